import random

import pytest

from leakloom.operators import history


def brute(edges, tips):
    up = {}
    for r, c, p in edges:
        up.setdefault((r, c), set())
        if p is not None:
            up[r, c].add((r, p))

    def reach(start):
        seen, todo = set(), list(start)
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    old = reach((r, c) for r, c, b in tips if b)
    return {x for x in reach((r, c) for r, c, b in tips if not b) if x not in old}, up


def test_scopes(spark):
    rng = random.Random(3)
    edges, tips = [], []
    for repo in range(12):
        for c in range(40):
            parents = sorted(rng.sample(range(c), min(c, rng.choice([0, 1, 1, 2, 3]))))
            edges += [(repo, c, p) for p in parents] or [(repo, c, None)]
        tips += [(repo, rng.randrange(40), b) for b in (False, False, True)]
    n = 10_000
    edges += [(99, i, i - 1 if i else None) for i in range(n)]
    tips += [(99, n - 1, False), (99, 99, True)]
    e, t = spark.createDataFrame(edges, "repo int, commit long, parent long"), spark.createDataFrame(tips, "repo int, commit long, base boolean")
    got = {(r.repo, r.commit): (r.distance, r.generation) for r in history.scopes(e, t).collect()}
    want, up = brute(edges, tips)
    assert got.keys() == want and got[99, 100][1] == 0 and got[99, n - 1] == (0, n - 101)
    for x in want:
        inside = [got[p][1] for p in up[x] if p in want]
        assert got[x][1] == (max(inside) + 1 if inside else 0)
    with pytest.raises(Exception, match="more than 50 commits"):
        history.scopes(e, t, 50).collect()
    with pytest.raises(Exception, match="missing"):
        history.scopes(e.where("repo = 99 and commit <> 500"), t.where("repo = 99")).collect()


def test_changed_files(spark):
    child = [(1, "same", "a", "100644"), (1, "new", "b", "100644"), (1, "merged", "c", "100644"), (1, "vendor/x", "d", "100644"), (1, "mode", "e", "100755")]
    parents = [(1, 0, "same", "a", "100644"), (1, 0, "gone", "z", "100644"), (1, 0, "mode", "e", "100644"), (1, 1, "merged", "c", "100644"), (1, 0, "merged", "old", "100644")]
    c = spark.createDataFrame(child, "commit int, path string, blob string, mode string")
    p = spark.createDataFrame(parents, "commit int, parent_no int, path string, blob string, mode string")
    out = history.changed_files(c, p, "startswith(path, 'vendor/')")
    assert {r.path: r.reason for r in out.collect()} == {"new": None, "gone": "deleted", "merged": "content unchanged in a parent", "vendor/x": "trusted exclusion", "mode": "content unchanged in a parent"}
    assert {r.reason: r.n for r in history.skipped(out).collect()} == {"deleted": 1, "trusted exclusion": 1, "content unchanged in a parent": 2}
    link = spark.createDataFrame([(1, "l", "q", "120000")], c.schema)
    with pytest.raises(Exception, match="no regular file"):
        history.changed_files(link, p).collect()


def test_dates_and_merges(spark):
    commits = spark.sql("SELECT explode(array(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 23:59:59.5', TIMESTAMP '2024-01-03 00:00:00')) AS committed_at")
    assert tuple(history.date_scope(commits, "2024-01-01", "2024-01-02").first()) == (3, 2, 1)
    assert tuple(history.date_scope(commits).first()) == (3, 3, 0)
    for bad in ("2024-1-01", "2024-02-30", "20240101"):
        with pytest.raises(ValueError):
            history.date_scope(commits, bad)
    merges = spark.createDataFrame([(9, [1, 2])], "commit long, parents array<long>")
    assert history.merge_result(merges, 1, 2).count() == 1
    with pytest.raises(Exception, match="no merge"):
        history.merge_result(merges, 1, 3).collect()
