"""The policy file: patterns, exclusions, extensions, entropy and limits, found beside the sources, merged over the defaults and checked."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date
from pathlib import Path

from leakloom.functions import constants
from leakloom.operators import rules as R
from leakloom.plans.limits import Limits
from leakloom.sources.text import DEFAULT_EXCLUSIONS

NAME = "leakloom.toml"
POLICIES = {"Ignore": "ignore", "ScanButWarn": "warn", "ScanButAllow": "allow"}
MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Policy:
    rules: tuple[R.Rule, ...] = R.BUILTIN
    extensions: tuple[str, ...] = tuple(constants.EXTENSIONS.split())
    exclusions: tuple[tuple[str, str], ...] = DEFAULT_EXCLUSIONS
    entropy: bool = True
    threshold: float = 4.8
    min_length: int = 30
    max_depth: int = 1000
    since: str | None = None
    until: str | None = None
    limits: Limits = field(default_factory=Limits)


class PolicyError(ValueError):
    pass


def discovered(start: str) -> str | None:
    """The policy file of the nearest folder from start upwards; not above a folder that holds a repository."""
    at = Path(start).resolve()
    at = at if at.is_dir() else at.parent
    for folder in (at, *at.parents):
        if (folder / NAME).is_file():
            return str(folder / NAME)
        if (folder / ".git").exists():
            return None
    return None


def _section(data: dict, name: str, known: dict[str, type | tuple[type, ...]]) -> dict:
    own = data.get(name, {})
    if not isinstance(own, dict) or (unknown := own.keys() - known.keys()):
        raise PolicyError(f"unknown fields in {name}: {sorted(unknown) if isinstance(own, dict) else own}")
    for key, value in own.items():
        if isinstance(value, bool) != (known[key] is bool) or not isinstance(value, known[key]):
            raise PolicyError(f"{name}.{key} has a value of another kind")
    return own


def merged(text: str, base: Policy | None = None) -> Policy:
    """A policy file over another policy: patterns replace those of their name or come after all, extensions are added whatever their case, of equal
    exclusions the last counts, the fields of other sections replace. Unknown fields and values out of range are errors."""
    base = base or Policy()
    if len(text.encode()) > MOST_BYTES:
        raise PolicyError("the policy file is too large")
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise PolicyError(str(e)) from e
    if unknown := data.keys() - {"patterns", "extensions", "exclusions", "entropy", "git", "limits"}:
        raise PolicyError(f"unknown sections: {sorted(unknown)}")
    by_name = {r.name: r for r in base.rules}
    for x in data.get("patterns", []):
        if x.keys() - {"name", "pattern", "description", "severity"} or not {"name", "pattern"} <= x.keys():
            raise PolicyError(f"a pattern has name, pattern, description and severity: {x}")
        if x.get("severity", "Medium") not in constants.SEVERITIES.split():
            raise PolicyError(f"no severity: {x['severity']}")
        old = by_name.get(x["name"])
        try:
            re.compile(x["pattern"])
            by_name[x["name"]] = replace(old, severity=x.get("severity", "Medium")) if old and old.builtin and old.pattern == x["pattern"] else R.own(x["name"], x["pattern"], x.get("severity", "Medium"))
        except (re.error, ValueError) as e:
            raise PolicyError(f"{x['name']}: {e}") from e
    extensions = dict.fromkeys([*base.extensions, *(str(x).lower().removeprefix(".") for x in data.get("extensions", []))])
    exclusions = list(base.exclusions)
    for x in data.get("exclusions", []):
        if x.keys() != {"pattern", "policy"} or x["policy"] not in POLICIES:
            raise PolicyError(f"an exclusion has pattern and policy: {x}")
        exclusions = [e for e in exclusions if e[0] != x["pattern"]] + [(x["pattern"], POLICIES[x["policy"]])]
    entropy = _section(data, "entropy", {"enabled": bool, "threshold": (int, float), "min_length": int})
    git = _section(data, "git", {"max_depth": int, "since_date": str, "until_date": str})
    sizes = _section(data, "limits", {f.name: int for f in fields(Limits)})
    out = replace(
        base, rules=tuple(by_name.values()), extensions=tuple(extensions), exclusions=tuple(exclusions), entropy=entropy.get("enabled", base.entropy), threshold=float(entropy.get("threshold", base.threshold)),
        min_length=entropy.get("min_length", base.min_length), max_depth=git.get("max_depth", base.max_depth), since=git.get("since_date", base.since), until=git.get("until_date", base.until), limits=replace(base.limits, **sizes),
    )
    return checked(out)


def checked(policy: Policy) -> Policy:
    if not 0 <= policy.threshold <= 8 or policy.min_length < 1 or policy.max_depth < 1:
        raise PolicyError("entropy.threshold is from 0 to 8, entropy.min_length and git.max_depth are at least 1")
    if low := [k for k, v in asdict(policy.limits).items() if v < 1]:
        raise PolicyError(f"limits must be at least 1: {low}")
    days = []
    for day in (policy.since, policy.until):
        try:
            days.append(date.fromisoformat(day) if day is not None and len(day) == 10 else None)
        except ValueError:
            days.append(None)
        if day is not None and days[-1] is None:
            raise PolicyError(f"no date: {day}")
    if None not in days and days[0] > days[1]:
        raise PolicyError("since_date is after until_date")
    if not all(re.fullmatch(r"[a-z0-9_+-]+", x) for x in policy.extensions) or not all(p for p, _ in policy.exclusions):
        raise PolicyError("an extension or the pattern of an exclusion is empty or odd")
    return policy


def load(path: str | None = None, start: str = ".", use: bool = True) -> Policy:
    """The given file, else the discovered one, else the defaults; only the defaults if not `use`."""
    path = (path or discovered(start)) if use else None
    return merged(Path(path).read_text(encoding="utf-8")) if path else Policy()


def shown(policy: Policy) -> dict:
    """What `show-config` prints: the merged policy and its digest."""
    names = {v: k for k, v in POLICIES.items()}
    own = {
        "patterns": [{"name": r.name, "pattern": r.pattern, "severity": r.severity} for r in policy.rules], "extensions": list(policy.extensions),
        "exclusions": [{"pattern": p, "policy": names[x]} for p, x in policy.exclusions], "entropy": {"enabled": policy.entropy, "threshold": policy.threshold, "min_length": policy.min_length},
        "git": {k: v for k, v in (("max_depth", policy.max_depth), ("since_date", policy.since), ("until_date", policy.until)) if v is not None}, "limits": asdict(policy.limits),
    }
    return {"schema_version": 1, "sha256": hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest(), "policy": own}


def toml(policy: Policy) -> str:
    """A policy file that gives this policy again."""
    own, lines = shown(policy)["policy"], []
    lines.append(f"extensions = {json.dumps(own['extensions'])}")
    for name in ("entropy", "git", "limits"):
        lines += [f"\n[{name}]", *(f"{k} = {json.dumps(v)}" for k, v in own[name].items())]
    for name in ("patterns", "exclusions"):
        for x in own[name]:
            lines += [f"\n[[{name}]]", *(f"{k} = {json.dumps(v)}" for k, v in x.items())]
    return "\n".join(lines) + "\n"
