"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

1. Units: of every text that holds a keyword of licences the sentences with one (cut at line ends, and after `.` or `;` and white
   space), and each longest run of paragraphs with one (cut at empty lines): a licence body in a header without a title is such a run;
   of a licence file (by its name) the whole text too.
2. Each unit is a sparse vector: term frequency times inverse document frequency, where the frequencies are those over all units of all
   texts. Templates are weighed by the same. The cosine to all templates comes from one join on terms with the template table, whose
   size is fixed in this file. A unit has the licence of its best template if the cosine is at least `least`.
3. A file's own licence is that of its best unit (then the first). A directory's is that of its best licence file (then the first by name).
   A file without its own has that of the nearest directory above it: directories, each once, are joined to their ancestors' licences, and
   files to their directories.

Frequencies meet the units' terms in two joins: of the terms that stand in a ten-thousandth of all rows or more there are at most
10,000, which are broadcast, so that a very common term is no hot key; all others are joined by shuffling. A directory that holds most
files meets its one row in a plain equi-join, which Spark can split.

Defined results: null and empty texts have no units; texts of any length are taken whole; a null path has no directory and inherits
nothing; rows with equal paths are judged each by itself; ties go to the first name; an empty table gives an empty one. Other columns of
the input stay, one that is named like a result as `<name>_in`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import common

LEAST = 0.6
KEYWORDS = r"(?i)licen[sc]e|copyright|copyleft|permission|redistribut|warrant|public domain|spdx|creative commons|\bcc by|all rights reserved"
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*\+?"
#: Terms that stand in at least this share of all rows of terms are joined by a broadcast: at most its inverse.
COMMON = 1e-4
LICENCE_FILE = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying)(?:[._-][^/]*)?$"

#: Bags of words, each by name: forms of headers, and the vocabulary of whole licences in alphabetical order.
HEADERS = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "spdx-license-identifier apache-2.0"],
    "MIT": ["released under the mit license", "licensed under the mit license", "the mit license", "spdx-license-identifier mit"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "gnu general public license version 3 29 june 2007", "spdx-license-identifier gpl-3.0"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "spdx-license-identifier gpl-2.0"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx-license-identifier lgpl-3.0"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0"],
    "BSD-3-Clause": ["licensed under the bsd 3-clause license", "released under the bsd license", "spdx-license-identifier bsd-3-clause"],
    "BSD-2-Clause": ["licensed under the bsd 2-clause license", "spdx-license-identifier bsd-2-clause"],
    "ISC": ["licensed under the isc license", "spdx-license-identifier isc"],
    "MPL-2.0": ["subject to the terms of the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license"],
    "CC0-1.0": ["licensed under cc0 1.0", "dedicated to the public domain under cc0 1.0 universal"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved"],
}
WHOLE = {
    "MIT": "above action any arising associated authors charge claim conditions connection contract copies copyright damages dealings distribute documentation event express files fitness following free furnished granted hereby holders implied included liability liable limitation merchantability merge modify noninfringement notice obtaining otherwise particular permission permit person portions publish purpose restriction sell software sublicense subject substantial tort warranties warranty whom",
    "BSD-3-Clause": "above advised binary business caused conditions consequential contributors copyright damages data derived direct disclaimed disclaimer documentation endorse exemplary express fitness following forms holders implied incidental indirect interruption liability loss materials merchantability met modification names negligence neither notice permission permitted possibility prior procurement products profits promote provided punitive redistributions reproduce retain services source specific strict substitute theory tort warranties written",
    "ISC": "action aforementioned appear arising author consequential contract copies copyright damages data disclaims distribute fee fitness granted hereby implied indirect loss merchantability modify negligence notice performance permission profits purpose regard resulting software special tortious use warranties whatsoever",
    "Apache-2.0": "additional apache attribution basis boilerplate compliance conditions contribution contributor copyright cross-claim derivative disclaimer distribution exercising governing grant granted irrevocable law legal liability licensable license licensor limitations litigation modifications no-charge non-exclusive notice object obligations patent permissions perpetual redistribution reproduction royalty-free source submission trademarks version warranties work worldwide",
    "BSD-2-Clause": "above binary business caused conditions consequential contributors copyright damages data direct disclaimed disclaimer documentation event exemplary express fitness following forms goods holder holders implied incidental indirect interruption liability limited list loss materials merchantability met modification negligence notice particular permitted possibility procurement profits provided purpose redistribution redistributions reproduce retain services software source special strict substitute theory tort use warranties",
    "MPL-2.0": "applicable claims contribution contributor contributions copyright covered distribute distribution executable form grant grants initial larger license licensable licenses made mozilla modifications notice notices patent party public royalty-free secondary software source terms trademarks under version warranty work world-wide you your",
    "CC-BY-4.0": "adapted adapter appropriate attribution collecting commons copyright creative creator credit database effective exceptions indicate international legal licensed licensor limitations litigation material modified moral non-exclusive non-sublicensable patent public purpose reasonable receive recipients reproduce retain royalty-free share shared similar technological trademark voluntary waive worldwide",
    "CC0-1.0": "affirmer abandon affirm associated author claims commons copyright copyright-related creative creator cultural dedication disclaims domain fallback fullest future irrevocable legal moral neighboring perpetual permitted public purpose related relinquish rights royalty-free statement surrender unconditional unconditionally universal waive waiver waives work worldwide",
    "Unlicense": "anyone author authors benefit binary commercial compile compiled copy copyright dedicate dedication detriment distribute domain encumbered free freely heirs intend interest jurisdictions large laws means modify non-commercial overt perpetuity present public publish recognize relinquishment released sell software source successors unencumbered use",
    "GPL-2.0": "accompany appropriate charge circumstances conditions copies copying copyright derivative distribute distribution executable fee foundation free freedom general gnu interchange license licensees machine-readable medium modify notice obligations offer option patent program public recipients refrain royalty-free source software terms verbatim version warranty work",
    "GPL-3.0": "affero anti-circumvention aggregate conditions conveying copyleft copying corresponding covered derived freedom general gnu installation license licensors modified network non-source object patents permissions propagate program public recipients software source standard sublicensing system termination verbatim version warranty work",
}


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """template, license, term, n: of fixed size."""
    rows = [(i, name, text) for i, (name, text) in enumerate([(k, x) for k, v in HEADERS.items() for x in v] + list(WHOLE.items()))]
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, name, text in rows)
    table = spark.sql(f"SELECT col1 AS template, col2 AS license, col3 AS text FROM VALUES {values}")
    return table.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("n"))


UNITS = "array<struct<place:int,text:string>>"


def units(files: DataFrame) -> DataFrame:
    """_row, path, and _units (array of place, text): sentences by their number from 0, runs of paragraphs by theirs from -2 downwards, -1 a whole licence file."""
    empty = F.array().cast(UNITS)
    sentences = F.filter(F.transform(F.split("text", r"\n|(?<=[.;])\s+"), lambda x, i: F.struct(i.alias("place"), x.alias("text"))), lambda x: x["text"].rlike(KEYWORDS))
    # paragraphs without a keyword become a mark that no paragraph holds; what is between marks are the runs
    paragraphs = F.transform(F.split("text", r"\n[ \t\r]*\n\s*"), lambda x: F.when(x.rlike(KEYWORDS), x).otherwise(F.lit("\n\n")))
    runs = F.filter(F.split(F.array_join(paragraphs, "\n"), "\n\n"), lambda x: x.rlike(KEYWORDS))
    runs = F.transform(runs, lambda x, i: F.struct((-2 - i).alias("place"), x.alias("text")))
    some = F.when(F.col("text").rlike(KEYWORDS), F.concat(sentences, runs)).otherwise(empty)
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array(F.struct(F.lit(-1).alias("place"), F.col("text")))).otherwise(empty)
    return files.withColumn("_units", F.when(F.col("text").isNotNull(), F.concat(whole, some)).otherwise(empty)).drop("text").withColumn("_row", F.monotonically_increasing_id())


def matched(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """_row, place, license, score: each unit's best template, if it is near enough."""
    spark = rows.sparkSession
    every = rows.where(F.size("_units") > 0).select("_row", F.explode("_units").alias("u")).select("_row", "u.place", terms(F.col("u.text")).alias("terms"))
    own = every.select("_row", "place", F.explode("terms").alias("term")).groupBy("_row", "place", "term").agg(F.count("*").alias("n"))
    own = common.written(own)
    n_units = every.count()
    seen = common.checkpointed(own.groupBy("term").agg(F.count("*").alias("df")))
    n_rows = seen.agg(F.sum("df")).first()[0] or 0
    idf = lambda df: F.log((1 + F.lit(n_units)) / (1 + df)) + 1
    often = seen.where(F.col("df") >= max(1, n_rows * COMMON)).withColumnRenamed("df", "often")  # at most 1 / COMMON terms
    both = own.join(F.broadcast(often), "term", "left")
    weighed = both.where("often is not null").unionByName(both.where("often is null").drop("often").join(seen.where(F.col("df") < max(1, n_rows * COMMON)), "term").withColumnRenamed("df", "often"))
    weighed = weighed.withColumn("w", F.col("n") * idf(F.col("often")))
    forms = templates(spark).join(seen, "term", "left").withColumn("t", F.col("n") * idf(F.coalesce("df", F.lit(0))))
    forms = forms.withColumn("t", F.col("t") / F.sqrt(F.sum(F.col("t") * F.col("t")).over(Window.partitionBy("template"))))
    # one row for each term of the templates, whose number is fixed: a proven bound
    forms = forms.groupBy("term").agg(F.collect_list(F.struct("template", "license", "t")).alias("forms"))
    met = weighed.join(F.broadcast(forms), "term", "left")
    size = F.sqrt(F.sum(F.col("w") * F.col("w")))
    sizes = met.groupBy("_row", "place").agg(size.alias("size"))
    near = met.where("forms is not null").select("_row", "place", "w", F.inline("forms")).groupBy("_row", "place", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    near = near.join(sizes, ["_row", "place"]).withColumn("score", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("score") >= least)
    best = near.groupBy("_row", "place").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("b"))
    return best.select("_row", "place", "b.license", (-F.col("b.low")).alias("score"))


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scanned(files: DataFrame, least: float = LEAST) -> DataFrame:
    """files (path, text, more) without text, with license, score, found (header, file, inherited or null), origin (path of the licence file)."""
    files, names = common.apart(files, ("license", "score", "found", "origin"), ("_row", "_units", "own", "grant", "_folder", "_above", "low", "place"))
    names = [x for x, c in zip(names, files.columns, strict=True) if c != "text"]
    rows = common.written(units(files))
    found = common.checkpointed(matched(rows, least))
    own = found.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("low"), "place", "license")).alias("own"))
    with_own = rows.drop("_units").join(own, "_row", "left").withColumn("_folder", folder(F.col("path")))
    is_file = F.col("path").rlike(LICENCE_FILE)
    granted = with_own.where(is_file & F.col("own").isNotNull()).groupBy("_folder").agg(F.min(F.struct(F.col("own.low").alias("low"), "path", F.col("own.license").alias("license"))).alias("grant"))
    granted = granted.select(F.col("_folder").alias("_above"), "grant")
    parts = F.split("_folder", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    folders = with_own.where("own is null and _folder is not null").select("_folder").distinct()
    given = folders.select("_folder", F.explode(F.array_distinct(above)).alias("_above")).join(granted, "_above")
    nearest = given.groupBy("_folder").agg(F.max_by("grant", F.length("_above")).alias("grant"))
    out = with_own.join(nearest, "_folder", "left").withColumn("grant", F.when(F.col("own").isNull(), F.col("grant")))
    return out.select(
        *(c for c in files.columns if c != "text"),
        F.coalesce("own.license", "grant.license").alias("license"),
        (-F.coalesce("own.low", "grant.low")).alias("score"),
        F.when(F.col("own").isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col("grant").isNotNull(), "inherited").alias("found"),
        F.col("grant.path").alias("origin"),
    ).toDF(*names, "license", "score", "found", "origin")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; each gets one: source, language and a hundredth of its id are directories, and a text whose first
    line holds a keyword is its directory's licence file."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    first = F.substring_index("text", "\n", 1)
    name = F.when(first.rlike(KEYWORDS), F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 100).cast("string"), name)
    return scanned(docs.select("doc_id", path.alias("path"), "text"))
