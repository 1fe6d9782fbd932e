"""Cross-site boilerplate lines, in Spark's own functions only.

A line's spread is the number of distinct sites that have it. HyperLogLog sketches per line
hash are merged by aggregation; lines whose estimate is near the threshold are counted
exactly; lines that reach it are cut out of every document.

With ``min_texts`` a line must also be in so many distinct texts on those sites, counted in
the same way: all copies of a text are one piece of evidence, so a document that is copied
to many sites keeps its lines. Near copies are distinct texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import beside, cut, row_key

#: Share of the threshold on either side of which an estimate counts as near. Sketches of
#: 2**12 registers have a standard error of 1.6 %, so this is over ten of them.
NEAR = 0.2
LOG_REGISTERS = 12
_BLANK = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(k0, k1, pos, h0, h1, site, copy) of every line with a word; two hashes tell the trimmed line, ``copy`` the whole text."""
    k0, k1 = row_key(id_col, text_col)
    rows = docs.select(k0.alias("k0"), k1.alias("k1"), F.col(f"`{site_col}`").cast("string").alias("site"), F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")))
    line = F.btrim("col", F.lit(_BLANK))
    return rows.where(line != "").select("k0", "k1", "pos", F.xxhash64(line).alias("h0"), F.hash(line, F.length(line)).alias("h1"), "site", "copy")


def spread(lines: DataFrame, *of: str) -> DataFrame:
    """(h0, h1, *of): the estimated number of sites, or of what ``of`` names, per line, from merged sketches."""
    of = of or ("site",)
    sketches = lines.where("site IS NOT NULL").groupBy("h0", "h1").agg(*[F.hll_sketch_agg(c, F.lit(LOG_REGISTERS)).alias(c) for c in of])
    return sketches.select("h0", "h1", *[F.hll_sketch_estimate(c).alias(c) for c in of])


def boilerplate(lines: DataFrame, min_sites: int, min_texts: int = 1) -> DataFrame:
    """(h0, h1) of the lines on ``min_sites`` sites or more, there in ``min_texts`` distinct texts or more."""
    least = {"site": min_sites} | ({"copy": min_texts} if min_texts > 1 else {})
    candidates = spread(lines, *least)
    for of, n in least.items():
        candidates = candidates.where(F.col(of) >= n * (1 - NEAR))
    candidates, found = cut(candidates), None
    for of, n in least.items():
        sure = candidates.where(F.col(of) > n * (1 + NEAR)).select("h0", "h1")
        near = candidates.where(F.col(of) <= n * (1 + NEAR)).select("h0", "h1")
        # Distinct before the join: a line that is everywhere comes once per site and task.
        pairs = lines.where("site IS NOT NULL").select("h0", "h1", of).distinct().join(near, ["h0", "h1"])
        exact = pairs.groupBy("h0", "h1").agg(F.count(of).alias("n")).where(F.col("n") >= n).select("h0", "h1")
        reached = sure.unionByName(exact)
        found = found.join(reached, ["h0", "h1"]) if found else reached
    return found


def _without(lines, places):
    """The lines but for those at the sorted places: slices between them, in one pass."""
    stops = F.array_append(places, F.size(lines))
    before = lambda i: F.coalesce(F.get(stops, i - 1), F.lit(-1))
    return F.flatten(F.transform(stops, lambda x, i: F.slice(lines, before(i) + 2, x - before(i) - 1)))


def clean(
    docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_texts: int = 1
) -> DataFrame:
    """(row, kept, n_lines, n_removed): each input row as a struct beside its text without boilerplate lines.

    ``n_lines`` counts lines with a word.

    * with ``min_texts``, lines of fewer distinct texts than that stay, on however many sites
    * lines are compared without the white space around them; blank lines always stay
    * a null site is no site; rows with null text have no lines and keep null
    * null ids and repeated rows: each row is cleaned for itself
    * an empty table: no rows; the other columns, whatever their names, travel in ``row``
    """
    lines = _lines(docs, id_col, text_col, site_col)
    found = lines.join(boilerplate(lines, min_sites, min_texts), ["h0", "h1"])
    places = found.groupBy("k0", "k1").agg(F.sort_array(F.collect_set("pos")).alias("__places"))
    both = beside(docs, places.withColumnsRenamed({"k0": "__k0", "k1": "__k1"}), id_col, text_col)
    text = F.col("row").getField(text_col)
    split, words = F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""
    kept = F.when(F.col("__places").isNull(), text).otherwise(F.array_join(_without(split, F.col("__places")), "\n"))
    return both.select(
        "row",
        kept.alias("kept"),
        F.coalesce(F.size(F.filter(split, words)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_removed"),
    )


def summary(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per input row: id, n_lines, n_removed and the digest of the text that is kept."""
    found = clean(docs, min_sites, id_col, text_col, site_col)
    digest = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return found.select(F.col("row").getField(id_col).alias(id_col), "n_lines", "n_removed", digest)


def without_boilerplate(
    docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str | None = None,
    min_texts: int = 1,
) -> DataFrame:
    """The documents with their own columns; the text, and its length in characters if named, are those of what is kept."""
    found = clean(docs, min_sites, id_col, text_col, site_col, min_texts)
    new = {text_col: F.col("kept")} | ({length_col: F.length("kept").cast(docs.schema[length_col].dataType)} if length_col else {})
    return found.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
