"""Quality rules as a bitmask ledger, in Spark's own functions only.

``ledger`` evaluates every rule once per document and stores the measurements and
one failure bit per rule. A policy is a versioned set of rules; applying one is a
bitwise AND over the stored bits, and an ablation is an aggregation over them: no text
is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import WORD_GAP, cut

#: The rules in the order of their bits; each fails where its condition is true.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "shouting": "2 * n_upper_runs > n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_runs")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules: a document is kept if none of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, not once for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by hash with their places; equal neighbours, confirmed word by
    word, are repeats. Sorting keeps the work at n log n for texts of any length.
    """
    hashes = lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    sorted_ = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda w, a, b: (
        (a["h"] == b["h"])
        & (F.get(w, a["i"]) == F.get(w, b["i"]))
        & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1))
        & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2))
    )
    places = lambda w, s: F.transform(
        F.filter(s, lambda x, j: same(w, x, F.get(s, j - 1)) | same(w, x, F.get(s, j + 1))), lambda x: x["i"]
    )
    # Each window covers three places; one that starts d < 3 after the window before it adds d of them.
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    counted = lambda w, h: _bound(sorted_(h), lambda s: _bound(F.sort_array(places(w, s)), covered))
    # Most texts have no repeated window at all: a hash set tells, and the sort is left out.
    return _bound(
        words,
        lambda w: _bound(
            hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(w, h))
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, every measurement and ``failed_bits``.

    * null text: no words, so every count is 0 and ``few_words`` fails; an empty text likewise
    * null id: kept as null; repeated rows: one result row each; an empty table: no rows
    * very long texts are measured whole; the work grows as n log n with their words
    * other columns of the input, whatever their names, are not read
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    gaps = " \t\n\x0b\x0c\r"
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("t"))
    words = F.array_remove(F.split("t", WORD_GAP), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(gaps)) != "")
    measured = base.select(
        F.col(id_col),
        _bound(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            ),
        ).alias("w"),
        _bound(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
        sum((F.length("t") - F.length(F.replace("t", F.lit(c))) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_upper_runs"),
    ).select(id_col, "w.*", "l.*", "n_symbols", "n_upper_runs")
    bits = sum((F.when(F.expr(cond), BITS[name]).otherwise(0) for name, cond in RULES.items()), F.lit(0))
    return measured.select(id_col, *MEASURES, bits.cast("long").alias("failed_bits"))


def apply_policy(rows: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """Adds the boolean ``out``: no rule of the policy fails."""
    return rows.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.

    One pass of conditional counts over the stored bits; also ``all_bits`` and
    ``common_bits``, the OR and the AND over all documents.
    """
    failed = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    counts = [
        F.struct(
            F.lit(r).alias("rule"),
            F.count_if(failed.bitwiseAND(F.lit(BITS[r])) != 0).alias("n_failed"),
            F.count_if(failed == BITS[r]).alias("n_only"),
        )
        for r in policy.rules
    ]
    return rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.bit_or("failed_bits").alias("all_bits"),
        F.bit_and("failed_bits").alias("common_bits"),
        F.array(*counts).alias("r"),
    ).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "n_docs", "all_bits", "common_bits", F.inline("r"))


def policy_report(docs: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ablations`` of several versioned policies over one ledger, written once to the shared folder.

    Null, empty and very long texts, null ids and repeated rows are as in ``ledger``; of an
    empty table the counts are 0 and the bits null.
    """
    stored = cut(ledger(docs, id_col, text_col).select("failed_bits"))
    first, *rest = [ablations(stored, p) for p in policies]
    for more in rest:
        first = first.unionByName(more)
    return first


def quality(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (false if ``base_failed``, else the policy's verdict)."""
    rows = apply_policy(apply_policy(ledger(docs, id_col, text_col), BASE, "base_ok"), policy)
    return rows.select(
        id_col, *MEASURES, "failed_bits", (~F.col("base_ok")).alias("base_failed"), (F.col("kept") & F.col("base_ok")).alias("kept")
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that the policy keeps, with their own columns alone.

    The verdict is a function of the row's text, so no join is needed: the measurements
    are computed beside the row and dropped again. Null and empty texts go, for they have
    too few words; null ids and repeated rows are judged by their text; other columns travel
    along, whatever their names; an empty table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return quality(whole, policy, "row", "text").where("kept").select("row.*")
