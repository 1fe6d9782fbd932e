"""Token totals for every context limit, from an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.byte_bpe import default_ranks, encoding, split_words
from pulsegrid.llm.shared import cut

#: Words whose token counts a task remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Lengths per block in the two-level suffix sums.
BLOCK = 128


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row; a null text has no tokens."""
    path = path or default_ranks()

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary

        class Counts(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(encode(" " + word))
                return n

        known = Counts()

        def tokens(text: str | None) -> int:
            if not text:
                return 0
            first, *rest = split_words(text)
            return len(encode(first)) + sum(map(known.__getitem__, rest))

        for texts in parts:
            yield pd.Series(np.fromiter(map(tokens, texts), np.int64, len(texts)))
            if len(known) > REMEMBERED:
                known.clear()

    return docs.select(F.col(f"`{id_col}`"), count(F.col(f"`{text_col}`")).alias("n_tokens"))


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): lengths are summed up within each task before the shuffle."""
    return counted.groupBy(F.col(length_col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as the context limit:

    n_docs of that length, docs_longer, docs_total, tokens_total, tokens_truncated (each
    document cut at the limit), tokens_lost, and quantile, the share of documents that fit.
    Any other limit L answers from the row of the largest length at or below it:
    ``tokens_truncated + (L - n_tokens) * docs_longer``.

    Sums run in two levels: within blocks of lengths in parallel, and over one row per
    block. A length that no document has gives no row; an empty histogram none at all.
    """
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = sums.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    after = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(after), F.lit(0)) + F.col("d_after")).alias("docs_longer"),
        (F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(after), F.lit(0)) + F.col("t_after")).alias("t_longer"),
        "docs_total",
        "tokens_total",
    )
    cut_off = F.col("t_longer") - F.col("n_tokens") * F.col("docs_longer")
    return longer.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - cut_off).alias("tokens_truncated"),
        cut_off.alias("tokens_lost"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``context_limits`` of the documents' own histogram.

    Null and empty texts count as length 0, repeated rows each; ids may be null, for they
    are not used; other columns are not read; an empty table gives no rows.
    """
    # Used twice below, and no longer than the longest text: kept, so that texts are encoded once.
    return context_limits(cut(histogram(lengths(docs, id_col, text_col, path))))
