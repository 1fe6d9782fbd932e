"""Recall of the near-copy links against all pairs of five-word similarity 0.8: ``python tests/llm/shingle_recall.py DIR``.

Brute force is exact: of two sets with that similarity the rarest shingles of one, as many as
the other may lack and one more, hold a common one, so pairs that share one of those are
compared and no others need to be.
"""

from __future__ import annotations

import os
import sys
from collections import Counter, defaultdict
from functools import partial
from pathlib import Path


def similar_pairs(texts: list[str]) -> list[tuple[int, int]]:
    """Indices of all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    often = Counter(g for s in sets for g in s)
    filed, pairs = defaultdict(list), []
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for g in rare for j in filed[g]}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                pairs.append((j, i))
        for g in rare:
            filed[g].append(i)
    return pairs


def recall(spark, sf_dir: str) -> tuple[int, int]:
    """(pairs that the links bring into one class, all pairs) of the different texts of ``documents``."""
    from pulsegrid.llm import shingle_links, simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = sorted({r["text"] for r in docs.select("text").collect() if r["text"]})
    name = partial(simhash.fingerprint, words_per_shingle=3)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in shingle_links.links(docs, "doc_id", "text", 0.8, 5, name).collect():
        root[find(a & (1 << 64) - 1)] = find(b & (1 << 64) - 1)
    pairs = similar_pairs(texts)
    return sum(find(name(texts[i])) == find(name(texts[j])) for i, j in pairs), len(pairs)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    print("found, all:", *recall(session, sys.argv[1]))
