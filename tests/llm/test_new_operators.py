"""Winnowing, centroid clustering and collocations against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows_of, rows_of_sql
from pyspark.sql import functions as F

from pulsegrid.llm import centroids, collocations, fingerprints, substring_index
from pulsegrid.llm.oracles import ORACLES
from pulsegrid.llm.queries import QUERIES

WORDS = "the of and to in river stone cloud seven market window paper light".split()
DOCS = "doc_id long, text string, lang string, k0 long, r string, range string, id string, n string, f string, word string"


def prose(seed, n, span=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(span)) for _ in range(n))


def awkward():
    texts = [
        (None, None), (3, ""), (1, " \n\t "), (7, "one two"), (4, "a" * 3000), (5, prose(1, 90)), (6, "head " + prose(1, 90)),
        (7, prose(1, 90)), (7, prose(1, 90)), (7, prose(1, 90)), (None, prose(2, 30)), (8, prose(3, 4000)), (9, "Größe ÜBER çé 漢字漢字 " * 40),
        (10, "x y " * 200), (12, "the the the, the. the the"), (13, "天地玄黃宇宙洪荒" * 30), (40, "b" * 31 + " " + "c" * 33),
    ]
    return [(i, t, None if k % 5 == 0 else "en", 1, "r", "x", "i", "n", "f", "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_phrase_collocations"])
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


# --- winnowing ---


def slow_units(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        out += list(w) if len(w) > fingerprints.LONG_WORD else [w]
    return out


def run_hashes(spark, texts, k):
    """Spark's hash of each distinct run of units, taken one by one."""
    runs = {tuple(u[i : i + k]) for u in map(slow_units, texts) for i in range(max(1, len(u) - k + 1)) if u}
    cols = [f"c{j}" for j in range(k)]
    rows = spark.createDataFrame([r + (None,) * (k - len(r)) for r in runs], ", ".join(f"{c} string" for c in cols))
    told = rows.select(*cols, F.xxhash64(*cols).alias("h")).collect()
    return {tuple(v for v in r[:-1] if v is not None): r.h & 0xFFFFFFFF for r in told}


def slow_winnow(hashed, text, k, w):
    u = slow_units(text)
    h = [hashed[tuple(u[i : i + k])] for i in range(max(1, len(u) - k + 1))] if u else []
    chosen = set()
    for s in range(max(1, len(h) - w + 1) if h else 0):
        window = h[s : s + w]
        chosen.add(s + max(i for i, x in enumerate(window) if x == min(window)))
    return [(p, h[p]) for p in sorted(chosen)]


@pytest.mark.parametrize(("k", "w"), [(5, 8), (1, 1), (2, 5), (3, 7)])
def test_windows_choose_their_rightmost_least_hash(spark, docs, empty, k, w):
    hashed = run_hashes(spark, [r[1] for r in awkward()], k)
    got = fingerprints.fingerprints(docs, k, w)
    want = sorted(((i, *x) for i, t, *_ in awkward() for x in slow_winnow(hashed, t, k, w)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert fingerprints.fingerprints(empty, k, w).count() == 0


def test_a_shared_run_shares_a_hash(spark):
    """Any run of k + w - 1 units that two texts share puts one hash at matching places."""
    rng, rows, runs = random.Random(5), [], []
    for n in range(40):
        run = prose(1000 + n, fingerprints.K + fingerprints.WINDOW - 1, 10**6)
        for side in (0, 1):
            before = rng.randrange(60)
            rows.append((2 * n + side, " ".join(filter(None, [prose(n + 77 * side, before, 10**6), run, prose(n + 99 + 77 * side, rng.randrange(60), 10**6)]))))
            runs.append(before)
    found = {}
    for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add((r.place - runs[r.doc_id], r.hash))
    assert all(found[2 * n] & found[2 * n + 1] for n in range(40))


def slow_likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_neighbours(spark, rows):
    texts = {i: t or "" for i, t in rows}
    rows = [(i, t or "") for i, t in rows]
    key = {(i, t): spark.sql("SELECT xxhash64(:n, :t)", {"n": i is None, "t": t}).first()[0] if len(texts) < len(rows) else 0 for i, t in rows}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, key[r]))
    edited = []
    for (_, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        edited.append(t[: len(t) - m] + nxt[:m])
    hashed = run_hashes(spark, [t for _, t in rows] + edited, fingerprints.K)
    of = lambda t: slow_winnow(hashed, t, fingerprints.K, fingerprints.WINDOW)
    show = lambda f: ",".join(f"{p:X}:{h:X}" for p, h in f)
    for (i, t), e, (_, nxt) in zip(rows, edited, rows[1:] + rows[:1]):
        f, g = of(t), of(e)
        yield i, len(t), sha(e.encode()), show(f), show(g), slow_likeness(f, g), slow_likeness(f, of(nxt))


COLS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_neighbours_equal_brute_force(spark, docs, empty, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(i, t) for i, t, *_ in awkward() if t is not None]
        got = fingerprints.neighbours(docs.where("text IS NOT NULL"))
        assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=repr) == sorted(slow_neighbours(spark, rows), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert fingerprints.neighbours(empty).count() == 0


def test_neighbours_null_text_and_one_row(spark):
    one = spark.createDataFrame([(5, None)], "doc_id long, text string")
    assert [tuple(r) for r in fingerprints.neighbours(one).collect()] == [(5, 0, sha(b""), "", "", 1.0, 1.0)]
    alone = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.neighbours(alone).first().edited_sha256 == sha(b"abcdefab")


def test_fingerprints_of_documents(spark):
    """The registered query on a real table, and that texts and fingerprints are shuffled once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_document_fingerprints"](spark, SF)
    want = slow_neighbours(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert "Python" not in got._jdf.queryExecution().toString()


# --- centroids ---


def slow_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}".encode()), r[1]))
    centers = [x for _, x in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    pick = lambda x: min((dist(x, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(pick(x)[1], []).append(x)
        for j, xs in own.items():
            centers[j] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, *pick(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centers[c])).encode())) for i, c, d in found]


@pytest.mark.parametrize("rows_at_a_time", [8192, 7])
@pytest.mark.parametrize("n", [400, 5, 0])
def test_clusters_equal_brute_force(spark, monkeypatch, n, rows_at_a_time):
    monkeypatch.setattr(centroids, "BATCH_ROWS", rows_at_a_time)
    rng = np.random.default_rng(n)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 4, 64) / 8]) for i in rng.integers(0, 300, n)]
    vectors += [(v[0], v[1]) for v in vectors[:3]] + [(None, v[1]) for v in vectors[:2]]
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64), (7, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 0, 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, x string, cluster int, v int").repartition(3)
    got = [tuple(r) for r in centroids.clustered(df).collect()]
    assert sorted(got, key=repr) == sorted(slow_clusters(vectors + odd, 16, 3), key=repr)


def test_search_is_exact_and_prefers_the_smaller_number():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-4, 4, (500, 64)), rng.integers(-4, 4, (16, 64))
    c[9] = c[2]
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for block in (1, 8, 64):
        which, best = centroids.nearest(x, c, block)
        assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_components_that_are_too_large_raise(spark):
    df = spark.createDataFrame([(1, [3e38] + [0.0] * 63)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="or more"):
        centroids.clustered(df).collect()


# --- collocations ---


def slow_collocations(rows, min_count, top):
    n, f, out = Counter(), {}, []
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        found = []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, left, right = min((2000000 * a // (own[p[:j]] + own[p[j:]]), j, own[p[:j]], own[p[j:]]) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["La", "casa", "é", "bLUE", "\x1cx", "漢", "a\xa0b", "de", "of"]
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            words += ["big", "red", "house", "here"] * rng.randrange(3) + ["no", "no", "no"]
        yield rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for w in words)


@pytest.mark.parametrize(("seed", "min_count", "top", "chunk", "split"), [(1, 30, 2000, 1 << 21, 1 << 22), (2, 5, 2000, 50, 13), (3, 8, 7, 300, 64)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, min_count, top, chunk, split):
    """Also with chunks and steps that a text crosses; nulls, an empty text and repeated rows are among the rows."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "SPLIT_BYTES", split)
    rows = [*phrase_rows(seed), ("en", None), ("en", ""), (None, " \t ")]
    rows += rows[:9]
    df = spark.createDataFrame([(l, t, "c", 1, "w", 2, "p") for l, t in rows], "lang string, text string, chunk string, n long, word string, no long, phrase string").repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, min_count, top).collect()]
    assert sorted(got) == sorted(slow_collocations(rows, min_count, top))


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).count() == 0


def test_merged_lists_are_the_longer_phrases():
    words = np.array([0, 1, 0, 1, 2, 0, 1, 2, 2])
    positions = np.array([0, 1, 2, 3, 4, 6, 7, 8, 9])  # a piece ends after 4
    at, which, first, last, n = collocations.merged(positions, words)
    want = Counter((words[i], words[i + 1]) for i in range(8) if positions[i] + 1 == positions[i + 1])
    assert {(a, b): c for a, b, c in zip(first, last, n)} == want
    assert all((first[j], last[j]) == (words[list(positions).index(p)], words[list(positions).index(p) + 1]) for p, j in zip(at, which))
    assert list(itertools.accumulate(n))[-1] == len(at)


def test_the_substring_query_compacts_below_the_shared_folder(spark, monkeypatch):
    """Five batches through levels of four: the last is joined with one merged run; nothing stays behind."""
    from pathlib import Path

    seen, joined = [], []
    compact, candidates = substring_index.SubstringIndex.compact, substring_index.SubstringIndex.candidates

    def watched_compact(self):
        compact(self)
        seen.append([len(level) for level in self.levels])

    def watched_candidates(self, new):
        joined.append(len(self.runs()))
        return candidates(self, new)

    monkeypatch.setattr(substring_index.SubstringIndex, "compact", watched_compact)
    monkeypatch.setattr(substring_index.SubstringIndex, "candidates", watched_candidates)
    assert QUERIES["op10_substring_dedup"](spark, SF).count() > 0
    assert seen[2:] == [[3], [0, 1], [1, 1]] and joined == [0, 1, 2, 3, 1]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    assert not list(shared.glob("substring_index-*")) and not list(Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")).glob("substring_index*"))


def test_blocks_of_a_batch_are_found_once(spark, tmp_path):
    """Words of a text are split and hashed once for the batch's run and its removals."""
    from pulsegrid.llm.anchors import Windows
    from pulsegrid.llm.shared import keyed

    log = str(tmp_path / "calls")

    def counted(text):
        with open(log, "a") as f:
            f.write(f"{len(text)}\n")
        return substring_index._words(text)

    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{'x ' * i}{passage} {'y ' * i}") for i in range(1, 6)], "doc_id long, text string").cache()
    index = substring_index.SubstringIndex(spark)
    index.spec = Windows(50, 8, counted)
    try:
        got = {r["id"]: r["n_removed"] for r in index.add(keyed(docs, "doc_id", "text")).collect()}
    finally:
        index.drop()
    assert got[1] == 0 and all(got[i] >= 60 for i in range(2, 6))
    with open(log) as f:
        assert len(f.read().split()) == 5
