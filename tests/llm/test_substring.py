import hashlib
import random

import numpy as np
import pytest

from featloom.llm import substring as ss


def brute(rows, size):
    """Places are (id, start); a window goes if the same words start at a smaller place."""
    def key(i):
        return (i is not None, i or 0)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            place = (key(i), k)
            x = tuple(w[k:k + size])
            first[x] = min(first.get(x, place), place)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < (key(i), k):
                keep[k:k + size] = [False] * size
        left = [x for x, k in zip(w, keep) if k]
        out.append((i, len(w), len(w) - len(left), b" ".join(left).decode()))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: ((r[0] is not None, r[0] or 0), r[1:]))


PASSAGE = " ".join(f"p{k}" for k in range(30))


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_rows(spark, docs_of, partitions):
    rows = [(5, PASSAGE), (2, f"x {PASSAGE} y"), (2, f"x {PASSAGE} y"), (None, PASSAGE), (7, None), (8, ""), (9, "a " * 70), (2, "other " + PASSAGE),
            (10, " ".join(f"p{k}" for k in range(19))), (11, PASSAGE + "\n" + PASSAGE), (12, "tab\tand\x0bwords\xa0kept " * 12)]
    docs = docs_of(rows).repartition(partitions)
    assert got(ss.without_repeats(docs)) == brute(rows, 20)


def test_random_passages(spark, docs_of):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(passages) if rng.random() < 0.5 else f"w{rng.randint(0, 9**6)}" for _ in range(rng.randint(0, 8)))) for k in range(60)]
    assert got(ss.without_repeats(docs_of(rows).repartition(4))) == brute(rows, 20)


def test_empty_table(docs_of):
    assert ss.without_repeats(docs_of([])).count() == 0


def test_a_full_sketch_loses_nothing(spark, docs_of, monkeypatch):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 400}" for j in range(60))) for k in range(80)]
    monkeypatch.setattr(ss, "MIN_CELLS", 6)
    from pyspark.sql import functions as F
    docs = docs_of(rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")
    few = ss.repeated_places(docs, max_cells=6).count()
    assert few == ss.repeated_places(docs).count() == sum(r[2] > 0 for r in brute(rows, 20))


def test_anchor_is_inside_its_window_and_the_same_for_equal_ones():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    at = np.arange(len(words) - 19)
    hashes, places = ss._anchors(words, at, 20, 8)
    assert ((places >= at) & (places + 8 <= at + 20)).all()
    seen = {}
    for k, h in zip(at, hashes):
        assert seen.setdefault(tuple(words[k:k + 20]), h) == h


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 20)]
    assert got(ss.op4_substring_dedup(spark, sf_dir)) == sorted(expected, key=lambda r: ((True, r[0]), r[1:]))
