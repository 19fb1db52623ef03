import hashlib
import math
import random

import numpy as np
import pytest

from featloom.llm import veccodes as vc


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes, errors, label errors and the codebooks' digest by plain integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = [assign(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, e in zip(cut, of) if e == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [[assign(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest)
                   for (i, _, label), f, e in zip(kept, found, errors)), key=str)


def coded(df, **options):
    out = vc.vector_codes(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(partitions)


def single(values):
    return [float(np.float32(x)) for x in values]


def test_hilbert_neighbours_touch():
    side = 16
    grid = np.array([(x, y) for x in range(side) for y in range(side)])
    # a corner of the next power of two, so that cells and levels agree
    points = np.concatenate([grid * 4096, [[side * 4096] * 2]])
    path = grid[np.argsort(vc.hilbert_keys(points)[:-1], kind="stable")]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).mean() > 0.95
    cube = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    assert len(set(vc.hilbert_keys(cube).tolist())) == 64 and not len(vc.hilbert_keys(np.zeros((0, 3))))


def test_shortlists_keep_every_nearest_entry_and_drop_most():
    rng = np.random.default_rng(5)
    book = rng.integers(-3000, 3000, (16, 8))
    parts = book[rng.integers(0, 16, 4000)] + rng.integers(-300, 300, (4000, 8))
    chunk = vc.Chunk.of(parts)
    low, high, sums = chunk.boxes()
    listed = vc.shortlists(low, high, book)
    apart = ((chunk.parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert listed[chunk.block_of, apart.argmin(axis=1)].all() and listed.mean() < 0.3
    entry, best = vc.nearest(chunk.parts, chunk.block_of, listed, book)
    assert (entry == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert (sums.sum(axis=0) == parts.sum(axis=0)).all()


def test_codes_equal_brute_force_with_nulls_ties_and_copies(spark):
    rng = random.Random(11)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(5)]
    rows = [(k, single(x + rng.gauss(0, 0.05) for x in rng.choice(centres)), rng.choice([0, 1, None])) for k in range(300)]
    rows += [(400 + k, rows[0][1], 1) for k in range(150)]  # a third are copies
    rows += [(7, rows[3][1], 0), (None, rows[5][1], 2), (-1, None, 1), (-2, [None] + rows[1][1][1:], 1), (-3, [math.nan] + rows[1][1][1:], 1),
             (-4, [math.inf] + rows[1][1][1:], None)]
    rng.shuffle(rows)
    assert coded(table(spark, rows)) == brute(rows) == coded(table(spark, rows, 1))


def test_few_and_no_vectors(spark):
    few = [(1, single([0.5] * 8), None), (2, single([-0.3] * 8), None)]
    assert coded(table(spark, few, 1)) == brute(few)
    assert coded(table(spark, few).limit(0)) == [] and coded(table(spark, [(1, None, 1)])) == []
    odd = [*few, (3, single([0.1] * 9), 1), (4, [], 1)]
    assert coded(table(spark, odd)) == brute(few)


def test_huge_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, single(rng.choice([1e30, 1e30 + 2e23, 5.0]) for _ in range(8)), 1) for k in range(40)]
    want = [(i, code, e if e < 2**63 else None) for i, code, e, _, _ in brute(rows)]
    out = coded(table(spark, rows))
    assert [r[:3] for r in out] == want and out[0][4] == brute(rows)[0][4]


def test_query_equals_brute_force_on_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = vc.op11_vector_codes(spark, sf_dir)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_more_entries_than_two_digits_tell_raise(spark):
    with pytest.raises(ValueError):
        vc.vector_codes(table(spark, []), entries=257)
