import numpy as np
import pyarrow as pa
import pytest

from featloom.llm import neardup as nd
from featloom.llm.components import components


def sets(text):
    w = (text or "").encode().split()
    return {b" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """Classes of (id, text) rows with different ids, over all pairs."""
    of, shingles = {i: i for i, _ in rows}, {i: sets(t) for i, t in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x
    index = {}
    for i, s in shingles.items():
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {(a, b) for v in index.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if len(shingles[a] & shingles[b]) >= threshold * len(shingles[a] | shingles[b]):
            x, y = find(a), find(b)
            of[max(x, y)] = min(x, y)
    return {i: find(i) for i in of}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"e{rng.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def base():
    return [f"w{k}" for k in np.random.default_rng(5).integers(0, 10**6, 200)]


def test_signature_estimates_the_probability_jaccard_similarity():
    rng = np.random.default_rng(2)
    common = rng.integers(1, 2**60, 300).astype(np.uint64)
    a = np.concatenate([common, rng.integers(1, 2**60, 50).astype(np.uint64)])
    b = np.concatenate([common, rng.integers(1, 2**60, 70).astype(np.uint64)])
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    expected = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    made = nd.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([wa, wb]), 2, 4096)
    assert abs((made[0] == made[1]).mean() - expected) < 0.03
    alone = nd.signatures(a, np.zeros(len(a), int), wa, 1, 4096)
    assert (alone[0] == made[0]).all()


def test_shingles_of_short_texts():
    hashes, rows = nd.shingles(pa.array(["a b c d e f", None, "a b", "", "a", "a b", "a b c d e"]))
    assert np.bincount(rows, minlength=7).tolist() == [2, 0, 1, 0, 1, 1, 1]
    at = {r: hashes[rows == r].tolist() for r in range(7)}
    assert at[2] == at[5] and at[0][0] == at[6][0] and at[4] != at[2]


def test_odd_rows(docs_of, base):
    rng = np.random.default_rng(7)
    text = " ".join(base)
    rows = [(9, text), (4, text), (4, text), (None, text), (1, None), (2, ""), (3, " \n"), (6, "a b"), (5, "a b"), (7, "a c"),
            (12, edited(rng, base, 2)), (13, " ".join(f"o{k}" for k in range(200))), (20, "x " * 3000), (21, "x " * 2999)]
    got = {(r.doc_id, r.class_id) for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == {(9, 4), (4, 4), (None, None), (1, 1), (2, 2), (3, 3), (6, 5), (5, 5), (7, 7), (12, 4), (13, 13), (20, 20), (21, 20)}
    kept = nd.deduplicated(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 4, 5, 7, 13, 20]
    assert kept.columns == docs_of(rows).columns


def test_clashing_columns(docs_of):
    docs = docs_of([(1, "a b c"), (2, "a b c"), (3, None)]).selectExpr("*", "1 AS gone", "2 AS class_id", "3 AS id", "4 AS __gone")
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_blocks_find_links_between_all_classes():
    """Whatever the classes to begin with, the links of a block and the classes join what all links of its first documents join."""
    rng = np.random.default_rng(21)
    for trial in range(30):
        base = rng.integers(1, 2**62, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(30, 40)], rng.integers(1, 2**62, rng.integers(0, 6)).astype(np.uint64)]))
                for _ in range(20)]
        classes = rng.integers(0, 12, 20)
        block = nd.Block.__new__(nd.Block)
        block.ids, block.classes, block.weights = np.arange(20), classes.copy(), None
        block.flat, block.ends = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        first = int(rng.integers(1, 21))

        def joined(links):
            of = classes.copy()
            for i, j in links:
                of[of == of[j]] = of[i]
            return len(set(of.tolist())), [bool(of[i] == of[j]) for i in range(20) for j in range(i)]
        every = [(i, j) for i in range(first) for j in range(20) if i != j
                 and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        linked = block.links(first, 0.8)
        found = [(i, j) for i, j, *_ in linked]
        assert joined(found) == joined(every) and len(found) < 12
        assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in every}
        of = classes.copy()
        for i, j in found:
            of[of == of[j]] = of[i]
        for i, j, _, name in linked:  # one name for all that is joined, the last one's where it is among them
            assert name in classes[of == of[i]] and (of[i] != of[-1] or name == classes[-1])


def test_empty_table(docs_of):
    assert nd.near_duplicates(docs_of([])).count() == 0 and nd.deduplicated(docs_of([])).count() == 0


def test_large_group_of_near_copies_equals_brute_force(docs_of, base):
    """Many copies of one text with few to many edits: links, chains and leftovers."""
    rng = np.random.default_rng(11)
    rows = [(k, edited(rng, base, int(rng.integers(0, 7)))) for k in range(300)]
    out = nd.near_duplicates(docs_of(rows)).collect()
    assert {r.doc_id: r.class_id for r in out} == brute(rows)
    texts = {}
    for i, c in brute(rows).items():
        texts.setdefault(c, set()).add(rows[i][1])
    for r in out:  # linked to a different text, if there is one in the class
        assert (r.n_links > 0) == (len(texts[r.class_id]) > 1)
    assert sum(r.n_links for r in out) < 8 * len(rows)


def test_many_blocks_of_a_bucket_equal_brute_force(docs_of, base, monkeypatch):
    """Small blocks, and a text with more shingles than one holds."""
    monkeypatch.setattr(nd, "OUTSIDE", 5)
    monkeypatch.setattr(nd, "MEMBERS", 7)
    monkeypatch.setattr(nd, "HASHES", 900)
    rng = np.random.default_rng(12)
    long = [f"v{k}" for k in rng.integers(0, 10**6, 2000)]
    rows = [(k, edited(rng, base, int(rng.integers(0, 8)))) for k in range(120)] + [(200 + k, edited(rng, long, 9 * k)) for k in range(8)]
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows)).collect()} == brute(rows)


def repeats(rng, n=40):
    """Pairs of texts that hold the same passages, one of them 1 to 20 times."""
    rows = []
    for k in range(n):
        words = [f"r{x}" for x in rng.integers(0, 10**9, 110)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:60] * (1, 5, 10, 20)[k % 4] + words[60:]))]
    return rows


def test_texts_that_differ_in_how_often_a_passage_repeats(docs_of):
    rows = repeats(np.random.default_rng(13))
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows) == {k: k - k % 2 for k in range(80)}


def test_weighted_option_verifies_the_weighted_similarity(docs_of):
    rng = np.random.default_rng(14)
    for _ in range(20):
        x, y = (dict(zip(rng.permutation(30)[:20].tolist(), rng.integers(1, 6, 20).tolist())) for _ in range(2))
        expected = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        (a, wa), (b, wb) = (map(np.array, zip(*sorted(d.items()))) for d in (x, y))
        assert abs(nd.probability_jaccard(a, wa, b, wb) - expected) < 1e-9
    rows = repeats(rng)
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs_of(rows), weighted=True).collect()}
    assert got == {k: k - k % 2 if k // 2 % 4 == 0 else k for k in range(80)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    got = {r["id"]: r["class"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(101)} | {400: 400, 500: 400}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in nd.op9_near_duplicates(spark, sf_dir).collect()} == brute(rows)
