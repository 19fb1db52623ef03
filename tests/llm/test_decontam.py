import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featloom.llm import decontam as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        size = min(window, len(p))
        for k in range(len(p) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j:j + size] == p[k:k + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(w), sorted(hit), sorted(found)


tokens = st.lists(st.sampled_from(["a", "B", "é", "c9", "..", "[x]"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(tokens, st.lists(tokens, min_size=1, max_size=4), st.integers(1, 6))
def test_search_finds_what_brute_force_finds(text, items, window):
    patterns = {}
    for k, t in enumerate(items):
        for p in dc.patterns_of(t, window):
            patterns.setdefault(p, []).append(str(k))
    hit, found = set(), set()
    for start, end, of in dc.Searcher(patterns).find(dc.words_of(text)):
        hit.update(range(start, end))
        found.update(of)
    n, expected, names = brute(text, list(enumerate(items)), window)
    assert (len(dc.words_of(text)), sorted(hit), sorted(found)) == (n, expected, names)


LONG = " ".join(f"w{k}" for k in range(5000))


@pytest.mark.parametrize("block_words", [1, 1_000_000])
def test_table_with_odd_rows(spark, docs_of, block_words):
    items = [(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20 w21 w22 w23"), (2, "Short, one!"), (2, "short one"), (None, "zz top"), (3, None), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, LONG), (2, "a SHORT one"), (2, "a SHORT one"), (3, None), (None, "zz top"), (5, ""), (6, "short"), (7, " ".join(f"w{k}" for k in range(5, 40)))]
    got = dc.find_contamination(docs_of(rows), bench, block_words=block_words)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "_n_words", "n_hit", "spans", "items", "contaminated"]
    out = sorted((r.doc_id is not None, r.doc_id or 0, r["_n_words"], r.n_hit, r.items, r.contaminated) for r in got.collect())
    expected = []
    for i, t in rows:
        n, hit, names = brute(t, items, 13)
        expected.append((i is not None, i or 0, n, len(hit), names, len(hit) > 0 and 20 * len(hit) >= n))
    assert out == sorted(expected)
    assert dc.decontaminated(docs_of(rows), bench, block_words=block_words).count() == sum(not e[-1] for e in expected)


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs_of([]), bench).count() == 0
    assert not dc.find_contamination(docs_of([(1, "a b")]), bench).first().contaminated


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    index = {}
    for item, t in items:
        for p in dc.patterns_of(t):
            index.setdefault(p, set()).add(str(item))
    sizes = {len(p) for p in index}
    got = {r.doc_id: r for r in dc.op10_decontaminate(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        w, hit, found = [x.encode() for x in words(r.text)], set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (of := index.get(tuple(w[j:j + size]))):
                    hit.update(range(j, j + size))
                    found |= of
        mine = got[r.doc_id]
        assert (mine.n_words, mine.n_hit, mine.n_items) == (len(w), len(hit), len(found))
        assert mine.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
