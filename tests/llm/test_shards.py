import zlib
from collections import Counter, defaultdict

import pytest

from featloom.llm import shards as sh


def check(rows, got, shards):
    count = Counter(r.shard for r in got)
    assert len(got) == len(rows) and all(0 <= s < shards for s in count)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(k % 5, None if k % 7 == 0 else "é" * (k % 3)) for k in range(53)] + [(None, "x" * 100_000)]])
def test_odd_rows(docs_of, rows):
    check(rows, sh.assign_shards(docs_of(rows), shards=4).collect(), 4)


def test_groups_stay_together_and_a_hot_one_is_split(docs_of):
    rows = [(k, f"single {k}") for k in range(600)] + [(1000 + k, f"pair {k // 2}") for k in range(400)] + [(2000 + k, "hot") for k in range(500)]
    got = sh.assign_shards(docs_of(rows), shards=8).collect()
    check(rows, got, 8)
    texts, groups = dict(rows), defaultdict(set)
    for r in got:
        groups[texts[r.doc_id]].add(r.shard)
    whole = sum(len(v) == 1 for t, v in groups.items() if t.startswith("pair"))
    assert whole >= 140  # of 200; about 25 at random
    assert len(groups["hot"]) > 1


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, sh.op7_shards(spark, sf_dir).collect(), 16)
