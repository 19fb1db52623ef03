import glob
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featloom.llm import tokenpack as tp

public_tokenizers = pytest.importorskip("public_tokenizers")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=300))))
def test_packing_round_trip(case):
    bits, ids = case
    data = tp.pack(np.array(ids, np.uint32), bits)
    assert len(data) == -(-len(ids) // 64) * 8 * bits
    assert tp.unpack(data, len(ids), bits).tolist() == ids


def test_file_round_trip_and_random_access(monkeypatch):
    monkeypatch.setattr(tp, "BLOCK", 128)
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 2**13, n)) for k, n in enumerate([0, 1, 127, 128, 129, 1000, 0, 5])] + [(None, np.array([3]))]
    sink = io.BytesIO()
    close, sink.close = sink.close, lambda: None
    writer = tp.Writer(sink, 13)
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    reader = tp.Reader(pa.BufferReader(sink.getvalue()))
    for k in reversed(range(len(docs))):
        assert reader.document(k).tolist() == docs[k][1].tolist()
    assert reader.doc_ids.tolist() == [*range(8), 0] and reader.doc_is_null.tolist() == [False] * 8 + [True]
    with pytest.raises(ValueError):
        tp.Reader(pa.BufferReader(sink.getvalue()[:-3]))
    close()


ODD = ["", None, "Ça  va? it's I'LL ½x²y ºª µm naïve <|endoftext|>x é́ İstanbul ΣΑΣ ß ẞ 'sss a\u0085b x​y 日本語12", "word " * 3000]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer = tp.Encoder(path), Tokenizer.from_file(path)
    assert encoder.wordwise
    for text in ODD[2:] + ODD[2:]:
        assert encoder(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    other = tp.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.wordwise
    assert other("a b\n c").tolist() == other.tokenizer.encode("a b\n c", add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(3, "one two"), (None, None), (1, ODD[2]), (3, "one two"), (3, "other"), (2, ""), (9, ODD[3])]])
def test_written_and_read_back(spark, docs_of, tmp_path, rows):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = tp.write_tokens(docs_of(rows), path, f"file://{tmp_path}/out", end_id=2)
    got = tp.read_tokens(manifest, with_ids=True).orderBy("start").collect()
    encoded = sorted(((i is not None, i or 0), tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [k for k, _ in encoded]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in encoded]
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(ids) for _, ids in encoded)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += len(r.ids)
    assert len(glob.glob(f"{tmp_path}/out/*.bin")) == manifest.count()


def test_memory_is_bounded_and_keeps_frequent_keys():
    memory, asked = tp.Memory(20_000), []
    rng = np.random.default_rng(8)
    for _ in range(300):
        keys = {b"often%d" % k for k in range(10)} | {b"rare%d" % k for k in rng.integers(0, 10**6, 10)}
        new = memory.missing(keys)
        asked += [k for k in new if k.startswith(b"often")]
        memory.add({k: k[::-1] for k in new})
        assert all(memory.young[k] == k[::-1] for k in keys)
        held = [sum(tp.ENTRY + 2 * len(k) for k in part) for part in (memory.young, memory.old)]
        assert memory.held == held[0] and sum(held) < 20_000 + 2 * 20 * (tp.ENTRY + 40)
    assert sorted(asked) == sorted(b"often%d" % k for k in range(10))


def test_little_memory_changes_no_ids(monkeypatch, spark, sf_dir):
    monkeypatch.setattr(tp, "REMEMBERED", 10_000)
    encoder = tp.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = encoder.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
    for start in range(0, len(texts), 7):
        for ids, want in zip(encoder.together(texts[start:start + 7]), found[start:start + 7]):
            assert ids.tolist() == want.ids


def test_query_equals_the_library_on_the_whole_table(spark, sf_dir):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = tp.op2_token_ids(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in out.collect()) == want


def test_joined_pieces_are_those_encoded_alone():
    encoder = tp.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = ["the", "'s", "'", "zq", "été", "7", "²", "--", "<", "('", "antidisestablishmentarianism", "ß"]
    assert encoder._joined(pieces) == encoder._encoded(pieces)
    assert encoder._joined([*pieces, "two words"]) == encoder._encoded([*pieces, "two words"])  # not whole: encoded alone


def test_other_operators_let_go_of_kept_encoders():
    from featloom.llm.shared import forget_encoders
    path = public_tokenizers.path("word_bpe_49k.json")
    kept = tp.worker_encoder(path)
    assert tp.worker_encoder(path) is kept
    forget_encoders()
    assert tp.worker_encoder(path) is not kept
