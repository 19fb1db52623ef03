import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from featloom.llm import textwords as tw

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c\xa0x", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 9))
def test_words_and_windows_equal_brute_force(rows, size):
    data, offsets = tw.utf8(pa.array(rows, pa.string()))
    starts, ends, word_offsets = tw.word_spans(data, offsets)
    words = [[bytes(data[starts[i]:ends[i]]) for i in range(word_offsets[k], word_offsets[k + 1])] for k in range(len(rows))]
    assert words == [(t or "").encode().split() for t in rows]
    hashes = tw.word_hashes(data, starts, ends)
    flat = [w for row in words for w in row]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    at, of = tw.window_starts(word_offsets, size)
    assert [(r, k - word_offsets[r]) for k, r in zip(at, of)] == [(r, k) for r, row in enumerate(words) for k in range(len(row) - size + 1)]
    windows = [tuple(flat[k:k + size]) for k in at]
    found = tw.window_hashes(hashes, size)[at].tolist()
    assert len(set(zip(windows, found))) == len(set(windows)) == len(set(found))


def test_a_word_longer_than_a_piece():
    word = "x" * (tw.PIECE + 5)
    data, offsets = tw.utf8(pa.array([f"a {word} b", word]))
    starts, ends, _ = tw.word_spans(data, offsets)
    hashes = tw.word_hashes(data, starts, ends)
    assert len(hashes) == 4 and hashes[1] == hashes[3]


def test_pieces_cover_a_sliced_batch():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaaa", None, "", "bbbbbbbb", "c"])}).slice(1)
    parts = [p.column(0).to_pylist() for p in tw.pieces(batch, 0, 3)]
    assert sum(parts, []) == [None, "", "bbbbbbbb", "c"] and all(parts)
    assert np.concatenate([tw.utf8(p.column(0))[0] for p in tw.pieces(batch, 0, 3)]).tobytes() == b"bbbbbbbbc"
