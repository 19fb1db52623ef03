"""Token alignment between two tokenizers, and how often their ids are linked over a whole corpus.

Both tokenizers encode the same bytes. The byte offsets at which tokens end are two ascending lists a batch of texts long; the
shorter one drives a galloping search through the longer one: for a run of its offsets, steps of doubling width find the
stretch of the longer list that can hold them, and a binary search within the stretch finds each. Offsets in both lists
cut the tokens into groups, slices between two common indices; the differences of ranks tell which tokens of the other
list a token overlaps. Two tokens that end together are a link.

Counts of linked id pairs are summed over all texts in Spark. A chunk of texts hands on each distinct pair once, with its count; the
pairs get their corpus-wide counts in one join and come back to their chunk, which has at most as many as its texts
have tokens. So nothing of the size of the corpus, or of the vocabularies' product, is broadcast or held in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed
from .textwords import pieces

# Offsets of the shorter list that are searched together.
RUN = 256
# Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 2 << 20
# Bits of an id in a pair.
ID_BITS = 32
# Bytes that a worker's remembered units take, and what each takes besides its characters and ids.
REMEMBERED, ENTRY = 96 << 20, 100
# Units that are encoded together.
LEARN = 512


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in two ascending lists of the values that both hold; values of one list differ.

    From where the last run ended, the bound doubles its distance until it has passed the run's last value;
    the values of the run are then found by bisection before the bound.
    """
    mine, theirs, at = [], [], 0
    for start in range(0, len(short), RUN):
        run, width = short[start:start + RUN], RUN
        while at + width < len(long) and long[at + width] < run[-1]:
            width *= 2
        stretch = long[at:at + width + 1]
        place = np.searchsorted(stretch, run)
        inside = np.minimum(place, len(stretch) - 1)
        found = stretch[inside] == run if len(stretch) else np.zeros(len(run), bool)
        mine.append(np.flatnonzero(found) + start)
        theirs.append(place[found] + at)
        at += int(place[-1])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (mine, theirs))


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``a`` and of ``b`` at which the same offset stands."""
    if len(a) <= len(b):
        return gallop(a, b)
    at_b, at_a = gallop(b, a)
    return at_a, at_b


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of ``a`` the first and last token of ``b`` that shares a byte with it; both lists cover the same bytes.

    The rank of a token's start among the ends of ``b`` is the first; the rank of its last byte is the last.
    """
    starts = np.concatenate([a[:1] * 0, a[:-1]])
    return np.searchsorted(b, starts, "right"), np.searchsorted(b, a, "left")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Tokens:
    """Ids of some texts one after another, where each text's begin, and the bytes of every id."""

    ids: np.ndarray
    offsets: np.ndarray
    table: list[bytes]
    lengths: np.ndarray

    def text(self, row: int) -> bytes:
        return b"".join([self.table[i] for i in self.ids[self.offsets[row]:self.offsets[row + 1]].tolist()])


class ByteLevel:
    """A byte-level tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = _byte_alphabet(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts["pre_tokenizer"] or {}
        # White space begins a piece unless it is one space before something else, which then is in that piece.
        self.unitwise = (parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                         and not cut.get("add_prefix_space") and all(t["special"] for t in parts["added_tokens"]))

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text behind a space."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # No piece goes on behind a space.
        self.unitwise = not any("▁" in p.lstrip("▁") for p in names)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Encoders:
    """Two tokenizers that encode the same texts, each behind a space.

    Where both treat a space between two visible characters as the begin of what follows it, texts are cut there into
    units, and each distinct unit is encoded once and remembered, in ``REMEMBERED`` bytes. Other tokenizers encode whole texts.
    """

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.unitwise = all(side.unitwise for side in self.sides)
        self.lengths = [np.array([len(t) for t in side.table]) for side in self.sides]
        self._forget()

    def _forget(self) -> None:
        # numbers of units, and words that do not begin and end visibly
        self.number, self.odd, self.held = {}, set(), 0
        # ids of the units one after another, where each unit's begin, and whether both sides give it back
        self.ids, self.begins, self.faithful = [array("i"), array("i")], [array("q", [0]), array("q", [0])], bytearray()

    def _learn(self, units: list[bytes]) -> None:
        for start in range(0, len(units), LEARN):
            some = units[start:start + LEARN]
            texts, whole = [u.decode() for u in some], b" " + b" ".join(some)
            ends = np.cumsum([len(u) + 1 for u in some])
            faithful = np.ones(len(some), bool)
            for side, n, ids, begins in zip(self.sides, self.lengths, self.ids, self.begins):
                # Units stand side by side as in a text; unless their tokens give them back, each is encoded alone.
                found = np.array(side.ids([whole[1:].decode()])[0], np.int32)
                upto = np.cumsum(n[found])
                last = np.searchsorted(upto, ends)
                if b"".join([side.table[i] for i in found.tolist()]) == whole and (upto[last] == ends).all():
                    begins.extend((last + 1 + len(ids)).tolist())
                    ids.extend(found.tolist())
                    continue
                for k, alone in enumerate(side.ids(texts)):
                    ids.extend(alone)
                    begins.append(len(ids))
                    faithful[k] &= b"".join([side.table[i] for i in alone]) == b" " + some[k]
            self.faithful.extend(faithful.tobytes())
            first = len(self.number)
            self.number.update(zip(some, range(first, first + len(some))))
            self.held += len(whole) * 4 + ENTRY * len(some)

    def _units(self, text: bytes) -> list[bytes]:
        """Units of a text: its words, with those joined again between which there is not one space and two visible characters."""
        out, clean = [], False
        for word in text.split(b" "):
            chars = word.decode()
            if clean and chars and _visible(chars[0]):
                out.append([word])
            elif out:
                out[-1].append(word)
            else:
                out.append([word])
            clean = bool(chars) and _visible(chars[-1])
        return [b" ".join(words) for words in out]

    def __call__(self, texts: list[bytes]) -> tuple[Tokens, Tokens, np.ndarray]:
        """Tokens of both sides, and whether they give a text back; an empty text has none and is not given back."""
        some = np.array([bool(t) for t in texts], bool)
        if not self.unitwise:
            made = [_joined(side.ids([t.decode() for t in texts]), side.table, n, texts) for side, n in zip(self.sides, self.lengths)]
            doubtful = np.flatnonzero(some)
        else:
            if self.held > REMEMBERED:
                self._forget()
            words = [t.split(b" ") if t else [] for t in texts]
            odd = {w for w in set().union(*words).difference(self.number, self.odd) if not _clean(w)}
            self.odd |= odd
            self.held += sum(map(len, odd)) + ENTRY * len(odd)
            units = [w if self.odd.isdisjoint(w) else self._units(t) for t, w in zip(texts, words)]
            self._learn(list(set().union(*units).difference(self.number)))
            rows = np.concatenate([[0], np.cumsum([len(us) for us in units], dtype=np.int64)])
            numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64, rows[-1])
            made = [_gathered(np.frombuffer(ids, np.int32), np.frombuffer(begins, np.int64), numbers, rows, side.table, n)
                    for ids, begins, side, n in zip(self.ids, self.begins, self.sides, self.lengths)]
            lost = np.concatenate([[0], np.cumsum(np.frombuffer(self.faithful, np.uint8)[numbers] == 0)])
            doubtful = np.flatnonzero(some & (lost[rows[1:]] > lost[rows[:-1]]))
        for i in doubtful:
            some[i] = made[0].text(i) == made[1].text(i) == b" " + texts[i]
        return *made, some


def _visible(c: str) -> bool:
    """Whether no tokenizer takes a character for white space."""
    return "!" <= c <= "~" or c.isalnum()


_PLAIN = re.compile(rb"[!-~](?:.*[!-~])?", re.DOTALL)


def _clean(word: bytes) -> bool:
    if _PLAIN.fullmatch(word):
        return True
    chars = word.decode()
    return bool(chars) and _visible(chars[0]) and _visible(chars[-1])


def _gathered(ids: np.ndarray, begins: np.ndarray, numbers: np.ndarray, rows: np.ndarray, table: list[bytes], lengths: np.ndarray) -> Tokens:
    """Tokens of texts from those of their units; ``rows`` tells where each text's units begin."""
    counts = begins[numbers + 1] - begins[numbers]
    upto = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(upto[-1]) + np.repeat(begins[numbers] - upto[:-1], counts)
    return Tokens(ids[at], upto[rows], table, lengths)


def _joined(ids: list[list[int]], table: list[bytes], lengths: np.ndarray, texts: list[bytes]) -> Tokens:
    ids = [x if t else [] for x, t in zip(ids, texts)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    return Tokens(np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]), offsets, table, lengths)


def worker_encoders(a: str, b: str) -> Encoders:
    """The two tokenizers of this Python worker, kept from task to task; they stay on the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_aligned_by_path", {})
    if (a, b) not in kept:
        kept.clear()
        kept[a, b] = Encoders(a, b)
    return kept[a, b]


def written(numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decimal numbers, each followed by its mark, and where each begins (and the end)."""
    most = len(str(int(numbers.max(initial=0))))
    digits = np.ones(len(numbers), np.int64)
    for k in range(1, most):
        digits += numbers >= 10**k
    begins = np.concatenate([[0], np.cumsum(digits + 1)])
    out = np.empty(begins[-1], np.uint8)
    places, rest = begins[1:] - 2, numbers.astype(np.uint32)
    for k in range(most):
        if k:
            wide = rest >= 10
            places, rest = places[wide] - 1, rest[wide] // 10
        out[places] = rest % 10 + 48
    out[begins[1:] - 1] = marks
    return out, begins


@dataclass
class Aligned:
    """Alignment of some texts: common indices of both lists (row by row), and the token lists without refused texts."""

    a: Tokens
    b: Tokens
    at_a: np.ndarray
    at_b: np.ndarray
    rows: np.ndarray  # the row of each common offset

    def group_digests(self) -> list[str]:
        """Of each row the SHA-256 of its groups' ids; empty without tokens."""
        # Tokens in the order in which they are written: by group, A before B.
        counts = [np.diff(at, prepend=-1) for at in (self.at_a, self.at_b)]
        n = len(self.at_a)
        if not n:
            return [""] * (len(self.a.offsets) - 1)
        sides, sizes = np.tile([0, 1], n), np.stack(counts, axis=1).reshape(-1)
        ends = np.cumsum(sizes)
        side_of, order = np.repeat(sides, sizes), np.empty(ends[-1], np.int32)
        order[side_of == 0], order[side_of == 1] = self.a.ids, self.b.ids
        marks = np.full(len(order), ord(","), np.uint8)
        marks[ends[0::2] - 1], marks[ends[1::2] - 1] = ord("|"), ord(";")
        data, begins = written(order, marks)
        tokens = self.a.offsets + self.b.offsets  # written before each row
        out = []
        for s, e in zip(tokens[:-1].tolist(), tokens[1:].tolist()):
            out.append(hashlib.sha256(data[begins[s]:begins[e] - 1]).hexdigest() if e > s else "")
        return out


def _without(tokens: Tokens, fits: np.ndarray) -> Tokens:
    counts = np.diff(tokens.offsets)
    keep = np.repeat(fits, counts)
    return Tokens(tokens.ids[keep], np.concatenate([[0], np.cumsum(counts * fits)]), tokens.table, tokens.lengths)


def align(texts: list[bytes], encoders: Encoders) -> Aligned:
    """Common token ends of both tokenizers in each UTF-8 text behind one space; empty and refused texts have no tokens.

    A text is refused where the joined bytes of either list are not those of the space and the text.
    """
    a, b, fits = encoders(texts)
    a, b = _without(a, fits), _without(b, fits)
    # Texts stand one after another, so offsets go on from text to text, and both lists end a text together.
    ends_a, ends_b = np.cumsum(a.lengths[a.ids]), np.cumsum(b.lengths[b.ids])
    at_a, at_b = common_ends(ends_a, ends_b)
    return Aligned(a, b, at_a, at_b, np.searchsorted(a.offsets, at_a, "right") - 1)


def _packed(numbers: np.ndarray, below: int) -> bytes:
    """Numbers in two bytes each where all are below 2^16, else in four; the first byte tells."""
    width = 2 if below <= 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each chunk of texts: what is known of them without the corpus, and the chunk's id pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = worker_encoders(a, b)
        for batch in (part for whole in batches for part in pieces(whole, 1, CHUNK)):
            made = align([t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()], encoders)
            n = batch.num_rows
            links = np.bincount(made.rows, minlength=n)
            linked = made.a.ids[made.at_a].astype(np.int64) << ID_BITS | made.b.ids[made.at_b]
            pairs, of, counts = np.unique(linked, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.array([batch.column(0)], pa.list_(pa.int64())),
                *(pa.array([x], pa.list_(pa.int64())) for x in (np.diff(made.a.offsets), np.diff(made.b.offsets), links)),
                pa.array([made.group_digests()], pa.list_(pa.string())), pa.array([pairs], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([_packed(of, len(pairs))], pa.binary())],
                names=["chunk", "ids", "n_a", "n_b", "n_links", "digests", "pairs", "counts", "of"])

    return docs.mapInArrow(run, "chunk string, ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>, "
                                "pairs array<long>, counts array<long>, of binary")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair`` (both ids), ``n`` (links that hold it, corpus-wide) and ``best``: no pair with the same B id has more."""
    counted = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    counted = checkpointed(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))))
    most = checkpointed(counted.groupBy("b").agg(F.max("n").alias("most")))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Alignment figures of every row of ``docs`` between tokenizer file ``a`` (byte-level) and model ``b`` (pieces).

    Columns: ``doc_id``, ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose id pair is linked at least as often, in all
    texts, as any other with the same B id), ``count_sum`` (how often the pairs of its links are linked in all texts, summed over
    links) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``). A null or empty text, and one that a tokenizer does not give back, has no
    tokens: zeros and an empty digest. Rows that repeat an id are rows of their own. ``a`` and ``b`` are paths that every executor has.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = checkpointed(_chunks(rows, a, b))
    asked = chunks.select("chunk", F.explode("pairs").alias("pair"))
    counted = checkpointed(pair_counts(chunks))
    answers = (asked.join(counted, "pair").groupBy("chunk")
               .agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("answers")))
    answers = checkpointed(answers.select("chunk", F.col("answers.n").alias("ns"), F.col("answers.best").alias("bests")))
    joined = chunks.select("chunk", "ids", "n_a", "n_b", "n_links", "digests", "of").join(answers, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_a, n_b, links, digests = (batch.column(k)[i].values for k in range(5))
                ends = np.concatenate([[0], np.cumsum(links.to_numpy())])
                of = _unpacked(batch.column(5)[i].as_py())
                sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
                if len(of):
                    n, best = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (6, 7))
                    for k, values in enumerate((best.astype(np.int64), n)):
                        upto = np.concatenate([[0], np.cumsum(values[of])])
                        sums[k] = upto[ends[1:]] - upto[ends[:-1]]
                yield pa.RecordBatch.from_arrays([ids, n_a, n_b, links, links, *map(pa.array, sums), digests], names=names)

    names = [doc_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = joined.select("ids", "n_a", "n_b", "n_links", "digests", "of", "ns", "bests").mapInArrow(
        run, ", ".join(f"c{k} long" for k in range(7)) + ", c7 string")
    return out.toDF(*names)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece tokenizer over all documents."""
    import public_tokenizers

    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                   public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
