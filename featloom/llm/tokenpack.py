"""Token ids in binary files of fixed-width bits, written and read by Spark tasks.

File format (little-endian throughout)::

    "FLTOKEN1"                                     8 bytes
    blocks, one after another                      each of BLOCK ids but the last of a file
    footer: offsets of the blocks and of the end   (n_blocks + 1) x u64
            ids before each document and in all    (n_docs + 1) x u64
            ids of the documents, nulls as 0       n_docs x i64
            1 for a document whose id is null      n_docs x u8
    bits, ids a block, n_blocks, n_docs, n_ids     5 x u64
    "FLTOKEN1"                                     8 bytes

An id takes as many bits as the largest id of the vocabulary needs. A block stores ids in groups of 64:
id ``j`` of a group fills bits ``j * bits`` and up of the group's ``bits`` 64-bit words. So 64 vector
operations pack or unpack a block, and any block can be read by itself.

Files are written by one task each to a name of its own attempt and published by the manifest only, so a
repeated task leaves at most an unnamed file behind. Paths go through pyarrow's file systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, new_folder
from .textwords import pieces as cut

MAGIC = b"FLTOKEN1"
# Ids in a block; a multiple of 64.
BLOCK = 1 << 16
# Bytes that a worker's remembered words take, and as many again its remembered pieces; what each entry takes besides its characters
# and ids; and bytes of text that are encoded together.
REMEMBERED, ENTRY, TOGETHER = 192 << 20, 130, 2 << 20
# Pieces that are encoded as one text.
JOINED = 20_000


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; the last group is filled up with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[:len(ids)] = ids
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed data, as unsigned 32-bit integers."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes, mask = np.empty((len(words), 64), np.uint32), np.uint64(2**bits - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, j] = lane & mask
    return lanes.reshape(-1)[:n]


class Writer:
    """Streams documents into one file; holds one block and the offsets."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at = sink, bits, len(MAGIC)
        self.block_offsets, self.doc_offsets, self.doc_ids, self.waiting, self.held = [], [0], [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.doc_offsets.append(self.doc_offsets[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i:i + BLOCK])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.block_offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        tail = [self.bits, BLOCK, len(self.block_offsets), len(self.doc_ids), self.doc_offsets[-1]]
        for numbers, kind in (([*self.block_offsets, self.at], "<u8"), (self.doc_offsets, "<u8"),
                              ([i or 0 for i in self.doc_ids], "<i8"), ([i is None for i in self.doc_ids], "u1"), (tail, "<u8")):
            self.sink.write(np.asarray(numbers, kind).tobytes())
        self.sink.write(MAGIC)
        self.sink.close()


class Reader:
    """Random access to the documents of a file: only blocks that are asked for are read."""

    def __init__(self, source):
        self.source, size = source, source.size()
        head = source.read_at(48, size - 48) if size >= 48 else b""
        if head[40:] != MAGIC:
            raise ValueError("not a token file, or it is cut short")
        self.bits, self.block, n_blocks, self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(head[:40], "<u8"))
        n, m = n_blocks + 1, self.n_docs + 1
        size_of = 8 * (n + m + self.n_docs) + self.n_docs
        footer = source.read_at(size_of, size - 48 - size_of)
        self.block_offsets = np.frombuffer(footer, "<i8", n)
        self.doc_offsets = np.frombuffer(footer, "<i8", m, 8 * n)
        self.doc_ids = np.frombuffer(footer, "<i8", self.n_docs, 8 * (n + m))
        self.doc_is_null = np.frombuffer(footer, "u1", self.n_docs, 8 * (n + m + self.n_docs)).astype(bool)
        self._number, self._ids = -1, None

    def _read(self, number: int) -> np.ndarray:
        if number != self._number:
            start, end = int(self.block_offsets[number]), int(self.block_offsets[number + 1])
            n = min(self.block, self.n_ids - number * self.block)
            self._number, self._ids = number, unpack(self.source.read_at(end - start, start), n, self.bits)
        return self._ids

    def pieces(self, doc: int) -> Iterator[np.ndarray]:
        """Ids of a document, block by block."""
        start, end = self.doc_offsets[doc], self.doc_offsets[doc + 1]
        while start < end:
            number = start // self.block
            upto = min(end, (number + 1) * self.block)
            yield self._read(number)[start - number * self.block:upto - number * self.block]
            start = upto

    def document(self, doc: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *self.pieces(doc)])


def _opened(path: str):
    return pafs.FileSystem.from_uri(path)


# How the normalizer and the pre-tokenizer of a file must look for its words to be encoded independently.
WORDWISE_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
# The pieces that such a pre-tokenizer makes of words, in its own notation, and in Python's of lower-case printable Latin-1.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class Memory:
    """Values by key in a bounded number of bytes: two generations, of which the older one goes when the younger is full.

    What is found in the older one moves to the younger, so frequent keys stay.
    """

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.held = limit // 2, {}, {}, 0

    def missing(self, keys: set[bytes]) -> set[bytes]:
        """The keys that have no value; all others are in the younger generation from now on."""
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        new = keys.difference(self.young)
        again = new.intersection(self.old)
        self.add({k: self.old[k] for k in again})
        return new - again

    def add(self, values: dict[bytes, bytes]) -> None:
        self.young.update(values)
        self.held += ENTRY * len(values) + sum(map(len, values)) + sum(map(len, values.values()))


class Encoder:
    """Ids of whole texts.

    Where the tokenizer file turns white space into borders that it drops, and lower-cases, the words between
    ASCII blanks are encoded independently of each other; then each distinct word, and each distinct piece of
    the Latin words, is encoded once and remembered. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), Memory(REMEMBERED), Memory(REMEMBERED)
        self.bits = bits_for(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.kind = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        with open(path, encoding="utf-8") as file:
            self.wordwise = self._is_wordwise(json.load(file))
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(marks) or "(?!)").search

    @staticmethod
    def _is_wordwise(parts: dict) -> bool:
        normalizer, splitter = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        steps = normalizer.get("normalizers", [normalizer])
        cuts = splitter.get("pretokenizers", [splitter])
        return ({x.get("type") for x in steps} == WORDWISE_NORMALIZERS and len(cuts) == 2
                and all(x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in steps if x["type"] == "Replace")
                and cuts[0].get("type") == "Split" and cuts[0].get("pattern") == {"Regex": PIECE_PATTERN}
                and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
                and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
                and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or " " in t["content"]
                            for t in parts["added_tokens"]))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the pre-tokenizer leaves whole: texts of many with a space between, cut by the piece of each id."""
        out = []
        for first in range(0, len(pieces), JOINED):
            part = pieces[first:first + JOINED]
            made = self.tokenizer.encode_batch([" ".join(part)], add_special_tokens=False)[0]
            of = made.word_ids
            if None in of or set(of) != set(range(len(part))):
                out += self._encoded(part)
                continue
            data = np.array(made.ids, self.kind).tobytes()
            ends = (np.searchsorted(of, np.arange(len(part) + 1)) * self.kind.itemsize).tolist()
            out += [data[i:j] for i, j in zip(ends, ends[1:])]
        return out

    def _learn(self, new: set[bytes]) -> None:
        plain = [word for word in new if word.isalpha()]  # ASCII letters alone are one piece
        lower = b" ".join(plain).lower().decode().split(" ") if plain else []
        cut, whole = {}, {}
        for word in new.difference(plain):
            w = word.decode()
            # Latin-1 is in normal form already and lower-cased letter by letter.
            if (w.isascii() or max(w) <= "\xff") and w.isprintable() and not self.marked(w):
                cut[word] = LATIN_PIECES.findall(w.lower())
            else:
                whole[word] = w
        pieces = set(lower).union(*cut.values())
        unknown = self.pieces.missing(pieces.union(whole.values()))
        single = list(unknown.intersection(pieces))
        self.pieces.add(dict(zip(single, self._joined(single))))
        single = list(unknown.difference(pieces))
        self.pieces.add(dict(zip(single, self._encoded(single))))
        known = self.pieces.young.__getitem__
        self.words.add(dict(zip(plain, map(known, lower))))
        self.words.add({word: known(p[0]) if len(p) == 1 else b"".join(map(known, p)) for word, p in cut.items()})
        self.words.add({word: known(w) for word, w in whole.items()})

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text."""
        if not self.wordwise:
            return [np.frombuffer(x, self.kind) for x in self._encoded([t.decode() for t in texts])]
        words = [t.split() for t in texts]
        new = self.words.missing(set().union(*words))
        if new:
            self._learn(new)
        known = self.words.young.__getitem__
        return [np.frombuffer(b"".join(map(known, w)), self.kind) for w in words]

    def __call__(self, text: str) -> np.ndarray:
        return self.together([text.encode()])[0]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task; it stays on the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept.clear()
        kept[path] = Encoder(path)
    return kept[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode all texts and write them in ascending order of ``doc_id``; returns the manifest.

    ``tokenizer`` is the path of a tokenizer file that every executor has. The manifest has a row for each
    file: ``shard`` (in order of doc_id), ``path``, ``n_docs``, ``n_ids`` and ``start`` (ids in earlier
    shards); it is a checkpoint. Documents that share an id stand in the order of their texts' hashes, null
    ids come first, a null or empty text has the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    target = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer = None, None
        for batch in (part for whole in batches for part in cut(whole, 1, TOGETHER)):
            if writer is None:
                files, place = _opened(target)
                path = f"{place}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                files.create_dir(place)
                encode = worker_encoder(tokenizer)
                writer = Writer(files.open_output_stream(path), encode.bits)
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for i, ids in zip(batch.column(0).to_pylist(), encode.together(texts)):
                writer.add(i, np.append(ids, encode.kind.type(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path.rpartition("/")[2]],
                "n_docs": pa.array([len(writer.doc_offsets) - 1], pa.int64()), "n_ids": pa.array([writer.doc_offsets[-1]], pa.int64())})

    written = checkpointed(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"))
    starts, total = [], 0
    for shard, n in written.select("shard", "n_ids").orderBy("shard").collect():  # a row for each file
        starts.append((shard, total))
        total += n
    return (written.join(F.broadcast(spark.createDataFrame(starts, "shard long, start long")), "shard")
            .select("shard", F.concat(F.lit(f"{target}/"), "path").alias("path"), "n_docs", "n_ids", "start"))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents as the files of a manifest hold them, one task reading a file block by block.

    Columns: ``doc_id``, ``shard``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` (of the
    ids as little-endian unsigned 32-bit integers) and, if asked for, the ``ids`` themselves.
    """
    fields = "doc_id long, shard long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "start"))):
                files, place = _opened(path)
                with files.open_input_file(place) as source:
                    reader = Reader(source)
                    for first in range(0, reader.n_docs, 1000):
                        docs = range(first, min(first + 1000, reader.n_docs))
                        crcs = []
                        for doc in docs:
                            crc = 0
                            for piece in reader.pieces(doc):
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        part = slice(docs.start, docs.stop)
                        columns = [pa.array(reader.doc_ids[part], pa.int64(), mask=reader.doc_is_null[part]),
                                   pa.array([shard] * len(docs), pa.int64()), pa.array(reader.doc_offsets[:-1][part] + start),
                                   pa.array(np.diff(reader.doc_offsets)[part]), pa.array(crcs, pa.int64())]
                        if with_ids:
                            columns.append(pa.array([reader.document(d).astype(np.int64) for d in docs], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("shard", "path", "start").repartition(n).mapInArrow(read, fields)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in order of doc_id and read back from the files."""
    return token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), new_folder(docs.sparkSession, "tokens"), end_id=2)
    return read_tokens(manifest)
