"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of the benchmark items; an item of fewer words is
one pattern. Patterns of one length share a search table: a shift for each block of two adjacent words
tells how far a window can move without missing a pattern; where the shift is zero, the suffix hash names
the patterns that end in this block, and a direct comparison of all words confirms them.

The search is a narrow stage: no document leaves its task. Benchmark items are streamed through the
driver into broadcast blocks of at most ``block_words`` pattern words each, and a task holds the tables
of one block at a time, so neither a large benchmark nor a large corpus has to fit in memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused

WINDOW = 13
# Words of all patterns in one broadcast block: tens of megabytes of search tables.
BLOCK_WORDS = 1_000_000

# Word characters are digits, lower-case letters and everything from 0x80; A-Z are lowered first.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Folded words of a text, as UTF-8; none for null."""
    return text.encode().translate(_FOLD).split() if text else []


def patterns_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The distinct windows of an item."""
    words = words_of(text)
    if len(words) <= window:
        return [tuple(words)] if words else []
    return list(dict.fromkeys(tuple(words[i:i + window]) for i in range(len(words) - window + 1)))


class Searcher:
    """Search tables of one block of patterns, a set of them for each pattern length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.tables = []
        for size in sorted({len(p) for p in patterns}):
            block = min(2, size)
            shifts: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list] = {}
            for pattern in (p for p in patterns if len(p) == size):
                for end in range(block, size + 1):
                    key = pattern[end - block:end]
                    shifts[key] = min(shifts.get(key, size), size - end)
                buckets.setdefault(pattern[size - block:], []).append((list(pattern), patterns[pattern]))
            self.tables.append((size, block, size - block + 1, shifts, buckets))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """Start, end and items of every occurrence."""
        n = len(words)
        for size, block, longest, shifts, buckets in self.tables:
            keys = list(zip(words, words[1:])) if block == 2 else [(w,) for w in words]
            at = size - block  # where the last block of the window begins
            while at <= n - block:
                step = shifts.get(keys[at], longest)
                if step:
                    at += step
                    continue
                start = at + block - size
                for pattern, items in buckets[keys[at]]:
                    if words[start:start + size] == pattern:
                        yield start, start + size, items
                at += 1


def _blocks(items: Iterable, window: int, block_words: int) -> Iterator[dict]:
    """Patterns with the items that hold them, in blocks of bounded size."""
    block, held = {}, 0
    for item, text in items:
        for pattern in patterns_of(text, window):
            block.setdefault(pattern, []).append("" if item is None else str(item))
            held += len(pattern)
            if held >= block_words:
                yield block
                block, held = {}, 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, min_share: float = 0.05,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with what the benchmark shares with them.

    Added columns (an underscore goes before names that ``docs`` has already): ``n_words``, ``n_hit`` (words
    inside any occurrence), ``spans`` (merged hit ranges of word positions, end exclusive), ``items`` (ids of
    the items found, as sorted strings), ``contaminated`` (some hit, and hits are ``min_share`` of the words or more).

    Null or empty texts have no words and are clean. Items without words match nothing; repeated items count
    once for each distinct id, and a null id is the empty string. Repeated rows of ``docs`` stay.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_id), F.col(item_text)).toLocalIterator(prefetchPartitions=True)
    blocks = [spark.sparkContext.broadcast(pickle.dumps(block)) for block in _blocks(map(tuple, rows), window, block_words)]
    per_mille = round(min_share * 1000)
    names = [unused(n, docs) for n in ("n_words", "n_hit", "spans", "items", "contaminated")]
    added = T.StructType([
        T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()),
        T.StructField(names[2], T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField(names[3], T.ArrayType(T.StringType())), T.StructField(names[4], T.BooleanType())])
    kinds = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()),
                       (names[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                       (names[3], pa.list_(pa.string())), (names[4], pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [None, None]  # the block whose tables are held, and the tables
        for batch in batches:
            texts = [words_of(t) for t in batch.column(text).to_pylist()]
            found = [([], set()) for _ in texts]
            for number, block in enumerate(blocks):
                if kept[0] != number:
                    kept[:] = number, Searcher(pickle.loads(block.value))
                for words, (ranges, items) in zip(texts, found):
                    for start, end, of in kept[1].find(words):
                        ranges.append((start, end))
                        items.update(of)
            out = [[], [], [], [], []]
            for words, (ranges, items) in zip(texts, found):
                merged = _merged(ranges)
                hit = sum(e - s for s, e in merged)
                for column, value in zip(out, (len(words), hit, [{"start": s, "end": e} for s, e in merged], sorted(items),
                                               hit > 0 and hit * 1000 >= per_mille * len(words))):
                    column.append(value)
            added_columns = [pa.array(c, f.type) for c, f in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added_columns], names=[*batch.schema.names, *kinds.names])

    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, *added.fields]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(r) for r in out]


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns only."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(~F.col(found.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of each document by the benchmark, over all rows of both tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
