"""Repeated passages, removed exactly behind a count-min prefilter.

A window is a run of 20 words of one document. A word goes if a window over it has a word sequence that also
starts earlier: in a document of a smaller id, or before it in the same document.

1. Every task counts windows in a count-min sketch of its own partition, kept as the cells it touched. Spark
   merges the sketches cell range by cell range. Windows are counted by their least-hashed inner run of 8
   words, one row for seven windows or so. Equal windows hold equal inner runs, so the sketch can only overestimate.
2. Windows that the sketch calls repeated are grouped exactly, by 96 bits of hash. A task hands on only its
   earliest occurrence of each; others it has seen to be repeated itself, so no window sends more rows than there
   are tasks, however often it occurs.
3. Places that lost to an earlier one meet their documents again by a join on the document.

The sketch grows with the corpus up to ``max_cells``; beyond that more windows take part in step 2, and none is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textwords import mix, pieces, utf8, window_hashes, window_starts, word_hashes, word_spans

WINDOW = 20
# Words of the inner runs by which windows are counted.
INNER = 8
# Rows of the sketch, each with hash functions and cells of its own.
DEPTH = 2
# Cells of a row: at least 2^MIN, at most 2^MAX bits, which a worker holds and the driver passes on (32 MB a row).
MIN_CELLS, MAX_CELLS = 16, 28
# Cells in one range that a task merges, and in one row of the merged sketch.
RANGE = 20


def _windows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and word offsets of the rows, then start and row of each window."""
    data, offsets = utf8(column)
    starts, ends, word_offsets = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    at, rows = window_starts(word_offsets, size)
    return words, word_offsets, at, rows


def _anchors(words: np.ndarray, at: np.ndarray, size: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the least inner run of each window; the first of equal ones."""
    runs = window_hashes(words, inner, salt=11)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best = np.arange(len(runs))
    width, span = 1, size - inner + 1
    while width < span:  # the least of ``width`` runs, by doubling with overlap
        step = min(width, span - width)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(runs[left] <= runs[right], left, right)
        width += step
    place = best[at]
    return runs[place], place


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes, 20 + row) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(docs: DataFrame, bits: int, size: int, inner: int) -> list[np.ndarray]:
    """Bit tables, one a row of the sketch: set where a cell counted two places or more."""
    span = min(bits, RANGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 0):
                words, _, at, _ = _windows(batch.column(0), size)
                hashes, places = _anchors(words, at, size, inner)
                hashes = hashes[np.unique(places, return_index=True)[1]]  # a run counts once for all windows that share it
                for row in range(DEPTH):
                    cells, n = np.unique(_cells(hashes, row, bits), return_counts=True)
                    cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << span))
                    for k in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[k], cuts[k + 1])
                        once = (cells[part] - (int(k) << span)).astype("<u4")
                        yield pa.RecordBatch.from_pydict({
                            "range": pa.array([row << (bits - span) | int(k)], pa.int64()),
                            "cells": [once.tobytes()], "again": [once[n[part] > 1].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, two = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int64()), "bits": [zlib.compress(np.packbits(two).tobytes(), 1)]})

        for batch in batches:
            for key, cells, again in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != at:
                    if at is not None:
                        yield done()
                    at, one, two = key, np.zeros(1 << span, bool), np.zeros(1 << span, bool)
                cells = np.frombuffer(cells, "<u4")
                two[cells[one[cells]]] = True
                one[cells] = True
                two[np.frombuffer(again, "<u4")] = True
        if at is not None:
            yield done()

    found = docs.select("text").mapInArrow(count, "range long, cells binary, again binary")
    merged = found.repartition(F.col("range")).sortWithinPartitions("range").mapInArrow(merge, "range long, bits binary")
    tables = [np.zeros(1 << bits >> 3, np.uint8) for _ in range(DEPTH)]
    for part in merged.toLocalIterator():  # DEPTH * 2^bits bits in all, at most
        row, k = divmod(part["range"], 1 << (bits - span))
        bytes_of = (1 << span) >> 3
        tables[row][k * bytes_of:(k + 1) * bytes_of] = np.frombuffer(zlib.decompress(part["bits"]), np.uint8)
    return tables


def _runs(starts: np.ndarray, size: int) -> list[int]:
    """Sorted window starts as ranges of words: start, end, start, end, ..."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > size)
    first, last = np.append(0, breaks + 1), np.append(breaks, len(starts) - 1)
    return np.column_stack([starts[first], starts[last] + size]).ravel().tolist()


def repeated_places(docs: DataFrame, size: int = WINDOW, inner: int = INNER, max_cells: int = MAX_CELLS) -> DataFrame:
    """``id``, ``digest`` and ``ranges`` (flat starts and ends of word positions) that repeat earlier windows.

    ``docs`` has ``id``, ``digest`` (of the text) and ``text``. There may be several rows for a document.
    """
    spark = docs.sparkSession
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(max_cells, max(MIN_CELLS, (words // 6).bit_length() + 1)))
    sketch = spark.sparkContext.broadcast(_sketch(docs, bits, size, inner))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2, 8 << 20):
                words, word_offsets, at, rows = _windows(batch.column(2), size)
                anchors, _ = _anchors(words, at, size, inner)
                seen = np.ones(len(at), bool)
                for row, table in enumerate(sketch.value):
                    cells = _cells(anchors, row, bits)
                    seen &= (table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                at, rows = at[seen], rows[seen]
                first, second = window_hashes(words, size, salt=1)[at], window_hashes(words, size, salt=2)[at] >> np.uint64(32)
                ids = batch.column(0)
                null = np.asarray(ids.is_null())
                number = np.asarray(ids.fill_null(0)).astype(np.int64)
                start = at - word_offsets[rows]
                # earliest first within each window: a null id before all others
                order = np.lexsort((start, number[rows], ~null[rows], second, first))
                first, second, rows, start = first[order], second[order], rows[order], start[order]
                head = np.ones(len(order), bool)
                head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                # A place at which an equal row of the same document stands, too, is no earlier one.
                group = np.cumsum(head) - 1
                lead = np.flatnonzero(head)[group] if len(head) else group
                tie = (number[rows] == number[rows[lead]]) & (null[rows] == null[rows[lead]]) & (start == start[lead])
                one = head | tie
                tail = (second[one].astype(np.int64) << 32) | start[one]  # 32 bits of hash, then the start
                of = pa.array(rows[one])
                yield pa.RecordBatch.from_arrays([pa.array(first[one].view(np.int64)), pa.array(tail), ids.take(of), batch.column(1).take(of),
                                                  pa.nulls(len(of), pa.list_(pa.int64()))], names=names)
                gone, of = start[~one], rows[~one]
                order = np.lexsort((gone, of))
                gone, of = gone[order], of[order]
                here = np.unique(of)
                lists = pa.array([_runs(gone[a:b], size) for a, b in zip(np.searchsorted(of, here), np.searchsorted(of, here, "right"))],
                                 pa.list_(pa.int64()))
                # Ranges of its own travel under a hash of the document, past the grouping.
                key = pa.array(mix(number[here].astype(np.uint64), 30).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, pa.nulls(len(here), pa.int64()), ids.take(pa.array(here)),
                                                  batch.column(1).take(pa.array(here)), lists], names=names)

    names = ["h1", "tail", "id", "digest", "ranges"]
    schema = "h1 long, tail long, id long, digest long, ranges array<long>"
    rows = docs.select("id", "digest", "text").mapInArrow(candidates, schema)
    sorted_rows = rows.repartition("h1").sortWithinPartitions(
        "h1", F.shiftright("tail", 32).asc_nulls_first(), F.col("id").asc_nulls_first(), "tail")

    kept = ["id", "digest", "start", "ranges"]

    def losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # window and first place of the window that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.filter(batch.column(4).is_valid())
            yield pa.RecordBatch.from_arrays([own.column(2), own.column(3), pa.nulls(own.num_rows, pa.int64()), own.column(4)], names=kept)
            batch = batch.filter(batch.column(4).is_null())
            if not batch.num_rows:
                continue
            h1, tail = (np.asarray(batch.column(i)) for i in (0, 1))
            h2, start = tail >> 32, tail & 0xFFFFFFFF
            null = np.asarray(batch.column(2).is_null())
            number = np.asarray(batch.column(2).fill_null(0))
            head = np.ones(len(h1), bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            lost = ~((number == number[lead]) & (null == null[lead]) & (start == start[lead]))
            if last is not None and (h1[0], h2[0]) == last[:2]:
                same = lead == 0
                lost[same] = ~((number[same] == last[2]) & (null[same] == last[3]) & (start[same] == last[4]))
            else:
                last = None
            k = lead[-1]
            if k or last is None:
                last = (h1[k], h2[k], number[k], null[k], start[k])
            gone = pa.array(lost)
            yield pa.RecordBatch.from_arrays([batch.column(2).filter(gone), batch.column(3).filter(gone), pa.array(start[lost]),
                                              pa.nulls(int(lost.sum()), pa.list_(pa.int64()))], names=kept)

    lost = sorted_rows.mapInArrow(losers, "id long, digest long, start long, ranges array<long>")
    return lost.groupBy("id", "digest").agg(F.sort_array(F.collect_list("start")).alias("starts"),
                                            F.flatten(F.collect_list("ranges")).alias("ranges"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space) of every row.

    Words are runs of characters other than space and the controls 9 to 13, unchanged. A null text has none. A null id is
    smaller than any other. Rows that repeat an id share its places: a window is not earlier than itself at the same
    id and start, so equal rows are treated alike.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                         F.col(text).alias("text"))
    gone = repeated_places(source, size)
    matched = source.alias("d").join(gone.hint("shuffle_hash").alias("g"), (F.col("d.digest") == F.col("g.digest")) & F.col("d.id").eqNullSafe(F.col("g.id")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                out = [[], [], []]
                for t, starts, ranges in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    words = (t or "").encode().split()
                    keep = np.ones(len(words), bool)
                    for s, e in zip((ranges or [])[::2], (ranges or [])[1::2]):
                        keep[s:e] = False
                    spans = _runs(np.array(starts or [], np.int64), size)
                    for s, e in zip(spans[::2], spans[1::2]):
                        keep[s:e] = False
                    left = words if keep.all() else [w for w, k in zip(words, keep) if k]
                    for column, value in zip(out, (len(words), len(words) - len(left), b" ".join(left).decode())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                                 names=["id", "n_words", "n_removed", "kept"])

    done = matched.select("d.id", "d.text", "starts", "ranges").mapInArrow(strip, "id long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", doc_id)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated 20-word windows."""
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
