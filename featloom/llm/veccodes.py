"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. The parts of a
chunk of vectors are sorted along a Hilbert curve, position by position, and stored as flat blocks of ``BLOCK`` parts,
each with the smallest and largest value of every component (its box) and their sums. In a round, the squared distances
of an entry to the nearest and to the furthest point of a box bound its distance to all parts of the block; entries whose
nearest point is further than another one's furthest point are out. What is left is the block's shortlist. A block
with one entry on its list adds its stored sums without a look at its parts; the parts of the others are compared with the
entries of their list, in 64-bit integers. So every round gives exactly the assignment that comparing all
parts with all entries gives.

Chunks are made from the rows of a task in the order in which they come; no vector is shuffled. A round hands on one
sum and count for each (part, entry, component) and task. Blocks stay in a checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Vectors of a chunk at most, and parts in a block.
CHUNK, BLOCK = 65_536, 16
# Bits a component has in a Hilbert key; a key takes 63 bits at most.
KEY_BITS = 63
# Components below this in magnitude are compared in 64-bit integers, larger ones in Python's.
EXACT = 2.0**29
# Sums travel as two numbers, this many times the first and the second.
LIMB = 1 << 60


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place along a Hilbert curve through the box of the points; a row is a point.

    Components are cut into as many levels as a 63-bit key has room for. Works on all points at once, one bit and component at a time:
    each bit of a component decides whether the lower bits of the first one are mirrored or change places with its own.
    """
    n, width = points.shape
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, min(16, KEY_BITS // width))
    low = points.min(axis=0).astype(float)
    span = np.maximum(points.max(axis=0).astype(float) - low, 1.0)
    cells = np.clip((points.astype(float) - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(width):
            mirror = (cells[k] >> bit) & 1 == 1
            swapped = np.where(mirror, 0, (cells[0] ^ cells[k]) & below)
            cells[0] ^= np.where(mirror, below, swapped)
            cells[k] ^= swapped
    for k in range(1, width):  # Gray code of each level, across components
        cells[k] ^= cells[k - 1]
    flip = np.zeros(n, np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((cells[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    cells ^= flip
    keys = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(min(width, KEY_BITS)):  # of very wide parts only the first components count
            keys = (keys << 1) | ((cells[k] >> bit) & 1)
    return keys


def integers(values: np.ndarray) -> np.ndarray:
    """Whole floats as 64-bit integers, or as Python integers where squares of their differences might not fit."""
    if np.abs(values).max(initial=0) < EXACT:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out.reshape(-1)[:] = [int(v) for v in values.reshape(-1)]
    return out


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each box and entry, whether the entry may be nearest to a part in the box.

    Out is an entry whose distance to the nearest point of the box is above another one's to the furthest point, or that is further than the
    entry of the least such reach from every point of the box: the difference of two squared distances is linear in the point, so its least
    value over the box is a sum over components.
    """
    near = far = 0
    for c in range(low.shape[1]):  # one component at a time: (blocks x entries) is all that is held
        below, above = low[:, c, None] - book[None, :, c], book[None, :, c] - high[:, c, None]
        out = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(abs(below), abs(above))
        near, far = near + out * out, far + reach * reach
    rival, lead = book[far.argmin(axis=1)], 0
    for c in range(low.shape[1]):
        mine, other = book[None, :, c], rival[:, c, None]
        slope = 2 * (other - mine)
        lead = lead + mine * mine - other * other + np.minimum(slope * low[:, c, None], slope * high[:, c, None])
    return (near <= far.min(axis=1)[:, None]) & (lead <= 0)


def nearest(parts: np.ndarray, block_of: np.ndarray, listed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part, by its block's shortlist; ties go to the lower entry."""
    entry = np.full(len(parts), -1, np.int64)
    best = np.zeros(len(parts), np.result_type(parts, book))
    for e in range(len(book)):
        at = np.flatnonzero(listed[block_of, e])
        if len(at):
            apart = parts[at] - book[e]
            distance = (apart * apart).sum(axis=1)
            closer = (entry[at] < 0) | (distance < best[at]).astype(bool)
            entry[at[closer]], best[at[closer]] = e, distance[closer]
    return entry, best


class Chunk:
    """Parts of a chunk of vectors at one position, in Hilbert order, cut into blocks."""

    def __init__(self, order: np.ndarray, sorted_parts: np.ndarray):
        self.order, self.parts = order, sorted_parts
        self.starts = np.arange(0, len(order), BLOCK)
        self.block_of = np.arange(len(order)) // BLOCK

    @classmethod
    def of(cls, parts: np.ndarray) -> Chunk:
        order = np.argsort(hilbert_keys(parts), kind="stable")
        return cls(order, parts[order])

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest and largest components, and sums of components, of each block."""
        return tuple(f.reduceat(self.parts, self.starts, axis=0) for f in (np.minimum, np.maximum, np.add))


def _bytes(values: np.ndarray) -> bytes:
    """Integers in as few bytes as they all fit in; floats hold those beyond 64 bits, each of which is one exactly."""
    if values.dtype == object:
        return b"f" + values.astype(np.float64).tobytes()
    top = int(np.abs(values).max(initial=0))
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    return kind[2].encode() + values.astype(kind).tobytes()


def _numbers(data: bytes, *shape: int) -> np.ndarray:
    if data[:1] == b"f":
        return integers(np.frombuffer(data, "<f8", offset=1)).reshape(shape)
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.int64).reshape(shape)


def _chunks(vectors: DataFrame, dim: int, parts: int) -> DataFrame:
    """One row a chunk: its ids and labels, and of each position the order, parts, boxes and block sums."""
    width = dim // parts

    def rows(ids: list, labels: list, held: list) -> pa.RecordBatch:
        values, names = integers(np.concatenate(held)), ["order", "parts", "low", "high", "sums"]
        packed: list[list[bytes]] = [[] for _ in names]
        for p in range(parts):
            chunk = Chunk.of(values[:, p * width:(p + 1) * width])
            low, high, sums = chunk.boxes()
            exact = sums if sums.dtype != object else sums.astype(str).astype(bytes)  # sums may have more bits than a float
            for out, data in zip(packed, (chunk.order.astype("<i4").tobytes(), _bytes(chunk.parts), _bytes(low), _bytes(high),
                                          _bytes(sums) if exact is sums else b"s" + b",".join(exact.reshape(-1)))):
                out.append(data)
        return pa.RecordBatch.from_arrays(
            [pa.array([pa.concat_arrays(x)], pa.list_(x[0].type)) for x in (ids, labels)]
            + [pa.array([x], pa.list_(pa.binary())) for x in packed], names=["ids", "labels", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, n = [], [], [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                if n + len(flat) > CHUNK and n:
                    yield rows(ids, labels, held)
                    ids, labels, held, n = [], [], [], 0
                ids.append(batch.column(0))
                labels.append(batch.column(1))
                held.append(flat)
                n += len(flat)
        if n:
            yield rows(ids, labels, held)

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "label", "v").mapInArrow(
        run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, "
             "order array<binary>, parts array<binary>, low array<binary>, high array<binary>, sums array<binary>")


def _block_sums(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"s":
        return np.array([int(x) for x in data[1:].split(b",")], object).reshape(-1, width)
    return _numbers(data, -1, width)


def _summed(chunks: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``part``, ``entry``, ``place``, and a task's sum (in two limbs) and count of the components assigned there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[[0] * width for _ in book] for book in books]
        counts = [[0] * len(book) for book in books]
        for batch in batches:
            for row in batch.select(["parts", "low", "high", "sums"]).to_pylist():
                for p, book in enumerate(books):
                    low, high = (_numbers(row[k][p], -1, width) for k in ("low", "high"))
                    listed, stored = shortlists(low, high, book), _block_sums(row["sums"][p], width)
                    parts = _numbers(row["parts"][p], -1, width)
                    sizes = np.minimum(BLOCK, len(parts) - np.arange(len(low)) * BLOCK)
                    alone = listed.sum(axis=1) == 1
                    sole = listed.argmax(axis=1)
                    open_parts = np.repeat(~alone, sizes)
                    block_of = np.repeat(np.arange(len(low)), sizes)[open_parts]
                    some = parts[open_parts]
                    entry, _ = nearest(some, block_of, listed, book)
                    for e in range(len(book)):
                        mine, whole = entry == e, alone & (sole == e)
                        counts[p][e] += int(mine.sum()) + int(sizes[whole].sum())
                        for c, (a, b) in enumerate(zip(some[mine].sum(axis=0), stored[whole].sum(axis=0))):
                            totals[p][e][c] += int(a) + int(b)
        rows = [(p, e, c, str(total // LIMB), total % LIMB, counts[p][e])
                for p, entries in enumerate(totals) for e, places in enumerate(entries) for c, total in enumerate(places) if counts[p][e]]
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["part", "entry", "place", "much", "little", "n"])

    return chunks.mapInArrow(run, "part int, entry int, place int, much string, little long, n long")


def _coded(chunks: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of every vector; an error beyond 64 bits is null."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema.fields[:2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                codes, error = np.zeros((len(ids), len(books)), np.uint8), 0
                order, parts, low, high = (batch.column(k)[i].as_py() for k in ("order", "parts", "low", "high"))
                for p, book in enumerate(books):
                    at, points = np.frombuffer(order[p], "<i4"), _numbers(parts[p], -1, width)
                    listed = shortlists(_numbers(low[p], -1, width), _numbers(high[p], -1, width), book)
                    entry, best = nearest(points, np.arange(len(points)) // BLOCK, listed, book)
                    codes[at, p] = entry
                    back = np.empty(len(at), best.dtype)
                    back[at] = best
                    error = error + back
                digits = codes.tobytes().hex()
                step = 2 * len(books)
                fits = [int(x) if x < 2**63 else None for x in error]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[k:k + step] for k in range(0, len(digits), step)], pa.string()),
                                                  pa.array(fits, pa.int64())], names=["id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector that is kept.

    A null vector, and one with a null or non-finite component, is dropped; so is one whose length is not that of
    the smallest kept id's vector, or not a multiple of ``parts``. A component x becomes floor(scale * x). The codebook of a position starts as that
    part of the ``entries`` smallest ids (at most 256; fewer where there are fewer; nulls last, equal ids by their components); ``rounds``
    times all parts go to their nearest entry, ties to the lower one, and entries become the floors of their parts' means,
    unused ones stay; then parts are assigned for good. ``code`` has two hex digits a part, ``error`` is the sum of squared
    distances, ``label_error`` its sum over the rows of equal labels (null labels are one group); either is null where it does not fit into
    64 bits. Ids that repeat are rows like any others. An empty table gives an empty result, as does one where no vector is kept.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits tells at most 256 entries apart")
    spark = vectors.sparkSession
    whole = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = whole.where("v IS NOT NULL AND size(v) > 0").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf"))))
    ints = sound.select("id", "label", F.transform("v", lambda x: _floored(x, scale)).alias("v"))
    first = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).first()
    dim = first.n if first and first.n % parts == 0 else 0
    names = [vec_id, label if label != vec_id else "label", "code", "error", "label_error", "codebooks_sha256"]
    if not dim:
        empty = ints.limit(0).select("id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in names[3:5]), F.lit("").alias("sha"))
        return empty.toDF(*names)
    kept, width = ints.where(F.size("v") == dim), dim // parts
    starts = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # at most ``entries`` rows
    seeds = integers(np.array([r.v for r in starts], np.float64))
    books = [seeds[:, p * width:(p + 1) * width] for p in range(parts)]
    chunks = checkpointed(_chunks(kept, dim, parts))
    for _ in range(rounds):
        sums = _summed(chunks, books, width).groupBy("part", "entry", "place").agg(
            F.sum(F.col("much").cast("decimal(38,0)")).alias("much"), F.sum(F.col("little").cast("decimal(38,0)")).alias("little"), F.sum("n").alias("n"))
        books = [np.array([[int(x) for x in row] for row in book], object) for book in books]
        for r in sums.collect():  # a row for each component of the codebooks
            books[r.part][r.entry, r.place] = (int(r.much) * LIMB + int(r.little)) // r.n
        books = [integers(b.astype(np.float64)) if all(abs(int(x)) < 2**53 for x in b.reshape(-1)) else b for b in books]
    listed = ",".join(str(int(x)) for book in books for x in book.reshape(-1))
    coded = checkpointed(_coded(chunks, books, width))
    by_label = coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count_if(F.col("error").isNull()).alias("beyond"))
    by_label = checkpointed(by_label.select(F.col("label").alias("of"), F.when(F.col("beyond") == 0, F.col("label_error")).alias("label_error")))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return joined.select("id", coded["label"], "code", "error", "label_error",
                         F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("sha")).toDF(*names)


def _floored(x, scale: int):
    """floor(scale * x) as a float, which holds it exactly: Spark's own floor ends at 64 bits."""
    scaled = x * float(scale)
    # beyond 2^53 a float is whole already
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all sound vectors by 8 codebooks of 16 entries."""
    coded = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
