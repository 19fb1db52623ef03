"""Near-duplicate documents: ProbMinHash signatures, banding, and exact verification.

A document is the set of its five-word shingles, all of weight 1, or, where that is asked for, each weighing as often
as it occurs. In ProbMinHash each shingle sends a Poisson process of arrivals, its rate the weight, each arrival to a
random component of the signature; a component keeps the shingle that arrived first. A process ends as soon as its
next arrival is later than all components' first ones. Two documents agree in a component with their probability
Jaccard similarity, which for sets is the Jaccard similarity; the same similarity is verified.

Equal texts count once. Documents that share a band of their signatures are a bucket. Each document goes to one head, of
all documents of its buckets the one that shares most buckets with others; a head's documents are cut into blocks, and a task
verifies a block and its head by their shingle sets. Where different classes remain in a bucket after that, the documents
outside its largest class meet the others in blocks: first by signatures, which tell who may link across classes at all, then those
by their sets. Tasks write only links that join classes, never pairs to be verified, so what a group of copies writes is in proportion to
its documents, however many of them are similar. Comparisons inside tasks are quadratic where a bucket holds many documents that do not link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import checkpointed, forget_encoders, unused
from .textwords import mix, pieces, utf8, window_hashes, window_starts, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
# With similarity 0.8, two documents share no band once in 1,900 pairs; with 0.85, once in 230,000. Long bands keep
# documents apart that share one common passage only.
BANDS, ROWS = 32, 7
# Documents may link if the share of components in which they agree is no further than this below the threshold: with 224
# components 3.7 standard deviations, which one pair in 10,000 of exactly the threshold misses.
SLACK = 0.1
# Documents in a block of those of a head or outside the largest class, and of the members they meet; shingles in any block.
OUTSIDE, MEMBERS, HASHES = 256, 1024, 1 << 20
# Buckets that a document is thought to share with its head; it may be one, and a block then so many times as large.
BUCKETS = 8
# Shingles whose arrivals are drawn together.
BATCH = 200_000


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows, one after another, and the row of each.

    A text with fewer words than a shingle, but some, is one shingle; a null or empty text has none.
    """
    data, offsets = utf8(column)
    starts, ends, word_offsets = word_spans(data, offsets)
    words, counts = word_hashes(data, starts, ends), np.diff(word_offsets)
    at, rows = window_starts(word_offsets, size)
    hashes = [window_hashes(words, size)[at]]
    owners = [rows]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(window_hashes(words, n, salt=n)[word_offsets[short]])
            owners.append(short)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row, sorted within rows, with their rows and how often they occur."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(first)
    return hashes[at], rows[at], np.diff(np.append(at, len(hashes)))


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """ProbMinHash signature of each row: ``size`` shingle hashes, all 0 for a row without shingles."""
    first = np.full(n_rows * size, np.inf)
    chosen = np.zeros(n_rows * size, np.uint64)
    active, time, number = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(active):
        # a few arrivals of each process at once, the more the fewer processes are left
        many = int(np.clip(BATCH // len(active), 1, 16))
        draws = mix(hashes[active][:, None] ^ mix(np.arange(number, number + many, dtype=np.uint64), 3)[None, :], 4)
        gaps = -np.log(((draws >> np.uint64(12)) + 0.5) * 2.0**-52)
        arrivals = time[active][:, None] + np.cumsum(gaps, axis=1) / weights[active][:, None]
        component = (mix(draws, 5) % np.uint64(size)).astype(np.int64) + (rows[active] * size)[:, None]
        flat, cell = arrivals.ravel(), component.ravel()
        better = flat < first[cell]
        flat, cell = flat[better], cell[better]
        of = np.repeat(hashes[active], many)[better]
        order = np.argsort(-flat, kind="stable")  # the last one written is the earliest
        first[cell[order]] = flat[order]
        chosen[cell[order]] = of[order]
        time[active] = arrivals[:, -1]
        latest = first.reshape(n_rows, size).max(axis=1)
        active = active[time[active] < latest[rows[active]]]
        number += many
    return chosen.reshape(n_rows, size)


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets of sorted hashes: the chance that their components agree."""
    every = np.union1d(x, y)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = wx, wy
    # For a common i, the sum of max(a_j / a_i, b_j / b_i) has the first term where a_j / b_j is at least a_i / b_i.
    ratio = np.divide(a, b, out=np.full(len(every), np.inf), where=b > 0)
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    behind, before = np.cumsum(a[::-1])[::-1], np.cumsum(b) - b
    both = (a > 0) & (b > 0)
    return float((1 / (behind[both] / a[both] + before[both] / b[both])).sum())


def _bands(docs: DataFrame, bands: int, rows: int, weighted: bool) -> DataFrame:
    """``id``, ``digest`` of the text, the hash of each band (null for a text without words), 8 bits of each component, and ``n`` distinct shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in (part for whole in batches for part in pieces(whole, 2)):
            hashes, owners, weights = counted(*shingles(batch.column(2)))
            if not weighted:
                weights = np.ones(len(hashes), np.int64)
            n = batch.num_rows
            out, short = np.zeros((n, bands), np.uint64), np.zeros((n, bands * rows), np.uint8)
            ends = np.searchsorted(owners, np.arange(n + 1))
            start = 0
            while start < n:  # rows up to about a batch of shingles at a time
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + BATCH, "right")) - 1)
                part = slice(ends[start], ends[stop])
                made = signatures(hashes[part], owners[part] - start, weights[part], stop - start, bands * rows)
                short[start:stop] = made & np.uint64(0xFF)
                made = made.reshape(-1, bands, rows)
                folded = np.zeros(made.shape[:2], np.uint64)
                for k in range(rows):
                    folded = mix(folded ^ made[:, :, k], 6 + k)
                out[start:stop] = folded
                start = stop
            values = pa.array(out.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), values,
                                             mask=pa.array(ends[1:] == ends[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([r.tobytes() for r in short], pa.binary()),
                                              pa.array(np.diff(ends).astype(np.int64))], names=["id", "digest", "bands", "signature", "n"])

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, digest binary, bands array<long>, signature binary, n long")


def _sets(docs: DataFrame, ids: DataFrame, weighted: bool) -> DataFrame:
    """``id``, the sorted shingle hashes ``s`` of its text, and how often each occurs (``w``, if weighted)."""
    parts = ["s", "w"] if weighted else ["s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            hashes, owners, weights = counted(*shingles(batch.column(1)))
            ends = np.searchsorted(owners, np.arange(batch.num_rows + 1)).astype(np.int32)
            sets = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.view(np.int64))) for v in ((hashes, weights) if weighted else (hashes,))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sets], names=["id", *parts])

    involved = docs.join(ids.hint("shuffle_hash"), ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "text")
    return involved.mapInArrow(run, "id long" + "".join(f", {p} array<long>" for p in parts))


class Block:
    """Documents that meet in a task: ids, classes and shingle sets, one after another."""

    def __init__(self, docs: pa.RecordBatch):
        self.ids, self.classes = (docs.column(k).to_numpy() for k in ("id", "class"))
        sets = docs.column("s")
        ends = sets.offsets.to_numpy().astype(np.int64)
        self.flat, self.ends = sets.values.to_numpy().view(np.uint64)[ends[0]:ends[-1]], ends - ends[0]
        self.weights = docs.column("w").flatten().to_numpy() if "w" in docs.schema.names else None

    def links(self, first: int, threshold: float) -> list[tuple[int, int, float, int]]:
        """Links from the first documents to all: as many as join every two classes that any such link joins.

        Documents are compared only while their classes are apart; a link joins them. With each link comes the class that all
        that is joined has in the end: that of the last document, if it is among them.
        """
        out, sizes = [], np.diff(self.ends)
        distinct, local = np.unique(self.flat, return_inverse=True)
        marked = np.zeros(len(distinct), bool)
        of = self.classes.copy()
        for i in range(first):
            apart = np.flatnonzero((of != of[i]) & (self.ids != self.ids[i]))
            if self.weights is None:  # no similarity is above that of the sizes
                apart = apart[np.minimum(sizes[apart], sizes[i]) >= threshold * np.maximum(sizes[apart], sizes[i])]
            if not len(apart):
                continue
            own = slice(self.ends[i], self.ends[i + 1])
            marked[local[own]] = True
            if 8 * len(apart) > len(sizes):
                upto = np.concatenate([[0], np.cumsum(marked[local])])
                common = upto[self.ends[apart + 1]] - upto[self.ends[apart]]
            else:
                common = np.array([np.count_nonzero(marked[local[self.ends[j]:self.ends[j + 1]]]) for j in apart])
            marked[local[own]] = False
            if self.weights is None:
                similarity = common / (sizes[apart] + sizes[i] - common)
            else:
                similarity = np.array([self._weighted(i, j) if c else 0.0 for j, c in zip(apart, common)])
            for k in np.argsort(-similarity, kind="stable"):
                if similarity[k] < threshold:
                    break
                j = apart[k]
                if of[j] != of[i]:
                    out.append((int(self.ids[i]), int(self.ids[j]), float(similarity[k])))
                    of[of == of[j]] = of[i]
        names = {of[-1]: int(self.classes[-1])} if len(of) else {}
        place = {int(d): k for k, d in reversed(list(enumerate(self.ids)))}
        return [(a, b, s, names.get(of[place[a]], int(of[place[a]]))) for a, b, s in out]

    def _weighted(self, i: int, j: int) -> float:
        a, b = (slice(self.ends[k], self.ends[k + 1]) for k in (i, j))
        return probability_jaccard(self.flat[a], self.weights[a], self.flat[b], self.weights[b])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of each key, which stand together, as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.concat_batches(held)
            held = []
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def _together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key in one partition, next to each other, those of side 0 first."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "side")


def _links(met: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``a``, ``b``, ``similarity`` and joint ``class`` of the links of documents of side 0 to all with the same keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for group in _groups(batches, keys):
            found = Block(group).links(int((group.column("side").to_numpy() == 0).sum()), threshold)
            if found:
                a, b, similarity, joint = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64)),
                                                  pa.array(similarity, pa.float64()), pa.array(joint, pa.int64())], names=["a", "b", "similarity", "class"])

    return _together(met, keys).mapInArrow(run, "a long, b long, similarity double, class long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """``doc_id``, ``class_id`` and ``n_links`` of every row of ``docs``.

    ``class_id`` is the smallest id among the documents that chains of links join: equal texts, and texts of
    similarity ``threshold`` or more. ``n_links`` counts the links of a text to different ones among those that hold its class
    together: a class of k different texts has k - 1 or a few more of them, and only a text alone in its class has none.
    The similarity is that of sets; if ``weighted``, the probability Jaccard of shingles weighing as often as they occur.
    A text without words (null, empty or blank) links to nothing and is a class of its own. Rows that repeat an id
    share what any of their texts links to; a row whose id is null has a null class and no links.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    source = source.withColumn("digest", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    marked = checkpointed(_bands(source, bands, rows, weighted))
    members = marked.where("bands IS NOT NULL AND id IS NOT NULL")
    # One document stands for all of equal text: the smallest id of the digest.
    # (Aggregates that many rows meet again are stored first: only then can a hot key of the other side be split.)
    distinct = checkpointed(members.groupBy("digest").agg(F.min(F.struct("id", "bands", "signature", "n")).alias("x")).select("digest", "x.*"))
    copies = members.select("id", "digest").join(distinct.select("digest", F.col("id").alias("of")), "digest").where("id <> of")

    # Documents that share a bucket, each with its buckets.
    banded = distinct.select("id", "digest", "n", F.posexplode("bands").alias("band", "hash"))
    counts = checkpointed(banded.groupBy("band", "hash").agg(F.count("*").alias("docs")).where("docs > 1"))
    sharing = checkpointed(banded.join(counts, ["band", "hash"]).groupBy("id", "digest", "n").agg(
        F.sum("docs").alias("degree"), F.collect_list(F.struct("band", "hash")).alias("buckets")))
    sets = checkpointed(_sets(source, sharing.select("id", "digest"), weighted))
    shared = sharing.select("id", "n", "degree", F.explode("buckets").alias("bucket")).select("id", "n", "degree", "bucket.*")
    # Each document goes to one head: of the heads of its buckets the one that shares most.
    ranked = checkpointed(shared.groupBy("band", "hash").agg(F.max(F.struct("degree", (-F.col("id")).alias("less"))).alias("top")))
    chosen = shared.join(ranked, ["band", "hash"]).groupBy("id", "n").agg(F.max("top").alias("top"))
    chosen = checkpointed(chosen.select("id", "n", (-F.col("top.less")).alias("head"), F.col("top.degree").alias("degree")).where("id <> head"))
    links = checkpointed(_links(_around(chosen, sets), AROUND, threshold))

    # What these links join has one class, and that of its head's class. This need not be all that chains of links join:
    # documents that have one class do belong together, others are compared.
    near = links.select(F.explode(F.array("a", "b")).alias("id"), "class").groupBy("id").agg(F.min("class").alias("class"))
    further = near.select(F.col("id").alias("class"), F.col("class").alias("next"))
    near = near.join(further, "class", "left").select("id", F.coalesce("next", "class").alias("class"))
    buckets = shared.drop("degree").join(near, "id", "left").withColumn("class", F.coalesce("class", "id"))
    signs = distinct.select("id", "bands", "signature")
    likely = checkpointed(_likely(checkpointed(buckets), signs, bands * rows, threshold))
    met = _meetings(_mixed(likely, F.col("n")).join(sets, "id"))
    more = checkpointed(_links(met, MEETING, threshold))
    links = links.unionByName(more)
    # What a link joins is joined by way of its class, which makes short chains.
    stars = links.select("class", F.explode(F.array("a", "b")).alias("b")).select(F.col("class").alias("a"), "b")
    classes = components(stars.union(copies.select("of", "id")))
    links = links.select("a", "b").distinct()
    counts = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_digest = distinct.select("digest", "id").join(counts, "id").select("digest", "n_links")
    out = marked.select("id", "digest").join(classes, "id", "left").join(of_digest, "digest", "left")
    return out.select(F.col("id").alias(doc_id), F.coalesce("class", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _blocks(docs: Column, number: int, shingles: Column) -> Column:
    """How many blocks so many documents and shingles make; a document's block is the remainder of a hash of its id."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(docs / number), F.ceil(shingles / HASHES))


#: Keys of a block of the documents of one head.
AROUND = ["head", "span", "block"]


def _around(chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """Documents of each ``head`` in blocks, and on side 1 of each block the head itself.

    A head has no more documents than its ``degree``, which counts one that shares several buckets as often. So that and the
    power of two above a document's shingles, its ``span``, give blocks of bounded size without a count.
    """
    span = F.ceil(F.log2("n")).cast("int")
    docs = F.ceil(F.col("degree") / BUCKETS)
    own = chosen.select("id", "head", span.alias("span"),
                        F.pmod(F.xxhash64("id"), _blocks(docs, OUTSIDE, docs * F.pow(F.lit(2.0), span))).alias("block"))
    heads = own.select(*AROUND).distinct().select(F.col("head").alias("id"), *AROUND, F.lit(1).alias("side"))
    return own.withColumn("side", F.lit(0)).unionByName(heads).join(sets.withColumn("class", F.col("id")), "id")


#: Keys of a meeting of two blocks of a bucket.
MEETING = ["band", "hash", "outer", "inner"]


def _meetings(rows: DataFrame) -> DataFrame:
    """Documents outside the largest class of a bucket (side 0) in ``outer`` blocks, each with every ``inner`` block of all of the bucket's (side 1).

    ``rows`` has ``band``, ``hash``, ``id``, ``class``, whether it is ``outside``, and the numbers of blocks ``outer`` and ``inner``.
    """
    place = F.xxhash64("id")
    mine, theirs = F.pmod(place, F.col("outer")), F.pmod(place, F.col("inner"))

    def upto(number: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(number) - 1)

    def at(outer: Column, inner: Column, side: int) -> Column:
        return F.struct(outer.alias("outer"), inner.alias("inner"), F.lit(side).alias("side"))
    inside = F.transform(upto("outer"), lambda o: at(o, theirs, 1))
    both = F.concat(F.transform(upto("inner"), lambda i: at(mine, i, 0)), inside)
    met = rows.withColumn("met", F.explode(F.when(F.col("outside"), both).otherwise(inside)))
    return met.select(*(c for c in rows.columns if c not in ("outer", "inner", "outside")), "met.*")


def _mixed(rows: DataFrame, size: Column) -> DataFrame:
    """The rows of buckets in which classes differ, marked by whether they are outside the largest class, and the blocks of the bucket."""
    sizes = rows.groupBy("band", "hash", "class").agg(F.count("*").alias("docs"), F.sum(size).alias("all"))
    main = F.max(F.struct("docs", "class", "all"))
    mixed = checkpointed(sizes.groupBy("band", "hash").agg(
        F.count("*").alias("classes"), main["class"].alias("main"),
        _blocks(F.sum("docs") - main["docs"], OUTSIDE, F.sum("all") - main["all"]).alias("outer"),
        _blocks(F.sum("docs"), MEMBERS, F.sum("all")).alias("inner")).where("classes > 1").drop("classes"))
    return rows.join(mixed, ["band", "hash"]).withColumn("outside", F.col("class") != F.col("main")).drop("main")


def _likely(buckets: DataFrame, signatures: DataFrame, size: int, threshold: float) -> DataFrame:
    """``band``, ``hash``, ``id``, ``class`` and shingles ``n`` of documents that may link to one of another class in the bucket.

    Two documents meet in the first band that they share only. They may link if they agree in nearly as many components as the
    threshold has them agree on average.
    """
    met = _together(_meetings(_mixed(buckets, F.lit(1)).join(signatures, "id")), MEETING)
    least = size * (threshold - SLACK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for group in _groups(batches, MEETING):
            band, first = group.column("band")[0].as_py(), int((group.column("side").to_numpy() == 0).sum())
            ids, of = (group.column(k).to_numpy() for k in ("id", "class"))
            known = group.column("bands").flatten().to_numpy().reshape(len(ids), -1)[:, :band]
            signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), size)
            found = np.zeros(len(ids), bool)
            for k in range(first):
                at = np.flatnonzero(of[first:] != of[k]) + first
                at = at[(signs[at] == signs[k]).sum(axis=1) >= least]
                at = at[~(known[at] == known[k]).any(axis=1)]
                found[at] = True
                found[k] = len(at) > 0
            if found.any():
                yield group.select(["band", "hash", "id", "class", "n"]).filter(pa.array(found))

    return met.mapInArrow(compare, "band int, hash long, id long, class long, n long").distinct()


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but those whose class has a smaller id.

    Of rows that repeat the id of a class, one whole row stays if their texts are equal.
    """
    classes = near_duplicates(docs, text, doc_id, **options)
    name = unused("gone", docs)
    gone = classes.where(F.col(doc_id) != F.col("class_id")).select(F.col(doc_id).alias(name)).distinct()
    return docs.join(gone, docs[doc_id] == gone[name], "left_anti")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document among all, by similarity 0.8 of five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
