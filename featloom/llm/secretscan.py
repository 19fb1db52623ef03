"""Secrets in texts: fixed patterns, and automata inferred from what the patterns find.

The finds of the patterns are labelled credentials. For each kind a prefix tree of a bounded sample of them is
generalised by state merging: two states merge if the frequencies of their next characters and ends, and of those
behind them, differ no more than chance would make them. The result is a probabilistic automaton of the format; as merged
states forget how long a credential was, the lengths of the kind count beside it. Every run of credential
characters is then scored by its whole likelihood under each kind against that under all ordinary runs, whose lengths and pairs of
neighbouring characters are counted in all texts. A run is a further span where a kind explains it better by more than
ordinary runs outnumber the kind's credentials.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, unused
from .textwords import pieces

# Kinds of base finds with their patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Shortest runs that are scored, as short as base credentials may be, and characters that a run may consist of.
LEAST = 6
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
# Characters that may join a run to a base find.
JOINS = "=/.-"
# Verdicts on runs that a task remembers.
REMEMBERED = 200_000
# Labelled credentials of each kind that a fit uses at most: those of the smallest hashes; longer ones than LONGEST teach no format.
MAX_LABELLED, LONGEST = 600, 512
# Chance of keeping two equal states apart by one frequency of a half; for rare characters the bound is much wider.
ALPHA = 0.05
# Characters that a run may consist of, and what pairs that were never seen count.
ALPHABET, UNSEEN = 68, 0.5
# How many characters a state borrows from all others.
BORROWED = 4
# Different characters in a run that no credential of the kind holds; with more, the kind does not score it.
STRANGE = 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the finds of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def credential(text: str, span: tuple[int, int, str]) -> str:
    """The secret itself: for an assignment the value."""
    found = text[span[0]:span[1]]
    return ASSIGN.match(found)[2] if span[2] == "assign" else found


class State:
    __slots__ = ("n", "ends", "next", "count")

    def __init__(self):
        self.n, self.ends, self.next, self.count = 0, 0, {}, Counter()


def _prefix_tree(words: Sequence[str]) -> State:
    root = State()
    for word in words:
        state = root
        for c in word:
            state.n += 1
            state.count[c] += 1
            state = state.next.setdefault(c, State())
        state.n += 1
        state.ends += 1
    return root


def _close(f: int, n: int, g: int, m: int, alpha: float) -> bool:
    """Whether two frequencies differ by no more than the Hoeffding bound allows."""
    return abs(f / n - g / m) < math.sqrt(0.5 * math.log(2 / alpha)) * (n ** -0.5 + m ** -0.5)


def _compatible(a: State, b: State, alpha: float) -> bool:
    """Whether two states, and those that the same characters lead to from them, differ no more than chance allows."""
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        if not _close(a.ends, a.n, b.ends, b.n, alpha):
            return False
        for c in a.count.keys() | b.count.keys():
            if not _close(a.count[c], a.n, b.count[c], b.n, alpha):
                return False
            if c in a.next and c in b.next:
                waiting.append((a.next[c], b.next[c]))
    return True


def _fold(into: State, tree: State) -> None:
    """Add a state, and the tree behind it, to another one."""
    waiting = [(into, tree)]
    while waiting:
        into, tree = waiting.pop()
        into.n += tree.n
        into.ends += tree.ends
        into.count.update(tree.count)
        for c, state in tree.next.items():
            if c in into.next:
                waiting.append((into.next[c], state))
            else:
                into.next[c] = state


def infer(words: Sequence[str], alpha: float = ALPHA) -> State:
    """A probabilistic automaton of the words, by merging compatible states of their prefix tree."""
    root = _prefix_tree(sorted(words))
    settled, known = [root], {id(root)}
    while True:
        border = [(-s.n, c, state) for state in settled for c, s in sorted(state.next.items()) if id(s) not in known]
        if not border:
            return root
        _, c, parent = min(border, key=lambda x: x[:2])
        tree = parent.next[c]
        match = next((s for s in settled if _compatible(s, tree, alpha)), None)
        if match is None:
            settled.append(tree)
            known.add(id(tree))
        else:
            parent.next[c] = match
            _fold(match, tree)


# Classes of characters of a run; the rest is one class.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CLASSES = {c: k for k, letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")) for c in letters}


def _class(c: str) -> int:
    return CLASSES.get(c, 3)


Row = dict[str, tuple[float, int]]


def _table(automaton: State) -> list[Row]:
    """The automaton as rows: for each character its log probability, given that another one comes, and the next row.

    A state that saw few credentials knows little: as if it had seen ``BORROWED`` more characters, spread as in all states together. There, one
    more character is unseen, any other of the classes that occur. Such a character leads where most do.
    """
    number, states = {id(automaton): 0}, [automaton]
    for state in states:
        for following in state.next.values():
            if id(following) not in number:
                number[id(following)] = len(states)
                states.append(following)
    every: Counter[str] = Counter()
    for s in states:
        every.update(s.count)
    classes = {_class(c) for c in every}
    letters = [c for c in LETTERS if _class(c) in classes]
    unseen = 1 / max(len(letters) - len(every), 1)
    overall = {c: (every.get(c) or unseen) / (sum(every.values()) + 1) for c in letters}
    out = []
    for k, s in enumerate(states):
        total = s.n - s.ends + BORROWED
        usual = number[id(s.next[max(sorted(s.next), key=s.count.__getitem__)])] if s.next else k
        out.append({c: (math.log((s.count.get(c, 0) + BORROWED * p) / total), number[id(s.next[c])] if c in s.next else usual)
                    for c, p in overall.items()})
    return out


def log_likelihood(table: list[Row], word: str) -> float:
    """Log probability of the characters of a word; minus infinity where no credential has a character of its class."""
    total, row = 0.0, 0
    for c in word:
        step = table[row].get(c)
        if step is None:
            return -math.inf
        total, row = total + step[0], step[1]
    return total


def length_bin(n: int) -> int:
    """Lengths up to 256 are a bin each, longer ones one for each power of two."""
    return n if n <= 256 else 248 + (n - 1).bit_length()


class Lengths:
    """Probabilities of lengths from counts by bin; one more length, unseen, may be any."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.total = counts, sum(counts.values()) + 1

    def log_probability(self, n: int) -> float:
        place = length_bin(n)
        within = 1 if n <= 256 else 1 << (place - 249)  # lengths of the bin
        # an unseen length: half of the chance for each doubling of it, spread over that doubling
        unseen = 2.0 ** (-2 * n.bit_length())
        return math.log((self.counts.get(place, 0) / within + unseen) / self.total)


class Ordinary:
    """Likelihood of runs by their length and by pairs of neighbouring characters; a line end stands before the first one."""

    def __init__(self, pairs: dict[str, int], lengths: dict[int, int]):
        before: Counter[str] = Counter()
        for pair, n in pairs.items():
            before[pair[0]] += n
        self.pairs = {pair: math.log((n + UNSEEN) / (before[pair[0]] + UNSEEN * ALPHABET)) for pair, n in pairs.items()}
        self.unseen = {c: math.log(UNSEEN / (n + UNSEEN * ALPHABET)) for c, n in before.items()}
        self.lengths, self.runs = Lengths(lengths), sum(lengths.values())

    def log_likelihood(self, word: str) -> float:
        total, last = self.lengths.log_probability(len(word)), "\n"
        for c in word:
            step = self.pairs.get(last + c)
            total += self.unseen.get(last, -math.log(ALPHABET)) if step is None else step
            last = c
        return total


class Formats:
    """Automata and lengths of the kinds, the ordinary runs, and how much better a kind must explain a run."""

    def __init__(self, labelled: dict[str, list[str]], found: dict[str, int], pairs: dict[str, int], lengths: dict[int, int]):
        self.ordinary, self.kinds, self.verdicts = Ordinary(pairs, lengths), [], {}
        for kind in sorted(labelled):
            words = [w for w in labelled[kind] if len(w) <= LONGEST]
            if words:
                # prior odds: credentials of the kind among all runs
                least = math.log((self.ordinary.runs + 1) / found[kind])
                self.kinds.append((_table(infer(words)), Lengths(Counter(length_bin(len(w)) for w in words)),
                                   frozenset("".join(words)), least))

    def tables(self) -> tuple:
        return self.ordinary, self.kinds

    @classmethod
    def of(cls, tables: tuple) -> Formats:
        out = cls.__new__(cls)
        out.ordinary, out.kinds = tables
        out.verdicts = {}
        return out

    def odds(self, word: str) -> float:
        """Log odds that the best kind, rather than ordinary text, made the run; minus infinity where no automaton has a way."""
        best, common = -math.inf, None
        for table, lengths, characters, least in self.kinds:
            if len(frozenset(word) - characters) <= STRANGE:
                likelihood = log_likelihood(table, word)
                if likelihood > -math.inf:
                    common = self.ordinary.log_likelihood(word) if common is None else common
                    best = max(best, likelihood + lengths.log_probability(len(word)) - common - least)
        return best

    def accepts(self, word: str) -> bool:
        verdict = self.verdicts.get(word)
        if verdict is None:
            verdict = self.odds(word) > 0
            if len(self.verdicts) >= REMEMBERED:
                self.verdicts.clear()
            if len(word) <= LONGEST:  # so many bytes at most
                self.verdicts[word] = verdict
        return verdict


def _rank(word: str) -> bytes:
    return hashlib.sha256(word.encode()).digest()[:8]


def fit_formats(docs: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED) -> Formats:
    """Automata from the base finds in all texts, of each kind at most ``max_labelled`` different ones, and the pairs and lengths of all ordinary runs.

    A task hands on no more than that many of each, those of the smallest hashes, which hold the smallest of all, and
    one count for each kind, pair of characters and length. Without a find there is no automaton and no further span.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, set[str]] = {}
        found: Counter[str] = Counter()
        lengths: Counter[int] = Counter()
        pairs = np.zeros(128 * 128, np.int64)

        def first(words: set[str]) -> set[str]:
            return set(sorted(words, key=_rank)[:max_labelled])

        for batch in (part for whole in batches for part in pieces(whole, 0)):
            ordinary = []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t or "")
                for s in spans:
                    found[s[2]] += 1
                    best.setdefault(s[2], set()).add(credential(t, s))
                ordinary += [t[s:e] for s, e in runs(t or "", spans)]
            lengths.update(map(length_bin, map(len, ordinary)))
            codes = np.frombuffer(("\n" + "\n".join(ordinary)).encode(), np.uint8).astype(np.int64)
            pairs += np.bincount(codes[:-1] * 128 + codes[1:], minlength=128 * 128)
            best = {kind: first(words) if len(words) > 8 * max_labelled else words for kind, words in best.items()}
        rows = [(kind, word, 1) for kind, words in best.items() for word in first(words)]
        rows += [("found", kind, n) for kind, n in found.items()] + [("length", str(k), n) for k, n in lengths.items()]
        rows += [("pair", chr(k // 128) + chr(k % 128), int(pairs[k])) for k in np.flatnonzero(pairs) if k % 128 != 10]  # ends are no characters
        types = {"kind": pa.string(), "word": pa.string(), "n": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=[*types])

    handed = checkpointed(docs.select(F.col(text)).mapInArrow(find, "kind string, word string, n long"))
    statistics = handed.where("kind IN ('found', 'length', 'pair')").groupBy("kind", "word").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = {"found": {}, "length": {}, "pair": {}}
    for r in statistics:  # kinds, bins of lengths and pairs of 67 characters: a few thousand at most
        counts[r.kind][r.word] = r.n
    distinct = handed.where(F.col("kind").isin(*KINDS[:3])).select("kind", "word").distinct()
    rank = F.substring(F.sha2("word", 256), 1, 16)
    labelled = {kind: [r.word for r in distinct.where(F.col("kind") == kind).orderBy(rank, "word").limit(max_labelled).collect()]
                for kind in KINDS[:3]}
    return Formats(labelled, counts["found"], counts["pair"], {int(k): n for k, n in counts["length"].items()})


def runs(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Start and end of the runs outside of base spans; what such a span leaves of a run is one, without the character that joined it."""
    ordered, k = sorted((s, e) for s, e, _ in spans), 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while k < len(ordered) and ordered[k][1] <= start:
            k += 1
        at, cut, i = start, False, k
        while i < len(ordered) and ordered[i][0] < end:
            s, e = ordered[i]
            if s > at:
                part = at + (cut and text[at] in JOINS), s - (text[s - 1] in JOINS)
                if part[1] - part[0] >= LEAST:
                    yield part
            if e > at:
                at, cut = e, True
            i += 1
        if at < end:
            at += cut and text[at] in JOINS
            if end - at >= LEAST:
                yield at, end


def find_secrets(docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``secrets``: start, end (code points, end exclusive) and kind of each find.

    Finds stand by start, then by kind in the order of ``KINDS``. Kind ``format`` marks runs, or what base finds
    leave of them, that only the automata know; they do not overlap base finds. A null text has none. The added name takes underscores if ``docs`` has it already.
    """
    name, place = unused("secrets", docs), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(formats.tables()))
    one = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Formats.of(pickle.loads(shared.value))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in (part for whole in batches for part in pieces(whole, place)):
            out = []
            for t in batch.column(place).to_pylist():
                spans = base_spans(t or "")
                more = [(s, e, "format") for s, e in runs(t or "", spans) if known.accepts(t[s:e])]
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted(spans + more, key=lambda x: (x[0], KINDS.index(x[2])))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(one))]))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, by pattern and by inferred format."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, fit_formats(docs)).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "format")), 256).alias("base_sha256"),
                        joined("secrets").alias("spans"))
