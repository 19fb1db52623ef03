"""Quality rules: an ordered list of threshold conjunctions, learned from labelled text statistics.

Sequential covering: a rule grows term by term by the gain in information over the documents that earlier
rules leave, is pruned on documents held out from growing, and stays only if it is precise on those. The
result is a CASE expression over statistics of one text, so applying it needs no shuffle, and everything
here is built from DataFrame functions: learning asks Spark for counts per (statistic, interval, label) and
compares those few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import rewritten

# Labelled documents that a fit uses at most: those whose ids have the smallest hashes.
MAX_LABELLED = 20_000
# Thresholds of a statistic: this many quantiles of either class with its ends, and the middles between them.
QUANTILES = 24
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"

#: Statistics that rules may use, as SQL over the columns of :func:`text_statistics`.
FEATURES = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "double(n_words)",
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_shouts")


def _covered(starts: Column) -> Column:
    """Positions that windows of three cover, from their sorted starts."""
    end = F.aggregate(
        starts, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, s: F.struct((s + 3).alias("upto"), (a["n"] + s + 3 - F.greatest(a["upto"], s)).alias("n")))
    return end["n"]


def text_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``STATISTICS`` of each text, as longs, next to the columns ``keep`` (all of ``docs`` by default).

    Words are runs of characters other than space and the controls 9 to 13; windows are compared by 64-bit
    hashes. A null text counts as empty: all its statistics are 0. ``docs`` must not have columns named like
    the statistics; see :func:`with_verdict` for tables that may.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.ltrim(F.translate(x, BLANKS[1:], "")) != "")
    step = docs.select(*kept, whole.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    # Each array becomes a column before lambdas read it: inside a lambda it would be built anew for every element.
    step = step.withColumn("__hashes", F.transform(
        F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))))
    step = step.withColumn("__some", F.size(F.array_distinct("__hashes")) < F.size("__hashes"))
    step = step.withColumn("__pairs", F.when(F.col("__some"), F.sort_array(
        F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def same(pair: Column, other: Column) -> Column:
        return F.coalesce(pair["h"] == other["h"], F.lit(False))

    twice = F.filter("__pairs", lambda p, k: same(p, F.get("__pairs", k - 1)) | same(p, F.get("__pairs", k + 1)))
    starts = F.sort_array(F.transform(twice, lambda p: p["i"]))

    def without(characters: str) -> Column:
        return F.length(F.translate("__text", characters, ""))

    n = F.length("__text")
    values = {
        "n_words": F.size("__words"), "word_chars": without(BLANKS), "n_symbols": n - without(SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.col("__some"), _covered(starts)).otherwise(0),
        "n_lines": F.size("__lines"), "n_distinct_words": F.size(F.array_distinct("__words")),
        "n_capitals": F.length(F.regexp_replace("__text", "[^\\p{Lu}]+", "")), "n_shouts": n - without("!")}
    return step.select(*kept, *(values[name].cast("long").alias(name) for name in STATISTICS))


def base_failed() -> Column:
    """The fixed rule before all learned ones: too short, or mostly repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    caught: int = 0  # rejected rows of the held-out part
    wrong: int = 0  # good ones among them

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.terms)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def sql(self) -> str:
        """Number of the first rule that holds, from 1; 0 if none does."""
        return f"CASE {' '.join(f'WHEN {r.sql()} THEN {i}' for i, r in enumerate(self.rules, 1))} ELSE 0 END" if self.rules else "0"

    def fired(self) -> Column:
        return F.expr(self.sql()).cast("int")


def learn_rules(stats: DataFrame, bad: str = "bad", key: str = "key", max_rules: int = 12, max_terms: int = 4,
                min_precision: float = 0.97, min_caught: int = 5) -> DecisionList:
    """A decision list that tells rows with ``bad`` = 1 from those with 0.

    ``stats`` has ``STATISTICS``, ``bad`` and a bigint ``key`` that deals rows to the growing part (two of
    three) and the held-out part. Rows with a null label are left out. Without a row of either class the list is empty.
    """
    names = list(FEATURES)
    rows = stats.where(F.col(bad).isNotNull()).select(
        F.col(bad).cast("int").alias("bad"), (F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(3)) == 0).alias("held"),
        *(F.expr(sql).alias(name) for name, sql in FEATURES.items()))
    rows = rewritten(rows, "rules")
    quantiles = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(c, quantiles, 1000).alias(c) for c in names)).collect()
    if len(found) < 2:
        return DecisionList()
    cuts = {}
    for c in names:
        ends = sorted({x for row in found for x in row[c]})
        cuts[c] = sorted({*ends, *((a + b) / 2 for a, b in zip(ends, ends[1:]))})
    # A value as the number of thresholds it reaches.
    binned = rewritten(rows.select("bad", "held", F.array(*(
        F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda t: t <= value)) for c, value in ((c, F.col(c)) for c in names))).alias("at")), "rules")

    def holds(terms: Sequence[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for c, at_least, k in terms:
            out = out & ((F.col("at")[c] >= k) if at_least else (F.col("at")[c] < k))
        return out

    rules, earlier = [], F.lit(False)
    while len(rules) < max_rules:
        left = binned.where(~earlier)
        terms = _grow(left.where(~F.col("held")), holds, [len(cuts[c]) for c in names], max_terms)
        prefixes = [terms[:k] for k in range(1, len(terms) + 1)]
        if not prefixes:
            break
        counts = left.where("held").agg(*(F.struct(
            F.coalesce(F.sum(F.when(holds(p), F.col("bad"))), F.lit(0)).alias("caught"),
            F.coalesce(F.sum(F.when(holds(p), 1 - F.col("bad"))), F.lit(0)).alias("wrong")) for p in prefixes)).first()
        best = max(range(len(prefixes)), key=lambda k: ((counts[k].caught - counts[k].wrong) / max(1, counts[k].caught + counts[k].wrong), -k))
        caught, wrong = counts[best]
        if caught < min_caught or caught < min_precision * (caught + wrong):
            break
        rules.append(Rule(tuple(Term(names[c], up, cuts[names[c]][k - 1]) for c, up, k in prefixes[best]), caught, wrong))
        earlier = earlier | holds(prefixes[best])
    return DecisionList(rules)


def _grow(rows: DataFrame, holds, sizes: Sequence[int], max_terms: int) -> list[tuple[int, bool, int]]:
    """Terms of one rule, each the best by information gain on the rows that meet those before."""
    terms: list[tuple[int, bool, int]] = []
    while len(terms) < max_terms:
        counts = (rows.where(holds(terms)).select("bad", F.posexplode("at").alias("c", "k")).groupBy("c", "k")
                  .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
        table = [[[0, 0] for _ in range(size + 1)] for size in sizes]
        for row in counts:
            table[row.c][row.k] = [row.p, row.n]
        all_p, all_n = (sum(x[i] for x in table[0]) for i in (0, 1))
        if not all_p or not all_n:
            break
        best, gain = None, 1e-9
        for c, bins in enumerate(table):
            below = [0, 0]
            for k in range(1, len(bins)):
                below = [below[0] + bins[k - 1][0], below[1] + bins[k - 1][1]]
                for up, (p, n) in ((True, (all_p - below[0], all_n - below[1])), (False, below)):
                    if p and (new := p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n)))) > gain:
                        best, gain = (c, up, k), new
        if best is None:
            break
        terms.append(best)
    return terms


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
                max_labelled: int = MAX_LABELLED, **options) -> DecisionList:
    """Learn a list from the documents that ``labels`` marks 1 (good) or 0 (bad).

    At most ``max_labelled`` labelled ids are used, so their table can be broadcast. Null ids and labels are left out; an id
    with several labels takes the smallest.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("key"))
             .agg((1 - F.min(F.col(label).cast("int"))).alias("bad")).orderBy(F.xxhash64("key"), "key").limit(max_labelled))
    texts = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    marked = texts.join(F.broadcast(known), "key")
    stats = rewritten(text_statistics(marked, keep=["key", "bad"]), "statistics")
    return learn_rules(stats.where(~base_failed()), **options)


def with_verdict(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, with statistics, ``base_failed``, ``rule`` (the one that fired, or 0) and ``kept``."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    stats = text_statistics(packed.select("doc", F.col("doc").getField(text).alias("text")), keep=["doc"])
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rules.fired()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned rules keep."""
    judged = with_verdict(docs, fit_quality(docs, labels, **options))
    # The filter reads a column that depends on the partition, or it would move below and split each text many times.
    return judged.withColumn("row", F.monotonically_increasing_id()).where("kept AND row >= 0").select("doc.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict on each document, by rules learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = with_verdict(docs, rules)
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
