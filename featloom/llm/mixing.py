"""Mixing by soft membership: document rates that bring expected domain totals to target weights.

A naive-Bayes classifier, fitted on a labelled table, gives each document the probabilities of the domains.
Rates are then the nonnegative weighted least-squares fit of expected totals ``sum(rate * tokens * probability)`` to the
targets, by projected gradient steps from a rate of 1: the totals of a step are one small aggregate
over all documents, and the next rates are an expression of those totals, so no table of rates is kept.

Everything on documents is built from DataFrame functions; the driver sees counts of the classifier's fixed number
of features and a total for each domain and step.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import rewritten

# Labelled documents that a fit uses at most: those whose ids have the smallest hashes.
MAX_LABELLED = 10_000
# Words whose presence the classifier looks at.
VOCABULARY = 200
# Steps of the rate fit; it ends earlier when all totals are met.
STEPS = 40
TOLERANCE = 1e-3

#: Shape of a text as whole numbers of at most 8 levels each.
LEVELS = {
    "symbols": "least(7, int(50 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)))",
    "capitals": "least(7, int(16 * length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) / greatest(length(text), 1)))",
    "variety": "least(7, int(8 * size(array_distinct(words)) / greatest(size(words), 1)))",
    "length": "least(7, int(log10(1 + size(words)) * 1.7))",
}


def _features(docs: DataFrame, text: str, keep: Sequence[Column]) -> DataFrame:
    """``keep`` and, for each text, its ``words`` (lower-case runs of letters), ``tokens`` and levels."""
    source = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    source = source.withColumn("words", F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != ""))
    return source.withColumns({
        "tokens": F.regexp_count("text", F.lit("[^ \\t-\\r]+")).cast("long"),
        **{f"level_{name}": F.expr(sql) for name, sql in LEVELS.items()}})


@dataclass(frozen=True)
class DomainClassifier:
    """Log probabilities of domains; ``posteriors`` gives a Column for each domain."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    words: dict[str, tuple[float, ...]]  # log odds of presence against absence
    absent: tuple[float, ...]  # what no word at all adds
    levels: dict[str, tuple[tuple[float, ...], ...]]  # by level, then domain

    def scores(self) -> Column:
        """Array of log scores over the columns of ``_features``."""
        if not self.domains:
            return F.array().cast("array<double>")
        base = F.array(*(F.lit(p + a) for p, a in zip(self.prior, self.absent)))
        for name, table in self.levels.items():
            levels = F.array(*(F.array(*map(F.lit, row)) for row in table))
            base = F.zip_with(base, F.get(levels, F.col(f"level_{name}")), lambda x, y: x + y)
        if not self.words:
            return base
        known = F.array(*map(F.lit, self.words))
        odds = F.map_from_arrays(known, F.array(*(F.array(*map(F.lit, row)) for row in self.words.values())))
        return F.aggregate(F.array_intersect("words", known), base,
                           lambda total, w: F.zip_with(total, odds[w], lambda x, y: x + y))


def fit_domains(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", domain: str = "domain",
                max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> DomainClassifier:
    """Fit on the documents named in ``labelled`` (``doc_id``, ``domain``), at most ``max_labelled`` of them.

    Null ids and domains are left out; an id with several domains takes the smallest. Where no label meets a document there are no domains.
    """
    known = (labelled.where(F.col(domain).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("key"))
             .agg(F.min(domain).alias("domain")).orderBy(F.xxhash64("key"), "key").limit(max_labelled))
    texts = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    marked = texts.join(F.broadcast(known), "key")
    rows = rewritten(_features(marked, "text", [F.col("domain")]).select(
        "domain", F.array_distinct("words").alias("words"), *(f"level_{n}" for n in LEVELS)), "domains")
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = tuple(sorted(sizes))
    total = sum(sizes.values())
    if not domains:
        return DomainClassifier((), (), {}, (), {})

    per_domain = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    seen = rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*per_domain)
    # How far the presence of a word is from independence of the domain.
    everywhere = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    chi = sum((F.pow(F.col(f"n{i}") - everywhere * (sizes[d] / total), 2) / (everywhere * (sizes[d] / total)) for i, d in enumerate(domains)), F.lit(0.0))
    chosen = seen.where(everywhere >= 5).orderBy(chi.desc(), "word").limit(vocabulary).collect()

    def chance(n: int, d: str, kinds: int) -> float:
        return (n + 1) / (sizes[d] + kinds)

    words, absent = {}, [0.0] * len(domains)
    for row in chosen:
        chances = [chance(row[f"n{i}"], d, 2) for i, d in enumerate(domains)]
        words[row.word] = tuple(math.log(c / (1 - c)) for c in chances)
        absent = [a + math.log(1 - c) for a, c in zip(absent, chances)]
    levels = {}
    for name in LEVELS:
        found = {r[0]: r for r in rows.groupBy(f"level_{name}").agg(*per_domain).collect()}
        levels[name] = tuple(tuple(math.log(chance(found[k][f"n{i}"] if k in found else 0, d, 8)) for i, d in enumerate(domains)) for k in range(8))
    return DomainClassifier(domains, tuple(math.log(sizes[d] / total) for d in domains), words, tuple(absent), levels)


def with_posteriors(docs: DataFrame, classifier: DomainClassifier, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, with ``tokens`` (words between blanks) and ``posterior``, an array by domain."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = _features(packed.select("doc", F.col("doc").getField(text).alias("text")), "text", [F.col("doc")])
    scored = rows.select("doc", "tokens", classifier.scores().alias("scores"))
    shifted = scored.withColumn("top", F.array_max("scores"))
    powers = shifted.withColumn("powers", F.transform("scores", lambda s: F.exp(s - F.col("top"))))
    powers = powers.withColumn("whole", F.aggregate("powers", F.lit(0.0), lambda a, x: a + x))
    return powers.select("doc", "tokens", F.transform("powers", lambda p: p / F.col("whole")).alias("posterior"))


@dataclass(frozen=True)
class Mixture:
    """Steps of a rate fit and what they reached, by domain."""

    domains: tuple[str, ...]
    steps: tuple[tuple[float, ...], ...]
    available: tuple[float, ...]
    targets: tuple[float, ...]
    reached: tuple[float, ...]

    def rate(self) -> Column:
        return _rate(self.steps, len(self.domains))


def _rate(steps: Sequence[Sequence[float]], n: int) -> Column:
    """The rate after gradient steps, each kept at 0 or above, as an expression of ``posterior``."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate + sum((F.col("posterior")[k] * step[k] for k in range(n)), F.lit(0.0)))
    return rate


def fit_rates(rows: DataFrame, domains: Sequence[str], weights: Mapping[str, float], budget: float | None = None,
              steps: int = STEPS, tolerance: float = TOLERANCE) -> Mixture:
    """Rates for rows of ``tokens`` and ``posterior`` so that domain totals are ``weights`` of ``budget`` tokens.

    The budget is all tokens by default. The fit minimises the squared differences of totals and targets, each
    divided by what its domain holds in documents whose rate is not zero yet; no domain's row of the Hessian sums to more,
    so a full gradient step is safe. A domain without any
    tokens cannot be raised; its target stays unmet. Without domains all rates are 1. ``rows`` is read once a step, so it should be stored.
    """
    n = len(domains)
    if not n:
        return Mixture((), (), (), (), ())

    def totals(rate: Column) -> tuple[list[float], list[float]]:
        held = rows.select("tokens", "posterior", rate.alias("rate"))
        mass = [F.col("tokens") * F.col("posterior")[k] for k in range(n)]
        sums = held.agg(*(F.sum(m * F.col("rate")) for m in mass), *(F.sum(F.when(F.col("rate") > 0, m)) for m in mass)).first()
        sums = [round(x or 0.0, 3) for x in sums]
        return sums[:n], sums[n:]

    available, active = totals(F.lit(1.0))
    budget = sum(available) if budget is None else budget
    share = sum(weights.get(d, 0.0) for d in domains) or 1.0
    targets = [weights.get(d, 0.0) / share * budget for d in domains]
    history: list[list[float]] = []
    reached, misses = available, []
    for _ in range(steps):
        misses.append(max((abs(t - x) for t, x in zip(targets, reached)), default=0.0))
        # met, or out of reach: five steps have not brought it a tenth nearer
        if misses[-1] <= tolerance * max(budget, 1.0) or len(misses) > 5 and misses[-1] > 0.9 * misses[-6]:
            break
        history.append([(t - x) / a if a else 0.0 for t, x, a in zip(targets, reached, active)])
        reached, left = totals(_rate(history, n))
        # where no document is left above zero, all may come back
        active = [a or b for a, b in zip(left, available)]
    return Mixture(tuple(domains), tuple(map(tuple, history)), tuple(available), tuple(targets), tuple(reached))


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], budget: float | None = None,
          text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] | None = None) -> tuple[DataFrame, Mixture]:
    """Rows of ``docs`` (struct ``doc``, of the columns ``keep`` or all) with ``tokens``, ``posterior``, ``rate`` and ``copies``; and the mixture.

    ``copies`` is the rate rounded down or up, up with the probability of its fraction by a hash of id and text, so
    it does not depend on partitioning. A null text has no tokens, and its rate follows from the priors. Repeated
    rows are judged alike. An empty table gives no rows.
    """
    if not docs.limit(1).count():
        return (docs.select(F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("doc"), F.lit(0).cast("long").alias("tokens"),
                            F.array().cast("array<double>").alias("posterior"), F.lit(0.0).alias("rate"), F.lit(0).alias("copies")),
                Mixture((), (), (), (), ()))
    classifier = fit_domains(docs, labelled, text, doc_id)
    chance = F.pmod(F.xxhash64(F.col("doc").getField(doc_id), F.col("doc").getField(text), F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    kept = F.struct(*(F.col("doc").getField(c).alias(c) for c in (docs.columns if keep is None else keep)))
    # Texts are classified once: what later steps need is stored, the documents with it.
    rows = rewritten(with_posteriors(docs, classifier, text).select(kept.alias("doc"), "tokens", "posterior", chance.alias("chance")), "posteriors")
    mixture = fit_rates(rows, classifier.domains, weights, budget)
    rated = rows.withColumn("rate", mixture.rate())
    copies = (F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.withColumn("copies", copies).drop("chance"), mixture


def mixture_of(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies``."""
    rated, _ = mixed(docs, labelled, weights, **options)
    return rated.where("copies > 0").select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select("doc.*")


#: Domains of the ``labels`` table, and what each shall have of all tokens.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'good' END"
WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for a mixture of 90 % good, 8 % low-quality and 2 % toxic tokens."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr(DOMAIN).alias("domain"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rated, mixture = mixed(docs, labels, WEIGHTS, keep=["doc_id"])
    return rated.select("doc.doc_id", "tokens", *(F.round(F.col("posterior")[k], 6).alias(f"p_{d}") for k, d in enumerate(mixture.domains)),
                        F.round("rate", 4).alias("rate"), "copies")
