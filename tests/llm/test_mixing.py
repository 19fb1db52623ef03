import pytest
from pyspark.sql import functions as F

from featloom.llm import mixing as mx


@pytest.fixture(scope="module")
def corpus(docs_of):
    rows = []
    for k in range(1200):
        words = [f"c{(k * 17 + j * 7) % 97}x" for j in range(40 + k % 60)]
        if k % 4 == 0:
            words = [w if j % 5 else "vile" for j, w in enumerate(words)]
        rows.append((k, " ".join(words)))
    return docs_of(rows)


@pytest.fixture(scope="module")
def labelled(corpus):
    return corpus.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "toxic").otherwise("clean").alias("domain"))


def test_held_out_accuracy_and_totals(corpus, labelled):
    rated, mixture = mx.mixed(corpus, labelled, {"clean": 0.95, "toxic": 0.05})
    assert mixture.domains == ("clean", "toxic")
    budget = sum(mixture.available)
    assert all(abs(t - r) <= 2 * mx.TOLERANCE * budget for t, r in zip(mixture.targets, mixture.reached))
    rows = rated.select("doc.doc_id", "tokens", "posterior", "rate", "copies").collect()
    held = [r for r in rows if r.doc_id % 3]
    right = sum((r.posterior[1] > 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.98 * len(held)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and abs(sum(r.posterior) - 1) < 1e-9 for r in rows)
    assert all(r.copies >= 1 for r in rows if r.doc_id % 4)  # what is wanted more is kept
    toxic = sum(r.tokens * r.copies for r in rows if r.doc_id % 4 == 0) / sum(r.tokens * r.copies for r in rows)
    assert abs(toxic - 0.05) < 0.03
    again = {r.doc_id: r.copies for r in mx.mixed(corpus.repartition(7), labelled, {"clean": 0.95, "toxic": 0.05})[0].select("doc.doc_id", "copies").collect()}
    assert again == {r.doc_id: r.copies for r in rows}


def test_rows_are_repeated_as_often_as_copies(corpus, labelled):
    rated, _ = mx.mixed(corpus, labelled, {"clean": 0.9, "toxic": 0.1}, budget=200_000)
    out = mx.mixture_of(corpus, labelled, {"clean": 0.9, "toxic": 0.1}, budget=200_000)
    assert out.columns == corpus.columns and out.count() == rated.agg(F.sum("copies")).first()[0]


def test_projection_keeps_rates_at_zero(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.0]), (100, [0.5, 0.5]), (100, [0.0, 1.0])], "tokens long, posterior array<double>")
    fit = mx.fit_rates(rows, ["a", "b"], {"a": 1.0, "b": 0.0}, budget=100, steps=200, tolerance=1e-6)
    rates = [r[0] for r in rows.select(fit.rate()).collect()]
    assert min(rates) == 0.0 and abs(fit.reached[0] - 100) < 0.1 and abs(fit.reached[1]) < 0.1


def test_odd_rows(docs_of, labelled):
    rows = [(0, "vile vile"), (0, "vile vile"), (3, None), (None, "c1x"), (6, ""), (9, "c2x " * 5000), (12, "vile")]
    rated, _ = mx.mixed(docs_of(rows), labelled, {"clean": 0.9, "toxic": 0.1})
    out = rated.select("doc.doc_id", "tokens", "rate", "copies").collect()
    assert len(out) == len(rows) and all(r.rate is not None for r in out)
    assert {r.doc_id: r.tokens for r in out} == {0: 2, 3: 0, None: 1, 6: 0, 9: 5000, 12: 1}
    same = [tuple(r) for r in out if r.doc_id == 0]
    assert same[0] == same[1]


def test_empty_tables(spark, docs_of, corpus, labelled):
    assert mx.mixture_of(docs_of([]), labelled, {"clean": 1.0}).count() == 0
    for none in ([], [(-5, "clean"), (None, "clean"), (3, None)]):  # no label meets a document: nothing is known, and nothing changes
        rated, mixture = mx.mixed(corpus, spark.createDataFrame(none, "doc_id long, domain string"), {"clean": 1.0})
        assert mixture.domains == () and {(r.rate, r.copies, len(r.posterior)) for r in rated.collect()} == {(1.0, 1, 0)}


def test_query_covers_all_documents_without_python(spark, sf_dir):
    out = mx.op1_mix_sources(spark, sf_dir)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
