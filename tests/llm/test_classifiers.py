import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import cotraining, linear, toxicity_chain
from riskloom.llm.common import table
from tests.llm.cases import FOLDER, ODD, documents, empty

LARGE = FOLDER.replace("sf0.001", "sf0.1")


def counts(scored, labels, label):
    rows = scored.select("doc_id", "kept").join(labels, "doc_id").groupBy(label, "kept").agg(F.count("*").alias("n")).collect()
    return {(r[label], r.kept): r.n for r in rows}


@pytest.fixture(scope="module")
def labelled(spark):
    labels = table(spark, LARGE, "labels")
    docs = table(spark, LARGE, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").where("doc_id < 8000")
    return docs, labels


def test_chain_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    setting = toxicity_chain.ChainSetting()
    sample = toxicity_chain.categories_of(labels.where("doc_id % 2 = 0"), docs, setting)
    chain = toxicity_chain.train(sample, setting=setting)
    assert [len(m.weights) for m in chain.models] == [len(chain.dictionary) + k + 1 for k in range(3)]
    scored = toxicity_chain.score(docs.where("doc_id % 2 = 1"), chain).withColumn("kept", ~F.col("toxic"))
    plain = docs.where(F.lower("text").rlike("|".join(toxicity_chain.INSULTS))).select("doc_id")  # no other sign there
    marked = labels.join(plain.withColumn("plain", F.lit(1)), "doc_id", "left").where("toxic = 0 OR plain = 1")
    seen = counts(scored, marked, "toxic")
    assert seen.get((0, False), 0) <= 0.005 * seen[0, True] and seen.get((1, True), 0) <= 0.1 * seen[1, False]
    odd = toxicity_chain.score(documents(spark, ODD), chain).orderBy("doc_id").collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd[:3])
    assert toxicity_chain.score(empty(spark), chain).count() == 0


def test_chain_without_labels(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    chain = toxicity_chain.train(toxicity_chain.categories_of(none, docs, toxicity_chain.ChainSetting()))
    rows = toxicity_chain.score(docs, chain).collect()
    assert len(rows) == len(ODD) and all(r.p_toxic == 0.5 for r in rows)


def test_cotraining_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    good = labels.select("doc_id", F.col("quality").alias("good"))
    model = cotraining.train(docs, good.where("doc_id % 2 = 0"))
    seen = counts(cotraining.score(docs.where("doc_id % 2 = 1"), model), good, "good")
    assert seen.get((1, False), 0) <= 0.005 * seen[1, True] and seen.get((0, True), 0) <= 0.1 * seen[0, False]
    odd = cotraining.score(documents(spark, ODD).withColumn("source", F.lit(None).cast("string")), model)
    assert odd.count() == len(ODD) and cotraining.score(empty(spark), model).count() == 0


def test_cotraining_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, good int")
    docs = documents(spark, ODD)
    assert all(r.kept for r in cotraining.score(docs, cotraining.train(docs, none)).collect())


def test_views_teach_each_other():
    """The second view alone can't know feature 1; the first one's pseudo-labels show it."""
    draw = np.random.default_rng(2)
    n = 600
    truth = draw.integers(0, 2, n)
    first = [[int(t)] for t in truth]
    y = np.where(np.arange(n) < 100, truth, np.nan).astype(float)
    second = [[int(t)] if i < 100 else [2 + int(t)] for i, t in enumerate(truth)]
    model = cotraining.Model(["=a", "=b"], ["c", "d", "e", "f"])
    model.fit(np.arange(n), [linear.Rows(first), linear.Rows(second)], y, cotraining.CoTrainingSetting(sure=0.9))
    weights = model.views[1].weights
    assert weights[3] - weights[2] > 0.5


def test_logistic_against_closed_form():
    """One 0/1 feature: the weights are the log odds."""
    rows = linear.Rows([[0]] * 40 + [[]] * 60)
    y = np.array([1.0] * 30 + [0.0] * 10 + [1.0] * 15 + [0.0] * 45)
    fitted = linear.Logistic(1, 0).fit(rows, np.zeros((100, 0)), y, np.ones(100), ridge=1e-9)
    assert np.allclose(fitted.weights, [np.log(3) + np.log(3), -np.log(3)], atol=1e-2)
