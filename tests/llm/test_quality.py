import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from textloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables():
    """Clean prose against shouting and tables, with odd rows among them."""
    docs = fixtures.documents()
    labels = []
    for k in range(1000, 1240):
        clean = k % 3 > 0
        text = fixtures.prose(k, 30 + k % 50)
        docs.append((k, text.capitalize() + "." if clean else " | ".join(text.upper().split()), "en", "s", 1))
        labels.append((k, int(clean), 0))
    return docs, labels


def test_votes_match_brute_force():
    draw = np.random.default_rng(1)
    rows = np.abs(draw.standard_normal((60, quality.SIZE))).astype(np.float32)
    votes = quality.Votes(rows, draw.integers(0, 2, 60))
    latent, labelled = votes.latent(rows), votes.vectors.T
    got = votes.scores(rows, block=7)
    for k, x in enumerate(latent):
        cosines = labelled @ x
        near = sorted(range(60), key=lambda j: -cosines[j])[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[near], 0).astype(float) ** 16 + 1e-12
        assert got[k] == pytest.approx((weight * votes.labels[near]).sum() / weight.sum(), rel=1e-3)


def test_held_out_accuracy_and_odd_rows(spark, tables):
    rows, known = tables
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    labels = spark.createDataFrame([*known, *known[:5], (None, 1, 0), (1000, None, 0), (10**9, 0, 0)], LABELS)
    out = quality.score(docs, labels, ["doc_id"])
    scores = out.collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    truth = dict((i, q) for i, q, _ in known)
    judged = [(r.score >= 0.7) == truth[r.row.doc_id] for r in scores if r.row.doc_id in truth and fixtures.held_out(r.row.doc_id)]
    assert len(judged) > 30 and np.mean(judged) > 0.95
    blank = {r.row.doc_id: r.score for r in scores if r.row.doc_id in (16, 17, 18)}
    assert blank == {16: 0, 17: 0, 18: 0}


def test_held_out_labels_change_nothing(spark, tables):
    rows, known = tables
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    turned = [(i, 1 - q if fixtures.held_out(i) else q, t) for i, q, t in known]
    a, b = (quality.score(docs, spark.createDataFrame(x, LABELS), ["doc_id"]).collect() for x in (known, turned))
    assert sorted(map(str, a)) == sorted(map(str, b))
    fold = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    assert all(r.h == fixtures.held_out(r.doc_id) for r in fold.collect())


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 1), (2, None, None, None, None)], fixtures.DOCS)
    none = spark.createDataFrame([], LABELS)
    assert sorted(r.score for r in quality.score(docs, none).collect()) == [0.0, 0.5]
    assert quality.keep(docs.limit(0), none).columns == docs.columns


def test_rows_that_repeat_an_id_teach_once(spark):
    docs = [(k, fixtures.prose(k, 30), "en", "s", 1) for k in range(40)] * 5 + [(0, None, None, None, None)]
    table = spark.createDataFrame(docs, fixtures.DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    votes = quality.fit(table, labels)
    assert len(votes.labels) == sum(not fixtures.held_out(k) for k in range(40))
