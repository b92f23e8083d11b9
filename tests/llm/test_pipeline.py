"""Each stage against its operator's definition on a small corpus with planted cases."""

import importlib

import pytest

from tests.llm import fixtures
from textloom.llm import contamination


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    item = fixtures.prose(9001, 14)
    docs = [(k, fixtures.prose(k, 60 + k % 60).capitalize() + ".\nshared foot line", "en", f"s{k % 20}", 1) for k in range(200)]
    docs += [(k, " | ".join(fixtures.prose(k, 70).upper().split()), "en", f"s{k % 20}", 1) for k in range(200, 260)]
    docs += [(300 + k, docs[0][1] + f" edit{k}", "en", "s1", 1) for k in range(5)]
    docs += [(400, fixtures.prose(77, 80).capitalize() + ". " + item, "en", "s2", 1), (401, item, "en", "s3", 1), (402, None, None, None, None), (403, "", None, None, 0)]
    labels = [(k, int(k < 200), 0) for k in range(0, 260)]
    spark.createDataFrame(docs, fixtures.DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_in_a_row(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        kept.append({r.doc_id: r for r in rows})
        assert len(kept[-1]) == len(rows)
        if k < 4:
            assert docs.columns == columns
    quality, lines, near, clean, mixed = kept
    assert set(range(200)) <= set(quality) and not set(range(200, 260)) & set(quality) and not {402, 403} & set(quality)
    assert set(lines) == set(quality)
    assert sum("shared foot line" in r.text.split("\n") for r in lines.values()) == 1 and lines[0].text.endswith("\nshared foot line")
    assert set(range(200)) <= set(near) and not set(range(300, 305)) & set(near)
    assert 401 not in clean and set(range(200)) <= set(clean)
    assert fixtures.prose(9001, 14) not in clean[400].text
    assert set(mixed) <= set(clean) and all(r.taken > 0 for r in mixed.values())
    assert contamination.scan(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("size(spans) > 0").count() == 0


def test_run_is_the_stages(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    a, b = (sorted((r.doc_id, r.taken) for r in pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and a
    positions = [r.position for r in pipeline.run(spark, folder).collect()]
    assert positions == sorted(positions)


def test_run_unfolds_the_passes(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = {r.doc_id: r for r in pipeline.mixing_stage(spark, docs, folder).collect()}
    rows = pipeline.training_order(docs).collect()
    assert len(rows) > len(stage) and sum(r.taken for r in rows) == sum(r.taken for r in stage.values())
    assert sorted((r.doc_id, r.position) for r in rows) == sorted((i, p) for i, r in stage.items() for p in r.positions)
    assert "pass" in pipeline.run(spark, folder).columns


def test_columns_named_like_the_mix(spark, folder):
    """A document's own columns of such names are kept under another name; the mix's are whole."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 100")
    plain = {r.doc_id: (r.taken, r.positions) for r in pipeline.mixing_stage(spark, docs, folder).collect()}
    odd = docs.selectExpr("*", "doc_id AS position", "'x' AS taken", "1 AS Target", "2 AS size", "3 AS `pass`", "4 AS positions", "5 AS source_size", "6 AS size_of_document")
    rows = pipeline.mixing_stage(spark, odd, folder).collect()
    assert {r.doc_id: (r.taken, r.positions) for r in rows} == plain
    assert all((r.position_of_document, r.taken_of_document, r.Target_of_document) == (r.doc_id, "x", 1) for r in rows)
    assert all((r.size_of_document_of_document if "size_of_document_of_document" in r else None) in (2, 6) for r in rows)
    assert len({c.lower() for c in rows[0].__fields__}) == len(rows[0].__fields__)
    order = pipeline.training_order(odd)
    assert {"pass", "pass_of_document", "positions"} <= set(order.columns) and order.count() == sum(len(p) for _, p in plain.values())
