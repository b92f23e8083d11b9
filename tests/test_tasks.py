"""What is told of texts by odd spaces and no words, and how work is dealt over tasks."""

from pyspark.sql import functions as F

from textloom.plans import catalogue
from textloom.sources import programs


def test_calibration_features_of_odd_spaces_and_of_no_words(spark, tmp_path):
    import duckdb

    texts = ["a\n \nb", "　\nx", "", " \n", None, "a b a b", "\t\n\r\n", "..."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["text_calibration_features"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLES["text_calibration_features"]).fetchall())
    assert got[:4] == [(0, 2, 1.0), (1, 1, 0.0), (2, 0, 0.0), (3, 0, 0.0)] and got[4] == (4, None, 0.0)


def test_programs_are_made_by_as_many_tasks_as_there_are_cores(spark):
    made = programs.programs(spark.range(400).unionByName(spark.range(10)), "id")
    assert made.count() == 400
    assert made.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism


def test_references_are_resolved_once_for_all_kinds_of_edges(spark):
    from textloom.operators import syntax
    from textloom.sources import trees

    nodes = trees.nodes(programs.programs(spark.range(40), "id"))
    edges = syntax.system_edges(nodes)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6
    # what resolves to nothing is a gap, once for each call
    calls = nodes.where("kind = 'Call'").join(nodes.where("field = 'func' AND text IS NOT NULL").select("path", F.col("parent").alias("node")), ["path", "node"]).count()
    assert edges.where("kind IN ('call', 'gap')").select("path", "call").distinct().count() == calls


def test_functions_are_told_where_their_texts_are(spark):
    for name in ("control_regions", "control_facts", "program_points"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan, name


def test_whether_a_file_parses_is_told_without_its_nodes(spark):
    from textloom.sources import trees

    files = spark.createDataFrame([("a.py", "python", "x = 1\n"), ("b.py", "python", "def f(:"), ("c.py", "python", None), ("d.rs", "rust", "fn f() {}"), ("a.py", "python", "y = 2")], "path string, lang string, text string")
    out = trees.provenance(files)
    assert sorted(map(tuple, out.collect())) == [("a.py", "complete"), ("a.py", "complete"), ("b.py", "partial"), ("c.py", "complete"), ("d.rs", "unsupported")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_pairs_are_counted_by_as_many_tasks_as_lines_ask_for(spark, monkeypatch):
    from textloom.plans import duplicate_plans

    rows = sorted(map(tuple, catalogue.QUERIES["co_change_jaccard"](spark, "/root/testdata/sf0.001").collect()))
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(duplicate_plans, "TASK_LINES", 100)
    out = catalogue.QUERIES["co_change_jaccard"](spark, "/root/testdata/sf0.001")
    dealt = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
    assert len(dealt) >= 2 and all(str(-(-lines // 100)) in x for x in dealt)
    assert sorted(map(tuple, out.collect())) == rows and rows
