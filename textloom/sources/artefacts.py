"""Sources other than source code: configuration, linters' reports, coverage, version control, patches, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

# fixed values: configuration of tools, whose keys other programs read
TOOL_CONFIGS = ("Cargo.toml", "Cargo.lock", "package.json", "package-lock.json", "tsconfig.json", "jsconfig.json", "pyproject.toml", "poetry.lock", "Pipfile", "composer.json", "deno.json", "bun.lockb", "Project.toml", "Manifest.toml", "JuliaProject.toml", "rust-toolchain.toml", "rustfmt.toml", "clippy.toml", ".pre-commit-config.yaml", "mkdocs.yml", "codecov.yml", "renovate.json")
LANGUAGES = {"clj": "clojure", "cljs": "clojure", "cljc": "clojure", "edn": "clojure", "jl": "julia", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "rs": "rust"}


def language(path):
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("generic"))


def snapshot(spark: SparkSession, root: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """Files under a folder with their bytes read once: path, lang, text, bytes_len, content_hash, status."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", language(F.col("path")).alias("lang"), F.expr("try_validate_utf8(content)").alias("text"), F.col("length").alias("bytes_len"), F.sha2("content", 256).alias("content_hash"))
    rows = rows.where(~F.col("path").rlike(exclude)) if exclude else rows
    return rows.withColumn("status", F.when(F.col("text").isNull(), "failed").when(F.col("lang") == "generic", "unsupported").otherwise("complete"))


def snapshot_id(files: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """One row: a digest of all paths and digests, whatever their order. Sums of hashes merge, so nothing is gathered."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", F.col(key).cast("string"), digest).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return files.agg(F.sum(h).cast("string").alias("snapshot"), F.count("*").alias("files"))


def overlaid(base: DataFrame, overlay: DataFrame, key: str = "path") -> DataFrame:
    """Files with some replaced by unsaved versions."""
    return base.join(overlay.select(key), key, "left_anti").unionByName(overlay)


def config_keys(files: DataFrame) -> DataFrame:
    """path, line_no, key and normalised key of TOML, YAML and JSON files, line by line."""
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    toml, yaml, json = (F.regexp_extract("line", p, 1) for p in (r"^\s*([A-Za-z0-9_-]+)\s*=", r"^\s*(?:-\s+)?([A-Za-z0-9_.-]+)\s*:", r'"([A-Za-z0-9_.-]+)"\s*:'))
    key = F.when(F.col("path").endswith(".toml"), toml).when(F.col("path").rlike(r"\.ya?ml$"), yaml).otherwise(json)
    return rows.select("path", (F.col("pos") + 1).cast("long").alias("line_no"), key.alias("key")).where("key <> ''").withColumn("nkey", X.normalized_key(F.col("key")))


def config_boundary(keys: DataFrame, uses: DataFrame, least: int = 4) -> DataFrame:
    """nkey, declared, uses, rule: declared keys joined in full with evidence of use (key, kind)."""
    declared = keys.groupBy("nkey").agg(F.count("*").alias("declared"))
    kinds = ("parsed", "echoed", "stored", "live", "shadowed")
    seen = uses.groupBy(X.normalized_key(F.col("key")).alias("nkey")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    z = {c: F.coalesce(c, F.lit(0)) for c in ("declared", *kinds)}
    j = declared.join(seen, "nkey", "full_outer").where(F.length("nkey") >= least).select("nkey", *[z[c].alias(c) for c in z])
    n = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    rule = F.when((F.col("declared") > 0) & (n == 0), "config-key-unread").when(F.col("shadowed") > 0, "config-key-shadowed").when((F.col("parsed") > 0) & (F.col("live") == 0), "config-key-unconsumed")
    return j.select("nkey", "declared", n.alias("uses"), rule.alias("rule"))


def lcov(lines: DataFrame) -> DataFrame:
    """path, line, hits of an LCOV report given as rows (report, pos, value): the last SF carries forward."""
    w = Window.partitionBy("report").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    framed = lines.withColumn("path", F.last(F.nullif(F.regexp_extract("value", "^SF:(.*)$", 1), F.lit("")), True).over(w))
    hit = framed.where(F.col("value").startswith("DA:")).select("path", F.split(F.substring("value", 4, 1000), ",").alias("x"))
    return hit.groupBy("path", F.get("x", 0).cast("long").alias("line")).agg(F.sum(F.get("x", 1).cast("long")).alias("hits"))


def coverage_of(regions: DataFrame, hits: DataFrame) -> DataFrame:
    """path, region, status: covered if every measured line was hit, uncovered if none, unknown if none was measured."""
    j = regions.join(hits, "path", "left").where("line IS NULL OR line BETWEEN start_line AND end_line")
    g = j.groupBy("path", "region").agg(F.count("line").alias("n"), F.count_if(F.col("hits") > 0).alias("hit"))
    return regions.select("path", "region").join(g, ["path", "region"], "left").select("path", "region", F.when(F.coalesce("n", F.lit(0)) == 0, "unknown").when(F.col("hit") == F.col("n"), "covered").when(F.col("hit") == 0, "uncovered").otherwise("partial").alias("status"))


def numstat(lines: DataFrame) -> DataFrame:
    """path, added, deleted, binary of ``added TAB deleted TAB path`` rows; ``-`` is binary and counts 0."""
    p = F.split("value", "\t", 3)
    return lines.select(F.get(p, 2).alias("path"), F.coalesce(F.get(p, 0).try_cast("long"), F.lit(0)).alias("added"), F.coalesce(F.get(p, 1).try_cast("long"), F.lit(0)).alias("deleted"), (F.get(p, 0) == "-").alias("binary"))


#: What linters call their findings, and ours.
# fixed values: rules that linters codes stand for
LINTER_RULES = [("clj-kondo", "unused-binding", "unused-binding"), ("clj-kondo", "unused-private-var", "unused-private-def"), ("clj-kondo", "unused-namespace", "unused-namespace"), ("clippy", "clippy::needless_return", "needless-return"), ("clippy", "clippy::redundant_closure", "redundant-closure"), ("clippy", "clippy::let_and_return", "let-and-return"), ("staticlint", "UnusedFunctionArgument", "unused-arg"), ("staticlint", "UnusedBinding", "unused-binding"), ("staticlint", "MissingReference", "missing-reference"), ("jet", "*", "julia-jet")]
LINTER = "file string, line long, code string, message string"


def linter_findings(reports: DataFrame) -> DataFrame:
    """path, line, rule, message of linters' JSON rows (tool, json); rules of no equivalent are left out."""
    rows = reports.select("tool", F.from_json("json", LINTER).alias("j")).select("tool", "j.*")
    rules = F.broadcast(reports.sparkSession.createDataFrame(LINTER_RULES, "tool string, code string, rule string"))
    exact = rows.join(rules, ["tool", "code"])
    every = rows.join(rules.where("code = '*'").drop("code"), "tool")
    return exact.select("file", "line", "rule", "message").unionByName(every.select("file", "line", "rule", "message")).withColumnRenamed("file", "path")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str = "content_hash") -> DataFrame:
    return wanted.join(cached.select(key).distinct(), key, "left_anti")
