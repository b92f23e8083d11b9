"""The corpus pipeline: five operators in a row, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next one's documents. The last one returns the mix, a row for each document; ``run`` unfolds it to the
training order, a row for each pass over a document.

Cases: null and blank texts are rejected by the first stage, as is what scores low; repeated rows are near copies, of
which one stays; empty tables give an empty result, an empty benchmark changes nothing;
documents' other columns go with them, and those named like a column of the mix are renamed in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import contamination, lines, mixing, neardup, quality
from textloom.llm.storage import saved


#: Near copies share this part of their shingles; op10's own contract has another threshold.
NEAR = (80, 100)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut from the texts; every document stays."""
    return lines.dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.dedup(docs, NEAR)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut; documents that are mostly such passages go."""
    return contamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def _mixed(docs: DataFrame, passes: bool) -> DataFrame:
    """The documents that the mix takes with its columns; a document's own column of such a name gets ``_of_document``
    (once more for each such name that it also has)."""
    mixed = mixing.mix(docs, carry=True, passes=passes).where(F.col("taken") > 0)
    added = ["size", "source_size", "target", "taken", "position", "pass" if passes else "positions"]
    taken = {c.lower() for c in added}
    own = []
    for c in docs.columns:
        name = c
        while name.lower() in taken:
            name += "_of_document"
        taken.add(name.lower())
        own.append(F.col("row").getField(c).alias(name))
    return mixed.select(*own, *added)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, by their first position, with the words taken, their source's target and their
    positions in every pass."""
    return _mixed(docs, passes=False)


def training_order(docs: DataFrame) -> DataFrame:
    """``mixing_stage`` with a row for each pass over a document, at its own position and with the words it gives."""
    return _mixed(docs, passes=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", contamination_stage),
    ("source mixing", mixing_stage),
]

#: The first stage's nearest neighbours in a latent space are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return training_order(docs)
