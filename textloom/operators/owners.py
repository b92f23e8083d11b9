"""Graphs of many owners (functions, sessions), given as tables with a column ``owner``.

An owner whose rows fit in one task is walked there, so all of them take one shuffle by owner, however many steps their
walks have. Owners with more than ``graphs.SMALL`` rows are told apart first and go by rounds of joins, which no task holds.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators import graphs
from textloom.sources.shared import kept


def walked(tables: dict[str, DataFrame], fields: dict[str, T.DataType], walk: Callable[..., Iterable[tuple]], rounds: Callable[..., DataFrame]) -> DataFrame:
    """owner and ``fields``: what ``rounds`` gives of the tables. ``walk`` gives these rows without the owner, for one owner, from
    each table's rows as lists of dicts; rows without an owner are left out."""
    tables = {k: kept(df.where("owner IS NOT NULL")) for k, df in tables.items()}
    sizes = reduce(DataFrame.unionByName, [df.select("owner") for df in tables.values()]).groupBy("owner").count()
    large = kept(sizes.where(F.col("count") > graphs.SMALL).select("owner"))
    if large.isEmpty():
        return _in_tasks(tables, fields, walk)
    small = _in_tasks({k: df.join(large, "owner", "left_anti") for k, df in tables.items()}, fields, walk)
    rest = rounds(**{k: df.join(large, "owner", "left_semi") for k, df in tables.items()})
    return small.unionByName(rest.select("owner", *fields))


def _in_tasks(tables: dict[str, DataFrame], fields: dict[str, T.DataType], walk: Callable[..., Iterable[tuple]]) -> DataFrame:
    owner = next(iter(tables.values())).schema["owner"]
    out = T.StructType([T.StructField("owner", owner.dataType), *(T.StructField(k, v) for k, v in fields.items())])
    schema, names = to_arrow_schema(out), list(tables)
    rows = [df.select("owner", F.lit(n).alias("table"), F.struct(*[c for c in df.columns if c != "owner"]).alias(k)) for n, (k, df) in enumerate(tables.items())]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        rows = (x for batch in batches for x in batch.to_pylist())
        for owner, group in itertools.groupby(rows, itemgetter("owner")):
            held: dict[str, list[dict]] = {k: [] for k in names}
            for x in group:
                held[names[x["table"]]].append(x[names[x["table"]]])
            found += [(owner, *row) for row in walk(**held)]
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if found:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return every.repartition("owner").sortWithinPartitions("owner").mapInArrow(run, out)
