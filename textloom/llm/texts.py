"""Running a kernel over the texts of a table, slice by slice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm import kernels


def named(name: str) -> Column:
    """A column by its exact name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(docs: DataFrame, kernel: Callable[..., list], fields: str, carry: list[str] | None = None, text: str = "text", also: list[Column] | None = None, most: int = kernels.SLICE_BYTES) -> DataFrame:
    """For each row: ``row``, a struct of the columns of ``carry`` (all by default), and the ``fields`` (a DDL string)
    that ``kernel`` makes of bytes, row offsets and Arrow arrays of the columns ``also``: a list of arrays, one value a
    row. A null text is an empty one; a kernel gets rows of ``most`` bytes of text together, or one longer row.
    Names never clash, as a row's own columns stay inside the struct."""
    carry = docs.columns if carry is None else carry
    made = T.StructType.fromDDL(fields)
    rows = docs.select(F.struct(*[named(c) for c in carry]).alias("row"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"), *[c.alias(f"also{k}") for k, c in enumerate(also or [])])
    types = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.buffers(batch.column("text"))
            row = batch.column("row")
            for low, high in kernels.slices(offsets, most):
                at = offsets[low : high + 1]
                out = kernel(data[at[0] : at[-1]], at - at[0], *[c.slice(low, high - low) for c in batch.columns[2:]])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)]
                yield pa.record_batch([row.slice(low, high - low), *arrays], names=["row", *made.names])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *made]))
