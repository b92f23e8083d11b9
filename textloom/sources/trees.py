"""Syntax trees as rows: one row for each node of a Python source, from the standard library's parser.

The parser is the only step that is not relational; what is asked of trees is asked of the rows (``operators.syntax``).
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple, get_args

import pyarrow as pa
from pyspark.sql import DataFrame

REGIONS = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
#: node and parent are numbered in source order, so a subtree is a run of numbers; ``regions`` are the regions around a
#: node, itself included, outermost first; ``above`` the kinds from its region down to its parent; ``scope`` the names of the
#: regions, dotted.
SCHEMA = (
    "path string, node long, parent long, field string, ordinal long, kind string, ctx string, name string, start long, end long, line long, end_line long, "
    "owner long, regions array<long>, above array<string>, scope string, text string"
)
#: Longer expressions have no text of their own.
MOST_TEXT = 200
#: Rows of a batch, about: one for each text would cost more than its rows.
BATCH_ROWS = 4096


class _Facts(NamedTuple):
    """What a class of nodes has, looked up once for each."""

    kind: str
    fields: tuple[str, ...]  # those that can hold nodes with rows
    names: tuple[str, ...]
    placed: bool
    ctx: bool
    region: bool
    named: bool
    text: bool


#: What has no row, besides values.
_ROWLESS = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)


def _holds(annotated) -> bool:
    """Whether a field of a type (``ast.expr``, ``list[ast.stmt]``, ``ast.expr | None``) can hold nodes with rows."""
    inner = get_args(annotated)
    return any(map(_holds, inner)) if inner else isinstance(annotated, type) and issubclass(annotated, ast.AST) and not issubclass(annotated, _ROWLESS)


@lru_cache(None)
def _facts(kind: type) -> _Facts | None:
    """None for what has no row: values, operators and contexts."""
    if not issubclass(kind, ast.AST) or issubclass(kind, _ROWLESS):
        return None
    named = issubclass(kind, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
    names = tuple(f for f in ("name", "id", "arg", "attr") if f in kind._fields)
    types = getattr(kind, "_field_types", {})
    fields = tuple(f for f in kind._fields if f not in types or _holds(types[f]))
    return _Facts(kind.__name__, fields, names, "lineno" in kind._attributes, "ctx" in kind._fields, issubclass(kind, REGIONS), named, issubclass(kind, ast.expr))


def _name(node: ast.AST, facts: _Facts | None = None) -> str | None:
    facts = facts or _facts(type(node))
    for attribute in facts.names:
        found = getattr(node, attribute)
        if isinstance(found, str):
            return found
    if facts.kind == "ImportFrom":
        return "." * node.level + (node.module or "")
    return repr(node.value) if facts.kind == "Constant" else None


def parsed(text: str) -> ast.Module | None:
    """None where it does not parse."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def tree(text: str) -> list[tuple]:
    """The rows of one source, without its path; none where it does not parse."""
    root = parsed(text)
    if root is None:
        return []
    source = text.encode()
    plain = text.isascii()
    begins = [0]
    for line in source.splitlines(keepends=True):
        begins.append(begins[-1] + len(line))
    rows: list[tuple] = []
    stack: list[tuple] = [(root, _facts(type(root)), None, "", 0, None, (), (), "")]
    while stack:
        node, facts, parent, field, ordinal, over, regions, above, scope = stack.pop()
        kind, fields, names, placed, ctx, region, named, text_ = facts
        k = len(rows)
        if placed:
            line, last = node.lineno, node.end_lineno
            start, end = begins[line - 1] + node.col_offset, begins[last - 1] + node.end_col_offset
        elif over is None:
            start, end, line, last = 0, len(source), 1, len(begins) - 1
        else:
            start, line = rows[over][7], rows[over][9]
            end, last = start, line
        # an ``if`` that continues another as ``elif`` is an Elif
        if kind == "If" and field == "orelse" and parent == "If" and source[start : start + 4] == b"elif":
            kind = "Elif"
        name = _name(node, facts)
        if region:
            regions, above = (*regions, k), ()
            own = name if named else f"<{line}>" if kind == "Lambda" else ""
            scope = f"{scope}.{own}" if scope else own
        body = None
        if text_ and end - start <= MOST_TEXT:
            body = text[start:end] if plain else source[start:end].decode()
        rows.append((k, over, field, ordinal, kind, type(node.ctx).__name__ if ctx else None, name, start, end, line, last, regions[-1], regions, above, scope, body))
        if not fields:
            continue
        inner, parent, children = (*above, kind), facts.kind, []
        for f in fields:
            value = getattr(node, f)
            if type(value) is list:
                for j, child in enumerate(value):
                    of = _facts(type(child))
                    if of is not None:
                        children.append((child, of, parent, f, j, k, regions, inner, scope))
            elif value is not None:
                of = _facts(type(value))
                if of is not None:
                    children.append((value, of, parent, f, 0, k, regions, inner, scope))
        children.reverse()
        stack += children
    return rows


def told(files: DataFrame, tell: Callable[..., Iterable[tuple]], schema: str, columns: tuple[str, ...] = ("path", "text")) -> DataFrame:
    """The rows that ``tell`` gives of ``columns`` of each Python source in ``files``, told where the texts are: no tree leaves its task."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda rows: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        rows: list[tuple] = []
        gc.disable()  # trees and rows hold no cycles, and looking for some takes as long as making them
        try:
            for batch in batches:
                for given in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    rows += tell(*given)
                    if len(rows) >= BATCH_ROWS:
                        yield of(rows)
                        rows = []
            if rows:
                yield of(rows)
        finally:
            gc.enable()

    return files.where("lang = 'python'").select(*columns).mapInArrow(run, schema)


def nodes(files: DataFrame) -> DataFrame:
    """A row for each node of the Python sources in ``files`` (path, lang, text), parsed where the texts are."""
    return told(files, lambda path, text: [(path, *r) for r in tree(text or "")], SCHEMA)


def provenance(files: DataFrame) -> DataFrame:
    """path and status (complete, partial, unsupported) of each file, told where its text is."""
    names = ["path", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
            status = ["unsupported" if lang != "python" else "complete" if parsed(text or "") else "partial" for lang, text in rows]
            yield pa.record_batch([batch.column("path"), pa.array(status, pa.string())], names)

    return files.select("path", "lang", "text").mapInArrow(run, "path string, status string")
