"""What the trees of pages say: their nodes as rows, fragments that sibling elements share, and subtrees that recur.

Trees are built and compared where pages are; no page is shuffled. Null, empty and blank pages have no nodes. Rows that
repeat are pages of their own. ``keys`` are the columns that name a page; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.operators import nesting
from textloom.sources import pages as P
from textloom.sources.shared import kept, spread

#: A subtree of fewer nodes is no clone.
LEAST_NODES = 4


def _mapped(pages: DataFrame, keys: list[str], html: str, ddl: str, *rows: Callable[[P.Trees], tuple[np.ndarray, list]]) -> DataFrame:
    """Keys beside what each of ``rows`` gives: the pages' numbers and the columns of ``ddl``."""
    df = pages.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{html}`").alias("html of page"))
    out = T.StructType([*df.schema.fields[:-1], *T.StructType.fromDDL(ddl).fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, trees in P.slices(batch, "html of page"):
                for page, columns in (f(trees) for f in rows):
                    if not len(page):
                        continue
                    held = [batch.column(k).take(pa.array(low + page)) for k in keys]
                    yield pa.record_batch([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip([*held, *columns], schema, strict=True)], schema=schema)

    return spread(df).mapInArrow(run, out)


def _numbers(trees: P.Trees) -> np.ndarray:
    """Each node's number within its page."""
    first = np.searchsorted(trees.page, trees.page)
    return np.arange(len(trees.page)) - first


def nodes(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """A row for each element and text: ``node`` numbers a page's nodes in the order of their starts from 0, ``parent`` is null for
    roots, ``ordinal`` the place among siblings, ``nodes`` the size of the subtree, and ``start`` to ``stop`` its code points. ``value`` holds the
    attributes of an element as they are written, and a text with its white space made one space each."""

    def rows(t: P.Trees):
        number = _numbers(t)
        parent = pa.array(number[t.parent], mask=t.parent < 0)
        return t.page, [number, parent, t.ordinal, t.depth, t.name, t.value, t.size, t.start, t.stop]

    return _mapped(pages, keys, html, "node long, parent long, ordinal long, depth long, name string, value string, nodes long, start long, stop long", rows)


def _fragments(t: P.Trees, values: bool) -> tuple[np.ndarray, list]:
    held = np.bincount(t.parent[t.parent >= 0], minlength=len(t.page))
    place = np.empty(len(t.order), np.int64)
    place[t.order] = np.arange(len(t.order))
    first = np.zeros(len(t.page), np.int64)
    heads = t.order[t.ordinal[t.order] == 0]
    heads = heads[t.parent[heads] >= 0]
    first[t.parent[heads]] = place[heads]
    # Arms are siblings next to each other, of one name, with something in each.
    here = t.order
    arm = (held[here] > 0) & (t.name[here] != P.TEXT)
    joined = np.zeros(len(here), bool)
    a, b = here[:-1], here[1:]
    joined[1:] = arm[:-1] & arm[1:] & (t.parent[a] == t.parent[b]) & (t.page[a] == t.page[b]) & (t.name[a] == t.name[b])
    right = np.flatnonzero(joined)
    if not len(right):
        return np.zeros(0, np.int64), []
    one, two = here[right - 1], here[right]
    runs = nesting.Runs(t.digests(0, values)[here])
    most = np.minimum(held[one], held[two])
    before = runs.alike(first[one], first[two], most)
    after = runs.alike(first[one] + held[one], first[two] + held[two], most, backwards=True)
    new = np.flatnonzero(np.diff(right, prepend=-2) != 1)
    arms = np.diff(np.append(new, len(right))) + 1
    least = np.minimum(np.minimum.reduceat(held[two], new), held[one[new]])
    longest = np.maximum(np.maximum.reduceat(held[two], new), held[one[new]])
    prefix = np.minimum.reduceat(before, new)
    whole = (prefix == least) & (least == longest)
    suffix = np.where(whole, 0, np.minimum(np.minimum.reduceat(after, new), least - prefix))
    head = one[new]
    mass = np.concatenate((np.zeros(1, np.int64), np.cumsum(t.size[here])))
    number = _numbers(t)
    out = []
    for kind, chosen, parts, start in (
        ("equivalent-arms", whole, prefix, first[head]),
        ("common-prefix", ~whole & (prefix > 0), prefix, first[head]),
        ("common-suffix", suffix > 0, suffix, first[head] + held[head] - suffix),
    ):
        k = np.flatnonzero(chosen)
        at, n = start[k], parts[k]
        out.append((head[k], arms[k], np.full(len(k), kind, object), n, (mass[at + n] - mass[at]) * (arms[k] - 1)))
    head, arms, kind, parts, saved = (np.concatenate(c) for c in zip(*out, strict=True))
    up = t.parent[head]
    return t.page[head], [pa.array(number[up], mask=up < 0), number[head], t.name[head], arms, kind, parts, saved]


def fragments(pages: DataFrame, keys: list[str], html: str = "html", values: bool | None = True) -> DataFrame:
    """What the arms of a page share and could say once. Arms are two or more siblings in a row, elements of one name with
    something inside. Where all hold equal lists of subtrees the kind is ``equivalent-arms``; else ``common-prefix`` and ``common-suffix`` tell
    how many subtrees (``parts``) all begin or end with, the suffix within what the prefix leaves of the shortest. ``first`` is the first arm and
    ``saved`` the nodes that are said again. Common lengths come from hashes of runs of subtrees by halved lengths, between neighbours
    alone, and the least of them holds for all arms, so a list of any length costs no pairs. Without ``values`` subtrees are equal if
    their elements are, whatever attributes and texts they have. None gives both, from trees that are built once, and ``exact`` tells them apart."""
    ddl = "parent long, first long, name string, arms long, kind string, parts long, saved long"
    if values is not None:
        return _mapped(pages, keys, html, ddl, lambda t: _fragments(t, values))

    def told(t: P.Trees, exact: bool) -> tuple[np.ndarray, list]:
        page, columns = _fragments(t, exact)
        return page, [*columns, np.full(len(page), exact)]

    return _mapped(pages, keys, html, f"{ddl}, exact boolean", lambda t: told(t, True), lambda t: told(t, False))


def clones(pages: DataFrame, keys: list[str], html: str = "html", least: int = LEAST_NODES) -> DataFrame:
    """Subtrees of ``least`` nodes or more that occur twice or more in all pages: digest, check (two hashes of 64 bits that tell the
    class), name, nodes, holders, pages (rows of pages that hold it) and first (the least of ``keys`` and node). A class whose every holder stands in a holder of
    one larger class of as many holders is left out. Pages send each class once, so a frequent one is summed before it is shuffled."""

    def rows(t: P.Trees):
        one, two = t.digests(0).view(np.int64), t.digests(2).view(np.int64)
        k = np.flatnonzero(t.size >= least)
        order = k[np.lexsort((k, two[k], one[k], t.page[k]))]
        if not len(order):
            return order, []
        new = np.flatnonzero(np.append(True, (np.diff(t.page[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
        held, head = np.diff(np.append(new, len(order))), order[new]
        up = np.where(t.parent >= 0, one[t.parent], 0)[order]
        low, high = np.minimum.reduceat(up, new), np.maximum.reduceat(up, new)
        root = np.logical_or.reduceat(t.parent[order] < 0, new)
        mask = root | (low != high)
        return t.page[head], [one[head], two[head], t.name[head], t.size[head], held, pa.array(low, mask=mask), _numbers(t)[head]]

    ddl = "digest long, check long, name string, nodes long, held long, above long, node long"
    found = _mapped(pages, keys, html, ddl, rows)
    first = F.min(F.struct(*[F.col(f"`{k}`") for k in keys], "node"))
    one_above = F.when((F.count("above") == F.count("*")) & (F.min("above") == F.max("above")), F.min("above"))
    groups = found.groupBy("digest", "check", "name", "nodes").agg(
        F.sum("held").alias("holders"), F.count("*").alias("pages"), first.alias("first"), one_above.alias("above")
    )
    many = kept(groups.where("holders >= 2"))
    larger = many.select(F.col("digest").alias("above"), F.col("holders").alias("holders above"))
    largest = many.join(larger, (many["above"] == larger["above"]) & (many["holders"] == larger["holders above"]), "left_anti")
    return largest.select("digest", "check", "name", "nodes", "holders", "pages", "first")
