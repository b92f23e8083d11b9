"""Web pages as trees: elements and texts of the markup as arrays, for a batch of pages at a time.

A start tag opens an element, and an end tag closes the latest open element of its name; an end tag that finds none is left
out. Elements without an end tag of their own last until the next start tag of their name or the end of the element around
them, whichever is first. The element around a node is the latest that began before it and has not ended, so elements that
cross are nested in the order of their starts. Empty elements and self-closed tags hold nothing. Comments and declarations
are no nodes, and the insides of scripts, styles, titles and text areas are one text. A text is what stands between tags and is not
white space alone. A tag that is not closed by ``>`` before the next ``<`` is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute

from textloom.operators import nesting

#: Pages of about so many characters are looked at together; a longer page is alone.
SLICE = 1 << 21
# The standard's elements without an end tag, and those whose inside is not markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = "script|style|title|textarea"
_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^"'<>])*+"""
_TOKEN = re.compile(
    rf"<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<raw>{RAW})(?P<set>(?=[\s/>]){_ATTRIBUTES})>(?P<body>[\s\S]*?)(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*)(?P<attributes>{_ATTRIBUTES})>",
    re.IGNORECASE,
)
TEXT = "#text"


@dataclass
class Trees:
    """The nodes of the pages ``page`` in order; ``order`` lists them by their parents."""

    page: np.ndarray
    name: np.ndarray
    value: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    parent: np.ndarray
    order: np.ndarray
    ordinal: np.ndarray
    depth: np.ndarray
    size: np.ndarray

    def digests(self, lane: int, values: bool = True) -> np.ndarray:
        """A hash of each subtree: the names, attributes and texts in it, or its shape, the names alone."""
        labels = pd.util.hash_array(self.name, categorize=True)
        if values:
            labels = labels * np.uint64(3) + pd.util.hash_array(self.value, categorize=True)
        return nesting.digests(labels, self.size, lane)


def _tokens(html: str) -> Iterator[tuple[int, str, str, int, int]]:
    """step (1 start, -1 end, 0 a node without inside), name, value, first and last position of each token."""
    done = 0
    for m in _TOKEN.finditer(html):
        text = html[done : m.start()].strip()
        if text:
            yield 0, TEXT, " ".join(text.split()), done, m.start()
        done = m.end()
        if m["raw"]:
            yield 1, m["raw"].lower(), m["set"].strip(), m.start(), m.end("set") + 1
            if m["body"].strip():
                yield 0, TEXT, " ".join(m["body"].split()), m.start("body"), m.end("body")
            yield -1, m["raw"].lower(), "", m.end("body"), m.end()
        elif m["name"]:
            name, value = m["name"].lower(), m["attributes"].strip()
            if m["end"]:
                if name not in VOID:
                    yield -1, name, "", m.start(), m.end()
            else:
                yield 0 if name in VOID or value.endswith("/") else 1, name, value.rstrip("/").strip(), m.start(), m.end()
    text = html[done:].strip()
    if text:
        yield 0, TEXT, " ".join(text.split()), done, len(html)


def trees(pages: list[str | None]) -> Trees | None:
    """The trees of pages; a page that is null, empty or of white space alone has no node, and None stands for no node at all."""
    rows, page, base = [], [], [0]
    for k, html in enumerate(pages):
        found = list(_tokens(html or ""))
        rows += found
        page += [k] * len(found)
        base.append(base[-1] + len(html or "") + 1)
    if not rows:
        return None
    step, names, values, start, stop = (list(c) for c in zip(*rows, strict=True))
    step, page, base = np.array(step), np.array(page), np.array(base)
    start, stop = np.array(start) + base[page], np.array(stop) + base[page]
    names, values = np.array(names, object), np.array(values, object)
    kinds = pd.factorize(names)[0]
    bracket = np.flatnonzero(step)
    closing = np.full(len(step), -1, np.int64)
    closing[bracket] = nesting.matched((page * (kinds.max() + 1) + kinds)[bracket], step[bracket])
    closing[bracket] = np.where(closing[bracket] >= 0, bracket[closing[bracket]], -1)
    node = np.flatnonzero(step >= 0)
    end = np.where(closing[node] >= 0, stop[closing[node]], np.where(step[node] > 0, start[node], stop[node]))
    loose = np.flatnonzero((step[node] > 0) & (closing[node] < 0))
    if len(loose):
        around = nesting.previous_above(np.where(np.isin(np.arange(len(node)), loose), start[node], end), start[node])[loose]
        limit = np.where(around >= 0, end[around], base[page[node[loose]] + 1] - 1)
        opens = np.flatnonzero(step[node] > 0)
        group = (page * (kinds.max() + 1) + kinds)[node[opens]]
        by_name = np.argsort(group, kind="stable")
        following = np.full(len(opens), np.iinfo(np.int64).max)
        again = np.flatnonzero(group[by_name][:-1] == group[by_name][1:])
        following[by_name[again]] = start[node[opens[by_name[again + 1]]]]
        end[loose] = np.minimum(limit, following[np.searchsorted(opens, loose)])
    inside = np.where(step[node] > 0, end, start[node])
    parent = nesting.previous_above(inside, start[node])
    depth = nesting.depths(parent)
    order, ordinal = nesting.children(page[node], parent)
    shift = base[page[node]]
    return Trees(page[node], names[node], values[node], start[node] - shift, end - shift, parent, order, ordinal, depth, nesting.sizes(depth))


def slices(batch: pa.RecordBatch, html: str) -> Iterator[tuple[int, Trees]]:
    """The trees of a batch's pages, some pages at a time, with the first page's place in the batch. Only these pages are strings of
    Python at a time."""
    column = batch.column(html)
    ends = np.append(0, np.cumsum(pa.compute.utf8_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE, "right")) - 1)
        found = trees(column.slice(low, high - low).to_pylist())
        if found:
            yield low, found
        low = high
