"""Queries of the trees of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import markup
from textloom.plans.registry import query, table

_KEYS = ["page_id", "url"]


@query("page_nodes")
def _(spark, d):
    """Every element and text of every page, with its place in the tree."""
    return markup.nodes(table(spark, d, "pages"), _KEYS)


@query("page_fragments")
def _(spark, d):
    """What sibling elements of a page begin or end with alike: with their attributes and texts (exact), and by elements alone."""
    return markup.fragments(table(spark, d, "pages"), _KEYS, values=None)


@query("page_clones")
def _(spark, d):
    """Subtrees that recur in the pages, the largest alone; hashes stay out of the result."""
    found = markup.clones(table(spark, d, "pages"), _KEYS)
    return found.select("name", "nodes", "holders", "pages", *[F.col(f"first.{k}").alias(f"first_{k}") for k in (*_KEYS, "node")])
