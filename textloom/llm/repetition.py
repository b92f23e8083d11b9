"""Repetition coverage: how much of a text lies inside its own repeated word n-grams and lines.

Rolling hashes of word n-grams are made in numpy for all texts of a slice at once. A repeated n-gram begins with a
repeated (n - 1)-gram, so each length looks only at the places where the shorter one repeats.

Cases: a null, empty or blank text has no words, counts 0 throughout and fails the base rule; rows are measured one
by one, so repeated rows, null ids and other columns change nothing; texts of any length are measured whole; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm import kernels
from textloom.llm.texts import map_texts

LEAST_WORDS = 50
#: Most of a text's words, in hundredths, that may lie in repeated windows of three words.
MOST_REPEATED_WORDS = 50
#: Most of a text's characters that may lie in repeats of an n-gram, first ones left out, by n.
MOST_IN_GRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of the characters that may lie in lines seen before. Their share of lines says little of a text of few lines.
MOST_LINE_CHARS = 0.20

FIELDS = ", ".join(["n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, dup_line_chars long", *(f"dup_chars_{n} long" for n in MOST_IN_GRAMS), "base_failed boolean, kept boolean"])

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NO_FEED = np.ones(256, bool)
_NO_FEED[0x0A] = False


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them are not the first such."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    again = np.zeros(len(keys), bool)
    if not len(twice):
        return again, again
    near = np.zeros(1 << 16, bool)
    near[twice & np.uint64(0xFFFF)] = True
    some = np.flatnonzero(near[keys & np.uint64(0xFFFF)])
    _, first, inverse, count = np.unique(keys[some], return_index=True, return_inverse=True, return_counts=True)
    among = again.copy()
    among[some] = count[inverse] > 1
    again[some] = among[some]
    again[some[first]] = False
    return among, again


def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
    n_rows = len(offsets) - 1
    starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
    row, hashes = kernels.row_of(first), kernels.span_hashes(data, starts, ends)
    n_words = np.diff(first)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kernels.LEADS[data], out=lead[1:])
    sizes = lead[ends] - lead[starts]  # in code points
    chars = kernels.sums_by_row(sizes, first)
    symbols = kernels.sums_by_row(_SYMBOLS[data].astype(np.int8), offsets)

    salt = kernels.mixed(np.arange(n_rows, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at, rolled = np.arange(len(hashes)), kernels.mixed(hashes) + salt[row]
    n_repeat_words, in_grams = np.zeros(n_rows, np.int64), []
    last = first[1:][row]
    for n in range(2, 11):
        fits = at + n <= last[at]
        at = at[fits]
        rolled = rolled[fits] * np.uint64(0xD6E8FEB86659FD93) + hashes[at + n - 1]
        among, again = repeats(kernels.mixed(rolled))
        if n == 3:
            n_repeat_words = kernels.sums_by_row(kernels.covered(at[among], n, len(hashes)), first)
        if n in MOST_IN_GRAMS:
            in_grams.append(kernels.sums_by_row(kernels.covered(at[again], n, len(hashes)) * sizes, first))
        at, rolled = at[among], rolled[among]

    l_starts, l_ends, l_first = kernels.words(data, offsets, _NO_FEED)
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_row = kernels.row_of(l_first)
    _, again = repeats(kernels.mixed(kernels.span_hashes(data, l_starts, l_ends)[worded] + salt[l_row[worded]]))
    l_row, l_sizes = l_row[worded], (np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends))
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    l_chars = (total[l_sizes[1]] - total[l_sizes[0]])[worded]
    n_lines = np.bincount(l_row, minlength=n_rows)
    dup_lines = np.bincount(l_row[again], minlength=n_rows)
    dup_line_chars = np.bincount(l_row[again], l_chars[again], minlength=n_rows).astype(np.int64)

    failed = (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_WORDS * n_words)
    kept = ~failed & (dup_line_chars <= MOST_LINE_CHARS * chars)
    for most, found in zip(MOST_IN_GRAMS.values(), in_grams, strict=True):
        kept &= found <= most * chars
    return [n_words, chars, symbols, dup_lines, n_repeat_words, n_lines, dup_line_chars, *in_grams, failed, kept]


def measure(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``carry``) with counts of words, symbols, repeats and the two verdicts."""
    return map_texts(docs, kernel, FIELDS, carry)


def oracle() -> str:
    """The query of documents with unique ids in DuckDB's SQL."""
    parts, joins, kept = [], [], []
    for n, most in MOST_IN_GRAMS.items():
        parts.append(
            f"g{n} AS (SELECT doc_id, CAST(sum(len(ws[p])) AS BIGINT) AS c FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM ("
            f"SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM ("
            f"SELECT doc_id, i, hash(array_to_string(ws[i:i + {n - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n}))) WHERE k > 1) JOIN w USING (doc_id) GROUP BY doc_id)"
        )
        joins.append(f"LEFT JOIN g{n} ON g{n}.doc_id = w.doc_id")
        kept.append(f"coalesce(g{n}.c, 0) <= {most} * chars")
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{word}'), []) AS ws FROM documents),
r AS (
  SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (
      SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3))) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM w),
k AS (SELECT doc_id, len(array_to_string(regexp_extract_all(line, '{word}'), '')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k FROM l WHERE regexp_matches(line, '{word}')),
n AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (k > 1) AS dup, CAST(coalesce(sum(chars) FILTER (k > 1), 0) AS BIGINT) AS dup_chars FROM k GROUP BY doc_id),
{", ".join(parts)},
c AS (SELECT doc_id, CAST(len(array_to_string(ws, '')) AS BIGINT) AS chars FROM w),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, chars AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words, coalesce(lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_line_chars,
         {", ".join(f"coalesce(g{n}.c, 0) AS dup_chars_{n}" for n in MOST_IN_GRAMS)},
         len(ws) < {LEAST_WORDS} OR 100 * coalesce(r.c, 0) > {MOST_REPEATED_WORDS} * len(ws) AS base_failed,
         {" AND ".join(kept)} AND coalesce(dup_chars, 0) <= {MOST_LINE_CHARS} * chars AS fine
  FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id {" ".join(joins)})
SELECT * EXCLUDE (fine), fine AND NOT base_failed AS kept FROM m
"""
