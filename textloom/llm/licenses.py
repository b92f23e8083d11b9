"""License scan by conditional compression.

*Candidates.* A word may belong to a license where it is in a run of ``GRAM`` words that some template has; such runs
are found in numpy over all words of all texts, so line breaks, comment signs and what a notice calls itself play no part.
Runs at most ``GAP`` words apart make a block, which stays if it has as many of them as the shortest template it
could be; no length is bounded.

*Ranking.* The block's words are compressed alone and with the words of each template as a raw zstandard dictionary.
Templates are ranked by the part of the size that they save.

*Confirming.* In that order, the exact wording is compared: the words that the block has and the form (a statement,
notice or text of the license) has not, and those it lacks. Forms of up to ``SHORT`` words must be there word for word,
longer ones but for ``MOST_OTHER`` of the words, and numbers, which are versions, must always be. What follows "not" and
the like is no license, and a form of less than four words must end a clause. Of the templates that are confirmed, and
save nearly as much as the first one that is, the one with the fewest differences wins: "2-clause" and "3-clause" or two
versions of one text differ by a few words. The winner's words, wherever one
of its forms is, are taken out and the rest is judged again.

*Declaring.* SPDX tags and names after one verb ("under MIT or Apache-2.0") have no wording; ``declarations`` reads them by
their grammar, and what no block has at that place is added with a null ``saved``.

Cases: null or empty texts and those without a run have no blocks; a block like a template that is confirmed as none has
a null license; rows are judged one by one, so repeated rows and null ids change nothing; an empty table gives an empty
table; other columns stay inside a struct.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from textloom.llm import declarations, kernels
from textloom.llm.license_texts import TEMPLATES
from textloom.llm.texts import map_texts

GRAM = 3
GAP = 20
LEVEL = 9
SHORT = 16
MOST_OTHER = 0.3
#: Templates that save this much less than the first confirmed one are not asked.
NEARLY = 0.25
#: A form's own span must shrink by this part.
LEAST_SAVED = 0.1
#: Blocks of so many words that shrink by this part, and are confirmed as no license, are listed with a null one.
UNSURE_WORDS, UNSURE_SAVED = 12, 0.4
FIELDS = "blocks array<struct<first_line: int, last_line: int, license: string, saved: double, other_words: int>>"
#: Words that turn a statement round, among the three before it.
NEGATIONS = frozenset("not never neither nor cannot longer isn aren wasn weren won".split())
_WORD = re.compile(r"[a-z0-9]+")
_KIND = np.zeros(256, bool)
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = True
_FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


class Form(NamedTuple):
    words: list[str]
    grams: frozenset


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[k : k + GRAM]) for k in range(len(words) - GRAM + 1)]


def _least_grams(form: list[str]) -> int:
    """Runs that a confirmed form has at least: all where it is short, else what differences spread out evenly leave."""
    return len(form) - GRAM + 1 if len(form) <= SHORT else max(1, round(len(form) * (1 - MOST_OTHER * GRAM)))


@lru_cache(1)
def _tools() -> list[tuple]:
    """(template, compressor with its dictionary, forms) of each template."""
    out = []
    for t in TEMPLATES:
        known = zstandard.ZstdCompressionDict(" ".join(words_of(t.text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        forms = [Form(w, frozenset(_grams(w))) for w in map(words_of, t.forms)]
        out.append((t, zstandard.ZstdCompressor(dict_data=known, **_FRAME), sorted(forms, key=lambda f: -len(f.words))))
    return out


@lru_cache(1)
def _known_grams() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the templates' runs of words, and how many runs the shortest form with each has at least."""
    least: dict[tuple[str, ...], int] = {}
    for _, _, forms in _tools():
        for f in forms:
            for g in f.grams:
                least[g] = min(least.get(g, 1 << 30), _least_grams(f.words))
    data, offsets = kernels.buffers(_column([" ".join(g) for g in least]))
    starts, ends, _ = kernels.words(data, offsets, _KIND)
    hashes = kernels.gram_hashes(kernels.span_hashes(data, starts, ends), GRAM)[::GRAM]
    order = np.argsort(hashes)
    return hashes[order], np.fromiter(least.values(), np.int64)[order]


def _column(values: list[str]) -> pa.Array:
    return pa.array(values, pa.large_string())


def savings(block: bytes) -> list[tuple[float, int]]:
    """(part of the compressed size that it saves, number) of each template, most first, ties in their order."""
    alone = len(zstandard.ZstdCompressor(level=LEVEL, **_FRAME).compress(block))
    found = [(1 - len(tool.compress(block)) / alone, k) for k, (_, tool, _) in enumerate(_tools())]
    return sorted(found, key=lambda x: (-round(x[0], 6), x[1]))


def saving(k: int, words: list[str]) -> float:
    """Part of the compressed size of words that template k saves."""
    block = " ".join(words).encode()
    return 1 - len(_tools()[k][1].compress(block)) / len(zstandard.ZstdCompressor(level=LEVEL, **_FRAME).compress(block))


class Found(NamedTuple):
    matched: list[int]
    other: int
    missing: int

    @property
    def score(self) -> int:
        return len(self.matched) - self.other - self.missing


def _runs(words: list[str], own: list[str]) -> list[difflib.Match]:
    """Runs that both have, without single words at the ends."""
    runs = [m for m in difflib.SequenceMatcher(None, words, own, autojunk=False).get_matching_blocks() if m.size]
    while len(runs) > 1 and runs[0].size == 1:
        del runs[0]
    while len(runs) > 1 and runs[-1].size == 1:
        del runs[-1]
    return runs


def _wording(words: list[str], form: Form, ends: list[bool]) -> Iterator[Found]:
    """Places where the words are those of the form, with the exact differences."""
    own, n = form.words, len(form.words)
    at = [k for k in range(len(words) - GRAM + 1) if tuple(words[k : k + GRAM]) in form.grams]
    done = -1
    for start in at:
        if start < done:
            continue
        if n <= SHORT:
            if words[start : start + n] != own:
                continue
            low, matched, other, missing = start, list(range(start, start + n)), 0, 0
        else:
            low = max(0, start - 2)
            low += _runs(words[low : low + n + n // 2], own)[0].a  # where it begins, so that its end is in view
            runs = _runs(words[low : low + n + n // 2], own)
            matched = [low + k for m in runs for k in range(m.a, m.a + m.size)]
            same = {k for m in runs for k in range(m.b, m.b + m.size)}
            other, missing = matched[-1] + 1 - matched[0] - len(matched), n - len(same)
            low = matched[0]
            if max(other, missing) > MOST_OTHER * n or any(own[k].isdigit() for k in range(n) if k not in same):
                done = start + max(1, n // 4)
                continue
        done = matched[-1] + 1
        if NEGATIONS & set(words[max(0, low - 3) : low]) or n < 4 and not ends[matched[-1]]:
            continue
        yield Found(matched, other, missing)


def _judged(block: str) -> tuple[tuple[str, float, int], ...]:
    low = block.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    ends = [bool(re.search(r"[^\s]|\n", low[b : spans[k + 1][0] if k + 1 < len(spans) else len(low)])) or k + 1 == len(spans) for k, (_, b) in enumerate(spans)]
    place = list(range(len(words)))
    out: list[tuple] = []
    named: set[str] = set()
    while words:
        best, floor = None, -1.0
        for saved, k in savings(" ".join(words).encode()):
            template, _, forms = _tools()[k]
            if saved < floor:
                break
            if template.name in named:
                continue
            places = [found for f in forms for found in _wording(words, f, ends)]
            for found in places:
                if best is None or found.score > best[0].score:
                    own = saving(k, words[found.matched[0] : found.matched[-1] + 1])
                    if own >= LEAST_SAVED:
                        best, floor = (found, own, template.name, places), max(floor, saved - NEARLY)
        if best is None:
            break
        found, own, name, places = best
        out.append((place[found.matched[0]], name, own, found.other + found.missing))
        named.add(name)
        gone = {k for x in places for k in x.matched}
        words, ends, place = ([x for k, x in enumerate(xs) if k not in gone] for xs in (words, ends, place))
    return tuple(x[1:] for x in sorted(out))


_kept = lru_cache(4096)(_judged)


def judged(block: str) -> tuple[tuple[str, float, int], ...]:
    """(license, saved, words that differ) of each license in a block, in its order. Short blocks, which recur, are remembered."""
    return _kept(block) if len(block) <= 500 else _judged(block)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """For each text, first and last line and the text of its candidate blocks, with the three words before and the one
    after each."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends, first = kernels.words(data, offsets, _KIND)
    known, least = _known_grams()
    lowered = kernels.LOWER[data]
    hashes = kernels.gram_hashes(kernels.span_hashes(lowered, starts, ends), GRAM)
    if not len(hashes):
        return out
    row = kernels.row_of(first)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero((known[at] == hashes) & (row[: len(hashes)] == row[GRAM - 1 :]))
    if not len(hit):
        return out
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > GAP + GRAM) | (row[hit[1:]] != row[hit[:-1]])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(hit))
    enough = high - low >= np.minimum.reduceat(least[at[hit]], low)
    feeds = np.flatnonzero(data == 10)
    for a, b in zip(low[enough].tolist(), high[enough].tolist(), strict=True):
        r, x, y = int(row[hit[a]]), int(hit[a]), int(hit[b - 1]) + GRAM - 1
        since = starts[max(int(first[r]), x - 3)]
        until = ends[y + 1] if y + 1 < first[r + 1] else offsets[r + 1]
        line = np.searchsorted(feeds, [offsets[r], starts[x], starts[y]])
        out[r].append((int(line[1] - line[0]), int(line[2] - line[0]), data[since:until].tobytes().decode("utf-8", "replace")))
    return out


def blocks_of(text: bytes) -> list[tuple[int, int, str]]:
    """First and last line, and the text, of each candidate block of a text."""
    return _blocks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def _kernel(data: np.ndarray, offsets: np.ndarray) -> list:
    out = []
    for k, blocks in enumerate(_blocks(data, offsets)):
        found = []
        for first, last, block in blocks:
            licenses: tuple = judged(block)
            if not licenses and len(words := words_of(block)) >= UNSURE_WORDS and (saved := savings(" ".join(words).encode())[0][0]) >= UNSURE_SAVED:
                licenses = ((None, saved, len(words)),)
            found += [{"first_line": first, "last_line": last, "license": name, "saved": round(saved, 6), "other_words": other} for name, saved, other in licenses]
        own = data[offsets[k] : offsets[k + 1]].tobytes()
        more = [(line, name) for line, name in declarations.declared(own) if not any(x["license"] == name and x["first_line"] <= line <= x["last_line"] for x in found)]
        found += [{"first_line": line, "last_line": line, "license": name, "saved": None, "other_words": 0} for line, name in dict.fromkeys(more)]
        out.append(sorted(found, key=lambda x: x["first_line"]) if more else found)
    return [out]


def scan(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``carry``) with ``blocks``; license is null where a block is confirmed as none."""
    return map_texts(docs, _kernel, FIELDS, carry)
