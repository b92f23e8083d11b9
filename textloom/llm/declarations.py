"""Licenses that a text declares by identifier: SPDX tags by their grammar, and lists of names after one verb.

An SPDX tag holds an expression of identifiers, AND, OR, WITH and brackets; what follows its longest beginning that is one
(the end of a comment, say) is no part of it. A statement ("licensed under", "MIT-licensed" and the like) holds one name or
several between "and", "or", commas and strokes. Names are those of the templates and what their short forms call
them, so nothing else is a license here. Such words have no wording to compare and nothing to compress; texts and
notices are ``licenses``' work.

Cases: a null or empty text declares nothing; an expression that is none declares nothing; an exception after WITH is no
license; identifiers without a template are given as written.
"""

from __future__ import annotations

import re
from functools import lru_cache

from textloom.llm.license_texts import TEMPLATES

TAG = re.compile(rb"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: Statements that name licenses after them, or right before them.
VERB = re.compile(rb"\b(?:licen[sc]ed|released|distributed|available)[ \t\r\n]+under\b", re.IGNORECASE)
BEFORE = re.compile(rb"\b([A-Za-z0-9][A-Za-z0-9.\-]{1,40})-licen[sc]ed\b", re.IGNORECASE)
NEGATIONS = frozenset(b"not never neither nor cannot longer isn aren wasn weren won".split())
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_PART = re.compile(r"[a-z0-9]+|[,/&;:.()\[\]]|\n\s*\n")
_FILL = frozenset("the either both a terms of your choice one following at option".split())
_JOINS = frozenset("and or , / &".split())
#: What follows a name and makes it another license.
_OTHER = frozenset("style like compatible".split())
LONGEST = 400


@lru_cache(1)
def names() -> dict[tuple[str, ...], str]:
    """The words of each template's name, and of what its short forms say after "under"."""
    out: dict[tuple[str, ...], str] = {}
    for t in TEMPLATES:
        said = [t.name.lower().replace("-", " ")]
        said += [f.lower().split(" under ", 1)[1] for f in t.forms if len(f) < 100 and re.match(r"(?i)(licensed|released|distributed) under ", f)]
        for s in said:
            words = tuple(w for w in re.findall(r"[a-z0-9]+", s))
            out.setdefault(words[1:] if words[0] == "the" else words, t.name)
    return out


@lru_cache(1)
def _identifiers() -> dict[str, str]:
    return {t.name.lower(): t.name for t in TEMPLATES}


def canonical(identifier: str) -> str:
    """The template's name of an SPDX identifier, whatever "or later" it says; as written if there is none."""
    base = re.sub(r"(\+|-only|-or-later)$", "", identifier, flags=re.IGNORECASE)
    return _identifiers().get(base.lower(), identifier)


def expression(text: str) -> list[str]:
    """The identifiers of the longest SPDX expression that the text begins with, in order; none if there is none."""
    place, depth, want = 0, 0, True
    found: list[str] = []
    whole: list[str] = []
    while True:
        space = re.match(r"[ \t]*", text[place:])
        place += space.end() if space else 0
        m = _TOKEN.match(text, place)
        if not m:
            return whole
        token, place = m.group(), m.end()
        word = token.upper()
        if token == "(":
            if not want:
                return whole
            depth += 1
        elif token == ")":
            if want or not depth:
                return whole
            depth -= 1
        elif word in ("AND", "OR"):
            if want:
                return whole
            want = True
        elif word == "WITH":
            space = re.match(r"[ \t]*", text[place:])
            exception = _TOKEN.match(text, place + (space.end() if space else 0))
            if want or not exception or exception.group() in "()":
                return whole
            place = exception.end()
        else:
            if not want:
                return whole
            found.append(canonical(token))
            want = False
        if not want and not depth:
            whole = list(found)


def listed(text: str) -> list[str]:
    """The licenses that a text begins by naming, with "and", "or", commas or strokes between them."""
    parts, known = _PART.findall(text.lower()), names()
    longest = max(map(len, known))
    found: list[str] = []
    k = 0
    while True:
        while k < len(parts) and (parts[k] in _FILL or found and parts[k] in _JOINS):
            k += 1
        best = None
        words: list[str] = []
        for j in range(k, len(parts)):
            if parts[j] in (".", ",") and words and j + 1 < len(parts) and parts[j + 1][0].isalnum():
                if parts[j] == "." and not (parts[j - 1].isdigit() and parts[j + 1].isdigit()):
                    break
                continue  # "2.0", "License, Version 2.0"
            if not parts[j][0].isalnum() or len(words) == longest:
                break
            words.append(parts[j])
            if tuple(words) in known:
                best = (j + 1, known[tuple(words)])
        if best is None:
            return found
        k, name = best
        if k < len(parts) and parts[k] in _OTHER:
            return found
        found.append(name)
        while k < len(parts) and parts[k] in ("license", "licence", "licenses", "licences"):
            k += 1
        if k >= len(parts) or parts[k] not in _JOINS:
            return found


def declared(text: bytes) -> list[tuple[int, str]]:
    """(line, license) of each license that a text declares, in order."""
    out: list[tuple[int, str]] = []
    for m in TAG.finditer(text):
        out += [(m.start(), name) for name in expression(m.group(1).decode("utf-8", "replace"))]
    for m in VERB.finditer(text):
        if not NEGATIONS & set(re.findall(rb"[a-z0-9]+", text[max(0, m.start() - 40) : m.start()].lower())[-3:]):
            out += [(m.start(), name) for name in listed(text[m.end() : m.end() + LONGEST].decode("utf-8", "replace"))]
    for m in BEFORE.finditer(text):
        name = _identifiers().get(m.group(1).decode().lower())
        if name and not NEGATIONS & set(re.findall(rb"[a-z0-9]+", text[max(0, m.start() - 40) : m.start()].lower())[-3:]):
            out.append((m.start(), name))
    return [(text.count(b"\n", 0, at), name) for at, name in sorted(dict.fromkeys(out))] if out else []
