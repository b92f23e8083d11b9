"""Byte-pair encoding and decoding of whole texts by a trie of distinct words.

Where a merge table was learned in order (a merge's parts are older than itself), the encoding of a sequence is the only
one whose neighbours all fit: no merge across a border fires before its sides are used up. So the encoding of a prefix
is told by its last token alone, as the rest is the encoding of a shorter prefix. Distinct words of a slice of texts are
put into a trie, here the sorted words with the lengths that they share with the one before; a depth-first walk of it
carries the last token of every prefix, so what words share is encoded once. Candidates for the last token are the
tokens that end there, told by an automaton of the vocabulary; the first that fits its left neighbour is it.

White space only parts words, so words between ASCII white space are told apart and cut by the library's own normaliser
and pre-tokeniser once for each distinct one; special tokens in a text part it as well. Tasks share nothing and nothing
is shuffled. A Python worker keeps the vocabulary (about 80 MB) and the encodings of some words seen before.

Cases: null and empty texts and those of white space alone have no tokens and decode to an empty text; rows are encoded
one by one, so repeated rows, null ids and other columns change nothing; texts and words of any length are encoded
whole, in time linear in them; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels
from textloom.llm.texts import map_texts, named

#: Encoded words that a worker keeps from slice to slice, twice; longer words are not kept.
MOST_KEPT, LONGEST_KEPT = 200_000, 64
#: Pairs of neighbours, and of states and symbols, that a worker keeps.
MOST_PAIRS = 500_000
_NEVER = 1 << 60
#: A normaliser and the end of a pre-tokeniser under which printable ASCII is lower-cased and cut by one pattern alone.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_BYTES = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Bytes of text that share a trie; one longer text is a trie of its own.
SLICE_BYTES = 3 << 21


class Merges:
    """A merge table: what each token is made of and when, and which tokens can end at a place."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        n = max(vocabulary.values()) + 1
        self.left, self.right, self.made = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[int, int] = {}  # of the merge of two tokens
        used = set()
        for rank, (a, b) in enumerate(merges):
            left, right = vocabulary[a], vocabulary[b]
            token = vocabulary[a + b]
            used |= {left, right}
            if self.made[token] >= 0 or token in used:
                raise ValueError(f"merge {rank} makes a token again, or after it was used")
            self.left[token], self.right[token], self.made[token] = left, right, rank
            self.rank[left << 32 | right] = rank
        self.inner = {s: t for s, t in vocabulary.items() if len(s) == 1}
        self.final = {s[0]: t for s, t in vocabulary.items() if suffix and len(s) == 1 + len(suffix) and s.endswith(suffix)} or self.inner
        self.moves: dict[int, int] = {}
        self.fitting: dict[int, bool] = {}  # of two neighbours
        self._automaton()

    def first_across(self, a: int, b: int) -> int:
        """The rank of the first merge that fires across the border of two neighbours; _NEVER if none does."""
        made, rank, end_a, end_b = self.made, self.rank, _NEVER, _NEVER
        found = _NEVER
        while True:
            at = rank.get(a << 32 | b, _NEVER)
            if at < end_a and at <= end_b:  # of equal ranks the left one fires first
                found = at  # ranks fall as the walk goes back in time
            if made[a] < 0 and made[b] < 0:
                return found
            if made[a] > made[b]:
                end_a, a = made[a], self.right[a]
            else:
                end_b, b = made[b], self.left[b]

    def _automaton(self) -> None:
        """Over single-symbol tokens: states are the beginnings of tokens; ``ends`` is the longest token that ends in a
        state and ``shorter`` the next shorter one that ends where a token does."""
        n = len(self.made)
        spelled: list[tuple] = [()] * n
        self.length = [0] * n
        whole = [t for t in (*self.inner.values(), *self.final.values())]
        for t in whole:
            spelled[t], self.length[t] = (t,), 1
        for token in sorted((t for t in range(n) if self.made[t] >= 0), key=self.made.__getitem__):
            left, right = self.left[token], self.right[token]
            spelled[token] = spelled[left] + spelled[right]
            self.length[token] = len(spelled[token])
            if self.first_across(left, right) == self.made[token]:  # else its own symbols never give it
                whole.append(token)
        self.goto: dict[int, int] = {}
        self.ends, before, symbol = [-1], [0], [-1]
        depth = [0]
        for token in whole:
            at = 0
            for s in spelled[token]:
                to = self.goto.get(at << 20 | s)
                if to is None:
                    to = self.goto[at << 20 | s] = len(self.ends)
                    self.ends.append(-1)
                    before.append(at)
                    symbol.append(s)
                    depth.append(depth[at] + 1)
                at = to
            self.ends[at] = token
        self.back = [0] * len(self.ends)
        self.shorter = [-1] * n
        for state in sorted(range(1, len(self.ends)), key=depth.__getitem__):
            if before[state]:
                self.back[state] = self.step(self.back[before[state]], symbol[state])
            up = self.ends[self.back[state]]
            if self.ends[state] >= 0:
                self.shorter[self.ends[state]] = up
            else:
                self.ends[state] = up

    def step(self, state: int, symbol: int) -> int:
        """The longest beginning of a token that ends with ``symbol`` after ``state``; what is looked up is kept."""
        to, at = self.goto.get(state << 20 | symbol), state
        while to is None and at:
            at = self.back[at]
            to = self.goto.get(at << 20 | symbol)
        return to or 0

    def symbols(self, word: str) -> tuple:
        return (*[self.inner[c] for c in word[:-1]], self.final[word[-1]])

    def encode(self, words: list[tuple]) -> dict[tuple, list[int]]:
        """The tokens of distinct words (of symbols), by a depth-first walk over their trie."""
        moves, step, ends, shorter, length, fitting = self.moves, self.step, self.ends, self.shorter, self.length, self.fitting
        for kept in (moves, fitting):
            if len(kept) > MOST_PAIRS:
                kept.clear()
        states, last = [0], [-1]  # along the path from the root: automaton states, last tokens of the prefixes
        before: tuple = ()
        out = {}
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for symbol in word[shared:]:
                key = state << 20 | symbol
                state = moves.get(key, -1)
                if state < 0:
                    state = moves[key] = step(key >> 20, symbol)
                token = ends[state]
                while True:
                    left = last[-length[token]]
                    if left < 0:
                        break
                    key = left << 32 | token
                    fits = fitting.get(key)
                    if fits is None:
                        fits = fitting[key] = self.first_across(left, token) == _NEVER
                    if fits:
                        break
                    token = shorter[token]
                states.append(state)
                last.append(token)
            tokens, k = [], len(word)
            while k:
                tokens.append(last[k])
                k -= length[last[k]]
            out[word] = tokens[::-1]
            before = word
        return out


class Kept:
    """The encodings of the words seen last: two tables, of which the older one is dropped when the newer one is full."""

    def __init__(self) -> None:
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.newer) > MOST_KEPT:
            self.older, self.newer = self.newer, {}

    def get(self, words: Iterable[str]) -> list:
        newer, older = self.newer.get, self.older.get
        return [newer(w) or older(w) for w in words]

    def put(self, words: Iterable[str], coded: Iterable[bytes]) -> None:
        self.newer.update([(w, x) for w, x in zip(words, coded, strict=True) if len(w) <= LONGEST_KEPT])


class Codec:
    """A tokenizer file whose words end at white space, which is dropped."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: only BPE files without decoder, post-processor, dropout and prefixes are read")
        self.library = Tokenizer.from_file(path)
        if self.pieces("a \t b") != self.pieces("a") + self.pieces("b") or self.pieces(" \x0b\x0c"):
            raise ValueError(f"{path}: only tokenizers that drop white space are read")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: s for s, i in (model["vocab"] | self.special).items()}
        raw = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.name_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.name_ends = np.cumsum([len(x) for x in raw])
        self.name_starts = self.name_ends - [len(x) for x in raw]
        self.words, self.tokens = Kept(), Kept()
        known = spec["normalizer"] == KNOWN_NORMALIZER and spec["pre_tokenizer"]["pretokenizers"][1:] == KNOWN_BYTES
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if known else None

    def pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def cut(self, words: list[str]) -> list[list]:
        """The pieces of each word that holds no ASCII white space; a special token is its id."""
        out: list = [None] * len(words)
        if self.pattern:
            plain = [k for k, w in enumerate(words) if w.isascii() and w.isprintable()]
            found = self.pattern.findall
            for k, lowered in zip(plain, "\n".join([words[k] for k in plain]).lower().split("\n"), strict=False):
                out[k] = [lowered] if lowered.isalpha() else found(lowered)
        for k, w in enumerate(words):
            if out[k] is None or self.parting and "|" in w and self.parting.search(w):
                out[k] = []
                for text in self.parting.split(w) if self.parting else [w]:
                    out[k] += [self.special[text]] if text in self.special else self.pieces(text)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some distinct words that hold no ASCII white space, one after another, and how many each has."""
        for kept in (self.words, self.tokens):
            kept.turn()
        coded = self.words.get(words)
        new = [k for k, x in enumerate(coded) if x is None]
        cut = self.cut([words[k] for k in new])
        pieces = list({p for parts in cut for p in parts if isinstance(p, str)})
        tokens = dict(zip(pieces, self.tokens.get(pieces), strict=True))
        symbols = {p: self.merges.symbols(p) for p, x in tokens.items() if x is None}
        found = self.merges.encode(list(symbols.values()))
        for p, word in symbols.items():
            tokens[p] = array("I", found[word]).tobytes()
        for k, parts in zip(new, cut, strict=True):
            coded[k] = b"".join([array("I", [p]).tobytes() if isinstance(p, int) else tokens[p] for p in parts])
        self.words.put(words, coded)
        self.tokens.put(tokens, tokens.values())
        return np.frombuffer(b"".join(coded), np.uint32), np.array([len(x) for x in coded], np.int64) // 4

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of rows of UTF-8 and the places where rows begin."""
        starts, ends, first = kernels.words(data, offsets, kernels.SPACED)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        within = np.concatenate(([0], np.cumsum(ends - starts)))
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(within.astype(np.int64)), pa.py_buffer(data[kernels.SPACED[data]].tobytes()))
        distinct = column.dictionary_encode()
        coded, sizes = self.encode_words(distinct.dictionary.to_pylist())
        at = distinct.indices.to_numpy()
        ids = gathered(coded, np.cumsum(sizes) - sizes, sizes, at)
        before = np.concatenate(([0], np.cumsum(sizes[at])))
        return ids, before[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of each row's tokens, joined by a space, and where rows begin."""
        sizes = self.name_ends - self.name_starts
        if len(ids) and int(ids.max()) >= len(sizes):
            raise ValueError(f"no token has the id {int(ids.max())}")
        ids = ids.astype(np.int64)
        data = gathered(self.name_bytes, self.name_starts, sizes, ids)
        ends = np.cumsum(sizes[ids])
        rows = first[1:] > first[:-1]
        keep = np.ones(len(data), bool)
        keep[ends[first[1:][rows] - 1] - 1] = False  # the space after a row's last token
        starts = np.concatenate(([0], ends))[first] - np.concatenate(([0], np.cumsum(rows)))
        return data[keep], starts


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for each i of ``at``, one after another; ``most`` of them at a time."""
    out = np.empty(int(sizes[at].sum()), flat.dtype)
    done = 0
    for low in range(0, len(at), most):
        some = at[low : low + most]
        lengths = sizes[some]
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        out[done : done + total] = flat[np.repeat(starts[some] - (ends - lengths), lengths) + np.arange(total)]
        done += total
    return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _binary(data: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    wide = pa.large_string() if kind == pa.string() else pa.large_binary()
    return pa.Array.from_buffers(wide, len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(data.tobytes())]).cast(kind)


def round_trip(docs: DataFrame, path: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``carry``) with n_tokens, ids (little-endian unsigned 32-bit integers) and what they
    decode to."""

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        ids, first = codec(path).encode(data, offsets)
        decoded = codec(path).decode(ids, first)
        return [np.diff(first), _binary(ids.astype("<u4").view(np.uint8), first * 4, pa.binary()), _binary(*decoded, pa.string())]

    return map_texts(docs, kernel, "n_tokens long, ids binary, decoded string", carry, text, most=SLICE_BYTES)


def encode(docs: DataFrame, path: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``carry``) with n_tokens and ids (little-endian unsigned 32-bit integers)."""

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        ids, first = codec(path).encode(data, offsets)
        return [np.diff(first), _binary(ids.astype("<u4").view(np.uint8), first * 4, pa.binary())]

    return map_texts(docs, kernel, "n_tokens long, ids binary", carry, text, most=SLICE_BYTES)


def decode(coded: DataFrame, path: str, carry: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """``row`` (the columns of ``carry``) with the text that a column of ``encode``'s ids stands for; null ids are none."""
    def kernel(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> list:
        raw, at = kernels.buffers(column)
        return [_binary(*codec(path).decode(np.frombuffer(raw.tobytes(), "<u4"), at // 4), pa.string())]

    blank = coded.withColumn("text", F.lit(""))
    return map_texts(blank, kernel, "decoded string", coded.columns if carry is None else carry, also=[named(ids)])
