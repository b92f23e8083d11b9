"""Encoding is held against the tokenizers library, the merge table's steps against plain BPE."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm import fixtures
from textloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x0bb\x1cc", "Σ ΑΣ İX ﬁ", "<|endoftext|>abc<|startoftext|> <|endoftext|", "é ́x ᠎ y z", "'s'LL'Re it's", "½²٣ 日本語😀", "x" * 5000, "aaa<|startoftext|>aaa", "\x7f\x01 ok"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_against_the_library(spark):
    draw = random.Random(4)
    letters = "abcdeé ßΣİ'sllretvdm09 \x0b\x1c\x85 ́　日😀!.<|endoftext|>aaa\n\t"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 0xD7FF), draw.randrange(0x10000, 0x1FFFF)])) for _ in range(draw.randrange(1, 30))) for _ in range(2000)]
    rows = fixtures.documents() + [(100 + k, x, None, None, 0) for k, x in enumerate(texts)]
    tool = library()
    out = bpe.round_trip(spark.createDataFrame(rows, fixtures.DOCS), PATH, ["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = tool.encode(r.row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids, r.row.text
        assert r.n_tokens == len(ids)
        assert r.decoded == tool.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_apart(spark):
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    coded = bpe.encode(docs, PATH, ["text"])
    both = bpe.decode(coded, PATH).select("row.row.text", "decoded").collect()
    tool = library()
    assert len(both) == docs.count()
    for text, decoded in both:
        assert decoded == tool.decode(tool.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.decode(spark.createDataFrame([(None,), (b"",)], "ids binary"), PATH).select("decoded").distinct().collect() == [("",)]


def plain(merges: bpe.Merges, word: tuple) -> list[int]:
    """Merge the pair of the lowest rank, the leftmost first, until none is left."""
    tokens = list(word)
    while True:
        found = [(merges.rank.get(a << 32 | b), k) for k, (a, b) in enumerate(zip(tokens, tokens[1:]))]
        found = [x for x in found if x[0] is not None]
        if not found:
            return tokens
        rank, k = min(found)
        tokens[k : k + 2] = [merges.made.index(rank)]


@pytest.mark.parametrize("seed", range(25))
def test_small_merge_tables(seed):
    """Tables learned from random words, so that all of what a table can hold in order occurs."""
    draw = random.Random(seed)
    corpus = [[c for c in "".join(draw.choice("ab" if seed % 2 else "abc") for _ in range(draw.randrange(1, 14)))] for _ in range(60)]
    vocabulary, merges = {c: k for k, c in enumerate("abc")}, []
    for _ in range(25):
        pairs: dict = {}
        for w in corpus:
            for pair in zip(w, w[1:]):
                if pair[0] + pair[1] not in vocabulary:
                    pairs[pair] = pairs.get(pair, 0) + 1
        if not pairs:
            break
        pair = max(sorted(pairs), key=pairs.get)
        merges.append(pair)
        vocabulary["".join(pair)] = len(vocabulary)
        for w in corpus:
            k = 0
            while k + 1 < len(w):
                if (w[k], w[k + 1]) == pair:
                    w[k : k + 2] = ["".join(pair)]
                k += 1
    table = bpe.Merges(vocabulary, merges, "")
    words = list({tuple(draw.randrange(3) for _ in range(draw.randrange(1, 16))) for _ in range(400)})
    for word, tokens in table.encode(words).items():
        assert tokens == plain(table, word), word


def test_tables_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], "")


def test_cases(spark):
    assert bpe.round_trip(spark.createDataFrame([], fixtures.DOCS), PATH).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "z"), (None, None, None, None)], "ids long, text string, `row` int, `a.b` string")
    out = bpe.round_trip(odd, PATH).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.decoded, r.row["a.b"]) for r in out] == [(0, "", None), (2, "a</w> b</w>", "z")]


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KEPT", 50)
    kept = bpe.Kept()
    for k in range(500):
        kept.turn()
        kept.put([f"w{k}", "x" * 100], [b"a", b"b"])
    assert len(kept.newer) <= 51 and len(kept.older) <= 51 and kept.get(["w499", "w0"]) == [b"a", None]


def test_query(spark):
    from textloom.llm.queries import QUERIES

    out = QUERIES["op11_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tool = library()
    assert len(out) == len(texts)
    for r in out:
        ids = tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
