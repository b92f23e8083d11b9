import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures
from textloom.llm import suffixes


def test_suffix_array_and_prefixes():
    draw = random.Random(2)
    for _ in range(400):
        n, k = draw.randrange(0, 60), draw.randrange(1, 5)
        text = [draw.randrange(1, k + 1) for _ in range(n)]
        if draw.random() < 0.3:
            text = text * 3
        text.append(0)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffixes.suffix_array(text) == want
        shared = suffixes.common_prefixes(text, want)
        for a, b, x in zip(want, want[1:], shared[1:]):
            p, q = text[a:], text[b:]
            assert x == next(i for i in range(len(p) + 1) if p[i : i + 1] != q[i : i + 1])


def brute(texts):
    length = suffixes.LENGTH
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    draw = random.Random(9)
    passage = [fixtures.prose(400 + k, 60 + 12 * k) for k in range(6)]
    out = [t for _, t, *_ in fixtures.documents()]
    for k in range(60):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            x = draw.choice(passage)
            if draw.random() < 0.6:  # a repeat of about the length, cut anywhere
                a = draw.randrange(0, len(x) - 395)
                x = x[a : a + draw.randrange(380, 440)]
            if draw.random() < 0.3:
                a = draw.randrange(len(x))
                x = x[:a] + "é#" + x[a + 1 :]
            parts += [x, fixtures.prose(5000 + 10 * k + len(parts), draw.randrange(0, 30))]
        out.append("".join(parts))
    return [*out, "ab" * 700, "ab" * 300 + "c" + "ab" * 300, "z" * 401, "z" * 399]


@pytest.mark.parametrize("most", [suffixes.MOST_SNIPPETS, 2])
def test_against_brute_force(spark, most):
    these = texts()
    docs = spark.createDataFrame([(k, t, "odd") for k, t in enumerate(these)], "doc_id long, text string, ranges string")
    out = {r.row.doc_id: tuple(r)[1:5] for r in suffixes.dedup(docs, ["doc_id"], most).collect()}
    want = brute(these)
    assert [out[k] for k in range(len(these))] == want


def test_empty(spark):
    assert suffixes.dedup(spark.createDataFrame([], fixtures.DOCS)).count() == 0
