import hashlib
import random
import re

from tests.llm import fixtures
from textloom.llm import contamination

WORD = re.compile(contamination.WORD)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window):
    words = WORD.findall(lowered(text))
    hit, names = set(), set()
    for i, item in items:
        own = WORD.findall(lowered(item))
        n = min(window, len(own))
        if not n:
            continue
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                names.add(i)
    names = sorted(str(i) for i in names if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def items():
    base = fixtures.prose(1, 180).split()
    return [(1, " ".join(base[20:60])), (2, "  ".join(base[30:45]).upper()), (10, fixtures.prose(7, 70)), (3, "shared foot"), (4, "zzz"), (5, None), (6, "..."), (None, "one two"), (7, "same line same"), (8, " ".join(base[100:109])), (8, "ünï cödé ßtr"), (9, "c")]


def check(spark, most_words, these=None):
    these = items() if these is None else these
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    bench = spark.createDataFrame(these, "item_id long, text string")
    out = contamination.scan(docs, bench, most_words=most_words, carry=["doc_id", "text"])
    got = contamination.digest(out).collect()
    want = [(r.doc_id, *brute(r.text, these, 10)) for r in docs.collect()]
    assert sorted(map(str, (tuple(g) for g in got))) == sorted(map(str, want))


def test_against_brute_force(spark):
    check(spark, contamination.MOST_WORDS)


def test_without_short_items(spark):
    check(spark, contamination.MOST_WORDS, [x for x in items() if x[0] in (1, 2, 10)])


def test_several_automata(spark):
    check(spark, 40)


def test_empty_benchmark(spark):
    check(spark, 40, [])


def test_automaton_on_random_words():
    draw = random.Random(5)
    for _ in range(150):
        window = draw.randrange(1, 5)
        these = [(k, [draw.randrange(3) for _ in range(draw.randrange(0, 9))]) for k in range(4)]
        made = contamination.Automaton(window)
        for _, x in these:
            made.add(x)
        made.finish(these)
        words = [draw.randrange(4) for _ in range(40)]
        hits, names = made.stream(words)
        want, want_names = set(), set()
        for k, x in these:
            n = min(window, len(x))
            grams = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(words) - n + 1):
                if tuple(words[j : j + n]) in grams:
                    want |= set(range(j, j + n))
                    want_names.add(k)
        assert {p + q for p, n in hits for q in range(n)} == want
        assert names == want_names


def test_cut_out(spark):
    item = fixtures.prose(70, 12)
    docs = spark.createDataFrame([(1, "Before it, " + fixtures.prose(2, 30) + " " + item.upper() + "; after é.", "en", "s", 1), (2, item, "en", "s", 1), (3, None, None, None, None)], fixtures.DOCS)
    out = contamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Before it, " + fixtures.prose(2, 30) + " ; after é.", 3: None}


def test_parts_are_jobs_of_their_own(spark):
    """A long item is cut into pieces and items dealt over automata; a task holds one, and the result is the same."""
    docs = spark.createDataFrame(fixtures.documents(), fixtures.DOCS)
    items = [(1, fixtures.prose(1, 180)), (2, fixtures.prose(7, 70)), (3, "one two three"), (4, fixtures.prose(3, 400)), (5, None), (6, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = contamination.digest(contamination.scan(docs, table, carry=["doc_id"]))
    dealt = contamination.scan(docs, table, most_words=50, carry=["doc_id"])
    assert dealt._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, contamination.digest(dealt).collect())) == sorted(map(str, whole.collect()))
    assert contamination.scan(spark.createDataFrame([], fixtures.DOCS), table).count() == 0
