"""Surprisal against its SQL over odd rows, and against plain Python whatever the batches, slices and tasks."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from textloom.operators import sequences
from textloom.operators import surprisal as U
from textloom.plans.catalogue import ORACLES, QUERIES

WORDS = [f"w{k}" for k in range(60)] + ["über", "a_b", "X9", "<START>", "naïve", "\U0001f600x"]


def text(draw, n):
    return "".join(draw.choice(WORDS) + draw.choice([" ", "\n", ", ", "\t"]) for _ in range(n))


def odd_rows():
    """Regions of many rows, rows without region, language, text or words, and regions alone in their language."""
    draw = random.Random(4)
    rows = [(draw.choice([1, 2, 3, None, *range(10, 200)]), text(draw, draw.randrange(0, 60)), draw.choice(["en", "de", None])) for _ in range(400)]
    return rows + [(7, "alone a b a", "fr"), (8, "", "fr"), (9, None, "en"), (500, "... !", "en"), (501, "x", "en"), (502, "x x x x", "en"), (503, text(draw, 3000), "en")]


def plain(rows):
    """(lang, region): mean, p90, most."""
    pairs, totals, words = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for region, t, lang in rows:
        found = re.findall("[A-Za-z0-9_]+", t or "") if lang is not None else []
        for a, b in zip(["<START>", *found], found, strict=False):
            pairs[lang, region][a, b] += 1
            totals[lang][a, b] += 1
            totals[lang][a,] += 1
            words[lang].add(b)
    out = {}
    for (lang, region), own in pairs.items():
        if region is None or own.total() == sum(n for k, n in totals[lang].items() if len(k) == 2):
            continue
        local = Counter()
        for (a, _), n in own.items():
            local[a] += n
        bits = sorted(-math.log2((totals[lang][a, b] - n + 1) / (totals[lang][a,] - local[a] + len(words[lang]) + 1)) for (a, b), n in own.items() for _ in range(n))
        at = (len(bits) - 1) * 0.9
        low, high = bits[math.floor(at)], bits[math.ceil(at)]
        out[lang, region] = [sum(bits) / len(bits), low + (high - low) * (at - math.floor(at)), bits[-1]]
    return out


def got(df):
    return {(r.lang, r.region): [r.mean, r.p90, r.most] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=2e-6), k


def test_odd_rows_equal_the_sql(spark, tmp_path):
    spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r[:2]): list(r[2:]) for r in con.execute(f"SELECT lang, region, mean, p90, most FROM ({ORACLES['surprisal']})").fetchall()}
    found = QUERIES["surprisal"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) > 150  # a row without a document is not measured, and none comes twice
    close({(r.lang, r.region): [r.mean, r.p90, r.most] for r in found}, want)
    close(want, plain(odd_rows()))


def test_batches_slices_and_tasks_change_nothing(spark, monkeypatch):
    rows, most = odd_rows(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(U, "TASK_CHARS", 5000)
    table = spark.createDataFrame(rows, "id long, text string, lang string")
    before = spark.conf.get(most)
    try:
        for n in (1, 7):
            spark.conf.set(most, n)
            close(got(U.surprisal(table, "id")), plain(rows))
    finally:
        spark.conf.set(most, before)
    close(got(U.surprisal(table.withColumn("id", table.id.cast("string")), "id")), {(a, str(b)): v for (a, b), v in plain(rows).items()})
    assert U.surprisal(table.limit(0), "id").count() == 0


def test_slices_hold_whole_regions_of_one_language(monkeypatch):
    """Slices are the same wherever batches end."""
    monkeypatch.setattr(sequences, "SLICE_BYTES", 40)
    rows = [(p, lang, region, text(random.Random(region or 0), 6)) for p in (3, 9) for lang in "ab" for region in [None, None, *sorted(k // 3 for k in range(20))]]
    whole = pa.table({c: pa.array(v) for c, v in zip(("part", "lang", "region", "text"), zip(*rows, strict=True), strict=True)})
    want = [(part, number, t.to_pylist(), first.tolist()) for part, number, t, first in U._slices(iter(whole.to_batches()))]
    for size in (1, 2, 4, 7):
        batches = whole.to_batches(max_chunksize=size)
        assert [(part, number, t.to_pylist(), first.tolist()) for part, number, t, first in U._slices(iter([*batches[:3], batches[0].slice(0, 0), *batches[3:]]))] == want
    assert [r for _, _, found, _ in want for r in found] == whole.to_pylist()
    assert len({x[:2] for x in want}) == len(want) > 20
    seen = set()
    for part, _, found, first in want:
        assert len({(r["part"], r["lang"]) for r in found}) == 1 and found[0]["part"] == part
        here = {(part, r["lang"], r["region"]) for r in found if r["region"] is not None}
        assert not here & seen and len(first) == len(here) + sum(r["region"] is None for r in found)
        seen |= here


def test_pairs_are_no_rows(spark, tmp_path):
    """What is shuffled are packed rows of slices and buckets, however many pairs the texts have."""
    draw = random.Random(8)
    rows = [(k, " ".join(f"v{draw.randrange(3000)}" for _ in range(1000)), "en") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(context._jvm.double, 0)

    def records():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = records()
    assert QUERIES["surprisal"](spark, str(tmp_path)).count() == 200
    assert 0 < records() - before < 2000  # pairs: about 195,000
