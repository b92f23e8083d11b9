"""Deterministic Python programs, one for each id: packages of modules with classes, inheritance, imports, calls through
objects and modules, nested functions, loops and branches, copies and renamed copies. A corpus of any size for what reads code."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, lang string, text string"
PACKAGES = 20
#: Programs of a task: ids are so short that adaptive execution would take all of them for one.
TASK_PROGRAMS = 2000


def place(k: int) -> str:
    return f"gen/m{k % PACKAGES}/p{k}.py"


def _copied(name: str, a: str, b: str, c: str) -> list[str]:
    """The same function under any names."""
    return [f"def {name}({a}, {b}):", f"    {c} = {{}}", f"    for x in {a}:", f"        if x.get({b}) is not None:", f"            {c}[x] = {c}.get(x, 0) + 1", f"    return sorted({c})", ""]


def program(k: int) -> str:
    """The text of program k."""
    draw = random.Random(k)
    other = max(0, k - 1 - draw.randrange(3))
    module = f"gen.m{other % PACKAGES}.p{other}"
    out = ["import os", f"import {module} as other", f"from {module} import Base{other}", "", f"LIMIT = {k % 7}", ""]
    out += [f"class Base{k}:", "    rate = 2", "    def weigh(self, item):", f"        return item * self.rate + {k % 5}", "    def run(self, items, start=0):", "        total = start", "        for item in items:", "            if item > LIMIT:"]
    out += ["                total += self.weigh(item)", "            elif item < 0:", "                continue", "            else:", "                break" if k % 3 else "                raise ValueError(item)", "        return total", ""]
    out += [f"class Child{k}(Base{other}):", "    def scan(self, rows):", f"        return [self.weigh(r) for r in rows if r != {draw.randrange(9)}]", ""]
    for j in range(draw.randrange(1, 4)):
        out += [f"def step_{j}(value, key):", "    try:", f"        while value > {draw.randrange(20)}:", "            value = value - 1", "            if key and value == 3:", "                return value", "    except TypeError as e:", "        print(e)", "    return helper(value)" if draw.random() < 0.5 else f"    return other.step_0(value, key={j})", ""]
    out += ["def helper(value):", "    def inner(x):", "        return x + value + LIMIT", "    pick = lambda y: inner(y)", f"    return pick({draw.randrange(5)}) if value else Base{k}().run([value])", ""]
    out += _copied("tally", "rows", "key", "seen") if k % 4 == 0 else _copied("count_up", "lines", "name", "found") if k % 4 == 1 else []
    out += [f"def test_{k}():", "    assert helper(1) is not None", ""] if k % 5 == 0 else []
    if k % 97 == 96:
        out.append("def broken(:")
    return "\n".join(out)


def programs(ids: DataFrame, key: str) -> DataFrame:
    """path, lang, text of the program of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_pylist()
            yield pa.record_batch([pa.array([place(k) for k in own]), pa.array(["python"] * len(own)), pa.array([program(k) for k in own])], ["path", "lang", "text"])

    own = ids.select(F.col(key).cast("long").alias("id")).where("id >= 0")
    tasks = max(ids.sparkSession.sparkContext.defaultParallelism, -(-own.count() // TASK_PROGRAMS))
    return own.repartition(tasks, "id").distinct().mapInArrow(run, SCHEMA)
