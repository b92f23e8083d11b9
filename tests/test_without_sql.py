"""Registered queries that no SQL stands beside, against plain Python or hand-made results, by name."""

import ast
import json
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from textloom.operators import flow
from textloom.plans import catalogue, graph_plans
from textloom.sources import corpus

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalogue.QUERIES[name](spark, FOLDER).collect()


def test_baseline_fingerprints(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()

    def fnv(x):
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    want = {d["doc_id"]: fnv("ÿ".join(str(x) for x in (d["doc_id"], d["text"]) if x is not None)) for d in docs}
    assert {r.doc_id: r.fingerprint for r in rows(spark, "baseline_fingerprints")} == want


def patched(before, diff):
    """``before`` with a unified diff applied."""
    old, out, at = before.splitlines(True), [], 0
    for line in diff.splitlines(True)[2:]:
        if line.startswith("@@"):
            start = int(line.split()[1].split(",")[0][1:]) - 1
            out += old[at:start]
            at = start
        elif line[0] in " -":
            assert old[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
        elif line[0] == "+":
            out.append(line[1:])
    return "".join(out + old[at:])


def test_unified_diff(spark):
    from textloom.plans import stream_plans

    given = {p: (a or "", b or "") for p, a, b in stream_plans._DIFF}
    for r in rows(spark, "unified_diff"):
        a, b = given[r.path]
        assert (patched(a, r.diff) if r.diff else a) == b and a[: r.edit.start] + r.edit.replacement + a[r.edit.end :] == b


def test_streamed_windows_are_those_that_have_closed(spark):
    batch = {(r.start, r.event_type): (r.n, r.total) for r in rows(spark, "tumbling_windows")}
    streamed = {(r.start, r.event_type): (r.n, r.total) for r in rows(spark, "streamed_windows")}
    assert streamed and all(batch[k] == v for k, v in streamed.items())
    missing = {k[0] for k in batch} - {k[0] for k in streamed}
    assert not missing or min(missing) > max(k[0] for k in streamed)


def test_sarif_log_holds_all_findings(spark):
    (r,) = rows(spark, "sarif_log")
    log = json.loads(r.sarif)
    results = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and len(results) == len(rows(spark, "sarif_results"))
    assert {x["ruleId"] for x in results} == {x["id"] for x in log["runs"][0]["tool"]["driver"]["rules"]}


def test_module_restructure(spark):
    module = dict(graph_plans.FILES)
    size = Counter(module.values())
    edges = {(a, b) for a, b, *_ in graph_plans.EDGES if a != b}
    ties = defaultdict(Counter)
    for a, b, *_ in graph_plans.EDGES:
        if a != b:
            ties[a][module[b]] += 1
            ties[b][module[a]] += 1
    want = {("move", f, m) for f, own in ties.items() for m, n in own.items() if m != module[f] and n > own[module[f]] and size[module[f]] > 1}
    for m in size:
        inside = [f for f in module if module[f] == m]
        after = defaultdict(list)
        for a, b in edges:
            if module[a] == module[b] == m:
                after[a].append(b)
                after[b].append(a)
        parts = {min(flow.reach(f, after)) for f in inside}
        if len(parts) > 1:
            want.add(("split", m, str(len(parts))))
    across = {(module[a], module[b]) for a, b in edges if module[a] != module[b]}
    want |= {("merge", a, b) for a, b in across if a < b and (b, a) in across}
    assert {(r.kind, r.subject, r.target) for r in rows(spark, "module_restructure")} == want


def test_contracts(spark):
    roles = {(r.ix, r.name): r.role for r in rows(spark, "contract_roles")}
    assert {n: r for (ix, n), r in roles.items() if ix == 0} == {"owner": "consumer", "reader": "consumer", "other": "consumer", "test_rate": "test", "build_row": "producer", "verify_row": "verifier", "check_in": "verifier", "check_out": "verifier"}
    assert roles[2, "publish"] == "identity" and roles[2, "count"] == "telemetry"
    assert [tuple(r) for r in rows(spark, "untested_dimensions")] == [(0, "m.py", "join_all", 1)]
    (chain,) = rows(spark, "adoption_chain_incomplete")
    assert (chain.ix, chain.path, chain.owner, chain.families, chain.n) == (0, "a.py", "owner", "consumer,test", 2)
    found = {r.ix: r for r in rows(spark, "contract_extraction")}
    assert found[0].loops == 1 and found[0].config_keys == "LIMIT" and found[1].config_keys == "" and found[1].calls == ["log.info(rows)"]


def functions():
    for path, lang, text in corpus.FILES:
        if lang == "python":
            for f in ast.walk(ast.parse(text)):
                if isinstance(f, ast.FunctionDef):
                    yield path, f


def test_cfg_points_are_the_statements(spark):
    got = defaultdict(Counter)
    for r in rows(spark, "cfg_points"):
        got[r.path, r.owner][r.kind] += 1
    for path, f in functions():
        own = [x for x in ast.walk(f) if isinstance(x, ast.stmt) and x is not f]
        kinds = got[path, f.name]
        assert sum(kinds.values()) == len(own) + 2 and kinds["entry"] == kinds["exit"] == 1
        assert kinds["branch"] == sum(isinstance(x, ast.If) for x in own) and kinds["loop"] == sum(isinstance(x, (ast.For, ast.While)) for x in own) and kinds["return"] == sum(isinstance(x, ast.Return) for x in own)


@pytest.fixture(scope="module")
def graphs_by_owner(spark):
    out = defaultdict(list)
    for r in rows(spark, "cfg_edges"):
        out[r.path, r.owner].append((r.src, r.dst, r.kind))
    return out


def test_cfg_edges_reach_everything(graphs_by_owner):
    for (path, name), edges in graphs_by_owner.items():
        after = defaultdict(list)
        for a, b, _ in edges:
            after[a].append(b)
        assert flow.reach(0, after) >= {1} and 1 not in after
        for a, own in after.items():
            kinds = {k for x, _, k in edges if x == a}
            assert len(set(own)) == 1 or kinds in ({"true", "false"}, {"case", "none"}, {"next", "raise"}, {"true", "back"}, {"false", "back"})


def test_program_dependences_by_definition(spark, graphs_by_owner):
    """A point depends on another in control if some way on from that one always comes to it, and not every way does."""
    got = defaultdict(set)
    for r in rows(spark, "program_dependences"):
        if r.kind == "control":
            got[r.path, r.owner].add((r.src, r.dst))
    for key, edges in graphs_by_owner.items():
        after = defaultdict(list)
        for a, b, _ in edges:
            after[a].append(b)
        points = flow.reach(0, after)

        def always(frm, to):
            """Whether every way from ``frm`` to the exit passes ``to``."""
            return frm == to or 1 not in flow.reach(frm, {a: [b for b in m if b != to] for a, m in after.items() if a != to})

        want = {(b, a) for a in points for b in points if b != 1 and any(always(s, b) for s in set(after[a])) and not (a != b and always(a, b))} if points else set()
        want = {(b, a) for b, a in want if len(set(after[a])) > 1}
        assert got[key] == want, key


def test_cross_file_findings_of_the_corpus(spark):
    """The renamed copy of the corpus is found as near, the plain one as a duplicate; the first file never."""
    found = {(r.path, r.rule, r.first_key) for r in rows(spark, "cross_file_findings") if r.path.startswith("app/copy")}
    assert ("app/copy_b.py", "duplicate-block", "app/copy_a.py") in found and ("app/copy_c.py", "near-duplicate", "app/copy_a.py") in found
    assert not any(p == "app/copy_a.py" for p, *_ in found)


NAMED = {
    "adoption_chain_incomplete", "baseline_fingerprints", "cfg_edges", "cfg_points", "contract_extraction", "contract_roles", "cross_file_findings", "module_restructure", "program_dependences", "sarif_log",
    "streamed_windows", "unified_diff", "untested_dimensions",
    # tests/test_sequences.py, tests/test_syntax.py, tests/test_records.py, tests/test_slice_queries.py, tests/test_constants.py, tests/test_markup.py and tests/test_engine.py hold what these apply
    "in_file_duplicates", "call_and_base_resolution", "callable_summaries", "clone_repetition", "dependency_graph", "import_layers", "node_reanchoring", "parse_provenance", "subtree_fingerprints", "system_dependences",
    "deterministic_commit", "guard_facts", "masked_sources", "control_facts", "control_regions", "program_points",
    "event_regions", "event_arms", "page_clones", "page_fragments", "page_nodes",
}


def test_every_query_without_sql_is_held_by_a_test():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == NAMED
