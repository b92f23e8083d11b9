"""Trees of pages against stacks and plain loops; fragments against lists side by side; clones against written-out subtrees."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from textloom.operators import markup, nesting
from textloom.plans.catalogue import QUERIES
from textloom.sources import pages as P

DATA = "/root/testdata/sf0.001"


def plain_tokens(html):
    """Tokens of markup that has tags and texts alone."""
    at = 0
    for part in re.split(r"(<[^>]*>)", html):
        m = re.fullmatch(r"<(/?)(\w+)\s*([^>/]*?)(/?)>", part)
        if m:
            step = -1 if m[1] else 0 if m[4] or m[2] in P.VOID else 1
            yield step, m[2], m[3].strip(), at, at + len(part)
        elif part.strip():
            yield 0, P.TEXT, " ".join(part.split()), at, at + len(part)
        at += len(part)


def plain_tree(tokens, length):
    """Rows (parent, ordinal, depth, name, value, size, start, stop) by a stack for each name and loops over all before."""
    tokens = list(tokens)
    stacks, closed = defaultdict(list), {}
    for k, (step, name, *_) in enumerate(tokens):
        if step > 0:
            stacks[name].append(k)
        elif step < 0 and stacks[name]:
            closed[stacks[name].pop()] = k
    nodes = [k for k, t in enumerate(tokens) if t[0] >= 0]
    inside, stop = {}, {}
    for k in nodes:
        step, _, _, start, end = tokens[k]
        stop[k] = tokens[closed[k]][4] if k in closed else start if step else end
        inside[k] = stop[k] if k in closed else start

    def around(k):
        return next((j for j in reversed(nodes) if j < k and inside[j] > tokens[k][3]), None)

    loose = [k for k in nodes if tokens[k][0] > 0 and k not in closed]
    ends = {k: min([inside[around(k)] if around(k) is not None else length] + [tokens[j][3] for j in nodes if j > k and tokens[j][:2] == tokens[k][:2]][:1]) for k in loose}
    inside |= ends
    stop |= ends
    rows, depth, number, seen = [], {}, {k: n for n, k in enumerate(nodes)}, Counter()
    for k in nodes:
        up = around(k)
        depth[k] = 0 if up is None else depth[up] + 1
        rows.append([None if up is None else number[up], seen[up], depth[k], tokens[k][1], tokens[k][2], 1, tokens[k][3], stop[k]])
        seen[up] += 1
    for r in reversed(rows):
        if r[0] is not None:
            rows[r[0]][5] += r[5]
    return rows


def got_rows(pages):
    t = P.trees(pages)
    out = [[] for _ in pages]
    if t is None:
        return out
    base = np.searchsorted(t.page, t.page)
    for i, k in enumerate(t.page):
        up = None if t.parent[i] < 0 else int(t.parent[i] - base[i])
        out[k].append([up, int(t.ordinal[i]), int(t.depth[i]), t.name[i], t.value[i], int(t.size[i]), int(t.start[i]), int(t.stop[i])])
    return out


def random_page(draw):
    return "".join(draw.choice(["<a>", "</a>", "<b>", "</b>", "<li>", "</li>", "<br>", "<b/>", "x", " ", "y z", '<a c="1">']) for _ in range(draw.randint(0, 25)))


def test_trees_against_loops():
    draw = random.Random(3)
    pages = [random_page(draw) for _ in range(600)]
    for html, got in zip(pages, got_rows(pages), strict=True):
        assert got == plain_tree(plain_tokens(html), len(html)), html


def test_tokens_and_trees_of_given_pages():
    """Against the standard library's tokeniser, whose texts are cut at references and comments alike."""
    pages = pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist()

    class Tags(HTMLParser):
        def handle_starttag(self, tag, attrs):
            self.found.append((0 if tag in P.VOID else 1, tag))

        def handle_endtag(self, tag):
            self.found.append((-1, tag))

        def handle_data(self, data):
            if data.strip() and self.found[-1] != (0, P.TEXT):
                self.found.append((0, P.TEXT))

        def handle_comment(self, data):
            self.found.append("comment")

    for html, got in zip(pages, got_rows(pages), strict=True):
        tags = Tags(convert_charrefs=True)
        tags.found = ["start"]
        tags.feed(html)
        tags.close()
        assert [t[:2] for t in P._tokens(html)] == [t for t in tags.found if isinstance(t, tuple)]
        assert got == plain_tree(P._tokens(html), len(html))


def test_odd_pages():
    rows = got_rows(["", None, " \n", "<!-- <p>a</p> --><!DOCTYPE x>", "<script>a<b>c</script >d", "<STYLE>x", "<p title='a>b' >t</P>", "a < b <c", "<title></title>"])
    assert [[(r[3], r[4], r[0]) for r in page] for page in rows] == [
        [], [], [], [],
        [("script", "", None), ("#text", "a<b>c", 0), ("#text", "d", None)], [("style", "", None), ("#text", "x", 0)],
        [("p", "title='a>b'", None), ("#text", "t", 0)], [("#text", "a < b <c", None)], [("title", "", None)],
    ]
    deep = 30000
    t = P.trees(["<a>" * deep + "x" + "</a>" * deep])
    assert list(t.depth) == list(range(deep + 1)) and list(t.size) == list(range(deep + 1, 0, -1))


def test_search_and_common_lengths_against_loops():
    draw = random.Random(4)
    for n in range(40):
        values, at = (np.array([draw.randrange(9) for _ in range(n)], np.int64) for _ in range(2))
        assert list(nesting.previous_above(values, at)) == [next((j for j in range(i - 1, -1, -1) if values[j] > at[i]), -1) for i in range(n)]
    values = np.array([draw.randrange(2) for _ in range(300)], np.uint64)
    runs = nesting.Runs(values)
    pairs = [(draw.randrange(100, 200), draw.randrange(100, 200), draw.randrange(60)) for _ in range(500)]
    a, b, most = map(np.array, zip(*pairs, strict=True))
    common = lambda i, j, m, s: next((k for k in range(m) if values[i + s * k] != values[j + s * k]), m)
    assert list(runs.alike(a, b, most)) == [common(i, j, m, 1) for i, j, m in pairs]
    assert list(runs.alike(a, b, most, backwards=True)) == [common(i - 1, j - 1, m, -1) for i, j, m in pairs]


def arms_page(draw):
    item = lambda: draw.choice(["<p>a</p>", "<p>b</p>", "<br>", "t<br>", "<i><b>a</b>c</i>"])
    shared, end = [item() for _ in range(draw.randint(0, 2))], [item() for _ in range(draw.randint(0, 2))]
    arms = ["<li>" + "".join([*shared, *[item() for _ in range(draw.randint(0, 2))], *end]) + "</li>" for _ in range(draw.randint(1, 4))]
    return "<ul>" + draw.choice(["", "x", "<u>1</u>"]).join(arms) + "</ul>" + "".join(arms[:2])


def written(rows, values):
    """Each node's subtree as nested tuples."""
    under = defaultdict(list)
    for n, r in enumerate(rows):
        under[r[0]].append(n)

    def tell(n):
        return (rows[n][3], rows[n][4] if values else "", *map(tell, under[n]))

    return under, tell


def plain_fragments(rows, values):
    under, tell = written(rows, values)
    out = set()
    for up, nodes in list(under.items()):
        run = []
        for n in [*nodes, None]:
            fits = n is not None and bool(under[n]) and rows[n][3] != P.TEXT
            if run and not (fits and rows[n][3] == rows[run[0]][3]):
                lists = [[tell(c) for c in under[a]] for a in run]
                if len(run) > 1:
                    prefix = next((k for k in range(min(map(len, lists))) if len({x[k] for x in lists}) > 1), min(map(len, lists)))
                    rest = [x[prefix:][::-1] for x in lists]
                    suffix = next((k for k in range(min(map(len, rest))) if len({x[k] for x in rest}) > 1), min(map(len, rest)))
                    size = lambda some: sum(rows[c][5] for c in some) * (len(run) - 1)  # noqa: E731, B023
                    head = (up, run[0], rows[run[0]][3], len(run))
                    if all(x == lists[0] for x in lists):
                        out.add((*head, "equivalent-arms", prefix, size(under[run[0]])))
                    else:
                        if prefix:
                            out.add((*head, "common-prefix", prefix, size(under[run[0]][:prefix])))
                        if suffix:
                            out.add((*head, "common-suffix", suffix, size(under[run[0]][-suffix:])))
                run = []
            if fits:
                run.append(n)
    return out


def test_fragments_against_lists(spark):
    draw = random.Random(5)
    pages = {k: arms_page(draw) for k in range(300)}
    kinds = Counter()
    table = spark.createDataFrame([*pages.items(), (-1, None), (-2, "")], "page_id long, html string").repartition(3)
    for values in (True, False):
        got = defaultdict(set)
        for r in markup.fragments(table, ["page_id"], values=values).collect():
            got[r.page_id].add((r.parent, r.first, r.name, r.arms, r.kind, r.parts, r.saved))
            kinds[r.kind] += 1
        assert got == {k: want for k, html in pages.items() if (want := plain_fragments(got_rows([html])[0], values))}
    assert all(kinds[k] > 50 for k in ("equivalent-arms", "common-prefix", "common-suffix"))


def plain_clones(pages, least):
    holders, size, above = defaultdict(list), {}, defaultdict(set)
    for key, html in pages:
        rows = got_rows([html])[0]
        _, tell = written(rows, True)
        for n, r in enumerate(rows):
            if r[5] >= least:
                what = tell(n)
                holders[what].append((key, n))
                size[what] = r[5]
                above[what].add(None if r[0] is None else tell(r[0]))
    out = Counter()
    for what, held in holders.items():
        over = next(iter(above[what])) if len(above[what]) == 1 else None
        if len(held) >= 2 and not (over is not None and len(holders[over]) == len(held)):
            out[what[0], size[what], len(held), min(held)] += 1
    return out


def test_clones_against_written_subtrees(spark):
    draw = random.Random(6)
    pages = [(k, arms_page(draw)) for k in range(120)] + [(200, None), (201, "")]
    table = spark.createDataFrame(pages, "page_id long, html string").repartition(4)
    got = markup.clones(table, ["page_id"]).collect()
    assert Counter((r.name, r.nodes, r.holders, (r.first.page_id, r.first.node)) for r in got) == plain_clones(pages, markup.LEAST_NODES)
    assert all(r.pages <= r.holders for r in got) and any(r.pages < r.holders for r in got) and len(got) > 20


def test_queries_over_given_pages(spark):
    rows = pq.read_table(f"{DATA}/pages.parquet").select(["page_id", "url", "html"]).to_pylist()
    trees = {(r["page_id"], r["url"]): got_rows([r["html"]])[0] for r in rows}
    got = defaultdict(dict)
    for r in QUERIES["page_nodes"](spark, DATA).collect():
        got[r.page_id, r.url][r.node] = [r.parent, r.ordinal, r.depth, r.name, r.value, r.nodes, r.start, r.stop]
    assert got == {k: dict(enumerate(v)) for k, v in trees.items()}
    found = defaultdict(set)
    for r in QUERIES["page_fragments"](spark, DATA).collect():
        found[r.page_id, r.url, r.exact].add((r.parent, r.first, r.name, r.arms, r.kind, r.parts, r.saved))
    assert found == {(*k, exact): want for k, v in trees.items() for exact in (True, False) if (want := plain_fragments(v, exact))}
    want = plain_clones([((r["page_id"], r["url"]), r["html"]) for r in rows], markup.LEAST_NODES)
    got = QUERIES["page_clones"](spark, DATA).collect()
    assert Counter((r.name, r.nodes, r.holders, ((r.first_page_id, r.first_url), r.first_node)) for r in got) == want


def test_cases(spark):
    """Repeated rows are pages of their own; columns of clashing names stay out; empty tables have no rows."""
    html = "<ul><li>1<b>2</b></li><li>1<b>2</b></li></ul>"
    table = spark.createDataFrame([(1, html, 7, "x"), (1, html, 7, "x"), (None, html, 8, "y")], "page_id long, `a.b` string, node long, name string")
    assert markup.nodes(table, ["page_id"], "a.b").count() == 27
    assert sorted((r.page_id or 0, r.kind, r.saved) for r in markup.fragments(table, ["page_id"], "a.b").collect()) == [(0, "equivalent-arms", 3), (1, "equivalent-arms", 3), (1, "equivalent-arms", 3)]
    assert [(r.name, r.nodes, r.holders, r.pages) for r in sorted(markup.clones(table, ["page_id"], "a.b").collect(), key=lambda r: r.nodes)] == [("li", 4, 6, 3), ("ul", 9, 3, 3)]
    for f in (markup.nodes, markup.fragments, markup.clones):
        assert f(table.limit(0), ["page_id"], "a.b").count() == 0


def test_a_batch_is_never_strings_at_once():
    """Slices take their own pages alone out of a batch, whatever its size, and leave none out."""
    pages = [f"<p>{k}</p>" + "x" * (99_000 + k) for k in range(300)] + [None, "", "<b>" + "y" * (3 * P.SLICE), "<i>z</i>", None]
    batch = pa.record_batch([pa.array(pages)], ["html"])
    whole = sum(len(x or "") for x in pages)
    tracemalloc.start()
    places = [(low + int(p), name) for low, t in P.slices(batch, "html") for p, name in zip(t.page, t.name, strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert places == [(k, name) for k, x in enumerate(pages) if x for name in ([x[1], P.TEXT, P.TEXT] if x[1] == "p" else [x[1], P.TEXT])]
    assert peak < whole * 0.75, (peak, whole)


def test_both_kinds_of_fragments_take_one_pass(spark):
    draw = random.Random(12)
    table = spark.createDataFrame([(k, arms_page(draw)) for k in range(60)], "page_id long, html string").repartition(3)
    both = markup.fragments(table, ["page_id"], values=None)
    want = Counter((*r, exact) for exact in (True, False) for r in markup.fragments(table, ["page_id"], values=exact).collect())
    assert Counter(map(tuple, both.collect())) == want and {r[-1] for r in want} == {True, False}
    assert QUERIES["page_fragments"](spark, DATA)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
