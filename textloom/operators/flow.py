"""Control flow and data flow, one owner at a time.

Graphs of single functions are tiny and many, so each is one group: lowering of Python sources with the standard
library's parser, dominators, regions, reaching definitions, liveness and dependences run in plain sets inside
``mapInPandas`` where the texts are, and inside ``applyInPandas`` for graphs given as rows. Owners are independent; the
largest function bounds a task's memory.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Edges = dict[int, list[int]]


def reach(start: int, after: Edges) -> set[int]:
    seen, stack = {start}, [start]
    while stack:
        for n in after.get(stack.pop(), ()):
            if n not in seen:
                seen.add(n)
                stack.append(n)
    return seen


def turned(after: Edges) -> Edges:
    out: Edges = {}
    for a, many in after.items():
        for b in many:
            out.setdefault(b, []).append(a)
    return out


def dominators(root: int, after: Edges) -> dict[int, set[int]]:
    """dom(n) = {n} and what dominates all predecessors, among the points reached from the root."""
    domain, before = reach(root, after), turned(after)
    dom = {n: {n} if n == root else set(domain) for n in domain}
    changed = True
    while changed:
        changed = False
        for n in sorted(domain - {root}):
            own = {n} | set.intersection(*(dom[p] for p in before[n] if p in domain))
            if own != dom[n]:
                dom[n], changed = own, True
    return dom


def immediate(dom: dict[int, set[int]]) -> dict[int, int | None]:
    """The strict dominator that all other strict ones dominate."""
    return {n: max(d - {n}, key=lambda x: len(dom[x]), default=None) for n, d in dom.items()}


def cycles(points: Iterable[int], after: Edges) -> list[set[int]]:
    """Strongly connected sets of more than one point, or with a self-loop."""
    forward = {n: reach(n, after) for n in points}
    out, seen = [], set()
    for n in sorted(forward):
        own = {m for m in forward[n] if n in forward[m]}
        if n not in seen and (len(own) > 1 or n in after.get(n, ())):
            out.append(own)
        seen |= own
    return out


def reaching(after: Edges, root: int, defs: dict[int, list[tuple[int, str]]]) -> dict[int, set[tuple[int, str]]]:
    """Definitions (point, name) that reach the entry of each point; a later one at a point kills earlier ones."""
    before, domain = turned(after), reach(root, after)
    into: dict[int, set] = {n: set() for n in domain}
    changed = True
    while changed:
        changed = False
        for n in sorted(domain):
            new = set()
            for p in before.get(n, ()):
                if p in domain:
                    own = {name for _, name in defs.get(p, ())}
                    new |= {x for x in into[p] if x[1] not in own} | set(defs.get(p, ()))
            if new != into[n]:
                into[n], changed = new, True
    return into


def live(after: Edges, points: Iterable[int], defs: dict[int, set[str]], uses: dict[int, set[str]]) -> dict[int, set[str]]:
    """Names live at the entry of each point: (out - defined) and used."""
    into: dict[int, set[str]] = {n: set() for n in points}
    changed = True
    while changed:
        changed = False
        for n in sorted(into, reverse=True):
            out = set().union(*(into[m] for m in after.get(n, ())))
            own = (out - defs.get(n, set())) | uses.get(n, set())
            if own != into[n]:
                into[n], changed = own, True
    return into


def control_dependences(after: Edges, root: int, leave: int) -> set[tuple[int, int]]:
    """(depends, on): walk up post-dominators from each branch's target to the branch's own."""
    post = dominators(leave, turned(after))
    up, seen = immediate(post), reach(root, after)
    out = set()
    for a in seen:
        for b in after.get(a, ()):
            if a in post and b in post and b not in post[a]:
                runner: int | None = b
                while runner is not None and runner != up[a]:
                    out.add((runner, a))
                    runner = up[runner]
    return out


class Lowered:
    """Points and edges of one function: 0 is the entry, 1 the exit."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.points: list[tuple[str, int]] = [("entry", function.lineno), ("exit", function.end_lineno or function.lineno)]
        self.edges: set[tuple[int, int, str]] = set()
        self.defs: dict[int, list[str]] = {0: [a.arg for a in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]]}
        self.uses: dict[int, set[str]] = {}
        self._ends(self._body(function.body, [(0, "next")], []), 1)

    def _point(self, kind: str, node: ast.AST, into: list[tuple[int, str]], *parts: ast.AST | None) -> int:
        self.points.append((kind, node.lineno))
        n = len(self.points) - 1
        self._ends(into, n)
        for part in parts:
            for x in ast.walk(part) if part is not None else ():
                if isinstance(x, ast.Name):
                    if isinstance(x.ctx, ast.Load):
                        self.uses.setdefault(n, set()).add(x.id)
                    else:
                        self.defs.setdefault(n, []).append(x.id)
        if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            self.uses.setdefault(n, set()).add(node.target.id)
        return n

    def _ends(self, into: list[tuple[int, str]], n: int) -> None:
        self.edges |= {(a, n, kind) for a, kind in into}

    def _body(self, body: list[ast.stmt], into: list[tuple[int, str]], loops: list[tuple[int, list]]) -> list[tuple[int, str]]:
        for node in body:
            if isinstance(node, ast.If):
                n = self._point("branch", node, into, node.test)
                into = self._body(node.body, [(n, "true")], loops) + self._body(node.orelse, [(n, "false")], loops)
            elif isinstance(node, (ast.While, ast.For, ast.AsyncFor)):
                n = self._point("loop", node, into, *([node.test] if isinstance(node, ast.While) else [node.target, node.iter]))
                left: list[tuple[int, str]] = []
                self._ends([(a, "back") for a, _ in self._body(node.body, [(n, "true")], [*loops, (n, left)])], n)
                into = self._body(node.orelse, [(n, "false")], loops) + left
            elif isinstance(node, ast.Match):
                n, out = self._point("match", node, into, node.subject), []
                for case in node.cases:
                    out += self._body(case.body, [(n, "case")], loops)
                whole = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in node.cases)
                into = out if whole else [*out, (n, "none")]
            elif isinstance(node, ast.Return):
                self._ends([(self._point("return", node, into, node.value), "return")], 1)
                into = []
            elif isinstance(node, ast.Raise):
                self._ends([(self._point("raise", node, into, node.exc), "raise")], 1)
                into = []
            elif isinstance(node, (ast.Break, ast.Continue)) and loops:
                n = self._point(type(node).__name__.lower(), node, into)
                head, left = loops[-1]
                if isinstance(node, ast.Break):
                    left.append((n, "break"))
                else:
                    self._ends([(n, "back")], head)
                into = []
            elif isinstance(node, (ast.With, ast.AsyncWith)):
                n = self._point("with", node, into, *(i.context_expr for i in node.items), *(i.optional_vars for i in node.items))
                into = self._body(node.body, [(n, "next")], loops)
            elif isinstance(node, (ast.Try, ast.TryStar)):
                n = self._point("try", node, into)
                out = self._body(node.orelse, self._body(node.body, [(n, "next")], loops), loops)
                for handler in node.handlers:
                    out += self._body(handler.body, [(self._point("except", handler, [(n, "raise")], handler.type), "next")], loops)
                into = self._body(node.finalbody, out, loops)
            else:
                into = [(self._point("statement", node, into, node), "next")]
        return into

    def after(self) -> Edges:
        out: Edges = {}
        for a, b, _ in sorted(self.edges):
            if b not in out.setdefault(a, []):
                out[a].append(b)
        return out


def functions(text: str) -> list[tuple[str, Lowered]]:
    """Name and graph of each function of a Python source; none where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    return [(f.name, Lowered(f)) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]


#: Texts whose rows are held at once.
SLICE_TEXTS = 200


def over_texts(files: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over slices of the Python sources, where they are: nothing is shuffled, and no source is a group of its own."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), SLICE_TEXTS):
                yield run(batch.iloc[low : low + SLICE_TEXTS])

    return files.where("lang = 'python'").select("path", "text").mapInPandas(each, schema)


POINTS = "path string, owner string, point long, kind string, line long, idom long, ipdom long, live string, reaching string"


def lowered_points(files: DataFrame) -> DataFrame:
    """Points of every Python function: kind, line, immediate (post-)dominators, live names, definitions that reach."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, text in zip(group["path"], group["text"], strict=True):
            for name, g in functions(text):
                after = g.after()
                up, down = immediate(dominators(0, after)), immediate(dominators(1, turned(after)))
                into = reaching(after, 0, {p: [(p, n) for n in dict.fromkeys(ns)] for p, ns in g.defs.items()})
                alive = live(after, range(len(g.points)), {p: set(n) for p, n in g.defs.items()}, g.uses)
                for p, (kind, line) in enumerate(g.points):
                    rows.append((path, name, p, kind, line, up.get(p), down.get(p), ",".join(sorted(alive[p])), ",".join(sorted(f"{n}@{q}" for q, n in into.get(p, ())))))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in POINTS.split(", ")])
        return out.astype({"idom": "Int64", "ipdom": "Int64"})

    return over_texts(files, run, POINTS)


EDGES = "path string, owner string, src long, dst long, kind string"


def lowered_edges(files: DataFrame, dependences: bool = False) -> DataFrame:
    """Control-flow edges of every Python function, or its control and flow dependences (src depends on dst)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, text in zip(group["path"], group["text"], strict=True):
            for name, g in functions(text):
                after = g.after()
                if not dependences:
                    rows += [(path, name, a, b, k) for a, b, k in sorted(g.edges)]
                    continue
                rows += [(path, name, a, b, "control") for a, b in sorted(control_dependences(after, 0, 1))]
                into = reaching(after, 0, {p: [(p, n) for n in dict.fromkeys(ns)] for p, ns in g.defs.items()})
                rows += sorted({(path, name, p, q, f"flow {n}") for p, names in g.uses.items() for q, n in into.get(p, ()) if n in names})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])

    return over_texts(files, run, EDGES)


def owner_dominators(edges: DataFrame, owner: str, root: int, points: str = "long") -> DataFrame:
    """owner, point, idom, depth for graphs given as rows (owner, src, dst) of small integers."""
    kind = dict(edges.dtypes)[owner]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        after: Edges = {}
        for a, b in zip(group["src"], group["dst"], strict=True):
            after.setdefault(int(a), []).append(int(b))
        dom = dominators(root, after)
        up = immediate(dom)
        out = pd.DataFrame([(group[owner].iloc[0], p, up[p], len(dom[p])) for p in sorted(dom)], columns=[owner, "point", "idom", "depth"])
        return out.astype({"idom": "Int64"})

    return edges.groupBy(owner).applyInPandas(run, f"{owner} {kind}, point {points}, idom {points}, depth long")


REGIONS = "path string, owner string, kind string, head long, leave long, points long, parent long"


def structured(after: Edges, root: int, leave: int) -> list[tuple[str, int, int | None, set[int]]]:
    """(kind, head, where it is left to, points) of the regions of a graph: a loop is a back edge's head with what reaches the
    edge without passing the head; a branch is a point of several ways with what it dominates before they meet again."""
    reached = reach(root, after)
    dom, post = dominators(root, after), dominators(leave, turned(after))
    meet = immediate(post)
    before = turned(after)
    loops: dict[int, set[int]] = {}
    for a in reached:
        for b in after.get(a, ()):
            if b in dom[a]:
                body, stack = loops.setdefault(b, {b}), [a]
                while stack:
                    x = stack.pop()
                    if x not in body:
                        body.add(x)
                        stack += [p for p in before.get(x, ()) if p in reached]
    out: list[tuple[str, int, int | None, set[int]]] = [("root", root, leave, set(reached))]
    for head, body in sorted(loops.items()):
        left = {b for x in body for b in after.get(x, ()) if b not in body}
        out.append(("loop", head, left.pop() if len(left) == 1 else None, body))
    for x in sorted(reached - set(loops)):
        if len(after.get(x, ())) > 1:
            end = meet.get(x)
            inside, stack = {x}, [y for y in after[x] if y != end]
            while stack:
                y = stack.pop()
                if y not in inside and y in reached and x in dom[y]:
                    inside.add(y)
                    stack += [z for z in after.get(y, ()) if z != end]
            out.append(("branch", x, end, inside))
    return out


def control_regions(files: DataFrame) -> DataFrame:
    """Regions of every Python function: kind, head, the point that it is left to (null where there are several), how many points, and
    the head of the smallest region around."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, text in zip(group["path"], group["text"], strict=True):
            for name, g in functions(text):
                found = structured(g.after(), 0, 1)
                for k, (kind, head, left, points) in enumerate(found):
                    around = [(len(p), h) for j, (_, h, _, p) in enumerate(found) if j != k and points < p]
                    rows.append((path, name, kind, head, left, len(points), min(around)[1] if around else None))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")])
        return out.astype({"leave": "Int64", "parent": "Int64"})

    return over_texts(files, run, REGIONS)


FACTS = "path string, owner string, point long, fact string"


def unstructured(g: Lowered) -> list[tuple[int, str]]:
    """(point, fact) of what leaves the structure: breaks, continues, returns and raises before the end, points never
    reached, loops left in several ways, entered past their head, or never left."""
    after = g.after()
    reached, dom = reach(0, after), dominators(0, after)
    out = []
    for p, (kind, _) in enumerate(g.points):
        if p not in reached:
            out.append((p, "unreached"))
        elif kind in ("break", "continue", "raise"):
            out.append((p, kind))
        elif kind == "return" and p != max(reached):
            out.append((p, "early return"))
    for part in cycles(reached, after):
        heads = {b for a in reached - part for b in after.get(a, ()) if b in part}
        left = {b for a in part for b in after.get(a, ()) if b not in part}
        if len(heads) > 1 or any(h not in dom[x] for h in heads for x in part):
            out += [(h, "entered past its head") for h in sorted(heads)]
        if len(left) > 1:
            out.append((min(part), "left in several ways"))
        if not left:
            out.append((min(part), "never left"))
    return sorted(set(out))


def control_facts(files: DataFrame) -> DataFrame:
    """``unstructured`` of every Python function."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(path, name, p, fact) for path, text in zip(group["path"], group["text"], strict=True) for name, g in functions(text) for p, fact in unstructured(g)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return over_texts(files, run, FACTS)
