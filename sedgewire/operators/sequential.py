"""Algorithms that are sequential by nature, run per group or per row as Arrow functions."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_orders(orders: list[list[str]]) -> list[str] | None:
    """C3 merge: repeatedly take the first head that stands in no tail; None if there is none."""
    orders = [list(o) for o in orders if o]
    out: list[str] = []
    while orders:
        head = next((o[0] for o in orders if not any(o[0] in other[1:] for other in orders)), None)
        if head is None:
            return None
        out.append(head)
        orders = [rest for o in orders if (rest := o[1:] if o[0] == head else o)]
    return out


def linearize(parents: dict[str, list[str]]) -> dict[str, tuple[list[str], bool]]:
    """Method resolution order of every class and whether it is consistent; a class on a circle has itself alone, an inconsistent one its depth-first order."""
    done: dict[str, tuple[list[str], bool]] = {}

    def circular(c: str) -> bool:
        met, todo = set(), list(parents.get(c, []))
        while todo:
            at = todo.pop()
            if at == c:
                return True
            if at not in met:
                met.add(at)
                todo += parents.get(at, [])
        return False

    def order(c: str) -> list[str]:
        if c not in done:
            if circular(c):
                done[c] = ([c], False)
                return [c]
            ups = [order(p) for p in parents.get(c, [])]
            merged = merge_orders([*ups, parents.get(c, [])])
            done[c] = (list(dict.fromkeys([c, *(x for u in ups for x in u)])), False) if merged is None else ([c, *merged], True)
        return done[c][0]

    for c in sorted(parents):
        order(c)
    return done


def method_resolution(links: DataFrame) -> DataFrame:
    """(tree, class, mro, consistent) from (tree, class, parent, position); one hierarchy per ``tree``, null parent for none.

    A tree is one connected hierarchy of classes and is folded by one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for row in pdf.sort_values(["class", "position"]).itertuples(index=False):
            ups = parents.setdefault(row[1], [])
            if row[2] is not None and row[2] == row[2]:
                ups.append(row[2])
                parents.setdefault(row[2], [])
        found = linearize(parents)
        return pd.DataFrame([(pdf["tree"].iloc[0], c, m, ok) for c, (m, ok) in found.items()], columns=["tree", "class", "mro", "consistent"])

    return links.select("tree", "class", "parent", "position").groupBy("tree").applyInPandas(run, "tree string, class string, mro array<string>, consistent boolean")


def bisect(nodes: list[str], edges: dict[tuple[str, str], float], most: int = 50, density: float = 0.40, passes: int = 10, gain: float = 0.001) -> list[list[str]]:
    """Parts of a graph: split while it has more than ``most`` nodes or is sparser than ``density``, moving nodes while modularity grows."""
    n = len(nodes)
    possible = n * (n - 1) / 2
    if n < 3 or n <= most and len(edges) / possible >= density:
        return [sorted(nodes)]
    weight = {v: 0.0 for v in nodes}
    near: dict[str, dict[str, float]] = {v: {} for v in nodes}
    for (a, b), w in edges.items():
        weight[a] += w
        weight[b] += w
        near[a][b] = near[b][a] = w
    total = sum(edges.values()) or 1.0
    seed = min(nodes, key=lambda v: (weight[v] / max(1, len(near[v])), v))
    side = {v: v == seed or v in near[seed] for v in nodes}
    for _ in range(passes):
        moved = False
        for v in sorted(nodes):
            inside = {s: sum(w for u, w in near[v].items() if side[u] == s) for s in (True, False)}
            mass = {s: sum(weight[u] for u in nodes if side[u] == s and u != v) for s in (True, False)}
            here, there = side[v], not side[v]
            delta = (inside[there] - inside[here]) / total - weight[v] * (mass[there] - mass[here]) / (2 * total * total)
            if delta > gain and sum(side[u] == here for u in nodes) > 1:
                side[v] = there
                moved = True
        if not moved:
            break
    halves = [[v for v in nodes if side[v] == s] for s in (True, False)]
    if not all(halves):
        return [sorted(nodes)]
    return [p for h in halves for p in bisect(h, {e: w for e, w in edges.items() if e[0] in set(h) and e[1] in set(h)}, most, density, passes, gain)]


def split_components(edges: DataFrame) -> DataFrame:
    """(component, member, part) from (component, a, b, w): components too large or too sparse are bisected; a component is folded by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = {(min(a, b), max(a, b)): w for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]) if a != b}
        nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
        parts = bisect(nodes, pairs)
        return pd.DataFrame([(pdf["component"].iloc[0], v, p[0]) for p in parts for v in p], columns=["component", "member", "part"])

    return edges.select("component", "a", "b", "w").groupBy("component").applyInPandas(run, "component string, member string, part string")


_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`")
_DECLARED = re.compile(r"\b(?:function|func|def)\s+(\w+)|\b(?:const|let|var|long|int)\s+(?:\w+\s+)?(\w+)\s*[:=]|\b(\w+)\s*:=")
_PARAMETERS = re.compile(r"\(([^()]*)\)\s*(?::[^{]*)?(?:=>|\{|:)")


def normalize_code(code: str) -> str:
    """Code that differs only in its own names, comments and spacing comes out the same."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    text = _STRING.sub(keep, code)
    text = re.sub(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|(?m:^\s*#[^\n]*)", "", text)
    names: dict[str, str] = {}
    for m in _DECLARED.finditer(text):
        for word, kind in zip(m.groups(), "FVV"):
            if word:
                names.setdefault(word, f"{kind}{len(names)}")
    for m in _PARAMETERS.finditer(text):
        for p in m[1].split(","):
            word = re.match(r"\s*(?:\.\.\.|\*{1,2})?(?:[\w.<>\[\]]+\s+)?(\w+)", p)
            if word:
                names.setdefault(word[1], f"P{len(names)}")
    text = re.sub(r"(?<![.\w])[A-Za-z_]\w*", lambda m: names.get(m[0], m[0]), text)
    text = re.sub(r"\s*([{}()\[\];,.:=+*/<>-])\s*", r"\1", re.sub(r"\s+", " ", text)).strip()
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


@F.pandas_udf(T.StringType())
def normalized_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SHA-256 of the normalised form; null stays null."""
    for batch in batches:
        yield batch.map(lambda s: None if s is None else hashlib.sha256(normalize_code(s).encode()).hexdigest())


def split_parameters(signature: str) -> list[str]:
    """Parameters between the outermost brackets, commas inside nested brackets kept."""
    start = signature.find("(")
    if start < 0:
        return []
    out, depth, at = [], 0, start + 1
    for i in range(start + 1, len(signature)):
        c = signature[i]
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not (c == ">" and signature[i - 1] in "=-"):
            if c == ")" and not depth:
                out.append(signature[at:i])
                break
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(signature[at:i])
            at = i + 1
    return [p.strip() for p in out if p.strip()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("expression", T.StringType()), T.StructField("strength", T.DoubleType())])))
def signature_invariants(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What a signature promises: types of parameters, optional ones, unions, bounds of type parameters, the result."""
    for batch in batches:
        out = []
        for s in batch:
            found: list[tuple[str, float]] = []
            for p in split_parameters(s or ""):
                name, _, kind = p.partition(":")
                kind = kind.split("=")[0].strip()
                if kind:
                    found.append((f"input_type {name.strip().rstrip('?')}: {kind}", 0.85))
                    if "|" in kind:
                        found.append((f"union_type {kind}", 0.80))
                if name.strip().endswith("?") or "=" in p:
                    found.append((f"optional_params {name.strip().rstrip('?').split('=')[0].strip()}", 0.80))
            result = re.search(r"\)\s*(?::|->)\s*(.+)$", s or "")
            if result:
                found.append((f"output_guarantee {result[1].strip()}", 0.85 if "null" not in result[1] else 0.80))
            for bound in re.findall(r"<\s*(\w+ extends [^,>]+)", s or ""):
                found.append((f"type_bound {bound.strip()}", 0.82))
            out.append([{"expression": e, "strength": w} for e, w in dict.fromkeys(found)])
        yield pd.Series(out)


def extract_python(texts: DataFrame) -> DataFrame:
    """(file_id, name, kind, line, end_line, n_params, calls) of every function and class in Python files that parse; others give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, source in zip(batch["file_id"], batch["source_text"]):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))})
                        is_class = isinstance(node, ast.ClassDef)
                        out.append((file_id, node.name, "class" if is_class else "function", node.lineno, node.end_lineno, 0 if is_class else len(node.args.args) + len(node.args.kwonlyargs), calls))
            yield pd.DataFrame(out, columns=["file_id", "name", "kind", "line", "end_line", "n_params", "calls"])

    return texts.select("file_id", "source_text").mapInPandas(run, "file_id string, name string, kind string, line long, end_line long, n_params long, calls array<string>")
