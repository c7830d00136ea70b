import random

from conftest import rows

from sedgewire.operators.components import connected_components
from sedgewire.operators.hierarchy import descendants, hierarchy


def brute(links):
    out = {}
    for n in links:
        seen, at = [], n
        while True:
            if at in seen:
                circle = seen[seen.index(at) :]
                out[n] = (min(circle), -1)
                break
            seen.append(at)
            p = links[at]
            if p is None or p not in links:
                out[n] = (at, len(seen) - 1)
                break
            at = p
    return out


def test_against_brute_force(spark):
    random.seed(7)
    links = {}
    for i in range(400):
        pick = random.random()
        links[f"n{i:03d}"] = None if pick < 0.05 else "gone" if pick < 0.07 else f"n{random.randrange(400):03d}" if pick < 0.12 else f"n{max(0, i - 1 - int(random.random() < 0.2)):03d}"
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    want = brute(links)
    for block in (0, 40, 10_000):  # all rounds as jobs, some, none
        got = {r["node"]: r for r in hierarchy(df, "id", "parent", with_path=block > 0, block=block).collect()}
        assert {n: (r["root"], r["depth"]) for n, r in got.items()} == want
        for n, r in got.items() if block else ():
            assert r["path"] is None if r["depth"] < 0 else len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root"] and all(links[b] == a for a, b in zip(r["path"], r["path"][1:]))


def test_hub_and_long_chain(spark):
    links = {f"c{i:05d}": f"c{i - 1:05d}" if i else None for i in range(3000)} | {f"h{i:05d}": "c02999" for i in range(3000)}
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    for block in (1000, 20_000):
        got = {r["node"]: r["depth"] for r in hierarchy(df, "id", "parent", block=block).collect()}
        assert got["c02999"] == 2999 and got["h00007"] == 3000 and len(got) == 6000


def test_paths_descendants_and_circles(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "c"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), (None, "a")]
    tree = hierarchy(spark.createDataFrame(links, "id string, parent string"), "id", "parent", with_path=True)
    by = {r["node"]: r for r in tree.collect()}
    assert by["d"]["path"] == ["a", "b", "c", "d"] and by["a"]["path"] == ["a"]
    assert (by["z"]["root"], by["z"]["depth"], by["z"]["path"], by["z"]["on_cycle"]) == ("x", -1, None, True)
    assert (by["s"]["root"], by["s"]["depth"]) == ("s", -1)
    assert ("a", "e", 3) in rows(descendants(tree)) and len(rows(descendants(tree))) == 1 + 2 + 3 + 3


def test_empty(spark):
    assert rows(hierarchy(spark.createDataFrame([], "id string, parent string"), "id", "parent")) == []


def test_components(spark):
    random.seed(3)
    edges = [(f"v{random.randrange(120):03d}", f"v{random.randrange(120):03d}") for _ in range(90)] + [("v000", "v000"), (None, "v001")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = sorted((x, find(x)) for x in parent)
    assert rows(connected_components(spark.createDataFrame(edges, "src string, dst string"))) == want
