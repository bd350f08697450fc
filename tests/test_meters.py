"""Reach, walks with a budget and the graph by levels against sequential models."""

import random
from collections import Counter

from lodestone.operators import graph_view, meters


def graph(dice, n=24, m=60):
    kinds, methods = ["calls", "calls", "includes", "co_changes"], ["exact", "exact", "exact", "reference_index"]
    edges = [(f"n{dice.randrange(n)}", f"n{dice.randrange(n)}", dice.choice(kinds), dice.choice(methods), dice.randrange(3), i) for i in range(m)]
    nodes = [(f"n{i}", f"d/f{i % 7}" if i % 11 else None, i % 2 == 0) for i in range(n)]
    return edges, nodes, [f"d/f{i}" for i in range(5)]


def frames(spark, edges, nodes, files):
    return (
        spark.createDataFrame(edges, "src string, dst string, kind string, method string, resolution int, ord int"),
        spark.createDataFrame(nodes, "node string, path string, symbol boolean"),
        spark.createDataFrame([(f,) for f in files], "path string"),
    )


def walk(edges, path, files, starts, depth, most):
    """The walk as a queue."""
    queue, seen, nodes, followed = [(s, 0, 0) for s in dict.fromkeys(starts)], set(starts), [], []
    while queue and len(nodes) < most:
        node, d, weakest = queue.pop(0)
        if d >= depth:
            continue
        for src, dst, kind, method, resolution, _ in edges:
            if dst != node or kind == "co_changes":
                continue
            followed.append((src, dst, resolution))
            if src not in seen:
                seen.add(src)
                outer = method == "reference_index" or (path[src] is not None and path[src] not in files)
                nodes.append((src, d + 1, max(weakest, resolution), outer))
                queue.append((src, d + 1, max(weakest, resolution)))
    return nodes, followed


def test_walks_end_at_their_budget(spark):
    dice = random.Random(3)
    for most in (1, 4, 9, 100):
        edges, nodes, files = graph(dice)
        path, starts = {n: p for n, p, _ in nodes}, {"s1": ["n0"], "s2": ["n3", "n1", "n2"], "s3": ["n9"]}
        rows = spark.createDataFrame([(s, n, i) for s, ns in starts.items() for i, n in enumerate(ns)], "start string, node string, nth int")
        e, n, f = frames(spark, edges, nodes, files)
        for parts in (1, 5):
            met, followed = meters.impact_within(e.repartition(parts), rows, n, f, 3, most)
            for s, own in starts.items():
                want, links = walk(edges, path, files, own, 3, most)
                found = [(r["node"], r["depth"], r["resolution"], r["boundary"]) for r in met.where(f"start = '{s}'").orderBy("depth", "place").collect()]
                assert found == want, (most, s)
                assert Counter((r["src"], r["dst"], r["resolution"]) for r in followed.where(f"start = '{s}'").collect()) == Counter(links)
        counts = {r["start"]: r for r in meters.impact_counts(e, rows, met, followed).collect()}
        want, links = walk(edges, path, files, starts["s2"], 3, most)
        open_out = sum(x[4] == 2 and x[0] in starts["s2"] for x in edges)
        assert (counts["s2"]["nodes"], counts["s2"]["boundary"], counts["s2"]["unresolved"]) == (len(want), sum(x[3] for x in want), sum(x[2] == 2 for x in links) + open_out)


def meter(edges, nodes, files, components, starts):
    path, symbol = {n: p for n, p, _ in nodes}, {n for n, _, s in nodes if s}
    own = {path[s] for s in starts if path.get(s)}
    links = [e for e in edges if e[2] != "co_changes"]
    seen, front, by_depth, outside, met, doubts = set(starts), set(starts), [], set(), set(), Counter()
    while front:
        new, outer = set(), set()
        for src, dst, _, method, resolution, _ in links:
            if dst in front:
                doubts[resolution] += 1
                if src not in seen:
                    new.add(src)
                    if method == "reference_index" or (path[src] is not None and path[src] not in files):
                        outer.add(src)
        seen |= new
        outside |= {path[n] or n for n in outer}
        front = new - outer
        if front:
            by_depth.append(len(front))
        met |= front
    doubts["unresolved"] += sum(e[0] in starts and e[4] == "unresolved" for e in links)
    affected = {path[n] for n in met if path[n]} - own
    parts = lambda paths: {c for c, p in components if p in paths}
    return (len(affected), max(0, len(files) - len(own)), len(met & symbol), len(symbol), len(parts(affected) - parts(own)), by_depth, len(outside), doubts["ambiguous"], doubts["unresolved"])


def test_meters_by_a_sequential_model(spark):
    dice = random.Random(4)
    names = ("resolved", "ambiguous", "unresolved")
    for n, m in ((24, 40), (12, 60)):
        edges, nodes, files = graph(dice, n, m)
        edges = [(*e[:4], names[e[4]], e[5]) for e in edges]
        components = [("c1", "d/f0"), ("c1", "d/f1"), ("c2", "d/f2"), ("c3", "d/f3")]
        starts = {"a": ["n0"], "b": ["n1", "n2"], "c": [f"n{n - 1}"]}
        e = spark.createDataFrame(edges, "src string, dst string, kind string, method string, resolution string, ord int")
        _, nd, f = frames(spark, [(*x[:4], 0, 0) for x in edges], nodes, files)
        found = meters.reach_meter(e, spark.createDataFrame([(s, x) for s, xs in starts.items() for x in xs], "start string, node string"), nd, f, spark.createDataFrame(components, "component string, path string"))
        for r in found.collect():
            got = (r["files"], r["files_total"], r["symbols"], r["symbols_total"], r["components"], r["by_depth"], r["outside"], r["ambiguous"], r["unresolved"])
            assert got == meter(edges, nodes, files, components, starts[r["start"]])
            assert r["lower_bound"] == (r["outside"] > 0 or r["unresolved"] > 0) and r["max_depth"] == len(r["by_depth"])


def view(edges, path, files, component, shown, level, file):
    """The edges of one level, one after another."""
    size, first, groups = Counter(), {}, {}

    def at(node, place):
        p = path.get(node)
        if level == "symbol" and node in shown:
            return node
        if p is None:
            return None
        if p not in files:
            d = "dir:" + (p.rpartition("/")[0] or ".")
            size[d] += 1
            first.setdefault(d, place)
            return d
        if level == "component":
            return component.get(p)
        if level == "file":
            return "file:" + p
        return "file:" + p if file and p != file else None

    for src, dst, kind, resolution, weight, ord_ in sorted(edges, key=lambda e: e[5]):
        if kind == "co_changes" or src not in path or dst not in path:
            continue
        a, b = at(src, (ord_, 0)), at(dst, (ord_, 1))
        if a and b and a != b:
            w, r = groups.get((a, b, kind), (0, 9))
            groups[a, b, kind] = w + weight, min(r, resolution)
    if level == "symbol":
        for _, b, _ in groups:
            size[b] += 1
    dirs = sorted((d for d in size if d.startswith("dir:")), key=lambda d: (-size[d], first[d]))
    gone = set(dirs[graph_view.MOST_DIRECTORIES[level] :])
    return {(*k, *v) for k, v in groups.items() if k[0] not in gone and k[1] not in gone}


def test_views_by_a_sequential_model(spark, monkeypatch):
    monkeypatch.setattr(graph_view, "MOST_DIRECTORIES", {"component": 2, "file": 3, "symbol": 2})
    dice = random.Random(6)
    path = {f"n{i}": (f"in/f{i % 6}" if i % 3 else f"o{i % 9}/x" if i % 2 else "top.c") for i in range(40)} | {"lost": None}
    files = {f"in/f{i}" for i in range(6)}
    component = {f"in/f{i}": f"comp:{i % 2}" for i in range(5)}
    edges = [(dice.choice(list(path)), dice.choice(list(path)), dice.choice(["calls", "includes", "co_changes"]), dice.randrange(3), dice.randrange(1, 4), i) for i in range(160)]
    symbols = [(n, "macro" if i % 5 == 0 else "function", p, float(i % 8)) for i, (n, p) in enumerate(path.items()) if p in files]
    make = spark.createDataFrame
    for file in (None, "in/f1"):
        wanted = graph_view.wanted_symbols(make(symbols, "id string, kind string, path string, criticality double"), 12, file)
        nodes, found = graph_view.graph_view(
            make(edges, "src string, dst string, kind string, resolution int, weight long, ord int"), make(list(path.items()), "node string, path string"),
            make([(f,) for f in files], "path string"), make([(c, p) for p, c in component.items()], "component string, path string"), wanted, file=file,
        )
        shown = {r["id"] for r in wanted.collect()}
        rows = found.collect()
        for level in graph_view.MOST_DIRECTORIES:
            got = {(r["src"], r["dst"], r["kind"], r["weight"], r["resolution"]) for r in rows if r["level"] == level}
            assert got == view(edges, path, files, component, shown, level, file), (level, file)
            ends = {x for g in got for x in g[:2]}
            assert ends <= {r["id"] for r in nodes.where(f"level = '{level}'").collect()}
