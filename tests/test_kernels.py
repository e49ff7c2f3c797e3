import numpy as np
import pytest
from pyspark.sql import functions as F

from stopweave.functions import polyline, text
from stopweave.operators import routing

G = routing.Graph({"A": ("a", "c", 10), "B": ("b", "c", 6), "C": ("c", "d", 100)})
THIRD = 2 / 3


@pytest.mark.parametrize(
    "froms,tos,want",
    [
        ([("A", 0), ("B", 0)], [("C", 0)], {(0, 0): 10, (1, 0): 6}),
        ([("A", 0), ("B", 0)], [("C", 0.5)], {(0, 0): 60, (1, 0): 56}),
        ([("A", 0.5), ("B", THIRD)], [("C", 0)], {(0, 0): 5, (1, 0): 2}),
        ([("A", 0.5), ("B", THIRD)], [("C", 0.9)], {(0, 0): 95, (1, 0): 92}),
    ],
)
def test_plain_hops(froms, tos, want):
    assert routing.hops(G, froms, tos, 9999) == want


@pytest.mark.parametrize(
    "froms,tos,start,want",
    [
        ([("A", 0), ("B", 0)], [("C", 0)], [0, 0], {(1, 0): 6}),
        ([("A", 0), ("B", 0)], [("C", 0.5)], [0, 0], {(1, 0): 56}),
        ([("A", 0.5), ("B", THIRD)], [("C", 0)], [0, 0], {(1, 0): 2}),
        ([("A", 0.5), ("B", THIRD)], [("C", 0.9)], [0, 0], {(1, 0): 92}),
        ([("A", 0.5), ("B", 0)], [("C", 0)], [0, 0], {(0, 0): 5}),
        ([("A", 0.5), ("A", 0), ("B", 0)], [("C", 0)], [6, 0, 20], {(0, 0): 5, (1, 0): 10}),
        ([("A", 0.5), ("A", 0), ("B", 0)], [("C", 1)], [6, 0, 20], {(0, 0): 105, (1, 0): 110}),
        ([("A", 0.5), ("A", 0), ("B", 0)], [("C", 1), ("C", 0.5)], [6, 0, 20], {(0, 0): 105, (1, 0): 110, (0, 1): 55, (1, 1): 60}),
    ],
)
def test_fast_hops(froms, tos, start, want):
    assert routing.fast_hops(G, froms, tos, 9999, start) == want


def test_same_edge_bound_and_turns():
    assert routing.hops(G, [("A", 0.25)], [("A", 0.75), ("A", 0.1)], 9999) == {(0, 0): 5}
    assert routing.hops(G, [("A", 0)], [("C", 0.5)], 60) == {}
    banned = routing.Graph(G.edges, {("A", "C"): routing.INFINITE})
    assert routing.hops(banned, [("A", 0), ("B", 0)], [("C", 0)], 9999) == {(1, 0): 6}
    assert G.path("A", "C") == ["A", "C"] and G.path("C", "A") == []


def test_match_prefers_cheap_and_falls_back():
    c = routing.Candidate
    layers = [[c("A", 0, 1), c("B", 0, 0)], [c("C", 0.5, 0), c(None, 0, 2)]]
    total, chosen = routing.match(G, layers, [9999], 1.0)
    assert chosen == [1, 0] and total == pytest.approx(5.6)
    assert routing.match(G, layers, [9999], 1.0, fast=True) == (total, chosen)
    assert routing.match(G, layers, [8], 1.0)[1] == [1, 0]  # the bound doubles to 64
    total, chosen = routing.match(G, [[c("C", 0, 0)], [c("A", 0, 3), c(None, 0, 0)]], [1], 1.0)
    assert chosen == [0, 0] and total == 3


def test_match_patterns(spark):
    edges = spark.createDataFrame([(1, 1, 3, 10), (2, 2, 3, 6), (3, 3, 4, 100)], "eid long, src long, dst long, cost long")
    rows = [("p", 0, 0, 1, 0.0, 1.0, 0), ("p", 0, 1, 2, 0.0, 0.0, 0), ("p", 1, 0, 3, 0.5, 0.0, 9999), ("p", 1, 1, None, 0.0, 2.0, 9999)]
    cands = spark.createDataFrame(rows, "pattern string, pos long, cand long, eid long, progr double, pen double, bound long")
    got = [(r.pos, r.eid, r.path) for r in routing.match_patterns(cands, edges).orderBy("pos").collect()]
    assert got == [(0, 2, []), (1, 3, [2, 3])]
    one = lambda t: t.selectExpr("*", "1 as comp")
    assert [(r.pos, r.eid, r.path) for r in routing.match_patterns(one(cands), one(edges)).orderBy("pos").collect()] == got


def test_polylines():
    line = np.array([[0, 0], [0, 1], [0, 2], [1, 2]], float)
    assert polyline.project(line, np.array([0.5, 0.5])) == (0.5, pytest.approx(0.5 / 3))
    assert polyline.part(line, 1 / 3, 1).tolist() == [[0, 1], [0, 2], [1, 2]]
    assert polyline.part(line, 1, 1 / 3).tolist() == [[1, 2], [0, 2], [0, 1]]
    assert polyline.simplified(line, 0.01).tolist() == [[0, 0], [0, 2], [1, 2]]
    assert polyline.frechet(line, line, 1000.0) == 0
    shifted = line + [0.001, 0]
    assert polyline.frechet(line, shifted) == pytest.approx(111.19, abs=0.05)
    assert polyline.frechet(line, shifted, total=True) == pytest.approx(4 * 111.19, abs=0.5)
    cut = polyline.segments(line, np.array([0, 10, 20, 30.0]), np.array([0, 15, 30.0]))
    assert [c.tolist() for c in cut] == [[[0, 0], [0, 1], [0, 1.5]], [[0, 1.5], [0, 2], [1, 2]]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row


def test_names(spark):
    names = ["haupt", "hauptbahnhof", "old town central station", "central station", "kitten", "sitting", "", "  ", "a b c d e f g h i j k l m n", "l m n", "ñ ü"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rows = pairs.select("a", "b", text.prefix_distance(F.col("a"), F.col("b")), text.best_subsequence(F.col("a"), F.col("b"))).collect()

    def best(a, b):
        found = [0.0]
        for x, y in ((a, b), (b, a)):
            w = x.split()
            runs = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
            found += [1 - edits(r, y)[-1] / max(len(r), len(y), 1) for r in runs]
        return max(found)

    for a, b, prefix, run in rows:
        assert prefix == min(edits(a, b)) and run == pytest.approx(best(a, b)), (a, b)
    assert {(r[0], r[1]): r[3] for r in rows}["a b c d e f g h i j k l m n", "l m n"] == 1.0


def test_replacements():
    assert text.java_replacement(r"\1 & $x\.") == "$1 $0 \\$x."


def test_best_subsequence_takes_all_words():
    words = " ".join(f"w{i}" for i in range(14))
    assert text.best_subsequence(f"{words} central station", "central station") == 1.0


def grid(n, seed):
    """A grid of streets, both ways, with costs that are at least a second for 10 m."""
    rng = np.random.default_rng(seed)
    places = {(x, y): (47 + y * 0.001, 8 + x * 0.001) for x in range(n) for y in range(n)}
    edges = {}
    for x, y in places:
        for to in ((x + 1, y), (x, y + 1)):
            if to in places:
                metres = routing._metres(places[x, y], places[to])
                for a, b in (((x, y), to), (to, (x, y))):
                    edges[len(edges)] = (a, b, int(np.ceil(metres / 10 * 10 * rng.uniform(1, 3))))
    return edges, places


@pytest.mark.parametrize("seed", range(6))
def test_searches_agree(seed):
    """Fast, plain and directed hops choose the same, whatever the candidates cost so far; forbidden turns count."""
    edges, places = grid(7, seed)
    rng = np.random.default_rng(100 + seed)
    ids = list(edges)
    turns = {(a, b): routing.INFINITE if rng.random() < 0.5 else 50 for a in ids for b in ids if edges[a][1] == edges[b][0] and rng.random() < 0.2}
    plain, directed = routing.Graph(edges, turns), routing.Graph(edges, turns, places, 10.0)
    c = routing.Candidate
    layers = [[c(int(e), float(rng.random()), float(rng.random() * 40)) for e in rng.choice(ids, 5)] for _ in range(4)]
    for bound in (150, 400, 2000):
        results = [routing.match(g, layers, [bound] * 3, 0.0083, fast, p := []) + (p,) for g in (plain, directed) for fast in (False, True)]
        assert all(r[0] == pytest.approx(results[0][0]) for r in results)
        for (total, chosen, paths), g in zip(results, (plain, plain, directed, directed), strict=True):
            for k, path in enumerate(paths):
                a, b = layers[k][chosen[k]], layers[k + 1][chosen[k + 1]]
                if path:
                    assert path[0] == a.eid and path[-1] == b.eid
                    assert all(edges[x][1] == edges[y][0] and turns.get((x, y), 0) < routing.INFINITE for x, y in zip(path, path[1:], strict=False))


def test_bound_is_for_the_path_alone():
    """What candidates cost so far does not widen a search."""
    edges = {n: (n, n + 1, 100) for n in range(1000)}
    g = routing.Graph(edges)
    met = []
    g = g.priced(lambda e, cost: met.append(e) or cost)
    assert routing.fast_hops(g, [(0, 0), (500, 0)], [(3, 0)], 350, [0, 40], 0.0083) == {(0, 0): 300}
    assert len(met) < 20


def test_mismatches():
    assert routing.mismatched(101, 0, (1.2, 1.1, 1.05)) == 140  # 121.2, 133.1, 139.65
    assert routing.mismatched(101, 7, (1.2, 1.1, 1.05)) == 101
    assert routing.mismatched(101, 0, (1.0, 1.1, 1.05)) == 101
    assert routing.mismatched(101, 1, (0.5, 0.5, 1.0)) == 51
    assert routing.best_bits([1, 6, 4]) == 6 and routing.best_bits([]) == 0


def test_lines_and_turns_of_patterns(spark):
    """Two ways from 1 to 4: the trip's line, a forbidden turn and a large graph's components decide."""
    edges = [(12, 1, 2, 100, None), (24, 2, 4, 100, None), (13, 1, 3, 110, [7]), (34, 3, 4, 110, [7]), (45, 4, 5, 10, [7]), (1, 0, 1, 10, [7])]
    e = spark.createDataFrame(edges, "eid long, src long, dst long, cost long, lines array<long>")
    rows = [("p", 0, 0, 1, 0.0, 0.0, 0), ("p", 1, 0, 45, 0.5, 0.0, 9999)]
    cands = spark.createDataFrame(rows, "pattern string, pos long, cand long, eid long, progr double, pen double, bound long")
    path = lambda c, e, **x: routing.match_patterns(c, e, **x).filter("pos = 1").first().path
    assert path(cands, e) == [1, 12, 24, 45]
    like = cands.selectExpr("*", "array(struct(7L as line, 7 as bits)) as like")
    assert path(like, e, factors=(1.2, 1.1, 1.05)) == [1, 13, 34, 45]
    banned = spark.createDataFrame([(12, 24)], "from_eid long, to_eid long")
    one = lambda t: t.selectExpr("*", "1 as comp")
    assert path(cands, e, turns=banned) == path(one(cands), one(e), turns=banned) == [1, 13, 34, 45]
    dear = banned.selectExpr("*", "15L as cost")
    assert path(cands, e, turns=dear) == [1, 12, 24, 45]
