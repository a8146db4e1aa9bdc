"""Predicates by noding, ring sweeps, covers and neighbours against brute force."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import geometry as g
from fieldstrata.functions import noding as nd
from fieldstrata.functions import relations as r
from fieldstrata.operators import covers, spatial
from fieldstrata.sources import adapters


def polygon(*rings):
    return [{"type": "Polygon", "rings": [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]}]


def line(*v):
    return [{"type": "LineString", "rings": [[{"x": float(x), "y": float(y)} for x, y in v]]}]


def points(*v):
    return [{"type": "Point", "rings": [[{"x": float(x), "y": float(y)}]]} for x, y in v]


def box(x, y, n):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


FRAME = polygon(box(0, 0, 9), box(2, 2, 4))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (polygon(box(0, 0, 4)), polygon(box(2, 2, 4)), "212101212"),
        (polygon(box(0, 0, 4)), polygon(box(4, 0, 4)), "FF2F11212"),
        (polygon(box(0, 0, 4)), polygon(box(4, 4, 4)), "FF2F01212"),
        (polygon(box(0, 0, 4)), polygon(box(0, 0, 4)[::-1]), "2FFF1FFF2"),
        (polygon(box(0, 0, 4)), polygon(box(0, 0, 2)), "212F11FF2"),
        (FRAME, polygon(box(3, 3, 1)), "FF2FF1212"),
        (FRAME, polygon(box(2, 2, 4)), "FF2F112F2"),
        (line((0, 0), (4, 4)), line((0, 4), (4, 0)), "0F1FF0102"),
        (line((0, 0), (4, 0)), line((2, 0), (6, 0)), "1010F0102"),
        (line((-2, 2), (6, 2)), polygon(box(0, 0, 4)), "101FF0212"),
        (line((0, 0), (4, 0)), polygon(box(0, 0, 4)), "F1FF0F212"),
        (line((0, 0), (4, 0), (4, 4), (0, 0)), line((1, 0), (2, 0)), "101FFFFF2"),
        (points((0, 0), (2, 0)), line((0, 0), (4, 0)), "00FFFF102"),
        (points((0, 2)), polygon(box(0, 0, 4)), "F0FFFF212"),
        (points((1, 1)), points((1, 1), (2, 2)), "0FFFFF0F2"),
        (polygon(box(0, 0, 1)) + line((0, 0), (1, 1)), points((0, 0)), None),
        (polygon([(0, 0), (1, 0), (float("nan"), 1), (0, 0)]), points((0, 0)), None),
        ([], points((0, 0)), None),
        (None, points((0, 0)), None),
    ],
)
def test_matrix(a, b, want):
    assert nd.relate(a, b) == want
    turned = nd.relate(b, a)
    assert turned == (want and "".join(want[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)))


def star(rand, x, y, grid):
    while True:
        turns = sorted(rand.random() * 2 * math.pi for _ in range(rand.randrange(3, 9)))
        ring = [(x + (1 + 4 * rand.random()) * math.cos(t), y + (1 + 4 * rand.random()) * math.sin(t)) for t in turns]
        ring = [(round(p), round(q)) for p, q in ring] if grid else ring
        ring += ring[:1]
        if brute_simple(ring):
            return ring


def brute_simple(ring):
    edges = [(p, q) for p, q in zip(ring, ring[1:], strict=False) if p != q]
    n = len(edges)
    if n < 3 or len({p for p, _ in edges}) < n:
        return False
    on = lambda e, p: nd.side(*e, p) == 0 and all(min(e[0][k], e[1][k]) <= p[k] <= max(e[0][k], e[1][k]) for k in (0, 1))
    for i in range(n):
        for j in range(i):
            e, f = edges[i], edges[j]
            shared = {p for p, o in ((e[0], f), (e[1], f), (f[0], e), (f[1], e)) if on(o, p)}
            cross = nd.side(*e, f[0]) * nd.side(*e, f[1]) < 0 and nd.side(*f, e[0]) * nd.side(*f, e[1]) < 0
            if len(shared) > 1 if (i - j) % n in (1, n - 1) else (cross or shared):
                return False
    return True


def holds(ring, x, y):
    return sum((b > y) != (d > y) and a + (y - b) / (d - b) * (c - a) > x for (a, b), (c, d) in zip(ring, ring[1:], strict=False)) % 2 == 1


def test_random_polygons_equal_brute_force():
    """Against a fine raster of points: interiors and exteriors that meet are seen there, those that do not are not."""
    rand = random.Random(5)
    for k in range(150):
        a, b = star(rand, 0, 0, k % 2), star(rand, rand.randrange(-5, 6), rand.randrange(-5, 6), k % 2)
        m = nd.relate(polygon(a), polygon(b))
        seen = {(holds(a, x / 4 + 0.013, y / 4 + 0.017), holds(b, x / 4 + 0.013, y / 4 + 0.017)) for x in range(-44, 44) for y in range(-44, 44)}
        for at, pair in ((0, (True, True)), (2, (True, False)), (6, (False, True))):
            assert m[at] == "2" or pair not in seen, (m, a, b)
        cross = any(nd.side(*e, f[0]) * nd.side(*e, f[1]) < 0 and nd.side(*f, e[0]) * nd.side(*f, e[1]) < 0 for e in zip(a, a[1:], strict=False) for f in zip(b, b[1:], strict=False))
        assert not cross or m[0] == m[2] == m[6] == "2"


def test_simple_equals_brute_force():
    rand = random.Random(6)
    for _ in range(1500):
        ring = [(rand.randrange(6), rand.randrange(6)) for _ in range(rand.randrange(3, 9))]
        assert nd.simple(ring + ring[:1]) == brute_simple(ring + ring[:1])


def test_ring_of_100000_vertices():
    n = 100_000
    ring = [(math.cos(2 * math.pi * i / n) * (1 + 0.3 * (i % 2)), math.sin(2 * math.pi * i / n) * (1 + 0.3 * (i % 2))) for i in range(n)]
    start = time.time()
    assert nd.simple(ring + ring[:1])
    assert not nd.simple(ring[:50_000] + [ring[70_000]] + ring[50_000:] + ring[:1])
    assert time.time() - start < 120


def test_faults(spark):
    rows = [
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 6 2, 6 6, 2 2))", ""),
        ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "not simple"),  # a bow-tie
        ("POLYGON ((0 0, 4 0, 4 4, 4 6, 4 4, 0 4, 0 0))", "not simple"),  # a spike
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 4, 2 3, 2 5, 0 4))", ""),  # a hole that touches in one point
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 1, 2 1, 2 3, 0 3, 0 1))", "rings cross"),
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 14 2, 14 4, 2 4, 2 2))", "rings cross"),
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (20 2, 24 2, 24 4, 20 2))", "hole outside"),
        ("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 7 1, 7 7, 1 7, 1 1), (2 2, 4 2, 4 4, 2 4, 2 2))", "rings cross"),
        ("POLYGON ((0 0, 1 0, 0 0))", "few vertices"),
        ("POLYGON ((0 0, 1 0, 1 1, 0 1))", "not closed"),
        ("LINESTRING (0 0, 1 1)", ""),
        ("no geometry", None),
    ]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", F.array_join(r.faults(adapters.read_ewkt(F.col("t"))), ","))
    assert [x.got for x in df.collect()] == [x[1] for x in rows]


def test_predicates(spark):
    rows = [("LINESTRING (-1 2, 6 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), ("LINESTRING (0 0, 4 0)", "LINESTRING (2 0, 6 0)"), ("POINT (0 0)", "POINT (1 1)"), (None, "POINT (1 1)")]
    df = spark.createDataFrame(rows, "a string, b string").select(adapters.read_ewkt(F.col("a")).alias("a"), adapters.read_ewkt(F.col("b")).alias("b"))
    m = df.select("*", r.matrix(F.col("a"), F.col("b")).alias("m"))
    got = m.select(r.predicate("intersects", F.col("m")), r.crosses(F.col("m"), g.dimension(F.col("a")), g.dimension(F.col("b"))), r.overlaps(F.col("m"), g.dimension(F.col("a")), g.dimension(F.col("b"))), r.predicate("disjoint", F.col("m"))).collect()
    assert [tuple(x) for x in got] == [(True, True, False, False), (True, False, True, False), (False, False, False, True), (None,) * 4]


def test_cover_lies_between_its_bounds(spark):
    rand = random.Random(7)
    rings = {i: [star(rand, 20, 10, False)] for i in range(12)}
    rings[12] = [box(10, 10, 9), box(12, 12, 4)]
    rows = [(i, k, n, float(x), float(y)) for i, rs in rings.items() for k, ring in enumerate(rs) for n, (x, y) in enumerate(ring)]
    c = covers.polygon_cover(spark.createDataFrame(rows, "geom int, ring int, seq int, x double, y double"), 9).collect()
    area = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))) / 2
    one = 360 * 180 / 4**9
    for i, rs in rings.items():
        inner, outer = (sum(x.hi - x.lo for x in c if x.geom == i and (x.inside or all_)) * one for all_ in (False, True))
        assert inner <= area(rs[0]) - sum(map(area, rs[1:])) <= outer and outer - inner < 60
        mine = sorted((x.lo, x.hi) for x in c if x.geom == i)
        assert all(p[1] <= q[0] for p, q in zip(mine, mine[1:], strict=False))


def test_overlay_and_merge(spark):
    rand = random.Random(8)
    sides = [[(lo, lo + rand.randrange(1, 9)) for lo in (rand.randrange(200) for _ in range(40))] for _ in range(2)]
    left, right = (spark.createDataFrame(s, "lo long, hi long") for s in sides)
    sets = [{i for lo, hi in s for i in range(lo, hi)} for s in sides]
    o = covers.overlay(left, right, 2).collect()
    for op, test in (("union", sets[0] | sets[1]), ("intersection", sets[0] & sets[1]), ("difference", sets[0] - sets[1]), ("symmetric difference", sets[0] ^ sets[1])):
        rule = {"union": lambda x: True, "intersection": lambda x: x.in_left and x.in_right, "difference": lambda x: x.in_left and not x.in_right, "symmetric difference": lambda x: x.in_left != x.in_right}[op]
        assert sorted(i for x in o if rule(x) for i in range(x.lo, x.hi)) == sorted(test)
    m = sorted((x.lo, x.hi) for x in covers.merged(left, 2).collect())
    assert sorted(i for lo, hi in m for i in range(lo, hi)) == sorted(sets[0])
    assert all(a[1] < b[0] or b[0] % 16 == 0 for a, b in zip(m, m[1:], strict=False))


def metres(a, b):
    dx, (la, lb) = math.radians(b[0] - a[0]), (math.radians(a[1]), math.radians(b[1]))
    return 6378137 * math.atan2(math.hypot(math.cos(lb) * math.sin(dx), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(dx)), math.sin(la) * math.sin(lb) + math.cos(la) * math.cos(lb) * math.cos(dx))


def test_nearest_equal_brute_force(spark, monkeypatch):
    """A crowd, points at one place, poles, the antimeridian and lone points far away."""
    monkeypatch.setattr(spatial, "CROWD", 4)
    rand = random.Random(9)
    at = [(rand.uniform(10, 10.5), rand.uniform(50, 50.5)) for _ in range(60)] + [(11.0, 51.0)] * 9 + [(179.9, 0.0), (-179.9, 0.1), (0.0, 89.9), (120.0, 89.8), (0.0, -90.0), (-70.0, -30.0)]
    rows = [(i, x, y) for i, (x, y) in enumerate(at)]
    df = spark.createDataFrame([*rows, (99, None, None)], "site long, x double, y double")
    for k, others in ((1, False), (3, True), (100, True)):
        got = {(x.left, x.rank): x.right for x in spatial.nearest_sites(df, df, k, others).collect()}
        want = {}
        for i, x, y in rows:
            near = sorted((round(metres((x, y), (u, v)), 6), j) for j, u, v in rows if not others or i != j)[:k]
            want |= {(i, n + 1): j for n, (_, j) in enumerate(near)}
        assert got == want
    assert spatial.nearest_sites(df, df.limit(0)).count() == 0 and spatial.nearest_sites(df.limit(0), df).count() == 0


def test_hausdorff_equals_brute_force(spark):
    rand = random.Random(10)
    v = {i: [(rand.gauss(i, 2), rand.gauss(0, 1)) for _ in range(30)] for i in range(4)} | {4: [(500.0, 1.0)]}
    df = spark.createDataFrame([(i, x, y) for i, ps in v.items() for x, y in ps], "geom int, x double, y double")
    pairs = [(i, j) for i in v for j in v if i < j]
    got = {(x.left, x.right): x.hausdorff for x in spatial.hausdorff_distances(spark.createDataFrame(pairs, "left int, right int"), df).collect()}
    one_way = lambda a, b: max(min(math.dist(p, q) for q in b) for p in a)
    assert got == pytest.approx({(i, j): max(one_way(v[i], v[j]), one_way(v[j], v[i])) for i, j in pairs})
