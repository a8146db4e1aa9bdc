"""Queries on how geometries lie to each other: predicates by noding, ring faults, meetings of segments, covers, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import relations as r
from ..functions import shapes
from ..operators import covers
from ..operators import long_lines as ll
from ..operators import measures as m
from ..operators import spatial as s
from ..sources import datasets as d
from .joins import NEAR
from .registry import query


def plots(spark, sf_dir):
    """(id, g): a plot for every part, with sides along the axes: an L, a frame around a hole, or a rectangle."""
    p = d.table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") * 3 % 200 + F.floor(F.col("p_partkey") / 2000) * 200, F.col("p_partkey") * 7 % 160
    w, h = F.col("p_size") % 5 + 4, F.col("p_size") % 3 + 4
    ring = lambda *v: F.array(*[g.vertex(x + i, y + j) for i, j in v])
    box = lambda i, j, k, n: ring((i, j), (k, j), (k, n), (i, n), (i, j))
    ell = g.polygon(F.array(ring((0, 0), (w, 0), (w, 2), (2, 2), (2, h), (0, h), (0, 0))))
    frame = g.polygon(F.array(box(0, 0, w, h), box(1, 1, w - 1, h - 1)))
    kind = F.col("p_partkey") % 3
    return p.select(F.col("p_partkey").alias("id"), F.when(kind == 0, ell).when(kind == 1, frame).otherwise(g.polygon(F.array(box(0, 0, w, h)))).alias("g"))


#: The unit cells of the plots.
CELLS = (
    "q AS (SELECT p_partkey AS id, p_partkey * 3 % 200 + p_partkey // 2000 * 200 AS x, p_partkey * 7 % 160 AS y, p_size % 5 + 4 AS w, p_size % 3 + 4 AS h, p_partkey % 3 AS kind FROM part), "
    "cells AS (SELECT id, x + i AS cx, y + j AS cy FROM q, LATERAL (SELECT unnest(range(0, w)) AS i) a, LATERAL (SELECT unnest(range(0, h)) AS j) b WHERE kind = 2 OR (kind = 0 AND (i < 2 OR j < 2)) OR (kind = 1 AND (i IN (0, w - 1) OR j IN (0, h - 1))))"
)


@query(
    f"WITH {CELLS}, near AS (SELECT DISTINCT a.id AS first, b.id AS second FROM cells a JOIN cells b ON a.id < b.id AND b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND b.cy BETWEEN a.cy - 1 AND a.cy + 1), "
    "common AS (SELECT a.id AS first, b.id AS second, count(*) AS n FROM cells a JOIN cells b ON a.id < b.id AND a.cx = b.cx AND a.cy = b.cy GROUP BY 1, 2), sizes AS (SELECT id, count(*) AS n FROM cells GROUP BY id) "
    "SELECT first, second, n IS NULL AS touches, coalesce(n < least(sa, sb), FALSE) AS overlaps, coalesce(n = sa, FALSE) AS within, coalesce(n = sb, FALSE) AS contains, coalesce(n = sb, FALSE) AS covers, coalesce(n = sa AND n = sb, FALSE) AS equals "
    "FROM near LEFT JOIN common c USING (first, second) JOIN (SELECT id AS first, n AS sa FROM sizes) USING (first) JOIN (SELECT id AS second, n AS sb FROM sizes) USING (second)"
)
def j15_plot_relations(spark, sf_dir):
    """Plots that meet, concave ones and ones with holes among them, and how they lie to each other."""
    p = plots(spark, sf_dir)
    near = s.met_boxes(p, p, 8.0).where("id < id_").select("id", "id_", r.matrix(F.col("g"), F.col("g_")).alias("m"))
    of = lambda name: r.predicate(name, F.col("m")).alias(name)
    near = near.where(of("intersects"))
    return near.select(F.col("id").alias("first"), F.col("id_").alias("second"), of("touches"), r.overlaps(F.col("m"), 2, 2).alias("overlaps"), of("within"), of("contains"), of("covers"), of("equals"))


@query(
    f"WITH {CELLS}, l AS (SELECT c_custkey AS line, c_custkey * 11 % 200 + c_custkey // 1500 * 200 AS x, c_custkey * 13 % 160 AS y, c_custkey % 2 AS up, 1 + c_custkey % 7 AS n FROM customer), "
    "u AS (SELECT line, n, up, x + i * (1 - up) AS ux, y + i * up AS uy FROM l, LATERAL (SELECT unnest(range(0, n)) AS i) t), "
    # a unit of the line lies between two cells, beside (up) or above and below each other
    "k AS (SELECT line, n, up, ux, uy, id, count(*) AS sides FROM u JOIN cells ON (up = 0 AND cx = ux AND cy IN (uy, uy - 1)) OR (up = 1 AND cy = uy AND cx IN (ux, ux - 1)) GROUP BY ALL), "
    "t AS (SELECT line, id, any_value(n) AS n, count(*) AS covered, count(*) FILTER (sides = 2) AS inside FROM k GROUP BY line, id), "
    "p AS (SELECT DISTINCT line, id FROM l, LATERAL (SELECT unnest(range(0, n + 1)) AS i) t JOIN cells ON cx IN (x + i * (1 - up), x + i * (1 - up) - 1) AND cy IN (y + i * up, y + i * up - 1)) "
    "SELECT p.line, p.id AS plot, coalesce(inside, 0) = 0 AS touches, coalesce(inside > 0 AND covered < n, FALSE) AS crosses, coalesce(inside > 0 AND covered = n, FALSE) AS within, coalesce(covered = n, FALSE) AS covered_by FROM p LEFT JOIN t USING (line, id)"
)
def j15_line_relations(spark, sf_dir):
    """Lines along the axes and the plots they meet."""
    k = F.col("c_custkey")
    x, y, n = k * 11 % 200 + F.floor(k / 1500) * 200, k * 13 % 160, k % 7 + 1
    line = g.line(F.array(g.vertex(x, y), g.vertex(x + n * (1 - k % 2), y + n * (k % 2))))
    lines = d.table(spark, sf_dir, "customer").select(k.alias("id"), line.alias("g"))
    near = s.met_boxes(lines, plots(spark, sf_dir), 8.0).select("id", "id_", r.matrix(F.col("g"), F.col("g_")).alias("m"))
    of = lambda name: r.predicate(name, F.col("m")).alias(name)
    return near.where(of("intersects")).select(F.col("id").alias("line"), F.col("id_").alias("plot"), of("touches"), r.crosses(F.col("m"), 1, 2).alias("crosses"), of("within"), of("covered_by"))


@query(f"WITH {CELLS}, p AS (SELECT c_custkey AS site, c_custkey * 11 % 200 + c_custkey // 1500 * 200 AS x, c_custkey * 13 % 160 AS y FROM customer), n AS (SELECT site, id AS plot, count(*) AS n FROM p JOIN cells ON cx IN (x, x - 1) AND cy IN (y, y - 1) GROUP BY ALL) SELECT site, plot, n = 4 AS within, TRUE AS covered_by, n < 4 AS touches FROM n")
def j08_points_covered(spark, sf_dir):
    """Points and the plots that cover them; those on the boundary are covered, but not within."""
    k = F.col("c_custkey")
    points = d.table(spark, sf_dir, "customer").select(k.alias("id"), g.point(k * 11 % 200 + F.floor(k / 1500) * 200, k * 13 % 160).alias("g"))
    near = s.met_boxes(points, plots(spark, sf_dir), 8.0).select("id", "id_", r.matrix(F.col("g"), F.col("g_")).alias("m"))
    of = lambda name: r.predicate(name, F.col("m")).alias(name)
    return near.where(of("covered_by")).select(F.col("id").alias("site"), F.col("id_").alias("plot"), of("within"), of("covered_by"), of("touches"))


#: Rings of six events of a user in a row; no two vertices of a ring are equal.
RINGS = (
    "e AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_id FROM events), "
    "v AS (SELECT track, place // 6 AS ring, place % 6 AS i, event_id * 37 % 40 AS x, event_id * 53 % 29 * 6 + place % 6 AS y, count(*) OVER (PARTITION BY track, place // 6) AS n FROM e), "
    "s AS (SELECT a.track, a.ring, a.i, a.n, a.x, a.y, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.track = b.track AND a.ring = b.ring AND b.i = (a.i + 1) % a.n), "
    "o AS (SELECT a.track, a.ring, b.i - a.i IN (1, a.n - 1) AS beside, (a.x2 - a.x) * (b.x2 - b.x) + (a.y2 - a.y) * (b.y2 - b.y) AS way, "
    "sign((a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x)) AS p, sign((a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x)) AS q, sign((b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x)) AS r, sign((b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x)) AS t, "
    "greatest(least(a.x, a.x2), least(b.x, b.x2)) <= least(greatest(a.x, a.x2), greatest(b.x, b.x2)) AND greatest(least(a.y, a.y2), least(b.y, b.y2)) <= least(greatest(a.y, a.y2), greatest(b.y, b.y2)) AS boxes "
    "FROM s a JOIN s b ON a.track = b.track AND a.ring = b.ring AND a.i < b.i AND a.n > 2)"
)


@query(f"WITH {RINGS}, bad AS (SELECT DISTINCT track, ring FROM o WHERE CASE WHEN beside THEN p = 0 AND q = 0 AND way < 0 ELSE boxes AND p * q <= 0 AND r * t <= 0 END) SELECT track, ring, CASE WHEN any_value(n) < 3 THEN 'few vertices' WHEN count(bad.track) > 0 THEN 'not simple' ELSE '' END AS faults FROM v LEFT JOIN bad USING (track, ring) GROUP BY track, ring")
def g09_ring_faults(spark, sf_dir):
    """Rings of six places of a track in a row, and what is wrong with them."""
    p = d.track_points(spark, sf_dir).select("track", (F.col("seq") - 1).alias("at"), "event")
    v = p.select("track", F.floor(F.col("at") / 6).alias("ring"), (F.col("at") % 6).alias("i"), (F.col("event") * 37 % 40).alias("x"), (F.col("event") * 53 % 29 * 6 + F.col("at") % 6).alias("y"))
    v = v.groupBy("track", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda q: g.vertex(q["x"], q["y"])).alias("v"))
    ring = F.concat(F.col("v"), F.slice("v", 1, 1))
    return v.select("track", "ring", F.array_join(r.faults(g.polygon(F.array(ring))), ",").alias("faults"))


_EDGES = "e AS (SELECT geom, ring, seq, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM polygons WINDOW w AS (PARTITION BY geom, ring ORDER BY seq)), f AS (SELECT * FROM e WHERE u IS NOT NULL)"
_MET = (
    "k AS (SELECT a.id AS left, f.geom AS right, (f.v - f.y) * (a.x2 - a.x) - (f.u - f.x) * (a.y2 - a.y) AS det, (f.u - f.x) * (a.y - f.y) - (f.v - f.y) * (a.x - f.x) AS ta, (a.x2 - a.x) * (a.y - f.y) - (a.y2 - a.y) * (a.x - f.x) AS tb, a.x, a.y, a.x2, a.y2, f.x AS fx, f.y AS fy, f.u, f.v "
    "FROM a JOIN f ON greatest(a.x, a.x2) >= least(f.x, f.u) AND least(a.x, a.x2) <= greatest(f.x, f.u) AND greatest(a.y, a.y2) >= least(f.y, f.v) AND least(a.y, a.y2) <= greatest(f.y, f.v)), "
    "h AS (SELECT \"left\", \"right\", CASE WHEN det <> 0 THEN round(x + ta / det * (x2 - x), 6) + 0 END AS px, CASE WHEN det <> 0 THEN round(y + ta / det * (y2 - y), 6) + 0 END AS py FROM k WHERE (det <> 0 AND ta / det BETWEEN 0 AND 1 AND tb / det BETWEEN 0 AND 1) OR (det = 0 AND ta = 0)) "
    "SELECT \"left\", \"right\", CASE WHEN count(px) > 0 THEN 'Intersection' ELSE 'Coincident' END AS status, count(DISTINCT (px, py)) FILTER (px IS NOT NULL) AS points, coalesce(min(px), 0) AS first_x, coalesce(max(py), 0) AS last_y FROM h GROUP BY ALL"
)


def _met(a, b):
    """Where the segments of a and of b meet, worked out for one geometry of each class of equal ones."""
    (a, of_left), (b, of_right) = (s.classes(x, "k", "x", "y", "x2", "y2") for x in (a, b))
    found = s.meeting_shapes(s.meetings(a, b, 1.0))
    x, y = F.transform("points", lambda p: F.round(p["x"], 6) + 0.0), F.transform("points", lambda p: F.round(p["y"], 6) + 0.0)
    found = found.select("left", "right", "status", F.size("points").cast("long").alias("points"), F.coalesce(F.array_min(x), F.lit(0.0)).alias("first_x"), F.coalesce(F.array_max(y), F.lit(0.0)).alias("last_y"))
    return s.members(s.members(found, "left", of_left), "right", of_right)


@query(f"WITH {d.SITES}, {d.POLYGONS}, {_EDGES}, a AS (SELECT site AS id, x, y, x + site % 9 / 4e0 AS x2, y + site % 5 / 2e0 AS y2 FROM sites WHERE site % 9 > 0 OR site % 5 > 0), {_MET}")
def j11_lines_and_polygons(spark, sf_dir):
    """Where the lines from the sites meet the polygons."""
    k = F.col("site")
    a = d.sites(spark, sf_dir).select(k.alias("geom"), F.lit(0).alias("k"), "x", "y", (F.col("x") + k % 9 / 4).alias("x2"), (F.col("y") + k % 5 / 2).alias("y2"))
    b = m.segments(d.polygons(spark, sf_dir)).select("geom", F.struct("ring", "seq").alias("k"), "x", "y", "x2", "y2")
    return _met(a, b)


@query(f"WITH {d.SITES}, {d.POLYGONS}, {_EDGES}, b AS (SELECT site AS id, floor(x * 2) / 2 AS x, floor(y * 2) / 2 AS y FROM sites), a AS (SELECT id, x, y, x + 1 AS x2, y AS y2 FROM b UNION ALL SELECT id, x + 1, y, x + 1, y + 2 FROM b UNION ALL SELECT id, x + 1, y + 2, x, y + 2 FROM b UNION ALL SELECT id, x, y + 2, x, y FROM b), {_MET}")
def j11_rectangles_and_polygons(spark, sf_dir):
    """Where rectangles by the sites and polygons meet with their edges; shared edges give their ends where others cross."""
    p = d.sites(spark, sf_dir).select(F.col("site").alias("geom"), (F.floor(F.col("x") * 2) / 2).alias("x"), (F.floor(F.col("y") * 2) / 2).alias("y"))
    corners = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 2), (0, 2), (0, 0))])
    v = p.select("geom", F.lit(0).alias("ring"), F.posexplode(corners).alias("seq", "v")).select("geom", "ring", "seq", "v.x", "v.y")
    a, b = (m.segments(x).select("geom", F.struct("ring", "seq").alias("k"), "x", "y", "x2", "y2") for x in (v, d.polygons(spark, sf_dir)))
    return _met(a, b)


LEVELS = 10
_GRID = (
    f"v AS (SELECT geom, ring, seq, (x + 180) / 360 * {1 << LEVELS} AS x, (y + 90) / 180 * {1 << LEVELS} AS y FROM polygons), "
    "e AS (SELECT * FROM (SELECT geom, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM v WINDOW w AS (PARTITION BY geom, ring ORDER BY seq)) WHERE u IS NOT NULL), "
    "b AS (SELECT geom, floor(min(x))::INT - 1 AS a, floor(min(y))::INT - 1 AS b, floor(max(x))::INT + 1 AS c, floor(max(y))::INT + 1 AS d FROM v GROUP BY geom), "
    "k AS (SELECT geom, i AS cx, j AS cy FROM b, LATERAL (SELECT unnest(range(a, c + 1)) AS i) p, LATERAL (SELECT unnest(range(b, d + 1)) AS j) q), "
    "o AS (SELECT k.*, x, y, u - x AS dx, v - y AS dy, cx - 1e-9 AS x0, cx + 1 + 1e-9 AS x1, cy - 1e-9 AS y0, cy + 1 + 1e-9 AS y1, "
    "((y < cy + 0.5 AND v >= cy + 0.5) OR (v < cy + 0.5 AND y >= cy + 0.5)) AND x + (cy + 0.5 - y) / (v - y) * (u - x) < cx + 0.5 AS hit FROM k JOIN e USING (geom)), "
    "t AS (SELECT geom, cx, cy, count(*) FILTER (hit) % 2 = 1 AS inside, bool_or((dx <> 0 OR x BETWEEN x0 AND x1) AND (dy <> 0 OR y BETWEEN y0 AND y1) AND "
    "greatest(0, CASE WHEN dx <> 0 THEN least((x0 - x) / dx, (x1 - x) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((y0 - y) / dy, (y1 - y) / dy) ELSE 0 END) <= least(1, CASE WHEN dx <> 0 THEN greatest((x0 - x) / dx, (x1 - x) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y0 - y) / dy, (y1 - y) / dy) ELSE 1 END)) AS met FROM o GROUP BY geom, cx, cy)"
)


@query(f"WITH {d.POLYGONS}, {_GRID} SELECT geom, count(*) FILTER (inside AND NOT met) AS inner_cells, count(*) AS outer_cells FROM t WHERE inside OR met GROUP BY geom")
def x02_polygon_covers(spark, sf_dir):
    """Finest cells that lie inside each polygon and that it meets, from covers of mixed cells."""
    c = covers.polygon_cover(d.polygons(spark, sf_dir), LEVELS)
    size = F.col("hi") - F.col("lo")
    return c.groupBy("geom").agg(F.sum(F.when(F.col("inside"), size).otherwise(0)).alias("inner_cells"), F.sum(size).alias("outer_cells"))


@query(
    f"WITH {d.POLYGONS}, {_GRID}, l AS (SELECT DISTINCT cx, cy FROM t WHERE (inside OR met) AND geom % 2 = 0), r AS (SELECT DISTINCT cx, cy FROM t WHERE (inside OR met) AND geom % 3 = 0) "
    "SELECT 'union' AS op, count(*) AS cells FROM (FROM l UNION FROM r) UNION ALL SELECT 'intersection', count(*) FROM (FROM l INTERSECT FROM r) UNION ALL SELECT 'difference', count(*) FROM (FROM l EXCEPT FROM r) UNION ALL SELECT 'symmetric difference', count(*) FROM ((FROM l EXCEPT FROM r) UNION ALL (FROM r EXCEPT FROM l))"
)
def x02_cover_overlay(spark, sf_dir):
    """Union, intersection and differences of two areas of many polygons, as ranges of cells."""
    c = covers.polygon_cover(d.polygons(spark, sf_dir), LEVELS)
    o = covers.overlay(c.where("geom % 2 = 0"), c.where("geom % 3 = 0"), LEVELS).select(F.expr("hi - lo").alias("n"), "in_left", "in_right")
    sums = o.agg(*[F.sum(F.when(F.expr(test), F.col("n")).otherwise(0)).alias(op) for op, test in covers.OPERATIONS.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(op).alias("cells")) for op in covers.OPERATIONS])).alias("s")).select("s.op", "s.cells")


_NEAREST = "SELECT \"left\", \"right\", round(metres, 3) AS metres, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY \"left\" ORDER BY round(metres, 6), \"right\")::INT AS k FROM p) WHERE k <= "


@query(f"WITH {d.SITES}, p AS (SELECT a.site AS left, b.site AS right, {NEAR} AS metres FROM sites a JOIN sites b ON a.site <> b.site) {_NEAREST}3")
def j12_nearest_three(spark, sf_dir):
    """Of every site the three nearest others, however far."""
    p = d.sites(spark, sf_dir)
    return s.nearest_sites(p, p, 3, others=True).withColumn("metres", F.round("metres", 3))


@query(f"WITH {d.SITES}, {d.SPRINGS}, p AS (SELECT a.upload AS left, b.site AS right, {NEAR.replace('a.x', 'a.lon').replace('a.y', 'a.lat')} AS metres FROM springs a CROSS JOIN sites b) {_NEAREST}1")
def j12_springs_to_sites(spark, sf_dir):
    """The site nearest to each spring, from all over the globe."""
    a = d.springs(spark, sf_dir).select(F.col("upload").alias("site"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return s.nearest_sites(a, d.sites(spark, sf_dir)).withColumn("metres", F.round("metres", 3))


@query(
    f"WITH {d.TRACKS}, v AS (SELECT DISTINCT track, lon, lat FROM points), t AS (SELECT DISTINCT track FROM v), n AS (SELECT a.track AS left, b.track AS right, p.lon, p.lat, min(sqrt(pow(p.lon - q.lon, 2) + pow(p.lat - q.lat, 2))) AS m FROM t a JOIN t b ON abs(a.track - b.track) = 1 JOIN v p ON p.track = a.track JOIN v q ON q.track = b.track GROUP BY ALL), "
    "f AS (SELECT \"left\", \"right\", max(m) AS m FROM n GROUP BY ALL) SELECT a.left, a.right, round(greatest(a.m, b.m), 6) AS hausdorff FROM f a JOIN f b ON a.left = b.right AND a.right = b.left WHERE a.left < a.right"
)
def a20_track_distances(spark, sf_dir):
    """Hausdorff distance of each track and the one of the next number."""
    v = d.track_vertices(spark, sf_dir)
    t = v.select(F.col("geom").alias("left")).distinct()
    pairs = t.join(t.select(F.col("left").alias("right")), F.col("left") + 1 == F.col("right"))
    return s.hausdorff_distances(pairs, v).withColumn("hausdorff", F.round("hausdorff", 6))


_STEPS = f"{d.TRACKS}, s AS (SELECT track AS geom, seq, lon AS x, lat AS y, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY track ORDER BY seq)), r AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS length FROM s WHERE x2 IS NOT NULL)"


@query(f"WITH {_STEPS} SELECT geom AS track, seq, round(length, 6) AS length, round(coalesce(sum(length) OVER (PARTITION BY geom ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS run FROM r")
def a04_running_lengths(spark, sf_dir):
    """Length of every step of a track and of what lies before it, by slices of 16 places."""
    s_ = ll.running_lengths(ll.sliced_segments(d.track_vertices(spark, sf_dir), 16))
    return s_.select(F.col("geom").alias("track"), F.col("seq").cast("int").alias("seq"), F.round("length", 6).alias("length"), F.round("run", 6).alias("run"))


@query(
    f"WITH {_STEPS}, t AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY geom ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, sum(length) OVER (PARTITION BY geom) AS total FROM r), "
    "p AS (SELECT event_id AS item, user_id AS geom, (event_id * 41 % 3600) / 10e0 - 180 AS px, (event_id * 59 % 1700) / 10e0 - 85 AS py FROM events WHERE event_type = 'view'), "
    "k AS (SELECT item, p.geom AS track, run, length, total, seq, x, y, x2, y2, px, py, CASE WHEN length = 0 THEN 0 ELSE greatest(0, least(1, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) END AS t FROM p JOIN t USING (geom)), "
    # equally near to a billionth: the first segment
    "o AS (SELECT *, CASE WHEN t = 1 THEN x2 ELSE x + t * (x2 - x) END - px AS ox, CASE WHEN t = 1 THEN y2 ELSE y + t * (y2 - y) END - py AS oy FROM k), "
    "n AS (SELECT item, track, total, run + t * length AS at_, sqrt(ox * ox + oy * oy) AS away, seq FROM o) "
    "SELECT item, track, round(arg_min(at_, (round(away, 9), seq)), 5) AS along, round(arg_min(at_, (round(away, 9), seq)) / any_value(total), 6) AS share, round(arg_min(away, (round(away, 9), seq)), 6) AS away FROM n GROUP BY item, track"
)
def w09_places_on_tracks(spark, sf_dir):
    """How far along its track the place nearest to each point lies, with segments in rows."""
    e = d.table(spark, sf_dir, "events").where("event_type = 'view'")
    p = e.select(F.col("event_id").alias("item"), F.col("user_id").alias("geom"), ((F.col("event_id") * 41 % 3600) / 10.0 - 180).alias("px"), ((F.col("event_id") * 59 % 1700) / 10.0 - 85).alias("py"))
    found = ll.project_points(p, d.track_vertices(spark, sf_dir))
    return found.select("item", F.col("geom").alias("track"), F.round("at", 5).alias("along"), F.round("share", 6).alias("share"), F.round("away", 6).alias("away"))


@query(
    f"WITH {d.TRACKS}, v AS (SELECT DISTINCT track AS geom, round(lon * 10)::BIGINT AS x, round(lat * 10)::BIGINT AS y FROM points), e AS (SELECT p.geom, p.x, p.y, q.x AS qx, q.y AS qy FROM v p JOIN v q ON p.geom = q.geom AND (p.x <> q.x OR p.y <> q.y)), "
    "o AS (SELECT e.*, (qx - e.x) * (r.y - e.y) - (qy - e.y) * (r.x - e.x) AS side, (qx - e.x) * (r.x - e.x) + (qy - e.y) * (r.y - e.y) AS along, pow(qx - e.x, 2) + pow(qy - e.y, 2) AS size FROM e JOIN v r ON r.geom = e.geom) "
    "SELECT DISTINCT geom AS track, x, y FROM (SELECT geom, x, y, qx, qy FROM o GROUP BY ALL HAVING NOT bool_or(side < 0 OR (side = 0 AND (along < 0 OR along > size))))"
)
def a19_hull_corners(spark, sf_dir):
    """Corners of the convex hull of each track, on tenths of a degree."""
    v = d.track_vertices(spark, sf_dir).select("geom", "seq", F.round(F.col("x") * 10).alias("x"), F.round(F.col("y") * 10).alias("y"))
    return shapes.convex_hulls(v).select(F.col("geom").alias("track"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
