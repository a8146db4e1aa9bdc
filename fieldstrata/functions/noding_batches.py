"""Matrices of many pairs of geometries at once: ``noding.relate`` over all pairs of an Arrow batch.

Every pair's edges and vertices meet all of the other's, so this suits small geometries; pairs with more than ``MOST`` pairs of
edges, mixed types, and empty, null or not finite ones go through ``relate`` one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .noding import B, E, I, relate, sides

#: Pairs of vertices or edges of one pair of geometries, and of the pairs worked out together.
MOST, TOGETHER = 4096, 400_000
DIMENSIONS = {"Point": 0, "LineString": 1, "Polygon": 2}


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where the items of each list begin in ``flatten``; null lists are empty."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(n)])


class Shapes:
    """Vertices and edges of a column of geometries; ``dim`` is -1 for what has to be looked at one by one."""

    def __init__(self, column: pa.Array):
        g = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        parts = pc.struct_field(g, "parts")
        of_parts = _offsets(parts)
        flat = parts.flatten()
        kinds, rings = pc.struct_field(flat, "type"), pc.struct_field(flat, "rings")
        of_rings = _offsets(rings)
        rings = rings.flatten()
        of_vertices = _offsets(rings)
        v = rings.flatten()
        self.x, self.y = (pc.struct_field(v, c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in "xy")
        n = len(g)
        part = np.repeat(np.arange(n), np.diff(of_parts))
        dim = np.array([DIMENSIONS.get(k, -1) for k in kinds.to_pylist()], np.int64)
        low, high = np.full(n, 9), np.full(n, -1)
        np.minimum.at(low, part, dim)
        np.maximum.at(high, part, dim)
        self.dim = np.where(low == high, low, -1)
        ring_part = np.repeat(np.arange(len(flat)), np.diff(of_rings))
        inner = np.arange(len(rings)) > of_rings[:-1][ring_part] if len(rings) else np.zeros(0, bool)
        sizes = np.diff(of_vertices)
        ring = np.repeat(np.arange(len(rings)), sizes)
        ring_owner = part[ring_part] if len(rings) else np.zeros(0, np.int64)
        self.owner = ring_owner[ring]
        count = np.bincount(self.owner, minlength=n)
        odd = np.bincount(self.owner[~(np.isfinite(self.x) & np.isfinite(self.y))], minlength=n)
        self.dim[(count == 0) | (odd > 0)] = -1
        self.start = np.concatenate([[0], np.cumsum(count)])
        # edges between neighbours of a ring
        i = np.flatnonzero((ring[1:] == ring[:-1]) & ((self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1])))
        with np.errstate(all="ignore"):
            cross = self.x[i] * self.y[i + 1] - self.x[i + 1] * self.y[i]
        area = np.bincount(ring[i], cross, minlength=len(rings))
        self.a, self.b = np.stack([self.x[i], self.y[i]], 1), np.stack([self.x[i + 1], self.y[i + 1]], 1)
        self.left = (area[ring[i]] > 0) != inner[ring[i]]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(self.owner[i], minlength=n))])
        # boundary: vertices of polygons, and ends of lines that an odd number share
        ends = np.zeros(len(self.x), np.int64)
        full = sizes > 0
        np.add.at(ends, of_vertices[:-1][full], 1)
        np.add.at(ends, of_vertices[1:][full] - 1, 1)
        order = np.lexsort((self.y, self.x, self.owner))
        o, x, y = self.owner[order], self.x[order], self.y[order]
        first = np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(order)]
        group = np.cumsum(first) - 1
        shared = np.empty(len(order), np.int64)
        if len(order):
            shared[order] = np.bincount(group, ends[order])[group].astype(np.int64)
        kind = self.dim[self.owner]
        self.own = np.where((kind == 2) | ((kind == 1) & (shared % 2 == 1)), B, I)

    def vertices(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[rows], self.start[rows + 1] - self.start[rows]

    def segments(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.edges[rows], self.edges[rows + 1] - self.edges[rows]


def _runs(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the places start .. start + n of each row, one after the other."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]


def _holds(points: np.ndarray, row: np.ndarray, s: Shapes, of: np.ndarray) -> np.ndarray:
    """Whether each point, of the pair ``row``, is inside the geometry of ``s`` that the pair has; for points off its edges."""
    start, n = s.segments(of[row])
    i, j = _runs(start, np.where(s.dim[of[row]] == 2, n, 0))
    x, y = points[i, 0], points[i, 1]
    a, b = s.a[j], s.b[j]
    met = np.flatnonzero((a[:, 1] > y) != (b[:, 1] > y))
    i, x, y, a, b = i[met], x[met], y[met], a[met], b[met]
    hit = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > x
    return np.bincount(i[hit], minlength=len(points)) % 2 == 1


def _place(s: Shapes, s_of: np.ndarray, t: Shapes, t_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vertex of the pairs' geometries in s: pair, its own place, and its place in that of t."""
    row, v = _runs(*s.vertices(s_of))
    points = np.stack([s.x[v], s.y[v]], 1)
    place = np.where(_holds(points, row, t, t_of), I, E)
    i, j = _runs(*t.segments(t_of[row]))
    p, a, b = points[i], t.a[j], t.b[j]
    k = np.flatnonzero(((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(1))
    k = k[sides(a[k], b[k], p[k]) == 0]
    place[i[k]] = np.where(t.dim[t_of[row[i[k]]]] == 2, B, I)
    i, j = _runs(*t.vertices(t_of[row]))
    k = np.flatnonzero((points[i, 0] == t.x[j]) & (points[i, 1] == t.y[j]))
    place[i[k]] = t.own[j[k]]
    return row, s.own[v], place


def _pieces(s: Shapes, s_of: np.ndarray, t: Shapes, t_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``noding._pieces``: (pair, point) of pieces off the edges of t; (pair, same, against) of those along them; pairs with crossings."""
    row, e = _runs(*s.segments(s_of))
    i, j = _runs(*t.segments(t_of[row]))
    a, b, c, d = s.a[e[i]], s.b[e[i]], t.a[j], t.b[j]
    k = np.flatnonzero(((np.minimum(a, b) <= np.maximum(c, d)) & (np.minimum(c, d) <= np.maximum(a, b))).all(1))
    i, j, a, b, c, d = i[k], j[k], a[k], b[k], c[k], d[k]
    c_, d_, a_, b_ = sides(a, b, c), sides(a, b, d), sides(c, d, a), sides(c, d, b)
    line = b - a
    size = (line**2).sum(1)
    n = len(e)
    edge, at = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
    for end, zero in ((c, c_), (d, d_)):
        k = np.flatnonzero(zero == 0)
        edge.append(i[k])
        at.append(((end[k] - a[k]) * line[k]).sum(1) / size[k])
    k = np.flatnonzero((c_ * d_ < 0) & (a_ * b_ < 0))
    crossed = row[i[k]]
    w = d[k] - c[k]
    edge.append(i[k])
    at.append(((c[k, 0] - a[k, 0]) * w[:, 1] - (c[k, 1] - a[k, 1]) * w[:, 0]) / (line[k, 0] * w[:, 1] - line[k, 1] * w[:, 0]))
    k = np.flatnonzero((c_ == 0) & (d_ == 0))
    x, y = ((c[k] - a[k]) * line[k]).sum(1) / size[k], ((d[k] - a[k]) * line[k]).sum(1) / size[k]
    along, lo, hi, turned = i[k], np.minimum(x, y), np.maximum(x, y), (y > x) == (s.left[e[i[k]]] == t.left[j[k]])
    edge, at = np.concatenate(edge), np.clip(np.concatenate(at), 0, 1)
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    real = (edge[1:] == edge[:-1]) & (at[1:] > at[:-1])
    edge, middle = edge[:-1][real], (at[:-1][real] + at[1:][real]) / 2
    start = np.searchsorted(edge, along, "left")
    k, piece = _runs(start, np.searchsorted(edge, along, "right") - start)
    k, piece = (z[(middle[piece] > lo[k]) & (middle[piece] < hi[k])] for z in (k, piece))
    same, against = np.zeros(len(edge), bool), np.zeros(len(edge), bool)
    same[piece[turned[k]]] = True
    against[piece[~turned[k]]] = True
    free = ~(same | against)
    points = s.a[e[edge[free]]] + middle[free, None] * (s.b - s.a)[e[edge[free]]]
    return row[edge[free]], points, row[edge[~free]], same[~free], against[~free], crossed


def _matrices(s: Shapes, t: Shapes, of: np.ndarray) -> np.ndarray:
    m = np.full((len(of), 3, 3), -1, np.int8)
    m[:, E, E] = 2

    def hit(row: np.ndarray, x, y, dim: int) -> None:
        m[row, x, y] = np.maximum(m[row, x, y], dim)

    hit(*_place(s, of, t, of), 0)
    row, own, place = _place(t, of, s, of)
    hit(row, place, own, 0)
    for one, other, turned in ((s, t, False), (t, s, True)):
        put = (lambda row, x, y, d: hit(row, y, x, d)) if turned else hit
        row, points, along, same, against, crossed = _pieces(one, of, other, of)
        mine, theirs = (np.where(z.dim[of] == 2, B, I) for z in (one, other))
        area, both = one.dim[of] == 2, (one.dim[of] == 2) & (other.dim[of] == 2)
        put(crossed, mine[crossed], theirs[crossed], 0)
        inside = _holds(points, row, other, of)
        for where, some in ((I, row[inside]), (E, row[~inside])):
            put(some, mine[some], where, 1)
            some = some[area[some]]
            put(some, I, where, 2)
            put(some, E, where, 2)
        put(along, mine[along], theirs[along], 1)
        put(along[same & ~against & both[along]], I, I, 2)
        some = along[against & ~same & both[along]]
        put(some, I, E, 2)
        put(some, E, I, 2)
        put(np.flatnonzero(area & (other.dim[of] < 2) & (np.diff(one.edges)[of] > 0)), I, E, 2)
    return m


def relate_all(a: pa.Array, b: pa.Array) -> pa.Array:
    """``relate`` of two columns of geometries row by row."""
    s, t = Shapes(a), Shapes(b)
    sizes = [np.maximum(np.diff(x.start), np.diff(x.edges)) for x in (s, t)]
    work = sizes[0] * sizes[1]
    small = (s.dim >= 0) & (t.dim >= 0) & (work <= MOST)
    out = np.empty(len(a), object)
    of = np.flatnonzero(small)
    ends = np.cumsum(work[of])
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        m = _matrices(s, t, of[at:to]).reshape(-1, 9)
        letters = np.frombuffer(b"F012", np.uint8)[m + 1]
        out[of[at:to]] = [x.decode() for x in letters.view("S9").ravel()]
        at = to
    rest = np.flatnonzero(~small)
    one, other = (x.take(pa.array(rest)).to_pylist() for x in (a, b))
    for i, v, w in zip(rest, one, other, strict=True):
        out[i] = relate(v and v["parts"], w and w["parts"])
    return pa.array(out.tolist(), pa.string())
