"""Image planning: sizes, crops, pyramids, tiles, histograms, box geometry."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The thumbnail boxes.
THUMBNAILS = [(100, 75), (200, 150), (400, 300), (1280, 960)]
#: Their names in the same order.
THUMBNAIL_NAMES = ["thumb", "small", "medium", "large"]


def fit_inside(width: Column, height: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """The largest size of the same shape inside a box."""
    wide = width / bw > height / bh
    w = F.when(wide, bw).otherwise(F.greatest(F.round(width * bh / height), F.lit(1)))
    h = F.when(wide, F.greatest(F.round(height * bw / width), F.lit(1))).otherwise(bh)
    return w.cast("int"), h.cast("int")


def fit_outside(width: Column, height: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """The smallest size of the same shape that covers a box."""
    wide = width / bw < height / bh
    w = F.when(wide, bw).otherwise(F.round(width * bh / height))
    h = F.when(wide, F.round(height * bw / width)).otherwise(bh)
    return w.cast("int"), h.cast("int")


def resized(width: Column, height: Column, bw: Column, bh: Column, fit: str = "inside", scale: str = "any") -> tuple[Column, Column]:
    """Size after a resize to a box: fitted inside, outside or filling it; only ``down`` or ``up`` in size, or ``any``.

    A missing side of the box follows from the other by the image's shape, rounded down; a box without either is
    the image's own size.
    """
    w = F.coalesce(bw, F.when(bh.isNotNull(), F.floor(width * bh / height)).otherwise(width))
    h = F.coalesce(bh, F.when(bw.isNotNull(), F.floor(height * bw / width)).otherwise(height))
    if fit == "fill":
        nw, nh = w, h
    else:
        rx, ry = width / w, height / h
        ratio = F.greatest(rx, ry) if fit == "inside" else F.least(rx, ry)
        nw, nh = F.round(width / ratio), F.round(height / ratio)
    if scale != "any":
        same = (nw >= width) & (nh >= height) if scale == "down" else (nw <= width) & (nh <= height)
        nw, nh = F.when(same, width).otherwise(nw), F.when(same, height).otherwise(nh)
    return nw.cast("int"), nh.cast("int")


def coordinate(text: Column, size: Column, other: Column | None = None) -> Column:
    """A coordinate written as a sum of numbers, shares ("50%") and places ("left", "center", "bottom"), in pixels.

    Places leave room for ``other``, the size of what is placed, if it is given. Minus signs in a row cancel. Null
    for what cannot be read, and for a sum that ends in a sign.
    """
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"[+-]|[^+-]+"), F.lit(0)), lambda t: F.trim(t))
    room = size if other is None else size - other

    def value(t: Column) -> Column:
        number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)%?$", 1).try_cast("double")
        named = F.when(t.isin("left", "top"), 0).when(t.isin("center", "middle"), (room / 2).cast("int")).when(t.isin("right", "bottom"), room)
        return F.coalesce(named, F.when(t.endswith("%"), F.round(size * number / 100)).otherwise(F.round(number))).cast("double")

    def step(acc: Column, t: Column) -> Column:
        minus, plus = t == "-", t == "+"
        sign = F.when(minus, F.when(acc["sign"] == 0, -1).otherwise(-acc["sign"])).when(plus, F.when(acc["sign"] == 0, 1).otherwise(acc["sign"])).otherwise(0)
        total = F.when(minus | plus, acc["total"]).otherwise(acc["total"] + F.when(acc["sign"] == 0, F.lit(None).cast("double")).otherwise(acc["sign"]) * value(t))
        return F.struct(total.alias("total"), sign.cast("int").alias("sign"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(1).alias("sign"))
    done = F.aggregate(F.filter(tokens, lambda t: t != ""), start, step)
    return F.when((done["sign"] == 0) & text.isNotNull(), done["total"].cast("int"))


def crop(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """A rectangle held inside the image; its sides are 0 or less where nothing is left."""
    x0, y0 = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return x0, y0, F.least(width, x + w) - x0, F.least(height, y + h) - y0


def pyramid_levels(images: DataFrame, tile: int = 256) -> DataFrame:
    """Levels of each image, halved until both sides are at most tile/2+1; level 0 is the smallest."""
    k = F.sequence(F.lit(0), F.lit(30))
    sides = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k"))).cast("int")
    last = F.array_min(F.filter(k, lambda i: (F.floor(F.col("width") / F.pow(F.lit(2.0), i)) <= tile // 2 + 1) & (F.floor(F.col("height") / F.pow(F.lit(2.0), i)) <= tile // 2 + 1)))
    d = images.withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0), "last")))
    return d.withColumn("level", (F.col("last") - F.col("k")).cast("long")).withColumn("w", sides("width")).withColumn("h", sides("height"))


def zoomify_levels(images: DataFrame, tile: int = 256) -> DataFrame:
    """Levels halved while a side is over the tile; the last, which fits into one tile, is level 0."""
    return _halved(images, F.lit(tile), True)


def service_levels(images: DataFrame, tile: int = 256) -> DataFrame:
    """Levels halved while a side is over tile/2+1, the full size always among them; level 0 is the smallest."""
    return _halved(images, F.lit(tile // 2 + 1), False)


def zoomify_ends(images: DataFrame, tile: int = 256) -> DataFrame:
    """The ``zoomify_levels`` (image, level, w, h) with the number of the first of their ``tiles`` and the name of the last.

    Worked out inside the row, one row an image: no tile is made and nothing is shuffled.
    """
    n = lambda c: F.greatest(F.ceil(c / tile), F.lit(1)).cast("long")
    d = images.select("image", "width", "height", _halvings(F.lit(tile)).alias("last"))
    sides = lambda i: F.struct(*[_side(c, F.col("last") - i).cast("int").alias(c[0]) for c in ("width", "height")])
    d = d.select("image", F.transform(F.sequence(F.lit(0), "last"), sides).alias("grid"))
    before = lambda i: F.aggregate(F.slice("grid", F.lit(1), i), F.lit(0).cast("long"), lambda sum_, v: sum_ + n(v["w"]) * n(v["h"]))
    d = d.select("image", F.explode(F.transform("grid", lambda v, i: F.struct(i.cast("long").alias("level"), v["w"].alias("w"), v["h"].alias("h"), before(i).alias("first_tile")))).alias("v")).select("image", "v.*")
    tx, ty = n(F.col("w")), n(F.col("h"))
    return d.withColumn("last_name", zoomify_name(F.col("first_tile") + tx * ty - 1, F.col("level"), tx - 1, ty - 1))


def _side(c: str, k: Column) -> Column:
    return F.floor(F.col(c) / F.pow(F.lit(2.0), k))


def _halvings(most: Column) -> Column:
    """How often an image is halved until both sides are at most ``most``."""
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: (_side("width", k) <= most) & (_side("height", k) <= most)))


def _halved(images: DataFrame, most: Column, with_last: bool) -> DataFrame:
    side, first = _side, _halvings(most)
    last = first if with_last else F.greatest(first - 1, F.lit(0))
    d = images.withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0), "last")))
    return d.withColumn("level", (F.col("last") - F.col("k")).cast("long")).withColumn("w", side("width", F.col("k")).cast("int")).withColumn("h", side("height", F.col("k")).cast("int"))


def zoomify_name(tile: Column, level: Column, x: Column, y: Column, group: int = 256) -> Column:
    return F.format_string("TileGroup%d/%d-%d-%d.jpg", F.floor(tile / group), level, x, y)


def service_name(level: Column, x: Column, y: Column, tile: int = 256) -> Column:
    return F.format_string("tile=%d,%d,%d,%d", level, x, y, F.lit(tile))


def map_tiles(images: DataFrame, tile: int = 256, zooms: int = 8, extension: str = "jpg", bottom_up: bool = True) -> DataFrame:
    """Map tiles (image, zoom, x, y, left, top, path): of each zoom the image fitted into 2^zoom tiles a side.

    Zooms at which that square is larger than the image on both sides are left out, so nothing is scaled up. Tiles are
    counted from the bottom if ``bottom_up``; their tops may lie above the image then.
    """
    d = images.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(zooms)))).withColumn("side", F.pow(F.lit(2.0), F.col("zoom")) * tile)
    d = d.where(~((F.col("side") > F.col("width")) & (F.col("side") > F.col("height"))))
    w, h = resized(F.col("width"), F.col("height"), F.col("side"), F.col("side"))
    d = d.select("image", "zoom", F.greatest(w, F.lit(1)).alias("w"), F.greatest(h, F.lit(1)).alias("h"))
    up_to = lambda c: F.sequence(F.lit(0), F.ceil(F.col(c) / tile).cast("int") - 1)
    d = d.withColumn("x", F.explode(up_to("w"))).withColumn("y", F.explode(up_to("h")))
    top = F.col("h") - (F.col("y") + 1) * tile if bottom_up else F.col("y") * tile
    return d.select("image", "zoom", "x", "y", (F.col("x") * tile).alias("left"), top.alias("top"), F.format_string(f"%d/%d/%d.{extension}", "zoom", "x", "y").alias("path"))


def quad_boxes(images: DataFrame, tile: int = 512) -> DataFrame:
    """Crop boxes (image, side, level, column, row, left, top, right, bottom) of the square canvas of a power of two
    around an image, at every level at which a box is not smaller than a tile."""
    side = F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("width", "height")))).cast("long"), F.lit(1).cast("long"))
    levels = F.greatest(F.floor(F.log2(side / tile)), F.lit(0)).cast("int")
    d = images.select("image", side.alias("side"), F.explode(F.sequence(F.lit(0), levels)).alias("level"))
    d = d.withColumn("box", F.expr("shiftright(side, level)")).withColumn("n", F.expr("shiftleft(1, level)"))
    d = d.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edge = lambda c, more=0: ((F.col(c) + more) * F.col("box")).cast("long")
    return d.select("image", "side", "level", "column", "row", edge("column").alias("left"), edge("row").alias("top"), edge("column", 1).alias("right"), edge("row", 1).alias("bottom"))


def tiles(levels: DataFrame, tile: int = 256) -> DataFrame:
    """(image, level, x, y, tile, name) of every tile; numbers go on from level to level."""
    n = lambda c: F.greatest(F.ceil(F.col(c) / tile), F.lit(1)).cast("long")
    before = F.sum(F.col("tx") * F.col("ty")).over(Window.partitionBy("image").orderBy("level").rowsBetween(Window.unboundedPreceding, -1))
    d = levels.select("image", "level", n("w").alias("tx"), n("h").alias("ty")).withColumn("base", F.coalesce(before, F.lit(0)))
    d = d.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ty") - 1)))
    return d.select("image", "level", "x", "y", (F.col("base") + F.col("x") + F.col("y") * F.col("tx")).alias("tile"), F.format_string("%03d_%03d_%03d.jpg", "level", "x", "y").alias("name"))


def image_tiles(images: DataFrame, tile: int = 256) -> DataFrame:
    """The ``tiles`` of the ``pyramid_levels`` of each image, numbered inside the row: nothing is shuffled."""
    half = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k))
    n = lambda c, k: F.greatest(F.ceil(half(c, k) / tile), F.lit(1)).cast("long")
    last = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: (half("width", k) <= tile // 2 + 1) & (half("height", k) <= tile // 2 + 1)))
    d = images.select("image", "width", "height", last.alias("last"))
    grid = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(i.cast("long").alias("level"), n("width", F.col("last") - i).alias("tx"), n("height", F.col("last") - i).alias("ty")))
    d = d.withColumn("grid", grid)
    base = lambda i: F.aggregate(F.slice("grid", F.lit(1), i), F.lit(0).cast("long"), lambda a, g: a + g["tx"] * g["ty"])
    d = d.select("image", F.explode(F.transform("grid", lambda g, i: F.struct(g["level"].alias("level"), g["tx"].alias("tx"), g["ty"].alias("ty"), base(i).alias("base")))).alias("g")).select("image", "g.*")
    d = d.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ty") - 1)))
    three = lambda c: F.lpad(F.col(c).cast("string"), F.greatest(F.length(F.col(c).cast("string")), F.lit(3)), F.lit("0"))
    return d.select("image", "level", "x", "y", (F.col("base") + F.col("x") + F.col("y") * F.col("tx")).alias("tile"), F.concat(three("level"), F.lit("_"), three("x"), F.lit("_"), three("y"), F.lit(".jpg")).alias("name"))


Layout = Callable[[DataFrame, int], DataFrame]
LAYOUTS: dict[str, Layout] = {}


def register_layout(name: str, plan: Layout) -> None:
    """Adds a way to cut images (image, width, height) into tiles of a size, or puts another in the place of one."""
    LAYOUTS[name] = plan


def planned(images: DataFrame, layout: Column | str, tile: int = 256) -> DataFrame:
    """(image, layout, plan as JSON, one row a tile) of images by registered layouts: one name for all, or a column with the layout of each.

    Images of a layout that is not registered, or of none, have no rows.
    """
    named = images.withColumn("_layout", F.lit(layout) if isinstance(layout, str) else layout)
    out = None
    for name, plan in LAYOUTS.items():
        if isinstance(layout, str) and name != layout:
            continue
        made = plan(named.where(F.col("_layout") == name).drop("_layout"), tile)
        made = made.select("image", F.lit(name).alias("layout"), F.to_json(F.struct(*[c for c in made.columns if c != "image"])).alias("plan"))
        out = made if out is None else out.unionByName(made)
    return images.select("image", F.lit(None).cast("string").alias("layout"), F.lit(None).cast("string").alias("plan")).limit(0) if out is None else out


register_layout("pyramid", image_tiles)
register_layout("quads", quad_boxes)
register_layout("map", map_tiles)


def histogram(px: DataFrame, channel: str, value: str, bins: int = 256) -> DataFrame:
    """(channel, bin, n) over equal bins from the channel's smallest to its largest value."""
    mm = px.groupBy(channel).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return px.join(mm, channel).groupBy(channel, b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_statistics(px: DataFrame, channel: str, value: str, bins: int = 256, mask: Column | None = None) -> DataFrame:
    """Per channel average, deviation, first and last bin with a value, bins with any, and the bins most and least full.

    With ``mask`` only the values for which it holds count.
    """
    px = px if mask is None else px.where(mask)
    stats = px.groupBy(channel).agg(F.avg(value).alias("average"), F.stddev_pop(value).alias("deviation"))
    h = histogram(px, channel, value, bins).groupBy(channel).agg(
        F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("full_bins"),
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("fullest"), F.min_by("bin", F.struct("n", "bin")).alias("emptiest"),
    )
    return stats.join(h, channel)


def linear_levels(value: Column, low: Column, high: Column, levels: int = 256) -> Column:
    """A value on a linear scale from low to high, as a whole level; values outside are held to its ends."""
    return F.least(F.greatest(F.round((value - low) / F.nullif(high - low, F.lit(0.0)) * (levels - 1)), F.lit(0)), F.lit(levels - 1)).cast("int")


def turned_bounds(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, width and height of the bounds of a box turned about its centre (x, y)."""
    a = F.radians(degrees)
    ex = F.abs(w / 2 * F.cos(a)) + F.abs(h / 2 * F.sin(a))
    ey = F.abs(w / 2 * F.sin(a)) + F.abs(h / 2 * F.cos(a))
    return x - ex, y - ey, ex * 2, ey * 2


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    a = math.radians(degrees)
    return x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """A point through the matrix (a, b, c, d, e, f): a x + c y + e, b x + d y + f."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    """The matrix that takes back what ``m`` does; ValueError if there is none."""
    det = m[0] * m[3] - m[1] * m[2]
    if not det:
        raise ValueError("the matrix has no inverse")
    a, b, c, d = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    return a, b, c, d, -(a * m[4] + c * m[5]), -(b * m[4] + d * m[5])


def between(a: tuple[Column, Column], b: tuple[Column, Column], share: float = 0.5) -> tuple[Column, Column]:
    """The point at a share of the way from a to b; the middle by default."""
    return a[0] + (b[0] - a[0]) * share, a[1] + (b[1] - a[1]) * share


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))


def componentwise(a: tuple[Column, Column], b: tuple[Column, Column]) -> dict[str, Column]:
    """Sums, differences, minima, maxima and comparisons of two points, side by side."""
    return {
        "add_x": a[0] + b[0], "add_y": a[1] + b[1], "sub_x": a[0] - b[0], "sub_y": a[1] - b[1],
        "min_x": F.least(a[0], b[0]), "min_y": F.least(a[1], b[1]), "max_x": F.greatest(a[0], b[0]), "max_y": F.greatest(a[1], b[1]),
        "eq": (a[0] == b[0]) & (a[1] == b[1]), "lt": (a[0] < b[0]) & (a[1] < b[1]), "lte": (a[0] <= b[0]) & (a[1] <= b[1]),
    }


def local_bounds(xs: Column, ys: Column) -> tuple[Column, Column, Column, Column]:
    """Smallest x and y and the extent of a polygon's points; an extent of 0 is 1."""
    extent = lambda v: F.when(F.array_max(v) == F.array_min(v), 1.0).otherwise(F.array_max(v) - F.array_min(v))
    return F.array_min(xs), F.array_min(ys), extent(xs), extent(ys)


def to_image(x: Column, y: Column, x_offset: Column, y_offset: Column, scale: Column) -> tuple[Column, Column]:
    """Canvas coordinates in the image's pixels, by the offset and scale of the viewer."""
    return (x - x_offset) / scale, (y - y_offset) / scale


def region(size: Column, origin: Column, extent: Column) -> tuple[Column, Column]:
    """(first, number) of a region of interest along one side: an origin out of range is 0, its size the remainder then."""
    bad = (origin < 0) | (origin >= size)
    return F.when(bad, 0).otherwise(origin), F.when(bad, size).otherwise(F.least(size - origin, extent))


def volume_region(sizes: list[Column], origin: list[Column], extent: list[Column]) -> list[tuple[Column, Column]]:
    """(first, number) of a region of interest along x, y and z of a stack.

    An origin outside is 0; no extent along x or y is the whole side; what would reach beyond the far side is cut off there.
    """
    out = []
    for axis, (n, o, e) in enumerate(zip(sizes, origin, extent, strict=True)):
        first = F.when((o < 0) | (o >= n), 0).otherwise(o)
        wanted = F.when(e <= 0, n).otherwise(e) if axis < 2 else e
        out.append((first, F.least(wanted, n - first)))
    return out


def thumbnail_name(file: Column, size: Column) -> Column:
    """File name of a thumbnail: what is before the image's first dot, and the size's name."""
    return F.concat(F.substring_index(file, ".", 1), F.lit("_"), size, F.lit(".jpg"))


def unit_pixels(text: Column, dpi: float = 96.0) -> Column:
    """Pixels of a length with its unit; plain numbers are pixels."""
    v, unit = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double"), F.regexp_extract(text, "([a-z]*)$", 1)
    return v * F.when(unit == "mm", dpi / 25.4).when(unit == "cm", dpi / 2.54).when(unit == "in", dpi).when(unit == "pt", dpi / 72).when(unit == "pc", dpi / 6).otherwise(1.0)
