"""Geography in column expressions; rings are arrays of (x, y) structs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Centre of the projection, latitude and longitude.
CENTER = (23.7, 121.0)


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def azimuthal(lat: Column, lon: Column) -> Column:
    """struct(x, y, angle) in degrees about CENTER, y downwards."""
    p0 = F.radians(F.lit(CENTER[0]))
    la, dl = F.radians(lat), F.radians(lon - CENTER[1])
    c = F.acos(_clamp(F.sin(p0) * F.sin(la) + F.cos(p0) * F.cos(la) * F.cos(dl)))
    k = F.when(c < 1e-9, 1.0).otherwise(c / F.greatest(F.sin(c), F.lit(1e-9)))
    x, y = k * F.cos(la) * F.sin(dl), k * (F.cos(p0) * F.sin(la) - F.sin(p0) * F.cos(la) * F.cos(dl))
    return F.struct(F.degrees(x).alias("x"), (-F.degrees(y)).alias("y"), F.degrees(c).alias("angle"))


def km_from_center(lat: Column, lon: Column) -> Column:
    return F.bround(6371 * F.radians(azimuthal(lat, lon)["angle"]))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 12742 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat: Column, lon: Column) -> Column:
    """Unit vector (east, north) from CENTER; null at the centre."""
    dy, dx = lat - CENTER[0], (lon - CENTER[1]) * F.cos(F.radians(F.lit(CENTER[0])))
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n >= 1e-6, F.struct((dx / n).alias("x"), (dy / n).alias("y")))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, t: Column) -> Column:
    """struct(lon, lat) at the share t of the way."""
    a = [F.cos(F.radians(lat1)) * F.cos(F.radians(lon1)), F.cos(F.radians(lat1)) * F.sin(F.radians(lon1)), F.sin(F.radians(lat1))]
    b = [F.cos(F.radians(lat2)) * F.cos(F.radians(lon2)), F.cos(F.radians(lat2)) * F.sin(F.radians(lon2)), F.sin(F.radians(lat2))]
    w = F.acos(_clamp(a[0] * b[0] + a[1] * b[1] + a[2] * b[2]))
    v = [(F.sin((1 - t) * w) * x + F.sin(t * w) * y) / F.sin(w) for x, y in zip(a, b, strict=True)]
    there = F.struct(F.degrees(F.atan2(v[1], v[0])).alias("lon"), F.degrees(F.asin(_clamp(v[2]))).alias("lat"))
    return F.when(w < 1e-9, F.struct(lon1.cast("double").alias("lon"), lat1.cast("double").alias("lat"))).otherwise(there)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over the ring's edges, closed from the last point to the first."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def crosses(p, q):
        return F.when((p["y"] > y) != (q["y"] > y), x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(False)

    hits = F.filter(F.zip_with(ring, nxt, crosses), lambda z: z)
    return F.size(hits) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the others, its holes."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda h: in_ring(x, y, h))


def cells_by_density(points: DataFrame, most: int, depth: int) -> DataFrame:
    """cx, cy, level, ax, ay, n of each finest cell with points: the largest square around it, of those that halve from level 0 to
    ``depth``, with at most ``most`` points in all, or the finest. points: cx, cy. Only counts are shuffled."""
    fine = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    up = fine.select("cx", "cy", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    up = up.withColumns({c: F.expr(f"shiftright(c{c[1]}, {depth} - level)") for c in ("ax", "ay")})
    held = up.groupBy("level", "ax", "ay").agg(F.sum("n").alias("held"))
    fits = up.join(held, ["level", "ax", "ay"]).filter((F.col("held") <= most) | (F.col("level") == depth))
    return fits.groupBy("cx", "cy", "n").agg(F.min(F.struct("level", "ax", "ay", "held")).alias("c")).select("cx", "cy", "n", "c.*")


def locate(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", most_polygons: int = 10_000, most_points: int = 100_000, depth: int = 12) -> DataFrame:
    """points with the name of the first polygon (by ord) that holds each. polygons: ord, name, rings. Boxes sort out most pairs
    before rings are walked.

    The polygons are counted, and broadcast up to ``most_polygons``. Beyond that spots and polygons meet in cells, large where spots
    are few and small where they are dense; a finest cell with more than ``most_points`` is dealt out further by row. A spot is a pair of
    coordinates, which is placed once for all its points; of polygons with equal rings only the first can be the answer."""
    first = F.get("rings", F.lit(0))
    boxed = lambda shapes: shapes.select("ord", "name", "rings", *[f(first[c]).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    inside = (F.col(x) >= F.col("lox")) & (F.col(x) <= F.col("hix")) & (F.col(y) >= F.col("loy")) & (F.col(y) <= F.col("hiy"))
    own = points.columns
    hit = F.when(in_polygon(F.col(x), F.col(y), F.col("rings")), F.struct("ord", "name"))
    if polygons.count() <= most_polygons:
        met = points.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(boxed(polygons)), inside, "left")
        return met.groupBy("_row", *own).agg(F.min(hit).alias("m")).select(*own, F.col("m.name").alias("place"))
    box = cut(boxed(polygons.groupBy("rings").agg(F.min(F.struct("ord", "name")).alias("f")).select("f.*", "rings")))
    x0, x1, y0, y1 = box.agg(F.min("lox"), F.max("hix"), F.min("loy"), F.max("hiy")).first()
    side = 1 << depth

    def cell(c, low, high):
        """Number of the finest cell; what lies beyond the outermost polygons counts with the cells at the rim."""
        return F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((c - low) / ((high - low) or 1.0) * side))).cast("int")

    points = cut(points)
    spots = points.groupBy(x, y).agg(F.count(F.lit(1)).alias("here")).withColumn("_row", F.monotonically_increasing_id())
    at = cut(spots.withColumns({"cx": F.coalesce(cell(F.col(x), x0, x1), F.lit(0)), "cy": F.coalesce(cell(F.col(y), y0, y1), F.lit(0))}))
    cells = cut(cells_by_density(at.select("cx", "cy"), most_points, depth))
    total = cells.agg(F.sum("n")).first()[0] or 0
    dense = F.broadcast(cells.filter(F.col("n") * 1024 > total).select("cx", "cy", "level", "ax", "ay", "held"))  # under 1024 rows
    sparse = cells.filter(F.col("n") * 1024 <= total).select("cx", "cy", "level", "ax", "ay", "held")
    placed = at.join(dense, ["cx", "cy"]).union(at.join(dense.select("cx", "cy"), ["cx", "cy"], "left_anti").join(sparse, ["cx", "cy"]).select("cx", "cy", *at.drop("cx", "cy").columns, "level", "ax", "ay", "held"))
    salts = F.ceil(F.col("held") / most_points).cast("int")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("_row"), salts).cast("int"))
    # polygons and cells meet in a coarse grid first
    span = lambda low, high: F.explode(F.sequence(low, high))
    coarse = max(0, depth - 4)
    boxes = box.withColumns({f"{e}c{c}": cell(F.col(f"{e}{c}"), *r) for e in ("lo", "hi") for c, r in (("x", (x0, x1)), ("y", (y0, y1)))})
    boxes = boxes.withColumn("gx", span(F.shiftright("locx", coarse), F.shiftright("hicx", coarse))).withColumn("gy", span(F.shiftright("locy", coarse), F.shiftright("hicy", coarse)))
    leaves = cells.select("level", "ax", "ay", salts.alias("salts")).distinct()
    leaves = leaves.withColumns({f"{e}a{c}": F.expr(f"shiftleft(a{c} + {k}, {depth} - level) - {k}") for c in "xy" for e, k in (("lo", 0), ("hi", 1))})
    leaves = leaves.withColumn("gx", span(F.shiftright("loax", coarse), F.shiftright("hiax", coarse))).withColumn("gy", span(F.shiftright("loay", coarse), F.shiftright("hiay", coarse)))
    over = (F.col("locx") <= F.col("hiax")) & (F.col("hicx") >= F.col("loax")) & (F.col("locy") <= F.col("hiay")) & (F.col("hicy") >= F.col("loay"))
    # what meets in several places of the coarse grid counts in the first of them
    once = (F.col("gx") == F.shiftright(F.greatest("locx", "loax"), coarse)) & (F.col("gy") == F.shiftright(F.greatest("locy", "loay"), coarse))
    shapes = boxes.join(leaves, ["gx", "gy"]).filter(over & once).withColumn("salt", span(F.lit(0), F.col("salts") - 1))
    met = placed.join(shapes.select("level", "ax", "ay", "salt", "ord", "name", "rings", "lox", "hix", "loy", "hiy"), ["level", "ax", "ay", "salt"]).filter(inside)
    found = met.select("_row", hit.alias("m")).filter("m IS NOT NULL").groupBy("_row").agg(F.min("m").alias("m"))
    places = cut(at.join(found, "_row").select(F.col(x).alias("_x"), F.col(y).alias("_y"), "here", F.col("m.name").alias("place")))
    here, there = points.count(), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))
    busy = F.broadcast(places.filter(F.col("here") * 1024 > here))  # under 1024 rows
    others = points.join(busy, there, "left_anti").join(places.filter(F.col("here") * 1024 <= here), there, "left")
    return points.join(busy, there).select(*own, "place").union(others.select(*own, "place"))


def ring_area(ring: Column) -> Column:
    """Shoelace area, not signed."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def densify(ring: Column, longest: float) -> Column:
    """The ring with points added evenly on edges that are longer than ``longest`` in x or y; its last edge closes it."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def edge(p, q):
        steps = F.greatest(F.lit(1), F.ceil(F.round(F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])) / longest, 6)).cast("int"))
        return F.transform(F.sequence(F.lit(0), steps - 1), lambda i: F.struct((p["x"] + (q["x"] - p["x"]) * i / steps).alias("x"), (p["y"] + (q["y"] - p["y"]) * i / steps).alias("y")))

    return F.flatten(F.zip_with(ring, nxt, edge))


def simplify(epsilon: float):
    """Column function: indices of the points that a polyline keeps when none may lie further than epsilon from it."""

    @F.pandas_udf("array<int>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_kept(np.asarray(x, float), np.asarray(y, float), epsilon) for x, y in zip(xs, ys, strict=True)])

    return kept


def _kept(x: np.ndarray, y: np.ndarray, epsilon: float) -> list[int]:
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        n = np.hypot(dx, dy)
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(dx * py - dy * px) / n if n else np.hypot(px, py)
        k = int(d.argmax())
        if d[k] > epsilon:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(k for k in keep if k >= 0)


def choose_place(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, most_km: float = 80.0) -> Column:
    """struct(lat, lon, src): the precise coordinate unless it lies further from the city than ``most_km``."""
    far = haversine_km(lat_a, lon_a, lat_b, lon_b) > most_km
    use_city = lat_a.isNull() | (lat_b.isNotNull() & far)
    return F.struct(F.when(use_city, lat_b).otherwise(lat_a).alias("lat"), F.when(use_city, lon_b).otherwise(lon_a).alias("lon"), F.when(use_city & lat_b.isNull(), "none").when(use_city, "city").otherwise("precise").alias("src"))


def outlines(polygons: DataFrame, epsilon: float, least_area: float, longest: float) -> DataFrame:
    """ord, name, rings on the map: rings below ``least_area`` go, long edges get points, points within ``epsilon`` of the line go,
    and the rest is projected. polygons: ord, name, rings of (x lon, y lat)."""
    real = F.filter("rings", lambda r: ring_area(r) >= least_area)
    each = polygons.select("ord", "name", F.posexplode(real).alias("part", "ring")).withColumn("ring", densify(F.col("ring"), longest))
    kept = simplify(epsilon)(F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"]))
    points = F.transform(kept, lambda i: F.get("ring", i))

    def projected(p):
        a = azimuthal(p["y"], p["x"])
        return F.struct(a["x"].alias("x"), a["y"].alias("y"))

    rings = each.withColumn("points", points).select("ord", "name", "part", F.transform("points", projected).alias("ring"))
    return rings.groupBy("ord", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ring"))), lambda x: x["ring"]).alias("rings"))


def packed_positions(members: DataFrame, radius: float = 1.0) -> DataFrame:
    """node_id, dx, dy of people around their institution: by group and id they fill rings of 6, 12, 18, ... places outwards, so that
    a group is a sector of neighbours. members: place, grp, node_id."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("place").orderBy("grp", "node_id")) - 1
    m = members.withColumn("i", at)
    ring = F.ceil((F.sqrt(F.lit(9.0) + 12 * F.col("i")) - 3) / 6).cast("int")  # rings 0 to k hold 1 + 3k(k + 1) places
    m = m.withColumn("ring", ring).withColumn("first", F.when(F.col("ring") > 0, 1 + 3 * F.col("ring") * (F.col("ring") - 1)).otherwise(0))
    angle = F.when(F.col("ring") > 0, 2 * F.pi() * (F.col("i") - F.col("first")) / (6 * F.col("ring"))).otherwise(0.0)
    return m.select("place", "node_id", "ring", (radius * F.col("ring") * F.cos(angle)).alias("dx"), (radius * F.col("ring") * F.sin(angle)).alias("dy"))
