"""Map and scene tables: edges, parking lines, spawn positions, documents, edits, buildings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import grid_convergence
from wheeltrace.functions.geodesy import local_equirect, local_tmerc_heading, wgs84_to_tmerc
from wheeltrace.operators.nearest import nearest_target, segment
from wheeltrace.operators.ordered import attach, dense_number, running
from wheeltrace.operators.paths import offset_line
from wheeltrace.session import materialize


def label_counts(df: DataFrame, side: str, orient: str) -> DataFrame:
    """Counts by orientation, by side and by (side, orientation) in one pass."""
    both = df.select(F.col(side).alias("side"), F.col(orient).alias("orient"))
    a, b = F.col("side"), F.col("orient")
    out = both.groupingSets([[a], [b], [a, b]], a, b).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    # the bits of the id mark the columns left out
    kind = F.when(F.col("g") == 1, "side").when(F.col("g") == 2, "orient").otherwise("pair")
    return out.select(kind.alias("kind"), "side", "orient", "n")


# Tag contents that allow kerb-side parking, and road classes cars may use.
PARK_ACCEPT = ("yes", "parallel", "diagonal", "lane", "parallel:both", "diagonal:both", "lane:both", "on_street", "on_kerb")
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service")
BACK_OFFSET = 0.13          # rear axle to vehicle centre of the replayed vehicle, metres
LEFT_M, RIGHT_M = 6.0, 5.2  # distance of the parking lines from the road centre line


# --- roads ------------------------------------------------------------------------------------------
def osm_edges(nodes: DataFrame, ways: DataFrame, both_directions: bool = True) -> DataFrame:
    """One row per consecutive node pair of every allowed road; two-way roads also in reverse.

    ``nodes``: ``id, lat, lon``. ``ways``: ``way_id, refs array, tags map``.
    """
    roads = ways.where(F.col("tags")["highway"].isin(*ROAD_CLASSES))
    pairs = roads.select("way_id", "tags", F.expr(
        "inline(transform(slice(refs, 1, greatest(size(refs) - 1, 0)), (a, i) -> struct(i as seg, a as u, refs[i + 1] as v)))"))
    end = lambda n, p: nodes.select(F.col("id").alias(n), F.col("lat").alias(f"lat{p}"), F.col("lon").alias(f"lon{p}"))
    fwd = pairs.join(end("u", 0), "u").join(end("v", 1), "v")
    cols = ["way_id", "seg", "u", "v", "lat0", "lon0", "lat1", "lon1", "tags"]
    fwd = fwd.select(*cols, F.lit(False).alias("reversed"))
    if not both_directions:
        return fwd
    two_way = ~F.coalesce(F.col("tags")["oneway"].isin("yes", "true", "1"), F.lit(False))
    back = fwd.where(two_way).select(
        "way_id", "seg", F.col("v").alias("u"), F.col("u").alias("v"), F.col("lat1").alias("lat0"), F.col("lon1").alias("lon0"),
        F.col("lat0").alias("lat1"), F.col("lon0").alias("lon1"), "tags", F.lit(True).alias("reversed"))
    return fwd.unionByName(back)


def edge_tags(edges: DataFrame, tags: DataFrame, edge_id: str, tag_id: str) -> DataFrame:
    """Left join of parking tags on the id as text; several tag rows give several edge rows."""
    t = tags.withColumn("_id", F.col(tag_id).cast("string")).drop(tag_id)
    return edges.withColumn("_id", F.col(edge_id).cast("string")).join(t, "_id", "left").drop("_id")


def parking_allowed(tag_cols: dict[str, str], side: str, override: bool = False):
    """Whether any of the four tags that speak for ``side`` accepts parking."""
    out = F.lit(override)
    for tag in (f"parking:{side}", f"parking:lane:{side}", "parking:both", "parking:lane:both"):
        if tag in tag_cols:
            out = out | F.coalesce(F.lower(F.col(tag_cols[tag]).cast("string")).isin(*PARK_ACCEPT), F.lit(False))
    return out


def parking_lines(edges: DataFrame, edge_id: str, tag_cols: dict[str, str], override: bool = False, extra=()) -> DataFrame:
    """Parallel lines beside each edge on the allowed sides: ``line_id, side, x0..y1`` (lon, lat).

    ``line_id`` orders lines as edges in id order, left before right. Edges without length give no line.
    """
    rows = []
    for k, (side, metres) in enumerate((("left", LEFT_M), ("right", RIGHT_M))):
        x0, y0, x1, y1 = offset_line("lon0", "lat0", "lon1", "lat1", metres, side)
        line = F.struct((F.col(edge_id) * 2 + k).alias("line_id"), F.lit(side).alias("side"),
                        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
        rows.append(F.when(parking_allowed(tag_cols, side, override), line))
    drawn = (F.col("lon0") != F.col("lon1")) | (F.col("lat0") != F.col("lat1"))
    return edges.where(drawn).select(edge_id, *extra, F.inline(F.array_compact(F.array(*rows))))


def nearest_edge_by_side(cars: DataFrame, lines: DataFrame, keys, car_id, side: str = "side", xy=("lon", "lat"),
                         payload=(), max_dist: float | None = None, metric: str = "deg") -> DataFrame:
    """Nearest parking line on the wanted side; all lines when the side is unknown or has none.

    Distances are in degrees as drawn; ``metric='m'`` scales longitudes by the latitude first.
    """
    keys = list(keys)
    ends = ("x0", "y0", "x1", "y1")
    if metric == "m":
        shrink = lambda c, lat: F.col(c) * F.cos(F.radians(lat)) * 111320
        mid = (F.col("y0") + F.col("y1")) / 2
        lines = lines.select(*[c for c in lines.columns if c not in ends], shrink("x0", mid).alias("x0"), (F.col("y0") * 111320).alias("y0"),
                             shrink("x1", mid).alias("x1"), (F.col("y1") * 111320).alias("y1"))
        cars = cars.withColumn("_px", shrink(xy[0], F.col(xy[1]))).withColumn("_py", F.col(xy[1]) * 111320)
        xy = ("_px", "_py")
    have = lines.select(*keys, "side").distinct().select(*keys, F.col("side").alias("_want_side"), F.col("side").alias("_want"))
    wanted = cars.withColumn("_want_side", F.lower(side)).join(have, [*keys, "_want_side"], "left")
    wanted = wanted.withColumn("_want", F.coalesce("_want", F.lit("any"))).drop("_want_side")
    target = lines.withColumn("line_side", F.col("side")).select("*", F.explode(F.array("side", F.lit("any"))).alias("_want"))
    near = nearest_target(wanted, target, [*keys, "_want"], car_id, xy, segment(*ends), "line_id",
                        ("line_side", *payload))
    near = near.drop("_want", "_px", "_py")
    return near if max_dist is None else near.where(F.col("dist") < max_dist)


def spawn_positions(cars: DataFrame, lines: DataFrame, keys, car_id: str, offset: tuple, edge_id: str = "edge_id",
                    orient: str = "orient", side: str = "side", xy=("lon", "lat")) -> DataFrame:
    """Simulation position and heading of every parked car beside its nearest parking line."""
    keys = list(keys)
    headed = local_tmerc_heading(lines, "y0", "x0", "y1", "x1", "_line_heading")
    near = nearest_edge_by_side(cars, headed, keys, [*keys, car_id], side, xy, (edge_id, "_line_heading"))
    centre = cars.groupBy(*keys).agg(F.avg(xy[1]).alias("_clat"), F.avg(xy[0]).alias("_clon"))
    near = attach(near, centre, keys)
    mode = F.when(F.lower(orient).isin("parallel", "perpendicular"), F.lower(orient)).otherwise("parallel")
    near = near.withColumn("mode", mode)
    turn = F.when(F.col("line_side") == "left", 180.0).otherwise(0.0) + F.when(F.col("mode") == "perpendicular", 90.0).otherwise(0.0)
    heading = F.pmod(F.col("_line_heading") + turn - grid_convergence("_clat", "_clon"), F.lit(360.0))
    near = wgs84_to_tmerc(near.withColumn("heading", heading), xy[1], xy[0], "_mx", "_my")
    sx, sy = F.col("_mx") + offset[0], -(F.col("_my") + offset[1])
    return near.select(
        *keys, F.col(car_id).alias("cluster_id"), F.col("line_side").alias("side"), F.col(edge_id).alias("street_id"), "mode",
        F.array(sx, sy, F.lit(0.0)).alias("start"), F.array(sx + 0.0001, sy + 0.0001, F.lit(0.0)).alias("end"), "heading")


def bbox_filter(df: DataFrame, lat: float, lon: float, dist: float, lat_col="lat", lon_col="lon", kinds: str | None = None) -> DataFrame:
    """Features within ``dist`` metres north/south/east/west of a point; ``kinds`` is a tag map column."""
    radius = 6_371_009.0  # mean earth radius used for the box
    dlat = math.degrees(dist / radius)
    dlon = dlat / math.cos(math.radians(lat))
    out = df.where(F.col(lat_col).between(lat - dlat, lat + dlat) & F.col(lon_col).between(lon - dlon, lon + dlon))
    if kinds:
        out = out.where(F.col(kinds)["building"].isNotNull() | F.col(kinds)["highway"].isNotNull())
    return out


def road_level_address(address: str, display: str):
    """Road, first known area and first known town of a reverse-geocoded address map, else its name."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(address)[n], F.lit("")) for n in names])
    text = F.concat_ws(", ", pick("road"), pick("neighbourhood", "suburb", "quarter", "city_district"),
                       pick("city", "town", "municipality", "village"))
    return F.when(text != "", text).otherwise(F.col(display))


# --- buildings and map centre -------------------------------------------------------------------------
def map_centre(nodes: DataFrame, bounds: DataFrame, keys) -> DataFrame:
    """Centre of the declared bounds, else the middle of the node extents."""
    mid = nodes.groupBy(*keys).agg(((F.min("lat") + F.max("lat")) / 2).alias("_nlat"), ((F.min("lon") + F.max("lon")) / 2).alias("_nlon"))
    b = bounds.select(*keys, ((F.col("minlat") + F.col("maxlat")) / 2).alias("_blat"), ((F.col("minlon") + F.col("maxlon")) / 2).alias("_blon"))
    return mid.join(b, list(keys), "full_outer").select(
        *keys, F.coalesce("_blat", "_nlat").alias("lat"), F.coalesce("_blon", "_nlon").alias("lon"))


def building_stats(nodes: DataFrame, ways: DataFrame, keys, level_height: float = 3.0) -> DataFrame:
    """Mean local offset and height of each building around the centroid of all building vertices."""
    keys = list(keys)
    b = ways.where(F.col("tags")["building"].isNotNull())
    v = b.select(*keys, "way_id", F.coalesce(F.try_to_number(F.col("tags")["building:levels"], F.lit("999.99")).cast("double"), F.lit(1.0)).alias("levels"),
                 F.explode("refs").alias("id")).join(nodes, [*keys, "id"])
    centre = v.groupBy(*keys).agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"))
    dx, dz = local_equirect(F.col("_clat"), F.col("_clon"), F.col("lat"), F.col("lon"))
    return attach(v, centre, keys).groupBy(*keys, "way_id").agg(
        F.avg(dx).alias("offset_x"), F.avg(dz).alias("offset_z"), (F.max("levels") * level_height).alias("height"),
        F.count(F.lit(1)).alias("vertices"))


# --- scene documents ----------------------------------------------------------------------------------
def vehicle_doc_merge(final: DataFrame, source: DataFrame, keys, hero: DataFrame | None = None,
                      spawns: DataFrame | None = None, dist: int | None = None) -> DataFrame:
    """Upsert of scene documents: the final document wins over the source one, else empty.

    Documents have ``offset, dist, hero_car, spawn_positions`` and may have the legacy ``start``
    (used for a missing hero) and ``parking``; legacy fields are dropped. ``hero`` and ``spawns``
    replace the stored part of their keys.
    """
    keys = list(keys)
    zero = "named_struct('x', 0.0d, 'y', 0.0d, 'heading', 0.0d)"

    def doc(df, name):
        fields = [F.col(f) if f in df.columns else F.lit(None).alias(f) for f in ("offset", "dist", "hero_car", "spawn_positions", "start")]
        return df.select(*keys, F.struct(*fields).alias(name))

    j = doc(final, "_f").join(doc(source, "_s"), keys, "full_outer").select(*keys, F.coalesce("_f", "_s").alias("d"))
    extra = []
    for df, name in ((hero, "_hero"), (spawns, "_spawns")):
        if df is not None:
            j = j.join(df.withColumnRenamed("hero_car" if name == "_hero" else "spawn_positions", name), keys, "full_outer")
            extra.append(name)
    c0 = lambda f: F.coalesce(F.col(f"d.start.{f}"), F.lit(0.0))
    legacy = F.when(F.col("d.start").isNotNull(), F.struct(F.array(c0("x"), c0("y"), c0("z")).alias("position"), c0("yaw").alias("heading")))
    none = F.struct(F.array(*[F.lit(0.0)] * 3).alias("position"), F.lit(0.0).alias("heading"))
    hero_parts = [F.col("_hero")] if hero is not None else []
    spawn_parts = [F.col("_spawns")] if spawns is not None else []
    return j.select(
        *keys, F.coalesce(F.col("d.offset"), F.expr(zero)).alias("offset"),
        (F.lit(dist) if dist is not None else F.coalesce(F.col("d.dist"), F.lit(200))).cast("int").alias("dist"),
        F.coalesce(*hero_parts, F.col("d.hero_car"), legacy, none).alias("hero_car"),
        F.coalesce(*spawn_parts, F.col("d.spawn_positions"), F.array()).alias("spawn_positions"))


def hero_start(odom_rear: DataFrame, rear: DataFrame, docs: DataFrame, keys, pos: str, z_offset: float = 0.5) -> DataFrame:
    """Start pose: odometry-yaw rear trajectory, else rear trajectory, else the document's hero."""
    def first(df, prio, source):
        pick = F.min_by(F.struct("x", "y", "z", "yaw"), pos)
        return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, F.struct(F.lit(prio).alias("prio"), F.lit(source).alias("source"), F.col("_p").alias("p")).alias("_c"))

    hero = docs.where(F.col("hero_car").isNotNull()).select(*keys, F.struct(
        F.lit(2).alias("prio"), F.lit("document").alias("source"),
        F.struct(*[F.col("hero_car.position")[i].alias(c) for i, c in enumerate("xyz")], F.col("hero_car.heading").alias("yaw")).alias("p")).alias("_c"))
    every = first(odom_rear, 0, "odom_rear").unionByName(first(rear, 1, "rear")).unionByName(hero)
    best = every.groupBy(*keys).agg(F.min_by("_c", F.col("_c.prio")).alias("_b"))
    return best.select(*keys, F.col("_b.source").alias("source"), F.col("_b.p.x").alias("x"), F.col("_b.p.y").alias("y"),
                       (F.col("_b.p.z") + z_offset).alias("z"), F.col("_b.p.yaw").alias("yaw"))


def order_runs(df: DataFrame, *cols: str) -> DataFrame:
    """Deterministic report order."""
    return df.orderBy(*cols)


# Box of a car inserted by hand, and the step of a nudge (metres, radians).
INSERT_BOX = (4.5, 1.8, 1.5)
NUDGE_M, NUDGE_RAD = 0.2, 0.05


def apply_edits(base: DataFrame, log: DataFrame, keys) -> DataFrame:
    """Replay an edit log on car tables without an ordered per-car loop.

    ``base``: keys, ``id, x, y, z, l, w, h, yaw, count, conf, side, orient``. ``log``: keys, ``seq, op,
    id, dx, dy, dz, dyaw``; ``op`` is delete, toggle_orient, toggle_side, move (dx, dy are the new
    position), insert (at dx, dy, dz) or nudge (steps forward / left / up / turn of ``NUDGE_M`` and
    ``NUDGE_RAD``, in the direction the car has at that moment). Deleting is final, a position is
    the last move plus the nudges after it, and toggles depend on their number only.
    """
    keys = list(keys)
    kid = [*keys, "id"]
    op = F.col("op")
    ins = log.where(op == "insert").groupBy(*kid).agg(
        F.max_by(F.struct("dx", "dy", F.coalesce("dz", F.lit(0.0)).alias("dz")), "seq").alias("_i"))
    born = ins.select(
        *kid, F.col("_i.dx").alias("x"), F.col("_i.dy").alias("y"), F.col("_i.dz").alias("z"),
        *[F.lit(v).alias(n) for v, n in zip(INSERT_BOX, "lwh")], F.lit(0.0).alias("yaw"), F.lit(1).cast("long").alias("count"),
        F.lit(1.0).alias("conf"), F.lit("right").alias("side"), F.lit("parallel").alias("orient"))
    cars = base.select(*born.columns).unionByName(born.join(base, kid, "left_anti"))
    moved = log.where(op == "move").groupBy(*kid).agg(F.max("seq").alias("_mseq"), F.max_by(F.struct("dx", "dy"), "seq").alias("_m"))

    def steps(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    # direction before each nudge: start yaw plus all earlier turns
    nudges = log.where(op == "nudge").select(
        *kid, "seq", (steps("dx") * NUDGE_M).alias("f"), (steps("dy") * NUDGE_M).alias("l"),
        (steps("dz") * NUDGE_M).alias("u"), (steps("dyaw") * NUDGE_RAD).alias("t"))
    nudges = materialize(dense_number(nudges, kid, ["seq"], "_pos"), "nudges")
    nudges = running(nudges, kid, "_pos", {"_turned": ("sum", F.col("t"))})
    nudges = nudges.join(cars.select(*kid, "yaw"), kid).join(moved.drop("_m"), kid, "left")
    nudges = nudges.select("*", (F.col("yaw") + F.col("_turned") - F.col("t")).alias("_dir"))
    after = F.col("_mseq").isNull() | (F.col("seq") > F.col("_mseq"))
    sin, cos = F.sin("_dir"), F.cos("_dir")
    push = nudges.groupBy(*kid).agg(
        F.sum(F.when(after, F.col("f") * cos - F.col("l") * sin)).alias("_nx"),
        F.sum(F.when(after, F.col("f") * sin + F.col("l") * cos)).alias("_ny"),
        F.sum("u").alias("_nz"), F.sum("t").alias("_nyaw"))
    marks = log.where(op.isin("delete", "toggle_orient", "toggle_side")).groupBy(*kid).agg(
        F.max(op == "delete").alias("_del"), F.count_if(op == "toggle_orient").alias("_no"), F.count_if(op == "toggle_side").alias("_ns"))
    j = cars.join(moved, kid, "left").join(push, kid, "left").join(marks, kid, "left").where(~F.coalesce("_del", F.lit(False)))

    def z(c):
        return F.coalesce(c, F.lit(0.0))

    def toggled(c, n, a, b):
        odd = F.when(F.col(c) == a, b).otherwise(a)
        even = F.when(odd == a, b).otherwise(a)
        n = F.coalesce(n, F.lit(0))
        return F.when(n == 0, F.col(c)).when(n % 2 == 1, odd).otherwise(even)

    return j.select(
        *kid, (F.coalesce("_m.dx", "x") + z("_nx")).alias("x"), (F.coalesce("_m.dy", "y") + z("_ny")).alias("y"),
        (F.col("z") + z("_nz")).alias("z"), "l", "w", "h", (F.col("yaw") + z("_nyaw")).alias("yaw"), "count", "conf",
        toggled("side", "_ns", "left", "right").alias("side"), toggled("orient", "_no", "parallel", "perpendicular").alias("orient"))
