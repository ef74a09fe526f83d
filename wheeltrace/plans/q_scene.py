"""Queries: roads, parking lines, spawn positions, documents, edits, buildings."""

from pyspark.sql import functions as F

from wheeltrace.operators import scene as Sc
from wheeltrace.operators.paths import offset_line as _offset_line
from wheeltrace.plans.derived import cte, derived, table
from wheeltrace.plans.q_time import OFFSET, tm_fwd
from wheeltrace.plans.registry import q, query, r, rounded

# nodes and ways of a small street grid, derived from suppliers and parts
_NODES = "SELECT CAST(s_suppkey AS BIGINT) AS id, 48.17e0 + floor(s_suppkey/10e0)*0.001e0 AS lat, 11.58e0 + (s_suppkey % 10)*0.002e0 AS lon FROM supplier"
_HIGH = """CASE p_partkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'footway' WHEN 2 THEN 'service' WHEN 3 THEN 'primary' ELSE 'unclassified' END"""
_WAYS = f"""SELECT CAST(p_partkey AS BIGINT) AS way_id, CAST(p_partkey % (SELECT count(*) FROM supplier) + 1 AS BIGINT) AS first_ref, CAST(p_size % 6 + 2 AS BIGINT) AS n_refs,
  {_HIGH} AS highway, CASE WHEN p_partkey % 4 = 0 THEN 'yes' END AS oneway, CAST(p_partkey % 7 AS BIGINT) AS lv FROM part"""


def _osm(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("_wt_supplier")
    table(spark, sf, "part").createOrReplaceTempView("_wt_part")
    nodes = spark.sql(_NODES.replace("FROM supplier", "FROM _wt_supplier"))
    ways = spark.sql(_WAYS.replace("FROM part", "FROM _wt_part").replace("FROM supplier", "FROM _wt_supplier"))
    return nodes, ways.select(
        "way_id", F.expr("transform(sequence(0L, n_refs - 1), k -> first_ref + k)").alias("refs"),
        F.expr("map_filter(map('highway', highway, 'oneway', oneway, 'building', case when way_id % 3 = 0 then 'yes' end,"
               " 'building:levels', case when lv > 1 then cast(lv as string) end), (k, v) -> v is not null)").alias("tags"))


_EDG = {
    "nodes": _NODES, "ways": _WAYS,
    "pairs": "SELECT way_id, highway, oneway, k AS seg, first_ref + k AS u, first_ref + k + 1 AS v FROM (SELECT *, unnest(range(n_refs - 1)) AS k FROM ways) WHERE highway <> 'footway'",
    "fwd": "SELECT p.*, a.lat AS lat0, a.lon AS lon0, b.lat AS lat1, b.lon AS lon1 FROM pairs p JOIN nodes a ON a.id = p.u JOIN nodes b ON b.id = p.v",
}


@query("osm_edges", cte(f"""SELECT way_id, seg, u, v, reversed, {q('lat0')} AS lat0, {q('lon1')} AS lon1 FROM (SELECT way_id, seg, u, v, false AS reversed, lat0, lon1 FROM fwd UNION ALL
   SELECT way_id, seg, v, u, true, lat1, lon0 FROM fwd WHERE oneway IS NULL)""", extra=_EDG))
def osm_edges(spark, sf):
    nodes, ways = _osm(spark, sf)
    return Sc.osm_edges(nodes, ways).select("way_id", F.col("seg").cast("long").alias("seg"), "u", "v", "reversed", r("lat0").alias("lat0"), r("lon1").alias("lon1"))


@query("edge_tags", cte("""SELECT f.way_id, f.seg, f.u, t.value AS parking FROM fwd f LEFT JOIN
   (SELECT s_suppkey AS id, s_nationkey % 3 AS value FROM supplier UNION ALL SELECT s_suppkey, 9 FROM supplier WHERE s_suppkey % 2 = 0) t ON CAST(f.way_id AS VARCHAR) = CAST(t.id AS VARCHAR)""", extra=_EDG))
def edge_tags(spark, sf):
    nodes, ways = _osm(spark, sf)
    sup = table(spark, sf, "supplier")
    tags = sup.selectExpr("s_suppkey as id", "cast(s_nationkey % 3 as int) as value").unionAll(
        sup.where("s_suppkey % 2 = 0").selectExpr("s_suppkey as id", "9 as value"))
    out = Sc.edge_tags(Sc.osm_edges(nodes, ways, both_directions=False), tags, "way_id", "id")
    return out.select("way_id", F.col("seg").cast("long").alias("seg"), "u", F.col("value").alias("parking"))


@query("parking_side_rules", cte("""SELECT edge_id, lower(parking_left) IN ('yes', 'parallel') OR edge_id % 5 = 0 AS left_ok, edge_id % 5 = 0 AS right_ok FROM edges""", "edges"))
def parking_side_rules(spark, sf):
    e = derived(spark, sf, "edges").withColumn("both_", F.expr("case when edge_id % 5 = 0 then 'Diagonal:both' else 'no' end"))
    tags = {"parking:left": "parking_left", "parking:lane:both": "both_"}
    return e.select("edge_id", Sc.parking_allowed(tags, "left").alias("left_ok"), Sc.parking_allowed(tags, "right").alias("right_ok"))


def _off(m, sign):
    d = f"({sign}{m}e0/111320e0)"
    ln = "sqrt((lon1-lon0)*(lon1-lon0)+(lat1-lat0)*(lat1-lat0))"
    return f"-(lat1-lat0)/{ln}*{d}", f"(lon1-lon0)/{ln}*{d}"


_LX, _LY = _off(6.0, "")
_RX, _RY = _off(5.2, "-")
_LINES = {
    "lines": f"""SELECT edge_id, edge_id*2 AS line_id, 'left' AS side, lon0 + {_LX} AS x0, lat0 + {_LY} AS y0, lon1 + {_LX} AS x1, lat1 + {_LY} AS y1 FROM edges
      UNION ALL SELECT edge_id, edge_id*2 + 1, 'right', lon0 + {_RX}, lat0 + {_RY}, lon1 + {_RX}, lat1 + {_RY} FROM edges""",
}


@query("offset_line", cte(f"SELECT line_id, {', '.join(f'{q(c, 9)} AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM lines", "edges", extra=_LINES))
def offset_line(spark, sf):
    e = derived(spark, sf, "edges")
    out = None
    for k, (side, m) in enumerate((("left", 6.0), ("right", 5.2))):
        c = _offset_line("lon0", "lat0", "lon1", "lat1", m, side)
        part = e.select((F.col("edge_id") * 2 + k).alias("line_id"), *[r(v, 9).alias(n) for v, n in zip(c, ("x0", "y0", "x1", "y1"))])
        out = part if out is None else out.unionByName(part)
    return out


_NEAR = {
    **_LINES,
    "cl": """SELECT c.cluster_id, c.lon, c.lat, c.side AS want, c.orient, l.*, greatest(0e0, least(1e0, ((c.lon-l.x0)*(l.x1-l.x0)+(c.lat-l.y0)*(l.y1-l.y0))/((l.x1-l.x0)*(l.x1-l.x0)+(l.y1-l.y0)*(l.y1-l.y0)))) AS u
      FROM cars c JOIN lines l ON c.side = 'unknown' OR l.side = c.side""",
    "cd": "SELECT *, (lon-x0-u*(x1-x0))*(lon-x0-u*(x1-x0)) + (lat-y0-u*(y1-y0))*(lat-y0-u*(y1-y0)) AS d2 FROM cl",
    "cn": "SELECT cluster_id, min(struct_pack(d := round(d2, 17), line_id := line_id)) AS m, min(sqrt(d2)) AS dist FROM cd GROUP BY cluster_id",
    "near": "SELECT d.*, n.dist FROM cn n JOIN cd d ON d.cluster_id = n.cluster_id AND d.line_id = n.m.line_id",
}


def _parking_lines(spark, sf):
    return Sc.parking_lines(derived(spark, sf, "edges"), "edge_id", {}, override=True)


@query("nearest_edge_by_side", cte(f"SELECT cluster_id, line_id, side AS line_side, {q('dist', 9)} AS dist FROM near", "edges", "cars", extra=_NEAR))
def nearest_edge_by_side(spark, sf):
    out = Sc.nearest_edge_by_side(derived(spark, sf, "cars"), _parking_lines(spark, sf), [], ["cluster_id"])
    return out.select("cluster_id", "line_id", "line_side", r("dist", 9).alias("dist"))


_SPAWN = {
    **_NEAR,
    **tm_fwd("lines", "y1", "x1", "x0", 1.0, "0e0", "hx", "hy", lat0="y0"),
    "lh": "SELECT line_id, degrees(atan2(-hy, hx)) + 360 AS lhead FROM lines_f",
    "ctr": "SELECT degrees(atan(tan(radians(avg(lon)))*sin(radians(avg(lat))))) AS conv FROM cars",
    "sp0": """SELECT n.cluster_id, n.edge_id, n.side, n.orient, n.lat, n.lon,
      h.lhead + CASE WHEN n.side = 'left' THEN 180 ELSE 0 END + CASE WHEN n.orient = 'perpendicular' THEN 90 ELSE 0 END - c.conv AS hd FROM near n JOIN lh h ON h.line_id = n.line_id, ctr c""",
    **tm_fwd("sp0", "lat", "lon", "0e0", 1.0, "0e0", "mx", "my"),
}


@query("spawn_positions", cte(f"SELECT cluster_id, edge_id AS street_id, side, orient AS mode, {q('mx - 880000e0', 4)} AS x, {q('-(my - 5390000e0)', 4)} AS y, {q('hd - 360*floor(hd/360e0)', 4)} AS heading FROM sp0_f", "edges", "cars", extra=_SPAWN))
def spawn_positions(spark, sf):
    out = Sc.spawn_positions(derived(spark, sf, "cars"), _parking_lines(spark, sf), [], "cluster_id", OFFSET)
    return out.select("cluster_id", "street_id", "side", "mode", r(F.col("start")[0], 4).alias("x"), r(F.col("start")[1], 4).alias("y"), r("heading", 4).alias("heading"))


@query("bbox_filter", cte("""SELECT cluster_id FROM cars WHERE lat BETWEEN 48.174e0 - degrees(200e0/6371009e0) AND 48.174e0 + degrees(200e0/6371009e0)
   AND lon BETWEEN 11.589e0 - degrees(200e0/6371009e0)/cos(radians(48.174e0)) AND 11.589e0 + degrees(200e0/6371009e0)/cos(radians(48.174e0))""", "cars"))
def bbox_filter(spark, sf):
    return Sc.bbox_filter(derived(spark, sf, "cars"), 48.174, 11.589, 200.0).select("cluster_id")


@query("road_level_address", cte("""SELECT c_custkey, CASE WHEN t <> '' THEN t ELSE c_name END AS address FROM (SELECT c_custkey, c_name, concat_ws(', ',
   CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment WHEN c_custkey % 4 = 2 THEN 'suburb' END,
   CASE WHEN c_custkey % 5 = 1 THEN 'town' WHEN c_custkey % 5 = 2 THEN 'village' END) AS t FROM customer)"""))
def road_level_address(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.expr(
        "map('road', case when c_custkey % 3 > 0 then c_name end, 'neighbourhood', case when c_custkey % 4 = 1 then c_mktsegment else '' end,"
        " 'suburb', case when c_custkey % 4 = 2 then 'suburb' end, 'city', '', 'town', case when c_custkey % 5 = 1 then 'town' end,"
        " 'village', case when c_custkey % 5 = 2 then 'village' end)").alias("a"))
    return c.select("c_custkey", Sc.road_level_address("a", "c_name").alias("address"))


@query("map_centre", cte(f"""SELECT n.nation, {q('coalesce(b.la, (min(lat0)+max(lat0))/2)', 8)} AS lat, {q('coalesce(b.lo, (min(lon0)+max(lon0))/2)', 8)} AS lon FROM edges n LEFT JOIN
   (SELECT CAST(n_nationkey AS BIGINT) AS nation, 48e0 + n_nationkey*0.01e0 AS la, 11e0 + n_nationkey*0.02e0 AS lo FROM nation WHERE n_regionkey = 1) b ON b.nation = n.nation GROUP BY n.nation, b.la, b.lo""", "edges"))
def map_centre(spark, sf):
    nodes = derived(spark, sf, "edges").select("nation", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))
    nat = table(spark, sf, "nation").where("n_regionkey = 1").selectExpr(
        "cast(n_nationkey as bigint) as nation", "47.5d + n_nationkey*0.01d as minlat", "48.5d + n_nationkey*0.01d as maxlat",
        "10.5d + n_nationkey*0.02d as minlon", "11.5d + n_nationkey*0.02d as maxlon")
    present = nat.join(nodes, "nation", "left_semi")
    return rounded(Sc.map_centre(nodes, present, ["nation"]), "nation", lat="lat", lon="lon", digits=8)


_BLD = {
    "nodes": _NODES, "ways": _WAYS,
    "bv": "SELECT w.way_id, w.lv, n.lat, n.lon FROM (SELECT *, unnest(range(n_refs)) AS k FROM ways WHERE way_id % 3 = 0) w JOIN nodes n ON n.id = w.first_ref + w.k",
    "bc": "SELECT avg(lat) AS clat, avg(lon) AS clon FROM bv",
}


@query("building_stats", cte(f"""SELECT way_id, {q('avg((lon - clon)*40075000*cos(radians(clat))/360)', 4)} AS offset_x, {q('avg((lat - clat)*111320)', 4)} AS offset_z,
   CASE WHEN max(lv) > 1 THEN max(lv) ELSE 1 END*3e0 AS height, count(*) AS vertices FROM bv, bc GROUP BY way_id""", extra=_BLD))
def building_stats(spark, sf):
    nodes, ways = _osm(spark, sf)
    out = Sc.building_stats(nodes, ways, [])
    return out.select("way_id", r("offset_x", 4).alias("offset_x"), r("offset_z", 4).alias("offset_z"), "height", "vertices")


def _docs(spark, sf):
    """Stored and source scene documents per customer, some legacy, some missing."""
    c = table(spark, sf, "customer").selectExpr("cast(c_custkey as bigint) as id", "cast(c_acctbal as double) as bal")
    pos = "named_struct('position', array(bal, bal + 1, 0.5d), 'heading', bal / 100)"
    final = c.where("id % 3 = 0").selectExpr(
        "id", "cast(null as struct<x:double,y:double,heading:double>) as offset", "150 as dist",
        f"case when id % 2 = 0 then {pos} end as hero_car", "array(named_struct('n', id)) as spawn_positions",
        "named_struct('x', bal * 2, 'y', cast(null as double), 'z', 1.0d, 'yaw', 2.0d) as start")
    source = c.where("id % 5 = 0").selectExpr(
        "id", "named_struct('x', bal, 'y', 0.0d, 'heading', 0.0d) as offset", "cast(null as int) as dist", f"{pos} as hero_car",
        "cast(null as array<struct<n:bigint>>) as spawn_positions")
    return final, source


@query("vehicle_doc_merge", cte(f"""SELECT id, {q('CASE WHEN id % 3 = 0 THEN 0e0 ELSE bal END')} AS off_x, CASE WHEN id % 3 = 0 THEN 150 ELSE 200 END AS dist,
   {q('CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN bal*2 ELSE bal END')} AS hx, {q('CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 2e0 ELSE bal/100 END')} AS heading,
   CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS n FROM (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS bal FROM customer) WHERE id % 3 = 0 OR id % 5 = 0"""))
def vehicle_doc_merge(spark, sf):
    out = Sc.vehicle_doc_merge(*_docs(spark, sf), ["id"])
    return out.select("id", r("offset.x").alias("off_x"), "dist", r(F.col("hero_car.position")[0]).alias("hx"),
                      r("hero_car.heading").alias("heading"), F.size("spawn_positions").alias("n"))


@query("hero_start", cte(f"""SELECT bag, source, {q('x')} AS x, {q('z')} AS z FROM (SELECT bag, CASE WHEN bag % 2 = 0 THEN 'odom_rear' WHEN bag % 3 = 0 THEN 'rear' ELSE 'document' END AS source,
   CASE WHEN bag % 2 = 0 THEN tx WHEN bag % 3 = 0 THEN tx + 1 ELSE tx + 2 END AS x, tz + 0.5e0 AS z FROM odom WHERE idx = 0)""", "odom"))
def hero_start(spark, sf):
    o = derived(spark, sf, "odom").selectExpr("bag", "idx", "tx as x", "ty as y", "tz as z", "yaw")
    rear = o.where("bag % 3 = 0").withColumn("x", F.col("x") + 1)
    docs = o.where("idx = 0").selectExpr("bag", "named_struct('position', array(x + 2, y, z), 'heading', yaw) as hero_car")
    out = Sc.hero_start(o.where("bag % 2 = 0"), rear, docs, ["bag"], "idx")
    return out.select("bag", "source", r("x").alias("x"), r("z").alias("z"))


@query("order_runs", cte("SELECT kind AS method, run, count(*) AS points FROM runs GROUP BY kind, run ORDER BY method, run", "runs"))
def order_runs(spark, sf):
    n = derived(spark, sf, "runs").groupBy(F.col("kind").alias("method"), "run").agg(F.count(F.lit(1)).alias("points"))
    return Sc.order_runs(n, "method", "run")


# edit log: every order is one edit of a car
_LOG = """SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(o_custkey AS BIGINT) AS id, CASE WHEN o_orderkey % 97 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'toggle_orient'
   WHEN o_orderkey % 5 = 1 THEN 'toggle_side' WHEN o_orderkey % 5 = 2 THEN 'move' ELSE 'nudge' END AS op,
   CAST(o_orderkey % 11 AS DOUBLE) - 5e0 AS dx, CAST(o_orderkey % 7 AS DOUBLE) - 3e0 AS dy, 1e0 AS dz, CAST(o_orderkey % 3 AS DOUBLE) - 1e0 AS dyaw FROM orders"""
_INS = "SELECT CAST(-1 AS BIGINT) AS seq, CAST(100000 + s_suppkey AS BIGINT) AS id, 'insert' AS op, CAST(s_suppkey AS DOUBLE) AS dx, 2e0 AS dy, 0e0 AS dz, 0e0 AS dyaw FROM supplier"
_EDIT = {
    "log": f"{_LOG} UNION ALL {_INS}",
    "car0": "SELECT cluster_id AS id, lon*1000 AS x, lat*1000 AS y, 0.3e0 AS yaw, side, orient FROM cars UNION ALL SELECT id, dx, dy, 0e0, 'right', 'parallel' FROM log WHERE op = 'insert'",
    "mv": "SELECT id, max(seq) AS ms, arg_max(dx, seq) AS mx, arg_max(dy, seq) AS my FROM log WHERE op = 'move' GROUP BY id",
    "nu": """SELECT l.id, l.seq, l.dx*0.2e0 AS f, l.dy*0.2e0 AS lf, l.dyaw*0.05e0 AS t,
      c.yaw + sum(l.dyaw*0.05e0) OVER (PARTITION BY l.id ORDER BY l.seq) - l.dyaw*0.05e0 AS dir FROM log l JOIN car0 c ON c.id = l.id WHERE l.op = 'nudge'""",
    "pu": """SELECT n.id, sum(CASE WHEN m.ms IS NULL OR n.seq > m.ms THEN f*cos(dir) - lf*sin(dir) ELSE 0 END) AS nx,
      sum(CASE WHEN m.ms IS NULL OR n.seq > m.ms THEN f*sin(dir) + lf*cos(dir) ELSE 0 END) AS ny, sum(t) AS nt FROM nu n LEFT JOIN mv m ON m.id = n.id GROUP BY n.id""",
    "mk": "SELECT id, bool_or(op = 'delete') AS del, count(*) FILTER (WHERE op = 'toggle_orient') AS no, count(*) FILTER (WHERE op = 'toggle_side') AS ns FROM log GROUP BY id",
}


def _flip(c, n, a, b):
    odd = f"CASE WHEN {c} = '{a}' THEN '{b}' ELSE '{a}' END"
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN {c} WHEN {n} % 2 = 1 THEN {odd} ELSE (CASE WHEN ({odd}) = '{a}' THEN '{b}' ELSE '{a}' END) END"


@query("apply_edits", cte(f"""SELECT c.id, {q('coalesce(m.mx, c.x) + coalesce(p.nx, 0)')} AS x, {q('coalesce(m.my, c.y) + coalesce(p.ny, 0)')} AS y, {q('c.yaw + coalesce(p.nt, 0)')} AS yaw,
   {_flip('c.side', 'k.ns', 'left', 'right')} AS side, {_flip('c.orient', 'k.no', 'parallel', 'perpendicular')} AS orient FROM car0 c
   LEFT JOIN mv m ON m.id = c.id LEFT JOIN pu p ON p.id = c.id LEFT JOIN mk k ON k.id = c.id WHERE NOT coalesce(k.del, false)""", "cars", extra=_EDIT))
def apply_edits(spark, sf):
    for t in ("orders", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(f"_wt_{t}")
    log = spark.sql(f"{_LOG} UNION ALL {_INS}".replace("FROM orders", "FROM _wt_orders").replace("FROM supplier", "FROM _wt_supplier"))
    base = derived(spark, sf, "cars").selectExpr(
        "cluster_id as id", "lon*1000 as x", "lat*1000 as y", "0.0d as z", "4.5d as l", "1.8d as w", "1.5d as h", "0.3d as yaw",
        "3L as count", "0.9d as conf", "side", "orient")
    out = Sc.apply_edits(base, log, [])
    return rounded(out, "id", "side", "orient", x="x", y="y", yaw="yaw").select("id", "x", "y", "yaw", "side", "orient")
