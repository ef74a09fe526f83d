"""Queries: class maps, overlap scores, colours, speckles, incremental results, model batches."""

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wheeltrace.operators import images as Im
from wheeltrace.plans.derived import cte, derived, table
from wheeltrace.plans.registry import q, query, r
from wheeltrace.sources.python_sources import write_files
from wheeltrace.sources.readers import read_label_images as read_images
from wheeltrace.sources.sinks import incremental_results as incremental
from wheeltrace.session import scratch_folder

_CM = {"cm": "SELECT p.frame, g.gt, g.pred, count(*) FILTER (WHERE p.gt = g.gt AND p.pred = g.pred) AS n FROM pixels p, (SELECT unnest([0,0,0,1,1,1,2,2,2]) AS gt, unnest([0,1,2,0,1,2,0,1,2]) AS pred) g GROUP BY p.frame, g.gt, g.pred"}


@query("confusion_matrix", cte("SELECT frame, gt, pred, n FROM cm", "pixels", extra=_CM))
def confusion_matrix(spark, sf):
    return Im.confusion_matrix(derived(spark, sf, "pixels"), ["frame"], "gt", "pred")


_IOU = {
    **_CM,
    "cls": """SELECT frame, c, sum(CASE WHEN gt = c AND pred = c THEN n ELSE 0 END) AS d, sum(CASE WHEN gt = c THEN n ELSE 0 END) AS g, sum(CASE WHEN pred = c THEN n ELSE 0 END) AS p
      FROM cm, (SELECT unnest([0, 1, 2]) AS c) GROUP BY frame, c""",
    "sc": "SELECT frame, c, g, CAST(d AS DOUBLE)/greatest(g + p - d, 1) AS iou FROM cls",
    "io": """SELECT frame, max(CASE WHEN c = 0 THEN iou END) AS iou_background, max(CASE WHEN c = 1 THEN iou END) AS iou_car,
      max(CASE WHEN c = 2 THEN iou END) AS iou_road, avg(CASE WHEN g > 0 THEN iou END) AS mean_iou FROM sc GROUP BY frame""",
}
_COLS = ("iou_background", "iou_car", "iou_road", "mean_iou")


def _iou(spark, sf):
    return Im.iou(Im.confusion_matrix(derived(spark, sf, "pixels"), ["frame"], "gt", "pred"), ["frame"])


@query("iou", cte("SELECT frame, " + ", ".join(f"{q(c)} AS {c}" for c in _COLS) + " FROM io", "pixels", extra=_IOU))
def iou(spark, sf):
    return _iou(spark, sf).select("frame", *[r(c).alias(c) for c in _COLS])


@query("iou_summary", cte(" UNION ALL ".join(f"SELECT '{c}' AS score, {q(f'avg({c})')} AS mean, {q(f'stddev_pop({c})')} AS std, count({c}) AS n FROM io" for c in _COLS), "pixels", extra=_IOU))
def iou_summary(spark, sf):
    return Im.iou_summary(_iou(spark, sf), _COLS).select("score", r("mean").alias("mean"), r("std").alias("std"), "n")


_RGB = "(l_partkey*7) % 160 AS cr, (l_orderkey*5) % 80 AS cg, (l_partkey*3 + l_linenumber*11) % 160 AS cb"
_NEARC = lambda c: f"abs(cr - {c[0]}) <= 15 AND abs(cg - {c[1]}) <= 15 AND abs(cb - {c[2]}) <= 15"


@query("palette_map", cte(f"""SELECT frame, cls, count(*) AS n FROM (SELECT frame, CASE WHEN {_NEARC((128, 64, 128))} THEN 2 WHEN {_NEARC((0, 0, 142))} THEN 1 ELSE 0 END AS cls
   FROM (SELECT frame, {_RGB} FROM pixels)) GROUP BY frame, cls""", "pixels"))
def palette_map(spark, sf):
    px = derived(spark, sf, "pixels").selectExpr("frame", *_RGB.split(", "))
    cls = Im.class_of_rgb("cr", "cg", "cb")
    return px.select("frame", cls.alias("cls")).groupBy("frame", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("recolour", cte("""SELECT l_orderkey, l_linenumber, CASE WHEN c = 0 THEN 8405120 WHEN c = 4620980 THEN 0 ELSE c END AS rgb, CASE WHEN k = 0 THEN 2 WHEN k = 13 THEN 1 ELSE 0 END AS cls
   FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 19 AS INT) AS k, CASE CAST(l_partkey % 19 AS INT) WHEN 0 THEN 8405120 WHEN 10 THEN 4620980 WHEN 13 THEN 142 ELSE 0 END AS c FROM pixels)""", "pixels"))
def recolour(spark, sf):
    px = derived(spark, sf, "pixels").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 19).cast("int").alias("k"))
    packed = F.when(F.col("k").isin(0, 10, 13), Im.rgb_of_class("k")).otherwise(F.lit(0))
    return px.select("l_orderkey", "l_linenumber", Im.recolour(packed).alias("rgb"), Im.reduce_classes("k").alias("cls"))


_INST = "CAST(l_partkey % 256 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS b, CAST(12 + l_linenumber AS INT) AS tag"
_ICOL = lambda i, j: f"CASE WHEN tag IN (14, 15, 16, 18) THEN (g*{i} + b*{j}) % 200 + 55 ELSE 0 END"


@query("instance_colour", cte(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r = 55 THEN 1 ELSE r END AS r, gg AS g, bb AS b FROM (SELECT *, {_ICOL(37, 13)} AS r, {_ICOL(17, 43)} AS gg, {_ICOL(29, 53)} AS bb
   FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_INST} FROM pixels))""", "pixels"))
def instance_colour(spark, sf):
    px = derived(spark, sf, "pixels").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *_INST.split(", "))
    px = px.select("l_orderkey", "l_linenumber", "l_partkey", Im.instance_colour("g", "b", "tag").alias("c"))
    remap = px.where("c.r = 55").selectExpr("c.r", "c.g", "c.b", "1 as r2", "c.g as g2", "c.b as b2").distinct()
    return Im.remap_colours(px, "c", remap).select("l_orderkey", "l_linenumber", "l_partkey", "c.r", "c.g", "c.b")


@query("unique_instance_colours", cte(f"""SELECT DISTINCT frame, {_ICOL(37, 13)} AS r, {_ICOL(17, 43)} AS g, {_ICOL(29, 53)} AS b FROM (SELECT frame, {_INST} FROM pixels) WHERE tag IN (14, 15, 16, 18)""", "pixels"))
def unique_instance_colours(spark, sf):
    px = derived(spark, sf, "pixels").selectExpr("frame", *_INST.split(", "))
    return Im.unique_instance_colours(px, "frame", "g", "b", "tag")


def png(rgb: np.ndarray) -> bytes:
    """A plain PNG file of an image (rows x columns x 3 bytes)."""
    h, w, _ = rgb.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, 3 * w)], 1).tobytes()
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def _maps(spark, sf):
    """8 x 8 class maps from the vectors: class by value range."""
    return derived(spark, sf, "cameras").select(
        F.col("frame_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("c2w", lambda v: F.when(v > 0.05, 2).when(v < -0.05, 1).otherwise(0).cast("tinyint")).alias("cls"))


@query("read_label_images", cte("""SELECT frame, CAST((k - 1) // 8 AS BIGINT) AS y, CAST((k - 1) % 8 AS BIGINT) AS x, CASE WHEN v > 0.05e0 THEN 2 WHEN v < -0.05e0 THEN 1 ELSE 0 END AS cls
   FROM (SELECT frame_id AS frame, unnest(range(1, 65)) AS k, CAST(unnest(c2w) AS DOUBLE) AS v FROM cameras)""", "cameras"))
def read_label_images(spark, sf):
    def paint(batches):  # image files in noisy palette colours
        pal = np.array([[1, 2, 3], [2, 5, 140], [131, 66, 120]], dtype=np.uint8)
        for pdf in batches:
            shots = [pal[np.array(c).reshape(h, w)] for c, h, w in zip(pdf["cls"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"name": [f"frame_{f}.png" for f in pdf["frame"]], "content": [png(rgb) for rgb in shots]})

    path = f"{scratch_folder(spark)}/images-{uuid.uuid4().hex}"
    write_files(_maps(spark, sf).mapInPandas(paint, "name string, content binary"), path)
    px = Im.pixel_rows(read_images(spark, path, size=None))
    return px.select(F.regexp_extract("frame", r"frame_(\d+)\.png$", 1).cast("long").alias("frame"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("cls").cast("int").alias("cls"))


_SPK = {
    "px": """SELECT frame, (k - 1) // 8 AS y, (k - 1) % 8 AS x, k, CASE WHEN v > 0.05e0 THEN 2 WHEN v < -0.05e0 THEN 1 ELSE 0 END AS cls
      FROM (SELECT frame_id AS frame, unnest(range(1, 65)) AS k, CAST(unnest(c2w) AS DOUBLE) AS v FROM cameras)""",
    "nb": "SELECT a.frame, a.k AS a, b.k AS b FROM px a JOIN px b ON a.frame = b.frame AND a.cls = b.cls AND a.cls > 0 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1",
    "rch": "SELECT frame, a, b FROM nb UNION SELECT r.frame, r.a, n.b FROM rch r JOIN nb n ON n.frame = r.frame AND n.a = r.b",
    "ar": "SELECT frame, a AS k, count(*) AS n FROM rch GROUP BY frame, a",
}


@query("despeckle", "WITH RECURSIVE " + cte("""SELECT p.frame, 8 AS h, 8 AS w, string_agg(CAST(CASE WHEN p.y = 7 THEN 2 WHEN a.n < 4 THEN 0 ELSE p.cls END AS VARCHAR), '' ORDER BY p.k) AS cls
   FROM px p LEFT JOIN ar a ON a.frame = p.frame AND a.k = p.k GROUP BY p.frame""", "cameras", extra=_SPK)[5:])
def despeckle(spark, sf):
    out = Im.despeckle(_maps(spark, sf), min_area=4, hood=1)
    return out.select("frame", "h", "w", F.concat_ws("", F.transform("cls", lambda c: c.cast("string"))).alias("cls"))


@query("incremental_results", cte("SELECT score, mean, n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS score, {q(f'avg({c})')} AS mean, count({c}) AS n FROM io" for c in _COLS) + ")", "pixels", extra=_IOU))
def incremental_results(spark, sf):
    path = f"{scratch_folder(spark)}/iou-{uuid.uuid4().hex}"
    frames = derived(spark, sf, "pixels")

    def score(todo):
        return Im.iou(Im.confusion_matrix(todo, ["frame"], "gt", "pred"), ["frame"])

    incremental(frames.where("frame < 20"), score, path, ["frame"])  # a first, earlier delivery
    stored = incremental(frames, score, path, ["frame"])
    return Im.iou_summary(stored, _COLS).select("score", r("mean").alias("mean"), "n")


@query("batch_predict", cte("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(length(text) % 7 AS BIGINT) AS label FROM documents"))
def batch_predict(spark, sf):
    def make_model():
        return lambda pdf: pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["text"].str.len() % 7})

    docs = table(spark, sf, "documents").selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return Im.batch_predict(docs, make_model, "doc_id long, label long")
