"""Class maps, palettes, confusion matrices, overlap scores, speckle removal, batch prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.functions.angles import col

# Class palette (RGB) of the label images.
PALETTE = {(0, 0, 0): 0, (0, 0, 142): 1, (128, 64, 128): 2}
CLASS_NAMES = ("background", "car", "road")
BACKGROUND, ROAD, SKY = (0, 0, 0), (128, 64, 128), (70, 130, 180)
VEHICLE_TAGS = (14, 15, 16, 18)
# The public street-scene palette of 19 classes, by class id.
STREET_PALETTE = (
    (128, 64, 128), (244, 35, 232), (70, 70, 70), (102, 102, 156), (190, 153, 153), (153, 153, 153),
    (250, 170, 30), (220, 220, 0), (107, 142, 35), (152, 251, 152), (70, 130, 180), (220, 20, 60),
    (255, 0, 0), (0, 0, 142), (0, 0, 70), (0, 60, 100), (0, 80, 100), (0, 0, 230), (119, 11, 32),
)
# Classes that the simulator palette paints black, and the one it paints as road.
SIM_BLACK = (2, 3, 4, 5, 8, 9, 10)
SIM_ROAD = (0, 1)


def class_of_rgb(r, g, b, palette: dict = PALETTE, tolerance: int = 15) -> Column:
    """Class of a colour; the last palette entry within tolerance on all channels wins, default 0."""
    r, g, b = col(r), col(g), col(b)
    out = F.lit(0)
    for (pr, pg, pb), cls in palette.items():
        near = (F.abs(r - pr) <= tolerance) & (F.abs(g - pg) <= tolerance) & (F.abs(b - pb) <= tolerance)
        out = F.when(near, F.lit(cls)).otherwise(out)
    return out


def rgb_of_class(cls, simulator: bool = False) -> Column:
    """Packed colour (r * 65536 + g * 256 + b) of a street-scene class id; unknown ids are black."""
    table = [
        ROAD if simulator and i in SIM_ROAD else BACKGROUND if simulator and i in SIM_BLACK else c
        for i, c in enumerate(STREET_PALETTE)
    ]
    arr = F.array(*[F.lit(r * 65536 + g * 256 + b) for r, g, b in table])
    return F.coalesce(F.try_element_at(arr, (col(cls) + 1).cast("int")), F.lit(0))


def recolour(rgb) -> Column:
    """Packed colour after black -> road, then sky -> black (the order matters)."""
    pack = lambda c: c[0] * 65536 + c[1] * 256 + c[2]
    first = F.when(col(rgb) == pack(BACKGROUND), F.lit(pack(ROAD))).otherwise(col(rgb))
    return F.when(first == pack(SKY), F.lit(pack(BACKGROUND))).otherwise(first)


def reduce_classes(cls, road_id: int = 0, car_id: int = 13) -> Column:
    """Keep road and car of a street-scene map (classes of ``PALETTE``), everything else background."""
    return F.when(col(cls) == road_id, F.lit(2)).when(col(cls) == car_id, F.lit(1)).otherwise(F.lit(0))


def instance_colour(g, b, tag) -> Column:
    """Colour struct of a vehicle instance from its two id bytes; black for other tags."""
    g, b = col(g).cast("int"), col(b).cast("int")
    mix = [((37, 13), "r"), ((17, 43), "g"), ((29, 53), "b")]
    on = F.struct(*[((g * i + b * j) % 200 + 55).alias(n) for (i, j), n in mix])
    off = F.struct(*[F.lit(0).alias(n) for _, n in mix])
    return F.when(col(tag).isin(*VEHICLE_TAGS), on).otherwise(off)


MAX_COLOURS = 65_536  # instance colours come from two id bytes


def remap_colours(pixels: DataFrame, colour: str, remap: DataFrame, order: str | None = None) -> DataFrame:
    """Replace colours by an optional table ``r, g, b -> r2, g2, b2`` whose entries apply one after the other.

    Entries follow each other by ``order``, or by colour: after 1 -> 2 and 2 -> 3 a pixel of 1 is 3. The table may
    have ``MAX_COLOURS`` entries; it is closed over itself, reduced to one row per colour and broadcast, which also
    keeps the many black pixels in place.
    """
    sides = ("r", "g", "b"), ("r2", "g2", "b2")
    rows = remap.orderBy(*([order] if order else []), *sides[0], *sides[1]).limit(MAX_COLOURS + 1).collect()
    if len(rows) > MAX_COLOURS:
        raise ValueError(f"more than {MAX_COLOURS} colours to replace")
    now: dict[tuple, set] = {}  # present colour -> the colours that have become it
    seen: set = set()
    for row in rows:
        old, new = (tuple(int(row[c]) for c in side) for side in sides)
        moved = now.pop(old, set()) | (set() if old in seen else {old})
        seen.add(old)
        now.setdefault(new, set()).update(moved)
    pairs = [(*k, *v) for v, ks in now.items() for k in ks if k != v]
    table = pixels.sparkSession.createDataFrame(pairs, "r int, g int, b int, r2 int, g2 int, b2 int")
    kinds = {f.name: f.dataType for f in pixels.schema[colour].dataType}
    side = lambda names: F.struct(*[F.col(n).cast(kinds[c]).alias(c) for n, c in zip(names, sides[0])])
    m = table.select(side(sides[0]).alias(colour), side(sides[1]).alias("_new"))
    out = pixels.join(F.broadcast(m), colour, "left")
    return out.select(*[c for c in pixels.columns if c != colour], F.coalesce("_new", colour).alias(colour))


def unique_instance_colours(pixels: DataFrame, frame: str, g: str, b: str, tag: str) -> DataFrame:
    only = pixels.where(F.col(tag).isin(*VEHICLE_TAGS))
    return only.select(frame, instance_colour(g, b, tag).alias("c")).select(frame, "c.*").distinct()


def confusion_matrix(pixels: DataFrame, keys, gt: str, pred: str, classes: int = 3) -> DataFrame:
    """Dense counts ``gt, pred, n`` per key in one partial aggregation."""
    valid = pixels.where(F.col(gt).between(0, classes - 1))
    cells = [(i, j) for i in range(classes) for j in range(classes)]
    wide = valid.groupBy(*keys).agg(*[F.count_if((F.col(gt) == i) & (F.col(pred) == j)).alias(f"c{i}_{j}") for i, j in cells])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("gt"), F.lit(j).alias("pred"), F.col(f"c{i}_{j}").alias("n")) for i, j in cells])))


def iou(confusion: DataFrame, keys, classes: int = 3) -> DataFrame:
    """Overlap per class and its mean over the classes present in the ground truth."""
    n = F.col("n")
    sums = confusion.groupBy(*keys).agg(*[
        a for c in range(classes) for a in (
            F.sum(F.when((F.col("gt") == c) & (F.col("pred") == c), n).otherwise(0)).alias(f"_d{c}"),
            F.sum(F.when(F.col("gt") == c, n).otherwise(0)).alias(f"_g{c}"),
            F.sum(F.when(F.col("pred") == c, n).otherwise(0)).alias(f"_p{c}"))])
    score = [F.col(f"_d{c}") / F.greatest(F.col(f"_g{c}") + F.col(f"_p{c}") - F.col(f"_d{c}"), F.lit(1)) for c in range(classes)]
    present = [F.when(F.col(f"_g{c}") > 0, score[c]) for c in range(classes)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in present), F.lit(0.0))
    count = sum((F.col(f"_g{c}") > 0).cast("int") for c in range(classes))
    names = CLASS_NAMES if classes == 3 else [str(c) for c in range(classes)]
    return sums.select(*keys, *[s.alias(f"iou_{m}") for s, m in zip(score, names)],
                       F.when(count > 0, total / count).alias("mean_iou"))


def iou_summary(frames: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population std and count per score, ignoring missing values."""
    stacked = frames.select(F.inline(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in cols])))
    return stacked.groupBy("score").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("n"))


# --- whole-image work: a row per frame, Arrow batches --------------------------------------------
def decode_labels(rgb: np.ndarray, size: tuple[int, int] | None, tolerance: int = 15) -> np.ndarray:
    """Class map of an H x W x 3 image, optionally resized (nearest pixel centre) to (W, H) first."""
    if size and (rgb.shape[1], rgb.shape[0]) != size:
        w, h = size
        yy = ((np.arange(h) + 0.5) * rgb.shape[0] / h).astype(int)
        xx = ((np.arange(w) + 0.5) * rgb.shape[1] / w).astype(int)
        rgb = rgb[yy][:, xx]
    out = np.zeros(rgb.shape[:2], dtype=np.int8)
    px = rgb.astype(np.int16)
    for colour, cls in PALETTE.items():
        out[(np.abs(px - np.array(colour, dtype=np.int16)) <= tolerance).all(axis=-1)] = cls
    return out


def label_images(images: DataFrame, size: tuple[int, int] | None = (512, 512), order: str = "bgr") -> DataFrame:
    """``frame, height, width, data`` (interleaved bytes) to ``frame, h, w, cls`` class arrays."""

    def run(batches):
        for pdf in batches:
            rows = []
            for f, h, w, data in pdf.itertuples(index=False):
                img = np.frombuffer(data, dtype=np.uint8).reshape(h, w, -1)[:, :, :3]
                cls = decode_labels(img[:, :, ::-1] if order == "bgr" else img, size)
                rows.append((f, cls.shape[0], cls.shape[1], cls.ravel()))
            yield pd.DataFrame(rows, columns=["frame", "h", "w", "cls"])

    kind = dict(images.dtypes)["frame"]
    return images.select("frame", "height", "width", "data").mapInPandas(run, f"frame {kind}, h int, w int, cls array<tinyint>")


def pixel_rows(maps: DataFrame, value: str = "cls") -> DataFrame:
    """Class arrays as one row per pixel ``frame, y, x, cls``."""
    return maps.select("frame", "w", F.posexplode(value).alias("_i", value)).select(
        "frame", F.expr("_i div w").alias("y"), (F.col("_i") % F.col("w")).alias("x"), value)


def small_components(mask: np.ndarray, min_area: int) -> np.ndarray:
    """Pixels of 8-connected components with fewer than ``min_area`` pixels.

    Horizontal runs are the nodes; runs of neighbouring rows that touch (also diagonally) are joined.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1]  # exclusive ends, in the same row-major order
    n = len(ys)
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        a_end, b_end = first[y], first[y + 1]
        while a < a_end and b < b_end:
            if x0[a] <= x1[b] and x0[b] <= x1[a]:
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
            if x1[a] <= x1[b]:
                a += 1
            else:
                b += 1
    roots = np.array([root(a) for a in range(n)], dtype=np.int64)
    area = np.bincount(roots, weights=(x1 - x0), minlength=max(n, 1))
    out = np.zeros_like(mask, dtype=bool)
    for k in np.nonzero(area[roots] < min_area)[0] if n else ():
        out[ys[k], x0[k]:x1[k]] = True
    return out


def despeckle(
    frames: DataFrame, classes: Sequence[int] = (1, 2), min_area: int = 250, hood: int = 42, road: int = 2,
    instance: bool = False,
) -> DataFrame:
    """Clean class maps ``frame, h, w, cls`` (and ``inst`` arrays) frame by frame.

    Small components of each class become background, the instance map is cleared there, and the
    bottom rows (``hood``, ten more for the instance map) are forced to road / nothing.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                cls = np.array(r.cls, dtype=np.int8).reshape(r.h, r.w)
                clean = cls.copy()
                for c in classes:
                    clean[small_components(cls == c, min_area)] = 0
                inst = np.array(r.inst).reshape(r.h, r.w) if instance else None
                if instance:
                    inst[clean == 0] = 0
                if hood > 0:
                    clean[-hood:] = road
                    if instance:
                        inst[-(hood + 10):] = 0
                rows.append((r.frame, r.h, r.w, clean.ravel(), *([inst.ravel()] if instance else [])))
            yield pd.DataFrame(rows, columns=["frame", "h", "w", "cls", *(["inst"] if instance else [])])

    kind = dict(frames.dtypes)["frame"]
    schema = f"frame {kind}, h int, w int, cls array<tinyint>" + (", inst array<int>" if instance else "")
    use = ["frame", "h", "w", "cls", *(["inst"] if instance else [])]
    return frames.select(*use).mapInPandas(run, schema)


def batch_predict(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Apply a model to Arrow batches; ``make_model`` runs once per partition, not per row."""

    def run(batches):
        model = make_model()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)
