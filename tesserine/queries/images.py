"""Image features on images made by arithmetic, so that SQL can make them too: every mode, in colour and in grey."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as I
from ..plans import scan
from .base import SEED, key_sql, r6, table

SIDE = 12


def pixels(ids: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(images, side, side, 3) bytes: a gradient under noise; every seventh image has three equal channels."""
    n, y, x, c = ids[:, None, None, None], np.arange(side)[:, None, None], np.arange(side)[None, :, None], np.arange(3)
    c = np.where(n % 7 == 0, 0, c)
    noise = (n * 40503 + y * 8191 + x * 131 + c * 977) * 2654435761 % 4294967296 // 16777216
    return ((noise // 2 + x * 11 + y * 9 * (n % 3)) % 256).astype(np.uint8)


def made_images(spark: SparkSession, d: str) -> DataFrame:
    """(id, image) of every supplier, in the form of Spark's image source."""
    schema = "id bigint, image struct<height: int, width: int, nChannels: int, data: binary>"
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            made = [{"height": SIDE, "width": SIDE, "nChannels": 3, "data": p[:, :, ::-1].tobytes()} for p in pixels(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["id", "image"])

    return supplier_ids(spark, d).mapInArrow(run, schema)


def supplier_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"))


def unpivoted(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.posexplode("v").alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), r6("x").alias("value"))


def in_color(mode: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return unpivoted(I.vectorize(made_images(spark, d), {"v": I.VectorConfig(SIDE, SIDE, mode)}, ("id",)))

    return query


def in_gray(mode: str):
    config = I.VectorConfig(SIDE, SIDE, mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pixels(batch.column(0).to_numpy())[..., 0] / 255.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([I.gray_vector(g, config).tolist() for g in made], pa.list_(pa.float64()))], names=["id", "v"])

    def query(spark: SparkSession, d: str) -> DataFrame:
        return unpivoted(supplier_ids(spark, d).mapInArrow(run, "id bigint, v array<double>"))

    return query


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of cut images: every image is cut to a width and a height of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [I.image_stats(p[: 3 + n % 10, : 2 + n % 11]) for n, p in zip(ids, pixels(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(f[c]) for f in found]) for c in STATS)], names=["id", *STATS])

    rows = supplier_ids(spark, d).mapInArrow(run, "id bigint, " + ", ".join(f"{c} double" for c in STATS))
    return rows.select("id", *(r6(c).alias(c) for c in STATS))


def cropped(kind: str):
    """Centre crops, or letterboxes of what needs no resizing, pixel by pixel."""
    crop = I.center_crop if kind == "center" else lambda p: I.letterbox(p, SIDE, SIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            made = [crop(p[: 3 + n % 10, : 2 + n % 11]).astype(int) for n, p in zip(ids, pixels(ids))]
            rows = [(n, y, x, *m[y, x].tolist()) for n, m in zip(ids.tolist(), made) for y in range(m.shape[0]) for x in range(m.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=list("nyxrgb"))

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = supplier_ids(spark, d).mapInArrow(run, ", ".join(f"{c} bigint" for c in "nyxrgb"))
        return rows.withColumnRenamed("n", "id")

    return query


def resized(width: int, height: int):
    """Triangle-filter resizes, pixel by pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = [(n, y, x, *m[y, x].tolist()) for n, p in zip(ids.tolist(), pixels(ids)) for m in [I.resize(p, width, height)] for y in range(height) for x in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=list("nyxrgb"))

    def query(spark: SparkSession, d: str) -> DataFrame:
        return supplier_ids(spark, d).mapInArrow(run, ", ".join(f"{c} bigint" for c in "nyxrgb")).withColumnRenamed("n", "id")

    return query


def border(spark: SparkSession, d: str) -> DataFrame:
    """Mean colours of the borders, and the distances from them that make a pixel foreground."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [I.border_background(p) for p in pixels(batch.column(0).to_numpy())]
            columns = [pa.array([float(b[i]) for b, _ in found], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([t for _, t in found], pa.float64())], names=["id", "r", "g", "b", "threshold"])

    rows = supplier_ids(spark, d).mapInArrow(run, "id bigint, r double, g double, b double, threshold double")
    return rows.select("id", *(r6(c).alias(c) for c in ("r", "g", "b", "threshold")))


def patches(spark: SparkSession, d: str) -> DataFrame:
    """The grey values of all patches of 8 pixels, 3 apart."""
    found = I.vectorize_patches(made_images(spark, d), I.VectorConfig(8, 8, "pixels"), 8, 3, ("id",))
    return found.select("id", "x", "y", "w", "h", F.posexplode("vector").alias("i", "v")).select("id", "x", "y", "w", "h", F.col("i").cast("long").alias("i"), r6("v").alias("value"))


def mask_images(spark: SparkSession, d: str) -> DataFrame:
    """(mask_path, mask): a pixel is set where x + y * id is divisible by 3."""
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
            made = [{"height": SIDE, "width": SIDE, "nChannels": 1, "data": (((x + y * n) % 3 == 0) * 255).astype(np.uint8).tobytes()} for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in batch.column(0).to_pylist()]), pa.array(made, kind)], names=["mask_path", "mask"])

    return supplier_ids(spark, d).mapInArrow(run, "mask_path string, mask struct<height: int, width: int, nChannels: int, data: binary>")


def masked_patches(spark: SparkSession, d: str) -> DataFrame:
    """Masks against the patches over a threshold; every ninth image has no mask."""
    at = supplier_ids(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("k", F.col("k").cast("long"))
    place = {"x": (F.col("id") * 5 + F.col("k") * 7) % 11, "y": (F.col("id") * 3 + F.col("k") * 4) % 10, "w": F.lit(5).cast("long"), "h": F.lit(4).cast("long")}
    score = ((F.col("id") * 13 + F.col("k") * 29) % 100) / 100.0
    rows = at.where("id % 9 <> 0").select(F.col("id").alias("image_id"), F.col("id").cast("string").alias("mask_path"), (F.col("id") * 10 + F.col("k")).alias("patch_id"), *(v.alias(c) for c, v in place.items()), score.alias("anomaly_score"))
    told = scan.against_masks(rows, mask_images(spark, d), 0.6)
    return told.select("image_id", r6("iou").alias("iou"), F.explode("overlaps").alias("o")).select("image_id", "iou", "o.patch_id", r6("o.ratio").alias("ratio"))


def evaluation_split(spark: SparkSession, d: str) -> DataFrame:
    """Images dealt out to validation and holdout, normal and anomalous ones by seeds of their own."""
    rows = supplier_ids(spark, d).select(F.col("id").alias("image_id"), F.lit("eval").alias("split"), (F.col("id") % 3 == 0).alias("expected"))
    validation, holdout = scan.split_evaluation(scan.Category("made", rows, rows), 0.3, SEED)
    return validation.withColumn("part", F.lit("validation")).union(holdout.withColumn("part", F.lit("holdout")))


STATS = ("width", "height", "aspect", "brightness", "contrast", "crop_loss")

# --- SQL --------------------------------------------------------------------------------------------

RAW_SQL = f"""raw AS (
  SELECT s_suppkey::BIGINT AS id, y, x, c,
    (((s_suppkey::BIGINT * 40503 + y * 8191 + x * 131 + CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE c END * 977) * 2654435761) % 4294967296 // 16777216 // 2 + x * 11 + y * 9 * (s_suppkey % 3)) % 256 AS v
  FROM supplier, range({SIDE}) a(y), range({SIDE}) b(x), range(3) e(c)
)"""
N = SIDE * SIDE
EPS = "2.220446049250313e-16::DOUBLE"


def pixels_sql(gray: bool) -> str:
    """p: one row a pixel, with its grey value, channels and hue; ch: one row for each of its six channels (RGB, then HSV)."""
    wide = "SELECT id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM raw GROUP BY ALL"
    if gray:
        one = "SELECT id, y, x, r / 255::DOUBLE AS gray, gray AS rf, gray AS gf, gray AS bf, gray AS h, gray AS s, gray AS top, 0 AS r, 0 AS g, 0 AS b FROM w"
    else:
        one = f"""SELECT *, CASE WHEN delta <= {EPS} THEN 0 WHEN abs(top - rf) <= {EPS} THEN ((gf - bf) / delta + CASE WHEN gf < bf THEN 6 ELSE 0 END) / 6
            WHEN abs(top - gf) <= {EPS} THEN ((bf - rf) / delta + 2) / 6 ELSE ((rf - gf) / delta + 4) / 6 END AS h,
          CASE WHEN top > {EPS} THEN delta / top ELSE 0 END AS s
        FROM (SELECT *, greatest(rf, gf, bf) AS top, greatest(rf, gf, bf) - least(rf, gf, bf) AS delta FROM (
          SELECT *, (2126 * r + 7152 * g + 722 * b) // 10000 / 255::DOUBLE AS gray, r / 255::DOUBLE AS rf, g / 255::DOUBLE AS gf, b / 255::DOUBLE AS bf FROM w))"""
    return f"""{RAW_SQL}, w AS ({wide}), p AS (SELECT *, y * 4 // {SIDE} * 4 + x * 4 // {SIDE} AS cell FROM ({one})),
ch AS (SELECT id, cell, unnest(range(6)) AS k, unnest([rf, gf, bf, h, s, top]) AS f, unnest([r, g, b, 0, 0, 0]) AS v FROM p),
gr AS (
  SELECT a.id, a.cell, a.y, a.x, e.gray - w.gray AS gx, s.gray - n.gray AS gy FROM p a JOIN p e ON e.id = a.id AND e.y = a.y AND e.x = a.x + 1 JOIN p w ON w.id = a.id AND w.y = a.y AND w.x = a.x - 1
  JOIN p s ON s.id = a.id AND s.x = a.x AND s.y = a.y + 1 JOIN p n ON n.id = a.id AND n.x = a.x AND n.y = a.y - 1
), ho AS (
  SELECT id, cell, least(floor(CASE WHEN t >= pi() THEN t - pi() ELSE t END / pi() * 8), 7)::BIGINT AS bin, sum(size) AS m FROM (
    SELECT *, sqrt(gx * gx + gy * gy) AS size, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END AS t FROM gr) WHERE size > {EPS} GROUP BY ALL
), hc AS (
  SELECT i.id, cell, bin, coalesce(m, 0) AS m FROM (SELECT id, cell, bin FROM (SELECT DISTINCT id FROM p), range(16) a(cell), range(8) b(bin)) i LEFT JOIN ho USING (id, cell, bin)
), lw AS (SELECT *, abs(gray - avg(gray) OVER (PARTITION BY id)) AS q FROM p
), lt AS (SELECT *, greatest(sum(q) OVER (PARTITION BY id), {EPS}) AS total, x / {SIDE - 1}::DOUBLE AS px, y / {SIDE - 1}::DOUBLE AS py FROM lw
), lc AS (SELECT *, sum(q * px) OVER (PARTITION BY id) / total AS cx, sum(q * py) OVER (PARTITION BY id) / total AS cy FROM lt)"""


def _lbp_sql(radius: int) -> str:
    ring = "(VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, 1), (4, 1, 1), (5, 1, 0), (6, 1, -1), (7, 0, -1)) r(k, dy, dx)"
    return f"""SELECT id, cell * 16 + code * 16 // 256 AS i, count(*) / any_value(n)::DOUBLE AS value FROM (
      SELECT *, count(*) OVER (PARTITION BY id, cell) AS n FROM (
        SELECT a.id, a.y, a.x, a.cell, sum(CASE WHEN b.gray >= a.gray THEN 1 << k ELSE 0 END)::BIGINT AS code
        FROM p a, {ring}, p b WHERE b.id = a.id AND b.y = a.y + dy * {radius} AND b.x = a.x + dx * {radius}
          AND a.y BETWEEN {radius} AND {SIDE - 1 - radius} AND a.x BETWEEN {radius} AND {SIDE - 1 - radius} GROUP BY ALL)) GROUP BY 1, 2"""


def _mean_std_sql(rows: str, group: str) -> str:
    return f"""SELECT id, {group} * 2 + unnest([0, 1]) AS i, unnest([avg(f), sqrt(greatest(avg(f * f) - avg(f) * avg(f), 0))]) AS value FROM {rows} GROUP BY id, {group}"""


def _layout_sql() -> str:
    half, quarter = SIDE // 2, SIDE // 4
    share = lambda where: f"coalesce(sum(q) FILTER ({where}), 0) / any_value(total)"
    centre = share(f"y >= {quarter} AND y < {SIDE - quarter} AND x >= {quarter} AND x < {SIDE - quarter}")
    left, right, upper, lower = (share(w) for w in (f"x < {half}", f"x >= {half}", f"y < {half}", f"y >= {half}"))
    corners = [share(f"{a} AND {b}") for a in (f"y < {half}", f"y >= {half}") for b in (f"x < {half}", f"x >= {half}")]
    mirror = lambda other, where: f"(SELECT avg(abs(a.gray - b.gray)) FROM p a JOIN p b ON a.id = b.id AND {other} WHERE a.id = lc.id AND {where})"
    last = SIDE - 1
    values = [
        mirror(f"b.y = a.y AND b.x = {last} - a.x", f"a.x < {half}"),
        mirror(f"b.x = a.x AND b.y = {last} - a.y", f"a.y < {half}"),
        mirror("b.y = a.x AND b.x = a.y", "a.y > a.x"),
        mirror(f"b.y = {last} - a.x AND b.x = {last} - a.y", f"{last} - a.x < a.y"),
        "any_value(cx)",
        "any_value(cy)",
        "sqrt(sum(q * (px - cx) ** 2) / any_value(total))",
        "sqrt(sum(q * (py - cy) ** 2) / any_value(total))",
        centre,
        f"1 - {centre}",
        f"abs({left} - {right})",
        f"abs({upper} - {lower})",
        *corners,
    ]
    return f"SELECT id, unnest(range(16)) AS i, unnest([{', '.join(f'least(greatest({v}, 0), 1)' for v in values)}]) AS value FROM lc GROUP BY id"


def part_sql(part: str, gray: bool) -> str:
    """(id, i, value) of a part; entries that are 0 may be missing."""
    if part == "pixels":
        return f"SELECT id, y * {SIDE} + x AS i, gray AS value FROM p"
    if part == "color":
        bin_ = "least(floor(f * 8), 7)::BIGINT" if gray else "least(v * 8 // 256, 7)"
        return f"SELECT id, k * 8 + {bin_} AS i, count(*) / {N}::DOUBLE AS value FROM ch WHERE k < 3 GROUP BY 1, 2"
    hsv_bin = "(k - 3) * 8 + least(floor(least(greatest(f, 0), 1) * 8), 7)::BIGINT"
    if part == "hsv":
        return f"SELECT id, {hsv_bin} AS i, count(*) / {N}::DOUBLE AS value FROM ch WHERE k >= 3 GROUP BY 1, 2"
    if part == "spatial":
        return f"SELECT id, cell * 24 + {hsv_bin} AS i, count(*) / {N // 16}::DOUBLE AS value FROM ch WHERE k >= 3 GROUP BY 1, 2"
    if part == "moments":
        return _mean_std_sql("ch", "k")
    if part == "intensity":
        return _mean_std_sql("(SELECT id, cell, gray AS f FROM p)", "cell")
    if part == "chromaticity":
        share = "1 / 3::DOUBLE" if gray else f"f / greatest(sum(f) OVER (PARTITION BY id, y, x), {EPS})"
        return _mean_std_sql(f"(SELECT id, k, {share} AS f FROM (SELECT id, y, x, unnest(range(3)) AS k, unnest([rf, gf, bf]) AS f FROM p))", "k")
    if part in ("lbp1", "lbp2"):
        return _lbp_sql(int(part[-1]))
    if part == "hog":
        return f"SELECT id, cell * 8 + bin AS i, CASE WHEN t > {EPS} THEN m / t ELSE m END AS value FROM (SELECT *, sum(m) OVER (PARTITION BY id, cell) AS t FROM hc)"
    if part == "blocks":
        return f"""SELECT id, block * 32 + j * 8 + bin AS i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY id, block)), {EPS}) AS value FROM (
          SELECT hc.id, oy * 3 + ox AS block, jy * 2 + jx AS j, bin, m FROM hc, range(3) a(oy), range(3) b(ox), range(2) e(jy), range(2) f(jx) WHERE cell = (oy + jy) * 4 + ox + jx)"""
    if part == "edge":
        return "SELECT id, cell * 3 + unnest([0, 1, 2]) AS i, least(unnest([avg(sqrt(gx * gx + gy * gy)), avg(abs(gx)), avg(abs(gy))]), 1) AS value FROM gr GROUP BY id, cell"
    return _layout_sql()


def mode_sql(mode: str, gray: bool) -> str:
    parts, at, union = ["pixels"] if mode == "pixels" else I.PARTS[mode], 0, []
    for part in parts:
        union.append(f"SELECT id, i + {at} AS i, value FROM ({part_sql(part, gray)})")
        at += N if part == "pixels" else I.SIZES[part]
    return f"""WITH {pixels_sql(gray)}, found AS ({" UNION ALL ".join(union)})
SELECT a.id, a.i, round(coalesce(value, 0), 6) + 0 AS value FROM (SELECT s_suppkey::BIGINT AS id, i FROM supplier, range({at}) t(i)) a LEFT JOIN found USING (id, i)"""


CUT_SQL = f"{RAW_SQL}, cut AS (SELECT *, (2 + id % 11) AS w, (3 + id % 10) AS h FROM raw WHERE y < 3 + id % 10 AND x < 2 + id % 11)"
STATS_SQL = f"""WITH {CUT_SQL}, g AS (
  SELECT id, any_value(w)::DOUBLE AS w, any_value(h)::DOUBLE AS h, (2126 * max(v) FILTER (c = 0) + 7152 * max(v) FILTER (c = 1) + 722 * max(v) FILTER (c = 2)) // 10000 / 255::DOUBLE AS gray FROM cut GROUP BY id, y, x)
SELECT id, any_value(w) AS width, any_value(h) AS height, round(any_value(w / h), 6) AS aspect, round(avg(gray), 6) AS brightness, round(stddev_pop(gray), 6) AS contrast,
  round(1 - least(any_value(w), any_value(h)) ** 2 / any_value(w * h), 6) + 0 AS crop_loss FROM g GROUP BY id"""
CENTER_SQL = f"""WITH {CUT_SQL}, s AS (SELECT *, least(w, h) AS side, (h - least(w, h)) // 2 AS top, (w - least(w, h)) // 2 AS lead FROM cut)
SELECT id, y - top AS y, x - lead AS x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM s
WHERE y >= top AND y < top + side AND x >= lead AND x < lead + side GROUP BY ALL"""
LETTERBOX_SQL = f"""WITH {CUT_SQL}, b AS (SELECT id, y + ({SIDE} - h) // 2 AS y, x + ({SIDE} - w) // 2 AS x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM cut GROUP BY ALL)
SELECT a.id, a.y, a.x, coalesce(r, 127) AS r, coalesce(g, 127) AS g, coalesce(b, 127) AS b FROM (SELECT s_suppkey::BIGINT AS id, y, x FROM supplier, range({SIDE}) t(y), range({SIDE}) u(x)) a LEFT JOIN b USING (id, y, x)"""



def _weights_sql(n: int, m: int) -> str:
    """(o, i, k): what sample i of n counts in the triangle filter's output o of m."""
    support, ratio = max(n / m, 1.0), n / m
    raw = f"greatest(0, 1 - abs((i + 0.5::DOUBLE - (o + 0.5::DOUBLE) * {ratio!r}::DOUBLE) / {support!r}::DOUBLE))"
    return f"SELECT o, i, k / sum(k) OVER (PARTITION BY o) AS k FROM (SELECT o, i, {raw} AS k FROM range({m}) a(o), range({n}) b(i)) WHERE k > 0"


def resize_sql(width: int, height: int) -> str:
    return f"""WITH {RAW_SQL}, wy AS ({_weights_sql(SIDE, height)}), wx AS ({_weights_sql(SIDE, width)}),
rows_ AS (SELECT id, c, wy.o AS y, x, sum(k * v) AS v FROM raw JOIN wy ON wy.i = raw.y GROUP BY ALL),
both_ AS (SELECT id, c, y, wx.o AS x, least(greatest(floor(sum(k * v) + 0.5::DOUBLE + 1e-9::DOUBLE), 0), 255)::BIGINT AS v FROM rows_ JOIN wx ON wx.i = rows_.x GROUP BY ALL)
SELECT id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM both_ GROUP BY ALL"""


BORDER_SQL = f"""WITH {RAW_SQL}, e AS (SELECT id, y, x, max(v) FILTER (c = 0) / 255::DOUBLE AS r, max(v) FILTER (c = 1) / 255::DOUBLE AS g, max(v) FILTER (c = 2) / 255::DOUBLE AS b FROM raw
  WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}) GROUP BY ALL), m AS (SELECT *, avg(r) OVER o AS mr, avg(g) OVER o AS mg, avg(b) OVER o AS mb FROM e WINDOW o AS (PARTITION BY id)),
q AS (SELECT *, least(sqrt(((r - mr) ** 2 + (g - mg) ** 2 + (b - mb) ** 2) / 3), 1) AS q FROM m)
SELECT id, round(any_value(mr), 6) AS r, round(any_value(mg), 6) AS g, round(any_value(mb), 6) AS b, round(least(greatest(avg(q) + 2 * stddev_pop(q), 0.08), 0.35), 6) AS threshold FROM q GROUP BY id"""
PATCHES_SQL = f"""WITH {RAW_SQL}, p AS (SELECT id, y, x, (2126 * max(v) FILTER (c = 0) + 7152 * max(v) FILTER (c = 1) + 722 * max(v) FILTER (c = 2)) // 10000 / 255::DOUBLE AS v FROM raw GROUP BY ALL),
s AS (SELECT unnest([0, 3, 4]) AS a)
SELECT id, u.a AS x, t.a AS y, 8 AS w, 8 AS h, (p.y - t.a) * 8 + p.x - u.a AS i, round(v, 6) + 0 AS value FROM p, s t, s u WHERE p.y >= t.a AND p.y < t.a + 8 AND p.x >= u.a AND p.x < u.a + 8"""
MASKED_SQL = f"""WITH b AS (SELECT s_suppkey::BIGINT AS id, k, s_suppkey * 10 + k AS patch_id, (s_suppkey * 5 + k * 7) % 11 AS px, (s_suppkey * 3 + k * 4) % 10 AS py, ((s_suppkey * 13 + k * 29) % 100) / 100::DOUBLE AS s FROM supplier, range(6) t(k) WHERE s_suppkey % 9 <> 0),
g AS (SELECT s_suppkey::BIGINT AS id, y, x, (x + y * s_suppkey) % 3 = 0 AS truth FROM supplier, range({SIDE}) t(y), range({SIDE}) u(x) WHERE s_suppkey % 9 <> 0),
j AS (SELECT g.*, patch_id, s FROM g JOIN b ON b.id = g.id AND x >= px AND x < px + 5 AND y >= py AND y < py + 4),
c AS (SELECT g.id, g.y, g.x, any_value(truth) AS truth, coalesce(bool_or(s >= 0.6), false) AS told FROM g LEFT JOIN (SELECT id, y, x, s FROM j) k USING (id, y, x) GROUP BY ALL),
i AS (SELECT id, coalesce(count_if(truth AND told) / nullif(count_if(truth OR told), 0), 0) AS iou FROM c GROUP BY id)
SELECT id AS image_id, round(iou, 6) + 0 AS iou, patch_id, round(avg(truth::INT), 6) + 0 AS ratio FROM j JOIN i USING (id) GROUP BY id, iou, patch_id"""
_PART = "SELECT id, row_number() OVER (ORDER BY {key}, id) - 1 < round(count(*) OVER () * 0.3::DOUBLE) AS test FROM s WHERE {which}"
EVALUATION_SQL = f"""WITH s AS (SELECT s_suppkey::BIGINT AS id FROM supplier), p AS (
  {_PART.format(key=key_sql("id", SEED + 1), which="id % 3 <> 0")} UNION ALL {_PART.format(key=key_sql("id", SEED + 2), which="id % 3 = 0")})
SELECT id AS image_id, CASE WHEN test THEN 'validation' ELSE 'holdout' END AS part FROM p"""

MODES = [*I.FEATURE_MODES]
QUERIES = {f"img_{m.replace('-', '_')}_{kind}": make(m) for m in MODES for kind, make in (("color", in_color), ("gray", in_gray))}
QUERIES |= {"img_stats": geometry, "img_center_crop": cropped("center"), "img_letterbox": cropped("letterbox")}
SQL = {f"img_{m.replace('-', '_')}_{kind}": mode_sql(m, kind == "gray") for m in MODES for kind in ("color", "gray")}
SQL |= {"img_stats": STATS_SQL, "img_center_crop": CENTER_SQL, "img_letterbox": LETTERBOX_SQL}
QUERIES |= {"img_resize_down": resized(5, 7), "img_resize_up": resized(17, 13), "img_border": border, "img_patches": patches, "scan_against_masks": masked_patches, "scan_evaluation_split": evaluation_split}
SQL |= {"img_resize_down": resize_sql(5, 7), "img_resize_up": resize_sql(17, 13), "img_border": BORDER_SQL, "img_patches": PATCHES_SQL, "scan_against_masks": MASKED_SQL, "scan_evaluation_split": EVALUATION_SQL}
