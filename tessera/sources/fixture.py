"""Scenes made of the driver's tables: an order is a scene, its lines are the objects.

The same rules in SQL (``OBJECTS``) let another engine check every query. A few scenes have objects that hold each
other up in a circle; all others rest on the floor or on an object with a smaller number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
WIDTH, HEIGHT, FOCAL, CAMERA_X, CAMERA_Y = 640, 480, 320.0, 4.0, -2.0
ROOM = (-1.0, -1.0, 9.0, 9.0)


def scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an object: identity, box, view of the camera, and the facts that the roster needs."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *ORDER)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # lines meet their parts before they are dealt by order, so that all that follows finds a scene's objects together;
    # a part's rows are lists, so that the join neither drops lines before they are counted nor repeats them
    of = {n: F.collect_list(F.struct(n)).alias(f"{n}s") for n in ("p_name", "p_type", "p_size")}
    part = part.groupBy("p_partkey").agg(*of.values())
    scene = Window.partitionBy("l_orderkey")
    d = line.join(part, line.l_partkey == part.p_partkey, "left")
    d = d.withColumn("seq", F.row_number().over(scene.orderBy(*ORDER)).cast("long")).withColumn("n", F.count("*").over(scene))
    d = d.filter("p_partkey IS NOT NULL").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("p_sizes") - 1)))
    d = d.withColumns({n: F.get(f"{n}s", "k")[n] for n in of})
    num = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    d = d.select(
        F.col("l_orderkey").alias("scene_id"), F.col("seq").alias("object_id"), F.col("n").alias("scene_size"), F.col("p_type").alias("category"), F.col("p_name").alias("name"),
        (num("(l_partkey * 37 + seq * 211) % 800") / 100).alias("x"), (num("(l_suppkey * 53 + seq * 149) % 800") / 100).alias("y"),
        (num("p_size % 10") / 20 + 0.2).alias("ex"), (num("p_size % 7") / 20 + 0.2).alias("ey"), (num("p_size % 5") / 10 + 0.3).alias("ez"),
        (1 - F.col("l_discount") * 8).alias("visible_fraction"), (F.col("l_returnflag") != "A").alias("movable"), (F.col("l_partkey") % 11 == 0).alias("pinned"),
        F.expr("CASE WHEN l_orderkey % 17 = 0 AND n >= 2 AND seq <= 2 THEN 3 - seq WHEN seq > 1 AND p_size % 4 = 0 THEN (l_partkey + seq) % (seq - 1) + 1 END").cast("long").alias("support_id"),
        F.col("l_tax").alias("clearance"), F.expr("CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END").alias("split"),
    )
    d = d.withColumn("z", F.col("ez") / 2).withColumn("depth", F.col("y") - CAMERA_Y).withColumn("cx", (F.col("x") - CAMERA_X) * FOCAL / F.col("depth") + WIDTH / 2)
    half_w, half_h = F.col("ex") * FOCAL / F.col("depth") / 2, F.lit(0.6 * FOCAL) / F.col("depth") / 2
    d = d.withColumns({"xmin": F.col("cx") - half_w, "xmax": F.col("cx") + half_w, "ymin": F.lit(HEIGHT / 2) - half_h, "ymax": F.lit(HEIGHT / 2) + half_h})
    clipped = F.greatest(F.lit(0.0), F.least("xmax", F.lit(float(WIDTH))) - F.greatest("xmin", F.lit(0.0))) * F.greatest(F.lit(0.0), F.least("ymax", F.lit(float(HEIGHT))) - F.greatest("ymin", F.lit(0.0)))
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return d.withColumns({"image_area_fraction": area / (WIDTH * HEIGHT), "truncated_fraction": 1 - clipped / area})


OBJECTS = f"""
raw AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
placed AS (
    SELECT l_orderkey AS scene_id, seq AS object_id, n AS scene_size, p_type AS category, p_name AS name,
        CAST((l_partkey * 37 + seq * 211) % 800 AS DOUBLE) / 100 AS x, CAST((l_suppkey * 53 + seq * 149) % 800 AS DOUBLE) / 100 AS y,
        CAST(p_size % 10 AS DOUBLE) / 20 + 0.2::DOUBLE AS ex, CAST(p_size % 7 AS DOUBLE) / 20 + 0.2::DOUBLE AS ey, CAST(p_size % 5 AS DOUBLE) / 10 + 0.3::DOUBLE AS ez,
        1 - l_discount * 8 AS visible_fraction, l_returnflag <> 'A' AS movable, l_partkey % 11 = 0 AS pinned,
        CAST(CASE WHEN l_orderkey % 17 = 0 AND n >= 2 AND seq <= 2 THEN 3 - seq WHEN seq > 1 AND p_size % 4 = 0 THEN (l_partkey + seq) % (seq - 1) + 1 END AS BIGINT) AS support_id,
        l_tax AS clearance, CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split
    FROM raw JOIN part ON l_partkey = p_partkey),
seen AS (SELECT *, ez / 2 AS z, y + 2::DOUBLE AS depth, (x - 4::DOUBLE) * 320::DOUBLE / (y + 2::DOUBLE) + 320::DOUBLE AS cx FROM placed),
boxed AS (SELECT *, cx - ex * 320::DOUBLE / depth / 2 AS xmin, cx + ex * 320::DOUBLE / depth / 2 AS xmax, 240::DOUBLE - 192::DOUBLE / depth / 2 AS ymin, 240::DOUBLE + 192::DOUBLE / depth / 2 AS ymax FROM seen),
objects AS (
    SELECT *, (xmax - xmin) * (ymax - ymin) / 307200 AS image_area_fraction,
        1 - greatest(0::DOUBLE, least(xmax, 640::DOUBLE) - greatest(xmin, 0::DOUBLE)) * greatest(0::DOUBLE, least(ymax, 480::DOUBLE) - greatest(ymin, 0::DOUBLE)) / ((xmax - xmin) * (ymax - ymin)) AS truncated_fraction
    FROM boxed)
"""
