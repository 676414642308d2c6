"""Views over the given tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table; ``spark_view`` puts DataFrames there, ``duck`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

POLYLINES = """SELECT o_custkey AS drawing_id, l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq,
 CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

SESSIONS = """SELECT user_id AS session_id, seq, cmd, CASE WHEN cmd = 'MOVE' THEN value END AS x, CASE WHEN cmd = 'MOVE' THEN k END AS y, CASE WHEN cmd = 'MOVE' THEN CAST(35.0 AS DOUBLE) END AS speed FROM (
 SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, CAST(value AS DOUBLE) AS value, CAST({k} AS DOUBLE) AS k,
 CASE event_type WHEN 'purchase' THEN 'PEN_DOWN' WHEN 'signup' THEN 'PEN_UP' WHEN 'error' THEN 'PING' ELSE 'MOVE' END AS cmd FROM {events}) s"""

#: Sessions in which events of one time come in the order of their ids.
TRACKED = SESSIONS.replace("ORDER BY ts)", "ORDER BY ts, event_id)")

GRID = """SELECT vec_id AS image_id, label, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, v AS value, v > 0 AS is_on, CAST(floor((v + 0.6) * 210) AS INT) AS gray FROM {exploded} e"""

RUNS = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS image, CASE l_returnflag WHEN 'A' THEN 'classical' ELSE 'ml' END AS vision_mode, CASE l_linestatus WHEN 'F' THEN 'nearest_neighbor' ELSE 'two_opt' END AS path_ordering,
 count(*) AS num_commands, count(DISTINCT l_orderkey) AS num_paths, round(sum(CAST(l_quantity AS DOUBLE)), 2) AS pen_up_distance_mm, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS draw_distance_mm,
 CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE round(avg(CAST(l_discount AS DOUBLE)) * 10, 4) END AS mask_dice, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE round(avg(CAST(l_tax AS DOUBLE)) * 10, 4) END AS mask_iou,
 CASE WHEN l_returnflag = 'R' AND avg(CAST(l_quantity AS DOUBLE)) < 26 THEN 'classical' WHEN l_returnflag = 'A' THEN 'classical' ELSE 'ml' END AS effective_vision_mode,
 CASE WHEN l_returnflag = 'R' AND avg(CAST(l_quantity AS DOUBLE)) < 25 THEN CASE WHEN count(*) % 2 = 0 THEN 'blob' ELSE 'artwork' END WHEN l_returnflag = 'R' AND avg(CAST(l_quantity AS DOUBLE)) < 26 THEN ' ' END AS fallback_reason
 FROM {lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey, l_returnflag, l_linestatus"""

OBSERVATIONS = "SELECT l_suppkey AS device, CAST(l_quantity AS DOUBLE) AS commanded, CAST(l_extendedprice AS DOUBLE) / 1000 AS measured FROM {lineitem}"

HISTORIES = """SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS epoch, CAST(value AS DOUBLE) AS train_loss, CAST(value AS DOUBLE) AS val_loss FROM {events}"""

IMAGES = "SELECT CAST(doc_id AS VARCHAR(20)) AS stem, concat('images/', CAST(doc_id AS VARCHAR(20)), '.png') AS path, source FROM {documents}"
MASKS = """SELECT CAST(doc_id AS VARCHAR(20)) AS stem, concat('masks/', CAST(doc_id AS VARCHAR(20)), '.png') AS path FROM {labels}
 UNION ALL SELECT concat('orphan', CAST(region AS VARCHAR(20))), concat('masks/orphan', CAST(region AS VARCHAR(20)), '.png') FROM (SELECT r_regionkey AS region FROM {region}) o"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if "{k}" in sql:
        sql = sql.replace("{k}", "get_json_object(props, '$.k')")
    if "{exploded}" in sql:
        sql = sql.replace("{exploded}", "(SELECT vec_id, label, i, CAST(v AS DOUBLE) AS v FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS i, v)").replace("i // 8", "i div 8")
        used["embeddings"] = read(spark, sf_dir, "embeddings")
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same view for DuckDB, in brackets."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    sql = sql.replace("{k}", "json_extract_string(props, '$.k')")
    sql = sql.replace("{exploded}", "(SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))")
    return f"({sql})"


def paths(points: DataFrame) -> DataFrame:
    """(drawing_id, path_id, points): points in the order of seq."""
    from pyspark.sql import functions as F

    rows = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    return points.groupBy("drawing_id", "path_id").agg(F.transform(rows, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drawing_id, path_id, points): closed 32-gons from vectors."""
    from pyspark.sql import functions as F

    e = read(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", k).cast("double") * 100
    ring = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda k: F.struct(at((k % 32) * 2).alias("x"), at((k % 32) * 2 + 1).alias("y")))
    return e.select(F.col("label").cast("bigint").alias("drawing_id"), F.col("vec_id").alias("path_id"), ring.alias("points"))
