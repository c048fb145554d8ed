"""Views that turn the driver tables into tiles, manifests, boxes and candidates.

Each view exists twice: as a DataFrame here and as SQL text for the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import tile_partition

SIDE = 32          # edge of a lineitem tile
SMALL = 8          # edge of an embedding tile


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index) -> "F.Column":
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


# --- manifest from documents and labels ---------------------------------------

LICENSES = ["public_domain", "cc_by_4.0", "commercial_ok", "verified_commercial", "unknown"]


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    q = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    rows = d.join(q, "doc_id", "left")
    ident = F.concat(F.lit("d"), k.cast("string"))
    return rows.select(
        "doc_id", ident.alias("id"),
        F.concat(F.lit("img/"), k.cast("string"), F.lit("_a.png")).alias("pre"),
        F.concat(F.lit("img/"), (k + F.when(k % 9 == 0, 1).otherwise(0)).cast("string"), F.when(k % 9 == 0, F.lit("_a.png")).otherwise(F.lit("_b.png"))).alias("post"),
        F.concat(F.lit("r"), F.floor(k / 4).cast("string")).alias("region_id"),
        F.col("lang").alias("state"),
        F.when(k % 11 == 0, "LEVIR-CD").when(k % 11 == 1, "hansen+naip").when(k % 11 == 2, "mock_demo")
        .when(k % 11 == 3, "").otherwise(F.col("source")).alias("source"),
        (F.lit(2010) + k % 7).cast("string").alias("year_pre"),
        (F.lit(2010) + k % 7 + k % 4).cast("string").alias("year_post"),
        _pick(LICENSES, (k % 5).cast("int")).alias("license_status"),
        F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "candidate")
        .when(k % 3 == 0, "weak_unreviewed").otherwise("verified").alias("label_status"),
        F.when(k % 13 == 0, "hansen").otherwise("manual").alias("label_source"),
        F.when(k % 6 == 0, "review_mask_only").otherwise("full").alias("training_scope"),
        F.when(k % 12 == 0, "").otherwise(F.concat(F.lit("masks/"), k.cast("string"), F.lit(".png"))).alias("review_mask"),
        F.when(k % 17 == 0, "unverified").otherwise("").alias("audit_status"),
        F.sha2("text", 256).alias("content_hash"),
        F.when(k % 2 == 0, F.concat(F.lit("mask/"), k.cast("string"))).otherwise("absent").alias("new_building"),
        F.when(k % 3 == 0, F.concat(F.lit("mask/t"), k.cast("string"))).otherwise("").alias("tree_removal"),
        F.when(k % 8 == 0, F.concat(F.lit("raster"), F.floor(k / 40).cast("string"))).otherwise("").alias("source_raster"),
        F.col("n_chars").alias("n_chars"),
        F.col("toxic").alias("toxic"),
    )


MANIFEST_SQL = """
manifest AS (
 SELECT d.doc_id, 'd'||d.doc_id AS id,
  'img/'||d.doc_id||'_a.png' AS pre,
  CASE WHEN d.doc_id%9=0 THEN 'img/'||(d.doc_id+1)||'_a.png' ELSE 'img/'||d.doc_id||'_b.png' END AS post,
  'r'||(d.doc_id//4) AS region_id, d.lang AS state,
  CASE d.doc_id%11 WHEN 0 THEN 'LEVIR-CD' WHEN 1 THEN 'hansen+naip' WHEN 2 THEN 'mock_demo' WHEN 3 THEN '' ELSE d.source END AS source,
  CAST(2010+d.doc_id%7 AS VARCHAR) AS year_pre, CAST(2010+d.doc_id%7+d.doc_id%4 AS VARCHAR) AS year_post,
  CASE d.doc_id%5 WHEN 0 THEN 'public_domain' WHEN 1 THEN 'cc_by_4.0' WHEN 2 THEN 'commercial_ok' WHEN 3 THEN 'verified_commercial' ELSE 'unknown' END AS license_status,
  CASE WHEN l.quality=1 THEN 'reviewed' WHEN l.quality=0 THEN 'candidate' WHEN d.doc_id%3=0 THEN 'weak_unreviewed' ELSE 'verified' END AS label_status,
  CASE WHEN d.doc_id%13=0 THEN 'hansen' ELSE 'manual' END AS label_source,
  CASE WHEN d.doc_id%6=0 THEN 'review_mask_only' ELSE 'full' END AS training_scope,
  CASE WHEN d.doc_id%12=0 THEN '' ELSE 'masks/'||d.doc_id||'.png' END AS review_mask,
  CASE WHEN d.doc_id%17=0 THEN 'unverified' ELSE '' END AS audit_status,
  sha256(d.text) AS content_hash,
  CASE WHEN d.doc_id%2=0 THEN 'mask/'||d.doc_id ELSE 'absent' END AS new_building,
  CASE WHEN d.doc_id%3=0 THEN 'mask/t'||d.doc_id ELSE '' END AS tree_removal,
  CASE WHEN d.doc_id%8=0 THEN 'raster'||(d.doc_id//40) ELSE '' END AS source_raster,
  d.n_chars, l.toxic
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


# --- 32x32 two-class tiles from lineitem ---------------------------------------

def tile_pixels(spark: SparkSession, sf: str, placed: bool = False) -> DataFrame:
    """(pair_id, class_name, y, x, p, truth): one row per covered cell. With ``placed`` the lines of a pair meet first, so that later groups of a pair need no exchange."""
    l = table(spark, sf, "lineitem")
    if placed:
        l = tile_partition(l.select("l_suppkey", "l_linestatus", "l_partkey", "l_orderkey", "l_discount", "l_returnflag"), ["l_suppkey"])
    return (
        l.groupBy(
            F.col("l_suppkey").alias("pair_id"),
            F.when(F.col("l_linestatus") == "O", "new_building").otherwise("tree_removal").alias("class_name"),
            (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"),
        )
        .agg(
            (F.max(F.col("l_discount") + 0.0) * 10.0).alias("p"),
            (F.max("l_returnflag") == "R").alias("truth"),
        )
    )


def tile_truth(spark: SparkSession, sf: str) -> DataFrame:
    """``tile_pixels`` without ``p``, where the lines of a pair meet first: all that a line says of its cell goes there as one small number."""
    l = table(spark, sf, "lineitem")
    edge, flag = 2 * SIDE, F.col("l_returnflag")  # a remainder of a negative key is negative; the last value stands for null
    place = lambda key: F.coalesce(F.col(key) % SIDE + SIDE, F.lit(edge)).cast("int")
    rank = F.when(flag > "R", 2).when(flag == "R", 1).when(flag.isNull(), 3).otherwise(0)
    code = ((F.when(F.col("l_linestatus") == "O", 1).otherwise(0) * (edge + 1) + place("l_partkey")) * (edge + 1) + place("l_orderkey")) * 4 + rank
    c = tile_partition(l.select(F.col("l_suppkey").alias("pair_id"), code.alias("_code")), ["pair_id"])
    digit = lambda unit, base: F.floor(F.col("_code") / unit) % base
    back = lambda d: F.when(d < edge, d - SIDE).cast("int")
    lines = c.select(
        "pair_id", F.when(digit(4 * (edge + 1) ** 2, 2) == 1, "new_building").otherwise("tree_removal").alias("class_name"),
        back(digit(4 * (edge + 1), edge + 1)).alias("y"), back(digit(4, edge + 1)).alias("x"), F.when(digit(1, 4) < 3, digit(1, 4)).alias("_rank"))
    return lines.groupBy("pair_id", "class_name", "y", "x").agg((F.max("_rank") == 1).alias("truth"))


def presence(spark: SparkSession, sf: str) -> DataFrame:
    """(pair_id, class_name, presence): one score in [0, 1] per tile and class; also the population."""
    l = table(spark, sf, "lineitem")
    return l.groupBy(
        F.col("l_suppkey").alias("pair_id"),
        F.when(F.col("l_linestatus") == "O", "new_building").otherwise("tree_removal").alias("class_name"),
    ).agg(F.round(F.avg("l_tax") * 12.5, 6).alias("presence"))


TILE_SQL = """
px AS (
 SELECT l_suppkey AS pair_id, CASE WHEN l_linestatus='O' THEN 'new_building' ELSE 'tree_removal' END AS class_name,
  CAST(l_partkey%32 AS INTEGER) AS y, CAST(l_orderkey%32 AS INTEGER) AS x,
  max(l_discount+0.0::DOUBLE)*10.0::DOUBLE AS p, max(l_returnflag)='R' AS truth
 FROM lineitem GROUP BY ALL),
pop AS (
 SELECT l_suppkey AS pair_id, CASE WHEN l_linestatus='O' THEN 'new_building' ELSE 'tree_removal' END AS class_name,
  round(avg(l_tax)*12.5::DOUBLE, 6) AS presence FROM lineitem GROUP BY ALL)"""


def components_sql(source: str, target: str, width: int = SIDE, diagonal: bool = False) -> str:
    """Recursive labelling of a pixel relation; component = smallest cell index."""
    near = "greatest(abs(n.y-r.y),abs(n.x-r.x))=1" if diagonal else "abs(n.y-r.y)+abs(n.x-r.x)=1"
    return f"""
{target}_walk AS (
 SELECT pair_id, class_name, y, x, y*{width}+x AS seed FROM {source}
 UNION
 SELECT n.pair_id, n.class_name, n.y, n.x, r.seed FROM {target}_walk r JOIN {source} n
  ON n.pair_id=r.pair_id AND n.class_name=r.class_name AND n.y BETWEEN r.y-1 AND r.y+1 AND {near} AND r.seed < n.y*{width}+n.x),
{target} AS (SELECT pair_id, class_name, y, x, CAST(min(seed) AS BIGINT) AS component_id FROM {target}_walk GROUP BY ALL)"""


# --- 8x8 image pairs from embeddings --------------------------------------------

def image_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(pair_id, y, x, pre_r.. post_b, p_building, p_tree, v_pre, v_post): vectors k and k+1 as an image pair."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pre = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("a"))
    post = e.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("b"))
    cells = pre.join(post, "pair_id").select("pair_id", "a", "b", F.posexplode(F.sequence(F.lit(0), F.lit(63))).alias("i", "_j"))

    def squash(side: str, shift: int):
        v = F.element_at(F.col(side), ((F.col("i") + shift) % 64) + 1).cast("double")
        return 1.0 / (1.0 + F.exp(-8.0 * v))

    def raw(side: str):
        return F.element_at(F.col(side), F.col("i") + 1).cast("double")

    return cells.select(
        "pair_id", F.floor(F.col("i") / SMALL).cast("int").alias("y"), (F.col("i") % SMALL).cast("int").alias("x"),
        *[squash("a", s).alias(f"pre_{c}") for c, s in (("r", 0), ("g", 21), ("b", 42))],
        *[squash("b", s).alias(f"post_{c}") for c, s in (("r", 0), ("g", 21), ("b", 42))],
        (1.0 / (1.0 + F.exp(-16.0 * (raw("b") - raw("a"))))).alias("p_building"),
        (1.0 / (1.0 + F.exp(-16.0 * (raw("a") - raw("b"))))).alias("p_tree"),
    )


IMAGE_SQL = """
img AS (
 SELECT a.vec_id AS pair_id, CAST(i//8 AS INTEGER) AS y, CAST(i%8 AS INTEGER) AS x,
  1/(1+exp(-8*a.embedding[i+1]::DOUBLE)) AS pre_r, 1/(1+exp(-8*a.embedding[(i+21)%64+1]::DOUBLE)) AS pre_g, 1/(1+exp(-8*a.embedding[(i+42)%64+1]::DOUBLE)) AS pre_b,
  1/(1+exp(-8*b.embedding[i+1]::DOUBLE)) AS post_r, 1/(1+exp(-8*b.embedding[(i+21)%64+1]::DOUBLE)) AS post_g, 1/(1+exp(-8*b.embedding[(i+42)%64+1]::DOUBLE)) AS post_b,
  1/(1+exp(-16*(b.embedding[i+1]::DOUBLE-a.embedding[i+1]::DOUBLE))) AS p_building,
  1/(1+exp(-16*(a.embedding[i+1]::DOUBLE-b.embedding[i+1]::DOUBLE))) AS p_tree
 FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1, range(64) t(i))"""


def image_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Long probability maps (pair_id, class_name, y, x, p) of the image pairs."""
    return image_pairs(spark, sf).select(
        "pair_id", "y", "x",
        F.inline(F.array(
            F.struct(F.lit("new_building").alias("class_name"), F.col("p_building").alias("p")),
            F.struct(F.lit("tree_removal").alias("class_name"), F.col("p_tree").alias("p")),
        )),
    )


MAPS_SQL = IMAGE_SQL + """,
maps AS (SELECT pair_id, 'new_building' AS class_name, y, x, p_building AS p FROM img
 UNION ALL SELECT pair_id, 'tree_removal', y, x, p_tree FROM img)"""


# --- boxes, acquisitions, candidates, log ---------------------------------------

def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One metric box per part: 10 m wide, scattered by prime strides so some touch."""
    k = F.col("p_partkey")
    w = ((k * 37) % 4001).cast("double")
    s = ((k * 53) % 3001).cast("double")
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        k.alias("id"), w.alias("w"), s.alias("s"), (w + size).alias("e"), (s + 10.0).alias("n"))


BOXES_SQL = """
boxes AS (SELECT p_partkey AS id, CAST((p_partkey*37)%4001 AS DOUBLE) AS w, CAST((p_partkey*53)%3001 AS DOUBLE) AS s,
  CAST((p_partkey*37)%4001 AS DOUBLE)+p_size AS e, CAST((p_partkey*53)%3001 AS DOUBLE)+10 AS n FROM part)"""


def acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("region_id"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("path"))


ACQUISITIONS_SQL = "acq AS (SELECT o_custkey AS region_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS path FROM orders)"


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Per-component evidence rows; (pair_id, class_name, component_id) is unique."""
    l = table(spark, sf, "lineitem")
    return l.groupBy(
        F.col("l_orderkey").alias("pair_id"),
        F.when(F.col("l_linestatus") == "O", "new_building").otherwise("tree_removal").alias("class_name"),
        F.col("l_linenumber").alias("component_id"),
    ).agg(
        (F.max("l_quantity") / 50.0).alias("score"),
        (F.max("l_quantity") >= 20).alias("kept"),
        (F.max("l_extendedprice") / 1000.0).alias("area"),
        F.round(F.max(F.col("l_discount") + 0.0) * 10.0, 6).alias("stability"),
        F.round(F.max(F.col("l_tax") + 0.0) * 12.5, 6).alias("reverse"),
        (F.min("l_quantity") / 50.0).alias("confidence"),
        (F.max("l_returnflag") == "R").alias("is_true"),
    )


CANDIDATES_SQL = """
cand AS (SELECT l_orderkey AS pair_id, CASE WHEN l_linestatus='O' THEN 'new_building' ELSE 'tree_removal' END AS class_name,
  l_linenumber AS component_id, max(l_quantity)/50 AS score, max(l_quantity)>=20 AS kept,
  max(l_extendedprice)/1000 AS area, round(max(l_discount+0.0::DOUBLE)*10,6) AS stability,
  round(max(l_tax+0.0::DOUBLE)*12.5::DOUBLE,6) AS reverse, min(l_quantity)/50 AS confidence, max(l_returnflag)='R' AS is_true
 FROM lineitem GROUP BY ALL)"""


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value"))
