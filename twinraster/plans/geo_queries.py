"""Footprints, catalogues, grids, vegetation, forest loss, shift search, sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import geo as G
from ..operators import graph as H
from ..operators import maps as M
from ..operators import runs as R
from ..operators import sampling as A
from ..session import cut, scratch_path
from . import evidence_queries as EQ
from . import views as V
from .registry import query

N = V.SMALL
OWN = "pair_id, class_name, component_id"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("j04_box_adjacency", "WITH " + V.BOXES_SQL + " SELECT a.id AS src, b.id AS dst FROM boxes a JOIN boxes b ON a.id<b.id AND pow(greatest(0,b.w-a.e,a.w-b.e),2)+pow(greatest(0,b.s-a.n,a.s-b.n),2)<=9")
def box_adjacency(spark, sf):
    return H.box_adjacency(V.boxes(spark, sf), buffer=3.0)


TRIANGLES = "tri AS (SELECT id, w, s, w+2*(e-w) AS e, s+20 AS n FROM boxes)"


def triangles(spark, sf):
    b = V.boxes(spark, sf)
    p = lambda x, y: F.array(F.col(x), F.col(y))
    t = b.withColumn("e", F.col("w") + 2 * (F.col("e") - F.col("w"))).withColumn("n", F.col("s") + 20)
    return t.withColumn("rings", F.array(F.array(p("w", "s"), p("e", "s"), p("w", "n"))))


@query("j05_footprint_pixels", "WITH " + V.BOXES_SQL + "," + TRIANGLES + """,
c AS (SELECT id, w, s, e, n, x, y FROM tri, LATERAL (SELECT unnest(range(CAST(w AS BIGINT), CAST(e AS BIGINT)+1)) AS x), LATERAL (SELECT unnest(range(CAST(s AS BIGINT), CAST(n AS BIGINT)+1)) AS y)),
i AS (SELECT id, x, y FROM c WHERE e>w AND ((CASE WHEN (s<=y+0.5)<>(n<=y+0.5) AND x+0.5 < w+(y+0.5-n)/(s-n)*(w-w) THEN 1 ELSE 0 END)+(CASE WHEN (s<=y+0.5)<>(n<=y+0.5) AND x+0.5 < e+(y+0.5-s)/(n-s)*(w-e) THEN 1 ELSE 0 END))%2=1)
SELECT id, x//256 AS tile_x, y//256 AS tile_y, count(*) AS pixels FROM i GROUP BY ALL""")
def footprint_pixels(spark, sf):
    t = G.split_by_tile(G.footprint_runs(triangles(spark, sf), ["id"]), ["id"], 256)
    return t.groupBy("id", "tile_x", "tile_y").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"))


@query("s07_footprint_scan", "WITH " + V.BOXES_SQL + """, f AS (SELECT id, w, s, CASE WHEN id%2=0 THEN e+900 ELSE e END AS e, CASE WHEN id%2=0 THEN n+700 ELSE n END AS n FROM boxes)
SELECT CAST(id AS VARCHAR) AS feature_id, CAST(unnest(CASE WHEN id%2=0 THEN [0,1] ELSE [0] END) AS INTEGER) AS part, w, s, e, n FROM f WHERE e>=500 AND w<=2500 AND n>=300 AND s<=2000""")
def footprint_scan(spark, sf):
    """Even features have a second part far from the first: often only one of the two meets the box."""
    b = V.boxes(spark, sf)
    corner = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))

    def ring(dx, dy):
        w, e, s, n = F.col("w") + dx, F.col("e") + dx, F.col("s") + dy, F.col("n") + dy
        return F.concat(F.lit("[["), F.concat_ws(",", corner(w, s), corner(e, s), corner(e, n), corner(w, n)), F.lit("]]"))

    many = F.col("id") % 2 == 0
    line = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","geometry":{"type":"'), F.when(many, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'),
                    F.when(many, F.concat(F.lit("["), ring(0, 0), F.lit(","), ring(900, 700), F.lit("]"))).otherwise(ring(0, 0)), F.lit("}}"))
    path = scratch_path(spark, "footprints")
    b.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return G.read_footprints(spark, path, (500.0, 300.0, 2500.0, 2000.0)).select("feature_id", "part", "w", "s", "e", "n")


@query("s12_catalogue_scan", """WITH i AS (SELECT 'm'||o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey%3 AS st FROM orders),
k AS (SELECT id, year FROM i WHERE year IN (1996, 1998) AND st=1)
SELECT id, year, 'md' AS state, (SELECT count(*) FROM k)>500 AS truncated FROM k""")
def catalogue(spark, sf):
    """Pages of fifty items, every item on two pages; all items, and whether a limit of 500 would truncate them."""
    o = V.table(spark, sf, "orders")
    item = F.struct(F.concat(F.lit("m"), "o_orderkey").alias("id"), F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.when(F.col("o_custkey") % 3 == 1, "MD").when(F.col("o_custkey") % 3 == 2, "Va").otherwise("pa").alias("state"), F.lit(0.6).alias("gsd")).alias("properties"))
    pages = o.withColumn("page", F.explode(F.array(F.floor(F.col("o_orderkey") / 50), F.floor(F.col("o_orderkey") / 50) + 1))).groupBy("page").agg(F.collect_list(item).alias("features"))
    path = scratch_path(spark, "pages")
    pages.write.json(path)
    schema = "page long, features array<struct<id:string,properties:struct<datetime:string,state:string,gsd:double>>>"
    items = G.catalogue_items(spark.read.schema(schema).json(path), [1996, 1998], "md")
    verdict = G.catalogue_verdict(items, 500).select("truncated").withColumn("_k", F.lit(1))
    return items.withColumn("_k", F.lit(1)).join(F.broadcast(verdict), "_k").select("id", "year", "state", "truncated")  # one row


@query("j02_year_options", """WITH y AS (SELECT DISTINCT o_custkey AS r, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE o_totalprice>150000)
SELECT a.r AS region_id, a.y AS year_pre, b.y AS year_post FROM y a JOIN y b ON a.r=b.r AND b.y-a.y BETWEEN 2 AND 4""")
def year_options(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("region_id"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 150000).alias("covers"))
    return G.year_options(o)


@query("v15_loss_interval", """SELECT l_orderkey AS pair_id, l_linenumber AS n, CAST(l_quantity AS INTEGER)%25 AS lossyear FROM lineitem WHERE CAST(l_quantity AS INTEGER)%25 BETWEEN 1 AND 24 AND CAST(l_quantity AS INTEGER)%25 > l_partkey%20 AND CAST(l_quantity AS INTEGER)%25 <= l_partkey%20+3
 AND l_extendedprice/1000>=30 AND l_returnflag<>'A'""")
def loss_interval(spark, sf):
    l = V.table(spark, sf, "lineitem")
    pre = 2000 + F.col("l_partkey") % 20
    px = l.select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("int") % 25).alias("lossyear"), (F.col("l_extendedprice") / 1000).alias("treecover"),
                  F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("datamask"), "l_partkey")
    return G.loss_pixels(px, pre, pre + 3, 30.0).select("pair_id", "n", "lossyear")


@query("v20_budget", """WITH f AS (SELECT p_brand, CASE WHEN p_partkey%97=0 THEN NULL WHEN p_partkey%131=0 THEN -1 ELSE p_size*1000 END AS b, p_name FROM part),
g AS (SELECT p_brand, count(*) n, count(*) FILTER (WHERE b IS NULL) u, count(*) FILTER (WHERE b<0) ng, coalesce(sum(b),0) k, max(b) mx, count(DISTINCT p_name) d FROM f GROUP BY 1)
SELECT p_brand AS plan, n AS files, u AS unknown, CAST(k AS BIGINT) AS known_bytes, array_to_string(list_filter([CASE WHEN n>85 THEN 'too many files' END, CASE WHEN u>0 THEN 'unknown size' END, CASE WHEN ng>0 THEN 'negative size' END, CASE WHEN mx>49000 THEN 'file too large' END,
 CASE WHEN k>2000000 THEN 'plan too large' END, CASE WHEN d<n THEN 'duplicate name' END], lambda s: s IS NOT NULL), '; ') AS reasons FROM g""")
def budget(spark, sf):
    k = F.col("p_partkey")
    f = V.table(spark, sf, "part").select(F.col("p_brand").alias("plan"), F.col("p_name").alias("name"), F.lit(True).alias("safe"),
                                          F.when(k % 97 == 0, None).when(k % 131 == 0, -1).otherwise(F.col("p_size") * 1000).cast("long").alias("bytes"))
    return G.budget_verdict(f, "plan", 85, 49000, 2000000).select("plan", "files", "unknown", "known_bytes", F.array_join("reasons", "; ").alias("reasons"))


@query("a36_byte_estimates", "SELECT p_brand AS region, CAST(sum(ceil(p_size*10/0.36::DOUBLE)*4*2) AS BIGINT) AS bytes FROM part GROUP BY 1")
def byte_estimates(spark, sf):
    return V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("region")).agg(F.sum(G.raster_bytes(F.col("p_size") * 10.0, 0.6, 4, 2)).cast("long").alias("bytes"))


GRID_SQL = "WITH " + V.BOXES_SQL + """,
p AS (SELECT id, ceil(greatest(w, w+1.3::DOUBLE)/0.5)*0.5 AS west, ceil(greatest(s, s-2)/0.5)*0.5 AS south, floor(least(e, e+0.7::DOUBLE)/0.5)*0.5 AS east, floor(least(n, n-0.4::DOUBLE)/0.5)*0.5 AS north FROM boxes),
g AS (SELECT *, CAST(round((east-west)/0.5) AS INTEGER) AS width, CAST(round((north-south)/0.5) AS INTEGER) AS height FROM p WHERE east>west AND north>south)"""


def grids(spark, sf):
    b = V.boxes(spark, sf)
    pairs = b.select("id", *[F.col(c).alias(f"a_{c}") for c in "wsen"], (F.col("w") + 1.3).alias("b_w"), (F.col("s") - 2).alias("b_s"), (F.col("e") + 0.7).alias("b_e"), (F.col("n") - 0.4).alias("b_n"))
    return G.common_grid(pairs, 0.5)


@query("r20_tile_grid", GRID_SQL + " SELECT id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, width, height, CASE WHEN (width//8)*(height//8)>6 THEN 'too many tiles' WHEN width*height>500 THEN 'grid exceeds the pixel limit' END AS verdict FROM g, range(0,100,8) a(r), range(0,200,8) b(c) WHERE r<=height-8 AND c<=width-8")
def tile_grid(spark, sf):
    return G.grid_tiles(grids(spark, sf), 8, 6, 500).select("id", "row", "col", "width", "height", "verdict")


AOI_SQL = "WITH " + V.BOXES_SQL + """,
p AS (SELECT id, ceil(greatest(w, w+1.3::DOUBLE, CASE WHEN id%4=0 THEN w+6.1::DOUBLE END)/0.5)*0.5 AS west, ceil(greatest(s, s-2)/0.5)*0.5 AS south, floor(least(e, e+0.7::DOUBLE, CASE WHEN id%3=0 THEN e-5.2::DOUBLE END)/0.5)*0.5 AS east, floor(least(n, n-0.4::DOUBLE)/0.5)*0.5 AS north FROM boxes),
g AS (SELECT *, CAST(round((east-west)/0.5) AS INTEGER) AS width, CAST(round((north-south)/0.5) AS INTEGER) AS height FROM p WHERE east>west AND north>south)"""


@query("r20_valid_tiles", AOI_SQL + """,
t AS (SELECT id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, width, height FROM g, range(0,100,8) a(r), range(0,200,8) b(c) WHERE r<=height-8 AND c<=width-8),
v AS (SELECT t.*, sum(CASE WHEN y%6=5 THEN 0 ELSE greatest(0, least(col+8, width-y%4)-greatest(col, id%5)) END)/64 AS f FROM t, range(0,100) q(y) WHERE y BETWEEN row AND row+7 GROUP BY ALL)
SELECT id, row, col, f AS valid_fraction FROM v WHERE f>=0.8""")
def valid_fractions(spark, sf):
    """Tiles of grids within their area of interest that are valid on four fifths in both rasters: the first lacks a strip on
    the left and every sixth row, the second a ragged strip on the right."""
    b = V.boxes(spark, sf)
    k = F.col("id")
    pairs = b.select("id", *[F.col(c).alias(f"a_{c}") for c in "wsen"], (F.col("w") + 1.3).alias("b_w"), (F.col("s") - 2).alias("b_s"), (F.col("e") + 0.7).alias("b_e"), (F.col("n") - 0.4).alias("b_n"),
                     F.when(k % 4 == 0, F.col("w") + 6.1).alias("aoi_w"), F.lit(None).cast("double").alias("aoi_s"), F.when(k % 3 == 0, F.col("e") - 5.2).alias("aoi_e"), F.lit(None).cast("double").alias("aoi_n"))
    g = G.common_grid(pairs, 0.5)
    rows = g.select("id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    first = rows.filter("y % 6 <> 5").select("id", "y", (k % 5).cast("int").alias("x0"), F.col("width").alias("x1")).filter("x1 > x0")
    second = rows.select("id", "y", F.lit(0).alias("x0"), (F.col("width") - F.col("y") % 4).alias("x1")).filter("x1 > x0")
    found = G.valid_tiles(G.grid_tiles(g, 8), [first, second], 8, 0.8)
    return found.select("id", "row", "col", "valid_fraction")


@query("r21_affine_and_zone", "WITH " + V.BOXES_SQL + """ SELECT id, round((w-10)/0.5,6) AS col, round((3000-s)/0.5,6) AS row, CAST(CASE WHEN s/20-75 BETWEEN -80 AND 84 THEN (CASE WHEN s/20-75>=0 THEN 32600 ELSE 32700 END)+least(60,greatest(1,floor((w/12-170+180)/6)+1)) END AS INTEGER) AS epsg FROM boxes""")
def affine(spark, sf):
    c = lambda v: F.lit(float(v))
    col, row = G.to_pixel(F.col("w"), F.col("s"), c(0.5), c(0), c(10), c(0), c(-0.5), c(3000))
    return V.boxes(spark, sf).select("id", F.round(col, 6).alias("col"), F.round(row, 6).alias("row"), G.utm_code(F.col("w") / 12 - 170, F.col("s") / 20 - 75).alias("epsg"))


@query("r22_granule_cover", "WITH " + V.BOXES_SQL + """, b AS (SELECT id, w/12-170 AS w, s/20-75 AS s, w/12-170+(e-w)/2 AS e, s/20-75+5 AS n FROM boxes WHERE e>w),
x AS (SELECT id, lon, lat FROM b, range(-190,200,10) a(lon), range(-90,100,10) c(lat) WHERE lon>=floor(w/10)*10 AND lon<=(ceil(e/10)-1)*10 AND lat>=floor(s/10)*10+10 AND lat<=ceil(n/10)*10)
SELECT id, lpad(CAST(abs(lat) AS VARCHAR),2,'0')||CASE WHEN lat>=0 THEN 'N' ELSE 'S' END||'_'||lpad(CAST(abs(lon) AS VARCHAR),3,'0')||CASE WHEN lon>=0 THEN 'E' ELSE 'W' END AS granule FROM x""")
def granule_cover(spark, sf):
    b = V.boxes(spark, sf).select("id", (F.col("w") / 12 - 170).alias("w"), (F.col("s") / 20 - 75).alias("s"), (F.col("w") / 12 - 170 + (F.col("e") - F.col("w")) / 2).alias("e"), (F.col("s") / 20 - 75 + 5).alias("n"))
    return G.granules(b, ["id"])


BYTES_SQL = V.IMAGE_SQL + """,
bt AS (SELECT pair_id, y, x, """ + ", ".join(f"round({s}_{c}*255) AS {s}_{c}" for s in ("pre", "post") for c in "rgb") + """, p_tree, p_building FROM img)"""


def byte_pairs(spark, sf):
    t = V.image_pairs(spark, sf)
    return t.withColumns({f"{s}_{c}": F.round(F.col(f"{s}_{c}") * 255) for s in ("pre", "post") for c in "rgb"})


@query("r23_vegetation", "WITH " + BYTES_SQL + """ SELECT pair_id, y, x, round(least(1,greatest(0,2*(2*pre_g-pre_r-pre_b)/greatest(pre_r+pre_g+pre_b,1))),6) AS share, round((post_g-post_r)/greatest(post_g+post_r,1),6) AS ndvi, 2*post_g-post_r-post_b AS exg FROM bt""")
def vegetation(spark, sf):
    c = F.col
    return byte_pairs(spark, sf).select("pair_id", "y", "x", F.round(G.vegetation_share(c("pre_r"), c("pre_g"), c("pre_b")), 6).alias("share"), F.round(G.ndvi(c("post_g"), c("post_r")), 6).alias("ndvi"), G.excess_green(c("post_r"), c("post_g"), c("post_b")).alias("exg"))


LOSS_SQL = "WITH RECURSIVE " + BYTES_SQL + """,
v AS (SELECT pair_id, y, x, least(1,greatest(0,2*(2*pre_g-pre_r-pre_b)/greatest(pre_r+pre_g+pre_b,1))) AS b, least(1,greatest(0,2*(2*post_g-post_r-post_b)/greatest(post_r+post_g+post_b,1))) AS a, p_tree>=0.1::DOUBLE AND (pre_r+pre_g+pre_b)/3>=30 AND (post_r+post_g+post_b)/3>=30 AS o FROM bt),
h AS (SELECT pair_id, 'c' AS class_name, y, x FROM v WHERE o AND b>=0 AND a<=0.95 AND b-a>=-0.9),
er AS (SELECT h.pair_id, h.class_name, h.y, h.x FROM h JOIN h n ON n.pair_id=h.pair_id AND abs(n.y-h.y)+abs(n.x-h.x)<=1 GROUP BY ALL HAVING count(*)=5),""" + V.components_sql("er", "lc", N, diagonal=True)


def loss(spark, sf):
    return G.forest_loss(byte_pairs(spark, sf), F.col("p_tree") >= 0.1, F.lit(True), N, N, pre_min=0.0, post_max=0.95, min_drop=-0.9, min_area=3)


@query("r24_forest_loss", LOSS_SQL + " SELECT pair_id, y, x FROM lc QUALIFY count(*) OVER (PARTITION BY pair_id, component_id)>=3")
def forest_loss(spark, sf):
    return R.to_pixels(loss(spark, sf)[0])


@query("r24_loss_confidence", LOSS_SQL + " SELECT pair_id, y, x, round(CASE WHEN o THEN least(1,greatest(0,b-a))*b*(1-a) ELSE 0 END,6) AS confidence FROM v")
def loss_confidence(spark, sf):
    return loss(spark, sf)[1].select("pair_id", "y", "x", *r6("confidence"))


@query("r24_review_states", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus='P' THEN CASE WHEN o_custkey%3=0 THEN 'mask or reviewer without a decision' END WHEN o_custkey%3<>0 THEN 'reviewer required'
 WHEN o_orderstatus='O' AND o_orderkey%2=1 THEN 'approval requires a mask' WHEN o_orderstatus='O' AND o_orderkey%10=0 THEN 'mask leaves the reviewable area' WHEN o_orderstatus='F' AND o_orderkey%10=4 THEN 'rejection cannot carry a mask' END AS reason,
 CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'rejected' ELSE 'pending' END AS review_status FROM orders""")
def review_states(spark, sf):
    k = F.col("o_orderkey")
    d = V.table(spark, sf, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "O", "approve").when(F.col("o_orderstatus") == "F", "reject").alias("decision"), F.when(F.col("o_custkey") % 3 == 0, "someone").alias("reviewer"),
        ((k % 2 == 0) & (F.col("o_orderstatus") != "P")).alias("has_mask"), F.when(k % 10 == 0, 3).otherwise(0).alias("outside_pixels"), F.when(k % 10 == 4, 5).otherwise(0).alias("mask_pixels"), F.lit(9).alias("review_pixels"))
    return G.loss_review_state(d).select("id", "reason", "review_status")


@query("r25_footprint_proposals", EQ.COMP_SQL.replace("WITH RECURSIVE " + V.IMAGE_SQL, "WITH RECURSIVE " + BYTES_SQL) + f""",
mb AS (SELECT {OWN}, (pre_g-pre_r)/greatest(pre_g+pre_r,1) AS np, (post_g-post_r)/greatest(post_g+post_r,1) AS nq, (abs(post_r-pre_r)+abs(post_g-pre_g)+abs(post_b-pre_b))/3 AS ch FROM ck JOIN bt USING (pair_id, y, x))
SELECT {OWN}, count(*) AS pixels, round(avg(np),6) AS before, round(avg(nq),6) AS after, round(avg(ch),6) AS change FROM mb GROUP BY ALL HAVING count(*)>=5 AND avg(np)>0.02 AND avg(nq)<0.05 AND avg(ch)>25""")
def footprint_proposals(spark, sf):
    b = byte_pairs(spark, sf)
    maps = b.select("pair_id", "y", "x", G.ndvi(F.col("pre_g"), F.col("pre_r")).alias("ndvi_pre"), G.ndvi(F.col("post_g"), F.col("post_r")).alias("ndvi_post"),
                    ((F.abs(F.col("post_r") - F.col("pre_r")) + F.abs(F.col("post_g") - F.col("pre_g")) + F.abs(F.col("post_b") - F.col("pre_b"))) / 3).alias("change"))
    members = E.member_pixels(EQ.components(spark, sf), maps, ["pair_id"])
    return G.footprint_proposals(members, E.OWNER, 5, 0.02, 0.05, 25.0).select(*E.OWNER, "pixels", *r6("before", "after", "change"))


@query("a34_crop_counts", "WITH " + V.TILE_SQL + " SELECT pair_id, CAST(y//8*8 AS INTEGER) AS row, CAST(x//8*8 AS INTEGER) AS col, count(*) AS pixels FROM (SELECT DISTINCT pair_id, y, x FROM px WHERE truth) GROUP BY ALL HAVING count(*)>=14")
def crop_counts(spark, sf):
    px = V.tile_pixels(spark, sf).groupBy("pair_id", "y", "x").agg(F.bool_or("truth").alias("t"))
    return G.crop_counts(px, 8, F.col("t"), 14)


@query("j21_label_transition", "WITH " + V.TILE_SQL + " SELECT pair_id, y, x FROM px WHERE class_name='new_building' AND truth EXCEPT SELECT pair_id, y, x FROM px WHERE class_name='tree_removal' AND truth")
def label_transition(spark, sf):
    t = V.tile_pixels(spark, sf).withColumn("label", F.when(F.col("truth"), 10).otherwise(0))
    return G.label_transition(t.filter("class_name = 'tree_removal'"), t.filter("class_name = 'new_building'"), 10)


@query("j22_metadata_joins", "SELECT s_suppkey AS raster_id, n_name AS region, r_name AS zone, count(l_orderkey) AS tiles FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY ALL")
def metadata_joins(spark, sf):
    """Fact rows are counted per raster before the lookups; Spark broadcasts a lookup only when its size allows."""
    tiles = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("tiles"))
    s = V.table(spark, sf, "supplier").join(tiles, "s_suppkey", "left")
    j = s.join(V.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("s_suppkey").alias("raster_id"), F.col("n_name").alias("region"), F.col("r_name").alias("zone"), F.coalesce("tiles", F.lit(0).cast("long")).alias("tiles"))


# --- local shift search --------------------------------------------------------------------

REGION_SQL = EQ.COMP_SQL + f""", {EQ.CELLS}, bx AS (SELECT {OWN}, greatest(min(y)-2,0) y0, greatest(min(x)-2,0) x0, least(max(y)+3,8) y1, least(max(x)+3,8) x1 FROM ck GROUP BY ALL),
rn AS (SELECT DISTINCT {OWN}, c.y, c.x FROM ck JOIN cells c ON abs(c.y-ck.y)<=1 AND abs(c.x-ck.x)<=1),
rgn AS (SELECT rn.*, ck.pair_id IS NOT NULL AS interior FROM rn JOIN bx USING ({OWN}) LEFT JOIN ck USING (pair_id, class_name, component_id, y, x) WHERE rn.y>=y0 AND rn.y<y1 AND rn.x>=x0 AND rn.x<x1)"""


def region(spark, sf):
    return E.alignment_region(EQ.components(spark, sf), N, N, 2, 1)


@query("r18_alignment_region", REGION_SQL + f" SELECT {OWN}, y, x, interior FROM rgn")
def alignment_region(spark, sf):
    return region(spark, sf)


SUPPORT_SQL = REGION_SQL + f""",
sh AS (SELECT row_number() OVER (ORDER BY dy*dy+dx*dx, dy, dx)-1 AS rank, dy, dx FROM range(-3,4) a(dy), range(-3,4) b(dx) WHERE dy*dy+dx*dx<=4),
ts AS (SELECT rgn.*, rank, dy, dx, y+dy BETWEEN 0 AND 7 AND x+dx BETWEEN 0 AND 7 AS ok FROM rgn, sh),
el AS (SELECT *, row_number() OVER (PARTITION BY {OWN} ORDER BY rank) AS pos FROM (SELECT {OWN}, rank, count(*) AS nt FROM ts GROUP BY ALL HAVING count(*) FILTER (WHERE ok)/count(*)>=0.75 OR rank=0)),
pf AS (SELECT a.pair_id, a.class_name, a.component_id, a.pos, c.y, c.x, min(t.ok::INT) AS alive FROM el a JOIN el b ON a.pair_id=b.pair_id AND a.class_name=b.class_name AND a.component_id=b.component_id AND b.pos<=a.pos
  JOIN rgn c ON c.pair_id=a.pair_id AND c.class_name=a.class_name AND c.component_id=a.component_id JOIN ts t ON t.pair_id=c.pair_id AND t.class_name=c.class_name AND t.component_id=c.component_id AND t.y=c.y AND t.x=c.x AND t.rank=b.rank GROUP BY ALL),
pn AS (SELECT {OWN}, pos, sum(alive) AS nc, count(*) AS nt FROM pf GROUP BY ALL),
kp AS (SELECT {OWN}, max(pos) AS keep FROM pn WHERE nc>=4 AND nc/nt>=0.75 AND nt>=4 GROUP BY ALL)"""


@query("r19_usable_shifts", SUPPORT_SQL + f" SELECT el.pair_id, el.class_name, el.component_id, CAST(rank AS INTEGER) AS rank FROM el JOIN kp USING ({OWN}) WHERE pos<=keep")
def usable_shifts(spark, sf):
    return E.usable_support(region(spark, sf), E.shift_table(spark, 2, N, N, N), N)[1].select(*E.OWNER, "rank")


RESIDUAL_SQL = SUPPORT_SQL + f""",
sp AS (SELECT pf.pair_id, pf.class_name, pf.component_id, y, x FROM pf JOIN kp USING ({OWN}) WHERE pos=keep AND alive=1),
us AS (SELECT el.pair_id, el.class_name, el.component_id, sh.rank, dy, dx FROM el JOIN kp USING ({OWN}) JOIN sh USING (rank) WHERE pos<=keep),
pr AS (SELECT sp.pair_id, sp.class_name, sp.component_id, us.rank, dy, dx, rgn.interior, sqrt(pow(a.pre_r-b.post_r,2)+pow(a.pre_g-b.post_g,2)+pow(a.pre_b-b.post_b,2)) AS l2, abs(a.pre_r-b.post_r)+abs(a.pre_g-b.post_g)+abs(a.pre_b-b.post_b) AS l1,
  a.pre_r*b.post_r+a.pre_g*b.post_g+a.pre_b*b.post_b AS ab, sqrt(a.pre_r*a.pre_r+a.pre_g*a.pre_g+a.pre_b*a.pre_b) AS na, sqrt(b.post_r*b.post_r+b.post_g*b.post_g+b.post_b*b.post_b) AS nb, (a.pre_r+a.pre_g+a.pre_b+b.post_r+b.post_g+b.post_b)/2 AS s1
 FROM sp JOIN rgn USING (pair_id, class_name, component_id, y, x) JOIN us USING ({OWN}) JOIN img a ON a.pair_id=sp.pair_id AND a.y=sp.y AND a.x=sp.x JOIN img b ON b.pair_id=sp.pair_id AND b.y=sp.y+dy AND b.x=sp.x+dx),
rs AS (SELECT {OWN}, rank, dy, dx, avg(l2) AS res, avg(ab/(na*nb)) AS cs, avg(l1)/avg(s1) AS n1, avg(l2)/avg((na+nb)/2) AS n2, coalesce(avg(l2) FILTER (WHERE interior),0) AS rin, coalesce(avg(l2) FILTER (WHERE NOT interior),0) AS rout FROM pr GROUP BY ALL)"""


def planes(spark, sf):
    return V.image_pairs(spark, sf).select("pair_id", "y", "x", F.array("pre_r", "pre_g", "pre_b").alias("v_pre"), F.array("post_r", "post_g", "post_b").alias("v_post"))


def residuals(spark, sf):
    return E.shift_search(region(spark, sf), planes(spark, sf), E.shift_table(spark, 2, N, N, N), N)


@query("a26_shift_residuals", RESIDUAL_SQL + f" SELECT {OWN}, dy, dx, round(res,6) AS residual, round(cs,6) AS cosine, round(n1,6) AS norm_l1, round(n2,6) AS norm_l2, round(rin,6) AS interior, round(rout,6) AS ring FROM rs")
def shift_residuals(spark, sf):
    return residuals(spark, sf).select(*E.OWNER, "dy", "dx", *r6("residual", "cosine", "norm_l1", "norm_l2", "interior", "ring"))


BEST_SQL = RESIDUAL_SQL + f""",
bs AS (SELECT *, row_number() OVER (PARTITION BY {OWN} ORDER BY res, rank) AS n FROM rs), ba AS (SELECT * FROM rs WHERE rank=0)"""


@query("a27_best_shift", BEST_SQL + f" SELECT bs.pair_id, bs.class_name, bs.component_id, bs.dy AS best_dy, bs.dx AS best_dx, round(ba.res,6) AS residual_before, round(bs.res,6) AS residual_after, round(bs.res/ba.res,6) AS residual_ratio, round(bs.cs-ba.cs,6) AS cosine_gain FROM bs JOIN ba USING ({OWN}) WHERE n=1")
def best_shift(spark, sf):
    return E.best_shift(residuals(spark, sf), 2).select(*E.OWNER, "best_dy", "best_dx", *r6("residual_before", "residual_after", "residual_ratio", "cosine_gain"))


@query("a28_scale_aggregation", BEST_SQL + f""" SELECT {OWN}, coalesce(bs.dx*32.0::DOUBLE,0) AS align_best_dx, coalesce(bs.dy*32.0::DOUBLE,0) AS align_best_dy, round(coalesce(bs.res,0),6) AS align_residual_after, CASE WHEN bs.res IS NULL THEN 0 ELSE 1 END::DOUBLE AS align_num_valid_scales
 FROM csize LEFT JOIN (SELECT * FROM bs WHERE n=1) bs USING ({OWN})""")
def scale_aggregation(spark, sf):
    per = E.best_shift(residuals(spark, sf), 2)
    comps = EQ.components(spark, sf).select(*E.OWNER).distinct()
    return E.combine_scales(per, comps, 256, {2: N}).select(*E.OWNER, "align_best_dx", "align_best_dy", *r6("align_residual_after"), "align_num_valid_scales")


# --- sampling ----------------------------------------------------------------------------------

CAT = "CASE doc_id%5 WHEN 0 THEN 'new_building' WHEN 1 THEN 'tree_removal' WHEN 2 THEN 'both' WHEN 3 THEN 'negative' ELSE 'real_negative' END"
UNIT = "(('0x'||substring(md5({0}),1,8))::BIGINT/4294967296.0::DOUBLE)"


@query("w12_epoch_draw", f"""WITH pool AS (SELECT doc_id AS id, {CAT} AS category FROM documents), ix AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id)-1 AS i, count(*) OVER (PARTITION BY category) AS n FROM pool),
sl AS (SELECT b AS batch, CAST(s AS INTEGER) AS slot, CASE WHEN s<4 THEN 'new_building' WHEN s<8 THEN 'tree_removal' WHEN s<10 THEN 'both' WHEN {UNIT.format("'5|'||b||'|'||s||'|kind'")}<0.75 THEN 'real_negative' ELSE 'negative' END AS category FROM range((SELECT count(*)//16 FROM documents)) a(b), range(16) c(s))
SELECT batch, slot, sl.category, ix.id FROM sl JOIN ix ON ix.category=sl.category AND ix.i=floor({UNIT.format("'5|'||batch||'|'||slot||'|member'")}*ix.n)""")
def epoch_draw(spark, sf):
    k = F.col("doc_id") % 5
    pool = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "new_building").when(k == 1, "tree_removal").when(k == 2, "both").when(k == 3, "negative").otherwise("real_negative").alias("category"))
    return A.draw_epoch(pool, pool.count() // 16, 16, 5)


@query("w13_negative_mining", "WITH " + V.TILE_SQL + """,
c AS (SELECT pair_id, CAST(y//8*8 AS INTEGER) AS row, CAST(x//8*8 AS INTEGER) AS col, count(*) AS built FROM px WHERE p>=0.6::DOUBLE GROUP BY ALL HAVING count(*)>=24),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY built DESC, row, col)=1),
u AS (SELECT pair_id, row, col, 1 AS pass FROM b UNION ALL SELECT DISTINCT pair_id, 12, 12, 2 FROM px)
SELECT pair_id, row, col, CAST(pass AS INTEGER) AS pass, row_number() OVER (ORDER BY pass, md5('11|'||pair_id)) AS rank FROM u""")
def negative_mining(spark, sf):
    px = V.tile_pixels(spark, sf)
    cells = G.crop_counts(px, 8, F.col("p") >= 0.6, 1).withColumnRenamed("pixels", "built")
    return A.mine_negatives(cells, px.select("pair_id").distinct(), 11, 24, (12, 12)).select("pair_id", "row", "col", "pass", "rank")


@query("w14_target_counts", """WITH s AS (SELECT s_suppkey AS source_id, row_number() OVER (ORDER BY s_suppkey)-1 AS i, count(*) OVER () AS n FROM supplier),
a AS (SELECT o_orderkey AS attempt, CASE o_orderstatus WHEN 'O' THEN 'new_building' WHEN 'F' THEN 'tree_removal' ELSE 'both' END AS category, o_totalprice>100000 AS ok FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY attempt) AS rank FROM a WHERE ok)
SELECT attempt, category, source_id, rank, rank<=CASE category WHEN 'both' THEN 50 ELSE 120 END AS within_target FROM r JOIN s ON s.i=attempt%n""")
def target_counts(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt"), F.when(F.col("o_orderstatus") == "O", "new_building").when(F.col("o_orderstatus") == "F", "tree_removal").otherwise("both").alias("category"), (F.col("o_totalprice") > 100000).alias("accepted"))
    ranked = A.rank_attempts(o, {"new_building": 120, "tree_removal": 120, "both": 50})
    return A.assign_sources(ranked, V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"))).select("attempt", "category", "source_id", "rank", "within_target")


KINDS = ["exact_no_change", "brightness", "seasonal_color", "roof_color", "vegetation_appearance", "shadows", "temporary_objects", "slight_shift", "blur"]


def byte_images(spark, sf):
    return byte_pairs(spark, sf).select(F.col("pair_id").alias("id"), "y", "x", *[F.col(f"pre_{c}").alias(c) for c in "rgb"])


@query("r31_colour_negatives", "WITH " + BYTES_SQL + f""",
k AS (SELECT * FROM (VALUES ('exact_no_change',1.0,1.0,1.0),('seasonal_color',1.15,0.9,0.8),('roof_color',0.8,1.0,1.3),('brightness',0,0,0)) v(kind,gr,gg,gb)),
s AS (SELECT pair_id AS id, kind, y, x, pre_r, pre_g, pre_b, CASE WHEN kind='brightness' THEN 0.7+0.6*{UNIT.format("'3|'||pair_id||'|'||kind||'|gain'")} END AS bg, 0.6+0.4*{UNIT.format("'3|'||pair_id||'|'||kind||'|strength'")} AS st, gr, gg, gb FROM bt, k)
SELECT id, kind, y, x, """ + ", ".join(f"least(255,greatest(0,round_even(pre_{c}*coalesce(bg,1+(g{c}-1)::DOUBLE*st),0))) AS {c}" for c in "rgb") + " FROM s")
def colour_negatives(spark, sf):
    return A.negative_rows(byte_images(spark, sf), ["exact_no_change", "seasonal_color", "roof_color", "brightness"], 3, N, N).drop("valid", "o_r", "o_g", "o_b")


@query("r31_changed_pixels")
def changed_pixels(spark, sf):
    return A.changed_pixels(A.negative_rows(byte_images(spark, sf), KINDS, 3, N, N))


@query("r31_paired_negatives", """SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 OR o_orderpriority='5-LOW' THEN 'region and season must match' WHEN o_orderstatus<>'O' THEN 'explicit confirmation required' END AS reason FROM orders""")
def paired(spark, sf):
    k = F.col("o_orderkey")
    p = V.table(spark, sf, "orders").select(k.alias("id"), F.lit("r1").alias("region_pre"), F.when(k % 3 == 0, "r2").otherwise("r1").alias("region_post"), F.lit("s").alias("season_pre"),
                                            F.when(F.col("o_orderpriority") == "5-LOW", "t").otherwise("s").alias("season_post"), (F.col("o_orderstatus") == "O").alias("confirmed"))
    return A.paired_negatives(p).select("id", "reason")
