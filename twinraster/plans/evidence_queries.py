"""Mask pipeline and per-component evidence (embedding image pairs)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import matching as K
from ..operators import polygons as G
from ..operators import runs as R
from ..operators import scoring as S
from . import views as V
from .registry import query

N = V.SMALL
MIN_AREA = 3
KEY = "pair_id, class_name"
OWN = "pair_id, class_name, component_id"

MASK_SQL = "WITH RECURSIVE " + V.MAPS_SQL + ", m AS (SELECT pair_id, class_name, y, x FROM maps WHERE p >= 0.35::DOUBLE), gr AS (SELECT DISTINCT pair_id, class_name FROM maps)"
COMP_SQL = "WITH RECURSIVE " + V.MAPS_SQL + ", m AS (SELECT * FROM maps WHERE p >= 0.5::DOUBLE)," + V.components_sql("m", "lab", N) + """,
csize AS (SELECT pair_id, class_name, component_id, count(*) AS area FROM lab GROUP BY ALL HAVING count(*)>=3),
ck AS (SELECT lab.* FROM lab JOIN csize USING (pair_id, class_name, component_id))"""
CELLS = "cells AS (SELECT CAST(a.v AS INTEGER) AS y, CAST(b.v AS INTEGER) AS x FROM range(8) a(v), range(8) b(v))"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def mask(spark, sf, threshold=0.35):
    return R.to_runs(R.tile_partition(V.image_maps(spark, sf).filter(F.col("p") >= threshold)))


def tiles(spark, sf):
    return V.image_maps(spark, sf).select(*R.TILE).distinct()


def components(spark, sf, maps=None):
    maps = V.image_maps(spark, sf) if maps is None else maps
    runs = R.to_runs(R.tile_partition(maps.filter("p >= 0.5")))
    return R.keep_large(R.label_components(runs, N, N), MIN_AREA).select(*E.OWNER, "y", "x0", "x1")


# --- morphology -------------------------------------------------------------------

@query("r03_square_dilation", MASK_SQL + f", {CELLS} SELECT DISTINCT {KEY}, c.y, c.x FROM m JOIN cells c ON abs(c.y-m.y)<=1 AND abs(c.x-m.x)<=1")
def dilation(spark, sf):
    return R.to_pixels(R.dilate(mask(spark, sf), 1, N, N))


@query("r04_square_erosion", MASK_SQL + f" SELECT a.pair_id, a.class_name, a.y, a.x FROM m a JOIN m b ON a.pair_id=b.pair_id AND a.class_name=b.class_name AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL HAVING count(*)=9")
def erosion(spark, sf):
    return R.to_pixels(R.erode(mask(spark, sf), 1))


@query("r04_inner_boundary", MASK_SQL + f", e AS (SELECT a.pair_id, a.class_name, a.y, a.x FROM m a JOIN m b ON a.pair_id=b.pair_id AND a.class_name=b.class_name AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL HAVING count(*)=9) SELECT * FROM m EXCEPT SELECT * FROM e")
def inner_boundary(spark, sf):
    return R.to_pixels(R.boundary(mask(spark, sf)))


FLOOD = """
bg AS (SELECT pair_id, class_name, y, x FROM gr, cells EXCEPT SELECT pair_id, class_name, y, x FROM {src}),
fl AS (SELECT * FROM bg WHERE y IN (0,7) OR x IN (0,7) UNION SELECT b.* FROM fl JOIN bg b ON b.pair_id=fl.pair_id AND b.class_name=fl.class_name AND abs(b.y-fl.y)+abs(b.x-fl.x)=1),
filled AS (SELECT pair_id, class_name, y, x FROM gr, cells EXCEPT SELECT * FROM fl)"""


@query("r08_fill_holes", MASK_SQL + f", {CELLS}," + FLOOD.format(src="m") + " SELECT * FROM filled")
def fill_holes(spark, sf):
    return R.to_pixels(R.fill_holes(mask(spark, sf), tiles(spark, sf), N, N))


EXTERIOR_SQL = COMP_SQL + """,
pad AS (SELECT CAST(a.v-1 AS INTEGER) AS y, CAST(b.v-1 AS INTEGER) AS x FROM range(10) a(v), range(10) b(v)),
ob AS (SELECT pair_id, class_name, component_id, pad.y, pad.x FROM csize, pad EXCEPT SELECT pair_id, class_name, component_id, y, x FROM ck),
ofl AS (SELECT * FROM ob WHERE y=-1 AND x=-1 UNION SELECT b.* FROM ofl JOIN ob b ON b.pair_id=ofl.pair_id AND b.class_name=ofl.class_name AND b.component_id=ofl.component_id AND abs(b.y-ofl.y)+abs(b.x-ofl.x)=1),
ext AS (SELECT pair_id, class_name, component_id, pad.y, pad.x FROM csize, pad EXCEPT SELECT * FROM ofl)"""


@query("r08_component_fill", EXTERIOR_SQL + f" SELECT {OWN}, count(*) AS filled_area FROM ext GROUP BY ALL")
def component_fill(spark, sf):
    lab = components(spark, sf)
    cover = lab.unionByName(R.component_holes(lab, N, N).select(*lab.columns))
    return cover.groupBy(*E.OWNER).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("filled_area"))


@query("r05_mask_pipeline", MASK_SQL + f""", {CELLS},
e1 AS (SELECT a.pair_id, a.class_name, a.y, a.x FROM m a JOIN m b ON a.pair_id=b.pair_id AND a.class_name=b.class_name AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL HAVING count(*)=9),
o1 AS (SELECT DISTINCT pair_id, class_name, c.y, c.x FROM e1 JOIN cells c ON abs(c.y-e1.y)<=1 AND abs(c.x-e1.x)<=1),
d1 AS (SELECT DISTINCT pair_id, class_name, c.y, c.x FROM o1 JOIN cells c ON abs(c.y-o1.y)<=1 AND abs(c.x-o1.x)<=1),
k1 AS (SELECT a.pair_id, a.class_name, a.y, a.x FROM d1 a JOIN d1 b ON a.pair_id=b.pair_id AND a.class_name=b.class_name AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY ALL HAVING count(*)=9),
g1 AS (SELECT DISTINCT pair_id, class_name, c.y, c.x FROM k1 JOIN cells c ON abs(c.y-k1.y)<=1 AND abs(c.x-k1.x)<=1),""" + FLOOD.format(src="g1") + "," + V.components_sql("filled", "fc", N) + """
SELECT pair_id, class_name, y, x FROM fc QUALIFY count(*) OVER (PARTITION BY pair_id, class_name, component_id) >= 10""")
def mask_pipeline(spark, sf):
    return R.to_pixels(R.clean_mask(mask(spark, sf), tiles(spark, sf), N, N, opening=1, closing=1, dilation=1, fill=True, min_area=10)).select(*R.TILE, "y", "x")


@query("r38_component_pixels", COMP_SQL + f" SELECT {OWN}, y, x FROM ck")
def component_pixels(spark, sf):
    return R.to_pixels(components(spark, sf))


@query("r12_polygon_cells", EXTERIOR_SQL + f""",
vx AS (SELECT {OWN}, v.y, v.x, count(*) AS k FROM ext, (SELECT CAST(a.v AS INTEGER) AS dy, CAST(b.v AS INTEGER) AS dx FROM range(2) a(v), range(2) b(v)) d,
  LATERAL (SELECT ext.y+d.dy AS y, ext.x+d.dx AS x) v GROUP BY ALL)
SELECT {KEY}, count(DISTINCT component_id) AS polygons, (SELECT count(*) FROM ext e WHERE e.pair_id=vx.pair_id AND e.class_name=vx.class_name)::DOUBLE AS area, count(*) FILTER (WHERE k IN (1,3)) AS vertices FROM vx GROUP BY ALL""")
def polygon_cells(spark, sf):
    """Exported cells, read back and measured: ring count, shoelace area and corner count."""
    cells = G.polygon_cells(components(spark, sf), N, N)
    rings = cells.withColumn("ring", F.explode(G.parse_cell(F.col("cell"))))
    return rings.groupBy(*R.TILE).agg(F.count(F.lit(1)).alias("polygons"), F.sum(G.ring_area(F.col("ring"))).alias("area"), F.sum(F.size("ring")).alias("vertices"))


@query("v11_polygon_cells", """SELECT p_partkey AS id, CASE p_partkey%6 WHEN 0 THEN 'fewer than three points' WHEN 1 THEN CASE WHEN p_size=0 THEN 'no area' ELSE 'self-crossing' END WHEN 2 THEN 'no area' WHEN 3 THEN 'invalid polygon JSON'
 ELSE CASE WHEN p_size=0 THEN 'no area' END END AS reason,
 CASE WHEN p_partkey%6>3 AND p_size>0 THEN round(p_size*10.0::DOUBLE,6) END AS area FROM part""")
def polygon_validation(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    cell = (
        F.when(k % 6 == 0, F.concat(F.lit("[[[0,0],["), s, F.lit(",1]]]")))
        .when(k % 6 == 1, F.concat(F.lit("[[[0,0],["), s, F.lit(",10],["), s, F.lit(",0],[0,10]]]")))
        .when(k % 6 == 2, F.concat(F.lit("[[[0,0],["), s, F.lit(",0],[1,0]]]")))
        .when(k % 6 == 3, F.lit("[[oops"))
        .when(k % 6 == 4, F.concat(F.lit("[[[0,0],["), s, F.lit(",0],["), s, F.lit(",10],[0,10]]]")))
        .otherwise(F.concat(F.lit("[[[0,0],["), s, F.lit(",0],["), s, F.lit(",10],[0,10],[0,0]]]"))))
    rows = V.table(spark, sf, "part").select(k.alias("id"), cell.alias("cell"))
    out = G.rings(rows, "cell", ["id"])
    return out.select("id", "reason", F.when(F.col("reason").isNull(), F.round(G.ring_area(F.col("ring")), 6)).alias("area"))


# --- pixel maps ---------------------------------------------------------------------

GRAD = """CASE WHEN lag({v}) OVER ({w}) IS NULL THEN lead({v}) OVER ({w})-{v} WHEN lead({v}) OVER ({w}) IS NULL THEN {v}-lag({v}) OVER ({w}) ELSE (lead({v}) OVER ({w})-lag({v}) OVER ({w}))/2 END"""
WX, WY = "PARTITION BY pair_id, y ORDER BY x", "PARTITION BY pair_id, x ORDER BY y"


def _edge(v):
    return f"sqrt(pow({GRAD.format(v=v, w=WX)},2)+pow({GRAD.format(v=v, w=WY)},2))"


def _blur(v, w):
    return f"(coalesce(lag({v}) OVER ({w}),{v})+{v}+coalesce(lead({v}) OVER ({w}),{v}))/3"


CHANGE_SQL = V.MAPS_SQL + f""",
l0 AS (SELECT *, (pre_r+pre_g+pre_b)/3 AS lp, (post_r+post_g+post_b)/3 AS lq, abs(post_r-pre_r) dr, abs(post_g-pre_g) dg, abs(post_b-pre_b) db FROM img),
l1 AS (SELECT *, (dr+dg+db)/3 AS diff, {_edge('lp')} AS ep, {_edge('lq')} AS eq, {_blur('lp', WX)} AS b1, {_blur('lq', WX)} AS b2, {_blur('(lp*lp)', WX)} AS s1, {_blur('(lq*lq)', WX)} AS s2 FROM l0),
l2 AS (SELECT *, {_blur('b1', WY)} AS m1, {_blur('b2', WY)} AS m2, {_blur('s1', WY)} AS q1, {_blur('s2', WY)} AS q2 FROM l1),
chg AS (SELECT *, greatest(0,q1-m1*m1) AS vp, greatest(0,q2-m2*m2) AS vq, abs(lq-lp) AS ld, abs(eq-ep) AS ed FROM l2),
glb AS (SELECT pair_id, avg(diff) AS gr, abs(avg(lq)-avg(lp)) AS gb, abs(stddev_pop(lq)-stddev_pop(lp)) AS gc, avg(ed) AS ge FROM chg GROUP BY 1)"""


@query("r09_edge_magnitude", "WITH " + CHANGE_SQL + " SELECT pair_id, y, x, round(ep,6) AS edge_pre, round(eq,6) AS edge_post FROM chg")
def edges(spark, sf):
    return E.change_maps(V.image_pairs(spark, sf)).select("pair_id", "y", "x", *r6("edge_pre", "edge_post"))


@query("r10_local_variance", "WITH " + CHANGE_SQL + " SELECT pair_id, y, x, round(vp,8) AS var_pre, round(vq,8) AS var_post FROM chg")
def variance(spark, sf):
    return E.change_maps(V.image_pairs(spark, sf)).select("pair_id", "y", "x", F.round("var_pre", 8).alias("var_pre"), F.round("var_post", 8).alias("var_post"))


@query("a22_global_shift", "WITH " + CHANGE_SQL + " SELECT pair_id, round(gr,6) AS global_rgb_shift, round(gb,6) AS global_brightness_shift, round(gc,6) AS global_contrast_shift, round(ge,6) AS global_edge_diff FROM glb")
def global_shift(spark, sf):
    return E.global_shift(E.change_maps(V.image_pairs(spark, sf))).select("pair_id", *r6("global_rgb_shift", "global_brightness_shift", "global_contrast_shift", "global_edge_diff"))


@query("r13_flip_average", "WITH " + V.MAPS_SQL + """
SELECT a.pair_id, a.class_name, a.y, a.x, round((a.p+b.p+c.p+d.p)/4,6) AS p FROM maps a
 JOIN maps b ON b.pair_id=a.pair_id AND b.class_name=a.class_name AND b.y=a.y AND b.x=7-a.x JOIN maps c ON c.pair_id=a.pair_id AND c.class_name=a.class_name AND c.y=7-a.y AND c.x=a.x
 JOIN maps d ON d.pair_id=a.pair_id AND d.class_name=a.class_name AND d.y=7-a.y AND d.x=7-a.x""")
def flip_average(spark, sf):
    from ..operators.maps import average_views, flip_views
    return average_views(flip_views(V.image_maps(spark, sf), N, N)).select(*R.TILE, "y", "x", *r6("p"))


@query("r13_softmax", "WITH " + V.IMAGE_SQL + """,
z AS (SELECT pair_id, y, x, exp(pre_r) a, exp(pre_g) b, exp(pre_b) c FROM img) SELECT pair_id, y, x, round(a/(a+b+c),6) AS p0, round(b/(a+b+c),6) AS p1, round(c/(a+b+c),6) AS p2 FROM z""")
def softmax(spark, sf):
    from ..operators.maps import softmax as soft
    cols = soft([F.col("pre_r"), F.col("pre_g"), F.col("pre_b")])
    return V.image_pairs(spark, sf).select("pair_id", "y", "x", *[F.round(c, 6).alias(f"p{i}") for i, c in enumerate(cols)])


@query("r14_reverse_pair", "WITH " + V.IMAGE_SQL + " SELECT pair_id, y, x, round(post_r,6) AS pre_r, round(pre_r,6) AS post_r FROM img")
def reverse_pair(spark, sf):
    from ..operators.maps import denormalise, normalise, reverse_time
    flipped = denormalise(normalise(reverse_time(V.image_pairs(spark, sf))))
    return flipped.select("pair_id", "y", "x", *r6("pre_r", "post_r"))


@query("r15_normalise", "WITH " + V.IMAGE_SQL + " SELECT pair_id, y, x, round((pre_r-0.485::DOUBLE)/0.229::DOUBLE,6) AS pre_r, round((post_g-0.456::DOUBLE)/0.224::DOUBLE,6) AS post_g FROM img")
def normalise(spark, sf):
    from ..operators.maps import normalise as norm
    return norm(V.image_pairs(spark, sf)).select("pair_id", "y", "x", *r6("pre_r", "post_g"))


CORR = "least(1,greatest(0,(pre_{c}-avg(pre_{c}) OVER w)*least(2,greatest(0.5,stddev_pop(post_{c}) OVER w/greatest(stddev_pop(pre_{c}) OVER w,0.02)))+avg(post_{c}) OVER w))"


@query("r16_radiometric_match", "WITH " + V.IMAGE_SQL + " SELECT pair_id, y, x, " + ", ".join(f"round({CORR.format(c=c)},6) AS corr_{c}" for c in "rgb") + " FROM img WINDOW w AS (PARTITION BY pair_id)")
def radiometric(spark, sf):
    return E.match_radiometry(V.image_pairs(spark, sf)).select("pair_id", "y", "x", *r6("corr_r", "corr_g", "corr_b"))


RING_SQL = COMP_SQL + f", {CELLS}, rg AS (SELECT DISTINCT {OWN}, c.y, c.x FROM ck JOIN cells c ON abs(c.y-ck.y)+abs(c.x-ck.x)<=2 EXCEPT SELECT {OWN}, y, x FROM ck)"


@query("r17_ring", RING_SQL + f" SELECT {OWN}, y, x FROM rg")
def ring(spark, sf):
    return R.to_pixels(E.surrounding_ring(components(spark, sf), 2, N, N))


# --- component features -----------------------------------------------------------------

@query("a17_geometry", COMP_SQL + f""",
g AS (SELECT {OWN}, count(*)::DOUBLE a, min(x) nx, max(x)+1 mx, min(y) ny, max(y)+1 my, avg(x) cx, avg(y) cy, var_pop(x) m20, var_pop(y) m02, covar_pop(x,y) m11 FROM ck GROUP BY ALL),
ad AS (SELECT {OWN}, count(*) AS k FROM ck JOIN ck n USING ({OWN}) WHERE (n.y=ck.y+1 AND n.x=ck.x) OR (n.x=ck.x+1 AND n.y=ck.y) GROUP BY ALL),
f AS (SELECT *, 4*a-2*coalesce(k,0) AS per, (mx-nx)::DOUBLE w, (my-ny)::DOUBLE h, sqrt(pow(m20-m02,2)+4*m11*m11) t FROM g LEFT JOIN ad USING ({OWN}))
SELECT {OWN}, a AS area, per AS perimeter, w AS bbox_width, h AS bbox_height, round(greatest(w,h)/least(w,h),6) AS aspect_ratio, round(a/(w*h),6) AS extent,
 round(cx+0.5,6) AS centroid_x, round(cy+0.5,6) AS centroid_y, round(4*sqrt((m20+m02+t)/2),5) AS major_axis, round(4*sqrt(greatest(0,(m20+m02-t)/2)),5) AS minor_axis,
 greatest(0,least(nx,ny,8-mx,8-my))::DOUBLE AS border_distance, round(per/(2*sqrt(pi()*a)),6) AS long_thin_score, round(4*pi()*a/(per*per),6) AS circularity FROM f""")
def geometry(spark, sf):
    g = E.geometry(components(spark, sf), N, N)
    return g.select(*E.OWNER, "area", "perimeter", "bbox_width", "bbox_height", *r6("aspect_ratio", "extent", "centroid_x", "centroid_y"),
                    F.round("major_axis", 5).alias("major_axis"), F.round("minor_axis", 5).alias("minor_axis"), "border_distance", *r6("long_thin_score", "circularity"))


@query("a18_hull_geometry")
def hull(spark, sf):
    return E.hull_geometry(components(spark, sf))


@query("j12_neighbour_context", COMP_SQL + f""",
s AS (SELECT {OWN}, count(*)::DOUBLE AS a, avg(x)+0.5 AS cx, avg(y)+0.5 AS cy FROM ck GROUP BY ALL),
q AS (SELECT s.*, o.a AS oa, sqrt(pow(s.cx-o.cx,2)+pow(s.cy-o.cy,2)) AS d FROM s LEFT JOIN s o ON o.pair_id=s.pair_id AND o.class_name=s.class_name AND o.component_id<>s.component_id)
SELECT {OWN}, round(coalesce(min(d),8),6) AS nearest_component_distance, coalesce(sum(CASE WHEN d<=3 THEN oa END),0)::DOUBLE AS nearby_component_area,
 round(coalesce(max(a)/median(oa),1),6) AS area_over_median_neighbor FROM q GROUP BY {OWN}""")
def neighbours(spark, sf):
    ctx = E.neighbour_context(E.geometry(components(spark, sf), N, N), image_size=N, reach=3.0)
    return ctx.select(*E.OWNER, *r6("nearest_component_distance"), "nearby_component_area", *r6("area_over_median_neighbor"))


@query("a19_confidence", COMP_SQL + f""",
v AS (SELECT {OWN}, p, row_number() OVER (PARTITION BY {OWN} ORDER BY p DESC) r, count(*) OVER (PARTITION BY {OWN}) n FROM ck JOIN maps USING (pair_id, class_name, y, x)),
a AS (SELECT {OWN}, count(*)::DOUBLE AS n, avg(p) mp, max(p) xp, median(p) dp, quantile_cont(p,0.9) q90, quantile_cont(p,0.95) q95, avg(p) FILTER (WHERE r<=ceil(0.01*n)) t1, avg(p) FILTER (WHERE r<=ceil(0.05*n)) t5, stddev_pop(p) sp FROM v GROUP BY ALL)
SELECT {OWN}, n AS component_area, round(mp,6) AS mean_probability, round(xp,6) AS max_probability, round(dp,6) AS median_probability, round(q90,6) AS p90_probability, round(q95,6) AS p95_probability,
 round(t1,6) AS top1_percent_mean, round(t5,6) AS top5_percent_mean, round(sp,6) AS confidence_std, sum(n) OVER (PARTITION BY {KEY}) AS total_class_area, (count(*) OVER (PARTITION BY {KEY}))::DOUBLE AS num_same_class_components FROM a""")
def confidence(spark, sf):
    c = E.confidence(components(spark, sf), V.image_maps(spark, sf))
    return c.select(*E.OWNER, "component_area", *r6("mean_probability", "max_probability", "median_probability", "p90_probability", "p95_probability", "top1_percent_mean", "top5_percent_mean", "confidence_std"),
                    "total_class_area", "num_same_class_components")


A21_SQL = RING_SQL.replace("WITH RECURSIVE " + V.MAPS_SQL, "WITH RECURSIVE " + CHANGE_SQL) + f""",
ins AS (SELECT ck.{OWN.replace(', ', ', ck.')}, c.* EXCLUDE (pair_id, y, x) FROM ck JOIN chg c ON c.pair_id=ck.pair_id AND c.y=ck.y AND c.x=ck.x),
hs AS (SELECT {OWN}, sum(abs(a-b)) AS hd FROM (SELECT {OWN}, k, sum(u) a, sum(w) b FROM (SELECT {OWN}, least(floor(lp*16),15) k, 1 u, 0 w FROM ins UNION ALL SELECT {OWN}, least(floor(lq*16),15), 0, 1 FROM ins) GROUP BY ALL) GROUP BY ALL),
st AS (SELECT {OWN}, count(*) n, avg(diff) d, avg(dr) dr, avg(dg) dg, avg(db) db, avg(ld) ld, avg(abs(vq-vp)) vd, avg(ed) ed, avg((ep>0.08)::INT) e1, avg((eq>0.08)::INT) e2,
 avg(2*pre_g-pre_r-pre_b) x1, avg(2*post_g-post_r-post_b) x2, avg(pre_g/greatest(pre_r+pre_g+pre_b,1e-4)) g1, avg(post_g/greatest(post_r+post_g+post_b,1e-4)) g2 FROM ins GROUP BY ALL),
rs AS (SELECT {OWN}, avg(diff) rd, avg(ed) re FROM rg JOIN chg USING (pair_id, y, x) GROUP BY ALL),
al AS (SELECT st.*, hd, coalesce(rd, gr) AS rd, coalesce(re, ge) AS re, gr, gb, gc, ge FROM st JOIN hs USING ({OWN}) LEFT JOIN rs USING ({OWN}) JOIN glb USING (pair_id))
SELECT {OWN}, round(d,6) AS rgb_diff_mean, round(dr,6) AS rgb_diff_r, round(ld,6) AS luminance_diff, round(vd,8) AS local_variance_diff, round(ed,6) AS sobel_mag_diff, round(e1,5) AS edge_density_pre, round(e2,5) AS edge_density_post,
 round(0.5*hd/n,5) AS local_hist_dist, round(rd,6) AS ring_rgb_diff_mean, round(d/greatest(rd,1e-4),6) AS rgb_ratio, round(ed/greatest(re,1e-4),6) AS sobel_ratio, round(d/greatest(gr,1e-4),6) AS local_vs_global_rgb, round(ed/greatest(ge,1e-4),6) AS local_vs_global_edge,
 CASE WHEN class_name='new_building' THEN round(greatest(0,e2-e1),5) END AS bld_edge_increase, CASE WHEN class_name='tree_removal' THEN round(greatest(0,x1-x2),6) END AS tree_exg_drop, CASE WHEN class_name='tree_removal' THEN round(greatest(0,g1-g2),6) END AS tree_green_ratio_drop FROM al"""


@query("a21_colour_evidence", A21_SQL)
def colour(spark, sf):
    c = E.colour_evidence(components(spark, sf), E.change_maps(V.image_pairs(spark, sf)), N, N, ring_radius=2)
    five = lambda n: F.round(n, 5).alias(n)
    return c.select(*E.OWNER, *r6("rgb_diff_mean", "rgb_diff_r", "luminance_diff", "sobel_mag_diff", "ring_rgb_diff_mean", "rgb_ratio", "sobel_ratio", "local_vs_global_rgb", "local_vs_global_edge", "tree_exg_drop", "tree_green_ratio_drop"),
                    F.round("local_variance_diff", 8).alias("local_variance_diff"), five("edge_density_pre"), five("edge_density_post"), five("local_hist_dist"), five("bld_edge_increase"))


def planes(spark, sf):
    """Three-channel vectors of every cell as array columns."""
    t = V.image_pairs(spark, sf).select("pair_id", "y", "x", F.array("pre_r", "pre_g", "pre_b").alias("v_pre"), F.array("post_r", "post_g", "post_b").alias("v_post"))
    return E.vector_change(t, "v_pre", "v_post")


@query("a23_change_vectors", RING_SQL + f""",
cv AS (SELECT pair_id, y, x, sqrt(pow(post_r-pre_r,2)+pow(post_g-pre_g,2)+pow(post_b-pre_b,2)) AS v, 1-(pre_r*post_r+pre_g*post_g+pre_b*post_b)/(sqrt(pre_r*pre_r+pre_g*pre_g+pre_b*pre_b)*sqrt(post_r*post_r+post_g*post_g+post_b*post_b)) AS c FROM img),
i AS (SELECT {OWN}, avg(v) a, max(v) b, stddev_pop(v) s, quantile_cont(v,0.9) q, avg(c) c FROM ck JOIN cv USING (pair_id, y, x) GROUP BY ALL),
r AS (SELECT {OWN}, avg(v) rv FROM rg JOIN cv USING (pair_id, y, x) GROUP BY ALL), w AS (SELECT pair_id, avg(v) wv FROM cv GROUP BY 1)
SELECT {OWN}, round(a,6) AS cva_mean, round(b,6) AS cva_max, round(s,6) AS cva_std, round(q,6) AS cva_p90, round(c,6) AS cva_cosine_dist, round(coalesce(rv,wv),6) AS cva_ring_mean, round(a/greatest(coalesce(rv,wv),1e-4),6) AS cva_ratio, round(a-coalesce(rv,wv),6) AS cva_diff
 FROM i LEFT JOIN r USING ({OWN}) JOIN w USING (pair_id)""")
def change_vectors(spark, sf):
    c = E.change_vector_evidence(components(spark, sf), planes(spark, sf), N, N, ring_radius=2)
    return c.select(*E.OWNER, *r6(*[n for n in c.columns if n.startswith("cva_")]))


VERIFIER_SQL = "WITH " + CHANGE_SQL + """,
cr AS (SELECT pair_id, y, x, (abs(post_r-""" + CORR.format(c="r") + ")+abs(post_g-" + CORR.format(c="g") + ")+abs(post_b-" + CORR.format(c="b") + f"""))/3 AS r FROM img WINDOW w AS (PARTITION BY pair_id)),
j AS (SELECT m.pair_id, m.class_name, m.p, m.p>=0.55::DOUBLE AS k, c.*, cr.r, 2*pre_g-pre_r-pre_b AS g1, 2*post_g-post_r-post_b AS g2 FROM maps m JOIN (SELECT * RENAME (pair_id AS pid) FROM chg) c ON c.pid=m.pair_id AND c.y=m.y AND c.x=m.x JOIN cr ON cr.pair_id=m.pair_id AND cr.y=m.y AND cr.x=m.x),
a AS (SELECT {KEY}, avg(p) pm, stddev_pop(p) ps, max(p) px, quantile_cont(p,0.9) q90, quantile_cont(p,0.99) q99, avg(k::INT) mf, avg(diff) gd, coalesce(avg(diff) FILTER (WHERE k),0) rd, avg(r) gc, coalesce(avg(r) FILTER (WHERE k),0) rc,
 coalesce(avg(lp) FILTER (WHERE k),0) l1, coalesce(avg(lq) FILTER (WHERE k),0) l2, coalesce(avg(g1-g2) FILTER (WHERE k),0) gl, coalesce(avg(ep) FILTER (WHERE k),0) e1, coalesce(avg(eq) FILTER (WHERE k),0) e2, coalesce(avg(ed) FILTER (WHERE k),0) ec, avg(ed) ge, coalesce(quantile_cont(r,0.9) FILTER (WHERE k),0) r90 FROM j GROUP BY ALL)
SELECT {KEY}, round(pm,6) AS prob_mean, round(ps,6) AS prob_std, round(px,6) AS prob_max, round(q90,6) AS prob_q90, round(q99,6) AS prob_q99, mf AS mask_fraction, round(gd,6) AS global_rgb_difference, round(rd,6) AS roi_rgb_difference,
 round(rd/greatest(gd,0.01),6) AS relative_rgb_difference, round(gc,6) AS global_corrected_difference, round(rc,6) AS roi_corrected_difference, round(rc/greatest(gc,0.01),6) AS relative_corrected_difference, round(l1,6) AS roi_luminance_before, round(l2,6) AS roi_luminance_after,
 round(gl,6) AS roi_green_loss, round(e1,6) AS roi_edge_before, round(e2,6) AS roi_edge_after, round(ec,6) AS roi_edge_change, round(ge,6) AS global_edge_change, round(r90,6) AS roi_corrected_q90 FROM a"""


def image_presence(spark, sf):
    return V.image_maps(spark, sf).groupBy(*R.TILE).agg(F.max("p").alias("presence"))


def verifier_table(spark, sf):
    return E.verifier_features(V.image_pairs(spark, sf), V.image_maps(spark, sf), image_presence(spark, sf), {c: 0.55 for c in S.CLASSES})


@query("a24_verifier_features", VERIFIER_SQL)
def verifier(spark, sf):
    names = ["prob_mean", "prob_std", "prob_max", "prob_q90", "prob_q99", "global_rgb_difference", "roi_rgb_difference", "relative_rgb_difference", "global_corrected_difference", "roi_corrected_difference",
             "relative_corrected_difference", "roi_luminance_before", "roi_luminance_after", "roi_green_loss", "roi_edge_before", "roi_edge_after", "roi_edge_change", "global_edge_change", "roi_corrected_q90"]
    return verifier_table(spark, sf).select(*R.TILE, "mask_fraction", *r6(*names))


# --- views, matching, stability ------------------------------------------------------------

def view_maps(spark, sf):
    """Three auxiliary views: every third cell is damped a little more per view."""
    v = F.explode(F.sequence(F.lit(1), F.lit(3)))
    m = V.image_maps(spark, sf).withColumn("view", v)
    damped = (F.col("y") * N + F.col("x") + F.col("view")) % 3 == 0
    return m.withColumn("p", F.when(damped, F.col("p") * (1 - 0.08 * F.col("view"))).otherwise(F.col("p")))


def view_components(spark, sf):
    keys = [*R.TILE, "view"]
    runs = R.to_runs(R.tile_partition(view_maps(spark, sf).filter("p >= 0.5"), keys), keys)
    return R.keep_large(R.label_components(runs, N, N, keys=keys), MIN_AREA, keys).select(*keys, "component_id", "y", "x0", "x1")


VIEW_SQL = COMP_SQL + f""",
vm AS (SELECT pair_id, class_name, y, x, CAST(w AS INTEGER) AS vw, CASE WHEN (y*8+x+w)%3=0 THEN p*(1-0.08::DOUBLE*w) ELSE p END AS p FROM maps, range(1,4) r(w)),
vmm AS (SELECT pair_id*10+vw AS pair_id, class_name, y, x FROM vm WHERE p>=0.5::DOUBLE),""" + V.components_sql("vmm", "vl", N) + f""",
vc AS (SELECT pair_id//10 AS pair_id, class_name, pair_id%10 AS vw, component_id AS j, y, x FROM vl QUALIFY count(*) OVER (PARTITION BY pair_id, class_name, component_id)>=3),
sa AS (SELECT {OWN}, count(*)::DOUBLE ai, avg(x) xi, avg(y) yi FROM ck GROUP BY ALL), sb AS (SELECT {KEY}, vw, j, count(*)::DOUBLE aj, avg(x) xj, avg(y) yj FROM vc GROUP BY ALL),
ov AS (SELECT {KEY}, vw, component_id, j, count(*)::DOUBLE o FROM ck JOIN vc USING (pair_id, class_name, y, x) GROUP BY ALL),
pe AS (SELECT sa.pair_id, sa.class_name, sb.vw, sa.component_id AS i, sb.j, ai, aj, coalesce(o,0) o, sqrt(pow(xi-xj,2)+pow(yi-yj,2)) AS drift FROM sa JOIN sb USING (pair_id, class_name) LEFT JOIN ov USING (pair_id, class_name, component_id, vw, j)),
ed AS (SELECT *, o/(ai+aj-o) AS iou FROM pe WHERE o/(ai+aj-o)>=0.2::DOUBLE OR (drift<=4 AND aj/ai BETWEEN 0.25 AND 4))"""


@query("j10_match_candidates", VIEW_SQL + f" SELECT {KEY}, CAST(vw AS INTEGER) AS view, i, j, round(iou,6) AS iou, round(drift,6) AS drift FROM ed")
def match_candidates(spark, sf):
    keys = [*R.TILE, "view"]
    copies = components(spark, sf).withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return K.match_candidates(copies, view_components(spark, sf), keys).select(*keys, "i", "j", *r6("iou", "drift"))


# The greedy walk is order dependent; its SQL twin is the same walk as a recursive query over ranked edges.
GREEDY_SQL = VIEW_SQL + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, vw ORDER BY -iou, drift, i, j) AS n, count(*) OVER (PARTITION BY {KEY}, vw) AS total FROM ed),
gw AS (SELECT pair_id, class_name, vw, 0::BIGINT AS n, []::BIGINT[] AS ui, []::BIGINT[] AS uj, false AS took FROM (SELECT DISTINCT pair_id, class_name, vw FROM ed)
 UNION ALL SELECT g.pair_id, g.class_name, g.vw, r.n, CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN ui ELSE list_append(ui, r.i) END,
  CASE WHEN list_contains(ui, r.i) OR list_contains(uj, r.j) THEN uj ELSE list_append(uj, r.j) END, NOT (list_contains(ui, r.i) OR list_contains(uj, r.j))
 FROM gw g JOIN rk r ON r.pair_id=g.pair_id AND r.class_name=g.class_name AND r.vw=g.vw AND r.n=g.n+1),
mt AS (SELECT rk.* FROM rk JOIN gw USING (pair_id, class_name, vw, n) WHERE took)"""


@query("j11_greedy_matching", GREEDY_SQL + f" SELECT {KEY}, CAST(vw AS INTEGER) AS view, i, j, round(iou,6) AS iou FROM mt")
def greedy(spark, sf):
    keys = [*R.TILE, "view"]
    copies = components(spark, sf).withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return K.match_components(copies, view_components(spark, sf), keys).select(*keys, "i", "j", *r6("iou"))


STABILITY_SQL = GREEDY_SQL + f""",
al AS (SELECT {KEY}, i AS component_id, aj AS a FROM mt UNION ALL SELECT {OWN}, ai FROM sa), am AS (SELECT {OWN}, avg(a) ma, stddev_pop(a) sd FROM al GROUP BY ALL),
ms AS (SELECT {KEY}, i AS component_id, count(*) k, sum(iou) su, min(iou) mn, max(iou) mx, avg(drift) d, max(drift) xd FROM mt GROUP BY ALL),
stb AS (SELECT {OWN}, ai, coalesce(k,0) k, coalesce(su,0)/3 mi, CASE WHEN k=3 THEN mn ELSE 0 END mn, coalesce(mx,0) mx, ma, sd, coalesce(d,0) d, coalesce(xd,0) xd FROM sa JOIN am USING ({OWN}) LEFT JOIN ms USING ({OWN}))"""


def stability(spark, sf):
    return K.view_stability(components(spark, sf), view_components(spark, sf), 3)


@query("a20_view_stability", STABILITY_SQL + f"""
SELECT {OWN}, k+1 AS persistence_count, round(mi,6) AS mean_matching_iou, round(mn,6) AS minimum_matching_iou, round(mx,6) AS maximum_matching_iou, round(ma,6) AS matching_area_mean, round(sd,5) AS area_std, round(sd/ma,5) AS area_cv,
 round(d,6) AS centroid_mean_drift, round(xd,6) AS centroid_max_drift FROM stb""")
def view_stability(spark, sf):
    return stability(spark, sf).select(*E.OWNER, "persistence_count", *r6("mean_matching_iou", "minimum_matching_iou", "maximum_matching_iou", "matching_area_mean"),
                                       F.round("area_std", 5).alias("area_std"), F.round("area_cv", 5).alias("area_cv"), *r6("centroid_mean_drift", "centroid_max_drift"))


# The appearance view is view 4 of the SQL: it shows less of the upper half.
APPEARANCE_SQL = GREEDY_SQL.replace("CASE WHEN (y*8+x+w)%3=0", "CASE WHEN w=4 THEN p*(CASE WHEN y<4 THEN 0.6::DOUBLE ELSE 1 END) WHEN (y*8+x+w)%3=0").replace("range(1,4)", "range(1,5)") + f""",
pm AS (SELECT {OWN}, avg(p) m, max(p) x, count(*) n FROM ck JOIN maps USING (pair_id, class_name, y, x) GROUP BY ALL),
lg AS (SELECT {KEY}, m AS lm FROM pm QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY n DESC, component_id)=1),
apm AS (SELECT {KEY}, i AS component_id, max(CASE WHEN vw=4 THEN 1 ELSE 0 END)=1 AS shown, count(*) FILTER (WHERE vw<4) AS k, coalesce(sum(iou) FILTER (WHERE vw<4),0)/3 AS mi FROM mt GROUP BY ALL),
apf AS (SELECT pm.*, lm, coalesce(shown,false) AS shown, coalesce(k,0)+1 AS c, coalesce(mi,0) AS mi FROM pm JOIN lg USING (pair_id, class_name) LEFT JOIN apm USING ({OWN}))"""


def appearance_stability(spark, sf):
    dim = V.image_maps(spark, sf).withColumn("p", F.when(F.col("y") < N // 2, F.col("p") * 0.6).otherwise(F.col("p")))
    return K.view_stability(components(spark, sf), view_components(spark, sf), 3, components(spark, sf, dim))


@query("a20_appearance_view", APPEARANCE_SQL + f" SELECT {OWN}, c AS persistence_count, round(mi,6) AS mean_matching_iou, shown AS appearance_matched, round(m,6) AS original_mean_probability, round(x,6) AS original_max_probability, round(lm,6) AS largest_confidence FROM apf")
def appearance_view(spark, sf):
    own = K.identity_confidence(components(spark, sf), V.image_maps(spark, sf))
    return appearance_stability(spark, sf).join(own, E.OWNER).select(
        *E.OWNER, "persistence_count", *r6("mean_matching_iou"), "appearance_matched", *r6("original_mean_probability", "original_max_probability", "largest_confidence"))


@query("r28_appearance_rules", APPEARANCE_SQL + f" SELECT rule, {KEY}, count(*) AS candidates, count(*) FILTER (WHERE c>=n2 AND mi>=t AND shown) AS kept FROM apf, (VALUES ('A',3,0.0),('B',4,0.0),('C',3,0.2),('D',3,0.3),('E',3,0.4)) r(rule,n2,t) GROUP BY ALL")
def appearance_rules(spark, sf):
    v = K.stability_verdicts(appearance_stability(spark, sf), appearance_consistency=True)
    return v.groupBy("rule", *R.TILE).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("keep").alias("kept"))


@query("a20_view_probabilities", VIEW_SQL + f""",
av AS (SELECT pair_id, class_name, y, x, p FROM vm UNION ALL SELECT pair_id, class_name, y, x, p FROM maps),
pp AS (SELECT {OWN}, y, x, avg(p) m, stddev_pop(p) s, count(*) FILTER (WHERE p>=0.5) k FROM ck JOIN av USING (pair_id, class_name, y, x) GROUP BY ALL)
SELECT {OWN}, round(avg(m),6) AS tta_prob_mean, round(avg(s),6) AS tta_prob_std, round(avg((k>=3)::INT),5) AS consensus_fraction FROM pp GROUP BY ALL""")
def view_probabilities(spark, sf):
    every = V.image_maps(spark, sf).unionByName(view_maps(spark, sf).drop("view"))
    return K.view_probabilities(components(spark, sf), every, 0.5).select(*E.OWNER, *r6("tta_prob_mean", "tta_prob_std"), F.round("consensus_fraction", 5).alias("consensus_fraction"))


@query("r28_stability_rules", STABILITY_SQL + f"""
SELECT rule, {KEY}, count(*) AS candidates, count(*) FILTER (WHERE k+1>=n AND mi>=t) AS kept FROM stb, (VALUES ('A',3,0.0),('B',4,0.0),('C',3,0.2),('D',3,0.3),('E',3,0.4)) r(rule,n,t) GROUP BY ALL""")
def stability_rules(spark, sf):
    v = K.stability_verdicts(stability(spark, sf))
    return v.groupBy("rule", *R.TILE).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("keep").alias("kept"))


@query("j13_reverse_match", VIEW_SQL.replace("range(1,4)", "range(2,3)") + f""",
b AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, i ORDER BY -iou, drift, j) AS n FROM ed),
q AS (SELECT {OWN}, avg(vm.p) m, max(vm.p) x, avg((vm.p>=0.5)::INT) share FROM ck JOIN vm USING (pair_id, class_name, y, x) GROUP BY ALL)
SELECT q.pair_id, q.class_name, q.component_id, round(m,6) AS reverse_mean_prob, round(q.x,6) AS reverse_max_prob, round(share,5) AS reverse_overlap_fraction, round(coalesce(iou,0),6) AS reverse_matching_iou,
 round(CASE WHEN aj IS NULL THEN 10 ELSE sa.ai/aj END,6) AS area_ratio_forward_reverse FROM q JOIN sa USING ({OWN}) LEFT JOIN b ON b.pair_id=q.pair_id AND b.class_name=q.class_name AND b.i=q.component_id AND b.n=1""")
def reverse_match(spark, sf):
    back = view_maps(spark, sf).filter("view = 2").drop("view")
    ev = K.reverse_evidence(components(spark, sf), components(spark, sf, back), back, 0.5)
    return ev.select(*E.OWNER, *r6("reverse_mean_prob", "reverse_max_prob"), F.round("reverse_overlap_fraction", 5).alias("reverse_overlap_fraction"), *r6("reverse_matching_iou", "area_ratio_forward_reverse"))


# --- pair gate features ---------------------------------------------------------------------

PAIR_SQL = "WITH " + V.CANDIDATES_SQL + """,
sc AS (SELECT *, 'pair' AS scope FROM cand UNION ALL SELECT *, CASE class_name WHEN 'new_building' THEN 'building' ELSE 'tree' END FROM cand),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id, scope ORDER BY score DESC) AS n FROM sc),
ag AS (SELECT pair_id, scope, count(*)::DOUBLE c, (count(*) FILTER (WHERE kept))::DOUBLE kc, max(score) m1, coalesce(max(score) FILTER (WHERE n=2),0) m2, avg(score) FILTER (WHERE n<=3) mk, sum(area) ta, max(area) ma, avg(area) aa, coalesce(sum(area) FILTER (WHERE kept),0) ka,
 max(stability) ms, avg(stability) ns, max(reverse) mr, avg(reverse) nr, (count(*) FILTER (WHERE confidence>=0.5))::DOUBLE hc FROM rk GROUP BY ALL),
pq AS (SELECT pair_id, max(confidence) AS q FROM cand GROUP BY 1)"""


@query("a25_pair_features", PAIR_SQL + """
SELECT p.pair_id, p.c AS pair_candidate_count, p.kc AS pair_kept_candidate_count, round(p.mk,6) AS pair_mean_top_k_score, round(p.m1-p.m2,6) AS pair_score_margin_top1_top2, round(p.ta,9) AS total_area_all_classes,
 round(p.ns,6) AS pair_mean_tta_stability, round(p.nr,6) AS pair_mean_reverse_support, coalesce(b.c,0) AS building_candidate_count, round(coalesce(b.mk,0),6) AS building_mean_top_k_score, round(coalesce(t.aa,0),9) AS tree_mean_candidate_area, coalesce(t.hc,0) AS tree_num_high_confidence_candidates,
 round(ln(least(1-1e-6,greatest(1e-6,q))/(1-least(1-1e-6,greatest(1e-6,q)))),6) AS pair_presence_logit, (coalesce(b.c,0)>0 AND coalesce(t.c,0)>0)::INT::DOUBLE AS both_classes_present, round(coalesce(b.m1,0)-coalesce(t.m1,0),6) AS building_vs_tree_score_margin
FROM ag p JOIN pq USING (pair_id) LEFT JOIN ag b ON b.pair_id=p.pair_id AND b.scope='building' LEFT JOIN ag t ON t.pair_id=p.pair_id AND t.scope='tree' WHERE p.scope='pair'""")
def pair_features(spark, sf):
    return pair_table(spark, sf).select(
        "pair_id", "pair_candidate_count", "pair_kept_candidate_count", *r6("pair_mean_top_k_score", "pair_score_margin_top1_top2"), F.round("total_area_all_classes", 9).alias("total_area_all_classes"),
        *r6("pair_mean_tta_stability", "pair_mean_reverse_support"), "building_candidate_count", *r6("building_mean_top_k_score"), F.round("tree_mean_candidate_area", 9).alias("tree_mean_candidate_area"), "tree_num_high_confidence_candidates",
        *r6("pair_presence_logit"), "both_classes_present", *r6("building_vs_tree_score_margin"))


def pair_table(spark, sf):
    c = V.candidates(spark, sf)
    heads = c.groupBy(*R.TILE).agg(F.max("confidence").alias("presence"))
    return E.pair_features(c, heads)


CELL_SQL = """WITH t AS (SELECT p_partkey AS id, unnest(['new_building','tree_removal']) AS class_name, p_size%30 AS s, p_partkey%4 AS dx, p_partkey%3 AS dy, p_partkey AS k FROM part),
g AS (SELECT *, CASE WHEN s=0 OR (class_name='tree_removal' AND k%5<>0) THEN 0 ELSE 1 END AS has_t, CASE WHEN s=0 OR k%7=0 OR (class_name='tree_removal' AND k%3=1) THEN 0 ELSE 1 END AS has_p,
 CASE WHEN class_name='tree_removal' AND k%11=0 THEN 25 ELSE 0 END AS extra FROM t),
a AS (SELECT *, has_t*s*s AS ta, has_p*s*s+extra AS pa,
 has_t*has_p*greatest(0, least(s+dx, s+1)-greatest(dx,-1))*greatest(0, least(s+dy, s+1)-greatest(dy,-1)) AS pn,
 has_t*has_p*greatest(0, least(s, s+dx+1)-greatest(0,dx-1))*greatest(0, least(s, s+dy+1)-greatest(0,dy-1)) AS tn FROM g),
r AS (SELECT class_name, ta>0 AS t, pa>=20 AS p, CASE WHEN pa>=20 AND pn>0 THEN 2*(pn/pa)*(tn/ta)/(pn/pa+tn/ta) ELSE 0 END AS f FROM a),
c AS (SELECT class_name, count(*) FILTER (WHERE t AND p) tp, count(*) FILTER (WHERE NOT t AND p) fp, count(*) FILTER (WHERE t AND NOT p) fn, count(*) FILTER (WHERE NOT t AND NOT p) tn, avg(f) FILTER (WHERE t) sh FROM r GROUP BY 1)
SELECT class_name, tp, fp, fn, tn, round((2*tp/(2*tp+fp+fn)+2*tn/(2*tn+fp+fn))/2,6) AS presence_macro_f1, round(sh,6) AS shape_score, round(((2*tp/(2*tp+fp+fn)+2*tn/(2*tn+fp+fn))/2+sh)/2,6) AS score FROM c"""


@query("a04_polygon_score", CELL_SQL)
def polygon_score(spark, sf):
    """Squares as polygon cells: moved by up to 3 by 2 pixels, open or closed, some twice over, some with a second piece."""
    k = F.col("p_partkey")
    p = V.table(spark, sf, "part").select(k, (F.col("p_size") % 30).alias("s"), (k % 4).alias("dx"), (k % 3).alias("dy"))

    def square(x, y, side, closed):
        at = lambda a, b: F.format_string("[%d,%d]", a.cast("long"), b.cast("long"))
        corners = [at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side)]
        return F.concat(F.lit("["), F.concat_ws(",", *corners, F.when(closed, corners[0])), F.lit("]"))

    ten = F.lit(10)
    truth_ring = square(ten, ten, F.col("s"), k % 2 == 0)
    moved = square(ten + F.col("dx"), ten + F.col("dy"), F.col("s"), k % 2 == 1)
    cell = lambda *rings: F.concat(F.lit("["), F.concat_ws(",", *rings), F.lit("]"))
    here, far = F.col("s") > 0, square(F.lit(200), F.lit(200), F.lit(5), F.lit(False))
    pred = here & (k % 7 != 0)
    none = F.lit("")
    truth = p.select(k.alias("id"), F.when(here, cell(truth_ring)).otherwise(none).alias("new_building"), F.when(here & (k % 5 == 0), cell(truth_ring)).otherwise(none).alias("tree_removal"))
    predictions = p.select(
        k.alias("id"), F.when(pred, cell(moved, F.when(k % 2 == 0, moved))).otherwise(F.lit("[]")).alias("new_building"),
        F.when((pred & (k % 3 != 1)) | (k % 11 == 0), cell(F.when(pred & (k % 3 != 1), moved), F.when(k % 11 == 0, far))).otherwise(none).alias("tree_removal"))
    scored = G.score_cells(predictions, truth)
    return scored.select("class_name", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("presence_macro_f1", "shape_score", "score")])
