"""Metrics slice: thresholds, runs, components, scores (lineitem tiles)."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import scoring as S
from ..operators.order_stats import order_stats, sort_groups
from . import views as V
from .registry import query

MIN_AREA, MIN_POS_AREA = 3, 5
KEY = "pair_id, class_name"

# Predicted and truth pixels after presence gate and component filter.
PRED_SQL = "WITH RECURSIVE " + V.TILE_SQL + """,
m AS (SELECT px.* FROM px JOIN pop USING (pair_id, class_name) WHERE p >= 0.5::DOUBLE AND presence >= 0.48::DOUBLE),""" + V.components_sql("m", "lab") + """,
csize AS (SELECT pair_id, class_name, component_id, count(*) AS area FROM lab GROUP BY ALL),
kept AS (SELECT lab.* FROM lab JOIN csize USING (pair_id, class_name, component_id) WHERE area >= 3),
big AS (SELECT pair_id, class_name FROM kept GROUP BY ALL HAVING count(*) >= 5),
pr AS (SELECT kept.* FROM kept JOIN big USING (pair_id, class_name)),
gt AS (SELECT pair_id, class_name, y, x FROM px WHERE truth)"""

# Areas, tolerance shape score and confusion from the relations pr, gt and pop.
MEASURE_SQL = """,
off AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1),(0),(1)) a(v), (VALUES (-1),(0),(1)) b(v)),
prg AS (SELECT DISTINCT pair_id, class_name, y+dy AS y, x+dx AS x FROM pr, off),
gtg AS (SELECT DISTINCT pair_id, class_name, y+dy AS y, x+dx AS x FROM gt, off),
sums AS (
 SELECT pair_id, class_name,
  (SELECT count(*) FROM pr WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) AS pred_area,
  (SELECT count(*) FROM gt WHERE gt.pair_id=pop.pair_id AND gt.class_name=pop.class_name) AS truth_area,
  (SELECT count(*) FROM pr JOIN gt USING (pair_id,class_name,y,x) WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) AS both_area,
  (SELECT count(*) FROM pr JOIN gtg USING (pair_id,class_name,y,x) WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) AS pg,
  (SELECT count(*) FROM gt JOIN prg USING (pair_id,class_name,y,x) WHERE gt.pair_id=pop.pair_id AND gt.class_name=pop.class_name) AS tg
 FROM pop),
pr_rates AS (SELECT *, CASE WHEN pred_area=0 THEN 0 ELSE pg/pred_area END AS prec, CASE WHEN truth_area=0 THEN 0 ELSE tg/truth_area END AS rec FROM sums),
outc AS (SELECT pair_id, class_name, pred_area, truth_area, both_area, truth_area>0 AS t, pred_area>=20 AS q,
  CASE WHEN pred_area>=20 AND prec+rec>0 THEN 2*prec*rec/(prec+rec) ELSE 0 END AS shape FROM pr_rates),
conf AS (SELECT class_name, count(*) FILTER (WHERE t AND q) tp, count(*) FILTER (WHERE NOT t AND q) fp, count(*) FILTER (WHERE t AND NOT q) fn, count(*) FILTER (WHERE NOT t AND NOT q) tn,
  count(*) FILTER (WHERE t) pos, sum(CASE WHEN t THEN shape ELSE 0 END) sh, count(*) n FROM outc GROUP BY 1),
cls AS (SELECT class_name, tp, fp, fn, tn, pos AS gt_positive_count, n AS num_samples,
  ((CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END)+(CASE WHEN 2*tn+fp+fn=0 THEN 0 ELSE 2*tn/(2*tn+fp+fn) END))/2 AS macro,
  CASE WHEN pos=0 THEN 0 ELSE sh/pos END AS shp FROM conf)"""
GROW_SQL = PRED_SQL + MEASURE_SQL

# The same over exported exteriors: every component of the prediction and of the truth with all cells that a flood from outside its
# box, through edges, doesn't reach.
_EXTERIOR = """,
{t}b AS (SELECT pair_id, class_name, component_id, min(y)-1 AS y0, max(y)+1 AS y1, min(x)-1 AS x0, max(x)+1 AS x1 FROM {s} GROUP BY ALL),
{t}o AS (SELECT pair_id, class_name, component_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, yy=y0 AND xx=x0 AS corner
  FROM (SELECT *, unnest(range(x0, x1+1)) AS xx FROM (SELECT *, unnest(range(y0, y1+1)) AS yy FROM {t}b)) box
  WHERE NOT EXISTS (SELECT 1 FROM {s} k WHERE k.pair_id=box.pair_id AND k.class_name=box.class_name AND k.component_id=box.component_id AND k.y=yy AND k.x=xx)),
{t}f AS (SELECT pair_id, class_name, component_id, y, x FROM {t}o WHERE corner UNION SELECT b.pair_id, b.class_name, b.component_id, b.y, b.x FROM {t}f f JOIN {t}o b
  ON b.pair_id=f.pair_id AND b.class_name=f.class_name AND b.component_id=f.component_id AND abs(b.y-f.y)+abs(b.x-f.x)=1),
{t} AS (SELECT DISTINCT pair_id, class_name, y, x FROM (
  SELECT pair_id, class_name, component_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x
  FROM (SELECT *, unnest(range(x0, x1+1)) AS xx FROM (SELECT *, unnest(range(y0, y1+1)) AS yy FROM {t}b))
  EXCEPT SELECT * FROM {t}f))"""


def _exterior_sql(source: str, target: str) -> str:
    return _EXTERIOR.replace("{s}", source).replace("{t}", target)


EXTERIOR_SQL = PRED_SQL + "," + V.components_sql("gt", "gl") + _exterior_sql("pr", "pe") + _exterior_sql("gl", "ge") + re.sub(r"\bgt\b", "ge", re.sub(r"\bpr\b", "pe", MEASURE_SQL))


def gated_pixels(spark, sf, threshold=0.5, presence_threshold=0.48):
    """Pixels of the class mask; the presence gate prunes tiles before the pixel test."""
    alive = V.presence(spark, sf).filter(F.col("presence") >= presence_threshold)
    return V.tile_pixels(spark, sf).filter(F.col("p") >= threshold).join(alive, R.TILE, "left_semi")


def labelled(spark, sf, connectivity=4):
    runs = R.to_runs(R.tile_partition(gated_pixels(spark, sf)))
    return R.label_components(runs, V.SIDE, V.SIDE, connectivity)


def predicted_components(spark, sf):
    return R.area_filter(labelled(spark, sf), MIN_AREA, MIN_POS_AREA).select(*R.TILE, "component_id", "y", "x0", "x1")


def predicted(spark, sf):
    return predicted_components(spark, sf).drop("component_id")


def truth(spark, sf):
    return R.to_runs(R.tile_partition(V.tile_pixels(spark, sf).filter("truth")))


def outcomes(spark, sf):
    return S.tile_outcomes(predicted(spark, sf), truth(spark, sf), V.presence(spark, sf))


def exterior_outcomes(spark, sf):
    """Outcomes of exported exteriors: both masks as components with their holes filled."""
    areas = S.exterior_areas(predicted_components(spark, sf), truth(spark, sf), V.SIDE, V.SIDE)
    return S.outcomes_of_areas(V.presence(spark, sf).join(areas, R.TILE, "left").fillna(0, S.AREAS))


@query("r01_presence_gated_mask", "WITH RECURSIVE " + V.TILE_SQL + f"""
SELECT {KEY}, y, x, round(p,6) AS p FROM px JOIN pop USING (pair_id, class_name) WHERE p >= 0.5::DOUBLE AND presence >= 0.48::DOUBLE""")
def presence_gated_mask(spark, sf):
    return gated_pixels(spark, sf).select(*R.TILE, "y", "x", F.round("p", 6).alias("p"))


@query("r07_runs", "WITH " + V.TILE_SQL + f""",
m AS (SELECT *, x-row_number() OVER (PARTITION BY {KEY}, y ORDER BY x) AS g FROM px WHERE p >= 0.5::DOUBLE)
SELECT {KEY}, y, min(x) AS x0, max(x)+1 AS x1 FROM m GROUP BY {KEY}, y, g""")
def runs(spark, sf):
    return R.to_runs(V.tile_pixels(spark, sf).filter("p >= 0.5"))


@query("r07_rectangles", "WITH " + V.TILE_SQL + f""",
m AS (SELECT *, x-row_number() OVER (PARTITION BY {KEY}, y ORDER BY x) AS g FROM px WHERE p >= 0.5::DOUBLE),
r AS (SELECT {KEY}, y, min(x) AS x0, max(x)+1 AS x1 FROM m GROUP BY {KEY}, y, g),
b AS (SELECT *, y-row_number() OVER (PARTITION BY {KEY}, x0, x1 ORDER BY y) AS k FROM r)
SELECT {KEY}, x0, x1, min(y) AS y0, max(y)+1 AS y1 FROM b GROUP BY {KEY}, x0, x1, k""")
def rectangles(spark, sf):
    return R.coalesce_rectangles(R.to_runs(V.tile_pixels(spark, sf).filter("p >= 0.5")))


@query("r06_components", PRED_SQL + f" SELECT {KEY}, component_id, area FROM csize")
def components(spark, sf):
    return R.component_areas(labelled(spark, sf))


@query("r06_components_8way", "WITH RECURSIVE " + V.TILE_SQL + """,
m AS (SELECT * FROM px WHERE p >= 0.8::DOUBLE),""" + V.components_sql("m", "lab", diagonal=True) + f"""
SELECT {KEY}, component_id, count(*) AS area FROM lab GROUP BY ALL HAVING count(*) >= 4""")
def components_8way(spark, sf):
    runs = R.to_runs(R.tile_partition(V.tile_pixels(spark, sf).filter("p >= 0.8")))
    return R.component_areas(R.label_components(runs, V.SIDE, V.SIDE, 8)).filter("area >= 4")


@query("r11_area_filters", PRED_SQL + f" SELECT {KEY}, y, x FROM pr")
def area_filters(spark, sf):
    return R.to_pixels(predicted(spark, sf))


@query("a01_presence_confusion", GROW_SQL + " SELECT class_name, tp, fp, fn, tn FROM cls")
def presence_confusion(spark, sf):
    return S.confusion(outcomes(spark, sf), ["class_name"]).select("class_name", "tp", "fp", "fn", "tn")


@query("a02_presence_macro_f1", GROW_SQL + " SELECT class_name, round(macro,6) AS presence_macro_f1 FROM cls")
def macro_f1(spark, sf):
    return S.class_scores(S.confusion(outcomes(spark, sf), ["class_name"])).select(
        "class_name", F.round("presence_macro_f1", 6).alias("presence_macro_f1"))


@query("a03_shape_f1", GROW_SQL + f" SELECT {KEY}, pred_area, truth_area, round(shape,6) AS shape FROM outc WHERE t")
def shape(spark, sf):
    return outcomes(spark, sf).filter("truth_positive").select(*R.TILE, "pred_area", "truth_area", F.round("shape", 6).alias("shape"))


@query("a04_final_score", EXTERIOR_SQL + """
SELECT round(avg((macro+shp)/2),6) AS score, max(num_samples) AS num_samples,
 round(max(CASE WHEN class_name='new_building' THEN (macro+shp)/2 END),6) AS building_score,
 round(max(CASE WHEN class_name='tree_removal' THEN (macro+shp)/2 END),6) AS tree_score,
 CAST(sum(gt_positive_count) AS BIGINT) AS gt_positive_count FROM cls""")
def final_score(spark, sf):
    report = S.final_score(S.class_scores(S.confusion(exterior_outcomes(spark, sf), ["class_name"])))
    b, t = F.col("classes")["new_building"], F.col("classes")["tree_removal"]
    return report.select(
        F.round("score", 6).alias("score"), "num_samples",
        F.round(b["score"], 6).alias("building_score"), F.round(t["score"], 6).alias("tree_score"),
        (b["gt_positive_count"] + t["gt_positive_count"]).alias("gt_positive_count"))


QUIET_SQL = GROW_SQL.replace("WHERE truth)", "WHERE truth AND pair_id%3<>0)")


@query("a05_no_change_false_positives", QUIET_SQL + """,
tiles AS (SELECT pair_id, bool_or(t) c, bool_or(q) a, bool_or(q AND class_name='new_building') ba, bool_or(q AND class_name='tree_removal') ta FROM outc GROUP BY 1)
SELECT count(*) FILTER (WHERE NOT c) AS no_change_count, count(*) FILTER (WHERE NOT c AND a) AS no_change_fp_any, count(*) FILTER (WHERE NOT c AND ba) AS new_building_fp,
 count(*) FILTER (WHERE NOT c AND ta) AS tree_removal_fp, count(*) FILTER (WHERE a) AS predicted_positive_samples,
 round(count(*) FILTER (WHERE NOT c AND a)/greatest(count(*) FILTER (WHERE NOT c),1),6) AS no_change_fp_rate FROM tiles""")
def no_change(spark, sf):
    """Every third tile is defined to hold no true change."""
    quiet = S.tile_outcomes(predicted(spark, sf), truth(spark, sf).filter("pair_id % 3 <> 0"), V.presence(spark, sf))
    return S.no_change_counts(quiet).withColumn("no_change_fp_rate", F.round("no_change_fp_rate", 6))


@query("a06_binary_overlap", PRED_SQL + """,
c AS (SELECT (SELECT count(*) FROM pr JOIN gt USING (pair_id,class_name,y,x)) tp, (SELECT count(*) FROM pr) np, (SELECT count(*) FROM gt) ng, (SELECT count(*)*1024 FROM pop) n),
k AS (SELECT tp, np-tp AS fp, ng-tp AS fn, n-np-ng+tp AS tn FROM c)
SELECT tp, fp, fn, tn, round(tp/(tp+fp+fn),6) AS iou, round(2*tp/(2*tp+fp+fn),6) AS dice, round(2*tp/(2*tp+fp+fn),6) AS f1,
 round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy FROM k""")
def binary_overlap(spark, sf):
    out = S.binary_overlap(predicted(spark, sf), truth(spark, sf), V.presence(spark, sf), V.SIDE * V.SIDE)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("iou", "dice", "f1", "precision", "recall", "accuracy")])


LABEL_SQL = "WITH " + V.TILE_SQL + """,
w AS (SELECT pair_id, y, x, max(CASE WHEN class_name='new_building' THEN p ELSE 0 END) b, max(CASE WHEN class_name='tree_removal' THEN p ELSE 0 END) t,
 bool_or(truth AND class_name='new_building') tb, bool_or(truth AND class_name='tree_removal') tt FROM px GROUP BY ALL),
lbl AS (SELECT pair_id, y, x, CASE WHEN 0.5::DOUBLE>=b AND 0.5::DOUBLE>=t THEN 0 WHEN b>=t THEN 1 ELSE 2 END AS pred,
 CASE WHEN tb AND tt THEN -100 WHEN tb THEN 1 WHEN tt THEN 2 ELSE 0 END AS truth FROM w)"""


def exclusive_labels(spark, sf):
    """Exclusive labels per covered cell: background has probability 0.5, ties go to the lower label."""
    b, t = [F.max(F.when(F.col("class_name") == c, F.col("p")).otherwise(0.0)) for c in S.CLASSES]
    tb, tt = [F.bool_or((F.col("class_name") == c) & F.col("truth")) for c in S.CLASSES]
    wide = V.tile_pixels(spark, sf).groupBy("pair_id", "y", "x").agg(b.alias("b"), t.alias("t"), tb.alias("tb"), tt.alias("tt"))
    best = F.array_max(F.array(
        F.struct(F.lit(0.5).alias("p"), F.lit(0).alias("k")), F.struct(F.col("b").alias("p"), F.lit(-1).alias("k")),
        F.struct(F.col("t").alias("p"), F.lit(-2).alias("k"))))
    return wide.select(
        "pair_id", "y", "x", (-best["k"]).alias("pred"),
        F.when(F.col("tb") & F.col("tt"), -100).when(F.col("tb"), 1).when(F.col("tt"), 2).otherwise(0).alias("truth"))


@query("w01_exclusive_argmax", LABEL_SQL + " SELECT pair_id, y, x, pred FROM lbl")
def argmax(spark, sf):
    return exclusive_labels(spark, sf).select("pair_id", "y", "x", "pred")


@query("a07_multiclass_confusion", LABEL_SQL + """,
g AS (SELECT a.v AS truth, b.v AS pred FROM range(3) a(v), range(3) b(v)),
mx AS (SELECT g.truth, g.pred, count(lbl.pair_id) AS n FROM g LEFT JOIN lbl ON lbl.truth=g.truth AND lbl.pred=g.pred GROUP BY ALL),
k AS (SELECT l.v AS label, (SELECT n FROM mx WHERE truth=l.v AND pred=l.v) tp, (SELECT sum(n) FROM mx WHERE pred=l.v) pc, (SELECT sum(n) FROM mx WHERE truth=l.v) tc, (SELECT sum(n) FROM mx) tot FROM range(3) l(v))
SELECT CAST(label AS INTEGER) AS label, tp, CAST(pc-tp AS BIGINT) AS fp, CAST(tc-tp AS BIGINT) AS fn, CAST(tot-pc-tc+tp AS BIGINT) AS tn,
 round(tp/(pc+tc-tp),6) AS iou, round(2*tp/(pc+tc),6) AS f1, round(avg(tp/(pc+tc-tp)) OVER (),6) AS macro_iou, round(avg(2*tp/(pc+tc)) OVER (),6) AS macro_f1 FROM k""")
def multiclass(spark, sf):
    per = S.multiclass_metrics(S.label_confusion(exclusive_labels(spark, sf), 3, ignore=-100), 3)
    every = S._everything()
    return per.select(
        "label", "tp", "fp", "fn", "tn", F.round("iou", 6).alias("iou"), F.round("f1", 6).alias("f1"),
        F.round(F.avg("iou").over(every), 6).alias("macro_iou"), F.round(F.avg("f1").over(every), 6).alias("macro_f1"))


BOUNDARY_SQL = PRED_SQL + """,
o8 AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1),(0),(1)) a(v), (VALUES (-1),(0),(1)) b(v)),
o5 AS (SELECT * FROM o8 WHERE dy*dy+dx*dx<=1),
pc AS (SELECT pr.pair_id, pr.class_name, pr.y, pr.x FROM pr, o8 JOIN pr n ON n.pair_id=pr.pair_id AND n.class_name=pr.class_name AND n.y=pr.y+dy AND n.x=pr.x+dx GROUP BY ALL HAVING count(*)=9),
gc AS (SELECT gt.pair_id, gt.class_name, gt.y, gt.x FROM gt, o8 JOIN gt n ON n.pair_id=gt.pair_id AND n.class_name=gt.class_name AND n.y=gt.y+dy AND n.x=gt.x+dx GROUP BY ALL HAVING count(*)=9),
pb AS (SELECT pair_id, class_name, y, x FROM pr EXCEPT SELECT * FROM pc),
gb AS (SELECT pair_id, class_name, y, x FROM gt EXCEPT SELECT * FROM gc),
pm AS (SELECT DISTINCT pb.* FROM pb, o5 JOIN gb n ON n.pair_id=pb.pair_id AND n.class_name=pb.class_name AND n.y=pb.y+dy AND n.x=pb.x+dx),
gm AS (SELECT DISTINCT gb.* FROM gb, o5 JOIN pb n ON n.pair_id=gb.pair_id AND n.class_name=gb.class_name AND n.y=gb.y+dy AND n.x=gb.x+dx)"""


@query("j19_boundary_matching", BOUNDARY_SQL + f""",
u AS (SELECT {KEY}, 1 a, 0 b, 0 c, 0 d FROM pb UNION ALL SELECT {KEY},0,1,0,0 FROM gb UNION ALL SELECT {KEY},0,0,1,0 FROM pm UNION ALL SELECT {KEY},0,0,0,1 FROM gm)
SELECT {KEY}, CAST(sum(a) AS BIGINT) AS predicted_boundary_pixels, CAST(sum(b) AS BIGINT) AS gt_boundary_pixels,
 CAST(sum(c) AS BIGINT) AS matched_predicted_boundary_pixels, CAST(sum(d) AS BIGINT) AS matched_gt_boundary_pixels FROM u GROUP BY ALL""")
def boundary_matching(spark, sf):
    return S.boundary_counts(predicted(spark, sf), truth(spark, sf))


@query("a08_boundary_metrics", BOUNDARY_SQL + """,
t AS (SELECT (SELECT count(*) FROM pm)/(SELECT count(*) FROM pb) AS p, (SELECT count(*) FROM gm)/(SELECT count(*) FROM gb) AS r)
SELECT round(p,6) AS precision, round(r,6) AS recall, round(2*p*r/(p+r),6) AS f1 FROM t""")
def boundary_metrics(spark, sf):
    counts = S.boundary_counts(predicted(spark, sf), truth(spark, sf))
    pooled = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c.endswith("pixels")])
    return S.boundary_scores(pooled).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


LABEL_NAMES = ["background", "new_building", "tree_removal", "unused"]
MULTI_SQL = PRED_SQL + """,
fr AS (SELECT DISTINCT pair_id, y, x FROM (SELECT DISTINCT pair_id FROM pop), range(0,32) a(y), range(0,32) b(x)),
lp AS (SELECT fr.*, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.pair_id=fr.pair_id AND pr.y=fr.y AND pr.x=fr.x AND class_name='tree_removal') THEN 'tree_removal'
 WHEN EXISTS (SELECT 1 FROM pr WHERE pr.pair_id=fr.pair_id AND pr.y=fr.y AND pr.x=fr.x AND class_name='new_building') THEN 'new_building' ELSE 'background' END AS label FROM fr),
lt AS (SELECT fr.*, CASE WHEN EXISTS (SELECT 1 FROM gt WHERE gt.pair_id=fr.pair_id AND gt.y=fr.y AND gt.x=fr.x AND class_name='tree_removal') THEN 'tree_removal'
 WHEN EXISTS (SELECT 1 FROM gt WHERE gt.pair_id=fr.pair_id AND gt.y=fr.y AND gt.x=fr.x AND class_name='new_building') THEN 'new_building' ELSE 'background' END AS label FROM fr),
d8 AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1),(0),(1)) a(v), (VALUES (-1),(0),(1)) b(v)),
d5 AS (SELECT * FROM d8 WHERE dy*dy+dx*dx<=1),
bp AS (SELECT * FROM lp EXCEPT SELECT m.pair_id, m.y, m.x, m.label FROM lp m, d8 JOIN lp n ON n.pair_id=m.pair_id AND n.label=m.label AND n.y=m.y+dy AND n.x=m.x+dx GROUP BY ALL HAVING count(*)=9),
bt AS (SELECT * FROM lt EXCEPT SELECT m.pair_id, m.y, m.x, m.label FROM lt m, d8 JOIN lt n ON n.pair_id=m.pair_id AND n.label=m.label AND n.y=m.y+dy AND n.x=m.x+dx GROUP BY ALL HAVING count(*)=9),
mp AS (SELECT DISTINCT bp.* FROM bp, d5 JOIN bt n ON n.pair_id=bp.pair_id AND n.label=bp.label AND n.y=bp.y+dy AND n.x=bp.x+dx),
mt AS (SELECT DISTINCT bt.* FROM bt, d5 JOIN bp n ON n.pair_id=bt.pair_id AND n.label=bt.label AND n.y=bt.y+dy AND n.x=bt.x+dx),
kk AS (SELECT c AS label, (SELECT count(*) FROM mp WHERE label=c) a, (SELECT count(*) FROM bp WHERE label=c) b, (SELECT count(*) FROM mt WHERE label=c) d, (SELECT count(*) FROM bt WHERE label=c) e
 FROM (VALUES ('background'),('new_building'),('tree_removal'),('unused')) v(c)),
rr AS (SELECT label, CASE WHEN b=0 THEN 0 ELSE a/b END AS p, CASE WHEN e=0 THEN 0 ELSE d/e END AS r FROM kk),
ff AS (SELECT *, CASE WHEN p+r=0 THEN 0 ELSE 2*p*r/(p+r) END AS f FROM rr)"""


@query("a09_multiclass_boundary", MULTI_SQL + " SELECT label, round(p,6) AS precision, round(r,6) AS recall, round(f,6) AS f1, round(avg(f) OVER (),6) AS macro_f1 FROM ff")
def multiclass_boundary(spark, sf):
    """Four labels, of which one is never used: it counts in the macro score all the same."""
    tiles = V.presence(spark, sf).select("pair_id").distinct()
    found = S.mask_boundary(predicted(spark, sf), truth(spark, sf), S.CLASSES, tiles, V.SIDE, V.SIDE, LABEL_NAMES)
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")])


@query("a37_sample_errors", PRED_SQL + f""",
s AS (SELECT pop.pair_id, pop.class_name, (SELECT count(*) FROM pr WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) pa,
 (SELECT count(*) FROM gt WHERE gt.pair_id=pop.pair_id AND gt.class_name=pop.class_name) ta,
 (SELECT count(*) FROM pr JOIN gt USING (pair_id,class_name,y,x) WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) ba,
 (SELECT count(DISTINCT component_id) FROM pr WHERE pr.pair_id=pop.pair_id AND pr.class_name=pop.class_name) nc FROM pop),
c AS (SELECT {KEY}, avg(p) mp, quantile_cont(p, 0.95) qp FROM px GROUP BY ALL)
SELECT {KEY}, pa AS prediction_area, ta AS gt_area, nc AS polygon_count, round(CASE WHEN pa+ta-ba=0 THEN 1 ELSE ba/(pa+ta-ba) END,6) AS iou,
 round(mp,6) AS mean_confidence, round(qp,6) AS p95_confidence, ta=0 AND pa>=20 AS fp, ta>0 AND pa<20 AS fn FROM s JOIN c USING (pair_id, class_name)""")
def sample_errors(spark, sf):
    kept = R.area_filter(labelled(spark, sf), MIN_AREA, MIN_POS_AREA)
    out = S.tile_outcomes(kept, truth(spark, sf), V.presence(spark, sf))
    pieces = kept.groupBy(*R.TILE).agg(F.countDistinct("component_id").alias("polygon_count"))
    px = sort_groups(V.tile_pixels(spark, sf), R.TILE, "p", ["y", "x"])
    conf = px.groupBy(*R.TILE).agg(F.avg("p").alias("m")).join(order_stats(px, R.TILE, "p", {"q": 0.95}), R.TILE)
    union = F.col("pred_area") + F.col("truth_area") - F.col("both_area")
    return out.join(conf, R.TILE).join(pieces, R.TILE, "left").select(
        *R.TILE, F.col("pred_area").alias("prediction_area"), F.col("truth_area").alias("gt_area"),
        F.coalesce("polygon_count", F.lit(0).cast("long")).alias("polygon_count"),
        F.round(F.when(union == 0, 1.0).otherwise(F.col("both_area") / union), 6).alias("iou"),
        F.round("m", 6).alias("mean_confidence"), F.round("q", 6).alias("p95_confidence"),
        (~F.col("truth_positive") & F.col("pred_positive")).alias("fp"),
        (F.col("truth_positive") & ~F.col("pred_positive")).alias("fn"))
