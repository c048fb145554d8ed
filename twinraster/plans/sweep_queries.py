"""Sweeps, selections, gates and metric logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from ..operators import folds
from ..operators import maps as M
from ..operators import ordering as O
from ..operators import runs as R
from ..operators import scoring as S
from ..operators import sweep as W
from ..session import cut, scratch_path
from . import evidence_queries as EQ
from . import scoring_queries as Q
from . import views as V
from .registry import query

PIXELS, HEADS = [0.4, 0.6, 0.8], [0.46, 0.5, 0.54]
KEY = "pair_id, class_name"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def quiet_truth(spark, sf):
    """Truth runs with every third tile declared free of change."""
    return Q.truth(spark, sf).filter("pair_id % 3 <> 0")


def grid_outcomes(spark, sf):
    return W.pixel_grid_outcomes(placed_pixels(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), PIXELS, V.SIDE, V.SIDE, 3, 5)


# Outcomes for several masks at once: tiles of different masks get different pair ids.
def outcome_sql(mask_select: str, pop_select: str, lo="3", pos="5") -> str:
    return f"""
mk AS ({mask_select}),""" + V.components_sql("mk", "lab") + f""",
pp AS ({pop_select}),
kp AS (SELECT lab.* FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, class_name, component_id) AS area FROM lab) lab JOIN pp USING (pair_id, class_name) WHERE area >= {lo}),
prd AS (SELECT kp.* FROM (SELECT *, count(*) OVER (PARTITION BY pair_id, class_name) AS tot FROM kp) kp JOIN pp USING (pair_id, class_name) WHERE tot >= {pos}),
gt AS (SELECT pp.pair_id, pp.class_name, y, x FROM px JOIN pp ON pp.tile=px.pair_id AND pp.class_name=px.class_name WHERE truth AND px.pair_id%3<>0),
off AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1),(0),(1)) a(v), (VALUES (-1),(0),(1)) b(v)),
prg AS (SELECT DISTINCT pair_id, class_name, y+dy AS y, x+dx AS x FROM prd, off), gtg AS (SELECT DISTINCT pair_id, class_name, y+dy AS y, x+dx AS x FROM gt, off),
c1 AS (SELECT {KEY}, count(*) AS pa, count(DISTINCT component_id) AS np FROM prd GROUP BY ALL), c2 AS (SELECT {KEY}, count(*) AS ta FROM gt GROUP BY ALL),
c3 AS (SELECT {KEY}, count(*) AS pg FROM prd JOIN gtg USING (pair_id, class_name, y, x) GROUP BY ALL), c4 AS (SELECT {KEY}, count(*) AS tg FROM gt JOIN prg USING (pair_id, class_name, y, x) GROUP BY ALL),
oc AS (SELECT pp.*, coalesce(pa,0) pa, coalesce(np,0) np, coalesce(ta,0)>0 AS t, coalesce(pa,0)>=20 AS q, CASE WHEN pa>=20 AND coalesce(pg,0)+coalesce(tg,0)>0 THEN 2*(coalesce(pg,0)/pa)*(coalesce(tg,0)/ta)/((coalesce(pg,0)/pa)+(coalesce(tg,0)/ta)) ELSE 0 END AS shape
 FROM pp LEFT JOIN c1 USING (pair_id, class_name) LEFT JOIN c2 USING (pair_id, class_name) LEFT JOIN c3 USING (pair_id, class_name) LEFT JOIN c4 USING (pair_id, class_name))"""


F1 = "(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END + CASE WHEN 2*tn+fp+fn=0 THEN 0 ELSE 2*tn/(2*tn+fp+fn) END)/2"
GRID_SQL = "WITH RECURSIVE " + V.TILE_SQL + ", pg AS (SELECT k, v FROM (VALUES (0,0.4::DOUBLE),(1,0.6::DOUBLE),(2,0.8::DOUBLE)) g(k,v))," + outcome_sql(
    "SELECT px.pair_id*10+k AS pair_id, class_name, y, x FROM px JOIN pg ON p>=v",
    "SELECT pair_id*10+k AS pair_id, pair_id AS tile, class_name, presence, v AS pixel FROM pop, pg") + f""",
qt AS (SELECT *, NOT bool_or(t) OVER (PARTITION BY pair_id) AS quiet FROM oc),
hd AS (SELECT * FROM (VALUES (0.46::DOUBLE),(0.5::DOUBLE),(0.54::DOUBLE),(NULL)) h(head)),
fl AS (SELECT qt.*, head, q AND (head IS NULL OR qt.presence>=head) AS f FROM qt, hd),
st AS (SELECT class_name, pixel, head, count(*) FILTER (WHERE t AND f) tp, count(*) FILTER (WHERE NOT t AND f) fp, count(*) FILTER (WHERE t AND NOT f) fn, count(*) FILTER (WHERE NOT t AND NOT f) tn,
 count(*) FILTER (WHERE t) gp, coalesce(sum(shape) FILTER (WHERE t AND f),0) sh, count(*) FILTER (WHERE quiet AND f) qf, count(*) FILTER (WHERE quiet) qc FROM fl GROUP BY ALL),
sc AS (SELECT *, {F1} AS mf, CASE WHEN gp=0 THEN 0 ELSE sh/gp END AS ss FROM st)"""


@query("a16_presence_grid", GRID_SQL + " SELECT class_name, pixel, head AS presence, tp, fp, fn, tn, gp AS gt_positive_count, qf AS no_change_fp_count, qc AS no_change_count, round(mf,6) AS presence_macro_f1, round(ss,6) AS shape_score FROM sc")
def presence_grid(spark, sf):
    s = W.presence_statistics(grid_outcomes(spark, sf), HEADS)
    return s.select("class_name", "pixel", "presence", "tp", "fp", "fn", "tn", "gt_positive_count", "no_change_fp_count", "no_change_count", *r6("presence_macro_f1", "shape_score"))


PLATEAU_SQL = GRID_SQL + """,
g AS (SELECT class_name, pixel, head, (mf+ss)/2 AS u, qf, round(pixel*5) AS j, CASE WHEN head IS NULL THEN -9 ELSE round(head*25) END AS k FROM sc),
nb AS (SELECT a.class_name, a.j, a.k, min(b.u) nmin, avg(b.u) nmean FROM g a JOIN g b ON a.class_name=b.class_name AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1 GROUP BY ALL),
rk AS (SELECT g.*, nmin, nmean, row_number() OVER (PARTITION BY class_name ORDER BY round(nmin,12) DESC, round(nmean,12) DESC, round(u,12) DESC, qf, (head IS NULL) DESC, pixel) AS n
 FROM (SELECT *, max(u) OVER (PARTITION BY class_name) AS mu FROM g) g JOIN nb USING (class_name, j, k) WHERE u>=mu-0.01)"""


@query("w04_plateau", PLATEAU_SQL + " SELECT class_name, head AS presence, pixel, round(u,6) AS utility, round(nmin,6) AS neighbor_min, round(nmean,6) AS neighbor_mean FROM rk WHERE n=1")
def plateau(spark, sf):
    s = W.presence_statistics(grid_outcomes(spark, sf), HEADS)
    trials = s.select("class_name", "presence", "pixel", F.col("score").alias("utility"), "score", "no_change_fp_count")
    return W.select_plateau(cut(trials), HEADS, PIXELS).select("class_name", "presence", "pixel", *r6("utility", "neighbor_min", "neighbor_mean"))


@query("j20_grid_neighbours", PLATEAU_SQL + " SELECT class_name, head AS presence, pixel, round(nmin,6) AS neighbor_min, round(nmean,6) AS neighbor_mean FROM g JOIN nb USING (class_name, j, k)")
def grid_neighbours(spark, sf):
    """A margin above every utility keeps the whole grid; each cell is its own class."""
    s = cut(W.presence_statistics(grid_outcomes(spark, sf), HEADS).select("class_name", "presence", "pixel", F.col("score").alias("u")))
    step = lambda df: df.withColumn("j", F.round(F.col("pixel") * 5).cast("int")).withColumn("k", F.coalesce(F.round(F.col("presence") * 25).cast("int"), F.lit(-9)))
    cells = step(s)
    spread = cells.select("class_name", F.explode(F.sequence(F.col("j") - 1, F.col("j") + 1)).alias("j"), "k", "u")
    spread = spread.select("class_name", "j", F.explode(F.sequence(F.col("k") - 1, F.col("k") + 1)).alias("k"), "u")
    near = spread.groupBy("class_name", "j", "k").agg(F.min("u").alias("neighbor_min"), F.avg("u").alias("neighbor_mean"))
    return cells.join(near, ["class_name", "j", "k"]).select("class_name", "presence", "pixel", *r6("neighbor_min", "neighbor_mean"))


# --- exclusive trials ------------------------------------------------------------------

def tile_rows(spark, sf, *names):
    """Line items placed by tile, so that what follows per tile needs no further exchange."""
    return R.tile_partition(V.table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_partkey", "l_orderkey", *names).withColumnRenamed("l_suppkey", "pair_id"), ["pair_id"])


def tile_cell():
    return [(F.col("l_partkey") % V.SIDE).cast("int").alias("y"), (F.col("l_orderkey") % V.SIDE).cast("int").alias("x")]


def wide_maps(spark, sf):
    """The maps of ``V.tile_pixels`` with a column per class."""
    p = [F.max(F.when(c, F.col("l_discount") + 0.0).otherwise(0.0)) * 10.0 for c in (F.col("l_linestatus").eqNullSafe("O"), ~F.col("l_linestatus").eqNullSafe("O"))]
    w = tile_rows(spark, sf, "l_discount").groupBy("pair_id", *tile_cell()).agg(p[0].alias("p1"), p[1].alias("p2"))
    return w.withColumn("p0", 1 - F.greatest("p1", "p2"))


def tile_class():
    return F.when(F.col("l_linestatus") == "O", S.CLASSES[0]).otherwise(S.CLASSES[1]).alias("class_name")


def placed_pixels(spark, sf):
    """The maps of ``V.tile_pixels`` placed by tile."""
    return tile_rows(spark, sf, "l_discount").groupBy("pair_id", tile_class(), *tile_cell()).agg((F.max(F.col("l_discount") + 0.0) * 10.0).alias("p"))


def placed_truth(spark, sf):
    """``quiet_truth`` placed by tile."""
    rows = tile_rows(spark, sf, "l_returnflag").filter("pair_id % 3 <> 0")
    return R.to_runs(rows.groupBy("pair_id", tile_class(), *tile_cell()).agg((F.max("l_returnflag") == "R").alias("truth")).filter("truth"))


WIDE_SQL = V.TILE_SQL + """,
wd AS (SELECT pair_id, y, x, max(CASE WHEN class_name='new_building' THEN p ELSE 0 END) p1, max(CASE WHEN class_name='tree_removal' THEN p ELSE 0 END) p2 FROM px GROUP BY ALL),
wp AS (SELECT *, 1-greatest(p1,p2) AS p0 FROM wd)"""


def exclusive_sql(settings: str) -> str:
    """``settings`` is a VALUES list (trial, b_threshold, t_threshold, b_area, t_area, b_pos, t_pos)."""
    return "WITH RECURSIVE " + WIDE_SQL + f""",
tr AS (SELECT * FROM (VALUES {settings}) v(trial, bt, tt, ba, ta, bp, tp)),
e AS (SELECT pair_id, y, x, trial, p0, CASE WHEN p1>=bt::DOUBLE THEN p1 ELSE -1 END a, CASE WHEN p2>=tt::DOUBLE THEN p2 ELSE -1 END b FROM wp, tr),
lb AS (SELECT *, CASE WHEN p0>=a AND p0>=b THEN 0 WHEN a>=b THEN 1 ELSE 2 END AS label FROM e),""" + outcome_sql(
        "SELECT pair_id*1000+trial AS pair_id, CASE label WHEN 1 THEN 'new_building' ELSE 'tree_removal' END AS class_name, y, x FROM lb WHERE label>0",
        "SELECT pair_id*1000+trial AS pair_id, pair_id AS tile, class_name, trial, CASE class_name WHEN 'new_building' THEN ba ELSE ta END AS lo, CASE class_name WHEN 'new_building' THEN bp ELSE tp END AS pos FROM pop, tr", "lo", "pos") + f""",
st AS (SELECT trial, class_name, count(*) FILTER (WHERE t AND q) tp, count(*) FILTER (WHERE NOT t AND q) fp, count(*) FILTER (WHERE t AND NOT q) fn, count(*) FILTER (WHERE NOT t AND NOT q) tn, count(*) FILTER (WHERE t) gp,
 coalesce(sum(shape) FILTER (WHERE t),0) sh, avg(pa) aa, avg(np) an, count(*) FILTER (WHERE q) ps FROM oc GROUP BY ALL),
sc AS (SELECT *, {F1} AS mf, CASE WHEN gp=0 THEN 0 ELSE sh/gp END AS ss FROM st),
tl AS (SELECT trial, tile, bool_or(t) c, bool_or(q) f FROM oc GROUP BY ALL),
nc AS (SELECT trial, count(*) FILTER (WHERE NOT c) nn, count(*) FILTER (WHERE NOT c AND f) nf FROM tl GROUP BY 1),
sm AS (SELECT sc.trial, avg((mf+ss)/2) AS overall, sum(fn) AS fn, sum(ss) AS shp, max(nf) AS nf, max(nn) AS nn, max(nf)/greatest(max(nn),1) AS rate, max(CASE WHEN class_name='new_building' THEN tp END) AS btp, max(CASE WHEN class_name='tree_removal' THEN an END) AS tan FROM sc JOIN nc USING (trial) GROUP BY sc.trial)"""


TRIALS = [W.trial(i, {"threshold": b, "min_area": 2, "min_pos_area": 5}, {"threshold": t, "min_area": 2, "min_pos_area": 5}) for i, (b, t) in enumerate((b, t) for b in (0.5, 0.7, 0.9) for t in (0.5, 0.7, 0.9))]


def values(trials):
    return ",".join(f"({t['trial_id']},{t['b_threshold']},{t['t_threshold']},{t['b_min_area']},{t['t_min_area']},{t['b_min_pos_area']},{t['t_min_pos_area']})" for t in trials)


def evaluator(spark, sf):
    def run(trials):
        out = W.trial_outcomes(wide_maps(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), trials, V.SIDE, V.SIDE)
        return W.with_settings(W.trial_summary(out), trials)
    return run


@query("r02_threshold_competition", "WITH " + WIDE_SQL + """,
e AS (SELECT *, CASE WHEN p1>=0.6::DOUBLE THEN p1 ELSE -1 END a, CASE WHEN p2>=0.7::DOUBLE THEN p2 ELSE -1 END b FROM wp) SELECT pair_id, y, x, CASE WHEN p0>=a AND p0>=b THEN 0 WHEN a>=b THEN 1 ELSE 2 END AS label FROM e""")
def competition(spark, sf):
    return wide_maps(spark, sf).select("pair_id", "y", "x", W.threshold_labels(F.col("p0"), F.col("p1"), F.col("p2"), F.lit(0.6), F.lit(0.7)).alias("label"))


@query("a15_trial_summary", exclusive_sql(values(TRIALS)) + """
SELECT trial AS trial_id, round(overall,6) AS overall, CAST(fn AS BIGINT) AS fn, nf AS no_change_fp_any, nn AS no_change_count, btp AS new_building_tp, round(tan,6) AS tree_average_polygons FROM sm""")
def trial_summary(spark, sf):
    s = evaluator(spark, sf)(TRIALS)
    return s.select("trial_id", *r6("overall"), (F.col("new_building_fn") + F.col("tree_removal_fn")).alias("fn"), "no_change_fp_any", "no_change_count", "new_building_tp", F.round("tree_removal_average_polygons", 6).alias("tree_average_polygons"))


@query("w03_preset_ranking", exclusive_sql(values(TRIALS)) + """
SELECT (SELECT trial FROM sm ORDER BY fn, rate, round(overall,12) DESC, trial LIMIT 1) AS conservative, (SELECT trial FROM sm ORDER BY fn, (rate<=0.3) DESC, round(overall,12) DESC, rate, trial LIMIT 1) AS balanced,
 (SELECT trial FROM sm ORDER BY fn, round(overall,12) DESC, round(shp,12) DESC, rate, trial LIMIT 1) AS aggressive""")
def preset_ranking(spark, sf):
    return W.preset_winners(evaluator(spark, sf)(TRIALS))


CART = W.cartesian({"new_building": {"threshold": [0.6, 0.8]}, "tree_removal": {"min_area": [2, 4]}}, {"new_building": {"min_area": 2, "min_pos_area": 5}, "tree_removal": {"min_pos_area": 5}})


@query("u05_cartesian_search", exclusive_sql(values(CART)) + " SELECT trial AS trial_id, bt::DOUBLE AS b_threshold, ta::DOUBLE AS t_min_area, round(overall,6) AS objective FROM sm JOIN tr USING (trial)")
def cartesian_search(spark, sf):
    return evaluator(spark, sf)(CART).select("trial_id", "b_threshold", "t_min_area", F.round("overall", 6).alias("objective"))


@query("u05_staged_search")
def staged_search(spark, sf):
    """Threshold stage, then area stages, incumbent kept; returns the trial log."""
    run = evaluator(spark, sf)
    grid = {"new_building": {"threshold": [0.6, 0.8], "min_area": [2, 4]}, "tree_removal": {"threshold": [0.6, 0.8], "min_area": [2, 4]}}
    best, log = W.staged_search(lambda trials: run(trials).select("trial_id", F.col("overall").alias("objective")), grid)
    return spark.createDataFrame([(i, t["stage"], t["b_threshold"], float(t["b_min_area"]), t["t_threshold"], float(t["t_min_area"]), round(t["objective"], 6)) for i, t in enumerate(log)],
                                 "trial int, stage string, b_threshold double, b_min_area double, t_threshold double, t_min_area double, objective double")


@query("u06_calibration_sweep")
def calibration(spark, sf):
    sweep = W.calibration_sweep(evaluator(spark, sf), [0.5, 0.7], [2, 5], [5, 10])
    return sweep.select("stage", "trial_id", "b_threshold", "t_threshold", "b_min_area", "t_min_area", "b_min_pos_area", "t_min_pos_area", *r6("overall", "no_change_fp_rate"), "worst_fn", *r6("worst_fp", "neighbor_mean", "spread"))


@query("j18_transitions", exclusive_sql(values([TRIALS[0], TRIALS[8]])) + """,
jn AS (SELECT a.tile, class_name, a.t, a.q AS o, b.q AS n FROM oc a JOIN oc b USING (tile, class_name) WHERE a.trial=0 AND b.trial=8)
SELECT class_name, CASE WHEN t AND o AND n THEN 'TP_preserved' WHEN t AND o THEN 'TP_lost' WHEN o AND n THEN 'FP_still' WHEN o THEN 'FP_fixed' WHEN t AND NOT n THEN 'new_FN' WHEN NOT t AND n THEN 'new_FP' ELSE 'unchanged' END AS transition, count(*) AS n FROM jn GROUP BY ALL""")
def transitions(spark, sf):
    out = W.trial_outcomes(wide_maps(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), [TRIALS[0], TRIALS[8]], V.SIDE, V.SIDE)
    t = W.transitions(out.filter("trial_id = 0").drop("trial_id"), out.filter("trial_id = 8").drop("trial_id"))
    return t.groupBy("class_name", "transition").agg(F.count(F.lit(1)).alias("n"))


GATE_SQL = exclusive_sql(values(TRIALS)) + """,
mt AS (SELECT sc.trial, class_name, tp, gp, ss, overall, nf, nn FROM sc JOIN sm USING (trial)),
gt2 AS (SELECT c.trial, c.class_name, c.tp<b.tp AS r1, c.ss+1e-10<0.95*b.ss AS r2, c.overall+1e-10<b.overall AS r3, c.nf>=b.nf AS r4, c.nf>b.nf AS r5 FROM mt c JOIN mt b USING (class_name) WHERE b.trial=0 AND c.trial>0)"""


@query("j17_promotion_gate", GATE_SQL + """,
rs AS (SELECT trial, unnest(list_filter([CASE WHEN r3 THEN 'legacy: overall score regressed' END, CASE WHEN r5 THEN 'legacy: no-change false positives increased' END, CASE WHEN r1 THEN 'legacy/'||class_name||': positive recall regressed' END,
 CASE WHEN r2 THEN 'legacy/'||class_name||': shape score dropped more than 5 percent' END, CASE WHEN r4 THEN 'legacy: real no-change false positives did not decrease' END], lambda s: s IS NOT NULL)) AS r FROM gt2)
SELECT t.trial AS trial_id, coalesce(string_agg(DISTINCT r, ' | ' ORDER BY r),'') AS reasons, count(r)=0 AS passed FROM (SELECT DISTINCT trial FROM gt2) t LEFT JOIN rs USING (trial) GROUP BY 1""")
def promotion(spark, sf):
    s = cut(W.trial_summary(W.trial_outcomes(wide_maps(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), TRIALS, V.SIDE, V.SIDE)))
    rows = F.inline(F.array(*[F.struct(F.lit("legacy").alias("population"), F.lit(c).alias("class_name"), F.col(f"{c}_tp").alias("tp"), F.col(f"{c}_shape_score").alias("shape_score"),
                                       (F.col(f"{c}_tp") + F.col(f"{c}_fn")).alias("gt_positive_count"), (F.col(f"{c}_tp") + F.col(f"{c}_fn") + F.col(f"{c}_fp") + F.col(f"{c}_tn")).alias("num_samples")) for c in S.CLASSES]))
    m = s.select("trial_id", "overall", "no_change_fp_any", "no_change_count", rows)
    gate = W.promotion_gate(m.filter("trial_id > 0"), m.filter("trial_id = 0"), ["trial_id"])
    return gate.select("trial_id", F.array_join("reasons", " | ").alias("reasons"), "passed")


@query("w05_rule_choice", GATE_SQL + """,
el AS (SELECT g.class_name, g.trial, (mf+ss)/2 AS score, nf FROM gt2 g JOIN sc USING (trial, class_name) JOIN nc USING (trial) WHERE NOT r1 AND NOT r2),
f1 AS (SELECT *, min(nf) OVER (PARTITION BY class_name) mf FROM el), f2 AS (SELECT *, max(score) OVER (PARTITION BY class_name) ms FROM f1 WHERE nf=mf)
SELECT class_name, min_by('T'||trial, list_position([8,7,6,5,4,3,2,1], trial)) AS rule FROM f2 WHERE score>=ms-0.01 GROUP BY 1""")
def rule_choice(spark, sf):
    s = cut(W.trial_summary(W.trial_outcomes(wide_maps(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), TRIALS, V.SIDE, V.SIDE)))
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(f"{c}_tp").alias("tp"), F.col(f"{c}_shape_score").alias("shape"), F.col(f"{c}_score").alias("score")) for c in S.CLASSES]))
    m = s.select("trial_id", F.col("no_change_fp_any").alias("fp_count"), rows)
    base = m.filter("trial_id = 0").select("class_name", F.col("tp").alias("tp0"), F.col("shape").alias("shape0"))
    rules = m.filter("trial_id > 0").join(base, "class_name").select(
        "class_name", F.concat(F.lit("T"), "trial_id").alias("rule"), "fp_count", "score", ((F.col("tp") >= F.col("tp0")) & (F.col("shape") + 1e-10 >= 0.95 * F.col("shape0"))).alias("eligible"))
    return W.select_rule(rules, [f"T{i}" for i in range(8, 0, -1)])


def trial_metrics(spark, sf):
    """(rule, class_name, metrics) of all trials; the first is the baseline."""
    s = cut(W.trial_summary(W.trial_outcomes(wide_maps(spark, sf), placed_truth(spark, sf), V.presence(spark, sf), TRIALS, V.SIDE, V.SIDE)))
    positives = quiet_truth(spark, sf).select(*R.TILE).distinct().groupBy("class_name").agg(F.count(F.lit(1)).alias("gt_positive_count"))
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(f"{c}_tp").alias("tp"), F.col(f"{c}_shape_score").alias("shape_score")) for c in S.CLASSES]))
    size = V.presence(spark, sf).agg(F.countDistinct("pair_id"))
    m = s.select("trial_id", "no_change_fp_any", "no_change_count", "overall", rows).join(positives, "class_name")
    return m.withColumns({"num_samples": size.scalar(), "rule": F.concat(F.lit("T"), "trial_id")})


FINAL_SQL = GATE_SQL + """,
need AS (SELECT class_name, tp AS tp0, ss AS ss0, overall AS ov0 FROM mt WHERE trial=0),
lg AS (SELECT m.trial, list_filter([CASE WHEN gp<>tp0 OR tp<>tp0 THEN class_name||': recall must be '||tp0||'/'||tp0 END, CASE WHEN ss+1e-10<0.95*ss0 THEN class_name||': shape score dropped more than 5 percent' END,
 CASE WHEN nf>30 THEN 'real no-change false positives above 30' END, CASE WHEN overall<0.40 THEN 'real score below 0.40' END], lambda s: s IS NOT NULL) AS r FROM mt m JOIN need USING (class_name) WHERE trial>0),
sg AS (SELECT m.trial, list_filter([CASE WHEN tp<0.95*tp0 THEN class_name||': stress TP dropped more than 5 percent' END, CASE WHEN ss+1e-10<0.95*ss0 THEN class_name||': stress shape dropped more than 5 percent' END,
 CASE WHEN overall+1e-10<0.95*ov0 THEN 'stress overall score dropped more than 5 percent' END], lambda s: s IS NOT NULL) AS r FROM mt m JOIN need USING (class_name) WHERE trial>0),
gv AS (SELECT 'local' AS gate, trial, list_sort(list_distinct(flatten(list(r)))) AS r FROM lg GROUP BY trial UNION ALL SELECT 'stress', trial, list_sort(list_distinct(flatten(list(r)))) FROM sg GROUP BY trial)"""


def final_gates(m, needed):
    base, rest = m.filter("trial_id = 0"), m.filter("trial_id > 0")
    return W.local_gate(rest, base, ["rule"], needed, 30, 0.40), W.stress_gate(rest, base, ["rule"])


@query("j17_final_gates", FINAL_SQL + " SELECT gate, 'T'||trial AS rule, array_to_string(r, ' | ') AS reasons, len(r)=0 AS passed FROM gv")
def local_and_stress_gates(spark, sf):
    m = cut(trial_metrics(spark, sf))
    needed = {r.class_name: int(r.tp) for r in m.filter("trial_id = 0").collect()}  # what the baseline finds, a number per class
    named = [g.select(F.lit(n).alias("gate"), "rule", F.array_join("reasons", " | ").alias("reasons"), "passed") for n, g in zip(("local", "stress"), final_gates(m, needed))]
    return named[0].unionByName(named[1])


RULES_SQL = """WITH c AS (SELECT c_custkey//2%40 AS k, abs(c_acctbal) AS v, CASE WHEN c_custkey%2=0 THEN 'new_building' ELSE 'tree_removal' END AS class_name FROM customer),
w AS (SELECT k, k%3 AS nf, round(avg(v)/8000,4) AS score, k%2<>0 AS p FROM c GROUP BY 1), m AS (SELECT k, class_name, 5+CAST(k%7=0 AS INTEGER) AS tp, round(avg(v)/10000,4) AS ss FROM c GROUP BY 1, 2),
ok AS (SELECT m.k FROM m JOIN w USING (k) JOIN (SELECT class_name, tp AS t0, ss AS s0 FROM m WHERE k=4) b USING (class_name) GROUP BY 1 HAVING bool_and(tp=t0 AND ss>=0.95*s0 AND score>=0.5)),
od AS (SELECT w.*, row_number() OVER (ORDER BY p DESC, nf, score DESC, k) AS n FROM w JOIN ok USING (k)),
pf AS (SELECT od.*, od.k=(SELECT max(k) FROM od) AND od.p=b.p AND od.nf=b.nf AND od.score>=b.score-0.2 AS up FROM od, (SELECT * FROM od WHERE n=1) b)"""


@query("w05_rank_finalists", RULES_SQL + " SELECT k AS rule, CAST(row_number() OVER (ORDER BY CASE WHEN up THEN 0 ELSE n END) AS INTEGER) AS place FROM pf")
def finalists(spark, sf):
    """Rules with metrics of their own, a rule per group of customers; the last eligible one is preferred."""
    v = F.abs("c_acctbal").cast("double")
    c = V.table(spark, sf, "customer").select((F.floor(F.col("c_custkey") / 2) % 40).alias("rule"), v.alias("v"), F.when(F.col("c_custkey") % 2 == 0, "new_building").otherwise("tree_removal").alias("class_name"))
    whole = c.groupBy("rule").agg(F.max(F.col("rule") % 3).alias("no_change_fp_any"), F.round(F.avg("v") / 8000, 4).alias("overall"))
    m = cut(c.groupBy("rule", "class_name").agg(F.max(5 + (F.col("rule") % 7 == 0).cast("int")).alias("tp"), F.round(F.avg("v") / 10000, 4).alias("shape_score")).join(whole, "rule"))
    base, gates = m.filter("rule = 4"), whole.select("rule", (F.col("rule") % 2 != 0).alias("passed"))
    last = W.rank_finalists(m, base, gates, "rule", -1).agg(F.max("rule")).first()[0]  # one number
    return W.rank_finalists(m, base, gates, "rule", last, 0.5, 0.2)


@query("w16_keep_threshold", "WITH " + V.CANDIDATES_SQL + """,
k AS (SELECT class_name, CASE WHEN pair_id%4=0 THEN 'legacy' ELSE 'stress' END AS population, thr, count(*) FILTER (WHERE NOT is_true AND score>=thr) AS fp, count(*) FILTER (WHERE is_true AND score>=thr)/count(*) FILTER (WHERE is_true) AS rec, avg(((score>=thr)=is_true)::INT) AS sc
 FROM cand, (VALUES (0.0::DOUBLE),(0.03::DOUBLE),(0.05::DOUBLE),(0.1::DOUBLE),(0.2::DOUBLE)) t(thr) GROUP BY ALL),
t AS (SELECT class_name, thr, bool_and(rec>=0.95) ok, sum(fp) FILTER (WHERE population='legacy') AS fp, sum(sc) s FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY fp, round(s,12) DESC, thr) n FROM t WHERE ok)
SELECT class_name, thr AS threshold, CAST(fp AS BIGINT) AS fp, round(s,6) AS score FROM r WHERE n=1""")
def keep_threshold(spark, sf):
    grid = F.explode(F.array(*[F.lit(v) for v in (0.0, 0.03, 0.05, 0.1, 0.2)]))
    c = V.candidates(spark, sf).withColumn("threshold", grid).withColumn("population", F.when(F.col("pair_id") % 4 == 0, "legacy").otherwise("stress"))
    hit = F.col("score") >= F.col("threshold")
    t = c.groupBy("class_name", "population", "threshold").agg(
        F.count_if(~F.col("is_true") & hit).alias("fp_count"), (F.count_if(F.col("is_true") & hit) / F.count_if("is_true") >= 0.95).alias("ok"),
        F.avg((hit == F.col("is_true")).cast("double")).alias("score"))
    return W.choose_threshold(t).select("class_name", "threshold", "fp", *r6("score"))


# --- logs, ranks, caches ---------------------------------------------------------------------

@query("w08_best_so_far", """SELECT user_id AS run, event_id AS step, coalesce(value > max(value) OVER w, true) AS improved, round(greatest(value, coalesce(max(value) OVER w, value)),6) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def best_so_far(spark, sf):
    return folds.best_so_far(V.metric_log(spark, sf)).select("run", "step", "improved", *r6("best"))


@query("w08_patience", """
WITH RECURSIVE l AS (SELECT user_id AS run, event_id AS step, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events),
f AS (SELECT run, step, n, value AS best, 0::BIGINT AS bad, true AS improved FROM l WHERE n=1
 UNION ALL SELECT l.run, l.step, l.n, CASE WHEN value > best+5 THEN value ELSE best END, CASE WHEN value > best+5 THEN 0 ELSE bad+1 END, value > best+5 FROM f JOIN l ON l.run=f.run AND l.n=f.n+1)
SELECT run, step, improved, round(best,6) AS best, bad, bad>=10 AS stop FROM f""")
def patience(spark, sf):
    return folds.best_so_far(V.metric_log(spark, sf), min_delta=5.0, patience=10).select("run", "step", "improved", *r6("best"), "bad", "stop")


@query("w06_best_tuple", """SELECT user_id AS run, event_id AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type='click' DESC, value DESC, event_id) n FROM events) WHERE n=1""")
def best_tuple(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "event_type", "value")
    return W.best_tuple(e, ["run"], "step", F.col("event_type") == "click", F.col("value"), -F.col("step"))


@query("w02_worst_errors", Q.GROW_SQL + """,
k AS (SELECT class_name, pair_id, CASE WHEN t AND NOT q THEN 'fn' WHEN q AND NOT t THEN 'fp' WHEN t AND q AND both_area/(pred_area+truth_area-both_area)<0.8 THEN 'boundary' END AS kind, CASE WHEN t AND NOT q THEN -truth_area WHEN q AND NOT t THEN -pred_area ELSE both_area/(pred_area+truth_area-both_area) END AS o FROM outc),
r AS (SELECT *, row_number() OVER (PARTITION BY class_name, kind ORDER BY o, pair_id) AS rank FROM k WHERE kind IS NOT NULL) SELECT class_name, kind, pair_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank<=3""")
def worst_errors(spark, sf):
    o = Q.outcomes(spark, sf)
    t, q = F.col("truth_positive"), F.col("pred_positive")
    iou = F.col("both_area") / (F.col("pred_area") + F.col("truth_area") - F.col("both_area"))
    kind = F.when(t & ~q, "fn").when(q & ~t, "fp").when(t & q & (iou < 0.8), "boundary")
    size = F.when(t & ~q, -F.col("truth_area").cast("double")).when(q & ~t, -F.col("pred_area").cast("double")).otherwise(iou)
    rows = o.withColumn("kind", kind).withColumn("o", size).filter(F.col("kind").isNotNull())
    return O.top_per_group(rows, ["class_name", "kind"], [F.col("o"), F.col("pair_id")], 3).select("class_name", "kind", "pair_id", "rank")


@query("w07_largest_components", Q.PRED_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, class_name ORDER BY area DESC, component_id) AS rank FROM csize) SELECT pair_id, class_name, component_id, area, CAST(rank AS INTEGER) AS rank FROM r WHERE rank<=2""")
def largest(spark, sf):
    areas = R.component_areas(Q.labelled(spark, sf))
    return O.top_per_group(areas, R.TILE, [F.desc("area"), F.col("component_id")], 2)


@query("j09_id_alignment", "SELECT vec_id AS id, 'missing' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def id_alignment(spark, sf):
    return W.alignment_mismatch(V.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


@query("j15_blend", "WITH " + V.MAPS_SQL + " SELECT a.pair_id, a.class_name, a.y, a.x, round(0.3::DOUBLE*a.p+0.7::DOUBLE*b.p,6) AS p FROM maps a JOIN maps b ON b.pair_id=a.pair_id+1 AND b.class_name=a.class_name AND b.y=a.y AND b.x=a.x")
def blend(spark, sf):
    m = V.image_maps(spark, sf)
    return M.blend(m, m.withColumn("pair_id", F.col("pair_id") - 1), 0.3, [*R.TILE, "y", "x"]).withColumn("p", F.round("p", 6))


ALTERED = "CASE WHEN pair_id%6=0 AND y>=4 THEN p*0.9::DOUBLE ELSE p END"
CACHE_SQL = EQ.COMP_SQL + f""",
m2 AS (SELECT * FROM (SELECT pair_id, class_name, y, x, {ALTERED} AS p FROM maps) WHERE p >= 0.5::DOUBLE),""" + V.components_sql("m2", "l2", V.SMALL) + f""",
c2 AS (SELECT * FROM l2 QUALIFY count(*) OVER (PARTITION BY pair_id, class_name, component_id)>=3),
n1 AS (SELECT pair_id, class_name, component_id, count(*) AS a FROM ck WHERE pair_id%3=0 GROUP BY ALL), n2 AS (SELECT pair_id, class_name, component_id, count(*) AS b, avg(p) AS mp FROM c2 JOIN maps USING (pair_id, class_name, y, x) GROUP BY ALL),
bo AS (SELECT pair_id, class_name, component_id, count(*) AS k FROM ck JOIN c2 USING (pair_id, class_name, component_id, y, x) GROUP BY ALL)"""


@query("j16_cache_reuse", CACHE_SQL + """
SELECT pair_id, class_name, component_id, CASE WHEN a IS NULL THEN 'miss' WHEN a=b AND coalesce(k,0)=a THEN 'hit' ELSE 'stale' END AS state, b::DOUBLE AS area, round(mp,6) AS mean_probability
FROM n2 LEFT JOIN n1 USING (pair_id, class_name, component_id) LEFT JOIN bo USING (pair_id, class_name, component_id)""")
def cache_reuse(spark, sf):
    """Features of a third of the pairs are cached; then all pairs are asked for, some with other masks: those are computed anew, what
    is the same is read back."""
    maps = V.image_maps(spark, sf)
    image = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pair_id"), C.content_fingerprint(F.concat_ws(",", F.col("embedding").cast("array<string>")), 8, 8, "float32").alias("pair_fingerprint"))
    path = scratch_path(spark, "cache")

    def asked(labelled):
        keyed = C.cache_keys(C.mask_fingerprints(labelled, V.SMALL, V.SMALL).join(image, "pair_id"), "model-1", "config-1")

        def compute(todo):
            cells = R.to_pixels(labelled.join(todo.select(*C.IDENTITY, "cache_key"), C.IDENTITY)).join(maps, [*R.TILE, "y", "x"])
            return cells.groupBy("cache_key").agg(F.count(F.lit(1)).alias("area"), F.avg("p").alias("mean_probability"))

        return C.cached_features(keyed, compute, ["area", "mean_probability"], path)

    asked(EQ.components(spark, sf).filter("pair_id % 3 = 0"))
    altered = maps.withColumn("p", F.when((F.col("pair_id") % 6 == 0) & (F.col("y") >= 4), F.col("p") * 0.9).otherwise(F.col("p")))
    found = asked(EQ.components(spark, sf, altered))
    return found.select(*C.IDENTITY, "state", "area", F.round("mean_probability", 6).alias("mean_probability"))


@query("a31_image_fingerprints", """SELECT vec_id AS id, sha256('8x8xfloat32|'||array_to_string(list_transform(embedding, lambda v: CAST(CAST(round(v*1000) AS INTEGER) AS VARCHAR)), ',')) AS fingerprint FROM embeddings""")
def image_fingerprints(spark, sf):
    """Shape, type and content of every image in one hash."""
    text = F.concat_ws(",", F.transform("embedding", lambda v: F.round(v * F.lit(1000.0).cast("float")).cast("int").cast("string")))
    return V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), C.content_fingerprint(text, 8, 8, "float32").alias("fingerprint"))


@query("v10_probability_validity", "WITH " + V.IMAGE_SQL + """
SELECT pair_id, y, x, 'classes do not sum to one' AS reason FROM img WHERE abs(p_building+p_tree*1.0000005+CASE WHEN pair_id%7=0 THEN 0.1 ELSE 0 END-1)>1e-6::DOUBLE UNION ALL SELECT pair_id, y, x, 'outside [0,1]' FROM img WHERE pair_id%7=0 AND p_building+0.1>1""")
def probability_validity(spark, sf):
    """Every seventh pair has a shifted building map."""
    m = V.image_maps(spark, sf)
    bad = (F.col("class_name") == "new_building") & (F.col("pair_id") % 7 == 0)
    scaled = F.when(F.col("class_name") == "tree_removal", F.col("p") * 1.0000005).otherwise(F.col("p"))
    m = m.withColumn("p", F.when(bad, F.col("p") + 0.1).otherwise(scaled))
    return M.invalid_probabilities(m, ["pair_id", "y", "x"], 1e-6)
