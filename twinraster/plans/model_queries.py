"""Feature contracts, weights, logistic fits, candidate labels and evidence filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import runs as R
from ..operators import splits as P
from ..session import cut
from . import evidence_queries as EQ
from . import scoring_queries as Q
from . import views as V
from .registry import query

NAMES = ["score", "stability", "reverse", "confidence"]
OWN = "pair_id, class_name, component_id"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def training(spark, sf):
    return V.candidates(spark, sf).withColumn("label", F.col("is_true").cast("int")).withColumn("real", F.col("pair_id") % 3 == 0)


@query("v19_candidate_contract", "WITH " + V.CANDIDATES_SQL + """
SELECT pair_id, class_name, component_id, 'score' AS reason FROM cand WHERE score*1.1>1 UNION ALL SELECT pair_id, class_name, component_id, 'area' FROM cand WHERE area-2<0 UNION ALL SELECT pair_id, class_name, component_id, 'stability' FROM cand WHERE stability=0.5""")
def candidate_contract(spark, sf):
    c = V.candidates(spark, sf).withColumn("score", F.col("score") * 1.1).withColumn("area", F.col("area") - 2)
    c = c.withColumn("stability", F.when(F.col("stability") == 0.5, float("nan")).otherwise(F.col("stability")))
    return L.candidate_violations(c, ["pair_id", "class_name", "component_id"])


@query("v19_lenient_features", "WITH " + V.CANDIDATES_SQL + " SELECT pair_id, class_name, component_id, CASE WHEN stability=0.5 THEN 0 ELSE stability END AS stability, 0::DOUBLE AS absent_feature FROM cand")
def lenient(spark, sf):
    c = V.candidates(spark, sf).withColumn("stability", F.when(F.col("stability") == 0.5, float("inf")).otherwise(F.col("stability")))
    return L.lenient(c, ["stability", "absent_feature"]).select("pair_id", "class_name", "component_id", "stability", "absent_feature")


@query("v24_parameter_contract", """WITH p AS (SELECT p_brand AS model, p_type AS feature, p_size-2 AS sc, p_retailprice/1000 AS th, p_size%9=0 AS rev FROM part)
SELECT DISTINCT model, 'scale must be positive' AS reason FROM p WHERE sc<=0 UNION ALL SELECT DISTINCT model, 'threshold must be in [0,1]' FROM p WHERE th>1 UNION ALL SELECT DISTINCT model, 'support bounds are reversed' FROM p WHERE rev
UNION ALL SELECT DISTINCT model, 'duplicate feature' FROM (SELECT model, feature FROM p GROUP BY ALL HAVING count(*)>1)""")
def parameter_contract(spark, sf):
    p = V.table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.col("p_type").alias("feature"), F.lit(0).alias("pos"), F.lit(0.0).alias("mean"), (F.col("p_size") - 2).cast("double").alias("scale"), F.lit(1.0).alias("weight"),
        F.when(F.col("p_size") % 9 == 0, 2.0).otherwise(0.0).alias("lower"), F.lit(1.0).alias("upper"), (F.col("p_retailprice") / 1000).alias("threshold"))
    return L.parameter_violations(p)


WEIGHTS_SQL = "WITH " + V.CANDIDATES_SQL + """,
t AS (SELECT *, is_true::INT AS label, pair_id%3=0 AS real FROM cand),
n AS (SELECT class_name, label, real, count(*) AS n, CASE WHEN label=1 THEN 0.5 WHEN real THEN 0.75 ELSE 0.25 END::DOUBLE AS m FROM t GROUP BY ALL),
w AS (SELECT class_name, label, real, 0.5*m/sum(m) OVER (PARTITION BY class_name, label)/n*sum(n) OVER (PARTITION BY class_name) AS weight FROM n)"""


@query("a29_sample_weights", WEIGHTS_SQL + """,
j AS (SELECT * FROM t JOIN w USING (class_name, label, real)), f AS (SELECT class_name, weight, unnest(['score','stability','reverse','confidence']) AS feature, unnest([score, stability, reverse, confidence]) AS v FROM j),
a AS (SELECT class_name, feature, sum(weight*v)/sum(weight) AS m FROM f GROUP BY ALL)
SELECT class_name, feature, round(any_value(m),6) AS mean, round(sqrt(sum(weight*pow(v-m,2))/sum(weight)),6) AS scale, min(v) AS lower, max(v) AS upper FROM f JOIN a USING (class_name, feature) GROUP BY ALL""")
def sample_weights(spark, sf):
    w = L.stratum_weights(training(spark, sf))
    return L.weighted_moments(w, ["class_name"], NAMES).select("class_name", "feature", *r6("mean", "scale"), "lower", "upper")


@query("a30_logistic_fit")
def logistic_fit(spark, sf):
    """One balanced fit per class; coefficients as rows."""
    rows = []
    for c in ("new_building", "tree_removal"):
        m = L.fit_logistic(L.design(training(spark, sf).filter(F.col("class_name") == c), NAMES, "label"), len(NAMES))[0]
        rows += [(c, n, round(w, 6)) for n, w in zip([*NAMES, "bias"], [*m["weights"], m["bias"]])]
    return spark.createDataFrame(rows, "class_name string, feature string, weight double")


@query("a32_out_of_fold_grid")
def out_of_fold(spark, sf):
    """Every fold's rows are scored by a fit on the others, for each class; the chosen threshold of a class is marked."""
    scored, whole = [], cut(training(spark, sf).select("pair_id", "class_name", "label", *NAMES))
    for c in ("new_building", "tree_removal"):
        rows = P.grouped_folds(whole.filter(F.col("class_name") == c), "pair_id", 5)
        scored.append(L.out_of_fold(cut(rows), NAMES, "label", "fold", 5, 2.0)[0])
    grid = L.threshold_grid(scored[0].unionByName(scored[1]), "label", by=["class_name"])
    chosen = L.choose_operating_points(grid).withColumn("chosen", F.lit(True))
    return grid.join(F.broadcast(chosen), ["class_name", "threshold"], "left").select(  # a row per class
        "class_name", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fp_reduction", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query("a32_operating_points", "WITH " + V.CANDIDATES_SQL + """,
g AS (SELECT class_name, t, count(*) FILTER (WHERE confidence>=t AND is_true) tp, count(*) FILTER (WHERE confidence>=t AND NOT is_true) fp, count(*) FILTER (WHERE confidence<t AND is_true) fn, count(*) FILTER (WHERE confidence<t AND NOT is_true) tn
 FROM cand, (SELECT round(0.2::DOUBLE+0.05::DOUBLE*i,2) AS t FROM range(13) r(i)) GROUP BY ALL),
m AS (SELECT *, tp/greatest(tp+fp,1) p, tp/greatest(tp+fn,1) r FROM g), k AS (SELECT *, round(r,4) AS rc, round(2*p*r/greatest(p+r,1e-6),4) AS f, round(tn/greatest(tn+fp,1),4) AS fr FROM m),
o AS (SELECT *, rc>=CASE class_name WHEN 'new_building' THEN 0.88 ELSE 0.94 END AND t<=CASE class_name WHEN 'new_building' THEN 0.55 ELSE 0.2 END AS ok FROM k)
SELECT class_name, t AS threshold, tp, fp, fn, tn, rc AS recall, f AS f1, fr AS fp_reduction FROM o
QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY ok DESC, CASE WHEN ok THEN -fr WHEN class_name='new_building' THEN -f ELSE abs(t-0.2) END, CASE WHEN ok THEN -f ELSE t END, t)=1""")
def operating_points(spark, sf):
    """The rule on scores that need no fit: one threshold per class with its counts."""
    scored = V.candidates(spark, sf).select("class_name", F.col("is_true").cast("int").alias("label"), F.col("confidence").cast("double").alias("oof"))
    grid = L.threshold_grid(scored, "label", by=["class_name"])
    return grid.join(L.choose_operating_points(grid), ["class_name", "threshold"]).select("class_name", "threshold", "tp", "fp", "fn", "tn", "recall", "f1", "fp_reduction")


@query("a33_feature_separation", "WITH " + V.CANDIDATES_SQL + """
SELECT class_name, round(avg(score) FILTER (WHERE is_true),6) AS score_true, round(avg(score) FILTER (WHERE NOT is_true),6) AS score_other, round(avg(reverse) FILTER (WHERE is_true),6) AS reverse_true, round(avg(reverse) FILTER (WHERE NOT is_true),6) AS reverse_other,
 avg(score) FILTER (WHERE is_true)-avg(score) FILTER (WHERE NOT is_true)>=0.05 AS score_separates, avg(reverse) FILTER (WHERE is_true)-avg(reverse) FILTER (WHERE NOT is_true)>=0.1 AS reverse_separates FROM cand GROUP BY 1""")
def feature_separation(spark, sf):
    s = L.separation(V.candidates(spark, sf).withColumnRenamed("is_true", "has_truth"), ["score", "reverse"], [0.05, 0.10])
    return s.select("class_name", *r6("score_true", "score_other", "reverse_true", "reverse_other"), "score_separates", "reverse_separates")


FACT_SQL = Q.PRED_SQL + f""",
fa AS (SELECT k.pair_id, k.class_name, k.component_id, count(*) AS n, count(gt.pair_id) AS overlap, count(*) FILTER (WHERE k.y<16) AS reviewed FROM kept k LEFT JOIN gt USING (pair_id, class_name, y, x) GROUP BY ALL),
tt AS (SELECT pair_id, class_name, count(*) AS total_truth FROM gt GROUP BY ALL),
ff AS (SELECT fa.*, coalesce(total_truth,0) AS total_truth, pair_id%4=1 AS partial, pair_id%5=0 AS neg, overlap/n AS sh FROM fa LEFT JOIN tt USING (pair_id, class_name)),
lbd AS (SELECT *, CASE WHEN neg THEN 0 WHEN partial THEN CASE WHEN sh>=0.4 THEN 1 WHEN reviewed/n>=0.95 AND sh<0.05 THEN 0 ELSE -1 END WHEN total_truth=0 THEN 0 WHEN sh>=0.4 OR overlap/(n+total_truth-overlap)>=0.25 THEN 1 WHEN sh<0.05 THEN 0 ELSE -1 END AS label FROM ff)"""


def large_components(spark, sf):
    return R.keep_large(Q.labelled(spark, sf), Q.MIN_AREA).select(*R.TILE, "component_id", "y", "x0", "x1")


def labelled_candidates(spark, sf, lab):
    half = V.presence(spark, sf).select(*R.TILE, F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y"), F.lit(0).alias("x0"), F.lit(V.SIDE).alias("x1"))
    facts = L.candidate_facts(lab, Q.truth(spark, sf), half)
    facts = facts.withColumn("partial", F.col("pair_id") % 4 == 1).withColumn("category", F.when(F.col("pair_id") % 5 == 0, "negative").otherwise("new_building"))
    return L.label_candidates(facts)


@query("r26_candidate_labels", FACT_SQL + f" SELECT {OWN}, n, overlap, reviewed, total_truth, label FROM lbd")
def candidate_labels(spark, sf):
    return labelled_candidates(spark, sf, large_components(spark, sf)).select(*R.TILE, "component_id", "n", "overlap", "reviewed", "total_truth", "label")


@query("x07_labelled_table", FACT_SQL + """,
q AS (SELECT pair_id, class_name, component_id, avg(p) AS mp FROM kept JOIN px USING (pair_id, class_name, y, x) GROUP BY ALL)
SELECT class_name, label, count(*) AS n, round(avg(mp),6) AS mean_probability, CAST(sum(n) AS BIGINT) AS pixels FROM lbd JOIN q USING (pair_id, class_name, component_id) GROUP BY ALL""")
def labelled_table(spark, sf):
    """Labelled feature table, written partitioned by class and read back."""
    from ..operators import evidence as E
    from ..session import scratch_path
    lab = cut(large_components(spark, sf))  # read by three branches
    feats = E.geometry(lab, V.SIDE, V.SIDE).join(E.confidence(lab, V.tile_pixels(spark, sf)), E.OWNER)
    path = scratch_path(spark, "candidates")
    feats.join(labelled_candidates(spark, sf, lab).select(*E.OWNER, "label"), E.OWNER).write.partitionBy("class_name").parquet(path)
    return spark.read.parquet(path).groupBy("class_name", "label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg("mean_probability"), 6).alias("mean_probability")], F.sum("area").cast("long").alias("pixels"))


MODEL = {"mean": [0.5, 0.5, 0.5, 0.5], "scale": [0.25, 0.3, 0.3, 0.25], "weights": [1.5, -0.5, 0.25, 1.0], "bias": -0.2, "lower": [0.05, 0.0, 0.0, 0.0], "upper": [0.97, 1.0, 1.0, 1.0]}
LOGIT = "-0.2+(score-0.5)/0.25*1.5+(stability-0.5)/0.3*-0.5+(reverse-0.5)/0.3*0.25+(confidence-0.5)/0.25*1.0"
PROB_SQL = "WITH " + V.CANDIDATES_SQL + f", sc AS (SELECT *, 1/(1+exp(-({LOGIT})::DOUBLE)) AS pr FROM cand)"


@query("r27_linear_scores", PROB_SQL + f" SELECT {OWN}, round(pr,6) AS probability, round(CASE WHEN score<0.05 OR score>0.97 THEN 1 ELSE pr END,6) AS supported, pr>=0.6 AS keep FROM sc")
def linear_scores(spark, sf):
    p = L.linear_probability(NAMES, MODEL)
    return V.candidates(spark, sf).select(*R.TILE, "component_id", F.round(p, 6).alias("probability"), F.round(L.supported_probability(NAMES, MODEL), 6).alias("supported"), (p >= 0.6).alias("keep"))


@query("r29_evidence_filter", PROB_SQL + f", k AS (SELECT * FROM sc WHERE pr>=0.6), b AS (SELECT pair_id, class_name FROM k GROUP BY ALL HAVING sum(area)>=60) SELECT {OWN}, area FROM k JOIN b USING (pair_id, class_name)")
def evidence_filter(spark, sf):
    c = V.candidates(spark, sf).withColumn("pr", L.linear_probability(NAMES, MODEL))
    return L.filter_components(c, F.col("pr") >= 0.6, 60.0).select(*R.TILE, "component_id", "area")


GATE_NAMES = ["pair_candidate_count", "pair_mean_top_k_score", "building_vs_tree_score_margin"]
GATE = {"mean": [4.0, 0.7, 0.0], "scale": [2.0, 0.2, 0.5], "weights": [0.4, 0.9, 0.3], "bias": 0.1}


@query("r30_pair_veto", EQ.PAIR_SQL + """,
g AS (SELECT p.pair_id, 1/(1+exp(-(0.1+(p.c-4)/2*0.4+(p.mk-0.7)/0.2*0.9+(coalesce(b.m1,0)-coalesce(t.m1,0))/0.5*0.3)::DOUBLE))>=0.5 AS ok FROM ag p LEFT JOIN ag b ON b.pair_id=p.pair_id AND b.scope='building' LEFT JOIN ag t ON t.pair_id=p.pair_id AND t.scope='tree' WHERE p.scope='pair')
SELECT o_orderkey AS pair_id, CASE WHEN coalesce(ok,true) THEN o_orderstatus ELSE '' END AS new_building, CASE WHEN coalesce(ok,true) THEN o_orderpriority ELSE '' END AS tree_removal FROM orders LEFT JOIN g ON pair_id=o_orderkey""")
def pair_veto(spark, sf):
    verdicts = EQ.pair_table(spark, sf).select("pair_id", (L.linear_probability(GATE_NAMES, GATE) >= 0.5).alias("keep_pair"))
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderstatus").alias("new_building"), F.col("o_orderpriority").alias("tree_removal"))
    return L.pair_veto(rows, verdicts, ["new_building", "tree_removal"])


@query("r30_vetoed_records", EQ.PAIR_SQL + """,
g AS (SELECT p.pair_id, 1/(1+exp(-(0.1+(p.c-4)/2*0.4+(p.mk-0.7)/0.2*0.9+(coalesce(b.m1,0)-coalesce(t.m1,0))/0.5*0.3)::DOUBLE))>=0.5 AS ok FROM ag p LEFT JOIN ag b ON b.pair_id=p.pair_id AND b.scope='building' LEFT JOIN ag t ON t.pair_id=p.pair_id AND t.scope='tree' WHERE p.scope='pair'),
k AS (SELECT cand.pair_id, class_name, component_id, area, kept AND coalesce(ok,true) AS kept FROM cand LEFT JOIN g USING (pair_id))
SELECT pair_id, class_name, component_id, kept AND coalesce(sum(area) FILTER (WHERE kept) OVER (PARTITION BY pair_id, class_name),0)>=60 AS kept FROM k""")
def vetoed_records(spark, sf):
    verdicts = EQ.pair_table(spark, sf).select("pair_id", (L.linear_probability(GATE_NAMES, GATE) >= 0.5).alias("keep_pair"))
    records = V.candidates(spark, sf).withColumn("area", F.col("area").cast("double"))
    return L.veto_records(records, verdicts, 60.0).select(*R.TILE, "component_id", "kept")
