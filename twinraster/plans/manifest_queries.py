"""Manifest scans, predicates, groups, splits, leakage and audit chains (documents and labels)."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X
from ..operators import graph as G
from ..operators import manifest as M
from ..operators import ordering as O
from ..operators import splits as P
from ..operators.reviews import apply_reviews, review_issues
from ..operators.settings import resolve_settings, setting_conflicts
from ..session import scratch_path
from ..sources import tables as S
from . import views as V
from .registry import query

WITH = "WITH RECURSIVE " + V.MANIFEST_SQL
GROUP_KEYS = [("region_id", "region_id"), ("image", "pre"), ("image", "post"), ("source_raster", "source_raster")]

TOKENS = "list_transform(string_split(source,'+'), lambda s: replace(lower(trim(s)),'-','_'))"
REASON = f"""CASE WHEN lower(audit_status)='unverified' THEN 'dataset audit has not approved this sample'
 WHEN list_has_any({TOKENS}, ['levir','levir_cd','levir_cd+','aihub','ai_hub']) THEN 'source excluded pending competition-compatible rights'
 WHEN trim(source)='' THEN 'missing source provenance'
 WHEN lower(license_status) NOT IN ('public_domain','cc_by_4.0','commercial_ok','verified_commercial') THEN 'commercial license not verified'
 WHEN list_has_any({TOKENS}, ['hansen','gfc','hansen_gfc']) OR label_source='hansen' THEN 'Hansen is candidate mining only'
 WHEN lower(label_status) IN ('candidate','weak_unreviewed','unreviewed') THEN 'labels require high-resolution review'
 WHEN training_scope='review_mask_only' AND review_mask='' THEN 'partial weak labels require a review_mask path'
 ELSE 'approved' END"""
MOCK = "list_has_any(string_split(lower(source),'_'), ['mock','demo','fixture','test'])"

KEYS_SQL = """
kv AS (SELECT id, 'region_id' AS namespace, region_id AS value FROM manifest UNION SELECT id,'image',pre FROM manifest UNION SELECT id,'image',post FROM manifest
 UNION SELECT id,'source_raster',source_raster FROM manifest WHERE source_raster<>'')"""
GROUPS_SQL = WITH + "," + KEYS_SQL + """,
adj AS (SELECT DISTINCT a.id AS a, b.id AS b FROM kv a JOIN kv b USING (namespace, value) WHERE a.id<>b.id),
walk AS (SELECT id, id AS seed FROM manifest UNION SELECT adj.b, walk.seed FROM walk JOIN adj ON adj.a=walk.id WHERE walk.seed<adj.b),
grp AS (SELECT id, min(seed) AS group_id FROM walk GROUP BY 1),
mg AS (SELECT manifest.*, group_id, CASE WHEN doc_id%5=0 THEN 'val' ELSE 'train' END AS split FROM manifest JOIN grp USING (id))"""


# The same groups with boxes: documents lie on the ground, some touch others or come within three metres of them.
KEY_EDGES = "SELECT DISTINCT a.id AS a, b.id AS b FROM kv a JOIN kv b USING (namespace, value) WHERE a.id<>b.id"
BOX_EDGES = """SELECT a.id AS a, b.id AS b FROM gb a JOIN gb b ON a.id<>b.id AND pow(greatest(0,b.w-a.e,a.w-b.e),2)+pow(greatest(0,b.s-a.n,a.s-b.n),2)<=9"""
SPATIAL_SQL = GROUPS_SQL.replace("adj AS (" + KEY_EDGES + ")", "gb AS (SELECT id, (doc_id*37)%4001 AS w, (doc_id*53)%3001 AS s, (doc_id*37)%4001+doc_id%50 AS e, (doc_id*53)%3001+10 AS n FROM manifest),\nadj AS (" + KEY_EDGES + " UNION " + BOX_EDGES + ")")
STATE_SQL = SPATIAL_SQL.replace(" UNION " + BOX_EDGES, "").replace("kv AS (", "kv AS (SELECT id, 'state' AS namespace, state AS value FROM manifest UNION ")


def placed(spark, sf):
    k = F.col("doc_id")
    w, south = ((k * 37) % 4001).cast("double"), ((k * 53) % 3001).cast("double")
    return V.manifest(spark, sf).withColumns({"w": w, "s": south, "e": w + k % 50, "n": south + 10, "crs": F.lit("EPSG:32618")})


@query("j06_spatial_groups", SPATIAL_SQL + " SELECT id, group_id FROM grp")
def spatial_groups(spark, sf):
    """Groups by shared keys and by boxes within three metres of each other, across regions."""
    return G.geographic_groups(placed(spark, sf), GROUP_KEYS, buffer=3.0).select("id", "group_id")


@query("j06_state_groups", STATE_SQL + " SELECT id, group_id FROM grp")
def state_groups(spark, sf):
    return G.geographic_groups(V.manifest(spark, sf), GROUP_KEYS, strategy="state").select("id", "group_id")


def grouped(spark, sf):
    rows = V.manifest(spark, sf)
    return G.label_groups(rows, G.shared_key_edges(rows, GROUP_KEYS))


def row_split(rows):
    """A deliberately unsafe split by row, to have leakage to find."""
    return rows.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train"))


# --- scans and sinks --------------------------------------------------------------

TEXT_COLUMNS = ["id", "pre", "post", "new_building", "tree_removal", "region_id", "state", "source", "year_pre", "year_post",
                "license_status", "review_mask", "label_status"]


def _tail(name):
    return F.regexp_replace(name, r"^/.*/manifest-[0-9a-f]+/", "")


@query("s01_manifest_scan", WITH + """
SELECT id, pre, post, coalesce(nullif(new_building,''),'-') AS new_building, coalesce(nullif(tree_removal,''),'-') AS tree_removal, region_id, coalesce(nullif(review_mask,''),'-') AS review_mask FROM manifest""")
def manifest_scan(spark, sf):
    path = scratch_path(spark, "manifest")
    S.write_manifest(path, V.manifest(spark, sf).select(*TEXT_COLUMNS))
    rows = S.read_manifest(spark, path)
    return rows.select("id", _tail("pre").alias("pre"), _tail("post").alias("post"),
                       F.coalesce(_tail("new_building"), F.lit("-")).alias("new_building"),
                       F.coalesce(_tail("tree_removal"), F.lit("-")).alias("tree_removal"), "region_id",
                       F.coalesce(_tail("review_mask"), F.lit("-")).alias("review_mask"))


@query("s02_sample_folders", WITH + """
SELECT id, f||'/'||id||'/pre.png' AS pre, f||'/'||id||'/post.png' AS post, CAST(3*n_chars AS BIGINT) AS bytes,
 CASE WHEN doc_id%6=0 THEN 'two folders have this id' END AS reason
FROM manifest, LATERAL (SELECT unnest(CASE WHEN doc_id%6=0 THEN ['root/x','root/y'] ELSE ['root/x'] END) AS f) WHERE doc_id%2=0""")
def sample_folders(spark, sf):
    """Listing of three files per document; only even documents are in the region list; some have twin folders."""
    m = V.manifest(spark, sf)
    parent = F.explode(F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("root/x/"), F.lit("root/y/"))).otherwise(F.array(F.lit("root/x/"))))
    files = m.select("id", "n_chars", parent.alias("parent")).select(
        "*", F.explode(F.array(*[F.lit(r) for r in ("pre", "post", "new_building")])).alias("role")).select(
        F.concat("parent", "id", F.lit("/"), "role", F.lit(".png")).alias("path"), F.col("n_chars").alias("length"))
    regions = m.filter("doc_id % 2 = 0").select(F.col("id").alias("region"))
    found = S.scan_sample_folders(files, regions)
    return found.join(S.folder_violations(found), "id", "left").select("id", "pre", "post", "bytes", "reason")


@query("s03_pair_list", WITH + " SELECT id, 'images/'||id||'/pre.png' AS pre, 'images/'||id||'/post.png' AS post FROM manifest")
def pair_list(spark, sf):
    folder = scratch_path(spark, "pairs")
    V.manifest(spark, sf).select("id").write.option("header", True).csv(f"{folder}/pairs.csv")
    rows = S.read_pairs(spark, folder)
    cut = r"^.*/(images/)"
    return rows.select("id", *[F.regexp_replace(r, cut, "$1").alias(r) for r in ("pre", "post")])


@query("s06_truth_kind", "SELECT 'polygons' AS kind, id, cell AS new_building, '-' AS tree_removal FROM (SELECT 'd'||doc_id AS id, '[[['||doc_id||',0],['||doc_id||',9],['||(doc_id+5)||',9]]]' AS cell FROM documents)")
def truth_load(spark, sf):
    path = scratch_path(spark, "truth")
    k = F.col("doc_id").cast("string")
    cell = F.concat(F.lit("[[["), k, F.lit(",0],["), k, F.lit(",9],["), (F.col("doc_id") + 5).cast("string"), F.lit(",9]]]"))
    V.table(spark, sf, "documents").select(F.concat(F.lit("d"), k).alias("id"), cell.alias("new_building"), F.lit("").alias("tree_removal")) \
        .write.option("header", True).option("escape", '"').csv(path)
    kind, rows = S.read_truth(spark, path)
    return rows.select(F.lit(kind).alias("kind"), "id", "new_building", F.coalesce("tree_removal", F.lit("-")).alias("tree_removal"))


LOG_SQL = "SELECT user_id AS run, event_id AS step, round(value,6) AS value FROM events WHERE event_id%4=0"


@query("s08_journal_resume", LOG_SQL)
def journal(spark, sf):
    """Three quarters of the log are journalled; the rest is what a resumed run still has to do."""
    log = V.metric_log(spark, sf).withColumn("key", F.concat_ws(":", "run", "step"))
    path = scratch_path(spark, "journal")
    S.append_journal(log.filter("step % 4 in (1, 2)"), path)
    S.append_journal(log.filter("step % 4 = 3"), path)
    left = S.pending(log, S.read_journal(spark, path, log.schema))
    return left.select("run", "step", F.round("value", 6).alias("value"))


@query("s09_prediction_sink", "SELECT 'd'||doc_id AS id, CASE WHEN doc_id%2=0 THEN '[[[0,0],[0,9],[9,9]]]' ELSE '' END AS new_building, '' AS tree_removal FROM documents")
def prediction_sink(spark, sf):
    path = scratch_path(spark, "prediction")
    cell = F.when(F.col("doc_id") % 2 == 0, "[[[0,0],[0,9],[9,9]]]").otherwise("")
    rows = V.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), cell.alias("new_building"), F.lit("").alias("tree_removal"))
    S.write_predictions(rows, path)
    return S.read_csv_table(spark, path).select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in S.PREDICTION_FIELDS[1:]])


@query("s10_manifest_sink", WITH + """
SELECT id, region_id, coalesce(nullif(zone,''),'-') AS zone, coalesce(nullif(extra,''),'-') AS extra FROM (
 SELECT id, region_id, '' AS zone, label_status AS extra FROM manifest UNION ALL SELECT id||'x', region_id, state, '' FROM manifest)""")
def manifest_sink(spark, sf):
    path = scratch_path(spark, "sink")
    m = V.manifest(spark, sf)
    S.write_manifest(path, m.select("id", "region_id", F.col("label_status").alias("extra")),
                     m.select(F.concat("id", F.lit("x")).alias("id"), "region_id", F.col("state").alias("zone")))
    back = S.read_csv_table(spark, path)
    assert back.columns == S.MANIFEST_FIELDS + ["extra", "zone"]
    return back.select("id", "region_id", F.coalesce("zone", F.lit("-")).alias("zone"), F.coalesce("extra", F.lit("-")).alias("extra"))


@query("s11_json_report", "SELECT source, count(*) AS n, round(avg(n_chars),6) AS mean_chars FROM documents GROUP BY 1")
def json_report(spark, sf):
    path = scratch_path(spark, "report")
    stats = V.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    S.write_report_json(stats, path)
    return spark.read.text(path).select(F.from_json("value", stats.schema).alias("r")).select("r.*")


# --- predicates -------------------------------------------------------------------

@query("v01_safe_ids", """SELECT url AS id, trim(url)<>'' AND url NOT IN ('.','..') AND NOT contains(url,'/') AND NOT contains(url,'\\') AS safe FROM pages
 UNION ALL SELECT p_name, trim(p_name)<>'' AND NOT contains(p_name,'/') FROM part""")
def safe_ids(spark, sf):
    ids = V.table(spark, sf, "pages").select(F.col("url").alias("id")).unionAll(V.table(spark, sf, "part").select("p_name"))
    return ids.select("id", X.safe_id(F.col("id")).alias("safe"))


@query("v02_unique_ids", "SELECT text AS id, 'duplicate id' AS reason FROM (SELECT sha256(text) AS text FROM documents) GROUP BY 1 HAVING count(*)>1")
def unique_ids(spark, sf):
    return S.id_violations(V.table(spark, sf, "documents").select(F.sha2("text", 256).alias("id")))


@query("v03_training_eligibility", WITH + f" SELECT id, {REASON} AS reason, {REASON}='approved' AS eligible FROM manifest")
def eligibility(spark, sf):
    return M.training_eligibility(V.manifest(spark, sf)).select("id", "reason", "eligible")


@query("v04_eligibility_split", WITH + f" SELECT {REASON} AS reason, count(*) AS n FROM manifest GROUP BY 1")
def eligibility_split(spark, sf):
    good, bad = M.split_by_eligibility(V.manifest(spark, sf))
    both = good.select(F.lit("approved").alias("reason")).unionAll(bad.select("exclusion_reason"))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("v05_mock_sources", WITH + f" SELECT id, {MOCK} AS mock FROM manifest")
def mock_sources(spark, sf):
    return V.manifest(spark, sf).select("id", M.is_mock(F.col("source")).alias("mock"))


def audit_input(spark, sf):
    k = F.col("doc_id")
    return V.manifest(spark, sf).select(
        "*", F.lit("a").alias("pre_source"), F.lit("b").alias("post_source"),
        F.when(k % 4 == 0, "").otherwise("m").alias("mask_source"),
        F.when(k % 19 == 0, "x").when(k % 23 == 0, "-1").otherwise("0.6").alias("resolution_m"),
        F.lit("l").alias("license_source"), F.when(k % 5 == 1, "").otherwise("u").alias("source_url"), F.lit("who").alias("reviewer"),
        F.when(k % 7 == 0, "").otherwise("aoi").alias("aoi_id"),
        F.when(k % 3 == 0, "verified").otherwise("").alias("provenance_status"), F.lit("verified").alias("license_review_status"))


AUDIT_SQL = WITH + f""",
am AS (SELECT *, 'a' pre_source, 'b' post_source, CASE WHEN doc_id%4=0 THEN '' ELSE 'm' END mask_source,
 CASE WHEN doc_id%19=0 THEN 'x' WHEN doc_id%23=0 THEN '-1' ELSE '0.6' END resolution_m, CASE WHEN doc_id%5=1 THEN '' ELSE 'u' END source_url,
 CASE WHEN doc_id%7=0 THEN '' ELSE 'aoi' END aoi_id, CASE WHEN doc_id%3=0 THEN 'verified' ELSE '' END provenance_status, {REASON} AS reason, {MOCK} AS mock FROM manifest),
why AS (SELECT *, list_filter([
  CASE WHEN trim(source)='' OR mask_source='' OR source_url='' OR aoi_id='' THEN 'missing '||array_to_string(list_filter([CASE WHEN trim(source)='' THEN 'source' END, CASE WHEN mask_source='' THEN 'mask_source' END,
   CASE WHEN source_url='' THEN 'source_url' END, CASE WHEN aoi_id='' THEN 'geographic_evidence' END], lambda s: s IS NOT NULL), ', ') END,
  CASE WHEN mock THEN 'mock imagery/labels; dates and regions are invented' END,
  CASE WHEN reason<>'approved' THEN reason END,
  CASE WHEN label_status NOT IN ('reviewed','verified') THEN 'labels not explicitly reviewed' END,
  CASE WHEN provenance_status<>'verified' THEN 'documented provenance/license review not verified' END,
  CASE WHEN try_cast(resolution_m AS DOUBLE) IS NULL THEN 'acquisition interval/resolution unverified'
   WHEN CAST(year_pre AS INT)>=CAST(year_post AS INT) OR try_cast(resolution_m AS DOUBLE)<=0 THEN 'invalid acquisition interval/resolution' END
 ], lambda s: s IS NOT NULL) AS w FROM am),
audited AS (SELECT *, len(w)=0 AS ok, array_to_string(w,'; ') AS audit_reason FROM why)"""


@query("v06_provenance", AUDIT_SQL + " SELECT id, mock, CASE WHEN ok THEN 'verified' ELSE 'unverified' END AS audit_status, ok AS audit_training_eligible, audit_reason FROM audited")
def provenance(spark, sf):
    return M.provenance(audit_input(spark, sf)).select("id", "mock", "audit_status", "audit_training_eligible", "audit_reason")


@query("v09_bounds", """SELECT p_partkey AS id, CASE WHEN p_partkey%10=0 THEN 'four finite coordinates required' WHEN p_partkey%6=0 OR p_size=0 THEN 'bounds must increase'
 WHEN (p_partkey%400)-200 < -180 OR (p_partkey%400)-200+p_size>180 THEN 'WGS84 range exceeded' END AS reason FROM part""")
def bounds(spark, sf):
    k = F.col("p_partkey")
    w, size = ((k % 400) - 200).cast("string"), F.col("p_size")
    text = F.when(k % 10 == 0, F.concat(F.lit("["), w, F.lit(",0,1]"))).when(
        k % 6 == 0, F.concat(F.lit("["), w, F.lit(",0,"), w, F.lit(",1]"))).otherwise(
        F.concat(F.lit("["), w, F.lit(",0,"), ((k % 400) - 200 + size).cast("string"), F.lit(",1]")))
    return V.table(spark, sf, "part").select(k.alias("id"), M.bounds_reason(F.from_json(text, "array<double>"), geographic=True).alias("reason"))


@query("v14_review_gate", """
SELECT id, reason FROM (SELECT o_orderkey AS id, unnest(list_filter([
 CASE WHEN o_orderkey%13=0 THEN 'notes' END,
 CASE WHEN (o_orderstatus='O')<>(o_orderpriority IN ('1-URGENT','2-HIGH')) THEN 'accept requires HIGH and HIGH requires accept' END,
 CASE WHEN o_orderstatus='O' AND o_orderkey%7=0 THEN 'full tile review and board' END,
 CASE WHEN o_orderstatus='O' AND o_custkey%11=0 THEN 'alignment note' END,
 CASE WHEN o_orderstatus='O' AND o_orderkey%3<>0 AND o_custkey%17=0 THEN 'label licence' END,
 CASE WHEN o_orderstatus='O' AND o_orderkey%3=0 AND o_custkey%4<>0 THEN 'no_change carries masks' END,
 CASE WHEN o_orderstatus='O' AND o_orderkey%3<>0 AND o_custkey%4<2 THEN 'positive lacks masks' END], lambda s: s IS NOT NULL)) AS reason FROM orders)""")
def review_gate(spark, sf):
    return M.review_violations(review_decisions(spark, sf))


def review_decisions(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return V.table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "O", "accept").when(F.col("o_orderstatus") == "P", "review").otherwise("reject").alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "HIGH").when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("MEDIUM").alias("confidence"),
        F.when(k % 13 == 0, " ").otherwise("seen").alias("notes"), (k % 7 != 0).alias("full_tile_reviewed"), F.lit("b").alias("board"),
        F.when(c % 11 == 0, "").otherwise("ok").alias("alignment_review"), F.when(c % 17 == 0, "").otherwise("own").alias("label_license"),
        F.when(k % 3 == 0, "no_change").otherwise("new_building").alias("class"), (c % 4).alias("n_masks"))


@query("j14_review_join", WITH + """
SELECT id, coalesce(CASE o_orderstatus WHEN 'O' THEN 'accept' WHEN 'P' THEN 'review' ELSE CASE WHEN o_orderkey IS NULL THEN NULL ELSE 'reject' END END,'pending') AS review_status,
 CASE WHEN o_orderkey IS NULL THEN 'UNREVIEWED' WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'HIGH' WHEN o_orderpriority='5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS review_confidence
FROM manifest LEFT JOIN orders ON o_orderkey=doc_id AND o_orderkey%3<>1""")
def review_join(spark, sf):
    d = review_decisions(spark, sf).filter("id % 3 <> 1").withColumn("id", F.concat(F.lit("d"), "id"))
    return M.apply_reviews(V.manifest(spark, sf).select("id", "region_id"), d).select("id", "review_status", "review_confidence")


@query("v16_heldout_guard", WITH + """,
g AS (SELECT *, CASE WHEN doc_id%7=0 THEN id ELSE NULL END AS source_id FROM manifest),
h AS (SELECT * FROM g WHERE doc_id%10=0), t AS (SELECT * FROM g WHERE doc_id%10<>0),
hp AS (SELECT pre AS v FROM h UNION SELECT post FROM h), ho AS (SELECT coalesce(nullif(source_id,''), id) AS v FROM h)
SELECT id, 'shared region_id' AS reason FROM t WHERE region_id IN (SELECT region_id FROM h)
UNION ALL SELECT id, 'shared source' FROM t WHERE coalesce(nullif(source_id,''), id) IN (SELECT v FROM ho)
UNION ALL SELECT id, 'shared image' FROM t WHERE pre IN (SELECT v FROM hp) OR post IN (SELECT v FROM hp)
UNION ALL SELECT id, 'shared source_raster' FROM t WHERE source_raster<>'' AND source_raster IN (SELECT source_raster FROM h)
UNION ALL SELECT id, 'shared content_hash' FROM t WHERE content_hash IN (SELECT content_hash FROM h)""")
def heldout_guard(spark, sf):
    """Images of either role are one namespace; a row without a source is its own source."""
    m = V.manifest(spark, sf).withColumn("source_id", F.when(F.col("doc_id") % 7 == 0, F.col("id")))
    keys = {"region_id": ["region_id"], "source": [P.own_source()], "image": ["pre", "post"], "source_raster": ["source_raster"], "content_hash": ["content_hash"]}
    return P.heldout_violations(m.filter("doc_id % 10 <> 0"), m.filter("doc_id % 10 = 0"), keys)


@query("v18_forbidden_ids", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)")
def forbidden_ids(spark, sf):
    forbidden = V.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(forbidden, "id", "left_anti")


@query("v21_partition_coverage", WITH + """
SELECT id, CASE WHEN doc_id%31=0 THEN 'not covered' WHEN doc_id%29=0 THEN 'duplicate partition id' ELSE 'partition differs from inventory' END AS reason
FROM manifest WHERE doc_id%31=0 OR doc_id%29=0 OR doc_id%37=0 UNION ALL SELECT 'z'||doc_id, 'not in inventory' FROM manifest WHERE doc_id%41=0""")
def partition_coverage(spark, sf):
    m = V.manifest(spark, sf)
    base = m.select("doc_id", "id", "pre", "post")
    parts = base.filter("doc_id % 31 <> 0").withColumn("post", F.when((F.col("doc_id") % 37 == 0) & (F.col("doc_id") % 29 != 0), "other").otherwise(F.col("post")))
    parts = parts.unionByName(base.filter("doc_id % 29 = 0 and doc_id % 31 <> 0")).unionByName(
        base.filter("doc_id % 41 = 0").withColumn("id", F.concat(F.lit("z"), "doc_id")))
    return P.coverage_violations(m.select("id", "pre", "post"), parts.select("id", "pre", "post"), ["pre", "post"])


@query("v22_flags", WITH + """
SELECT id, CASE WHEN tree_removal='' THEN true ELSE false END AS tree_blank, lower(new_building)='absent' AS building_absent, toxic=1 AS toxic_flag FROM manifest WHERE toxic IS NOT NULL
UNION ALL SELECT id, tree_removal='', lower(new_building)='absent', false FROM manifest WHERE toxic IS NULL""")
def flags(spark, sf):
    return V.manifest(spark, sf).select(
        "id", X.is_blank(F.col("tree_removal")).alias("tree_blank"), X.is_absent(F.col("new_building")).alias("building_absent"),
        X.is_true(F.col("toxic").cast("string")).alias("toxic_flag"))


def review_case(spark, sf, broken):
    """Decisions on two of three documents; with ``broken`` every seventh breaks a rule of its own."""
    k = F.col("doc_id")
    rows = V.manifest(spark, sf).select("id", "doc_id", "region_id", F.lit("NAIP").alias("source"), (k % 50 == 49).alias("synthetic"), "audit_status")
    accept, quiet = k % 3 == 0, k % 2 == 0
    bad = lambda n: F.lit(broken) & (k % 7 == 0) & (F.floor(k / 7) % 6 == n)
    mask = lambda c: F.concat(F.when(bad(0), "proposed_").otherwise("final_"), "id", F.lit(f"_{c}.png"))
    masks = F.when(quiet, F.create_map().cast("map<string,string>")).when(bad(1), F.create_map(F.lit("new_building"), mask("b"))).otherwise(
        F.create_map(F.lit("new_building"), mask("b"), F.lit("tree_removal"), mask("t")))
    said = rows.filter((k % 3 != 2) & ((k % 50 != 49) | F.lit(broken)))
    said = said.select(
        "id", F.when(accept, "accept").when(k % 6 == 1, "review").otherwise("reject").alias("status"), F.when(accept & ~bad(2), "HIGH").otherwise("LOW").alias("confidence"),
        F.when(bad(3), "").otherwise("seen").alias("notes"), F.lit("board.png").alias("board"), F.lit(True).alias("full_tile_reviewed"), F.when(bad(4), " ").otherwise("aligned").alias("alignment_review"),
        F.when(quiet, "no_change").otherwise("change").alias("class"), masks.alias("masks"), F.when(~quiet & ~bad(5), "own work").alias("label_license"), F.lit(None).cast("string").alias("negative_type"))
    return rows, said.unionByName(said.filter(F.col("id").endswith("99") & F.lit(broken)))


@query("v14_review_outcomes", WITH + """
SELECT id, doc_id%3=0 AND doc_id%50<>49 AS accepted, CASE WHEN doc_id%3=2 OR doc_id%50=49 THEN 'pending' WHEN doc_id%3=0 THEN 'accept' WHEN doc_id%6=1 THEN 'review' ELSE 'reject' END AS review_status,
 CASE WHEN doc_id%3=2 OR doc_id%50=49 THEN 'UNREVIEWED' WHEN doc_id%3=0 THEN 'HIGH' ELSE 'LOW' END AS confidence, CASE WHEN doc_id%3=0 AND doc_id%50<>49 THEN CASE WHEN doc_id%2=0 THEN 'absent' ELSE 'final_'||id||'_t.png' END END AS tree_removal FROM manifest""")
def review_outcomes(spark, sf):
    """Accepted rows and the queue of a sound set of decisions, in one table."""
    rows, said = review_case(spark, sf, False)
    accepted, queue = apply_reviews(rows, said, "reviewer-1", "side by side", "public record")
    cols = ["id", "accepted", "review_status", "confidence", "tree_removal"]
    return accepted.withColumn("accepted", F.lit(True)).select(cols).unionByName(queue.withColumns({"accepted": F.lit(False), "tree_removal": F.lit(None).cast("string")}).select(cols))


@query("v14_review_issues", WITH + """,
d AS (SELECT *, doc_id%3=0 AS ac, doc_id%2=0 AS q, CASE WHEN doc_id%7=0 THEN (doc_id//7)%6 ELSE 9 END AS b, CASE WHEN id LIKE '%99' THEN 2 ELSE 1 END AS n FROM manifest WHERE doc_id%3<>2),
i AS (SELECT id, n, unnest(list_filter([CASE WHEN n>1 THEN 'duplicate id' END, CASE WHEN b=3 THEN 'notes' END, CASE WHEN ac AND b=2 THEN 'only explicit HIGH decisions are accepted' END, CASE WHEN ac AND doc_id%50=49 THEN 'real NAIP pairs only' END,
 CASE WHEN ac AND b=4 THEN 'alignment decision' END, CASE WHEN ac AND NOT q AND b=1 THEN 'both reviewed masks and no others' END, CASE WHEN ac AND NOT q AND b=5 THEN 'label licence' END, CASE WHEN ac AND NOT q AND b=0 THEN 'candidate evidence is no final mask' END], lambda s: s IS NOT NULL)) AS reason FROM d)
SELECT id, reason FROM i, range(2) r(k) WHERE k<n""")
def review_problems(spark, sf):
    rows, said = review_case(spark, sf, True)
    return review_issues(rows, said, "public record")


# --- joins, groups, splits ----------------------------------------------------------

@query("j01_temporal_pairs", "WITH " + V.ACQUISITIONS_SQL + """
SELECT a.region_id, a.year AS year_pre, b.year AS year_post, a.path AS pre, b.path AS post FROM acq a JOIN acq b ON a.region_id=b.region_id AND b.year-a.year BETWEEN 2 AND 3""")
def temporal_pairs(spark, sf):
    return P.temporal_pairs(V.acquisitions(spark, sf), 2, 3)


@query("j01_temporal_pairs_open", "WITH " + V.ACQUISITIONS_SQL + """
SELECT a.region_id, a.year AS year_pre, b.year AS year_post, a.path AS pre, b.path AS post FROM acq a JOIN acq b ON a.region_id=b.region_id AND b.year-a.year>=4""")
def temporal_pairs_open(spark, sf):
    return P.temporal_pairs(V.acquisitions(spark, sf), 4)


@query("j01_temporal_steps", "WITH " + V.ACQUISITIONS_SQL + """,
n AS (SELECT region_id, year, count(*) AS n FROM acq GROUP BY ALL) SELECT a.region_id, a.year AS year_pre, b.year AS year_post, a.n AS n_pre, b.n AS n_post FROM n a JOIN n b ON a.region_id=b.region_id AND b.year>a.year""")
def temporal_steps(spark, sf):
    return P.temporal_steps(V.acquisitions(spark, sf))


@query("j03_shared_key_edges", WITH + "," + KEYS_SQL + """,
c AS (SELECT namespace, value, min(id) AS dst FROM kv GROUP BY ALL HAVING count(*)>1)
SELECT namespace, value, id AS src, dst FROM kv JOIN c USING (namespace, value) WHERE id<>dst""")
def shared_key_edges(spark, sf):
    return G.shared_key_edges(V.manifest(spark, sf), GROUP_KEYS)


@query("j06_geographic_groups", GROUPS_SQL + " SELECT id, group_id FROM grp")
def geographic_groups(spark, sf):
    return grouped(spark, sf).select("id", "group_id")


@query("j07_leakage_members", GROUPS_SQL + """,
g AS (SELECT group_id, count(*) FILTER (WHERE split='train') a, count(*) FILTER (WHERE split='val') b FROM mg GROUP BY 1)
SELECT group_id, id, split, year_pre||'->'||year_post AS span, CASE split WHEN 'train' THEN b ELSE a END AS n_opposite FROM mg JOIN g USING (group_id) WHERE a>0 AND b>0""")
def leakage_members(spark, sf):
    rows = row_split(grouped(spark, sf)).withColumn("span", F.concat_ws("->", "year_pre", "year_post"))
    return P.leakage_members(rows, "group_id", ["span"])


@query("j07_leakage_status", GROUPS_SQL + """,
g AS (SELECT group_id, count(*) FILTER (WHERE split='train') a, count(*) FILTER (WHERE split='val') b FROM mg GROUP BY 1)
SELECT CAST((SELECT sum(a*b) FROM g) AS BIGINT) AS candidates, (SELECT count(*) FROM mg) AS rows, (SELECT count(*) FROM mg WHERE source_raster<>'') AS located, 'leakage_detected' AS status""")
def leakage_status(spark, sf):
    return P.leakage_status(row_split(grouped(spark, sf)), "group_id", F.col("source_raster") != "")


@query("j08_duplicate_content", WITH + """
SELECT content_hash, count(*) AS copies, min(id) AS first_id, max(id) AS last_id, count(*) FILTER (WHERE doc_id%5<>0) AS n_train, count(*) FILTER (WHERE doc_id%5=0) AS n_val
FROM manifest GROUP BY 1 HAVING count(*)>1""")
def duplicate_content(spark, sf):
    return P.duplicate_content(row_split(V.manifest(spark, sf)), "content_hash")


@query("j08_duplicate_pairs", WITH + """
SELECT id, previous_id FROM (SELECT id, lag(id) OVER (PARTITION BY content_hash, state ORDER BY doc_id) AS previous_id FROM manifest) WHERE previous_id IS NOT NULL""")
def duplicate_pairs(spark, sf):
    return P.duplicate_pairs(V.manifest(spark, sf).select("doc_id", "id", "content_hash", "state"), ["content_hash", "state"], "doc_id").select("id", "previous_id")


@query("w09_grouped_folds", """WITH g AS (SELECT DISTINCT o_custkey AS grp FROM orders), f AS (SELECT grp, ntile(5) OVER (ORDER BY grp)-1 AS fold FROM g)
SELECT o_orderkey AS id, CAST(fold AS INTEGER) AS fold FROM orders JOIN f ON grp=o_custkey""")
def grouped_folds(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"))
    return P.grouped_folds(rows, "grp", 5).select("id", "fold")


@query("w10_fraction_split", GROUPS_SQL + """,
sz AS (SELECT group_id, count(*) AS n, md5('7|'||group_id) AS o FROM grp GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, row_number() OVER (ORDER BY o DESC, group_id DESC) AS back FROM sz)
SELECT id, CASE WHEN before < 0.2*(SELECT count(*) FROM grp) AND back>1 THEN 'val' ELSE 'train' END AS split FROM grp JOIN r USING (group_id)""")
def fraction_split(spark, sf):
    return P.fraction_split(grouped(spark, sf), "group_id", 0.2, 7).select("id", "split")


@query("w10_temporal_split", GROUPS_SQL + """,
l AS (SELECT group_id, max(CAST(year_post AS INT)) AS y FROM mg GROUP BY 1) SELECT id, CASE WHEN y>=2019 THEN 'val' ELSE 'train' END AS split FROM mg JOIN l USING (group_id)""")
def temporal_split(spark, sf):
    return P.temporal_split(grouped(spark, sf), "group_id", "year_post", 2019).select("id", "split")


@query("w11_split_validation", GROUPS_SQL + """,
l AS (SELECT group_id, max(CAST(year_post AS INT)) AS y FROM mg GROUP BY 1)
SELECT (SELECT count(*) FROM (SELECT group_id FROM mg GROUP BY 1 HAVING count(DISTINCT split)>1)) AS mixed_groups,
 (SELECT count(*) FROM (SELECT id FROM mg WHERE split='train' INTERSECT SELECT id FROM mg WHERE split='val')) AS shared_ids,
 (SELECT count(*) FROM mg JOIN l USING (group_id) WHERE (y>=2019)<>(split='val')) AS cutoff_breaks""")
def split_validation(spark, sf):
    rows = row_split(grouped(spark, sf))
    expected = P.temporal_split(rows.drop("split"), "group_id", "year_post", 2019).select("id", F.col("split").alias("want"))
    shared = rows.filter("split='train'").select("id").intersect(rows.filter("split='val'").select("id"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
    mixed = P.leakage_groups(rows, "group_id")
    breaks = rows.join(expected, "id").filter("split <> want")
    return one(mixed, "mixed_groups").join(one(shared, "shared_ids"), "_k").join(one(breaks, "cutoff_breaks"), "_k").drop("_k")


@query("u02_distinct_assets", WITH + " SELECT path, count(*) AS refs FROM (SELECT pre AS path FROM manifest UNION ALL SELECT post FROM manifest UNION ALL SELECT review_mask FROM manifest WHERE review_mask<>'') GROUP BY 1")
def distinct_assets(spark, sf):
    return _references(spark, sf).groupBy("path").agg(F.count(F.lit(1)).alias("refs"))


def _references(spark, sf):
    cells = V.manifest(spark, sf).select("n_chars", F.explode(F.array("pre", "post", "review_mask")).alias("path"))
    return cells.filter(X.present(F.col("path")) & ~X.is_absent(F.col("path")))


@query("a12_inventory", WITH + """,
r AS (SELECT pre AS path, n_chars FROM manifest UNION ALL SELECT post, n_chars FROM manifest UNION ALL SELECT review_mask, n_chars FROM manifest WHERE review_mask<>''),
p AS (SELECT path, max(n_chars) AS bytes FROM r GROUP BY 1)
SELECT count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes)/(SELECT count(*) FROM manifest),6) AS mean_bytes FROM p""")
def inventory(spark, sf):
    """Every physical path counts once however often it is referenced."""
    n = V.manifest(spark, sf).agg(F.count(F.lit(1)).alias("samples")).withColumn("_k", F.lit(1))
    files = _references(spark, sf).groupBy("path").agg(F.max("n_chars").alias("bytes"))
    total = files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).withColumn("_k", F.lit(1))
    return total.join(n, "_k").select("files", "bytes", F.round(F.col("bytes") / F.col("samples"), 6).alias("mean_bytes"))


@query("u03_id_differences", """SELECT doc_id AS id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
 UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id%7<>0)""")
def id_differences(spark, sf):
    truth, pred = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return truth.join(pred, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(
        pred.join(truth.filter("id % 7 <> 0"), "id", "left_anti").withColumn("side", F.lit("extra")))


@query("u04_shared_ids", "SELECT doc_id AS id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def shared_ids(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id")).intersect(V.table(spark, sf, "embeddings").select("vec_id"))


@query("u01_recipe_union", """
SELECT recipe, from_positives, from_negatives, count(*) AS n, count(quality) AS with_quality FROM (
 SELECT unnest(['S0','S1','S2']) AS recipe, 0 AS from_positives, 0 AS from_negatives, NULL::INT AS quality FROM documents
 UNION ALL SELECT unnest(['S1','S2']), 1, 0, quality FROM labels WHERE quality=1 UNION ALL SELECT 'S2', 0, 1, quality FROM labels WHERE quality=0) GROUP BY ALL""")
def recipe_union(spark, sf):
    base = V.table(spark, sf, "documents").select("doc_id", F.lit(0).alias("from_positives"), F.lit(0).alias("from_negatives"))
    extra = V.table(spark, sf, "labels").select("doc_id", "quality", F.when(F.col("quality") == 1, 1).otherwise(0).alias("from_positives"),
                                                F.when(F.col("quality") == 0, 1).otherwise(0).alias("from_negatives"))
    # Stage at which a row enters; it belongs to that recipe and every later one.
    rows = base.withColumn("stage", F.lit(0)).unionByName(
        extra.withColumn("stage", F.when(F.col("quality") == 1, 1).otherwise(2)), allowMissingColumns=True)
    named = rows.withColumn("recipe", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"S{i}").alias("n")) for i in range(3)]), lambda s: s["i"] >= F.col("stage"))))
    return named.groupBy(F.col("recipe.n").alias("recipe"), "from_positives", "from_negatives").agg(
        F.count(F.lit(1)).alias("n"), F.count("quality").alias("with_quality"))


@query("a14_reason_counters", AUDIT_SQL + " SELECT state, reason, count(*) AS n FROM (SELECT state, unnest(w) AS reason FROM audited) GROUP BY ALL")
def reason_counters(spark, sf):
    judged = M.provenance(audit_input(spark, sf)).filter("audit_reason <> ''")
    # The mock message itself holds "; ", so it is protected before splitting.
    safe = F.replace("audit_reason", F.lit("labels; dates"), F.lit("labels, dates"))
    return judged.select("state", F.explode(F.split(safe, "; ")).alias("reason")).groupBy(
        "state", F.replace("reason", F.lit("labels, dates"), F.lit("labels; dates")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


CATEGORY_SQL = "CASE WHEN new_building<>'absent' AND tree_removal<>'' THEN 'both' WHEN new_building<>'absent' THEN 'new_building' WHEN tree_removal<>'' THEN 'tree_removal' ELSE 'negative' END"


def category_column():
    return M.category(~X.is_absent(F.col("new_building")), X.present(F.col("tree_removal")))


@query("w15_first_examples", WITH + f""" SELECT category, id FROM (SELECT {CATEGORY_SQL} AS category, id, row_number() OVER (PARTITION BY {CATEGORY_SQL} ORDER BY doc_id) AS r FROM manifest) WHERE r=1""")
def first_examples(spark, sf):
    rows = V.manifest(spark, sf).withColumn("category", category_column())
    return rows.groupBy("category").agg(F.min_by("id", "doc_id").alias("id"))


@query("a31_fingerprints", """SELECT doc_id AS id, sha256(n_chars||'|'||text) AS fingerprint FROM documents""")
def fingerprints(spark, sf):
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("|", "n_chars", "text"), 256).alias("fingerprint"))


def audit_totals(spark, sf):
    rows = row_split(grouped(spark, sf))
    audited = M.provenance(audit_input(spark, sf))
    cat = category_column()
    totals = audited.select(
        "*", cat.alias("category"), (F.col("doc_id") % 5 == 0).alias("val")).agg(
        F.count_if(F.col("category") == "negative").alias("background_only"),
        F.sum(F.when(F.col("category").isin("both", "new_building"), F.col("n_chars")).otherwise(0)).alias("building_pixels"),
        F.sum(F.when(F.col("category").isin("both", "tree_removal"), F.col("n_chars")).otherwise(0)).alias("tree_pixels"),
        F.count(F.lit(1)).alias("total_samples"), F.count_if("mock").alias("mock_samples"),
        F.count_if(~F.col("audit_training_eligible")).alias("ineligible_samples"),
        F.count_if(F.col("n_chars") > 0).alias("usable_samples"),
        F.count_if(F.col("val") & (F.col("training_scope") == "review_mask_only")).alias("partial_val_samples"),
        F.count_if(F.col("n_chars") < 20).alias("suspicious_samples")).withColumn("_k", F.lit(1))
    leaks = P.leakage_groups(rows, "group_id").agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("leaks")).withColumn("_k", F.lit(1))
    return totals.join(leaks, "_k").drop("_k")


READY_SQL = AUDIT_SQL.replace("WITH RECURSIVE " + V.MANIFEST_SQL, GROUPS_SQL) + f""",
g AS (SELECT group_id, count(*) FILTER (WHERE split='train') a, count(*) FILTER (WHERE split='val') b FROM mg GROUP BY 1),
ct AS (SELECT *, {CATEGORY_SQL} AS category FROM audited),
tot AS (SELECT count(*) FILTER (WHERE category='negative') bg, count(*) n, count(*) FILTER (WHERE mock) mk, count(*) FILTER (WHERE NOT ok) inel,
 count(*) FILTER (WHERE doc_id%5=0 AND training_scope='review_mask_only') pv, count(*) FILTER (WHERE n_chars<20) sus, CAST((SELECT sum(a*b) FROM g) AS BIGINT) lk FROM ct)"""


@query("a35_readiness", READY_SQL + """
SELECT n AS total_samples, mk AS mock_samples, inel AS ineligible_samples, lk AS leaks, pv AS partial_val_samples, sus AS suspicious_samples, 'NOT READY' AS readiness,
 array_to_string(list_filter([CASE WHEN bg=0 THEN 'No reviewed no-change samples for false-positive control' END,
  CASE WHEN inel>0 THEN 'Unverified provenance/license/label review; excluded from training readiness' END,
  CASE WHEN lk>0 THEN 'Geographic/temporal isolation is not established or leakage exists' END,
  CASE WHEN pv>0 THEN 'Validation contains partially reviewed masks' END], lambda s: s IS NOT NULL), ' | ') AS blockers FROM tot""")
def readiness(spark, sf):
    out = M.readiness(audit_totals(spark, sf))
    return out.select("total_samples", "mock_samples", "ineligible_samples", "leaks", "partial_val_samples", "suspicious_samples", "readiness",
                      F.array_join("blockers", " | ").alias("blockers"))


@query("x05_dataset_build", SPATIAL_SQL + f""",
ok AS (SELECT * FROM (SELECT *, {REASON} AS reason FROM mg) WHERE reason='approved'),
sz AS (SELECT group_id, count(*) AS n, md5('7|'||group_id) AS o FROM ok GROUP BY 1),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before, row_number() OVER (ORDER BY o DESC, group_id DESC) AS back FROM sz)
SELECT id, CASE WHEN before < 0.2*(SELECT count(*) FROM ok) AND back>1 THEN 'val' ELSE 'train' END AS split FROM ok JOIN r USING (group_id)""")
def dataset_build(spark, sf):
    """Eligibility filter, group-safe split, leakage assertion, manifest sink, read back. Many documents touch each other until they are one group."""
    from ..operators.chains import build_dataset
    path = scratch_path(spark, "build")
    build_dataset(placed(spark, sf), GROUP_KEYS, path, fraction=0.2, seed=7, buffer=3.0, one_sided=True)
    return S.read_csv_table(spark, path + "/split").select("id", "split")


# --- strings, dates, JSON --------------------------------------------------------

@query("r34_years", """SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate)-2000 AS INTEGER) AS code,
 CAST(year(o_orderdate)-1995 AS INTEGER) AS gap, year(o_orderdate)>1995 AS ordered FROM orders""")
def years(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    y = F.year(F.to_timestamp(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), y.alias("year"), (y - 2000).alias("code"), (y - 1995).alias("gap"), (y > 1995).alias("ordered"))


@query("r35_strings", WITH + f""" SELECT id, array_to_string({TOKENS},',') AS tokens, 'tile_'||lpad(CAST(doc_id AS VARCHAR),8,'0') AS tile_id, regexp_replace(pre,'^img/','') AS relative FROM manifest""")
def strings(spark, sf):
    return V.manifest(spark, sf).select(
        "id", F.array_join(M.source_tokens(F.col("source")), ",").alias("tokens"),
        F.format_string("tile_%08d", "doc_id").alias("tile_id"), F.regexp_replace("pre", "^img/", "").alias("relative"))


@query("r36_safe_math", """SELECT event_id AS id, round(CASE WHEN k=0 THEN 0 ELSE value/k END,9) AS ratio,
 round(ln(q/(1-q)),6) AS logit, round(least(5.0::DOUBLE,greatest(-1.0::DOUBLE,value-10)),6) AS clamped
 FROM (SELECT event_id, value, CAST(json_extract_string(props,'$.k') AS DOUBLE) k, least(1-1e-6,greatest(1e-6,value/100)) AS q FROM events)""")
def safe_math(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return V.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.round(X.ratio(F.col("value"), k), 9).alias("ratio"),
        F.round(X.clipped_logit(F.col("value") / 100), 6).alias("logit"), F.round(X.clamp(F.col("value") - 10, -1, 5), 6).alias("clamped"))


@query("r32_json_access", """SELECT event_id AS id, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS objective FROM events WHERE try_cast(json_extract_string(props,'$.k') AS DOUBLE) IS NOT NULL""")
def json_access(spark, sf):
    """Dotted path into a nested report; only finite numbers survive."""
    nested = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("scores")))
    value = F.get_json_object(nested, "$.scores.k").cast("double")
    return V.table(spark, sf, "events").select(F.col("event_id").alias("id"), value.alias("objective")).filter(
        F.col("objective").isNotNull() & ~F.isnan("objective") & (F.abs("objective") != float("inf")))


@query("r33_config_keys", """SELECT p_partkey AS id, substring(sha256('{"min_area":'||p_size||',"threshold":"'||p_brand||'"}'),1,16) AS fingerprint,
 p_size%2=0 AS matches FROM part""")
def config_keys(spark, sf):
    text = F.to_json(F.struct(F.col("p_size").alias("min_area"), F.col("p_brand").alias("threshold")))
    runtime = X.short_fingerprint(text)
    expected = F.when(F.col("p_size") % 2 == 0, runtime).otherwise(F.lit("other"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), runtime.alias("fingerprint"), (runtime == expected).alias("matches"))


@query("r37_nested_reports", """SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n, count(*) FILTER (WHERE event_type='click') AS clicks, round(avg(value) FILTER (WHERE event_type='click'),6) AS click_mean FROM events GROUP BY 1""")
def nested_reports(spark, sf):
    per = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    report = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "mean").alias("v")))).alias("r"), F.sum("n").alias("n"))
    return report.select("user_id", "n", F.coalesce(F.col("r")["click"]["n"], F.lit(0).cast("long")).alias("clicks"), F.round(F.col("r")["click"]["mean"], 6).alias("click_mean"))


def setting_layers(spark, sf):
    """Common, class and direct layers per customer, with aliases, doubled settings and morphology on all levels."""
    k = F.col("c_custkey")

    def some(**parts):
        pairs = [F.struct(F.lit(n).alias("k"), F.lit(float(v)).alias("v"), c.alias("given")) for n, (c, v) in parts.items()]
        return F.map_from_entries(F.transform(F.filter(F.array(*pairs), lambda p: p["given"]), lambda p: F.struct(p["k"], p["v"])))

    layer = lambda settings, morphology: F.struct(settings.alias("settings"), morphology.alias("morphology"))
    none = F.lit(None).cast("map<string, double>")
    common = layer(some(threshold=(k % 2 == 0, 0.6), min_component_area=(k % 7 == 0, 12), min_area=(k % 14 == 0, 15), building_threshold=(k % 4 == 1, 0.65), min_total_area=(k % 6 == 0, 40),
                        min_positive_total_area=(k % 12 == 0, 44), opening=(k % 3 == 1, 1)), some(closing=(k % 5 == 1, 2), opening=(k % 15 == 1, 4)))
    building = layer(some(threshold=(k % 3 == 0, 0.7), min_component_area=(k % 9 == 0, 8)), none)
    tree = layer(some(min_area=(k % 5 == 0, 9)), some(opening=(k % 5 == 0, 3)))
    direct = F.map_from_arrays(F.array(F.lit("new_building"), F.lit("tree_removal")), F.array(
        layer(some(simplification_tolerance=(k % 10 == 0, 0.25), min_area=(k % 20 == 0, 5), min_component_area=(k % 40 == 0, 6)), none),
        layer(some(min_positive_total_area=(k % 11 == 0, 77), dilation=(k % 11 == 0, 1)), none)))
    by_class = F.map_from_arrays(F.array(F.lit("new_building"), F.lit("tree_removal")), F.array(building, tree))
    return V.table(spark, sf, "customer").select(k.alias("id"), common.alias("common"), by_class.alias("classes"), F.when(k % 13 != 0, direct).alias("direct"))


@query("v23_settings", """WITH l AS (SELECT c_custkey AS id, c_custkey AS k, cls, cls='new_building' AS b, c_custkey%13<>0 AS d FROM customer, (VALUES ('new_building'),('tree_removal')) v(cls))
SELECT id, cls AS class_name, CASE WHEN b AND k%3=0 THEN 0.7::DOUBLE WHEN k%2=0 THEN 0.6::DOUBLE WHEN b AND k%4=1 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS threshold,
 (CASE WHEN d AND b AND k%20=0 THEN 5 WHEN b AND k%9=0 THEN 8 WHEN NOT b AND k%5=0 THEN 9 WHEN k%14=0 THEN 15 WHEN k%7=0 THEN 12 END)::DOUBLE AS min_area,
 (CASE WHEN d AND NOT b AND k%11=0 THEN 77 WHEN k%12=0 THEN 44 WHEN k%6=0 THEN 40 END)::DOUBLE AS min_pos_area, (CASE WHEN d AND b AND k%10=0 THEN 0.25 END)::DOUBLE AS simplify_px,
 (CASE WHEN NOT b AND k%5=0 THEN 3 WHEN k%15=1 THEN 4 WHEN k%3=1 THEN 1 END)::DOUBLE AS opening, (CASE WHEN k%5=1 THEN 2 END)::DOUBLE AS closing, (CASE WHEN d AND NOT b AND k%11=0 THEN 1 END)::DOUBLE AS dilation FROM l""")
def settings(spark, sf):
    """Per-customer setting layers resolved to one row per class."""
    found = resolve_settings(setting_layers(spark, sf), "common", "classes", "direct")
    return found.select("id", "class_name", *[F.try_element_at("settings", F.lit(n)).alias(n) for n in ("threshold", "min_area", "min_pos_area", "simplify_px")],
                        *[F.try_element_at("morphology", F.lit(n)).alias(n) for n in ("opening", "closing", "dilation")])


@query("v23_setting_conflicts", """SELECT c_custkey AS id, layer, key, dropped, kept_value::DOUBLE AS kept_value, dropped_value::DOUBLE AS dropped_value FROM customer, (VALUES
 (14, 0, 'common', 'min_area', 'min_component_area', 15, 12), (12, 0, 'common', 'min_pos_area', 'min_total_area', 44, 40), (15, 1, 'common', 'opening', 'opening', 4, 1),
 (40, 0, 'direct.new_building', 'min_area', 'min_component_area', 5, 6)) c(m, r, layer, key, dropped, kept_value, dropped_value) WHERE c_custkey%m=r AND (layer='common' OR c_custkey%13<>0)""")
def setting_conflict_rows(spark, sf):
    return setting_conflicts(setting_layers(spark, sf), "common", "classes", "direct")
