"""Manifest, pair-list, truth, journal and report scans and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_absent, is_blank, present, safe_id

# Manifest columns in file order.
MANIFEST_FIELDS = [
    "id", "pre", "post", "new_building", "tree_removal", "region_id", "state",
    "source", "year_pre", "year_post", "license_status", "valid_mask", "review_mask",
]
PATH_FIELDS = ["pre", "post", "new_building", "tree_removal", "valid_mask", "review_mask"]
PREDICTION_FIELDS = ["id", "new_building", "tree_removal"]


class ContractError(ValueError):
    """Input breaks a documented rule."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def read_csv_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV with every column a string.

    ``multi_line`` admits line breaks inside quoted cells; such files cannot be split,
    so it is off unless asked for.
    """
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def id_violations(rows: DataFrame, trim: bool = True, id_col: str = "id") -> DataFrame:
    """(id, reason) for unsafe and repeated ids; empty when the table is sound."""
    key = F.trim(F.col(id_col)) if trim else F.col(id_col)
    counted = rows.groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "id",
        F.when(~safe_id(F.col("id"), trim), "unsafe id").when(F.col("n") > 1, "duplicate id").alias("reason"),
    ).filter(F.col("reason").isNotNull())


def reject_any(violations: DataFrame, what: str) -> None:
    """Raise with a few examples when a violation table is not empty."""
    sample = violations.limit(5).collect()
    if sample:
        raise ContractError(f"{what}: {[r.asDict() for r in sample]}")


def resolve_paths(rows: DataFrame, folder: Column) -> DataFrame:
    """Make relative path cells absolute; blanks and the word ``absent`` stay as they are."""
    out = rows
    for name in PATH_FIELDS:
        if name not in rows.columns:
            continue
        cell = F.trim(F.col(name))
        absolute = F.when(cell.startswith("/"), cell).otherwise(F.concat(folder, F.lit("/"), cell))
        # Absent by declaration or left blank: not a path.
        out = out.withColumn(name, F.when(present(F.col(name)) & ~is_absent(cell), absolute).otherwise(F.col(name)))
    return out


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows = require_columns(read_csv_table(spark, path), ["id", "pre", "post"])
    source = F.regexp_replace(F.input_file_name(), "^file:/+", "/")
    folder = F.regexp_replace(source, "/[^/]*$", "")
    rows = resolve_paths(rows.withColumn("id", F.trim("id")), folder)
    if strict:
        reject_any(id_violations(rows), "manifest ids must be safe and unique")
    return rows


def scan_sample_folders(files: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row per sample folder, told apart by its full path, from a (path, length) file listing; ``id`` is its last name."""
    roles = ["pre", "post", "new_building", "tree_removal"]
    name = r"^(.*?)([^/]+)/([^/]+)\.png$"
    parts = files.select(
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", name, 2).alias("id"),
        F.regexp_extract("path", name, 3).alias("role"), "path", "length",
    ).filter(F.col("role").isin(*roles))
    rows = parts.groupBy("folder", "id").agg(
        *[F.max(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in roles],
        F.sum("length").alias("bytes"),
    )
    return rows if regions is None else rows.join(regions, rows.id == regions.region, "left_semi")


def folder_violations(folders: DataFrame) -> DataFrame:
    """(id, reason) of folders whose last name another folder has too."""
    return folders.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("two folders have this id").alias("reason"))


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the single ``pairs.csv`` below ``root`` (a file, or a folder that Spark wrote) with their image paths."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        F.regexp_extract("path", r"^(.*)/pairs\.csv(/[^/]*)?$", 1).alias("base"))
    bases = [r.base for r in listed.filter("base <> ''").distinct().limit(2).collect()]
    if len(bases) != 1:
        raise ContractError("expected exactly one pairs.csv")
    raw = spark.read.option("header", True).csv(f"{bases[0]}/pairs.csv")
    rows = require_columns(raw, ["id"]).select(F.trim("id").alias("id")).filter(~is_blank(F.col("id")))
    reject_any(id_violations(rows), "pair ids must be safe and unique")
    image = lambda role: F.concat(F.lit(f"{bases[0]}/images/"), F.col("id"), F.lit(f"/{role}.png")).alias(role)
    return rows.select("id", image("pre"), image("post"))


def truth_kind(columns: list[str]) -> str:
    """``manifest`` when image columns exist, else ``polygons``; an error when neither fits."""
    names = set(columns)
    if {"pre", "post"} <= names or {"pre_path", "post_path"} <= names:
        return "manifest"
    if set(PREDICTION_FIELDS) <= names:
        return "polygons"
    raise ContractError("truth needs image columns or id, new_building, tree_removal")


def read_truth(spark: SparkSession, path: str, kind: str = "auto") -> tuple[str, DataFrame]:
    rows = read_csv_table(spark, path)
    found = truth_kind(rows.columns) if kind == "auto" else kind
    if rows.isEmpty():
        raise ContractError("ground truth is empty")
    if found == "manifest":
        return found, read_manifest(spark, path)
    return found, rows.select(*PREDICTION_FIELDS)


# --- sinks ----------------------------------------------------------------------

def write_predictions(rows: DataFrame, path: str) -> None:
    """Exactly the three prediction columns, unique ids, published by Spark's committer."""
    extra = sorted(set(rows.columns) - set(PREDICTION_FIELDS))
    if extra:
        raise ContractError(f"unexpected columns: {extra}")
    require_columns(rows, PREDICTION_FIELDS)
    reject_any(rows.groupBy("id").count().filter("count > 1"), "duplicate prediction ids")
    rows.select(*PREDICTION_FIELDS).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def manifest_columns(columns: list[str]) -> list[str]:
    return MANIFEST_FIELDS + sorted(set(columns) - set(MANIFEST_FIELDS))


def arrange_manifest(*parts: DataFrame) -> DataFrame:
    """Union of manifests: canonical columns first, then every extra column by name."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in manifest_columns(rows.columns)])


def write_manifest(path: str, *parts: DataFrame) -> None:
    arrange_manifest(*parts).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_report_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed column list; other columns are left out."""
    rows.select(*fields).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def report_json(rows: DataFrame) -> DataFrame:
    """One ``value`` column of JSON text per row; rows holding NaN or infinity are an error."""
    numbers = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = F.lit(False)
    for name in numbers:
        c = F.col(name)
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    text = F.to_json(F.struct(*rows.columns))
    return rows.select(F.when(bad, F.raise_error(F.lit("report holds a non-finite number"))).otherwise(text).alias("value"))


def write_report_json(rows: DataFrame, path: str) -> None:
    report_json(rows).write.mode("errorifexists").text(path)


def append_journal(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Reload a journal; a torn or malformed record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def pending(trials: DataFrame, journal: DataFrame, key: str = "key") -> DataFrame:
    """Trials whose key is not in the journal yet."""
    return trials.join(journal.select(key), key, "left_anti")
