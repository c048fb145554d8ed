"""Group-safe splits, leakage, duplicates and held-out guards."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_index, prefix_sum, previous_in_group


def grouped_folds(rows: DataFrame, group: str, k: int) -> DataFrame:
    """Adds ``fold``: sorted distinct groups cut into ``k`` near-equal chunks."""
    ranked = global_index(rows.select(group).distinct(), F.col(group), name="_g")
    n = ranked.count()
    base, extra = divmod(n, k)
    # The first ``extra`` chunks hold one group more.
    edge = extra * (base + 1)
    fold = F.when(F.col("_g") < edge, F.floor(F.col("_g") / (base + 1))).otherwise(
        extra + F.floor((F.col("_g") - edge) / max(base, 1)))
    return rows.join(ranked.select(group, fold.cast("int").alias("fold")), group)


def fraction_split(rows: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``split``: whole groups go to ``val`` in seeded order until the target is reached; never the last group."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))
    ahead = prefix_sum(sizes.withColumn("_o", order), "n", F.col("_o"), F.col(group), name="before")
    total, last = ahead.agg(F.sum("n"), F.max(F.struct("_o", group))).first()
    chosen = (F.col("before") < total * fraction) & ~((F.col("_o") == last[0]) & (F.col(group) == last[1]))
    sides = ahead.select(group, F.when(chosen, "val").otherwise("train").alias("split"))
    return rows.join(sides, group)


def temporal_split(rows: DataFrame, group: str, year: str, cutoff: int) -> DataFrame:
    """Every member of a group with a post year at or after the cutoff is validation."""
    late = rows.groupBy(group).agg(F.max(F.col(year).cast("int")).alias("_y"))
    sides = late.select(group, F.when(F.col("_y") >= cutoff, "val").otherwise("train").alias("split"))
    return rows.join(sides, group)


def both_sides(split: DataFrame) -> None:
    if split.select("split").distinct().count() < 2:
        raise ValueError("split needs at least two disconnected groups")


def leakage_groups(rows: DataFrame, group: str) -> DataFrame:
    """Groups that hold rows of both splits, with counts and the exact number of leaking pairs.

    The pair list is the product of the two sides. It is kept in factored form, one row
    per group here and one row per member in ``leakage_members``, so that a large group
    stays linear.
    """
    sides = rows.groupBy(group).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    return sides.filter((F.col("n_train") > 0) & (F.col("n_val") > 0)).withColumn("n_pairs", F.col("n_train") * F.col("n_val"))


def leakage_members(rows: DataFrame, group: str, keep: list[str]) -> DataFrame:
    """Every row of a leaking group, its side, and how many rows of the other side it leaks with.

    The train and validation rows of one group are the complete list of leaking pairs.
    """
    bad = leakage_groups(rows, group)
    other = F.when(F.col("split") == "train", F.col("n_val")).otherwise(F.col("n_train"))
    return rows.join(bad, group).select(group, "id", "split", *keep, other.alias("n_opposite"))


def leakage_status(rows: DataFrame, group: str, located: Column) -> DataFrame:
    """One row: leaking pairs, located rows and the verdict."""
    pairs = leakage_groups(rows, group).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("candidates"))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(located).alias("located"))
    both = pairs.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn(
        "status", F.when(F.col("candidates") > 0, "leakage_detected").when(F.col("located") != F.col("rows"), "unverified").otherwise("no_candidates"))


def duplicate_content(references: DataFrame, digest: str) -> DataFrame:
    """(digest, copies, first id, last id, n_train, n_val) of every content held more than once."""
    return references.groupBy(digest).agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"),
    ).filter("copies > 1")


def duplicate_pairs(rows: DataFrame, digests: list[str], position: str) -> DataFrame:
    """Rows whose content occurred before, with the previous holder's id."""
    return previous_in_group(rows, digests, F.col(position), "id", "previous_id").filter(F.col("previous_id").isNotNull())


def own_source() -> Column:
    """The source a row was made from, or the row itself."""
    given = F.trim("source_id")
    return F.when(given != "", given).otherwise(F.col("id"))


def heldout_violations(train: DataFrame, heldout: DataFrame, keys: dict[str, list], id_col: str = "id") -> DataFrame:
    """(id, reason) of training rows that share a value with held-out rows, once per row and key.

    ``keys`` maps a name to the columns that share one namespace: any of a training row's values against all of them.
    """
    hits = []
    for name, columns in keys.items():
        values = lambda rows, *more: rows.select(*more, F.explode(F.array_distinct(F.array(*columns))).alias("_v")).filter(F.col("_v").isNotNull() & (F.col("_v") != ""))
        found = values(train, id_col).join(values(heldout).distinct(), "_v", "left_semi").select(id_col).distinct()
        hits.append(found.select(id_col, F.lit(f"shared {name}").alias("reason")))
    return reduce(DataFrame.unionByName, hits)


def coverage_violations(inventory: DataFrame, parts: DataFrame, fields: list[str]) -> DataFrame:
    """(id, reason): duplicate, missing, unknown or differing partition rows."""
    side = parts.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{c}") for c in fields])
    joined = inventory.select("id", F.lit(1).alias("_have"), *fields).join(side, "id", "full")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields])
    why = (
        F.when(F.col("_have").isNull(), "not in inventory").when(F.col("_n").isNull(), "not covered")
        .when(F.col("_n") > 1, "duplicate partition id").when(differs, "partition differs from inventory")
    )
    return joined.select("id", why.alias("reason")).filter(F.col("reason").isNotNull())


def temporal_steps(records: DataFrame, min_gap: int = 1, max_gap: int | None = None) -> DataFrame:
    """(region, year_pre, year_post, n_pre, n_post): the pair list of ``temporal_pairs`` by year, linear in size."""
    n = records.groupBy("region_id", "year").agg(F.count(F.lit(1)).alias("n"))
    pre, post = n.withColumnsRenamed({"year": "year_pre", "n": "n_pre"}), n.withColumnsRenamed({"year": "year_post", "n": "n_post"})
    gap = F.col("year_post") - F.col("year_pre")
    rule = gap >= min_gap if max_gap is None else gap.between(min_gap, max_gap)
    return pre.join(post, "region_id").filter(rule)


def temporal_pairs(records: DataFrame, min_gap: int = 1, max_gap: int | None = None) -> DataFrame:
    """All (pre, post) records of one region whose year gap lies in the range.

    With a bounded gap the post side is reached by equality on (region, year), so
    only matching pairs are produced. Without a bound the years come from the
    distinct (region, year) table.
    """
    years = records.groupBy("region_id", "year").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    if max_gap is None:
        post = years.select("region_id", F.col("year").alias("year_post"))
        steps = years.join(post, "region_id").filter(F.col("year_post") - F.col("year") >= min_gap)
    else:
        steps = years.withColumn("year_post", F.explode(F.sequence(F.col("year") + min_gap, F.col("year") + max_gap)))
        steps = steps.join(years.select("region_id", F.col("year").alias("year_post")), ["region_id", "year_post"], "left_semi")
    pre = records.select("region_id", "year", F.col("path").alias("pre")).join(steps, ["region_id", "year"])
    post = records.select("region_id", F.col("year").alias("year_post"), F.col("path").alias("post"))
    pairs = pre.join(post, ["region_id", "year_post"]).withColumnRenamed("year", "year_pre")
    if min_gap <= 0:
        # Same-year records form a pair once, in path order.
        pairs = pairs.filter((F.col("year_pre") < F.col("year_post")) | (F.col("pre") < F.col("post")))
    return pairs.select("region_id", "year_pre", "year_post", "pre", "post")
