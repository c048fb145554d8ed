"""Footprints, catalogues, tile grids, vegetation and forest-loss proposals."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, reasons
from . import runs as R

GEOMETRY = "struct<type:string,coordinates:string>"
RINGS = "array<array<array<double>>>"


def read_footprints(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(feature_id, part, rings, w, s, e, n) of GeoJSON lines whose envelope meets ``box``, every part of such a feature.

    ``w, s, e, n`` is the envelope of the whole feature. What can't be used is listed by ``footprint_violations``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.get_json_object("value", "$.id").alias("feature_id"), F.get_json_object("value", "$.geometry.type").alias("kind"),
                          F.get_json_object("value", "$.geometry.coordinates").alias("c"))
    single = F.array(F.from_json("c", RINGS))
    many = F.from_json("c", f"array<{RINGS}>")
    features = parsed.filter(F.col("kind").isin("Polygon", "MultiPolygon")).select(
        "feature_id", F.filter(F.when(F.col("kind") == "Polygon", single).otherwise(many), lambda p: F.size(p[0]) >= 3).alias("parts"))
    corners = F.flatten(F.transform("parts", lambda p: p[0]))
    side = lambda f, i: f(F.transform(corners, lambda c: c[i]))
    boxed = features.filter(F.size("parts") > 0).select(
        "feature_id", "parts", side(F.array_min, 0).alias("w"), side(F.array_min, 1).alias("s"), side(F.array_max, 0).alias("e"), side(F.array_max, 1).alias("n"))
    west, south, east, north = box
    kept = boxed.filter((F.col("e") >= west) & (F.col("w") <= east) & (F.col("n") >= south) & (F.col("s") <= north))
    return kept.select("feature_id", F.posexplode("parts").alias("part", "rings"), "w", "s", "e", "n")


def footprint_violations(spark: SparkSession, path: str, max_line: int = 1_000_000, max_features: int = 1_000_000) -> DataFrame:
    """(feature_id, reason): lines that hold no usable polygon or are longer than ``max_line``, and one row without an id if
    there are more than ``max_features`` lines. The scan itself keeps everything; the caller decides."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.get_json_object("value", "$.geometry.type")
    found = lines.select(F.get_json_object("value", "$.id").alias("feature_id"), F.explode(reasons(
        (F.length("value") > max_line, "line is too long"), (kind.isNull() | ~kind.isin("Polygon", "MultiPolygon"), "not a polygon"))).alias("reason"))
    count = lines.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_features)
    return found.unionByName(count.select(F.lit(None).cast("string").alias("feature_id"), F.lit("too many features").alias("reason")))


def catalogue_items(pages: DataFrame, years: list[int], state: str | None) -> DataFrame:
    """Every item of fetched pages by year and state, unique by id."""
    f = pages.select(F.explode("features").alias("f")).select(
        F.col("f.id").alias("id"), F.year(F.to_timestamp("f.properties.datetime")).alias("year"), F.lower("f.properties.state").alias("state"), F.col("f.properties.gsd").alias("gsd"))
    kept = f.filter(F.col("year").isin(*years))
    if state is not None:
        kept = kept.filter(F.col("state") == state.lower())
    return kept.dropDuplicates(["id"])


def catalogue_verdict(items: DataFrame, max_items: int) -> DataFrame:
    """One row: how many items there are and whether a caller that takes ``max_items`` would truncate them."""
    return items.agg(F.count(F.lit(1)).alias("items")).withColumn("truncated", F.col("items") > max_items)


def year_options(records: DataFrame, min_gap: int = 2, max_gap: int = 4) -> DataFrame:
    """(region, year_pre, year_post) of fully covered years within the gap range."""
    years = records.filter("covers").select("region_id", "year").distinct()
    later = years.select("region_id", F.col("year").alias("year_post"))
    ahead = years.withColumn("year_post", F.explode(F.sequence(F.col("year") + min_gap, F.col("year") + max_gap)))
    return ahead.join(later, ["region_id", "year_post"], "left_semi").select("region_id", F.col("year").alias("year_pre"), "year_post")


def loss_pixels(pixels: DataFrame, pre: Column, post: Column, cover: float, base: int = 2000) -> DataFrame:
    """Pixels whose coded loss year lies in (pre, post], with enough cover, on land."""
    code = F.col("lossyear")
    return pixels.filter(code.between(1, 24) & (code > pre - base) & (code <= post - base) & (F.col("treecover") >= cover) & (F.col("datamask") == 1))


def budget_verdict(files: DataFrame, by: str, max_files: int, max_file: int, max_total: int) -> DataFrame:
    """One row per plan: totals and the reasons to refuse it."""
    g = files.groupBy(by).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("bytes").isNull()).alias("unknown"), F.count_if(F.col("bytes") < 0).alias("negative"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("known_bytes"), F.max("bytes").alias("largest"), F.countDistinct("name").alias("names"), F.count_if(~F.col("safe")).alias("unsafe"))
    return g.withColumn("reasons", reasons(
        (F.col("files") > max_files, "too many files"), (F.col("unknown") > 0, "unknown size"), (F.col("negative") > 0, "negative size"), (F.col("largest") > max_file, "file too large"),
        (F.col("known_bytes") > max_total, "plan too large"), (F.col("names") < F.col("files"), "duplicate name"), (F.col("unsafe") > 0, "unsafe name")))


def raster_bytes(area_m2: Column, resolution: float, bands: int, stamps: int) -> Column:
    """Raw byte estimate of uint8 rasters."""
    return F.ceil(area_m2 / (resolution * resolution)) * bands * stamps


def footprint_runs(polygons: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """Even-odd scanline rasterisation at pixel centres: runs (keys, y, x0, x1).

    Every ring edge yields its crossing with the centre line of each row it spans;
    sorted crossings pair up to runs. Holes follow from the even-odd rule.
    """
    ring = polygons.select(*keys, F.explode(rings).alias("r"))
    edges = ring.select(*keys, F.explode(F.zip_with("r", F.concat(F.expr("slice(r, 2, size(r) - 1)"), F.slice("r", 1, 1)), lambda p, q: F.struct(p[0].alias("ax"), p[1].alias("ay"), q[0].alias("bx"), q[1].alias("by")))).alias("e")).select(*keys, "e.*")
    edges = edges.filter("ay <> by").withColumn("lo", F.least("ay", "by")).withColumn("hi", F.greatest("ay", "by"))
    # Rows whose centre lies in [lo, hi).
    span = edges.withColumn("y0", F.ceil(F.col("lo") - 0.5)).withColumn("y1", F.ceil(F.col("hi") - 0.5) - 1).filter("y1 >= y0")
    rows = span.withColumn("y", F.explode(F.sequence("y0", "y1")))
    x = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossing = rows.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.ceil(x - 0.5))).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(F.get(F.col("c"), 2 * i).alias("x0"), F.get(F.col("c"), 2 * i + 1).alias("x1")))
    return crossing.select(*keys, "y", F.inline(pairs)).filter("x1 > x0")


def split_by_tile(runs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Cut world-pixel runs at tile borders: (keys, tile_x, tile_y, y, x0, x1) in tile pixels."""
    t = runs.withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x1") - 1) / size)))).withColumn("tile_y", F.floor(F.col("y") / size))
    return t.select(*keys, "tile_x", "tile_y", (F.col("y") - F.col("tile_y") * size).alias("y"),
                    (F.greatest(F.col("x0"), F.col("tile_x") * size) - F.col("tile_x") * size).alias("x0"), (F.least(F.col("x1"), (F.col("tile_x") + 1) * size) - F.col("tile_x") * size).alias("x1"))


def common_grid(pairs: DataFrame, resolution: float) -> DataFrame:
    """Adds the inward-snapped common extent of two boxes (a_*, b_*) and its pixel size.

    Where the rows have columns aoi_*, the extent also stays within that area of interest; a null side doesn't limit it.
    """
    boxes = ["a", "b", "aoi"] if "aoi_w" in pairs.columns else ["a", "b"]
    up = lambda side: F.ceil(F.greatest(*[f"{b}_{side}" for b in boxes]) / resolution) * resolution
    down = lambda side: F.floor(F.least(*[f"{b}_{side}" for b in boxes]) / resolution) * resolution
    g = pairs.withColumns({"west": up("w"), "south": up("s"), "east": down("e"), "north": down("n")})
    g = g.filter((F.col("east") > F.col("west")) & (F.col("north") > F.col("south")))
    return g.withColumn("width", F.round((F.col("east") - F.col("west")) / resolution).cast("int")).withColumn("height", F.round((F.col("north") - F.col("south")) / resolution).cast("int"))


def grid_tiles(grids: DataFrame, size: int, max_tiles: int | None = None, max_pixels: int | None = None) -> DataFrame:
    """Complete tiles of every grid, each with the ``verdict`` on its grid: null, or the limit that the grid passes."""
    tiles = F.floor(F.col("width") / size) * F.floor(F.col("height") / size)
    never = F.lit(False)
    verdict = F.when(never if max_tiles is None else tiles > max_tiles, "too many tiles").when(
        never if max_pixels is None else F.col("width").cast("long") * F.col("height") > max_pixels, "grid exceeds the pixel limit")
    g = grids.withColumn("verdict", verdict).filter((F.col("width") >= size) & (F.col("height") >= size))
    return g.withColumn("row", F.explode(F.expr(f"sequence(0, height - {size}, {size})"))).withColumn("col", F.explode(F.expr(f"sequence(0, width - {size}, {size})")))


def valid_tiles(tiles: DataFrame, valid: list[DataFrame], size: int, min_valid: float = 1.0, key: str = "id") -> DataFrame:
    """``tiles`` of ``grid_tiles`` with ``valid_fraction``, the share of pixels that are valid in every raster, where it is at least ``min_valid``.

    Each raster's valid pixels are runs (key, y, x0, x1) on the grid. Runs are cut at tile borders and summed, so a tile costs its
    runs, not its pixels; a tile without a valid run has fraction 0.
    """
    if not 0 <= min_valid <= 1:
        raise ValueError("the valid fraction lies between 0 and 1")
    layers = {f"v{k}": runs.select(key, "y", "x0", "x1") for k, runs in enumerate(valid)}
    everywhere = reduce(lambda a, b: a & b, [F.col(name) > 0 for name in layers])
    shared = R.sweep(layers, [key]).filter(everywhere)
    counts = split_by_tile(shared, [key], size).groupBy(key, (F.col("tile_y") * size).alias("row"), (F.col("tile_x") * size).alias("col")).agg(F.sum(F.col("x1") - F.col("x0")).alias("_n"))
    share = F.coalesce(F.col("_n"), F.lit(0)) / F.lit(size * size)
    # both sides are exploded from far smaller tables, by whose size Spark would broadcast one of them
    return tiles.join(counts.hint("merge"), [key, "row", "col"], "left").withColumn("valid_fraction", share).filter(F.col("valid_fraction") >= min_valid).drop("_n")


def to_pixel(x: Column, y: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """World to (col, row) by the inverse of x = a*col + b*row + c, y = d*col + e*row + f."""
    det = a * e - b * d
    return (e * (x - c) - b * (y - f)) / det, (a * (y - f) - d * (x - c)) / det


def utm_code(lon: Column, lat: Column) -> Column:
    """EPSG number of the local UTM zone; NULL beyond its latitude range."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6) + 1))
    return F.when(lat.between(-80, 84), F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def granules(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Names of the 10-degree granules that cover each lon/lat box, by their upper-left corner; an empty box has none."""
    boxes = boxes.filter((F.col("e") > F.col("w")) & (F.col("n") > F.col("s")))
    lon = F.explode(F.sequence((F.floor(F.col("w") / 10) * 10).cast("int"), ((F.ceil(F.col("e") / 10) - 1) * 10).cast("int"), F.lit(10)))
    lat = F.explode(F.sequence((F.floor(F.col("s") / 10) * 10 + 10).cast("int"), (F.ceil(F.col("n") / 10) * 10).cast("int"), F.lit(10)))
    t = boxes.withColumn("lon", lon).withColumn("lat", lat)
    name = F.format_string("%02d%s_%03d%s", F.abs("lat"), F.when(F.col("lat") >= 0, "N").otherwise("S"), F.abs("lon"), F.when(F.col("lon") >= 0, "E").otherwise("W"))
    return t.select(*keys, name.alias("granule"))


def vegetation_share(r: Column, g: Column, b: Column, floor: float = 1.0) -> Column:
    """Brightness-normalised green excess, doubled and clipped."""
    return clamp(2 * (2 * g - r - b) / F.greatest(r + g + b, F.lit(float(floor))), 0, 1)


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / F.greatest(nir + red, F.lit(1.0))


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def forest_loss(pairs: DataFrame, candidate: Column, valid: Column, width: int, height: int, pre_min: float = 0.55, post_max: float = 0.25, min_drop: float = 0.35,
                min_area: int = 16, erosion: bool = True, min_brightness: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(proposal runs, per-pixel confidence) of byte RGB pairs inside candidate and valid pixels."""
    before, after = (vegetation_share(*[F.col(f"{s}_{c}") for c in "rgb"]) for s in ("pre", "post"))
    bright = lambda s: (F.col(f"{s}_r") + F.col(f"{s}_g") + F.col(f"{s}_b")) / 3 >= min_brightness
    t = pairs.withColumn("before", before).withColumn("after", after).withColumn("open", candidate & valid & bright("pre") & bright("post"))
    drop = F.col("before") - F.col("after")
    confidence = t.select("pair_id", "y", "x", F.when(F.col("open"), clamp(drop, 0, 1) * F.col("before") * (1 - F.col("after"))).otherwise(0.0).alias("confidence"))
    hits = t.filter(F.col("open") & (F.col("before") >= pre_min) & (F.col("after") <= post_max) & (drop >= min_drop)).select("pair_id", "y", "x")
    keys = ["pair_id"]
    m = R.to_runs(R.tile_partition(hits, keys), keys)
    if erosion:
        m = R.erode_cross(m, keys)
    return R.keep_large(R.label_components(m, width, height, 8, keys), min_area, keys).select("pair_id", "y", "x0", "x1"), confidence


def loss_review_state(decisions: DataFrame) -> DataFrame:
    """Adds review_status, label_source and train_eligible; broken decisions get a reason."""
    d = F.col("decision")
    named = F.col("reviewer").isNotNull() & (F.trim("reviewer") != "")
    why = (
        F.when(d.isNull() & (F.col("has_mask") | F.col("reviewer").isNotNull()), "mask or reviewer without a decision").when(d.isNotNull() & ~d.isin("approve", "reject"), "unknown decision")
        .when(d.isNotNull() & ~named, "reviewer required").when((d == "approve") & ~F.col("has_mask"), "approval requires a mask")
        .when((d == "approve") & (F.col("outside_pixels") > 0), "mask leaves the reviewable area").when((d == "reject") & (F.col("mask_pixels") > 0), "rejection cannot carry a mask"))
    return (
        decisions.withColumn("reason", why)
        .withColumn("review_status", F.when(d == "approve", "approved").when(d == "reject", "rejected").otherwise("pending"))
        .withColumn("label_source", F.when(d.isNull(), "unlabeled").otherwise("manual_review"))
        .withColumn("train_eligible", d.isNotNull() & (F.col("review_pixels") > 0) & F.col("reason").isNull()))


def footprint_proposals(members: DataFrame, keys: list[str], min_pixels: int = 40, before_min: float = 0.15, after_max: float = 0.2, change_min: float = 25.0) -> DataFrame:
    """Footprints that were vegetated, are not any more, and changed colour."""
    g = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), F.avg("ndvi_pre").alias("before"), F.avg("ndvi_post").alias("after"), F.avg("change").alias("change"))
    return g.filter((F.col("pixels") >= min_pixels) & (F.col("before") > before_min) & (F.col("after") < after_max) & (F.col("change") > change_min))


def crop_counts(pixels: DataFrame, cell: int, flag: Column, minimum: int, keys: list[str] = ("pair_id",)) -> DataFrame:
    """Grid cells with at least ``minimum`` flagged pixels."""
    at = lambda c: (F.floor(F.col(c) / cell) * cell).cast("int")
    g = pixels.groupBy(*keys, at("y").alias("row"), at("x").alias("col")).agg(F.count_if(flag).alias("pixels"))
    return g.filter(F.col("pixels") >= minimum)


def label_transition(pre: DataFrame, post: DataFrame, code: int) -> DataFrame:
    """Pixels that carry ``code`` after but not before."""
    keys = ["pair_id", "y", "x"]
    return post.filter(F.col("label") == code).select(*keys).join(pre.filter(F.col("label") == code).select(*keys), keys, "left_anti")
