"""op11: the embeddings, whitened on their leading components."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import register
from .common import stored, table
from .whitening import fit, grid_vectors, whiten

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


def whitened(vectors):
    """One row per row of ``vectors`` (vec_id, embedding) and component. Rows with a null or non-finite entry are left out; repeated and null ids
    are rows like others; vectors of different lengths are an error. Without two different vectors nothing varies: whitened, explained and
    identity_error are null."""
    rows = grid_vectors(vectors.select("vec_id", "embedding"), "embedding", "x", SCALE, OFFSET).select("vec_id", "x")
    points = stored(rows.select("x").distinct(), "whitening-points")
    found, error = fit(points, "x", COMPONENTS)
    done = whiten(rows, found, "x").select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(s).cast("double") for s in found.explained]) if found else F.array().cast("array<double>")
    return done.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(found.n if found else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
