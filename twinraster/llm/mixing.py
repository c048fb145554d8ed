"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of (source, language, topic); the cells are raked until their margins meet the targets, and each
document is kept with the probability its cell needs. Targets are parameters and every value they don't name falls under
``*``, so the table of cells is bounded by the parameters: product of (named values + 1), whatever the number of documents.
"""
from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Target shares of tokens per margin; ``*`` gathers every other value and null.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.20, "*": 0.80},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11},
    "topic": {"note": 0.05, "article": 0.30, "essay": 0.45, "book": 0.20},
}
#: Targets relative to the corpus: per margin, the factor on the share a value has in the tokens there are. Every other value, null
#: included, has factor 1.
RELATIVE: dict[str, dict[str, float]] = {
    "source": {"src0": 1.25},
    "lang": {},
    "topic": {"note": 1.1, "book": 1.1},
}
#: Cells that the targets may span, and raking sweeps.
MAX_CELLS, SWEEPS = 65_536, 40
REST = "*"


def tokens(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic(n: Column) -> Column:
    """A stand-in for a topic model where documents carry no topic: the form of the text by its length in tokens."""
    return F.when(n < 100, "note").when(n < 400, "article").when(n < 2000, "essay").otherwise("book")


def _margin(value: Column, targets: dict[str, float]) -> Column:
    named = [v for v in targets if v != REST]
    return F.when(value.isin(named), value).otherwise(F.lit(REST)) if named else F.lit(REST)


def rake(counts: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """``counts`` scaled axis by axis, again and again, until each axis sums to its target shares of one.

    A value without tokens can't get any: its share goes to the others in proportion. Cells that are empty stay empty.
    """
    weights = counts / max(counts.sum(), 1e-300)
    for _ in range(sweeps):
        for axis, target in enumerate(targets):
            others = tuple(a for a in range(counts.ndim) if a != axis)
            now = weights.sum(axis=others)
            wanted = np.where(now > 0, target, 0.0)
            wanted = wanted / wanted.sum() if wanted.sum() > 0 else now
            factor = np.divide(wanted, now, out=np.zeros_like(now), where=now > 0)
            weights = weights * factor.reshape([-1 if a == axis else 1 for a in range(counts.ndim)])
    return weights


def cell_rates(cells: DataFrame, targets: dict[str, dict[str, float]], sweeps: int = SWEEPS, relative: bool = False) -> list[tuple]:
    """(margin values..., rate) per cell from the token counts of ``cells``: how many times a document of the cell is expected in the mix.

    A cell's rate is its raked share over its share now, divided by the largest such ratio: the largest mix that
    has the target margins and repeats no document. Cells without tokens keep all their documents.

    With ``relative``, ``targets`` are factors on the shares that ``cells`` have (1 where none is given), and nothing is divided: the mix has as
    many tokens as the corpus, and what a cell needs beyond its documents are repeats, not less of all others. Where values go
    together, the margins can ask for a cell of nothing, or for one over and over; so no rate leaves the reach of the factors: the product, over the
    margins, of the largest raise or fall that one of them names.
    """
    names = list(targets)
    values = [[*(v for v in targets[n] if v != REST), REST] for n in names]
    place = [{v: i for i, v in enumerate(vs)} for vs in values]
    if np.prod([len(vs) for vs in values]) > MAX_CELLS:
        raise ValueError(f"targets span more than {MAX_CELLS} cells")
    counts = np.zeros([len(vs) for vs in values])
    for row in cells.collect():
        counts[tuple(place[k][row[n]] for k, n in enumerate(names))] = row["tokens"]
    shares = [np.array([float(targets[n].get(v, 1.0 if relative else 0.0)) for v in vs]) for n, vs in zip(names, values)]
    if relative:
        for axis, factors in enumerate(shares):
            wanted = factors * counts.sum(axis=tuple(a for a in range(counts.ndim) if a != axis))
            shares[axis] = wanted / max(wanted.sum(), 1e-300)
    weights = rake(counts, shares, sweeps)
    ratio = np.divide(weights, counts, out=np.zeros_like(counts), where=counts > 0)
    if relative:
        reach = np.prod([max([1.0, *(max(f, 1 / f) for f in targets[n].values())]) for n in names])
        keep = np.where(counts > 0, np.clip(ratio * counts.sum(), 1 / reach, reach), 1.0)
    else:
        top = ratio.max() if ratio.size else 0.0
        keep = np.where(counts > 0, np.minimum(ratio / top, 1.0) if top > 0 else 0.0, 1.0)
    return [(*vs, round(float(keep[at]), 9)) for vs, at in zip(product(*values), np.ndindex(counts.shape))]


def draw(id_col: Column, seed: int) -> Column:
    """A number in 0..1 that follows from the id alone, so a repeated or recomputed row is drawn alike."""
    digits = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 11, out: tuple[str, str, str, str] = ("tokens", "keep_probability", "sampled", "copies"),
) -> DataFrame:
    """``docs`` with its tokens, the probability that its cell keeps it, whether the draw does, and how many times it stands in the mix, in columns
    named ``out``.

    ``targets`` maps a column to shares of tokens, and a document stands in the mix once at most; without it the mix follows ``RELATIVE``, which takes no
    cell to 0, and documents of a cell that is raised come once, some of them more often: values that it
    doesn't name, null included, keep the share they have. The margin ``topic`` is derived from the text where ``docs`` has no such
    column. Defined cases: values that no target names, null included, count under ``*``; where given targets leave ``*`` no share (or
    a share of 0), such documents are not sampled; a document without tokens has no weight and is kept if its cell is;
    rows with equal ids are drawn alike (null ids as the empty string); an empty table gives an empty table; columns of
    ``docs`` with one of the ``out`` names are replaced.
    """
    n_tokens, keep_p, sampled, copies = out
    relative = targets is None
    targets = RELATIVE if relative else targets
    named = {m: f"__margin_{m}" for m in targets}
    counted = docs.withColumn("__tokens", tokens(F.col(text_col)))
    for m, values in targets.items():
        source = F.col(m) if m in docs.columns else topic(F.col("__tokens"))
        counted = counted.withColumn(named[m], _margin(source.cast("string"), values))
    cells = counted.groupBy(*[F.col(c).alias(m) for m, c in named.items()]).agg(F.sum("__tokens").alias("tokens"))
    rows = cell_rates(cells, targets, relative=relative)
    schema = ", ".join([f"{c} string" for c in named.values()] + ["__rate double"])
    factors = docs.sparkSession.createDataFrame(rows, schema)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in out]
    rate, u = F.col("__rate"), draw(F.col(id_col), seed)
    return counted.join(F.broadcast(factors), list(named.values()), "left").select(
        *kept, F.col("__tokens").alias(n_tokens), F.least(rate, F.lit(1.0)).alias(keep_p), (u < rate).alias(sampled),
        (F.floor(rate) + (u < rate - F.floor(rate)).cast("bigint")).alias(copies))
