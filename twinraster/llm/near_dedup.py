"""Near-duplicate documents by DartMinHash.

A text is a weighted set: its word shingles with the times each occurs. Darts are thrown at every unit of weight by a hash of
(shingle, unit, rank band), so two texts see the same darts wherever their weights overlap. Each dart hits one of ``K``
coordinates; the dart of lowest rank per coordinate is the signature, and two signatures agree at a coordinate with the
probability of the weighted Jaccard similarity. Bands of coordinates give candidates:

1. equal texts collapse to one representative before any banding;
2. in each bucket, members are compared with the member that shares most buckets with most others (a star: linear in the
   bucket, however large); among edited copies of one text that member is the text itself;
3. members that their centre isn't linked to are compared with the other members of the bucket, so no link is lost to the
   stars. An exact bound on the difference of two texts (bits of their shingles that only one has) spares the pairs
   that can't reach the threshold, such as two copies with many edits each;
4. candidates are verified on the exact weighted similarity of the whole texts, and links become connected components.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut
from .common import extended, mix, shingle_hashes, stored, texts, with_arrays, word_hashes

_U = np.uint64
SHINGLE, SIMILARITY = 5, 0.8
#: Coordinates, and bands of as many coordinates each: a pair at 0.8 shares a band with probability 0.9998.
K, BANDS = 64, 16
#: A pair is verified if at least this many coordinates agree; at similarity 0.8 fewer do with probability 1e-5.
AGREE = 36
#: Bits per text in the bound that spares far pairs their verification.
BITS = 2048
#: Rank bands end at 2^-12, 2^-11, ... 1 and then at every whole number.
_FINE = 12


def occurrence_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """One sorted hash per unit of weight: the j-th occurrence of a shingle hashes with j. The weighted Jaccard similarity
    of two texts is the plain one of these sets."""
    shingles = np.sort(shingle_hashes(word_hashes(text or b"")[0], size))
    if not len(shingles):
        return shingles
    start = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    at = np.arange(len(shingles))
    nth = at - np.maximum.accumulate(np.where(start, at, 0))
    return np.sort(mix(shingles + nth.astype(_U) * _U(0xA24BAED4963EE407)))


def _poisson_limits(mean: float) -> np.ndarray:
    """Upper limits of 64-bit hashes for 0, 1, 2, ... darts of a Poisson count."""
    p = total = np.exp(-mean)
    limits = [total]
    for k in range(1, 24):
        p *= mean / k
        total += p
        limits.append(total)
    return (np.minimum(np.array(limits), 1 - 2.0**-53) * 2.0**64).astype(_U)


_EDGES = np.concatenate([[0.0], 2.0 ** np.arange(-_FINE, 1)])
_LIMITS = np.stack([_poisson_limits(x) for x in np.diff(_EDGES)])


def dart_signature(units: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart (a hash) per coordinate. Rank bands are opened from the lowest until every coordinate is hit: first
    as many as hold some k log k darts, then one by one. A long text opens only bands of few darts, a short one opens more."""
    rank = np.full(k, np.inf)
    dart = np.zeros(k, dtype=_U)
    reach = k * (np.log(k) + 2) / len(units)
    low, high = 0, int(np.searchsorted(_EDGES, reach)) + 1 if reach <= 1 else _FINE + 1 + int(np.ceil(reach))
    while np.isinf(rank).any():
        bands = np.arange(low, high)
        seeds = mix(units[None, :] ^ ((bands + 1).astype(_U) * _U(0x9FB21C651E98DF25))[:, None])
        limits = _LIMITS[np.minimum(bands, _FINE)]
        band, at = np.nonzero(seeds >= limits[:, :1])
        if len(band):
            seed = seeds[band, at]
            each = (seed[:, None] >= limits[band]).sum(axis=1)
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            darts = mix(np.repeat(seed, each) + (nth + 1).astype(_U) * _U(0xD6E8FEB86659FD93))
            place = mix(darts ^ _U(0x632BE59BD9B4E019))
            start = np.where(bands <= _FINE, _EDGES[np.minimum(bands, _FINE)], bands - _FINE)
            width = np.where(bands <= _FINE, np.diff(_EDGES)[np.minimum(bands, _FINE)], 1.0)
            mine = np.repeat(band, each)
            ranks = start[mine] + width[mine] * ((place >> _U(11)).astype(np.float64) * 2.0**-53)
            coordinate = (darts % _U(k)).astype(np.int64)
            order = np.argsort(-ranks, kind="stable")  # the last write per coordinate is the lowest rank
            best, chosen = np.full(k, np.inf), np.zeros(k, dtype=_U)
            best[coordinate[order]], chosen[coordinate[order]] = ranks[order], darts[order]
            better = best < rank
            rank[better], dart[better] = best[better], chosen[better]
        low, high = high, high + 1
    return dart


def signatures(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, k: int = K, bands: int = BANDS) -> DataFrame:
    """``docs`` with ``coords`` (array of int, one per coordinate) and ``keys`` (array of long, one per band) in place of the
    text; both null for a text without a word."""

    def run(batches):
        for batch in batches:
            where = batch.schema.get_field_index(text_col)
            keep = [n for n in batch.schema.names if n != text_col]
            coords, keys = [], []
            for text in texts(batch.column(where)):
                units = occurrence_hashes(text, size)
                if not len(units):
                    coords.append(None)
                    keys.append(None)
                    continue
                sign = dart_signature(units, k)
                coords.append((sign >> _U(32)).astype(np.uint32).view(np.int32))
                folded = np.arange(1, bands + 1, dtype=_U)
                for column in sign.reshape(bands, -1).T:
                    folded = mix(folded * _U(0x2545F4914F6CDD1D) + column)
                keys.append(folded.view(np.int64))
            yield with_arrays(batch.select(keep), {"coords": pa.array(coords, pa.list_(pa.int32())), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, extended(docs.drop(text_col), ("coords", "array<int>"), ("keys", "array<bigint>")))


def verified(pairs: DataFrame, size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b) of those rows (a, b, text_a, text_b) whose weighted Jaccard similarity is at least ``threshold``."""

    def run(batches):
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            close = []
            for s, t in zip(texts(column["text_a"]), texts(column["text_b"])):
                x, y = occurrence_hashes(s, size), occurrence_hashes(t, size)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                close.append(shared >= threshold * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([column["a"], column["b"]], names=["a", "b"]).filter(pa.array(close, pa.bool_()))

    return pairs.mapInArrow(run, f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}")


def _bitmaps(bodies: DataFrame, size: int) -> DataFrame:
    """(id, units, bits) per text: its number of units, and a bit for every place of ``BITS`` that a unit hashes to. A bit
    that only one of two texts has set is a unit that only one has, so the bits that differ bound their difference."""

    def run(batches):
        for batch in batches:
            sizes, bits = [], []
            for text in texts(batch.column(1)):
                units = occurrence_hashes(text, size)
                held = np.zeros(BITS, dtype=np.uint8)
                held[(mix(units) % _U(BITS)).astype(np.int64)] = 1
                sizes.append(len(units))
                bits.append(np.packbits(held).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64()))], names=["id", "units", "bits"])

    return bodies.select("id", "text").mapInArrow(run, f"id {bodies.schema['id'].dataType.simpleString()}, units int, bits array<bigint>")


def _agree(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) >= AGREE


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """(id, class_id): one row per distinct id; ``class_id`` is the smallest id of the documents linked to it by a chain of
    pairs whose weighted Jaccard similarity on ``size``-word shingles is at least ``threshold``.

    Words are runs without ASCII blanks, unchanged. Defined cases: equal texts are always one class, null counting as empty;
    a text with 1 to ``size`` - 1 words is one shingle; different texts without a word are not linked; rows with a null id are left out; rows that
    repeat an id are one document, linked to what any of its texts is linked to; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    content = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content")
    signed = stored(signatures(docs.select("id", content, "text"), "text", size), "signatures")
    # equal texts: the signature follows the content, so the aggregate keeps one of each before the shuffle
    distinct = stored(
        signed.groupBy("content").agg(F.min("id").alias("id"), F.first("coords").alias("coords"), F.first("keys").alias("keys")),
        "distinct",
    )
    members = distinct.select("id", F.posexplode("keys").alias("band", "key"))
    buckets = cut(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    sized = cut(members.join(buckets, ["band", "key"]))
    met = cut(sized.groupBy("id").agg(F.sum("n").alias("met")))
    centres = cut(sized.join(met, "id").groupBy("band", "key").agg(F.max(F.struct("met", "id")).getField("id").alias("centre")))
    bucketed = cut(sized.drop("n").join(centres, ["band", "key"]))

    wanted = bucketed.select("id").distinct()  # both ends of every candidate of either round are in a bucket
    bodies = stored(
        docs.join(wanted.hint("shuffle_hash"), "id", "left_semi").groupBy("id", content).agg(F.first("text").alias("text")).drop("content"),
        "bodies")
    coords = distinct.select("id", "coords")

    def links(pairs: DataFrame) -> DataFrame:
        near = (
            pairs.join(coords.toDF("a", "coords_a"), "a").join(coords.toDF("b", "coords_b"), "b")
            .filter(_agree(F.col("coords_a"), F.col("coords_b"))).select("a", "b")
        )
        both = near.join(bodies.toDF("a", "text_a"), "a").join(bodies.toDF("b", "text_b"), "b")
        return cut(verified(both.select("a", "b", "text_a", "text_b"), size, threshold))

    stars = links(bucketed.filter(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    # members that their bucket's centre isn't linked to are compared with the bucket's others, inside the join
    linked = stars.select(F.col("a").alias("centre"), F.col("b").alias("id"), F.lit(True).alias("linked"))
    others = cut(bucketed.filter(F.col("id") != F.col("centre")).join(linked, ["centre", "id"], "left").select(
        "band", "key", "id", F.col("linked").isNull().alias("loose")))
    open_buckets = cut(
        others.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.max("loose").alias("loose")).filter("loose and n > 1").select("band", "key"))
    side = cut(others.join(open_buckets, ["band", "key"]))
    facts = side.join(cut(_bitmaps(bodies.join(side.select("id").distinct(), "id", "left_semi"), size).join(distinct.select("id", "coords", "keys"), "id")), "id")
    left, right = (facts.select("band", "key", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "loose", "units", "bits", "coords", "keys")]) for x in "ab")
    differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, v: n + v)
    bound = differ * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("a_units") + F.col("b_units")) + 1e-6
    once = ~F.col("b_loose") & (F.col("a_id") != F.col("b_id")) | (F.col("a_id") < F.col("b_id"))
    # a pair is compared in the first bucket it shares: there one of the two is loose, or both are linked to its centre
    shared = F.zip_with("a_keys", "b_keys", lambda x, y: x == y)
    new = ~F.exists(F.slice(shared, F.lit(1), F.col("band")), lambda v: v)
    open_pairs = (
        left.filter("a_loose").join(right, ["band", "key"]).filter(once & new & bound & _agree(F.col("a_coords"), F.col("b_coords")))
        .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    )
    twins = signed.select("id", "content").join(distinct.select("content", F.col("id").alias("rep")), "content").filter(F.col("id") != F.col("rep"))
    classes = connected_components(stars.union(links(open_pairs)).toDF("src", "dst").union(twins.select("rep", "id")))
    return (
        docs.select("id").distinct().join(classes.toDF("id", "class"), "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"))
    )

