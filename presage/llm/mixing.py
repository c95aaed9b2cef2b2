"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources, ordered by code point with null last, share the total size by weight;
a target stops at ``max_copies`` times its source's size and the excess is shared again
by weight until none is above.

Every document of a source asks for target / size copies. The whole part is given; the
fractional parts, equal within a source, are rounded by the pivotal method: the unit in
hand meets the next smaller one, and words move from one to the other at random until
one of them is whole; the other stays in hand. That keeps the words of all together, and
what is in hand at the end is small.
Groups of about ``GROUP`` units run at once; each hands one fractional unit to the next
level, where the units of a source meet again, until every source has one. The last is
rounded to the nearer, so a source misses its target by half a document at most. Draws
come from a hash of what a row says and of the level, so reruns agree.

Defined results: a null or empty text has size 0; sources with no words take nothing;
repeated rows are told apart by a number and rounded one by one; an empty table gives an
empty one. Columns other than doc_id, text, source are ignored by ``mix``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import n_words
from presage.session import staged

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
GROUP = 4096
EDGE = 1e-9


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, size, place: places from 0 by code point, null last. Counted by ranges, so no task gets all."""
    ordered = staged(
        sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources",
    )
    before = {}
    total = 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before[r["part"]], total = total, total + r["count"]
    starts = F.lit(0)
    for part, start in before.items():
        starts = F.when(F.col("part") == part, start).otherwise(starts)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.select("source", "size", (rank + starts).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, size, target. Each pass shares the words that no stopped source holds; sources only ever stop."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    weighed = staged(ranked_sources(sizes).select("source", "size", weight.alias("weight")), "weights")
    limit = F.col("size") * float(max_copies)
    total = float(weighed.agg(F.sum("size")).first()[0] or 0)
    rate, stopped = None, -1
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * rate > limit
        row = weighed.agg(
            F.sum(F.when(over, limit)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == stopped or not row["weight"]:
            break
        stopped, rate = row["n"], (total - float(row["held"] or 0)) / float(row["weight"])
    share = F.col("weight") * float(rate or 0)
    return weighed.select("source", "size", F.least(share, limit).alias("target"))


def _meet(p: float, q: float, s: float, t: float, draw: float) -> tuple[float, float]:
    """One step of the pivotal method for two units of s and t words: words move from one to the other until one
    is whole. The words of both together, and the expectation of each, stay."""
    to_p, to_q = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    moved = to_p if draw * (to_p + to_q) < to_q else -to_q
    return p + moved / s, q - moved / t


def round_group(probs: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """All but at most one of the units become 0 or 1, in the given order. Units without words are drawn alone."""
    out = probs.astype(float).copy()
    hand = -1
    for i in range(len(out)):
        if not EDGE < out[i] < 1 - EDGE:
            out[i] = round(out[i])
        elif not sizes[i]:
            out[i] = draws[i] < out[i]
        elif hand < 0:
            hand = i
        else:
            out[hand], out[i] = _meet(out[hand], out[i], sizes[hand], sizes[i], draws[i])
            for k in (hand, i):
                if not EDGE < out[k] < 1 - EDGE:
                    out[k] = round(out[k])
            hand = hand if 0 < out[hand] < 1 else i if 0 < out[i] < 1 else -1
    return out


UNITS = "source string, uid long, key long, spread long, size long, mass double"


def _level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Round within (source, part); a source has as many parts, by a hash, as its units need."""

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), *((c, "ascending") for c in ("key", "spread", "uid"))])
        out = round_group(*(group.column(c).to_numpy() for c in ("mass", "size", "draw")))
        return group.select(["source", "uid", "key", "spread", "size"]).append_column("mass", pa.array(out))

    draw = F.pmod(F.xxhash64("key", "spread", F.lit(seed), F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
    part = F.pmod(F.xxhash64("key", "spread", F.lit(seed + 1), F.lit(level)), F.col("parts"))
    counts = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")).withColumnRenamed("source", "s")
    dealt = units.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "uid", "key", "spread", "size", "mass", draw.alias("draw"), part.alias("part"))
    return dealt.groupBy("source", "part").applyInArrow(rounded, UNITS)


def copies(rows: DataFrame, seed: int = 17) -> DataFrame:
    """uid, copies for stored ``rows`` (source, uid, key, size, rate): the whole part of the rate and the rounded
    rest. ``uid`` only tells rows apart; chance hangs on ``key``, a hash of what a row says. Only rows that are
    equal more than ``GROUP`` times are spread by uid, so that no part gets too many."""
    whole = F.floor("rate")
    many = rows.groupBy("key").count().where(F.col("count") > GROUP).select(F.col("key").alias("many"))
    units = rows.join(many, F.col("key") == F.col("many"), "left").select(
        "source", "uid", "key", F.when(F.col("many").isNotNull(), F.col("uid")).otherwise(0).alias("spread"), "size", (F.col("rate") - whole).alias("mass"))
    settled, level = [], 0
    is_open = (F.col("mass") > 0) & (F.col("mass") < 1)
    while True:
        units = staged(_level(units, level, seed), f"mix-{level}")
        settled.append(units.where(~is_open))
        left = units.where(is_open)
        n, n_sources = left.select(F.count(F.lit(1)), F.count_distinct(F.struct("source"))).first()
        if n == n_sources:  # one unit of each source, or none
            settled.append(left.withColumn("mass", F.round("mass")))
            break
        units, level = left, level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return rows.select("uid", whole.alias("whole")).join(out.select("uid", "mass"), "uid").select(
        "uid", (F.col("whole") + F.col("mass")).cast("long").alias("copies"))


def _mixed(rows: DataFrame, weights: tuple[float, ...], max_copies: int, seed: int) -> DataFrame:
    read = staged(rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), "uid",
        F.xxhash64("doc_id", "source", "text").alias("key"),
    ), "sizes")
    sources = targets(read.groupBy("source").agg(F.sum("size").alias("size")), weights, max_copies).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    rated = staged(read.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "rated")
    return rated.join(copies(rated, seed), "uid").drop("rate", "key")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """doc_id, uid, size, source, source_size, target, copies: a row for each document. ``uid`` numbers the rows
    as they are read and is stored with them."""
    return _mixed(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("uid")), weights, max_copies, seed)


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them."""
    stored = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "numbered")
    taken = _mixed(stored.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col("row.text").alias("text")),
                   weights, max_copies, seed).where("copies > 0").select("uid", "copies")
    return stored.join(taken, "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
