"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id, stored row number), so equal texts stand together
and the number, which only tells repeated rows apart, lets every range be cut. A
size-weighted sample of keys gives quantile boundaries; records fall into the ranges
between them, and the bytes of each range are counted over all records. A range of more
than twice its share is subdivided by keys sampled inside it, until none is left or one
row alone fills it. Consecutive ranges then make a shard: a range belongs to the shard
in which its middle byte lies. So shards differ by about a range, and a group of equal
texts is only cut where a boundary inside it is needed.

There are ``FINE`` ranges for each shard, or more once a range would hold more than
``RANGE_ROWS`` rows. The driver holds the boundaries, a count for each range and
``PER_RANGE`` sampled keys for each range: 24 bytes for every 60,000 rows at most.

Within a shard slots follow the order of keys: counts of ranges give where a range
starts, a window inside the range the rest.

Defined results: size is the text's UTF-8 bytes plus 1; a null text has none and crc 0; a
null doc_id comes first among equal texts; repeated rows get slots side by side; an empty
table gives an empty one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import ceil_div
from presage.session import staged

SHARDS = 8
FINE = 128
RANGE_ROWS = 1_000_000
PER_RANGE = 16
NO_ID = -(1 << 63)  # where a null doc_id stands

Key = tuple[int, int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """What a record is placed by. ``uid`` holds still once this is stored."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("h"),
        F.monotonically_increasing_id().alias("uid"),
    )


def in_ranges(rows: DataFrame, cuts: list[Key]) -> DataFrame:
    """``rows`` with ``range``: how many cuts are not above their key."""
    heads, ids, uids = (np.array([c[k] for c in cuts], np.int64) for k in range(3))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            doc = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
            low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
            uid = batch.column("uid").to_numpy()
            found = low.copy()
            for at in np.unique(low[low < high]):  # cuts inside a group of equal texts
                mine = np.flatnonzero((low == at) & (high > at))
                inside = ids[at : high[mine[0]]]
                first, last = at + np.searchsorted(inside, doc[mine], "left"), at + np.searchsorted(inside, doc[mine], "right")
                found[mine] = first
                for k in np.unique(first[first < last]):  # and inside a group of repeated rows
                    equal = np.flatnonzero((first == k) & (last > k))
                    found[mine[equal]] = k + np.searchsorted(uids[k : last[equal[0]]], uid[mine[equal]], "right")
            yield batch.append_column("range", pa.array(found, pa.int64()))

    return rows.mapInArrow(find, "doc_id long, size long, text_crc32 long, h long, uid long, range long")


def _draw(rows: DataFrame, unit: float, seed: int) -> list[tuple[int, int, int, int]]:
    """(h, doc_id, uid, range) of keys drawn with chance size / unit, by a hash of the row."""
    draw = F.pmod(F.xxhash64("h", "doc_id", "uid", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    found = rows.where(draw < F.col("size") / unit).select("h", F.coalesce("doc_id", F.lit(NO_ID)), "uid", "range")
    return sorted(tuple(r) for r in found.collect())


def _evenly(keys: list[Key], parts: int) -> list[Key]:
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def split_points(rows: DataFrame, shards: int = SHARDS, seed: int = 5, passes: int = 8) -> tuple[list[Key], list[tuple[int, int]]]:
    """The cuts, and (bytes, rows) of every range between them."""
    n, total = rows.select(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(shards * FINE, ceil_div(n, RANGE_ROWS))
    share = total / parts
    drawn = _draw(rows.withColumn("range", F.lit(0)), max(1.0, share / PER_RANGE), seed)
    cuts = _evenly([k[:3] for k in drawn], parts)
    for level in range(1, passes + 1):
        ranged = in_ranges(rows, cuts)
        least = F.struct("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "uid")
        stats = {r["range"]: r for r in ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(least).alias("low"), F.max(least).alias("high"),
        ).collect()}
        over = {k: r for k, r in stats.items() if r["bytes"] > 2 * share and r["low"] != r["high"]}
        if not over or level == passes:
            break
        inside: dict[int, list[Key]] = {}
        for *key, k in _draw(ranged.where(F.col("range").isin(list(over))), max(1.0, share / PER_RANGE), seed + level):
            inside.setdefault(k, []).append(tuple(key))
        more = {key for k, keys in inside.items() for key in _evenly(keys, max(2, round(over[k]["bytes"] / share)))}
        more |= {tuple(r["high"]) for r in over.values()}  # so that each pass divides each range
        if more <= set(cuts):
            break
        cuts = sorted({*cuts, *more})
    return cuts, [(stats[k]["bytes"], stats[k]["n"]) if k in stats else (0, 0) for k in range(len(cuts) + 1)]


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: a row for each document."""
    rows = staged(keyed(docs), "keys")
    cuts, counted = split_points(rows, shards, seed)
    share = max(sum(b for b, _ in counted) / shards, 1.0)
    shard_of, start_of, filled, before = [], [], [0] * shards, 0
    for size, n in counted:
        shard = min(shards - 1, int((before + size / 2) / share))
        shard_of.append(shard)
        start_of.append(filled[shard])
        filled[shard] += n
        before += size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = np.array(shard_of), np.array(start_of)
        for batch in batches:
            at = batch.column("range").to_numpy()
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(shard[at], pa.int32()),
                pa.array(start[at] + batch.column("rank").to_numpy() - 1, pa.int64()),
            ], ["doc_id", "size", "text_crc32", "shard", "slot"])

    rank = F.row_number().over(Window.partitionBy("range").orderBy("h", F.col("doc_id").asc_nulls_first(), "uid")).cast("long")
    return in_ranges(rows, cuts).withColumn("rank", rank).mapInArrow(
        place, "doc_id long, size long, text_crc32 long, shard int, slot long")
