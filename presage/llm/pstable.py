"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosines.

Vectors are brought to length 1, where a cosine of c is a distance of sqrt(2 - 2c). A table's key
is made of ``bits`` projections on normal directions, each shifted and cut into steps of ``WIDTH``:
near vectors share a step with a chance that depends on their distance alone. The number of
projections is the least that leaves a vector about ``CANDIDATES`` far ones in its bucket, judged by
a sample of ``SAMPLE_ROWS`` rows; the number of tables then follows from ``MISS``, the chance that a
pair right at the threshold shares no bucket.

Equal vectors of a label are one class and only classes are hashed. Members of a bucket are compared
by exact cosines in double precision; buckets above ``BLOCK_ROWS`` are cut into blocks that meet
pairwise in tasks of their own. A pair counts in the first table in which it meets, so nothing has
to be made distinct, and a task returns a count for each of its vectors and a forest of its links,
never the pairs.

Defined results: only rows of one label and one number of components are compared; a row without
vec_id, label or vector, or whose vector is empty, zero or holds a null or non-finite component, is
linked with nothing and its own component; repeated rows are vectors of their own, told apart by
a number; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.llm.common import hash128
from presage.llm.groups import components
from presage.session import staged

WIDTH, CANDIDATES, MISS = 2.0, 256, 1e-6
SAMPLE_ROWS, MOST_BITS = 2000, 24
BLOCK_ROWS, PAIRS_AT_ONCE = 512, 200_000


def shared_step(distance: np.ndarray | float) -> np.ndarray:
    """The chance that two vectors at a distance fall into the same step of one projection."""
    r = WIDTH / np.maximum(distance, 1e-9)
    tail = np.vectorize(lambda x: math.erfc(x / math.sqrt(2.0)))(r)
    return 1.0 - tail - 2.0 / (math.sqrt(2.0 * math.pi) * r) * (1.0 - np.exp(-(r**2) / 2.0))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of equal width at length 1, in double precision whatever their scale."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tables:
    """Projections of all tables for vectors of one width."""

    def __init__(self, dim: int, bits: int, tables: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.bits, self.tables = bits, tables
        self.directions = rng.normal(size=(dim, bits * tables))
        self.shifts = rng.uniform(0.0, WIDTH, bits * tables)
        self.mix = rng.integers(1, 2**63, bits * tables, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        steps = np.floor((x @ self.directions + self.shifts) / WIDTH).astype(np.int64).view(np.uint64)
        mixed = (steps * self.mix).reshape(len(x), self.tables, self.bits).sum(axis=2, dtype=np.uint64)
        return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parameters(sample: pa.Table, rows: int, cosine: float) -> tuple[int, int]:
    """Projections a table and tables, by the distances of a sample that are above the threshold."""
    near = math.sqrt(max(2.0 - 2.0 * cosine, 0.0))
    far: list[np.ndarray] = []
    n = sample.num_rows
    if n > 1:
        label, dim = sample.column("label").to_numpy(zero_copy_only=False).astype(str), sample.column("dim").to_numpy()
        groups = np.unique([f"{d} {x}" for x, d in zip(label, dim)], return_inverse=True)[1]
        for g in range(groups.max() + 1):
            x = unit(sample.filter(pa.array(groups == g)).column("v").combine_chunks())
            d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ x.T), 0.0))[np.triu_indices(len(x), 1)]
            far.append(d[d > near])
    chances = shared_step(np.concatenate(far)) if far and sum(map(len, far)) else np.empty(0)
    share = 2.0 / (n * (n - 1)) if n > 1 else 0.0  # of all pairs, those of different labels too
    bits = 1
    while bits < MOST_BITS and rows * share * (chances**bits).sum() > CANDIDATES:
        bits += 1
    found = float(shared_step(near)) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-found))) if found < 1 else 1


def _usable(vector: Column) -> Column:
    """A vector of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


BUCKET = ("label", "dim", "at", "key", "i", "j")


def _links_of_bucket(rows: pa.RecordBatch | pa.Table, tables: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (p, q) of the links of one bucket or pair of blocks that meet here first."""
    at, i, j = (rows.column(c)[0].as_py() for c in ("at", "i", "j"))
    own = rows.column("own").to_numpy()
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right) or len(left) + len(right) < 2 or (i == j and len(left) < 2):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    column = rows.column("v")
    x = unit(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    near = x[left] @ x[right].T >= cosine
    p, q = np.nonzero(np.triu(near, 1) if i == j else near)
    p, q = left[p], right[q]
    if at and len(p):
        keys = rows.column("keys")
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        keys = keys.flatten().to_numpy().reshape(-1, tables)[:, :at]
        new = np.concatenate([
            ~(keys[p[k : k + PAIRS_AT_ONCE]] == keys[q[k : k + PAIRS_AT_ONCE]]).any(axis=1) for k in range(0, len(p), PAIRS_AT_ONCE)])
        p, q = p[new], q[new]
    return p, q


def _forest(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions a position that it is connected with, itself for one of each part."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[p], label[q])
        after = label.copy()
        np.minimum.at(after, label[p], least)
        np.minimum.at(after, label[q], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _runs(batch: pa.Table) -> np.ndarray:
    """Where buckets start in sorted rows, with the end."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in BUCKET:
        x = batch.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def links_in_buckets(placed: DataFrame, tables: int, cosine: float) -> DataFrame:
    """u, n: how many links each vector has here; u, v: a forest of them. ``placed`` has whole buckets in each
    partition, in order."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            u, v, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                bucket = rows.slice(a, b - a)
                p, q = _links_of_bucket(bucket, tables, cosine)
                if not len(p):
                    continue
                ids, copies = bucket.column("rep").to_numpy(), bucket.column("copies").to_numpy()
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                root, hit = _forest(p, q, len(ids)), np.flatnonzero(links)
                u.append(ids[hit]), v.append(ids[root[hit]]), n.append(links[hit])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v, n)], ["u", "v", "n"])

        held: list[pa.RecordBatch] = []  # of the bucket that the last batch ended in, and may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, end = ([batch.column(c)[k].as_py() for c in BUCKET] for k in (0, batch.num_rows - 1))
            if held and first == end == last:
                held.append(batch)
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _runs(rows)
            yield settle(rows, starts[:-1])
            held, last = rows.slice(starts[-2]).to_batches(), end
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield settle(rows, np.array([0, rows.num_rows]))

    return placed.mapInArrow(check, "u long, v long, n long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.98, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector. Links are between rows of one label whose cosine
    is ``cosine`` or more."""
    rows = staged(embeddings.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.when(_usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("embedding")).alias("v"),
    ).withColumn("same", F.when(F.col("v").isNotNull(), hash128("v"))), "vectors")
    # equal vectors have equal digests, so any of them will do
    classes = staged(rows.where("v is not null").groupBy("label", "same").agg(
        F.min("uid").alias("rep"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"),
    ).withColumn("dim", F.size("v")), "vector-classes")
    drawn = classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(SAMPLE_ROWS).select("label", "dim", "v").toArrow()
    bits, tables = parameters(drawn, classes.count(), cosine)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), np.empty((batch.num_rows, tables), np.int32)
            for dim in np.unique(dims).tolist():
                of = known[dim] if dim in known else known.setdefault(dim, Tables(dim, bits, tables, seed))
                at = np.flatnonzero(dims == dim)
                keys[at] = of.keys(unit(batch.column("v").take(pa.array(at))))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "keys"])

    plain = classes.select("rep", "label", "dim", "copies", "v")
    kinds = ", ".join(f"{c} {t}" for c, t in plain.dtypes)
    signed = staged(plain.mapInArrow(sign, f"{kinds}, keys array<int>"), "signed-vectors")

    tabled = ("label", "dim", "at", "key")
    # stored, so that the planner knows how few they are before it deals out vectors
    crowded = staged(signed.select("label", "dim", F.posexplode("keys").alias("at", "key")).groupBy(*tabled).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > BLOCK_ROWS).select(*tabled, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")), "crowded")
    dealt = signed.select("*", F.posexplode("keys").alias("at", "key")).join(crowded, list(tabled), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("parts")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "parts")
    found = staged(links_in_buckets(placed.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "rep"), tables, cosine), "vector-links")

    linked = components(found.where("u != v").select("u", "v")).withColumnRenamed("node", "rep")
    counted = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    named = classes.select("rep", "label", "same", "least", "copies").join(counted, "rep", "left").join(linked, "rep", "left").withColumn(
        "root", F.coalesce("component", "rep"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    judged = named.join(heads, "root").select("label", "same", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    return rows.drop("v").join(judged, ["label", "same"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
