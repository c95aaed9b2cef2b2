"""Ranked lexical search by buckets of vector length, with exact integer scores.

A document is a vector of term impacts, a query one of term weights, a score their inner product.
Coordinates that no query has add nothing to any product and are left out, which makes vectors
shorter and bounds tighter. Documents are ranged by length, longest first, and cut into buckets of
``BUCKET_ROWS`` rows or ``BUCKET_ENTRIES`` coordinates. A query passes over a bucket when its own
length times that of the bucket's longest vector is below the k-th score found so far
(Cauchy-Schwarz). Inside, only its heaviest coordinates are read from inverted lists: their part of
the product, plus the product of what is left of both lengths, bounds every row's score. Rows that
the bound doesn't rule out are scored in 64-bit integers. A first round over the ``FIRST_ROWS`` longest
documents gives every query a k-th score, with which the second round starts everywhere at once.

Queries go in blocks of about ``BLOCK_TERMS`` terms; only a block's weights and its terms' document
counts pass the driver, and each block is a pass over the documents.

Defined results: a null or empty text has no terms, and documents without
terms don't count in N and are never found; items that share an item_id (null is one) are one item
with the terms of all; repeated documents are ranked one by one; equal scores go to the smaller doc_id,
null last, then to the shorter document, then to the first row; no documents or items, no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import ceil_div, small_batches
from presage.session import staged

BLOCK_TERMS, FIRST_ROWS = 400_000, 16_384
BUCKET_ROWS, BUCKET_ENTRIES = 4096, 1_000_000
#: Heavy coordinates are read until no more than this share of a query's squared length is left.
REST = 0.03

# Terms are the longest runs of ASCII letters (A-Z folded), digits and all that isn't ASCII.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, terms: a row for each item_id."""
    small_batches(benchmark.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t.decode() for t in terms(x)}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    read_terms = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(read, "item_id long, terms array<string>")
    return read_terms.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).select(
        F.monotonically_increasing_id().alias("item"), "item_id", "terms")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """uid, doc_id, n, terms, tfs: length and counts of the terms that ``vocabulary`` numbers, for documents with
    terms."""
    small_batches(docs.sparkSession)
    known, size = docs.sparkSession.sparkContext.broadcast(vocabulary), max(1, len(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, get = TaskContext.get().partitionId() << 40, known.value.get
        for batch in batches:
            lengths, found = [], []
            for text in batch.column("text").to_pylist():
                said = terms(text)
                lengths.append(len(said))
                found.append([x for x in map(get, said) if x is not None])
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            keys, times = np.unique(rows * size + np.array([x for of in found for x in of], np.int64), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(found) + 1) * size).astype(np.int32)
            some = pa.array(np.array(lengths) > 0)
            out = pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(found))), batch.column("doc_id"), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((keys % size).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
            ], ["uid", "doc_id", "n", "terms", "tfs"])
            uid += len(found)
            yield out.filter(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        count, "uid long, doc_id long, n long, terms array<int>, tfs array<int>")


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m: 10 + (90 n N) div L, without leaving 64 bits."""
    if len(n) and 90 * docs * int(n.max()) >= 2**63:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * docs * n // max(1, total)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impacts(counted: DataFrame, docs: int, total: int) -> DataFrame:
    """uid, doc_id, n, terms, impacts, norm of the documents with a query term."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tfs = batch.column("n").to_numpy(), batch.column("tfs")
            sizes = np.diff(tfs.offsets.to_numpy())
            tf = tfs.flatten().to_numpy().astype(np.int64)
            values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(length_norm(n, docs, total), sizes))
            ends = np.append(0, np.cumsum(sizes))
            norm = np.sqrt(np.add.reduceat(values.astype(float) ** 2, ends[:-1])) if len(n) else np.empty(0)  # no row is empty
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("uid", "doc_id", "n", "terms")),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)), pa.array(norm),
            ], ["uid", "doc_id", "n", "terms", "impacts", "norm"])

    return counted.where(F.size("terms") > 0).mapInArrow(
        weigh, "uid long, doc_id long, n long, terms array<int>, impacts array<long>, norm double")


class Query:
    """Terms by weight, heaviest first, and how many of them are read before a row's bound is taken."""

    def __init__(self, item: int, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(-weights, kind="stable")
        self.item, self.ids, self.weights = item, ids[order], weights[order]
        squares = np.cumsum(self.weights.astype(float) ** 2)
        self.norm = math.sqrt(squares[-1]) if len(ids) else 0.0
        self.focus = int(np.searchsorted(squares, (1 - REST) * squares[-1])) + 1 if len(ids) else 0
        self.rest = math.sqrt(max(squares[-1] - squares[self.focus - 1], 0.0)) if len(ids) else 0.0


class Bucket:
    """Rows of about one length, with an inverted list for each of their coordinates."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray, norms: np.ndarray):
        self.ids, self.values, self.norms, self.longest = ids, values, norms, float(norms.max())
        self.ends = np.append(0, np.cumsum(sizes))
        order = np.argsort(ids, kind="stable")
        self.sorted, self.rows, self.listed = ids[order], np.repeat(np.arange(len(sizes)), sizes)[order], values[order]

    def survivors(self, q: Query, bar: float) -> np.ndarray:
        """Rows whose score can reach ``bar``; scores are integers, so rounding is left less than half a point."""
        product, taken = np.zeros(len(self.norms)), np.zeros(len(self.norms))
        for term, w in zip(q.ids[: q.focus], q.weights[: q.focus]):
            part = slice(*np.searchsorted(self.sorted, (term, term + 1)))
            rows, x = self.rows[part], self.listed[part].astype(float)
            product[rows] += w * x
            taken[rows] += x * x
        bound = product + q.rest * np.sqrt(np.maximum(self.norms**2 - taken, 0.0))
        return np.flatnonzero((bound > 0) & (bound * (1 + 1e-9) + 0.5 >= bar))

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact products of some rows with a query's weights by term."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        first = np.append(0, np.cumsum(sizes))[:-1]
        at = np.arange(sizes.sum()) + np.repeat(self.ends[rows] - first, sizes)
        return np.add.reduceat(weights[self.ids[at]] * self.values[at], first) if len(rows) else np.empty(0, np.int64)


FOUND = "item long, doc_id long, n long, uid long, score long"


def best_of(ranged: DataFrame, queries: list[Query], bars: dict[int, tuple], size: int, k: int) -> DataFrame:
    """item, doc_id, n, uid, score: the k best of each partition for each query, if they come before its bar, a row's
    place as (-score, no doc_id, doc_id, n, uid). ``ranged`` holds longer vectors before shorter ones."""
    small_batches(ranged.sparkSession)
    asked = ranged.sparkSession.sparkContext.broadcast((queries, bars))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = asked.value
        best: list[list[tuple]] = [[] for _ in block]
        last = [least.get(q.item, (0,)) for q in block]  # scores above 0
        bar = [max(1, -x[0]) for x in last]
        weights = np.zeros(size, np.int64)

        def take(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            column = {c: rows.column(c).combine_chunks() for c in ("terms", "impacts")}
            sizes = np.diff(column["terms"].offsets.to_numpy())
            bucket = Bucket(column["terms"].flatten().to_numpy(), column["impacts"].flatten().to_numpy(), sizes, rows.column("norm").to_numpy())
            doc, n, uid = rows.column("doc_id").to_pylist(), rows.column("n").to_numpy(), rows.column("uid").to_numpy()
            for at, q in enumerate(block):
                if q.norm * bucket.longest * (1 + 1e-9) + 0.5 < bar[at]:
                    continue
                alive = bucket.survivors(q, bar[at])
                if not len(alive):
                    continue
                weights[q.ids] = q.weights
                score = bucket.scores(alive, weights)
                weights[q.ids] = 0
                hit = np.flatnonzero(score >= bar[at])
                if len(hit) > k:  # ties with the k-th stay in
                    hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
                places = ((-s, doc[r] is None, doc[r] or 0, int(n[r]), int(uid[r])) for s, r in zip(score[hit].tolist(), alive[hit].tolist()))
                best[at] += [x for x in places if x < last[at]]
                if len(best[at]) > k:
                    best[at] = sorted(best[at])[:k]
                if len(best[at]) == k:
                    bar[at] = max(bar[at], -max(best[at])[0])

        held, n_rows, n_entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            n_rows, n_entries = n_rows + batch.num_rows, n_entries + len(batch.column("terms").flatten())
            if n_rows >= BUCKET_ROWS or n_entries >= BUCKET_ENTRIES:
                take(held)
                held, n_rows, n_entries = [], 0, 0
        if n_rows:
            take(held)
        out = [(q.item, None if none else doc, n, uid, -s) for q, of in zip(block, best) for s, none, doc, n, uid in of]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["item", "doc_id", "n", "uid", "score"])

    return ranged.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item. ``docs`` is read once for each block."""
    items = staged(items_of(benchmark), "items")
    n_terms = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, out = ceil_div(n_terms, BLOCK_TERMS), None
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        part = _search_block(docs, block, k)
        out = part if out is None else out.unionByName(part)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    asked = [(r["item"], [t.encode() for t in r["terms"]]) for r in block.select("item", "terms").collect()]  # BLOCK_TERMS bounds it
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, of in asked for t in of}))}
    counted = staged(term_counts(docs, vocabulary), "terms")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for a term of the block
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    queries = []
    for item, of in asked:
        ids = np.array([vocabulary[t] for t in of if vocabulary[t] in df], np.int64)
        queries.append(Query(item, ids, weights[ids]))
    vectors = staged(impacts(counted, n_docs, total or 0), "impacts")
    n_rows, size = vectors.count(), len(vocabulary)
    cut = vectors.agg(F.percentile_approx("norm", 1.0 - min(1.0, FIRST_ROWS / max(1, n_rows)), 1000)).first()[0]
    ranged = lambda rows: rows.repartitionByRange(F.desc("norm"), "uid").sortWithinPartitions(F.desc("norm"), "uid")
    long = staged(_ranked(best_of(ranged(vectors.where(F.col("norm") >= F.lit(cut or 0.0))), queries, {}, size, k), k), "longest")
    bars = {r["item"]: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n"], r["uid"]) for r in long.where(F.col("rank") == k).collect()}  # a row for an item
    rest = best_of(ranged(vectors.where(F.col("norm") < F.lit(cut or 0.0))), queries, bars, size, k)
    return _ranked(long.drop("rank").unionByName(rest), k)
