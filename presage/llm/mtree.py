"""Exact top-k by inner product with M-trees, searched best first.

Inner products become distances by one more coordinate: with M the largest norm, a stored
vector x gets sqrt(M^2 - |x|^2) and a query gets 0, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x and
the nearest vectors are those of the highest score.

Up to ``PIVOTS`` drawn vectors cut the space into regions; a region is dealt by a hash
into parts of some 512 to 65,536 rows, and each part becomes an M-tree. Its pages are nodes of at most ``PAGE`` entries. An entry
holds its object's distance to the node's routing object; entries of inner nodes also
hold the covering radius of the page below.

Queries are packed into blocks by region, each block one row. A query first searches one tree of
its own region, which bounds its k-th distance. Then its block goes to the trees whose region
can hold something as near to one of its queries, and no others. Within a tree pages are taken by
their least possible distance; |d(q, parent) - d(object, parent)| rules out entries before any
distance to them is computed. Answers of a query are at most k for each tree.

Vectors are integers here, so scores are exact; bounds leave room for rounding of roots.

Defined results: rows with a null vec_id or vector, or a vector with a null or non-finite
component, take no part; a shorter vector counts as padded with zeros; rows with the
query's own vec_id are not its candidates; equal scores go to the smaller vec_id;
repeated queries are one query, repeated candidates are each one; inner products that
could pass 2^53 raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presage.llm.common import ceil_div
from presage.session import staged

PIVOTS, PAGE, FANOUT, BLOCK, BATCH = 256, 128, 12, 4096, 64
#: What the vectors of a block of queries may take.
BLOCK_BYTES = 2_000_000
#: Rows of a tree: as many as leave TREES trees, within these bounds.
TREES, LEAST_ROWS, MOST_ROWS = 32, 512, 65_536


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, v array<long>: floor(scale * x) of every component, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where("vec_id is not null and embedding is not null").where(finite).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _distance(dots: np.ndarray, reach: float) -> np.ndarray:
    return np.sqrt(np.maximum(reach - 2.0 * dots, 0.0))


class Tree:
    """One M-tree. Objects are rows of ``x`` (with the added coordinate); nodes are (objects, their vectors,
    distances to the routing object, radii, child nodes), leaves without the last two."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norm2: float, seed: int = 1):
        rest = np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1), 0.0))
        self.ids, self.x, self.norm2 = ids, np.hstack([v, rest[:, None]]), norm2
        self.nodes: list[tuple] = []
        self._rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)), None)[0]
        del self._rng, self.x, self.ids

    def _from(self, obj: int, rows: np.ndarray) -> np.ndarray:
        return _distance(self.x[rows] @ self.x[obj], 2.0 * self.norm2)

    def _build(self, rows: np.ndarray, router: int | None) -> tuple[int, float]:
        """The node over ``rows`` and its covering radius around ``router``."""
        to = self._from(router, rows) if router is not None else np.zeros(len(rows))
        radius = float(to.max()) if len(rows) else 0.0
        if len(rows) <= PAGE:
            self.nodes.append((self.ids[rows], np.ascontiguousarray(self.x[rows, :-1]), to, None, None))
            return len(self.nodes) - 1, radius
        routers = self._rng.choice(rows, min(FANOUT, ceil_div(len(rows), PAGE)), replace=False)
        nearest = np.argmin(np.stack([self._from(r, rows) for r in routers]), axis=0)
        if np.bincount(nearest).max() > 0.9 * len(rows):  # equal or nearly equal objects: any even cut is as good
            nearest = np.arange(len(rows)) % len(routers)
        parts = [(int(r), rows[nearest == k]) for k, r in enumerate(routers) if (nearest == k).any()]
        below = [self._build(part, r) for r, part in parts]
        heads = np.array([r for r, _ in parts])
        self.nodes.append((self.ids[heads], np.ascontiguousarray(self.x[heads, :-1]), self._from(router, heads) if router is not None else np.zeros(len(heads)),
                           np.array([b[1] for b in below]), [b[0] for b in below]))
        return len(self.nodes) - 1, radius

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, bounds: np.ndarray) -> tuple[list[list[tuple[int, int]]], int]:
        """The k best (score, id) of each query within its bound, and how many distances were computed.

        The queries of a batch take pages together, the page that is nearest to any of them first; a query
        takes part in a page only while its own bounds don't rule the page out."""
        reach = (queries * queries).sum(axis=1) + self.norm2
        slack = 1e-6 * (1.0 + np.sqrt(reach))
        limit, best, computed, turn = bounds + slack, [[] for _ in queries], 0, 0
        everywhere = np.zeros(len(queries))
        pages: list[tuple[float, int, int, np.ndarray, np.ndarray | None]] = [(0.0, turn, self.root, everywhere, None)]
        while pages:
            least, _, at, low, parent = heapq.heappop(pages)
            if least > limit.max():
                break
            active = np.flatnonzero(low <= limit)
            ids, x, to, radii, below = self.nodes[at]
            if parent is None:
                near = np.arange(len(x))
            else:
                gap = np.abs(parent[active] - to[:, None]) - (0.0 if radii is None else radii[:, None])
                near = np.flatnonzero((gap <= limit[active]).any(axis=1))
            if not len(near) or not len(active):
                continue
            dots = (x if len(near) == len(x) else x[near]) @ queries[active].T
            computed += dots.size
            if radii is None:
                least_dot = (reach[active] - limit[active] ** 2) / 2.0
                for c in np.flatnonzero(dots.max(axis=0) >= least_dot):
                    q = active[c]
                    other = ids[near] != own[q]
                    mine = np.where(other, dots[:, c], -np.inf)  # its own rows, however many, take no place among the best
                    if len(mine) > k:
                        least_dot[c] = max(least_dot[c], np.partition(mine, -k)[-k])
                    hits = np.flatnonzero(other & (mine >= least_dot[c]))
                    found = [(-int(mine[i]), int(ids[near[i]])) for i in hits]
                    best[q] = sorted(best[q] + found)[:k]
                    if len(best[q]) == k:
                        limit[q] = min(limit[q], np.sqrt(max(reach[q] + 2.0 * best[q][-1][0], 0.0)) + slack[q])
            else:
                d = _distance(dots, reach[active])
                down = np.maximum(d - radii[near, None], 0.0)
                for r in np.flatnonzero((down <= limit[active]).any(axis=1)):
                    lows, parents = np.full(len(queries), np.inf), np.zeros(len(queries))
                    lows[active], parents[active] = down[r], d[r]
                    turn += 1
                    heapq.heappush(pages, (float(down[r].min()), turn, below[near[r]], lows, parents))
        return [[(-s, name) for s, name in b] for b in best], computed


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
    if len(flat) == len(column) * dim:
        return flat.reshape(len(column), dim).astype(float)
    out = np.zeros((len(column), dim))
    for i, v in enumerate(np.split(flat, ends[:-1])):
        out[i, : len(v)] = v
    return out


class Index:
    """Stored trees: ``trees`` (tree long, pages binary), and what routes a query to them."""

    def __init__(self, vectors: DataFrame, tree_rows: int | None = None, seed: int = 9):
        n, dim, norm2, most = vectors.select(
            F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)),
            F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), F.lit(0.0)),
            F.coalesce(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.lit(0)),
        ).first()
        if float(most) ** 2 * dim >= 2.0**53:
            raise ValueError("inner products could pass 2^53 and would not be exact")
        self.dim, self.norm2 = dim, norm2
        rows = tree_rows or min(max(n // TREES, LEAST_ROWS), MOST_ROWS)
        drawn = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(PIVOTS, ceil_div(n, rows))).toArrow()
        self.pivots = self._lifted(_matrix(drawn.column("v"), dim))
        regions = staged(self._routed(vectors), "regions")
        stats = {r["region"]: r for r in regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()}
        self.radii = np.array([stats[k]["radius"] if k in stats else -1.0 for k in range(len(self.pivots))])
        self.parts = [ceil_div(stats[k]["n"], rows) if k in stats else 0 for k in range(len(self.pivots))]
        parts = F.element_at(F.array(*map(F.lit, self.parts or [1])), (F.col("region") + 1).cast("int"))
        tree = (F.col("region") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(seed)), parts)).alias("tree")
        norm2, dim = self.norm2, self.dim

        def build(rows: pa.Table) -> pa.Table:
            number = rows.column("tree")[0].as_py()
            rows = rows.sort_by("id")
            pages = pickle.dumps(Tree(rows.column("id").to_numpy(), _matrix(rows.column("v"), dim), norm2))
            return pa.table({"tree": pa.array([number], pa.int64()), "pages": pa.array([pages], pa.binary())})

        self.trees = staged(regions.select(tree, "id", "v").groupBy("tree").applyInArrow(build, "tree long, pages binary"), "trees")

    def _lifted(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.norm2 - (v * v).sum(axis=1), 0.0))[:, None]])

    def _routed(self, vectors: DataFrame) -> DataFrame:
        pivots, dim, norm2, lifted = self.pivots, self.dim, self.norm2, self._lifted

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distance(lifted(_matrix(batch.column(1), dim)) @ pivots.T, 2.0 * norm2)
                region = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(region, pa.int64()), pa.array(d[np.arange(len(d)), region])], ["id", "v", "region", "d"])

        return vectors.select("id", "v").mapInArrow(route, "id long, v array<long>, region long, d double")

    def _blocks(self, queries: DataFrame, first: bool) -> DataFrame:
        """block, trees, queries: the queries of a region, or of neighbouring regions with few, in blocks of bounded size,
        each as one row with the trees that it has to see. ``queries`` has id, v and bound.

        ``first``: for each region of a block one of its trees. Else every other tree of the regions that may hold
        something within the bound of one of the block's queries."""
        pivots, radii, parts, dim, norm2 = self.pivots, self.radii, self.parts, self.dim, self.norm2
        size = max(BATCH, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = self_distance(_matrix(batch.column("v"), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1))], ["id", "v", "bound", "home"])

        def self_distance(v: np.ndarray) -> np.ndarray:
            d = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + norm2 - 2.0 * v @ pivots[:, :-1].T, 0.0))
            d[:, radii < 0] = np.inf
            return d

        homed = staged(queries.select("id", "v", "bound").mapInArrow(home, "id long, v array<long>, bound double, home long"), "homed")
        counts = {r["home"]: r["n"] for r in homed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # PIVOTS rows at most
        base, cut, number, room = [0] * len(pivots), [1] * len(pivots), 0, size
        for region in self._chain():
            n = counts.get(region, 0)
            if n > room:
                number, room = number + 1, size
            base[region], cut[region] = number, ceil_div(n, size)
            room -= n
            if n > size:
                number, room = number + cut[region], size
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("home") + 1).cast("int"))
        part = F.pmod(F.xxhash64("id", F.lit(2)), of(cut))
        dealt = homed.withColumn("part", part).withColumn("block", (of(base) + F.col("part")).cast("long"))

        def pack(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            ids, homes, part, bounds = (rows.column(c).to_numpy() for c in ("id", "home", "part", "bound"))
            v = _matrix(rows.column("v"), dim)
            own = (homes << 32) + part % np.array(parts)[homes]
            if first:
                trees = np.unique(own)
            else:
                reach = (v * v).sum(axis=1)[:, None] + norm2
                near = (self_distance(v) - radii <= bounds[:, None] + 1e-6 * (1.0 + np.sqrt(reach))).any(axis=0)
                trees = np.array([(int(r) << 32) + k for r in np.flatnonzero(near) for k in range(parts[r])], np.int64)
                if len(np.unique(own)) == 1:  # all of the block have seen it
                    trees = trees[trees != own[0]]
            return pa.table({
                "block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "trees": pa.array([trees], pa.list_(pa.int64())),
                "queries": pa.array([pickle.dumps((ids, v, bounds, own))], pa.binary())})

        return staged(dealt.groupBy("block").applyInArrow(pack, "block long, trees array<long>, queries binary"), "query-blocks")

    def _chain(self) -> list[int]:
        """Regions, each after the one that is nearest to it of those left."""
        left, out = set(range(1, len(self.pivots))), [0]
        while left:
            out.append(min(left, key=lambda r: float(((self.pivots[r] - self.pivots[out[-1]]) ** 2).sum())))
            left.remove(out[-1])
        return out

    def _answers(self, blocks: DataFrame, first: bool, k: int) -> DataFrame:
        """Search blocks in their trees. A tree and a block go to the task of each of their meetings as one row each."""
        pivots, radii, norm2 = self.pivots, self.radii, self.norm2

        def answer(tree: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple[int, int, int]] = []
            if tree.num_rows and asked.num_rows:
                held, number = pickle.loads(tree.column("pages")[0].as_py()), tree.column("tree")[0].as_py()
                names, v, bounds, own = pickle.loads(asked.column("queries")[0].as_py())
                region = number >> 32
                reach = (v * v).sum(axis=1) + norm2
                d = np.sqrt(np.maximum(reach - 2.0 * v @ pivots[region, :-1], 0.0))
                wanted = own == number if first else (own != number) & (d - radii[region] <= bounds + 1e-6 * (1.0 + np.sqrt(reach)))
                names, v, bounds = names[wanted], v[wanted], bounds[wanted]
                for at in range(0, len(names), BATCH):
                    part = slice(at, at + BATCH)
                    for name, best in zip(names[part], held.search(v[part], k, names[part], bounds[part])[0]):
                        out += [(int(name), other, score) for score, other in best]
            columns = list(zip(*out)) or [(), (), ()]
            return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), columns)})

        visits = blocks.select("block", F.explode("trees").alias("tree"))
        trees = visits.join(self.trees, "tree").select("tree", "block", "pages").groupBy("tree", "block")
        asked = blocks.select(F.col("block").alias("of_block"), F.explode("trees").alias("of_tree"), "queries").groupBy("of_tree", "of_block")
        return trees.cogroup(asked).applyInArrow(answer, "query_id long, vec_id long, score long")

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score of the k best candidates of every query."""
        asked = staged(queries.select("id", "v").distinct(), "queries")
        if not len(self.pivots):
            return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
        early = staged(self._answers(self._blocks(asked.withColumn("bound", F.lit(float("inf"))), True), True, k), "early")
        # the k-th score of the first tree; with fewer answers nothing is ruled out
        kth = early.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        bounded = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce(
            F.sqrt(F.greatest(norm + self.norm2 - 2.0 * F.col("worst"), F.lit(0.0))), F.lit(float("inf"))).alias("bound"))
        late = self._answers(self._blocks(bounded, False), False, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return early.unionByName(late).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")
