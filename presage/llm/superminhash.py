"""Near-duplicates by SuperMinHash, banding, full verification and union-find groups.

A document's set is its distinct shingles of ``n`` consecutive words. SuperMinHash gives
each element a permutation of the ``SLOTS`` slots, drawn step by step: at step j it gets
a random rank in [j, j + 1) for the j-th slot of its permutation, and a slot keeps the
least rank. Slots share elements' ranks without repetition, which lowers the variance,
and an element stops once j passes the largest rank that any slot still holds.

Documents with equal sets form a class and only its first member goes on. Signatures are
cut into ``BANDS`` bands of ``ROWS`` slots; documents that agree in a band meet in its
bucket. With 4 slots a band and 32 bands a pair of similarity 0.8 is missed with a chance
of 5e-8. In a bucket everyone is compared with one
leader, the document that meets most others, on full sets; links are joined to components.
What a leader leaves apart is then compared with the rest of its group, block by block:
how two documents differ from their leader says exactly how much they share, and an index
of these differences finds it without going through pairs one by one. So a group of near
copies costs a comparison or two a document, and no link that could join two components
is left out.

Components: edges are first contracted by union-find inside each task to at most a
forest; then smallest labels are passed along (large-star, small-star) until they rest.

Defined results: with fewer than n words the whole sequence is one shingle; without words
or with null text the set is empty and linked with nothing; equal non-empty sets are
linked; a null doc_id takes part in no link and is its own component (null); repeated
doc_ids are one document by their id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import small_batches
from presage.llm.groups import components
from presage.session import staged

ROWS, BANDS = 4, 32
SLOTS = ROWS * BANDS
CACHE_WORDS = 400_000
#: A block of documents that a leader left apart, or of its group.
BLOCK_ROWS, BLOCK_BYTES = 48, 4_000_000
#: Documents of a leader that are compared with it in one part.
PART_ROWS = 64
#: Keys that the pairs of one leader are dealt to before its parts are known.
SALTS = 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = set(words).difference(known)
        known.update(zip(new, map(xxhash.xxh3_64_intdigest, new)))
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(ids))
        with np.errstate(over="ignore"):
            out = mix64(ids[: len(ids) - n + 1] + np.uint64(n))
            for k in range(1, n):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
        return np.unique(out)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A signature for each set: the least rank of each slot, inf for an empty set. Step j runs for all sets at
    once; a set drops out once j is not below the largest rank that one of its slots holds."""
    sig = np.full((len(sets), slots), np.inf)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    perm = None
    with np.errstate(over="ignore"):
        for j in range(slots):
            if j:
                runs = (sig.max(axis=1) > j)[owner]
                items, owner, perm = items[runs], owner[runs], perm[runs] if perm is not None else None
                first = first[runs] if perm is None else None
            if not len(items):
                break
            x = mix64(items + np.uint64(2 * j + 1) * np.uint64(0x9E3779B97F4A7C15))
            rank = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
            pick = j + (mix64(x + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)).astype(np.int64) % (slots - j)
            if j == 0:
                slot = first = pick
            else:
                place = np.arange(len(items))
                if perm is None:  # most texts fill all slots at step 0 and never need permutations
                    perm = np.tile(np.arange(slots, dtype=np.int16), (len(items), 1))
                    perm[place, 0], perm[place, first] = first, 0
                slot = perm[place, pick].astype(np.int64)
                perm[place, pick] = perm[place, j]
                perm[place, j] = slot
            np.minimum.at(sig.reshape(-1), owner * slots + slot, rank)
    return sig


def signatures(sets: list[np.ndarray], at_once: int = 16_000) -> np.ndarray:
    """``superminhash`` for a batch of sets, in parts of bounded total size."""
    out, part, size = [], [], 0
    for x in sets:
        if part and size + len(x) > at_once:
            out.append(superminhash(part))
            part, size = [], 0
        part.append(x)
        size += len(x)
    return np.concatenate([*out, superminhash(part)])


def band_keys(sig: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    slots = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1, ROWS)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(mix64(np.arange(slots.shape[1], dtype=np.uint64) + np.uint64(seed << 20)), slots.shape[:2])
        for k in range(ROWS):
            keys = mix64((keys ^ slots[:, :, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return keys


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def signed_sets(docs: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set and a key for each band. The sets are not kept: they
    are larger than the texts they come from."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            keys = band_keys(signatures(sets), seed).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64)), BANDS).cast(pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


COMPARED = "u long, part int, v long, n_u long, n_v long, both long, apart binary"


def dealt_to_parts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, part, v) and (u, parts): the documents of a leader u in parts of about ``PART_ROWS``. Whatever goes to
    pairs by their leader goes to every part, so no key of a join is hot."""
    sizes = staged(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts")), "parts")
    large = sizes.where("parts > 1").select("u", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(SALTS)).cast("int")
    part = F.pmod(F.xxhash64("v", F.lit(4)), F.coalesce("parts", F.lit(1))).cast("int")
    return staged(pairs.withColumn("salt", salt).join(large, ["u", "salt"], "left").select("u", part.alias("part"), "v"), "pairs"), sizes


def to_parts(leaders: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each part of each leader that has one."""
    return leaders.join(sizes, "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def compared(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, n: int, differences: bool) -> DataFrame:
    """u, part, v, the sizes of their full sets and of what they share. With ``differences`` also the elements that
    only one of them has, those of u told apart by a flipped bit."""
    small_batches(pairs.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, mine = Shingles(n), None, None
        for batch in batches:
            counts, apart = [], []
            for u, tu, tv in zip(batch.column("u").to_pylist(), batch.column("tu").to_pylist(), batch.column("tv").to_pylist()):
                if u != last:  # rows of a leader come one after another
                    last, mine = u, shingles(tu)
                other = shingles(tv)
                both = np.intersect1d(mine, other, assume_unique=True)
                counts.append((len(mine), len(other), len(both)))
                apart.append(np.concatenate([
                    np.setdiff1d(other, both, assume_unique=True), ~np.setdiff1d(mine, both, assume_unique=True),
                ]).tobytes() if differences else None)
            columns = [pa.array(x, pa.int64()) for x in zip(*counts)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("u", "part", "v")), *columns, pa.array(apart, pa.binary())], ["u", "part", "v", "n_u", "n_v", "both", "apart"])

    leaders = to_parts(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), sizes)
    placed = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
    # merged, so that the rows of a leader come one after another and its set is made once
    return placed.hint("merge").join(leaders.hint("merge"), ["u", "part"]).select("u", "part", "v", "tu", "tv").mapInArrow(check, COMPARED)


def linked(overlap, n_u, n_v, percent: int):
    return 100 * overlap >= percent * (n_u + n_v - overlap)


def links_of_block(block: pa.Table, percent: int) -> pa.Table:
    """u, v of documents that the leader of their group left apart (side 0) and any others of it (side 1). With
    o_x, o_y elements in common with the leader of n_u elements, two documents share exactly
    o_x + o_y - n_u + (differences from the leader that they share) elements."""
    side = block.column("side").to_numpy()
    ids, parts, n, both, n_u = (block.column(c).to_numpy() for c in ("v", "component", "n_v", "both", "n_u"))
    apart = [np.frombuffer(x, np.uint64) for x in block.column("apart").to_pylist()]
    right = np.flatnonzero(side == 1)
    tokens = np.concatenate([apart[j] for j in right] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(right)), [len(apart[j]) for j in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found = []
    for i in np.flatnonzero(side == 0):
        low, high = np.searchsorted(tokens, apart[i], "left"), np.searchsorted(tokens, apart[i], "right")
        hit = low < high
        at = np.concatenate([owner[a:b] for a, b in zip(low[hit], high[hit])] or [np.empty(0, np.int64)])
        overlap = both[i] + both[right] - n_u[i] + np.bincount(at, minlength=len(right))
        for j in right[linked(overlap, n[i], n[right], percent) & (parts[right] != parts[i])]:
            found.append((ids[i], ids[j]))
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def left_apart(compared_pairs: DataFrame, sizes: DataFrame, found: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """u, v of the links between documents that meet in a bucket and that its leader has not joined.

    Each group of a leader is cut into blocks; every block of documents outside the leader's component meets
    every block of the group in a task of its own, which finds links by an index of differences."""
    label = found.withColumnRenamed("component", "c")
    leaders = sizes.select("u").join(label.withColumnRenamed("node", "u"), "u", "left").select("u", F.coalesce("c", "u").alias("own"))
    placed = compared_pairs.select("u", "part", "v").join(label.withColumnRenamed("node", "v"), "v", "left").select(
        "u", "part", "v", F.coalesce("c", "v").alias("component"))
    placed = staged(placed.join(to_parts(leaders, sizes), ["u", "part"]).select("u", "part", "v", "component", (F.col("component") != F.col("own")).alias("outside")), "placed")
    open_groups = placed.groupBy("u").agg(F.count(F.lit(1)).alias("all"), F.count_if("outside").alias("out")).where("all > 1 and out > 0").select("u")
    members = staged(placed.join(to_parts(open_groups, sizes), ["u", "part"]), "apart")
    open_sizes = sizes.join(open_groups, "u", "left_semi")
    detail = compared(members.select("u", "part", "v"), open_sizes, texts, n, True).drop("part").withColumnsRenamed({"u": "x", "v": "y"})
    rows = staged(members.join(detail, (F.col("u") == F.col("x")) & (F.col("v") == F.col("y"))).drop("x", "y"), "differences")
    blocks = staged(rows.groupBy("u").agg(
        F.ceil(F.greatest(F.count_if("outside") / BLOCK_ROWS, F.sum(F.when(F.col("outside"), F.octet_length("apart"))) / BLOCK_BYTES)).cast("int").alias("outs"),
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.octet_length("apart")) / BLOCK_BYTES)).cast("int").alias("alls")), "blocks")
    sized = rows.join(to_parts(blocks, open_sizes), ["u", "part"])
    own = lambda seed, parts: F.pmod(F.xxhash64("v", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    values = ("u", "v", "component", "n_v", "both", "n_u", "apart")
    left = sized.where("outside").select(*values, F.lit(0).alias("side"), own(1, "outs").alias("i"), every("alls").alias("j"))
    right = sized.select(*values, F.lit(1).alias("side"), own(2, "alls").alias("j"), every("outs").alias("i"))
    # rows lie by leader after the join; dealt anew, the blocks of a large group go to many tasks
    dealt = left.unionByName(right).repartition("u", "i", "j")
    return dealt.groupBy("u", "i", "j").applyInArrow(lambda t: links_of_block(t, percent), "u long, v long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each document. ``docs`` is read twice."""
    signed = staged(signed_sets(docs, n), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = staged(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    slots = firsts.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    shared = slots.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = staged(slots.join(shared, "key"), "members")
    # the document that meets most others leads its buckets: in a group of copies the one that they come from
    met = members.groupBy("id").agg(F.sum("members").alias("met"))
    led = members.join(met, "id").groupBy("key").agg(F.min(F.struct(-F.col("met"), F.col("id").alias("id"))).alias("leader"))
    pairs, sizes = dealt_to_parts(staged(members.join(led, "key").select(F.col("leader.id").alias("u"), F.col("id").alias("v")).where("u != v").distinct(), "met"))
    wanted = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    # ids grow with the documents: they are merged, not broadcast while they happen to be few
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    star = staged(compared(pairs, sizes, texts, n, False).drop("apart"), "star")
    links = star.where(linked(F.col("both"), F.col("n_u"), F.col("n_v"), percent)).select("u", "v")
    found = components(links)
    more = staged(left_apart(star, sizes, found, texts, n, percent), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    grouped = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("keys").join(grouped, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component"))
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(own, F.col("doc_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_firsts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all their columns: of each group the first by doc_id (null first) and hash of the
    text. Rows are told apart by stored numbers, so those that share a doc_id or have none are compared like all
    others; of rows with one doc_id and no word one stays."""
    rows = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    judged = near_duplicates(rows.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")), n, percent).select(
        F.col("doc_id").alias("uid"), "n_shingles", "component_id")
    named = rows.select("uid", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("h")).join(judged, "uid")
    wordless = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    firsts = named.groupBy(F.when(~wordless, F.col("component_id")).alias("of"), F.when(wordless, F.col("id")).alias("of_id")).agg(
        F.min(F.struct("id", "h", "uid")).alias("first")).select("first.uid")
    return rows.join(firsts, "uid", "left_semi").select("row.*")
