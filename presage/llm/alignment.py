"""Alignment of two tokenizations of the same bytes, by pointer jumping.

Tokens of both sides are nodes of one array. Every token points to the farthest-right token that
overlaps it, on the other side; one that ends where a token of the other side ends has reached the
end of its group, and there the left side's token points to itself. Pointers are doubled for a whole
batch of texts at once until they rest at the last token of each group, which labels the group.

Links are pairs of tokens whose bytes overlap: one for each piece that the ends of both sides cut.
The corpus counts in how many documents an id pair is linked. Tasks add up what they have read before
anything is shuffled. The most frequent pairs, ``HEAD`` at most, meet documents as a broadcast table;
all others, whose counts are then small, meet theirs in a join, so no key of it is hot.

Defined results: a text that is null or empty, or that one of the sides can't give back byte by byte,
has no tokens and takes no part in counts; repeated rows are documents of their own; a null doc_id is
kept; no documents, no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import small_batches
from presage.session import staged

HEAD = 1 << 18
#: Bytes of text that are aligned at once, and id pairs that a task adds up before it passes them on.
AT_ONCE, PAIRS_AT_ONCE = 2_000_000, 4_000_000
BLANKS = re.compile(r"\s{2000}")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Side:
    """Ids of texts, and the bytes of every id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def ids(self, text: str, want: bytes) -> list[int] | None:
        """None if the ids don't say ``want``."""
        ids = self.encode(text)
        return ids if b"".join(map(self.pieces.__getitem__, ids)) == want else None


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level vocabulary; merges are in the order of ids, special tokens aren't looked for."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    letters = byte_letters()
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if all(c in letters for c in t)}
    named = {t: i for t, i in vocabulary.items() if re.fullmatch(r"<\|\w+\|>", t)}
    ranks = {t: i for t, i in ranks.items() if i not in named.values()}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        if BLANKS.search(text):  # the faster library's pattern would look back through all of them
            return slow.encode(" " + text, add_special_tokens=False).ids
        return encoding.encode_ordinary(" " + text)

    return Side(encode, pieces)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A piece vocabulary that puts a space before the text and spells unknown characters by bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        if model.is_unknown(i) or model.is_control(i):
            return b""
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return Side(lambda text: model.encode(text, num_threads=1), [spelled(i) for i in range(model.get_piece_size())])


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The label of every token, those of the left side first: the number of its group's last left token."""
    n = len(ends_a)
    # the token of the other side that holds a token's last byte is the farthest one that overlaps it
    over_b, over_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    met = ends_b[over_b] == ends_a if n else np.empty(0, bool)
    to = np.concatenate([np.where(met, np.arange(n), n + over_b), over_a])
    while True:
        farther = to[to]
        if (farther == to).all():
            return to
        to = farther


@dataclass
class Alignment:
    """A batch of texts: ids of both sides, groups and links, with the places where each text's part begins."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray  # of each token, counted over the batch
    group_b: np.ndarray
    link_a: np.ndarray  # token numbers of each link
    link_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    starts_groups: np.ndarray
    starts_links: np.ndarray


def align(texts: list[str | None], left: Side, right: Side) -> Alignment:
    ids = []
    for text in texts:
        want = b" " + text.encode() if text else b""
        a = left.ids(text, want) if text else None
        b = right.ids(text, want) if a is not None else None
        ids.append(([], []) if b is None else (a, b))
    a, b = (np.fromiter((i for of in ids for i in of[k]), np.int64, sum(len(of[k]) for of in ids)) for k in (0, 1))
    starts_a, starts_b = (np.append(0, np.cumsum([len(of[k]) for of in ids], dtype=np.int64)) for k in (0, 1))
    ends_a, ends_b = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
    last = group_ends(ends_a, ends_b)  # texts end on both sides at once, so groups never reach over them
    first_of = np.flatnonzero(last[: len(a)] == np.arange(len(a)))
    group = np.searchsorted(first_of, last)
    cuts = np.union1d(ends_a, ends_b)
    link_a, link_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return Alignment(
        a, b, group[: len(a)], group[len(a) :], link_a, link_b, starts_a, starts_b,
        np.searchsorted(first_of, starts_a), np.searchsorted(link_a, starts_a))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about ``AT_ONCE`` characters each."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += len(text or "")
    yield start, len(texts)


def _lists(values: np.ndarray, starts: np.ndarray, kind=np.int32) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(kind)))


def token_groups(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_groups, b_groups: the ids of each text by both tokenizers and each token's group."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(left), piece_side(right)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _parts(texts):
                x = align(texts[i:j], *sides)
                own_a, own_b = (np.repeat(x.starts_groups[:-1], np.diff(s)) for s in (x.starts_a, x.starts_b))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), _lists(x.a, x.starts_a), _lists(x.b, x.starts_b),
                    _lists(x.group_a - own_a, x.starts_a), _lists(x.group_b - own_b, x.starts_b),
                ], ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>")


class Writer:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``, and their digest."""

    def __init__(self, left: Side, right: Side):
        n = max(len(left.pieces), len(right.pieces))
        self.words = [b"%d%s" % (i, mark) for i in range(n) for mark in (b",", b"|", b";", b"")]

    def digests(self, x: Alignment) -> list[str]:
        n_groups = int(x.starts_groups[-1])
        in_a, in_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
        before_a, before_b = np.append(0, np.cumsum(in_a)), np.append(0, np.cumsum(in_b))
        mark_a, mark_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        mark_a[before_a[1:] - 1] = 1
        mark_b[before_b[1:] - 1] = 2
        some = np.flatnonzero(np.diff(x.starts_b))
        mark_b[x.starts_b[some + 1] - 1] = 3
        out = np.empty(len(x.a) + len(x.b), np.int64)
        out[np.arange(len(x.a)) + before_b[x.group_a]] = 4 * x.a + mark_a
        out[np.arange(len(x.b)) + before_a[x.group_b + 1]] = 4 * x.b + mark_b
        said, starts = out.tolist(), (x.starts_a + x.starts_b).tolist()
        word = self.words.__getitem__
        return [hashlib.sha256(b"".join(map(word, said[i:j]))).hexdigest() if j > i else "" for i, j in zip(starts, starts[1:])]


ALIGNED = """uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,
    pairs array<long>, times array<int>"""


def linked_pairs(docs: DataFrame, left: str, right: str) -> DataFrame:
    """A row for each document: counts, the digest of its groups, its distinct id pairs (left id << 32 | right id) and
    how often each is linked. ``uid`` is the task's number and a count, so it holds once the rows are stored."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(left), piece_side(right)
        writer, uid = Writer(*sides), TaskContext.get().partitionId() << 40
        n_right = len(sides[1].pieces)
        n_pairs = len(sides[0].pieces) * n_right
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _parts(texts):
                x = align(texts[i:j], *sides)
                of = np.repeat(np.arange(j - i), np.diff(x.starts_links))
                keys, times = np.unique((of * n_pairs) + x.a[x.link_a] * n_right + x.b[x.link_b], return_counts=True)
                ends = np.searchsorted(keys, np.arange(j - i + 1) * n_pairs)
                pairs = keys % n_pairs
                counts = (np.diff(s) for s in (x.starts_a, x.starts_b, x.starts_groups, x.starts_links))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + j - i)), batch.column("doc_id").slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in counts),
                    pa.array(writer.digests(x), pa.string()), _lists(pairs // n_right << 32 | pairs % n_right, ends, np.int64), _lists(times, ends),
                ], ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                uid += j - i

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, ALIGNED)


def document_counts(linked: DataFrame) -> DataFrame:
    """pair, n, best: in how many documents an id pair is linked, and whether no pair of its left id is in more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_keys, at = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return all_keys, np.bincount(at, np.concatenate([counts, np.ones(size, np.int64)]), len(all_keys)).astype(np.int64)

        for batch in batches:
            held.append(batch.column("pairs").flatten().to_numpy())
            size += len(held[-1])
            if size >= PAIRS_AT_ONCE:
                keys, counts = merged()
                held, size = [], 0
                if len(keys) >= PAIRS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    counted = staged(linked.select("pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    left = F.shiftright("pair", 32)
    most = counted.groupBy(left.alias("left")).agg(F.max("n").alias("most"))  # a row for an id of the left vocabulary
    return counted.join(most, left == F.col("left")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, head: int) -> int:
    """The least count that no more than ``head`` pairs reach, among powers of 2 by eighths."""
    step = F.floor(8 * F.log2("n")).alias("step")
    reached, least = 0, 0
    for r in counts.groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("step")).collect():
        reached += r["n"]
        if reached > head:
            return r["most"] + 1
        least = r["least"]
    return least


def link_statistics(docs: DataFrame, left: str, right: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each document."""
    linked = staged(linked_pairs(docs, left, right), "aligned")
    counts = staged(document_counts(linked), "document-counts")
    bar = frequent(counts, head)
    top = counts.where(F.col("n") >= bar).orderBy("pair").toArrow()  # ``head`` rows at most
    known = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = known.value
        n, best = np.append(n, 0), np.append(best, False)  # the last place is that of pairs not found
        for batch in batches:
            pairs, starts = batch.column("pairs").flatten().to_numpy(), batch.column("pairs").offsets.to_numpy()
            starts = starts - starts[0]
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pairs)
            there = np.zeros(len(pairs), bool)
            there[at < len(keys)] = keys[at[at < len(keys)]] == pairs[at < len(keys)]
            at = np.where(there, at, len(keys))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[starts])
            ends = np.append(0, np.cumsum(~there))[starts]
            yield pa.RecordBatch.from_arrays([
                batch.column("uid"), pa.array(total(times * best[at])), pa.array(total(times * n[at])),
                _lists(pairs[~there], ends, np.int64), _lists(times[~there], ends),
            ], ["uid", "n_best", "count_sum", "pairs", "times"])

    met = staged(linked.select("uid", "pairs", "times").mapInArrow(
        look_up, "uid long, n_best long, count_sum long, pairs array<long>, times array<int>"), "frequent-links")
    rest = met.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts.where(F.col("n") < bar), "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    none = F.lit(0).cast("long")
    return linked.drop("pairs", "times").join(met.drop("pairs", "times"), "uid").join(rest, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"), "groups_sha256")
