"""Best-fit packing of tokenized documents under several capacities at once.

Documents become pieces of at most ``tokens`` ids. Pieces are dealt by a hash into groups
of about ``GROUP_PIECES``; each group is packed on its own, longest piece first. A piece asks for (tokens, 1 document, length^2 of attention) and goes to the open bin that has
room in every dimension and is left with the smallest weighted residual norm, or with
the largest weighted dot-product of residual and demand; if none has room, it opens a bin.
Pieces of bins that stayed poorly filled are dealt and packed once more together.

Defined results: a null or empty text is one piece that holds the end id; null doc_ids
are kept; repeated rows are packed one by one; no documents, no pieces. Other columns
are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import ceil_div, small_batches
from presage.session import staged

GROUP_PIECES = 2048
#: Words whose ids a worker remembers, in two generations: when the younger one is full, the elder one goes. With
#: 200 bytes a word some 350 MB.
CACHE_WORDS = 1_800_000
#: A bin filled to this share is closed in the first round.
WELL_FILLED = 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", deal long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. ``weights`` are those of tokens, documents and attention cost."""

    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0 * 4096.0
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"  # or "dot"

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError("rule is 'norm' or 'dot'")
        if self.documents < 1 or self.attention < float(self.tokens) ** 2:
            raise ValueError("a full piece must fit an empty sequence")


#: A comma or full stop between an ASCII letter and white space is a token of its own.
TAIL = re.compile(rb"([A-Za-z])([.,])(?=\s|$)")


class WordIds:
    """Ids of texts by their words. The tokenizer's rules never reach over white space, it folds case, and it
    sets a mark after a letter apart; so texts are folded and such marks cut off, and every word met then is
    encoded once. Texts that might hold a special token aren't folded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.elder = Tokenizer.from_file(path), {}, {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        data = text.encode()
        return TAIL.sub(rb"\1 \2", data if b"<|" in data else data.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        if 2 * len(self.known) > CACHE_WORDS:
            self.known, self.elder = {}, self.known
        missing = words.difference(self.known)
        self.known.update((word, self.elder[word]) for word in missing if word in self.elder)
        new = [word for word in missing if word not in self.elder]
        for word, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            self.known[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, words: list[bytes]) -> bytes:
        """Little-endian ids of learned words."""
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut at ``tokens``."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(tokenizer)
        for batch in batches:
            texts = [ids.words(x or "") for x in batch.column(1).to_pylist()]
            ids.learn(set().union(*texts))
            rows, starts, lengths, crcs = [], [], [], []
            for i, words in enumerate(texts):
                data = ids.encode(words) + end
                for at in range(0, len(data), 4 * tokens):
                    part = data[at : at + 4 * tokens]
                    rows.append(i)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array([s // tokens for s in starts], pa.int32()),
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, the longest placed first."""
    n, limits = len(lengths), np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left, ids = np.empty((n, 3)), np.empty(n, np.int64)  # open bins: residual shares, bin numbers
    used = np.zeros(n, np.int64)
    n_open = n_bins = 0
    least = np.array([lengths.min(), 1, float(lengths.min()) ** 2]) / limits if n else None
    for i in order:
        size = int(lengths[i])
        demand = np.array([size, 1, float(size) ** 2]) / limits
        fits = np.flatnonzero((left[:n_open] >= demand - 1e-12).all(axis=1))
        if len(fits):
            rest = left[fits]
            if capacity.rule == "norm":
                at = fits[np.argmin(((rest - demand) ** 2) @ weights)]
            else:
                at = fits[np.argmax(rest @ (weights * demand))]
        else:
            at, left[n_open], ids[n_open] = n_open, 1.0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        left[at] -= demand
        b = ids[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if (left[at] < least - 1e-12).any():  # nothing fits any more: close it
            n_open -= 1
            left[at], ids[at] = left[n_open], ids[n_open]
    return bins, offsets


def _round(pieces: DataFrame, groups: int, capacity: Capacity, base: int, final: bool) -> DataFrame:
    """Pack each group. Unless final, pieces of poorly filled bins get no sequence."""

    def pack(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        group = group.drop_columns(["group"])
        # the same group gives the same bins whatever order its rows come in
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32", "deal")])
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        none = np.zeros(len(bins), bool) if final else np.bincount(bins, lengths)[bins] < WELL_FILLED * capacity.tokens
        numbers = pa.array(base + (number << 32) + bins, mask=none)
        return group.append_column("sequence_id", numbers).append_column("offset", pa.array(offsets, mask=none))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(base)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, PACKED)


def _dealt(pieces: DataFrame) -> DataFrame:
    """Stored ``pieces`` with ``deal``, by which they go to groups: a hash of what a piece says and of which thousands
    of its part of the table it is in, so equal pieces of a part share a deal ``GROUP_PIECES`` times at most."""
    run = F.floor(F.monotonically_increasing_id() / GROUP_PIECES)
    return pieces.withColumn("deal", F.xxhash64("doc_id", "piece", "length", "ids_crc32", run))


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are read three times: pass a stored table."""
    first = staged(_round(_dealt(pieces), ceil_div(pieces.count(), GROUP_PIECES), capacity, 0, False), "packed")
    done, rest = first.where("sequence_id is not null"), first.where("sequence_id is null").drop("sequence_id", "offset")
    groups = ceil_div(rest.count(), GROUP_PIECES)
    return done.unionByName(_round(rest, groups, capacity, 1 << 62, True)).drop("deal")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    return pack(staged(tokenized_pieces(docs, tokenizer, capacity.tokens, end_id), "pieces"), capacity)
