"""Line dedup by overlapping windows of three lines, with Spark expressions only.

Lines are parts between newlines. Lines that hold a word are numbered; three consecutive
numbered lines are a window, hashed to 128 bits. Of windows with equal lines in the whole
corpus the first, by (doc_id, text hash, number), stays; every later one covers its three
lines, except lines that the first window itself stands on. Covered lines are removed, so
overlapping windows merge and a repeated passage of any length from three lines goes whole.

Defined results: a null text stays null, and texts with fewer than three lines that hold
words stay as they are; lines without a word are never removed; a text may become empty.
Rows with equal doc_id and text are the same document: none of them counts as a later
occurrence of another. A null doc_id comes first in the order. Further columns are kept.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.llm.common import hash128

SPAN = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _numbered(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(HAS_WORD)))


def windows(docs: DataFrame) -> DataFrame:
    """doc struct<doc_id, a, b>, at, key: a row for each window."""
    lines = docs.where("text is not null").select(
        F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")).alias("doc"),
        _numbered(F.col("text")).alias("lines"),
    ).where(F.size("lines") >= SPAN)
    keys = lines.select("doc", F.transform("lines", lambda x: hash128(x)).alias("h"))
    return keys.select("doc", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("h") - SPAN),
        lambda i: hash128(*(F.get("h", i + k)[side] for k in range(SPAN) for side in "ab")),
    )).alias("at", "key"))


def covered_lines(docs: DataFrame) -> DataFrame:
    """doc, covered array<int>: numbered lines that later occurrences of a window stand on."""
    found = windows(docs)
    repeated = found.groupBy("key").agg(
        F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"),
    ).where("n > 1").select("key", "first")
    later = found.join(repeated, "key").where(F.struct("doc", "at") != F.col("first")).select(
        "doc", "at",
        # the first window's own lines, when this one overlaps it
        F.when(F.col("first.doc") == F.col("doc"), F.col("first.at") + SPAN).alias("own_end"),
    )
    return later.select("doc", F.explode(F.sequence(
        F.greatest(F.col("at"), F.coalesce("own_end", F.lit(0))), F.col("at") + SPAN - 1,
    )).alias("line")).groupBy("doc").agg(F.collect_set("line").alias("covered"))


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often a lambda inside asks for it."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, covered: Column) -> Column:
    """``text`` without its covered numbered lines. Places of numbered lines come from the text itself. Every array is
    bound before a lambda goes over it, so the work grows with the lines and not with their square."""

    def places(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(HAS_WORD)), i)), lambda i: i.isNotNull())

    def kept(lines: Column) -> Column:
        dropped = _with(places(lines), lambda of: F.transform(covered, lambda k: F.get(of, k)))
        return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)

    return _with(F.split(text, "\n", -1), lambda lines: F.array_join(_with(kept(lines), lambda at: F.transform(at, lambda i: F.get(lines, i))), "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns under ``row``, and ``text`` without repeated passages,
    ``n_lines`` (that hold a word) and ``n_removed`` beside them."""
    covered = covered_lines(docs)
    rows = docs.select(
        F.struct(*(F.col(c) for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"),
    )
    hit = covered.select(F.col("doc.doc_id").alias("c_id"), F.col("doc.a").alias("c_a"), F.col("doc.b").alias("c_b"), "covered")
    # hashes of a text are never null; only a null doc_id needs the null-safe part
    joined = rows.join(hit, (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b")) & F.col("id").eqNullSafe(F.col("c_id")), "left")
    text = F.col("row.text")
    return joined.select(
        "row",
        F.when(F.col("covered").isNull(), text).otherwise(_without(text, F.col("covered"))).alias("text"),
        F.coalesce(F.size(_numbered(text)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
