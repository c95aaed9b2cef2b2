"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.llm import cascade, lines, mixing, packing, superminhash
from presage.session import staged

TOKENIZER = "word_bpe_49k.json"

#: Clean texts may be short, and half of a short text may be a line that it repeats: only junk is rejected here.
RULES = (*cascade.JUNK_ANY, cascade.repeated(50, least_words=50))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cascade.keep_documents(docs, RULES)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.keep_firsts(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Rules, signatures, draws and packing aren't SQL: tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
