"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged into a block, which keeps the border between its texts as a control
string. A block reads

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control
string can occur there and reading back is exact. In roles a newline becomes ``\\n``.

``loss_runs`` marks what a model learns from: runs of (skip, take) characters that cover
the formatted text from its start, so their sums are its length.

Defined results: a null text or role is empty; turns are ordered by turn (null first),
then role, then text, so ties have one order; repeated rows are turns of their own; rows
without conv_id form one conversation; no rows, no conversation. Other columns are
ignored. One conversation is one output row and has to fit a row, as any text has.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"


def _quote(control: str) -> str:
    return control.replace("|", r"\|")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\G((?:[^\\]++|\\[^n])*+)\\n", "$1\n"))


def _blocks(turns: Column) -> Column:
    """Runs of turns with one role, their texts escaped: where a run starts, up to the next start."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(turns, a)["role"].alias("role"),
        F.transform(F.slice(turns, a + 1, b - a), lambda t: escape(t["text"])).alias("texts"),
    ))


def _runs(block: Column) -> Column:
    learned = block["role"] == LEARNED

    def run(text: Column, i: Column) -> Column:
        mark = F.when(i == 0, len(START) + 1 + F.length(escape_role(block["role"]))).otherwise(len(SEP))
        return F.struct(
            F.when(learned, mark).otherwise(mark + F.length(text)).alias("skip"),
            F.when(learned, F.length(text)).otherwise(0).alias("take"),
        )

    return F.concat(F.transform(block["texts"], run), F.array(F.struct(F.lit(len(END)).alias("skip"), F.lit(0).alias("take"))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs array<struct<skip, take>>: a row for each conversation."""
    empty = F.lit("")
    return (
        conversations.select("conv_id", F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
        ).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", _blocks(F.col("turns")).alias("blocks"))
        .select(
            "conv_id",
            F.array_join(F.transform("blocks", lambda b: F.concat(
                F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END),
            )), "").alias("formatted"),
            F.flatten(F.transform("blocks", _runs)).alias("loss_runs"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text was made of."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, _quote(SEP), -1), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, _quote(START), -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns))


def read_loss(formatted: Column, runs: Column) -> Column:
    """array<string>: the unescaped texts under the mask. Every run starts at a control string."""
    pieces = F.split(formatted, r"(?=<\|)", -1)
    taken = F.zip_with(pieces, runs, lambda p, r: F.when(r["take"] > 0, unescape(F.substr(p, r["skip"] + 1, r["take"]))))
    return F.filter(taken, lambda t: t.isNotNull())


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, read from its output alone."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_runs")), "").alias("loss"),
    ).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
