"""Personal data by fixed patterns and by bootstrapped contexts.

Base spans are found by pattern: e-mail addresses, IPv4 addresses, card numbers (Luhn)
and international phone numbers. They are seeds, and so are values that a text assigns to
one of ``SECRET_WORDS``. Every seed, and every other token that looks like an identifier
(``MIN_LENGTH`` characters with ``MIN_DIGITS`` digits), is an instance. Its patterns are the two
words or signs before it, the one before with the one after, and, of tokens that mix letters
and digits, the shape: how many letters and digits follow one another. Instances and patterns
of the whole corpus are the two sides of a graph. Seeds score 1. In each round a pattern's
confidence is the summed score of its instances over their number plus one, patterns below
``CONFIDENT`` or with fewer than ``SUPPORT`` believed instances count nothing, and an instance
scores as a noisy-or of its patterns. At the end tokens in confident patterns, seeds of secrets
too, are spans of kind ``context``.

Defined results: a null text is empty; base spans always stay; spans are in code points,
end exclusive; kinds stand in the order email, ip, card, phone, context, then by start;
repeated rows get equal rows; a null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.llm.common import small_batches
from presage.session import staged

# The patterns of the four base kinds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
BORDER = frozenset(" \t\n\r\x0b\x0c\"'=:,;()<>[]{}")
TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c\"'=:,;()<>\[\]{}]*")
CONTEXT = re.compile(r"[^\W\d_]+|[=:#]")

#: Names of things whose values are kept secret. They only start the search: other names are learned from it.
SECRET_WORDS = ("accesskey", "apikey", "auth", "credential", "iban", "passphrase", "passport", "passwd", "password", "pwd", "secret", "secretkey", "ssn", "token")
ASSIGN = re.compile(r"[:=]")
NAME = re.compile(r"([A-Za-z][A-Za-z_-]*)[\"']?[ \t]{0,3}$")
VALUE = re.compile(r"[ \t]{0,3}[\"']?")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
RUNS = re.compile(r"[0-9]+|[^\W\d_]+|[\W_]+")

MIN_LENGTH, MIN_DIGITS, REACH = 6, 3, 60
ROUNDS, CONFIDENT, SUPPORT = 3, 0.7, 3


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, from each @ outwards: a run of local characters is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d if (d := 2 * int(c)) < 10 else d - 9 for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def identifiers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with digits that look like identifiers and stand outside the taken spans."""
    taken, k, at = sorted(taken), 0, 0
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in BORDER:
            start -= 1
        at = TOKEN.match(text, m.start()).end()
        end = at
        while text[end - 1] in ".!?-":
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        if end - start >= MIN_LENGTH and sum(map(str.isdigit, text[start:end])) >= MIN_DIGITS:
            yield start, end


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values of ``SECRET_WORDS``: the token after ``name =`` or ``name:``, if it holds a digit."""
    for m in ASSIGN.finditer(text):
        name = NAME.search(text, max(0, m.start() - REACH), m.start())
        if name and re.sub("[_-]", "", name.group(1).lower()) in SECRET_WORDS:
            start = VALUE.match(text, m.end()).end()
            end = TOKEN.match(text, start).end()
            if end - start >= MIN_LENGTH and DIGIT.search(text, start, end):
                yield start, end


def shape(token: str) -> str | None:
    """Lengths of runs of letters, digits and others, of tokens that have both letters and digits."""
    if token.isdigit() or not DIGIT.search(token) or not any(map(str.isalpha, token)):
        return None
    if HEX.fullmatch(token):
        return f"{'hex' if token.islower() else 'HEX'}{len(token)}"
    return "".join(f"{'9' if r[0].isdigit() else 'a' if r[0].isalpha() else r[0]}{len(r)}" for r in RUNS.findall(token))


def patterns(text: str, start: int, end: int) -> list[str]:
    before = CONTEXT.findall(text[max(0, start - REACH) : start].lower())[-2:]
    after = CONTEXT.findall(text[end : end + REACH].lower())[:1]
    form = shape(text[start:end]) if end - start <= REACH else None
    out = [f"like {form}"] if form and len(form) <= REACH else []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


MENTIONS = """uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string,
    found array<struct<start: long, end: long, instance: string, seed: boolean, base: boolean, patterns: array<string>>>"""


def mentions(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and the list of base spans, and every instance with its patterns. ``uid``
    is the task's number and a count, so it holds once the rows are stored."""
    small_batches(docs.sparkSession)
    of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.string()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, base, found = [[] for _ in KINDS], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for kind, into in zip(KINDS, counts):
                    into.append(sum(s[0] == kind for s in spans))
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                own = [(a, b) for _, a, b in spans]
                secrets = sorted({s for s in assigned(text) if not any(a < s[1] and s[0] < b for a, b in own)})
                found.append([
                    {"start": a, "end": b, "instance": text[a:b].lower(), "seed": seed, "base": is_base, "patterns": patterns(text, a, b)}
                    for seed, is_base, pairs in ((True, True, own), (True, False, secrets), (False, False, identifiers(text, own + secrets))) for a, b in pairs
                ])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(range(uid, uid + n), pa.int64()), batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                pa.array(base, pa.string()), pa.array(found, of),
            ], ["uid", "doc_id", *(f"n_{k}" for k in KINDS), "base", "found"])
            uid += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, MENTIONS)


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """pattern, confidence: the patterns that the graph of patterns and instances believes at the end."""
    said = seen.select(F.explode("found").alias("m")).select("m.instance", "m.seed", F.explode("m.patterns").alias("pattern"))
    edges = staged(said.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed")), "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    for k in range(rounds):
        believed = edges.join(scores, "instance").groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"),
            F.count(F.when(F.col("score") >= confident, 1)).alias("n"),
        ).where((F.col("confidence") >= confident) & (F.col("n") >= support)).drop("n")
        believed = staged(believed, f"patterns-{k}")
        scores = edges.join(believed, "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))))).alias("score"))
    return believed


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each document."""
    seen = staged(mentions(docs), "mentions")
    believed = confident_patterns(seen)
    loose = seen.select("uid", F.explode("found").alias("m")).where("not m.base").select("uid", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    more = loose.join(believed.select("pattern"), "pattern", "left_semi").groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    text = F.transform("more", lambda s: F.concat_ws(":", F.lit("context"), s["start"], s["end"]))
    return seen.drop("found").join(more, "uid", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text).alias("spans"),
    )
