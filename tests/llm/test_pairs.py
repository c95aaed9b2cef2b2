"""Vector links, lexical search and token alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presage.llm import alignment, lemp, pstable
from tests.llm import plain

LEFT, RIGHT = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
VECTORS = "vec_id long, embedding array<double>, label int, uid string, rep int, same string, n long, u int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", None, 2) for i, label, v in rows], VECTORS).repartition(3)


def check_links(out, rows, cosine):
    want = plain.linked_vectors(rows, cosine)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, ((r["vec_id"], r["n_links"], r["component_id"]) for r in out))) == sorted(key((rows[k][0], n, c)) for k, (n, c) in want.items())
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)


def some_vectors(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (12, 24))
    rows = [(int(i), int(i % 4), (centers[i % 12] + rng.normal(0, 0.05 if i % 3 else 0.2, 24)).tolist()) for i in rng.permutation(n)]
    return rows + [(1000 + i, 1, [x * (1 + i % 3) for x in rows[0][2]]) for i in range(40)]


def test_vector_links_equal_all_pairs(spark):
    rows = some_vectors(500, 1)
    rows += [(2000 + k, 3, [math.cos(0.15 * k), math.sin(0.15 * k)] + [0.0] * 22) for k in range(12)]  # a chain
    check_links(pstable.near_vectors(vectors(spark, rows)).collect(), rows, 0.98)


def test_vector_links_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(pstable, "BLOCK_ROWS", 16)  # buckets meet as pairs of blocks
    monkeypatch.setattr(pstable, "PAIRS_AT_ONCE", 50)
    rows = some_vectors(260, 2)
    check_links(pstable.near_vectors(vectors(spark, rows)).collect(), rows, 0.98)


def test_vector_links_of_odd_tables(spark):
    v, nan, inf = [1.0, 2.0, -1.0], float("nan"), float("inf")
    rows = [(1, 1, v), (2, 1, v), (2, 1, v), (3, 2, v), (4, None, v), (5, None, v), (None, 1, v), (None, None, None), (6, 1, None), (7, 1, []), (8, 1, [0.0] * 3),
            (9, 1, [0.0] * 3), (10, 1, [nan, 1.0, 1.0]), (11, 1, [inf, 1.0, 1.0]), (12, 1, [None, 1.0, 2.0]), (13, 1, [1e-200, 2e-200, -1e-200]),
            (14, 1, [1e200, 2e200, -1e200]), (15, 1, v[:2]), (16, 1, v[:2]), (17, 1, [-x for x in v]), (0, 2, [2.0, 4.0, -2.0]), (18, 5, v)]
    check_links(pstable.near_vectors(vectors(spark, rows)).collect(), rows, 0.98)
    assert pstable.near_vectors(vectors(spark, rows).limit(0)).count() == 0
    assert pstable.near_vectors(vectors(spark, rows).where("vec_id = 6")).first()["n_links"] == 0


def test_vector_links_leave_no_pairs(spark, monkeypatch):
    rows = [(i, 1, (np.array([1.0] * 8) + np.random.default_rng(i).normal(0, 0.01, 8)).tolist()) for i in range(300)]
    written = {}
    real = pstable.staged
    monkeypatch.setattr(pstable, "staged", lambda df, name="x": written.setdefault(name, real(df, name)))
    out = pstable.near_vectors(vectors(spark, rows)).collect()
    assert {r["n_links"] for r in out} == {299}
    tables = len(written["signed-vectors"].first()["keys"])
    assert written["vector-links"].count() <= 300 * tables  # a row for a vector and a bucket, of 44,850 links


def test_parameters_follow_rows_and_threshold():
    rng = np.random.default_rng(3)
    sample = pa.table({"label": ["a"] * 400, "dim": [32] * 400, "v": rng.normal(size=(400, 32)).tolist()})
    bits, tables = zip(*(pstable.parameters(sample, n, 0.98) for n in (10**3, 10**5, 10**7)))
    assert bits[0] < bits[1] < bits[2] and tables[0] < tables[1] < tables[2]
    assert all((1 - pstable.shared_step(0.2) ** b) ** t <= pstable.MISS * 1.01 for b, t in zip(bits, tables))
    x = rng.normal(size=(400, 16))
    near = x + rng.normal(size=x.shape) * 0.3
    keys = pstable.Tables(16, 1, 1000, 5)
    d = np.sqrt(((x - near) ** 2).sum(axis=1))
    assert (keys.keys(x) == keys.keys(near)).mean() == pytest.approx(pstable.shared_step(d).mean(), abs=0.015)


def texts_and_items(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "and"]) if rng.random() < 0.5 else f"w{int(rng.expovariate(0.02))}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 300])))) for i in range(300)]
    items = [(k, " ".join(word() for _ in range(12)) + (" | " + docs[k][1][:200] if k % 2 else "")) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_everything(spark, monkeypatch, small):
    if small:  # many buckets, most of them in the second round, and several blocks of queries
        for name, value in (("BUCKET_ROWS", 8), ("FIRST_ROWS", 20), ("BLOCK_TERMS", 100)):
            monkeypatch.setattr(lemp, name, value)
    docs, items = texts_and_items(4)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, terms string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item int, score string")
    out = [tuple(r) for r in lemp.search(frame, asked).collect()]
    assert sorted(out) == sorted(plain.lexical_ranks(docs, items, 10))


def test_search_of_odd_tables(spark, odd, odd_rows, nothing):
    items = [(1, "alpha BETA of"), (1, "gamma"), (None, "über señor"), (2, ""), (3, None), (4, "nothing has this"), (5, "the the THE"), (6, "one"), (None, "z" * 60_000)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    out = [tuple(r) for r in lemp.search(odd, asked).collect()]
    want = plain.lexical_ranks([r[:2] for r in odd_rows], items, 10)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out)) == sorted(map(key, want))
    assert lemp.search(nothing, asked).count() == 0 and lemp.search(odd, asked.limit(0)).count() == 0


def test_bounds_rule_out_rows_but_no_hit():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 30, 500)
    ids = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in sizes])
    values = rng.integers(1, 10**6, len(ids))
    norms = np.sqrt(np.add.reduceat(values.astype(float) ** 2, np.append(0, np.cumsum(sizes))[:-1]))
    bucket, left = lemp.Bucket(ids, values, sizes, norms), 0
    for k in range(20):
        of = rng.choice(200, 12, replace=False)
        q = lemp.Query(k, of, rng.integers(1, 9000, 12))
        weights = np.zeros(200, np.int64)
        weights[q.ids] = q.weights
        scores = bucket.scores(np.arange(500), weights)
        bar = int(np.sort(scores)[-10])
        alive = bucket.survivors(q, bar)
        assert set(np.flatnonzero(scores >= bar)) <= set(alive)
        assert q.norm * bucket.longest >= scores.max()
        left += len(alive)
    assert left < 0.5 * 20 * 500


def test_length_norm_stays_exact():
    n = np.array([1, 5, 10**9])
    assert lemp.length_norm(n, 10**10, 10**12).tolist() == [10 + 90 * int(x) * 10**10 // 10**12 for x in n]


HARD = ["", " ", "  two  spaces ", "a\r\nb\tc\n\n d", "é ñ ß ﬁ Å á", "漢字かな 한국어 العربية", "x▁y z", "\x00\x01", "<s> </s> <unk> <0x0A>", "<|endoftext|> x",
        "😀👩‍👩‍👧 🇩🇪", "　x", "1234567 12.5%", "'s don't WE'LL", "a" * 3000, " " * 500 + "x", "\n" * 300, "▁", "ﷺ​﻿", "z " * 50]


def plain_tokens(text):
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(LEFT), sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    left.encode_special_tokens = True
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in right.encode(text):
        p = right.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()))
    want = (b" " + text.encode()) if text else b""
    return (a, b) if want and b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain_statistics(texts):
    tokens = [plain_tokens(t or "") for t in texts]
    links = [plain.overlaps(a, b) for a, b in tokens]
    n = Counter(p for of in links for p in set(of))
    most = Counter()
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    for (a, b), of in zip(tokens, links):
        groups = plain.aligned_groups(a, b)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (len(a), len(b), len(groups), len(of), sum(n[p] == most[p[0]] for p in of), sum(n[p] for p in of),
               hashlib.sha256(said.encode()).hexdigest() if a else "")


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [0, 30, alignment.HEAD])
def test_alignment_equals_plain_version(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "AT_ONCE", 400)
    rng = random.Random(head)
    texts = [*HARD, None, *("".join(rng.choice(HARD[1:13])[:20] for _ in range(6)) for _ in range(20)), "the same", "the same", "the cat sat on the mat"]
    docs = spark.createDataFrame([(k if k % 7 else None, t, 0, "p") for k, t in enumerate(texts)], "doc_id long, text string, uid int, pairs string").repartition(3)
    out = alignment.link_statistics(docs, LEFT, RIGHT, head).collect()
    want = [(str(k if k % 7 else None), *x) for k, x in enumerate(plain_statistics(texts))]
    assert sorted((str(r["doc_id"]), *(r[c] for c in COUNTS)) for r in out) == sorted(want)


def test_token_groups_say_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    left, right = alignment.byte_side(LEFT), alignment.piece_side(RIGHT)
    for r in alignment.token_groups(docs, LEFT, RIGHT).collect():
        a, b = plain_tokens(HARD[r["doc_id"]])
        assert r["a_ids"] == [i for i, _ in a] and r["b_ids"] == [i for i, _ in b]
        for g in range(max(r["a_groups"], default=-1) + 1):
            of_a, of_b = ([ids[k] for k, x in enumerate(groups) if x == g] for ids, groups in ((r["a_ids"], r["a_groups"]), (r["b_ids"], r["b_groups"])))
            assert b"".join(left.pieces[i] for i in of_a) == b"".join(right.pieces[i] for i in of_b) != b""


def test_alignment_of_odd_tables(odd, odd_rows, nothing):
    out = alignment.link_statistics(odd, LEFT, RIGHT).collect()
    assert Counter(str(r["doc_id"]) for r in out) == Counter(str(r[0]) for r in odd_rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[d][c] == 0 for d in (4, 5) for c in COUNTS[:-1]) and by[4]["groups_sha256"] == by[5]["groups_sha256"] == ""
    assert by[6]["n_links"] > 0 and by[9]["n_a"] > 10_000
    assert alignment.link_statistics(nothing, LEFT, RIGHT).count() == 0


def test_side_equals_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    left, ours = Tokenizer.from_file(LEFT), alignment.byte_side(LEFT)
    left.encode_special_tokens = True
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select(F.col("text")).limit(300).collect():
        assert ours.encode(r["text"]) == left.encode(" " + r["text"], add_special_tokens=False).ids
    for text in (" " * 1_000_000, "a" + "\n" * 300_000 + "b", "\t \u3000" * 1000 + "x", "z" * 200_000):
        assert len(b"".join(ours.pieces[i] for i in ours.encode(text))) == 1 + len(text.encode())
