"""Packing, mixing, sharding, near-duplicates, top-k search and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from presage.llm import mixing, mtree, packing, sharding, superminhash
from presage.llm.groups import components
from tests.llm import plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for of in by.values():
        of.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in of] == list(np.cumsum([0] + [r["length"] for r in of])[:-1])
        assert sum(r["length"] for r in of) <= capacity.tokens and len(of) <= capacity.documents
        assert sum(r["length"] ** 2 for r in of) <= capacity.attention
    return len(by)


def test_packing_ids_and_pieces(odd, odd_rows, nothing):
    from tokenizers import Tokenizer

    tokenizer, capacity = Tokenizer.from_file(TOKENIZER), packing.Capacity(tokens=512, attention=512.0**2)
    out = packing.pack_documents(odd, TOKENIZER, capacity).collect()
    want = []
    for doc, text, *_ in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 512):
            part = np.array(ids[at : at + 512], "<u4")
            want.append((str(doc), at // 512, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("piece", "start", "length", "ids_crc32"))) for r in out) == sorted(want)
    n = check_packed(out, capacity)
    assert n <= -(-sum(w[3] for w in want) // 512) + 2
    assert packing.pack_documents(nothing, TOKENIZER).count() == 0


def test_packing_groups_of_pieces_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 16)
    rows = [(None, 0, 0, 4096, 7 if i % 2 else i) for i in range(400)]  # half of them equal, all without an id
    pieces = packing.staged(spark.createDataFrame(rows, packing.PIECES).repartition(3))
    out = packing.pack(pieces).collect()
    assert sorted(r["ids_crc32"] for r in out) == sorted(r[4] for r in rows) and check_packed(out, packing.Capacity()) == 400
    assert max(Counter(r["sequence_id"] >> 32 for r in out).values()) < 60


def test_word_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    rng, tokenizer, ids = random.Random(8), Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    parts = ["Don't", "a,", "b.", "!!.", "...", "x<|endoftext|>y", "<|ENDOFTEXT|>", "é", "́z", "İ.", "ß,", "12.5,", " q", "\x1cr", "漢字.", "'s.", "a.,", "O'Neill,"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 12)))
        words = ids.words(text)
        ids.learn(set(words))
        assert np.frombuffer(ids.encode(words), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    capacity = packing.Capacity(tokens=100, documents=4, attention=10_000.0, rule=rule)
    lengths = np.random.default_rng(2).integers(1, 101, 3000)
    bins, offsets = packing.best_fit(lengths, capacity)
    n = check_packed([{"sequence_id": b, "offset": o, "length": int(x)} for b, o, x in zip(bins, offsets, lengths)], capacity)
    assert n <= 1.05 * max(lengths.sum() / 100, len(lengths) / 4)
    tight = packing.Capacity(tokens=100, documents=100, attention=10_000.0)
    assert len(set(packing.best_fit(np.full(10, 10), tight)[0])) == 1
    with pytest.raises(ValueError):
        packing.Capacity(tokens=100, attention=5.0)


def test_targets_equal_plain_sharing(spark):
    rng = random.Random(6)
    for k in range(4):
        sizes = {f"s{i}é"[: 2 + i % 2]: rng.choice([0, 1, 5, 40, 1000]) for i in range(3 + 5 * k)} | {None: 7}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(plain.shared_targets(sizes, mixing.WEIGHTS, 3))


def test_rounding_keeps_words_and_expectation():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(0, 500, 60))
    probs, total = np.full(60, 0.37), np.zeros(60)
    for _ in range(1500):
        out = mixing.round_group(probs, sizes, rng.random(60))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert out[sizes > 0] @ sizes[sizes > 0] == pytest.approx(probs @ sizes)
        total += out
    assert np.abs(total / 1500 - 0.37).max() < 0.07


def test_mix_of_odd_tables(odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)  # several levels
    out = mixing.mix(odd).collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in odd_rows:
        sizes[source] += len(plain.WORDS.findall(text or ""))
    want = plain.shared_targets(sizes, mixing.WEIGHTS, 3)
    taken, most = defaultdict(int), defaultdict(int)
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert len(out) == len(odd_rows) and all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, mixing.mix(odd).collect())) == sorted(map(key, out))
    repeated = mixing.repeat_documents(odd)
    assert repeated.schema == odd.schema and repeated.count() == sum(r["copies"] for r in out)
    assert mixing.mix(nothing).count() == 0 and mixing.repeat_documents(nothing).count() == 0


def test_mix_tells_no_source_from_any_name(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(i, " ".join(["w"] * (1 + i % 7)), source) for i in range(60) for source in (None, "\0null", "a")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 180 and {r["source"] for r in out} == {None, "\0null", "a"}


def check_shards(out, rows, shards):
    want = [(str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted(want)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < shards
        by[r["shard"]].append(r)
    for of in by.values():
        assert sorted(r["slot"] for r in of) == list(range(len(of)))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    share = sum(sizes) / shards
    return max(abs(s - share) for s in sizes), share


def test_shards_are_even(spark):
    rng = random.Random(9)
    hot = "the same text again and again " * 3
    rows = [(i, hot if i % 3 == 0 else "w" * rng.choice([5, 50, 300])) for i in range(6000)]
    rows = [(d, t if t == hot else f"{d} {t}") for d, t in rows]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    off, share = check_shards(out, rows, 8)
    assert off < 0.02 * share
    assert len({r["shard"] for r in out if r["text_crc32"] == zlib.crc32(hot.encode())}) > 1  # the hot group is divided
    for shard in range(8):  # and in one order
        slots = [r["slot"] for r in out if r["shard"] == shard and r["text_crc32"] == zlib.crc32(hot.encode())]
        assert not slots or max(slots) - min(slots) == len(slots) - 1


def test_overfull_ranges_are_divided(spark):
    rows = spark.createDataFrame([(i, "x" if i < 900 else f"{i}") for i in range(1000)], "doc_id long, text string")
    keys = sharding.staged(sharding.keyed(rows))
    cuts, counted = sharding.split_points(keys, 8)
    assert max(b for b, _ in counted) < 1000 * 3 / 8 / 8 and sum(n for _, n in counted) == 1000


def test_repeated_rows_are_divided(spark):
    for hot in ((None, "x"), (7, "x y"), (None, None)):
        rows = [hot if i % 3 else (1000 + i, f"{i}") for i in range(3000)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        out = sharding.assign(frame).collect()
        off, share = check_shards(out, rows, 8)
        assert off < 0.02 * share


def test_shards_of_odd_tables(odd, odd_rows, nothing):
    check_shards(sharding.assign(odd).collect(), [r[:2] for r in odd_rows], 8)
    assert sharding.assign(nothing).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        shared = int(rng.integers(50, 250))
        a, b = np.unique(pool[: (300 + shared) // 2]), np.unique(pool[(300 - shared) // 2 :])
        s, t = superminhash.superminhash([a, b])
        errors.append(np.mean(s == t) - np.intersect1d(a, b).size / np.union1d(a, b).size)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045
    together = superminhash.signatures([a, np.empty(0, np.uint64), b], at_once=1)
    assert (together[0] == s).all() and (together[2] == t).all() and np.isinf(together[1]).all()
    one = superminhash.superminhash([a[:1]])[0]
    assert sorted(np.floor(one)) == list(range(superminhash.SLOTS))  # one element: each rank once


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1090)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, n):
    rng = random.Random(n)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(80)}" for _ in range(rng.choice([1, 3, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
            rows.append((doc, " ".join(words).upper() if doc % 5 == 0 else " ".join(words)))
            doc += 1
    chain = [f"c{i}" for i in range(400)]  # neighbours alike, ends not
    rows += [(500 + k, " ".join(chain[9 * k : 9 * k + 130])) for k in range(12)]
    rows += [(900, ""), (901, None), (902, " \t"), (903, "É a"), (904, "é a")]
    out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, 80).collect()
    want = plain.near_components(rows, n, 80)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {d: len(plain.shingles(t, n)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_band_keys_tell_bands_and_slots_apart():
    sig = np.random.default_rng(1).random((50, superminhash.SLOTS))
    same = sig.copy()
    same[:, 5] += 1  # a slot of the second band
    a, b = superminhash.band_keys(sig, 3), superminhash.band_keys(same, 3)
    assert a.shape == (50, superminhash.BANDS) and len(np.unique(a)) == a.size
    assert ((a != b).sum(axis=0) == [50 if k == 1 else 0 for k in range(superminhash.BANDS)]).all()
    swapped = sig[:, [1, 0, *range(2, superminhash.SLOTS)]]
    assert (superminhash.band_keys(swapped, 3)[:, 0] != a[:, 0]).all() and (superminhash.band_keys(sig, 4) != a).all()


@pytest.mark.parametrize("part", [3, 64])
def test_large_group_of_near_copies(spark, monkeypatch, part):
    monkeypatch.setattr(superminhash, "PART_ROWS", part)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(90)] = f"x{rng.randrange(9999)}"
        rows.append((d, " ".join(words)))
    out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == plain.near_components(rows, 2, 80)


def test_near_duplicates_of_odd_tables(odd, odd_rows, nothing):
    out = superminhash.near_duplicates(odd, 5, 80).collect()
    assert len(out) == len(odd_rows)
    by = {r["doc_id"]: r for r in out}
    assert by[2]["component_id"] == by[11]["component_id"] == 1 and by[12]["component_id"] == 7 and by[10]["component_id"] == 9
    assert by[None]["component_id"] is None and by[None]["kept"] and by[4]["component_id"] == 4
    kept = superminhash.keep_firsts(odd)
    counts = Counter(r["doc_id"] for r in kept.collect())
    assert kept.schema == odd.schema and counts[None] == 2 and max(c for d, c in counts.items() if d is not None) == 1
    assert superminhash.near_duplicates(nothing).count() == 0 and superminhash.keep_firsts(nothing).count() == 0


def test_keep_firsts_tells_rows_apart(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(20))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a")), (None, text("c")), (None, text("c")), (3, text("c")),
            (None, text("d")), (4, ""), (4, ""), (4, text("e"))]
    kept = superminhash.keep_firsts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(d), t[:1]) for d, t in kept) == [("1", "a"), ("1", "b"), ("4", ""), ("4", "e"), ("None", "c"), ("None", "d")]


def brute_top(vectors, queries, k):
    out = []
    for q in queries:
        v = next(v for i, v in vectors if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 1, (6, 12))
    raw = [(i, (centers[i % 6] + rng.normal(0, 0.1, 12)).tolist()) for i in range(700)]
    raw += [(1000 + i, raw[0][1]) for i in range(150)] + [(2000, [0.0] * 12), (2050, raw[1][1][:5])]
    bad = [(3000, None), (None, raw[0][1]), (3050, [None] + raw[0][1][1:]), (3100, [float("nan")] * 12), (3150, [float("inf")] * 12)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in raw + bad], "vec_id long, embedding array<double>, id string, v int").repartition(3)
    ints = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (12 - len(v))) for i, v in raw]
    vectors = mtree.integer_vectors(frame)
    for rows, block in ((30, 4096), (400, 4096), (40, 3)):
        monkeypatch.setattr(mtree, "BLOCK", block)
        monkeypatch.setattr(mtree, "BATCH", min(block, 64))
        got = mtree.Index(vectors, tree_rows=rows).top_k(vectors.where(F.col("id") % 50 == 0), 5).collect()
        assert sorted(tuple(r) for r in got) == brute_top(ints, [i for i, _ in raw if i % 50 == 0], 5)


def test_search_with_repeated_rows_of_a_query(spark):
    rng = np.random.default_rng(7)
    raw = [(i, rng.normal(0, 1, 6).tolist()) for i in range(120)]
    raw += [raw[q] for q in (0, 50, 100) for _ in range(4)]  # five own rows of each query in one leaf
    vectors = mtree.integer_vectors(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    got = mtree.Index(vectors).top_k(vectors.where(F.col("id") % 50 == 0), 5).collect()
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw]
    assert sorted(tuple(r) for r in got) == brute_top(ints, [0, 50, 100], 5)


def test_blocks_go_only_to_trees_that_may_help(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 4)
    monkeypatch.setattr(mtree, "BATCH", 4)
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 1, (10, 16))
    raw = [(i, (centers[i % 10] / np.linalg.norm(centers[i % 10]) + rng.normal(0, 0.002, 16)).tolist()) for i in range(1000)]
    vectors = mtree.integer_vectors(spark.createDataFrame(raw, "vec_id long, embedding array<double>"))
    index = mtree.Index(vectors, tree_rows=20)
    met, real = [], index._answers
    index._answers = lambda blocks, first, k: (met.append((blocks.count(), blocks.select(F.sum(F.size("trees"))).first()[0])), real(blocks, first, k))[1]
    got = index.top_k(vectors.where(F.col("id") % 50 == 0), 5).collect()
    assert sorted(tuple(r) for r in got) == brute_top([(i, [int(np.floor(256 * x)) for x in v]) for i, v in raw], range(0, 1000, 50), 5)
    blocks, visits = met[1]
    assert visits < 0.7 * blocks * index.trees.count()


def test_search_avoids_distances():
    rng = np.random.default_rng(6)
    v = np.floor(256 * (np.repeat(rng.normal(0, 1, (20, 8)), 100, axis=0) + rng.normal(0, 0.02, (2000, 8))))
    tree = mtree.Tree(np.arange(2000), v, float((v * v).sum(axis=1).max()))
    asked = np.arange(0, 2000, 40)
    best, computed = tree.search(v[asked], 5, asked, np.full(len(asked), np.inf))
    assert computed < 0.45 * 2000 * len(asked) and all(len(b) == 5 for b in best)


def test_search_of_few_and_none(spark):
    few = mtree.integer_vectors(spark.createDataFrame([(0, [1.0]), (50, [0.5]), (7, [])], "vec_id long, embedding array<float>"))
    got = mtree.Index(few).top_k(few.where(F.col("id") % 50 == 0), 5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 50, 256 * 128), (0, 2, 7, 0), (50, 1, 0, 256 * 128), (50, 2, 7, 0)]
    none = few.limit(0)
    assert mtree.Index(none).top_k(none, 5).count() == 0
    huge = mtree.integer_vectors(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        mtree.Index(huge)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from presage.llm import cascade

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    want = {r["doc_id"] for r in docs.collect() if not any(rule.rejects(cascade.Stats(r["text"])) for rule in corpus_pipeline.RULES)}
    assert {r["doc_id"] for r in kept.collect()} == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(labels[d] == 0 for d in set(labels) - want)
    thin = stages["line dedup"](spark, kept, sf_dir).cache()
    assert {r["doc_id"]: r["text"] for r in thin.collect()} == plain.without_repeats([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert all(r["n_chars"] == len(r["text"]) for r in thin.collect())
    single = stages["near dedup"](spark, thin, sf_dir).cache()
    component = plain.near_components([(r["doc_id"], r["text"]) for r in thin.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({d for d, c in component.items() if d == c})
    mixed = stages["mixing"](spark, single, sf_dir).cache()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in single.collect():
        n = len(plain.WORDS.findall(r["text"]))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    for r in mixed.collect():
        taken[r["source"]] += len(plain.WORDS.findall(r["text"]))
    targets = plain.shared_targets(sizes, mixing.WEIGHTS, 3)
    assert all(abs(taken[s] - targets[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    assert docs.schema == kept.schema == thin.schema == single.schema == mixed.schema
    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert check_packed(packed, packing.Capacity()) <= -(-sum(r["length"] for r in packed) // 4096) + 2
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
