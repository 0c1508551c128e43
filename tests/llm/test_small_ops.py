"""Sharding, mixing, search, near-duplicate vectors: brute force and edge cases on small tables."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, embedding_dedup, mixing, sharding, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b  c", "en", None, 6), (3, "a b  c", "en", None, 6), (None, "x", "en", "b", 1), (5, "é " * 50_000, "fr", "", 100_000), (6, "a b  c", "en", "b", 6)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def clashing(hard):
    names = ("shard", "slot", "size", "copies", "salt", "score", "predicted", "block", "part", "k", "t", "key_a", "component", "row", "words", "gram", "label", "kept", "hash", "n")
    return hard.withColumns({n: F.lit("x") for n in names})


def _shard(doc, count):
    best = None
    for s in range(count):
        seed = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed)
        score = (-math.log(((h >> 11) + 1) * 2.0**-53), s)
        best = score if best is None else min(best, score)
    return best[1]


def test_sharding_against_brute_force(spark):
    rows = [(i * 7919, "t" * (i % 13), "en", "s", 1) for i in range(600)]
    found = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 600
    slots = defaultdict(list)
    for r in found:
        assert r["shard"] == _shard(r["doc_id"], 16)
        assert r["grown_shard"] == _shard(r["doc_id"], 17)
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    found = Counter(r["shard"] for r in sharding.shard_documents(docs, weights=[1, 3]).collect())
    assert 0.72 < found[1] / 20_000 < 0.78


def test_sharding_hard_rows(hard, clashing):
    for docs in (hard, clashing):
        found = sharding.shard_documents(docs).collect()
        assert len(found) == len(HARD)
        sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in found}
        assert sizes[1] == (1, 0) and sizes[2] == (1, 0)
        assert sizes[5] == (150_001, zlib.crc32(("é " * 50_000).encode()))
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(hard.limit(0)).collect() == []


def _targets(sizes, weights, ceiling):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > ceiling * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "z", None, "c"][: 3 + seed % 4]
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), "en", rng.choice(names + names[:1] * 6), 0) for i in range(700)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix_sources(spark, docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    wanted = _targets(sizes, (5, 2, 1), 3)
    taken, longest = Counter(), Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]], rel=1e-9)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= longest[s] + 1e-6
    again = mixing.mix_sources(spark, docs.repartition(3)).collect()
    assert sorted(found, key=str) == sorted(again, key=str)


def test_pivot_keeps_words_and_leaves_one_fraction():
    rng = random.Random(11)
    mean = [0.0] * 6
    for trial in range(4_000):
        sizes = sorted((rng.randint(1, 400) for _ in range(rng.randint(1, 30))), reverse=True) if trial % 2 else [50, 20, 9, 5, 2, 1]
        parts = [rng.random() for _ in sizes] if trial % 2 else [0.3, 0.3, 0.7, 0.2, 0.5, 0.9]
        out = mixing.pivot(sizes, parts, [rng.random() for _ in range(2 * len(sizes) + 1)])
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in out)
        assert sum(1e-9 < p < 1 - 1e-9 for p in out) <= 1
        assert sum(s * p for s, p in zip(sizes, out, strict=True)) == pytest.approx(sum(s * p for s, p in zip(sizes, parts, strict=True)), abs=1e-6)
        if trial % 2 == 0:
            mean = [m + p / 2_000 for m, p in zip(mean, out, strict=True)]
    assert mean == pytest.approx([0.3, 0.3, 0.7, 0.2, 0.5, 0.9], abs=0.05)


def test_mixing_by_levels_agrees_in_total(spark):
    rows = [(i, 1 + i % 40, "s", 1, 0.4, i, 500) for i in range(500)] + [(1000 + i, 30, "t", 1, 0.4, i, 100) for i in range(100)]
    rows = spark.createDataFrame(rows, "doc_id long, size long, source string, n long, part double, tag long, classes long")
    found = mixing.pivotal_copies(spark, rows, 1, leaf_rows=4, fan_in=3).collect()
    words = sum((r["part"] + r["more"]) * r["size"] for r in found if r["source"] == "s")
    assert len(found) == 600 and abs(words - 0.4 * sum(r["size"] for r in found if r["source"] == "s")) <= 40


def test_equal_rows_are_rounded_each(spark):
    same = [(None, "a b c", "en", "s", 0)] * 900 + [(7, "a b c", "en", "s", 0)] * 100
    docs = spark.createDataFrame([*same, *[(100 + i, "x " * 40, "en", "t", 0) for i in range(50)]], DOCS)
    found = mixing.mix_sources(spark, docs).collect()
    assert len(found) == 1050
    for key, n in ((None, 900), (7, 100)):
        own = [r for r in found if r["doc_id"] == key]
        expected = own[0]["target"] / own[0]["source_size"]
        copies = Counter(r["copies"] for r in own)
        assert len(own) == n and set(copies) <= {math.floor(expected), math.ceil(expected)}
        assert abs(sum(r["copies"] for r in own) - n * expected) < 1
    assert mixing.mix_documents(spark, docs).groupBy("doc_id").count().where("doc_id is null").first()["count"] == sum(r["copies"] for r in found if r["doc_id"] is None)


def test_long_documents_are_settled_and_keep_their_expectation():
    """A few long documents among many short ones: all words but those of one short document come out whole."""
    rng = np.random.default_rng(5)
    sizes = np.array([20_000, 9_000, 9_000, 4_000] + sorted(rng.integers(20, 600, 300).tolist(), reverse=True))
    parts = np.concatenate([[0.3, 0.6, 0.05, 0.5], rng.uniform(0.25, 0.45, 300)])
    mean, runs = np.zeros(len(sizes)), 4_000
    for seed in range(runs):
        draws = np.random.default_rng(seed).random(2 * len(sizes) + 1)
        out = mixing.pivot(sizes, parts, draws)
        left = (out > 1e-9) & (out < 1 - 1e-9)
        assert left.sum() <= 1 and not left[:250].any()
        assert (out * sizes).sum() == pytest.approx((parts * sizes).sum(), rel=1e-12)
        mean += np.where(left, draws[-1] < out, out) / runs
    assert np.abs(mean - parts).max() < 4.5 * math.sqrt(0.25 / runs)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_mixing_comes_near_the_targets_of_the_given_tables(spark, scale):
    found = mixing.mix_sources(spark, spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")).select("source", "size", "taken", "target").collect()
    taken, target, sizes = Counter(), {}, defaultdict(list)
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        sizes[r["source"]].append(r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.001 * t, sorted(sizes[s])[len(sizes[s]) // 2])


def test_mixing_keeps_expectation(spark):
    rows = [(i, "w " * (1 + i % 40), "en", "ab"[i % 2], 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    total = sum(sum(r["copies"] for r in mixing.mix_sources(spark, docs, seed=s).where("source = 'a'").collect()) for s in range(6)) / 6
    part = mixing.mix_sources(spark, docs).where("source = 'a'").first()
    assert total == pytest.approx(30 * part["target"] / part["source_size"], rel=0.15)


def test_mixing_hard_rows(spark, hard, clashing):
    for docs in (hard, clashing):
        found = mixing.mix_sources(spark, docs).collect()
        assert len(found) == len(HARD)
        assert all(r["taken"] == 0 for r in found if r["size"] == 0)
        taken = mixing.mix_documents(spark, docs)
        assert taken.columns == docs.columns
        assert taken.count() == sum(r["copies"] for r in found)
    assert mixing.mix_sources(spark, hard.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def _fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    vectors = {i: [rng.choice([-1, 1]) * rng.random() for _ in range(24)] for i in range(400)}
    vectors |= {400 + i: list(vectors[i % 3]) for i in range(60)}  # ties
    vectors[450], vectors[99], vectors[100] = [float("nan")] + [0.0] * 23, None, [None] * 24
    rows = [(i, v, 0) for i, v in vectors.items()]
    docs = spark.createDataFrame(rows, VECTORS)
    table = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in docs.collect() if _fine(r["embedding"])}
    found = defaultdict(list)
    for r in vector_search.top_k_inner_products(spark, docs, shard_rows=64, group_queries=4).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in table if i % 50 == 0}
    for q, got in found.items():
        scores = sorted(((-sum(a * b for a, b in zip(table[q], v, strict=True)), i) for i, v in table.items() if i != q))[:5]
        assert sorted(got) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_search_hard_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (50, [1.0], 0), (1, [0.5, -0.5], None), (1, [0.5, -0.5], None), (None, [1.0, 1.0], 0), (2, [], 0), (3, [float("inf"), 0.0], 0)]
    docs = spark.createDataFrame(rows, VECTORS)
    found = vector_search.top_k_inner_products(spark, docs).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(0, 50), (0, 1), (0, 2), (50, 0), (50, 1), (50, 2)}
    assert len(found) == 8
    assert vector_search.top_k_inner_products(spark, docs.limit(0)).count() == 0
    assert vector_search.top_k_inner_products(spark, docs.limit(1)).count() == 0


def _reach(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 330)] + [(500, i) for i in range(501, 560)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == _reach({n for link in links for n in link}, links)


@pytest.mark.parametrize("part_rows, broadcast_rows", [(2_048, 20_000), (7, 0)])
def test_near_vectors_against_brute_force(spark, part_rows, broadcast_rows):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = []
    for i in range(400):
        v = [x + rng.gauss(0, rng.choice([0.02, 0.1, 0.13])) for x in base[min(int(rng.expovariate(0.2)), 29)]]
        rows.append((i, rows[-1][1] if i % 9 == 8 else [1e150 * x if i % 50 == 1 else x for x in v], i % 11 and i % 3 or (None if i % 11 == 0 else 0)))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")

    def cosine(a, b):
        a, b = [x / max(map(abs, a)) for x in a], [x / max(map(abs, b)) for x in b]
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    links = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] is not None and a[2] == b[2] and cosine(a[1], b[1]) >= 0.98]
    degree = Counter(n for link in links for n in link)
    label = _reach(range(400), links)
    found = embedding_dedup.near_duplicate_vectors(spark, docs, part_rows=part_rows, broadcast_rows=broadcast_rows).collect()
    assert len(links) > 100 and len(found) == 400
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], label[i], label[i] == i)


def test_near_vectors_hard_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 3.0], 1), (6, [float("nan"), 2.0, 3.0], 1), (7, [1.0, 2.0], 1), (8, v, 2), (9, [], 1)]
    docs = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in ("id", "n", "hash", "v", "fine", "links")})
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(spark, docs).collect())
    assert found == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)] + [(i, 0, i, True) for i in range(2, 10)]
    assert embedding_dedup.near_duplicate_vectors(spark, docs.limit(0)).count() == 0


def test_links_are_those_of_the_row_where_ids_repeat(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, 0), (1, y, 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (9, [0.0, 0.0, 1.0], 0)]
    found = sorted(map(tuple, embedding_dedup.near_duplicate_vectors(spark, spark.createDataFrame(rows, VECTORS)).collect()))
    # by x: 2; by y: both rows of 3
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (9, 0, 9, True)]


def test_links_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    rows, vectors = [], rng.standard_normal((3_000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, v in enumerate(vectors[:1_500]):
        side = rng.standard_normal(32)
        side -= side @ v * v
        cosine = rng.uniform(0.98, 0.985)
        rows.append((3_000 + i, (cosine * v + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)).tolist(), 0))
    rows += [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows.sort()
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = ((unit @ unit.T >= 0.98).sum(axis=1) - 1).tolist()
    assert sum(wanted) >= 2_990 and embedding_dedup.table_plan(len(rows), 0.98)[0] >= 9
    found = embedding_dedup.near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [r["n_links"] for r in sorted(found)] == wanted


def test_table_plan_reaches_the_miss_rate():
    for rows in (10, 10_000, 10**9):
        bits, tables = embedding_dedup.table_plan(rows, 0.98)
        p = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - p) ** tables <= embedding_dedup.MISS


def test_words_of_latin_texts_by_their_own_pattern():
    """As the pattern of the vocabulary file finds them, with contractions before words of letters."""
    import random
    import re

    from tidemark.llm import vocabulary as v

    plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{v.LETTERS}]+|[{v.NUMBERS}]|[^{v.SPACES}{v.LETTERS}{v.NUMBERS}]+").findall
    rng = random.Random(1)
    for top in (0x80, 0x100, 0x250):
        for _ in range(300):
            text = "".join(rng.choice(["'", "s", "re", "LL", " ", "7", chr(rng.randrange(top))]) for _ in range(200))
            assert v.split_words(text) == v._latin_words(text.lower()) == plain(text.lower()) if top <= 0x100 else v.split_words(text) == plain(text.lower())
