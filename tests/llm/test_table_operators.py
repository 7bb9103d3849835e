"""Operators over whole tables, against brute force on small fixtures."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from panelforge.llm import common, lm, mixing, simhash, topk, vectors
from panelforge.llm.components import Forest, connected_components
from panelforge.llm.queries import ORACLES
from pyspark.sql import functions as F


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(1))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    links = [tuple(rng.sample(range(80), 2)) for _ in range(55)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    expected = groups_of({n for pair in links for n in pair}, links)
    df = spark.createDataFrame([*links, *links[:5], (7, 7), (None, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == expected
    named = df.selectExpr("concat('n', lpad(a, 4, '0')) AS a", "concat('n', lpad(b, 4, '0')) AS b")
    assert {r["node"]: r["component"] for r in connected_components(named).collect()} == {f"n{k:04}": f"n{v:04}" for k, v in expected.items()}
    assert connected_components(df.limit(0)).count() == 0
    forest = Forest(300)
    forest.link(np.array([a for a, _ in links[:60]]), np.array([b for _, b in links[:60]]))
    forest.link(np.array([a for a, _ in links[60:]]), np.array([b for _, b in links[60:]]))
    whole = groups_of(range(300), links)
    same = {}
    for n in range(300):
        assert same.setdefault(whole[n], forest.root[n]) == forest.root[n]


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if counts[bit] * 2 > len(shingles))


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Ärger", "delta", "eps"]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(1, 400))
        rows.append((i, " ".join(base)))
        for j in range(i % 4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "zeta"
            rows.append((1000 + 10 * i + j, "\t".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2003, "one"), (None, "one"), (2004, "w " * 150_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, component_id string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    prints = [brute_print(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = groups_of(range(len(rows)), links)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(least.get(group[i], doc_id), doc_id)
    expected = Counter((rows[i][0], f"{prints[i]:016x}", least.get(group[i])) for i in range(len(rows)))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bk_trees_find_every_pair_of_a_dense_shard():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64)
    prints = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 5), replace=False))) for _ in range(400)], dtype=np.uint64))
    tree = simhash.BKForest(np.zeros(len(prints), dtype=np.int64), prints)
    found = {tuple(sorted((int(a), int(b)))) for x, y in tree.neighbours(3) for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 3}


# Vectors


def vector_rows(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        v = rng.standard_normal(16)
        rows.append((i, v.tolist()))
        if i % 3 == 0:
            for k, angle in enumerate((0.05, 0.3, 0.44, 0.46, 0.6)):
                other = rng.standard_normal(16)
                other -= other @ v / (v @ v) * v
                other *= np.linalg.norm(v) / np.linalg.norm(other)
                rows.append((200 + i * 5 + k, (math.cos(angle) * v + math.sin(angle) * other).tolist()))
        if i % 10 == 0:
            rows += [(2000 + i * 10 + k, v.tolist()) for k in range(4)]
    return rows


def test_vector_links_match_brute_force(spark):
    rows = vector_rows()
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, []), (None, [1.0] * 16), (5005, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows + odd], "vec_id long, embedding array<double>, n_links int")
    out = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df).collect()}
    ids, matrix = [a for a, _ in rows], np.array([b for _, b in rows])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)]
    group = groups_of(ids, links)
    found = sum(out[i]["n_links"] for i in ids)
    assert 0.99 * near.sum() <= found <= near.sum()
    assert sum(out[i]["component_id"] == group[i] for i in ids) >= 0.99 * len(ids)
    for i, _ in odd:
        assert out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] == (i is not None)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_a_run_longer_than_the_window_is_compared_whole():
    rng = np.random.default_rng(2)
    near = rng.standard_normal(8) + rng.standard_normal((700, 8)) * 0.01
    earlier = np.zeros((700, 0), np.uint16)
    assert sum(len(a) for a, _ in vectors.run_links(vectors.unit_rows(near), near, earlier, 0.9)) == 700 * 699 // 2
    earlier = np.stack((np.arange(700) // 350, np.arange(700) % 2), axis=1).astype(np.uint16)  # what two earlier passes had together
    found = {(a, b) for x, y in vectors.run_links(vectors.unit_rows(near), near, earlier, 0.9) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(a, b) for a in range(350) for b in range(350, 700) if a % 2 != b % 2}


def exact_groups(matrix, ids, threshold):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near.sum(axis=1), groups_of(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(near)), strict=True)])


def test_a_group_larger_than_a_task_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)  # joins of hot keys, too
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    matrix = np.concatenate([centre + 0.25 * rng.standard_normal((1500, 16)), rng.standard_normal((400, 16)), np.repeat([centre * 2], 400, axis=0)])
    ids = [f"v{i:05}" for i in range(len(matrix))]
    df = spark.createDataFrame(list(zip(ids, matrix.tolist(), strict=True)), "vec_id string, embedding array<double>")
    n_links, groups = exact_groups(matrix, ids, 0.9)
    out = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df, task_rows=500).collect()}
    found = np.array([out[i]["n_links"] for i in ids])
    assert (found <= n_links).all() and found.sum() >= 0.999 * n_links.sum()
    assert sum(out[i]["component_id"] == groups[i] for i in ids) >= 0.999 * len(ids)
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in ids)


def test_repeated_ids_stand_for_their_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    out = vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(200)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "k long, w string").join(left.groupBy("k").count(), "k")
    own = common.join_counted(left, right, "k", "count", 200)
    assert own.columns == ["k", "v", "w"]
    assert Counter(map(tuple, own.collect())) == Counter(map(tuple, left.join(right.drop("count"), "k").collect()))


@pytest.mark.parametrize("radius", [1, 3])
def test_shards_dealt_out_again_lose_no_pair(spark, radius):
    rng = np.random.default_rng(radius)
    base = int(rng.integers(0, 2**62))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(200)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    dealt = simhash.deal_shards(df, radius, most=30)
    shards = {}
    for r in dealt.collect():
        shards.setdefault(r["shard"], set()).add(r["fingerprint"] % 2**64)
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
    together = {(a, b) for members in shards.values() for a in members for b in members if a < b}
    assert near <= together
    if radius == 3:
        assert max(map(len, shards.values())) < 120
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.link_prints(df, radius, most=30).collect()]
    assert groups_of(prints, links) == groups_of(prints, near)


def test_a_crowd_below_the_threshold_hides_no_pair(spark):
    rng = np.random.default_rng(3)
    crowd = math.sqrt(0.9) * np.eye(1, 64) + math.sqrt(0.1 / 64) * rng.standard_normal((12_000, 64))
    near = crowd[:400] + math.sqrt(0.05 / 64) * rng.standard_normal((400, 64))
    matrix = np.concatenate([crowd, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.97).sum(axis=1) - 1
    out = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicate_vectors(df, threshold=0.97, task_rows=2000).collect()}
    assert expected.sum() >= 600
    assert sum(out.values()) >= 0.995 * expected.sum()
    assert all(out[i] <= n for i, n in enumerate(expected))


def test_top_k_matches_brute_force(spark):
    rows = vector_rows(4) + [(3000, [0.5] * 16), (3001, [0.5] * 16), (3002, [0.5] * 16), (100, [1e9] * 16), (3100, [0.0] * 16), (3201, [2e9] * 16), (3202, [1.5e9] * 16), (3203, [-3e9] * 16), (3204, [-2e9] * 16)]
    rows += [(3300 + i, [0.5] * 16) for i in range(40)]
    odd = [(6000, None), (6100, [float("inf")] * 16), (6200, [None] * 16), (6300, [1.0]), (6400, [2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    out = topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=7, wave=8).collect()
    usable = [(a, [math.floor(1024 * x) for x in b]) for a, b in [*rows, (6300, [1.0]), (6400, [2.0])]]
    expected = set()
    for q, v in usable:
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])}
    assert {tuple(r) for r in out} == {(q, n, i, max(-(2**63), min(s, 2**63 - 1))) for q, n, i, s in expected}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_statement(spark):
    rows = [(i, [((i * 37 + j * 11) % 23 - 11) / 9.0 for j in range(8)]) for i in range(230)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    embeddings = df.toArrow()  # noqa: F841  (read by the statement)
    expected = con.execute(ORACLES["op5_topk"]).fetchall()
    assert sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(expected)


# Mixing


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, pieces = mixing.mix(df, **more)
    return taken.collect(), pieces


def test_mix_meets_targets_exactly(spark):
    rng = random.Random(6)
    shares = {"a": 300, "b": 40, "c": 5, "d": 60, None: 30, "": 1}
    rows = [(i, "w " * rng.randint(0, 50), s) for i, s in enumerate(s for s, n in shares.items() for _ in range(n))]
    rows += [(9000, None, "a"), (9001, "x", "a"), (9001, "x", "a"), (9002, "y " * 30_000, "b"), (None, "z z", "c")]
    out, pieces = mixed(spark, rows)
    again, _ = mixed(spark, rows[::-1])
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and len(out) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(weights[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        own = [r for r in out if r["source"] == s]
        target = 3 * sizes[s] if s in capped else level * weights[s]
        assert all(math.isclose(r["target"], target) and r["source_size"] == sizes[s] for r in own)
        assert sum(r["taken"] for r in own) == round(target)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    order = pieces.orderBy("slot").collect()
    assert sum(p["words"] for p in order) == sum(r["taken"] for r in out)
    # Half of the schedule has about half of each large source.
    half = Counter()
    for p in order[: len(order) // 2]:
        half[p["source"]] += p["words"]
    whole = Counter()
    for p in order:
        whole[p["source"]] += p["words"]
    assert all(abs(half[s] / whole[s] - half.total() / whole.total()) < 0.1 for s in ("a", "b", "d"))


def test_mix_does_not_depend_on_the_runs_of_places(spark, monkeypatch):
    rows = [(i, "w " * (i % 37), "abc"[i % 7 % 3]) for i in range(400)]
    whole, _ = mixed(spark, rows, block_words=5)
    monkeypatch.setattr(mixing, "PLACE_RUN", 11)
    assert Counter(map(tuple, mixed(spark, rows, block_words=5)[0])) == Counter(map(tuple, whole))
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)  # another order, but the same targets met
    taken = Counter()
    for r in mixed(spark, rows, block_words=5)[0]:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    expected = Counter()
    for r in whole:
        expected[r["source"]] += r["taken"]
    assert taken == expected


def test_mix_of_nothing(spark):
    assert mixed(spark, [])[0] == []
    out, pieces = mixed(spark, [(1, None, "a"), (2, " ", None)])
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2 and pieces.count() == 0


# Language model


def test_lm_counts_match_brute_force(spark):
    rng = random.Random(7)
    words = ["the", "The", "of", "Été", "été", "x" * 40, "a"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "the the"), (202, "only here"), (202, "only here"), (203, "long " * 120_000)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double")
    learned = F.col("doc_id") % 7 != 2
    out = lm.score_documents(df, learned, filter_bits=1 << 20, block_bytes=3000).collect()
    counts = Counter()
    tokens = lambda text: [*(text or "").encode().lower().split(), None]
    for doc_id, text in rows:
        if doc_id is not None and doc_id % 7 != 2:
            counts.update(tokens(text))
    n, v = counts.total(), len(counts)
    expected = Counter()
    for doc_id, text in rows:
        own = tokens(text)
        expected[doc_id, len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == expected
    assert all(r["score"] < 0 for r in out)
    nothing = lm.score_documents(df, F.lit(False), filter_bits=1 << 20).collect()
    assert {(r["base_score"], r["score"], r["train_tokens"]) for r in nothing} == {(0.0, 0.0, 0)}
    assert lm.score_documents(df.limit(0), learned, filter_bits=1 << 20).count() == 0


def test_filter_grows_with_the_corpus(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(100))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = F.col("doc_id") % 7 != 2
    small, large = ({r["doc_id"]: r["score"] for r in lm.score_documents(df, learned, filter_bits=bits, block_bytes=30_000).collect()} for bits in (1 << 10, 1 << 25))
    singles, pairs = Counter(), Counter()
    texts = {doc_id: [*text.encode().split(), None] for doc_id, text in rows}
    for doc_id, own in texts.items():
        if doc_id % 7 != 2:
            singles.update(own)
            pairs.update(zip([None, *own], own))
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0
    n, v = singles.total(), len(singles)
    for doc_id, own in texts.items():
        score = 0.0
        for a, b in zip([None, *own], own):
            single = (middle(singles[b]) + 1) / (n + v + 1)
            share = min(1.0, middle(pairs[a, b]) / max(middle(singles[a]), 1))
            score += math.log10(lm.PAIR_WEIGHT * share + (1 - lm.PAIR_WEIGHT) * single if singles[a] else single)
        assert abs(large[doc_id] - score) < 0.01
        # False positives, about 1 in 200 probes, raise some of a text's counts.
        assert abs(small[doc_id] - score) < 0.05 * abs(score)


def test_lm_blocks_split_copies_and_long_texts(spark):
    rows = [(1, "same words again")] * 300 + [(2, "w" * 5000), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("learned"))
    blocks = lm.pack_blocks(docs, 1000).collect()
    tables = [lm.unpacked(r["packed"]) for r in blocks]
    assert sum(t.num_rows for t in tables) == len(rows) and len({r["block"] for r in blocks}) == len(blocks)
    assert all(t.num_rows == 1 or sum(len(x) for x in t.column("text").to_pylist()) <= 1000 for t in tables)
    # Many more blocks, and so buckets, than the least number; the same results with few and many.
    few, many = ({(r["doc_id"], round(r["base_score"], 6), round(r["score"], 2)) for r in lm.score_documents(df, F.lit(True), filter_bits=1 << 24, block_bytes=b).collect()} for b in (10**6, 100))
    assert few == many and len(many) == 4


def test_filter_reads_back_levels():
    rng = np.random.default_rng(8)
    hashes = np.unique(rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    counts = rng.integers(1, 1000, len(hashes))
    bits = np.zeros(1 << 17, dtype=np.uint8)
    for bucket in range(16):
        own = lm.bucket_of(hashes, 16) == bucket
        lm.fill_segment(bits[bucket * (1 << 13) : (bucket + 1) * (1 << 13)], lm.short_ids(hashes[own]), counts[own], 0)
    levels = lm.read_levels(bits, hashes, 0, 16)
    true = np.floor(np.log2(counts)) + 1
    assert (levels >= true).all() and (levels == true).mean() > 0.99
    absent = lm.read_levels(bits, lm.mixed(hashes), 0, 16)
    assert (absent == 0).mean() > 0.98
