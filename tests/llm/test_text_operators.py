"""Operators that work text by text, against brute force and exact round trips."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelforge.llm import bpe, html, langid, pii, quality
from pyspark.sql.functions import lit as F_lit

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return bpe.encoder(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(alphabet=st.sampled_from(list("abethin'ls  \n\t\r\x1c\x85 0123.,!éßñçü日本語😀²½")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_agrees_with_tiktoken_and_decodes(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thein ab", max_size=80), st.text(alphabet="thein ab", max_size=40), st.data())
def test_bpe_appends_and_edits_are_exact(encoder, text, more, data):
    own = bpe.PieceEncoder(encoder.vocabulary, text.encode())
    own.append(more.encode())
    whole = (text + more).encode()
    start = data.draw(st.integers(0, len(whole)))
    end = data.draw(st.integers(start, len(whole)))
    own.splice(start, end, b"ing")
    edited = whole[:start] + b"ing" + whole[end:]
    assert [encoder.table[i] for i in own.tokens()] == bpe.merge(edited, encoder.vocabulary.ranks)


def test_bpe_edit_near_the_start_keeps_most_prefixes(encoder):
    own = bpe.PieceEncoder(encoder.vocabulary, b"thein" * 400)
    assert own.splice(10, 11, b"x") < 400


def test_bpe_splits_whole_texts_under_other_patterns():
    ranks = {bytes([i]): i for i in range(256)} | {b"a ": 256, b"a b": 257, b" b": 258}
    own = bpe.Encoder(bpe.Vocabulary(ranks), r"[\s\S]+")
    assert own.encode("a b") == [257] and own.encode("xa bx") == [120, 257, 120] and own.encode("a  b") == [256, 258]
    cut = bpe.Encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    assert cut.encode("a b") == [97, 258]
    grouped = bpe.Encoder(bpe.Vocabulary(ranks), r"(a)( b)|.")
    assert grouped.encode("a bx") == [257, 120]


def test_bpe_memory_is_bounded_by_bytes(encoder, monkeypatch):
    own = bpe.Encoder(encoder.vocabulary, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    rng = random.Random(3)
    for _ in range(40):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([5, 2000]))) for _ in range(5))
        assert own.decode(own.encode(text)) == text.encode()
        assert own.encode(text) == encoder.encode(text)
        assert own.held == sum(len(k) + len(v) for memory in (own.segments, own.pieces) for k, v in memory.items()) < 50_000 + 40_000


def test_bpe_query_handles_odd_rows(spark, encoder):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, LONG, None), (None, "a  b\n", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, carry=["doc_id", "ids"]).collect()
    assert len(out) == 5
    empty = hashlib.sha256(b"").hexdigest()
    for row in out:
        text = {1: "", 2: "", 3: LONG, None: "a  b\n"}[row["doc_id"]]
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["n_tokens"] * 4 == len(row["ids"])  # the clashing column is replaced
        if not text:
            assert row["ids_sha256"] == empty
    assert bpe.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# Personal data


def base_by_pattern(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        odd, even = digits[-1::-2], digits[-2::-2]
        if 12 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


@settings(max_examples=1500, deadline=None)
@given(st.one_of(*[st.text(alphabet=a, max_size=45) for a in ("ab@.-", "12.", "1 23-", "+1 ()23.-4", "a1@.+ é０", "255.0 1")]))
def test_base_entities_are_the_patterns(text):
    assert pii.base_spans(text) == base_by_pattern(text)


def test_long_odd_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1.1." * 100_000):
        pii.base_spans(text)


def test_terms_that_only_entities_have_are_removed(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, k=40))
        if i % 4 == 0:
            text += f" reachme +1 (202) 555-{1000 + i} often " + " ".join(rng.choices(words, k=5))
        if i % 3 == 0:
            text += " often " * 30
        rows.append((i, text))
    rows += [(400, None), (401, ""), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {(r["term"], r["kind"]): r["full"] for r in pii.disclosing_terms(df).collect()}
    assert terms == {("reachme", 3): True}
    out = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    found = out[4]
    assert found["n_phone"] == 1 and "reachme" not in found["sanitised"] and "[PHONE]" in found["sanitised"]
    start = rows[4][1].index("reachme")
    assert f"term:{start}:{start + 7}" in found["spans"] and "term" not in found["base_spans"]
    clean = out[1]
    assert clean["spans"] == "" and clean["sanitised"] == rows[1][1]
    assert out[400]["sanitised"] is None and out[400]["spans"] == "" and out[401]["spans"] == ""
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_rare_and_distant_terms_are_removed(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(200)]
    rows.append((500, "Gomez " + " ".join(rng.choices(words, k=12)) + " maria maria@x.com " + " ".join(rng.choices(words, k=3))))
    rows.append((501, "田中太郎、" + "、".join("word1" for _ in range(60)) + " +1 (202) 555-1000"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {(r["term"], r["kind"]): r["full"] for r in pii.disclosing_terms(df).collect()}
    assert terms == {("gomez", 0): True, ("maria", 0): True, ("田中太郎", 3): True}
    long = "x" * 700
    far = pii.context_terms(f"{long} a@b.cd", pii.base_spans(f"{long} a@b.cd"), 1)
    assert {t for _, _, t, _, _ in far} == {long}  # a long word is as near as a short one
    out = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    assert all(t not in out[500]["sanitised"] for t in ("Gomez", "maria")) and "田中太郎" not in out[501]["sanitised"]
    assert all(out[i]["sanitised"] == text for i, text in rows[:200])


def brute_disclosure(texts, window, alpha):
    """(term, entity) over the threshold, and whether fully, by the definition."""
    totals, inside = Counter(), Counter()
    for text in texts:
        spans = base_by_pattern(text or "")
        terms = []
        for m in re.finditer(r"[^\W_]+", text or ""):
            if not m.group().isdecimal() and not any(a < m.end() and m.start() < b for a, _, b in spans):
                terms.append((m.start(), m.group().lower()))
        totals.update(t for _, t in terms)
        near = set()
        for a, kind, b in spans:
            before = sum(at < a for at, _ in terms)
            for i in range(max(0, before - window), min(len(terms), before + window)):
                near |= {(i, kind), (i, pii.entity_id(text, (a, kind, b)))}
        inside.update((terms[i][1], entity) for i, entity in near)
    words, held = sum(totals.values()), Counter()
    for (_, entity), n in inside.items():
        held[entity] += n
    out = {}
    for (term, entity), n in inside.items():
        information = -math.log2(min(1, held[entity] / words))
        disclosure = math.log2(min(1, n / totals[term])) + information
        if information > 0 and disclosure >= alpha * information - 1e-12:
            out[term, entity] = n >= totals[term]
    return out


def test_disclosure_matches_brute_force(spark, monkeypatch):
    from panelforge.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)  # hot words and entities take their own way
    rng = random.Random(16)
    words = [f"w{i}" for i in range(30)] + ["İstanbul", "Straße", "x" * 300]
    people = [("ann", "ann@mail.example"), ("bob", "+1 (202) 555-1000"), ("eve", "EVE@mail.example")]
    texts = []
    for i in range(150):
        body = rng.choices(words, k=rng.randint(3, 40))
        if i % 3 == 0:
            name, address = people[i % 9 // 3]
            body.insert(rng.randrange(len(body)), name if rng.random() < 0.8 else f"Rare{i}")
            body.insert(rng.randrange(len(body)), address)
        if i % 10 == 0:
            body += ["10.0.0.7", "boilerplate", "ann@MAIL.example"]
        texts.append(" ".join(body))
    texts += [None, "", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["term"], r["entity"]): r["full"] for r in pii.disclosing_terms(df, window=6).collect()}
    assert found == brute_disclosure(texts, 6, 0.9)
    named = {pii.entity_id(a, (0, k, len(a))) for k, a in ((0, "ann@mail.example"), (3, "+1 (202) 555-1000"), (0, "eve@mail.example"))}
    assert named & {entity for _, entity in found}  # single entities are protected, not only kinds
    clash = df.withColumn("spans", F_lit("x")).withColumn("uid", F_lit(1))
    out = pii.find_personal_data(clash, window=6, carry=["doc_id", "spans", "uid", "text"]).collect()
    assert len(out) == len(texts) and all(r["uid"] == 1 and r["spans"] != "x" for r in out)
    for r in out:
        text = texts[r["doc_id"]] or ""
        base = base_by_pattern(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(kind == i for _, kind, _ in base) for i in range(4)]
        listed = {(t, e) for _, _, t, e, _ in pii.context_terms(text, base, 6)} if base else set()
        expected = {(a, b) for a, b, t, e, _ in (pii.context_terms(text, base, 6) if base else ()) if (t, e) in found and (t, e) in listed}
        assert {tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")} == expected


# Quality


def random_net(seed=1, filters=4):
    rng = np.random.default_rng(seed)
    made = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    return quality.ConvNet(made(257, quality.LEARNED), made(quality.WIDTH * quality.SIZE, filters), made(filters), made(filters), 0.2)


def brute_score(net, data):
    """The network without pieces or groups: every chunk of one document in one array."""
    n = len(data)
    size = max(1, -(-n // quality.STRIDE)) * quality.STRIDE + quality.WIDTH - quality.STRIDE
    vectors = np.zeros((size, quality.SIZE))
    raw = np.frombuffer(data, dtype=np.uint8)
    vectors[:n, : quality.LEARNED] = net.vectors[raw]
    vectors[n:, : quality.LEARNED] = net.vectors[quality.PAD]
    for bit, (length, back) in enumerate(quality.ECHOES):
        for lag in range(1, min(back, n) + 1):
            same = raw[lag:] == raw[:-lag]
            runs = np.lib.stride_tricks.sliding_window_view(same, length).all(axis=1) if len(same) >= length else np.zeros(0, bool)
            vectors[lag : lag + len(runs), quality.LEARNED + bit] += runs
        vectors[:, quality.LEARNED + bit] = vectors[:, quality.LEARNED + bit] > 0
    chunks = np.lib.stride_tricks.sliding_window_view(vectors, quality.WIDTH, axis=0)[:: quality.STRIDE].transpose(0, 2, 1).reshape(-1, quality.WIDTH * quality.SIZE)
    pooled = np.maximum((chunks @ net.kernels + net.bias).max(axis=0), 0)
    return 1 / (1 + np.exp(-(pooled @ net.weights + net.offset)))


def scores(net, texts):
    return net.score(np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))


def test_network_sees_every_byte_like_brute_force():
    net = random_net()
    rng = random.Random(8)
    texts = ["", "a", "x" * 31, "ab" * 40, "the quick brown fox " * 20, "é" * 100, "que que del del", "ab" * 2, "abcabc", "end"]
    texts += ["".join(rng.choices("abc d", k=rng.randint(0, 300))) for _ in range(60)]
    data = [t.encode() for t in texts]
    assert np.allclose(scores(net, data), [brute_score(net, t) for t in data], atol=1e-5)


@pytest.mark.parametrize("size", [quality.PIECE_BYTES - 1, quality.PIECE_BYTES, 2 * quality.PIECE_BYTES + 5, 1_000_000, 4_300_000])
def test_long_texts_take_the_same_path(size):
    rng = np.random.default_rng(size)
    data = rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), size).tobytes()
    data = data[: size // 2] + data[size // 2 - 20 : size // 2 + 20] + data[size // 2 + 40 :]
    net = random_net(3)
    found = scores(net, [b"short", data, b"", data[:100]])
    assert np.allclose(found, [brute_score(net, t) for t in (b"short", data, b"", data[:100])], atol=1e-5)
    for at in (0, size // 2, size - 40) if size < 500_000 else ():  # a mark anywhere in the text counts
        marked = data[:at] + b"\xff" * 40 + data[at + 40 :]
        assert np.isclose(scores(net, [marked])[0], brute_score(net, marked), atol=1e-5)


def test_the_order_of_bytes_counts():
    net = random_net(4)
    data = b"the quick brown fox jumps over the lazy dog"
    chunk = bytes(sorted(data[:16]))
    assert abs(scores(net, [data])[0] - scores(net, [chunk + data[16:]])[0]) > 1e-4


def test_training_takes_long_texts_and_one_text_of_an_id(spark):
    rng = random.Random(12)
    texts = {i: " ".join("".join(rng.choices("abcdef", k=4)) + ("##" if i % 2 else "") for _ in range(60)) for i in range(40)}
    texts[4] = "abcd efab " * 30_000  # far longer than the rest
    docs = [(i, t) for i, t in texts.items()] + [(7, texts[7])] * 3 + [(8, "other")]
    labels = [(i, 1 - i % 2) for i in range(40)] + [(3, 0), (6, 0), (6, 1)]
    seen = []
    real, quality.fit = quality.fit, lambda found, marks: seen.append((found, marks))
    try:
        for order in (1, -1):
            frame = spark.createDataFrame(docs[::order], "doc_id long, text string")
            quality.train(frame, spark.createDataFrame(labels[::order], "doc_id long, quality int"))
        quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=10, max_bytes=2000)
    finally:
        quality.fit = real
    assert seen[0] == seen[1] and len(seen[0][0]) == 39  # id 6 has both labels
    assert texts[4].encode() in seen[0][0]
    assert len(seen[2][0]) <= 10 and sum(map(len, seen[2][0])) <= 2000


def test_quality_replaces_a_clashing_column_and_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (1, "c", None)], "doc_id long, text string, score string")
    out = quality.classify_documents(df, random_net(), carry=["doc_id", "score", "text"]).collect()
    assert len(out) == 3 and all(isinstance(r["score"], float) for r in out)
    assert len({r["score"] for r in out if r["text"] == "a b"}) == 1
    assert quality.classify_documents(df.limit(0), random_net()).count() == 0


def test_network_separates_held_out_junk(spark):
    rng = random.Random(2)
    syllables = ["the", "an", "er", "ti", "on", "re", "wh", "ea"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(500):
        body = [word() for _ in range(60)]
        bad = i % 5 == 1
        if bad:
            body[20:40] = [w + "***" for w in body[20:40]] if i % 2 else [body[20]] * 20
        rows.append((i, " ".join(body)))
        labels.append((i, int(not bad), 0))
    rows += [(500, None), (501, ""), (502, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, marked, usable="doc_id % 4 <> 0")
    out = {r["doc_id"]: r for r in quality.classify_documents(docs, net).collect()}
    held = [i for i in range(500) if i % 4 == 0]
    assert sum(out[i]["predicted"] == (i % 5 != 1) for i in held) >= 0.95 * len(held)
    assert all(0 <= out[i]["score"] <= 1 for i in (500, 501, 502)) and out[500]["score"] == out[501]["score"]
    nothing = quality.train(docs.limit(0), marked.limit(0))
    assert {r["score"] for r in quality.score_documents(docs, nothing).collect()} == {0.5}


# Language


def test_language_models_are_distributions():
    texts = ["abba abab ba", "abc cab", "bab"]
    grams, _ = langid.grams_of(texts)
    keys, counts = np.unique(grams, return_counts=True)
    model = langid.kneser_ney(keys, counts, 5)
    symbols = sorted({int(k) & 0xFFFF for k in keys}) + [9, 10]  # five known ones and those unknown share the floor
    for context in ("  a", "abb", "xyz"):
        packed = 0
        for c in context:
            packed = packed << 16 | int(langid.letters()[ord(c)])
        all_grams = np.array([packed << 16 | s for s in symbols[:4]], dtype=np.uint64)
        total = np.exp(model.log_probability(all_grams)).sum()
        assert 0.3 < total <= 1.0001


def brute_kneser_ney(texts, symbols):
    """Interpolated Kneser-Ney by its formulas, from dictionaries of strings: log probability of a character after its context."""
    counts = Counter()
    for text in texts:
        clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        line = re.sub(" +", " ", clean)
        padded = "   " + line
        for i in range(4, len(padded)):
            counts[padded[i - 3 : i + 1]] += 1  # nothing before a text is a space, too
    levels = [counts]
    for n in (3, 2, 1):
        levels.append(Counter(gram[-n:] for gram in levels[-1]))
    levels.reverse()
    tables = []
    for level in levels:
        ones, twos = (sum(v == k for v in level.values()) for k in (1, 2))
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        totals, kinds = Counter(), Counter()
        for gram, n in level.items():
            totals[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        tables.append((level, discount, totals, kinds))

    def probability(gram):
        if not gram:
            return 1 / (symbols + 1)
        level, discount, totals, kinds = tables[len(gram) - 1]
        context = gram[:-1]
        if not totals[context]:
            return probability(gram[1:])
        return max(level[gram] - discount, 0) / totals[context] + discount * kinds[context] / totals[context] * probability(gram[1:])

    return counts, probability


def test_models_match_brute_force_kneser_ney():
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abcde", weights=[5, 4, 3, 2, 1], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["Ab, ba! 12 ab", "é"]
    grams, _ = langid.grams_of(texts)
    keys, counts = np.unique(grams, return_counts=True)
    model = langid.kneser_ney(keys, counts, 7)
    expected, probability = brute_kneser_ney(texts, 7)
    pack = lambda gram: sum((0 if c == " " else ord(c)) << 16 * i for i, c in enumerate(reversed(gram)))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {pack(gram): n for gram, n in expected.items()}
    probes = ["abcd", "aaaa", "ab a", "xyzz", "cdea", " abz", "zzza", "é a ", *list(expected)[::7]]
    found = model.log_probability(np.array([pack(g) for g in probes], dtype=np.uint64))
    assert np.allclose(found, [np.log(probability(g)) for g in probes])


def test_rejection_is_calibrated_on_unseen_text(spark):
    rng = random.Random(15)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ich", "en"]}
    say = lambda lang: " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))
    rows = [(i, say(lang), lang) for i, lang in enumerate(["aa", "bb"] * 400)]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({m.limit for m in models.values()}) == 2
    more = [(i, say(("aa", "bb")[i % 2])) for i in range(400)] + [(1000 + i, "".join(rng.choices("qxzwvy", k=60))) for i in range(50)]
    out = {r["doc_id"]: r["rejected"] for r in langid.identify(spark.createDataFrame(more, "doc_id long, text string"), models).collect()}
    # Some 40 texts calibrate a language, so a share of about 1 in 40 may pass the greatest of them.
    assert sum(out[i] for i in range(400)) <= 28 and all(out[1000 + i] for i in range(50))
    repeated = spark.createDataFrame([(1, "kalo mi", "x"), (1, "kalo mi", "x"), (1, None, None)], "doc_id long, text string, lang_pred string")
    found = langid.identify(repeated, models, carry=["doc_id", "lang_pred"]).collect()
    assert sorted(r["lang_pred"] for r in found) == ["aa", "aa", "und"]


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ich"], "cc": ["que", "eau", "oir"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(20)), lang) for i, lang in enumerate(list(sounds) * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, LONG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(df.where("doc_id % 3 <> 1 or doc_id % 4 = 0"))
    out = {r["doc_id"]: r for r in langid.identify(df, models).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    for i in (900, 901, 902):
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"]
    assert out[903]["rejected"] and 0 <= out[903]["score"] <= 1 and not out[5]["rejected"]
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}


def test_models_keep_every_gram(spark):
    rng = random.Random(5)
    rows = [(lang, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(2000))) for lang in ("xx", "yy") for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string")
    models = langid.train(df)
    for lang in ("xx", "yy"):
        expected, _ = langid.grams_of([t for name, t in rows if name == lang])
        assert np.array_equal(models[lang].grams[-1], np.unique(expected))


# Pages

PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use</div>
{main}<div id="comments"><p>A reader says that this is a long comment about the article, of many words in all.</p></div>
<aside>More</aside><footer>&copy; me</footer></body></html>"""
PARAGRAPH = "This is a paragraph of the article, which is long enough to be told from what stands around it."


def test_main_text_of_article_elements():
    page = PAGE.format(main="<article><h1>A &amp; B</h1><p>One <b>bold</b>\n\n word<br>two<p>Hm.</p><div class='ad'>Buy</div><form>f</form></article>")
    assert html.main_text(page) == "A & B\nOne bold word\ntwo\nHm."


def test_main_text_by_line_blocks():
    page = PAGE.format(main=f"<div><h1>Head</h1><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div>")
    assert html.main_text(page) == "\n".join(["Head", PARAGRAPH, "Short.", PARAGRAPH])


def test_main_text_outside_article_elements():
    teaser = "<article><h3><a href='/a'>Read this too</a></h3></article>"
    page = PAGE.format(main=f"<div><h1>Head</h1><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div><ul><li><a href='/b'>b</a></ul><ul><li><a href='/c'>c</a></ul><ul><li><a href='/d'>d</a></ul>{teaser}")
    assert html.main_text(page) == "\n".join(["Head", PARAGRAPH, "Short.", PARAGRAPH])
    page = PAGE.format(main=f"<article><h1>Head</h1><p>{PARAGRAPH}</p></article><div><p>{PARAGRAPH}</p><p>Short.</p></div>")
    assert html.main_text(page) == "\n".join(["Head", PARAGRAPH, PARAGRAPH, "Short."])


FIVE = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(5))
STORY = "\n".join(["Head", *(f"{PARAGRAPH} {i}" for i in range(5))])


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="left-side content"><article><h1>Head</h1>{FIVE}</article></div>',
        f'<div class="share"><h1>Head</h1>{FIVE}</div>',
        f'<div class="sidebar">{PARAGRAPH}</div><main><h1>Head</h1>{FIVE}<div class="comment-list">{PARAGRAPH}</div></main>',
        f"<div><h1>Head</h1>{FIVE}</div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>" + "<article><h3><a href='/x'>card</a></h3></article>" * 4,
        f"<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><article><a href='/x'>Teaser</a></article><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><div><h1>Head</h1>{FIVE}</div>",
        f"<h1>Head</h1>{FIVE}<div class='comments'>{FIVE}{FIVE}</div>",
    ],
)
def test_the_story_is_found(page):
    assert html.main_text(PAGE.format(main=page)) == STORY


def test_furniture_that_touches_the_article_stays_out():
    article = f"<article><h1>Head</h1><p>{PARAGRAPH}</p><p>Short.</p></article>"
    own = "\n".join(["Head", PARAGRAPH, "Short."])
    assert html.main_text(article + "<div>Copyright 2024 Example Media Ltd. All rights reserved worldwide.</div><p>Follow us now</p>") == own
    teaser = "A teaser of ninety characters or so, which says what another page of the same site is about."
    assert html.main_text(f"<div class='col-3'>{teaser}</div>{article}") == own
    assert html.main_text(f"<div class='col-3'>{teaser}</div><div>x</div>{article}<p>Follow us now</p>") == "\n".join([teaser, "x", own])
    # A body outside the element is no furniture.
    assert html.main_text(f"{article}{FIVE}") == own + "\n" + "\n".join(STORY.split("\n")[1:])


def test_names_with_other_words_say_nothing():
    names = ["side-by-side", "search-results", "reply-to-critics", "shareholders", "load"]
    page = "<article>" + "".join(f'<div class="{n}">{n} {PARAGRAPH}</div>' for n in names) + "<div class='cookieNotice'>no</div></article>"
    assert html.main_text(page) == "\n".join(f"{n} {PARAGRAPH}" for n in names)


def test_short_pages_and_comments():
    assert html.main_text(f"<div><h1>T</h1><p>Short story.</p></div><div class='comments'>{FIVE}</div>") == "T\nShort story."
    assert html.main_text("<div class='ad'>Buy this now, it is cheap.</div><article><p>Short.</p></article>") == "Short."


def brute_blocks(weights, block, threshold):
    """Lines between dives around a surge, straight from the definition."""
    n = len(weights)
    sums = [sum(weights[i : i + block]) for i in range(n)]
    if not any(weights):
        return []
    surges = [i for i in range(n) if sums[i] > threshold] or [i for i in range(n) if sums[i] == max(sums)]
    kept = set()
    for i in surges:
        a = b = i
        while a and sums[a - 1] > 0:
            a -= 1
        while b + 1 < n and sums[b + 1] > 0:
            b += 1
        while weights[a] == 0:
            a += 1
        kept |= set(range(a, b + 1))
    return sorted(kept)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 5, 30, 81, 200]), max_size=30), st.integers(1, 4))
def test_line_blocks_match_brute_force(weights, block):
    kept, _ = html.kept_lines(np.array(weights, dtype=np.int64), block, 80)
    assert np.flatnonzero(kept).tolist() == brute_blocks(weights, block, 80)


def test_bad_markup_takes_linear_time():
    import time

    for text in ('<a "', "</b>", "<div>", "<div><p></b>", "<a x='\">", "<", "<!--", "<script>", '<div class="share">', '<p class="ad"><article>', '<b "x>'):
        start = time.process_time()
        html.main_text(text * (1_000_000 // len(text) | 1))
        assert time.process_time() - start < 6, text


def test_sample_pages_do_not_need_the_element():
    duckdb = pytest.importorskip("duckdb")
    try:
        pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    except duckdb.IOException:
        pytest.skip("no sample tables")
    bare = [re.sub("</?article>", "", p) for p in pages]
    same = sum(html.main_text(a) == html.main_text(b) for a, b in zip(pages, bare, strict=True))
    assert same >= 0.99 * len(pages)


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!-- x", "<script>never closed", "plain text", "<p>a<p>b", "&lt;p&gt;", "<a href='x>y'>z</a>"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(html.main_text(page), str)


def test_page_query_handles_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "v", "<article>é&eacute;</article>"), (4, "w", "<article>" + "<p>x</p>" * 30_000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    out = html.extract(df, carry=["page_id", "url", "text"]).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in out) == [(1, 0), (1, 0), (2, 0), (3, 2), (4, 59_999)]
    assert html.extract(df.limit(0)).count() == 0


def test_folds_leave_null_ids_out(spark):
    from panelforge.llm.common import is_fold, not_fold

    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for row in df.select("doc_id", is_fold(df.doc_id, 5, 0).alias("a"), not_fold(df.doc_id, 5, 0).alias("b")).collect():
        if row["doc_id"] is None:
            assert not row["a"] and not row["b"]
        else:
            assert row["a"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) and row["b"] != row["a"]
