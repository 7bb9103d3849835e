"""The corpus pipeline, stage by stage, on a small fixture."""

import hashlib

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
mixing = pytest.importorskip("panelforge.llm.mixing")
pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, tmp_path):
    import random

    rng = random.Random(9)
    syllables = ["the", "an", "er", "ti", "on", "re", "wh", "ea"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(200):
        body = [word() for _ in range(80)]
        bad = i % 5 == 1
        if bad:
            body = [w + "***" for w in body]
        if i == 10:
            body[40] = "a.b@example.com"
        text = " ".join(body)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    copy = docs[12][1]
    docs += [(300 + k, copy, "en", "s1", len(copy)) for k in range(5)] + [docs[12], docs[12], (None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{k}"
        stage(spark, tables[-1], folder).write.parquet(path)
        tables.append(spark.read.parquet(path))
    assert all(t.columns == docs.columns for t in tables[1:-1])
    good, single, clean, mixed, encoded = ([r.asDict() for r in t.collect()] for t in tables[1:])
    assert not [r for r in good if r["text"] and "***" in r["text"]] and len(good) >= 155
    copies = [r["doc_id"] for r in single if r["text"] == docs.where("doc_id = 12").first()["text"]]
    assert copies == [12]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single}
    hidden = next(r["text"] for r in clean if r["doc_id"] == 10)
    assert "[EMAIL]" in hidden and "@" not in hidden
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert len(encoded) == len(mixed)
    assert sorted(r["decoded_sha256"] for r in encoded) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in mixed)


def test_stages_take_empty_tables_and_other_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    clashing = ["score", "fingerprint", "spans", "uid", "times", "epoch", "ids", "copies", "block", "k0", "row"]
    more = docs.select("*", *[F.lit("own").alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns, name
        assert out.where(" or ".join(f"{c} <> 'own'" for c in clashing if c not in ("score", "fingerprint", "spans"))).count() == 0, name


def test_ids_that_repeat_in_two_groups_stay_in_both(spark):
    texts = ["one two three four five six seven", "completely other words that share nothing with it at all"]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1), (2, texts[0], "en", "s", 1), (3, texts[1], "en", "s", 1), (None, "a third text of its own", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(a), b) for a, b, *_ in (rows[0], rows[1], rows[4]))


def test_equal_rows_are_mixed_as_often_as_they_are_taken(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 4 + [(2, "d e", "en", "t", 3)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    from panelforge.llm import mixing

    taken = mixing.mix(docs)[0].collect()
    expected = sum(-(-r["taken"] // r["size"]) for r in taken)
    assert corpus_pipeline.mix_sources(spark, docs, "").count() == expected


def test_run_gives_the_same_rows(spark, folder):
    rows = [sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_rows_that_differ_in_where_a_null_stands_are_different_rows(spark, tmp_path):
    text = "a b c d e"
    schema = "doc_id long, text string, lang string, source string, n_chars long, more array<string>, extra struct<a:int,b:binary>, spans map<string,int>"
    rows = [
        (1, text, "web", None, 9, ["x"], (1, b"1"), {"a": 1}), (1, text, None, "web", 9, ["x"], (1, b"1"), {"a": 1}), (1, text, None, "web", 9, ["x", None], (1, b"1"), {"a": 1}),
        (1, text, None, "web", 9, ["x"], (None, b"1"), {"a": 1}), (1, text, None, "web", 9, ["x"], (1, b"1"), None), (1, text, None, "web", 9, None, None, {"a": None}),
        (1, text, None, "null", 9, ["x"], (1, b"1"), {"a": 1}),
    ]
    docs = spark.createDataFrame([*rows, rows[0]], schema)
    keys = [r["row_key"] for r in corpus_pipeline.keyed(docs).collect()]
    assert len(set(keys)) == len(rows)
    mixed = {repr(r) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()}
    known = {r["row_key"]: repr(r["row"]) for r in corpus_pipeline.keyed(docs).collect()}
    taken, _ = mixing.mix(corpus_pipeline.keyed(docs), doc_id="row_key")
    assert mixed == {known[r["doc_id"]] for r in taken.where("taken > 0").collect()} and len(mixed) > 2
    # The two rows of the same values, in different columns, from a source that is taken whole.
    pair = spark.createDataFrame(rows[:2], schema)
    assert len(corpus_pipeline.mix_sources(spark, pair, str(tmp_path)).select("lang", "source").distinct().collect()) == 2
