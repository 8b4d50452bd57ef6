"""Clashing column names, repeated rows and ids, and the stages of the pipeline on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sensorlake.llm import content_sort, decontaminate, fair_mix, hyperminhash, names, url_lists

CLASHES = {
    "_id": 1, "_row": 2, "_rest": 3, "a.b": 4, "_dropped": 5, "kept": 6, "keep_id": 7, "component_id": 8, "_hash": 9, "size": 10,
    "_source": 11, "_taken": 12, "copies": 13, "n`t": 14, "score": 15, "_url": 16, "_found": 17, "item_id": 18, "_kept": 19, "id": 20,
    "_content": 21, "_size": 22, "target": 23, "_place": 24, "held": 25, "label": 26, "_text": 27, "node": 28, "rep": 29,
}


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def clashing(df):
    return df.select("*", *[F.lit(v).alias(n) for n, v in CLASHES.items()])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], None, None, None) for i in range(5)]
    rows += [(200 + i, texts[i] + " more", "en", "a", 1) for i in range(5)]
    rows += [(300, None, None, "a", 0), (301, "", None, None, 0), (None, texts[0], None, "a", 1), (302, "\t\n", "x", "b", 2)]
    rows += [(303, "word " * 30_000, "en", "a", 1)]
    return clashing(documents(spark, rows))


def same_columns(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    assert all([r[n] for n in CLASHES] == list(CLASHES.values()) for r in rows)
    return rows


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "x int, `x_` int")
    assert names.free_name(df, "X") == "X__"


def test_exact_dedup_with_clashing_names(docs):
    rows = same_columns(content_sort.exact_dedup(docs), docs)
    texts = [r.text or "" for r in docs.collect()]
    assert sorted(r.text or "" for r in rows) == sorted(set(texts))
    by = {r.text: r.doc_id for r in rows if r.text}
    assert all(by[r.text] == min(x.doc_id for x in docs.collect() if x.text == r.text and x.doc_id is not None) for r in rows if r.text)
    groups = content_sort.exact_groups(docs, carry=True)
    assert groups.filter("kept").count() == len(rows) and {"a.b", "_rest", "keep_id"} <= set(groups.columns)
    lower = content_sort.exact_dedup(docs, normalise=F.lower)
    assert lower.columns == docs.columns and lower.count() == len(rows)


def test_near_dedup_with_clashing_names(docs):
    rows = same_columns(hyperminhash.near_dedup(docs), docs)
    ids = {r.doc_id for r in rows}
    assert not ids & {100, 101, 102, 200, 201, 202} and {0, 1, 2, 300, 301, None} <= ids


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(1, a), (2, b), (5, a), (5, b), (7, prose(rng, 50)), (7, prose(rng, 50))]
    out = hyperminhash.near_groups(documents(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (5, 1), (7, 7)} and len(out) == 6


def test_mix_with_clashing_names_and_repeated_rows(docs, spark):
    rows = same_columns(fair_mix.mixed_documents(docs).drop("mix_copies", "mix_finish"), docs)
    assert len(rows) <= docs.count()
    rng = random.Random(3)
    texts = [prose(rng, 10) for _ in range(6)]
    repeated = [(1, texts[0], None, "s", 0)] * 3 + [(2, texts[1], None, "s", 0), (2, texts[2], None, "s", 0), (None, texts[3], None, None, 0), (None, texts[4], None, None, 0)]
    frame = documents(spark, repeated)
    plan = fair_mix.mix_plan(frame).collect()
    mixed = fair_mix.mixed_documents(frame).collect()
    assert len(mixed) == sum(r.copies > 0 for r in plan) <= 7
    assert sum(r.mix_copies for r in mixed) == sum(r.copies for r in plan)
    again = fair_mix.mixed_documents(frame.repartition(3)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_skewed_sources_reach_their_targets(spark):
    rng = random.Random(4)
    rows = []
    for s in range(40):
        for i in range(60 if s == 0 else 8):
            rows.append((s * 1000 + i, "w " * rng.randint(1, 40), None, f"s{s:02d}", 0))
    plan = fair_mix.mix_plan(documents(spark, rows)).collect()
    taken, target = {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 41 for s in target)


def test_judged_captures_with_clashing_names(spark):
    captures = clashing(spark.createDataFrame([("http://a.org/x", 5), (None, 5), ("http://b.org/", None)], "url string, fetched int"))
    entries = spark.createDataFrame([("a.org", "block", 1)], "rule string, verdict string, listed_at int")
    out = url_lists.judge(captures.withColumn("verdict", F.lit("old")), entries)
    assert [c for c in out.columns if c not in ("host", "verdict", "rule", "rule_from")] == captures.columns
    assert sorted(r.verdict for r in out.collect()) == ["block", "none", "none"]


def tables(spark, folder, rows, labels, items):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_in_the_order_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "source mix",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_its_plain_steps(spark, tmp_path):
    rng = random.Random(5)
    good = [prose(rng, 80) for _ in range(200)]
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows, labels = [], []
    for i, text in enumerate(good):
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
        labels.append((i, 0 if bad else 1, 0))
    clean = [r for i, r in enumerate(rows) if i % 4]
    rows += [(1000 + k, r[1], "en", "a", 0) for k, r in enumerate(clean[:10])]
    rows += [(2000 + k, r[1] + " tail", "en", "b", 0) for k, r in enumerate(clean[10:20])]
    rows += [(3000 + k, prose(rng, 30) + " " + items[k][1] + " " + prose(rng, 30), "en", "c", 0) for k in range(5)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "a", 0)]
    tables(spark, str(tmp_path), rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "source mix":
            assert out.columns == docs.columns
        docs = out
        kept[name] = {r.doc_id for r in out.collect()}
    ids = {r[0] for r in clean}
    near = kept["near dedup"]
    assert ids <= kept["quality classifier"] and not any(i % 4 == 0 and i < 200 for i in kept["quality classifier"])
    assert ids <= kept["exact dedup"] and not any(1000 <= (i or 0) < 1010 for i in kept["exact dedup"])
    assert ids <= near and not any(2000 <= (i or 0) < 2010 for i in near)
    assert ids <= kept["benchmark decontamination"] and not any(3000 <= (i or 0) < 3005 for i in kept["benchmark decontamination"])
    assert kept["source mix"] <= kept["benchmark decontamination"]
    run = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == kept["source mix"]


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [], [])
    odd = documents(spark, [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "x", None, "s", 1), (2, "y", None, "s", 1)])
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        assert stage(spark, odd, str(tmp_path)).count() <= 5
