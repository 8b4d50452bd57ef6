"""Corpus operators against brute force, with nulls, empty and long texts, repeats and empty tables."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from sensorlake.llm import (
    components,
    content_sort,
    decontaminate,
    fair_mix,
    ftrl,
    hyperminhash,
    kneser_ney,
    license_scan,
    tokens,
    transducer,
    url_lists,
    wrappers,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SYLLABLES = "ka lo mi ne pu ra so ti vu we xa yo".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def docs_of(spark, texts, source="s"):
    return make(spark, [(i, t, None, source, None) for i, t in enumerate(texts)])


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a long one, repeated rows, a null id and a null source."""
    long = "word " * 60_000
    return make(
        spark,
        [(1, None, None, "a", 0), (2, "", None, "a", 0), (3, " \t\n", None, None, 0), (4, "One two", "en", "b", 7),
         (4, "One two", "en", "b", 7), (5, long, None, "b", 1), (None, "One two", None, "a", 7), (6, "x" * 200_000, None, "c", 1)],
    )


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# Words


def test_words_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(1)
    texts = ["", prose(rng, 300), "a\x00b a", "x" * 500, "é ü", None, prose(rng, 50)]
    data, offsets = tokens.utf8(pa.array(texts))
    whole = tokens.words(data, offsets, tokens.WHOLE)
    monkeypatch.setattr(tokens, "STRETCH", 64)
    tokens._tables.clear()
    cut = tokens.words(data, offsets, tokens.WHOLE)
    tokens._tables.clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
    assert np.bincount(whole[0], minlength=len(texts)).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_equal_words_and_only_these_have_equal_hashes():
    rng = random.Random(2)
    words = prose(rng, 3000).split()
    data, offsets = tokens.utf8(pa.array([" ".join(words)]))
    hashes = tokens.words(data, offsets, tokens.WHOLE)[2].tolist()
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


# 1 URL lists


def test_captures_are_judged_by_the_entries_of_their_day(spark):
    entries = spark.createDataFrame(
        [("bad.org", "block", 10), ("bad.org", "drop", 20), ("ok.bad.org", "allow", 12), ("bad.org/x/", "allow", 15),
         ("t.org", "block", 5), ("t.org", "allow", 5), (None, "block", 1), ("u.org", "block", None)],
        "rule string, verdict string, listed_at int",
    )
    captures = spark.createDataFrame(
        [(1, "http://bad.org/", 9), (2, "http://bad.org/", 10), (3, "https://me@A.BAD.org.:80/y?q", 19), (4, "http://bad.org", 20),
         (5, "http://ok.bad.org/z", 13), (6, "http://bad.org/x/y", 16), (6, "http://bad.org/x/y", 16), (7, "http://t.org#f", 5),
         (8, None, 5), (9, "nonsense", 5), (10, "http://bad.org/", None), (11, "http://u.org/", 5)],
        "page_id int, url string, fetched int",
    ).selectExpr("*", "1 AS verdict")
    out = sorted((r["page_id"], r["verdict"], r["rule"]) for r in url_lists.judge(captures, entries).collect())
    n = "none"
    assert [(a, b) for a, b, _ in out] == [
        (1, n), (2, "block"), (3, "block"), (4, n), (5, "allow"), (6, "allow"), (6, "allow"), (7, "allow"), (8, n), (9, n), (10, n), (11, n)
    ]
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    assert {r["verdict"] for r in url_lists.judge(captures, entries.limit(0)).collect()} == {n}


# 2 Token counts


def test_counts_equal_the_library(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in transducer.token_counts(odd, MODEL).join(odd, "doc_id").collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 4096)
    assert transducer.token_counts(odd, MODEL).count() == odd.count()
    assert transducer.token_counts(none, MODEL).count() == 0


def test_counts_of_random_texts_and_cuts():
    library, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    machine = transducer.Transducer(transducer.read_vocabulary(MODEL))
    letters = list("aabbcehirnt  \n\t\r.,;(){}<s>0123 éñ中😀▁\x00")
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        want = len(library.encode(text))
        assert machine.count(text) == want
        assert machine.count(text, rng.randint(1, 9)) == want


def test_stretch_maps_compose_associatively():
    rng = random.Random(4)
    machine = transducer.Transducer(transducer.read_vocabulary(MODEL))
    for _ in range(200):
        a, b, c = (machine.stretch("".join(rng.choices("ab▁\n", k=rng.randint(1, 6)))) for _ in range(3))
        assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


# 3 Quality


def test_classifier_finds_marked_texts(spark):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(300)]
    bad = [i % 3 == 0 for i in range(300)]
    texts = [re.sub(r"(\w+)", r"\1!!", t) if b else t for t, b in zip(texts, bad)] + [None, ""]
    labels = spark.createDataFrame([(i, int(not b)) for i, b in enumerate(bad)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = docs_of(spark, texts)
    out = {r["doc_id"]: r for r in ftrl.quality_scores(docs, labels).collect()}
    assert len(out) == 302 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    wrong = [i for i, b in enumerate(bad) if out[i]["held_out"] and out[i]["predicted"] != int(not b)]
    assert not wrong
    assert ftrl.good_documents(docs, labels).columns == docs.columns


def test_classifier_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in ftrl.quality_scores(odd, labels).collect()} == {0.5}
    assert ftrl.quality_scores(none, labels).count() == 0


# 4 Near-duplicates


def near_truth(rows, n):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_all_pairs(spark, words):
    rng = random.Random(words)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.choice([1, 2, 4, 12, 60, 400])).split()
        for _ in range(rng.randint(1, 8)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.05, 0.1]) else rng.choice(SYLLABLES) for w in base]
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    truth = near_truth(list(enumerate(texts)), words)
    for block in (200_000, 300):
        out = hyperminhash.near_groups(docs_of(spark, texts), hyperminhash.Settings(words=words, block=block)).collect()
        assert {r["doc_id"]: r["component_id"] for r in out} == truth
        assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], words)) for r in out)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_groups_of_odd_rows(odd, none):
    out = hyperminhash.near_groups(odd, hyperminhash.Settings(words=2)).collect()
    assert len(out) == odd.count()
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, None: None}
    assert hyperminhash.near_groups(none).count() == 0
    assert hyperminhash.near_dedup(odd).count() == odd.count()


def test_register_estimate():
    rng = np.random.default_rng(0)
    s = hyperminhash.Settings()
    orders = hyperminhash.register_orders(s.registers)
    for size in (20, 200, 5000):
        shared = rng.integers(0, 2**63, size * 8 // 10, dtype=np.uint64)
        sets = [np.unique(np.r_[shared, rng.integers(0, 2**63, size // 10, dtype=np.uint64)]) for _ in range(2)]
        of = np.repeat([0, 1], [len(x) for x in sets])
        registers = hyperminhash.sketch(of, np.concatenate(sets), 2, s, orders)
        assert abs(hyperminhash.estimate(registers[:1], registers[1:], s.mantissa)[0, 0] - 0.8) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 170)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in out}
    assert len(out) == len(got)
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}


# 5 Mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 30)), None, ("a" if i % 3 else None if i % 2 else "b"), 0) for i in range(600)]
    docs = make(spark, rows)
    plan = fair_mix.mix_plan(docs, hash_ranges=8, time_ranges=16).collect()
    assert len(plan) == 600
    total = sum(r["size"] for r in plan)
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(1.5 * total)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 60
        assert rs[0]["target"] <= 2 * rs[0]["source_size"]
    again = fair_mix.mix_plan(docs.repartition(5), hash_ranges=64, time_ranges=128).collect()
    assert {(r["doc_id"], r["taken"]) for r in plan} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_of_odd_rows(odd, none):
    plan = fair_mix.mix_plan(odd).collect()
    assert len(plan) == odd.count() and all(r["taken"] == 0 for r in plan if not r["size"])
    assert fair_mix.mix_plan(none).count() == 0
    assert fair_mix.mixed_documents(none.selectExpr("*", "1 AS mix_copies")).count() == 0


# 6 Main texts


PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var a='</p>'</script></head><body><header>H</header><nav><ul><li>m"
    "</ul></nav><div class='cookie-notice'>n</div><aside>s</aside><div id=content><h1>A &amp; B</h1><p>One\n  <b>tw</b>o<br>three"
    "<p>{}</p><div class=comments><p>c</div><form>f</form><p>Join our list</p></div><footer>z</footer></body></html>"
)


def test_main_texts(spark, none):
    pages = [(i, f"http://h.org/{i}", PAGE.replace("{}", f"body {i}")) for i in range(30)]
    pages += [(30, "http://one.org/", PAGE.replace("{}", "x")), (31, None, None), (32, "u", ""), (33, "http://q.org/", "<p>cut &amp; <"), (33, "http://q.org/", "<p>cut &amp; <")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in wrappers.main_texts(frame).collect()}
    # Paragraphs are one slot, which varies; the heading is the same on all pages of the host.
    assert out[7]["text"] == "One two three\nbody 7\nJoin our list"
    assert out[30]["text"] == "A & B\nOne two three\nx\nJoin our list"
    assert out[31]["text"] == out[32]["text"] == "" and out[33]["text"].startswith("cut &")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert wrappers.main_texts(frame).count() == len(pages)
    assert wrappers.main_texts(frame.limit(0)).count() == 0


# 7 Licences


def test_licenses_equal_search(spark, odd, none):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        text = prose(rng, 40).split()
        if i % 2:
            text.insert(rng.randint(0, 40), rng.choice(license_scan.TEMPLATES)[1])
        texts.append(" ".join(text))
    want = {(i, n) for i, t in enumerate(texts) for n, x in license_scan.TEMPLATES if x in t}
    assert {(r["doc_id"], r["license"]) for r in license_scan.license_finds(docs_of(spark, texts)).collect()} == want
    assert license_scan.license_finds(odd).count() == license_scan.license_finds(none).count() == 0


# 8 Toxicity


def test_models_find_toxic_words(spark):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for _ in range(3):
                words.insert(rng.randint(0, 60), rng.choice(["vile", "scorn"]))
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in kneser_ney.toxicity_scores(docs_of(spark, texts + [None, ""]), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [i for i in range(400) if out[i]["held_out"]]
    assert sum(out[i]["predicted"] != int(toxic[i]) for i in held) <= 2
    assert out[400]["predicted"] == out[401]["predicted"] == 0


def test_toxicity_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in kneser_ney.toxicity_scores(odd, labels).collect()} == {0}
    assert kneser_ney.toxicity_scores(none, labels).count() == 0


# 9 Decontamination


def test_edited_passages_are_found(spark, odd, none):
    rng = random.Random(10)
    items = [prose(rng, 30) for _ in range(20)] + ["solo item", None, ""]
    texts = []
    for i in range(120):
        words = prose(rng, 100).split()
        if i < 40:
            passage = items[i % 20].upper().split() if i % 2 else items[i % 20].split()
            if i >= 20:
                passage = [w for k, w in enumerate(passage) if k % 9 != 4]
            words[50:50] = passage
        texts.append(" ".join(words))
    texts.append("Solo, item!")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, texts)
    want = {(i, i % 20) for i in range(40)} | {(120, 20)}
    for s in (decontaminate.Settings(), decontaminate.Settings(block_words=60)):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark, s).collect()} == want
    assert decontaminate.decontaminated(docs, benchmark).count() == 80
    assert decontaminate.leaks(odd, benchmark).count() == decontaminate.leaks(none, benchmark).count() == 0
    assert decontaminate.decontaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_alignment():
    s = decontaminate.Settings()
    item = np.arange(10)
    assert decontaminate.align(np.r_[90, item, 91], item, s) == (20, 10, 1, 10)
    assert decontaminate.align(np.r_[0, 1, 2, 99, 3, 4, 5], item, s)[:2] == (11, 6)


# 10 Exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_with_hot_text(spark, keep):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b ", "b", "A"]) * rng.randint(1, 3), None, None, 0) for i in range(900)]
    rows += [(3, "hot", None, None, 0), (None, "hot", None, None, 0), (901, None, None, None, 0), (902, "", None, None, 0)]
    docs = make(spark, rows)
    out = content_sort.exact_groups(docs, keep=keep, piece_rows=20, carry=True).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    assert len(out) == len(rows)
    for r in out:
        ids = groups[r["text"] or ""]
        assert (r["keep_id"], r["group_size"]) == (pick(i for i in ids if i is not None), len(ids))
    assert sum(r["kept"] for r in out) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert {r["doc_id"] for r in out if r["text"] is None} == {901}


def test_exact_dedup_of_odd_rows(odd, none):
    assert content_sort.exact_dedup(odd).columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in content_sort.exact_dedup(odd).collect()) == ["1", "3", "4", "5", "6"]
    assert content_sort.exact_dedup(none).count() == 0
    clash = content_sort.exact_groups(odd.selectExpr("*", "'x' AS kept", "1 AS keep_id"), carry=True)
    assert len(set(clash.columns)) == len(clash.columns) and clash.count() == odd.count()
