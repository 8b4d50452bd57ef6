"""Kneser-Ney models against plain ones with dictionaries."""

import collections
import math
import random

import numpy as np
import pyarrow as pa

from sensorlake.llm import ftrl, kneser_ney, tokens


def plain_discounts(counts):
    n = collections.Counter(min(c, 5) for c in counts)
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    out, last = [0], 0.5
    for j in (1, 2, 3):
        if share and n[j] and n[j + 1]:
            last = j - (j + 1) * share * n[j + 1] / n[j]
        out.append(min(max(last, 0.05), j - 0.02))
    return out


def plain_word_model(texts):
    pairs = {(b, w) for t in texts for b, w in zip([None, *t], t)}
    counts = collections.Counter(w for _, w in pairs)
    d = plain_discounts(counts.values())
    total = sum(counts.values())
    free = sum(d[min(c, 3)] for c in counts.values()) / total
    return lambda word, shared: max(counts[word] - d[min(counts[word], 3)], 0) / total + free * shared


def plain_spelling(texts, order=kneser_ney.ORDER):
    tables = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        for w in t:
            s = ("<", *w.encode(), ">")
            for j in range(1, len(s)):
                gram = s[max(0, j - order + 1) : j + 1]
                tables[len(gram)][gram] += 1
    for k in range(order, 1, -1):
        for gram in tables[k]:
            tables[k - 1][gram[1:]] += 1
    ds = [plain_discounts(t.values()) for t in tables]

    def logp(word):
        s, total = ("<", *word.encode(), ">"), 0.0
        for j in range(1, len(s)):
            p = 1 / 258
            for k in range(1, min(j + 1, order) + 1):
                history = s[j - k + 1 : j]
                same = {g: c for g, c in tables[k].items() if g[:-1] == history}
                n = sum(same.values())
                if n:
                    c = same.get((*history, s[j]), 0)
                    free = sum(ds[k][min(c, 3)] for c in same.values())
                    p = max(c - ds[k][min(c, 3)], 0) / n + free / n * p
            total += math.log(p)
        return total

    return logp


def prose(rng, n, extra=()):
    return ["".join(rng.choices(["ka", "lo", "é", "t", "7"], k=rng.randint(1, 3))) if rng.random() > 0.1 or not extra else rng.choice(extra) for _ in range(n)]


def test_differences_equal_plain_models():
    rng = random.Random(3)
    toxic = [prose(rng, 40, ["scum", "scumm"]) for _ in range(12)]
    ordinary = [prose(rng, 40, ["kind"]) for _ in range(30)]
    columns = [[pa.array([" ".join(t) for t in c])] for c in (toxic, ordinary)]
    s = kneser_ney.Settings(bits=10)
    shared = np.arange(1 << 10, dtype=float)
    models = kneser_ney.Models(*columns, shared, s)
    words = sorted({w for t in toxic + ordinary for w in t} | {"new", "scummy", "x" * 40})
    data, offsets = tokens.utf8(pa.array(words))
    _, _, hashes, _ = tokens.words(data, offsets, tokens.LETTERS)
    got = models.differences(data, offsets[:-1], offsets[1:], hashes)
    weights = (shared + 0.1) / (shared.sum() + 0.1 * len(shared))
    base = weights[kneser_ney._place(hashes, 10)]
    a, b = plain_word_model(toxic), plain_word_model(ordinary)
    c, d = plain_spelling(toxic), plain_spelling(ordinary)
    for i, w in enumerate(words):
        assert abs(got[0, i] - math.log(a(w, base[i]) / b(w, base[i]))) < 1e-5
        assert abs(got[1, i] - (c(w) - d(w))) < 1e-9


def test_probabilities_of_a_model_sum_to_one():
    rng = random.Random(5)
    texts = [" ".join(prose(rng, 60)) for _ in range(20)]
    model = kneser_ney.SpellingModel([pa.array(texts)])
    history = [kneser_ney.OPEN, *(x + 1 for x in b"ka")]
    for length in range(len(history) + 1):
        head = 0
        for symbol in history[len(history) - length :]:
            head = (head << kneser_ney.SYMBOL) + symbol
        codes = (head << kneser_ney.SYMBOL) + np.r_[np.arange(1, 257), kneser_ney.OPEN, kneser_ney.CLOSE]
        assert abs(np.exp(model.log_probability(codes)).sum() - 1) < 1e-9


def test_discounts_lie_below_their_counts():
    rng = np.random.default_rng(0)
    for counts in (np.zeros(0), np.ones(5), np.array([1, 1, 1, 2, 2, 3, 4, 9]), rng.zipf(1.7, 4000), np.full(9, 50)):
        d = kneser_ney.discounts(counts)
        assert d[0] == 0 and all(0 < d[j] < j for j in (1, 2, 3))
        assert np.allclose(d, plain_discounts(counts.astype(int).tolist()))


def test_features_do_not_depend_on_batches_or_memory(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(prose(rng, rng.randint(0, 50), ["scum"])) for _ in range(60)] + [None, "", "!!", "Scum"]
    models = kneser_ney.Models([pa.array(texts[:20])], [pa.array(texts[20:60])], np.ones(1 << 8), kneser_ney.Settings(bits=8))
    whole = models.features(pa.array(texts))
    assert (whole[60:63] == 0).all() and (whole[63] != 0).any()
    monkeypatch.setattr(kneser_ney, "MOST_MET", 4)
    again = kneser_ney.Models.from_state(models.state())
    parts = np.concatenate([again.features(pa.array(texts[i : i + 7], pa.string())) for i in range(0, len(texts), 7)])
    assert np.allclose(whole, parts, atol=1e-12)


def test_repeated_ids_and_one_class(spark):
    rng = random.Random(2)
    rows = [(i % 150, " ".join(prose(rng, 40, ["scum"] if i % 150 % 3 == 0 else ())), "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "scum", "x"), (7, None, "x")], "doc_id long, text string, held string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(150)], "doc_id long, toxic int, quality int")

    def scores(frame):
        return sorted((r.doc_id or -1, r.score) for r in kneser_ney.toxicity_scores(frame, labels).collect())

    first = scores(docs)
    assert first == scores(docs.repartition(7)) and len(first) == 302
    assert all(0 <= s <= 1 for _, s in first)
    for toxic, want in ((0, 0), (1, 1)):
        one = labels.filter(f"toxic = {toxic}")
        assert {r.predicted for r in kneser_ney.toxicity_scores(docs, one).collect()} == {want}


def test_quality_weights_do_not_depend_on_the_order_of_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i % 40, " ".join(prose(rng, 30, ["#"] if i % 2 else ()))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = ftrl.train(docs, labels), ftrl.train(docs.repartition(5, "text"), labels)
    assert (a == b).all()
