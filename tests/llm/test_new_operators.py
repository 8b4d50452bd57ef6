"""Whitening, decision lists and conversation repair against brute force, with odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sensorlake.llm import conversations, quality_rules, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Whitening


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n string, x string, id int")


def brute_whitening(vectors, most=4):
    x = np.unique(np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64), axis=0)
    n = len(x)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return n, x.sum(axis=0), values[order], axes[:, order].T, np.trace(cov)


@pytest.mark.parametrize("kind", ["random", "low rank", "clusters", "equal", "zero", "diagonal", "wide", "single"])
def test_components_agree_with_the_library(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "single" else 24
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {
        "random": rng.random(d) * 9, "low rank": np.r_[rng.random(4), np.zeros(d - 4)] if d > 4 else None,
        "clusters": np.repeat([1.0, 1 + 1e-13, 2.0], d // 3 or 1)[:d], "equal": np.ones(d), "zero": np.zeros(d),
        "diagonal": np.arange(d, dtype=float), "wide": 10.0 ** np.linspace(-9, 3, d), "single": np.array([5.0]),
    }[kind]
    a = np.diag(values) if kind == "diagonal" else q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    size = max(np.linalg.norm(a), 1e-300)
    for most in (1, 4, d):
        got, axes = whitening.leading_components(a, most)
        assert len(got) == min(most, d)
        assert np.abs(got - np.linalg.eigvalsh(a)[::-1][:most]).max() <= 1e-13 * size
        assert np.abs(axes @ a - got[:, None] * axes).max() <= 1e-13 * size
        assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-13


def test_equal_diagonal_is_divided():
    values, _ = whitening.leading_components(np.array([[1, 0.5], [0.5, 1]]), 2)
    assert np.allclose(values, [1.5, 0.5], atol=1e-15)


def test_polar_factor_is_orthogonal_and_has_the_signs():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.abs(u @ u.T - np.eye(12)).max() < 1e-13
    assert int(round(np.trace(u))) == int(np.sign(np.linalg.eigvalsh(a)).sum())


def test_exact_products_of_large_entries():
    rng = random.Random(2)
    for bits in (3, 20, 26, 40, 60):
        rows = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        want = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(np.array(rows, np.int64)).tolist() == want


def test_whitened_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = (rng.standard_normal((60, 6)) @ rng.standard_normal((6, 6))).astype(np.float32)
    rows = [(i, v.tolist(), "c", "n", "x", 1) for i, v in enumerate(base)]
    rows += [(3, base[3].tolist(), "c", "n", "x", 1)] * 2 + [(None, base[0].tolist(), None, None, None, None)]
    rows += [(100 + i, base[7].tolist(), None, None, None, None) for i in range(40)]
    rows += [
        (900, None, None, None, None, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None, None, None),
        (902, [math.nan] * 6, None, None, None, None), (903, [math.inf] * 6, None, None, None, None),
        (904, [], None, None, None, None), (905, [1.0, 2.0], None, None, None, None), (906, [-math.inf] + [0.0] * 5, None, None, None, None),
    ]
    n, sums, values, axes, trace = brute_whitening(base)
    got = whitening.whitened(vectors_of(spark, rows).repartition(5)).collect()
    assert len(got) == 4 * (60 + 2 + 1 + 40)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, v in enumerate(base):
        x = np.floor(256 * v.astype(float)).astype(np.int64)
        for k in range(4):
            r = by[i, k + 1]
            assert r["n"] == n == 60
            assert r["deviation"] == sum(int(n * a - s) ** 2 for a, s in zip(x.tolist(), sums.tolist()))
            want = (x - sums / n) @ axes[k] / math.sqrt(values[k])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
            assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-12
            assert r["identity_error"] < 1e-10
    assert by[0, 1]["whitened"] == by[None, 1]["whitened"]


def test_whitening_without_spread_and_without_rows(spark):
    same = vectors_of(spark, [(i, [0.5, 0.25], None, None, None, None) for i in range(5)])
    rows = whitening.whitened(same).collect()
    assert len(rows) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(1, 0, None, None, None)}
    assert whitening.whitened(vectors_of(spark, [])).collect() == []
    assert whitening.whitened(vectors_of(spark, [(1, None, None, None, None, None), (2, [], None, None, None, None)])).collect() == []
    line = vectors_of(spark, [(i, [float(i), float(2 * i), 0.0], None, None, None, None) for i in range(9)])
    rows = whitening.whitened(line).collect()
    assert {r["component"] for r in rows if r["whitened"] is not None} == {1}


def test_whitening_of_huge_entries_does_not_crash(spark):
    rows = whitening.whitened(vectors_of(spark, [(1, [1e30, 0.0], None, None, None, None), (2, [-1e30, 1.0], None, None, None, None), (3, [0.0, 2.0], None, None, None, None)])).collect()
    assert len(rows) == 6 and any(r["deviation"] is None for r in rows)


# Decision lists


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)), "n_short": sum(len(w) == 1 for w in words),
        "n_distinct": len(set(words)), "n_loud": len(re.findall("[!?]", text)),
    }


def odd_texts():
    rng = random.Random(9)
    out = [None, "", " \t\n\x0b\x0c\r", "a", "a a a a", "é é\né é\né é", "x\n\nx\n \nx ", "A\x85b c \x1fd", "##|| <a> $%&*", "\n" * 50, "z" * 5000]
    for _ in range(60):
        out.append("".join(rng.choices(["a ", "b ", "c\n", "é", "#", "!? ", "D", "\t", "　", "𝄞 "], k=rng.randint(0, 120))))
    return out


def test_counts_equal_brute_force(monkeypatch):
    texts = odd_texts()
    got = quality_rules.text_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute_counts(text), repr(text)
    # The same from many small stretches.
    slices = quality_rules.tokens.slices
    monkeypatch.setattr(quality_rules.tokens, "slices", lambda offsets: slices(offsets, 40))
    cut = quality_rules.text_counts(pa.array(texts, pa.string()))
    assert all((cut[k] == got[k]).all() for k in got)
    assert all(len(v) == 0 for v in quality_rules.text_counts(pa.array([], pa.string())).values())


def labelled(spark, n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 120))]
        kind = i % 5
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "n", "k", 1))
        labels.append((i, 0 if kind < 2 else 1, 0))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, kept string, n_words string, bad int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_decision_list_learns_both_kinds_and_keeps_clean_rows(spark):
    docs, labels = labelled(spark)
    held_out = [r for r in labels if r[0] % 4 == 0]
    got = quality_rules.judge(*frames(spark, docs, [r for r in labels if r[0] % 4]))
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] == bool(q) for i, q, _ in held_out)


def test_spark_expression_agrees_with_the_rules(spark):
    docs, labels = labelled(spark)
    d, l = frames(spark, docs, labels)
    counts = quality_rules.counted(d)
    rules = quality_rules.train(counts, l)
    assert rules and all(1 <= len(r) <= 4 for r in rules)
    of = quality_rules.measures(counts)
    rows = counts.select(*(c.alias(n) for n, c in of.items()), quality_rules.verdict(rules, of).alias("kept")).toPandas()
    bad = np.zeros(len(rows), bool)
    for rule in rules:
        bad |= quality_rules.covers(rule, rows)
    assert (rows["kept"].to_numpy() == ~bad).all()


def test_best_threshold_equals_trying_all():
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({m: rng.integers(0, 6, 40).astype(float) for m in quality_rules.MEASURES})
    bad = rng.random(40) < 0.4
    gain, condition = quality_rules._best_condition(rows, bad, 3)
    before, best = math.log2(bad.mean()), 0.0
    for m in rows:
        values = sorted(set(rows[m]))
        for low, high in zip(values, values[1:]):
            for above in (False, True):
                held = quality_rules.Condition(m, above, (low + high) / 2).holds(rows)
                p = int((held & bad).sum())
                if p and held.sum() >= 3:
                    best = max(best, p * (math.log2(p / held.sum()) - before))
    assert math.isclose(gain, best)


def test_judged_rows_of_odd_tables(spark):
    docs = [(1, None, None, None, None), (2, "", "x", "y", 1), (None, "word " * 60, None, None, None), (4, "one two", None, None, 0),
            (4, "one two", None, None, 0), (5, " ".join(f"w{i}" for i in range(200_000)), None, None, 0)]
    d, l = frames(spark, docs, [(5, 1, None), (5, 0, 0), (None, 0, 0), (4, None, 1)])
    rows = quality_rules.judge(d, l).collect()
    assert len(rows) == 6
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_words"] == by[2]["word_chars"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    assert by[5]["kept"] and by[5]["n_words"] == 200_000 and by[None]["n_repeat_words"] == 60 and not by[None]["kept"]
    empty = frames(spark, [], [])
    assert quality_rules.judge(*empty).collect() == []
    assert {r["kept"] for r in quality_rules.judge(d, empty[1]).filter("doc_id = 5").collect()} == {True}


# Conversation repair


def brute_repair(shape):
    """Tries all edits, with at most two insertions in a row, by a table of strings."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None

    def walk(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not re.match(r"s?(ua)*u?$", roles):
            return
        if i == len(shape) and legal.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for r in "ua":
                walk(i, roles + r, cost + 5, audit + "I", inserted + 1)
        if i == len(shape):
            return
        mark = shape[i]
        walk(i + 1, roles, cost + 2, audit + "D", 0)
        if mark != "x":
            late = 5 if mark.isupper() else 0
            walk(i + 1, roles + mark.lower(), cost + late, audit + "K", 0)
            for r in "ua":
                walk(i + 1, roles + r, cost + 1 + late, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def test_lightest_repair_equals_trying_all_edits():
    rng = random.Random(6)
    shapes = ["".join(s) for n in range(4) for s in itertools.product("xsuaoSUA", repeat=n)]
    shapes += ["".join(rng.choices("xsuauaoUA", k=rng.randint(4, 6))) for _ in range(120)]
    for shape in shapes:
        assert conversations.lightest_repair(shape) == brute_repair(shape), shape


def table_repair(shape):
    """The same by a table of costs and whole strings, for long shapes."""
    at = {"": (0, "")}
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}

    def inserted(at):
        for _ in range(3):
            for state, (c, w) in list(at.items()):
                for r in "ua":
                    to = moves[state].get(r)
                    if to:
                        at[to] = min(at.get(to, (10**9, "")), (c + 5, w + "I"))
        return at

    inserted(at)
    for mark in shape:
        new = {}

        def offer(to, weight):
            new[to] = min(new.get(to, weight), weight)

        for state, (c, w) in at.items():
            offer(state, (c + 2, w + "D"))
            if mark != "x":
                late = 5 if mark.isupper() else 0
                if mark.lower() in moves[state]:
                    offer(moves[state][mark.lower()], (c + late, w + "K"))
                for r in "ua":
                    if r in moves[state]:
                        offer(moves[state][r], (c + late + 1, w + "R"))
        at = inserted(new)
    return min(at[s] for s in ("", "p") if s in at)


def test_long_conversations_equal_the_table():
    rng = random.Random(7)
    for n in (50, 400, 1500):
        shape = "".join(rng.choices("suauauaxoSUA", k=n))
        assert conversations.lightest_repair(shape) == table_repair(shape)


def test_audits_compare_like_strings():
    rng = random.Random(8)
    nodes = [conversations.Audit()]
    seen = {(0, e): None for e in ()}
    for _ in range(300):
        parent = rng.choice(nodes[-40:])
        edit = rng.choice("DIKR")
        if (id(parent), edit) not in seen:
            seen[id(parent), edit] = parent
            nodes.append(conversations.Audit(parent, edit))
    for a, b in itertools.product(rng.sample(nodes, 60), repeat=2):
        assert (a < b) == (str(a) < str(b))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    return out


def brute_digest(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen, shape = [], set(), ""
        for _, role, text in kept:
            last = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            mark = role[:1] if role[:1] in ("s", "u", "a") else "o"
            shape += "x" if fault in ("blank", "duplicate") else mark.upper() if fault else mark
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = table_repair(shape)
        said, i, state = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[i][1:]
            i += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            said.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def test_digests_equal_brute_force(spark):
    rng = random.Random(10)
    texts = ["Yes.", "Yes.", "No!", "cut", None, " ", "é?\n", "a\nb.", "\x0b", "x" * 30_000 + "?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux"]
    rows = [
        (conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts))
        for conv in range(150)
        for turn in range(rng.randint(1, 9))
    ]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    rows += [(777, t, "assistant" if t % 2 else "user", f"Row {t}.") for t in range(2_500)]
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, audit int"
    )
    want = brute_digest(rows)
    got = conversations.repair_digests(conversations.damage(df.repartition(7))).collect()
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_repaired_rows_are_legal_and_in_order(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [r for r in conversations.repaired_rows(df).collect() if r["place"]]
    assert [r["place"] for r in out] == list(range(1, len(out) + 1))
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in out))


def test_dropped_and_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_digests(conversations.damage(none)).collect() == []
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    df = spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")
    rows = conversations.repair_digests(conversations.damage(df)).collect()
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
