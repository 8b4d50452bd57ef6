import random

from conftest import make_frame

from sensorlake.operators import questions


def log(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_intent_order_and_node(spark):
    cases = {
        "Is M1 offline? trend today": ("module_status", "M1"),
        "Temperature TREND of m10": ("trend", "M10"),
        "all day summary": ("today", None),
        "how warm is M12": ("current", None),
        "M100 or xM1?": ("current", None),
        "what about (m11)": ("current", "M11"),
    }
    out = questions.with_node(questions.with_intent(log(spark, cases))).orderBy("id").collect()
    assert [(r.intent, r.node) for r in out] == list(cases.values())


def test_commands(spark):
    cases = {
        "/chart_day_m1_temp": ("chart", "day", "m1", "temp"),
        "/chart_week_all_co2": ("chart", "week", "all", "co2"),
        "/predict_m10_humid": ("predict", "m10", "humid", None),
        "/heatmap_tvoc": ("heatmap", "tvoc", None, None),
        "/compare_m1_m4": ("compare", "m1", "m4", None),
        "/rank_temp": ("rank", "temp", None, None),
        "/rank_noise": ("invalid", None, None, None),
        "/chart_year_all_temp": ("invalid", None, None, None),
        "/chart": ("menu", None, None, None),
        "/charts": (None, None, None, None),
        "hello": (None, None, None, None),
    }
    out = questions.parse_commands(log(spark, cases)).orderBy("id").collect()
    assert [(r.kind, r.arg1, r.arg2, r.arg3) for r in out] == list(cases.values())


def test_question_windows(spark):
    frame = make_frame(spark, {("M1", "Temp"): [1.0] * 28 + [None, 2.0], ("M4", "CO2"): [None] * 30})
    out = questions.question_windows(log(spark, ["M1 dead?", "trend", "now M4"]), frame).orderBy("id").collect()
    assert [(r.intent, r.window_rows, r.shown_rows, r.n_values) for r in out] == [
        ("module_status", 5, 5, 4), ("trend", 30, 20, 19), ("current", 10, 10, 0),
    ]


def common(a, b):
    """Longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def masks_of(text):
    return {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in text}


def slow_ratio(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0
    windows = [long[i : i + n] for i in range(len(long) - n + 1)]
    return int(round(100 * max(questions._lcs(masks_of(short), n, w) for w in windows) / n))


def test_common_subsequence_by_bits():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(1, 12))) for _ in range(2))
        assert questions._lcs(masks_of(a), len(a), b) == common(a, b)


WORDS = "is the temperature of node m1 m10 high low now please show trend co2 offline why when".split()


def sentences(n, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(2, 9))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = rng.choice("abcdeé ")
        out.append("".join(text))
    return out


def test_the_bound_never_hides_a_hit():
    texts = sentences(60, 4)
    hits = 0
    for a in texts:
        for b in texts:
            want = slow_ratio(a, b)
            got = questions.partial_ratio(a, b, 80)
            assert got == want or (want < 80 and got == 0)
            hits += want >= 80
    assert hits > 150


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    texts = sentences(50, 6) + ["Same question?"] * 40
    rng.shuffle(texts)
    rows = [(i, rng.randrange(0, 3000), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, asked_s bigint, text string")
    got = {r.id: (r.score, r.matched) for r in questions.cache_hits(df, ["id"]).collect()}
    want = {}
    for i, t, text in rows:
        scores = {
            o.strip().lower(): slow_ratio(text.strip().lower(), o.strip().lower())
            for _, s, o in rows
            if s < t and s >= t - 300
        }
        best = max(scores.values(), default=0)
        if best >= 80:
            same = text.strip().lower()
            ties = [q for q, v in scores.items() if v == best]
            want[i] = (best, same if best == 100 and same in ties else max(ties))
    assert got == want
    assert len(want) > 20
