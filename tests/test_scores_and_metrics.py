import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from screenlake.functions.topic import clean
from screenlake.operators import metrics, scoring
from screenlake.plans import catalogue


def test_bm25_equals_the_formula(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("a b c d É x-y".split()) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None)]
    terms = {"a": 2, "b": 1, "x-y": 1, "absent": 3}
    words = {i: clean(t or "").split() for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    for r in scoring.bm25(spark.createDataFrame(docs, "id long, abstract string"), terms).collect():
        w, want = words[r["id"]], 0.0
        for t, q in terms.items():
            df = sum(t in x for x in words.values())
            tf = w.count(t)
            want += q * math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
        assert abs(r["bm25"] - want) < 1e-9


def plain_sweep(pairs, criterion, step):
    pos = sum(y for _, y in pairs)
    neg = len(pairs) - pos
    if not pos or not neg:
        return None
    start, stop = min(0.0, min(s for s, _ in pairs) - 1e-3), max(1.0, max(s for s, _ in pairs) + 1e-3)
    best = (-1.0, None)
    for i in range(max(1, math.ceil((stop - start) / step)) + 1):
        t = round(start + i * step, 10)
        tp, fp = sum(s >= t and y for s, y in pairs), sum(s >= t and not y for s, y in pairs)
        if criterion == "f1":
            p, r = (tp / (tp + fp) if tp + fp else 0), tp / pos
            v = 2 * p * r / (p + r) if p + r else 0.0
        else:
            v = tp / pos + (neg - fp) / neg - 1
        if v > best[0] + 1e-15:
            best = v, t
    return best[1]


@pytest.mark.parametrize("criterion", ["f1", "youden"])
def test_sweep_equals_the_loop(spark, criterion):
    rng = random.Random(4)
    groups = {g: [(rng.choice([rng.uniform(-0.5, 1.4), round(rng.uniform(0, 1), 2)]), rng.randint(0, 1)) for _ in range(rng.randint(1, 25))] for g in range(12)}
    rows = [(g, s, y) for g, ps in groups.items() for s, y in ps]
    got = {r["g"]: r["threshold"] for r in scoring.sweep(spark.createDataFrame(rows, "g int, score double, y int"), ["g"], criterion).collect()}
    want = {g: t for g, ps in groups.items() if (t := plain_sweep(ps, criterion, 0.01)) is not None}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_thresholds_need_both_classes(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.2)], "id long, score double")
    gold = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "paper_id long, consensus_label string")
    assert scoring.derive_threshold(s, gold("in-scope", "disagree")) is None and 0.2 < scoring.derive_threshold(s, gold("in-scope", "hybrid")) <= 0.5
    with pytest.raises(ValueError):
        scoring.derive_threshold(s, gold("in-scope", "hybrid"), "odd")
    with pytest.raises(ValueError):
        scoring.derive_threshold(s, gold("in-scope", "hybrid"), step=0)


def test_evaluate_and_bootstrap(spark):
    papers = spark.createDataFrame([(1, "Power analysis of an arbiter PUF by probing"), (2, "A deep learning model of puf responses"), (3, None), (4, "Plain text about gardens and rivers")], "id long, abstract string")
    got = {r["paper_id"]: r for r in scoring.evaluate_corpus(papers).collect()}
    assert [got[i]["relevance_class"] for i in (1, 2, 3, 4)] == ["in-scope", "out-of-scope", "out-of-scope", "out-of-scope"] and got[1]["threshold"] == 0.15 and got[3]["score"] == 0
    assert scoring.evaluate_paper(papers, 1).first()["score"] == got[1]["score"]
    kept = scoring.statistics(papers)
    for i in (2, 3):  # nothing but the paper and the kept row is read
        assert scoring.evaluate_paper(papers.where(F.col("id") == i), i, corpus=kept).first() == got[i]
    with pytest.raises(ValueError):
        scoring.evaluate_paper(papers, 99)
    gold = spark.createDataFrame([(i, "in-scope" if i % 2 else "hybrid") for i in range(1, 21)], "paper_id long, consensus_label string")
    scores = spark.createDataFrame([(i, 0.9 if i % 2 else 0.1) for i in range(1, 21)], "id long, score double")
    ci = {r["criterion"]: r for r in scoring.intervals(scoring.bootstrap(scores, gold, 50)).collect()}
    assert ci["f1"]["n"] <= 50 and 0.1 < ci["f1"]["low"] <= ci["f1"]["median"] <= ci["f1"]["high"] <= 0.9


def first_best(pairs, criterion):
    """As the reference sweeps: the first strict maximum."""
    pos = sum(y for _, y in pairs)
    neg = len(pairs) - pos
    if not pos or not neg:
        return None
    start, stop = min(0.0, min(s for s, _ in pairs) - 1e-3), max(1.0, max(s for s, _ in pairs) + 1e-3)
    best = (-1.0, None)
    for i in range(max(1, math.ceil((stop - start) / 0.01)) + 1):
        t = round(start + i * 0.01, 10)
        tp, fp = sum(s >= t and y for s, y in pairs), sum(s >= t and not y for s, y in pairs)
        p, r = (tp / (tp + fp) if tp + fp else 0.0), tp / pos
        v = (2 * p * r / (p + r) if p + r else 0.0) if criterion == "f1" else r + (neg - fp) / neg - 1.0
        if v > best[0]:
            best = v, t
    return best[1]


def test_bootstrap_equals_the_loop(spark):
    rng = random.Random(8)
    labels = [(i, rng.choice(["in-scope", "hybrid", "out-of-scope", "disagree"])) for i in range(24)]
    score = {i: rng.choice([rng.uniform(-0.3, 1.2), round(rng.uniform(0, 1), 2)]) for i in range(24) if i % 11}
    gold = {i: int(c == "in-scope") for i, c in labels if c != "disagree"}
    draw, ends, drawn, place = random.Random(42), {"f1": [], "youden": []}, [], {i: n for n, i in enumerate(gold)}
    for b in range(1000):
        sample = dict(draw.choices(list(gold.items()), k=len(gold)))
        drawn += [(b, place[i]) for i in sample]
        pairs = [(score[i], y) for i, y in sample.items() if i in score]
        for c in ends:
            if (t := first_best(pairs, c)) is not None:
                ends[c].append(t)
    scores, consensus = spark.createDataFrame(list(score.items()), "id long, score double"), spark.createDataFrame(labels, "paper_id long, consensus_label string")
    draws = spark.createDataFrame(drawn, "round int, nth long")
    got = scoring.at_medians(scoring.intervals(scoring.bootstrap(scores, consensus, draws=draws)), scores, consensus).collect()
    assert {r["criterion"] for r in got} == set(ends)
    for r in got:
        t = sorted(ends[r["criterion"]])
        cut = t[len(t) // 2]
        assert (r["n"], r["low"], r["high"], r["median"]) == (len(t), t[int(0.025 * len(t))], t[int(0.975 * len(t))], cut)
        tp, fp = (sum(score.get(i, 0) >= cut and y == k for i, y in gold.items()) for k in (1, 0))
        p, q = (tp / (tp + fp) if tp + fp else 0.0), tp / sum(gold.values())
        assert all(abs(a - b) < 1e-12 for a, b in zip((r["precision"], r["recall"], r["f1"]), (p, q, 2 * p * q / (p + q) if p + q else 0.0)))


def test_bootstrap_draws_by_hash(spark):
    """The same draws anywhere, even over the numbers, and thresholds equal to a loop over them."""
    rng = random.Random(3)
    score, y = {i: round(rng.random(), 3) for i in range(40)}, {i: rng.random() < 0.4 for i in range(40)}
    hashed = lambda b, j: int(hashlib.md5(f"7:{b}:{j}".encode()).hexdigest()[:12], 16) % 40
    scores, consensus = spark.createDataFrame(list(score.items()), "id long, score double"), spark.createDataFrame([(i, "in-scope" if v else "hybrid") for i, v in y.items()], "paper_id long, consensus_label string")
    got = {(r["round"], r["criterion"]): r["threshold"] for r in scoring.bootstrap(scores, consensus, 60, seed=7).collect()}
    want = {(b, c): first_best([(score[i], y[i]) for i in {hashed(b, j) for j in range(40)}], c) for b in range(60) for c in ("f1", "youden")}
    assert got == want
    one = spark.range(20000).select(scoring.draw(1, F.lit(0), F.col("id"), 10).alias("n")).groupBy("n").count().collect()
    assert len(one) == 10 and all(1800 < r["count"] < 2200 for r in one)
    with pytest.raises(ValueError):
        scoring.bootstrap(scores, consensus.limit(0))


def test_bootstrap_query_has_all_rounds(spark):
    got = catalogue.QUERIES["bootstrap_intervals"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 2 and all(900 < r["n"] <= 1000 and 0 <= r["f1"] <= 1 for r in got)


def from_matrix(spark, matrix):
    names = ("in-scope", "out-of-scope", "hybrid")
    rows, i = [], 0
    for g, line in zip(names, matrix):
        for p, n in zip(names, line):
            for _ in range(n):
                rows.append((1, i, p, None, g))
                i += 1
    return spark.createDataFrame(rows, "run_id long, paper_id long, decision string, score double, gold string")


def test_published_matrices(spark):
    m = metrics.metrics(from_matrix(spark, [[15, 0, 1], [0, 15, 2], [1, 2, 14]])).first()
    assert (m["n"], m["accuracy"]) == (50, 0.88) and abs(m["kappa"] - 0.8199279711884755) < 1e-12 and abs(m["macro_f1"] - 0.8811274509803922) < 1e-12
    m = metrics.metrics(from_matrix(spark, [[15, 0, 1], [1, 14, 2], [1, 2, 14]])).first()
    assert abs(m["kappa"] - 0.7900419916016796) < 1e-12 and abs(m["macro_f1"] - 0.8603683897801545) < 1e-12
    two = metrics.metrics(from_matrix(spark, [[2, 0, 0], [0, 1, 0], [0, 0, 0]])).first()
    assert abs(two["macro_f1"] - 2 / 3) < 1e-12 and two["kappa"] == 1 and two["auc_in_scope"] == 1


def test_auc(spark):
    def auc(*rows):
        df = spark.createDataFrame([(1, i, "in-scope", s, "in-scope" if y else "hybrid") for i, (s, y) in enumerate(rows)], "run_id long, paper_id long, decision string, score double, gold string")
        return metrics.roc_auc(df).first()["auc_in_scope"]

    assert auc((0.9, 1), (0.1, 0)) == 1 and auc((0.1, 1), (0.9, 0)) == 0 and auc((0.5, 1), (0.5, 0)) == 0.5 and auc((0.5, 1)) is None


def test_agreement(spark):
    rows = [(p, a, l) for p, ls in enumerate([("in-scope", "in-scope"), ("out-of-scope", "out-of-scope"), ("hybrid", "hybrid"), ("in-scope", "hybrid")], 1) for a, l in zip("ab", ls)]
    gt = spark.createDataFrame(rows, "paper_id long, annotator_id string, label string")
    assert abs(metrics.cohen_kappa(gt).first()["kappa"] - 0.6363636363636364) < 1e-12
    assert {r["paper_id"]: r["consensus_label"] for r in metrics.consensus(gt).collect()} == {1: "in-scope", 2: "out-of-scope", 3: "hybrid", 4: "disagree"}
    assert metrics.fleiss_kappa(gt).first() is None
    three = spark.createDataFrame([(p, a, l) for p, l in ((1, "in-scope"), (2, "hybrid")) for a in "abc"], "paper_id long, annotator_id string, label string")
    assert metrics.fleiss_kappa(three).first()["kappa"] == 1 and metrics.fleiss_kappa(three, variant="reference").first()["kappa"] < 0
