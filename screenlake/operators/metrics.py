"""Agreement of annotators and quality of classifiers, for all runs at once."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.schemas import LABELS

SHORT = {"in-scope": "in", "out-of-scope": "out", "hybrid": "hybrid"}


def ratio(a: Column, b: Column, empty: Column | float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(empty if isinstance(empty, Column) else F.lit(empty))


def safe_kappa(observed: Column, expected: Column) -> Column:
    """Null where the expected agreement is 1 or more."""
    return F.when(expected < 1, (observed - expected) / (1 - expected))


def consensus(ground_truth: DataFrame) -> DataFrame:
    """paper_id, consensus_label (the common label, else disagree), n_annotators, n_agree, method."""
    per = ground_truth.groupBy("paper_id", "label").agg(F.count("*").alias("c"))
    top = per.groupBy("paper_id").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("m"))
    whole = F.col("m.c") == F.col("n")
    return top.select(
        "paper_id", F.when(whole, F.col("m.label")).otherwise("disagree").alias("consensus_label"), F.col("n").cast("int").alias("n_annotators"),
        F.col("m.c").cast("int").alias("n_agree"), F.when(whole, "unanimous").otherwise("majority").alias("method"))


def kappa_of_pairs(pairs: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by..., n, kappa of (a, b) label pairs: one aggregate over counts of agreement and of each label on each side."""
    marks = [F.count_if(F.col(c) == x).alias(f"{c}{i}") for i, x in enumerate(labels) for c in ("a", "b")]
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), *marks)
    n = F.col("n")
    expected = reduce(add, [F.col(f"a{i}") / n * (F.col(f"b{i}") / n) for i in range(len(labels))])
    return g.select(*by, "n", F.when(n > 0, safe_kappa(F.col("same") / n, expected)).alias("kappa")) if by else g.where("n > 0").select("n", safe_kappa(F.col("same") / n, expected).alias("kappa"))


def cohen_kappa(ground_truth: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """n, kappa of exactly two annotators over what both labelled; no row with another number of annotators."""
    who = ground_truth.agg(F.min("annotator_id").alias("first"), F.max("annotator_id").alias("second"), F.count_distinct("annotator_id").alias("raters"))
    both = ground_truth.crossJoin(F.broadcast(who)).where("raters = 2")  # one row
    side = both.groupBy("paper_id").agg(F.max(F.when(F.col("annotator_id") == F.col("first"), F.col("label"))).alias("a"), F.max(F.when(F.col("annotator_id") == F.col("second"), F.col("label"))).alias("b"))
    return kappa_of_pairs(side.where("a is not null and b is not null"), labels)


def fleiss_kappa(ground_truth: DataFrame, labels: tuple[str, ...] = LABELS, variant: str = "standard") -> DataFrame:
    """n, kappa of more than two annotators. ``variant`` 'reference' subtracts the number of raters once for each label, as the study's figures do; 'standard' once for each paper."""
    if variant not in ("standard", "reference"):
        raise ValueError(f"unknown variant {variant!r}")
    raters = F.broadcast(ground_truth.agg(F.count_distinct("annotator_id").alias("r")))  # one row
    counts = ground_truth.groupBy("paper_id").agg(*[F.count_if(F.col("label") == x).alias(f"c{i}") for i, x in enumerate(labels)])
    c = [F.col(f"c{i}") for i in range(len(labels))]
    squares = reduce(add, [x * x for x in c])
    taken = F.col("r") * (len(labels) if variant == "reference" else 1)
    agreed = (squares - taken) / (F.col("r") * (F.col("r") - 1))
    total = counts.crossJoin(raters).where("r > 2").groupBy("r").agg(F.count("*").alias("n"), F.avg(agreed).alias("p"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(c)])
    expected = reduce(add, [(F.col(f"s{i}") / (F.col("n") * F.col("r"))) ** 2 for i in range(len(labels))])
    return total.select("n", safe_kappa(F.col("p"), expected).alias("kappa"))


def judged(evals: DataFrame, gold: DataFrame) -> DataFrame:
    """run_id, paper_id, decision, score, gold: evaluated papers with a consensus label other than disagree."""
    g = gold.where("consensus_label <> 'disagree'").select("paper_id", F.col("consensus_label").alias("gold"))
    return evals.join(g, "paper_id").select("run_id", "paper_id", "decision", "score", "gold")


def confusion(pairs: DataFrame) -> DataFrame:
    """run_id and nine counts g_p (gold, predicted), zeros included."""
    return pairs.groupBy("run_id").agg(*[
        F.count_if((F.col("gold") == g) & (F.col("decision") == p)).alias(f"{SHORT[g]}_{SHORT[p]}") for g in LABELS for p in LABELS])


def confusion_rows(pairs: DataFrame) -> DataFrame:
    """run_id, gold, decision, n with a row for each of the nine cells."""
    cells = F.array(*[F.struct(F.lit(g).alias("gold"), F.lit(p).alias("decision"), F.col(f"{SHORT[g]}_{SHORT[p]}").alias("n")) for g in LABELS for p in LABELS])
    return confusion(pairs).select("run_id", F.inline(cells))


def roc_auc(pairs: DataFrame) -> DataFrame:
    """run_id, auc of in-scope against the rest by ranks with ties; null with one class only.

    A missing score counts as 1 or 0 by the decision. Rows are first counted by score, so the window holds different
    scores, not rows.
    """
    s = F.coalesce("score", F.when(F.col("decision") == "in-scope", 1.0).otherwise(0.0))
    per = pairs.select("run_id", s.alias("s"), (F.col("gold") == "in-scope").cast("long").alias("y")).groupBy("run_id", "s").agg(F.count("*").alias("c"), F.sum("y").alias("p"))
    below = F.sum("c").over(Window.partitionBy("run_id").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = per.withColumn("rank", below + (F.col("c") + 1) / 2)
    g = ranked.groupBy("run_id").agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").alias("pos"), F.sum(F.col("c") - F.col("p")).alias("neg"))
    p, n = F.col("pos"), F.col("neg")
    return g.select("run_id", F.when((p > 0) & (n > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * n)).alias("auc_in_scope"))


def metrics(pairs: DataFrame) -> DataFrame:
    """One row for each run: n, accuracy, precision, recall and F1 by class and in the mean of three, kappa, AUC, confusion, and the binary figures (in-scope against the rest)."""
    cell = lambda g, p: F.col(f"{SHORT[g]}_{SHORT[p]}")
    total = reduce(add, [cell(g, p) for g in LABELS for p in LABELS])
    rows = {g: reduce(add, [cell(g, p) for p in LABELS]) for g in LABELS}
    cols = {p: reduce(add, [cell(g, p) for g in LABELS]) for p in LABELS}
    right = reduce(add, [cell(x, x) for x in LABELS])
    out: dict[str, Column] = {"n": total, "accuracy": ratio(right, total)}
    scores: dict[str, list[Column]] = {"precision": [], "recall": [], "f1": []}
    for x in LABELS:
        p, r = ratio(cell(x, x), cols[x]), ratio(cell(x, x), rows[x])
        for name, value in (("precision", p), ("recall", r), ("f1", ratio(2 * p * r, p + r))):
            out[f"{name}_{SHORT[x]}"] = value
            scores[name].append(value)
    for name, values in scores.items():
        out[f"macro_{name}"] = reduce(add, values) / 3
    out["kappa"] = F.when(total > 0, safe_kappa(right / total, reduce(add, [rows[x] / total * (cols[x] / total) for x in LABELS])))
    tp = cell("in-scope", "in-scope")
    fp, fn = cols["in-scope"] - tp, rows["in-scope"] - tp
    tn = total - tp - fp - fn
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    expected = (tp + fn) / total * ((tp + fp) / total) + (fp + tn) / total * ((fn + tn) / total)
    out |= {"binary_tp": tp, "binary_fp": fp, "binary_fn": fn, "binary_tn": tn, "binary_accuracy": ratio(tp + tn, total), "binary_precision": p, "binary_recall": r, "binary_f1": ratio(2 * p * r, p + r), "binary_kappa": F.when(total > 0, safe_kappa((tp + tn) / total, expected))}
    c = confusion(pairs)
    return c.select("run_id", *[v.alias(k) for k, v in out.items()], *[x for x in c.columns if x != "run_id"]).join(roc_auc(pairs), "run_id")


def summary(runs: DataFrame, evals: DataFrame, gold: DataFrame) -> DataFrame:
    """All runs with their metrics; ``note`` tells where a run has nothing to compare."""
    m = metrics(judged(evals, gold))
    named = runs.select(F.col("id").alias("run_id"), "method", "model", "prompt_id", "run_index")
    return named.join(m, "run_id", "left").withColumn("note", F.when(F.col("n").isNull(), "no evaluated papers with a consensus label"))


def runs_with_counts(runs: DataFrame, evals: DataFrame) -> DataFrame:
    """Runs with n_evals, those without evals included."""
    n = evals.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n_evals"))
    return runs.join(n, "id", "left").withColumn("n_evals", F.coalesce("n_evals", F.lit(0)))
