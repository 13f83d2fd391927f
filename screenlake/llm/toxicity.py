"""Toxicity: cumulative-link ordinal regression on sparse text features.

One weight vector serves every threshold: P(grade > k) = sigmoid(w.x - b_k) with b_1 <= b_2 <= b_3. Features are
the distinct lower-case words of a text and their beginnings; every feature of the training rows that leans towards a
class well beyond chance gets a weight. Expected severity is the sum of the P(grade > k).

Labels that hold grades (0 to 3) are learnt as they are. Labels that only say toxic or not have no order to learn, so
toxic rows are graded by a binary model of the same form that was fitted on the other half of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages, aside, slices

GRADES = 3
SCHEMA = "severity double, grade int, toxic boolean"
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@"
PREFIXES = (4, 5, 6)


def features(text: str) -> set[str]:
    """Distinct lower-case words without marks at their edges, and their beginnings, marked with a star."""
    plain = {w.strip(_EDGE) for w in set(text.lower().split())}
    plain.discard("")
    out = set(plain)
    for n in PREFIXES:
        out |= {w[:n] + "*" for w in plain if len(w) >= n}
    return out


def parts(b: pa.RecordBatch, text: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``b`` in parts of at most ``limit`` bytes of text each, or of one row; a text's words take many times its bytes."""
    lengths = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for s, e in slices(lengths, limit):
        yield b.slice(s, e - s)


def word_lists(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, words) of batches of (doc_id, __t, text): the sorted features of each text."""
    for whole in batches:
        for b in parts(whole, whole.schema.get_field_index("text"), limit):
            found = [sorted(features(t)) for t in b.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__t"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "t", "words"])


@dataclass
class Model:
    weights: dict[str, float]
    cuts: np.ndarray
    limit: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Sum of the weights of each text's features; a word's features are looked up once for all of the texts."""
        w = self.weights
        heads = {k.rstrip("*")[: PREFIXES[0]] for k in w}
        known: dict[str, tuple[str, ...]] = {}

        def features_of(x: str) -> tuple[str, ...]:
            plain = x if x[0].isalnum() and x[-1].isalnum() else x.strip(_EDGE)
            if plain[: PREFIXES[0]] not in heads:
                return ()
            return tuple(w.keys() & {plain, *[plain[:n] + "*" for n in PREFIXES if len(plain) >= n]})

        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for x in set(text.lower().split()):
                has = known.get(x)
                if has is None:
                    has = known[x] = features_of(x)
                if has:
                    found.update(has)
            out[i] = sum(w[k] for k in sorted(found))
        return out

    def severity(self, logits: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.cuts[None, :] - logits[:, None], -40, 40)))).sum(1)


@dataclass(frozen=True)
class Rows:
    """Sets of features, one after the other: ``at`` has the features' numbers, ``row`` the row of each."""

    at: np.ndarray
    row: np.ndarray
    rows: int
    size: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.rows)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, d[self.row], self.size)

    def only(self, keep: np.ndarray) -> Rows:
        k = keep[self.row]
        return Rows(self.at[k], (np.cumsum(keep) - 1)[self.row[k]], int(keep.sum()), self.size)


def fit(x: Rows, y: np.ndarray, grades: int = GRADES, ridge: float = 1e-3, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the log likelihood of the cumulative logits; cuts are a first value plus squares, so they stay ordered."""
    n = x.size
    p = np.zeros(n + grades)
    p[n:] = 0.5
    m, v = np.zeros_like(p), np.zeros_like(p)
    over = (y[:, None] > np.arange(grades)[None, :]).astype(float)
    for t in range(1, steps + 1):
        w, c = p[:n], p[n:]
        cuts = c[0] + np.concatenate(([0.0], np.cumsum(c[1:] ** 2)))
        z = np.clip(x.dot(w)[:, None] - cuts[None, :], -40, 40)
        d = (1 / (1 + np.exp(-z)) - over) / len(y)
        gc = -d.sum(0)
        g = np.concatenate((x.back(d.sum(1)) + ridge * w, [gc.sum()], [2 * c[k] * gc[k:].sum() for k in range(1, grades)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p = p - step
        if np.abs(step).max() < 1e-3:
            break
    c = p[n:]
    return p[:n], c[0] + np.concatenate(([0.0], np.cumsum(c[1:] ** 2)))


def graded(x: Rows, toxic: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """0 for rows that are not toxic, else 1 to 3 by the thirds of the logits that a model of the other fold gives."""
    logit = np.zeros(x.rows)
    for f in (False, True):
        other = fold != f
        if toxic[other].any() and not toxic[other].all():
            logit[~other] = x.only(~other).dot(fit(x.only(other), toxic[other].astype(int), 1)[0])
    y = toxic.astype(int)
    for q in (1 / 3, 2 / 3):
        y = y + (toxic & (logit > np.quantile(logit[toxic], q)))
    return y


def train(docs: DataFrame, labels: DataFrame, rows: int = 12000, least: float = 12.0) -> Model | None:
    """Fit on at most ``rows`` labelled documents, those of the least hashed id. None without both kinds of label.

    labels: doc_id, toxic: 0, or a grade up to 3; if none is over 1 the labels are binary (see above). ``least``: the
    likelihood ratio of a feature against chance, from which on it is used. Null labels and ids are left out; of
    repeated labels the highest counts, of repeated documents one row.
    """
    stages = Stages(docs.sparkSession, "toxicity")
    picked = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__t"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))

    # at most `rows` ids of 12 bytes: a proven bound
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(word_lists, "doc_id long, t int, words array<string>")
    got = stages.save("sample", got.groupBy("doc_id").agg(F.min(F.struct("t", "words")).alias("r")).select("doc_id", F.col("r.t").alias("grade"), F.least("r.t", F.lit(1)).alias("t"), "r.words"))
    # counts by word and class stay on the executors; only words that lean to a class come to the driver
    total = got.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n, n1 = float(total["n"]), float(total["t"])
    if n1 < 5 or n - n1 < 5:
        stages.drop("sample")
        return None
    by_word = got.select("t", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("s"), F.sum("t").alias("a"))
    s, a = F.col("s").cast("double"), F.col("a").cast("double")
    p = s / n

    def part(o, e):
        return F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0)

    g = part(a, n1 * p) + part(s - a, (n - n1) * p) + part(n1 - a, n1 * (1 - p)) + part(n - n1 - s + a, (n - n1) * (1 - p))
    leaning = stages.save("leaning", by_word.where(g > least / 2).select("w"))
    data = got.select("doc_id", "grade", F.explode("words").alias("w")).join(leaning, "w").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.sort_array(F.collect_list("w")).alias("words"))
    found = {r["doc_id"]: r["words"] for r in data.collect()}  # at most `rows` rows
    grades = {r["doc_id"]: r["grade"] for r in got.select("doc_id", "grade").collect()}
    stages.drop("sample", "leaning")
    chosen = {w: i for i, w in enumerate(sorted({w for ws in found.values() for w in ws}))}
    if not chosen:
        return None
    ids = sorted(grades)
    lists = [[chosen[w] for w in found.get(i, ())] for i in ids]
    x = Rows(np.array([k for ks in lists for k in ks], np.int64), np.repeat(np.arange(len(ids)), [len(ks) for ks in lists]), len(ids), len(chosen))
    grade = np.array([grades[i] for i in ids])
    toxic = grade > 0
    y = np.minimum(grade, GRADES) if grade.max() > 1 else graded(x, toxic, np.array(ids) % 2 == 1)
    w, cuts = fit(x, np.maximum(y, 0))
    model = Model(dict(zip(chosen, w.tolist())), cuts, 0.5)
    model.limit = threshold(model.severity(x.dot(w)), toxic)
    return model


def threshold(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The cut between two severities with the fewest labelled rows on the wrong side."""
    order = np.argsort(severity, kind="stable")
    s, t = severity[order], toxic[order]
    wrong = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((~t)[::-1])[::-1], [0]))
    ok = np.concatenate(([True], s[1:] > s[:-1], [True]))
    k = int(np.flatnonzero(ok)[np.argmin(wrong[ok])])
    return float(s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` plus severity (0 to 3), toxic (severity over the model's limit) and grade: 0 if not toxic, else the
    nearest of 1 to 3. One pass of Arrow batches over whole texts, however long.

    Null and empty texts have no features: severity is that of a text without evidence, so they are not toxic.
    Without a model (no usable labels) every severity is 0. Repeated rows are judged alike; a severity at the limit is
    not toxic. An empty table gives an empty result. Columns named like an output are replaced.
    """
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    docs = docs.drop(*made)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, names.index("text"), 1 << 23):
                texts = b.column(names.index("text")).fill_null("").to_pylist()
                sev = model.severity(model.logits(texts)) if model else np.zeros(len(texts))
                bad = sev > model.limit if model else np.zeros(len(texts), bool)
                grade = np.where(bad, np.maximum(np.rint(sev), 1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sev), pa.array(grade), pa.array(bad)], [*names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", "severity", "grade", "toxic")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with the columns of ``docs``. Null and empty texts stay; equal texts stay or go
    together, whatever their ids; texts are judged whole, however long; a severity at the limit itself is not toxic; an
    empty table gives an empty one."""
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    apart, back = aside(docs, [x.split()[0] for x in SCHEMA.split(", ")])
    return judge(apart, model).where("not toxic").select(*back)
