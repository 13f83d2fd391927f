"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import aside, slices, texts_of, words

GAPS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def repeat_words(w: np.ndarray) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(w) < 4:
        return 0
    tri = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(tri, kind="stable")
    same = tri[order[1:]] == tri[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(w) + 2, bool)
    twice = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(GAPS))
        seen.add(line)
    return n


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The five counts, and the forest's features, one of each count: the logged number of words, mean word length, and
    the logged rates of symbols, repeated words and repeated lines (of lines that are not blank)."""
    counts = np.zeros((len(texts), 5), np.int64)
    lines = np.ones(len(texts), np.int64)
    for a, b in slices(np.array([len(t) for t in texts], np.int64), 1 << 20):
        hashes, per = words(texts[a:b], fold=False)
        at = 0
        for i, n in zip(range(a, b), per.tolist()):
            t = texts[i]
            chars = len(t.translate(None, GAPS).decode("utf-8", "replace"))
            counts[i] = n, chars, len(t) - len(t.translate(None, SYMBOLS)), dup_lines(t), repeat_words(hashes[at : at + n])
            at += n
            if counts[i, 3]:
                lines[i] = sum(bool(line.strip(GAPS)) for line in t.split(b"\n"))
    n = np.maximum(counts[:, 0], 1)
    rates = np.column_stack([counts[:, (2, 4)] / n[:, None], counts[:, 3] / lines])
    return counts, np.column_stack([np.log(n), counts[:, 1] / n, np.log1p(100 * rates)])


@dataclass
class Forest:
    """Random splits on arrays of nodes: feature (-1: leaf), threshold, children, and the path length at a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    scale: float
    limit: float = field(default=1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, under 0.5 for rows like the rest."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                live = f >= 0
                if not live.any():
                    break
                go = x[rows, np.maximum(f, 0)] < self.threshold[node]
                node = np.where(live, np.where(go, self.left[node], self.right[node]), node)
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def expected_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, bounds: np.ndarray | None = None) -> Forest:
    """``x``: usual rows. Splits are drawn from a node's cell, which starts as ``bounds`` (lowest and highest of all
    rows, those of anomalies included), so regions that usual rows leave empty are cut off after a few splits."""
    bounds = np.array([x.min(0), x.max(0)]) if bounds is None else bounds
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(sample, 2))))
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, cell: np.ndarray, d: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, d + expected_path(len(rows))])
        open_ = np.flatnonzero(cell[0] < cell[1])
        if d < depth and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            t = rng.uniform(*cell[:, f])
            go = rows[:, f] < t
            under, over = cell.copy(), cell.copy()
            under[1, f] = over[0, f] = t
            nodes[me][:4] = f, t, grow(rows[go], under, d + 1), grow(rows[~go], over, d + 1)
        return me

    roots = [grow(x[rng.choice(len(x), sample, replace=False)], bounds, 0) for _ in range(trees)]
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), expected_path(sample))


def calibrate(score: np.ndarray, good: np.ndarray, false_rate: float) -> float:
    """The threshold with the best gain (bad rows found less good rows lost) among those that lose at most ``false_rate`` of the good rows; inf without both kinds."""
    if good.all() or not good.any():
        return float("inf")
    order = np.argsort(-score, kind="stable")
    s, g = score[order], good[order]
    lost, found = np.cumsum(g) / good.sum(), np.cumsum(~g) / (~good).sum()
    ends = np.append(s[1:] != s[:-1], True)
    fine = ends & (lost <= false_rate)
    if not fine.any():
        return float("inf")
    best = np.flatnonzero(fine)[np.argmax((found - lost)[fine])]
    below = s[best + 1] if best + 1 < len(s) else s[best]
    return float((s[best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = 8192, false_rate: float = 0.001) -> Forest | None:
    """Fit on at most ``rows`` labelled documents, those of the least hashed id; None without labelled documents.

    Null labels and ids are left out; of repeated labels the lowest counts, of repeated documents one row. Documents
    that fail the base rules, null and empty ones among them, take no part.
    """
    picked = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most `rows` ids of 12 bytes: a proven bound
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "__q", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = statistics(texts_of(b.column("text")))
            failed = base_failed(counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__q"), pa.array(failed), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "q", "failed", "x"])

    got = texts.mapInArrow(features, "doc_id long, q int, failed boolean, x array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("q", "failed", "x")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()  # at most `rows`
    got = [r for r in got if not r["failed"]]
    if len(got) < 8:
        return None
    x, good = np.array([r["x"] for r in got]), np.array([r["q"] > 0 for r in got])
    if not good.any():
        return None
    # grown on every second good row; the threshold comes from the others and the bad rows, which it has not seen
    grown = good & (np.cumsum(good) % 2 == 1)
    forest = fit_forest(x[grown], bounds=np.array([x.min(0), x.max(0)]))
    rest = ~grown if (good & ~grown).any() else np.ones(len(x), bool)
    forest.limit = calibrate(forest.score(x[rest]), good[rest], false_rate)
    return forest


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` plus the counts, base_failed, anomaly and kept. No shuffle: one pass of Arrow batches.

    Null and empty texts have no words, so they fail the base rules. Without a forest the base rules decide alone.
    Repeated rows are judged alike; a score at the threshold is rejected. Texts are counted whole, however long, and
    an empty table gives an empty result. Columns named like an output are replaced.
    """
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    docs = docs.drop(*made)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = statistics(texts_of(b.column(names.index("text"))))
            failed = base_failed(counts)
            score = forest.score(x) if forest is not None and len(x) else np.zeros(len(x))
            kept = ~failed & (score < forest.limit) if forest is not None else ~failed
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(counts[:, k]) for k in range(5)], pa.array(failed), pa.array(score), pa.array(kept)], [*names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, forest).select("doc_id", *COUNTS, "base_failed", "anomaly", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and forest keep, with the columns of ``docs``. Null and empty texts fail the base
    rules and go; repeated rows stay or go together; texts are judged whole, however long; a row whose anomaly
    is the limit itself goes; an empty table gives an empty one."""
    forest = train(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    apart, back = aside(docs, [x.split()[0] for x in SCHEMA.split(", ")])
    return judge(apart, forest).where("kept").select(*back)
