"""Embedding near-dedup by spherical-cap filters.

Each half of the dimensions has a random code of unit vectors; a filter is a pair of code words, one of each half,
and its direction their joint vector. A vector is listed under every filter whose inner product with it exceeds a
bound, found by pruned search of the product code, not by trying all filters. Vectors of one label that share a
filter are compared exactly; a pair is counted under its least common filter only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages, components


@dataclass(frozen=True)
class Options:
    """``tables``: product codes, each after a random rotation of its own. ``listed``: filters of a code that a vector
    exceeds on average. ``bucket``: vectors of a label under a filter on average, as far as the code's size decides
    it. ``miss_rate`` measures how many pairs at exactly the cosine bound share no filter. ``block``: rows that a
    task holds at a time."""

    cosine: float = 0.93
    tables: int = 4
    listed: int = 10
    bucket: int = 512
    block: int = 2048
    seed: int = 11


@dataclass(frozen=True)
class Code:
    turn: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bound: float

    def listed(self, x: np.ndarray) -> list[np.ndarray]:
        """Filters of each unit vector: code words in falling order of the second half, cut where the bound fails."""
        h = len(self.first[0])
        x = x @ self.turn
        a = x[:, :h] @ self.first.T
        b = x[:, h:] @ self.second.T if x.shape[1] > h else np.zeros((len(x), len(self.second)))
        order = np.argsort(-b, axis=1)
        sorted_b = -np.take_along_axis(b, order, 1)
        m = len(self.second)
        out = []
        for i in range(len(x)):
            words = np.flatnonzero(a[i] - sorted_b[i, 0] >= self.bound)
            ends = np.searchsorted(sorted_b[i], a[i, words] - self.bound, "right")
            out.append(np.sort(np.concatenate([w * m + order[i, :e] for w, e in zip(words, ends)])) if len(words) else words)
        return out


@dataclass(frozen=True)
class Book:
    codes: tuple[Code, ...]

    def listed(self, x: np.ndarray) -> list[np.ndarray]:
        per = [c.listed(x) for c in self.codes]
        step = len(self.codes[0].first) * len(self.codes[0].second)
        return [np.concatenate([f + t * step for t, f in enumerate(rows)]) for rows in zip(*per)]


def book(dim: int, rows: int, o: Options) -> Book:
    """As many filters as make buckets of the asked size among ``rows`` vectors; a code's bound is the matching
    quantile of inner products with random unit vectors."""
    rng = np.random.default_rng(o.seed)
    filters = max(o.listed * 4, rows * o.listed // o.bucket)
    m = max(8, int(np.ceil(np.sqrt(filters))))
    h = (dim + 1) // 2
    probe = rng.standard_normal((4096, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    share = min(1.0, o.listed / (m * m))
    out = []
    for _ in range(o.tables):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        # code words from orthonormal bases spread evenly
        halves = [np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-m // d))])[:m] for d in (h, max(dim - h, 1))]
        x = probe @ turn
        a, b = x[:, :h] @ halves[0].T, (x[:, h:] @ halves[1].T if dim > h else np.zeros((len(x), m)))
        sums = (a[:, rng.integers(0, m, 512)] + b[:, rng.integers(0, m, 512)]).ravel()
        out.append(Code(turn, halves[0], halves[1], float(np.quantile(sums, 1 - share))))
    return Book(tuple(out))


def unit(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the usable ones, and which are: not null, without null or non-finite
    components, not zero, of the dimension asked for."""
    ok = np.zeros(len(vectors), bool)
    rows = []
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0 or dim is not None and len(v) != dim or not isinstance(v, np.ndarray) and any(c is None for c in v):
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            continue
        x = x / top  # so that squares neither overflow nor vanish
        rows.append(x / np.sqrt(x @ x))
        ok[i] = True
    return (np.stack(rows) if rows else np.zeros((0, dim or 1))), ok


def miss_rate(o: Options, dim: int = 64, rows: int = 5000, pairs: int = 4000) -> float:
    """Share of random pairs at exactly the cosine bound that share no filter."""
    c = book(dim, rows, o)
    rng = np.random.default_rng(1)
    u = rng.standard_normal((pairs, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((pairs, dim))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = o.cosine * u + np.sqrt(1 - o.cosine**2) * w
    return float(np.mean([len(np.intersect1d(a, b, assume_unique=True)) == 0 for a, b in zip(c.listed(u), c.listed(v))]))


def link(vectors: DataFrame, o: Options = Options(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Only rows of equal labels that are not null are compared. Rows whose vector is null, empty, zero, holds null or
    non-finite components, or is not as long as most, link with nothing. Equal vectors of one label form a class and
    link with each other; one row of the class is listed and counts as often as the class has rows. Null ids take no
    part; repeated rows of one id and vector each get the row's result. A cosine of exactly the bound links. Other input
    columns are left out, whatever their names; an empty table gives an empty result. A bucket larger than ``block`` is
    compared in pairs of blocks, so no task holds more than two blocks.
    """
    spark = vectors.sparkSession
    st = Stages(spark, "near-vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    dim = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dim[0]["d"] if dim and dim[0]["d"] > 0 else 1
    values = F.transform("v", lambda x: x.cast("double"))
    clean = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(values, lambda x: x != 0)
    real = F.coalesce(clean & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # negative zeros equal zeros
    same = F.transform(values, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    keyed = rows.withColumns({"real": real, "h1": F.xxhash64("label", same), "h2": F.hash(same, "label")})
    classes = keyed.where("real").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = st.save("classes", classes)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    filters = book(dim, most, o)
    reps = keyed.where("real").join(classes, ["label", "h1", "h2"]).where("vec_id = rep").dropDuplicates(["vec_id", "label", "h1", "h2"])

    kind = np.float32 if rows.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ok = unit(b.column("v").to_pylist(), dim)
            assert ok.all()
            f = filters.listed(x)
            flat = [r.astype(np.int32) for r in f]
            yield pa.RecordBatch.from_arrays([
                b.column("label"), b.column("rep"), b.column("copies"), pa.array([np.array(v, kind).tobytes() for v in b.column("v").to_pylist()], pa.binary()),
                pa.array([r.tolist() for r in flat], pa.list_(pa.int32())), pa.array([r.tobytes() for r in flat], pa.binary())], ["label", "rep", "copies", "x", "filters", "all"])

    found = reps.select("label", "rep", "copies", "v").mapInArrow(listed, "label string, rep long, copies long, x binary, filters array<int>, all binary")
    found = st.save("listed", found)
    each = found.select("label", F.explode("filters").alias("filter"))
    blocks = each.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1").select("label", "filter", F.ceil(F.col("n") / o.block).cast("int").alias("blocks"))
    blocks = st.save("blocks", blocks)  # the join then has plain shuffles on both sides
    entry = found.select("label", "rep", "copies", "x", "all", F.explode("filters").alias("filter")).join(blocks, ["label", "filter"])
    entry = entry.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    entry = entry.withColumn("p", pair).select("label", "filter", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "rep", "copies", "x", "all")
    entry = entry.repartition("label", "filter", "i", "j").sortWithinPartitions("label", "filter", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held)
            return bucket(key, rows, o, kind) if rows.num_rows > 1 else None

        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in ("label", "filter", "i", "j")]))
            at = 0
            for k in range(len(keys)):
                if keys[k] != key:
                    if held or k > at:
                        held.append(b.slice(at, k - at))
                        if (out := done()) is not None:
                            yield out
                    key, held, at = keys[k], [], k
            held.append(b.slice(at))
        if held and (out := done()) is not None:
            yield out

    links = st.save("links", entry.mapInArrow(compare, "rep long, n long, b long"))
    degree = links.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(st, links.select(F.col("rep").alias("a"), "b"), "links")
    info = classes.join(degree, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    info = st.finish(info)
    out = keyed.where("real").select("vec_id", "label", "h1", "h2").join(info, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = keyed.where("not real").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def bucket(key: tuple, held: pa.Table, o: Options, kind: type) -> pa.RecordBatch | None:
    """Links of the pairs of one bucket, or of two blocks of it, whose least common filter this is: for each row the
    rows it links (n, copies counted) and one row (b) that stands for its component among them."""
    _, filt, bi, bj = key
    block, rep, copies = (held.column(c).to_numpy() for c in ("block", "rep", "copies"))
    x = np.frombuffer(b"".join(held.column("x").to_pylist()), kind).reshape(len(rep), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    near = x @ x.T >= o.cosine
    np.fill_diagonal(near, False)
    if bi != bj:
        near &= (block[:, None] != block[None, :])
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return None
    near, rep, copies = near[np.ix_(rows, rows)], rep[rows], copies[rows]
    lists = [np.frombuffer(v, np.int32) for v in held.column("all").take(pa.array(rows)).to_pylist()]
    lower = [v[v < filt] for v in lists]
    names, at = np.unique(np.concatenate(lower), return_inverse=True)
    first = near
    if len(names):
        has = np.zeros((len(rows), len(names)), np.float32)
        has[np.repeat(np.arange(len(rows)), [len(v) for v in lower]), at] = 1
        first = near & ~(has @ has.T > 0)
    n = first @ copies
    label = rep.copy()
    while True:  # least reachable row
        low = np.minimum(label, np.where(first, label[None, :], np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            break
        label = low
    go = n > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[go]), pa.array(n[go]), pa.array(label[go])], ["rep", "n", "b"]) if go.any() else None


def query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, k.c AS component_id, k.c = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) k ON k.vec_id = v.vec_id
"""
