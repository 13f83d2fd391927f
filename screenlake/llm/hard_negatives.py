"""Hard negatives by a two-dimensional block matrix multiply over whole numbers.

The score matrix of anchors and rows is cut into shards of anchors and shards of rows. Each cell (anchor shard, row
shard) gets one block of either side and multiplies them tile by tile; a tile never leaves its task. Of the scores only
the best few of each anchor, or of each anchor and positive, go on, and these are reduced over the cells. A few anchor
shards go at a time, so what is shuffled at once grows with the rows, not with anchors times rows. The first product, of
equal labels only, finds the positives; the second finds the negatives inside each positive's window of scores.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages


@dataclass(frozen=True)
class Options:
    """``anchors`` x ``rows``: about how many of each a shard, and so a cell, holds; ``dims``: dimensions multiplied at
    a time; ``stripe``: anchor shards of each group that are multiplied before their blocks are deleted.
    Negatives score ``low`` to ``high`` hundredths of the positive."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    anchors: int = 4096
    rows: int = 32768
    dims: int = 128
    stripe: int = 4


#: What a block says of its rows; ``h`` tells rows of one id apart. Positives' scores come behind where there are some.
META = ["id", "h", "label"]


def quantised(vectors: DataFrame, o: Options, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, q, h): rows that take part, each once."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(clean)
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * o.scale)).alias("q"))
    return rows.dropDuplicates(["id", "label", "q"]).withColumn("h", F.xxhash64("q"))


def packed(rows: DataFrame, shards: Column, dim: int, o: Options, more: list[str]) -> DataFrame:
    """(grp, shard, meta, x): rows in blocks, each block in one row, ordered by id; ``x`` in the narrowest whole numbers
    that hold the block."""
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id", "h"), shards).cast("int")).select("grp", "shard", *META, *more, F.col("q").alias("x"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("h", "ascending"), ("label", "ascending")]).combine_chunks()
        width = np.array(pa.compute.list_value_length(t["x"]).combine_chunks())
        x = np.zeros((len(width), dim), np.int64)
        x[np.arange(dim) < width[:, None]] = np.array(pa.compute.list_flatten(t["x"]).combine_chunks())
        for kind in (np.int16, np.int32):
            if np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
                x = x.astype(kind)
                break
        meta = np.stack([np.array(t[c].combine_chunks()) for c in META] + [np.array(pa.compute.list_element(t[c], i).combine_chunks()) for c in more for i in range(o.positives)])
        first = t.slice(0, 1)
        return pa.table({"grp": first["grp"], "shard": first["shard"], "meta": pa.array([meta.astype(np.int64).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    return placed.groupBy("grp", "shard").applyInArrow(pack, "grp long, shard int, meta binary, x binary")


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in floats if every sum of their products stays exact in them (no part of one exceeds the product of the
    rows' norms), else in int64."""
    norm = lambda x: np.sqrt(np.square(x.astype(np.float64)).sum(1).max(initial=0))
    most = norm(a) * norm(b) * 1.001
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


def best(row: np.ndarray, score: np.ndarray, col: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each row, ties by column; what is asked comes in the order of rows."""
    order = np.lexsort((col, -score, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return order[rank < most]


def strongest(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], o: Options) -> tuple[np.ndarray, ...]:
    """(window, row, col, score): of each row of ``a`` and each of its windows (``low`` to ``high``: windows x rows), the
    ``most`` highest scores with rows of ``b`` that ``fits``, ties by column.

    Columns are taken in turn; once a window has ``most``, only higher scores are looked at, since ties go to earlier
    columns.
    """
    x, y = exact(a, b)
    whole, out = np.iinfo(np.int64), []
    for f in range(0, len(x), 256):
        part = x[f : f + 256]
        least, top = np.where(low > high, whole.max, low)[:, f : f + 256], high[:, f : f + 256]
        ceiling = top.max(0).astype(x.dtype)[:, None]
        held = [(np.zeros(0, np.int64),) * 3 for _ in least]
        at, step = 0, 512
        while at < len(y):
            scores = part[:, : o.dims] @ y[at : at + step, : o.dims].T
            for k in range(o.dims, x.shape[1], o.dims):
                scores += part[:, k : k + o.dims] @ y[at : at + step, k : k + o.dims].T
            row, col = np.nonzero((scores >= least.min(0).astype(x.dtype)[:, None]) & (scores <= ceiling))
            s, col = scores[row, col].astype(np.int64), col + at
            ok = fits(row + f, col)
            row, col, s = row[ok], col[ok], s[ok]
            for t in range(len(least)):
                go = (s >= least[t][row]) & (s <= top[t][row])
                if not go.any():
                    continue
                r, c, v = (np.concatenate(z) for z in zip(held[t], (row[go], col[go], s[go])))
                keep = best(r, v, c, most)
                r, c, v = held[t] = r[keep], c[keep], v[keep]
                n = np.bincount(r, minlength=len(part))
                full = np.flatnonzero(n == most)
                least[t][full] = np.minimum(v[np.cumsum(n)[full] - 1], whole.max - 1) + 1
            at, step = at + step, 4096
        out += [(np.full(len(r), t), r + f, c, v) for t, (r, c, v) in enumerate(held)]
    return tuple(np.concatenate(z) for z in zip(*out))


def tiles(st: Stages, name: str, anchors: DataFrame, rows: DataFrame, dim: int, o: Options, reduce: Callable[..., pa.Table], schema: str, rank: Callable[[DataFrame], DataFrame], more: list[str] = ()) -> DataFrame:
    """``rank`` of what ``reduce`` (anchors' meta and vectors, rows' meta and vectors) leaves of each cell of anchors and
    rows with equal ``grp``. Shards are counted for each group, so a group of any size is many cells; a cell gets two
    blocks. All cells of an anchor are in one stripe, so ``rank`` sees them together."""
    more = list(more)
    count = lambda df, size, to: df.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("int").alias(to))
    sizes = st.save(f"{name}-sizes", count(anchors, o.anchors, "n_a").join(count(rows, o.rows, "n_b"), "grp"))
    left = st.save(f"{name}-left", packed(anchors.join(sizes, "grp"), F.col("n_a"), dim, o, more))
    right = st.save(f"{name}-right", packed(rows.join(sizes, "grp"), F.col("n_b"), dim, o, []))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                blocks = []
                for side, n in (("a", len(META) + len(more) * o.positives), ("b", len(META))):
                    meta = np.frombuffer(batch.column(f"{side}_meta")[r].as_buffer(), np.int64).reshape(n, -1)
                    raw = batch.column(side)[r].as_buffer()
                    blocks += [meta, np.frombuffer(raw, f"<i{raw.size // (meta.shape[1] * dim)}").reshape(-1, dim)]
                yield from reduce(*blocks).to_batches()

    stripes = []
    for first in range(0, sizes.agg(F.max("n_a")).first()[0] or 1, o.stripe):
        end = first + o.stripe
        here = sizes.where(F.col("n_a") > first)
        a = left.where(F.col("shard").between(first, end - 1)).join(here, "grp").select("grp", F.col("shard").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("j"), F.col("meta").alias("a_meta"), F.col("x").alias("a"))
        b = right.join(here, "grp").select("grp", F.explode(F.sequence(F.lit(first), F.least(F.col("n_a"), F.lit(end)) - 1)).alias("i"), F.col("shard").alias("j"), F.col("meta").alias("b_meta"), F.col("x").alias("b"))
        cells = a.join(b.hint("merge"), ["grp", "i", "j"])
        stripes.append(st.save(f"{name}-{first}", rank(cells.mapInArrow(product, schema))))
    st.drop(f"{name}-sizes", f"{name}-left", f"{name}-right")
    return functools.reduce(DataFrame.union, stripes)


def mine(vectors: DataFrame, o: Options = Options(), id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, is_anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label``, ``is_anchor``: expressions over the input (column ``label`` and ids divisible by 50 by default). Rows with
    a null id, label or vector, or with a null or non-finite component, take no part. Rows alike in id, label and whole
    numbers count once; other rows of one id are rows of their own, and ties between them go by a hash of the vector.
    Vectors of unequal length score as if the shorter one ended in zeros; an empty vector scores 0. Scores that leave 64
    bits wrap. An anchor without positives, or a positive without rows in its window, gives no row; so does an
    empty table. Other input columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    st = Stages(spark, "hard-negatives")
    flag = F.col(f"`{id_col}`") % 50 == 0 if is_anchor is None else is_anchor
    rows = quantised(vectors, o, id_col, vector_col, F.col("label") if label is None else label)
    keys = vectors.where(flag).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    rows = st.save("rows", rows.join(keys.withColumn("anchor", F.lit(True)), "id", "left"))
    dim = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 0)
    anchors = rows.where("anchor")

    def positives(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> pa.Table:
        whole = np.iinfo(np.int64)
        every = np.full((1, len(x)), whole.min), np.full((1, len(x)), whole.max)
        _, row, col, s = strongest(x, y, *every, o.positives, lambda r, c: (a[0][r] != b[0][c]) | (a[1][r] != b[1][c]), o)
        return pa.table({"id": a[0][row], "h": a[1][row], "label": a[2][row], "positive_id": b[0][col], "ph": b[1][col], "positive_score": s})

    by_label = lambda df: df.withColumn("grp", F.col("label"))
    turn = Window.partitionBy(*META).orderBy(F.desc("positive_score"), "positive_id", "ph")
    first = lambda df: df.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= o.positives)
    found = tiles(st, "positives", by_label(anchors), by_label(rows), dim, o, positives, "id long, h long, label long, positive_id long, ph long, positive_score long", first)
    windows = found.groupBy(*META).agg(F.map_from_entries(F.collect_list(F.struct("turn", "positive_score"))).alias("scores"))
    # a missing positive asks for a score of -1: its window is empty
    scores = F.transform(F.sequence(F.lit(1), F.lit(o.positives)), lambda t: F.coalesce(F.col("scores")[t], F.lit(-1).cast("long")))
    asking = anchors.join(windows.select(*META, scores.alias("asked")), META).withColumn("grp", F.lit(0).cast("long"))

    def negatives(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> pa.Table:
        asked = a[len(META) :]
        low, high = -(-o.low * asked // 100), o.high * asked // 100
        low, high = np.where(asked < 0, 1, low), np.where(asked < 0, 0, high)
        t, row, col, s = strongest(x, y, low, high, o.negatives, lambda r, c: a[2][r] != b[2][c], o)
        return pa.table({"id": a[0][row], "h": a[1][row], "label": a[2][row], "turn": pa.array(t + 1, pa.int32()), "negative_id": b[0][col], "nh": b[1][col], "nl": b[2][col], "negative_score": s})

    place = Window.partitionBy(*META, "turn").orderBy(F.desc("negative_score"), "negative_id", "nh", "nl")
    nearest = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= o.negatives)
    near = tiles(st, "negatives", asking, rows.withColumn("grp", F.lit(0).cast("long")), dim, o, negatives, "id long, h long, label long, turn int, negative_id long, nh long, nl long, negative_score long", nearest, ["asked"])
    out = near.join(found, [*META, "turn"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return st.finish(out)


def query(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
