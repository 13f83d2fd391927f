"""How five filters interact, by the multilinear extension of what they remove.

Each document has a mask of the filters that it fails. If filter i is applied with probability x_i, the expected number
of removed documents is a polynomial in the x: the sum over masks m of n_m * (1 - product over i in m of (1 - x_i)).
Its coefficient at the product over a set S is (-1)^(|S| + 1) times the number of documents that fail all of S. At the
corner of a set T of filters it is what T removes; so survivors, removals in any order, and lost documents of a kind
are differences of corners. A filter's Shapley value is the integral of its partial derivative along the diagonal: the
term of S gives its coefficient over |S|, an exact rational, which 120 makes whole.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
SETS = 1 << len(FILTERS)
#: Kinds of documents that are counted: all, good ones, toxic ones.
KINDS = ("n", "good", "toxic")


def masks(docs: DataFrame, labels: DataFrame, st: Stages, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just the filters of a mask (bit 0: A).

    Texts are read once; what is shuffled after that is a row of an id, a digest, a part and four flags. Equal texts are
    those of equal SHA-256 digest (a null is an empty text). A row fails E if an equal text has a smaller id; null ids
    have none before or after them. Rows that repeat count each. A document is good or toxic if any of its label rows
    says so. Groups of copies are summed by (text, part) before they meet, so a text that a third of all rows have is at
    most one row for each part.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    fails = [
        F.size("w") < 50,
        100 * F.size(F.array_distinct("w")) < 65 * F.size("w"),
        100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 5 * F.length("t"),
        F.col("t").rlike(r"[#$%&*|]"),
    ]
    bits = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", GAP), ""))
    each = rows.select("id", "part", F.sha2("t", 256).alias("text"), bits.alias("m")).groupBy("id", "text", "part").agg(F.first("m").alias("m"), F.count("*").alias("n"))
    each = st.save("each", each)
    said = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null and (quality = 1 or toxic = 1)")
    said = said.groupBy("id").agg(F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("is_good"), F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("is_toxic"))
    each = each.join(said, "id", "left").select("id", "text", "part", "m", "n", *[(F.col("n") * F.coalesce(f"is_{k}", F.lit(0))).alias(k) for k in KINDS[1:]])
    # the row of the least id, and the sums of those with an id and of those without
    known = F.col("id").isNotNull()
    groups = each.groupBy("text", "part").agg(
        F.first("m").alias("m"), F.min(F.when(known, F.struct("id", *KINDS))).alias("low"),
        *[F.sum(F.when(known, F.col(k)).otherwise(0)).alias(k) for k in KINDS], *[F.sum(F.when(known, 0).otherwise(F.col(k))).alias(f"bare_{k}") for k in KINDS],
    )
    first = F.min("low.id").over(Window.partitionBy("text"))
    groups = groups.withColumn("kept", F.coalesce(F.col("low.id") == first, F.lit(False)))
    own = [(F.when(F.col("kept"), F.col(f"low.{k}")).otherwise(0)).alias(f"own_{k}") for k in KINDS]
    groups = groups.select("part", "m", *KINDS, *[f"bare_{k}" for k in KINDS], *own)
    e = 1 << FILTERS.index("E")
    both = F.explode(F.array(
        F.struct(F.col("m").alias("mask"), *[(F.col(f"bare_{k}") + F.col(f"own_{k}")).alias(k) for k in KINDS]),
        F.struct((F.col("m") + e).alias("mask"), *[(F.col(k) - F.col(f"own_{k}")).alias(k) for k in KINDS]),
    ))
    return groups.select("part", both.alias("x")).select("part", "x.*").groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in KINDS])


_IN = np.array([[s & t == s for s in range(SETS)] for t in range(SETS)])  # [t, s]: s lies in t
_SIZE = np.array([bin(s).count("1") for s in range(SETS)])
_BIT = 1 << np.arange(len(FILTERS))
#: (order, step, filter, filters before it) of all orders.
STEPS = [("".join(p), k + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]
_ORDER, _STEP = [o for o, *_ in STEPS], np.array([k for _, k, _, _ in STEPS], np.int32)
_I, _BEFORE = np.array([i for *_, i, _ in STEPS]), np.array([b for *_, b in STEPS])


def coefficients(counts: np.ndarray) -> np.ndarray:
    """The removal polynomial's coefficient of each set, from the number of documents of each mask."""
    failing = counts @ _IN  # of each set: documents that fail all of it
    return np.where(_SIZE > 0, (-1) ** (_SIZE + 1), 0) * failing


def shapley(poly: np.ndarray) -> list[Fraction]:
    """Each filter's integral of its partial derivative from (0, ..., 0) to (1, ..., 1)."""
    return [sum((Fraction(int(c), int(k)) for c, k in zip(poly[of], _SIZE[of])), Fraction(0)) for of in (np.flatnonzero(np.arange(SETS) & b) for b in _BIT)]


def orders(t: pa.Table) -> pa.Table:
    """The rows of one part, from its masks."""
    corner, poly = {}, {}
    for k in KINDS:
        counts = np.zeros(SETS, np.int64)
        counts[t["mask"].to_numpy()] = t[k].to_numpy()
        poly[k] = coefficients(counts)
        corner[k] = _IN @ poly[k]
        if k == KINDS[0]:
            total = counts.sum()
    n, after = corner["n"], _BEFORE | _BIT[_I]
    gone = {k: corner[k][after] - corner[k][_BEFORE] for k in KINDS}
    value = [factorial(len(FILTERS)) * v for v in shapley(poly["n"])]
    assert all(v.denominator == 1 for v in value)
    return pa.table({
        "part": pa.array([t["part"][0].as_py()] * len(STEPS), pa.string()), "filter_order": _ORDER, "step": _STEP, "kept": total - n[after], "removed": gone["n"], "redundant": poly["n"][_BIT][_I] - gone["n"],
        "unique_fails": (n[-1] - n[SETS - 1 - _BIT])[_I], "good_lost": gone["good"], "toxic_lost": gone["toxic"], "shapley": np.array([v.numerator for v in value])[_I],
    })


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each
    part and order of filters, from ``masks``; zeros included. A part has at most 32 masks and gets 600 rows; no rows
    give none."""
    numbers = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInArrow(orders, f"part string, filter_order string, step int, {numbers}")


def query(spark, sf_dir: str) -> DataFrame:
    st = Stages(spark, "filter-audit")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(st.finish(masks(docs, labels, st), "masks"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
lows AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
f AS (SELECT w.doc_id, w.part, len(w.w) < 50 AS A, 100 * len(list_distinct(w.w)) < 65 * len(w.w) AS B, 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) AS C,
  regexp_matches(w.t, '[#$%&*|]') AS D, coalesce(w.doc_id > l.lo, false) AS E FROM w JOIN lows l ON l.t = w.t),
g AS (SELECT f.*, exists(SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AS good, exists(SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) AS toxic FROM f),
m AS (SELECT part, concat(if(A, 'A', ''), if(B, 'B', ''), if(C, 'C', ''), if(D, 'D', ''), if(E, 'E', '')) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM g GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT m.part, s.filter_order, s.step, s.x,
  coalesce(sum(n) FILTER (NOT contains(fails, s.x) AND translate(fails, s.earlier, '') = fails), 0) AS kept,
  coalesce(sum(n) FILTER (contains(fails, s.x) AND translate(fails, s.earlier, '') = fails), 0) AS removed,
  coalesce(sum(n) FILTER (contains(fails, s.x) AND translate(fails, s.earlier, '') <> fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = s.x), 0) AS unique_fails,
  coalesce(sum(good) FILTER (contains(fails, s.x) AND translate(fails, s.earlier, '') = fails), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (contains(fails, s.x) AND translate(fails, s.earlier, '') = fails), 0) AS toxic_lost
  FROM m, s GROUP BY m.part, s.filter_order, s.step, s.x)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
