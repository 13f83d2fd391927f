"""Sharding: documents in Hilbert-curve order of several metadata dimensions, cut into runs of near equal bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages


def hilbert_table(dims: int, bits: int) -> np.ndarray:
    """Curve index of every cell; a cell's number holds its coordinates, the first in the highest bits.

    The inverse of the usual undoing of excess work, then a Gray code of the transposed bits.
    """
    cells = np.arange(1 << (dims * bits), dtype=np.int64)
    x = [(cells >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(dims):
            on = (x[d] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[d] = x[d] ^ t if d else x[d]
        q >>= 1
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    t = np.zeros_like(cells)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(cells)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ t) >> b) & 1)
    return out


def leading(c: Column) -> Column:
    """The first six bytes of a text as a number: keeps the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.coalesce(c, F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


#: A group of equal texts over this part of a shard finds its shard by itself, the others go with the curve.
LARGE = 64


def spread(groups: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """A shard for each (start, bytes) of the large groups: the one nearest to where the curve has it among those that
    still have room for it, the emptiest if none has. Largest first."""
    load, out = [0.0] * shards, [0] * len(groups)
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k][1], groups[k])):
        start, size = groups[k]
        near = min(start * shards // max(total, 1), shards - 1)
        room = [s for s in range(shards) if load[s] + size <= total / shards]
        s = min(room, key=lambda s: (abs(s - near), s)) if room else min(range(shards), key=lambda s: (load[s], s))
        load[s] += size
        out[k] = s
    return out


def shard(docs: DataFrame, shards: int = 16, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard, curve.

    ``dims``: metadata as numbers, each quantised to 2 ** ``bits`` levels at its approximate quantiles; the first
    letters of lang and source and the size, if not given. Equal texts take their group's smallest values, so they
    stand side by side on the curve, and no cut falls inside a group: large groups get a shard each, the nearest on
    the curve that has room, and the rest of the curve is cut where each shard is full. Only a group that is larger
    than a whole shard is cut, since sizes could not be near equal otherwise.

    Null texts count as empty, null metadata as the lowest level; null ids come first within their text; repeated rows
    get slots of their own; an empty table gives an empty result. No text is shuffled, and no task gathers a group:
    rows are dealt by range of (curve, text hash, id). To the driver come one row for each range and shard, and one
    for each large group, of which there are at most ``LARGE`` a shard.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dims or {k: (leading(F.col(k)) if k in docs.columns else F.lit(0.0)) for k in ("lang", "source")}
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"), *[F.coalesce(c, F.lit(0.0)).alias(f"d{i}") for i, c in enumerate(dims.values())])
    rows = rows.withColumn(f"d{len(dims)}", F.log2("size"))
    n = len(dims) + 1
    names = [f"d{i}" for i in range(n)]
    group = ["h", "text_crc32", "size"]
    lows = rows.groupBy(*group).agg(*[F.min(d).alias(d) for d in names], F.sum("size").alias("group_bytes"))
    # written first: the join below then has plain shuffles on both sides, and a hot group's rows can be split
    lows = stages.save("groups", lows)
    levels = 1 << bits
    cuts = lows.agg(*[F.percentile_approx(d, [k / levels for k in range(1, levels)], 2000).alias(d) for d in names], F.sum("group_bytes").alias("total")).first()
    total = cuts["total"] or 0
    cell = F.lit(0)
    for d in names:
        bounds = sorted(set(cuts[d] or []))
        level = sum((F.when(F.col(d) > b, 1).otherwise(0) for b in bounds), F.lit(0))
        cell = cell * levels + level
    table = F.lit(hilbert_table(n, bits).tolist())
    several = F.col("group_bytes") > F.col("size")
    lows = lows.select(*group, several.alias("several"), (several & (F.col("group_bytes") * (LARGE * shards) > total) & (F.col("group_bytes") * shards <= total)).alias("large"),
                       (F.col("group_bytes") * shards > total).alias("over"), "group_bytes", F.element_at(table, (cell + 1).cast("int")).cast("long").alias("curve"))
    placed = rows.select("doc_id", *group).join(lows, group)
    order = ["curve", *group, "doc_id"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stages.save("sorted", placed.repartitionByRange(ranges, *order).withColumn("pid", F.spark_partition_id()))
    free = F.when(~F.col("large"), F.col("size")).otherwise(0)
    sums = placed.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.sum(free).alias("f"), F.count_if(~F.col("large")).alias("k")).orderBy("pid").collect()
    if not sums:
        return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    starts, at = [], (0, 0, 0, 0)
    for r in sums:
        starts.append((r["pid"], *at))
        at = at[0] + r["b"], at[1] + r["n"], at[2] + r["f"], at[3] + r["k"]
    offsets = F.broadcast(spark.createDataFrame(starts, "pid int, b0 long, n0 long, f0 long, k0 long"))  # one row for each range
    w = Window.partitionBy("pid").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(offsets, "pid").select(
        *order, "several", "large", "over", (F.col("b0") + F.sum("size").over(upto) - F.col("size")).alias("before"), (F.col("f0") + F.sum(free).over(upto) - free).alias("free"),
        (F.col("n0") + F.row_number().over(w) - 1).alias("nth"), (F.col("k0") + F.count_if(~F.col("large")).over(upto) - 1).alias("kth"))
    placed = stages.save("placed", placed)
    # at most LARGE rows a shard: each has more than 1 / LARGE of a shard's bytes
    large = placed.where("large").groupBy(*group).agg(F.min("before").alias("start"), F.min("nth").alias("first"), F.count("*").alias("rows")).orderBy("start").collect()
    homes = spread([(r["start"], r["rows"] * r["size"]) for r in large], total, shards)
    ends, full = [], 0.0
    for s in range(shards - 1):
        full += max(total / shards - sum(r["rows"] * r["size"] for r, home in zip(large, homes) if home == s), 0.0)
        ends.append(full)
    # a group that is not cut goes where its first row goes
    firsts = placed.where("several and not large and not over").groupBy(*group).agg(F.min("free").alias("from"))
    rest = placed.where("not large").join(firsts, group, "left")
    number = sum((F.when(F.coalesce("from", "free") >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    rest = stages.save("rest", rest.select("doc_id", *group, "curve", "kth", number.alias("shard")))
    # large groups come after the rest of their shard; inside either, the order is that of the curve
    held = {r["shard"]: (r["first"], r["n"]) for r in rest.groupBy("shard").agg(F.min("kth").alias("first"), F.count("*").alias("n")).collect()}
    slot = F.col("kth") - F.element_at(F.create_map(*[F.lit(x) for s, (first, _) in held.items() for x in (s, first)]), F.col("shard")) if held else F.lit(0)
    base = {s: held[s][1] if s in held else 0 for s in range(shards)}
    homed = []
    for r, s in zip(large, homes):
        homed.append((r["h"], r["text_crc32"], r["size"], s, base[s] - r["first"]))
        base[s] += r["rows"]
    home = F.broadcast(spark.createDataFrame(homed, "h long, text_crc32 long, size long, shard int, base long"))  # one row for each large group
    tail = placed.where("large").join(home, group).select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("nth") + F.col("base")).alias("slot"))
    out = rest.select("doc_id", "size", "text_crc32", "curve", "shard", slot.cast("long").alias("slot")).unionByName(tail)
    return stages.finish(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def write(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """The documents as one sorted folder for each shard, so that readers skip files by lang, source and size."""
    placed = shard(docs, shards, **options).select("doc_id", "shard", "slot")
    (docs.join(placed, "doc_id").repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
