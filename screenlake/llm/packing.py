"""Best-fit packing into bins of several permitted lengths.

Items of one length are alike, so the plan works on the histogram of lengths, which has at most the largest
capacity's number of rows. Lengths are taken in falling order; each item goes to the open bin with the least room
that still holds it, else a new bin is opened at the permitted length of least expected cost. When all items are
placed every bin is cut down to the least permitted length that holds its contents. Runs of alike bins are planned
at once, and items find their places by their number within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages, texts_of


@dataclass(frozen=True)
class Options:
    """``overhead``: what a bin costs besides its length, in tokens: the more, the larger the bins that pay off."""

    lengths: tuple[int, ...] = (1024, 2048, 4096, 8192)
    overhead: int = 64


@dataclass
class Run:
    """``count`` alike bins: opened length, room left, and contents as (length, items in each bin)."""

    length: int
    room: int
    count: int
    items: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], o: Options) -> list[Run]:
    """Best-fit decreasing over lengths with counts, all permitted lengths open to every new bin."""
    rooms: list[int] = []  # rooms that open bins have, in rising order
    at: dict[int, list[Run]] = {}
    done: list[Run] = []

    def put(r: Run) -> None:
        if not r.room:
            done.append(r)
            return
        if r.room not in at or not at[r.room]:
            if r.room not in at:
                at[r.room] = []
            insort(rooms, r.room)
        at[r.room].append(r)

    def take(k: int) -> Run:
        room = rooms[k]
        r = at[room].pop()
        if not at[room]:
            rooms.pop(k)
        return r

    rest = sum(n * c for n, c in histogram.items())
    smaller = sorted(histogram)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                r = take(k)
            else:
                size = opening(length, left, rest, smaller, o)
                r = Run(size, size, max(1, left // max(1, size // length)), ())
            fit = r.room // length
            full = min(r.count, left // fit)
            if full:
                put(Run(r.length, r.room - fit * length, full, (*r.items, (length, fit))))
            left -= full * fit
            if r.count > full:
                if left and left < fit:
                    put(Run(r.length, r.room - left * length, 1, (*r.items, (length, left))))
                    full += 1
                    left = 0
                if r.count > full and r.items:
                    put(Run(r.length, r.room, r.count - full, r.items))
        rest -= length * histogram[length]
    for room in rooms:
        done.extend(at[room])
    return done


def opening(length: int, left: int, rest: int, smaller: list[int], o: Options) -> int:
    """The permitted length with the least cost for each token it will hold: what alike items leave free is filled by
    shorter ones as far as these go (the least length that is there bounds the waste)."""
    least = smaller[0] if smaller[0] < length else length
    best = None
    for size in o.lengths:
        if size < length:
            continue
        fit = min(left, size // length)
        room = size - fit * length
        others = rest - left * length
        held = fit * length + min(max(others, 0), room - room % least if room >= least else 0)
        ends = min((c for c in o.lengths if c >= held), default=size)  # a bin that stays short is cut down
        cost = (ends + o.overhead) / held
        if best is None or cost < best[0] - 1e-12:
            best = cost, size
    return best[1]


def pack(items: DataFrame, o: Options = Options(), length_col: str = "n_tokens", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (key..., chunk, start, length, bin, bin_length, place): where each piece of each item goes.

    Items longer than the largest capacity are cut into full bins and a rest. Null lengths and lengths of 0 or less
    have nothing to place: one row with a null bin. Repeated rows are items of their own. Columns other than the key are
    left out, whatever their names; an empty table gives an empty result. Equal lengths are numbered
    by range partitions of (length, hash of the key), so a length that a third of all items share is spread over
    tasks. To the driver come the histogram, at most one row for each length up to the largest capacity, and one
    row for each partition and length that it holds.
    """
    spark, top = items.sparkSession, max(o.lengths)
    st = Stages(spark, "packing")
    n = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    chunks = items.select(*key, n.alias("__n"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / top).cast("int") - 1, F.lit(0))), lambda k: F.struct(k.alias("chunk"), (k.cast("long") * top).alias("start")))
    chunks = chunks.withColumn("c", F.explode(cut)).select(*key, F.col("c.chunk").alias("chunk"), F.col("c.start").alias("start"), F.least(F.col("__n") - F.col("c.start"), F.lit(top)).cast("int").alias("length"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", F.xxhash64(*key, "chunk")]
    chunks = chunks.repartitionByRange(ranges, *order).withColumn("pid", F.spark_partition_id())
    chunks = st.save("chunks", chunks)
    counts = chunks.groupBy("length", "pid").agg(F.count("*").alias("n")).orderBy("length", "pid").collect()
    histogram: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for r in counts:
        before.append((r["length"], r["pid"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    histogram.pop(0, None)
    tables = places(plan(histogram, o), o)

    nth = F.row_number().over(Window.partitionBy("pid", "length").orderBy(F.xxhash64(*key, "chunk"), *key, "chunk")) - 1
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0, 0)], "length int, pid int, first long"))  # rows: lengths plus partitions
    numbered = chunks.join(offsets, ["length", "pid"]).withColumn("nth", nth + F.col("first")).select(*key, "chunk", "start", "length", "nth")

    names = numbered.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = b.column("length").to_numpy(zero_copy_only=False), b.column("nth").to_numpy(zero_copy_only=False)
            bins, size, pos = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                if x <= 0:
                    continue
                first, bin0, each, offset, final = tables[int(x)]
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(first, nth[rows], "right") - 1
                inside = nth[rows] - first[k]
                bins[rows] = bin0[k] + inside // each[k]
                size[rows] = final[k]
                pos[rows] = offset[k] + (inside % each[k]) * x
            none = bins < 0
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins, mask=none), pa.array(size.astype(np.int32), mask=none), pa.array(pos.astype(np.int32), mask=none)], [*names[:-1], "bin", "bin_length", "place"])

    fields = ", ".join(f"`{c}` {numbered.schema[c].dataType.simpleString()}" for c in names[:-1])
    return numbered.mapInArrow(place, f"{fields}, bin long, bin_length int, place int")


def places(runs: list[Run], o: Options) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays over its runs: number of the first item, first bin, items in each bin, offset, final length."""
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    bin0 = 0
    for r in runs:
        used = r.length - r.room
        final = min(c for c in o.lengths if c >= used)
        offset = 0
        for length, each in r.items:
            rows.setdefault(length, []).append((seen.get(length, 0), bin0, each, offset, final))
            seen[length] = seen.get(length, 0) + each * r.count
            offset += length * each
        bin0 += r.count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


def tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words of the text, plus an end mark; 0 without words) in place of the text."""
    docs = docs.drop("n_tokens")
    keep = [c for c in docs.columns if c != text_col]
    docs = docs.select(*keep, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(t.split()) for t in texts_of(b.column(len(keep)))], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n + (n > 0))], [*keep, "n_tokens"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.mapInArrow(count, f"{fields}n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the pieces of every document, by doc_id; the other columns of ``docs`` end here. Null and empty
    texts get one row without a bin, repeated rows and ties places of their own; a text longer than the largest bin is
    cut into full bins and a rest; an empty table gives an empty one."""
    return pack(tokens(docs.select("doc_id", "text")))
