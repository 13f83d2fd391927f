"""Suffix-array dedup of byte passages.

A string of ``width`` bytes is fingered by its anchor: the k bytes of least hash inside it. Equal strings have equal
anchors at equal places, so strings are dealt by anchor, and only anchors that occur twice or more matter. Stretches
around such anchors meet in tasks, one for each content with the number of its occurrences. Each task builds the
suffix array of its stretches by two-stage sorting: suffixes smaller than their successors are sorted directly, the
rest is induced from them bucket by bucket. A run of suffixes whose adjacent common prefixes reach ``width`` is one
string, and it is repeated if the run's stretches occur twice or more together. Stretches of an anchor that has more
of them than ``group`` are cut into parts that share more bytes than the anchor (``parted``) before the same sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages, aside, mix, slices


@dataclass(frozen=True)
class Options:
    """``piece``: bytes of text that are searched for anchors at a time; ``batch``: bytes of stretches sorted at a
    time, more only for a single group; ``group``: different stretches of one anchor that go to the sort uncut."""

    width: int = 200
    k: int = 64
    piece: int = 1 << 19
    batch: int = 1 << 20
    group: int = 512

    @property
    def span(self) -> int:
        """Places that an anchor can have inside a string."""
        return self.width - self.k + 1


def anchors(texts: list[bytes], o: Options) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor's place, first and last start of a string with this anchor, hash of the anchor's bytes,
    hash of the stretch), for each stretch of strings that share an anchor. Long texts come in overlapping pieces."""
    todo = []
    for i, t in enumerate(texts):
        for s in range(0, max(len(t) - o.width + 1, 0), o.piece):
            todo.append((i, s, min(len(t), s + o.piece + o.width - 1)))
    for a, b in slices(np.array([e - s for _, s, e in todo], np.int64), o.piece):
        part = todo[a:b]
        raw = b"".join(texts[i][s:e] for i, s, e in part) + bytes(o.k)
        buf = np.frombuffer(raw, np.uint8)
        n = len(buf) - o.k
        # 8 bytes at every place, doubled up to k
        h = mix(np.ndarray((n + o.k - 7,), "<u8", raw, 0, (1,)).copy())
        size, c = 8, 0xC2B2AE3D27D4EB4F
        while size < o.k:
            h = h[:-size] * np.uint64(c) + (h[size:] ^ (h[size:] >> np.uint64(29)))
            size, c = 2 * size, (c * 0x9E3779B97F4A7C15) % 2**64 | 1
        h = mix(h)[:n]
        ranked = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        low, have = ranked, 1
        while have * 2 <= o.span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < o.span:
            low = np.minimum(low[: len(low) - (o.span - have)], low[o.span - have :])
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        ends = np.cumsum([e - s for _, s, e in part])
        begins = ends - [e - s for _, s, e in part]
        fits = np.zeros(n + 1, np.int64)
        np.add.at(fits, begins, 1)
        np.add.at(fits, ends - o.width + 1, -1)
        ok = np.cumsum(fits)[: len(place)] > 0
        starts = np.flatnonzero(ok)
        if not len(starts):
            continue
        p = place[starts]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(starts) != 1), [True])))
        first, last, at = starts[new[:-1]], starts[new[1:] - 1], p[new[:-1]]
        which = np.searchsorted(ends, first, "right")
        view = memoryview(raw)
        w = o.width
        whole = np.array([xxhash.xxh3_64_intdigest(view[f : l + w], seed=d) for f, l, d in zip(first.tolist(), last.tolist(), (at - first).tolist())], np.uint64)
        shift = np.array([s for _, s, _ in part], np.int64)[which] - begins[which]
        number = np.array([i for i, _, _ in part], np.int64)[which]
        yield number, at + shift, first + shift, last + shift, h[at].view(np.int64), whole.view(np.int64)


# --- two-stage suffix sorting --------------------------------------------------------------------------------------


def by_prefix(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes from each place; only ties of 8 bytes are looked at further."""
    eight = np.ndarray((len(buf) + depth,), ">u8", np.concatenate((buf, np.zeros(depth + 8, np.uint8))), 0, (1,))
    key = eight[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    tie = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))  # number of the run of equals
    live = np.arange(len(at))
    for off in range(8, depth, 8):
        run = tie[live]
        same = np.concatenate(([False], run[1:] == run[:-1], [False]))
        live = live[same[1:] | same[:-1]]
        if not len(live):
            break
        key, run = eight[at[live] + off].astype(np.uint64), tie[live]
        order = np.lexsort((key, run))
        at[live], key = at[live][order], key[order]
        part = np.concatenate(([True], (run[1:] != run[:-1]) | (key[1:] != key[:-1])))
        tie[live] = live[np.maximum.accumulate(np.where(part, np.arange(len(live)), 0))] + len(tie) * (off + 1)
    return at


def smaller(buf: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor; the last one counts as such."""
    n = len(buf)
    up = np.ones(n, bool)
    differ = np.where(buf[:-1] != buf[1:], np.arange(n - 1), n)
    nxt = np.minimum.accumulate(differ[::-1])[::-1]  # where the run of one byte ends
    inside = np.flatnonzero(nxt < n)
    up[inside] = buf[nxt[inside]] < buf[nxt[inside] + 1]
    return up


def suffix_order(buf: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Order, by at least ``depth`` bytes, of the suffixes at ``wanted`` (a mask).

    Every suffix of the set that is larger than its successor needs that successor in the set too, so the set is
    closed up to the next smaller one. Smaller ones are sorted directly; then the buckets of first bytes are scanned
    upwards, and each scanned suffix puts its predecessor, if that is of the larger kind, next into the
    predecessor's bucket, before the bucket's smaller ones.
    """
    n = len(buf)
    small = smaller(buf)
    stop = np.where(small, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    inside = wanted.copy()
    open_ = np.flatnonzero(wanted & ~np.concatenate((wanted[1:], [True])) & ~small)
    if len(open_):
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, open_, 1)
        np.add.at(edge, np.minimum(stop[open_] + 1, n), -1)
        inside |= np.cumsum(edge)[:n] > 0
    direct = np.flatnonzero(inside & small)
    direct = by_prefix(buf, direct, depth)
    bounds = np.searchsorted(buf[direct], np.arange(257))
    larger = inside & ~small
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Deals the predecessors out to their buckets; returns those of the bucket being scanned."""
        before = scanned[scanned > 0] - 1
        before = before[larger[before]]
        first = buf[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        mine = before[:0]
        for chunk in np.split(before, cuts):
            if len(chunk):
                if buf[chunk[0]] == c:
                    mine = chunk
                else:
                    induced[buf[chunk[0]]].append(chunk)
        return mine

    for c in range(256):
        scan = np.concatenate(induced[c]) if induced[c] else direct[:0]
        while len(scan):
            out.append(scan)
            scan = induce(scan, c)
        mine = direct[bounds[c] : bounds[c + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, c)
    order = np.concatenate(out) if out else direct
    return order[wanted[order]]


def repeated(texts: list[bytes], froms: np.ndarray, tos: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first and last start) of each run of strings, out of those that start at froms..tos of each text,
    that occur twice or more; a text stands for as many equal ones as ``times`` says."""
    lengths = np.array([len(t) + 1 for t in texts])
    base = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, base + froms, 1)
    np.add.at(edge, base + tos + 1, -1)
    wanted = np.cumsum(edge)[:-1] > 0
    order = suffix_order(buf, wanted, width)
    # adjacent common prefixes, as far as the width
    eight = np.ndarray((len(buf) + width,), "<u8", np.concatenate((buf, np.zeros(width + 8, np.uint8))), 0, (1,))
    same = np.ones(max(len(order) - 1, 0), bool)
    live = np.arange(len(same))
    for off in range(0, width, 8):
        off = min(off, width - 8)
        equal = eight[order[live] + off] == eight[order[live + 1] + off]
        same[live[~equal]] = False
        live = live[equal]
    hit = np.zeros(len(buf) + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit[:-1] |= wanted & (np.repeat(times, lengths) > 1)
    ends = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    ends = np.concatenate(([0], ends)) if hit[0] else ends
    first, last = ends[::2], ends[1::2] - 1
    row = np.searchsorted(base, first, "right") - 1
    return row, first - base[row], last - base[row]


# --- the distributed operator --------------------------------------------------------------------------------------

STRETCH = "core long, own long, lo smallint, hi smallint, left int, c long, stretch binary"


def covered(docs: DataFrame, stages: Stages, o: Options) -> DataFrame:
    """(doc_id, th, spans): the byte runs of each text to remove, not merged yet. docs: doc_id, th, text (binary)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for number, at, first, last, key, whole in anchors(texts, o):
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("th").take(rows), pa.array(key), pa.array(whole), pa.array(at), pa.array((at - last).astype(np.int16)), pa.array((at - first).astype(np.int16))], ["doc_id", "th", "core", "own", "at", "lo", "hi"])

    found = stages.save("found", docs.mapInArrow(scan, "doc_id long, th long, core long, own long, at long, lo smallint, hi smallint"))
    # written first: the join then has plain shuffles on both sides, and a hot anchor's rows can be split
    cores = stages.save("cores", found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    cand = stages.save("candidates", found.join(cores, "core"))
    stages.drop("found", "cores")
    # one row for each content, with the number of its occurrences; it is cut out of the least of its documents
    classes = cand.groupBy("core", "own").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "at", "lo", "hi")).alias("r"))
    parts = classes.groupBy("r.doc_id", "r.th").agg(F.collect_list(F.struct("core", "own", "r.at", "r.lo", "r.hi", "c")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # copies of one row lie in one partition; one of them is cut
        for b in batches:
            for text, parts, key in zip(b.column("text"), b.column("parts"), zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist())):
                if key in done:
                    continue
                done.add(key)
                p = {f: parts.values.field(f) for f in ("core", "own", "at", "lo", "hi", "c")}
                at, lo, hi = (p[f].to_numpy().astype(np.int64) for f in ("at", "lo", "hi"))
                raw = text.as_buffer()
                own = [raw[f:t].to_pybytes() for f, t in zip((at - hi).tolist(), (at - lo + o.width).tolist())]
                yield pa.RecordBatch.from_arrays([p["core"], p["own"], p["lo"], p["hi"], pa.array(hi.astype(np.int32)), p["c"], pa.array(own, pa.binary())], ["core", "own", "lo", "hi", "left", "c", "stretch"])

    rows = stages.save("stretches", docs.join(parts, ["doc_id", "th"]).select("text", "parts", "doc_id", "th").mapInArrow(cut, STRETCH))
    levels, links = parted(rows, stages, o)
    spans = None
    for n in reversed(range(len(levels))):
        here = levels[n].repartition("core").sortWithinPartitions("core").mapInArrow(lambda batches: sort(batches, o), "core long, own long, a int, b int")
        if spans is not None:
            here = here.unionByName(links[n].join(spans, ["core", "own"]).select(F.col("of_core").alias("core"), F.col("of_own").alias("own"), "a", "b"))
        spans = stages.save(f"spans{n}", here)
    # a row's copies share one id and hash: each span of a text stays once before the spans meet
    place = lambda x: (F.col("at") + F.col(x)).alias(x)
    out = cand.join(spans, ["core", "own"]).select("doc_id", "th", place("a"), place("b")).distinct()
    return out.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def sort(batches: Iterator[pa.RecordBatch], o: Options) -> Iterator[pa.RecordBatch]:
    """(core, own, a, b): runs of bytes, from and to places counted from the anchor, that repeated strings cover. Rows
    come in the order of core; whole groups are taken together up to ``batch`` bytes."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lo, hi, left, c = (t.column(f).to_numpy().astype(np.int64) for f in ("lo", "hi", "left", "c"))
        row, first, end = repeated(t.column("stretch").to_pylist(), left - hi, left - lo, c, o.width)
        at = pa.array(row)
        a, b = (first - left[row]).astype(np.int32), (end - left[row] + o.width).astype(np.int32)
        return pa.RecordBatch.from_arrays([*[t.column(f).take(at).combine_chunks() for f in ("core", "own")], pa.array(a), pa.array(b)], ["core", "own", "a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        core = b.column("core").to_numpy()
        ends = np.cumsum([len(x) for x in b.column("stretch").to_pylist()])
        new = np.flatnonzero(np.concatenate(([core[0] != last], core[1:] != core[:-1])))
        before = np.concatenate(([0], ends))
        at = 0
        while True:
            full = new[(new >= at) & (size + before[new] - before[at] >= o.batch)]
            if not len(full):
                break
            held.append(b.slice(at, full[0] - at))
            yield done()
            held, size, at = [], 0, int(full[0])
        held.append(b.slice(at))
        size += int(before[-1] - before[at])
        last = core[-1]
    if held:
        yield done()


def parted(rows: DataFrame, stages: Stages, o: Options) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of stretches to sort, and for each level but the last the (core, own, of_core, of_own) of the parts that
    its large groups were cut into.

    ``left``: the anchor's place inside the stretch. A group of more than ``group`` stretches is cut by the strings'
    start into quarters; the bytes that all strings of a quarter share become its parts' core. Parts of one content
    become one row with their occurrences summed, and a part that is alone with its core goes: its strings occur once.
    At the latest the fourth level has single strings, one row for each core.
    """
    step, levels, links = o.span, [], []
    while True:
        turn = len(levels)
        big = stages.save(f"big{turn}", rows.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > o.group).select("core")) if step > 1 else None
        if big is None or not big.limit(1).count():
            return [*levels, rows], links
        levels.append(rows.join(big, "core", "left_anti"))
        step = max(1, -(-step // 4))

        def split(batches: Iterator[pa.RecordBatch], width: int = o.width, now: int = step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[] for _ in range(9)]
                for core, mine, lo, hi, left, c, text in zip(*[b.column(x).to_pylist() for x in ("core", "own", "lo", "hi", "left", "c", "stretch")]):
                    for k in range(lo // now, hi // now + 1):
                        a, z = max(lo, k * now), min(hi, k * now + now - 1)
                        # strings start k*now .. k*now+now-1 before the anchor; all of them hold these bytes
                        shared = text[max(left - k * now, 0) : left - (k * now + now - 1) + width]
                        part = text[left - z : left - a + width]
                        values = (xxhash.xxh3_64_intdigest(shared, seed=k) ^ (core & 2**64 - 1), xxhash.xxh3_64_intdigest(part, seed=z), a, z, z, c, part, core, mine)
                        for col, v in zip(out, values):
                            col.append(v)
                kinds = (pa.uint64(), pa.uint64(), pa.int16(), pa.int16(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([cols[0].view(pa.int64()), cols[1].view(pa.int64()), *cols[2:]], ["core", "own", "lo", "hi", "left", "c", "stretch", "of_core", "of_own"])

        cut = stages.save(f"cut{turn}", rows.join(big, "core", "left_semi").select("core", "own", "lo", "hi", "left", "c", "stretch").mapInArrow(split, f"{STRETCH}, of_core long, of_own long"))
        links.append(cut.select("core", "own", "of_core", "of_own"))
        same = cut.groupBy("core", "own").agg(F.sum("c").alias("c"), F.first(F.struct("lo", "hi", "left", "stretch")).alias("r"))
        often = cut.groupBy("core").agg(F.sum("c").alias("n")).where("n > 1").select("core")
        rows = stages.save(f"rows{turn}", same.join(often, "core").select("core", "own", "r.lo", "r.hi", "r.left", "c", "r.stretch"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def characters(part: bytes, first: bool, last: bool) -> bytes:
    """A stretch of valid UTF-8 without the bytes of characters that are cut at its ends, the text's own ends apart."""
    a, z = 0, len(part)
    while not first and a < z and part[a] & 0xC0 == 0x80:
        a += 1
    if not last:
        lead = z - 1
        while lead >= a and part[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= a and lead + (1 if part[lead] < 0xC0 else 2 if part[lead] < 0xE0 else 3 if part[lead] < 0xF0 else 4) > z:
            z = lead
    return part[a:z]


def dedup(docs: DataFrame, o: Options = Options(), id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` plus removed (the maximal runs, in bytes of the input text) and kept (the remaining bytes, joined).

    A byte goes if a string of ``width`` bytes over it also starts anywhere else, in the same text or another one;
    strings are judged on the input. Null texts count as empty; texts under ``width`` bytes lose nothing; all of a
    repeated text of ``width`` bytes or more goes, in every row, null ids included; an empty table gives an empty result.
    Texts are taken whole, however long: only the search for anchors takes them in overlapping pieces. Input columns named removed or
    kept are replaced. Two copies of the texts are shuffled, one to cut out what must be sorted, one for the result.
    With ``whole_characters`` kept has no bytes of characters that a cut has split.
    """
    stages = Stages(docs.sparkSession, "suffix-dedup")
    docs = docs.drop(*[c for c in ("removed", "kept") if c not in (id_col, text_col)])
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = stages.finish(covered(source, stages, o), "spans")
    names = docs.columns
    whole = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "__th": F.xxhash64(text)})
    whole = whole.join(spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), ["__id", "__th"], "left").select(*names, "__spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, kept = [], []
            for t, s in zip(b.column(names.index(text_col)).to_pylist(), b.column(len(names)).to_pylist()):
                t = (t or "").encode()
                found = merged(s)
                edges = [0, *[x for r in found for x in r], len(t)]
                runs.append([{"a": a, "b": z} for a, z in found])
                stay = [t[x:y] if not whole_characters else characters(t[x:y], x == 0, y == len(t)) for x, y in zip(edges[::2], edges[1::2])]
                kept.append(b"".join(stay) if found else t)
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(runs, kind), pa.array(kept, pa.binary())], [*names, "removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return whole.mapInArrow(remove, f"{fields}, removed array<struct<a:bigint,b:bigint>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages; the bytes of a character that a cut has split go too.

    No row goes, even one that loses all of its text: null texts stay null, empty ones empty. Repeated rows lose all
    that they share. Texts are searched whole, however long; which of several equal passages is first does not matter,
    since all go. An empty table gives an empty one.
    """
    apart, back = aside(docs, ["removed", "kept"])
    out = dedup(apart, whole_characters=True)
    out = out.withColumn("text", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*back)
