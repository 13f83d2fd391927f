"""MinHash near-dedup with sequential Bayesian verification.

Texts with the same words (A-Z as a-z) form a class; one row of each class goes on. Banded signatures give candidate
groups (stars around each bucket's least member, never all pairs). Inside a candidate group signatures are compared
in batches: after each batch a pair goes on only while the posterior probability of a similarity at or above the
threshold is at least ``miss``. A candidate group of more than a block is first compared bucket by bucket, without
texts, and falls into the groups that survivors of this comparison hold together. Survivors that are not yet known to be connected are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import Stages, components, mix, slices, texts_of, words

K = 5


@dataclass(frozen=True)
class Options:
    """6 rows in 40 bands: a pair at similarity 0.75 shares no band with probability 4e-4, at 0.8 with 5e-6.
    ``block`` and ``block_bytes``: rows of a candidate group, and bytes of their full sets, that a block has on
    average; larger groups are split by signatures, and go in pairs of blocks where that leaves them larger."""

    threshold: float = 0.75
    rows: int = 6
    bands: int = 40
    batch: int = 24
    miss: float = 1e-4
    block: int = 8192
    block_bytes: int = 1 << 26

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of the texts in turn (the whole sequence where it is shorter), shingles per
    text (0 without words), and words per text."""
    w, per = words(texts, fold=True)
    first = np.cumsum(per) - per
    count = np.where(per >= K, per - K + 1, (per > 0).astype(np.int64))
    out = np.zeros(int(count.sum()), np.uint64)
    at = np.cumsum(count) - count
    if len(w) >= K:
        full = w[: len(w) - K + 1] * np.uint64(0x9E3779B97F4A7C15)
        for j, c in zip(range(1, K), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)):
            full = full + w[j : len(w) - K + 1 + j] * np.uint64(c)
        full = mix(full)
        long = np.flatnonzero(per >= K)
        if len(long):
            n = count[long]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[long], n) + step] = full[np.repeat(first[long], n) + step]
    for i in np.flatnonzero((per > 0) & (per < K)):
        h = per[i : i + 1].astype(np.uint64)
        for k in range(first[i], first[i] + per[i]):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[k : k + 1])
        out[at[i]] = h[0]
    return out, count, per


def signatures(hashes: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Least value of n hash functions over each text's shingles; 0 for texts without any."""
    sig = np.zeros((len(count), n), np.uint32)
    rows = np.flatnonzero(count)
    if len(rows):
        starts = (np.cumsum(count) - count)[rows]
        h, step = (hashes >> np.uint64(32)).astype(np.uint32), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        for k in range(n):
            sig[rows, k] = np.minimum.reduceat(h, starts)
            h += step
    return sig


def band_keys(sig: np.ndarray, o: Options) -> np.ndarray:
    parts = sig.reshape(len(sig), o.bands, o.rows).astype(np.uint64)
    key = np.arange(1, o.bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for r in range(o.rows):
        key = mix(key + parts[:, :, r] + np.uint64(r))
    return key.view(np.int64)


def least_matches(o: Options) -> list[int]:
    """Fewest equal values after each batch with which P(similarity >= threshold) is still at least ``miss``, for a
    uniform prior: the posterior of m equal of n is Beta(m + 1, n - m + 1)."""
    grid = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(o.batch, o.hashes + 1, o.batch):
        logs = np.arange(n + 1)[:, None] * np.log(grid) + (n - np.arange(n + 1))[:, None] * np.log1p(-grid)
        p = np.exp(logs - logs.max(1, keepdims=True))
        tail = p[:, grid >= o.threshold].sum(1) / p.sum(1)
        out.append(int(np.flatnonzero(tail >= o.miss)[0]))
    return out


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


def linked(sets: list[np.ndarray], i: int, j: int, percent: int) -> bool:
    a, b = sets[i], sets[j]
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(sig: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, o: Options, need: list[int], confirm: Callable[[int, int], bool] | None = None) -> Union:
    """Joins the rows whose pair outlasts every batch and is confirmed, of all pairs of a row of ``left`` and a later
    one of ``right``; ``sizes`` are the numbers of their shingles."""
    u = Union(len(sizes))
    percent = round(100 * o.threshold)
    # rows of the least sizes first would not matter: every pair that is not connected yet is compared
    for i in left.tolist():
        js = right[right > i] if left is right else right
        roots = u.roots()
        js = js[roots[js] != roots[i]]
        js = js[(100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))]
        equal = np.zeros(len(js), np.int64)
        for k, m in enumerate(need):
            if not len(js):
                break
            part = slice(k * o.batch, (k + 1) * o.batch)
            equal = equal + (sig[js, part] == sig[i, part]).sum(1)
            go = equal >= m
            js, equal = js[go], equal[go]
        for j in js[np.argsort(-equal, kind="stable")].tolist():
            if u.find(i) != u.find(j) and (confirm is None or confirm(i, j)):
                u.join(i, j)
    return u


def dedup(docs: DataFrame, o: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Null texts and texts without words have no shingles, link with nothing, not even with each other, and are kept
    as their own component. Rows of one id are one document for the links of either text. Null ids get a null
    component of their own and are kept. Ties go to the smallest id. Other input columns are left out, whatever their
    names; an empty table gives an empty result. Texts are taken whole, however long. Candidate groups of more rows or
    bytes than a block are split by signatures; what is still larger is dealt out as pairs of blocks, so no task holds
    more than two blocks.
    """
    spark = docs.sparkSession
    st = Stages(spark, "near-text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = texts_of(b.column("text")), b.column("doc_id")
            for s, e in slices(np.array([len(t) for t in texts], np.int64), 1 << 20):
                h, count, per = shingle_hashes(texts[s:e])
                sig = signatures(h, count, o.hashes)
                at = np.cumsum(count) - count
                distinct, first, second = [], [], []
                for a, c in zip(at.tolist(), count.tolist()):
                    x = h[a : a + c]
                    distinct.append(len(np.unique(x)) if c else 0)
                    # the sequence of shingles in order stands for the sequence of words
                    k = x * (np.arange(c, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
                    first.append(int(k.sum(dtype=np.uint64).view(np.int64)) if c else 0)
                    second.append(int(np.bitwise_xor.reduce(mix(k + np.uint64(c))).view(np.int64)) if c else 0)
                keys = band_keys(sig, o)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(s, e - s), pa.array(distinct, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                    pa.array([x.astype(np.uint16).tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1) * o.bands, pa.int32()), pa.array(keys.ravel()))], ["doc_id", "n_shingles", "h1", "h2", "sig", "keys"])

    signed = docs.mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>")
    signed = st.save("signed", signed)
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = signed.where(real).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = st.save("classes", classes)
    own = signed.where(real).join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "doc_id"])
    # a document with two texts stands in two classes; its id links them
    own = st.save("own", own.select("doc_id", "h1", "h2", "n_shingles", "sig", "keys"))
    keyed = own.select("doc_id", "h1", "h2", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", "m")
    shared = st.save("shared", shared)  # the join then has plain shuffles on both sides, and a hot bucket can be split
    node = _node()
    stars = keyed.join(shared, "key").select(node.alias("a"), F.xxhash64("m.doc_id", "m.h1", "m.h2").alias("b")).where("a <> b").distinct()
    groups = st.save("groups", components(st, stars, "cand").select(F.col("node"), F.col("component").alias("grp")))
    sizes = st.save("sizes", _blocks(own, groups, o))
    if sizes.where("blocks > 1").limit(1).count():
        tight = _split(st, own, groups.join(sizes.where("blocks > 1"), "grp", "left_semi"), o)
        groups = st.save("parts", groups.join(sizes.where("blocks = 1"), "grp", "left_semi").select("node", "grp").union(tight))
        sizes = st.save("part_sizes", _blocks(own, groups, o))
    members = own.withColumn("node", node).select("doc_id", "h1", "h2", "sig", "node").join(groups, "node").join(sizes, "grp")
    members = st.save("members", members.select("doc_id", "h1", "h2", "sig", "grp", "blocks"))
    st.drop(*[n for n in st.names if n in ("groups", "sizes", "parts", "part_sizes", "shared")])
    again = st.save("again", signed.where(real).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    edges = st.save("edges", _verified(docs, members, again, o))
    # ids and classes: every row's id links to its class's, every class's to its component's
    found = components(st, edges.select("a", "b"), "links")
    found = found.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    by_id = signed.where(real).select("doc_id", "h1", "h2").join(classes, ["h1", "h2"])
    by_id = by_id.join(found, "rep", "left").select("doc_id", F.least(F.coalesce("root", "rep"), "doc_id").alias("c"))
    twice = by_id.groupBy("doc_id").agg(F.min("c").alias("c"), F.max("c").alias("d"))
    by_id = st.save("by_id", twice)
    if by_id.where("c <> d").limit(1).count():  # an id with two texts joined two components
        more = components(st, by_id.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")), "twice")
        by_id = by_id.join(more.withColumnRenamed("node", "c"), "c", "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    out = signed.select("doc_id", "n_shingles").join(by_id.select("doc_id", F.col("c")), "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return st.finish(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))


def _node() -> Column:
    return F.xxhash64("doc_id", "h1", "h2")


def _blocks(own: DataFrame, groups: DataFrame, o: Options) -> DataFrame:
    """Blocks of each candidate group, by rows and by the bytes of full sets."""
    blocks = F.ceil(F.greatest(F.count("*") / o.block, F.sum("n_shingles") * 8 / o.block_bytes)).cast("int")
    return groups.join(own.select(_node().alias("node"), "n_shingles"), "node").groupBy("grp").agg(blocks.alias("blocks"))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key with ``blocks`` blocks, once for each pair (i, j), i <= j, that holds their ``block``; equal
    (key, i, j) lie together, in one partition."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("i"), F.greatest(other, F.col("block")).alias("j"))))
    rows = rows.withColumn("p", pair).select(*keys, F.col("p.i").alias("i"), F.col("p.j").alias("j"), *[c for c in rows.columns if c not in keys and c != "blocks"])
    return rows.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys of two rows or more."""
    key, held = None, []
    for b in batches:
        rows, at = list(zip(*[b.column(c).to_pylist() for c in keys])), 0
        for k in range(len(rows)):
            if rows[k] != key:
                if k > at:
                    held.append(b.slice(at, k - at))
                if sum(h.num_rows for h in held) > 1:
                    yield key, pa.Table.from_batches(held)
                key, held, at = rows[k], [], k
        if len(rows) > at:
            held.append(b.slice(at))
    if sum(h.num_rows for h in held) > 1:
        yield key, pa.Table.from_batches(held)


def _sides(block: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    if i == j:
        every = np.arange(len(block))
        return every, every
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def _split(st: Stages, own: DataFrame, groups: DataFrame, o: Options) -> DataFrame:
    """(node, grp) of tighter groups inside ``groups`` (node, grp); rows without a survivor are left out.

    Rows of one bucket are compared by signature only, and each bucket gives at most one edge a row. A pair that is
    linked and shares a bucket outlasts the batches there, or its rows are already joined, so it stays in one group.
    Buckets of the same rows, as copies have them in every band, are compared once.
    """
    need = least_matches(o)
    rows = own.withColumn("node", _node()).join(groups, "node", "left_semi").select("node", F.col("n_shingles").alias("size"), "sig", "keys")
    rows = st.save("large", rows)
    held = rows.select("node", F.explode("keys").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    buckets = st.save("buckets", held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / o.block).cast("int").alias("blocks")))
    entry = rows.select("node", "size", "sig", F.explode("keys").alias("key")).join(buckets, "key")
    entry = _dealt(entry.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), ["key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _runs(batches, ["key", "i", "j"]):
            node, size, block = (t.column(c).to_numpy() for c in ("node", "size", "block"))
            sig = np.stack([np.frombuffer(v, np.uint16) for v in t.column("sig").to_pylist()])
            roots = verify(sig, size, *_sides(block, i, j), o, need).roots()
            go = roots != np.arange(len(roots))
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[go]), pa.array(node[roots[go]])], ["a", "b"])

    edges = st.save("survivors", entry.mapInArrow(compare, "a long, b long"))
    tight = components(st, edges, "tight").select("node", F.col("component").alias("grp"))
    st.drop("large", "buckets", "survivors")
    return tight


def _verified(docs: DataFrame, members: DataFrame, again: DataFrame, o: Options) -> DataFrame:
    """Edges (a, b) of ids that span what is linked inside each candidate group. ``again``: ids of several rows, of
    which each different text is compared once."""
    need, percent = least_matches(o), round(100 * o.threshold)
    # the texts of members only; their full sets are made where the text is
    several = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text")).select("doc_id", "text")
    once = docs.join(again, "doc_id", "left_anti").select("doc_id", "text")
    texts = once.join(members, "doc_id").unionByName(several.join(members, "doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = texts_of(b.column("text"))
            for s, e in slices(np.array([len(t) for t in raw], np.int64), 1 << 20):
                h, count, _ = shingle_hashes(raw[s:e])
                at = np.cumsum(count) - count
                keep, blobs = [], []
                h1, h2 = b.column("h1").slice(s, e - s).to_pylist(), b.column("h2").slice(s, e - s).to_pylist()
                for i, (a, c) in enumerate(zip(at.tolist(), count.tolist())):
                    x = h[a : a + c]
                    k = x * (np.arange(c, dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
                    if c and int(k.sum(dtype=np.uint64).view(np.int64)) == h1[i] and int(np.bitwise_xor.reduce(mix(k + np.uint64(c))).view(np.int64)) == h2[i]:
                        keep.append(i)
                        blobs.append(np.unique(x).tobytes())
                at_rows = pa.array(keep, pa.int64())
                part = b.slice(s, e - s)
                ids, grp, blocks = (part.column(c).take(at_rows) for c in ("doc_id", "grp", "blocks"))
                block = [int(d) % n for d, n in zip((np.array(ids.to_pylist(), np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).tolist(), blocks.to_pylist())]
                yield pa.RecordBatch.from_arrays([grp, blocks, pa.array(block, pa.int32()), ids, part.column("sig").take(at_rows), pa.array(blobs, pa.binary())], ["grp", "blocks", "block", "doc_id", "sig", "shingles"])

    rows = texts.select("doc_id", "text", "h1", "h2", "sig", "grp", "blocks").mapInArrow(sets, "grp long, blocks int, block int, doc_id long, sig binary, shingles binary")
    rows = _dealt(rows, ["grp"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), t in _runs(batches, ["grp", "i", "j"]):
            t = t.take(pa.array(np.argsort(t.column("doc_id").to_numpy(), kind="stable")))
            ids, block = t.column("doc_id").to_numpy(), t.column("block").to_numpy()
            sig = np.stack([np.frombuffer(v, np.uint16) for v in t.column("sig").to_pylist()])
            full = [np.frombuffer(v, np.uint64) for v in t.column("shingles").to_pylist()]
            u = verify(sig, np.array([len(x) for x in full]), *_sides(block, i, j), o, need, lambda i, j: linked(full, i, j, percent))
            roots = u.roots()
            go = roots != np.arange(len(roots))
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[go]), pa.array(ids[roots[go]])], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the smallest id of each component, with the columns of ``docs``.

    Rows of one kept id stay once for each different text, so no text of a repeated id is lost; of rows with equal id
    and text the one of the least hash over all columns stays. Rows with a null id, and null, empty and wordless texts,
    have no copies: all of them stay, but for rows repeated under one id. Texts are compared whole, however long. An empty
    table gives an empty one.
    """
    ids = dedup(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows"))
    once = docs.join(ids.where("__rows = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    several = docs.join(ids.where("__rows > 1").select("doc_id"), "doc_id", "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = several.groupBy("doc_id", F.xxhash64("text").alias("__a"), F.md5(F.coalesce("text", F.lit(""))).alias("__b")).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("r")).select("r.*")
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id WHERE r.c < g.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, k.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) k USING (doc_id)
"""
