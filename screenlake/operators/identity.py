"""Which rows are the same paper: cascaded lookups, fuzzy titles, and the ordered fold of a search's results."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.functions.text import fold_title, normalise_doi, normalise_title, plain_similarity, squash_title, title_similarity
from screenlake.operators.graph import components
from screenlake.operators.upserts import with_ids
from screenlake.stages import Stages


def find_existing(refs: DataFrame, papers: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, paper_id) of refs (key, doi, title) found among papers: by DOI, else by title, else by title without
    white space; never where both have DOIs that differ; the lowest id wins. The squashed title only counts where no
    paper has the title itself."""
    r = refs.select(key, normalise_doi("doi").alias("d"), normalise_title("title").alias("t"), squash_title("title").alias("s"))
    p = papers.select(F.col("id").alias("paper_id"), normalise_doi("doi").alias("pd"), F.lower(F.coalesce("doi", F.lit(""))).alias("raw"), F.lower(F.coalesce("title", F.lit(""))).alias("pt"), squash_title("title").alias("ps"))
    by_doi = r.where("d is not null").join(p.where("raw <> ''").groupBy("raw").agg(F.min("paper_id").alias("paper_id")), F.col("d") == F.col("raw")).select(key, "paper_id")
    rest = r.join(by_doi.select(key), key, "left_anti").where("t <> ''")
    fine = F.col("d").isNull() | F.col("pd").isNull() | (F.col("d") == F.col("pd"))
    titled = rest.join(p, F.col("t") == F.col("pt")).groupBy(key).agg(F.min(F.when(fine, F.col("paper_id"))).alias("paper_id"))
    squashed = rest.join(titled.select(key), key, "left_anti").join(p, F.col("s") == F.col("ps")).where(fine).groupBy(key).agg(F.min("paper_id").alias("paper_id"))
    return by_doi.unionByName(titled.where("paper_id is not null")).unionByName(squashed)


def plain_title(title: str | None) -> str:
    return " ".join((title or "").split()).lower()


@F.pandas_udf(T.StringType())
def folded(titles: pd.Series) -> pd.Series:
    return titles.map(fold_title)


@F.pandas_udf(T.StringType())
def plain(titles: pd.Series) -> pd.Series:
    return titles.map(plain_title)


def shared_grams(total: int, q: int, least: float) -> int:
    """How many substrings of length ``q`` two strings of ``total`` characters together share at least if their ratio
    is ``least`` or more.

    The ratio is 2 m / total for m characters in common blocks, and total - 2 m characters lie outside of them, so there
    is at most one block more than that; each block loses q - 1 places.
    """
    m = math.ceil(least * total / 2 - 1e-9)
    return m - (q - 1) * (total - 2 * m + 1)


@lru_cache(maxsize=None)
def prefixes(n: int, least: float) -> tuple[tuple[int, int], ...]:
    """(q, k): a string of ``n`` characters meets every string of a ratio of ``least`` or more under one of its first k
    substrings of length q, in whatever order both sides list them; q is the longest that the length of the pair allows."""
    need: dict[int, int] = {}
    for other in range(max(1, math.ceil(least * n / (2 - least) - 1e-9)), math.floor(n * (2 - least) / least + 1e-9) + 1):
        q = next(q for q in (3, 2, 1) if q == 1 or shared_grams(n + other, q, least) >= 1)
        need[q] = min(need.get(q, n), shared_grams(n + other, q, least))
    return tuple((q, n - q + 1 - t + 1) for q, t in need.items())


def gram_lists(keys: DataFrame, least: float) -> DataFrame:
    """k, grams: each substring (q, g, keep) of k of the lengths q that its pairs use, with the number of its
    occurrence in front."""

    @F.pandas_udf("array<struct<q:int,g:string,keep:int>>")
    def listed(titles: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            if not t:
                return [{"q": 0, "g": "", "keep": 1}]
            out = []
            for q, keep in prefixes(len(t), least):
                seen: Counter[str] = Counter()
                for i in range(len(t) - q + 1):
                    g = t[i : i + q]
                    seen[g] += 1
                    out.append({"q": q, "g": f"{seen[g]} {g}", "keep": keep})
            return out

        return titles.map(one)

    return keys.select("k", listed("k").alias("grams"))


def first_title_match(refs: DataFrame, works: DataFrame, key: str = "ref_id", least: float = 0.85, years: int = 1) -> DataFrame:
    """(key, work_id, similarity): for refs (key, title, year) the first of the works (work_id, title, year, rank)
    whose title is similar enough and whose year is within ``years`` where both are known."""
    pairs = _similar(refs.withColumn("k", folded(F.lower("title"))), works.withColumn("k", folded("title")), key, title_similarity, least)
    near = F.col("year").isNull() | F.col("work_year").isNull() | (F.abs(F.col("year") - F.col("work_year")) <= years)
    hits = pairs.where(near)
    return hits.groupBy(key).agg(F.min(F.struct("rank", "work_id", "similarity")).alias("m")).select(key, "m.work_id", "m.similarity")


def best_title_match(refs: DataFrame, works: DataFrame, key: str = "ref_id", least: float = 0.85) -> DataFrame:
    """(key, work_id, similarity): the most similar work, the earliest of equals; years don't count."""
    hits = _similar(refs.withColumn("k", plain("title")), works.withColumn("k", plain("title")), key, plain_similarity, least)
    return hits.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("rank")).alias("back"), "work_id")).alias("m")).select(key, "m.work_id", "m.similarity")


#: Characters that are counted one by one; all others count together, which only raises the bound.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(k: Column) -> Column:
    """How often a title has each of the counted characters, and all others."""
    each = F.transform(F.array(*[F.lit(c) for c in COUNTED]), lambda c: F.length(k) - F.length(F.replace(k, c, F.lit(""))))
    return F.concat(each, F.array(F.length(k) - F.aggregate(each, F.lit(0), lambda s, x: s + x)))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(rk, wk): pairs of different titles (k) that can have a ratio of ``least`` or more; none of those is left out.

    A pair of that ratio shares a number of substrings that its lengths give, so one of the rarest of each side; under
    the first one they share, as many must be able to follow on both sides. What is left must also have enough
    characters in common, whatever their order, and as many substrings.
    """
    st = Stages(left.sparkSession, "titles")
    lists = [st.save(n, gram_lists(x, least)) for n, x in (("refs", left), ("works", right))]
    a, b = (x.select("k", F.char_length("k").alias("n"), F.explode("grams").alias("x")).select("k", "n", "x.q", "x.g", "x.keep") for x in lists)
    often = a.select("q", "g").union(b.select("q", "g")).groupBy("q", "g").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("k", "q").orderBy("often", "g"))  # at most a title's length
    rare = lambda x: x.join(often, ["q", "g"]).withColumn("place", place).where("place <= keep").select("k", "n", "q", "g", "place")
    a, b = (rare(x).withColumnsRenamed({"k": k, "n": n, "place": p}) for x, k, n, p in ((a, "rk", "rn", "rp"), (b, "wk", "wn", "wp")))
    total = F.col("rn") + F.col("wn")
    both = F.ceil(F.lit(least) * total / 2 - 1e-9)  # characters in common blocks, at least
    need = lambda q: both - (q - 1) * (total - 2 * both + 1)  # noqa: E731 - as shared_grams
    own = F.when(F.col("q") == 0, 0).when(need(3) >= 1, 3).when(need(2) >= 1, 2).otherwise(1)  # the pair's own length of substrings
    fits = (2 * F.least("rn", "wn") >= F.lit(least) * total - 1e-9) & (F.col("q") == own)
    met = a.join(b, ["q", "g"]).where(fits).groupBy("rk", "wk", "rn", "wn", "q").agg(F.min(F.struct("rp", "wp")).alias("p"))
    follow = 1 + F.least(F.col("rn") - F.col("q") + 1 - F.col("p.rp"), F.col("wn") - F.col("q") + 1 - F.col("p.wp"))
    pairs = met.where((F.col("q") == 0) | (follow >= need(F.col("q")))).select("rk", "wk", "q", need(F.col("q")).alias("need"))
    for side, x in zip("rw", lists):
        pairs = pairs.join(x.select(F.col("k").alias(f"{side}k"), letters(F.col("k")).alias(f"{side}a"), F.col("grams").alias(f"{side}g")), f"{side}k")
    common = F.aggregate(F.zip_with("ra", "wa", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = pairs.where(2 * common >= F.lit(least) * (F.char_length("rk") + F.char_length("wk")) - 1e-9)
    own = lambda c: F.transform(F.filter(c, lambda x: x["q"] == F.col("q")), lambda x: x["g"])
    return pairs.where((F.col("q") == 0) | (F.size(F.array_intersect(own("rg"), own("wg"))) >= F.col("need"))).select("rk", "wk")


def _similar(refs: DataFrame, works: DataFrame, key: str, similarity: Callable, least: float) -> DataFrame:
    """key, year, work_id, work_year, rank, similarity of all pairs whose titles ``k`` have a ratio of ``least`` or more.

    Different titles are compared once, and only ``candidates`` reach the comparison.
    """
    r = refs.select(key, "year", F.col("k").alias("rk"))
    w = works.select("work_id", F.col("year").alias("work_year"), "rank", F.col("k").alias("wk"))
    left, right = r.select(F.col("rk").alias("k")).distinct(), w.select(F.col("wk").alias("k")).distinct()
    if least <= 0:
        pairs = left.select(F.col("k").alias("rk")).crossJoin(right.select(F.col("k").alias("wk")))
    else:
        pairs = candidates(left, right, least)
    pairs = pairs.withColumn("similarity", similarity("wk", "rk")).where(F.col("similarity") >= least)
    return r.join(pairs, "rk").join(w, "wk").drop("rk", "wk")


def listed_title_match(lists: DataFrame, least: float = 0.85, years: int = 1) -> DataFrame:
    """(ref_id, work_id, similarity): first match inside each ref's own list of works (ref_id, title, year, rank, work_id, work_title, work_year), compared exhaustively."""
    near = F.col("year").isNull() | F.col("work_year").isNull() | (F.abs(F.col("year") - F.col("work_year")) <= years)
    # titles whose lengths alone keep the ratio down are not compared
    a, b = F.char_length("__a"), F.char_length("__b")
    rows = lists.withColumns({"__a": folded("work_title"), "__b": folded(normalise_title("title"))}).where(near & (2 * F.least(a, b) >= F.lit(least) * (a + b) - 1e-9))
    hits = rows.withColumn("similarity", title_similarity("work_title", normalise_title("title"))).where(F.col("similarity") >= least)
    return hits.groupBy("ref_id").agg(F.min(F.struct("rank", "work_id", "similarity")).alias("m")).select("ref_id", "m.work_id", "m.similarity")


def distinct_dois(rows: DataFrame, col: str = "doi", order: str = "seq", size: int | None = None) -> DataFrame:
    """doi, seq of first mention and, with ``size``, the number of its chunk."""
    out = rows.select(normalise_doi(col).alias("doi"), F.col(order).alias("seq")).where("doi is not null").groupBy("doi").agg(F.min("seq").alias("seq"))
    if size:
        from screenlake.stages import numbered

        out = numbered(out, ["seq", "doi"]).withColumn("chunk", F.floor(F.col("nth") / size).cast("int")).drop("nth")
    return out


class Shelf:
    """Papers of one group in the order of their arrival, found by DOI, else by name: the first paper of the name, or
    for an entry with a DOI the first that has none. Every step looks up one key."""

    def __init__(self) -> None:
        self.papers: list[list] = []  # id, DOI, title
        self.by_doi: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.free: dict[str, list[int]] = {}

    def find(self, doi: str | None, *names: str) -> int | None:
        """By DOI, else by the first of the names that any paper has."""
        if doi and doi in self.by_doi:
            return self.by_doi[doi]
        for name in names:
            if name and name in self.first:
                if not doi:
                    return self.first[name]
                free = self.free.get(name, [])
                while free and self.papers[free[0]][1]:
                    heapq.heappop(free)
                return free[0] if free else None
        return None

    def name(self, k: int, *names: str) -> None:
        """Gives a paper names; an earlier paper goes before later ones of a name."""
        for name in filter(None, names):
            self.first[name] = min(k, self.first.get(name, k))
            if not self.papers[k][1]:
                heapq.heappush(self.free.setdefault(name, []), k)

    def add(self, paper: int, doi: str | None, *names: str) -> int:
        k = len(self.papers)
        self.papers.append([paper, doi, names[0] if names else ""])
        if doi:
            self.by_doi.setdefault(doi, k)
        self.name(k, *names)
        return k

    def learn(self, k: int, doi: str | None) -> None:
        """A paper without a DOI takes one that no paper has."""
        if doi and not self.papers[k][1] and doi not in self.by_doi:
            self.papers[k][1] = doi
            self.by_doi[doi] = k


def find_or_create(papers: DataFrame, works: DataFrame) -> DataFrame:
    """(seq, paper_id, maker): for each of the works (seq, doi, title), in the order of ``seq``, the paper that it is: one
    known before, or null and the seq of the work that makes it.

    A work is the paper of its DOI, else the first of its title, else, where no paper has the title, the first of it
    without white space; never where both have DOIs that differ. A paper without DOI takes that of its first work, so
    later works see it. Only papers that share a key with a work are looked at, in groups linked by keys, and each
    group is read once, in order.
    """
    st = Stages(papers.sparkSession, "find-or-create")

    def keyed(df: DataFrame, seq: Column, kind: int, doi: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), seq.alias("seq"), F.nullif(doi, F.lit("")).alias("d"), normalise_title("title").alias("t"), squash_title("title").alias("s"))

    def keys(df: DataFrame) -> DataFrame:
        return df.select("kind", "seq", F.explode(F.array(F.concat(F.lit("d"), "d"), F.when(F.col("s") != "", F.concat(F.lit("s"), "s")))).alias("k")).where("k is not null")

    w = st.save("works", keyed(works, F.col("seq"), 1, normalise_doi("doi")))
    p = keyed(papers, F.col("id"), 0, F.lower("doi"))
    wanted = st.save("keys", keys(w).select("k").distinct())
    near = keys(p).join(wanted, "k", "left_semi")
    rows = st.save("rows", w.unionByName(p.join(near.select("seq").distinct(), "seq", "left_semi").select(*w.columns)).withColumn("node", F.col("seq") * 2 + F.col("kind")))
    links = st.save("links", keys(rows).select((F.col("seq") * 2 + F.col("kind")).alias("a"), "k"))
    heads = links.groupBy("k").agg(F.min("a").alias("b"))
    groups = components(st, links.join(heads, "k").select("a", "b"))
    rows = rows.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shelf = None, Shelf()
        for b in batches:
            out: list[tuple] = []
            for g, kind, seq, d, t, q in zip(*[b.column(c).to_pylist() for c in ("grp", "kind", "seq", "d", "t", "s")]):
                if g != group:
                    group, shelf = g, Shelf()
                names = ("t" + t, "s" + q) if q else ()
                if kind == 0:
                    shelf.add(2 * seq, d, *names)
                    continue
                k = shelf.find(d, *names)
                if k is None:
                    k = shelf.add(2 * seq + 1, d, *names)
                else:
                    shelf.learn(k, d)
                paper, made = divmod(shelf.papers[k][0], 2)
                out.append((seq, None if made else paper, paper if made else None))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["seq", "paper_id", "maker"])

    got = rows.select("grp", "kind", "seq", "d", "t", "s").repartition("grp").sortWithinPartitions("grp", "kind", "seq")
    return st.finish(got.mapInArrow(fold, "seq long, paper_id long, maker long"))


WORK_FIELDS = ("doi", "title", "authors", "year", "abstract", "publication_title", "pdf_url")


def absorb(papers: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, (seq, paper_id), ids of new papers) after the works (seq and the fields of a work) came in: unknown
    ones become papers, known ones fill what their papers lack."""
    st = Stages(papers.sparkSession, "absorb")
    for c in WORK_FIELDS:
        if c not in works.columns:
            works = works.withColumn(c, F.lit(None).cast("int" if c == "year" else "string"))
    works = st.save("works", works.select("seq", *WORK_FIELDS))
    placed = st.save("placed", find_or_create(papers, works))
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    made = works.join(placed.where("maker = seq").select("seq"), "seq")
    made = made.withColumns({"title": trimmed("title"), "abstract": trimmed("abstract"), "authors": F.coalesce("authors", F.lit("")), "publication_title": F.coalesce("publication_title", F.lit("")), "year": F.coalesce("year", F.lit(0)), "doi": F.nullif("doi", F.lit(""))})
    new = st.save("new", with_ids(papers, made, ["seq"]))
    ids = new.select(F.col("seq").alias("maker"), F.col("id").alias("new_id"))
    placed = st.save("ids", placed.join(ids, "maker", "left").select("seq", F.coalesce("paper_id", "new_id").alias("paper_id"), (F.col("seq") == F.col("maker")).alias("made")))
    for f in papers.schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    grown = st.save("grown", papers.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in papers.schema])))
    later = works.join(placed.where("not coalesce(made, false)"), "seq").withColumn("rank", F.col("seq"))
    return fill_missing(grown, later), placed.select("seq", "paper_id"), ids.select(F.col("new_id").alias("paper_id"))


def _first_papers(st: Stages, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of entries (seq, d, t): when papers arise. (d, made, name, named): the entry that makes a DOI's paper, and the
    first title that it gets, with the entry that brings it; (t, s0): the first entry without DOI of each title; (t) of
    the titles whose first such entry finds a paper.

    An entry without DOI makes a paper at s0 if no paper has its title by then. An entry with a DOI makes the DOI's
    paper unless that exists, or its title has such a paper; the title's paper never takes the DOI. So when a DOI's
    paper arises depends on titles, and whether a title's paper arises on earlier DOIs. Both only look back, so starting
    from the guess that every title's paper arises and deciding all again until nothing changes ends at the one answer,
    after as many rounds as such decisions hang on each other. A round sees at most two rows of each (DOI, title),
    merged before they are shuffled, so a large group is spread over all tasks.
    """
    s0 = st.save("s0", e.where("d is null and t <> ''").groupBy("t").agg(F.min("seq").alias("s0")))
    of_doi = e.where("d is not null")
    later = F.coalesce(F.col("seq") > F.col("s0"), F.lit(False))
    first = of_doi.where("t <> ''").groupBy("d", "t").agg(F.min("seq").alias("seq"))
    # the first entry of a DOI and a title, and the first after the title's own entry
    after = of_doi.where("t <> ''").join(s0, "t").where(later).groupBy("d", "t").agg(F.min("seq").alias("seq"))
    turns = first.unionByName(after).distinct().join(s0, "t", "left").select("d", "t", "seq", "s0", later.alias("waits"))
    turns = st.save("turns", turns)
    bare = st.save("bare", of_doi.where("t = ''").groupBy("d").agg(F.min("seq").alias("u0")))
    lent = of_doi.where("t <> ''").join(bare, "d").where("seq > u0").groupBy("d").agg(F.min(F.struct("seq", "t")).alias("lent"))
    bare = st.save("lent", bare.join(lent, "d", "left"))
    gone, seen, turn = s0.select("t").limit(0), None, 0
    while True:
        open_ = turns.join(gone.withColumn("gone", F.lit(True)), "t", "left").where("not waits or gone")
        made = open_.groupBy("d").agg(F.min(F.struct("seq", "t")).alias("m")).join(bare, "d", "full")
        titled = F.col("m").isNotNull() & (F.col("u0").isNull() | (F.col("m.seq") < F.col("u0")))
        made = made.select("d", F.when(titled, F.col("m.seq")).otherwise(F.col("u0")).alias("made"), F.when(titled, F.col("m")).otherwise(F.col("lent")).alias("x"))
        made = st.save(f"made{turn}", made.select("d", "made", F.col("x.t").alias("name"), F.col("x.seq").alias("named")))
        gone = made.groupBy(F.col("name").alias("t")).agg(F.min("named").alias("n")).join(s0, "t").where("n < s0").select("t")
        gone = st.save(f"gone{turn}", gone)
        now = tuple(gone.agg(F.count("*"), F.sum(F.xxhash64("t").cast("decimal(38,0)"))).first())
        if now == seen:
            return made, s0, gone
        seen, turn = now, turn + 1


def _first_named(queries: DataFrame, events: DataFrame, blocks: int) -> DataFrame:
    """(seq, paper): for queries (t, seq) the least ``made`` of the events (t, seq, made) of the title up to them.

    Each title's rows are cut into blocks of their order; a block looks at its own rows and at the least of the blocks
    before it, so a title that a third of all rows have is many tasks.
    """
    rows = events.select("t", "seq", "made", F.lit(False).alias("asks")).unionByName(queries.select("t", "seq", F.lit(None).cast("long").alias("made"), F.lit(True).alias("asks")))
    span = rows.groupBy("t").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count("*").alias("n"))
    many = F.least(F.lit(blocks), F.ceil(F.col("n") / 4096)).cast("long")
    rows = rows.join(span, "t").withColumn("block", F.floor((F.col("seq") - F.col("low")) * many / (F.col("high") - F.col("low") + 1)).cast("int")).select("t", "block", "seq", "made", "asks")
    before = rows.groupBy("t", "block").agg(F.min("made").alias("made"))
    before = before.select("t", "block", F.min("made").over(Window.partitionBy("t").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one row for each block
    own = F.min("made").over(Window.partitionBy("t", "block").orderBy("seq", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("own", own).where("asks").join(before, ["t", "block"]).select("seq", F.least("own", "before").alias("paper"))


def ingest(entries: DataFrame) -> DataFrame:
    """(seq, paper, inserted, title, authors, year, abstract, publication_title, doi, keywords): the fold of a search's
    entries into papers, in the order of ``seq``; ``paper`` is the seq of the entry that made the paper.

    An entry is the paper of its DOI, else that of its title unless both have DOIs that differ; later entries fill
    empty fields. When papers arise is found by DOI and title without reading any group in order (``_first_papers``);
    texts don't pass through. Entries with neither key are papers of their own.
    """
    spark = entries.sparkSession
    st = Stages(spark, "ingest")
    e = entries.withColumn("__d", F.nullif(F.trim(F.coalesce("doi", F.lit(""))), F.lit(""))).withColumn("__t", normalise_title("title"))
    keyed = st.save("keyed", e.select("seq", F.col("__d").alias("d"), F.col("__t").alias("t")).where("d is not null or t <> ''"))
    made, s0, gone = _first_papers(st, keyed)
    with_doi = keyed.where("d is not null").join(made.select("d", "made"), "d", "left").join(s0, "t", "left")
    with_doi = with_doi.select("seq", F.when(F.col("seq") >= F.col("made"), F.col("made")).otherwise(F.col("s0")).alias("paper"))
    events = made.where("name is not null").select(F.col("name").alias("t"), F.col("named").alias("seq"), "made").unionByName(s0.join(gone, "t", "left_anti").select("t", F.col("s0").alias("seq"), F.col("s0").alias("made")))
    without = _first_named(keyed.where("d is null").select("t", "seq"), events, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = with_doi.unionByName(without)
    got = st.save("papers", e.select("seq", "__d").join(got, "seq", "left").select("seq", F.coalesce("paper", "seq").alias("paper"), "__d"))
    names = [c for c in entries.columns if c != "seq"]
    filled = [c for c in ("title", "authors", "abstract", "year") if c in names]
    full = {c: F.col(c).isNotNull() if c == "year" else F.coalesce(c, F.lit("")) != "" for c in filled}
    first = got.join(entries.select("seq", *filled), "seq").groupBy("paper").agg(*[F.min_by(c, F.when(full[c], F.col("seq"))).alias(f"__{c}") for c in filled])
    made = entries.withColumnRenamed("seq", "paper").join(got.where("seq = paper").select("paper", "__d"), "paper").join(first, "paper")
    value = {c: F.coalesce(f"__{c}", c) for c in filled} | ({"doi": F.col("__d")} if "doi" in names else {})
    made = made.select("paper", *[value.get(c, F.col(f"`{c}`")).alias(c) for c in names])
    return got.select("seq", "paper", (F.col("seq") == F.col("paper")).alias("inserted")).join(made, "paper").select("seq", "paper", "inserted", *names)


def ingest_counts(folded: DataFrame) -> DataFrame:
    """One row: inserted, deduped."""
    return folded.agg(F.count_if("inserted").alias("inserted"), F.count_if(~F.col("inserted")).alias("deduped"))


def fill_missing(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Papers whose empty abstract, authors, year, doi and pdf_url are filled from (paper_id, those columns, rank); a
    DOI that another paper has is not taken."""
    best = {c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.col("rank"))) for c in ("abstract", "authors", "year", "doi", "pdf_url") if c in found.columns and c in papers.columns}
    new = found.groupBy(F.col("paper_id").alias("id")).agg(*[v.alias(f"__{c}") for c, v in best.items()])
    taken = papers.where("doi is not null").select(normalise_doi("doi").alias("__taken")).distinct()
    if "doi" in best:
        clash = new.select("id", normalise_doi("__doi").alias("__taken")).join(taken, "__taken", "left_semi").select("id")
        new = new.join(clash.withColumn("__clash", F.lit(True)), "id", "left").withColumn("__doi", F.when(F.col("__clash").isNull(), F.col("__doi"))).drop("__clash")
    out = papers.join(new, "id", "left")
    for c in best:
        blank = F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
        out = out.withColumn(c, F.when(blank, F.coalesce(f"__{c}", c)).otherwise(F.col(c)))
    return out.select(*papers.columns)
