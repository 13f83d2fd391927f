"""Expansion over the citation graph as pure steps on reference rows; works come from sources as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.text import is_blank, normalise_doi
from screenlake.operators.identity import WORK_FIELDS, absorb, find_existing, listed_title_match
from screenlake.operators.upserts import latest, with_ids
from screenlake.stages import Stages

#: The source that is asked for what another one does not have, and the order in which sources are tried
#: while one is throttled.
ALTERNATE = {"crossref": "openalex", "openalex": "crossref", "semantic_scholar": None, "zotero": None}
CHAINS = {
    "crossref": ("crossref", "openalex", "zotero", "semantic_scholar"),
    "openalex": ("openalex", "crossref", "zotero", "semantic_scholar"),
    "semantic_scholar": ("semantic_scholar", "openalex", "crossref", "zotero"),
    "zotero": ("zotero",),
}
#: The order in which sources are searched by title, for references and for abstracts.
TITLE_ORDER = ("openalex", "crossref", "semantic_scholar")
BACKFILL_TITLES = ("crossref", "openalex", "semantic_scholar", "zotero")


def asked_for_dois(source: str, alternates: bool = True, throttled: tuple[str, ...] = ()) -> list[str]:
    """Sources of a DOI's work, first to last: the local library, the first of the chain that is not throttled, and
    that one's alternate. Without ``alternates`` the chosen source only."""
    if not alternates:
        return [s for s in (source,) if s not in throttled]
    first = next((s for s in CHAINS[source] if s not in throttled), None)
    found = ["zotero", first, ALTERNATE.get(first)] if first else ["zotero"]
    return [s for s in dict.fromkeys(found) if s and s not in throttled]


def asked_for_abstracts(source: str, alternates: bool = True, batch: bool = True, throttled: tuple[str, ...] = ()) -> list[str]:
    """Sources of an abstract by DOI, first to last: batches of all sources, then the chosen one's chain, which ends at
    the source that has no alternate."""
    batches = ["zotero", *(["openalex"] if source == "openalex" else []), "crossref", "semantic_scholar"] if batch else []
    chain = list(CHAINS[source]) if alternates else [source]
    if "semantic_scholar" in chain:
        chain = chain[: chain.index("semantic_scholar") + 1]
    return [s for s in dict.fromkeys([*batches, *chain]) if s not in throttled]


def seeds(papers: DataFrame, paper_queries: DataFrame, paper_ids: list[int] | None = None, query_ids: list[int] | None = None) -> DataFrame:
    """Seed papers: those named, else those of the queries named, else all; distinct, in the order of their ids."""
    if paper_ids:
        return papers.where(F.col("id").isin(sorted(set(paper_ids)))).orderBy("id")
    if query_ids:
        return papers.join(paper_queries.where(F.col("query_id").isin(query_ids)).select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi").orderBy("id")
    return papers.orderBy("id")


def parse_ids(text: str | None) -> list[int]:
    return [int(x) for x in (text or "").replace(";", ",").split(",") if x.strip()]


def add_edges(edges: DataFrame, pairs: DataFrame, depth: int = 1) -> DataFrame:
    """New edges (child_paper_id, parent_paper_id) without self loops and known pairs."""
    new = pairs.where("child_paper_id <> parent_paper_id").select("child_paper_id", "parent_paper_id").distinct()
    new = new.join(edges.select("child_paper_id", "parent_paper_id"), ["child_paper_id", "parent_paper_id"], "left_anti").withColumn("depth", F.lit(depth))
    new = with_ids(edges, new, ["parent_paper_id", "child_paper_id"])
    for c in edges.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(edges.schema[c].dataType))
    return edges.unionByName(new.select(*edges.columns))


REF_KEY = ["parent_paper_id", "direction", "__doi", "__text"]


def reference_rows(refs: DataFrame) -> DataFrame:
    """Reference rows as kept: DOI normalised; a title stands in for a missing DOI and text; status by resolution."""
    doi, text, title = normalise_doi("doi"), F.trim(F.coalesce("unstructured", F.lit(""))), F.trim(F.coalesce("title", F.lit("")))
    return refs.select(
        "parent_paper_id", "direction", "ref_index", doi.alias("ref_doi"), title.alias("ref_title"), F.col("year").alias("ref_year"), F.coalesce("authors", F.lit("")).alias("ref_authors"),
        F.when(doi.isNull() & (text == "") & (title != ""), title).otherwise(text).alias("ref_unstructured"), "resolved_paper_id", "source",
        F.when(F.col("resolved_paper_id").isNotNull(), "resolved").otherwise("pending").alias("status"))


def first_mention(rows: DataFrame) -> DataFrame:
    """One row for each reference of a seed, the first by index."""
    keyed = rows.withColumns({"__doi": F.coalesce("ref_doi", F.lit("")), "__text": F.coalesce("ref_unstructured", F.lit(""))})
    return latest(keyed, REF_KEY, -F.coalesce(F.col("ref_index"), F.lit(2**31 - 1)))


def upsert_references(lists: DataFrame, refs: DataFrame) -> DataFrame:
    """Unknown references are added; a known one only gains a paper it has been resolved to."""
    new = first_mention(reference_rows(refs))
    old = lists.withColumns({"__doi": F.coalesce("ref_doi", F.lit("")), "__text": F.coalesce("ref_unstructured", F.lit(""))})
    hits = new.where("resolved_paper_id is not null").select(*REF_KEY, F.col("resolved_paper_id").alias("__r"))
    old_now = old.join(hits, REF_KEY, "left").withColumn("status", F.when(F.col("__r").isNotNull(), "resolved").otherwise(F.col("status"))).withColumn("resolved_paper_id", F.coalesce("resolved_paper_id", "__r"))
    fresh = with_ids(lists, new.join(old.select(*REF_KEY), REF_KEY, "left_anti"), ["parent_paper_id", "direction", "ref_index", "__doi", "__text"])
    for c in lists.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(lists.schema[c].dataType))
    return old_now.select(*lists.columns).unionByName(fresh.select(*lists.columns))


def sync_status(lists: DataFrame) -> DataFrame:
    return lists.withColumn("status", F.when(F.col("resolved_paper_id").isNotNull(), "resolved").otherwise(F.col("status")))


def harvest(seed_papers: DataFrame, papers: DataFrame, fetched: DataFrame, lists: DataFrame, edges: DataFrame, direction: str = "backward", source: str = "crossref") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, edges, one row of counts) after the references (parent_doi, ref_index, doi, title, authors, year, unstructured) of the seeds came in; papers known already are linked at once."""
    s = seed_papers.select(F.col("id").alias("parent_paper_id"), normalise_doi("doi").alias("k")).where("k is not null")
    refs = fetched.withColumn("k", normalise_doi("parent_doi")).join(s, "k").withColumn("ref_id", F.xxhash64("parent_paper_id", "ref_index"))
    known = find_existing(refs, papers).select("ref_id", F.col("paper_id").alias("resolved_paper_id"))
    refs = refs.join(known, "ref_id", "left").withColumns({"direction": F.lit(direction), "source": F.lit(source)})
    refs = Stages(papers.sparkSession, "harvest").save("refs", refs)
    after = upsert_references(lists, refs)
    hit = refs.where("resolved_paper_id is not null")
    pairs = hit.select(F.col("resolved_paper_id").alias("child_paper_id"), "parent_paper_id") if direction == "backward" else hit.select(F.col("parent_paper_id").alias("child_paper_id"), F.col("resolved_paper_id").alias("parent_paper_id"))
    linked = add_edges(edges, pairs)
    counts = refs.agg(F.count("*").alias("references_harvested"), F.count("resolved_paper_id").alias("local_hits"))
    return after, linked, counts


def unresolved(lists: DataFrame, with_doi: bool, direction: str | None = None) -> DataFrame:
    """References that are not resolved yet, with or without a DOI."""
    rows = lists.where(F.col("resolved_paper_id").isNull() & (~is_blank("ref_doi") if with_doi else is_blank("ref_doi")))
    return rows.where(F.col("direction") == direction) if direction else rows


def inventory(lists: DataFrame, parent: int | None = None) -> DataFrame:
    rows = lists.where(F.col("parent_paper_id") == parent) if parent is not None else lists
    return rows.orderBy("parent_paper_id", "direction", "ref_index", "id")


def ranked(sources: list[str]) -> Column:
    """The place of a row's source among those asked, from 1; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, sources)), F.col("source")).cast("int"), F.lit(0)) if sources else F.lit(None).cast("int")


def ask_in_turn(asked: DataFrame, sources: Mapping[str, Callable[[DataFrame], DataFrame]], order: Sequence[str], batch: Mapping[str, int], good: Column | None = None, throttled: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(works, calls) of the DOIs ``asked`` for (doi), each of which goes to a source only if those before had nothing.

    ``sources``: name -> function from (doi) to works; ``good``: what a work must have to count (an abstract, say).
    works: k (the DOI as it is compared), source, and the works' columns, one for each DOI that was found; calls: turn,
    source, asked, calls (in batches of the source's size), found. Sources that are throttled or unknown are left out.
    What a source leaves is written before the next is asked, so no source is asked twice; null DOIs are not asked for.
    """
    st = Stages(asked.sparkSession, "in-turn")
    left = st.save("asked", asked.select(normalise_doi("doi").alias("k")).where("k is not null").distinct())
    works, log = None, []
    for turn, name in enumerate(n for n in order if n in sources and n not in throttled):
        n = left.count()
        answers = sources[name](left.select(F.col("k").alias("doi")))
        answers = answers.where(F.lit(True) if good is None else good).withColumns({"k": normalise_doi("doi"), "source": F.lit(name)})
        columns = ["k", "source", *[c for c in answers.columns if c not in ("k", "source")]]
        whole = F.struct(*[F.col(f"`{c}`") for c in columns])
        one = answers.join(left, "k", "left_semi").groupBy("k").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("w")).select("w.*")
        found = st.save(f"found{turn}", one)
        left = st.save(f"left{turn}", left.join(found.select("k"), "k", "left_anti"))
        works = found if works is None else works.unionByName(found)
        log.append((turn, name, n, -(-n // batch.get(name, 50)), n - left.count()))
    calls = asked.sparkSession.createDataFrame(log, "turn int, source string, asked long, calls long, found long")
    return (works if works is not None else left.withColumn("source", F.lit(None).cast("string")).limit(0)), calls


def pick_works(works: DataFrame, source: str = "crossref", alternates: bool = True, throttled: tuple[str, ...] = ()) -> DataFrame:
    """One work (doi, ...) for each DOI out of those that sources (col ``source``) returned, by the order of asking."""
    keyed = works.withColumns({"__k": normalise_doi("doi"), "__rank": ranked(asked_for_dois(source, alternates, throttled))}).where("__k is not null and __rank is not null")
    return latest(keyed, ["__k"], -F.col("__rank")).drop("__rank")


def resolve_dois(lists: DataFrame, works: DataFrame, papers: DataFrame, source: str = "crossref", alternates: bool = True, throttled: tuple[str, ...] = (), budget: int | None = None, direction: str | None = None) -> DataFrame:
    """References with a DOI and the work that was found for it: ref_id, paper_id (known papers), status, first (the
    first reference of the DOI) and the work's fields. A DOI of which nothing is left is an error at once; what the
    budget of DOIs does not reach stays pending."""
    rows = unresolved(lists, True, direction).withColumn("k", normalise_doi("ref_doi"))
    asked = rows.where("k is not null").groupBy("k").agg(F.min("id").alias("first"))
    if budget is not None:
        asked = asked.orderBy("first").limit(budget)
    found = pick_works(works, source, alternates, throttled).withColumnRenamed("__k", "k")
    out = rows.join(asked.select("k", "first", F.lit(True).alias("asked")), "k", "left").join(found.drop("source"), (F.col("asked")) & (rows["k"] == found["k"]), "left").drop(found["k"])
    known = find_existing(out.where("doi is not null").select(F.col("id").alias("ref_id"), "doi", "title"), papers)
    out = out.join(known.withColumnRenamed("ref_id", "id"), "id", "left")
    status = F.when(F.col("k").isNull(), "fetch_error").when(F.col("doi").isNotNull(), "resolved").when(F.col("asked"), "fetch_error").otherwise(F.col("status"))
    return out.select(F.col("id").alias("ref_id"), "parent_paper_id", "paper_id", status.alias("status"), "first", "doi", "title", "authors", "year", "abstract", "publication_title", "pdf_url")


def title_candidates(candidates: DataFrame, sources: tuple[str, ...] | list[str]) -> DataFrame:
    """Candidates of the sources asked, ranked by source, then by the source's own order; without a column ``source``
    by the latter."""
    if "source" not in candidates.columns:
        return candidates
    place = candidates.withColumn("__source", ranked(list(sources))).where("__source is not null")
    return place.withColumn("rank", F.struct("__source", "rank")).drop("__source")


def resolve_titles(lists: DataFrame, candidates: DataFrame, source: str = "crossref", alternates: bool = True, direction: str | None = None) -> DataFrame:
    """ref_id, parent_paper_id, work_id, status and the work's fields of references without DOI: by the title's first
    match among each one's candidates (ref_id, work_id, work_title, work_year, rank and, if there, source and the fields
    of a work). No title: unresolved_no_doi; no match: unresolved_title_failed. A chosen source that has no title search
    leaves all of them pending."""
    rows = unresolved(lists, False, direction).select(F.col("id").alias("ref_id"), "parent_paper_id", F.trim(F.coalesce("ref_title", F.lit(""))).alias("title"), F.col("ref_year").alias("year"), "status")
    asked = title_candidates(candidates, TITLE_ORDER if alternates else (source,))
    if source == "semantic_scholar":
        asked, rows = asked.limit(0), rows.limit(0)
    hit = listed_title_match(rows.select("ref_id", "title", "year").where("title <> ''").join(asked.select("ref_id", "work_id", "work_title", "work_year", "rank"), "ref_id")).select("ref_id", "work_id")
    fields = [c for c in ("doi", "authors", "abstract", "publication_title", "pdf_url") if c in candidates.columns]
    works = latest(asked.select("ref_id", "work_id", F.col("work_title").alias("title"), F.col("work_year").alias("year"), *fields, "rank"), ["ref_id", "work_id"], -F.xxhash64("rank")).drop("rank")
    status = F.when(F.col("blank"), "unresolved_no_doi").when(F.col("work_id").isNull(), "unresolved_title_failed").otherwise("resolved")
    rows = rows.select("ref_id", "parent_paper_id", (F.col("title") == "").alias("blank")).join(hit, "ref_id", "left")
    return rows.join(works, ["ref_id", "work_id"], "left").withColumn("status", status).drop("blank")


@dataclass
class Resolution:
    """Tables after references were resolved, and what happened: counts by name, statuses by name."""

    papers: DataFrame
    lists: DataFrame
    edges: DataFrame
    new_papers: DataFrame
    counts: dict[str, int]
    statuses: dict[str, int]


def settle(st: Stages, name: str, r: Resolution, found: DataFrame) -> Resolution:
    """Takes in resolved references (ref_id, parent_paper_id, status, seq, the fields of their work): each becomes a
    paper or is one, the reference points to it, and an edge leads from its parent to it. Rows of one ``seq`` have one
    work."""
    found = st.save(f"{name}-found", found)
    works = latest(found.where("status = 'resolved'"), ["seq"], -F.col("ref_id"))
    papers, placed, new = absorb(r.papers, works.select("seq", *[c for c in WORK_FIELDS if c in works.columns]))
    new = st.save(f"{name}-new", new)
    papers, placed = st.save(f"{name}-papers", papers), st.save(f"{name}-placed", placed)
    result = st.save(f"{name}-result", found.join(placed, "seq", "left").select("ref_id", "parent_paper_id", "paper_id", "status"))
    lists = st.save(f"{name}-lists", apply_status(r.lists, result))
    before = r.edges.count()
    edges = st.save(f"{name}-edges", add_edges(r.edges, result.where("paper_id is not null").select(F.col("paper_id").alias("child_paper_id"), "parent_paper_id")))
    counts = dict(r.counts)
    counts["new_papers"] += new.count()
    counts["edges"] += edges.count() - before
    return Resolution(papers, lists, edges, r.new_papers.unionByName(new), counts, r.statuses)


def status_counts(lists: DataFrame) -> dict[str, int]:
    return {x["status"]: x["n"] for x in lists.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a row for each status


def expand(lists: DataFrame, papers: DataFrame, edges: DataFrame, works: DataFrame, candidates: DataFrame, source: str = "crossref", assured: bool = True, alternates: bool = True,
           throttled: tuple[str, ...] = (), budget: int | None = None, direction: str | None = None) -> Resolution:
    """References resolved into papers: sync, DOIs, titles, and with ``assured`` the check against papers and one more
    try of what failed. Works that no paper is yet become papers, so the corpus grows. Each step is written before
    the next, so plans stay small; a second run with the same works changes nothing."""
    st = Stages(papers.sparkSession, "resolve")
    empty = papers.select(F.col("id").alias("paper_id")).limit(0)
    r = Resolution(st.save("papers", papers), st.save("lists", sync_status(lists)), st.save("edges", edges), empty, {"new_papers": 0, "edges": 0, "verified": 0}, {})
    works, candidates = st.save("works", works), st.save("candidates", candidates)

    def round_(name: str, r: Resolution) -> Resolution:
        dois = resolve_dois(r.lists, works, r.papers, source, alternates, throttled, budget, direction)
        r = settle(st, f"dois{name}", r, dois.withColumn("seq", F.coalesce("first", "ref_id")).drop("paper_id", "first"))
        titles = resolve_titles(r.lists, candidates, source, alternates, direction)
        return settle(st, f"titles{name}", r, titles.withColumn("seq", F.col("ref_id")).drop("work_id"))

    r = round_("0", r)
    if assured:
        before = status_counts(r.lists).get("resolved", 0)
        checked, linked, _ = verify(r.lists, r.papers, r.edges)
        r = Resolution(r.papers, st.save("verified", checked), st.save("linked", linked), r.new_papers, r.counts, r.statuses)
        r.counts["verified"] = status_counts(r.lists).get("resolved", 0) - before
        r = round_("1", r)
    r.statuses = status_counts(r.lists)
    return r


def apply_status(lists: DataFrame, result: DataFrame) -> DataFrame:
    """``lists`` with (ref_id, status[, paper_id]) of the result."""
    paper = F.col("paper_id") if "paper_id" in result.columns else F.lit(None).cast("long")
    r = result.select(F.col("ref_id").alias("id"), F.col("status").alias("__s"), paper.alias("__p"))
    out = lists.join(r, "id", "left")
    return out.withColumn("resolved_paper_id", F.coalesce("resolved_paper_id", "__p")).withColumn("status", F.coalesce("__s", "status")).select(*lists.columns)


def verify(lists: DataFrame, papers: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists, edges, still missing): references whose DOI is a paper by now are linked; unusable DOIs are errors."""
    open_ = lists.where("ref_doi is not null and status <> 'resolved'").withColumn("k", normalise_doi("ref_doi"))
    p = papers.where("doi is not null").groupBy(F.lower("doi").alias("k")).agg(F.min("id").alias("paper_id"))
    found = open_.join(p, "k", "left")
    status = F.when(F.col("k").isNull(), "fetch_error").when(F.col("paper_id").isNotNull(), "resolved").otherwise(F.col("status"))
    result = found.select(F.col("id").alias("ref_id"), "paper_id", status.alias("status"))
    pairs = found.where("paper_id is not null").select(F.col("paper_id").alias("child_paper_id"), "parent_paper_id")
    return apply_status(lists, result), add_edges(edges, pairs), found.where("paper_id is null").select("ref_doi", "ref_title", "parent_paper_id")


def retry(lists: DataFrame) -> DataFrame:
    """Failed references set back to pending, for another round of ``resolve_dois`` and ``resolve_titles``."""
    return lists.withColumn("status", F.when(F.col("status").isin("fetch_error", "unresolved_title_failed"), "pending").otherwise(F.col("status")))


def resolve(lists: DataFrame, papers: DataFrame, edges: DataFrame, works: DataFrame, candidates: DataFrame, source: str = "crossref", assured: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(lists, edges) of ``expand``."""
    r = expand(lists, papers, edges, works, candidates, source, assured, **options)
    return r.lists, r.edges


def backfill(papers: DataFrame, works: DataFrame, order: tuple[str, ...] = ("zotero", "openalex", "crossref", "semantic_scholar")) -> DataFrame:
    """Papers whose empty abstract takes the first source's that has one, by DOI; others are not touched."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    w = works.where(~is_blank("abstract")).select(normalise_doi("doi").alias("k"), "abstract", rank.alias("r")).where("k is not null and r > 0")
    best = w.groupBy("k").agg(F.min_by("abstract", "r").alias("__a"))
    out = papers.withColumn("k", normalise_doi("doi")).join(best, "k", "left")
    return out.withColumn("abstract", F.when(is_blank("abstract"), F.coalesce("__a", "abstract")).otherwise(F.col("abstract"))).select(*papers.columns)


def backfill_chain(papers: DataFrame, works: DataFrame, candidates: DataFrame, source: str = "crossref", alternates: bool = True, batch: bool = True, throttled: tuple[str, ...] = ()) -> DataFrame:
    """Papers with empty abstracts filled, by DOI from the sources in the order of asking, and without a DOI by title.

    candidates: ref_id (the paper's id), work_id, work_title, work_year, rank, source, doi, abstract. The first title that
    is similar enough gives its abstract, its title as the source has it, and its DOI unless another paper has that.
    Papers that have an abstract are not touched, so a second run changes nothing.
    """
    out = backfill(papers, works, tuple(asked_for_abstracts(source, alternates, batch, throttled)))
    lacking = is_blank("abstract") & is_blank("doi") & F.col("title").isNotNull()
    rows = papers.where(lacking).select(F.col("id").alias("ref_id"), "title", "year")
    sources = [s for s in BACKFILL_TITLES if s not in throttled]
    asked = title_candidates(candidates, sources if alternates else sources[:1])
    hit = listed_title_match(rows.join(asked.select("ref_id", "work_id", "work_title", "work_year", "rank"), "ref_id")).select("ref_id", "work_id")
    found = latest(asked.join(hit, ["ref_id", "work_id"], "left_semi"), ["ref_id"], -F.xxhash64("rank"))
    found = found.select(F.col("ref_id").alias("id"), F.trim(F.coalesce("abstract", F.lit(""))).alias("__a"), F.trim(F.coalesce("work_title", F.lit(""))).alias("__t"), normalise_doi("doi").alias("__d"))
    taken = papers.where("doi is not null").select(normalise_doi("doi").alias("__d")).distinct()
    free = latest(found.where("__d is not null").join(taken, "__d", "left_anti"), ["__d"], -F.col("id")).select("id", F.col("__d").alias("__doi"))  # of two papers the first takes a DOI
    out = out.join(found.drop("__d").join(free, "id", "left"), "id", "left")
    filled = {"abstract": F.when(is_blank("abstract"), F.coalesce(F.nullif("__a", F.lit("")), F.col("abstract"))).otherwise(F.col("abstract")), "title": F.coalesce(F.nullif("__t", F.lit("")), F.col("title")), "doi": F.coalesce("doi", "__doi")}
    return out.withColumns(filled).select(*papers.columns)


def coverage(papers: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: papers, those without abstract or title, and resolved references to papers without abstract or title."""
    lacking = papers.where(is_blank("abstract") | is_blank("title")).select(F.col("id").alias("resolved_paper_id"), is_blank("abstract").alias("__a"), is_blank("title").alias("__t"))
    refs = lists.where("status = 'resolved'").join(lacking, "resolved_paper_id").agg(F.count_if("__a").alias("resolved_missing_abstract"), F.count_if("__t").alias("resolved_missing_title"))
    one = papers.agg(F.count("*").alias("papers_total"), F.count_if(is_blank("abstract")).alias("papers_missing_abstract"), F.count_if(is_blank("title")).alias("papers_missing_title"))
    return one.crossJoin(F.broadcast(refs))  # one row each


def log_run(runs: DataFrame, direction: str, source: str, seed_count: int, counts: dict[str, int], note: str | None = None) -> DataFrame:
    """``runs`` with a row for one harvest or resolution; a run that a source's limit ended says so in its note."""
    row = {"direction": direction, "source": source, "seed_count": seed_count, "note": note, **{k: counts.get(k, 0) for k in ("references_harvested", "new_papers", "edges", "api_calls")}}
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema if f.name in row)
    new = runs.sparkSession.createDataFrame([row], fields)
    for f in runs.schema:
        if f.name not in new.columns and f.name != "id":
            new = new.withColumn(f.name, F.current_timestamp() if f.name in ("started_at", "finished_at") else F.lit(None).cast(f.dataType))
    return runs.unionByName(with_ids(runs, new, ["direction"]).select(*runs.columns))


def closure(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(paper_id, depth) reachable from the start papers by at most ``depth`` edges from parent to child."""
    seen = start.select(F.col("id").alias("paper_id")).distinct().withColumn("depth", F.lit(0))
    last = seen
    for d in range(1, depth + 1):
        step = last.select(F.col("paper_id").alias("parent_paper_id")).join(edges.select("parent_paper_id", "child_paper_id"), "parent_paper_id")
        last = step.select(F.col("child_paper_id").alias("paper_id")).distinct().join(seen.select("paper_id"), "paper_id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(last)
    return seen
