"""Lists, point lookups and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 500
SUMMARY = ("id", "title", "authors", "year", "doi")


def whole(value, name: str, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer")
    if least is not None and value < least:
        raise ValueError(f"{name} must be at least {least}")
    return value


def text(value, name: str, empty: bool = False) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{name} must be a string")
    if not empty and not value.strip():
        raise ValueError(f"{name} must not be empty")
    return value.strip()


def names(value) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, list):
        raise ValueError("source_names must be a list of strings")
    return list(dict.fromkeys(text(v, "source name") for v in value))


def limited(limit) -> int:
    return min(whole(limit, "limit", 1), MOST)


def newest(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("created_at"), F.desc("id"))


def list_papers(papers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Summary columns, newest first."""
    return newest(papers).offset(whole(offset, "offset", 0)).limit(limited(limit)).select(*[c for c in SUMMARY if c in papers.columns])


def get_paper(papers: DataFrame, paper_id: int) -> DataFrame:
    return papers.where(F.col("id") == whole(paper_id, "paper_id"))


def get_by_doi(papers: DataFrame, doi: str) -> DataFrame:
    """DOI as written, trimmed; case counts."""
    return papers.where(F.col("doi") == text(doi, "doi"))


def search(papers: DataFrame, words: str, limit: int = 50, columns: tuple[str, ...] = ("title", "abstract", "authors")) -> DataFrame:
    """Substring in any of the columns, case apart; % and _ stay wildcards, a backslash is itself."""
    pattern = "%" + text(words, "text").lower().replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).like(pattern), F.lit(False))
    return newest(papers.where(hit)).limit(limited(limit)).select(*[c for c in SUMMARY if c in papers.columns])


def by_queries(papers: DataFrame, paper_queries: DataFrame, query_ids: list[int]) -> DataFrame:
    """Distinct papers of the queries, by id."""
    ids = paper_queries.where(F.col("query_id").isin(query_ids)).select(F.col("paper_id").alias("id")).distinct()
    return papers.join(ids, "id", "left_semi").orderBy("id")


def by_relevance(papers: DataFrame, which: str) -> DataFrame:
    """relevant, irrelevant, unevaluated or all."""
    flags = {"relevant": F.col("is_relevant"), "irrelevant": ~F.col("is_relevant"), "unevaluated": F.col("is_relevant").isNull(), "all": F.lit(True)}
    if which not in flags:
        raise ValueError(f"unknown filter {which!r}")
    return papers.where(flags[which])


def embedding(embeddings: DataFrame, paper_id: int, model: str) -> DataFrame:
    return embeddings.where((F.col("paper_id") == paper_id) & (F.col("model_name") == model)).select("embedding")


def analyses(runs: DataFrame) -> DataFrame:
    return runs.select("id", "name", "generated_at").orderBy("id")


def dois(papers: DataFrame, ids: list[int] | None = None) -> DataFrame:
    rows = papers.where("doi is not null and doi <> ''")
    return (rows.where(F.col("id").isin(ids)) if ids else rows).select("doi").orderBy("doi")


def detail(papers: DataFrame, sources: DataFrame, paper_sources: DataFrame, queries: DataFrame, paper_queries: DataFrame) -> DataFrame:
    """Papers with their sources and platforms as sorted comma lists."""
    s = paper_sources.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy(F.col("paper_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("source_names"))
    q = paper_queries.join(queries.select(F.col("id").alias("query_id"), "platform"), "query_id").groupBy(F.col("paper_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"))
    return papers.join(s, "id", "left").join(q, "id", "left")


def edge_titles(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with both titles."""
    t = papers.select("id", "title")
    child, parent = t.toDF("child_paper_id", "child_title"), t.toDF("parent_paper_id", "parent_title")
    return edges.join(child, "child_paper_id").join(parent, "parent_paper_id").select("child_paper_id", "child_title", "parent_paper_id", "parent_title", "depth")


def neighbours(edges: DataFrame, paper_id: int) -> DataFrame:
    """Parents and children of a paper, each once."""
    up = edges.where(F.col("child_paper_id") == paper_id).select(F.col("parent_paper_id").alias("paper_id"))
    down = edges.where(F.col("parent_paper_id") == paper_id).select(F.col("child_paper_id").alias("paper_id"))
    return up.union(down).distinct()
