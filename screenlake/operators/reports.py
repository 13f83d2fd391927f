"""Fixed reports over the tables of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.text import binary_class, source_category


def by_source(sources: DataFrame, links: DataFrame, zeros: bool = False) -> DataFrame:
    """Distinct papers of each source, most first; ``zeros``: also sources without papers, by name."""
    n = links.groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("paper_id").alias("n_papers"))
    if zeros:
        return sources.join(n, "id", "left").select(F.col("name").alias("source"), F.coalesce("n_papers", F.lit(0)).alias("n_papers")).orderBy("source")
    return sources.join(n, "id").groupBy(F.col("name").alias("source")).agg(F.sum("n_papers").alias("n_papers")).orderBy(F.desc("n_papers"), "source")


def by_category(sources: DataFrame, links: DataFrame) -> DataFrame:
    """category, n_links (sum over its sources), n_papers (distinct)."""
    named = links.join(sources.select(F.col("id").alias("source_id"), source_category("name").alias("category")), "source_id")
    pairs = named.select("category", "source_id", "paper_id").distinct()
    return pairs.groupBy("category").agg(F.count("*").alias("n_links"), F.count_distinct("paper_id").alias("n_papers")).orderBy(F.desc("n_papers"), "category")


def papers_total(links: DataFrame) -> DataFrame:
    return links.agg(F.count_distinct("paper_id").alias("n"))


def multi_source(links: DataFrame) -> DataFrame:
    """Papers found by more than one source."""
    per = links.groupBy("paper_id").agg(F.count_distinct("source_id").alias("k")).where("k > 1")
    return per.agg(F.count("*").alias("n"))


def top_sourced(links: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` papers with most sources, ties by id."""
    return links.groupBy("paper_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "paper_id").limit(k)


def by_year(papers: DataFrame, unknown: bool = True) -> DataFrame:
    rows = papers if unknown else papers.where("year > 0")
    return rows.groupBy("year").agg(F.count("*").alias("n_papers")).orderBy("year")


def relevance(papers: DataFrame) -> DataFrame:
    return papers.groupBy(F.coalesce("relevance_class", F.lit("unlabeled")).alias("relevance_class")).agg(F.count("*").alias("n_papers")).orderBy(F.desc("n_papers"), "relevance_class")


def binary(papers: DataFrame) -> DataFrame:
    return papers.groupBy(binary_class("relevance_class").alias("binary_class")).agg(F.count("*").alias("n_papers"))


def statuses(lists: DataFrame) -> DataFrame:
    return lists.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def edge_totals(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("child_paper_id").alias("discovered"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def relevance_totals(papers: DataFrame, evals: DataFrame) -> DataFrame:
    """One row: total, evaluated, relevant, irrelevant, unevaluated, last_evaluated."""
    last = evals.agg(F.max("evaluated_at").alias("last_evaluated"))
    n = papers.agg(F.count("*").alias("total_papers"), F.count("is_relevant").alias("evaluated"), F.count_if(F.col("is_relevant")).alias("relevant"), F.count_if(~F.col("is_relevant")).alias("irrelevant"), F.count_if(F.col("is_relevant").isNull()).alias("unevaluated"))
    return n.crossJoin(F.broadcast(last))  # one row each


def by_method(evals: DataFrame) -> DataFrame:
    return evals.groupBy("method", "decision").agg(F.count("*").alias("n_papers")).orderBy("method", "decision")


def consensus_labels(gold: DataFrame) -> DataFrame:
    return gold.groupBy("consensus_label").agg(F.count("*").alias("n_papers"))


def dashboard(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def provenance(papers: DataFrame, sources: DataFrame, paper_sources: DataFrame, queries: DataFrame, paper_queries: DataFrame, edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, found, title, sources, queries, parents, children of each of ``papers``, or of the ids ``asked`` for, known or
    not. Parents and children come with title (null where the paper is gone), depth and time, by id. Every arm is
    aggregated before it is joined."""
    ids = (asked if asked is not None else papers).select("id")
    titles = papers.select("id", "title")
    s = paper_sources.join(sources.select(F.col("id").alias("source_id"), "name"), "source_id").groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("sources"))
    q = paper_queries.join(queries.select(F.col("id").alias("query_id"), "platform", "query_text"), "query_id").groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("query_id", "platform", "query_text"))).alias("queries"))
    time = F.col("discovered_at") if "discovered_at" in edges.columns else F.lit(None).cast("timestamp")
    named = edges.select("child_paper_id", "parent_paper_id", "depth", time.alias("discovered_at"))

    def arm(me: str, other: str, name: str) -> DataFrame:
        near = named.join(ids.select(F.col("id").alias(me)), me, "left_semi").join(titles.select(F.col("id").alias(other), "title"), other, "left")
        return near.groupBy(F.col(me).alias("id")).agg(F.sort_array(F.collect_set(F.struct(F.col(other).alias("paper_id"), "title", "depth", "discovered_at"))).alias(name))

    out = ids.join(titles.withColumn("found", F.lit(True)), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "title")
    for part in (s.join(ids, "id", "left_semi"), q.join(ids, "id", "left_semi"), arm("child_paper_id", "parent_paper_id", "parents"), arm("parent_paper_id", "child_paper_id", "children")):
        out = out.join(part, "id", "left")
    return out
