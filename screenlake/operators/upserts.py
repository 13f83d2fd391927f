"""New snapshots from old ones: every function is pure, ``store`` writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.text import normalise_authors, normalise_keywords, publication_title
from screenlake.schemas import LABELS
from screenlake.stages import numbered


def latest(rows: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """The row of the highest ``order`` for each key. Aggregated before the shuffle, so hot keys are no trouble."""
    o = F.col(order) if isinstance(order, str) else order
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max_by(whole, o).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None, keep_id: bool = True) -> DataFrame:
    """Rows of ``new`` take the place of ``old`` rows of the same key; the last by ``order`` wins inside ``new``.

    With an ``id`` column, a replaced row keeps its id (``keep_id``) and other rows get the next free ones.
    """
    columns = [c for c in old.columns if c != "id"] if "id" in old.columns else old.columns
    fresh = latest(new, key, order).select(*columns) if order else new.select(*columns).dropDuplicates(key)
    rest = old.join(fresh.select(*key), key, "left_anti").select(*old.columns)
    if "id" not in old.columns:
        return rest.unionByName(fresh)
    if keep_id:
        ids = old.select(*key, "id").dropDuplicates(key)
        fresh = fresh.join(ids, key, "left")
    else:
        fresh = fresh.withColumn("id", F.lit(None).cast("long"))
    known, unknown = fresh.where("id is not null"), fresh.where("id is null").drop("id")
    return rest.unionByName(known.select(*old.columns)).unionByName(with_ids(old, unknown, key).select(*old.columns))


def with_ids(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with ids after the highest of ``old``, in the order of ``order``."""
    start = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    return numbered(new, order).withColumn("id", (F.col("nth") + start + 1).cast("long")).drop("nth")


def get_or_create(old: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``old`` plus a row for each key of ``wanted`` that it has not; other columns come from ``wanted``, else null."""
    missing = wanted.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    for f in old.schema:
        if f.name not in missing.columns and f.name != "id":
            missing = missing.withColumn(f.name, F.lit(None).cast(f.dataType))
    return old.unionByName(with_ids(old, missing, key).select(*old.columns))


def link(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore of junction rows."""
    return old.unionByName(new.select(*old.columns)).distinct()


def entries_to_papers(entries: DataFrame) -> DataFrame:
    """Paper columns of parsed entries (entry_type, cite_key, fields, seq); ``error`` where the year is missing or no number."""
    f = lambda k: F.element_at("fields", k)
    text = lambda k: F.trim(F.coalesce(f(k), F.lit("")))
    year = F.trim(f("year")).try_cast("int")
    return entries.select(
        "seq", "cite_key", text("title").alias("title"), normalise_authors(f("author")).alias("authors"), year.alias("year"), text("abstract").alias("abstract"),
        publication_title(F.col("entry_type"), f("journal"), f("booktitle"), f("publisher")).alias("publication_title"), F.nullif(f("doi"), F.lit("")).alias("doi"),
        normalise_keywords(f("keywords")).alias("keywords"), F.when(f("year").isNull(), "Missing year").when(year.isNull(), F.concat(F.lit("bad year: "), f("year"))).alias("error"))


def upsert_papers(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Papers by exact DOI: a row of a known DOI overwrites all fields, the last of a batch wins; rows without DOI are always inserted; rows with ``error`` are left out."""
    good = rows.where("error is null") if "error" in rows.columns else rows
    fields = [c for c in ("title", "authors", "year", "abstract", "publication_title", "doi", "keywords") if c in rows.columns]
    with_doi = latest(good.where("doi is not null").select("seq", *fields), ["doi"], "seq")
    first = good.where("doi is not null").groupBy("doi").agg(F.min("seq").alias("seq0"))
    ids = papers.where("doi is not null").select("doi", "id")
    with_doi = with_doi.join(first, "doi").join(ids, "doi", "left")
    changed = with_doi.where("id is not null")
    new = with_doi.where("id is null").withColumn("seq", F.col("seq0")).select("seq", *fields).unionByName(good.where("doi is null").select("seq", *fields))
    new = with_ids(papers, new, ["seq"])
    other = [c for c in papers.columns if c not in fields and c != "id"]
    kept = papers.join(changed.select("id"), "id", "left_anti")
    changed = papers.select("id", *other).join(changed.select("id", *fields), "id")
    for c in other:
        new = new.withColumn(c, F.lit(None).cast(papers.schema[c].dataType))
    return kept.unionByName(changed.select(*papers.columns)).unionByName(new.select(*papers.columns))


def insert_paper(papers: DataFrame, row: DataFrame) -> DataFrame:
    """A paper whose DOI is known stays as it is; else it is inserted."""
    fresh = row.withColumn("doi", F.nullif(F.trim("doi"), F.lit(""))).join(papers.where("doi is not null").select("doi"), "doi", "left_anti")
    return upsert_papers(papers, fresh.withColumn("seq", F.lit(0).cast("long")) if "seq" not in fresh.columns else fresh)


RUN_KEY = ["method", "model", "model_version", "prompt_id", "temperature", "run_index"]


def run_keys(records: DataFrame) -> DataFrame:
    """Eval records with defaults for missing parts of the run's key."""
    fill = {"method": "unknown", "model": "unknown", "model_version": "", "prompt_id": "n/a"}
    out = records
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    return out.withColumn("temperature", F.coalesce("temperature", F.lit(0.0))).withColumn("run_index", F.coalesce("run", F.lit(1)))


def invalid_labels(records: DataFrame, col: str = "decision") -> DataFrame:
    return records.where(F.col(col).isNull() | ~F.col(col).isin(*LABELS))


def ingest_evals(runs: DataFrame, evals: DataFrame, records: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """New (eval_runs, evals, counts). A decision outside the three labels is an error and nothing is taken."""
    bad = invalid_labels(records).limit(1).collect()
    if bad:
        raise ValueError(f"Invalid decision label: {bad[0]['decision']!r}")
    keyed = run_keys(records)
    runs = get_or_create(runs, keyed.select(*RUN_KEY), RUN_KEY)
    rows = keyed.join(runs.select(F.col("id").alias("run_id"), *RUN_KEY), RUN_KEY)
    fields = [c for c in evals.columns if c in rows.columns and c not in ("id", "created_at")]
    new = rows.select(*fields, order)
    for c in evals.columns:
        if c not in new.columns and c != "id":
            new = new.withColumn(c, F.lit(None).cast(evals.schema[c].dataType))
    counts = {"runs": keyed.select(*RUN_KEY).distinct().count(), "evals": records.count()}
    return runs, upsert(evals, new, ["run_id", "paper_id"], order), counts


def rebuild_relevance_evals(evals: DataFrame, runs: DataFrame, methods: dict[str, str], thresholds: dict[str, float]) -> DataFrame:
    """Rows of relevance_evals from evals, with a fixed threshold for each method; methods without one are left out."""
    pairs = [(m, methods.get(m, m), thresholds[methods.get(m, m)]) for m in {*methods, *thresholds} if methods.get(m, m) in thresholds]
    table = F.broadcast(evals.sparkSession.createDataFrame(pairs, "method string, key string, threshold double"))  # one row for each method
    r = runs.select(F.col("id").alias("run_id"), "method").join(table, "method")
    e = evals.join(r, "run_id")
    return e.select("paper_id", F.col("key").alias("method"), "score", F.col("decision").isin("in-scope", "hybrid").alias("is_relevant"), "threshold", F.to_json(F.struct("decision", "score", "run_id")).alias("details"))


#: The study's thresholds and names of methods.
STUDY_METHODS = {"baseline_keyword": "keyword", "baseline_bm25": "bm25", "baseline_hybrid": "hybrid", "embedding-octen-8b": "embedding"}
STUDY_THRESHOLDS = {"keyword": 0.22, "bm25": 0.52, "hybrid": 0.55, "embedding": 0.62}
