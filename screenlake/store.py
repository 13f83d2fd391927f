"""A project's tables as snapshots: a new version is complete before it becomes the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.schemas import TABLES


class Store:
    """Each version is a file that names the folder of each table; folders are never changed after they are written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def versions(self) -> list[int]:
        fs, p, _ = self._fs(f"{self.root}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def folders(self, version: int | None = None) -> dict[str, str]:
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema("name string, folder string").json(f"{self.root}/versions/{version or known[-1]}").collect()
        return {r["name"]: r["folder"] for r in rows}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folder = self.folders(version).get(name)
        schema = TABLES[name].schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in TABLES}

    def commit(self, new: dict[str, DataFrame], check: bool = True) -> int:
        """Writes the tables given and makes them current in one step, if their keys, references and values hold."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        folders = self.folders()
        for name, df in new.items():
            schema = TABLES[name].schema
            folder = f"data/{name}/{version}-{uuid.uuid4().hex[:8]}"
            df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(f"{self.root}/{folder}")
            folders[name] = folder
        if check:
            held = {n: self.spark.read.schema(TABLES[n].schema).parquet(f"{self.root}/{f}") for n, f in folders.items()}
            if faults := validate(held, set(new)):
                raise ValueError("; ".join(faults))
        temporary = f"{self.root}/versions/_{version}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame(sorted(folders.items()), "name string, folder string").coalesce(1).write.json(temporary)
        fs, source, jvm = self._fs(temporary)
        if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{version}")):
            raise RuntimeError(f"version {version} exists by now: another writer was first")
        return version

    def run(self, step: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
        """Commits what ``step`` makes of the current tables; nothing changes if it fails."""
        return self.commit(step(self.tables()))


def validate(tables: dict[str, DataFrame], only: set[str] | None = None) -> list[str]:
    """Faults of keys, unique columns, values and references."""
    out = []
    for name, df in tables.items():
        if only is not None and name not in only:
            continue
        t = TABLES[name]
        for key in (t.key, *t.unique):
            named = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]))
            if named.groupBy(*key).count().where("count > 1").limit(1).count():
                out.append(f"{name}: {', '.join(key)} is not unique")
        for col, allowed in t.enums:
            if df.where(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).limit(1).count():
                out.append(f"{name}: {col} has a value outside {allowed}")
        for f in t.schema:
            if not f.nullable and df.where(F.col(f.name).isNull()).limit(1).count():
                out.append(f"{name}: {f.name} is null")
        for col, to in t.refers:
            if to in tables and df.where(F.col(col).isNotNull()).join(tables[to].select(F.col("id").alias(col)), col, "left_anti").limit(1).count():
                out.append(f"{name}: {col} names no row of {to}")
    return out


#: Version, name, and what is added: table, column and type. Every step can be run again.
MIGRATIONS: tuple[tuple[int, str, tuple[tuple[str, str, str], ...]], ...] = (
    (1, "papers_notes", (("papers", "notes", "string"),)),
    (2, "references", (("papers", "pdf_url", "string"), ("reference_lists", "", ""), ("snowball_runs", "", ""))),
    (3, "reference_status", (("reference_lists", "status", "string"),)),
    (4, "relevance_class", (("papers", "relevance_class", "string"), ("relevance_evals", "decision", "string"))),
    (5, "analysis_runs", (("analysis_runs", "", ""),)),
    (6, "paper_embeddings", (("paper_embeddings", "", ""),)),
)


def migrate(tables: dict[str, DataFrame], spark: SparkSession, applied: set[int] = frozenset(), up_to: int | None = None) -> tuple[dict[str, DataFrame], list[int]]:
    """Tables with missing tables and columns added, and the versions that were applied now. Every reference starts as
    pending; the resolution marks those that have their paper."""
    out, done = dict(tables), []
    for version, _, steps in MIGRATIONS:
        if version in applied or up_to is not None and version > up_to:
            continue
        for table, column, kind in steps:
            if table not in out:
                out[table] = spark.createDataFrame([], TABLES[table].schema)
            elif column and column not in out[table].columns:
                out[table] = out[table].withColumn(column, F.lit("pending" if column == "status" else None).cast(kind))
        done.append(version)
    return out, done


#: Parts of a platform's name and the source that it stands for, in the order of looking.
PLATFORMS = (("acm", "ACM"), ("ieee", "IEEE"), ("springer", "Springer"), ("semantic", "Semantic Scholar"), ("scholar", "Semantic Scholar"))


def from_first_layout(papers: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """Tables of the present layout from the first one, where a paper had one query: junctions, sources by platform."""
    if "query_id" not in papers.columns:
        raise ValueError("papers has no query_id: it is not of the first layout")
    platform = F.lower("platform")
    # each run of letters begins with a capital
    name = F.array_join(F.transform(F.regexp_extract_all("platform", F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")
    for part, source in reversed(PLATFORMS):
        name = F.when(platform.contains(part), source).otherwise(name)
    links = papers.where("query_id is not null").select(F.col("id").alias("paper_id"), "query_id").distinct()
    named = queries.select(F.col("id").alias("query_id"), name.alias("name"))
    fixed = papers.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(s for _, s in PLATFORMS)] + [("snowball",)], "name string")
    names = fixed.union(named.select("name")).distinct()
    from screenlake.stages import numbered

    sources = numbered(names, ["name"]).select((F.col("nth") + 1).alias("id"), "name", F.lit(None).cast("string").alias("description"))
    by_source = links.join(named, "query_id").join(sources, "name").select("paper_id", F.col("id").alias("source_id")).distinct()
    return {"papers": papers.drop("query_id"), "queries": queries, "sources": sources, "paper_queries": links, "paper_sources": by_source}
