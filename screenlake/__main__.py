"""Command line: python -m screenlake PROJECT COMMAND ...: a thin layer over Engine."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from screenlake.operators import citations, metrics, reports, scoring, upserts
from screenlake.plans.engine import Engine
from screenlake.sources import bibtex, tables
from screenlake.stages import numbered
from screenlake.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="screenlake")
    p.add_argument("project", help="folder of the project's tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "import-bibtex": ["path", "--source", "--query"], "import-csv": ["path", "--layout", "--source", "--query"], "evaluate": ["--method", "--threshold"], "ingest-evals": ["path"],
        "ground-truth": ["path"], "metrics": [], "runs": [], "sheet": ["path"], "unresolved": ["path"], "coverage": [], "verify": [], "analyse": ["name", "--kinds", "--plots"],
        "snowball": ["references", "works", "--candidates", "--seeds", "--queries", "--direction", "--source"], "resolve": ["works", "--candidates", "--source"], "backfill": ["works", "--candidates", "--source"], "paper": ["id", "--method"],
        "screen": ["answers", "model", "--prompt"], "judge": ["answers", "model", "--run"], "bootstrap": ["--method", "--rounds"], "derive-threshold": ["--method", "--criterion"], "baseline": ["path", "--method", "--threshold"], "tool": ["name", "--arguments"], "sql": ["statement"], "stats": [],
    }.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
    return p


def show(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def take_papers(e: Engine, found, source: str | None, query: str | None) -> None:
    """Imports paper rows, with links to a source and a query where these are named."""
    before = e.t("papers")
    after = upserts.upsert_papers(before, found)
    e.store.commit({"papers": after})
    papers = e.t("papers")
    good = found.where("error is null")
    named = papers.where("doi is not null").join(good.select("doi"), "doi", "left_semi").select("id")
    fresh = papers.join(before.select("id"), "id", "left_anti").select("id")
    ids = named.union(fresh).distinct()
    changed = {}
    for name, table, link, key, extra in ((source, "sources", "paper_sources", "name", {}), (query, "queries", "paper_queries", "query_text", {"platform": "unknown"})):
        if name:
            wanted = e.spark.createDataFrame([{key: name, **extra}])
            kept = upserts.get_or_create(e.t(table), wanted.selectExpr("*", "current_timestamp() as run_at") if table == "queries" else wanted, [key])
            row = kept.where(kept[key] == name).select("id").first()["id"]
            changed[table] = kept
            changed[link] = upserts.link(e.t(link), ids.selectExpr("id as paper_id", f"{row}L as {link.split('_')[1][:-1].replace('querie', 'query')}_id"))
    if changed:
        e.store.commit(changed)
    print(json.dumps({"rows": found.count(), "skipped": found.where("error is not null").count()}))


#: Rows of the files that stand for services: JSON lines.
REFERENCES = "parent_doi string, ref_index int, doi string, title string, authors string, year int, unstructured string"
WORKS = "doi string, title string, authors string, year int, abstract string, publication_title string, pdf_url string, source string"
CANDIDATES = "ref_id long, work_id long, work_title string, work_year int, rank int, source string, doi string, authors string, abstract string, publication_title string, pdf_url string"


def rows(e: Engine, path: str | None, schema: str):
    return e.spark.read.schema(schema).json(path) if path else e.spark.createDataFrame([], schema)


def answers(path: str):
    """A model out of a file of answers (title, answer): what a client has asked for beforehand."""
    with open(path, encoding="utf-8") as f:
        known = {r["title"]: r["answer"] for r in map(json.loads, filter(str.strip, f))}

    def model(system: str, title: str, abstract: str) -> str:
        return known[title] if isinstance(known[title], str) else json.dumps(known[title])

    return model


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("screenlake").getOrCreate()
    e = Engine(spark, Store(spark, a.project))
    try:
        if a.command == "import-bibtex":
            take_papers(e, bibtex.papers(bibtex.read(spark, a.path)), a.source, a.query)
        elif a.command == "import-csv":
            take_papers(e, tables.read_csv(spark, a.path, a.layout or "acm"), a.source, a.query)
        elif a.command == "evaluate":
            show(e.evaluate(a.method or "hybrid", float(a.threshold) if a.threshold else None).groupBy("relevance_class").count())
        elif a.command == "ingest-evals":
            records = numbered(tables.read_evals(spark, a.path), ["paper_id", "eval_id"], "seq")
            runs, evals, counts = upserts.ingest_evals(e.t("eval_runs"), e.t("evals"), records)
            e.store.commit({"eval_runs": runs, "evals": evals}, check=False)
            print(json.dumps(counts))
        elif a.command == "ground-truth":
            e.label(tables.read_ground_truth(spark, a.path))
            print(json.dumps({"kappa": e.kappa()}))
        elif a.command == "metrics":
            show(metrics.summary(e.t("eval_runs"), e.t("evals"), e.t("ground_truth_consensus")))
        elif a.command == "runs":
            show(metrics.runs_with_counts(e.t("eval_runs"), e.t("evals")))
        elif a.command == "sheet":
            tables.write_csv(tables.annotator_sheet(e.t("papers")), a.path)
        elif a.command == "unresolved":
            tables.write_csv(tables.unresolved_sheet(e.t("reference_lists")), a.path)
        elif a.command == "coverage":
            show(citations.coverage(e.t("papers"), e.t("reference_lists")))
        elif a.command == "verify":
            show(e.verify())
        elif a.command == "analyse":
            print(e.analyse(a.name, tuple((a.kinds or "corpus,relevance,snowball,evaluation").split(",")), a.plots))
        elif a.command == "snowball":
            print(json.dumps(e.snowball(rows(e, a.references, REFERENCES), rows(e, a.works, WORKS), rows(e, a.candidates, CANDIDATES), citations.parse_ids(a.seeds), citations.parse_ids(a.queries), a.direction or "backward", a.source or "crossref")))
        elif a.command == "resolve":
            print(json.dumps(e.resolve(rows(e, a.works, WORKS), rows(e, a.candidates, CANDIDATES), a.source or "crossref")))
        elif a.command == "backfill":
            show(e.backfill(rows(e, a.works, WORKS), rows(e, a.candidates, CANDIDATES), a.source or "crossref"))
        elif a.command == "paper":
            show(scoring.evaluate_paper(e.t("papers"), int(a.id), a.method or "hybrid"))
        elif a.command == "screen":
            print(json.dumps(e.screen(answers(a.answers), a.model, a.prompt or "P1")))
        elif a.command == "judge":
            show(e.judge(answers(a.answers), a.model, run_id=int(a.run) if a.run else None))
        elif a.command == "bootstrap":
            show(e.bootstrap(a.method or "hybrid", int(a.rounds or 1000)))
        elif a.command == "derive-threshold":
            print(json.dumps({"threshold": e.derive_threshold(a.method or "hybrid", a.criterion or "f1")}))
        elif a.command == "baseline":
            e.export_baseline(a.path, a.method or "hybrid", float(a.threshold) if a.threshold else None)
        elif a.command == "tool":
            print(json.dumps(e.call(a.name, json.loads(a.arguments or "{}")), default=str))
        elif a.command == "sql":
            show(e.execute_select(a.statement))
        elif a.command == "stats":
            show(reports.relevance_totals(e.t("papers"), e.t("relevance_evals")))
    except ValueError as fault:
        print(f"error: {fault}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
