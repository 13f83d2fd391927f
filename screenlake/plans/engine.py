"""One project as an object: its tables, and the named tools with their arguments."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.topic import STUDY, Topic
from screenlake.operators import citations, lookups, metrics, reports, scoring, screening, upserts
from screenlake.plans import sql as readonly
from screenlake.sources.tables import analysis_json, plot_bars, write_records
from screenlake.stages import Stages
from screenlake.store import Store

_TEXT, _INT = {"type": "string"}, {"type": "integer"}

#: Tools: name -> (what it does, argument types, arguments that must be given).
TOOLS: dict[str, tuple[str, dict[str, dict], tuple[str, ...]]] = {
    "list_papers": ("Papers, newest first", {"limit": _INT, "offset": _INT}, ()),
    "get_paper": ("One paper by id", {"paper_id": _INT}, ("paper_id",)),
    "get_paper_by_doi": ("One paper by DOI", {"doi": _TEXT}, ("doi",)),
    "search_papers": ("Papers with a text in title, abstract or authors", {"text": _TEXT, "limit": _INT}, ("text",)),
    "get_paper_provenance": ("Sources, queries, parents and children of a paper", {"paper_id": _INT}, ("paper_id",)),
    "execute_select": ("Rows of one read-only statement", {"sql": _TEXT}, ("sql",)),
    "insert_paper": ("Adds a paper unless its DOI is known", {"title": _TEXT, "authors": _TEXT, "year": _INT, "abstract": _TEXT, "publication_title": _TEXT, "doi": _TEXT, "keywords": _TEXT, "source_names": {"type": "array", "items": _TEXT}}, ("title", "authors", "year", "abstract", "publication_title")),
    "store_analysis": ("Keeps a JSON result under a name", {"name": _TEXT, "result_json": _TEXT}, ("name", "result_json")),
    "list_analysis": ("Results kept so far", {}, ()),
    "get_prewritten_sql_statements": ("Prepared statements", {"statement_name": _TEXT}, ()),
}


def schema(name: str) -> dict:
    what, properties, required = TOOLS[name]
    return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}}


@dataclass
class Engine:
    """Reads the store's current version; tools that change something commit a new one."""

    spark: SparkSession
    store: Store
    topic: Topic = field(default_factory=lambda: STUDY)

    def t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def list_papers(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return lookups.list_papers(self.t("papers"), limit, offset)

    def get_paper(self, paper_id: int) -> DataFrame:
        return lookups.get_paper(self.t("papers"), paper_id)

    def get_paper_by_doi(self, doi: str) -> DataFrame:
        return lookups.get_by_doi(self.t("papers"), doi)

    def search_papers(self, text: str, limit: int = 50) -> DataFrame:
        return lookups.search(self.t("papers"), text, limit)

    def get_paper_provenance(self, paper_id: int) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(lookups.whole(paper_id, "paper_id")).cast("long").alias("id"))
        return reports.provenance(self.t("papers"), self.t("sources"), self.t("paper_sources"), self.t("queries"), self.t("paper_queries"), self.t("snowball_edges"), asked)

    def execute_select(self, sql: str) -> DataFrame:
        return readonly.execute(self.spark, sql, self.store.tables())

    def insert_paper(self, title: str, authors: str, year: int, abstract: str, publication_title: str, doi: str | None = None, keywords: str | None = None, source_names: list[str] | None = None) -> DataFrame:
        row = {k: lookups.text(v, k, k == "abstract") for k, v in (("title", title), ("authors", authors), ("abstract", abstract), ("publication_title", publication_title))}
        row |= {"year": lookups.whole(year, "year", 0), "doi": (doi or "").strip() or None, "keywords": keywords, "seq": 0}
        papers = self.t("papers")
        new = self.spark.createDataFrame([row], "title string, authors string, abstract string, publication_title string, year int, doi string, keywords string, seq bigint")
        known = papers.where(F.col("doi") == row["doi"]).select("id").first() if row["doi"] else None
        after = papers if known else upserts.upsert_papers(papers, new).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        paper_id = known["id"] if known else (papers.agg(F.max("id")).first()[0] or 0) + 1
        changed = {} if known else {"papers": after}
        if names := lookups.names(source_names):
            wanted = self.spark.createDataFrame([(n,) for n in names], "name string")
            sources = upserts.get_or_create(self.t("sources"), wanted, ["name"])
            links = sources.join(wanted, "name").select(F.lit(paper_id).cast("long").alias("paper_id"), F.col("id").alias("source_id"))
            changed |= {"sources": sources, "paper_sources": upserts.link(self.t("paper_sources"), links)}
        if changed:
            self.store.commit(changed)
        return self.get_paper(paper_id)

    def store_analysis(self, name: str, result_json: str) -> DataFrame:
        json.loads(lookups.text(result_json, "result_json"))
        new = self.spark.createDataFrame([(lookups.text(name, "name"), result_json)], "name string, result_json string").withColumn("generated_at", F.current_timestamp())
        self.store.commit({"analysis_runs": upserts.upsert(self.t("analysis_runs"), new, ["name"])})
        return self.list_analysis().where(F.col("name") == name)

    def list_analysis(self) -> DataFrame:
        return lookups.analyses(self.t("analysis_runs"))

    def get_prewritten_sql_statements(self, statement_name: str | None = None) -> DataFrame:
        return self.spark.createDataFrame(list(readonly.prepared(statement_name).items()), "name string, sql string")

    def call(self, name: str, arguments: dict | None = None) -> list[dict]:
        """All rows of a tool; unknown tools or arguments and bad values raise ValueError."""
        if name not in TOOLS:
            raise ValueError(f"unknown tool {name!r}")
        given = dict(arguments or {})
        _, properties, required = TOOLS[name]
        if extra := set(given) - set(properties):
            raise ValueError(f"unknown arguments {sorted(extra)}")
        if missing := [r for r in required if r not in given]:
            raise ValueError(f"missing arguments {missing}")
        return [r.asDict(recursive=True) for r in getattr(self, name)(**given).toLocalIterator()]

    def evaluate(self, method: str = "hybrid", threshold: float | None = None, run: int = 1, store: bool = True, **options) -> DataFrame:
        """Scores and classes of all papers; with ``store`` also relevance_evals, papers and the run's evals."""
        papers = self.t("papers")
        results = scoring.evaluate_corpus(papers, self.t("ground_truth_consensus"), method, threshold, self.topic, **options)
        if store:
            rows = upserts.with_ids(self.t("relevance_evals"), scoring.relevance_rows(results).withColumn("evaluated_at", F.current_timestamp()), ["paper_id"])
            runs, evals, _ = upserts.ingest_evals(self.t("eval_runs"), self.t("evals"), scoring.baseline_records(results, run).withColumn("seq", F.col("paper_id")))
            self.store.commit({"relevance_evals": self.t("relevance_evals").unionByName(rows), "papers": scoring.mark_papers(papers, results), "eval_runs": runs, "evals": evals}, check=False)
        return results

    def label(self, ground_truth: DataFrame) -> DataFrame:
        """Takes labels (paper_id, annotator_id, label, confidence, rationale) and recomputes the consensus. Of two labels of
        one annotator for a paper the last by ``seq`` counts, without that column the greatest by its values."""
        order = F.col("seq") if "seq" in ground_truth.columns else F.struct("label", "confidence", "rationale")
        new = ground_truth.withColumns({"seq": order, "created_at": F.current_timestamp()})
        table = upserts.upsert(self.t("ground_truth"), new, ["paper_id", "annotator_id"], "seq")
        gold = metrics.consensus(table).withColumns({"notes": F.lit(None).cast("string"), "created_at": F.current_timestamp()})
        self.store.commit({"ground_truth": table, "ground_truth_consensus": gold})
        return self.t("ground_truth_consensus")

    def kappa(self, variant: str = "standard") -> float | None:
        """Agreement of all annotators: Cohen's for two, Fleiss' for more."""
        t = self.t("ground_truth")
        row = metrics.cohen_kappa(t).first() or metrics.fleiss_kappa(t, variant=variant).first()
        return row["kappa"] if row else None

    def verify(self) -> DataFrame:
        """Links references whose DOI has become a paper; returns those still missing."""
        lists, edges, missing = citations.verify(self.t("reference_lists"), self.t("papers"), self.t("snowball_edges"))
        missing = Stages(self.spark, "verify").save("missing", missing)
        self.store.commit({"reference_lists": lists, "snowball_edges": edges})
        return missing

    def snowball(self, fetched: DataFrame, works: DataFrame, candidates: DataFrame, seeds: list[int] | None = None, queries: list[int] | None = None, direction: str = "backward", source: str = "crossref", **options) -> dict[str, int]:
        """One expansion: takes in the references of the seeds, resolves them into papers, logs the run."""
        papers, lists, edges = self.t("papers"), self.t("reference_lists"), self.t("snowball_edges")
        start = citations.seeds(papers, self.t("paper_queries"), seeds, queries)
        lists, edges, counts = citations.harvest(start, papers, fetched, lists, edges, direction, source)
        done = counts.first().asDict()
        now = F.current_timestamp()
        self.store.commit({"reference_lists": lists.withColumn("discovered_at", F.coalesce("discovered_at", now)), "snowball_edges": edges.withColumn("discovered_at", F.coalesce("discovered_at", now))})
        return self.resolve(works, candidates, source, harvested=done["references_harvested"], seed_count=start.count(), name=direction, **options)

    def resolve(self, works: DataFrame, candidates: DataFrame, source: str = "crossref", harvested: int = 0, seed_count: int = 0, name: str = "resolve", **options) -> dict[str, int]:
        """References of either direction resolved into papers, linked to the citation source; the counts of the run."""
        r = citations.expand(self.t("reference_lists"), self.t("papers"), self.t("snowball_edges"), works, candidates, source, **options)
        counts = {"references_harvested": harvested, **r.counts}
        wanted = self.spark.range(1).selectExpr("'snowball' as name", "'Papers found in references' as description")
        sources = upserts.get_or_create(self.t("sources"), wanted, ["name"])
        links = r.new_papers.join(sources.where("name = 'snowball'").select(F.col("id").alias("source_id")))  # one source
        now = F.current_timestamp()
        self.store.commit({
            "papers": r.papers.withColumn("created_at", F.coalesce("created_at", now)), "reference_lists": r.lists, "snowball_edges": r.edges.withColumn("discovered_at", F.coalesce("discovered_at", now)), "sources": sources,
            "paper_sources": upserts.link(self.t("paper_sources"), links), "snowball_runs": citations.log_run(self.t("snowball_runs"), name, source, seed_count, counts)})
        return counts | r.statuses

    def backfill(self, works: DataFrame, candidates: DataFrame, source: str = "crossref", **options) -> DataFrame:
        """Empty abstracts filled from works and titles; the coverage afterwards."""
        self.store.commit({"papers": citations.backfill_chain(self.t("papers"), works, candidates, source, **options)})
        return citations.coverage(self.t("papers"), self.t("reference_lists"))

    def screen(self, model: screening.Model, model_name: str, prompt: str = "P1", run: int = 1, **options) -> dict[str, int]:
        """All papers through a model that the caller hands in; its answers become the evals of a run."""
        records = screening.screen_three(self.t("papers"), model, model_name, prompt, run, **options).withColumn("seq", F.col("paper_id"))
        kept = Stages(self.spark, "screen").save("records", records)  # a model is asked once
        runs, evals, counts = upserts.ingest_evals(self.t("eval_runs"), self.t("evals"), kept)
        self.store.commit({"eval_runs": runs, "evals": evals}, check=False)
        return counts

    def judge(self, model: screening.Model, judge_model: str, prompt_id: str = "", run_id: int | None = None) -> DataFrame:
        """Evals, of one run if named, through a second model; its views replace earlier ones of the same key."""
        evals = self.t("evals") if run_id is None else self.t("evals").where(F.col("run_id") == run_id)
        rows = Stages(self.spark, "judge").save("rows", screening.judge(evals, self.t("papers"), model, judge_model, prompt_id).withColumn("created_at", F.current_timestamp()))
        self.store.commit({"llm_judge": upserts.upsert(self.t("llm_judge"), rows, ["eval_id", "judge_model", "judge_prompt_id"])})
        return self.t("llm_judge").groupBy("verdict").count()

    def derive_threshold(self, method: str = "hybrid", criterion: str = "f1", **options) -> float | None:
        return scoring.derive_threshold(scoring.components(self.t("papers"), method, topic=self.topic, **options), self.t("ground_truth_consensus"), criterion)

    def bootstrap(self, method: str = "hybrid", rounds: int = 1000, **options) -> DataFrame:
        """Intervals of both thresholds over resampled labels, with precision, recall and F1 at their medians."""
        scores, gold = scoring.components(self.t("papers"), method, topic=self.topic, **options).select("id", "score"), self.t("ground_truth_consensus")
        return scoring.at_medians(scoring.intervals(scoring.bootstrap(scores, gold, rounds)), scores, gold)

    def export_baseline(self, path: str, method: str = "hybrid", threshold: float | None = None, run: int = 1, **options) -> None:
        """Eval records of a deterministic run as JSON lines, for embeddings at 0.3 if no threshold is given."""
        papers, gold = self.t("papers"), self.t("ground_truth_consensus")
        at = 0.3 if method == "embedding" and threshold is None else threshold
        write_records(scoring.baseline_records(scoring.evaluate_corpus(papers, gold, method, at, self.topic, **options), run), path)

    def analyse(self, name: str, kinds: tuple[str, ...] = ("corpus", "relevance", "snowball", "evaluation"), plots: str | None = None) -> str:
        """The reports of some kinds as JSON, kept under a name; bar charts go to the folder ``plots``, if one is named."""
        known = {
            "corpus": lambda: {"by_source": reports.by_source(self.t("sources"), self.t("paper_sources")), "by_category": reports.by_category(self.t("sources"), self.t("paper_sources")), "by_year": reports.by_year(self.t("papers"))},
            "relevance": lambda: {"relevance": reports.relevance(self.t("papers")), "binary": reports.binary(self.t("papers"))},
            "snowball": lambda: {"statuses": reports.statuses(self.t("reference_lists")), "edges": reports.edge_totals(self.t("snowball_edges"))},
            "evaluation": lambda: {"runs": metrics.summary(self.t("eval_runs"), self.t("evals"), self.t("ground_truth_consensus"))},
        }
        if bad := [k for k in kinds if k not in known]:
            raise ValueError(f"unknown kinds {bad}")
        found = {k: v for kind in kinds for k, v in known[kind]().items()}
        text = analysis_json(found)
        self.store_analysis(name, text)
        if plots:
            parts = json.loads(text)
            for k, (x, y) in {"by_source": ("source", "n_papers"), "by_year": ("year", "n_papers"), "relevance": ("relevance_class", "n_papers"), "statuses": ("status", "n"), "runs": ("run_id", "macro_f1")}.items():
                if rows := [r for r in parts.get(k, ()) if r.get(y) is not None]:
                    plot_bars(rows, x, y, f"{plots}/{name}-{k}.png")
        return text
