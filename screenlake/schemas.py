"""Tables of a screening project: types, keys and references. Nothing is ever inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LABELS = ("in-scope", "out-of-scope", "hybrid")
STATUSES = ("pending", "resolved", "unresolved_no_doi", "unresolved_title_failed", "fetch_error")
DIRECTIONS = ("backward", "forward")


@dataclass(frozen=True)
class Table:
    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    refers: tuple[tuple[str, str], ...] = ()
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _table(fields: str, key: str, unique=(), refers="", enums=()) -> Table:
    """``fields``: name type pairs; a ! after the type forbids nulls."""
    schema = T.StructType()
    for part in fields.split(", "):
        name, kind = part.split(" ", 1)
        schema.add(name, _KINDS[kind.rstrip("!")], not kind.endswith("!"))
    links = tuple(tuple(x.split(">")) for x in refers.split()) if refers else ()
    return Table(schema, tuple(key.split()), unique, links, enums)


_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType()),
}

TABLES: dict[str, Table] = {
    "sources": _table("id long!, name string!, description string", "id", (("name",),)),
    "queries": _table("id long!, run_at timestamp!, platform string!, query_text string!", "id"),
    "papers": _table(
        "id long!, title string!, authors string!, year int, abstract string!, publication_title string!, doi string, keywords string, pdf_url string, is_relevant boolean, "
        "relevance_score double, relevance_class string, created_at timestamp, updated_at timestamp, notes string", "id", (("doi",),)),
    "paper_queries": _table("paper_id long!, query_id long!", "paper_id query_id", (), "paper_id>papers query_id>queries"),
    "paper_sources": _table("paper_id long!, source_id long!", "paper_id source_id", (), "paper_id>papers source_id>sources"),
    "snowball_edges": _table("id long!, child_paper_id long!, parent_paper_id long!, depth int!, discovered_at timestamp", "id", (("child_paper_id", "parent_paper_id"),), "child_paper_id>papers parent_paper_id>papers"),
    "reference_lists": _table(
        "id long!, parent_paper_id long!, direction string!, ref_index int, ref_doi string, ref_title string, ref_year int, ref_authors string, ref_unstructured string, "
        "resolved_paper_id long, source string, status string!, discovered_at timestamp", "id", (), "parent_paper_id>papers resolved_paper_id>papers", (("direction", DIRECTIONS), ("status", STATUSES))),
    "snowball_runs": _table("id long!, direction string, source string, seed_count int, references_harvested int, new_papers int, edges int, api_calls int, started_at timestamp, finished_at timestamp, note string", "id"),
    "relevance_evals": _table("id long!, paper_id long!, method string!, score double!, is_relevant boolean!, threshold double!, decision string, details string, evaluated_at timestamp", "id", (), "paper_id>papers"),
    "runs": _table("id long!, run_at timestamp, model string, prompt_text string, misc string", "id"),
    "decisions": _table("id long!, run_id long!, paper_id long!, decision string, criterion string, justification string, excerpt string, excerpt_verified boolean, tokens_used int", "id", (), "run_id>runs paper_id>papers"),
    "ground_truth": _table("id long!, paper_id long!, annotator_id string!, label string!, confidence double, rationale string, created_at timestamp", "id", (("paper_id", "annotator_id"),), "paper_id>papers", (("label", LABELS),)),
    "ground_truth_consensus": _table("paper_id long!, consensus_label string!, n_annotators int!, n_agree int!, method string!, notes string, created_at timestamp", "paper_id", (), "paper_id>papers", (("consensus_label", (*LABELS, "disagree")),)),
    "eval_runs": _table("id long!, method string!, model string!, model_version string!, prompt_id string!, temperature double!, run_index int!, config_hash string, notes string, created_at timestamp", "id", (("method", "model", "model_version", "prompt_id", "temperature", "run_index"),)),
    "evals": _table("id long!, run_id long!, paper_id long!, decision string!, score double, confidence double, rationale string, matched_keywords strings, latency_ms int, created_at timestamp", "id", (("run_id", "paper_id"),), "run_id>eval_runs paper_id>papers", (("decision", LABELS),)),
    "llm_judge": _table("id long!, eval_id long!, judge_model string!, judge_prompt_id string!, score double, verdict string, rationale string, created_at timestamp", "id", (("eval_id", "judge_model", "judge_prompt_id"),), "eval_id>evals"),
    "schema_migrations": _table("version int!, name string!, applied_at timestamp", "version"),
    "analysis_runs": _table("id long!, name string!, generated_at timestamp, result_json string!", "id", (("name",),)),
    "paper_embeddings": _table("paper_id long!, model_name string!, embedding floats!, computed_at timestamp", "paper_id model_name", (), "paper_id>papers"),
}

EVAL_RECORD = _table(
    "eval_id string, paper_id long, title string, method string, model string, model_version string, prompt_id string, decision string, score double, confidence double, "
    "matched_keywords strings, rationale string, temperature double, run int, timestamp string, latency_ms int", "").schema
WORK = _table("doi string, title string, authors string, year int, unstructured string, publication_title string, pdf_url string, abstract string", "").schema
