"""Screening by a model that the caller hands in: answers become decisions or eval records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.functions.text import embedding_text, excerpt_fragments, html_unescape, in_order, judge_result, plain_quote, verify_excerpt
from screenlake.schemas import LABELS
from screenlake.stages import Stages

#: Prompts by name; the words are our own.
PROMPTS = {
    "P1": "Decide from title and abstract whether the paper is about physical attacks on the studied circuits (in-scope), about learned models of them only (out-of-scope), or both (hybrid). Answer as JSON with decision, relevance_score, confidence, techniques and rationale.",
    "P2": "List the attack techniques that the abstract names, say which need physical access, then give one of in-scope, out-of-scope or hybrid. Answer as JSON with decision, relevance_score, confidence, techniques and rationale.",
    "P3": "Be strict: in-scope only if the abstract reports a physical attack that was carried out. Otherwise out-of-scope, or hybrid if learning is combined with it. Answer as JSON with decision, relevance_score, confidence, techniques and rationale.",
}


def prompt(name: str) -> str:
    if name.upper() not in PROMPTS:
        raise ValueError(f"unknown prompt {name!r}")
    return PROMPTS[name.upper()]


Model = Callable[[str, str, str], str]


def ask(papers: DataFrame, model: Model, system: str, retries: int = 3, accept: Callable[[dict], bool] = lambda r: True) -> DataFrame:
    """(id, answer as JSON) from ``model(system, title, abstract)``, asked up to ``retries`` times for each paper until
    the answer is JSON and accepted; RuntimeError after that."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for t, a in zip(b["title"], b["abstract"]):
                fault: object = None
                for _ in range(retries):
                    try:
                        text = model(system, t or "", a or "")
                        if accept(json.loads(text)):
                            answers.append(text)
                            break
                        fault = "answer was not accepted"
                    except Exception as e:  # noqa: BLE001 - whatever the model's client raises counts as a failed try
                        fault = e
                else:
                    raise RuntimeError(f"no usable answer after {retries} tries: {fault}")
            yield pd.DataFrame({"id": b["id"], "answer": answers})

    clean = papers.select("id", html_unescape("title").alias("title"), html_unescape(F.coalesce("abstract", F.lit(""))).alias("abstract"))
    return clean.mapInPandas(run, "id long, answer string")


def screen_two(papers: DataFrame, model: Model, run_id: int, name: str = "P1", retries: int = 3, dry_run: bool = False) -> DataFrame:
    """Rows of decisions without id: INCLUDE or EXCLUDE (the default), and whether the excerpt is in the abstract."""
    if dry_run:
        answers = papers.select("id", F.lit("{}").alias("answer"))
    else:
        answers = ask(papers, model, prompt(name), retries)
    a = F.from_json("answer", "decision string, criterion string, justification string, excerpt string, tokens_used int")
    out = answers.withColumn("a", a).join(papers.select("id", F.coalesce("abstract", F.lit("")).alias("abstract")), "id")
    text = lambda c, d="": F.coalesce(F.col(f"a.{c}"), F.lit(d))
    return out.select(F.lit(run_id).cast("long").alias("run_id"), F.col("id").alias("paper_id"), text("decision", "EXCLUDE").alias("decision"), text("criterion").alias("criterion"), text("justification").alias("justification"), text("excerpt").alias("excerpt"), verify_excerpt(text("excerpt"), "abstract").alias("excerpt_verified"), F.col("a.tokens_used").alias("tokens_used"))


def _labelled(answer: dict) -> bool:
    return str(answer.get("decision") or "").strip().lower() in LABELS


def screen_three(papers: DataFrame, model: Model, model_name: str, name: str = "P1", run: int = 1, temperature: float = 0.0, retries: int = 3, dry_run: bool = False) -> DataFrame:
    """Eval records of the three classes; an answer outside them is asked for again."""
    if dry_run:
        answers = papers.select("id", F.lit(json.dumps({"decision": "out-of-scope", "rationale": "dry run"})).alias("answer"))
    else:
        answers = ask(papers, model, prompt(name), retries, _labelled)
    a = F.from_json("answer", "decision string, relevance_score double, confidence double, techniques array<string>, rationale string")
    out = answers.withColumn("a", a).join(papers.select("id", "title"), "id")
    return out.select(
        F.concat(F.lit(f"eval-{run}-"), F.col("id").cast("string")).alias("eval_id"), F.col("id").alias("paper_id"), "title", F.lit("llm").alias("method"), F.lit(model_name).alias("model"), F.lit("").alias("model_version"),
        F.lit(name).alias("prompt_id"), F.lower(F.trim("a.decision")).alias("decision"), F.col("a.relevance_score").alias("score"), F.col("a.confidence").alias("confidence"), F.coalesce("a.techniques", F.array().cast("array<string>")).alias("matched_keywords"),
        F.coalesce("a.rationale", F.lit("")).alias("rationale"), F.lit(temperature).alias("temperature"), F.lit(run).alias("run"), F.lit("").alias("timestamp"))


def judge(evals: DataFrame, papers: DataFrame, model: Model, judge_model: str, prompt_id: str = "") -> DataFrame:
    """Rows of llm_judge without id: a second model's view of decisions and rationales."""
    asked = evals.select(F.col("id").alias("eval_id"), "paper_id", "decision", "rationale").join(papers.select(F.col("id").alias("paper_id"), "title", "abstract"), "paper_id")
    q = asked.select(F.col("eval_id").alias("id"), "title", F.concat_ws("\n", F.coalesce("abstract", F.lit("")), F.concat(F.lit("Decision: "), "decision"), F.concat(F.lit("Rationale: "), F.coalesce("rationale", F.lit("")))).alias("abstract"))
    answers = ask(q, model, "Say whether the rationale supports the decision. Answer as JSON with score, verdict (pass, needs_review, fail) and rationale.")
    a = answers.withColumn("a", F.from_json("answer", "score string, verdict string, rationale string"))
    fields = judge_result(F.col("a.score"), F.col("a.verdict"), F.col("a.rationale"))
    return a.select(F.col("id").alias("eval_id"), F.lit(judge_model).alias("judge_model"), F.lit(prompt_id).alias("judge_prompt_id"), *[v.alias(k) for k, v in fields.items()])


def find_excerpts(docs: DataFrame, excerpts: DataFrame, id_col: str = "id", text_col: str = "abstract", key: str = "excerpt_id", size: int = 5) -> DataFrame:
    """(id, key) of each document and each of the excerpts (key, excerpt) that it holds: fragments in order.

    Words inside of a fragment, its first and last apart, are words of any text that holds it, one after the other. The
    first ``size`` of them, fewer in a shorter fragment, of the longest fragment find candidates: runs of as many words
    of the texts are joined with them by hash, and only candidates are compared. Excerpts without inner words are
    compared with every text, empty ones are in all. Each text is made plain once for either step.
    """
    st = Stages(docs.sparkSession, "excerpts")
    longest = F.split(F.element_at(F.array_sort("fragments", lambda a, b: F.length(b) - F.length(a)), 1), " ")
    asked = excerpts.select(key, excerpt_fragments("excerpt").alias("fragments")).withColumn("inner", F.when(F.size("fragments") > 0, longest).otherwise(F.array().cast("array<string>")))
    asked = asked.withColumn("inner", F.slice("inner", 2, F.greatest(F.lit(0), F.least(F.lit(size), F.size("inner") - 2)))).withColumn("n", F.size("inner"))
    asked = st.save("asked", asked.withColumn("run", F.xxhash64("inner")))
    lengths = [r["n"] for r in asked.select("n").distinct().orderBy("n").collect()]  # at most size + 1
    plain = docs.select(F.col(id_col).alias("id"), plain_quote(F.col(text_col)).alias("plain"))
    w = F.col("w")

    def runs(n: int):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice(w, i, n)).alias("run")))).otherwise(F.array().cast("array<struct<n:int,run:bigint>>"))

    none = F.array().cast("array<struct<n:int,run:bigint>>")
    held = plain.select("id", F.split("plain", " ").alias("w")).select("id", F.explode(F.concat(none, *[runs(n) for n in lengths if n])).alias("r"))
    pairs = held.select("id", "r.n", "r.run").join(asked.where("n > 0").select(key, "n", "run"), ["n", "run"]).select("id", key).distinct()
    pairs = st.save("pairs", pairs)
    fits = in_order(F.col("fragments"), F.col("plain"))
    found = plain.join(pairs, "id").join(asked.select(key, "fragments"), key).where(fits).select("id", key)
    if 0 in lengths:
        found = found.unionByName(plain.crossJoin(asked.where("n = 0").select(key, "fragments")).where(fits).select("id", key))  # no word of these is sure
    return found


def embed(papers: DataFrame, embeddings: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model_name: str, prefix: str = "- ", batch: int = 64) -> DataFrame:
    """Rows of paper_embeddings for papers that have none of this model yet."""
    missing = papers.join(embeddings.where(F.col("model_name") == model_name).select(F.col("paper_id").alias("id")), "id", "left_anti")
    texts = missing.select("id", F.concat(F.lit(prefix), embedding_text(F.col("title"), F.col("abstract"))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"paper_id": part["id"], "embedding": embedder(part["text"].tolist())})

    return texts.mapInPandas(run, "paper_id long, embedding array<float>").select("paper_id", F.lit(model_name).alias("model_name"), "embedding")
