"""Relevance scores: ranking function, keywords, both weighted, cosine; thresholds from labels and their stability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.text import apart, condensed, occurrences, preprocess, tokens
from screenlake.functions.topic import STUDY, Topic, keyword_scores, labelled, signals
from screenlake.stages import Stages, numbered

FALLBACK = 0.15


def term_counts(docs: DataFrame, asked: list[str], cleaned: str, brief: str | None = None) -> DataFrame:
    """``docs`` plus dl (words of a preprocessed text) and tf (how often each of the terms asked for is a word).
    ``brief``: a column with the text condensed to words that include the terms, if there is one already."""
    c = F.coalesce(F.col(cleaned), F.lit(""))
    df = docs.withColumn("__a", apart(F.col(brief) if brief else condensed(c, asked))).withColumn("dl", F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1))
    return df.withColumn("tf", F.array(*[occurrences(F.col("__a"), f" {x} ") for x in asked]).cast("array<int>")).drop("__a")


def corpus_row(counted: DataFrame, asked: list[str]) -> DataFrame:
    """One row of what the ranking function needs of a corpus: docs, avgdl, and df of the sorted terms."""
    return counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(asked))]).alias("df"))


def ranked(counted: DataFrame, terms: Mapping[str, int], k1: float = 1.5, b: float = 0.75, corpus: DataFrame | None = None) -> DataFrame:
    """``counted`` (dl, tf of the sorted terms) plus bm25, by the statistics of a ``corpus`` row or of its own."""
    asked = sorted(terms)
    corpus = (corpus_row(counted, asked) if corpus is None else corpus).select(*[F.col(c).alias(f"__{c}") for c in ("docs", "avgdl", "df")])
    one = counted.crossJoin(F.broadcast(corpus))  # one row
    score: Column = F.lit(0.0)
    for i, x in enumerate(asked):
        tf, df = F.col("tf")[i], F.col("__df")[i]
        idf = F.ln((F.col("__docs") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, F.lit(terms[x]) * idf * tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("__avgdl")))).otherwise(0.0)
    return one.withColumn("bm25", score).drop(*corpus.columns)


def bm25(docs: DataFrame, terms: Mapping[str, int], id_col: str = "id", text_col: str = "abstract", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, bm25) of every document for a query given as term -> times. Texts without words score 0.

    One pass over the texts counts words and hits and is written; statistics and scores come from that small table. No
    document is shuffled.
    """
    counted = term_counts(docs.select(F.col(id_col).alias("id"), preprocess(text_col).alias("__c")), sorted(terms), "__c").select("id", "dl", "tf")
    return ranked(Stages(docs.sparkSession, "bm25").save("counted", counted), terms, k1, b).select("id", "bm25")


def corpus_statistics(docs: DataFrame, id_col: str = "id", text_col: str = "abstract") -> tuple[DataFrame, DataFrame]:
    """(term, df) of all terms, and one row (docs, avgdl)."""
    t = docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("t"))
    df = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df, t.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avgdl"))


def normalised(scores: DataFrame, col: str, top: DataFrame | None = None) -> DataFrame:
    """``col`` as a share of its maximum, or of the column ``top`` of one row; all 0 if that is not positive."""
    top = (scores.agg(F.max(col).alias("top")) if top is None else top).select(F.col("top").alias("__top"))
    share = F.when(F.col("__top") > 0, F.col(col) / F.col("__top")).otherwise(0.0)
    return scores.crossJoin(F.broadcast(top)).withColumn(col, share).drop("__top")  # one row


def cosine(papers: DataFrame, embeddings: DataFrame, topic: DataFrame) -> DataFrame:
    """(id, score): cosine of each paper's embedding and the topic's one vector; 0 without an embedding."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("topic")
    joined = papers.select("id").join(embeddings.select(F.col("paper_id").alias("id"), "embedding"), "id", "left").crossJoin(F.broadcast(topic.select(F.col("embedding").alias("topic")).limit(1)))
    length = F.sqrt(dot(e, e)) * F.sqrt(dot(q, q))
    return joined.select("id", F.coalesce(F.when(length > 0, dot(e, q) / length), F.lit(0.0)).alias("score"))


def measured(papers: DataFrame, topic: Topic) -> DataFrame:
    """id, what keywords and signals find, dl and tf of each paper."""
    base = papers.select("id", F.coalesce("abstract", F.lit("")).alias("abstract")).withColumn("__c", preprocess("abstract")).withColumn("__b", condensed(F.col("__c"), topic.vocabulary))
    base = keyword_scores(base, "abstract", topic, cleaned="__b").withColumn("signals", signals(F.col("__b"), topic))
    return term_counts(base, sorted(topic.query_terms()), "__c", "__b").drop("abstract", "__c", "__b")


def statistics(papers: DataFrame, topic: Topic = STUDY) -> DataFrame:
    """One row, to be kept beside a corpus: docs, avgdl, df of the topic's terms, and top, the best rank score. With it a
    paper is scored without reading the others."""
    st, terms = Stages(papers.sparkSession, "statistics"), topic.query_terms()
    counted = papers.select("id", preprocess(F.coalesce("abstract", F.lit(""))).alias("__c"))
    counted = st.save("counted", term_counts(counted, sorted(terms), "__c").select("dl", "tf"))
    corpus = st.save("corpus", corpus_row(counted, sorted(terms)))
    return st.finish(corpus.crossJoin(F.broadcast(ranked(counted, terms, corpus=corpus).agg(F.max("bm25").alias("top")))))  # one row each


def components(papers: DataFrame, method: str = "hybrid", keyword_weight: float = 0.4, bm25_weight: float = 0.6, topic: Topic = STUDY, embeddings: DataFrame | None = None, topic_vector: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """id, keyword_score, keyword_raw, keyword_matched, signals, bm25_score, score of every paper.

    The texts are read, preprocessed and condensed to the topic's words once: what keywords, signals and the ranking function need of them is written
    as one small row for each paper, from which thresholds and results are made. With a row of ``statistics`` as
    ``corpus`` the papers are scored against that corpus, in one pass over them alone.
    """
    if method not in ("keyword", "bm25", "hybrid", "embedding"):
        raise ValueError(f"unknown method {method!r}")
    if method == "embedding" and (embeddings is None or topic_vector is None):
        raise ValueError("method 'embedding' needs embeddings and a topic vector")
    terms = topic.query_terms()
    base = measured(papers, topic)
    if corpus is None:
        base = Stages(papers.sparkSession, "scores").save("measured", base)
    if method == "embedding":
        return base.drop("dl", "tf").withColumn("bm25_score", F.lit(0.0)).join(cosine(papers, embeddings, topic_vector), "id")
    if method == "keyword":
        base = base.withColumn("bm25_score", F.lit(0.0))
    else:
        base = normalised(ranked(base, terms, corpus=corpus), "bm25", corpus).withColumnRenamed("bm25", "bm25_score")
    both = F.lit(keyword_weight) * F.col("keyword_score") + F.lit(bm25_weight) * F.col("bm25_score")
    return base.drop("dl", "tf").withColumn("score", {"keyword": F.col("keyword_score"), "bm25": F.col("bm25_score")}.get(method, both))


def gold(consensus: DataFrame) -> DataFrame:
    """(paper_id, y): 1 in-scope, 0 the other two classes; rows without agreement are left out."""
    y = F.when(F.col("consensus_label") == "in-scope", 1).when(F.col("consensus_label").isin("out-of-scope", "hybrid"), 0)
    return consensus.select("paper_id", y.alias("y")).where("y is not null")


def sweep(pairs: DataFrame, by: list[str], criterion: str = "f1", step: float = 0.01, times: str | None = None) -> DataFrame:
    """by..., threshold, value: the first best threshold of each group of (by..., score, y). ``times``: a column that
    says how many pairs a row stands for.

    Scores are counted by the last grid point they reach, so work is in proportion to rows plus grid points, not to
    their product. Groups with one class only have no row.
    """
    if criterion not in ("f1", "youden"):
        raise ValueError(f"unknown criterion {criterion!r}: use 'f1' or 'youden'")
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    n = F.col(times) if times else F.lit(1)
    at = lambda i: F.round(F.col("start") + i * F.lit(step), 10)
    group = pairs.groupBy(*by).agg(F.least(F.lit(0.0), F.min("score") - 1e-3).alias("start"), F.greatest(F.lit(1.0), F.max("score") + 1e-3).alias("stop"), F.sum(F.col("y") * n).alias("pos"), F.sum((1 - F.col("y")) * n).alias("neg"))
    group = group.where("pos > 0 and neg > 0").withColumn("steps", F.greatest(F.lit(1), F.ceil((F.col("stop") - F.col("start")) / F.lit(step)).cast("int")))
    k = F.floor((F.col("score") - F.col("start")) / F.lit(step)).cast("int")
    reach = pairs.join(group, by) if by else pairs.crossJoin(F.broadcast(group))
    reach = reach.withColumn("i", k).withColumn("i", F.when(at(F.col("i") + 1) <= F.col("score"), F.col("i") + 1).when(at(F.col("i")) > F.col("score"), F.col("i") - 1).otherwise(F.col("i")))
    reach = reach.withColumn("i", F.least("i", "steps")).groupBy(*by, "i").agg(F.sum(F.col("y") * n).alias("p"), F.sum((1 - F.col("y")) * n).alias("q"))
    grid = group.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    w = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # at most the grid's points
    rows = grid.join(reach, [*by, "i"], "left").withColumns({"tp": F.coalesce(F.sum("p").over(w), F.lit(0)), "fp": F.coalesce(F.sum("q").over(w), F.lit(0))})
    tp, fp = F.col("tp"), F.col("fp")
    if criterion == "f1":
        precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        recall = tp / F.col("pos")
        value = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    else:
        value = tp / F.col("pos") + (F.col("neg") - fp) / F.col("neg") - 1.0
    best = rows.withColumn("v", value).groupBy(*by).agg(F.max(F.struct("v", (-F.col("i")).alias("back"), at(F.col("i")).alias("t"))).alias("m"))
    return best.select(*by, F.col("m.t").alias("threshold"), F.col("m.v").alias("value"))


def derive_threshold(scores: DataFrame, consensus: DataFrame, criterion: str = "f1", step: float = 0.01) -> float | None:
    """The first best threshold for (id, score) against consensus labels; None without both classes."""
    pairs = scores.select(F.col("id").alias("paper_id"), "score").join(gold(consensus), "paper_id").select("score", "y")
    row = sweep(pairs, [], criterion, step).first()
    return row["threshold"] if row else None


def evaluate_corpus(papers: DataFrame, consensus: DataFrame | None = None, method: str = "hybrid", threshold: float | None = None, topic: Topic = STUDY, **options) -> DataFrame:
    """paper_id, score, is_relevant, relevance_class, threshold and the details of each paper.

    Without a threshold it is derived from the consensus; without usable labels it is 0.15.
    """
    parts = components(papers, method, topic=topic, **options)
    if threshold is None:
        threshold = derive_threshold(parts, consensus) if consensus is not None else None
        threshold = FALLBACK if threshold is None else threshold
    return parts.select(
        F.col("id").alias("paper_id"), "score", (F.col("score") >= threshold).alias("is_relevant"), labelled(F.col("signals"), F.col("score"), threshold).alias("relevance_class"),
        F.lit(method).alias("method"), F.lit(threshold).alias("threshold"), "keyword_score", "bm25_score", "keyword_raw", "keyword_matched")


def evaluate_paper(papers: DataFrame, paper_id: int, method: str = "hybrid", threshold: float = FALLBACK, corpus: DataFrame | None = None, topic: Topic = STUDY, **options) -> DataFrame:
    """One paper against statistics of the whole corpus; an unknown id is an error. With a kept row of ``statistics``
    only the paper itself is read."""
    one = papers.where(F.col("id") == paper_id)
    if not one.limit(1).count():
        raise ValueError(f"Paper {paper_id} not found")
    if corpus is None and method in ("bm25", "hybrid"):
        corpus = statistics(papers, topic)
    return evaluate_corpus(one, None, method, threshold, topic=topic, corpus=corpus, **options)


def baseline_records(results: DataFrame, run: int = 1) -> DataFrame:
    """Eval records of a deterministic run."""
    return results.select(
        F.concat(F.lit(f"eval-{run}-"), F.col("paper_id").cast("string")).alias("eval_id"), "paper_id", F.lit("").alias("title"), F.concat(F.lit("baseline_"), "method").alias("method"),
        F.lit("deterministic").alias("model"), F.lit("").alias("model_version"), F.lit("n/a").alias("prompt_id"), F.col("relevance_class").alias("decision"), "score",
        F.lit(None).cast("double").alias("confidence"), F.map_keys("keyword_matched").alias("matched_keywords"),
        F.concat("method", F.lit(" score "), F.format_string("%.4f", "score"), F.lit(" vs threshold "), F.col("threshold").cast("string")).alias("rationale"),
        F.lit(0.0).alias("temperature"), F.lit(run).alias("run"), F.lit("").alias("timestamp"))


def relevance_rows(results: DataFrame) -> DataFrame:
    """Rows of relevance_evals without id and time."""
    details = F.to_json(F.struct("keyword_score", "bm25_score", F.struct(F.col("keyword_matched").alias("matched"), F.col("keyword_raw").alias("raw_score")).alias("keyword_details"), "method", "threshold"))
    return results.select("paper_id", "method", "score", "is_relevant", "threshold", F.col("relevance_class").alias("decision"), details.alias("details"))


def mark_papers(papers: DataFrame, results: DataFrame) -> DataFrame:
    """``papers`` with the last results in is_relevant, relevance_score and relevance_class."""
    new = results.select(F.col("paper_id").alias("id"), F.col("is_relevant").alias("__r"), F.col("score").alias("__s"), F.col("relevance_class").alias("__c"))
    found = F.col("__s").isNotNull()
    out = papers.join(new, "id", "left")
    for name, col in (("is_relevant", "__r"), ("relevance_score", "__s"), ("relevance_class", "__c")):
        out = out.withColumn(name, F.when(found, F.col(col)).otherwise(F.col(name)))
    return out.select(*papers.columns)


def draw(seed: int, round_: Column, place: Column, n: int) -> Column:
    """A number from 0 to n - 1 for each (seed, round, place), the same on any executor: 48 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % n


def bootstrap(scores: DataFrame, consensus: DataFrame, rounds: int = 1000, size: int | None = None, step: float = 0.01, seed: int = 42, draws: DataFrame | None = None) -> DataFrame:
    """round, criterion, threshold: thresholds of resampled labels. Rounds with one class only have no row.

    Labelled papers are numbered in the order of their ids; a round draws ``size`` numbers (as many as there are labels
    if not given) with replacement, and a paper counts once in it. Draws are hashed from (seed, round, place) where they
    are needed, or given (round, nth), and merged at once into counts of each (round, score, class), over which the
    thresholds of all rounds are swept together. A drawn paper without a score takes part in no sweep. Only the number
    of labels comes to the driver.
    """
    spark = scores.sparkSession
    st = Stages(spark, "bootstrap")
    rows = gold(consensus).join(scores.select(F.col("id").alias("paper_id"), "score"), "paper_id", "left").select("paper_id", "score", "y")
    rows = st.save("labels", numbered(rows, ["paper_id", "score", "y"]))
    n = rows.count()
    if not n:
        raise ValueError("no labelled papers in the consensus")
    k = size or n
    if draws is None:
        turn = F.floor(F.col("id") / k).cast("int")
        draws = spark.range(rounds * k).select(turn.alias("round"), draw(seed, turn, F.col("id") % k, n).alias("nth"))
    cells = draws.select("round", "nth").distinct().join(rows.where("score is not null"), "nth").groupBy("round", "score", "y").agg(F.count("*").alias("times"))
    cells = st.save("cells", cells)
    both = [sweep(cells, ["round"], c, step, "times").select("round", F.lit(c).alias("criterion"), "threshold") for c in ("f1", "youden")]
    return both[0].unionByName(both[1])


def intervals(thresholds: DataFrame) -> DataFrame:
    """criterion, n, low, high, median: percentiles by index int(q * n) of the sorted thresholds."""
    s = thresholds.groupBy("criterion").agg(F.sort_array(F.collect_list("threshold")).alias("t"))  # at most one for each round
    n = F.size("t")
    pick = lambda q: F.get("t", F.floor(n * F.lit(q)).cast("int"))
    return s.select("criterion", n.alias("n"), pick(0.025).alias("low"), pick(0.975).alias("high"), F.get("t", F.floor(n / 2).cast("int")).alias("median"))


def at_medians(bounds: DataFrame, scores: DataFrame, consensus: DataFrame) -> DataFrame:
    """``bounds`` (one row for each criterion) with precision, recall and f1 of all labelled papers at the median
    threshold; a paper without a score counts as 0."""
    pairs = gold(consensus).join(scores.select(F.col("id").alias("paper_id"), "score"), "paper_id", "left").select(F.coalesce("score", F.lit(0.0)).alias("score"), "y")
    over = F.col("score") >= F.col("median")
    n = pairs.crossJoin(F.broadcast(bounds)).groupBy(*bounds.columns).agg(  # two rows
        F.count_if(over & (F.col("y") == 1)).alias("tp"), F.count_if(over & (F.col("y") == 0)).alias("fp"), F.sum("y").alias("pos"))
    tp, fp, p, r = F.col("tp"), F.col("fp"), F.col("precision"), F.col("recall")
    n = n.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": F.when(F.col("pos") > 0, tp / F.col("pos")).otherwise(0.0)})
    return n.select(*bounds.columns, "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
