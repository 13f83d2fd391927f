"""Queries over inputs, citations and screening, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from screenlake.functions import text as X
from screenlake.operators import citations, identity, lookups, screening, upserts
from screenlake.plans import sql as readonly
from screenlake.plans.catalogue import _DOI, _KEYS, _docs, query
from screenlake.plans.standin import ctes, table
from screenlake.schemas import EVAL_RECORD, TABLES
from screenlake.sources import bibtex, payloads, tables, works
from screenlake.stages import Stages
from screenlake.store import from_first_layout, migrate

# --- files and payloads ---------------------------------------------------------------------------------------------

#: Texts as files have them, made alike by Spark and DuckDB.
_BIB = r"""SELECT concat('f', doc_id) AS path, concat('% note', chr(10), '@Article{k', doc_id, ',', chr(10), '  title = {{T', chr(123), 'e', chr(125), 'xt} of ', lang, '  ', doc_id, '},', chr(10), '  author = "Roe, ', source, ' and Poe, Ann",', chr(10), '  year = ',
    CASE WHEN doc_id % 7 = 0 THEN 'soon' ELSE '2001' END, ',', chr(10), '  journal = {J, of ', lang, '},', chr(10), '  keywords = {a, ,', source, '},', chr(10), '  doi = {10.1/', doc_id, '}', chr(10), '}', chr(10)) AS value FROM documents"""


@query("SELECT concat('k', doc_id) AS cite_key, concat('{T{e}xt} of ', lang, ' ', doc_id) AS title, concat(source, ' Roe; Ann Poe') AS authors, CASE WHEN doc_id % 7 <> 0 THEN 2001 END AS year, concat('J, of ', lang) AS publication_title, concat('a; ', source) AS keywords, "
       "concat('10.1/', doc_id) AS doi, CASE WHEN doc_id % 7 = 0 THEN 'bad year: soon' END AS error FROM documents")
def bibtex_papers(spark, d):
    _docs(spark, d).createOrReplaceTempView("documents")
    return bibtex.papers(bibtex.entries(spark.sql(_BIB))).select("cite_key", "title", "authors", "year", "publication_title", "keywords", "doi", "error")


_CSV = """SELECT doc_id AS seq, CASE doc_id % 5 WHEN 0 THEN 'Article' WHEN 1 THEN 'inproceedings' WHEN 2 THEN 'book' ELSE 'article' END AS entry_type, concat('Roe, ', source, ' and Poe') AS author, concat(' T', doc_id, ' ') AS title, CASE WHEN doc_id % 9 = 4 THEN 'x' ELSE '2001' END AS year,
    CASE WHEN doc_id % 5 = 3 THEN '' ELSE 'J' END AS journal, 'B' AS booktitle, 'ab' AS abstract, CASE WHEN doc_id % 2 = 0 THEN concat('10.1/', doc_id) ELSE ' ' END AS doi, concat(lang, ',, k') AS keywords FROM documents"""


@query(f"""WITH r AS ({_CSV}) SELECT seq, trim(title) AS title, regexp_replace(author, '^Roe, (.*) and Poe$', '\\1 Roe; Poe') AS authors, TRY_CAST(year AS INT) AS year, nullif(trim(doi), '') AS doi, regexp_replace(keywords, ',, ', '; ') AS keywords,
    CASE WHEN lower(entry_type) = 'article' THEN nullif(journal, '') WHEN entry_type = 'inproceedings' THEN booktitle END AS publication_title,
    CASE WHEN entry_type = 'book' THEN 'Unsupported entry_type book' WHEN lower(entry_type) = 'article' AND journal = '' THEN 'Empty value for field ''journal''' WHEN year = 'x' THEN 'Field ''year'' is not an integer: x' END AS error FROM r""")
def csv_rows(spark, d):
    _docs(spark, d).createOrReplaceTempView("documents")
    return tables.map_rows(spark.sql(_CSV), "acm").select("seq", "title", "authors", "year", "doi", "keywords", "publication_title", "error")


@query("SELECT doc_id, concat('10.1/', doc_id) AS doi, concat('T ', lang) AS title, concat('Ann ', source, '; Org') AS authors, 1990 + doc_id % 30 AS year, 'V' AS publication_title, concat('http://p/', doc_id) AS pdf_url, 'x < y.' AS abstract FROM documents")
def crossref_works(spark, d):
    person = F.array(F.struct(F.lit("Ann").alias("given"), F.col("source").alias("family"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("Org").alias("name")))
    payload = F.to_json(F.struct(
        F.concat(F.lit("10.1/"), "doc_id").alias("DOI"), F.array(F.concat(F.lit("T "), "lang")).alias("title"), person.alias("author"), F.struct(F.array(F.array((1990 + F.col("doc_id") % 30).cast("string"), F.lit("5"))).alias("date-parts")).alias("published"),
        F.array(F.struct(F.lit("text/html").alias("content-type"), F.lit("h").alias("URL")), F.struct(F.lit("application/pdf").alias("content-type"), F.concat(F.lit("http://p/"), "doc_id").alias("URL"))).alias("link"), F.array(F.lit("V")).alias("container-title"), F.lit("<jats:p>x &lt; y</jats:p> .").alias("abstract")))
    return works.normalise(_docs(spark, d).select("doc_id", payload.alias("payload")), "crossref").select("doc_id", "doi", "title", "authors", "year", "publication_title", "pdf_url", "abstract")


def _kept(spark, d, name: str, payload, **more) -> works.WorkSource:
    """A source whose payloads, one for each document, are kept as files and read back by the data source."""
    path = f"{Stages(spark, 'payloads').root}/{name}"
    rows = _docs(spark, d).select(F.concat(F.lit("10.1/"), "doc_id").alias("key"), F.to_json(payload).alias("payload"), *[c.alias(k) for k, c in more.items()])
    payloads.keep(rows, path, 8)
    return works.WorkSource(name, payloads.read(spark, path))


_id = lambda: F.concat(F.lit("10.1/"), "doc_id")
_year = lambda: 1990 + F.col("doc_id") % 30
_none = lambda: F.lit(None).cast("string")


@query("SELECT concat('https://doi.org/10.1/', doc_id) AS doi, concat('T ', lang) AS title, concat(source, '; Org') AS authors, (1990 + doc_id % 30)::INT AS year, '' AS unstructured, 'V' AS publication_title, CASE WHEN doc_id % 4 > 0 THEN concat('http://p/', doc_id) END AS pdf_url, concat(lang, ' of ', source, ' of') AS abstract, 'openalex' AS source "
       "FROM documents WHERE doc_id % 3 = 0")
def works_by_doi(spark, d):
    """Works of every third document's DOI, asked for by a table of DOIs."""
    authors = F.array(*[F.struct(F.struct(x.alias("display_name")).alias("author")) for x in (F.col("source"), _none(), F.lit("Org"))])
    location = F.struct(F.struct(F.lit("V").alias("display_name")).alias("source"))
    words = F.create_map(F.lit("of"), F.array(F.lit(3), F.lit(1)), F.col("lang"), F.array(F.lit(0)), F.col("source"), F.array(F.lit(2)))
    pdf = F.struct(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("http://p/"), "doc_id")).alias("pdf_url"))
    payload = F.struct(F.concat(F.lit("https://doi.org/"), _id()).alias("doi"), F.concat(F.lit("T "), "lang").alias("title"), authors.alias("authorships"), _year().cast("int").alias("publication_year"), location.alias("primary_location"), pdf.alias("best_oa_location"), words.alias("abstract_inverted_index"))
    asked = _docs(spark, d).where("doc_id % 3 = 0").select(_id().alias("doi"))
    return _kept(spark, d, "openalex", payload).by_dois(asked)


@query("SELECT concat('10.1/', doc_id) AS doi, concat('T ', lang) AS title, concat('N ', source, '; Other') AS authors, CASE WHEN doc_id % 5 > 0 THEN (1990 + doc_id % 30)::INT END AS year, '' AS unstructured, CASE WHEN doc_id % 2 = 0 THEN 'V' ELSE '' END AS publication_title, NULL::VARCHAR AS pdf_url, CASE WHEN doc_id % 3 > 0 THEN concat('A ', lang) ELSE '' END AS abstract, 'semantic_scholar' AS source FROM documents")
def works_of_graph(spark, d):
    authors = F.array(F.struct(F.concat(F.lit("N "), "source").alias("name")), F.struct(F.lit("Other").alias("name")))
    payload = F.struct(F.struct(_id().alias("DOI")).alias("externalIds"), F.concat(F.lit("T "), "lang").alias("title"), authors.alias("authors"), F.when(F.col("doc_id") % 5 > 0, _year().cast("int")).alias("year"),
                       F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("A "), "lang")).alias("abstract"), F.struct(F.when(F.col("doc_id") % 2 == 0, "V").alias("name")).alias("publicationVenue"))
    return _kept(spark, d, "semantic_scholar", payload).by_dois(_docs(spark, d).select(_id().alias("doi")))


@query("SELECT concat('10.1/', doc_id) AS doi, concat('T ', lang) AS title, concat('Ann ', source, '; Org') AS authors, CASE WHEN doc_id % 5 > 0 THEN (1990 + doc_id % 30)::INT END AS year, '' AS unstructured, CASE WHEN doc_id % 2 = 1 THEN 'V' ELSE '' END AS publication_title, NULL::VARCHAR AS pdf_url, concat('A ', lang) AS abstract, 'zotero' AS source FROM documents "
       "UNION ALL SELECT concat('10.1/', doc_id), concat('T ', lang), concat('Ann ', source, '; Org'), CASE WHEN doc_id % 5 > 0 THEN (1990 + doc_id % 30)::INT END, '', '', NULL, concat('A ', lang), 'zotero one by one' FROM documents")
def works_of_library(spark, d):
    """Items of a library, asked for in batches and one by one (then without a venue)."""
    creators = F.array(F.struct(F.lit(" Ann").alias("given"), F.col("source").alias("family")), F.struct(_none().alias("given"), F.lit("Org ").alias("family")), F.struct(F.lit("").alias("given"), F.lit(" ").alias("family")))
    payload = F.struct(_id().alias("DOI"), F.concat(F.lit("T "), "lang").alias("title"), creators.alias("creators"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("5 May "), _year(), F.lit(", late"))).otherwise("no date").alias("date"),
                       F.concat(F.lit("A "), "lang").alias("abstractNote"), F.when(F.col("doc_id") % 2 == 1, "V").alias("publicationTitle"))
    library, asked = _kept(spark, d, "zotero", payload), _docs(spark, d).select(_id().alias("doi"))
    return library.by_dois(asked).unionByName(library.by_dois(asked, single=True).withColumn("source", F.lit("zotero one by one")))


@query("SELECT concat('10.1/', doc_id) AS parent_doi, (doc_id % 7)::INT AS ref_index, CASE WHEN doc_id % 4 > 0 THEN concat('10.2/', doc_id) END AS doi, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN concat('R ', lang) ELSE concat('S ', lang) END AS title, CASE WHEN doc_id % 5 > 0 THEN (1990 + doc_id % 30)::INT END AS year, concat('as printed ', source) AS unstructured "
       "FROM documents WHERE doc_id % 2 = 0")
def references_listed(spark, d):
    """The references of every document as seeds: only rows of the asked direction, and only pairs that a source offers."""
    title = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("R "), "lang"))
    payload = F.struct(F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("10.2/"), "doc_id")).alias("DOI"), title.alias("article-title"), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("S "), "lang")).alias("title"), F.when(F.col("doc_id") % 5 > 0, _year().cast("string")).otherwise("20x").alias("year"), F.concat(F.lit(" as printed "), "source").alias("unstructured"))
    crossref = _kept(spark, d, "crossref", payload, direction=F.when(F.col("doc_id") % 2 == 0, "backward").otherwise("forward"), ref_index=(F.col("doc_id") % 7).cast("int"))
    seeds = _docs(spark, d).select(_id().alias("doi"))
    return crossref.references(seeds, "backward").unionByName(crossref.references(seeds, "forward")).select("parent_doi", "ref_index", "doi", "title", "year", "unstructured")


@query(r"SELECT doc_id AS id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^0-9a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS folded FROM documents")
def folded_titles(spark, d):
    """Every text in the form that titles are compared in."""
    return _docs(spark, d).select(F.col("doc_id").alias("id"), X.match_title("text").alias("folded"))


@query("SELECT doc_id AS id, md5(text) AS plain FROM documents")
def unescaped(spark, d):
    """Every text, written with character references and read back."""
    escaped = F.col("text")
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), ("é", "&eacute;"), ("à", "&#224;"), ("ü", "&#xFC;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(reference))
    return _docs(spark, d).select(F.col("doc_id").alias("id"), F.md5(X.html_unescape(escaped)).alias("plain"))


@query(ctes("evals") + " SELECT id, CASE WHEN score IS NOT NULL THEN decision END AS decision, score, CASE WHEN score IS NULL THEN concat('invalid decision: ', decision, '?') END AS error, CASE WHEN paper_id % 3 = 0 THEN '' ELSE concat('because ', decision) END AS rationale FROM evals")
def screening_answers(spark, d):
    """Answers made of every eval: labels in capitals, scores as texts; labels that are none where the score is not one."""
    e = table(spark, d, "evals")
    raw = F.when(F.col("score").isNotNull(), F.concat(F.lit(" "), F.upper("decision"))).otherwise(F.concat("decision", F.lit("? ")))
    c = X.llm_result(raw, F.coalesce(F.col("score").cast("string"), F.lit("half")), F.lit("1"), F.lit(None).cast("array<string>"), F.when(F.col("paper_id") % 3 != 0, F.concat(F.lit("because "), "decision")))
    return e.select("id", *[c[k].alias(k) for k in ("decision", "score", "error", "rationale")])


@query(ctes("evals") + " SELECT id, least(1.0, greatest(0.0, coalesce(2 * score - 0.5, 0.0)))::DOUBLE AS score, CASE decision WHEN 'in-scope' THEN 'pass' WHEN 'hybrid' THEN 'fail' ELSE 'needs_review' END AS verdict, concat('r ', decision) AS rationale FROM evals")
def judge_answers(spark, d):
    """Judgements made of every eval: scores beyond 0 and 1, verdicts in capitals or none."""
    e = table(spark, d, "evals")
    verdict = F.when(F.col("decision") == "in-scope", " PASS").when(F.col("decision") == "hybrid", "Fail ").otherwise("perhaps")
    c = X.judge_result((2 * F.col("score") - 0.5).cast("string"), verdict, F.concat(F.lit(" r "), "decision", F.lit("\n")))
    return e.select("id", *[c[k].alias(k) for k in ("score", "verdict", "rationale")])


# --- files that are written and read back ---------------------------------------------------------------------------


@query(ctes("evals") + " SELECT id AS eval_id, paper_id, concat('T ', decision) AS title, decision, score, run_id::INT AS run, NULL::DOUBLE AS confidence FROM evals")
def eval_files(spark, d):
    """Every eval through files of JSON lines."""
    path = f"{Stages(spark, 'files').root}/evals"
    tables.write_records(table(spark, d, "evals").selectExpr("cast(id as string) as eval_id", "paper_id", "concat('T ', decision) as title", "decision", "score", "run_id as run"), path)
    return tables.read_evals(spark, path).select(F.col("eval_id").cast("long").alias("eval_id"), "paper_id", "title", "decision", "score", "run", "confidence")


@query(ctes("ground_truth") + " SELECT paper_id, annotator_id, label, CASE WHEN paper_id % 3 > 0 THEN (paper_id % 10) / 10.0::DOUBLE END AS confidence, CASE WHEN paper_id % 2 = 0 THEN 'so, \"it\" is' ELSE '' END AS rationale FROM ground_truth")
def label_files(spark, d):
    """Every label through CSV files, with quotes, commas and numbers that are none."""
    path = f"{Stages(spark, 'files').root}/labels"
    rows = table(spark, d, "ground_truth").selectExpr("concat(' ', paper_id) as paper_id", "annotator_id", "concat(label, ' ') as label", "case when paper_id % 3 > 0 then cast((paper_id % 10) / 10.0 as string) else 'sure' end as confidence", "case when paper_id % 2 = 0 then 'so, \"it\" is' end as rationale")
    tables.write_csv(rows, path)
    return tables.read_ground_truth(spark, path)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, concat('T', doc_id) AS title, concat(source, ' Roe') AS authors, CASE WHEN doc_id % 9 <> 4 THEN (1990 + doc_id % 30)::INT END AS year, concat('J ', lang) AS publication_title, CASE WHEN doc_id % 9 = 4 THEN 'Field ''year'' is not an integer: ?' END AS error FROM documents")
def csv_files(spark, d):
    """Every document as a row of CSV files: rows are numbered in the order of files and lines, however they are read."""
    path = f"{Stages(spark, 'files').root}/rows"
    rows = _docs(spark, d).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    rows = rows.select(F.lit("article").alias("type"), F.lit("article").alias("entry_type"), F.concat(F.lit("Roe, "), "source").alias("author"), F.concat(F.lit("T"), "doc_id").alias("title"), F.when(F.col("doc_id") % 9 == 4, "?").otherwise((1990 + F.col("doc_id") % 30).cast("string")).alias("year"),
                       F.concat(F.lit("J "), "lang").alias("journal"), F.lit("B").alias("booktitle"), F.lit("line one\nline, two").alias("abstract"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"), F.lit("k").alias("keywords"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_csv(spark, path, "acm").select("seq", "title", "authors", "year", "publication_title", "error")


@query("SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id % 2, doc_id) - 1 AS seq, concat('query', doc_id % 3) AS query, CASE WHEN doc_id % 2 = 0 THEN 'ACM' ELSE 'IEEE' END AS platform, concat('k', doc_id) AS cite_key, concat('T ', lang, ' ', doc_id) AS title, (2000 + doc_id % 20)::INT AS year FROM documents")
def folder_files(spark, d):
    """Every document as an entry of BibTeX files in folders of queries."""
    root = f"{Stages(spark, 'files').root}/folders"
    entry = F.concat(F.lit("@article{k"), "doc_id", F.lit(",\n  title = {T "), "lang", F.lit(" "), "doc_id", F.lit("},\n  author = {Roe, A},\n  journal = {J},\n  year = {"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("}\n}\n"))
    rows = _docs(spark, d).select((F.col("doc_id") % 3).alias("q"), (F.col("doc_id") % 2).alias("p"), "doc_id", entry.alias("value"))
    whole = rows.groupBy("q", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "value"))), lambda x: x["value"]), "\n").alias("value"))  # a file each
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{root}/other")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for q in range(3):
        for p, name in enumerate(("acm", "ieee")):
            path = f"{root}/query{q}/{name}"
            whole.where((F.col("q") == q) & (F.col("p") == p)).select("value").coalesce(1).write.text(path)
            folder = jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(conf)
            for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")):
                fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/query{q}/{name}.bib"))
            fs.delete(folder, True)
    found = bibtex.read_query_folders(spark, root)
    return found.join(bibtex.papers(found).select("seq", F.col("title").alias("of_paper"), F.col("year").alias("of_year")), "seq").select("seq", "query", "platform", "cite_key", F.col("of_paper").alias("title"), F.col("of_year").alias("year"))


@query(ctes("papers") + " SELECT id AS paper_id, coalesce(doi, '') AS doi, title, '' AS annotator_id, '' AS label, '' AS confidence, '' AS rationale FROM papers")
def annotator_sheet(spark, d):
    return tables.annotator_sheet(table(spark, d, "papers"))


@query(ctes("reference_lists") + " SELECT ref_doi, ref_title, ref_year, source, status, CASE status WHEN 'pending' THEN 'not yet processed' WHEN 'fetch_error' THEN 'both sources failed (404/error on Crossref and OpenAlex)' ELSE 'no DOI and no title metadata to recover' END AS reason FROM reference_lists WHERE status <> 'resolved'")
def unresolved_sheet(spark, d):
    return tables.unresolved_sheet(table(spark, d, "reference_lists"))


# --- evals and screening --------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE 'm' END AS method, paper_id, decision, score FROM (SELECT doc_id, doc_id AS paper_id, CASE WHEN n_chars > 1000 THEN 'in-scope' ELSE 'hybrid' END AS decision, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents)")
def ingest_evals(spark, d):
    fields = {"paper_id": F.col("doc_id"), "method": F.when(F.col("doc_id") % 2 == 1, "m"), "decision": F.when(F.col("n_chars") > 1000, "in-scope").otherwise("hybrid"), "score": (F.col("n_chars") % 100) / 100.0}
    records = _docs(spark, d).select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVAL_RECORD], F.col("doc_id").alias("seq"))
    runs, evals, _ = upserts.ingest_evals(spark.createDataFrame([], TABLES["eval_runs"].schema), spark.createDataFrame([], TABLES["evals"].schema), records)
    return evals.join(runs.selectExpr("id as run_id", "method"), "run_id").select("method", "paper_id", "decision", "score")


def _model(system: str, title: str, abstract: str) -> str:
    """Answers by a rule, in place of a model: includes long abstracts and quotes their beginning."""
    return json.dumps({"decision": "INCLUDE" if len(abstract) > 1500 else None, "excerpt": abstract[:40] if len(abstract) % 2 else "nothing of the kind", "relevance_score": len(title) % 10 / 10})


@query(ctes("papers") + " SELECT id AS paper_id, CASE WHEN length(abstract) > 1500 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision, length(abstract) % 2 = 1 AS excerpt_verified FROM papers")
def screen_two(spark, d):
    papers = table(spark, d, "papers")
    out = screening.screen_two(papers.withColumn("abstract", F.replace(F.col("abstract"), F.lit("&"), F.lit("+"))), _model, 1)
    return out.select("paper_id", "decision", "excerpt_verified")


@query(ctes("papers", "evals") + " SELECT e.id AS eval_id, 'needs_review' AS verdict, (length(p.title) % 10) / 10.0::DOUBLE AS score FROM evals e JOIN papers p ON p.id = e.paper_id WHERE e.run_id = 1")
def judge_evals(spark, d):
    evals = table(spark, d, "evals").where("run_id = 1").withColumn("rationale", F.lit("r"))
    papers = table(spark, d, "papers").withColumn("title", F.replace(F.col("title"), F.lit("&"), F.lit("+")))
    rows = screening.judge(evals, papers, _judge, "rule")
    stored = upserts.upsert(spark.createDataFrame([], TABLES["llm_judge"].schema), rows.withColumn("created_at", F.lit(None).cast("timestamp")), ["eval_id", "judge_model", "judge_prompt_id"])
    return stored.select("eval_id", "verdict", "score")


def _judge(system: str, title: str, abstract: str) -> str:
    return json.dumps({"score": str(len(title) % 10 / 10), "verdict": "perhaps"})


@query(ctes("papers") + " SELECT id AS paper_id, length(concat('- ', CASE WHEN abstract = '' THEN title ELSE concat(title, chr(10), abstract) END))::DOUBLE AS n FROM papers WHERE id % 2 = 1")
def embed_missing(spark, d):
    papers = table(spark, d, "papers")
    have = papers.where("id % 2 = 0").selectExpr("id as paper_id", "'m' as model_name", "array(cast(1 as float)) as embedding")
    out = screening.embed(papers, have, lambda texts: [[float(len(t))] for t in texts], "m")
    return out.select("paper_id", F.col("embedding")[0].cast("double").alias("n"))


@query(ctes("papers") + " SELECT doi, title, abstract = '' AS bare, authors FROM papers UNION ALL SELECT concat('10.9/', id), 'New', false, authors FROM papers WHERE id % 2 = 0")
def insert_unknown(spark, d):
    """Every paper again, under another title: known DOIs change nothing; half of the papers under a DOI that is new."""
    p = table(spark, d, "papers").select("id", "title", "authors", "year", "abstract", "publication_title", "doi", "keywords")
    again = p.where("doi is not null").withColumn("title", F.lit("Other")).withColumnRenamed("id", "seq")
    new = p.where("id % 2 = 0").withColumns({"doi": F.concat(F.lit(" 10.9/"), "id", F.lit(" ")), "title": F.lit("New"), "abstract": F.lit("a")}).withColumnRenamed("id", "seq")
    return upserts.insert_paper(upserts.insert_paper(p, again), new).select("doi", "title", (F.col("abstract") == "").alias("bare"), "authors")


@query(ctes("papers") + " SELECT id, doi, title, year FROM papers WHERE doi IS NOT NULL AND id % 4 <> 0 UNION ALL SELECT (SELECT max(id) FROM papers WHERE doi IS NOT NULL) + row_number() OVER (ORDER BY doi), doi, title, year + 1 FROM papers WHERE doi IS NOT NULL AND id % 4 = 0")
def replaced_with_new_ids(spark, d):
    """Every fourth paper replaced, of two rows for a key the later; replaced rows get the next free ids."""
    p = table(spark, d, "papers").where("doi is not null").select("id", "doi", "title", "year")
    fourth = p.where("id % 4 = 0")
    new = fourth.withColumns({"year": F.lit(7), "n": F.lit(1)}).unionByName(fourth.withColumns({"year": F.col("year") + 1, "n": F.lit(2)})).drop("id")
    return upserts.upsert(p, new, ["doi"], "n", keep_id=False).select("id", "doi", "title", "year")


@query(ctes("papers") + " SELECT id, doi, year FROM papers WHERE doi IS NOT NULL AND id % 4 <> 0 UNION ALL SELECT id, doi, year + 1 FROM papers WHERE doi IS NOT NULL AND id % 4 = 0 UNION ALL SELECT (SELECT max(id) FROM papers WHERE doi IS NOT NULL) + row_number() OVER (ORDER BY doi), concat(doi, '/new'), year FROM papers WHERE doi IS NOT NULL AND id % 5 = 0")
def replaced_with_ids(spark, d):
    """Every fourth paper replaced under its id, every fifth added under a new key."""
    p = table(spark, d, "papers").where("doi is not null").select("id", "doi", "year")
    new = p.where("id % 4 = 0").selectExpr("doi", "year + 1 as year", "1 as n").union(p.where("id % 5 = 0").selectExpr("concat(doi, '/new')", "year", "1"))
    return upserts.upsert(p, new, ["doi"], "n").select("id", "doi", "year")


@query(ctes("papers") + " SELECT year, count(*) AS n_papers FROM papers WHERE year > 0 GROUP BY year")
def prepared_by_year(spark, d):
    return readonly.execute(spark, next(iter(readonly.prepared("corpus by year").values())), {"papers": table(spark, d, "papers")})


@query(ctes("papers") + " SELECT id FROM papers WHERE id IN (3, 5, 8)")
def seeds_by_id(spark, d):
    return citations.seeds(table(spark, d, "papers"), table(spark, d, "paper_queries"), citations.parse_ids("5; 3,8,3"), [1]).select("id")


@query("SELECT vec_id AS paper_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id = 3")
def embedding_lookup(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id as paper_id", "'m' as model_name", "embedding")
    return lookups.embedding(e, 3, "m").select(F.lit(3).cast("long").alias("paper_id"), F.col("embedding").cast("array<double>").alias("embedding"))


# --- citations ------------------------------------------------------------------------------------------------------

_FETCHED = "SELECT concat('10.1000/AB', parent_paper_id) AS parent_doi, ref_index, id, ref_doi AS doi, ref_title AS title, '' AS authors, ref_year AS year, '' AS unstructured FROM reference_lists"


@query(ctes("papers", "reference_lists") + f", {_KEYS}, known AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT count(*) AS references_harvested, count(known.paper_id) AS local_hits FROM reference_lists r JOIN papers p ON p.id = r.parent_paper_id AND p.doi IS NOT NULL LEFT JOIN known ON known.ref_id = r.id")
def harvest_counts(spark, d):
    table(spark, d, "reference_lists").createOrReplaceTempView("reference_lists")
    fetched = spark.sql(_FETCHED).withColumn("ref_index", F.col("id").cast("int")).drop("id")
    papers = table(spark, d, "papers")
    lists, edges = spark.createDataFrame([], TABLES["reference_lists"].schema), spark.createDataFrame([], TABLES["snowball_edges"].schema)
    return citations.harvest(papers, papers, fetched, lists, edges)[2]


def _harvested(spark, d):
    table(spark, d, "reference_lists").createOrReplaceTempView("reference_lists")
    fetched = spark.sql(_FETCHED).withColumn("ref_index", F.col("id").cast("int")).drop("id").withColumn("unstructured", F.concat(F.lit("u"), "ref_index"))
    papers = table(spark, d, "papers")
    lists, edges = spark.createDataFrame([], TABLES["reference_lists"].schema), spark.createDataFrame([], TABLES["snowball_edges"].schema)
    return citations.harvest(papers, papers, fetched, lists, edges)


_SEEDED = ctes("papers", "reference_lists") + f", {_KEYS}, known AS (SELECT * FROM a UNION ALL SELECT * FROM b), h AS (SELECT r.*, known.paper_id AS found FROM reference_lists r JOIN papers p ON p.id = r.parent_paper_id AND p.doi IS NOT NULL LEFT JOIN known ON known.ref_id = r.id)"


@query(_SEEDED + " SELECT parent_paper_id, 'backward' AS direction, id::INT AS ref_index, " + _DOI.format("ref_doi") + " AS ref_doi, ref_title, ref_year, concat('u', id) AS ref_unstructured, found AS resolved_paper_id, 'crossref' AS source, CASE WHEN found IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM h")
def harvested_lists(spark, d):
    """The reference lists that a harvest of all papers leaves."""
    return _harvested(spark, d)[0].select("parent_paper_id", "direction", "ref_index", "ref_doi", "ref_title", "ref_year", "ref_unstructured", "resolved_paper_id", "source", "status")


@query(_SEEDED + " SELECT DISTINCT found AS child_paper_id, parent_paper_id, 1::INT AS depth FROM h WHERE found IS NOT NULL AND found <> parent_paper_id")
def harvested_edges(spark, d):
    """The edges that a harvest of all papers leaves."""
    return _harvested(spark, d)[1].select("child_paper_id", "parent_paper_id", "depth")


@query(ctes("reference_lists") + " SELECT id, CASE WHEN status = 'fetch_error' OR id % 5 = 0 AND status <> 'resolved' THEN 'pending' ELSE status END AS status FROM reference_lists")
def retried(spark, d):
    """Failed references, by DOI or by title, set back for another round."""
    lists = table(spark, d, "reference_lists").withColumn("status", F.expr("case when id % 5 = 0 and status <> 'resolved' then 'unresolved_title_failed' else status end"))
    return citations.retry(lists).select("id", "status")


_ORDER = ("zotero", "openalex", "crossref", "semantic_scholar")
#: Which source answers a DOI: the first in turn that has a work with an abstract of an even length.
_TURNS = ctes("reference_lists", "works") + f""", a AS (SELECT DISTINCT {_DOI.format('ref_doi')} AS k FROM reference_lists WHERE {_DOI.format('ref_doi')} IS NOT NULL),
w AS (SELECT DISTINCT a.k, list_position(['zotero', 'openalex', 'crossref', 'semantic_scholar'], works.source) - 1 AS turn, works.title, works.abstract FROM a JOIN works ON lower(works.doi) = a.k WHERE length(works.abstract) % 2 = 0 AND works.source <> 'openalex'),
f AS (SELECT k, min(turn) AS turn FROM w GROUP BY k)"""


def _in_turn(spark, d):
    every = table(spark, d, "works")
    source = lambda name: lambda asked: every.where(F.col("source") == name).withColumn("k", X.normalise_doi("doi")).join(asked.select(F.col("doi").alias("k")), "k", "left_semi").drop("k", "source")
    return citations.ask_in_turn(table(spark, d, "reference_lists").select(F.col("ref_doi").alias("doi")), {n: source(n) for n in _ORDER}, _ORDER, works.BATCH, F.length("abstract") % 2 == 0, throttled=("openalex",))


@query(_TURNS + " SELECT w.k, CASE w.turn WHEN 0 THEN 'zotero' WHEN 2 THEN 'crossref' ELSE 'semantic_scholar' END AS source, w.title, w.abstract FROM f JOIN w ON w.k = f.k AND w.turn = f.turn")
def works_in_turn(spark, d):
    """A work for each reference's DOI from the first source that has a fitting one; one source is throttled."""
    return _in_turn(spark, d)[0].select("k", "source", "title", "abstract")


@query(_TURNS + """, n AS (SELECT s.turn, s.source, s.size, (SELECT count(*) FROM a) - (SELECT count(*) FROM f WHERE f.turn < s.place) AS asked, (SELECT count(*) FROM f WHERE f.turn = s.place) AS found FROM (VALUES (0, 0, 'zotero', 50), (1, 2, 'crossref', 50), (2, 3, 'semantic_scholar', 100)) s(turn, place, source, size))
SELECT turn, source, asked, ((asked + size - 1) // size)::BIGINT AS calls, found FROM n""")
def calls_in_turn(spark, d):
    """How many DOIs and calls each source got."""
    return _in_turn(spark, d)[1]


def _expanded(spark, d):
    edges = table(spark, d, "edges").selectExpr("cast(child_paper_id as bigint) as id", "child_paper_id", "parent_paper_id", "depth")
    return citations.expand(table(spark, d, "reference_lists"), table(spark, d, "papers"), edges, table(spark, d, "works"), table(spark, d, "candidates"))


#: Works of a DOI by the order of asking (local library, chosen source, its alternate), then titles that match.
_FOUND = ctes("papers", "reference_lists", "works", "candidates", "edges") + f""", k AS (SELECT *, {_DOI.format('ref_doi')} AS d FROM reference_lists),
w AS (SELECT lower(doi) AS d, arg_min(title, array_position(['zotero', 'crossref', 'openalex'], source)) AS title FROM works WHERE source IN ('zotero', 'crossref', 'openalex') GROUP BY 1),
f AS (SELECT k.id, k.parent_paper_id, k.resolved_paper_id, CASE WHEN k.resolved_paper_id IS NOT NULL THEN 'resolved' WHEN k.ref_doi IS NOT NULL THEN CASE WHEN w.d IS NOT NULL THEN 'resolved' ELSE 'fetch_error' END
        WHEN trim(k.ref_title) = '' THEN 'unresolved_no_doi' WHEN c.ref_id IS NOT NULL THEN 'resolved' ELSE 'unresolved_title_failed' END AS status,
      lower(trim(regexp_replace(CASE WHEN k.resolved_paper_id IS NOT NULL THEN (SELECT p.title FROM papers p WHERE p.id = k.resolved_paper_id) WHEN k.ref_doi IS NOT NULL THEN w.title WHEN trim(k.ref_title) <> '' THEN c.work_title END, '\\s+', ' ', 'g'))) AS title_key
    FROM k LEFT JOIN w ON w.d = k.d LEFT JOIN candidates c ON c.ref_id = k.id AND c.source = 'crossref')"""


@query(_FOUND + " SELECT id, status, title_key FROM f")
def resolve_references(spark, d):
    r = _expanded(spark, d)
    return r.lists.join(r.papers.select(F.col("id").alias("resolved_paper_id"), X.normalise_title("title").alias("title_key")), "resolved_paper_id", "left").select("id", "status", "title_key")


@query(_FOUND + """, n AS (SELECT DISTINCT title_key FROM f WHERE resolved_paper_id IS NULL AND status = 'resolved'), p AS (SELECT title_key FROM n WHERE title_key NOT IN (SELECT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) FROM papers)),
e AS (SELECT DISTINCT title_key, parent_paper_id FROM f WHERE resolved_paper_id IS NULL AND status = 'resolved') SELECT (SELECT count(*) FROM papers) + (SELECT count(*) FROM p) AS papers, (SELECT count(*) FROM edges) + (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM p) AS new_papers""")
def citation_growth(spark, d):
    r = _expanded(spark, d)
    return r.papers.agg(F.count("*").alias("papers")).crossJoin(F.broadcast(r.edges.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(r.new_papers.agg(F.count("*").alias("new_papers"))))  # one row each


_LATE = """SELECT id AS ref_id, id AS work_id, concat('  ', title, '!') AS work_title, CAST(NULL AS INT) AS work_year, CAST(2 AS INT) AS rank, 'crossref' AS source, concat('10.2/X', id) AS doi, concat(' found ', id) AS abstract FROM papers WHERE length(title) BETWEEN 20 AND 150 AND id % 2 = 1
    UNION ALL SELECT id, id + 1000000, title, CAST(NULL AS INT), CAST(1 AS INT), 'openalex', CAST(NULL AS STRING), 'too late' FROM papers"""


@query(ctes("papers") + """, w AS (SELECT lower(doi) AS d, CASE WHEN id % 2 = 0 THEN concat('crossref ', id) ELSE concat('openalex ', id) END AS a FROM papers WHERE doi IS NOT NULL AND id % 5 <> 0), g AS (SELECT *, abstract = '' AND doi IS NULL AS lacking, length(title) BETWEEN 20 AND 150 AND id % 2 = 1 AS first FROM papers)
SELECT g.id, md5(CASE WHEN abstract <> '' THEN abstract WHEN NOT lacking THEN coalesce(w.a, '') WHEN first THEN concat('found ', id) END) AS abstract_md5,
    CASE WHEN lacking AND first THEN concat('10.2/x', id) ELSE doi END AS doi FROM g LEFT JOIN w ON w.d = lower(g.doi) WHERE NOT lacking OR first""")
def backfill_by_title(spark, d):
    p = table(spark, d, "papers")
    p.createOrReplaceTempView("papers")
    found = p.where("doi is not null and id % 5 <> 0").selectExpr("doi", "concat('openalex ', id) as abstract", "'openalex' as source")
    found = found.union(p.where("doi is not null and id % 5 <> 0 and id % 2 = 0").selectExpr("upper(doi)", "concat('crossref ', id)", "'crossref'"))
    out = citations.backfill_chain(p, found, spark.sql(_LATE))
    return out.join(p.select("id", F.col("abstract").alias("was"), F.col("doi").alias("had"), F.length("title").between(20, 150).alias("short")), "id").where("was <> '' or had is not null or (short and id % 2 = 1)").select("id", F.md5("abstract").alias("abstract_md5"), "doi")


@query("SELECT 1 AS id, 'backward' AS direction, 'crossref' AS source, count(*)::INTEGER AS seed_count, 7 AS references_harvested, 0 AS new_papers, NULL AS note FROM documents UNION ALL SELECT 2, 'resolve', 'openalex', 0, 0, 3, 'aborted'")
def run_log(spark, d):
    runs = citations.log_run(spark.createDataFrame([], TABLES["snowball_runs"].schema), "backward", "crossref", _docs(spark, d).count(), {"references_harvested": 7})
    runs = citations.log_run(runs, "resolve", "openalex", 0, {"new_papers": 3}, "aborted")
    return runs.select("id", "direction", "source", "seed_count", "references_harvested", "new_papers", "note")


@query(ctes("papers") + ", f AS (SELECT id, abstract, doi FROM papers) SELECT id, md5(CASE WHEN abstract = '' THEN concat('late ', id) ELSE abstract END) AS abstract_md5, coalesce(doi, CASE WHEN id % 2 = 0 THEN concat('10.3/', id) END) AS doi FROM f")
def fill_missing(spark, d):
    p = table(spark, d, "papers")
    found = p.selectExpr("id as paper_id", "'' as abstract", "if(id % 2 = 0, concat('10.3/', id), null) as doi", "0 as rank").union(p.selectExpr("id", "concat('late ', id)", "'10.1000/ab1'", "1"))
    return identity.fill_missing(p, found).select("id", F.md5("abstract").alias("abstract_md5"), "doi")


# --- tables of earlier layouts --------------------------------------------------------------------------------------

_FIRST = """SELECT id, CASE id % 6 WHEN 0 THEN 'ACM digital library' WHEN 1 THEN 'ieee xplore' WHEN 2 THEN 'Springer Link' WHEN 3 THEN 'google scholar' WHEN 4 THEN 'Semantic things' ELSE 'other-PLACE 2nd' END AS platform FROM queries"""


@query(ctes("papers", "queries") + f", q AS ({_FIRST}) SELECT p.id AS paper_id, q.id AS query_id, CASE q.id % 6 WHEN 0 THEN 'ACM' WHEN 1 THEN 'IEEE' WHEN 2 THEN 'Springer' WHEN 5 THEN 'Other-Place 2Nd' ELSE 'Semantic Scholar' END AS source FROM papers p JOIN q ON q.id = p.id % 20 WHERE p.id % 7 <> 0")
def first_layout(spark, d):
    papers = table(spark, d, "papers").withColumn("query_id", F.when(F.col("id") % 7 != 0, F.col("id") % 20))
    table(spark, d, "queries").createOrReplaceTempView("queries")
    queries = spark.sql(_FIRST)
    known = from_first_layout(papers.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi"), queries)
    named = known["paper_sources"].join(known["sources"].selectExpr("id as source_id", "name as source"), "source_id")
    return known["paper_queries"].join(named, "paper_id").select("paper_id", "query_id", "source")


@query(ctes("reference_lists") + " SELECT id, 'pending' AS status, CASE WHEN resolved_paper_id IS NULL THEN 'pending' ELSE 'resolved' END AS status_resolved FROM reference_lists")
def migrated_references(spark, d):
    now, _ = migrate({"papers": table(spark, d, "papers"), "reference_lists": table(spark, d, "reference_lists").drop("status")}, spark)
    lists = now["reference_lists"].withColumn("was", F.col("status"))
    return citations.sync_status(lists).selectExpr("id", "was as status", "status as status_resolved")
