"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.functions import text as X
from screenlake.functions.topic import STUDY, Topic, classify, forms, keyword_scores, signals
from screenlake.operators import citations, identity, lookups, metrics, reports, scoring, screening, upserts
from screenlake.plans import sql as readonly
from screenlake.plans.standin import ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A topic out of words that the documents have.
TOPIC = Topic({"the": ("core", 2.0), "this": ("core", 1.0), "for the": ("core", 3.0), "worthless": ("other", 2.5), "leaux": ("other", 1.5)}, ("that", "worthless"), ("with", "les"))


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c.name, places).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


# --- reports --------------------------------------------------------------------------------------------------------


@query(ctes("sources", "paper_sources") + " SELECT s.name AS source, count(DISTINCT l.paper_id) AS n_papers FROM sources s JOIN paper_sources l ON l.source_id = s.id GROUP BY s.name")
def corpus_by_source(spark, d):
    return reports.by_source(table(spark, d, "sources"), table(spark, d, "paper_sources"))


@query(ctes("sources", "paper_sources") + ", s AS (SELECT id, name FROM sources UNION ALL SELECT -1, 'no papers') SELECT s.name AS source, count(DISTINCT l.paper_id) AS n_papers FROM s LEFT JOIN paper_sources l ON l.source_id = s.id GROUP BY s.name")
def source_counts_with_zeros(spark, d):
    extra = spark.range(1).selectExpr("-1L as id", "'no papers' as name")
    return reports.by_source(table(spark, d, "sources").union(extra), table(spark, d, "paper_sources"), zeros=True)


_CATEGORY = "CASE WHEN contains(lower(s.name), 'snowball') THEN 'snowball' WHEN lower(s.name) LIKE 'query%' OR lower(s.name) IN ('acm', 'ieee', 'springer', 'semantic scholar') THEN 'database_query' ELSE 'other' END"


@query(ctes("sources", "paper_sources") + f" SELECT category, sum(n)::BIGINT AS n_links, any_value(p) AS n_papers FROM (SELECT {_CATEGORY} AS category, s.id, count(DISTINCT l.paper_id) AS n FROM sources s JOIN paper_sources l ON l.source_id = s.id GROUP BY 1, 2) a "
       f"JOIN (SELECT {_CATEGORY} AS category, count(DISTINCT l.paper_id) AS p FROM sources s JOIN paper_sources l ON l.source_id = s.id GROUP BY 1) b USING (category) GROUP BY category")
def corpus_by_category(spark, d):
    return reports.by_category(table(spark, d, "sources"), table(spark, d, "paper_sources"))


@query(ctes("paper_sources") + " SELECT count(DISTINCT paper_id) AS n FROM paper_sources")
def distinct_total(spark, d):
    return reports.papers_total(table(spark, d, "paper_sources"))


@query(ctes("paper_sources") + " SELECT count(*) AS n FROM (SELECT paper_id FROM paper_sources GROUP BY paper_id HAVING count(DISTINCT source_id) > 1)")
def multi_source_count(spark, d):
    return reports.multi_source(table(spark, d, "paper_sources"))


@query(ctes("paper_sources") + " SELECT paper_id, count(*) AS n FROM paper_sources GROUP BY paper_id ORDER BY n DESC, paper_id LIMIT 10")
def top_sourced(spark, d):
    return reports.top_sourced(table(spark, d, "paper_sources"), 10)


@query(ctes("papers") + " SELECT year, count(*) AS n_papers FROM papers GROUP BY year")
def year_histogram(spark, d):
    return reports.by_year(table(spark, d, "papers"))


@query(ctes("papers") + " SELECT year, count(*) AS n_papers FROM papers WHERE year > 0 GROUP BY year")
def year_histogram_known(spark, d):
    return reports.by_year(table(spark, d, "papers"), unknown=False)


@query(ctes("papers") + " SELECT coalesce(relevance_class, 'unlabeled') AS relevance_class, count(*) AS n_papers FROM papers GROUP BY 1")
def relevance_distribution(spark, d):
    return reports.relevance(table(spark, d, "papers"))


@query(ctes("papers") + " SELECT CASE WHEN relevance_class = 'in-scope' THEN 'include' ELSE 'exclude' END AS binary_class, count(*) AS n_papers FROM papers GROUP BY 1")
def binary_distribution(spark, d):
    return reports.binary(table(spark, d, "papers"))


@query(ctes("reference_lists") + " SELECT status, count(*) AS n FROM reference_lists GROUP BY status")
def status_counts(spark, d):
    return reports.statuses(table(spark, d, "reference_lists"))


@query(ctes("edges") + " SELECT count(*) AS edges, count(DISTINCT child_paper_id) AS discovered, max(depth) AS max_depth FROM edges")
def edge_totals(spark, d):
    return reports.edge_totals(table(spark, d, "edges"))


@query(ctes("papers", "evals") + " SELECT count(*) AS total_papers, count(is_relevant) AS evaluated, count(*) FILTER (is_relevant) AS relevant, count(*) FILTER (NOT is_relevant) AS irrelevant, count(*) FILTER (is_relevant IS NULL) AS unevaluated, (SELECT max(id) FROM evals) AS last_evaluated FROM papers")
def relevance_totals(spark, d):
    return reports.relevance_totals(table(spark, d, "papers"), table(spark, d, "evals").withColumnRenamed("id", "evaluated_at"))


_RESOLVED = "(SELECT count(*) FROM reference_lists r JOIN papers p ON p.id = r.resolved_paper_id WHERE r.status = 'resolved' AND coalesce(p.{0}, '') = '') AS resolved_missing_{0}"


@query(ctes("papers", "reference_lists") + f""" SELECT count(*) AS papers_total, count(*) FILTER (coalesce(abstract, '') = '') AS papers_missing_abstract, count(*) FILTER (coalesce(title, '') = '') AS papers_missing_title,
    {_RESOLVED.format('abstract')}, {_RESOLVED.format('title')} FROM papers""")
def coverage(spark, d):
    return citations.coverage(table(spark, d, "papers"), table(spark, d, "reference_lists"))


@query(ctes("evals") + " SELECT concat('m', run_id) AS method, decision, count(*) AS n_papers FROM evals GROUP BY 1, 2")
def method_decisions(spark, d):
    return reports.by_method(table(spark, d, "evals").withColumn("method", F.concat(F.lit("m"), "run_id")))


@query(ctes("gold") + " SELECT consensus_label, count(*) AS n_papers FROM gold GROUP BY 1")
def consensus_labels(spark, d):
    return reports.consensus_labels(table(spark, d, "gold"))


@query(ctes("papers", "edges", "evals") + " SELECT 'papers' AS name, count(*) AS n FROM papers UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'evals', count(*) FROM evals")
def dashboard(spark, d):
    return reports.dashboard({n: table(spark, d, n) for n in ("papers", "edges", "evals")})


def _near(me: str, other: str) -> str:
    return f"(SELECT string_agg(x, ',' ORDER BY k) FROM (SELECT DISTINCT e.{other} AS k, concat(e.{other}, ':', e.depth, ':', coalesce(md5(q.title), '')) AS x FROM edges e LEFT JOIN papers q ON q.id = e.{other} WHERE e.{me} = p.id))"


@query(ctes("papers", "edges", "queries", "paper_queries") + f""" SELECT p.id, true AS found, p.title, {_near('child_paper_id', 'parent_paper_id')} AS parents, {_near('parent_paper_id', 'child_paper_id')} AS children,
    (SELECT string_agg(DISTINCT q.query_text, ',' ORDER BY q.query_text) FROM paper_queries l JOIN queries q ON q.id = l.query_id WHERE l.paper_id = p.id) AS sources FROM papers p UNION ALL SELECT -1, false, NULL, NULL, NULL, NULL""")
def provenance(spark, d):
    links = table(spark, d, "paper_queries").selectExpr("paper_id", "query_id as source_id")
    sources = table(spark, d, "queries").selectExpr("id", "query_text as name")
    papers = table(spark, d, "papers")
    asked = papers.select("id").union(spark.range(1).selectExpr("-1L"))
    p = reports.provenance(papers, sources, links, table(spark, d, "queries"), table(spark, d, "paper_queries"), table(spark, d, "edges"), asked)
    near = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["paper_id"], x["depth"], F.coalesce(F.md5(x["title"]), F.lit("")))), ",").alias(c)
    return p.select("id", "found", "title", near("parents"), near("children"), F.array_join("sources", ",").alias("sources"))


# --- lookups --------------------------------------------------------------------------------------------------------


@query(ctes("papers") + " SELECT id, title, authors, year, doi FROM papers ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 10")
def list_page(spark, d):
    return lookups.list_papers(table(spark, d, "papers"), 25, 10)


@query(ctes("papers") + " SELECT id, title, authors, year, doi FROM papers WHERE lower(title) LIKE '%the%in%' OR lower(abstract) LIKE '%the%in%' OR lower(authors) LIKE '%the%in%' ORDER BY created_at DESC, id DESC LIMIT 50")
def search_like(spark, d):
    return lookups.search(table(spark, d, "papers"), "the%in")


@query(ctes("papers") + " SELECT * FROM papers WHERE doi = '10.1000/ab100'")
def paper_by_doi(spark, d):
    return lookups.get_by_doi(table(spark, d, "papers"), " 10.1000/ab100 ")


@query(ctes("papers", "paper_queries") + " SELECT id, title FROM papers WHERE id IN (SELECT paper_id FROM paper_queries WHERE query_id IN (3, 5))")
def seeds_by_query(spark, d):
    return lookups.by_queries(table(spark, d, "papers"), table(spark, d, "paper_queries"), [3, 5]).select("id", "title")


@query(ctes("papers") + " SELECT 'relevant' AS kind, id FROM papers WHERE is_relevant UNION ALL SELECT 'irrelevant', id FROM papers WHERE NOT is_relevant UNION ALL SELECT 'unevaluated', id FROM papers WHERE is_relevant IS NULL")
def relevance_filters(spark, d):
    p = table(spark, d, "papers")
    parts = [lookups.by_relevance(p, k).select(F.lit(k).alias("kind"), "id") for k in ("relevant", "irrelevant", "unevaluated")]
    return parts[0].union(parts[1]).union(parts[2])


@query(ctes("reference_lists") + " SELECT id, ref_doi IS NOT NULL AND ref_doi <> '' AS with_doi FROM reference_lists WHERE resolved_paper_id IS NULL AND direction = 'backward'")
def unresolved_references(spark, d):
    r = table(spark, d, "reference_lists")
    return citations.unresolved(r, True, "backward").select("id", F.lit(True).alias("with_doi")).union(citations.unresolved(r, False, "backward").select("id", F.lit(False)))


@query(ctes("reference_lists") + " SELECT * FROM reference_lists WHERE parent_paper_id = 7")
def reference_inventory(spark, d):
    return citations.inventory(table(spark, d, "reference_lists"), 7)


@query(ctes("papers", "queries", "paper_queries") + """ SELECT p.id, string_agg(DISTINCT q.query_text, ',' ORDER BY q.query_text) AS source_names, string_agg(DISTINCT q.platform, ',' ORDER BY q.platform) AS platforms
    FROM papers p LEFT JOIN paper_queries l ON l.paper_id = p.id LEFT JOIN queries q ON q.id = l.query_id GROUP BY p.id""")
def detail_listagg(spark, d):
    q, l = table(spark, d, "queries"), table(spark, d, "paper_queries")
    return lookups.detail(table(spark, d, "papers"), q.selectExpr("id", "query_text as name"), l.selectExpr("paper_id", "query_id as source_id"), q, l).select("id", "source_names", "platforms")


@query(ctes("papers", "edges") + " SELECT e.child_paper_id, c.title AS child_title, e.parent_paper_id, p.title AS parent_title, e.depth FROM edges e JOIN papers c ON c.id = e.child_paper_id JOIN papers p ON p.id = e.parent_paper_id")
def edge_titles(spark, d):
    return lookups.edge_titles(table(spark, d, "edges"), table(spark, d, "papers"))


@query(ctes("edges") + " SELECT parent_paper_id AS paper_id FROM edges WHERE child_paper_id = 57 UNION SELECT child_paper_id FROM edges WHERE parent_paper_id = 7")
def neighbours_union(spark, d):
    e = table(spark, d, "edges")
    return lookups.neighbours(e.where("child_paper_id = 57"), 57).union(lookups.neighbours(e.where("parent_paper_id = 7"), 7)).distinct()


@query(ctes("papers") + " SELECT doi FROM papers WHERE doi IS NOT NULL")
def known_dois(spark, d):
    return lookups.dois(table(spark, d, "papers"))


@query(ctes("reference_lists") + " SELECT doi, min(id) AS seq FROM (SELECT id, nullif(trim(lower(regexp_replace(trim(ref_doi), '^(https?://(dx\\.)?doi\\.org/|doi:)', '', 'i'))), '') AS doi FROM reference_lists) WHERE doi IS NOT NULL GROUP BY doi")
def distinct_dois(spark, d):
    return identity.distinct_dois(table(spark, d, "reference_lists"), "ref_doi", "id")


# --- text -----------------------------------------------------------------------------------------------------------

_PRE = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_PRE} AS clean FROM documents")
def preprocess(spark, d):
    return _docs(spark, d).select("doc_id", X.preprocess("text").alias("clean"))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query(f"WITH t AS (SELECT doc_id, list_filter(string_split({_PRE}, ' '), lambda x: x <> '') AS w FROM documents) SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM t) GROUP BY term")
def document_frequency(spark, d):
    return scoring.corpus_statistics(_docs(spark, d), "doc_id", "text")[0]


@query(ctes("reference_lists") + r""", x AS (SELECT id, trim(ref_doi) AS t FROM reference_lists) SELECT id, nullif(trim(lower(regexp_replace(t, '^(https?://(dx\.)?doi\.org/|doi:)', '', 'i'))), '') AS doi FROM x""")
def doi_normalise(spark, d):
    return table(spark, d, "reference_lists").select("id", X.normalise_doi("ref_doi").alias("doi"))


@query(ctes("papers") + r""" SELECT id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS title_key, lower(regexp_replace(title, '\s+', '', 'g')) AS squashed FROM papers""")
def title_keys(spark, d):
    return table(spark, d, "papers").select("id", X.normalise_title("title").alias("title_key"), X.squash_title("title").alias("squashed"))


@query(ctes("papers") + " SELECT id, concat(publication_title, '') AS x, regexp_replace(authors, '^Roe, (.*) and (.*)$', '\\1 Roe; \\2') AS authors FROM papers")
def author_flip(spark, d):
    return table(spark, d, "papers").select("id", F.col("publication_title").alias("x"), X.normalise_authors("authors").alias("authors"))


@query(ctes("papers") + " SELECT id, array_to_string(list_filter(list_transform(string_split(keywords, ','), lambda k: trim(k)), lambda k: k <> ''), '; ') AS keywords FROM papers")
def keyword_list(spark, d):
    return table(spark, d, "papers").select("id", X.normalise_keywords("keywords").alias("keywords"))


_ENTITIES = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _a, _b in X.ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, regexp_replace(trim(regexp_replace({_ENTITIES}, '\s+', ' ', 'g')), ' ([.,;:!?])', '\1', 'g') AS plain FROM pages")
def strip_markup(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.strip_markup("html").alias("plain"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split({_PRE}, ' '), lambda x: x <> ''), ' ') AS plain FROM documents")
def inverted_index_text(spark, d):
    w = _docs(spark, d).select("doc_id", F.posexplode(X.tokens("text")).alias("p", "w"))
    index = w.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return _docs(spark, d).select("doc_id").join(index, "doc_id", "left").select("doc_id", X.inverted_index_text("m").alias("plain"))


_PLAIN = r"lower(trim(regexp_replace(translate({}, '“”‘’„‚«» ', '\"\"''''\"''\"\" '), '\s+', ' ', 'g')))".replace('\\"', '"')


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(" + _PLAIN.format("d.text") + ", " + _PLAIN.format(r"regexp_replace(b.text, '[\s.…]+$', '')") + ")")
def excerpt_in_order(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("excerpt"))
    return screening.find_excerpts(_docs(spark, d), items, "doc_id", "text", "item_id").withColumnRenamed("id", "doc_id")


#: Excerpts with an elision: two parts of each item in their order (kind 0) and the other way round (kind 1).
_ELIDED = "SELECT item_id * 2 AS part_id, concat(substr(text, 1, 90), ' [...] ', substr(text, 120, 70)) AS excerpt, substr(text, 1, 90) AS a, substr(text, 120, 70) AS b FROM benchmark UNION ALL " \
    "SELECT item_id * 2 + 1 AS part_id, concat(substr(text, 120, 70), ' ... ', substr(text, 1, 90)) AS excerpt, substr(text, 120, 70) AS a, substr(text, 1, 90) AS b FROM benchmark"


@query(f"WITH e AS ({_ELIDED}), p AS (SELECT part_id, {_PLAIN.format('a')} AS a, {_PLAIN.format('b').replace('translate(b', chr(116) + 'ranslate(regexp_replace(b, ' + chr(39) + '[' + chr(92) + 's.…]+$' + chr(39) + ', ' + chr(39) * 2 + ')')} AS b FROM e), "
       f"t AS (SELECT doc_id, {_PLAIN.format('text')} AS t FROM documents) SELECT doc_id, part_id FROM t JOIN p ON contains(t, a) AND contains(substr(t, instr(t, a) + length(a)), b)")
def excerpt_fragments(spark, d):
    spark.read.parquet(f"{d}/benchmark.parquet").createOrReplaceTempView("benchmark")
    return screening.find_excerpts(_docs(spark, d), spark.sql(_ELIDED).select("part_id", "excerpt"), "doc_id", "text", "part_id").withColumnRenamed("id", "doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_details(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(ctes("reference_lists") + " SELECT id, ref_doi, status, CASE status WHEN 'pending' THEN 'not yet processed' WHEN 'fetch_error' THEN 'both sources failed (404/error on Crossref and OpenAlex)' ELSE 'no DOI and no title metadata to recover' END AS reason FROM reference_lists WHERE status <> 'resolved'")
def unresolved_reasons(spark, d):
    return table(spark, d, "reference_lists").where("status <> 'resolved'").select("id", "ref_doi", "status", X.status_reason("status").alias("reason"))


@query(ctes("papers") + " SELECT id, CASE WHEN abstract = '' THEN title ELSE concat(title, chr(10), abstract) END AS whole FROM papers")
def embedding_text(spark, d):
    return table(spark, d, "papers").select("id", X.embedding_text(F.col("title"), F.col("abstract")).alias("whole"))


# --- scores ---------------------------------------------------------------------------------------------------------

_BM25 = f"""q(term, qtf) AS (VALUES ('the', 3), ('this', 1), ('for', 1), ('worthless', 1), ('leaux', 1)),
tk AS (SELECT doc_id, list_filter(string_split({_PRE}, ' '), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tk),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tk) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY doc_id),
b AS (SELECT doc_id, coalesce(s, 0.0) AS bm25 FROM documents LEFT JOIN bm USING (doc_id))"""

assert TOPIC.query_terms() == {"the": 2, "this": 1, "for": 1, "worthless": 1, "leaux": 1}
_BM25 = _BM25.replace("('the', 3)", "('the', 2)")
# keyword spans: 'for the' claims before 'this' and 'the'
_KW = f"""k0 AS (SELECT doc_id, text, CASE WHEN length(trim(text)) >= 20 THEN {_PRE} ELSE '' END AS m FROM documents),
k1 AS (SELECT doc_id, text, ' ' || replace(replace(m, ' ', '  '), '-', ' - ') || ' ' AS m FROM k0),
k2 AS (SELECT doc_id, text, regexp_replace(m, ' for  the(s|es)? ', ' # ', 'g') AS m2, m FROM k1),
kw AS (SELECT doc_id, text, (length(m2) - length(replace(m2, '#', ''))) * 3.0 + 2.5 * len(regexp_extract_all(m2, ' worthless(s|es)? ')) + 1.5 * len(regexp_extract_all(m2, ' leaux(s|es)? '))
      + 1.0 * len(regexp_extract_all(m2, ' this(s|es)? ')) + 2.0 * len(regexp_extract_all(m2, ' the(s|es)? ')) AS raw FROM k2)"""


@query(f"WITH {_BM25} SELECT doc_id AS id, round(bm25, 6) AS bm25 FROM b")
def bm25_scores(spark, d):
    return rounded(scoring.bm25(_docs(spark, d), TOPIC.query_terms(), "doc_id", "text"))


@query(f"WITH {_BM25} SELECT doc_id AS id, round(CASE WHEN (SELECT max(bm25) FROM b) > 0 THEN bm25 / (SELECT max(bm25) FROM b) ELSE 0 END, 6) AS bm25 FROM b")
def bm25_normalised(spark, d):
    return rounded(scoring.normalised(scoring.bm25(_docs(spark, d), TOPIC.query_terms(), "doc_id", "text"), "bm25"))


@query(f"WITH {_KW} SELECT doc_id, round(raw, 6)::DOUBLE AS keyword_raw, round(least(raw / 10.0, 1.0), 6)::DOUBLE AS keyword_score FROM kw")
def keyword_spans(spark, d):
    return rounded(keyword_scores(_docs(spark, d), "text", TOPIC).select("doc_id", "keyword_raw", "keyword_score"))


@query(f"WITH {_BM25}, {_KW} SELECT doc_id AS id, round(0.4 * least(raw / 10.0, 1.0) + 0.6 * bm25 / (SELECT max(bm25) FROM b), 6) AS score FROM kw JOIN b USING (doc_id)")
def hybrid_score(spark, d):
    papers = _docs(spark, d).selectExpr("doc_id as id", "text as abstract")
    return rounded(scoring.components(papers, "hybrid", topic=TOPIC).select("id", "score"))


_HAS = "len(list_filter(string_split(replace(replace({}, '-', ' '), '_', '_'), ' '), lambda x: regexp_full_match(x, '({})(s|es)?'))) > 0"


@query(f"WITH t AS (SELECT doc_id, n_chars, {_PRE} AS c FROM documents) SELECT doc_id, CASE WHEN {_HAS.format('c', 'that|worthless')} AND {_HAS.format('c', 'with|les')} THEN 'hybrid' WHEN {_HAS.format('c', 'that|worthless')} THEN 'in-scope' WHEN {_HAS.format('c', 'with|les')} THEN 'out-of-scope' WHEN n_chars >= 1000 THEN 'in-scope' ELSE 'out-of-scope' END AS label FROM t")
def classify_three(spark, d):
    return _docs(spark, d).select("doc_id", classify("text", F.col("n_chars").cast("double"), 1000.0, TOPIC).alias("label"))


#: Documents that speak of the study's topic: common words give way to its terms, some of which overlap.
_STUDY_TEXT = "text"
for _word, _term in ((" the ", " puf-based "), (" for ", " SRAM "), (" of ", " side-channels "), (" and ", " machine learning attacks, "), (" in ", " physical unclonable functions "), (" de ", " semi-invasive fault injection "), (" that ", " AI ")):
    _STUDY_TEXT = f"replace({_STUDY_TEXT}, '{_word}', '{_term}')"
_STUDY_DOCS = f"docs AS (SELECT doc_id, {_STUDY_TEXT} AS text FROM documents), "
_STUDY_BM25 = _STUDY_DOCS + (_BM25[: _BM25.index("(VALUES")] + "(VALUES " + ", ".join(f"('{t}', {n})" for t, n in STUDY.query_terms().items()) + ")" + _BM25[_BM25.index("),\ntk") + 1 :]).replace("FROM documents", "FROM docs")
_SPACED = f"' ' || replace(replace({_PRE}, ' ', '  '), '-', ' - ') || ' '"


def _study_keywords() -> str:
    """Each keyword in turn, the longest first, counted and masked."""
    sql, counts = [f"m0 AS (SELECT doc_id, CASE WHEN length(trim(text)) >= 20 THEN {_SPACED} ELSE '' END AS m FROM docs)"], []
    for i, k in enumerate(STUDY.by_length):
        pattern = forms(k)[0][:-1] + "(s|es)? "
        done = "".join(f", n{j}" for j in range(i))
        sql.append(f"m{i + 1} AS (SELECT doc_id, regexp_replace(m, '{pattern}', chr(1), 'g') AS m{done}, len(regexp_extract_all(m, '{pattern}')) AS n{i} FROM m{i})")
        counts.append((k, f"n{i} * {STUDY.keywords[k][1]}::DOUBLE"))
    raw = " + ".join(c for _, c in counts)
    matched = ", ".join(f"CASE WHEN n{i} > 0 THEN concat('{k}:', {c}) END" for i, (k, c) in enumerate(counts))
    return _STUDY_DOCS + ", ".join(sql) + f", kw AS (SELECT doc_id, {raw} AS raw, concat_ws(',', {matched}) AS matched FROM m{len(counts)})"


def _study(spark, d):
    return _docs(spark, d).selectExpr("doc_id", f"{_STUDY_TEXT} AS text", "n_chars")


@query(f"WITH {_study_keywords()} SELECT doc_id, round(raw, 6) AS keyword_raw, round(least(raw / {STUDY.most}, 1.0), 6)::DOUBLE AS keyword_score, matched FROM kw")
def study_keywords(spark, d):
    """The study's 29 keywords with their weights."""
    pairs = F.array_join(F.transform(F.map_entries("keyword_matched"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return rounded(keyword_scores(_study(spark, d), "text").select("doc_id", "keyword_raw", "keyword_score", pairs.alias("matched")))


@query(f"WITH {_STUDY_BM25} SELECT doc_id AS id, round(bm25, 6) AS bm25 FROM b".replace("FROM documents LEFT", "FROM docs LEFT"))
def study_bm25(spark, d):
    return rounded(scoring.bm25(_study(spark, d), STUDY.query_terms(), "doc_id", "text"))


_SIGNAL = lambda terms: "regexp_matches(c, '(" + "|".join(forms(t)[0][:-1] for t in terms) + ")(s|es)? ')"


@query(f"WITH {_STUDY_DOCS} s AS (SELECT doc_id, {_SPACED} AS c FROM docs) SELECT doc_id, {_SIGNAL(STUDY.physical)} AS physical, {_SIGNAL(STUDY.learning)} AS learning FROM s")
def study_signals(spark, d):
    found = signals(X.condensed(X.preprocess("text"), STUDY.vocabulary))
    return _study(spark, d).select("doc_id", found.alias("s")).select("doc_id", "s.physical", "s.learning")


@query(f"WITH {_study_keywords()}, {_STUDY_BM25[len(_STUDY_DOCS):]}, s AS (SELECT doc_id, {_SPACED} AS c FROM docs), h AS (SELECT doc_id, 0.4 * least(raw / {STUDY.most}, 1.0) + 0.6 * bm25 / (SELECT max(bm25) FROM b) AS score FROM kw JOIN b USING (doc_id))"
       f" SELECT doc_id AS paper_id, round(score, 6) AS score, score >= 0.29 AS is_relevant, CASE WHEN {_SIGNAL(STUDY.physical)} AND {_SIGNAL(STUDY.learning)} THEN 'hybrid' WHEN {_SIGNAL(STUDY.physical)} THEN 'in-scope' WHEN {_SIGNAL(STUDY.learning)} THEN 'out-of-scope' WHEN score >= 0.29 THEN 'in-scope' ELSE 'out-of-scope' END AS relevance_class FROM h JOIN s USING (doc_id)")
def study_evaluated(spark, d):
    """Scores and classes at the study's published threshold."""
    papers = _study(spark, d).selectExpr("doc_id as id", "text as abstract")
    return rounded(scoring.evaluate_corpus(papers, threshold=0.29).select("paper_id", "score", "is_relevant", "relevance_class"))


@query(f"WITH {_study_keywords()}, {_STUDY_BM25[len(_STUDY_DOCS):]} SELECT doc_id AS paper_id, round(0.4 * least(raw / {STUDY.most}, 1.0) + 0.6 * bm25 / (SELECT max(bm25) FROM b), 6) AS score, round(bm25 / (SELECT max(bm25) FROM b), 6) AS bm25_score FROM kw JOIN b USING (doc_id) WHERE doc_id % 2 = 0")
def study_by_statistics(spark, d):
    """Every second paper scored by the kept statistics of the whole corpus, without reading the others."""
    papers = _study(spark, d).selectExpr("doc_id as id", "text as abstract")
    return rounded(scoring.evaluate_corpus(papers.where("id % 2 = 0"), threshold=0.29, corpus=scoring.statistics(papers)).select("paper_id", "score", "bm25_score"))


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings")
def cosine_topic(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return rounded(scoring.cosine(e.selectExpr("vec_id as id"), e.selectExpr("vec_id as paper_id", "embedding"), e.where("vec_id = 0").select("embedding")))


def _sweep(value: str) -> str:
    return ctes("gold", "evals") + f""", p AS (SELECT score, CASE WHEN consensus_label = 'in-scope' THEN 1 ELSE 0 END AS y FROM evals JOIN gold USING (paper_id) WHERE run_id = 1 AND consensus_label <> 'disagree'),
g AS (SELECT least(0.0::DOUBLE, min(score) - 0.001::DOUBLE) AS a, greatest(1.0::DOUBLE, max(score) + 0.001::DOUBLE) AS b, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM p),
i AS (SELECT i, round(a + i * 0.01::DOUBLE, 10) AS t, pos, neg FROM g, unnest(range(0, greatest(1, ceil((b - a) / 0.01::DOUBLE)::BIGINT) + 1)) u(i)),
c AS (SELECT i, t, pos, neg, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp FROM i, p GROUP BY ALL)
SELECT round(t, 6) AS threshold, round(v, 6) AS value FROM (SELECT t, i, {value} AS v FROM c) ORDER BY v DESC, i LIMIT 1"""


def _pairs(spark, d):
    return table(spark, d, "evals").where("run_id = 1").select("paper_id", "score").join(scoring.gold(table(spark, d, "gold")), "paper_id").select("score", "y")


@query(_sweep("CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) END"))
def threshold_f1(spark, d):
    return rounded(scoring.sweep(_pairs(spark, d), [], "f1"))


@query(_sweep("tp / pos + (neg - fp) / neg - 1.0"))
def threshold_youden(spark, d):
    return rounded(scoring.sweep(_pairs(spark, d), [], "youden"))


def _best(criterion: str, value: str) -> str:
    return f"SELECT round, '{criterion}' AS criterion, arg_max(t, (v, -i)) AS threshold FROM (SELECT round, t, i, {value} AS v FROM swept) GROUP BY round"


_F1 = "CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) END"
_BOOTSTRAP = ctes("gold", "evals") + f""", l AS (SELECT paper_id, score, CASE WHEN consensus_label = 'in-scope' THEN 1 ELSE 0 END AS y FROM gold LEFT JOIN (SELECT paper_id, score FROM evals WHERE run_id = 1) USING (paper_id)
  WHERE consensus_label IN ('in-scope', 'out-of-scope', 'hybrid')),
nth AS (SELECT *, row_number() OVER (ORDER BY paper_id, score, y) - 1 AS nth FROM l), many AS (SELECT count(*) AS n FROM l),
drawn AS (SELECT DISTINCT r.round, ('0x' || substr(md5(concat('42:', r.round, ':', p.place)), 1, 12))::BIGINT % n AS nth FROM (SELECT unnest(range(1000)) AS round) r, (SELECT unnest(range(n)) AS place FROM many) p, many),
cells AS (SELECT round, score, y, count(*) AS times FROM drawn JOIN nth USING (nth) WHERE score IS NOT NULL GROUP BY ALL),
g AS (SELECT round, least(0.0::DOUBLE, min(score) - 0.001::DOUBLE) AS a, greatest(1.0::DOUBLE, max(score) + 0.001::DOUBLE) AS b, sum(y * times)::BIGINT AS pos, sum((1 - y) * times)::BIGINT AS neg FROM cells GROUP BY round HAVING pos > 0 AND neg > 0),
i AS (SELECT round, i, round(a + i * 0.01::DOUBLE, 10) AS t, pos, neg FROM g, unnest(range(0, greatest(1, ceil((b - a) / 0.01::DOUBLE)::BIGINT) + 1)) u(i)),
swept AS (SELECT i.round, i, t, pos, neg, coalesce(sum(times) FILTER (score >= t AND y = 1), 0)::BIGINT AS tp, coalesce(sum(times) FILTER (score >= t AND y = 0), 0)::BIGINT AS fp FROM i JOIN cells ON cells.round = i.round GROUP BY ALL),
best AS ({_best('f1', _F1)} UNION ALL {_best('youden', 'tp / pos + (neg - fp) / neg - 1.0::DOUBLE')})"""


@query(_BOOTSTRAP + """, s AS (SELECT criterion, list_sort(list(threshold)) AS t FROM best GROUP BY criterion),
q AS (SELECT criterion, len(t) AS n, t[floor(len(t) * 0.025)::INT + 1] AS low, t[floor(len(t) * 0.975)::INT + 1] AS high, t[floor(len(t) / 2)::INT + 1] AS median FROM s),
m AS (SELECT q.*, count(*) FILTER (coalesce(score, 0) >= median AND y = 1) AS tp, count(*) FILTER (coalesce(score, 0) >= median AND y = 0) AS fp, sum(y) AS pos FROM q, l GROUP BY ALL)
SELECT criterion, n::INT AS n, round(low, 6) AS low, round(high, 6) AS high, round(median, 6) AS median, round(tp / (tp + fp), 6) AS precision, round((tp / pos)::DOUBLE, 6) AS recall, round((2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos))::DOUBLE, 6) AS f1 FROM m""")
def bootstrap_intervals(spark, d):
    scores = table(spark, d, "evals").where("run_id = 1").selectExpr("paper_id as id", "score")
    gold = table(spark, d, "gold")
    return rounded(scoring.at_medians(scoring.intervals(scoring.bootstrap(scores, gold)), scores, gold))


@query()
def evaluate_hybrid(spark, d):
    papers = _docs(spark, d).selectExpr("doc_id as id", "text as abstract")
    return scoring.evaluate_corpus(papers, table(spark, d, "gold"), topic=TOPIC)


_EVALUATED = ctes("gold") + f""", {_BM25}, {_KW}, h AS (SELECT doc_id, text, 0.4 * least(raw / 10.0, 1.0) + 0.6 * bm25 / (SELECT max(bm25) FROM b) AS score FROM kw JOIN b USING (doc_id)),
p AS (SELECT score, CASE WHEN consensus_label = 'in-scope' THEN 1 ELSE 0 END AS y FROM h JOIN gold ON paper_id = doc_id WHERE consensus_label <> 'disagree'),
g AS (SELECT least(0.0::DOUBLE, min(score) - 0.001::DOUBLE) AS a, greatest(1.0::DOUBLE, max(score) + 0.001::DOUBLE) AS b, sum(y)::BIGINT AS pos FROM p),
i AS (SELECT i, round(a + i * 0.01::DOUBLE, 10) AS t, pos FROM g, unnest(range(0, greatest(1, ceil((b - a) / 0.01::DOUBLE)::BIGINT) + 1)) u(i)),
c AS (SELECT i, t, pos, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp FROM i, p GROUP BY ALL),
v AS (SELECT t FROM c ORDER BY CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) END DESC, i LIMIT 1), x AS (SELECT doc_id, score, t, {_PRE} AS c FROM h, v)
SELECT doc_id AS paper_id, score >= t AS is_relevant, round(t, 6) AS threshold, CASE WHEN {_HAS.format('c', 'that|worthless')} AND {_HAS.format('c', 'with|les')} THEN 'hybrid' WHEN {_HAS.format('c', 'that|worthless')} THEN 'in-scope'
    WHEN {_HAS.format('c', 'with|les')} THEN 'out-of-scope' WHEN score >= t THEN 'in-scope' ELSE 'out-of-scope' END AS relevance_class FROM x"""


@query(_EVALUATED)
def evaluated_classes(spark, d):
    return rounded(evaluate_hybrid(spark, d).select("paper_id", "is_relevant", "threshold", "relevance_class"))


@query(f"WITH {_KW} SELECT concat('eval-2-', doc_id) AS eval_id, doc_id AS paper_id, 'baseline_keyword' AS method, CASE WHEN {_HAS.format(_PRE, 'that|worthless')} AND {_HAS.format(_PRE, 'with|les')} THEN 'hybrid' WHEN {_HAS.format(_PRE, 'that|worthless')} THEN 'in-scope' WHEN {_HAS.format(_PRE, 'with|les')} THEN 'out-of-scope' WHEN raw / 10.0 >= 0.22 THEN 'in-scope' ELSE 'out-of-scope' END AS decision, "
       "round(least(raw / 10.0, 1.0), 6)::DOUBLE AS score, 2 AS run, concat('keyword score ', printf('%.4f', least(raw / 10.0, 1.0)::DOUBLE), ' vs threshold 0.22') AS rationale FROM kw")
def baseline_records(spark, d):
    """Eval records of a deterministic run over all documents."""
    papers = _docs(spark, d).selectExpr("doc_id as id", "text as abstract")
    found = scoring.baseline_records(scoring.evaluate_corpus(papers, method="keyword", threshold=0.22, topic=TOPIC), 2)
    return rounded(found.select("eval_id", "paper_id", "method", "decision", "score", "run", "rationale"))


@query(ctes("papers", "paper_sources", "sources", "edges") + """, top AS (SELECT paper_id, count(*) AS n FROM paper_sources GROUP BY paper_id ORDER BY n DESC, paper_id LIMIT 5)
SELECT top.paper_id, top.n, p.title, (SELECT string_agg(DISTINCT s.name, ',' ORDER BY s.name) FROM paper_sources l JOIN sources s ON s.id = l.source_id WHERE l.paper_id = top.paper_id) AS sources,
    (SELECT string_agg(DISTINCT e.parent_paper_id::VARCHAR, ',' ORDER BY e.parent_paper_id::VARCHAR) FROM edges e WHERE e.child_paper_id = top.paper_id) AS parents FROM top LEFT JOIN papers p ON p.id = top.paper_id""")
def most_sourced_provenance(spark, d):
    """Where the five papers with most sources come from."""
    links, papers = table(spark, d, "paper_sources"), table(spark, d, "papers")
    top = reports.top_sourced(links)
    found = reports.provenance(papers, table(spark, d, "sources"), links, table(spark, d, "queries"), table(spark, d, "paper_queries"), table(spark, d, "edges"), top.selectExpr("paper_id as id"))
    parents = F.array_join(F.sort_array(F.transform("parents", lambda x: x["paper_id"].cast("string"))), ",")
    return top.join(found.withColumnRenamed("id", "paper_id"), "paper_id").select("paper_id", "n", "title", F.array_join("sources", ",").alias("sources"), parents.alias("parents"))


# --- quality of classifiers -----------------------------------------------------------------------------------------

_J = ctes("gold", "evals") + ", j AS (SELECT run_id, paper_id, decision, score, consensus_label AS gold FROM evals JOIN gold USING (paper_id) WHERE consensus_label <> 'disagree'), l(x) AS (VALUES ('in-scope'), ('out-of-scope'), ('hybrid'))"
_PRF = _J + """, r AS (SELECT DISTINCT run_id FROM j), c AS (SELECT r.run_id, l.x, count(*) FILTER (gold = l.x AND decision = l.x) AS tp, count(*) FILTER (gold <> l.x AND decision = l.x) AS fp, count(*) FILTER (gold = l.x AND decision <> l.x) AS fn,
count(*) FILTER (gold = l.x) AS g, count(*) FILTER (decision = l.x) AS p, count(*) AS n FROM r JOIN j USING (run_id), l GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM s)"""


def _judged(spark, d):
    return metrics.judged(table(spark, d, "evals"), table(spark, d, "gold"))


@query(_J + ", r AS (SELECT DISTINCT run_id FROM j) SELECT r.run_id, a.x AS gold, b.x AS decision, count(j.paper_id) AS n FROM r CROSS JOIN l a CROSS JOIN l b LEFT JOIN j ON j.run_id = r.run_id AND j.gold = a.x AND j.decision = b.x GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion_rows(_judged(spark, d))


@query(_PRF + """ SELECT run_id, max(CASE WHEN x = 'in-scope' THEN round(pr, 6) END) AS precision_in, max(CASE WHEN x = 'in-scope' THEN round(re, 6) END) AS recall_in, max(CASE WHEN x = 'hybrid' THEN round(f1, 6) END) AS f1_hybrid,
max(CASE WHEN x = 'out-of-scope' THEN round(f1, 6) END) AS f1_out FROM f GROUP BY run_id""")
def per_class(spark, d):
    return rounded(metrics.metrics(_judged(spark, d)).select("run_id", "precision_in", "recall_in", "f1_hybrid", "f1_out"))


@query(_PRF + """ SELECT run_id, any_value(n) AS n, round(sum(tp) / any_value(n), 6) AS accuracy, round(sum(pr) / 3, 6) AS macro_precision, round(sum(re) / 3, 6) AS macro_recall, round(sum(f1) / 3, 6) AS macro_f1,
round((sum(tp) / any_value(n) - sum((g / n) * (p / n))) / (1 - sum((g / n) * (p / n))), 6) AS kappa FROM f GROUP BY run_id""")
def macro_metrics(spark, d):
    return rounded(metrics.metrics(_judged(spark, d)).select("run_id", "n", "accuracy", "macro_precision", "macro_recall", "macro_f1", "kappa"))


@query(_J + """, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (gold = 'in-scope' AND decision = 'in-scope') AS tp, count(*) FILTER (gold <> 'in-scope' AND decision = 'in-scope') AS fp, count(*) FILTER (gold = 'in-scope' AND decision <> 'in-scope') AS fn, count(*) FILTER (gold <> 'in-scope' AND decision <> 'in-scope') AS tn FROM j GROUP BY run_id),
e AS (SELECT *, ((tp + fn) / n) * ((tp + fp) / n) + ((fp + tn) / n) * ((fn + tn) / n) AS pe FROM c) SELECT run_id, tp AS binary_tp, fp AS binary_fp, fn AS binary_fn, tn AS binary_tn, round((tp + tn) / n, 6) AS binary_accuracy, round(tp / (tp + fp), 6) AS binary_precision, round(tp / (tp + fn), 6) AS binary_recall, round(((tp + tn) / n - pe) / (1 - pe), 6) AS binary_kappa FROM e""")
def binary_metrics(spark, d):
    return rounded(metrics.metrics(_judged(spark, d)).select("run_id", "binary_tp", "binary_fp", "binary_fn", "binary_tn", "binary_accuracy", "binary_precision", "binary_recall", "binary_kappa"))


@query(_J + """, s AS (SELECT run_id, coalesce(score, CASE WHEN decision = 'in-scope' THEN 1.0 ELSE 0.0 END) AS s, gold = 'in-scope' AS y FROM j),
k AS (SELECT run_id, y, rank() OVER (PARTITION BY run_id ORDER BY s) + (count(*) OVER (PARTITION BY run_id, s) - 1) / 2.0 AS r FROM s)
SELECT run_id, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc_in_scope FROM k GROUP BY run_id""")
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_judged(spark, d)))


@query(ctes("ground_truth") + """, c AS (SELECT paper_id, label, count(*) AS c FROM ground_truth GROUP BY ALL), m AS (SELECT paper_id, sum(c)::INTEGER AS n, max(c)::INTEGER AS k, arg_max(label, (c, label)) AS l FROM c GROUP BY paper_id)
SELECT paper_id, CASE WHEN n = k THEN l ELSE 'disagree' END AS consensus_label, n AS n_annotators, k AS n_agree, CASE WHEN n = k THEN 'unanimous' ELSE 'majority' END AS method FROM m""")
def consensus(spark, d):
    return metrics.consensus(table(spark, d, "ground_truth"))


@query(ctes("ground_truth") + """, s AS (SELECT paper_id, max(label) FILTER (annotator_id = 'a') AS a, max(label) FILTER (annotator_id = 'b') AS b FROM ground_truth GROUP BY paper_id), t AS (SELECT * FROM s WHERE a IS NOT NULL AND b IS NOT NULL),
e AS (SELECT sum((SELECT count(*) FROM t WHERE a = x) * (SELECT count(*) FROM t WHERE b = x)) / ((SELECT count(*) FROM t) * (SELECT count(*) FROM t)) AS pe FROM (VALUES ('in-scope'), ('out-of-scope'), ('hybrid')) l(x))
SELECT (SELECT count(*) FROM t) AS n, round(((SELECT count(*) FROM t WHERE a = b) / (SELECT count(*) FROM t) - pe) / (1 - pe), 6) AS kappa FROM e""")
def cohen_kappa(spark, d):
    return rounded(metrics.cohen_kappa(table(spark, d, "ground_truth")))


def _fleiss(taken: int) -> str:
    return ctes("ground_truth", "third") + f""", a AS (SELECT * FROM ground_truth UNION ALL SELECT * FROM third), c AS (SELECT paper_id, count(*) FILTER (label = 'in-scope') AS x, count(*) FILTER (label = 'out-of-scope') AS y, count(*) FILTER (label = 'hybrid') AS z FROM a GROUP BY paper_id),
t AS (SELECT count(*) AS n, avg((x * x + y * y + z * z - {taken}) / 6.0) AS p, (sum(x) / (count(*) * 3)) ** 2 + (sum(y) / (count(*) * 3)) ** 2 + (sum(z) / (count(*) * 3)) ** 2 AS pe FROM c) SELECT n, round((p - pe) / (1 - pe), 6) AS kappa FROM t"""


@query(_fleiss(3))
def fleiss_kappa(spark, d):
    return rounded(metrics.fleiss_kappa(table(spark, d, "ground_truth").unionByName(table(spark, d, "third"))))


@query(_fleiss(9))
def fleiss_kappa_as_published(spark, d):
    return rounded(metrics.fleiss_kappa(table(spark, d, "ground_truth").unionByName(table(spark, d, "third")), variant="reference"))


@query(ctes("runs", "evals") + " SELECT r.id, r.method, r.model, r.prompt_id, r.run_index, count(e.id) AS n_evals FROM runs r LEFT JOIN evals e ON e.run_id = r.id GROUP BY ALL")
def runs_eval_counts(spark, d):
    return metrics.runs_with_counts(table(spark, d, "runs"), table(spark, d, "evals"))


@query(_J + ", c AS (SELECT run_id, count(*) AS n, round(count(*) FILTER (gold = decision) / count(*), 6) AS accuracy FROM j GROUP BY run_id), runs AS (SELECT unnest([1, 2, 3]) AS id) SELECT CAST(r.id AS BIGINT) AS run_id, c.n, c.accuracy, CASE WHEN c.n IS NULL THEN 'no evaluated papers with a consensus label' END AS note FROM runs r LEFT JOIN c ON c.run_id = r.id")
def evaluation_summary(spark, d):
    return rounded(metrics.summary(table(spark, d, "runs"), table(spark, d, "evals"), table(spark, d, "gold")).select("run_id", "n", "accuracy", "note"))


# --- upserts, identity, citations -----------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def upsert_latest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return upserts.latest(e, ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id")


@query(ctes("evals") + " SELECT run_id, paper_id, CASE WHEN paper_id % 2 = 0 AND run_id = 1 THEN 'hybrid' ELSE decision END AS decision FROM evals UNION ALL SELECT 9, doc_id, 'hybrid' FROM documents WHERE doc_id % 2 = 1")
def upsert_evals(spark, d):
    old = table(spark, d, "evals")
    new = _docs(spark, d).selectExpr("if(doc_id % 2 = 0, 1L, 9L) as run_id", "doc_id as paper_id", "'hybrid' as decision", "cast(null as double) as score", "doc_id as seq")
    return upserts.upsert(old, new, ["run_id", "paper_id"], "seq").select("run_id", "paper_id", "decision")


@query(ctes("paper_queries") + " SELECT paper_id, query_id FROM paper_queries UNION SELECT doc_id, doc_id % 20 FROM documents UNION SELECT doc_id, 99 FROM documents")
def junction_ignore(spark, d):
    new = _docs(spark, d).selectExpr("doc_id as paper_id", "doc_id % 20 as query_id").union(_docs(spark, d).selectExpr("doc_id", "99L"))
    return upserts.link(table(spark, d, "paper_queries"), new)


_UPSERTED = "SELECT 'new title' AS title, concat('A', id, ' Roe') AS authors, (id % 100)::INT AS year, md5(concat('n', abstract)) AS abstract_md5, concat('P ', id) AS publication_title, doi, concat('k', id) AS keywords"


@query(ctes("papers") + f" SELECT title, authors, year, md5(abstract) AS abstract_md5, publication_title, doi, keywords FROM papers WHERE NOT (id % 3 <> 0 AND id % 2 = 0) UNION ALL {_UPSERTED} FROM papers WHERE id % 2 = 0")
def upsert_papers(spark, d):
    """Every second paper comes again with other fields: known DOIs are overwritten, rows without are inserted."""
    p = table(spark, d, "papers").select("id", "title", "authors", "year", "abstract", "publication_title", "doi", "keywords")
    rows = p.where("id % 2 = 0").selectExpr("id as seq", "'new title' as title", "concat('A', id, ' Roe') as authors", "cast(id % 100 as int) as year", "concat('n', abstract) as abstract", "concat('P ', id) as publication_title", "doi", "concat('k', id) as keywords")
    return upserts.upsert_papers(p, rows).select("title", "authors", "year", F.md5("abstract").alias("abstract_md5"), "publication_title", "doi", "keywords")


@query(ctes("sources") + " SELECT name FROM sources UNION SELECT 'fresh one' UNION SELECT 'fresh two'")
def get_or_create(spark, d):
    wanted = spark.createDataFrame([("fresh one",), ("fresh two",), ("IEEE",)], "name string")
    return upserts.get_or_create(table(spark, d, "sources"), wanted, ["name"]).select("name")


@query(ctes("evals", "runs") + " SELECT paper_id, CASE run_id WHEN 1 THEN 'keyword' ELSE 'bm25' END AS method, score, decision IN ('in-scope', 'hybrid') AS is_relevant, CASE run_id WHEN 1 THEN 0.22 ELSE 0.52 END::DOUBLE AS threshold FROM evals")
def rebuild_relevance_evals(spark, d):
    out = upserts.rebuild_relevance_evals(table(spark, d, "evals"), table(spark, d, "runs"), {"method1": "keyword", "method2": "bm25", "method3": "other"}, upserts.STUDY_THRESHOLDS)
    return out.drop("details")


_DOI = r"nullif(trim(lower(regexp_replace(trim({}), '^(https?://(dx\.)?doi\.org/|doi:)', '', 'i'))), '')"
_KEYS = f"""r AS (SELECT id AS ref_id, {_DOI.format('ref_doi')} AS d, lower(trim(regexp_replace(ref_title, '\\s+', ' ', 'g'))) AS t FROM reference_lists),
p AS (SELECT id, lower(doi) AS d, lower(title) AS t FROM papers),
a AS (SELECT ref_id, min(p.id) AS paper_id FROM r JOIN p ON p.d = r.d GROUP BY ref_id),
b AS (SELECT r.ref_id, min(p.id) AS paper_id FROM r JOIN p ON p.t = r.t AND r.t <> '' WHERE r.ref_id NOT IN (SELECT ref_id FROM a) AND (r.d IS NULL OR p.d IS NULL OR r.d = p.d) GROUP BY r.ref_id)"""


@query(ctes("papers", "reference_lists") + f", {_KEYS} SELECT * FROM a UNION ALL SELECT * FROM b")
def identity_lookup(spark, d):
    refs = table(spark, d, "reference_lists").selectExpr("id as ref_id", "ref_doi as doi", "ref_title as title")
    return identity.find_existing(refs, table(spark, d, "papers"))


@query(ctes("papers", "reference_lists") + f""", k AS (SELECT id, parent_paper_id, {_DOI.format('ref_doi')} AS d, ref_doi, status FROM reference_lists)
SELECT k.id, CASE WHEN k.ref_doi IS NULL OR k.status = 'resolved' THEN k.status WHEN k.d IS NULL THEN 'fetch_error' WHEN p.id IS NOT NULL THEN 'resolved' ELSE k.status END AS status FROM k LEFT JOIN papers p ON lower(p.doi) = k.d""")
def verify_retrieval(spark, d):
    edges = table(spark, d, "edges").selectExpr("cast(child_paper_id as bigint) as id", "child_paper_id", "parent_paper_id", "depth")
    return citations.verify(table(spark, d, "reference_lists"), table(spark, d, "papers"), edges)[0].select("id", "status")


@query(ctes("edges") + " SELECT child_paper_id, parent_paper_id FROM edges UNION SELECT doc_id, doc_id % 30 FROM documents WHERE doc_id <> doc_id % 30")
def add_edges(spark, d):
    edges = table(spark, d, "edges").selectExpr("cast(child_paper_id as bigint) as id", "child_paper_id", "parent_paper_id", "depth")
    new = _docs(spark, d).selectExpr("doc_id as child_paper_id", "doc_id % 30 as parent_paper_id")
    return citations.add_edges(edges, new).select("child_paper_id", "parent_paper_id")


@query(ctes("reference_lists") + f""", k AS (SELECT parent_paper_id, direction, coalesce({_DOI.format('ref_doi')}, '') AS d, trim(ref_title) AS t, ref_index FROM reference_lists), u AS (SELECT parent_paper_id, direction, d, CASE WHEN d = '' THEN t ELSE '' END AS x, ref_index FROM k)
SELECT parent_paper_id, direction, d AS doi, x AS unstructured, min(ref_index) AS ref_index FROM u GROUP BY ALL""")
def reference_first_mention(spark, d):
    r = table(spark, d, "reference_lists").selectExpr("parent_paper_id", "direction", "ref_index", "ref_doi as doi", "ref_title as title", "ref_year as year", "'' as authors", "'' as unstructured", "cast(null as bigint) as resolved_paper_id", "source")
    out = citations.first_mention(citations.reference_rows(r))
    return out.select("parent_paper_id", "direction", F.coalesce("ref_doi", F.lit("")).alias("doi"), F.col("ref_unstructured").alias("unstructured"), "ref_index")


@query(ctes("papers") + ", w AS (SELECT lower(doi) AS k, CASE WHEN id % 2 = 0 THEN concat('crossref ', id) ELSE concat('s2 ', id) END AS a FROM papers WHERE doi IS NOT NULL AND id % 5 <> 0) SELECT p.id, md5(CASE WHEN coalesce(p.abstract, '') = '' THEN coalesce(w.a, p.abstract) ELSE p.abstract END) AS abstract_md5 FROM papers p LEFT JOIN w ON w.k = lower(p.doi)")
def backfill_abstracts(spark, d):
    p = table(spark, d, "papers")
    works = p.where("doi is not null and id % 5 <> 0").selectExpr("doi", "concat('s2 ', id) as abstract", "'semantic_scholar' as source")
    works = works.union(p.where("doi is not null and id % 5 <> 0 and id % 2 = 0").selectExpr("upper(doi)", "concat('crossref ', id)", "'crossref'"))
    return citations.backfill(p, works).select("id", F.md5("abstract").alias("abstract_md5"))


@query(ctes("papers", "edges") + """, r AS (SELECT 3::BIGINT AS paper_id, 0 AS depth UNION SELECT e.child_paper_id, r.depth + 1 FROM r JOIN edges e ON e.parent_paper_id = r.paper_id WHERE r.depth < 3) SELECT paper_id, min(depth)::INTEGER AS depth FROM r GROUP BY paper_id""")
def citation_closure(spark, d):
    return citations.closure(table(spark, d, "edges"), table(spark, d, "papers").where("id = 3").select("id"), 3)


@query(ctes("papers") + " SELECT lang AS publication_title, count(*) AS n FROM documents GROUP BY lang")
def guarded_sql(spark, d):
    return readonly.execute(spark, "-- a report\nSELECT publication_title, count(*) AS n FROM papers GROUP BY publication_title;", {"papers": table(spark, d, "papers")})


@query()
def title_similarity(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_name").distinct()
    refs = p.select(F.xxhash64("p_name").alias("ref_id"), F.concat("p_name", F.lit(".")).alias("title"), F.lit(None).cast("int").alias("year"))
    works = p.select(F.xxhash64("p_name").alias("work_id"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"), F.xxhash64("p_name").alias("rank"))
    return identity.first_title_match(refs, works)


@query()
def ingest_fold(spark, d):
    e = table(spark, d, "reference_lists").selectExpr("id as seq", "ref_title as title", "'' as authors", "ref_year as year", "'' as abstract", "ref_doi as doi")
    return identity.ingest(e)
