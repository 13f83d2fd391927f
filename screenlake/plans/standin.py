"""A project's tables out of the driver's: the same rows as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each table as SQL that Spark and DuckDB read alike, over documents, labels, lineitem, supplier and conversations.
SQL: dict[str, str] = {
    "papers": """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, concat('Roe, ', source, ' and ', lang, ' Poe') AS authors, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 2000 + doc_id % 25 END AS INT) AS year,
        CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS abstract, lang AS publication_title, CASE WHEN doc_id % 3 <> 0 THEN concat('10.1000/ab', doc_id) END AS doi, concat('k1, ', source, ' ,, ', lang) AS keywords,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE n_chars > 1500 END AS is_relevant, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN n_chars > 3000 THEN 'in-scope' WHEN n_chars > 1500 THEN 'hybrid' ELSE 'out-of-scope' END AS relevance_class,
        doc_id % 17 AS created_at FROM documents""",
    "sources": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN concat('Snowball ', s_suppkey) WHEN s_suppkey % 5 = 1 THEN concat('query', s_suppkey, ':ACM') WHEN s_suppkey % 5 = 2 AND s_suppkey < 5 THEN 'IEEE' ELSE s_name END AS name FROM supplier""",
    "paper_sources": "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS source_id FROM lineitem",
    "queries": "SELECT DISTINCT doc_id % 20 AS id, concat('platform ', doc_id % 3) AS platform, concat('q', doc_id % 20) AS query_text FROM documents WHERE doc_id % 3 = (doc_id % 20) % 3",
    "paper_queries": "SELECT doc_id AS paper_id, doc_id % 20 AS query_id FROM documents UNION SELECT doc_id AS paper_id, (doc_id + 7) % 20 AS query_id FROM documents WHERE doc_id % 2 = 0",
    "edges": "SELECT doc_id AS child_paper_id, doc_id % 50 AS parent_paper_id, CAST(1 + doc_id % 2 AS INT) AS depth FROM documents WHERE doc_id <> doc_id % 50",
    "gold": "SELECT doc_id AS paper_id, CASE WHEN doc_id % 29 = 0 THEN 'disagree' WHEN quality = 0 THEN 'out-of-scope' WHEN toxic = 1 THEN 'hybrid' ELSE 'in-scope' END AS consensus_label FROM labels",
    "runs": "SELECT CAST(r AS BIGINT) AS id, concat('method', r) AS method, 'm' AS model, 'P1' AS prompt_id, CAST(r AS INT) AS run_index FROM (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) x",
    "evals": """SELECT doc_id AS id, CAST(1 AS BIGINT) AS run_id, doc_id AS paper_id, CASE WHEN doc_id % 9 = 0 THEN 'hybrid' WHEN n_chars > 700 THEN 'in-scope' ELSE 'out-of-scope' END AS decision, (n_chars % 1000) / CAST(1000 AS DOUBLE) AS score FROM documents
        UNION ALL SELECT 1000000 + doc_id AS id, CAST(2 AS BIGINT) AS run_id, doc_id AS paper_id, CASE WHEN lang = 'fr' THEN 'hybrid' WHEN lang = 'de' THEN 'out-of-scope' ELSE 'in-scope' END AS decision,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (n_chars % 50) / CAST(50 AS DOUBLE) END AS score FROM documents""",
    "ground_truth": """SELECT doc_id AS paper_id, 'a' AS annotator_id, CASE WHEN quality = 1 THEN 'in-scope' ELSE 'out-of-scope' END AS label FROM labels
        UNION ALL SELECT doc_id AS paper_id, 'b' AS annotator_id, CASE WHEN doc_id % 10 = 0 THEN 'hybrid' WHEN quality = 1 AND toxic = 0 THEN 'in-scope' ELSE 'out-of-scope' END AS label FROM labels WHERE doc_id % 31 <> 0""",
    "third": "SELECT doc_id AS paper_id, 'c' AS annotator_id, CASE WHEN doc_id % 4 = 0 THEN 'hybrid' WHEN quality = 1 THEN 'in-scope' ELSE 'out-of-scope' END AS label FROM labels",
    "reference_lists": """SELECT doc_id AS id, doc_id % 40 AS parent_paper_id, CASE WHEN doc_id % 6 = 0 THEN 'forward' ELSE 'backward' END AS direction, CAST(doc_id % 30 AS INT) AS ref_index,
        CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(' https://doi.org/10.1000/AB', (doc_id * 3) % 1500) WHEN 2 THEN concat('DOI:10.1000/ab', (doc_id * 3) % 1500) WHEN 3 THEN 'doi:' WHEN 4 THEN concat('http://dx.doi.org/10.1000/Ab', (doc_id * 3) % 1500) ELSE concat('10.1000/ab', (doc_id * 3) % 1500) END AS ref_doi,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS ref_title, CAST(2000 + doc_id % 25 AS INT) AS ref_year, CASE WHEN doc_id % 9 = 0 THEN doc_id % 40 END AS resolved_paper_id, 'crossref' AS source,
        CASE WHEN doc_id % 9 = 0 THEN 'resolved' WHEN doc_id % 9 = 1 THEN 'fetch_error' WHEN doc_id % 9 = 2 THEN 'unresolved_no_doi' ELSE 'pending' END AS status FROM documents""",
    "works": """SELECT concat('10.1000/AB', n) AS doi, concat('Work  ', n) AS title, '' AS authors, CAST(2010 AS INT) AS year, concat(source, ' ', n) AS abstract, 'V' AS publication_title, CAST(NULL AS STRING) AS pdf_url, source FROM (SELECT DISTINCT (doc_id * 3) % 1500 AS n FROM documents) x
        JOIN (SELECT 'crossref' AS source, 4 AS m UNION ALL SELECT 'openalex', 8 UNION ALL SELECT 'semantic_scholar', 5 UNION ALL SELECT 'zotero', 10) y ON n % m = 0""",
    "candidates": """SELECT doc_id AS ref_id, doc_id AS work_id, concat(split_part(text, chr(10), 1), '.') AS work_title, CAST(2001 + doc_id % 25 AS INT) AS work_year, CAST(1 AS INT) AS rank, 'crossref' AS source FROM documents WHERE length(split_part(text, chr(10), 1)) BETWEEN 20 AND 150 AND doc_id % 2 = 0
        UNION ALL SELECT doc_id, doc_id + 1000000, 'Another title altogether', CAST(2000 AS INT), CAST(0 AS INT), 'openalex' FROM documents""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table; the driver's tables that it needs become views."""
    for raw in ("documents", "labels", "lineitem", "supplier"):
        if raw in SQL[name]:
            spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
    return spark.sql(SQL[name])


def ctes(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
