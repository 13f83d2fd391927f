"""CSV and JSON-lines inputs, and the files that are written for people."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.functions.text import normalise_authors, parts, status_reason
from screenlake.schemas import EVAL_RECORD, LABELS

#: Columns of the two layouts of exported search results.
LAYOUTS = {
    "acm": ("entry_type", "author", "title", "year", "journal", "booktitle", "abstract", "doi", "keywords"),
    "ieee": ("Document Title", "Authors", "Publication Year", "Abstract", "DOI", "Publication Title", "Author Keywords"),
}


def required(c: Column, name: str) -> tuple[Column, Column]:
    """Trimmed value and an error text for an empty one."""
    value = F.nullif(F.trim(c), F.lit(""))
    return value, F.when(value.isNull(), f"Empty value for field '{name}'")


def whole_number(c: Column, name: str) -> tuple[Column, Column]:
    value, error = required(c, name)
    number = value.try_cast("int")
    return number, F.coalesce(error, F.when(number.isNull(), F.concat(F.lit(f"Field '{name}' is not an integer: "), value)))


def many(c: Column, name: str, separator: str, each: Callable[[Column], Column] | None = None, optional: bool = False) -> tuple[Column, Column]:
    """Pieces joined by '; ', null and an error (unless optional) where there are none."""
    pieces = parts(c, separator)
    value = F.nullif(F.array_join(F.transform(pieces, each) if each else pieces, "; "), F.lit(""))
    return value, F.lit(None).cast("string") if optional else F.when(value.isNull(), f"Empty value for field '{name}'")


def map_rows(rows: DataFrame, layout: str) -> DataFrame:
    """Paper columns of raw rows in one of the layouts; ``error`` names the first thing wrong."""
    c = {f.lower(): F.col(f"`{f}`") for f in rows.columns}
    col = lambda n: c.get(n.lower(), F.lit(None).cast("string"))
    optional = lambda n: F.nullif(F.trim(col(n)), F.lit(""))
    if layout == "acm":
        kind, e0 = required(F.lower(col("entry_type")), "entry_type")
        journal, ej = required(col("journal"), "journal")
        book, eb = required(col("booktitle"), "booktitle")
        venue = F.when(kind == "article", journal).when(kind == "inproceedings", book)
        ev = F.coalesce(e0, F.when(kind == "article", ej).when(kind == "inproceedings", eb).otherwise(F.concat(F.lit("Unsupported entry_type "), kind)))
        fields = {"title": required(col("title"), "title"), "authors": many(col("author"), "author", " and ", normalise_authors), "year": whole_number(col("year"), "year"), "abstract": required(col("abstract"), "abstract"), "keywords": many(col("keywords"), "keywords", ",", optional=True)}
        doi = optional("doi")
    elif layout == "ieee":
        venue, ev = required(col("Publication Title"), "Publication Title")
        fields = {"title": required(col("Document Title"), "Document Title"), "authors": many(col("Authors"), "Authors", ";", normalise_authors), "year": whole_number(col("Publication Year"), "Publication Year"), "abstract": required(col("Abstract"), "Abstract"), "keywords": many(col("Author Keywords"), "Author Keywords", ";", optional=True)}
        doi = optional("DOI")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    error = F.coalesce(ev, *[e for _, e in fields.values()])
    keep = [x for x in ("seq",) if x in rows.columns]
    return rows.select(*keep, *[v.alias(k) for k, (v, _) in fields.items()], doi.alias("doi"), venue.alias("publication_title"), error.alias("error"))


def read_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Rows of CSV files in a layout; split good from bad by ``error``. A missing column reads as nulls. ``seq`` numbers
    rows by file, place of the block in the file, and place in the block, whatever files a task reads together."""
    from screenlake.stages import numbered

    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))  # rises inside a block
    return map_rows(numbered(rows, ["__file", "__block", "__at"], "seq").drop("__file", "__block", "__at"), layout)


def read_evals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Eval records of JSON-lines files; blank lines don't count."""
    return spark.read.schema(EVAL_RECORD).json(paths)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labels of annotators; a label outside the three is an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    rows = raw.select(F.trim("paper_id").cast("long").alias("paper_id"), F.trim(F.coalesce("annotator_id", F.lit(""))).alias("annotator_id"), F.trim(F.coalesce("label", F.lit(""))).alias("label"), F.col("confidence").try_cast("double").alias("confidence"), F.trim(F.coalesce("rationale", F.lit(""))).alias("rationale"))
    bad = rows.where(~F.col("label").isin(*LABELS)).limit(1).collect()
    if bad:
        raise ValueError(f"Invalid ground-truth label: {bad[0]['label']!r}")
    return rows


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def annotator_sheet(papers: DataFrame) -> DataFrame:
    blank = [F.lit("").alias(c) for c in ("annotator_id", "label", "confidence", "rationale")]
    return papers.select(F.col("id").alias("paper_id"), F.coalesce("doi", F.lit("")).alias("doi"), "title", *blank).orderBy("paper_id")


def unresolved_sheet(lists: DataFrame) -> DataFrame:
    """References that are not resolved, by status and id, with the reason."""
    return lists.where("status <> 'resolved'").orderBy("status", "id").select("ref_doi", "ref_title", "ref_year", "source", "status", status_reason("status").alias("reason"))


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted output stays in order: parts are numbered by range. Quotes inside of quotes are doubled."""
    df.write.mode("overwrite").option("emptyValue", "").option("escape", '"').csv(path, header=True)


def analysis_json(parts: dict[str, DataFrame], most: int = 10000) -> str:
    """Reports as one JSON text; a report longer than ``most`` rows is an error, not a silent cut."""
    out = {}
    for name, df in parts.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"report {name} has more than {most} rows")
        out[name] = rows
    return json.dumps(out, default=str, ensure_ascii=False, sort_keys=True)


def plot_bars(rows: list[dict], x: str, y: str, path: str) -> bool:
    """A bar chart as PNG if matplotlib is installed; tells whether it was written."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    figure, axes = pyplot.subplots()
    axes.bar([str(r[x]) for r in rows], [r[y] for r in rows])
    axes.set_xlabel(x), axes.set_ylabel(y)
    figure.savefig(path)
    pyplot.close(figure)
    return True


def push(df: DataFrame, send: Callable[[list[dict]], None], size: int = 50) -> None:
    """Hands rows to ``send`` in batches, from the executors."""
    def part(rows):
        held = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(part)


INVERTED = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
