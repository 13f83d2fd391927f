"""Works from outside services: payloads as typed rows, normalised to one schema; clients are handed in."""

from __future__ import annotations

import email.utils
import itertools
import random
import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.text import first, inverted_index_text, join_authors, parse_year, strip_markup, year_in_date
from screenlake.schemas import WORK

PERSON = "array<struct<name:string,given:string,family:string>>"
PAYLOADS = {
    "crossref_reference": f"DOI string, `article-title` string, title string, author {PERSON}, year string, unstructured string",
    "crossref": f"DOI string, title array<string>, author {PERSON}, published struct<`date-parts`:array<array<string>>>, link array<struct<`content-type`:string,URL:string>>, URL string, `container-title` array<string>, abstract string",
    "openalex": "doi string, id string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, primary_location struct<source:struct<display_name:string>>, "
    "best_oa_location struct<pdf_url:string>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>",
    "semantic_scholar": f"externalIds struct<DOI:string>, title string, authors {PERSON}, year int, abstract string, publicationVenue struct<name:string>",
    "zotero": f"DOI string, title string, creators {PERSON}, date string, abstractNote string, publicationTitle string",
}


def _work(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    out = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in WORK]
    return df.select(*keep, *out)


def normalise(df: DataFrame, kind: str, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Rows of JSON texts of one kind as works, next to the columns ``keep``."""
    if kind not in PAYLOADS:
        raise ValueError(f"unknown kind {kind!r}")
    keep = keep if keep is not None else [c for c in df.columns if c != payload]
    df = df.withColumn("p", F.from_json(payload, PAYLOADS[kind]))
    p = lambda path: F.col(f"p.{path}")
    blank = lambda c: F.coalesce(c, F.lit(""))
    if kind == "crossref_reference":
        return _work(df, keep, doi=p("DOI"), title=blank(F.coalesce(F.nullif(p("`article-title`"), F.lit("")), p("title"))), authors=join_authors(p("author")), year=parse_year(p("year")), unstructured=F.trim(blank(p("unstructured"))), publication_title=F.lit(""))
    if kind == "crossref":
        pdf = F.get(F.filter(p("link"), lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
        return _work(df, keep, doi=p("DOI"), title=first(p("title")), authors=join_authors(p("author")), year=parse_year(F.get(F.get(p("published.`date-parts`"), F.lit(0)), F.lit(0))), unstructured=F.lit(""), publication_title=first(p("`container-title`")), pdf_url=F.coalesce(pdf, p("URL")), abstract=strip_markup(p("abstract")))
    if kind == "openalex":
        names = F.filter(F.transform(p("authorships"), lambda a: a["author"]["display_name"]), lambda x: blank(x) != "")
        return _work(df, keep, doi=p("doi"), title=blank(p("title")), authors=F.coalesce(F.array_join(names, "; "), F.lit("")), year=p("publication_year"), unstructured=F.lit(""), publication_title=blank(p("primary_location.source.display_name")), pdf_url=p("best_oa_location.pdf_url"), abstract=inverted_index_text(p("abstract_inverted_index")))
    if kind == "semantic_scholar":
        return _work(df, keep, doi=p("externalIds.DOI"), title=blank(p("title")), authors=join_authors(p("authors")), year=p("year"), unstructured=F.lit(""), publication_title=blank(p("publicationVenue.name")), abstract=blank(p("abstract")))
    creators = F.array_join(F.filter(F.transform(p("creators"), lambda c: F.trim(F.concat_ws(" ", F.nullif(F.trim(blank(c["given"])), F.lit("")), F.nullif(F.trim(blank(c["family"])), F.lit(""))))), lambda x: x != ""), "; ")
    return _work(df, keep, doi=p("DOI"), title=blank(p("title")), authors=F.coalesce(creators, F.lit("")), year=year_in_date(p("date")), unstructured=F.lit(""), publication_title=blank(p("publicationTitle")), abstract=blank(p("abstractNote")))


class RateLimitError(Exception):
    """A source could not be used any further."""


def _number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None


def _moment(text: str) -> float | None:
    fields = email.utils.parsedate_tz(text)
    return email.utils.mktime_tz(fields) if fields else None


def retry_after(header: str | None, now: float | None = None) -> float | None:
    """Seconds that a Retry-After header asks to wait: a number or an HTTP date; None if it is past or no such thing."""
    text = (header or "").strip()
    seconds, moment = _number(text), _moment(text)
    if seconds is None and moment is not None:
        seconds = moment - (time.time() if now is None else now)
    return seconds if seconds is not None and seconds > 0 else None


@dataclass(frozen=True)
class Limits:
    """What a source stands: pure functions of what has happened so far."""

    #: Seconds between calls, failures in a row that end a run, the longest wait, how waits widen, and the
    #: share of chance in them.
    interval: float = 1.0
    retries: int = 5
    longest: float = 60.0
    base: float = 2.0
    jitter: float = 0.5
    by_source: Mapping[str, float] = field(default_factory=dict)

    def due(self, last: float | None, failures: int, source: str | None) -> float:
        """When the next call may go."""
        if last is None:
            return float("-inf")
        gap = self.interval if source is None else self.by_source.get(source, self.interval)
        return last + (gap if failures == 0 else min(gap * self.base**failures, self.longest))

    def back_off(self, attempt: int, asked: float | None, chance: float) -> float:
        """Seconds to wait after a failed attempt; what the source asked for goes before our own measure."""
        own = min(self.base ** max(attempt, 0), self.longest) + chance * self.jitter
        return own if asked is None else min(asked, self.longest)


class Pace:
    """One client's calls under ``Limits``: waits until the next may go, counts failures in a row, gives up in the end."""

    def __init__(self, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, **limits):
        self.limits, self.sleep, self.clock = Limits(**limits), sleep, clock
        self.last: float | None = None
        self.failures = self.calls = 0

    def wait(self, source: str | None = None) -> None:
        early = self.limits.due(self.last, self.failures, source) - self.clock()
        if early > 0:
            self.sleep(early)
        self.last, self.calls = self.clock(), self.calls + 1

    def pause(self, attempt: int, header: str | None = None) -> float:
        return self.limits.back_off(attempt, retry_after(header), random.random())

    def outcome(self, good: bool) -> None:
        self.failures = 0 if good else self.failures + 1
        if self.failures >= self.limits.retries:
            raise RateLimitError(f"{self.failures} calls in a row failed")


#: Answers that are worth another try.
AGAIN = frozenset({429, 500, 502, 503, 504})


def transient(status: int) -> bool:
    """Whether the source, not the request, is at fault."""
    return status in AGAIN


def call(request: Callable[[], tuple[int, dict, object]], pace: Pace, source: str) -> object:
    """The body of a request (status, headers, body), tried again on passing faults; RateLimitError in the end."""
    for attempt in itertools.count():
        pace.wait(source)
        status, headers, body = request()
        passing = transient(status)
        if status >= 400 and not passing:
            raise LookupError(f"{source} answered {status}")
        pace.outcome(not passing)
        if not passing:
            return body
        pace.sleep(pace.pause(attempt, headers.get("Retry-After")))


class Run:
    """One run over several sources: a source that fails passingly once is skipped for the rest of it."""

    def __init__(self) -> None:
        self.throttled: set[str] = set()

    def ask(self, source: str, request: Callable[[], object]) -> object | None:
        """The answer, or None from a source that is skipped, fails, or does not have it."""
        if source in self.throttled:
            return None
        try:
            return request()
        except LookupError:
            return None
        except (RateLimitError, OSError):  # time-outs and refused connections among them
            self.throttled.add(source)
            return None

    def first(self, sources: Iterable[str], request: Callable[[str], object]) -> object | None:
        """The first answer of the sources in turn."""
        return next((a for s in sources if (a := self.ask(s, lambda s=s: request(s))) is not None), None)


def secret(value: str | None, names: Iterable[str], environment: Mapping[str, str]) -> str:
    """A key for a client: the value given, else the first of the names that the caller's environment has."""
    found = value or next((environment[n] for n in names if environment.get(n)), None)
    if not found:
        raise ValueError(f"no key given, and none of {', '.join(names)} is set")
    return found


def optional(make: Callable[[], object]) -> object | None:
    """A client, or None where its package or key is missing."""
    try:
        return make()
    except (ImportError, ValueError):
        return None


#: DOIs asked for in one request.
BATCH = {"crossref": 50, "openalex": 50, "zotero": 50, "semantic_scholar": 100}
#: Pairs of source and direction that a seed's references can come from.
CAN_LIST = {("crossref", "backward"), ("openalex", "backward"), ("openalex", "forward"), ("semantic_scholar", "backward")}


class WorkSource:
    """Works of one source out of a table of payloads (key, payload), which stands for the service: files written by a
    client, or rows of tests. ``fetch`` fills it from a live client, one batch at a time."""

    def __init__(self, name: str, payloads: DataFrame):
        self.name, self.payloads = name, payloads

    def by_dois(self, dois: DataFrame, single: bool = False) -> DataFrame:
        """Works of (doi) with the column source. ``single``: as asked one by one, where the library names no venue."""
        hit = self.payloads.join(dois.select(F.col("doi").alias("key")).distinct(), "key", "left_semi")
        out = normalise(hit, self.name, keep=[]).withColumn("source", F.lit(self.name))
        return out.withColumn("publication_title", F.lit("")) if single and self.name == "zotero" else out

    def references(self, seeds: DataFrame, direction: str) -> DataFrame:
        """(parent_doi, ref_index, work...) of seeds (doi); empty for pairs that the source does not offer."""
        if (self.name, direction) not in CAN_LIST or not {"direction", "ref_index"} <= set(self.payloads.columns):
            return normalise(self.payloads.limit(0).selectExpr("key as parent_doi", "0 as ref_index", "payload"), "crossref_reference")
        hit = self.payloads.where(F.col("direction") == direction).join(seeds.select(F.col("doi").alias("key")).where("key is not null").distinct(), "key", "left_semi")
        kind = "crossref_reference" if self.name == "crossref" else self.name
        return normalise(hit.select(F.col("key").alias("parent_doi"), "ref_index", "payload"), kind)


def fetch(spark: SparkSession, name: str, dois: Iterable[str], ask: Callable[[list[str]], dict[str, str]], pace: Pace, path: str, run: Run | None = None, budget: int | None = None) -> DataFrame:
    """(key, payload) of a live client ``ask``: DOIs in, DOI -> JSON out, kept under ``path``. At most ``budget`` calls;
    the source's limit on calls makes this serial by nature. Answers are written batch by batch, so the driver holds
    one, and what a source gave before it failed stays; DOIs that ``path`` has are not asked for again."""
    schema, run = "key string, payload string", run or Run()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    todo = spark.createDataFrame([(d,) for d in dict.fromkeys(dois)], "key string")
    todo = todo.join(spark.read.schema(schema).parquet(path), "key", "left_anti") if exists else todo
    left = (r["key"] for r in todo.orderBy("key").toLocalIterator())
    for n in itertools.count():
        batch = list(itertools.islice(left, BATCH.get(name, 50)))
        if not batch or name in run.throttled or budget is not None and n >= budget:
            break
        pace.wait(name)
        answers = run.ask(name, lambda: ask(batch)) or {}
        spark.createDataFrame(list(answers.items()), schema).coalesce(1).write.mode("append").parquet(path)
        exists = True
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
