"""Text functions as column expressions; the few that no built-in expresses are Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def preprocess(c: Column | str) -> Column:
    """Lower case; everything but letters, digits, _ and - to spaces; white space squeezed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}_-]+", " "))


def tokens(c: Column | str) -> Column:
    """Words of the preprocessed text; an empty array for null or empty texts."""
    plain = preprocess(c)
    return F.when(F.coalesce(plain, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def apart(c: Column) -> Column:
    """A preprocessed text with spaces of its own on both sides of each word, so that words are found as " word ": by
    plain search, where neighbours don't share a space."""
    return F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))


def occurrences(c: Column, part: str) -> Column:
    """How often a text holds ``part``, from left to right."""
    return F.when(F.contains(c, F.lit(part)), ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")).otherwise(0)


def condensed(cleaned: Column, words: Sequence[str]) -> Column:
    """A preprocessed text with its words of interest and hyphenated words only, a dot for what stood between them: terms
    made of ``words`` are found in it as in the whole text, by one lookup for each word however many terms there are."""
    kept = lambda w: w.isin(*words) | F.contains(w, F.lit("-"))
    marked = F.transform(F.split(F.coalesce(cleaned, F.lit("")), " "), lambda w: F.when(kept(w), w).otherwise("."))
    first_of_run = lambda a: F.filter(a, lambda w, i: (w != ".") | (i > 0) & (F.get(a, i - 1) != "."))
    return F.array_join(bound(marked, first_of_run), " ")


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column's value, which is worked out once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(c), use), 1)


#: Prefixes that a DOI may carry.
DOI_PREFIX = r"(?i)^(https?://(dx\.)?doi\.org/|doi:)"


def normalise_doi(c: Column | str) -> Column:
    """Trimmed, without one resolver prefix, lower case; null if nothing is left."""
    return F.nullif(F.lower(squeeze(F.regexp_replace(F.trim(_c(c)), DOI_PREFIX, ""))), F.lit(""))


def normalise_title(c: Column | str) -> Column:
    """White space squeezed, lower case; '' for null."""
    return F.lower(squeeze(F.coalesce(_c(c), F.lit(""))))


def squash_title(c: Column | str) -> Column:
    """Without any white space, lower case; '' for null."""
    return F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", ""))


def fold_title(title: str | None) -> str:
    """Compatibility-decomposed, without combining marks, lower case, only [0-9a-z] and single spaces."""
    plain = (ch for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", title or "")) if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^0-9a-z\s]", "", "".join(plain).lower()).split())


@F.pandas_udf(T.StringType())
def match_title(titles: pd.Series) -> pd.Series:
    return titles.map(fold_title, na_action=None)


@F.pandas_udf(T.DoubleType())
def title_similarity(work: pd.Series, ref: pd.Series) -> pd.Series:
    """Ratio of matching blocks of the folded titles; the order of the two counts."""
    return pd.Series([difflib.SequenceMatcher(None, fold_title(a), fold_title(b)).ratio() for a, b in zip(work, ref)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def plain_similarity(item: pd.Series, title: pd.Series) -> pd.Series:
    """As ``title_similarity``, on titles that are only squeezed and lower-cased."""
    def key(t):
        return " ".join((t or "").split()).lower()

    return pd.Series([difflib.SequenceMatcher(None, key(a), key(b)).ratio() for a, b in zip(item, title)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def parts(c: Column | str, separator: str) -> Column:
    """Trimmed pieces that are not empty."""
    return F.filter(F.transform(F.split(_c(c), separator), lambda x: F.trim(x)), lambda x: x != "")


def normalise_authors(c: Column | str) -> Column:
    """'Last, First and ...' to 'First Last; ...'; '' for null."""
    def flip(name: Column) -> Column:
        at = F.instr(name, ",")
        return F.when(at > 0, F.concat_ws(" ", F.trim(F.substring(name, at + 1, F.length(name))), F.trim(F.substring(name, F.lit(1), at - 1)))).otherwise(name)

    return F.coalesce(F.array_join(F.transform(parts(c, " and "), flip), "; "), F.lit(""))


def normalise_keywords(c: Column | str, separator: str = ",") -> Column:
    return F.nullif(F.array_join(parts(c, separator), "; "), F.lit(""))


def publication_title(entry_type: Column, journal: Column, booktitle: Column, publisher: Column) -> Column:
    """The field that an entry's type keeps its venue in; '' where it has none."""
    either = F.when(entry_type == "article", journal).when(entry_type.isin("inproceedings", "proceedings"), booktitle)
    either = either.when(entry_type == "inbook", F.coalesce(booktitle, publisher)).otherwise(F.coalesce(journal, booktitle))
    return F.trim(F.coalesce(either, F.lit("")))


def join_authors(authors: Column) -> Column:
    """Names of an array of structs (name, given, family), joined by '; '; '' for null."""
    def name(a: Column) -> Column:
        both = F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
        return F.trim(F.coalesce(F.nullif(a["name"], F.lit("")), both))

    return F.coalesce(F.array_join(F.filter(F.transform(authors, name), lambda x: x != ""), "; "), F.lit(""))


def first(c: Column) -> Column:
    """First of an array, '' for null or empty arrays."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


#: Entities of abstracts and what they stand for, in the order of replacement.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x2009;", " "), ("&#x200A;", " "), ("&#x200B;", ""))


def strip_markup(c: Column | str) -> Column:
    """Tags to spaces, entities decoded, white space squeezed, none before punctuation; '' for null."""
    out = F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.regexp_replace(squeeze(out), r" ([.,;:!?])", "$1")


def inverted_index_text(index: Column | str) -> Column:
    """Text of a map word -> positions; '' for null."""
    pairs = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda x: x["p"].isNotNull())), lambda x: x["w"]), " "), F.lit(""))


QUOTES_FROM, QUOTES_TO = "“”‘’„‚«» ", "\"\"''\"'\"\" "


def plain_quote(c: Column) -> Column:
    """Lower case, plain quotes, white space squeezed; '' for null."""
    return F.lower(squeeze(F.translate(F.coalesce(c, F.lit("")), QUOTES_FROM, QUOTES_TO)))


def excerpt_fragments(excerpt: Column | str) -> Column:
    """The fragments between elision marks, plain, without empty ones and without a mark at the end."""
    cut = F.regexp_replace(F.coalesce(_c(excerpt), F.lit("")), r"(?U)[\s.\x{2026}]+\z", "")
    return F.filter(F.transform(F.split(cut, r"(?U)\s*(?:\[\.\.\.\]|\.{3,}|\x{2026})\s*"), plain_quote), lambda f: f != "")


def in_order(fragments: Column, whole: Column) -> Column:
    """Whether a plain text holds the fragments one after the other."""
    def step(at: Column, f: Column) -> Column:
        found = F.call_function("locate", f, whole, at)
        return F.when((at > 0) & (found > 0), found + F.length(f)).otherwise(F.lit(0))

    return F.aggregate(fragments, F.lit(1), step) > 0


def verify_excerpt(excerpt: Column | str, text: Column | str) -> Column:
    """Whether the fragments between elision marks occur in the text, in order; case, quotes and space don't count."""
    return bound(plain_quote(_c(text)), lambda whole: in_order(excerpt_fragments(excerpt), whole))


def parse_year(c: Column | str) -> Column:
    """A whole number, or null."""
    return F.trim(_c(c).cast("string")).try_cast("int")


def year_in_date(c: Column | str) -> Column:
    """The first four digits in a row of a date text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(\d{4})", 1), F.lit("")).try_cast("int")


def embedding_text(title: Column, abstract: Column) -> Column:
    has = F.coalesce(abstract, F.lit("")) != ""
    return F.when(has, F.concat(title, F.lit("\n"), abstract)).otherwise(title)


#: Source names that stand for a search in a database.
DATABASES = ("acm", "ieee", "springer", "semantic scholar")


def source_category(name: Column | str) -> Column:
    n = F.lower(_c(name))
    return F.when(n.contains("snowball"), "snowball").when(n.startswith("query") | n.isin(*DATABASES), "database_query").otherwise("other")


#: Why a reference has a status other than resolved.
REASONS = {
    "pending": "not yet processed",
    "fetch_error": "both sources failed (404/error on Crossref and OpenAlex)",
    "unresolved_no_doi": "no DOI and no title metadata to recover",
    "unresolved_title_failed": "title search found no confident match",
}


def status_reason(status: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.element_at(table, _c(status)), F.lit(""))


def binary_class(label: Column | str) -> Column:
    return F.when(_c(label) == "in-scope", "include").otherwise("exclude")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit("")) == ""


def stripped(c: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def llm_result(decision: Column, score: Column, confidence: Column, techniques: Column, rationale: Column) -> dict[str, Column]:
    """Fields of a screening answer; ``error`` where the label is none of the three."""
    from screenlake.schemas import LABELS

    label = F.lower(stripped(decision))
    return {
        "decision": F.when(label.isin(*LABELS), label), "score": score.try_cast("double"), "confidence": confidence.try_cast("double"),
        "matched_keywords": F.coalesce(techniques, F.array().cast("array<string>")), "rationale": F.coalesce(rationale, F.lit("")),
        "error": F.when(~label.isin(*LABELS), F.concat(F.lit("invalid decision: "), label)),
    }


def judge_result(score: Column, verdict: Column, rationale: Column) -> dict[str, Column]:
    """Score held to [0, 1]; an unknown verdict needs review."""
    v = F.lower(stripped(verdict))
    return {
        "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.try_cast("double"), F.lit(0.0)))),
        "verdict": F.when(v.isin("pass", "needs_review", "fail"), v).otherwise("needs_review"), "rationale": stripped(rationale),
    }
