"""Topics: weighted keywords in categories, and the signals that part the three classes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.text import apart, bound, condensed, preprocess

#: What a claimed span leaves behind.
CLAIMED = "\u0001"


@dataclass(frozen=True)
class Topic:
    """keyword -> (category, weight), and the two families of signals."""

    keywords: dict[str, tuple[str, float]]
    physical: tuple[str, ...]
    learning: tuple[str, ...]

    @property
    def most(self) -> float:
        return sum(w for _, w in self.keywords.values())

    @property
    def by_length(self) -> list[str]:
        return sorted(self.keywords, key=len, reverse=True)

    @property
    def vocabulary(self) -> list[str]:
        """All words that a keyword or signal has, with plural endings; words with a hyphen are left to the reader."""
        words = {w for t in (*self.keywords, *self.physical, *self.learning) for w in clean(t).split()}
        return sorted(w + ending for w in words for ending in ("", "s", "es"))

    def query_terms(self) -> dict[str, int]:
        """Words of all keywords with how often each occurs: the query of the ranking function."""
        out: dict[str, int] = {}
        for k in self.keywords:
            for w in clean(k).split():
                out[w] = out.get(w, 0) + 1
        return out


def clean(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s-]", " ", text.lower()).split())


# The topic of the study, its weights and its signals.
_CORE = {"puf": 2.0, "physical unclonable function": 2.0}
_ATTACKS = {
    "power analysis": 3.0, "side-channel": 3.0, "side channel": 3.0, "electromagnetic": 3.0, "em analysis": 3.0, "probing": 3.0,
    "invasive attack": 3.0, "semi-invasive": 3.0, "semi invasive": 3.0, "delayering": 3.0, "cloning": 3.0, "modeling attack": 3.0,
    "machine learning attack": 3.0, "fault injection": 3.0, "laser": 3.0, "focused ion beam": 3.0, "fib": 3.0, "physical attack": 2.5,
}
_KINDS = {
    "arbiter puf": 1.5, "ring oscillator": 1.5, "ro puf": 1.5, "sram puf": 1.5, "bistable ring": 1.5, "puf-based": 1.5, "puf based": 1.5,
    "memory puf": 1.5, "butterfly puf": 1.5,
}
_LEARNING_KEYWORDS = ("modeling attack", "machine learning attack")
_LEARNING = (
    "machine learning attack", "modeling attack", "dnn", "neural network", "neural networks", "deep learning", "ml attack",
    "machine learning", "artificial intelligence", "ai",
)

STUDY = Topic(
    {k: (c, w) for c, group in (("core", _CORE), ("attacks", _ATTACKS), ("puf_types", _KINDS)) for k, w in group.items()},
    tuple(k for k in _ATTACKS if k not in _LEARNING_KEYWORDS),
    _LEARNING,
)


def spaced(c: Column) -> Column:
    """A preprocessed text whose words and hyphens stand apart: a hyphen parts words, but is none."""
    return F.replace(apart(c), F.lit("-"), F.lit(" - "))


def forms(term: str) -> list[str]:
    """A term and its two plurals as a spaced text has them."""
    plain = clean(term).replace(" ", "  ").replace("-", " - ")
    return [f" {plain}{ending} " for ending in ("", "s", "es")]


def mentions(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a spaced text has one of the terms as a whole word, with or without a plural ending."""
    hit = F.lit(False)
    for t in terms:
        one, *more = forms(t)
        any_form = F.contains(text, F.lit(one))
        for m in more:
            any_form = any_form | F.contains(text, F.lit(m))
        hit = hit | F.contains(text, F.lit(one[:-1])) & any_form
    return hit


def keyword_scores(df: DataFrame, text: str, topic: Topic = STUDY, shortest: int = 20, cleaned: str | None = None) -> DataFrame:
    """``df`` plus keyword_score in [0, 1], keyword_raw and keyword_matched (keyword -> weight of its occurrences).

    The longest keyword claims its spans first: each step counts one keyword and masks it for the shorter ones, by
    plain search and only where the text has it. Texts under ``shortest`` characters and null texts score 0.
    One pass looks the topic's words up; each keyword is then searched in what is left of the text. ``cleaned``: a
    column that has the preprocessed text, or this rest of it, already.
    """
    plain = F.col(cleaned) if cleaned else condensed(preprocess(text), topic.vocabulary)
    out = df.withColumn("__m", F.when(F.length(F.trim(F.col(text))) >= shortest, spaced(plain)).otherwise(""))
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(CLAIMED), F.lit("")))
    counts, last = [], "__m"
    for i, k in enumerate(topic.by_length):
        one, *more = forms(k)
        has = F.contains(last, F.lit(one[:-1]))
        masked = F.replace(last, F.lit(one), F.lit(CLAIMED))
        for m in more:
            masked = F.replace(masked, F.lit(m), F.lit(CLAIMED))
        out = out.withColumn(f"__m{i}", F.when(has, masked).otherwise(F.col(last)))
        out = out.withColumn(f"__n{i}", F.when(has, marks(F.col(f"__m{i}")) - marks(F.col(last))).otherwise(0))
        counts.append((k, topic.keywords[k][1], F.col(f"__n{i}")))
        last = f"__m{i}"
    raw = sum((n * F.lit(w) for _, w, n in counts), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(k).alias("key"), (n * F.lit(w)).alias("value")) for k, w, n in counts])
    matched = F.map_from_entries(F.filter(each, lambda e: e["value"] > 0))
    out = out.withColumn("keyword_raw", raw).withColumn("keyword_matched", matched)
    score = F.least(F.col("keyword_raw") / F.lit(topic.most), F.lit(1.0)) if topic.most > 0 else F.lit(0.0)
    return out.withColumn("keyword_score", score).drop("__m", *[f"__{c}{i}" for i in range(len(counts)) for c in "mn"])


def signals(cleaned: Column, topic: Topic = STUDY) -> Column:
    """(physical, learning): whether a preprocessed text has terms of either family."""
    return bound(spaced(F.coalesce(cleaned, F.lit(""))), lambda t: F.struct(mentions(t, topic.physical).alias("physical"), mentions(t, topic.learning).alias("learning")))


def labelled(found: Column, score: Column, threshold: Column | float) -> Column:
    """Both families of signals: hybrid; physical only: in-scope; learning only: out-of-scope; none: by the score."""
    bar = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    physical, learning = found["physical"], found["learning"]
    return (F.when(physical & learning, "hybrid").when(physical, "in-scope").when(learning, "out-of-scope")
            .when(score >= bar, "in-scope").otherwise("out-of-scope"))


def classify(text: Column | str, score: Column | str, threshold: Column | float, topic: Topic = STUDY) -> Column:
    """The class of a text by its signals, else by its score (see ``labelled``)."""
    s = F.col(score) if isinstance(score, str) else score
    return bound(signals(condensed(preprocess(text), topic.vocabulary), topic), lambda found: labelled(found, s, threshold))
