import difflib
import random
import re

from pyspark.sql import functions as F

from screenlake.functions import text as X
from screenlake.functions.topic import STUDY, classify, clean, keyword_scores


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("o")).first()["o"]


def test_dois_and_titles(spark):
    for raw, want in ((" HTTPS://doi.org/10.1/A ", "10.1/a"), ("doi: 10.2/B", "10.2/b"), ("http://dx.doi.org/10.3/c", "10.3/c"), ("doi:", None), ("", None), (None, None)):
        assert one(spark, raw, X.normalise_doi) == want
    assert one(spark, "  A \t b\nC ", X.normalise_title) == "a b c" and one(spark, "A b\nC", X.squash_title) == "abc"
    assert one(spark, "Café: ﬁne—Résumé!", X.match_title) == X.fold_title("Café: ﬁne—Résumé!") == "cafe fineresume"
    assert one(spark, None, X.match_title) == ""


def test_authors_keywords_markup(spark):
    assert one(spark, "Doe, Jane and Roe, R. M. and Plain Name", X.normalise_authors) == "Jane Doe; R. M. Roe; Plain Name"
    assert one(spark, None, X.normalise_authors) == "" and one(spark, " a, ,b ", X.normalise_keywords) == "a; b" and one(spark, " , ", X.normalise_keywords) is None
    assert one(spark, "<jats:p>A &amp; B&#x2009;x</jats:p> , <b>c</b> .", X.strip_markup) == "A & B x, c."
    assert one(spark, {"b": [1, 3], "a": [0], "c": None}, X.inverted_index_text, "map<string,array<int>>") == "a b b"
    assert one(spark, "a&lt;b &eacute;", X.html_unescape) == "a<b é" and one(spark, "May 2019", X.year_in_date) == 2019 and one(spark, " 12x", X.parse_year) is None


def test_excerpts(spark):
    abstract = "We “probe” the  chip. Then we measure it; finally we conclude."
    cases = [("we \"probe\" the chip", True), ("probe [...] measure it", True), ("measure it ... probe", False), ("", True), ("finally we conclude…", True), ("absent", False), ("Then we … conclude...", True)]
    df = spark.createDataFrame([(e, abstract, w) for e, w in cases], "e string, a string, w boolean").withColumn("o", X.verify_excerpt("e", "a"))
    assert all(r["o"] == r["w"] for r in df.collect())


def test_found_excerpts_equal_the_check_of_each(spark):
    from screenlake.operators.screening import find_excerpts

    rng = random.Random(17)
    words = "we probe the chip then measure it finally “conclude” and so on in words".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None)]
    cuts = []
    for k in range(120):
        t = rng.choice(texts[:60])[1]
        a, b = sorted(rng.randint(0, len(t)) for _ in range(2))
        c = rng.randint(b, len(t))
        cuts.append((k, rng.choice([t[a:b], t[a:b] + " ... " + t[c:], t[c:] + "[...]" + t[a:b], t[a:b].upper() + "…", "", "we", "the chip"])))
    d, e = spark.createDataFrame(texts, "id long, abstract string"), spark.createDataFrame(cuts, "excerpt_id long, excerpt string")
    want = d.crossJoin(e).where(X.verify_excerpt("excerpt", "abstract")).select("id", "excerpt_id").collect()
    assert sorted(map(tuple, find_excerpts(d, e).collect())) == sorted(map(tuple, want)) and len(want) > 200


def test_similarity_is_the_ratio_of_folded_titles(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc é:") for _ in range(20)), "".join(rng.choice("abc é:") for _ in range(18))) for _ in range(50)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.title_similarity("a", "b").alias("s")).collect()
    assert all(r["s"] == difflib.SequenceMatcher(None, X.fold_title(r["a"]), X.fold_title(r["b"])).ratio() for r in got)


def plain_score(text):
    """Spans claimed one after the other, longest keyword first."""
    if not text or len(text.strip()) < 20:
        return 0.0
    t, taken, raw = clean(text), set(), 0.0
    for k in STUDY.by_length:
        for m in re.finditer(r"\b" + re.escape(clean(k)) + r"(?:s|es)?\b", t):
            if not taken & set(range(*m.span())):
                taken |= set(range(*m.span()))
                raw += STUDY.keywords[k][1]
    return min(raw / STUDY.most, 1.0)


def test_keywords_claim_spans(spark):
    rng = random.Random(3)
    parts = [*STUDY.keywords, "fiber", "pufs", "sram", "based", "attack", "attacks", "and", "the", "é", "-", "laser-fault", "probings"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", None, "short fib", "An SRAM PUF-based design with fibs, FIB; fibrosis"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    for r in keyword_scores(df, "t").collect():
        assert abs(r["keyword_score"] - plain_score(r["t"])) < 1e-12, r["t"]
    assert STUDY.most == 71.0


def test_three_classes(spark):
    cases = [("Physical attacks by laser on it with deep learning", 0.0, "hybrid"), ("FIB milling of the chip", 0.0, "in-scope"), ("A neural network model", 1.0, "out-of-scope"), ("Nothing of the kind", 0.1, "out-of-scope"), ("Nothing of the kind", 0.2, "in-scope"), ("fiber and Fibonacci", 0.0, "out-of-scope"), (None, 0.2, "in-scope")]
    df = spark.createDataFrame(cases, "t string, s double, w string").withColumn("o", classify("t", "s", 0.2))
    assert all(r["o"] == r["w"] for r in df.collect())


def test_answers(spark):
    df = spark.createDataFrame([("In-Scope ", "0.5", None, None, None), ("maybe", "x", "1", ["a"], "r")], "d string, s string, c string, t array<string>, r string")
    got = df.select(*[v.alias(k) for k, v in X.llm_result(*[F.col(c) for c in "dsctr"]).items()]).collect()
    assert got[0]["decision"] == "in-scope" and got[0]["score"] == 0.5 and got[0]["error"] is None and got[1]["decision"] is None and got[1]["score"] is None and "maybe" in got[1]["error"]
    j = spark.createDataFrame([("3", "PASS ", None), ("-1", "odd", "r")], "s string, v string, r string")
    got = j.select(*[v.alias(k) for k, v in X.judge_result(F.col("s"), F.col("v"), F.col("r")).items()]).collect()
    assert [(r["score"], r["verdict"]) for r in got] == [(1.0, "pass"), (0.0, "needs_review")]
