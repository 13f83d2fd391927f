"""Filter audit, word-end BPE and hard negatives against plain loops, the tokenizers library and each other's edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from screenlake.llm import filter_audit, hard_negatives, html_text, near_text, suffix_dedup, url_rules, word_bpe
from screenlake.stages import Stages

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


# filter audit


def failing(text, doc_id, first):
    words = GAP.findall(text)
    return "".join(f for f, bad in zip("ABCDE", (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
        doc_id is not None and first.get(text) is not None and first[text] < doc_id)) if bad)


def brute_audit(rows, labels):
    """rows: (doc_id, text, part); labels: (doc_id, quality, toxic). Every order is walked document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    docs = defaultdict(list)
    for i, t, p in rows:
        docs[p or ""].append((failing(t or "", i, first), i in good, i in toxic))
    for part, here in docs.items():
        for order in permutations("ABCDE"):
            left = list(here)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(gone)
                fails = sum(f in d[0] for d in here)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(d[0] == f for d in here), sum(d[1] for d in gone), sum(d[2] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(docs, labels):
    st = Stages(docs.sparkSession, "audit-test")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = filter_audit.audit(filter_audit.masks(docs, labels, st)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got}
    assert len(out) == len(got)
    return out


def test_audit_equals_walking_every_order(spark, docs):
    rng = random.Random(3)
    said = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(1, 60), 3, 5, None]]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    shout = spark.createDataFrame([(70 + k, t, "hot", s) for k, (t, s) in enumerate([("SHOUT " * 60, "a"), ("# x " * 30, None), ("", "b"), (None, ""), ("a b " * 40, "a"), ("a b " * 40, "b"), ("a b " * 40, None)] * 3)], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").union(shout)
    bare = spark.createDataFrame([(None, "a b " * 40, "x", "a"), (None, "", "x", "z"), (75, "a b " * 40, "x", "a"), (75, "a b " * 40, "x", "a")], both.schema)
    both = both.union(bare).withColumns({c: F.lit("x") for c in ("part", "m", "n", "mask", "quality")})
    rows = [(r["doc_id"], r["text"], r["source"]) for r in both.collect()]
    want = brute_audit(rows, said)
    assert audit_rows(both, labels) == want and any(v[2] and v[4] for v in want.values())
    assert audit_rows(both.limit(0), labels) == {}
    assert {k: v[:4] for k, v in audit_rows(both, labels.limit(0)).items()} == {k: v[:4] for k, v in want.items()}


def test_audit_value_is_the_mean_over_orders_and_exact():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 10**12, 32)
    got = filter_audit.shapley(filter_audit.coefficients(counts))
    want = [sum(Fraction(int(counts[m]), bin(m).count("1")) for m in range(32) if m >> i & 1) for i in range(5)]
    assert got == want and sum(got) == counts[1:].sum()


def test_audit_hot_text(spark):
    """A text that most rows have, in many sources."""
    hot = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one text " * 30).alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    got = audit_rows(hot, spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int"))
    assert sum(got[str(p), "EABCD", 1][1] for p in range(7)) == 19999 and got["0", "EABCD", 1][0] == 1 and got["5", "EABCD", 1][4:6] == (1, 1)


# word-end BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe.Options().model)


@pytest.fixture(scope="module")
def encoder():
    return word_bpe.Encoder(word_bpe.load(word_bpe.Options().model))


def same_ids(encoder, library, texts):
    ids, count = encoder.encode(texts, 1 << 16)
    at = 0
    for t, n, want in zip(texts, count.tolist(), library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at : at + n].tolist() == want.ids, t
        at += n


def test_bpe_words_of_all_kinds(encoder, library):
    rng = random.Random(2)
    shown = list(library.get_vocab())
    glued = ["".join(rng.choice(shown).replace("</w>", "") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    letters = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    runs = [c * n for c in ("a", "!", "=-", "ab", "é", "日", "1") for n in range(1, 70)]
    odd = ["<|endoftext|>Hello <|startoftext|>'S we'LL <|ENDOFTEXT|> <|endoftext|", "<|endoftext|><|endoftext|>", "", " \n\t", "é ﬁ ẛ̣ Å", "İ ΑΣ ΑΣ. \x1c\x1d a\x85b​c \x00", "don't I'VE 'tis ''s", "a" * 50000, "🙂👍🏽 x🙂y"]
    same_ids(encoder, library, glued + letters + runs + odd)
    same_ids(encoder, library, [f"a{chr(c)}b {chr(c).upper()}" for c in range(0x1000) if not 0xD800 <= c < 0xE000 and chr(c).isprintable() and word_bpe.unicodedata.category(chr(c)) != "Cn"])


def test_bpe_pairs_agree_with_merging(encoder):
    """A pair stays apart if and only if merging the joined symbols by rank gives the two again."""
    pairs, table = encoder.pairs, {s: i for i, s in word_bpe.load(word_bpe.Options().model)["tokens"].items()}
    symbols = {i: s for s, i in table.items()}

    def merged(ids):
        ids = list(ids)
        while True:
            ranks = [(pairs.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs.rank]
            if not ranks:
                return ids
            rank, k = min(ranks)
            made = next(m for m in (table.get(symbols[ids[k]] + symbols[ids[k + 1]]),) if m is not None)
            ids[k : k + 2] = [made]

    rng = random.Random(4)
    inner = [i for i, s in symbols.items() if ord(s[-1]) < 256 and s.isascii()]
    for _ in range(1500):
        a, b = rng.choice(inner), rng.choice(list(symbols))
        want = merged([table[c] for c in symbols[a] + symbols[b]]) == [a, b]
        assert pairs.apart[a << 32 | b] == want


def test_bpe_steps_back(encoder):
    """Always taking the longest token is not what merging gives."""
    differ = 0
    for k in range(300):
        w = "".join(random.Random(k).choice(["the", "of", "and", "en", "re", "st", "our", "ti", "on"]) for _ in range(5))
        longest = [i for _, i in encoder.automaton.iter_long(w[:-1] + chr(256 + ord(w[-1])))]
        differ += longest != encoder.word(w)
    assert 50 < differ


def test_bpe_tables(spark, docs, rows, library):
    out = word_bpe.encode(docs)
    assert "text" not in out.columns and out.columns[-2:] == ["ids", "n_tokens"] and set(docs.columns) - {"text", "ids"} <= set(out.columns)
    got = [(r["doc_id"], r["n_tokens"], list(r["ids"])) for r in out.collect()]
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert sorted(map(repr, got)) == sorted(repr((i, len(w), w)) for (i, _), w in zip(rows, want))
    back = sorted(repr(r["text"]) for r in word_bpe.decode(out).collect())
    assert back == sorted(repr(library.decode(w, skip_special_tokens=False)) for w in want)
    assert word_bpe.encode(docs.limit(0)).count() == 0 and word_bpe.decode(out.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in word_bpe.decode(none).collect()} == {1: None, 2: ""}


def test_bpe_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.query(spark, SF).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


# hard negatives


def brute_negatives(rows, o, anchor=lambda i: i % 50 == 0):
    """rows: (id, whole numbers, label), each once, in the order of ids."""
    width = max((len(q) for _, q, _ in rows), default=0)
    x = [q + [0] * (width - len(q)) for _, q, _ in rows]
    out = []
    for a, (i, _, label) in enumerate(rows):
        if not anchor(i):
            continue
        score = [sum(p * q for p, q in zip(x[a], y)) for y in x]
        near = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-score[b], rows[b][0]))
        for p in [b for b in near if rows[b][2] == label][: o.positives]:
            s = score[p]
            fits = [b for b in near if rows[b][2] != label and o.low * s <= 100 * score[b] <= o.high * s][: o.negatives]
            out += [(i, rows[p][0], k, rows[b][0], s, score[b]) for k, b in enumerate(fits, 1)]
    return sorted(out)


def mined(df, o):
    return sorted(map(tuple, hard_negatives.mine(df, o).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("o", [hard_negatives.Options(anchors=2, rows=16, dims=5), hard_negatives.Options(anchors=500, rows=500, dims=64), hard_negatives.Options(anchors=3, rows=40, dims=7, low=0, high=100, positives=2, negatives=4)])
def test_negatives_equal_brute_force_for_any_blocks(spark, o):
    rng = np.random.default_rng(1)
    rows, kept = [], []
    for i in range(260):
        q = [int(v) for v in rng.integers(-3, 6, 17)]  # few values, so that scores tie
        label = int(rng.choice([0, 0, 0, 0, 1, 2, 3]))
        rows.append((i, [v / 256 + 0.001 for v in q], label, "x"))
        kept.append((i, q, label))
    rows += [rows[50], rows[50], rows[51]]  # repeated rows count once
    rows += [(300, None, 1, "x"), (350, [0.1, None], 1, "x"), (400, [float("nan")] * 17, 1, "x"), (401, [float("inf")] * 17, 0, "x"), (450, [0.5] * 17, None, "x"), (None, [0.5] * 17, 0, "x")]
    for i, v in ((500, [0.25, 0.5]), (550, [])):  # shorter ones end in zeros
        rows.append((i, v, 0, "x"))
        kept.append((i, [int(256 * x) for x in v], 0))
    kept.append((600, [9] * 17, 77))  # no positives
    rows.append((600, [9 / 256] * 17, 77, "x"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, turn string").withColumns({c: F.lit("x") for c in ("grp", "id", "h", "q", "k", "rank")})
    want = brute_negatives(kept, o)
    assert mined(df, o) == want and len(want) > 20
    assert mined(df.limit(0), o) == []


def test_negatives_of_large_numbers_stay_whole(spark):
    big = 2.0**20
    rows = [(0, [big, big / 256], 0), (1, [big, 1 / 256], 0), (2, [big * 0.75, 3 / 256], 1), (3, [big * 0.75, 2 / 256], 1)]
    kept = [(i, [int(256 * x) for x in v], c) for i, v, c in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, hard_negatives.Options()) == brute_negatives(kept, hard_negatives.Options()) != []


def test_scores_stay_in_their_tasks(spark):
    rng = np.random.default_rng(4)
    n, anchor = 4000, F.col("vec_id") % 4 == 0
    q = rng.integers(-90, 91, (n, 16))
    labels = rng.integers(0, 4, n)
    df = spark.createDataFrame([(i, (v / 256 + 0.001).tolist(), int(c)) for i, (v, c) in enumerate(zip(q, labels))], "vec_id long, embedding array<double>, label int")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    for more in ({}, {"stripe": 3}):
        o = hard_negatives.Options(anchors=100, rows=1500, dims=16, **more)
        before = shuffled()
        got = hard_negatives.mine(df, o, is_anchor=anchor).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
        assert shuffled() - before < 2 * n * n // 4  # bytes; one whole matrix of scores has four times as many
        want = []
        for a in range(0, n, 4):
            s = q @ q[a]
            order = np.lexsort((np.arange(n), -s))
            order = order[order != a]
            for p in order[labels[order] == labels[a]][: o.positives]:
                fits = order[(labels[order] != labels[a]) & (50 * s[p] <= 100 * s[order]) & (100 * s[order] <= 95 * s[p])][: o.negatives]
                want += [(a, p, k, x, s[p], s[x]) for k, x in enumerate(fits, 1)]
        assert sorted(map(tuple, got)) == sorted(want)


# what earlier operators got wrong

PROSE = "<p>This is a paragraph with enough words, commas, and length to count as prose in the article.</p>"
REMARK = "<p>I think that this remark, which is long, was left by a reader and is none of it.</p>"


def test_html_ids_and_words_inside_an_article():
    page = f'<article><h1>T</h1>{PROSE}<h2 id="market-share">Market</h2>{PROSE}<h2 id="legal">Legal</h2><h2 id="related">Related</h2><section id="legal">{PROSE}</section></article>'
    assert [len(x) for x in html_text.extract(page).split("\n\n")] == [1, 91, 6, 91, 5, 7, 91]
    names = ("left-side", "right-side", "cost-of-notice", "price-notice", "global-side", "side", "legal-analysis", "share-price")
    assert html_text.extract("<article>" + "".join(f'<div class="{n}">{PROSE}</div>' for n in names) + "</article>").count("paragraph") == len(names)
    for n in ("share", "social-links", "related-posts", "comments", "comment-list", "newsletter-box", "ad-slot", "notice"):
        assert html_text.extract(f'<article>{PROSE}<div class="{n}">{REMARK}</div></article>') == html_text.extract(f"<article>{PROSE}</article>")


def test_html_comment_areas_and_several_articles():
    alone = html_text.extract(f"<article>{PROSE}{PROSE}</article>")
    assert html_text.extract(f'<body><article>{PROSE}{PROSE}<div class="responses">{REMARK}</div></article><section class="discussion">{REMARK}{REMARK}</section></body>') == alone
    assert html_text.extract(f'<div>{PROSE}{PROSE}</div><div class="reader-comments">{REMARK}</div>') == alone
    assert html_text.extract(f"<div><article>{PROSE}</article></div><div><article>{PROSE}</article></div>") == alone
    assert html_text.extract("<article><p>AT&<b>lt;T</b> &amp; more of &lt;b&gt;</p></article>") == "AT&lt;T & more of <b>"


def test_each_url_rule_fits_what_it_is_for(spark):
    """One url for each shipped pattern rule, in their order; the verdict is the rule's own."""
    urls = [
        "http://a.com/spam/", "http://best-casino.net/", "http://a.com/porn/x", "http://a.com/viagra?x", "http://a.com/buy-shoes-online", "http://payday-loans.com/", "http://a.com/torrent/x", "http://a.com/crack/full-download/",
        "http://ads.a.com/x", "http://click9.com/redirect/", "http://a.com/login.php", "http://a.com/cart/", "http://a.com/wp-cron.php", "http://a.com/cgi-bin/run.pl", "http://a.com/tag/x/page/2",
        "http://a.com/search/x/results/", "http://www.a.com/feed/", "http://a.com/wiki/casino", "http://a.com/history-of-casino",
    ]
    assert len(urls) == len(url_rules.FILTERS)
    more = [(100, "http://click.ads9.com/a/redirect/x", 9)]
    rows = [(k, u, k) for k, u in enumerate(urls)] + more
    df = spark.createDataFrame(rows, "page_id long, url string, n int")
    for k, u, n in rows:
        own = url_rules.judge(df.where(F.col("page_id") == k), (url_rules.FILTERS[n],), default="none").first()
        assert own["verdict"] == url_rules.FILTERS[n].verdict, u


def plain_repeats(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(int(gone.sum()))
    return out


def test_repeated_rows_of_one_text(spark):
    """2,000 rows of one id and text, as many of one text without id, and near copies."""
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["river", "stone", "light", "paper", "walks", "seven", "amber"]) + str(rng.randint(0, 60)) for _ in range(n))
    a, b, c = say(400), say(300), say(300)
    near = a.replace(" ", " x ", 1)
    one = spark.createDataFrame([(1, a, 2000), (None, b, 2000), (2, near, 1), (3, c, 1), (4, c[:900] + say(50), 1)], "doc_id long, text string, n int")
    df = one.select("doc_id", "text", F.explode(F.sequence(F.lit(1), "n")).alias("k")).drop("k")
    got = {(r["doc_id"], r["gone"], r["n"]) for r in suffix_dedup.dedup(df).withColumn("gone", F.octet_length("text") - F.octet_length("kept")).groupBy("doc_id", "gone").agg(F.count("*").alias("n")).collect()}
    texts = [t.encode() for t in (a, a, b, b, near, c, c[:900] + one.collect()[4]["text"][900:])]
    want = plain_repeats(texts, 200)
    assert got == {(1, want[0], 2000), (None, want[2], 2000), (2, want[4], 1), (3, want[5], 1), (4, want[6], 1)}
    links = near_text.dedup(df, near_text.Options(block=8))
    found = {(r["doc_id"], r["component_id"], r["n"]) for r in links.groupBy("doc_id", "component_id").agg(F.count("*").alias("n")).collect()}
    assert {x for x in found if x[0] in (1, 2, None)} == {(1, 1, 2000), (None, None, 2000), (2, 1, 1)}
