import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlake.llm import html_text, near_text, near_vectors, packing, pieces, quality, sharding, suffix_dedup, toxicity, url_rules
from screenlake.operators.graph import components
from screenlake.stages import Stages

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def empty(docs):
    return docs.limit(0)


# 1


def test_pieces_round_trip_and_repeat(docs, rows):
    out = pieces.encode(docs, keep_text=True).collect()
    assert len(out) == len(rows) and all(r["lossless"] for r in out)
    assert {tuple(r["ids"]) for r in out if r["doc_id"] == 12}.__len__() == 1
    assert all(r["ids"] is None and r["n_tokens"] == 0 for r in out if r["text"] is None)
    assert all(r["ids"] == [] for r in out if r["text"] == "")
    again = pieces.encode(docs.repartition(3)).select("doc_id", "ids").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in pieces.encode(docs).select("doc_id", "ids").collect())
    back = pieces.decode(pieces.encode(docs.drop("text").withColumn("text", F.concat(F.lit("▁ 日 \x00"), F.lit("b  c\n"))))).select("text").distinct().collect()
    assert [r["text"] for r in back] == ["▁ 日 \x00b  c\n"]
    assert pieces.encode(empty(docs)).count() == 0


def test_pieces_sample_from_the_posterior():
    v = pieces.load(pieces.MODEL)
    table = {b.decode().replace(" ", pieces.MARK): i for i, b in enumerate(v.bytes_of) if b and v.weight[i] > -20 and i not in set(v.byte_ids.tolist())}
    word, power = "▁lightly", 0.3

    def all_paths(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in table:
                for rest in all_paths(s[k:]):
                    yield (table[s[:k]], *rest)

    want = {p: math.exp(power * sum(v.weight[i] for i in p)) for p in all_paths(word)}
    total, n = sum(want.values()), 60000
    flat, count = pieces.Lattices([word], v, power).sample(np.zeros(n, int), pieces.mix(np.arange(n).astype(np.uint64)))
    end = np.cumsum(count)
    got = Counter(tuple(flat[a:b].tolist()) for a, b in zip((end - count).tolist(), end.tolist()))
    assert set(got) <= set(want) and len(want) > 5
    for p, w in want.items():
        assert abs(got[p] / n - w / total) < 0.01


def test_pieces_do_not_depend_on_the_block():
    v = pieces.load(pieces.MODEL)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    keys, o = pieces.mix(np.arange(200).astype(np.uint64)), pieces.Options()
    ids, count = pieces.encode_block(texts, keys, v, o)
    parts = [pieces.encode_block(texts[a : a + 7], keys[a : a + 7], v, o) for a in range(0, 200, 7)]
    assert (np.concatenate([p[0] for p in parts]) == ids).all() and (np.concatenate([p[1] for p in parts]) == count).all()
    wide = pieces.Lattices([" ".join(texts[:40])[:3000].replace(" ", pieces.MARK)] + ["▁lightly"], v, 0.3)
    lone = pieces.Lattices(["▁lightly"], v, 0.3)
    salt = pieces.mix(np.arange(5000).astype(np.uint64))
    assert (wide.sample(np.ones(5000, int), salt)[0] == lone.sample(np.zeros(5000, int), salt)[0]).all()


# 2


def plain_counts(text):
    w = GAP.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(GAP.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts_equal_the_rules(docs, rows, spark):
    more = [(100, "a b c a b c x\na b\n\na b\n\n#*$"), (101, "x " * 70), (102, "\u3000é ü\u00a0ß"), (103, "q w e r " * 30 + " ".join(map(str, range(200))))]
    df = docs.select("doc_id", "text", "kept").union(spark.createDataFrame([(i, t, "x") for i, t in more], "a long, b string, c string"))
    got = quality.judge(df, None).collect()
    for r in got:
        want = plain_counts(r["text"])
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])
    assert quality.judge(empty(docs), None).count() == 0
    assert quality.train(docs, docs.limit(0).selectExpr("doc_id", "1 as quality")) is None


def test_forest_finds_held_out_anomalies(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    out = quality.judge(docs.select("doc_id", "text"), quality.train(docs, train)).join(test, "doc_id").where("not base_failed").collect()
    bad = [r for r in out if r["quality"] == 0]
    assert bad and sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(not r["kept"] for r in out if r["quality"] == 1) <= 0.02 * len(out)


def test_forest_finds_repeated_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    say = lambda bad: "\n".join(" ".join(word() for _ in range(8)) + bad * "\nRead more" for _ in range(rng.randint(10, 20)))
    rows = [(i, say(i % 2), 1 - i % 2) for i in range(240)]
    made = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.judge(made, quality.train(made, made.where("doc_id < 160"))).where("doc_id >= 160").collect()
    assert sum(not r["kept"] for r in out if not r["quality"]) >= 36 and sum(not r["kept"] for r in out if r["quality"]) <= 2


# 3


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    rows = [(int(i), [float(x) for x in v], int(i) % 2) for i, v in enumerate(base)]
    for i in range(60, 200):
        v = base[i % 20] + 0.12 * rng.standard_normal(8)
        rows.append((i, [float(x) for x in v * rng.uniform(0.1, 9)], i % 2))
    rows += [(300, rows[3][1], 1), (301, rows[3][1], 1), (302, rows[3][1], None), (303, None, 1), (304, [0.0] * 8, 1), (305, [1.0, None] + [0.0] * 6, 1), (306, [float("nan")] * 8, 1), (307, [float("inf")] + [1.0] * 7, 1), (308, [1.0] * 3, 1), (309, [1e300] * 8, 0), (310, [1e-300] * 8, 0), (None, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1)).withColumn("rep", F.lit("x"))
    good = {}
    for i, v, l in rows:
        if i is not None and v and l is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = (x / np.sqrt(x @ x), l)
    links = defaultdict(set)
    for i, (x, l) in good.items():
        for j, (y, m) in good.items():
            if i != j and l == m and x @ y >= 0.93:
                links[i].add(j)
    root = {i: i for i in good}
    for _ in range(len(good)):
        for i in good:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    for block in (2048, 16):
        got = near_vectors.link(df, near_vectors.Options(block=block)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is not None:
                i = r["vec_id"]
                assert (r["n_links"], r["component_id"]) == (len(links[i]), root.get(i, i)), i
                assert r["kept"] == (r["component_id"] == i)
    assert near_vectors.link(df.limit(0)).count() == 0
    assert near_vectors.miss_rate(near_vectors.Options(), rows=5000, pairs=1500) < 0.004


# 4


def test_shards_law_and_slots(docs, rows):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    for r in got:
        t = text[r["doc_id"]][0] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    assert sharding.shard(empty(docs)).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(6)
    rows, i = [], 0
    for copies in [1] * 400 + [2] * 40 + [3] * 20 + [12, 25, 40, 60] + [700]:
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randint(50, 400))) if copies < 700 else "hot " * 60
        for _ in range(copies):
            rows.append((None if i % 50 == 7 else i, text, rng.choice(["en", "fr", None]), rng.choice("abc")))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("x")).withColumn("large", F.lit(1))
    got = sharding.shard(df, 4).collect()
    assert len(got) == len(rows)
    by, of = defaultdict(list), defaultdict(set)
    for r in got:
        by[r["shard"]].append(r)
        of[r["text_crc32"], r["size"]].add(r["shard"])
    total, hot = sum(r["size"] for r in got), (zlib.crc32(b"hot " * 60), 241)
    assert [k for k, v in of.items() if len(v) > 1] == [hot]  # larger than a shard
    sizes = [sum(r["size"] for r in by[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= total / 4 * 0.06 and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    curve = sharding.hilbert_table(3, 4)
    for v in by.values():  # along the curve, large groups apart
        runs = [r["curve"] for r in sorted(v, key=lambda r: r["slot"])]
        assert set(runs) <= set(curve.tolist()) and sum(a > b for a, b in zip(runs, runs[1:])) <= 4


def test_large_groups_find_room():
    assert sharding.spread([(0, 10), (10, 10), (20, 5)], 40, 4) == [0, 1, 2] and sharding.spread([(0, 9), (9, 9)], 40, 4) == [0, 0 + 1] and sharding.spread([], 0, 4) == []


def test_shards_are_near_equal(spark):
    sizes = [r["b"] for r in sharding.query(spark, SF).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    biggest = spark.read.parquet(f"{SF}/documents.parquet").agg(F.max(F.octet_length("text"))).first()[0]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * (biggest + 1) + sum(sizes) / 64 / 16 * 2


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 4), (4, 2)):
        t = sharding.hilbert_table(dims, bits)
        cells = np.argsort(t)
        at = np.stack([(cells >> (bits * (dims - 1 - k))) & ((1 << bits) - 1) for k in range(dims)])
        assert sorted(t) == list(range(len(t))) and (np.abs(np.diff(at)).sum(0) == 1).all()


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site, name, and slogan of some length here.</p></header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="sidebar">Side text that is long enough, with commas, to count.</div>
<div id="page"><div class="post with-sidebar"><h1>Title &amp; more</h1><p><b>First &lt;block&gt;, with   text,
enough to count as prose.<br><p>Second&nbsp;one <a href="#">with a link</a> &eacute; &#x41;.</p><form><p>Your name, please, and more of it.</p></form><ul><li>Item one of the article</li></ul></div>
<div class="comments"><p>Nice post, really, I liked it a lot, thanks.</p></div></div><div class="cookie-notice">We use cookies, as all do, on this page.</div><footer>&copy; us</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html_text.extract(PAGE) == "Title & more\n\nFirst <block>, with text, enough to count as prose.\n\nSecond one with a link é A.\n\nItem one of the article"


def test_html_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no tags at all"), (4, "u", "<p>only"), (5, "u", "<script>x"), (6, "u", "<div" * 50), (7, "u", "<article><p>Short.</p></article><aside>Long text, with, many, commas, and more of it.</aside>"), (8, "u", "<p>" + "word, " * 50000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(None).cast("string"))
    got = {r["page_id"]: r for r in html_text.extract_pages(df).collect()}
    assert [got[k]["text"] for k in (1, 2, 5)] == ["", "", ""] and got[3]["text"] == "no tags at all" and got[4]["text"] == "only" and got[7]["text"] == "Short."
    assert got[8]["n_chars"] == 6 * 50000 - 1 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(3, 3), (1, 1), (3, 3, 3), (9, 3), (3, 9), (9, 4, 3, 3)])
def test_html_nested_sections_without_article(sizes):
    texts = [[f"Paragraph {j} of section {i}, with commas, and enough words to count as prose of the page." for j in range(n)] for i, n in enumerate(sizes)]
    row = lambda ps: "<div class='row'><div class='inner'>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></div>"
    page = "<body><nav><a href='/'>Home</a> menu</nav><div><a href='/a'>One link of many</a> <a href='/b'>another link of many</a></div><div id='page'>%s</div><div><p>Short blurb.</p></div><div class='comments'>%s</div></body>"
    got = html_text.extract(page % ("".join(map(row, texts)), row(["Nice post, really, I liked it a lot, thanks, and so on, and so on, and so on."] * 9)))
    assert got == "\n\n".join(p for ps in texts for p in ps)


def test_html_weak_text_elsewhere_is_no_reason_to_climb():
    body = "".join(f"<p>Paragraph {j}, with commas, and enough words to count as prose of the page.</p>" for j in range(9))
    page = f"<body><div><div><p>All about us, in a line of text.</p></div></div><div><div>{body}</div></div></body>"
    assert html_text.extract(page).startswith("Paragraph 0") and "about us" not in html_text.extract(page)
    assert html_text.extract("<div><div>Short a</div></div><div><div>Short b</div></div>") == "Short a"


PROSE = "First paragraph, with commas, and enough words to count as prose."


@pytest.mark.parametrize(("body", "want"), [
    (f"<p title='it's here'>{PROSE}</p><p>Don't.</p>", [PROSE, "Don't."]),
    (f"<p>{PROSE} <span class='ad'>Buy</span><span style='display:none'>no</span><a class='share'>share</a><i hidden>no</i> End.</p>", [PROSE + " End."]),
    (f"<p>{PROSE}</p><ul><li><a href='1'>One</a></li><li><a href='2'>Two</a></li></ul><div><a href='x'>Only a link</a></div>", [PROSE, "One", "Two", "Only a link"]),
    (f"<p>{PROSE} <button>b</button><label>l</label> <svg><g><path d='x'/></g></svg>Rest.</p>", [PROSE + " Rest."]),
    (f"<header class='entry-header'><h1>Title</h1></header><p>{PROSE}</p><footer>By us, all of us.</footer>", ["Title", PROSE]),
    (f"<p>{PROSE} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><p data-x=\"a > b\">Kept.</p>", [PROSE + " x=2", "Kept."]),
])
def test_html_article_parts(body, want):
    page = f"<body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><article>{body}</article><div class='related-posts'><p>{PROSE} Others.</p></div></body>"
    assert html_text.extract(page) == "\n\n".join(want)


def test_html_names_that_hold_a_word():
    outside = ["ad", "cookie-notice", "site-header", "comment-list", "post_footer", "related-posts", "share-buttons", "ad-slot-3", "newsletter-signup-box", "sideBar"]
    inside = ["legal-analysis", "header-image-story", "has-sidebar", "navy", "shareholder-report", "adventure", "body"]
    assert all(map(html_text.names_outside, outside)) and not any(map(html_text.names_outside, inside))
    for c in inside:
        assert html_text.extract(f"<body><div class='{c}'><p>{PROSE}</p></div></body>") == PROSE


def test_html_time_grows_with_length():
    from time import perf_counter

    for part in ("<div>", "<b><div>", "<div>a", "<li><div>x", "<x", "<a =", "<a b='", "<p><b>x"):
        began = perf_counter()
        html_text.extract(part * 30000 + "</b>" * 30000)
        assert perf_counter() - began < 5, part


class Tree(HTMLParser):
    """Text of the blocks of an article by the standard library's parser: a second, plain implementation for pages
    whose text is all in article elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.skip, self.parts = 0, [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "aside", "nav", "form", "footer", "header") or dict(attrs).get("class") in ("comments", "ad", "sidebar", "share", "related"):
            self.skip.append(tag)
        elif self.skip and tag == self.skip[-1]:
            self.skip.append(tag)
        self.open += tag == "article"
        if tag == "br":
            self.parts[-1].append(" ")
        elif tag not in html_text.INLINE:
            self.parts.append([])

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        self.open -= tag == "article"
        if tag not in html_text.INLINE:
            self.parts.append([])

    def handle_data(self, data):
        if self.open and not self.skip:
            self.parts[-1].append(data)

    def text(self):
        return "\n\n".join(t for t in (" ".join("".join(p).split()) for p in self.parts) if t)


def test_html_equals_a_plain_parser_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert set(got) == set(raw)
    for i, page in raw.items():
        t = Tree()
        t.feed(page or "")
        t.close()
        assert got[i] == t.text(), i


# 6


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    say = lambda n: [rng.choice("river stone light paper house green window music".split()) + rng.choice(["", "s"]) for _ in range(n)]
    rows = []
    for i in range(1200):
        words = say(40)
        k = 0 if i % 4 else rng.randint(1, 5)
        for _ in range(k):
            words[rng.randrange(40)] = rng.choice(["Idiot!", "moron", "trashy", "scum,"])
        rows.append((i, " ".join(words), int(k > 0), k))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, k int")
    model = toxicity.train(df, df.where("doc_id < 800").select("doc_id", "toxic"))
    assert (np.diff(model.cuts) >= 0).all()
    out = toxicity.judge(df.where("doc_id >= 800").withColumnRenamed("toxic", "gold").withColumn("grade", F.lit("x")), model).collect()
    assert all(r["toxic"] == bool(r["gold"]) for r in out)
    mean = lambda k: np.mean([r["severity"] for r in out if r["k"] == k])
    assert mean(0) < 0.5 < mean(1) < mean(3) < mean(5) <= 3


def test_toxicity_learns_graded_labels(spark):
    """Severities that only the labels know: one mild and one strong word, as often as each other."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        k = i % 4
        words = [rng.choice("river stone light paper house green window music".split()) for _ in range(30)]
        if k:
            words[rng.randrange(30)] = {1: "blimey", 2: "nitwit", 3: "scumbag"}[k]
        rows.append((i, " ".join(words), k))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.where("doc_id < 1000").select("doc_id", "toxic"))
    out = toxicity.judge(df.where("doc_id >= 1000").withColumnRenamed("toxic", "gold"), model).collect()
    assert (np.diff(model.cuts) > 0).all() and np.mean([r["grade"] == r["gold"] for r in out]) > 0.97
    assert all(r["toxic"] == (r["gold"] > 0) == (r["grade"] > 0) for r in out)


def test_toxicity_fit_equals_a_dense_one():
    rng = np.random.default_rng(4)
    dense = rng.random((60, 7)) < 0.3
    y = np.minimum(dense[:, 0] + dense[:, 1] + (rng.random(60) < 0.1), 3)
    row, at = np.nonzero(dense)
    x = toxicity.Rows(at, row, 60, 7)
    w = rng.standard_normal(7)
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(np.arange(60.0)), dense.T @ np.arange(60.0))
    keep = rng.random(60) < 0.5
    assert np.allclose(x.only(keep).dot(w), dense[keep] @ w)
    got, cuts = toxicity.fit(x, y)

    def loss(w, c):
        z = (dense @ w)[:, None] - c[None, :]
        over = y[:, None] > np.arange(3)[None, :]
        return np.mean(np.where(over, np.log1p(np.exp(-z)), np.log1p(np.exp(z))).sum(1)) + 5e-4 * w @ w

    best = loss(got, cuts)
    for _ in range(300):  # no near point is better
        assert loss(got + 0.05 * rng.standard_normal(7), np.sort(cuts + 0.05 * rng.standard_normal(3))) > best - 2e-3


def test_toxicity_features_are_made_in_parts():
    import pyarrow as pa

    texts = ["Alpha beta " * 40, None, "", "gamma " * 9, "delta", "x" * 2000, "beta"]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([0, 1, 0, 1, 0, 1, 0], pa.int32()), pa.array(texts)], ["doc_id", "__t", "text"])
    got = list(toxicity.word_lists(iter([b]), 450))
    assert [x.num_rows for x in got] == [3, 2, 1, 1]
    assert [r for x in got for r in x.to_pylist()] == [{"doc_id": i, "t": i % 2, "words": sorted(toxicity.features(t or ""))} for i, t in enumerate(texts)]
    assert max(x.num_rows for x in toxicity.word_lists(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([0] * 40, pa.int32()), pa.array(["w" * (1 << 18)] * 40)], ["doc_id", "__t", "text"])]))) == 4


def test_toxicity_odd_rows(docs, spark):
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    got = toxicity.judge(docs, None).collect()
    assert not any(r["toxic"] for r in got) and len(got) == docs.count()
    model = toxicity.Model({"scum": 2.0, "scum*": 1.0}, np.array([1.0, 2.0, 3.0]), 0.9)
    assert not any(r["toxic"] for r in toxicity.judge(docs, model).where("text is null or text = ''").collect())
    assert model.logits(["Scum of", '"scum"', "scummy", "", "scumx scum"]).tolist() == [3.0, 3.0, 1.0, 0.0, 3.0]
    assert toxicity.judge(empty(docs), model).count() == 0


# 7


def shingles(text):
    w = GAP.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_near(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(shingles(t)))
    root = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j])]
    for _ in range(len(linked) + 1):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize("block", [8192, 8])
def test_near_copies_equal_brute_force(docs, rows, spark, block):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    more = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        more.append((1000 + i, " ".join(t)))
    df = docs.select("doc_id", "text", "kept", "component_id").union(spark.createDataFrame([(i, t, "x", "x") for i, t in more], "a long, b string, c string, d string"))
    want = brute_near(rows + more)
    got = near_text.dedup(df, near_text.Options(block=block)).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"]), r
            assert r["n_shingles"] in {len(shingles(t)) for i, t in rows + more if i == r["doc_id"]}


def test_large_candidate_groups_split_by_signatures(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(2000)) for _ in range(n)]
    frame, texts = say(120), []
    for k in range(80):  # documents in one frame: often candidates of each other, linked with their own copy alone
        own = say(80)
        texts += [frame + own, frame + own[:-1] + ["other"]]
    texts += [texts[0][:]] * 3
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    seen, verified = [], near_text._verified

    def watched(docs, members, o):
        seen.append(members.groupBy("grp").count().agg(F.max("count"), F.count("*")).first())
        return verified(docs, members, o)

    monkeypatch.setattr(near_text, "_verified", watched)
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_near(rows)
    for block in (8192, 40, 6):
        got = near_text.dedup(df, near_text.Options(block=block)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) == 80
    assert seen[0][0] > 40  # whole candidate groups
    assert seen[1] == (2, 80) == seen[2]


def test_near_copies_of_nothing(docs):
    assert near_text.dedup(empty(docs)).count() == 0


def test_near_copies_stage_keeps_other_texts_of_an_id(spark):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, say(1), "a"), (1, say(2), "b"), (1, say(2), "c"), (1, None, "d"), (2, say(2), "e"), (3, None, "f"), (None, say(1), "g"), (4, say(4), "h"), (4, say(4), "h")]
    got = near_text.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    again = near_text.stage(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(3), "").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    assert texts == sorted([(1, say(1)), (1, say(2)), (1, ""), (3, ""), (0, say(1)), (4, say(4))])


def test_posterior_bounds_fall_as_expected():
    o = near_text.Options()
    need = near_text.least_matches(o)
    assert need == sorted(need) and 0 < need[-1] < 0.75 * o.hashes


# 8


def check_packing(got, lengths, o):
    bins, seen = defaultdict(list), defaultdict(int)
    for r in got:
        seen[r["doc_id"]] += r["length"]
        if r["bin"] is None:
            assert r["length"] == 0
            continue
        bins[r["bin"]].append(r)
    assert seen == lengths
    for part in bins.values():
        size = {r["bin_length"] for r in part}
        assert len(size) == 1
        at = 0
        for r in sorted(part, key=lambda r: r["place"]):
            assert r["place"] == at
            at += r["length"]
        assert size == {min(c for c in o.lengths if c >= at)}
    return bins


def test_packing_places_everything_once(docs, rows, spark):
    o = packing.Options(lengths=(64, 128, 256))
    lengths = defaultdict(int)
    for i, t in rows:
        n = len(GAP.findall(t or ""))
        lengths[i] += n + (n > 0)
    check_packing(packing.pack(packing.tokens(docs.select("doc_id", "text", "bin", "kept")), o).collect(), lengths, o)
    assert packing.pack(packing.tokens(empty(docs)), o).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 0), (3, -5), (4, 256), (4, 256), (5, 257)], "doc_id long, n_tokens long")
    assert packing.pack(odd, o).count() == 7


def brute_best_fit(items, o):
    """The same rule, one item at a time."""
    rooms, rest = [], sum(items)
    left = Counter(items)
    for n in sorted(items, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r[1] >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k][1])
        else:
            later = sum(x * c for x, c in left.items() if x <= n)
            size = packing.opening(n, left[n], later, sorted(set(items)), o)
            rooms.append([size, size])
            k = len(rooms) - 1
        rooms[k][1] -= n
        left[n] -= 1
    return sum(min(c for c in o.lengths if c >= s - r) for s, r in rooms)


def test_plan_is_as_tight_as_one_at_a_time():
    rng = random.Random(2)
    for _ in range(60):
        o = packing.Options(lengths=rng.choice([(16,), (8, 16, 32), (10, 25)]), overhead=rng.choice([0, 2]))
        items = [min(max(o.lengths), 1 + int(rng.expovariate(0.2))) for _ in range(rng.randint(1, 150))]
        runs = packing.plan(dict(Counter(items)), o)
        assert Counter(x for r in runs for x, e in r.items for _ in range(e * r.count)) == Counter(items)
        assert all(r.room >= 0 and sum(x * e for x, e in r.items) == r.length - r.room for r in runs)
        total = sum(min(c for c in o.lengths if c >= r.length - r.room) * r.count for r in runs)
        assert total <= brute_best_fit(items, o) * 1.1 + max(o.lengths)


# 9


def test_url_rules(spark):
    urls = [
        ("https://www.Example.COM/en/7x?y", "www.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://a.com/en/", "a.com", "/en/", "com/en/", "block"), ("http://a.com/EN/", "a.com", "/EN/", None, "allow"),
        ("ftp://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("x://a.org/es/1#z", "a.org", "/es/1", "org/es/", "block"),
        ("no scheme.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://cheap-pills.example.org", "cheap-pills.example.org", "", None, "block"), ("http://spillsy.org/x", "spillsy.org", "/x", None, "allow"),
        ("http://com", "com", "", None, "allow"), ("http://a.com?/en/", "a.com", "", None, "allow"), ("http://É.com/en/" + "a" * 50000, "É.com", "/en/" + "a" * 50000, "com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("rule", F.lit(3)).withColumn("host", F.lit("q"))
    got = url_rules.judge(df).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["page_id"]][1:], r
        assert r["n_tried"] <= 3
    assert url_rules.judge(df.limit(0)).count() == 0


def fits(text, url):
    """A pattern by plain search, one sign at a time."""
    def run(signs, at, first):
        if not signs:
            return True
        s, rest = signs[0], signs[1:]
        edge = lambda k: k < 0 or k >= len(url) or not url[k].isalnum() or url[k] > "z"
        if s == "||":
            slash = url.find("/") if "/" in url else len(url)
            return any(run(rest, k, False) for k in [0] + [k + 1 for k in range(slash) if url[k] == "."])
        if s == "*":
            return any(run(rest, k, False) for k in range(at, len(url) + 1))
        if s == "|":
            return at == 0 and run(rest, at, False) if first else at == len(url) and run(rest, at, False)
        if s == "^":
            return at in (0, len(url)) and run(rest, at, False) or at < len(url) and edge(at) and run(rest, at + 1, False)
        return any(url.startswith(x, at) and run(rest, at + len(x), False) for x in (s[1:-1].split(",") if s[0] == "{" else [s]))

    signs = re.findall(r"\{[^{}]*\}|\|\||[*^|]|[^*^|{}]+", text.removeprefix("@@"))
    anchored = signs[0] in ("|", "||")
    return run(signs, 0, True) if anchored else any(run(signs, k, False) for k in range(len(url) + 1))


def test_url_patterns_equal_plain_search(spark):
    rng = random.Random(13)
    words = "casino poker buy cheap online now pills payday loan history museum of wiki ads click9 redirect login php cart tag page feed www wp-login cgi-bin run exe search results a b crack free".split()
    urls = []
    for i in range(1500):
        host = ".".join(rng.choice(words) + rng.choice(["", "-" + rng.choice(words)]) for _ in range(rng.randint(1, 3)))
        path = "".join("/" + rng.choice(words) + rng.choice(["", "-", "."]) + rng.choice([*words, ""]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"])
        urls.append((i, f"http://{host}{path}", host + path))
    got = url_rules.judge(spark.createDataFrame([u[:2] for u in urls], "page_id long, url string"), url_rules.FILTERS).collect()
    want = {}
    for i, _, u in urls:
        hits = [r for r in url_rules.FILTERS if fits(r.name, u)]
        want[i] = (max(hits, key=lambda r: (r.rank, r.name)).verdict if hits else "allow", len(hits))
    assert len(got) == len(urls) and Counter(v for v, _ in want.values())["block"] > 200
    for r in got:
        assert r["verdict"] == want[r["page_id"]][0], r
        assert r["n_tried"] >= want[r["page_id"]][1]  # every rule that fits was fetched
    assert sum(r["n_tried"] for r in got) > sum(n for _, n in want.values())  # and the expressions turned some down
    with pytest.raises(ValueError):
        url_rules.pattern_rule("*casino*")


def test_url_rules_as_a_table(spark):
    """Twenty thousand rules as rows, of which a url tries the few that its tokens fetch."""
    rules = spark.range(20000).selectExpr("concat('r', id) as name", "1 as rank", "concat('(^|[^a-z0-9])w', id, '([^a-z0-9]|\\\\z)') as pattern", "'block' as verdict", "false as exact", "0 as branch", "array(concat('w', id), 'common') as tokens")
    urls = spark.createDataFrame([(1, "http://w7.com/common"), (2, "http://x.com/common/w19999"), (3, "http://x.com/common/w20000"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["n_tried"]) for r in url_rules.judge(urls, rules).collect()}
    assert got == {1: ("block", 1), 2: ("block", 1), 3: ("allow", 0), 4: ("allow", 0)}


# 10


def brute_removed(rows, width):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                hit[k : k + width] = b"\1" * width
        runs = sum(1 for k in range(len(b)) if hit[k] and (not k or not hit[k - 1]))
        out[i].append((len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("options", [suffix_dedup.Options(), suffix_dedup.Options(group=2), suffix_dedup.Options(piece=512)])
def test_passages_equal_brute_force(docs, rows, spark, options):
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(230))
    more = [(500 + i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 150))) + shared + "".join(rng.choice("ijk") for _ in range(90))) for i in range(12)]
    more += [(600, "x" * 1000), (601, "\x00" * 450), (602, "xyz" * 150)]
    df = docs.select("doc_id", "text", "kept", "removed", "key").union(spark.createDataFrame([(i, t, "x", "x", "x") for i, t in more], "a long, b string, c string, d string, e string"))
    got = defaultdict(list)
    for r in suffix_dedup.dedup(df, options).collect():
        n = len((r["text"] or "").encode())
        got[r["doc_id"]].append((n, n - len(r["kept"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    assert {i: sorted(v) for i, v in got.items()} == brute_removed(rows + more, 200)


def test_passages_find_repeats_by_the_sort_alone():
    rng = random.Random(12)
    for _ in range(40):
        pool = ["".join(rng.choice("abc") for _ in range(rng.randint(24, 60))) for _ in range(4)]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 3))).encode() for _ in range(6)]
        times = np.array([rng.choice([1, 1, 1, 3]) for _ in texts])
        froms = np.zeros(6, np.int64)
        tos = np.array([len(t) - 24 for t in texts])
        count = Counter()
        for t, n in zip(texts, times.tolist()):
            for k in range(len(t) - 23):
                count[t[k : k + 24]] += n
        row, first, last = suffix_dedup.repeated(texts, froms, tos, times, 24)
        got = {(r, k) for r, a, b in zip(row.tolist(), first.tolist(), last.tolist()) for k in range(a, b + 1)}
        assert got == {(r, k) for r, t in enumerate(texts) for k in range(len(t) - 23) if count[t[k : k + 24]] > 1}


def test_passages_of_nothing(docs):
    assert suffix_dedup.dedup(empty(docs)).count() == 0


def test_two_stage_sort_orders_suffixes():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 300)
        t = bytes(rng.choice(rng.choice([b"ab", b"abc", b"\x00\x01a", b"abcdefgh"])) for _ in range(n)) + b"\0"
        buf, mask = np.frombuffer(t, np.uint8), np.zeros(n + 1, bool)
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(n)
            mask[a : a + rng.randint(1, 100)] = True
        order = suffix_dedup.suffix_order(buf, mask, 24)
        keys = [t[i : i + 24].ljust(24, b"\0") for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(mask).tolist() and keys == sorted(keys)


# shared


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(Stages(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 140)) and got[200] == got[201] == 200


def test_passages_stage_keeps_own_replacement_characters(spark):
    passage = "".join(random.Random(3).choice("abcdefgh ") for _ in range(300))
    rows = [(1, "A \ufffd b \u00e9" + passage + "\u00e9 c \ufffd"), (2, "other \u0169" + passage + "\u00e8 \ufffdd"), (3, "no passage \ufffd")]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: "A \ufffd b  c \ufffd", 2: "other  \ufffdd", 3: "no passage \ufffd"}
    for cut in range(8):
        part = "x\u00e9\U0001f600".encode()
        assert suffix_dedup.characters(part[:cut], True, False) == part[:cut].decode("utf-8", "ignore").encode()
        assert suffix_dedup.characters(part[cut:], False, True) == part[cut:].decode("utf-8", "ignore").encode()
