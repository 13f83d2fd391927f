import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from screenlake.__main__ import show
from screenlake.functions import text as X
from screenlake.operators import citations, identity, screening, upserts
from screenlake.plans.engine import TOOLS, Engine, schema
from screenlake.plans.sql import prepared, select_only
from screenlake.schemas import TABLES
from screenlake.stages import Stages
from screenlake.sources import bibtex, payloads, tables, works
from screenlake.store import Store, from_first_layout, migrate
from screenlake.streaming import evals as stream

BIB = """@article{one,
  author = {Doe, Jane and Roe, R.},
  title = {{A {Great} Title}},
  journal = "J. of X",
  year = 2020,
  doi = {10.1/A},
  keywords = {a, b},
  abstract = {Some, text
   over lines}
}
junk
@InProceedings{two,
  title = {{Foo}-bar},
  booktitle = {Proc},
  year = {bad},
}
@misc{three, title = {lost},
  year = 1999
}
"""


def test_bibtex(spark, tmp_path):
    e = bibtex.parse(BIB)
    assert [x["cite_key"] for x in e] == ["one", "two", "three"] and e[0]["fields"]["title"] == "A {Great} Title" and e[0]["fields"]["abstract"] == "Some, text over lines" and e[1]["fields"]["title"] == "{Foo}-bar" and e[2]["fields"] == {"year": "1999"}
    for q, f in (("query1", "x_acm.bib"), ("query2", "y_ieee.bib"), ("query2", "other.bib"), ("else", "z_acm.bib")):
        (tmp_path / q).mkdir(exist_ok=True)
        (tmp_path / q / f).write_text(BIB)
    got = bibtex.read_query_folders(spark, str(tmp_path))
    assert sorted({(r["query"], r["platform"]) for r in got.collect()}) == [("query1", "ACM"), ("query2", "IEEE")] and got.count() == 6
    p = {r["cite_key"]: r for r in bibtex.papers(got.where("query = 'query1'")).collect()}
    assert p["one"]["authors"] == "Jane Doe; R. Roe" and p["one"]["publication_title"] == "J. of X" and p["one"]["error"] is None and p["two"]["error"].startswith("bad year")


def test_csv_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('entry_type,author,title,year,journal,booktitle,abstract,doi,keywords\narticle,"Doe, J. and Roe, R.","A ""q"" title",2020,J,,"two\nlines",10.1/a,"x, y"\nbook,A,T,2020,,,ab,,\narticle,A,T,x,J,,ab,,\n')
    got = sorted(tables.read_csv(spark, str(tmp_path / "a.csv"), "acm").collect(), key=lambda r: r["seq"])
    assert got[0]["error"] is None and got[0]["authors"] == "J. Doe; R. Roe" and got[0]["keywords"] == "x; y" and got[0]["title"] == 'A "q" title'
    assert "Unsupported" in got[1]["error"] and "integer" in got[2]["error"]
    (tmp_path / "i.csv").write_text("Document Title,Authors,Publication Year,Abstract,Publication Title,Author Keywords\nT,A B; C D,2019,ab,V,k;l\n,A,2019,ab,V,\n")
    got = sorted(tables.read_csv(spark, str(tmp_path / "i.csv"), "ieee").collect(), key=lambda r: r["seq"])
    assert got[0]["authors"] == "A B; C D" and got[0]["doi"] is None and got[0]["keywords"] == "k; l" and "Document Title" in got[1]["error"]


def plain_ingest(rows):
    papers, out = [], []
    for seq, doi, title, abstract in rows:
        d, t = (doi or "").strip() or None, " ".join((title or "").split()).lower()
        hit = next((p for p in papers if d and p["doi"] == d), None) or next((p for p in papers if t and p["t"] == t and (not d or not p["doi"] or p["doi"] == d)), None)
        if hit is None:
            hit = {"seq": seq, "doi": d, "t": t, "abstract": abstract}
            papers.append(hit)
        else:
            hit["abstract"] = hit["abstract"] or abstract
            hit["t"] = hit["t"] or t
        out.append((seq, hit))
    return {s: (p["seq"], p["abstract"] or None) for s, p in out}


def test_ingest_equals_the_loop(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, None, "", "10.1", "10.2", "10.3", "10.4"]), rng.choice([None, "", "A b", "a  B", "c", "d", "e"]), rng.choice([None, "x", "y"])) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, doi string, title string, abstract string")
    got = {r["seq"]: (r["paper"], r["abstract"] or None) for r in identity.ingest(df).collect()}
    assert got == plain_ingest(rows)
    counts = identity.ingest_counts(identity.ingest(df)).first()
    assert counts["inserted"] + counts["deduped"] == 120


def test_ingest_chains_of_decisions(spark):
    """Many small searches at once, in which titles and DOIs decide about each other in long chains."""
    rng = random.Random(12)
    rows = []
    for g in range(150):
        dois, titles, rare = rng.randint(1, 6), rng.randint(1, 6), rng.random()
        for _ in range(rng.randint(2, 40)):
            d = rng.choice([None, f"10.{g}/{rng.randint(1, dois)}"]) if rng.random() > rare * 0.3 else f"10.{g}/{rng.randint(1, dois)}"
            t = rng.choice([None, "", *[f"g{g} t{k}" for k in range(titles)]]) if rng.random() < 0.9 else None
            rows.append((len(rows), d, t, rng.choice([None, "x", "y"])))
    # a chain: each DOI's fate hangs on the title that the one before names
    for k in range(12):
        n = len(rows)
        rows += [(n, None, f"chain {k}", None)] if k == 0 else []
        n = len(rows)
        rows += [(n, f"10.9/{k}", f"chain {k}", "a"), (n + 1, None, f"chain {k + 1}", "b"), (n + 2, f"10.9/{k}", f"chain {k + 1}", "c")]
    got = {r["seq"]: (r["paper"], r["abstract"] or None) for r in identity.ingest(spark.createDataFrame(rows, "seq long, doi string, title string, abstract string")).collect()}
    assert got == plain_ingest(rows)


def test_ingest_of_one_large_group(spark):
    """One title and one DOI that most entries share, with many DOIs that name it: no task reads the group."""
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, "10.1/hot", f"10.1/{rng.randint(0, 9000)}"]), rng.choice(["the title", "the title", None, f"other {rng.randint(0, 500)}"]), None) for i in range(30000)]
    df = spark.createDataFrame(rows, "seq long, doi string, title string, abstract string")
    shelf, want = identity.Shelf(), {}
    for seq, d, t, _ in rows:
        t = t or ""
        k = shelf.find(d, t) if d or t else None
        if k is None:
            k = shelf.add(seq, d, t)
        elif t and not shelf.papers[k][2]:
            shelf.papers[k][2] = t
            shelf.name(k, t)
        want[seq] = shelf.papers[k][0]
    assert {r["seq"]: r["paper"] for r in identity.ingest(df).select("seq", "paper").collect()} == want


def test_lookup_order(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "Same title"), (2, None, "Same  title"), (3, "10.3/c", "Other"), (4, None, "Sp lit")], "id long, doi string, title string")
    refs = spark.createDataFrame([(1, "DOI:10.1/A", "x"), (2, None, "same TITLE"), (3, "10.9/z", "same title"), (4, None, "Split"), (5, None, None), (6, "10.9/z", "other")], "ref_id long, doi string, title string")
    assert {r["ref_id"]: r["paper_id"] for r in identity.find_existing(refs, papers).collect()} == {1: 1, 2: 1, 4: 4}


def test_short_titles_with_typos(spark):
    rng = random.Random(5)
    base = ["", "map of the pufs", "cryptanalysis", "a", "ab", "on puf aging", "A survey of ring oscillators", "modelling attacks on arbiters", "Élan vital of the SRAM cell", "aaaa aaaa aaaa"]

    def typo(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "s", "y", " "])
        return "".join(t)

    titles = [(i, typo(base[i % len(base)]), None) for i in range(80)] + [(90, "map of the puf", None), (91, "cryptanalysys", None), (92, "ab" * 120, None), (93, None, None)]
    works = [(100 + i, typo(base[i % len(base)]), None, i) for i in range(60)] + [(200, "map of the pufs", None, 200), (201, "cryptanalysis", None, 201), (202, "ab" * 119 + "x", None, 202)]
    r, w = spark.createDataFrame(titles, "ref_id long, title string, year int"), spark.createDataFrame(works, "work_id long, title string, year int, rank int")
    plain = lambda t: " ".join((t or "").split()).lower()
    for least in (0.85, 0.6):
        first, best = {}, {}
        for i, t, _ in titles:
            for j, x, _, k in works:
                if (s := difflib.SequenceMatcher(None, X.fold_title(x), X.fold_title((t or "").lower())).ratio()) >= least:
                    first[i] = min(first.get(i, (k, j, s)), (k, j, s))
                if (s := difflib.SequenceMatcher(None, plain(x), plain(t)).ratio()) >= least:
                    best[i] = max(best.get(i, (s, -k, j)), (s, -k, j))
        assert {x["ref_id"]: (x["work_id"], x["similarity"]) for x in identity.first_title_match(r, w, least=least).collect()} == {i: m[1:] for i, m in first.items()}
        assert {x["ref_id"]: (x["work_id"], x["similarity"]) for x in identity.best_title_match(r, w, least=least).collect()} == {i: (m[2], m[0]) for i, m in best.items()}


def test_few_pairs_of_titles_are_compared(spark):
    """No pair of the ratio is missed, and what is compared stays close to what matches as the works grow."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 9)))
    works = [say() for _ in range(1600)] + ["", "a", "b"]
    refs = [t[:3] + t[4:-2] + "x" for t in works[:40]] + ["", "ab"] + [say() for _ in range(20)]
    frame = lambda rows: spark.createDataFrame([(t,) for t in dict.fromkeys(rows)], "k string")
    found = {}
    for n in (400, 1603):
        got = {(r["rk"], r["wk"]) for r in identity.candidates(frame(refs), frame(works[:n]), 0.85).collect()}
        want = {(a, b) for a in refs for b in works[:n] if difflib.SequenceMatcher(None, b, a).ratio() >= 0.85}
        assert want <= got and len(want) >= 30
        found[n] = len(got) / len(refs)
    assert found[1603] < 1.5 * found[400] < 2, found


def test_titles_within_a_year(spark):
    refs = spark.createDataFrame([(1, "A study of ring oscillators.", 2000), (2, "Nothing alike", None)], "ref_id long, title string, year int")
    w = spark.createDataFrame([(1, "A Study of Ring-Oscillators", 2004, 0), (2, "A study of ring oscillators", 2001, 1), (3, "A study of ring oscillators", None, 2)], "work_id long, title string, year int, rank int")
    assert [(r["ref_id"], r["work_id"]) for r in identity.first_title_match(refs, w).collect()] == [(1, 2)]
    assert identity.best_title_match(refs, w).first()["work_id"] in (2, 3)


def test_citation_steps(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "Seed", ""), (2, "10.2/b", "Known", "has"), (3, None, "Titled", "")], "id long, doi string, title string, abstract string").withColumns({"year": F.lit(2000), "authors": F.lit("")})
    lists, edges = spark.createDataFrame([], TABLES["reference_lists"].schema), spark.createDataFrame([], TABLES["snowball_edges"].schema)
    fetched = spark.createDataFrame([("10.1/A", 0, "10.2/B", "Known", None, 2000, ""), ("10.1/A", 1, None, "Lost one", None, 2001, ""), ("10.1/A", 2, "10.7/q", "Far", None, 2002, ""), ("10.1/A", 3, None, "", None, None, "text"), ("10.1/A", 4, None, "Lost one", None, 2001, "")], "parent_doi string, ref_index int, doi string, title string, authors string, year int, unstructured string")
    lists, edges, n = citations.harvest(papers.where("id = 1"), papers, fetched, lists, edges)
    assert n.first().asDict() == {"references_harvested": 5, "local_hits": 1}
    got = {r["ref_index"]: r["status"] for r in lists.collect()}
    assert got == {0: "resolved", 1: "pending", 2: "pending", 3: "pending"} and [(r["child_paper_id"], r["parent_paper_id"]) for r in edges.collect()] == [(2, 1)]
    st = Stages(spark, "test")
    lists, edges = st.save("lists", lists), st.save("edges", edges)
    again, _, _ = citations.harvest(papers.where("id = 1"), papers, fetched, lists, edges)
    assert again.count() == 4
    w = spark.createDataFrame([("10.7/Q", "Far", "", 2002, "abs", "", None, "openalex")], "doi string, title string, authors string, year int, abstract string, publication_title string, pdf_url string, source string")
    cands = spark.createDataFrame([], "ref_id long, work_id long, work_title string, work_year int, rank int")
    out, _ = citations.resolve(lists, papers, edges, w, cands)
    assert {r["ref_index"]: r["status"] for r in out.collect()} == {0: "resolved", 1: "unresolved_title_failed", 2: "resolved", 3: "unresolved_no_doi"}
    assert {r["ref_index"]: r["status"] for r in citations.apply_status(lists, citations.resolve_dois(lists, w, papers, throttled=("openalex",))).collect()}[2] == "fetch_error"
    assert citations.resolve_dois(lists, w, papers, budget=0).where("status = 'fetch_error'").count() == 0
    more = papers.union(papers.where("id = 1").selectExpr("9L", "'10.7/Q'", "'Far'", "''", "2000", "''"))
    done, linked, missing = citations.verify(lists, more, edges)
    assert done.where("ref_index = 2").first()["resolved_paper_id"] == 9 and linked.count() == 2 and missing.count() == 0
    filled = citations.backfill(papers, spark.createDataFrame([("10.1/A", "late", "crossref"), ("10.1/a", "first", "zotero"), ("10.2/b", "no", "zotero")], "doi string, abstract string, source string"))
    assert {r["id"]: r["abstract"] for r in filled.collect()} == {1: "first", 2: "has", 3: ""}
    found = spark.createDataFrame([(3, "10.2/B", "abs", 1999, 0), (3, "10.8/n", "later", None, 1)], "paper_id long, doi string, abstract string, year int, rank int")
    r = identity.fill_missing(papers, found).where("id = 3").first()
    assert r["abstract"] == "abs" and r["doi"] is None and r["year"] == 2000


def test_resolved_works_become_papers(spark):
    """One step at a time: known by DOI, known by title without a DOI, new, new twice, and a DOI that is no paper's."""
    papers = spark.createDataFrame([(1, "10.1/a", "Seed", "x", "", 2000), (2, None, "Titled Work", "", "", 0), (3, "10.3/c", "Same name", "x", "A", 1999)], "id long, doi string, title string, abstract string, authors string, year int")
    papers = papers.withColumns({"publication_title": F.lit(""), "keywords": F.lit(None).cast("string"), "pdf_url": F.lit(None).cast("string")})
    rows = [(1, "10.3/C", ""), (2, "10.2/b", ""), (3, "10.9/new", ""), (4, "https://doi.org/10.9/NEW", ""), (5, "10.8/s", ""), (6, "doi:", "t"), (7, "10.7/gone", ""), (8, None, "Fresh title"), (9, None, "fresh  TITLE."), (10, None, ""), (11, None, "No match")]
    refs = spark.createDataFrame([(i, 1, "backward", i, d, t, 2001, "crossref", None, "pending") for i, d, t in rows], "id long, parent_paper_id long, direction string, ref_index int, ref_doi string, ref_title string, ref_year int, source string, resolved_paper_id long, status string")
    lists = refs.select(*[(F.col(f.name) if f.name in refs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["reference_lists"].schema])
    edges = spark.createDataFrame([], TABLES["snowball_edges"].schema)
    w = spark.createDataFrame([
        ("10.3/c", "Same name", "", 1999, "late", "crossref"), ("10.2/B", "titled  work", "W", 2003, "abs", "openalex"), ("10.9/new", "New one", "N", 2004, " a ", "crossref"), ("10.9/new", "Worse", "", 1, "", "openalex"),
        ("10.8/s", "Same name", "S", 2005, "", "crossref"), ("10.7/gone", "Only there", "", 2006, "", "semantic_scholar")], "doi string, title string, authors string, year int, abstract string, source string").withColumns({"publication_title": F.lit("V"), "pdf_url": F.lit("u")})
    cands = spark.createDataFrame([(8, 80, "Fresh Title", 2001, 0, "crossref", None), (8, 81, "Fresh title", 2009, 0, "openalex", None), (9, 90, "Fresh title", 2002, 0, "openalex", "10.5/f"), (11, 1, "Something else", 2001, 0, "openalex", None)], "ref_id long, work_id long, work_title string, work_year int, rank int, source string, doi string")
    r = citations.expand(lists, papers, edges, w, cands)
    got = {x["id"]: (x["status"], x["resolved_paper_id"]) for x in r.lists.collect()}
    made = {x["title"]: x for x in r.papers.where("id > 3").collect()}
    assert set(made) == {"New one", "Same name", "Fresh Title"} and r.counts["new_papers"] == 3 and r.new_papers.count() == 3
    new, same, fresh = (made[t]["id"] for t in ("New one", "Same name", "Fresh Title"))
    assert got == {1: ("resolved", 3), 2: ("resolved", 2), 3: ("resolved", new), 4: ("resolved", new), 5: ("resolved", same), 6: ("fetch_error", None), 7: ("fetch_error", None), 8: ("resolved", fresh), 9: ("resolved", fresh), 10: ("unresolved_no_doi", None), 11: ("unresolved_title_failed", None)}
    known = {x["id"]: x for x in r.papers.collect()}
    assert (known[2]["doi"], known[2]["abstract"], known[2]["year"], known[2]["authors"]) == ("10.2/B", "abs", 2003, "W") and known[3]["abstract"] == "x" and known[new]["abstract"] == "a" and known[fresh]["doi"] == "10.5/f" and known[new]["pdf_url"] == "u"
    assert sorted((e["child_paper_id"], e["parent_paper_id"]) for e in r.edges.collect()) == sorted((c, 1) for c in (2, 3, new, same, fresh)) and r.counts["edges"] == 5
    again = citations.expand(r.lists, r.papers, r.edges, w, cands)
    assert again.counts["new_papers"] == again.counts["edges"] == 0 and again.statuses == r.statuses == {"resolved": 7, "fetch_error": 2, "unresolved_no_doi": 1, "unresolved_title_failed": 1}
    # a throttled source passes its work on to the next of the chain (the library goes before the last); a strict one has no other
    status = lambda **o: {x["ref_id"]: x["status"] for x in citations.resolve_dois(lists, w, papers, **o).collect()}
    assert status(throttled=("crossref", "openalex", "zotero"))[7] == "resolved" and status(throttled=("crossref", "openalex"))[7] == "fetch_error" and status(source="semantic_scholar")[1] == "fetch_error" and status(alternates=False)[2] == "fetch_error"
    assert {x["status"] for x in citations.resolve_titles(lists, cands, "semantic_scholar").collect()} == set()


def plain_find_or_create(papers, works):
    known = [list(p) for p in papers]
    out, low = {}, lambda t: " ".join((t or "").split()).lower()
    squash = lambda t: "".join((t or "").split()).lower()
    for seq, d, t in works:
        d = (d or "").lower() or None
        hit = next((p for p in known if d and (p[1] or "").lower() == d), None)
        if hit is None and low(t):
            named = [p for p in known if low(p[2]) == low(t)] or [p for p in known if squash(p[2]) == squash(t)]
            hit = next((p for p in named if not d or not p[1] or p[1].lower() == d), None)
        if hit is None:
            hit = [f"new {seq}", d, t]
            known.append(hit)
        hit[1] = hit[1] or d
        out[seq] = hit[0]
    return out


def test_find_or_create_equals_the_loop(spark):
    rng = random.Random(21)
    title = lambda: rng.choice([None, "", "A b", "a  B", "ab", "c d", "cd", "e", "f g"])
    papers = [(i, f"10.1/P{i}" if rng.random() < 0.5 else None, title()) for i in range(1, 25)]
    works_ = [(i, rng.choice([None, None, "10.1/p3", "10.1/p4", "10.2/x", "10.2/y", "10.2/z", f"10.3/{i}"]), title()) for i in range(150)]
    got = identity.find_or_create(spark.createDataFrame(papers, "id long, doi string, title string"), spark.createDataFrame(works_, "seq long, doi string, title string"))
    assert {r["seq"]: r["paper_id"] if r["paper_id"] is not None else f"new {r['maker']}" for r in got.collect()} == plain_find_or_create(papers, works_)


def test_backfill_by_doi_then_title(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "A title", ""), (2, None, "A lost paper", ""), (3, None, "Other lost paper", ""), (4, "10.4/d", "D", ""), (5, None, "Kept as is", "has")], "id long, doi string, title string, abstract string").withColumn("year", F.lit(2000))
    w = spark.createDataFrame([("10.1/A", "from s2", "semantic_scholar"), ("10.1/a", "from openalex", "openalex"), ("10.4/d", "", "crossref"), ("10.4/d", "lib", "zotero")], "doi string, abstract string, source string")
    c = spark.createDataFrame([(2, 1, "A Lost Paper.", 2001, 0, "openalex", "10.9/o", "o"), (2, 2, "A Lost Paper", 2001, 0, "crossref", "10.9/C", " c "), (3, 3, "Other lost papers", 1999, 0, "crossref", "10.4/D", ""), (5, 4, "Kept as it", 2000, 0, "crossref", "10.5/k", "no")], "ref_id long, work_id long, work_title string, work_year int, rank int, source string, doi string, abstract string")
    got = {r["id"]: (r["doi"], r["title"], r["abstract"]) for r in citations.backfill_chain(papers, w, c).collect()}
    assert got == {1: ("10.1/a", "A title", "from s2"), 2: ("10.9/c", "A Lost Paper", "c"), 3: (None, "Other lost papers", ""), 4: ("10.4/d", "D", "lib"), 5: (None, "Kept as is", "has")}
    again = citations.backfill_chain(papers.where("id = 1"), w, c, "openalex")
    assert again.first()["abstract"] == "from openalex" and citations.asked_for_abstracts("semantic_scholar") == ["zotero", "crossref", "semantic_scholar"] and citations.asked_for_abstracts("crossref", False, False) == ["crossref"]


def test_expansion_through_the_engine(spark, tmp_path):
    e = Engine(spark, Store(spark, str(tmp_path / "p")))
    e.call("insert_paper", {"title": "Seed", "authors": "A", "year": 2000, "abstract": "x", "publication_title": "V", "doi": "10.1/a"})
    fetched = spark.createDataFrame([("10.1/A", 0, "10.2/b", "Found", "", 2001, ""), ("10.1/a", 1, None, "", "", None, "raw")], "parent_doi string, ref_index int, doi string, title string, authors string, year int, unstructured string")
    w = spark.createDataFrame([("10.2/B", "Found", "", 2001, "", "V", None, "openalex")], "doi string, title string, authors string, year int, abstract string, publication_title string, pdf_url string, source string")
    none = spark.createDataFrame([], "ref_id long, work_id long, work_title string, work_year int, rank int, source string, doi string, abstract string")
    n = e.snowball(fetched, w, none)
    assert n["references_harvested"] == 2 and n["new_papers"] == 1 and n["edges"] == 1 and n["resolved"] == 1 and n["unresolved_no_doi"] == 1
    run = e.t("snowball_runs").first()
    assert (run["direction"], run["seed_count"], run["new_papers"], run["references_harvested"]) == ("backward", 1, 1, 2) and e.t("paper_sources").count() == 1
    p = e.call("get_paper_provenance", {"paper_id": 2})[0]
    assert p["found"] and p["sources"] == ["snowball"] and p["parents"][0]["title"] == "Seed" and p["parents"][0]["depth"] == 1 and p["parents"][0]["discovered_at"]
    assert e.call("get_paper_provenance", {"paper_id": 99})[0]["found"] is False
    assert e.backfill(w.withColumn("abstract", F.lit("late")), none).first().asDict() == {"papers_total": 2, "papers_missing_abstract": 0, "papers_missing_title": 0, "resolved_missing_abstract": 0, "resolved_missing_title": 0}
    e.screen(lambda system, title, abstract: json.dumps({"decision": "hybrid"}), "m")
    assert e.judge(lambda *_: json.dumps({"score": 2, "verdict": "pass"}), "j").first()["count"] == 2 and e.judge(lambda *_: json.dumps({"score": 2, "verdict": "fail"}), "j").first()["verdict"] == "fail"


def test_sources_of_a_run():
    run, asked = works.Run(), []

    def request(source):
        asked.append(source)
        if source == "a":
            raise works.RateLimitError
        if source == "b":
            raise LookupError
        return f"from {source}"

    assert run.first("abc", request) == run.first("abc", request) == "from c" and asked == ["a", "b", "c", "b", "c"] and run.throttled == {"a"}
    assert works.secret(None, ["X", "Y"], {"Y": "k"}) == "k" and works.secret("v", ["X"], {}) == "v" and works.optional(lambda: works.secret(None, ["X"], {})) is None


def test_answers_are_kept_batch_by_batch(spark, tmp_path):
    calls = []

    def ask(batch):
        calls.append(len(batch))
        if len(calls) == 2:
            raise TimeoutError
        return {d: "{}" for d in batch}

    pace = works.Pace(interval=0, sleep=lambda s: None)
    path, dois = str(tmp_path / "w"), [f"10.1/{i:03d}" for i in range(120)]
    run = works.Run()
    assert works.fetch(spark, "crossref", dois, ask, pace, path, run).count() == 50 and run.throttled == {"crossref"}
    assert works.fetch(spark, "crossref", dois, ask, pace, path).count() == 120 and calls == [50, 50, 50, 20]


def test_works(spark):
    cross = {"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"name": "Org"}], "published": {"date-parts": [[2019, 5]]}, "link": [{"content-type": "text/html", "URL": "h"}, {"content-type": "application/pdf", "URL": "p"}], "URL": "u", "container-title": ["V"], "abstract": "<jats:p>x &lt; y</jats:p>"}
    opened = {"doi": "10.2", "title": "T", "authorships": [{"author": {"display_name": "A B"}}, {"author": {}}], "publication_year": 2018, "primary_location": {"source": {"display_name": "V"}}, "best_oa_location": None, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    rows = {k: works.normalise(spark.createDataFrame([(json.dumps(v),)], "payload string"), k).first() for k, v in (("crossref", cross), ("openalex", opened), ("semantic_scholar", {"externalIds": {"DOI": "d"}, "title": "T", "authors": [{"name": "N"}], "year": 2017}), ("zotero", {"title": "T", "creators": [{"given": "A ", "family": "B"}], "date": "May 2016"}), ("crossref_reference", {"article-title": "R", "year": "20x", "unstructured": " u "}))}
    assert rows["crossref"].asDict() == {"doi": "10.1/x", "title": "T", "authors": "A B; Org", "year": 2019, "unstructured": "", "publication_title": "V", "pdf_url": "p", "abstract": "x < y"}
    assert rows["openalex"]["abstract"] == "a b a" and rows["openalex"]["authors"] == "A B" and rows["semantic_scholar"]["doi"] == "d" and rows["zotero"]["year"] == 2016 and rows["zotero"]["authors"] == "A B" and rows["crossref_reference"]["year"] is None and rows["crossref_reference"]["unstructured"] == "u"
    src = works.WorkSource("crossref", spark.createDataFrame([("10.1/x", json.dumps(cross))], "key string, payload string"))
    assert src.by_dois(spark.createDataFrame([("10.1/x",), ("10.9",)], "doi string")).count() == 1 and src.references(spark.createDataFrame([("10.1/x",)], "doi string"), "forward").count() == 0


def test_tools_and_command_line_give_all_rows(spark, tmp_path, capsys):
    rows = Engine(spark, Store(spark, str(tmp_path))).call("execute_select", {"sql": "SELECT explode(sequence(1, 10001)) AS n ORDER BY n"})
    assert [r["n"] for r in rows] == list(range(1, 10002))
    show(spark.range(1001).orderBy("id"))
    assert [json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()] == list(range(1001))


def test_pace():
    slept = []
    p = works.Pace(interval=1, jitter=0, sleep=slept.append, clock=lambda: 100.0)
    p.wait("a"), p.wait("a")
    assert slept == [1.0] and p.pause(3) == 8 and p.pause(0, "7") == 7 and p.pause(0, "999") == 60
    answers = iter([(503, {}, None), (200, {}, "ok")])
    assert works.call(lambda: next(answers), p, "a") == "ok" and p.failures == 0
    with pytest.raises(LookupError):
        works.call(lambda: (404, {}, None), p, "a")
    with pytest.raises(works.RateLimitError):
        works.call(lambda: (429, {"Retry-After": "1"}, None), p, "a")
    assert works.retry_after("Wed, 21 Oct 2015 07:28:10 GMT", 1445412480) == 10 and works.retry_after("x") is None and works.retry_after("-1") is None


def test_guard_reads_quotes_whole():
    assert select_only("select '-- no comment; drop' as x -- but this") == "select '-- no comment; drop' as x"
    assert select_only("select `delete`, \"a;b\" from t ; -- end") == "select `delete`, \"a;b\" from t"


@pytest.mark.parametrize("sql", ["SELECT 1", "with a as (select 1) select * from a;", "select 'drop; update' as x", "select \"delete\" from t -- drop", "/* x */ select 1"])
def test_guard_allows(sql):
    assert select_only(sql)


@pytest.mark.parametrize("sql", ["", " ; ", "-- only", "drop table x", "select 1; select 2", "insert into t values (1)", "with a as (select 1) delete from a", "pragma x", "attach 'x' as y", "select replace(a, 'b', 'c') from t", "explain select 1", "update t set a = 1"])
def test_guard_rejects(sql):
    with pytest.raises(ValueError):
        select_only(sql)


def test_prepared():
    assert len(prepared()) == 15 and list(prepared(5)) == ["Snowball Edges Count"] and "Corpus by Year" in prepared("year")
    with pytest.raises(ValueError):
        prepared("nothing such")


def test_engine(spark, tmp_path):
    e = Engine(spark, Store(spark, str(tmp_path / "p")))
    first = e.call("insert_paper", {"title": "Probing a PUF", "authors": "A B", "year": 2020, "abstract": "Laser fault injection on an arbiter PUF circuit", "publication_title": "V", "doi": "10.1/a", "source_names": ["ACM", "ACM"]})
    assert first[0]["id"] == 1 and e.call("insert_paper", {"title": "Other", "authors": "C", "year": 2021, "abstract": "", "publication_title": "V", "doi": "10.1/a", "source_names": ["IEEE"]})[0]["title"] == "Probing a PUF"
    assert e.call("get_paper_provenance", {"paper_id": 1})[0]["sources"] == ["ACM", "IEEE"] and e.call("search_papers", {"text": "probing"})[0]["id"] == 1 and e.call("get_paper_by_doi", {"doi": " 10.1/a "})[0]["id"] == 1
    assert e.call("execute_select", {"sql": "SELECT count(*) AS n FROM paper_sources"}) == [{"n": 2}]
    for sql in prepared().values():
        e.execute_select(sql).collect()
    assert e.call("store_analysis", {"name": "x", "result_json": "{}"})[0]["id"] == 1 and e.call("store_analysis", {"name": "x", "result_json": "[]"})[0]["id"] == 1
    assert len(e.call("get_prewritten_sql_statements")) == 15 and len(e.call("list_papers", {"limit": 5})) == 1
    for bad in (("nope", {}), ("get_paper", {}), ("get_paper", {"paper_id": True}), ("list_papers", {"offset": -1}), ("execute_select", {"sql": "drop table papers"}), ("get_paper", {"paper_id": 1, "x": 2})):
        with pytest.raises(ValueError):
            e.call(*bad)
    assert schema("get_paper")["inputSchema"]["required"] == ["paper_id"] and len(TOOLS) == 10
    e.evaluate()
    assert e.t("papers").first()["relevance_class"] == "in-scope" and e.t("evals").count() == 1 and e.t("relevance_evals").count() == 1
    e.label(spark.createDataFrame([(1, "a", "in-scope", None, ""), (1, "b", "in-scope", 0.5, "")], "paper_id long, annotator_id string, label string, confidence double, rationale string"))
    assert e.t("ground_truth_consensus").first()["consensus_label"] == "in-scope" and json.loads(e.analyse("all"))["runs"][0]["accuracy"] == 1.0
    with pytest.raises(ValueError):
        e.store.commit({"paper_sources": spark.createDataFrame([(77, 1)], "paper_id long, source_id long")})
    assert e.t("paper_sources").count() == 2


def test_evals_are_upserted(spark, tmp_path):
    one = {"paper_id": 1, "method": "m", "decision": "hybrid", "score": 0.5}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(one) + "\n\n" + json.dumps({**one, "paper_id": 2}) + "\n")
    store = Store(spark, str(tmp_path / "s"))
    stream.start(stream.read(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({**one, "decision": "in-scope"}) + "\n")
    stream.start(stream.read(spark, str(tmp_path / "in")), store, str(tmp_path / "c")).awaitTermination()
    assert {r["paper_id"]: r["decision"] for r in store.read("evals").collect()} == {1: "in-scope", 2: "hybrid"} and store.read("eval_runs").count() == 1
    with pytest.raises(ValueError):
        upserts.ingest_evals(store.read("eval_runs"), store.read("evals"), tables.read_evals(spark, str(tmp_path / "in")).withColumns({"seq": F.lit(0), "decision": F.lit("odd")}))


def test_first_layout_and_migrations(spark):
    papers = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "id long, title string, query_id long")
    queries = spark.createDataFrame([(1, "ACM Digital Library", "q"), (2, "my place", "r")], "id long, platform string, query_text string")
    t = from_first_layout(papers, queries)
    assert t["paper_queries"].count() == 2 and t["paper_sources"].count() == 2 and {"ACM", "My Place", "snowball"} <= {r["name"] for r in t["sources"].collect()}
    with pytest.raises(ValueError):
        from_first_layout(papers.drop("query_id"), queries)
    out, done = migrate({"papers": papers.drop("query_id")}, spark)
    assert done == [1, 2, 3, 4, 5, 6] and {"notes", "pdf_url", "relevance_class"} <= set(out["papers"].columns) and migrate(out, spark, set(done))[1] == []


def test_screening(spark):
    papers = spark.createDataFrame([(1, "T &amp; U", "We probe it."), (2, "V", None)], "id long, title string, abstract string")
    yes = lambda system, title, abstract: json.dumps({"decision": "in-scope", "excerpt": "we probe", "title": title})
    got = {r["paper_id"]: r for r in screening.screen_two(papers, yes, 4).collect()}
    assert got[1]["excerpt_verified"] and not got[2]["excerpt_verified"] and got[1]["run_id"] == 4
    three = screening.screen_three(papers, yes, "m", run=2).collect()
    assert {r["decision"] for r in three} == {"in-scope"} and {r["eval_id"] for r in three} == {"eval-2-1", "eval-2-2"}
    assert {r["decision"] for r in screening.screen_two(papers, None, 1, dry_run=True).collect()} == {"EXCLUDE"}
    with pytest.raises(Exception, match="no usable answer"):
        screening.screen_three(papers, lambda *_: "{}", "m").collect()
    with pytest.raises(ValueError):
        screening.prompt("P9")
    assert screening.prompt("p1")
    have = spark.createDataFrame([(1, "m", [1.0])], "paper_id long, model_name string, embedding array<float>")
    new = screening.embed(papers, have, lambda texts: [[float(len(t))] for t in texts], "m").collect()
    assert [(r["paper_id"], r["embedding"]) for r in new] == [(2, [3.0])]


def test_upserts(spark):
    old = spark.createDataFrame([(5, "a", 1), (6, "b", 2)], "id long, k string, v int")
    new = spark.createDataFrame([("b", 7, 0), ("b", 8, 1), ("c", 9, 2)], "k string, v int, seq int")
    assert sorted(map(tuple, upserts.upsert(old, new, ["k"], "seq").collect())) == [(5, "a", 1), (6, "b", 8), (7, "c", 9)]
    papers = spark.createDataFrame([(1, "old", "", 1990, "", "", "10.1", None)], "id long, title string, authors string, year int, abstract string, publication_title string, doi string, keywords string")
    rows = spark.createDataFrame([(1, "x", "", 2000, "", "", "10.1", None, None), (2, "y", "", 2001, "", "", "10.1", None, None), (3, "z", "", 2002, "", "", None, None, None), (4, "z", "", 2002, "", "", None, None, None), (5, "bad", "", None, "", "", None, None, "Missing year")], "seq long, title string, authors string, year int, abstract string, publication_title string, doi string, keywords string, error string")
    assert sorted((r["id"], r["title"]) for r in upserts.upsert_papers(papers, rows).collect()) == [(1, "y"), (2, "z"), (3, "z")]


def asked_for(keys):
    """A client of tests: refuses more than a batch, knows every key but those with an x."""
    assert len(keys) <= 50
    return {k: json.dumps({"k": k}) for k in keys if "x" not in k}


def test_payloads_as_a_data_source(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [(f"10.1/{i % 200}", json.dumps({"n": i}), "backward", i) for i in range(500)] + [(None, "{}", "backward", 0)]
    payloads.keep(spark.createDataFrame(rows, "key string, payload string, direction string, ref_index int"), path, 16)
    every = payloads.read(spark, path)
    assert every.rdd.getNumPartitions() == 16 and sorted(r["ref_index"] for r in every.collect()) == list(range(500))
    some = payloads.read(spark, path, ["10.1/3", "10.1/7", "10.1/none", "it's"])
    assert some.rdd.getNumPartitions() <= 4  # a bucket for each key at most
    assert sorted(r["ref_index"] for r in some.collect()) == [3, 7, 203, 207, 403, 407]
    assert payloads.read(spark, path, ["10.1/3"]).where("ref_index > 100").count() == 2
    assert payloads.read(spark, path, []).count() == 0
    reader = payloads.PayloadReader({"path": path})
    kept = list(reader.pushFilters([payloads.In(("key",), ("10.1/3", "10.1/4")), payloads.EqualTo(("key",), "10.1/4"), payloads.EqualTo(("ref_index",), 4)]))
    assert reader.keys == {"10.1/4"} and [f.attribute for f in kept] == [("ref_index",)] and len(reader.partitions()) == 1
    with pytest.raises(Exception):
        payloads.PayloadReader({})
    with pytest.raises(ValueError):
        payloads.PayloadReader({"client": "m:f"}).partitions()
    live = payloads.PayloadReader({"client": "tests.test_tables_and_citations:asked_for", "kind": "crossref", "tasks": "2"})
    live.keys = {f"{i}" for i in range(120)} | {"x1", None}
    parts = live.partitions()
    assert [len(p.batches) for p in parts] == [2, 1] and sum(len(b) for p in parts for b in p.batches) == 121


def test_sources_are_asked_for_what_is_left(spark):
    asked, seen = spark.createDataFrame([(f" https://doi.org/10.1/{i}",) for i in range(120)] + [(None,), ("10.1/3",), ("",)], "doi string"), {}

    def source(name, has):
        def ask(dois):
            seen[name] = sorted(r["doi"] for r in dois.collect())
            return dois.where(F.substring_index("doi", "/", -1).cast("int") % has == 0).select(F.concat(F.lit("DOI:"), F.upper("doi")).alias("doi"), F.lit(name).alias("abstract"), F.lit("x").alias("k")).union(spark.createDataFrame([("10.9/unasked", name, "x")], "doi string, abstract string, k string"))

        return ask

    names = {"a": 2, "b": 3, "c": 1, "d": 1}
    got, calls = citations.ask_in_turn(asked, {n: source(n, m) for n, m in names.items()}, ["a", "x", "b", "d", "c"], {"a": 50, "b": 7}, throttled=["d"])
    who = {r["k"]: r["source"] for r in got.collect()}
    assert who == {f"10.1/{i}": "a" if i % 2 == 0 else "b" if i % 3 == 0 else "c" for i in range(120)} and got.columns == ["k", "source", "doi", "abstract"]
    assert [tuple(r) for r in calls.orderBy("turn").collect()] == [(0, "a", 120, 3, 60), (1, "b", 60, 9, 20), (2, "c", 40, 1, 40)]
    assert len(seen["a"]) == 120 and len(seen["b"]) == 60 and "d" not in seen and not set(seen["c"]) & {k for k, s in who.items() if s != "c"}
    none, log = citations.ask_in_turn(asked.limit(0), {"a": source("a", 1)}, ["a"], {})
    assert none.count() == 0 and log.first()["asked"] == 0


@pytest.mark.parametrize("size", [400, 2000, 1 << 20])
def test_bibtex_split_anywhere(spark, tmp_path, size):
    """Files that are read in splits give the entries of each whole text."""
    rng = random.Random(size)
    odd = ["% a note", "", "@comment no entry", "}", "@Article{late,", "  title = {never closed", "text { between", "@string{x = 1}"]

    def entry(k):
        deep = "{" * rng.choice([0, 0, 0, 1, 2, 6])
        lines = [f"@{rng.choice(['Article', 'book'])}{{k{k}, year = 1999", f"  title = {{T {deep}of é{'}' * len(deep)} {k}}},", '  author = "Roe, A and {Poe}, B",', f"  note = {{see @misc{{x{k}, or", f"  more {rng.choice(['{', ''])} of it}},", "  year = {2001}", rng.choice(["}", "  }", "}}", "} % end"])]
        return lines

    texts = {}
    for name in ("a", "b", "c"):
        lines = []
        for k in range(12):
            lines += entry(k) + rng.choices(odd, k=rng.randint(0, 2))
        texts[name] = rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.bib").write_bytes(texts[name].encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = bibtex.read(spark, f"{tmp_path}/*.bib").collect()
        splits = spark.read.text(f"{tmp_path}/*.bib").select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits == 3 if size == 1 << 20 else splits > 3
    for name, text in texts.items():
        rows = sorted((r for r in got if r["path"].endswith(f"{name}.bib")), key=lambda r: r["seq_in_file"])
        assert [(r["entry_type"], r["cite_key"], r["fields"]) for r in rows] == [(e["entry_type"], e["cite_key"], e["fields"]) for e in bibtex.parse(text)]
        assert len({r["seq_in_file"] for r in rows}) == len(rows)
