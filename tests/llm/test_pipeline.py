import re
from collections import Counter, defaultdict

import corpus_pipeline
from screenlake.llm import quality, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = docs
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, SF).cache()
        assert made.columns == docs.columns
        counts[name] = {r["doc_id"]: r["text"] for r in made.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    forest, model = quality.train(docs, labels), toxicity.train(docs, labels)
    assert set(counts["quality"]) == {r["doc_id"] for r in quality.judge(docs, forest).where("kept").collect()}
    assert set(counts["toxicity"]) == set(counts["quality"]) - {r["doc_id"] for r in toxicity.judge(docs, model).where("toxic").collect()}
    # near copies: pairwise
    left = {i: shingles(t) for i, t in counts["toxicity"].items()}
    root = {i: i for i in left}
    pairs = [(i, j) for i in left for j in left if i < j and left[i] and 100 * len(left[i] & left[j]) >= 75 * len(left[i] | left[j])]
    for _ in pairs:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    assert set(counts["near_duplicates"]) == {i for i in left if root[i] == i}
    # passages: every string of 200 bytes
    raw = {i: (t or "").encode() for i, t in counts["near_duplicates"].items()}
    seen = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        hit = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        assert counts["passages"][i] == bytes(x for x, h in zip(b, hit) if not h).decode("utf-8", "ignore")
    # packing: whole, without overlap, inside the bins
    bins, total = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        total[r["doc_id"]] += r["length"]
        if r["bin"] is not None:
            bins[r["bin"]].append((r["place"], r["length"], r["bin_length"]))
    words = {i: len(WORD.findall(t or "")) for i, t in counts["passages"].items()}
    assert dict(total) == {i: n + (n > 0) for i, n in words.items()}
    for part in bins.values():
        at = 0
        for place, length, size in sorted(part):
            assert place == at and place + length <= size
            at += length


def test_nothing_in_nothing_out(spark):
    made = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, SF)
        assert made.count() == 0


def test_columns_named_like_outputs_stay(spark, docs):
    from pyspark.sql import functions as F

    d = docs.withColumns({"toxic": F.lit("own"), "removed": F.lit("own"), "n_chars": F.length("text")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        assert {r["kept"] for r in out.select("kept").distinct().collect()} <= {"x"} and {r["removed"] for r in out.select("removed").distinct().collect()} <= {"own"}
