"""BibTeX files as rows of entries."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.operators.upserts import entries_to_papers
from screenlake.stages import Stages, numbered

ENTRY = "seq_in_file long, entry_type string, cite_key string, fields map<string,string>"
_HEAD = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
#: Characters that mean something in the body of an entry, and a field's name.
_MARK = re.compile(r'[{}",]')
_NAME = re.compile(r"\s*(\w+)\s*=\s*(.*)", re.S)


def pairs(text: str) -> dict[int, int]:
    """Where each brace that opens is closed, as far as it is."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def value_of(raw: str) -> str | None:
    """What a field says: without its mark (braces or quotes), without braces around the whole, spaces squeezed. None
    where several values stand without a mark. A comma that an unclosed brace has kept from ending the field goes."""
    raw = raw.removesuffix(",").rstrip()
    first, last = raw[:1], raw[-1:]
    if len(raw) > 1 and (first, last) in (("{", "}"), ('"', '"')):
        raw = raw[1:-1]
    elif not raw or "," in raw[1:]:
        return None
    raw = raw.strip()
    closed = pairs(raw)
    a, z = 0, len(raw)
    while z - a > 1 and raw[a] == "{" and closed.get(a) == z - 1:
        a, z = a + 1, z - 1
        while a < z and raw[a].isspace():
            a += 1
        while z > a and raw[z - 1].isspace():
            z -= 1
    return " ".join(raw[a:z].split())


def fields_of(body: str) -> dict[str, str]:
    """name -> value of ``name = {..}``, ``name = ".."`` and ``name = bare`` between the commas that stand in neither
    braces nor quotes. One pass over the marks; pieces that are no field are left out."""
    out, depth, quoted, start = {}, 0, False, 0
    ends = [(m.start(), m[0]) for m in _MARK.finditer(body)] + [(len(body), "end")]
    for at, mark in ends:
        if mark == '"' and not depth:
            quoted = not quoted
        elif mark in "{}" and not quoted:
            depth += 1 if mark == "{" else -1
        elif mark == "end" or mark == "," and not quoted and not depth:
            named = _NAME.fullmatch(body[start:at].strip())
            value = value_of(named[2].strip()) if named else None
            if value is not None:
                out[named[1].lower()] = value
            start = at + 1
    return out


def parse(text: str) -> list[dict]:
    """Entries in order. Fields on the line that opens an entry or on the one that closes it are not read."""
    out: list[dict] = []
    depth, body = 0, []
    for line in text.splitlines():
        if not depth:
            if head := _HEAD.match(line.strip()):
                out.append({"entry_type": head[1].lower(), "cite_key": head[2], "fields": {}})
                depth, body = 1, []
            continue
        depth = max(depth + line.count("{") - line.count("}"), 0)
        if depth:
            body.append(line)
        else:
            out[-1]["fields"] = fields_of(" ".join(body))
    if depth and out:
        out[-1]["fields"] = fields_of(" ".join(body))
    return out


def entries(files: DataFrame) -> DataFrame:
    """(path, seq_in_file, entry_type, cite_key, fields) of texts (path, value); one text is parsed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, e["entry_type"], e["cite_key"], e["fields"]) for p, v in zip(b["path"], b["value"]) for n, e in enumerate(parse(v or ""))]
            yield pd.DataFrame(rows, columns=["path", "seq_in_file", "entry_type", "cite_key", "fields"])

    return files.select("path", "value").mapInPandas(run, f"path string, {ENTRY}")


# --- files in splits ------------------------------------------------------------------------------------------------

#: Depths at the start of a split for which its end is found in the first pass; a deeper one is followed on its own.
DEEP = 4


def after(depth: int, line: str) -> int:
    """The depth of braces behind a line, as ``parse`` counts it: 0 between entries."""
    if not depth:
        return int(bool(_HEAD.match(line.strip())))
    return max(depth + line.count("{") - line.count("}"), 0)


def ends(lines: Iterator[str], starts: list[int]) -> list[tuple[int, bool]]:
    """For each depth before the lines the depth behind them, and whether it was 0 in between, so that an entry that is
    open then began here. Depths that have become equal are followed as one."""
    now = {(d, not d): [d] for d in starts}  # depth and whether it was 0 -> the starts that lead there
    for line in lines:
        if "{" in line or "}" in line or "@" in line:
            then: dict[tuple[int, bool], list[int]] = {}
            for (depth, zero), of in now.items():
                behind = after(depth, line)
                then.setdefault((behind, zero or not behind), []).extend(of)
            now = then
    found = {d: end for end, of in now.items() for d in of}
    return [found[d] for d in starts]


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """(path, start of the split) and the lines of each split; a task reads a split's rows in order, as a run of its own."""
    rows = ((key, line) for b in batches for key, value in zip(zip(b["path"], b["block"]), b["value"]) for line in (value.splitlines() or [""]))
    for key, run in itertools.groupby(rows, lambda r: r[0]):
        yield key, (line for _, line in run)


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The entries of all files: path, seq_in_file (a number that rises with the place in the file), entry_type,
    cite_key, fields. Equal to ``parse`` of each whole file, however large it is and wherever it is split.

    A first pass finds for each split what depth of braces it ends at for each depth it may begin with; from these the
    driver, which gets a few numbers for each split, tells every split its beginning. In a second pass each split gives
    its entries, and the pieces of an entry that splits have cut meet by the split in which it begins.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def scan(batches: Iterator[pd.DataFrame], starts: tuple[int, ...] = tuple(range(DEEP + 1))) -> Iterator[pd.DataFrame]:
        for (path, block), own in _splits(batches):
            found = ends(own, list(starts))
            yield pd.DataFrame([(path, block, [d for d, _ in found], [z for _, z in found])], columns=["path", "block", "ends", "zero"])

    kind = "path string, block long, ends array<int>, zero array<boolean>"
    begins: dict[tuple[str, int], tuple[int, int]] = {}  # split -> depth at its beginning, split in which that entry begins
    of, depth, owner = None, 0, 0
    for r in lines.mapInPandas(scan, kind).orderBy("path", "block").toLocalIterator():
        if r["path"] != of:
            of, depth = r["path"], 0
        if depth:
            begins[r["path"], r["block"]] = depth, owner
        place = depth
        if depth > DEEP:
            one = lines.where((F.col("path") == r["path"]) & (F.col("block") == r["block"]))
            r, place = one.mapInPandas(lambda batches, d=depth: scan(batches, (d,)), kind).first(), 0
        depth = r["ends"][place]
        if depth and r["zero"][place]:
            owner = r["block"]
    known = spark.sparkContext.broadcast(begins)  # one row for each split that begins inside an entry

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (path, block), own in _splits(batches):
            depth, owner = known.value.get((path, block), (0, block))
            rows, n, body, head = [], -1, [], (None, None)
            for line in own:
                before, depth = depth, after(depth, line)
                if not before and depth:
                    n, owner, body, head = n + 1, block, [], _HEAD.match(line.strip()).groups()
                elif before and depth:
                    body.append(line)
                elif before:
                    rows.append((path, owner, block, n, head[0], head[1], " ".join(body), owner != block))
                    body = []
            if depth:
                rows.append((path, owner, block, n, head[0], head[1], " ".join(body), True))
            yield pd.DataFrame(rows, columns=["path", "owner", "block", "n", "entry_type", "cite_key", "body", "cut"])

    st = Stages(spark, "bibtex")
    pieces = st.save("pieces", lines.mapInPandas(cut, "path string, owner long, block long, n long, entry_type string, cite_key string, body string, cut boolean"))
    parts = F.sort_array(F.collect_list(F.struct("block", "body")))  # as long as an entry
    joined = pieces.where("cut").groupBy("path", "owner").agg(F.max("n").alias("n"), F.max("entry_type").alias("entry_type"), F.max("cite_key").alias("cite_key"), F.array_join(F.transform(parts, lambda x: x["body"]), " ").alias("body"))
    whole = pieces.where("not cut").select("path", "owner", "n", "entry_type", "cite_key", "body").unionByName(joined)

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, o + n, t.lower(), k, fields_of(body)) for p, o, n, t, k, body in b[["path", "owner", "n", "entry_type", "cite_key", "body"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "seq_in_file", "entry_type", "cite_key", "fields"])

    return st.finish(whole.mapInPandas(fields, f"path string, {ENTRY}"))


def read_query_folders(spark: SparkSession, root: str) -> DataFrame:
    """Entries of ``root``/query*/*.bib with query (folder), platform (ACM or IEEE by the file's name; others are left
    out) and seq, a number in the order of folder, file and place."""
    e = read(spark, f"{root}/[qQ][uU][eE][rR][yY]*/*.bib")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    e = e.withColumns({"query": F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), "platform": F.when(name.contains("acm"), "ACM").when(name.contains("ieee"), "IEEE")})
    return numbered(e.where("platform is not null"), ["query", "path", "seq_in_file"], "seq")


def papers(found: DataFrame) -> DataFrame:
    """Paper rows of entries, those with a bad or missing year with an ``error``."""
    return entries_to_papers(found if "seq" in found.columns else numbered(found, ["path", "seq_in_file"], "seq"))
