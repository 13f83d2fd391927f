"""Exact merges of a word-end vocabulary by backtracking, and decoding by an offset table.

A word is a string over 512 symbols: its bytes, the last one with the word's end. Tokens are strings of such symbols.
An automaton over all tokens finds the longest token at each place. Merges apply in the order of their ranks, and a
merge only joins tokens that earlier merges made; so a token sequence is what the merges give if and only if each two
neighbours are compatible, that is, merging their joined symbols gives the two again. The encoder goes from left to
right, takes the longest token compatible with the one before, then shorter ones, and steps back where none is left.
A place once left is never tried again, since what leads to it is unique: time is linear in the length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import slices

def runs(kind: str, last: int) -> str:
    """Characters of a general category up to ``last``, as ranges of a character class."""
    out, first = [], None
    for c in range(last + 2):
        is_in = c <= last and unicodedata.category(chr(c))[0] == kind
        if is_in and first is None:
            first = c
        elif not is_in and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


@cache
def word(last: int = sys.maxunicode) -> re.Pattern:
    """Splits a text that is in its composed lower-case form and has characters up to ``last``; white space stays
    outside. Unicode's white space is written out, since Python's class has four characters more. Classes of the first
    plane are looked up, those of higher ones are searched, so texts without the latter have a pattern of their own."""
    letters, numbers = runs("L", last), runs("N", last)
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{white}{letters}{numbers}]+")


#: The same for ASCII texts.
ASCII_WORD = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+")
#: What the file must say about texts: this module does these steps and no others.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "</w>")


@dataclass(frozen=True)
class Options:
    """``block``: characters of texts that are encoded at once; ``known``: ids kept of words met before, in each worker."""

    model: str = field(default_factory=lambda: public_tokenizers.path("word_bpe_49k.json"))
    block: int = 1 << 20
    known: int = 1 << 20


# --- vocabulary ---------------------------------------------------------------------------------------------------


def shown_bytes() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for one: printable ones as they are, the others in
    turn from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load(path: str) -> dict:
    """Plain tables of a vocabulary file, bounded by the vocabulary: tokens over 512 symbols, merges, special tokens,
    and each id's bytes for decoding."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    steps = ([n["type"] for n in found["normalizer"]["normalizers"]], [p["type"] for p in found["pre_tokenizer"]["pretokenizers"]], found["model"]["end_of_word_suffix"])
    if steps != STEPS or found["decoder"] is not None:
        raise ValueError(f"{path} asks for other steps: {steps}")
    byte, end, vocabulary = shown_bytes(), STEPS[2], found["model"]["vocab"]

    def symbols(token: str) -> str:
        bare = token.removesuffix(end)
        s = "".join(chr(byte[c]) for c in bare)
        return s if bare == token else s[:-1] + chr(256 + ord(s[-1]))

    rank_of: dict[int, int] = {}
    merges = []
    for rank, pair in enumerate(found["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        made = vocabulary[a + b]
        rank_of.setdefault(made, rank)
        merges.append((vocabulary[a], vocabulary[b], made))
    specials = {t["content"]: t["id"] for t in found["added_tokens"]}
    text_of = {i: t for t, i in (vocabulary | specials).items()}
    return {
        "path": path, "tokens": {i: symbols(t) for t, i in vocabulary.items()}, "merges": merges, "specials": specials,
        "bytes_of": [text_of.get(i, "").encode() for i in range(max(text_of) + 1)],
    }


class Pairs:
    """Which tokens stay apart when they stand side by side.

    A token's last symbols while it is being merged are its right spine: the token, its right part, and so on down to
    a symbol; each is there from its own merge up to that of the one above. The next token's first symbols are its left
    spine. The two tokens stay apart if no merge of a symbol of one with a symbol of the other comes while both are
    there. Of equal ranks the left place goes first.
    """

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b, made) in enumerate(merges):
            self.rank.setdefault((a, b), rank)
            if made not in self.parts:
                self.parts[made], self.born[made] = (a, b), rank
        self.apart = Apart(self)
        self.spines: tuple[dict, dict] = {}, {}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(part, rank of the merge that takes it up), from the symbol up to the token. Kept, one for each token."""
        kept = self.spines[side].get(token)
        if kept is None:
            out, part, up = [], token, float("inf")
            while True:
                out.append((part, up))
                if part not in self.parts:
                    break
                up, part = self.born[part], self.parts[part][side]
            kept = self.spines[side][token] = out[::-1]
        return kept

    def crossing(self, a: int, b: int) -> int | None:
        """Rank of the first merge across the border of the two tokens."""
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, x_up), (y, y_up) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_up and rank <= y_up:
                return rank
            if x_up == y_up == float("inf"):
                return None
            if x_up <= y_up:
                i += 1
            else:
                j += 1


class Apart(dict):
    """Whether two tokens stay apart, by (left << 32 | right); what is not there yet is found and kept."""

    def __init__(self, pairs: Pairs):
        self.pairs = pairs

    def __missing__(self, key: int) -> bool:
        if len(self) >= 1 << 20:  # what is dropped is found again
            self.clear()
        got = self[key] = self.pairs.crossing(key >> 32, key & 0xFFFFFFFF) is None
        return got


class Numbers(dict):
    """Number of each word, given in turn; a new word is encoded."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        e = self.encoder
        e.flat += [e.specials[word]] if word in e.specials else e.word(word)
        e.ends.append(len(e.flat))
        got = self[word] = len(self)
        return got


class Encoder:
    def __init__(self, tables: dict):
        self.pairs = Pairs(tables["merges"])
        self.length = np.zeros(len(tables["bytes_of"]), np.int64)
        whole = set()  # tokens that the merges make out of their own symbols
        self.automaton = ahocorasick.Automaton()
        for i in sorted(tables["tokens"], key=lambda t: self.pairs.born.get(t, -1)):
            s, parts = tables["tokens"][i], self.pairs.parts.get(i)
            if parts is None and len(s) == 1 or parts and whole.issuperset(parts) and self.pairs.crossing(*parts) == self.pairs.born[i]:
                whole.add(i)
                self.length[i] = len(s)
                self.automaton.add_word(s, i)
        #: Next shorter token with which a token begins.
        self.shorter = {i: self.start_of(tables["tokens"][i]) for i in whole}
        self.automaton.make_automaton()
        self.long = self.length.tolist()
        self.specials = tables["specials"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.reset()

    def start_of(self, s: str) -> int:
        for k in range(len(s) - 1, 0, -1):
            if s[:k] in self.automaton:
                return self.automaton.get(s[:k])
        return -1

    def reset(self) -> None:
        self.number = Numbers(self)
        self.flat: list[int] = []
        self.ends: list[int] = [0]

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode().decode("latin-1")
        s = raw[:-1] + chr(256 + ord(raw[-1]))
        one = self.automaton.get(s, -1)
        if one >= 0:
            return [one]
        n, long, apart, shorter, find = len(s), self.long, self.pairs.apart, self.shorter, self.automaton.iter_long
        left: set[int] = set()
        out: list[int] = []
        at, before = 0, -1
        ahead = find(s)  # longest tokens from a place on, each where the one before ends
        last, token = next(ahead)
        due = last + 1
        while True:
            while token >= 0 and (before >= 0 and not apart[before << 32 | token] or at + long[token] in left):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += long[token]
                if at == n:
                    return out
                before = token
                if at != due:
                    ahead = find(s, at)
                last, token = next(ahead)
                due = last + 1
            else:
                left.add(at)
                token = out.pop()
                before = out[-1] if out else -1
                at -= long[token]
                due = -1
                token = shorter[token]

    def words_of(self, text: str) -> list[str]:
        out: list[str] = []
        for part in self.cut.split(text) if self.cut and "<" in text else (text,):
            if part in self.specials:
                out.append(part)
            elif part.isascii():
                out += ASCII_WORD.findall(part.lower())
            else:  # a capital sigma is lowered alike everywhere
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                plane = 0xFFFF if len(part.encode("utf-16-le", "surrogatepass")) == 2 * len(part) else sys.maxunicode
                out += word(plane).findall(part)
        return out

    def encode(self, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in turn, and ids for each text."""
        if len(self.flat) > limit:
            self.reset()
        per, used = [], []
        for t in texts:
            found = self.words_of(t) if t else []
            per.append(len(found))
            used += map(self.number.__getitem__, found)
        at, ends, flat = np.array(used, np.int64), np.array(self.ends, np.int64), np.array(self.flat, np.int32)
        n = ends[at + 1] - ends[at]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(ends[at] - total[:-1], n) + np.arange(total[-1])]
        edge = total[np.concatenate(([0], np.cumsum(np.array(per, np.int64))))]
        return ids, np.diff(edge)


class Offsets:
    """Tokens' bytes one after the other, each with the space that joins it to the next, and where each begins."""

    def __init__(self, bytes_of: list[bytes]):
        n = np.array([len(b) + 1 for b in bytes_of], np.int64)
        self.begin, self.size = np.cumsum(n) - n, n
        self.flat = np.frombuffer(b" ".join(bytes_of) + b" ", np.uint8)

    def texts(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        n = self.size[ids]
        end = np.cumsum(n)
        raw = self.flat[np.repeat(self.begin[ids] - (end - n), n) + np.arange(int(n.sum()))].tobytes()
        edge = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(count)))].tolist()
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1], edge[1:])]


_made: dict[str, tuple[Encoder, Offsets]] = {}


def made(tables: dict) -> tuple[Encoder, Offsets]:
    """Encoder and decoder of a worker, made once for a vocabulary."""
    if tables["path"] not in _made:
        _made.clear()
        _made[tables["path"]] = Encoder(tables), Offsets(tables["bytes_of"])
    return _made[tables["path"]]


# --- DataFrames ---------------------------------------------------------------------------------------------------


def encode(docs: DataFrame, o: Options = Options(), text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ids (array of int) and n_tokens.

    Strings of the file's special tokens in a text become their ids, as the library's encoder does. Null and empty texts
    and texts of white space have no ids. Whole texts are encoded, however long, one at a time where they are larger
    than a block. Equal texts get equal ids, so there are no ties and repeated rows stay. Input columns named like an
    output are replaced; an empty table gives an empty one. One pass, no shuffle; the broadcast is the vocabulary.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load(o.model))
    low = {"ids", "n_tokens"}
    keep = [c for c in docs.columns if c != text_col and c.lower() not in low]
    rest = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = made(tables.value)
        for b in batches:
            texts = b.column(len(keep))
            for x, y in slices(np.array(pa.compute.binary_length(texts.fill_null("")), np.int64), o.block):
                ids, count = encoder.encode([t or "" for t in texts.slice(x, y - x).to_pylist()], o.known)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[c.slice(x, y - x) for c in b.columns[: len(keep)]], lists, pa.array(count)], [*keep, "ids", "n_tokens"])

    fields = "".join(f"`{c}` {rest.schema[c].dataType.simpleString()}, " for c in keep)
    return rest.mapInArrow(run, f"{fields}ids array<int>, n_tokens long")


def decode(tokens: DataFrame, o: Options = Options(), ids_col: str = "ids") -> DataFrame:
    """``tokens`` plus text: the tokens as the vocabulary writes them, one space between two, since the file names no
    decoder. Null ids give null, no ids an empty text; an input column ``text`` is replaced."""
    tables = tokens.sparkSession.sparkContext.broadcast(load(o.model))
    tokens = tokens.drop("text")
    names = tokens.columns
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, offsets = made(tables.value)
        for b in batches:
            lists = b.column(place)
            count = np.array(pa.compute.list_value_length(lists).fill_null(0), np.int64)
            for x, y in slices(count * 8, o.block):
                part = lists.slice(x, y - x)
                ids = np.asarray(part.flatten().cast(pa.int32()), np.int64)
                texts = pa.array(offsets.texts(ids, count[x:y]), pa.binary()).cast(pa.string())
                texts = pa.compute.if_else(part.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*[c.slice(x, y - x) for c in b.columns], texts], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, text string")


def ids_text(ids: str = "ids") -> Column:
    """Decimal ids with one space between two."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def query(spark, sf_dir: str) -> DataFrame:
    tokens = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return decode(tokens).select("doc_id", "n_tokens", F.sha2(ids_text(), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
