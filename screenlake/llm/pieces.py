"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text becomes a lattice of all the vocabulary's pieces that fit. The forward pass sums the weights of all paths to
each place; the backward pass draws the last piece, the one before it and so on from their exact posterior. Draws
come from a hash of the seed, the row key and the place, so a row gets the same segmentation wherever it is
computed. No piece of this kind crosses the begin of a word, so a text's lattice is a chain of words' lattices: the
forward pass runs once for each different word of a block of text, the backward pass for every word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.shared import mix, slices

MARK, LITERAL = "▁", "\udc00"  # a lone surrogate stands for a mark that the text itself holds: no text can hold it
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Options:
    """``power``: exponent on the pieces' weights; large values tend to the single best segmentation, 0 makes all
    segmentations alike. ``block``: characters handled at a time."""

    model: str = MODEL
    seed: int = 1
    power: float = 1.0
    block: int = 1 << 21


class Vocabulary:
    """Pieces, their log weights, and a trie over characters.

    A merge vocabulary only ranks its pieces; their weights then fall as 1 / (rank + 10). A unigram vocabulary's own
    log probabilities are taken as they are.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.bytes_of = [b"" if k == "other" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)]
        self.byte_ids = np.full(256, -1, np.int32)
        usual = [i for i, k in enumerate(kinds) if k == "piece"]
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_ids[self.bytes_of[i][0]] = i
        ranked = all(float(scores[i]).is_integer() for i in usual)
        order = sorted(usual, key=lambda i: -scores[i])
        self.weight = np.full(len(pieces), -20.0)
        for r, i in enumerate(order):
            self.weight[i] = -np.log(r + 10) - np.log(np.log((len(order) + 10) / 10)) if ranked else scores[i]
        self.words = not any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in usual)
        lone = {"\n"} - {c for i in usual for c in pieces[i] if len(pieces[i]) > 1}
        self.lines = bool(lone)
        count: dict[str, int] = {}
        for i in usual:
            for c in pieces[i]:
                count[c] = count.get(c, 0) + 1
        common = sorted(count, key=lambda c: (-count[c], c))[:120]
        # classes: 0 none, 1.. common characters of the dense table, beyond those by search
        self.letters = np.array(sorted(ord(c) for c in count), np.uint32)
        rank = {ord(c): k + 1 for k, c in enumerate(common)}
        more = iter(range(len(common) + 1, len(count) + 1))
        self.classes = np.array([rank[x] if x in rank else next(more) for x in self.letters.tolist()], np.int64)
        self.table = np.zeros(1 << 16, np.int64)
        self.table[:-1] = self._searched(np.arange(len(self.table) - 1))
        self.width = len(common) + 1
        class_of = dict(zip(self.letters.tolist(), self.classes.tolist()))
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in usual:
            s = 0
            for c in pieces[i]:
                s = steps.setdefault((s, class_of[ord(c)]), len(steps) + 1)
            ends[s] = i
        n = len(steps) + 1
        self.dense = np.zeros((n, self.width), np.int32)
        rare = []
        for (s, c), t in steps.items():
            if c < self.width:
                self.dense[s, c] = t
            else:
                rare.append((s * (len(count) + 1) + c, t))
        rare.sort()
        self.base = len(count) + 1
        self.rare = np.array([r[0] for r in rare] or [-1], np.int64)
        self.rare_to = np.array([r[1] for r in rare] or [0], np.int32)
        self.end = np.full(n, -1, np.int32)
        for s, i in ends.items():
            self.end[s] = i
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        out = cls.__new__(cls)
        out.__dict__.update(tables)
        return out

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.dense[state, np.minimum(letter, self.width - 1)]
        far = np.flatnonzero(letter >= self.width)
        if len(far):
            key = state[far].astype(np.int64) * self.base + letter[far]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[far] = np.where(self.rare[at] == key, self.rare_to[at], 0)
        return out

    def letter(self, chars: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(chars, len(self.table) - 1)]
        return out if self.letters[-1] < len(self.table) - 1 else np.where(chars < len(self.table) - 1, out, self._searched(chars))

    def _searched(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, chars), len(self.letters) - 1)
        return np.where(self.letters[at] == chars, self.classes[at], 0)


def load(path: str) -> Vocabulary:
    """Read on the driver; executors get the table, which is bounded by the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) else "piece" for i in range(n)]
    v = Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)
    if (v.byte_ids < 0).any():
        raise ValueError("lossless encoding asks for a vocabulary with all 256 byte pieces")
    return v


#: Bits of a draw.
FINE = np.uint64(36)


class Lattices:
    """Forward pass over the lattices of different words: edges sorted by the node they end in."""

    def __init__(self, words: list[str], v: Vocabulary, power: float):
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        letters = v.letter(chars)
        limit = np.repeat(stop, size)
        start, state, step = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        a_s, b_s, i_s = [], [], []
        while len(start):
            state = v.step(state, letters[start + step])
            step += 1
            go = state > 0
            start, state = start[go], state[go]
            piece = v.end[state]
            hit = piece >= 0
            a_s.append(start[hit])
            b_s.append(start[hit] + step)
            i_s.append(piece[hit])
            go = start + step < limit[start]
            start, state = start[go], state[go]
        single = np.zeros(len(chars), bool)
        if a_s:
            single[a_s[0]] = True
        bare = np.flatnonzero(~single)  # no piece for this character: its bytes
        a = np.concatenate([*a_s, bare])
        b = np.concatenate([*b_s, bare + 1])
        pick = np.concatenate([*i_s, -1 - chars[bare].astype(np.int64)])
        weight = np.concatenate([v.weight[x] for x in i_s] + [np.full(len(bare), -30.0)]) * power
        # node of a place inside word k: place + k, so that a word of n characters has n + 1 nodes
        word = np.repeat(np.arange(len(words)), size)[a]
        a, b = a + word, b + word
        order = np.argsort(b, kind="stable")
        self.a, self.b, self.pick, weight = a[order], b[order], pick[order], weight[order]
        self.first = stop - size + np.arange(len(words))
        self.last = stop + np.arange(len(words))
        nodes = len(chars) + len(words)
        alpha = np.full(nodes, -np.inf)
        alpha[self.first] = 0.0
        depth = self.b - self.first[word[order]]
        deepest = int(depth.max()) if len(depth) else 0
        turn = np.argsort(depth.astype(np.int16) if deepest < 32768 else depth, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(depth, minlength=deepest + 1)[1:])))
        for x, y in zip(cuts[:-1], cuts[1:]):
            e = turn[x:y]
            if not len(e):
                continue
            value = alpha[self.a[e]] + weight[e]
            into = self.b[e]
            at = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            top = np.maximum.reduceat(value, at)
            total = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(at, len(e))))), at)
            alpha[into[at]] = top + np.log(total)
        self.alpha = alpha
        p = np.exp(alpha[self.a] + weight - alpha[self.b])
        self.low = np.concatenate(([0], np.cumsum(np.bincount(self.b, minlength=nodes))))
        # sums of a node's edges in turn, as whole numbers: they don't depend on where in a block the word stands
        run, width = p.copy(), np.diff(self.low)
        for k in range(1, int(width.max()) if len(width) else 0):
            e = self.low[:-1][width > k] + k
            run[e] += run[e - 1]
        self.cut = (self.b.astype(np.uint64) << FINE) + np.minimum(run * 2.0 ** int(FINE), 2.0 ** int(FINE)).astype(np.uint64)

    def sample(self, word: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Picks of the occurrences in turn, each one's in the order of the text, and picks per occurrence."""
        node, live = self.last[word], np.arange(len(word))
        first = self.first[word]
        who, what, turn = [], [], 0
        while len(live):
            u = mix(salt[live] + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) >> (np.uint64(64) - FINE)
            at = node[live]
            e = np.searchsorted(self.cut, (at.astype(np.uint64) << FINE) + u, "right")
            e = np.minimum(np.maximum(e, self.low[at]), self.low[at + 1] - 1)
            who.append(live)
            what.append(self.pick[e])
            at = self.a[e]
            node[live] = at
            live = live[at > first[live]]
            turn += 1
        count = np.zeros(len(word), np.int64)
        for k, live in enumerate(who):
            count[live] = k + 1
        end = np.cumsum(count)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (live, pick) in enumerate(zip(who, what)):
            out[end[live] - 1 - k] = pick
        return out, count


def encode_block(texts: list[str], keys: np.ndarray, v: Vocabulary, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in turn, and ids per text."""
    pattern = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if v.lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if v.words else None
    known: dict[str, int] = {}
    number: list[int] = []
    per = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        t = MARK + t.replace(MARK, LITERAL).replace(" ", MARK)
        parts = pattern.findall(t) if pattern else [t]
        per[i] = len(parts)
        number += [known.setdefault(p, len(known)) for p in parts]
    if not number:
        return np.zeros(0, np.int32), per
    word = np.array(number)
    place = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
    seeds = mix(keys.astype(np.uint64) + np.uint64(o.seed) * np.uint64(0xD6E8FEB86659FD93))
    salt = mix(np.repeat(seeds, per) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    flat, count = Lattices(list(known), v, o.power).sample(word, salt)
    end = np.cumsum(count)
    bare = np.flatnonzero(flat < 0)
    if len(bare):
        raw = [(MARK if x == ord(LITERAL) else chr(x)).encode() for x in (-1 - flat[bare]).tolist()]
        wide = np.ones(len(flat), np.int64)
        wide[bare] = [len(r) for r in raw]
        at = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), np.int64)
        plain = np.flatnonzero(flat >= 0)
        out[at[plain]] = flat[plain]
        for p, r in zip(at[bare].tolist(), raw):
            out[p : p + len(r)] = v.byte_ids[list(r)]
        total = np.add.reduceat(wide, end - count)
        flat = out
    else:
        total = count
    edge = np.concatenate(([0], np.cumsum(total)))
    doc = np.concatenate(([0], np.cumsum(per)))
    return flat.astype(np.int32), edge[doc[1:]] - edge[doc[:-1]]


def decode_block(ids: np.ndarray, count: np.ndarray, v: Vocabulary) -> list[bytes]:
    """The texts' bytes: pieces joined, the mark that stands before the first word taken off."""
    n = v.length[ids]
    end = np.cumsum(n)
    take = np.repeat(v.begin[ids] - (end - n), n) + np.arange(int(n.sum()))
    raw = v.flat[take].tobytes()
    edge = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(count)))].tolist()
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(edge[:-1], edge[1:])]


def encode(docs: DataFrame, o: Options = Options(), id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` without the text, plus ids, n_tokens and lossless (whether decoding gives back the text).

    Null texts have null ids and 0 tokens; empty ones no ids. A null key draws as an empty one does; equal rows get equal
    ids, and texts are encoded whole, however long. An empty table gives an empty one; input columns named like an output are replaced. One pass, no shuffle.
    """
    v = docs.sparkSession.sparkContext.broadcast(vars(load(o.model)))  # bounded by the vocabulary
    made = ["ids", "n_tokens", "lossless"]
    docs = docs.drop(*made)
    keep = [c for c in docs.columns if c != text_col or keep_text]
    rest = docs.select(*keep, F.col(text_col).alias("__text"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(v.value)
        for b in batches:
            texts, keys = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for x, y in slices(np.array([len(t or "") for t in texts], np.int64), o.block):
                part = [t or "" for t in texts[x:y]]
                ids, count = encode_block(part, keys[x:y], vocabulary, o)
                back = decode_block(ids, count, vocabulary)
                same = [r == t.encode() for r, t in zip(back, part)]
                null = np.array([t is None for t in texts[x:y]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids))
                if null.any():
                    lists = pa.array([None if z else r for z, r in zip(null, lists.to_pylist())], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(x, y - x) for c in b.columns[: len(keep)]], lists, pa.array(count), pa.array(same)], [*keep, *made])

    fields = "".join(f"`{c}` {rest.schema[c].dataType.simpleString()}, " for c in keep)
    return rest.mapInArrow(run, f"{fields}ids array<int>, n_tokens long, lossless boolean")


def decode(tokens: DataFrame, o: Options = Options(), ids_col: str = "ids") -> DataFrame:
    """``tokens`` plus text: the exact inverse of ``encode``. Null ids give null texts."""
    v = tokens.sparkSession.sparkContext.broadcast(vars(load(o.model)))
    tokens = tokens.drop("text")
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(v.value)
        for b in batches:
            texts = [None if x is None else decode_block(np.array(x, np.int64), np.array([len(x)]), vocabulary)[0].decode("utf-8", "replace") for x in b.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{fields}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "lossless")
