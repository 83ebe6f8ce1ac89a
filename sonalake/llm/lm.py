"""Language-model scores: causal self-attention over subword ids, beside an add-one word model.

Texts are cut once into ids of a public byte-pair vocabulary, each word with a
space before it, so the ids themselves tell where words begin. The model has two
levels of masked attention, which together give a probability to every sequence
of ids: one predicts the first id of the next word, or the end, from the words
before it; one predicts each further id of a word, or its stop, from the ids of
the word before it. A word's further ids depend on the word alone, so they are
scored once for each different word. Each prediction is a walk through a Huffman
tree over the whole vocabulary, with the attention's output deciding at every
branch: no id is dropped or merged.

Sequences are scored in windows that overlap by `context` places; each id is
scored once, in the window that has it beyond its context.

Training takes every id of every training text: gradients are summed over all
texts of a share and over all different words by their counts, then Adam makes
one step; STEPS shares make up all texts. Sums don't depend on partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, keeping, map_batches, mix64, released, words_of, written  # noqa: F401

#: Input classes (the commonest ids have their own), branches with weights of their own (the others keep their frequencies).
CLASSES, BRANCHES = 2048, 2047
#: Branches with the most mass, which every place computes at once, on its way or not: a matter of speed alone.
DENSE = 48
#: Places that go through a network at once.
PLACES = 16384
#: Steps of training, its rate, seed. Ids that are counted at once, or go through the network, and characters that are cut at once.
STEPS, RATE, SEED = 16, 0.12, 3
COUNT_IDS, PIECE_IDS, CHARS = 2_000_000, 200_000, 1_000_000
#: Words that are broadcast at most; those over 1/HOT of all tokens are in every step. Words that a task remembers while cutting.
HOT, CACHE_WORDS = 200_000, 250_000
FOLDS, HELD = 7, 2
#: Numbers of a row in which sums of gradients travel.
CHUNK = 1024
WORDS_KIND, FIRST_KIND, NEXT_KIND, DOCS_KIND = 0, 1, 2, 3
#: Turns of words that are in every step of training, and in none.
OFTEN, NEVER = -1, -2


@dataclass(frozen=True)
class Level:
    """Width of the vectors, places scored in a window and before them, kinds of the second input, windows of a batch."""

    width: int
    scored: int
    context: int
    second: int
    batch: int


#: Words of a text: the inputs are the first and the last id of the word before. Ids of a word: the id before and its place.
TEXT, WORD = Level(8, 32, 16, CLASSES, 256), Level(16, 4, 12, 8, 1024)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The public vocabulary as a tiktoken encoding, and which ids begin with a space."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's own
    begins = np.zeros(max(ranks.values()) + 1, bool)
    begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), begins


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... length[0] places, then those from first[1], and so on."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Spelling:
    """Ids of words, cut together where they are new to the task."""

    def __init__(self, path: str):
        self.encoding, self.begins = encoding(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " " + " ".join(words)
        flat = np.array(self.encoding.encode_ordinary(joined), np.int32)
        first = np.flatnonzero(self.begins[flat])
        if len(first) != len(words) or not joined.isprintable():  # other white space may join words: cut one by one
            ids = [self.encoding.encode_ordinary(" " + w) for w in words]
            return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))
        return flat, np.diff(np.r_[first, len(flat)])

    def spelled(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of texts that lie one after the other, and how many each text has, which ends before these words."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        coded = words.dictionary_encode()  # each different word is looked up once
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in different if w not in self.at]:
            flat, length = self.cut(new)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(length) - length])
            self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, flat])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        place = np.fromiter(map(self.at.__getitem__, different), np.int64, len(different))[coded.indices.to_numpy()]
        length = self.length[place]
        upto = np.r_[0, np.cumsum(length)]
        return self.flat[spread(self.first[place], length)], np.diff(upto[np.r_[0, ends]])

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has, by the texts' words."""
        words = pa.array([w.decode("utf-8", "replace") for words in texts for w in words], pa.string())
        return self.spelled(words, np.cumsum([len(words) for words in texts], dtype=np.int64))

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole texts; null is empty. Both functions of Arrow know A-Z and the white space of the contracts only."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, offsets = split.flatten(), split.offsets.to_numpy()
        held = pc.greater(pc.binary_length(words), 0)  # space at either end of a text leaves an empty word there
        upto = np.r_[0, np.cumsum(held.to_numpy(zero_copy_only=False))]
        return self.spelled(words.filter(held), upto[offsets[1:] - offsets[0]])


def tokenised(documents: DataFrame, path: str) -> DataFrame:
    """row, doc_id, share (of training, -1 for the held-out fold) and ids (packed) of documents(doc_id, text), cut once; a folder for each share."""

    def make():
        keeping()
        spelling = Spelling(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, count = spelling.ids_of(batch.column(3))
            return pa.RecordBatch.from_arrays([*batch.columns[:3], packed_ids(flat, count)], names=["row", "doc_id", "share", "ids"])

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    share = F.when(crc_mod("doc_id", FOLDS) == HELD, -1).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(STEPS))).cast("int")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", share.alias("share"), "text")
    return written(map_batches(rows, "text", make, f"row long, doc_id {kind}, share int, ids binary", chars=CHARS), "ids", "share")


@dataclass
class Texts:
    """Words of a piece of the ids: where each begins, how long it is, its hash, and how many each text has."""

    flat: np.ndarray
    first: np.ndarray
    length: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, packed: pa.Array, begins: np.ndarray) -> Texts:
        flat, count = unpacked(packed)
        first = np.flatnonzero(begins[flat])
        words = np.diff(np.searchsorted(first, np.r_[0, np.cumsum(count)]))
        return cls(flat, first, np.diff(np.r_[first, len(flat)]), words)

    def hashes(self) -> np.ndarray:
        """63 bits of each word's ids and their places."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        place = np.arange(len(self.flat)) - np.repeat(self.first, self.length)
        mixed = mix64(self.flat.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(20)) + np.uint64(1))
        return (mix64(np.add.reduceat(mixed, self.first)) >> np.uint64(1)).view(np.int64)


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `most` ids of a packed column; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    offsets = packed_offsets(batch.column(column))
    upto, start = offsets[1:] - offsets[0], 0
    while start < batch.num_rows:
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def packed_ids(flat: np.ndarray, length: np.ndarray) -> pa.Array:
    """Two bytes an id, of words or texts whose ids lie one after the other: bytes go through Spark whole, not number by number."""
    offsets = np.r_[0, 2 * np.cumsum(length)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.astype("<u2").tobytes())])


def packed_offsets(packed: pa.Array) -> np.ndarray:
    """Where the ids of each item begin and the last ends."""
    return np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 2


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of packed words or texts."""
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets, held = packed_offsets(packed), packed.buffers()[2]
    data = np.frombuffer(held, "<u2", len(held) // 2)[offsets[0] : offsets[-1]] if held else np.zeros(0, "<u2")
    return data.astype(np.int64), np.diff(offsets)


def counted(ids: DataFrame, path: str) -> DataFrame:
    """kind, key, n: how often training texts have each word, first id, next id of a word (or its stop), and how many they are.

    Words of held-out texts are there too, with n = 0 if no training text has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping()
        begins = encoding(path)[1]
        stop = len(begins)
        for whole in batches:
            for batch in pieces(whole, 1, COUNT_IDS):
                t = Texts.of(batch.column(1), begins)
                train = (batch.column(0).to_numpy() >= 0).astype(float)
                _, at, back = np.unique(t.hashes(), return_index=True, return_inverse=True)
                n = np.bincount(back, np.repeat(train, t.words), len(at)).astype(np.int64)
                first, length = t.first[at], t.length[at]
                flat = t.flat[spread(first, length)]
                firsts = np.bincount(t.flat[first], n, stop).astype(np.int64)
                begin = np.cumsum(length) - length
                inner = np.ones(len(flat), bool)
                inner[begin] = False
                nexts = np.bincount(flat[inner], np.repeat(n, length)[inner], stop + 1).astype(np.int64)
                nexts[stop] += n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), packed_ids(flat, length), pa.array(n)], names=["kind", "key", "n"])
                for kind, counts in ((FIRST_KIND, firsts), (NEXT_KIND, nexts), (DOCS_KIND, np.array([int(train.sum())]))):
                    used = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), packed_ids(used, np.ones(len(used), np.int64)), pa.array(counts[used])], names=["kind", "key", "n"])
        released()

    parts = ids.select("share", "ids").mapInArrow(run, "kind int, key binary, n long")
    return written(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


@dataclass
class Tree:
    """A Huffman tree over symbols: for each branch on the way to each, its weights' row, the turn (1 or -1) and the log-odds by frequency.

    Branches are numbered from the one with the most symbols below it; from
    BRANCHES on they have no weights and share the last row, of zeros.
    """

    first: np.ndarray
    length: np.ndarray
    branch: np.ndarray
    turn: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        size = len(counts)
        mass = np.r_[counts + 1.0, np.zeros(size - 1)]
        parent, side = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1)
        heap = [(m, i) for i, m in enumerate(mass[:size].tolist())]
        heapq.heapify(heap)
        for node in range(size, 2 * size - 1):
            (m1, a), (m2, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[a, b]], side[[a, b]], mass[node] = node, (1, -1), m1 + m2
            heapq.heappush(heap, (m1 + m2, node))
        inner = np.arange(size, 2 * size - 1)
        number = np.zeros(2 * size - 1, np.int64)
        number[inner[np.lexsort((inner, -mass[inner]))]] = np.arange(size - 1)
        up, down = np.zeros(size - 1), np.zeros(size - 1)
        child = np.arange(2 * size - 2)
        np.add.at(up, number[parent[child[side[child] > 0]]], mass[child[side[child] > 0]])
        np.add.at(down, number[parent[child[side[child] < 0]]], mass[child[side[child] < 0]])
        at, ways, turns = np.arange(size), [], []
        while (live := at != 2 * size - 2).any():
            ways.append(np.where(live, number[parent[at]], -1))
            turns.append(side[at])
            at = np.where(live, parent[np.minimum(at, 2 * size - 3)], at)
        way, turn = np.stack(ways, 1), np.stack(turns, 1)
        used = way >= 0
        length = used.sum(1)
        odds = np.log(up / down).astype(np.float32)[way[used]]
        return cls(np.cumsum(length) - length, length, np.minimum(way[used], BRANCHES).astype(np.uint16), turn[used].astype(np.int8), odds)


def places(lengths: np.ndarray, scored: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of sequences that lie one after the other, and whether each is inside its sequence."""
    first, per = np.cumsum(lengths) - lengths, -(-lengths // scored)
    owner = np.repeat(np.arange(len(lengths)), per)
    start = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * scored
    at = start[:, None] + np.arange(-context, scored)
    return at, (at >= first[owner][:, None]) & (at < (first + lengths)[owner][:, None])


def summed_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values' rows by row number."""
    return np.stack([np.bincount(rows, v, size) for v in values.T], 1)


def longest(m: np.ndarray) -> float:
    """Length of the longest row."""
    return float(np.einsum("ij,ij->i", m, m).max(initial=0)) ** 0.5


class Ways:
    """Branches on the ways to the symbols of a run: those near the root as tables by symbol, the others as lists.

    The loss of a branch is ln(1 + exp(sign * (own log-odds) + offset)). In the
    tables a branch that isn't on the way has no sign and an offset that makes
    its loss 0, so one product with all of them serves every place. Branches
    without weights add the same to every place of a symbol.
    """

    def __init__(self, tree: Tree, bias: np.ndarray, symbols: np.ndarray):
        used = np.flatnonzero(np.bincount(symbols, minlength=len(tree.length)))
        number = np.zeros(len(tree.length), np.int64)
        number[used] = np.arange(len(used))
        self.local, length = number[symbols], tree.length[used]
        at, owner = spread(tree.first[used], length), np.repeat(np.arange(len(used)), length)
        row, sign = tree.branch[at].astype(np.int64), -tree.turn[at].astype(np.float32)
        offset = sign * (tree.odds[at] + bias[row])
        near, fixed = row < DENSE, row >= BRANCHES
        self.sign = np.zeros((len(used), DENSE), np.float32)
        self.offset = np.full((len(used), DENSE), -1e4, np.float32)
        self.sign[owner[near], row[near]], self.offset[owner[near], row[near]] = sign[near], offset[near]
        self.most = float(self.offset.max(initial=0))
        self.constant = np.bincount(owner[fixed], np.log1p(np.exp(offset[fixed].astype(float))), len(used))
        far = ~near & ~fixed
        self.far = np.bincount(owner[far], minlength=len(used))
        self.far_first = np.cumsum(self.far) - self.far
        self.far_row, self.far_sign, self.far_offset = row[far], sign[far], offset[far]


class Net:
    """One causal head: parameters as one flat array. Inputs are sums of two embeddings; outputs walk a tree."""

    def __init__(self, level: Level, tree: Tree, flat: np.ndarray | None = None):
        d, self.level, self.tree = level.width, level, tree
        self.shapes = {"e": (CLASSES + 1, d), "f": (level.second + 1, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "r": (level.scored + level.context,), "u": (BRANCHES + 1, d), "b": (BRANCHES + 1,)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())
        if flat is None:
            rng = np.random.default_rng(SEED)
            scale = {"e": 0.5, "f": 0.5, "q": 0.3, "k": 0.3, "v": d**-0.5, "o": d**-0.5}
            flat = np.concatenate([rng.normal(0, scale[n], s).ravel() if n in scale else np.zeros(s).ravel() for n, s in self.shapes.items()])
        self.p, at = {}, 0
        for n, s in self.shapes.items():
            self.p[n] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
            at += int(np.prod(s))

    def walk(self, ways: Ways, local: np.ndarray, h: np.ndarray, weight: np.ndarray | None, grad: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of symbols, by their numbers in ways; with weights, the gradient by h as well, and grad grows by those of u and b."""
        near = self.p["u"][:DENSE]
        sign = ways.sign.take(local, 0)
        miss = h @ near.T
        miss *= sign
        miss += ways.offset.take(local, 0)
        most = longest(h) * longest(near) + ways.most
        if most > 60:
            np.minimum(miss, 60, out=miss)
        np.exp(miss, out=miss)  # the odds of the other turn
        whole = miss + 1
        if weight is not None:
            miss /= whole
            miss *= sign
            miss *= weight[:, None]
            dh = miss @ near
            grad["u"][:DENSE] += miss.T @ h
            grad["b"][:DENSE] += np.ones(len(miss), np.float32) @ miss
        if most < 40 and DENSE % 2 == 0:  # a logarithm for two
            whole = whole[:, : DENSE // 2] * whole[:, DENSE // 2 :]
        out = -(np.log(whole, out=whole) @ np.ones(whole.shape[1], np.float32)) - ways.constant[local]
        some = np.flatnonzero(ways.far[local])
        if len(some):
            local = local[some]
            length = ways.far[local]
            at, rep = spread(ways.far_first[local], length), np.repeat(some, length)
            row, asked = ways.far_row[at], h.take(rep, 0)
            u, sign = self.p["u"].take(row, 0), ways.far_sign[at]
            miss = np.exp(np.minimum(sign * np.einsum("ij,ij->i", asked, u) + ways.far_offset[at], 60))
            starts = np.cumsum(length) - length
            out[some] -= np.add.reduceat(np.log(1 + miss), starts)
            if weight is not None:
                dz = sign * miss / (1 + miss) * weight[rep]
                asked *= dz[:, None]
                grad["far"].append((row, dz, asked))
                u *= dz[:, None]
                dh[some] += summed_rows(np.repeat(np.arange(len(some)), length), u, len(some))
        return out, None if weight is None else dh

    def run(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln probability of each symbol; with weights, the gradient of the weighted sum of -ln p as well.

        Windows with as many places before them are taken together, so no place
        before a sequence is computed; those after its end are seen by none
        inside. Sums of weights come with the values, by a column of ones. About
        PLACES are taken at once, so that what belongs to them stays in a cache.
        """
        out, grad = np.zeros(len(a)), None if weight is None else {n: np.zeros(shape) for n, shape in self.shapes.items()}
        if grad is not None:
            grad["far"], grad["dx"] = [], np.zeros((len(a), self.level.width), np.float32)  # rows that are summed by their numbers in the end
        ways, upto, start = Ways(self.tree, self.p["b"], symbols), np.r_[0, np.cumsum(lengths)], 0
        while start < len(lengths):
            end = max(start + 1, int(np.searchsorted(upto, upto[start] + PLACES, side="right")) - 1)
            some = slice(upto[start], upto[end])
            out[some] = self.part(ways, a[some], b[some], lengths[start:end], ways.local[some], None if weight is None else weight[some], grad, some)
            start = end
        if grad is None:
            return out, None
        for name, index in (("e", a), ("f", b)):
            grad[name] += summed_rows(index, grad["dx"], len(grad[name]))
        if grad["far"]:
            row, dz, asked = map(np.concatenate, zip(*grad["far"], strict=True))
            grad["b"] += np.bincount(row, dz, BRANCHES + 1)
            grad["u"] += summed_rows(row, asked, BRANCHES + 1)
        grad["u"][BRANCHES], grad["b"][BRANCHES] = 0, 0
        return out, np.concatenate([grad[n].ravel() for n in self.shapes])

    def part(self, ways: Ways, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, local: np.ndarray, weight: np.ndarray | None, grad: dict | None, some: slice) -> np.ndarray:
        """ln probabilities at some sequences' places; grad grows by their gradient."""
        s, c, d = self.level.scored, self.level.context, self.level.width
        out, p = np.zeros(len(a)), self.p
        every, inside = places(lengths, s, c)
        before, full = inside[:, :c].sum(1), inside[:, -1]
        flat_x = p["e"].take(a, 0) + p["f"].take(b, 0)
        m = np.concatenate([p["q"] * np.float32(d**-0.5), p["o"], p["k"], p["v"]], 1)
        flat = flat_x @ m
        asker, keys = np.ascontiguousarray(flat[:, : 2 * d]), np.ascontiguousarray(flat[:, 2 * d : 3 * d].T)
        values = np.concatenate([flat[:, 3 * d :], np.ones((len(a), 1), np.float32)], 1)
        small = longest(flat[:, :d]) * longest(flat[:, 2 * d : 3 * d]) + np.abs(p["r"]).max() < 60  # else the greatest is taken off before exp
        if weight is not None:
            d_asker, d_seen = np.zeros((len(a), 2 * d), np.float32), np.zeros((len(a), 2 * d), np.float32)
        for behind, whole in np.argwhere(np.bincount(before * 2 + full, minlength=2 * c + 2).reshape(-1, 2)):
            back = (np.arange(s)[:, None] + behind) - np.arange(s + behind)[None, :]
            near = np.where(back >= 0, p["r"][np.maximum(back, 0)], -1e9).astype(np.float32)
            group = np.flatnonzero((before == behind) & (full == whole))
            for i in range(0, len(group), self.level.batch):
                which = group[i : i + self.level.batch]
                at = every[which, c - behind :]
                mine = None if whole else np.flatnonzero(inside[which, c:])
                if not whole:
                    at = np.minimum(at, len(a) - 1)
                inner = lambda x: x.reshape(-1, x.shape[-1]) if mine is None else x.reshape(-1, x.shape[-1]).take(mine, 0)  # noqa: E731, B023
                here = inner(at[:, behind:, None])[:, 0]
                own = asker.take(at[:, behind:], 0)
                q, k, v = own[..., :d], keys.take(at, 1).transpose(1, 0, 2), values.take(at, 0)
                w = q @ k
                w += near
                if not small:
                    w -= w.max(2, keepdims=True)
                np.exp(w, out=w)
                seen = w @ v
                share = 1 / seen[..., d:]
                seen = seen[..., :d] * share
                out[here], dh_mine = self.walk(ways, local[here], inner(seen + own[..., d:]), None if weight is None else weight[here], grad)
                if weight is None:
                    continue
                dh = np.zeros((len(at), s, d + 1), np.float32)
                dh.reshape(-1, d + 1)[slice(None) if mine is None else mine, :d] = dh_mine
                dh[..., d] = -np.einsum("ijk,ijk->ij", dh[..., :d], seen)
                dh *= share
                dw = dh @ v.transpose(0, 2, 1)
                dw *= w
                grad["r"] += np.bincount(np.maximum(back, 0).ravel(), (dw.sum(0) * (back >= 0)).ravel(), s + c)
                moved = np.concatenate([dw.transpose(0, 2, 1) @ q, w.transpose(0, 2, 1) @ dh[..., :d]], 2)
                d_asker[here] = np.concatenate([inner(dw @ k.transpose(0, 2, 1)), dh_mine], 1)
                d_seen[here] += inner(moved[:, behind:])
                for j in range(0, behind, s):  # the windows of a sequence lie s apart: no place is twice in one of these
                    d_seen[at[:, j : min(j + s, behind)]] += moved[:, j : min(j + s, behind)]
        if weight is None:
            return out
        moved = np.concatenate([d_asker, d_seen], 1)
        total = flat_x.T @ moved
        for j, (name, scale) in enumerate((("q", d**-0.5), ("o", 1), ("k", 1), ("v", 1))):
            grad[name] += total[:, j * d : (j + 1) * d] * scale
        grad["dx"][some] = moved @ m.T
        return out


@dataclass
class Model:
    """All that scoring needs but the weights and the counts of words: as large as the vocabulary asks."""

    path: str
    classes: np.ndarray
    trees: tuple[Tree, Tree]
    tokens: int
    distinct: int
    documents: int

    def nets(self, flats: list[np.ndarray] | None = None) -> tuple[Net, Net]:
        """Of the two levels, with these weights or those before training."""
        return tuple(Net(level, self.trees[k], flats[k] if flats else None) for k, level in enumerate((TEXT, WORD)))

    def text_inputs(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last ids of the word before each word and the end of each text, how many these are, and the first ids to predict."""
        sizes, end = t.words + 1, len(self.classes)
        at = spread(np.cumsum(sizes) - sizes, t.words)
        first, last = np.full(int(sizes.sum()), end), np.full(int(sizes.sum()), end)
        first[at], last[at] = t.flat[t.first], t.flat[t.first + t.length - 1]
        known = np.r_[self.classes, CLASSES]
        a, b = np.r_[CLASSES, known[first][:-1]], np.r_[CLASSES, known[last][:-1]]
        return a, b, sizes, first

    def word_inputs(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes and places of the words' ids, and the ids that follow, with the stop after the last."""
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        follow = np.r_[flat[1:], 0]
        follow[np.cumsum(length) - 1] = len(self.classes)
        return self.classes[flat], np.minimum(place, WORD.second), follow


def chunks(level: int, grad: np.ndarray, loss: float, weight: float) -> pa.RecordBatch:
    """A sum of gradients in rows; the last row has the loss and its weight."""
    parts = [*(grad[i : i + CHUNK] for i in range(0, len(grad), CHUNK)), np.array([loss, weight])]
    numbers = [*range(len(parts) - 1), -1]
    return pa.RecordBatch.from_arrays([pa.array([level] * len(parts), pa.int32()), pa.array(numbers, pa.int32()), pa.array([x.astype("<f8").tobytes() for x in parts], pa.binary())], names=["level", "chunk", "v"])


def summed(parts: DataFrame) -> dict[int, tuple[np.ndarray, float, float]]:
    """Sum of the rows of all tasks, by level: a bounded number of rows, whatever the table's size."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("v").to_pylist()
        total = np.frombuffer(rows[0], "<f8").copy()
        for r in rows[1:]:
            total += np.frombuffer(r, "<f8")
        return pa.table({"level": table.column("level").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    got = parts.groupBy("level", "chunk").applyInArrow(add, "level int, chunk int, v binary").toArrow().sort_by([("level", "ascending"), ("chunk", "ascending")]).to_pylist()
    out = {}
    for level in {r["level"] for r in got}:
        own = [np.frombuffer(r["v"], "<f8") for r in got if r["level"] == level]
        out[level] = (np.concatenate(own[1:]), *own[0].tolist())
    return out


def step_gradients(ids: DataFrame, words: DataFrame, model: Model, shared: Broadcast, flats: list[np.ndarray], turn: int) -> dict[int, tuple[np.ndarray, float, float]]:
    """Gradients over the texts of a share, and over a share of the different words, frequent ones in every share."""
    weights = ids.sparkSession.sparkContext.broadcast([f.astype(np.float32) for f in flats])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping()
        model = shared.value
        net, begins = model.nets(weights.value)[0], encoding(model.path)[1]
        grad, loss, weight = np.zeros(net.size), 0.0, 0.0
        for whole in batches:
            for batch in pieces(whole, 0, PIECE_IDS):
                a, b, sizes, first = model.text_inputs(Texts.of(batch.column(0), begins))
                lp, g = net.run(a, b, sizes, first, np.ones(len(first), np.float32))
                grad, loss, weight = grad + g, loss - lp.sum(), weight + len(first)
        yield chunks(0, grad, loss, weight)
        released()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping()
        model = shared.value
        net = model.nets(weights.value)[1]
        grad, loss, weight = np.zeros(net.size), 0.0, 0.0
        for batch in batches:
            keys = batch.column(0)
            flat, length = unpacked(keys)
            if len(flat):
                a, b, follow = model.word_inputs(flat, length)
                times = np.repeat(batch.column(1).to_numpy(), length).astype(np.float32)
                lp, g = net.run(a, b, length, follow, times)
                grad, loss, weight = grad + g, loss - (lp * times).sum(), weight + float(times.sum())
        yield chunks(1, grad, loss, weight)
        released()

    mine = words.where(F.col("turn").isin(turn, OFTEN)).select("key", F.when(F.col("turn") == OFTEN, F.col("n") / STEPS).otherwise(F.col("n")).cast("double").alias("times"))
    schema = "level int, chunk int, v binary"
    found = summed(ids.where(F.col("share") == turn).select("ids").mapInArrow(texts, schema).union(mine.mapInArrow(inner, schema)))
    weights.destroy()
    return found


def input_classes(counts: np.ndarray) -> np.ndarray:
    """A class for each id: the commonest their own, the others by bands of equal mass in the last sixteenth."""
    bands = CLASSES // 16
    order = np.lexsort((np.arange(len(counts)), -counts))
    of, rest = np.zeros(len(counts), np.int64), order[CLASSES - bands :]
    of[order[: CLASSES - bands]] = np.arange(min(CLASSES - bands, len(order)))
    mass = np.cumsum(counts[rest] + 1e-3)
    of[rest] = CLASSES - bands + np.minimum((mass / mass[-1] * bands).astype(np.int64), bands - 1) if len(rest) else 0
    return of


def train(ids: DataFrame, path: str) -> tuple[Model, list[np.ndarray], DataFrame]:
    """The model, the weights of its levels, and key, n, turn of all words; texts of the held-out fold are read for neither counts nor gradients."""
    size = len(encoding(path)[1])
    counts = counted(ids, path)
    words = counts.where(F.col("kind") == WORDS_KIND).select("key", "n")
    sums = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    docs = counts.where(F.col("kind") == DOCS_KIND).agg(F.sum("n")).first()[0] or 0
    tokens, distinct = (sums["n"] or 0) + docs, (sums["v"] or 0) + (docs > 0)
    small = counts.where(F.col("kind").isin(FIRST_KIND, NEXT_KIND)).toArrow().combine_chunks()  # as many rows as the vocabulary has, twice
    first, after = np.zeros(size + 1), np.zeros(size + 1)
    for kind, key, n in zip(*(small.column(c).to_pylist() for c in ("kind", "key", "n")), strict=True):
        (first if kind == FIRST_KIND else after)[int.from_bytes(key, "little")] += n
    first[size] += docs
    often = F.when(F.col("n") > tokens / HOT, OFTEN).otherwise(F.pmod(F.xxhash64("key"), F.lit(STEPS)))
    words = written(words.withColumn("turn", F.when(F.col("n") > 0, often).otherwise(NEVER).cast("int")), "turns", "turn")  # a step reads its own
    model = Model(path, input_classes((first + after)[:size]), (Tree.of(first), Tree.of(after)), tokens, distinct, docs)
    nets, shared = model.nets(), ids.sparkSession.sparkContext.broadcast(model)
    flats = [np.concatenate([n.p[k].ravel() for k in n.shapes]).astype(float) for n in nets]
    moments = [[np.zeros(n.size), np.zeros(n.size)] for n in nets]
    for turn in range(STEPS if tokens else 0):
        for level, (grad, _, weight) in step_gradients(ids, words, model, shared, flats, turn).items():
            if weight:
                grad, (m, v) = grad / weight, moments[level]
                m += 0.2 * (grad - m)
                v += 0.1 * (grad**2 - v)
                rate = RATE * (1 - turn / (2 * STEPS))
                flats[level] = flats[level] - rate * (m / (1 - 0.8 ** (turn + 1))) / (np.sqrt(v / (1 - 0.9 ** (turn + 1))) + 1e-5)
    shared.destroy()
    return model, flats, words


def scored_words(words: DataFrame, model: Model, flats: list[np.ndarray]) -> DataFrame:
    """hash, n, inner: of each different word, the log10 probability of its ids after the first and of its stop."""
    shared = words.sparkSession.sparkContext.broadcast((model, flats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping()
        model, flats = shared.value
        net = model.nets(flats)[1]
        for batch in batches:
            flat, length = unpacked(batch.column(0))
            if not len(flat):
                continue
            a, b, follow = model.word_inputs(flat, length)
            first = np.cumsum(length) - length
            inner = np.add.reduceat(net.run(a, b, length, follow)[0], first) / np.log(10)
            hashes = Texts(flat, first, length, length).hashes()
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(1), pa.array(inner)], names=["hash", "n", "inner"])
        released()

    out = written(words.select("key", "n").mapInArrow(run, "hash long, n long, inner double"), "words")
    shared.destroy()
    return out


def scored_once(ids: DataFrame, model: Model, flats: list[np.ndarray], hot: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id, share, n_tokens, sums over hot words and ends, and the rare words with their times."""
    shared = ids.sparkSession.sparkContext.broadcast((model, flats, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeping()
        model, flats, (keys, counts, inner) = shared.value
        net, begins = model.nets(flats)[0], encoding(model.path)[1]
        total = np.log10(model.tokens + model.distinct + 1)
        for whole in batches:
            for batch in pieces(whole, 3, PIECE_IDS):
                t, many = Texts.of(batch.column(3), begins), batch.num_rows
                a, b, sizes, first = model.text_inputs(t)
                owner = np.repeat(np.arange(many), sizes)
                score = np.bincount(owner, net.run(a, b, sizes, first)[0], many) / np.log(10)
                h, owner = t.hashes(), np.repeat(np.arange(many), t.words)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hot = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                base = np.bincount(owner[hot], np.log10(counts[at[hot]] + 1.0) - total, many) + np.log10(model.documents + 1.0) - total
                known = np.bincount(owner[hot], minlength=many) + int(model.documents > 0)
                score += np.bincount(owner[hot], inner[at[hot]], many)
                order = np.lexsort((h[~hot], owner[~hot]))
                rare, who = h[~hot][order], owner[~hot][order]
                new = np.r_[True, (rare[1:] != rare[:-1]) | (who[1:] != who[:-1])] if len(rare) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                cuts = pa.array(np.searchsorted(who[first], np.arange(many + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (rare[first], np.diff(np.r_[first, len(rare)]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, (sizes, known, base, score)), *lists], names=["row", "doc_id", "share", "n_tokens", "known", "base", "score", "keys", "times"])
        released()

    kind = ids.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, share int, n_tokens long, known long, base double, score double, keys array<long>, times array<long>"
    out = written(ids.select("row", "doc_id", "share", "ids").mapInArrow(run, schema), "scored")
    shared.destroy()
    return out


def hot_count(words: DataFrame, least: float) -> float:
    """A count that at most HOT words exceed: least, as there are at most HOT words over 1/HOT of all tokens, or a smaller one by halves."""
    halves = [least / 2**k for k in range(1, 24)]
    many = words.agg(*(F.count_if(F.col("n") > h) for h in halves)).first()
    return min([least, *(h for h, n in zip(halves, many, strict=True) if n <= HOT)])


def score_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of documents(doc_id, text), one row per row.

    Null text is empty: one token, the end. A null doc_id is in no fold that is
    held out. Rows that repeat a doc_id are scored apart, equal texts alike.
    Without training documents every count is 0 and the model has its first
    weights. Texts and words are taken whole, however long; other columns don't
    matter. The commonest words have their counts broadcast, at most HOT of them;
    the others are looked up by a shuffle of their 63-bit hashes.
    """
    ids = tokenised(documents, path)
    model, flats, words = train(ids, path)
    words = scored_words(words, model, flats)
    least = hot_count(words, model.tokens / HOT)
    hot = words.where(F.col("n") > least).toArrow().sort_by("hash")
    rows = scored_once(ids, model, flats, tuple(hot.column(c).to_numpy() for c in ("hash", "n", "inner")))
    rare = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("hash"), F.col("w.times").alias("times"))
    found = rare.join(words.where(F.col("n") <= least), "hash")
    total = float(np.log10(model.tokens + model.distinct + 1))
    log = F.log10(F.col("n").cast("double") + 1) - total
    sums = found.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more_known"), F.sum(F.col("times") * F.col("inner")).alias("inside"))
    return rows.drop("keys", "times").join(sums, "row", "left").select(
        "doc_id",
        (F.col("share") == -1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("inside", F.lit(0.0))).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
