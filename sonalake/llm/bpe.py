"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of the tree holds (rank, i) of the pair that starts at symbol i; inner
nodes hold the smaller of their children. The root is the leftmost pair of
lowest rank; merging it changes at most three leaves, each a logarithmic point
update. Words of a batch that the task hasn't met are encoded together, as one
array of trees for each width; words too long for that have a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches

#: Fixed value: how the public byte-level tokenizer cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers, and their bytes at most; words as long as TREE_WIDTH symbols are merged one at a time.
CACHE_WORDS, CACHE_LENGTH, TREE_WIDTH = 200_000, 64, 256
CHUNK = 200_000
TYPES = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """A tokenizer read from a tokenizers-library JSON file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for shown, b in alphabet.items():
            self.first[b] = vocab[shown]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.cut = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[str, str]] = {}
        self.passing: list[str] = []

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't be merged; negative ids are no symbols."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of at most `width` bytes, a power of two: one tree for each row of an array."""
        count = len(words)
        length = np.fromiter(map(len, words), np.int64, count)
        ids = np.full((count, width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < length[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.tile(np.arange(1, width + 2), (count, 1)), np.tile(np.arange(-1, width), (count, 1))
        tree = np.full((count, 2 * width), NONE, np.int64)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + np.arange(width), NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            then, prior = after[live, gone], before[live, at]
            ids[live, at], ids[live, gone] = self.made[rank], -1
            after[live, at] = then
            inside = then <= width
            before[live[inside], np.minimum(then[inside], width - 1)] = np.where(then[inside] < width, at[inside], before[live[inside], width - 1])
            self.put(tree, live, gone, np.full(len(live), NONE), width)
            self.put(tree, live, at, self.pair_ranks(ids[live, at], ids[live, np.minimum(then, width)]), width)
            has = np.flatnonzero(prior >= 0)
            rows = live[has]
            self.put(tree, rows, prior[has], self.pair_ranks(ids[rows, prior[has]], ids[rows, at[has]]), width)
            live = live[tree[live, 1] < NONE]
        flat = ids[:, :width]
        kept = flat >= 0
        return [x.tolist() for x in np.split(flat[kept], np.cumsum(kept.sum(1))[:-1])]

    @staticmethod
    def put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, ranks: np.ndarray, width: int) -> None:
        """Point updates, one leaf in each of the rows."""
        node = at + width
        tree[rows, node] = np.where(ranks < NONE, np.minimum(ranks, NONE // width - 1) * width + at, NONE)
        while node[0] > 1 if len(node) else False:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word of any length, by a tree of its own."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        count = len(ids)
        width = 1 << max(1, (count - 1).bit_length())
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        get, none = self.rank_of.get, NONE
        tree = [none] * (2 * width)
        for i in range(count - 1):
            if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then, prior = after[gone], before[at]
            ids[at], ids[gone], after[at] = int(self.made[rank]), -1, then
            if then < count:
                before[then] = at
            changed = [(gone, None), (at, get(ids[at] << 32 | ids[then]) if then < count else None)]
            if prior >= 0:
                changed.append((prior, get(ids[prior] << 32 | ids[at])))
            for leaf, rank in changed:
                node = leaf + width
                tree[node] = none if rank is None else rank * width + leaf
                while node > 1:
                    node >>= 1
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
        return [i for i in ids if i >= 0]

    def learn(self, words: Iterable[str], into: dict[str, tuple[str, str]]) -> None:
        """Adds each word's ids as text, and what they decode to."""
        by_width: dict[int, list[str]] = {}
        for word in words:
            size = len(word.encode())
            by_width.setdefault(1 << max(1, (size - 1).bit_length()) if size < TREE_WIDTH else 0, []).append(word)
        for width, group in by_width.items():
            step = max(1, 2_000_000 // width) if width else 1
            for k in range(0, len(group), step):
                part = group[k : k + step]
                raw = [w.encode() for w in part]
                for word, ids in zip(part, self.merge_many(raw, width) if width else map(self.merge_one, raw), strict=True):
                    into[word] = (",".join(map(str, ids)), self.decode(ids))

    def pieces(self, text: str) -> Iterator[tuple[list[str], bool]]:
        """Words in chunks, and special tokens, each as a chunk of its own."""
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                yield [part], True
            elif len(part) <= 8 * CHUNK:
                if part:
                    yield self.cut.findall(part), False
            else:
                found = self.cut.finditer(part)
                while chunk := [m[0] for m in islice(found, CHUNK)]:
                    yield chunk, False

    def ready(self, words: set[str]) -> dict[str, tuple[str, str]]:
        """The cache with all the words in it; long ones leave at the next call."""
        for word in self.passing:
            del self.known[word]
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, words
        self.learn(new, self.known)
        self.passing = [w for w in new if len(w) > CACHE_LENGTH]
        return self.known

    def encoded(self, text: str) -> Iterator[tuple[str, str]]:
        """Ids as text, and the decoded text, chunk by chunk."""
        for words, special in self.pieces(text):
            if special:
                yield str(self.special[words[0]]), self.decode([self.special[words[0]]])
            else:
                yield self.joined(words, self.ready(set(words)))

    @staticmethod
    def joined(words: list[str], known: dict[str, tuple[str, str]]) -> tuple[str, str]:
        found = [known[w] for w in words]
        return ",".join([x[0] for x in found]), "".join([x[1] for x in found])

    def encoded_many(self, texts: list[str]) -> Iterator[Iterable[tuple[str, str]]]:
        """encoded() of each text; the words of short ones are learnt together."""
        short = [len(t) <= CHUNK and not (self.split and self.split.search(t)) for t in texts]
        words = [self.cut.findall(t) if s else [] for t, s in zip(texts, short, strict=True)]
        known = self.ready(set().union(*words)) if texts else {}
        simple = [self.joined(w, known) for w in words]
        for text, is_short, made in zip(texts, short, simple, strict=True):
            yield ([made] if text else []) if is_short else self.encoded(text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encoded(text) for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids' bytes, special tokens as they are; broken characters become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """One tokenizer, with its cache, for each Python worker."""
    return ByteBpe(path)


def encode_table(documents: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """documents(doc_id, text) as doc_id and the outputs, one row per row; null text is empty and has no ids.

    path: a tokenizers-library JSON file that every worker can read. Outputs:
    n_tokens, ids, decoded (the ids decoded again), and the sha256 of the
    comma-joined ids and of the decoded text.
    """

    def make():
        bpe = loaded(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: dict[str, list] = {name: [] for name in outputs}
            for parts in bpe.encoded_many(texts):
                ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
                ids_parts, text_parts = [np.zeros(0, np.int32)], []
                for ids, decoded in parts:
                    ids_hash.update((b"," if count else b"") + ids.encode())
                    text_hash.update(decoded.encode())
                    count += ids.count(",") + 1
                    if "ids" in out:
                        ids_parts.append(np.fromstring(ids, np.int32, sep=","))
                    if "decoded" in out:
                        text_parts.append(decoded)
                made = {"n_tokens": count, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()}
                made |= {"ids": np.concatenate(ids_parts), "decoded": "".join(text_parts)}
                for name in outputs:
                    out[name].append(made[name])
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], TYPES[n][1]) for n in outputs)], names=["doc_id", *outputs])

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, " + ", ".join(f"{n} {TYPES[n][0]}" for n in outputs), chars=1_000_000)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
