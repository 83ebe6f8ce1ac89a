"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words, A-Z lower-cased and freed of punctuation at their ends,
and their leading characters; each is hashed to one of 2**BITS buckets. All
buckets are in the machine: it learns a weight and a vector for each, so that
pairs of terms count as pairs. A term's value is FLOOR plus how far its share of
toxic training rows lies from the common one: terms that are neutral alone have
the least value, not none, so that a pair of them can still tell. The score is
the logistic function of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, words_of, written

#: Bits of a term's hash, leading characters that are terms, and labelled rows that the fit takes at most.
BITS, PREFIXES, SAMPLE = 18, (4, 5, 6), 20_000
FACTORS, EPOCHS, BATCH, RATE, PAIR_RATE, DECAY, SPREAD, SEED = 4, 6, 64, 0.2, 0.1, 1e-3, 0.02, 11
#: Least value of a term, deviations of its toxic share that give the value 1.
FLOOR, FULL_Z = 0.05, 10.0
#: Words whose terms a task remembers, characters that it scores at once.
CACHE_WORDS, CHARS = 120_000, 2_000_000
FOLDS = 5
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TermsOf(dict):
    """The buckets of each word; a word of punctuation alone has none."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        mask, core = (1 << BITS) - 1, word.strip(PUNCTUATION)
        text = core.decode("utf-8", "replace")
        terms = (zlib.crc32(core) & mask, *(zlib.crc32(b"^%d" % n + text[:n].encode()) & mask for n in PREFIXES if len(text) > n)) if core else ()
        self[word] = terms
        return terms

    def of(self, text: str | None) -> set[int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        return set().union(*map(self.__getitem__, set(words_of(text))))


@dataclass
class FactorizationMachine:
    bias: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32), repr=False)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32), repr=False)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, FACTORS), np.float32), repr=False)

    def parts(self, flat: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and each row's sums of its terms' vectors; flat: buckets of all rows, owner: their rows."""
        x = self.values[flat].astype(float)
        logits, sums = self.bias + np.bincount(owner, self.weights[flat] * x, rows), np.empty((rows, FACTORS))
        for f in range(FACTORS):
            v = self.vectors[flat, f] * x
            sums[:, f] = np.bincount(owner, v, rows)
            logits += (sums[:, f] ** 2 - np.bincount(owner, v * v, rows)) / 2
        return logits, sums

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return logistic(self.parts(*flattened(rows), len(rows))[0])

    def fit(self, flat: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
        """Gradient steps on the logistic loss, in a fixed order of batches, the rate falling to a tenth; weights decay.

        flat has the buckets of all rows one after the other, counts how many each row has.
        """
        rng, size, rows = np.random.default_rng(SEED), 1 << BITS, len(counts)
        share = float(np.clip(labels.mean() if rows else 0.0, 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        first, seen_in, toxic = np.cumsum(counts) - counts, np.zeros(size), np.zeros(size)

        def batch(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = counts[at]
            return flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], np.repeat(np.arange(len(at)), n)

        for start in range(0, rows, 1024):
            own, owner = batch(np.arange(start, min(start + 1024, rows)))
            seen_in += np.bincount(own, minlength=size)
            toxic += np.bincount(own, labels[start + owner], size)
        z = np.abs(toxic - seen_in * share) / np.sqrt(seen_in * share * (1 - share) + 1e-9)
        values = FLOOR + (1 - FLOOR) * np.minimum(1, z / FULL_Z) ** 2
        weights, vectors = np.zeros(size), rng.normal(0, SPREAD, (size, FACTORS))
        self.values, self.weights, self.vectors = values, weights, vectors
        step, steps = 0, EPOCHS * -(-rows // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(rows)
            for start in range(0, rows, BATCH):
                at = order[start : start + BATCH]
                own, owner = batch(at)
                slow, step = 1 - 0.9 * step / steps, step + 1
                logits, sums = self.parts(own, owner, len(at))
                slope = logistic(logits) - labels[at]
                seen, place = np.unique(own, return_inverse=True)
                x = values[own]
                pull = slope[owner] * x
                weights *= 1 - DECAY * slow
                weights[seen] -= slow * RATE * np.bincount(place, pull, len(seen))
                grad = [np.bincount(place, pull * (sums[owner, f] - vectors[own, f] * x), len(seen)) for f in range(FACTORS)]
                vectors *= 1 - DECAY * slow
                vectors[seen] -= slow * PAIR_RATE * np.clip(np.stack(grad, 1), -1, 1)
                self.bias -= slow * RATE / 10 * float(slope.mean())
        self.values, self.weights, self.vectors = (a.astype(np.float32) for a in (values, weights, vectors))
        return self


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def flattened(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((t for r in rows for t in r), np.int64, int(counts.sum()))
    return flat, np.repeat(np.arange(len(rows)), counts)


def training_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic (0 or 1) of labelled documents outside the held-out fold: at most about `sample`, by a hash of the id.

    A doc_id with several labels is toxic if any says so; null labels and ids
    are left out. Label columns with names of document columns don't matter.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = written(marks.where(crc_mod("doc_id", FOLDS) != 0), "marks")
    total = marks.count()
    if total > sample:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(1e6 * sample / total)))
    marks = F.broadcast(marks) if min(total, sample) <= 4 * SAMPLE else marks
    return written(documents.select("doc_id", "text").join(marks, "doc_id"), "training")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fits on training_rows(); without labels of both kinds the model knows the share of toxic rows only.

    The driver gets the buckets of at most about `sample` rows, four bytes for
    each different term of a row.
    """
    rows = training_rows(documents, labels, sample)

    def make():
        terms_of = TermsOf()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.array(sorted(terms_of.of(t)), np.int32) for t in batch.column(1).to_pylist()]
            tie = [zlib.crc32(f.tobytes()) for f in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tie, pa.int64()), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "tie", "terms", "toxic"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = map_batches(rows, "text", make, f"doc_id {kind}, tie long, terms array<int>, toxic int", CHARS).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("tie", "ascending")])  # the same fit wherever the rows lay
    terms = got.column("terms").combine_chunks()
    return FactorizationMachine().fit(terms.flatten().to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64), got.column("toxic").to_numpy().astype(float))


def scored(documents: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score of documents(doc_id, text), one row per row.

    Null and empty texts get the score of no terms. Equal texts score alike,
    whatever their ids; a text counts whole, each of its terms once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        terms_of = TermsOf()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sorted(terms_of.of(t)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(found), pa.float64())], names=["doc_id", "score"])

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, score double", CHARS)


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents that score below the threshold, with all their columns; rows without doc_id are scored like others."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def make():
        model = shared.value
        terms_of = TermsOf()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return batch.filter(pa.array(model.score([sorted(terms_of.of(t)) for t in texts]) < threshold))

        return step

    return map_batches(documents, "text", make, documents.schema, CHARS)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, by a model that never saw the held-out fold; a null doc_id isn't held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (crc_mod("doc_id", FOLDS) == 0).alias("held_out")
    return scored(documents, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
