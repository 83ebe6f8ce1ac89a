"""License texts found by MinHash bands over overlapping windows of words.

Templates are grouped by size, in steps of a quarter. For each group a document
is cut into windows of one and a half times that size, so that every place where
a template may stand lies wholly in some window. Windows and templates that
agree in one band of their MinHash signatures are candidates. In the stretches
that candidate windows cover, copies are told apart by the order of their
shingles, and the exact containment of the template's shingles decides.

A group's size is up to 1.25 times a template's, so a window has at most 1.875
shingles for each of the template's: one that contains it has similarity 0.53 or
more with it, one that has the least PERCENT of it 0.385 or more. They agree in a
band with probability 1 - (1 - s**ROWS)**BANDS: over 0.99997 and 0.993.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, mix64
from .license_texts import TEMPLATES

#: Words of a shingle, bands and values in each, containment that is a match.
SHINGLE, BANDS, ROWS, PERCENT = 3, 32, 2, 80
#: Ratio of the sizes of neighbouring groups.
STEP = 1.25
#: Shingles that a copy may go back in its template's order before it counts as the next copy.
BACK = 8
SEED, CACHE_WORDS = 77, 200_000
PATTERN = "[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*"
WORD, PLACES = re.compile(PATTERN.encode()), re.compile(PATTERN)


def words_in(text: str) -> list[bytes]:
    """Lower-cased words; punctuation and layout don't count. Only ASCII matters, so places in the text are those of PLACES."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the shingle at each word but the last ones."""
    count = max(0, len(words) - SHINGLE + 1)
    made = np.zeros(count, np.uint64)
    for k in range(SHINGLE):
        made = mix64(made) + words[k : k + count]
    return mix64(made)


@dataclass
class Template:
    name: str
    order: np.ndarray
    shingles: np.ndarray
    bands: np.ndarray

    def copies(self, marks: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(first, last, containment) of the copies among the places `at` of marks that have one of the template's shingles.

        A copy ends where the template's order starts again, or after half a
        template of other text. If no such run has enough of the template but
        all within one template's length together do, they are a match whatever
        their order.
        """
        offsets: dict[int, list[int]] = {}
        for k, mark in enumerate(self.order.tolist()):
            offsets.setdefault(mark, []).append(k)
        size, need, runs = len(self.shingles), PERCENT * len(self.shingles), []
        reach, last, seen, start, end = len(self.order) // 2 + SHINGLE, -1, set(), -1, -1
        for i in at.tolist():
            mark = int(marks[i])
            ahead = [k for k in offsets[mark] if k > last - BACK]
            if seen and (not ahead or i - end > reach or (mark in seen and len(offsets[mark]) == 1)):
                runs.append((start, end, seen))
                seen, last, ahead = set(), -1, offsets[mark]
            if not seen:
                start = i
            last, end = max(last, min(ahead, key=lambda k: abs(k - last - 1))), i
            seen.add(mark)
        if seen:
            runs.append((start, end, seen))
        found = [(a, b, len(s) / size) for a, b, s in runs if 100 * len(s) >= need]
        if not found and len(runs) > 1:
            limit, k, counts = len(self.order) * 3 // 2, 0, {}
            places = at.tolist()
            for j, i in enumerate(places):
                counts[int(marks[i])] = counts.get(int(marks[i]), 0) + 1
                while i - places[k] >= limit:
                    m = int(marks[places[k]])
                    counts[m] -= 1
                    if not counts[m]:
                        del counts[m]
                    k += 1
                if 100 * len(counts) >= need:
                    found.append((places[k], i, len(counts) / size))
                    k, counts = j + 1, {}
        return found


def salts() -> np.ndarray:
    return mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(SEED))


def band_keys(minima: np.ndarray) -> np.ndarray:
    """(…, BANDS) keys from (…, BANDS * ROWS) minima."""
    parts = minima.reshape(*minima.shape[:-1], BANDS, ROWS)
    made = np.zeros(parts.shape[:-1], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        made = mix64(made) + parts[..., k]
    return mix64(made)


class Scanner:
    """Templates by size: those of one size share their windows."""

    def __init__(self, templates: dict[str, str]):
        self.hashes, self.groups = Hashes(), {}
        tell: dict[int, list[np.ndarray]] = {}
        for name, text in sorted(templates.items()):
            order = shingles(self.hashes.of(words_in(text)))
            marks = np.unique(order)
            if len(marks):
                least = np.array([marks[mix64(marks ^ s).argmin()] for s in salts()])
                minima = mix64(least ^ salts())
                size = math.ceil(STEP ** math.ceil(math.log(len(marks), STEP) - 1e-9))
                self.groups.setdefault(size, []).append(Template(name, order, marks, band_keys(minima)))
                tell.setdefault(size, []).append(least)
        self.tell = {size: np.unique(np.concatenate(x)) for size, x in tell.items()}
        self.any = np.unique(np.concatenate([*self.tell.values(), np.zeros(0, np.uint64)]))

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, containment) of each match; places in code points."""
        marks = shingles(self.hashes.of(words_in(text)))
        # A band can only agree where a template's least shingles are: windows without any need no signature.
        if not among(marks, self.any).any():
            return []
        found, places = [], []
        for size, templates in self.groups.items():
            told = np.flatnonzero(among(marks, self.tell[size]))
            if not len(told):
                continue
            step = -(-size // 2)
            starts = np.arange(0, max(1, len(marks) - step), step)
            first = np.maximum(0, -(-(told - size - step + 1) // step))
            last = np.minimum(len(starts) - 1, told // step)
            live = np.unique(np.concatenate([np.minimum(first + k, last) for k in range(int((last - first).max()) + 1)]))
            keys = band_keys(np.stack([window_minima(mix64(marks ^ s), starts[live], size + step) for s in salts()], 1))
            for t in templates:
                hits = live[(keys == t.bands).any(1)]
                if not len(hits):
                    continue
                mine = np.flatnonzero(among(marks, t.shingles))
                for stretch in np.split(hits, np.flatnonzero(np.diff(hits) > 3) + 1):
                    inside = mine[np.searchsorted(mine, starts[stretch[0]]) : np.searchsorted(mine, starts[stretch[-1]] + size + step)]
                    for i, j, share in t.copies(marks, inside):
                        places = places or [m.span() for m in PLACES.finditer(text)]
                        found.append((t.name, places[i][0], places[j + SHINGLE - 1][1], share))
        return sorted(found, key=lambda f: (f[1], f[0], f[2]))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not len(values) or not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def window_minima(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Least value in each window, the last ones cut off at the end."""
    padded = np.concatenate([values, np.full(size, np.iinfo(np.uint64).max, np.uint64)])
    view = np.lib.stride_tricks.sliding_window_view(padded, size)
    return np.concatenate([view[starts[i : i + 4096]].min(1) for i in range(0, len(starts), 4096)])


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, start, end, containment: a row for each match in documents(doc_id, text).

    Places are code points, end exclusive. Null and empty texts match nothing;
    rows that repeat a doc_id are scanned apart, texts whole, however long, and
    other columns don't matter. Every copy of a template in a text is a match; a
    template that stands in a longer one matches there too. Templates of fewer words than a
    shingle can't be found and are ignored.
    """
    chosen = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(chosen)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for match in scanner.scan(text) if text else ():
                    ids.append(k)
                    rows.append(match)
            if not rows:
                return None
            name, start, end, share = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids)), pa.array(name), pa.array(map(int, start), pa.int64()), pa.array(map(int, end), pa.int64()), pa.array(map(float, share), pa.float64())],
                names=["doc_id", "template", "start", "end", "containment"],
            )

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, template string, start long, end long, containment double", chars=2_000_000)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match of a template in a document, containment rounded to six digits."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_licenses(documents)
    return found.select("doc_id", "template", "start", "end", F.round("containment", 6).alias("containment"))
