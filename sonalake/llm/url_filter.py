"""URL rules held in cascades of Bloom filters.

A cascade answers "is this key listed?" for every key of a known universe
without error and without a join. Level 1 encodes the listed keys; level 2
the keys of the universe that pass level 1 but aren't listed; level 3 the listed
keys that pass level 2; and so on until nothing passes wrongly. A key is
listed if the number of levels that it passes in a row is odd.

Here the keys are rules, as host suffix and path prefix, and the universe is
every suffix and prefix of the corpus's URLs of a length that a rule has. One
cascade holds the blocking rules and one the allowing ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, written

#: The contract's rules, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SEEDS = (1, 2)
#: Bytes of a cascade that are broadcast at most, beyond which keys are dealt into parts; different keys of a part.
FILTER_BYTES, PART_KEYS = 16_000_000, 500_000
LEVELS = 60


@dataclass
class Bloom:
    """Bits in which each key sets or tests `probes` places, found from its two hashes and the level."""

    bits: int
    probes: int
    level: int
    words: np.ndarray = field(repr=False)

    @classmethod
    def sized(cls, keys: int, rate: float, level: int) -> Bloom:
        bits = max(64, math.ceil(keys * math.log(1 / rate) / math.log(2) ** 2))
        return cls(bits, max(1, round(math.log2(1 / rate))), level, np.zeros((bits + 63) // 64, np.uint64))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(self.level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        a, b = mix64(h1 ^ salt), mix64(h2 + salt) | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for at in self.places(h1, h2):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return found


@dataclass
class Cascade:
    levels: list[Bloom]

    @property
    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def depth(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels each key passes before it first fails."""
        depth, alive = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for bloom in self.levels:
            alive = alive[bloom.test(h1[alive], h2[alive])]
            depth[alive] += 1
        return depth

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.depth(h1, h2) % 2 == 1


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", *(F.xxhash64(F.lit(s), F.col("key")).alias(f"h{s}") for s in SEEDS))


def _columns(batch: pa.RecordBatch, names: tuple[str, ...] = ("h1", "h2")) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


def _passing(hashed: DataFrame, bloom: Bloom) -> DataFrame:
    """Rows that a level lets through."""
    shared = hashed.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.test(*_columns(batch))))

    return hashed.mapInArrow(run, hashed.schema)


def _filled(hashed: DataFrame, bloom: Bloom) -> Bloom:
    """The level with all keys set: each task fills its own bits, and they meet by OR in blocks."""
    bits, probes, level = bloom.bits, bloom.probes, bloom.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits, probes, level, np.zeros((bits + 63) // 64, np.uint64))
        for batch in batches:
            own.add(*_columns(batch))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "word": pa.array(own.words[at].view(np.int64))})

    got = hashed.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bloom.words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return bloom


def build_cascade(listed: DataFrame, universe: DataFrame, limit: int = FILTER_BYTES) -> Cascade | None:
    """A cascade exact on universe(key) for listed(key); None if it would exceed the limit of bytes.

    The first level's rate is that of least total size, listed / (sqrt 2 *
    universe); the others' is a half. Null keys are ignored. An empty list
    gives a cascade without levels, in which nothing is listed.
    """
    inside = written(_hashed(listed.where("key IS NOT NULL").distinct()), "listed")
    outside = _hashed(universe.where("key IS NOT NULL"))
    n = inside.count()
    if not n:
        return Cascade([])
    many = max(n, universe.agg(F.approx_count_distinct("key")).first()[0])
    levels: list[Bloom] = []
    include, against = inside, outside
    while n:
        rate = min(0.5, n / (math.sqrt(2) * many)) if not levels else 0.5
        bloom = Bloom.sized(n, rate, len(levels) + 1)
        if sum(x.words.nbytes for x in levels) + bloom.words.nbytes > limit or len(levels) >= LEVELS:
            return None
        levels.append(_filled(include, bloom))
        wrong = _passing(against, bloom)
        if len(levels) == 1:  # the only lookup in the list itself, and only by what passed level 1
            wrong = wrong.join(inside.select("key"), "key", "left_anti").distinct()
        wrong = written(wrong, f"level{len(levels)}")
        include, against, n = wrong, include, wrong.count()
    return Cascade(levels)


def parsed(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) as page_id, host, path, a row for each; both are empty for null or without ://."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), upper, upper.lower()).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def with_probes(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """urls(host, path) with the keys to look up, each with its hashes, longest first; of equal ones the longer host first."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    )
    prefixes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    pairs = F.transform(
        suffixes,
        lambda s: F.transform(
            prefixes,
            lambda n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substr("path", F.lit(1), n)).alias("key")),
        ),
    )
    hashed = F.transform(
        F.sort_array(F.flatten(pairs), asc=False),
        lambda p: F.struct(p["key"].alias("key"), *(F.xxhash64(F.lit(s), p["key"]).alias(f"h{s}") for s in SEEDS)),
    )
    return urls.withColumn("probes", hashed)


def looked_up(urls: DataFrame, cascades: dict[str, Cascade], default: str) -> DataFrame:
    """The first probe of each row that a cascade holds, and that cascade's name; earlier cascades before later ones."""
    shared = urls.sparkSession.sparkContext.broadcast(cascades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*shared.value, default]
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("probes"))
            flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            h1, h2 = (flat.field(f"h{s}").to_numpy(zero_copy_only=False).view(np.uint64) for s in SEEDS)
            which = np.full(len(flat), len(names) - 1)
            for k, cascade in reversed(list(enumerate(shared.value.values()))):
                which[cascade.test(h1, h2)] = k
            hits = np.flatnonzero(which < len(names) - 1)
            row, first = np.unique(np.repeat(np.arange(batch.num_rows), counts)[hits], return_index=True)
            at = np.full(batch.num_rows, -1)
            at[row] = hits[first]
            rule = flat.field("key").take(pa.array(at, mask=at < 0))
            verdict = pa.array([names[which[i]] if i >= 0 else default for i in at], pa.string())
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*kept, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def local_cascade(keys: pa.Array, h1: np.ndarray, h2: np.ndarray, listed: pa.Array) -> Cascade:
    """A cascade exact on these different keys, in memory, for those of them that are listed."""
    inside = np.asarray(pc.is_in(keys, value_set=listed))
    levels: list[Bloom] = []
    include, against = np.flatnonzero(inside), np.flatnonzero(~inside)
    while len(include) and len(levels) < LEVELS:
        rate = min(0.5, len(include) / (math.sqrt(2) * max(1, len(keys)))) if not levels else 0.5
        bloom = Bloom.sized(len(include), rate, len(levels) + 1)
        bloom.add(h1[include], h2[include])
        levels.append(bloom)
        include, against = against[bloom.test(h1[against], h2[against])], include
    if len(include):
        raise RuntimeError("keys can't be told apart by their hashes")
    return Cascade(levels)


def partitioned(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """What looked_up() gives, for lists too long to broadcast: a cascade of its own for each part of the keys by hash.

    A part has about PART_KEYS different keys; its cascades are sent to the
    tasks that look its probes up, which are dealt further by row, so that no
    frequent key meets in one task.
    """
    each = written(urls.withColumn("row", F.monotonically_increasing_id()), "rows")
    names = ("block", "allow")
    probes = each.select("row", F.posexplode("probes").alias("pos", "p")).select("row", "pos", "p.*")
    keys = written(probes.groupBy("key").agg(*(F.first(f"h{s}").alias(f"h{s}") for s in SEEDS)), "universe")
    parts = -(-keys.count() // PART_KEYS) or 1
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(parts)).alias("part")

    def build(universe: pa.Table, listed: pa.Table) -> pa.Table:
        if not universe.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "cascades": pa.array([], pa.binary())})
        columns = [universe.column(f"h{s}").to_numpy().view(np.uint64) for s in SEEDS]
        found = {v: local_cascade(universe.column("key").combine_chunks(), *columns, listed.filter(pc.equal(listed.column("verdict"), v)).column("key").combine_chunks()) for v in names}
        return pa.table({"part": universe.column("part").slice(0, 1), "cascades": pa.array([pickle.dumps(found)], pa.binary())})

    lists = rules.select("key", "verdict").distinct()
    cascades = keys.select("*", part).groupBy("part").cogroup(lists.select("*", part).groupBy("part")).applyInArrow(build, "part long, cascades binary")
    cascades = written(cascades, "cascades")
    salts = -(-probes.count() // (parts * PART_KEYS)) or 1
    dealt = probes.select("*", part, F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    copies = cascades.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def look(asked: pa.Table, own: pa.Table) -> pa.Table:
        columns = [asked.column(f"h{s}").to_numpy().view(np.uint64) for s in SEEDS]
        which = np.full(asked.num_rows, len(names))
        if own.num_rows:
            found = pickle.loads(own.column("cascades")[0].as_py())
            for k, name in reversed(list(enumerate(names))):
                which[found[name].test(*columns)] = k
        hits = pa.array(np.flatnonzero(which < len(names)))
        out = asked.select(["row", "pos", "key"]).take(hits)
        return out.append_column("verdict", pa.array([names[k] for k in which[which < len(names)]], pa.string()))

    hits = dealt.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInArrow(look, "row long, pos int, key string, verdict string")
    hit = hits.groupBy("row").agg(F.min_by(F.struct("key", "verdict"), "pos").alias("hit"))
    out = each.join(hit, "row", "left")
    return out.select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", limit: int = FILTER_BYTES) -> DataFrame:
    """Judges pages(page_id, url) by rules(host, path, verdict): page_id, host, path, rule, verdict, one row per row.

    A rule fits its host and all subdomains where the path starts with its
    path; the longest rule wins, of equally long ones that with the longer
    host, and a block before an allow of the same key. URLs that no rule fits,
    null ones included, are in no cascade: not listed, they get the default.
    Rules with a null host or path are ignored. No rules or no pages are fine.
    Rows that repeat a page_id, or have none, are judged apart; other columns
    don't matter. Lists over the limit of bytes go by partitioned cascades.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('block', 'allow')")
    rules = written(rules.select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("labels")), "rules")
    shape = rules.agg(F.max("labels").alias("labels"), F.array_sort(F.collect_set("n")).alias("lengths")).first()
    urls = written(with_probes(parsed(pages), shape["labels"] or 1, shape["lengths"] or [0]), "probes")
    universe = urls.select(F.explode("probes.key").alias("key"))
    cascades = {v: build_cascade(rules.where(F.col("verdict") == v).select("key"), universe, limit // 2) for v in ("block", "allow")}
    if None in cascades.values():
        return partitioned(urls, rules, default)
    return looked_up(urls, cascades, default)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all pages."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                      ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT u.*, h || q AS rule, coalesce(v, 'allow') AS verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST, length(h) DESC) AS n
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, verdict FROM m WHERE n = 1
"""
