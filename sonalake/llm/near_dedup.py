"""Near duplicates by bottom-k sketches of one hash function.

1. Documents with equal sets of 5-word shingles form a class; from here on only
   classes are compared. A class's sketch is its KEEP smallest shingle hashes.
2. Inverted lists of the retained values give the overlaps. Two classes of
   similarity 0.75 share at least SHARED of the KEEP values of their union's
   sketch (short sets: three quarters of all), so each need only be listed
   under its rarest KEEP - SHARED + 1: passages that many documents share are
   met in no list, unless nearly all of a document consists of them. The
   classes that meet in these lists are listed again by sketches of up to LONG
   values, apart for each pair of size buckets: similar sets of sizes n and m
   share 3/7 (n + m), so they meet under the n - 3/7 (n + m) + 1 rarest values.
   Only these lists are used. Copies of one text that were edited too much to be
   similar to each other mostly don't meet in them.
3. In a list, all are compared with one centre, and the linked ones become one
   component; further rounds take other centres; a last round compares every
   member with all members of other components. No pair inside a component is
   made, and no link between components is missed.
4. Pairs pass if the sketch of their union shares SHARED values; then the exact
   similarity of their full sets decides.
5. Components are labelled by minimum propagation with pointer jumping.

With binomial tails the chance that a pair of similarity 0.75 shares fewer than
24 of 64 or 678 of 1024 is below 1e-9; sets of at most 64 shingles are certain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, mix64, one_each, packed, sized, without, words_of, written

SHINGLE, KEEP, SHARED, PERCENT = 5, 64, 24, 75
LONG, LONG_SHARED = 1024, 678
#: Ratio of the bounds of a size bucket, and how many buckets away sets can be similar.
BUCKET, STEPS = 1.1, 4
#: Centres of the lists in each round before the last.
ROUNDS = (range(0, 1), range(1, 9))
#: Words whose hash a task remembers, members of a centre that share one copy of its set, rows broadcast at most.
CACHE_WORDS, MEMBERS, ROWS, HOT = 200_000, 64, 200_000, 1024
#: Pairs of a list from which on each is made only under its first key.
HEAVY = 1024


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hash of each word; a long text goes through in chunks."""
    if not text or len(text) < 4_000_000:
        return hashes.of(words_of(text))
    found = re.finditer(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "surrogatepass").lower())
    parts = []
    while chunk := [m[0] for m in islice(found, 200_000)]:
        parts.append(hashes.of(chunk))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the 5-word shingles; fewer words are one shingle."""
    if not len(words):
        return np.zeros(0, np.int64)
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    made = np.full(count, width, np.uint64)
    for k in range(width):
        made = mix64(made) + words[k : k + count]
    return np.unique((mix64(made) >> np.uint64(1)).view(np.int64))


def node_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), n (shingles), node (digest of the set; null for none), sketch (its smallest hashes)."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(word_hashes(t, hashes)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array(map(node_of, sets), pa.binary()),
                    pa.array([s[:KEEP] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "tag", "n", "node", "sketch"],
            )

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    return map_batches(rows, "text", make, f"doc_id {kind}, tag long, n long, node binary, sketch array<long>")


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and whole set, for wanted(id, node, rep): only documents with a rep's id are read again."""
    reps = wanted.select("rep").distinct()
    reps = sized(reps, reps.count(), ROWS)
    some = documents.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for t in batch.column(1).to_pylist() if len(s := shingle_set(word_hashes(t, hashes)))]
            return pa.RecordBatch.from_arrays(
                [pa.array(map(node_of, sets), pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

        return step

    found = map_batches(some, "text", make, "node binary, shingles array<long>")
    return written(found.join(wanted.select("id", "node"), "node").select("id", "shingles").dropDuplicates(["id"]), "sets")


def ranked_values(sketches: DataFrame) -> DataFrame:
    """id, m, value, place: values of sketches(id, sketch) that two have, and their places from rarest to commonest of the m."""
    values = sketches.select("id", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = Window.partitionBy("id")
    alone = F.col("m") - F.count(F.lit(1)).over(mine)
    place = alone + F.row_number().over(mine.orderBy("df", "value"))
    return values.join(often, "value").select("id", "m", "value", place.alias("place"))


def meeting_nodes(sketches: DataFrame) -> DataFrame:
    """The ids that meet another under one of their rarest retained values."""
    need = F.when(F.col("m") >= SHARED * 4 // 3, F.lit(SHARED)).otherwise(F.ceil(F.col("m") * PERCENT / 100))
    lists = written(ranked_values(sketches).where(F.col("place") <= F.col("m") - need + 1).select("value", "id"), "lists")
    return lists.join(lists.groupBy("value").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "value").select("id").distinct()


def size_lists(sets: DataFrame) -> DataFrame:
    """key, id, side, pair, place, n: inverted lists by value and pair of size buckets; side -1 meets all, 0 and 1 meet each other.

    Sets over LONG are truncated and meet each other, and those that can be as
    similar, in a list of their own under LONG_SHARED common values.
    """
    size = F.size("shingles")
    bucket = F.floor(F.log(size.cast("double")) / F.log(F.lit(BUCKET)) + 1e-9).cast("int")
    values = ranked_values(sets.select("id", F.slice("shingles", 1, LONG).alias("sketch")))
    values = values.join(sets.select("id", size.alias("n"), bucket.alias("own")), "id")
    n, own = F.col("n"), F.col("own")
    other = F.col("other")
    least = F.greatest(F.floor(F.pow(F.lit(BUCKET), other)), F.ceil(n * PERCENT / 100))
    common = F.ceil((n + least) * PERCENT / (100 + PERCENT) - 1e-6)
    by_size = values.where(n <= LONG).withColumn("other", F.explode(F.sequence(own - STEPS, own + STEPS))).where(F.col("place") <= n - common + 1)
    pair = F.xxhash64(F.least(own, other), F.greatest(own, other))
    side = F.when(own == other, -1).when(own < other, 0).otherwise(1)
    by_size = by_size.select("id", "n", "place", "value", pair.alias("pair"), side.alias("side"))
    long = values.where((n > LONG * PERCENT // 100) & (F.col("place") <= F.col("m") - LONG_SHARED + 1))
    long = long.select("id", F.lit(None).cast("int").alias("n"), "place", "value", F.xxhash64(F.lit("long")).alias("pair"), F.lit(-1).alias("side"))
    return by_size.union(long).select(F.xxhash64("value", "pair").alias("key"), "id", "side", "pair", "place", "n")


def attached(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with a column of both, as x of a and y of b; a node in many pairs gets a copy for each MEMBERS of them.

    Only the nodes with copies, one for MEMBERS pairs at most, are sent to the
    pairs: no task gathers the pairs of one node.
    """
    copies = (F.floor(F.count(F.lit(1)) / MEMBERS) + 1).alias("copies")
    many = written(pairs.groupBy("a").agg(copies).where("copies > 1"), "copies")
    few = sized(many, many.count(), ROWS)
    salted = pairs.join(few, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1).cast("long"))).alias("salt"))
    centre = rows.select(F.col("id").alias("a"), F.col(column).alias("x")).join(few, "a", "left")
    centre = centre.select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("salt"))
    return salted.join(rows.select(F.col("id").alias("b"), F.col(column).alias("y")), "b").join(centre, ["a", "salt"]).select("a", "b", "x", "y")


def likely(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sketches allow similarity 0.75; whole sets in both are decided here."""
    union, times = np.unique(np.concatenate([x, y]), return_counts=True)
    if len(x) < KEEP and len(y) < KEEP:
        return int((times == 2).sum()) * 100 >= PERCENT * len(union)
    return int((times[:KEEP] == 2).sum()) >= SHARED


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def linked(rows: DataFrame) -> DataFrame:
    """a, b of the rows whose sets x and y are similar: those whose sketches allow it are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (fx, ox), (fy, oy) = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(2), batch.column(3))]
            pairs = [(fx[ox[i] : ox[i + 1]], fy[oy[i] : oy[i + 1]]) for i in range(batch.num_rows)]
            keep = [likely(x[:KEEP], y[:KEEP]) and similar(x, y) for x, y in pairs]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp (the smallest id that links(a, b) reach) of every linked class."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "label")
    while True:
        near = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = label.join(near, label["id"] == near["a"]).select("id", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        jump = label.select(F.col("id").alias("low"), F.col("comp").alias("root"))
        nxt = lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("root", "low")).alias("comp"), "old")
        nxt = written(nxt, "label")
        if nxt.where("comp <> old").isEmpty():
            return nxt.select("id", "comp")
        label = nxt.select("id", "comp")


def members_of(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """The lists that more than one component has members in, with each member's component."""
    if label is None:
        return members.withColumn("comp", F.col("id"))
    label = sized(label, label.count(), ROWS)
    each = members.drop("comp").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = each.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return each.join(several, "key", "left_semi")


def centre_pairs(members: DataFrame, turns: range) -> DataFrame:
    """Each member with its list's centres, one for each turn, where they are of other components."""
    best = [F.min(F.struct(F.xxhash64(F.lit(t), F.col("id")).alias("h"), "id", "comp", "side")) for t in turns]
    each = members.join(members.groupBy("key").agg(F.array(*best).alias("cs")), "key").withColumn("c", F.explode("cs"))
    each = each.where("comp <> c.comp AND (side = -1 OR side <> c.side)")
    return each.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def cross_pairs(members: DataFrame) -> DataFrame:
    """Each member that isn't of its list's largest component with all members of other components.

    In lists that make many pairs, a pair is made only under the first key that
    both have, and only if what follows that key can still suffice; so it is
    made once, not for each key that the two share.
    """
    size = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    shape = size.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.sum("k").alias("all"), F.max("k").alias("most"))
    shape = shape.select("key", "largest", (F.col("all") * (F.col("all") - F.col("most")) > HEAVY).alias("heavy"))
    each = written(members.join(shape, "key"), "shaped")
    differ = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.side") == -1) | (F.col("x.side") != F.col("y.side")))
    light, heavy = each.where("NOT heavy"), each.where("heavy")
    pairs = light.where("comp <> largest").alias("x").join(light.alias("y"), differ).select("x.id", F.col("y.id").alias("other"))
    keys = each.groupBy("id", "pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda s: s["key"]).alias("keys"))
    heavy = heavy.join(keys, ["id", "pair"]).withColumn("before", F.expr("slice(keys, 1, cast(array_position(keys, key) AS INT) - 1)")).drop("keys")
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    enough = F.coalesce(rest * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT, F.lit(True))
    first = differ & enough & ~F.arrays_overlap("x.before", "y.before")
    pairs = pairs.union(heavy.where("comp <> largest").alias("x").join(heavy.alias("y"), first).select("x.id", F.col("y.id").alias("other")))
    return pairs.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()


def linked_components(documents: DataFrame, classes: DataFrame) -> DataFrame | None:
    """id, comp of the classes that some link reaches; None without candidates."""
    wanted = written(meeting_nodes(classes).join(classes.select("id", "node", "rep"), "id"), "wanted")
    if wanted.isEmpty():
        return None
    sets = full_sets(documents, wanted)
    members = written(size_lists(sets), "size_lists")
    links, label = None, None
    for turn in range(len(ROUNDS) + 1):
        members = members_of(members, label)
        if turn:
            members = written(members, f"members{turn}")
            if members.isEmpty():
                break
        pairs = written(centre_pairs(members, ROUNDS[turn]) if turn < len(ROUNDS) else cross_pairs(members), f"pairs{turn}")
        found = written(linked(attached(pairs, sets, "shingles")), f"links{turn}")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            label = components(links)
    return label


def near_duplicates(documents: DataFrame, tagged: bool = False) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are compared as sets of 5-word shingles, words lower-cased in A-Z;
    fewer words are one shingle. Rows without words, or with null text, have
    no shingle and are linked with nothing. component_id is the smallest doc_id
    that links of similarity 0.75 or more reach. A row without doc_id is never
    a component's id: it counts as kept only where its component has no id at
    all. Rows that repeat a doc_id are compared like any others; tagged adds a
    hash of the text as tag, to tell them apart.
    """
    rows = written(signatures(documents), "signatures")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    label = linked_components(documents, classes)
    slim = classes.select("id", "node", "rep", "size")
    if label is None:
        owner = slim.where("size > 1").select("node", F.col("rep").alias("component_id"), "size")
    else:
        each = label.join(slim, "id")
        lowest = each.groupBy("comp").agg(F.min("rep").alias("component_id"))
        linked = each.join(lowest, "comp").select("node", "component_id")
        owner = slim.join(linked, "node", "left").where("size > 1 OR component_id IS NOT NULL")
        owner = owner.select("node", F.coalesce("component_id", "rep").alias("component_id"), "size")
    owner = written(owner, "owners")
    total = slim.agg(F.sum("size")).first()[0] or 0
    hot = owner.where(F.col("size") > total / HOT).select("node", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    rest = owner.where(F.col("size") <= total / HOT).select("node", "component_id", F.lit(True).alias("owned"))
    split = rows.select("doc_id", "tag", "n", "node").join(F.broadcast(hot), "node", "left")
    done = split.where("hot").select("doc_id", "tag", "n", F.col("hot_id").alias("component_id"))
    cold = split.where("hot IS NULL").join(rest, "node", "left")
    cold = cold.select("doc_id", "tag", "n", F.when(F.col("owned"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = done.union(cold).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept"), "tag")
    return out if tagged else out.drop("tag")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """documents with one document of each component, the one whose doc_id names it; near_duplicates() says what null ids do.

    Of rows that repeat both doc_id and text one stays. All columns are kept,
    whatever their names; an empty table stays empty.
    """
    found = written(near_duplicates(documents, True), "near")
    lost = written(found.where("NOT kept").select("doc_id", "tag").distinct(), "lost")
    row = packed(documents, F.xxhash64("text").alias("tag"))
    left = without(row, lost, ["doc_id", "tag"])
    return one_each(left, found.where("kept").select("doc_id", "tag"), ["doc_id", "tag"]).select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
