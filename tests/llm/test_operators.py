"""Small cases of each operator: nulls, empty tables, ties, repeated rows, clashing columns; and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonalake.llm import ann, bpe, exact_dedup, license_scan, lm, mixing, near_dedup, pii, toxicity, url_filter

from ..compare import by_sql, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("th", "er", "an", "on", "re", "st") for b in ("a", "e", "in", "ou", "ly", "sh")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0 if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    return docs(spark, [(1, None, "a"), (2, "", None), (3, "x " * 30000, "b"), (4, "Same  text\there", "a"), (4, "Same  text\there", "a"), (None, "Same text here", "a"), (5, "same text here", None), (None, None, None), (5, "other", "b")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


class TestExactDedup:
    def test_null_and_repeated(self, odd):
        got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(odd).collect()}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[(4, digest("Same text here"))]["group_size"] == 3 and got[(4, digest("Same text here"))]["kept"]
        assert not got[(None, digest("Same text here"))]["kept"]
        assert got[(1, digest(""))]["kept"] and not got[(2, digest(""))]["kept"] and not got[(None, digest(""))]["kept"]
        assert exact_dedup.exact_groups(odd).count() == odd.count()

    def test_stage_keeps_columns(self, odd, none):
        got = exact_dedup.drop_exact_duplicates(odd.withColumn("text_sha256", F.lit("clash")).withColumn("keep_id", F.lit(0)))
        assert got.columns[-2:] == ["text_sha256", "keep_id"] and got.count() == 5
        assert exact_dedup.drop_exact_duplicates(none).count() == 0

    def test_repeated_rows_leave_one(self, spark):
        rows = docs(spark, [(7, "a  b c d e f", "x")] * 5 + [(None, "a b c d e f", "x")] * 3 + [(8, "other words of another text here", "y")] * 2).withColumn("row", F.lit(1)).withColumn("key_doc_id", F.lit(2))
        for stage in (exact_dedup.drop_exact_duplicates, near_dedup.drop_near_duplicates):
            got = stage(rows)
            assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [7, 8]

    def test_heavy_digests_are_found(self, spark):
        rng = random.Random(1)
        keys = ["hot"] * 300 + [str(rng.randrange(10**6)) for _ in range(600)]
        rng.shuffle(keys)
        df = spark.createDataFrame([(k.encode(),) for k in keys], "digest binary").repartition(5)
        found = {bytes(r[0]) for r in exact_dedup.heavy_digests(df, 8).collect()}
        assert b"hot" in found and len(found) <= 8

    def test_hot_group_equals_sql(self, spark, data):
        same(exact_dedup.op2_exact_dedup(spark, data).toPandas(), by_sql(exact_dedup.ORACLE, data))


class TestMixing:
    def test_equals_sql(self, spark, data):
        same(mixing.op5_mixing(spark, data).toPandas(), by_sql(mixing.ORACLE, data))

    def test_bounds(self, spark, odd, none):
        got = mixing.mix(odd).toPandas()
        assert len(got) == odd.count() and (got["taken"] <= 2 * got["size"]).all()
        assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0

    def test_null_and_repeated_ids_come_near_their_targets(self, spark):
        rows = docs(spark, [(None, "a b c", "a")] * 300 + [(5, f"w{i} b c", "b") for i in range(90)] + [(i, "a b c", "c") for i in range(60)])
        rows = rows.repartition(7).withColumn("plan_source", F.lit(1)).withColumn("row", F.lit(2)).withColumn("hash", F.lit(3))
        for _ in range(2):
            got = mixing.mix(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
            assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= 1.5 for r in got)
        half = mixing.mixed_rows(rows, share=0.5, repeat=1.0)
        assert half.columns == rows.columns and half.count() == pytest.approx(225, abs=2)

    def test_sources_in_ranges(self, spark):
        names = [None, *(f"s{i:03d}" for i in range(100)), "é", "Z", ""]
        got = mixing.ranked_sources(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(9)).collect()
        assert {r["source"]: r["place"] for r in got} == {n: i for i, n in enumerate([*sorted(n for n in names if n is not None), None])}

    def test_budgets_are_nested(self, spark):
        rng = random.Random(2)
        df = docs(spark, [(i, prose(rng, rng.randrange(1, 60)), "hot" if i % 3 else str(i % 5)) for i in range(400)])
        small = {r["doc_id"] for r in mixing.mixed_rows(df, share=0.3, repeat=1.0).collect()}
        large = {r["doc_id"] for r in mixing.mixed_rows(df, share=0.4, repeat=1.0).collect()}
        assert small and small <= large and mixing.mixed_rows(df, share=0.4, repeat=1.0).columns == df.columns

    def test_rows_repeat_as_taken(self, spark):
        df = docs(spark, [(i, "a b c d", str(i % 4)) for i in range(40)]).withColumn("copies", F.lit(1)).withColumn("below", F.lit(1))
        taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
        assert mixing.mixed_rows(df).count() * 4 == taken

    def test_many_sources_are_salted(self, spark, monkeypatch):
        df = docs(spark, [(i, "a b c", None if i % 7 == 0 else str(i % 7)) for i in range(70)])
        want = mixing.mix(df).toPandas()
        monkeypatch.setattr(mixing, "SOURCE_ROWS", 0)
        same(mixing.mix(df).toPandas(), want)


class TestUrlFilter:
    def test_equals_sql(self, spark, data):
        same(url_filter.op3_url_filters(spark, data).toPandas(), by_sql(url_filter.ORACLE, data))

    def test_odd_urls(self, spark):
        urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/en/12?x#y", "a://b://c.org/", "http://org", "http://xorg/", "http://.org/", "http://a.example.org/es/#", "x://example.org?q=/es/"]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
        assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.org/en/1", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("org/", "allow"), 9: ("example.org/es/", "block"), 10: (None, "allow")}
        assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
        assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)

    def test_repeated_null_and_long(self, spark):
        pages = spark.createDataFrame([(1, "http://a.org/x", "c"), (1, "http://a.org/x", "c"), (None, "http://a.com/de/", "c"), (2, "http://" + "a." * 20_000 + "com/de/" + "y" * 100_000, "c")], "page_id long, url string, probes string")
        rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
        for limit in (url_filter.FILTER_BYTES, 1):
            got = url_filter.filter_urls(pages, rules, limit=limit).collect()
            assert sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in got) == [("1", "org/", "allow"), ("1", "org/", "allow"), ("2", "com/de/", "block"), ("None", "com/de/", "block")]

    def test_cascade_is_exact_and_parts_agree(self, spark, monkeypatch):
        monkeypatch.setattr(url_filter, "PART_KEYS", 300)
        universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
        listed = universe.where("crc32(key) % 50 = 0")
        cascade = url_filter.build_cascade(listed, universe)
        h = url_filter._hashed(universe).toPandas()
        got = set(h["key"][cascade.test(h["h1"].to_numpy().view(np.uint64), h["h2"].to_numpy().view(np.uint64))])
        assert len(cascade.levels) > 1 and got == {r[0] for r in listed.collect()}
        pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 9, F.lit(".org/p"), F.col("id")).alias("url"))
        rules = spark.createDataFrame([(f"h{k}.org", f"/p{k}", "block") for k in range(9)], "host string, path string, verdict string")
        same(url_filter.filter_urls(pages, rules, limit=1).toPandas(), url_filter.filter_urls(pages, rules).toPandas())


class TestBpe:
    def test_equals_library(self):
        from tokenizers import Tokenizer

        library, own = Tokenizer.from_file(bpe.tokenizer_path()), bpe.ByteBpe(bpe.tokenizer_path())
        rng = random.Random(3)
        pool = [*" \n\t'sabcd", " ", "é", "中", "1", "²", "<|endoftext|>", "...", "'ll", "😀", "​"]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(800)] + ["ab" * 3000, "x" * 255, "y" * 256, " " * 999]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text) == want.ids
            assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False) == text

    def test_table(self, spark, odd, none):
        got = bpe.encode_table(odd, bpe.tokenizer_path(), tuple(bpe.TYPES)).toPandas()
        assert len(got) == odd.count() and got["n_tokens"].tolist() == [len(i) for i in got["ids"]]
        assert sorted(got["decoded"]) == sorted(r[0] or "" for r in odd.select("text").collect())
        assert all(hashlib.sha256(",".join(map(str, i)).encode()).hexdigest() == h for i, h in zip(got["ids"], got["ids_sha256"], strict=True))
        assert bpe.encode_table(none, bpe.tokenizer_path()).count() == 0


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


class TestNearDedup:
    def brute(self, rows):
        sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                    a, b = comp[i], comp[j]
                    comp = [b if c == a else c for c in comp]
        least = collections.defaultdict(list)
        for (k, _), c in zip(rows, comp, strict=True):
            least[c].append(k)
        return {k: (len(s), min(least[c])) for (k, _), s, c in zip(rows, sets, comp, strict=True)}

    def test_against_all_pairs(self, spark):
        rng = random.Random(4)
        texts = []
        shared = prose(rng, 60)
        for _ in range(30):
            base = prose(rng, rng.choice([3, 6, 12, 40, 150, 400])).split()
            texts.append(" ".join(base))
            for _ in range(rng.randrange(6)):
                w = list(base)
                for _ in range(rng.randrange(1 + len(w) // 25)):
                    w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
                texts.append(" ".join(w))
        texts += [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(30)] + [texts[0], "", " \n"]
        rng.shuffle(texts)
        rows = list(enumerate(texts, 10))
        got = near_dedup.near_duplicates(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")).collect()
        want = {k: (n, k if n == 0 else c) for k, (n, c) in self.brute(rows).items()}
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want

    def test_large_group_of_near_copies(self, spark):
        rng = random.Random(5)
        base = prose(rng, 120).split()
        rows = []
        for k in range(150):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == self.brute(rows)

    def test_odd_rows(self, odd, none):
        got = near_dedup.near_duplicates(odd).collect()
        by = collections.defaultdict(set)
        for r in got:
            by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
        assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[4] == {(1, 4, True)} and by[5] == {(1, 4, False), (1, 5, True)}
        assert by[None] == {(1, 4, False), (0, None, True)}
        left = near_dedup.drop_near_duplicates(odd.withColumn("tag", F.lit("clash")))
        assert sorted(((r[0], r[1]) for r in left.select("doc_id", F.length("text")).collect()), key=str) == sorted([(1, None), (2, 0), (3, 60000), (4, 15), (None, None), (5, 5)], key=str)
        assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_duplicates(none).count() == 0


class TestToxicity:
    def test_learns_and_leaves_clean_rows(self, spark):
        rng = random.Random(6)
        rows = [(i, prose(rng, 40) + (" idiot scum" if i % 8 == 0 else ""), "a") for i in range(400)]
        labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
        df = docs(spark, rows).withColumn("toxic", F.lit(0))
        got = toxicity.scored(df, toxicity.train(df, labels)).toPandas()
        assert ((got["score"] >= 0.5) == (got["doc_id"] % 8 == 0)).mean() > 0.98 and got["score"].between(0, 1).all()
        assert toxicity.drop_toxic(df, labels).columns == df.columns

    def test_odd_rows(self, spark, odd, none):
        labels = spark.createDataFrame([], "doc_id long, toxic int")
        assert toxicity.scored(odd, toxicity.train(odd, labels)).where("score IS NULL").count() == 0
        assert toxicity.drop_toxic(none, labels).count() == 0

    def test_pairs_that_tell_only_together(self):
        """Rows with one of the two words alone are clean; sixty other words of 3000 are in each row."""
        rng = np.random.default_rng(0)
        both = rng.random((4000, 2)) < 0.3
        rows = [sorted({k for k in (0, 1) if r[k]} | {int(t) for t in rng.integers(1000, 4000, 60)}) for r in both]
        label = both.all(1)
        fm = toxicity.FactorizationMachine().fit(np.concatenate(rows[:3000]), np.array([len(r) for r in rows[:3000]]), label[:3000].astype(float))
        assert ((fm.score(rows[3000:]) >= 0.5) == label[3000:]).mean() > 0.99
        fm.vectors = np.zeros_like(fm.vectors)
        assert ((fm.score(rows[3000:]) >= 0.5) == label[3000:]).mean() < 0.99

    def test_repeated_long_and_punctuated(self, spark):
        rng = random.Random(6)
        rows = [(i // 2, prose(rng, 40) + (" Idiot!!! (scum)," if i // 2 % 8 == 0 else ""), "a") for i in range(800)]
        labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
        model = toxicity.train(docs(spark, rows), labels)
        probe = docs(spark, [(1, "idiot SCUM " + prose(rng, 30), "a"), (1, "idiot SCUM " + prose(rng, 30), "a"), (2, "x" * 500_000, "a"), (3, "!!! ###", "a"), (4, None, "a"), (5, "", "a")])
        got = toxicity.scored(probe, model).toPandas().sort_values("doc_id")["score"].tolist()
        assert got[0] > 0.5 and got[1] > 0.5 and max(got[2:]) < 0.5 and got[3] == got[4] == got[5]

    def test_held_out_accuracy(self, spark):
        d = "/root/testdata/sf0.01"
        got = toxicity.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
        assert (got["predicted"] == got["toxic"]).mean() > 0.95


class TestPii:
    EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(self, t):
        found = [(m.start(), 0, m.end()) for m in self.EMAIL.finditer(t)]
        found += [(m.start(), 1, m.end()) for m in self.IP.finditer(t) if all(int(p.lstrip("0")[:9] or "0") <= 255 for p in m[0].split("."))]
        for m in self.CARD.finditer(t):
            d = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
            if 12 <= len(d) <= 19 and sum(c if k % 2 == 0 else sum(divmod(2 * c, 10)) for k, c in enumerate(d)) % 10 == 0:
                found.append((m.start(), 2, m.end()))
        return sorted(found + [(m.start(), 3, m.end()) for m in self.PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15])

    def test_patterns(self):
        rng = random.Random(7)
        for _ in range(20000):
            t = "".join(rng.choice("0123456789..@+- (a1é\n%") for _ in range(rng.randrange(40)))
            assert pii.patterned(t) == self.brute(t)
        assert pii.patterned("0" * 5000 + ".1.1.1") == [(0, 1, 5006)] and pii.patterned("9" * 5000 + ".1.1.1") == []
        assert pii.patterned("1" * 500_000 + "@" + "a" * 500_000) == [] and pii.patterned("a" * 500_000) == []

    def test_viterbi_against_all_paths(self):
        model = pii.trained()
        words = "call (415) 555-0132 or".split()
        made = pii.line_features(words)
        scores = np.array([model.row(w)[1] for w in made]) + model.bias
        for i, w in enumerate(made):
            scores[i + 1 : i + 2] += model.row(w)[0]
            if i:
                scores[i - 1] += model.row(w)[2]
        import itertools

        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=lambda p: sum(scores[i, a] for i, a in enumerate(p)) + sum(model.pairs[a, b] for a, b in zip((0, *p), (*p, 0), strict=True)))
        assert tuple(pii.Tagger(model).labels([[w.encode() for w in words]])) == best

    def test_spans(self, spark, odd, none):
        df = docs(spark, [(1, "mail a.b@c.de or 10.0.0.1 or dial (503) 555-0123 now", "x")])
        r = pii.find_pii(df).first()
        assert [s["kind"] for s in r["base"]] == ["email", "ip"] and [s["kind"] for s in r["spans"]] == ["email", "ip", "phone"]
        assert pii.find_pii(odd).where("size(spans) > 0").count() == 0 and pii.find_pii(odd).count() == odd.count() and pii.find_pii(none).count() == 0


    HELD_OUT = (
        ("fax 503.555.0199 is on", [("phone", "503.555.0199")]),
        ("the card 4111 1111 1111 1112 was here", [("card", "4111 1111 1111 1112")]),
        ("call 6175550148 please", [("phone", "6175550148")]),
        ("write john [at] mail [dot] com now", [("email", "john [at] mail [dot] com")]),
        ("see jan(at)site.org today", [("email", "jan(at)site.org")]),
        ("they can call (707) 555-0101, or mail zoe at corp dot io", [("phone", "(707) 555-0101"), ("email", "zoe at corp dot io")]),
        ("phone 044 555 0188 thanks", [("phone", "044 555 0188")]),
        ("the host 10-9-8-7 failed", [("ip", "10-9-8-7")]),
        ("we sat at the table and dot", []),
        ("it cost 1200 in 1998 and 1300 in 1999", []),
        ("version 10.2.33 of 2020", []),
    )

    def test_field_adds_spans_of_held_out_texts(self, spark):
        assert not {t for t, _ in self.HELD_OUT} & set(pii.TABLE.splitlines())
        got = pii.find_pii(docs(spark, [(i, t, "x") for i, (t, _) in enumerate(self.HELD_OUT)])).collect()
        for r in got:
            text, want = self.HELD_OUT[r["doc_id"]]
            assert [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] == want and not r["base"]

    def test_query_against_brute_force(self, spark, tmp_path):
        rng = random.Random(8)
        rows = [(i, " ".join(rng.choice(["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (415) 555-0132", "über", "(503) 555-0123", "dial", "0" * 5000 + ".1.1.1", "x@", "1-1"]) for _ in range(rng.randrange(12))), "x") for i in range(60)]
        rows += [(60, None, "x"), (61, "", None), (61, "", None), (62, "9" * 100_000 + " " + "a@b.c " * 4000 + "+1 " + "5" * 12, "x")]
        docs(spark, rows).withColumn("spans", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
        texts = dict((i, t or "") for i, t, _ in rows)
        listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        got = pii.op9_pii(spark, str(tmp_path)).collect()
        assert len(got) == len(rows)
        for r in got:
            base = self.brute(texts[r["doc_id"]]) if r["doc_id"] != 62 else pii.patterned(texts[62])
            assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in base) for j in range(4)]
            spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
            assert {(k, int(a), int(b)) for k, a, b in spans} >= {(pii.KINDS[k], a, b) for a, k, b in base}
            assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)

    def test_many_spans_take_linear_time(self):
        text = "a@b.c (503) 555-0123 " * 4000
        labels = pii.Tagger(pii.trained()).labels([text.encode().split()])
        assert len(pii.added(text, labels, pii.patterned(text))) >= 0


class TestAnn:
    def test_recall_and_scores(self, spark, monkeypatch):
        monkeypatch.setattr(ann, "BLOCK_BYTES", 60_000)  # several blocks of queries
        e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
        got, x = ann.search(e, e.where("vec_id % 100 = 0")).toPandas(), e.toPandas()
        v, ids, hits = np.stack(x["embedding"]).astype(float), x["vec_id"].to_numpy(), 0
        for q in np.flatnonzero(ids % 100 == 0):
            dist = np.sqrt(((v - v[q]) ** 2).sum(1))
            order = [k for k in np.lexsort((ids, dist)) if k != q][:10]
            own = got[got["query_id"] == ids[q]].sort_values("rank")
            assert own["rank"].tolist() == list(range(1, 11))
            hits += len(set(own["vec_id"]) & set(ids[order]))
            at = {i: k for k, i in enumerate(ids)}
            np.testing.assert_allclose(own["score"], [dist[at[i]] for i in own["vec_id"]], rtol=1e-12)
        assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()

    def test_ties_and_odd_vectors(self, spark):
        nan = float("nan")
        rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1e30]), (3, [nan, 1.0]), (4, None), (5, [1.0, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0])]
        e = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
        got = ann.search(e, e.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 5), (0, 6), (0, 2)]
        assert ann.search(e.limit(0), e).count() == 0

    def test_candidates_are_few_where_vectors_cluster(self):
        """50,000 vectors near a surface of six dimensions: recall and the share of candidates, only pairs that share a leaf."""
        rng = np.random.default_rng(1)
        x = np.tanh(rng.normal(size=(50_000, 6)) @ rng.normal(size=(6, 32))) + rng.normal(0, 0.01, (50_000, 32))
        forest, asks = ann.Forest.fit(x[rng.choice(len(x), ann.SAMPLE, replace=False)]), x[:40]
        leaf, share = forest.leaves_of(x), ann.share_for(len(x), 0.1)
        visits = [forest.visited(q, share) for q in asks]
        order = np.lexsort((np.repeat(np.arange(40), [len(v) for v in visits]), np.concatenate(visits)))
        keys, asker = np.concatenate(visits)[order], np.repeat(np.arange(40), [len(v) for v in visits])[order]
        found = np.zeros((40, len(x)), bool)
        for q, r in ann.Block(forest, np.arange(40), asks, keys, asker).pairs(leaf):
            assert not found[q, r].any()  # each pair once
            found[q, r] = True
        want = np.array([[bool(set(visits[q]) & set(leaf[r])) for r in range(0, 5000, 50)] for q in range(40)])
        assert (found[:, :5000:50] == want).all()
        near = np.argsort(((x[None, :, :] - asks[:, None, :]) ** 2).sum(2), 1)[:, 1:11]
        assert np.take_along_axis(found, near, 1).mean() >= 0.9 and found.mean() <= 0.05

    def test_copies_beyond_k_never_matter(self, spark):
        rows = [(i, [1.0, 1.0], 0) for i in range(3000)] + [(3000 + i, [1.0 + i / 4, 1.0], 0) for i in range(1, 50)]
        e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int").repartition(4)
        got = ann.search(e, e.where("vec_id IN (0, 5, 3001)")).orderBy("query_id", "rank").toPandas()
        assert got[got.query_id == 5]["vec_id"].tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
        assert got[got.query_id == 0]["vec_id"].tolist() == list(range(1, 11)) and got[got.query_id == 3001]["vec_id"].tolist() == list(range(10))


class TestLicense:
    def test_matches(self, spark, odd, none):
        t = license_scan.TEMPLATES
        df = docs(spark, [(k, f"Über some text. {v.upper() if k % 2 else v}. More text", "x") for k, v in enumerate(t.values())] + [(99, "the license of the house", "x"), (98, None, "x")])
        got = license_scan.scan_licenses(df.withColumn("template", F.lit("clash")).union(df.withColumn("template", F.lit("clash")).where("doc_id = 98"))).toPandas()
        assert len(t) >= 20 and set(zip(got["doc_id"], got["template"], strict=True)) >= set(enumerate(t)) and not {98, 99} & set(got["doc_id"])
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for k, (name, text) in enumerate(t.items()):
            own = got[(got["doc_id"] == k) & (got["template"] == name)].iloc[0]
            assert own["containment"] == 1 and texts[k][own["start"] : own["end"]] == (text.upper() if k % 2 else text).rstrip("./")
        assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(none).count() == 0

    @pytest.mark.parametrize("name", ["MIT", "MIT-text", "BSD-3-Clause-text"])
    def test_each_copy_is_a_match(self, name):
        text = license_scan.TEMPLATES[name]
        scanner, core = license_scan.Scanner({name: text}), len(text.rstrip("."))
        for n, gap in ((10, " "), (500, ". "), (3, " and then some words more of other text before "), (4000 if name == "MIT" else 50, "\n")):
            got = scanner.scan(gap.join([text] * n))
            assert [(s, e) for _, s, e, _ in got] == [(k * (len(text) + len(gap)), k * (len(text) + len(gap)) + core) for k in range(n)]

    def test_containment_against_brute_force(self):
        """Templates with a share of their words changed, between other words: found where enough is left, else not."""
        rng, scanner, met = random.Random(11), license_scan.Scanner(license_scan.TEMPLATES), [0, 0]
        marks = lambda t: [tuple(x) for x in zip(*(license_scan.words_in(t)[i:] for i in range(3)), strict=False)]
        for name, text in license_scan.TEMPLATES.items():
            for share in (0.01, 0.03, 0.2, 0.4):
                words = [w if rng.random() > share else f"edit{rng.randrange(10**6)}" for w in text.split()]
                doc = f"{prose(rng, 80)} {' '.join(words)} {prose(rng, 80)}"
                want = set(marks(text))
                left = len(want & set(marks(" ".join(words)))) / len(want)
                if left >= 0.85 or left < 0.75:
                    hits = [m for m in scanner.scan(doc) if m[0] == name]
                    assert len(hits) == (left >= 0.85), (name, left)
                    assert not hits or hits[0][3] == pytest.approx(left)
                    met[left >= 0.85] += 1
        assert min(met) > 15

    def test_sections_in_another_order_still_match(self):
        text = license_scan.TEMPLATES["Zlib-text"].split()
        got = license_scan.Scanner({"z": " ".join(text)}).scan(" ".join(text[50:] + text[:50]))
        assert len(got) == 1 and got[0][3] >= 0.8

    def test_very_long_text(self):
        text = license_scan.TEMPLATES["ISC-text"]
        got = license_scan.Scanner(license_scan.TEMPLATES).scan("some words of prose " * 200_000 + text + " more" * 200_000)
        assert [m[1] for m in got if m[0] == "ISC-text"] == [20 * 200_000]

    def test_every_whole_template_is_found(self, spark, data):
        got = license_scan.op7_license_scan(spark, data).toPandas()
        for name, text in license_scan.TEMPLATES.items():
            want = {r[0] for r in spark.read.parquet(f"{data}/documents.parquet").where(F.contains("text", F.lit(text))).select("doc_id").collect()}
            assert want <= set(got["doc_id"][got["template"] == name])
        again = license_scan.Scanner(license_scan.TEMPLATES)
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
        assert sorted(zip(got["doc_id"], got["template"], got["start"], got["end"], strict=True)) == sorted((k, n, a, b) for k, t in texts.items() for n, a, b, _ in again.scan(t))


class TestLm:
    def test_base_and_counts(self, spark, data):
        got = lm.op8_lm_scoring(spark, data).toPandas()
        texts = {r[0]: [*lm.words_of(r[1]), b""] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
        c = collections.Counter(w for k, ws in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
        n, v = sum(c.values()), len(c)
        for r in got.itertuples():
            ws = texts[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert (got["score"] < 0).all()

    def net(self, symbols=40):
        tree = lm.Tree.of(np.arange(symbols) ** 2.0)
        net, rng = lm.Net(lm.WORD, tree), np.random.default_rng(1)
        for n in ("u", "b", "r"):
            net.p[n][:] = rng.normal(0, 0.5, net.p[n].shape)
        return net, rng

    def test_tree_is_a_code(self):
        tree = lm.Tree.of(np.array([0, 5, 1, 900, 3, 3]))
        assert (0.5**tree.length).sum() == 1 and tree.length[3] == 1 and tree.length[0] == tree.length.max()

    def test_probabilities_sum_to_one(self):
        net, rng = self.net()
        a, b, sizes = rng.integers(0, 30, 25), rng.integers(0, 8, 25), np.array([9, 0, 1, 15])
        each = [net.run(a, b, sizes, np.full(25, k))[0] for k in range(40)]
        np.testing.assert_allclose(np.exp(each).sum(0), 1, rtol=1e-4)

    def test_gradient(self):
        net, rng = self.net()
        a, b, sizes, y, weight = rng.integers(0, 30, 25), rng.integers(0, 8, 25), np.array([9, 0, 1, 15]), rng.integers(0, 40, 25), rng.integers(1, 5, 25).astype(np.float32)
        flat = np.concatenate([net.p[k].ravel() for k in net.shapes]).astype(float)
        grad = net.run(a, b, sizes, y, weight)[1]
        loss = lambda f: -(lm.Net(lm.WORD, net.tree, f).run(a, b, sizes, y)[0] * weight).sum()
        for k in [*np.argsort(-np.abs(grad))[:12], *rng.choice(np.flatnonzero(grad), 12)]:
            step = np.zeros(len(flat))
            step[k] = 2e-2
            assert (loss(flat + step) - loss(flat - step)) / 4e-2 == pytest.approx(grad[k], abs=2e-2, rel=2e-2)

    def test_windows_score_each_place_once_and_causally(self):
        net, rng = self.net()
        a, b, y = rng.integers(0, 30, 50), rng.integers(0, 8, 50), rng.integers(0, 40, 50)
        at, inside = lm.places(np.array([30, 0, 20]), 4, 12)
        assert sorted(at[:, 12:][inside[:, 12:]]) == list(range(50))
        before = net.run(a, b, np.array([30, 20]), y)[0]
        a[40:] = 7
        after = net.run(a, b, np.array([30, 20]), y)[0]
        np.testing.assert_allclose(before[:40], after[:40], rtol=1e-6)

    def slow(self, net, a, b, y):
        """ln p of each symbol of one sequence, place by place."""
        p, level, out = {k: v.astype(float) for k, v in net.p.items()}, net.level, []
        x = p["e"][a] + p["f"][b]
        for t in range(len(y)):
            start = max(0, t // level.scored * level.scored - level.context)
            z = np.array([x[t] @ p["q"] @ (x[j] @ p["k"]) / level.width**0.5 + p["r"][t - j] for j in range(start, t + 1)])
            w = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            h = sum(w[j - start] * (x[j] @ p["v"]) for j in range(start, t + 1)) + x[t] @ p["o"]
            way = slice(net.tree.first[y[t]], net.tree.first[y[t]] + net.tree.length[y[t]])
            total = 0.0
            for branch, turn, odds in zip(net.tree.branch[way], net.tree.turn[way], net.tree.odds[way], strict=True):
                own = h @ p["u"][branch] + p["b"][branch] if branch < lm.BRANCHES else 0.0
                total -= np.log1p(np.exp(-float(turn) * (own + odds)))
            out.append(total)
        return out

    def test_scores_against_a_slow_version_and_other_partitions(self, spark, monkeypatch):
        monkeypatch.setattr(lm, "STEPS", 3)
        rng, kept = random.Random(9), {}
        rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) * rng.randrange(9) for _ in range(rng.randrange(70))), "a") for i in range(60)] + [(60, "x" * 3000 + " nbsp\u00a0inside \u2003", "a")]
        real = lm.train
        monkeypatch.setattr(lm, "train", lambda ids, path: kept.setdefault("model", real(ids, path)) if "model" not in kept else real(ids, path))
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs(spark, rows).repartition(1), lm.vocabulary_path()).collect()}
        again = {r["doc_id"]: r["score"] for r in lm.score_documents(docs(spark, rows).repartition(6), lm.vocabulary_path()).collect()}
        assert again == pytest.approx(got, rel=1e-4)
        model, flats, _ = kept["model"]
        texts, words = model.nets(flats)
        enc, size = lm.encoding(lm.vocabulary_path())[0], len(model.classes)
        for i, text, _ in rows[:12] + rows[-1:]:
            ids = [enc.encode_ordinary(" " + w.decode()) for w in lm.words_of(text)]
            a, b = [[lm.CLASSES, *(model.classes[w[k]] for w in ids)] for k in (0, -1)]
            want = sum(self.slow(texts, np.array(a), np.array(b), [*(w[0] for w in ids), size]))
            for w in ids:
                want += sum(self.slow(words, model.classes[np.array(w)], np.minimum(np.arange(len(w)), 8), [*w[1:], size]))
            assert got[i] == pytest.approx(want / np.log(10), rel=1e-3)

    def test_better_than_frequencies_on_held_out_texts(self, spark, data):
        docs_ = spark.read.parquet(f"{data}/documents.parquet")
        ids = lm.tokenised(docs_, lm.vocabulary_path())
        model, flats, _ = lm.train(ids, lm.vocabulary_path())
        held = ids.where("share = -1").select("ids").toArrow().combine_chunks().column(0).combine_chunks()
        t = lm.Texts.of(held, lm.encoding(model.path)[1])
        a, b, sizes, first = model.text_inputs(t)
        c, d, follow = model.word_inputs(t.flat, t.length)
        per_word = lambda nets: (nets[0].run(a, b, sizes, first)[0].sum() + nets[1].run(c, d, t.length, follow)[0].sum()) / len(first) / np.log(10)
        assert per_word(model.nets(flats)) > per_word(model.nets()) + 0.5  # before training the trees' frequencies decide

    def test_ids_travel_as_bytes(self, odd, monkeypatch):
        ids = lm.tokenised(odd, lm.vocabulary_path())
        assert dict(ids.dtypes)["ids"] == "binary"  # two bytes an id, copied whole
        batch = ids.orderBy("row").select("ids").toArrow().combine_chunks().to_batches()[0]
        lengths = [len(x) // 2 for x in batch.column(0).to_pylist()]
        assert 0 in lengths and max(lengths) >= 30000
        cut = list(lm.pieces(batch, 0, 100))
        assert [len(x) // 2 for p in cut for x in p.column(0).to_pylist()] == lengths and len(cut) > 1
        assert np.concatenate([lm.unpacked(p.column(0))[0] for p in cut]).tolist() == lm.unpacked(batch.column(0))[0].tolist()

    def test_cut_together_is_cut_one_by_one(self):
        spelling, rng = lm.Spelling(lm.vocabulary_path()), random.Random(10)
        pool = [*"abcXYZ019'.,!?", "é", "中", "'s", "'LL", "\u00a0", "\u2003", "😀"]
        words = sorted({"".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))).lower().encode() for _ in range(3000)})
        flat, count = spelling.ids([words[:1500], [], words[1500:]])
        want = [i for w in words for i in spelling.encoding.encode_ordinary(" " + w.decode())]
        assert flat.tolist() == want and count.sum() == len(want) and count[1] == 0

    def test_places_and_branches_in_any_portions(self, monkeypatch):
        found = []
        for dense, places in ((48, 16384), (0, 16384), (7, 10), (40, 1)):
            monkeypatch.setattr(lm, "DENSE", dense)
            monkeypatch.setattr(lm, "PLACES", places)
            net, rng = self.net(120)
            a, b, sizes, y, weight = rng.integers(0, 30, 45), rng.integers(0, 8, 45), np.array([9, 0, 1, 35]), rng.integers(0, 120, 45), rng.integers(1, 5, 45).astype(np.float32)
            net.p["u"][lm.BRANCHES], net.p["b"][lm.BRANCHES] = 0, 0
            found.append((*net.run(a, b, sizes, y, weight), net.run(a, b, sizes, y)[0]))
        for lp, grad, again in found:
            np.testing.assert_allclose(lp, found[0][0], atol=1e-4)
            np.testing.assert_allclose(grad, found[0][1], atol=1e-3)
            np.testing.assert_allclose(again, lp, atol=1e-6)
        net.p["q"] *= 300  # beyond what exp holds: the greatest is taken off
        np.testing.assert_allclose(net.run(a[:9], b[:9], sizes[:1], y[:9])[0], self.slow(net, a[:9], b[:9], y[:9]), rtol=1e-3)

    def test_a_step_reads_its_own_folders(self, odd):
        ids = lm.tokenised(odd, lm.vocabulary_path())
        words = lm.train(ids, lm.vocabulary_path())[2]
        for table, column, least in ((ids, "share", -1), (words, "turn", lm.NEVER)):
            assert {r[0] for r in table.select(column).distinct().collect()} <= set(range(least, lm.STEPS))
            value = table.agg(F.max(column)).first()[0]
            files = [r[0] for r in table.where(F.col(column) == value).select(F.input_file_name()).distinct().collect()]
            assert files and all(f"/{column}={value}/" in f for f in files)

    def test_words_of_whole_texts(self):
        rng, pool = random.Random(11), [*"abC \t\n\v\f\r\x1c\x1f\x00.,'1", "\u0085", "\u00a0", "\u2003", "É", "中", "😀"]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(500)] + [None, "", " ", "  a "]
        flat, count = lm.Spelling(lm.vocabulary_path()).ids_of(pa.array(texts).slice(3))
        want, sizes = lm.Spelling(lm.vocabulary_path()).ids([lm.words_of(t) for t in texts[3:]])
        assert flat.tolist() == want.tolist() and count.tolist() == sizes.tolist()

    def test_broadcast_words_are_bounded(self, spark, monkeypatch):
        monkeypatch.setattr(lm, "HOT", 10)
        words = spark.createDataFrame([(1,)] * 8 + [(3,)] * 7 + [(40,)] * 2, "n long")
        assert words.where(F.col("n") > lm.hot_count(words, 109 / 10)).count() == 9  # all but those that would be more than HOT

    def test_odd_rows(self, odd, none):
        got = lm.score_documents(odd, lm.vocabulary_path())
        assert got.count() == odd.count() and got.where("score IS NULL OR base_score IS NULL").count() == 0
        assert lm.score_documents(none, lm.vocabulary_path()).count() == 0


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    df, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in c.STAGES:
        df = c.written(stage(spark, df, d), name)
        kept[name] = [r["doc_id"] for r in df.select("doc_id").collect()]
        if name != "bpe":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {}
    for k in sorted(kept["toxicity"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", start[k]), k)
    assert sorted(kept["exact_dedup"]) == sorted(first.values())
    near = TestNearDedup().brute([(k, start[k]) for k in kept["exact_dedup"]])
    assert sorted(kept["near_dedup"]) == sorted(k for k, (_, comp) in near.items() if k == comp)
    assert len(set(kept["mixing"])) == len(kept["mixing"]) and set(kept["mixing"]) <= set(kept["near_dedup"]) and sorted(kept["bpe"]) == sorted(kept["mixing"])
    words = sum(len(lm.words_of(start[k])) for k in kept["near_dedup"])
    assert sum(len(lm.words_of(start[k])) for k in kept["mixing"]) == pytest.approx(c.SHARE * words, rel=0.05)
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    terms = toxicity.TermsOf()
    assert sorted(kept["toxicity"]) == sorted(k for k, t in start.items() if model.score([sorted(terms.of(t))])[0] < 0.5)
    own = bpe.loaded(bpe.tokenizer_path())
    assert all(r["ids"] == own.encode(start[r["doc_id"]]) for r in df.collect())


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline as c

    clash = {"row": 1, "tag": 2, "hash": 3, "digest": 4, "plan_source": 5, "key_doc_id": 6, "ids": 7, "score": 8}
    df, empty = (t.withColumns({k: F.lit(v) for k, v in clash.items()}) for t in (odd, none))
    for name, stage in c.STAGES:
        left, nothing = stage(spark, df, "/root/testdata/sf0.001"), stage(spark, empty, "/root/testdata/sf0.001")
        assert nothing.count() == 0 and left.count() <= odd.count()
        if name != "bpe":
            assert left.columns == nothing.columns == df.columns


def test_each_stage_begins_with_memory_given_back(spark, none):
    import corpus_pipeline as c

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()  # on one machine the executor's
    for name, stage in c.STAGES:
        before = sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
        stage(spark, none, "/root/testdata/sf0.001")
        assert sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()) > before, name
