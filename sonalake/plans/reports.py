"""Reports, orders and feature preparation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, cleanse, cohort, joins, reports
from .registry import query, table

ORDER = ["purchase", "click", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
POWERS = [round(-2 + 0.25 * k, 2) for k in range(17)]


@query("""SELECT event_type, count(*) AS n_samples, count(DISTINCT event_id) AS n_recordings, count(DISTINCT user_id) AS n_speakers, count(DISTINCT props) AS n_tokens FROM events GROUP BY event_type""")
def diagnosis_per_class(spark, d):
    return reports.breakdown(table(spark, d, "events"), "event_type", n_recordings="event_id", n_speakers="user_id", n_tokens="props")


@query("""SELECT o_orderpriority, max(o_totalprice) AS best, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_orderpriority) AS rank FROM orders GROUP BY o_orderpriority""")
def best_per_config(spark, d):
    return reports.best_per_config(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("""SELECT 'documents' AS "table", 'rows' AS item, count(*) AS n FROM documents UNION ALL SELECT 'labels', 'rows', count(*) FROM labels
          UNION ALL SELECT 'documents', 'lang:' || coalesce(lang, 'null'), count(*) FROM documents GROUP BY lang UNION ALL SELECT 'labels', 'quality:' || coalesce(CAST(quality AS VARCHAR), 'null'), count(*) FROM labels GROUP BY quality""")
def feature_summary(spark, d):
    return reports.feature_summary({n: table(spark, d, n) for n in ("documents", "labels")}, {"documents": "lang", "labels": "quality"})


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_groups, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS groups FROM orders GROUP BY o_custkey""")
def membership_lists(spark, d):
    return reports.memberships(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT count(*) AS n_ids, count(*) FILTER (g = 1) AS n_single, count(*) FILTER (g > 1) AS n_overlap, max(g) AS most_groups FROM (SELECT count(DISTINCT o_orderstatus) AS g FROM orders GROUP BY o_custkey)""")
def overlap_totals(spark, d):
    return reports.overlap_totals(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL""")
def sizes_per_pair(spark, d):
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, round(avg(l_extendedprice - l_extendedprice * (1 - l_discount)), 4) AS delta FROM lineitem GROUP BY l_returnflag""")
def mean_score_delta(spark, d):
    li = table(spark, d, "lineitem")
    out = reports.mean_delta(li, "l_returnflag", F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return out.select("l_returnflag", F.round("delta", 4).alias("delta"))


@query("""SELECT 'documents' AS "table", count(*) AS n_rows, 5::BIGINT AS n_columns, 4::BIGINT AS n_features FROM documents UNION ALL SELECT 'labels', count(*), 3, 2 FROM labels UNION ALL SELECT 'events', count(*), 6, 5 FROM events""")
def table_shapes(spark, d):
    return reports.shape_report({n: table(spark, d, n) for n in ("documents", "labels", "events")}, ["doc_id", "event_id"])


@query("""SELECT value >= 100 AS label, count(*) AS n, count(DISTINCT user_id) AS n_speakers FROM events WHERE event_type = 'click' GROUP BY 1""")
def single_token_stats(spark, d):
    return reports.token_stats(table(spark, d, "events"), "event_type", "click", "user_id", F.col("value") >= 100)


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'click'""")
def token_filter(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id")


@query("""WITH o AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS g FROM orders GROUP BY 1), t AS (SELECT o_custkey, o_custkey::VARCHAR AS txt, g FROM o WHERE g > 1),
          r AS (SELECT *, row_number() OVER (ORDER BY o_custkey) AS line, count(*) OVER () AS total FROM t)
          SELECT line, txt || ':' || g AS text FROM r WHERE line <= 20 UNION ALL SELECT 21, '... and ' || (max(total) - 20) || ' more' FROM r HAVING max(total) > 20""")
def overlap_listing(spark, d):
    some = reports.memberships(table(spark, d, "orders"), "o_custkey", "o_orderstatus").where("n_groups > 1")
    return reports.first_and_more(some, [F.col("o_custkey")], F.concat(F.col("o_custkey"), F.lit(":"), F.col("n_groups")), 20)


@query("""WITH p AS (SELECT DISTINCT o_orderstatus AS g, o_custkey AS u FROM orders), c AS (SELECT a.g AS left_group, b.g AS right_group, count(*) AS overlap FROM p a JOIN p b ON a.u = b.u AND a.g < b.g GROUP BY ALL)
          SELECT *, row_number() OVER (ORDER BY overlap DESC, left_group, right_group) AS rank FROM c""")
def non_zero_pairs(spark, d):
    pairs = joins.pairwise_overlap(table(spark, d, "orders"), "o_orderstatus", "o_custkey").drop("sample_ids")
    return reports.non_zero(pairs, "overlap", ["left_group", "right_group"])


@query("""SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 4) AS balance, row_number() OVER (ORDER BY count(*) DESC, round(avg(s_acctbal), 4), s_nationkey) AS rank FROM supplier GROUP BY 1""")
def multi_key_sort(spark, d):
    out = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 4).alias("balance"))
    return reports.ranked(out, [F.desc("n"), F.col("balance"), F.col("s_nationkey")])


@query("""SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY coalesce(list_position(['purchase', 'click', 'view'], event_type), 4), event_type) AS rank FROM events GROUP BY event_type""")
def custom_order(spark, d):
    out = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return reports.ranked(out, [reports.custom_order("event_type", ORDER), F.col("event_type")])


@query("""WITH k AS (SELECT 'src-' || s_suppkey AS name, s_suppkey AS n FROM supplier) SELECT name, row_number() OVER (ORDER BY n, name) AS rank FROM k""")
def natural_sort(spark, d):
    names = table(spark, d, "supplier").select(F.concat(F.lit("src-"), F.col("s_suppkey")).alias("name"))
    return reports.ranked(names, reports.natural("name"))


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 10""")
def head(spark, d):
    return table(spark, d, "events").orderBy("event_id").limit(10).select("event_id", "user_id", "event_type")


@query("""SELECT event_type, event_id, user_id FROM events""")
def column_order(spark, d):
    return reports.ordered_columns(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["event_type", "missing"])


@query("""SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def numeric_features(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*reports.numeric_columns(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


@query("""SELECT split_part(column_name, '_', 1) AS prefix, count(*) AS n, array_to_string(list_sort(list(column_name)), ',') AS columns FROM (DESCRIBE events) GROUP BY 1""")
def prefix_listing(spark, d):
    return reports.prefix_groups(table(spark, d, "events"))


@query("""WITH a AS (SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS by_status, count(DISTINCT o_orderpriority) > 4 AS by_priority FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN a USING (o_custkey) WHERE NOT (by_status OR by_priority)""")
def overlap_exclusion(spark, d):
    o = cleanse.overlap_flag(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "by_status")
    many = o.groupBy("o_custkey").agg((F.countDistinct("o_orderpriority") > 4).alias("by_priority"))
    return o.join(many, "o_custkey").where("NOT (by_status OR by_priority)").select("o_orderkey")


@query("""SELECT t.speaker, truth, guess FROM (SELECT doc_id % 60 AS speaker, max(quality) AS truth FROM labels GROUP BY 1) t JOIN (SELECT doc_id % 60 AS speaker, max(toxic) AS guess FROM labels GROUP BY 1) p ON t.speaker = p.speaker""")
def truth_and_prediction(spark, d):
    speaker = (F.col("doc_id") % 60).alias("speaker")
    truth, guess = (table(spark, d, "labels").groupBy(speaker).agg(F.max(c).alias(n)) for c, n in (("quality", "truth"), ("toxic", "guess")))
    return truth.join(guess, "speaker")


@query("""SELECT e.vec_id, round(avg(x), 6) AS x_mean, round(stddev_pop(x), 6) AS x_std, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) e GROUP BY e.vec_id""")
def finite_stats(spark, d):
    e = table(spark, d, "embeddings")
    noisy = e.withColumn("embedding", F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double"))))
    out = reports.finite_stats(noisy, "vec_id", "embedding", "x")
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_speakers, count(*) >= 2000 AS capped, count(*) < 1990 AS below FROM events GROUP BY 1""")
def class_report_with_speakers(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("n"), F.countDistinct("user_id").alias("n_speakers"), (n >= 2000).alias("capped"), (n < 1990).alias("below"))


@query("""WITH h AS (SELECT event_id, event_type, row_number() OVER (ORDER BY md5(concat_ws('|', '42', event_id)), event_id) AS r FROM events WHERE event_type = 'view'),
          s AS (SELECT 'click' AS disease UNION ALL SELECT 'purchase'), n AS (SELECT event_type AS disease, count(*) AS n FROM events GROUP BY 1)
          SELECT s.disease, h.event_id, 0 AS y FROM s JOIN n USING (disease) JOIN h ON r <= n UNION ALL SELECT event_type, event_id, 1 FROM events WHERE event_type IN ('click', 'purchase') AND (SELECT count(*) FROM events WHERE event_type = 'view') > 0""")
def per_disease_subsets(spark, d):
    """For each class, as many rows of the healthy one, by the same hash order."""
    e = table(spark, d, "events")
    parts = []
    for disease in ("click", "purchase"):
        two = e.where(F.col("event_type").isin("view", disease))
        cut = cohort.balanced(two, F.col("event_type") == "view", "event_id", 42)
        parts.append(cut.select(F.lit(disease).alias("disease"), "event_id", (F.col("event_type") == disease).cast("int").alias("y")))
    return parts[0].unionByName(parts[1])


STATES = """CASE WHEN quality IS NULL THEN 'missing_wav_path' WHEN doc_id % 7 = 0 THEN 'missing_wav_file' WHEN doc_id % 11 = 0 THEN 'audio_load_failed' END"""


@query(f"""WITH x AS (SELECT doc_id, n_chars, quality, toxic, {STATES} AS before, CASE WHEN n_chars < 500 THEN 'short_signal' ELSE 'ok' END AS mf, CASE WHEN toxic = 1 THEN 'failed' WHEN n_chars = 0 THEN 'empty_signal' ELSE 'ok' END AS ac FROM documents LEFT JOIN labels USING (doc_id)),
           b AS (SELECT *, concat_ws(' | ', CASE WHEN ac <> 'ok' THEN 'acoustic:' || ac END, CASE WHEN mf <> 'ok' THEN 'multifractal:' || mf END) AS bad FROM x)
           SELECT doc_id, coalesce(before, CASE WHEN bad = '' THEN 'ok' ELSE 'partial_failure' END) AS core_status, CASE WHEN before = 'audio_load_failed' THEN 'not readable' WHEN before IS NULL AND bad <> '' THEN bad END AS core_error,
                  coalesce(before, ac) AS acoustic_status, coalesce(before, mf) AS multifractal_status FROM b""")
def sample_statuses(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    path, exists = F.when(F.col("quality").isNotNull(), F.concat(F.col("doc_id"), F.lit(".wav"))), F.col("doc_id") % 7 != 0
    error = F.when(F.col("doc_id") % 11 == 0, "not readable")
    families = {"acoustic": F.when(F.col("toxic") == 1, "failed").when(F.col("n_chars") == 0, "empty_signal").otherwise("ok"), "multifractal": F.when(F.col("n_chars") < 500, "short_signal").otherwise("ok")}
    return reports.sample_status(j, path, exists, error, families).select("doc_id", "core_status", "core_error", "acoustic_status", "multifractal_status")


@query("SELECT o_orderkey, " + ", ".join(f"(coalesce(o_orderpriority, '5-LOW') = '{c}')::INTEGER AS o_orderpriority_{i}" for i, c in enumerate(PRIORITIES[:4])) + " FROM orders")
def one_hot(spark, d):
    """The fifth priority plays the unknown category."""
    out = reports.one_hot(table(spark, d, "orders"), "o_orderpriority", PRIORITIES[:4], "5-LOW")
    return out.select("o_orderkey", *(f"o_orderpriority_{i}" for i in range(4)))


def _yj(p: float) -> str:
    up = "ln(x + 1)" if p == 0 else f"(pow(x + 1, {p}) - 1) / ({p})"
    down = "-ln(1 - x)" if p == 2 else f"-(pow(1 - x, {2 - p}) - 1) / {2 - p}"
    return f"CASE WHEN x >= 0 THEN {up} ELSE {down} END"


YJ = "x AS (SELECT s_suppkey, s_acctbal / 1000 AS x FROM supplier), " + "l AS (" + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS power, -ln(var_pop({_yj(p)})) / 2 + ({p} - 1) * avg(sign(x) * ln(abs(x) + 1)) AS likelihood FROM x" for p in POWERS) + ")"


@query(f"WITH {YJ} SELECT power, round(likelihood, 6) AS likelihood FROM l")
def yeo_johnson_likelihood(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_acctbal") / 1000).alias("x"))
    return reports.yeo_johnson_power(s, "x", POWERS).select("power", F.round("likelihood", 6).alias("likelihood"))


@query(f"""WITH {YJ}, b AS (SELECT power FROM l ORDER BY round(likelihood, 9) DESC, power LIMIT 1), y AS (SELECT s_suppkey, CASE (SELECT power FROM b) {" ".join(f"WHEN {p} THEN {_yj(p)}" for p in POWERS)} END AS y FROM x)
           SELECT s_suppkey, round((y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y), 6) AS z FROM y""")
def yeo_johnson(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"))
    power = reports.yeo_johnson_power(s, "x", POWERS).orderBy(F.desc(F.round("likelihood", 9)), "power").first()["power"]  # a row for each candidate
    y = s.select("s_suppkey", reports.yeo_johnson(F.col("x"), power).alias("y"))
    m = y.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    return y.crossJoin(F.broadcast(m)).select("s_suppkey", F.round((F.col("y") - F.col("m")) / F.col("s"), 6).alias("z"))  # one row


@query(" UNION ALL ".join(f"""(WITH e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem), b AS (SELECT l_returnflag AS y, least(9, floor(({c} - lo) / (hi - lo) * 10)) AS b FROM lineitem, e),
    n AS (SELECT y, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT n, sum(n) OVER () AS total, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM n)
    SELECT '{c}' AS "column", round(sum(n / total * ln(n * total / (nb * ny))), 8) AS mi FROM t)""" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def mutual_information(spark, d):
    out = reports.mutual_information(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", F.round("mi", 8).alias("mi"))


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_token, round_even(avg(value), 1) AS mean_value, count(DISTINCT event_type) AS n_tokens FROM events GROUP BY user_id""")
def first_and_mean(spark, d):
    e = table(spark, d, "events").groupBy("user_id")
    return e.agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_token"), aggs.even_mean("value", 1).alias("mean_value"), F.countDistinct("event_type").alias("n_tokens"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) AS total FROM lineitem GROUP BY l_returnflag
          UNION ALL SELECT 'All', count(*) FILTER (l_linestatus = 'F'), count(*) FILTER (l_linestatus = 'O'), count(*) FROM lineitem""")
def crosstab_totals(spark, d):
    """Wide, with totals of rows and columns."""
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0).withColumn("total", F.col("F") + F.col("O"))
    return wide.unionByName(wide.agg(F.lit("All").alias("l_returnflag"), *(F.sum(c).alias(c) for c in ("F", "O", "total"))))


@query("""WITH p AS (SELECT DISTINCT o_orderstatus AS g, o_custkey AS u FROM orders), c AS (SELECT a.g AS left_group, b.g AS right_group, a.u AS u FROM p a JOIN p b ON a.u = b.u AND a.g < b.g)
          SELECT left_group, right_group, count(*) AS overlap, array_to_string(list_sort(list(u))[1:20], ',') AS sample_ids FROM c GROUP BY ALL""")
def overlap_samples(spark, d):
    pairs = joins.pairwise_overlap(table(spark, d, "orders"), "o_orderstatus", "o_custkey").where("overlap > 0")
    return pairs.withColumn("sample_ids", F.array_join(F.col("sample_ids").cast("array<string>"), ","))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
          SELECT c_custkey, n_name, r_name, n_orders, round(top, 4) AS top, n_lines, round(quantity, 2) AS quantity FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey""")
def five_side_fan_in(spark, d):
    """A core with five sides, each reduced to one row a key before it is joined."""
    t = {n: table(spark, d, n) for n in ("customer", "nation", "region", "orders", "lineitem")}
    per_order = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("q"))
    orders = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top"))
    lines = t["orders"].join(per_order, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("lines").alias("n_lines"), F.sum("q").alias("quantity"))
    core = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    out = joins.fan_in(core, {"orders": orders, "lines": lines}, "c_custkey", {"orders": [F.col("n_orders")], "lines": [F.col("n_lines")]})
    return out.select("c_custkey", "n_name", "r_name", "n_orders", F.round("top", 4).alias("top"), "n_lines", F.round("quantity", 2).alias("quantity"))


@query("""WITH m AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min(ts)::DATE AS since FROM events GROUP BY user_id) SELECT m.user_id, m.event_type, m.since, round(avg(value), 6) AS value__mean FROM m JOIN events e ON m.user_id = e.user_id GROUP BY ALL""")
def speaker_meta(spark, d):
    e = table(spark, d, "events")
    meta = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.to_date(F.min("ts")).alias("since"))
    return meta.join(e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("value__mean")), "user_id")


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance, round(max(c_acctbal), 4) AS best, row_number() OVER (ORDER BY round(avg(c_acctbal), 4) DESC, round(max(c_acctbal), 4) DESC, c_mktsegment) AS rank FROM customer GROUP BY 1""")
def leaderboard_metrics(spark, d):
    out = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.round(F.max("c_acctbal"), 4).alias("best"))
    return reports.ranked(out, [F.desc("mean_balance"), F.desc("best"), F.col("c_mktsegment")])


@query("""SELECT 'rows' AS item, count(*) AS n FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'lang:' || coalesce(lang, 'null'), count(*) FROM documents GROUP BY lang UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT doc_id) FROM documents""")
def manifest_histogram(spark, d):
    """Rows, sources, a status histogram and duplicate keys; an empty table gives zeros and no status."""
    docs = table(spark, d, "documents")
    one = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("duplicate_keys"))
    return one.unpivot([], ["rows", "sources", "duplicate_keys"], "item", "n").unionByName(reports.histogram(docs, "documents", "lang").select("item", "n"))
