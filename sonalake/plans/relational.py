"""Cleanup, joins, sets, cohorts and reports over the driver's tables.

Roles: an event is a recording of the speaker user_id, its event_type the token;
labels are a feature table that covers some documents; dates are orders'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggs, cache, cleanse, cohort, joins
from .registry import query, table

GROUPS = {"view": "passive", "click": "active", "purchase": "active"}
GROUPS_SQL = "CASE event_type WHEN 'view' THEN 'passive' WHEN 'click' THEN 'active' WHEN 'purchase' THEN 'active' END"
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("""SELECT event_type, count(*) AS n_samples, count(DISTINCT user_id) AS n_users, count(*) / count(DISTINCT user_id) AS per_user,
          array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m'))), ',') AS months FROM events GROUP BY event_type""")
def class_breakdown(spark, d):
    return events(spark, d).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_samples"), F.countDistinct("user_id").alias("n_users"), (F.count(F.lit(1)) / F.countDistinct("user_id")).alias("per_user"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM"))), ",").alias("months"))


@query("""SELECT user_id, count(DISTINCT event_type) AS n_tokens, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY user_id""")
def distinct_per_group(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.countDistinct("event_type").alias("n_tokens"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@query("""SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY l.toxic""")
def value_counts_null(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT concat_ws('::', user_id, event_type, event_id) AS sample_key, CASE WHEN starts_with(event_type, 'p') THEN substr(event_type, 2) ELSE event_type END AS token,
          lower(trim(event_type)) = 'view' AS is_healthy FROM events""")
def composite_keys(spark, d):
    return events(spark, d).select(
        cleanse.composite_key("user_id", "event_type", "event_id").alias("sample_key"),
        F.when(F.startswith("event_type", F.lit("p")), F.substr("event_type", F.lit(2))).otherwise(F.col("event_type")).alias("token"),
        (F.lower(F.trim("event_type")) == "view").alias("is_healthy"))


@query("""SELECT e.event_id, m.k > 1 AS is_overlap FROM events e JOIN (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id) m USING (user_id)""")
def overlap_flags(spark, d):
    return cleanse.overlap_flag(events(spark, d), "user_id", "event_type", "is_overlap").select("event_id", "is_overlap")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1)""")
def mixed_label_antijoin(spark, d):
    return cohort.drop_mixed(table(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 80)""")
def small_class_drop(spark, d):
    return cohort.drop_small(table(spark, d, "part"), "p_brand", 80).select("p_partkey", "p_brand")


@query("""WITH t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
          SELECT d.doc_id, d.n_chars, l.quality, l.toxic, t.turns FROM documents d
          LEFT JOIN (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id LEFT JOIN t ON t.conv_id = d.doc_id""")
def safe_fanin_join(spark, d):
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("turns"))
    labels = table(spark, d, "labels")
    out = joins.fan_in(table(spark, d, "documents"), {"labels": labels.unionByName(labels), "turns": turns}, "doc_id", {"labels": [F.col("quality"), F.col("toxic")], "turns": [F.col("turns")]})
    return out.select("doc_id", "n_chars", "quality", "toxic", "turns")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
          SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'matched' END AS match_status FROM customer LEFT JOIN f ON c_custkey = o_custkey AND r = 1""")
def lookup_first_row(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.lookup(table(spark, d, "customer"), orders, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey", "match_status")


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def keep_last_dedup(spark, d):
    e = cleanse.first_by(events(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return e.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def keep_first_dedup(spark, d):
    return cleanse.first_by(events(spark, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH p AS (SELECT DISTINCT event_type AS g, user_id AS u FROM events), g AS (SELECT DISTINCT g FROM p)
          SELECT a.g AS left_group, b.g AS right_group, (SELECT count(*) FROM p x JOIN p y ON x.u = y.u WHERE x.g = a.g AND y.g = b.g) AS overlap FROM g a JOIN g b ON a.g < b.g""")
def pairwise_overlap(spark, d):
    return joins.pairwise_overlap(events(spark, d), "event_type", "user_id").drop("sample_ids")


@query("""SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_left_only, count(*) FILTER (a IS NULL) AS n_right_only,
          coalesce(bool_and(a IS NOT NULL AND b IS NOT NULL), true) AS equal_sets FROM (SELECT DISTINCT doc_id AS a FROM documents) x FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) y ON a = b""")
def key_set_report(spark, d):
    return joins.key_set_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', '42', event_id)), event_id) <= 500""")
def per_class_cap(spark, d):
    return cohort.capped(events(spark, d), "event_type", "event_id", 500, 42).select("event_id", "event_type")


@query("""WITH h AS (SELECT doc_id, 1 AS quality FROM labels WHERE quality = 1 ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id LIMIT (SELECT count(*) FROM labels WHERE quality = 0))
          SELECT doc_id, quality FROM h UNION ALL SELECT doc_id, quality FROM labels WHERE quality = 0""")
def balance_downsample(spark, d):
    return cohort.balanced(table(spark, d, "labels"), F.col("quality") == 1, "doc_id", 42).select("doc_id", "quality")


@query("""SELECT o_orderkey, round_even(datediff('day', o_orderdate, l_shipdate) / 365.25, 1) AS age FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1""")
def age_years(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return table(spark, d, "orders").join(li, "o_orderkey").select("o_orderkey", cleanse.years_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("age"))


@query(f"SELECT event_id, coalesce({GROUPS_SQL}, event_type) AS target FROM events")
def target_map_keep(spark, d):
    return events(spark, d).select("event_id", cohort.target_keep("event_type", GROUPS).alias("target"))


@query(f"""SELECT * FROM (SELECT event_id, CASE WHEN event_type = 'login' THEN 'healthy' ELSE {GROUPS_SQL} END AS target FROM events) WHERE target IS NOT NULL""")
def target_map_drop(spark, d):
    return cohort.target_drop(events(spark, d), "event_type", GROUPS, F.col("event_type") == "login").select("event_id", "target")


@query(f"SELECT event_id, coalesce({GROUPS_SQL}, 'Other') AS target FROM events")
def target_map_other(spark, d):
    return events(spark, d).select("event_id", cohort.target_other("event_type", GROUPS).alias("target"))


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') AND (l.quality = 1 OR l.quality IS NULL)""")
def status_filter_null(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").where(F.col("lang").isin("en", "de"))
    return cohort.with_status(joined, {"quality": [1]}, null_ok=True).select("doc_id")


@query("""WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
          SELECT 'lang' AS "column", count(*) FILTER (lang IS NULL) AS n_missing, round(100 * count(*) FILTER (lang IS NULL) / count(*), 4) AS pct_missing FROM j
          UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), round(100 * count(*) FILTER (quality IS NULL) / count(*), 4) FROM j
          UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), round(100 * count(*) FILTER (toxic IS NULL) / count(*), 4) FROM j""")
def missing_report(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return aggs.missing_report(j, ["lang", "quality", "toxic"])


@query("""WITH v AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'inf'::DOUBLE ELSE value END AS a, value AS b FROM events)
          SELECT 'a' AS "column", count(*) FILTER (isinf(a)) AS n_infinite FROM v UNION ALL SELECT 'b', count(*) FILTER (isinf(b)) FROM v""")
def inf_report(spark, d):
    v = events(spark, d).select(F.when(F.col("event_id") % 97 == 0, float("inf")).otherwise(F.col("value")).alias("a"), F.col("value").alias("b"))
    return aggs.infinite_report(v, ["a", "b"])


def _describe(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {n}" for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, {q}, round(max({c}), 4) AS max FROM lineitem"""


@query(" UNION ALL ".join(map(_describe, COLUMNS)))
def describe_exact(spark, d):
    out = aggs.described(table(spark, d, "lineitem"), COLUMNS)
    return out.select("column", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL""")
def crosstab(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id % 10 AS cohort, count(DISTINCT user_id) FILTER (event_type = 'click') AS click, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS purchase,
          count(DISTINCT user_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def pivot_coverage(spark, d):
    wide = events(spark, d).groupBy((F.col("user_id") % 10).alias("cohort")).pivot("event_type", ["click", "purchase", "view"]).agg(F.countDistinct("user_id"))
    return wide.fillna(0)


@query(" UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]))
def corr_pairs(spark, d):
    return cohort.correlations(table(spark, d, "lineitem"), COLUMNS).select("first", "second", F.round("r", 6).alias("r"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def collinear_drop(spark, d):
    """The revenue follows the price, so it goes; whatever else correlates stays under the limit."""
    li = table(spark, d, "lineitem").withColumn("l_revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    gone = cohort.collinear(li, [*COLUMNS, "l_revenue"], 0.95)
    return li.select("l_orderkey", "l_linenumber", *(c for c in [*COLUMNS, "l_revenue"] if c not in gone))


@query("""SELECT user_id, round(avg(value), 6) AS value__mean, round(coalesce(stddev_samp(value), 0), 6) AS value__std, round(median(value), 6) AS value__median FROM events GROUP BY user_id""")
def speaker_aggregate(spark, d):
    out = aggs.speaker_frame(events(spark, d), "user_id", ["value"])
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
          SELECT user_id, arg_min(event_type, (-n, event_type)) AS mode_token, count(*) AS n_tokens FROM c GROUP BY user_id""")
def speaker_mode_label(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.mode("event_type", True).alias("mode_token"), F.countDistinct("event_type").alias("n_tokens"))


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""")
def winner_per_group(spark, d):
    return cleanse.first_by(events(spark, d), ["user_id"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("""WITH a AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
          SELECT coalesce(a.p, b.p) AS priority, round(a.x - b.x, 4) AS delta FROM a FULL JOIN b ON a.p = b.p""")
def full_outer_delta(spark, d):
    o = table(spark, d, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias(n))
    return side("F", "a").join(side("O", "b"), "priority", "full_outer").select("priority", F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def _means(cols):
    return "SELECT " + ", ".join(f"avg({c}) AS {c}" for c in cols) + " FROM lineitem GROUP BY l_returnflag"


@query(f"""WITH m AS ({_means(COLUMNS)}), r AS ({' UNION ALL '.join(f"SELECT '{c}' AS {chr(34)}column{chr(34)}, var_samp({c}) AS v FROM m" for c in COLUMNS)})
           SELECT "column", round(v, 6) AS variance FROM r ORDER BY v DESC LIMIT 2""")
def interclass_variance_topk(spark, d):
    v = aggs.interclass_variance(table(spark, d, "lineitem"), "l_returnflag", COLUMNS)
    return v.orderBy(F.desc("variance"), "column").limit(2).select("column", F.round("variance", 6).alias("variance"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 3) AS f
        FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)""" for c in COLUMNS))
def anova_f_topk(spark, d):
    return aggs.anova_f(table(spark, d, "lineitem"), "l_returnflag", COLUMNS).select("column", F.round("f", 3).alias("f"))


@query("""SELECT user_id, 'n' AS metric, count(*)::DOUBLE AS v FROM events GROUP BY user_id UNION ALL SELECT user_id, 'top', round(max(value), 6) FROM events GROUP BY user_id""")
def melt(spark, d):
    wide = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.max("value"), 6).alias("top"))
    return wide.unpivot("user_id", ["n", "top"], "metric", "v")


@query("""SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::INTEGER FROM labels""")
def union_by_name(spark, d):
    a, b = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def anti_subtract(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti").distinct()


@query("""SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1""")
def intersect_ids(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("""SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_prop, len(json_keys(props)) AS n_props FROM events""")
def json_props(spark, d):
    keys = F.json_object_keys("props")
    return events(spark, d).select("event_id", F.element_at(F.from_json("props", "map<string,string>"), F.get(keys, F.lit(0))).alias("first_prop"), F.size(keys).cast("long").alias("n_props"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g')) AS plain FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"[ \n\t\r]+", " ")).alias("plain"))


@query("""SELECT conv_id, turn, role, line FROM (SELECT conv_id, turn, role, unnest(string_split(text, '. ')) AS line FROM conversations) WHERE regexp_matches(line, '(?i)accuracy|score|the ')""")
def keyword_lines(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", "role", F.explode(F.split("text", r"\. ")).alias("line"))
    return lines.where(F.col("line").rlike("(?i)accuracy|score|the "))


@query("""SELECT doc_id, coalesce(quality, 0) AS quality, (quality IS NULL)::INTEGER AS quality_missing FROM documents LEFT JOIN labels USING (doc_id)""")
def missing_indicator(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("quality").isNull().cast("int").alias("quality_missing"))


@query("""SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events""")
def zscore(spark, d):
    e = events(spark, d)
    m = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.crossJoin(F.broadcast(m)).select("event_id", F.round((F.col("value") - F.col("m")) / F.col("s"), 6).alias("z"))  # one row


@query("""SELECT doc_id, coalesce(quality, 2)::INTEGER AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def cache_reconcile(spark, d):
    existing = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    target = table(spark, d, "documents").select("doc_id")
    return cache.reconciled(existing, target, "doc_id", lambda missing: missing.withColumn("quality", F.lit(2)))


@query("""SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size < 10)::INTEGER DESC, p_partkey) <= 2""")
def representative_rows(spark, d):
    rank_first = F.desc((F.col("p_size") < 10).cast("int"))
    p = table(spark, d, "part")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(rank_first, "p_partkey"))).where("r <= 2").select("p_brand", "p_type", "p_partkey")


@query("""SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(*) - count(DISTINCT concat_ws('::', user_id, event_type)) AS n_duplicate_keys FROM events""")
def manifest_summary(spark, d):
    key = cleanse.composite_key("user_id", "event_type")
    return events(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("n_duplicate_keys"))


@query("""SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 ORDER BY n DESC, s_nationkey LIMIT 5""")
def leaderboard(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "s_nationkey").limit(5)


@query("""SELECT event_type, count(*) AS n, count(*) >= 2000 AS capped, count(*) < 1990 AS below FROM events GROUP BY 1""")
def cap_report(spark, d):
    n = F.count(F.lit(1))
    return events(spark, d).groupBy("event_type").agg(n.alias("n"), (n >= 2000).alias("capped"), (n < 1990).alias("below"))


@query("""SELECT count_if(quality = 1) / greatest(count_if(quality = 0), 1) AS balance FROM labels""")
def balance_ratio(spark, d):
    return table(spark, d, "labels").agg((F.count_if(F.col("quality") == 1) / F.greatest(F.count_if(F.col("quality") == 0), F.lit(1))).alias("balance"))


@query("""SELECT label, pos, round(avg(x), 5) AS mean, round(coalesce(stddev_samp(x), 0), 5) AS std FROM
          (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos FROM embeddings) GROUP BY ALL""")
def curve_envelope(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return aggs.curve_envelope(e, "label", "embedding").select("label", "pos", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))
