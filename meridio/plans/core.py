"""Scans, cleaning, joins, aggregates, ranks, gap filling, profiles and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import STOP, any_true_in_dict, category_slug, census_number, literal_bool, literal_text, name_key, r6, repair_years, split_trim, tokens_plain, week_ending_sunday
from ..operators import relational as rel
from .bindings import INTER, SUPP, interactions, suppliers, t
from .registry import query

STOPS = ", ".join(f"'{w}'" for w in STOP)


@query("scan_pruned_pushdown", """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag""")
def scan_pruned_pushdown(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("clean_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def clean_json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("explode_tokens", f"""SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
  WHERE length(token) > 2 AND token NOT IN ({STOPS}) GROUP BY lang, token""")
def explode_tokens(spark, d):
    return t(spark, d, "documents").select("lang", F.explode(tokens_plain(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


@query("array_clean_trim", """SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(p_brand || ' , ' || p_type, ','))) AS item FROM part) GROUP BY item""")
def array_clean_trim(spark, d):
    tags = split_trim(F.concat_ws(" , ", "p_brand", "p_type"))
    return t(spark, d, "part").select(F.explode(tags).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("map_lookup_default", """SELECT CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' ELSE 'other' END AS market, count(*) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def map_lookup_default(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    names = F.create_map(*(F.lit(x) for x in (0, "south", 1, "west", 2, "east")))
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return rows.select(F.coalesce(names[F.col("n_regionkey")], F.lit("other")).alias("market")).groupBy("market").agg(F.count(F.lit(1)).alias("n"))


@query("slug_normalise", """SELECT p_partkey, 'cat_' || replace(replace(replace(lower(p_type), '&', 'and'), ' ', '_'), '/', '_') AS slug,
  trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM part""")
def slug_normalise(spark, d):
    return t(spark, d, "part").select("p_partkey", category_slug(F.col("p_type")).alias("slug"), name_key(F.col("p_name")).alias("name_key"))


@query("python_literals", """SELECT event_id, CASE WHEN k % 3 = 0 THEN TRUE WHEN k % 3 = 1 THEN FALSE END AS flag, CASE WHEN k % 2 = 0 THEN 'free' END AS wifi, k % 5 = 0 AS parking,
  CASE WHEN k % 2 = 0 THEN 2 ELSE 2 END AS n_years FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def python_literals(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t(spark, d, "events").select("event_id", k.alias("k")).select(
        "event_id",
        F.when(F.col("k") % 3 == 0, "True").when(F.col("k") % 3 == 1, "u'false'").otherwise("None").alias("a"),
        F.when(F.col("k") % 2 == 0, "u'free'").otherwise("None").alias("b"),
        F.when(F.col("k") % 5 == 0, "{'garage': False, 'lot': True}").otherwise("{'garage': False, 'lot': None}").alias("c"),
        F.when(F.col("k") % 2 == 0, "20,20,2021").otherwise("2020,2021").alias("y"),
    )
    return rows.select("event_id", literal_bool(F.col("a")).alias("flag"), literal_text(F.col("b")).alias("wifi"), any_true_in_dict(F.col("c")).alias("parking"), F.size(repair_years(F.col("y"))).alias("n_years"))


@query("census_shares", """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS income,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END, 0) * 2.0 / (s_suppkey % 5 * 25), 4) END AS share FROM supplier""")
def census_shares(spark, d):
    s = t(spark, d, "supplier")
    raw = s.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "-666666666").otherwise(F.round("s_acctbal", 2).cast("string")).alias("income"),
                   F.when(F.col("s_suppkey") % 3 == 0, "-666666666").otherwise(F.col("s_nationkey").cast("string")).alias("part"), (F.col("s_suppkey") % 5 * 25).cast("double").alias("whole"))
    part = F.coalesce(census_number(F.col("part")), F.lit(0.0)) * 2
    return raw.select("s_suppkey", census_number(F.col("income")).alias("income"), F.round(F.try_divide(part, F.when(F.col("whole") != 0, F.col("whole"))), 4).alias("share"))


_PROFILE = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS type, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS example FROM customer"
    for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"))
)


@query("column_profile", _PROFILE)
def column_profile(spark, d):
    return rel.column_profile(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("approx_profile")
def approx_profile(spark, d):
    return rel.column_profile(t(spark, d, "lineitem"), exact=False)


@query("quality_checks", """SELECT 'null_price' AS check_name, count(*) FILTER (WHERE l_extendedprice IS NULL) AS n FROM lineitem
  UNION ALL SELECT 'quantity_out_of_range', count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 50) FROM lineitem
  UNION ALL SELECT 'discount_out_of_range', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 1) FROM lineitem
  UNION ALL SELECT 'large_tax', count(*) FILTER (WHERE l_tax > 0.05) FROM lineitem
  UNION ALL SELECT 'flag_not_letter', count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '[A-Za-z]')) FROM lineitem
  UNION ALL SELECT 'status_empty', count(*) FILTER (WHERE l_linestatus = '') FROM lineitem
  UNION ALL SELECT 'status_unknown', count(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F')) FROM lineitem""")
def quality_checks(spark, d):
    return rel.count_checks(t(spark, d, "lineitem"), {
        "null_price": "l_extendedprice is null", "quantity_out_of_range": "l_quantity < 1 or l_quantity > 50", "discount_out_of_range": "l_discount < 0 or l_discount > 1",
        "large_tax": "l_tax > 0.05", "flag_not_letter": "not l_returnflag rlike '[A-Za-z]'", "status_empty": "l_linestatus = ''", "status_unknown": "l_linestatus not in ('O', 'F')",
    })


@query("integrity_checks", """SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys,
  (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS orders_without_lines,
  (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)) AS orphans,
  (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS first_day, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) AS last_day""")
def integrity_checks(spark, d):
    li, o = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dup = rel.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("duplicate_keys"))
    lone = rel.orphans(o, li, "o_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("orders_without_lines"))
    orphan = rel.orphans(li, o, "l_orderkey", "o_orderkey").agg(F.count(F.lit(1)).alias("orphans"))
    span = o.agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return dup.crossJoin(lone).crossJoin(orphan).crossJoin(span)  # one row each


@query("filter_sensitivity", f"""WITH {INTER}, {SUPP}, u AS (SELECT 'all' AS definition, i FROM supp UNION ALL SELECT 'one_market', i FROM supp WHERE market = (SELECT min(market) FROM supp)
  UNION ALL SELECT 'positive_balance', i FROM supp WHERE balance > 0)
  SELECT definition, count(DISTINCT u.i) AS items, count(inter.u) AS n_rows, round(CAST(count(inter.u) AS DOUBLE) / count(DISTINCT u.i), 6) AS intensity FROM u LEFT JOIN inter ON u.i = inter.i GROUP BY definition""")
def filter_sensitivity(spark, d):
    s = suppliers(spark, d)
    first = s.agg(F.min("market").alias("m"))
    universes = {"all": s.select("i"), "one_market": s.join(F.broadcast(first), s.market == first.m, "left_semi").select("i"), "positive_balance": s.where("balance > 0").select("i")}
    return rel.universe_sensitivity(interactions(spark, d), universes, "i")


@query("attribute_coverage", """SELECT attribute, round(share, 6) AS share, share >= 0.3 AS kept FROM (
  SELECT 'quality' AS attribute, avg(CASE WHEN quality IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'toxic', avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) FROM documents LEFT JOIN labels USING (doc_id))""")
def attribute_coverage(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return rel.coverage(rows.select("quality", F.when(F.col("toxic") == 1, 1).alias("toxic")), ["quality", "toxic"], 0.3)


@query("market_comparison", f"""WITH {INTER}, {SUPP}, a AS (SELECT market, count(*) AS items, round(avg(balance), 6) AS mean_balance FROM supp GROUP BY market),
  b AS (SELECT market, count(*) AS n_rows, round(avg(r), 6) AS mean_rating, count(DISTINCT u) AS users FROM inter JOIN supp USING (i) GROUP BY market)
  SELECT market, items, mean_balance, n_rows, mean_rating, users FROM a JOIN b USING (market)""")
def market_comparison(spark, d):
    s = suppliers(spark, d)
    a = s.groupBy("market").agg(F.count(F.lit(1)).alias("items"), r6(F.avg("balance")).alias("mean_balance"))
    b = interactions(spark, d).join(s, "i").groupBy("market").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.avg("r")).alias("mean_rating"), F.count_distinct("u").alias("users"))
    return a.join(b, "market")


@query("yearly_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def yearly_counts(spark, d):
    return t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24))


@query("dow_hour_heatmap", f"SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, {_HOURS} FROM events GROUP BY 1")
def dow_hour_heatmap(spark, d):
    rows = t(spark, d, "events").select(F.dayofweek("ts").alias("dow"), F.concat(F.lit("h"), F.hour("ts")).alias("h"))
    return rows.groupBy("dow").pivot("h", [f"h{h}" for h in range(24)]).count().na.fill(0)


@query("temporal_profile", """SELECT 'month' AS unit, CAST(month(ts) AS INTEGER) AS value, count(*) AS n FROM events GROUP BY 2
  UNION ALL SELECT 'dow', CAST(dayofweek(ts) + 1 AS INTEGER), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(ts) AS INTEGER), count(*) FROM events GROUP BY 2""")
def temporal_profile(spark, d):
    parts = F.explode(F.create_map(F.lit("month"), F.month("ts"), F.lit("dow"), F.dayofweek("ts"), F.lit("hour"), F.hour("ts"))).alias("unit", "value")
    return t(spark, d, "events").select(parts).groupBy("unit", "value").agg(F.count(F.lit(1)).alias("n"))


@query("text_length_percentiles", """SELECT lang, CAST(min(length(text)) AS BIGINT) AS shortest, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90,
  round(quantile_cont(length(text), 0.99), 6) AS p99 FROM documents GROUP BY lang""")
def text_length_percentiles(spark, d):
    n = F.length("text")
    return t(spark, d, "documents").groupBy("lang").agg(F.min(n).cast("bigint").alias("shortest"), *(r6(F.percentile(n, p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)))


@query("percentiles_exact", """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type""")
def percentiles_exact(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(*(r6(F.percentile("value", p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)))


@query("conditional_filter_agg", """SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(avg(l_extendedprice) FILTER (WHERE l_quantity >= 25), 6) AS mean_large,
  count(*) FILTER (WHERE l_tax = 0) AS untaxed FROM lineitem GROUP BY l_returnflag""")
def conditional_filter_agg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), r6(F.expr("avg(l_extendedprice) filter (where l_quantity >= 25)")).alias("mean_large"), F.count_if(F.col("l_tax") == 0).alias("untaxed")
    )


@query("value_shares", "SELECT c_mktsegment, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def value_shares(spark, d):
    return rel.value_shares(t(spark, d, "customer"), ["c_mktsegment"])


@query("first_interaction_dedupe", f"WITH {INTER} SELECT u, i, r, d FROM inter")
def first_interaction_dedupe(spark, d):
    return interactions(spark, d)


@query("argmax_per_group", "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k = 1")
def argmax_per_group(spark, d):
    return rel.top_per_group(t(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 1).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("mode_per_group", """SELECT c_nationkey, c_mktsegment AS segment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k
  FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE k = 1""")
def mode_per_group(spark, d):
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.mode("c_mktsegment", deterministic=True).alias("segment"))


@query("avg_rank_pct", """SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER (), 6) AS pct FROM part""")
def avg_rank_pct(spark, d):
    return rel.percent_ranks(t(spark, d, "part"), "p_size", "pct").select("p_partkey", r6(F.col("pct")).alias("pct"))


@query("ccdf", """SELECT v, round(1 - (row_number() OVER (ORDER BY v) - 1) * 1.0 / count(*) OVER (), 6) AS ccdf FROM (SELECT count(*) AS v FROM orders GROUP BY o_custkey)""")
def ccdf(spark, d):
    return rel.ccdf(t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v")), "v").select("v", r6(F.col("ccdf")).alias("ccdf"))


@query("topk_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5")
def topk_per_group(spark, d):
    return rel.top_per_group(t(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5, "k").select("c_mktsegment", "c_custkey", "c_acctbal", "k")


_CUM = "cum AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(count(*)) OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS total FROM events GROUP BY event_type, CAST(ts AS DATE))"


def _cumulative(spark, d) -> DataFrame:
    daily = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.select("event_type", "day", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("total"))


@query("lag_new_from_cumulative", f"""WITH {_CUM} SELECT event_type, day, CAST(greatest(total - coalesce(lag(total) OVER (PARTITION BY event_type ORDER BY day), total), 0) AS BIGINT) AS new FROM cum""")
def lag_new_from_cumulative(spark, d):
    return rel.new_from_cumulative(_cumulative(spark, d), ["event_type"], "day", "total", "new").select("event_type", "day", "new")


@query("trailing_mean_7", """WITH daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
  SELECT day, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 6) END AS mean_7 FROM daily WINDOW w AS (ORDER BY day ROWS 6 PRECEDING)""")
def trailing_mean_7(spark, d):
    daily = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rel.trailing_mean(daily, [], "day", "n", 7, "mean_7").select("day", "n", r6(F.col("mean_7")).alias("mean_7"))


@query("week_ending_sunday", "SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS week, count(*) AS n, round(sum(value), 6) AS total, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY 1")
def week_ending(spark, d):
    return t(spark, d, "events").groupBy(week_ending_sunday(F.to_date("ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"), F.to_date(F.max("ts")).alias("last_day"))


@query("gapfill_hourly", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1),
  g AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
  SELECT strftime(g.hour, '%Y-%m-%d %H:%M') AS hour, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (hour)""")
def gapfill_hourly(spark, d):
    rows = t(spark, d, "events").where("event_type = 'signup'")
    return rel.hourly_counts(rows, "ts").select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n")


@query("union_event_kinds", """SELECT kind, market, count(*) AS n FROM (SELECT 'order' AS kind, c_nationkey AS market FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'line', s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY kind, market""")
def union_event_kinds(spark, d):
    o, c, li, s = (t(spark, d, x) for x in ("orders", "customer", "lineitem", "supplier"))
    a = o.join(c, o.o_custkey == c.c_custkey).select(F.lit("order").alias("kind"), F.col("c_nationkey").alias("market"))
    b = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("market"), F.lit("line").alias("kind"))
    return a.unionByName(b).groupBy("kind", "market").agg(F.count(F.lit(1)).alias("n"))


@query("topk_overlap", """WITH a AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(*) DESC, l_suppkey LIMIT 20), b AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 20)
  SELECT count(*) AS overlap FROM a JOIN b USING (l_suppkey)""")
def topk_overlap(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("v"))
    a, b = (g.orderBy(F.desc(x), "l_suppkey").limit(20).select("l_suppkey") for x in ("n", "v"))
    return a.join(b, "l_suppkey", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))


@query("surrogate_keys", f"WITH {INTER} SELECT u, CAST(row_number() OVER (ORDER BY u) - 1 AS BIGINT) AS u_idx FROM (SELECT DISTINCT u FROM inter)")
def surrogate_keys(spark, d):
    return rel.dense_keys(interactions(spark, d).select("u"), "u", "u_idx")


@query("key_based_sample", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 10 < 3 GROUP BY o_custkey")
def key_based_sample(spark, d):
    return t(spark, d, "orders").where(F.col("o_custkey") % 10 < 3).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("referential_antijoin", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def referential_antijoin(spark, d):
    return rel.orphans(t(spark, d, "customer"), t(spark, d, "orders").where("o_totalprice > 150000"), "c_custkey", "o_custkey").select("c_custkey")


@query("case_insensitive_filter", "SELECT n_name FROM nation WHERE n_name ILIKE '%tion_1%'")
def case_insensitive_filter(spark, d):
    return t(spark, d, "nation").where(F.col("n_name").ilike("%tion_1%")).select("n_name")


@query("crosstab_normalised", """SELECT c_mktsegment, c_nationkey, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer GROUP BY c_mktsegment, c_nationkey""")
def crosstab_normalised(spark, d):
    return rel.value_shares(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], within=["c_mktsegment"])


@query("melt_measures", """SELECT s_suppkey, measure, round(value, 6) AS value FROM (SELECT s_suppkey, 'balance' AS measure, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier)""")
def melt_measures(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "measure", "value").withColumn("value", r6(F.col("value")))


@query("snippets_first_k", """SELECT source, doc_id, substring(text, 1, 250) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 15""")
def snippets_first_k(spark, d):
    return rel.top_per_group(t(spark, d, "documents"), ["source"], [F.asc("doc_id")], 15).select("source", "doc_id", F.substring("text", 1, 250).alias("snippet"))
