"""Queries: aggregates, contingency, windows, sorts, set operations, profiles and regression."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernspan.operators import tabular as T
from fernspan.session import table

LANGS = ["de", "en", "es", "fr"]
FLAGS = ["A", "N", "R"]


def lang_counts(spark, sf):
    return T.value_counts(table(spark, sf, "documents"), "lang")


def distinct_per_group(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_lang"), F.count_distinct("text").alias("n_text"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


def describe_lengths(spark, sf):
    return T.describe_by(table(spark, sf, "documents"), "lang", "n_chars")


def median_by_group(spark, sf):
    return T.median_by(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice").select("l_returnflag", F.round("median", 6).alias("median_price"))


def source_lang_cube(spark, sf):
    return T.crosstab(table(spark, sf, "documents"), "source", "lang")


def pivot_lang_source(spark, sf):
    wide = T.pivot_counts(table(spark, sf, "documents"), "source", "lang", LANGS)
    return wide.select("source", *LANGS, "total", *(F.round(F.col(c) / F.col("total"), 6).alias(f"share_{c}") for c in LANGS))


def pivot_price(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", FLAGS).agg(F.round(F.sum("l_quantity"), 2))
    return d.fillna(0.0)


def null_profile(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return T.null_profile(d.select("doc_id", "lang", "source", "quality", "toxic"))


def length_histogram(spark, sf):
    return T.histogram(table(spark, sf, "orders"), "o_totalprice", 0.0, 500000.0, 20)


def price_correlations(spark, sf):
    return T.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def ols_price(spark, sf):
    return T.ols(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")


def linear_scorer(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.linear_score(F.col("l_discount"), 90.2, -50.6), 6).alias("score"))


def zscore_parts(spark, sf):
    d = T.zscores(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return d.select("p_partkey", F.round("z_p_size", 6).alias("z_size"), F.round("z_p_retailprice", 5).alias("z_price"))


def one_hot_segments(spark, sf):
    c = table(spark, sf, "customer")
    values = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    d = T.one_hot(c.withColumnRenamed("c_mktsegment", "seg"), "seg", values)
    return d.select("c_custkey", *[f"seg_{v}" for v in values])


def info_gain(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "source", (F.col("n_chars") > 1500).alias("long_text"), "quality")
    return T.info_gain(d, ["lang", "source", "long_text"], "quality")


def conditional_rates(spark, sf):
    """Counts and rates of a boolean by group; an empty mask gives null."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"), F.round(F.avg("toxic"), 6).alias("rate"), F.round(F.avg(F.when(F.col("quality") == 0, F.col("toxic"))), 6).alias("rate_low"), F.count_if(F.col("quality") == 1).alias("n_good"))


def totals_by_currency(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("amount"), F.round(F.sum(F.col("value") * 1.35), 4).alias("sgd"), F.round(F.sum(F.when(F.col("value") > 50, F.col("value"))), 4).alias("large"))


def first_label_of_group(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("lang", "doc_id").alias("first_lang"), F.min("doc_id").alias("first_id"))


def top_words_per_source(spark, sf):
    d = table(spark, sf, "documents")
    return T.top_per_group(d.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


def longest_per_lang(spark, sf):
    return T.row_of_maximum(table(spark, sf, "documents").select("lang", "doc_id", "source", "n_chars"), ["lang"], F.col("n_chars"), ["doc_id"])


def random_sample(spark, sf):
    """The sampling operator: a hundred rows, the same ones each time."""
    return T.sampled(table(spark, sf, "documents").select("doc_id", "source"), F.col("doc_id"), 100)


def largest_orders(spark, sf):
    """Top-k report over the whole table."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def build_chain_diff(spark, sf):
    """Row-to-row change along a chain of daily totals."""
    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.orderBy("day")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("v", 4).alias("v"), F.round(F.coalesce(F.col("v") - F.lag("v").over(w), F.lit(0.0)), 4).alias("gain"))


def union_disjoint_complement(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    held = d.filter(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5 == 0)
    rest = T.complement(d, held, ["doc_id"])
    parts = held.withColumn("part", F.lit("held")).unionByName(rest.withColumn("part", F.lit("rest")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def null_safe_membership(spark, sf):
    """Membership and its negation, where a null is kept by the negation."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    inside = F.coalesce(F.col("toxic").isin(1), F.lit(False))
    return d.groupBy(inside.alias("in_set")).agg(F.count("*").alias("n"), F.count("toxic").alias("n_known"))


def tpch_pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def revenue_by_region(spark, sf):
    """A star join: the dimensions are broadcast by their size, the fact tables meet on the order key."""
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        lang_counts, distinct_per_group, describe_lengths, median_by_group, source_lang_cube, pivot_lang_source, pivot_price, null_profile, length_histogram, price_correlations, ols_price, linear_scorer, zscore_parts, one_hot_segments,
        info_gain, conditional_rates, totals_by_currency, first_label_of_group, top_words_per_source, longest_per_lang, random_sample, largest_orders, build_chain_diff, union_disjoint_complement, null_safe_membership, tpch_pricing_summary, revenue_by_region,
    )
}

_DL = "documents JOIN labels USING (doc_id)"
_GAIN = """
WITH d AS (SELECT lang, source, (n_chars > 1500) AS long_text, quality FROM documents JOIN labels USING (doc_id)),
l AS (SELECT 'lang' AS attribute, lang AS value, quality FROM d UNION ALL SELECT 'source', source, quality FROM d UNION ALL SELECT 'long_text', cast(long_text AS VARCHAR), quality FROM d),
c AS (SELECT attribute, value, quality, count(*) AS n FROM l GROUP BY ALL),
h AS (SELECT attribute, value, sum(n) AS t, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL),
r AS (SELECT attribute, sum(t * h) / sum(t) AS rest FROM h GROUP BY ALL),
w AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS whole FROM (SELECT quality, count(*) AS n FROM d GROUP BY quality))
SELECT attribute, round(whole - rest, 6) AS gain FROM r, w
"""
_QUANT = "round(quantile_cont(n_chars, {}), 6)"
_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

ORACLES = {
    "lang_counts": "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang",
    "distinct_per_group": "SELECT source, count(DISTINCT lang) AS n_lang, count(DISTINCT text) AS n_text, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY source",
    "describe_lengths": f"SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS min, {_QUANT.format(0.25)} AS q25, {_QUANT.format(0.5)} AS q50, {_QUANT.format(0.75)} AS q75, max(n_chars) AS max FROM documents GROUP BY lang",
    "median_by_group": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price FROM lineitem GROUP BY 1",
    "source_lang_cube": "SELECT source, lang, count(*) AS n, cast(grouping(source, lang) AS INTEGER) AS level FROM documents GROUP BY CUBE (source, lang)",
    "pivot_lang_source": "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in LANGS) + ", count(*) FILTER (lang IN ('de', 'en', 'es', 'fr')) AS total, " + ", ".join(f"round(count(*) FILTER (lang = '{x}') / count(*) FILTER (lang IN ('de', 'en', 'es', 'fr')), 6) AS share_{x}" for x in LANGS) + " FROM documents GROUP BY source",
    "pivot_price": "SELECT l_linestatus, " + ", ".join(f'coalesce(round(sum(l_quantity) FILTER (l_returnflag = \'{x}\'), 2), 0.0) AS "{x}"' for x in FLAGS) + " FROM lineitem GROUP BY 1",
    "null_profile": "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM d" for c in ("doc_id", "lang", "source", "quality", "toxic")),
    "length_histogram": "SELECT cast(CASE WHEN o_totalprice = 500000 THEN 20 ELSE floor((o_totalprice - 0.0) / 25000.0) + 1 END AS INTEGER) AS bin, count(*) AS n, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1",
    "price_correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]),
    "ols_price": "SELECT round(s, 6) AS slope, round(i, 4) AS intercept, cast(n AS BIGINT) AS n, round(sqrt(greatest(syy - s * sxy, 0) / n), 4) AS rmse FROM (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, regr_count(l_extendedprice, l_quantity) AS n, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem)",
    "linear_scorer": "SELECT l_orderkey, l_linenumber, round(90.2::DOUBLE + (-50.6)::DOUBLE * l_discount, 6) AS score FROM lineitem",
    "zscore_parts": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 5) AS z_price FROM part",
    "one_hot_segments": "SELECT c_custkey, " + ", ".join(f"cast(c_mktsegment = '{v}' AS INTEGER) AS seg_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
    "info_gain": _GAIN,
    "conditional_rates": f"SELECT lang, count(*) AS n, cast(sum(toxic) AS BIGINT) AS n_toxic, round(avg(toxic), 6) AS rate, round(avg(CASE WHEN quality = 0 THEN toxic END), 6) AS rate_low, count(*) FILTER (quality = 1) AS n_good FROM {_DL} GROUP BY lang",
    "totals_by_currency": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS amount, round(sum(value * 1.35::DOUBLE), 4) AS sgd, round(sum(CASE WHEN value > 50 THEN value END), 4) AS large FROM events GROUP BY event_type",
    "first_label_of_group": "SELECT source, arg_min(lang, doc_id) AS first_lang, min(doc_id) AS first_id FROM documents GROUP BY source",
    "top_words_per_source": "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3",
    "longest_per_lang": "SELECT lang, doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1",
    "random_sample": "SELECT doc_id, source FROM documents ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "largest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "build_chain_diff": "SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 4) AS v, round(coalesce(v - lag(v) OVER (ORDER BY day), 0), 4) AS gain FROM (SELECT cast(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1)",
    "union_disjoint_complement": "SELECT CASE WHEN ('0x' || substr(md5(cast(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 5 = 0 THEN 'held' ELSE 'rest' END AS part, count(*) AS n, cast(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY 1",
    "null_safe_membership": "SELECT coalesce(toxic IN (1), false) AS in_set, count(*) AS n, count(toxic) AS n_known FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "tpch_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "revenue_by_region": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}
