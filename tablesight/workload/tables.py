"""Types, profiles, cleaning and features over the given tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tablesight.functions.nulls import na_tokens_to_null
from tablesight.functions.storage import shared_folder
from tablesight.operators import clean, features, hooks, profile as profiles, sketches
from tablesight.operators.quantiles import exact_quantiles
from tablesight.operators.stages import aggregate
from tablesight.operators.typing import decide_types, infer_types, type_shares
from tablesight.workload.registry import query

_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def with_gaps(customers):
    """Customers with a missing balance on every 7th and a missing segment on every 5th key."""
    return customers.withColumns({
        "c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))})


_GAPS = """gaps AS (SELECT c_custkey, c_name, c_nationkey,
                  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
                  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"""


@query("infer_types", """
    SELECT 'o_orderkey' AS name, 'bigint' AS type, count(try_cast(o_orderkey::VARCHAR AS DOUBLE)) / count(*) AS share FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', count(try_cast(o_custkey::VARCHAR AS DOUBLE)) / count(*) FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) / count(*) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(try_cast(o_totalprice::VARCHAR AS DOUBLE)) / count(*) FROM orders
    UNION ALL SELECT 'o_orderdate', 'timestamp', count(try_cast(o_orderdate::VARCHAR AS TIMESTAMP)) / count(*) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) / count(*) FROM orders""")
def infer(t):
    return decide_types(type_shares(as_text(t("orders", spread=True)))).select("name", "type", "share")


@query("infer_values", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def infer_values(t):
    return infer_types(as_text(t("orders", spread=True)))


@query("infer_mixed", """
    SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS mostly_number,
           CASE WHEN event_id % 4 = 0 THEN 'none' ELSE value::VARCHAR END AS often_text,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts::DATE::TIMESTAMP END AS mostly_date,
           event_id % 2 = 0 AS flag FROM events""")
def infer_mixed(t):
    mixed = t("events", spread=True).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 6 == 0, "n.a.").otherwise(F.col("value").cast("string")).alias("mostly_number"),
        F.when(F.col("event_id") % 4 == 0, "none").otherwise(F.col("value").cast("string")).alias("often_text"),
        F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.date_format("ts", "d/M/yyyy")).alias("mostly_date"),
        F.when(F.col("event_id") % 2 == 0, "True").otherwise("False").alias("flag"))
    # Days beyond the 12th settle which of day and month comes first.
    return infer_types(mixed)


@query("missing_tokens", """
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS word FROM events""")
def missing_tokens(t):
    word = F.when(F.col("event_type") == "error", "N/A").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return na_tokens_to_null(t("events").select("event_id", word.alias("word")))


def _profile_sql(table: str, columns: dict[str, str], with_clause: str = "") -> str:
    parts = []
    for c, kind in columns.items():
        label = f"'{kind}'" if kind != "text" else (
            f"CASE WHEN count(DISTINCT {c}) < 0.5 * count({c}) THEN 'categorical' ELSE 'text' END")
        parts.append(f"""
        SELECT '{c}' AS name, {label} AS type,
               (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {table}
                WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)) AS samples,
               round((count(*) - count({c})) * 100 / count(*), 6) AS null_percentage,
               count(DISTINCT {c}) AS unique_count, count(*) AS rows FROM {table}""")
    return f"WITH {with_clause} " * bool(with_clause) + " UNION ALL ".join(parts)


_CUSTOMER_KINDS = {"c_custkey": "numerical", "c_name": "text", "c_nationkey": "numerical", "c_acctbal": "numerical",
                   "c_mktsegment": "text"}


@query("profile", _profile_sql("gaps", _CUSTOMER_KINDS, _GAPS))
def profile(t):
    return profiles.profile(with_gaps(t("customer"))).select(
        "name", "type", F.array_join("sample_values", "|").alias("samples"),
        F.round("null_percentage", 6).alias("null_percentage"), "unique_count", "rows")


@query("column_roles", f"""
    SELECT name, CASE WHEN name = 'o_orderdate' THEN 'time' WHEN type = 'numerical' THEN 'measure' ELSE 'dimension' END AS role,
           CASE WHEN unique_count = rows AND null_percentage = 0 AND type <> 'temporal' THEN 'id' ELSE type END AS characteristic
    FROM ({_profile_sql("orders", {"o_orderkey": "numerical", "o_custkey": "numerical", "o_orderstatus": "text",
                                   "o_totalprice": "numerical", "o_orderdate": "temporal", "o_orderpriority": "text"})})""")
def column_roles(t):
    rows = profiles.characteristics(profiles.column_roles(profiles.profile(t("orders"))))
    return rows.select("name", "role", "characteristic")


@query("file_profile", f"""
    SELECT name, type, CAST(round(null_percentage * rows / 100) AS BIGINT) AS null_count, unique_count,
           concat_ws(',', CASE WHEN null_percentage = 100 THEN 'empty' WHEN null_percentage > 20 THEN 'many missing values'
                               WHEN null_percentage > 0 THEN 'missing values' END,
                     CASE WHEN unique_count = 1 THEN 'constant' END,
                     CASE WHEN unique_count = rows AND null_percentage = 0 THEN 'key' END) AS issues
    FROM ({_profile_sql("gaps", _CUSTOMER_KINDS, _GAPS)})""")
def file_profile(t):
    return profiles.issues_by_column(with_gaps(t("customer"))).withColumn("issues", F.array_join("issues", ","))


@query("upload_shape", """
    SELECT 6 AS columns, count(*) AS rows, 'event_id,ts,user_id,event_type,value,props' AS column_names FROM events""")
def upload_shape(t):
    return profiles.shape(t("events")).withColumn("column_names", F.array_join("column_names", ","))


@query("json_keys", """
    SELECT key, count(*) AS records FROM (SELECT unnest(json_keys(
        CASE WHEN event_type = 'click' THEN '{"k": 1, "clicked": true}' ELSE props END)) AS key FROM events) GROUP BY 1""")
def json_keys(t):
    props = F.when(F.col("event_type") == "click", '{"k": 1, "clicked": true}').otherwise(F.col("props"))
    return profiles.json_keys(t("events").select(props.alias("props")), "props")


@query("quality_score", f"""
    WITH {_GAPS}, u AS (SELECT c_nationkey, c_acctbal, c_mktsegment FROM gaps),
    d AS (SELECT sum(n - 1)::BIGINT AS dup FROM (SELECT count(*) AS n FROM u GROUP BY c_nationkey, c_acctbal, c_mktsegment)),
    m AS (SELECT count(*) AS rows, 3 * count(*) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS missing FROM u)
    SELECT rows, 3 AS columns, missing, dup AS duplicates, round(1 - missing / (3 * rows), 8) AS completeness,
           1.0::DOUBLE AS consistency, round(((1 - missing / (3 * rows)) + 1 + (1 - dup / rows)) / 3, 8) AS score FROM m, d""")
def quality_score(t):
    out = profiles.quality(with_gaps(t("customer")), ["c_nationkey", "c_acctbal", "c_mktsegment"])
    return out.withColumns({"completeness": F.round("completeness", 8), "score": F.round("score", 8)})


@query("date_parts", """
    SELECT event_id, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day,
           quarter(ts)::INT AS ts_quarter, (isodow(ts) - 1)::INT AS ts_day_of_week FROM events""")
def date_parts(t):
    parts = ("year", "month", "day", "quarter", "day_of_week")
    return features.date_parts(t("events").select("event_id", "ts"), parts=parts).drop("ts")


@query("label_encode", """
    SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_code FROM part""")
def label_encode(t):
    return features.label_encode(t("part").select("p_partkey", "p_brand"), "p_brand")


@query("zscore", """
    SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 8) AS c_acctbal_z FROM customer""")
def zscore(t):
    out = features.z_scores(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", F.round("c_acctbal_z", 8).alias("c_acctbal_z"))


@query("normalise_text", r"""
    SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\s\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g'))) AS digest FROM documents""")
def normalise_text(t):
    return t("documents", spread=True).select("doc_id", F.md5(features.normalise_text(F.col("text"))).alias("digest"))


@query("feature_catalog", """
    WITH e AS (SELECT CASE WHEN event_id % 5 <> 0 THEN ts END AS ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
    SELECT 'ts_' || m AS feature, 'int' AS type, 'ts' AS source, m AS method, count(date_part(m, ts)) AS known, count(*) - count(ts) AS missing
    FROM e, (SELECT unnest(['year', 'month', 'day']) AS m) GROUP BY m
    UNION ALL SELECT 'double_value', 'double', NULL, 'expression', count(value * 2), count_if(value IS NULL) FROM e""")
def feature_catalog(t):
    events = t("events").withColumns({"ts": F.expr("CASE WHEN event_id % 5 <> 0 THEN ts END"), "value": F.expr("CASE WHEN event_id % 3 <> 0 THEN value END")})
    return features.feature_catalog(events, features.derive(features.date_parts(events), {"double_value": "value * 2"}))


@query("dedup_first", """
    SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_first(t):
    return clean.drop_duplicates(t("documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


@query("dedup_rows", "SELECT DISTINCT user_id, event_type, props FROM events")
def dedup_rows(t):
    return clean.drop_duplicates(t("events").select("user_id", "event_type", "props"))


@query("impute", f"""
    WITH {_GAPS}, f AS (SELECT median(c_acctbal) AS mid FROM gaps),
    m AS (SELECT c_mktsegment AS usual FROM gaps WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT c_custkey, round(coalesce(c_acctbal, mid), 4) AS c_acctbal, coalesce(c_mktsegment, usual) AS c_mktsegment FROM gaps, f, m""")
def impute(t):
    filled = clean.impute(with_gaps(t("customer")), ["c_acctbal"], ["c_mktsegment"])
    return filled.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


@query("fill_unknown", f"WITH {_GAPS} SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM gaps")
def fill_unknown(t):
    return clean.fill_unknown(with_gaps(t("customer")), ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("measure_to_number", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS value FROM events WHERE event_type <> 'view'""")
def measure_to_number(t):
    raw = t("events").select("event_id", F.when(F.col("event_type") == "view", "n.a.").otherwise(
        F.col("value").cast("string")).alias("value"))
    return clean.numbers_only(raw, "value")


@query("standardise", "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment FROM customer")
def standardise(t):
    messy = t("customer").select("c_custkey", F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")).alias("segment"))
    return clean.standardise(messy, ["segment"], case="upper")


_FENCES = """f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""


@query("outliers_iqr", f"""
    WITH {_FENCES} SELECT event_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_outlier FROM events, f""")
def outliers_iqr(t):
    return clean.flag_outliers(t("events").select("event_id", "value"), ["value"])


@query("quantiles", """
    SELECT 'l_extendedprice' AS "column", p AS probability, round(quantile_cont(l_extendedprice, p), 4) AS quantile
    FROM lineitem, (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p) GROUP BY p
    UNION ALL SELECT 'l_quantity', p, round(quantile_cont(l_quantity, p), 4)
    FROM lineitem, (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS p) GROUP BY p""".replace(
    "quantile_cont(l_extendedprice, p)", "CASE p WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) "
    "WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END").replace(
    "quantile_cont(l_quantity, p)", "CASE p WHEN 0.05 THEN quantile_cont(l_quantity, 0.05) "
    "WHEN 0.5 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.95) END"))
def quantiles(t):
    return exact_quantiles(t("lineitem"), ["l_extendedprice", "l_quantity"], [0.05, 0.5, 0.95]).withColumn(
        "quantile", F.round("quantile", 4))


@query("rule_violations", """
    SELECT 'positive balance' AS rule, count_if(NOT c_acctbal > 0)::BIGINT AS violations,
           round(count_if(NOT c_acctbal > 0) * 100 / count(*), 8) AS percentage FROM customer
    UNION ALL SELECT 'known nation', count_if(NOT c_nationkey BETWEEN 0 AND 24)::BIGINT,
           round(count_if(NOT c_nationkey BETWEEN 0 AND 24) * 100 / count(*), 8) FROM customer""")
def rule_violations(t):
    out = clean.count_violations(t("customer"), {"positive balance": "c_acctbal > 0", "known nation": "c_nationkey BETWEEN 0 AND 24"})
    return out.withColumn("percentage", F.round("percentage", 8))


@query("clean_issues", f"""
    WITH {_GAPS}, n AS (SELECT count(*) AS n FROM gaps),
    f AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM gaps),
    i AS (SELECT 'missing_values' AS type, 'c_acctbal' AS "column", count_if(c_acctbal IS NULL) AS k FROM gaps
          UNION ALL SELECT 'missing_values', 'c_mktsegment', count_if(c_mktsegment IS NULL) FROM gaps
          UNION ALL SELECT 'duplicate_rows', NULL, (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM gaps GROUP BY c_acctbal, c_mktsegment))::BIGINT
          UNION ALL SELECT 'outliers', 'c_acctbal', count_if(c_acctbal NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) FROM gaps, f
          UNION ALL SELECT 'invalid_values', 'positive', count_if(NOT coalesce(c_acctbal > 0, false)) FROM gaps)
    SELECT type, "column", CASE WHEN k * 100 / n > 20 THEN 'high' WHEN k * 100 / n > 5 THEN 'medium' ELSE 'low' END AS severity,
           k::BIGINT AS affected_rows, round(k * 100 / n, 8) AS percentage FROM i, n WHERE k > 0""")
def clean_issues(t):
    out = clean.issues(with_gaps(t("customer")), {"positive": "c_acctbal > 0"}, ["c_acctbal", "c_mktsegment"])
    return out.drop("action").withColumn("percentage", F.round("percentage", 8))


@query("clean_report", """
    WITH a AS (SELECT count(*) AS n FROM documents),
         b AS (SELECT count(*) AS n FROM (SELECT DISTINCT trim(regexp_replace(text, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')), lang FROM documents))
    SELECT a.n AS records_before, b.n AS records_after, a.n - b.n AS records_removed,
           round((a.n - b.n) * 100 / a.n, 8) AS data_loss_percentage FROM a, b""")
def clean_report(t):
    docs = t("documents", spread=True).select("text", "lang")
    return clean.lineage(docs, clean.clean(docs, "standard")).withColumn(
        "data_loss_percentage", F.round("data_loss_percentage", 8))


@query("clean_aggressive", """
    WITH v AS (SELECT DISTINCT user_id, event_type, value FROM events), r AS (SELECT * FROM v WHERE value < 300),
         f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                      quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM r),
         k AS (SELECT r.* FROM r, f WHERE user_id BETWEEN u1 - 1.5 * (u3 - u1) AND u3 + 1.5 * (u3 - u1))
    SELECT k.user_id, event_type, value FROM k, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM r)
    WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def clean_aggressive(t):
    return clean.clean(t("events").select("user_id", "event_type", "value"), "aggressive", {"small": "value < 300"})


@query("analysis_summary", """
    SELECT count(*) AS rows, 6 AS columns, 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS score, 'o_custkey,o_orderkey,o_totalprice' AS measures,
           'o_orderpriority,o_orderstatus' AS dimensions, 'o_orderdate' AS time_columns FROM orders""")
def analysis_summary(t):
    out = profiles.analysis_summary(t("orders")).drop("consistency")
    return out.withColumns({c: F.array_join(c, ",") for c in ("measures", "dimensions", "time_columns")})


@query("stage_chain", """
    SELECT year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, event_type, round(sum(value), 2) AS value
    FROM (SELECT DISTINCT user_id, ts, event_type, value FROM events) WHERE value > 1 GROUP BY ALL""")
def stage_chain(t):
    return hooks.chain(
        t("events").select("user_id", "ts", "event_type", "value"), clean.drop_duplicates, lambda df: df.where("value > 1"),
        features.date_parts, lambda df: aggregate(df, ["ts_year", "ts_month", "ts_day", "event_type"], ["value"]),
    ).withColumn("value", F.round("value", 2))


@query("first_success", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def first_success(t):
    tried = hooks.first_success(t("lineitem"), {
        "A": lambda df: df.groupBy("no_such_column").count(),
        "B": lambda df: df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))})
    return tried.result


@query("user_sql", """
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def user_sql(t):
    orders = t("orders")
    return hooks.run_sql(orders.sparkSession, """
        SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total
        FROM {orders} JOIN {customers} ON o_custkey = c_custkey GROUP BY c_mktsegment""", {"orders": orders, "customers": t("customer")})


@query("user_function", "SELECT p_partkey, p_retailprice * 2 + p_size AS score FROM part")
def user_function(t):
    parts = t("part")

    @F.pandas_udf("double")
    def doubled(price: pd.Series) -> pd.Series:
        return price * 2

    hooks.register_function(parts.sparkSession, "doubled", doubled)
    return features.derive(parts, {"score": "doubled(p_retailprice) + p_size"}).select("p_partkey", "score")


@query("profile_merged", """
    SELECT 'l_quantity' AS name, count(*) AS rows, count_if(l_quantity IS NULL)::BIGINT AS nulls, true AS distinct_near, true AS median_near FROM lineitem
    UNION ALL SELECT 'l_extendedprice', count(*), count_if(l_extendedprice IS NULL), true, true FROM lineitem
    UNION ALL SELECT 'l_partkey', count(*), count_if(l_partkey IS NULL), true, true FROM lineitem""")
def profile_merged(t):
    """Sketches of seven parts, stored one after the other and merged, against exact counts and ranks within the stated errors."""
    columns = ["l_quantity", "l_extendedprice", "l_partkey"]
    lines = t("lineitem").select("l_orderkey", *columns)
    path = f"{shared_folder(lines.sparkSession)}/{uuid.uuid4().hex}"
    part = F.col("l_orderkey") % 7
    for some in (part < 5, part >= 5):
        sketches.append_sketches(sketches.sketch(lines.where(some), part, columns), path)
    found = sketches.merged(sketches.read_sketches(lines.sparkSession, path))
    medians = {r["name"]: r["median"] for r in found.select("name", F.col("quantiles")[1].alias("median")).collect()}  # one row per column
    exact = lines.agg(*[F.struct(F.count_distinct(c).alias("n"), F.avg((F.col(c) < medians[c]).cast("double")).alias("below"),
                                 F.avg((F.col(c) <= medians[c]).cast("double")).alias("upto")).alias(c) for c in columns])
    checks = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("exact")) for c in columns])))
    near = F.abs(F.col("unique_count") - F.col("exact.n")) <= F.col("exact.n") * sketches.DISTINCT_ERROR
    median = (F.col("exact.below") <= 0.5 + sketches.RANK_ERROR) & (F.col("exact.upto") >= 0.5 - sketches.RANK_ERROR)
    return found.join(checks, "name").select("name", "rows", "nulls", near.alias("distinct_near"), median.alias("median_near"))
