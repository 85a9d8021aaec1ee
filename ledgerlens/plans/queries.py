"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_iso
from ..operators import clean as C
from ..operators import expectations as E
from ..operators import orderstat as O
from ..operators import profile as P
from ..operators import risk as R
from ..operators import sketches as K
from ..operators.asof import retrieve_as_of
from ..operators.schema import schema_differences, schema_profile
from ..sources.io import read_transactions, staged, verify, work_dir, write_gold
from ..sources.known import KnownKeys
from ..sources.snapshots import Conflict, history, open_snapshot, publish
from ..spec import GOLD, GOLD_SCHEMA, RAW, RAW_SCHEMA, TableSpec
from . import fixtures as X
from . import modeling as M
from . import report
from .folds import block_statistics, fold_selection, rolling_folds
from .pipeline import run_cleaning, to_gold, with_event_time
from .scorecard import learn_scorecard, model_table, score_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINES = TableSpec(target="returned", timestamp="shipped", id="line_id", amount="price", kind="status", numerics=("price", "quantity", "discount"),
                  categoricals=("status", "line"), identifiers=("line_id",), suspects=("discount",), incomplete="discount")
TIMED = replace(RAW, timestamp="event_timestamp")
SEVEN = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
FIVE = [0.01, 0.05, 0.5, 0.95, 0.99]


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return with_event_time(X.raw(spark, sf))


# ---------------------------------------------------------------- cleaning

@_add("rate_by_type", f"""with {X.RAW_CTE} select transaction_type, count(*) as row_count, sum(is_fraud::int)::bigint as positive_count, round(avg(amount), 6) as amount_mean,
 round(median(amount), 6) as amount_median, sum(is_fraud::int)::double / count(*) as positive_rate from raw group by 1""")
def rate_by_type(spark, sf):
    return _rounded(P.type_summary(X.raw(spark, sf), RAW, "transaction_type"), "amount_mean", "amount_median")


_CLEANED = f"""{X.DIRTY_CTE}, d as (select distinct * from dirty), a as (select * from d where not coalesce(amount < 0, false)),
 g as (select *, try_cast(timestamp as timestamp) as event_timestamp from a), k as (select * from g where event_timestamp is not null)"""


@_add("cleaning_stats", f"""with {_CLEANED} select (select count(*) from dirty) as initial_rows, (select count(*) from dirty) - (select count(*) from d) as duplicate_rows_removed,
 (select count(*) from d) - (select count(*) from a) as invalid_amount_rows, (select count(*) from a) - (select count(*) from k) as invalid_timestamp_rows, (select count(*) from k) as final_rows""")
def cleaning_stats(spark, sf):
    return C.cleaning_stats(X.dirty(spark, sf), RAW)


@_add("gold_table", f"""with {_CLEANED} select transaction_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') as event_timestamp, transaction_type, merchant_category, location, device_used,
 payment_channel, amount, time_since_last_transaction, spending_deviation_score, velocity_score, geo_anomaly_score, is_fraud::tinyint as is_fraud from k""")
def gold_table(spark, sf):
    return to_gold(X.dirty(spark, sf)).withColumn("event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_add("duplicate_rows", f"with {X.DIRTY_CTE} select (select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) as duplicates")
def duplicate_rows(spark, sf):
    return C.duplicate_count(X.dirty(spark, sf))


@_add("duplicate_ids", f"with {X.LINES_CTE} select count(*) - count(distinct line_id) - max((line_id is null)::int) as duplicates from li")
def duplicate_ids(spark, sf):
    return C.duplicate_count(X.lines(spark, sf), ["line_id"])


@_add("amount_counts", f"""with {X.DIRTY_CTE} select count(*) filter (amount < 0) as negative_rows, count(*) filter (amount = 0) as zero_rows, count(*) filter (amount is null) as missing_rows,
 count(*) filter (try_cast(timestamp as timestamp) is null) as invalid_timestamps from dirty""")
def amount_counts(spark, sf):
    return C.count_where(X.dirty(spark, sf), {"negative_rows": F.col("amount") < 0, "zero_rows": F.col("amount") == 0, "missing_rows": F.col("amount").isNull(),
                                              "invalid_timestamps": parse_iso(F.col("timestamp")).isNull()})


# ---------------------------------------------------------------- sources and sinks

def _raw_csv(spark, sf) -> str:
    """The dirty table as CSV with a header, in the shared folder."""
    path = work_dir(spark, "raw-csv")
    X.dirty(spark, sf).write.csv(path, header=True)
    return path


_GOLD_SQL = ORACLES["gold_table"]


@_add("published_gold", _GOLD_SQL)
def published_gold(spark, sf):
    """Read typed CSV, check, clean, publish, report, verify, and read what was published."""
    done = run_cleaning(spark, _raw_csv(spark, sf), work_dir(spark, "gold"), work_dir(spark, "report"))
    return done.gold.withColumn("event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_ODD = """case when cast(substr(transaction_id, 2) as bigint) % 10 = 0 then concat('x "y", z ', device_used) when cast(substr(transaction_id, 2) as bigint) % 10 = 1 then concat(device_used, chr(10), 'two lines')
 when cast(substr(transaction_id, 2) as bigint) % 10 = 2 then concat(device_used, chr(92)) else device_used end"""


@_add("gold_csv", f", {_ODD.replace('device_used', 'k.device_used')} as device_used,".join(_GOLD_SQL.rsplit(", device_used,", 1)))
def gold_csv(spark, sf):
    """The gold table, with quotes, separators, line breaks and backslashes in a field, written as CSV and read again with its types."""
    gold = to_gold(X.dirty(spark, sf)).withColumn("device_used", F.expr(_ODD.replace("chr(92)", "char(92)")))
    back = read_transactions(spark, write_gold(gold, work_dir(spark, "gold-csv"), fmt="csv"), GOLD_SCHEMA)
    return back.withColumn("event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_add("published_checks", f"""with {_CLEANED}, x as (select count(*)::double as n, sum(is_fraud::int)::double as p, """ + " + ".join(f"(count(*) - count({c}))" for c in RAW.gold) + """ as m from k),
 c as (select 'run' as version, unnest(['rows', 'columns', 'missing_values_total', 'positive_rows']) as "check", unnest([n, 13.0::double, m::double, p]) as expected, unnest([n, 13.0::double, m::double, p]) as actual from x
  union all select 'cut short', unnest(['rows', 'columns', 'positive_rows']), unnest([n, 13.0::double, p]), unnest([(select count(*) filter (amount > 50)::double from k), 13.0::double, (select count(*) filter (amount > 50 and is_fraud)::double from k)]) from x)
 select version, "check", expected, actual, expected = actual as ok from c""")
def published_checks(spark, sf):
    """What a run observed while writing held against what is published; and against a version that lost rows, which the checks must tell."""
    path = work_dir(spark, "gold")
    done = run_cleaning(spark, _raw_csv(spark, sf), path, work_dir(spark, "report"))
    facts = done.snapshot.facts
    publish(done.gold.where("amount > 50"), path, base=done.snapshot.version)
    short = verify(open_snapshot(spark, path), {k: facts[k] for k in ("rows", "columns", "positive_rows")}, "is_fraud")
    return done.checks.select(F.lit("run").alias("version"), "*").unionByName(short.select(F.lit("cut short").alias("version"), "*"))


@_add("snapshot_history", f"""with {_CLEANED} select unnest([1, 2, 3])::bigint as version, unnest([0, (select count(*) from k), (select count(*) from k where amount > 50)])::bigint as rows, unnest([0.0::double, (select count(*)::double from k), -1.0::double]) as fact""")
def snapshot_history(spark, sf):
    """Three versions of a table, one writer that comes too late, and the rows that each version still shows."""
    path, gold = work_dir(spark, "gold"), to_gold(X.dirty(spark, sf))
    publish(gold.limit(0), path, base=0, facts={"rows": 0})
    second = publish(gold, path, base=1, facts={"rows": gold.count()})
    old = open_snapshot(spark, path)
    try:
        publish(gold.limit(1), path, base=1)
    except Conflict:
        publish(old.where("amount > 50"), path, base=second.version)
    rows = [open_snapshot(spark, path, v).agg(F.lit(v).cast("long").alias("version"), F.count(F.lit(1)).alias("rows")) for v in (1, 2, 3)]
    facts = history(spark, path).select("version", F.coalesce(F.try_element_at("facts", F.lit("rows")), F.lit(-1.0)).alias("fact"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).join(facts, "version")


@_add("csv_preview", f"with {X.DIRTY_CTE} select least(5, count(*)) as rows, 18 as columns, 18 as text_columns from dirty")
def csv_preview(spark, sf):
    seen = read_transactions(spark, _raw_csv(spark, sf), RAW_SCHEMA, preview=5)
    return seen.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(seen.columns)).alias("columns"), F.lit(sum(t == "string" for _, t in seen.dtypes)).alias("text_columns"))


@_add("input_guard", f"with {X.DIRTY_CTE} select 'there' as path, count(*) as rows, '' as error from dirty union all select 'not there', 0, 'FileNotFoundError'")
def input_guard(spark, sf):
    """Rows of a table that is there, and the error for one that is not."""
    path = _raw_csv(spark, sf)
    out = read_transactions(spark, path, RAW_SCHEMA).agg(F.lit("there").alias("path"), F.count(F.lit(1)).alias("rows"), F.lit("").alias("error"))
    try:
        read_transactions(spark, f"{path}-none", RAW_SCHEMA)
        error = ""
    except FileNotFoundError as e:
        error = type(e).__name__
    return out.unionByName(out.limit(0).unionByName(spark.range(1).select(F.lit("not there").alias("path"), F.lit(0).cast("long").alias("rows"), F.lit(error).alias("error"))))


@_add("schema_contract", f"""with {X.RAW_CTE}, have as (select column_name as c from (describe select * exclude (device_hash), device_hash as device_key, 1 as extra from raw)), want as (select column_name as c from (describe select * from raw))
 select 'missing' as kind, c as "column" from (select c from want except select c from have) union all select 'unexpected', c from (select c from have except select c from want)""")
def schema_contract(spark, sf):
    changed = X.raw(spark, sf).withColumnRenamed("device_hash", "device_key").withColumn("extra", F.lit(1))
    return schema_differences(changed, RAW_SCHEMA.names)


# ---------------------------------------------------------------- profiles

@_add("class_distribution", f"with {X.RAW_CTE} select is_fraud::bigint as is_fraud, count(*) as row_count, count(*)::double / (select count(*) from raw) * 100 as percentage from raw group by 1")
def class_distribution(spark, sf):
    return P.class_distribution(X.raw(spark, sf), RAW)


@_add("class_distribution_lines", f"with {X.LINES_CTE} select returned::bigint as returned, count(*) as row_count, count(*)::double / (select count(*) from li) * 100 as percentage from li group by 1")
def class_distribution_lines(spark, sf):
    return P.class_distribution(X.lines(spark, sf), LINES)


_COLS = ("transaction_id timestamp sender_account receiver_account amount transaction_type merchant_category location device_used is_fraud fraud_type "
         "time_since_last_transaction spending_deviation_score velocity_score geo_anomaly_score payment_channel ip_address device_hash").split()


def _each(table: str, columns, form: str) -> str:
    return " union all ".join(f"select {form.format(c=c)} from {table}" for c in columns)


@_add("missing_by_column", f"with {X.DIRTY_CTE} " + _each("dirty", _COLS, "'{c}' as column, count(*) - count({c}) as missing_count, (count(*) - count({c}))::double / count(*) * 100 as missing_percent"))
def missing_by_column(spark, sf):
    return P.missing_summary(X.dirty(spark, sf))


@_add("missing_total", f"with {X.DIRTY_CTE} select sum(m)::bigint as missing_values_total from (" + _each("dirty", _COLS, "count(*) - count({c}) as m") + ")")
def missing_total(spark, sf):
    return P.missing_total(X.dirty(spark, sf))


_TYPES = {"amount": "double", "is_fraud": "boolean", "time_since_last_transaction": "double", "spending_deviation_score": "double", "velocity_score": "smallint", "geo_anomaly_score": "double"}


@_add("schema_profile", f"with {X.RAW_CTE} " + " union all ".join(
    f"select '{c}' as column, '{_TYPES.get(c, 'string')}' as dtype, count(*) - count({c}) as missing_count, (count(*) - count({c}))::double / count(*) * 100 as missing_percent, count(distinct {c}) as unique_count from raw" for c in _COLS))
def schema_profile_raw(spark, sf):
    return schema_profile(X.raw(spark, sf))


@_add("id_cardinality", f"with {X.RAW_CTE} " + _each("raw", RAW.identifiers, "'{c}' as column, count(distinct {c}) as unique_count, count(distinct {c})::double / count(*) as cardinality_ratio, count({c}) - count(distinct {c}) as repeated_non_missing_values"))
def id_cardinality(spark, sf):
    return P.cardinality(X.raw(spark, sf), list(RAW.identifiers))


@_add("overview", f"""with {X.DIRTY_CTE}, t as (select *, try_cast(timestamp as timestamp) as e from dirty)
 select 'rows' as metric, count(*)::varchar as value from t union all select 'columns', '18' union all select 'date_min', strftime(min(e), '%Y-%m-%d %H:%M:%S.%f') from t
 union all select 'date_max', strftime(max(e), '%Y-%m-%d %H:%M:%S.%f') from t union all select 'invalid_timestamps', (count(*) - count(e))::varchar from t
 union all select 'exact_duplicate_rows', ((select count(*) from dirty) - (select count(*) from (select distinct * from dirty)))::varchar
 union all select 'duplicate_ids', (count(*) - count(distinct transaction_id))::varchar from t
 union all select 'negative_amount_rows', (count(*) filter (amount < 0))::varchar from t union all select 'zero_amount_rows', (count(*) filter (amount = 0))::varchar from t
 union all select 'missing_values_total', sum(m)::varchar from (""" + _each("dirty", _COLS, "count(*) - count({c}) as m") + """) union all select 'positive_rows', sum(is_fraud::int)::varchar from t
 union all select 'positive_percent', printf('%.4f', avg(is_fraud::int) * 100) from t union all select 'missing_columns', '' union all select 'unexpected_columns', ''""")
def overview(spark, sf):
    return P.overview(X.dirty(spark, sf), RAW, expected=RAW_SCHEMA.names)


def _describe_sql(table: str, columns, probabilities) -> str:
    ps = ", ".join(f"round(quantile_cont({{c}}::double, {p}), 6) as p{p * 100:g}".replace("p0.", "p0_") for p in probabilities)
    return _each(table, columns, "'{c}' as feature, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(min({c})::double, 6) as min, " + ps + ", round(max({c})::double, 6) as max")


def _described(df, columns, ps):
    d = P.describe(df, columns, ps)
    return _rounded(d, *[c for c in d.columns if c not in ("feature", "count")])


@_add("describe_raw", f"with {X.LINES_CTE} " + _describe_sql("li", LINES.numerics, SEVEN))
def describe_raw(spark, sf):
    return _described(X.lines(spark, sf), list(LINES.numerics), SEVEN)


@_add("describe_clean", f"with {X.RAW_CTE} " + _describe_sql("raw", RAW.numerics, FIVE))
def describe_clean(spark, sf):
    return _described(X.raw(spark, sf), list(RAW.numerics), FIVE)


@_add("missing_by_class", f"with {X.RAW_CTE}, m as (" + _each("raw", [c for c in _COLS if c != "is_fraud"], "'{c}' as column, is_fraud::bigint as is_fraud, ({c} is null)::int as x") + """)
 select "column", is_fraud, count(*) as row_count, sum(x)::bigint as missing_count, sum(x)::double / count(*) * 100 as missing_percent from m
 group by "column", is_fraud qualify sum(sum(x)) over (partition by "column") > 0""")
def missing_by_class(spark, sf):
    return P.missing_by_class(X.raw(spark, sf), RAW)


@_add("leakage_audit", f"""with {X.RAW_CTE} select 'fraud_type' as column, is_fraud::bigint as is_fraud, count(*) as row_count, count(fraud_type) as present,
 count(fraud_type)::double / count(*) * 100 as present_percent from raw group by is_fraud""")
def leakage_audit(spark, sf):
    return P.presence_by_class(X.raw(spark, sf), RAW, ["fraud_type"])


_CATS = _each("raw", RAW.categoricals, "'{c}' as feature, {c} as category, is_fraud::int as y")


@_add("category_profile", f"with {X.RAW_CTE}, c as ({_CATS}) select feature, category, count(*) as row_count, sum(y)::bigint as positive_count, count(*)::double / (select count(*) from raw) * 100 as row_percent, sum(y)::double / count(*) as positive_rate from c group by 1, 2")
def category_profile(spark, sf):
    return P.category_profile(X.raw(spark, sf), RAW)


@_add("type_top10", f"""with {X.LINES_CTE} select line, count(*) as row_count, sum(returned)::bigint as positive_count, round(avg(price), 4) as amount_mean, round(median(price), 4) as amount_median,
 sum(returned)::double / count(*) as positive_rate from li group by 1 order by positive_rate desc, row_count desc, line limit 10""")
def type_top10(spark, sf):
    s = P.type_summary(X.lines(spark, sf), LINES, "line")
    return _rounded(O.top_k(s, [F.desc("positive_rate"), F.desc("row_count"), "line"], 10), "amount_mean", "amount_median", digits=4)


_RATE = "count(*) as row_count, sum(is_fraud::int)::bigint as positive_count, sum(is_fraud::int)::double / count(*) as positive_rate"


@_add("hourly", f"with {X.RAW_CTE} select hour(event_timestamp)::int as hour, {_RATE} from ev where event_timestamp is not null group by 1")
def hourly(spark, sf):
    return P.rate_by_time(X.raw(spark, sf), RAW, "hour")


@_add("weekday", f"with {X.RAW_CTE} select (isodow(event_timestamp) - 1)::int as weekday, {_RATE} from ev where event_timestamp is not null group by 1")
def weekday(spark, sf):
    return P.rate_by_time(X.raw(spark, sf), RAW, "weekday")


@_add("missingness_bias", f"""with {X.RAW_CTE} select case when time_since_last_transaction is null then 'missing' else 'observed' end as status, count(*) as row_count, sum(is_fraud::int)::bigint as positive_count,
 count(*)::double / (select count(*) from raw) * 100 as row_percent, sum(is_fraud::int)::double / count(*) * 100 as positive_percent from raw group by 1""")
def missingness_bias(spark, sf):
    return P.missingness_bias(X.raw(spark, sf), RAW, "time_since_last_transaction")


# ---------------------------------------------------------------- order statistics and risk

def _edges(table: str, x: str, q: int, name: str = "e") -> str:
    return f"{name} as (select list_sort(list_distinct(quantile_cont({x}::double, [{', '.join(f'{i / q}' for i in range(q + 1))}]))) as {name} from {table})"


def _bin(e: str, x: str) -> str:
    return f"case when len({e}) > 1 and {x} is not null then len(list_filter({e}[2:len({e}) - 1], lambda v: v < {x})) end"


def _lift_sql(cte: str, table: str, x: str, y: str, q: int) -> str:
    return f"""with {cte}, {_edges(table, x, q)}, b as (select {_bin('e', x)} as b, {x} as x, {y} as y from {table}, e), g as (
 select b, min(x) as low, max(x) as high, count(*) as row_count, sum(y)::bigint as positive_count from b where b is not null group by b)
 select row_number() over (order by b)::int as quantile, low, high, row_count, positive_count, positive_count::double / row_count as positive_rate,
 round(positive_count::double / row_count / (select sum(y)::double / count(y) from b), 9) as lift from g"""


@_add("amount_lift", _lift_sql(X.LINES_CTE, "li", "price", "returned", 20))
def amount_lift(spark, sf):
    return _rounded(R.quantile_lift(X.lines(spark, sf), LINES, "price"), "lift", digits=9)


@_add("amount_lift_ties", _lift_sql(X.LINES_CTE, "li", "quantity", "returned", 10))
def amount_lift_ties(spark, sf):
    return _rounded(R.quantile_lift(X.lines(spark, sf), LINES, "quantity", 10), "lift", digits=9)


@_add("amount_lift_raw", _lift_sql(X.RAW_CTE, "raw", "amount", "is_fraud::int", 20))
def amount_lift_raw(spark, sf):
    return _rounded(R.quantile_lift(X.raw(spark, sf), RAW, "amount"), "lift", digits=9)


_WILSON = """s as (select feature, category, count(*) as row_count, sum(y)::bigint as positive_count, sum(y)::double / count(*) as p, count(*)::double as n from c where category is not null group by 1, 2),
 w as (select *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) as mid, 1.96 * sqrt(greatest((p * (1 - p) + 3.8416 / (4 * n)) / n, 0)) / (1 + 3.8416 / n) as margin from s)"""


@_add("wilson_rates", f"with {X.RAW_CTE}, c as ({_CATS}), {_WILSON} select feature, category, row_count, positive_count, p as positive_rate, round(mid - margin, 9) as ci_low, round(mid + margin, 9) as ci_high from w")
def wilson_rates(spark, sf):
    return _rounded(R.category_rates(X.raw(spark, sf), RAW), "ci_low", "ci_high", digits=9)


@_add("errorbar_series", f"""with {X.RAW_CTE}, c as ({_CATS}), {_WILSON} select (row_number() over (order by p, feature, category) - 1)::int as position, feature || ' = ' || category as label, round(p * 100, 9) as percent,
 round((p - (mid - margin)) * 100, 7) as below, round(((mid + margin) - p) * 100, 7) as above from w""")
def errorbar_series(spark, sf):
    return _rounded(_rounded(report.series_errorbars(X.raw(spark, sf), RAW), "percent", digits=9), "below", "above", digits=7)


@_add("hour_weekday", f"""with {X.RAW_CTE} select (isodow(event_timestamp) - 1)::int as weekday, hour(event_timestamp)::int as hour, count(*) as row_count, round(avg(is_fraud::int) * 100, 6) as positive_percent
 from ev where event_timestamp is not null group by 1, 2""")
def hour_weekday(spark, sf):
    return _rounded(report.series_hour_weekday(_ev(spark, sf), TIMED), "positive_percent")


def _weekly_sql(cte: str, table: str, ts: str, y: str) -> str:
    return f"""with {cte}, g as (select date_trunc('week', {ts})::date as w, count(*) as row_count, sum({y})::bigint as positive_count, min({ts})::date as lo, max({ts})::date as hi from {table} where {ts} is not null group by 1),
 r as (select *, positive_count::double / row_count * 100 as pct from g) select w::varchar as week, row_count, positive_count, round(pct, 6) as positive_percent,
 round(avg(pct) over (order by w rows between 3 preceding and current row), 6) as rolling_percent,
 (w = min(w) over () and lo > w) or (w = max(w) over () and hi < w + 6) as is_partial_week from r"""


def _weekly(df, spec):
    return _rounded(R.weekly_stability(df, spec), "positive_percent", "rolling_percent").withColumn("week", F.to_date("week").cast("string"))


@_add("weekly_stability", _weekly_sql(X.LINES_CTE, "li", "shipped", "returned"))
def weekly_stability(spark, sf):
    return _weekly(X.lines(spark, sf), LINES)


@_add("weekly_stability_raw", _weekly_sql(X.RAW_CTE, "ev", "event_timestamp", "is_fraud::int"))
def weekly_stability_raw(spark, sf):
    return _weekly(_ev(spark, sf), TIMED)


_NUM = [*RAW.numerics, "is_fraud"]


def _corr_sql() -> str:
    cast = ", ".join(f"{c}::int::double as {c}" if c == "is_fraud" else f"{c}::double as {c}" for c in _NUM)
    rows = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from n" for a in _NUM for b in _NUM)
    return f"with {X.RAW_CTE}, n as (select {cast} from raw), m as ({rows})"


def _corr(spark, sf):
    raw = X.raw(spark, sf)
    return R.correlation(raw.withColumn("is_fraud", F.col("is_fraud").cast("int")), _NUM)


@_add("correlation_long", _corr_sql() + " select a, b, round(r, 6) as r from m")
def correlation_long(spark, sf):
    return _rounded(_corr(spark, sf), "r")


@_add("strongest_corr", _corr_sql() + " select a, round(r, 6) as r from m where b = 'is_fraud' and a <> 'is_fraud' order by abs(m.r) desc, a limit 1")
def strongest_corr(spark, sf):
    return _rounded(R.strongest(_corr(spark, sf), "is_fraud"), "r")


@_add("score_surface", f"""with {X.RAW_CTE}, {_edges('raw', 'spending_deviation_score', 10, 'e1')}, {_edges('raw', 'geo_anomaly_score', 10, 'e2')},
 b as (select {_bin('e1', 'spending_deviation_score')}::int as x, {_bin('e2', 'geo_anomaly_score')}::int as y, is_fraud::int as f from raw, e1, e2)
 select x as spending_deviation_score_bin, y as geo_anomaly_score_bin, count(*) as row_count, round(avg(f) * 100, 6) as positive_percent from b where x is not null and y is not null group by 1, 2""")
def score_surface(spark, sf):
    return _rounded(report.series_surface(X.raw(spark, sf), RAW), "positive_percent")


@_add("metric_ranges", f"""with {X.RAW_CTE}, {_edges('raw', 'amount', 20)}, l as (select {_bin('e', 'amount')} as b, avg(is_fraud::int) as r from raw, e where amount is not null group by 1),
 c as ({_CATS}), k as (select avg(y) as r from c where category is not null group by feature, category),
 w as (select date_trunc('week', event_timestamp) as w, avg(is_fraud::int) * 100 as r from ev where event_timestamp is not null group by 1), v as (select avg(r) over (order by w rows between 3 preceding and current row) as r from w)
 select 'amount_lift_range' as metric, round((max(r) - min(r)) / (select avg(is_fraud::int) from raw), 6) as value from l union all
 select 'category_rate_range', round(max(r) - min(r), 6) from k union all select 'weekly_rate_range', round(max(r) - min(r), 6) from v""")
def metric_ranges(spark, sf):
    return _rounded(R.metric_ranges(_ev(spark, sf), TIMED), "value")


@_add("ecdf_by_class", f"with {X.LINES_CTE} select distinct returned, price as value, cume_dist() over (partition by returned order by price) as cumulative from li")
def ecdf_by_class(spark, sf):
    return O.ecdf(X.lines(spark, sf), "price", "returned")


@_add("ecdf_by_class_raw", f"with {X.RAW_CTE} select distinct is_fraud, amount as value, cume_dist() over (partition by is_fraud order by amount) as cumulative from raw where amount is not null")
def ecdf_by_class_raw(spark, sf):
    return O.ecdf(X.raw(spark, sf), "amount", "is_fraud")


@_add("histogram_amount", f"""with {X.LINES_CTE}, m as (select min(price) as lo, max(price) as hi from li), b as (select least(79, floor((price - lo) / (hi - lo) * 80))::int + 1 as bin, lo, hi from li, m)
 select bin, round(lo + (hi - lo) / 80 * (bin - 1), 6) as low, round(lo + (hi - lo) / 80 * bin, 6) as high, count(*) as n from b group by bin, lo, hi""")
def histogram_amount(spark, sf):
    return _rounded(O.histogram(X.lines(spark, sf), "price"), "low", "high")


@_add("series_missing", f"with {X.RAW_CTE}, m as (" + _each("raw", _COLS, "'{c}' as column, (count(*) - count({c}))::double / count(*) * 100 as missing_percent") + ") select * from m where missing_percent > 0")
def series_missing(spark, sf):
    return report.series_missing(X.raw(spark, sf))


@_add("series_missingness", f"""with {X.RAW_CTE} select case when time_since_last_transaction is null then 'missing' else 'observed' end as status, count(*)::double / (select count(*) from raw) * 100 as row_percent,
 sum(is_fraud::int)::double / count(*) * 100 as positive_percent, round((select avg(is_fraud::int) from raw) * 100, 9) as overall_percent from raw group by 1""")
def series_missingness(spark, sf):
    return _rounded(report.series_missingness(X.raw(spark, sf), RAW), "overall_percent", digits=9)


@_add("series_hours", f"with {X.RAW_CTE} select hour(event_timestamp)::int as hour, sum(is_fraud::int)::double / count(*) * 100 as positive_percent from ev where event_timestamp is not null group by 1")
def series_hours(spark, sf):
    return report.series_hours(X.raw(spark, sf), RAW)


# ---------------------------------------------------------------- report, samples, second tier

@_add("quality_report", f"""with {_CLEANED}, t as (select transaction_type as k, count(*) as n, avg(is_fraud::int) as r from dirty group by 1 order by r desc, n desc, k limit 10), m as ("""
      + _each("dirty", _COLS, "'{c}' as c, (count(*) - count({c}))::double as n, (count(*) - count({c}))::double / count(*) * 100 as p") + f"""), q as ({_describe_sql('dirty', RAW.numerics, [0.5])}), x as (
 select 'cleaning' as section, 'rows' as item, unnest(['initial_rows', 'duplicate_rows_removed', 'invalid_amount_rows', 'invalid_timestamp_rows', 'final_rows']) as metric,
  unnest([(select count(*) from dirty), (select count(*) from dirty) - (select count(*) from d), (select count(*) from d) - (select count(*) from a), (select count(*) from a) - (select count(*) from k), (select count(*) from k)])::double as value
 union all select 'gold', 'rows', unnest(['rows_after', 'positive_after']), unnest([(select count(*) from k)::double, (select sum(is_fraud::int) from k)::double])
 union all select 'missing', c, unnest(['missing_count', 'missing_percent']), unnest([n, p]) from m where n > 0
 union all select 'target', is_fraud::int::varchar, unnest(['row_count', 'percentage']), unnest([count(*)::double, count(*)::double / (select count(*) from dirty) * 100]) from dirty group by is_fraud
 union all select 'kind', k, unnest(['row_count', 'positive_rate']), unnest([n::double, r]) from t
 union all select 'numeric', feature, unnest(['mean', 'std', 'min', 'p50', 'max']), unnest([mean, std, min, p50, max]) from q
 union all select 'decision', 'missing kept: time_since_last_transaction', 'rows', (select count(*) - count(time_since_last_transaction) from k)::double
 union all select 'decision', unnest(['identifiers dropped: device_hash, ip_address, receiver_account, sender_account', 'label-derived dropped: fraud_type', 'columns added: event_timestamp']), 'columns', unnest([4.0::double, 1.0::double, 1.0::double]))
 select section, item, metric, round(value, 6) as value from x""")
def quality_report(spark, sf):
    dirty = X.dirty(spark, sf)
    return _rounded(report.quality_report(dirty, to_gold(dirty), RAW), "value")


_EVIDENCE = """avg(is_fraud::int) * 100 as pos, avg((time_since_last_transaction is null)::int) * 100 as gap, avg(is_fraud::int) filter (time_since_last_transaction is null) * 100 as gp,
 avg(is_fraud::int) filter (time_since_last_transaction is not null) * 100 as gn, avg(amount) as mean, median(amount) as med"""
_TOPICS = {("size", "rows"): "n", ("label", "positive_percent"): "pos", ("gaps", "percent"): "gap", ("gaps", "positive_percent"): "gp", ("gaps", "observed_positive_percent"): "gn",
           ("amount", "mean"): "mean", ("amount", "median"): "med", ("amount", "mean_to_median"): "mean / med", ("gaps", "positive_difference"): "abs(gp - gn)"}
_RANGES = ORACLES["metric_ranges"].replace("round((max(r) - min(r)) / (select avg(is_fraud::int) from raw), 6)", "(max(r) - min(r)) / (select avg(is_fraud::int) from raw)").replace("round(max(r) - min(r), 6)", "max(r) - min(r)")


def _shown(topics: dict, columns: int, source: str) -> str:
    every = {**topics, ("size", "columns"): str(columns)}
    return " union all ".join(f"select '{t}' as topic, '{m}' as metric, ({v})::double as value from {source}" for (t, m), v in every.items())


_FINDINGS = f"""with {X.RAW_CTE}, rng as ({_RANGES}), top as (with {_corr_sql().removeprefix("with ")} select a, r from m where b = 'is_fraud' and a <> 'is_fraud' order by abs(m.r) desc, a limit 1),
 f as (select count(*) as n, {_EVIDENCE} from raw), x as ({_shown(_TOPICS, 19, "f")} union all select 'risk', metric, value from rng union all select 'correlation', 'strongest ' || a, r from top)"""


@_add("findings", _FINDINGS + " select topic, metric, round(value, 6) as value from x")
def findings(spark, sf):
    return _rounded(report.findings(_ev(spark, sf), TIMED), "value")


_OBSERVED = f"""with {X.DIRTY_CTE}, f as (select count(*) as n, {_EVIDENCE}, count(*) filter (try_cast(timestamp as timestamp) is null) as times, count(*) filter (amount < 0) as neg, count(*) filter (amount = 0) as zero,
 count(*) filter (time_since_last_transaction is null and is_fraud) as mp, count(*) filter (fraud_type is not null and not is_fraud) as told,
 count(*) - (select count(*) from (select distinct * from dirty)) as same, count(transaction_id) - count(distinct transaction_id) as ids, {", ".join(f"count(distinct {c}) as u_{c}" for c in RAW.identifiers)} from dirty), x as (""" + _shown(
    {**_TOPICS, ("times", "unreadable"): "times", ("amount", "negative"): "neg", ("amount", "zero"): "zero", ("gaps", "on_positive"): "mp", ("leak", "fraud_type on negative"): "told", ("repeats", "rows"): "same",
     ("repeats", "ids"): "ids", **{("identifiers", f"values of {c}"): f"u_{c}" for c in RAW.identifiers}}, 18, "f") + ")"


@_add("observations", _OBSERVED + " select topic, metric, round(value, 6) as value from x")
def observations(spark, sf):
    return _rounded(report.observations(X.dirty(spark, sf), RAW), "value")


@_add("advice", _OBSERVED + ", rules(metric, op, bound, action) as (values " + ", ".join(f"('{m}', '{o}', {b}, '{a}')" for m, o, b, a in report.ADVICE) + """)
 select topic || '.' || x.metric as metric, round(value, 6) as value, action from x join rules r on r.metric = topic || '.' || x.metric where case when op = '>' then value > bound else value < bound end""")
def advice(spark, sf):
    return _rounded(report.advice(X.dirty(spark, sf), RAW, raw=True), "value")


_HASH = "('0x' || substr(md5('42:' || transaction_id), 1, 13))::bigint"


@_add("sample_n", f"with {X.RAW_CTE} select * from raw qualify row_number() over (order by {_HASH}, transaction_id) <= 2500")
def sample_n(spark, sf):
    return O.sample_n(X.raw(spark, sf), 2500, 42, "transaction_id", clamp=True)


@_add("sample_guard", f"with {X.RAW_CTE} select 'enough' as asked, 100::bigint as rows, '' as error union all select 'too many', 0, 'ValueError'")
def sample_guard(spark, sf):
    """A sample of exactly n rows where there are as many, and the error where there are not."""
    raw = X.raw(spark, sf)
    out = O.sample_n(raw, 100, 42, "transaction_id").agg(F.lit("enough").alias("asked"), F.count(F.lit(1)).alias("rows"), F.lit("").alias("error"))
    try:
        O.sample_n(raw, raw.count() + 1, 42, "transaction_id")
        error = ""
    except ValueError as e:
        error = type(e).__name__
    return out.unionByName(spark.range(1).select(F.lit("too many").alias("asked"), F.lit(0).cast("long").alias("rows"), F.lit(error).alias("error")))


@_add("sample_by_class", f"with {X.RAW_CTE} select * from raw qualify row_number() over (partition by is_fraud order by {_HASH}, transaction_id) <= 300")
def sample_by_class(spark, sf):
    return O.sample_n(X.raw(spark, sf), 300, 42, "transaction_id", by="is_fraud", clamp=True)


@_add("ecdf_lines", f"""with {X.LINES_CTE}, g as (select returned, price as value, count(*) as n from li group by 1, 2),
 r as (select *, sum(n) over (partition by returned order by value) as upto, sum(n) over (partition by returned) as total from g), t as (select *, greatest(1, total // 1000) as step from r)
 select returned, value, upto::double / total as cumulative, round(log10(value), 9) as log10_value from t where upto // step > (upto - n) // step or upto = total""")
def ecdf_lines(spark, sf):
    return _rounded(report.series_ecdf(X.lines(spark, sf), LINES), "log10_value", digits=9)


@_add("series_classes", f"with {X.LINES_CTE} select returned::bigint::varchar as label, count(*) as row_count from li group by 1")
def series_classes(spark, sf):
    return report.series_classes(X.lines(spark, sf), LINES)


@_add("series_lift", f"select quantile, lift from ({ORACLES['amount_lift']})")
def series_lift(spark, sf):
    return _rounded(report.series_lift(X.lines(spark, sf), LINES), "lift", digits=9)


@_add("series_weekly", ORACLES["weekly_stability_raw"])
def series_weekly(spark, sf):
    return _rounded(report.series_weekly(_ev(spark, sf), TIMED), "positive_percent", "rolling_percent").withColumn("week", F.to_date("week").cast("string"))


@_add("series_correlation", ORACLES["correlation_long"])
def series_correlation(spark, sf):
    return _rounded(report.series_correlation(X.raw(spark, sf).withColumn("is_fraud", F.col("is_fraud").cast("int")), RAW), "r")


_SPLIT = "u as (select *, epoch_us(event_timestamp)::double as us from ev), q as (select quantile_cont(us, 0.7) as a, quantile_cont(us, 0.85) as b from u)"


@_add("time_split", f"""with {X.RAW_CTE}, {_SPLIT} select case when us <= a then 'train' when us <= b then 'validation' else 'test' end as split, count(*) as row_count, sum(is_fraud::int)::bigint as positive_count from u, q group by 1""")
def time_split(spark, sf):
    return M.time_split(_ev(spark, sf), TIMED).groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("is_fraud").cast("int")).alias("positive_count"))


@_add("feature_sets", f"""with {X.RAW_CTE} select transaction_id, round(ln(1 + amount), 9) as amount_log1p, hour(event_timestamp)::int as hour, (isodow(event_timestamp) - 1)::int as weekday, month(event_timestamp)::int as month,
 (time_since_last_transaction is null)::int as time_since_last_transaction_missing from ev""")
def feature_sets(spark, sf):
    f = M.add_features(_ev(spark, sf), TIMED, ["amount_log", "time_parts", "missing_flag"])
    return _rounded(f.select("transaction_id", "amount_log1p", "hour", "weekday", "month", "time_since_last_transaction_missing"), "amount_log1p", digits=9)


def _halves(spark, sf):
    ev = _ev(spark, sf)
    first = F.pmod(F.substring("transaction_id", 2, 20).cast("long"), F.lit(2)) == 0
    return ev.where(first), ev.where(~first)


@_add("psi_drift", f"""with {X.RAW_CTE}, o as (select * from raw where cast(substr(transaction_id, 2) as bigint) % 2 = 0), n as (select * from raw where cast(substr(transaction_id, 2) as bigint) % 2 = 1), """ + ", ".join(
    f"""{_edges('o', c, 10, f'e{i}')}, s{i} as (select b, coalesce(sum(r), 0) as r, coalesce(sum(c), 0) as c from (
 select {_bin(f'e{i}', c)} as b, 1.0::double / (select count({c}) from o) as r, 0.0::double as c from o, e{i} where {c} is not null union all
 select {_bin(f'e{i}', c)}, 0.0::double, 1.0::double / (select count({c}) from n) from n, e{i} where {c} is not null) group by b)""" for i, c in enumerate(("amount", "geo_anomaly_score"))) + " " + " union all ".join(
    f"""select '{c}' as column, round(sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6))), 6) as psi, round(max(g), 6) as ecdf_gap from (
 select *, abs(sum(r) over (order by b) - sum(c) over (order by b)) as g from s{i})""" for i, c in enumerate(("amount", "geo_anomaly_score"))))
def psi_drift(spark, sf):
    a, b = _halves(spark, sf)
    return _rounded(M.drift(a, b, ["amount", "geo_anomaly_score"]), "psi", "ecdf_gap")


_WINDOW = """select count(*)::double as rows, (count(*) - count(amount))::double / count(*) * 100 as m1, (count(*) - count(geo_anomaly_score))::double / count(*) * 100 as m2,
 avg((geo_anomaly_score >= 0.9)::int) * 100 as flagged, avg(geo_anomaly_score) as mean, (count(*) filter (geo_anomaly_score >= 0.9 and is_fraud))::double / count(*) filter (geo_anomaly_score >= 0.9) as prec,
 (count(*) filter (geo_anomaly_score >= 0.9 and is_fraud))::double / count(*) filter (is_fraud) as rec, coalesce(sum(amount) filter (geo_anomaly_score < 0.9 and is_fraud), 0) + 5.0 * count(*) filter (geo_anomaly_score >= 0.9 and not is_fraud) as cost"""
_METRICS = {("quality", "missing_percent amount"): "m1", ("quality", "missing_percent geo_anomaly_score"): "m2", ("quality", "rows"): "rows", ("prediction", "flagged_percent"): "flagged",
            ("prediction", "score_mean"): "mean", ("performance", "precision"): "prec", ("performance", "recall"): "rec", ("cost", "expected_cost"): "cost"}


@_add("monitoring_batch", f"""with drifted as ({ORACLES["psi_drift"]}), {X.RAW_CTE}, a as ({_WINDOW} from raw where cast(substr(transaction_id, 2) as bigint) % 2 = 0), b as ({_WINDOW} from raw where cast(substr(transaction_id, 2) as bigint) % 2 = 1) """
      + " union all ".join(f"select '{x}' as section, '{m}' as metric, round(a.{c}::double, 6) as reference, round(b.{c}::double, 6) as current from a, b" for (x, m), c in _METRICS.items())
      + """ union all select 'drift', 'psi ' || "column", 0.0::double, psi from drifted""")
def monitoring_batch(spark, sf):
    a, b = _halves(spark, sf)
    return _rounded(M.monitoring_batch(a, b, RAW, ["amount", "geo_anomaly_score"], "geo_anomaly_score", 0.9, 5.0), "reference", "current")


@_add("run_log", f"""select 'run 1' as run_id, 'parameter' as kind, 'threshold' as name, '0.9' as value union all
 select 'run 1', 'metric', unnest(['initial_rows', 'final_rows']), unnest([initial_rows::varchar, final_rows::varchar]) from ({ORACLES["cleaning_stats"]})""")
def run_log(spark, sf):
    """Metrics and parameters of a run, logged and read again."""
    path = work_dir(spark, "runs")
    stats = C.cleaning_stats(X.dirty(spark, sf), RAW)
    M.log_run(spark, path, "run 1", stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("initial_rows", "final_rows")]))), {"threshold": "0.9"})
    return spark.read.parquet(path)


@_add("threshold_cost", f"""with {X.RAW_CTE}, g as (select geo_anomaly_score as s, sum(is_fraud::int) as p, count(*) as n, sum(case when is_fraud then amount else 0 end) as v from raw group by 1),
 w as (select s, sum(p) over o as tp, sum(n) over o - sum(p) over o as fp, (select sum(case when is_fraud then amount else 0 end) from raw) - sum(v) over o as fn from g window o as (order by s desc))
 select s as threshold, tp::bigint as tp, fp::bigint as fp, round(fn, 4) + 0.0::double as missed_value, round(fn + fp * 5.0, 4) + 0.0::double as cost from w""")
def threshold_cost(spark, sf):
    return _rounded(M.threshold_cost(X.raw(spark, sf), "is_fraud", "amount", 5.0, "geo_anomaly_score"), "missed_value", "cost", digits=4)


@_add("evaluation", f"""with {X.RAW_CTE}, g as (select geo_anomaly_score as s, sum(is_fraud::int)::double as dp, sum((not is_fraud)::int)::double as dn from raw group by 1),
 w as (select *, sum(dp) over (order by s desc) as tp, sum(dn) over (order by s desc) as fp from g),
 c as (select count(*) filter (is_fraud and geo_anomaly_score >= 0.5)::double as tp, count(*) filter (not is_fraud and geo_anomaly_score >= 0.5)::double as fp,
  count(*) filter (is_fraud and geo_anomaly_score < 0.5)::double as fn, count(*) filter (not is_fraud and geo_anomaly_score < 0.5)::double as tn from raw),
 x as (select unnest(['tp', 'fp', 'fn', 'tn', 'precision', 'recall', 'f1', 'roc_auc', 'pr_auc']) as metric, unnest([tp, fp, fn, tn, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn),
  (select sum(dn * (tp - dp / 2)) from w) / ((tp + fn) * (fp + tn)), (select sum(dp * tp / (tp + fp)) from w) / (tp + fn)]) as value from c)
 select metric, round(value, 9) as value from x""")
def evaluation(spark, sf):
    return _rounded(M.evaluate(X.raw(spark, sf), "is_fraud", 0.5, "geo_anomaly_score"), "value", digits=9)


@_add("class_weights", f"""with {X.RAW_CTE}, n as (select count(*)::double as n, sum(is_fraud::int)::double as p from raw) select is_fraud, round(max(case when is_fraud then n / (2 * p) else n / (2 * (n - p)) end), 9) as weight, count(*) as row_count from raw, n group by 1""")
def class_weights(spark, sf):
    w = M.class_weights(X.raw(spark, sf), RAW).groupBy("is_fraud").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("row_count"))
    return _rounded(w, "weight", digits=9)


@_add("oversample", f"""with {X.RAW_CTE}, n as (select count(*) filter (not is_fraud)::double as neg, count(*) filter (is_fraud)::double as pos from raw), w as (select greatest(1.0::double, neg * 0.2::double / (1 - 0.2::double) / pos) as want from n)
 select raw.* from raw, w, unnest(generate_series(1, case when is_fraud then floor(want)::bigint + ({_HASH} / {1 << 52}.0::double < want - floor(want))::bigint else 1 end)) u(i)""")
def oversample(spark, sf):
    return M.oversample(X.raw(spark, sf), RAW, 0.2)


_WEIGHTS = {"amount": 0.2, "time_since_last_transaction": 0.15, "spending_deviation_score": -0.05, "velocity_score": 0.1, "geo_anomaly_score": 0.3}


def _scorecard_sql() -> str:
    nums, cats = list(_WEIGHTS), RAW.categoricals
    return f"""with {_CLEANED}, {_SPLIT.replace("from ev)", "from k)")}, t as (select u.* from u, q where us <= a), s as (select u.* from u, q where us > b), f as (select {", ".join(f"median({c})::double as {c}" for c in nums)} from t),
 m as (select {", ".join(f"avg(coalesce(t.{c}, f.{c})) as m{i}, stddev_samp(coalesce(t.{c}, f.{c})) as s{i}" for i, c in enumerate(nums))}, ln((sum(is_fraud::int) + 0.5) / (count(*) - sum(is_fraud::int) + 0.5)) as o from t, f),
 w as (select feature, category, ln((sum(y) + 0.5) / (count(*) - sum(y) + 0.5)) - any_value(o) as w from ({_each("t", cats, "'{c}' as feature, {c} as category, is_fraud::int as y")}), m where category is not null group by 1, 2)
 select transaction_id, s.amount, s.is_fraud::tinyint as is_fraud, round(1 / (1 + exp(-(o + {" + ".join(f"(coalesce(s.{c}, f.{c}) - m{i}) / s{i} * {w}" for i, (c, w) in enumerate(_WEIGHTS.items()))}
 + {" + ".join(f"coalesce(w{i}.w, 0)" for i in range(len(cats)))}))), 9) as score from s, f, m """ + " ".join(f"left join w w{i} on w{i}.feature = '{c}' and w{i}.category = s.{c}" for i, c in enumerate(cats)).replace("from s, f, m left", "from s, f, m left")


def _split_gold(spark, sf):
    """Cleaned rows with their split. They are cleaned once, into a staged table: learning reads them many times."""
    return M.time_split(staged(to_gold(X.dirty(spark, sf)), "gold"), GOLD)


@_add("model_scores", _scorecard_sql().replace("from s, f, m left", "from s cross join f cross join m left"))
def model_scores(spark, sf):
    """A scorecard learned from the earlier rows as a table, and the later rows scored by joins with it."""
    split = _split_gold(spark, sf)
    card = learn_scorecard(split.where("split = 'train'"), GOLD, _WEIGHTS)
    return _rounded(score_table(split.where("split = 'test'"), GOLD, card), "score", digits=9)


@_add("fitted_scores")
def fitted_scores(spark, sf):
    """A logistic regression fitted on the earlier rows, the later rows scored by its table."""
    split = _split_gold(spark, sf)
    model = M.fit(split.where("split = 'train'"), GOLD)
    return score_table(split.where("split = 'test'"), GOLD, model_table(spark, model, GOLD))


_BEFORE = "select sender_account, event_timestamp as seen_at, max_by(amount, transaction_id) as last_amount, max_by(merchant_category, transaction_id) as last_category"


@_add("asof_features", f"""with {X.RAW_CTE}, x as ({_BEFORE.replace("max_by(merchant_category, transaction_id)", "arg_max_null(merchant_category, transaction_id)").replace("max_by(amount, transaction_id)", "arg_max_null(amount, transaction_id)")} from ev where transaction_type = (select min(transaction_type) from raw) group by 1, 2)
 select transaction_id, ev.sender_account, last_amount, last_category, strftime(seen_at, '%Y-%m-%d %H:%M:%S.%f') as seen_at from ev asof left join x on ev.sender_account = x.sender_account and ev.event_timestamp >= x.seen_at""")
def asof_features(spark, sf):
    """Each transaction with the amount and category of its sender's latest one of the first type, at or before its time."""
    ev = _ev(spark, sf)
    first = ev.agg(F.min("transaction_type").alias("_type"))
    seen = ev.join(F.broadcast(first), F.col("transaction_type") == F.col("_type")).select(  # one row
        "sender_account", "transaction_id", F.col("event_timestamp").alias("seen_at"), F.col("amount").alias("last_amount"), F.col("merchant_category").alias("last_category"))
    out = retrieve_as_of(ev.select("transaction_id", "sender_account", "event_timestamp"), seen, "sender_account", "event_timestamp", ["last_amount", "last_category"], feature_time="seen_at", tie="transaction_id")
    return out.drop("event_timestamp").withColumn("seen_at", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@_add("quality_gate", f"""with {X.RAW_CTE} select avg((merchant_category is null)::int) * 100 <= 50 and avg((time_since_last_transaction is null)::int) * 100 <= 10 as passed,
 case when avg((time_since_last_transaction is null)::int) * 100 > 10 then 'time_since_last_transaction is incomplete' else '' end as reasons from raw""")
def quality_gate(spark, sf):
    m = P.missing_summary(X.raw(spark, sf)).select(F.col("column").alias("metric"), F.col("missing_percent").alias("value"))
    rules = spark.createDataFrame([("merchant_category", ">", 50.0, "merchant_category is incomplete"), ("time_since_last_transaction", ">", 10.0, "time_since_last_transaction is incomplete")],
                                  "metric string, op string, bound double, reason string")
    return M.gate(m, rules).withColumn("reasons", F.array_join("reasons", "; "))


@_add("feature_retrieval", f"with {X.RAW_CTE} select is_fraud, transaction_id, round(ln(1 + amount), 9) as amount_log1p from raw")
def feature_retrieval(spark, sf):
    raw = X.raw(spark, sf)
    feats = M.add_features(raw, RAW, ["amount_log"])
    return _rounded(M.retrieve(raw.select("transaction_id", "is_fraud"), feats, "transaction_id", ["amount_log1p"]), "amount_log1p", digits=9)


# ---------------------------------------------------------------- expectations, folds, sketches, batches

_RULES = [
    E.in_domain("transaction_type", ("click", "purchase", "signup", "view")), E.in_range("amount", 0.0, 90.0), E.in_range("velocity_score", 1, 19), E.present("merchant_category"),
    E.matches("timestamp", r"^\d{4}-\d{2}-\d{2}T"), E.in_order("geo_anomaly_score", "spending_deviation_score"), E.nulls_at_most("time_since_last_transaction", 10.0), E.nulls_at_most("location", 0.0),
    E.unique("transaction_id"), E.unique("sender_account", "timestamp", name="one at a time")]
_BREAKS = {"transaction_type in domain": "transaction_type not in ('click', 'purchase', 'signup', 'view')", "amount in range": "amount < 0 or amount > 90", "velocity_score in range": "velocity_score < 1 or velocity_score > 19",
           "merchant_category present": "merchant_category is null", "timestamp matches": "not starts_with(timestamp, '2')", "geo_anomaly_score up to spending_deviation_score": "geo_anomaly_score > spending_deviation_score"}


def _judged(rule: str, broken: str, most: float) -> str:
    return f"select '{rule}' as rule, count(*) as rows, {broken} as broken, round({broken} * 100.0::double / count(*), 9) as value, {broken} * 100.0::double / count(*) <= {most} as passed from dirty"


@_add("expectations", f"with {X.DIRTY_CTE} " + " union all ".join([
    *(_judged(r, f"count(*) filter ({c})", 0.0) for r, c in _BREAKS.items()), _judged("time_since_last_transaction nulls", "count(*) filter (time_since_last_transaction is null)", 10.0),
    _judged("location nulls", "count(*) filter (location is null)", 0.0), _judged("transaction_id unique", "(count(*) - count(distinct transaction_id))", 0.0),
    _judged("one at a time", "(count(*) - (select count(*) from (select distinct sender_account, timestamp from dirty)))", 0.0)]))
def expectations(spark, sf):
    return _rounded(E.judge(X.dirty(spark, sf), _RULES), "value", digits=9)


@_add("quarantined_rows", f"with {X.DIRTY_CTE}, m as (select transaction_id, amount, list_filter([" + ", ".join(f"case when {c} then '{r}' end" for r, c in _BREAKS.items()) + """], lambda x: x is not null) as b from dirty)
 select transaction_id, amount, array_to_string(b, '; ') as broken_rules from m where len(b) > 0""")
def quarantined_rows(spark, sf):
    return E.quarantine(X.dirty(spark, sf), _RULES)[1].select("transaction_id", "amount", F.array_join("broken_rules", "; ").alias("broken_rules"))


def _fold_features() -> str:
    return _each("ev", RAW.numerics, "event_timestamp::date as b, is_fraud::int as y, '{c}' as feature, {c}::double - (select avg({c}::double) from ev where event_timestamp is not null) as x")


_FOLDS = f"""with {X.RAW_CTE}, l as ({_fold_features()}), s as (select b, feature, count(x) filter (y = 0) as n0, coalesce(sum(x) filter (y = 0), 0) as s0, coalesce(sum(x * x) filter (y = 0), 0) as q0, count(x) filter (y = 1) as n1,
 coalesce(sum(x) filter (y = 1), 0) as s1, coalesce(sum(x * x) filter (y = 1), 0) as q1 from l where b is not null group by 1, 2),
 f as (select b, feature, n0 + n1 as test_rows, n1 as test_positive, """ + ", ".join(f"coalesce(sum({c}) over w, 0) as {c}" for c in ("n0", "s0", "q0", "n1", "s1", "q1")) + """, count(*) over w as blocks from s window w as (partition by feature order by b rows between unbounded preceding and 1 preceding)),
 v as (select *, case when n0 > 0 and n1 > 0 then (s0 * s0 / n0 + s1 * s1 / n1 - (s0 + s1) * (s0 + s1) / (n0 + n1)) * (n0 + n1 - 2) / (q0 + q1 - s0 * s0 / n0 - s1 * s1 / n1) end as fv from f where blocks >= 3)"""


def _folds(spark, sf):
    return rolling_folds(block_statistics(_ev(spark, sf), TIMED, F.to_date("event_timestamp")), 3)


@_add("rolling_folds", _FOLDS + " select b::varchar as origin, blocks, feature, n0::bigint as n0, n1::bigint as n1, round(s0, 4) as s0, round(q1, 4) as q1, test_rows, test_positive from v")
def rolling_fold_table(spark, sf):
    f = _folds(spark, sf).withColumn("origin", F.col("origin").cast("string"))
    return _rounded(f.select("origin", "blocks", "feature", "n0", "n1", "s0", "q1", "test_rows", "test_positive"), "s0", "q1", digits=4)


@_add("fold_selection", _FOLDS + " select b::varchar as origin, feature, round(fv, 6) as f_value, (row_number() over (partition by b order by fv desc nulls last, feature))::int as place, row_number() over (partition by b order by fv desc nulls last, feature) <= 2 and fv is not null as selected from v")
def fold_selection_table(spark, sf):
    return _rounded(fold_selection(_folds(spark, sf), 2).withColumn("origin", F.col("origin").cast("string")), "f_value")


@_add("sketch_periods", f"with {X.RAW_CTE}, p as (select date_trunc('week', event_timestamp)::date::varchar as period, * from ev) " + " union all ".join(
    f"select period, '{c}' as column, count(distinct {c}) as exact, true as within from p group by 1 union all select 'all', '{c}', count(distinct {c}), true from p" for c in ("sender_account", "transaction_id")))
def sketch_periods(spark, sf):
    """Distinct values by week and over all weeks from the weeks' stored sketches: the exact count beside each, and whether the estimate is within 5 %."""
    ev = _ev(spark, sf).withColumn("_week", F.date_trunc("week", "event_timestamp").cast("date").cast("string"))
    names, path = ["sender_account", "transaction_id"], work_dir(spark, "sketches")
    K.sketch_by(ev, F.col("_week"), names, ["amount"]).write.parquet(path)
    kept = spark.read.parquet(path)
    told = K.distinct_estimates(kept, names).unionByName(K.distinct_estimates(K.united(kept, names, ["amount"]).withColumn("period", F.lit("all")), names))
    exact = lambda df, period: df.groupBy(period.alias("period")).agg(*[F.count_distinct(c).alias(c) for c in names]).select("period", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in names])))
    right = exact(ev, F.col("_week")).unionByName(exact(ev, F.lit("all")))
    return told.join(right, ["period", "column"]).select("period", "column", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.col("exact") * 0.05, F.lit(2.0))).alias("within"))


@_add("sketch_drift", "with d as (" + ORACLES["psi_drift"] + """) select "column", true as psi_near, true as gap_near from d""")
def sketch_drift(spark, sf):
    """Drift of two halves by stored sketches, beside the exact figures: near within the sketches' rank error."""
    names, sides = ["amount", "geo_anomaly_score"], []
    for half in _halves(spark, sf):
        path = work_dir(spark, "sketches")
        K.united(K.sketch_by(half, F.date_trunc("week", "event_timestamp"), [], names), [], names).write.parquet(path)
        sides.append(spark.read.parquet(path))
    right = M.drift(*_halves(spark, sf), names).withColumnsRenamed({"psi": "_p", "ecdf_gap": "_g"})
    return K.sketch_drift(*sides, names).join(right, "column").select("column", (F.abs(F.col("psi") - F.col("_p")) <= 0.02).alias("psi_near"), (F.abs(F.col("ecdf_gap") - F.col("_g")) <= 0.02).alias("gap_near"))


@_add("batches_dedup", f"with {X.DIRTY_CTE} select transaction_id, min(case when cast(substr(transaction_id, 2) as bigint) % 3 = 0 then 1 else 2 end)::int as batch, 1::bigint as kept from dirty group by 1")
def batches_dedup(spark, sf):
    """Two batches that share keys, the second met with the published keys only: each key once, from the first batch that has it."""
    dirty = X.dirty(spark, sf)
    first = F.pmod(F.substring("transaction_id", 2, 20).cast("long"), F.lit(3)) == 0
    known = KnownKeys(spark, f"known_{uuid.uuid4().hex}", "transaction_id", buckets=8, path=work_dir(spark, "known"))
    kept = []
    for n, batch in ((1, dirty.where(first)), (2, dirty)):
        path = work_dir(spark, "batch")
        known.fresh(batch, [F.col("timestamp"), F.col("amount")]).write.parquet(path)
        fresh = spark.read.parquet(path)
        known.add(fresh)
        kept.append(fresh.select("transaction_id", F.lit(n).alias("batch")))
    known.drop()
    return kept[0].unionByName(kept[1]).groupBy("transaction_id").agg(F.min("batch").alias("batch"), F.count(F.lit(1)).alias("kept"))
