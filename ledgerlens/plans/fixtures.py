"""Transaction tables derived from the driver's tables, as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RAW = """
select concat('T', cast(event_id as {S})) as transaction_id, {FMT} as timestamp,
 concat('ACC', cast(user_id as {S})) as sender_account, concat('ACC', cast((user_id*7+3)%150 as {S})) as receiver_account,
 value as amount, event_type as transaction_type,
 case when event_id%11=0 then null else concat('m', cast(event_id%8 as {S})) end as merchant_category,
 concat('loc', cast(user_id%8 as {S})) as location, concat('dev', cast((user_id+event_id)%4 as {S})) as device_used,
 ((event_id*7919+user_id*31)%28=0) as is_fraud,
 case when (event_id*7919+user_id*31)%28=0 then concat('ft', cast(event_id%4 as {S})) end as fraud_type,
 case when (event_id*7919+user_id*31)%28<>0 and event_id%5=0 then null else cast((event_id*97)%20001-10000 as double)/1000 end as time_since_last_transaction,
 cast((event_id*37)%401-200 as double)/100 as spending_deviation_score, cast(1+(event_id*13)%20 as smallint) as velocity_score,
 cast((event_id*53)%101 as double)/100 as geo_anomaly_score, concat('pc', cast(event_id%4 as {S})) as payment_channel,
 concat('10.0.', cast(user_id%256 as {S}), '.', cast(event_id%256 as {S})) as ip_address, concat('D', cast(user_id*17%1000 as {S})) as device_hash
from {T}
"""
_DIRTY = """
select transaction_id, case when cast(substr(transaction_id,2) as bigint)%103=0 then 'not-a-date' else timestamp end as timestamp, sender_account, receiver_account,
 case when cast(substr(transaction_id,2) as bigint)%107=0 then null when cast(substr(transaction_id,2) as bigint)%101=0 then -amount else amount end as amount,
 transaction_type, merchant_category, location, device_used, is_fraud, fraud_type, time_since_last_transaction, spending_deviation_score, velocity_score,
 geo_anomaly_score, payment_channel, ip_address, device_hash from {T}
"""
_LI = """
select concat(cast(l_orderkey as {S}), '-', cast(l_linenumber as {S})) as line_id, l_shipdate as shipped, case when l_returnflag = 'R' then 1 else 0 end as returned,
 l_extendedprice as price, l_quantity as quantity, case when l_discount > 0 then l_discount end as discount, l_linestatus as status, cast(l_linenumber as {S}) as line
from {T}
"""
_SPARK = {"S": "string", "FMT": """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")"""}
_DUCK = {"S": "varchar", "FMT": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RAW.format(T="{t}", **_SPARK), t=spark.read.parquet(f"{sf_dir}/events.parquet"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(_DIRTY.format(T="{t}"), t=raw(spark, sf_dir))
    return p.unionByName(p.where("cast(substr(transaction_id,2) as bigint)%97=0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LI.format(T="{t}", **_SPARK), t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


RAW_CTE = f"raw as ({_RAW.format(T='events', **_DUCK)}), ev as (select *, try_cast(timestamp as timestamp) as event_timestamp from raw)"
DIRTY_CTE = f"{RAW_CTE}, p as ({_DIRTY.format(T='raw')}), dirty as (select * from p union all select * from p where cast(substr(transaction_id,2) as bigint)%97=0)"
LINES_CTE = f"li as ({_LI.format(T='lineitem', **_DUCK)})"
