"""Document tables derived from the test tables, for the registered queries and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.documents import dealt

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, deal: bool) -> DataFrame:
    """deal: whether the rows go on to a walk over single values."""
    found = table(spark, sf_dir, "events")
    return dealt(found, "event_id") if deal else found


def poly(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """events as documents whose `p` is, by event_id % 8: null, true, integer, fraction, string, array, object, absent."""
    kinds = """case event_id % 8
        when 0 then 'null' when 1 then 'true' when 2 then cast(event_id as string) when 3 then concat(cast(event_id as string), '.5')
        when 4 then concat('"', event_type, '"') when 5 then concat('[', user_id % 3, ',', event_id % 3, ',7]') when 6 then concat('{"a":', event_id % 5, ',"b":"x"}') end"""
    text = f"case when event_id % 8 = 7 then '{{}}' else concat('{{\"p\":', {kinds}, '}}') end"
    return events(spark, sf_dir, deal).select("event_id", F.expr(f"parse_json({text})").alias("doc"))


def arrays(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """events as arrays of event_id % 5 numbers: user_id % 3, event_id % 3, event_id % 2, 7."""
    parts = "slice(array(user_id % 3, event_id % 3, event_id % 2, 7), 1, cast(event_id % 5 as int))"
    return events(spark, sf_dir, deal).select("event_id", F.expr(f"parse_json(to_json({parts}))").alias("doc"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as objects with a (every 2nd), b (every 3rd), x1 (every 5th) and y (every 7th)."""
    parts = """array_join(filter(array(if(o_orderkey % 2 = 0, '"a":1', null), if(o_orderkey % 3 = 0, '"b":"s"', null),
        if(o_orderkey % 5 = 0, concat('"x1":', if(o_orderkey % 10 = 0, '1', '"t"')), null), if(o_orderkey % 7 = 0, '"y":null', null)), x -> x is not null), ',')"""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"parse_json(concat('{{', {parts}, '}}'))").alias("doc"))


def strings(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """events with a string made from their columns."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(sql).alias("s"))


def nested(spark: SparkSession, sf_dir: str, levels: int = 4, deal: bool = False) -> DataFrame:
    """events as chains of `next`, event_id % levels deep; the innermost `v` is a string for every 3rd event."""
    n = f"cast(event_id % {levels} as int)"
    body = f"concat(repeat('{{\"v\":1,\"next\":', {n}), if(event_id % 3 = 0, '{{\"v\":\"s\"}}', '{{\"v\":2}}'), repeat('}}', {n}))"
    return events(spark, sf_dir, deal).select("event_id", F.expr(f"parse_json({body})").alias("doc"))


def deep(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Chains of up to 20 levels, more than recursion is unrolled to."""
    return nested(spark, sf_dir, 21, deal)
