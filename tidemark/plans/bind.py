"""The roles of the driver's tables: a user's events are a clip, and event types are what was seen in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DET, REF, CAND, MOTION, BEEP = "click", "purchase", "view", "error", "signup"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as the SQL rounds: scaled, then to the nearest whole, halves away from zero.  (Spark's own round goes by the decimal digits.)"""
    return F.round((F.col(value) if isinstance(value, str) else value) * 10.0**digits) / 10.0**digits


def timeline(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(clip, id, t, conf) of all events, or of some kinds; t in microseconds."""
    e = read(spark, sf_dir, "events")
    if kinds:
        e = e.where(F.col("event_type").isin(*kinds))
    return e.select(F.col("user_id").alias("clip"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("conf"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra: (clip, idx, mag), clip the label of a vector."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("clip"), n.cast("long").alias("idx"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("mag"), "vec_id")


#: The same roles in DuckDB.
EV = "ev AS (SELECT user_id AS clip, event_id AS id, epoch_us(ts) AS t, value AS conf, event_type AS kind FROM events)"


def role(name: str, kind: str) -> str:
    return f"{name} AS (SELECT clip, id, t, conf FROM ev WHERE kind = '{kind}')"


SERIES = "s AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY t, id) - 1 AS idx, conf AS value, t, id FROM ev)"
FRAMES = "f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS mag FROM embeddings)"
