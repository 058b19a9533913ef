"""Domain views over the driver's synthetic tables.

No given table holds listening data, so two adapters map them onto the
interaction schema:

* lineitem bundle (volume): lineitem x orders x part -> ``listens`` only.
  ``timestamp`` is a per-user delta (the line number), so the clock is the
  running sum, exactly like the interaction data the analyses were written for.
* events bundle (behaviour): one ``events`` row per interaction; event types
  map to listens / likes / dislikes / undislikes, ``timestamp`` is absolute time
  in 5-second units.

The oracle SQL in ``playstat.plans.oracle`` spells the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playstat.sources.loader import join_path
from playstat.sources.schemas import Bundle

# fixed values of the adapter mapping
LISTEN_TYPES = ("view", "click")
EVENT_TYPE_MAP = {"view": "listen", "click": "listen", "purchase": "like",
                  "error": "dislike", "signup": "undislike"}
VECTOR_ID_SHIFT = 14          # vector v belongs to item v + 14; items below 14 have none
NULL_RATIO_EVERY = 53         # every 53rd listen (by event_id) has no ratio

L_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice")
E_ORDER = ("ts", "event_id")


def _pq(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(join_path(sf_dir, f"{name}.parquet"))


def lineitem_bundle(spark: SparkSession, sf_dir: str) -> Bundle:
    # what needs lineitem alone is made ahead of the joins, so that they shuffle fewer columns
    ln = F.col("l_linenumber")
    li = _pq(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate",
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_organic"),
        F.when((F.col("l_returnflag") == "A") & (ln == 7), F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") * 3).alias("played_ratio_pct"),
        F.coalesce((F.col("l_returnflag") == "R") & (ln == 6), F.lit(False)).alias("no_length"))
    o = _pq(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = _pq(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    listens = j.select(
        F.col("o_custkey").alias("uid"),
        F.col("l_partkey").alias("item_id"),
        ln.cast("bigint").alias("timestamp"),
        "is_organic", "played_ratio_pct",
        F.when(F.col("no_length"), F.lit(None).cast("double"))
         .otherwise((F.col("p_size") * 12).cast("double")).alias("track_length_seconds"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )
    # every listen is one lineitem row (inner joins on keys): the parquet row
    # count (footer metadata) bounds the rows of any user
    return Bundle(listens=listens, order_cols=L_ORDER, clock="cumsum",
                  bound_source=li, listens_joined=True)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pq(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"),
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "event_id", "ts",
        # microseconds since the epoch of the wall-clock (NTZ) time: independent
        # of the session time zone
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 5000000")
         .alias("timestamp"),
        F.col("event_type").alias("raw_type"), "value",
    )


def events_bundle(spark: SparkSession, sf_dir: str, with_embeddings: bool = True) -> Bundle:
    ev = _events(spark, sf_dir)
    organic = (F.col("event_id") % 2).cast("int")
    keys = ["uid", "item_id", "timestamp", "ts", "event_id"]
    listens = ev.filter(F.col("raw_type").isin(*LISTEN_TYPES)).select(
        *keys, organic.alias("is_organic"),
        F.when(F.col("event_id") % NULL_RATIO_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("played_ratio_pct"),
        (30 + (F.col("item_id") * 37) % 571).cast("double").alias("track_length_seconds"))
    likes = ev.filter(F.col("raw_type") == "purchase").select(*keys)
    dislikes = ev.filter(F.col("raw_type") == "error").select(*keys, organic.alias("is_organic"))
    undislikes = ev.filter(F.col("raw_type") == "signup").select(*keys)
    etype = F.lit(None).cast("string")
    for raw, dom in EVENT_TYPE_MAP.items():
        etype = F.when(F.col("raw_type") == raw, dom).otherwise(etype)
    multi = ev.select(*keys,
                      F.when(F.col("raw_type").isin(*LISTEN_TYPES), organic).alias("is_organic"),
                      etype.alias("event_type"))
    emb = None
    if with_embeddings:
        emb = _pq(spark, sf_dir, "embeddings").select(
            (F.col("vec_id") + VECTOR_ID_SHIFT).alias("item_id"),
            F.col("embedding").cast("array<float>").alias("normalized_embed"))
    return Bundle(listens=listens, likes=likes, dislikes=dislikes, undislikes=undislikes,
                  multi_event=multi, embeddings=emb, order_cols=E_ORDER, clock="absolute", bound_source=ev)
