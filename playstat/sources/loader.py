"""Parquet loading of the domain tables (listens, likes, dislikes, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from playstat.sources import schemas as S
from playstat.sources.schemas import Bundle


def join_path(base: str, name: str) -> str:
    # plain string join keeps scheme://host:port intact
    return base.rstrip("/") + "/" + name


def read_table(spark: SparkSession, base: str, name: str, columns: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read ``name``(.parquet) and cast to the declared columns; other columns are
    dropped but for ``keep``, which must be there."""
    path = join_path(base, name if name.endswith(".parquet") else name + ".parquet")
    df = spark.read.parquet(path)
    missing = [c for c in (*columns, *keep) if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()],
                     *[c for c in keep if c not in columns])


def optional_table(spark: SparkSession, base: str, name: str, columns: dict,
                   keep: tuple[str, ...] = ()) -> DataFrame | None:
    """Absent path -> None (callers report SKIPPED); any other error is raised."""
    try:
        return read_table(spark, base, name, columns, keep)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_bundle(spark: SparkSession, base: str, clock: str = "cumsum",
                order_cols: tuple[str, ...] = ()) -> Bundle:
    """The six interaction tables plus optional embeddings from ``base``.

    ``order_cols``: columns of every table that order a user's events; a table's
    other columns break ties, so results do not depend on the files' row order.
    ``clock="cumsum"`` treats ``timestamp`` as per-user deltas, which do not order
    events: it needs ``order_cols`` (``("timestamp",)`` is the original
    preprocessing). ``clock="absolute"`` treats ``timestamp`` as absolute time in
    5-second units and orders by it unless told otherwise."""
    if clock == "cumsum" and not order_cols:
        raise ValueError("clock='cumsum' needs order_cols: deltas do not order events")
    order = tuple(order_cols) or ("timestamp",)
    need = {"listens": S.LISTENS, "likes": S.LIKES, "dislikes": S.DISLIKES, "undislikes": S.UNDISLIKES,
            "multi_event": S.MULTI_EVENT}
    tables = {name: read_table(spark, base, name, columns, order) for name, columns in need.items()}
    tables["unlikes"] = optional_table(spark, base, "unlikes", S.UNLIKES, order)
    # all tables together bound the rows of any key (counted from parquet metadata
    # on the first hot-key check)
    from functools import reduce
    keyed = [t.select("uid") for t in tables.values() if t is not None]
    return Bundle(**tables, embeddings=optional_table(spark, base, "embeddings", S.EMBEDDINGS),
                  order_cols=order, order_is_total=False, clock=clock,
                  bound_source=reduce(DataFrame.unionAll, keyed))
