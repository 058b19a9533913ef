"""Domain schemas (interaction tables) and the typed result schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# column -> type; the loader casts to these and fails on a missing column
LISTENS = {"uid": L, "item_id": L, "timestamp": L, "is_organic": I,
           "played_ratio_pct": D, "track_length_seconds": D}
MULTI_EVENT = {"uid": L, "item_id": L, "timestamp": L, "is_organic": I, "event_type": S}
DISLIKES = {"uid": L, "item_id": L, "timestamp": L, "is_organic": I}
LIKES = {"uid": L, "item_id": L, "timestamp": L}
UNDISLIKES = {"uid": L, "item_id": L, "timestamp": L}
UNLIKES = {"uid": L, "item_id": L, "timestamp": L}
EMBEDDINGS = {"item_id": L, "normalized_embed": T.ArrayType(T.FloatType())}

HOT_KEY_ROWS = 1_000_000      # the row budget: rows of one key that one task takes

CHUNK = "order_range"         # column of the ranges that a hot table is cut into
MIN_CHUNK_ROWS = 64           # a smaller budget (tests force one) cuts no finer

RESULT_SCHEMA = T.StructType([
    T.StructField("id", S, False),
    T.StructField("description", S, False),
    T.StructField("confirmed", T.BooleanType(), False),
    T.StructField("metric", S, False),
    T.StructField("value", D, True),
])


@dataclass(frozen=True)
class Bundle:
    """Immutable set of domain tables. Transforms return new bundles.

    ``order_cols`` orders one user's events (the clock and every sequence operator
    sort by it, see ``order``).
    """
    listens: DataFrame
    likes: DataFrame | None = None
    dislikes: DataFrame | None = None
    undislikes: DataFrame | None = None
    unlikes: DataFrame | None = None
    multi_event: DataFrame | None = None
    embeddings: DataFrame | None = None
    order_cols: tuple[str, ...] = ("timestamp",)
    # False: a table's other columns break ties (see ``order``)
    order_is_total: bool = True
    # "cumsum": ``timestamp`` holds per-user deltas (clock = running sum);
    # "absolute": ``timestamp`` already is the time in clock units
    clock: str = "cumsum"
    # rows of a key above which its scans and joins are split (0: always split)
    hot_key_rows: int = HOT_KEY_ROWS
    # a frame whose row count bounds the rows of any table (counted lazily, on
    # the first hot-key check); at or below hot_key_rows no key can be hot
    bound_source: DataFrame | None = None
    # True: ``listens`` is a join; analyses that share their frames write it once
    listens_joined: bool = False
    _chunk_cache: dict = field(default_factory=dict, compare=False, repr=False)

    def with_(self, **kw) -> "Bundle":
        return replace(self, _chunk_cache={}, **kw)

    def rows_at_most(self, n: int) -> bool:
        """True if the bundle's row bound (lazily counted) is at most ``n``."""
        if self.bound_source is None:
            return False
        if "__bound" not in self._chunk_cache:
            self._chunk_cache["__bound"] = self.bound_source.count()
        return self._chunk_cache["__bound"] <= n

    def key_is_hot(self, table: str = "listens", key: str = "uid") -> bool:
        """True if some ``key`` value of ``table`` holds more than ``hot_key_rows``
        rows. One column-pruned aggregate (rows per key, map-side combined) and
        one row back to the driver; made once per (table, key)."""
        if self.hot_key_rows <= 0:
            return True
        if self.rows_at_most(self.hot_key_rows):
            return False
        if (table, key) not in self._chunk_cache:
            from pyspark.sql import functions as F
            top = (getattr(self, table).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                   .agg(F.max("n").alias("m")).first())
            self._chunk_cache[(table, key)] = (top.m or 0) > self.hot_key_rows
        return self._chunk_cache[(table, key)]

    def order(self, name: str) -> tuple[str, ...]:
        """Total order of one user's rows in a table, up to equal rows."""
        if self.order_is_total:
            return self.order_cols
        rest = [c for c in getattr(self, name).columns if c not in self.order_cols and c != "uid"]
        return (*self.order_cols, *rest)

    def table(self, name: str) -> DataFrame:
        """The table; with a ``CHUNK`` column if some user of it is hot.

        A hot table is cut into ranges of (uid, order) of about ``hot_key_rows``
        rows and written once. The range number is the chunk: it is monotone in a
        user's order, so a hot user is spread over many chunks whatever the days or
        deltas of its events are, and no chunk of a user exceeds its range."""
        df = getattr(self, name)
        if not self.key_is_hot(name):
            return df
        if name not in self._chunk_cache:
            from pyspark.sql import functions as F

            from playstat.session import cut_lineage
            ranges = max(2, -(-df.count() // max(self.hot_key_rows, MIN_CHUNK_ROWS)))
            self._chunk_cache[name] = cut_lineage(
                df.repartitionByRange(ranges, "uid", *self.order(name)).withColumn(CHUNK, F.spark_partition_id()))
        return self._chunk_cache[name]

    def chunk_for(self, table: str = "listens", part: str = "uid") -> str | None:
        """``CHUNK`` if ``table()`` has it, else None (one plain window per user is cheaper then)."""
        return CHUNK if self.key_is_hot(table, part) else None
