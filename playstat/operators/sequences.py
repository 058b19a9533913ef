"""Count-based sliding windows and last-k history over each user's sequence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playstat.operators import vectors as V
from playstat.operators.prefix import row_index, running_sums
from playstat.operators.skew import join_maybe_salted
from playstat.sources.schemas import HOT_KEY_ROWS

# fixed values: defaults of the windowed analyses
WINDOW_SIZE = 100
WINDOW_STEP = 50
HISTORY_LEN = 20
MIN_HISTORY = 3
HISTORY_CHUNK_ROWS = 4096    # rows of a user per block of the history scan (plus k organic ones)


def sliding_count_windows(df: DataFrame, order_cols, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                          part: str = "uid", chunk_col: str | None = None) -> DataFrame:
    """One output row per (input row, window it falls in): adds ``idx`` and
    ``win``. Windows start every ``step`` rows, hold ``size`` rows; each row is
    copied into at most ceil(size/step) windows. Completeness (full windows
    only) is checked after grouping by (part, win)."""
    d = row_index(df, part, order_cols, "idx", chunk_col)
    lo = F.greatest(F.lit(0), F.floor((F.col("idx") - size) / step) + 1).cast("bigint")
    hi = F.floor(F.col("idx") / step).cast("bigint")
    # size < step leaves rows in no window (lo > hi); sequence() would count down
    return d.withColumn("win", F.explode(F.when(lo <= hi, F.sequence(lo, hi))
                                          .otherwise(F.array().cast("array<bigint>"))))


def window_stats(win_rows: DataFrame, size: int = WINDOW_SIZE, part: str = "uid",
                 item: str = "item_id") -> DataFrame:
    """Per full window: rec_share and Shannon entropy (bits) of the item counts."""
    per_item = win_rows.groupBy(part, "win", item).agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.when(F.col("is_organic") == 0, 1).otherwise(0)).alias("r"))
    p = F.col("c") / F.lit(float(size))
    return (per_item.groupBy(part, "win").agg(
                F.sum("c").alias("n"),
                (F.sum("r") / F.lit(float(size))).alias("rec_share"),
                (-F.sum(p * F.log2(p))).alias("entropy"))
            .filter(F.col("n") == size).drop("n"))


def window_diversity(indexed: DataFrame, emb: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP,
                     part: str = "uid", hot_items: bool = False, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Per full window: mean pairwise cosine distance of the available vectors
    (repeats kept).

    ``indexed`` has ``idx``, the row's position in its ``part``. Rows meet their
    vectors once, as given (in FLOAT, with the norm), and take these to a block of
    gcd(size, step) rows, where unit vectors are summed; only the block sums are copied
    into the windows, which are size / gcd blocks."""
    width = math.gcd(size, step)
    vec = emb.select("item_id", F.when(F.col("normalized_embed").isNotNull(), F.struct(
        F.col("normalized_embed").alias("v"), V.norm("normalized_embed").alias("norm"))).alias("vec"))
    rows = join_maybe_salted(indexed.select(part, "idx", "item_id"), vec, "item_id", "left", hot_items, hot_rows)
    blocks = rows.groupBy(part, F.floor(F.col("idx") / width).alias("blk")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list("vec").alias("vs"))
    blocks = blocks.select(part, "blk", "n", F.size("vs").alias("n_vec"),
                           F.size(F.filter("vs", lambda s: s["norm"] >= V.COSINE_EPS)).alias("n_nz"),
                           V.sum_units("vs", "v", "norm").alias("u"))
    first = F.greatest(F.lit(0), F.ceil((F.col("blk") * width - size + width) / step)).cast("bigint")
    last = F.floor(F.col("blk") * width / step).cast("bigint")
    copies = blocks.withColumn("win", F.explode(F.when(first <= last, F.sequence(first, last))
                                                .otherwise(F.array().cast("array<bigint>"))))
    agg = copies.groupBy(part, "win").agg(
        F.sum("n").alias("n"), F.sum("n_vec").alias("n_vec"), F.sum("n_nz").alias("n_nz"),
        F.collect_list("u").alias("us")).filter((F.col("n") == size) & (F.col("n_vec") > 0))
    return agg.select(part, "win", "n_vec",
                      V.pairwise_diversity(V.sum_vectors("us"), "n_vec", "n_nz").alias("diversity"))


def _history_blocks(d: DataFrame, part: str, k: int, chunk_rows: int | None) -> DataFrame:
    """``d`` cut into blocks of ``chunk_rows`` rows of a user (column ``__blk``), plus copies
    (``__own`` false) of the last k organic rows before each block, by their number."""
    own = d.withColumn("__blk", F.floor(F.col("__pos") / chunk_rows).cast("bigint") if chunk_rows
                       else F.lit(0).cast("bigint")).withColumn("__own", F.lit(True))
    if not chunk_rows:
        return own
    before = F.min(F.col("n_org") - F.col("is_organic"))         # organic rows ahead of the block
    wanted = (own.groupBy(part, "__blk").agg(before.alias("__before"))
              .where((F.col("__blk") > 0) & (F.col("__before") > 0))
              .select(part, F.col("__blk"), F.explode(F.sequence(
                  F.greatest(F.lit(1), F.col("__before") - (k - 1)), F.col("__before"))).alias("n_org")))
    halo = (d.where(F.col("is_organic") == 1).join(wanted, [part, "n_org"])
            .withColumn("__own", F.lit(False)).select(*own.columns))
    return own.unionByName(halo)


def vector_prefix(vector: str, dims: int, window, where: Column) -> Column:
    """Sum of an array column over a window's rows where ``where`` holds, element by element."""
    return F.array(*[F.coalesce(F.sum(F.when(where, F.col(vector)[i].cast("double"))).over(window), F.lit(0.0))
                     for i in range(dims)])


def history_similarity(listens: DataFrame, emb: DataFrame, order_cols, k: int = HISTORY_LEN,
                       min_history: int = MIN_HISTORY, part: str = "uid",
                       chunk_col: str | None = None,
                       chunk_rows: int | None = HISTORY_CHUNK_ROWS,
                       hot_items: bool = False, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """For each recommended listen with at least ``min_history`` organic listens
    before it: cosine between its vector and the mean vector of the last ``k``
    organic listens, as far as these have vectors. Rows without a vector, or whose
    history has no vector at all, are dropped.

    The sum of a history is the difference of two running sums of vectors, over the
    organic rows up to number ``n_org`` and up to ``n_org - k``: both are scans of the
    same sorted rows, to which each listen carries its own vector once. They run per
    block of ``chunk_rows`` rows of a user (with copies of the k organic rows before it),
    so neither a hot user nor a long run of recommended listens makes a large task, and
    sums are short enough for their difference to be exact to about 1e-12."""
    sums = {"n_org": (F.col("is_organic"), True), "__pos": (F.lit(1), False)}
    d = running_sums(listens, part, order_cols, sums, chunk_col)
    keep = [part, "n_org", "item_id", "listen_plus", *[c for c in order_cols if c not in (part, "item_id")]]
    d = d.select(*dict.fromkeys([*keep, "is_organic", "__pos"]))
    vec = emb.select("item_id", "normalized_embed").where(F.col("normalized_embed").isNotNull())
    first = vec.select(F.size("normalized_embed").alias("n")).first()
    dims = first["n"] if first else 0
    rec = (F.col("is_organic") == 0) & (F.col("n_org") >= min_history)
    rows = _history_blocks(d, part, k, chunk_rows).where(rec | (F.col("is_organic") == 1)).drop("__pos")
    rows = join_maybe_salted(rows, vec, "item_id", "inner", hot_items, hot_rows)
    upto = Window.partitionBy(part, "__blk").orderBy("n_org").rangeBetween(Window.unboundedPreceding, 0)
    older = Window.partitionBy(part, "__blk").orderBy("n_org").rangeBetween(Window.unboundedPreceding, -k)
    organic = F.col("is_organic") == 1
    held = F.count(F.when(organic, 1))
    rows = (rows.withColumn("__n_vec", held.over(upto) - held.over(older))
            .withColumn("__upto", vector_prefix("normalized_embed", dims, upto, organic))
            .withColumn("__older", vector_prefix("normalized_embed", dims, older, organic)))
    history = F.zip_with("__upto", "__older", lambda x, y: x - y)
    return (rows.where(rec & F.col("__own") & (F.col("__n_vec") > 0))
            .withColumn("__history", history)
            .withColumn("cosine_sim", V.cosine("normalized_embed", "__history"))
            .select(*dict.fromkeys(keep), "cosine_sim"))
