"""Run every analysis on a folder of interaction tables.

    spark-submit playstat/plans/run.py --data-dir hdfs:///data/interactions \\
        --clock absolute --out hdfs:///results/run1

Writes the long-form results (id, description, confirmed, metric, value) as
parquet when ``--out`` is given (and the run's parameters beside them) and prints the per-analysis verdicts. The
session (master, resources, checkpoint dir) comes from spark-submit.
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from playstat.plans import hypotheses as H  # noqa: E402
from playstat.plans.context import Context, Params  # noqa: E402
from playstat.session import ensure_checkpoint_dir  # noqa: E402


def parse(argv=None):
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--data-dir", required=True)
    p.add_argument("--clock", choices=["cumsum", "absolute"], default="cumsum")
    p.add_argument("--order-cols", default="", help="comma-separated columns that order a user's events")
    p.add_argument("--out", default=None, help="folder for the results parquet")
    d = Params()
    p.add_argument("--session-gap", type=int, default=d.session_gap)
    p.add_argument("--window-size", type=int, default=d.window_size)
    p.add_argument("--window-step", type=int, default=d.window_step)
    p.add_argument("--seed", type=int, default=d.seed)
    return p.parse_args(argv)


def write_results(res: DataFrame, out: str, params: Params) -> None:
    """The long-form results under ``out``, the parameters of the run (name, value) next to them."""
    res.write.mode("overwrite").parquet(out)
    rows = [(k, str(v)) for k, v in vars(params).items()]
    res.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(
        out.rstrip("/") + "_parameters")


def main(argv=None, spark: SparkSession | None = None):
    a = parse(argv)
    spark = spark or SparkSession.builder.appName("playstat").getOrCreate()
    ensure_checkpoint_dir(spark)
    params = Params(session_gap=a.session_gap, window_size=a.window_size, window_step=a.window_step,
                    seed=a.seed)
    ctx = Context.from_folder(spark, a.data_dir, params, clock=a.clock,
                              order_cols=tuple(c for c in a.order_cols.split(",") if c))
    res = H.run_all(ctx)                      # checkpointed, small
    if a.out:
        write_results(res, a.out, params)
    verdicts = (res.groupBy("id", "description").agg(F.max(F.col("confirmed").cast("int")).alias("c"))
                .collect())
    order = {f"H{i}": i for i in range(1, 12)}
    for r in sorted(verdicts, key=lambda r: order.get(r.id, 99)):
        print(f"{r.id:4s} {'CONFIRMED' if r.c else 'not confirmed':14s} {r.description}")
    print(f"confirmed: {sum(r.c for r in verdicts)} / {len(verdicts)}")
    return res


if __name__ == "__main__":
    main()
