"""playstat: behavioural-interaction analytics on Spark DataFrames.

Layout
------
sources/    parquet loading, domain schemas, adapters from the given tables
functions/  Column-expression helpers (flags, buckets, tail probabilities)
operators/  DataFrame -> DataFrame building blocks (windows, joins, ranks, ...)
plans/      composite analyses (hypotheses) and the query registry
streaming/  (nothing: the analyses are batch-only, see README)
"""

__all__ = ["session"]
