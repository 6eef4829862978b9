"""Rankings that keep their balance when one key holds much of the data."""

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirpline.session import stored

ROUND = 1024
TWO_ROUNDS_FROM = 50


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, by ``order``.

    The form depends on ``n`` alone. For a small one a single round is enough:
    Spark cuts each map task's share to ``n`` rows per group before the
    shuffle. From ``TWO_ROUNDS_FROM`` on, the shares of up to ``ROUND`` groups
    of map tasks are cut in tasks of their own first, so that at most ``ROUND``
    times ``n`` rows of a group meet in the second round.
    """
    if n >= TWO_ROUNDS_FROM:
        # rows of a map task stay together, or its share could not be cut before the shuffle
        some = df.withColumn("__round", F.pmod(F.spark_partition_id(), F.lit(ROUND)))
        first = Window.partitionBy(*keys, "__round").orderBy(*order)
        df = some.withColumn("__rank1", F.row_number().over(first)).filter(F.col("__rank1") <= n).drop("__rank1", "__round")
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def totals_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the total of ``value`` over the rows of a key that stand before a row. No two rows of a key share a place.

    The rows are dealt by range of key and place and stay where they are dealt,
    so a key of any size is shared by many tasks; each task adds up its own
    rows, and the tasks' totals, one for each task a key reaches, are added up
    over the tasks.
    """
    dealt = stored(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    earlier = (Window.unboundedPreceding, -1)
    over_parts = Window.partitionBy(*keys).orderBy("__part").rowsBetween(*earlier)
    base = dealt.groupBy(*keys, "__part").agg(F.sum(value).alias("__sum")).select(
        *keys, "__part", F.coalesce(F.sum("__sum").over(over_parts), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(*earlier)
    summed = dealt.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = functools.reduce(operator.and_, [summed[c].eqNullSafe(base[c]) for c in [*keys, "__part"]])
    return summed.join(base, same).select(*[summed[c] for c in rows.columns], (F.col("__base") + F.col("__inside")).alias(name))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by the values of columns over as many tasks as a shuffle has, for work that costs more than the bytes it reads.

    Files of few row groups, and small partitions that adaptive execution
    joins, would leave such work to a few tasks. A number that is given stays.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))
