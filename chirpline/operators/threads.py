"""Threads of a saved timeline page."""

from pyspark.sql import DataFrame, Window, functions as F


def assemble_threads(items: DataFrame, fresh: DataFrame | None = None, crawl: list[str] = ("page_id",)) -> DataFrame:
    """Thread items of a page joined into threads, each ended by its closing item.

    Items between two closing ones belong together; what follows the last one
    is dropped. ``fresh`` limits the members to posts not seen earlier in the
    crawl, while repeated items still end their thread. All groups lie within
    one page.
    """
    page = list(crawl)
    order = Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = items.filter(F.col("kind") == "thread").withColumn(
        "thread_no", F.coalesce(F.sum(F.col("is_thread_end").cast("int")).over(order), F.lit(0)))
    new = F.lit(True)
    if fresh is not None:
        parts = parts.join(fresh.select(*page, "pos", F.lit(True).alias("__new")), [*page, "pos"], "left")
        new = F.col("__new").isNotNull()
    member = F.struct(F.col("pos"), F.col("id"), F.col("link"), F.col("text"))
    return parts.groupBy(*page, "thread_no").agg(
        F.array_sort(F.collect_list(F.when(new, member))).alias("posts"),
        F.max("is_thread_end").alias("__closed")).filter("__closed").drop("__closed")
