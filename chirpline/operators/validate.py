"""Record rules: which rows are posts, and what is wrong with the rest."""

from pyspark.sql import Column, DataFrame, functions as F

from chirpline import schema
from chirpline.functions import text as tx


def _broken(rule: Column, name: str) -> Column:
    return F.when(rule, F.lit(name))


def score_violations() -> list[Column]:
    score, conf = F.col("sentiment_score"), F.col("sentiment_confidence")
    return [
        _broken(~score.between(-1.0, 1.0), "sentiment_score out of range"),
        _broken(~conf.between(0.0, 1.0), "sentiment_confidence out of range"),
    ]


def with_defaults(df: DataFrame) -> DataFrame:
    """All post columns in their types and order, defaults filled in; other columns follow."""
    def column(field):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.try_cast(field.dataType)
        if field.name in schema.COUNTERS:
            value = F.coalesce(value, F.lit(0))
        elif field.name in schema.FLAGS:
            value = F.coalesce(value, F.lit(False))
        elif field.name == "scraped_at":
            value = F.coalesce(value, F.current_timestamp())
        elif field.name == "content":
            value = tx.strip(value)
        return value.alias(field.name)

    others = [c for c in df.columns if c not in schema.POSTS.names]
    return df.select(*[column(f) for f in schema.POSTS.fields], *others)


def malformed(df: DataFrame) -> list[Column]:
    """Violations of values that cannot be read as their column's type."""
    known = {f.name: f.dataType for f in schema.POSTS.fields}
    odd = [f for f in df.schema.fields if f.name in known and f.dataType != known[f.name]]
    return [_broken(F.col(f.name).isNotNull() & F.col(f.name).try_cast(known[f.name]).isNull(), f"{f.name} malformed") for f in odd]


def check_posts(df: DataFrame) -> DataFrame:
    """Posts with defaults and a ``violations`` array, empty for a good row. A value that cannot be read never stops the job."""
    df = df.withColumn("__malformed", F.array(*malformed(df)).cast("array<string>"))
    rules = [_broken(F.col(c).isNull(), f"{c} missing") for c in schema.REQUIRED]
    rules.append(_broken(F.col("content") == "", "content empty"))
    rules += [_broken(F.col(c) < 0, f"{c} negative") for c in schema.COUNTERS]
    rules += score_violations()
    found = F.array_compact(F.concat("__malformed", F.array(*rules)))
    return with_defaults(df).withColumn("violations", found).drop("__malformed")


def valid_posts(df: DataFrame) -> DataFrame:
    return check_posts(df).filter(F.size("violations") == 0).drop("violations")


def quarantined_posts(df: DataFrame) -> DataFrame:
    return check_posts(df).filter(F.size("violations") > 0)
