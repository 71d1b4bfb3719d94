"""Mix sources to target weights by Efraimidis-Spirakis sampling, in SQL functions only.

Shares: each source gets the share of all words that its weight has, but at most
``most`` times its own words; the excess is shared anew by weight among the
others until no source is above. That fixed point is a water level: sources
sorted by the level at which they are full are full up to one of them, and the
rest divide what is left by weight.

Choice: a source with target T, rounded to words, and size S is taken
floor(T / S) times whole (complete epochs); the remaining words are drawn without replacement. Every
document draws u from its id and size and gets the key -ln(u) / w with its
quality weight w; documents are taken in order of the key until the budget is
used up, and the document at the border gives only as many words as are left.
Documents that tie at the border (repeated rows) share these words evenly.

Scale: a source is never sorted as a whole. Keys are mapped to [0, 1) and dealt
into as many buckets as the table has ``bucket_rows`` rows; sums per source and
bucket find the one bucket with the border, and only that bucket is ordered. The
border (one row per source) is joined to the documents; adaptive execution
broadcasts it if it is small and splits hot sources if not.

Edge cases: a null text has size 0, a null source is a source like any other and
comes last; sources without words get target 0; null doc_ids draw by size; an
empty table gives an empty result. A column that has the name of an
added one is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.durable import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 4096
_ADDED = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    """Words: runs of other characters than space and U+0009..U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality_of(text: Column) -> Column:
    """Quality weight from 0.25 to 1: the share of letters among the characters, squared."""
    letters = F.try_divide(F.length(F.regexp_replace(text, "[^\\p{L}]+", "")), F.length(text))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * letters * letters, F.lit(0.25))


def key_of(doc_id: Column, size: Column, weight: Column, seed: int) -> Column:
    """Exponential key: the smaller, the earlier the document is taken."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")).cast("binary"))
    draw = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(draw) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from source and source_size; one row for each source."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    rising = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    after, before = rising.rowsBetween(0, Window.unboundedFollowing), rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum("source_size").over(Window.partitionBy()).cast("double")
    left = everything - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)  # the level if this source were the first that is not full
    found = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("level", level)
    is_open = F.col("level") * F.col("weight") < F.col("full")
    found = found.withColumn("level", F.min(F.when(is_open, F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(Window.partitionBy())["level"])
    return found.select("source", "source_size", F.when(F.col("level") * F.col("weight") < F.col("full"), F.col("level") * F.col("weight")).otherwise(F.col("full")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, source, ...) with size, source_size, target and taken."""
    # The row travels as one struct, so its column names cannot clash.
    sized = docs.select("doc_id", "source", "text", size_of(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_row"))
    sized = sized.withColumn("_key", key_of(F.col("doc_id"), F.col("size"), quality_of(F.col("text")), seed))
    slim = materialise(sized.select("source", "size", "_key"), "mixing")
    place = F.lit(1.0) - F.exp(-F.col("_key"))

    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    goals = targets(sources.select("source", "source_size"), weights, most)
    goals = goals.join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Of the rounded target, so that the rest is less than the source.
    goals = goals.withColumn("_goal", F.round(F.col("target")).cast("long"))
    goals = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_goal div source_size")).otherwise(F.lit(0).cast("long")))
    goals = goals.withColumn("_rest", F.col("_goal") - F.col("_epochs") * F.col("source_size"))
    goals = goals.withColumn("_buckets", F.ceil(F.col("_rows") / F.lit(bucket_rows)).cast("long"))
    goals = materialise(goals, "targets").withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))

    bucket = F.least(F.floor(place * F.col("_buckets")).cast("long"), F.col("_buckets") - 1).alias("_bucket")
    dealt = slim.join(goals.select("_source", "_buckets", "_rest"), same).select("source", "size", "_key", "_rest", bucket)
    sums = dealt.groupBy("source", "_bucket", "_rest").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    borders = materialise(sums.where("_before <= _rest AND _rest < _before + _sum").select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_before"), "borders")

    # Of each source only the bucket with the border is ordered, repeated rows as one entry.
    near = dealt.join(borders, same & (F.col("_bucket") == F.col("_b"))).groupBy("_source", "_key", "size", "_before", "_rest").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_ahead", F.col("_before") + F.coalesce(F.sum(F.col("_n") * F.col("size")).over(order), F.lit(0)))
    cut = near.where("size > 0 AND _ahead <= _rest AND _rest < _ahead + _n * size").select(
        F.col("_source").alias("_cut_source"), F.col("_key").alias("_cut_key"), F.col("size").alias("_cut_size"), F.floor((F.col("_rest") - F.col("_ahead")) / F.col("_n")).cast("long").alias("_cut_words")
    )
    plan = goals.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    plan = materialise(plan.select("_source", "source_size", "target", "_epochs", "_cut_key", "_cut_size", "_cut_words"), "mix_plan")

    mine = F.struct("_key", "size")
    border = F.struct("_cut_key", "_cut_size")
    part = F.when(F.col("_cut_key").isNull(), 0).when(mine < border, F.col("size")).when(mine == border, F.col("_cut_words")).otherwise(0)
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    names = [name for name in docs.columns if name.lower() not in _ADDED]
    return sized.join(plan, same).select("_row", "size", "source_size", "target", taken.alias("taken")).select(*[f"_row.`{name}`" for name in names], *_ADDED)


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as it is taken, the one at the border rounded."""
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("whole_row"))
    mixed = mix(rows, weights, most, seed).select("whole_row", times.alias("times")).where("times > 0")
    return mixed.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("whole_row.*")
