"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Word counts are summed by source and by the leading
bits of the hash; the bucket in which a source's budget ends is refined by the next bits,
and only the rows of that bucket are read again, until one hash value is left. A document is
in the mix if its hash lies below its source's threshold: a filter, never a sort.

A source whose target is r times its words gives each document floor(r) times, and once more
where the hash lies below the threshold of the rest. The documents with the threshold's own
hash give only the words that are still missing, in proportion to their sizes, so that a
source misses its target by rounding alone.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
rows that agree in doc_id and text have the same hash and share what is missing; a source
without words has target 0; a very long text is one document, however large its share of the
source (the boundary then lies inside it, and it gives the missing words only); an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, fresh, materialise, small_or_not, text_or_empty

#: Weights of the sources in code point order, repeating, and the most times a document is used.
WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 5


def words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash (0 to 2**60 - 1, by doc_id and text)."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), _hash().alias("hash"))


def _hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.xxhash64(text_or_empty(text))), 64 - BITS * LEVELS)


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target. by_source has source and source_size, a row for each source.

    A target stops at `most` times its source's words; what is over goes to the others by
    weight, until none is above. The sources that stop are those with the least room for
    their weight, so one running sum in the order of source_size / weight finds them.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    w = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double"))
    room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(everything)).withColumn("left_words", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    w = w.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("scale", F.col("left_words") / F.col("left_weight"))
    w = w.withColumn("stops", F.col("scale") * F.col("weight") >= most * F.col("source_size"))
    # once a source doesn't stop, none after it does, and they all share at its scale
    w = w.withColumn("final", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "scale"))).over(everything)["scale"])
    share = F.when(F.col("stops"), most * F.col("source_size").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return w.select("source", "source_size", share.alias("target"))


def thresholds(rows: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """A row for each source: source_size, target, copies (of every document), bound (hashes
    below give one more), missing (words that the hash `bound` gives) and bound_size (words it has).

    rows has source, size and hash, and is read once for each level; each level reads only
    the buckets in which a budget ends, and sums by source and bucket before it shuffles.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source, weights, most).withColumn("words", F.round("target").cast("long"))
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("missing", F.col("words") - F.col("copies") * F.col("source_size")).withColumn("bound", F.lit(0).cast("long")).withColumn("bound_size", F.col("source_size"))
    plan = materialise(plan)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        edge = plan.select(F.col("source").alias("_source"), F.col("bound").alias("_bound"))
        inside = rows.join(small_or_not(edge), F.col("source").eqNullSafe(F.col("_source")) & (F.shiftrightunsigned("hash", shift + BITS) == F.col("_bound")))
        histogram = inside.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        so_far = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("in_bucket").over(so_far)).select(F.col("source").alias("_source"), "bucket", "in_bucket", "upto")
        # the bucket in which the budget ends: the first whose running sum is over it, else the last
        ends = plan.join(histogram, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("missing"), F.struct("bucket", "in_bucket", "upto"))).alias("over"), F.max(F.struct("bucket", "in_bucket", "upto")).alias("last")
        )
        ends = ends.select(F.col("source").alias("_source"), F.coalesce("over", "last").alias("end"))
        plan = plan.join(ends, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "source_size", "target", "copies", F.col("end.bucket").alias("bound"), (F.col("missing") - F.col("end.upto") + F.col("end.in_bucket")).alias("missing"), F.col("end.in_bucket").alias("bound_size")
        )
        plan = materialise(plan)
    return plan


def taken(size: Column, hash: Column, copies: Column, bound: Column, missing: Column, bound_size: Column) -> Column:
    """Words that the mix takes of a document."""
    part = F.when(bound_size > 0, F.floor(missing.cast("decimal(19,0)") * size / bound_size).cast("long")).otherwise(F.lit(0))
    return copies * size + F.when(hash < bound, size).when(hash == bound, part).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken."""
    rows = materialise(sizes(docs))
    plan = small_or_not(thresholds(rows, weights, most).withColumnRenamed("source", "_source"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken(*map(F.col, ("size", "hash", "copies", "bound", "missing", "bound_size"))).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs, each row as many times as the mix uses it, with its own columns only.

    Texts aren't cut: a last, partial use counts as a whole one from half of the words up.
    A document without words has nothing to weigh and stays once.
    """
    size, hash, times = fresh(docs, "_size", "_hash", "_times")
    found = thresholds(materialise(sizes(docs).select("source", "size", "hash")), weights, most)
    # every column of the plan gets a name that docs doesn't have
    source, copies, bound, missing, bound_size = fresh(docs, "_source", "_copies", "_bound", "_missing", "_bound_size")
    plan = found.select(F.col("source").alias(source), F.col("copies").alias(copies), F.col("bound").alias(bound), F.col("missing").alias(missing), F.col("bound_size").alias(bound_size))
    rows = docs.withColumn(size, words()).withColumn(hash, _hash()).join(small_or_not(plan), F.col("source").cast("string").eqNullSafe(F.col(source)))
    uses = F.round(taken(*map(F.col, (size, hash, copies, bound, missing, bound_size))) / F.col(size)).cast("int")
    rows = rows.withColumn(times, F.when(F.col(size) > 0, uses).otherwise(1)).where(F.col(times) > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(times)).drop(times)
