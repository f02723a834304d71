"""A mixture of sources with target shares of the total size in tokens.

Every document gets a hash-random key. Documents are range-sorted by (source, key); the totals of the sorted
partitions, one small row per partition and source, give each partition its offset, so that the running sums of tokens
need no single task per source. Each source is cut where its running sum reaches its budget; a small source is used in
whole epochs first, at most ``max_repeats`` of them in all.

The total is the largest at which every source can reach its target within its repeats, unless ``total`` is given;
then a source that cannot reach its budget gives all it may, and the report shows the share it falls short.

Defined results: a document without text, without tokens, without a source, or whose source has no target, takes no
part; a target without documents is reported with zero tokens and does not bound the total; exact copies are documents
of their own; the cut falls on the document boundary that is nearest to the budget.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.shared import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pattern of byte-level vocabularies: contractions, words, numbers, other signs, spaces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the size of ``text`` in tokens; NULL and empty texts have none."""
    # The vocabulary goes to the executors with the job; they need no copy of their own.
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)


    def count(batches):
        encoding = _encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = [len(encoding.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(text, *keep).mapInArrow(count, f"{kinds}, n_tokens bigint")


def running_sums(docs: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """``docs`` with ``before``, the sum of ``size`` over the rows of the same group that come earlier.

    The prefix sums are distributed: within range partitions, plus the totals of the partitions before.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = docs.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "placed")
    totals = placed.groupBy(group, "__part").agg(F.sum(size).alias("__total"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    # One row per partition and group: bounded by the number of partitions plus the number of groups.
    return local.join(F.broadcast(offsets), [group, "__part"]).withColumn("before", F.col("__offset") + F.col("__local")).drop("__part", "__offset", "__local")


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, n_tokens, copies) and the report of the shares reached.

    ``targets`` has the columns source, target_share and max_repeats, one row per source.
    """
    aims = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = with_tokens(docs.filter(F.col(text).isNotNull() & F.col(source).isNotNull()), text, [key, source], tokenizer).select(F.col(key), F.col(source).alias("source"), "n_tokens")
    sized = materialize(sized.filter("n_tokens > 0").join(F.broadcast(aims.select("source")), "source", "left_semi").withColumn("__random", F.xxhash64(F.lit(seed), F.col(key))), "sized")
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = aims.join(sizes, "source", "left").na.fill(0, ["tokens", "documents"])
    if total is None:
        total = plan.filter("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0
    plan = plan.withColumn("budget", F.least(F.floor(F.lit(float(total)) * F.col("target_share") + 0.5), F.col("tokens") * F.col("max_repeats")).cast("bigint"))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = materialize(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan")
    summed = running_sums(sized, "source", ["__random", key], "n_tokens").join(F.broadcast(plan.select("source", "epochs", "rest", "max_repeats")), "source")
    # A document is in the last, partial epoch if more than half of it lies before the cut.
    partial = ((F.col("before") * 2 + F.col("n_tokens")) <= F.col("rest") * 2) & (F.col("epochs") < F.col("max_repeats"))
    mixture = summed.withColumn("copies", F.col("epochs") + partial.cast("int")).filter("copies > 0").select(key, "source", "n_tokens", "copies")
    mixture = materialize(mixture, "mixture")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies"))
    used = materialize(used, "used")
    everything = used.agg(F.sum("used_tokens")).first()[0] or 1
    report = plan.join(used, "source", "left").select(
        "source",
        "target_share",
        F.coalesce(F.col("used_tokens") / F.lit(everything), F.lit(0.0)).alias("actual_share"),
        "max_repeats",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "tokens",
        "budget",
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
    )
    return mixture, report
