"""The ordered folds and logs as Structured Streaming queries.

State is bounded per key; a chunk that arrives late (not after the last one folded) is refused and reported, so that a
replayed micro-batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.states import context_step

OUT = "doc long, chunk int, accepted boolean, n_characters int, n_open int, n_resolved int"


def fold_contexts(stream: DataFrame) -> DataFrame:
    """Rolling context per document of a stream of (doc, chunk, characters, opened, resolved): a row per chunk."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = json.loads(state.get[0]) if state.exists else {}
        out = []
        for pdf in frames:
            for r in pdf.sort_values("chunk").itertuples(index=False):
                fresh = int(r.chunk) > current.get("last_chunk", -1)
                if fresh:
                    current = context_step(current, int(r.chunk), list(r.characters), list(r.opened), list(r.resolved))
                sizes = [len(current.get(k, [])) for k in ("characters", "open_threads", "resolved")]
                out.append((key[0], int(r.chunk), fresh, *sizes))
        state.update((json.dumps(current, ensure_ascii=False),))
        yield pd.DataFrame(out, columns=["doc", "chunk", "accepted", "n_characters", "n_open", "n_resolved"])

    return stream.groupBy("doc").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_usage(stream: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Calls and sizes per window and type of a stream of (ts, event_type, value); later rows than ``late`` are dropped."""
    marked = stream.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("size"))


def merge_log(path: str, keys: list[str], version: str):
    """A ``foreachBatch`` function that appends each batch's latest rows to a log; ``read_log`` gives the snapshot.

    A batch that is replayed after a failure writes the same folder again: the log is idempotent.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
        latest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_log(spark, path: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "epoch")).alias("r")).select(*keys, "r.*").drop("epoch")
