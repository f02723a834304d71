"""Ordered folds of chunk results into bounded state, for batches; ``streaming`` runs the same steps incrementally."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

#: How many entries of each list the rolling context keeps in a document of less than two million characters.
CAPS = {"characters": 40, "open_threads": 40, "resolved": 30}
MILLION = 1_000_000
STALE_AFTER = 50


def extend(items: list, new: list, cap: int) -> list:
    """Distinct entries, the newest last, at most ``cap`` of them."""
    fresh = [x for x in dict.fromkeys(new) if x]
    return [*(x for x in items if x not in fresh), *fresh][-cap:]


def context_step(state: dict, chunk: int, characters: list, opened: list, resolved: list, length: int = 0) -> dict:
    """The rolling context after one chunk: what it resolves is open no more. ``length`` of the document scales the caps."""
    caps = {name: cap * max(1, length // MILLION) for name, cap in CAPS.items()}
    done = extend(state.get("resolved", []), resolved, caps["resolved"])
    gone = set(resolved)
    still = [x for x in extend(state.get("open_threads", []), opened, caps["open_threads"]) if x not in gone]
    return {"characters": extend(state.get("characters", []), characters, caps["characters"]), "open_threads": still, "resolved": done, "last_chunk": chunk}


def memory_step(state: dict, chunk: int, threads: list) -> dict:
    """Scan memory: threads are the same by their first 20 characters; unreferenced ones turn stale, then go."""
    known = dict(state.get("threads", {}))
    for t in threads:
        if t:
            known[t[:20]] = chunk
    open_ = sorted((t for t in known.items() if chunk - t[1] <= STALE_AFTER), key=lambda t: (t[1], t[0]))[-30:]
    stale = sorted((t for t in known.items() if chunk - t[1] > STALE_AFTER), key=lambda t: (t[1], t[0]))[-10:]
    return {"threads": dict(stale + open_)}


def rolling_context(rows: DataFrame, by: str) -> DataFrame:
    """Final context per document from (by, chunk, characters, opened, resolved) with one row per chunk.

    A column ``length``, the characters of the whole document, scales the caps; without it they are the least ones.
    The state is bounded; a document's chunks are folded in order by one function, as each step needs the one before.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        for r in pdf.sort_values("chunk").itertuples(index=False):
            state = context_step(state, int(r.chunk), list(r.characters), list(r.opened), list(r.resolved), int(getattr(r, "length", 0)))
        return pd.DataFrame([(pdf[by].iloc[0], state["last_chunk"], state["characters"], state["open_threads"], len(state["resolved"]))], columns=[by, "last_chunk", "characters", "open_threads", "n_resolved"])

    return rows.groupBy(by).applyInPandas(fold, f"{by} {dict(rows.dtypes)[by]}, last_chunk int, characters array<string>, open_threads array<string>, n_resolved int")


def scan_memory(rows: DataFrame, by: str) -> DataFrame:
    """(by, thread, last_seen, stale) of the threads remembered after the last chunk."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        chunk = 0
        for r in pdf.sort_values("chunk").itertuples(index=False):
            chunk = int(r.chunk)
            state = memory_step(state, chunk, list(r.opened))
        return pd.DataFrame([(pdf[by].iloc[0], t, at, chunk - at > STALE_AFTER) for t, at in state["threads"].items()], columns=[by, "thread", "last_seen", "stale"])

    return rows.groupBy(by).applyInPandas(fold, f"{by} {dict(rows.dtypes)[by]}, thread string, last_seen int, stale boolean")
