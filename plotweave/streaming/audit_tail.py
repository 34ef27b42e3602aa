"""Incremental verification of an audit log as it grows (an extension)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.audit import GENESIS, entry_hash

OUT = "log_id string, seq long, ok boolean, kind string"


def verify_stream(entries: DataFrame) -> DataFrame:
    """``log_id, seq, ok, kind`` of each entry of a stream, keyed by log.

    State is the chain's head and the entries that came before their
    predecessor, by number; a break is told once and the chain goes on from the
    entry as stored.
    """

    def step(key, frames, state: GroupState):
        head, nxt, waiting = state.get if state.exists else (GENESIS, 1, "[]")
        early = {r["seq"]: r for r in (pd.read_json(waiting, dtype=False).to_dict("records") if waiting != "[]" else [])}
        for f in frames:
            early |= {int(r["seq"]): r for r in f.to_dict("records")}
        out = []
        while nxt in early:
            r = {k: (None if isinstance(v, float) and pd.isna(v) else v) for k, v in early.pop(nxt).items()}
            kind = "link" if r["prev_hash"] != head else "content" if entry_hash(r) != r["hash"] else None
            out.append((key[0], nxt, kind is None, kind))
            head, nxt = r["hash"], nxt + 1
        state.update((head, nxt, pd.DataFrame(early.values()).to_json(orient="records") if early else "[]"))
        yield pd.DataFrame(out, columns=["log_id", "seq", "ok", "kind"])

    return entries.groupBy("log_id").applyInPandasWithState(step, OUT, "head string, nxt long, waiting string", "append", "NoTimeout")
