"""Streaming forms of two operators. These are extensions: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import STATUS_RANK


def state_stream(events: DataFrame) -> DataFrame:
    """The resolved state of each (case_id, concept) as propositions arrive (columns verification, clinical_status, turn_idx).

    Late turns count at their place: the state keeps the arg-max of (rank, turn) and of turn. It is kept for good.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, s_rank, s_turn, verified, v_turn = state.get if state.exists else ("active", 0, -1, "confirmed", -1)
        for f in frames:
            for v, s, t in zip(f["verification"], f["clinical_status"], f["turn_idx"]):
                r = STATUS_RANK.get(s, 0)
                if r and (r, t) >= (s_rank, s_turn):
                    status, s_rank, s_turn = s, r, int(t)
                if v and t >= v_turn:
                    verified, v_turn = v, int(t)
        state.update((status, s_rank, s_turn, verified, v_turn))
        yield pd.DataFrame({"case_id": [key[0]], "concept": [key[1]], "final_verification": [verified], "final_status": [status]})

    return events.groupBy("case_id", "concept").applyInPandasWithState(
        update, "case_id long, concept string, final_verification string, final_status string", "status string, s_rank int, s_turn int, verified string, v_turn int", "update", "NoTimeout"
    )


def session_stream(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a key with their number of events and sum of values, closed by the watermark."""
    w = F.session_window(at, gap)
    out = events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")
