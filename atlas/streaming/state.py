"""Review decisions and map corrections as keyed state that outlives its queries.

Both folds keep a few values for each key in a RocksDB store below the checkpoint, so the state may exceed memory and
a restarted query goes on where the last one stopped. Every batch emits the keys it touched; :func:`keep_batches`
writes them under the batch's number, which makes a repeated batch harmless, and :func:`current` reads the last state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from atlas.streaming.decisions import DROP_MARK, NEUTRAL_MARKS, real_moves
from atlas.streaming.flows import drain

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def review_state(decisions: DataFrame, key: str = "hash", seq: str = "seq") -> DataFrame:
    """``key, label, dropped`` after every batch, for the keys in it; the rules are those of ``replay_decisions``.

    The order of arrival does not matter: the label with the highest number wins, a drop mark is permanent.
    """
    marks, drop = (DROP_MARK, *NEUTRAL_MARKS), DROP_MARK

    class Review(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getValueState("kept", "seq long, label string, dropped boolean")

        def handleInputRows(self, group, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            at, label, dropped = self.kept.get() or (None, None, False)
            for pdf in frames:
                dropped = bool(dropped or (pdf["label"] == drop).any())
                real = pdf[pdf["label"].notna() & ~pdf["label"].isin(marks)]
                if len(real):
                    last = real.loc[real["seq"].idxmax()]
                    if at is None or last["seq"] >= at:
                        at, label = int(last["seq"]), last["label"]
            self.kept.update((at, label, dropped))
            yield pd.DataFrame({key: [group[0]], "label": [label], "dropped": [dropped]})

        def close(self) -> None:
            pass

    kind = decisions.schema[key].dataType.simpleString()
    rows = decisions.select(key, F.col(seq).cast("long").alias("seq"), "label")
    return rows.groupBy(key).transformWithStateInPandas(
        Review(), f"{key} {kind}, label string, dropped boolean", "Update", "None")


def correction_state(moves: DataFrame, idle: float | None = None, event_time: str = "ts") -> DataFrame:
    """``path, section`` after every batch, for the paths in it; a null section: no correction stands.

    ``moves``: path, seq, from_section, to_section. A path's first move fixes its origin. Moving back to the origin
    erases correction and origin, any other move replaces the correction. Moves of a batch apply in the order of
    ``seq``; one that is not newer than the last applied is a repetition and changes nothing.

    With ``idle`` (seconds), ``moves`` carries an event time under a watermark: a path without a move for that long
    ends its session, whose origin vanishes while its correction stays. The pause counts, also inside a batch; a
    timer frees the origins of paths that never move again.
    """
    wait = None if idle is None else int(idle * 1000)

    class Corrections(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.origin = handle.getValueState("origin", "section string, until long")
            self.last = handle.getValueState("last", "seq long, section string")

        def handleInputRows(self, group, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            origin, until = self.origin.get() or (None, None)
            done, section = self.last.get() or (None, None)
            moved = pd.concat(list(frames)).sort_values("seq")  # the moves of one item in one batch
            for row in moved.itertuples(index=False):
                if done is not None and row.seq <= done:
                    continue
                done = int(row.seq)
                if wait is not None and until is not None and row.at > until:
                    origin = None
                if origin is None:
                    origin = row.from_section
                if row.to_section == origin:
                    origin, section = None, None
                else:
                    section = row.to_section
                until = None if wait is None else int(row.at) + wait
            self.last.update((done, section))
            if origin is None:
                self.origin.clear()
            else:
                self.origin.update((origin, until))
                if wait is not None:
                    self.handle.registerTimer(until)
            yield pd.DataFrame({"path": [group[0]], "section": [section]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            origin, until = self.origin.get() or (None, None)
            if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
                self.origin.clear()
            yield from ()

        def close(self) -> None:
            pass

    kind = moves.schema["path"].dataType.simpleString()
    at = F.lit(0) if idle is None else F.unix_millis(event_time)
    rows = real_moves(moves).select("path", F.col("seq").cast("long").alias("seq"), "from_section", "to_section",
                                    at.cast("long").alias("at"), *([event_time] if idle is not None else []))
    return rows.groupBy("path").transformWithStateInPandas(
        Corrections(), f"path {kind}, section string", "Update", "None" if idle is None else "EventTime")


def keep_batches(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run ``stream`` over all that has arrived, its state in RocksDB, and write every batch under its number."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        drain(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), "update", checkpoint)
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The last row of each key over all batches written so far."""
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(key, "_r.*")
