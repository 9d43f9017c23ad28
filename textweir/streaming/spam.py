"""The live spam guard: per-actor state across micro-batches with ``transformWithStateInPandas`` (RocksDB state store)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textweir.kernels import spam as K
from textweir.kernels.spam import SpamConfig
from textweir.operators.spam import actor_key

_STATE = "last double, times array<double>, texts array<string>, seen array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SpamProcessor(StatefulProcessor):
    """One value per actor, read and written once a micro-batch; rows of a batch are folded in sequence order."""

    def __init__(self, cfg: SpamConfig, columns: list[str], text: str, now_ms: str, order: str, idle_ms: int | None):
        self.cfg, self.columns, self.text, self.now_ms, self.order, self.idle_ms = cfg, columns, text, now_ms, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Each configuration has a state of its own, so a restart with other limits does not go by the old ones' records.
        self.state = handle.getValueState(f"actor_{zlib.crc32(self.cfg.scope().encode()):08x}", _STATE, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actor = K.Actor()
        if self.state.exists():
            last, times, texts, seen = self.state.get()
            actor = K.Actor(-math.inf if last is None else last, list(times or ()), dict(zip(texts or (), seen or ())))
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        reasons = []
        for text, now in zip(batch[self.text], batch[self.now_ms]):
            reason, _, normal = K.precheck(None if key[0] == K.UNKNOWN_ACTOR else key[0], text, self.cfg)
            reasons.append(reason or actor.decide(normal, K.clock(None if pd.isna(now) else float(now), self.cfg), self.cfg))
        self.state.update((None if actor.last == -math.inf else actor.last, actor.times, list(actor.texts), list(actor.texts.values())))
        out = batch[self.columns].copy()
        out["allowed"], out["reason"] = [r is None for r in reasons], reasons
        yield out

    def close(self) -> None:
        pass


def guard_stream(df: DataFrame, cfg: SpamConfig | None = None, actor: str = "actor_key", text: str = "text", now_ms: str = "now_ms", order: str = "seq", idle_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame with ``allowed`` and ``reason``; across micro-batches arrival order holds.

    ``idle_ms`` bounds the state: an actor that sends nothing for so long (by the cluster's clock, and no less than the windows
    of the configuration) is forgotten. It is for triggers that run on; Spark does not end an availableNow query whose state
    expires, so it is off by default. The session must use the RocksDB state store (``PROVIDER``)."""
    cfg = cfg or SpamConfig()
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    grouped = df.withColumn("_actor", actor_key(actor)).groupBy("_actor")
    processor = SpamProcessor(cfg, df.columns, text, now_ms, order, idle_ms and max(idle_ms, cfg.retention_ms))
    return grouped.transformWithStateInPandas(processor, f"{fields}, allowed boolean, reason string", "Append", "processingTime" if idle_ms else "none")
