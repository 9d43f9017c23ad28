"""The spam guard over tables: a streamed fold per actor, and plain windows for the tracked mode on a monotone clock."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textweir.functions import columns as C
from textweir.kernels import spam as K
from textweir.kernels.spam import SpamConfig

_DECISION = "struct<allowed:boolean,reason:string>"


def actor_key(c: Column | str) -> Column:
    """Normalised actor; all missing actors share one key."""
    folded = F.trim(F.regexp_replace(C.lower_nfkc(C.strip_zero_width(c)), C._SPACES + "+", " "))
    return F.when(folded == "", K.UNKNOWN_ACTOR).otherwise(folded)


def normalized_text(c: Column | str) -> Column:
    """Text as duplicates are compared; beyond-BMP text is cut by UTF-16 units in the kernel instead."""
    folded = F.regexp_replace(C.lower_nfkc(C.strip_zero_width(c)), C._SPACES + "+", " ")
    return F.trim(F.substring(folded, 1, K.MAX_TEXT_UNITS))


def decide(df: DataFrame, cfg: SpamConfig | None = None, actor: str = "actor_key", text: str = "text", now_ms: str = "now_ms", order: str | list[str] = "seq", exact_eviction: bool = False, live: Column | None = None) -> DataFrame:
    """``df`` with ``decision``; where ``live`` is given and false, a row is passed over and its decision is null. Arrival order is ``order``, not the clock.

    Rows are hashed by actor, sorted and streamed through the fold, so memory is one actor's bounded state, whatever an
    actor's number of rows. Actors are never evicted unless ``exact_eviction``, which couples all actors and therefore
    folds the whole table in one task."""
    cfg = cfg or SpamConfig()
    order = [order] if isinstance(order, str) else order
    names = df.columns
    keyed = df.withColumn("_actor", actor_key(actor)).withColumn("_now", F.col(now_ms).cast("double")).withColumn("_live", F.lit(True) if live is None else F.coalesce(live, F.lit(False)))
    sorted_ = keyed.coalesce(1).sortWithinPartitions(*order) if exact_eviction else keyed.repartition("_actor").sortWithinPartitions("_actor", *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard, key, state = K.SpamGuard(cfg), None, K.Actor()
        for batch in batches:
            allowed, reasons = [], []
            for a, t, now, judged in zip(*(batch.column(c).to_pylist() for c in ("_actor", text, "_now", "_live"))):
                if not judged:
                    allowed.append(None)
                    reasons.append(None)
                    continue
                if exact_eviction:
                    reason = guard.check(None if a == K.UNKNOWN_ACTOR else a, t, now)
                else:
                    if a != key:
                        key, state = a, K.Actor()
                    reason, _, normal = K.precheck(None if a == K.UNKNOWN_ACTOR else a, t, cfg)
                    reason = reason or state.decide(normal, K.clock(now, cfg), cfg)
                allowed.append(reason is None)
                reasons.append(reason)
            decision = pa.StructArray.from_arrays([pa.array(allowed, pa.bool_()), pa.array(reasons, pa.string())], names=["allowed", "reason"], mask=pa.array([a is None for a in allowed], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), decision], names=[*names, "decision"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return sorted_.mapInArrow(fold, f"{fields}, decision {_DECISION}")


def decide_tracked(df: DataFrame, cfg: SpamConfig | None = None, actor: str = "actor_key", text: str = "text", now_ms: str = "now_ms", order: str | list[str] = "seq") -> DataFrame:
    """As :func:`decide` with ``track_rejected_attempts``, as windows: every attempt is recorded, so the previous row is
    the previous attempt. Exact where the clock does not run backwards per actor and no actor sends more than 256
    different texts in a duplicate window."""
    cfg = cfg or SpamConfig(track_rejected_attempts=True)
    order = [order] if isinstance(order, str) else order
    keyed = df.withColumns({"_actor": actor_key(actor), "_text": normalized_text(text), "_now": F.col(now_ms).cast("double")})
    keyed = keyed.withColumn("_pre", F.when(F.col("_text") == "", K.EMPTY).when((F.lit(cfg.actor_key_policy) == "reject_missing") & (F.col("_actor") == K.UNKNOWN_ACTOR), K.MISSING_ACTOR))
    live = F.col("_pre").isNull()
    w = Window.partitionBy("_actor", live).orderBy(*order)
    same = Window.partitionBy("_actor", live, "_text").orderBy(*order)
    gap = lambda c: F.col("_now") - c
    last, again, nth = F.lag("_now").over(w), F.lag("_now").over(same), F.lag("_now", cfg.burst_max_messages).over(w)
    reason = (
        F.when(~live, F.col("_pre"))
        .when((F.lit(cfg.min_interval_ms) > 0) & (last >= 0) & (gap(last) < cfg.min_interval_ms), K.TOO_FAST)
        .when(gap(again) < cfg.duplicate_window_ms, K.DUPLICATE)
        .when(gap(nth) < cfg.burst_window_ms, K.BURST)
    )
    out = keyed.withColumn("_reason", reason)
    return out.withColumn("decision", F.struct(F.col("_reason").isNull().alias("allowed"), F.col("_reason").alias("reason"))).drop("_actor", "_text", "_now", "_pre", "_reason")


def guard(cfg: SpamConfig | None = None, **columns):
    """The guard as a step of a :class:`textweir.plans.pipeline.TextPipeline`; it passes over rows that an earlier guard blocked."""

    def run(df: DataFrame, live: Column | None = None) -> DataFrame:
        return decide(df, cfg, live=live, **columns)

    run.skips = True
    return run
