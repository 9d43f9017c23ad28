"""Per-actor anti-spam decisions as a fold over (text, now_ms) in arrival order. No Spark here."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

from .text import SPACE_RUN, lower_nfkc, strip_zero_width, u16_width

EMPTY, MISSING_ACTOR, TOO_FAST, DUPLICATE, BURST = "empty", "missing_actor", "too_fast", "duplicate", "burst"
UNKNOWN_ACTOR = "__unknown_actor__"
MAX_TEXT_UNITS = 512
MAX_TEXTS = 256
_MAX_LIMIT = 2**53 - 1
_LEAST = {"min_interval_ms": 0, "duplicate_window_ms": 1, "burst_window_ms": 1, "burst_max_messages": 1, "max_actors": 1}


@dataclass(frozen=True)
class SpamConfig:
    """Invalid limits fall back to the defaults; they are never clamped."""

    min_interval_ms: int = 700
    duplicate_window_ms: int = 12_000
    burst_window_ms: int = 10_000
    burst_max_messages: int = 6
    max_actors: int = 3000
    actor_key_policy: str = "shared_unknown"
    clock_policy: str = "input_or_system"
    track_rejected_attempts: bool = False

    def __post_init__(self):
        for name, least in _LEAST.items():
            object.__setattr__(self, name, bounded_int(getattr(self, name), getattr(type(self), name), least))
        if self.actor_key_policy != "reject_missing":
            object.__setattr__(self, "actor_key_policy", "shared_unknown")
        if self.clock_policy != "system":
            object.__setattr__(self, "clock_policy", "input_or_system")
        object.__setattr__(self, "track_rejected_attempts", self.track_rejected_attempts is True)

    @property
    def retention_ms(self) -> int:
        return max(self.min_interval_ms, self.duplicate_window_ms, self.burst_window_ms)

    def scope(self) -> str:
        """Separates the states of differently configured guards in one store."""
        return repr((self.min_interval_ms, self.duplicate_window_ms, self.burst_window_ms, self.burst_max_messages, self.max_actors, self.actor_key_policy, self.clock_policy, self.track_rejected_attempts))


def bounded_int(value: object, fallback: int, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return fallback
    whole = math.trunc(value)
    return whole if least <= whole <= _MAX_LIMIT else fallback


def normalize_text(value: object) -> str:
    """Zero-width marks out, NFKC lower case, blanks to one space, at most 512 UTF-16 units, trimmed."""
    s = SPACE_RUN.sub(" ", lower_nfkc(strip_zero_width(value)))
    if len(s) * 2 > MAX_TEXT_UNITS:
        units = 0
        for i, c in enumerate(s):
            units += u16_width(c)
            if units > MAX_TEXT_UNITS:
                s = s[:i]
                break
    return s.strip(" ")


def normalize_actor(value: object) -> str:
    return SPACE_RUN.sub(" ", lower_nfkc(strip_zero_width(value))).strip(" ") or UNKNOWN_ACTOR


@dataclass
class Actor:
    """What is remembered of an actor. ``last`` is -inf before the first message; ``texts`` keeps insertion order."""

    last: float = -math.inf
    times: list[float] = field(default_factory=list)
    texts: dict[str, float] = field(default_factory=dict)

    def forget(self, now: float, cfg: SpamConfig, bursts: bool) -> None:
        """Windows are half-open: what is exactly a window old is gone."""
        self.texts = {t: at for t, at in self.texts.items() if now - at < cfg.duplicate_window_ms}
        if bursts:
            self.times = [t for t in self.times if now - t < cfg.burst_window_ms]

    def remember(self, text: str, now: float, cfg: SpamConfig) -> None:
        self.times.append(now)
        self.last = now
        self.texts.pop(text, None)
        self.texts[text] = now
        if len(self.times) > cfg.burst_max_messages:
            self.times = sorted(self.times)[-cfg.burst_max_messages :]
        for old in sorted(self.texts, key=self.texts.__getitem__)[: max(0, len(self.texts) - MAX_TEXTS)]:
            del self.texts[old]

    def reject(self, reason: str, text: str, now: float, cfg: SpamConfig) -> str:
        """A tracked rejection counts as an attempt at the latest time seen."""
        if cfg.track_rejected_attempts:
            now = max(now, self.last)
            self.forget(now, cfg, True)
            self.remember(text, now, cfg)
        return reason

    def decide(self, text: str, now: float, cfg: SpamConfig) -> str | None:
        """The reason to block a normalised text, None to allow it."""
        if cfg.min_interval_ms > 0 and self.last >= 0 and now - self.last < cfg.min_interval_ms:
            return self.reject(TOO_FAST, text, now, cfg)
        self.forget(now, cfg, False)
        if text in self.texts:
            return self.reject(DUPLICATE, text, now, cfg)
        self.forget(now, cfg, True)
        if len(self.times) >= cfg.burst_max_messages:
            return self.reject(BURST, text, now, cfg)
        self.remember(text, now, cfg)
        return None


def precheck(actor: object, text: object, cfg: SpamConfig) -> tuple[str | None, str, str]:
    """(reason, actor key, normalised text): the tests that touch no state."""
    key, normal = normalize_actor(actor), normalize_text(text)
    if not normal:
        return EMPTY, key, normal
    if cfg.actor_key_policy == "reject_missing" and key == UNKNOWN_ACTOR:
        return MISSING_ACTOR, key, normal
    return None, key, normal


def clock(now: float | None, cfg: SpamConfig) -> float:
    usable = cfg.clock_policy == "input_or_system" and now is not None and math.isfinite(now)
    return float(now) if usable else float(int(time.time() * 1000))


class SpamGuard:
    """All actors together, with the eviction of stale and then oldest actors above ``max_actors``."""

    def __init__(self, cfg: SpamConfig | None = None, store: dict[str, Actor] | None = None, **options):
        self.cfg = replace(cfg or SpamConfig(), **options)
        self.scope = self.cfg.scope()
        self.store = {} if store is None else store

    def _evict(self, now: float) -> None:
        own = {k: a for k, a in self.store.items() if k[0] == self.scope}
        extra = len(own) - self.cfg.max_actors
        for k, a in own.items():
            if extra <= 0:
                return
            if now - a.last > self.cfg.retention_ms:
                del self.store[k]
                extra -= 1
        if extra > 0:
            left = [k for k in own if k in self.store]
            for k in sorted(left, key=lambda k: own[k].last)[:extra]:
                del self.store[k]

    def check(self, actor: object, text: object, now: float | None = None) -> str | None:
        at = clock(now, self.cfg)
        reason, key, normal = precheck(actor, text, self.cfg)
        if reason:
            return reason
        k = (self.scope, key)
        state = self.store.get(k) or Actor()
        reason = state.decide(normal, at, self.cfg)
        if state.last > -math.inf or reason is None:
            self.store[k] = state
        self._evict(at)
        return reason

    def reset(self) -> None:
        for k in [k for k in self.store if k[0] == self.scope]:
            del self.store[k]
