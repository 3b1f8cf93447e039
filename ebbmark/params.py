"""Strategies as parameter records, with the standard sets for both data sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

HOUSE_WINDOW_MS = 10_000
TAXI_WINDOW_MS = 60_000
TICK_MS = 200          # watermarks are emitted on this periodic tick
WARMUP_EVENTS = 500    # an ADWIN stream emits no watermark before this many events
SAMPLES = 200          # length of the mean-shift buffer


@dataclass(frozen=True)
class Strategy:
    """One lateness policy.

    ``kind`` is ``fixed``, ``mean_shift``, ``adwin`` or ``speculative``. ``sample`` says what the
    adaptive kinds measure: ``network`` (arrival minus event time) or ``disorder`` (distance behind
    the newest event time so far). ``offset_ms`` is the extra millisecond that a bounded
    out-of-orderness watermark subtracts; the adaptive watermarks do not subtract it.
    """

    name: str
    kind: str
    window_ms: int
    slack_ms: int = 0
    lateness_ms: int = 0
    offset_ms: int = 0
    sample: str = "network"
    threshold_ms: int | None = None
    late_limit: float | None = None
    delta_step: float | None = None
    floor_ms: int | None = None
    cap_ms: int | None = None
    warmup_cap_ms: int | None = None
    warmup_buffer_ms: int = 0
    buffer_ms: int = 0
    mode: int | None = None

    def clamp(self, slack: int) -> int:
        low = slack if self.floor_ms is None else max(self.floor_ms, slack)
        return low if self.cap_ms is None else min(self.cap_ms, low)


def _percent(x: float) -> int:
    return int(x * 100)


# Smart home -----------------------------------------------------------------

def house_naive() -> Strategy:
    return Strategy("naive", "fixed", HOUSE_WINDOW_MS, offset_ms=1)


def house_fixed(slack_s: int = 5) -> Strategy:
    return Strategy(f"watermark_{slack_s}s", "fixed", HOUSE_WINDOW_MS, slack_ms=slack_s * 1000, offset_ms=1)


def house_mean_shift(threshold_ms: int = 1000) -> Strategy:
    return Strategy(f"adaptive_adwin_dt{threshold_ms}", "mean_shift", HOUSE_WINDOW_MS, slack_ms=5000,
                    threshold_ms=threshold_ms, cap_ms=12_000, buffer_ms=500)


def house_adwin(late_limit: float = 0.1, delta_step: float = 0.1) -> Strategy:
    return Strategy(f"adaptive_real_adwin_L{_percent(late_limit)}_dd{_percent(delta_step)}", "adwin",
                    HOUSE_WINDOW_MS, slack_ms=2000, late_limit=late_limit, delta_step=delta_step,
                    floor_ms=1000, cap_ms=12_000, warmup_cap_ms=8000, warmup_buffer_ms=1000, buffer_ms=1000)


def house_speculative() -> Strategy:
    return Strategy("speculative", "speculative", HOUSE_WINDOW_MS, lateness_ms=15_000, offset_ms=1)


# Taxi -----------------------------------------------------------------------

def taxi_naive() -> Strategy:
    return Strategy("taxi_naive", "fixed", TAXI_WINDOW_MS, offset_ms=1)


def taxi_in_order() -> Strategy:
    """Reference run over a sorted topic: timestamps never go back, so no slack is needed."""
    return Strategy("taxi_inorder", "fixed", TAXI_WINDOW_MS, offset_ms=1)


def taxi_fixed(mode: int = 3, slack_s: int | None = None) -> Strategy:
    seconds = slack_s if slack_s is not None else (1500 if mode == 3 else 36)
    name = f"taxi_watermark_m{mode}" + (f"_s{slack_s}" if slack_s is not None else "")
    return Strategy(name, "fixed", TAXI_WINDOW_MS, slack_ms=seconds * 1000, offset_ms=1, mode=mode)


def taxi_mean_shift(mode: int = 3, threshold_s: int | None = None) -> Strategy:
    name = f"taxi_adaptive_adwin_m{mode}" + (f"_dt{threshold_s}" if threshold_s is not None else "")
    # A zero or negative override means the default threshold of the mode.
    override = threshold_s * 1000 if threshold_s and threshold_s > 0 else None
    if mode == 3:
        return Strategy(name, "mean_shift", TAXI_WINDOW_MS, slack_ms=600_000, sample="disorder",
                        threshold_ms=override or 60_000, floor_ms=10_000, cap_ms=3_600_000,
                        buffer_ms=60_000, mode=mode)
    return Strategy(name, "mean_shift", TAXI_WINDOW_MS, slack_ms=36_000, sample="disorder",
                    threshold_ms=override or 500, floor_ms=1000, cap_ms=250_000, buffer_ms=5000, mode=mode)


def taxi_adwin(mode: int = 3, late_limit: float | None = None, delta_step: float | None = None) -> Strategy:
    limit = 0.1 if late_limit is None else late_limit
    step = 0.1 if delta_step is None else delta_step
    name = f"taxi_real_adwin_m{mode}"
    if late_limit is not None or delta_step is not None:
        name += f"_L{_percent(limit)}_dd{_percent(step)}"
    if mode == 3:
        slack, floor, cap, warm, drift = 600_000, 10_000, 3_600_000, 60_000, 120_000
    else:
        slack, floor, cap, warm, drift = 36_000, 1000, 250_000, 5000, 10_000
    return Strategy(name, "adwin", TAXI_WINDOW_MS, slack_ms=slack, sample="disorder", late_limit=limit,
                    delta_step=step, floor_ms=floor, cap_ms=cap, warmup_cap_ms=cap, warmup_buffer_ms=warm,
                    buffer_ms=drift, mode=mode)


def taxi_speculative(mode: int = 3) -> Strategy:
    return Strategy(f"taxi_speculative_m{mode}", "speculative", TAXI_WINDOW_MS,
                    lateness_ms=3_600_000 if mode == 3 else 120_000, offset_ms=1, mode=mode)


# Standard sets --------------------------------------------------------------

def house_comparison() -> list[Strategy]:
    return [house_naive(), house_fixed(5), house_mean_shift(1000), house_adwin(0.1, 0.1), house_speculative()]


def taxi_comparison(mode: int = 3) -> list[Strategy]:
    if mode == 3:
        return [taxi_naive(), taxi_fixed(3, 1500), taxi_mean_shift(3, 60), taxi_adwin(3, 0.1, 0.1),
                taxi_speculative(3)]
    return [taxi_naive(), taxi_fixed(mode), taxi_mean_shift(mode), taxi_adwin(mode), taxi_speculative(mode)]


# Parameter grids of the sensitivity study: fixed values.
HOUSE_SLACKS_S = (1, 3, 5, 8, 12)
HOUSE_THRESHOLDS_MS = (500, 1000, 2000)
TAXI_SLACKS_S = (500, 900, 1500, 2400, 3600)
TAXI_THRESHOLDS_S = (30, 60, 120)
LATE_LIMITS = (0.01, 0.1, 1.0)
DELTA_STEPS = (0.1, 1.0)


def house_sensitivity() -> dict[str, list[Strategy]]:
    return {
        "slack": [house_fixed(s) for s in HOUSE_SLACKS_S],
        "threshold": [house_mean_shift(t) for t in HOUSE_THRESHOLDS_MS],
        "adwin": [house_adwin(limit, step) for step in DELTA_STEPS for limit in LATE_LIMITS],
    }


def taxi_sensitivity() -> dict[str, list[Strategy]]:
    return {
        "slack": [taxi_fixed(3, s) for s in TAXI_SLACKS_S],
        "threshold": [taxi_mean_shift(3, t) for t in TAXI_THRESHOLDS_S],
        "adwin": [taxi_adwin(3, limit, step) for step in DELTA_STEPS for limit in LATE_LIMITS],
    }


# Strategy ids from parameter columns ------------------------------------------

def fixed_id(slack_s):
    return F.concat(F.lit("watermark_"), slack_s.cast("string"), F.lit("s"))


def mean_shift_id(threshold_ms):
    return F.concat(F.lit("adaptive_adwin_dt"), threshold_ms.cast("string"))


def adwin_id(late_limit, delta_step):
    """Both parameters appear as hundredths, truncated."""
    return F.format_string("adaptive_real_adwin_L%d_dd%d", (late_limit * 100).cast("int"), (delta_step * 100).cast("int"))


def taxi_fixed_id(mode, slack_s):
    return F.format_string("taxi_watermark_m%d_s%d", mode, slack_s)


def taxi_mean_shift_id(mode, threshold_s):
    return F.format_string("taxi_adaptive_adwin_m%d_dt%d", mode, threshold_s)


def taxi_adwin_id(mode, late_limit, delta_step):
    return F.format_string("taxi_real_adwin_m%d_L%d_dd%d", mode, (late_limit * 100).cast("int"),
                           (delta_step * 100).cast("int"))
