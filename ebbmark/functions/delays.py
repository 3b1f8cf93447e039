"""Arrival times derived from event times under a network regime.

Delays come from an integer hash of the event id, so the same event always gets the same delay on
any partitioning, and any SQL engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MODULUS = 2_147_483_647
MULTIPLIERS = (48_271, 69_621, 16_807)


def scramble(identity: Column, salt: int) -> Column:
    """Integer in [0, 2^31 - 1), a fixed function of the id and the salt."""
    modulus = F.lit(MODULUS).cast("long")
    x = F.pmod(identity.cast("long"), modulus) + F.lit(salt * 7_919 + 1).cast("long")
    for multiplier in MULTIPLIERS:
        x = (x * F.lit(multiplier).cast("long") + F.lit(salt).cast("long")) % modulus
    return x


def draw(identity: Column, salt: int, choices: int) -> Column:
    """Integer in [0, choices)."""
    return scramble(identity, salt) % F.lit(choices).cast("long")


def _minute(event_time: Column, start_ms: int, period: int) -> Column:
    elapsed = F.floor((event_time - F.lit(start_ms).cast("long")) / 60_000).cast("long")
    return F.pmod(elapsed, F.lit(period).cast("long"))


def delay_ms(chance: Column, event_time: Column, regime: str, start_ms: int = 0) -> Column:
    """Network delay for an event with scrambled id ``chance``.

    Regimes: ``stationary``, ``short_cycle`` (6 min), ``long_cycle`` (45 min). The low digits of the
    scrambled id pick the branch and the high ones the delay inside it, so one hash serves both.
    """
    coin = chance % 10_000
    amount = F.call_function("div", chance, F.lit(10_000).cast("long"))

    def between(low: int, choices: int) -> Column:
        return amount % F.lit(choices).cast("long") + F.lit(low).cast("long")

    if regime == "stationary":
        return (F.when(coin < 1500, between(5, 7) * 1000)
                .when(coin < 3000, between(0, 2000))
                .otherwise(between(50, 200)))
    good = between(50, 150)
    jitter = between(100, 300)
    if regime == "short_cycle":
        minute = _minute(event_time, start_ms, 6)
        return (F.when(minute < 2, good)
                .when((minute < 4) & (coin < 5000), between(5000, 5000))
                .when(minute < 4, jitter)
                .otherwise(between(500, 1500)))
    if regime == "long_cycle":
        minute = _minute(event_time, start_ms, 45)
        return (F.when(minute < 15, good)
                .when((minute < 30) & (coin < 7500), between(8000, 10_000))
                .when(minute < 30, jitter)
                .otherwise(between(1000, 4000)))
    raise ValueError(f"unknown regime: {regime}")


def with_arrival(events: DataFrame, regime: str, start_ms: int = 0, seed: int = 0,
                 identity: str = "event_id") -> DataFrame:
    """Add ``arrival_time`` = event time + regime delay."""
    delay = delay_ms(F.col("_chance"), F.col("event_time"), regime, start_ms)
    return (events.withColumn("_chance", scramble(F.col(identity), seed + 1))
            .withColumn("arrival_time", F.col("event_time") + delay).drop("_chance"))


def phase_name(event_time: Column, long_cycle: bool, start_ms: int = 0) -> Column:
    """Name of the network phase an event was sent in."""
    # Phase names: fixed values.
    names = ("EXCELENT(L)", "CONGESTIE(L)", "RECUPERARE(L)") if long_cycle else \
        ("EXCELENT", "CONGESTIE", "RECUPERARE")
    period = 45 if long_cycle else 6
    minute = _minute(event_time, start_ms, period)
    third = period // 3
    return (F.when(minute < third, names[0]).when(minute < 2 * third, names[1]).otherwise(names[2]))
