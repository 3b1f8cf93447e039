"""Metric queries over the smart-home results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbmark import params
from ebbmark.plans import backtest, metrics
from ebbmark.session import shared_folder
from ebbmark.sources import files, sinks
from oracles import base
from registry.core import approx, house, house_metrics, query, settings

SPEC = "speculative"
CTES = base.house_ctes() + [base.HOUSE_METRICS]
# Speculative finals and the mean of their counts.
FINALS = [f"finals AS (SELECT * FROM metrics WHERE strategy = '{SPEC}')",
          "reference AS (SELECT CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS baseline FROM finals)"]
MEANS = """means AS (SELECT strategy, CAST(sum(true_latency_ms) AS DOUBLE) / count(true_latency_ms) / 1000.0 AS true_latency_s,
    CAST(sum(decisional_latency_ms) AS DOUBLE) / count(decisional_latency_ms) / 1000.0 AS decisional_latency_s, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS avg_events,
    CAST(sum(update_count) AS DOUBLE) / count(update_count) AS overhead FROM metrics GROUP BY strategy)"""
LABELS = {"naive": "no slack", "watermark_5s": "fixed slack of 5 s", "adaptive_adwin_dt1000": "mean-shift slack",
          "adaptive_real_adwin_L10_dd10": "ADWIN slack"}
COMPLETENESS = (f"CASE WHEN baseline <= 0 THEN avg_events WHEN strategy = '{SPEC}' THEN 100.0 "
                "ELSE least(100.0, avg_events / baseline * 100) END AS completeness_pct")


def sql(final: str, extra: list[str] = ()) -> str:
    return base.statement(CTES + list(extra), final)


_LABEL = "CASE strategy " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE strategy END AS label"


@query("house_comparison", sql(f"SELECT means.*, {COMPLETENESS}, {_LABEL} FROM means, reference", FINALS + [MEANS]))
def comparison(spark, folder):
    return metrics.house_comparison(house_metrics(spark, folder), SPEC, LABELS)


@query("house_comparison_without_initial_rows", sql(f"SELECT means.*, {COMPLETENESS}, {_LABEL} FROM means, reference", FINALS + [MEANS]))
def comparison_without_initial(spark, folder):
    """The same report from a table that also holds the first guesses, which it must leave out."""
    rows = house_metrics(spark, folder)
    guesses = rows.where(F.col("strategy") == SPEC).withColumn("house_id", F.concat("house_id", F.lit("-initial"))) \
        .withColumn("pachete_count", F.lit(1).cast("long")).withColumn("is_final", F.lit(False))
    return metrics.house_comparison(rows.unionByName(guesses), SPEC, LABELS)


@query("house_metrics_scan", sql("""SELECT time_ms, house_id, strategy, pachete_count, avg_temp, avg_energy, update_count
    FROM metrics WHERE strategy IN ('naive', 'watermark_5s') AND time_ms > 1704070800000"""))
def metrics_scan(spark, folder):
    """Stored partitioned by strategy, then read back with a strategy and a time predicate."""
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(house_metrics(spark, folder), path)
    rows = files.read_metrics(spark, path, ["naive", "watermark_5s"], "2024-01-01 01:00:00")
    return rows.select(F.unix_millis("time").alias("time_ms"), "house_id", "strategy", "pachete_count", "avg_temp",
                       "avg_energy", "update_count")


@query("house_recent_means", sql("""SELECT strategy, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS avg_events, count(*) AS windows_fired FROM metrics
    WHERE time_ms > (SELECT max(time_ms) FROM metrics) - 1800000 GROUP BY strategy"""))
def recent_means(spark, folder):
    rows = house_metrics(spark, folder)
    now = rows.agg(F.max("time")).scalar()
    return metrics.since(rows, now, "30 minutes").groupBy("strategy").agg(
        F.avg("pachete_count").alias("avg_events"), F.count(F.lit(1)).alias("windows_fired"))


@query("house_final_versions", sql("SELECT time_ms, house_id, pachete_count, update_count, is_final FROM finals", FINALS))
def final_versions(spark, folder):
    return metrics.house_finals(house_metrics(spark, folder), SPEC).select(
        F.unix_millis("time").alias("time_ms"), "house_id", "pachete_count", "update_count", "is_final")


@query("house_speculative_baseline", sql("SELECT baseline FROM reference", FINALS))
def speculative_baseline(spark, folder):
    return metrics.baseline(metrics.house_finals(house_metrics(spark, folder), SPEC), "pachete_count")


@query("house_tradeoff", sql(f"SELECT strategy, true_latency_s, {COMPLETENESS} FROM means, reference", FINALS + [MEANS]))
def tradeoff(spark, folder):
    return metrics.tradeoff(metrics.house_comparison(house_metrics(spark, folder), SPEC))


def _series(bucket_ms: int) -> list[str]:
    return [f"""series AS (SELECT strategy, bucket_ms, avg(v) AS avg_events FROM (
        SELECT strategy, time_ms // {bucket_ms} * {bucket_ms} AS bucket_ms, house_id, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS v FROM metrics
        GROUP BY 1, 2, 3) GROUP BY strategy, bucket_ms)"""]


def _series_queries(suffix: str, bucket: str, bucket_ms: int) -> None:
    @query(f"house_series_{suffix}", sql("SELECT strategy, bucket_ms, round(avg_events, 6) AS avg_events FROM series",
                                         _series(bucket_ms)))
    def series(spark, folder):
        rows = metrics.house_series(house_metrics(spark, folder), bucket)
        return rows.select("strategy", "bucket_ms", approx("avg_events"))

    @query(f"house_series_completeness_{suffix}", sql(f"""SELECT s.strategy, s.bucket_ms,
        round(least(100.0, s.avg_events / r.avg_events * 100), 6) AS completeness_pct
        FROM series s JOIN series r ON s.bucket_ms = r.bucket_ms AND r.strategy = '{SPEC}' WHERE s.strategy <> '{SPEC}'""",
                                                      _series(bucket_ms)))
    def completeness(spark, folder):
        rows = metrics.series_completeness(metrics.house_series(house_metrics(spark, folder), bucket), SPEC)
        return rows.select("strategy", "bucket_ms", approx("completeness_pct"))


_series_queries("1m", "1 minute", 60_000)
_series_queries("10m", "10 minutes", 600_000)


@query("house_events_per_key", sql("SELECT strategy, house_id, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS avg_events FROM metrics GROUP BY 1, 2"))
def events_per_key(spark, folder):
    return metrics.house_events(house_metrics(spark, folder))


GRID = [f"spec AS (SELECT house_id, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS ref FROM finals GROUP BY house_id)",
        f"""names AS (SELECT DISTINCT strategy FROM metrics WHERE strategy <> '{SPEC}')""",
        "own AS (SELECT strategy, house_id, CAST(sum(pachete_count) AS DOUBLE) / count(pachete_count) AS v FROM metrics GROUP BY 1, 2)",
        """grid AS (SELECT n.strategy, s.house_id,
            CAST(9 - CAST(replace(s.house_id, 'HOUSE_', '') AS INTEGER) // 10 AS INTEGER) AS grid_row,
            CAST(replace(s.house_id, 'HOUSE_', '') AS INTEGER) % 10 AS grid_col,
            CASE WHEN ref > 0 THEN least(100.0, coalesce(v, 0) / ref * 100) ELSE 0 END AS completeness_pct
            FROM spec s CROSS JOIN names n LEFT JOIN own o ON o.strategy = n.strategy AND o.house_id = s.house_id)"""]


@query("house_grid", sql("SELECT * FROM grid", FINALS + GRID))
def grid(spark, folder):
    return metrics.house_grid(house_metrics(spark, folder), SPEC)


@query("house_grid_matrix", sql("SELECT strategy, grid_row, " + ", ".join(
    f'max(completeness_pct) FILTER (WHERE grid_col = {i}) AS "{i}"' for i in range(10)) + " FROM grid GROUP BY 1, 2",
    FINALS + GRID))
def grid_matrix(spark, folder):
    return metrics.as_matrix(metrics.house_grid(house_metrics(spark, folder), SPEC))


@query("house_errors", sql(f"""SELECT q.strategy, round(q.t, 6) AS mean_temp, round(q.e, 6) AS mean_energy,
    round(CASE WHEN q.strategy = '{SPEC}' THEN 0.0 ELSE (q.t - r.t) / r.t * 100 END, 6) AS temp_error_pct,
    round(CASE WHEN q.strategy = '{SPEC}' THEN 0.0 ELSE (q.e - r.e) / r.e * 100 END, 6) AS energy_error_pct
    FROM q, (SELECT * FROM q WHERE strategy = '{SPEC}') r""",
    ["q AS (SELECT strategy, avg(avg_temp) AS t, avg(avg_energy) AS e FROM metrics GROUP BY strategy)"]))
def errors(spark, folder):
    rows = metrics.house_errors(house_metrics(spark, folder), SPEC)
    return rows.select("strategy", *[approx(c) for c in rows.columns if c != "strategy"])


# The whole parameter study: 14 variants, three families.
ADAPTIVE = params.house_sensitivity()["adwin"]
STUDY = ([base.fixed(f"watermark_{s}s", s * 1000) for s in params.HOUSE_SLACKS_S]
         + [base.mean_shift(f"adaptive_adwin_dt{t}", 5000, t, 500, None, 12000) for t in params.HOUSE_THRESHOLDS_MS]
         + [base.combined(s, 5) for s in ADAPTIVE])


def _sensitivity(name: str, regime: str) -> None:
    final = """SELECT strategy, true_latency_s, decisional_latency_s, least(100.0, avg_events / 10.0 * 100) AS completeness_pct,
        overhead FROM means"""

    @query(name, base.statement(base.house_ctes(STUDY, regime, adaptive=ADAPTIVE) + [base.HOUSE_METRICS, MEANS], final))
    def build(spark, folder):
        results = backtest.sweep(house(spark, folder, regime), params.house_sensitivity(), settings())
        return metrics.house_sensitivity(metrics.to_house_metrics(results))


_sensitivity("house_sensitivity_stationary", "stationary")
_sensitivity("house_sensitivity_short_cycle", "short_cycle")
_sensitivity("house_sensitivity_long_cycle", "long_cycle")


@query("house_sensitivity_all_variants", base.statement(
    base.house_ctes(STUDY, "short_cycle", adaptive=ADAPTIVE) + [base.HOUSE_METRICS, MEANS],
    """SELECT strategy, round_even(true_latency_s, 3) AS true_latency_s, round_even(decisional_latency_s, 3) AS decisional_latency_s,
    round_even(least(100.0, avg_events / 10.0 * 100), 1) AS completeness_pct, round_even(overhead, 2) AS overhead FROM means"""))
def all_variants(spark, folder):
    """The exported table of the study."""
    results = backtest.sweep(house(spark, folder, "short_cycle"), params.house_sensitivity(), settings())
    report = metrics.house_sensitivity(metrics.to_house_metrics(results))
    return metrics.rounded_report(report, {"true_latency_s": 3, "decisional_latency_s": 3, "completeness_pct": 1,
                                           "overhead": 2})


@query("exported_report", sql("SELECT strategy, CAST(count(*) AS BIGINT) AS windows FROM metrics GROUP BY strategy"))
def exported_report(spark, folder):
    """A result table written as CSV with a header and read back."""
    report = house_metrics(spark, folder).groupBy("strategy").agg(F.count(F.lit(1)).alias("windows"))
    path = shared_folder(spark, "report")
    sinks.export_report(report, path)
    return spark.read.csv(path, header=True, schema="strategy string, windows long")


@query("house_upsert_writers", sql("""SELECT time_ms, house_id, strategy, pachete_count, update_count
    FROM metrics WHERE strategy IN ('naive', 'watermark_5s')"""))
def upsert_writers(spark, folder):
    """Two strategies write one table at the same time, with the same batch numbers; one of them starts anew, and the
    table is compacted in between. No row is lost, and the restarted writer's rows replace its older ones."""
    rows = house_metrics(spark, folder)
    naive, fixed = (rows.where(F.col("strategy") == s) for s in ("naive", "watermark_5s"))
    first, second = shared_folder(spark, "upsert-writers"), shared_folder(spark, "upsert-compacted")
    stale = fixed.withColumn("pachete_count", F.lit(0).cast("long"))
    sinks.upsert_house_metrics(first, "naive")(naive, 0)
    sinks.upsert_house_metrics(first, "fixed")(stale, 0)
    sinks.compacted_house_metrics(spark, first, second)
    sinks.upsert_house_metrics(second, "fixed", run=1)(fixed, 0)
    return sinks.latest_house_metrics(spark, second).select(
        F.unix_millis("time").alias("time_ms"), "house_id", "strategy", "pachete_count", "update_count")


@query("house_upsert_view", sql("""SELECT time_ms, house_id, strategy, pachete_count, update_count
    FROM metrics WHERE strategy IN ('naive', 'speculative')"""))
def upsert_view(spark, folder):
    """Two versions of the upsert table, the first one twice as a retried batch; the view keeps the last."""
    rows = house_metrics(spark, folder).where(F.col("strategy").isin("naive", "speculative"))
    path = shared_folder(spark, "upsert")
    write = sinks.upsert_house_metrics(path)
    stale = rows.where(F.col("pachete_count") > 1).withColumn("pachete_count", F.lit(1).cast("long")) \
        .withColumn("update_count", F.lit(1).cast("long"))
    write(stale, 0)
    write(stale, 0)
    write(rows, 1)
    return sinks.latest_house_metrics(spark, path).select(
        F.unix_millis("time").alias("time_ms"), "house_id", "strategy", "pachete_count", "update_count")
