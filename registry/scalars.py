"""Sources, projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ebbmark import params
from ebbmark.functions import delays, scalars
from ebbmark.session import shared_folder
from ebbmark.sources import files, sinks, streams, tables
from oracles import base
from registry.core import house, query, taxi

START = tables.REPLAY_START_MS


# Arrival regimes and phases ---------------------------------------------------

def _arrivals(regime: str) -> None:
    sql = base.statement([base.house_events(regime)], "SELECT event_id, event_time, arrival_time FROM ev")
    query(f"arrival_{regime}", sql)(
        lambda spark, folder: house(spark, folder, regime).select("event_id", "event_time", "arrival_time"))


for _regime in ("stationary", "short_cycle", "long_cycle"):
    _arrivals(_regime)


def _phases(name: str, long_cycle: bool, labels: tuple[str, str, str], period: int) -> None:
    minute = base.minute(period)
    case = (f"CASE WHEN {minute} < {period // 3} THEN '{labels[0]}' WHEN {minute} < {2 * period // 3} "
            f"THEN '{labels[1]}' ELSE '{labels[2]}' END")

    @query(name, base.statement([base.house_events()], f"SELECT {case} AS phase, count(*) AS events FROM ev GROUP BY 1"))
    def build(spark, folder):
        rows = house(spark, folder)
        return (rows.groupBy(delays.phase_name(F.col("event_time"), long_cycle, START).alias("phase"))
                .agg(F.count(F.lit(1)).alias("events")))


_phases("phase_names_short", False, ("EXCELENT", "CONGESTIE", "RECUPERARE"), 6)
_phases("phase_names_long", True, ("EXCELENT(L)", "CONGESTIE(L)", "RECUPERARE(L)"), 45)


# Projections -------------------------------------------------------------------

@query("taxi_projection", base.statement([base.taxi_events()], """SELECT event_id, key AS zone_id,
    reading_1 AS distance, reading_2 AS duration_min, reading_3 AS passengers, event_time FROM ev"""))
def taxi_projection(spark, folder):
    return taxi(spark, folder).select(
        "event_id", F.col("key").alias("zone_id"), F.col("reading_1").alias("distance"),
        F.col("reading_2").alias("duration_min"), F.col("reading_3").alias("passengers"), "event_time")


_LAT = "CAST('40.4774' AS DOUBLE) + (l_partkey % 500) * CAST('0.00088' AS DOUBLE)"
_LON = "CAST('-74.2591' AS DOUBLE) + (l_orderkey % 600) * CAST('0.00093' AS DOUBLE)"


@query("geo_grid", f"""SELECT cell, count(*) AS points FROM (
    SELECT {base.cell('lat', 'lon')} AS cell FROM (SELECT {_LAT} AS lat, {_LON} AS lon FROM lineitem)) GROUP BY cell""")
def geo_grid(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    lat = F.lit(scalars.LAT_MIN) + (F.col("l_partkey") % 500) * F.lit(0.00088)
    lon = F.lit(scalars.LON_MIN) + (F.col("l_orderkey") % 600) * F.lit(0.00093)
    return rows.groupBy(scalars.geo_cell(lat, lon).alias("cell")).agg(F.count(F.lit(1)).alias("points"))


def _jitter(salt: int) -> str:
    return f"{base.draw('event_id * 100 + house', salt, 1_000_000)} / 1000000.0"


@query("house_fan_out", f"""SELECT 'HOUSE_' || house AS key, count(*) AS events,
    round(avg(value + {_jitter(51)} - 0.5), 6) AS mean_temperature,
    round(avg(1.0 + {_jitter(52)} * 0.05), 6) AS mean_energy, round(avg(50.0 + {_jitter(53)} * 0.02), 6) AS mean_humidity
    FROM events, (SELECT unnest(range(0, 100)) AS house) GROUP BY house""")
def house_fan_out(spark, folder):
    rows = tables.events_table(spark, folder).select(
        "event_id", F.col("value").alias("temperature"), F.lit(1.0).alias("energy"), F.lit(50.0).alias("humidity"))
    return files.fan_out(rows, "event_id").groupBy("key").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.avg("reading_1"), 6).alias("mean_temperature"),
        F.round(F.avg("reading_2"), 6).alias("mean_energy"),
        F.round(F.avg("reading_3"), 6).alias("mean_humidity"))


# Null handling, units, identifiers ----------------------------------------------

@query("null_safe_mean", """SELECT l_returnflag AS key, count(*) AS events,
    sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END) / count(*) AS mean_reading
    FROM lineitem GROUP BY l_returnflag""")
def null_safe_mean(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_returnflag", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("reading"))
    return rows.groupBy(F.col("l_returnflag").alias("key")).agg(
        F.count(F.lit(1)).alias("events"), scalars.null_safe_mean("reading").alias("mean_reading"))


@query("null_defaults", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END, 0) AS price,
    CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE o_custkey % 4 END AS updates,
    CASE WHEN o_custkey % 4 > 0 THEN o_orderkey / CAST(o_custkey % 4 AS DOUBLE) ELSE 0 END AS per_update,
    (o_orderkey * 37) / 1000.0 AS seconds FROM orders""")
def null_defaults(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    counter = F.when(F.col("o_custkey") % 8 != 0, F.col("o_custkey") % 4)
    return rows.select(
        "o_orderkey", F.coalesce(price, F.lit(0.0)).alias("price"),
        scalars.one_if_missing(counter).alias("updates"),
        scalars.safe_divide(F.col("o_orderkey").cast("double"), F.col("o_custkey") % 4).alias("per_update"),
        (F.col("o_orderkey") * 37 / 1000.0).alias("seconds"))


@query("key_grid_cells", """SELECT user_id, CAST((user_id % 150) // 10 AS INTEGER) AS house_row, CAST(user_id % 10 AS INTEGER) AS house_col,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 11 AS INTEGER) END AS x,
    CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 7 AS INTEGER) END AS y,
    count(*) AS events FROM events GROUP BY user_id""")
def key_grid_cells(spark, folder):
    user = F.col("user_id")
    rows = tables.events_table(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    zone = F.when(user % 3 == 0, F.lit("CELL_OUT")).otherwise(
        F.concat_ws("_", F.lit("CELL"), (user % 11).cast("string"), (user % 7).cast("string")))
    row, column = scalars.house_cell(F.concat(F.lit("HOUSE_"), (user % 150).cast("string")))
    x, y = scalars.zone_cell(zone)
    return rows.select("user_id", row.alias("house_row"), column.alias("house_col"), x.alias("x"), y.alias("y"), "events")


@query("strategy_ids", """SELECT discount, tax, 'adaptive_real_adwin_L' || CAST(trunc(discount * 100) AS BIGINT) || '_dd'
    || CAST(trunc(tax * 100) AS BIGINT) AS strategy, 'watermark_' || CAST(quantity AS BIGINT) || 's' AS fixed, quantity, lines
    FROM (SELECT l_discount AS discount, l_tax AS tax, l_quantity AS quantity, count(*) AS lines FROM lineitem GROUP BY 1, 2, 3)""")
def strategy_ids(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    return rows.agg(F.count(F.lit(1)).alias("lines")).select(
        "discount", "tax", "quantity", "lines",
        params.adwin_id(F.col("discount"), F.col("tax")).alias("strategy"),
        params.fixed_id(F.col("quantity").cast("long")).alias("fixed"))


@query("strategy_labels", """SELECT event_type, CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views'
    ELSE event_type END AS label, count(*) AS events FROM events GROUP BY event_type""")
def strategy_labels(spark, folder):
    rows = tables.events_table(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
    return rows.select("event_type", "events",
                       scalars.label_of(F.col("event_type"), {"click": "Clicks", "view": "Views"}).alias("label"))


# Sources and sinks -----------------------------------------------------------------

@query("json_decode", base.statement([base.house_events()], """SELECT key AS house_id, reading_1 AS temperature,
    reading_2 AS energy_usage, reading_3 AS humidity, event_time, arrival_time FROM ev WHERE event_id % 13 <> 0"""))
def json_decode(spark, folder):
    """Encode events with an unknown field, spoil some records, decode and keep the good ones."""
    events = house(spark, folder)
    wire = streams.as_wire(events).columns
    names = {"house_id": "key", "temperature": "reading_1", "energy_usage": "reading_2", "humidity": "reading_3"}
    text = F.to_json(F.struct(*[F.col(names.get(c, c)).alias(c) for c in wire], F.lit("x").alias("unknown_field")))
    raw = events.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("value"))
    good, _ = streams.quarantine(streams.decode(raw, strict=False))
    return good.select(*wire)


@query("json_quarantine", "SELECT count(*) AS malformed FROM events WHERE event_id % 13 = 0")
def json_quarantine(spark, folder):
    events = house(spark, folder)
    text = F.to_json(F.struct(F.col("key").alias("house_id"), "event_time", "arrival_time"))
    raw = events.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("value"))
    _, malformed = streams.quarantine(streams.decode(raw, strict=False))
    return malformed.agg(F.count(F.lit(1)).alias("malformed"))


@query("keyed_records", base.statement([base.house_events()], "SELECT key, count(*) AS records, CAST(sum(arrival_time) AS BIGINT) AS arrivals FROM ev GROUP BY key"))
def keyed_records(spark, folder):
    records = sinks.keyed_records(house(spark, folder))
    arrival = F.get_json_object("value", "$.arrival_time").cast("long")
    return records.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.sum(arrival).alias("arrivals"))


def _csv_row(cells: dict[int, object], width: int):
    return [F.lit("0").alias(f"c{i}") if i not in cells else cells[i].cast("string").alias(f"c{i}") for i in range(width)]


@query("house_csv_scan", """SELECT event_id % 101 AS energy, value AS temperature, CAST(user_id AS DOUBLE) AS humidity
    FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0""".replace("event_id % 101", "CAST(event_id % 101 AS DOUBLE)"))
def house_csv_scan(spark, folder):
    rows = tables.events_table(spark, folder)
    energy = F.when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise((F.col("event_id") % 101).cast("string"))
    humidity = F.when(F.col("event_id") % 19 != 0, F.col("user_id").cast("string"))
    path = shared_folder(spark, "house-csv")
    rows.select(*_csv_row({1: energy, 19: F.col("value"), 21: humidity}, 24)).write.csv(path, header=True)
    return files.read_house_csv(spark, path).select("energy", "temperature", "humidity")


_TRIP_SQL = """SELECT epoch_us(date_trunc('second', ts)) // 1000 AS event_time, value AS reading_1,
    CAST(event_id % 3600 AS DOUBLE) / 60.0 AS reading_2, CAST(event_id % 6 AS DOUBLE) AS reading_3,
    'CELL_' || CAST(event_id % 10 AS VARCHAR) || '_5' AS key FROM events WHERE event_id % 23 <> 0 AND event_id % 29 <> 0"""


def _trip_file(spark, folder) -> str:
    rows = tables.events_table(spark, folder)
    stamp = F.date_format(F.col("ts").cast("timestamp"), files.PICKUP_FORMAT)
    pickup = F.when(F.col("event_id") % 23 == 0, F.lit("yesterday")).otherwise(stamp)
    passengers = F.when(F.col("event_id") % 29 == 0, F.lit("two")).otherwise((F.col("event_id") % 6).cast("string"))
    lon = F.lit(scalars.LON_MIN) + (F.col("event_id") % 10 + 0.5) * 0.05587
    path = shared_folder(spark, "taxi-csv")
    cells = {5: pickup, 7: passengers, 8: F.col("event_id") % 3600, 9: F.col("value"), 10: lon, 11: F.lit(40.71)}
    rows.select(*_csv_row(cells, 14)).write.csv(path, header=True)
    return path


@query("taxi_csv_scan", _TRIP_SQL)
def taxi_csv_scan(spark, folder):
    trips = files.read_taxi_csv(spark, _trip_file(spark, folder))
    return files.taxi_events(trips).select("event_time", "reading_1", "reading_2", "reading_3", "key")


@query("sorted_trips", """SELECT count(*) AS trips, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_pickup,
    strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_pickup FROM orders""")
def sorted_trips(spark, folder):
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    source = shared_folder(spark, "trips")
    stamp = F.concat(F.lit(" "), F.date_format(F.col("o_orderdate").cast("timestamp"), files.PICKUP_FORMAT))
    rows.select(F.col("o_orderkey").alias("medallion"), stamp.alias("pickup_datetime"),
                F.col("o_totalprice").alias("trip_distance")).write.csv(source, header=True)
    return files.sort_trips(spark, source, shared_folder(spark, "trips-sorted"))


@query("sorted_trips_order", "SELECT count(*) AS trips, CAST(0 AS BIGINT) AS out_of_order FROM orders")
def sorted_trips_order(spark, folder):
    """Reads the sorted files back and counts rows that are earlier than the one before, within files and between them."""
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    source, target = shared_folder(spark, "trips"), shared_folder(spark, "trips-sorted")
    stamp = F.date_format(F.col("o_orderdate").cast("timestamp"), files.PICKUP_FORMAT)
    rows.select(F.col("o_orderkey").alias("medallion"), stamp.alias("pickup_datetime"),
                F.col("o_totalprice").alias("trip_distance")).write.csv(source, header=True)
    files.sort_trips(spark, source, target)
    back = spark.read.csv(target, header=True).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), "pickup_datetime")
    inside = back.withColumn("before", F.lag("pickup_datetime").over(Window.partitionBy("file").orderBy("row")))
    each = inside.groupBy("file").agg(
        F.count("*").alias("trips"), F.count_if(F.col("before") > F.col("pickup_datetime")).alias("wrong"),
        F.min("pickup_datetime").alias("first"), F.max("pickup_datetime").alias("last"))
    joined = each.withColumn("previous", F.lag("last").over(Window.orderBy("file")))  # one row per file
    return joined.agg(F.sum("trips").alias("trips"), (F.sum("wrong") + F.count_if(F.col("previous") > F.col("first"))).alias("out_of_order"))


@query("taxi_strategy_ids", """SELECT l_orderkey, l_linenumber, 'taxi_watermark_m' || (l_linenumber % 3 + 1) || '_s' || CAST(l_quantity AS BIGINT) AS fixed,
    'taxi_adaptive_adwin_m' || (l_linenumber % 3 + 1) || '_dt' || CAST(l_quantity AS BIGINT) AS mean_shift,
    'taxi_real_adwin_m' || (l_linenumber % 3 + 1) || '_L' || CAST(trunc(CAST(l_discount AS DOUBLE) * 100) AS BIGINT) || '_dd'
    || CAST(trunc(CAST(l_tax AS DOUBLE) * 100) AS BIGINT) AS adwin, 'adaptive_adwin_dt' || CAST(l_quantity AS BIGINT) AS house_mean_shift
    FROM lineitem""")
def taxi_strategy_ids(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    mode, size = F.col("l_linenumber") % 3 + 1, F.col("l_quantity").cast("long")
    limit, step = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    return rows.select(
        "l_orderkey", "l_linenumber", params.taxi_fixed_id(mode, size).alias("fixed"), params.taxi_mean_shift_id(mode, size).alias("mean_shift"),
        params.taxi_adwin_id(mode, limit, step).alias("adwin"), params.mean_shift_id(size).alias("house_mean_shift"))
