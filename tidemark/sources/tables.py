"""Sources: series from tables, CSV streams, long label files, price files and JSON windows; the partitioned run store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_seq(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(series_id, seq from 0, ts, value) with any other columns left out; ``order`` must be unique in a series."""
    w = Window.partitionBy("series_id").orderBy(*order)
    return df.withColumn("series_id", F.col(series)).withColumn("seq", (F.row_number().over(w) - 1).cast("long")).select("series_id", "seq", "ts", F.col(value).cast("double").alias("value"))


def with_long_seq(df: DataFrame, series: str, order: list[str], value: str, time: str = "ts") -> DataFrame:
    """As :func:`with_seq` where ``order`` begins with ``time``, for series that are too long for one task: rows are numbered within a day, after the count of the days before."""
    day = F.coalesce(F.unix_date(F.col(time).cast("date")), F.lit(-(1 << 30)))
    rows = df.withColumns({"series_id": F.col(series), "day": day})
    along = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("series_id", "day").agg(F.count(F.lit(1)).alias("n")).select("series_id", "day", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    seq = F.col("before") + F.row_number().over(Window.partitionBy("series_id", "day").orderBy(*order)) - 1
    return rows.join(before, ["series_id", "day"]).withColumn("seq", seq.cast("long")).select("series_id", "seq", F.col(time).alias("ts"), F.col(value).cast("double").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types as series."""
    return with_long_seq(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value")


def parsed_time(text: str = "timestamp"):
    """Text up to the first point as ``yyyy-MM-dd HH:mm:ss``; anything else is null."""
    return F.try_to_timestamp(F.split_part(F.col(text), F.lit("."), F.lit(1)), F.lit("yyyy-MM-dd HH:mm:ss"))


def read_stream_csv(spark: SparkSession, path: str) -> DataFrame:
    """(series_id = file, seq, ts_raw, ts, value) of CSV files with a header and columns timestamp, value; rows whose value does not parse are left out. Order is that of the file: by the place of the block that Spark read, then by row."""
    raw = spark.read.csv(path, header=True, schema="timestamp string, value string", enforceSchema=False).select("*", F.col("_metadata.file_path").alias("series_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    good = raw.withColumn("value", F.expr("try_cast(value AS double)")).where("timestamp IS NOT NULL AND value IS NOT NULL")
    w = Window.partitionBy("series_id").orderBy("block", "at")
    return good.select("series_id", (F.row_number().over(w) - 1).alias("seq"), F.col("timestamp").alias("ts_raw"), parsed_time().alias("ts"), "value")


def replay_csv(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The CSV files of a folder as a stream of (series_id = file, timestamp, value), ``files`` of them in a micro-batch; rows that do not parse are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).csv(folder, header=True, schema="timestamp string, value string")
    return raw.select(F.col("_metadata.file_path").alias("series_id"), "timestamp", F.expr("try_cast(value AS double)").alias("value")).where("timestamp IS NOT NULL AND value IS NOT NULL")


def read_config(path: str) -> dict:
    """Settings of a JSON file on the driver: ``window_size``, ``calibration_steps``, ``scorer_weights`` and what else it holds."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def univariate(wide: DataFrame, label: str = "label") -> DataFrame:
    """(file, seq, ts, value, label) of ``pivot_channels``, ts being the place from 1 as text. A file with another number of data channels than one, or with values and labels of unlike number, ends in an error."""
    if label not in wide.columns:
        raise ValueError(f"no channel '{label}'")
    data = [c for c in wide.columns if c not in ("file", "seq", label)]
    here = F.array_compact(F.array(*[F.when(F.count(F.col(f"`{c}`")).over(Window.partitionBy("file")) > 0, F.lit(c)) for c in data]))
    rows = wide.withColumn("channels", here)
    one = F.when(F.size("channels") != 1, F.raise_error(F.concat(F.col("file"), F.lit(": one data channel expected, found "), F.array_join("channels", ", "))).cast("double"))
    value = F.coalesce(one, *[F.when(F.array_contains("channels", c), F.col(f"`{c}`")) for c in data])
    rows = rows.select("file", "seq", (F.col("seq") + 1).cast("string").alias("ts"), value.alias("value"), F.col(label).alias("raw"))
    uneven = F.when(F.col("raw").isNull() != F.col("value").isNull(), F.raise_error(F.concat(F.col("file"), F.lit(": values and labels differ in number"))).cast("int"))
    return rows.select("file", "seq", "ts", "value", F.coalesce(uneven, F.bround("raw").cast("int")).alias("label"))


def select_channels(meta: DataFrame, dataset: str | None = None, max_steps: int = 0, limit: int = 0) -> DataFrame:
    """Univariate files of ``read_channel_meta``, of one dataset (in any case) and of at most ``max_steps`` steps if given, by name; the first ``limit`` if given."""
    out = meta.where("if_univariate")
    if dataset:
        out = out.where(F.upper("dataset_name") == dataset.upper())
    if max_steps:
        out = out.where(F.col("time_steps") <= max_steps)
    out = out.orderBy("file_name")
    return out.limit(limit) if limit else out


def labelled(series: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of series that have a window."""
    return series.join(windows.select("series_id").distinct(), "series_id", "left_semi")


def pivot_channels(long: DataFrame) -> DataFrame:
    """(file, seq, channel columns) of long rows (file, date, data, cols): integer dates before texts, integers by value; each channel is ranked by its own dates."""
    n = F.expr("try_cast(trim(date) AS bigint)")
    w = Window.partitionBy("file", "cols").orderBy(n.isNull(), n, F.trim("date"))
    return long.withColumn("seq", F.row_number().over(w) - 1).groupBy("file", "seq").pivot("cols").agg(F.first("data"))


def read_prices_csv(spark: SparkSession, path: str, column: str = "Close") -> DataFrame:
    """(series_id = file, seq, ts_raw, value) of price files in file order; header names in any case, with blanks or a byte order mark; rows without a number are left out."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    date = next((names[n] for n in ("date", "datetime", "timestamp") if n in names), None)
    if date is None or column.lower() not in names:
        raise ValueError("no date or value column")
    value = F.expr(f"try_cast(`{names[column.lower()]}` AS double)")
    rows = raw.select(F.col("_metadata.file_path").alias("series_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col(f"`{date}`").alias("ts_raw"), value.alias("value")).where("ts_raw IS NOT NULL AND value IS NOT NULL")
    return rows.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("block", "at")) - 1).alias("seq"), "ts_raw", "value")


def read_windows_json(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, window_id, w_start, w_end) of a JSON object from file names to lists of [start, end]; keys that start with ``_`` are comments."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("series_id", "j"))
    pairs = text.where(~F.col("series_id").startswith("_")).select("series_id", F.posexplode(F.from_json("j", "array<array<string>>")).alias("window_id", "w"))
    at = lambda i: F.try_to_timestamp(F.split_part(F.col("w")[i], F.lit("."), F.lit(1)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return pairs.select("series_id", "window_id", at(0).alias("w_start"), at(1).alias("w_end"))


def read_channel_meta(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, dataset_name, if_univariate, train_lens, test_lens, time_steps, anomaly_rate) of a description file; what does not parse is null."""
    raw = spark.read.csv(path, header=True)
    whole = [F.expr(f"try_cast(try_cast(trim({c}) AS double) AS int)").alias(c) for c in ("train_lens", "test_lens", "time_steps")]
    return raw.select("file_name", "dataset_name", (F.upper(F.trim("if_univariate")) == "TRUE").alias("if_univariate"), *whole, F.expr("try_cast(trim(anomaly_rate) AS double)").alias("anomaly_rate"))


def synthetic_prices(spark: SparkSession, series: int, n: int, seed: int = 0, drift: float = 0.0002, vol: float = 0.01, start: float = 100.0) -> DataFrame:
    """(series_id, seq, value): geometric walks whose volatility changes every 120 to 399 steps, with about one jump in 500. Hashes give the numbers, so reruns agree however rows are placed."""
    u = lambda tag, *cols: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    numbered = lambda count, name: spark.range(series * count).select((F.col("id") / count).cast("long").cast("string").alias("series_id"), (F.col("id") % count).alias(name))
    at = ("series_id", "seq")
    normal = F.sqrt(-2 * F.log(u("a", *at))) * F.cos(2 * F.pi() * u("b", *at))
    size = 120 + (u("g", "series_id", "k") * 280).cast("int")
    times = F.element_at(F.array(*map(F.lit, (0.5, 1.0, 1.0, 2.0, 3.0))), (u("c", "series_id", "k") * 5).cast("int") + 1)
    upto = Window.partitionBy("series_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    regimes = numbered(n // 120 + 1, "k").withColumns({"size": size, "times": times}).withColumn("to", F.sum("size").over(upto)).select("series_id", (F.col("to") - F.col("size")).alias("from"), "to", "times")
    rows = numbered(n, "seq").join(regimes, "series_id").where("seq >= from AND seq < to")
    jump = F.when(u("d", *at) < 1 / 500, F.signum(u("e", *at) - 0.5) * vol * (8 + 8 * u("f", *at))).otherwise(0.0)
    w = Window.partitionBy("series_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("r", (normal + drift) * vol * F.col("times") + jump).select("series_id", "seq", (start * F.exp(F.sum("r").over(w))).alias("value"))


def open_store(spark: SparkSession, root: str) -> RunStore:
    """The run store of a folder. Files of embedded databases are not read: there is no driver for them on the class path."""
    if root.lower().endswith((".db", ".sqlite", ".sqlite3")):
        raise ValueError("a run store is a folder of Parquet tables")
    return RunStore(spark, root)


class RunStore:
    """Runs, stream values and signal scores as Parquet partitioned by run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read("runs", "run_id long, source string, started_at timestamp").orderBy("run_id")

    def begin_run(self, source: str) -> int:
        run = (self.runs().agg(F.max("run_id")).first()[0] or 0) + 1
        self.spark.range(1).select(F.lit(run).cast("long").alias("run_id"), F.lit(source).alias("source"), F.current_timestamp().alias("started_at")).write.mode("append").parquet(f"{self.root}/runs")
        return run

    def write(self, run: int, scored: DataFrame, signals: list[str], channel: str = "value") -> None:
        """``scored``: seq, ts, value and a column for each signal; signals are stored long, nulls kept."""
        tag = {"run_id": F.lit(run).cast("long"), "channel": F.lit(channel)}
        scored.select("seq", "ts", "value").withColumns(tag).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/stream")
        scored.unpivot(["seq", "ts"], signals, "signal_name", "value").withColumns(tag).write.mode("append").partitionBy("run_id").parquet(f"{self.root}/signals")

    def stream(self, run: int, channel: str = "value") -> DataFrame:
        return self._read("stream", "seq long, ts timestamp_ntz, value double, channel string, run_id long").where((F.col("run_id") == run) & (F.col("channel") == channel)).orderBy("seq")

    def signal(self, run: int, name: str, channel: str = "value") -> DataFrame:
        df = self._read("signals", "seq long, ts timestamp_ntz, signal_name string, value double, channel string, run_id long")
        return df.where((F.col("run_id") == run) & (F.col("channel") == channel) & (F.col("signal_name") == name)).orderBy("seq")

    def signal_names(self, run: int, channel: str = "value") -> DataFrame:
        df = self._read("signals", "signal_name string, channel string, run_id long")
        return df.where((F.col("run_id") == run) & (F.col("channel") == channel)).select("signal_name").distinct().orderBy("signal_name")

    def signal_rows(self, run: int) -> int:
        return self._read("signals", "run_id long").where(F.col("run_id") == run).count()

    def channels(self, run: int) -> DataFrame:
        return self._read("stream", "channel string, run_id long").where(F.col("run_id") == run).select("channel").distinct().orderBy("channel")

    def summary(self, run: int) -> DataFrame:
        if self.runs().where(F.col("run_id") == run).isEmpty():
            raise KeyError(run)
        df = self._read("stream", "seq long, ts timestamp_ntz, value double, channel string, run_id long").where(F.col("run_id") == run)
        points = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("stream_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sort_array(F.collect_set("channel")).alias("channels"))
        names = self._read("signals", "signal_name string, run_id long").where(F.col("run_id") == run).groupBy("run_id").agg(F.sort_array(F.collect_set("signal_name")).alias("signals"))
        return points.join(names, "run_id", "left")
