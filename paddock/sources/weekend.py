"""Race weekends from per-event CSV files, as the canonical tables of ``plans.features.TABLES``.

A file holds one table of one session; its name has the key, its columns have one of several names. Durations are texts
(``0 days 00:01:35.4``) or numbers: of a column of numbers whose median in a file is over a thousand, milliseconds, else
seconds. A missing value may be empty, ``nan``, ``NaT`` or ``None``. Files of a table may have different columns, also in
another order. A table without files is empty; a value that doesn't parse is null.

``read`` gives lazy tables; ``store`` writes them once as Parquet by year, as each of the feature queries reads several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import detect
from ..operators.lookback import first_available
from ..operators.stats import percentile
from .files import exists, read_events, read_files

FILE = ["year", "round", "session"]
KEY = [*FILE, "driver"]
# The names that a column may have, the surest first.
DRIVER = ["Abbreviation", "Driver", "code", "driverRef", "DriverRef", "DriverCode", "BroadcastName"]
LAP_DRIVER = ["Driver", "Abbreviation", "driver", "code", "driverRef", "DriverRef", "DriverCode", "DriverNumber"]
TEAM = ["TeamName", "Team", "Constructor", "ConstructorName", "ConstructorTeam"]
POSITION = ["Position", "position", "ResultPosition", "FinishPosition", "QualiPosition", "QPosition", "QualifyingPosition"]
LAP_TIME = ["LapTime", "LapTime_s", "LapTimeSec", "LapTimeSeconds", "lap_time", "LapTimeMs", "milliseconds"]
GAP = ["GapToAhead", "gap_to_ahead", "IntervalToCarAhead", "interval_to_ahead", "GapAhead", "gapAhead", "Interval", "interval", "GapToFront"]
PIT_IN, PIT_OUT = ["IsPitIn", "PitIn", "InPit", "IsPitLap", "is_pit", "Pit", "in_pit"], ["IsPitOut", "PitOut", "OutPit"]
NEUTRAL = ["IsSC", "is_sc", "SC", "IsVSC", "is_vsc", "VSC", "YellowPhase"]
COMPOUNDS = {"S": "SOFT", "M": "MEDIUM", "H": "HARD", "I": "INTERMEDIATE", "W": "WET"}
EVENT = {"event": ["EventName", "Event", "GrandPrix", "Name"], "official": ["OfficialEventName"], "circuit": ["CircuitShortName", "CircuitName", "Circuit"], "location": ["Location", "Country"], "format": ["EventFormat"]}
AIR = {"air": ["AirTemp", "AirTemp_C", "Temperature", "AirTemperature", "temp", "TempC"], "track": ["TrackTemp", "TrackTemp_C", "TrackTemperature"], "humidity": ["Humidity", "RH", "RelHumidity"], "wind": ["WindKph", "Wind_kph", "WindSpeed", "WindSpeedKph", "WindSpeedKMH"], "rain_prob": ["RainProb", "PrecipProb", "PrecipitationProb", "rain_probability"]}
UTC = ["Utc", "UTC", "Timestamp", "DateTime"]
TOP_SPEED = ["TopSpeed", "TopSpeedKph", "TopSpeedKMH", "TopSpeed_kph", "SpeedTrapKph", "SpeedTrapKMH"]
BEST_LAP = ["BestLapTime", "BestLapTime_s", *LAP_TIME]
BOUNDS = [("StartUtc", "EndUtc"), ("StartUTC", "EndUTC"), ("Start", "End"), ("DateStart", "DateEnd")]
CALENDARS = "{schedule_[0-9][0-9][0-9][0-9],races}.csv"
MISSING = ("", "nan", "nat", "none", "null", "<na>")


def present(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of these names that the table has, in the names' order. Files differ, so a row may have its value in any."""
    return [F.col(f"`{c}`") for c in dict.fromkeys(detect(df, [n]) for n in names) if c]


def words(df: DataFrame, names: list[str]) -> Column:
    """The first text among the columns; what stands for a missing value is null."""
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))
    return F.coalesce(*[clean(c) for c in present(df, names)], F.lit(None).cast("string"))


def number(df: DataFrame, names: list[str]) -> Column:
    plain = lambda c: F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    return F.coalesce(*[plain(c) for c in present(df, names)], F.lit(None).cast("double"))


def flag(df: DataFrame, names: list[str]) -> Column:
    """Whether any of the columns that the table has says yes; null if none says anything."""
    found = [text.boolean_text(c) for c in present(df, names)]
    return F.greatest(*found, F.lit(None).cast("boolean")) if found else F.lit(None).cast("boolean")


def moment(df: DataFrame, names: list[str]) -> Column:
    """A time of a calendar, as UTC."""
    value = F.regexp_replace(F.regexp_replace(words(df, names), "T", " "), r"(\+00:00|Z)$", "")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(form)) for form in ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])


def in_seconds(rows: DataFrame, columns: list[str], key: list[str] = FILE) -> DataFrame:
    """The columns (texts) as seconds. Whether plain numbers are milliseconds is decided for each file and column by their median."""
    plain = lambda c: text.plain_number(F.col(c))
    scale = rows.groupBy(*key).agg(*[F.when(percentile(plain(c), 0.5) > 1000, 1000.0).otherwise(1.0).alias(f"_of_{c}") for c in columns])
    out = rows.join(scale, key, "left")
    return out.withColumns({c: F.coalesce(text.clock_seconds(F.col(c)), plain(c) / F.col(f"_of_{c}")) for c in columns}).drop(*[f"_of_{c}" for c in columns])


def compound(value: Column) -> Column:
    upper = F.upper(value)
    return F.coalesce(*[F.when(upper == short, F.lit(long)) for short, long in COMPOUNDS.items()], upper)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of races and sessions; a round without a file of its qualifying's results takes ``qualifying`` or ``quali``."""
    def of(name: str, session: Column) -> DataFrame:
        raw = read_events(spark, folder, name)
        said = words(raw, ["Status", "status", "ResultStatus"])
        kept = F.when(flag(raw, ["Classified"]) == F.lit(False), "NC")
        rows = raw.select("year", "round", session.alias("session"), words(raw, DRIVER).alias("driver"), words(raw, TEAM).alias("team"), number(raw, POSITION).alias("position"), number(raw, ["GridPosition", "Grid", "GridPos", "grid"]).alias("grid"), number(raw, ["Points", "points", "PTS"]).alias("points"),
                          F.coalesce(said, kept).alias("status"), *[words(raw, [c]).alias(c.lower()) for c in ("Q1", "Q2", "Q3", "Time")])
        return rows.filter("driver is not null").dropDuplicates([*FILE, "driver"])

    main = of("results", F.col("session"))
    other = [of(n, F.lit("Q")) for n in ("qualifying", "quali")]
    return in_seconds(first_available([main, *other], FILE), ["q1", "q2", "q3", "time"])


def laps(spark: SparkSession, folder: str) -> DataFrame:
    """Laps of all sessions. A flagged stop without a time has the lap's own time; a session without stints has one for each change
    of compound and after each stop; without tyre ages, laps of a stint are counted."""
    raw = read_events(spark, folder, "laps")
    times = {"lap_s": LAP_TIME, "time_s": ["Time", "SessionTime", "Sector3SessionTime"], "start_s": ["LapStartTime"], "pit_in": ["PitInTime"], "pit_out": ["PitOutTime"], "s1": ["Sector1Time"], "s2": ["Sector2Time"], "s3": ["Sector3Time"]}
    rows = raw.select(*FILE, words(raw, LAP_DRIVER).alias("driver"), words(raw, TEAM).alias("team"), number(raw, ["LapNumber", "Lap", "lap", "lap_number"]).cast("int").alias("lap"), *[words(raw, names).alias(c) for c, names in times.items()],
                      number(raw, ["Stint"]).cast("int").alias("stint"), compound(words(raw, ["Compound"])).alias("compound"), number(raw, ["TyreLife"]).cast("int").alias("tyre_age"), F.regexp_replace(words(raw, ["TrackStatus"]), r"\.0$", "").alias("track_status"),
                      text.boolean_text(words(raw, ["IsAccurate"])).alias("is_accurate"), text.boolean_text(words(raw, ["Deleted"])).alias("deleted"), number(raw, ["Position", "position", "Pos", "pos", "PositionOrder"]).alias("position"), number(raw, GAP).alias("gap_s"),
                      flag(raw, PIT_IN).alias("_in"), flag(raw, PIT_OUT).alias("_out"), flag(raw, NEUTRAL).alias("_neutral"))
    rows = in_seconds(rows.filter("driver is not null"), list(times))
    at = F.coalesce("time_s", "start_s", F.lit(0.0))
    rows = rows.withColumns({"pit_in": F.coalesce("pit_in", F.when(F.col("_in"), at)), "pit_out": F.coalesce("pit_out", F.when(F.col("_out"), at)), "track_status": F.coalesce("track_status", F.when(F.col("_neutral"), "4"))})
    own = Window.partitionBy(*KEY).orderBy("lap", "time_s")
    numbered = rows.withColumn("lap", F.coalesce("lap", F.row_number().over(own)))
    own = Window.partitionBy(*KEY).orderBy("lap", "time_s")
    starts = (F.row_number().over(own) == 1) | ~F.col("compound").eqNullSafe(F.lag("compound").over(own)) | F.coalesce(F.lag("pit_in").over(own).isNotNull() | F.col("pit_out").isNotNull(), F.lit(False))
    counted = numbered.withColumn("_starts", starts.cast("int")).withColumn("stint", F.when(F.max("stint").over(Window.partitionBy(*KEY)).isNull(), F.sum("_starts").over(own)).otherwise(F.col("stint")).cast("int"))
    age = F.when(F.max("tyre_age").over(Window.partitionBy(*KEY)).isNull(), F.row_number().over(Window.partitionBy(*KEY, "stint").orderBy("lap", "time_s"))).otherwise(F.col("tyre_age"))
    return counted.withColumn("tyre_age", age.cast("int")).drop("_in", "_out", "_neutral", "_starts")


def pit_stops(spark: SparkSession, folder: str, laps: DataFrame) -> DataFrame:
    """Stops with their seconds; a round without a file of them has the times from each way in to the next way out."""
    raw = read_events(spark, folder, "pit_stops")
    filed = raw.select("year", "round", words(raw, LAP_DRIVER).alias("driver"), number(raw, ["lap", "Lap", "LapNumber"]).cast("int").alias("lap"), F.coalesce(number(raw, ["duration_ms", "milliseconds"]) / 1000, text.duration_seconds(words(raw, ["duration", "Duration", "PitTime"]))).alias("seconds"))
    race = laps.filter("session = 'R'")
    out = F.coalesce(F.lead("pit_out").over(Window.partitionBy("year", "round", "driver").orderBy("lap")), F.when(F.col("pit_out") > F.col("pit_in"), F.col("pit_out")))
    timed = race.withColumn("seconds", out - F.col("pit_in")).filter("seconds is not null").select("year", "round", "driver", "lap", "seconds")
    return first_available([filed.filter("driver is not null"), timed], ["year", "round"])


def meta(spark: SparkSession, folder: str) -> DataFrame:
    """One row a round: each column from the race's file, else that of another session, else the schedule."""
    raw = read_events(spark, folder, "meta")
    place = F.coalesce(*[F.when(F.col("session") == s, F.lit(n)) for n, s in enumerate(("R", "Q"))], F.lit(2))
    filed = raw.select("year", "round", F.struct(place.alias("n"), F.col("session").alias("s")).alias("_order"), *[words(raw, names).alias(c) for c, names in EVENT.items()])
    listed = _schedule_rows(spark, folder)
    if listed is not None:
        filed = filed.unionByName(listed.select("year", "round", F.struct(F.lit(3).alias("n"), F.lit("").alias("s")).alias("_order"), *[words(listed, names).alias(c) for c, names in EVENT.items()]))
    return filed.groupBy("year", "round").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in EVENT])


def _schedule_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of schedule_YEAR.csv and races.csv with year and round."""
    raw = read_files(spark, folder, CALENDARS)
    if raw is None:
        return None
    year = F.coalesce(number(raw, ["year", "Year", "season"]), F.nullif(F.regexp_extract("_path", r"schedule_(\d{4})\.csv", 1), F.lit("")).try_cast("double"))
    keys = {"_y": year.cast("int"), "_r": number(raw, ["round", "RoundNumber", "Round"]).cast("int")}
    rows = raw.withColumns(keys).drop(*[c for c in raw.columns if c.lower() in ("year", "round", "_path")])
    return rows.withColumnsRenamed({"_y": "year", "_r": "round"}).filter("year is not null and round is not null")


def races(spark: SparkSession, folder: str) -> DataFrame:
    """The rounds of the calendar files."""
    rows = _schedule_rows(spark, folder)
    return rows.select("year", "round").distinct() if rows is not None else spark.createDataFrame([], "year int, round int")


def schedule(spark: SparkSession, folder: str) -> DataFrame:
    """year, round, session, starts: the sessions that calendar files list."""
    rows = _schedule_rows(spark, folder)
    if rows is None:
        return spark.createDataFrame([], "year int, round int, session string, starts timestamp")
    each = [F.struct(text.session_code(words(rows, [f"Session{i}"])).alias("session"), F.coalesce(moment(rows, [f"Session{i}DateUtc"]), moment(rows, [f"Session{i}Date"])).alias("starts")) for i in range(1, 6)]
    out = rows.select("year", "round", F.explode(F.array(*each)).alias("s")).select("year", "round", "s.*")
    return out.filter("session is not null").groupBy("year", "round", "session").agg(F.max("starts").alias("starts"))


def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_events(spark, folder, "meta")
    session = F.coalesce(text.session_code(words(raw, ["Session", "Phase"])), F.col("session"))
    bound = lambda k: F.coalesce(*[moment(raw, [pair[k]]) for pair in BOUNDS])
    return raw.select("year", "round", session.alias("session"), bound(0).alias("t0"), bound(1).alias("t1")).filter("t0 is not null and t1 is not null")


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Measured weather by session, and forecasts as the session FC."""
    def of(name: str, session: Column) -> DataFrame:
        raw = read_events(spark, folder, name)
        time = words(raw, ["Time"])
        rain = F.coalesce(text.boolean_text(words(raw, ["Rainfall"])).cast("double"), number(raw, ["Rainfall"]))
        return raw.select("year", "round", session.alias("session"), text.duration_seconds(time).alias("t_s"), F.coalesce(moment(raw, UTC), moment(raw, ["Time"])).alias("utc"), *[number(raw, names).alias(c) for c, names in AIR.items()], rain.alias("rain"))

    return of("weather", F.col("session")).unionByName(of("weather_forecast", F.lit("FC")))


def messages(spark: SparkSession, folder: str, table: str, columns: dict[str, list[str]]) -> DataFrame:
    """Rows of a log: time since the session's start (t_s) and texts."""
    raw = read_events(spark, folder, table)
    clean = lambda c, names: F.regexp_replace(words(raw, names), r"\.0$", "") if c == "status" else words(raw, names)
    return raw.filter("session = 'R'").select("year", "round", text.duration_seconds(words(raw, ["Time", "SessionTime"])).alias("t_s"), *[clean(c, names).alias(c) for c, names in columns.items()])


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Samples; the driver stands in the file's name, where the file has no column of it."""
    raw = read_events(spark, folder, "telemetry")
    brake = F.coalesce(text.boolean_text(words(raw, ["Brake"])).cast("double"), number(raw, ["Brake"]))
    return raw.select(*FILE, F.coalesce(words(raw, LAP_DRIVER), F.col("file_driver")).alias("driver"), text.duration_seconds(words(raw, ["Time", "SessionTime"])).alias("t_s"), number(raw, ["Speed"]).alias("speed"), number(raw, ["Throttle"]).alias("throttle"), brake.alias("brake"), number(raw, ["DRS"]).alias("drs"), number(raw, ["nGear"]).alias("gear"), number(raw, ["RPM"]).alias("rpm")).filter("driver is not null")


def telemetry_best(spark: SparkSession, folder: str) -> DataFrame:
    """Best lap and top speed of a race's drivers, from the files that sum telemetry up."""
    raw = read_events(spark, folder, "telemetry_agg")
    rows = raw.select(*FILE, words(raw, LAP_DRIVER).alias("driver"), words(raw, BEST_LAP).alias("best"), number(raw, TOP_SPEED).alias("top")).filter("session = 'R' and driver is not null")
    return in_seconds(rows, ["best"]).groupBy("year", "round", "driver").agg(F.min("best").alias("best"), F.max("top").alias("top"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_events(spark, folder, "entrylist")
    return raw.select(*FILE, words(raw, DRIVER).alias("driver"), words(raw, TEAM).alias("team")).filter("driver is not null").distinct()


def track_profiles(spark: SparkSession, folder: str) -> DataFrame | None:
    """slug and the profile columns of track_profiles.csv; None without the file."""
    raw = read_files(spark, folder, "track_profiles.csv")
    if raw is None:
        return None
    named = [c for c in raw.columns if c.lower() not in ("slug", "track", "track_slug", "_path", "cluster")]
    return raw.select(text.slug_ascii(words(raw, ["slug", "track", "track_slug"])).alias("slug"), *[number(raw, [c]).alias(c.lower()) for c in named]).filter("slug is not null").dropDuplicates(["slug"])


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The canonical tables of a folder: results, laps and stops, and of the others those that have files."""
    has = lambda *names: any(exists(spark, f"{folder.rstrip('/')}/{n}_[0-9]*.csv") for n in names)
    planned = exists(spark, f"{folder.rstrip('/')}/{CALENDARS}")
    driven = laps(spark, folder)
    out = {"results": results(spark, folder), "laps": driven, "pit_stops": pit_stops(spark, folder, driven)}
    if planned or has("meta"):
        out |= {"meta": meta(spark, folder)} | ({"session_windows": session_windows(spark, folder)} if has("meta") else {}) | ({"schedule": schedule(spark, folder)} if planned else {})
    if has("weather", "weather_forecast"):
        out["weather"] = weather(spark, folder)
    if has("race_ctrl"):
        out["race_ctrl"] = messages(spark, folder, "race_ctrl", {"category": ["Category"], "message": ["Message"], "status": ["Status"], "flag": ["Flag"], "lap": ["Lap"]}).withColumn("lap", F.col("lap").try_cast("double").cast("int"))
    for name in filter(has, ("track_status", "session_status")):
        out[name] = messages(spark, folder, name, {"status": ["Status"], "message": ["Message"]})
    if has("race_events"):
        events = messages(spark, folder, "race_events", {"lap": ["Lap", "lap", "LapNumber"], "driver": LAP_DRIVER, "event": ["Event", "Type", "event", "type", "Flag", "flag", "Description"]})
        out["race_events"] = events.select("year", "round", F.col("lap").try_cast("double").cast("int").alias("lap"), "driver", "event")
    for name, source, of in (("telemetry", "telemetry", telemetry), ("telemetry_best", "telemetry_agg", telemetry_best), ("entries", "entrylist", entries)):
        if has(source):
            out[name] = of(spark, folder)
    known = track_profiles(spark, folder)
    return out | ({"track_profiles": known} if known is not None else {})


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet; a year that a table has is replaced, others stay. Tables without a year are replaced whole."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "year" in df.columns:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("year")
        writer.parquet(f"{path.rstrip('/')}/{name}")


def stored(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that ``store`` has written, of the names that the folder has."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if s.isDirectory()]
    read = lambda n: spark.read.schema(schemas[n]) if n in schemas else spark.read
    return {n: read(n).parquet(f"{path.rstrip('/')}/{n}") for n in sorted(names) if not n.startswith(("_", "."))}
