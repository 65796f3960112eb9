"""Choices that are made on column names and types when a plan is built; no data is read unless said so."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that the table has, exactly first, else in another case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((n for n in names if n in df.columns), next((lower[n.lower()] for n in names if n.lower() in lower), None))


def pick(df: DataFrame, names: list[str], kind: str) -> Column:
    """The detected column, leniently cast, NaN as null; null if there is none."""
    found = detect(df, names)
    value = F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value


def sanitize(df: DataFrame) -> DataFrame:
    """Names stripped; columns that then share a name become one, which must not conflict (else the query raises)."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(df.columns):
        places.setdefault(re.sub(r"\s+", " ", c).strip(), []).append(i)
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for name, at in places.items():
        columns = [F.col(f"_{i}") for i in at]
        value = F.coalesce(*columns)
        for c in columns[1:]:
            numeric = df.schema[at[0]].dataType.simpleString() in ("double", "float")
            differs = F.abs(value - c) > 1e-8 + 1e-6 * F.abs(c) if numeric else value != c
            value = F.when(differs, F.raise_error(F.lit(f"conflicting columns {name}"))).otherwise(value)
        out.append(value.alias(name))
    return flat.select(*out)


def select_features(df: DataFrame, blacklist: list[str] = (), drop_prefixes: list[str] = (), keep_prefixes: list[str] = (), drop_pattern: str | None = None, skip_empty: bool = True) -> list[str]:
    """The numeric columns that pass the lists, without all-null ones (one aggregate over the data)."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "boolean", "decimal")]
    names = [c for c in numeric if c not in blacklist and not c.startswith(tuple(drop_prefixes)) and (not keep_prefixes or c.startswith(tuple(keep_prefixes))) and not (drop_pattern and re.search(drop_pattern, c))]
    if not (skip_empty and names):
        return names
    counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
    return [c for c in names if counts[c]]


def filter_columns(names: list[str], keep: list[str] = (), drop: list[str] = (), contains: list[str] = (), exact: list[str] = ()) -> list[str]:
    """Names that start with a prefix of ``keep`` (all if there is none), hold a text of ``contains`` or are listed in ``exact``,
    without those that start with a prefix of ``drop``; in their order."""
    chosen = lambda c: c in exact or any(t in c for t in contains) or c.startswith(tuple(keep)) or not (keep or contains or exact)
    return [c for c in names if chosen(c) and not c.startswith(tuple(drop))]


#: Prefixes and names of the columns that are known before a weekend, and parts of names that tell a column's direction.
FUTURE_PREFIXES = ("track_", "track_is_", "driver_trackc_pre_", "weather_pre_", "chaos_pre_", "hist_pre_", "tele_pre_", "quali_pre_", "compound_mix_priors_", "tyre_delta_priors_", "expected_deg_", "reliab_", "lap1_", "net_pass_", "driver_team_pre_")
FUTURE_NAMES = ("driver_trend", "team_dev_trend", "stability_delta_vs_tm")
LOW_IS_GOOD = ("_pos_p50", "_pos_iqr", "finish_p50", "finish_iqr", "pace_p50_s", "bestpos_min")
HIGH_IS_GOOD = ("_share", "_rate", "_quality", "_perf", "top", "clean_share")


def future_columns(names: list[str]) -> list[str]:
    """The columns of the future profile; raises if none is left."""
    kept = filter_columns(names, keep=list(FUTURE_PREFIXES), exact=list(FUTURE_NAMES))
    if not kept:
        raise ValueError("the future profile leaves no column")
    return kept


def direction(name: str) -> int | None:
    """-1 where a low value should mean a good result, 1 where a high one should, None where the name doesn't tell."""
    text = name.lower()
    return -1 if any(p in text for p in LOW_IS_GOOD) else 1 if any(p in text for p in HIGH_IS_GOOD) else None


#: Names that a target may have, the surest first.
TARGETS = ("finish_pos_eff", "finish_position", "finish_pos", "final_position", "position", "pos", "finishplace", "finish_place", "target_finish_position", "target_pos", "y_finish_pos", "y_pos")
OUT_WORDS = r"dnf|did not finish|retired|accident|collision|engine|gearbox|hydraul|electr|wheel|not classified|\bnc\b|disqual|dq|damage|drive shaft"


def with_target(df: DataFrame, hint: str | None = None, out_position: float = 21.0) -> DataFrame:
    """df with finish_pos_eff: as it is, else from the hint, a listed name or a name with both finish or pos and a position, the
    first that has a number (one aggregate over the data); ``out_position`` where a column Status tells of a retirement."""
    if "finish_pos_eff" in df.columns:
        return df
    alike = [c for c in df.columns if ("finish" in c.lower() or c.lower().startswith("pos") or c.lower().endswith("_pos")) and "pos" in c.lower()]
    names = list(dict.fromkeys([*filter(None, [detect(df, [n]) for n in ([hint] if hint else []) + list(TARGETS)]), *alike]))
    number = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    known = df.agg(*[F.count(F.when(~F.isnan(v), v)).alias(c) for c, v in number.items()]).first() if names else {}
    usable = [c for c in names if known[c]]
    if not usable:
        raise ValueError("no column holds a finish position")
    value = F.when(~F.isnan(number[usable[0]]), number[usable[0]])
    if "Status" in df.columns:
        value = F.when(F.lower(F.col("Status").cast("string")).rlike(OUT_WORDS), out_position).otherwise(value)
    return df.withColumn("finish_pos_eff", value)


def scenario(df: DataFrame, driver: str = "driver", track: str | None = None, weather: dict[str, tuple[list[str], float]] | None = None, grid: dict[str, float] | None = None, grid_names: list[str] = ("grid", "GridPosition", "grid_pos")) -> DataFrame:
    """df with what a user supposes: the one-hot column of a track is 1 and all others 0 (all are 0 if none is the track's), the
    first column that a weather value's aliases name takes it, listed drivers take grid places. What has no column is left out."""
    values: dict[str, Column] = {}
    if track is not None:
        slug = re.sub(r"[^a-z0-9]+", "_", track.lower()).strip("_")
        values |= {c: F.lit(float(c in (f"track_is_{slug}", f"track_is_{slug}_grand_prix"))) for c in df.columns if c.startswith("track_is_")}
    for names, value in (weather or {}).values():
        if found := detect(df, names):
            values[found] = F.lit(float(value))
    place = detect(df, list(grid_names))
    if grid and place:
        values[place] = F.coalesce(*[F.when(F.col(driver) == d, F.lit(float(p))) for d, p in grid.items()], F.col(place).cast("double"))
    return df.withColumns(values)


def ensure(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in names if c not in df.columns})


def coerce_numeric(df: DataFrame, prefixes: list[str], least: float = 0.6) -> DataFrame:
    """Text columns with a known prefix become numbers where enough of their values are (one aggregate over the data)."""
    names = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name.startswith(tuple(prefixes))]
    if not names:
        return df
    shares = df.agg(*[F.avg(F.col(c).try_cast("double").isNotNull().cast("int")).alias(c) for c in names]).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in names if (shares[c] or 0) >= least})


def override(df: DataFrame, values: dict[str, object], per_key: DataFrame | None = None, key: list[str] = ()) -> DataFrame:
    """Existing columns replaced by scalars, then by the non-null values of a table of the same names."""
    out = df.withColumns({c: F.lit(v) for c, v in values.items() if c in df.columns})
    if per_key is not None:
        shared = [c for c in per_key.columns if c in df.columns and c not in key]
        renamed = per_key.select(*key, *[F.col(c).alias(f"_o_{c}") for c in shared])
        out = out.join(renamed, list(key), "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in shared}).drop(*[f"_o_{c}" for c in shared])
    return out


def check_key(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows that break the key: null parts or repeated values, with their count."""
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in key], F.lit(0)) == 1
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter((F.col("rows") > 1) | null)


def in_list_order(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of the listed keys, in the list's order; of repeated keys one row."""
    order = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_pos", key))
    return df.dropDuplicates([key]).join(F.broadcast(order), key).orderBy("_pos").drop("_pos")
