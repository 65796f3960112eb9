"""Tracks: aliases, clusters, profiles and indices.

Profiles of single tracks are a table that the caller brings (slug and any of PROFILE's columns); a column that it lacks takes the default,
and so does a track. Pit loss and fuel effect of a track in the table follow from its other columns unless it has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookback import few
from ..operators.stats import clip

# Other names of tracks, the clusters of some, the default profile, and the bounds of the scaled columns.
ALIASES = {
    "spa": "belgian_grand_prix", "monza": "italian_grand_prix", "suzuka": "japanese_grand_prix", "zandvoort": "dutch_grand_prix", "hungaroring": "hungarian_grand_prix", "barcelona": "spanish_grand_prix",
    "montreal": "canadian_grand_prix", "imola": "emilia_romagna_grand_prix", "interlagos": "sao_paulo_grand_prix", "austin": "united_states_grand_prix", "cota": "united_states_grand_prix", "miami": "miami_grand_prix",
    "las_vegas": "las_vegas_grand_prix", "lusail": "qatar_grand_prix", "yas_marina": "abu_dhabi_grand_prix", "shanghai": "chinese_grand_prix", "albert_park": "australian_grand_prix", "jeddah": "saudi_arabian_grand_prix",
    "baku": "azerbaijan_grand_prix", "usa_grand_prix": "united_states_grand_prix", "brazilian_grand_prix": "sao_paulo_grand_prix", "mexico_city_grand_prix": "mexican_grand_prix", "monaco": "monaco_grand_prix",
}
CLUSTERS = {"belgian_grand_prix": "balanced", "italian_grand_prix": "low_df", "japanese_grand_prix": "high_df", "singapore_grand_prix": "high_df"}
CLUSTER_IDS = {"low_df": 0, "balanced": 1, "high_df": 2}
PROFILE = {"straight_pct": 0.55, "fast_corner_ratio": 0.50, "lap_km": 5.5, "braking_ev_per_lap": 7.0, "drs_zones": 2.0, "tdeg_index": 0.55, "aero_df_index": 0.55}
BOUNDS = {"straight": ("straight_pct", 0.35, 0.75), "fast_corner": ("fast_corner_ratio", 0.25, 0.75), "braking": ("braking_ev_per_lap", 4.0, 12.0), "drs": ("drs_zones", 0.0, 4.0), "lap": ("lap_km", 3.0, 7.5), "tdeg": ("tdeg_index", 0.2, 0.9), "aero_df": ("aero_df_index", 0.2, 0.9)}


def mapped(key: Column, values: dict[str, object], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()], otherwise)


def slug_of(slug: Column) -> Column:
    return mapped(slug, ALIASES, slug)


def cluster_of(slug: Column) -> Column:
    return mapped(slug, CLUSTERS, F.lit("balanced"))


def profiles(rounds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """year, round, slug with the profile of the track and the indices derived from it."""
    out = rounds.withColumn("slug", F.coalesce("slug", F.lit("")))
    extra = [c for c in (known.columns if known is not None else []) if c in PROFILE or c in ("pit_loss_s", "fuel_effect_s_per10kg")]
    matched = F.lit(False)
    if known is not None:
        out = out.join(few(known.select("slug", *extra, F.lit(True).alias("_known"))), "slug", "left")
        matched = F.col("_known").isNotNull()
    value = {c: (F.coalesce(c, F.lit(v)) if c in extra else F.lit(v)).cast("double") for c, v in PROFILE.items()}
    cluster = cluster_of(F.col("slug"))
    scaled = {n: clip((value[c] - lo) / (hi - lo), 0, 1) for n, (c, lo, hi) in BOUNDS.items()}
    loss = F.coalesce(*([F.col("pit_loss_s")] if "pit_loss_s" in extra else []), F.when(matched, 17.0 + 0.6 * value["lap_km"] + 0.8 * value["drs_zones"]).otherwise(19.0))
    fuel = F.coalesce(*([F.col("fuel_effect_s_per10kg")] if "fuel_effect_s_per10kg" in extra else []), F.when(matched, 0.036 * value["lap_km"] + 0.005).otherwise(0.21))
    return out.select(
        "year", "round", F.col("slug").alias("track_slug"), *[v.alias(f"track_{c}") for c, v in value.items()], cluster.alias("track_cluster"), mapped(cluster, CLUSTER_IDS, F.lit(1)).alias("track_cluster_id"),
        *[(cluster == c).cast("int").alias(f"track_cluster_{c}") for c in CLUSTER_IDS], clip(scaled["straight"] - 0.7 * scaled["aero_df"], -1, 1).alias("track_power_vs_df_index"),
        clip(0.35 * scaled["straight"] + 0.40 * scaled["braking"] + 0.25 * scaled["drs"] - 0.20 * scaled["fast_corner"], 0, 1).alias("track_overtake_index"), loss.alias("track_pit_loss_s"), fuel.alias("track_fuel_effect_s_per10kg"),
        *[v.alias(f"track_{n}_n") for n, v in scaled.items()])
