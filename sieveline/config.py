"""Schemas, label maps, feature sets and defaults for the two survey catalogues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: names and limits that results depend on -------------------

TARGET = "label"
GROUP = "group_id"

LABEL_MAP = {"CONFIRMED": 1, "FALSE POSITIVE": 0, "REFUTED": 0}
CANDIDATE_LABEL = "CANDIDATE"

PREFERRED_FLAG = "default_flag"
PREFERRED_VALUE = 1

SEED = 42
N_SPLITS = 5
MIN_PRECISION = 0.5
MIN_RECALL = 0.5
REFLECT_EPS = 1e-6
WHISKER = 1.5
PERCENT_TO_PPM = 10000.0

# raw column of catalogue A, raw column of catalogue B, canonical name
SURVEY_COLUMNS = (
    ("kepid", "pl_name", "group_id"),
    ("koi_disposition", "disposition", "label"),
    ("koi_period", "pl_orbper", "orbital_period_days"),
    ("koi_eccen", "pl_orbeccen", "eccentricity"),
    ("koi_longp", "pl_orblper", "arg_periastron_deg"),
    ("koi_impact", "pl_imppar", "impact_parameter"),
    ("koi_duration", "pl_trandur", "transit_duration_hours"),
    ("koi_depth", "pl_trandep", "transit_depth"),
    ("koi_ror", "pl_ratror", "radius_ratio_rp_rs"),
    ("koi_incl", "pl_orbincl", "inclination_deg"),
    ("koi_dor", "pl_ratdor", "a_over_rs"),
    ("koi_prad", "pl_rade", "planet_radius_rearth"),
    ("koi_sma", "pl_orbsmax", "semi_major_axis_au"),
    ("koi_teq", "pl_eqt", "equilibrium_temp_k"),
    ("koi_insol", "pl_insol", "insolation_earth"),
    ("koi_steff", "st_teff", "stellar_teff_k"),
    ("koi_slogg", "st_logg", "stellar_logg_cgs"),
    ("koi_smet", "st_met", "stellar_metallicity_dex"),
    ("koi_srad", "st_rad", "stellar_radius_rsun"),
    ("koi_smass", "st_mass", "stellar_mass_msun"),
    ("koi_sage", "st_age", "stellar_age_gyr"),
)

DROP_MISSING = ("arg_periastron_deg", "stellar_age_gyr")
DROP_CONSTANT = ("eccentricity",)
DROP_CORRELATED = (
    "semi_major_axis_au",
    "equilibrium_temp_k",
    "radius_ratio_rp_rs",
    "stellar_radius_rsun",
    "stellar_mass_msun",
)
DROP_ANALYSIS = DROP_CONSTANT + DROP_CORRELATED

RIGHT_SKEWED = (
    "insolation_earth",
    "transit_depth",
    "a_over_rs",
    "planet_radius_rearth",
    "orbital_period_days",
    "transit_duration_hours",
)
RIGHT_SKEWED_EXPLORATORY = RIGHT_SKEWED + ("semi_major_axis_au", "equilibrium_temp_k")
LEFT_SKEWED = ("inclination_deg",)

MODEL_FEATURES = (
    "orbital_period_days",
    "impact_parameter",
    "transit_duration_hours",
    "transit_depth",
    "inclination_deg",
    "a_over_rs",
    "planet_radius_rearth",
    "insolation_earth",
    "stellar_teff_k",
    "stellar_logg_cgs",
    "stellar_metallicity_dex",
)

# feature -> (lower, upper); None is an open end
PHYSICAL_INTERVALS: dict[str, tuple[float | None, float | None]] = {
    "orbital_period_days": (0.0, None),
    "impact_parameter": (0.0, 2.0),
    "transit_duration_hours": (0.0, None),
    "transit_depth": (0.0, None),
    "radius_ratio_rp_rs": (0.0, None),
    "inclination_deg": (0.0, 90.0),
    "a_over_rs": (0.0, None),
    "planet_radius_rearth": (0.0, None),
    "semi_major_axis_au": (0.0, None),
    "equilibrium_temp_k": (0.0, None),
    "insolation_earth": (0.0, None),
    "stellar_teff_k": (0.0, None),
    "stellar_logg_cgs": (0.0, 6.0),
    "stellar_metallicity_dex": (-5.0, 1.0),
    "stellar_radius_rsun": (0.0, None),
    "stellar_mass_msun": (0.0, None),
}

SET_A, SET_B, SET_AB = "KOI_test", "K2P", "KOI_test_plus_K2P"

# raw profile name (old names included) -> display name
PROFILE_DISPLAY = {
    "best_f2": "f2",
    "best_recall_constrained": "recall_constrained",
    "best_precision_constrained": "precision_constrained",
    "best_recall_pmin_0_5": "recall_constrained",
    "best_precision_rmin_0_5": "precision_constrained",
}
# display name -> metric an importance run uses
PROFILE_METRIC = {
    "f2": "f2",
    "recall_constrained": "recall",
    "precision_constrained": "precision",
}

# columns of the comparison table, in order
COMPARISON_COLUMNS = (
    "model", "profile", "threshold", "recall", "precision", "f2", "pr_auc", "tn", "fp", "fn", "tp", "dataset",
)
# columns of the diagnostics table, in order
DIAGNOSTICS_COLUMNS = (
    "run_tag", "deploy_id", "model_name", "profile", "dataset", "threshold", "positive_label", "negative_label",
    "accuracy", "recall", "precision", "f2", "roc_auc", "average_precision",
)
# messages of the row validation
MISSING_FEATURE = "Missing required feature: {name}"
MISSING_VALUE = "{name}: value is required"
NOT_NUMERIC = "{name}: expected numeric value, got "
OUT_OF_RANGE = " is {side} {bound:g}"
BELOW, ABOVE = "below minimum", "above maximum"

# --- end of fixed values -----------------------------------------------------

RENAME_A = {a: name for a, _, name in SURVEY_COLUMNS}
RENAME_B = {b: name for _, b, name in SURVEY_COLUMNS}


def _raw_schema(names, group_type):
    kinds = {0: group_type, 1: T.StringType()}
    return T.StructType(
        [T.StructField(n, kinds.get(i, T.DoubleType())) for i, n in enumerate(names)]
    )


SCHEMA_A = _raw_schema(RENAME_A, T.LongType())
SCHEMA_B = _raw_schema(RENAME_B, T.StringType())


@dataclass(frozen=True)
class FeatureSpec:
    """Columns and limits one preprocessing run uses; operators hard-code none of them."""

    features: tuple[str, ...] = MODEL_FEATURES
    right_skewed: tuple[str, ...] = RIGHT_SKEWED
    left_skewed: tuple[str, ...] = LEFT_SKEWED
    intervals: dict = field(default_factory=lambda: dict(PHYSICAL_INTERVALS))
    reflection_max: dict | None = None
    fences: dict | None = None
    eps: float = REFLECT_EPS
    whisker: float = WHISKER
    imputation: str = "median"
    scale: bool = True
