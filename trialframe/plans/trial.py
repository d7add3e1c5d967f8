"""The data sets of the trial: cleaned observations and the rows each response uses.

Input columns are those of ``sources.files`` after tidying. Every function is
a lazy plan of narrow steps, but for the two joins of the cleaning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from trialframe.functions.scalar import (
    days_since,
    either,
    null_tolerant,
    phase_label,
    phase_substitute,
    relative_to,
    time_varying_bounds,
)
from trialframe.operators.cleaning import duplicate_mask, membership_flag, outlier_mask

# Fixed values of the trial: dates, plausible ranges and bounds.
FIELD_HARVEST = "2021-01-13"
EXPERIMENT_START = "2021-03-03"
PLANTED = "2021-03-17"
GROWTH_FROM = "2021-04-25"
LAST_HARVEST = "2021-08-25"
LEAF_BOUNDS = [(50, 1.2), (75, 2.5), (120, 4.2)]
CONDUCTANCE = (0.0, 0.3)
LIMITS = {
    "rhizome_least": 6,  # at the samplings Grain and Final
    "rhizome_most": 27,
    "root_least": 6,  # at Final, beside a rhizome
    "shoot_least": 1,  # on the last day
    "root_below": 17,
    "final_root_range": (5, 15),
    "starch_after_days": 14,
}
DEDUPLICATED = ["above_ground_g", "rhi_sample_g", "root_g", "starch_rhi"]


def clean_observations(
    obs: DataFrame, dead: DataFrame, row_id: str, limits: Mapping[str, object] = LIMITS
) -> DataFrame:
    """Derived columns, then implausible values and repeated readings set to NULL.

    ``dead`` lists rhi_id of plants that died; ``row_id`` gives the file order,
    which decides the reading that counts as the first. ``limits`` are the
    plausible values.
    """
    in_storage = F.col("phase") == "Storage"
    derived = (
        obs.withColumn("phase", phase_label("harvest_date", GROWTH_FROM, "Storage", "Growth"))
        .withColumn("field_rhi_harvest", F.lit(FIELD_HARVEST).cast("date"))
        .withColumn("experiment_start", F.lit(EXPERIMENT_START).cast("date"))
        .withColumn("planted_rhi", F.lit(PLANTED).cast("date"))
        .withColumn("days", days_since("harvest_date", PLANTED))
        .withColumn("rhi_sample_g", phase_substitute(in_storage, "rhi_initial_fw_g", "rhi_sample_g"))
    )
    flagged = membership_flag(derived, dead, "rhi_id", out="caputd")
    alive = F.col("caputd") == "alive"
    rhizome, root, shoot = F.col("rhi_sample_g"), F.col("root_g"), F.col("above_ground_g")
    late = F.col("sampling").isin("Grain", "Final")
    final = F.col("sampling") == "Final"
    last_day = F.col("harvest_date") == F.lit(LAST_HARVEST).cast("date")
    light = late & (rhizome < limits["rhizome_least"])
    masked = outlier_mask(
        flagged,
        [
            ("rhi_sample_g", alive & (light | (rhizome > limits["rhizome_most"]))),
            ("root_g", alive & final & rhizome.isNotNull() & (root < limits["root_least"])),
            ("above_ground_g", alive & last_day & (shoot < limits["shoot_least"])),
        ],
    )
    return duplicate_mask(masked, DEDUPLICATED, row_id)


def _zero_at_start(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, either(F.col("sampling") == "14-Day", F.lit(0.0), F.col(column)))


def storage_starch(obs: DataFrame) -> DataFrame:
    """Living rhizomes up to planting, with a starch reading."""
    return obs.where(F.col("starch_rhi").isNotNull() & (F.col("caputd") == "alive") & (F.col("days") <= 0))


def growth_starch(obs: DataFrame) -> DataFrame:
    """Living rhizomes after planting, with a starch reading."""
    return obs.where(F.col("starch_rhi").isNotNull() & (F.col("caputd") == "alive") & (F.col("days") > 0))


def belowground(obs: DataFrame, limits: Mapping[str, object] = LIMITS) -> DataFrame:
    """Rhizome, root and their sum from planting on."""
    root = F.col("root_g")
    kept = (
        obs.where((F.col("caputd") == "alive") & (F.col("days") >= 0))
        .where(null_tolerant("root_g", root < limits["root_below"]))
        .where(null_tolerant("root_g", ~((F.col("sampling") == "Final") & ~root.between(*limits["final_root_range"]))))
    )
    below = F.col("rhi_sample_g") + either(F.col("days") <= 0, F.lit(0.0), root)
    with_sum = kept.withColumn("below_bm", below)
    return _zero_at_start(with_sum, "root_g").withColumn(
        "rel_rhi_bm", relative_to("rhi_sample_g", "rhi_initial_fw_g")
    )


def leaf_area(obs: DataFrame) -> DataFrame:
    return _zero_at_start(obs, "leaf_area_cm2").where(F.col("leaf_area_cm2").isNotNull())


def aboveground(obs: DataFrame) -> DataFrame:
    return _zero_at_start(obs, "above_ground_g").where(F.col("above_ground_g").isNotNull())


def starch_mass(obs: DataFrame, limits: Mapping[str, object] = LIMITS) -> DataFrame:
    """Starch of the whole rhizome of living plants, from the third week of the growth phase on."""
    mass = F.col("starch_rhi") * F.col("rhi_sample_g")
    growing = F.col("harvest_date") >= F.lit(GROWTH_FROM).cast("date")
    return obs.withColumn("starch_rhi_g", mass).where(
        F.col("starch_rhi_g").isNotNull() & (F.col("caputd") == "alive") & growing & (F.col("days") > limits["starch_after_days"])
    )


def development(dev: DataFrame, obs: DataFrame) -> DataFrame:
    """Development counts with days since planting and the status of the plant."""
    died = obs.where(F.col("caputd") != "alive").select("rhi_id")
    counted = dev.where(F.col("tot_leaves").isNotNull()).withColumn(
        "days", days_since("sampling_date", F.col("planted_rhi"))
    )
    return membership_flag(counted, died, "rhi_id", out="caputd")


def leaf_development(dev: DataFrame) -> DataFrame:
    """Without counts too low for their day."""
    return dev.where(time_varying_bounds("days", "avg_leaves", LEAF_BOUNDS))


def flowering(dev: DataFrame) -> DataFrame:
    return dev.where(F.col("avg_flower") > 0)


def water_use_efficiency(gas: DataFrame) -> DataFrame:
    """Assimilation per conductance, over plausible conductances."""
    low, high = CONDUCTANCE
    kept = gas.where((F.col("gsw") > low) & (F.col("gsw") < high))
    return kept.withColumn("wue", relative_to("a", "gsw"))
