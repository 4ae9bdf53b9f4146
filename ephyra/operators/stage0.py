"""Dimension tables of odors, mixtures and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def components(wide: DataFrame, keys: list[str], slots: dict[str, tuple], names: list[str]) -> DataFrame:
    """(keys, slot, names...): one row for each slot of a wide row whose first column isn't NULL."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), *[F.col(c).alias(n) for c, n in zip(cols, names)]) for s, cols in slots.items()]))
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*").where(F.col(names[0]).isNotNull())


def mixtures(wide: DataFrame, keys: list[str], slots: dict[str, tuple], names: list[str], flag: str) -> DataFrame:
    """components() with vp_mismatch: 1 where the flag's text says so."""
    return components(wide, [*keys, flag], slots, names).withColumn("vp_mismatch", F.coalesce(F.contains(F.lower(flag), F.lit("mismatch")), F.lit(False)).cast("int"))


def dictionary(singles: DataFrame, mixes: DataFrame) -> DataFrame:
    """Singles and mixtures by odor_id, a mixture over a single; roles control, single and mix; rows without a name are left out."""
    s = singles.join(mixes.select("odor_id"), "odor_id", "left_anti").withColumn("role", F.when(F.col("control"), "control").otherwise("single"))
    both = s.unionByName(mixes.withColumn("role", F.lit("mix")), allowMissingColumns=True)
    return both.where(F.trim(F.coalesce("odor_name", F.lit(""))) != "").drop("control")


def panel(loaded: DataFrame, keys: list[str], order: list[str], first: int | None = None) -> DataFrame:
    """Loaded rows with vial_position from 1, the first ones only if asked."""
    p = loaded.withColumn("vial_position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))
    return p.where(F.col("vial_position") <= first) if first else p


def feasibility(mixes: DataFrame, singles: DataFrame) -> DataFrame:
    """mixes (panel, mix, odor, ppm) with the single's ppm on the panel, dose_ratio and status."""
    m = mixes.join(singles, ["panel", "odor"], "left")
    ratio = F.try_divide(F.col("ppm").cast("double"), F.col("single").cast("double"))
    status = F.when(F.col("single").isNull(), "component not on panel").when(F.col("ratio").isNull(), "unknown").when(F.abs(F.col("ratio") - 1) <= 1e-6, "exact").when(F.col("ratio").between(0.5, 2), "interpolation").otherwise("extrapolation")
    return m.withColumn("ratio", ratio).withColumn("status", status).withColumnRenamed("ratio", "dose_ratio")


def panel_feasibility(panels: DataFrame) -> DataFrame:
    """Feasibility of each mixture of a panel table (panel, vial_position, odor_id, mix_name, component_a/b ids and ppm)."""
    slots = {"A": ("component_a_odor_id", "component_a_ppm"), "B": ("component_b_odor_id", "component_b_ppm")}
    is_mix = F.col("component_b_odor_id").isNotNull()
    mixes = components(panels.where(is_mix), ["panel", "odor_id", "mix_name"], slots, ["odor", "ppm"]).withColumnsRenamed({"odor_id": "mix"})
    singles = panels.where(~is_mix).groupBy("panel", F.coalesce("component_a_odor_id", "odor_id").alias("odor")).agg(F.first("component_a_ppm").alias("single"))
    return feasibility(mixes, singles)
