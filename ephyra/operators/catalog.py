"""From a catalog of experiments, trials and acquisitions to validated tables of trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.columns import seconds_between


def trial_table(trials: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Trials with their acquisition's start and three durations in seconds. Trials without an acquisition stay."""
    t = trials.join(acquisitions.select("acq_id", "acq_start"), "acq_id", "left")
    return t.withColumns({
        "odor_duration_s": seconds_between("odor_off", "odor_on"),
        "baseline_s": seconds_between("odor_on", "trial_start"),
        "odor_minus_acq_start_s": seconds_between("odor_on", "acq_start"),
    })


def assign_state(trials: DataFrame, key: list[str], program: str, start: str, tie: str, most: int | None = 2) -> DataFrame:
    """trials with block (programs in order of their first trial), state and trial_in_block. One program: no state; two: pre and
    post; more than `most` (if given) is an error."""
    programs = trials.groupBy(*key, program).agg(F.min(start).alias("_first"))
    by = Window.partitionBy(*key)
    programs = programs.withColumn("block", F.row_number().over(by.orderBy("_first", program)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    if most is not None:
        programs = programs.withColumn("block", F.when(F.col("_n") <= most, F.col("block")).otherwise(F.raise_error(F.lit(f"more than {most} programs"))))
    state = F.when(F.col("_n") == 2, F.when(F.col("block") == 0, "pre").otherwise("post"))
    got = trials.join(programs.withColumn("state", state).drop("_first", "_n"), [*key, program])
    return got.withColumn("trial_in_block", F.row_number().over(Window.partitionBy(*key, "block").orderBy(start, tie)))


def block_gap(trials: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, gap_s) from the end of the first block to the begin of the second, NULL with one block."""
    return trials.groupBy(*key).agg(seconds_between(F.min(F.when(F.col("block") == 1, F.col(start))), F.max(F.when(F.col("block") == 0, F.col(end)))).alias("gap_s"))


def summarize(trials: DataFrame, key: list[str], odor: str, durations: dict[str, str], nullable: str) -> DataFrame:
    return trials.groupBy(*key).agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct(odor).alias("n_odors"), *[F.median(c).alias(a) for a, c in durations.items()], F.count_if(F.col(nullable).isNull()).alias("n_missing"))


def value_counts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, counts): a map from value to its number of rows."""
    n = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias("counts"))


def validated_group(members: DataFrame, experiments: DataFrame, key: str, subject: str, size: list[str], start: str) -> DataFrame:
    """Groups with the verdict of their checks: not empty, one subject, one frame size, distinct starts without NULLs."""
    m = experiments.join(members, "exp_id").groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(subject).alias("n_subjects"), F.count_distinct(F.struct(*size)).alias("n_sizes"),
        F.countDistinct(start).alias("n_starts"), F.count_if(F.col(start).isNull()).alias("n_null"),
    )
    problem = F.when(F.col("n_subjects") > 1, "several subjects").when(F.col("n_sizes") > 1, "several frame sizes").when(F.col("n_null") > 0, "no start").when(F.col("n_starts") < F.col("n"), "starts repeat").otherwise("ok")
    return m.withColumn("status", problem)


def combine(parts: list[DataFrame], labels: list[str], rate: str | None = None, spread: float = 1e-3) -> DataFrame:
    """The trials of two experiments, one after the other, labelled. Frame rates may differ by `spread` of the least."""
    if len(parts) != len(labels) or len(parts) > 2:
        raise ValueError("two parts at most, one label for each")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("state", F.lit(s)) for p, s in zip(parts, labels)])
    if rate:
        low, high = both.agg(F.min(rate), F.max(rate)).first()
        if low is not None and high > low * (1 + spread):
            raise ValueError(f"frame rates differ: {low} and {high}")
    return both


def resolve_inputs(trials: DataFrame, files: DataFrame, windows: DataFrame, *, source: str | None = None, approved_only: bool = True, excluded: list[int] = ()) -> DataFrame:
    """trials with path, on_frame, off_frame, kept and reason: why a trial can't be used, the first of: excluded, no file, not
    approved (NULL counts as not approved), no window. Of several files of an acquisition the last by file_id counts."""
    f = files.where(F.col("source") == source) if source else files
    latest = f.groupBy("acq_id").agg(F.max_by(F.struct("path", F.coalesce("approved", F.lit(False)).alias("approved")), "file_id").alias("_f"))
    got = trials.join(latest, "acq_id", "left").join(windows.select("acq_id", "on_frame", "off_frame"), "acq_id", "left")
    reason = F.when(F.col("acq_id").isin(*excluded) if excluded else F.lit(False), "excluded").when(F.col("acq_id").isNull() | F.col("_f").isNull(), "no file")
    if approved_only:
        reason = reason.when(~F.col("_f.approved"), "not approved")
    reason = reason.when(F.col("on_frame").isNull(), "no window")
    return got.withColumns({"path": F.col("_f.path"), "reason": reason, "kept": reason.isNull()}).drop("_f")


def approved_group(files: DataFrame, acquisitions: DataFrame, key: list[str], source: str | None = None) -> DataFrame:
    """Approved files (NULL is not) of each group in order of acq_id."""
    f = files.where(F.coalesce("approved", F.lit(False)))
    return (f.where(F.col("source") == source) if source else f).join(acquisitions, "acq_id").withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("acq_id", "file_id")))


def aligned_rows(aux: DataFrame, rounds: DataFrame, on: list[str]) -> DataFrame:
    """(aux_row, round_row) of the acquisitions in both, in the round's order."""
    return aux.select(*on, "aux_row").join(rounds.select(*on, "round_row"), on).select("aux_row", "round_row")


def paired_by_place(trials: DataFrame, windows: DataFrame, key: list[str], trial_order: list[str], window_order: list[str]) -> DataFrame:
    """The k-th trial with the k-th window; an error unless every key has as many of either."""
    a = trials.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*trial_order)))
    b = windows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*window_order)))
    both = a.join(b, [*key, "_k"], "full_outer")
    bad = F.raise_error(F.lit("trials and windows differ in number"))
    there = F.col(trial_order[0]).isNotNull() & F.col(window_order[0]).isNotNull()
    return both.withColumn("_k", F.when(there, F.col("_k")).otherwise(bad)).withColumnRenamed("_k", "place")


def encoded(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """df with the column as a code from 0 in order of its values (-1: NULL), and the levels (code, level)."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("level")).distinct()
    levels = levels.withColumn("code", F.row_number().over(Window.orderBy("level")) - 1)
    coded = df.join(levels, F.col(column) == F.col("level"), "left").withColumn(column, F.coalesce("code", F.lit(-1))).drop("level", "code")
    return coded, levels.select("code", "level")


def decoded(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    return df.join(levels, F.col(column) == F.col("code"), "left").withColumn(column, F.col("level")).drop("code", "level")


def label_list(df: DataFrame, key: list[str], column: str, sep: str = " + ") -> DataFrame:
    """(key, labels): the distinct values in order, joined."""
    return df.groupBy(*key).agg(F.concat_ws(sep, F.array_sort(F.collect_set(column))).alias("labels"))


def display_rank(state):
    return F.when(state == "pre", 0).when(state == "post", 1).otherwise(2)


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")


def top_k(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def pending(trials: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Trials that are not done yet."""
    return trials.join(done.select(*on).distinct(), on, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def staleness(rounds: DataFrame, masks: DataFrame) -> DataFrame:
    """rounds (key, stored hash, traces?) against the hash of the mask now: ok, STALE, or mask only."""
    got = masks.join(rounds, "key", "left")
    return got.withColumn("status", F.when(F.col("stored").isNull(), "no rounds found").when(~F.col("has_traces"), "mask only").when(F.col("stored") == F.col("current"), "ok").otherwise("STALE"))
