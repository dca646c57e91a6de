"""Levels of records for subgroup analysis, from what their channels say about each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .beats import per_beat
from .features import intervals


def banded(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band whose upper end lies above the value, else last; null stays null."""
    out = F.when(value < bands[0][0], bands[0][1])
    for end, name in bands[1:]:
        out = out.when(value < end, name)
    return out.when(value.isNotNull(), last)


def beat_rates(beats: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n_<name>, hr_<name>): beats and 60 over the median interval; 0 where there is no interval or a median of 0."""
    rr = intervals(beats, key)
    rate = F.coalesce(F.lit(60.0) / F.nullif(F.percentile("rr", 0.5), F.lit(0.0)), F.lit(0.0))
    return rr.groupBy(key).agg(F.count("*").alias(f"n_{name}"), rate.alias(f"hr_{name}"))


def signal_factors(
    ecg: DataFrame, pulse: DataFrame, periodicity: DataFrame, key: str, low: float, high: float,
    apart: float = 15.0, covered: float = 0.5, periodic: float = 0.3, rates: list[tuple[float, str]] | None = None, fastest: str = "HR>=140", few: int = 3,
) -> DataFrame:
    """(key, detector_disagree, pulse_coverage, pulse_acf, hr_regime) of every recording with a beat, a pulse or a periodicity.

    ecg and pulse hold (key, t), periodicity (key, peak), one row per recording. The detectors disagree when their rates
    differ by at least apart, a side without beats having rate 0; coverage is the share of beats that a pulse follows within
    [low, high]; the regime is the rate's band, or "few beats" below few of them. A level that needs beats is null without
    any, and pulse_acf is null without a peak. Every table is grouped by key, so a recording's rows meet in one place once.
    """
    rates = rates or [(50.0, "HR<50"), (100.0, "HR50-100"), (140.0, "HR100-140")]
    both = beat_rates(ecg, key, "ecg").join(beat_rates(pulse, key, "pulse"), key, "full")
    followed = per_beat(ecg, pulse, key, low, high).groupBy(key).agg((F.count("ptt") / F.count("*")).alias("coverage"))
    rows = both.join(followed, key, "full").join(periodicity.select(key, "peak"), key, "full")
    n, hr = F.coalesce("n_ecg", F.lit(0)), F.coalesce("hr_ecg", F.lit(0.0))
    seen = (n > 0) | (F.coalesce("n_pulse", F.lit(0)) > 0)
    return rows.select(
        key,
        F.when(seen, banded(F.abs(hr - F.coalesce("hr_pulse", F.lit(0.0))), [(apart, "agree")], "disagree")).alias("detector_disagree"),
        banded(F.col("coverage"), [(covered, "low")], "high").alias("pulse_coverage"),
        banded(F.col("peak"), [(periodic, "weak")], "clear").alias("pulse_acf"),
        F.when(seen & (n < few), "few beats").when(seen, banded(hr, rates, fastest)).alias("hr_regime"),
    )
