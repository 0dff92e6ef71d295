"""Queries on spectra of each time segment, their uncertainty, and simulated statistics. SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import compact, rounded
from skein.operators import segments, timefrequency
from skein.plans.cycles import EV, PI, SQL_SENS, SQL_STAT, T, moment_cte, packed, segmented, values

TF = timefrequency.TimeFrequency(3, 3)
HZ = timefrequency.TimeFrequency(rate=2.0, time=[(1, 20), (15, 40)], hertz=[(0.1, 0.4), (0.3, 1.0)])


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("cycle_id", F.posexplode("f").alias("k", "v")).select("cycle_id", (F.col("k") + 1).alias("feature_idx"), "v")


def q68_segment_spectra(spark, d):
    """Nine statistics of overlapping time segments and of three bands of each one's spectrum."""
    rows = packed(spark, d).select("cycle_id", TF.features(F.col("samples")).alias("f"))
    return _long(rows).select("cycle_id", "feature_idx", compact(F.col("v")).alias("log_value"))


def q69_segment_spectra_in_hertz(spark, d):
    """The same of given samples and of bands in Hz."""
    rows = packed(spark, d).select("cycle_id", HZ.features(F.col("samples")).alias("f"))
    return _long(rows).select("cycle_id", "feature_idx", compact(F.col("v")).alias("log_value"))


def q70_segment_spectra_uncertainty(spark, d):
    """Their uncertainties, through the covariance that a segment's bins have by their common samples."""
    rows = packed(spark, d).select("cycle_id", TF.uncertainty(F.col("samples"), F.col("u")).alias("f"))
    return _long(rows).select("cycle_id", "feature_idx", compact(F.col("v")).alias("log_u"))


def q71_simulated_extremes(spark, d):
    """Place and value of the maximum, minimum and crest factor by 2,000 seeded draws a cycle, in two blocks."""
    found = timefrequency.simulated(packed(spark, d), segments.overlapping(T, 3), runs=2000, unit=250, blocks=2, keys=("cycle_id",))
    return found.select("cycle_id", "seg", "statistic", rounded(F.col("mean")).alias("mean"), rounded(F.col("u")).alias("u"), "runs")


NAMED = [q68_segment_spectra, q69_segment_spectra_in_hertz, q70_segment_spectra_uncertainty, q71_simulated_extremes]


def _spectra(tf: timefrequency.TimeFrequency) -> str:
    """CTEs: ``ts`` samples by time segment, ``sp`` bins of each one's spectrum, ``al`` the samples of all segments, those of bands numbered after those of time."""
    time = tf.time_segments(T)
    bands = [(s, len(time) + (s - 1) * len(tf.bands(b - a + 1)) + f, lo, hi) for s, a, b in time for f, lo, hi in tf.bands(b - a + 1)]
    return f"""{segmented("ts", time)},
tc as (select *, x - avg(x) over w y, count(*) over w len from ts window w as (partition by cycle_id, seg)),
sp as (select cycle_id, seg, len, k, sqrt(re * re + im * im) h, re, im, case when k = 0 then 0.0 when k = len // 2 then 1.0 / len else 2.0 / len end wt from
(select cycle_id, seg, len, k, sum(y * cos(2 * {PI} * k * (pos - 1) / len)) re, -sum(y * sin(2 * {PI} * k * (pos - 1) / len)) im from (select *, unnest(range(0, len // 2 + 1)) k from tc) group by all)),
bd(s, seg, lo, hi) as (values {values(bands)}),
al as (select cycle_id, seg, pos, x from ts union all select cycle_id, bd.seg, k + 2 - lo, wt * h from sp join bd on bd.s = sp.seg and k + 1 between lo and hi)"""


_LOG = "case when isfinite({v}) then round(sign({v}) * ln(1 + abs({v})), 7) + 0.0 end"


def _features_sql(tf) -> str:
    items = ", ".join(f"struct_pack(k := {k + 1}, v := ({SQL_STAT[n]})::DOUBLE)" for k, n in enumerate(segments.NINE))
    return f"""with {EV}, {_spectra(tf)}, {moment_cte("m", "al")}
select cycle_id, ((seg - 1) * 9 + f.k)::INT feature_idx, {_LOG.format(v="f.v")} log_value from (select cycle_id, seg, unnest([{items}]) f from m group by cycle_id, seg)"""


def oracle() -> dict[str, str]:
    items = ", ".join(f"struct_pack(k := {k + 1}, v := ({SQL_SENS[n]})::DOUBLE)" for k, n in enumerate(segments.NINE))
    n = len(TF.time_segments(T))
    return {
        "q68_segment_spectra": _features_sql(TF),
        "q69_segment_spectra_in_hertz": _features_sql(HZ),
        "q70_segment_spectra_uncertainty": f"""with {EV}, {_spectra(TF)}, {moment_cte("m", "al")},
se as (select cycle_id, seg, pos, unnest([{items}]) f from m),
ch as (select se.cycle_id, se.seg, f.k stat, tc.pos, sum(f.v * case when sp.k = 0 then 0.0 else wt * (re * cos(2 * {PI} * sp.k * (tc.pos - 1) / tc.len) - im * sin(2 * {PI} * sp.k * (tc.pos - 1) / tc.len)) / h end) c, any_value(tc.u) u
from se join bd using (seg) join sp on sp.cycle_id = se.cycle_id and sp.seg = bd.s and sp.k = se.pos + lo - 2 join tc on tc.cycle_id = se.cycle_id and tc.seg = bd.s group by all),
un as (select cycle_id, seg, f.k stat, f.v c, u from se join ts using (cycle_id, seg, pos) where se.seg <= {n} union all select cycle_id, seg, stat, c, u from ch),
o as (select cycle_id, seg, stat, case when count(*) = count(c) then sqrt(sum(c * c * u * u)) end v from un group by all)
select cycle_id, ((seg - 1) * 9 + stat)::INT feature_idx, {_LOG.format(v="v")} log_u from o""",
    }
