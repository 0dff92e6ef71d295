"""Queries on cycles of thousands of samples, thinned for their extractors and drawn again at full length. SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.layout import compact, matrix_udf, rounded
from skein.operators import piecewise, resample
from skein.operators.stack import EXTRACTORS, Extractor, fit_piecewise, fit_principal
from skein.plans.cycles import EV, R, packed
from skein.sources.tables import daily_cycles

PIECES = 8


def _grid(rows: DataFrame) -> resample.Grid:
    return resample.Grid.of(rows.select(F.size("samples").alias("n")).first().n)


def _long(rows: DataFrame, *named: str) -> DataFrame:
    one = F.arrays_zip(*[F.col(n) for n in named])
    return rows.select("cycle_id", F.posexplode(one).alias("k", "e")).select("cycle_id", (F.col("k") + 1).alias("k"), *[rounded(F.col(f"e.{n}")).alias(n) for n in named])


def q83_thinned_cycles(spark, d):
    """Daily quantities of each supplier, low-passed and thinned to some 400 samples, with their uncertainty."""
    rows = daily_cycles(spark, d)
    grid = _grid(rows)
    thin = rows.select("cycle_id", matrix_udf(grid.down)(F.col("samples")).alias("x"), F.transform(matrix_udf(lambda u: grid.down_variance(u * u))(F.col("u")), lambda v: F.sqrt(v)).alias("u"))
    return _long(thin, "x", "u")


def q84_thinned_breakpoints(spark, d):
    """The best three breaks of the thinned cycles, and the days for which they stand."""
    rows = daily_cycles(spark, d)
    grid = _grid(rows)
    thin = rows.select("cycle_id", matrix_udf(grid.down)(F.col("samples")).alias("samples"))
    error, splits = piecewise.best_splits(piecewise.error_matrix(piecewise.interval_errors(thin)), PIECES // 2 - 1)[-1]
    found = [(k + 1, s, *grid.samples(s), error) for k, s in enumerate(splits)]
    made = spark.createDataFrame(found, "split int, at int, first_day int, last_day int, error double")
    return made.select("split", "at", "first_day", "last_day", compact(F.col("error")).alias("log_error"))


def q85_thinned_pieces(spark, d):
    """Mean and slope of each piece with their uncertainty."""
    rows = daily_cycles(spark, d)
    e = fit_piecewise(rows, PIECES)
    return _long(rows.select("cycle_id", e.features(F.col("samples")).alias("value"), e.uncertainty(F.col("samples"), F.col("u")).alias("u")), "value", "u")


def _drawn(rows: DataFrame, e: Extractor) -> DataFrame:
    back = e.reconstruct(e.features(F.col("samples")))
    sse = F.aggregate(F.zip_with("samples", back, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("cycle_id", F.size(back).alias("samples"), compact(sse).alias("log_sse"))


def q86_pieces_drawn(spark, d):
    """Squared error of the lines, interpolated to all days."""
    rows = daily_cycles(spark, d)
    return _drawn(rows, fit_piecewise(rows, PIECES))


def q87_components_drawn(spark, d):
    """The same of all components of the thinned cycles: what thinning alone loses."""
    rows = daily_cycles(spark, d)
    return _drawn(rows, fit_principal(rows, None))


def q88_raw_features(spark, d):
    """The identity extractor: samples as features, their uncertainty as the features'."""
    rows = packed(spark, d)
    e = EXTRACTORS["identity"](rows)
    return _long(rows.select("cycle_id", e.features(F.col("samples")).alias("value"), e.uncertainty(F.col("samples"), F.col("u")).alias("u")), "value", "u")


NAMED = [q83_thinned_cycles, q84_thinned_breakpoints, q85_thinned_pieces, q86_pieces_drawn, q87_components_drawn, q88_raw_features]

#: The given tables span 2,485 to 2,749 days at any size: one factor.
Q = resample.factor(2499)
H = 10 * Q
_TAPS = f"h(j, c) as (select unnest(range({-H}, {H + 1})), unnest([{', '.join(repr(float(x)) for x in resample.low_pass(Q))}]))"
_DAYS = """b as (select min(l_shipdate::date) lo, (max(l_shipdate::date) - min(l_shipdate::date) + 1)::INT n from lineitem where l_suppkey is not null),
ds as (select l_suppkey cycle_id, (l_shipdate::date - (select lo from b) + 1)::INT t, sum(l_quantity) x from lineitem where l_shipdate is not null and l_suppkey is not null group by 1, 2),
dd as (select c.cycle_id, g.t, coalesce(ds.x, 0.0) x, 0.01 * abs(coalesce(ds.x, 0.0)) + 0.001 u from (select distinct cycle_id from ds) c cross join (select unnest(range(1, (select n + 1 from b)))::INT t) g left join ds on ds.cycle_id = c.cycle_id and ds.t = g.t)"""
_THIN = f"""with {_DAYS}, {_TAPS},
w as (select i, {Q} * (i - 1) + 1 - j t, c from (select unnest(range(1, (select (n + {Q - 1}) // {Q} + 1 from b)))::INT i), h),
dn as (select cycle_id, i, sum(c * x) x, sqrt(sum(c * c * u * u)) u from w join dd using (t) group by 1, 2)"""
_CUT = """pr as (select cycle_id, i, x, sum(x) over w s, sum(x * x) over w ss, sum(i * x) over w st from (select cycle_id, i, x - avg(x) over (partition by cycle_id) x from dn) window w as (partition by cycle_id order by i)),
m as (select max(i) n from dn),
e as (select a.i, z.i j, sum(greatest((z.ss - a.ss + a.x * a.x) - (z.s - a.s + a.x) ** 2 / (z.i - a.i + 1) - ((z.st - a.st + a.i * a.x) - (a.i + z.i) / 2.0 * (z.s - a.s + a.x)) ** 2 / ((z.i - a.i + 1) * ((z.i - a.i + 1) ** 2 - 1) / 12.0), 0)) v
from pr a join pr z on a.cycle_id = z.cycle_id and a.i < z.i group by 1, 2),
c0 as (select i, v from e, m where j = n),
c1 as (select e.i, min(e.v + c.v) v, arg_min(e.j, e.v + c.v) s from e join c0 c on c.i = e.j group by 1),
c2 as (select e.i, min(e.v + c.v) v, arg_min(e.j, e.v + c.v) s from e join c1 c on c.i = e.j group by 1),
c3 as (select min(e.v + c.v) v, arg_min(e.j, e.v + c.v) s from e join c2 c on c.i = e.j where e.i = 1),
sp as (select c3.s s1, c2.s s2, c1.s s3, c3.v from c3 join c2 on c2.i = c3.s join c1 on c1.i = c2.s),
pc as (select 1 k, 1 a, s1 b from sp union all select 2, s1, s2 from sp union all select 3, s2, s3 from sp union all select 4, s3, n from sp, m)"""
_LINES = "ft as (select cycle_id, k, any_value(a) a, any_value(b) b, avg(x) mean, regr_slope(x, i) slope, sqrt(sum(u * u)) / count(*) u_mean, sqrt(sum(pow((i - (a + b) / 2.0) * u, 2))) / regr_sxx(x, i) u_slope from dn join pc on i between a and b group by 1, 2)"


def _up_sql(ctes: str, thin: str) -> str:
    """Squared errors of (cycle_id, i, y) of ``thin``, interpolated."""
    return f"""{_THIN}{ctes}, th as ({thin}),
up as (select cycle_id, t, sum({Q} * c * y) y from th join w using (i) group by 1, 2)
select cycle_id, count(*)::INT samples, round(ln(1 + sum(pow(x - y, 2))), 7) + 0.0 log_sse from dd join up using (cycle_id, t) group by 1"""


def oracle() -> dict[str, str]:
    drawn = "select cycle_id, i, mean + slope * (i - (a + b) / 2.0) y from (select dn.cycle_id, i, k, mean, slope, a, b, max(k) over (partition by dn.cycle_id, i) last from dn join ft on dn.cycle_id = ft.cycle_id and i between a and b) where k = last"
    return {
        "q83_thinned_cycles": f"{_THIN} select cycle_id, i::INT k, {R('x')} x, {R('u')} u from dn",
        "q84_thinned_breakpoints": f"""{_THIN}, {_CUT} select f.k::INT split, f.s::INT "at", ((f.s - 1) * {Q} + 1)::INT first_day, least(f.s * {Q}, (select n from b))::INT last_day, round(ln(1 + v), 7) + 0.0 log_error
from (select v, unnest([struct_pack(k := 1, s := s1), struct_pack(k := 2, s := s2), struct_pack(k := 3, s := s3)]) f from sp)""",
        "q85_thinned_pieces": f"""{_THIN}, {_CUT}, {_LINES} select cycle_id, ((k - 1) * 2 + f.p)::INT k, {R('f.v')} "value", {R('f.u')} u
from (select cycle_id, k, unnest([struct_pack(p := 1, v := mean, u := u_mean), struct_pack(p := 2, v := slope, u := u_slope)]) f from ft)""",
        "q86_pieces_drawn": _up_sql(f", {_CUT}, {_LINES}", drawn),
        "q87_components_drawn": _up_sql("", "select cycle_id, i, x y from dn"),
        "q88_raw_features": f"with {EV} select cycle_id, t::INT k, {R('x')} \"value\", {R('u')} u from ev",
    }
