"""Queries of fits with several coordinates, frozen inputs, averaged channels, optimal operators and couplings, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import couplings, special
from samplewright.operators import coordinates as Q
from samplewright.operators import fits as L
from samplewright.operators import matrices as M
from samplewright.operators import projections as J
from samplewright.operators import pvalues as V
from samplewright.operators import resampling as R
from samplewright.operators import selection as C

from .extended import _PR, QUANTITY, _pair
from .registry import _ER, _JK, _LI, N, _jack, _rounded, samples

QUERIES, ORACLES = {}, {}
#: Samples of the cells by line number, channel and order.
FEW = 20


def _add(name: str, query, sql: str | None = None, **digits: int) -> None:
    QUERIES[name] = lambda spark, d: _rounded(query(spark, d), **digits)
    if sql:
        ORACLES[name] = sql


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, k, s, v): mean prices of the first lines of orders, by line, half of the suppliers and sample."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 4")
    keys = [(F.col("l_linenumber") - 1).alias("t"), (F.col("l_suppkey") % 2).cast("int").alias("k"), (F.col("l_orderkey") % FEW).alias("s")]
    return lines.groupBy(*keys).agg((F.avg("l_extendedprice") / 30000).alias("v"))


_CE = f"ce AS (SELECT l_linenumber - 1 AS t, (l_suppkey % 2)::INT AS k, l_orderkey % {FEW} AS s, avg(l_extendedprice) / 30000 AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2, 3)"
_CJ = f"{_CE}, cj AS (SELECT t, k, s, (sum(v) OVER w - v) / (count(*) OVER w - 1) AS v FROM ce WINDOW w AS (PARTITION BY t, k))"


def _few_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jackknife samples of quantities by line number, as many as the cells have."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return R.jackknife(lines.groupBy((F.col("l_linenumber") - 1).alias("t"), (F.col("l_orderkey") % FEW).alias("s")).agg(F.avg(QUANTITY).alias("v")), ["t"])


# Three-point functions of (time, separation): the matrix element, with all else frozen, some of it by sample.
def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = R.jackknife(_cells(spark, sf_dir), ["t", "k"]).select("t", (4 + 2 * F.col("k")).alias("separation"), "s", "v")
    data = data.withColumn("v", F.col("v") * F.exp(-0.2 * F.col("t") - 0.3 * (F.col("separation") - F.col("t"))))
    series, function = Q.placed(data, ["t", "separation"], Q.three_point())
    sources = {"A_src": Q.Frozen(_few_quantities(spark, sf_dir), {"t": 0}, "x / 25"), "E_src": Q.Frozen(formula="2 / 10"), "A_snk": Q.Frozen(formula="1"), "E_snk": Q.Frozen(formula="0.3")}
    frozen = L.Options(frozen=dict.fromkeys(sources, 1.0))
    return L.fitted(series, function, 0, 7, "uncorrelated", frozen, frozen=Q.frozen_values(sources, series)).select("s", "M", "chi2", "dof")


_QF = f"qf AS (SELECT l_linenumber - 1 AS t, l_orderkey % {FEW} AS s, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), qj AS (SELECT s, (sum(q) OVER () - q) / {FEW - 1} / 25 AS a FROM qf WHERE t = 0)"
_add(
    "three_point_matrix", _three,
    f"WITH {_CJ}, {_QF}, d AS (SELECT t, k, s, v * exp(-0.2 * t - 0.3 * (4 + 2 * k - t)) AS v, exp(-0.2 * t - 0.3 * (4 + 2 * k - t)) / sqrt(2) AS g FROM cj), w AS (SELECT t, k, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM d GROUP BY t, k), m AS (SELECT s, sum(w * v * a * g) / sum(w * a * g * a * g) AS m FROM d JOIN w USING (t, k) JOIN qj USING (s) GROUP BY s) SELECT s, round(m, 6) AS M, round(sum(w * (v - m * a * g) ** 2), 4) AS chi2, 7::INT AS dof FROM d JOIN w USING (t, k) JOIN qj USING (s) JOIN m USING (s) GROUP BY s, m",
    M=6, chi2=4,
)


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates, the slope along one of them frozen."""
    series, function = Q.placed(R.jackknife(_cells(spark, sf_dir), ["t", "k"]), ["t", "k"], Q.linear(2))
    return L.fitted(series, function, 0, 7, "uncorrelated", L.Options(frozen={"a1": 0.01})).select("s", "a0", "a2", "chi2")


_add(
    "fit_plane", _planes,
    f"WITH {_CJ}, w AS (SELECT t, k, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM cj GROUP BY t, k), m AS (SELECT s, k, sum(w * (v - 0.01 * t)) / sum(w) AS m FROM cj JOIN w USING (t, k) GROUP BY s, k), c AS (SELECT s, sum(w * (v - 0.01 * t - m) ** 2) AS c FROM cj JOIN w USING (t, k) JOIN m USING (s, k) GROUP BY s) SELECT s, round(max(m) FILTER (k = 0), 6) AS a0, round(max(m) FILTER (k = 1) - max(m) FILTER (k = 0), 6) AS a2, round(any_value(c), 4) AS chi2 FROM m JOIN c USING (s) GROUP BY s",
    a0=6, a2=6, chi2=4,
)

# A ratio of series, then a constant.
_add(
    "ratio_constant", lambda spark, d: L.fitted(Q.ratio(_jack(spark, d), _jack(spark, d, QUANTITY), _jack(spark, d, QUANTITY), 6), L.polynomial(0), 2, 4, "uncorrelated").select("s", "a0", "chi2"),
    f"WITH {_JK}, r AS (SELECT a.t AS t, a.s AS s, a.v / (a.q * b.q) AS v FROM jk a JOIN jk b ON b.t = 6 - a.t AND a.s = b.s WHERE a.t BETWEEN 2 AND 4), w AS (SELECT t, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM r GROUP BY t), m AS (SELECT s, sum(w * v) / sum(w) AS m FROM r JOIN w USING (t) GROUP BY s) SELECT s, round(m, 6) AS a0, round(sum(w * (v - m) ** 2), 5) AS chi2 FROM r JOIN w USING (t) JOIN m USING (s) GROUP BY s, m", a0=6, chi2=5,
)

# Frozen values from other samples, by a formula.
_add(
    "fit_frozen_by_sample", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(1), 0, 6, "uncorrelated", L.Options(frozen={"a1": 0.0}), frozen=Q.frozen_values({"a1": Q.Frozen(_jack(spark, d, QUANTITY), {"t": 0}, "2*x - x^2/100")}, _jack(spark, d))).select("s", "a0", "a1", "chi2"),
    f"WITH {_ER}, z AS (SELECT s, 2 * q - q * q / 100 AS b FROM jk WHERE t = 0), m AS (SELECT s, any_value(b) AS b, sum(w * (v - b * t)) / sum(w) AS m FROM jk JOIN er USING (t) JOIN z USING (s) GROUP BY s) SELECT s, round(m, 3) AS a0, round(b, 6) AS a1, round(sum(w * (v - m - b * t) ** 2), 5) AS chi2 FROM jk JOIN er USING (t) JOIN m USING (s) GROUP BY s, m, b", a0=3, a1=6, chi2=5,
)

# Channels averaged before a fit whose samples have matrices of their own.
_AV = f"{_CE}, cw AS (SELECT t, k, (count(*) - 1) / var_pop(v) AS w FROM ce GROUP BY t, k), av AS (SELECT t, s, sum(w * v) / sum(w) AS v FROM ce JOIN cw USING (t, k) GROUP BY t, s)"
_add("averaged_channels", lambda spark, d: Q.averaged(_cells(spark, d), "k", ["t"]), f"WITH {_AV} SELECT t, s, round(v, 8) AS v FROM av", v=8)
_add(
    "fit_averaged_channels", lambda spark, d: L.fitted(Q.averaged(_cells(spark, d), "k", ["t"]), L.polynomial(0), 1, 2, "correlated").select("s", "a0", "chi2"),
    f"WITH {_AV}, xy AS (SELECT s, max(v) FILTER (t = 1) AS x, max(v) FILTER (t = 2) AS y FROM av GROUP BY s), k AS (SELECT o.s, avg(x) AS x, avg(y) AS y, var_pop(x) / {FEW - 2} AS a, covar_pop(x, y) / {FEW - 2} AS b, var_pop(y) / {FEW - 2} AS c FROM (SELECT s FROM xy) o JOIN xy r ON r.s <> o.s GROUP BY o.s), f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM k) SELECT s, round(m, 6) AS a0, round((c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b), 5) AS chi2 FROM f", a0=6, chi2=5,
)
_add(
    "channel_consistency", lambda spark, d: Q.consistency(R.jackknife(_cells(spark, d), ["t", "k"]), "k", ["t"]).select("t", "chi2", "dof"),
    f"WITH {_CJ}, m AS (SELECT t, k, avg(v) AS m, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM cj GROUP BY t, k), a AS (SELECT t, sum(w * m) / sum(w) AS a FROM m GROUP BY t) SELECT t, round(sum(w * (m - a) ** 2), 5) AS chi2, 1::INT AS dof FROM m JOIN a USING (t) GROUP BY t", chi2=5,
)


# The combination of two operators that couples to the first state only.
def _optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = _pair(spark, sf_dir)
    amplitudes = pair.where("t = 0").select(F.col("i").alias("n"), F.col("j").alias("i"), "s", "v")
    return J.projected(pair.where("t > 0"), J.optimal(amplitudes, scale=4.0))


_add(
    "state_projection", _optimal,
    f"WITH {_PR}, r AS (SELECT s, c / (a * c - b * b) / 2 AS r0, -b / (a * c - b * b) / 2 AS r1 FROM pr WHERE t = 0) SELECT t, s, round(a * r0 * r0 + 2 * b * r0 * r1 + c * r1 * r1, 7) AS v FROM pr JOIN r USING (s) WHERE t > 0", v=7,
)

# Couplings.
_B0, _B1 = couplings.betas(4)
_AS = f"(4 * pi() / {_B0!r} / l * (1 - {_B1 / _B0 / _B0!r} * ln(l) / l))"


def _couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    energies = _jack(spark, sf_dir).select("t", "s", (F.col("v") / 10000).alias("energy"))
    return energies.withColumn("coupling", couplings.running(F.col("energy"), F.lit(0.33), 4))


_add("running_coupling", lambda spark, d: _couplings(spark, d).select("t", "s", "coupling"), f"WITH {_JK}, l AS (SELECT t, s, 2 * ln(v / 10000 / 0.33) AS l FROM jk) SELECT t, s, round({_AS}, 9) AS coupling FROM l", coupling=9)
_add("matched_scale", lambda spark, d: couplings.matched_scale(_couplings(spark, d), "energy", "coupling", 4).select("t", "s", "scale"), f"WITH {_JK} SELECT t, s, 0.33::DOUBLE AS scale FROM jk", scale=5)


# Masses where the ratio of two hyperbolic functions has a closed form.
def _steep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jack(spark, sf_dir).withColumn("v", F.col("v") / 30000 * F.exp(-1.2 * F.col("t")))


_RATIO = f"WITH {_JK}, r AS (SELECT a.s, a.v / b.v * exp(1.2) AS r FROM jk a JOIN jk b ON a.t = 5 AND b.t = 6 AND a.s = b.s)"
_add("cosh_mass_closed", lambda spark, d: L.cosh_mass(_steep(spark, d).where("t >= 5"), 12).select("s", "v"), f"{_RATIO} SELECT s, round(acosh(r), 6) AS v FROM r", v=6)
_add("sinh_mass_closed", lambda spark, d: L.cosh_mass(_steep(spark, d).where("t >= 5"), 14, odd=True).select("s", "v"), f"{_RATIO} SELECT s, round(acosh(r / 2), 6) AS v FROM r", v=6)


# Distributions with a closed form: chi-square of 4, F of 2 and 10, T-square of 2 and 49 degrees of freedom.
def _distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _jack(spark, sf_dir).select("t", "s", (F.col("v") / 10000).alias("x"))
    of = lambda name, *numbers: special.distribution(name, F.col("x"), *map(F.lit, numbers)).alias(name)
    return x.select("t", "s", of("chi2_pdf", 4), of("chi2_cdf", 4), of("f_pdf", 2, 10), of("f_cdf", 2, 10), of("t2_pdf", 2, 49), of("t2_cdf", 2, 49), special.distribution("t2_range", F.lit(1), *(F.col("x"), F.lit(2), F.lit(49))).alias("t2_range"))


_add(
    "distributions", _distributions,
    f"WITH {_JK}, z AS (SELECT t, s, v / 10000 AS x FROM jk) SELECT t, s, round(x / 4 * exp(-x / 2), 9) AS chi2_pdf, round(1 - exp(-x / 2) * (1 + x / 2), 9) AS chi2_cdf, round(pow(1 + x / 5, -6), 9) AS f_pdf, round(1 - pow(1 + x / 5, -5), 9) AS f_cdf, round(24.0 / 49 * pow(1 + x / 49, -25), 9) AS t2_pdf, round(1 - pow(1 + x / 49, -24), 9) AS t2_cdf, round(pow(1 + 1.0 / 49, -24) - pow(1 + x / 49, -24), 9) AS t2_range FROM z",
    chi2_pdf=9, chi2_cdf=9, f_pdf=9, f_cdf=9, t2_pdf=9, t2_cdf=9, t2_range=9,
)

# Subtractions: bubbles of source and sink, and the coefficient that takes the vacuum out.
_add(
    "two_bubbles", lambda spark, d: C.less_vacuum(_jack(spark, d), _jack(spark, d, QUANTITY), _jack(spark, d).where("t = 1").drop("t")),
    f"WITH {_JK} SELECT a.t, a.s, round(a.v - a.q * b.v, 2) AS v FROM jk a JOIN jk b ON b.t = 1 AND a.s = b.s", v=2,
)


def _less_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, quantity = _jack(spark, sf_dir), _jack(spark, sf_dir, QUANTITY)
    later = lambda df: df.where("t > 0").withColumn("t", F.col("t") - 1)
    early = lambda df: df.where("t < 6")
    return C.less_mixing(early(price), C.mixing(later(price), later(quantity)), early(quantity), 0.5)


_add("less_mixing", _less_mixing, f"WITH {_JK} SELECT a.t, a.s, round(a.v - 0.5 * b.v / b.q * a.q, 3) AS v FROM jk a JOIN jk b ON b.t = a.t + 1 AND a.s = b.s", v=3)
# Autocorrelation about means from elsewhere.
_add(
    "autocorrelation_about_means", lambda spark, d: R.bootstrap_autocorrelation(samples(spark, d), ["t"], 3, 4, 10, N, means=_jack(spark, d, QUANTITY).where("s = 0").select("t", (F.col("v") * 1400).alias("v"))).where("s = -1").select("t", "lag", "v"),
    f"WITH {_JK}, m AS (SELECT t, q * 1400 AS m FROM jk WHERE s = 0), p AS (SELECT a.t, g::INT AS lag, a.s // 4 AS b, avg((a.v - m) * (c.v - m)) AS p, count(*) AS n FROM li a JOIN range(4) r(g) ON TRUE JOIN li c ON c.t = a.t AND c.s = a.s + g JOIN m ON m.t = a.t WHERE a.s < 47 GROUP BY a.t, g, a.s // 4 HAVING count(*) = 4), l AS (SELECT t, lag, avg(p) AS p FROM p GROUP BY t, lag) SELECT t, lag, round(l.p / z.p, 8) AS v FROM l JOIN (SELECT t, p FROM l WHERE lag = 0) z USING (t)", v=8,
)


# Seven operators in the basis of ten, and back again.
def _ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = samples(spark, sf_dir).select(F.col("t").alias("j"), F.lit(0).alias("t"), "s", "v")
    return M.in_basis(seven, M.TEN_FROM_SEVEN)


_MATRIX = ", ".join(f"({i}, {j}, {c!r}::DOUBLE)" for i, row in enumerate(M.TEN_FROM_SEVEN) for j, c in enumerate(row) if c)
_add("basis_of_ten", lambda spark, d: _ten(spark, d).select("i", "s", (F.col("v") * F.exp(F.lit(-0.1))).alias("v")), f"WITH {_LI}, b(i, j, c) AS (VALUES {_MATRIX}) SELECT i, s, round(sum(c * v) * exp(-0.1), 4) AS v FROM li JOIN b ON t = j GROUP BY i, s", v=4)
_add("basis_of_seven", lambda spark, d: M.in_basis(_ten(spark, d).withColumnRenamed("i", "j"), M.SEVEN_FROM_TEN).select("i", "s", (F.col("v") * F.exp(F.lit(-0.1))).alias("v")), f"WITH {_LI} SELECT t::INT AS i, s, round(v * exp(-0.1), 4) AS v FROM li", v=4)

# The fit to the means alone, with both tails; of two degrees of freedom they have a closed form.
_add(
    "fit_central", lambda spark, d: V.central(samples(spark, d), L.polynomial(0), 2, 4, "uncorrelated"),
    f"WITH {_LI}, m AS (SELECT t, avg(v) AS m, (count(*) - 1) / var_pop(v) AS w FROM li WHERE t BETWEEN 2 AND 4 GROUP BY t), a AS (SELECT sum(w * m) / sum(w) AS a FROM m), c AS (SELECT any_value(a) AS a, sum(w * (m - a) ** 2) AS c FROM m, a) SELECT round(a, 3) AS a0, round(c, 5) AS chi2, 2::INT AS dof, true AS converged, round(exp(-c / 2), 7) AS p, round(pow(1 + c / 49, -24), 7) AS p_t2 FROM c", a0=3, chi2=5, p=7, p_t2=7,
)
