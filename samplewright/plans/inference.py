"""Queries of p-values by resampling, covariance strategies, other minimisers, roots and further eigenvalue problems, with DuckDB SQL.

Fits of a constant to two points, of a line, and of an exponential to two points have closed forms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.operators import eigen as G
from samplewright.operators import fits as L
from samplewright.operators import matrices as M
from samplewright.operators import pvalues as V
from samplewright.operators import resampling as R
from samplewright.operators import roots as Z

from .extended import _DC, _PR, _decaying, _pair
from .extended import ORACLES as _EXTENDED
from .registry import _JK, _LI, BLOCK, BOOTS, N, _boots, _boots_sql, _jack, _rounded, samples

QUERIES, ORACLES = {}, {}


def _add(name: str, query, sql: str | None = None, **digits: int) -> None:
    QUERIES[name] = lambda spark, d: _rounded(query(spark, d), **digits)
    if sql:
        ORACLES[name] = sql


def _table(spark: SparkSession, size: int = 1) -> DataFrame:
    return R.resample_table(spark, N, BOOTS, size)


# P-values: boots of the raw samples, each with its own covariance, moved to the central fit and fitted again.
_RAW = f"{_boots_sql(1)}, br AS (SELECT b, t, avg(v) AS m, (count(*) - 1) / var_pop(v) AS w FROM li JOIN tb USING (s) GROUP BY b, t UNION ALL SELECT -1, t, avg(v), (count(*) - 1) / var_pop(v) FROM li GROUP BY t)"
_RECENTRED = f"{_RAW}, ce AS (SELECT sum(w * m) / sum(w) AS a FROM br WHERE b = -1), mv AS (SELECT b, t, w, CASE b WHEN -1 THEN m ELSE m + a - c END AS m FROM br JOIN (SELECT t, m AS c FROM br WHERE b = -1) USING (t), ce), fa AS (SELECT b, sum(w * m) / sum(w) AS a FROM mv GROUP BY b), q2 AS (SELECT b AS s, any_value(a) AS a0, sum(w * (m - a) ** 2) AS chi2 FROM mv JOIN fa USING (b) GROUP BY b)"
_PLACED = "SELECT round((n - k) / n, 9) AS p FROM (SELECT count(*) AS n, arg_min(r, (abs(chi2 - c), r)) AS k FROM (SELECT chi2, row_number() OVER (ORDER BY chi2) AS r FROM q2 WHERE s >= 0), (SELECT chi2 AS c FROM q2 WHERE s = -1))"


def _q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.resampled_q2(samples(spark, sf_dir), _table(spark), L.polynomial(0), 0, 6, "uncorrelated")


_add("resampled_q2", lambda spark, d: _q2(spark, d).select("s", "a0", "chi2", "dof"), f"{_RECENTRED} SELECT s, round(a0, 3) AS a0, round(chi2, 5) AS chi2, 6::INT AS dof FROM q2", a0=3, chi2=5)
_add("resampled_p_value", lambda spark, d: V.placed(_q2(spark, d)), f"{_RECENTRED} {_PLACED}", p=9)
# Two points: of bins of five, of single samples, and correlations of these with errors of those.
_DRAWN = f"{_boots_sql(BLOCK)}, dr AS (SELECT b, id * 5 + k AS pos, d * 5 + k AS s FROM (SELECT id // 10 AS b, id % 10 AS id, {R.draw('id', N // BLOCK, 1234)} AS d FROM range({BOOTS * (N // BLOCK)}) r(id)), range(5) z(k) UNION ALL SELECT -1, s, s FROM range(50) r(s)), rw AS (SELECT b, pos, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM dr JOIN li USING (s) WHERE t IN (2, 3) GROUP BY b, pos), bn AS (SELECT b, pos // 5 AS pos, avg(x) AS x, avg(y) AS y FROM rw GROUP BY b, pos // 5), cs AS (SELECT b, var_pop(x) / 49 AS p, covar_pop(x, y) / 49 AS q, var_pop(y) / 49 AS r FROM rw GROUP BY b), cb AS (SELECT b, var_pop(x) / 9 AS a, covar_pop(x, y) / 9 AS b0, var_pop(y) / 9 AS c, avg(x) AS x, avg(y) AS y FROM bn GROUP BY b)"


def _pair_sql(off: str, a: str = "a", c: str = "c") -> str:
    """Chi-squares of a constant fitted to two recentred points."""
    return f"{_DRAWN}, k AS (SELECT cb.b AS s, x, y, {a} AS a, {off} AS b, {c} AS c FROM cb JOIN cs ON cs.b = cb.b), f0 AS (SELECT x AS x0, y AS y0, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m0 FROM k WHERE s = -1), mv AS (SELECT s, a, b, c, CASE s WHEN -1 THEN x ELSE x + m0 - x0 END AS x, CASE s WHEN -1 THEN y ELSE y + m0 - y0 END AS y FROM k, f0), f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM mv), q2 AS (SELECT s, m AS a0, (c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b) AS chi2 FROM f) SELECT s, round(a0, 2) AS a0, round(chi2, 4) AS chi2 FROM q2"


for _name, _sql in {"frozen": _pair_sql("b0"), "block": _pair_sql("q", "p", "r"), "hybrid": _pair_sql("q * sqrt(a * c / p / r)")}.items():
    _add(f"resampled_pair_{_name}", lambda spark, d, strategy=_name: V.resampled_q2(samples(spark, d), _table(spark, BLOCK), L.polynomial(0), 2, 3, strategy, BLOCK).select("s", "a0", "chi2"), _sql, a0=2, chi2=4)

# Fits whose samples have matrices of their own.
_BLOCKS = f"{_LI}, xy AS (SELECT s, s // 5 AS k, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM li GROUP BY s), bl AS (SELECT o.k AS s, var_pop(x) / 44 AS p, covar_pop(x, y) / 44 AS q, var_pop(y) / 44 AS r FROM xy JOIN (SELECT DISTINCT k FROM xy) o ON o.k <> xy.k GROUP BY o.k), bn AS (SELECT k, avg(x) AS x, avg(y) AS y FROM xy GROUP BY k), bj AS (SELECT o.k AS s, avg(b.x) AS x, avg(b.y) AS y, var_pop(b.x) / 8 AS a, covar_pop(b.x, b.y) / 8 AS b0, var_pop(b.y) / 8 AS c FROM bn b JOIN bn o ON o.k <> b.k GROUP BY o.k)"
_TWO = "f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM k) SELECT s, round(m, 2) AS a0, round((c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b), 4) AS chi2 FROM f"


def _own(strategy: str, **more):
    return lambda spark, d: L.fitted(samples(spark, d), L.polynomial(0), 2, 3, strategy, **more).select("s", "a0", "chi2")


_add("fit_binned_pair", _own("correlated", size=BLOCK), f"WITH {_BLOCKS}, k AS (SELECT s, x, y, a, b0 AS b, c FROM bj), {_TWO}", a0=2, chi2=4)
_add("fit_block_pair", _own("block", size=BLOCK), f"WITH {_BLOCKS}, k AS (SELECT s, x, y, p AS a, q AS b, r AS c FROM bj JOIN bl USING (s)), {_TWO}", a0=2, chi2=4)
_add("fit_hybrid_pair", _own("hybrid", size=BLOCK), f"WITH {_BLOCKS}, k AS (SELECT s, x, y, a, q * sqrt(a * c / p / r) AS b, c FROM bj JOIN bl USING (s)), {_TWO}", a0=2, chi2=4)
_DJ = f"WITH {_DC}, d2 AS (SELECT s, max(c) FILTER (t_i = 2 AND t_j = 2) * 48 AS a, max(c) FILTER (t_i = 2 AND t_j = 3) * 48 AS b0, max(c) FILTER (t_i = 3 AND t_j = 3) * 48 AS c FROM dc GROUP BY s), jk AS (SELECT t, s, (sum(v) OVER (PARTITION BY t) - v) / 49 AS v FROM li), xy AS (SELECT s, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM jk GROUP BY s), co AS (SELECT s, b0 / sqrt(a * c) AS r FROM d2)"
_add(
    "fit_shrunk_pair", _own("correlated", shrink=True),
    f"{_DJ}, sh AS (SELECT 2 * 49 * var_pop(r) / (2 + 2 * avg(r * r)) AS l FROM co), k AS (SELECT s, x, y, a, (1 - l) * r * sqrt(a * c) AS b, c FROM d2 JOIN co USING (s) JOIN xy USING (s), sh), {_TWO}", a0=2, chi2=4,
)
# Of two points the eigenvalues are 1 + r and 1 - r: with a cutoff of 1 only the larger one counts, with its vector (1, sign of r).
_add(
    "fit_cut_pair", _own("correlated", cutoff=1.0),
    f"{_DJ}, k AS (SELECT s, x / sqrt(a) AS u, y / sqrt(c) AS w, 1 / sqrt(a) AS g, 1 / sqrt(c) AS h, abs(r) AS e, sign(r) AS z FROM d2 JOIN co USING (s) JOIN xy USING (s)) SELECT s, round((u + z * w) / (g + z * h), 0) AS a0, 0.0::DOUBLE AS chi2 FROM k", a0=0, chi2=2,
)
_add(
    "fit_boot_pair", lambda spark, d: L.fitted(samples(spark, d), L.polynomial(0), 2, 3, "correlated", table=_table(spark)).select("s", "a0", "chi2"),
    f"{_boots_sql(1)}, xy AS (SELECT s, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM li GROUP BY s), k AS (SELECT b AS s, avg(x) AS x, avg(y) AS y, var_pop(x) / 49 AS a, covar_pop(x, y) / 49 AS b, var_pop(y) / 49 AS c FROM xy JOIN tb USING (s) GROUP BY b UNION ALL SELECT -1, avg(x), avg(y), var_pop(x) / 49, covar_pop(x, y) / 49, var_pop(y) / 49 FROM xy), {_TWO}", a0=2, chi2=4,
)


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    jack = _jack(spark, sf_dir)
    return L.fitted(jack, L.polynomial(0), 2, 3, imported=M.normalised(R.covariance(jack, "t", "jackknife"))).select("s", "a0", "chi2")


_add("fit_imported_pair", _imported, _EXTENDED["fit_correlated_pair"], a0=3, chi2=5)

# Fits with a closed form though they aren't linear, and trust regions.
_EXP = f"WITH {_JK}, y AS (SELECT s, max(v) FILTER (t = 2) / 30000 * exp(-0.8) AS x, max(v) FILTER (t = 3) / 30000 * exp(-1.2) AS y FROM jk GROUP BY s) SELECT s, round(x * exp(2 * ln(x / y)), 5) AS A, round(ln(x / y), 6) AS E FROM y"
for _name in ("damped", "lm", "lmaccel", "dogleg", "ddogleg", "subspace"):
    _add(f"fit_exponential_pair_{_name}", lambda spark, d, m=_name: L.fitted(_decaying(spark, d), L.exponential(), 2, 3, minimizer=m).select("s", "A", "E"), _EXP, A=5, E=6)
_add("fit_line_dogleg", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(1), 0, 6, "uncorrelated", minimizer="dogleg").select("s", "a0", "a1", "chi2", "dof", "converged"), _EXTENDED["fit_line"], a0=2, a1=3, chi2=5)

# Roots.
_add(
    "root_of_exponential", lambda spark, d: Z.solved(_decaying(spark, d).select("t", "s", F.col("v").alias("y")), lambda x, y: np.exp(-x) - y, ["y"], {"v": 0.3}, 1e-9).select("t", "s", "v"),
    f"WITH {_JK} SELECT t, s, round(-ln(v / 30000 * exp(-0.4 * t)), 7) AS v FROM jk", v=7,
)


def _two_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude and energy of an exponential through the points at 2 and 3."""
    y = _decaying(spark, sf_dir).groupBy("s").agg(F.max(F.when(F.col("t") == 2, F.col("v"))).alias("y2"), F.max(F.when(F.col("t") == 3, F.col("v"))).alias("y3"))
    equations = lambda x, y: np.stack([x[:, 0] * np.exp(-k * x[:, 1]) - y[:, k - 2] for k in (2, 3)], axis=1)
    return Z.solved(y, equations, ["y2", "y3"], {"A": 1.0, "E": 0.3}, 1e-9).select("s", "A", "E")


_add("roots_of_two_equations", _two_equations, _EXP, A=5, E=6)

# Eigenvalue problems: matrices less those at a fixed time, and matrices without symmetry.
_FALL = "fl AS (SELECT t, s, a * exp(-2 * t) AS a, b * exp(-2 * t) AS b, c * exp(-2 * t) AS c FROM pr)"


def _falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(spark, sf_dir).withColumn("v", F.col("v") * F.exp(-2.0 * F.col("t")))


_add(
    "subtracted_energies", lambda spark, d: G.subtracted_energies(G.sweep(G.less_time(_falling(spark, d), 2), 0, 0, 1), 2).select("s", F.col("n").cast("long").alias("n"), "v"),
    f"WITH {_PR}, {_FALL}, su AS (SELECT f.t, f.s, f.a - g.a AS a, f.b - g.b AS b, f.c - g.c AS c FROM fl f JOIN fl g ON g.t = 2 AND f.s = g.s), k AS (SELECT u.s, u.a * u.c - u.b * u.b AS p, w.a * u.c + u.a * w.c - 2 * w.b * u.b AS q, w.a * w.c - w.b * w.b AS r FROM su u JOIN su w ON u.s = w.s AND u.t = 0 AND w.t = 1), l AS (SELECT s, n, (q + (1 - 2 * n) * sqrt(q * q - 4 * p * r)) / (2 * p) AS l FROM k, range(2) z(n)) SELECT s, n, round(ln((1 - l) / l), 5) AS v FROM l", v=5,
)


def _turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices without symmetry: the entry below the diagonal has its sign changed at odd times."""
    return _pair(spark, sf_dir).withColumn("v", F.when((F.col("i") > F.col("j")) & (F.col("t") % 2 == 1), -F.col("v")).otherwise(F.col("v")))


_TURN = f"WITH {_PR}, m AS (SELECT t, s, a, b, CASE t % 2 WHEN 1 THEN -b ELSE b END AS b2, c FROM pr), g AS (SELECT u.t AS t0, w.t AS t, u.s, u.a * u.c - u.b * u.b2 AS p, w.a * u.c + u.a * w.c - w.b * u.b2 - w.b2 * u.b AS q, w.a * w.c - w.b * w.b2 AS r FROM m u JOIN m w ON u.s = w.s AND u.t <= 1 AND w.t > u.t AND w.t <= 4), e AS (SELECT t0, t, s, q / (2 * p) AS h, (q * q - 4 * p * r) / (4 * p * p) AS d FROM g), v AS (SELECT t0, t, s, k, CASE WHEN d >= 0 THEN h + k * sqrt(d) ELSE h END AS re, CASE WHEN d < 0 THEN k * sqrt(-d) ELSE 0 END AS im FROM e, (VALUES (1), (-1)) z(k))"
_add(
    "nonsymmetric_eigenvalues", lambda spark, d: G.sweep(_turning(spark, d), 0, 1, 4, general=True).select("t0", "t", "s", F.col("n").cast("long").alias("n"), "value", "imaginary"),
    f"{_TURN} SELECT t0, t, s, row_number() OVER (PARTITION BY t0, t, s ORDER BY round(re * re + im * im, 12) DESC, im DESC) - 1 AS n, round(re, 6) + 0.0 AS value, round(im, 6) + 0.0 AS imaginary FROM v", value=6, imaginary=6,
)
_add(
    "nonsymmetric_matrices", lambda spark, d: G.eigenvalues(_turning(spark, d), ["t", "s"], general=True).groupBy("t", "s").agg(F.sum("value").alias("trace"), F.sum("imaginary").alias("turn"), (F.max("residual") < 1e-9).alias("solved")),
    f"WITH {_PR} SELECT t, s, round(a + c, 6) AS trace, 0.0::DOUBLE AS turn, true AS solved FROM pr", trace=6, turn=6,
)

# Refits of boots, of which only linear ones have a closed form.
_BW = f"{_boots_sql(1)}, w AS (SELECT t, 1 / var_pop(v) AS w, avg(v) AS m FROM bt WHERE s >= 0 GROUP BY t)"
ORACLES["fit_boots"] = f"{_BW}, m AS (SELECT s, sum(w * t) / sum(w) AS x, sum(w * v) / sum(w) AS y FROM bt JOIN w USING (t) GROUP BY s), f AS (SELECT s, x, y, sum(w * (t - x) * (v - y)) / sum(w * (t - x) ** 2) AS b FROM bt JOIN w USING (t) JOIN m USING (s) GROUP BY s, x, y) SELECT s, round(y - b * x, 2) AS a0, round(b, 3) AS a1, round(sum(w * (v - (y - b * x) - b * t) ** 2), 4) AS chi2, 5::INT AS dof, true AS converged FROM bt JOIN w USING (t) JOIN f USING (s) GROUP BY s, x, y, b"
ORACLES["refitted_boots_p_value"] = f"{_BW}, c0 AS (SELECT sum(w * v) / sum(w) AS a FROM bt JOIN w USING (t) WHERE s = -1), q0 AS (SELECT sum(w * (v - a) ** 2) AS q FROM bt JOIN w USING (t), c0 WHERE s = -1), mv AS (SELECT t, s, w, v - m + a AS v FROM bt JOIN w USING (t), c0 WHERE s >= 0), f AS (SELECT s, sum(w * v) / sum(w) AS a FROM mv GROUP BY s), r AS (SELECT s, sum(w * (v - a) ** 2) AS q FROM mv JOIN f USING (s) GROUP BY s) SELECT round(avg((r.q > q0.q)::INT::DOUBLE), 6) AS p FROM r, q0"
