"""Queries of formulas, selections, matrices, super-ensembles, eigenvalues and fits on the driver tables, with DuckDB SQL.

SQL is left out where there is no closed form (exponential and cosh fits, fits
of boots); tests hold those against plain numpy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.functions import expressions as X
from samplewright.functions import printing as P
from samplewright.functions import special
from samplewright.operators import eigen as G
from samplewright.operators import fits as L
from samplewright.operators import matrices as M
from samplewright.operators import resampling as R
from samplewright.operators import selection as C
from samplewright.operators import series as S
from samplewright.operators import superensembles as U
from samplewright.sources import ensembles as Z

from .registry import _ER, _JK, _LI, BOOTS, N, T, _boots, _events, _jack, _rounded, samples
from .registry import ORACLES as _REGISTERED

QUANTITY = "l_quantity"
QUERIES, ORACLES = {}, {}


def _add(name: str, query, sql: str | None = None, **digits: int) -> None:
    QUERIES[name] = lambda spark, d: _rounded(query(spark, d), **digits)
    if sql:
        ORACLES[name] = sql


def _both(f):
    """A query of the samples of two quantities."""
    return lambda spark, d: f(samples(spark, d), samples(spark, d, QUANTITY))


def _both_jack(f):
    return lambda spark, d: f(_jack(spark, d), _jack(spark, d, QUANTITY))


# Formulas and printed results.
_add("formula_of_raw", lambda spark, d: X.applied(samples(spark, d), "x^2/3 - sqrt(x) + -2^2"), f"WITH {_LI} SELECT t, s, round(v * v / 3 - sqrt(v) - 4, 2) AS v FROM li", v=2)
_add(
    "formula_of_quantities", _both_jack(lambda a, b: X.calculated("-a^2/(b + 1) + log10(a)*exp(-b/100) - pow(b, 3)/a", {"a": a, "b": b}, ["t", "s"])),
    f"WITH {_JK} SELECT t, s, round(-(v * v) / (q + 1) + log10(v) * exp(-q / 100) - pow(q, 3) / v, 2) AS v FROM jk", v=2,
)
_PRINT = f"WITH {_JK}, p AS (SELECT t, avg(v) / 1000 AS c, sqrt((count(*) - 1) * var_pop(v)) / 1000 AS e FROM jk GROUP BY t), x AS (SELECT *, floor(log10(c))::INT AS k, floor(log10(e))::INT AS l FROM p)"
_add(
    "printed", lambda spark, d: R.jackknife_error(_jack(spark, d), T).select("t", P.published(F.col("mean") / 1000, F.col("error") / 1000, 2, "error").alias("text"), P.published_value(F.col("mean") / 1000, 5).alias("value")),
    f"{_PRINT} SELECT t, ' ' || format('{{:.' || (1 - l) || 'f}}', c) || '(' || CASE WHEN e < 1 THEN ltrim(replace(format('{{:.' || (1 - l) || 'f}}', e), '.', ''), '0') ELSE format('{{:.' || (1 - l) || 'f}}', e) END || ')' AS text, ' ' || format('{{:.' || (4 - k) || 'f}}', c) AS value FROM x",
)

# Selections.
_add("x_range", lambda spark, d: C.in_x_range(samples(spark, d), 2, 4), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li WHERE t BETWEEN 2 AND 4", v=4)
_add("x_range_inverted", lambda spark, d: C.in_x_range(samples(spark, d), 2, 4, invert=True), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li WHERE t NOT BETWEEN 2 AND 4", v=4)
_add("positions", lambda spark, d: C.by_position(samples(spark, d).where("t <> 1"), 1, 3), f"WITH {_LI}, k AS (SELECT t, s, v, dense_rank() OVER (ORDER BY t) - 1 AS k FROM li WHERE t <> 1) SELECT t, s, round(v, 4) AS v FROM k WHERE k BETWEEN 1 AND 3", v=4)
_add("odd_times", lambda spark, d: C.at_times(samples(spark, d), "odd"), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li WHERE t % 2 = 1", v=4)
_add("late_times", lambda spark, d: C.at_times(samples(spark, d), "greater", 3), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li WHERE t > 3", v=4)
_add(
    # The bound falls with the number of lines, as the errors do, so that some times pass and some don't.
    "relative_error_filter", lambda spark, d: C.with_relative_error(_jack(spark, d), 1.5 / spark.read.parquet(f"{d}/lineitem.parquet").count() ** 0.5),
    f"WITH {_JK} SELECT t, s, round(v, 4) AS v FROM jk WHERE t IN (SELECT t FROM jk GROUP BY t HAVING sqrt((count(*) - 1) * var_pop(v)) / abs(avg(v)) <= 1.5 / sqrt((SELECT count(*) FROM lineitem)))", v=4,
)
_add("pruned_points", lambda spark, d: C.without_points(samples(spark, d), spark.range(2, 5, 2).select(F.col("id").cast("int").alias("t"))), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li WHERE t NOT IN (2, 4)", v=4)
_add("missing_samples", lambda spark, d: C.missing_samples(samples(spark, d).where("(t + s) % 7 <> 0"), N), f"WITH {_LI} SELECT t, s FROM li WHERE (t + s) % 7 = 0")
_add("reversed_points", lambda spark, d: C.reversed_points(samples(spark, d)), f"WITH {_LI} SELECT 6 - t AS t, s, round(v, 4) AS v FROM li", v=4)
_add("appended_series", _both(C.appended), f"WITH {_LI} SELECT t, s, round(v, 4) AS v FROM li UNION ALL SELECT t + 7, s, round(q, 4) FROM li", v=4)


def _typed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Users with a large value in events of the first (min) or the last (max) type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = events.agg(getattr(F, kind)("event_type").alias("event_type"))
    return events.where("value > 100").join(F.broadcast(one), "event_type", "left_semi").select("user_id").distinct()


for _how, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("complement", "EXCEPT")):
    _side = "SELECT user_id FROM events WHERE value > 100 AND event_type = (SELECT {0}(event_type) FROM events)"
    _add(f"set_{_how}", lambda spark, d, how=_how: C.sets(_typed(spark, d, "min"), _typed(spark, d, "max"), how), f"{_side.format('min')} {_op} {_side.format('max')}")


def _sizes(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(where).groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("size"))


_add("layout_lacks", lambda spark, d: C.lacking(_sizes(spark, d, "user_id % 5 <> 0 OR event_type < 'm'"), _sizes(spark, d)), "SELECT event_type AS tag, count(*) AS size FROM events GROUP BY event_type HAVING count(*) <> count(*) FILTER (user_id % 5 <> 0 OR event_type < 'm')")
_add(
    "layout_remapped", lambda spark, d: C.remapped(_sizes(spark, d), _sizes(spark, d).where("tag < 'm'").select("tag", F.upper("tag").alias("new_tag"))),
    "SELECT CASE WHEN event_type < 'm' THEN upper(event_type) ELSE event_type END AS tag, count(*) AS size FROM events GROUP BY event_type",
)


def _complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex samples: the price, and the quantity at odd times as imaginary part."""
    both = R.matched(samples(spark, sf_dir), samples(spark, sf_dir, QUANTITY), ["t", "s"])
    return both.select("t", "s", F.struct(F.col("v").alias("re"), F.when(F.col("t") % 2 == 1, F.col("_w")).otherwise(0.0).alias("im")).alias("v"))


_add("imaginary_part", lambda spark, d: C.real_part(_complex(spark, d), "im"), f"WITH {_LI} SELECT t, s, round(CASE WHEN t % 2 = 1 THEN q ELSE 0 END, 6) AS v FROM li", v=6)
_add("is_complex", lambda spark, d: C.is_complex(_complex(spark, d), T), "SELECT DISTINCT l_linenumber - 1 AS t, l_linenumber % 2 = 0 AS complex FROM lineitem")
_add("struct_member", lambda spark, d: C.member(C.member(_complex(spark, d), "re", F.col("v.re") + F.col("v.im")), "re"), f"WITH {_LI} SELECT t, s, round(v + CASE WHEN t % 2 = 1 THEN q ELSE 0 END, 4) AS v FROM li", v=4)
_add(
    "weighted_by_key", lambda spark, d: C.weighted_by_key(_jack(spark, d).withColumn("k", F.col("t") % 2), ["k"], "t", F.col("t") > 0),
    f"WITH {_ER} SELECT t % 2 AS k, s, round(sum(w * v) / sum(w), 4) AS v FROM jk JOIN er USING (t) WHERE t > 0 GROUP BY t % 2, s", v=4,
)
_add(
    "front_and_back", lambda spark, d: C.halves(samples(spark, d), T, N),
    f"WITH {_LI} SELECT t, CASE WHEN s < 25 THEN 'front' ELSE 'back' END AS half, round(avg(v), 4) AS mean, round(stddev_pop(v) / sqrt(count(*) - 1), 4) AS error FROM li GROUP BY 1, 2", mean=4, error=4,
)
_add("expanded_jackknife", lambda spark, d: C.expanded(_jack(spark, d), T, N, 8), f"WITH {_JK} SELECT t, s, round(v, 4) AS v FROM jk UNION ALL SELECT t, 50 + k, round(avg(v), 4) FROM jk, range(8) r(k) GROUP BY t, k", v=4)


def _moving(spark: SparkSession, sf_dir: str, value: str, key: str = "p") -> DataFrame:
    """Order lines by momentum (or kind) and sample."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy((F.col("l_suppkey") % 4).cast("int").alias(key), (F.col("l_linenumber") - 1).alias("t"), (F.col("l_orderkey") % 10).alias("s")).agg(F.avg(value).alias("v"))


_MV = "mv AS (SELECT (l_suppkey % 4)::INT AS p, l_linenumber - 1 AS t, l_orderkey % 10 AS s, avg(l_extendedprice) AS v, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)"
_add(
    "momentum_product", lambda spark, d: C.momentum_product(_moving(spark, d, "l_extendedprice"), _moving(spark, d, QUANTITY), spark.createDataFrame([(0, 1, 0.5), (1, 0, -1.0), (2, 2, 2.0)], "p int, q int, weight double")),
    f"WITH {_MV}, w AS (SELECT * FROM (VALUES (0, 1, 0.5::DOUBLE), (1, 0, -1), (2, 2, 2)) w(a, b, w)) SELECT x.t, x.s, round(sum(w * x.v * y.q), 1) AS v FROM w JOIN mv x ON x.p = a JOIN mv y ON y.p = b AND y.t = x.t AND y.s = x.s GROUP BY x.t, x.s", v=1,
)
_add(
    "contracted_diagrams", lambda spark, d: C.contracted(_moving(spark, d, "l_extendedprice", "k").withColumn("kind", F.expr("substr('CDRV', k + 1, 1)")), {"C": 1, "D": 2, "R": -6, "V": 3}),
    f"WITH {_MV} SELECT t, s, round(sum(v * [1, 2, -6, 3][p + 1]), 3) AS v FROM mv GROUP BY t, s", v=3,
)
_add(
    "less_vacuum", lambda spark, d: C.less_vacuum(X.applied(_jack(spark, d), "x^2"), _jack(spark, d).where("t = 0").select("s", "v")),
    f"WITH {_JK} SELECT a.t, a.s, round(a.v * a.v - b.v * b.v, 1) AS v FROM jk a JOIN jk b ON b.t = 0 AND b.s = a.s", v=1,
)
_add(
    "consistency", lambda spark, d: C.consistency(_jack(spark, d), X.applied(_jack(spark, d, QUANTITY), "x * 1400")),
    f"WITH {_JK}, x AS (SELECT t, avg(v - q * 1400) AS m, sqrt((count(*) - 1) * var_pop(v - q * 1400)) AS e FROM jk GROUP BY t) SELECT t, round(m, 3) AS difference, round(e, 3) AS error, round(abs(m) / e, 6) AS deviations FROM x",
    difference=3, error=3, deviations=6,
)


# Matrices of samples.
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cell = [(F.col("l_suppkey") % 3).cast("int").alias("i"), (F.col("l_partkey") % 3).cast("int").alias("j"), (F.col("l_orderkey") % 20).alias("s")]
    return lines.groupBy(*cell).agg((F.avg("l_extendedprice") / 10000).alias("v"))


_MX = "mx AS (SELECT (l_suppkey % 3)::INT AS i, (l_partkey % 3)::INT AS j, l_orderkey % 20 AS s, avg(l_extendedprice) / 10000 AS v FROM lineitem GROUP BY 1, 2, 3)"
_BASIS = ((0.2, 0.2, -0.6), (0.0, 1.0, 0.0), (1.0, -1.0, 0.5))
_add("matrix_product", lambda spark, d: M.multiplied(_matrix(spark, d), M.transposed(_matrix(spark, d))), f"WITH {_MX} SELECT a.i, b.i AS j, a.s, round(sum(a.v * b.v), 6) AS v FROM mx a JOIN mx b ON a.j = b.j AND a.s = b.s GROUP BY a.i, b.i, a.s", v=6)
_add("matrix_times_vector", lambda spark, d: M.applied_to(_matrix(spark, d), _matrix(spark, d).where("j = 1").drop("j")), f"WITH {_MX} SELECT a.i, a.s, round(sum(a.v * b.v), 6) AS v FROM mx a JOIN mx b ON b.i = a.j AND b.j = 1 AND a.s = b.s GROUP BY a.i, a.s", v=6)
_add("submatrix", lambda spark, d: M.submatrix(_matrix(spark, d), [2, 0], [1, 2]), f"WITH {_MX} SELECT CASE i WHEN 2 THEN 0 ELSE 1 END AS i, j - 1 AS j, s, round(v, 6) AS v FROM mx WHERE i IN (0, 2) AND j IN (1, 2)", v=6)
_add("matrix_contraction", lambda spark, d: M.contracted(_matrix(spark, d), M.transposed(_matrix(spark, d))), f"WITH {_MX} SELECT a.s, round(sum(a.v * b.v), 6) AS v FROM mx a JOIN mx b ON a.i = b.j AND a.j = b.i AND a.s = b.s GROUP BY a.s", v=6)
_add(
    "matrix_norms", lambda spark, d: M.norms(_matrix(spark, d)),
    f"WITH {_MX}, c AS (SELECT s, j, sum(abs(v)) AS n FROM mx GROUP BY s, j), r AS (SELECT s, i, sum(abs(v)) AS n FROM mx GROUP BY s, i) SELECT s, round(sqrt(sum(v * v)), 6) AS frobenius, round((SELECT max(n) FROM c WHERE c.s = mx.s), 6) AS one, round((SELECT max(n) FROM r WHERE r.s = mx.s), 6) AS infinity FROM mx GROUP BY s",
    frobenius=6, one=6, infinity=6,
)
_add(
    "less_constant_matrix", lambda spark, d: M.less_matrix(_matrix(spark, d).withColumn("t", F.lit(0)), _matrix(spark, d).groupBy("i", "j").agg(F.avg("v").alias("v"))).drop("t"),
    f"WITH {_MX} SELECT i, j, s, round(v - avg(v) OVER (PARTITION BY i, j), 6) AS v FROM mx", v=6,
)
_add(
    "basis_change", lambda spark, d: M.in_basis(_moving(spark, d, "l_extendedprice", "j").where("j < 3"), _BASIS),
    f"WITH {_MV}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {c}::DOUBLE)' for i, r in enumerate(_BASIS) for j, c in enumerate(r))}) c(i, j, c)) SELECT i, t, s, round(sum(c * v), 3) AS v FROM c JOIN mv ON p = j GROUP BY i, t, s", v=3,
)
_CV = f"{_JK}, cv AS (SELECT a.t AS t_i, b.t AS t_j, covar_pop(a.v, b.v) * (count(*) - 1) AS c FROM jk a JOIN jk b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t), sg AS (SELECT t_i AS t, sqrt(c) AS g FROM cv WHERE t_i = t_j)"
_add(
    "correlation_matrix", lambda spark, d: M.normalised(R.covariance(_jack(spark, d), "t", "jackknife")),
    f"WITH {_CV} SELECT t_i, t_j, round(c / (a.g * b.g), 7) AS correlation, round(a.g, 4) AS sigma_i, round(b.g, 4) AS sigma_j FROM cv JOIN sg a ON a.t = t_i JOIN sg b ON b.t = t_j", correlation=7, sigma_i=4, sigma_j=4,
)
_add(
    "covariance_dump", lambda spark, d: M.dumped(M.normalised(R.covariance(_jack(spark, d), "t", "jackknife"))),
    f"WITH {_CV} SELECT t_i, t_j, round(c, 3) AS covariance FROM cv UNION ALL SELECT t_j, t_i, round(c, 3) FROM cv WHERE t_i < t_j", covariance=3,
)
_DC = f"{_LI}, z AS (SELECT t, sum(v) AS z FROM li GROUP BY t), dj AS (SELECT a.t, a.s AS o, b.s, (z - a.v - b.v) / 48 AS v FROM li a JOIN li b USING (t) JOIN z USING (t) WHERE a.s <> b.s), dc AS (SELECT a.t AS t_i, b.t AS t_j, a.o AS s, covar_pop(a.v, b.v) AS c FROM dj a JOIN dj b ON a.o = b.o AND a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t, a.o), cr AS (SELECT x.t_i, x.t_j, x.s, x.c / sqrt(y.c * z.c) AS r FROM dc x JOIN dc y ON y.t_i = x.t_i AND y.t_j = x.t_i AND y.s = x.s JOIN dc z ON z.t_i = x.t_j AND z.t_j = x.t_j AND z.s = x.s)"
_add(
    "shrunk_correlation", lambda spark, d: M.shrunk(M.normalised(R.double_jackknife_covariance(samples(spark, d), "t"), keys=["s"]).select("t_i", "t_j", "s", "correlation")),
    f"WITH {_DC}, e AS (SELECT t_i, t_j, (count(*) - 1) * var_pop(r) AS e, avg(r * r) AS m FROM cr GROUP BY t_i, t_j), l AS (SELECT sum(CASE WHEN t_i <> t_j THEN 2 * e ELSE 0 END) / sum(CASE WHEN t_i <> t_j THEN 2 * m ELSE m END) AS l FROM e) SELECT t_i, t_j, s, round((1 - l) * r + CASE WHEN t_i = t_j THEN l ELSE 0 END, 7) AS correlation, round(l, 7) AS shrinkage FROM cr, l",
    correlation=7, shrinkage=7,
)


# Super-ensembles.
def _members(spark: SparkSession) -> DataFrame:
    """Samples 0 to 49 at the outer samples of 80 whose number mod 8 is below 5."""
    return U.chosen(spark.range(80).withColumnRenamed("id", "o"), F.col("o") % 8 < 5)


_MB = "mb AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS s FROM range(80) r(o) WHERE o % 8 < 5)"
_add(
    "super_jackknife", lambda spark, d: U.super_jackknife(samples(spark, d), _members(spark), 80, T),
    f"WITH {_LI}, {_MB}, z AS (SELECT t, sum(v) AS z FROM li GROUP BY t) SELECT z.t, r.o AS s, round(CASE WHEN li.v IS NULL THEN z / 50 ELSE (z - li.v) / 49 END, 4) AS v FROM z CROSS JOIN range(80) r(o) LEFT JOIN mb ON mb.o = r.o LEFT JOIN li ON li.t = z.t AND li.s = mb.s", v=4,
)
_add(
    "super_double_jackknife", lambda spark, d: U.super_double_jackknife(samples(spark, d).where("t < 2 AND s < 10"), U.contiguous(spark, 4, 10), 18, T),
    f"WITH {_LI}, k AS (SELECT t, s + 4 AS o, v FROM li WHERE t < 2 AND s < 10), z AS (SELECT t, sum(v) AS z FROM k GROUP BY t) SELECT z.t, x.o AS s, y.o AS \"inner\", round((z - coalesce(a.v, 0) - coalesce(b.v, 0)) / (10 - (a.v IS NOT NULL)::INT - (b.v IS NOT NULL)::INT), 4) AS v FROM z CROSS JOIN range(18) x(o) JOIN range(18) y(o) ON x.o <> y.o LEFT JOIN k a ON a.t = z.t AND a.o = x.o LEFT JOIN k b ON b.t = z.t AND b.o = y.o", v=4,
)
_add(
    "sample_boost", lambda spark, d: U.boosted(_jack(spark, d), T, 20, 90),
    f"WITH {_JK}, m AS (SELECT t, avg(v) AS m FROM jk GROUP BY t) SELECT m.t, r.k AS s, round(coalesce(jk.v, m), 4) AS v FROM m CROSS JOIN range(90) r(k) LEFT JOIN jk ON jk.t = m.t AND jk.s + 20 = r.k", v=4,
)
_add(
    "sample_boost_double", lambda spark, d: U.boosted_double(R.double_jackknife(samples(spark, d).where("t < 2 AND s < 10"), T), T, 4, 10, 18),
    f"WITH {_LI}, k AS (SELECT t, s + 4 AS o, v FROM li WHERE t < 2 AND s < 10), z AS (SELECT t, sum(v) AS z FROM k GROUP BY t) SELECT z.t, x.o AS s, y.o AS \"inner\", round(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN (z - a.v - b.v) / 8 WHEN a.v IS NULL AND b.v IS NULL THEN z / 10 ELSE (z - coalesce(a.v, b.v)) / 9 END, 4) AS v FROM z CROSS JOIN range(18) x(o) JOIN range(18) y(o) ON x.o <> y.o LEFT JOIN k a ON a.t = z.t AND a.o = x.o LEFT JOIN k b ON b.t = z.t AND b.o = y.o", v=4,
)


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble A with jackknife samples, B with boots."""
    a = _jack(spark, sf_dir).select("t", F.lit("A").alias("ens"), F.lit("J").alias("kind"), F.col("s").cast("long").alias("s"), "v")
    return a.unionByName(_boots(spark, sf_dir).where("s >= 0").select("t", F.lit("B").alias("ens"), F.lit("B").alias("kind"), "s", "v"))


_BT = f"tb AS (SELECT id // {N} AS b, {R.draw('id', N, 1234)} AS s FROM range({BOOTS * N}) r(id)), bt AS (SELECT t, b AS s, avg(v) AS v FROM li JOIN tb USING (s) GROUP BY t, b)"
_add(
    "supermulti_covariance", lambda spark, d: U.supermulti_covariance(_multi(spark, d), "t"),
    f"WITH {_JK}, {_BT}, e AS (SELECT a.t AS t_i, b.t AS t_j, covar_pop(a.v, b.v) * (count(*) - 1) AS c FROM jk a JOIN jk b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t UNION ALL SELECT a.t, b.t, covar_pop(a.v, b.v) FROM bt a JOIN bt b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t) SELECT t_i, t_j, round(sum(c), 2) AS covariance FROM e GROUP BY t_i, t_j", covariance=2,
)
_add(
    "super_correlation", lambda spark, d: U.super_correlation(*(_jack(spark, d, c).withColumn("ens", F.lit("A")) for c in ("l_extendedprice", QUANTITY)), T),
    f"WITH {_JK} SELECT t, 'A' AS ens, round(corr(v, q), 7) AS correlation FROM jk GROUP BY t", correlation=7,
)


# Eigenvalues.
def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 matrices of second moments of price and quantity by t and sample: positive definite."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") - 1).alias("t"), (F.col("l_orderkey") % 10).alias("s"), (F.col("l_extendedprice") / 30000).alias("x"), (F.col(QUANTITY) / 25).alias("y"))
    cells = lines.groupBy("t", "s").agg(F.avg(F.col("x") * F.col("x")).alias("a"), F.avg(F.col("x") * F.col("y")).alias("b"), F.avg(F.col("y") * F.col("y")).alias("c"))
    entry = lambda i, j, c: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(c) * F.exp(F.col("t") * (-0.3))).alias("v"))
    return cells.select("t", "s", F.explode(F.array(entry(0, 0, "a"), entry(0, 1, "b"), entry(1, 0, "b"), entry(1, 1, "c"))).alias("e")).select("t", "s", "e.*")


_PR = "pr AS (SELECT l_linenumber - 1 AS t, l_orderkey % 10 AS s, avg(x * x) * exp(-0.3 * (l_linenumber - 1)) AS a, avg(x * y) * exp(-0.3 * (l_linenumber - 1)) AS b, avg(y * y) * exp(-0.3 * (l_linenumber - 1)) AS c FROM (SELECT *, l_extendedprice / 30000 AS x, l_quantity / 25 AS y FROM lineitem) GROUP BY 1, 2, l_linenumber)"
_EG = f"{_PR}, eg AS (SELECT t, s, n, (a + c) / 2 + (1 - 2 * n) * sqrt((a - c) * (a - c) / 4 + b * b) AS value FROM pr, range(2) r(n))"
# det(A - x B) = 0: p x^2 - q x + r = 0.
_GV = f"{_PR}, g0 AS (SELECT u.t AS t0, w.t AS t, u.s, u.a * u.c - u.b * u.b AS p, w.a * u.c + u.a * w.c - 2 * w.b * u.b AS q, w.a * w.c - w.b * w.b AS r FROM pr u JOIN pr w ON u.s = w.s AND u.t <= 1 AND w.t > u.t AND w.t <= 4), gv AS (SELECT t0, t, s, n, (q + (1 - 2 * n) * sqrt(q * q - 4 * p * r)) / (2 * p) AS value FROM g0, range(2) k(n))"
_add("eigenvalues", lambda spark, d: G.eigenvalues(_pair(spark, d), ["t", "s"]).select("t", "s", F.col("n").cast("long").alias("n"), "value"), f"WITH {_EG} SELECT t, s, n, round(value, 7) AS value FROM eg", value=7)
_add("generalised_eigenvalues", lambda spark, d: G.sweep(_pair(spark, d), 0, 1, 4).select("t0", "t", "s", F.col("n").cast("long").alias("n"), "value"), f"WITH {_GV} SELECT t0, t, s, n, round(value, 7) AS value FROM gv", value=7)
_add("general_eigenvalues", lambda spark, d: G.sweep(_pair(spark, d), 0, 1, 4, general=True).select("t0", "t", "s", F.col("n").cast("long").alias("n"), "value"), f"WITH {_GV} SELECT t0, t, s, n, round(value, 7) AS value FROM gv", value=7)
_EF = f"{_GV}, ef AS (SELECT a.t0, a.t, a.s, a.n, ln(a.value / b.value) AS v FROM gv a JOIN gv b ON a.t0 = b.t0 AND b.t = a.t + 1 AND a.s = b.s AND a.n = b.n WHERE a.value / b.value > 0)"
_add("effective_energies", lambda spark, d: G.effective_energies(G.sweep(_pair(spark, d), 0, 1, 4)).select("t0", "t", "s", F.col("n").cast("long").alias("n"), "v"), f"WITH {_EF} SELECT t0, t, s, n, round(v, 6) AS v FROM ef", v=6)
_add(
    "energy_constant", lambda spark, d: G.constant_energies(G.late_energies(G.effective_energies(G.sweep(_pair(spark, d), 0, 1, 4)), 1, 3)).select(F.col("n").cast("long").alias("n"), "s", "v"),
    f"WITH {_EF}, l AS (SELECT * FROM ef WHERE t0 >= t // 2 AND t BETWEEN 1 AND 3), w AS (SELECT t0, t, n, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM l GROUP BY t0, t, n) SELECT n, s, round(sum(w * v) / sum(w), 6) AS v FROM l JOIN w USING (t0, t, n) GROUP BY n, s", v=6,
)
_add(
    "eigen_residuals", lambda spark, d: G.poor_residuals(G.sweep(_pair(spark, d), 0, 1, 4), -1.0),
    f"WITH {_GV} SELECT DISTINCT t0, t, 0.0::DOUBLE AS residual FROM gv", residual=9,
)
_add("effective_amplitudes", lambda spark, d: G.amplitudes(_pair(spark, d), G.sweep(_pair(spark, d), 0, 1, 6)).select("t0", "t", "s", "n", "i", "v"))

# Fits of one sample each.
_LINE = f"WITH {_ER}, m AS (SELECT s, sum(w * t) / sum(w) AS x, sum(w * v) / sum(w) AS y FROM jk JOIN er USING (t) GROUP BY s), f AS (SELECT s, x, y, sum(w * (t - x) * (v - y)) / sum(w * (t - x) ** 2) AS b FROM jk JOIN er USING (t) JOIN m USING (s) GROUP BY s, x, y)"
_add(
    "fit_line", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(1), 0, 6, "uncorrelated").select("s", "a0", "a1", "chi2", "dof", "converged"),
    f"{_LINE} SELECT s, round(y - b * x, 2) AS a0, round(b, 3) AS a1, round(sum(w * (v - (y - b * x) - b * t) ** 2), 5) AS chi2, 5::INT AS dof, true AS converged FROM jk JOIN er USING (t) JOIN f USING (s) GROUP BY s, x, y, b", a0=2, a1=3, chi2=5,
)
_add(
    "fit_constant", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(0), 1, 5, "uncorrelated").select("s", "a0", "chi2"),
    f"WITH {_ER}, m AS (SELECT s, sum(w * v) / sum(w) AS y FROM jk JOIN er USING (t) WHERE t BETWEEN 1 AND 5 GROUP BY s) SELECT s, round(y, 3) AS a0, round(sum(w * (v - y) ** 2), 5) AS chi2 FROM jk JOIN er USING (t) JOIN m USING (s) WHERE t BETWEEN 1 AND 5 GROUP BY s, y", a0=3, chi2=5,
)
_add(
    "fit_frozen_slope", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(1), 0, 6, "uncorrelated", L.Options(frozen={"a1": 50.0})).select("s", "a0", "a1", "chi2"),
    f"WITH {_ER}, m AS (SELECT s, sum(w * (v - 50 * t)) / sum(w) AS y FROM jk JOIN er USING (t) GROUP BY s) SELECT s, round(y, 3) AS a0, 50.0::DOUBLE AS a1, round(sum(w * (v - y - 50 * t) ** 2), 5) AS chi2 FROM jk JOIN er USING (t) JOIN m USING (s) GROUP BY s, y", a0=3, chi2=5,
)
_add(
    "fit_with_prior", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(1), 0, 6, "uncorrelated", L.Options(priors={"a1": (20.0, 10.0)})).select("s", "a0", "a1", "chi2", "dof"),
    f"WITH {_ER}, m AS (SELECT s, sum(w) AS w, sum(w * t) AS wx, sum(w * v) AS wy, sum(w * t * t) + 0.01 AS wxx, sum(w * t * v) + 0.2 AS wxy FROM jk JOIN er USING (t) GROUP BY s), f AS (SELECT s, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b, (wy - wx * (w * wxy - wx * wy) / (w * wxx - wx * wx)) / w AS a FROM m) SELECT s, round(a, 2) AS a0, round(b, 4) AS a1, round(sum(w * (v - a - b * t) ** 2) + ((b - 20) / 10) ** 2, 5) AS chi2, 6::INT AS dof FROM jk JOIN er USING (t) JOIN f USING (s) GROUP BY s, a, b", a0=2, a1=4, chi2=5,
)
_add(
    "fit_correlated_pair", lambda spark, d: L.fitted(_jack(spark, d), L.polynomial(0), 2, 3, "frozen").select("s", "a0", "chi2"),
    f"WITH {_CV}, k AS (SELECT max(c) FILTER (t_i = 2 AND t_j = 2) AS a, max(c) FILTER (t_i = 2 AND t_j = 3) AS b, max(c) FILTER (t_i = 3 AND t_j = 3) AS c FROM cv), y AS (SELECT s, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM jk GROUP BY s), f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM y, k) SELECT s, round(m, 3) AS a0, round((c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b), 5) AS chi2 FROM f", a0=3, chi2=5,
)
_add(
    "fit_double_jackknife_pair", lambda spark, d: L.fitted(samples(spark, d), L.polynomial(0), 2, 3, "correlated").select("s", "a0", "chi2"),
    f"WITH {_DC}, k AS (SELECT s, 49 - 1 AS n, max(c) FILTER (t_i = 2 AND t_j = 2) * 48 AS a, max(c) FILTER (t_i = 2 AND t_j = 3) * 48 AS b, max(c) FILTER (t_i = 3 AND t_j = 3) * 48 AS c FROM dc GROUP BY s), jk AS (SELECT t, s, (sum(v) OVER (PARTITION BY t) - v) / 49 AS v FROM li), y AS (SELECT s, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM jk GROUP BY s), f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM y JOIN k USING (s)) SELECT s, round(m, 3) AS a0, round((c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b), 5) AS chi2 FROM f", a0=3, chi2=5,
)


def _decaying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jackknife samples of a correlator that falls off with t."""
    return _jack(spark, sf_dir).withColumn("v", F.col("v") / 30000 * F.exp(F.col("t") * (-0.4)))


_add("fit_exponential", lambda spark, d: L.fitted(_decaying(spark, d), L.exponential(), 0, 6), A=6, E=7, chi2=4)
_add("fit_cosh_bounded", lambda spark, d: L.fitted(_decaying(spark, d), L.cosh(14), 0, 6, "uncorrelated", L.Options(bounds={"E": (0.0, 1.0), "A": (0.0, None)})), A=6, E=7, chi2=4)
_add("fit_boots", lambda spark, d: L.fitted(_boots(spark, d), L.polynomial(1), 0, 6, "uncorrelated", kind="bootstrap"), a0=2, a1=3, chi2=4)
_add(
    "refitted_boots_p_value", lambda spark, d: (lambda q: q.where("s >= 0").crossJoin(F.broadcast(q.where("s = -1").select(F.col("chi2").alias("c")))).agg(F.avg((F.col("chi2") > F.col("c")).cast("double")).alias("p")))(L.refitted_q2(_boots(spark, d), L.polynomial(0), 0, 6, strategy="uncorrelated")), p=6,
)
_add(
    "chi2_by_mode", lambda spark, d: _modes(spark, d).groupBy("s").agg(F.sum("contribution").alias("chi2")),
    f"WITH {_CV}, k AS (SELECT max(c) FILTER (t_i = 2 AND t_j = 2) AS a, max(c) FILTER (t_i = 2 AND t_j = 3) AS b, max(c) FILTER (t_i = 3 AND t_j = 3) AS c FROM cv), y AS (SELECT s, max(v) FILTER (t = 2) AS x, max(v) FILTER (t = 3) AS y FROM jk GROUP BY s), f AS (SELECT *, ((c - b) * x + (a - b) * y) / (a + c - 2 * b) AS m FROM y, k) SELECT s, round((c * (x - m) ** 2 - 2 * b * (x - m) * (y - m) + a * (y - m) ** 2) / (a * c - b * b), 5) AS chi2 FROM f", chi2=5,
)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square by eigenmode of the correlated fit of a constant to two points."""
    two = _jack(spark, sf_dir).where("t BETWEEN 2 AND 3")
    model = L.at_points(L.fitted(two, L.polynomial(0), 2, 3), L.polynomial(0), [2.0, 3.0]).withColumn("t", F.col("t").cast("int"))
    correlation = M.normalised(R.covariance(two, "t", "jackknife"))
    sigma = correlation.where("t_i = t_j").select(F.col("t_i").alias("t"), F.col("sigma_i").alias("sigma"))
    return L.chi2_modes(two, model, correlation, sigma)


_add(
    "chi2_p_value", lambda spark, d: R.line_fit(_jack(spark, d)).select("s", special.chi2_p(F.col("chi2"), F.lit(4)).alias("p")),
    f"{_LINE}, c AS (SELECT s, sum(w * (v - (y - b * x) - b * t) ** 2) AS c FROM jk JOIN er USING (t) JOIN f USING (s) GROUP BY s) SELECT s, round(exp(-c / 2) * (1 + c / 2), 7) AS p FROM c", p=7,
)
_add(
    "t2_p_value", lambda spark, d: R.line_fit(_jack(spark, d)).select("s", special.t2_p(F.col("chi2"), F.lit(2), F.lit(N - 1)).alias("p")),
    f"{_LINE}, c AS (SELECT s, sum(w * (v - (y - b * x) - b * t) ** 2) AS c FROM jk JOIN er USING (t) JOIN f USING (s) GROUP BY s) SELECT s, round(pow(1 + c / 49, -24), 7) AS p FROM c", p=7,
)
_add("cosh_mass", lambda spark, d: L.cosh_mass(_decaying(spark, d), 20), v=6)
_SIGNED = "em AS (SELECT a.t AS t, a.s AS s, (a.v - 35000) / (b.v - 35000) AS r FROM li a JOIN li b ON b.t = a.t + 1 AND a.s = b.s)"
_add(
    "effective_mass_signed", lambda spark, d: R.effective_mass(X.applied(samples(spark, d), "x - 35000")),
    f"WITH {_LI}, {_SIGNED} SELECT t, s, round(ln(r), 6) AS v FROM em WHERE t IN (SELECT t FROM em GROUP BY t HAVING bool_and(r > 0))", v=6,
)
_add(
    "jackknife_autocorrelation", lambda spark, d: R.jackknife_autocorrelation(_jack(spark, d), T, 3, 4, 10, N),
    f"WITH {_JK}, m AS (SELECT t, avg(v) AS m, var_pop(v) AS d FROM jk GROUP BY t), p AS (SELECT a.t, b.s - a.s AS lag, a.s // 4 AS k, avg((a.v - m) * (b.v - m) / d) AS v FROM jk a JOIN jk b ON a.t = b.t AND b.s - a.s BETWEEN 0 AND 3 JOIN m ON m.t = a.t GROUP BY a.t, b.s - a.s, a.s // 4 HAVING count(*) = 4), tb AS ("
    + " UNION ALL ".join(f"SELECT {lag} AS lag, id // {(N - lag) // 4} AS b, {R.draw('id', (N - lag) // 4, 1234)} AS k FROM range({10 * ((N - lag) // 4)}) r(id)" for lag in range(4))
    + ") SELECT t, p.lag::INT AS lag, b AS s, round(avg(v), 6) AS v FROM p JOIN tb ON tb.k = p.k AND tb.lag = p.lag GROUP BY t, p.lag, b UNION ALL SELECT t, lag::INT, -1, round(avg(v), 6) FROM p GROUP BY t, lag", v=6,
)


# Missing samples and constant series.
def _holey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with gaps, and a series (t = 6) without variation."""
    return samples(spark, sf_dir).withColumn("v", F.when((F.col("t") + F.col("s")) % 7 == 0, None).when(F.col("t") == 6, 1.0).otherwise(F.col("v")))


_HO = f"{_LI}, ho AS (SELECT t, s, CASE WHEN t = 6 THEN 1 ELSE v END AS v FROM li WHERE (t + s) % 7 <> 0), hj AS (SELECT t, s, (sum(v) OVER w - v) / (count(*) OVER w - 1) AS v FROM ho WINDOW w AS (PARTITION BY t))"
_add("holey_jackknife_error", lambda spark, d: R.jackknife_error(R.jackknife(_holey(spark, d), T), T), f"WITH {_HO} SELECT t, round(avg(v), 4) AS mean, round(stddev_pop(v) / sqrt(count(*) - 1), 4) AS error FROM ho GROUP BY t", mean=4, error=4)
_add("holey_covariance", lambda spark, d: R.covariance(_holey(spark, d), "t"), f"WITH {_HO} SELECT a.t AS t_i, b.t AS t_j, round(covar_pop(a.v, b.v) / (count(*) - 1), 3) AS covariance FROM ho a JOIN ho b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t", covariance=3)
_add(
    "holey_autocorrelation", lambda spark, d: R.autocorrelation(_holey(spark, d), T, 2).select("t", "lag", "c"),
    f"WITH {_HO}, m AS (SELECT t, avg(v) AS m, nullif(var_pop(v), 0) AS d FROM ho GROUP BY t) SELECT a.t AS t, (b.s - a.s)::INT AS lag, round(avg((a.v - m) * (b.v - m) / d), 6) AS c FROM ho a JOIN ho b ON a.t = b.t AND b.s - a.s BETWEEN 0 AND 2 JOIN m ON m.t = a.t GROUP BY a.t, b.s - a.s", c=6,
)
_add("holey_weighted_average", lambda spark, d: R.weighted_average(R.jackknife(_holey(spark, d), T), "t"), f"WITH {_HO}, e AS (SELECT t, 1 / nullif((count(*) - 1) * var_pop(v), 0) AS w FROM hj GROUP BY t) SELECT s, CASE WHEN bool_and(w IS NOT NULL) THEN round(sum(w * v) / sum(w), 4) END AS v FROM hj JOIN e USING (t) GROUP BY s", v=4)


# Samples whose number grows with the tables.
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a sample of its line number's series."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select((F.col("l_linenumber") - 1).alias("t"), F.col("l_orderkey").alias("s"), F.col("l_extendedprice").alias("v"))


_add("lines_moments", lambda spark, d: R.moments(_lines(spark, d), T).select("t", "mean", "deviation", "standard_error"), "SELECT l_linenumber - 1 AS t, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS deviation, round(stddev_pop(l_extendedprice) / sqrt(count(*) - 1), 5) AS standard_error FROM lineitem GROUP BY 1", mean=4, deviation=4, standard_error=5)
_add("lines_jackknife_error", lambda spark, d: R.jackknife_error(R.jackknife(_lines(spark, d), T), T), "SELECT l_linenumber - 1 AS t, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice) / sqrt(count(*) - 1), 4) AS error FROM lineitem GROUP BY 1", mean=3, error=4)
_add("lines_covariance", lambda spark, d: R.covariance(_lines(spark, d), "t"), "SELECT a.l_linenumber - 1 AS t_i, b.l_linenumber - 1 AS t_j, round(covar_pop(a.l_extendedprice, b.l_extendedprice) / (count(*) - 1), 3) AS covariance FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <= b.l_linenumber GROUP BY 1, 2", covariance=3)
_EV = "ev AS (SELECT event_type AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS s, value AS v FROM events)"
_add("events_jackknife", lambda spark, d: R.jackknife(_events(spark, d), T), f"WITH {_EV} SELECT t, s, round((sum(v) OVER w - v) / (count(*) OVER w - 1), 6) AS v FROM ev WINDOW w AS (PARTITION BY t)", v=6)
_add(
    "events_binned_error", lambda spark, d: R.jackknife_error(R.bin_jackknife(_events(spark, d), T, 16), T),
    f"WITH {_EV}, b AS (SELECT t, avg(v) AS v FROM ev GROUP BY t, s // 16 HAVING count(*) = 16) SELECT t, round(avg(v), 6) AS mean, round(stddev_pop(v) / sqrt(count(*) - 1), 6) AS error FROM b GROUP BY t", mean=6, error=6,
)
_add("events_numbered", lambda spark, d: S.numbered(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id"), ["user_id"], "event_id", 64), "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS s FROM events")

# Synthetic samples, determinants, saved parameters.
_add("determinants", lambda spark, d: G.determinants(_pair(spark, d), ["t", "s"]), f"WITH {_PR} SELECT t, s, round(a * c - b * b, 8) AS v FROM pr", v=8)
_add(
    "orthonormal_rows", lambda spark, d: G.orthonormal(_pair(spark, d), ["t", "s"]).where("i = 0").select("t", "s", F.col("j").cast("long").alias("j"), "v"),
    f"WITH {_PR} SELECT t, s, j, round(CASE j WHEN 0 THEN a ELSE b END / sqrt(a * a + b * b), 7) AS v FROM pr, range(2) r(j)", v=7,
)
_add(
    "regridded_flow", lambda spark, d: Z.regridded(samples(spark, d).where("t <> 2 OR s % 2 = 0").select(F.col("s").alias("traj"), F.col("t").cast("double").alias("t"), "v")),
    f"WITH {_LI} SELECT a.s AS traj, a.t::DOUBLE AS t, round(CASE WHEN a.t = 2 AND a.s % 2 = 1 THEN (b.v + c.v) / 2 ELSE a.v END, 4) AS v FROM li a LEFT JOIN li b ON b.s = a.s AND b.t = a.t - 1 LEFT JOIN li c ON c.s = a.s AND c.t = a.t + 1", v=4,
)

_add(
    "integrated_autocorrelation", lambda spark, d: R.integrated(R.bootstrap_autocorrelation(samples(spark, d), T, 4, 2, BOOTS, N), T),
    f"WITH a AS ({_REGISTERED['bootstrap_autocorrelation'].replace(', 6) AS v', ', 15) AS v')}) SELECT t, lag, s, round(sum(CASE lag WHEN 0 THEN 0.5 ELSE v END) OVER (PARTITION BY t, s ORDER BY lag), 5) AS v FROM a", v=5,
)
_add(
    "weighted_average_double", lambda spark, d: R.weighted_average_double(R.double_jackknife(samples(spark, d).where("s < 20"), T), "t"),
    f"WITH {_LI}, k AS (SELECT * FROM li WHERE s < 20), z AS (SELECT t, sum(v) AS z FROM k GROUP BY t), dj AS (SELECT a.t, a.s, b.s AS i, (z - a.v - b.v) / 18 AS v FROM k a JOIN k b USING (t) JOIN z USING (t) WHERE a.s <> b.s), w AS (SELECT t, s, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM dj GROUP BY t, s) SELECT s, i AS \"inner\", round(sum(w * v) / sum(w), 4) AS v FROM dj JOIN w USING (t, s) GROUP BY s, i", v=4,
)
_add(
    "effective_mass_less_constant", lambda spark, d: R.effective_mass_less_constant(_decaying(spark, d).withColumn("v", F.col("v") + 5)),
    f"WITH {_JK}, d AS (SELECT t, s, v / 30000 * exp(-0.4 * t) + 5 AS v FROM jk), e AS (SELECT a.t, a.s, a.v - b.v AS v FROM d a JOIN d b ON b.t = a.t + 1 AND a.s = b.s), em AS (SELECT a.t, a.s, a.v / b.v AS r FROM e a JOIN e b ON b.t = a.t + 1 AND a.s = b.s) SELECT t, s, round(ln(r), 5) AS v FROM em WHERE t IN (SELECT t FROM em GROUP BY t HAVING bool_and(r > 0))", v=5,
)
_add(
    "lines_histogram", lambda spark, d: C.histogram(_lines(spark, d), T, 10000.0, 60000.0, 10),
    "SELECT l_linenumber - 1 AS t, (CASE WHEN l_extendedprice < 10000 THEN -1 WHEN l_extendedprice >= 60000 THEN 10 ELSE least(9, floor((l_extendedprice - 10000) / 50000 * 10)) END)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
_add(
    "energies_by_distance", lambda spark, d: G.energies_by_distance(G.effective_energies(G.sweep(_pair(spark, d), 0, 1, 4))).select("d", F.col("n").cast("long").alias("n"), "s", "v"),
    f"WITH {_EF}, w AS (SELECT t0, t, n, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM ef GROUP BY t0, t, n) SELECT ef.t - ef.t0 AS d, n, s, round(sum(w * v) / sum(w), 6) AS v FROM ef JOIN w USING (t0, t, n) GROUP BY ef.t - ef.t0, n, s", v=6,
)
_add(
    "subtracted_matrices", lambda spark, d: G.less_next(_pair(spark, d)).where("i = 0 AND j = 1").select("t", "s", "v"),
    f"WITH {_PR} SELECT x.t, x.s, round(x.b - y.b, 8) AS v FROM pr x JOIN pr y ON y.t = x.t + 1 AND x.s = y.s", v=8,
)
_add("fit_eigenvalue_decay", lambda spark, d: G.decay_fit(G.sweep(_pair(spark, d), 0, 0, 6), 0, 0, 1, 5), E=7, chi2=4)
_add(
    "fit_two_series", lambda spark, d: L.fitted(
        L.together(_jack(spark, d).withColumn("series", F.lit(0)).unionByName(X.applied(_jack(spark, d, QUANTITY), "x * 1400").withColumn("series", F.lit(1)))),
        L.simultaneous([L.polynomial(0), L.polynomial(0)], [{"a0": "both"}, {"a0": "both"}]), 0, 1e7, "uncorrelated").select("s", F.col("both").alias("v"), "dof"),
    f"WITH {_JK}, p AS (SELECT 0 AS k, t, s, v FROM jk UNION ALL SELECT 1, t, s, q * 1400 FROM jk), w AS (SELECT k, t, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM p GROUP BY k, t) SELECT s, round(sum(w * v) / sum(w), 3) AS v, 13::INT AS dof FROM p JOIN w USING (k, t) GROUP BY s", v=3,
)
