"""All queries on the driver tables with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplewright.operators import ensembles as E
from samplewright.operators import resampling as R
from samplewright.operators import series as S

N, BOOTS, BLOCK = 50, 40, 5


def samples(spark: SparkSession, sf_dir: str, value: str = "l_extendedprice") -> DataFrame:
    """Order lines as a correlator: t by line number, N samples, mean value of each cell."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = lines.groupBy((F.col("l_linenumber") - 1).alias("t"), (F.col("l_orderkey") % N).alias("s"))
    return cells.agg(F.avg(value).alias("v"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, numbered in the order of their ids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("t"), "event_id", F.col("value").alias("v"))
    return S.numbered(events, ["t"], "event_id").select("t", "s", "v")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jackknife samples of each user's mean event value; a user is an ensemble of a group of ten."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("t"), "user_id", F.col("event_id").alias("s"), F.col("value").alias("v"))
    return R.jackknife(events, ["t", "user_id"])


def _boots(spark: SparkSession, sf_dir: str, size: int = 1) -> DataFrame:
    return R.bootstrap(samples(spark, sf_dir), R.resample_table(spark, N, BOOTS, size), ["t"])


T = ["t"]
QUERIES = {
    "jackknife_error": lambda spark, d: _rounded(R.jackknife_error(R.jackknife(samples(spark, d), T), T), mean=4, error=4),
    "moments": lambda spark, d: _rounded(R.moments(samples(spark, d), T), mean=4, variance=2, deviation=4, low=4, high=4, standard_error=4, third=6, fourth=6),
    "covariance": lambda spark, d: _rounded(R.covariance(samples(spark, d), "t"), covariance=3),
    "jackknife_covariance": lambda spark, d: _rounded(R.covariance(R.jackknife(samples(spark, d), T), "t", "jackknife"), covariance=3),
    "bin": lambda spark, d: _rounded(R.binned(samples(spark, d), T, 4), v=4),
    "bin_events": lambda spark, d: _rounded(R.binned(_events(spark, d), T, 16), v=6),
    "jackknife": lambda spark, d: _rounded(R.jackknife(samples(spark, d), T), v=4),
    "jackknife_to_raw": lambda spark, d: _rounded(R.unjackknife(R.jackknife(samples(spark, d), T), T), v=3),
    "double_jackknife": lambda spark, d: _rounded(R.double_jackknife(samples(spark, d), T), v=4),
    "double_jackknife_covariance": lambda spark, d: _rounded(R.double_jackknife_covariance(samples(spark, d), "t"), covariance=2),
    "block_double_jackknife": lambda spark, d: _rounded(R.block_double_jackknife(samples(spark, d), T, 7), v=4),
    "bootstrap": lambda spark, d: _rounded(_boots(spark, d), v=4),
    "block_bootstrap": lambda spark, d: _rounded(_boots(spark, d, BLOCK), v=4),
    "bootstrap_error": lambda spark, d: _rounded(R.bootstrap_error(_boots(spark, d), T), central=4, error=4, low=4, high=4),
    "autocorrelation": lambda spark, d: _rounded(R.autocorrelation(_events(spark, d), T, 10), c=6, tau=6),
    "weighted_average": lambda spark, d: _rounded(R.weighted_average(R.jackknife(samples(spark, d), T), "t"), v=4),
    "effective_mass": lambda spark, d: _rounded(R.jackknife_error(R.effective_mass(R.jackknife(samples(spark, d), T)), T), mean=8, error=8),
    "line_fit": lambda spark, d: _rounded(R.line_fit(R.jackknife(samples(spark, d), T)), a=3, b=4, chi2=5),
    "superjackknife_error": lambda spark, d: _rounded(R.superjackknife_error(_users(spark, d), T, "user_id"), mean=4, error=6),
    "relative_difference": lambda spark, d: _rounded(
        R.relative_difference(R.jackknife(samples(spark, d), T), R.jackknife(samples(spark, d, "l_quantity"), T), T), v=9
    ),
}

_LI = "li AS (SELECT l_linenumber - 1 AS t, l_orderkey % 50 AS s, avg(l_extendedprice) AS v, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
_JK = _LI + ", jk AS (SELECT t, s, (sum(v) OVER w - v) / (count(*) OVER w - 1) AS v, (sum(q) OVER w - q) / (count(*) OVER w - 1) AS q FROM li WINDOW w AS (PARTITION BY t))"
_ER = _JK + ", er AS (SELECT t, 1 / ((count(*) - 1) * var_pop(v)) AS w FROM jk GROUP BY t)"
_EV = "ev AS (SELECT event_type AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS s, value AS v FROM events)"


def _boots_sql(size: int) -> str:
    n = N // size
    table = f"SELECT id // {n} AS b, {R.draw('id', n, 1234)} * {size} + k AS s FROM range({BOOTS * n}) r(id), range({size}) z(k)"
    return f"WITH {_LI}, tb AS ({table}), bt AS (SELECT t, b AS s, avg(v) AS v FROM li JOIN tb USING (s) GROUP BY t, b UNION ALL SELECT t, -1, avg(v) FROM li GROUP BY t)"


ORACLES = {
    "jackknife_error": f"WITH {_JK} SELECT t, round(avg(v), 4) AS mean, round(sqrt((count(*) - 1) * var_pop(v)), 4) AS error FROM jk GROUP BY t",
    "moments": f"WITH {_LI}, m AS (SELECT t, avg(v) AS m, stddev_pop(v) AS d FROM li GROUP BY t) SELECT t, round(avg(v), 4) AS mean, round(var_pop(v), 2) AS variance, round(stddev_pop(v), 4) AS deviation, round(min(v), 4) AS low, round(max(v), 4) AS high, round(stddev_pop(v) / sqrt(count(*) - 1), 4) AS standard_error, round(avg(((v - m) / d) ** 3), 6) AS third, round(avg(((v - m) / d) ** 4), 6) AS fourth FROM li JOIN m USING (t) GROUP BY t",
    "covariance": f"WITH {_LI} SELECT a.t AS t_i, b.t AS t_j, round(covar_pop(a.v, b.v) / (count(*) - 1), 3) AS covariance FROM li a JOIN li b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t",
    "jackknife_covariance": f"WITH {_JK} SELECT a.t AS t_i, b.t AS t_j, round(covar_pop(a.v, b.v) * (count(*) - 1), 3) AS covariance FROM jk a JOIN jk b ON a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t",
    "bin": f"WITH {_LI} SELECT t, s // 4 AS s, round(avg(v), 4) AS v FROM li GROUP BY t, s // 4 HAVING count(*) = 4",
    "bin_events": f"WITH {_EV} SELECT t, s // 16 AS s, round(avg(v), 6) AS v FROM ev GROUP BY t, s // 16 HAVING count(*) = 16",
    "jackknife": f"WITH {_JK} SELECT t, s, round(v, 4) AS v FROM jk",
    "jackknife_to_raw": f"WITH {_LI} SELECT t, s, round(v, 3) AS v FROM li",
    "double_jackknife": f"WITH {_LI}, z AS (SELECT t, sum(v) AS z, count(*) AS n FROM li GROUP BY t) SELECT t, a.s AS s, b.s AS inner, round((z - a.v - b.v) / (n - 2), 4) AS v FROM li a JOIN li b USING (t) JOIN z USING (t) WHERE a.s <> b.s".replace("AS inner", 'AS "inner"'),
    "double_jackknife_covariance": f"WITH {_LI}, z AS (SELECT t, sum(v) AS z, count(*) AS n FROM li GROUP BY t), dj AS (SELECT t, a.s AS o, b.s AS s, (z - a.v - b.v) / (n - 2) AS v FROM li a JOIN li b USING (t) JOIN z USING (t) WHERE a.s <> b.s) SELECT a.t AS t_i, b.t AS t_j, a.o AS s, round(covar_pop(a.v, b.v) * (count(*) - 1), 2) AS covariance FROM dj a JOIN dj b ON a.o = b.o AND a.s = b.s AND a.t <= b.t GROUP BY a.t, b.t, a.o",
    "block_double_jackknife": f"WITH {_LI}, k AS (SELECT *, s // 7 AS own FROM li WHERE s < 49), z AS (SELECT t, sum(v) AS z FROM k GROUP BY t), p AS (SELECT t, own AS block, sum(v) AS p FROM k GROUP BY t, own) SELECT t, block, s, round((z - p - v) / 41, 4) AS v FROM k JOIN z USING (t) JOIN p USING (t) WHERE own <> block",
    "bootstrap": f"{_boots_sql(1)} SELECT t, s, round(v, 4) AS v FROM bt",
    "block_bootstrap": f"{_boots_sql(BLOCK)} SELECT t, s, round(v, 4) AS v FROM bt",
    "bootstrap_error": f"{_boots_sql(1)}, l AS (SELECT t, list_sort(list(v)) AS l, stddev_pop(v) AS e, count(*) AS n FROM bt WHERE s >= 0 GROUP BY t) SELECT t, round(v, 4) AS central, round(e, 4) AS error, round(l[1 + 16 * n // 100], 4) AS low, round(l[n - 16 * n // 100], 4) AS high FROM l JOIN (SELECT t, v FROM bt WHERE s = -1) USING (t)",
    "autocorrelation": f"WITH {_EV}, m AS (SELECT t, avg(v) AS m, var_pop(v) AS d FROM ev GROUP BY t), c AS (SELECT t, g::INT AS lag, avg((a.v - m) * (b.v - m) / d) AS c FROM ev a JOIN range(11) r(g) ON TRUE JOIN ev b ON a.t = b.t AND b.s = a.s + g JOIN m ON m.t = a.t GROUP BY a.t, g) SELECT t, lag, round(c, 6) AS c, round(sum(CASE lag WHEN 0 THEN 0.5 ELSE c END) OVER (PARTITION BY t ORDER BY lag), 6) AS tau FROM c".replace("SELECT t, g::INT", "SELECT a.t AS t, g::INT"),
    "weighted_average": f"WITH {_ER} SELECT s, round(sum(w * v) / sum(w), 4) AS v FROM jk JOIN er USING (t) GROUP BY s",
    "effective_mass": f"WITH {_JK}, em AS (SELECT a.t AS t, a.v / b.v AS r FROM jk a JOIN jk b ON b.t = a.t + 1 AND a.s = b.s), em2 AS (SELECT t, ln(r) AS v FROM em WHERE t IN (SELECT t FROM em GROUP BY t HAVING bool_and(r > 0))) SELECT t, round(avg(v), 8) AS mean, round(sqrt((count(*) - 1) * var_pop(v)), 8) AS error FROM em2 GROUP BY t",
    "line_fit": f"WITH {_ER}, m AS (SELECT s, sum(w * t) / sum(w) AS x, sum(w * v) / sum(w) AS y FROM jk JOIN er USING (t) GROUP BY s), f AS (SELECT s, x, y, sum(w * (t - x) * (v - y)) / sum(w * (t - x) ** 2) AS b FROM jk JOIN er USING (t) JOIN m USING (s) GROUP BY s, x, y) SELECT s, round(y - b * x, 3) AS a, round(b, 4) AS b, round(sum(w * (v - (y - b * x) - b * t) ** 2), 5) AS chi2 FROM jk JOIN er USING (t) JOIN f USING (s) GROUP BY s, x, y, b",
    "superjackknife_error": "WITH e AS (SELECT user_id % 10 AS t, user_id, avg(value) AS m, var_pop(value) / (count(*) - 1) AS e FROM events GROUP BY user_id) SELECT t, round(sum(m), 4) AS mean, round(sqrt(sum(e)), 6) AS error FROM e GROUP BY t",
    "relative_difference": f"WITH {_JK} SELECT t, s, round(2 * (q - v) / (q + v), 9) AS v FROM jk",
}


def _jack(spark: SparkSession, sf_dir: str, value: str = "l_extendedprice") -> DataFrame:
    return R.jackknife(samples(spark, sf_dir, value), T)


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble A with jackknife samples, B with boots."""
    a = _jack(spark, sf_dir).select("t", F.lit("A").alias("ens"), F.lit("J").alias("kind"), "v")
    return a.unionByName(_boots(spark, sf_dir).where("s >= 0").select("t", F.lit("B").alias("ens"), F.lit("B").alias("kind"), "v"))


def _neighbours(spark: SparkSession, sf_dir: str, circular: bool) -> DataFrame:
    return R.bootstrap(samples(spark, sf_dir), R.neighbour_table(spark, N, BOOTS, BLOCK, circular), T)


QUERIES |= {
    "time_reflect": lambda spark, d: _rounded(S.reflected(samples(spark, d), 7), v=4),
    "time_fold": lambda spark, d: _rounded(S.folded(samples(spark, d), 7), v=4),
    "time_antifold_offset": lambda spark, d: _rounded(S.folded(samples(spark, d), 7, -1, 2), v=4),
    "neighbour_difference": lambda spark, d: _rounded(S.less_next(samples(spark, d)), v=4),
    "fixed_time_difference": lambda spark, d: _rounded(S.less_fixed(samples(spark, d), 3), v=4),
    "remove_samples": lambda spark, d: _rounded(S.without_samples(samples(spark, d), 10, 20), v=4),
    "scramble_samples": lambda spark, d: _rounded(S.scrambled(samples(spark, d), N), v=4),
    "combine_channels": lambda spark, d: _rounded(S.combined(samples(spark, d), samples(spark, d, "l_quantity"), "ratio"), v=6),
    "channel_correlation": lambda spark, d: _rounded(S.correlation(_jack(spark, d), _jack(spark, d, "l_quantity")), correlation=7),
    "shifted_product": lambda spark, d: _rounded(S.shifted_product(samples(spark, d), samples(spark, d, "l_quantity"), 7), v=2),
    "interpolate": lambda spark, d: _rounded(S.interpolated(samples(spark, d), POINTS), v=4),
    "closest_points": lambda spark, d: _rounded(S.closest(samples(spark, d), TARGET), v=4),
    "slope_at_target": lambda spark, d: _rounded(S.slope(samples(spark, d), TARGET), slope=4),
    "closest_p_value": lambda spark, d: _rounded(S.p_value(samples(spark, d), TARGET), p=9),
    "recentre": lambda spark, d: _rounded(S.recentred(samples(spark, d), spark.range(7).select(F.col("id").cast("int").alias("t"), (F.col("id") * 1000.0).alias("fit"))), v=4),
    "jackknife_to_double": lambda spark, d: _rounded(R.jackknife_to_double(_jack(spark, d), T), v=3),
    "double_to_jackknife": lambda spark, d: _rounded(R.double_to_jackknife(R.double_jackknife(samples(spark, d), T), T), v=4),
    "boot_jackknife": lambda spark, d: _rounded(R.boot_jackknife(samples(spark, d), R.resample_table(spark, N, BOOTS), T), v=4),
    "boot_covariance": lambda spark, d: _rounded(R.boot_covariance(samples(spark, d), R.resample_table(spark, N, BOOTS), "t"), covariance=2),
    "overlapping_bootstrap": lambda spark, d: _rounded(_neighbours(spark, d, False), v=4),
    "circular_bootstrap": lambda spark, d: _rounded(_neighbours(spark, d, True), v=4),
    "super_boost": lambda spark, d: _rounded(R.super_boost(_jack(spark, d), T, "A", {"A": N, "B": 20}), v=4),
    "supermulti_error": lambda spark, d: _rounded(R.supermulti_error(_multi(spark, d), T, "ens", "kind"), error=4),
    "bootstrap_autocorrelation": lambda spark, d: _rounded(R.bootstrap_autocorrelation(samples(spark, d), T, 4, 2, BOOTS, N), v=6),
}

POINTS, TARGET = [-1.0, 0.0, 1.5, 3.25, 6.0, 7.5], 35000.0
_TB1 = f"tb AS (SELECT id // {N} AS b, id % {N} AS pos, {R.draw('id', N, 1234)} AS s FROM range({BOOTS * N}) r(id))"
_BJ = f"{_LI}, {_TB1}, bs AS (SELECT t, b, pos AS s, v FROM li JOIN tb USING (s) UNION ALL SELECT t, -1, s, v FROM li), bj AS (SELECT t, b, s, (sum(v) OVER w - v) / 49 AS v FROM bs WINDOW w AS (PARTITION BY t, b))"
_PTS = ", ".join(f"({x})" for x in POINTS)


def _permutation_ctes(m: int, seed: int) -> str:
    """CTEs p0 to pROUNDS (id, x): a permutation, round by round."""
    rounds = (f"p{r + 1} AS MATERIALIZED (SELECT id, {E.permuted('x', r, m, seed)} AS x FROM p{r})" for r in range(E.ROUNDS))
    return ", ".join([f"p0 AS (SELECT id, id AS x FROM range({m}) z(id))", *rounds])


def _scrambled_sql() -> str:
    return f"WITH {_LI}, {_permutation_ctes(N, 1234)} SELECT t, x AS s, round(v, 4) AS v FROM li JOIN p{E.ROUNDS} ON s = id"


def _neighbours_sql(circular: bool) -> str:
    n = N // BLOCK
    table = f"SELECT id // {n} AS b, ({R.draw('id', N if circular else N - BLOCK + 1, 1234)} + k) % {N} AS s FROM range({BOOTS * n}) r(id), range({BLOCK}) z(k)"
    return f"WITH {_LI}, tb AS ({table}) SELECT t, b AS s, round(avg(v), 4) AS v FROM li JOIN tb USING (s) GROUP BY t, b UNION ALL SELECT t, -1, round(avg(v), 4) FROM li GROUP BY t"


ORACLES |= {
    "time_reflect": f"WITH {_LI} SELECT (7 - t) % 7 AS t, s, round(v, 4) AS v FROM li",
    "time_fold": f"WITH {_LI} SELECT a.t, a.s, round(CASE a.t WHEN 0 THEN a.v ELSE (a.v + b.v) / 2 END, 4) AS v FROM li a JOIN li b ON a.s = b.s AND b.t = (7 - a.t) % 7",
    "time_antifold_offset": f"WITH {_LI} SELECT a.t, a.s, round((a.v - b.v) / 2, 4) AS v FROM li a JOIN li b ON a.s = b.s AND b.t = (7 - 2 - a.t + 7) % 7",
    "neighbour_difference": f"WITH {_LI} SELECT a.t, a.s, round(a.v - b.v, 4) AS v FROM li a JOIN li b ON a.s = b.s AND b.t = a.t + 1",
    "fixed_time_difference": f"WITH {_LI} SELECT a.t, a.s, round(a.v - b.v, 4) AS v FROM li a JOIN li b ON a.s = b.s AND b.t = 3",
    "remove_samples": f"WITH {_LI} SELECT t, row_number() OVER (PARTITION BY t ORDER BY s) - 1 AS s, round(v, 4) AS v FROM li WHERE s NOT BETWEEN 10 AND 19",
    "scramble_samples": _scrambled_sql(),
    "combine_channels": f"WITH {_LI} SELECT t, s, round(v / q, 6) AS v FROM li",
    "channel_correlation": f"WITH {_LI} SELECT t, round(corr(v, q), 7) AS correlation FROM li GROUP BY t",
    "shifted_product": f"WITH {_LI} SELECT (a.t - b.t + 7) % 7 AS t, a.s, round(avg(a.v * b.q), 2) AS v FROM li a JOIN li b ON a.s = b.s GROUP BY (a.t - b.t + 7) % 7, a.s",
    "interpolate": f"WITH {_LI}, x AS (SELECT x::DOUBLE AS x, greatest(0, least(5, floor(x)::INT)) AS k FROM (VALUES {_PTS}) p(x)) SELECT x AS t, a.s, round(a.v + (b.v - a.v) * (x - a.t), 4) AS v FROM x JOIN li a ON a.t = k JOIN li b ON b.t = k + 1 AND b.s = a.s",
    "closest_points": f"WITH {_LI}, c AS (SELECT t, s, v, row_number() OVER (PARTITION BY s ORDER BY abs(v - {TARGET}), t) AS rank FROM li) SELECT t, s, round(v, 4) AS v, rank FROM c WHERE rank <= 2",
    "slope_at_target": f"WITH {_LI}, c AS (SELECT t, s, v, row_number() OVER (PARTITION BY s ORDER BY abs(v - {TARGET}), t) AS k FROM li) SELECT a.s, round((b.v - a.v) / (b.t - a.t), 4) AS slope FROM c a JOIN c b ON a.s = b.s AND a.k = 1 AND b.k = 2",
    "closest_p_value": f"WITH {_LI}, c AS (SELECT t, arg_min(v, (abs(v - {TARGET}), v)) AS c FROM li GROUP BY t) SELECT t, round((count(*) - count(*) FILTER (v < c) - 1) / count(*), 9) AS p FROM li JOIN c USING (t) GROUP BY t",
    "recentre": f"WITH {_LI} SELECT t, s, round(v + t * 1000 - avg(v) OVER (PARTITION BY t), 4) AS v FROM li",
    "double_to_jackknife": f"WITH {_JK} SELECT t, s, round(v, 4) AS v FROM jk",
    "boot_jackknife": f"WITH {_BJ} SELECT t, b, s, round(v, 4) AS v FROM bj",
    "boot_covariance": f"WITH {_BJ} SELECT x.t AS t_i, y.t AS t_j, b, round(covar_pop(x.v, y.v) * 49, 2) AS covariance FROM bj x JOIN bj y USING (b, s) WHERE x.t <= y.t GROUP BY x.t, y.t, b",
    "overlapping_bootstrap": _neighbours_sql(False),
    "circular_bootstrap": _neighbours_sql(True),
    "super_boost": f"WITH {_JK} SELECT t, 'A' AS ens, s, round(v, 4) AS v FROM jk UNION ALL SELECT t, 'B', k, round(avg(v), 4) FROM jk, range(20) r(k) GROUP BY t, k",
    "supermulti_error": f"{_boots_sql(1)}, e AS (SELECT t, var_pop(v) / (count(*) - 1) AS e FROM li GROUP BY t UNION ALL SELECT t, var_pop(v) FROM bt WHERE s >= 0 GROUP BY t) SELECT t, round(sqrt(sum(e)), 4) AS error FROM e GROUP BY t",
    "bootstrap_autocorrelation": f"WITH {_LI}, m AS (SELECT t, avg(v) AS m FROM li GROUP BY t), p AS (SELECT a.t AS t, b.s - a.s AS lag, a.s // 2 AS s, avg((a.v - m) * (b.v - m)) AS v FROM li a JOIN li b ON a.t = b.t AND b.s - a.s BETWEEN 0 AND 4 AND a.s < 46 JOIN m ON m.t = a.t GROUP BY a.t, b.s - a.s, a.s // 2), tb AS (SELECT id // 23 AS b, {R.draw('id', 23, 1234)} AS s FROM range({BOOTS * 23}) r(id)), g AS (SELECT t, lag, b AS s, avg(v) AS v FROM p JOIN tb USING (s) GROUP BY t, lag, b UNION ALL SELECT t, lag, -1, avg(v) FROM p GROUP BY t, lag) SELECT g.t, g.lag, g.s, round(g.v / z.v, 6) AS v FROM g JOIN g z ON z.lag = 0 AND z.t = g.t AND z.s = g.s",
}
ORACLES["jackknife_to_double"] = ORACLES["double_jackknife"].replace(", 4) AS v", ", 3) AS v")


def _sources(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    """Order lines by source, time and sample; exact ones are zero for one source of each sample."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = lines.groupBy((F.col("l_suppkey") % 4).alias("tsrc"), (F.col("l_linenumber") - 1).alias("t"), (F.col("l_orderkey") % N).alias("s"))
    if not exact:
        return cells.agg(F.avg(F.expr("l_extendedprice * (1 - l_discount)")).alias("v"))
    return cells.agg(F.avg("l_extendedprice").alias("v")).withColumn("v", F.when(F.expr("tsrc = s % 4"), 0.0).otherwise(F.col("v")))


def _layout(spark: SparkSession, sf_dir: str, column: str = "event_type", where: str = "true") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col(column).cast("string").alias("tag")).agg(F.count("*").alias("size")).where(where)


def _user_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ensemble for each user, tagged by groups of users."""
    users = _layout(spark, sf_dir, "user_id")
    return users.select((F.col("tag").cast("long") % 100).cast("string").alias("tag"), "size")


def _ama(spark: SparkSession, sf_dir: str) -> DataFrame:
    sloppy = samples(spark, sf_dir)
    return E.sample_corrected(sloppy.where("s < 30"), sloppy.where("s >= 30"), samples(spark, sf_dir, "l_quantity").where("s >= 30"), T)


QUERIES |= {
    "jackknife_with_centre": lambda spark, d: _rounded(E.jackknife_with_centre(samples(spark, d), T), v=4),
    "error_about_centre": lambda spark, d: _rounded(E.error_about_centre(E.jackknife_with_centre(samples(spark, d), T), T), central=4, error=4),
    "block_double_jackknife_covariance": lambda spark, d: _rounded(E.block_double_jackknife_covariance(samples(spark, d), "t", 7), covariance=2),
    "asymmetric_errors": lambda spark, d: _rounded(E.asymmetric_errors(R.bootstrap_error(_boots(spark, d), T), T), central=4, up=4, down=4),
    "source_average": lambda spark, d: _rounded(E.source_average(_sources(spark, d, True)), v=4),
    "live_source_average": lambda spark, d: _rounded(E.source_average(_sources(spark, d, True), True), v=4),
    "source_correction": lambda spark, d: _rounded(E.correction(_sources(spark, d, True), _sources(spark, d, False)), v=4),
    "sample_correction": lambda spark, d: _rounded(_ama(spark, d), v=4),
    "average_over_dimension": lambda spark, d: _rounded(E.averaged_over(_sources(spark, d, False), ["tsrc"], F.col("t") < 4), v=4),
    "joined_layout": lambda spark, d: E.joined_layout(_layout(spark, d, where="tag < 'm'"), _layout(spark, d)),
    "told_apart": lambda spark, d: E.told_apart(_user_layout(spark, d)),
    "balanced_bootstrap": lambda spark, d: _rounded(R.bootstrap(samples(spark, d), E.balanced_table(spark, N, BOOTS, BLOCK), T), v=4),
}

_SRC = "src AS (SELECT l_suppkey % 4 AS tsrc, l_linenumber - 1 AS t, l_orderkey % 50 AS s, CASE WHEN l_suppkey % 4 = l_orderkey % 50 % 4 THEN 0 ELSE avg(l_extendedprice) END AS e, avg(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1, 2, 3)"
_CENTRE = f"{_JK}, jc AS (SELECT t, s::BIGINT AS s, v FROM jk UNION ALL SELECT t, -1, avg(v) FROM li GROUP BY t)"


def _balanced_sql() -> str:
    n, m = N // BLOCK, N // BLOCK * BOOTS
    table = f"tb AS (SELECT id // {n} AS b, x % {n} * {BLOCK} + k AS s FROM p{E.ROUNDS}, range({BLOCK}) z(k))"
    return f"WITH {_LI}, {_permutation_ctes(m, 0)}, {table} SELECT t, b AS s, round(avg(v), 4) AS v FROM li JOIN tb USING (s) GROUP BY t, b UNION ALL SELECT t, -1, round(avg(v), 4) FROM li GROUP BY t"


ORACLES |= {
    "jackknife_with_centre": f"WITH {_CENTRE} SELECT t, s, round(v, 4) AS v FROM jc",
    "error_about_centre": f"WITH {_CENTRE}, c AS (SELECT t, v AS c FROM jc WHERE s = -1) SELECT t, round(c, 4) AS central, round(sqrt((count(*) - 1) * avg((v - c) ** 2)), 4) AS error FROM jc JOIN c USING (t) WHERE s >= 0 GROUP BY t, c",
    "block_double_jackknife_covariance": f"WITH {_LI}, k AS (SELECT *, s // 7 AS own FROM li WHERE s < 49), z AS (SELECT t, sum(v) AS z FROM k GROUP BY t), p AS (SELECT t, own AS block, sum(v) AS p FROM k GROUP BY t, own), bd AS (SELECT t, block, s, (z - p - v) / 41 AS v FROM k JOIN z USING (t) JOIN p USING (t) WHERE own <> block) SELECT a.t AS t_i, b.t AS t_j, block, round(covar_pop(a.v, b.v) * (count(*) - 1), 2) AS covariance FROM bd a JOIN bd b USING (block, s) WHERE a.t <= b.t GROUP BY a.t, b.t, block",
    "asymmetric_errors": f"{_boots_sql(1)}, l AS (SELECT t, list_sort(list(v)) AS l, count(*) AS n FROM bt WHERE s >= 0 GROUP BY t) SELECT t, round(v, 4) AS central, round(l[n - 16 * n // 100] - v, 4) AS up, round(v - l[1 + 16 * n // 100], 4) AS down FROM l JOIN (SELECT t, v FROM bt WHERE s = -1) USING (t)",
    "source_average": f"WITH {_SRC} SELECT t, s, round(avg(e), 4) AS v FROM src GROUP BY t, s",
    "live_source_average": f"WITH {_SRC} SELECT t, s, round(avg(e), 4) AS v FROM src WHERE e <> 0 GROUP BY t, s",
    "source_correction": f"WITH {_SRC} SELECT t, s, round(avg(e - v), 4) AS v FROM src WHERE tsrc <> s % 4 GROUP BY t, s",
    "sample_correction": f"WITH {_LI}, a AS (SELECT t, sum(v) AS x, count(*) AS n FROM li WHERE s < 30 GROUP BY t), c AS (SELECT t, sum(q - v) AS x, count(*) AS n FROM li WHERE s >= 30 GROUP BY t) SELECT t, CASE WHEN s < 30 THEN 'S' ELSE 'C' END AS ens, s, round(CASE WHEN s < 30 THEN (a.x - v) / (a.n - 1) + c.x / c.n ELSE a.x / a.n + (c.x - (q - v)) / (c.n - 1) END, 4) AS v FROM li JOIN a USING (t) JOIN c USING (t)",
    "average_over_dimension": f"WITH {_SRC} SELECT tsrc, round(avg(v), 4) AS v FROM src WHERE t < 4 GROUP BY tsrc",
    "joined_layout": "SELECT event_type AS tag, count(*) AS size FROM events GROUP BY event_type",
    "told_apart": "WITH u AS (SELECT DISTINCT (user_id % 100)::VARCHAR AS tag, count(*) AS size FROM events GROUP BY user_id), m AS (SELECT *, count(*) OVER (PARTITION BY tag) AS n FROM u) SELECT CASE WHEN n > 1 THEN tag || '_' || size ELSE tag END AS tag, size FROM m",
    "balanced_bootstrap": _balanced_sql(),
}
