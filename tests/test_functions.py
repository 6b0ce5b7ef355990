"""Formulas, printed results and tail probabilities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.functions import expressions as X
from samplewright.functions import printing as P
from samplewright.functions import special as D


@pytest.mark.parametrize(
    ("formula", "value"),
    [("1 + 2*3", 7), ("-2^2", -4), ("2^3^2", 512), ("2^-1", 0.5), ("(1+2)*3/2", 4.5), ("sqrt(x) + log10(100)", 4), ("exp(log(x))", 4), ("pow(x, 2) - y", 13), ("sin(0) + cos(0) + tan(0)", 1),
     ("1/(x - 4)", None), ("sqrt(-x)", None), ("log(0)", None), ("(-x)^0.5", None), ("1e-1*x", 0.4), ("--x", 4)],
)
def test_formulas(spark, formula, value):
    got = spark.range(1).select(X.column(formula, {"x": F.lit(4.0), "y": F.lit(3.0)}).alias("v")).first()["v"]
    assert got == (None if value is None else pytest.approx(value))


@pytest.mark.parametrize("formula", ["x +", "z + 1", "__import__('os')", "x.y", "x[0]", "1 if x else 2", "lambda: 1", "'a'", "x; y", "foo(x)", "x and y"])
def test_what_is_no_formula(spark, formula):
    with pytest.raises((ValueError, SyntaxError)):
        X.column(formula, {"x": F.lit(1.0), "y": F.lit(1.0)})


def test_calculated_needs_all_quantities_at_all_keys(spark):
    frame = lambda rows: spark.createDataFrame(rows, "s long, v double")
    a, b = frame([(-1, 1.0), (0, 2.0), (1, None)]), frame([(-1, 3.0), (0, 5.0), (1, 7.0)])
    assert {r["s"]: r["v"] for r in X.calculated("a*b", {"a": a, "b": b}, ["s"]).collect()} == {-1: 3.0, 0: 10.0, 1: None}
    with pytest.raises(Exception, match="at s = 1"):
        X.calculated("a + b", {"a": a.where("s < 1"), "b": b}, ["s"]).collect()
    with pytest.raises(ValueError, match="no value for c"):
        X.calculated("a + c", {"a": a}, ["s"])
    with pytest.raises(ValueError, match="x alone"):
        X.applied(a, "y + 1")


@pytest.mark.parametrize(
    ("central", "error", "options", "text"),
    [(1.23456, 0.0123, {"figures": 2, "of": "error"}, " 1.235(12)"), (-1.23456, 0.0123, {"figures": 3}, "-1.23(1)"), (123.456, 7.89, {"figures": 2, "of": "error"}, " 123.5(7.9)"), (0.0, 0.015, {"figures": 2, "of": "error"}, " 0.000(15)"),
     (123456.0, 789.0, {"figures": 3}, " 1.23(1)\\times 10^{5}"), (0.00001234, 0.00000056, {"figures": 2, "of": "error"}, " 1.234(56)\\times 10^{-5}"), (5.0, 0.0, {"figures": 3}, " 5.00(0)"), (1234.5, 45.6, {"round_power": 1}, " 1230(50)"),
     (9.996, 0.004, {"figures": 1, "of": "error"}, " 9.996(4)"), (None, 1.0, {}, None), (2.0, None, {}, None)],
)
def test_published(spark, central, error, options, text):
    row = spark.createDataFrame([(central, error)], "c double, e double").select(P.published(F.col("c"), F.col("e"), **options).alias("t")).first()
    assert row["t"] == text


def test_other_printers(spark):
    df = spark.createDataFrame([(1.5, 0.25)], "c double, e double")
    got = df.select(P.basic(F.col("c"), F.col("e")), P.basic(F.col("c"), F.col("e"), 20), P.published_value(F.col("c") * 1e6, 2), P.published_value(F.col("e"), 1), P.published(F.col("c"), F.col("e"), 2, "error", width=14)).first()
    assert tuple(got) == ("(1.5 +- 0.25)", "(1.5 +- 0.25)       ", " 1.5\\times 10^{6}", " 0.3", " 1.50(25)     ")


def test_chi_square_tails_in_closed_form():
    x = np.linspace(0, 60, 301)
    assert np.allclose(D.chi2_p_value(x, 2), np.exp(-x / 2), atol=1e-14)
    assert np.allclose(D.chi2_p_value(x, 6), np.exp(-x / 2) * (1 + x / 2 + x * x / 8), atol=1e-14)
    odd = [math.erfc(math.sqrt(v / 2)) for v in x]
    assert np.allclose(D.chi2_p_value(x, 1), odd, atol=1e-13)
    assert np.allclose(D.chi2_p_value(x, 3), odd + np.sqrt(2 * x / np.pi) * np.exp(-x / 2), atol=1e-13)
    assert np.isnan(D.chi2_p_value([-1.0, 1.0], [2, 0])).all()


def test_f_and_t_square_tails():
    x = np.linspace(0, 30, 101)
    for d in (1, 3, 10, 49):
        assert np.allclose(D.f_cdf(x, 2, d), 1 - (1 + 2 * x / d) ** (-d / 2), atol=1e-13)
    assert np.allclose(D.f_cdf(x, 1, 1), 2 / np.pi * np.arctan(np.sqrt(x)), atol=1e-13)
    assert np.allclose(D.t2_p_value(x, 1, 49), 1 - D.f_cdf(x, 1, 49), atol=1e-13)
    assert np.isnan(D.t2_p_value(1.0, 5, 4)) and D.t2_p_value(1.0, 5, 5) > 0
    rng = np.random.default_rng(1)
    samples = rng.chisquare(5, 200_000) / 5 / (rng.chisquare(8, 200_000) / 8)
    assert abs((samples < 1.3).mean() - D.f_cdf(1.3, 5, 8)) < 0.005


def test_tails_of_columns(spark):
    df = spark.createDataFrame([(4.0, 2), (None, 2), (-1.0, 2)], "x double, dof int")
    assert [r[0] for r in df.select(D.chi2_p(F.col("x"), F.col("dof"))).collect()] == [pytest.approx(math.exp(-2)), None, None]


def test_densities_are_slopes_of_probabilities():
    x, h = np.linspace(0.05, 30, 400), 1e-5
    for density, below, numbers in ((D.chi2_pdf, D.chi2_cdf, (1,)), (D.chi2_pdf, D.chi2_cdf, (7,)), (D.f_pdf, D.f_cdf, (3, 8)), (D.f_pdf, D.f_cdf, (10, 2)), (D.t2_pdf, D.t2_cdf, (4, 30)), (D.t2_pdf, D.t2_cdf, (1, 5))):
        assert density(x, *numbers) == pytest.approx((below(x + h, *numbers) - below(x - h, *numbers)) / (2 * h), rel=1e-5, abs=1e-9)
        assert density(np.array([-1.0]), *numbers) == 0
    assert D.t2_range(2.0, 5.0, 4, 30) == pytest.approx(D.t2_cdf(5.0, 4, 30) - D.t2_cdf(2.0, 4, 30))
    grid = np.linspace(1e-6, 4000, 4_000_001)
    density = D.t2_pdf(grid, 3, 40)
    mean = np.trapezoid(grid * density, grid)
    assert D.t2_mean(3, 40) == pytest.approx(mean, rel=1e-4)


def test_distributions_without_a_value(spark):
    for wrong in (D.chi2_pdf(1.0, -1), D.f_pdf(1.0, 0, 3), D.t2_pdf(1.0, 5, 3), D.t2_cdf(1.0, 5, 3), D.t2_mean(5, 6), D.t2_variance(3, 6), D.chi2_pdf(np.nan, 3)):
        assert np.isnan(wrong)
    df = spark.createDataFrame([(1.0, 2, 9.0), (None, 2, 9.0), (1.0, 5, 3.0)], "x double, p int, n double")
    got = [r[0] for r in df.select(D.distribution("t2_pdf", df["x"], df["p"], df["n"])).collect()]
    assert got[0] > 0 and got[1:] == [None, None]
