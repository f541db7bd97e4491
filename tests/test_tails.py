"""Tail functions against the commons-math library that Spark ships."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from statistics import NormalDist

from statweave.functions import tails


def law(spark, name, *args):
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*args)


@pytest.mark.parametrize("df", [1.0, 2.5, 10.0, 300.0, 40072.0])
@pytest.mark.parametrize("t", [0.0, 0.3, 1.96, 5.0])
def test_student(spark, df, t):
    want = 2 * law(spark, "TDistribution", df).cumulativeProbability(-t)
    assert tails.student_two_sided(t, df) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("d1,d2", [(1.0, 5.0), (3.0, 40.0), (2.0, 60000.0)])
@pytest.mark.parametrize("f", [0.1, 1.0, 3.7, 20.0])
def test_fisher(spark, d1, d2, f):
    want = 1 - law(spark, "FDistribution", d1, d2).cumulativeProbability(f)
    assert tails.fisher_upper(f, d1, d2) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("df", [1.0, 4.0, 99.0, 5000.0])
@pytest.mark.parametrize("share", [0.2, 0.9, 1.0, 1.3])
def test_chi_square(spark, df, share):
    x = df * share
    want = 1 - law(spark, "ChiSquaredDistribution", df).cumulativeProbability(x)
    assert tails.gamma_sf(df / 2, x / 2) == pytest.approx(want, abs=1e-9)


def test_quantiles():
    p = np.array([1e-12, 0.001, 0.3, 0.5, 0.925, 0.99999])
    np.testing.assert_allclose(tails.normal_quantile(p), [NormalDist().inv_cdf(v) for v in p], atol=1e-14)
    for df in (1, 2, 5, 30, 5000):
        assert tails.student_two_sided(tails.student_quantile(0.95, df), df) == pytest.approx(0.05, abs=1e-10)


def test_column_expressions(spark):
    df = spark.createDataFrame([(float(z),) for z in np.linspace(-7, 7, 57)], "z double")
    for z, cdf, p in df.select("z", tails.normal_cdf_of("z"), tails.normal_two_sided("z")).collect():
        assert cdf == pytest.approx(NormalDist().cdf(z), rel=1e-12, abs=1e-16)
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)
    lam = spark.createDataFrame([(0.1,), (0.5,), (1.0,), (2.0,)], "l double").select(tails.kolmogorov_sf("l"))
    assert [r[0] for r in lam.collect()] == pytest.approx([1.0, 0.9639452436648751, 0.26999967167735456, 0.0006709252557796953])
