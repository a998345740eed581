"""Edge fixtures of the preparation chain (FIXTURES section 6)."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators.prep import PrepConfig, Preprocessor
from tessera.operators.roles import Roles, role_report


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_even_median_fill(spark):
    df = _df(spark, [(i, "No", v) for i, v in enumerate([1.0, 2.0, 3.0, 10.0, None])], "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",))).fit(df)
    assert m.medians["x"] == 2.5
    filled = [r[0] for r in df.select(m.imputed("x", dict(df.dtypes))).collect()]
    assert sorted(filled) == [1.0, 2.0, 2.5, 3.0, 10.0]


def test_mode_tie_takes_smallest(spark):
    df = _df(spark, [(i, "No", v) for i, v in enumerate(["2", "2", "1", "1", None])], "k long, y string, c string")
    m = Preprocessor(Roles("k", "y", categorical=("c",))).fit(df)
    assert m.modes["c"] == "1"


def test_nan_is_missing(spark):
    df = _df(spark, [(0, "No", float("nan")), (1, "No", float("nan")), (2, "No", 1.0), (3, "No", None)],
             "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",))).fit(df)
    assert m.medians["x"] == 1.0
    vals = [r[0] for r in df.select(m.imputed("x", dict(df.dtypes))).collect()]
    assert vals == [1.0, 1.0, 1.0, 1.0]


def test_zero_iqr_collapses_and_scales_to_zero(spark):
    df = _df(spark, [(i, "No", v) for i, v in enumerate([0.0] * 8 + [5.0])], "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",))).fit(df)
    d = dict(df.dtypes)
    assert [r[0] for r in df.select(m.capped("x", d)).collect()] == [0.0] * 9
    assert m.n_capped["x"] == 1
    assert all(r[0] == 0.0 for r in df.select(m.scaled("x", d)).collect())


def test_skip_zero_iqr_option(spark):
    df = _df(spark, [(i, "No", v) for i, v in enumerate([0.0] * 8 + [5.0])], "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",)), PrepConfig(skip_zero_iqr=True)).fit(df)
    assert max(r[0] for r in df.select(m.capped("x", dict(df.dtypes))).collect()) == 5.0


def test_constant_column_scales_to_zero(spark):
    df = _df(spark, [(i, "No", 3.0) for i in range(3)], "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",))).fit(df)
    assert [r[0] for r in df.select(m.scaled("x", dict(df.dtypes))).collect()] == [0.0, 0.0, 0.0]


def test_label_codes_follow_string_order(spark):
    vals = ["10.0", "2.0", "-6.0", "1.0", "-9.0"]
    df = _df(spark, [(i, "No", v) for i, v in enumerate(vals)], "k long, y string, b string")
    m = Preprocessor(Roles("k", "y", binary=("b",))).fit(df)
    codes = [r[0] for r in df.orderBy("k").select(m.code("b", dict(df.dtypes))).collect()]
    assert codes == [3, 4, 0, 2, 1]


def test_target_map(spark):
    df = _df(spark, [(0, "Yes"), (1, "No"), (2, "Maybe"), (3, None)], "k long, y string")
    m = Preprocessor(Roles("k", "y")).fit(df)
    assert [r[0] for r in df.orderBy("k").select(m.target()).collect()] == [1, 0, None, None]


def test_one_hot_keeps_all_levels_sorted(spark):
    df = _df(spark, [(0, "No", "b"), (1, "No", "a"), (2, "No", None), (3, "No", "a")], "k long, y string, c string")
    m = Preprocessor(Roles("k", "y", categorical=("c",))).fit(df)
    out = m.transform(df).orderBy("k")
    assert out.columns == ["k", "c_a", "c_b", "label"]
    assert [(r.c_a, r.c_b) for r in out.collect()] == [(0, 1), (1, 0), (1, 0), (1, 0)]


def test_two_roles_rejected_and_reported(spark):
    roles = Roles("k", "y", binary=("c",), categorical=("c",))
    df = _df(spark, [(0, "No", "1", 1.0)], "k long, y string, c string, extra double")
    with pytest.raises(ValueError):
        roles.validate(df)
    rep = {r.column_name: (r.role, r.problem) for r in role_report(spark, df, roles).collect()}
    assert rep["c"] == ("binary,categorical", "two roles")
    assert rep["extra"] == (None, "not classified")


def test_fit_uses_population_sigma(spark):
    xs = [1.0, 2.0, 3.0, 4.0]
    df = _df(spark, [(i, "No", v) for i, v in enumerate(xs)], "k long, y string, x double")
    m = Preprocessor(Roles("k", "y", numeric=("x",))).fit(df)
    mu = sum(xs) / 4
    sd = math.sqrt(sum((x - mu) ** 2 for x in xs) / 4)
    assert m.scale["x"][0] == pytest.approx(mu) and m.scale["x"][1] == pytest.approx(sd)


def test_scratch_root_refuses_local_folder_on_cluster(monkeypatch):
    import tessera.session as S

    class Conf:
        def get(self, k, default=None):
            return None

    class SC:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        conf = Conf()
        sparkContext = SC()

    with pytest.raises(RuntimeError):
        S.scratch_root(Fake())


def test_observed_roles(spark):
    from tessera.operators.roles import observed_roles

    rows = [(1, "Yes", "a", "x", 1.0), (2, "No", "a", "y", None), (2, None, "b", "z", 2.0)]
    df = spark.createDataFrame(rows, "k int, t string, two string, many string, num double")
    got = {r.column_name: (r.n_rows, r.n_null, r.n_levels, r.fits)
           for r in observed_roles(df, Roles("k", "t", ("two", "many"), ("gone",), ("num",))).collect()}
    assert got == {"k": (3, 0, 2, False), "t": (3, 1, 2, True), "two": (3, 0, 2, True), "many": (3, 0, 3, False), "num": (3, 1, 2, True)}
    assert observed_roles(df.limit(0), Roles("k", "t")).count() == 0
