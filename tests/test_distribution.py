import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelscope.operators import distribution as D


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        # one group and one value hold about a third of all rows
        "g": np.where(rng.random(n) < 0.35, "hot", rng.choice(list("abcdef"), n)),
        "x": np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(0, 50, n), 1)),
        "y": np.exp(rng.normal(3, 2, n)),
    })
    pdf.loc[rng.random(n) < 0.1, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.05, "g"] = None
    df = spark.createDataFrame(pdf).withColumns({
        "x": F.when(~F.isnan("x"), F.col("x")), "g": F.when(F.col("g") != "NaN", F.col("g")),
    })
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), None)
    return pdf, df.cache()


OUTPUTS = {
    "q0": ("quantile", "x", 0.0), "q25": ("quantile", "x", 0.25), "q50": ("quantile", "x", 0.5),
    "q97": ("quantile", "y", 0.97), "n": ("count", "x"), "rows": ("count", D.ROWS), "s": ("sum", "y"),
    "m": ("mean", "x"),
}


def test_profile_equals_pandas_for_light_and_heavy_groups(values):
    pdf, df = values
    got = D.profile(df, ["g"], {"x": "x", "y": "y"}, OUTPUTS).toPandas().set_index("g").sort_index()
    by = pdf.groupby("g")
    want = pd.DataFrame({
        "q0": by["x"].min(), "q25": by["x"].quantile(0.25), "q50": by["x"].median(), "q97": by["y"].quantile(0.97),
        "n": by["x"].count(), "rows": by.size(), "s": by["y"].sum(), "m": by["x"].mean(),
    }).sort_index()
    assert list(got.index) == list(want.index)
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_profile_without_groups(values):
    pdf, df = values
    row = D.profile(df, [], {"x": "x", "y": "y"}, OUTPUTS).first()
    assert row.q50 == pytest.approx(pdf["x"].median())
    assert row.q97 == pytest.approx(pdf["y"].quantile(0.97))
    assert row.rows == len(pdf) and row.n == pdf["x"].count()


def test_profile_of_nothing_is_null(spark):
    empty = spark.createDataFrame([(None,)], "x double")
    assert D.medians(empty, {"x": "x"}).first().x is None


def test_rank_percent_equals_pandas(values):
    pdf, df = values
    got = D.with_rank_percent(
        df, "id", {"rx": F.coalesce("x", F.lit(0.0)), "rg": "x", "ry": "y"}, {"rg": "g"}
    ).toPandas().sort_values("id")
    np.testing.assert_allclose(got["rx"], pdf["x"].fillna(0).rank(pct=True))
    np.testing.assert_allclose(got["ry"], pdf["y"].rank(pct=True))
    want = pdf.groupby("g")["x"].rank(pct=True)
    np.testing.assert_allclose(got["rg"].astype(float), want)


def test_number_rows_is_a_total_order(values):
    pdf, df = values
    for descending in (False, True):
        got = D.number_rows(df, "x", "id", "place", descending).toPandas().set_index("id")["place"]
        want = pdf.sort_values(["x", "id"], ascending=[not descending, True], na_position="last")["id"]
        assert list(got.sort_values().index) == list(want)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_lookup_join_keeps_every_row(values, hot):
    pdf, df = values
    table = df.where("g is not null and g <> 'f'").groupBy("g").agg(F.count("*").alias("w"), F.avg("y").alias("mean_y"))
    got = D.lookup_join(df, table.drop("w"), ["g"], hot=hot).toPandas().sort_values("id")
    assert len(got) == len(pdf)
    means = pdf[pdf["g"] != "f"].groupby("g")["y"].mean()
    np.testing.assert_allclose(got["mean_y"].astype(float), pdf["g"].map(means).astype(float))


@pytest.mark.parametrize("hot_key", ["known", "unknown", None])
def test_lookup_join_spreads_hot_keys(spark, hot_key):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 80_000, 1, 8).select(
            "id", F.when(F.col("id") % 10 > 0, F.lit(hot_key)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k")
        )
        table = spark.range(0, 80_000, 10).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("x"))
        table = table.unionByName(spark.createDataFrame([("known", -1)], "k string, x long"))
        joined = D.lookup_join(rows, table, ["k"], hot=100)
        assert joined.count() == 80_000
        sizes = joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert max(sizes) <= 2 * 80_000 / 8
        found = {r["x"]: r["n"] for r in joined.groupBy("x").agg(F.count("*").alias("n")).collect()}
        assert found[-1 if hot_key == "known" else None] == 72_000 and found[70] == 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_number_rows_with_19_digit_and_text_ids_under_two_layouts(spark):
    base = spark.range(0, 4000, 1, 4).select((F.col("id") * 7 + 7_300_000_000_000_000_000).alias("long"), F.lit("2024-01-01").alias("d"))
    base = base.withColumn("text", F.concat(F.lit("video_"), F.col("long").cast("string")))
    for tie in ("long", "text"):
        expected = sorted(r[tie] for r in base.collect())
        for layout in (base.repartition(3, "text"), base.repartition(13)):
            got = {r[tie]: r["place"] for r in D.number_rows(layout, "d", tie, "place").collect()}
            assert [x for x, _ in sorted(got.items(), key=lambda kv: kv[1])] == expected
            assert sorted(got.values()) == list(range(1, 4001))


def test_narrow_values_are_cut_into_even_ranges(spark):
    rows = spark.range(0, 80_000, 1, 8).select((F.lit(0.5) + F.col("id") * 1e-9).alias("v"), F.lit(1).alias("n"), F.lit("g").alias("g"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in D.with_ranges(rows, ["g"]).groupBy("bucket").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert len(sizes) == 8 and max(sizes) < 20_000
