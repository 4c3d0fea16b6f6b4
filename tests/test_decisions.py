import pytest
from pyspark.sql import functions as F

from reelscope.functions import fixed_values as fixed
from reelscope.operators import decisions

LIVE = "plays_day0 double, plays_day1 double, plays_day3 double, likes_day3 double, pred_incr double"


@pytest.mark.parametrize("row, score, status", [
    ((10000.0, 35000.0, 95000.0, 8200.0, 25000.0), 99.0, "Boost"),
    ((500.0, 1100.0, 1800.0, 140.0, 5000.0), 50.0, "Let Grow"),
    ((300.0, 350.0, 370.0, 12.0, 500.0), 40.0, "Rethink"),
])
def test_presets(spark, row, score, status):
    got = decisions.triage_score(spark.createDataFrame([row], LIVE)).first()
    assert got.score == score and got.status.startswith(status)


def test_preset_diagnostics(spark):
    got = decisions.triage_score(spark.createDataFrame([(500.0, 1100.0, 1800.0, 140.0, 5000.0)], LIVE)).first()
    assert (got.decay_ratio, got.velocity_1_3, got.acceleration, got.like_rate_pct) == (1.63, 350.0, -250.0, 7.77)


def test_score_stays_in_bounds(spark):
    grid = spark.range(20000).select(*[
        (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100000)).cast("double")).alias(c)
        for i, c in enumerate(("plays_day0", "plays_day1", "plays_day3", "likes_day3", "pred_incr"))
    ])
    low, high = decisions.triage_score(grid).agg(F.min("score"), F.max("score")).first()
    assert 5.0 <= low and high <= 99.0


def test_tier_edges(spark):
    values = [-1.0, 0.0, 999.9, 1000.0, 15000.0, 100000.0, None]
    rows = decisions.virality_tier(spark.createDataFrame([(x,) for x in values], "pred_incr double")).collect()
    t = [x[0] for x in fixed.TIERS]
    assert [r.tier for r in rows] == [t[3], t[0], t[0], t[1], t[2], t[3], None]
    assert rows[1].tier_badge == "gray"
    assert decisions.tier_table(spark).count() == 4


def test_draft_defaults_chain(spark):
    got = decisions.draft_defaults(spark.createDataFrame([(1, 1000.0, None), (2, None, 10.0)], "draft_id int, creator_median_plays30 double, plays_day3 double"))
    a, b = got.orderBy("draft_id").collect()
    assert (a.plays_day0, a.plays_day3, a.topic) == (400.0, 950.0, "Beauty_Fashion")
    assert a.plays_day7 == pytest.approx(950 * 1.15) and a.likes_day3 == pytest.approx(76.0)
    assert (b.creator_median_plays30, b.plays_day3) == (500.0, 10.0)


def test_forecast_interval_is_ordered(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0, 9.0), (1.0, -3.0, 4.0, -1.0)], "plays_day3 double, m double, l double, h double")
    for r in decisions.bounded_forecast(df, "m", "l", "h").collect():
        assert 0 <= r.pred_p10 <= r.pred_median <= r.pred_p90
        assert r.total_expected == pytest.approx(1.0 + r.pred_median)


def test_forecast_curve_ends_at_the_total(spark):
    df = spark.createDataFrame([(1, 100.0, 50.0, 10.0, 90.0)], "video_id int, plays_day3 double, pred_median double, pred_p10 double, pred_p90 double")
    rows = decisions.forecast_curve(df).orderBy("day").collect()
    assert [r.day for r in rows] == [3, 7, 14, 21, 30]
    assert rows[0].median == 100.0 and rows[-1].median == 150.0 and rows[1].median == pytest.approx(100 + 50 * 0.25**0.7)


def test_tips(spark):
    rows = [(1, "Life_Hacks", 99.0, "High", 2.0, 10.0, 30.0), (2, "X", 5.0, "Medium", 3.0, 10.0, 30.0), (3, "X", 20.0, "Low", 2.2, None, None)]
    df = spark.createDataFrame(rows, "draft_id int, topic string, duration double, hook string, speaking_rate double, p25_duration double, p75_duration double")
    tips = {}
    for r in decisions.draft_tips(df).orderBy("draft_id", "tip_no").collect():
        tips.setdefault(r.draft_id, []).append(r.tip)
    assert len(tips[1]) == 3 and "In Life Hacks, most top-performing videos are between 10 and 30 seconds" in tips[1][0]
    assert len(tips[2]) == 1 and "Very quick video (5s)" in tips[2][0]
    assert len(tips[3]) == 2 and "optimal length range" in tips[3][0]


def test_unknown_topic_becomes_the_fallback(spark):
    profiles = spark.createDataFrame([("A", 5, 1.0), ("Others", 9, 2.0)], "topic string, video_count long, median_duration double")
    df = spark.createDataFrame([(1, "A"), (2, "?"), (3, None)], "draft_id int, topic string")
    got = {r.draft_id: (r.topic, r.median_duration) for r in decisions.profile_lookup(df, profiles).collect()}
    assert got == {1: ("A", 1.0), 2: ("Others", 2.0), 3: ("Others", 2.0)}


def test_priorities(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0)], "id int, v double")
    got = {r.id: r.priority for r in decisions.priority_rank(df, "v", "id").collect()}
    assert got == {2: "#1", 3: "#2", 1: "#3"}


def test_planner_levels(spark):
    df = spark.createDataFrame([("High", "Low", "Medium", "Low")], "surprise_level string, joy_level string, sadness_level string, fear_level string")
    r = decisions.planner_levels(df).first()
    assert (r.surprise, r.joy, r.sadness, r.fear, r.anger, r.disgust) == (0.8, 0.1, 0.45, 0.1, 0.02, 0.01)


def test_triage_runs_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(10000.0, 35000.0, 95000.0, 8200.0, 25000.0)], LIVE).write.parquet(source)
    stream = decisions.virality_tier(decisions.triage_score(spark.readStream.schema(LIVE).parquet(source)))
    query = (
        stream.writeStream.format("memory").queryName("triaged")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    query.processAllAvailable()
    query.stop()
    assert spark.table("triaged").first().score == 99.0
