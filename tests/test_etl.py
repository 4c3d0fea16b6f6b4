import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelscope.functions.fixed_values import EMOTIONS
from reelscope.operators import cleaning, summary, topic_series, trajectory
from reelscope.plans.pipeline import run_etl
from reelscope.sources import tables

E_SCHEMA = (
    "video_id long, date string, days_since_post int, play_count long, like_count long, comment_count long, share_count long"
)


def engagement(spark, rows):
    return spark.createDataFrame([(v, f"2024-01-{1 + d:02d}", d, p, p // 10, p // 50, p // 100) for v, d, p in rows], E_SCHEMA)


def videos(spark, rows):
    text = ", ".join(f"{e} double" for e in EMOTIONS)
    schema = (
        "video_id long, author_id long, create_date string, topic string, duration double, is_english int, "
        f"word_count double, speaking_rate double, hashtag_count double, {text}, music_selected_from string"
    )
    full = [(v, a, "2024-01-01", t, 10.0, 1, 5.0, 2.0, 3.0, *[0.1] * 6, "original_sound") for v, a, t in rows]
    return spark.createDataFrame(full, schema)


def creator(spark, rows):
    schema = "author_id long, date string, follower_count long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def raw(spark):
    e = engagement(spark, [
        (1, 0, 100), (1, 1, 300), (1, 3, 700), (1, 7, 800), (1, 30, 1000),
        (1, 3, 700), (1, 3, 700),  # copies
        (2, 0, 50), (2, 3, 60),
        (3, 1, 10), (3, 3, 20), (3, 30, 90),  # no day 0: not in the summary
    ]).unionByName(spark.createDataFrame([(1, "2022-01-01", -1, 9, 9, 9, 9)], E_SCHEMA))
    return videos(spark, [(1, 7, "A"), (2, 7, None), (3, 8, "B")]), e, creator(spark, [(7, "2024-01-01", 99), (7, "2024-01-01", 99)])


def test_summary_values(raw):
    rows = {r.video_id: r for r in summary.video_summary(*raw).collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert (one.plays_day0, one.plays_day1, one.plays_day3, one.plays_day7, one.plays_day30) == (100, 300, 700, 800, 1000)
    assert one.incr_plays_3_30 == 300 and two.incr_plays_3_30 is None
    assert (one.velocity_0_1, one.velocity_1_3, one.acceleration) == (200, 200.0, 0.0)
    assert one.decay_ratio == pytest.approx(200 / 201)
    assert one.like_rate_day3 == pytest.approx(70 / 701)
    assert one.penetration_rate == pytest.approx(700 / 100)
    # missing day 1 counts as 0: first speed -50, second 30
    assert (two.velocity_0_1, two.velocity_1_3) == (-50, 30.0)
    assert two.decay_ratio == pytest.approx(30 / -49)
    assert one.creator_video_count == two.creator_video_count == 2
    assert one.creator_median_plays30 == 1000 and one.creator_avg_plays30 == 1000.0


def test_decay_ratio_with_vanishing_denominator(spark):
    v = spark.createDataFrame([(1, 0, 9)], "plays_day0 int, plays_day1 int, plays_day3 int")
    assert summary.decay_ratio(v).first().decay_ratio == 0.0


def test_dedup_takes_the_smallest_row(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "z"), (1, 3, "c"), (2, None, "q")], "k int, x int, y string")
    got = {tuple(r) for r in cleaning.dedup_keys(df, ["k"]).collect()}
    assert got == {(1, 3, "c"), (2, None, "q")}


def test_summary_counts_deduplicated_rows_only(spark, raw):
    """Two rows of one video and date that disagree on the day: only the smaller one is there for the pivot."""
    v, e, c = raw
    one = e.where("days_since_post = 0").limit(1)
    video = one.first()["video_id"]
    twice = one.withColumns({"date": F.lit("2030-01-01").cast(e.schema["date"].dataType), "play_count": F.lit(50).cast(e.schema["play_count"].dataType)})
    rows = twice.withColumn("days_since_post", F.lit(2)).unionByName(
        twice.withColumns({"days_since_post": F.lit(3), "play_count": F.lit(60).cast(e.schema["play_count"].dataType)})
    ).unionByName(one)
    rows = rows.select([F.col(f.name).cast(f.dataType) for f in e.schema.fields])
    clean = cleaning.clean_engagement(rows)
    kept = {r["days_since_post"] for r in clean.where(F.col("video_id") == video).collect()}
    got = summary.pivot_snapshots(clean).first()
    assert len(kept) == 2
    assert (got["plays_day3"] == 60) == (3 in kept) and (3 in kept or got["plays_day3"] is None)
    plan = summary.pivot_snapshots(spark.createDataFrame([], clean.schema))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_optional_columns_may_be_absent(spark):
    v = spark.createDataFrame([(1, 2, "2024-01-01", "A")], "video_id long, author_id long, create_date string, topic string")
    assert cleaning.clean_videos(v).columns == ["video_id", "author_id", "create_date", "topic"]


def test_prior_stats_see_only_earlier_dates(spark):
    v = spark.createDataFrame(
        [(1, 9, dt.date(2024, 1, 1), 10), (2, 9, dt.date(2024, 1, 1), 30), (3, 9, dt.date(2024, 1, 2), None), (4, 9, dt.date(2024, 1, 5), 5)],
        "video_id long, author_id long, create_date date, plays_day30 long",
    )
    got = {r.video_id: (r.prior_video_count, r.prior_avg_plays30) for r in summary.creator_stats_prior(v).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (2, 20.0), 4: (3, 20.0)}


def test_windows(raw):
    rows = trajectory.trajectory_features(cleaning.clean_engagement(raw[1])).where("video_id = 1").orderBy("days_since_post").collect()
    assert [r.play_lag1 for r in rows] == [None, 100, 300, 700, 800]
    assert [r.daily_play_inc for r in rows] == [100, 200, 400, 100, 200]
    assert rows[4].play_roll3_avg == pytest.approx(600.0) and rows[0].play_roll3_avg is None


def test_panel_interpolates_between_neighbours(raw):
    rows = trajectory.panel_trajectory(cleaning.clean_engagement(raw[1]), steps=(0, 2, 5, 30, 40)).where("video_id = 1").orderBy("step").collect()
    assert [r.plays for r in rows] == [100.0, 500.0, 750.0, 1000.0, 1000.0]


def test_fill_uses_last_then_next_value(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day, 5.0), ("A", day + dt.timedelta(3), 9.0), ("B", day, 1.0)]
    dense = topic_series.daily_series(spark.createDataFrame(rows, "topic string, date date, v double"), "v")
    got = [r.value for r in dense.where("topic = 'A'").orderBy("date").collect()]
    assert got == [5.0, 5.0, 5.0, 9.0]


def test_run_etl_writes_readable_tables(spark, raw, tmp_path):
    folder = str(tmp_path)
    for name, df in zip(tables.RAW_TABLES, raw):
        tables.write_table(df, folder, name)
    run_etl(spark, folder, folder)
    v, topics = tables.scan_processed(spark, folder)
    assert v.count() == 2
    day3 = topics.where((F.col("date") == "2024-01-04") & (F.col("topic") == "A")).first()
    assert (day3.active_videos, day3.total_plays) == (1, 700)
    assert tables.row_counts({"v": v}).first().row_count == 2


def test_bundle_is_reused_until_forced(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"a": spark.range(len(calls))}

    folder = str(tmp_path / "b")
    assert tables.reuse_bundle(spark, folder, ["a"], build)["a"].count() == 1
    assert tables.reuse_bundle(spark, folder, ["a"], build)["a"].count() == 1
    assert tables.reuse_bundle(spark, folder, ["a"], build, force=True)["a"].count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_of_the_engagement_table(spark, raw, tmp_path):
    """Dedup, pivot and join with videos share it, also without broadcasts, and no aggregate over that table sorts."""
    v, e, _ = raw
    e.write.parquet(str(tmp_path / "e"))
    v.write.parquet(str(tmp_path / "v"))
    e, v = spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "v"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, x in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, x)  # the plan as it runs
    try:
        clean = cleaning.clean_engagement(e)
        for result, more in ((clean, 0), (summary.pivot_snapshots(clean), 0),
                             (cleaning.join_engagement_video(clean, cleaning.clean_videos(v)), 1)):
            lines = plan_of(result).splitlines()
            shuffles = [x for x in lines if "Exchange hashpartitioning" in x and "Reused" not in x]
            assert len(shuffles) == 1 + more, lines
        sorted_ = [x for x in plan_of(clean).splitlines() if "SortAggregate" in x]
        assert all("struct(" in x for x in sorted_) and len(sorted_) == 2  # over the rows that differ
        assert clean.count() == 10
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)


def test_dedup_of_numbers_equals_the_ordered_choice(spark):
    import random

    chance = random.Random(2)
    rows = [tuple(chance.choice([None, 1, 2]) for _ in range(2)) + (chance.choice([None, 0, 1]), chance.choice([None, 0, 5]), chance.choice([None, 0.0, 2.5])) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "a int, b int, x int, y long, z double").repartition(6)
    order = lambda r: tuple((x is not None, x or 0) for x in r[2:])  # noqa: E731  nulls first
    want = {}
    for r in rows:
        want[r[:2]] = min(want.get(r[:2], r), r, key=order)
    for by in (None, "a", "b"):
        got = [tuple(r) for r in cleaning.dedup_keys(df, ["a", "b"], by).collect()]
        known = {r for k, r in want.items() if by is None or k["ab".index(by)] is not None}
        assert len(got) == len(known) and set(got) == known
    assert cleaning.dedup_keys(df.select("a", "b"), ["a", "b"]).count() == len(want)
    assert cleaning.dedup_keys(df.where("false"), ["a", "b"]).count() == 0


def test_only_differing_keys_are_compared_whole(spark, raw, tmp_path):
    """Whole rows are made distinct behind the lookup of the keys whose rows differ, not before it."""
    raw[1].write.parquet(str(tmp_path / "e"))
    clean = cleaning.clean_engagement(spark.read.parquet(str(tmp_path / "e")))
    lines = clean._jdf.queryExecution().analyzed().toString().splitlines()
    whole = [i for i, x in enumerate(lines) if "Distinct" in x or "Deduplicate" in x]
    assert whole
    for i in whole:
        below = next(x for x in lines[i + 1:] if "Project" not in x)
        assert "Join" in below, below
