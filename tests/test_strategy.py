import datetime as dt

import pytest

from reelscope.functions import columns as C
from reelscope.functions import fixed_values as fixed
from reelscope.operators import profiles, strategy


def test_bucket_edges_belong_to_the_lower_bucket(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 2.0, 2.5, 200.0, 201.0, None)], "x double")
    got = [r[0] for r in df.select(C.bucket_label("x", fixed.HASHTAG_BUCKETS)).collect()]
    names = [b[0] for b in fixed.HASHTAG_BUCKETS]
    assert got == [None, names[0], names[1], names[1], names[2], names[5], None, None]


def test_music_rules_take_the_first_hit(spark):
    words = ["ORIGINAL_recommend", "single_song_search", "Recommend", "my_search", "effect", None]
    df = spark.createDataFrame([(w,) for w in words], "m string")
    got = [r[0] for r in df.select(C.music_category("m")).collect()]
    assert got == [x[1] for x in fixed.MUSIC_RULES] + [fixed.MUSIC_OTHER] * 2


def test_archetype_edges(spark):
    df = spark.createDataFrame([(80, 100), (79, 100), (45, 100), (44, 100), (None, 100)], "a long, b long")
    got = [r[0] for r in df.select(C.archetype("a", "b")).collect()]
    assert got == [fixed.FLASH, fixed.STEADY, fixed.STEADY, fixed.EVERGREEN, None]


def test_archetypes_need_both_days_and_views(spark):
    rows = [(1, 3, 10), (1, 30, 49), (2, 3, 10), (2, 30, 50), (3, 30, 90), (4, 3, 5)]
    e = spark.createDataFrame(rows, "video_id long, days_since_post int, play_count long")
    assigned = strategy.archetype_assign(e)
    assert [r.video_id for r in assigned.collect()] == [2]
    share = strategy.archetype_shares(assigned, display=True).first()
    assert (share.archetype, share.share_pct, share.sample_size) == (fixed.EVERGREEN, 100.0, 1)
    days = {r.day for r in strategy.archetype_curves(assigned).collect()}
    assert days == {3, 30}


@pytest.fixture(scope="module")
def authors(spark):
    day = dt.date(2024, 1, 1)
    creator = spark.createDataFrame(
        [(1, day, 100), (1, day + dt.timedelta(14), 600), (2, day, None), (2, day + dt.timedelta(1), 50), (3, day, 10)],
        "author_id long, date date, follower_count long",
    )
    v = spark.createDataFrame(
        [(1, 1, "B", 5000, 30.0), (2, 1, "A", 15000, 10.0), (3, 2, None, None, None), (4, 9, "A", 1, 1.0)],
        "video_id long, author_id long, topic string, plays_day30 long, duration double",
    )
    return strategy.join_author_span_videos(creator, v).cache()


def test_author_measures(authors):
    rows = {r.author_id: r for r in authors.collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert one.primary_topic == "A"  # tie → first by name
    assert one.followers_per_10k_views == pytest.approx(500 / 20000 * 10000)
    assert one.videos_per_week == pytest.approx(1.0)
    # the null follower row is skipped at both ends; no plays at all count as 0
    assert (two.follower_gain, two.total_plays, two.median_plays, two.primary_topic) == (0, 0.0, None, None)


def test_empty_buckets_stay_in_the_reports(authors):
    rows = strategy.posting_cadence(authors, display=True).collect()
    assert [r.cadence_bucket for r in rows] == [b[0] for b in fixed.CADENCE_BUCKETS]
    assert [r.creators_count for r in rows] == [2, 0, 0, 0, 0]
    durations = strategy.follower_conversion_duration(authors).collect()
    assert [r.median_conversion for r in durations] == [250.0, None, None]


def test_topic_conversion_drops_authors_without_topic(authors):
    rows = strategy.follower_conversion_topic(authors, display=True).collect()
    assert [(r.primary_topic, r.creator_count, r.median_conversion) for r in rows] == [("A", 1, 250.0)]


def test_library_search_labels_and_limits(spark):
    v = spark.createDataFrame(
        [(i, "t", float(i), 1, 2, 1000 + i, 5) for i in range(1, 80)],
        "video_id long, topic string, duration double, plays_day1 long, plays_day3 long, plays_day30 long, incr_plays_3_30 long",
    )
    found = profiles.library_search(v, (5, 70), 1000, ["t"])
    assert found.columns == list(fixed.LIBRARY_LABELS.values()) and found.count() == 50
    assert profiles.library_search(v, (5, 70), 1000, ["other"]).count() == 0


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "video_id")
    a = {r[0] for r in profiles.deterministic_sample(df, 100, "video_id").collect()}
    b = {r[0] for r in profiles.deterministic_sample(df.repartition(7), 100, "video_id").collect()}
    assert a == b and len(a) == 100
