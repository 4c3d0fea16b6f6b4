"""The scoring bundle end to end on the smallest tables."""

import pytest

from reelscope.functions import fixed_values as fixed
from reelscope.operators import decisions
from reelscope.plans import registry, scoring
from reelscope.plans.pipeline import workspace


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, "/root/testdata/sf0.001")


def test_scores_keep_every_draft_in_order(ws):
    drafts = registry.drafts(ws)
    filled = {r.draft_id: r.plays_day3 for r in decisions.draft_defaults(drafts).collect()}
    rows = registry.score_drafts(ws).collect()
    assert {r.draft_id for r in rows} == set(filled) and len(rows) == len(filled)
    edges = {t[0]: (t[1], t[2]) for t in fixed.TIERS}
    for r in rows:
        assert 0 <= r.pred_p10 <= r.pred_median <= r.pred_p90
        assert r.total_expected == pytest.approx(filled[r.draft_id] + r.pred_median)
        low, high = edges[r.tier]
        assert low <= r.pred_median < high


def test_live_check_decides_by_the_prediction(spark, ws):
    bundle = registry.bundle(ws)
    assert bundle["holdout"].first()["smape"] >= 0
    posts = spark.createDataFrame(
        [(1, "ECONOMY", 100, 500, 900, 40), (2, None, None, None, None, None)],
        "video_id long, topic string, plays_day0 long, plays_day1 long, plays_day3 long, likes_day3 long",
    )
    decided, curve = scoring.live_check(posts, bundle)
    rows = {r.video_id: r for r in decided.collect()}
    again = decisions.triage_score(decided.select(*posts.columns, "pred_median"), "pred_median")
    assert {r.video_id: r.score for r in again.collect()} == {i: r.score for i, r in rows.items()}
    last = {r.video_id: r.median for r in curve.where("day = 30").collect()}
    for i, r in rows.items():
        assert last[i] == pytest.approx(r.plays_day3 + r.pred_median)


def test_ideas_are_ranked_by_expected_views(spark, ws):
    ideas = spark.createDataFrame(
        [(1, "ECONOMY", 15, "High", 25000, "a"), (2, "nowhere", 90, "Low", 10, "b"), (3, "PROMO", None, None, None, "c")],
        "draft_id long, topic string, length int, hook string, followers long, concept string",
    )
    rows = scoring.rank_ideas(ideas, registry.bundle(ws)).collect()
    ordered = sorted(rows, key=lambda r: int(r.priority[1:]))
    assert [r.priority for r in ordered] == ["#1", "#2", "#3"]
    views = [r.expected_views for r in ordered]
    assert views == sorted(views, reverse=True)
    by_id = {r.draft_id: r for r in rows}
    assert {i: r.concept for i, r in by_id.items()} == {1: "a", 2: "b", 3: "c"}
    assert by_id[2].category == fixed.FALLBACK_TOPIC and by_id[3].length == "25s"
