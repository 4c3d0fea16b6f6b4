"""The registered queries as DuckDB SQL over the test tables: an independent second formulation."""

from __future__ import annotations

from reelscope.functions import fixed_values as fixed


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def big(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def bucket_case(expression: str, buckets) -> str:
    arms = " ".join(f"WHEN {expression} > {lo} AND {expression} <= {hi} THEN {text(name)}" for name, lo, hi in buckets)
    return f"CASE {arms} END"


def label_values(column: str, labels) -> str:
    return f"(VALUES {', '.join(f'({text(x)})' for x in labels)}) AS labels({column})"


EMO = ", ".join(fixed.EMOTIONS)

RAW = """
lines AS (
  SELECT l_partkey AS video_id, CAST(floor(sqrt(l_partkey)) AS BIGINT) AS author_id,
         CAST(l_shipdate AS DATE) AS d, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem),
firsts AS (SELECT video_id, min(d) AS first_day FROM lines GROUP BY video_id),
binned AS (
  SELECT l.video_id, l.d, l.q,
         CAST(floor(date_diff('day', f.first_day, l.d) / CAST(73 AS DOUBLE)) AS INTEGER) AS k
  FROM lines l JOIN firsts f ON l.video_id = f.video_id),
steps AS (
  SELECT video_id, k, max(d) AS d,
         CAST(sum(floor(q * CAST(100 AS DOUBLE) * (CASE WHEN video_id % 50 = 0 THEN 40 ELSE 1 END)
           / (CAST(1 AS DOUBLE) + CAST(k AS DOUBLE) * k * CAST(CASE video_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.25 ELSE 1 END AS DOUBLE)))) AS BIGINT) AS inc
  FROM binned GROUP BY video_id, k),
counters AS (
  SELECT video_id, d AS date, k AS days_since_post,
         CAST(sum(inc) OVER w AS BIGINT) AS play_count,
         CAST(sum(floor(inc * (video_id % 13) / CAST(100 AS DOUBLE))) OVER w AS BIGINT) AS like_count,
         CAST(sum(floor(inc / CAST(200 AS DOUBLE))) OVER w AS BIGINT) AS comment_count,
         CAST(sum(floor(inc * (video_id % 7) / CAST(500 AS DOUBLE))) OVER w AS BIGINT) AS share_count
  FROM steps WINDOW w AS (PARTITION BY video_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
engagement_daily AS (
  SELECT * FROM counters
  UNION ALL SELECT * FROM counters WHERE video_id % 17 = 0
  UNION ALL SELECT video_id, CAST(date - 400 AS DATE), -1, play_count, like_count, comment_count, share_count
            FROM counters WHERE video_id % 19 = 0 AND days_since_post = 0),
changes AS (SELECT author_id, d, sum(q * 10 - 200) AS change FROM lines GROUP BY author_id, d),
followers AS (
  SELECT author_id, d AS date, CAST(1000 + author_id * 100 + sum(change) OVER w AS BIGINT) AS follower_count,
         min(d) OVER (PARTITION BY author_id) AS first_day
  FROM changes WINDOW w AS (PARTITION BY author_id ORDER BY d ROWS UNBOUNDED PRECEDING)),
creator_daily AS (
  SELECT author_id, date, follower_count, CAST(author_id % 200 + 50 AS BIGINT) AS following_count,
         CAST(follower_count * 10 AS BIGINT) AS total_favorited, CAST(author_id % 2 AS BIGINT) AS enterprise_verified
  FROM followers WHERE date_diff('day', first_day, date) <= 180),
videos AS (
  SELECT p_partkey AS video_id, CAST(floor(sqrt(p_partkey)) AS BIGINT) AS author_id, f.first_day AS create_date,
         CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS topic,
         CASE WHEN p_partkey % 29 <> 0 THEN CAST(p_size * 3 AS DOUBLE) END AS duration,
         CAST(p_partkey % 2 AS BIGINT) AS is_english,
         CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size % 18 AS DOUBLE) END AS hashtag_count,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST((p_partkey * 31) % 200 AS DOUBLE) END AS word_count,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST((p_partkey * 7) % 50 AS DOUBLE) / CAST(10 AS DOUBLE) END AS speaking_rate,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS joy,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 41) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS disgust,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 43) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS sadness,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 47) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS anger,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS surprise,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey * 59) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS fear,
         CASE p_partkey % 6 WHEN 0 THEN 'original_sound' WHEN 1 THEN 'single_song' WHEN 2 THEN 'recommend_list'
              WHEN 3 THEN 'search_result' WHEN 4 THEN 'effect' END AS music_selected_from
  FROM part JOIN firsts f ON p_partkey = f.video_id)"""

CLEAN = RAW + """,
clean_engagement AS (
  SELECT video_id, date, days_since_post, play_count, like_count, comment_count, share_count FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, date
      ORDER BY days_since_post, play_count, like_count, comment_count, share_count) AS rn
    FROM engagement_daily WHERE days_since_post >= 0) t WHERE rn = 1),
daily AS (
  SELECT e.*, v.author_id, v.create_date, v.topic, v.duration, c.follower_count
  FROM clean_engagement e JOIN videos v ON e.video_id = v.video_id
  LEFT JOIN creator_daily c ON v.author_id = c.author_id AND e.date = c.date)"""


def _snapshots(days=fixed.SNAPSHOT_DAYS) -> str:
    picks = ", ".join(
        f"max(CASE WHEN days_since_post = {d} THEN {column} END) AS {name}_day{d}"
        for d in days
        for name, column in (("plays", "play_count"), ("likes", "like_count"), ("comments", "comment_count"), ("shares", "share_count"))
    )
    return f"SELECT video_id, {picks} FROM clean_engagement GROUP BY video_id"


SNAPSHOT_NAMES = [f"{c}_day{d}" for d in fixed.SNAPSHOT_DAYS for c in ("plays", "likes", "comments", "shares")]
D = {f"d{d}": f"CAST(coalesce(plays_day{d}, 0) AS DOUBLE)" for d in fixed.SNAPSHOT_DAYS}
V01 = f"({D['d1']} - {D['d0']})"
V13 = f"(({D['d3']} - {D['d1']}) / CAST(2 AS DOUBLE))"
SAFE_PLAYS = f"greatest({D['d3']} + CAST(1 AS DOUBLE), CAST(1 AS DOUBLE))"

SUMMARY = CLEAN + f""",
pivoted AS ({_snapshots()}),
meta AS (
  SELECT d.video_id, d.author_id, d.create_date, d.topic, d.duration, v.is_english, {", ".join("v." + e for e in fixed.EMOTIONS)},
         v.word_count, v.speaking_rate, v.hashtag_count, d.follower_count
  FROM daily d JOIN videos v ON d.video_id = v.video_id WHERE d.days_since_post = 0),
base AS (
  SELECT m.*, {", ".join("p." + c for c in SNAPSHOT_NAMES)}
  FROM meta m JOIN pivoted p ON m.video_id = p.video_id),
stats AS (
  SELECT author_id, quantile_disc(plays_day30, 0.5) AS creator_median_plays30,
         count(video_id) AS creator_video_count, avg(plays_day30) AS creator_avg_plays30
  FROM base GROUP BY author_id),
summary AS (
  SELECT b.*,
    plays_day30 - plays_day3 AS incr_plays_3_30, likes_day30 - likes_day3 AS incr_likes_3_30,
    comments_day30 - comments_day3 AS incr_comments_3_30, shares_day30 - shares_day3 AS incr_shares_3_30,
    ln(1 + plays_day30) - ln(1 + plays_day3) AS growth_factor_plays,
    CAST({V01} AS BIGINT) AS velocity_0_1, {V13} AS velocity_1_3, {V13} - {V01} AS acceleration,
    CASE WHEN abs({V01} + 1) < 0.001 THEN CAST(0 AS DOUBLE) ELSE {V13} / ({V01} + CAST(1 AS DOUBLE)) END AS decay_ratio,
    CAST(coalesce(likes_day3, 0) AS DOUBLE) / {SAFE_PLAYS} AS like_rate_day3,
    CAST(coalesce(comments_day3, 0) AS DOUBLE) / {SAFE_PLAYS} AS comment_rate_day3,
    CAST(coalesce(shares_day3, 0) AS DOUBLE) / {SAFE_PLAYS} AS share_rate_day3,
    CAST(plays_day3 AS DOUBLE) / (follower_count + CAST(1 AS DOUBLE)) AS penetration_rate,
    s.creator_median_plays30, s.creator_video_count, s.creator_avg_plays30
  FROM base b LEFT JOIN stats s ON b.author_id = s.author_id)"""

TOPICS = CLEAN + """,
topics AS (
  SELECT date, topic, count(video_id) AS active_videos, CAST(sum(play_count) AS BIGINT) AS total_plays,
         CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(comment_count) AS BIGINT) AS total_comments,
         CAST(sum(share_count) AS BIGINT) AS total_shares, avg(play_count) AS avg_plays_per_video
  FROM daily GROUP BY date, topic),
top_topic AS (
  SELECT topic, CAST(sum(total_plays) AS BIGINT) AS total FROM topics WHERE topic IS NOT NULL
  GROUP BY topic ORDER BY total DESC, topic LIMIT 1),
span AS (
  SELECT topic, min(date) AS a, max(date) AS b FROM topics WHERE topic IS NOT NULL GROUP BY topic),
dense AS (
  SELECT s.topic, CAST(g.day AS DATE) AS date, t.avg_plays_per_video AS raw
  FROM span s CROSS JOIN LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 DAY)) AS day) g
  LEFT JOIN topics t ON t.topic = s.topic AND t.date = CAST(g.day AS DATE)),
series AS (
  SELECT topic, date, coalesce(
    last_value(raw IGNORE NULLS) OVER (PARTITION BY topic ORDER BY date ROWS UNBOUNDED PRECEDING),
    first_value(raw IGNORE NULLS) OVER (PARTITION BY topic ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
  FROM dense),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date) AS position, count(*) OVER (PARTITION BY topic) AS length
  FROM series)"""

AUTHORS = SUMMARY + """,
spans AS (
  SELECT author_id, min(date) AS start_date, max(date) AS end_date,
         arg_min(follower_count, date) AS start_followers, arg_max(follower_count, date) AS end_followers
  FROM creator_daily GROUP BY author_id),
topic_votes AS (
  SELECT author_id, topic, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, topic) AS rn
  FROM summary WHERE topic IS NOT NULL GROUP BY author_id, topic),
author_videos AS (
  SELECT s.author_id, coalesce(sum(plays_day30), 0) AS total_plays, count(video_id) AS videos_posted,
         median(plays_day30) AS median_plays, avg(plays_day30) AS mean_plays, avg(duration) AS avg_duration,
         any_value(t.topic) AS primary_topic
  FROM summary s LEFT JOIN topic_votes t ON s.author_id = t.author_id AND t.rn = 1 GROUP BY s.author_id),
authors AS (
  SELECT a.*, s.start_date, s.end_date, s.start_followers, s.end_followers,
         s.end_followers - s.start_followers AS follower_gain,
         date_diff('day', s.start_date, s.end_date) AS total_days,
         greatest(CAST(1 AS DOUBLE), date_diff('day', s.start_date, s.end_date) / CAST(7 AS DOUBLE)) AS active_weeks,
         (s.end_followers - s.start_followers) / greatest(CAST(1000 AS DOUBLE), CAST(a.total_plays AS DOUBLE)) * CAST(10000 AS DOUBLE) AS followers_per_10k_views,
         a.videos_posted / greatest(CAST(1 AS DOUBLE), date_diff('day', s.start_date, s.end_date) / CAST(7 AS DOUBLE)) AS videos_per_week
  FROM spans s JOIN author_videos a ON s.author_id = a.author_id)"""

_CURVE = ", ".join(f"max(CASE WHEN days_since_post = {d} THEN play_count END) AS day_{d}" for d in fixed.CURVE_DAYS)
ASSIGNED = SUMMARY + f""",
matrix AS (SELECT video_id, {_CURVE} FROM engagement_daily GROUP BY video_id),
assigned AS (
  SELECT *, CASE WHEN day_3 / CAST(day_30 AS DOUBLE) >= 0.8 THEN {text(fixed.FLASH)}
                 WHEN day_3 / CAST(day_30 AS DOUBLE) >= 0.45 THEN {text(fixed.STEADY)} ELSE {text(fixed.EVERGREEN)} END AS archetype
  FROM matrix WHERE day_3 IS NOT NULL AND day_30 IS NOT NULL AND day_30 >= 50)"""


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def qr(ctes: str, body: str) -> str:
    """As :func:`q`, for tables that are built from themselves."""
    return f"WITH RECURSIVE {ctes.strip()}\n{body.strip()}"


SUMMARY_LONGS = (
    "video_id", "author_id", *SNAPSHOT_NAMES, "is_english", "follower_count", "incr_plays_3_30", "incr_likes_3_30",
    "incr_comments_3_30", "incr_shares_3_30", "velocity_0_1", "creator_median_plays30", "creator_video_count",
)
SUMMARY_DOUBLES = (
    "duration", *fixed.EMOTIONS, "word_count", "speaking_rate", "hashtag_count", "growth_factor_plays",
    "velocity_1_3", "acceleration", "decay_ratio", "like_rate_day3", "comment_rate_day3", "share_rate_day3",
    "penetration_rate", "creator_avg_plays30",
)
SUMMARY_BODY = (
    "SELECT create_date, topic, " + ", ".join(big(c) for c in SUMMARY_LONGS) + ", "
    + r6s(*SUMMARY_DOUBLES) + " FROM summary"
)
TOPIC_BODY = "SELECT date, topic, active_videos, total_plays, total_likes, total_comments, total_shares, " + r6s("avg_plays_per_video") + " FROM topics"


def _error_metrics(source: str, by: str, clip: bool = False, extra: str = "") -> str:
    """Metrics of ``y`` and ``yhat`` in a table expression, grouped by ``by``."""
    seen = "greatest(yhat, 0)" if clip else "yhat"
    return f"""
SELECT {by}, count(*) AS n, {r6("avg(abs(y - yhat))", "mae")}, {r6("median(abs(y - yhat))", "medae")},
  {r6("sqrt(avg((y - yhat) * (y - yhat)))", "rmse")},
  {r6("CASE WHEN sum(abs(y)) > 0 THEN sum(abs(y - yhat)) / sum(abs(y)) * 100 END", "wape")},
  {r6(f"avg(2 * abs(y - {seen}) / (abs(y) + abs({seen}) + 1)) * 100", "smape")},
  {r6("CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) > 0 THEN 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) WHEN avg((y - yhat) * (y - yhat)) = 0 THEN 1 ELSE 0 END", "r2")}{extra}
FROM {source} WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY {by}"""


Y = "CAST(coalesce(incr_plays_3_30, 0) AS DOUBLE)"
P3 = "CAST(coalesce(plays_day3, 0) AS DOUBLE)"
BASELINES = f"""
zero_pred AS (SELECT 'All Zero' AS model, video_id, {Y} AS y, CAST(0 AS DOUBLE) AS yhat FROM summary),
mean_pred AS (SELECT 'Mean Baseline' AS model, video_id, {Y} AS y, (SELECT avg({Y}) FROM summary) AS yhat FROM summary),
ratio_pred AS (SELECT 'Day-3 Proportional' AS model, video_id, {Y} AS y,
  {P3} * (SELECT median({Y} / ({P3} + 1)) FROM summary) AS yhat FROM summary),
speed_pred AS (SELECT 'Velocity Extrapolation (Day 1->3)' AS model, video_id, {Y} AS y,
  greatest(coalesce(velocity_1_3, 0) * 27, 0) AS yhat FROM summary),
predictions AS (SELECT * FROM zero_pred UNION ALL SELECT * FROM mean_pred UNION ALL SELECT * FROM ratio_pred UNION ALL SELECT * FROM speed_pred)"""

AVG_RANK = "(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {tie}{x}) - 1) / CAST(2 AS DOUBLE)) / count({x}) OVER ({part})"


def global_rank(x: str) -> str:
    return AVG_RANK.format(part="", tie="", x=x)


def _lp(x: str) -> str:
    return f"ln(1 + greatest(CAST(coalesce({x}, 0) AS DOUBLE), 0))"


LEVELS = {f"{c}_log": f"ln(1 + CAST(coalesce({c}, 0) AS DOUBLE))" for c in (
    "plays_day0", "plays_day1", "plays_day3", "plays_day7", "likes_day3", "likes_day7", "shares_day7")}
DYNAMICS = {
    "velocity_0_1_log": _lp("velocity_0_1"), "velocity_1_3_log": _lp("velocity_1_3"),
    "acceleration_val": "coalesce(acceleration, 0)",
    "decay_ratio_val": "CASE WHEN decay_ratio IS NULL THEN 0 WHEN decay_ratio > 10 THEN 10 WHEN decay_ratio < -10 THEN -10 ELSE decay_ratio END",
    "velocity_3_7": "ln(1 + greatest((CAST(coalesce(plays_day7, 0) AS DOUBLE) - coalesce(plays_day3, 0)) / 4, 0))",
}
QUALITY = {
    "like_rate": "coalesce(like_rate_day3, 0)", "comment_rate": "coalesce(comment_rate_day3, 0)",
    "share_rate": "coalesce(share_rate_day3, 0)",
    "like_rate_day7": "CAST(coalesce(likes_day7, 0) AS DOUBLE) / (coalesce(plays_day7, 0) + CAST(1 AS DOUBLE))",
}
CREATOR = {
    "creator_median_log": "ln(1 + CAST(coalesce(creator_median_plays30, 0) AS DOUBLE))",
    "creator_video_count_val": "coalesce(creator_video_count, 1)",
    "penetration_rate_val": "CASE WHEN penetration_rate IS NULL OR penetration_rate < 0 THEN 0 WHEN penetration_rate > 100 THEN 100 ELSE penetration_rate END",
    "follower_count_log": "ln(1 + CAST(coalesce(follower_count, 0) AS DOUBLE))",
}
CALENDAR = {
    "post_day_of_week": "isodow(create_date) - 1", "post_month": "month(create_date)",
    "post_is_weekend": "CASE WHEN isodow(create_date) >= 6 THEN 1 ELSE 0 END",
    "days_since_start": "date_diff('day', (SELECT min(create_date) FROM {t}), create_date)",
}
IMPUTED = {
    "duration": "coalesce(duration, (SELECT median(duration) FROM {t}))", "is_english": "coalesce(is_english, 0)",
    **{c: f"coalesce({c}, (SELECT median({c}) FROM {{t}}))" for c in fixed.TEXT_COLUMNS},
    **{f"{c}_missing": f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in fixed.TEXT_COLUMNS},
    **{c: f"coalesce({c}, (SELECT median({c}) FROM {{t}}))" for c in fixed.EMOTIONS},
}
RANKS = {f"{c}_rank_pct": global_rank(f"coalesce({c}, 0)") for c in (
    "velocity_1_3", "plays_day3", "creator_median_plays30", "follower_count")}


def topic_rank(c: str) -> str:
    ranked = AVG_RANK.format(part="PARTITION BY topic", tie="topic, ", x=c)
    return f"CASE WHEN topic IS NOT NULL AND {c} IS NOT NULL THEN {ranked} END"


TOPIC_RANKS = {f"{c}_topic_rank_pct": f"coalesce({topic_rank(c)}, 0)" for c in ("plays_day3", "velocity_1_3")}
LOG_Y = f"ln(1 + greatest({Y}, 0))"


def pick(expressions: dict[str, str], table: str = "summary") -> str:
    return ", ".join(r6(e.replace("{t}", table), n) for n, e in expressions.items())


def feature_sql(variant: str) -> str:
    table = "summary" if variant == "v3" else "kept"
    exprs = {**LEVELS, **DYNAMICS, **QUALITY, **CREATOR, **RANKS, **TOPIC_RANKS, **CALENDAR, **IMPUTED}
    if variant == "gpu":
        exprs.pop("velocity_1_3_topic_rank_pct")
        exprs["duration"], exprs["is_english"] = "coalesce(duration, 15)", "coalesce(is_english, 1)"
    ctes = SUMMARY + ",\nkept AS (SELECT * FROM summary WHERE incr_plays_3_30 IS NOT NULL)"
    keys = f"video_id, author_id, topic, create_date, {big('incr_plays_3_30')}, {r6(LOG_Y, 'y')}"
    return q(ctes, f"SELECT {keys}, {pick(exprs, table)} FROM {table}")


CUT = """,
cut AS (SELECT quantile_cont(CAST(date_diff('day', DATE '1970-01-01', create_date) AS DOUBLE), 0.8) AS c FROM summary),
marked AS (SELECT s.*, date_diff('day', DATE '1970-01-01', create_date) <= (SELECT c FROM cut) AS is_train FROM summary s)"""

ENCODED = CUT + """,
overall AS (SELECT avg(incr_plays_3_30) AS g FROM marked WHERE is_train),
topic_map AS (
  SELECT topic, count(*) AS n, (coalesce(sum(incr_plays_3_30), 0) + 30 * (SELECT g FROM overall)) / (count(incr_plays_3_30) + 30) AS te
  FROM marked WHERE is_train AND topic IS NOT NULL GROUP BY topic),
author_map AS (
  SELECT author_id, count(*) AS n, (coalesce(sum(incr_plays_3_30), 0) + 30 * (SELECT g FROM overall)) / (count(incr_plays_3_30) + 30) AS te
  FROM marked WHERE is_train GROUP BY author_id)"""

FOLDS = """,
per_day AS (SELECT create_date AS d, count(*) AS n FROM summary GROUP BY create_date),
placed AS (
  SELECT d, n, row_number() OVER (ORDER BY d) - 1 AS place, count(*) OVER () AS total FROM per_day),
blocks AS (
  SELECT d, n, CAST(floor((place - floor(total * 0.5)) / greatest(1, floor(total * 0.5 / 5))) AS BIGINT) AS fold
  FROM placed WHERE place >= floor(total * 0.5)),
tests AS (SELECT fold, min(d) AS test_start, max(d) AS test_end, CAST(sum(n) AS BIGINT) AS test_rows FROM blocks WHERE fold < 5 GROUP BY fold),
folds AS (
  SELECT t.fold, max(p.d) AS train_end, t.test_start, t.test_end, CAST(sum(p.n) AS BIGINT) AS train_rows, t.test_rows
  FROM tests t JOIN per_day p ON p.d < t.test_start GROUP BY t.fold, t.test_start, t.test_end, t.test_rows)"""

TIER = {
    i: "CASE WHEN {x} IS NULL THEN NULL " + " ".join(
        f"WHEN {{x}} >= {t[1]} AND {{x}} < {'CAST(' + text('Infinity') + ' AS DOUBLE)' if t[2] == float('inf') else t[2]} THEN {text(str(t[i]))}" for t in fixed.TIERS
    ) + f" ELSE {text(str(fixed.TIERS[-1][i]))} END"
    for i in (0, 3, 4)
}

INPUTS = """,
live AS (
  SELECT video_id, CAST(coalesce(plays_day0, 0) AS DOUBLE) AS p0, CAST(coalesce(plays_day1, 0) AS DOUBLE) AS p1,
         CAST(coalesce(plays_day3, 0) AS DOUBLE) AS p3, CAST(coalesce(likes_day3, 0) AS DOUBLE) AS l3,
         CAST(incr_plays_3_30 AS DOUBLE) AS gain FROM summary),
signals AS (
  SELECT *, greatest((p3 - p1) / 2, 0) AS speed, greatest((p3 - p1) / 2, 0) - greatest(p1 - p0, 0) AS accel,
         p3 / (p1 + 1) AS decay, l3 / (p3 + 1) AS likes FROM live),
scored AS (
  SELECT *, least(99, greatest(5, 40
    + CASE WHEN decay > 1.25 THEN 25 WHEN decay > 1.0 THEN 15 WHEN decay < 0.6 THEN -20 ELSE 0 END
    + CASE WHEN accel > 50 THEN 20 WHEN accel < -50 THEN -15 ELSE 0 END
    + CASE WHEN likes > 0.08 THEN 15 WHEN likes < 0.03 THEN -10 ELSE 0 END
    + CASE WHEN gain > 20000 THEN 20 WHEN gain < 1000 THEN -15 ELSE 0 END)) AS score FROM signals)"""


def _status(i: int) -> str:
    (a, b, c) = fixed.TRIAGE_STATUSES
    return f"CASE WHEN score >= {a[0]} THEN {text(a[i])} WHEN score >= {b[0]} THEN {text(b[i])} ELSE {text(c[i])} END"


NUMERIC = [
    "author_id", "plays_day0", "likes_day0", "comments_day0", "shares_day0", "plays_day1", "likes_day1", "comments_day1",
    "shares_day1", "plays_day3", "likes_day3", "comments_day3", "shares_day3", "plays_day7", "likes_day7",
    "comments_day7", "shares_day7", "duration", "is_english", *fixed.EMOTIONS, "word_count", "speaking_rate",
    "hashtag_count", "follower_count", "growth_factor_plays", "velocity_0_1", "velocity_1_3", "acceleration",
    "decay_ratio", "like_rate_day3", "comment_rate_day3", "share_rate_day3", "penetration_rate",
    "creator_median_plays30", "creator_video_count", "creator_avg_plays30",
]
_UNPIVOT = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
SPEARMAN = SUMMARY + f""",
wide AS (SELECT CAST(incr_plays_3_30 AS DOUBLE) AS y, {_UNPIVOT} FROM summary WHERE incr_plays_3_30 IS NOT NULL),
tall AS (UNPIVOT wide ON {", ".join(NUMERIC)} INTO NAME feature VALUE x),
ranked AS (
  SELECT feature,
    rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / CAST(2 AS DOUBLE) AS rx,
    rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / CAST(2 AS DOUBLE) AS ry
  FROM tall),
rhos AS (
  SELECT feature, count(*) AS n,
    CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho
  FROM ranked GROUP BY feature HAVING count(*) >= 100)"""

HEAT = (*fixed.EMOTIONS, "duration", "speaking_rate", "follower_count", "plays_day30")

DRAFTS = SUMMARY + """,
drafts AS (
  SELECT video_id AS draft_id, topic, duration, CAST(follower_count AS DOUBLE) AS follower_count,
         CAST(creator_median_plays30 AS DOUBLE) AS creator_median_plays30, speaking_rate, hashtag_count,
         CAST(plays_day0 AS DOUBLE) AS plays_day0, CAST(plays_day1 AS DOUBLE) AS plays_day1, CAST(plays_day3 AS DOUBLE) AS plays_day3,
         CASE WHEN surprise > 0.66 THEN 'High' WHEN surprise < 0.33 THEN 'Low' WHEN surprise IS NOT NULL THEN 'Medium' END AS hook
  FROM summary),
filled AS (
  SELECT draft_id, hook, coalesce(topic, 'Beauty_Fashion') AS topic, coalesce(duration, 20) AS duration,
         coalesce(follower_count, 10000) AS follower_count, coalesce(creator_median_plays30, 500) AS creator_median_plays30,
         coalesce(speaking_rate, 2.8) AS speaking_rate, coalesce(hashtag_count, 4) AS hashtag_count,
         CAST(1 AS DOUBLE) AS is_english, CAST(40 AS DOUBLE) AS word_count, CAST(0.005 AS DOUBLE) AS comment_rate, CAST(0.01 AS DOUBLE) AS share_rate,
         coalesce(plays_day0, coalesce(creator_median_plays30, 500) * 0.4) AS plays_day0,
         coalesce(plays_day1, coalesce(creator_median_plays30, 500) * 0.7) AS plays_day1,
         coalesce(plays_day3, coalesce(creator_median_plays30, 500) * 0.95) AS plays_day3
  FROM drafts),
profiles AS (
  SELECT topic, quantile_cont(duration, 0.25) AS p25, quantile_cont(duration, 0.75) AS p75, median(duration) AS mid, count(*) AS n
  FROM summary WHERE topic IS NOT NULL GROUP BY topic)"""


def _tip(template: str) -> str:
    out, rest = [], template
    names = {
        "topic": "replace(topic, '_', ' ')", "p25": "format('{:,}', CAST(round_even(low, 0) AS BIGINT))",
        "p75": "format('{:,}', CAST(round_even(high, 0) AS BIGINT))", "duration": "CAST(CAST(round_even(duration, 0) AS BIGINT) AS VARCHAR)",
    }
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += [text(head), names[name]]
    return " || ".join([*out, text(rest)])


def _payoff(source: str, by: str) -> str:
    return (
        f"SELECT {by}, count(plays_day30) AS video_count, {r6('median(plays_day30)', 'median_views')}, "
        f"{r6('avg(plays_day30)', 'mean_views')}, {r6('avg(like_rate_day3)', 'avg_like_rate')}, "
        f"{r6('avg(like_rate_day3) * 100', 'like_rate_pct')} FROM {source} GROUP BY {by}"
    )


def _music() -> str:
    arms = " ".join(f"WHEN contains(lower(coalesce(music_selected_from, '')), {text(p)}) THEN {text(n)}" for p, n in fixed.MUSIC_RULES)
    return f"CASE {arms} ELSE {text(fixed.MUSIC_OTHER)} END"


JOINED = SUMMARY + """,
joined AS (SELECT v.video_id, v.music_selected_from, v.hashtag_count, s.plays_day30, s.like_rate_day3 FROM videos v JOIN summary s ON v.video_id = s.video_id)"""

ENGAGEMENT_COLUMNS = "video_id, date, CAST(days_since_post AS BIGINT) AS days_since_post, play_count, like_count, comment_count, share_count"

_SAMPLE_ORDER = "(video_id % 2147483648 * 2654435761) % 2147483648"

_LAGS = ", ".join(f"sum(d * lead_{k}) AS p{k}" for k in range(21))
_LEADS = ", ".join(f"lead(d, {k}) OVER (PARTITION BY topic ORDER BY date) AS lead_{k}" for k in range(21))
_ACF_ROWS = " UNION ALL ".join(f"SELECT topic, CAST({k} AS BIGINT) AS lag, {r6(f'p{k} / p0', 'acf')} FROM sums WHERE {k} < n" for k in range(21))

TREND = TOPICS + """,
points AS (
  SELECT *, CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) AS t, isodow(date) - 1 AS wd,
         position <= floor(length * CAST(0.8 AS DOUBLE)) AS is_train FROM numbered),
means AS (SELECT topic, wd, avg(t) AS tm, avg(value) AS ym FROM points WHERE is_train GROUP BY topic, wd),
alls AS (SELECT topic, avg(t) AS ta, avg(value) AS ya FROM points WHERE is_train GROUP BY topic),
slopes AS (
  SELECT p.topic, coalesce(sum((t - tm) * (value - ym)) / nullif(sum((t - tm) * (t - tm)), 0), 0) AS slope
  FROM points p JOIN means m ON p.topic = m.topic AND p.wd = m.wd WHERE is_train GROUP BY p.topic),
trend AS (
  SELECT p.topic, p.date, p.value AS actual, coalesce(ym, ya) + slope * (t - coalesce(tm, ta)) AS forecast
  FROM points p JOIN slopes s ON p.topic = s.topic JOIN alls a ON a.topic = p.topic
  LEFT JOIN means m ON p.topic = m.topic AND p.wd = m.wd WHERE NOT is_train)"""

_AWAY = """,
away AS (SELECT topic, date, total_plays - avg(total_plays) OVER (PARTITION BY topic) AS d FROM topics WHERE topic IS NOT NULL),
placed_days AS (SELECT topic, d, row_number() OVER (PARTITION BY topic ORDER BY date) AS i FROM away)"""

#: Durbin-Levinson, one lag a step; the coefficients so far travel as a list.
PACF = TOPICS + _AWAY + """,
sized AS (SELECT topic, count(*) AS n, sum(d * d) AS own FROM placed_days GROUP BY topic),
adjusted AS (
  SELECT a.topic, b.i - a.i AS k, sum(a.d * b.d) / any_value(s.own) * any_value(s.n) / (any_value(s.n) - (b.i - a.i)) AS r
  FROM placed_days a JOIN placed_days b ON a.topic = b.topic AND b.i - a.i BETWEEN 0 AND 20 JOIN sized s ON s.topic = a.topic
  GROUP BY a.topic, b.i - a.i, s.n HAVING b.i - a.i <= s.n / 2),
lists AS (SELECT topic, list(r ORDER BY k) AS r FROM adjusted GROUP BY topic),
levinson AS (
  SELECT topic, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS error, CAST(1 AS DOUBLE) AS last FROM lists
  UNION ALL
  SELECT topic, k + 1, list_append(list_transform(phi, lambda p, j: p - now * phi[len(phi) + 1 - j]), now), error * (1 - now * now), now
  FROM (SELECT v.*, (l.r[k + 2] - coalesce(list_sum(list_transform(phi, lambda p, j: p * l.r[k + 2 - j])), 0)) / nullif(error, 0) AS now,
               len(l.r) AS most FROM levinson v JOIN lists l ON l.topic = v.topic WHERE k + 1 < len(l.r)))"""

#: One sweep a step on column ``k`` of a symmetric matrix ``m`` (row order) of ``w`` columns, if it isn't collinear.
_SWEPT = """CASE WHEN m[k * w + k + 1] > 1e-10 * scale[k + 1] THEN list_transform(m, lambda x, spot: CASE
    WHEN (spot - 1) // w = k AND (spot - 1) % w = k THEN -1 / m[k * w + k + 1]
    WHEN (spot - 1) // w = k OR (spot - 1) % w = k THEN x / m[k * w + k + 1]
    ELSE x - m[(spot - 1) // w * w + k + 1] * m[k * w + (spot - 1) % w + 1] / m[k * w + k + 1] END) ELSE m END"""


def _moments(name: str, source: str, steps: str) -> str:
    """The moment matrix per topic of the list ``x`` in ``source``, and what is left after each of ``steps`` sweeps."""
    return f"""{name}_cells AS (
  SELECT topic, i, j, any_value({steps}) AS steps, len(any_value(x)) AS w, count(*) AS n, sum(x[i] * x[j]) AS s
  FROM {source}, range(1, len(x) + 1) a(i), range(1, len(x) + 1) b(j) GROUP BY topic, i, j),
{name} AS (
  SELECT topic, any_value(w) AS w, any_value(n) AS n, any_value(steps) AS steps, list(s ORDER BY i, j) AS m0,
         list(s ORDER BY i) FILTER (i = j) AS scale FROM {name}_cells GROUP BY topic),
{name}_swept AS (
  SELECT topic, w, n, steps, scale, m0 AS m, CAST(0 AS BIGINT) AS k FROM {name}
  UNION ALL
  SELECT topic, w, n, steps, scale, {_SWEPT}, k + 1 FROM {name}_swept WHERE k < steps)"""


#: Lag counts are compared over the days that the largest leaves; the best is fitted over its own.
ADF = TOPICS + """,
levels AS (
  SELECT topic, date, CAST(total_plays AS DOUBLE) - avg(CAST(total_plays AS DOUBLE)) OVER (PARTITION BY topic) AS y,
         row_number() OVER (PARTITION BY topic ORDER BY date) - 1 AS spot, count(*) OVER (PARTITION BY topic) AS n,
         max(total_plays) OVER (PARTITION BY topic) > min(total_plays) OVER (PARTITION BY topic) AS moves
  FROM topics WHERE topic IS NOT NULL AND total_plays IS NOT NULL),
ordered AS (SELECT topic, list(y ORDER BY spot) AS ys FROM levels GROUP BY topic),
days AS (
  SELECT l.topic, spot, ys, least(ceil(12 * (n / CAST(100 AS DOUBLE)) ** CAST(0.25 AS DOUBLE)), n // 2 - 2) AS most
  FROM levels l JOIN ordered o ON o.topic = l.topic WHERE moves AND spot > 0),
wide AS (
  SELECT topic, spot, most, [CAST(1 AS DOUBLE), ys[spot]] || list_transform(range(1, CAST(most AS BIGINT) + 1), lambda k:
           CASE WHEN spot - k > 0 THEN ys[spot + 1 - k] - ys[spot - k] ELSE 0 END) || [ys[spot + 1] - ys[spot]] AS x
  FROM days WHERE most >= 0),
late AS (SELECT * FROM wide WHERE spot > most),
""" + _moments("tried", "late", "most + 2") + """,
scores AS (
  SELECT topic, k - 2 AS lags, n * ln(greatest(m[w * w], 1e-10 * scale[w]) / n) + 2 * k AS aic FROM tried_swept WHERE k >= 2),
best AS (SELECT topic, arg_min(lags, (aic, lags)) AS lags FROM scores GROUP BY topic),
fitting AS (
  SELECT w.topic, b.lags, x[1:b.lags + 2] || [x[-1]] AS x FROM wide w JOIN best b ON b.topic = w.topic WHERE w.spot > b.lags),
""" + _moments("fit", "fitting", "lags + 2") + """,
tested AS (
  SELECT topic, n AS m, steps - 2 AS lags,
         m[2 * w] / sqrt(-m[w + 2] * greatest(m[w * w], 1e-10 * scale[w]) / greatest(n - steps, 1)) AS statistic
  FROM fit_swept WHERE k = steps AND m[w + 2] < 0)"""

_SMALL = " + ".join(f"({c}) * statistic ** {i}" for i, c in enumerate((2.1659, 1.4412, 0.038269)))
_LARGE = " + ".join(f"({c}) * statistic ** {i}" for i, c in enumerate((1.7339, 0.93202, -0.12745, -0.010368)))
_Z = f"least(greatest(CASE WHEN statistic <= -1.61 THEN {_SMALL} ELSE {_LARGE} END, -6), 6)"
#: The normal distribution by the series of its density's integral; the terms are a running product.
UNIT_ROOT_P = f"""CASE WHEN statistic IS NULL THEN NULL WHEN statistic > 2.74 THEN 1 WHEN statistic < -18.83 THEN 0 ELSE 0.5 + exp(-(({_Z}) ** 2) / 2) / sqrt(2 * pi()) *
  list_sum(list_transform(range(0, 121), lambda i: ({_Z}) * CASE WHEN i = 0 THEN 1 ELSE
    list_product(list_transform(range(1, i + 1), lambda j: ({_Z}) ** 2 / (2 * j + 1))) END)) END"""

#: The continued fraction of the incomplete beta function, one step a round, from the side where it settles fast.
P_VALUES = SPEARMAN + """,
sides AS (
  SELECT feature, n, rho, (n - 2) / CAST(2 AS DOUBLE) AS half, 1 - rho * rho AS share FROM rhos),
asked AS (
  SELECT *, share > (half + 1) / (half + 2.5) AS turned FROM sides WHERE rho IS NOT NULL AND abs(rho) < 1),
given AS (
  SELECT feature, CASE WHEN turned THEN CAST(0.5 AS DOUBLE) ELSE half END AS a, CASE WHEN turned THEN half ELSE CAST(0.5 AS DOUBLE) END AS b,
         CASE WHEN turned THEN rho * rho ELSE share END AS x, turned FROM asked),
fraction AS (
  SELECT feature, a, b, x, turned, 0 AS i, CAST(2 AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d, CAST(2 AS DOUBLE) AS total FROM given
  UNION ALL
  SELECT feature, a, b, x, turned, i + 1, 1 + term / c, 1 / (1 + term * d), total * (1 + term / c) / (1 + term * d)
  FROM (SELECT *, CASE WHEN i % 2 = 1 THEN (i + 1) // 2 * (b - (i + 1) // 2) * x / ((a + i) * (a + i + 1))
                  ELSE -(a + i // 2) * (a + b + i // 2) * x / ((a + i) * (a + i + 1)) END AS term FROM fraction WHERE i < 400)),
tails AS (
  SELECT feature, turned, x, CASE WHEN x <= 0 THEN 0 ELSE
         exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a * (total - 1) END AS tail FROM fraction WHERE i = 400),
judged AS (
  SELECT r.feature, r.n, r.rho, CASE WHEN abs(r.rho) >= 1 THEN 0 WHEN turned THEN 1 - tail ELSE tail END AS p
  FROM rhos r LEFT JOIN tails t ON t.feature = r.feature)"""

#: Two least squares per topic over lists of earlier steps, then one day a round.
SEASONAL = TOPICS + """,
trained AS (
  SELECT topic, list(value ORDER BY date) AS ys FROM numbered WHERE position <= floor(length * CAST(0.8 AS DOUBLE)) GROUP BY topic),
stepped AS (
  SELECT topic, ys, list_transform(range(9, len(ys) + 1), lambda t: ys[t] - ys[t - 7] - ys[t - 1] + ys[t - 8]) AS ws FROM trained WHERE len(ys) >= 28),
long_rows AS (
  SELECT topic, list_reverse(ws[t - 7:t - 1]) || [ws[t]] AS x FROM stepped, range(8, len(ws) + 1) r(t)),
""" + _moments("long", "long_rows", "7") + """,
firsts_found AS (
  SELECT topic, list_transform(range(0, 7), lambda i: CASE WHEN m[i * w + i + 1] < 0 THEN m[(i + 1) * w] ELSE 0 END) AS first
  FROM long_swept WHERE k = steps),
shocked AS (
  SELECT s.topic, ys, ws, list_transform(range(1, len(ws) + 1), lambda t: CASE WHEN t > 7
    THEN ws[t] - list_sum(list_transform(range(1, 8), lambda i: first[i] * ws[t - i])) ELSE 0 END) AS es
  FROM stepped s JOIN firsts_found f ON f.topic = s.topic),
short_rows AS (
  SELECT topic, [ws[t - 1], ws[t - 7], ws[t - 8], es[t - 1], ws[t]] AS x FROM shocked, range(10, len(ws) + 1) r(t)),
""" + _moments("short", "short_rows", "4") + """,
betas AS (
  SELECT topic, list_transform(range(0, 4), lambda i: CASE WHEN m[i * w + i + 1] < 0 THEN m[(i + 1) * w] ELSE 0 END) AS b
  FROM short_swept WHERE k = steps),
rolled AS (
  SELECT s.topic, 0 AS i, b, ws[-8:] AS w, ys[-8:] AS y, es[-1] AS e FROM shocked s JOIN betas b ON b.topic = s.topic
  UNION ALL
  SELECT topic, i + 1, b, w[2:] || [now], y[2:] || [now + y[8] + y[2] - y[1]], 0
  FROM (SELECT *, b[1] * w[8] + b[2] * w[2] + b[3] * w[1] + b[4] * e AS now FROM rolled WHERE i < 3000)
  WHERE i < (SELECT max(length) FROM numbered n WHERE n.topic = topic)),
held_out AS (
  SELECT topic, date, value, row_number() OVER (PARTITION BY topic ORDER BY date) AS i FROM numbered
  WHERE position > floor(length * CAST(0.8 AS DOUBLE))),
foreseen AS (
  SELECT h.topic, h.date, h.value AS actual, r.y[8] AS forecast FROM held_out h LEFT JOIN rolled r ON r.topic = h.topic AND r.i = h.i)"""

def _column_totals(name: str, table: str, columns: dict[str, bool]) -> str:
    cells = ", ".join(
        f"{{'measure': '{c}', 'known': count({c}), 'total': {f'round(sum(CAST({c} AS DOUBLE)), 6) + 0.0' if number else 'CAST(NULL AS DOUBLE)'}}}"
        for c, number in columns.items()
    )
    return f"SELECT '{name}' AS table_name, unnest([{cells}], recursive := true) FROM {table}"


def _long_contents(name: str, sql: str, texts: tuple[str, ...]) -> str:
    label, numbers = ", ".join(texts), f"COLUMNS(* EXCLUDE ({', '.join(texts)}))"
    return f"""SELECT '{name}' AS table_name, concat_ws(' | ', {label}) AS label, measure, round(value, 6) + 0.0 AS value FROM (
UNPIVOT (SELECT {label}, CAST({numbers} AS DOUBLE) FROM ({sql})) ON {numbers} INTO NAME measure VALUE value)"""


_PANEL = ", ".join(f"({i + 1}, {d})" for i, d in enumerate(fixed.PANEL_DAYS))


def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # scans, sinks, profiling
    out["scan_raw"] = q(RAW, "SELECT video_id, strftime(date, '%Y-%m-%d') AS date, CAST(days_since_post AS BIGINT) AS days_since_post, play_count, like_count, comment_count, share_count FROM engagement_daily")
    out["scan_raw_videos"] = q(RAW, f"SELECT video_id, author_id, strftime(create_date, '%Y-%m-%d') AS create_date, topic, is_english, music_selected_from, {r6s('duration', 'hashtag_count', 'word_count', 'speaking_rate', *fixed.EMOTIONS)} FROM videos")
    out["scan_raw_creator"] = q(RAW, "SELECT author_id, strftime(date, '%Y-%m-%d') AS date, follower_count, following_count, total_favorited, enterprise_verified FROM creator_daily")
    out["scan_processed"] = q(TOPICS, TOPIC_BODY)
    out["sink_processed"] = out["scan_processed"]
    summary_columns = {**dict.fromkeys((*SUMMARY_LONGS, *SUMMARY_DOUBLES), True), "create_date": False, "topic": False}
    out["scan_strategy_inputs"] = q(SUMMARY, " UNION ALL ".join(_column_totals(*x) for x in (
        ("creator", "creator_daily", {**dict.fromkeys(("author_id", "follower_count", "following_count", "total_favorited", "enterprise_verified"), True), "date": False}),
        ("summary", "summary", summary_columns),
        ("videos", "videos", {**dict.fromkeys(("video_id", "author_id", "is_english", "duration", *fixed.TEXT_COLUMNS, *fixed.EMOTIONS), True),
                              **dict.fromkeys(("create_date", "topic", "music_selected_from"), False)}),
        ("engagement", "engagement_daily", {**dict.fromkeys(("video_id", "days_since_post", "play_count", "like_count", "comment_count", "share_count"), True), "date": False}),
    )))
    out["row_counts"] = q(RAW, "SELECT 'videos' AS table_name, count(*) AS row_count FROM videos UNION ALL SELECT 'engagement_daily', count(*) FROM engagement_daily UNION ALL SELECT 'creator_daily', count(*) FROM creator_daily")
    out["dataset_profile"] = q(SUMMARY, "SELECT count(*) AS row_count, CAST(52 AS BIGINT) AS column_count, count(incr_plays_3_30) AS target_count FROM summary")

    # cleaning and joins
    out["cast_dates"] = q(RAW, "SELECT author_id, date, follower_count FROM creator_daily")
    out["valid_days"] = q(RAW, f"SELECT {ENGAGEMENT_COLUMNS} FROM engagement_daily WHERE days_since_post >= 0")
    out["dedup_keys"] = q(CLEAN, f"SELECT {ENGAGEMENT_COLUMNS} FROM clean_engagement")
    out["prune_optional"] = q(RAW, f"SELECT video_id, author_id, create_date, topic, is_english, {r6s('duration', 'word_count', 'speaking_rate', 'hashtag_count', *fixed.EMOTIONS)} FROM videos")
    out["join_engagement_video"] = q(CLEAN, f"SELECT {ENGAGEMENT_COLUMNS}, author_id, create_date, topic, {r6s('duration')} FROM daily")
    out["join_creator_day"] = q(CLEAN, f"SELECT {ENGAGEMENT_COLUMNS}, author_id, topic, follower_count FROM daily")
    out["snapshot_filter"] = q(CLEAN, f"SELECT {ENGAGEMENT_COLUMNS} FROM clean_engagement WHERE days_since_post IN (0, 1, 3, 7, 30)")

    # summary
    pivots = ", ".join(big(c) for c in SNAPSHOT_NAMES)
    out["pivot_snapshots"] = q(SUMMARY, f"SELECT video_id, {pivots} FROM pivoted")
    out["rename_pivot"] = q(CLEAN + f",\nold AS ({_snapshots(fixed.NOTEBOOK_SNAPSHOT_DAYS)})", "SELECT video_id, plays_day0, plays_day1, plays_day3, plays_day30 AS target_plays_30d, likes_day0, likes_day1, likes_day3 FROM old")
    out["day0_meta"] = q(SUMMARY, f"SELECT video_id, author_id, create_date, topic, is_english, follower_count, {r6s('duration', *fixed.EMOTIONS, 'word_count', 'speaking_rate', 'hashtag_count')} FROM meta")
    out["join_meta_pivot"] = q(SUMMARY, f"SELECT video_id, author_id, topic, follower_count, {pivots} FROM base")
    out["incr_targets"] = q(SUMMARY, "SELECT video_id, incr_plays_3_30, incr_likes_3_30, incr_comments_3_30, incr_shares_3_30 FROM summary")
    out["growth_factor"] = q(SUMMARY, f"SELECT video_id, {r6s('growth_factor_plays')} FROM summary")
    out["velocity_accel"] = q(SUMMARY, f"SELECT video_id, velocity_0_1, {r6s('velocity_1_3', 'acceleration')} FROM summary")
    out["decay_ratio"] = q(SUMMARY, f"SELECT video_id, {r6s('decay_ratio')} FROM summary")
    out["quality_rates"] = q(SUMMARY, f"SELECT video_id, {r6s('like_rate_day3', 'comment_rate_day3', 'share_rate_day3')} FROM summary")
    out["penetration_rate"] = q(SUMMARY, f"SELECT video_id, {r6s('penetration_rate')} FROM summary")
    out["creator_stats"] = q(SUMMARY, f"SELECT author_id, creator_median_plays30, creator_video_count, {r6s('creator_avg_plays30')} FROM stats")
    out["creator_stats_prior"] = q(SUMMARY, f"""SELECT a.video_id, count(b.video_id) AS prior_video_count, {r6('avg(b.plays_day30)', 'prior_avg_plays30')}
FROM base a LEFT JOIN base b ON a.author_id = b.author_id AND b.create_date < a.create_date GROUP BY a.video_id""")
    out["join_creator_stats"] = q(SUMMARY, f"SELECT video_id, author_id, creator_median_plays30, creator_video_count, {r6s('creator_avg_plays30')} FROM summary")
    out["video_summary"] = q(SUMMARY, SUMMARY_BODY)
    out["scan_processed_summary"] = out["sink_processed_summary"] = out["video_summary"]
    out["drop_null_target"] = q(SUMMARY, "SELECT video_id, incr_plays_3_30 FROM summary WHERE incr_plays_3_30 IS NOT NULL")
    out["min_views_filter"] = q(SUMMARY, "SELECT video_id, plays_day30 FROM summary WHERE plays_day30 >= 50")

    # topic series
    out["topic_daily"] = q(TOPICS, TOPIC_BODY)
    out["sorted_topic_daily"] = q(TOPICS, "SELECT date, topic, total_plays FROM topics")
    out["arg_max_topic"] = q(TOPICS, "SELECT topic, total FROM top_topic")
    out["top_topic_filter"] = q(TOPICS, "SELECT date, topic, total_plays FROM topics WHERE topic = (SELECT topic FROM top_topic)")
    out["calendar_join"] = q(TOPICS, f"SELECT topic, date, {r6('raw', 'avg_plays_per_video')} FROM dense")
    out["ffill_bfill"] = q(TOPICS, f"SELECT topic, date, {r6s('value')} FROM series")
    out["recent_history"] = q(TOPICS, f"SELECT topic, date, {r6s('value')} FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY date DESC) AS back FROM numbered WHERE position <= floor(length * CAST(0.8 AS DOUBLE))) t WHERE back <= 30")

    # trajectories
    lagged = "lag(play_count) OVER w"
    windows = "WINDOW w AS (PARTITION BY video_id ORDER BY days_since_post, date), p AS (PARTITION BY video_id ORDER BY days_since_post, date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    out["play_lag1"] = q(CLEAN, f"SELECT video_id, date, {lagged} AS play_lag1 FROM clean_engagement {windows}")
    out["play_roll3_avg"] = q(CLEAN, f"SELECT video_id, date, {r6('avg(play_count) OVER p', 'play_roll3_avg')} FROM clean_engagement {windows}")
    out["daily_play_inc"] = q(CLEAN, f"SELECT video_id, date, play_count - coalesce({lagged}, 0) AS daily_play_inc, CAST(dayofweek(date) + 1 AS BIGINT) AS day_of_week FROM clean_engagement {windows}")
    out["panel_trajectory"] = q(CLEAN + f""",
seen AS (SELECT video_id, days_since_post AS day, CAST(max(play_count) AS DOUBLE) AS plays FROM clean_engagement GROUP BY video_id, days_since_post),
spine AS (SELECT v.video_id, s.step, s.day FROM (SELECT DISTINCT video_id FROM seen) v CROSS JOIN (VALUES {_PANEL}) AS s(step, day)),
ends AS (
  SELECT s.video_id, s.step, s.day, arg_max(e.plays, e.day) FILTER (WHERE e.day <= s.day) AS ap, max(e.day) FILTER (WHERE e.day <= s.day) AS ad,
         arg_min(e.plays, e.day) FILTER (WHERE e.day >= s.day) AS bp, min(e.day) FILTER (WHERE e.day >= s.day) AS bd
  FROM spine s JOIN seen e ON s.video_id = e.video_id GROUP BY s.video_id, s.step, s.day)""",
        f"SELECT video_id, CAST(step AS BIGINT) AS step, CAST(day AS BIGINT) AS day, {r6('CASE WHEN ad IS NULL THEN bp WHEN bd IS NULL OR bd = ad THEN ap ELSE ap + (bp - ap) * ((day - ad) / CAST(bd - ad AS DOUBLE)) END', 'plays')} FROM ends")
    out["trajectory_matrix"] = q(CLEAN, "SELECT video_id, " + ", ".join(f"max(CASE WHEN days_since_post = {d} THEN play_count END) AS day_{d}" for d in range(31)) + " FROM engagement_daily WHERE days_since_post BETWEEN 0 AND 30 GROUP BY video_id")

    # strategy reports
    out["creator_span"] = q(AUTHORS, f"SELECT author_id, start_date, end_date, start_followers, end_followers, end_followers - start_followers AS follower_gain, CAST(date_diff('day', start_date, end_date) AS BIGINT) AS total_days, {r6('greatest(1.0, date_diff(' + text('day') + ', start_date, end_date) / CAST(7 AS DOUBLE))', 'active_weeks')} FROM spans")
    out["author_video_stats"] = q(AUTHORS, f"SELECT author_id, videos_posted, primary_topic, {r6s('total_plays', 'median_plays', 'mean_plays', 'avg_duration')} FROM author_videos")
    out["join_author_span_videos"] = q(AUTHORS, f"SELECT author_id, follower_gain, videos_posted, {r6s('total_plays', 'followers_per_10k_views', 'videos_per_week')} FROM authors")
    topic_report = f"""SELECT primary_topic, {r6('median(followers_per_10k_views)', 'median_conversion')}, {r6('median(follower_gain)', 'median_creator_gain')},
{r6('median(total_plays)', 'median_views_per_creator')}, count(*) AS creator_count, replace(primary_topic, '_', ' ') AS clean_topic
FROM authors WHERE primary_topic IS NOT NULL GROUP BY primary_topic"""
    out["follower_conversion_topic"] = q(AUTHORS, topic_report)
    out["clean_labels"] = q(SUMMARY, "SELECT DISTINCT topic, replace(topic, '_', ' ') AS clean_topic FROM summary WHERE topic IS NOT NULL")
    out["follower_conversion_duration"] = q(AUTHORS + f",\nb AS (SELECT *, {bucket_case('avg_duration', fixed.DURATION_BUCKETS)} AS duration_bucket FROM authors)",
        f"SELECT labels.duration_bucket, {r6('median(followers_per_10k_views)', 'median_conversion')}, {r6('median(total_plays)', 'median_views')} FROM {label_values('duration_bucket', [x[0] for x in fixed.DURATION_BUCKETS])} LEFT JOIN b ON b.duration_bucket = labels.duration_bucket GROUP BY labels.duration_bucket")
    out["posting_cadence"] = q(AUTHORS + f",\nb AS (SELECT *, {bucket_case('videos_per_week', fixed.CADENCE_BUCKETS)} AS cadence_bucket FROM authors)",
        f"SELECT labels.cadence_bucket, count(author_id) AS creators_count, {r6('median(median_plays)', 'median_views_per_video')}, {r6('median(mean_plays)', 'mean_views_per_video')}, {r6('median(follower_gain)', 'median_follower_gain')}, {r6('median(total_plays)', 'median_total_views')} FROM {label_values('cadence_bucket', [x[0] for x in fixed.CADENCE_BUCKETS])} LEFT JOIN b ON b.cadence_bucket = labels.cadence_bucket GROUP BY labels.cadence_bucket")
    out["join_raw_processed"] = q(JOINED, f"SELECT video_id, music_selected_from, plays_day30, {r6s('hashtag_count', 'like_rate_day3')} FROM joined")
    out["hashtag_payoff"] = q(JOINED + f",\nb AS (SELECT *, {bucket_case('coalesce(hashtag_count, 0)', fixed.HASHTAG_BUCKETS)} AS bucket FROM joined)",
        _payoff(f"(SELECT labels.hashtag_bucket, b.* FROM {label_values('hashtag_bucket', [x[0] for x in fixed.HASHTAG_BUCKETS])} LEFT JOIN b ON b.bucket = labels.hashtag_bucket) t", "hashtag_bucket"))
    out["music_payoff"] = q(JOINED, _payoff(f"(SELECT *, {_music()} AS music_category FROM joined) t", "music_category"))
    out["semi_join_sample"] = q(RAW + f",\npicked AS (SELECT video_id FROM (SELECT DISTINCT video_id FROM engagement_daily WHERE days_since_post = 0) ORDER BY {_SAMPLE_ORDER}, video_id LIMIT 1500)", f"SELECT {ENGAGEMENT_COLUMNS} FROM engagement_daily WHERE video_id IN (SELECT video_id FROM picked)")
    out["archetype_assign"] = q(ASSIGNED, "SELECT video_id, archetype, " + ", ".join(f"day_{d}" for d in fixed.CURVE_DAYS) + " FROM assigned")
    out["archetype_shares"] = q(ASSIGNED, f"SELECT archetype, count(*) AS video_count, CAST((SELECT count(*) FROM assigned) AS BIGINT) AS sample_size, {r6('count(*) * 100.0 / (SELECT count(*) FROM assigned)', 'share_pct')} FROM assigned GROUP BY archetype")
    out["archetype_curves"] = q(ASSIGNED, " UNION ALL ".join(f"SELECT archetype, CAST({d} AS BIGINT) AS day, {r6(f'median(day_{d} / CAST(day_30 AS DOUBLE))', 'median_norm')} FROM assigned GROUP BY archetype HAVING count(day_{d}) > 0" for d in fixed.CURVE_DAYS))
    out["topic_lookup"] = q(ASSIGNED, "SELECT a.video_id, a.archetype, s.topic FROM assigned a LEFT JOIN summary s ON a.video_id = s.video_id")
    shares = ", ".join(f'round(count(*) FILTER (WHERE archetype = {text(a)}) * 100.0 / count(*), 6) + 0.0 AS "{a}"' for a in fixed.ARCHETYPES)
    out["topic_archetype_crosstab"] = q(ASSIGNED, f"SELECT s.topic, {shares} FROM assigned a JOIN summary s ON a.video_id = s.video_id WHERE s.topic IS NOT NULL GROUP BY s.topic")
    out["conversion_extremes"] = q(AUTHORS + f",\nreport AS ({topic_report}),\nplaced AS (SELECT *, row_number() OVER (ORDER BY median_conversion DESC, primary_topic) AS place, count(*) OVER () AS places FROM report)",
        "SELECT place, clean_topic, median_conversion FROM placed WHERE place IN (1, 3) OR place = places")

    out["strategy_bundle"] = " UNION ALL ".join(_long_contents(name, out[query], texts) for name, query, texts in (
        ("topic_conversion", "follower_conversion_topic", ("clean_topic", "primary_topic")),
        ("duration_conversion", "follower_conversion_duration", ("duration_bucket",)),
        ("cadence_summary", "posting_cadence", ("cadence_bucket",)), ("hashtag_summary", "hashtag_payoff", ("hashtag_bucket",)),
        ("music_summary", "music_payoff", ("music_category",)), ("archetype_shares", "archetype_shares", ("archetype",)),
        ("archetype_curves", "archetype_curves", ("archetype",)), ("topic_archetypes", "topic_archetype_crosstab", ("topic",)),
    ))

    # profiles and exploration
    out["topic_profile"] = q(SUMMARY, f"SELECT topic, count(*) AS video_count, {r6('median(plays_day30)', 'avg_plays_30')}, {r6('median(incr_plays_3_30)', 'avg_incr')}, {r6('median(duration)', 'median_duration')}, {r6('quantile_cont(duration, 0.25)', 'p25_duration')}, {r6('quantile_cont(duration, 0.75)', 'p75_duration')}, {r6('median(follower_count)', 'avg_follower_count')} FROM summary WHERE topic IS NOT NULL GROUP BY topic")
    out["topic_counts"] = q(SUMMARY, "SELECT topic, count(*) AS video_count FROM summary WHERE topic IS NOT NULL GROUP BY topic")
    out["sink_bundle"] = out["topic_counts"]
    out["sink_bundle_profile"] = out["topic_profile"]
    out["topic_trajectory_medians"] = q(SUMMARY, "SELECT topic, " + ", ".join(r6(f"median(plays_day{d})", f"median_plays_day{d}") for d in (0, 1, 3, 30)) + " FROM summary WHERE topic IS NOT NULL GROUP BY topic")
    out["distinct_values"] = q(SUMMARY, "SELECT DISTINCT topic FROM summary WHERE topic IS NOT NULL")
    out["deterministic_sample"] = q(SUMMARY, f"SELECT video_id, topic, plays_day30 FROM summary ORDER BY {_SAMPLE_ORDER}, video_id LIMIT 500")
    out["library_search"] = q(SUMMARY, f"SELECT topic, {r6s('duration')}, plays_day1, plays_day3, plays_day30, incr_plays_3_30 FROM summary WHERE duration >= 5 AND duration <= 60 AND plays_day30 >= 1000 ORDER BY video_id LIMIT 50")
    out["head_n"] = q(SUMMARY, "SELECT video_id, topic, plays_day0, plays_day1, plays_day3, plays_day7, plays_day30, incr_plays_3_30 FROM summary ORDER BY video_id LIMIT 4")

    # correlations
    out["pearson_matrix"] = q(SUMMARY, " UNION ALL ".join(
        f"SELECT {text(a)} AS a, {text(b)} AS b, {r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'corr')} FROM summary"
        for i, a in enumerate(HEAT) for b in HEAT[i + 1:]))
    out["spearman_report"] = q(SPEARMAN, f"SELECT feature, n, {r6s('rho')} FROM rhos")
    out["top_k_features"] = q(SPEARMAN, f"SELECT feature, n, {r6s('rho')} FROM rhos WHERE rho IS NOT NULL ORDER BY abs(rho) DESC, feature LIMIT 20")
    out["acf"] = q(TOPICS + f",\naway AS (SELECT topic, date, total_plays - avg(total_plays) OVER (PARTITION BY topic) AS d FROM topics WHERE topic IS NOT NULL),\nleads AS (SELECT topic, d, {_LEADS} FROM away),\nsums AS (SELECT topic, count(*) AS n, {_LAGS} FROM leads GROUP BY topic)", _ACF_ROWS)
    scaled = ", ".join(f"p{k} / p0 * n / (n - {k}) AS r{k}" for k in (1, 2, 3))
    three = (
        "((r3 - r2 * r1) - r1 * (r1 * r3 - r2 * r2) + r1 * (r1 * r1 - r2))"
        " / ((1 - r1 * r1) - r1 * (r1 - r1 * r2) + r2 * (r1 * r1 - r2))"
    )
    first = ((0, "1.0"), (1, "r1"), (2, "(r2 - r1 * r1) / (1 - r1 * r1)"), (3, three))
    out["pacf_first_lags"] = q(
        TOPICS + f",\naway AS (SELECT topic, date, total_plays - avg(total_plays) OVER (PARTITION BY topic) AS d FROM topics WHERE topic IS NOT NULL),\nleads AS (SELECT topic, d, {_LEADS} FROM away),\nsums AS (SELECT topic, count(*) AS n, {_LAGS} FROM leads GROUP BY topic),\nscaled AS (SELECT topic, n, {scaled} FROM sums)",
        " UNION ALL ".join(f"SELECT topic, CAST({k} AS BIGINT) AS lag, {r6(e, 'pacf')} FROM scaled WHERE n >= {2 * k}" for k, e in first))
    out["adf_zero_lags"] = q(
        TOPICS + ",\ndiffs AS (SELECT topic, CAST(total_plays AS DOUBLE) - lag(CAST(total_plays AS DOUBLE)) OVER w AS d, lag(CAST(total_plays AS DOUBLE)) OVER w AS x FROM topics WHERE topic IS NOT NULL AND total_plays IS NOT NULL WINDOW w AS (PARTITION BY topic ORDER BY date)),\nfits AS (SELECT topic, count(*) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x) AS sse FROM diffs WHERE x IS NOT NULL GROUP BY topic)",
        f"SELECT topic, {r6('b / sqrt(sse / (n - 2) / sxx)', 'statistic')}, n AS n_used FROM fits WHERE n >= 3 AND sxx > 0")

    out["pacf"] = qr(PACF, f"SELECT topic, CAST(k AS BIGINT) AS lag, {r6('last', 'pacf')} FROM levinson")
    out["adf_test"] = qr(ADF, f"""SELECT t.topic, {r6('statistic', 'statistic')}, {r6(UNIT_ROOT_P, 'p_value')},
       CAST(coalesce(lags, 0) AS BIGINT) AS lags, CAST(coalesce(m, 0) AS BIGINT) AS n_used
FROM (SELECT DISTINCT topic FROM topics WHERE topic IS NOT NULL AND total_plays IS NOT NULL) t LEFT JOIN tested ON t.topic = tested.topic""")
    out["spearman_p_values"] = qr(P_VALUES, f"SELECT feature, n, {r6s('rho')}, {r6('p', 'p_value')} FROM judged")

    # ranks, encoding, splits
    out["global_rank_pct"] = q(SUMMARY, f"SELECT video_id, {pick(RANKS)} FROM summary")
    out["topic_rank_pct"] = q(SUMMARY, f"SELECT video_id, {r6(topic_rank('plays_day3'), 'plays_day3_topic_rank_pct')}, {r6(topic_rank('velocity_1_3'), 'velocity_1_3_topic_rank_pct')} FROM summary")
    out["time_split_cutoff"] = q(SUMMARY + CUT, "SELECT video_id, is_train FROM marked")
    out["target_encode_fit"] = q(SUMMARY + ENCODED, f"SELECT topic, n AS rows, {r6('te', 'encoding')} FROM topic_map")
    out["te_lookup"] = q(SUMMARY + ENCODED, f"SELECT m.video_id, {r6('coalesce(a.te, (SELECT g FROM overall))', 'author_id_te')}, {r6('coalesce(t.te, (SELECT g FROM overall))', 'topic_te')} FROM marked m LEFT JOIN author_map a ON m.author_id = a.author_id LEFT JOIN topic_map t ON m.topic = t.topic")
    out["target_encode_oof"] = q(SUMMARY + ENCODED + """,
tr AS (SELECT video_id, author_id, incr_plays_3_30 AS t, video_id % 5 AS f FROM marked WHERE is_train)""",
        f"""SELECT a.video_id, {r6("(coalesce(sum(b.t), 0) + 30 * (SELECT g FROM overall)) / (count(b.t) + 30)", "author_id_te")}
FROM tr a LEFT JOIN tr b ON a.author_id = b.author_id AND a.f <> b.f GROUP BY a.video_id""")
    out["expanding_folds"] = q(SUMMARY + FOLDS, "SELECT fold, train_end, test_start, test_end, train_rows, test_rows FROM folds WHERE train_rows >= 100 AND test_rows >= 50")
    out["positional_split"] = q(SUMMARY, "SELECT video_id, row_number() OVER (ORDER BY create_date, video_id) <= floor(count(*) OVER () * CAST(0.85 AS DOUBLE)) AS is_head FROM summary")
    out["feature_medians"] = q(SUMMARY, "SELECT " + ", ".join(r6(f"median({c})", c) for c in ("duration", *fixed.TEXT_COLUMNS, *fixed.EMOTIONS)) + " FROM summary")

    # features
    for name, part in (("feat_log_levels", LEVELS), ("feat_dynamics", DYNAMICS), ("feat_quality", QUALITY),
                       ("feat_creator", CREATOR), ("feat_calendar", CALENDAR), ("feat_impute", IMPUTED)):
        out[name] = q(SUMMARY, f"SELECT video_id, {pick(part)} FROM summary")
    out["features_v3"] = feature_sql("v3")
    out["features_gpu_variant"] = feature_sql("gpu")
    out["coerce_numeric"] = q(RAW, "SELECT video_id, coalesce(try_cast(music_selected_from AS DOUBLE), 0) + 0.0 AS music_number, coalesce(try_cast(CAST(duration AS VARCHAR) AS DOUBLE), 0) + 0.0 AS duration_number FROM videos")

    hot = "topic_size, CASE WHEN topic_place < topic_size THEN topic_place END AS topic_place"
    places = SUMMARY + """,
places AS (SELECT topic, row_number() OVER (ORDER BY topic DESC) - 1 AS topic_place, count(*) OVER () - 1 AS topic_size
           FROM (SELECT DISTINCT topic FROM summary WHERE topic IS NOT NULL)),
placed AS (SELECT s.*, p.topic_place, (SELECT max(topic_size) FROM places) AS topic_size FROM summary s LEFT JOIN places p ON s.topic = p.topic)"""
    out["one_hot_topic"] = q(places, f"SELECT video_id, {hot} FROM placed")
    first_generation = {
        **{f"{c}_log": f"ln(1 + CAST(coalesce({c}, 0) AS DOUBLE))" for c in ("plays_day0", "plays_day1", "plays_day3", "likes_day3", "follower_count")},
        **{c: f"coalesce({c}, 0)" for c in ("duration", "speaking_rate", "joy", "sadness", "anger")},
    }
    out["feat_v1"] = q(places, f"SELECT video_id, create_date, {r6(_lp('plays_day30'), 'y')}, {pick(first_generation)}, {hot} FROM placed")

    # metrics, baselines, leaderboards
    out["baseline_mean"] = q(SUMMARY + "," + BASELINES, f"SELECT video_id, {r6s('y', 'yhat')} FROM mean_pred")
    out["baseline_day3_ratio"] = q(SUMMARY + "," + BASELINES, f"SELECT video_id, {r6s('y', 'yhat')} FROM ratio_pred")
    out["baseline_velocity"] = q(SUMMARY + "," + BASELINES, f"SELECT video_id, {r6s('y', 'yhat')} FROM speed_pred")
    out["baseline_naive_scale"] = q(SUMMARY, " UNION ALL ".join(
        f"SELECT CAST({d} AS BIGINT) AS day, video_id, {r6('coalesce(plays_day30, 0)', 'y')}, {r6(f'plays_day{d} * (SELECT median(plays_day30 / (plays_day{d} + CAST(1 AS DOUBLE))) FROM summary)', 'yhat')} FROM summary" for d in (1, 3)))
    out["error_metrics"] = q(SUMMARY + "," + BASELINES, _error_metrics("predictions", "model"))
    log_rows = SUMMARY + f""",
logs AS (SELECT 'day 3 level' AS model, {LOG_Y} AS y, ln(1 + {P3}) AS yhat FROM summary
  UNION ALL SELECT 'negative', {LOG_Y}, -ln(1 + {P3}) FROM summary),
held AS (SELECT model, y AS ly, greatest(-1, least(25, yhat)) AS lh FROM logs),
original AS (SELECT model, exp(ly) - 1 AS y, greatest(exp(lh) - 1, 0) AS yhat, ly, lh FROM held)"""
    out["log_scale_metrics"] = q(log_rows, _error_metrics("original", "model", True, ", " + r6("1 - avg((ly - lh) * (ly - lh)) / var_pop(ly)", "r2_log")).replace("AS r2,", "AS r2_raw,"))
    unrounded = _error_metrics("predictions", "model").replace(", 6) + 0.0 AS", ", 12) + 0.0 AS")
    out["cv_summary"] = q(SUMMARY + "," + BASELINES + ",\nscores AS (" + unrounded + ")",
        f"SELECT 'rmse' AS metric, {r6('avg(rmse)', 'mean')}, {r6('stddev_samp(rmse)', 'std')} FROM scores UNION ALL SELECT 'smape', {r6('avg(smape)', 'mean')}, {r6('stddev_samp(smape)', 'std')} FROM scores")
    series_scores = _error_metrics("(SELECT 'Trend + weekday' AS model, actual AS y, forecast AS yhat FROM trend) t", "model")
    board = (
        SUMMARY + "," + BASELINES + ",\n" + TREND[len(CLEAN):].lstrip(",\n")
        + f",\nboard AS (SELECT 'A: per-video increment' AS track, * FROM ({_error_metrics('predictions', 'model')}) a UNION ALL SELECT 'B: topic series', * FROM ({series_scores}) b)"
    )
    columns = "track, model, n, mae, medae, rmse, wape, smape, r2"
    out["leaderboard_union"] = q(board, f"SELECT {columns} FROM board")
    out["track_leaderboards"] = out["leaderboard_union"]
    out["leaderboard_sort"] = q(board, f"SELECT {columns}, row_number() OVER (PARTITION BY track ORDER BY smape, model) AS place FROM board")

    # forecasts
    out["forecast_trend_weekly"] = q(TREND, f"SELECT topic, date, {r6s('actual', 'forecast')} FROM trend")

    # decisions
    gain = "CAST(incr_plays_3_30 AS DOUBLE)"
    out["tier_lookup"] = q(SUMMARY, f"SELECT video_id, {TIER[0].format(x=gain)} AS tier, {TIER[3].format(x=gain)} AS tier_badge FROM summary")
    out["virality_tier"] = q(SUMMARY, f"SELECT {TIER[0].format(x=gain)} AS tier, {TIER[4].format(x=gain)} AS tier_desc, count(*) AS video_count FROM summary GROUP BY 1, 2")
    out["triage_score"] = q(SUMMARY + INPUTS, f"SELECT video_id, {r6s('score')}, {_status(1)} AS status, {_status(2)} AS color, {_status(3)} AS recommendation, {r6('decay', 'decay_ratio')}, {r6('speed', 'velocity_1_3')}, {r6('accel', 'acceleration')}, {r6('likes * 100', 'like_rate_pct')} FROM scored")
    out["momentum_trend"] = q(SUMMARY, f"SELECT video_id, CASE WHEN acceleration > 0 THEN {text(fixed.TREND_UP)} ELSE {text(fixed.TREND_DOWN)} END AS trend FROM summary")
    curve = ", ".join(f"({d}, power(CAST({w} AS DOUBLE), CAST(0.7 AS DOUBLE)))" for d, w in zip(fixed.FORECAST_DAYS, fixed.FORECAST_WEIGHTS))
    start, med = P3, f"greatest({Y}, 0)"
    power = "(CAST(10 AS DOUBLE) ** floor(log10(abs(forecast))))"
    digits = f"CASE WHEN forecast = 0 THEN 0 ELSE round(forecast / {power}, 8) * {power} END"
    out["forecast_seasonal_ar"] = qr(SEASONAL, f"SELECT topic, date, {r6('actual', 'actual')}, {r6(digits, 'forecast')} FROM foreseen")
    out["forecast_curve"] = q(SUMMARY, f"SELECT video_id, CAST(c.day AS BIGINT) AS day, {r6(f'{start} + {med} * w', 'median')}, {r6(f'{start} + {med} * 0.5 * w', 'low')}, {r6(f'{start} + {med} * 2 * w', 'high')} FROM summary CROSS JOIN (VALUES {curve}) AS c(day, w)")
    out["draft_defaults"] = q(DRAFTS, f"SELECT draft_id, topic, {r6s('duration', 'follower_count', 'creator_median_plays30', 'speaking_rate', 'hashtag_count', 'is_english', 'word_count', 'comment_rate', 'share_rate', 'plays_day0', 'plays_day1', 'plays_day3')}, {r6('plays_day3 * 1.15', 'plays_day7')}, {r6('plays_day3 * 0.08', 'likes_day3')} FROM filled")
    out["profile_lookup"] = q(DRAFTS, f"SELECT d.draft_id, coalesce(p.topic, 'Others') AS topic, {r6('p.mid', 'median_duration')}, {r6('p.p25', 'p25_duration')}, {r6('p.p75', 'p75_duration')} FROM drafts d LEFT JOIN profiles p ON d.topic = p.topic")
    tips = DRAFTS + """,
lengths AS (SELECT f.draft_id, f.topic, f.duration, f.hook, f.speaking_rate, coalesce(p.p25, 15) AS low, coalesce(p.p75, 30) AS high FROM filled f LEFT JOIN profiles p ON f.topic = p.topic),
tips AS (
  SELECT draft_id, 1 AS k, CASE WHEN duration > high THEN """ + _tip(fixed.TIP_TOO_LONG) + " WHEN duration < low THEN " + _tip(fixed.TIP_VERY_SHORT) + " ELSE " + _tip(fixed.TIP_GOOD_LENGTH) + f""" END AS tip FROM lengths
  UNION ALL SELECT draft_id, 2, CASE hook WHEN 'High' THEN {text(fixed.TIP_STRONG_HOOK)} WHEN 'Low' THEN {text(fixed.TIP_WEAK_HOOK)} END FROM lengths
  UNION ALL SELECT draft_id, 3, CASE WHEN speaking_rate < 2.2 THEN {text(fixed.TIP_SLOW_SPEECH)} END FROM lengths)"""
    out["draft_tips"] = q(tips, "SELECT draft_id, row_number() OVER (PARTITION BY draft_id ORDER BY k) AS tip_no, tip FROM tips WHERE tip IS NOT NULL")
    out["priority_rank"] = q(SUMMARY, f"SELECT video_id, {r6(f'{P3} + {Y}', 'total_expected')}, '#' || CAST(row_number() OVER (ORDER BY {P3} + {Y} DESC, video_id) AS VARCHAR) AS priority FROM summary")
    out["level_maps"] = q(DRAFTS, f"SELECT draft_id, {r6('CASE hook WHEN ' + text('Low') + ' THEN 0.1 WHEN ' + text('Medium') + ' THEN 0.45 WHEN ' + text('High') + ' THEN 0.8 END', 'planner_level')}, {r6('CASE hook WHEN ' + text('Low') + ' THEN 0.15 WHEN ' + text('Medium') + ' THEN 0.45 WHEN ' + text('High') + ' THEN 0.8 ELSE 0.45 END', 'idea_level')} FROM drafts")

    # scalar function families
    out["math_functions"] = q(SUMMARY, f"SELECT video_id, {r6('ln(1 + plays_day30)', 'log1p_plays')}, {r6('exp(joy) - 1', 'expm1_joy')}, {r6('abs(acceleration)', 'abs_accel')}, {r6('power(joy, 0.7)', 'powered')}, {r6('CASE WHEN decay_ratio > 10 THEN 10 WHEN decay_ratio < -10 THEN -10 ELSE decay_ratio END', 'clipped')}, {r6('round_even(creator_avg_plays30, 1)', 'rounded')}, {r6('greatest(velocity_1_3, 0)', 'positive')} FROM summary")
    out["date_functions"] = q(SUMMARY, "SELECT video_id, CAST(dayofweek(create_date) + 1 AS BIGINT) AS sunday_first, CAST(isodow(create_date) - 1 AS BIGINT) AS monday_zero, CAST(month(create_date) AS BIGINT) AS month_no, isodow(create_date) >= 6 AS is_weekend, CAST(date_diff('day', (SELECT min(create_date) FROM summary), create_date) AS BIGINT) AS since_start FROM summary")
    out["string_functions"] = q(JOINED, f"SELECT video_id, {_music()} AS music_category, replace(coalesce(music_selected_from, ''), '_', ' ') AS music_label, format('{{:,}}', plays_day30) AS shown_views, CAST(plays_day30 AS VARCHAR) || 's' AS suffixed FROM joined")
    out["null_functions"] = q(SUMMARY, f"SELECT video_id, {r6('coalesce(duration, 15)', 'duration_filled')}, coalesce(is_english, 1) AS english_filled, CAST(word_count IS NULL AS BIGINT) AS word_count_missing FROM summary")
    out["bucket_functions"] = q(SUMMARY, f"SELECT video_id, {bucket_case('duration', fixed.DURATION_BUCKETS)} AS duration_bucket, {bucket_case('coalesce(hashtag_count, 0)', fixed.HASHTAG_BUCKETS)} AS hashtag_bucket FROM summary")
    return out
