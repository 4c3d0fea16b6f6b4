"""Labels, thresholds and texts that results must carry exactly as listed here."""

SNAPSHOT_DAYS = (0, 1, 3, 7, 30)
NOTEBOOK_SNAPSHOT_DAYS = (0, 1, 3, 30)
CURVE_DAYS = (0, 1, 2, 3, 5, 7, 10, 14, 21, 30)
PANEL_DAYS = (3, 5, 7, 10, 14, 18, 24, 30)

EMOTIONS = ("joy", "disgust", "sadness", "anger", "surprise", "fear")
TEXT_COLUMNS = ("word_count", "speaking_rate", "hashtag_count")

VIDEO_COLUMNS = (
    "video_id", "author_id", "create_date", "duration", "is_english", "topic",
    "word_count", "speaking_rate", "hashtag_count",
) + EMOTIONS
CREATOR_COLUMNS = (
    "author_id", "date", "follower_count", "following_count", "total_favorited", "enterprise_verified",
)

# (label, exclusive lower edge, inclusive upper edge)
DURATION_BUCKETS = (
    ("Quick (< 20s)", 0.0, 20.0),
    ("Medium (20-45s)", 20.0, 45.0),
    ("In-Depth (45s+)", 45.0, 300.0),
)
CADENCE_BUCKETS = (
    ("< 1 / week", 0.0, 1.0),
    ("1 to 3 / week", 1.0, 3.5),
    ("4 to 7 / week (1/day)", 3.5, 7.5),
    ("8 to 14 / week (2/day)", 7.5, 14.5),
    ("15+ / week (3+/day)", 14.5, 100.0),
)
HASHTAG_BUCKETS = (
    ("0 tags (No tags)", -1.0, 0.0),
    ("1 to 2 tags", 0.0, 2.0),
    ("3 to 5 tags (Sweet spot)", 2.0, 5.0),
    ("6 to 8 tags", 5.0, 8.0),
    ("9 to 15 tags", 8.0, 15.0),
    ("16+ tags (Spam)", 15.0, 200.0),
)

# (substring looked for in the lower-cased value, category); the first hit wins
MUSIC_RULES = (
    ("original", "Original Creator Audio"),
    ("single_song", "Licensed Commercial Track"),
    ("recommend", "Trending Recommended Sound"),
    ("search", "Searched Specific Sound"),
)
MUSIC_OTHER = "Other Sound Effect / Audio"

FLASH = "Flash Burn (Fast Decay)"
STEADY = "Steady Organic (Balanced)"
EVERGREEN = "Evergreen / Slow Burn (Compounding)"
ARCHETYPES = (FLASH, STEADY, EVERGREEN)
FLASH_FLOOR = 0.80
STEADY_FLOOR = 0.45
MIN_CURVE_VIEWS = 50

# (tier, lower edge inclusive, upper edge exclusive, badge, description)
TIERS = (
    ("Low Reach (<1K views)", 0.0, 1000.0, "gray",
     "Remains within initial test viewers. Did not get picked up by the recommendation algorithm."),
    ("Average Reach (1K - 15K views)", 1000.0, 15000.0, "blue",
     "Solid baseline performance. Circulates normally among your followers and topic feeds."),
    ("High Growth (15K - 100K views)", 15000.0, 100000.0, "purple",
     "Pushed to broader For You feeds with strong viewer retention."),
    ("Viral Hit (100K+ views)", 100000.0, float("inf"), "gold",
     "Top-tier breakout content with heavy sharing and exponential reach."),
)

TRIAGE_START, TRIAGE_LEAST, TRIAGE_MOST = 40.0, 5.0, 99.0
# per signal: above or below an edge, points; the first that holds counts
TRIAGE_POINTS = {
    "decay_level_ratio": (("above", 1.25, 25), ("above", 1.0, 15), ("below", 0.6, -20)),
    "acceleration": (("above", 50, 20), ("below", -50, -15)),
    "like_rate": (("above", 0.08, 15), ("below", 0.03, -10)),
    "increment": (("above", 20000, 20), ("below", 1000, -15)),
}
# (lowest score, status, colour, recommendation)
TRIAGE_STATUSES = (
    (70.0, "Boost with Paid Budget (High Priority)", "#10b981",
     "Strong audience interest detected. Viewers are watching and engaging at above-average rates. "
     "Action Plan: Put paid boost budget behind this video today. Pin it to the top of your profile. "
     "Plan and record a follow-up video or Part 2 within 48 hours to capitalize on the audience momentum."),
    (45.0, "Let Grow Organically (Steady Momentum)", "#3b82f6",
     "Video is performing consistently with healthy organic viewership. "
     "Action Plan: Reply to top comments to keep viewer conversations active and encourage shares. "
     "Keep paid ad budget in reserve for now and check back in a few days."),
    (float("-inf"), "Rethink Concept / Low Momentum", "#ef4444",
     "Views are slowing down quickly after upload. "
     "Action Plan: Do not spend ad money on this video. Review where viewers dropped off in the first 3 seconds, "
     "tweak the opening hook for your next video, and move your focus to new content ideas."),
)

TREND_UP = "Speeding Up"
TREND_DOWN = "Normal Decay"

FORECAST_DAYS = (3, 7, 14, 21, 30)
FORECAST_WEIGHTS = (0.0, 0.25, 0.60, 0.85, 1.0)
FORECAST_POWER = 0.7

PLANNER_LEVELS = {"Low": 0.1, "Medium": 0.45, "High": 0.8}
IDEA_HOOKS = {"Low": 0.15, "Medium": 0.45, "High": 0.8}
FALLBACK_TOPIC = "Others"

TIP_TOO_LONG = (
    "Video Length: In {topic}, most top-performing videos are between {p25} and {p75} seconds. "
    "Your draft is {duration} seconds. Consider trimming 10–15 seconds to boost completion rate."
)
TIP_VERY_SHORT = (
    "Video Length: Very quick video ({duration}s). "
    "Great for repeat rewatches if the ending loops back into the beginning."
)
TIP_GOOD_LENGTH = "Video Length: At {duration} seconds, this video is in the optimal length range for {topic}."
TIP_STRONG_HOOK = (
    "Opening Hook: Starting with strong curiosity helps stop people from swiping away in the critical first 3 seconds."
)
TIP_WEAK_HOOK = (
    "Opening Hook: Consider adding a bolder opening statement or question in the first 3 seconds to spark curiosity."
)
TIP_SLOW_SPEECH = (
    "Talking Speed: Speech pace is a bit slow. Cutting out brief pauses between sentences in editing "
    "can make the video feel faster and more dynamic."
)
SLOW_SPEECH_BELOW = 2.2

# Defaults of a draft row
DRAFT_DEFAULTS = {
    "topic": "Beauty_Fashion", "duration": 20.0, "follower_count": 10000.0, "creator_median_plays30": 500.0,
    "is_english": 1.0, "speaking_rate": 2.8, "word_count": 40.0, "hashtag_count": 4.0,
    "comment_rate": 0.005, "share_rate": 0.01,
}
# Early counters of a draft that has not run yet, as shares of another value
DRAFT_PLAY_SHARES = {"plays_day0": 0.4, "plays_day1": 0.7, "plays_day3": 0.95}
DRAFT_DAY7_OF_DAY3 = 1.15
DRAFT_LIKES_OF_DAY3 = 0.08

LIBRARY_LABELS = {
    "topic": "Category", "duration": "Length (s)", "plays_day1": "Day 1 Views", "plays_day3": "Day 3 Views",
    "plays_day30": "Total 30-Day Views", "incr_plays_3_30": "Views Gained (Day 3 to 30)",
}

TARGET = "incr_plays_3_30"
NOT_FEATURES = (
    "video_id", "incr_plays_3_30", "incr_likes_3_30", "incr_comments_3_30", "incr_shares_3_30",
    "plays_day30", "likes_day30", "comments_day30", "shares_day30",
)
ENCODING_SMOOTHING = 30.0

FEATURES_V3 = (
    "plays_day0_log", "plays_day1_log", "plays_day3_log", "plays_day7_log",
    "likes_day3_log", "likes_day7_log", "shares_day7_log",
    "velocity_0_1_log", "velocity_1_3_log", "acceleration_val", "decay_ratio_val", "velocity_3_7",
    "like_rate", "comment_rate", "share_rate", "like_rate_day7",
    "creator_median_log", "creator_video_count_val", "penetration_rate_val", "follower_count_log",
    "velocity_1_3_rank_pct", "plays_day3_rank_pct", "creator_median_plays30_rank_pct", "follower_count_rank_pct",
    "plays_day3_topic_rank_pct", "velocity_1_3_topic_rank_pct",
    "post_day_of_week", "post_month", "post_is_weekend", "days_since_start",
    "duration", "is_english", "word_count", "speaking_rate", "hashtag_count",
    "word_count_missing", "speaking_rate_missing", "hashtag_count_missing",
) + EMOTIONS

# The live check fills a draft from what a running post shows.
LIVE_MEDIAN_OF_DAY3 = 0.8
LIVE_FOLLOWERS = 25000.0
