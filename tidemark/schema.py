"""Labels, thresholds, fixed vocabularies and canonical table schemas."""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Fixed values.  These have to be exactly these words, in this order, because
# results (label ids, matched keywords, aliases) are defined by them.
# --------------------------------------------------------------------------
LABELS = ("积极", "愤怒", "悲伤", "恐惧", "惊讶", "中性")
LABELS_EN = ("happy", "angry", "sad", "fear", "surprise", "neutral")
PROB_COLUMNS = (
    "prob_positive", "prob_angry", "prob_sad", "prob_fear", "prob_surprise", "prob_neutral",
)
NEGATIVE_IDS = (1, 2, 3)
ANGER_FEAR_IDS = (1, 3)
SOURCE_TYPES = ("hot", "keyword", "kol", "retweet")

LABEL_ALIASES = {
    "快乐": "积极", "开心": "积极", "高兴": "积极", "喜悦": "积极", "喜欢": "积极",
    "支持": "积极", "赞赏": "积极", "欣慰": "积极", "感动": "积极",
    "生气": "愤怒", "气愤": "愤怒", "愤慨": "愤怒", "不满": "愤怒", "抱怨": "愤怒",
    "责备": "愤怒", "厌恶": "愤怒", "反感": "愤怒", "吐槽": "愤怒",
    "失望": "悲伤", "难过": "悲伤", "伤心": "悲伤", "沮丧": "悲伤", "遗憾": "悲伤",
    "心疼": "悲伤", "委屈": "悲伤", "哀伤": "悲伤",
    "害怕": "恐惧", "担心": "恐惧", "焦虑": "恐惧", "忧虑": "恐惧", "惊恐": "恐惧",
    "恐慌": "恐惧", "紧张": "恐惧",
    "震惊": "惊讶", "惊奇": "惊讶", "意外": "惊讶", "吃惊": "惊讶", "惊喜": "惊讶",
    "无": "中性", "无明显情感": "中性", "客观": "中性", "平静": "中性", "陈述": "中性",
    "无情绪": "中性", "中立": "中性",
}
REVIEW_TRUE_WORDS = ("1", "true", "yes", "y", "是", "需要")

BUCKETS = ("fear", "surprise", "anger_sad_boundary", "hard_negative")
BUCKET_LABEL_IDS = {
    "fear": (3,), "surprise": (4,), "anger_sad_boundary": (1, 2), "hard_negative": (0, 5),
}
BUCKET_QUOTAS = {
    "fear": 2200, "surprise": 1800, "anger_sad_boundary": 2500, "hard_negative": 1000,
}
HEURISTIC_BASE = {"fear": 120, "surprise": 105, "anger_sad_boundary": 95, "hard_negative": 75}
SELECTION_BASE = {"fear": 110, "surprise": 98, "anger_sad_boundary": 88, "hard_negative": 68}

FEAR_WORDS = (
    "安全风险", "安全隐患", "风险", "事故", "出事", "诈骗", "被骗", "骗钱", "危险", "危急",
    "担心", "害怕", "可怕", "怕了", "吓人", "吓死", "吓坏", "恐慌", "惊恐", "焦虑",
    "不敢", "求助", "报警", "失联", "坠落", "爆炸", "起火", "火灾", "中毒",
    "感染", "传染", "过敏", "后怕", "恐怖", "威胁", "避雷", "踩雷", "黑心",
)
SURPRISE_WORDS = (
    "震惊", "惊呆", "惊了", "没想到", "想不到", "居然", "竟然", "真的假的", "真假的",
    "离谱", "离大谱", "反转", "突然", "突发", "猝不及防", "不可思议", "匪夷所思",
    "刷新认知", "破防了", "意外", "惊喜", "惊讶", "震撼", "好家伙", "万万没想到",
)
ANGER_SAD_WORDS = (
    "失望", "心寒", "寒心", "心疼", "难受", "难过", "委屈", "憋屈", "无语", "气死",
    "气炸", "凭什么", "太过分", "过分", "恶心", "离谱", "服了", "受不了", "忍不了",
    "欺负", "坑人", "坑了", "骗了", "不公平", "不公", "投诉", "维权", "退钱", "赔偿",
    "无奈", "遗憾", "累了", "心累", "崩溃", "泪目", "破防", "烦死", "糟心",
)
OBJECTIVE_CUES = (
    "公告", "通报", "通知", "提醒", "预警", "辟谣", "声明", "回应", "发布", "公布",
    "报告", "数据显示", "据悉", "记者", "官方", "警方", "消防", "医院", "法院",
    "市场监管", "召回", "处罚", "立案", "调查", "提示", "科普", "指南",
)
EMOTION_TERMS = (
    "开心", "快乐", "喜欢", "惊喜", "震惊", "离谱", "可怕", "担心", "害怕", "焦虑",
    "愤怒", "生气", "心疼", "难过", "失望", "无语", "气死", "破防", "崩溃",
)
SARCASM_TERMS = (
    "真棒", "太棒了", "可真行", "真有你的", "谢谢你啊", "谢谢您", "笑死", "赢麻了",
    "绝了", "服了", "好家伙", "厉害了", "太会了", "真不错啊", "可太好了",
)

ROLE_NAMES = (
    "entry_kol", "verified_actor", "high_follower_actor", "high_interaction",
    "negative_polarized", "active_voice", "cross_topic",
)
ROLE_DISPLAY = (
    ("verified_actor", "认证账号"),
    ("entry_kol", "KOL 入口账号"),
    ("high_follower_actor", "高粉账号"),
    ("high_interaction", "高互动账号"),
    ("negative_polarized", "负面极化账号"),
    ("cross_topic", "跨话题账号"),
    ("active_voice", "活跃账号"),
)
ORDINARY_DISPLAY = "普通账号"
RISK_FACTOR_WEIGHTS = {
    "negative_ratio": 25, "negative_growth": 20, "interaction_growth": 20,
    "anger_fear": 15, "kol_verified": 10, "source_diversity": 10,
}
# Sentences shown with every context pack; deployments bring their own.
DATA_CAVEATS = (
    "Comments are those that were collected, which may be fewer than were written.",
    "Shares count scored samples; coverage follows the collection.",
    "Risk scores order the topics of one time range and are not comparable across ranges.",
    "Times are stored in UTC and shown in local time.",
)
REQUEST_NAMES = (
    "overview", "risk_topics", "topic_detail", "actors", "evidence",
    "emotion_timeseries", "model_quality", "model_disagreement", "data_quality",
)


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits; every one can be overridden."""

    primary_model: str = "primary"
    secondary_model: str = "secondary"
    stable_day_threshold: int = 10000
    growth_smoothing: float = 5.0
    topic_min_posts: int = 3
    topic_limit: int = 20
    low_confidence: float = 0.70
    low_margin: float = 0.15
    high_followers: int = 10_000
    polar_ratio: float = 0.60
    polar_min_samples: int = 3
    active_min_samples: int = 10
    cross_topic_min: int = 3
    actor_limit: int = 20
    evidence_limit: int = 8


DEFAULTS = Settings()


# Canonical table schemas as DDL.  Times are UTC without zone.
TABLE_SCHEMAS = {
    "topic": (
        "topic_id bigint, title string, lead string, hot_value string, read_count bigint, "
        "discuss_count bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
        "crawled_at timestamp_ntz"
    ),
    "post": (
        "post_id bigint, user_id bigint, retweet_of bigint, mblogid string, text_raw string, "
        "region_name string, source_client string, raw_json string, created_at timestamp_ntz, "
        "first_crawled_at timestamp_ntz, last_crawled_at timestamp_ntz, edit_count int, "
        "mblog_type int, visible_type int, has_images boolean, has_video boolean, "
        "is_long_text boolean"
    ),
    "engagement": (
        "post_id bigint, captured_at timestamp_ntz, comments_count bigint, "
        "attitudes_count bigint, reposts_count bigint"
    ),
    "post_topic": "post_id bigint, topic_id bigint, linked_at timestamp_ntz",
    "post_media": (
        "post_id bigint, media_type string, media_id string, media_url string, "
        "order_index int, width int, height int, crawled_at timestamp_ntz"
    ),
    "discovery": (
        "post_id bigint, source_type string, source_value string, discovered_at timestamp_ntz"
    ),
    "comment": (
        "comment_id bigint, post_id bigint, parent_comment_id bigint, "
        "reply_to_comment_id bigint, user_id bigint, like_count bigint, floor_number bigint, "
        "text_raw string, region_name string, source_client string, created_at timestamp_ntz, "
        "first_crawled_at timestamp_ntz"
    ),
    "user": (
        "uid bigint, followers_count bigint, friends_count bigint, statuses_count bigint, "
        "screen_name string, description string, location string, verified_reason string, "
        "gender string, ip_location string, birthday string, avatar_hd string, "
        "profile_url string, verified boolean, verified_type int, mbrank int, mbtype int, "
        "profile_tier int, labels array<string>, registered_at timestamp_ntz, "
        "profile_fetched_at timestamp_ntz, first_seen_at timestamp_ntz"
    ),
    "prediction": (
        "source_type string, source_id bigint, post_id bigint, "
        "source_created_at timestamp_ntz, content_hash string, model_key string, "
        "model_version string, checkpoint string, pred_label string, pred_label_id int, "
        "confidence float, second_label string, second_label_id int, second_prob float, "
        "margin float, prob_positive float, prob_angry float, prob_sad float, "
        "prob_fear float, prob_surprise float, prob_neutral float, predicted_at timestamp_ntz"
    ),
}

# table -> (key columns, version column); None = append-only, kept as is.
TABLE_KEYS = {
    "topic": (("topic_id",), "crawled_at"),
    "post": (("post_id",), "last_crawled_at"),
    "engagement": None,
    "post_topic": (("post_id", "topic_id"), "linked_at"),
    "post_media": (("post_id", "media_id"), "crawled_at"),
    "discovery": None,
    "comment": (("post_id", "comment_id"), "first_crawled_at"),
    "user": (("uid",), "profile_fetched_at"),
    "prediction": (("model_version", "source_type", "source_id"), "predicted_at"),
}
# first-seen columns keep the earliest value over all versions of a key
FIRST_SEEN = {
    "topic": "first_seen_at", "post": "first_crawled_at",
    "comment": "first_crawled_at", "user": "first_seen_at",
}
