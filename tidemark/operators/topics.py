"""Topic metrics, risk factors and topic detail (TOP-01..22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import (
    clip_norm, growth_label, local_day, local_iso, mean_micros, micros, ratio, risk_level, round_to,
)
from tidemark.functions.text import contains_ignore_case
from tidemark.operators.joins import hot_keys, join_unique, salted
from tidemark.operators.quantiles import nearest_rank
from tidemark.operators.samples import (
    EMOTION_COUNTS, dominant_emotion_id, emotion_aggregates, interactions, of_topic, predictions_in,
    topic_links,
)
from tidemark.operators.window import TimeWindow
from tidemark.schema import (
    ANGER_FEAR_IDS, DEFAULTS, NEGATIVE_IDS, RISK_FACTOR_WEIGHTS, SOURCE_TYPES, Settings,
)
from tidemark.session import stored

CAPPED = {
    "negative_growth": "negative_growth_raw",
    "interaction_growth": "interaction_delta",
    "kol_verified": "kol_verified_raw",
}
_PREDICTED = [*EMOTION_COUNTS, "sample_count", "confidence_micros", "post_samples", "comment_samples",
              "recent_negative"]


# ------------------------------------------------------------ one row per post
def post_growth(seen: DataFrame) -> DataFrame:
    """First and last interaction sums of each post in a set of snapshots."""
    return seen.groupBy("post_id").agg(
        F.min_by(interactions(), F.col("captured_at")).alias("earliest"),
        F.max_by(interactions(), F.col("captured_at")).alias("latest"))


def post_sources(discovery: DataFrame) -> DataFrame:
    """One flag per discovery source of each post."""
    return discovery.groupBy("post_id").agg(*[
        F.max(F.when(F.col("source_type") == t, 1).otherwise(0)).alias(f"from_{t}")
        for t in SOURCE_TYPES])


def notable_posts(tables, window: TimeWindow, s: Settings = DEFAULTS) -> DataFrame:
    """Posts created in the window; author id and flags only for verified or big accounts."""
    high = (F.col("profile_tier") >= 1) & (F.col("followers_count") >= s.high_followers)
    notable = tables.user.select(
        F.col("uid").alias("user_id"), F.col("uid").alias("author"),
        F.col("verified").cast("int").alias("author_verified"),
        high.cast("int").alias("author_high"),
    ).filter("author_verified = 1 or author_high = 1")
    posts = window.within(tables.post, "created_at").select("post_id", "user_id")
    return join_unique(posts, notable, "user_id", "post_id").drop("user_id").withColumn(
        "created_in_window", F.lit(1))


def post_features(tables, window: TimeWindow, s: Settings = DEFAULTS) -> DataFrame:
    """All counters a topic needs, one row per post.

    Predictions, snapshots, discoveries and posts are stacked as narrow rows and folded in one
    aggregation: every input is combined in its map tasks and shuffled once, and a viral post
    arrives as one partial row per task.
    """
    pred = predictions_in(tables.prediction, window, s.primary_model)
    predicted = pred.select(
        "post_id", "source_type", "pred_label_id", micros(F.col("confidence")).alias("micros"),
        window.recent(pred, "source_created_at").alias("recent"))
    snapshots = window.within(tables.engagement, "captured_at").select(
        "post_id", "captured_at", interactions().alias("total"))
    found = tables.discovery.select("post_id", F.col("source_type").alias("found_by"))
    parts = [predicted, snapshots, found, notable_posts(tables, window, s)]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    label, kind = F.col("pred_label_id"), F.col("source_type")
    negative = label.isin(*NEGATIVE_IDS)
    return stacked.groupBy("post_id").agg(
        *[F.count_if(label == i).alias(c) for i, c in enumerate(EMOTION_COUNTS)],
        F.count(label).alias("sample_count"),
        F.coalesce(F.sum("micros"), F.lit(0)).alias("confidence_micros"),
        F.count_if(kind == "post").alias("post_samples"),
        F.count_if(kind == "comment").alias("comment_samples"),
        F.count_if(negative & F.col("recent")).alias("recent_negative"),
        F.min_by("total", "captured_at").alias("earliest"),
        F.max_by("total", "captured_at").alias("latest"),
        *[F.count_if(F.col("found_by") == t).alias(f"from_{t}") for t in SOURCE_TYPES],
        F.max("created_in_window").alias("created_in_window"), F.max("author").alias("author"),
        F.max("author_verified").alias("author_verified"),
        F.max("author_high").alias("author_high"))


# ----------------------------------------------------------- one row per topic
def topic_totals(tables, window: TimeWindow, s: Settings = DEFAULTS,
                 links: DataFrame | None = None) -> DataFrame:
    """Metrics of every topic: posts, emotions, engagement, source mix, KOL and author signals.

    Totals are folded per (topic, notable author) first.  The second fold then counts distinct
    authors by counting rows, without a distinct aggregate.  Both follow one move by topic, in which the
    authors of a busy topic are dealt to several tasks.  In a plan that keeps
    written tables on disk the rows per post are written first, so that what they shuffle is not there
    together with the move by topic.
    """
    kept = links is None and tables.is_kept("post_topic")
    links = (tables.post_topic if links is None else links).select("post_id", "topic_id")
    if not kept:  # the search for hot posts and the join read the links
        links = stored(links, "links")
    features = post_features(tables, window, s)
    if kept:
        features = stored(features, "features")
    linked = join_unique(links, features, "post_id", "topic_id", how="inner")
    predicted = F.col("sample_count") > 0
    gain = F.greatest(F.col("latest") - F.col("earliest"), F.lit(0))
    created = F.col("created_in_window") == 1
    sums = {
        "post_count": predicted.cast("bigint"),
        **{c: F.col(c) for c in _PREDICTED},
        "earliest_interactions": F.col("earliest"),
        "latest_interactions": F.col("latest"),
        "interaction_delta": gain,
        **{f"source_{t}": (predicted & (F.col(f"from_{t}") > 0)).cast("bigint")
           for t in SOURCE_TYPES},
        "kol_entry_count": (created & (F.col("from_kol") > 0)).cast("bigint"),
    }
    dealt = salted(linked, hot_keys(links, "topic_id"), "topic_id", F.coalesce("author", -F.col("post_id"))).select(
        "topic_id", "_salt", "author", "author_verified", "author_high",
        *[v.alias(k) for k, v in sums.items()]).repartition("topic_id", "_salt")
    per_author = dealt.groupBy("topic_id", "_salt", "author").agg(
        *[F.sum(k).alias(k) for k in sums],
        F.max("author_verified").alias("author_verified"), F.max("author_high").alias("author_high"))
    shares = per_author.groupBy("topic_id", "_salt").agg(
        *[F.sum(k).alias(k) for k in sums],
        F.count_if(F.col("author_verified") == 1).alias("verified_actor_count"),
        F.count_if(F.col("author_high") == 1).alias("high_follower_actor_count"))
    def labelled(ids) -> Column:
        return sum((F.col(EMOTION_COUNTS[i]) for i in ids), F.lit(0))
    return shares.groupBy("topic_id").agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in sums],
        F.sum("verified_actor_count").alias("verified_actor_count"),
        F.sum("high_follower_actor_count").alias("high_follower_actor_count"),
    ).withColumns({"negative_count": labelled(NEGATIVE_IDS), "anger_fear_count": labelled(ANGER_FEAR_IDS)}
    ).withColumn("previous_negative", F.col("negative_count") - F.col("recent_negative"))


def matches(q: str) -> Column:
    """Whether a topic's title or lead contains the search text."""
    return contains_ignore_case(q, F.col("title"), F.col("lead"))


def known_topics(tables, totals: DataFrame) -> DataFrame:
    """The metrics of every topic that has a row in the topic table."""
    return totals.join(tables.topic.select("topic_id", "title", "lead"), "topic_id")


def candidate_topics(tables, totals: DataFrame, q: str = "", s: Settings = DEFAULTS) -> DataFrame:
    """Known topics with enough predicted posts."""
    found = known_topics(tables, totals.filter(F.col("post_count") >= s.topic_min_posts))
    return found.filter(matches(q)) if q else found


def add_raw_factors(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Unnormalised risk factors of each topic."""
    zero = F.lit(0)
    sources = sum((F.when(F.col(f"source_{t}") > 0, 1).otherwise(0) for t in SOURCE_TYPES), zero)
    return df.withColumns({
        "negative_ratio_raw": ratio(F.col("negative_count"), F.col("sample_count")),
        "anger_fear_ratio_raw": ratio(F.col("anger_fear_count"), F.col("sample_count")),
        "negative_growth_raw": ratio(
            F.col("recent_negative") - F.col("previous_negative"),
            F.col("previous_negative") + F.lit(s.growth_smoothing)),
        "interaction_growth_ratio": ratio(
            F.col("interaction_delta"), F.greatest(F.col("earliest_interactions"), F.lit(1))),
        "kol_verified_raw": F.col("kol_entry_count") + F.col("verified_actor_count")
        + F.col("high_follower_actor_count"),
        "source_diversity_raw": ratio(sources, F.lit(len(SOURCE_TYPES))),
    })


def window_caps(pool: DataFrame) -> DataFrame:
    """One row: nearest-rank p95 over the positive values of each capped factor, 1.0 if none."""
    values = pool.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("v"))
        for name, c in CAPPED.items()]))).filter("v > 0")
    caps = nearest_rank(values, ["name"], "v", 0.95)
    return caps.agg(*[
        F.coalesce(F.max(F.when(F.col("name") == name, F.col("v"))), F.lit(1.0))
        .alias(f"cap_{name}") for name in CAPPED])


def with_caps(candidates: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Candidates with the caps of the pool (or their own) on every row."""
    caps = window_caps(candidates if pool is None else pool).select(
        F.struct("*").alias("c")).scalar()
    return candidates.withColumn("_caps", caps).select("*", "_caps.*").drop("_caps")


def factor_points(df: DataFrame) -> DataFrame:
    """Six factor points and the risk score of candidates that carry their caps."""
    norms = {
        "negative_ratio": F.col("negative_ratio_raw"),
        "negative_growth": clip_norm(
            F.col("negative_growth_raw"), F.col("cap_negative_growth")),
        "interaction_growth": clip_norm(
            F.col("interaction_delta"), F.col("cap_interaction_growth")),
        "anger_fear": F.col("anger_fear_ratio_raw"),
        "kol_verified": clip_norm(F.col("kol_verified_raw"), F.col("cap_kol_verified")),
        "source_diversity": F.col("source_diversity_raw"),
    }
    points = {f"points_{k}": F.lit(float(RISK_FACTOR_WEIGHTS[k])) * v for k, v in norms.items()}
    total = sum((F.col(p) for p in list(points)[1:]), F.col(list(points)[0]))
    scored = df.withColumns(points).withColumn("risk_score", round_to(total, 1))
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def source_shares(df: DataFrame) -> DataFrame:
    """Share of each discovery source, 0 when a topic has none."""
    total = sum((F.col(f"source_{t}") for t in SOURCE_TYPES), F.lit(0))
    return df.withColumns({
        f"share_{t}": round_to(ratio(F.col(f"source_{t}"), total)) for t in SOURCE_TYPES})


def topic_candidates_with_factors(tables, window: TimeWindow, q: str = "",
                                  s: Settings = DEFAULTS) -> DataFrame:
    """Candidate topics with every metric and raw factor."""
    return add_raw_factors(candidate_topics(tables, topic_totals(tables, window, s), q, s), s)


def render_topics(scored: DataFrame) -> DataFrame:
    """Public columns of a scored topic."""
    dominant = label_name(F.col("dominant_id"))
    return source_shares(scored.withColumn("dominant_id", dominant_emotion_id())).select(
        F.col("topic_id").cast("string").alias("topic_id"), "title", "lead", "post_count",
        "risk_score", "risk_level", dominant.alias("dominant_emotion"),
        round_to(F.col("negative_ratio_raw")).alias("negative_ratio"),
        round_to(F.col("negative_growth_raw")).alias("negative_growth"),
        growth_label(F.col("negative_growth_raw")).alias("negative_growth_label"),
        round_to(F.col("interaction_growth_ratio")).alias("interaction_growth"),
        growth_label(F.col("interaction_growth_ratio")).alias("interaction_growth_label"),
        "latest_interactions", "sample_count", F.col("post_samples").alias("post_sample_count"),
        F.col("comment_samples").alias("sampled_comment_count"), "kol_entry_count",
        "verified_actor_count", "high_follower_actor_count",
        *[f"share_{t}" for t in SOURCE_TYPES], *EMOTION_COUNTS,
        round_to(mean_micros(F.col("confidence_micros"), F.col("sample_count")))
        .alias("avg_confidence"),
        *[round_to(F.col(f"points_{k}"), 1).alias(f"factor_{k}") for k in RISK_FACTOR_WEIGHTS],
    ).withColumn("note", F.concat(
        F.lit("负面率 "), F.format_string("%.1f", round_to(F.col("negative_ratio") * 100, 1)),
        F.lit("%，主导情绪为"), F.col("dominant_emotion")))


def rank_topics(scored: DataFrame, limit: int) -> DataFrame:
    """Highest risk first; topics without samples are left out."""
    return scored.filter(F.col("sample_count") > 0).orderBy(
        F.desc("risk_score"), F.desc("sample_count"), F.col("topic_id")).limit(limit)


# ------------------------------------------------------------------ one topic
def predicted_links(tables, window: TimeWindow, topic_id: int,
                    s: Settings = DEFAULTS) -> DataFrame:
    """Links of one topic whose post has a prediction in the window."""
    pred = predictions_in(tables.prediction, window, s.primary_model)
    seen = of_topic(pred.select("post_id", "source_id"), tables, topic_id, "source_id")
    return topic_links(tables, topic_id).join(
        seen.select("post_id").distinct(), "post_id", "left_semi")


def topic_base(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS) -> DataFrame:
    """Title, counters and predicted post count; no row when the topic is unknown."""
    posts = predicted_links(tables, window, topic_id, s).agg(
        F.count("*").alias("n")).scalar()
    return tables.topic.filter(F.col("topic_id") == topic_id).groupBy("topic_id").agg(
        F.min("title").alias("title"), F.min("lead").alias("lead"),
        F.max("read_count").alias("read_count"), F.max("discuss_count").alias("discuss_count"),
        local_iso(F.min("first_seen_at")).alias("first_seen_at"),
        local_iso(F.max("last_seen_at")).alias("last_seen_at"),
    ).withColumn("post_count", posts)


def topic_samples(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS) -> DataFrame:
    """Predictions of the posts of one topic and of their comments."""
    pred = predictions_in(tables.prediction, window, s.primary_model)
    return of_topic(pred, tables, topic_id, "source_id")


def emotion_by_day(samples: DataFrame) -> DataFrame:
    """Per local day: six counts, total, negative ratio, weighted confidence."""
    return series_of_days(samples.groupBy(local_day(F.col("source_created_at")).alias("day")).agg(
        *emotion_aggregates()))


def series_of_days(daily: DataFrame) -> DataFrame:
    """The series of daily sums, however they were made."""
    return daily.select(
        F.col("day").cast("string").alias("day"), *EMOTION_COUNTS,
        F.col("sample_count").alias("total"),
        round_to(ratio(F.col("negative_count"), F.col("sample_count"))).alias("negative_ratio"),
        round_to(mean_micros(F.col("confidence_micros"), F.col("sample_count")))
        .alias("avg_confidence"))


def emotion_distribution(samples: DataFrame) -> DataFrame:
    """One row of counts and shares."""
    total = samples.agg(*emotion_aggregates())
    shares = [round_to(ratio(F.col(c), F.col("sample_count"))).alias(f"ratio_{i}")
              for i, c in enumerate(EMOTION_COUNTS)]
    return total.select(
        *EMOTION_COUNTS, *shares, F.col("sample_count").alias("total"),
        "negative_count",
        round_to(ratio(F.col("negative_count"), F.col("sample_count"))).alias("negative_ratio"),
        "anger_fear_count",
        round_to(ratio(F.col("anger_fear_count"), F.col("sample_count")))
        .alias("anger_fear_ratio"))


def engagement_curve(tables, window: TimeWindow, topic_id: int) -> DataFrame:
    """Per local day: newest snapshot of each post on that day, summed."""
    seen = of_topic(window.within(tables.engagement, "captured_at"), tables, topic_id, "captured_at")
    newest = F.max_by(F.struct("comments_count", "attitudes_count", "reposts_count"),
                      F.col("captured_at")).alias("s")
    per_post = seen.groupBy(local_day(F.col("captured_at")).alias("day"), "post_id").agg(newest)
    daily = per_post.select("day", "s.*").groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("comments_count", "attitudes_count", "reposts_count")])
    return daily.withColumn("interaction_count", interactions()).withColumn(
        "day", F.col("day").cast("string"))


def engagement_summary(tables, window: TimeWindow, topic_id: int) -> DataFrame:
    """First and last totals, gain and growth of one topic."""
    seen = post_growth(of_topic(
        window.within(tables.engagement, "captured_at"), tables, topic_id, "captured_at"))
    return seen.agg(
        F.coalesce(F.sum("earliest"), F.lit(0)).alias("earliest_interactions"),
        F.coalesce(F.sum("latest"), F.lit(0)).alias("latest_interactions"),
        F.coalesce(F.sum(F.greatest(F.col("latest") - F.col("earliest"), F.lit(0))), F.lit(0))
        .alias("interaction_delta"),
    ).withColumn("interaction_growth", round_to(ratio(
        F.col("interaction_delta"), F.greatest(F.col("earliest_interactions"), F.lit(1)))))


def topic_sources(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS) -> DataFrame:
    """Counts and shares of the four discovery sources over predicted posts of one topic."""
    posts = predicted_links(tables, window, topic_id, s)
    flags = post_sources(of_topic(tables.discovery, tables, topic_id, "discovered_at").join(
        posts, "post_id", "left_semi"))
    counts = flags.agg(*[F.count_if(F.col(f"from_{t}") == 1).alias(f"source_{t}")
                         for t in SOURCE_TYPES])
    return source_shares(counts)


def topic_actor_signals(tables, window: TimeWindow, topic_id: int,
                        s: Settings = DEFAULTS) -> DataFrame:
    """KOL-entry posts, verified and high-follower authors of one topic."""
    posts = of_topic(window.within(tables.post, "created_at"), tables, topic_id, "user_id")
    found = of_topic(tables.discovery, tables, topic_id, "discovered_at")
    kol = found.filter(F.col("source_type") == "kol").join(
        posts, "post_id", "left_semi").select("post_id").distinct().agg(
        F.count("*").alias("n")).scalar()
    authors = tables.user.join(
        posts.select(F.col("user_id").alias("uid")), "uid", "left_semi")
    high = (F.col("profile_tier") >= 1) & (F.col("followers_count") >= s.high_followers)
    return authors.agg(
        F.count_if("verified").alias("verified_actor_count"),
        F.count_if(high).alias("high_follower_actor_count"),
    ).withColumn("kol_entry_count", kol)


def leading_factor(scored: DataFrame) -> DataFrame:
    """The factor with the most points of each topic (ties: the first in the fixed order)."""
    best = F.array_max(F.array(*[
        F.struct(F.col(f"points_{k}").alias("points"), F.lit(-i).alias("place"),
                 F.lit(k).alias("name"))
        for i, k in enumerate(RISK_FACTOR_WEIGHTS)]))
    return scored.select(
        "topic_id", best["name"].alias("leading_factor"),
        round_to(best["points"], 1).alias("leading_points"))


def emotion_stack(scored: DataFrame) -> DataFrame:
    """Share of each emotion of a topic, zero shares dropped."""
    shares = F.array(*[
        F.struct(label_name(F.lit(i)).alias("emotion"),
                 round_to(ratio(F.col(c), F.col("sample_count"))).alias("share"))
        for i, c in enumerate(EMOTION_COUNTS)])
    return scored.select("topic_id", F.explode(F.filter(shares, lambda x: x["share"] > 0))
                         .alias("s")).select("topic_id", "s.*")


def factor_fill(scored: DataFrame) -> DataFrame:
    """Percentage of the possible points of each factor, at most 100."""
    return scored.select("topic_id", *[
        round_to(F.least(F.col(f"points_{k}") / F.lit(float(w)) * 100, F.lit(100.0)), 2)
        .alias(f"fill_{k}") for k, w in RISK_FACTOR_WEIGHTS.items()])
