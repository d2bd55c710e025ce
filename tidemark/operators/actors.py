"""Key actors: roles, influence, footprint and ranking (ACT-01..18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import followers_bucket, log_norm, ratio, round_to
from tidemark.operators.joins import hot_keys, join_unique, repeated, salted
from tidemark.operators.quantiles import exact_percentile
from tidemark.operators.ranking import number_within
from tidemark.operators.samples import (
    EMOTION_COUNTS, busy_posts, busy_users, dominant_emotion_id, interactions, latest_interactions, of_topic,
    predictions_in, speakers, topic_links,
)
from tidemark.operators.window import TimeWindow
from tidemark.session import stored
from tidemark.schema import (
    DEFAULTS, NEGATIVE_IDS, ORDINARY_DISPLAY, ROLE_DISPLAY, ROLE_NAMES, Settings,
)

MARKERS = ("is_entry_kol", "is_high_inter", "is_polar", "is_active", "is_verified_kol",
           "is_cross_topic")


def interaction_p95(tables, window: TimeWindow) -> DataFrame:
    """One row: p95 of the newest interactions per post, whole number, at least 1."""
    return newest_p95(latest_interactions(window.within(tables.engagement, "captured_at")))


def newest_p95(newest: DataFrame) -> DataFrame:
    """One row: p95 of ``interaction_count``, whole number, at least 1."""
    counted = newest.groupBy("interaction_count").agg(F.count("*").alias("n"))
    found = exact_percentile(counted, "interaction_count", "n", 0.95, "p95")
    return found.select(F.greatest(F.lit(1), F.floor(F.coalesce("p95", F.lit(0.0))))
                        .cast("bigint").alias("p95"))


def posts_in(tables, window: TimeWindow, topic_id: int | None = None) -> DataFrame:
    """Posts created in the window with their newest interactions."""
    posts = of_topic(window.within(tables.post, "created_at"), tables, topic_id, "user_id")
    newest = latest_interactions(window.within(tables.engagement, "captured_at"))
    return posts.select("post_id", F.col("user_id").alias("uid")).join(newest, "post_id", "left")


def spoken_samples(tables, window: TimeWindow, topic_id: int | None = None,
                   s: Settings = DEFAULTS) -> DataFrame:
    """Each prediction with its speaker and interactions (post snapshot or comment likes)."""
    pred = of_topic(predictions_in(tables.prediction, window, s.primary_model), tables, topic_id,
                    "source_id")
    newest = latest_interactions(window.within(tables.engagement, "captured_at"))
    own = pred.filter(F.col("source_type") == "post").select(
        F.col("source_id").alias("post_id"), "pred_label_id")
    authors = tables.post.select("post_id", F.col("user_id").alias("uid"))
    posts = own.join(authors, "post_id").join(newest, "post_id", "left").select(
        "uid", "pred_label_id", F.lit("post").alias("source_type"),
        F.coalesce("interaction_count", F.lit(0)).alias("interaction_count"))
    replies = pred.filter(F.col("source_type") == "comment").select(
        "post_id", F.col("source_id").alias("comment_id"), "pred_label_id")
    comments = replies.join(
        tables.comment.select("comment_id", "post_id", F.col("user_id").alias("uid"),
                              "like_count"), ["comment_id", "post_id"]).select(
        "uid", "pred_label_id", F.lit("comment").alias("source_type"),
        F.col("like_count").alias("interaction_count"))
    return posts.unionByName(comments)


def _speech_counts() -> list[Column]:
    """Six counts, samples, posts, comments and interactions of one speaker."""
    label, kind = F.col("pred_label_id"), F.col("source_type")
    return [
        *[F.count_if(label == i).alias(c) for i, c in enumerate(EMOTION_COUNTS)],
        F.count(label).alias("sample_count"),
        F.count_if(label.isin(*NEGATIVE_IDS)).alias("negative_count"),
        F.count_if(kind == "post").alias("post_count"),
        F.count_if(kind == "comment").alias("comment_count"),
        F.coalesce(F.sum("interaction_count"), F.lit(0)).alias("interaction_count")]


def fold_actors(samples: DataFrame) -> DataFrame:
    """One row per speaker with their counts."""
    return samples.groupBy("uid").agg(*_speech_counts())


def actor_emotions(samples: DataFrame) -> DataFrame:
    """Speaker x emotion detail."""
    return samples.groupBy("uid", "pred_label_id").agg(
        F.count("*").alias("sample_count"),
        F.count_if(F.col("source_type") == "post").alias("post_count"),
        F.count_if(F.col("source_type") == "comment").alias("comment_count"),
        F.sum("interaction_count").alias("interaction_count"))


# ----------------------------------------------------------------- role branches
def _branch(df: DataFrame, **flags: Column | int) -> DataFrame:
    """uid plus the six markers, 0 where not given."""
    def cell(name: str) -> Column:
        value = flags.get(name, 0)
        return (value if isinstance(value, Column) else F.lit(value)).cast("int").alias(name)
    return df.select("uid", *[cell(m) for m in MARKERS])


def entry_kols(tables, posts: DataFrame) -> DataFrame:
    """Authors of posts that were discovered through a KOL."""
    kol = tables.discovery.filter(F.col("source_type") == "kol").select("post_id").distinct()
    return _branch(posts.join(kol, "post_id", "left_semi"), is_entry_kol=1)


def high_interaction(posts: DataFrame, p95: DataFrame) -> DataFrame:
    """Authors of a post at or above the interaction p95."""
    return _branch(posts.filter(F.col("interaction_count") >= p95.scalar()), is_high_inter=1)


def speech_markers(s: Settings = DEFAULTS) -> dict[str, Column]:
    """Polarised: enough samples and a high negative share; active: many samples."""
    share = F.try_divide("negative_count", "sample_count")
    polar = (F.col("sample_count") >= s.polar_min_samples) & (share >= s.polar_ratio)
    return {"is_polar": polar.cast("int"),
            "is_active": (F.col("sample_count") >= s.active_min_samples).cast("int")}


def polar_and_active(folded: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Role branch of polarised and of active speakers."""
    marks = speech_markers(s)
    return _branch(folded, **marks).filter("is_polar = 1 or is_active = 1")


def identity_kols(tables, window: TimeWindow, topic_id: int | None = None,
                  s: Settings = DEFAULTS) -> DataFrame:
    """Verified or big accounts that spoke in the window."""
    seen = speakers(
        of_topic(window.within(tables.post, "created_at"), tables, topic_id, "user_id"),
        of_topic(window.within(tables.comment, "created_at"), tables, topic_id, "comment_id"))
    known = F.col("verified") | (
        (F.col("profile_tier") >= 1) & (F.col("followers_count") >= s.high_followers))
    return _branch(tables.user.filter(known).join(seen, "uid", "left_semi"), is_verified_kol=1)


def cross_topic(tables, posts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Authors whose own posts touch several topics."""
    pairs = join_unique(tables.post_topic.select("post_id", "topic_id"),
                        posts.select("post_id", "uid"), "post_id", "topic_id", how="inner")
    topics = pairs.select("uid", "topic_id").distinct().groupBy("uid").agg(
        F.count("*").alias("topics"))
    return _branch(topics.filter(F.col("topics") >= s.cross_topic_min), is_cross_topic=1)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def post_facts(tables, window: TimeWindow, topic_id: int | None = None,
               s: Settings = DEFAULTS) -> DataFrame:
    """One row per post: author, newest interactions, own prediction, and flags.

    Posts, their predictions, snapshots and the links of the topic are stacked as narrow rows and
    folded once, so a post with many snapshots is combined in the map tasks.  ``created`` says whether
    the post is of the window and is null for ids without a post; ``as_of`` is null without a snapshot.
    """
    pred = predictions_in(tables.prediction, window, s.primary_model)
    parts = [
        tables.post.select("post_id", F.col("user_id").alias("uid"),
                           window.holds(tables.post, "created_at").alias("created")),
        pred.filter(F.col("source_type") == "post").select(
            F.col("source_id").alias("post_id"), "pred_label_id",
            F.lit(True).alias("predicted")),
        window.within(tables.engagement, "captured_at").select(
            "post_id", "captured_at", interactions().alias("total"))]
    if topic_id is not None:
        parts.append(topic_links(tables, topic_id).select("post_id", F.lit(True).alias("of_topic")))
    linked = F.lit(True) if topic_id is None else F.coalesce(F.max("of_topic"), F.lit(False))
    return _stacked(parts).groupBy("post_id").agg(
        F.max("uid").alias("uid"), F.max("created").alias("created"),
        F.max_by("total", "captured_at").alias("interaction_count"),
        F.max("captured_at").alias("as_of"), F.max("pred_label_id").alias("pred_label_id"),
        F.coalesce(F.max("predicted"), F.lit(False)).alias("predicted"),
        linked.alias("of_topic"))


def comment_facts(tables, window: TimeWindow, topic_id: int | None = None,
                  s: Settings = DEFAULTS) -> DataFrame:
    """One row per comment that is of the window or has a prediction in it."""
    pred = predictions_in(tables.prediction, window, s.primary_model)
    parts = [
        tables.comment.select("comment_id", "post_id", F.col("user_id").alias("uid"), "like_count",
                              window.holds(tables.comment, "created_at").alias("created")),
        pred.filter((F.col("source_type") == "comment") & F.col("post_id").isNotNull()).select(
            F.col("source_id").alias("comment_id"), "post_id", "pred_label_id",
            F.lit(True).alias("predicted"))]
    return of_topic(_stacked(parts), tables, topic_id, "comment_id").groupBy("comment_id", "post_id").agg(
        F.max("uid").alias("uid"), F.max("created").alias("created"),
        F.max("like_count").alias("interaction_count"),
        F.max("pred_label_id").alias("pred_label_id"),
        F.coalesce(F.max("predicted"), F.lit(False)).alias("predicted"),
    ).filter(F.col("created") | (F.col("created").isNotNull() & F.col("predicted")))


def _said(facts: DataFrame, kind: str, gained: Column) -> DataFrame:
    """Samples of the facts, and a bare ``spoke`` for what has no prediction."""
    return facts.select(
        "uid", "pred_label_id", F.when(F.col("predicted"), F.lit(kind)).alias("source_type"),
        F.when(F.col("predicted"), gained).alias("interaction_count"),
        F.col("created").alias("spoke"))


def actor_candidates(tables, window: TimeWindow, topic_id: int | None = None,
                     s: Settings = DEFAULTS, walked: bool = False) -> DataFrame:
    """Accounts with any role marker and their counts.

    The facts of the posts are written once; the percentile and the role branches read them.
    Samples, branches and notable accounts are stacked and folded per account once, instead of joining
    the candidates back to the samples.  With ``walked`` the footprint over all topics is folded in
    (``topic_count``, ``top_topic_id``), and its pass over the links tells cross-topic accounts too.
    """
    with tables.keeping("comment"):  # predictions, comment facts and the footprint read them
        return _candidates(tables, window, topic_id, s, walked)


def _candidates(tables, window: TimeWindow, topic_id: int | None, s: Settings, walked: bool) -> DataFrame:
    facts = stored(post_facts(tables, window, topic_id, s), "posts")
    own = facts.filter(F.col("created").isNotNull() & F.col("of_topic"))
    posts = own.filter("created").select("post_id", "uid", "interaction_count")
    known = F.col("verified") | (
        (F.col("profile_tier") >= 1) & (F.col("followers_count") >= s.high_followers))
    parts = [
        _said(own.filter(F.col("created") | F.col("predicted")), "post",
              F.coalesce("interaction_count", F.lit(0))),
        _said(comment_facts(tables, window, topic_id, s), "comment", F.col("interaction_count")),
        tables.user.filter(known).select("uid", F.lit(True).alias("notable")),
        entry_kols(tables, posts),
        high_interaction(posts, newest_p95(facts.filter(F.col("as_of").isNotNull()))),
    ]
    if walked:
        # its shuffles are the largest, so they end before those of the other parts begin
        parts.append(stored(walked_topics(tables, window, posts, s), "walked"))
    elif topic_id is None:
        parts.append(cross_topic(tables, posts, s))
    footprint = [F.max(c).alias(c) for c in FOOTPRINT] if walked else []
    marks = {m: F.coalesce(F.max(m), F.lit(0)) for m in MARKERS}
    marks["is_verified_kol"] = F.coalesce(F.max("notable") & F.max("spoke"), F.lit(False)).cast("int")
    merged = _stacked(parts).filter(F.col("uid") > 0).groupBy("uid").agg(
        *_speech_counts(), *[v.alias(m) for m, v in marks.items()], *footprint)
    marked = merged.withColumns({
        m: F.coalesce(v, F.lit(0)) for m, v in speech_markers(s).items()})
    found = F.greatest(*[F.col(m) for m in MARKERS]) == 1
    return marked.filter(found)


def role_markers(tables, window: TimeWindow, topic_id: int | None = None,
                 s: Settings = DEFAULTS) -> DataFrame:
    """Candidates with their markers."""
    return actor_candidates(tables, window, topic_id, s).select("uid", *MARKERS)


# --------------------------------------------------------------------- footprint
FOOTPRINT = ("topic_count", "top_topic_id")


def _per_account(said: DataFrame, tables, topic_id: int | None = None) -> DataFrame:
    """Per account: known topics, the one with most of their posts, and topics of their own posts.

    ``said`` holds (uid, post_id) with ``said`` and ``own`` or null, in any number of rows.  Accounts and posts
    meet the links after one move by post, and the topics of an account are counted after one move by account;
    busy posts and accounts are dealt to several tasks.  The topic table meets the links before that, since
    the rows per account and topic are many times the links.
    """
    posts = stored(hot_keys(busy_posts(tables), "post_id"), "hot")
    users = stored(hot_keys(busy_users(tables), "user_id").withColumnRenamed("user_id", "uid"), "hot")
    known = tables.topic.groupBy("topic_id").agg(F.count("*").alias("copies"))
    links = tables.post_topic.select("post_id", "topic_id")
    if topic_id is not None:
        links = links.filter(F.col("topic_id") == topic_id)
    pairs = salted(said, posts, "post_id", "uid").repartition("post_id", "_salt").groupBy(
        "uid", "post_id", "_salt").agg(F.max("said").alias("said"), F.max("own").alias("own"))
    touched = pairs.join(repeated(links.join(known, "topic_id", "left"), posts, "post_id"),
                         ["post_id", "_salt"]).select("uid", "topic_id", "said", "own", "copies")
    per_topic = salted(touched, users, "uid", "topic_id").repartition("uid", "_salt").groupBy(
        "uid", "_salt", "topic_id").agg(F.count("said").alias("posts"), F.count("own").alias("own"),
                                        F.max("copies").alias("copies"))
    counted = (F.col("posts") > 0) & F.col("copies").isNotNull()
    place = F.struct(F.col("posts"), (-F.col("topic_id")).alias("k"))
    shares = per_topic.groupBy("uid", "_salt").agg(
        F.sum(F.when(counted, F.col("copies"))).alias("topic_count"),
        F.max(F.when(counted, place)).alias("place"), F.count_if(F.col("own") > 0).alias("own_topics"))
    return shares.groupBy("uid").agg(
        F.sum("topic_count").alias("topic_count"), (-F.max("place")["k"]).alias("top_topic_id"),
        F.sum("own_topics").alias("own_topics"))


def _spoke(df: DataFrame, window: TimeWindow) -> DataFrame:
    """(uid, post_id) of the posts or comments of the window."""
    return window.within(df, "created_at").select(
        F.col("user_id").alias("uid"), "post_id", F.lit(1).alias("said"))


def walked_topics(tables, window: TimeWindow, posts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Footprint of every account and whether its own ``posts`` touch several topics."""
    stacked = _stacked([_spoke(tables.post, window), _spoke(tables.comment, window),
                        posts.select("uid", "post_id", F.lit(1).alias("own"))])
    return _per_account(stacked.filter(F.col("uid") > 0), tables).select("uid", *FOOTPRINT, (
        F.col("own_topics") >= s.cross_topic_min).cast("int").alias("is_cross_topic"))


def _titles(tables) -> DataFrame:
    return tables.topic.groupBy(F.col("topic_id").alias("top_topic_id")).agg(
        F.max("title").alias("top_topic_title"))


def topic_footprint(tables, window: TimeWindow, actors: DataFrame,
                    topic_id: int | None = None) -> DataFrame:
    """Per listed actor: number of topics and the topic with most of their posts.

    Only the (actor, post) pairs of the listed actors meet the links.
    """
    few = actors.select("uid")
    said = [_spoke(of_topic(df, tables, topic_id, "user_id"), window).join(few, "uid", "left_semi")
            for df in (tables.post, tables.comment)]
    pairs = _stacked(said).withColumn("own", F.lit(None).cast("int"))
    found = _per_account(pairs, tables, topic_id).filter("topic_count > 0")
    return found.drop("own_topics").join(_titles(tables), "top_topic_id", "left").select(
        "uid", *FOOTPRINT, "top_topic_title")


# --------------------------------------------------------------- scores and roles
def add_influence(actors: DataFrame) -> DataFrame:
    """Influence score and interaction contribution, relative to all listed actors."""
    trusted = F.col("profile_tier") >= 1
    whole = actors.agg(F.struct(
        F.max("interaction_count").alias("interactions"),
        F.max("followers_count").alias("followers"),
        F.sum("interaction_count").alias("total")).alias("w")).scalar()
    score = (
        F.lit(60.0) * log_norm(F.col("interaction_count"), whole["interactions"])
        + F.when(trusted, F.lit(25.0) * log_norm(
            F.col("followers_count"), whole["followers"])).otherwise(F.lit(0.0))
        + F.when(F.col("verified"), F.lit(10.0)).otherwise(F.lit(0.0))
        + F.when(trusted, F.lit(5.0)).otherwise(F.lit(0.0)))
    return actors.withColumns({
        "actor_influence_score": round_to(F.least(score, F.lit(100.0)), 1),
        "interaction_contribution": round_to(ratio(
            F.col("interaction_count"), whole["total"])),
    })


def add_roles(actors: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Role list in fixed order; ordinary_actor when none applies."""
    share = ratio(F.col("negative_count"), F.col("sample_count"))
    high = (F.col("profile_tier") >= 1) & (F.col("followers_count") >= s.high_followers)
    tests = {
        "entry_kol": F.col("is_entry_kol") == 1,
        "verified_actor": F.col("verified"),
        "high_follower_actor": ~F.col("verified") & high,
        "high_interaction": F.col("is_high_inter") == 1,
        "negative_polarized": (F.col("is_polar") == 1) | (
            (F.col("sample_count") >= s.polar_min_samples) & (share >= s.polar_ratio)),
        "active_voice": (F.col("is_active") == 1) | (
            F.col("sample_count") >= s.active_min_samples),
        "cross_topic": (F.col("is_cross_topic") == 1) | (
            F.col("topic_count") >= s.cross_topic_min),
    }
    found = F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in ROLE_NAMES]))
    return actors.withColumn("role_count", F.size(found)).withColumn(
        "roles", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ordinary_actor"))))


def display_prefix() -> Column:
    out = F.lit(ORDINARY_DISPLAY)
    for role, name in reversed(ROLE_DISPLAY):
        out = F.when(F.array_contains("roles", role), name).otherwise(out)
    return out


def actor_pseudonym(uid: Column) -> Column:
    return F.concat(F.lit("u_"), F.substring(F.sha2(uid.cast("string"), 256), 1, 10))


RANK_ORDER = ("role_count", "actor_influence_score", "sample_count")


def add_display_names(actors: DataFrame) -> DataFrame:
    """Prefix of the strongest role and A..Z, then numbers, in rank order per prefix."""
    order = [*[F.desc(c) for c in RANK_ORDER], F.asc("uid")]
    placed = number_within(
        actors.withColumn("_prefix", display_prefix()), ["_prefix"], order, "_n")
    n = F.col("_n")
    suffix = F.when(n <= 26, F.char((n + F.lit(64)).cast("int"))).otherwise(n.cast("string"))
    return placed.withColumn(
        "display_name", F.concat_ws(" ", "_prefix", suffix)).drop("_prefix", "_n")


def actor_profiles(tables, window: TimeWindow, topic_id: int | None = None,
                   s: Settings = DEFAULTS) -> DataFrame:
    """Every candidate with samples: counts, profile, footprint, influence and roles.

    Candidates and their profiles are written once: the maxima over all actors and the ranking read
    them.  Over all topics the footprint comes with the candidates, without a join back.
    """
    with tables.keeping("comment"):
        found = stored(actor_candidates(tables, window, topic_id, s, walked=topic_id is None), "actors")
        profiles = tables.user.select("uid", "verified", "profile_tier", "followers_count")
        counted = found.filter(F.col("sample_count") > 0).join(profiles, "uid", "left")
        if topic_id is None:
            counted = counted.join(_titles(tables), "top_topic_id", "left")
        else:
            counted = counted.join(topic_footprint(tables, window, found, topic_id), "uid", "left")
    joined = counted.withColumns({
        "verified": F.coalesce("verified", F.lit(False)),
        "profile_tier": F.coalesce("profile_tier", F.lit(0)),
        "followers_count": F.coalesce("followers_count", F.lit(0)),
        "topic_count": F.coalesce("topic_count", F.lit(0)),
    })
    return add_roles(add_influence(stored(joined, "profiles")), s)


def render_actors(actors: DataFrame) -> DataFrame:
    """Public columns of ranked actors."""
    return actors.select(
        actor_pseudonym(F.col("uid")).alias("actor_id"), "display_name", "verified",
        "profile_tier",
        followers_bucket(F.col("followers_count"), F.col("profile_tier"))
        .alias("followers_bucket"),
        "topic_count", F.col("top_topic_id").cast("string").alias("top_topic_id"),
        "top_topic_title", "post_count", "comment_count", "sample_count",
        label_name(dominant_emotion_id()).alias("dominant_emotion"),
        round_to(ratio(F.col("negative_count"), F.col("sample_count"))).alias("negative_ratio"),
        "interaction_count", "interaction_contribution", "actor_influence_score",
        F.array_join("roles", ",").alias("roles"), "role_count", *EMOTION_COUNTS)


def rank_actors(actors: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` actors with their names; a name depends only on better ranked ones."""
    first = actors.orderBy(*[F.desc(c) for c in RANK_ORDER], F.asc("uid")).limit(limit)
    return add_display_names(first)


def influence_points(ranked: DataFrame) -> DataFrame:
    """x influence, y negative ratio, size interactions, colour emotion."""
    return render_actors(ranked).select(
        "actor_id", "display_name", F.col("actor_influence_score").alias("influence_score"),
        "negative_ratio", "interaction_count", "dominant_emotion",
        F.col("top_topic_id").alias("topic_id"))


def role_counts(actors: DataFrame) -> DataFrame:
    return actors.select(F.explode("roles").alias("role")).groupBy("role").agg(
        F.count("*").alias("actors"))


def with_any_role(actors: DataFrame, roles: list[str]) -> DataFrame:
    return actors.filter(F.arrays_overlap("roles", F.array(*[F.lit(r) for r in roles])))
