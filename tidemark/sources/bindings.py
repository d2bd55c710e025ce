"""The canonical tables read from a star-schema parquet folder.

orders -> posts, lineitem -> comments, links, snapshots and discoveries, part -> topics,
customer -> users; predictions are arithmetic on the sample ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedupe import latest_version
from tidemark.session import size_tasks, spread
from tidemark.sources.tables import Tables

COMMENT_TIES = ("l_partkey", "l_suppkey", "like_count", "l_returnflag", "l_linestatus")


def star_tables(spark: SparkSession, root: str) -> Tables:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sized: list[str] = []

    def read(name: str) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}.parquet"
        if name == "lineitem" and not sized:  # the largest facts, and most plans fold them
            size_tasks(spark, path)
            sized.append(path)
        return spark.read.parquet(path)

    def user() -> DataFrame:
        return read("customer").selectExpr(
            "c_custkey + 1 uid", "c_mktsegment = 'BUILDING' verified",
            "c_nationkey % 3 profile_tier",
            "cast(floor(greatest(c_acctbal, 0) * 20) as bigint) followers_count")

    def post() -> DataFrame:
        return read("orders").selectExpr(
            "o_orderkey + 1 post_id", "o_custkey + 1 user_id", "o_orderdate created_at",
            "o_orderdate first_crawled_at",
            "case when o_orderkey % 10 = 9 then o_orderkey - 8 else 0 end retweet_of",
            "concat(o_orderpriority, ' ', o_orderstatus) text_raw")

    def replies() -> DataFrame:
        return read("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"),
            (F.col("l_orderkey") + 1).alias("post_id"),
            F.col("l_quantity").cast("bigint").alias("like_count"),
            F.col("l_shipdate").alias("created_at"),
            "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")

    def with_author(df: DataFrame) -> DataFrame:
        users = read("customer").agg(F.count("*")).scalar()
        return df.withColumn("user_id", F.col("l_partkey") % users + 1)

    def comment_versions() -> DataFrame:
        return with_author(replies()).select(
            "comment_id", "post_id", "user_id", "like_count", "created_at",
            "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")

    def comment() -> DataFrame:
        # authors follow from a column that the rows carry anyway
        newest = with_author(latest_version(
            replies(), ["comment_id"], "created_at", COMMENT_TIES))
        return newest.selectExpr(
            "comment_id", "post_id", "user_id", "like_count", "created_at",
            "concat('reply ', l_returnflag, l_linestatus) text_raw")

    def topic() -> DataFrame:
        return read("part").selectExpr(
            "p_partkey + 1 topic_id", "p_name title", "p_type lead",
            "cast(floor(p_retailprice) as bigint) read_count",
            "cast(p_size as bigint) discuss_count",
            "timestamp_ntz '1992-01-01 00:00:00' + make_dt_interval(p_size) first_seen_at",
            "timestamp_ntz '1998-01-01 00:00:00' + make_dt_interval(p_size) last_seen_at")

    def post_topic() -> DataFrame:
        return read("lineitem").selectExpr(
            "l_orderkey + 1 post_id", "l_partkey + 1 topic_id").distinct()

    def discovery() -> DataFrame:
        return read("lineitem").selectExpr(
            "l_orderkey + 1 post_id",
            """case when l_orderkey % 97 = 0 and l_linenumber % 2 = 0 then 'retweet'
               when l_orderkey % 41 = 0 and l_linenumber % 3 = 0 then 'kol'
               when l_linenumber % 2 = 0 then 'hot' else 'keyword' end source_type""",
            "cast(l_suppkey as string) source_value", "l_shipdate discovered_at")

    def engagement() -> DataFrame:
        return read("lineitem").groupBy(
            (F.col("l_orderkey") + 1).alias("post_id"), F.col("l_shipdate").alias("captured_at")
        ).agg(
            F.max(F.col("l_quantity").cast("bigint")).alias("comments_count"),
            F.max(F.floor(F.col("l_extendedprice") / 100).cast("bigint")).alias("attitudes_count"),
            F.max(F.col("l_linenumber").cast("bigint")).alias("reposts_count"))

    def sample() -> DataFrame:
        posts = tables.post.selectExpr(
            "'post' source_type", "post_id source_id", "post_id", "created_at")
        comments = tables.comment.selectExpr(
            "'comment' source_type", "comment_id source_id", "post_id", "created_at")
        return posts.unionByName(comments)

    def prediction() -> DataFrame:
        hashed = tables.sample.selectExpr(
            "*",
            "(source_id * 7919 + case source_type when 'post' then 17 else 91 end) % 1000 h")
        shared = ["source_type", "source_id", "post_id", "created_at source_created_at"]
        primary = hashed.selectExpr(
            *shared, "'primary' model_version", "h % 6 pred_label_id",
            "(h + 2) % 6 second_label_id", "0.4D + cast(h % 60 as double) / 100 confidence",
            "cast(h % 50 as double) / 100 margin")
        secondary = hashed.selectExpr(
            *shared, "'secondary' model_version",
            "case when h % 5 = 0 then (h + 1) % 6 else h % 6 end pred_label_id",
            "(h + 3) % 6 second_label_id",
            "0.4D + cast((h * 7) % 60 as double) / 100 confidence",
            "cast((h * 3) % 50 as double) / 100 margin")
        return primary.unionByName(secondary)

    def text() -> DataFrame:
        docs, marks = spread(read("documents")), read("labels")
        joined = docs.join(marks.withColumnRenamed("doc_id", "_id"),
                           docs["doc_id"] == F.col("_id"), "left")
        return joined.selectExpr(
            "doc_id id", "text content", "lang", "source",
            """cast(case when _id is null then 5 when toxic = 1 then 1 when quality = 0 then 2
               else doc_id % 6 end as bigint) label_id""",
            """case when doc_id % 10 < 7 then 'train' when doc_id % 10 = 7 then 'eval'
               else 'test' end split""")

    def text_noisy() -> DataFrame:
        return tables.text.selectExpr(
            "id",
            """concat('RT ', content, ' http://ex.am/p', cast(id as string), ' //@user',
               cast(id as string), ': #Topic ', cast(id % 7 as string), '# @Name_',
               cast(id as string), '  [wow]') content""",
            "label_id", "split")

    def annotation_primary() -> DataFrame:
        return tables.text.selectExpr(
            "id", "concat('s-', cast(id as string)) sample_id", "content",
            "label_id primary_label_id",
            "0.5D + cast(id % 50 as double) / 100 primary_confidence",
            "id % 11 = 0 primary_needs_review")

    def annotation_review() -> DataFrame:
        return tables.text.filter("id % 3 <> 0").selectExpr(
            "concat('s-', cast(id as string)) sample_id",
            "case when id % 4 = 0 then (label_id + 1) % 6 else label_id end review_label_id",
            "0.6D + cast(id % 40 as double) / 100 review_confidence",
            "id % 13 = 0 review_needs_review")

    bound = {f.__name__: f for f in (
        user, post, comment_versions, comment, topic, post_topic, discovery, engagement, sample,
        prediction, text, text_noisy, annotation_primary, annotation_review)}
    raw = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    tables = Tables(spark, {**{n: (lambda n=n: read(n)) for n in raw}, **bound})
    return tables
