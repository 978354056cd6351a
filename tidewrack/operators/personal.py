"""Personal scores, suggestions, recommendations, personas, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.config import DEFAULT, STUDENTS, RankingConfig


def role_match(role: Column, doc_type: Column, config: RankingConfig = DEFAULT) -> Column:
    """Students prefer web pages, teachers files."""
    return F.coalesce((role.isin(*STUDENTS) & doc_type.isin(*config.student_types)) | ((role == "teacher") & doc_type.isin(*config.teacher_types)), F.lit(False))


def interest_match(interests: Column, title: Column, body: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, body))
    return F.coalesce(F.exists(interests, lambda t: F.contains(text, F.lower(t))), F.lit(False))


def personal(interest: Column, role: Column, clicked: Column, config: RankingConfig = DEFAULT) -> Column:
    return F.least(F.lit(1.0), config.interest_share * interest.cast("double") + config.role_share * role.cast("double") + config.click_share * clicked.cast("double"))


def personalised(docs: DataFrame, users: DataFrame, clicks: DataFrame, config: RankingConfig = DEFAULT, most_users: int = 1000) -> DataFrame:
    """user_id, doc_id, pers for each user (a few, named by the caller) and document; users(user_id, role, interests), clicks(user_id, doc_id).

    Texts are read where they lie: only what a user and a document have in common meets the clicks of these users.
    """
    if users.limit(most_users + 1).count() > most_users:
        raise ValueError(f"more than {most_users} users: personal scores are for a few at a time")
    pairs = docs.select("doc_id", "title", "body", "doc_type").join(F.broadcast(users), how="cross")
    pairs = pairs.select("user_id", "doc_id", interest_match(F.col("interests"), F.col("title"), F.col("body")).alias("interest"), role_match(F.col("role"), F.col("doc_type"), config).alias("fits"))
    own = clicks.select("user_id", "doc_id", F.lit(True).alias("clicked")).join(F.broadcast(users.select("user_id")), "user_id", "left_semi").distinct()
    pairs = pairs.join(own, ["user_id", "doc_id"], "left")
    pers = personal(F.col("interest"), F.col("fits"), F.coalesce("clicked", F.lit(False)), config)
    return pairs.select("user_id", "doc_id", pers.alias("pers"))


def suggestions(docs: DataFrame, frequent: DataFrame, prefix: str, n: int) -> DataFrame:
    """text, kind, freq: the n most frequent titles and words that begin with the prefix; frequent(term, freq)."""
    low = prefix.lower()
    titles = docs.where(F.startswith(F.lower("title"), F.lit(low))).groupBy(F.col("title").alias("text")).agg(F.count("*").alias("freq")).select("text", F.lit("title").alias("kind"), "freq")
    words = frequent.where(F.startswith("term", F.lit(low))).select(F.col("term").alias("text"), F.lit("word").alias("kind"), "freq")
    return titles.unionByName(words).orderBy(F.desc("freq"), "text", "kind").limit(n)


def recommendations(docs: DataFrame, postings: DataFrame, doc_id: int, n: int, interests: list[str], role: str, terms: list[str], pr_hat: DataFrame | None = None, config: RankingConfig = DEFAULT) -> DataFrame:
    """doc_id, shared (terms shared with the given document, in any field), score, reasons of the n best other documents.

    The given document's distinct terms are a bounded set of one document's; they meet the postings in a hash join.
    """
    own = postings.where(F.col("doc_id") == doc_id).select("term").distinct()
    related = postings.where(F.col("doc_id") != doc_id).select("doc_id", "term").join(own, "term").groupBy("doc_id").agg(F.countDistinct("term").alias("shared"))
    rows = docs.join(related, "doc_id")
    rows = rows.join(pr_hat.withColumnRenamed("id", "doc_id"), "doc_id", "left") if pr_hat is not None else rows.withColumn("pr_hat", F.lit(0.0))
    text = F.lower(F.concat_ws(" ", "title", "body"))
    contains = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, F.lower(w))) if words else F.lit(False)
    interest, topic, resource = contains(interests), contains(terms), F.col("doc_type").isin(*config.teacher_types)
    authority = F.coalesce("pr_hat", F.lit(0.0))
    score = F.col("shared") / 10.0 + 2.0 * interest.cast("double") + 1.0 * topic.cast("double") + 0.5 * role_match(F.lit(role), F.col("doc_type"), config).cast("double") + authority
    reasons = F.array_compact(F.array(F.when(interest, "interest"), F.when(topic, "same topic"), F.when(resource, "document resource"), F.when(authority > 0.5, "site authority")))
    return rows.select("doc_id", "shared", F.round(score, 6).alias("score"), F.array_join(reasons, ",").alias("reasons")).orderBy(F.desc("score"), "doc_id").limit(n)


def recent(log: DataFrame, n: int, item: str) -> DataFrame:
    """Each user's last n rows of log(user_id, ts, item), newest first in rn."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), item)
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def click_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("user_id", "doc_id").agg(F.count("*").alias("clicks"))


def top_by_persona(scored: DataFrame, n: int) -> DataFrame:
    """The n best documents of each persona of scored(persona, doc_id, score)."""
    w = Window.partitionBy("persona").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
