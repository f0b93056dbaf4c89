"""Logical tables that the registered queries read, made from the given tables; each in Spark and in SQL.

SQL_TABLES holds the same definitions as text; with_sql(names, body) puts them in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import engagement as en

NOW_DAY = "2024-01-30"
NOW_MS = 1_706_659_199_000  # 2024-01-30T23:59:59Z
#: Interests that the platform knows; a parameter of the jobs.
INTERESTS = ["Classics", "Design", "Drifting", "Endurance", "Hot Hatch", "Off Road", "Rally", "Restoration", "Road Trips", "Tuning"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engagement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    five, kind = F.col("event_id") % 5 == 0, F.col("event_type")
    event = (
        F.when(kind == "view", "impression").when((kind == "click") & five, "outbound").when(kind == "click", "story_open")
        .when((kind == "purchase") & five, "share").when(kind == "purchase", "save")
        .when((kind == "signup") & (F.col("event_id") % 7 == 0), "experience_feedback").when(kind == "signup", "interested").otherwise("less_like_this")
    )
    rows = e.withColumn("event", event).withColumn("at", F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("event_id").alias("id"), "event",
        F.when(F.col("event") != "experience_feedback", F.get_json_object("props", "$.k").cast("long") + 1).alias("article_id"),
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor_key"),
        F.concat(F.lit("cohort"), (F.col("user_id") % 6).cast("string")).alias("cohort"),
        F.unix_millis("at").alias("created_at"),
        F.when(F.col("event_id") % 4 != 0, F.date_format("at", "yyyy-MM-dd")).alias("day_utc"),
        F.element_at(F.array(F.lit("home"), F.lit("category"), F.lit("editorial_api")), (F.col("event_id") % 3 + 1).cast("int")).alias("surface"),
        F.when(F.col("event") == "experience_feedback", F.when(F.col("event_id") % 2 == 0, "good:pace").when(F.col("event_id") % 3 == 0, "okay:").otherwise("love_it:layout")).alias("detail"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document; the title is its first line, the excerpt its whole text."""
    d = read(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("publication"), first.alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/story-"), (F.col("doc_id") % 700).cast("string"), F.when(F.col("doc_id") % 5 == 0, "?utm_source=feed").otherwise("")).alias("url"),
        F.col("text").alias("excerpt"), (F.lit(1_704_067_200_000) + F.col("doc_id") * 3_600_000).alias("published_at"), "lang", "n_chars",
    )


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, dim_kind, dim_value), from part."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    known = F.array(*[F.lit(x) for x in INTERESTS])
    interest = lambda n: F.element_at(known, (k * n % len(INTERESTS) + 1).cast("int"))
    return en.article_dims(
        p.select(k.alias("id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("publication")), p.select(k.alias("article_id"), F.explode(F.array(interest(3), interest(7))).alias("interest")),
        p.select(k.alias("article_id"), F.lit("make").alias("kind"), F.col("p_brand").alias("make"), F.col("p_brand").alias("name")), p.select(k.alias("article_id"), F.col("p_type").alias("primary_slug")), INTERESTS,
    )


_KNOWN = ", ".join(f"'{x}'" for x in INTERESTS)
SQL_TABLES = {
    "ev": """SELECT event_id AS id, event, CASE WHEN event <> 'experience_feedback' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS article_id,
        'v' || user_id AS visitor_key, 'cohort' || (user_id % 6) AS cohort, epoch_us(ts) // 1000 AS created_at,
        CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day_utc, strftime(ts, '%Y-%m-%d') AS own_day,
        CASE event_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'category' ELSE 'editorial_api' END AS surface,
        CASE WHEN event = 'experience_feedback' THEN CASE WHEN event_id % 2 = 0 THEN 'good:pace' WHEN event_id % 3 = 0 THEN 'okay:' ELSE 'love_it:layout' END END AS detail
        FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'impression' WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'outbound' WHEN event_type = 'click' THEN 'story_open'
            WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'share' WHEN event_type = 'purchase' THEN 'save'
            WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'experience_feedback' WHEN event_type = 'signup' THEN 'interested' ELSE 'less_like_this' END AS event FROM events)""",
    "touches": """SELECT DISTINCT coalesce(day_utc, own_day) AS day, article_id, visitor_key, event FROM ev
        WHERE event IN ('impression', 'story_open', 'outbound', 'save', 'share', 'interested', 'less_like_this') AND article_id IS NOT NULL""",
    "firsts": """SELECT visitor_key, min(coalesce(day_utc, own_day)) AS first_day FROM ev WHERE event = 'impression' AND article_id IS NOT NULL GROUP BY 1""",
    "dims": f"""SELECT DISTINCT article_id, dim_kind, dim_value FROM (
        SELECT p_partkey AS article_id, 'interest' AS dim_kind, ([{_KNOWN}])[CAST(p_partkey * 3 % {len(INTERESTS)} + 1 AS INTEGER)] AS dim_value FROM part
        UNION ALL SELECT p_partkey, 'interest', ([{_KNOWN}])[CAST(p_partkey * 7 % {len(INTERESTS)} + 1 AS INTEGER)] FROM part
        UNION ALL SELECT p_partkey, 'marque', p_brand FROM part
        UNION ALL SELECT p_partkey, 'category', p_type FROM part
        UNION ALL SELECT p_partkey, 'publisher', 'src' || (p_partkey % 20) FROM part)""",
    "articles": """SELECT doc_id AS id, source AS publication, string_split(text, chr(10))[1] AS title,
        'https://' || source || '.example.com/' || lang || '/story-' || (doc_id % 700) || CASE WHEN doc_id % 5 = 0 THEN '?utm_source=feed' ELSE '' END AS url,
        text AS excerpt, 1704067200000 + doc_id * 3600000 AS published_at, lang, n_chars FROM documents""",
}
_NEEDS = {"touches": ["ev"], "firsts": ["ev"]}


def with_sql(names: list[str], body: str) -> str:
    wanted: list[str] = []
    for name in names:
        for x in [*_NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    head = ", ".join(f"{n} AS ({SQL_TABLES[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
