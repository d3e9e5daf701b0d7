"""Window-shaped operators: keep last, keep first, coalescing, running caps, samples, settle detection, first-in-first-out claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.registry import query, table


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an aggregate, not a window, so a hot key is combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("row")).select("row.*")


def coalesced(changes: DataFrame, keys: list[str], order: Column, payload: list[str]) -> DataFrame:
    """One row for each key: the place of its first arrival and the payload of its last."""
    numbered = changes.withColumn("_n", order)
    kept = F.max_by(F.struct(*payload), F.col("_n")).alias("p")
    return numbered.groupBy(*keys).agg(F.min("_n").alias("first_seen"), kept, F.count(F.lit(1)).alias("n_changes")).select(*keys, "first_seen", "n_changes", "p.*")


def running_cap(df: DataFrame, group: list[str], order: list[Column], size: Column, cap: int) -> DataFrame:
    """Rows of each group as long as their sizes fit under the cap; the first that does not is marked, later ones go.  For groups of a bounded size."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = df.withColumn("running", F.sum(size).over(upto)).withColumn("_over", F.coalesce(F.sum(size).over(before), F.lit(0)) <= cap)
    return total.where("_over").drop("_over").withColumn("cut", F.col("running") > cap)


def running_cap_by_ranges(df: DataFrame, group: list[str], order: str, size: str, cap: int, width: int) -> DataFrame:
    """The same for groups of any size in the order of a long column: sums of ranges of `width` values come first, and only ranges that begin under the cap are looked into."""
    split = df.withColumn("_range", F.floor(F.col(order) / width))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = split.groupBy(*group, "_range").agg(F.sum(size).alias("_sum"))
    begins = sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")).where(F.col("_before") <= cap)
    within = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = split.join(begins, [*group, "_range"]).withColumn("running", F.col("_before") + F.sum(size).over(within))
    return rows.where(F.col("running") - F.col(size) <= cap).drop("_range", "_before").withColumn("cut", F.col("running") > cap)


def following(df: DataFrame, key: str, order: list[str], at: Column, width: int) -> DataFrame:
    """Adds `next_at`, the time of the key's next row: windows within ranges of time, and for a range's last row the least time of the key's next range; a hot key is spread over its ranges."""
    split = df.withColumn("_at", at).withColumn("_range", F.floor(F.col("_at") / width))
    later = Window.partitionBy(key).orderBy("_range")
    starts = split.groupBy(key, "_range").agg(F.min("_at").alias("_start")).select(key, "_range", F.lead("_start").over(later).alias("_then"))
    own = F.lead("_at").over(Window.partitionBy(key, "_range").orderBy(*order))
    return split.withColumn("_own", own).join(starts, [key, "_range"]).withColumn("next_at", F.coalesce("_own", "_then")).drop("_range", "_own", "_then")


def heads(df: DataFrame, group: str, order: str, most: int, salts: int = 64) -> DataFrame:
    """The first `most` rows of each group: of each salt first, then of those; a hot group is never in one task."""
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    some = spread.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order))).where(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= most).drop("_r", "_salt")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, min(event_id) AS first_seen, count(*) AS n_changes, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def event_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesced(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("event_id"), ["value"])


@query("SELECT event_id, user_id, 'processing' AS status FROM events WHERE event_type IN ('click', 'view') ORDER BY event_id LIMIT 50")
def fifo_claim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).orderBy("event_id").limit(50).select("event_id", "user_id", F.lit("processing").alias("status"))


@query("""WITH n AS (SELECT user_id, epoch_us(ts) AS us, event_id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us FROM events)
SELECT user_id, event_id, next_us IS NULL OR next_us - us >= 7200000000 AS settled FROM n""")
def settle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change has settled if none follows for its key within two hours."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = following(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], us, 6 * 3_600_000_000)
    return events.select("user_id", "event_id", F.coalesce(F.col("next_at") - F.col("_at") >= 7_200_000_000, F.lit(True)).alias("settled"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id) AS running FROM documents)
SELECT doc_id, source, running::BIGINT AS running, running > 300000 AS cut FROM r WHERE running - n_chars <= 300000""")
def running_doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return running_cap_by_ranges(docs, ["source", "lang"], "doc_id", "n_chars", 300_000, 4096).select("doc_id", "source", "running", "cut")


PRIORITY_SQL = "CASE WHEN n_chars = 0 OR n_chars > 20000 THEN 'high' WHEN lang IN ('de', 'fr') OR n_chars > 5000 THEN 'medium' ELSE 'low' END"


@query(f"""WITH p AS (SELECT doc_id, lang, {PRIORITY_SQL} AS priority FROM documents) SELECT doc_id, lang FROM p WHERE priority = 'low' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3""")
def low_risk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three low-priority rows of each format."""
    low = table(spark, sf_dir, "documents").where((F.col("n_chars") > 0) & ~F.col("lang").isin("de", "fr") & (F.col("n_chars") <= 5000))
    return heads(low.select("doc_id", "lang"), "lang", "doc_id", 3).select("doc_id", "lang")


@query("""WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM e GROUP BY 1""")
def first_seen_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("""SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer ORDER BY (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END), nation, segment LIMIT 15""")
def manifest_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()
    return pairs.orderBy(F.when(F.col("segment") == "BUILDING", 0).otherwise(1), "nation", "segment").limit(15)


@query("SELECT page_id, len(string_split(url, '/')) AS depth FROM pages ORDER BY depth, lower(url), page_id LIMIT 40")
def curated_path_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.size(F.split("url", "/")).cast("long").alias("depth"))
    return pages.orderBy("depth", F.lower("url"), "page_id").limit(40).select("page_id", "depth")
