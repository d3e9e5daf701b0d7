"""Counts and summaries: group counts with fallback labels, zero-filled vocabularies, roll-ups, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.registry import query, table


def label(value: Column) -> Column:
    """A counter's key: null and empty are `unknown`."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """All single-column counters in one pass: name, value, n (grouping sets)."""
    kinds = F.array(*[F.struct(F.lit(c).alias("name"), label(F.col(c)).alias("value")) for c in columns])
    return df.select(F.inline(kinds)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(counts: DataFrame, vocabulary: list[str], key: str, n: str = "n") -> DataFrame:
    """Counts for every word of a vocabulary."""
    words = counts.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{key} string")
    return words.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))


def side_by_side(*single_rows: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    first, *rest = [df.withColumn("_one", F.lit(1)) for df in single_rows]
    for df in rest:
        first = first.join(df, "_one")
    return first.drop("_one")


def list_items(values: Column, blanks: bool = False) -> Column:
    """Entries of a list, blank ones only if `blanks`."""
    return F.size(values if blanks else F.filter(values, lambda x: F.trim(x) != "")).cast("long")


@query("""SELECT 'lang' AS name, coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown'), count(*) FROM documents GROUP BY 2""")
def domain_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(table(spark, sf_dir, "documents"), "lang", "source")


@query("""SELECT v.lang, coalesce(n, 0) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it'), ('zz')) v(lang) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang)""")
def zero_filled_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, ["de", "en", "es", "fr", "it", "zz"], "lang")


@query("SELECT lang, count(*) AS n_records, sum(n_chars) AS total_chars, max(n_chars) AS max_chars, count(*) FILTER (n_chars > 5000) AS n_large, count(*) FILTER (text = '') AS n_empty FROM documents GROUP BY lang")
def extension_sizes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.count_if(F.col("n_chars") > 5000)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_chars").alias("total_chars"), F.max("n_chars").alias("max_chars"), large.alias("n_large"), F.count_if(F.col("text") == "").alias("n_empty"))


@query("""WITH c AS (SELECT lang AS domain, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (l.quality = 1) AS n_good, count(*) FILTER (l.toxic = 1) AS n_toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT v.domain, coalesce(n_docs, 0) AS n_docs, coalesce(n_labelled, 0) AS n_labelled, coalesce(n_good, 0) AS n_good, coalesce(n_toxic, 0) AS n_toxic FROM (VALUES ('de'), ('en'), ('es'), ('it')) v(domain) LEFT JOIN c USING (domain)
UNION ALL SELECT 'unclassified', sum(n_docs), sum(n_labelled), sum(n_good), sum(n_toxic) FROM c WHERE domain NOT IN ('de', 'en', 'es', 'it') HAVING sum(n_docs) > 0""")
def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four counts for each declared domain, and an `unclassified` row only if it is needed."""
    declared = ["de", "en", "es", "it"]
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    domain = F.when(F.col("lang").isin(declared), F.col("lang")).otherwise("unclassified")
    counts = joined.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n_docs"), F.count("known").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"))
    words = spark.createDataFrame([(d,) for d in declared], "domain string")
    return words.join(counts, "domain", "full").na.fill(0)


@query("""SELECT count(*) AS n_reviews, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, round(avg(quality), 2) AS mean_quality, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing FROM labels""")
def label_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    missing = table(spark, sf_dir, "documents").join(labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    own = labels.agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.round(F.avg("quality"), 2).alias("mean_quality"))
    return side_by_side(own, missing)


@query("""WITH seen AS (SELECT DISTINCT conv_id, role FROM conversations) SELECT c.conv_id, v.role FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES ('assistant'), ('system'), ('tool'), ('user')) v(role)
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.conv_id = c.conv_id AND s.role = v.role)""")
def mode_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected pairs of task and mode that have no result: the modes each task has, taken from the fixed vocabulary."""
    modes = F.array(*map(F.lit, ["assistant", "system", "tool", "user"]))
    seen = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("seen"))
    return seen.select("conv_id", F.explode(F.array_except(modes, "seen")).alias("role"))


@query("""SELECT v.role AS role, count(c.conv_id) AS n_turns, count(DISTINCT c.conv_id) AS n_convs, round(avg(length(c.text)), 2) AS mean_chars, count(*) FILTER (length(c.text) > 300) AS n_long
FROM (VALUES ('assistant'), ('system'), ('tool'), ('user')) v(role) LEFT JOIN conversations c ON c.role = v.role GROUP BY 1""")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = spark.createDataFrame([(r,) for r in ["assistant", "system", "tool", "user"]], "role string")
    turns = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.count_distinct("conv_id").alias("n_convs"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), F.count_if(F.length("text") > 300).alias("n_long"))
    return modes.join(turns, "role", "left").na.fill(0, ["n_turns", "n_convs", "n_long"])


@query("""SELECT 'event_type' AS name, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'sign', CASE WHEN value >= 50 THEN 'high' ELSE 'low' END, count(*) FROM events GROUP BY 2""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("sign"))
    return group_counts(events, "event_type", "sign")


@query("""SELECT v.event_type, coalesce(n, 0) AS n, coalesce(last_sequence, 0) AS last_sequence FROM (VALUES ('click'), ('error'), ('purchase'), ('queued'), ('signup'), ('view')) v(event_type)
LEFT JOIN (SELECT event_type, count(*) AS n, max(event_id) AS last_sequence FROM events GROUP BY 1) USING (event_type)""")
def journal_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_sequence"))
    words = spark.createDataFrame([(w,) for w in ["click", "error", "purchase", "queued", "signup", "view"]], "event_type string")
    return words.join(counts, "event_type", "left").na.fill(0)


@query("""WITH t AS (SELECT lang, sum(n_chars) AS chars FROM documents GROUP BY 1) SELECT lang, chars, round(100.0::DOUBLE * chars / sum(chars) OVER (), 1) AS share FROM t ORDER BY chars DESC, lang LIMIT 5""")
def language_share_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"))
    total = F.sum("chars").over(Window.partitionBy(F.lit(1)))  # over a row for each language
    return counts.select("lang", "chars", F.round(F.lit(100.0) * F.col("chars") / total, 1).alias("share")).orderBy(F.desc("chars"), "lang").limit(5)


@query("SELECT lang, source, count(*) AS n_files, sum(n_chars) AS n_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def workspace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sets = docs.groupingSets([["lang"], ["source"], []], "lang", "source")
    return sets.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("n_chars"))


@query("""WITH m AS (SELECT o_orderstatus AS contract, o_orderpriority AS version, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM m""")
def lifecycle_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("contract"), F.col("o_orderpriority").alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_negative, sum(length(trim(c_name))) AS name_chars FROM customer GROUP BY 1")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.sum(F.length(F.trim("c_name"))).alias("name_chars"))
