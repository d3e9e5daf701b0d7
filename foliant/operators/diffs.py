"""Snapshots and manifests: diff with move detection by size and hash, upserts, equality, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.registry import query, table


def snapshot_diff(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Changes between files now (path, size, modified, sha) and the manifest (path, size, modified, sha).

    A known path whose size or time differs is `modified`.  A new path is `moved` if exactly one
    record whose path is gone has its size and hash, `reconcile-required` if several have, else
    `created`; a gone record that no move takes is `deleted`.  If several new paths want one record
    the first by path takes it, and the others are `created`.
    """
    now = current.select("path", "size", "modified", "sha")
    then = recorded.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("sha").alias("old_sha"))
    changed = now.join(then, "path").where((F.col("size") != F.col("old_size")) | ~F.col("modified").eqNullSafe(F.col("old_modified"))).select("path", F.lit(None).cast("string").alias("previous_path"), F.lit("modified").alias("kind"))
    new = now.join(then, "path", "left_anti")
    gone = then.join(now, "path", "left_anti").withColumnRenamed("path", "old_path")
    # Candidates of a new path are counted by hash and size, not listed: copies make no pairs.
    stock = gone.groupBy("old_size", "old_sha").agg(F.count(F.lit(1)).alias("n"), F.min("old_path").alias("previous_path"))
    matched = new.join(stock, (F.col("size") == F.col("old_size")) & (F.col("sha") == F.col("old_sha")), "left")
    turn = F.row_number().over(Window.partitionBy("previous_path").orderBy("path"))
    ranked = matched.where("n = 1").withColumn("turn", turn)
    moved = ranked.where("turn = 1").select("path", "previous_path", F.lit("moved").alias("kind"))
    others = ranked.where("turn > 1").select("path").union(matched.where("n is null").select("path"))
    created = others.select("path", F.lit(None).cast("string").alias("previous_path"), F.lit("created").alias("kind"))
    unclear = matched.where("n > 1").select("path", F.lit(None).cast("string").alias("previous_path"), F.lit("reconcile-required").alias("kind"))
    taken = moved.select(F.col("previous_path").alias("old_path"))
    open_ = matched.where("n > 1").select("old_size", "old_sha").distinct()
    deleted = gone.join(taken, "old_path", "left_anti").join(open_, ["old_size", "old_sha"], "left_anti").select(F.lit(None).cast("string").alias("path"), F.col("old_path").alias("previous_path"), F.lit("deleted").alias("kind"))
    return changed.unionByName(moved).unionByName(created).unionByName(unclear).unionByName(deleted)


def upsert(manifest: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The manifest with its rows replaced by updates of the same key, and new ones added."""
    return manifest.join(updates, key, "left_anti").unionByName(updates)


def same_content(left: DataFrame, right: DataFrame) -> bool:
    """Whether two manifests have the same rows in any order, lists sorted: then nothing is written."""
    order = lambda df: df.select(*[F.array_sort(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    a, b = order(left), order(right)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def mark_missing(manifest: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Records whose source is gone get the state `source_missing`; nothing is removed."""
    found = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return manifest.join(found, key, "left").withColumn("lifecycle_state", F.when(F.col("_seen").isNull(), "source_missing").otherwise(F.col("lifecycle_state"))).drop("_seen")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files now, and a record of them with removals, renames and edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"))
    path = F.concat_ws("/", "lang", F.col("doc_id").cast("string"))
    now = docs.select(path.alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("modified"), "sha")
    old_path = F.when(F.col("source") == "src7", F.concat(F.lit("old/"), path)).otherwise(path)
    edited = F.col("source") == "src5"
    then = docs.where("source <> 'src3'").select(old_path.alias("path"), (F.col("n_chars") + F.when(edited, 1).otherwise(0)).alias("size"), F.lit(0).alias("modified"), F.when(edited, "x").otherwise(F.col("sha")).alias("sha"))
    return now, then.union(docs.where("source = 'src9'").select(F.concat(F.lit("gone/"), path), "n_chars", F.lit(0), F.lit("y")))


SNAPSHOTS_SQL = """docs AS (SELECT lang || '/' || doc_id AS p, source, n_chars, sha256(text) AS h FROM documents),
now AS (SELECT p AS path, n_chars AS size, h AS sha FROM docs),
rec AS (SELECT CASE WHEN source = 'src7' THEN 'old/' || p ELSE p END AS path, n_chars + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS size, CASE WHEN source = 'src5' THEN 'x' ELSE h END AS sha FROM docs WHERE source <> 'src3'
  UNION ALL SELECT 'gone/' || p, n_chars, 'y' FROM docs WHERE source = 'src9'),
fresh AS (SELECT * FROM now WHERE path NOT IN (SELECT path FROM rec)), gone AS (SELECT * FROM rec WHERE path NOT IN (SELECT path FROM now)),
cand AS (SELECT f.path, count(g.path) AS n, min(g.path) AS prev FROM fresh f LEFT JOIN gone g ON f.size = g.size AND f.sha = g.sha GROUP BY f.path),
turns AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY path) AS turn FROM cand WHERE n = 1)"""


@query(f"""WITH {SNAPSHOTS_SQL}
SELECT n.path, NULL::VARCHAR AS previous_path, 'modified' AS kind FROM now n JOIN rec r USING (path) WHERE n.size <> r.size
UNION ALL SELECT path, CASE WHEN turn = 1 THEN prev END, CASE WHEN turn = 1 THEN 'moved' ELSE 'created' END FROM turns
UNION ALL SELECT path, NULL, CASE WHEN n = 0 THEN 'created' ELSE 'reconcile-required' END FROM cand WHERE n <> 1
UNION ALL SELECT NULL, path, 'deleted' FROM gone g WHERE path NOT IN (SELECT prev FROM turns) AND NOT EXISTS (SELECT 1 FROM cand c JOIN fresh f USING (path) WHERE c.n > 1 AND f.size = g.size AND f.sha = g.sha)""")
def snapshot_diff_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(*snapshots(spark, sf_dir))


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, size, sha FROM rec WHERE path NOT IN (SELECT path FROM now) UNION ALL SELECT path, size, sha FROM now")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, then = snapshots(spark, sf_dir)
    return upsert(then, now, "path").select("path", "size", "sha")


@query("SELECT true AS same, false AS same_after_edit")
def manifest_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rewrite would change anything: not for the same rows in another order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"), F.array("source", "lang").alias("tags"))
    turned = rows.withColumn("tags", F.reverse("tags"))
    edited = rows.withColumn("lang", F.lit("xx"))
    return spark.createDataFrame([(same_content(rows, turned), same_content(rows, edited))], "same boolean, same_after_edit boolean")


@query("""WITH c AS (SELECT DISTINCT CASE WHEN c_acctbal > 9950 THEN c_nationkey ELSE c_nationkey + 100 END AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k AS nation, 'added' AS kind FROM s WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT k, 'removed' FROM c WHERE k NOT IN (SELECT k FROM s)""")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a target set has more and less than the current one; the current one's keys follow a column's value."""
    target = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    current = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 9950, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 100).alias("nation"))
    return target.subtract(current).withColumn("kind", F.lit("added")).union(current.subtract(target).withColumn("kind", F.lit("removed")))


@query("""WITH a AS (SELECT s_suppkey AS k, s_name AS v FROM supplier), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' WHEN c_nationkey < 5 THEN (SELECT any_value(s_name) FROM supplier WHERE s_suppkey = c_custkey) ELSE c_name END AS v FROM customer)
SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.v = b.v THEN 'same' ELSE 'drift' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def copy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two trees by path: those only in one, and those whose content differs."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"))
    customers = table(spark, sf_dir, "customer").join(a.select(F.col("k").alias("c_custkey"), F.col("a").alias("same")), "c_custkey", "left")
    b = customers.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "Supplier#").when(F.col("c_nationkey") < 5, F.col("same")).otherwise(F.col("c_name")).alias("b"))
    kind = F.when(~F.col("in_b"), "missing").when(~F.col("in_a"), "extra").when(F.col("a") == F.col("b"), "same").otherwise("drift")
    joined = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "k", "full").na.fill(False, ["in_a", "in_b"])
    return joined.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey NOT IN (SELECT CASE WHEN c_nationkey < 13 THEN c_custkey ELSE -c_custkey END FROM customer) THEN 'source_missing' ELSE o_orderstatus END AS lifecycle_state FROM orders""")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("lifecycle_state"))
    seen = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") < 13, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("key"))
    return mark_missing(manifest, seen, "key").select("id", "lifecycle_state")
