"""Screens over text: secrets, payment cards, identities, duplicates, risk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.functions.text import SECRET_PATTERNS, capped, card_numbers, identity, secret_labels, slug
from foliant.registry import query, table
from foliant.shared import spread

#: Texts to screen: documents and pages, with a made-up hit of each kind of secret here and there.
PLANTED = "CASE {0} % 23 WHEN 1 THEN ' AKIA' || 'ABCDEFGHIJKLMNOP' WHEN 2 THEN ' ghp_' || 'abcdefghijklmnopqrstuvwx' WHEN 3 THEN ' -----BEGIN RSA PRIVATE' || ' KEY-----' WHEN 4 THEN ' 123-45-6789 ' WHEN 5 THEN ' sk-' || 'abcdefghijklmnopqrstuv' WHEN 6 THEN ' xoxb-' || 'abcdefghijklmnopqrstuv' WHEN 7 THEN ' github_pat_' || 'abcdefghijklmnopqrstuv' WHEN 8 THEN ' 4111 1111 1111 1111 and 4111-1111-1111-1111 ' ELSE '' END"
SCREENED = [("documents", "'doc/' || doc_id", f"coalesce(text, '') || {PLANTED.format('doc_id')}"), ("pages", "'page/' || page_id", f"coalesce(html, '') || {PLANTED.format('page_id')}")]
SCREENED_SQL = "texts AS (" + " UNION ALL ".join(f"SELECT {p} AS path, {t} AS text FROM {name}" for name, p, t in SCREENED) + ")"


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [spread(table(spark, sf_dir, name).selectExpr(f"{p} AS path", f"{t} AS text")) for name, p, t in SCREENED]
    return parts[0].unionByName(parts[1])


def text_findings(texts: DataFrame, cards: bool = True) -> DataFrame:
    """One finding for each pattern that a text (path, text) has, payment cards once: path, finding."""
    found = secret_labels(F.col("text"))
    if cards:
        found = F.concat(found, F.when(F.size(card_numbers(F.col("text"))) > 0, F.array(F.lit("payment card"))).otherwise(F.array().cast("array<string>")))
    return texts.select("path", F.explode(found).alias("finding"))


@query(f"WITH {SCREENED_SQL} " + " UNION ALL ".join(f"SELECT path, '{label}' AS finding FROM texts WHERE regexp_matches(text, '{p}')" for label, p in SECRET_PATTERNS.items()))
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_findings(screened(spark, sf_dir), cards=False)


@query(rf"""WITH {SCREENED_SQL}, found AS (SELECT path, unnest(regexp_extract_all(text, '\b(?:\d[ -]*?){{13,19}}\b')) AS raw FROM texts), digits AS (SELECT path, regexp_replace(raw, '\D', '', 'g') AS d FROM found),
sums AS (SELECT path, d, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN d[i]::INT * 2 > 9 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END ELSE d[i]::INT END)) AS s FROM digits WHERE len(d) BETWEEN 13 AND 19)
SELECT path, count(*) AS n_cards FROM sums WHERE s % 10 = 0 GROUP BY path""")
def card_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screened(spark, sf_dir).select("path", F.size(card_numbers(F.col("text"))).cast("long").alias("n_cards"))
    return found.where("n_cards > 0")


#: Fields of a document's properties that name people or places.
IDENTITY_FIELDS = ["category", "company", "contentstatus", "creator", "description", "hyperlinkbase", "identifier", "keywords", "lastmodifiedby", "manager", "subject", "title"]


def property_findings(parts: DataFrame, allowed: list[str]) -> DataFrame:
    """Values of identity fields in document properties (path, part, xml) that are not allowed: path, part, field, value."""

    def value_of(field: str):
        return lambda v: F.struct(F.lit(field).alias("field"), F.trim(v).alias("value"))

    fields = [F.transform(F.regexp_extract_all("xml", F.lit(rf"<(?:\w+:)?(?i:{f})(?:\s[^>]*)?>([^<]*)</"), F.lit(1)), value_of(f)) for f in IDENTITY_FIELDS]
    rows = parts.where(F.lower("part").startswith("docprops/")).select("path", "part", F.inline(F.concat(*fields)))
    return rows.where((F.col("value") != "") & ~F.col("value").isin(allowed))


PROPS = "'<cp:coreProperties><dc:creator>' || CASE WHEN doc_id % 3 = 0 THEN 'Team' ELSE source END || '</dc:creator><cp:lastModifiedBy> </cp:lastModifiedBy><dc:title x=\"1\">' || lang || '</dc:title><other>z</other></cp:coreProperties>'"


@query(f"WITH p AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'word/x.xml' ELSE 'docProps/core.xml' END AS part, doc_id, source, lang FROM documents) SELECT path, part, 'creator' AS field, source AS value FROM p WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT path, part, 'title', lang FROM p WHERE doc_id % 5 <> 0 AND lang <> 'en'")
def property_identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").selectExpr("'d' || doc_id AS path", "CASE WHEN doc_id % 5 = 0 THEN 'word/x.xml' ELSE 'docProps/core.xml' END AS part", f"{PROPS} AS xml")
    return property_findings(parts, ["Team", "en"])


def converted(files: DataFrame, converter: Callable[[bytes], str]) -> DataFrame:
    """Files (path, content) with the text that any converter makes, an Arrow batch at a time; what it raises is an error of the row, not of the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for content in batch["content"]:
                try:
                    texts.append(converter(bytes(content)))
                    errors.append(None)
                except Exception as e:  # a converter may raise anything
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:160])
            yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


@query("SELECT lang || '/' || doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN upper(lang) END AS text, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: bad' END AS error FROM documents")
def converted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converter given by the caller over all files, some of which it cannot read."""

    def convert(content: bytes) -> str:
        if content.startswith(b"!"):
            raise ValueError("bad")
        return content.decode().upper()

    files = table(spark, sf_dir, "documents").selectExpr("lang || '/' || doc_id AS path", "cast(CASE WHEN doc_id % 7 = 0 THEN '!' ELSE lang END AS binary) AS content")
    return converted(files, convert)


@query("SELECT doc_id, 'src_' || left(sha256('doc/' || doc_id || chr(0) || sha256(text)), 20) AS source_id, sha256(text) AS text_sha256 FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sha = table(spark, sf_dir, "documents"), F.sha2("text", 256)
    return docs.select("doc_id", identity("src", F.concat(F.lit("doc/"), F.col("doc_id")), sha).alias("source_id"), sha.alias("text_sha256"))


@query("""WITH g AS (SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id, list_sort(list(doc_id))[1:6] AS few FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT d.doc_id, g.n AS n_copies, g.first_id, array_to_string(list_filter(few, lambda x: x <> d.doc_id)[1:5], ',') AS others FROM documents d JOIN g ON sha256(d.text) = g.sha""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the number of copies and up to five others; the groups keep six ids at most, so a large one gathers nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    ranked = docs.groupBy("sha").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"))
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("sha", "salt").orderBy("doc_id"))).where("r <= 6").groupBy("sha").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 6).alias("few"))
    groups = ranked.where("n_copies > 1").join(few, "sha")
    others = F.slice(F.filter("few", lambda x: x != F.col("doc_id")), 1, 5)
    return docs.join(groups, "sha").select("doc_id", "n_copies", "first_id", F.array_join(F.transform(others, lambda x: x.cast("string")), ",").alias("others"))


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN source LIKE '%1%' THEN 'format:.pdf' END, CASE WHEN n_chars > 25000 THEN 'large-file' END) AS warnings FROM documents""")
def source_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id"), F.when(F.col("source").contains("1"), ".pdf").otherwise(".docx"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(paths.risk_warnings(path, F.col("n_chars") * 1000), "; ").alias("warnings"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS c FROM documents)
SELECT doc_id, sha256(CASE WHEN c = '' THEN '_(no text)_' WHEN length(c) > 2000 THEN left(c, 2000) || '[cut]' ELSE c END) AS region_sha256 FROM t""")
def capped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(capped(F.col("text"), 2000, "[cut]"), 256).alias("region_sha256"))
