"""Exact duplicates through an extendible-hash index on files that all tasks share.

Texts are equal when they are after deleting every character of `[\\x20\\x09-\\x0D]`.  Map tasks put equal
texts of theirs together first, so a text that a third of all rows hold costs each task one entry.  Entries go
into buckets by the leading bits of a 64-bit hash: the directory starts with one slot and doubles whenever an
overfull bucket needs one more bit than it has.  A bucket that no bit can split (one key) or that is overfull
at the deepest directory becomes a chain of pages, merged page by page and then once more.  Owner tasks walk their
buckets in key order, hold the chain of one key only, and take texts as equal after comparing their bytes.

Defined cases: a null text is the empty text; blank texts are equal to each other; of equal texts the one of most
code points before deletion stays, then the smallest id, rows without an id last, and of rows that tie in all that
exactly one; other columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StructField, StructType

from foliant.llm.common import column_values, map_arrow, remove_folder, stage_folder

SPACES = " \t\n\x0b\x0c\r"
#: Bits of the hash that the directory may use: at most 65,536 slots, whatever the corpus.
DEEPEST = 16
#: Bytes of texts that a map task keeps to find copies before it starts anew.
HELD_BYTES = 32 << 20
OUT_ROWS = 2_000


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


@dataclass
class Directory:
    """Slots of 2**depth leading-bit patterns; each names its bucket (the first slot of it), and buckets know their pages."""

    depth: int
    slots: np.ndarray
    pages: dict[int, int]


def grow_directory(cells: np.ndarray, sizes: np.ndarray, single: np.ndarray, capacity: int, deepest: int = DEEPEST) -> Directory:
    """Double the directory and split buckets until each fits or no bit can help.

    `cells` are patterns of `deepest` leading bits that have entries, `sizes` their bytes, `single` whether all
    entries of a cell have one key.
    """
    whole = np.zeros(1 << deepest, np.int64)
    whole[cells] = sizes
    filled = np.zeros(1 << deepest, np.int64)
    filled[cells] = np.where(single, 1, 2)
    size_to, keys_to = (np.concatenate([[0], np.cumsum(x)]) for x in (whole, filled))
    depth, local, slots, pages = 0, {0: 0}, np.zeros(1, np.int64), {}

    def span(bucket: int) -> tuple[int, int]:
        width = 1 << (deepest - local[bucket])
        first = bucket << (deepest - depth)
        return int(size_to[first + width] - size_to[first]), int(keys_to[first + width] - keys_to[first])

    waiting = [0]
    while waiting:
        bucket = waiting.pop()
        size, keys = span(bucket)
        if size <= capacity:
            continue
        if keys < 2 or local[bucket] == deepest:
            pages[bucket] = -(-size // capacity)
            continue
        if local[bucket] == depth:  # one more bit: every slot becomes two
            depth, slots = depth + 1, np.repeat(slots, 2) * 2
            local, pages = ({b * 2: v for b, v in d.items()} for d in (local, pages))
            waiting, bucket = [b * 2 for b in waiting], bucket * 2
        local[bucket] += 1
        other = bucket + (1 << (depth - local[bucket]))
        local[other] = local[bucket]
        slots[other : other + (1 << (depth - local[bucket]))] = other
        waiting += [bucket, other]
    return Directory(depth, slots, pages)


def _collected(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Rows (kind 0) and, for each text that a task held once or more, an entry (kind 1) with its bytes, count and best row."""
    id_type = docs.schema["doc_id"].dataType
    body = normalised(docs["text"])
    source = docs.select(docs["doc_id"].alias("doc_id"), F.length(F.coalesce(docs["text"], F.lit(""))).alias("n_chars"), body.alias("__body")).select(
        "doc_id", "n_chars", key(F.col("__body")).alias("key"), F.unhex(F.sha2("__body", 256)).alias("sha"), F.col("__body").cast("binary").alias("body")
    )
    schema = StructType([
        StructField("kind", ByteType()), StructField("row", LongType()), StructField("entry", LongType()), StructField("doc_id", id_type), StructField("n_chars", IntegerType()),
        StructField("sha", BinaryType()), StructField("key", LongType()), StructField("body", BinaryType()), StructField("n", LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        row, held, size, id_arrow = TaskContext.get().partitionId() << 33, {}, 0, None

        def entries() -> Iterator[pa.RecordBatch]:
            found = [e for chain in held.values() for e in chain]
            for at in range(0, len(found), OUT_ROWS):
                part = found[at : at + OUT_ROWS]
                best = [e[2] for e in part]
                yield _batch([1] * len(part), [b[2] for b in best], [e[1] for e in part], pa.array([b[1][1] for b in best], id_arrow), [-b[0] for b in best], [None] * len(part), [e[4] for e in part], [e[0] for e in part], [e[3] for e in part])

        for batch in batches:
            ids, chars, keys, bodies = (column_values(batch, c) for c in ("doc_id", "n_chars", "key", "body"))
            id_arrow = batch.schema.field("doc_id").type
            owners = []
            for doc, n, k, body in zip(ids, chars, keys, bodies):
                chain = held.setdefault(k, [])
                entry = next((e for e in chain if e[0] == body), None)
                best = (-n, (doc is None, doc), row)
                if entry is None:
                    chain.append(entry := [body, row, best, 0, k])
                    size += len(body) + 200
                elif best[0] < entry[2][0] or best[0] == entry[2][0] and _before(best[1], entry[2][1]):
                    entry[2] = best
                entry[3] += 1
                owners.append(entry[1])
                row += 1
            count = len(ids)
            if count:
                yield _batch([0] * count, list(range(row - count, row)), owners, batch.column("doc_id"), chars, batch.column("sha"), [None] * count, [None] * count, [None] * count)
            if size > HELD_BYTES:
                yield from entries()
                held, size = {}, 0
        if held:
            yield from entries()

    return map_arrow(source, schema, run, keeps="exact")


def _before(a: tuple, b: tuple) -> bool:
    """Whether id `a` comes before id `b`; each is (is null, value)."""
    return a[0] < b[0] or not a[0] and not b[0] and a[1] < b[1]


def _batch(kind: list, row: list, entry: list, ids: pa.Array, chars: list, sha: list | pa.Array, key: list, body: list, n: list) -> pa.RecordBatch:
    arrays = [pa.array(kind, pa.int8()), pa.array(row, pa.int64()), pa.array(entry, pa.int64()), ids, pa.array(chars, pa.int32()), sha if isinstance(sha, pa.Array) else pa.array(sha, pa.binary()), pa.array(key, pa.int64()), pa.array(body, pa.binary()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "row", "entry", "doc_id", "n_chars", "sha", "key", "body", "n"])


def _chained(entries: DataFrame, tasks: int) -> DataFrame:
    """The class of every entry: an owner task walks its buckets by key and compares the texts of a key byte by byte.

    Takes entry, bucket, page, pages, key, body, n, doc_id, n_chars, row; gives entry, head (the least entry of the class
    within the page), the class's n, doc_id, n_chars and row, bucket, key, and the head's body where more pages follow.
    """
    names = ["entry", "head", "n", "doc_id", "n_chars", "row", "bucket", "key", "body", "open"]
    fields = {f.name: f.dataType for f in entries.schema}
    schema = StructType([StructField(c, fields[c] if c in fields else LongType()) for c in names])
    dealt = entries.repartition(tasks, "bucket", "page").sortWithinPartitions("bucket", "page", "key", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, chain, done, types = None, [], [], {}

        def settle() -> None:
            for body, members, best, n, (bucket, _, key), pages in chain:
                for member in members:
                    shown = body if pages > 1 and member == members[0] else None
                    done.append((member, members[0], n, best[1][1], -best[0], best[2], bucket, key, shown, int(pages > 1)))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*done), names)], names=names)

        for batch in batches:
            types = {k: batch.schema.field(k).type if k in batch.schema.names else pa.int64() for k in names}
            cols = [column_values(batch, c) for c in ("entry", "bucket", "page", "pages", "key", "body", "n", "doc_id", "n_chars", "row")]
            for entry, bucket, page, pages, key, body, n, doc, chars, row in zip(*cols):
                if at != (bucket, page, key):
                    settle()
                    at, chain = (bucket, page, key), []
                best = (-chars, (doc is None, doc), row)
                same = next((c for c in chain if c[0] == body), None)
                if same is None:
                    chain.append([body, [entry], best, n, (bucket, page, key), pages])
                    continue
                same[1].append(entry)
                same[3] += n
                if best[0] < same[2][0] or best[0] == same[2][0] and (_before(best[1], same[2][1]) or best[1] == same[2][1] and row < same[2][2]):
                    same[2] = best
            if len(done) >= OUT_ROWS:
                yield out()
                done.clear()
        settle()
        if done:
            yield out()

    return map_arrow(dealt, schema, run, keeps="exact")


def build_index(docs: DataFrame, folder: str, bucket_bytes: int = 32 << 20, key: Callable[[Column], Column] = F.xxhash64) -> None:
    """Write the index of `docs` (doc_id, text) into a shared folder: `collected`, `directory`, `classes`.

    Buckets hold `bucket_bytes`, or what 2**15 buckets need if that is more: the directory stays within its depth.
    """
    spark = docs.sparkSession
    _collected(docs, key).write.parquet(f"{folder}/collected")
    entries = spark.read.parquet(f"{folder}/collected").where("kind = 1").drop("kind", "sha")
    cell = F.shiftrightunsigned("key", 64 - DEEPEST)
    cells = entries.groupBy(cell.alias("cell")).agg(F.sum(F.length("body") + 64).alias("size"), (F.min("key") == F.max("key")).alias("single"), F.count("*").alias("n")).toArrow()
    total = int(np.sum(cells["size"].to_numpy())) if cells.num_rows else 0
    found = grow_directory(cells["cell"].to_numpy(), cells["size"].to_numpy(), cells["single"].to_numpy(zero_copy_only=False), max(bucket_bytes, total >> (DEEPEST - 1)))
    slots = pa.table({"slot": np.arange(len(found.slots)), "bucket": found.slots, "pages": pa.array([found.pages.get(int(b), 1) for b in found.slots], pa.int64())})
    spark.createDataFrame(slots).coalesce(1).write.parquet(f"{folder}/directory")
    directory = spark.read.parquet(f"{folder}/directory")
    slot = F.shiftrightunsigned("key", 64 - found.depth) if found.depth else F.lit(0).cast("long")
    placed = entries.withColumn("slot", slot).join(F.broadcast(directory), "slot").withColumn("page", F.pmod(F.xxhash64("entry"), "pages"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, len(set(found.slots.tolist())) + sum(found.pages.values())))
    _chained(placed, tasks).write.parquet(f"{folder}/classes")
    if found.pages:  # heads of the pages meet once more
        heads = spark.read.parquet(f"{folder}/classes").where("open = 1 AND entry = head")
        again = heads.withColumn("page", F.lit(0).cast("long")).withColumn("pages", F.lit(1).cast("long"))
        _chained(again, tasks).write.parquet(f"{folder}/merged")


def classes_of(spark: SparkSession, folder: str, paged: bool) -> DataFrame:
    """entry, group_size, keep_id, keep_row of every entry of an index."""
    classes = spark.read.parquet(f"{folder}/classes").select("entry", "head", "n", "doc_id", "row", "open")
    final = ["entry", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row")]
    if not paged:
        return classes.select(*final)
    merged = spark.read.parquet(f"{folder}/merged").select(F.col("entry").alias("head"), F.col("n").alias("__n"), F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
    joined = classes.where("open = 1").join(merged, "head").select("entry", F.col("__n").alias("group_size"), F.col("__doc").alias("keep_id"), F.col("__row").alias("keep_row"))
    return classes.where("open = 0").select(*final).unionByName(joined)


def exact_copies(docs: DataFrame, bucket_bytes: int = 32 << 20, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 of the text without white space."""
    spark = docs.sparkSession
    folder = stage_folder(spark)
    build_index(docs, folder, bucket_bytes, key)
    paged = not spark.read.parquet(f"{folder}/directory").where("pages > 1").isEmpty()
    rows = spark.read.parquet(f"{folder}/collected").where("kind = 0").select("row", "entry", "doc_id", "sha")
    joined = rows.join(classes_of(spark, folder, paged), "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    result = f"{folder}-copies"
    joined.write.parquet(result)
    remove_folder(spark, folder)
    return spark.read.parquet(result)
