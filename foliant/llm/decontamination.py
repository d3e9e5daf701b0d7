"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are brought to a canonical form, words joined by single spaces with one at either end, and
each benchmark window is a pattern of that form, so a match is a match of whole words.  A table of
block shifts lets the scan jump over positions where no pattern can end; a block with shift zero
selects a suffix-hash bucket whose patterns are compared directly.  Patterns are grouped by length
class, since the largest shift follows the shortest pattern.

The benchmark is a fixed query set.  Its items go to the executors in blocks whose bytes are counted
as they are gathered; a pass over the documents takes BLOCKS_EACH blocks at most, whose tables a worker
builds once, and a larger benchmark takes more passes.

Cases: a null or empty text or item has no words, and an item without words matches nothing; an
item with fewer words than a window is one window; items that share an id are one, repeated rows count
each; an item without an id has the empty one; an empty benchmark hits nothing, an empty table gives no
rows; a text of any length is scanned in whole; columns besides id and text, whatever their names, are
ignored, but for those carried along.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import checkpoint, column_values, map_arrow, text_bytes, worker_tables

WINDOW = 10
BLOCK_BYTES, BLOCKS_EACH = 8 << 20, 4

#: Lower-cases A-Z and turns each byte that is in no word into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words: runs of digits, letters and bytes above 127, with A-Z lower-cased."""
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> Iterable[bytes]:
    """Each window of an item as a pattern."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + size]) + b" "


class WuManber:
    """Shift tables and buckets for patterns of one length class."""

    def __init__(self, patterns: dict[bytes, list]) -> None:
        self.owners = patterns
        self.least = min(map(len, patterns))
        self.block = max(1, min(self.least, math.ceil(math.log(2 * self.least * len(patterns), 8))))
        self.far = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        for pattern in patterns:
            for end in range(self.block, self.least + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), self.least - end)
            self.buckets[pattern[self.least - self.block : self.least]][pattern[: self.least]].append(pattern)

    def matches(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Place and pattern of every occurrence."""
        least, block, far, shift = self.least, self.block, self.far, self.shift.get
        end, size = least, len(text)
        while end <= size:
            step = shift(text[end - block : end], far)
            if step:
                end += step
                continue
            start = end - least
            for pattern in self.buckets[text[end - block : end]].get(text[start:end], ()):
                if text.startswith(pattern, start):
                    yield start, pattern
            end += 1


class Matcher:
    """All patterns of a block of the benchmark, by length class."""

    CLASSES = (8, 24, 48)

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        groups: dict[int, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            for pattern in windows_of(words_of(text), window):
                groups[sum(len(pattern) >= c for c in self.CLASSES)][pattern].append(item)
        self.tables = [WuManber(dict(g)) for _, g in sorted(groups.items())]

    def search(self, words: list[bytes], spans: list[tuple[int, int]], items: set[str]) -> None:
        """Add the word ranges of all occurrences, and the items that occur."""
        text = b" " + b" ".join(words) + b" "
        for table in self.tables:
            at = word = 0
            for start, pattern in table.matches(text):
                word += text.count(b" ", at, start)
                at = start
                spans.append((word, word + pattern.count(b" ") - 1))
                items.update(table.owners[pattern])


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most `block_bytes` bytes of text, or of one item."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), text_bytes(text_col).alias("_text")).where(F.length("_text") > 0)
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["_text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["_id"], bytes(row["_text"])))
        size += len(row["_text"])
    if block:
        yield block


def search_pass(rows: DataFrame, blocks: list[Broadcast], window: int, id_col: str, carried: list[str]) -> DataFrame:
    """One pass: rows (id, columns of `carried`, _text, hit_spans, items) with what these blocks hit added, and n_words."""
    names = [(xxhash.xxh3_64_intdigest(repr(b.value).encode()), window) for b in blocks]

    def matcher(k: int) -> Matcher:
        kept = worker_tables("decontamination")
        # Tables of other passes go; those of this one are built once in a worker.
        for other in [name for name in kept if name not in names]:
            del kept[other]
        if names[k] not in kept:
            kept[names[k]] = Matcher(blocks[k].value, window)
        return kept[names[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = [], [], []
            for text, before, known in zip(*(column_values(batch, c) for c in ("_text", "hit_spans", "items"))):
                words = words_of(text)
                own, ids = [(s["start"], s["end"]) for s in before], set(known)
                for k in range(len(blocks) if words else 0):
                    matcher(k).search(words, own, ids)
                counts.append(len(words)), items.append(sorted(ids))
                spans.append([{"start": a, "end": b} for a, b in union_of(own)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [id_col, *carried, "_text"]]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())], [id_col, *carried, "_text", "hit_spans", "items", "n_words"])

    own = rows.select(id_col, *carried, "_text", "hit_spans", "items")
    return map_arrow(own, T.StructType([*own.schema.fields, T.StructField("n_words", T.LongType())]), run, "decontamination")


def find_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The id, the columns of `carry`, n_words, hit_spans (disjoint word ranges, end excluded) and items (ids, sorted as strings) of each document."""
    spark, carried = docs.sparkSession, carry or []
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *carried, text_bytes(text_col).alias("_text"), F.array().cast(spans).alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    blocks = benchmark_blocks(items, item_col, item_text_col, block_bytes)
    now = list(islice(blocks, BLOCKS_EACH))
    while True:
        shared = [spark.sparkContext.broadcast(b) for b in now]
        rows = search_pass(rows, shared, window, id_col, carried)
        now = list(islice(blocks, BLOCKS_EACH))
        if not now:
            return rows.select(id_col, *carried, "n_words", "hit_spans", "items")
        rows = checkpoint(spark, rows)
        for block in shared:
            block.destroy()


def without_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window; all columns, no shuffle."""
    carried = docs.select(F.monotonically_increasing_id().alias("__row"), text_bytes(text_col).alias("__text"), F.struct(*[docs[c] for c in docs.columns]).alias("__all"))
    found = find_benchmark(carried, items, window, id_col="__row", text_col="__text", carry=["__all"], **options)
    return found.where(F.size("hit_spans") == 0).select("__all.*")


def contamination_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items for each document."""
    return found.select(
        id_col,
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
