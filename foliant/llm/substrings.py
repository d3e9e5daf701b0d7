"""Substring dedup by fixed-block anchors.

A repeat of at least 13 words holds a whole block of 7 words that starts at a multiple of 7 in the
earlier text.  So only those blocks are reference blocks, and the rolling 7-word window at every
place probes them.  A hit is extended: of the 13-word windows around it each is compared with all
other texts' windows, and the words of windows that an earlier document has become maximal spans.

1. *Anchors.*  Hashes of all 7-word windows are dealt into buckets by their leading bits, as packed
   arrays of 4-byte remainders and places.  A bucket tells which places have a hash that two
   documents share, one of them at a reference block.
2. *Extension.*  Windows of 13 words that hold a hit are dealt by a 96-bit hash of their words.
   A bucket tells which of them a smaller document id has too.
3. *Spans.*  Those places go back to their documents, as disjoint ranges of words.

What repeats within a task is settled there: the task keeps one entry for each hash, and the other
places are hits at once (1) or, unless they are the least document's, removed at once (2).  So a
passage that a third of all documents hold sends one entry a task, and no bucket gathers it.

Cases: a null text has no words; a text of fewer than 13 words loses none; rows that repeat an id
are one document with that id, and neither removes the other's words (if their texts differ, each
loses the places found for either, as far as it has them); a row without an id keeps its words and
removes none; of several texts that hold a passage the least id keeps it; a text of any length is used in
whole; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import column_values, map_arrow, partitions_for, text_bytes

WINDOW = 13
BLOCK = 7  # a window of 2 * BLOCK - 1 words holds a whole block
BUCKET_BYTES = 5 << 20
FLUSH_WORDS = 300_000

#: Random odd factors of the rolling hash, by a fixed rule.
MIX = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) * (k + 3) | 1) & (2**64 - 1) for k in range(64)], np.uint64)
BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
STEP = np.uint64(0xD6E8FEB86659FD93)
STEP_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """1, base, base ** 2 and so on, modulo 2 ** 64."""
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text: runs without space, tab, and the bytes up to carriage return."""
    data = np.frombuffer(text, np.uint8)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, from running sums over the text."""
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(BYTE[np.frombuffer(text, np.uint8)] * ahead[: len(text)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * back[starts]
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` words."""
    count = max(0, len(words) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out += words[k : k + count] * MIX[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one compressed value."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpack_arrays(value: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of `pack_arrays`."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    count = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def pack_places(docs: np.ndarray, places: np.ndarray, *more: np.ndarray) -> bytes:
    """Documents and places in rising order, as differences: small numbers, which compress."""
    return pack_arrays(np.diff(docs, prepend=0), np.diff(places, prepend=0).astype(np.int32), *more)


def unpack_places(value: bytes, *kinds: type) -> list[np.ndarray]:
    """The inverse of `pack_places`."""
    docs, places, *more = unpack_arrays(value, np.int64, np.int32, *kinds)
    return [np.cumsum(docs), np.cumsum(places.astype(np.int64)), *more]


def by_document(docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document's places, sorted and packed."""
    if not len(docs):
        return
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)]):
        yield int(docs[a]), np.diff(places[a:b], prepend=0).astype(np.int32).tobytes()


def places_of(value: bytes) -> np.ndarray:
    """The places in a value of `by_document`, once each."""
    return np.unique(np.cumsum(np.frombuffer(value, np.int32), dtype=np.int64))


DEALT = "bucket int, entries binary, places binary"


def bucket_of(docs: np.ndarray, count: int) -> np.ndarray:
    """The bucket of each document: by a hash, so that ids with a common stride spread too."""
    mixed = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int32)


def by_bucket(docs: np.ndarray, places: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """Places packed by their document's bucket: few rows, whatever the number of documents."""
    if not len(docs):
        return
    bucket = bucket_of(docs, count)
    order = np.lexsort((places, docs, bucket))
    docs, places, bucket = docs[order], places[order], bucket[order]
    _, first = groups_of(bucket)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(docs)]):
        yield int(bucket[a]), pack_places(docs[a:b], places[a:b])


class Dealer:
    """Gathers a task's rows: entries for a hash's bucket, and places that need no bucket's word for their document's bucket."""

    def __init__(self, count: int) -> None:
        self.count, self.rows = count, []

    def entries(self, bucket: int, packed: bytes) -> None:
        self.rows.append((bucket, packed, None))

    def results(self, docs: np.ndarray, places: np.ndarray) -> None:
        self.rows += [(bucket, None, packed) for bucket, packed in by_bucket(docs, places, self.count)]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.rows), 256):
            columns = zip(*self.rows[a : a + 256])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "entries", "places"])


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values in order: the group number of each, and the first position of each group."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def deal_anchors(rows: DataFrame, buckets: int, block: int, flush_words: int) -> DataFrame:
    """Step 1 in the tasks that read documents (_id, _text): anchor entries by bucket, and hits that the task knows already."""

    def flush(hashes: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        h, d, p = map(np.concatenate, (hashes, docs, places))
        order = np.argsort(h, kind="stable")
        group, first = groups_of(h[order])
        ordered = d[order]
        several = (np.minimum.reduceat(ordered, first) != np.maximum.reduceat(ordered, first))[group]
        anchored = np.logical_or.reduceat(p[order] % block == 0, first)[group]
        head = np.zeros(len(h), bool)
        head[first] = True
        dealer = Dealer(buckets)
        hit = order[several]
        dealer.results(d[hit], p[hit])
        # One entry of a hash that several documents of the task share; else all, as one document's places may be many.
        sent = np.where(several, head, True)
        kind = np.empty(len(h), np.uint8)
        kind[order] = anchored + 2 * several
        keep = np.zeros(len(h), bool)
        keep[order] = sent
        h, d, p, kind = h[keep], d[keep], p[keep], kind[keep]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        group, first = groups_of(bucket[order])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            own = order[a:b]
            dealer.entries(int(bucket[own[0]]), pack_places(d[own], p[own], kind[own], h[own].astype(np.uint32)))
        yield from dealer.batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hashes, docs, places, held = [], [], [], 0
        ahead, back = powers(STEP, 1 << 16), powers(STEP_BACK, 1 << 16)
        for batch in batches:
            for doc, text in zip(column_values(batch, "_id"), column_values(batch, "_text")):
                starts, ends = word_places(text)
                if doc is None or len(starts) < 2 * block - 1:
                    continue
                if len(text) >= len(ahead):
                    ahead, back = powers(STEP, 2 * len(text)), powers(STEP_BACK, 2 * len(text))
                found = window_hashes(word_hashes(text, starts, ends, ahead, back), block)
                hashes.append(found), docs.append(np.full(len(found), doc, np.int64)), places.append(np.arange(len(found), dtype=np.int64))
                held += len(found)
                if held >= flush_words:
                    yield from flush(hashes, docs, places)
                    hashes, docs, places, held = [], [], [], 0
        yield from flush(hashes, docs, places)

    return map_arrow(rows, DEALT, run)


def with_known(group: pa.Table, count: int, settle) -> pa.Table:
    """What a bucket finds from its entries, by document bucket, and the places that came along."""
    known = group.select(["bucket", "places"]).filter(group.column("places").is_valid())
    entries = group.column("entries").drop_null().to_pylist()
    found = list(by_bucket(*settle(entries), count)) if entries else []
    return pa.concat_tables([known, pa.table({"bucket": pa.array([f[0] for f in found], pa.int32()), "places": pa.array([f[1] for f in found], pa.binary())})])


def gathered(group: pa.Table) -> pa.Table:
    """A row for each document of a bucket, with its places."""
    parts = [unpack_places(v) for v in group.column("places").to_pylist()]
    found = list(by_document(*(np.concatenate(x) for x in zip(*parts))))
    return pa.table({"_id": pa.array([f[0] for f in found], pa.int64()), "hits": pa.array([f[1] for f in found], pa.binary())})


def anchor_hits(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Step 1 in a bucket: places whose hash two documents share, where one has it at a reference block."""
    parts = [unpack_places(v, np.uint8, np.uint32) for v in entries]
    docs, places, kind, h = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.argsort(h, kind="stable")
    number, first = groups_of(h[order])
    ordered, kinds = docs[order], kind[order]
    shared = (np.minimum.reduceat(ordered, first) != np.maximum.reduceat(ordered, first)) | np.logical_or.reduceat(kinds >= 2, first)
    hit = (shared & np.logical_or.reduceat(kinds % 2 == 1, first))[number] & (kinds < 2)
    return docs[order[hit]], places[order[hit]]


def deal_windows(rows: DataFrame, buckets: int, window: int, block: int, flush_words: int) -> DataFrame:
    """Step 2 for documents (_id, _text, hits): windows that hold a hit, by bucket of their 96-bit hash."""

    def flush(highs: list, lows: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        if not highs:
            return
        high, low, d, p = np.array(highs, np.uint64), np.array(lows, np.uint32), np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((d, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        first = np.flatnonzero(new)
        least = d[order][first][np.cumsum(new) - 1]
        dealer = Dealer(buckets)
        later = order[d[order] != least]
        dealer.results(d[later], p[later])
        own = order[d[order] == least]  # the least document's places, all of them: what another task has may remove them
        bucket = ((high[own] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        own, bucket = own[by := np.lexsort((p[own], d[own], bucket))], bucket[by]
        _, first = groups_of(bucket)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
            part = own[a:b]
            dealer.entries(int(bucket[a]), pack_places(d[part], p[part], high[part], low[part]))
        yield from dealer.batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        highs, lows, docs, places = [], [], [], []
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for doc, text, hits in zip(column_values(batch, "_id"), column_values(batch, "_text"), column_values(batch, "hits")):
                if not hits:
                    continue
                words = text.split()
                last = len(words) - window
                if last < 0:
                    continue
                wanted = np.zeros(len(words) + 1, np.int64)
                at = places_of(hits)
                at = at[at <= len(words) - block]
                np.add.at(wanted, np.maximum(at - (window - block), 0), 1)
                np.add.at(wanted, np.minimum(at, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(wanted)[: last + 1] > 0)
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate([[0], ends[:-1] + 1])
                for a, b in zip(begins[starts].tolist(), ends[starts + window - 1].tolist()):
                    value = digest(joined[a:b])
                    highs.append(value >> 64), lows.append(value & 0xFFFFFFFF)
                docs.append(np.full(len(starts), doc, np.int64)), places.append(starts)
                if len(highs) >= flush_words // 2:
                    yield from flush(highs, lows, docs, places)
                    highs, lows, docs, places = [], [], [], []
        yield from flush(highs, lows, docs, places)

    return map_arrow(rows, DEALT, run)


def later_windows(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Step 2 in a bucket: places of windows that a document with a smaller id has too."""
    parts = [unpack_places(v, np.uint64, np.uint32) for v in entries]
    docs, places, high, low = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((docs, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    least = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = order[docs[order] != least]
    return docs[later], places[later]


def settled(dealt: DataFrame, count: int, settle) -> DataFrame:
    """A row for each document with places (_id, hits): what tasks knew and what buckets found."""
    found = dealt.repartition(count, "bucket").groupBy("bucket").applyInArrow(lambda group: with_known(group, count, settle), "bucket int, places binary")
    return found.repartition(count, "bucket").groupBy("bucket").applyInArrow(gathered, "_id long, hits binary")


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", flush_words: int = FLUSH_WORDS) -> DataFrame:
    """All documents (_id, _text) with `hits`: packed places of windows that start in a document with a smaller id too; null if none."""
    spark, block = docs.sparkSession, (window + 1) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    partitions = partitions_for(spark, docs, BUCKET_BYTES)
    known = rows.where("_id is not null")
    placed = known.repartition(partitions, "_id")
    anchors = settled(deal_anchors(known, partitions, block, flush_words), partitions, anchor_hits)
    # Both joins are left joins so that one exchange of the documents serves both.
    windows = settled(deal_windows(placed.join(anchors, "_id", "left"), partitions, window, block, flush_words), partitions, later_windows)
    return placed.join(windows, "_id", "left").unionByName(rows.where("_id is null").withColumn("hits", F.lit(None).cast("binary")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", flush_words: int = FLUSH_WORDS, keep_unchanged: bool = False) -> DataFrame:
    """The id, n_words, n_removed, spans (disjoint word ranges that go, end excluded) and kept (the words left, joined by one space; null where none go, if `keep_unchanged`) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for text, hits in zip(column_values(batch, "_text"), column_values(batch, "hits")):
                words = text.split()
                ranges = []
                if hits:
                    at = places_of(hits)
                    at = at[at <= len(words) - window]
                    cuts = np.flatnonzero(np.diff(at) > window) + 1
                    ranges = [(int(at[a]), int(at[b - 1]) + window) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]) if b > a]
                counts.append(len(words)), removed.append(sum(b - a for a, b in ranges))
                spans.append([{"start": a, "end": b} for a, b in ranges])
                for a, b in reversed(ranges):
                    del words[a:b]
                kept.append(None if keep_unchanged and not ranges else b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "spans", "kept"])

    rows = repeated_windows(docs, window, id_col, text_col, flush_words).select(F.col("_id").alias(id_col), "_text", "hits")
    return map_arrow(rows, f"{id_col} long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string", run)
