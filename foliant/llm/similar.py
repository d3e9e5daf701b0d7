"""Groups of texts whose five-word shingles are similar: SimHash links, verified, and an exact way for what they miss.

Texts with equal words are one class.  1. The trie self-join of SimHash fingerprints ties classes
together, and those ties whose shingle sets are similar enough are links.  2. Similar sets share a
shingle of their prefixes (the first n - ceil(t * n) + 1 in one common order), and in all at least as
many as sets of their sizes must; and where the parities of their shingles' counts by hash class differ,
a shingle does.  So classes that pass these tests, and that no verified link ties together yet, are verified
too.  The result is that of comparing all pairs, up to collisions of 64-bit hashes; the
fingerprints save the pairs within large groups, which would grow with the square.

The order of the prefixes puts the shingles last that are common in a bounded sample; it is exact in
any order.  Prefix shingles that one class alone has are left out once, before any round.  The others
are dealt into buckets as packed arrays, and a bucket counts what pairs of classes of fitting sizes share; a pair that shares one of the first shingles of its prefixes, rare or
common, is named by that shingle's bucket alone.

Cases: a null text counts as empty; texts without words are one class; rows that repeat an id with
other texts are texts of their own; a null id comes after all others; empty tables give no rows;
other columns are not looked at; texts of any length are read in whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, column_values, map_arrow, release, remove_folder, slabs, small_batches, stage_folder, text_bytes, worker_tables
from foliant.llm.components import least_members
from foliant.llm.shingles import CLASSES, LOWER, SLAB, Powers, Shingled, least_shared, may_be_similar, prefix_lengths, shingled, similar
from foliant.llm.simhash import BUDGET, trie_links
from foliant.llm.substrings import DEALT, MIX, Dealer, groups_of, pack_arrays, pack_places, places_of, settled, unpack_arrays, unpack_places

SIZE, SIMILARITY = 5, 0.8
SAMPLED, COMMON, COMMON_KEPT = 8192, 3, 65_536
HELD_TOKENS = 200_000
BUCKET_TOKENS, LEAST_BUCKETS = 400_000, 24
PAIRS_STEP = 1 << 16
HELD_PAIRS = 1 << 20
HEADS = 3
WIDE = 1024
STAR_ROUNDS, STAR_LEAST = 8, 0.005
BROADCAST_ROWS = 1 << 17


def text_class(text: bytes) -> int:
    """The number (a signed long) of all texts with the same words."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.translate(LOWER).split())) - (1 << 63)


def numbered_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, _text and a 128-bit key (k1, k2) of both, the same for equal rows only."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("_text"))
    return own.select(F.xxhash64("id", "_text").alias("k1"), F.xxhash64("_text", "id", F.lit(1)).alias("k2"), "id", "_text")


def in_slabs(batches: Iterator[pa.RecordBatch], size: int, last: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes], Shingled]]:
    """Slices of the batches with their texts and distinct shingles."""
    factors = worker_tables("similar").setdefault("factors", Powers())
    for batch in batches:
        texts = column_values(batch, "_text")
        for a, b in slabs(texts, SLAB):
            yield batch.slice(a, b - a), texts[a:b], shingled(texts[a:b], size, factors, last)


def common_shingles(rows: DataFrame, size: int, count: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, as sorted hashes; bounded, and of no influence on the result."""
    every = max(1, count // SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for _, _, own in in_slabs(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(own.hashes.view(np.int64))], ["token"])

    sample = rows.where(F.pmod(F.xxhash64("_text"), F.lit(every)) == 0).select("_text").distinct()
    counts = map_arrow(sample, "token long", run, "similar").groupBy("token").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r.token for r in counts.orderBy(F.desc("count"), "token").limit(COMMON_KEPT).collect()], np.int64).view(np.uint64))


def marked(rows: DataFrame, size: int, similarity: float, last: np.ndarray) -> DataFrame:
    """Each row's key and id with its class (node), number of shingles (n), fingerprint (fp), prefix, and `odd`: parities and the prefix's first rare and common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for part, texts, own in in_slabs(batches, size, last):
            lengths = prefix_lengths(own.sizes, similarity)
            prefix = own.parts(lengths)
            odd = [words.tobytes() for words in np.concatenate([own.parities(), own.heads(lengths, HEADS)], axis=1)]
            arrays = [pa.array(map(text_class, texts), pa.int64()), pa.array(own.sizes.astype(np.int64)), pa.array(own.fingerprints().view(np.int64)), pa.array(prefix, pa.binary()), pa.array(odd, pa.binary())]
            words = own.parities(WIDE).view(np.int64).reshape(-1)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(own.sizes) + 1, dtype=np.int32) * (WIDE // 64)), pa.array(words))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays, wide], ["k1", "k2", "id", "node", "n", "fp", "prefix", "odd", "wide"])

    return map_arrow(rows, "k1 long, k2 long, id long, node long, n long, fp long, prefix binary, odd binary, wide array<long>", run, "similar")


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each shingle, by ranges of the hash: prefixes hold the low quarter above all, which so gets four fifths of the buckets."""
    part = (token >> np.uint64(32)).astype(np.float64) / 2**32
    return np.minimum(np.where(part < 0.25, 3.2 * part, 0.8 + (part - 0.25) / 3.75) * buckets, buckets - 1).astype(np.int32)


def buckets_for(spark: SparkSession, classes: DataFrame) -> int:
    """Buckets for the prefixes of classes, of BUCKET_TOKENS shingles each."""
    tokens = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    return max(min(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-tokens // 8 // BUCKET_TOKENS))


def several_have(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """In a bucket: the classes and places of shingles that come more than once."""
    node, place, token = (np.concatenate(x) for x in zip(*(unpack_places(v, np.uint32) for v in entries)))
    order = np.argsort(token, kind="stable")
    number, first = groups_of(token[order])
    held = order[(np.diff(first, append=len(order)) > 1)[number]]
    return node[held], place[held]


def shared_prefixes(classes: DataFrame, buckets: int) -> DataFrame:
    """The classes (node, n, prefix, odd) whose prefixes have a shingle that another's has, with such shingles alone: the others name no pair."""

    def flush(nodes: list[int], prefixes: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = [len(p) // 8 for p in prefixes]
        token = np.frombuffer(b"".join(prefixes), np.uint64)
        node, place = np.repeat(np.array(nodes, np.int64), counts), np.concatenate([np.arange(n) for n in counts])
        bucket = bucket_of(token, buckets)
        order = np.lexsort((place, node, bucket))
        token, node, place, bucket = token[order].astype(np.uint32), node[order], place[order], bucket[order]
        _, first = groups_of(bucket)
        dealer = Dealer(buckets)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            dealer.entries(int(bucket[a]), pack_places(node[a:b], place[a:b], token[a:b]))
        yield from dealer.batches()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        nodes, prefixes, size = [], [], 0
        for batch in batches:
            for node, prefix in zip(column_values(batch, "node"), column_values(batch, "prefix")):
                if prefix:
                    nodes.append(node), prefixes.append(prefix)
                    size += len(prefix) // 8
                if size >= HELD_TOKENS:
                    yield from flush(nodes, prefixes)
                    nodes, prefixes, size = [], [], 0
        if nodes:
            yield from flush(nodes, prefixes)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, np.uint64)[places_of(h)].tobytes() for p, h in zip(column_values(batch, "prefix"), column_values(batch, "hits"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes, pa.binary()), batch.column(3)], ["node", "n", "prefix", "odd"])

    places = settled(map_arrow(classes.select("node", "prefix"), DEALT, deal, "similar"), buckets, several_have)
    held = classes.join(places.withColumnRenamed("_id", "node"), "node").select("node", "n", "prefix", "odd", "hits")
    return map_arrow(held, "node long, n long, prefix binary, odd binary", shorten, "similar")


def dealt_prefixes(classes: DataFrame, buckets: int) -> DataFrame:
    """The prefixes of classes (node, label, n, prefix, odd) by bucket: packed arrays of the classes, their parities, and their shingles there."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        node, label, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        token = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
        odd = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(-1, CLASSES // 64 + 2 * HEADS)
        bucket = bucket_of(token, buckets)
        order = np.argsort(bucket, kind="stable")
        token, owner, bucket = token[order].astype(np.uint32), owner[order], bucket[order]
        out = []
        _, first = groups_of(bucket)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
            _, begin = groups_of(owner[a:b])
            own = owner[a:b][begin]
            counts = np.diff(begin, append=b - a).astype(np.int32)
            out.append((int(bucket[a]), pack_arrays(node[own], label[own], n[own].astype(np.int32), counts), pack_arrays(odd[own].reshape(-1)), pack_arrays(token[a:b])))
        for k in range(0, len(out), 512):
            columns = zip(*out[k : k + 512])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "classes", "odds", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(column_values(batch, c) for c in ("node", "label", "n", "prefix", "odd"))):
                if not row[3]:
                    continue
                held.append(row)
                size += len(row[3]) // 8
                if size >= HELD_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return map_arrow(classes.select("node", "label", "n", "prefix", "odd"), "bucket int, classes binary, odds binary, tokens binary", run, "similar")


def crossing_pairs(token: np.ndarray, owner: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of owners with one token and different labels, in steps; a pair comes once for each token."""
    order = np.lexsort((label[owner], token))
    token, owner = token[order], owner[order]
    at = np.arange(len(token))
    new_token = np.ones(len(token), bool)
    new_token[1:] = token[1:] != token[:-1]
    labels = label[owner]
    new_label = new_token.copy()
    new_label[1:] |= labels[1:] != labels[:-1]
    ends = lambda new: np.append(at[new][1:], len(at))[np.cumsum(new) - 1]
    first, end = ends(new_label), ends(new_token)
    upto = np.cumsum(end - first)
    start = 0
    while start < len(at):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + PAIRS_STEP, "right")))
        many = (end - first)[start:stop]
        left = np.repeat(at[start:stop], many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[start:stop], many)
        if len(left):
            yield owner[left], owner[right]
        start = stop


def star_pairs(token: np.ndarray, owner: np.ndarray, label: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each token and kind of owner: all its owners with the first by rank of those of the least label, where labels differ."""
    order = np.lexsort((rank[owner], label[owner], kind[owner], token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (kind[owner][1:] != kind[owner][:-1])
    head = owner[np.flatnonzero(new)][np.cumsum(new) - 1]
    apart = np.flatnonzero(label[head] != label[owner])
    for k in range(0, len(apart), PAIRS_STEP):
        part = apart[k : k + PAIRS_STEP]
        yield head[part], owner[part]


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least value but zero that both rows hold, row by row; zero if there is none."""
    held = (left[:, :, None] == right[:, None, :]).any(axis=2) & (left > 0)
    least = np.where(held, left, np.uint64(2**64 - 1)).min(axis=1)
    return np.where(held.any(axis=1), least, np.uint64(0))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of what its rows share."""
    pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pairs, np.bincount(place, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)


def shared_in_bucket(similarity: float, turn: int | None, buckets: int):
    """Counts, for one bucket, what pairs of classes of fitting sizes share: a, b, shared, least (what they must share in all); all pairs, or the stars of a turn, each of which has other heads.  A pair leaves a bucket once, however many shingles it shares there."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for classes, odds, tokens in zip(*(column_values(batch, k) for k in ("classes", "odds", "tokens"))):
                found.append((*unpack_arrays(classes, np.int64, np.int64, np.int32, np.int32), *unpack_arrays(odds, np.uint64), *unpack_arrays(tokens, np.uint32)))
        node, label, n, counts, odd, token = (np.concatenate(x) for x in zip(*found))
        del found
        odd, head = np.split(odd.reshape(len(node), -1), [CLASSES // 64], axis=1)
        owner = np.repeat(np.arange(len(node)), counts)
        n = n.astype(np.int64)
        likes = np.floor(np.log(n) / -np.log(similarity)).astype(np.int64)  # sizes of one kind fit each other
        rank = (node.view(np.uint64) ^ MIX[turn or 0]) * MIX[1]
        def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pairs, shared = summed(held)
            i, j = pairs // len(node), pairs % len(node)
            a, b, least = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), least_shared(n[i], n[j], similarity)
            for k in range(0, len(a), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (a, b, shared, least)], ["a", "b", "shared", "least"])

        held, size = [], 0
        for left, right in crossing_pairs(token, owner, label) if turn is None else star_pairs(token, owner, label, likes, rank):
            fits = np.minimum(n[left], n[right]) >= similarity * np.maximum(n[left], n[right]) - 1e-9
            pairs, shared = np.unique(np.minimum(left, right)[fits] * len(node) + np.maximum(left, right)[fits], return_counts=True)
            i, j = pairs // len(node), pairs % len(node)
            near = may_be_similar(n[i], n[j], odd[i], odd[j], similarity)
            pairs, i, j, shared = pairs[near], i[near], j[near], shared[near]
            both = first_shared(head[i], head[j])
            named = both > 0
            shared = np.where(named, least_shared(n[i], n[j], similarity), shared)
            here = ~named | (bucket_of(both, buckets) == key[0].as_py())
            held.append((pairs[here], shared[here]))
            size += int(here.sum())
            if size >= HELD_PAIRS:
                held = [summed(held)]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)

    return run


def likely(classes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the classes' wide parities do not rule out; so sets move only for those."""
    side = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"w_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("w_a", "w_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where(apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b")


def verified(spark: SparkSession, rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets are similar enough; only the texts of their classes are moved."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for _, texts, own in in_slabs(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(map(text_class, texts), pa.int64()), pa.array(own.parts(), pa.binary())], ["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            both = zip(column_values(batch, "x"), column_values(batch, "y"))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = checkpoint(spark, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    owners = classes.select("node", "least.k1", "least.k2").join(wanted, "node", "left_semi").select("k1", "k2")
    if wanted.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)  # at most BROADCAST_ROWS pairs of longs
    texts = rows.join(owners, ["k1", "k2"], "left_semi").select("_text")
    shingles = map_arrow(texts, "node long, shingles binary", sets, "similar").dropDuplicates(["node"])
    left = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    matched = left.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return checkpoint(spark, map_arrow(matched, "a long, b long", compare))


def simhash_pairs(classes: DataFrame, budget: int) -> DataFrame:
    """Pairs that tie all classes together whose fingerprints link: equal ones to a head, and the trie's links of heads."""
    own = classes.select("node", "fp")
    heads = own.groupBy("fp").agg(F.min("node").alias("head"))
    same = own.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = trie_links(heads.select("fp"), budget)
    tied = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return same.unionByName(tied.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_classes(docs: DataFrame, folder: str, size: int = SIZE, similarity: float = SIMILARITY, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (k1, k2, id, node), and the classes (node, least: the row of the least id, root: the component's node); both read tables written below `folder`."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered_rows(docs, id_col, text_col)
    last = common_shingles(rows, size, docs.count())
    marked(rows, size, similarity, last).write.parquet(f"{folder}/marked")
    marks = spark.read.parquet(f"{folder}/marked")
    row = F.struct(F.col("id").isNull().alias("null"), "id", "k1", "k2")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  the same for all rows of a class
    marks.groupBy("node").agg(F.min(row).alias("least"), first("n"), first("fp"), first("prefix"), first("odd"), first("wide")).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    links = verified(spark, rows, classes, checkpoint(spark, simhash_pairs(classes, budget)), size, similarity)
    release(spark)
    shared_prefixes(classes.select("node", "n", "prefix", "odd"), buckets_for(spark, classes)).write.parquet(f"{folder}/shared")
    release(spark)
    shared = spark.read.parquet(f"{folder}/shared")
    buckets = buckets_for(spark, shared)

    def more(links: DataFrame, turn: int | None) -> DataFrame:
        known = least_members(links).select("node", F.col("root").alias("label"))
        labelled = shared.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        dealt = dealt_prefixes(labelled, buckets).repartition(buckets, "bucket").groupBy("bucket")
        counted = dealt.applyInArrow(shared_in_bucket(similarity, turn, buckets), "a long, b long, shared long, least long")
        pairs = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")
        found = verified(spark, rows, classes, checkpoint(spark, likely(classes, pairs, similarity)), size, similarity)
        release(spark)
        return found

    few = STAR_LEAST * classes.count()
    for turn in range(STAR_ROUNDS):
        found = more(links, turn)
        links = links.unionByName(found)
        if found.count() <= few:
            break
    roots = least_members(links.unionByName(more(links, None)))
    tied = classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return marks.select("k1", "k2", "id", "node"), tied


def similar_groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and component_id (smallest id in reach; null if none has one) of each row."""
    spark = docs.sparkSession
    folder = stage_folder(spark)
    marks, classes = similar_classes(docs, folder, size, similarity, budget, id_col, text_col)
    heads = classes.groupBy("root").agg(F.min("least.id").alias("component_id"))
    groups = marks.join(classes.select("node", "root").join(heads, "root").select("node", "component_id"), "node").select(F.col("id").alias(id_col), "component_id")
    groups = checkpoint(spark, groups)
    remove_folder(spark, folder)
    return groups


def one_of_each(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of each group, with all its columns; of rows with that id and text one stays.  Texts move only if more rows stay than may be broadcast, or if they repeat."""
    spark = docs.sparkSession
    folder = stage_folder(spark)
    marks, classes = similar_classes(docs, folder, size, similarity, budget, id_col, text_col)
    keys = ["__k1", "__k2"]
    repeated = marks.groupBy("k1", "k2").count().where("count > 1").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.lit(True).alias("__repeated"))
    least = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k1").alias("__k1"), F.col("least.k2").alias("__k2"))
    kept = checkpoint(spark, least.join(repeated, keys, "left"))
    remove_folder(spark, folder)
    again = kept.where("__repeated").count()
    keyed = docs.withColumns({"__k1": F.xxhash64(F.col(id_col).cast("long"), text_bytes(text_col)), "__k2": F.xxhash64(text_bytes(text_col), F.col(id_col).cast("long"), F.lit(1))})

    def rows_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(*keys)
        return keyed.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, keys, "left_semi")

    single = rows_of(kept.where("__repeated is null")).select(*docs.columns)
    return single if not again else single.unionByName(rows_of(kept.where("__repeated")).dropDuplicates(keys).select(*docs.columns))
