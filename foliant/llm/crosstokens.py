"""Alignment of two tokenizers' tokens by byte offsets, over whole texts.

Tokens are arrays of ids and byte ends: the ends that both hold bound the groups, and each distinct end is one link, for
two cuts of one byte range overlap in as many pairs as they have distinct ends; the tokens at an end are found by binary
search.  All steps are linear in a text but for sorting ends, however long it or a group is.  Links are counted over all
documents by Spark's grouping and joins.

Texts are tokenised as pieces.  Pieces begin at a space after a character that is not white space: no merge of either
tokenizer crosses such a place (the vocabularies are asked), so a text's tokens are those of its pieces, and both
tokenizers end there.  A worker keeps the pieces that it has aligned, up to a bound, with their groups as text and their
links; a document is the groups and links of its pieces, one after another.

Defined cases: null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens: zeros
and an empty digest; rows are apart, whatever their ids; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from foliant.llm.common import column_values, map_arrow, remove_folder, slabs, stage_folder, worker_tables

CUT = re.compile(r"(?<=\S) (?!\Z)")
#: What texts hold where that is not every space.
UNCUT = re.compile(r"(?:\A|\s) | \Z")
SLAB, RUN = 1 << 20, 1 << 16
#: Aligned pieces and their bytes that a worker keeps; beyond either it begins anew.
KEPT_PIECES, KEPT_BYTES = 200_000, 8 << 20
#: Pairs that a broadcast may hold; beyond it only the frequent ones go that way, which are fewer by their threshold.
BROADCAST_PAIRS = 1 << 21


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A tokenizer of the `tokenizers` library whose entries are byte-level texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        table = byte_of_char()
        self.parts = {k: bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode() for entry, k in self.own.get_vocab().items()}
        self.cuttable = True  # its pattern takes a space only before what follows it

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.own.id_to_piece(k) for k in range(self.own.get_piece_size())]
        self.parts = {k: bytes([int(n[3:5], 16)]) if self.own.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)}
        self.cuttable = not any(re.search("[^▁]▁", n) for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


def load(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


class Tokens:
    """Both tokenizers over texts and pieces."""

    def __init__(self, paths: tuple[str, str]) -> None:
        self.two = [load(p) for p in paths]
        self.cuttable = all(t.cuttable for t in self.two)
        self.sizes = [np.array([len(t.parts.get(k, b"")) for k in range(1 + max(t.parts))], np.int32) for t in self.two]

    def whole(self, texts: list[str]) -> list[tuple[np.ndarray, ...] | None]:
        """(A's ids, A's lengths, B's ids, B's lengths) of each text; None where the tokens' bytes are not a space and the text."""
        sides = [t.encode(texts) for t in self.two]
        out = []
        for text, *ids in zip(texts, *sides):
            body, found = (" " + text).encode(), []
            for own, size, side in zip(self.two, self.sizes, ids):
                if b"".join(map(own.parts.__getitem__, side)) != body:
                    found = None
                    break
                numbers = np.array(side, np.int32)
                found += [numbers, size[numbers]]
            out.append(tuple(found) if found is not None and text else None)
        return out


class Aligned:
    """Pieces that have been aligned, by number: their tokens, groups as `a1,a2|b1;a3|b2;`, and links (A's id shifted by `bits`, and B's)."""

    def __init__(self, paths: tuple[str, str], bits: int) -> None:
        self.tokens, self.bits = Tokens(paths), bits
        ids = range(max(len(size) for size in self.tokens.sizes))
        self.shown = [f"{k}{mark}" for k in ids for mark in ",|;"]
        self.widths = np.array([len(x) for x in self.shown], np.int64)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.bytes, self.texts = {}, 0, []
        self.counts, self.links = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        self.fresh_counts, self.fresh_links = [], []

    def add(self, found: tuple[np.ndarray, ...], sizes: list[int]) -> int:
        """Align the tokens of pieces with these lengths in bytes, which follow each other; the number of the first."""
        a_ids, a_ends, b_ids, b_ends = found[0], np.cumsum(found[1]), found[2], np.cumsum(found[3])
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        new = np.append(True, both[1:] != both[:-1])
        ends, bounds = both[new], both[~new]
        self.fresh_links.append((a_ids[np.searchsorted(a_ends, ends)].astype(np.int64) << self.bits) | b_ids[np.searchsorted(b_ends, ends)])
        a_to, b_to = (np.concatenate([[0], np.searchsorted(own, bounds) + 1]) for own in (a_ends, b_ends))
        # of each group A's tokens, then B's: tokens of the other before it move a token on
        codes = np.empty(a_to[-1] + b_to[-1], np.int64)
        a_code, b_code = 3 * a_ids.astype(np.int64), 3 * b_ids.astype(np.int64)
        a_code[a_to[1:] - 1] += 1
        b_code[b_to[1:] - 1] += 2
        codes[np.arange(len(a_ids)) + np.repeat(b_to[:-1], np.diff(a_to))] = a_code
        codes[np.arange(len(b_ids)) + np.repeat(a_to[1:], np.diff(b_to))] = b_code
        text = "".join(map(self.shown.__getitem__, codes.tolist()))
        piece_ends = np.cumsum(sizes)
        g_to, l_to = np.searchsorted(bounds, piece_ends) + 1, np.searchsorted(ends, piece_ends) + 1
        upto = np.column_stack([a_to[g_to], b_to[g_to], g_to, l_to])
        self.fresh_counts.append(np.diff(upto, axis=0, prepend=0))
        places = np.cumsum(self.widths[codes])[a_to[g_to] + b_to[g_to] - 1].tolist()
        first = len(self.texts)
        self.texts += [text[x:y] for x, y in zip([0, *places], places)]
        self.bytes += int(piece_ends[-1])
        return first

    def rows(self, texts: list[str]) -> list[list[int]]:
        """Every text as the numbers of its pieces; none without tokens."""
        if len(self.texts) > KEPT_PIECES or self.bytes > KEPT_BYTES:
            self.forget()
        whole, numbers = self.tokens.whole, self.numbers
        cuttable = self.tokens.cuttable
        cut = [((CUT.split(t) if UNCUT.search(t) else t.split(" ")) if cuttable else [t]) if t else [] for t in texts]
        distinct = [p for p in dict.fromkeys(p for own in cut for p in own) if p not in numbers]
        # pieces are cut where no merge crosses, so those joined by spaces keep their tokens, but for the last of a text that ends in white space
        alone = [p for p in distinct if not cuttable or p[-1].isspace()]
        listed = [p for p in distinct if cuttable and not p[-1].isspace()]
        coded = [p.encode() for p in listed]
        joined = [(listed[start:end], [len(p) + 1 for p in coded[start:end]]) for start, end in slabs(coded, RUN)]
        for run, sizes in [*joined, *(([p], [len(p.encode()) + 1]) for p in alone)]:
            found = whole([" ".join(run)])[0] if len(run) > 1 else None
            if found:
                first = self.add(found, sizes)
                numbers.update(zip(run, range(first, first + len(run))))
                continue
            for piece, size, own in zip(run, sizes, whole(run)):
                numbers[piece] = self.add(own, [size]) if own else -1
        out = []
        for text, own in zip(texts, cut):
            row = [numbers[p] for p in own]
            if -1 in row:  # a piece whose bytes differ settles nothing about the text: then the whole text is encoded
                found = whole([text])[0] if len(row) > 1 else None
                row = [self.add(found, [len(text.encode()) + 1])] if found else []
            out.append(row)
        self.counts, self.links = np.concatenate([self.counts, *self.fresh_counts]), np.concatenate([self.links, *self.fresh_links])
        self.fresh_counts, self.fresh_links = [], []
        return out

    def documents(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, list[str]]:
        """Of each text the distinct links, how often each is there, (n_a, n_b, n_groups, n_links), and the digest of its groups."""
        rows = self.rows(texts)
        link_ends = np.cumsum(self.counts[:, 3])
        pairs, times, counts, digests = [], [], np.zeros((len(texts), 4), np.int64), []
        for k, row in enumerate(rows):
            own = np.array(row, np.int64)
            sizes = self.counts[own]
            counts[k] = sizes.sum(axis=0)
            many = sizes[:, 3]
            place = np.arange(counts[k, 3]) + np.repeat(link_ends[own] - np.cumsum(many), many)
            found, often = np.unique(self.links[place], return_counts=True)
            pairs.append(found)
            times.append(often)
            digests.append(hashlib.sha256("".join(map(self.texts.__getitem__, row))[:-1].encode()).hexdigest() if row else "")
        return pairs, times, counts, digests


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *rows]), pa.int64()).cast(kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, bits: int, wide: bool = False, slab: int = SLAB) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, `pairs` (its distinct links as numbers) and `times` (how often each is there)."""
    number = LongType() if wide else IntegerType()
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, LongType()) for c in counts), StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(number)), StructField("times", ArrayType(IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tables = worker_tables("alignment")
        ids, texts, size, kind = [], [], 0, pa.int64()

        def out() -> pa.RecordBatch:
            known = tables.get((a_path, b_path)) or tables.setdefault((a_path, b_path), Aligned((a_path, b_path), bits))
            pairs, times, many, digests = known.documents(texts)
            arrays = [pa.array(ids, kind), *(pa.array(many[:, k]) for k in range(4)), pa.array(digests, pa.string()), lists(pairs, pa.int64() if wide else pa.int32()), lists(times, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(column_values(batch, "doc_id"), column_values(batch, "text")):
                ids.append(doc)
                texts.append(text or "")
                size += len(texts[-1]) + 100
                if size > slab:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return map_arrow(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), StructType(fields), run, keeps="alignment")


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer, from its file alone."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        return 1 + max([*found["model"]["vocab"].values(), *(t["id"] for t in found.get("added_tokens", []))])
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def counted_pairs(documents: DataFrame, bits: int) -> DataFrame:
    """pair, count (documents that hold it linked), best (its count is the highest of its A id); a pair is A's id shifted by `bits`, and B's."""
    counts = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    of_a = Window.partitionBy(F.shiftright("pair", bits))  # at most B's vocabulary
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Documents' links are written once as numbers; the counts of pairs meet them by a broadcast while at most
    `broadcast_pairs` pairs exist.  Beyond that pairs in more documents than a `broadcast_pairs`-th of all
    (document, pair) rows, hence fewer than `broadcast_pairs`, are broadcast, and the rest joins by a shuffle in which no
    key has more rows than that share allows.
    """
    spark = docs.sparkSession
    bits = (vocabulary_size(b_path) - 1).bit_length()
    wide = vocabulary_size(a_path) << bits > 1 << 31
    folder = stage_folder(spark)
    lean = aligned(docs, a_path, b_path, bits, wide)
    lean.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    counted_pairs(documents, bits).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    held, total = pairs.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    links = documents.select("row", "times", F.posexplode("pairs").alias("place", "pair")).select("row", "pair", F.get("times", F.col("place")).cast("long").alias("times"))
    if held <= broadcast_pairs:
        met = links.join(F.broadcast(pairs), "pair")
    else:
        often = F.col("count") * broadcast_pairs > total
        known = links.join(F.broadcast(pairs.where(often)), "pair", "left")
        rest = known.where("count IS NULL").select("row", "pair", "times").join(pairs.where(~often), "pair")
        met = known.where("count IS NOT NULL").select("row", "count", "best", "times").unionByName(rest.select("row", "count", "best", "times"))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    result = f"{folder}-alignment"
    documents.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256").write.parquet(result)
    remove_folder(spark, folder)
    return spark.read.parquet(result)
