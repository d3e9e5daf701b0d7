"""Hierarchical residual packing of documents into token sequences.

Each partition packs its own items by best fit, largest first.  Bins that are nearly full are
emitted; the underfull ones go one level up as items, where the bins of several partitions meet
and are packed again, until the tree is at its root.  A bin holds at most as many members as it
has tokens, so a row is bounded.  A task takes at most `items_each` underfull bins: the top level
keeps as many partitions as that needs, so no task grows with the corpus.  Each level is
checkpointed, which also makes the bins stable if executors are lost.

Token ids come from a vocabulary of the `tokenizers` library.  A text's words are looked up in a
table of the words met so far, and unknown words go to the library's model, since the library's own
splitting rule makes the encoding of a text the sequence of its words' encodings.

Cases: a null text counts as empty and has the closing id alone; a document longer than the
capacity is cut into full pieces and a last one, and no other is cut; repeated rows are packed
each for itself; of equal items the one met first goes first; a null id stays null; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, column_values, map_arrow, worker_tables
from foliant.llm.token_transducer import byte_symbols

CAPACITY = 2048
SLACK = 8
FAN_IN = 8
ITEMS_EACH = 500_000
WORDS_KEPT = 350_000
RUNS_KEPT = 450_000
END_ID = 0

#: White space as the vocabulary's splitting rule has it.
WHITE = r"\t-\r \x85\xa0  -     　"
PLAIN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")

MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"


class Known(dict):
    """A table that makes what it lacks."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Encodes texts to little-endian 32-bit ids for a lower-casing word vocabulary.

    No word of the splitting rule holds white space, so the ids of a text are those of its runs
    without white space in turn; runs and words are kept in two tables of bounded size.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.symbols = self.library.model, {b: s for s, b in byte_symbols().items()}
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        self.specials = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in added}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if added else None
        self.words = Known(lambda word: array("I", self.encode_word(word)).tobytes())
        self.runs = Known(self.encode_run)
        self.word = self.word_pattern()
        self.run = regex.compile(f"[^{WHITE}]+")

    def word_pattern(self) -> regex.Pattern:
        """The splitting rule.  `regex` may know letters and numbers that are newer than the library; the library is asked about them."""
        points = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
        ask = self.library.pre_tokenizer.pre_tokenize_str
        doubtful = [c for c in regex.findall(r"[\p{L}\p{N}]", points) if unicodedata.category(c)[0] not in "LN"]
        others = "".join(c for c in doubtful if len(ask("!" + c)) == 1) or "!"
        self.plain_below = min(doubtful, default="!")
        return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{others}]]+|[\p{{N}}--[{others}]]|(?:[^{WHITE}\p{{L}}\p{{N}}]|[{others}])+")

    def split_run(self, run: str) -> list[str]:
        """The words of a run without white space."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
        run = run.lower()
        if run.isascii() or max(run) < self.plain_below:
            if run.isalpha():
                return [run]
            if run[:-1].isalpha() and not run[-1].isalpha() and run[-1].isascii():
                return [run[:-1], run[-1]]
            return PLAIN.findall(run)
        return self.word.findall(run)

    def encode_word(self, word: str) -> list[int]:
        """The ids of a word: by the library's merges alone, or with its normaliser where a newer Unicode might matter."""
        if word and max(word) >= self.plain_below:
            return self.library.encode(word, add_special_tokens=False).ids
        symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
        return [t.id for t in self.model.tokenize(symbols)]

    def encode_run(self, run: str) -> bytes:
        """The ids of a run without white space."""
        return b"".join([self.words[w] for w in self.split_run(run)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        out: list[bytes] = []
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")  # white space to Python, not to the rule
            runs = self.run.findall(part) if odd else part.split()
            for first in range(0, len(runs), 100_000):
                for known, most in ((self.runs, RUNS_KEPT), (self.words, WORDS_KEPT)):
                    if len(known) > most:
                        known.clear()
                out += map(self.runs.__getitem__, runs[first : first + 100_000])
        return b"".join(out)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kept, end = worker_tables("packing"), END_ID.to_bytes(4, "little")
        encoder = kept[vocabulary] = kept.get(vocabulary) or WordEncoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(column_values(batch, id_col), column_values(batch, "_text")):
                ids = encoder.encode(text) + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [id_col, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return map_arrow(rows, f"{id_col} long, piece int, start long, length long, ids_crc32 long", run, "packing")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes to the open bin with the least room that holds it, the largest items first."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: there is a bin with room r
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fitting = rooms >> size << size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, len(bins)
            bins.append([])
        bins[own].append(item)
        room -= size
        by_room[room].append(own)
        rooms |= 1 << room
    return bins


def pack_level(items: DataFrame, capacity: int, slack: int) -> DataFrame:
    """Pack the items of each partition; `full` tells the bins that leave the tree."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sizes: list[int] = []
        members: list[list[dict]] = []
        for batch in batches:
            sizes += column_values(batch, "size")
            members += column_values(batch, "members")
        bins = best_fit(sizes, capacity)
        for first in range(0, len(bins), 10_000):
            columns: list[list[int]] = [[] for _ in names]
            ends, fills = [0], []
            for own in bins[first : first + 10_000]:
                base = 0
                for item in own:
                    for m in members[item]:
                        for column, name in zip(columns[:-1], names):
                            column.append(m[name])
                        columns[-1].append(base + m["offset"])
                    base += sizes[item]
                fills.append(base)
                ends.append(len(columns[0]))
            values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(fills, pa.int64()), pa.array([f >= capacity - slack for f in fills])], ["members", "size", "full"])

    return map_arrow(items.select("members", "size"), f"members array<{MEMBER}>, size long, full boolean", run)


def pack(parts: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, items_each: int = ITEMS_EACH) -> DataFrame:
    """Assign pieces (doc_id, piece, start, length, ids_crc32) to sequences: adds sequence_id and offset."""
    spark = parts.sparkSession
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    level = checkpoint(spark, pack_level(parts.select(F.array(member).alias("members"), F.col("length").alias("size")), capacity, slack))
    done, before = [], None
    while True:
        width = level.rdd.getNumPartitions()
        left = level.where(~F.col("full")).count()
        most = max(1, -(-left // items_each))
        narrower = max(most, -(-width // fan_in))
        if left == 0 or width == 1 or (narrower >= width and before is not None and left > 0.99 * before):
            done.append(level)
            break
        done.append(level.where("full"))
        level = checkpoint(spark, pack_level(level.where(~F.col("full")).coalesce(narrower), capacity, slack))
        before = left
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    return bins.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack documents into sequences of at most `capacity` tokens."""
    return pack(pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocabulary, capacity), capacity)
