"""SimHash near-duplicate groups by a self-join of binary tries.

Fingerprints of the texts are made distinct first, so copies cost one row.  A pair within the
error budget has at most half of it in one half of the bits, so two joins suffice: one over the
fingerprints as they are, with budget // 2 errors at most in the first half, one over them with
their halves swapped, with the rest.  Each join deals the trie's upper levels out: a fingerprint
goes to each pair of upper nodes within that budget, and one task walks the two lower tries
together, adds up differing bits, and leaves a pair of nodes when its errors exceed the budget.
Node pairs whose leaves already are in one component are left too: so a dense group costs no
walk over all its pairs, and what a task returns is at most one link for each fingerprint.

Cases: a null text counts as empty; a text without words has fingerprint zero, linked like any
other; repeated rows are in one component; a component's number is its smallest id, null if none of its rows
has one; a bit that is set in just half of the hashes is 0; an empty table gives no rows; other columns,
whatever their names, are not looked at; texts of any length are read in whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import checkpoint, column_values, map_arrow, text_bytes
from foliant.llm.components import least_members, united

BITS = 64
SEED = 42
BUDGET = 4
SHINGLE = 4
NODES_EACH = 16_384
LEAST_DEPTH, MOST_DEPTH = 6, 20
LEAF = 4
STEP = 1 << 16

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    set_in = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 65_536):
        part = hashes[first : first + 65_536]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint_of(shingle_hashes(text, size, seed))


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the fingerprint (fp, a signed long of the same bits) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size, seed) for t in column_values(batch, "_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), text_bytes(text_col).alias("_text")), f"{id_col} long, fp long", run)


class Trie:
    """A binary trie over sorted distinct fingerprints; a node is a range of them."""

    def __init__(self, values: np.ndarray, roots: list[tuple[int, int]]) -> None:
        self.values = values
        low, high, children, masks = [], [], [], []
        level = np.array(roots, np.int64).reshape(-1, 2)
        base = 0
        while len(level):
            a, b = level[:, 0], level[:, 1]
            apart = values[a] ^ values[b - 1]
            top = np.zeros(len(level), np.uint64)  # the highest bit in which members differ, as a mask of it and all below
            top[:] = apart
            for shift in (1, 2, 4, 8, 16, 32):
                top |= top >> np.uint64(shift)
            inner = b - a > LEAF
            split = np.searchsorted(values, values[b - 1] & ~(top >> np.uint64(1)))
            child = np.full(len(level), -1, np.int64)
            child[inner] = base + len(level) + 2 * np.arange(inner.sum())
            low.append(a), high.append(b), children.append(child), masks.append(~top)
            base += len(level)
            level = np.stack([np.stack([a[inner], split[inner]], 1), np.stack([split[inner], b[inner]], 1)], 1).reshape(-1, 2)
        self.low, self.high, self.child, self.mask = map(np.concatenate, (low, high, children, masks))


def linked(values: np.ndarray, roots: list[tuple[int, int]], budget: int, half_budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The component label (least position) of each value, by links between the two roots' values, or within the only root's; and links that span the components."""
    trie, label = Trie(values, roots), np.arange(len(values))
    change = np.arange(len(values))  # counts the label changes up to each position: equal at both ends of a node, its leaves are in one component
    low, high, child, mask = trie.low, trie.high, trie.child, trie.mask
    half, links = np.uint64(32), [np.empty((0, 2), np.int64)]
    stack = [np.array([[0, len(roots) - 1]], np.int64)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > STEP:
            stack.append(pairs[STEP:])
            pairs = pairs[:STEP]
        u, v = pairs[:, 0], pairs[:, 1]
        differ = (values[low[u]] ^ values[low[v]]) & mask[u] & mask[v]
        keep = (np.bitwise_count(differ) <= budget) & (np.bitwise_count(differ >> half) <= half_budget)
        keep &= ~((label[low[u]] == label[low[v]]) & (change[high[u] - 1] == change[low[u]]) & (change[high[v] - 1] == change[low[v]]))
        u, v = u[keep], v[keep]
        ends = (child[u] < 0) & (child[v] < 0)
        if ends.any():
            i = (low[u[ends], None] + np.arange(LEAF))[:, :, None]
            j = (low[v[ends], None] + np.arange(LEAF))[:, None, :]
            inside = (i < high[u[ends], None, None]) & (j < high[v[ends], None, None]) & (i != j)
            i, j = np.broadcast_to(i, inside.shape)[inside], np.broadcast_to(j, inside.shape)[inside]
            differ = values[i] ^ values[j]
            near = (np.bitwise_count(differ) <= budget) & (label[i] != label[j])
            if near.any():
                label, used = united(label, i[near], j[near])
                links.append(used)
                change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
            u, v = u[~ends], v[~ends]
        if len(u):
            same = u == v
            first = (child[v] < 0) | ((child[u] >= 0) & (high[u] - low[u] >= high[v] - low[v]))
            parts = [
                np.stack([child[u[same]], child[u[same]]], 1),
                np.stack([child[u[same]] + 1, child[u[same]] + 1], 1),
                np.stack([child[u[same]], child[u[same]] + 1], 1),
            ]
            for side in (0, 1):
                parts.append(np.stack([child[u[~same & first]] + side, v[~same & first]], 1))
                parts.append(np.stack([u[~same & ~first], child[v[~same & ~first]] + side], 1))
            stack.append(np.concatenate(parts))
    return label, np.concatenate(links)


def neighbour_masks(depth: int, errors: int) -> list[int]:
    """All masks of `depth` bits with at most `errors` ones."""
    return [sum(1 << b for b in bits) for n in range(errors + 1) for bits in combinations(range(depth), n)]


def swapped(fp: Column) -> Column:
    """The fingerprint with its halves exchanged."""
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def trie_links(distinct: DataFrame, budget: int = BUDGET, nodes_each: int = NODES_EACH, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """Links (a, b) that tie all distinct fingerprints (fp) of a component together: pairs within the budget, fewer than the fingerprints of a task."""
    size = distinct.count()
    depth = min(MOST_DEPTH, max(least_depth, math.ceil(math.log2(max(1, size / nodes_each)))))

    def dealt(turned: Column, errors: int, turn: int) -> DataFrame:
        prefix = F.shiftrightunsigned(turned, BITS - depth).cast("int")
        masks = F.array(*[F.lit(m) for m in neighbour_masks(depth, errors)])
        near = distinct.select(turned.alias("fp"), prefix.alias("p"), F.explode(masks).alias("m"))
        other = F.col("p").bitwiseXOR(F.col("m"))
        return near.select("fp", F.least("p", other).alias("p1"), F.greatest("p", other).alias("p2"), F.lit(turn).alias("turn"))

    first_half = budget // 2
    rest = budget - first_half - 1
    rows = dealt(F.col("fp"), first_half, 0)
    if rest >= 0:
        rows = rows.unionByName(dealt(swapped(F.col("fp")), rest, 1))

    def walk(key: tuple, group: pa.Table) -> pa.Table:
        p1, p2, turn = (k.as_py() for k in key)
        values = np.unique(group.column("fp").to_numpy().view(np.uint64))
        cut = len(values) if p1 == p2 else int(np.searchsorted(values, np.uint64(p2 << (BITS - depth))))
        a = b = np.empty(0, np.uint64)
        if p1 == p2 or 0 < cut < len(values):
            roots = [(0, cut)] if p1 == p2 else [(0, cut), (cut, len(values))]
            _, links = linked(values, roots, budget, first_half if turn == 0 else rest)
            a, b = values[links[:, 0]], values[links[:, 1]]
            if turn:
                a, b = ((x << np.uint64(32)) | (x >> np.uint64(32)) for x in (a, b))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("p1", "p2", "turn").applyInArrow(walk, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, fingerprint (16 hexadecimal digits) and component_id (smallest id in reach) of each document."""
    spark = docs.sparkSession
    marked = checkpoint(spark, fingerprints(docs, size, seed, id_col, text_col))
    least = checkpoint(spark, marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = least_members(trie_links(least.select("fp"), budget))
    tied = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = tied.join(heads, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
