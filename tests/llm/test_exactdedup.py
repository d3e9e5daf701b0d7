"""Exact copies against a plain grouping, with split buckets, pages and hash collisions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from foliant.llm.exactdedup import exact_copies, grow_directory

SCHEMA = "doc_id long, text string, entry int, key string"


def plain(rows):
    groups, out = {}, []
    for i, (doc, text, *_) in enumerate(rows):
        body = (text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, i, doc))
    for body, group in groups.items():
        best = min(group)
        for row in group:
            out.append((row[4], best[4], len(group), hashlib.sha256(body.encode()).hexdigest()))
    return out, sum(1 for _ in groups)


def check(spark, rows, parts, **how):
    got = exact_copies(spark.createDataFrame(rows, SCHEMA).repartition(parts), **how).collect()
    want, groups = plain(rows)
    order = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=order) == sorted(want, key=order)
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def odd_rows():
    rows = [(None, None), (1, ""), (2, " \t\n\x0b\f\r"), (3, "a b"), (4, "ab"), (5, "a  b"), (5, "a  b"), (None, "ab "), (6, " ab"), (7, "x" * 20_000), (8, "x" * 10_000 + " " + "x" * 10_000), (None, "zz"), (None, "zz")]
    rows += [(100 + i, f"copy {i % 3}" + " " * (i % 5)) for i in range(300)]
    rows += [(1000 + i, "hot text") for i in range(400)] + [(2000 + i, f"unlike {i}") for i in range(300)]
    return [(*r, 1, "k") for r in rows]


def test_equals_plain_grouping(spark):
    check(spark, odd_rows(), 6)


def test_small_buckets_split_and_pages_chain(spark):
    check(spark, odd_rows(), 7, bucket_bytes=3_000)


def test_colliding_keys_compare_bytes(spark):
    check(spark, odd_rows(), 3, bucket_bytes=3_000, key=lambda c: F.pmod(F.xxhash64(c), F.lit(5)))


def test_empty_table(spark):
    assert exact_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_directory_covers_every_pattern():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 1 << 10, 300))
    sizes = rng.integers(1, 50, len(cells))
    sizes[7] = 5_000
    single = np.ones(len(cells), bool)
    found = grow_directory(cells, sizes, single, 400, deepest=10)
    bucket = found.slots[cells >> (10 - found.depth)]
    for b in np.unique(bucket):
        held = sizes[bucket == b].sum()
        assert held <= 400 or (found.pages[int(b)] == -(-held // 400) and (bucket == b).sum() == 1)
    assert grow_directory(cells, sizes, single, 1 << 40, deepest=10).depth == 0
