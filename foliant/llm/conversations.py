"""Repair of conversations by cheapest edits: Dial's bucket queue over the graph of (row, state of the role pattern).

States are those of `(s?(ua)+)?`: nothing yet, after system, after user, after assistant.  Costs are at most 3, so
distances to the end are settled from an array of buckets; the audit then follows tight arcs from the start, the least
letter first.  Only one role letter leads on from each state, so an audit so far fixes the state.  Rows that have to go
(blank or repeated) change no state and sort before any insertion: they are counted, not searched.

A conversation is one task's work unless it holds more than `heavy_rows` rows and more than a 100,000th of all.  Such a
one is cut by ranges of turns into blocks of `block_rows`: each gives the distances between its states, the blocks are
composed backwards for the distances to the end and forwards for the states they begin in, and are walked apart.  Its
digest alone is read in order, a block at a time.

Defined cases: rows are ordered by turn, nulls first, then role and text; a null role or text is one space; a null
conv_id is a conversation; a role that begins with none of s, u, a can only be given another role or go; repeated rows
count as often as they occur; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.llm.common import column_values, map_arrow, partitions_for, remove_folder, small_batches, stage_folder

SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOW = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept row leads to, by the code of its role's first letter (0: none of them) and the state before.
KEEP = ((None, None, None, None), (SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None))
BEFORE = tuple(tuple(p for p in range(4) if FOLLOW[p] == q) for q in range(4))
KEPT_FROM = tuple(tuple(tuple(p for p in range(4) if KEEP[code][p] == q) for q in range(4)) for code in range(4))
LEGAL = {(1, 2), (2, 3), (3, 2)}
INSERT, REROLE, DELETE, FAR = 2, 2, 3, 1 << 60
FORCED, LIVE, TRUNCATED = range(3)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage, and copies: 0 of a dropped row, 2 of a repeated one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def distances(codes: list[int], cut: list[int], ends: list[int], source: int | None = None) -> list[int]:
    """Costs from every node (row, state), numbered 4 * row + state, to the end whose states cost `ends`; up to the source if one is given."""
    n, least = len(codes), min(ends)
    dist, done, buckets = [FAR] * (4 * n + 4), bytearray(4 * n + 4), []

    def put(node: int, cost: int) -> None:
        if cost < dist[node]:
            dist[node] = cost
            while len(buckets) <= cost - least:
                buckets.append([])
            buckets[cost - least].append(node)

    for state, cost in enumerate(ends):
        if cost < FAR:
            put(4 * n + state, cost)
    level = 0
    while level < len(buckets):
        bucket = buckets[level]  # grows while it is read, by arcs that cost nothing
        for node in bucket:
            if done[node]:
                continue
            done[node] = 1
            if node == source:
                return dist
            cost, row, state = level + least, node >> 2, node & 3
            for p in BEFORE[state]:
                put(node - state + p, cost + INSERT)
            if row:
                at, more = 4 * row - 4, cut[row - 1]
                put(at + state, cost + DELETE)
                for p in KEPT_FROM[codes[row - 1]][state]:
                    put(at + p, cost + more)
                for p in BEFORE[state]:
                    put(at + p, cost + REROLE + more)
        buckets[level] = None
        level += 1
    return dist


def walk(codes: list[int], cut: list[int], lead: list[int], dist: list[int], state: int, last: bool) -> tuple[str, list[tuple[str, int, int]], int]:
    """The least audit along tight arcs from a state, its edits (letter, row or -1, state after) and the state at the end.

    `lead` counts the forced deletions before each row and after the last.  Only the last block inserts at its end.
    """
    n, row, audit, edits = len(codes), 0, ["D" * lead[0]], []
    while row < n or last:
        here = dist[4 * row + state]
        if row < n and here == DELETE + dist[4 * row + 4 + state]:
            letter, after, on = "D", state, 1
        elif (row < n or here > 0) and here == INSERT + dist[4 * row + FOLLOW[state]]:
            letter, after, on = "I", FOLLOW[state], 0
        elif row == n:
            break
        elif (kept := KEEP[codes[row]][state]) is not None and here == cut[row] + dist[4 * row + 4 + kept]:
            letter, after, on = "K", kept, 1
        else:
            letter, after, on = "R", FOLLOW[state], 1
        edits.append((letter, row if on else -1, after))
        state, row = after, row + on
        audit.append(letter + "D" * lead[row] if on else letter)
    return "".join(audit), edits, state


def repaired(edits: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> list[str]:
    """The rows `role:text` that edits leave."""
    return [f"{roles[row]}:{texts[row]}" if letter == "K" else f"{NAMES[after]}:{texts[row] if row >= 0 else ''}" for letter, row, after in edits if letter != "D"]


def searched(kinds: list[int], codes: list[int], times: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Positions, codes and truncation of the rows that may stay, and the forced deletions before each and after the last.

    A row that stays and occurs more than once is followed by its repetitions, which go.
    """
    live, lead, waiting = [], [], 0
    for k, (kind, many) in enumerate(zip(kinds, times)):
        if kind == FORCED:
            waiting += many
        else:
            live.append(k)
            lead.append(waiting)
            waiting = many - 1
    return live, [codes[k] for k in live], [int(kinds[k] == TRUNCATED) for k in live], [*lead, waiting]


def code_of(role: str) -> int:
    return {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)


def facts(turns: list, kinds: list[int], codes: list[int], times: list[int], blank: list[bool]) -> dict:
    """Counts of faults, illegal neighbours and turns of rows in order, each occurring so many times."""
    known = [t for t in turns if t is not None]
    return {
        "blank": sum(m for b, m in zip(blank, times) if b),
        "duplicate": sum(m if k == FORCED else m - 1 for k, b, m in zip(kinds, blank, times) if not b),
        "truncated": sum(k == TRUNCATED for k in kinds),
        "illegal": sum((a, b) not in LEGAL for a, b in zip(codes, codes[1:])) + sum(m - 1 for m in times),
        "first_code": codes[0] if codes else -1, "last_code": codes[-1] if codes else -1,
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
    }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _one(rows: list[tuple]) -> tuple:
    """gaps, the counts, cost, audit and repaired text of a whole conversation of (turn, role, text, copies)."""
    rows = [r for r in rows if r[3]]
    turns, roles, texts, times = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
    seen, kinds, blank = set(), [], []
    for role, text in zip(roles, texts):
        ending = text.rstrip(SPACES)
        blank.append(not ending)
        kinds.append(FORCED if not ending or (role, text) in seen else LIVE if ending[-1] in ENDS else TRUNCATED)
        seen.add((role, text))
    codes = [code_of(r) for r in roles]
    found = facts(turns, kinds, codes, times, blank)
    live, live_codes, cut, lead = searched(kinds, codes, times)
    dist = distances(live_codes, cut, [0, FAR, FAR, 0], source=START)
    audit, edits, _ = walk(live_codes, cut, lead, dist, START, True)
    text = "\n".join(repaired(edits, [roles[k] for k in live], [texts[k] for k in live]))
    return (_gaps(found["first_turn"], found["last_turn"], found["turns"]), *(found[c] for c in COUNTS), dist[START] + DELETE * sum(lead), audit, text)


def _ordered(df: DataFrame, *first: str) -> list[Column]:
    return [*(F.col(c).asc_nulls_first() for c in first), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def repaired_texts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts, cost, audit and the repaired text of every conversation, each in one task."""
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(RESULT + ", repaired string").fields])
    dealt = rows.select("conv_id", "turn", "role", "text", "copies").repartition(partitions_for(rows.sparkSession, rows, 64 << 20), "conv_id").sortWithinPartitions(*_ordered(rows, "conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        types = [pa.int64()] * 7 + [pa.string()] * 2

        def stream() -> Iterator[tuple]:
            for batch in batches:
                types[0] = batch.schema.field("conv_id").type
                yield from zip(*(column_values(batch, c) for c in ("conv_id", "turn", "role", "text", "copies")))

        done, size = [], 0
        for conv, members in groupby(stream(), key=lambda r: r[0]):
            found = _one([m[1:] for m in members])
            done.append((conv, *found))
            size += len(found[-1]) + 100
            if size > 1 << 20:
                yield _table(done, types, schema.names)
                done, size = [], 0
        if done:
            yield _table(done, types, schema.names)

    return map_arrow(dealt, schema, run)


def _grouped(df: DataFrame, keys: list[str], fn, schema: StructType) -> DataFrame:
    """applyInArrow with a function that yields the result rows of a group's table."""
    small_batches(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        found = list(fn(table))
        types = [table.schema.field("conv_id").type if f.name == "conv_id" else _arrow(f.dataType.simpleString()) for f in schema]
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=schema.names)

    return df.groupBy(*keys).applyInArrow(run, schema)


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}[name]


def _in_order(table: pa.Table, by: str, *names: str) -> list[list]:
    table = table.sort_by(by)
    return [table.column(c).to_pylist() for c in names]


def _block_rows(rows: DataFrame, folder: str, block_rows: int) -> DataFrame:
    """Rows of heavy conversations in order, equal ones as one with its count, with what judges them, in written blocks."""
    spark = rows.sparkSession
    runs = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("times")).withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    first = runs.groupBy("conv_id", "same").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("__conv"), F.col("same").alias("__same"), F.col("first.turn").alias("__turn"))
    fresh = runs.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("same") == F.col("__same")) & F.col("turn").eqNullSafe(F.col("__turn")), "left").withColumn("fresh", F.col("__same").isNotNull())
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    judged = fresh.select(
        "conv_id", "turn", "role", "text", "times", (shown == "").alias("blank"), F.when((shown == "") | ~F.col("fresh"), FORCED).when(F.substring(shown, -1, 1).isin(*ENDS), LIVE).otherwise(TRUNCATED).alias("kind"),
        F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0).alias("code"),
    )
    tasks = partitions_for(spark, rows, 64 << 20)
    dealt = judged.repartitionByRange(tasks, *_ordered(judged, "conv_id")).sortWithinPartitions(*_ordered(judged, "conv_id"))
    schema = StructType([*dealt.schema.fields, *StructType.fromDDL("block long, at long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        block, at, before = TaskContext.get().partitionId() << 32, 0, ()
        for batch in batches:
            blocks, places = [], []
            for conv in column_values(batch, "conv_id"):
                if before and (before[0] != conv or at == block_rows):
                    block, at = block + 1, 0
                blocks.append(block)
                places.append(at)
                before, at = (conv,), at + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names=schema.names)

    map_arrow(dealt, schema, run).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


def _heavy(rows: DataFrame, folder: str, block_rows: int) -> DataFrame:
    """The result rows of heavy conversations, with the digest instead of the repaired text."""
    spark = rows.sparkSession
    lined = _block_rows(rows, folder, block_rows)
    conv = lined.schema["conv_id"]
    fields = lambda ddl: StructType([conv, *StructType.fromDDL(ddl).fields])
    counted = ", ".join(f"{c} long" for c in COUNTS)
    ends = "first_code long, last_code long, first_turn long, last_turn long, turns long"
    judged = lined.select("conv_id", "block", "at", "turn", "times", "blank", "kind", "code")

    def summary(table: pa.Table) -> Iterator[tuple]:
        turns, times, blank, kinds, codes = _in_order(table, "at", "turn", "times", "blank", "kind", "code")
        found = facts(turns, kinds, codes, times, blank)
        _, live, cut, lead = searched(kinds, codes, times)
        costs = []
        for end in range(4):
            dist = distances(live, cut, [0 if q == end else FAR for q in range(4)])
            costs += [d + DELETE * sum(lead) if d < FAR else FAR for d in dist[:4]]
        yield (table["conv_id"][0].as_py(), table["block"][0].as_py(), costs, *found.values())

    _grouped(judged, ["conv_id", "block"], summary, fields(f"block long, costs array<long>, {counted}, {ends}")).write.parquet(f"{folder}/summaries")

    def backwards(table: pa.Table) -> Iterator[tuple]:
        blocks, costs, first_codes, last_codes, first_turns, last_turns, turns, *counts = _in_order(table, "block", "block", "costs", "first_code", "last_code", "first_turn", "last_turn", "turns", *COUNTS)
        totals = dict(zip(COUNTS, (sum(c) for c in counts)))
        totals["illegal"] += sum((a, b) not in LEGAL for a, b in zip(last_codes, first_codes[1:]))
        known = [(a, b) for a, b in zip(first_turns, last_turns) if a is not None]
        distinct = sum(turns) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
        gaps = _gaps(known[0][0], known[-1][1], distinct) if known else 0
        to_end, after = [0, FAR, INSERT, 0], []  # insertions at the end included
        to_end[SYSTEM] = 2 * INSERT
        for cost in reversed(costs):
            after.append(to_end)
            to_end = [min(min(FAR, cost[4 * q + p] + to_end[q]) for q in range(4)) for p in range(4)]
        whole = to_end[START]
        for k, (block, to) in enumerate(zip(blocks, reversed(after))):
            yield (table["conv_id"][0].as_py(), block, to, k == len(blocks) - 1, gaps, *totals.values(), whole)

    stated = fields(f"block long, to_end array<long>, last boolean, gaps long, {counted}, cost long")
    _grouped(spark.read.parquet(f"{folder}/summaries"), ["conv_id"], backwards, stated).write.parquet(f"{folder}/backwards")
    behind = spark.read.parquet(f"{folder}/backwards")
    met = lambda left, right: left.join(right.drop("conv_id"), "block")  # noqa: E731  # a block is of one conversation

    def searched_block(table: pa.Table) -> tuple:
        times, kinds, codes = _in_order(table, "at", "times", "kind", "code")
        live, live_codes, cut, lead = searched(kinds, codes, times)
        last, to_end = table["last"][0].as_py(), table["to_end"][0].as_py()
        return live, live_codes, cut, lead, distances(live_codes, cut, [0, FAR, FAR, 0] if last else [min(x, FAR) for x in to_end]), last

    def forwards_of(table: pa.Table) -> Iterator[tuple]:
        _, codes, cut, lead, dist, last = searched_block(table)
        yield table["conv_id"][0].as_py(), table["block"][0].as_py(), [walk(codes, cut, lead, dist, q, last)[2] if dist[q] < FAR else q for q in range(4)]

    passed = _grouped(met(judged.select("conv_id", "block", "at", "times", "kind", "code"), behind.select("conv_id", "block", "to_end", "last")), ["conv_id", "block"], forwards_of, fields("block long, leads array<long>"))

    def forwards(table: pa.Table) -> Iterator[tuple]:
        state = START
        for block, leads in zip(*_in_order(table, "block", "block", "leads")):
            yield table["conv_id"][0].as_py(), block, state
            state = leads[state]

    _grouped(passed, ["conv_id"], forwards, fields("block long, state long")).write.parquet(f"{folder}/forwards")

    def walked(table: pa.Table) -> Iterator[tuple]:
        live, codes, cut, lead, dist, last = searched_block(table)
        audit, edits, _ = walk(codes, cut, lead, dist, table["state"][0].as_py(), last)
        roles, texts = _in_order(table, "at", "role", "text")
        left = repaired(edits, [roles[k] for k in live], [texts[k] for k in live])
        yield table["conv_id"][0].as_py(), table["block"][0].as_py(), audit, "\n".join(left) if left else None

    begun = met(behind, spark.read.parquet(f"{folder}/forwards"))
    pieces = _grouped(met(lined.drop("blank", "turn"), begun.select("conv_id", "block", "to_end", "last", "state")), ["conv_id", "block"], walked, fields("block long, audit string, piece string"))
    pieces.write.parquet(f"{folder}/pieces")
    dealt = spark.read.parquet(f"{folder}/pieces").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "block")
    digests = fields("audit string, repaired_sha256 string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, audit, digest, begun, kind = (), [], None, False, pa.int64()

        def out() -> pa.RecordBatch:
            return _table([(at[0], "".join(audit), digest.hexdigest())], [kind, pa.string(), pa.string()], digests.names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, letters, piece in zip(*(column_values(batch, c) for c in ("conv_id", "audit", "piece"))):
                if at != (conv,):
                    if at:
                        yield out()
                    at, audit, digest, begun = (conv,), [], hashlib.sha256(), False
                audit.append(letters)
                if piece is not None:
                    digest.update((b"\n" if begun else b"") + piece.encode())
                    begun = True
        if at:
            yield out()

    stated = behind.where("last").select("conv_id", "gaps", *COUNTS, "cost")
    audits = map_arrow(dealt, digests, hashed).withColumnRenamed("conv_id", "__conv")
    return stated.join(audits, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")


def repair(rows: DataFrame, heavy_rows: int = 4_096, block_rows: int = 4_096) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    `rows` have conv_id, turn, role and text, and may have copies; a conversation of dropped rows alone has zeros.
    """
    spark = rows.sparkSession
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.col("copies") if "copies" in rows.columns else F.lit(1).alias("copies"))
    folder = stage_folder(spark)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    total = rows.count()
    sizes.where(F.col("n") > max(heavy_rows, total // 100_000)).select(F.col("conv_id").alias("__heavy")).write.parquet(f"{folder}-heavy")
    heavy = spark.read.parquet(f"{folder}-heavy")  # 100,000 at most by the bound
    few = F.col("conv_id").eqNullSafe(F.col("__heavy"))
    names = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    if heavy.isEmpty():
        return repaired_texts(rows).withColumn("repaired_sha256", F.sha2("repaired", 256)).select(*names)
    light = repaired_texts(rows.join(F.broadcast(heavy), few, "left_anti")).withColumn("repaired_sha256", F.sha2("repaired", 256)).select(*names)
    large = rows.join(F.broadcast(heavy), few, "left_semi")
    found = _heavy(large, folder, block_rows)
    empty = heavy.join(found.select(F.col("conv_id").alias("__found")), F.col("__heavy").eqNullSafe(F.col("__found")), "left_anti")
    zeros = empty.select(F.col("__heavy").alias("conv_id"), *(F.lit(0).cast("long").alias(c) for c in ["gaps", *COUNTS, "cost"]), F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    found.select(*names).unionByName(zeros).write.parquet(f"{folder}-found")
    remove_folder(spark, folder)
    return light.unionByName(spark.read.parquet(f"{folder}-found"))
