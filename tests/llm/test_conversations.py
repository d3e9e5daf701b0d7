"""Repairs against a plain search over all edits, whole and in blocks."""

import hashlib
import heapq
import random
import zlib

from foliant.llm.conversations import damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired rows) by a best-first search ordered by cost, then audit."""
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    queue, settled = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if settled.setdefault((i, state), (cost, audit)) != (cost, audit):
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out), kinds
        for letter, role in (("u", "user"), ("a", "assistant")):
            if (state, letter) in NEXT:
                heapq.heappush(queue, (cost + 2, audit + "I", i, letter, (*out, f"{role}:")))
                if i < len(rows) and kinds[i] in ("", "truncated"):
                    heapq.heappush(queue, (cost + 2 + (kinds[i] != ""), audit + "R", i + 1, letter, (*out, f"{role}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
            after = NEXT.get((state, rows[i][1][:1]))
            if after and kinds[i] in ("", "truncated"):
                heapq.heappush(queue, (cost + (kinds[i] != ""), audit + "K", i + 1, after, (*out, f"{rows[i][1]}:{rows[i][2]}")))


def plain(rows):
    show, groups = lambda v: " " if v is None else v, {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text, group = show(role), show(text), groups.setdefault(conv, [])
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        group += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, audit, left, kinds = cheapest(group)
        turns = [r[0] for r in group if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(5)
    out = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Hello.", "More!", "cut off", "", " \n", "Why?", f"text {turn}.", f"long {turn} ", None])
            out.append((conv, rng.choice([turn, turn * 2, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text, 1))
    out += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + "." * (t % 3), 1) for t in range(150)]
    out += [(501, 3, "user", "The same.", 1)] * 60 + [(501, t // 3, "assistant", "The same.", 1) for t in range(60)]
    return out


def order(found):
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))


def test_equals_plain_search(spark):
    got = [tuple(r) for r in repair(damaged(spark.createDataFrame(rows(), SCHEMA).repartition(5))).collect()]
    assert order(got) == order(plain(rows()))


def test_heavy_conversations_in_blocks(spark):
    data = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for block in (1, 4, 50):
        got = [tuple(r) for r in repair(damaged(data), heavy_rows=5, block_rows=block).collect()]
        assert order(got) == order(plain(rows()))


def test_all_rows_dropped_and_empty_table(spark):
    dropped = [(c, 0, "user", "x", 1) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair(damaged(spark.createDataFrame(dropped, SCHEMA))).collect()
    assert len(got) == len(dropped) and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    heavy = [(c, 0, "user", "x", 1) for c in (dropped[0][0],) for _ in range(9)]
    assert [tuple(r)[1:8] for r in repair(damaged(spark.createDataFrame(heavy, SCHEMA)), heavy_rows=3).collect()] == [(0, 0, 0, 0, 0, 0, "")]
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
