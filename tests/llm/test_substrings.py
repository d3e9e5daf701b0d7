import random
import re

from foliant.llm import substrings


def brute(rows, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in sorted(split, key=lambda r: r[0]):
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = {}
    for i, words in split:
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(window)}
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_removal_equals_brute_force(spark):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "A", "a.", "\x00", "\x85x"]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [sentence(rng.randint(8, 60)) for _ in range(12)] + [["same"] * 30]
    rows = [(0, None), (1, ""), (2, "  "), (3, "a b")]
    for i in range(4, 160):
        parts = [sentence(rng.randint(0, 40)), rng.choice(passages), sentence(rng.randint(0, 20)), rng.choice(passages)[: rng.randint(0, 40)]]
        rows.append((i * 7 % 163 + 1000, rng.choice([" ", "\n", "\t "]).join(sum(parts, []))))
    rows += [(5000 + i, rows[9][1]) for i in range(20)]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, hits string, n_words int").repartition(3)
    for held in (substrings.FLUSH_WORDS, 300):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, flush_words=held).collect()}
        assert got == brute(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "a b"), (3, text[:60]), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 40), (3, 0), (3, 17)]
