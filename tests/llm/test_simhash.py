import random
import re

import numpy as np
import xxhash

from foliant.llm import components, shingles, similar, simhash


def brute_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(marks, budget=4):
    ids, parent = sorted(marks), {i: i for i in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(50)] + ["É", "A", "a"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 150))] for _ in range(25)]
    texts = [None, "", " ", "a", "A", "a b c", "  \t"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):
            own = list(words)
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append("\n".join(own))
    docs = spark.createDataFrame([(i * 3, t, 1, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, fp int, fingerprint string")
    marks = {i * 3: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(marks)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{marks[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_trie_join_loses_no_link_and_adds_none():
    rng = np.random.default_rng(1)
    for round_ in range(60):
        values = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, int(rng.integers(2, 120)))]
        for _ in range(3):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64))
        values = np.unique(values)
        label, _ = simhash.linked(values, [(0, len(values))], 4, 4)
        want = brute_components({int(v): int(v) for v in values})
        assert [int(values[k]) for k in label] == [want[int(v)] for v in values]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (1050, 2000)]
    for small in (0, 1000):
        got = {r.node: r.root for r in components.least_members(spark.createDataFrame(links, "a long, b long"), small).collect()}
        assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 200)) and got[2000] == 1000 and len(got) == 260
        assert components.least_members(spark.createDataFrame([], "a long, b long"), small).count() == 0


def test_similar_groups_are_verified(spark):
    rng = random.Random(6)
    base = [f"t{rng.randrange(500)}" for _ in range(200)]
    edited = list(base)
    edited[100] = "other"
    half = base[:100] + [f"u{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(half), "\n".join(edited), " ".join(base).upper(), None, "", " ".join(f"z{i}" for i in range(90))]
    docs = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == {10: 10, 11: 11, 12: 10, 13: 10, 14: 14, 15: 14, 16: 16}


def brute_groups(texts, size=5):
    """Components by links of Jaccard of at least 0.8 between all pairs, and those links."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
    ids, root, links = sorted(texts), {i: i for i in texts}, []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
                x, y = root[a], root[b]
                if x != y:
                    root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root, links


def test_similar_groups_of_a_template_equal_brute_force(spark):
    rng = random.Random(11)
    template = [f"t{rng.randrange(5000)}" for _ in range(120)]
    texts = {}
    for i in range(300):
        own = list(template)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"own{i}_{rng.randrange(99)}"
        texts[i] = " ".join(own)
        if i % 3 == 0:
            own[rng.randrange(len(own))] = f"copy{i}"
            texts[1000 + i] = " ".join(own)
    want, _ = brute_groups(texts)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_recall_at_the_least_similarity_is_whole_at_any_length(spark):
    rng, texts, pairs = random.Random(5), {}, {}
    for n in (8, 9, 10, 14, 20, 40, 100):
        for _ in range(40):
            a = len(texts)
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            pairs.setdefault(n, []).append(a)
            texts[a], texts[a + 1] = " ".join(words), " ".join(words + [f"v{rng.randrange(10**6)}" for _ in range((n - 4) // 4)])
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_groups(texts)[0]
    assert all(got[a + 1] == a for found in pairs.values() for a in found)


def test_one_of_each_keeps_rows_whole(spark):
    schema = "doc_id long, text string, k1 string, id string, node int"
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(3, base, "x", "a", 1), (3, base, "x", "a", 1), (2, base + " more", "y", "b", 2), (3, "other text", "z", "c", 3), (None, "text without an id", "n", "d", 4), (None, base, "n", "e", 5), (9, None, "e", "f", 6), (8, "", "e", "g", 7)]
    got = sorted(similar.one_of_each(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert got == sorted([rows[2], rows[3], rows[4], rows[7]], key=str)
    empty = similar.one_of_each(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "k1", "id", "node"]


def test_shingles_equal_plain_sets():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ABcde") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 40]))).encode() for _ in range(300)] + [b"", b"a" * 70000 + b" b c d e f"]
    own = shingles.shingled(texts, 5, shingles.Powers())
    def plain(t):
        words = t.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    names = {}
    for text, part, n in zip(texts, own.parts(), own.sizes):
        assert n == len(plain(text)) == len(part) // 8
        assert names.setdefault(frozenset(plain(text)), part) == part
    assert len(set(names.values())) == len(names)


def test_filters_never_lose_similar_sets():
    rng = np.random.default_rng(3)
    for n in (5, 9, 20, 60, 300):
        pool = rng.integers(0, 2**63, 4 * n).astype(np.uint64)
        sets = [np.unique(np.concatenate([pool[:n - k], pool[n + i * k : n + i * k + k]])) for k in range(0, max(2, n // 4)) for i in range(3)]
        own = shingles.Shingled(np.concatenate(sets), np.array([len(s) for s in sets]), np.array([len(s) for s in sets]))
        odd, prefix = own.parities(), [set(np.frombuffer(p, np.uint64).tolist()) for p in own.parts(shingles.prefix_lengths(own.sizes, 0.8))]
        for a in range(len(sets)):
            for b in range(a):
                if shingles.similar(sets[a], sets[b], 0.8):
                    n_a, n_b = own.sizes[a : a + 1], own.sizes[b : b + 1]
                    assert shingles.may_be_similar(n_a, n_b, odd[a : a + 1], odd[b : b + 1], 0.8).all()
                    assert len(prefix[a] & prefix[b]) >= shingles.least_shared(n_a, n_b, 0.8)[0]


def test_a_pair_leaves_a_bucket_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similar, "PAIRS_STEP", 4)
    monkeypatch.setattr(similar, "bucket_of", lambda token, buckets: np.zeros(np.shape(token), np.int32))
    sets = [np.arange(1, 21, dtype=np.uint64)] * 3
    node, label, n, counts = np.arange(3), np.arange(3), np.full(3, 20, np.int32), np.full(3, 5, np.int32)
    odd = np.zeros((3, shingles.CLASSES // 64 + 2 * similar.HEADS), np.uint64)
    for heads in (0, 1):
        odd[:, shingles.CLASSES // 64] = heads
        arrays = [similar.pack_arrays(node, label, n, counts), similar.pack_arrays(odd.reshape(-1)), similar.pack_arrays(np.concatenate([s[:5] for s in sets]).astype(np.uint32))]
        batch = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in arrays], ["classes", "odds", "tokens"])
        got = [tuple(r.values()) for out in similar.shared_in_bucket(0.8, None, 1)((pa.scalar(0),), iter([batch])) for r in out.to_pylist()]
        assert sorted(r[:2] for r in got) == [(0, 1), (0, 2), (1, 2)] and all(r[2] >= 5 for r in got if not heads)


def test_only_prefix_shingles_that_two_classes_have_are_dealt(spark):
    rng = random.Random(5)
    alone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    near = alone[0].split()
    near[50] = "changed"
    rows = similar.numbered_rows(spark.createDataFrame([*enumerate(alone), (500, " ".join(near)), (501, None)], "doc_id long, text string"), "doc_id", "text")
    classes = similar.marked(rows, 5, 0.8, np.array([], np.uint64)).select("node", "n", "prefix", "odd")
    for buckets in (1, 7):
        got = {r.node: r.prefix for r in similar.shared_prefixes(classes, buckets).collect()}
        assert set(got) == {similar.text_class(alone[0].encode()), similar.text_class(" ".join(near).encode())}
        held = [set(np.frombuffer(p, np.uint64).tolist()) for p in got.values()]
        assert held[0] == held[1] and held[0]
