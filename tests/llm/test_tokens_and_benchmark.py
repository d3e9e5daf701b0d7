import random
import re

import public_tokenizers
from tokenizers import Tokenizer

from foliant.llm import decontamination, token_transducer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "'", "'re", "'rx", "a'll b'l c'v 's ''s -- 'tis", "  a", "a  b", "a\n\n b", "x   ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "é" * 50, "a" * 3000, "12 34 a1b2", "日本語 テキスト", "\0a\0", " \n's", "\x1c a", None]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(" \n'srtveldmax1é.-\t　ab🙂") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    library = Tokenizer.from_file(BYTE_BPE)
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, _text int")
    got = {r.doc_id: r for r in token_transducer.count_tokens(docs, BYTE_BPE).collect()}
    for i, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((text or "").encode()), want > 512), text
    assert token_transducer.count_tokens(docs.limit(0), BYTE_BPE).count() == 0


def test_state_maps_compose_as_the_whole_text():
    splitter = token_transducer.Splitter()
    rng = random.Random(2)
    import numpy as np

    kinds = np.array([rng.randrange(1, token_transducer.CLASSES) for _ in range(5000)], np.uint8)
    maps = token_transducer.compose_scan(splitter.state_maps(token_transducer.lanes_of(kinds, token_transducer.END)))
    for entry in range(token_transducer.STATES):
        state = entry
        for i, kind in enumerate(kinds):
            state = splitter.next[state * token_transducer.CLASSES + kind]
            if (i + 1) % token_transducer.CHUNK == 0:
                assert maps[i // token_transducer.CHUNK, entry] == state


def test_states_can_be_forgotten(monkeypatch):
    monkeypatch.setattr(token_transducer, "MAX_STATES", 50)
    own = token_transducer.TokenCounter(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    texts = [f"some words number {i} and thistle{i * i}" for i in range(200)]
    for text in texts:
        assert own.count([text.encode()]) == [len(library.encode(text, add_special_tokens=False).ids)]


def brute(text, items, size=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        for k in range(max(1, len(own) - size + 1) if own else 0):
            window = own[k : k + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), len(found), bool(hit)


def test_wu_manber_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ab", "é", "x1", "long-word", "q"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randint(1, 16))) for i in range(12)] + [(12, None), (13, ""), (14, "a"), (15, "..."), (14, "a")]
    texts = [None, "", "a", "A b", *(sentence(rng.randint(1, 60)) for _ in range(60))]
    texts += [f"{rng.choice(items[:12])[1]}, {sentence(5)}" for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontamination.BLOCK_BYTES, 40):
        got = {r.doc_id: r for r in decontamination.contamination_report(decontamination.find_benchmark(docs, bench, block_bytes=bound)).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == brute(text, items), text
    nameless = decontamination.find_benchmark(docs, spark.createDataFrame([(None, "a b"), (3, "b a")], "item_id long, text string")).collect()
    assert any(r["items"] == [""] or r["items"] == ["", "3"] for r in nameless)
    assert not decontamination.contamination_report(decontamination.find_benchmark(docs, bench.limit(0))).where("contaminated").count()


def test_a_slab_may_need_more_states_than_the_bound(monkeypatch):
    monkeypatch.setattr(token_transducer, "MAX_STATES", 4600 - 65_536)  # the table once ended 65,536 states above it
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(3, 400))) for _ in range(400)), "".join(rng.choices(letters, k=3000))]
    library = Tokenizer.from_file(BYTE_BPE)
    own = token_transducer.TokenCounter(BYTE_BPE)
    assert own.count([t.encode() for t in texts]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
