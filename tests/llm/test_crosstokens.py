"""Alignment of two tokenizers against the libraries and a plain walk over byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import crosstokens
from foliant.llm.crosstokens import align, byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "Plain words, and more words.", "two  spaces   three\n\n new \t lines \n  end ", " leading and trailing ", "naïve Ünïcode ﬁ ligature Ⅷ ½", " nbsp em 　wide",
    "日本語のテキスト 和 文字", "🙂🙃 emoji 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x0A> ▁under", "a\x00b\x01 c\x1f d", "x" * 3000, "don't we'll I'd 's", "the the the the", "é combining", "tabs\t\tand\r\nreturns \r\n ", "1234567890 3.14 -7e10", "﻿bom", "def f(x):\n    return x  # code\n",
]


def plain(texts):
    a_own, b_own = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_own.encode_special_tokens = True
    names, table = {k: v for v, k in a_own.get_vocab().items()}, byte_of_char()
    docs, held = [], Counter()
    for text in texts:
        body = (" " + (text or "")).encode()
        a, b = a_own.encode(" " + (text or ""), add_special_tokens=False).ids, b_own.encode(text or "")
        a_parts = [bytes(table[c] for c in names[k]) for k in a]
        b_parts = [bytes([int(p[3:5], 16)]) if b_own.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b_own.id_to_piece(k)) for k in b)]
        if not text or b"".join(a_parts) != body or b"".join(b_parts) != body:
            docs.append(([], "", 0, 0))
            continue
        spans = []
        for parts in (a_parts, b_parts):
            at, found = 0, []
            for p in parts:
                found.append((at, at := at + len(p)))
            spans.append(found)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
        common, i, j, groups = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), 0, 0, []
        for end in common:
            left, right = [], []
            while i < len(a) and spans[0][i][1] <= end:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                right.append(str(b[j]))
                j += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        docs.append((links, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(a), len(b), len(groups)))
        held.update(set(links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(d[2], d[3], d[4] if len(d) > 4 else 0, len(d[0]), sum(held[p] == best[p[0]] for p in d[0]), sum(held[p] for p in d[0]), d[1]) for d in docs]


def test_equals_plain_walk(spark):
    texts = TEXTS + [f"{t} again {k}" for k, t in enumerate(TEXTS) if t]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, links int").repartition(3)
    want = plain(texts)
    for most in (1 << 21, 40):
        got = sorted(tuple(r) for r in align(docs, A, B, broadcast_pairs=most).collect())
        assert got == [(k, *w) for k, w in enumerate(want)]


def test_rows_without_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, None)], "doc_id long, text string")
    got = [tuple(r) for r in align(docs, A, B).collect()]
    assert sorted(r[1:] for r in got)[0] == (0, 0, 0, 0, 0, 0, "") and len(got) == 3
    assert align(docs.limit(0), A, B).collect() == []


def test_pieces_are_aligned_once_and_forgotten(monkeypatch):
    known = crosstokens.Aligned((A, B), 15)
    seen, whole = [], known.tokens.whole
    monkeypatch.setattr(known.tokens, "whole", lambda texts: seen.extend(texts) or whole(texts))
    digests = [d for k in range(5) for d in known.documents([f"same words {k}", " two  spaces"])[3]]
    assert sum(t.count("same") for t in seen) == 1 and sum(t.count("spaces") for t in seen) == 1
    monkeypatch.setattr(crosstokens, "KEPT_PIECES", 1)
    again = [d for k in range(5) for d in known.documents([f"same words {k}", " two  spaces"])[3]]
    assert again == digests == [w[-1] for w in plain([t for k in range(5) for t in (f"same words {k}", " two  spaces")])]
    assert len(known.texts) < 8
