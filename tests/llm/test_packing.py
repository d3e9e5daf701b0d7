import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from foliant.llm import packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def check_sequences(rows, capacity):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        place = 0
        for r in own:
            assert r.offset == place
            place += r.length
        assert place <= capacity
    return by_sequence, by_doc


def test_pieces_and_ids_equal_the_library(spark):
    rng = random.Random(4)
    texts = [None, "", "It's a Test's 12 ½", "a <|endoftext|>B", "ΑΣ İx é", "\x1c\x1da b", "word " * 5000]
    texts += ["".join(rng.choice(" \n'srtveldmaxΣİ1é.-\t　ab🙂<|>") for _ in range(rng.randint(1, 900))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, members string").repartition(7)
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    sequences, by_doc = check_sequences(rows, 2048)
    library = Tokenizer.from_file(WORD_BPE)
    total = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k // 2048, k, len(part := ids[k : k + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))) for k in range(0, len(ids), 2048)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs.limit(0), WORD_BPE).count() == 0


def test_tree_ends_whatever_the_sizes(spark):
    for low, high in ((1, 60), (1100, 1300), (2048, 2048)):
        rng = random.Random(low)
        rows = [(i, 0, 0, rng.randint(low, high), 0) for i in range(800)] * 2
        parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(30)
        packed = packing.pack(parts, items_each=50).collect()
        sequences, _ = check_sequences(packed, 2048)
        assert len(packed) == len(rows)
        if high < 1024:
            assert len(sequences) <= sum(r[3] for r in rows) / 2048 * 1.15 + 3
