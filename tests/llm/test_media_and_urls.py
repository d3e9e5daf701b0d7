import hashlib
import random
import zlib

import numpy as np
import pytest

from foliant.llm import jpeg, urlfilter


def test_payloads_round_trip(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 300, "x" * 576, "y" * 577, "word " * 60_000, "a", "\0\x7f"]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(160, 0xD7FF)])) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = {r.doc_id: bytes(r.media) for r in jpeg.store(docs).collect()}
    got = {r.doc_id: r for r in jpeg.read_back(jpeg.store(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert got[0].feature == got[1].feature and got[2].feature == got[7].feature
    assert jpeg.read_back(jpeg.store(docs.limit(0))).count() == 0


def test_general_decoder_agrees_and_reads_ac_coefficients():
    payload = bytes(random.Random(1).randrange(256) for _ in range(1152))
    frame = jpeg.parse(jpeg.encode([payload])[0])[0]
    assert (jpeg.decode_general(frame) + 128).astype(np.uint8).tobytes() == payload
    # One block: DC category 2 with value 3, then a run of 15 zeros, one coefficient, end of block.
    dc, ac = ((0, 1, *[0] * 14), (2,)), ((0, 2, *[0] * 14), (0x00, 0xF1))
    frame.tables, frame.restart, frame.width, frame.height = {0: dc, 16: ac}, 0, 8, 8
    frame.intervals = [int("00" + "11" + "01" + "1" + "00" + "1111111", 2).to_bytes(2, "big")]
    assert jpeg.decode_general(frame).tolist() == [[3]]
    assert jpeg.decode_lanes(frame.intervals, jpeg.block_table(dc, ac), 1) is None
    with pytest.raises(ValueError, match="start of image"):
        jpeg.parse(b"GIF89a")


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "a.b/x"), ("allow", "a.b/xy"), ("block", "a.b/")]
URLS = [None, "", "example.org/", "http://org", "http://ORG/", "https://m.Example.org/es/1?x#y", "http://notexample.org/es/", "http://e.com/x.example.org/es/", "ftp://a.b/xyz", "http://a.b/x?y", "http://q.a.b/X", "http://a.b?/x", "://a.b/", "http://a.b/x://org/", "http://a.b:80/", "http://é.org/é", "http://a.b/" + "z" * 9000]


def test_url_rules_equal_the_definition(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = urlfilter.judge_urls(pages, RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        url = URLS[r.page_id] or ""
        rest = url.partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower() if host.isascii() else host
        fits = [x for x in RULES if (host == x[1].partition("/")[0] or host.endswith("." + x[1].partition("/")[0])) and path.startswith("/" + x[1].partition("/")[2])]
        best = max(fits, key=lambda x: len(x[1]), default=("allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[0]), url
    assert urlfilter.judge_urls(pages.limit(0), RULES).count() == 0


def test_many_globs_cross_words():
    rng = random.Random(9)
    import fnmatch

    globs = ["".join(rng.choice("ab?*") for _ in range(rng.randint(1, 12))).replace("**", "*") for _ in range(60)]
    globs = [g.replace("**", "*") for g in globs]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    found = urlfilter.Globs([g.encode() for g in globs]).matches([t.encode() for t in texts])
    assert found.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]
