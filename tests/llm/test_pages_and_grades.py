import math
import random
import time

from pyspark.sql import functions as F

from foliant.llm import mainhtml, ordinal, warc

PAGES = {
    1: ("<html><head><title>x</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy, now.</div><article><h1>Head &amp; line</h1><p>First, one.  Two\n three.<p>Second &lt;b&gt; para, graph. And <b>more</b>, really.</article><div id='comments'><p>Nice, post. Really, I like it, a lot.</p></div><footer>&copy; me</footer></body></html>", "Head & line\nFirst, one. Two three.\nSecond <b> para, graph. And more, really."),
    2: ("", ""),
    3: (None, ""),
    4: ("plain text, no markup", "plain text, no markup"),
    5: ("<p>one<script>if (a < b) { x('</p>') }</script> still<br>one<!-- c --></p><p>two", "one still one\ntwo"),
    6: ("<div hidden>no</div><main><section><h2>T</h2><p>Body, text. Here, it is.</p></section><aside>no</aside><form>no</form></main>", "T\nBody, text. Here, it is."),
    7: ("<ul><li>a<li>b</ul> a < b & c &am", "a\nb\na < b & c &am"),
    8: ("<nav><p>only menus</p></nav>", ""),
    9: ("<div><a href=x>Home</a><a>News</a><a>Sport</a></div><div><p>This is the first, long paragraph of text. It has some sentences, and marks.</p><p>Second one, as well.</p></div>", "This is the first, long paragraph of text. It has some sentences, and marks.\nSecond one, as well."),
    10: ("<article><h2>T</h2><p class=alert>Beware, of the dog. It bites, really.</p><fieldset>Kept, text.</fieldset><ul><li>item one</ul><p>Text, x.</p><math>x+y</math><section class=comments><p>Great, post. I liked it, a lot, really.</p></section></article><div>Ours is a short line.</div>", "T\nBeware, of the dog. It bites, really.\nKept, text.\nitem one\nText, x.\nx+y"),
}


def test_main_text(spark):
    pages = spark.createDataFrame([(k, f"u{k}", h, "clash") for k, (h, _) in PAGES.items()] * 2, "page_id long, url string, html string, text string")
    got = mainhtml.extract(pages).collect()
    assert len(got) == 2 * len(PAGES)
    for r in got:
        assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert mainhtml.extract(pages.limit(0)).count() == 0
    long = "<article>" + "".join(f"<p>Sentence {i}, is here.</p>" for i in range(20_000)) + "</article>"
    assert mainhtml.main_text(long).count("\n") == 19_999


def test_scores_are_the_plain_ratios():
    rng = random.Random(2)
    for _ in range(60):
        parts = [(rng.choice(["p", "div", "td", "span"]), rng.choice(["", " class=x"]), " ".join(rng.choice(["word", "a,", "end."]) for _ in range(rng.randint(1, 30)))) for _ in range(rng.randint(1, 12))]
        page = mainhtml.Page("".join(f"<section><{t}{c}>{x}</{t}></section>" for t, c, x in parts))
        order, seen = [], {}
        for t, c, x in parts:
            key = ("section", "") if t == "span" else (t, c)
            if key not in seen:
                order.append(key)
            seen.setdefault(key, []).append(x)
        length = [math.log(1 + sum(map(len, seen[k])) / len(seen[k])) for k in order]
        marks = [math.log(1 + sum(x.count(",") + x.count(".") for x in seen[k]) / len(seen[k])) for k in order]
        smooth = lambda r: [0.75 * r[i] + 0.125 * (r[max(0, i - 1)] + r[min(len(r) - 1, i + 1)]) for i in range(len(r))]
        want = [a * (1 + b) for a, b in zip(smooth(length), smooth(marks))]
        scores = mainhtml.path_scores(page)
        assert all(abs(a - b) < 1e-9 for a, b in zip(scores.values(), want)) and len(scores) == len(want)
        chosen = mainhtml.content_paths(page)
        assert [p in chosen for p in scores] == [w >= 0.35 * max(want) for w in want]


def test_depth_costs_no_more_than_length():
    began = time.perf_counter()
    assert mainhtml.main_text("<div>" * 100_000 + "text, here.") == "text, here."
    assert mainhtml.main_text("<b>" * 100_000 + "text, here." + "</b>" * 100_000) == "text, here."
    assert time.perf_counter() - began < 10


def captures(spark, rows):
    schema = "record_id long, url string, captured long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>, bucket string"
    return spark.createDataFrame([(*r, "clash") for r in rows], schema)


def test_revisits(spark):
    day = 86_400
    rows = [
        (1, "HTTP://A.com:80/x#f", 100, "response", '"a"', None, "d1", {"Content-Type": "t", "Date": "1"}),
        (2, "http://a.com/x", 100, "revisit", '"a"', None, None, None),
        (3, "http://a.com/x", 101, "revisit", 'W/"a"', None, None, {"Date": "2", "Content-Type": "evil"}),
        (4, "http://a.com/x", 40 * day, "response", '"b"', "lm", "d2", {"Date": "3"}),
        (5, "http://a.com/x", 90 * day, "revisit", '"a"', "lm", None, {"Date": "4"}),
        (6, "http://a.com/x", 91 * day, "revisit", None, "lm", None, {"ETag": "e"}),
        (7, "http://a.com/x", 92 * day, "revisit", None, None, None, {}),
        (8, None, 5, "revisit", None, None, None, None),
        (9, "http://b.com", 5, "revisit", None, None, None, None),
        (9, "http://b.com", 5, "revisit", None, None, None, None),
        (10, "http://a.com/x", 40 * day, "response", '"a"', "lm", "d3", {"Date": "5"}),
    ]
    got = {}
    for r in warc.resolve_revisits(captures(spark, rows)).collect():
        got.setdefault(r.record_id, []).append((r.response_id, r.outcome, r.payload_digest, {h.key: h.value for h in r["headers"]} if r["headers"] is not None else None))
    assert got[2] == [(None, "orphan", None, None)]
    assert got[3] == [(1, "resolved", "d1", {"content-type": "t", "date": "2"})]
    assert got[5] == [(10, "resolved", "d3", {"date": "4"})]
    assert got[6] == [(10, "resolved", "d3", {"date": "5", "etag": "e"})]
    assert got[7] == [(10, "unverified", "d3", {"date": "5"})]
    assert got[8][0][1] == "orphan" and [x[1] for x in got[9]] == ["orphan", "orphan"]
    assert warc.resolve_revisits(captures(spark, rows).limit(0)).count() == 0


def test_grades_hold_out(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]

    def document(grade):
        own = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if grade == 0:
            own[rng.randrange(len(own))] = rng.choice(["vile", "foul", "rotten"])
        return " | ".join(own) if grade == 1 else " ".join(own)

    rows = [(i, document(g), g) for i, g in enumerate(rng.choices([0, 1, 2], [1, 1, 4], k=900))]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, 1 if g == 2 else 0, 1 if g == 0 else 0) for i, _, g in rows[:600]] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.grade_documents(docs, labels).collect()}
    assert len(got) == 902
    held = rows[600:]
    for grade, least in ((0, 0.85), (1, 0.75), (2, 0.95)):
        own = [got[i].keep == (grade == 2) for i, _, g in held if g == grade]
        assert sum(own) >= least * len(own), grade
    assert all(r.p_not_toxic >= r.p_good and 0 <= r.expected_grade <= 2 for r in got.values())
    none = ordinal.grade_documents(docs, labels.limit(0)).where(F.col("keep")).count()
    assert none == 902
    assert ordinal.grade_documents(docs.limit(0), labels).count() == 0


def test_content_paths_decide_wherever_the_blocks_are():
    prose = "".join(f"<p>Sentence {i}, which is long, has commas. And it goes on, as prose does.</p>" for i in range(40))
    lines = mainhtml.main_text(f"<body><main><h1>Headline</h1><p>A lead, of some length, that says it all.</p><article>{prose}</article></main></body>").split("\n")
    assert lines[:2] == ["Headline", "A lead, of some length, that says it all."] and len(lines) == 42
    second = "<div><p>The second part, which is short, ends here.</p></div>"
    assert mainhtml.main_text(f"<body><div>{prose}</div>{second}</body>").split("\n")[-1] == "The second part, which is short, ends here."
    rejected = mainhtml.main_text("<body>" + "".join(f"<ul><li>x{i}</li></ul>" for i in range(9)) + f"<div><b>y</b></div>{prose * 3}</body>")
    assert "x1" not in rejected and "Sentence 39" in rejected
