import random

from foliant.session import ROOT

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    assert ROOT
    rng = random.Random(3)
    words = [f"w{i}" for i in range(90)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, item = text(150), text(60), text(25)
    near = base.split()
    near[70] = "changed"
    texts = {0: base, 1: base.upper(), 2: " ".join(near), 3: text(80) + " " + passage, 4: passage + " " + text(90), 5: text(40) + " " + item, 6: "vile foul rotten " + text(50), 7: text(3000)}
    for i in range(10, 400):
        texts[i] = ("vile foul rotten " if i % 5 == 0 else "") + text(60)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(8, None, "en", "s", 0), (9, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 1 if i % 5 == 0 else 0) for i in range(10, 400)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        kept.append({r.doc_id: r.asDict() for r in now.collect()})
        if k < 4:
            assert now.columns == docs.columns
    assert not any(i in kept[0] for i in texts if i >= 10 and i % 5 == 0) and 6 not in kept[0]
    assert {0, 3, 4, 5, 7} <= set(kept[0]) and all(i in kept[0] for i in range(11, 400) if i % 5)
    assert 0 in kept[1] and 1 not in kept[1] and 2 not in kept[1] and {3, 4, 5, 7} <= set(kept[1])
    assert kept[2][3]["text"] == texts[3] and passage not in kept[2][4]["text"] and len(kept[2][4]["text"].split()) == 90 and kept[2][4]["n_chars"] == len(kept[2][4]["text"])
    assert set(kept[2]) == set(kept[1]) and set(kept[2]) - set(kept[3]) == {5}
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, folder).count() == now.count()
