"""Long tables of spreadsheets: each step is worked out once, so the work follows the cells."""

from pyspark.sql import functions as F

from foliant.sources.corpus import clean_table


def test_a_long_sheet_is_cleaned_with_its_cells_split_once(spark):
    rows = [f"| {i} | nan | y{i} |" for i in range(400)]
    text = "\n".join(["head", "| a | Unnamed: 1 | c |", "|---|---|---|", *rows, "foot", "| x |"])
    got = spark.createDataFrame([(text,), (None,)], "t string").select(clean_table(F.col("t")).alias("c"))
    assert got._jdf.queryExecution().analyzed().toString().count("split(") == 2  # lines, and their cells
    want = "\n".join(["head", "| a | c |", "| --- | --- |", *[f"| {i} | y{i} |" for i in range(400)], "foot", "| x |"])
    assert [r.c for r in got.collect()] == [want, None]
