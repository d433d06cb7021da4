"""Documents and items without an id are decontaminated like others."""

from logquarry.llm import decontaminate


def test_keep_clean_without_ids(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(None, f"x {passage} y"), (None, "a clean text of seven words here"), (1, passage), (2, "another clean text"), (3, "q1 q2 q3 q4 q5 q6"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (None, "q1 q2 q3 q4 q5 q6")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[3], rows[5]], key=repr)
