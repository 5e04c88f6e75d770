"""Benchmark items too short for probes, and items without an id."""

from outlinelake.llm.decontamination import contaminated_spans, without_contaminated


def test_short_items_and_items_without_id(spark):
    question, long = "What is the capital of France?", "A longer question without an id, of which nothing else in these texts tells anything."
    texts = [f"é: {question.upper()} Paris", "what is the capital of Frances", "x, what is  the capital\nof france", long, "somewhat is the capital of france", "france", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, question), (2, question), (None, long), (3, "?!"), (4, "")], "item_id long, text string")
    got = sorted(map(tuple, contaminated_spans(docs, bench).collect()))
    assert got == [(0, 1, 3, 32, 1, 0), (0, 2, 3, 32, 1, 0), (2, 1, 3, 33, 1, 0), (2, 2, 3, 33, 1, 0)]
    assert sorted(r["doc_id"] for r in without_contaminated(docs, bench).collect()) == [1, 4, 5, 6]
