"""Benchmark items shorter than a window, and items of which no window has enough literal tokens."""

from test_edges import story

from cadenza.llm import decontaminate

ITEMS = [
    (1, "What is the capital of France?"),
    (2, "Add 3 and 4 and 5 and 6 and 7 and 8 and 9 and 10"),
    (3, "A farmer sells 12 eggs at the market"),
    (4, "?!"),
    (5, None),
]
DOCS = [
    (1, f"{story(30)} so they asked, What is the capital of France? {story(30, 2)}"),
    (2, f"{story(30)} Add 3 and 4 and 5 and 6 and 7 and 8 and 9 and 10 {story(30, 3)}"),
    (3, f"{story(30)}. A farmer sells 12 eggs at the market"),
    (4, f"{story(30)}. A farmer sells 30 eggs at the market"),
    (5, f"{story(30)}. What is the capital of Spain? Add 1 and 2 and 5 and 7 and 6 and 8 and 9 and 11"),
    (6, "What is the capital of France"),
    (7, "?!"),
    (8, None),
]


def test_short_items_and_windows_of_numbers(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {r.doc_id: (r.item_ids, r.n_windows) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: ([1], 1), 2: ([2], 7), 3: ([3], 1), 4: ([3], 1), 6: ([1], 1)}
