"""Items too short to be cut in pieces of eight characters, and the budget of edits of the others."""

import pytest

from latticeflow.llm import decontam


def test_short_items_match_whole():
    index = decontam.ItemIndex([(1, "Is it Monday?"), (2, "ab"), (3, "?!"), (4, "the cat sat")])
    assert index.find("Well, is it MONDAY, or not") == [(1, 0, 5, 17)]
    assert index.find("is it monday") == [(1, 0, 0, 12)]
    assert index.find("this it monday, is it mondays, cab, abc") == []
    assert index.find("this it mondays; is it monday") == [(1, 0, 16, 28)]
    assert index.find("ab") == [(2, 0, 0, 2)]
    assert index.find("the cat sit") == [] and index.find("") == []


def test_short_items_match_in_tables(spark):
    docs = spark.createDataFrame([(1, "so: The cat, sat. there"), (2, "the cats sat"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the cat sat"), (8, ""), (9, None)], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, bench).collect()] == [(1, 7, 0, 3, 14)]


@pytest.mark.parametrize("size", [24, 29, 30, 31, 39, 40])
@pytest.mark.parametrize("rate", [0.1, 0.2])
def test_budget_is_the_stated_one(size, rate):
    item = "".join(chr(97 + (7 * i) % 26) for i in range(size))
    k = int(rate * size)
    index = decontam.ItemIndex([(1, item)], rate)
    assert index.nodes[0].budget == k
    for edits in (k, k + 1):
        text = list(item)
        for e in range(edits):
            text[(2 * e + 1) * size // (2 * edits)] = "0"
        found = index.find("".join(text))
        assert [f[1] for f in found] == ([k] if edits == k else [])
