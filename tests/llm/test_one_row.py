"""One row of each group of near copies, whatever its doc_ids."""

import random

import corpus_pipeline


def test_one_row_of_each_group(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(6)]
    near = lambda t: t + " more"
    rows = [(1, texts[0], "b"), (1, texts[0], "a"), (2, near(texts[0]), "a")]  # a repeated row is the first
    rows += [(5, texts[1], "a"), (5, near(texts[1]), "a"), (6, texts[1], "a")]  # two texts share the first id
    rows += [(None, texts[2], "a"), (None, near(texts[2]), "a"), (None, texts[2], "a")]  # no ids
    rows += [(None, texts[3], "a"), (9, near(texts[3]), "a")]
    rows += [(5, texts[4], "a"), (5, texts[5], "a"), (5, texts[5], "a")]  # other groups with the same id
    rows += [(7, "", "a"), (8, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == 8 and len(set(got)) == 8
    assert {(1, texts[0], "a"), (9, near(texts[3]), "a"), (5, texts[4], "a"), (5, texts[5], "a"), (7, "", "a"), (8, None, "a")} <= set(got)
    assert sum(i == 5 for i, *_ in got) == 3
    assert sum(i is None for i, *_ in got) == 1
