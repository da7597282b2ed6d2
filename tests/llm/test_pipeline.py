"""The pipeline's stages against plain versions of what each one decides."""

import hashlib
import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from latticeflow.llm.common import fresh_path

from .test_operators import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(r.choices(words, k=n)).capitalize() + "."
    bad = lambda: "\n".join(" | ".join(r.choices(words, k=6)).upper() + "!!" for _ in range(6))
    item = prose(30)
    passage = prose(80)
    rows = []
    for i in range(160):
        text = "\n".join(prose(r.randint(20, 60)) for _ in range(3))
        if i % 4 == 1:
            text = bad()
        if i in (40, 80):
            text += "\n" + item
        if i % 10 == 2:
            text += "\n" + passage
        rows.append((i, text, "en", "s", len(text)))
    rows += [(200, rows[0][1], "en", "s", 1), (201, rows[0][1].replace("a", "b", 1), "en", "s", 1), (202, None, "en", None, None), (203, "", "en", "s", 0), (None, prose(40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_keeps_the_good(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept >= {i for i in range(160) if i % 4 != 1} and not kept & {i for i in range(160) if i % 4 == 1}
    assert texts(stages[1]) <= texts(stages[0])


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert after <= before
    ids = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    sets = {r: shingles(r[1], 5) for r in ids}
    parent = {r: r for r in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)), key=ids.index)
                parent[y] = x
    assert after == {root(r) for r in ids}
    assert (200, [t for i, t in before if i == 200][0]) not in after


def test_repeats_go_and_leaks_go(stages):
    before, after = dict(texts(stages[2])), dict(texts(stages[3]))
    assert set(before) == set(after)
    long = [i for i in after if i is not None and after[i] and len(after[i]) < len(before[i])]
    assert len(long) >= 5
    seen, order = set(), sorted(before, key=lambda i: (i is not None, i or 0))
    for i in order:
        raw = (before[i] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        assert (after[i] or "") == bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].where("text is not null").collect())
    gone = {r["doc_id"] for r in stages[3].collect()} - {r["doc_id"] for r in stages[4].collect()}
    assert gone == {40} or gone == {40, 80}


def test_ids(stages):
    plain = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    expected = {}
    for r in stages[4].collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        expected[r["doc_id"]] = (ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert {r["doc_id"]: (r["ids"], r["ids_sha256"]) for r in stages[5].collect()} == expected


def test_run_is_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, got.select("doc_id", "ids_sha256").collect())) == sorted(map(str, stages[5].select("doc_id", "ids_sha256").collect()))
    assert got.where(F.col("n_tokens") != F.size("ids")).count() == 0


def test_no_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_columns_that_clash_stay_as_they_are(spark, folder, stages):
    more = {"__lf_rid": "doc_id + 1", "__lf_starts": "lang", "__lf_key": "1", "__lf_cut": "2", "__lf_quality": "3", "others": "named_struct('x', doc_id)", "a.b": "n_chars", "tags": "map('k', lang, 'id', cast(doc_id as string))"}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, value in more.items():
        docs = docs.withColumn(name, F.expr(value))
    docs = docs.unionByName(docs.where("doc_id in (0, 4)").withColumn("__lf_key", F.lit(0)))  # rows that repeat, least in an extra column
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = fresh_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert texts(out) == texts(stages[k + 1])
        for r in out.collect():
            i = r["doc_id"]
            assert (r["__lf_rid"], r["__lf_starts"], r["tags"]["k"], r["others"]["x"]) == (i + 1 if i is not None else None, r["lang"], r["lang"], i)
            assert r["__lf_key"] == (0 if i in (0, 4) and k > 0 else r["__lf_key"])
        docs = out
