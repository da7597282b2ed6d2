"""Whole operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticeflow.llm import arc_convert, bitplane, bwt_dedup, chunk_bpe, common, components, decontam, labelled, line_crf, pivot_index, queries, recurrent_lm, shingle_join, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string, score string, spans string, keys string, v string, n string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    passage, rows = prose(70), []
    for i in range(60):
        rows.append((i, prose(r.randint(20, 120)) + (" " + passage if i % 7 == 0 else "") + "\n" + prose(10)))
    base = rows[3][1].split(" ")
    for i in range(60, 80):
        near = list(base)
        near[r.randrange(len(near))] = "edited"
        rows.append((i, " ".join(near)))
    rows += [(80, rows[5][1]), (81, rows[5][1]), (81, rows[5][1]), (82, None), (83, ""), (84, " \n\t "), (85, "one"), (86, "One two"), (87, "a " * 4000), (88, prose(9000)), (None, prose(30)), (None, None), (89, prose(15)), (89, prose(15)), (90, "é" * 300), (91, "日本語 " * 60)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_encoding(docs, rows, empty):
    plain = Tokenizer.from_file(BYTE)
    got = Counter(map(tuple, chunk_bpe.digests(docs, BYTE).collect()))
    expected = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected
    assert chunk_bpe.encode_documents(empty, BYTE).count() == 0
    assert "keys" in chunk_bpe.encode_documents(docs, BYTE).columns


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_plane_files(docs, rows, empty, planes):
    plain = Tokenizer.from_file(WORD)
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(map(tuple, bitplane.plane_digests(docs, WORD, planes).collect()), key=lambda r: r[1])
    assert [key(r) for r in got] == sorted(map(key, rows))
    at, seen = 0, Counter()
    for i, start, n, crc in got:
        assert start == at
        at += n
        seen[i, n, crc] += 1
    expected = Counter()
    for i, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert seen == expected
    assert bitplane.plane_digests(empty, WORD).count() == 0


def plain_dedup(rows):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    seen, out = set(), {}
    for some, i, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = True
            seen.add(s)
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out[(i if some else None), t] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeated_strings(spark, docs, rows, empty, monkeypatch):
    expected = plain_dedup(rows)
    got = Counter(map(tuple, bwt_dedup.digests(docs).collect()))
    assert got == Counter((i, *expected[i, t or ""]) for i, t in rows)
    assert sum(v[1] for v in expected.values()) > 3000
    assert bwt_dedup.digests(empty).count() == 0
    for most in (5, 2, 1):
        monkeypatch.setattr(bwt_dedup, "HOT_REGIONS", most)
        assert Counter(map(tuple, bwt_dedup.digests(docs).collect())) == got
    kept = {r["doc_id"]: r["text"] for r in bwt_dedup.dedup_rows(docs).where("doc_id is not null").collect()}
    assert kept[82] is None and kept[83] == "" and len(kept[80]) < 100


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("words", "per_cent"), [(3, 90), (5, 80)])
def test_similarity_groups(docs, rows, empty, words, per_cent):
    items = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    sets = [shingles(t, words) for *_, t in items]
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= per_cent * (len(sets[a]) + len(sets[b]) - i):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (some, i, _) in enumerate(items):
        if some:
            least[root(k)] = min(least.get(root(k), i), i)
    expected = {((i if some else None), t): (len(sets[k]), least.get(root(k))) for k, (some, i, t) in enumerate(items)}
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.near_groups(docs, words, per_cent).collect())
    assert got == Counter((i, *expected[i, t or ""]) for i, t in rows)
    assert len(set(least.values())) < len(items) - 5
    assert shingle_join.near_groups(empty).count() == 0


def test_near_copies_of_many_kinds(spark, monkeypatch):
    """Groups of frequent shingles only, so that pairs of shingles, clusters and blocks all come into play."""
    monkeypatch.setattr(shingle_join, "FREQUENT", 4)
    r = random.Random(12)
    base = ["w%d" % r.randrange(10**6) for _ in range(300)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 5, 6, 9, 14])):
            words[r.randrange(300)] = r.choice(["a", "b", "u%d" % i])
        rows.append((i, " ".join(words)))
    sets = [shingles(t, 3) for _, t in rows]
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(150):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for most in (1000, 1):  # common components apart from the shuffle
        monkeypatch.setattr(common, "HOT_ROWS", most)
        got = shingle_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in range(150)}
    assert len({root(i) for i in range(150)}) > 5


def test_language_model(docs, rows, empty):
    got = recurrent_lm.score(docs).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert recurrent_lm.score(empty).count() == 0


def test_language_model_learns_from_every_token(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(["w%d" % k for k in range(50)], k=r.choice([3, 40, 200, 900]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, i, t, False) for i, t in enumerate(texts)], "__lf_rid long, doc_id long, text string, held_out boolean").repartition(3)
    blocks = recurrent_lm.read_blocks(docs)
    vocabulary = recurrent_lm.learn_vocabulary(recurrent_lm.word_counts(blocks))
    got = recurrent_lm.task_weights(blocks, vocabulary, recurrent_lm.Network(vocabulary.core)).collect()
    assert sum(w["tokens"] for w in got) == sum(len(t.split()) + 1 for t in texts)


def test_language_model_score_in_plain_numpy(spark, docs, rows, monkeypatch):
    """The score of each text, word by word, from the same counts and weights but no batches, blocks or joins."""
    monkeypatch.setattr(recurrent_lm, "HEAD", 300)  # most words of the table come by the join
    monkeypatch.setattr(recurrent_lm, "CORE", 96)
    kept = []
    train = recurrent_lm.train
    monkeypatch.setattr(recurrent_lm, "train", lambda *a: kept.append((a[2], train(*a))) or kept[0][1])
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 4)): r["score"] for r in recurrent_lm.score(docs).collect()}
    vocabulary, net = kept[0]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    own = recurrent_lm.Words()
    for i, t in {(i, t) for i, t in rows if (t or "").count(" ") < 300}:
        h, last, score = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0, 0.0
        for w in [*tokens(t), None]:
            if w is None:
                symbol, place, shape = 0, 0, 0
            else:
                word = own.h[own.read(w)]
                place, shape = int(vocabulary.slots(word)[0]), int(recurrent_lm.shape_of(word)[0])
                symbol = place if 0 <= place < vocabulary.core else vocabulary.core + shape
            h = net.run(np.array([[last]]), [1], h)[0]
            score += net.log_prob(h, np.array([symbol]))[0] / np.log(10)
            if symbol >= vocabulary.core:
                score += vocabulary.tail_log10(np.array([counts[w]]), np.array([shape]))[0]
            last = symbol
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*tokens(t), None])
        assert got[i, len(tokens(t)) + 1, round(base, 4)] == pytest.approx(score, rel=2e-4, abs=1e-3)


def test_start_texts_are_bounded(docs, rows, monkeypatch):
    every = sorted({t or "" for _, t in rows})
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    assert sorted(recurrent_lm.start_texts(texts, len(rows))) == every
    monkeypatch.setattr(recurrent_lm, "START_BYTES", 3000)
    some = recurrent_lm.start_texts(texts, len(rows))
    assert 0 < len(some) < len(every) and sum(len(t.encode()) for t in some[:-1]) <= 3000


def test_archives(spark):
    html = ["<p>same</p>", "<p>same</p>", None, "", "é\r\n\r\nWARC/1.0", "x" * 300_000, "<p>same</p>"]
    rows = [(i, f"http://a/{i}" if i != 3 else None, h, "z") for i, h in enumerate(html)] + [(4, "http://a/4", html[4], "z"), (None, "u v\n", "solo", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in arc_convert.round_trip(pages).collect())
    expected = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        same = [j for j, _, g, _ in rows if (g or "").encode() == raw and j is not None]
        ref = max(same) if same and i is not None and max(same) != i else None
        expected[i, len(raw), arc_convert.base32_sha1(raw), "response" if ref is None else "revisit", ref] += 1
    assert got == expected
    assert arc_convert.round_trip(pages.limit(0)).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(13)
    x = r.standard_normal((300, 16))
    x[100:140] = x[:40] + 0.05 * r.standard_normal((40, 16))
    x[150:160] = x[7] * 3
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(300, x[5].tolist(), 1), (300, x[5].tolist(), 1), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1), (305, [1.0, 2.0], 1), (306, [], 1), (None, x[9].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int")
    got = {(r["vec_id"]): r for r in pivot_index.near_vectors(df).collect()}
    good = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids = [i for i, _ in good]
    unique = {}
    for i, v in good:
        unique.setdefault(i, v / np.linalg.norm(v))
    names = list(unique)
    c = np.stack(list(unique.values()))
    near = c @ c.T >= 0.9 - 1e-12
    for k, i in enumerate(names):
        assert got[i]["n_links"] == near[k].sum() - 1
    for i in (301, 302, 303, 304, 305, 306):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[150]["component_id"] == got[7]["component_id"] <= 7 and not got[300]["kept"] and len(ids) == 303
    assert pivot_index.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(14)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 700)] + [(1, 1), (None, 2)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x["v"]: x["comp"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_decontamination(spark, docs, empty):
    items = [(1, "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion."), (2, None), (3, ""), (4, "short"), (5, "Completely different words that nobody ever wrote in any of these documents at all."), (1, "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion.")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    text = "so: THE quick, brown fox jumped over the lazy dog while seven wizards quietly brewed a potion"
    more = spark.createDataFrame([(900, "lead " * 40 + text + " tail"), (901, "nothing here"), (902, None), (903, text[30:] + " x"), (900, text)], "doc_id long, text string")
    got = decontam.matches(more, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(900, 1), (900, 1)]
    assert all(0 < r["distance"] <= 8 for r in got)
    assert Counter(map(tuple, decontam.matches(more, bench, block_chars=60).collect())) == Counter(map(tuple, got))
    assert decontam.matches(docs, bench).count() == 0
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(more, bench.limit(0)).count() == 0
    assert decontam.contaminated(more, bench).first()["item_ids"] == [1]


def test_labelled_operators(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None if i < 5 else i % 2, "x") for i in range(91)] + [(1, 0, 1, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for module, name in ((line_crf, "quality"), (toxicity, "toxic")):
        got = module.classify(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert module.classify(empty, labels).count() == 0
        assert module.classify(docs, labels.limit(0)).count() == docs.count()
        limit = labelled.sample(docs, labels, name, module.FOLDS, module.HELD, limit=7)
        assert 0 < len(limit) <= 8
    held = {r["doc_id"]: r["held_out"] for r in line_crf.classify(docs, labels).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items() if i is not None)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = queries.op9_line_quality(spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    t = queries.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert q > 0.95 and t > 0.9
