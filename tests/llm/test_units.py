"""Pieces of the training-data operators against plain versions."""

import random

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticeflow.llm import arc_convert, bitplane, bwt_dedup, chunk_bpe, components, decontam, line_crf, pivot_index, recurrent_lm, shingle_join, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = st.lists(st.sampled_from(["the", " of", "  ", "\n", "\t", "élan", "don't", "<|endoftext|>", "<|startoftext|>", "1234", "日本語", "é", " ", " x", "İ", "ΑΣ", "!!", "A.B", "word ", "x" * 50, "\x1c", "\x85", "\U0001f600", "'s", "ÀÉ"]), max_size=40)
TEXTS = st.one_of(st.text(max_size=200), PIECES.map("".join), PIECES.map(" ".join))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_chunked_encoding_is_the_library_s(texts):
    plain = Tokenizer.from_file(BYTE)
    own = chunk_bpe.codec(BYTE, 4)
    for t in [*texts, "".join(texts) * 3]:
        t = t.encode("utf-8", "ignore").decode()
        ids = plain.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got[0] == ",".join(map(str, ids)) and got[1] == len(ids)
        assert got[2] == plain.decode(ids, skip_special_tokens=False)


def test_chunks_are_shared_across_documents():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    body = " ".join(words)
    own = chunk_bpe.ChunkCodec(BYTE)
    own.encode("some start. " + body)
    before = own.reused
    own.encode("another one, longer! " + body + " and an end")
    assert own.reused - before > 0.8 * len(chunk_bpe.cut_points(np.frombuffer(body.encode(), np.uint8)))


def test_every_token_encodes_to_itself():
    own = chunk_bpe.codec(BYTE)
    assert all(own.ranked._encode_single_piece(b) == [i] for i, b in own.bytes_of.items() if b not in (k.encode() for k in own.special))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_word_encoding_is_the_library_s(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    plain = Tokenizer.from_file(WORD)
    ids, lengths = bitplane.word_encoder(WORD).encode(texts)
    expected = [plain.encode(t, add_special_tokens=False).ids + [bitplane.END_ID] for t in texts]
    assert ids.tolist() == [i for e in expected for i in e] and lengths.tolist() == [len(e) for e in expected]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]), st.integers(1, 64))
def test_plane_files_round_trip(ids, planes, block):
    a = np.array(ids, dtype=np.uint32)
    content = bitplane.write_file(a, [7], [len(ids)], planes, block)
    assert bitplane.read_ids(content).tolist() == ids
    assert bitplane.read_ids(content, 5, 20).tolist() == ids[5:20]
    assert bitplane.read_footer(content)["doc_ids"] == [7]


def test_arc_versions_and_lengths():
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nline\n\nhttp://x 1 2 3 4\nbody"
    for version in (1, 2):
        data = arc_convert.arc_header("a", version) + arc_convert.arc_record(version, "http://a b/", block) + arc_convert.arc_record(version, "u", b"")
        rows = list(arc_convert.parse_arc(data))
        assert [b for _, b in rows] == [block, b""] and rows[0][0]["URL"] == "http://a%20b/"
        record = arc_convert.warc_record(*rows[0])
        assert record == arc_convert.warc_record(*rows[0])
        (fields, back), = arc_convert.parse_warc(record)
        assert back == block and fields["WARC-Date"] == "2020-01-01T00:00:00Z"
        (fields, back), = arc_convert.parse_warc(arc_convert.warc_record(*rows[0], refers_to="9"))
        assert fields["WARC-Type"] == "revisit" and back.endswith(b"\r\n\r\n") and b"body" not in back
        with pytest.raises(ValueError):
            list(arc_convert.parse_arc(data[:-10]))
    assert arc_convert.warc_date("19970203") == "1997-02-03T00:00:00Z"


def plain_repeats(texts):
    """{(text, start)} of strings of LENGTH bytes that stand earlier."""
    seen, out = set(), set()
    for k, t in enumerate(texts):
        for i in range(len(t) - bwt_dedup.LENGTH + 1):
            s = t[i : i + bwt_dedup.LENGTH]
            if s in seen:
                out.add((k, i))
            seen.add(s)
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 100_000), st.integers(2, 9), st.integers(1, 5))
def test_merged_transforms_find_every_repeat(seed, n, shards):
    r = random.Random(seed)
    base = [bytes(r.choices(b"abc \0\xff", k=r.randint(60, 200))) for _ in range(3)]
    texts = [b"".join(r.choices(base, k=r.randint(1, 3)))[r.randint(0, 40) :] for _ in range(n)]
    texts = list(dict.fromkeys(texts))
    ids = np.arange(len(texts))
    rid, at = bwt_dedup.repeats(texts, ids, ids, np.zeros(len(texts), np.int64), shards)
    assert set(zip(rid.tolist(), at.tolist(), strict=True)) == plain_repeats(texts)


def test_every_string_has_one_region():
    r = random.Random(3)
    texts = [bytes(r.choices(b"ab cd", k=k)) for k in (0, 50, 99, 100, 101, 500, 3000)] + [b"aaaa " * 200]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h, place, s0, s1 = bwt_dedup.regions(data, ends)
    covered = [i for a, b in zip(s0, s1, strict=True) for i in range(a, b + 1)]
    expected = [e - len(t) + i for t, e in zip(texts, ends, strict=True) for i in range(len(t) - 99)]
    assert covered == expected and (place >= s0).all() is not None
    alone = bwt_dedup.regions(np.frombuffer(texts[6], np.uint8), np.array([3000]))
    at = ends[5]
    mine = (s0 >= at) & (s1 < ends[6])
    assert (h[mine] == alone[0]).all() and (place[mine] - at == alone[1]).all()


def test_remaining_bytes():
    assert bwt_dedup.remaining(b"0123456789", [(2, 4), (3, 6), (8, 10)]) == (b"0167", 6, 2)
    assert bwt_dedup.remaining(b"0123", []) == (b"0123", 0, 0)
    assert bwt_dedup.remaining(b"0123", [(0, 2), (2, 4)]) == (b"", 4, 1)


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", max_size=60))
def test_bit_parallel_distance(p, t):
    assert decontam.search(decontam.masks(p), len(p), t)[0] == plain_distance(p, t)


def test_pigeonhole_finds_every_item_within_its_budget():
    r = random.Random(5)
    for seed in range(30):
        item = "".join(r.choices("abcdefgh ", k=120)).strip()
        edited = list(item)
        for _ in range(r.randint(0, 16)):
            i = r.randrange(len(edited))
            edited[i : i + 1] = r.choice([[], ["z"], [edited[i], "q"]])
        text = "".join(r.choices("klmnop ", k=200)) + " " + "".join(edited) + " " + "".join(r.choices("klmnop ", k=90))
        index = decontam.ItemIndex([(seed, item)])
        p, t = decontam.normalise(item), decontam.normalise(text)
        d = plain_distance(p, t)
        k = index.nodes[0].budget
        found = index.find(text)
        assert (d <= k) == bool(found)
        if found:
            assert found[0][1] == d and plain_distance(p, t[found[0][2] : found[0][3]]) == d


def test_lexicon_automaton_against_distances():
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1], min(row)

    r = random.Random(6)
    words, stems = ["moron", "scum", "disgusting"], ["veq", "achlich"]
    lexicon = toxicity.Lexicon(words, stems)
    tried = ["moron", "morron", "mor0n", "moon", "scum", "scun", "disgustin", "disgsting", "dsgustinq", "vequ", "veq", "vexx", "achlicher", "achlixher", "achliher", "clean", ""]
    tried += ["".join(r.choices("acdeghilmnoqrsuv", k=r.randint(1, 11))) for _ in range(500)]
    for w in tried:
        best = []
        for t, k in [("moron", 1), ("scum", 0), ("disgusting", 2)]:
            d = levenshtein(w, t)[0]
            best += [d] if d <= k else []
        for t, k in [("veq", 0), ("achlich", 1)]:
            d = min(levenshtein(w[:n], t)[0] for n in range(len(w) + 1))
            best += [d] if d <= k else []
        assert lexicon.read(w) == (1 + min(best) if best else 0), w


def test_toxicity_learns_and_tells_quotation():
    r = random.Random(7)
    clean = lambda: " ".join("".join(r.choices("aeiourtn", k=4)) for _ in range(60))
    rows = [(clean() + (" you stupid moron " + clean() if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    model = toxicity.fit(rows)
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in rows)
    assert model.score(clean() + " you stupid morron " + clean()) >= 0.5
    found, _ = model.matches('he wrote and said quote "stupid" and quotes as said')
    assert found and not found[0][3]
    assert model.score("") < 0.5
    assert toxicity.fit([]).score("stupid") < 0.5


def test_crf_marginals_against_enumeration():
    r = np.random.default_rng(8)
    counts = np.array([1, 4, 2])
    score, trans = r.standard_normal((7, 2)), r.standard_normal((2, 2))
    m, z, pairs = line_crf.forward_backward(score, trans, counts)
    at, total, log_z = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        weights, marg = 0.0, np.zeros((n, 2))
        both = np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(score[at + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            weights += w
            for i in range(n):
                marg[i, y[i]] += w
            for i in range(n - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(m[at : at + n], marg / weights)
        total += both / weights
        log_z += np.log(weights)
        at += n
    assert np.allclose(pairs, total) and z == pytest.approx(log_z)


def test_quality_learns_lines():
    r = random.Random(9)
    good = lambda: " ".join("".join(r.choices("aeiourtn", k=5)) for _ in range(12)).capitalize() + "."
    bad = lambda: " | ".join("".join(r.choices("aeiourtn", k=5)).upper() + "!!" for _ in range(12))
    rows = [("\n".join(good() for _ in range(5)), 1) if k % 3 else ("\n".join([good(), bad(), bad(), good(), bad()]), 0) for k in range(150)]
    model = line_crf.fit(rows)
    s = model.score([t for t, _ in rows])
    assert ((s >= line_crf.THRESHOLD) == np.array([bool(q) for _, q in rows])).all()
    assert len(model.score([""])) == 1 and len(model.score([])) == 0
    assert line_crf.fit([]).score(["x"])[0] >= line_crf.THRESHOLD


def test_network_gradients_match_differences():
    net = recurrent_lm.Network(40, seed=1)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    r = np.random.default_rng(2)
    y = r.integers(0, 40 + recurrent_lm.SHAPES, (5, 3))
    x = r.integers(0, 40 + recurrent_lm.SHAPES, (5, 3))
    live, h0 = [3, 3, 2, 2, 1], r.standard_normal((3, recurrent_lm.HIDDEN)) * 0.1
    g, _, loss, n = net.gradients(x, y, live, h0)
    assert n == 11
    for name in net.NAMES:
        a = getattr(net, name)
        for i in r.integers(0, a.size, 6):
            old = a.reshape(-1)[i]
            if old < -1e3:
                continue
            a.reshape(-1)[i] = old + 1e-5
            up = net.gradients(x, y, live, h0)[2]
            a.reshape(-1)[i] = old - 1e-5
            down = net.gradients(x, y, live, h0)[2]
            a.reshape(-1)[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name].reshape(-1)[i], rel=1e-3, abs=1e-4), name


def test_windows_do_not_change_a_score(monkeypatch):
    net = recurrent_lm.Network(40, seed=3)
    r = np.random.default_rng(4)
    rows = [r.integers(0, 40 + recurrent_lm.SHAPES, k) for k in (1, 5, 33, 64, 200)]
    first = recurrent_lm.score_sequences(net, rows)
    one = np.array([recurrent_lm.score_sequences(net, [s])[0] for s in rows])
    monkeypatch.setattr(recurrent_lm, "WINDOW", 7)
    assert np.allclose(first, one, rtol=1e-4) and np.allclose(first, recurrent_lm.score_sequences(net, rows), rtol=1e-4)


def test_network_is_a_distribution():
    net = recurrent_lm.Network(40, seed=5)
    h = np.random.default_rng(6).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    every = np.arange(40 + recurrent_lm.SHAPES)
    assert np.exp(net.log_prob(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_vocabulary_is_a_distribution():
    words = {(k << 5) | (k % 32): c for k, c in zip(range(1, 400), [*range(60, 0, -1), *[1] * 339], strict=True)}
    head = sorted(words.items(), key=lambda x: -x[1])
    shapes, once = np.zeros(32, int), np.zeros(32, int)
    for h, c in words.items():
        shapes[h % 32] += c
        once[h % 32] += c == 1
    v = recurrent_lm.Vocabulary([(recurrent_lm.END, 10), *head], 10 + sum(words.values()), len(words) + 1, shapes, once)
    v.core = 20
    core = {h for h, _ in head[:19]}
    left = np.zeros(32)
    for h, c in words.items():
        left[h % 32] += c if h not in core else 0
    v.shape_tokens, v.unknown = left, np.full(32, 0.1)
    for s in range(32):
        total = sum(10 ** v.tail_log10(np.array([c]), np.array([s]))[0] for h, c in words.items() if h % 32 == s and h not in core) + 10 ** v.tail_log10(np.array([0]), np.array([s]))[0]
        assert total == pytest.approx(1)


def test_prefix_keys_meet_for_every_linking_pair():
    r = np.random.default_rng(10)
    universe = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    for trial in range(200):
        n = int(r.integers(9, 1500))
        base = r.choice(universe, n, replace=False)
        drop = int(r.integers(0, max(1, n // 19) + 1))
        other = np.concatenate([base[drop:], r.choice(np.setdiff1d(universe, base), int(r.integers(0, 3)))])
        a, b = np.unique(base), np.unique(other)
        i = len(np.intersect1d(a, b))
        frequent = np.sort(r.choice(universe, int(len(universe) * r.random()), replace=False))
        if 100 * i >= 90 * (len(a) + len(b) - i) and len(a) != i:
            ka, kb = shingle_join.keys_of(a, frequent, 90)[0], shingle_join.keys_of(b, frequent, 90)[0]
            assert len(np.intersect1d(ka, kb)), (n, drop, trial)


def test_shared_sizes():
    r = np.random.default_rng(11)
    sets = [np.unique(r.integers(0, 40, k)) for k in (5, 20, 1, 30)]
    got = shingle_join.shared_sizes(sets[:2], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


def test_pivot_recall_against_brute_force():
    r = np.random.default_rng(12)
    x = r.standard_normal((1500, 64))
    y = x + 0.45 * r.standard_normal(x.shape)
    v = pivot_index.unit(np.concatenate([x, y]))
    pivots = pivot_index.choose_pivots(v[:400], 128)
    near = pivot_index.nearest(v, pivots, pivot_index.PREFIX)
    truth = {(i, j) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.9, 1)), strict=True)}
    shared = lambda i, j: len(set(near[i]) & set(near[j]))
    assert len(truth) > 500 and np.mean([shared(i, j) >= pivot_index.SHARED for i, j in truth]) >= 0.9
    i, j = pivot_index.link_blocks(v, near, v, near, int(near[0, 0]), len(pivots), 0.9, 2, True)
    assert {(int(a), int(b)) for a, b in zip(i, j, strict=True)} <= truth


def test_forest():
    f = components.forest([(1, 2), (2, 3), (3, 1), (9, 8)])
    assert sorted(f) == [(2, 1), (3, 1), (9, 8)]
