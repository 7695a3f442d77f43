"""Values of the text operators against plain loops, planted cases and closed forms."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from warpline.llm import bpe, fingerprints, grulm, langid, linededup, packing, quality, simhash, urlfilter

# --- language ID


def _plain_grams(text):
    word, out = "", []
    for c in text.lower() + " ":
        if langid.regex.match(r"[\p{L}\p{M}]", c):
            word += c
        elif word:
            out.append(word)
            word = ""
    line = " " + " ".join(out) + " "
    return [line[i : i + o] for o in langid.ORDERS for i in range(len(line) - o + 1)]


def _plain_bucket(gram):
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BUCKET_BITS


@pytest.fixture(scope="module")
def language_model(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and lang is not null").orderBy("doc_id").collect()
    return langid.train([langid.shares_of(r.text) for r in rows], [r.lang for r in rows])


def test_language_scores_equal_a_plain_loop(language_model, monkeypatch):
    m = language_model
    texts = ["The and of thon.", "Les aux é de", None, "", "12 34 !", "Zu und die " * 900, "x", "ÉÈ ñ"]
    whole = langid.predict(m, texts)
    for text, (lang, score, rejected) in zip(texts, whole):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        grams = _plain_grams(text)
        z = m.bias.astype(float) + sum(m.weights[_plain_bucket(g)].astype(float) for g in grams) / len(grams)
        p = np.exp((z - z.max()) / m.temperature)
        assert lang == m.langs[z.argmax()] and abs(score - p.max() / p.sum()) < 1e-4
        assert rejected == (np.diff(np.sort(z)[-2:])[0] < m.threshold)
    monkeypatch.setattr(langid, "_BLOCK", 1 << 12)  # long texts in blocks, and several blocks
    assert [(a, b) for a, _, b in langid.predict(m, texts)] == [(a, b) for a, _, b in whole]


def test_noise_goes_and_clean_documents_stay(spark, sf, language_model):
    rng = random.Random(8)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(80)) for _ in range(50)]
    assert sum(r for _, _, r in langid.predict(language_model, noise)) >= 25
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]{2}'").collect()]
    assert sum(r for _, _, r in langid.predict(language_model, texts)) <= 0.02 * len(texts)
    assert 0.02 < language_model.temperature < 10


def test_one_language_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "ein text", "de"), (2, "noch einer", None), (None, None, "de"), (5, "x", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language_id(docs).collect()} <= {"de", "und"}
    assert {r.lang_pred for r in langid.language_id(docs.where("lang is null")).collect()} == {"und"}


# --- language model


def _small_net(seed=2):
    net = grulm.new_network(np.array([9.0, 5, 3, 2, 2, 1, 1]), np.ones(grulm.SHAPES), hidden=5, seed=seed)
    rng = np.random.default_rng(seed)
    for name in ("x", "u", "b", "wc", "bc", "wo"):
        v = getattr(net, name).astype(np.float64)
        setattr(net, name, v + 0.1 * rng.normal(size=v.shape))
    net.bo = net.bo.astype(np.float64)
    return net


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(grulm, "CLASS_SIZE", 4)
    net, rng = _small_net(), np.random.default_rng(3)
    ids, y = rng.integers(0, 16, (6, 3)), rng.integers(0, 7, (6, 3))
    y[2:4] += 8
    fresh, valid, h = np.zeros((6, 3)), np.ones((6, 3), dtype=bool), rng.normal(size=(3, 5))
    fresh[0, 1] = fresh[3, 0] = 1
    valid[5, 2] = False
    _, count, grads, _ = grulm.gradients(net, ids, y, fresh, valid, h)
    assert count == 17
    for p, g in zip(net.params(), grads):
        flat = p.reshape(-1)
        for k in rng.choice(flat.size, min(25, flat.size), replace=False):
            if abs(flat[k]) > 1e6:
                continue
            was, ends = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = was + step
                ends.append(grulm.gradients(net, ids, y, fresh, valid, h)[0])
            flat[k] = was
            assert abs((ends[0] - ends[1]) / 2e-5 / count - g.reshape(-1)[k]) < 1e-6


def _plain_likelihood(net, ids):
    hid = net.u.shape[0]
    h, before, total = np.zeros(hid), net.words + grulm.SHAPES, 0.0
    sig = lambda v: 1 / (1 + np.exp(-v))
    for y in ids:
        gx, a = net.x[before] + net.b, h @ net.u
        r, z = sig(gx[:hid] + a[:hid]), sig(gx[hid : 2 * hid] + a[hid : 2 * hid])
        n = np.tanh(gx[2 * hid :] + r * a[2 * hid :])
        h = (1 - z) * n + z * h
        out = h @ net.wc + net.bc
        c = y // grulm.CLASS_SIZE if y < net.words else net.word_classes + y - net.words
        total += out[c] - np.log(np.exp(out).sum())
        if y < net.words:
            out = h @ net.wo[c] + net.bo[c]
            total += out[y % grulm.CLASS_SIZE] - np.log(np.exp(out).sum())
        before = y
    return total


@pytest.mark.parametrize("lanes,window,steps", [(1, 4, 8), (3, 5, 10), (50, 32, 640)])
def test_windowed_scores_equal_one_loop(monkeypatch, lanes, window, steps):
    for name, v in (("CLASS_SIZE", 4), ("SCORE_LANES", lanes), ("SCORE_WINDOW", window), ("STEPS", steps)):
        monkeypatch.setattr(grulm, name, v)
    net, rng = _small_net(), np.random.default_rng(5)
    docs = [np.concatenate([rng.integers(0, 7, n), 7 + rng.integers(0, 8, n)]) for n in (1, 2, 9, 30, 4, 17, 100)]
    got = grulm.score(net, docs)
    assert np.allclose(got, [_plain_likelihood(net, d) for d in docs], rtol=1e-5)


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(grulm, "CLASS_SIZE", 4)
    net = _small_net()
    s = np.random.default_rng(1).normal(size=(1, 5))
    every = [grulm._log_probs(net, s, np.array([y]))[0] for y in range(7 + grulm.SHAPES)]
    assert abs(np.exp(every).sum() - 1) < 1e-9


def test_a_very_long_text_needs_little_memory():
    import tracemalloc

    net = grulm.new_network(np.ones(64), np.ones(grulm.SHAPES))
    docs = [np.zeros(3_000_00, dtype=np.int32)] + [np.zeros(20, dtype=np.int32)] * 191
    tracemalloc.start()
    windows = sum(1 for _ in grulm._windows(net, docs, 192, 32))
    assert windows == -(-300_000 // 32) and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_head_is_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(grulm, "HEAD", 40)
    words = [(f"w{i}".encode(), 1 + 1000 // (i + 1), 0) for i in range(30)] + [(f"r{i}".encode(), 1, 0) for i in range(500)]
    counts = spark.createDataFrame(words, "word binary, c long, shape int")
    got = [bytes(r["word"]) for r in grulm._head(counts)]
    assert got[:30] == [w for w, _, _ in sorted(words[:30], key=lambda r: (-r[1], r[0]))] and 30 <= len(got) <= 40


# --- packing


def test_histogram_packs_like_plain_shortest_pack_first():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([8, 50, 300])
        pieces = [rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 200))]
        packs: list[int] = []
        for n in sorted(pieces, reverse=True):  # the emptiest pack first
            if packs and packs[0] + n <= size:
                heapq.heappush(packs, heapq.heappop(packs) + n)
            else:
                heapq.heappush(packs, n)
        got = packing.pack_histogram(Counter(pieces), size)
        assert Counter({n: c for n, c in Counter(x for k, p in got for x in p for _ in range(k)).items()}) == Counter(pieces)
        assert all(sum(p) <= size for _, p in got)
        loads = Counter()
        for k, p in got:
            loads[sum(p)] += k
        assert sum(loads.values()) <= len(packs)


# --- fingerprints


def _shingle_hashes(text):
    words = (text or "").encode().lower().split()
    return [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []


def _jaccard(a, b):
    a, b = ({tuple(x) for x in _shingle_hashes(t)} for t in (a, b))
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_neighbours_equal_a_plain_loop(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 16)
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    off = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.to_text(fingerprints.sketch(text)) and r.edited_fingerprint == fingerprints.to_text(fingerprints.sketch(edited))
        for est, other in ((r.near_edited, edited), (r.near_next, after)):
            exact = _jaccard(text, other)
            small = len({tuple(x) for t in (text, other) for x in _shingle_hashes(t)}) <= fingerprints.K
            assert abs(est - exact) < (1e-9 if small else 0.25)
            off.append(est - exact)
    assert abs(sum(off) / len(off)) < 0.02


def test_sketches_merge_to_the_union(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    a, b = " ".join(rng.choices(words, k=3000)), " ".join(rng.choices(words, k=500))
    both = fingerprints.sketch(a + " " + "brk " * 1 + b)
    merged = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b))
    assert len(np.setdiff1d(merged, both)) <= 4 and len(merged) == fingerprints.K  # a few shingles straddle the joint
    s = fingerprints.sketch(a)
    assert abs(fingerprints.distinct_shingles(s) / len({tuple(x) for x in _shingle_hashes(a)}) - 1) < 0.3
    part = " ".join(a.split()[:1500])
    assert fingerprints.containment(fingerprints.sketch(part), s) > 0.75 and fingerprints.containment(fingerprints.sketch(b), s) < 0.1
    docs = spark.createDataFrame([(1, a), (2, b), (3, None)], "doc_id long, text string")
    rows = fingerprints.document_sketches(docs).selectExpr("1 as part", "sketch")
    got = fingerprints.merge_sketches(rows, "part").first().sketch
    assert [v + 2**63 for v in got] == [int(v) for v in merged]
    keyed = fingerprints.document_sketches(docs).selectExpr("nullif(doc_id % 2, 0) as part", "sketch")
    assert {r.part: len(r.sketch) for r in fingerprints.merge_sketches(keyed, "part").collect()} == {1: fingerprints.K, None: fingerprints.K}
    assert fingerprints.merge_sketches(keyed.limit(0), "part").count() == 0


# --- quality rules


def _planted():
    rng = np.random.default_rng(4)
    x = {"a": rng.uniform(size=3000), "b": rng.uniform(size=3000), "c": rng.uniform(size=3000)}
    bad = (x["a"] > 0.8) & (x["b"] > 0.5) | (x["c"] < 0.1)
    return x, bad


def test_planted_rules_are_found_row_by_row():
    x, bad = _planted()
    rules = quality.learn(x, bad)
    hit = np.zeros(len(bad), dtype=bool)
    for r in rules:
        hit |= quality._covers(r, x, len(bad))
    assert len(rules) >= 2 and any(len(r) >= 2 for r in rules)
    assert (hit == bad).mean() > 0.98 and bad[hit].mean() > 0.97


def test_rule_columns_equal_the_rules(spark):
    rules = [(quality.Condition("symbols_per_word", True, 0.5), quality.Condition("upper_share", False, 0.2)), (quality.Condition("distinct_share", False, 0.3),)]
    rng = random.Random(1)
    rows = [tuple(rng.randrange(0, 30) for _ in quality.COUNTS) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in quality.COUNTS))
    names = list(quality.features())
    got = df.select(*[quality.features()[n].alias(n) for n in names], quality.rule_column(rules).alias("rule")).collect()
    for r in got:
        x = {n: np.array([r[n]]) for n in names}
        assert r.rule == next((i for i, rule in enumerate(rules, 1) if quality._covers(rule, x, 1)[0]), 0)


def test_quality_learns_from_labels_and_takes_empty_tables(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(40)) for _ in range(150)]
    bad = [" ".join(word() + ("#*" if rng.random() < 0.7 else "") for _ in range(40)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(300, None), (301, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(got[i].kept == (i < 150) for i in range(300))
    assert not got[300].kept and got[301].base_failed
    empty = docs.limit(0)
    assert quality.quality_rules(empty, labels).count() == 0 and quality.keep_good(empty, labels.limit(0)).columns == docs.columns
    assert {r.doc_id for r in quality.keep_good(docs, labels.limit(0)).collect()} == set(range(300))


# --- URL filter


def test_url_training_equals_a_plain_loop():
    labelled = [("http://a.example/x", 1), ("http://b.example/yy", 0), (None, 0), ("http://casino.example/win", 1)]
    w, bias = {}, 0.0
    rows = [Counter(urlfilter.grams(urlfilter._split(u)[0], 0) + urlfilter.grams(urlfilter._split(u)[1], 17)) for u, _ in labelled]
    for _ in range(30):
        p = [1 / (1 + math.exp(-(bias + sum(w.get(k, 0.0) * n for k, n in r.items())))) for r in rows]
        g = [(a - y) / len(rows) for a, (_, y) in zip(p, labelled)]
        step = Counter()
        for r, e in zip(rows, g):
            for k, n in r.items():
                step[k] += n * e
        w = {k: w.get(k, 0.0) - 0.5 * (step[k] + 1e-3 * w.get(k, 0.0)) for k in step}
        bias -= 0.5 * sum(g)
    got, b = urlfilter.train(labelled, rounds=30)
    assert abs(b - bias * urlfilter._SCALE) <= 1
    assert all(abs(got[k] - w.get(k, 0.0) * urlfilter._SCALE) <= 1 for k in range(urlfilter.BUCKETS))


# --- rows of one doc_id, and stages at their edges


def test_rows_of_one_id_and_two_texts_lose_nothing_unique(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words("a")), (1, words("b")), (2, words("a")), (2, words("c")), (2, words("c"))], "doc_id long, text string")
    kept = sorted(map(tuple, simhash.keep_one(docs).collect()))
    assert kept == sorted([(1, words("a")), (1, words("b")), (2, words("c"))])
    lines = spark.createDataFrame([(1, words("a") + "\n" + words("x")), (1, words("b") + "\n" + words("y")), (2, words("z") + "\n" + words("y"))], "doc_id long, text string")
    left = sorted(r.text for r in linededup.dedup_lines(lines).collect())
    assert left == sorted([words("a") + "\n" + words("x"), words("b") + "\n" + words("y"), words("z")])


@pytest.mark.parametrize("at", range(4))
def test_stages_take_nulls_ties_repeats_and_clashing_names(spark, sf, at):
    stage = corpus_pipeline.STAGES[at][1]
    text = "The of rend and threlyes. " + " ".join(f"w{i}on" for i in range(40))
    rows = [(None, None, "en", "s", 0, "p"), (1, None, None, None, None, "p"), (2, "", "en", "s", 0, "p"), (3, text, "en", "s", len(text), "p"), (3, text, "en", "s", len(text), "p"), (4, text + "\n" + text, "en", "s", 9, "p"), (5, "x" * 300_000, "en", "s", 9, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, TEXT string")
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and out.count() <= len(rows)
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_long_texts_encode_like_the_library(spark):
    from tokenizers import Tokenizer
    from warpline.llm.vocabulary import resolve

    text = ("Some words, 123 more é漢 \n\n  and   spaces. " * 110_000)[:4_500_000]
    for name, run in (("byte_bpe_50k.json", lambda d: bpe.bpe_round_trip(d).first().n_tokens), ("word_bpe_49k.json", lambda d: packing.pack(d).groupBy().sum("length").first()[0] - 1)):
        lib = Tokenizer.from_file(resolve(name))
        lib.no_truncation()
        lib.no_padding()
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert run(docs) == len(lib.encode(text, add_special_tokens=False).ids)
