"""Cases where an operator once did less than the whole job."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.llm import components as union_find
from warpline.llm import grulm, langid, linededup, simhash
from warpline.llm.components import components
from warpline.plans import scratch as tables
from warpline.plans.scratch import Scratch


@pytest.fixture
def plans(monkeypatch):
    """(name, physical plan) of each table that is written, before it runs."""
    found, save = [], Scratch.save

    def note(self, df, name):
        found.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", note)
    return found


def test_members_of_buckets_are_not_broadcast(spark, plans):
    """They are 31 rows for each fingerprint, but Spark's estimate is the file of the fingerprints."""
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(200)]
    fps += [x ^ (1 << rng.randrange(63)) for x in fps]
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    scratch = Scratch(spark, "test")
    got = simhash.linked(scratch.save(rows, "fps"), 4, scratch).collect()
    assert len(got) == len(set(fps)) and len({r.root for r in got}) == 200
    joins = {name: plan for name, plan in plans if name in ("buckets", "open", "second")}
    assert len(joins) == 3 and not any("Broadcast" in plan for plan in joins.values())


def _char_shingles(line, k=12):
    line = line.lower()
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def test_lines_inside_long_runs_link_like_brute_force(spark):
    """One more character in a run without spaces, or in Thai, costs 12 shingles and not all that follow."""
    rng = random.Random(4)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    url = "https://a.example/" + draw("abcdefghijklmnopqrstuvwxyz0123456789/-_", 400)
    numbers = ",".join(str(rng.randrange(10**6)) for _ in range(120))
    thai = draw([chr(c) for c in range(0x0E01, 0x0E2F)], 300)
    emoji = draw(["\U0001f600", "\U0001f680", "\U00020000", "\U00020001", "a", "b", "c"], 200)
    words = " ".join(draw("abcdefgh", rng.randrange(2, 9)) for _ in range(40))
    lines = [x[:i] + extra + x[i:] for x, c in ((url, "q"), (numbers, "7"), (thai, "ฮ"), (emoji, "d"), (words, "z")) for i, extra in ((0, ""), (len(x) // 9, c), (len(x) // 2, c))]
    lines += [url[:200], thai[:280], "short", "Short", "shorts", draw("abc", 11), draw("abc", 12)]
    sets = [_char_shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                a1, b1 = sorted((find(i), find(j)))
                parent[b1] = a1
    want = [find(i) for i in range(len(lines))]
    assert want[1] == want[2] == 0 and want[7] == want[8] == 6  # the URL's and the Thai line's copies
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keep_doc_id for r in linededup.line_classes(docs).collect()}
    assert [got[i] for i in range(len(lines))] == want


def test_network_learns_from_every_token(spark, monkeypatch):
    """More documents than the sample of 1500 once held, the first of them long, in several shards."""
    monkeypatch.setattr(grulm, "SHARD_TOKENS", 20_000)
    texts = ["c d " * 20_000] + ["a b " * 4] * 4000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tokens = sum(len(grulm.words_of(t)) for t in texts)
    lex, net, total, _ = grulm.lexicon(grulm.count_tokens(docs))
    ids = [lex.encode(grulm.words_of(t))[1] for t in ("a b " * 4, "c d " * 500)]
    before = grulm.score(net, ids)
    assert total == tokens
    learned = grulm.fit(docs, lex, net, total, Scratch(spark, "fit"))
    assert len(learned) == grulm.ROUNDS and sum(learned) == tokens
    assert (grulm.score(net, ids) > before).all()


def test_large_steps_of_union_find_are_not_broadcast(spark, plans, monkeypatch):
    """However few bytes their files have."""
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 20, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    got = components(edges, Scratch(spark, "test")).collect()
    assert len(got) == 61 and len({r.root for r in got}) == 1
    first = next(plan for name, plan in plans if name == "edges0")
    assert "SortMergeJoin" in first and "Broadcast" not in first


def test_language_sample_costs_the_driver_little_beyond_its_arrays(spark):
    """The buckets and shares stay in Arrow memory; as Python numbers they took ten times that."""
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz     ")
    docs = spark.createDataFrame([(i, "".join(rng.choice(letters, 30_000)), "xy"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    tracemalloc.start()
    got = langid.labelled_sample(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    texts = {r.doc_id: r for r in docs.collect()}
    assert len(got) == 40 and sum(len(u) for _, u, _ in got) > 400_000
    for i in (0, 39):
        at, share = langid.shares_of(texts[i].text)
        assert got[i][0] == texts[i].lang and np.array_equal(got[i][1], at) and np.array_equal(got[i][2], share)
    assert peak < 8 << 20


def test_training_costs_no_more_than_the_lanes_that_go_on(monkeypatch):
    """One long piece among short ones: lanes that have ended are not computed to its end, and the loss stays."""
    rng = np.random.default_rng(6)
    counts, shapes = np.arange(64, 0, -1.0), np.ones(grulm.SHAPES)
    docs = [rng.integers(0, 64, n).astype(np.int32) for n in [2000] + [40] * 255]
    cells, gradients, losses = [], grulm.gradients, []

    def noted(net, ids, *rest):
        cells.append(ids.size)
        out = gradients(net, ids, *rest)
        losses.append(out[0])
        return out

    monkeypatch.setattr(grulm, "gradients", noted)
    net = grulm.new_network(counts, shapes)
    loss, seen = grulm.Trainer(net, 200).run(docs)
    assert seen == sum(map(len, docs)) and loss == pytest.approx(sum(losses))
    # the same with lanes that go on and count for nothing
    plain = grulm.Trainer(grulm.new_network(counts, shapes), 200)
    monkeypatch.setattr(grulm, "_windows", lambda *a, f=grulm._windows: ((i, t, fr, _whole(v), n) for i, t, fr, v, n in f(*a)))
    monkeypatch.setattr(grulm, "gradients", lambda net, i, t, fr, v, h: gradients(net, i, t, fr, v.true, h))
    assert plain.run(docs)[0] == pytest.approx(loss, rel=1e-5)
    assert sum(cells) <= 2 * seen


class _Whole(np.ndarray):
    """Says that all lanes go on, and holds which do."""


def _whole(valid):
    out = np.ones_like(valid).view(_Whole)
    out.true = valid
    return out


def test_long_texts_that_wait_are_scored_like_others(spark):
    """Each row comes out once, in whichever pool its text waits."""
    long = ["one two three " * n for n in (700, 900, 700, 1)]
    docs = spark.createDataFrame([(i, long[i % 4] if i % 3 else None) for i in range(24)], "doc_id long, text string")
    rows = {r.doc_id: r for r in grulm.language_model_scores(docs.repartition(2)).collect()}
    assert sorted(rows) == list(range(24))
    assert all(r.n_tokens == len((long[i % 4] if i % 3 else "").split()) + 1 for i, r in rows.items())
    for i in range(12):
        assert rows[i].score == pytest.approx(rows[i + 12].score, rel=1e-4)


def test_a_line_hash_is_made_once_for_each_place(spark, plans):
    """The filter of a line's small hashes made every hash of a short line once more."""
    docs = spark.createDataFrame([(1, "a line of some words")], "doc_id long, text string")
    linededup.line_classes(docs).collect()
    plan = next(p for name, p in plans if name == "signatures")
    tests = [x for x in plan.splitlines() if "Filter" in x and "xxhash64" in x]
    assert tests and all(x.count("xxhash64") == 1 and "cut" in x.split("xxhash64")[0] for x in tests)


def test_pairs_are_compared_by_arrays_and_long_ones_by_rows(spark, plans, monkeypatch):
    """Every shingle of every pair was a row of two aggregations; both ways give the same classes."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 90, 300)]
    lines = [x[:i] + "q" + x[i:] for x in base for i in (0, 7, 40)] + base
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    run = lambda: sorted(tuple(r) for r in linededup.line_classes(docs).collect())
    short = run()
    used = [p for name, p in plans if name in ("edges", "links")]
    assert any("array_intersect" in p for p in used) and not any("bit_or" in p for p in used)
    del plans[:]
    monkeypatch.setattr(linededup, "ARRAY_SHINGLES", 150)
    assert run() == short and len({r[2:4] for r in short}) < len(short)
    used = [p for name, p in plans if name in ("edges", "links")]
    assert any("array_intersect" in p and "bit_or" in p for p in used)


def test_further_links_take_only_the_roots_they_name(spark, monkeypatch):
    """Every node and its root were edges again, for another run of as many rounds."""
    seen = []
    monkeypatch.setattr(union_find, "components", lambda edges, scratch: seen.append(edges.count()) or components(edges, scratch))
    scratch = Scratch(spark, "test")
    link = lambda *pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = components(link(*[(0, i) for i in range(1, 200)], (300, 301), (400, 401)), scratch)
    assert union_find.extended(roots, link((1, 2)).limit(0), scratch) is roots
    got = {r.node: r.root for r in union_find.extended(roots, link((5, 301), (7, 301), (500, 501), (9, 10), (None, 3)), scratch).collect()}
    groups = [{*range(200), 300, 301}, {400, 401}, {500, 501}]
    assert set(got) == set().union(*groups) and all(len({got[x] for x in g}) == 1 and got[min(g)] in g for g in groups)
    assert len(set(got.values())) == 3 and seen == [5]


def test_union_find_rounds_share_their_code(spark):
    """A number of the round was written into the code, and each round's code was compiled anew."""
    code = lambda r: spark.range(3).select(union_find._spread(F.col("id"), r))._jdf.queryExecution().debug().codegenToSeq().apply(0)._2()
    assert code(0) == code(1)


def test_large_tables_of_line_dedup_send_a_map_of_their_keys(spark, plans, monkeypatch):
    """Leaders and places were broadcast whole up to a million rows, and the driver built their tables."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    docs = spark.createDataFrame([(i, x + "q" * (i // 6)) for i, x in enumerate(base * 3)], "doc_id long, text string")
    run = lambda: sorted(tuple(r) for r in linededup.line_classes(docs).collect())
    whole = run()
    assert not any(name == "map" for name, _ in plans) and sum(r[4] for r in whole) == 6
    del plans[:]
    monkeypatch.setattr(linededup, "WHOLE_ROWS", 3)
    assert run() == whole
    assert sum(name == "map" for name, _ in plans) == 2
    assert all("_bits" in p and "SortMergeJoin" in p for name, p in plans if name in ("buckets", "texts"))


def test_a_window_takes_two_softmaxes_whatever_its_classes(monkeypatch):
    """Each class of words had its own; the log-probabilities are those of the plain formula."""
    rng = np.random.default_rng(2)
    net = grulm.new_network(np.arange(200, 0, -1.0), np.ones(grulm.SHAPES), hidden=8)
    net.wc[:], net.wo[:] = rng.normal(0, 1, net.wc.shape), rng.normal(0, 1, net.wo.shape)
    states = rng.normal(0, 1, (300, 8)).astype(np.float32)
    target = rng.integers(0, net.words + grulm.SHAPES, 300)
    calls, softmax = [], grulm._softmax
    monkeypatch.setattr(grulm, "_softmax", lambda z, k: calls.append(z.shape) or softmax(z, k))
    got = grulm._log_probs(net, states, target)
    assert calls == [(300, net.word_classes + grulm.SHAPES), (int((target < net.words).sum()), grulm.CLASS_SIZE)]
    plain = lambda z: z - np.log(np.exp(z - z.max()).sum()) - z.max()
    for s, y, lp in zip(states.astype(np.float64), target, got):
        c = int(net.class_of(y))
        want = plain(s @ net.wc + net.bc)[c] + (plain(s @ net.wo[c] + net.bo[c])[y % grulm.CLASS_SIZE] if y < net.words else 0.0)
        assert abs(lp - want) < 1e-4
