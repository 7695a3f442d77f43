"""The text operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import duckdb
import pytest
import xxhash
from warpline.llm import bpe, fingerprints, grulm, langid, linededup, packing, quality, simhash, urlfilter, warc

TEXTS = [None, "", " \n ", "one", "One two three", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "é ß 漢字 " * 30, "x" * 5000, "The quick, brown fox.\nThe quick, brown fox.\nIt jumps!\n" * 20]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge texts, ties and repeated rows, a null id, and further columns that clash but for case."""
    rows = [(i, t, "z", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "z", 1), (None, "no id here", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string, k int").withColumnRenamed("k", "Doc_Id")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (None, 0), (9, None)], "doc_id long, quality int")


def naive_fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: naive_fingerprint(r.text) for r in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op3_simhash"](spark, sf).collect()}
    assert got == {i: (f"{v:016x}", find(i)) for i, v in fp.items()}


def test_simhash_masks_cover_every_small_difference():
    import itertools

    some = [tuple(sorted({i, (7 * i + 3) % 64, (13 * i + 29) % 64, (31 * i + 5) % 64})) for i in range(64)]
    for at in [*some, *itertools.combinations(range(0, 64, 7), 4)]:
        bits = sum(1 << i for i in at)
        assert any(not m & bits for m in simhash.masks(4))


def test_lines_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = linededup._lines(docs).collect()
    kinds, place = {}, {}
    for r in lines:
        low = r.line.lower()
        kinds[r.line] = {low[i : i + 12] for i in range(max(1, len(low) - 11))}
        place[r.line] = min(place.get(r.line, (1 << 62, 0)), (r.doc_id, r.line_no))
    names = list(kinds)
    parent, by = list(range(len(names))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, n in enumerate(names):
        for j in {j for s in kinds[n] for j in by[s]}:
            a, b = kinds[n], kinds[names[j]]
            if len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
        for s in kinds[n]:
            by[s].append(i)
    keep, at = {}, {n: i for i, n in enumerate(names)}
    for i, n in enumerate(names):
        keep[find(i)] = min(keep.get(find(i), (1 << 62, 0)), place[n])
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in linededup.line_classes(docs).collect()}
    assert got == {(r.doc_id, r.line_no): keep[find(at[r.line])] for r in lines}


@pytest.mark.parametrize("name", ["op2_warc", "op8_urlfilter"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = entry.queries()[name](spark, sf)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = con.execute("SELECT " + ", ".join(df.columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def test_url_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.NET/en/1?q#f", "x"), (3, "HTTP://A.Example.NET/en/1?q#f", "x")], "page_id long, url string, URL string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge_urls(df).collect()}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("a.example.net", "/en/1", "example.net/en/")}
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_warc_edges(spark):
    ddl = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    full = [(1, "http://www.a.example:80/x?b=2&a=1#f", 10, "response", '"v1"', None, {"A": "1", "Content-Length": "9"}), (2, "http://a.example/x?a=1&b=2", 20, "response", '"v2"', None, None)]
    again = [(3, "https://A.example/x?a=1&b=2&utm_source=q", 15, "revisit", 'W/"v1"', None, {"a": "2", "content-length": "0"}), (4, None, 15, "revisit", None, None, None), (5, "http://a.example/x?a=1&b=2", 20, "revisit", '"v3"', None, None)]
    got = {r.record_id: (r.resolved_id, r.outcome, r.headers) for r in warc.resolve_revisits(spark.createDataFrame(full + again, ddl)).collect()}
    assert got[3] == (1, "resolved", {"a": "2", "content-length": "9"})
    assert got[4] == (None, "orphan", {})
    assert got[5][:2] == (1, "mismatch")
    assert warc.resolve_revisits(spark.createDataFrame([], ddl)).count() == 0


def _encoder(name):
    from tokenizers import Tokenizer
    from warpline.llm.vocabulary import resolve

    t = Tokenizer.from_file(resolve(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, sf, docs):
    lib = _encoder("byte_bpe_50k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), docs):
        text = {r[0]: r[1] for r in df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select("_0", "_1").collect()}
        for r in bpe.bpe_round_trip(df).collect():
            ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_packing_holds_every_id_once(spark, sf):
    lib = _encoder("word_bpe_49k.json")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op6_packing"](spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(text)
    for i, parts in by_doc.items():
        ids = [*lib.encode(text[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_quality_counts_equal_a_plain_form(spark, docs, labels):
    def plain(text):
        words = (text or "").encode().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)

    got = [r for r in quality.quality_rules(docs, labels).collect() if r.doc_id is not None]
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = plain(TEXTS[r.doc_id])
        assert tuple(r[1:6]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_language_is_told_on_held_out_documents(spark, sf):
    got = {r.doc_id: r for r in entry.queries()["op4_langid"](spark, sf).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(lang)
    held = [i for i in got if got[i].held_out and lang[i] and got[i].lang_pred != "und"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)


def test_language_model_counts_and_scores(spark, sf):
    import math
    from collections import Counter

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    words = {r.doc_id: grulm.words_of(r.text) for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    seen = Counter(w for i in words if not held[i] for w in words[i])
    n = sum(seen.values())
    got = {r.doc_id: r for r in entry.queries()["op5_grulm"](spark, sf).collect()}
    for i, w in words.items():
        base = sum(math.log10((seen[x] + 1) / (n + len(seen) + 1)) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(x in seen for x in w), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, -base)
    assert sum(got[i].score for i in got if held[i]) > sum(got[i].base_score for i in got if held[i])


def test_fingerprints_of_equal_texts_are_equal(spark, docs):
    got = defaultdict(set)
    for r in fingerprints.neighbour_fingerprints(docs).collect():
        if r.doc_id is not None:
            got[TEXTS[r.doc_id] or ""].add(r.fingerprint)
            assert r.n_chars == len(TEXTS[r.doc_id] or "") and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(v) == 1 for v in got.values())


@pytest.mark.parametrize("run", [linededup.line_classes, simhash.simhash_components, langid.language_id, grulm.language_model_scores, packing.pack, fingerprints.neighbour_fingerprints, bpe.bpe_round_trip])
def test_empty_tables_and_edges(spark, docs, run):
    if run is not langid.language_id:
        assert run(docs).count() >= 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert run(empty).count() == 0


def test_pipeline_stages_keep_columns_and_drop_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "line dedup", "SimHash near-dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
