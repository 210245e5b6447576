"""Vectors, archives, and the pipeline."""

import gzip
import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.llm import files, queries, topk, warc
from cytolake.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


# -- 5 -------------------------------------------------------------------------------------------------------------


def brute(rows, every, k=5):
    ok = [(i, np.floor(np.array(v, float) * 256).astype(object)) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sorted(((i, q) for i, q in ok if i % every == 0), key=lambda x: x[0]):
        best = sorted((-int(q.astype(float) @ v.astype(float)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("mode", ["plain", "ties", "lengths", "near"])
def test_top_k_is_exact(spark, mode):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(700, 8))
    if mode == "ties":
        v[100:600] = v[3]
    if mode == "lengths":
        v *= rnd.lognormal(0, 2, (700, 1))
    if mode == "near":
        v[1::2] = v[::2] * rnd.uniform(0.9, 1.1, (350, 1)) + rnd.normal(scale=0.02, size=(350, 8))
    rows = [(i, v[i].tolist()) for i in range(700)]
    rows += [(700, None), (750, [1.0, None] * 4), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (900, [1.0, 2.0]), (None, [1.0] * 8), (901, [0.5, 1.0])]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk.top_k(df).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, 50)


@pytest.mark.parametrize("mode", ["plain", "ties", "lengths"])
def test_grid_of_many_cells(spark, mode):
    """Blocks of queries and chunks of rows of the least size."""
    rnd = np.random.default_rng(7)
    v = rnd.normal(size=(6000, 4))
    if mode == "ties":
        v[100:5600] = v[3]
    if mode == "lengths":
        v *= rnd.lognormal(0, 2, (6000, 1))
    rows = [(i, v[i].tolist()) for i in range(6000)]
    n = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(n, n.where("id % 2 = 0"), 5, topk.BUCKET * 4, topk.BUCKET * 4).where("query_id % 40 = 0").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(rows, 40)


def test_the_plan_does_not_grow_with_the_queries(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(5000)], "vec_id long, embedding array<double>")
    n = topk.integers(df)
    size = lambda few: len(topk.search(n, n.where(few), 5, topk.BUCKET * 2)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size("id = 1") == size("id >= 0")


def test_top_k_of_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("false")).count() == 0


def test_products_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 1.0 + 1 / 256])], "vec_id long, embedding array<double>")
    big = int(256 * 1e7) ** 2
    assert [tuple(r) for r in topk.top_k(df).orderBy("rank").collect()] == [(0, 1, 2, big + 256 * 257), (0, 2, 1, big + 256 * 256)]


# -- 9 -------------------------------------------------------------------------------------------------------------


def pages_of(spark):
    long = "é" * 600
    rows = [(1, "u", "a" * 999), (2, "u", "a" * 999), (3, "u", long), (9, "u\r\nx", long), (5, None, long), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "b" * 1000), (10, "u", "c" * 300_000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, sha1 string, path string")


@pytest.mark.parametrize("sent", [warc.SENT_LEADS, 0])
def test_warc_round_trip(spark, sent):
    rows, df = pages_of(spark)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = max((x for x in groups[raw] if x is not None), default=None)
        dup = len(raw) >= 1000 and len(groups[raw]) > 1 and i != lead
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if dup else "response", lead if dup else None))
    got = [tuple(r) for r in warc.round_trip(df.repartition(3), sent_leads=sent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).count() == 0


def test_a_page_copied_often(spark):
    """One payload on most pages, dealt out to several keys."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 100 > 0, F.repeat(F.lit("e"), F.lit(1500))).otherwise(F.repeat(F.lit("f"), F.lit(1200))).alias("html"))
    for sent in (warc.SENT_LEADS, 0):
        got = warc.marked(df, sent_leads=sent, copies=100).groupBy("refers_to").count().collect()
        assert {(r.refers_to, r["count"]) for r in got} == {(2999, 2969), (2900, 29), (None, 2)}


def test_payloads_come_back(spark):
    rows, df = pages_of(spark)
    archives = warc.write(df, fresh_path(spark, "warc"), file_bytes=2000)
    assert archives.count() > 1
    seen = {}
    for a in archives.collect():
        raw = gzip.decompress(files.system(a.path)[0].open_input_file(files.system(a.path)[1]).read())
        assert raw.startswith(b"WARC/1.1")
        for r in warc.Reader(files.Blocks(a.path, 512)).records():
            seen[r.page()] = (r.headers["warc-type"], r.payload())
    for i, _, h in rows:
        if seen[i][0] == "response":
            assert seen[i][1] == (h or "").encode()


@pytest.mark.parametrize("zipped", [True, False])
def test_long_headers_are_read(tmp_path, zipped):
    fixed = warc.record("response", 0, "", b"", hashlib.sha1(b"").hexdigest(), None).find(b"\r\n\r\n")
    sizes = [1, *range(warc.HEADER_BYTES - fixed - 5, warc.HEADER_BYTES - fixed + 2), 3 * warc.HEADER_BYTES]  # the end at each side of a step
    recs = [warc.record("response", k, "u" * n, b"payload", hashlib.sha1(b"payload").hexdigest(), None) for k, n in enumerate(sizes)]
    path = tmp_path / "long.warc"
    path.write_bytes(b"".join(warc.member(r) if zipped else r for r in recs))
    reader = warc.Reader(files.Blocks(f"file://{path}"))
    assert [(r.page(), len(r.headers["warc-target-uri"]), r.payload()) for r in reader.records()] == [(k, n, b"payload") for k, n in enumerate(sizes)]
    assert not reader.gaps


def test_round_trip_of_a_long_url(spark):
    df = spark.createDataFrame([(1, "data:" + "x" * 200_000, "a"), (2, "u", "b")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == [1, 2]
    archives = warc.write(df.coalesce(1), fresh_path(spark, "warc"))
    assert warc.scan(archives.withColumn("records", F.lit(2)), whole=True).count() == 2
    with pytest.raises(Exception, match="2 records read of 3 written"):
        warc.scan(archives.withColumn("records", F.lit(3)), whole=True).collect()


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(spark, tmp_path, zipped):
    rnd = random.Random(0)
    recs = [warc.record("response", k, "http://x", bytes(rnd.randrange(256) for _ in range(300)), hashlib.sha1(b"").hexdigest(), None) for k in range(30)]
    raw = [warc.member(r) if zipped else r for r in recs]
    broken = [bytearray(x) for x in raw]
    broken[4][len(raw[4]) // 2] ^= 255
    del broken[11][40:60]
    broken[20][0:2] = b"??"
    path = tmp_path / ("x.warc.gz" if zipped else "x.warc")
    path.write_bytes(b"".join(map(bytes, broken)) + raw[0][:50])
    reader = warc.Reader(files.Blocks(f"file://{path}", 1000))
    got = list(reader.records())
    assert {r.page() for r in got} == set(range(30)) - {4, 11, 20}
    covered = sorted([(r.start, r.end) for r in got] + [(g.start, g.end) for g in reader.gaps])
    assert covered[0][0] == 0 and covered[-1][1] == path.stat().st_size and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    records, log = warc.salvage(spark.createDataFrame([(f"file://{path}",)], "path string"))
    assert [(r.start, r.end) for r in log.orderBy("start").collect()] == [(g.start, g.end) for g in reader.gaps]
    assert [r.page_id for r in records.orderBy("start").collect()] == [r.page() for r in got]


def test_damaged_lengths_are_not_read(tmp_path, monkeypatch):
    """A length beyond the file, one within it, and a member that expands far beyond what it says."""
    monkeypatch.setattr(warc, "HELD_BYTES", 1000)
    one = lambda k: warc.record("response", k, "u", b"x" * 5000, hashlib.sha1(b"").hexdigest(), None)
    wrong = lambda r, n: r.replace(b"\r\nContent-Length: " + str(len(r.partition(b"\r\n\r\n")[2]) - 4).encode(), b"\r\nContent-Length: " + n)
    held = one(5).replace(b"WARC-Block-Digest", b"WARC-Other")
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join([one(0), wrong(one(1), b"9999999999999"), one(2), wrong(one(3), b"12000"), one(4), held, wrong(held, b"7000"), one(6)]))
    reader = warc.Reader(files.Blocks(f"file://{path}"))
    assert [r.page() for r in reader.records()] == [0, 2, 4, 5, 6]
    assert [g.reason for g in reader.gaps] == ["block is cut off", "block digest differs", "no record after the block"]
    bomb = warc.member(wrong(one(1), b"10") + b"0" * 50_000_000)
    path.write_bytes(warc.member(one(0)) + bomb + warc.member(one(2)))
    reader = warc.Reader(files.Blocks(f"file://{path}"))
    assert [r.page() for r in reader.records()] == [0, 2] and reader.gaps[0].reason == "member is longer than its header says"


def test_members_of_all_kinds(tmp_path):
    """Payloads that pack well and badly, of sizes about the steps of reading, in the middle and at the end of a file."""
    rnd = random.Random(8)
    sizes = [0, 1, 900, 65_000, 65_536, 65_537, 131_072, 400_000, 1 << 20]
    texts = [t for n in sizes for t in (b"a" * n, rnd.randbytes(n), (b"<p>some text</p>" * n)[:n])]
    path = tmp_path / "x.warc.gz"
    for last in range(len(texts)):
        order = [*texts[: last % 5], texts[last]]
        path.write_bytes(b"".join(warc.member(warc.record("response", k, "u" * (k * 20_000), t, hashlib.sha1(t).hexdigest(), None)) for k, t in enumerate(order)))
        reader = warc.Reader(files.Blocks(f"file://{path}"))
        assert [(r.page(), r.payload()) for r in reader.records()] == list(enumerate(order)) and not reader.gaps


@pytest.mark.parametrize("digest", [True, False])
@pytest.mark.parametrize("change", [700, -100, -3000, 5263])
def test_damaged_lengths_at_the_default_bound(tmp_path, digest, change):
    """Plain records of a few kB, the first length (or the third) wrong: nothing is swallowed, and every lost record is in the log."""
    rnd = random.Random(3)

    def one(k, by=0):
        r = warc.record("response", k, "u", bytes(rnd.randrange(97, 123) for _ in range(5000)), hashlib.sha1(b"").hexdigest(), None)
        if not digest:
            r = r.replace(b"WARC-Block-Digest", b"WARC-Other")
        n = len(r.partition(b"\r\n\r\n")[2]) - 4
        return r.replace(b"\r\nContent-Length: %d\r\n\r\nHTTP" % n, b"\r\nContent-Length: %d\r\n\r\nHTTP" % (n + by))

    path = tmp_path / "x.warc"
    raw = [one(0, change), one(1), one(2, change), one(3), one(4)]
    path.write_bytes(b"".join(raw))
    reader = warc.Reader(files.Blocks(f"file://{path}"))
    assert [r.page() for r in reader.records()] == [1, 3, 4]
    at = [sum(map(len, raw[:k])) for k in range(6)]
    assert [(g.start, g.end) for g in reader.gaps] == [(at[0], at[1]), (at[2], at[3])]


def test_a_record_before_a_damaged_one_stays(tmp_path):
    one = lambda k: warc.record("response", k, "u", b"x" * 3000, hashlib.sha1(b"").hexdigest(), None).replace(b"WARC-Block-Digest", b"WARC-Other")
    path = tmp_path / "x.warc"
    path.write_bytes(one(0) + b"?" + one(1)[1:] + one(2))
    reader = warc.Reader(files.Blocks(f"file://{path}"))
    assert [r.page() for r in reader.records()] == [0, 2] and len(reader.gaps) == 1


@pytest.mark.parametrize("zipped", [True, False])
def test_a_header_without_end_is_not_held(tmp_path, monkeypatch, zipped):
    monkeypatch.setattr(warc, "HEADER_MOST", 1 << 20)
    good = warc.record("response", 1, "u", b"x", hashlib.sha1(b"x").hexdigest(), None)
    endless = b"WARC/1.1\r\nX: " + b"a" * 60_000_000
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(map(warc.member, (endless, good))) if zipped else endless + b"\r\n" + good)
    reader = warc.Reader(files.Blocks(f"file://{path}", 1 << 16))
    tracemalloc.start()
    started = time.perf_counter()
    assert [r.page() for r in reader.records()] == [1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 and time.perf_counter() - started < 20
    assert reader.gaps[0].reason == "header does not end"
    with pytest.raises(ValueError, match="header of page 7"):
        warc.record("response", 7, "u" * (1 << 21), b"", "", None)


# -- very long runs ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["eyJ", "eyJ.", "eyJhbGciOiJIUzI1NiJ9.", "eyJa.eyJ", "A", "a1", "token", "token ", "token=", "AKIA", "xox", "xoxb-", "-----BEGIN ", "-----BEGIN A ", "gh", "ghp_", "4", "41111111111111110 "])
def test_secret_scan_is_linear(text):
    from cytolake.llm import secrets

    t = []
    for n in (1_000_000, 10_000_000) if text in ("eyJ", "A") else (200_000, 2_000_000):
        whole = text * (n // len(text))
        started = time.perf_counter()
        secrets.scan(whole)
        t.append(time.perf_counter() - started)
    assert t[1] < 60 and t[1] < 25 * max(t[0], 0.02)


def test_web_tokens_against_their_expression():
    from cytolake.llm import secrets

    rnd = random.Random(12)
    header = "eyJhbGciOiJIUzI1NiJ9"
    for _ in range(3000):
        text = "".join(rnd.choice([header, "eyJ", ".", "eyJx", "a", "-", " ", ".eyJy.", "Z"]) for _ in range(rnd.randrange(1, 14)))
        want = [m.span() for m in JWT.finditer(text) if secrets._is_jwt(m[1])]
        assert [(a, b) for a, k, b in secrets.scan(text) if secrets.KINDS[k] == "jwt"] == want, text


def test_toxicity_of_one_endless_word():
    from cytolake.llm import toxicity

    lexicon = toxicity.Lexicon(["idiot", "stupid", "moron$", "fool$"])
    started = time.perf_counter()
    for word in ("x" * 10_000_000, "idiot" * 2_000_000, "moron" * 2_000_000, "xdiot" + "y" * 10_000_000):
        lexicon.features(word)
    assert time.perf_counter() - started < 30
    for word in ("idiotic", "idi0ts", "moron", "morons", "moronss", "fooll", "fooool", "sstupid", "tsupidly", "xidiot" * 50, "fool" * 9, "m" + "moron"):
        whole = toxicity.Terms(lexicon.terms)
        whole.longest = 1 << 30
        assert toxicity.match(word, lexicon.index) == toxicity.match(word, whole), word


def test_salvage_goes_over_the_file_once(tmp_path):
    """Thousands of false starts in a zipped archive, where no version line stands in the open."""
    good = warc.member(warc.record("response", 1, "u", b"x", hashlib.sha1(b"x").hexdigest(), None))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good + warc.MAGIC * 20_000 + b"\0" * 3_000_000 + good)
    source = files.Blocks(f"file://{path}", 1 << 16)
    looked, find = [], source.find
    source.find = lambda what, at, end=None: looked.append(what) or find(what, at, end)
    reader = warc.Reader(source)
    assert sum(1 for _ in reader.records()) == 2 and looked.count(warc.VERSION) == 1


# -- all of them ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_lexical_search", "op13_source_divergence"}))  # test_search.py holds these against SQL
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"op5_top_k": "embeddings", "op9_warc": "pages"}.get(name, "documents")
    ids = {"op5_top_k": "query_id", "op9_warc": "page_id"}.get(name, "doc_id")
    all_ids = spark.read.parquet(f"{SF}/{table}.parquet").select({"op5_top_k": "vec_id"}.get(name, ids)).distinct()
    want = all_ids.where("vec_id % 50 = 0").count() if name == "op5_top_k" else all_ids.count()
    assert df.select(ids).distinct().count() == want


JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


def redact_of(text):
    """The secrets of a whole text by their expressions alone, without keywords or order."""
    from cytolake.llm import secrets as x
    from tests.llm.test_documents import base_spans

    if not text:
        return text
    spans = [(a, b) for a, _, b in base_spans(text)]
    spans += [m.span() for p in (x._GITHUB, x._NPM) for m in p.finditer(text) if x.base62_crc(m[1]) == m[2]]
    spans += [m.span() for m in x._CARD.finditer(text) if x.is_card(m[0])] + [m.span() for m in JWT.finditer(text) if x._is_jwt(m[1])] + [m.span() for m in x._PEM.finditer(text)]
    spans += [m.span() for p in x._FORMS.values() for m in p.finditer(text)]
    hidden = [False] * (len(text) + 1)
    out, k, over = "", 0, sorted(spans)
    for a, b in over:
        hidden[a:b] = [True] * (b - a)
    joins = {a for a, b in over if any(c < a < d for c, d in over)}  # spans that begin inside another are one with it
    while k < len(text):
        if not hidden[k]:
            out, k = out + text[k], k + 1
            continue
        out, k = out + "[secret]", k + 1
        while k < len(text) and hidden[k] and not (any(a == k for a, _ in over) and k not in joins):
            k += 1
    return out


def test_pipeline_by_brute_force(spark):
    """run() over whole tables, stage by stage, against plain Python."""
    from collections import Counter

    import corpus_pipeline as p
    from cytolake.llm import tokens
    from cytolake.llm.common import table
    from tests.llm import test_documents as t

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()]
    trusted = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    verdict = t.classify_of([(i, x, lang) for i, x, lang, _ in rows], trusted)
    good = [r for r in rows if verdict[r[0], r[1]][1]]
    assert 0 < len(good) < len(rows)
    least = {i: c for i, _, c in t.components_of([(i, t.fingerprint_of(x)) for i, x, *_ in good])}
    alone = [r for r in good if least[r[0]] == r[0]]
    clean = [(i, redact_of(x), s) for i, x, _, s in alone]
    mixed = []
    for i, _, x, n in t.mix_of(clean):
        while n > 0:
            ends = [m.end() for m in t.WORD.finditer(x)]
            mixed.append((i, x if n >= len(ends) else x[: ends[n - 1]]))
            n -= len(ends)
    encode = tokens.encoder(tokens.default_path()).tokenizer.encode
    want = Counter()
    for i, x in mixed:
        ids = np.array([*encode(x, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if k == 0 else a + 2048]
            want[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    got = p.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for s in placed.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(placed) <= -(-sum(r.length for r in got) // 2048) + 2


def test_pipeline_of_odd_tables(spark, docs, none, tmp_path):
    """Nulls, repeated rows, clashing columns, an empty table, and a text of nothing but line breaks."""
    import corpus_pipeline as p

    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("\n"), F.lit(1_000_000)).alias("text"), *docs.columns[2:])
    for df, some in ((docs.unionByName(odd), True), (none, False)):
        for name, stage in p.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != p.STAGES[-1][0]:
                assert df.columns == docs.columns
        assert (df.count() > 0) == some
