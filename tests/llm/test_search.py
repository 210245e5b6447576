"""Language identification, ranked search and the divergence of sources."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.llm import divergence, language, queries, treaps

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string"
ODD = [
    (None, "the river", "en", "s1"), (9001, None, "en", "s0"), (9002, "", "en", "s0"), (9003, " \n\t1 2", None, None), (9004, "word", None, None), (9005, "Á é ü\x0b日本語 x-y z9 Ⅷ \x7f q", "en", None),
    (9006, "stone " * 5000 + "river", "en", "s2"), (9006, "stone river", "en", "s2"), (9006, "stone river", "en", "s2"),
]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame([*rows, *ODD], FIELDS).repartition(3)


# -- 13 ------------------------------------------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    docs = [(divergence.terms(t), x or "", s or "") for _, t, x, s in rows]
    df, own, groups = Counter(), defaultdict(Counter), sorted({(x, s) for _, x, s in docs})
    for t, x, _ in docs:
        df.update((x, w) for w in set(t))
    for t, x, s in docs:
        own[x, s].update(w for w in t if df[x, w] >= least)
    out = []
    for x in {x for x, _ in groups}:
        kept = [w for (y, w), n in df.items() if y == x and n >= least]
        of = [s for y, s in groups if y == x]
        whole = sum((own[x, s] for s in of), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        share = {s: p(own[x, s]) for s in of}
        q = p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in of:
            pairs = [(o, sum(f(share[s][w], share[o][w]) for w in kept)) for o in of if o != s]
            found = [(w.decode(), f(share[s][w], q[w])) for w in kept if own[x, s][w] and share[s][w] > q[w]]
            for part, got, most in (("pair", pairs, None), ("term", found, top)):
                out += [(x, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(got, key=lambda r: (-r[1], r[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize("block,per_task,top", [(4 << 20, 200_000, 200), (2000, 50, 7)])
def test_divergence_is_exact(odd, rows, block, per_task, top):
    got = divergence.audit(odd, block=block, per_task=per_task, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit([*rows, *ODD], top=top)


def test_divergence_of_many_sources(spark):
    rnd = random.Random(8)
    rows = [(k, " ".join(f"w{chr(97 + int(rnd.paretovariate(0.7)) % 26)}{chr(97 + rnd.randrange(3))}" for _ in range(rnd.randrange(40))), "xy"[k % 2], f"s{min(k % 50, rnd.randrange(12))}") for k in range(300)]
    rows.append((300, "once", "z", "alone"))  # a language without kept terms
    rows.append((301, "other", "z", "two"))
    got = divergence.audit(spark.createDataFrame(rows, FIELDS), block=300, per_task=20)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)


def test_terms_of_the_audit():
    assert [t.decode() for t in divergence.terms("Ab-c1d Élan\x00x’y ＡÄ")] == ["ab", "c", "d", "Élan", "x’y", "ＡÄ"]
    assert divergence.terms(None) == []
    texts = ["a ab  a b\na", "", None, "b-a-b ab"]
    assert divergence.recount(texts, ["a", "ab", "b", "zz"]).tolist() == [4, 2, 3, 0]


@pytest.mark.parametrize("held", [1, 7, 1 << 20])
def test_meeting_in_pieces(held):
    rnd = np.random.default_rng(3)
    gid, term = np.unique(rnd.integers(0, [6, 40], (150, 2)), axis=0).T
    p, p0 = rnd.integers(1, 10**9, len(gid)), (gid + 1) * 1000
    got = dict(zip(zip(*(x.tolist() for x in divergence.met(gid, term, p, p0, held)[:2]), strict=True), divergence.met(gid, term, p, p0, held)[2].tolist(), strict=True))
    want: Counter = Counter()
    f = lambda a, b: (a - b) * (a - b) // b
    rows = [tuple(map(int, r)) for r in zip(gid, term, p, p0, strict=True)]
    for g, t, a, a0 in rows:
        for h, u, b, b0 in rows:
            if t == u and g != h:
                want[g, h] += f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
    assert got == dict(want)


def test_shares_of_large_counts(spark):
    rows = [(0, 1), (0, 5), (4, 5), (10**12, 10**12 + 7), (123456789012345, 9 * 10**15), (9 * 10**15 - 1, 9 * 10**15)]
    got = spark.createDataFrame(rows, "c long, d long").select(F.expr(divergence.share("c", "d"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 1) // d for c, d in rows]


def test_divergence_of_nothing(odd):
    assert divergence.audit(odd.where("false")).collect() == []


# -- 12 ------------------------------------------------------------------------------------------------------------


def brute_search(rows, items, k=20):
    docs = [(i, Counter(treaps.terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in {x for x in items}:
        want = Counter(treaps.terms(text))
        scores = [(sum(m * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * size * n // total))) for t, m in want.items() if c[t]), i) for i, c, size in docs]
        best = sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


QUERIES = [(0, "the river stones of the river"), (1, "word"), (2, ""), (3, None), (4, "zebra 9 日本語 stone"), (5, "village history number"), (5, "village history number"), (5, "paper"), (None, "Á ü Stone STONE z9"), (6, "the of and river stone window garden quiet morning letter paper forest")]


@pytest.mark.parametrize("shard,block,asked,seed", [(32 << 20, 8 << 20, 64 << 20, 16), (3000, 60, 64 << 20, 2), (500, 8 << 20, 0, 1)])
def test_search_is_exact(spark, odd, rows, shard, block, asked, seed):
    items = spark.createDataFrame([(i, t, "x") for i, t in QUERIES], "item_id long, text string, doc_id string")
    got = treaps.top_documents(odd, items, shard=shard, block=block, asked=asked, seed=seed)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search([(i, t) for i, t, *_ in [*rows, *ODD]], QUERIES)


def test_search_among_copies(spark):
    """Hundreds of equal scores: the smallest ids win, in whatever shard they are."""
    rnd = random.Random(2)
    texts = ["alpha beta gamma", "alpha beta", "beta delta delta"]
    rows = [(k, texts[rnd.randrange(3)] if k % 9 else f"alpha {k}") for k in range(900)]
    rnd.shuffle(rows)
    items = [(1, "alpha beta gamma"), (2, "delta"), (3, "alpha alpha 18")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = treaps.top_documents(df, spark.createDataFrame(items, "item_id long, text string"), shard=1500, seed=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(rows, items)


def test_search_of_nothing(spark, odd):
    items = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert treaps.top_documents(odd.where("false"), items).collect() == []
    assert treaps.top_documents(odd, items.where("false")).collect() == []


@pytest.mark.parametrize("impacts", ["random", "equal", "rising", "falling"])
def test_treaps_are_trees_and_heaps(impacts):
    rnd = np.random.default_rng(6)
    key = np.sort(rnd.choice(5 * 4000, 9000, replace=False))
    term, doc = key // 4000, key % 4000
    impact = {"random": rnd.integers(0, 10**6, len(key)), "equal": np.full(len(key), 7), "rising": np.arange(len(key)), "falling": np.arange(len(key))[::-1].copy()}[impacts]
    left, right, root = treaps.treaps(term, doc, impact)
    assert root.sum() == len(np.unique(term)) and (np.bincount(term[root]) == 1).all()
    seen, depth = 0, 0
    stack = [(int(r), -1, 4000, 1) for r in np.flatnonzero(root)]
    while stack:
        at, low, high, d = stack.pop()
        assert low < doc[at] < high
        seen, depth = seen + 1, max(depth, d)
        for child, a, b in ((left[at], low, doc[at]), (right[at], doc[at], high)):
            if child >= 0:
                assert term[child] == term[at] and impact[child] <= impact[at]
                stack.append((int(child), a, b, d + 1))
    assert seen == len(key)
    if impacts in ("random", "equal"):
        assert depth < 60


def test_subtrees_are_pruned():
    """A rare term and a common one: few of the common one's documents are scored."""
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["the", "of", "and"]) for _ in range(rnd.randrange(5, 30))) + (" rare" if k % 500 == 3 else "") for k in range(20_000)]
    shard = treaps.Shard(treaps.index_shard(0, list(range(20_000)), texts, 20_000, 20_000 * 18, None))
    walked, settle = [], shard.settle
    shard.settle = lambda at, low, high: walked.append(len(low)) or settle(at, low, high)
    best = shard.best([(b"the", 3), (b"of", 3), (b"rare", 6000)], 20, 1)
    assert len(best) == 20 and all(p % 500 == 3 for _, p in best)
    assert sum(walked) < 4000


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_source_divergence"])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    c = con.execute(queries.ORACLE_SQL[name])
    at = [[x[0] for x in c.description].index(k) for k in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in c.fetchall())


# -- 11 ------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    import unicodedata

    kind = lambda c: unicodedata.category(c)[0]
    if not text or not any(kind(c) == "L" for c in text.lower()):
        return {}
    u = " " + " ".join("".join(c if kind(c) in "LM" else " " for c in text.lower()).split()) + " "
    out: Counter = Counter()
    for n in range(1, language.ORDER + 1):
        for k in range(1 if n == 1 else 0, len(u) - n + 1):
            h = 0
            for c in u[k : k + n]:
                h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
            out[(h + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - language.BITS)] += 1
    return out


TEXTS = ["The quick  brown fox-42!", "Ça va? ÉTÉ", None, "", "123 !!", "́̂", "日本語 テキスト", "हिन्दी भाषा", "a", "  x  ", "İstanbul ß", "ab " * 500 + "end", "\x00q\x00"]


@pytest.mark.parametrize("piece", [1 << 20, 7, 3])
def test_grams_against_plain_counting(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    row, place, times = language.counts(TEXTS)
    got = defaultdict(dict)
    for r, p, n in zip(row.tolist(), place.tolist(), times.tolist(), strict=True):
        got[r][p] = n
    assert [got.get(k, {}) for k in range(len(TEXTS))] == [dict(plain_counts(t)) for t in TEXTS]


def test_one_pass_of_the_learner():
    """Against the update written out number by number."""
    rnd = np.random.default_rng(5)
    rows = [(int(rnd.integers(3)), np.sort(rnd.choice(30, 8, replace=False)), rnd.random(8)) for _ in range(60)]
    z, n = np.zeros((30, 3)), np.zeros((30, 3))
    language.follow(rows, z, n)
    zz, nn = defaultdict(float), defaultdict(float)

    def w(key):
        if abs(zz[key]) <= language.L1:
            return 0.0
        return -(zz[key] - math.copysign(language.L1, zz[key])) / ((language.BETA + math.sqrt(nn[key])) / language.ALPHA + language.L2)

    for y, at, x in rows:
        have = {(int(f), c): w((int(f), c)) for f in at for c in range(3)}
        s = [sum(v * have[int(f), c] for f, v in zip(at, x, strict=True)) for c in range(3)]
        total = sum(math.exp(v) for v in s)
        for f, v in zip(at, x, strict=True):
            for c in range(3):
                key, g = (int(f), c), (math.exp(s[c]) / total - (c == y)) * v
                sigma = (math.sqrt(nn[key] + g * g) - math.sqrt(nn[key])) / language.ALPHA
                zz[key] += g - sigma * have[key]
                nn[key] += g * g
    assert np.allclose(z, [[zz[f, c] for c in range(3)] for f in range(30)]) and np.allclose(n, [[nn[f, c] for c in range(3)] for f in range(30)])
    assert language.weight(np.array([0.01, -language.L1, 0.5]), np.ones(3)).tolist()[:2] == [0, 0]


def test_states_are_mixed_by_place():
    a = language._pack(0, np.array([3, 5000]), np.array([[1.0, 2.0], [3.0, 4.0]]), np.ones((2, 2)))
    b = language._pack(1, np.array([3, 9]), np.array([[3.0, 6.0], [7.0, 8.0]]), np.ones((2, 2)) * 3)
    import pyarrow as pa

    both = pa.concat_tables([a, b])
    got = [language._unpack(language._mix(both.filter(pa.compute.equal(both["block"], k)), 2), 2) for k in (0, 1)]
    assert got[0][0].tolist() == [3, 9] and got[0][1].tolist() == [[2.0, 4.0], [7.0, 8.0]] and got[0][2].tolist() == [[2.0, 2.0], [3.0, 3.0]]
    assert got[1][0].tolist() == [5000] and got[1][1].tolist() == [[3.0, 4.0]]


@pytest.fixture(scope="module")
def identified(spark):
    return {r.doc_id: r for r in queries.op11_language_id(spark, "/root/testdata/sf0.01").collect()}


def test_languages_of_held_out_documents(spark, identified):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held")).collect()
    assert len(truth) == len(identified) and all(identified[r.doc_id].held_out == r.held for r in truth)
    held = [(r.lang, identified[r.doc_id]) for r in truth if r.held and r.lang]
    right = [x == r.lang_pred for x, r in held]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in identified.values())
    assert abs(np.mean([r.score for _, r in held]) - np.mean(right)) < 0.05  # probabilities mean what they say


def test_held_out_languages_are_never_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    one, two = (sorted(tuple(r) for r in language.identify(d).collect()) for d in (docs, other))
    assert one == two and "xx" not in {r[2] for r in two}


def test_languages_of_odd_rows(spark, odd):
    got = language.identify(odd.withColumn("score", F.lit("a")).withColumn("held_out", F.lit(1)), sample=30)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r)
    assert all(by[k] == [(k, by[k][0][1], "und", 0.0)] for k in (9001, 9002, 9003, 62, 63, 64))
    assert len(by[9006]) == 3 and by[None][0][1] is False
    assert {r[2] for r in got} <= {"und", "en", "de"}


def test_nothing_to_learn_from(odd):
    got = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == odd.count() and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.identify(odd.where("false")).collect() == []
    one = language.identify(odd.withColumn("lang", F.lit("fr"))).collect()
    assert {r.lang_pred for r in one} == {"fr", "und"}


def test_temperature_lowers_the_loss(spark):
    rnd = np.random.default_rng(1)
    place, w = np.arange(2), np.array([[9.0, 0.0], [0.0, 9.0]])
    model = language.Model(["a", "b"], np.ones(1 << language.BITS), place, w)
    rows = [(int(k % 2 if rnd.random() < 0.8 else 1 - k % 2), [k % 2], [1.0]) for k in range(400)]  # right four times of five, but sure always
    df = spark.createDataFrame([(0, True, [y for y, *_ in rows], list(range(401)), [at[0] for _, at, _ in rows], [1.0] * 400)], language._ROWS)
    t = language.calibrate(df, model)
    p = 1 / (1 + np.exp(-9 / t))
    assert abs(p - np.mean([y == at[0] for y, at, _ in rows])) < 0.01
    assert language.calibrate(df.where("false"), model) == 1.0
