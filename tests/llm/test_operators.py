"""Operators for training data against brute force, on fixtures with every awkward case."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataq.llm import bpe, edits, jaccard, langid, mtree, nbsvm, packing, rules, sharding, suffixes
from strataq.llm.queries import BYTE_VOCAB, WORD_VOCAB, vocab_file

WHITE = "[\x20\x09-\x0d]+"
COLUMNS = "doc_id long, text string, lang string, source string, row string, number string, score string, _key string"


def prose(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n)).capitalize() + "."


def awkward_rows():
    """Nulls, empty and blank texts, ties, repeated rows, near and exact copies, shared passages, long and periodic texts."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = prose(rng, 30)
    texts = [*base, *base[:8], None, None, "", " \n\t ", "a", "é́ ß 日本 x\x1cy", "it's 'S <|endoftext|> <|startoftext|>!!", "ha " * 300, "ab" * 400, "\n".join(["same line here"] * 20)]
    for t in base[8:20]:
        w = t.split()
        if len(w) > 20:
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
    texts += [f"{t} {passage} {prose(rng, 9)}" for t in base[20:26]]
    texts.append(" ".join(prose(rng, 50) for _ in range(200)))
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[0], (None, base[1], None, None), (None, None, None, None), (7, base[30], "en", "s1")]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df, *cols):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in cols))
    return {k: sorted(v) for k, v in out.items()}


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return {k: sorted(v) for k, v in out.items()}


# 1: encoding


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_file(BYTE_VOCAB))


def test_bpe_as_the_library(docs, rows, byte_library):
    want = []
    for r in rows:
        ids = byte_library.encode(r[1] or "", add_special_tokens=False).ids
        back = byte_library.decode(ids, skip_special_tokens=False)
        want.append((r[0], (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert by_id(bpe.bpe_digests(docs, vocab_file(BYTE_VOCAB)), "n_tokens", "ids_sha256", "decoded_sha256") == grouped(want)


def test_bpe_round_trip_and_empty(docs, empty):
    path = vocab_file(BYTE_VOCAB)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert {"row", "score", "_key"} <= set(back.columns)
    assert bpe.bpe_digests(empty, path).count() == 0


def test_bpe_random_bytes(byte_library):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice(" '\n\t\r astremvldI'.!1½é日<|>endoftx") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    tables = bpe.worker(1, bpe.read_file(vocab_file(BYTE_VOCAB)))
    got = [f[a:b].tolist() for f, at in bpe.encode_batch(tables, pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]


# 2: rules


def brute_base(text):
    w = [x for x in re.split(WHITE, text or "") if x]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rule_statistics(docs, rows, empty):
    out = rules.apply_rules(docs, [])
    assert by_id(out, *rules.BASE, "base_failed") == grouped((r[0], brute_base(r[1])) for r in rows)
    assert out.filter(F.col("kept") & F.col("base_failed")).count() == 0
    assert rules.apply_rules(empty, []).count() == 0


def test_rules_are_learned_and_native(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 80), 1) for i in range(150)]
    bad = [(i, " ".join(w + "***" for w in prose(rng, 80).split()), 0) for i in range(150, 220)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    learned = rules.fit_rules(df, df.select("doc_id", "quality"))
    out = rules.apply_rules(df, learned)
    assert {(r["quality"], r["kept"]) for r in out.filter(~F.col("base_failed")).collect()} == {(1, True), (0, False)}
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert rules.learn_rules([], []) == [] and rules.fit_rules(df.limit(0), df.limit(0)) == []


# 3: near duplicates


def brute_components(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        w = [x for x in re.split(WHITE, (text or "").translate(fold)) if x]
        return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(k, shingles(t)) for k, t in rows]
    label = {k: k for k, _ in sets if k is not None}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    keyed = [(k, s) for k, s in sets if k is not None and s]
    for i, (a, s) in enumerate(keyed):
        for b, t in keyed[:i]:
            if 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return [(k, (len(s), None if k is None else top(k))) for k, s in sets]


@pytest.mark.parametrize("longest", [32, 2])
def test_near_duplicates(docs, rows, empty, longest, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", longest)  # 2: nearly every list is long
    own = [r for r in rows if r[0] != 7]  # one key with two texts has no single answer
    got = by_id(jaccard.near_duplicates(docs.filter("doc_id IS NULL OR doc_id <> 7")), "n_shingles", "component_id")
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in grouped_any(brute_components([(r[0], r[1]) for r in own])).items()}
    assert jaccard.near_duplicates(empty).count() == 0


def grouped_any(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def test_chains_and_large_groups_link(spark):
    rng = random.Random(8)
    start = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    made = []
    for i in range(150):
        w = list(start)
        for p in rng.sample(range(120), rng.randint(0, 5)):
            w[p] = f"z{rng.randint(0, 10**6)}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert by_id(jaccard.near_duplicates(df), "n_shingles", "component_id") == grouped(brute_components(made))


# 4: languages


def test_languages(spark, docs, empty):
    rng = random.Random(2)
    made = [(i, prose(rng, 30, "aeiourst" if i % 2 else "kwzxyjvb"), "one" if i % 2 else "two") for i in range(200)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = langid.identify_language(df, df.filter("doc_id < 120")).filter("doc_id >= 120")
    assert out.filter("lang = lang_pred AND score > 0.9").count() == 80
    odd = spark.createDataFrame([(None, 1), ("", 2), ("12 !!", 3), ("日", 4), ("rest" * 5000, 5)], "text string, doc_id long")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(odd, df).collect()} | {4: "", 5: ""} == {1: "und", 2: "und", 3: "und", 4: "", 5: ""}
    assert langid.identify_language(odd, df.limit(0)).filter("lang_pred <> 'und' OR score <> 0").count() == 0
    assert langid.identify_language(docs, docs).count() == docs.count() and langid.identify_language(empty, docs).count() == 0


def brute_bits(texts, asked):
    """Code lengths by dictionaries of contexts: escape method C, orders 3 to 0, then 8 bits; spaces before a text."""
    seen = defaultdict(Counter)
    for t in texts:
        t = b"   " + t
        for p in range(3, len(t)):
            for k in range(4):
                seen[t[p - k : p]][t[p]] += 1
    out, asked = [], b"   " + asked
    for p in range(3, len(asked)):
        bits = 0.0
        for k in (3, 2, 1, 0):
            c = seen.get(asked[p - k : p])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if c[asked[p]]:
                bits -= np.log2(c[asked[p]] / (n + d))
                break
            del c[asked[p]]
            bits -= np.log2(d / (n + d))
        else:
            bits += 8.0
        out.append(bits)
    return out


def test_code_lengths_by_brute_force():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé日 \n") for _ in range(n)).encode()
    texts = [word(rng.randint(0, 80)) for _ in range(12)]
    count = lambda ts: langid.count_grams(np.frombuffer(b"".join(ts), np.uint8), np.cumsum([0, *map(len, ts)]))
    trees = langid.Trees([count(texts), count(texts[:3]), count([b"q r"])])
    for t in [word(40), b"", b"zzz\x00\xff q", texts[3], b"ab"]:
        got = trees.code_lengths(langid.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
        for k, own in enumerate((texts, texts[:3], [b"q r"])):
            assert got[:, k].tolist() == pytest.approx(brute_bits(own, t), rel=1e-5)


def test_languages_of_long_texts_and_ties(spark):
    rows = [(1, "kw zx " * 20_000, "long"), (2, "aei " * 30, "short"), (3, "aei " * 30, "twin"), (4, None, "none"), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit("old"))
    out = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.identify_language(df, df).collect()}
    assert out[1] == ("long", 1.0) and out[2] == out[3] == ("short", 0.5) and out[4] == ("und", 0.0)


# 5: search


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)).round(2)
    x[100:200] = x[100]  # ties
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [1.0, 2.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in mtree.top_k(df, group=128, sample=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(256 * x).astype(np.int64)
    want = {i: sorted(((int(j), int(q[i] @ q[j])) for j in range(700) if j != i), key=lambda p: (-p[1], p[0]))[:5] for i in range(0, 700, 50)}
    assert dict(got) == want
    assert mtree.top_k(df.limit(0)).count() == 0 and mtree.top_k(df.filter("vec_id < 3")).count() == 2


def brute_top(made, every=50, k=5):
    """By query row: (key, vector) that repeat count once, and vectors of one key never find each other."""
    rows = sorted({(i, tuple(int(np.floor(256.0 * c)) for c in v)) for i, v in made})
    out = defaultdict(list)
    for i, q in rows:
        if i % every == 0:
            near = sorted(((sum(a * b for a, b in zip(q, x, strict=True)), -j) for j, x in rows if j != i and len(x) == len(q)), reverse=True)[:k]
            out[i].append([(-j, min(max(s, -(2**63)), 2**63 - 1)) for s, j in near])
    return {i: sorted(v) for i, v in out.items()}


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_top_k_of_awkward_rows(spark):
    rng = np.random.default_rng(4)
    made = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))]
    made += [made[0], made[0], made[7], (50, [3.0, -1.0, 2.0, 0.5]), (300, [float("inf"), 1.0, 0.0, 0.0])]
    made += [(200, [1e9, -1e9, 3.25, 0.0]), (201, [1e9, 1e9, 0.5, 1.0]), (202, [-1e12, 0.1, 0.0, 7.0]), (203, [2e9, -5e8, 0.0, 0.0]), (250, [1e30, 1.0, 1.0, 1.0])]
    odd = [(400, []), (450, [1.0, None, 1.0, 1.0]), (500, [1e200, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in made + odd], "vec_id long, embedding array<double>, packed string, g int")
    want = brute_top([(i, v) for i, v in made if i != 300])
    got = answers(mtree.top_k(df, group=16, sample=40, block=2))
    assert set(got) == set(want)
    for i, lists in want.items():
        assert sorted(got[i]) == sorted(x for v in lists for x in v), i
    assert [s for _, s in got[250]][-1] >= -(2**63) and got[200][0][0] == 250


def test_orders_of_scores():
    values = [0, 1, -1, 255, 256, -255, -256, 2**70, -(2**70), 2**70 + 1, 10**90, -(10**90)]
    assert sorted(values) == sorted(values, key=mtree.sort_key)


def test_queries_go_to_few_trees(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 8
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    members, sent, trees = mtree.spread(df, 50, 5, 512, 256, "vec_id", "embedding")
    assert members.count() == 6000 and members.groupBy("g").count().agg(F.max("count")).first()[0] <= 512
    assert sent.count() < 0.25 * 120 * trees
    made = [(i, v.tolist()) for i, v in enumerate(x)]
    assert {i: [v] for i, v in answers(mtree.top_k(df, sample=512, group=256)).items()} == brute_top(made)


def test_stored_distances_save_work():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (20, 16))
    x = (centres[rng.integers(0, 20, 4000)] + rng.integers(-60, 60, (4000, 16))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), x)
    for i in range(20):
        assert [s for s, _ in tree.search(i, x[i], 5, None)] == sorted((np.delete(x, i, 0) @ x[i]).tolist(), reverse=True)[:5]
    assert tree.computed < 0.6 * 20 * 4000


def test_sent_queries_leave_in_bounded_batches():
    class Asked:
        def mapInArrow(self, run, schema):
            return run

    dims, trees = 1 << 16, 4200  # over 2 GB of queries: more than one Arrow column holds
    cells = mtree.Cells(np.zeros(0, np.int64), np.full((1, dims), 1e6), 1)
    cells.ids, cells.x = np.array([-1]), cells.x[:0]
    cells.set([(0, 1.0, 1e9, 0, trees)])
    query = pa.RecordBatch.from_pydict({"query_id": [50], "mark": [1], "dims": [dims], "packed": [np.full(dims, 1e6).tobytes()]})
    seen = []
    for b in mtree.sent(Asked(), SimpleNamespace(value={dims: cells}), 5)(iter([query])):
        assert b.nbytes < 64 << 20
        seen += b.column(0).to_pylist()
    assert seen == list(range(trees))


@pytest.mark.parametrize("scale", [1, 3000, 10**6, 10**12])
def test_queries_that_go_down_together(scale):
    rng = np.random.default_rng(6)
    centres = rng.integers(-200, 200, (12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-9, 9, (3000, 8))) * scale
    x[500:900] = x[500]  # a page's worth of ties and more
    tree = mtree.MTree(np.arange(3000), x)
    asked = np.arange(0, 3000, 20)
    whole = x.astype(object) @ x[asked].astype(object).T
    want = [sorted(((int(whole[j, n]), j) for j in range(3000) if j != i), key=lambda r: (-r[0], r[1]))[:5] for n, i in enumerate(asked.tolist())]
    for floors in ([None] * len(asked), [w[-1][0] for w in want]):
        which, scores, ids = tree.search_all(asked, x[asked].astype(np.float64), 5, floors)
        got = [[] for _ in asked]
        for i, s, v in zip(which.tolist(), scores.tolist(), ids.tolist(), strict=True):
            got[i].append((int(s), v))
        assert got == want


# 6: quality


def test_quality(spark, docs, empty):
    rng = random.Random(5)
    made = [(i, prose(rng, 60) if i % 3 else prose(rng, 60).upper().replace(" ", "!! "), int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string, quality int")
    out = nbsvm.quality_scores(df, df, df.filter("doc_id < 200").select("doc_id", "quality")).filter("doc_id >= 200")
    assert out.filter((F.col("score") >= 0.3) != (F.col("quality") == 1)).count() == 0
    every = nbsvm.quality_scores(docs, df, df.select("doc_id", "quality"))
    assert every.filter("score >= 0 AND score <= 1").count() == docs.count()
    assert nbsvm.quality_scores(docs, df, df.select("doc_id", "quality").limit(0)).filter("score <> 0.5").count() == 0
    assert nbsvm.quality_scores(empty, df, df.select("doc_id", "quality")).count() == 0


def brute_linear(rows, y, smooth=1.0, cost=4.0):
    """The squared-hinge model over log-count ratios, by plain descent on all weights at once."""
    apart = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~apart)
    every = sorted({int(f) for r in rows for f in r})
    place = {f: i for i, f in enumerate(every)}
    x = np.zeros((len(fit), len(every)))
    for a, i in enumerate(fit):
        x[a, [place[int(f)] for f in rows[i]]] = 1.0
    s = y[fit]
    p, q = x[s > 0].sum(axis=0) + smooth, x[s < 0].sum(axis=0) + smooth
    ratio = np.log(p / (s > 0).sum()) - np.log(q / (s < 0).sum())
    ratio[x.sum(axis=0) == 0] = 0.0
    x = x * ratio
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    x = np.concatenate([x, np.ones((len(fit), 1))], axis=1)
    c = cost * np.where(s > 0, len(fit) / (2 * (s > 0).sum()), len(fit) / (2 * (s < 0).sum()))
    w = np.zeros(x.shape[1])
    step = 1.0 / (1.0 + 2 * (c[:, None] * x * x).sum())
    for _ in range(60_000):
        gap = np.maximum(0.0, 1.0 - s * (x @ w))
        w -= step * (w - 2 * x.T @ (c * s * gap))
    return every, ratio, w


def test_weights_by_plain_descent():
    rng = np.random.default_rng(3)
    y = np.where(np.arange(50) % 3 > 0, 1.0, -1.0)
    rows = [np.unique(rng.integers(0, 12, 8) + (6 if s > 0 else 0)) for s in y]
    model = nbsvm.fit(rows, (y > 0).astype(int), epochs=400)
    every, ratio, w = brute_linear(rows, y)
    assert np.allclose(model.square[every], ratio * ratio, rtol=1e-5)
    assert np.allclose(model.weight[every], w[:-1] * ratio, atol=2e-3)


# 7: packing


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_file(WORD_VOCAB))
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*t.encode(r[1] or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(docs, vocab_file(WORD_VOCAB), width=512, sentence=0.25, inside=3.0, block=4000).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        parts[p["doc_id"]].append(p)
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 512
    assert sum(p["length"] for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for k, own in parts.items():
        if len(ids[k]) == 1:
            want = ids[k][0]
            at = 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(want)
                assert p["ids_crc32"] == zlib.crc32(np.array(want[at : at + p["length"]], "<u4"))
                at += p["length"]
            assert at == len(want)
    sizes = [sum(n for _, n in s) for s in seqs.values()]
    assert sum(512 - n for n in sizes if n & (n - 1)) < 0.05 * sum(sizes)
    assert packing.pack(empty, vocab_file(WORD_VOCAB)).count() == 0


def test_cuts_cost_least():
    rng = np.random.default_rng(3)
    for _ in range(40):
        points = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 14))])
        penalty = rng.integers(0, 4, 15).astype(float)
        width = 16
        cost = [0.0] + [1e9] * 14
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= 2 else width - n
        for j in range(1, 15):
            cost[j] = penalty[j] + min(cost[i] + pad(int(points[j] - points[i])) for i in range(j) if points[j] - points[i] <= width)
        got, at = 0.0, 0
        for j in packing.best_cuts(points, penalty, width, least=1):
            got += penalty[j] + pad(int(points[j] - points[at]))
            at = j
        assert got == pytest.approx(cost[-1]) and at == 14


# 8: repeats


def brute_repeats(pairs):
    starts = defaultdict(set)
    for k, t in pairs:
        if k is not None:
            for p in range(len(t) - 49):
                starts[t[p : p + 50]].add(k)
    least = {w: min(v) for w, v in starts.items()}
    out = []
    for k, t in pairs:
        gone = bytearray(len(t))
        if k is not None:
            for p in range(len(t) - 49):
                if least[t[p : p + 50]] < k:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())))
    return out


def test_repeats(docs, rows, empty):
    want = grouped(brute_repeats([(r[0], (r[1] or "").encode()) for r in rows]))
    assert by_id(suffixes.repeat_digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    cut = suffixes.remove_repeats(docs, pass_through=["lang", "row"])
    assert cut.columns == ["doc_id", "text", "n_removed", "lang", "row"] and cut.count() == len(rows)
    assert suffixes.repeat_digests(empty).count() == 0


def test_repeats_of_exact_width_and_multibyte(spark):
    rng = random.Random(6)
    letters = "abé "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = word(60)
    made = [(i, word(rng.randint(0, 70)) + (passage[: rng.randint(30, 60)] if i % 2 else "") + word(rng.randint(0, 40))) for i in range(80)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert by_id(suffixes.repeat_digests(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == grouped(brute_repeats([(k, t.encode()) for k, t in made]))


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("least", [1, 3])
def test_longest_previous_factors(least):
    rng = random.Random(9)
    for _ in range(80):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
        value = np.array([rng.randint(0, 5) if rng.random() < 0.5 else i for i in range(len(t))], np.int64)
        order = sorted(range(len(t)), key=lambda i: t[i:])
        lcp = np.array([0, *(common(t[i:], t[j:]) for i, j in zip(order, order[1:], strict=False))][: len(t)], np.int64)
        got = suffixes.longest_previous_factors(value[order], lcp, least)
        want = [max([0, *(common(t[i:], t[j:]) for j in order if value[j] < value[i])]) for i in order]
        assert got.tolist() == [x if x >= least else 0 for x in want]


def test_leftmost_anchors():
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 150))) for _ in range(20)] + [b"ab" * 90, b"x" * 200, b"abcdefg" * 30]
    at = np.cumsum([0, *map(len, texts)])
    doc, h, first, last, place = suffixes.anchors(np.frombuffer(b"".join(texts), np.uint8), at, 50)
    seen = {}
    for d, x, a, z, p in zip(doc, h, first - at[doc], last - at[doc], place - at[doc], strict=True):
        for s in range(a, z + 1):
            assert s <= p <= s + 18
            assert seen.setdefault(texts[d][s : s + 50], (x, p - s)) == (x, p - s)
    assert set(seen) == {t[s : s + 50] for t in texts for s in range(len(t) - 49)}


def test_common_lines_are_cut_up(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_LEAST", 3)
    rng = random.Random(13)
    line = prose(rng, 14)[:70]
    made = [(i, f"{prose(rng, rng.randint(1, 9))}{line}{prose(rng, rng.randint(1, 9))}"[: rng.choice([200, 70, 55])]) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(6)
    assert by_id(suffixes.repeat_digests(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == grouped(brute_repeats([(k, t.encode()) for k, t in made]))
    hot = np.array([], np.uint64)
    pieces = suffixes.Contexts(4, 2, 50, hot)
    text = np.frombuffer(line.encode()[:68], np.uint8)
    one = pieces.cut_up(text, np.ones(1, np.uint64), *(np.array([x]) for x in (5, 0, 100, 68, 18, 0)))
    assert sorted(int(x) for p in one for x in p[4]) == [100, 104, 109, 114] and {int(x) for p in one for x in p[5]} == {54, 53}


# 9: token counts


def test_edited_counts(docs, rows, empty, byte_library):
    count = lambda s: len(byte_library.encode(s, add_special_tokens=False).ids)
    more = [(5000 + i, t) for i, t in enumerate(["mail a.b@c.org now", "x@y.zz", "call 123 456 7890!", "a@b.co'll 1234567s", "12345678", "no", "ab@cd.ef gh@ij.kl 99999999 end\n\n 7777777", "a@b@c.de a@c.org@d.ee @x.yz .@.-"])]
    df = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    want = []
    for k, t in [(r[0], r[1] or "") for r in rows] + more:
        b = t.encode()
        for e in reversed(edits.find_edits(b)):
            b = b[: e[0]] + e[2] + b[e[1] :]
        want.append((k, (count(t), count(b.decode()))))
    assert by_id(edits.edited_token_counts(df, vocab_file(BYTE_VOCAB)), "n_tokens", "n_tokens_after") == grouped(want)
    assert edits.edited_token_counts(empty, vocab_file(BYTE_VOCAB)).count() == 0


def test_addresses_as_a_pattern_finds_them():
    pattern = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(3000):
        t = bytes(rng.choice(b"ab@.- @") for _ in range(rng.randint(0, 24)))
        assert list(edits.addresses(t)) == [m.span() for m in pattern.finditer(t)], t
    began = time.time()
    assert list(edits.addresses(b"Ab0" * 400_000)) == [] and len(list(edits.addresses(b"x" * 1_000_000 + b"@y.zz"))) == 1
    assert time.time() - began < 1


def random_edits(rng, t, most=3):
    """Up to ``most`` edits of a text in order, as byte offsets."""
    at = [len(t[:k].encode()) for k in range(len(t) + 1)]
    es, pos = [], 0
    while pos <= len(t) and len(es) < most:
        a = rng.randint(pos, len(t))
        z = min(len(t), a + rng.choice([0, 1, 4, 30]))
        es.append((at[a], at[z], rng.choice(["", "'", "s", "re", " ", "\n", "x y", "é日", "word " * 9]).encode()))
        pos = z + 1
    return es


def test_random_edits_batch_after_batch(byte_library):
    tables = bpe.worker(1, bpe.read_file(vocab_file(BYTE_VOCAB)))
    rng = random.Random(7)
    for _ in range(150):
        t = "".join(rng.choice(" '\n\tastremvld.!1é日") for _ in range(rng.randint(0, 120)))
        tree = edits.TokenTree.of(tables, t.encode())
        for _ in range(4):
            es = random_edits(rng, t)
            tree.apply(tables, es)
            b = t.encode()
            for a, z, new in reversed(es):
                b = b[:a] + new + b[z:]
            t = b.decode()
            assert tree.text() == b and tree.total() == len(byte_library.encode(t, add_special_tokens=False).ids)
            tree = edits.TokenTree.from_bytes(tree.to_bytes())
            assert tree.text() == b and tree.total() == len(byte_library.encode(t, add_special_tokens=False).ids)
    long = ("word " * 5000).encode()
    tree = edits.TokenTree.of(tables, long)
    assert tree.apply(tables, [(10_000, 10_003, b"edit")]) < 20 and tree.apply(tables, [(12_000, 12_000, b"edit")]) < 20


def test_kept_trees(spark, docs, byte_library):
    path = vocab_file(BYTE_VOCAB)
    trees = edits.kept_trees(docs.select("doc_id", "text").filter("doc_id < 40 AND doc_id <> 7").dropDuplicates(["doc_id"]), path)
    change = spark.createDataFrame([(k, [(0, 0, bytearray(b"new start ")), (0, 1, bytearray(b""))]) for k in (1, 2, 3)] + [(4, None), (5, [])], "doc_id long, edits array<struct<start: long, end: long, new: binary>>")
    after = edits.edit_trees(edits.edit_trees(trees, change, path), change.filter("doc_id = 1"), path)
    old = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").filter("doc_id < 40 AND doc_id <> 7").collect()}
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == set(old)
    for k, t in old.items():
        for _ in range({1: 2, 2: 1, 3: 1}.get(k, 0)):
            t = "new start " + t[1:]
        assert got[k]["n_tokens"] == len(byte_library.encode(t, add_special_tokens=False).ids), k


def test_unspaced_texts_in_time(byte_library):
    rng = random.Random(5)
    tables = bpe.worker(1, bpe.read_file(vocab_file(BYTE_VOCAB)))
    text = "".join(rng.choice("abcdeABCDE") for _ in range(1_000_000))
    began = time.time()
    n = edits.TokenTree.of(tables, text.encode()).total()
    assert time.time() - began < 12
    assert n == len(byte_library.encode(text, add_special_tokens=False).ids)
    mixed = ["日本語" * 300, "x" * 257, "y" * 256, "ab" * 129, "é" * 500]
    import pyarrow as pa

    got = [f[a:b].tolist() for f, at in bpe.encode_batch(tables, pa.array(mixed)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in byte_library.encode_batch(mixed, add_special_tokens=False)]


# 10: sharding


def test_shards(docs, rows, empty):
    out = sharding.hilbert_shards(docs, shards=8, group_share=0.5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    assert sharding.hilbert_shards(empty).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(600)]
    made = [(i, texts[i % 600] if i < 1800 else "hot " * 30, rng.choice("ab"), rng.choice("xyz")) for i in range(2700)]
    out = sharding.hilbert_shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"))
    per = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(per) == 8 and max(per) < 1.03 * min(per)
    small = out.filter(F.col("size") != 121).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert small.filter("n > 1").count() == 0


def test_large_groups_of_copies_are_one_run_of_shards(spark):
    made = [(i, f"text {i:05d}", "abcd"[i % 4], "wxyz"[i // 4 % 4]) for i in range(950)]
    made += [(950 + i, "the copied", "abcd"[i % 4], "wxyz"[i // 4 % 4]) for i in range(50)]  # a twentieth of the bytes
    out = sharding.hilbert_shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    order = [r["doc_id"] >= 950 for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    at = order.index(True)
    assert len(out) == 1000 and all(order[at : at + 50]) and len({r["shard"] for r in out if r["doc_id"] >= 950}) <= 2
    load = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) <= 2 * 11


def test_shards_as_a_driver_side_sort(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 50)) for _ in range(500)]
    made = [(i, texts[rng.randrange(500)] if i % 3 else None, rng.choice("abcd"), rng.choice("wxyz")) for i in range(1800)]
    out = sharding.hilbert_shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(7), group_share=0.5).collect()
    rows = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    curve = [r["curve"] for r in rows]
    assert curve == sorted(curve)
    total, at, i, want = sum(r["size"] for r in rows), 0, 0, []
    groups = defaultdict(list)
    for r in rows:
        groups[r["curve"], r["text_crc32"], r["size"]].append(r)
    while i < len(rows):  # each group whole, where its middle falls
        r = rows[i]
        own = groups[r["curve"], r["text_crc32"], r["size"]]
        size = sum(x["size"] for x in own)
        hold = len(own) if len(own) > 1 and size <= total / 8 * 0.5 else 1
        size = r["size"] * hold
        want += [min(7, (at + size // 2) * 8 // total)] * hold
        at, i = at + size, i + hold
    assert [r["shard"] for r in rows] == want


def test_shards_have_narrow_ranges(spark):
    rng = random.Random(8)
    made = [(i, f"{i} " + "x" * rng.randint(1, 400), rng.choice("abcdefgh"), rng.choice("stuvwxyz")) for i in range(4000)]
    at = {i: (len(t), lang, source) for i, t, lang, source in made}
    found = defaultdict(list)
    for r in sharding.hilbert_shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect():
        found[r["shard"]].append(at[r["doc_id"]])
    share = [np.mean([len({x[d] for x in own}) / len({x[d] for x in at.values()}) for own in found.values()]) for d in range(3)]
    reach = np.mean([(max(x[0] for x in own) - min(x[0] for x in own)) / 400 for own in found.values()])
    assert share[1] < 0.75 and share[2] < 0.75 and reach < 0.75


def test_many_empty_texts_are_one_run(spark):
    made = [(i, None if i % 2 else f"text {i:06d} of its own", "ab"[i % 2], "s") for i in range(6000)]
    out = sharding.hilbert_shards(spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(5))
    empty = out.filter("size = 1")
    assert empty.select("shard").distinct().count() == 1 and empty.count() == 3000
    load = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(load) - min(load) <= 2 * 3000


def test_groups_over_partitions():
    a, b, c = (1, 2, 3, 30), (1, 9, 3, 12), (2, 4, 5, None)
    parts = [(0, 4, 12, (*b, 0), (*a, 6)), (1, 5, 15, (*a, 0), (*a, 0)), (2, 4, 12, (*a, 0), (*c, 9)), (3, 1, 5, (*c, 0), (*c, 0))]
    assert sharding.whole_parts(parts) == [(0, 0, 0, 0), (1, 4, 12, 6), (2, 9, 27, 6), (3, 13, 39, 36)]


def test_curve_is_one_walk():
    side = 4
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    place = sharding.hilbert_index(cells, bits=2)
    assert sorted(place) == list(range(side**3))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
