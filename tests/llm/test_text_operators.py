"""Chat formatting, language ID, packing, URL filters, quality rules and HTML extraction."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from brute import corpus, quality, sha
from pyspark.sql import functions as F

from biomeframe.llm import _spark, chat, components, html_text, langid, packing, urls
from biomeframe.llm import quality as rules

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<|", "<\\|", "\n", "a", "é漢", "|>", "<", "assistant\n"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem", "<|x", "", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(12))])))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    out = chat.format_conversations(spark.createDataFrame(shuffled, TURNS).withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("chunks"))).collect()}
    for c in range(30):
        own = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["loss"] == "".join(t for r, t in own if r == "assistant")
        assert got[c]["blocks"] == 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert got[c]["formatted"] == "".join(x["text"] for x in got[c]["chunks"])


def test_chat_template(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (None, None, None, None)]
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<|im_sep|>b<|im_end|>\n", None: "<|im_start|>\n<|im_end|>\n"}
    ties = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")], TURNS)
    assert chat.format_conversations(ties).collect()[0]["formatted"] == "<|im_start|>assistant\nz<|im_end|>\n<|im_start|>user\na<|im_sep|>a<|im_sep|>b<|im_end|>\n"
    assert chat.format_conversations(ties.limit(0)).collect() == []


def test_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(2000)]
    row = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(6)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()[0]
    assert [t["text"] for t in row["turns"]] == [f"t{t}" for t in range(2000)]


def language_corpus(n=160, seed=2):
    rng = random.Random(seed)
    parts = {"aa": "the of and ing tion er".split(), "bb": "que ción los ado en ñ".split(), "cc": "über sch ung ei der ß".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 3))) for _ in range(rng.choice([6, 30, 200]))]
        out.append((i, " ".join(words), lang))
    return out


def test_language_accuracy(spark):
    rows = language_corpus()
    train = spark.createDataFrame([r for r in rows if r[0] % 4], "doc_id long, text string, lang string")
    model = langid.train_language_model(train.union(spark.createDataFrame([(900, None, "aa"), (901, "x", None)], train.schema)), 100)
    assert model.labels == ["aa", "bb", "cc"]
    assert 0 < (np.abs(model.weights).sum(1) > 0).sum() < langid.BUCKETS / 10  # the penalties keep it sparse
    held = [r for r in rows if r[0] % 4 == 0] + [(1000, None, None), (1001, "", None), (1002, " 12 -- 3_", None), (1003, "the" * 300_000, None)]
    got = {r["doc_id"]: r for r in langid.predict_languages(spark.createDataFrame(held, "doc_id long, text string, score string"), model).collect()}
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in held if lang) >= 0.95 * sum(bool(x[2]) for x in held)
    assert [got[d]["lang_pred"] for d in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train_language_model(empty) is None
    assert [r["lang_pred"] for r in langid.predict_languages(spark.createDataFrame([(1, "abc")], DOCS), None).collect()] == ["und"]


def test_grams_against_loop():
    texts = ["aé漢b", "", "Abc", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    bucket, doc = langid.grams(raw, offsets)
    assert np.bincount(doc, minlength=4).tolist() == [4 + 3 + 2, 0, 3 + 2 + 1, 1]
    same, _ = langid.grams(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))
    assert sorted(bucket[doc == 2]) == sorted(same)


def simple_grams(text):
    """Plain Python buckets of a text's n-grams."""
    mask = (1 << 64) - 1
    low = [int.from_bytes(c.encode(), "big") for c in "".join(c.lower() if c.isascii() else c for c in text)]

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out = []
    for order in langid.ORDERS:
        for i in range(len(low) - order + 1):
            code = 0
            for k in range(order):
                code = (code * 0x100000001B3 + low[i + k] + k + 1) & mask
            out.append(mix(code) % langid.BUCKETS)
    return out


def simple_ftrl(rows, k, seed):
    """One epoch of follow-the-regularised-leader, one weight at a time."""
    a, b, l1, l2 = langid.ALPHA, langid.BETA, langid.L1, langid.L2
    z, n = {}, {}
    weight = lambda key: 0.0 if abs(z.get(key, 0.0)) <= l1 else -(z[key] - math.copysign(l1, z[key])) / ((b + math.sqrt(n[key])) / a + l2)
    for i in np.random.default_rng(seed).permutation(len(rows)):
        y, idx, val = rows[i]
        scores = [sum(x * weight((j, c)) for j, x in zip(idx, val)) + weight((None, c)) for c in range(k)]
        e = [math.exp(s - max(scores)) for s in scores]
        for c in range(k):
            p = e[c] / sum(e) - (c == y)
            for j, x in [*zip(idx, val), (None, 1.0)]:
                g, w, old = p * x, weight((j, c)), n.get((j, c), 0.0)
                z[j, c] = z.get((j, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * w
                n[j, c] = old + g * g
    return weight


def test_language_model_against_plain_python(spark):
    """N-grams, document frequencies, FTRL and scores equal a plain version, weight by weight."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB é漢z9 ") for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["", "Q"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bucket, doc = langid.grams(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == sorted(simple_grams(t))
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(langid.BUCKETS)
    for t in texts:
        want[sorted(set(simple_grams(t)))] += 1
    assert n == len(texts) and (df == want).all()
    rows = []
    for i, t in enumerate(texts):
        idx, count = np.unique(simple_grams(t), return_counts=True)
        rows.append((i % 3, idx.astype(np.int64), count / max(count.sum(), 1) * 2))
    w, b = langid.fit_ftrl(rows, 3, epochs=1, seed=5)
    weight = simple_ftrl(rows, 3, 5)
    for j in set().union(*(r[1].tolist() for r in rows)):
        assert w[j] == pytest.approx([weight((j, c)) for c in range(3)], abs=1e-9)
    assert b == pytest.approx([weight((None, c)) for c in range(3)], abs=1e-9)
    model = langid.LanguageModel(["x", "y", "z"], w, b, 1.7)
    got = {r["doc_id"]: r for r in langid.predict_languages(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3), model).collect()}
    for i, t in enumerate(texts):
        if any(c.isalpha() for c in t):
            own = simple_grams(t)
            s = [(sum(w[j][c] for j in own) / len(own) + b[c]) / 1.7 for c in range(3)]
            p = [math.exp(x - max(s)) for x in s]
            assert got[i]["lang_pred"] == "xyz"[p.index(max(p))] and got[i]["score"] == pytest.approx(max(p) / sum(p), abs=1e-5)


def test_language_sample_is_bounded(spark):
    """Repeated rows and ids neither fill nor empty the sample; equal rows count once; an empty table predicts nothing."""
    rows = [(1, f"text number {i}", "aa") for i in range(3000)] + [(2, "same text", "bb")] * 3000 + [(None, f"b {i}", "bb") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen = langid.sample_documents(df, 100).groupBy("lang").count().collect()
    got = {r["lang"]: r["count"] for r in chosen}
    assert 60 < got["aa"] < 150 and got.get("bb", 0) <= 6
    model = langid.train_language_model(df, 100)
    assert model.labels[0] == "aa"
    assert langid.predict_languages(df.limit(0), model).collect() == []
    twice = langid.predict_languages(spark.createDataFrame([(1, "text number 7")] * 3, DOCS), model).collect()
    assert len(twice) == 3 and len(set(twice)) == 1


def test_temperature():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(4000, 3))
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert langid.fit_temperature(s * 5, y) == pytest.approx(5, rel=0.15)


def test_tokens_equal_the_tokenizer_file():
    """The ranks give the ids of the JSON tokenizer as it is, on every code point in several surroundings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.load_tokenizer()
    texts = [x for _, x in corpus() if x] + ["<|endoftext|> x", "a\u00a0b\u2003c  d\r\n\r\n e", "don't I'LL 123 ½ Ⅷ", "😀e\u0301" * 9, "\x00\x7f\ufeff"]
    for first in range(0, 0x110000, 512):
        points = [chr(c) for c in range(first, first + 512) if not 0xD800 <= c < 0xE000]
        texts.append("\x00".join(f"a{c}b {c} 1{c}2  {c}\n'{c}s" for c in points))
    for x, want in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False)):
        assert encode(x).tolist() == want.ids


def test_special_tokens_equal_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x for _, x in corpus() if x] + ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x\n<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>"]
    encode = packing.load_tokenizer()
    for x in texts:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    row = packing.pack_documents(spark.createDataFrame([(1, texts[-5])], DOCS), keep_ids=True).collect()[0]
    assert row["ids"] == [64, 50256, 65, 2]


def check_packing(pieces, capacity):
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    rows = corpus(8, 80) + [(5000, "word " * 3000), (5001, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("x")).repartition(4)
    got = packing.pack_documents(df, capacity=128, keep_ids=True).collect()
    encoder = packing.load_encoder()
    used = check_packing(got, 128)
    by = {}
    for p in got:
        by.setdefault(p["doc_id"], []).append(p)
    for d, t in rows:
        own = sorted(by[d], key=lambda p: p["piece"])
        assert sum((p["ids"] for p in own), []) == [*encoder.encode_to_numpy(t or "").tolist(), 2]
        assert [p["piece"] for p in own] == list(range(len(own))) and all(p["length"] == 128 for p in own[1:])
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"])
    total = sum(p["length"] for p in got)
    assert used <= -(-total // 128) * 1.02 + 4
    assert packing.pack_documents(df.limit(0)).collect() == []
    twice = spark.createDataFrame([("x", "same text"), ("x", "same text"), (None, "other")], "doc_id string, text string")
    assert sorted(str(p["doc_id"]) for p in packing.pack_documents(twice).collect()) == ["None", "x", "x"]


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(1025, np.int64)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 4000).astype(int), 1, 1024) if seed < 3 else np.full(10, 600)
    np.add.at(hist, lengths, 1)
    runs = packing.plan_sequences(hist)
    seen = {n: np.zeros(hist[n], int) for n in np.flatnonzero(hist)}
    filled = {}
    for n, a, b, first, offset in runs:
        seen[n][a:b] += 1
        for k in range(b - a):
            filled.setdefault(first + k, []).append((offset, n))
    assert all((v == 1).all() for v in seen.values())
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(filled) <= (-(-lengths.sum() // 1024) * 1.01 + 2 if seed < 3 else 10)


def test_url_filters(spark):
    rules_ = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    pages = [
        (1, "http://a.com/x"), (2, "https://B.example.com/en/1?q"), (3, "https://www.example.com/en/1"), (4, "http://q.net/es/2#f"), (5, "http://q.net/"),
        (6, None), (7, "no scheme"), (8, "http://other.org/p"), (9, "http://third.org/p#frag"), (10, "http://example.com"), (11, "http://notcom/"), (12, "x://y.org://z/"), (12, "x://y.org://z/"),
        (13, "http://free.org/"), (14, "http://com/"),
    ]
    edges = [("http://other.org/p", "http://q.net/es/2"), ("http://third.org/p", "http://other.org/p"), ("http://free.org/", "http://q.net/fr/"), ("http://free.org/", "http://a.com/x"), (None, "u"), ("v", "v")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit(0))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, rules_, spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert sorted(got) == [
        (1, "a.com", "/x", "com/", "allow"), (2, "b.example.com", "/en/1", "example.com/en/", "block"), (3, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (4, "q.net", "/es/2", "net/es/", "block"), (5, "q.net", "/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"),
        (8, "other.org", "/p", None, "block"), (9, "third.org", "/p", None, "block"), (10, "example.com", "", None, "allow"), (11, "notcom", "/", None, "allow"),
        (12, "y.org:", "//z/", None, "allow"), (12, "y.org:", "//z/", None, "allow"), (13, "free.org", "/", None, "allow"), (14, "com", "/", "com/", "allow"),
    ]
    assert urls.filter_urls(df.limit(0), rules_, spark.createDataFrame([], "src string, dst string")).collect() == []


def url_classes(pages, edges):
    """Plain Python verdicts of pages (id, url), for edges between nodes."""
    host = lambda u: u.split("://", 1)[1].replace("?", "/").replace("#", "/").split("/")[0].lower() if "://" in u else ""
    path = lambda u: (("/" + rest[1]) if len(rest := u.split("://", 1)[1].split("#")[0].split("?")[0].split("/", 1)) > 1 else "") if "://" in u else ""
    node = lambda u: u.split("#")[0]

    def rule(u):
        fits = [(len(h + p), a == "allow", h + p, a) for a, h, p in urls.RULES if (host(u) == h or host(u).endswith("." + h)) and path(u).startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(node(a)), root(node(b))
        parent[max(x, y)] = min(x, y)
    seen = {}
    for u in {u for _, u in pages if u} | {x for e in edges for x in e}:
        if (action := rule(u)[1]) is not None and node(u) in parent:
            seen.setdefault(root(node(u)), set()).add(action)
    out = []
    for i, u in pages:
        r, action = rule(u or "")
        spread = "block" if u and node(u) in parent and seen.get(root(node(u))) == {"block"} else "allow"
        out.append((i, host(u or ""), path(u or ""), r, action or spread))
    return sorted(out)


def test_url_classes_of_a_random_graph(spark):
    """Pages whose html links them in long chains, stars and cycles, through page_edges and against plain Python."""
    rng = random.Random(11)
    hosts = ["a.com", "x.example.com", "www.example.com", "q.net", "other.org", "third.org", "Far.Org"]
    url = lambda k: f"http://{hosts[k % 7]}/{'en es fr p'.split()[k % 4]}/{k}"
    pages, edges = [], []
    for k in range(400):
        to = k + 7 if k < 120 else rng.choice([None, None, rng.randrange(400), 399 - k % 5])
        html = "<p>none</p>"
        if to is not None and to != k:
            html = f'<link rel="canonical" href="{url(to)}">' if k % 2 else f'<meta http-equiv="refresh" content="0;url={url(to)}">'
            edges.append((url(k), url(to)))
        pages.append((k, url(k) + ("#f" if k % 3 == 0 else ""), html))
    pages += [(1000 + k, None if k % 2 else "", None) for k in range(50)] + [(1100, "http://gone.org/", '<link rel=canonical href="http://q.net/es/zz">')]
    edges.append(("http://gone.org/", "http://q.net/es/zz"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rules_ = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    got = sorted(map(tuple, urls.filter_urls(df, rules_, urls.page_edges(df)).collect()))
    want = url_classes([(i, u) for i, u, _ in pages], edges)
    assert got == want
    assert len({x[4] for x in want if x[3] is None}) == 2  # aliases are blocked and others are not


def test_url_filters_run_no_python(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a/x", '<link rel="canonical" href="http://b/y">')], "page_id long, url string, html string")
    rules_ = spark.createDataFrame(urls.RULES, "action string, host string, path string")
    for pages in (df, df.withColumn("html", F.lit("none")), df.limit(0)):
        plans = []
        for module in (urls, components):
            monkeypatch.setattr(module, "cut", lambda x, real=_spark.cut: (plans.append(x._jdf.queryExecution().executedPlan().toString()), real(x))[1])
        plans.append(urls.filter_urls(pages, rules_, urls.page_edges(pages))._jdf.queryExecution().executedPlan().toString())
        assert len(plans) > 4
        assert not any(word in plan for plan in plans for word in ("MapInArrow", "MapInPandas", "EvalPython", "PythonUDF", "InPandas"))


def test_page_edges(spark):
    rows = [
        ("http://a/x#f", '<link href="http://b/y" rel="canonical">'), ("http://a/z", "<meta http-equiv=refresh content='0; url=/new'>"),
        ("http://a/q", "<link rel=stylesheet href=/s.css>"), (None, '<link rel="canonical" href="http://c/">'), ("http://a/n", None),
    ]
    got = urls.page_edges(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(map(tuple, got)) == [("http://a/x", "http://b/y"), ("http://a/z", "http://a/new")]


def test_relative_page_edges(spark):
    base = "http://h.org/d/e/page.html?q=1#f"
    cases = {
        "page2.html": "http://h.org/d/e/page2.html", "../x": "http://h.org/d/x", "../../../up/./y/": "http://h.org/up/y/", "..": "http://h.org/d/", "?id=2": "http://h.org/d/e/page.html?id=2",
        "?a=1&amp;b=2": "http://h.org/d/e/page.html?a=1&b=2", "//other.net/p": "http://other.net/p", "https://s.org/p?a=1&amp;b=2": "https://s.org/p?a=1&b=2", "/r/../t?u=/../v": "http://h.org/t?u=/../v",
        "./z?w=http://a/": "http://h.org/d/e/z?w=http://a/", "/&#233;&#x4e2d;&eacute;&#1114112;": "http://h.org/\u00e9\u4e2d\u00e9\ufffd", "/a?x=1&copy=2&notit;&lt": "http://h.org/a?x=1&copy=2&notit;<",
        "#top": None, "mailto:a@b": None, "page.html?q=1": "http://h.org/d/e/page.html?q=1", "/&#128;&#0;": "http://h.org/\u20ac\ufffd",
    }
    rows = spark.createDataFrame([(to,) for to in cases], "to string").select("to", urls.resolve(urls.unescape(F.col("to")), F.lit(base)).alias("dst")).collect()
    assert {r["to"]: r["dst"] for r in rows} == cases
    pages = [
        ("http://h.org", '<link rel="canonical" href="x">'), ("no site", '<link rel="canonical" href="x">'), ("http://s.org/a?b", '<link rel=canonical href="a?b">'),
        ("http://r.org/d/p", '<meta http-equiv="refresh" content="0; url=q?a=1&amp;b=2">'),
    ]
    got = urls.page_edges(spark.createDataFrame(pages, "url string, html string")).collect()
    assert sorted(map(tuple, got)) == [("http://h.org", "http://h.org/x"), ("http://r.org/d/p", "http://r.org/d/q?a=1&b=2")]


GOOD = "The river ran slowly past the old mill, and nobody spoke.\nLater the sun came out over the wide quiet fields again."
BAD = "WORD!! THING!! OTHER!! STUFF!! MORE!! AGAIN!! HERE!! THERE!! WHERE!! WHEN!! HOW!!\nred | green | blue | white | black | brown | grey | pink | teal | gold"


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(3)
    shuffle = lambda t: "\n".join(" ".join(rng.sample(x.split(), len(x.split()))) for x in t.split("\n"))
    rows = [(i, shuffle(GOOD if i % 2 else BAD)) for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)]
    return rules.train_field(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 20)


def test_quality(spark, field):
    rows = corpus(5, 50) + [(7000, GOOD), (7001, BAD), (7002, " ".join(f"w{i % 6}" for i in range(80))), (7003, GOOD + "\n" + GOOD)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).repartition(3)
    got = {r["row"]["doc_id"]: r for r in rules.score_quality(df, field).collect()}
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality(t)
        assert not (r["kept"] and r["base_failed"])
    assert [got[d]["kept"] for d in (7000, 7001, 7002)] == [True, False, False]
    out = rules.filter_quality(df, field)
    assert out.columns == df.columns and {7000} <= {r["doc_id"] for r in out.collect()}
    assert rules.score_quality(df.limit(0), field).collect() == []


def test_quality_sample_is_bounded(spark):
    """Many documents under one labelled id, some repeated, and a very long one."""
    rows = [(1, GOOD + f"\nline {i} is here, and it ends well.") for i in range(300)] + [(1, GOOD)] * 50 + [(2, BAD)] * 40 + [(2, "\n".join([BAD] * 3000))]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = []
    real = rules.fit_field
    rules.fit_field = lambda seqs, ys: got.append((seqs, ys)) or real(seqs, ys)
    try:
        f = rules.train_field(spark.createDataFrame(rows, DOCS).repartition(3), labels, 20)
    finally:
        rules.fit_field = real
    seqs, ys = got[0]
    assert ys.count(1) == 20 and ys.count(0) == 2 and max(map(len, seqs)) == rules.SAMPLE_LINES
    out = rules.score_quality(spark.createDataFrame([(1, GOOD)] * 3 + [(3, "\n".join([GOOD] * 2)), (4, "\n".join(f"{i} {GOOD}" for i in range(3000)))], DOCS), f).collect()
    assert [r["n_words"] for r in out if r["row"]["doc_id"] == 1] == [22] * 3


def test_field_against_enumeration():
    """One step's gradient direction: the fit raises the likelihood that enumerating all labellings gives."""
    from itertools import product

    rng = np.random.default_rng(7)
    seqs = [rng.normal(size=(n, len(rules.FEATURES))) + (i % 2) for i, n in enumerate((1, 3, 2, 4, 1, 3))]
    ys = [i % 2 for i in range(6)]
    f = rules.fit_field(seqs, ys, steps=60)

    def log_likelihood(field):
        total = 0.0
        for s, y in zip(seqs, ys):
            e = s @ field.emission
            value = lambda l: field.start[l[0]] + sum(e[i, c] for i, c in enumerate(l)) + sum(field.transition[a, b] for a, b in zip(l, l[1:]))
            total += value((y,) * len(s)) - np.logaddexp.reduce([value(l) for l in product((0, 1), repeat=len(s))])
        return total

    assert log_likelihood(f) > log_likelihood(rules.fit_field(seqs, ys, steps=5)) > log_likelihood(rules.fit_field(seqs, ys, steps=1))
    assert log_likelihood(f) > -1


def test_viterbi_against_enumeration(field):
    from itertools import product

    rng = np.random.default_rng(2)
    sizes = [3, 0, 1, 5, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(first[-1], 2))
    f = rules.Field(field.emission, rng.normal(size=(2, 2)), rng.normal(size=2))
    got = rules.viterbi(scores, first, f)
    for a, b in zip(first, first[1:]):
        if a < b:
            value = lambda y: f.start[y[0]] + sum(scores[a + i, c] for i, c in enumerate(y)) + sum(f.transition[p, q] for p, q in zip(y, y[1:]))
            assert tuple(got[a:b]) == max(product((0, 1), repeat=b - a), key=value)


def test_neutral_field(spark):
    field = rules.train_field(spark.createDataFrame([(1, "x")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["kept"] for r in rules.score_quality(spark.createDataFrame([(1, BAD), (2, None)], DOCS), field).collect()] == [True, False]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="lead"><p>Template blurb of the site</p></div>
<article><h1>Title &amp; more</h1><p>First <b>para<i>graph</i></b> &eacute;&#233;&nbsp;x<br>next<p>Second one<ul><li>item 1<li>item 2</ul>
<div class="ad-box">Buy!</div><aside>Side</aside><form><input>Send</form><table><tr><td>c1<td>c2</table><!-- hidden --><p>Own {own}</p>
<section id="comments"><p>Nice post</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE.replace("{own}", "text"), set()) == "Title & more First paragraph éé x next Second one item 1 item 2 c1 c2 Own text"
    assert html_text.main_text(None, set()) == "" and html_text.main_text("", set()) == ""
    assert html_text.main_text("plain &lt;text&gt; a < b", set()) == "plain <text> a < b"
    assert html_text.main_text("<article><p>cut off &am", set()) == "cut off &am"
    assert html_text.main_text("<article><p>cut off <a hre", set()) == "cut off"
    assert html_text.main_text("<main><p>m</p></main><p>outside</p>", set()) == "m"
    assert html_text.main_text("<body><p hidden>h</p><p>a</p></p></div>b<br/>c</body>", set()) == "a b c"
    assert html_text.main_text("<article>x<script>var q = '<p>y</p>'", set()) == "x"
    assert html_text.main_text("<p>" * 3000 + "deep" + "<div>" * 3000, set()) == "deep"


def test_furniture_around_the_article():
    side = '<nav>n</nav><div class="sidebar"><article>teaser</article></div><section id="comments"><article>Nice post, I liked it a lot</article></section>'
    for wrap in ("<form id=f>%s</form>", '<div class="page has-sidebar">%s</div>', '<div class="layout-top"><form>%s</form></div>', '<main><div class="content with-comments">%s</div></main>'):
        assert html_text.main_text(f"<body><header>Site</header>{wrap % ('<article><p>The long main text of this page</p></article>' + side)}<footer>f</footer></body>", set()) == "The long main text of this page"
    assert html_text.main_text('<div class="page has-sidebar"><nav>n</nav><div role=main>own text</div></div>', set()) == "own text"
    assert html_text.main_text(f"<body><article>short</article>{side}</body>", set()) == "short"
    assert html_text.main_text(f"<body><div>a page without an article, but with long text of its own and more of it</div>{side}</body>", set()).startswith("a page without")
    assert html_text.main_text("<body><p>p</p><template><article>not shown</article></template><div hidden><article>nor this</article></div></body>", set()) == "p"


def test_templates(spark):
    body = lambda i: f"<body><div><p>Welcome to our wonderful site</p></div><div><p>Story {i} is told here</p><p>Quoted by all</p></div></body>"
    rows = [(i, f"http://one.org/{i}", body(i)) for i in range(12)] + [(100 + i, f"http://two.org/{i}", PAGE.replace("{own}", f"t{i}")) for i in range(5)]
    rows += [(200, "http://one.org/0", body(0)), (300, None, None), (301, "http://x.org", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).repartition(3)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert [got[i] for i in (0, 3, 200)] == ["Story 0 is told here", "Story 3 is told here", "Story 0 is told here"]
    assert got[102].endswith("c1 c2 Own t2") and got[300] == got[301] == ""
    assert html_text.extract_text(df.limit(0)).collect() == []


def simple_templates(rows, min_pages):
    """Plain Python (host, box) pairs on min_pages distinct pages, for pages that are a row of boxes without nesting."""
    seen = {}
    for _, url, html in rows:
        host = url.split("/")[2]
        for box in set(re.findall(r"<div>.*?</div>", html)):
            seen.setdefault((host, box), set()).add(html)
    return {k for k, pages in seen.items() if len(pages) >= min_pages}


def test_templates_against_brute_force(spark):
    """Random pages of boxes without any word that lists know: what stays is what the counts say, on hosts of all sizes."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        host = rng.choice(["big.org"] * 6 + [f"h{k}.org" for k in range(12)])
        boxes = [f"<div>{host} block {rng.choice([1, 1, 2, 3, rng.randrange(60)])}</div>" for _ in range(rng.randrange(0, 4))] + [f"<div>own {rng.randrange(250)} words</div>"]
        rng.shuffle(boxes)
        rows.append((i, f"http://{host}/{i}", "<body>" + "".join(boxes) + "</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    templates = simple_templates(rows, html_text.MIN_PAGES)
    for i, url, html in rows:
        boxes = re.findall(r"<div>.*?</div>", html)
        left = [b for b in boxes if (url.split("/")[2], b) not in templates]
        assert got[i]["text"] == " ".join(b[5:-6] for b in left)
        assert got[i]["template_chars"] == sum(len(b) - 11 for b in boxes if b not in left) and got[i]["furniture_chars"] == 0
    without = {i: html_text.main_text(html, set()) for i, _, html in rows}
    assert sum(got[i]["text"] != without[i] for i in without) > 150  # the counts do this work, nothing else


def test_extraction_reports_what_each_step_deletes():
    html = "<body><div>ab cd</div><nav>xyz</nav><article><p>text</p></article></body>"
    elements, _ = html_text.parse(html)
    box = next(h for k, h in html_text.subtree_hashes(html, elements, True) if elements[k].tag == "div")
    assert html_text.extract(html, {box}) == ("text", 5, 3) and html_text.extract(html, set()) == ("text", 0, 3)
    assert html_text.extract(None, set()) == ("", 0, 0)


def test_templates_of_a_large_host(spark):
    notice = "<div><p>This section moves next week</p></div>"
    rows = [(i, f"http://big.org/{i}", f"<body>{notice if i < 4 else ''}<div><p>Story {i} of a large host</p></div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()} == {i: f"Story {i} of a large host" for i in range(60)}


def test_sha_helper():
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
