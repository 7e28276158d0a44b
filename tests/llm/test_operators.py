"""Every operator against a plain version on a small table with all the odd cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.llm import bpe, exact, html, langid, lm, packing, pu, rules, simhash, urltree
from rillflow.llm.queries import vocabulary

white = bytes.split


def words(t):
    return (t or "").encode().lower().split()


# 1 --------------------------------------------------------------------------------------------------------------------

def plain_model(train, order):
    toks = [words(t) + [b""] for t in train]
    uni = Counter(w for d in toks for w in d)
    three = Counter(p for d in toks for p in zip([None, None, *d], [None, *d], d))
    if order == 2:
        two = Counter(p for d in toks for p in zip([None, *d], d))
    else:
        two = Counter()
        for (_, v, w), c in three.items():
            two[v, w] += c if v is None else 1
    follow, begins, fresh = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), c in two.items():
        follow[u][0] += c
        follow[u][min(c, 3)] += 1
        fresh[w] += 1
    for (t, u, _), c in three.items():
        begins[t, u][0] += c
        begins[t, u][min(c, 3)] += 1
    d3, d2, d1 = ([0, *lm.discounts(np.array([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]))] for x in (three, two, fresh))
    every, size, n = sum(fresh.values()), len(uni), sum(uni.values())
    low = sum(d1[min(v, 3)] for v in fresh.values()) / every / (size + 1)

    def one(w):
        return max(fresh[w] - d1[min(fresh[w], 3)], 0) / every + low

    def over(x, c, d, below):
        return (max(c - d[min(c, 3)], 0) + sum(a * b for a, b in zip(d[1:], x[1:])) * below) / x[0]

    def p(t, u, w):
        best = one(w)
        if u in follow:
            best = over(follow[u], two[u, w], d2, best)
        if order == 3 and (t, u) in begins:
            best = over(begins[t, u], three[t, u, w], d3, best)
        return best

    return uni, n, size, p


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, docs, rows, none, order):
    got = lm.score_documents(docs, order=order).collect()
    uni, n, size, p = plain_model([t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1], order)
    by_id = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for t, u in ((b"of", b"the"), (None, None), (b"unseen", b"the")):
        assert abs(sum(p(t, u, w) for w in uni) + p(t, u, b"unseen") - 1) < 1e-9
    for r in got:
        if r["doc_id"] is None:
            assert not r["held_out"]
            continue
        d = words(by_id[r["doc_id"]]) + [b""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(d), sum(w in uni for w in d), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(log10((uni[w] + 0.5) / (n + 0.5 * (size + 1))) for w in d))
        assert r["score"] == pytest.approx(sum(log10(p(t, u, w)) for t, u, w in zip([None, None, *d], [None, *d], d)))
    assert lm.score_documents(none, order=order).collect() == []
    assert all(r["score"] == 0 for r in lm.score_documents(docs, F.lit(True), order).collect())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 10**6)), max_size=40))
def test_blobs(pairs):
    keys = np.array(sorted({k for k, _ in pairs}), np.uint64)
    counts = np.arange(1, len(keys) + 1)
    k, c = lm.unpack(lm.pack(keys, counts), np.uint64)
    assert (k == keys).all() and (c == counts).all()
    k, t, c = lm.unpack(lm.pack(keys, counts, counts + 7), np.uint64, True)
    assert (k == keys).all() and (c == counts).all() and (t == counts + 7).all()


# 2 --------------------------------------------------------------------------------------------------------------------

def groups(fps, tau):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


def group_of(got, fps, group):
    of = dict(zip(fps, group))
    return [of[r["fp"] % (1 << 64)] for r in got]


@pytest.mark.parametrize("size, tau", [(3, 3), (5, 5)])
def test_simhash(docs, rows, none, size, tau):
    import xxhash

    def plain(t):
        w = words(t)
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    got = simhash.near_duplicates(docs, size, tau).collect()
    ids, fps = [i for i, *_ in rows], [plain(t) for _, t, *_ in rows]
    group = groups(fps, tau)
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in group}
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((str(i), f, least[g]) for i, f, g in zip(ids, fps, group))
    assert sorted((f, n) for f, n in Counter(group).items()) == sorted({(g, r["component_size"]) for g, r in zip(group_of(got, fps, group), got)})
    assert simhash.near_duplicates(none, size, tau).collect() == []


@pytest.mark.parametrize("tau", [1, 2, 3, 5])
def test_pigeonhole_finds_every_link(spark, tau, monkeypatch):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for _ in range(3):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.add(int(x) ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    reps = spark.createDataFrame([(f, f) for f in signed], "node long, fp0 long")
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= tau}
    for cell, block in ((1 << 16, 1 << 18), (64, 1 << 18), (128, 40)):  # one cell, several, and cells dealt in blocks
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.search(reps, tau, pairs=True).collect()}
        assert got == want
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.search(reps, tau).collect()]
        assert joined(fps, edges) == joined(fps, want)


def joined(nodes, edges):
    """The least node of each node's component."""
    least = {k: k for k in nodes}

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {k: find(k) for k in nodes}


def test_bucket_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    at = np.sort(rng.integers(0, 4000, 500))
    edges = simhash._bucket(np.arange(250), np.arange(250, 500), lambda a, b: np.abs(at[a] - at[b]) <= 3)
    every = [(a, b) for a in range(250) for b in range(250, 500) if abs(at[a] - at[b]) <= 3]
    found = [(int(a), int(b)) for x, y in edges for a, b in zip(x, y)]
    assert all(abs(at[a] - at[b]) <= 3 for a, b in found)
    want, got = joined(range(500), every), joined(range(500), found)
    assert all(got[a] == got[b] for a, b in every) and len(found) < 4000
    assert {k for k in want if want[k] == k} >= {k for k in got if got[k] == k}


def test_allocation_sums_and_is_cheapest():
    rng = np.random.default_rng(0)
    costs = [np.cumsum(rng.random((5, 30)), axis=0) for _ in range(3)]
    t, cost = simhash.allocate(costs, 1)
    assert (t.sum(axis=1) == 1).all() and (t >= -1).all()
    best = min(costs[0][a + 1, 7] + costs[1][b + 1, 7] + costs[2][c + 1, 7] for a in range(-1, 4) for b in range(-1, 4) for c in range(-1, 4) if a + b + c == 1)
    assert cost[7] == pytest.approx(best)


# 3 --------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_bpe(docs, rows, none, library):
    got = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json"), ids=True, text=True).collect()
    by_id = {i: t or "" for i, t, *_ in rows if i is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            want = library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids
            assert list(r["ids"]) == want and r["n_tokens"] == len(want) and r["decoded"] == by_id[r["doc_id"]]
            assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(none, vocabulary("byte_bpe_50k.json")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcTHE \n\t\r\x0b\x1c\x85\xa0'.,!1²é\u0301中😀\0", "  ", "<|endoftext|>", "'ll", " the", "ing"]), max_size=30).map("".join))
def test_bpe_like_the_library(text):
    from tokenizers import Tokenizer

    b, t = bpe.load(vocabulary("byte_bpe_50k.json")), test_bpe_like_the_library.__dict__.setdefault("t", Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
    assert np.frombuffer(b.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


# 4 --------------------------------------------------------------------------------------------------------------------

def test_exact(docs, rows, none, clashing):
    got = exact.exact_groups(docs, capacity=4).collect()
    norm = ["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for _, t, *_ in rows]
    size = Counter(norm)
    best = {}
    for (i, t, *_), k in zip(rows, norm):
        rank = (-len(t or ""), i is None, i or 0)
        best[k] = min(best.get(k, (rank, i)), (rank, i))
    want = sorted((str(i), str(best[k][1]), size[k], i == best[k][1] and -len(t or "") == best[k][0][0], hashlib.sha256(k.encode()).hexdigest()) for (i, t, *_), k in zip(rows, norm))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact.exact_groups(none).collect() == []
    kept = exact.drop_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(w[3] for w in want)


@pytest.mark.parametrize("hashed", [lambda c: F.shiftleft(F.xxhash64(c), 63), lambda c: F.lit(5).cast("long"), lambda c: F.shiftright(F.xxhash64(c), 61)])
def test_exact_walks_chains(docs, rows, clashing, hashed, monkeypatch):
    """With hashes of one bit, of none and of three low bits the answers are those of whole hashes."""
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, F.lit(-(1 << 63)).cast("long")).otherwise(F.col("doc_id")))
    order = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(map(str, exact.exact_groups(odd).select(*order).collect()))
    kept = sorted(str(r["doc_id"]) for r in exact.drop_duplicates(clashing).collect())
    monkeypatch.setattr(exact, "HASH", hashed)
    assert sorted(map(str, exact.exact_groups(odd, capacity=1).select(*order).collect())) == want
    assert sorted(str(r["doc_id"]) for r in exact.drop_duplicates(clashing).collect()) == kept


def test_directory_splits_overfull_buckets(spark):
    index = spark.range(5000).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("n"))
    d, depth = exact.directory(index, capacity=100)
    cells = index.withColumn("cell", F.shiftrightunsigned("h", 64 - depth)).join(d, "cell")
    assert cells.count() == 5000
    size = cells.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in size) <= 100 and len({r["bucket"] for r in size}) == len(size)
    d, depth = exact.directory(index, capacity=5000)
    assert depth == 0 and [tuple(r) for r in d.collect()] == [(0, 5000, 0, 0)]
    close = spark.range(300).select(F.col("id").alias("h"), F.lit(1).cast("long").alias("n"))  # keys that differ in their last bits only
    d, depth = exact.directory(close, capacity=100)
    assert depth > 55 and d.groupBy("bucket").agg(F.sum("__n").alias("n")).filter("n > 100").count() == 0


# 5 --------------------------------------------------------------------------------------------------------------------

def test_urls(spark):
    urls = [None, "no scheme", "HTTP://Example.NET/en/1?x#y", "http://net", "http://a.net/x", "http://badexample.net/en/", "http://sub.example.com/de/", "http://example.com/DE/", "x://y.org/fr/a://b",
            "http://org?fr/", "://org/fr/", "http://host.io/p/1.html", "http://host.io/p/2.html"] + [f"http://bad.io/spam/{k}" for k in range(40)] + [f"http://bad.io/good/{k}" for k in range(40)] + [
            f"http://many.io/{w}{w}" for w in "abcdefghijklmnopqrst"]
    pages = spark.createDataFrame([*enumerate(urls), (0, None)], "page_id long, url string")
    labels = spark.createDataFrame([(k, "spam" not in (urls[k] or "")) for k in range(13, 93, 2)], "page_id long, good boolean")

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, None
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
        fits = [(len(h + p), h + p, a) for a, h, p in urltree.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None

    got = urltree.judge(pages, labels).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if "/spam/" in path else "allow"))
        if host == "many.io":
            assert r["template"] == "*"
    assert urltree.judge(pages.limit(0), labels).collect() == [] and urltree.judge(pages, labels.limit(0)).count() == len(got)


# 6 --------------------------------------------------------------------------------------------------------------------

def plain_statistics(t):
    t = t or ""
    w = t.encode().split()
    windows = Counter(zip(w, w[1:], w[2:]))
    again = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(again)


def test_rules(spark, docs, rows, none, clashing):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(25)] + [(None, 1, 0), (301, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.quality(docs, labels).collect()
    by_id = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            s = plain_statistics(by_id[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
            assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and (not r["kept"] or not r["base_failed"])
    assert rules.quality(none, labels).collect() == []
    assert rules.quality(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    kept = rules.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == sum(r["kept"] for r in got)
    odd = [(rules.Condition("symbol_share", True, 0.01),), (rules.Condition("mean_word_chars", False, 4.0), rules.Condition("repeat_share", True, 0.1))]
    some = [(k, " ".join(f"w{i * 7 + k}{'#' * (k % 3 if i % 4 == 0 else 0)}" for i in range(40 + k))) for k in range(40)]
    judged = [r.asDict() for r in rules.judged(spark.createDataFrame([*some, (99, None)], "doc_id long, text string"), odd).collect()]
    assert all(r["kept"] == (not r["base_failed"] and not any(rules.covers(rule, r) for rule in odd)) for r in judged)
    assert {r["kept"] for r in judged if not r["base_failed"]} == {True, False}


def test_columns_of_any_name(spark, clashing, rows):
    """Extra columns with the names that operators use themselves change nothing for those not tested so above."""
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for got in (lm.score_documents(clashing), simhash.near_duplicates(clashing), bpe.encode_decode(clashing, vocabulary("byte_bpe_50k.json")), pu.score(clashing, labels)):
        assert got.count() == len(rows)
    assert packing.pack(clashing, vocabulary("word_bpe_49k.json"), 2048).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_list_finds_a_conjunction_and_prunes_noise():
    rng = np.random.default_rng(0)
    data = [{f: float(x) for f, x in zip(rules.FEATURES, rng.random(len(rules.FEATURES)))} for _ in range(900)]
    for r in data:
        r["label"] = int(not (r["symbol_share"] > 0.7 and r["caps_share"] <= 0.4))
    found = rules.learn(data)
    hit = [any(rules.covers(c, r) for c in found) for r in data]
    assert np.mean([h == (r["label"] == 0) for h, r in zip(hit, data)]) > 0.98
    assert rules.learn([{**r, "label": 1} for r in data]) == [] and rules.learn([]) == []


# 7 --------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">More here</a></ul></nav><div class="cookie-notice">We use cookies to make this site work for all of you.</div>
<article><h1>A  title</h1><p>First <b>para</b>graph with a <a href="x>y">link</a> &amp; more&nbsp;words, enough to be read.<p>Two.<br>Three &lt;4&gt;</p>
<form><label>Name</label><input><button>Send it</button></form><div class="comments"><p>A reader says that this is a very good text indeed.</p></div></article>
<aside>Another thing that has nothing to do with it at all, but is long.</aside><footer>&copy; us &middot; imprint and all the rights of this page</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (5, "u", "<p>open <b>and <i>never closed"), (6, "u", "<" * 5000 + "a='"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html.extract(pages.withColumn("text", F.lit(1))).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "A title First paragraph with a link & more words, enough to be read. Two. Three <4>"
    assert text[2] == text[3] == "" and text[4] == "plain words only" and text[5] == "open and never closed"
    assert html.extract(pages.limit(0)).collect() == []


def test_tree_fits_its_table():
    rows = html.table()
    assert len({r[:-1] for r in rows}) == len({*rows})
    assert all(html.accepted(r[:-1], html.tree()) == bool(r[-1]) for r in rows)


def test_tree_tests_words_and_neighbours():
    def asked(node):
        return {html.FEATURES[node[0]]} | asked(node[2]) | asked(node[3]) if isinstance(node, tuple) else set()

    assert asked(html.tree()) >= {"words", "links", "prev_words", "prev_links", "next_words", "next_links"}
    long, menu = "word " * 40, "<ul><li><a href=x>One</a><li><a href=y>Two three</a></ul>"
    assert html.main_text(f"{menu}<div>Send us a note</div>{menu}<h1>A title</h1><p>{long}</p><p>Short.</p>{menu}<p>All of the rights</p>") == f"A title {long.strip()} Short."
    both = f'<div class="related-work"><h2>Related work</h2><p>{long}</p></div><div class="related-work"><p>Share this</p></div>'
    assert html.main_text(f"<article><p>Hi.</p>{both}{menu}</article>") == f"Hi. Related work {long.strip()}"


@pytest.mark.parametrize("page, text", [
    ('<article><p>Hello <svg class="i"/> world</p><p>Second</p></article>', "Hello world Second"),
    ("<datalist><option>a<option>b</datalist><article><p>Hi there</p></article>", "Hi there"),
    ('<article><p>One</p><div class="social-history"><p>' + "word " * 20 + "</p></div></article>", "One " + "word " * 19 + "word")])
def test_no_text_is_lost(page, text):
    assert html.main_text(page) == text


class Reader(__import__("html.parser").parser.HTMLParser):
    """Blocks of well-formed pages by the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.linked, self.open, self.link = [], [], 0, [], False
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = "".join(self.words).split()
        if text:
            apart = {"nav", "footer", "head", "header", "aside", "form"} & {t for t, _ in self.open}
            self.out.append((" ".join(text), len(text), min(1.0, self.linked / len(text)), bool(apart), any(c == "ad" for _, c in self.open), False, any(t == "article" for t, _ in self.open)))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK:
            self.end()
        if tag in html.REGION or tag in ("title", "script", "style"):
            self.open.append((tag, dict(attrs).get("class")))
        self.link = tag == "a" or self.link and tag not in html.BLOCK

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.end()
        if tag in {t for t, _ in self.open}:
            while self.open.pop()[0] != tag:
                pass
        self.link = self.link and tag != "a" and tag not in html.BLOCK

    def handle_data(self, data):
        if not {"title", "script", "style"} & {t for t, _ in self.open}:
            self.words.append(data)
            self.linked += len(data.split()) if self.link else 0


def test_pages_by_another_parser(spark):
    """Blocks, features and text of all pages of the table by a plain reading of each."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) > 200
    for r in rows:
        found = Reader(r["html"]).out
        assert html.blocks(r["html"]) == found
        kept = []
        for k, b in enumerate(found):
            p, n = found[k - 1] if k else ("", 0, 0.0), found[k + 1] if k + 1 < len(found) else ("", 0, 0.0)
            row = (p[1], p[2], b[1], b[2], n[1], n[2], b[3], b[4], b[5], b[6], not b[6] and any(x[6] and not x[3] and not x[4] for x in found))
            kept += [b[0]] if html.accepted(row, html.tree()) else []
        assert html.main_text(r["html"]) == " ".join(kept) == " ".join(b[0] for b in found if b[6])


# 8 and 9 --------------------------------------------------------------------------------------------------------------

def test_language(docs, rows, none, clashing):
    got = langid.identify(docs).collect()
    lang = {i: x for i, _, x, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (300, 301, 302, 303):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["doc_id"] is not None and (r["doc_id"] < 40 or 100 <= r["doc_id"] < 125):
            assert r["lang_pred"] == lang[r["doc_id"]]
    assert langid.identify(none).collect() == [] and {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_known(clashing)
    assert kept.columns == clashing.columns and kept.filter("doc_id in (300, 301, 302, 303)").count() == 0 and kept.filter("doc_id < 40").count() == 41


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    want = Counter() if t.strip() == "" else Counter(g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i:i + n]) != " " and not (n == 3 and g[1] == " "))
    codes, counts = langid.gram_counts(text)
    assert dict(zip(codes.tolist(), counts.tolist())) == {sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))): n for g, n in want.items()}


def test_quality_classifier(spark, docs, rows, none):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(25)] + [(None, 1, 0), (301, None, 0)], "doc_id long, quality int, toxic int")
    got = pu.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert pu.score(none, labels).collect() == []
    assert {r["score"] for r in pu.score(docs, labels.limit(0)).collect()} == {0.5}


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (900, 3))
    mixed = np.vstack([rng.normal(1.5, 1, (2100, 3)), negative])
    model = pu.fit(positive, mixed, 0.7)
    assert (pu.predict(negative, model) < 0.5).mean() > 0.95 and (pu.predict(positive, model) >= 0.5).mean() > 0.95


# 10 -------------------------------------------------------------------------------------------------------------------

def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path, cap = vocabulary("word_bpe_49k.json"), 256
    got = packing.pack(docs, path, cap).collect()
    library, by_id = Tokenizer.from_file(path), {i: t or "" for i, t, *_ in rows if i is not None}
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t in by_id.items():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        copies = sum(x[0] == i for x in rows)
        assert len(mine) == copies * -(-len(ids) // cap)
        for r in mine:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == r["piece"] * cap and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    assert len(used) <= -(-sum(r["length"] for r in got) // cap) * 1.1 + 1
    assert packing.pack(none, path, cap).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.sampled_from(["norm", "dot"]), st.integers(1, 12), st.integers(2500, 5000))
def test_best_fit_keeps_every_capacity(counts, rule, max_docs, max_cost):
    placed, n = packing.best_fit(counts, 50, max_docs, max_cost, rule)
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, many, first, offset in placed.tolist():
        for k in range(many):
            bins[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()} and len(bins) == n
    for parts in bins.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(p[1] for p in parts) <= 50 and len(parts) <= max_docs and sum(p[1] ** 2 for p in parts) <= max_cost
