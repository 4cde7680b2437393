"""Training-data operators against brute force on small tables with nulls, empty texts, ties and clashing columns."""

import base64
import hashlib
import math
import random
from collections import Counter

import pytest

from lithoframe.llm import components, decontaminate, html, mixing, neardup, quality, sharding, suffixes, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, band long, id string"


def texts(seed=5, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épée", "the", "of", "and", "to", "x#y", "ζ"]
    base = [" ".join(rng.choices(words, k=rng.randint(20, 80))) for _ in range(8)]
    out = [None, "", " \t\n", "one", "one two", "one two", "A B", "a b", "word " * 300]
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(rng.choice([" ", "\n"]).join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), "d", 1, "z") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return (t or "").encode().split()


def test_quality(docs, duck):
    got = {r["doc_id"]: r["quality"] for r in quality.judge(docs).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(texts()):
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) for j in range(5) if seen[tuple(w[k : k + 5])] > 1}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        q = got[i]
        assert (q["n_words"], q["n_repeat_words"], q["n_dup_lines"]) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert q["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (q["base_failed"] and q["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, q in got.items() if q["kept"]}


def jump(key, n):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, docs):
    extra = spark.createDataFrame([(None, "t"), (None, "t"), (-7, "x"), (2**62, None)], "doc_id long, text string")
    rows = sharding.shard(docs.select("doc_id", "text").union(extra), 5, sub_ranges=7).collect()
    assert len(rows) == docs.count() + 4
    for r in rows:
        assert r["shard"] == jump(r["doc_id"] or 0, 5) and r["grown_shard"] in (r["shard"], 5)
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_urls(spark):
    cases = [
        ("http://Example.COM/en/71?x", "example.com", "/en/71", "example.com/en/7", "allow"), ("https://a.b.com/en/", "a.b.com", "/en/", "com/en/", "block"),
        ("https://xcom/en/", "xcom", "/en/", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://m.example.net/de/85#q", "m.example.net", "/de/85", "example.net/de/8", "block"), ("http://net/de/9", "net", "/de/9", "net/de/", "block"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases + cases[:2] + cases[:1])], "page_id long, url string, rule string")
    pages = pages.union(pages.where("page_id = 0"))
    got = Counter(tuple(r) for r in urls.judge(pages, urls.rule_table(spark)).collect())
    want = Counter((i, *c[1:]) for i, c in enumerate(cases + cases[:2] + cases[:1]))
    want[(0, *cases[0][1:])] += 1
    assert got == want
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (5, "v", ""), (4, "w", "<p>é</p>"), (9, "z", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archive = warc.write(df)
    rows = {r["page_id"]: r for r in warc.read(archive).collect()}
    first: dict[bytes, int] = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        assert bytes(rows[i]["payload"]) == b and rows[i]["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        head = bytes(rows[i]["header"]).decode()
        assert f"WARC-Type: {'response' if f == i else 'revisit'}\r\n" in head
    record = {r["page_id"]: bytes(r["record"]) for r in warc.records(archive).collect()}
    assert record[9].endswith(b"\r\n\r\nother\r\n\r\n") and archive.payloads.count() == 3


def test_decontamination(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(14, 40)))) for i in range(12)] + [(90, "tiny item"), (91, None), (92, "")]
    rows = []
    for i in range(40):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            leak = items[i % 12][1].upper().split()
            if i % 2:
                leak[-1] = "changed"
            w[len(w) // 2 : len(w) // 2] = leak
        rows.append((i, " ".join(w)))
    rows += [(50, "Tiny  ITEM"), (51, "not a tiny item"), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def bag(w):
        return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    want = set()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            spots = range(len(w) - len(v) + 1) if len(v) >= 5 else ([0] if len(w) == len(v) else [])
            for k in spots if v else []:
                a, b = bag(w[k : k + len(v)]), bag(v)
                n = sum((a & b).values())
                if n >= 0.8 * (sum(a.values()) + sum(b.values()) - n):
                    want.add((d, i))
    for block in (20_000, 4):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, block_items=block).collect()}
        assert got == want and want
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_edited(spark):
    # 60 words with one changed mid-passage and one near an end: 50 of 56 shingles shared, a similarity of 0.806
    items = [(i, [f"w{i}x{k}" for k in range(60)]) for i in range(1500)]
    rows = [(i, " ".join(["before", "it", *w[:25 + i % 9], "changed", *w[26 + i % 9 : 59], "last", "after"])) for i, w in items]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i, _ in items}
    # the window from one word earlier shares as many
    assert {r["first_word"] for r in found} <= {1, 2} and {round(r["similarity"], 3) for r in found} == {0.806}
    # fingerprints may be farther apart than the old radius
    assert max(r["distance"] for r in found) > 15


def test_decontamination_short(spark):
    rng = random.Random(12)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(300)], k=n))) for i, n in enumerate((24, 30, 60, 60, 100))] + [(90, "tiny item"), (91, "Solo"), (92, "a b a b")]
    rows = [(100 * i + cut, " ".join(t.split()[:-cut])) for i, t in items[:5] for cut in (1, 2, 5, 9, 12, 20)]
    rows += [(1000 + i, " ".join(t.split()[2:])) for i, t in items[:5]]
    rows += [(2000, "not a TINY  item"), (2001, "tiny"), (2002, "item"), (2003, "x solo y solo"), (2004, "c a b a b a b"), (2005, "a b a"), (2006, None), (2007, "b"), (2008, "tiny item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def bag(w):
        return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    want = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, v in ((i, s.lower().split()) for i, s in items):
            size = min(len(v), len(w))
            for k in range(len(w) - size + 1):
                a, b = bag(w[k : k + size]), bag(v)
                n = sum((a & b).values())
                if n >= 0.8 * (sum(a.values()) + sum(b.values()) - n):
                    want.setdefault((d, i), (k, size))
    found = decontaminate.contaminated(docs, bench, short_inside=True).collect()
    assert {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in found} == want
    assert {(1, 0), (201, 2), (2000, 90), (2003, 91), (2004, 92)} <= set(want)
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, short_inside=True).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_mixing(spark, docs, duck):
    out = mixing.mix(docs, weights={"s0": 3, "s1": 1, "": 1}).collect()
    assert {r["source"] for r in out} <= {"s0", "s1", None}
    copies = Counter(r["doc_id"] for r in out)
    assert all(copies[r["doc_id"]] == r["n_copies"] for r in out) and len({r["mix_key"] for r in out}) == len(out)
    again = Counter(r["doc_id"] for r in mixing.mix(docs.repartition(3), weights={"s0": 3, "s1": 1, "": 1}).collect())
    assert again == copies
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_tiny_sources(spark):
    def count(key, rate):  # smallest count whose distribution function is above the document's number
        u = int(hashlib.md5(f"17|{key}".encode()).hexdigest()[:13], 16) / 2.0**52
        total, k = 0.0, 0
        while u >= (total := total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))):
            k += 1
        return k

    rows = [(i, "big", "x" * 100_000) for i in range(10)] + [(i, "tiny", "y") for i in range(10, 14)] + [(20, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id", "copy").distinct().collect())
    size = {"big": 1_000_000, "tiny": 4, None: 2}
    rate = {k: n**0.5 / sum(x**0.5 for x in size.values()) * sum(size.values()) / n for k, n in size.items()}
    assert rate["tiny"] < mixing.MOST < rate[None]
    assert got == {i: n for i, s, _ in rows if (n := count(i, rate[s]))}
    weights = {"big": 1, "tiny": 1, "": 1}
    got = Counter(r["doc_id"] for r in mixing.mix(docs, weights=weights).select("doc_id", "copy").distinct().collect())
    assert got == {i: n for i, s, _ in rows if (n := count(i, sum(size.values()) / 3 / size[s]))}


def test_near_duplicates(spark, docs):
    for k in (2, 5):
        sets = {}
        for i, t in enumerate(texts()):
            w = (t or "").encode().lower().split()
            sets[i] = frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent = {i: i for i in sets}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b]:
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, k=k).collect()}
        assert len(got) == len(sets)
        assert all((got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), root(i)) for i in sets)
    kept = neardup.keep_one(docs, k=5)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in sets if root(i) == i} and kept.columns == docs.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}


def cut(rows, n=50):
    first: dict[bytes, int] = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            first.setdefault(b[k : k + n], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_suffixes(spark, monkeypatch, chunk):
    rng = random.Random(4)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    parts = ["".join(rng.choices("abé \n", k=rng.randint(30, 130))) for _ in range(9)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 4)))) for i in range(40)]
    rows += [(100, None), (101, "a" * 500), (102, "a" * 49), (103, "a" * 51), (104, ""), (99, "a" * 60)]
    got = {r["doc_id"]: r for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = cut(rows)
    assert {i: bytes(r["kept"]) for i, r in got.items()} == want
    for i, t in rows:
        b = (t or "").encode()
        spans = [(s["begin"], s["end"]) for s in got[i]["spans"]]
        assert len(b) - sum(y - x for x, y in spans) == len(want[i]) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_suffixes_hot_anchor(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(suffixes, "HOT", 40, raising=False)
    letters, common = "abcdefghij klmnop", "".join(rng.choices("qrstuvwxyz", k=60))
    rows = [(i, "".join(rng.choices(letters, k=60)) + common + "".join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(300 + i, rows[7 * i][1][20 * (i % 3) :]) for i in range(40)] + [(None, rows[3][1]), (5, rows[5][1]), (400, common[:50] * 3)]
    groups = []
    settle = suffixes.sorted_runs

    def seen(*given):
        runs = settle(*given)
        groups.extend(runs.where("n > 0").groupBy("range").agg({"n": "sum", "kind": "max"}).collect())
        return runs

    monkeypatch.setattr(suffixes, "sorted_runs", seen)
    got = sorted((r["doc_id"] is None, r["doc_id"], bytes(r["kept"])) for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    strings = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            strings[t[k : k + 50]] = min(strings.get(t[k : k + 50], math.inf), math.inf if i is None else i)
    want = []
    for i, t in rows:
        gone = {k + j for k in range(len(t) - 49) if strings[t[k : k + 50]] < (math.inf if i is None else i) for j in range(50)}
        want.append((i is None, i, "".join(c for k, c in enumerate(t) if k not in gone).encode()))
    assert got == sorted(want)
    assert {r["max(kind)"] for r in groups} == {0, 2}
    # the common passage is in every document, but no group has an entry of each
    assert max(r["sum(n)"] for r in groups if r["max(kind)"] == 0) < len(rows)


def test_loser_tree():
    rng = random.Random(1)

    def shared(a, b):
        return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

    for _ in range(100):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        common = [[0] * bool(r) + [shared(x, y) for x, y in zip(r, r[1:], strict=False)] for r in runs]
        r, p, s = suffixes.merge(runs, common)
        got = [runs[i][j] for i, j in zip(r, p, strict=True)]
        assert got == sorted(x for q in runs for x in q)
        assert s == [0] * bool(got) + [shared(x, y) for x, y in zip(got, got[1:], strict=False)]


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        w = rng.choices(plain, k=30) + (rng.choices(["badly", "nastiest", "vile"], k=2) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i // 8 % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    held = [i for i in range(1500) if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == (i % 8 == 0) for i in held) > 0.95 * len(held)
    assert got[5000]["score"] == got[5001]["score"] and 0 <= got[5000]["score"] < 0.3
    assert toxicity.fit(docs.limit(0), known.limit(0)).bias < 0


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Home</a> <a>About us</a></nav><div class="cookie-notice">We use cookies here and there.</div>
<article><h1>Head &amp; line</h1><aside><p>Side words that are long enough to count as text.</p></aside><p>First  paragraph with <a href=y>a link</a> and <b>bold</b> words.<p>Second &lt;here&gt;<br>after break.
<ul><li>One<li>Two</ul><form><label>Mail</label></form><script>var x="<p>no</p>";</script></article><section id="comments"><p>I like it a lot, thanks.</p></section><footer>&copy; x</footer></body>"""
    want = "Head & line\nFirst paragraph with a link and bold words.\nSecond <here>\nafter break.\nOne\nTwo"
    weights = html.train([page] * 3)
    assert html.extract(page, weights) == want
    assert html.extract(page.replace("article>", "div>"), weights) == want
    assert html.extract(page.replace("<footer>", "<div><p>Some unmarked words of the site that go on and on here.</p></div><footer>"), html.train([])) == want
    for odd in ("", "   ", "<", "<p", "no tags at all", "<!-- open", "<script>x", "</div></p>", "&amp; <b", "\x00"):
        html.extract(odd, weights)
    assert html.extract("", weights) == "" and html.extract("plain words only", weights) == "plain words only"


def test_html_region():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html.region([float(v) for v in x])
        assert sum(x[a:b]) == max([sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)], default=0)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, "<article><p>Some words.</p></article>"), (2, None, "<article><p>Some words.</p></article>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(df).collect()) == [(1, "", 0), (2, "Some words.", 11), (2, "Some words.", 11)]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    good = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    ids = {r["doc_id"] for r in out}
    assert ids <= good
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in raw[d] for d in ids for i in items)
    sets = {}
    for d in ids:
        w = raw[d].encode().lower().split()
        sets[d] = frozenset(zip(*(w[j:] for j in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])
    pairs = [(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b]]
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in pairs)
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
