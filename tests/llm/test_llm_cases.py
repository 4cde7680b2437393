"""Nulls, empties, ties, repeats, empty tables, clashing columns and very long texts; the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from lithoframe.llm import common, components, decontaminate, html, mixing, neardup, quality, sharding, suffixes, toxicity, urls, warc
from tests_llm_brute import bag, contaminated, groups, jump, words

LONG = " ".join(f"long{i % 997}" for i in range(40_000))
#: Every name that an operator uses inside, or returns, as a further column of its input.
CLASH = (
    "quality copy n_copies mix_key band block center component digest id kind n range chunk rule verdict host path k payload sha256 header record "
    "shard slot size law part score predicted held_out u v key first_word item_id similarity"
).split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


ROWS = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "same words here again", "a"), (4, "same words here again", "a"), (5, "same words here again", "b"), (6, LONG, "b"), (7, LONG + " end", "b"), (None, "lost id", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_cases(odd, none):
    with pytest.raises(ValueError):
        quality.judge(odd)
    got = quality.judge(odd, name="judged")
    assert got.count() == len(ROWS) and {r["judged"]["n_words"] for r in got.where("doc_id = 6").collect()} == {40_000}
    assert all(r["judged"]["base_failed"] for r in got.where("doc_id < 4").collect())
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(none).count() == 0


def test_quality_stop_ratio(spark):
    # short and long texts alike need stop words, whatever their case
    rows = [(1, "word " * 5 + "other things " * 4, None), (2, "The AND of " + " ".join(f"w{i}" for i in range(40)), None), (3, " ".join(f"w{i}" for i in range(40)), None), (4, " ".join(f"w{i}" for i in range(990)) + " the" * 10, None)]
    got = {r["doc_id"]: r["j"] for r in quality.judge(table(spark, rows), name="j").collect()}
    assert [got[i]["n_stops"] for i in (1, 2, 3, 4)] == [0, 3, 0, 10]
    assert "stop_ratio" in got[3]["failed"] and "stop_ratio" in got[4]["failed"] and "stop_ratio" not in got[2]["failed"]


def test_sharding_cases(spark, odd, none):
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == len(ROWS) and sharding.shard(none).count() == 0
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    names = spark.createDataFrame([(f"key {i % 50}", "t") for i in range(200)] + [(None, None)], "doc_id string, text string")
    rows = sharding.shard(names, 4).collect()
    assert len(rows) == 201 and all(r["grown_shard"] in (r["shard"], 4) for r in rows) and len({r["shard"] for r in rows}) == 4
    # one key holds most rows: it is one group before it is shuffled
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, id, 7) AS doc_id", "if(id % 3 = 0, string(id), 'x') AS text")
    rows = sharding.shard(hot, 3).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_mixing_cases(odd, none):
    with pytest.raises(ValueError):
        mixing.mix(odd)
    for wrong in ({}, {"a": 0}, {"a": 2, "b": -1}):
        with pytest.raises(ValueError):
            mixing.mix(odd, names=None, weights=wrong)
    assert mixing.mix(odd, names=None).columns == odd.columns and mixing.mix(none, names=None).count() == 0
    got = mixing.mix(odd, names=("a1", "a2", "a3"), weights={"b": 1, "unknown": 5})
    assert {r["source"] for r in got.collect()} <= {"b"}  # sources without a weight leave
    assert mixing.mix(odd, names=None, weights={"y": 1}).count() == 0
    # equal rows get equal counts, each its own copies
    out = Counter((r["doc_id"], r["a1"], r["a2"]) for r in mixing.mix(odd.where("doc_id = 4"), names=("a1", "a2", "a3")).collect())
    assert set(out.values()) <= {2}


def test_urls_cases(spark, none):
    pages = spark.createDataFrame([(i, "https://a.example.com/en/8", "x", "y") for i in range(3)] * 2 + [(None, None, "x", "y")], "page_id long, url string, rule string, host string")
    assert urls.judge(pages, urls.rule_table(spark)).count() == 7
    assert urls.judge(pages, urls.rule_table(spark, [])).where("verdict = 'allow'").count() == 7
    assert urls.judge(none.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), urls.rule_table(spark)).count() == 0


def test_urls_contract(spark):
    # each rule of the contract by a url that it alone decides, on its host and on a subdomain
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: a for a, h, p in urls.RULES} == contract
    cases = {i: (sub + r, r) for i, (r, sub) in enumerate((r, sub) for r in contract for sub in ("", "a."))}
    pages = spark.createDataFrame([(i, f"http://{u}1") for i, (u, _) in cases.items()], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    assert got == {i: (r, contract[r]) for i, (_, r) in cases.items()}


def test_urls_digest(spark, monkeypatch):
    # so short a prefix that most rules share one: only the full digest decides
    monkeypatch.setattr(urls, "PREFIX_DIGITS", 1)
    rules = [("block", f"h{i}.org", "/p") for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p/x") for i in range(80)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    assert got == {i: f"h{i}.org/p" if i < 40 else None for i in range(80)}


def test_warc_cases(spark, odd, none, monkeypatch):
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    archive = warc.write(pages)
    got = Counter(r["page_id"] for r in warc.records(archive).collect())
    assert got == Counter(r[0] for r in ROWS)
    empty = warc.write(none.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"}))
    assert warc.records(empty).count() == 0
    # a payload that many records have is dealt over several parts
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    many = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "if(id % 2 = 0, 'hot', string(id)) AS html")
    archive = warc.write(many)
    assert warc.hot_payloads(archive.payloads) == [hashlib.sha256(b"hot").hexdigest()]
    said = {r["page_id"]: bytes(r["record"]) for r in warc.records(archive).collect()}
    assert len(said) == 300 and b"Refers-To-Key: 0\r\n" in said[298] and said[0].endswith(b"\r\n\r\nhot\r\n\r\n")


def test_warc_corrupted(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"))
    archive.payloads = archive.payloads.selectExpr("sha256", "cast('bad' AS binary) AS payload", "first_id", "n")
    with pytest.raises(PySparkException, match="does not match its digest"):
        warc.read(archive).collect()


def test_decontamination_cases(spark, odd, none):
    items = spark.createDataFrame([(1, "same words here again"), (2, "long1 long2 long3 long4 long5 long6"), (2, "never seen at all in here"), (3, None), (None, "lost id")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, items, short_inside=True).collect())
    assert got == {(4, 1): 2, (5, 1): 1, (6, 2): 1, (7, 2): 1, (None, None): 1}
    kept = decontaminate.decontaminate(odd, items.where("item_id = 1"))
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 6, 7, None])
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_decontamination_repeats(spark):
    # a window in which one shingle has a third of the weight, edited so that 0.8 is just reached
    rng = random.Random(9)
    items, rows = [], []
    for i in range(200):
        w = [f"x{i}w{k}" for k in range(40)] + ["again"] * 20
        rng.shuffle(head := w[:40])
        w = head + w[40:]
        items.append((i, " ".join(w)))
        w[3] = "edited"
        rows.append((i, " ".join(["pre", *w, "post"])))
    want = {(d, i) for d, t in rows for i, s in items if d == i for k in range(3) if alike(t.split()[k : k + 60], s.split()) >= 0.8}
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) == 200


def alike(w, v):
    a, b = bag(w), bag(v)
    n = sum((a & b).values())
    return n / (sum(a.values()) + sum(b.values()) - n)


def test_index_radius():
    rng = random.Random(3)
    shingles = [decontaminate.np.array([rng.getrandbits(64) for _ in range(30)], dtype=decontaminate.np.uint64) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), shingles)
    for _ in range(50):
        f = index.prints[rng.randrange(300)].copy()
        for bit in rng.sample(range(128), rng.randint(0, 60)):
            f[bit // 8] ^= 1 << bit % 8
        far = decontaminate.np.bitwise_count(index.prints ^ f).sum(axis=1)
        assert index.within(f) == [(i, d) for i, d in enumerate(far.tolist()) if d <= decontaminate.RADIUS]


def test_near_duplicates_cases(odd, none):
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect())
    assert got == Counter({(1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 2, (5, 4, False): 1, (6, 6, True): 1, (7, 6, False): 1, (None, None, True): 1})
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 4, 6, None])


def test_near_duplicates_blocks(spark, monkeypatch):
    # a chain of variants, of which few are linked with the bucket's smallest id: blocks of three meet, hot keys are dealt
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rng = random.Random(11)
    rows = []
    for f in range(3):
        base = [f"f{f}w{k}" for k in range(120)]
        for i in range(45):
            w = list(base)
            for _ in range(rng.choice((0, 2, 6, 9, 12))):
                w[rng.randrange(120)] = f"r{rng.randrange(10**6)}"
            rows.append((1000 * f + i, " ".join(w)))
    rows.append((5, "f0w1 with another text altogether"))  # an id that repeats
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, c) for i, c in groups(rows[:-1], 5))
    got = Counter((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).where("n_shingles > 2").collect())
    assert got == want and len(set(want.values())) == 1 and len({c for _, c in want}) > 5


def test_near_duplicates_exchange(spark, monkeypatch):
    # a bucket of one large component and a few other members: what meets grows with the bucket, not with its square
    monkeypatch.setattr(neardup, "BLOCK", 4)
    sizes = []
    for n in (80, 320):
        ids = spark.range(n).selectExpr("id", "if(id < 3, 1000 + id, 0) AS component")
        open_ = ids.selectExpr("7L AS band", "id", "0L AS center", f"{n}L AS size", "component")
        classes = ids.selectExpr("id", "10L AS n")
        rows = spark.createDataFrame([(i, f"w{i % 3} " + " ".join(f"c{k}" for k in range(9))) for i in range(n)], "doc_id long, text string")
        sigs = ids.selectExpr("id", f"cast(repeat('a', {neardup._K}) AS binary) AS sig")
        seen = {}

        def kept(df, name, seen=seen):
            seen[name] = common.written(df, name)
            return seen[name]

        monkeypatch.setattr(neardup, "written", kept)
        links = {(r["u"], r["v"]) for r in neardup._among_blocks(rows, open_, classes, sigs, neardup.least_matches(80), 5, 80).collect()}
        assert links == {(u, v) for u in range(3) for v in range(u + 1, n) if u % 3 == v % 3}
        sizes.append(seen["block-pairs"].count())
    assert sizes[1] <= 4.5 * sizes[0]


def test_components_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    monkeypatch.setattr(components, "LEAST_HOT", 10)
    rows = [(0, i) for i in range(1, 200)] + [(i, i + 1000) for i in range(150, 190)] + [(5000, 5001), (3, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{i + 1000: 0 for i in range(150, 190)}, 5000: 5000, 5001: 5000}
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_suffixes_cases(odd, none):
    got = Counter((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffixes.cut_repeats(odd).collect())
    n = len(LONG)
    assert sum(got.values()) == len(ROWS) and got[(4, 21, 21)] == 2 and got[(6, n, n)] == 1
    kept = next(k for i, _, k in got if i == 7)
    assert kept == 3  # all but the last word, as the document repeats that of id 6
    assert suffixes.cut_repeats(none).count() == 0


def test_suffixes_repeated_id(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=90))
    rows = [(1, text), (1, text), (2, text[:70]), (None, text), (None, text)]
    got = sorted((r["doc_id"] or 99, len(r["kept"])) for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 90), (1, 90), (2, 0), (99, 0), (99, 0)]


def test_toxicity_cases(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, "x"), (4, 0, "x"), (None, 1, "x"), (6, None, "x"), (5, 0, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] == 4} == {zlib.crc32(b"4") % 4 == 2}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_toxicity_gradient():
    # the loss that training lowers: prior-corrected, its negative part not below zero
    import numpy as np

    rng = np.random.default_rng(5)
    toxic = [np.unique(rng.integers(0, 30, 12)) for _ in range(60)]
    other = [np.unique(rng.integers(20, 400, 12)) for _ in range(500)] + [np.unique(rng.integers(0, 30, 12)) for _ in range(50)]
    prior = 50 / 550
    model = toxicity.train(toxic, other, prior)

    def risk(m):
        def z(rows):
            s = m.scores(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
            return np.log(s / (1 - s))

        zp, zu = z(toxic), z(other)
        loss = lambda x: np.logaddexp(0, x).mean()
        return prior * loss(-zp) + max(loss(zu) - prior * loss(zp), 0)

    flat = toxicity.Model(model.feature[:0], model.weight[:0], math.log(prior / (1 - prior)))
    assert len(model.feature) and risk(model) < 0.5 * risk(flat)


PAGE = """<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>First words of it.</p>
<ul><li>One<li>Two</ul></article><div class="comments"><p>I like it.</p></div><footer>end</footer></body></html>"""
TEXT = "Head\nFirst words of it.\nOne\nTwo"


@pytest.mark.parametrize(
    "page",
    [
        PAGE,
        PAGE.replace("</head><body>", ""),
        PAGE.replace("</head>", "").replace("<title>T</title>", "<title>T</title><meta name=a><script>if (a < b) x('<p>no</p>')</script>"),
        PAGE.replace("<article>", '<div class="post tags"><article>').replace("</article>", "</article></div>"),
        PAGE.replace("<body>", "<body><div class='layout has-sidebar side-by-side'>"),
        PAGE.replace("<article>", '<article class="post tags share">'),
        PAGE.replace("<body>", "<body><form id=page>").replace("</body>", "</form></body>"),
        PAGE.replace("<article>", '<div class="side-by-side">').replace("</article>", "</div>"),
        PAGE.replace("<article>", "<script src=x /></script><article>"),
        PAGE.replace("</li>", "").replace("</p>", "").replace("</h1>", ""),
        PAGE.replace("</article>", '<aside>Next to it.</aside><div class="cookie-notice">We use them.</div></article>'),
        PAGE.replace('<div class="comments"><p>I like it.</p></div>', '<section id=comments><article class="comment">I like it.</article><article class=reply>Me too.</article></section>'),
    ],
)
def test_html_pages(page):
    for weights in (html.Weights(), html.train([PAGE] * 10)):
        assert html.extract(page, weights) == TEXT


def test_html_learnt_evidence():
    """A class word that wraps articles on labelled pages is no boilerplate on others; one that stands outside is."""
    wrapped = PAGE.replace("<article>", '<div class="promo"><article>').replace("</article>", "</article></div>").replace("<footer>", "<div class=zq9>" + "Outer words go on and on. " * 9 + "</div><footer>")
    weights = html.train([wrapped] * 5)
    assert weights.evidence["promo"] == 3.0 and weights.evidence["zq9"] == -3.0
    plain = "<body><p>Some words here.</p><div class=promo><p>More words.</p></div><div class=zq9><p>Outer.</p></div><p>End words.</p></body>"
    assert html.extract(plain, weights) == "Some words here.\nMore words.\nEnd words."
    assert html.extract(plain, html.Weights()) == "Some words here.\nOuter.\nEnd words."


def test_html_tokens_against_parser():
    """Texts and their elements as the standard library's parser finds them, on pages whose tags are all there."""
    from html.parser import HTMLParser

    rng = random.Random(4)

    class Known(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.found = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in html.VOID:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag not in html.VOID:
                while self.open.pop() != tag:
                    pass

        def handle_data(self, data):
            self.found.append((data, tuple(self.open)))

    def tree(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["text", "div", "b", "a", "br", "comment"]) if depth else "text"
            if kind == "text":
                parts.append(rng.choice(["some words ", "x &lt; y &amp; z ", "ünïcode "]))
            elif kind == "br":
                parts.append("<br/>")
            elif kind == "comment":
                parts.append("<!-- <p>not here</p> -->")
            else:
                parts.append(f"<{kind} class='c{depth}' title=\"a>b\">{tree(depth - 1)}</{kind}>")
        return "".join(parts)

    for _ in range(100):
        page = f"<html><body>{tree(4)}</body></html>"
        known = Known()
        known.feed(page)
        known.close()
        out, elements = html.parse(page)

        def path(e):
            return (*path(elements[e].parent), elements[e].name) if e > 0 else ()

        merged, want = [], []
        for rows, into in (([(t.text, path(t.element)) for t in out if t.text], merged), (known.found, want)):
            for text, where in rows:
                if into and into[-1][1] == where:
                    into[-1] = (into[-1][0] + text, where)
                else:
                    into.append((text, where))
        assert merged == want


def test_html_cases(odd, none):
    pages = odd.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html.main_text(pages).collect()}
    assert got[1] == ("a", "", 0) and got[6] == ("b", LONG, len(LONG)) and html.main_text(pages).count() == len(ROWS)
    assert html.main_text(none.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})).count() == 0


def test_shared_folder(spark, odd):
    kept = common.written(odd.select("doc_id"), "rows")
    assert kept.count() == len(ROWS)

    class Remote:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError):
        common.shared_dir(Remote)


def pipeline(docs, items, keeps):
    """Brute force: rows (doc_id, size, crc, shard, grown_shard) with how often each is there."""
    rows = [(d, t, s) for d, t, s in docs if d in keeps]
    group = dict(groups([(d, t) for d, t, _ in rows], 5))
    rows = [r for r in rows if group[r[0]] == r[0]]
    found = contaminated([(d, t) for d, t, _ in rows], items)
    rows = [r for r in rows if r[0] not in found]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.encode())
    rate = {s: n**0.5 / sum(x**0.5 for x in size.values()) * sum(size.values()) / n for s, n in size.items()}
    out = Counter()
    for d, t, s in rows:
        u = int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:13], 16) / 2.0**52
        total, k = 0.0, 0
        while u >= (total := total + math.exp(k * math.log(rate[s]) - rate[s] - math.lgamma(k + 1))):
            k += 1
        if k:
            out[(d, len(t.encode()) + 1, zlib.crc32(t.encode()), jump(d, 8), jump(d, 9))] = k
    return out


def test_pipeline_brute(spark, sf_dir, duck):
    import corpus_pipeline

    docs = [tuple(r) for r in duck.execute("SELECT doc_id, text, source FROM documents").fetchall()]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    keeps = {r[0] for r in duck.execute(f"WITH {quality.SQL.split('WITH', 1)[1]}").fetchall() if r[-1]}
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want = pipeline(docs, items, keeps)
    assert got == want and 20 < len(want) < len(docs)


def test_pipeline_cases(spark, sf_dir, odd, none):
    import corpus_pipeline

    for docs in (odd.drop(*CLASH[10:]), none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, sf_dir), "stage")
            assert "quality" in docs.columns and "copy" in docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert out.count() == docs.count()
