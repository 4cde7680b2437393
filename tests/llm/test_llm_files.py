"""Token files, manifests and the divergence audit against brute force, on odd input and over several blocks and tiles."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoframe.llm import divergence, merkle, tokens
from lithoframe.llm.common import texts_of

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"long{i % 997}" for i in range(40_000))
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in "key hash row shard seq image entry grp block pos n path term idx p value rank".split())
ROWS = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \t", None, None), (4, "same words here", "a", "y"), (4, "same words here", "a", "y"), (5, "same words\nhere", "b", "y"), (6, LONG, "b", "y"), (7, LONG + " end", "ü", "y"), (None, "lost\nid", "c", None), (8, "", None, "z")]


def table(spark, rows):
    return spark.createDataFrame([(*r[:4], len(r[1] or "") or None, *("0" * 17)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ROWS).cache()


def ids_of(rows):
    """Key, start, number and CRC of each row's ids, and all ids."""
    library = tokens.Encoder(PATH).library
    out, every = [], []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((key, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    return out, every


def test_tokens_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, every = ids_of([(r["doc_id"], r["text"]) for r in docs.collect()])
    order = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert order(tokens.query(spark, sf_dir)) == want
    store = tokens.encode(docs, PATH, range_bytes=40_000)
    assert store.directory.select("shard").distinct().count() > 5 and order(tokens.read(store)) == want
    at = [*random.Random(1).sample(range(len(every)), 300), 0, len(every) - 1]
    found = tokens.ids_at(store, spark.createDataFrame([(p,) for p in [*at, at[0], -1, len(every)]], "position long")).collect()
    assert {r["position"]: r["id"] for r in found} == {p: every[p] for p in at} and len(found) == len(set(at))


def test_tokens_cases(spark, odd):
    want, _ = ids_of([r[:2] for r in ROWS])
    got = tokens.read(tokens.encode(odd, PATH), ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == want and all(r["ids"][-1] == 0 for r in got)
    empty = tokens.encode(odd.limit(0), PATH)
    assert tokens.read(empty).count() == 0 and tokens.ids_at(empty, spark.range(3).toDF("position")).count() == 0


def test_encoder_splits():
    # white space of every kind, words of several scripts, contractions, NUL and the special token
    rng, encoder = random.Random(5), tokens.Encoder(PATH)
    alphabet = [*" \n\t  ab'sé1.,　​中\x1c\u0085🙂\0Ӂ", " the", "<|endoftext|>"]
    texts = ["", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)), "x" * 50_000]
    for _ in range(2):  # the second time all chunks are known
        ((_, offsets, data),) = texts_of(pa.array(texts), 1 << 30)
        ids, n = encoder(offsets, data)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 2**32])
def test_codes(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = (rng.random(n) ** 6 * top).astype(np.uint32)
        codes = tokens.Codes(tokens.image(ids))
        at = rng.integers(0, max(n, 1), 200 if n else 0)
        assert codes.n == n and (codes.get(at) == ids[at]).all() and (codes.span(0, n) == ids).all()
        for a, b in np.sort(rng.integers(0, n + 1, (20, 2)), axis=1):
            assert (codes.span(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            codes.get([n])
    with pytest.raises(ValueError):
        tokens.Codes(b"else")


def test_widths_are_cheapest():
    assert tokens.widths(np.zeros(9, np.uint32)) == [2] and sum(tokens.widths(np.array([2**32 - 1], np.uint32))) == 32
    # nearly all ids are short: one short chunk for all, one for the rest
    assert tokens.widths(np.array([3] * 1000 + [50_000], np.uint32)) == [2, 14]


def manifest_of(rows, arity=3):
    """What the query returns, by the definition; rows are (doc_id, source, lang, n_chars, text)."""
    digest = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        i, text = r[0], r[4]
        if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups[r[1]].append((i, digest(*map(said, r)), digest(*map(said, (*r[:4], text)))))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
        return out

    def path(levels, at):
        for nodes in levels[:-1]:
            first = at // arity * arity
            yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + arity])
            at //= arity

    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([x[1] for x in groups[k]]) for k in keys}
    top, out = tree([trees[k][-1][0] for k in keys]), []
    for n, k in enumerate(keys):
        for m, (i, leaf, node) in enumerate(groups[k]):
            steps = [*path(trees[k], m), *path(top, n)]
            for a, b in steps:
                node = digest(a, node, b)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], digest(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_cases(spark, odd, tmp_path, monkeypatch):
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    rng = random.Random(2)
    many = [(i, "line\n" * rng.randrange(3), "hot" if i % 3 else f"s{i % 41}", "x") for i in range(300)] + [(9, "twice", "hot", "x")] * 40
    for rows, height in ((ROWS, 6), (many, 1), (many, 2)):
        folder = f"{tmp_path}/{len(rows)}-{height}"
        table(spark, rows).write.parquet(f"{folder}/documents.parquet")
        monkeypatch.setattr(merkle.build, "__defaults__", (3, height))
        got = sorted((tuple(r) for r in merkle.query(spark, folder).select(*columns).collect()), key=repr)
        assert got == manifest_of([(r[0], r[2], r[3], len(r[1] or "") or None, r[1]) for r in rows])
        sql = duckdb.connect()
        sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        assert sorted(sql.execute(f"SELECT {', '.join(columns)} FROM ({merkle.SQL})").fetchall(), key=repr) == got
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.query(spark, f"{tmp_path}/none").count() == 0


def test_manifest_of_other_rows(spark):
    rows = spark.range(30).select(F.col("id").alias("k"), F.lit("g").alias("g"), merkle.leaf(F.col("id")).alias("h"), F.lit(1).alias("kept"))
    made = merkle.build(rows, "g", "k", "h", arity=2, height=2)
    found = merkle.proofs(made).select("entry.kept", merkle.folded(F.col("entry.hash"), F.col("path")).alias("root")).distinct().collect()
    assert [tuple(r) for r in found] == [(1, made.root)]
    assert merkle.build(rows.withColumn("h", merkle.leaf(F.col("k") + 1)), "g", "k", "h", arity=2, height=2).root != made.root


def audit_of(rows, least=3, top=200):
    """What the query returns, by the definition; rows are (lang, source, text)."""
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        own, all_counts = share(counts[lang, source]), sum((counts[g] for g in groups if g[0] == lang), Counter())
        pairs = [(-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), other) for l2, other in groups if l2 == lang and other != source for q in [share(counts[lang, other])]]
        q = share(all_counts)
        terms = [(-((own[t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
            out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_audit_cases(spark, odd, tmp_path):
    columns = "lang source part item value rank".split()
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in divergence.query(spark, str(tmp_path)).select(*columns).collect())
    assert got == audit_of([(r[3], r[2], r[1]) for r in ROWS])
    audit = divergence.Audit(odd.limit(0))
    assert audit.pairs().count() == audit.terms().count() == 0


@pytest.mark.parametrize("light", [2, 100])
def test_audit_over_tiles(spark, light):
    # a source with a third of all rows, terms of every spread, several blocks of sources and of terms
    rng = random.Random(7)
    rows = []
    for i in range(400):
        words = [f"w{''.join(chr(97 + int(c)) for c in str(int(rng.paretovariate(0.6)) % 300))}" for _ in range(rng.randrange(40))] + ["Ünï"] * (i % 2)
        rows.append((f"l{i % 2}", "hot" if i % 3 == 0 else f"s{rng.randrange(15)}", " ".join(words)))
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    audit = divergence.Audit(docs, light=light, side=4, tile_terms=20, tile_shares=10)
    part = lambda df, name: [(r["lang"], r["source"], name, r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert sorted(part(audit.pairs(), "pair") + part(audit.terms(5), "term")) == audit_of(rows, top=5)


def test_terms_of_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Ab cd-EF éÉ x9y " * 40 + "z" * 30
    assert [w.decode() for part in divergence.terms_of(text.encode()) for w in part] == ["ab", "cd", "ef", "éÉ", "x", "y"] * 40 + ["z" * 30]
