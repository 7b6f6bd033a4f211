"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, shard string, score string, value string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus():
    """Near and exact copies, short and empty texts, nulls, one very long text, repeated words."""
    random.seed(8)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(400)]
    make = lambda n: random.choices(vocabulary, k=n)
    texts = [" ".join(make(random.randint(5, 80))) for _ in range(40)]
    base = make(120)
    for k in range(14):
        copy = list(base)
        for _ in range(k):
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[0]] * 3 + [texts[1].upper(), None, "", " \t\n ", "one", "one", "One two", "a b c d", "a b c d e", "été\x0bnaïve 日本語 😀", " ".join(make(30_000)), "x" * 50_000]
    langs = ["en", "de", None, "fr"]
    rows = [(i * 3, t, langs[i % 4], [None, "s1", "s2", "S3"][i % 4], 7, i, i, "z", "z", "z") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_sets(rows):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_near(rows):
    sets = brute_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def test_minhash(spark, docs, nothing):
    from tallyframe.llm.minhash import near_duplicates

    sets, comp = brute_near([(r.doc_id, r.text) for r in docs.collect()])
    got = near_duplicates(docs).collect()
    assert len(got) == len(sets)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert Counter((r.doc_id, r.kept) for r in near_duplicates(odd).collect()) == Counter({(1, True): 2, (2, False): 1, (None, True): 1})
    assert {r.doc_id: r.component_id for r in near_duplicates(odd).collect()} == {1: 1, 2: 1, None: None}


def test_minhash_chain_through_blocks(spark, monkeypatch):
    """A chain whose ends are unlike, in keys that hold several components, dealt to tiny blocks."""
    from tallyframe.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 3)
    random.seed(1)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, now = [], random.choices(vocabulary, k=200)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now = list(now)
        at = (i * 5) % 190
        now[at : at + 5] = random.choices(vocabulary, k=5)
    for i in range(40, 60):  # members that are near to the chain but not linked
        now = list(random.choice(rows)[1].split())
        for _ in range(9):
            now[random.randrange(200)] = random.choice(vocabulary)
        rows.append((i, " ".join(now)))
    _, comp = brute_near(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_components(spark):
    from tallyframe.llm.common import connected_components

    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    want = components({x for e in links if e[0] != e[1] for x in e}, [e for e in links if e[0] != e[1]])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    assert got == want


def test_context_mixing(docs, nothing):
    from tallyframe.llm.lm import score_texts

    rows = {r.doc_id: r.text for r in docs.collect()}
    tokens = {i: [*words(t), None] for i, t in rows.items()}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in score_texts(docs).collect():
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r.score < 0 and (len(rows[r.doc_id] or "") < 200 or r.score > -len((rows[r.doc_id]).encode()) * 8 * math.log10(2))
    assert score_texts(nothing).count() == 0


def test_context_mixing_repeated_and_null_ids(spark):
    from tallyframe.llm.lm import score_texts

    rows = [(1, "alpha beta alpha"), (2, "alpha gamma"), (7, "unk1 unk2 unk3"), (7, "alpha"), (None, "alpha qqq"), (None, None), (3, "\0" * 60), (4, "~" * 60)]
    out = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    trained = [[*words(t), None] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in trained for w in t)
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])
    assert sorted((str(i), round(base(t), 9)) for i, t in rows) == sorted((str(r.doc_id), round(r.base_score, 9)) for r in out)
    assert all(r.n_known == sum(counts[w] > 0 for w in [*words(t), None]) for r, t in zip(sorted(out, key=lambda r: r.base_score), sorted((t for _, t in rows), key=base)))
    score = {r.doc_id: r.score for r in out if r.doc_id in (3, 4)}
    assert score[3] < -1 and score[4] < -1  # no sequence is taken for an empty place of the cache
    assert all(math.isclose(r.bits_per_byte, -r.score * math.log2(10) / max(1, b)) for r, b in zip(sorted(out, key=lambda r: r.n_tokens + r.score), sorted(out, key=lambda r: r.n_tokens + r.score)) for b in [round(-r.score * math.log2(10) / r.bits_per_byte)])


def read_in_order(text: bytes, model: list[float]) -> float:
    """log10 probability of a text from the model's of each byte: naive counts, and weights that each byte multiplies."""
    from tallyframe.llm import lm

    full, weights, total = [*text, lm.END], [0.25] * 4, 0.0
    for i, byte in enumerate(full):
        p = [10 ** float(model[i])]
        for strength in lm.STRENGTHS:
            q = p[0]
            for k, size in zip(strength, (5, 11), strict=True):
                past = lambda j, size=size: bytes([lm.START] * max(0, size - j)) + bytes(full[max(0, j - size) : j])
                same = [j for j in range(i) if past(j) == past(i)]
                q = (sum(full[j] == byte for j in same) + k * q) / (len(same) + k)
            p.append(q)
        now = sum(w * q for w, q in zip(weights, p, strict=True))
        total += math.log10(now)
        weights = [w * q / now for w, q in zip(weights, p, strict=True)]
    return total


def test_context_mixing_against_the_formula(spark):
    """The score of a text, bit by bit from the model's own tables and then read in order, without cache, chunks or cells."""
    from tallyframe.llm import lm

    texts = ["abcabcabc abd", "abcabd a bc\nd", "zz", ""]
    model, _, _ = lm.train(spark.createDataFrame([(t,) for t in texts * 3], "text string"))
    counts, check = model.counts, model.check
    got = {r.text: r.score for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").mapInArrow(lm._score(model, (np.zeros(0, np.uint64), np.zeros(0))), "id long, rare array<long>, times array<long>, bytes long, n long, known long, base double, score double").join(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string"), "id").collect()}
    for text in texts:
        before, each = [lm.START] * lm.ORDER, []
        for byte in [*text.encode(), lm.END]:
            packed, total = np.array([int.from_bytes(bytes([*before, byte]), "big")], np.uint64), 0.0
            for place in range(7, -1, -1):
                bit, node = byte >> place & 1, np.array([(byte | 256) >> (place + 1)])
                x, seen = [], 0
                for o, (slot, mark) in enumerate(lm._slots(lm._contexts(packed), node, model.bits)):
                    n0, n1 = counts[slot[0]] if check[slot[0]] == mark[0] else (0, 0)
                    x.append(float(np.float16(math.log((n1 + lm.PRIOR) / (n0 + lm.PRIOR)))))  # cells hold half precision
                    seen = o + 1 if int(n0) + int(n1) else seen
                since = next((j for j, b in enumerate(reversed(before)) if b <= 32 or b == lm.START), lm.ORDER)
                w = model.weights[(place * (lm.ORDER + 1) + since) * (lm.ORDER + 2) + seen]
                odds = sum(a * b for a, b in zip([*x, 0.3], w.tolist()))
                p = 1 / (1 + math.exp(-odds))
                at = min(max(odds * 2 + 16, 0), 31.999)
                refined = model.refined[node[0]]
                p = 0.5 * p + 0.5 * (refined[int(at)] * (1 - at % 1) + refined[int(at) + 1] * (at % 1))
                total += math.log10(p if bit else 1 - p)
            before = [*before[1:], byte]
            each.append(total)
        assert math.isclose(got[text], read_in_order(text.encode(), each), rel_tol=1e-3, abs_tol=1e-3)


def test_mixture_is_a_distribution(docs):
    """The bits of a byte: probabilities of all 256 continuations of a context add up to one."""
    from tallyframe.llm import lm

    model, _, _ = lm.train(docs.select("text"))
    context = int.from_bytes(b"abcde", "big")
    every = np.array([(context << 8) | b for b in range(256)], np.uint64)
    assert math.isclose((10 ** model.log10(every)).sum(), 1.0, rel_tol=1e-4)


def test_syncmers(spark, docs, nothing):
    from tallyframe.llm.syncmers import anchors, compare_with_edits

    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(rows, reverse=True)
    after = {a: order[(k + 1) % len(order)] for k, a in enumerate(order)}
    seen = {}
    for r in compare_with_edits(docs).collect():
        text = rows[r.doc_id]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + rows[after[r.doc_id]][:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint and seen.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1.0
        a, b = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint))
        assert math.isclose(r.near_edited, len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r.placed_edited <= 1 and (text != edited or r.placed_edited == 1.0)
    assert compare_with_edits(nothing).count() == 0
    long = " ".join(f"w{k % 97}x{k}" for k in range(300))
    near = spark.createDataFrame([(2, long), (1, "other words " * 30), (None, "n"), (2, "dup")], "doc_id long, text string")
    assert compare_with_edits(near).count() == 4
    # an inner passage has the same anchors wherever it stands
    a, b = (dict((x.hash, x.word) for x in r.anchors) for r in anchors(spark.createDataFrame([(long,), ("before it " + long,)], "text string")).collect())
    assert len(set(a) - set(b)) <= 1 and all(b[h] - a[h] == 2 for h in set(a) & set(b))


def test_a_short_passage_of_two_long_texts_counts(spark):
    from tallyframe.llm.syncmers import anchors, compare_with_edits

    text = lambda p, n: " ".join(f"{p}{k * 7919 % 100003}" for k in range(n))
    shared = text("s", 60)
    d = spark.createDataFrame([(2, f"{text('a', 8000)} {shared} {text('b', 2000)}"), (1, f"{shared} {text('c', 10000)}")], "doc_id long, text string")
    whole = {r.doc_id: [(x.word, x.hash & 0xFFFFFFFF) for x in r.anchors] for r in anchors(d).collect()}
    sets = {k: {h for _, h in v} for k, v in whole.items()}
    want = len(sets[1] & sets[2]) / len(sets[1] | sets[2])
    for r in compare_with_edits(d).collect():
        assert [r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)] == [f"{h:08X}" for _, h in whole[r.doc_id]]
        assert r.words == [w for w, _ in whole[r.doc_id]]
        assert math.isclose(r.near_next, want) and want > 0


def test_anchors_are_matched_with_their_distances(spark):
    from tallyframe.llm.syncmers import likeness, placed

    rows = [([(0, 7), (3, 8), (5, 9)], [(2, 7), (5, 8), (9, 9)], 1 / 2), ([(0, 7)], [(0, 7)], 1.0), ([], [], 1.0), ([], [(0, 7)], 0.0)]
    d = spark.createDataFrame(rows, "a array<struct<word:int,hash:int>>, b array<struct<word:int,hash:int>>, want double")
    assert all(math.isclose(r.got, r.want) for r in d.select(likeness(placed(F.col("a")), placed(F.col("b"))).alias("got"), "want").collect())


def test_closed_syncmers_by_hand(spark):
    from tallyframe.llm.syncmers import anchors

    text = " ".join(f"t{k * 7919 % 1000}" for k in range(200))
    w = text.split()
    h = [r[0] for r in spark.createDataFrame([(x,) for x in w], "w string").select(F.xxhash64("w")).collect()]
    g = [r[0] for r in spark.createDataFrame(list(zip(h, h[1:])), "a long, b long").select(F.xxhash64("a", "b")).collect()]
    want = [k for k in range(len(w) - 5) if min(g[k], g[k + 4]) <= min(g[k + 1 : k + 4])]
    assert [x.word for x in anchors(spark.createDataFrame([(text,)], "text string")).first().anchors] == want


def test_secret_scan(spark, docs, nothing):
    from tallyframe.llm.secret_scan import redact, scan

    rows = [(1, 'a token = "26eb1cea0846965f2d3ecb5cdb87c0edc7a7a587" and password: "hunter2xyz99" end'), (2, "commit 7c4a8d09ca3762af61e59520943dc26494f8941b"), (3, None), (4, ""), (5, "see https://example.com/a-b-c-12345-defghijk/x.html"), (None, "api_key: Zk29dL4mQ8xV5bN7wR1tY6pZ"), (7, "x1" * 40_000), (8, "nothing here"), (8, "nothing here")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = scan(d)
    got = {(r.doc_id, r.value[:6]): r.is_secret for r in found.collect()}
    assert got[1, "26eb1c"] and got[1, "hunter"] and got[None, "Zk29dL"] and not got[2, "7c4a8d"] and not any(v for (i, _), v in got.items() if i == 5)
    clean = {r.doc_id: r.text for r in redact(d, found).collect()}
    assert clean[1] == 'a token = "[SECRET]" and password: "[SECRET]" end' and clean[2] == rows[1][1] and clean[3] is None
    assert redact(d, found).count() == len(rows)
    assert scan(nothing).count() == 0
    assert scan(docs).where("is_secret").count() == 0


def test_secrets_of_contexts_that_training_never_saw(spark):
    from tallyframe.llm.secret_scan import labelled_findings, scan

    held = spark.createDataFrame([(n, t, label) for n, (t, label) in enumerate(labelled_findings(held_out=True))], "doc_id long, text string, label int")
    got = Counter((r.label, r.is_secret) for r in scan(held).join(held.select("doc_id", "label"), "doc_id").collect())
    assert got[1, True] / (got[1, True] + got[0, True]) >= 0.95 and got[1, True] / (got[1, True] + got[1, False]) >= 0.95


def test_secret_patterns_are_linear(spark):
    from tallyframe.llm.secret_scan import candidates

    texts = ["x" * 1_000_000, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo3" * 28_000, "pass" * 250_000, "token=abcdefgh12;" * 60_000, "token = " * 120_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = Counter(r.id for r in candidates(d, "doc_id", "text").collect())
    assert got == Counter({1: 1, 3: 1}) and time.perf_counter() - began < 60


def test_url_sql_against_the_operator(spark, tmp_path):
    """Random aliases: the SQL's recursive closure and the operator's components give the same verdicts."""
    import duckdb

    from tallyframe.llm import sql
    from tallyframe.llm.urlfilter import Rule, judge_urls

    random.seed(5)
    hosts = ["a.net", "example.net", "m.example.net", "www.example.com", "plain.com", "b.org", "X.Example.Com"]
    paths = ["/en/%d", "/de/%d", "/fr/%d", "/%d", "/d/e/%d?x=1&y=2"]
    url = lambda: "http://" + random.choice(hosts) + random.choice(paths) % random.randrange(25)
    rows = [(900, None, None), (901, "no scheme", "<link rel=canonical href=http://a.net/1>"), (902, "http://net", None)]
    for i in range(400):
        link = random.choice([url(), url(), f"/q/{i % 30}", f"//a.net/{i % 30}", "#top", "mailto:x@y", f"rel{i % 9}", ""])
        tag = random.choice([f"<link rel='canonical' href='{link}'>", f'<meta http-equiv="refresh" content="0; url={link}">', "<p>", "<link rel=stylesheet href=/x.css>"])
        rows.append((i, url() + random.choice(["", "#f", "?a"]), tag if i % 17 else None))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    d.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    want = Counter(con.sql(f"select page_id, host, path, rule, verdict from ({sql.OP5})").fetchall())
    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
    assert Counter(map(tuple, judge_urls(d, rules).collect())) == want and sum(n for r, n in want.items() if r[3] is None and r[4] == "block") > 10
    many = [Rule(f"h{k}.example", "/", "block") for k in range(5000)] + rules
    assert Counter(map(tuple, judge_urls(d, many).collect())) == want


def test_urls(spark):
    from tallyframe.llm.urlfilter import Rule, judge_urls

    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
    canonical = lambda u: f"<head><LINK href='{u}' rel=\"canonical\"></head>"
    rows = [
        (1, "http://A.example.NET/en/1?q#f", None), (2, "http://x.net/1", ""), (3, "http://www.example.com/de/5", "<p>"), (4, "https://www.example.com/en/5", canonical("http://www.example.com/de/5#top")),
        (5, "http://mirror.org/a", '<meta http-equiv="refresh" content="0; url=https://www.example.com/en/5">'), (6, "http://good.example.net/en/2", canonical("http://x.net/1")), (7, "http://other.com/p", canonical("http://good.example.net/en/2")),
        (8, None, None), (9, "no scheme", canonical("http://x.net/1")), (10, "http://mirror.org/fr/b", canonical("http://x.net/1")), (11, "http://rel.com/d/e", canonical("/q")), (12, "http://rel.com/q", canonical("//x.net/zz")), (13, "http://net", None), (13, "http://net", None), (14, "http://plain.com/", canonical("http://plain.com/other")),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(d, rules).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.net", "/1", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6][2:] == ("example.net/en/", "allow") and got[7][2:] == (None, "allow") and got[10][2:] == ("org/fr/", "allow")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[13] == ("net", "", None, "allow") and got[14][3] == "allow"
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "block")  # by a link without scheme, and on by a rooted one
    moved = spark.createDataFrame([("http://plain.com/", "http://bad.net/x")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in judge_urls(d.where("page_id = 14"), rules, redirects=moved).collect()} == {14: "block"}
    assert judge_urls(d.limit(0), rules).count() == 0


def test_embeddings(spark, monkeypatch):
    from tallyframe.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 24))
    v = np.concatenate([base, *[base[k] + rng.standard_normal((12, 24)) * 0.12 for k in range(4)], base[:1].repeat(50, 0) + rng.standard_normal((50, 24)) * 0.02, base[:3]])
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, []), (904, [1.0, None]), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    m = np.array([r[1] for r in rows[: len(v)]], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    comp = components(range(len(v)), np.argwhere(near).tolist())
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_one_dense_topic(spark):
    from tallyframe.llm import embed_dedup

    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(math.sqrt(0.88) * unit(rng.standard_normal(64)) + math.sqrt(0.12) * unit(rng.standard_normal((12_000, 64))))
    v = np.concatenate([base, unit(base[:300] + 0.31 * unit(rng.standard_normal((300, 64))))])
    near = np.zeros(len(v), np.int64)
    for i in range(0, len(v), 2000):
        near[i : i + 2000] = (v[i : i + 2000] @ v.T >= 0.95).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(rows).collect()}
    assert near.sum() > 400 and sum(got[i] for i in range(len(v))) >= 0.98 * near.sum()
    assert all(got[i] <= near[i] for i in range(len(v)))


def test_languages(spark, docs, nothing):
    from tallyframe.llm.langid import identify, predict, train, viterbi

    random.seed(3)
    kinds = {"aa": "banulo", "bb": "zxqwkj", "ru": "привет"}
    word = lambda k: "".join(random.choices(kinds[k], k=random.randint(3, 8)))
    rows = [(i, " ".join(word(k) for _ in range(30)), k) for i, k in enumerate(random.choices(list(kinds), k=200))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = identify(d).join(d, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in out) and {r.held_out for r in out} == {True, False}
    mixed = spark.createDataFrame([(1, " ".join([word("aa") for _ in range(20)] + [word("bb") for _ in range(15)] + ["привет"] * 9)), (2, None), (3, "1 2 ?!"), (4, "")], "doc_id long, text string")
    spans = {r.doc_id: r for r in predict(mixed, train(d), with_spans=True).collect()}
    assert [s.lang for s in spans[1].spans] == ["aa", "bb", "ru"] and spans[1].lang_pred == "aa" and 0.3 < spans[1].score < 0.7
    assert all(spans[i].lang_pred == "und" and spans[i].score == 0 and spans[i].spans == [] for i in (2, 3, 4))
    assert {r.lang_pred for r in identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(docs).count() == docs.count() and identify(nothing).count() == 0
    scores = np.array([[0, -20], [-1, 0], [0, -20], [-30, 0], [-30, 0], [0, 0]], np.float32)
    assert viterbi(scores, np.array([6]), 12.0).tolist() == [0, 0, 0, 1, 1, 1]


def test_a_rare_language_is_found(spark):
    from tallyframe.llm.langid import predict, train

    random.seed(5)
    kinds = {"aa": "banulo", "rr": "zxqwkj"}
    text = lambda k: " ".join("".join(random.choices(kinds[k], k=6)) for _ in range(12))
    rows = [(i, text("rr" if i == 0 else "aa"), "rr" if i == 0 else "aa") for i in range(5000)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, text("rr")), (2, text("aa"))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in predict(new, model).collect()} == {1: "rr", 2: "aa"}


def test_mixing(spark, docs, nothing):
    from tallyframe.llm import mixing

    sizes = {None: 900, "a": 10_000, "b": 100, "c": 5_000, "é": 3_000, "zero": 0}
    rows, n = [], 0
    for s, total in sizes.items():
        for k in range(20):
            rows.append((n, " ".join(["w"] * (total // 20)), s))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
    out = mixing.plan_mix(d, block_words=300, shard_words=2_000).collect()
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= sizes[s] // 20 / 2 + 1e-6
    again = mixing.plan_mix(d.repartition(7), block_words=300, shard_words=2_000).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    shards = Counter(x for r in out for x in r.shards if r.size)
    assert len(shards) == 16  # shards hold equally many blocks, see the next test
    clash = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4, 5), (2, "c", "s", 1, 2, 3, 4, 5)], "doc_id long, text string, source string, shards int, _key int, COPY int, _places int, size int")
    assert mixing.mix(clash).columns == ["doc_id", "text", "source", "shards", "_key", "_places", "size", "copy", "shard"] and {r.shards for r in mixing.mix(clash).collect()} == {1}
    assert mixing.mix(clash.union(clash)).count() > 0
    empties = spark.createDataFrame([(k, None, "void") for k in range(100)] + [(200, "w " * 50, "b")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken) for r in mixing.plan_mix(empties, block_rows=7).collect() if r.source == "void"} == {(k, 0) for k in range(100)}
    made = mixing.mix(docs)
    assert made.columns == [*[c for c in docs.columns if c != "shard"], "copy", "shard"] and made.count() > 0
    assert mixing.plan_mix(docs).count() == docs.count() and mixing.plan_mix(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_hypergeometric_draws(spark):
    from tallyframe.llm.mixing import hypergeometric

    for total, marked, draws in ((1000, 300, 500), (60, 20, 31), (10**6, 600_000, 250_000)):
        x = np.array([r[0] for r in spark.range(8000).selectExpr(hypergeometric(f"{total}L", f"{marked}L", f"{draws}L", str(marked), "id")).collect()], float)
        mean, var = draws * marked / total, draws * marked / total * (1 - marked / total) * (total - draws) / (total - 1)
        assert abs(x.mean() - mean) < 5 * math.sqrt(var / len(x)) and 0.93 < x.var() / var < 1.07 and x.min() >= max(0, draws + marked - total) and x.max() <= min(draws, marked)


def test_viterbi_against_all_label_sequences():
    import itertools

    from tallyframe.llm.langid import viterbi

    rng = np.random.default_rng(6)
    for _ in range(40):
        scores, switch = rng.normal(0, 4, (6, 3)).astype(np.float32), float(rng.uniform(0, 6))
        value = lambda path: sum(scores[k, c] for k, c in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))  # noqa: E731, B023
        best = max(value(p) for p in itertools.product(range(3), repeat=6))
        assert math.isclose(value(viterbi(scores, np.array([6]), switch).tolist()), best, rel_tol=1e-5, abs_tol=1e-4)


def test_languages_of_the_given_documents(spark):
    from tallyframe.llm.langid import identify

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_splitting_tree_keeps_quotas(spark):
    from tallyframe.llm.mixing import split_quotas

    leaves = split_quotas(spark.createDataFrame([(0, 37), (1, 0), (2, 90), (3, 1)], "rank int, quota long"), 8).collect()
    by = Counter()
    for r in leaves:
        by[r.rank] += r.quota
    assert (by[0], by[1], by[2], by[3]) == (37, 0, 90, 1)
    assert {sum(r.quota for r in leaves if r.shard == s) for s in range(8)} == {16}


def test_bpe(docs, nothing):
    import public_tokenizers
    import tiktoken

    from tallyframe.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(rows[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_parts(monkeypatch):
    import public_tokenizers

    from tallyframe.llm import bpe

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        e = bpe.load(f.read(), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "PART", 40)
    monkeypatch.setattr(bpe, "_RUN", re.compile(f"[{bpe._WHITE}]{{15,}}"))
    monkeypatch.setattr(bpe, "LONG_RUN", 15)
    random.seed(3)
    for _ in range(1500):
        t = "".join(random.choice(" \n\t　\xa0ab1!'s\xe9\xdf漢\U0001f600") * random.choice([1, 1, 1, 2, 30]) for _ in range(random.randint(0, 60)))
        assert bpe.encode(e, t) == e.encode_ordinary(t), repr(t)


def test_warc(spark):
    from tallyframe.llm.warc import archive_round_trip, records

    trap = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\n"
    rows = [(1, "http://a/", "<p>x</p>"), (5, "http://b/\r\nEvil: 1", "<p>x</p>"), (3, None, "<p>x</p>"), (7, "u", trap), (8, "u", "é😀"), (9, "u", None), (10, "u", ""), (None, "u", "<p>x</p>"), (11, "u", "x" * 300_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in archive_round_trip(d).collect()}
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    for i, _, h in rows:
        raw = (h or "").encode()
        r, win = got[i], best[h or ""]
        kind = ("response", None) if i == win else ("revisit", win)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind)
    assert archive_round_trip(d.limit(0)).count() == 0
    small = {r.page_id: r.record_type for r in archive_round_trip(d, min_bytes=100).collect()}
    assert set(small.values()) == {"response"}
    with pytest.raises(ValueError):
        list(records(b"HTTP/1.1\r\n\r\n"))


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 20_000]
    d = spark.createDataFrame([r[:5] for r in rows] + [(1000, 'the token = "26eb1cea0846965f2d3ecb5cdb87c0edc7a7a587" of', "en", "s1", 60), (0, rows[0][1], "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    one = p.language_id(spark, d, "").collect()
    assert {r.doc_id for r in one} == {r.doc_id for r in d.collect() if any(ch.isalpha() for ch in r.text or "")}
    two = p.near_dedup(spark, d, "").collect()
    _, comp = brute_near([(r.doc_id, r.text) for r in d.collect()])
    assert Counter(r.doc_id for r in two) == Counter(set(comp.values()))
    three = {r.doc_id: r for r in p.redact_secrets(spark, d, "").collect()}
    assert three[1000].text == 'the token = "[SECRET]" of' and three[1000].n_chars == len(three[1000].text) and len(three) == len({r[0] for r in rows}) + 1
    assert p.mix_sources(spark, d, "").columns == d.columns
    extra = d.where("doc_id < 60").selectExpr("*", "0.123d as score", "'x' as lang_pred", "true as held_out", "1 as shards", "2 as `COPY`", "3 as _found", "4 as _key")
    for stage in (p.language_id, p.near_dedup, p.redact_secrets, p.mix_sources):
        kept = stage(spark, extra, "")
        assert kept.columns == extra.columns and {tuple(r)[5:] for r in kept.collect()} == {(0.123, "x", True, 1, 2, 3, 4)}
        assert stage(spark, d.limit(0), "").count() == 0 and stage(spark, d.limit(0), "").columns == d.columns
    assert p.encode(spark, d.limit(0), "").count() == 0
    long = spark.createDataFrame([(1, "ab1 " * 200_000, "en", "s", 0), (2, None, None, None, None), (None, "a b c", "en", None, 5)], d.schema)
    assert p.mix_sources(spark, p.redact_secrets(spark, p.near_dedup(spark, p.language_id(spark, long, ""), ""), ""), "").where("doc_id = 1").count() >= 1
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0


def test_adaptive_refinement_byte_by_byte():
    from tallyframe.llm import lm

    texts = [b"the cat sat on the cat sat on the cat", b"", b"ab" * 40, b"\0" * 30, "日本語の日本語の日本語".encode(), b"the cat sat"]
    sizes, packed, static = [], [], []
    rng = np.random.default_rng(5)
    for t in texts:
        padded = bytes([lm.START]) * lm.ORDER + t + bytes([lm.END])
        packed += [int.from_bytes(padded[i : i + lm.ORDER + 1], "big") for i in range(len(t) + 1)]
        sizes.append(len(t) + 1)
        static.append(np.log10(rng.uniform(0.05, 0.9, len(t) + 1)).astype(np.float32))
    got = lm.adapt(np.array(packed, np.uint64), np.array(sizes), np.concatenate(static))
    for t, model, score in zip(texts, static, got, strict=True):
        assert math.isclose(score, read_in_order(t, model), rel_tol=1e-4, abs_tol=1e-4)


def test_counts_of_earlier_keys_with_clashing_high_bits():
    from tallyframe.llm.lm import earlier

    keys = np.random.default_rng(3).integers(0, 50, 2000).astype(np.uint64)  # all differ only in the bits left out
    seen: Counter = Counter()
    want = []
    for k in keys.tolist():
        want.append(seen[k])
        seen[k] += 1
    assert earlier(keys).tolist() == want and earlier(keys[:1]).tolist() == [0]
