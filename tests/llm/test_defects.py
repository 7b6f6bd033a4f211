"""Repeated ids with different content, unbounded stretches of white space and names, skewed sizes."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm_ops import brute_sets, components


def test_minhash_of_an_id_with_different_texts(spark):
    """An id's texts are nodes of their own, and the id unites what they are linked with."""
    from tallyframe.llm.minhash import near_duplicates

    random.seed(6)
    make = lambda: [f"w{random.randrange(3000)}" for _ in range(60)]
    near = lambda t: [*t[:-1], "changed"]
    texts = [make() for _ in range(12)]
    rows = [(1, texts[0]), (1, texts[1]), (2, near(texts[0])), (3, near(texts[1])), (4, texts[2]), (4, []), (5, texts[2]), (0, near(texts[2]))]
    rows += [(7, texts[3]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (9, texts[5]), (-6, near(texts[5])), (10, near(texts[4])), (None, texts[0]), (11, texts[6]), (12, near(near(texts[1])))]
    rows = [(i, " ".join(t)) for i, t in rows]
    sets = brute_sets(list(enumerate(t for _, t in rows)))
    links = [(rows[a][0], rows[b][0]) for a in sets for b in sets if a < b and None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components({i for i, _ in rows if i is not None}, links)
    want = Counter((i, len(sets[n]), comp.get(i), i is None or comp[i] == i) for n, (i, _) in enumerate(rows))
    assert comp[3] == comp[2] == 1 and comp[10] == -6 and comp[5] == 0
    for parts in (1, 5):
        assert Counter(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())) == want


def test_pipeline_keeps_one_of_an_id_with_different_texts(spark):
    import corpus_pipeline as p

    base = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " z"), (3, base[1] + " z")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in p.near_dedup(spark, d, "").collect()] == [1]


def test_embeddings_of_an_id_with_different_vectors(spark):
    from tallyframe.llm.embed_dedup import near_duplicates

    rng = np.random.default_rng(3)
    v = rng.standard_normal((9, 24))
    near = lambda x: x + rng.standard_normal(24) * 0.03
    rows = [(1, v[0]), (1, v[1]), (2, near(v[0])), (3, near(v[1])), (4, v[2]), (4, v[2]), (5, near(v[2])), (6, v[3]), (6, near(v[3])), (7, v[4]), (0, near(v[5])), (8, v[5]), (8, v[6]), (9, near(v[6]))]
    listed = [(i, x.tolist()) for i, x in rows] + [(7, None), (10, [0.0] * 24), (None, v[0].tolist())]
    unit = {(i, tuple(x)): np.array(x) / np.linalg.norm(x) for i, x in listed if i is not None and x and any(x)}
    linked = {k: {j for j in unit if j != k and unit[k] @ unit[j] >= 0.95} for k in unit}
    comp = components({i for i, _ in listed if i is not None}, [(k[0], j[0]) for k in unit for j in linked[k]])
    want = Counter((i, len(linked.get((i, tuple(x or ())), ())), comp.get(i), i is None or comp[i] == i) for i, x in listed)
    assert comp[2] == comp[3] == 1 and comp[9] == 0
    for parts in (1, 4):
        got = near_duplicates(spark.createDataFrame(listed, "vec_id long, embedding array<double>").repartition(parts)).collect()
        assert Counter(map(tuple, got)) == want


def test_windows_wider_than_a_tile(spark, monkeypatch):
    from tallyframe.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "TILE", 7)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((80, 16)), np.repeat(rng.standard_normal((1, 16)), 60, 0) + rng.standard_normal((60, 16)) * 0.1])
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), window=32).collect()}
    assert [got[i] for i in range(len(v))] == near.sum(axis=1).tolist()


def test_secrets_at_any_distance(spark):
    """Neither white space nor a name's length hides a value, and other text changes no verdict."""
    from tallyframe.llm.secret_scan import scan

    gaps = [" " * 25, " " * 5000, "\n\t" * 400]
    texts = [f"password ={g}hunter2xyz99 end" for g in gaps] + [f"password{g}= hunter2xyz99 end" for g in gaps]
    texts += [f"password_{'n' * 45} = hunter2xyz99 end", f"my_{'n' * 300}_password={'hunter2xyz99'} end", "password ===== hunter2xyz99 end", "old-password: 'hunter2xyz99'"]
    with_hash = [t + " and commit 7c4a8d09ca3762af61e59520943dc26494f8941b here" for t in texts]
    rows = list(enumerate(texts + with_hash))
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).where("value = 'hunter2xyz99'").collect()
    assert Counter((r.doc_id, r.is_secret) for r in got) == Counter({(i, True): 1 for i, _ in rows})
    by_id = {r.doc_id: (r.word_at, r.probability) for r in got}
    assert all(by_id[i] == by_id[i + len(texts)] for i in range(len(texts)))


def test_secret_patterns_are_linear_in_names_and_space(spark):
    from tallyframe.llm.secret_scan import candidates

    texts = ["token_" * 170_000, "token" + " " * 1_000_000, "pass-" * 100_000 + " = abc", "token:" * 170_000, "password" + "=" * 1_000_000, ("secret" + " " * 50) * 18_000, "n" * 1_000_000 + "token=abcdefgh1"]
    began = time.perf_counter()
    got = Counter(r.id for r in candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect())
    assert time.perf_counter() - began < 60 and got[6] == 1 and not got[0] and not got[1]


def test_open_tags_are_linear(spark):
    from tallyframe.llm.urlfilter import Rule, judge_urls

    canonical = "<link rel=canonical href=http://bad.net/1>"
    rows = [(1, "http://a.com/1", canonical + "<link " * 170_000), (2, "http://a.com/2", "canonical" + "<meta " * 170_000), (3, "http://a.com/3", "<link title='<' rel=canonical href=http://bad.net/1>"), (4, "http://a.com/4", "<link " * 9 + canonical), (5, "http://a.com/5", "<link rel=canonical href=http://bad.net/1")]
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [Rule("net", "/", "block")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"} and time.perf_counter() - began < 60


def test_archives_of_skewed_records_are_cut_by_bytes(spark, monkeypatch, tmp_path):
    from tallyframe.llm import warc

    small = [(i, "u", f"<p>{i}</p>") for i in range(2000)]
    large = [(5000 + i, "u", f"{i}" + "é\r\n" * 5000) for i in range(40)]
    d = spark.createDataFrame(small + large, "page_id long, url string, html string").coalesce(1)
    whole = spark.createDataFrame(small[:1], d.schema)
    path = str(tmp_path / "archives")
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    warc.write_archives(d, path)
    sizes = [f.stat().st_size for f in (tmp_path / "archives").glob("part-*")]
    assert len(sizes) > 10 and max(sizes) <= 100_000
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, path).collect()}
    assert got == {i: len(h.encode()) for i, _, h in small + large}
    assert warc.archive_round_trip(whole).count() == 1


def test_scores_do_not_depend_on_the_layout(spark):
    """One, seven and sixteen partitions, rows in another order: the same model, and so the same scores."""
    import random

    from tallyframe.llm.lm import score_texts

    rng = random.Random(11)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(names) for _ in range(rng.randint(0, 40)))) for k in range(120)] + [(200, None), (201, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts, shuffled in ((1, 8), (7, 3), (16, 16)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string").repartition(parts)
            seen.append({r.doc_id: (r.score, r.n_known, r.base_score) for r in score_texts(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in seen[1:]:
        assert other.keys() == seen[0].keys()
        for k, (score, known, base) in seen[0].items():
            assert abs(other[k][0] - score) <= 1e-9 * abs(score) and other[k][1] == known and abs(other[k][2] - base) <= 1e-9 * abs(base)


def test_cells_of_shared_slots_keep_all_counts():
    """However few the slots are and however sequences are dealt: the counts of all contexts, those without a dense place included."""
    import numpy as np
    import pyarrow as pa

    from tallyframe.llm import lm

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 47, 3000))
    n = rng.integers(1, 9, len(keys))
    want: dict[int, list[int]] = {}
    for key, times in zip(keys, n, strict=True):
        one = np.array([key], np.uint64)
        for _, bit, node in lm._bits(one):
            for slot, check in lm._slots(lm._contexts(one), node, 6):
                want.setdefault((int(slot[0]) << 8) | int(check[0]), [0, 0])[int(bit[0])] += int(times)
    for cuts in ([0, 3000], [0, 700, 701, 3000]):
        got: dict[int, list[int]] = {}
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            batch = pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(n[i:j])], names=["key", "n"])
            for out in lm._tables(6)(iter([batch])):
                for row in out.to_pylist():
                    cell = got.setdefault(row["cell"], [0, 0])
                    cell[0] += row["n0"]
                    cell[1] += row["n1"]
        assert got == want


@pytest.mark.parametrize("stage", ["language_id", "byte_bpe"])
def test_pipeline_hands_texts_to_workers_in_small_batches(spark, stage):
    import corpus_pipeline as p

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    try:
        docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat('word ', 20000) as text", "'en' as lang", "'web' as source", "100000L as n_chars")
        assert dict(p.STAGES)[stage](spark, docs, "").count() == 40
        sizes = [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    finally:
        spark.conf.set(key, was)
    assert sum(sizes) >= 4_000_000
    assert max(sizes) <= p.BATCH + 200_000
