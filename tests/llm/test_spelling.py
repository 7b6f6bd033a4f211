"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            seen[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        if vs and max(n[v] for v in vs) >= 10 * n[w]:
            form[w] = min(v for v in vs if n[v] == max(n[u] for u in vs))
    root = lambda w: root(form[w]) if w in form else w
    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def words(rng, k):
    letters = "aebcdéß×÷ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(k)]
    for w in list(base):
        i = rng.randrange(len(w))
        base += [w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]
    return base


def test_whole_operator(spark):
    rng = random.Random(6)
    pool = words(rng, 60)
    weight = [10 ** rng.uniform(0, 3.5) for _ in pool]
    rows = [(i * 7, " ".join(rng.choices(pool, weight, k=200)).title() if i % 3 else "-".join(rng.choices(pool, weight, k=200))) for i in range(60)]
    rows += [(3, None), (4, ""), (None, " ".join(pool[:20])), (None, " ".join(pool[:20])), (5, rows[0][1]), (5, rows[0][1]), (6, "x" * 40_000 + " " + "x" * 40_000 + " " + "x" * 39_999 + "1" + "x" * 39_999), (8, "café́ İstanbulı 中文")]
    df = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], "doc_id long, text string, n int, word string, form int").repartition(4)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(df).collect()}
    want = brute(rows)
    assert got == want and sum(v[2] is not None for v in want.values()) > 10
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.where("doc_id = 4")).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 4, 9])
def test_symbols_change_no_result(spark, symbols):
    rng = random.Random(symbols)
    pool = sorted(set(words(rng, 40)))
    df = spark.createDataFrame([(w,) for w in pool], "word string")
    got = [(r.word, r.near) for r in spelling.near_pairs(df, symbols).collect()]
    assert sorted(got) == sorted((a, b) for a in pool for b in pool if one_edit(a, b))


def test_chain_and_ties(spark):
    rows = [("aaaaaab", 5), ("aaaaaac", 50), ("aaaaacc", 500), ("aaaaccc", 5000), ("ccccccd", 1), ("ccccccf", 10), ("ccccccE".lower(), 10), ("zzzzzzz", 7)]
    got = {r.word: (r.form, r.form_n, r.root, r.n_near) for r in spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["aaaaaab"] == ("aaaaaac", 50, "aaaaccc", 1)
    assert got["aaaaaac"] == ("aaaaacc", 500, "aaaaccc", 2)
    assert got["ccccccd"] == ("cccccce", 10, "cccccce", 2)
    assert got["zzzzzzz"] == (None, None, "zzzzzzz", 0)


def test_keys_are_those_of_all_neighbours():
    rng = random.Random(9)
    base, mask = spelling._BASE, (1 << 64) - 1
    key = lambda w: sum(s * pow(base, i, 1 << 64) for i, s in enumerate(w)) & mask
    w = [rng.randint(1, 3) for _ in range(9)]
    near = {tuple(w)} | {tuple(w[:i] + w[i + 1 :]) for i in range(9)} | {tuple(w[:i] + [c] + w[i + 1 :]) for i in range(9) for c in (1, 2, 3)} | {tuple(w[:i] + [c] + w[i:]) for i in range(10) for c in (1, 2, 3)}
    assert set(spelling.neighbour_keys(np.array([w], np.uint64), 3)[0].tolist()) == {key(v) for v in near}
