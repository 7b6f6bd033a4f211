import itertools

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import transforms as t
from tallyframe.functions.checkpoints import ensure_checkpoint_dir
from tallyframe.operators import cluster, mapping, profile, tuning
from tallyframe.sources import artifacts, delimited

COLS = "source_name string, column_name string, ordinal int, inferred_type string, is_id boolean, is_coded boolean, is_cents boolean, distinct_ratio double, null_rate double, vocabulary array<string>"


def test_project_takes_the_last_approved_and_keeps_order(spark):
    rows = spark.createDataFrame([("PCM-7", "Y", "12"), ("PCM-8", "N", "")], "A string, B string, C string")
    fields = [("id", "bigint"), ("flag", "boolean"), ("region", "string"), ("gone", "date"), ("twice", "integer")]
    approved = [("id", "A"), ("flag", "case B when 'Y' then true else false end"), ("id", "try_cast(replace(A, 'PCM-', '') as bigint)")]
    out = t.project(rows, fields, approved, [("region", "HARDCODED", "TX"), ("twice", "DERIVED", "2 * try_cast(C as bigint)")], ["C"])
    assert out.columns == ["id", "flag", "region", "gone", "twice", "extended_attributes"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(7, True, "TX", None, 24, '{"C":"12"}'), (8, False, "TX", None, None, '{"C":""}')]
    assert t.project(rows, fields, approved).first().extended_attributes is None
    names = spark.createDataFrame([("id",), ("x",), ("y",)], "name string")
    assert [r.name for r in t.unmapped_fields(names, spark.createDataFrame([("id",)], "target string"), spark.createDataFrame([("y",)], "field string")).collect()] == ["x"]


def test_labels_round_trip(spark, tmp_path):
    columns = spark.createDataFrame([("s1", "t", "A", "f", None, 0.5, "cents", True), ("s1", "t", "B", None, "g", None, None, False), ("../x", "t", "A", "f", None, 0.5, None, True)], "source_name string, table_name string, source_column string, truth string, secondary string, confidence_floor double, check string, is_hard boolean")
    missing = spark.createDataFrame([("s1", "t", "z"), ("s1", "t", "y")], "source_name string, table_name string, field string")
    artifacts.write_labels(columns, missing, str(tmp_path / "l"))
    found, gone = artifacts.read_labels(spark, str(tmp_path / "l"))
    assert {tuple(r) for r in found.collect()} == {("s1", "t", "A", "f", None, 0.5, "cents", True), ("s1", "t", "B", None, "g", None, None, False)}
    assert sorted(r.field for r in gone.collect()) == ["y", "z"]


def test_nested_profiles_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", "t", "A", "integer"), ("s", "t", "B", "date"), ("s", "u", "C", "string")], "source_name string, table_name string, name string, inferred_type string")
    artifacts.write_nested(rows, str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p")).select("source_name", "table_name", F.inline("columns"))
    assert {tuple(r[c] for c in rows.columns) for r in back.collect()} == {tuple(r) for r in rows.collect()}


def test_files_of_two_separators(spark, tmp_path):
    (tmp_path / "a.dat").write_text("X|Y|Z\n1|2|3\n4|5\n")
    (tmp_path / "b.csv").write_text("X,Y,W\n6,7,8\n")
    out = delimited.read(spark, [str(tmp_path / "a.dat"), str(tmp_path / "b.csv")], table_name="t")
    got = {(r.X, r.Y, r.Z, r.W, r.table_name) for r in out.collect()}
    assert got == {("1", "2", "3", "", "t"), ("4", "5", "", "", "t"), ("6", "7", "", "8", "t")}
    assert delimited.read(spark, str(tmp_path / "a.dat"), sep=",").columns == ["X|Y|Z"]


def test_only_the_first_rows_vote(spark):
    rows = spark.createDataFrame([(i, "7" if i < 3 else "x") for i in range(10)], "n int, v string")
    melted = profile.melt(rows.select("v", "n"), F.col("n"), "t")
    kind = lambda **k: {r.column_name: (r.inferred_type, r.row_count) for r in profile.profile(melted, **k).collect()}["v"]
    assert kind() == ("string", 10) and kind(vote_rows=5) == ("integer", 10)


def catalog(spark, n=3, size=6):
    import random

    random.seed(4)
    words = ["amt", "date", "policy", "code", "agent", "name", "risk", "score"]
    rows = [(f"s{s}", "_".join(random.sample(words, 2)) + f"_{c}", c, random.choice(["string", "date"]), False, c % 2 == 0, False, 0.5, 0.1 * (c % 3), [f"v{random.randrange(6)}" for _ in range(3)] if c % 2 == 0 else []) for s in range(n) for c in range(size)]
    return spark.createDataFrame(rows, COLS)


def test_blocking_loses_no_pair(spark):
    import random

    ensure_checkpoint_dir(spark)
    rng = random.Random(3)
    words = ["policy", "number", "date", "code", "agent", "effective", "risk", "x", "ab", "ba", "of", "birth", "zip"]
    names = {"a", "b", "ab", "aab", "aaa", "b a", "a a", "a b", "b b a", "eff dt", "policy number", "number policy", "xyz", "zz z", "date of birth", "birth date"}
    while len(names) < 130:
        names.add(" ".join(rng.choice(words) if rng.random() < 0.6 else "".join(rng.choice("abcdeorst") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3))))
    d = spark.createDataFrame([(n,) for n in sorted(names)], "words string")
    every = d.select(F.col("words").alias("x")).crossJoin(d.select(F.col("words").alias("y"))).where("x < y").withColumn("name", cluster.name_similarity(F.col("x"), F.col("y"))).where(F.col("name") >= cluster.NAME_FLOOR).collect()
    for floor in (cluster.NAME_FLOOR, 0.8):
        got = {(r.x, r.y): r.name for r in cluster.similar_names(d, floor).collect()}
        assert got == {(r.x, r.y): r.name for r in every if r.name >= floor} and ("a", "ab") in {(r.x, r.y) for r in every}


def test_overlap_loses_no_pair(spark):
    import random

    rng = random.Random(4)
    sets = {(f"s{i % 4}", f"c{i}"): {rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 9))} for i in range(60)}
    listed = spark.createDataFrame([(s, c, v) for (s, c), vs in sets.items() for v in vs], "source_name string, column_name string, v string")
    for share in (0.05, 0.52, 1.0):
        got = {(r.a_source_name, r.a_column_name, r.b_source_name, r.b_column_name) for r in cluster.overlapping(listed, share).collect()}
        want = {(*p, *q) for p in sets for q in sets if p[0] < q[0] and len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= share - 1e-9}
        assert want <= got and (want or share == 1.0)


def test_pairs_are_those_of_all_pairs(spark):
    """Candidates against every cross-source pair, by the same scores at a threshold that keeps all."""
    ensure_checkpoint_dir(spark)
    columns = catalog(spark, 3, 6)
    score = lambda t: {tuple(r[:2]) + (r.b_source_name, r.b_column_name): r.score for r in cluster.pair_scores(columns, t).collect()}
    low, high = score(0.05), score(0.55)
    assert high == {k: s for k, s in low.items() if s >= 0.55} and len(high) < len(low)
    given = columns.select("source_name", "column_name", F.explode("vocabulary").alias("v"))
    assert {(*tuple(r[:2]), r.b_source_name, r.b_column_name): r.score for r in cluster.pair_scores(columns, 0.55, given).collect()} == high


def test_groups_against_the_greedy_fold(spark):
    ensure_checkpoint_dir(spark)
    columns = catalog(spark, 4, 7)
    pairs = cluster.pair_scores(columns).checkpoint()
    score = {frozenset((f"{r.a_source_name}.{r.a_column_name}", f"{r.b_source_name}.{r.b_column_name}")): r.score for r in pairs.collect()}
    edges = sorted(((-r.score, f"{r.a_source_name}.{r.a_column_name}", f"{r.b_source_name}.{r.b_column_name}") for r in cluster.mutual_best(pairs).collect()))
    groups = []
    for s, x, y in edges:
        gx, gy = (next((g for g in groups if m in g), None) for m in (x, y))
        if gx is None and gy is None:
            groups.append([x, y])
        elif (gx is None) != (gy is None):
            g, new = (gy, x) if gx is None else (gx, y)
            if new.split(".")[0] not in {m.split(".")[0] for m in g} and all(frozenset((new, m)) in score for m in g):
                g.append(new)
    want = {frozenset(g) for g in groups}
    got = {}
    for r in cluster.clusters(columns, pairs).collect():
        got.setdefault(r.cluster, set()).add(r.member)
        assert (r.size == 1) == (r.confidence == 0)
    assert {frozenset(g) for g in got.values() if len(g) > 1} == want and len(want) > 2
    assert sum(map(len, got.values())) == 28
    assert all(len(r.evidence) > 0 for r in pairs.collect())
    with pytest.raises(ValueError):
        cluster.pair_scores(columns.unionByName(columns.limit(1)))


def test_long_chains_of_edges(spark):
    """Edges of falling score along a chain: every second one is taken, whatever the order of rounds."""
    chain = spark.createDataFrame([("p", f"a{k:03d}", f"b{k:03d}", 1000 - 2 * k) for k in range(12)] + [("p", f"a{k + 1:03d}", f"b{k:03d}", 999 - 2 * k) for k in range(11)], "pair string, a string, b string, w int")
    got = {(r.a, r.b) for r in cluster.one_to_one(chain, ["pair"], "a", "b", [F.col("w").desc()]).collect()}
    assert got == {(f"a{k:03d}", f"b{k:03d}") for k in range(12)}


def test_votes_against_the_greedy_choice(spark):
    import random

    random.seed(9)
    rows = [(f"p{random.randrange(2)}", r, f"a{random.randrange(4)}", f"b{random.randrange(4)}", random.choice([0.5, 0.7, 0.9])) for r in range(10) for _ in range(30)]
    known = [(p, s, f"{s}{k}") for p in ("p0", "p1") for s in "ab" for k in range(4) if (s, k) != ("a", 3)]
    got = {(r.pair, r.a, r.b, r.votes) for r in cluster.vote_consensus(spark.createDataFrame(rows, "pair string, run int, a string, b string, confidence double"), 10, share=0.5, known=spark.createDataFrame(known, "pair string, side string, name string")).collect()}
    best = {}
    for p, r, a, b, c in rows:
        if a != "a3":
            best[p, r, a, b] = max(c, best.get((p, r, a, b), 0))
    tally = {}
    for (p, _, a, b), c in best.items():
        tally.setdefault((p, a, b), []).append(c)
    want, used = set(), set()
    for (p, a, b), c in sorted(tally.items(), key=lambda x: (-len(x[1]), -round(sum(x[1]) / len(x[1]), 6), x[0][1], x[0][2])):
        if len(c) >= 5 and sum(c) / len(c) >= 0.6 and not {(p, a), (p, b)} & used:
            used |= {(p, a), (p, b)}
            want.add((p, a, b, len(c)))
    assert got == want and want


def test_weights_by_source_and_loose_suggestions(spark):
    columns = spark.createDataFrame([("s", "t", "POL_NO", 0, "string", None, True, False, False, [], "policy"), ("r", "t", "POL_NO", 0, "string", None, True, False, False, [], "policy")], "source_name string, table_name string, column_name string, ordinal int, inferred_type string, date_format string, is_id boolean, is_coded boolean, is_cents boolean, samples array<string>, schema_key string")
    fields = spark.createDataFrame([("policy", 0, "policy_no", "string", True, None, ["policy_no", "pol_no"])], "schema_key string, ordinal int, name string, target_type string, required boolean, secondary string, names array<string>")
    weights = spark.createDataFrame([("s", 0.2, 0.3, 0.5), (None, 0.0, 1.0, 0.0)], "source_name string, wa double, wb double, wc double")
    got = {r.source_name: r.confidence for r in mapping.scores(columns, fields, weights).collect()}
    assert got == {"s": 0.5, "r": 1.0}
    best = mapping.best_field(mapping.scores(columns, fields, weights))
    same = spark.createDataFrame([("s", "t", "POL_NO", "policy_no", 0.5)], "source_name string, table_name string, column_name string, s_target string, s_confidence double")
    method = lambda strict: {r.source_name: r.method for r in mapping.merge_suggestions(best, same, fields, strict=strict).collect()}
    assert method(True)["s"] == "rule" and method(False)["s"] == "suggested" and method(False)["r"] == "rule"
    decided = mapping.map_columns(columns, fields, overrides=spark.createDataFrame([("s", "t", "POL_NO", "none")], "source_name string, table_name string, column_name string, o_target string"))
    assert {r.source_name: r.final_target for r in decided.collect()} == {"s": None, "r": "policy_no"}


def test_split_and_comparison(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3 == 0).alias("hard"))
    got = {(r.hard, r.part): r["count"] for r in tuning.stratified_split(rows, ["id"], "hard").groupBy("hard", "part").count().collect()}
    sizes = {r.hard: r["count"] for r in rows.groupBy("hard").count().collect()}
    assert all(got[h, "train"] == round(n * 0.7) and got[h, "holdout"] == n - round(n * 0.7) for h, n in sizes.items())
    d = lambda *r: spark.createDataFrame(r, "id int, verdict string, loss double")
    better = tuning.comparison(d((1, "TP", 0.2), (2, "FN", 1.0)), d((1, "TN", 0.1), (2, "FN", 0.9)), ["id"]).first()
    worse = tuning.comparison(d((1, "TP", 0.2), (2, "FN", 1.0)), d((1, "FP", 0.1), (2, "TP", 0.1)), ["id"]).first()
    assert better.improved and not worse.improved and worse.regressed == 1
    assert [r.point for r in tuning.better_than(spark.createDataFrame([(1, 0.1), (2, 0.3)], "point int, mean_loss double"), F.lit(0.2)).collect()] == [1]


def test_tool_value_by_hand(spark):
    rows = [("s", ["a", "b"], "TP"), ("s", ["a"], "FN"), ("s", [], "TP"), ("r", ["a"], "TP"), ("s", ["c"], None)]
    got = {(r.signature, r.tool): (r.with_n, r.without_n, r.delta) for r in tuning.tool_value(spark.createDataFrame(rows, "signature string, tools array<string>, verdict string")).collect()}
    assert got == {("s", "a"): (2, 1, -0.5), ("s", "b"): (1, 2, 0.5)}
    assert all(len(set(c)) == len(c) for c in itertools.combinations(got, 2))
