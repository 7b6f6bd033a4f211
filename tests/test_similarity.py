import random

from pyspark.sql import functions as F

from tallyframe.functions import similarity as s


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_the_plain_table(spark):
    random.seed(5)
    pairs = [("".join(random.choices("abc ", k=random.randint(0, 12))), "".join(random.choices("abc ", k=random.randint(0, 12)))) for _ in range(150)]
    pairs += [("ab" * 40, "ba" * 41), ("x" * 61, "x" * 62), ("x" * 62, "xy" * 40), ("", "a"), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", s.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs(r.a, r.b) for r in got)


def test_ratios(spark):
    one = lambda c: round(spark.range(1).select(c).first()[0], 4)
    L = F.lit
    assert one(s.ratio(L("agcy cd"), L("agt id"))) == round(2 * 4 / 13, 4)
    assert one(s.token_set_ratio(L("risk score"), L("score risk total"))) == 1.0
    assert one(s.token_set_ratio(L(""), L("a"))) == 0.0
    assert one(s.field_similarity(L("ADDL_INS_2_NM"), L("prior_carr_nm"))) == 0.4615
    assert one(s.field_similarity(L("AGCY_CD"), L("cancel_cd"))) == 0.625
    assert one(s.token_sort_ratio(L("b a"), L("a b"))) == 1.0
