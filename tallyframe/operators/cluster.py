"""Columns of several sources that mean the same: pairs, mutual bests, groups, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import ensure_checkpoint_dir
from ..functions.similarity import ratio, token_set_ratio

# Thresholds of a pair, of a name and of kindred types.
THRESHOLD = 0.55
NAME_FLOOR = 0.62
KINSHIP_FLOOR = 0.72

# Abbreviations of column names, and prefixes of columns that a source writes about itself.
ABBREVIATIONS = {
    "no": "number", "num": "number", "nbr": "number", "id": "identifier", "cd": "code", "seq": "sequence", "ref": "reference",
    "dt": "date", "eff": "effective", "exp": "expiration", "term": "termination", "ts": "timestamp", "yr": "year", "mo": "month",
    "amt": "amount", "prem": "premium", "annu": "annual", "mnthly": "monthly", "lim": "limit", "ded": "deductible", "bal": "balance",
    "pol": "policy", "ins": "insured", "cov": "coverage", "agt": "agent", "agcy": "agency", "wrtg": "writing", "uw": "underwriting", "stat": "status",
    "cncl": "cancellation", "rsn": "reason", "carr": "carrier", "prod": "product", "chnl": "channel", "regn": "region", "terr": "territory", "rsk": "risk",
    "scr": "score", "addl": "additional", "rel": "relationship", "winbk": "win back", "flg": "flag", "lob": "line of business",
    "nm": "name", "addr": "address", "st": "state", "cust": "customer", "acct": "account", "dist": "distribution",
}
METADATA = r"(?i)^(_cdc|_meta|_ingest|_load)"
# Types that may stand for each other.
KIN = [
    ("integer", "decimal"), ("integer", "string"), ("decimal", "integer"), ("decimal", "string"), ("string", "integer"),
    ("string", "decimal"), ("date", "string"), ("string", "date"), ("boolean", "string"), ("string", "boolean"),
]


def expanded_name(name: Column) -> Column:
    """Lower case, underscores and hyphens to spaces, known abbreviations spelled out."""
    words = F.filter(F.split(F.translate(F.lower(name), "_-", "  "), r"\s+"), lambda t: t != "")
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


def name_similarity(a: Column, b: Column) -> Column:
    """The better of token-set and token-sort ratio of expanded names."""
    in_order = lambda s: F.array_join(F.array_sort(F.split(s, " ")), " ")
    return F.greatest(token_set_ratio(a, b), ratio(in_order(a), in_order(b)))


def _floors(threshold: float) -> tuple[float, float]:
    """Name score and value overlap of which a pair needs one: below both no pair reaches the threshold.

    A name below the first floor leaves the values three quarters of the score.
    """
    name = max(NAME_FLOOR, threshold / 0.85)
    return name, (threshold - 0.25 * min(name, 1.0)) / 0.75


def pair_scores(columns: DataFrame, threshold: float = THRESHOLD, values: DataFrame | None = None) -> DataFrame:
    """Cross-source pairs (a, b) that score at least ``threshold``.

    ``columns``: source_name, column_name, ordinal, inferred_type, is_id, is_coded,
    is_cents, distinct_ratio, null_rate, vocabulary (array of upper-case values).
    ``values`` (source_name, column_name, v) may give the values of bounded columns
    in place of the arrays, any number of them.  A source that names a column twice
    is refused.  ``evidence`` says what a pair's score rests on.

    Candidates come from two set-similarity joins: names (:func:`similar_names`)
    and values (:func:`overlapping`), each at the floor that the threshold leaves
    it.  Names are compared once for each two distinct expanded names, so copies of
    a name in thousands of sources cost one comparison; values are counted in joins
    and no pair carries a vocabulary.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    if not columns.groupBy("source_name", "column_name").count().where("count > 1").isEmpty():
        raise ValueError("a source names a column twice: source names must differ")
    ensure_checkpoint_dir(columns.sparkSession)
    name_floor, value_floor = _floors(threshold)
    keys = ["source_name", "column_name"]
    usable = columns.where(~F.col("column_name").rlike(METADATA)).withColumn("words", expanded_name(F.col("column_name")))
    listed = usable.select(*keys, F.explode("vocabulary").alias("v")) if values is None else values.join(usable.select(*keys), keys, "left_semi").select(*keys, "v")
    listed = listed.distinct()
    usable = usable.drop("vocabulary").join(listed.groupBy(*keys).agg(F.count("*").alias("held")), keys, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    side = lambda p, df: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    ends = [f"{p}_{c}" for p in "ab" for c in keys]
    names = usable.select("words").distinct()
    alike = similar_names(names, name_floor).checkpoint()
    both = alike.unionByName(alike.select(F.col("y").alias("x"), F.col("x").alias("y"), "name")).unionByName(names.where("words <> ''").select(F.col("words").alias("x"), F.col("words").alias("y"), F.lit(1.0).alias("name")))
    named = usable.select(*keys, "words")
    by_name = both.join(side("a", named), F.col("a_words") == F.col("x")).join(side("b", named), F.col("b_words") == F.col("y")).where("a_source_name < b_source_name").select(*ends)
    found = by_name.unionByName(overlapping(listed, value_floor)).distinct()
    # What each pair shares, counted in joins by value.
    shared = found.join(side("a", listed), [f"a_{c}" for c in keys]).join(side("b", listed).withColumnRenamed("b_v", "a_v"), [*[f"b_{c}" for c in keys], "a_v"])
    found = found.join(shared.groupBy(*ends).agg(F.count("*").alias("shared")), ends, "left")
    pairs = found.join(side("a", usable), [f"a_{c}" for c in keys]).join(side("b", usable), [f"b_{c}" for c in keys])
    known = both.select(F.col("x").alias("a_words"), F.col("y").alias("b_words"), F.col("name").alias("known"))
    pairs = pairs.join(known, ["a_words", "b_words"], "left")
    # Names below their floor are compared only where values made the pair.
    name = F.when(F.col("known").isNotNull(), F.col("known")).otherwise(name_similarity(F.col("a_words"), F.col("b_words")))
    shared = F.coalesce("shared", F.lit(0))
    overlap = F.when((F.col("a_held") > 0) & (F.col("b_held") > 0), shared / (F.col("a_held") + F.col("b_held") - shared)).otherwise(0.0)
    same = F.col("a_inferred_type") == F.col("b_inferred_type")
    kin = same | F.concat_ws(">", "a_inferred_type", "b_inferred_type").isin([f"{x}>{y}" for x, y in KIN])
    differing = sum((F.col(f"a_{c}") != F.col(f"b_{c}")).cast("int") for c in ("is_id", "is_coded", "is_cents"))
    gate = F.when(~kin, 0.25).when(~same, 0.85).otherwise(1.0)
    gate = gate * (1 - 0.6 * F.abs(F.col("a_distinct_ratio") - F.col("b_distinct_ratio"))) * (1 - 0.3 * F.abs(F.col("a_null_rate") - F.col("b_null_rate"))) * F.pow(F.lit(0.9), differing)
    gate = F.when(kin, F.greatest(gate, F.lit(KINSHIP_FLOOR))).otherwise(gate)
    rows = pairs.withColumn("name", name).withColumn("overlap", overlap).withColumn("gate", gate)
    raw = (
        F.when(F.col("overlap") > 0, F.greatest(0.75 * F.col("overlap") + 0.25 * F.col("name"), F.when(F.col("name") >= NAME_FLOOR, 0.85 * F.col("name")).otherwise(0.0)))
        .when(F.col("name") >= NAME_FLOOR, 0.85 * F.col("name"))
        .otherwise(0.0)
    )
    rows = rows.withColumn("score", F.bround(raw * F.col("gate"), 6)).where(F.col("score") >= threshold)
    evidence = F.array_compact(
        F.array(
            F.when(F.col("overlap") > 0, F.concat(F.lit("shared values "), F.bround("overlap", 2).cast("string"))),
            F.when(F.col("name") >= NAME_FLOOR, F.concat(F.lit("names "), F.bround("name", 2).cast("string"))),
            F.when(F.col("gate") < 1, F.concat(F.lit("shape "), F.bround("gate", 2).cast("string"))),
        )
    )
    return rows.select("a_source_name", "a_column_name", "a_ordinal", "b_source_name", "b_column_name", "b_ordinal", F.bround("name", 4).alias("name"), F.bround("overlap", 4).alias("overlap"), "score", evidence.alias("evidence"))


def overlapping(listed: DataFrame, share: float) -> DataFrame:
    """Cross-source pairs of columns whose values' Jaccard overlap can reach ``share``, by prefix filter.

    ``listed``: source_name, column_name, v (distinct).  A set that shares ``share``
    of a union has a common value among its rarest n - ceil(share * n) + 1, on
    either side; only these are keys, so a value that very many columns hold is a
    key only for sets of little else.  Sizes bound each other too.
    """
    keys = ["source_name", "column_name"]
    sized = listed.join(listed.groupBy("v").agg(F.count("*").alias("columns")), "v")
    own = Window.partitionBy(*keys)
    ranked = sized.withColumn("n", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("columns", "v")))
    lead = ranked.where(F.col("rank") <= F.col("n") - F.greatest(F.ceil(share * F.col("n") - 1e-9), F.lit(1)) + 1)
    side = lambda p: lead.select("v", F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in keys])
    met = side("a").join(side("b"), "v").where("a_source_name < b_source_name").where((F.least("a_n", "b_n") + 1e-9 >= share * F.greatest("a_n", "b_n")))
    return met.select(*[f"{p}_{c}" for p in "ab" for c in keys]).distinct()


def similar_names(names: DataFrame, floor: float = NAME_FLOOR) -> DataFrame:
    """(x, y, name): every two distinct expanded names, x < y, whose similarity reaches ``floor``, scored once.

    ``names.words`` is distinct.  Two names that share no word are compared by
    their sorted letters' longest common subsequence, so they share floor / 2 of
    their joint length in letters, counted with repeats.  A name's letters stand in
    order of their global rarity; the two rarest that a pair shares lie within both
    names' prefixes that this bound leaves, and those two are the pair's only key.
    Names that share words meet in their rarest common word.  Lengths and shared
    letters bound the score before it is computed.
    """
    parts = F.filter(F.split("words", " "), lambda t: t != "")
    joined = lambda w: F.array_join(F.array_sort(w), " ")
    base = names.where("words <> ''").select("words", parts.alias("parts"), joined(parts).alias("text"), joined(F.array_distinct(parts)).alias("short"))
    forms = F.array_distinct(F.array("text", "short"))
    letters = base.select("words", F.explode(forms).alias("form"))
    # Repeats of a letter are letters of their own: the second e is e2.
    each = F.posexplode(F.array_sort(F.regexp_extract_all("form", F.lit("(?s)."), 0)))
    numbered = letters.select("words", "form", each.alias("at", "c")).withColumn("k", F.row_number().over(Window.partitionBy("words", "form", "c").orderBy("at"))).withColumn("token", F.concat("c", F.col("k").cast("string")))
    rarity = numbered.groupBy("token").agg(F.count("*").alias("seen"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seen", "token"))), lambda t: t["token"])
    sets = numbered.join(rarity, "token").groupBy("words", "form").agg(ordered.alias("tokens")).join(base.select("words", "parts"), "words").checkpoint()
    n = F.size("tokens")

    def keys(role: str, shared: Column) -> DataFrame:
        """Two-letter keys of names in one role; names that may need only one common letter give single ones too."""
        lead = F.slice("tokens", 1, F.greatest(F.least(n - shared + 2, n), F.lit(1)))
        two = F.flatten(F.transform(lead, lambda p, i: F.transform(F.slice(lead, i + 2, F.size(lead)), lambda q: F.concat(p, q))))
        listed = F.when(n <= 2, F.concat(two, F.col("tokens"))).otherwise(two)
        return sets.select(F.explode(listed).alias("key"), *[F.col(c).alias(f"{role}_{c}") for c in ("words", "parts", "tokens")], n.alias(f"{role}_n"))

    at_least = lambda total: F.ceil(floor / 2 * total - 1e-9).cast("int")
    least_partner = floor / (2 - floor)
    met = keys("s", at_least(2 * n)).join(keys("l", at_least(n * (1 + least_partner))), "key")
    met = met.where("s_n < l_n or (s_n = l_n and s_words < l_words)").where("s_words <> l_words").where(F.col("s_n") + 1e-9 >= least_partner * F.col("l_n"))
    common = F.array_intersect("s_tokens", "l_tokens")
    need = at_least(F.col("s_n") + F.col("l_n"))
    first = F.when(need <= 1, F.get(common, F.lit(0))).otherwise(F.concat(F.get(common, F.lit(0)), F.get(common, F.lit(1))))
    apart = met.where(~F.arrays_overlap("s_parts", "l_parts")).where(F.size(common) >= need).where(F.col("key") == first).select(F.least("s_words", "l_words").alias("x"), F.greatest("s_words", "l_words").alias("y")).distinct()
    words = base.select("words", F.explode(F.array_distinct("parts")).alias("word"))
    by_rarity = words.join(words.groupBy("word").agg(F.count("*").alias("seen")), "word").groupBy("words").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "word"))), lambda t: t["word"]).alias("parts"))
    worded = by_rarity.withColumn("length", F.length(F.array_join("parts", " "))).checkpoint()
    side = lambda p: worded.select(F.explode("parts").alias("word"), F.col("words").alias(p), F.col("parts").alias(f"{p}_parts"), F.col("length").alias(f"{p}_n"))
    together = side("x").join(side("y"), "word").where("x < y").where(F.col("word") == F.get(F.array_intersect("x_parts", "y_parts"), F.lit(0)))
    s = F.length(F.array_join(F.array_intersect("x_parts", "y_parts"), " "))
    lone = F.least("x_n", "y_n")
    # No reading is better than all of the shorter name being common, or than the common words against the shorter rest.
    bound = F.greatest(2.0 * lone / (F.col("x_n") + F.col("y_n")), 2.0 * s / (2 * s + F.greatest(lone - s, F.lit(0))))
    repeats = F.size(F.split("x", " ")) + F.size(F.split("y", " ")) > F.size("x_parts") + F.size("y_parts")
    together = together.where((bound + 1e-9 >= floor) | repeats).select("x", "y")
    scored = apart.unionByName(together).withColumn("name", name_similarity(F.col("x"), F.col("y")))
    return scored.where(F.col("name") >= floor)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs whose ends are each the other's best in that source; ties by declared order."""
    a = Window.partitionBy("a_source_name", "a_column_name", "b_source_name").orderBy(F.col("score").desc(), "b_ordinal")
    b = Window.partitionBy("b_source_name", "b_column_name", "a_source_name").orderBy(F.col("score").desc(), "a_ordinal")
    return pairs.withColumn("ra", F.row_number().over(a)).withColumn("rb", F.row_number().over(b)).where("ra = 1 and rb = 1").drop("ra", "rb")


def _member(p: str) -> Column:
    return F.concat_ws(".", F.col(f"{p}_source_name"), F.col(f"{p}_column_name"))


def clusters(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per column: its group (named by its first member), the group's size and confidence.

    Groups grow by the mutual bests in order of score: an edge of two free columns
    makes a group; one of a free column and a group takes it in, if the group has no
    member of its source and it pairs with every member; others do nothing.  The
    result is that of going through all edges one by one, in parallel rounds: edges
    that can't do anything any more are left out, and an edge that comes first
    among all edges of both its ends (a free column or a whole group) is acted on,
    as nothing before it can change them.  What is in no group is a group of one
    with confidence 0.
    """
    ensure_checkpoint_dir(columns.sparkSession)
    rank = [F.col("score").desc(), "x", "y"]
    edges = mutual_best(pairs).select(_member("a").alias("x"), _member("b").alias("y"), "score")
    scores = pairs.select(_member("a").alias("x"), _member("b").alias("y"), "score")
    scores = scores.unionByName(scores.select(F.col("y").alias("x"), F.col("x").alias("y"), "score")).checkpoint()
    source = columns.select(F.concat_ws(".", "source_name", "column_name").alias("member"), "source_name").checkpoint()
    left = edges.checkpoint()
    grouped = source.select("member", "source_name", F.col("member").alias("cluster"), F.lit(0.0).alias("least")).limit(0).checkpoint()
    while not left.isEmpty():
        held = lambda end: grouped.select(F.col("member").alias(end), F.col("cluster").alias(f"{end}_cluster"))
        open_ = left.join(held("x"), "x", "left").join(held("y"), "y", "left").where("x_cluster is null or y_cluster is null")
        new = F.when(F.col("x_cluster").isNull(), F.col("x")).otherwise(F.col("y"))
        open_ = open_.withColumn("cluster", F.coalesce("x_cluster", "y_cluster")).withColumn("new", F.when(F.col("cluster").isNotNull(), new)).checkpoint()
        # A column fits a group if it pairs with all members and brings a source of its own.
        asked = open_.where("cluster is not null").select("new", "cluster").distinct().join(source.select(F.col("member").alias("new"), F.col("source_name").alias("own")), "new")
        with_all = asked.join(grouped.select("member", "source_name", "cluster"), "cluster").join(scores.select(F.col("x").alias("new"), F.col("y").alias("member"), "score"), ["new", "member"], "left")
        fits = with_all.groupBy("new", "cluster").agg(F.min("score").alias("weakest"), F.bool_and(F.col("score").isNotNull() & (F.col("own") != F.col("source_name"))).alias("fits")).where("fits").select("new", "cluster", "weakest")
        free = open_.where("cluster is null").withColumn("weakest", F.col("score"))
        live = free.unionByName(open_.join(fits, ["new", "cluster"]).select(free.columns)).select("x", "y", "score", "new", "cluster", "weakest").checkpoint()
        node = lambda end: F.when(F.col("cluster").isNotNull() & (F.col("new") != F.col(end)), F.col("cluster")).otherwise(F.col(end))
        # A group is named by one of its members, which is no free column, so names of both kinds don't meet.
        ends = live.select("x", "y", "score", F.explode(F.array(node("x"), node("y"))).alias("end"))
        first = ends.withColumn("place", F.row_number().over(Window.partitionBy("end").orderBy(*rank))).where("place = 1").groupBy("x", "y").count().where("count = 2").select("x", "y")
        now = live.join(first, ["x", "y"]).checkpoint()
        made = now.where("cluster is null").select(F.explode(F.array("x", "y")).alias("member"), F.least("x", "y").alias("cluster"), F.col("weakest").alias("least"))
        taken = now.where("cluster is not null").select(F.col("new").alias("member"), "cluster", F.col("weakest").alias("least"))
        grouped = grouped.unionByName(made.unionByName(taken).join(source, "member").select(grouped.columns)).checkpoint()
        left = live.join(now, ["x", "y"], "left_anti").select("x", "y", "score").checkpoint()
    named = grouped.groupBy("cluster").agg(F.min("member").alias("first"), F.count("*").cast("int").alias("size"), F.min("least").alias("confidence"))
    found = grouped.select("member", "cluster").join(named, "cluster").select("member", F.col("first").alias("cluster"), "size", "confidence")
    return source.select("member").join(found, "member", "left").select("member", F.coalesce("cluster", "member").alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def score_clusters(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Precision, recall and F1 over cross-source pairs.

    ``found``: member, source_name, cluster; ``targets``: member, target (may be
    null), secondary.  True pairs share a target; a found pair counts if both are
    catalogued and one has a target; pairs via a secondary target are apart.
    """
    rows = found.join(targets, "member", "left").withColumn("known", F.col("member").isNotNull())
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.source_name") < F.col("b.source_name")))
    listed = targets.select("member", F.lit(True).alias("listed"))
    pairs = pairs.select(F.col("a.member").alias("x"), F.col("b.member").alias("y"), F.col("a.target").alias("tx"), F.col("b.target").alias("ty"), F.col("a.secondary").alias("sx"), F.col("b.secondary").alias("sy"))
    pairs = pairs.join(listed.withColumnRenamed("member", "x").withColumnRenamed("listed", "lx"), "x", "left").join(listed.withColumnRenamed("member", "y").withColumnRenamed("listed", "ly"), "y", "left")
    ours = F.coalesce(F.col("tx") == F.col("ty"), F.lit(False))
    aside = ~ours & F.coalesce((F.col("tx") == F.col("sy")) | (F.col("sx") == F.col("ty")), F.lit(False))
    counted = F.col("lx") & F.col("ly") & (F.col("tx").isNotNull() | F.col("ty").isNotNull())
    kind = F.when(~F.coalesce(counted, F.lit(False)), "unscored").when(ours, "tp").when(aside, "secondary").otherwise("fp")
    tallied = pairs.withColumn("kind", kind).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "unscored", "secondary")])
    who = found.select("member", "source_name").join(targets.where("target is not null"), "member")
    truth = who.groupBy("target", "source_name").agg(F.count("*").alias("n")).groupBy("target").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    total = truth.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).cast("long").alias("truth"))
    rows = tallied.join(F.broadcast(total), F.lit(True))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("truth"), F.lit(0))
    rows = rows.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("r", F.coalesce(r, F.lit(0.0)))
    f1 = F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return rows.select("tp", "fp", "truth", "unscored", "secondary", F.bround("p", 4).alias("precision"), F.bround("r", 4).alias("recall"), F.bround(f1, 4).alias("f1"))


def one_to_one(edges: DataFrame, group: list[str], a: str, b: str, order: list) -> DataFrame:
    """The edges that a greedy one-to-one choice by ``order`` takes within each ``group``, without going through them one by one.

    An edge that comes first at both its ends is taken whatever else is, and its
    ends leave; rounds go on until no edge is left.  ``order`` ranks edges without ties.
    """
    left, taken = edges.checkpoint(), []
    while not left.isEmpty():
        place = lambda end: F.row_number().over(Window.partitionBy(*group, end).orderBy(*order))
        now = left.withColumn("_a", place(a)).withColumn("_b", place(b)).where("_a = 1 and _b = 1").drop("_a", "_b").checkpoint()
        taken.append(now)
        left = left.join(now.select(*group, a), [*group, a], "left_anti").join(now.select(*group, b), [*group, b], "left_anti").select(edges.columns).checkpoint()
    return reduce(DataFrame.unionByName, taken, edges.limit(0))


def vote_consensus(votes: DataFrame, runs: int, *, share: float = 0.8, floor: float = 0.6, known: DataFrame | None = None) -> DataFrame:
    """Pairs proposed by repeated outside runs: (pair, run, a, b, confidence) to one-to-one matches.

    ``known`` (pair, side ``a`` or ``b``, name) lists the columns there are; votes
    for others are dropped.  One vote for each run; kept with max(1, int(runs * share)) votes and a mean
    confidence of ``floor``; then greedily by votes and mean within a source pair.
    """
    if known is not None:
        for side in "ab":
            votes = votes.join(known.where(F.col("side") == side).select("pair", F.col("name").alias(side)).distinct(), ["pair", side], "left_semi")
    once = votes.groupBy("pair", "run", "a", "b").agg(F.max("confidence").alias("confidence"))
    tally = once.groupBy("pair", "a", "b").agg(F.count("*").alias("votes"), F.bround(F.avg("confidence"), 6).alias("mean"))
    tally = tally.where((F.col("votes") >= max(1, int(runs * share))) & (F.col("mean") >= floor))
    ensure_checkpoint_dir(votes.sparkSession)
    return one_to_one(tally.withColumn("votes", F.col("votes").cast("int")), ["pair"], "a", "b", [F.col("votes").desc(), F.col("mean").desc(), "a", "b"])


__all__ = ["clusters", "mutual_best", "pair_scores", "score_clusters", "vote_consensus"]
