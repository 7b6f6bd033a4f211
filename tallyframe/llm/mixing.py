"""Mixing sources to target weights by a hypergeometric splitting tree.

Targets.  The sources share the words of the whole input by weight; a target
stops at ``max_epochs`` times its source's size and the excess is shared again
by weight until none is above.

Blocks.  A keyed hash permutes each source's documents and cuts the permutation
into blocks of about ``block_words`` words and at most about ``block_rows``
documents, so that a source of empty texts is cut too.  A source is taken in whole passes
and one partial pass, which ends in the permuted order where its quota is met, so
the words taken come within half a document of the target.

Tree.  The blocks to draw, by source, are one vector of exact quotas.  A node of
the tree halves its output shards and draws the left half's vector from the
multivariate hypergeometric distribution by keyed hashes, at a cost that doesn't
depend on the number of blocks, so every level is one select of the nodes before and reruns agree.  At the
leaves each shard owns a disjoint run of each source's permuted draws; within a
shard the documents are ordered by another keyed hash.

Only DataFrame functions run.  Documents move once, hashed by (source, block), so
a source that holds most of the rows is spread like any other; the plan's own
tables have a row for each block or for each shard and source, and what is
numbered or added up along a source is dealt by range, never sorted in one task.

Defined results: a null text has size 0; null is a source like any other and
comes last; rows that repeat an id are documents of their own; a source without
words has target 0 and is taken 0 words; an empty table gives an empty result;
further columns of the input are carried along by :func:`mix`, whose own columns
``shard`` and ``copy`` take the place of any of that name.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, beside_wide_rows, broadcast_if_small, fresh, materialize, running_sum

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 20240611
#: Marked items up to which a node draws them one by one, and attempts beyond.
FEW, TRIES = 32, 80


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a keyed hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """One row per source: rank, source, source_size, rows, target.

    Sorted by the ratio of limit to weight, the sources at their limit are a
    prefix; the share of the rest follows from running sums.  One row for each
    source meets in a window.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sums.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w).withColumn("limit", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("limit") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped, used = F.coalesce(F.sum("limit").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    share = (F.sum("source_size").over(every) - capped) / (F.sum("w").over(every) - used)
    ranked = ranked.withColumn("share", share)
    first = F.min(F.when(F.col("share") * F.col("w") <= F.col("limit"), F.struct((F.col("limit") / F.col("w")).alias("ratio"), F.col("rank").alias("at"), F.col("share").alias("share")))).over(every)
    ranked = ranked.withColumn("level", first["share"])
    return ranked.select("rank", "source", "source_size", "rows", F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("limit").cast("double"))).alias("target"))


def _log_factorial(n: str) -> str:
    """SQL of ln n! by Stirling's series at n + 8, so that it is exact to about 1e-13 of its value."""
    near, far = (" * ".join(f"({n} + {i}D)" for i in span) for span in ((1, 2, 3, 4), (5, 6, 7, 8)))
    return f"(({n} + 8.5D) * ln({n} + 9D) - ({n} + 9D) + 0.9189385332046727D + 1 / (12 * ({n} + 9D)) - 1 / (360 * pow({n} + 9D, 3)) - ln({near}) - ln({far}))"


def hypergeometric(total: str, marked: str, draws: str, *key: str) -> str:
    """SQL of how many of ``marked`` of ``total`` items are among ``draws`` of them.

    Few marked items are drawn one after the other.  Many are drawn by ratio of
    uniforms: keyed points in the box around the square root of the
    distribution, of which the first beneath it counts; more than half are, so
    that ``TRIES`` of them all fail with a probability below 1e-20, whatever the
    numbers.  So a node costs the same at every size.
    """
    uniform = lambda *parts: f"(pmod(xxhash64({SEED}, {', '.join([*key, *parts])}), {1 << 52}) / {1 << 52}D)"
    weight = lambda x: f"-({' + '.join(_log_factorial(n) for n in (x, f'(t.k - {x})', f'(t.m - {x})', f'(t.others + {x})'))})"
    one_by_one = f"aggregate(sequence(1L, s.k), 0L, (x, j) -> x + cast({uniform('j')} * (s.n - j + 1) < s.m - x as bigint))"
    # of any distribution of this kind: the box has the sides 2 sqrt(2/e) spread + 3 - 2 sqrt(3/e)
    shape = """named_struct('k', s.k, 'm', s.m, 'others', s.n - s.k - s.m, 'low', greatest(0L, s.m + s.k - s.n), 'high', least(s.m, s.k), 'centre', s.m * (s.k / s.n) + 0.5D,
        'box', sqrt(s.m * (s.k / s.n) * (1 - s.k / s.n) * (s.n - s.m) / greatest(s.n - 1, 1L) + 0.5D) * 1.7155277699214135D + 0.8989161620588988D, 'mode', floor((s.m + 1D) * (s.k + 1D) / (s.n + 2D)))"""
    u = f"({uniform(repr('u'), 'j')} + 1e-16D)"
    point = f"named_struct('u', {u}, 'x', floor(t.centre + t.box * ({uniform(repr('v'), 'j')} - 0.5D) / {u}))"
    fit = f"case when c.x between t.low and t.high then case when 2 * ln(c.u) <= {weight('c.x')} - {weight('t.mode')} then cast(c.x as bigint) end end"
    by_ratio = f"coalesce(aggregate(sequence(1, {TRIES}), cast(null as bigint), (found, j) -> case when found is not null then found else transform(array({point}), c -> {fit})[0] end), cast(t.mode as bigint))"
    choose = f"case when s.k <= 0 or s.m <= 0 then 0L when s.m >= s.n then s.k when s.k <= {FEW} then {one_by_one} else transform(array({shape}), t -> {by_ratio})[0] end"
    return f"transform(array(named_struct('n', {total}, 'k', {marked}, 'm', {draws})), s -> {choose})[0]"


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, rank, quota): the splitting tree over ``shards`` leaves, a power of two.

    ``quotas`` has a row for each source: rank (0, 1, ...) and quota.  Each level
    is one select: a node's left half is drawn source by source, each from what
    the draws before it left, and its right half is what remains.
    """
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda s: s["quota"]).alias("q")).select(F.lit(0).cast("long").alias("node"), F.coalesce("q", F.array().cast("array<long>")).alias("q"))
    total = "aggregate(q, 0L, (a, b) -> a + b)"
    draw = hypergeometric("acc.rest", "k", "acc.draws - aggregate(acc.left, 0L, (a, b) -> a + b)", "level", "node", "size(acc.left)")
    left = f"aggregate(q, named_struct('left', cast(array() as array<bigint>), 'rest', {total}, 'draws', floor({total} / 2)), (acc, k) -> named_struct('left', array_append(acc.left, {draw}), 'rest', acc.rest - k, 'draws', acc.draws)).left"
    for level in range(int(log2(shards))):
        drawn = nodes.withColumn("level", F.lit(level)).withColumn("left", F.expr(left))
        nodes = drawn.select(F.expr("inline(array(named_struct('node', node * 2, 'q', left), named_struct('node', node * 2 + 1, 'q', zip_with(q, left, (a, b) -> a - b))))"))
        if level % 4 == 3:
            nodes = materialize(nodes, "nodes")  # plans stay short
    return nodes.select(F.col("node").alias("shard"), F.posexplode("q").alias("rank", "quota"))


def plan_mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3, block_words: int = 1 << 18, block_rows: int = 1 << 14, shard_words: int = 1 << 22) -> DataFrame:
    """One row per document: size, source_size, target, taken and ``shards``.

    ``shards`` lists the output shard of each copy of the document; ``taken`` is
    its size times their number.  ``keep`` names columns to carry along.
    """
    held = [F.col(f"`{c}`").alias(f"__{c}") for c in keep or []]
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *held)
    sized = materialize(base, "sizes") if not held else base
    plan = materialize(targets(sized.select("source", "size"), weights, max_epochs), "targets")
    head = plan.agg(F.count("*").alias("k"), F.sum("source_size").alias("words")).first()
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = plan.select("rank", F.col("source").alias("_s"), "source_size", "target", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("part"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("rows") / block_rows)).cast("long").alias("blocks"))

    place = F.pmod(F.xxhash64(F.lit(SEED), F.col("id"), F.col("size")), F.lit(1 << 32))
    rows = sized.join(broadcast_if_small(sources, head["k"]), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("place", place)
    rows = rows.withColumn("block", F.floor(F.col("place") * F.col("blocks") / F.lit(float(1 << 32))).cast("long"))
    # a wide table is read again rather than written a second time
    totals = (rows.select("rank", "block", "size", "passes", "part")).groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("part").alias("part"))
    totals = materialize(running_sum(totals, "rank", ["block"], F.col("words"), "ahead"), "blocks")

    # draws: whole passes over all blocks, and the partial pass over those it reaches
    copies = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("ahead") < F.col("part"), 0).otherwise(1))
    draws = totals.where((F.col("passes") > 0) | (F.col("ahead") < F.col("part"))).select("rank", "block", F.explode(copies).alias("copy"))
    draws = draws.withColumn("at", _uniform(F.lit("draw"), "rank", "copy", "block"))
    draws = running_sum(draws, "rank", ["at", "copy", "block"], F.lit(1).cast("long"), "earlier")
    draws = materialize(draws.select("rank", "block", "copy", (F.col("earlier") + 1).alias("draw")), "draws")
    shards = 1 << max(0, ceil(log2(max(1.0, (head["words"] or 0) / shard_words))))
    quotas = plan.select("rank").join(draws.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"))
    leaves = materialize(split_quotas(quotas, shards), "leaves")
    runs = running_sum(leaves, "rank", ["shard"], F.col("quota"), "at").where("quota > 0")
    runs = runs.select("rank", "shard", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("quota"))).alias("draw"))
    dealt = draws.join(runs, ["rank", "draw"]).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    blocks = materialize(totals.select("rank", "block", "ahead").join(dealt, ["rank", "block"], "left"), "dealt")

    inside = Window.partitionBy("rank", "block").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["rank", "block"])
    partial = F.col("ahead") + F.col("inside") + F.col("size") / 2 <= F.col("part")
    times = F.col("passes") + partial.cast("long")
    mine = F.transform(F.filter(F.coalesce("dealt", F.array().cast("array<struct<copy:bigint,shard:bigint>>")), lambda d: d["copy"] < times), lambda d: d["shard"])
    rows = rows.withColumn("shards", mine)
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards", *[F.col(f"`__{c}`") for c in keep or []])


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_col: str = "shard", copy_col: str = "copy", **options) -> DataFrame:
    """The mixture itself: the input's columns, a row for each copy, dealt to shards and shuffled there.

    Two columns are added, and take the place of any of their name.
    """
    own = [c for c in docs.columns if c.lower() not in (shard_col.lower(), copy_col.lower())]
    key, places = fresh("_key", docs), fresh("_places", docs)
    plan = lambda rows, keep=None: plan_mix(rows, id_col=id_col, source_col=source_col, text_col=text_col, keep=keep, **options)
    narrow = materialize(plan(docs.select(*{id_col: 0, source_col: 0, text_col: 0})).select(F.col(id_col).alias(key), F.col("shards").alias(places)), "shards")
    head = narrow.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids")).first()
    if head["n"] == head["ids"]:  # each id once: texts don't go through the plan
        planned = docs.join(beside_wide_rows(narrow, head["n"]), F.col(id_col) == F.col(key))
        copies = planned.select(*[F.col(f"`{c}`") for c in own], F.posexplode(places).alias(copy_col, shard_col))
    else:
        planned = plan(docs, own)
        copies = planned.select(*[F.col(f"`__{c}`").alias(c) for c in own], F.posexplode("shards").alias(copy_col, shard_col))
    order = F.xxhash64(F.lit(SEED + 1), F.col(shard_col), F.col(id_col), F.col(copy_col))
    return copies.repartition(shard_col).sortWithinPartitions(shard_col, order)
