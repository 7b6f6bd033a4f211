"""String metrics as native column expressions: no Python in the tasks.

All return a share from 0 to 1.  ``ratio`` is the indel similarity
``2 * LCS / (|a| + |b|)``; the longest common subsequence is counted by bit
parallelism, one step for each character of ``a`` on the match bits of ``b``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of ``b`` that fit in the bits of one number; longer names use rows of numbers.
WORD_BITS = 62


def chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    none = F.lit(0).cast("long")

    def by_bits(v: Column) -> Column:
        full = v["full"]
        # The places of a letter of a in b, as bits.
        match = lambda ch: F.aggregate(v["places"], none, lambda m, j: F.when(F.get(v["cb"], j) == ch, m.bitwiseOR(bit(j))).otherwise(m))
        step = lambda s, m: (s + s.bitwiseAND(m)).bitwiseOR(s - s.bitwiseAND(m)).bitwiseAND(full)
        return F.aggregate(F.transform(v["ca"], match), full, step, lambda s: F.bit_count(full.bitwiseXOR(s)).cast("int"))

    def by_rows(v: Column) -> Column:
        def row(before: Column, ch: Column) -> Column:
            cell = lambda new, j: F.when(F.get(v["cb"], j) == ch, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(new, -1)))
            return F.aggregate(v["places"], F.array(F.lit(0)), lambda new, j: F.array_append(new, cell(new, j)))

        return F.aggregate(v["ca"], F.array_repeat(F.lit(0), F.size(v["cb"]) + 1), row, lambda r: F.element_at(r, -1))

    n = F.length(b)
    parts = F.struct(chars(a).alias("ca"), chars(b).alias("cb"), F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1).alias("places"), (bit(F.least(n, F.lit(WORD_BITS))) - 1).alias("full"))
    return F.when((F.length(a) == 0) | (n == 0), F.lit(0)).when(a == b, n).otherwise(let(parts, lambda v: F.when(F.size(v["cb"]) <= WORD_BITS, by_bits(v)).otherwise(by_rows(v))))


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Common tokens against what either side has besides, best of the three readings."""

    def of_sets(v: Column) -> Column:
        x, y = v["x"], v["y"]
        only = lambda p, q: _joined(F.array_sort(F.array_except(p, q)))
        rest = F.struct(x.alias("x"), y.alias("y"), F.length(_joined(F.array_intersect(x, y))).alias("s"), only(x, y).alias("only_x"), only(y, x).alias("only_y"))
        return let(rest, of_rest)

    def of_rest(v: Column) -> Column:
        s, lx, ly = v["s"], F.length(v["only_x"]), F.length(v["only_y"])
        gap = F.when(s > 0, 1).otherwise(0)
        distance = lx + ly - 2 * lcs_length(v["only_x"], v["only_y"])
        first = 1.0 - distance / F.greatest(F.lit(1), (s + gap + lx) + (s + gap + ly))
        second = F.when(s > 0, 1.0 - (gap + lx) / F.greatest(F.lit(1), s + s + gap + lx)).otherwise(0.0)
        third = F.when(s > 0, 1.0 - (gap + ly) / F.greatest(F.lit(1), s + s + gap + ly)).otherwise(0.0)
        nothing = (F.size(v["x"]) == 0) | (F.size(v["y"]) == 0)
        return F.when(nothing, F.lit(0.0)).when((s > 0) & ((lx == 0) | (ly == 0)), F.lit(1.0)).otherwise(F.greatest(first, second, third))

    words = lambda c: F.array_sort(F.array_distinct(tokens(c)))
    return let(F.struct(words(a).alias("x"), words(b).alias("y")), of_sets)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(_joined(F.array_sort(tokens(a))), _joined(F.array_sort(tokens(b))))


def field_name(s: Column) -> Column:
    """A column name as compared with target fields: no leading underscores, lower case, spaces."""
    return F.trim(F.replace(F.lower(F.regexp_replace(s, "^_+", "")), F.lit("_"), F.lit(" ")))


def field_similarity(source: Column, target: Column) -> Column:
    """The better of plain and token-set ratio of two names."""
    a, b = field_name(source), field_name(target)
    return F.greatest(ratio(a, b), token_set_ratio(a, b))
