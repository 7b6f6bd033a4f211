"""Delimited extracts: separator detection and scans in which every cell is text.

Files are read as physical lines, so any file is split into blocks, even where
quoted cells hold line feeds.  Whether a line begins inside a quoted cell depends
on all lines before it, but a line (and so a block of lines) is only a function of
two states: where it ends if it begins outside, and where if it begins inside.
Such functions compose, so one pass tells each block's function, a running
composition over the blocks (one row each) tells where each begins, and a second
pass cuts every block into records by itself.  Only records that cross a block's
edge are put together by a shuffle.  Files without an open quote at any line's
end take no second pass.

Cells follow the usual rules of quoting: a cell that begins with a quote runs to
the next single quote, two quotes inside stand for one, what follows the closing
quote belongs to the cell as it is, and a quote inside an unquoted cell is a
character like any other.  A backslash has no meaning.  A quote that is never
closed runs to the end of its file, less the last line feed.  Blank lines are rows
of empty cells.  Line feeds, alone or after a carriage return, end lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import new_folder

#: Blocks whose starting state may be broadcast; beyond it lines are dealt by block and sorted.
BROADCAST_BLOCKS = 200_000


def separator(first_line: Column, path: Column) -> Column:
    """Two pipes or more decide, else two commas or more, else the file's ending."""
    count = lambda ch: F.length(first_line) - F.length(F.replace(first_line, F.lit(ch), F.lit("")))
    return F.when(count("|") >= 2, "|").when(count(",") >= 2, ",").when(F.lower(path).endswith(".dat"), "|").otherwise(",")


def physical_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, pos, value): lines without their line feed, in file order by block and pos."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")


def detect(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, first_line, sep) of each file.

    Only the blocks that begin a file are looked at, and of each the first line
    is kept by a partial minimum inside its task.
    """
    first = physical_lines(spark, paths).where("block = 0").groupBy("path").agg(F.min_by("value", "pos").alias("first_line"))
    return first.withColumn("sep", separator(F.col("first_line"), F.col("path")))


class _Grammar:
    """Patterns of one separator; every repetition is possessive, so lines of any length take linear time."""

    def __init__(self, sep: str):
        if len(sep) != 1 or sep in '"\r\n':
            raise ValueError("the separator is one character, no quote and no line end")
        s = "\\" + sep if re.match(r"[^\w\s]", sep) else sep
        inside, rest = '(?:[^"]++|"")*+', f"[^{s}]*+"
        cell = f'(?:"{inside}"{rest}|[^"{s}]{rest}|)'
        begun = f'(?:{cell}{s})*+"{inside}\\z'
        self.opens = f"(?s)^{begun}"
        self.stays = f'(?s)^{inside}(?:\\z|"{rest}{s}{begun})'
        self.cells = f'(?s){s}("{inside}(?:"{rest}|\\z)|[^"{s}]{rest}|)(?={s}|\\z)'
        self.quoted = f'(?s)^"({inside})'
        self.after = f'(?s)^"{inside}"(.*)\\z'


def _states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends inside a quoted cell, given what it does from either state and where the first begins."""
    at = np.arange(len(opens))
    fixed = opens == stays
    last = np.maximum.accumulate(np.where(fixed, at, -1))
    swaps = np.cumsum(~fixed & opens)
    base = np.where(last >= 0, opens[last], inside)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, block, first row, end) of the stretches of a batch that belong to one block."""
    path, block = batch.column("path").dictionary_encode(), np.asarray(batch.column("block"))
    code = np.asarray(path.indices)
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if b > a:
            yield path.dictionary[int(code[a])].as_py(), int(block[a]), a, b


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).cast(pa.uint8())).astype(bool)


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, pos, opens, stays, start_out, start_in) of each stretch: its function, and where its last record starts from either state."""
    rows = []
    for batch in batches:
        pos, opens, stays = np.asarray(batch.column("pos")), _flags(batch, "opens"), _flags(batch, "stays")
        for path, block, a, b in _runs(batch):
            row = [path, block, int(pos[a])]
            starts = []
            for inside in (False, True):
                ends = _states(opens[a:b], stays[a:b], inside)
                begun = np.flatnonzero(~np.concatenate([[inside], ends[:-1]]))
                row.append(bool(ends[-1]))
                starts.append(int(pos[a + begun[-1]]) if len(begun) else None)
            rows.append((*row, *starts))
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["path", "block", "pos", "opens", "stays", "start_out", "start_in"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def block_starts(lines: DataFrame) -> DataFrame:
    """(path, block, from_block, from_pos): blocks that begin inside a quoted cell, and where that record starts.

    ``lines`` has ``opens`` and ``stays``.  A block's stretches and a file's blocks
    compose in order; there is one row for each.
    """
    parts = lines.select("path", "block", "pos", "opens", "stays").mapInArrow(_block_functions, "path string, block long, pos long, opens boolean, stays boolean, start_out long, start_in long")
    order = Window.partitionBy("path").orderBy("block", "pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum(F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)).over(upto)
    rows = parts.withColumn("swaps", swaps)
    fixed = F.when(F.col("opens") == F.col("stays"), F.struct("opens", "swaps"))
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(upto))
    ends = F.coalesce(F.col("fixed.opens"), F.lit(False)) != ((F.col("swaps") - F.coalesce(F.col("fixed.swaps"), F.lit(0))) % 2 == 1)
    rows = rows.withColumn("ends", ends).withColumn("inside", F.coalesce(F.lag("ends").over(order), F.lit(False)))
    start = F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out"))
    rows = rows.withColumn("start", F.when(start.isNotNull(), F.struct(F.col("block").alias("b"), start.alias("p"))))
    rows = rows.withColumn("carried", F.last("start", ignorenulls=True).over(before))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "block").orderBy("pos"))).where("n = 1 and inside")
    return first.select("path", "block", F.col("carried.b").alias("from_block"), F.col("carried.p").alias("from_pos"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block, those that its edges leave open as pieces under the place of their first line."""
    now: tuple[str, int] | None = None
    inside, start, held = False, (0, 0), []

    def row(path: str, block: int, first: int, lines: list[str], whole: bool) -> tuple:
        return (path, *start, block, first, "\n".join(lines), whole)

    for batch in batches:
        out: list[tuple] = []
        value, pos = batch.column("value"), np.asarray(batch.column("pos"))
        opens, stays = _flags(batch, "opens"), _flags(batch, "stays")
        for path, block, a, b in _runs(batch):
            if now != (path, block):
                if held:
                    out.append(row(*now, held[0][0], [h[1] for h in held], False))
                now, held, crossed = (path, block), [], batch.column("from_block")[a].as_py()
                inside = crossed is not None
                broken = inside
                if inside:
                    start = (crossed, batch.column("from_pos")[a].as_py())
            ends = _states(opens[a:b], stays[a:b], inside)
            for k, (end, text) in enumerate(zip(ends.tolist(), value[a:b].to_pylist(), strict=True)):
                if not inside:
                    start, broken = (block, int(pos[a + k])), False
                held.append((int(pos[a + k]), text))
                if not end:
                    out.append(row(path, block, held[0][0], [h[1] for h in held], not broken))
                    held = []
                inside = end
        if out:
            yield _records(out)
    if held:
        yield _records([row(*now, held[0][0], [h[1] for h in held], False)])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "block", "pos", "at_block", "at_pos", "record", "whole"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _end(record: Column) -> Column:
    """A record without the carriage return that belongs to its line's end."""
    return F.regexp_replace(record, r"\r\z", "")


def records(spark: SparkSession, paths: list[str], sep: str) -> tuple[DataFrame, DataFrame]:
    """(path, block, pos, record): the records of files, line feeds inside quoted cells kept; the place is that of the first line.

    The second table holds those among them that begin in a file's first block.
    """
    g = _Grammar(sep)
    has = F.instr("value", '"') > 0
    # A line without a quote keeps the state it begins in.
    lines = physical_lines(spark, paths).withColumn("opens", has & F.col("value").rlike(g.opens)).withColumn("stays", ~has | F.col("value").rlike(g.stays))
    if lines.where("opens").isEmpty():
        plain = lines.select("path", "block", "pos", _end(F.col("value")).alias("record"))
        return plain, plain.where("block = 0")
    folder = new_folder(spark, "blocks")
    block_starts(lines).write.parquet(folder)
    starts = spark.read.parquet(folder)
    if starts.count() <= BROADCAST_BLOCKS:
        placed = lines.join(F.broadcast(starts), ["path", "block"], "left")  # keeps the lines' order
    else:
        placed = lines.join(starts, ["path", "block"], "left").repartition("path", "block").sortWithinPartitions("path", "block", "pos")
    placed = placed.select("path", "block", "pos", "opens", "stays", "from_block", "from_pos", "value")
    return _whole(placed), _whole(placed.where("block = 0 or from_block = 0")).where("block = 0")


def _whole(placed: DataFrame) -> DataFrame:
    """Records of lines whose blocks' starts are known."""
    cut = placed.mapInArrow(_cut, "path string, block long, pos long, at_block long, at_pos long, record string, whole boolean")
    pieces = F.array_sort(F.collect_list(F.struct("at_block", "at_pos", "record")))
    crossing = cut.where("not whole").groupBy("path", "block", "pos").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    return cut.where("whole").select("path", "block", "pos", "record").unionByName(crossing).withColumn("record", _end(F.col("record")))


def cells(record: Column, sep: str) -> Column:
    """The cells of a record as an array of texts; an empty record has none."""
    g = _Grammar(sep)
    listed = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(g.cells), 1)  # each cell with the separator before it
    plain = lambda c: F.concat(F.replace(F.regexp_extract(c, g.quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, g.after, 1))
    quoted = F.transform(listed, lambda c: F.when(c.startswith('"'), plain(c)).otherwise(c))
    return F.when(record == "", F.array().cast("array<string>")).when(F.instr(record, '"') == 0, F.split(record, f"\\Q{sep}\\E")).otherwise(quoted)


def _names(header: list[str]) -> list[str]:
    """Column names: trimmed, empty ones by their place, repeated ones with their place."""
    trimmed = [h.strip() for h in header]
    return [f"_c{i}" if h == "" else f"{h}{i}" if trimmed.count(h) > 1 else h for i, h in enumerate(trimmed)]


def _scan(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """Files of one separator, a projection for each distinct header."""
    rows, begin = records(spark, paths, sep)
    first = begin.groupBy("path").agg(F.min_by(F.struct("block", "pos", "record"), F.struct("block", "pos")).alias("f"))
    headers = first.select("path", "f.pos", cells(F.col("f.record"), sep).alias("header"))
    # One row for each file, as the file listing itself; one group for each distinct header.
    groups: dict[tuple, list] = {}
    for r in headers.orderBy("path").collect():
        groups.setdefault(tuple(_names(r["header"])), []).append((r["path"], r["pos"]))
    out = None
    for names, files in groups.items():
        own = rows if len(groups) == 1 else rows.join(F.broadcast(spark.createDataFrame([(p,) for p, _ in files], "path string")), "path")
        heads = F.broadcast(spark.createDataFrame([(p, 0, n) for p, n in files], "path string, block long, pos long"))
        listed = own.join(heads, ["path", "block", "pos"], "left_anti").select(cells(F.col("record"), sep).alias("c"))
        part = listed.select([F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.range(0).select()


def read(spark: SparkSession, path: str | list[str], *, sep: str | None = None, table_name: str | None = None) -> DataFrame:
    """Files with headers as text columns, names trimmed; files of each separator are scanned with theirs.

    Files of different separators or headers are united by name, columns that some
    lack filled with the empty string.  ``sep`` overrides the detection and
    ``table_name`` adds a column of that name.  Short rows are filled with the
    empty string and long ones cut; blank lines are rows.  Of repeated header names
    each gets a column of its own.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if sep is not None:
        groups = [(sep, paths)]
    else:  # two separators at most, and a list of file names
        groups = [(r["sep"], r["files"]) for r in detect(spark, paths).groupBy("sep").agg(F.sort_array(F.collect_list("path")).alias("files")).orderBy("sep").collect()]
        groups = [(groups[0][0], paths)] if len(groups) == 1 else groups
    out = None
    for separator_, files in groups:
        part = _scan(spark, files, separator_)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    out = out.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns])
    return out if table_name is None else out.withColumn("table_name", F.lit(table_name))
