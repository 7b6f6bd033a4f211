"""Byte-level BPE encoding and decoding with a local rank file.

The merges are those of the ``tiktoken`` library on a rank file in its own text
format; nothing is trained.  A long text is handed over in parts that are cut
only where the split pattern begins a new match whatever surrounds it: before a
space or line feed that follows a printable ASCII character.  Very long runs of
white space, which the pattern engine cannot take, are split by the pattern's
own rule for them.  Ids decode to raw bytes, never to text, so a token that ends
inside a character does no harm.

Defined results: a null text is encoded as the empty one (no ids); texts that
repeat are encoded each time; an empty table gives an empty result; further
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters after which a text is cut at the next safe boundary.
PART = 1 << 16
#: White-space runs of at least so many characters are split here and not by the pattern engine.
LONG_RUN = 1 << 10

# The characters with the Unicode property White_Space.
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")
_SAFE = re.compile(r"(?<=[!-~])[ \n]")

_loaded: dict = {}


def load(rank_bytes: bytes, pattern: str):
    """The encoding of a rank file's content, kept for the life of the worker."""
    import tiktoken

    key = (hashlib.sha256(rank_bytes).digest(), pattern)
    if key not in _loaded:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines())}
        _loaded[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = _SAFE.search(text, at + PART)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def encode(encoding, text: str) -> list[int]:
    """Ids of the whole text, as the library gives them for it in one piece."""
    ids: list[int] = []
    at = 0
    if len(text) >= LONG_RUN:
        for run in _RUN.finditer(text):
            # a run before a non-space gives up its last character, the rest is one match
            end = run.end() - 1 if run.end() < len(text) else run.end()
            for part in _parts(text[at : run.start()]):
                ids += encoding.encode_ordinary(part)
            ids += encoding._encode_single_piece(text[run.start() : end].encode())
            at = end
    for part in _parts(text[at:] if at else text):
        ids += encoding.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns the id column, ``n_tokens`` long, ``ids_sha256`` and
    ``decoded_sha256`` (lower-case hex, of the ids as little-endian unsigned
    32-bit integers and of the decoded bytes) and, if ``with_ids``, ``ids``
    array<int>.  One pass, no shuffle; a task holds one record batch.

    The rank file (about a megabyte) is read once on the driver and travels with
    the task, so that executors need no copy of it.
    """
    with open(rank_file, "rb") as f:
        rank_bytes = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(rank_bytes, pattern)
        for batch in batches:
            n, ids_hex, out_hex, ids_all = [], [], [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                ids = encode(encoding, raw)
                packed = np.array(ids, dtype="<u4")
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(packed.tobytes()).hexdigest())
                out_hex.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
                if with_ids:
                    ids_all.append(packed.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(out_hex, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids_all, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = docs.select(id_col, text_col)
    fields = [T.StructField(id_col, picked.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return picked.mapInArrow(run, T.StructType(fields))
