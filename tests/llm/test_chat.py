"""Chat formatting against plain Python, with exact reading back."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyframe.llm import chat

CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<|text|>", "<|image|>", "<|other|>", "\\", "<", "[", "%0A", "%25", "\n", "s>", "é😀", "INST]", "/s>", " "]
ROWS = "conv_id long, turn long, role string, text string, formatted string, turns string, _told string"


def tangled(rng, n):
    return "".join(rng.choice(CONTROLS) for _ in range(n))


def digests(rows):
    by = defaultdict(list)
    for i, (conv, turn, role, text, *_) in enumerate(rows):
        by[(conv, None if conv is not None else i)].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for (conv, _), turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def test_plain_conversations_read_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", tangled(rng, 4)]), rng.choice([None, "", tangled(rng, rng.randint(1, 30))]), "x", "y", "z") for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, 1, "assistant", "same", "", "", "")] * 3 + [(100, None, "user", "first", "", "", "")]
    rows += [(None, 1, "assistant", "alone", "", "", ""), (None, 1, "user", "alone", "", "", "")]
    rows += [(101, 0, "assistant", "<s>" * 60_000 + "\\" * 60_000 + "[" * 60_000, "", "", "")]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = chat.format_and_read_back(df).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == digests(rows)
    assert chat.format_and_read_back(df.limit(0)).count() == 0


def test_no_control_string_stands_in_a_text(spark):
    rng = random.Random(4)
    texts = [tangled(rng, 12) for _ in range(400)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in CONTROLS[:7])


def test_loss_spans_are_places_in_the_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi <s>"), (1, 1, "assistant", "[INST] é"), (1, 2, "user", ""), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(rows).first()
    spans = [(t.loss_start, t.loss_length) for t in r.turns if t.loss_start is not None]
    assert [r.formatted[a : a + n] for a, n in spans] == ["[\\INST] é", ""]
    assert "".join(r.formatted[t.start : t.start + t.length] for t in r.turns) == r.formatted


def test_parts_are_visited_in_order(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [part("text", "see <|image|>"), part("image", ref="a.png", w=100, h=57), part("text", ""), part("audio", ref="b.wav", s=2.01), part("document", ref="c.pdf", p=3), part("video", ref="d"), None, part("image", w=-5)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [part("text", "a")]), (1, 2, "user", None), (1, 3, "user", []), (1, 4, "user", [part("image", ref="e", w=1, h=1)])]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>"), parts_col="parts")
    row = r.first()
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "a.png", 12), (0, 3, "audio", "b.wav", 51), (0, 4, "document", "c.pdf", 3000), (0, 5, "other", "d", 0), (0, 6, "other", None, 0), (0, 7, "image", None, 0), (4, 0, "image", "e", 1)]
    assert row.expanded_tokens == 3064
    back = r.select(F.transform(chat.read_turns(F.col("formatted")), lambda t: chat.read_parts(t["content"])).alias("p")).first().p
    assert [[(p.type, p.text) for p in turn] for turn in back] == [
        [("text", "see <|image|>"), ("image", None), ("text", ""), ("audio", None), ("document", None), ("other", None), ("other", None), ("image", None)],
        [("text", "a")], [("text", "")], [("text", "")], [("image", None)],
    ]
    said = spark.createDataFrame([("hello",), ('[{"type":"text","text":"a"},{"type":"image","ref":"x","width":5}]',), ("[no list",), (None,), ("[1]",)], "c string").select(chat.parts_of(F.col("c")).alias("p")).collect()
    assert [[(p.type, p.text, p.ref) for p in r.p] for r in said] == [[("text", "hello", None)], [("text", "a", None), ("image", None, "x")], [("text", "[no list", None)], [("text", "", None)], [("text", "[1]", None)]]
