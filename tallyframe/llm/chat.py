"""Chat formatting with typed content parts.

A conversation's rows become one text in a template with turn marks, and can be
read back exactly.  A turn's content is a list of parts: texts, images, audio,
documents.  A visitor flattens them in order: each kind of part has a method that
gives its placeholder and its token count, and every attachment is recorded with
its place, turn, kind, reference and tokens.

Template: ``[INST]`` role, line feed, content ``[/INST]`` for a turn that is not
learned, ``<s>`` content ``</s>`` for an assistant's.  A lone text part stands as
it is; of other lists each part begins with its mark (``<|text|>``, ``<|image|>``,
``<|audio|>``, ``<|document|>``, ``<|other|>``).  A control string inside a text
gets a backslash after its first character, and one that already has some gets one
more; so no text holds a control string, and taking one away gives the text back.

All is native expressions: one shuffle by conversation, whose window gives every
turn its start in the text and whose groups are joined.

Defined results: a null text is empty, a null role the empty role; a null list of
parts, or an empty one, is one empty text; a null part or one of an unknown kind
is ``<|other|>`` with 0 tokens, its reference kept; a null or negative size counts
as 0.  Turns go by turn (null first), then role, text and parts; rows that repeat
are turns of their own.  Rows with a null conversation belong to none and are
each formatted alone.  A conversation is one row of the result, however long
(a digest of all its turns is asked for), so the largest one bounds a task.  An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LEARNED = "assistant"

# Marks of the template and of parts.
OPEN, CLOSE, OPEN_LEARNED, CLOSE_LEARNED = "[INST]", "[/INST]", "<s>", "</s>"
KINDS = ["text", "image", "audio", "document", "other"]

_CONTROL = r"(\[(?=\\*+/?INST\])|<(?=\\*+(?:/?s|\|(?:text|image|audio|document|other)\|)>))"
_ESCAPED = r"(\[(?=\\++/?INST\])|<(?=\\++(?:/?s|\|(?:text|image|audio|document|other)\|)>))\\"
_MARK = r"<\|(?:text|image|audio|document|other)\|>"


def escape(text: Column) -> Column:
    """A backslash more after the first character of each control string, plain or escaped before."""
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def _size(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))


@dataclass(frozen=True)
class Visitor:
    """Token counts of attachments: a method for each kind of part, called with the part.

    Images count a token for each ``patch`` by ``patch`` pixels begun, audio
    ``per_second`` tokens a second, documents ``per_page`` a page.
    """

    patch: int = 28
    per_second: int = 25
    per_page: int = 1000

    def image(self, part: Column) -> Column:
        return F.ceil(_size(part["width"]) / self.patch) * F.ceil(_size(part["height"]) / self.patch)

    def audio(self, part: Column) -> Column:
        seconds = F.coalesce(F.nanvl(part["seconds"], F.lit(0.0)), F.lit(0.0))
        return F.ceil(F.greatest(seconds, F.lit(0.0)) * self.per_second)

    def document(self, part: Column) -> Column:
        return _size(part["pages"]) * self.per_page

    def other(self, part: Column) -> Column:
        return F.lit(0)

    def methods(self) -> Mapping[str, Callable[[Column], Column]]:
        return {k: getattr(self, k) for k in KINDS if k != "text"}

    def kind(self, part: Column) -> Column:
        return F.when(part["type"].isin(KINDS), part["type"]).otherwise("other")

    def content(self, parts: Column) -> Column:
        """The flattened text of a list of parts."""
        texts = F.transform(parts, lambda p: F.concat(F.lit("<|"), self.kind(p), F.lit("|>"), F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise("")))
        lone = (F.size(parts) == 1) & (F.get(parts, F.lit(0))["type"] == "text")
        return F.when(F.size(parts) == 0, "").when(lone, escape(F.coalesce(F.get(parts, F.lit(0))["text"], F.lit("")))).otherwise(F.array_join(texts, ""))

    def attachments(self, parts: Column) -> Column:
        """The parts that are no texts: place in the list, kind, reference, tokens."""

        def tokens(p: Column) -> Column:
            out = F.lit(0).cast("long")
            for kind, method in self.methods().items():
                out = F.when(self.kind(p) == kind, method(p).cast("long")).otherwise(out)
            return out

        seen = F.transform(parts, lambda p, i: F.struct(i.alias("place"), self.kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
        return F.filter(seen, lambda p: p["kind"] != "text")


def parts_of(content: Column) -> Column:
    """Parts of a message's content: a JSON list of typed parts, or a plain text (anything else), which is one text part."""
    listed = F.from_json(content, f"array<{PART}>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.coalesce(content, F.lit("")).alias("text"))), PART))
    return F.when(content.rlike(r"^\s*\[\s*(\{|\])") & listed.isNotNull() & ~F.exists(listed, lambda p: p["type"].isNull()), listed).otherwise(plain)


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, visitor: Visitor | None = None) -> DataFrame:
    """One row for each conversation.

    ``formatted``; ``turns``: start and length of each turn and the span in it that
    is learned (``loss_start``, ``loss_length``, null for others), in code points
    from 0; ``attachments``: turn, place, kind, ref, tokens; ``expanded_tokens``:
    their sum.  With ``parts_col`` (an array of :data:`PART`) the content is those
    parts, else the text.
    """
    visitor = visitor or Visitor()
    conv = F.col(f"`{conv_col}`")
    role = F.coalesce(F.col(f"`{role_col}`"), F.lit(""))
    nothing = F.array().cast(f"array<{PART}>")
    if parts_col is None:
        content, attached, key = escape(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), visitor.attachments(nothing), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    else:
        parts = F.coalesce(F.col(f"`{parts_col}`").cast(f"array<{PART}>"), nothing)
        content, attached, key = visitor.content(parts), visitor.attachments(parts), F.to_json(parts)
    learned = role == LEARNED
    piece = F.when(learned, F.concat(F.lit(OPEN_LEARNED), content, F.lit(CLOSE_LEARNED))).otherwise(F.concat(F.lit(OPEN), _role_out(role), F.lit("\n"), content, F.lit(CLOSE)))
    turns = rows.select(conv.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), key.alias("key"), piece.alias("piece"), attached.alias("attached"), learned.alias("learned"))
    turns = turns.withColumn("length", F.length("piece").cast("long"))
    order = ["turn", "role", "key"]
    # A conversation's window and its group need one dealing of the rows.
    place = Window.partitionBy("conv").orderBy(*order)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    kept = turns.where("conv is not null").withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))).withColumn("number", F.row_number().over(place) - 1)
    item = F.struct("start", "number", "piece", "length", "learned", "attached")
    grouped = kept.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("items"))
    alone = turns.where("conv is null").withColumn("start", F.lit(0).cast("long")).withColumn("number", F.lit(0)).select("conv", F.array(item).alias("items"))
    both = grouped.unionByName(alone)
    mark, end = len(OPEN_LEARNED), len(CLOSE_LEARNED)
    spans = F.transform("items", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), F.when(t["learned"], t["start"] + mark).alias("loss_start"), F.when(t["learned"], t["length"] - mark - end).alias("loss_length")))
    seen = F.flatten(F.transform("items", lambda t: F.transform(t["attached"], lambda p: F.struct(t["number"].alias("turn"), p["place"].alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    out = both.select(F.col("conv").alias(conv_col), F.array_join(F.transform("items", lambda t: t["piece"]), "").alias("formatted"), spans.alias("turns"), seen.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without its closing mark."""
    return F.filter(F.split(formatted, r"\[/INST\]|</s>"), lambda p: p != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, content>>: the turns of a formatted conversation, contents still escaped."""

    def turn(p: Column) -> Column:
        learned = p.startswith(OPEN_LEARNED)
        body = F.substr(p, F.when(learned, len(OPEN_LEARNED) + 1).otherwise(len(OPEN) + 1))
        head = F.substring_index(body, "\n", 1)
        return F.struct(F.when(learned, LEARNED).otherwise(_role_in(head)).alias("role"), F.when(learned, body).otherwise(F.substr(body, F.length(head) + 2)).alias("content"))

    return F.transform(pieces(formatted), turn)


def read_parts(content: Column) -> Column:
    """array<struct<type, text>>: the parts of a turn's content; the text of an attachment is null."""
    kinds = F.transform(F.regexp_extract_all(content, F.lit(_MARK), 0), lambda m: F.regexp_extract(m, r"\w+", 0))
    texts = F.split(content, _MARK)
    part = lambda kind, text: F.struct(kind.alias("type"), F.when(kind == "text", unescape(text)).alias("text"))
    listed = F.transform(kinds, lambda k, i: part(k, F.get(texts, i + 1)))
    return F.when(F.size(kinds) == 0, F.array(part(F.lit("text"), content))).otherwise(listed)


def loss_text(formatted: Column, turns: Column) -> Column:
    """The learned text: what lies under the loss spans, unescaped, in order, nothing between."""
    under = F.zip_with(pieces(formatted), turns, lambda p, t: F.when(t["loss_start"].isNull(), "").otherwise(unescape(F.substr(p, (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int")))))
    return F.array_join(under, "")


def format_and_read_back(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format plain conversations, write them, and digest what is read back: one row for each."""
    written = materialize(format_conversations(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "chats")
    told, learned = fresh("_told", written), fresh("_learned", written)
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n"))), "")
    back = written.withColumn(told, said).withColumn(learned, loss_text(F.col("formatted"), F.col("turns")))
    return back.select(
        F.col(f"`{conv_col}`"),
        F.size(pieces(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
