"""Secret scan with a random forest against false positives.

Candidates are runs of 16 or more of the characters of keys and tokens that hold
a letter and a digit, and values of 8 or more that are assigned to a name like
``password``; where they overlap the one that begins first counts.  Each is described by its length, its character transitions (changes
between lower case, upper case, digits and the rest), its dictionary coverage (the
share of it that is made of words which the corpus itself uses), the path or url
it stands in, and the words around it.  A random forest, trained from labelled
findings, gives the probability that it is a secret.

Dictionary.  The letter runs of the candidates are counted as words over all
texts; those that at least ``DICTIONARY_DOCS`` documents use are dictionary words.

Labelled findings are a table (text, label): the candidates of a text bear its
label.  :func:`scan` takes one, and without it uses :func:`labelled_findings`,
which are our own: the contexts below filled with values of known kinds.  Contexts
of one group in five are held out of training, for a measure of precision and
recall (see the README).  The forest decides alone; no rule labels the corpus.

Only DataFrame functions and Spark's own random forest run.

Defined results: a null or empty text has no findings and so no row; repeated
rows give repeated findings; a null id is kept as null; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, literal_table, materialize, shared_dir

DICTIONARY_DOCS = 2
THRESHOLD = 0.5

_CHARS = r"[A-Za-z0-9_+/=\-]"
_RUN = _CHARS + "{16,}+"
_NAME = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|bearer|credential|private[_\-]?key|client[_\-]?secret)"
_DIGEST = r"(?i)(?:sha\d*|md5|commit|digest|checksum|hash|etag|uuid|guid|revision|build|version|integrity|fingerprint)"
#: A whole identifier that holds a secret's name, and the sign that gives it a value.  It begins only where an
#: identifier does and takes every run as a whole, so no run is read more than twice and none needs a bound.
_GIVEN = rf"(?<![A-Za-z0-9_\-])(?=[A-Za-z0-9_\-]*?{_NAME})[A-Za-z0-9_\-]++[\"']?\s*+[:=]++\s*+[\"']?"
_VALUE = r"[^\s\"'<>,;]{8,}+"
_ASSIGNED = rf"{_GIVEN}({_VALUE})"
_LEAD = r"^[\"']?[:=]*+[\"']?"

#: Contexts of findings: (what stands around the value, is it a secret, kinds of values that stand there).
CONTEXTS: list[tuple[str, int, str]] = [
    ('the token = "{}" of it', 1, "hex40 key32 mixed24"), ('token="{}"', 1, "hex40 key32 mixed24"), ("token: {} was sent", 1, "hex40 hex32 mixed24"), ('"token": "{}",', 1, "hex40 mixed24"), ("a token = '{}' in the text", 1, "hex40 key32"),
    ("api_key: {}", 1, "hex32 key32 mixed24"), ("API_KEY={}", 1, "key32 mixed24"), ("api-key = {} here", 1, "hex32 mixed24"), ("secret: {}", 1, "hex40 key32 mixed24"), ('client_secret = "{}"', 1, "key32 mixed24"),
    ("password = {}", 1, "mixed12 mixed24"), ('password: "{}" please', 1, "mixed12 mixed24"), ("export AUTH_TOKEN={}", 1, "key32 mixed24 hex40"), ("Authorization: Bearer {}", 1, "key32 mixed24"), ("access_key = {}", 1, "mixed24 key32"),
    ("aws secret {}", 1, "key32"), ("passwd={}", 1, "mixed12"), ("private_key: {}", 1, "key32"), ("bearer {}", 1, "hex40 key32"), ("my credential is secret = {}", 1, "mixed24 hex32"),
    ("commit {} merged", 0, "hex40"), ("sha1: {}", 0, "hex40"), ("md5 {} of the file", 0, "hex32"), ("checksum={}", 0, "hex32 hex40"), ("uuid {}", 0, "uuid"),
    ("id: {}", 0, "uuid number"), ("see /usr/share/doc/{}/examples for more", 0, "slug"), ("https://example.com/articles/{}", 0, "slug dated"), ("at src/main/java/{}", 0, "path"), ("version {}", 0, "slug release"),
    ("etag {}", 0, "hex40 hex32"), ("the class {}", 0, "camel"), ("called {} twice", 0, "snake"), ("{} is the page", 0, "slug dated"), ("/home/user/{}", 0, "path"),
    ("integrity sha512-{}", 0, "hex40 key32"), ("order {}", 0, "number"), ("password = {}", 0, "plain"), ("token = {}", 0, "plain"), ("secret: {}", 0, "plain"),
    ("api_key: {}", 0, "plain"), ("fingerprint {}", 0, "hex32 hex40"), ("isbn {}", 0, "number"), ("{}", 0, "rule slug camel snake"), ("digest = {}", 0, "hex40 hex32"),
    ("build {} passed", 0, "hex40 release"), ("revision {} of the page", 0, "hex40"), ("<a href=/{}>", 0, "path slug"), ("the word {} alone", 0, "camel slug"), ("phone {} or so", 0, "number"),
]
_WORDS = "user page order quarterly report project data result final release candidate config handler factory connection abstract sample module article list name value test write build email address service client server account number version archive image".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def example(kind: str, key: str) -> str:
    """A value of a kind, made from the digest of its key."""
    h = hashlib.sha512(f"{kind}:{key}".encode()).digest()
    w = [_WORDS[b % len(_WORDS)] for b in h[:6]]
    letters = lambda n: "".join(_ALNUM[b % 62] for b in h[:n])
    return {
        "hex40": h.hex()[:40], "hex32": h.hex()[:32], "key32": letters(32), "mixed24": f"{letters(11)}{'-_'[h[0] % 2]}{letters(23)[11:]}7", "mixed12": f"{letters(11)}{h[1] % 10}",
        "uuid": "-".join(h.hex()[i:j] for i, j in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))), "number": f"{int.from_bytes(h[:7]):017d}-x", "slug": f"{w[0]}-{h[0] % 90}-of-the-{w[1]}-{w[2]}", "dated": f"20{h[0] % 25:02d}/0{h[1] % 9 + 1}/{w[0]}-{w[1]}-{w[2]}",
        "path": f"{w[0]}/{w[1]}{h[0] % 9}/{w[2]}/{w[3]}", "camel": "".join(x.title() for x in w[:3]) + f"{h[0] % 9}{w[3].title()}", "snake": f"get_{w[0]}_{w[1]}_{w[2]}_v{h[0] % 9}", "release": f"{w[0]}-20{h[0] % 25:02d}-{w[1]}-{w[2]}", "plain": f"your-{w[0]}-goes-{w[1]}-{'here1' if h[0] % 2 else 'here'}", "rule": "=" * (16 + h[0] % 9) + "1" + "=" * 16,
    }[kind]


def labelled_findings(held_out: bool = False, copies: int = 8) -> list[tuple[str, int]]:
    """Our labelled findings (text, label): those for training, or those whose group of contexts is held out."""
    return [(context.format(example(kind, f"{n}-{k}-{held_out}")), label) for n, (context, label, kinds) in enumerate(CONTEXTS) if (n % 5 == 4) == held_out for kind in kinds.split() for k in range(copies)]


FEATURES = ["length", "changes", "lower_digit", "upper_lower", "digit_share", "upper_share", "vowel_share", "symbol_share", "hex_only", "distinct_share", "coverage", "in_path", "slashes", "named", "digest_near", "assigned", "quoted"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _mixed(run: Column) -> Column:
    return run.rlike("[A-Za-z]") & run.rlike("[0-9]")


def _values(word: Column) -> Column:
    """The candidates inside a word, from left to right and without overlap: assigned values, and mixed runs."""
    each = F.regexp_extract_all(word, F.lit(f"{_ASSIGNED}|{_RUN}"), F.lit(0))
    given = lambda m: F.regexp_extract(m, f"^{_ASSIGNED}", 1)
    return F.filter(F.transform(each, lambda m: F.when(given(m) != "", given(m)).when(_mixed(m), m)), lambda v: v.isNotNull())


def candidates(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per candidate: id, ``word_at`` (its word's number from 0), ``value``, and the words around it.

    Every pattern takes runs as a whole, and a word is looked at again only with
    the three that follow it, so the work is linear in the text, whatever it holds,
    and what is found of a secret doesn't depend on the rest of its text.
    """
    text = F.col(text_col)
    some = docs.where(F.exists(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), _mixed) | text.rlike(_ASSIGNED)).select(F.col(id_col).alias("id"), *keep, F.split(text, r"[\x20\x09-\x0D]+").alias("w"))
    at = lambda i: F.coalesce(F.try_element_at(F.col("w"), i), F.lit(""))
    near = lambda i: F.when(i >= 1, at(F.greatest(i, F.lit(1)))).otherwise(F.lit(""))

    def describe(word: Column, i: Column) -> Column:
        before = F.concat_ws(" ", near(i - 2), near(i - 1), near(i))
        lead = F.regexp_extract(word, _LEAD, 0)
        # a value that words before this one name
        named = F.concat_ws(" ", before, lead).rlike(_GIVEN + "$")
        first = F.when(named, F.regexp_extract(F.substr(word, F.length(lead) + 1), f"^{_VALUE}", 0)).otherwise(F.lit(""))
        rest = F.when(first == "", word).otherwise(F.substr(word, F.length(lead) + F.length(first) + 1))
        values = F.array_distinct(F.concat(F.filter(F.array(first), lambda v: v != ""), _values(rest)))
        return F.struct(i.alias("word_at"), word.alias("word"), before.alias("before"), near(i + 2).alias("after"), values.alias("found"))

    hit = lambda word: F.length(word) >= 8
    rows = some.select("id", *keep, F.inline(F.filter(F.transform("w", lambda word, i: F.when(hit(word), describe(word, i))), lambda s: s.isNotNull() & (F.size(s["found"]) > 0))))
    return rows.select("id", *keep, "word_at", "word", "before", "after", F.explode("found").alias("value"))


def _pieces(value: Column) -> Column:
    """The letter runs of a candidate of three and more, split where lower case turns to upper."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,}"), 0)


def dictionary(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those letter runs of the candidates that at least DICTIONARY_DOCS texts use as a word, over all texts."""
    pieces = materialize(found.select(F.explode(_pieces(F.col("value"))).alias("piece")).distinct(), "pieces")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![^\s\"'(])[a-z]{3,}(?![^\s\"'.,;:!?)])"), 0))).alias("piece"))
    used = words.join(broadcast_if_small(pieces, pieces.count()), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("docs"))
    return used.where(F.col("docs") >= DICTIONARY_DOCS).select("piece")


def describe(found: DataFrame, words: DataFrame) -> DataFrame:
    """Add the forest's features to candidates; ``words`` is the dictionary."""
    v = F.col("value")
    n = F.length(v).cast("double")
    covered = found.select("value").distinct().select("value", F.explode(_pieces(v)).alias("piece")).join(words, "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("covered"))
    rows = found.join(covered, "value", "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / n)).drop("covered")
    context = F.concat_ws(" ", "before", "word")
    changes = _count(v, "[a-z](?=[^a-z])|[A-Z](?=[^A-Za-z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])")
    return rows.select(
        "*",
        n.alias("length"),
        (changes / n).alias("changes"),
        (_count(v, "[a-z](?=[0-9])|[0-9](?=[a-z])") / n).alias("lower_digit"),
        (_count(v, "[A-Z](?=[a-z])") / n).alias("upper_lower"),
        (_count(v, "[0-9]") / n).alias("digit_share"),
        (_count(v, "[A-Z]") / n).alias("upper_share"),
        (_count(v, "[aeiouAEIOU]") / n).alias("vowel_share"),
        (_count(v, "[^A-Za-z0-9]") / n).alias("symbol_share"),
        v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double").alias("hex_only"),
        (F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0))).alias("distinct_share"),
        (F.col("word").rlike(r"://|^[./~]*/|\\\\|/[A-Za-z0-9_.\-]+/")).cast("double").alias("in_path"),
        _count(v, "/").alias("slashes"),
        context.rlike(_NAME).cast("double").alias("named"),
        context.rlike(_DIGEST).cast("double").alias("digest_near"),
        context.rlike(_ASSIGNED).cast("double").alias("assigned"),
        F.col("word").rlike("[\"']").cast("double").alias("quoted"),
    )


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest on described candidates with ``label``; deterministic in the set of rows."""
    rows = labelled.select(*FEATURES, "label")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=40, maxDepth=8, minInstancesPerNode=1, featureSubsetStrategy="onethird", seed=11)
    # written and read again: without the training summary, which holds the session, it can travel to tasks
    path = f"{shared_dir(labelled.sparkSession)}/forest-{uuid.uuid4().hex}"
    forest.fit(rows).write().save(path)
    return RandomForestClassificationModel.load(path)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row per finding: id, word_at, value, length, coverage, probability, is_secret.

    ``word_at`` is the number of its word in the text, from 0.
    """
    spark = docs.sparkSession
    given = labelled if labelled is not None else literal_table(spark, labelled_findings(), {"text": "string", "label": "int"})
    seeds = candidates(given.select(F.monotonically_increasing_id().alias("n"), "text", F.col("label").cast("double").alias("label")), "n", "text", "label").drop("id")
    found = materialize(candidates(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text"), "candidates")
    words = materialize(dictionary(found.select("value").unionByName(seeds.select("value")), docs, text_col), "dictionary")
    described = materialize(describe(found, words), "findings")
    lessons = describe(seeds, words).select(*FEATURES, "label")
    lessons = materialize(lessons.coalesce(1).sortWithinPartitions(*FEATURES, "label"), "lessons")
    model = train(lessons)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described))
    p = vector_to_array("probability")[1]
    scored = materialize(scored.select("id", "word_at", "value", F.col("length").cast("int").alias("length"), "coverage", p.alias("probability")), "scored")
    return scored.withColumnRenamed("id", id_col).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def redact(docs: DataFrame, findings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every occurrence of their secrets replaced by a mask."""
    secrets = findings.where("is_secret").groupBy(F.col(id_col).alias("_k")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("_secrets"))
    text = F.aggregate(F.coalesce("_secrets", F.array().cast("array<string>")), F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mask)))
    secrets = materialize(secrets, "secrets")
    joined = docs.join(broadcast_if_small(secrets, secrets.count(), 100_000), docs[id_col].eqNullSafe(F.col("_k")), "left").withColumn(text_col, text)
    return joined.select(*docs.columns)
