"""License scans by canonical digest lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictgraph.llm.license_texts import KNOWN

# Spellings that count as equivalent (the second replaces the
# first, also inside longer words).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("colour", "color"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("initialise", "initialize"),
    ("labour", "labor"),
    ("licence", "license"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("optimisation", "optimization"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# A line that is a copyright notice: it names a year, a sign or "by", unlike a
# condition that only speaks of notices or holders.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9©\n]*(?:copyright[^a-z0-9©\n]*(?:\(c\)|©|[12][0-9]{3}|by\b)|\(c\)[ \t]*(?:copyright|[12][0-9]{3})|©)[^\n]*$"
RESERVED_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
BLANK_LINE = r"(?m)^[^\p{L}\p{N}\n]+$"
HAS_BLANK_LINE = r"\n[^\p{L}\p{N}\n]*\n"

# Known texts up to this many are sent to every executor (a digest and a name
# each); more are joined by shuffling digests.
BROADCAST_TEXTS = 100_000
# First words of the known texts up to this many are looked for before a line is
# canonicalised.
FIRST_WORDS = 2_000


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one space for everything between words,
    one spelling for equivalent ones."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.regexp_replace(out, RESERVED_LINE, " ")
    return _spelled(F.trim(F.regexp_replace(out, NOT_WORD, " ")))


def _spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"regexp_replace({out}, '{RESERVED_LINE}', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def first_word(text: Column, canonical_text: bool = False) -> Column:
    """The first word of the canonical text, from the first word alone. Where
    "sub license" has become one word, its first part counts."""
    own = F.regexp_extract(text, r"([\p{L}\p{N}]+)", 1)
    if not canonical_text:
        own = F.substring_index(_spelled(F.lower(own)), " ", 1)
    return F.when(own.startswith("sublicense"), F.lit("sub")).otherwise(own)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def blocks(text: Column) -> Column:
    """The canonical paragraphs, without those that canonicalise to nothing. A
    line without letters and digits parts paragraphs, as in comments."""
    parts = F.split(F.regexp_replace(text, BLANK_LINE, ""), "\n\n+")
    return F.filter(F.transform(parts, canonical), lambda c: c != "")


def passages(rows: DataFrame, known: DataFrame) -> DataFrame:
    """For ``rows`` (``_id``, ``_h``, ``_t``) the sorted ids of the known texts
    whose paragraphs follow one another in the text (``_id2``, ``_h2``,
    ``passages``), however their lines are wrapped; rows without any are left
    out. Every paragraph's digest is looked up by itself; the matches of a
    known text are counted by the place where it would begin, so no text is
    carried along."""
    texts = (
        known.select("license_id", F.transform(blocks(F.col("text")), lambda c: F.sha2(c, 256)).alias("d"))
        .groupBy("d")
        .agg(F.min("license_id").alias("license_id"))
    )
    parts = texts.select("license_id", F.hash("d").alias("v"), F.size("d").alias("n"), F.posexplode("d").alias("j", "digest"))
    if parts.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        parts = F.broadcast(parts)
    found = rows.select("_id", "_h", F.posexplode(blocks(F.col("_t"))).alias("at", "c"))
    return (
        found.select("_id", "_h", "at", F.sha2("c", 256).alias("digest"))
        .join(parts, "digest")
        .groupBy("_id", "_h", "license_id", "v", "n", (F.col("at") - F.col("j")).alias("start"))
        .agg(F.count_distinct("j").alias("matched"))
        .where("matched = n")
        .groupBy("_id", "_h")
        .agg(F.sort_array(F.collect_set("license_id")).alias("passages"))
        .select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "passages")
    )


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col``, ``digest`` (SHA-256 of the canonical text),
    ``license_id`` of the known text that the whole text equals,
    ``notices``: sorted ids of the known texts that a line of it equals, and
    ``passages``: sorted ids of those that a run of its paragraphs (or the
    whole text) equals.

    Texts, lines and paragraphs are looked up by digest in ``known`` (``license_id``,
    ``text``), canonicalised alike; where known texts agree, the least id is
    given. Known texts that canonicalise to nothing are left out.

    A null text has a null digest, no license, notices or passages; an empty text
    has the digest of the empty string. Repeated rows and null ids are kept,
    one result each. Long texts are split into lines inside their row; only
    lines that match leave it, so that no key gathers more than the matches.
    """
    canon = known.select("license_id", canonical(F.col("text")).alias("c")).where("c <> ''")
    firsts = [r[0] for r in canon.select(first_word(F.col("c"), canonical_text=True)).distinct().limit(FIRST_WORDS + 1).collect()]
    names = (
        canon
        .groupBy(F.sha2("c", 256).alias("digest"))
        .agg(F.min("license_id").alias("license_id"))
    )
    if known.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        names = F.broadcast(names)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    key = F.xxhash64("_t").alias("_h")
    begun = rows.select("_id", key, F.explode(F.split("_t", "\n")).alias("line"))
    if len(firsts) <= FIRST_WORDS:  # most lines begin as no known text does
        begun = begun.where(first_word(F.col("line")).isin(firsts))
    whole = rows.select("_id", key, F.sha2(canonical(F.col("_t")), 256).alias("digest")).join(names, "digest", "left")
    lines = (
        begun
        .select("_id", "_h", F.sha2(canonical(F.col("line")), 256).alias("digest"))
        .join(names, "digest")
        .groupBy("_id", "_h")
        .agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
        .select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), "notices")
    )
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))
    out = whole.join(lines, same, "left").drop("_id2", "_h2")
    none = F.array().cast("array<string>")
    parted = rows.where(F.col("_t").rlike(HAS_BLANK_LINE))  # any other text is a single paragraph, looked up whole
    own = F.array_compact(F.array("license_id"))
    return out.join(passages(parted.select("_id", key, "_t"), known), same, "left").select(
        F.col("_id").alias(id_col),
        "digest",
        "license_id",
        F.coalesce("notices", none).alias("notices"),
        F.sort_array(F.array_union(F.coalesce("passages", none), own)).alias("passages"),
    )


def blocks_sql(text: str) -> str:
    """The digests of ``blocks`` as DuckDB SQL."""
    parts = f"string_split_regex(regexp_replace({text}, '{BLANK_LINE}', '', 'g'), '\n\n+')"
    found = f"list_filter(list_transform({parts}, lambda c: {canonical_sql('c')}), lambda c: c <> '')"
    return f"list_transform({found}, lambda c: sha256(c))"
