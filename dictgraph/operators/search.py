"""O10–O14: the dictionary's declared search surfaces as posting tables.

* ``segment_index`` / ``segment_search``   identifier segments split on ``_``
* ``identifier_index`` / ``identifier_search``  exact match on ``_code`` ids
* ``text_index`` / ``text_search``  word search over English ``_info`` text
  (``text_index_frame`` builds the same postings over any text table)
* ``domain_index`` / ``domain_filter``  every ``_domn`` sub-field as a facet
* ``term_list_view``  the covered list projection, sorted by gid or title;
  ``list_page`` reads one page of a published one

Postings are ``(doc, unit, token, pos)``: ``doc`` is the matched key, ``unit``
the text value positions count within (phrases never span two values).
Query modes: ``any`` (at least one token), ``all`` (every distinct token, in
any unit of the doc), ``phrase`` (all tokens adjacent and in order inside one
unit). ``all`` and ``phrase`` anchor each query on its rarest token and
verify the other tokens by exact (doc, token[, pos]) semi-joins, so a very
common token never fans out against a whole posting list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictgraph.functions.constants import (
    ANY_LANGUAGE,
    ENGLISH,
    IDENTIFIER_FIELDS,
    TEXT_ARRAY_FIELDS,
    TEXT_LANG_FIELDS,
)
from dictgraph.functions.stemming import with_stems
from dictgraph.functions.tokens import adjacent_pairs, segment_tokens, word_tokens, words
from dictgraph.functions.variant import is_array, is_container, is_json_null, is_object, is_string
from dictgraph.plans.lineage import cut_lineage, cut_lineage_counted, cut_lineage_observed
from dictgraph.plans.sizing import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, broadcast_if_bounded, broadcast_small, spread_if_narrow
from dictgraph.sources.dictionary import prepare_terms

MODES = ("any", "all", "phrase")


def _check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return mode


def _elements(v):
    """A variant as ``array<variant>``: arrays as they are, scalars wrapped."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def _string_of(v):
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


# ---------------------------------------------------------------- matching

def query_tokens(queries: DataFrame, tokenizer, text_col: str = "text") -> DataFrame:
    """``(query_id, qpos, token)`` for a ``(query_id, text)`` table."""
    return queries.select("query_id", F.explode(tokenizer(F.col(text_col))).alias("t")).select(
        "query_id", F.col("t.pos").alias("qpos"), F.col("t.token").alias("token")
    )


def match(postings: DataFrame, qtokens: DataFrame, mode: str = "any", materialize: bool = True) -> DataFrame:
    """Distinct ``(query_id, doc)`` for postings ``(doc, unit, token, pos)``
    and query tokens ``(query_id, qpos, token)``.

    ``all`` and ``phrase`` read the postings three times (token frequencies,
    anchor candidates, verification); with ``materialize`` they are
    checkpointed once instead of being rebuilt from the text each time. Pass
    ``materialize=False`` for a published postings table."""
    _check_mode(mode)
    qtokens = cut_lineage(qtokens)
    if mode == "any":
        wanted = broadcast_if_bounded(qtokens.select("query_id", "token").distinct())
        postings = restrict_to_tokens(postings, qtokens.select("token"), semi_join=False)
        return postings.join(wanted, "token").select("query_id", "doc").distinct()
    # Only postings of query tokens can matter to frequencies, anchors or
    # verification: keep those (map-side, against the broadcast token set).
    qdistinct = qtokens.select("query_id", "token").distinct()
    postings = restrict_to_tokens(postings, qdistinct.select("token"))
    if materialize:
        if mode == "all":  # a token counts once a doc, places do not matter
            postings = postings.select("doc", "token").distinct()
        postings = cut_lineage(postings)

    # Anchor: the query token with the fewest postings.
    freq = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = qtokens.join(freq, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    anchor = ranked.groupBy("query_id").agg(
        F.min(F.struct("df", "token", "qpos")).alias("a"),
        F.count(F.lit(1)).alias("n_pos"),
        F.countDistinct("token").alias("n_tok"),
    ).select("query_id", F.col("a.token").alias("token"), F.col("a.qpos").alias("aqpos"), "n_pos", "n_tok")
    anchor, n_anchor = cut_lineage_counted(anchor)
    cands = postings.join(F.broadcast(anchor) if n_anchor <= DEFAULT_MAX_BROADCAST_ROWS else anchor, "token")

    if mode == "all":
        cands = cands.select("query_id", "doc", "n_tok").distinct()
        need = cands.join(broadcast_if_bounded(qdistinct), "query_id")
        # a token can occur several times in a doc: de-duplicate the matched
        # rows (few), not the posting list
        ok = _present(need, postings.select("doc", "token"), ["doc", "token"])
        ok = ok.select("query_id", "doc", "n_tok", "token").distinct()
        return ok.groupBy("query_id", "doc", "n_tok").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") == F.col("n_tok")
        ).select("query_id", "doc")

    cands = cands.select("query_id", "doc", "unit", (F.col("pos") - F.col("aqpos")).alias("start"), "n_pos").filter(
        F.col("start") >= 0
    )
    # The query-token table is small; broadcasting it keeps one query with
    # many candidates from landing in a single task.
    need = cands.join(broadcast_if_bounded(qtokens), "query_id").select(
        "query_id", "doc", "unit", "start", "n_pos", "token", (F.col("start") + F.col("qpos")).alias("pos")
    )
    ok = _present(need, postings.select("doc", "unit", "token", "pos"), ["doc", "unit", "token", "pos"])
    return (
        ok.groupBy("query_id", "doc", "unit", "start", "n_pos")
        .agg(F.countDistinct("pos").alias("n"))  # equal rows of one doc have equal postings
        .filter(F.col("n") == F.col("n_pos"))
        .select("query_id", "doc")
        .distinct()
    )


def phrase_match(postings: DataFrame, pairs: DataFrame, qtokens: DataFrame, sep: str, materialize: bool = True) -> DataFrame:
    """Distinct ``(query_id, doc)`` of phrases, found by adjacent pairs.

    ``pairs`` are postings whose token is two adjacent tokens joined by ``sep``.
    A phrase of two tokens or more is searched as the phrase of its pairs: it
    starts from its rarest pair, so two common words that seldom meet make few
    candidates, and every further pair must stand at its place. The pair itself
    is the key, so there is nothing to verify afterwards. A phrase of one token
    is looked up in ``postings``."""
    by_query = qtokens.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("qpos").alias("pos"), "token"))).alias("t"))
    by_query = cut_lineage(by_query)
    one = by_query.filter(F.size("t") == 1).select("query_id", F.lit(0).alias("qpos"), F.col("t")[0]["token"].alias("token"))
    more = by_query.select("query_id", F.explode(adjacent_pairs("t", sep)).alias("t")).select(
        "query_id", F.col("t.pos").alias("qpos"), F.col("t.token").alias("token")
    )
    return match(pairs, more, "phrase", materialize).unionByName(match(postings, one, "any"))


# Query-token sets up to this size are also pushed into the postings scan as
# an ``IN`` filter: on a published table bucketed and sorted by token (O15)
# it prunes buckets and row groups, so only the queried tokens are read.
MAX_PUSHED_TOKENS = 10_000


def restrict_to_tokens(postings: DataFrame, tokens: DataFrame, column: str = "token", semi_join: bool = True) -> DataFrame:
    """Postings whose ``column`` is one of ``tokens``: a pushed-down ``IN``
    filter for a small token set (checked), else a broadcast semi-join."""
    tokens = tokens.select(F.col(column).alias(column)).filter(F.col(column).isNotNull()).distinct()
    small = tokens.limit(MAX_PUSHED_TOKENS + 1).collect()
    if len(small) <= MAX_PUSHED_TOKENS:
        return postings.filter(F.col(column).isin([r[0] for r in small]))
    return postings.join(broadcast_if_bounded(tokens), column, "left_semi") if semi_join else postings


def _present(need: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``need`` whose ``keys`` occur in ``have`` (unique on ``keys``).

    A bounded ``need`` is broadcast and ``have`` (the postings) streams past
    it without a shuffle; otherwise a shuffled semi-join."""
    need, n = cut_lineage_counted(need)
    if n <= DEFAULT_MAX_BROADCAST_ROWS:
        return have.join(F.broadcast(need), keys)
    return need.join(have, keys, "left_semi")


# ---------------------------------------------------------------- O10 segments

def segment_index(terms: DataFrame, delimiter: str = "_", pairs: bool = False) -> DataFrame:
    """``(doc, unit, token, pos)`` over the gid segments of every term; with
    ``pairs`` over adjacent segments, joined by the delimiter."""
    tokens = segment_tokens("_key", delimiter)
    if pairs:
        tokens = adjacent_pairs(tokens, delimiter)
    return terms.select(F.col("_key").alias("doc"), F.explode(tokens).alias("t")).select(
        "doc", F.col("doc").alias("unit"), F.col("t.token").alias("token"), F.col("t.pos").alias("pos")
    )


def segment_search(
    index: DataFrame, queries: DataFrame, mode: str = "any", delimiter: str = "_", materialize: bool = True, pairs: DataFrame | None = None
) -> DataFrame:
    """``(query_id, gid)``: terms whose gid segments match the query text
    (segmented with the same delimiter). With ``pairs`` (an index of adjacent
    segments) phrases start from their rarest pair."""
    qt = query_tokens(queries, lambda c: segment_tokens(c, delimiter))
    if mode == "phrase" and pairs is not None:
        return phrase_match(index, pairs, qt, delimiter, materialize).withColumnRenamed("doc", "gid")
    return match(index, qt, mode, materialize).withColumnRenamed("doc", "gid")


# ---------------------------------------------------------------- O11 identifiers

def identifier_index(terms: DataFrame, fields=IDENTIFIER_FIELDS) -> DataFrame:
    """``(field, value, gid)`` for the exact-match identifier fields of
    ``_code``; an array field yields one row per string element."""
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), F.try_variant_get("doc", f"$._code.{f}", "variant").alias("v")) for f in fields]
    )
    long = terms.select(F.col("_key").alias("gid"), F.explode(per_field).alias("fv")).select(
        "gid", F.col("fv.field").alias("field"), F.explode(_elements(F.col("fv.v"))).alias("e")
    )
    return long.select("field", _string_of(F.col("e")).alias("value"), "gid").filter(F.col("value").isNotNull()).distinct()


def identifier_search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, field, gid)`` for queries ``(query_id, value[, field])``;
    a NULL or absent field searches every identifier field."""
    q = queries if "field" in queries.columns else queries.withColumn("field", F.lit(None).cast("string"))
    q = q.select("query_id", F.col("field").alias("qfield"), "value").filter(F.col("value").isNotNull()).distinct()
    # Answers grow with the rows asked times the rows found, so they are never
    # shuffled: a query of one condition meets each row of the distinct index
    # once. Only a query of several conditions can find a row twice.
    q = cut_lineage(q)
    several, n = cut_lineage_counted(q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("query_id").alias("__id")))
    index = restrict_to_tokens(index, q, column="value", semi_join=False).select("field", "value", "gid")
    index = cut_lineage(index.filter(F.col("value").isNotNull()).distinct())
    if not n:
        return _answers(index, q)
    same, several = F.col("query_id").eqNullSafe(F.col("__id")), broadcast_small(several, n)
    return _answers(index, q.join(several, same, "left_anti")).unionByName(_answers(index, q.join(several, same, "left_semi")).distinct())


# Rows of one value that are moved and met as one, and answers of one gid that
# follow each other: the same few hundred queries for gid after gid, which
# columnar files keep in a fraction of a byte an answer.
BLOCK_ROWS = 1_024
RUN_ROWS = 512


def _answers(index: DataFrame, asked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, field, gid)`` for each row of ``asked`` (``query_id, qfield,
    value``) and each row of ``index`` that it finds.

    A value held by many and asked by many has the product of both as answers.
    Its rows are cut into blocks on either side, and each block of the one meets
    each block of the other in a task of its own choosing: no side is broadcast
    or held whole, a common value is dealt over all tasks, and what moves is
    blocks, not answers."""
    found, n_found = _blocks(index, "field", "gid", "fblock", block_rows)
    asked, n_asked = _blocks(asked, "qfield", "query_id", "qblock", block_rows)
    keys, tasks = ["value", "fblock", "qblock"], int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def copies(blocks: DataFrame, others: DataFrame, number: str) -> DataFrame:
        """Each block once for each of the other side's blocks of its value."""
        blocks = blocks.join(others, "value", "left").withColumn(number, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        return blocks.drop("blocks").repartition(tasks, *keys)  # by number: few bytes make many answers

    met = copies(found, n_asked, "qblock").join(copies(asked, n_found, "fblock"), keys)
    met = met.filter(F.col("qfield").isNull() | (F.col("qfield") == F.col("field")))
    runs = F.transform(F.sequence(F.lit(1), F.size("query_ids"), F.lit(RUN_ROWS)), lambda at: F.slice("query_ids", at, RUN_ROWS))
    met = met.select("field", "gids", F.explode(runs).alias("run")).select("field", "run", F.explode("gids").alias("gid"))
    return met.select(F.explode("run").alias("query_id"), "field", "gid")


def _blocks(rows: DataFrame, kind: str, item: str, number: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(value, kind, number, items)``: the ``item`` of all rows of a value and
    kind, about ``block_rows`` to a block; and ``(value, blocks)`` of the values
    with several blocks, at most one for each ``block_rows`` rows."""
    most = rows.groupBy("value", kind).agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max("n").alias("n"))
    blocks = F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")
    blocks, n = cut_lineage_counted(most.filter(F.col("n") > block_rows).select("value", blocks))
    blocks = broadcast_small(blocks, n)
    dealt = F.pmod(F.xxhash64(item), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = rows.join(blocks, "value", "left").withColumn(number, dealt)
    # in a struct, else a null would be left out
    rows = rows.groupBy("value", kind, number).agg(F.collect_list(F.struct(item)).alias("items"))
    return rows.select("value", kind, number, F.col(f"items.{item}").alias(f"{item}s")), blocks


# ---------------------------------------------------------------- O12 text

def text_values(terms: DataFrame, lang: str = ENGLISH) -> DataFrame:
    """``(gid, field, elem, text)``: the language-keyed ``_info`` fields
    (arrays of language maps expanded) and the plain string-array fields."""
    per_field = [
        F.struct(F.lit(f).alias("field"), F.lit(True).alias("keyed"), F.try_variant_get("doc", f"$._info.{f}", "variant").alias("v"))
        for f in TEXT_LANG_FIELDS
    ] + [
        F.struct(F.lit(f).alias("field"), F.lit(False).alias("keyed"), F.try_variant_get("doc", f"$._info.{f}", "variant").alias("v"))
        for f in TEXT_ARRAY_FIELDS
    ]
    long = terms.select(F.col("_key").alias("gid"), F.explode(F.array(*per_field)).alias("fv")).select(
        "gid", F.col("fv.field").alias("field"), F.col("fv.keyed").alias("keyed"),
        F.posexplode(_elements(F.col("fv.v"))).alias("elem", "e"),
    )
    text = F.when(F.col("keyed"), F.try_variant_get("e", f"$.{lang}", "string")).otherwise(_string_of(F.col("e")))
    return long.select("gid", "field", "elem", text.alias("text")).filter(F.col("text").isNotNull())


def text_values_by_language(terms: DataFrame) -> DataFrame:
    """``(gid, lang, field, elem, text)``: the ``_info`` texts of every language,
    each document's language maps exploded once. Texts of fields without
    languages get the language ``ANY_LANGUAGE``."""
    fields = [(f, True) for f in TEXT_LANG_FIELDS] + [(f, False) for f in TEXT_ARRAY_FIELDS]
    per_field = F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(keyed).alias("keyed"), F.try_variant_get("doc", f"$._info.{f}", "variant").alias("v")) for f, keyed in fields]
    )
    long = terms.select(F.col("_key").alias("gid"), F.explode(per_field).alias("fv")).select(
        "gid", F.col("fv.field").alias("field"), F.col("fv.keyed").alias("keyed"), F.posexplode(_elements(F.col("fv.v"))).alias("elem", "e")
    )
    keyed = long.filter("keyed").select("gid", "field", "elem", F.explode(F.try_variant_get("e", "$", "map<string,variant>")).alias("lang", "v")).select(
        "gid", "lang", "field", "elem", F.try_variant_get("v", "$", "string").alias("text")
    )
    plain = long.filter(~F.col("keyed")).select("gid", F.lit(ANY_LANGUAGE).alias("lang"), "field", "elem", _string_of(F.col("e")).alias("text"))
    return keyed.unionByName(plain).filter(F.col("text").isNotNull())


def stemmed(rows: DataFrame, column: str = "token", wanted: DataFrame | None = None) -> DataFrame:
    """``rows`` (postings, query tokens) with ``column`` replaced by its English
    stem. Each distinct token is stemmed once and its stem joined back.

    ``wanted`` (a DataFrame with ``column``, such as the queries' stems) keeps
    only rows with these stems: their few words are then broadcast to the
    postings, which a large vocabulary would have to be shuffled with."""
    stems = with_stems(rows.select(F.col(column).alias("__token")).distinct(), "__token", "__stem")
    stems, n = cut_lineage_counted(stems)
    if wanted is not None:  # a filter on stems is kept out of the plan that makes them
        stems, n = cut_lineage_counted(restrict_to_tokens(stems, wanted.select(F.col(column).alias("__stem")), "__stem"))
    out = rows.join(broadcast_small(stems, n, DEFAULT_MAX_BROADCAST_ROWS), F.col(column) == F.col("__token"))
    return out.withColumn(column, F.col("__stem")).drop("__token", "__stem")


def text_index_frame(
    df: DataFrame, doc_col: str, text_col: str, unit_cols=(), spread: bool = True, pairs: bool = False, keep=(), fold: bool = False
) -> DataFrame:
    """Word postings ``(doc, unit, token, pos)`` over any text column; with
    ``pairs`` postings of adjacent words, joined by a blank. ``keep`` columns
    (such as a language) stay with every posting. ``fold`` drops accents;
    ``stemmed`` turns the postings into those of stems.

    Every text is a unit of its own (its hash is part of the unit), so a phrase
    never spans two rows of one ``doc``. With ``spread`` an input with fewer
    partitions than task slots is spread out first, so tokenizing is not left
    to a few tasks."""
    unit = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in unit_cols], F.hex(F.xxhash64(text_col)))
    df = df.select(*dict.fromkeys([doc_col, text_col, *unit_cols, *keep]))
    if spread:
        df = spread_if_narrow(df)
    # Words are counted as they are exploded: nothing is made of them before. A
    # pair finds its second word in the text's words, which no row takes along.
    df = df.select(*keep, F.col(doc_col).alias("doc"), unit.alias("unit"), words(F.col(text_col), fold).alias("words"))
    firsts = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))) if pairs else F.col("words")
    df = df.select(*keep, "doc", "unit", "words", F.posexplode(firsts).alias("pos", "token"))
    token = F.concat_ws(" ", "token", F.get("words", F.col("pos") + 1)) if pairs else F.col("token")
    return df.select(*keep, "doc", "unit", token.alias("token"), "pos")


def text_index(terms: DataFrame, lang: str = ENGLISH, fields=None, pairs: bool = False, fold: bool = False) -> DataFrame:
    """Word postings over the text fields of every term in one language;
    ``fields`` restricts the indexed fields, ``fold`` drops accents."""
    vals = text_values(terms, lang)
    if fields is not None:
        vals = vals.filter(F.col("field").isin(list(fields)))
    return text_index_frame(vals, "gid", "text", ("field", "elem"), pairs=pairs, fold=fold)


def text_index_languages(terms: DataFrame, pairs: bool = False, fold: bool = False) -> DataFrame:
    """``(lang, doc, unit, token, pos)``: word postings of all languages, made in
    one pass. ``in_language`` picks one; a table partitioned by ``lang`` then
    reads that partition alone."""
    return text_index_values(text_values_by_language(terms), pairs, fold)


def text_index_values(values: DataFrame, pairs: bool = False, fold: bool = False) -> DataFrame:
    """``text_index_languages`` of texts already taken from their documents
    (``text_values_by_language``)."""
    return text_index_frame(values, "gid", "text", ("field", "elem"), pairs=pairs, keep=("lang",), fold=fold)


def in_language(index: DataFrame, lang: str = ENGLISH) -> DataFrame:
    """The postings of ``lang``, and those that belong to no language."""
    return index.filter(F.col("lang").isin(lang, ANY_LANGUAGE)).drop("lang")


def text_search(
    index: DataFrame,
    queries: DataFrame,
    mode: str = "any",
    materialize: bool = True,
    fields=None,
    pairs: DataFrame | None = None,
    fold: bool = False,
    stem: bool = False,
) -> DataFrame:
    """``(query_id, doc)`` for ``(query_id, text)`` queries; ``fields`` searches
    only these fields of an index made by ``text_index``. With ``pairs`` (an
    index of adjacent words) phrases start from their rarest pair. ``fold`` and
    ``stem`` treat the queries' words as those of the index were."""
    if stem and pairs is not None:
        raise ValueError("pairs hold words, not stems")

    def within(df: DataFrame) -> DataFrame:
        return df if fields is None else df.filter(F.substring_index("unit", "\u001f", 1).isin(list(fields)))

    qt = query_tokens(queries, lambda c: word_tokens(c, fold))
    if stem:
        qt = stemmed(qt)
    if mode == "phrase" and pairs is not None:
        return phrase_match(within(index), within(pairs), qt, " ", materialize)
    return match(within(index), qt, mode, materialize)


def phrase_search_texts(df: DataFrame, queries: DataFrame, doc_col: str, text_col: str, spread: bool = True) -> DataFrame:
    """``(query_id, doc)``: rows of a text table that hold each query's words in
    order and adjacent, without an index.

    One pass counts the texts of each query word, a second finds the keys of the
    texts with a query's rarest word, a third reads these texts and looks for
    the phrase in their words. No postings are written, no text is copied beside
    its words, and a common word alone brings no candidates."""
    qt, n_tokens = cut_lineage_counted(query_tokens(queries, word_tokens))
    texts = df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    if spread:
        texts = spread_if_narrow(texts)
    # Words are exploded beside a key of their text, never beside the text, and
    # cut to the queries' words where they arise. Texts come last, for the keys
    # that hold an anchor. Equal texts of one doc share a key and an answer.
    texts = texts.select("doc", "text", F.xxhash64("text").alias("at"))
    words = F.transform(word_tokens(F.col("text")), lambda t: t["token"])
    own = texts.select("doc", "at", F.explode(F.array_distinct(words)).alias("token"))
    freq = restrict_to_tokens(own, qt.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = qt.join(freq, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qpos", "token"))), lambda t: t["token"]), " ")
    anchors = ranked.groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("a"), phrase.alias("phrase"))
    anchors = anchors.select("query_id", F.col("a.token").alias("token"), "phrase", F.col("a.df").alias("df")).filter("df > 0")
    anchors, n = cut_lineage_counted(anchors)

    def bytes_of(c: str):
        return F.coalesce(F.sum(F.octet_length(F.col(c).cast("string")) + 64), F.lit(0))

    def bounded(df: DataFrame, stats: dict) -> DataFrame:
        fits = stats["rows"] <= DEFAULT_MAX_BROADCAST_ROWS and stats["bytes"] <= DEFAULT_MAX_BROADCAST_BYTES
        return F.broadcast(df) if fits else df

    asked = restrict_to_tokens(own, anchors).join(broadcast_small(anchors.select("token", "query_id"), n), "token").select("doc", "at", "query_id")
    asked, stats = cut_lineage_observed(asked.distinct(), bytes=bytes_of("doc"))
    phrases, of_phrases = cut_lineage_observed(anchors.select("query_id", "phrase"), bytes=bytes_of("phrase"))
    found = texts.join(bounded(asked, stats), ["doc", "at"]).join(bounded(phrases, of_phrases), "query_id")
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return found.filter(line.contains(F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("query_id", "doc").distinct()


# ---------------------------------------------------------------- O13 domain facets

def domain_index(terms: DataFrame) -> DataFrame:
    """``(path, value, gid)``: every scalar under ``_domn`` with its dotted
    path; arrays contribute each element under the array's path; nested
    objects are walked level by level until no container is left."""
    start = terms.select(
        F.col("_key").alias("gid"), F.lit("").alias("path"), F.try_variant_get("doc", "$._domn", "variant").alias("v")
    ).filter(is_object("v"))
    pending, n_pending = cut_lineage_counted(start)
    leaves = []
    while n_pending:
        objs = pending.filter(is_object("v")).select(
            "gid", "path", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v")
        ).select("gid", F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "v")
        arrs = pending.filter(is_array("v")).select(
            "gid", "path", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")
        )
        nxt = objs.unionByName(arrs).withColumn("container", is_container("v"))
        nxt, stats = cut_lineage_observed(nxt, containers=F.coalesce(F.sum(F.col("container").cast("long")), F.lit(0)))
        leaves.append(
            nxt.filter(~F.col("container") & F.col("v").isNotNull() & ~is_json_null("v")).select(
                "path", F.try_variant_get("v", "$", "string").alias("value"), "gid"
            )
        )
        pending, n_pending = nxt.filter("container").drop("container"), stats["containers"]
    if not leaves:
        return terms.sparkSession.createDataFrame([], "path string, value string, gid string")
    from functools import reduce

    return reduce(DataFrame.unionByName, leaves).distinct()


def domain_filter(index: DataFrame, queries: DataFrame, materialize: bool = True) -> DataFrame:
    """``(query_id, gid)``: terms matching every ``(path, value)`` condition
    listed under the same ``query_id``. Small sets of paths and values are
    pushed into the scan of the index as filters on its own columns; pass
    ``materialize=False`` for a published index."""
    index = restrict_to_tokens(index, queries, column="value", semi_join=False)
    index = restrict_to_tokens(index, queries, column="path", semi_join=False)
    postings = index.select(
        F.col("gid").alias("doc"), F.lit("").alias("unit"),
        F.concat_ws("\u001f", "path", "value").alias("token"), F.lit(0).alias("pos"),
    )
    qt = queries.select("query_id", F.lit(0).alias("qpos"), F.concat_ws("\u001f", "path", "value").alias("token"))
    return match(postings, qt, "all", materialize).withColumnRenamed("doc", "gid")


# ---------------------------------------------------------------- O14 list view

def term_list_view(terms: DataFrame, order: str = "gid", lang: str = ENGLISH, sort: bool = True) -> DataFrame:
    """``(gid, nid, title, term_roles)``, ascending by gid or by title (raw
    byte order, Spark's default collation). ``sort=False`` leaves the global
    sort out (e.g. when publishing a table sorted within buckets)."""
    if order not in ("gid", "title"):
        raise ValueError(f"order must be 'gid' or 'title', got {order!r}")
    t = prepare_terms(terms)
    roles = F.try_variant_get("doc", "$._domn._term_role", "variant")
    view = t.select(
        F.col("_key").alias("gid"),
        F.try_variant_get("doc", "$._code._nid", "string").alias("nid"),
        F.try_variant_get("doc", f"$._info._title.{lang}", "string").alias("title"),
        F.transform(_elements(roles), lambda e: F.try_variant_get(e, "$", "string")).alias("term_roles"),
    )
    if not sort:
        return view
    return view.orderBy("gid") if order == "gid" else view.orderBy(F.col("title").asc_nulls_last(), "gid")


def list_page(view: DataFrame, page: int | None = None, size: int = 50, after=None, order: str = "gid") -> DataFrame:
    """One page of a published list view (``gid, nid, title, term_roles, row``,
    whose ``row`` counts from 0 in its order): by number (``page`` from 0), or
    the rows behind a key: ``after`` is a gid, or with ``order='title'`` a pair
    (title, gid). The range of rows becomes a filter on ``row``, in which the
    table is sorted, so a page reads the few files and row groups that hold it
    and is never sorted again. An unknown key gives an empty page."""
    if order not in ("gid", "title"):
        raise ValueError(f"order must be 'gid' or 'title', got {order!r}")
    if (page is None) == (after is None):
        raise ValueError("a page is asked for by its number or by the key before it")
    if size < 1 or (page is not None and page < 0):
        raise ValueError("a page has at least one row and a number from 0")
    if after is not None:
        title, gid = after if order == "title" else (None, after)
        at = view.filter(F.col("gid") == gid)
        if order == "title":
            at = at.filter(F.col("title").eqNullSafe(F.lit(title)))
        found = at.select("row").first()
        first = found["row"] + 1 if found else None
    else:
        first = page * size
    if first is None:
        return view.limit(0)
    return view.filter((F.col("row") >= first) & (F.col("row") < first + size))
