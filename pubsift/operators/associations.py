"""Term-to-keyword associations inside sentences.

Pipeline (all lazy DataFrame steps):
``sentences`` -> regex filter -> ``sentence_tokens`` -> ``link_terms`` ->
``gene_evidence`` / ``first_mention`` / ``association_features``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubsift.functions.text import raw_tokens, sentence_key, split_sentences
from pubsift.session import materialize

ID = "pmid"


def sentences(docs: DataFrame, text: str = "content", id_col: str = ID,
              keep=("date",)) -> DataFrame:
    """(id, *keep, sent_pos, sentence): one row per sentence, 0-based position."""
    return docs.select(id_col, *keep,
                       F.posexplode(split_sentences(text)).alias("sent_pos", "sentence"))


def sentence_tokens(sents: DataFrame, col: str = "sentence") -> DataFrame:
    """Adds (tok_pos, token) for every token of every sentence (0-based)."""
    return sents.select("*", F.posexplode(raw_tokens(col)).alias("tok_pos", "token"))


def link_terms(tokens: DataFrame, dictionary: DataFrame, token: str = "token",
               alias: str = "alias", symbol: str = "symbol") -> DataFrame:
    """Attach every symbol whose alias equals the token (case-folded).

    Only single-token aliases can match a token.  The dictionary side is
    left to AQE: broadcast when its measured size is under the threshold,
    otherwise a shuffle join; a dictionary holding a third of one alias is
    split by AQE's skew handling.
    """
    d = dictionary.select(F.lower(F.col(alias)).alias("_alias"), F.col(symbol).alias("symbol"),
                          F.col(alias).alias("alias")).distinct()
    return tokens.join(d, F.lower(F.col(token)) == F.col("_alias")).drop("_alias")


def gene_token_guard(token: str = "token", tok_pos: str = "tok_pos", raw: str = "raw"):
    """A token may be a gene only if NOT (all letters AND (sentence start OR lower case))."""
    return may_be_gene(F.col(raw), F.col(tok_pos))


def may_be_gene(token, position):
    return ~(token.rlike(LETTERS_ONLY) & ((position == 0) | (token == F.lower(token))))


def gene_evidence(links: DataFrame, id_col: str = ID) -> DataFrame:
    """Per symbol: documents, sentences and mentions, and the first mention
    (earliest date, then id, then sentence) — all partial aggregates, so a
    symbol holding a third of all rows does not pile into one task."""
    # Two plain aggregation levels instead of distinct counts: per (symbol,
    # document) first, then per symbol; both combine map-side.
    per_doc = links.groupBy("symbol", id_col).agg(
        F.count_distinct("sent_pos").alias("_s"), F.count(F.lit(1)).alias("_m"),
        F.min("date").alias("_d"), F.min("sent_pos").alias("_fs"))
    first = F.min(F.struct(F.col("_d").alias("date"), F.col(id_col),
                           F.col("_fs").alias("sent_pos")))
    return (per_doc.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("_s").alias("n_sentences"),
        F.sum("_m").alias("n_mentions"),
        first.alias("_first"))
        .select("symbol", "n_docs", "n_sentences", "n_mentions",
                F.col("_first.date").alias("first_date"),
                F.col(f"_first.{id_col}").alias("first_pmid"),
                F.col("_first.sent_pos").alias("first_sent")))


def first_mention(links: DataFrame, id_col: str = ID) -> DataFrame:
    """Flag the first association of each symbol by (date, id, sentence).

    Computed as an aggregate joined back (not a window over the symbol), so a
    hot symbol is pre-aggregated map-side."""
    firsts = (links.groupBy("symbol")
              .agg(F.min(F.struct("date", id_col, "sent_pos")).alias("_f"))
              .select("symbol", F.col("_f.date").alias("_fd"),
                      F.col(f"_f.{id_col}").alias("_fp"), F.col("_f.sent_pos").alias("_fs")))
    out = links.join(firsts, "symbol")
    return (out.withColumn("first", (F.col("date") == F.col("_fd")) & (F.col(id_col) == F.col("_fp"))
                           & (F.col("sent_pos") == F.col("_fs")))
            .drop("_fd", "_fp", "_fs"))


def keyword_associations(docs: DataFrame, dictionary: DataFrame, pattern: str,
                         text: str = "content", id_col: str = ID) -> DataFrame:
    """Symbols linked in sentences matching ``pattern``:
    (id, date, sent_pos, sentence, sent_key, tok_pos, token, symbol, alias)."""
    s = sentences(docs, text, id_col)
    s = s.where(F.coalesce(F.col("sentence").rlike(pattern), F.lit(False)))
    toks = sentence_tokens(s).withColumn("sent_key", sentence_key("sentence"))
    return link_terms(toks, dictionary)


# Tokens for association features are words (letters of any script
# with their marks, digits, hyphens) or single punctuation characters.
FEATURE_TOKEN = r"[\p{L}\p{M}\p{N}-]+|[^\s\p{L}\p{M}\p{N}-]"
PUNCT_TOKEN = r"^[^\s\p{L}\p{M}\p{N}-]$"
LETTERS_ONLY = r"^[\p{L}\p{M}]+$"
CLASSES = ("VERB", "NOUN", "ADP", "PUNCT", "GENE")


def association_features(sents: DataFrame, dictionary: DataFrame, pattern: str,
                         lexicon: DataFrame | None = None, id_col: str = ID, verbed: bool = False,
                         flush_at_end: bool = False) -> DataFrame:
    """Counts of word classes between each linked term and the first regex
    match of its sentence.

    ``flip`` = index of the first token whose offset is after the match
    start.  A term at position i < flip counts tokens in (i, flip); a term at
    i >= flip counts tokens in [flip, i).  Non-term tokens count in their
    lexicon class (``lexicon(word, class)``, e.g. VERB/NOUN/ADP, the least class
    of a word listed twice) or PUNCT; term tokens count as GENE (once per token,
    whatever the number of symbols).  Before the match only the last mention of a
    symbol is kept, and none is kept when no token starts after the match, unless
    ``flush_at_end``.  ``verbed`` keeps the terms with a verb in between.

    A sentence stays one row with its tokens in an array.  Only tokens that may
    be terms are exploded for the dictionary, only sentences with a hit for the
    lexicon, and the counts are taken on slices of the sentence's class array.
    ``(id, sent_pos)`` is unique.  Both lookups are left to AQE, which broadcasts a
    side only if its measured size allows it.
    """
    key = [id_col, "sent_pos"]
    # One regex evaluation per sentence: the match position doubles as the filter.
    s = (sents.withColumn("match_start", F.regexp_instr("sentence", F.lit(pattern)) - 1)
         .where(F.col("match_start") >= 0)
         .withColumn("flip", F.size(F.regexp_extract_all(
             F.substr(F.col("sentence"), F.lit(1), F.col("match_start") + 1),
             F.lit(FEATURE_TOKEN), 0)))
         .withColumn("_toks", F.regexp_extract_all("sentence", F.lit(FEATURE_TOKEN), 0)))
    s = materialize(s.select(*key, "date", "match_start", "flip", "_toks"))
    listed = F.transform("_toks", lambda t, i: F.struct(i.alias("tok_pos"), t.alias("token")))
    able = s.select(*key, F.inline(F.filter(listed, lambda e: may_be_gene(e["token"], e["tok_pos"]))))
    d = dictionary.select(F.lower("alias").alias("_alias"), "symbol").distinct()
    hits = (able.join(d, F.lower(F.col("token")) == F.col("_alias")).groupBy(*key)
            .agg(F.collect_list(F.struct("tok_pos", "symbol")).alias("_hits")))     # within one sentence
    found = materialize(s.join(hits, key))
    if lexicon is None:
        lexicon = default_lexicon(sents.sparkSession)
    lex = lexicon.groupBy(F.lower("word").alias("_w")).agg(F.min("class").alias("_c"))
    classed = (found.select(*key, F.posexplode("_toks").alias("tok_pos", "token"))
               .join(lex, F.lower(F.col("token")) == F.col("_w")).groupBy(*key)
               .agg(F.collect_list(F.struct("tok_pos", "_c")).alias("_words")))
    by_pos = F.map_from_entries(F.coalesce("_words", F.array().cast("array<struct<tok_pos:int,_c:string>>")))
    gene_at = F.transform("_hits", lambda h: h["tok_pos"])
    rows = (found.join(classed, key, "left").withColumn("_by", by_pos).withColumn("_genes", gene_at)
            .withColumn("_cls", F.transform("_toks", lambda t, i: F.when(F.array_contains("_genes", i), "GENE")
                                            .when(t.rlike(PUNCT_TOKEN), "PUNCT")
                                            .otherwise(F.element_at("_by", i))))
            .select(*key, "date", "match_start", "flip", "_toks", "_cls", "_hits", F.inline("_hits")))
    pos, flip = F.col("tok_pos"), F.col("flip")
    before = pos < flip
    between = F.when(before, F.slice("_cls", pos + 2, flip - pos - 1)).otherwise(F.slice("_cls", flip + 1, pos - flip))
    # Before the match: nearest mention of a symbol wins; dropped if nothing follows.
    later = F.exists("_hits", lambda h: (h["symbol"] == F.col("symbol")) & (h["tok_pos"] > pos) & (h["tok_pos"] < flip))
    kept = ~before | (~later & (F.lit(flush_at_end) | (flip < F.size("_toks"))))

    def count_of(k):
        return F.size(F.filter("_between", lambda c: c == k)).cast("long").alias(k)

    out = rows.where(kept).withColumn("_between", between).select(
        *key, "date", "tok_pos", F.get("_toks", pos).alias("token"), "symbol", "match_start", "flip",
        before.alias("before"),
        *[count_of(k) for k in CLASSES])
    return (out.where(F.col("VERB") > 0) if verbed else out).select(
        id_col, "date", "sent_pos", "tok_pos", "token", "symbol", "match_start", "flip", "before", *CLASSES)


# A small default word-class lexicon (closed classes only).
ADPOSITIONS = ["of", "in", "on", "at", "by", "for", "with", "from", "to", "into",
               "through", "during", "before", "after", "above", "below", "between",
               "under", "over", "about", "against", "among", "within", "without"]
VERBS = ["is", "are", "was", "were", "be", "been", "being", "has", "have", "had",
         "do", "does", "did", "can", "could", "may", "might", "must", "shall",
         "should", "will", "would"]


def default_lexicon(spark) -> DataFrame:
    rows = [(w, "ADP") for w in ADPOSITIONS] + [(w, "VERB") for w in VERBS]
    return spark.createDataFrame(rows, "word string, class string")
