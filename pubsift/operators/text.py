"""Text features: token tables, vocabulary, bag of words, tf-idf, phrases,
padded index sequences.

Everything works on the long token form ``(pmid, sent_pos, tok_pos, token)``
so that no document's token list is ever collected whole except the short,
per-document arrays ``pad_sequence`` is asked to produce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubsift.functions.text import split_sentences, tokenize
from pubsift.operators.ordinals import global_ordinal, with_scalars
from pubsift.session import materialize

ID = "pmid"
# Fixed value: the phrase delimiter (U+00B7, middle dot).
PHRASE_DELIMITER = "·"


def sentence_token_table(docs: DataFrame, text: str | tuple = ("title", "content"), id_col: str = ID,
                         stop_words: bool = True) -> DataFrame:
    """(id, sent_pos, tok_pos, token): preprocessed tokens of every sentence of
    the title followed by the content (a column name: of that column only)."""
    whole = F.concat_ws(" ", *((text,) if isinstance(text, str) else text))
    s = docs.select(id_col, F.posexplode(split_sentences(whole)).alias("sent_pos", "sentence"))
    return s.select(id_col, "sent_pos",
                    F.posexplode(tokenize("sentence", stop_words=stop_words))
                    .alias("tok_pos", "token"))


def sentence_token_lists(docs: DataFrame, text: str | tuple = ("title", "content"), id_col: str = ID,
                         stop_words: bool = True, keep: tuple = ()) -> DataFrame:
    """(id, *keep, sent_pos, tokens): the sentences of :func:`sentence_token_table` that
    have tokens, one row each.  A sentence lies in one row, so nothing is shuffled."""
    whole = F.concat_ws(" ", *((text,) if isinstance(text, str) else text))
    s = docs.select(id_col, *keep, F.posexplode(split_sentences(whole)).alias("sent_pos", "sentence"))
    return s.select(id_col, *keep, "sent_pos", tokenize("sentence", stop_words=stop_words).alias("tokens")).where(
        F.size("tokens") > 0)


def document_token_lists(docs: DataFrame, text: str | tuple = ("title", "content"), id_col: str = ID,
                         stop_words: bool = True) -> DataFrame:
    """(id, tokens): the tokens of :func:`sentence_token_table` in text order, one row an
    id (written: several steps read them).  No token crosses a sentence's end, so a text
    is cut as a whole inside its row; only the sentences of ids that repeat are grouped,
    in the order of (sent_pos, tok_pos, token)."""
    fields = (text,) if isinstance(text, str) else text
    again = materialize(docs.select(F.col(id_col).alias("_id")).groupBy("_id").agg(
        F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id"))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    once = docs.join(again, same, "left_anti").select(
        id_col, tokenize(F.concat_ws(" ", *fields), stop_words=stop_words).alias("tokens"))
    shared = sentence_token_table(docs.join(again, same, "left_semi"), text, id_col, stop_words).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("sent_pos", "tok_pos", "token"))).alias("_s"))
    lists = once.unionByName(shared.select(id_col, F.transform("_s", lambda e: e["token"]).alias("tokens")))
    return materialize(lists).where(F.size("tokens") > 0)   # before the write it would cut every text twice


def vocabulary(tokens: DataFrame, id_col: str = ID) -> DataFrame:
    """(token, id, doc_freq, term_freq); ids 0.. in token order.  ``tokens`` is a token
    table or :func:`document_token_lists`, one row an id, whose tokens and distinct
    tokens are counted without a shuffle of (id, token)."""
    if "tokens" in tokens.columns:
        held = F.array_distinct("tokens")
        rows = tokens.select(F.explode(held).alias("token"), F.col(id_col).isNotNull().cast("long").alias("_d"),
                             F.lit(0).cast("long").alias("_t")).unionByName(
            tokens.select(F.explode("tokens").alias("token"), F.lit(0).cast("long").alias("_d"),
                          F.lit(1).cast("long").alias("_t")))
        v = rows.groupBy("token").agg(F.sum("_d").alias("doc_freq"), F.sum("_t").alias("term_freq"))
    else:
        v = tokens.groupBy("token").agg(F.count_distinct(id_col).alias("doc_freq"),
                                        F.count(F.lit(1)).alias("term_freq"))
    return global_ordinal(v, ["token"], "id", start=0)


def bag_of_words(tokens: DataFrame, id_col: str = ID) -> DataFrame:
    """(id, token, n): token counts per document, of tokens or of counted tokens with ``n``."""
    if "n" in tokens.columns:
        return tokens.groupBy(id_col, "token").agg(F.sum("n").alias("n"))
    return tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def counted_tokens(rows: DataFrame, tokens) -> DataFrame:
    """The columns of ``rows`` but its text, with (token, n) of the token array
    ``tokens``: counted inside the row, so no table of the tokens is held."""
    columns = rows.columns
    rows = rows.withColumn("_s", F.sort_array(tokens))
    size = F.size("_s")
    rows = rows.withColumn("_b", F.when(size > 0, F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))))
    ends = F.concat(F.slice("_b", F.lit(2), F.size("_b")), F.array(size))
    pairs = F.zip_with("_b", ends, lambda i, j: F.struct(F.get("_s", i).alias("token"), (j - i).cast("long").alias("n")))
    return rows.select(*columns, F.inline(pairs))


def document_bag(docs: DataFrame, text: tuple = ("title", "content"), id_col: str = ID) -> DataFrame:
    """(id, token, n): the tokens of :func:`sentence_token_table` counted inside each
    document row (a row a document and token, so ids that repeat have several)."""
    rows = docs.select(id_col, F.concat_ws(" ", *text).alias("_text"))
    return counted_tokens(rows, tokenize("_text")).select(id_col, "token", "n")


def idf_table(bow: DataFrame, id_col: str = ID) -> DataFrame:
    """(token, idf) with idf = ln((1 + n_docs) / (1 + df)) + 1 (smooth idf)."""
    n_docs = bow.agg(F.count_distinct(id_col).alias("_n_docs"))
    df = bow.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    return with_scalars(df, n_docs).select(
        "token", (F.log((1 + F.col("_n_docs")) / (1 + F.col("_df"))) + 1).alias("idf"))


def tfidf(bow: DataFrame, idf: DataFrame | None = None, id_col: str = ID) -> DataFrame:
    """(id, token, tfidf): counts x idf, L2-normalised per document.

    Pass the training ``idf`` to transform test documents with training
    document frequencies (unknown tokens drop out)."""
    if idf is None:
        bow = materialize(bow)  # read by the idf aggregate and by the weighting
        idf = idf_table(bow, id_col)
    w = bow.join(idf, "token").withColumn("_w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))  # one document's words
    return w.select(id_col, "token", (F.col("_w") / norm).alias("tfidf"))


def phrase_scores(tokens: DataFrame, min_count: int = 30, threshold: float = 10.0,
                  id_col: str = ID) -> DataFrame:
    """(a, b, n_ab, score) for adjacent pairs inside a sentence with
    score = (n_ab - min_count) * V / (n_a * n_b) above ``threshold``
    (V = number of distinct tokens)."""
    w = Window.partitionBy(id_col, "sent_pos").orderBy("tok_pos")
    with_next = tokens if "next" in tokens.columns else \
        tokens.withColumn("next", F.lead("token").over(w))
    pairs = (with_next.withColumnRenamed("next", "b")
             .where(F.col("b").isNotNull())
             .groupBy(F.col("token").alias("a"), "b").agg(F.count(F.lit(1)).alias("n_ab"))
             .where(F.col("n_ab") >= min_count))
    uni = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")))  # read three times
    v = uni.agg(F.count(F.lit(1)).alias("_v"))
    scored = (pairs.join(uni.select(F.col("token").alias("a"), F.col("n").alias("n_a")), "a")
              .join(uni.select(F.col("token").alias("b"), F.col("n").alias("n_b")), "b"))
    scored = with_scalars(scored, v).withColumn(
        "score", (F.col("n_ab") - min_count) * F.col("_v") / (F.col("n_a") * F.col("n_b")))
    return scored.where(F.col("score") > threshold).select("a", "b", "n_ab", "score")


def _pairs(lists: DataFrame, id_col: str) -> DataFrame:
    """(id, sent_pos, tok_pos, token, next) of sentence lists; nothing is shuffled."""
    following = F.slice("tokens", F.lit(2), F.size("tokens"))
    return lists.select(id_col, "sent_pos", F.posexplode(F.zip_with(
        "tokens", following, lambda t, n: F.struct(t.alias("token"), n.alias("next")))).alias("tok_pos", "_p")).select(
            id_col, "sent_pos", "tok_pos", "_p.token", "_p.next")


def _by_sentence(a: DataFrame, b: DataFrame, how: str, id_col: str) -> DataFrame:
    """``a`` joined with ``b`` on (id, sent_pos); null ids are equal."""
    b = b.withColumnsRenamed({id_col: "_id", "sent_pos": "_sp"})
    return a.join(b, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("sent_pos") == F.col("_sp")), how)


def _one_list_a_sentence(lists: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The sentence lists whose (id, sent_pos) occurs once, and the rows (id, sent_pos,
    tok_pos, token, next) of the others: ids that repeat share their sentences, in the
    order of ``tok_pos``."""
    lists = materialize(lists.select(id_col, "sent_pos", "tokens"))     # read by the keys and both parts
    again = materialize(lists.groupBy(id_col, "sent_pos").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    shared = _by_sentence(lists, again, "left_semi", id_col).select(
        id_col, "sent_pos", F.posexplode("tokens").alias("tok_pos", "token"))
    sent = Window.partitionBy(id_col, "sent_pos").orderBy("tok_pos")
    return (_by_sentence(lists, again, "left_anti", id_col),
            materialize(shared.withColumn("next", F.lead("token").over(sent))))


def _merge_lists(lists: DataFrame, phrases: DataFrame, id_col: str) -> DataFrame:
    """:func:`merge_phrases` of sentence lists with one row per (id, sent_pos): only the
    places of scored pairs are grouped; a sentence is cut and joined inside its row."""
    found = _pairs(lists, id_col).join(phrases.select(F.col("a").alias("token"), F.col("b").alias("next")),
                                       ["token", "next"]).select(id_col, "sent_pos", "tok_pos")
    sent = Window.partitionBy(id_col, "sent_pos").orderBy("tok_pos")
    run = Window.partitionBy(id_col, "sent_pos", "_run").orderBy("tok_pos")
    starts = (found.withColumn("_run", F.col("tok_pos") - F.row_number().over(sent))
              .where("tok_pos is not null").withColumn("_nth", F.row_number().over(run)).where("_nth % 2 = 1")
              .groupBy(id_col, "sent_pos").agg(F.sort_array(F.collect_list("tok_pos")).alias("_at")))
    both = _by_sentence(lists, starts, "left", id_col)
    size, at = F.size("tokens"), F.col("_at")
    merged = F.flatten(F.zip_with(
        F.concat(F.array(F.lit(-2)), at), F.concat(at, F.array(size)),
        lambda last, this: F.concat(
            F.slice("tokens", last + 3, this - last - 2),
            F.when(this < size, F.array(F.concat_ws(PHRASE_DELIMITER, F.get("tokens", this), F.get("tokens", this + 1))))
            .otherwise(F.array().cast("array<string>")))))
    return both.select(id_col, "sent_pos", F.when(at.isNull(), F.col("tokens")).otherwise(merged).alias("tokens"))


def _as_rows(lists: DataFrame, id_col: str) -> DataFrame:
    return lists.select(id_col, "sent_pos", F.posexplode("tokens").alias("tok_pos", "token"))


def merge_phrases(tokens: DataFrame, phrases: DataFrame, id_col: str = ID) -> DataFrame:
    """One greedy left-to-right merging pass: a scored pair (a, b) becomes the
    single token 'a·b'.  Returns the same long form with new positions.

    A run of consecutive pair starts is resolved greedily by taking every
    other start (1st, 3rd, ...) — gaps and islands inside the sentence.
    """
    sent = Window.partitionBy(id_col, "sent_pos").orderBy("tok_pos")
    p = phrases.select(F.col("a").alias("token"), F.col("b").alias("_next"),
                       F.lit(1).alias("_m"))
    with_next = tokens if "next" in tokens.columns else \
        tokens.withColumn("next", F.lead("token").over(sent))
    t = (with_next.withColumnRenamed("next", "_next")
         .join(p, ["token", "_next"], "left")
         .withColumn("_m", F.coalesce("_m", F.lit(0))))
    t = t.withColumn("_run_m", F.sum("_m").over(sent.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_island", F.col("tok_pos") - F.col("_run_m"))
    isl = Window.partitionBy(id_col, "sent_pos", "_m", "_island").orderBy("tok_pos")
    t = t.withColumn("_start", (F.col("_m") == 1) & (F.row_number().over(isl) % 2 == 1))
    t = t.withColumn("_prev_start", F.coalesce(F.lag("_start").over(sent), F.lit(False)))
    merged = (t.where(~F.col("_prev_start"))
              .withColumn("token", F.when(F.col("_start"),
                                          F.concat_ws(PHRASE_DELIMITER, "token", "_next"))
                          .otherwise(F.col("token"))))
    return (merged.withColumn("tok_pos", F.row_number().over(sent) - 1)
            .select(id_col, "sent_pos", "tok_pos", "token"))


def _merge_step(parts: tuple[DataFrame, DataFrame], phrases: DataFrame, id_col: str) -> DataFrame:
    """Sentence lists of both parts of :func:`_one_list_a_sentence` after one pass."""
    lists, shared = parts
    rows = merge_phrases(shared, phrases, id_col).groupBy(id_col, "sent_pos").agg(
        F.array_sort(F.collect_list(F.struct("tok_pos", "token"))).alias("_s"))
    return _merge_lists(lists, phrases, id_col).unionByName(
        rows.select(id_col, "sent_pos", F.transform("_s", lambda e: e["token"]).alias("tokens")))


def preprocess(tokens: DataFrame, passes: int = 1, min_count: int = 30,
               threshold: float = 10.0, id_col: str = ID):
    """Learn and apply ``passes`` phrase models in order.  Returns the merged
    tokens and the list of phrase tables (re-applied to new documents by
    :func:`apply_preprocessing`).  ``tokens`` is a token table or the lists of
    :func:`sentence_token_lists`, whose pairs need no shuffle."""
    models = []
    listed = "tokens" in tokens.columns
    sent = Window.partitionBy(id_col, "sent_pos").orderBy("tok_pos")
    for _ in range(passes):
        if listed:
            parts = _one_list_a_sentence(tokens, id_col)
            rows = _pairs(parts[0], id_col).unionByName(parts[1])
        else:
            # Read by phrase scoring and by merging; the next token is computed once.
            rows = materialize(tokens.withColumn("next", F.lead("token").over(sent)))
        ph = materialize(phrase_scores(rows, min_count, threshold, id_col))     # read by each later merge
        models.append(ph)
        tokens = _merge_step(parts, ph, id_col) if listed else merge_phrases(rows, ph, id_col)
    return (_as_rows(tokens, id_col) if listed else tokens), models


def apply_preprocessing(tokens: DataFrame, models: list[DataFrame], id_col: str = ID) -> DataFrame:
    """Re-apply fitted phrase tables, in order, to new token tables or sentence lists."""
    listed = "tokens" in tokens.columns
    for ph in models:
        tokens = _merge_step(_one_list_a_sentence(tokens, id_col), ph, id_col) if listed \
            else merge_phrases(tokens, ph, id_col)
    return _as_rows(tokens, id_col) if listed else tokens


def normalise_tokens(tokens: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """Replace tokens by their lemma from a (form, lemma) table; identity if absent.
    The table is written before the join, so its measured size decides whether it is
    broadcast: tokens are then not shuffled."""
    if lemmas is None:
        return tokens
    lem = materialize(lemmas.select(F.col("form").alias("token"), F.lower("lemma").alias("_lemma")))
    return (tokens.join(lem, "token", "left")
            .withColumn("token", F.coalesce("_lemma", "token")).drop("_lemma"))


def pad_sequences(tokens: DataFrame, vocab: DataFrame, width: int = 500,
                  id_col: str = ID, docs: DataFrame | None = None) -> DataFrame:
    """(id, seq): vocabulary id + 1 per token in text order, unknown tokens
    n + 1, the last ``width`` kept, zeros appended up to ``width``.  With
    ``docs`` every document has a row: one without tokens is all zeros.
    ``tokens`` is a token table or :func:`document_token_lists`: of a list only the
    tokens that are kept meet the vocabulary."""
    from pubsift.functions.text import pad_sequence

    n = vocab.agg(F.count(F.lit(1)).alias("_nv"))
    listed = "tokens" in tokens.columns
    if listed:
        size = F.size("tokens")
        kept = F.when(size > width, F.slice("tokens", size - width + 1, width)).otherwise(F.col("tokens"))
        tokens = tokens.select(id_col, F.posexplode(kept).alias("_at", "token"))
    t = with_scalars(tokens.join(vocab.select("token", "id"), "token", "left"), n)
    t = t.withColumn("_v", F.coalesce(F.col("id") + 1, F.col("_nv") + 1).cast("int"))
    order = ["_at"] if listed else ["sent_pos", "tok_pos"]
    seqs = t.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*order, "_v"))).alias("_s"))
    ids = F.transform("_s", lambda x: x["_v"])
    if docs is not None:
        seqs = docs.select(id_col).distinct().join(seqs, id_col, "left")
        ids = F.coalesce(ids, F.array().cast("array<int>"))
    return seqs.select(id_col, pad_sequence(ids, width).alias("seq"))


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(row, vector): row id+1 holds the word's vector (zeros when missing);
    row 0 (padding) and row n+1 (unknown) are zero vectors."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    body = (vocab.select((F.col("id") + 1).alias("row"), F.col("token").alias("word"))
            .join(vectors.select("word", "vector"), "word", "left")
            .select("row", F.coalesce("vector", zeros).alias("vector")))
    n = vocab.agg(F.count(F.lit(1)).alias("_n"))
    extra = n.select(F.explode(F.array(F.lit(0).cast("long"), F.col("_n") + 1)).alias("row"),
                     zeros.alias("vector"))
    return body.unionByName(extra)
