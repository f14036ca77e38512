"""Column expressions for text: sentences, tokens, keys, spans.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here calls Python per row.
"""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence boundary and token patterns.  Both are
# RE2-compatible (no look-behind) so that the DuckDB oracle reads them the
# same way Java's regex engine does.
SENTENCE_BOUNDARY = r"[.!?]+\s+"
# A token is a maximal run of letters of any script, their marks, digits and
# hyphens that holds a letter or a digit.  Runs are extracted rather than
# split off: the extract pattern is compiled once per task.
TOKEN_RUN = r"-*[\p{L}\p{N}][\p{L}\p{M}\p{N}-]*"
WORD_RUN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"  # hyphens separate
NUMBER_TOKEN = r"^[0-9]+$"


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop-word list, read from the Spark jar."""
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars",
                                  "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return tuple(z.read(name).decode("utf-8").split())
    return ()


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_sentences(text) -> Column:
    """array<string> of sentences; a boundary is a run of .!? then whitespace."""
    return F.split(col_of(text), SENTENCE_BOUNDARY)


def raw_tokens(text) -> Column:
    """Lower-cased tokens, separators removed, intra-word hyphens kept."""
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(TOKEN_RUN), 0)


def tokenize(text, stop_words: bool = True, drop_numbers: bool = True,
             split_hyphens: bool = False) -> Column:
    """Tokens in order: lower-cased, numbers and (optionally) stop words removed."""
    pattern = WORD_RUN if split_hyphens else TOKEN_RUN
    toks = F.regexp_extract_all(F.lower(col_of(text)), F.lit(pattern), 0)
    if drop_numbers:
        # all-digit tokens (same as NUMBER_TOKEN, without a regex per token; only those
        # that begin with a digit are looked at in full)
        toks = F.filter(toks, lambda t: (t < F.lit("0")) | (t >= F.lit(":")) | (F.translate(t, "0123456789", "") != F.lit("")))
    if stop_words:
        stops = list(english_stop_words())
        # isin over many literals becomes a hash-set lookup (InSet).
        toks = F.filter(toks, lambda t: ~t.isin(stops))
    return toks


def sentence_key(text) -> Column:
    """Stable key of a sentence: md5 of its text."""
    return F.md5(col_of(text))


# Month names and abbreviations accepted in publication dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december"]


def month_number(month) -> Column:
    """Numeric month from '3', '03', 'Mar' or 'March'; NULL if unknown."""
    m = F.lower(F.trim(col_of(month)))
    names = F.create_map(*[x for i, n in enumerate(MONTHS)
                           for x in (F.lit(n), F.lit(i + 1))])
    full = F.create_map(*[x for i, n in enumerate(MONTH_NAMES)
                          for x in (F.lit(n), F.lit(i + 1))])
    numeric = F.when(m.rlike("^[0-9]{1,2}$"), m.cast("int"))
    return F.coalesce(numeric, F.element_at(names, m), F.element_at(full, m))


def alias_list(symbol, name, aliases, sep: str = r"\|") -> Column:
    """[symbol, name] followed by the split alias field (NULL gives nothing)."""
    parts = F.coalesce(F.split(col_of(aliases), sep), F.array().cast("array<string>"))
    return F.concat(F.array(col_of(symbol), col_of(name)), parts)


def alias_set(label, synonyms) -> Column:
    """[label] + distinct synonyms other than the label."""
    syn = F.coalesce(col_of(synonyms), F.array().cast("array<string>"))
    return F.concat(F.array(col_of(label)),
                    F.array_except(F.array_distinct(syn), F.array(col_of(label))))


def join_definition(parts) -> Column:
    return F.array_join(col_of(parts), " ")


def occurrence_starts(text, label) -> Column:
    """1-based start of every (possibly overlapping) occurrence of label in text."""
    t, l = col_of(text), col_of(label)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                    lambda i: F.substr(t, i, F.length(l)) == l)


def annotation_span_start(text, label, n) -> Column:
    """0-based start of the (n+1)-th occurrence of label, NULL if there is none.

    ``substring_index`` looks for the next occurrence one place after the last, so
    it finds overlapping ones too, and gives the whole text if there are too few."""
    t, l, k = col_of(text), col_of(label), (col_of(n) + 1).cast("int")
    before = F.length(F.call_function("substring_index", t, l, k))
    return (F.when((F.length(l) > 0) & (k > 0), F.when(before < F.length(t), before))
            .otherwise(F.try_element_at(occurrence_starts(t, l), k) - 1))


def count_preceding_matches(text, label, position) -> Column:
    """Occurrences of label that start before a 0-based position.

    They lie in the text up to the position and the rest of a label; a look-ahead
    finds overlapping ones."""
    t, l, p = col_of(text), col_of(label), col_of(position)
    head = F.substr(t, F.lit(1), F.least(F.length(t), F.ceil(p) + F.length(l) - 1).cast("int"))
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(l, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return (F.when((F.length(l) > 0) & (p > 0), F.coalesce(F.regexp_count(head, quoted), F.lit(0)))
            .otherwise(F.size(F.filter(occurrence_starts(t, l), lambda s: s - 1 < p))))


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length numeric arrays (NULL if a norm is 0)."""
    a, b = col_of(a), col_of(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))


def pad_sequence(ids, width: int = 500) -> Column:
    """Last ``width`` ids, right-padded with zeros to exactly ``width``."""
    ids = col_of(ids)
    n = F.size(ids)
    kept = F.when(n > width, F.slice(ids, n - width + 1, width)).otherwise(ids)
    return F.concat(kept, F.array_repeat(F.lit(0), F.lit(width) - F.size(kept)))
