"""DuckDB twins of the adapter views, used by the oracle SQL of every query.

The driver registers the raw tables (documents, labels, ...) as DuckDB views.
A query's oracle text is ``WITH <needed adapters> <body>``; the adapters are
the same derivations as :mod:`pubsift.sources.tables`, written in DuckDB's
dialect (RE2 regexes, 1-based lists, ``lambda x:`` syntax).
"""

from __future__ import annotations

import re

from pubsift.functions.text import TOKEN_RUN

VIEWS: dict[str, str] = {
    "articles": r"""
select doc_id as pmid, 1 as version,
       regexp_extract(text, '^[^.!?\n]*', 0) as title,
       substr(text, length(regexp_extract(text, '^[^.!?\n]*', 0)) + 2) as content,
       cast(date '1990-01-01' + cast((doc_id * 37) % 12000 as int) as date) as date,
       0 as file_pos, cast(doc_id as int) as article_pos, lang, source
from documents""",
    "articles_versions": r"""
select pmid, version, title, content, date, file_pos, article_pos from articles
union all
select pmid, 2 as version, title, concat(content, ' Revised.') as content, date,
       1 as file_pos, article_pos
from articles where pmid % 10 = 0""",
    "mesh": r"""
select pmid, concat('L_', lang) as meshid from articles
union all select pmid, concat('S_', source) from articles
union all select doc_id, 'Q_high' from labels where quality = 1
union all select doc_id, 'Q_toxic' from labels where toxic = 1""",
    "dictionary": r"""
select distinct upper(replace(w, 'ß', 'ss')) as symbol, w as alias
from (select unnest(regexp_extract_all(lower(text), 'TOKEN_RUN')) as w from benchmark) t
where length(w) >= 7""",
    "ranked": r"""
select symbol, cast(row_number() over (order by md5(symbol), symbol) as double) as rank,
       row_number() over (order by md5(symbol), symbol) as pos
from (select distinct symbol from dictionary) t""",
    "word_vectors": r"""
select 'w' || cast(vec_id as varchar) as word, embedding as vector, label from embeddings""",
    "embedding_a": r"""
select 'w' || cast(vec_id as varchar) as word, embedding as vector, label
from embeddings where vec_id % 3 <> 0""",
    "embedding_b": r"""
select 'w' || cast(vec_id as varchar) as word, list_reverse(embedding) as vector, label
from embeddings where vec_id % 3 <> 1""",
    "annotation_events": r"""
select event_id, ts, cast(user_id % 10 as int) as gid, cast(user_id as int) as docid,
       cast(event_id % 20 as int) as annot_id,
       case event_type when 'purchase' then 'delete'
                       when 'view' then 'doc_annotation'
                       else 'segment_annotation' end as type,
       event_type as tag, value
from events""",
    "gene_names": r"""
select hgnc_id, upper(replace(w[1], 'ß', 'ss')) as symbol, w[2] as name,
       case when len(w) > 2 then array_to_string(w[3:], '|') end as alias_symbol
from (select item_id as hgnc_id, list_filter(w0, lambda x, i: list_position(w0, x) = i) as w
      from (select item_id, list_filter(regexp_extract_all(lower(text), 'TOKEN_RUN'),
                                        lambda x: length(x) >= 7) as w0 from benchmark) a) b
where len(w) >= 1""",
}

DEPENDS = {
    "articles_versions": ["articles"],
    "mesh": ["articles"],
    "ranked": ["dictionary"],
}


def _needed(body: str) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            visit(dep)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    return order


def with_views(body: str, ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` with the adapter views it mentions (and extra CTEs)."""
    kw = "with recursive " if recursive else "with "
    parts = [f"{n} as ({VIEWS[n].replace('TOKEN_RUN', TOKEN_RUN)}\n)" for n in _needed(body + ctes)]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        # The body has CTEs of its own: append them after the adapters.
        if not parts:
            return body
        return kw + ",\n".join(parts) + ",\n" + stripped[5:]
    if not parts:
        return body
    return kw + ",\n".join(parts) + "\n" + body


def sql_list(values) -> str:
    """A SQL list literal of strings: ['a', 'b']."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
