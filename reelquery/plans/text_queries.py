"""Text retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery.operators import text_search
from reelquery.operators.ordered import spread
from reelquery.plans.join_queries import DEPTH, catalogue
from reelquery.plans import search
from reelquery.plans.registry import query


@query("tokenize_simple", "SELECT doc_id, pos, term FROM v_words")
def tokenize_simple(t):
    return text_search.tokenize(documents(t), "doc_id")


@query(
    "postings",
    """SELECT term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions
      FROM v_words GROUP BY term, doc_id""",
)
def postings(t):
    index = text_search.postings(t.documents, "doc_id")
    texts = F.transform("positions", lambda p: p.cast("string"))
    return index.select("term", "doc_id", "tf", F.array_join(texts, ",").alias("positions"))


def documents(t):
    return spread(t.documents.select("doc_id", "text"))


def terms(t):
    return text_search.query_terms(t.v_text_queries)


@query("match_all_terms", "SELECT query_id, doc_id FROM v_matches")
def match_all_terms(t):
    return text_search.match_all_terms(documents(t), terms(t), "doc_id").select(
        "query_id", "doc_id"
    )


@query("cover_density_rank", "SELECT query_id, doc_id, n_covers, score FROM v_text_scores")
def cover_density_rank(t):
    ranked = text_search.text_rank(documents(t), t.v_text_queries, "doc_id")
    return ranked.withColumn("score", F.round("score", 6))


@query("minimal_covers", "SELECT query_id, doc_id, start_pos, end_pos, noise FROM v_covers")
def minimal_covers(t):
    matches = text_search.match_all_terms(documents(t), terms(t), "doc_id")
    return text_search.covers(text_search.term_positions(matches, "doc_id"), "doc_id")


@query(
    "text_search",
    """SELECT query_id, asset_id, file_id, media_type, start_s, end_s, score, channel_rank
      FROM v_text_hits""",
)
def full_text_search(t):
    return search.text_hits(catalogue(t), t.v_text_queries, DEPTH).select(
        "query_id", "asset_id", "file_id", "media_type", "start_s", "end_s", "score",
        "channel_rank",
    )


@query(
    "fts_debug",
    """SELECT d.doc_id, left(text, 80) AS preview, coalesce(w.tokens, '') AS tokens FROM documents d
      LEFT JOIN (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS tokens FROM (SELECT DISTINCT
        doc_id, term FROM v_words) GROUP BY doc_id) w USING (doc_id)""",
)
def fts_debug(t):
    return text_search.fts_debug(t.documents, "doc_id", "text")
