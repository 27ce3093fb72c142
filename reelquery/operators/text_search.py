"""Full-text match and cover-density rank over blocks of postings.

A task turns its texts into blocks: one term in one range of document ids, with delta-coded documents and
positions and the largest term frequency. Tokens are never exchanged, blocks are. A search reads the blocks
of its own terms, from a stored index or made for those terms in one pass over the texts. It works per
(query, range): a range is looked at only if it has a block of every term, and a frequent term is spread
over all its ranges.

A document's covers number at most its smallest term frequency, so the blocks bound the scores of a range. A
top-k search scores the ranges with the highest bounds first and then only those whose bound reaches the
k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators import posting_tasks as tasks
from reelquery.operators.ordered import spread, top_per_group
from reelquery.session import checkpointed

SALTS = 16
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order; no stop words, no stemming."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def tokenize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per token with its 1-based position."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term")).select(
        key, (F.col("pos") + 1).cast("bigint").alias("pos"), "term"
    )


#: Distinct terms of queries that are sent to the tasks; with more of them all terms are packed.
WANTED_TERMS = 200_000
#: Folders of a stored index.
BUCKETS = 64
#: Ranges of a query that are scored first.
FIRST_RANGES = 8


def block_index(docs: DataFrame, key: str, text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """Blocks of postings (``posting_tasks.BLOCK_SCHEMA``) of all terms or those in ``wanted`` (term).

    ``key`` is a whole number; rows without one are left out, and rows that share one count as one document.
    """
    chosen = None
    if wanted is not None:
        listed = wanted.select("term").distinct().limit(WANTED_TERMS + 1).collect()
        chosen = {r["term"] for r in listed} if len(listed) <= WANTED_TERMS else None
    rows = spread(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")))
    listed = rows.select("key", tokens(F.col("text")).alias("tokens")).filter("key IS NOT NULL AND tokens IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tasks.pack_tokens(batches, chosen)

    blocks = _merged(listed.mapInArrow(run, tasks.BLOCK_SCHEMA))
    return blocks.join(wanted.select("term").distinct(), "term", "left_semi") if wanted is not None and chosen is None else blocks


def _merged(parts: DataFrame) -> DataFrame:
    """One block per term and range; a frequent term is dealt by range."""
    dealt = parts.repartition("term", "doc_range").sortWithinPartitions("term", "doc_range")
    return dealt.mapInArrow(tasks.merge_blocks, tasks.BLOCK_SCHEMA)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(blocks: DataFrame, path: str) -> None:
    """Store blocks by hash of their term, in order of terms, so that a search opens the folders of its terms."""
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod("doc_range", F.lit(SALTS)))
    dealt.sortWithinPartitions("bucket", "term", "doc_range").write.partitionBy("bucket").parquet(path)


def postings(
    docs: DataFrame, key: str, text: str = "text", wanted: DataFrame | None = None
) -> DataFrame:
    """Inverted index rows (term, document, positions, tf), of all terms or those in ``wanted`` (term)."""
    schema = "term string, key bigint, positions array<bigint>, tf bigint"
    return block_index(docs, key, text, wanted).mapInArrow(tasks.posting_rows, schema).withColumnRenamed("key", key)


def _blocks(index: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The blocks of the wanted terms in an index of blocks or of ``postings`` rows."""
    if "bucket" in index.columns:
        folders = [r["bucket"] for r in wanted.select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]
        index = index.filter(F.col("bucket").isin(folders)).drop("bucket")
    own = index.join(wanted.select("term").distinct(), "term", "left_semi")
    if "docs" in index.columns:
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tasks.pack_rows(batches)

    rows = own.select("term", F.col(key).cast("bigint").alias("key"), F.col("positions").cast("array<bigint>").alias("positions"))
    return _merged(rows.mapInArrow(run, tasks.BLOCK_SCHEMA))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query_text") -> DataFrame:
    """Queries with their distinct terms; a query without a term matches nothing."""
    return queries.select(key, F.array_distinct(tokens(F.col(text))).alias("terms")).filter(
        F.size("terms") > 0
    )


class _Search:
    """Queries with terms met with blocks: the ranges in which a query has all its terms, and its blocks there."""

    def __init__(self, docs: DataFrame | None, queries: DataFrame, key: str, text: str, index: DataFrame | None):
        self.key = key
        self.wanted = checkpointed(queries.select(
            F.col("query_id").cast("bigint").alias("query_id"), F.size("terms").alias("n_terms"), F.explode("terms").alias("term")
        ))
        made = block_index(docs, key, text, self.wanted) if index is None else _blocks(index, key, self.wanted)
        self.blocks = checkpointed(made)

    def ranges(self) -> DataFrame:
        """(query_id, doc_range, bound): ranges with all terms of a query; no document has more covers than bound."""
        met = self.wanted.join(self.blocks.select("term", "doc_range", "max_tf"), "term")
        per_term = met.groupBy("query_id", "n_terms", "doc_range", "term").agg(F.max("max_tf").alias("max_tf"))
        return per_term.groupBy("query_id", "n_terms", "doc_range").agg(
            F.count(F.lit(1)).alias("n"), F.min("max_tf").alias("bound")
        ).filter("n = n_terms").select("query_id", "doc_range", "bound")

    def _groups(self, ranges: DataFrame) -> DataFrame:
        """(query_id, doc_range, n_terms, hits): the blocks of a query in a range, one per term."""
        needed = ranges.select("query_id", "doc_range").join(self.wanted, "query_id")
        hits = F.collect_list(F.struct("term", "docs", "tfs", "positions")).alias("hits")
        return needed.join(self.blocks, ["term", "doc_range"]).groupBy("query_id", "doc_range", "n_terms").agg(hits)

    def matches(self, ranges: DataFrame) -> DataFrame:
        found = self._groups(ranges).mapInArrow(tasks.match_rows, tasks.MATCH_SCHEMA)
        return found.withColumnRenamed("key", self.key)

    def ranked(self, ranges: DataFrame) -> DataFrame:
        """(query_id, document, n_covers, score) of all documents with all terms."""
        weight = C.COVER_WEIGHT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return tasks.rank_rows(batches, weight)

        return self._groups(ranges).mapInArrow(run, tasks.RANK_SCHEMA).withColumnRenamed("key", self.key)


def match_all_terms(
    docs: DataFrame | None, queries: DataFrame, key: str, text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """(query, document, hits) where every query term occurs; ``hits`` are its terms with positions.

    ``index`` is a stored ``block_index`` (or ``postings``) of the documents; without it the texts are read
    once, for the terms of the queries.
    """
    search = _Search(docs, queries, key, text, index)
    return search.matches(search.ranges())


def term_positions(matches: DataFrame, key: str) -> DataFrame:
    """Positions of query terms in each matched document."""
    return matches.select("query_id", key, F.explode("hits").alias("h")).select(
        "query_id", key, "h.term", F.explode("h.positions").alias("pos")
    )


def covers(positions: DataFrame, key: str) -> DataFrame:
    """Minimal covers: spans that hold every term and contain no smaller such span.

    A span starting at p can end no earlier than the next occurrence of every term first seen
    before p, and must end before p's own term comes again. One group is one document.
    """
    doc = ["query_id", key]
    by_term = Window.partitionBy(*doc, "term").orderBy("pos")
    by_doc = Window.partitionBy(*doc).orderBy("pos")
    numbered = positions.withColumns(
        {
            "n": F.row_number().over(by_doc),
            "next_pos": F.lead("pos").over(by_term),
            "is_first": F.row_number().over(by_term) == 1,
        }
    ).withColumn("next_n", F.lead("n").over(by_term))
    earlier = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*doc)
    forever = F.lit(2**62)
    bounded = numbered.withColumns(
        {
            "again": F.coalesce(F.max(F.coalesce("next_pos", forever)).over(earlier), F.lit(0)),
            "again_n": F.coalesce(F.max(F.coalesce("next_n", forever)).over(earlier), F.lit(0)),
            "all_seen": F.max(F.when(F.col("is_first"), F.col("pos"))).over(whole),
            "all_seen_n": F.max(F.when(F.col("is_first"), F.col("n"))).over(whole),
        }
    ).withColumns(
        {
            "end_pos": F.greatest("again", "all_seen", "pos"),
            "end_n": F.greatest("again_n", "all_seen_n", "n"),
        }
    )
    valid = F.col("end_pos") < F.coalesce("next_pos", forever)
    return bounded.filter(valid).select(
        *doc, F.col("pos").alias("start_pos"), "end_pos",
        (F.col("end_pos") - F.col("pos") - (F.col("end_n") - F.col("n"))).alias("noise"),
    )


def text_rank(
    docs: DataFrame | None, queries: DataFrame, key: str, text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """Rank per (query, document) that has all terms: sum over minimal covers of w / (1 + other words inside)."""
    search = _Search(docs, query_terms(queries), key, text, index)
    return search.ranked(search.ranges())


def text_search(
    chunks: DataFrame, files: DataFrame, libraries: DataFrame, queries: DataFrame, depth: int,
    index: DataFrame | None = None, filters: DataFrame | None = None,
) -> DataFrame:
    """Top ``depth`` transcript chunks per query over active files and libraries.

    chunks: asset_id, file_id, asset_type, start_s, end_s, scene_id, text_content; ``index``: a stored
    ``block_index`` of them by asset_id, with which no text is read; ``filters``: query_id, library_ids,
    media_types, of which a null admits everything. Filters act before the depth is cut.
    """
    live_files = files.filter(~F.col("is_deleted")).select(
        "file_id", "library_id", "media_type", "path"
    )
    live_libraries = libraries.filter(~F.col("is_deleted")).select("library_id")
    spoken = chunks.filter(F.col("asset_type") == "text_chunk")
    # Texts are packed where they are read; only ids meet the catalogue.
    search = _Search(spoken if index is None else None, query_terms(queries), "asset_id", "text_content", index)
    facts = (
        spoken.select("asset_id", "file_id", "scene_id", "start_s", "end_s")
        .join(live_files.filter(F.col("media_type").isin("image", "audio", "video")), "file_id")
        .join(live_libraries, "library_id", "left_semi")
    )

    def best(ranges: DataFrame, above: DataFrame | None = None) -> DataFrame:
        hits = search.ranked(ranges).withColumn("score", F.round("score", 6)).join(facts, "asset_id")
        if filters is not None:
            hits = admitted(hits, filters)
        hits = hits.drop("library_id")
        return top_per_group(
            hits if above is None else above.drop("channel_rank").unionByName(hits), ["query_id"],
            [F.desc("score"), F.asc_nulls_last("start_s"), F.asc("asset_id")], depth, "channel_rank", SALTS,
        )

    # A narrow row per range that has all terms of a query.
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("doc_range"))
    ranges = checkpointed(search.ranges().withColumn("place", F.row_number().over(by_bound)))
    top = best(ranges.filter(F.col("place") <= FIRST_RANGES))
    rest = ranges.filter(F.col("place") > FIRST_RANGES)
    if not rest.isEmpty():
        top = checkpointed(top)
        reached = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= depth)
        # Scores are rounded, so a bound within that of the last one may still reach it.
        within = F.col("bound") * C.COVER_WEIGHT + 1e-6 >= F.coalesce("least", F.lit(0.0))
        top = best(rest.join(reached, "query_id", "left").filter(within), top)
    # The depth counts every chunk; only speech of audio and video gives a reason afterwards.
    return top.filter(F.col("media_type").isin("audio", "video")).withColumn(
        "reason", F.lit("transcript_match")
    )


def admitted(hits: DataFrame, filters: DataFrame) -> DataFrame:
    """Hits (query_id, library_id, media_type) that their query's filter row admits.

    A query without a filter row, or with a null list, admits everything.
    """
    lists = filters.select("query_id", "library_ids", "media_types")
    allows = lambda names, c: F.coalesce(F.array_contains(names, F.col(c)), F.col(names).isNull())
    return hits.join(lists, "query_id", "left").filter(
        allows("library_ids", "library_id") & allows("media_types", "media_type")
    ).drop("library_ids", "media_types")


def fts_debug(assets: DataFrame, key: str, text: str) -> DataFrame:
    """Preview of a text and its sorted distinct tokens."""
    return assets.select(
        key, F.substring(text, 1, 80).alias("preview"),
        F.array_join(F.array_sort(F.array_distinct(tokens(F.col(text)))), " ").alias("tokens"),
    )
