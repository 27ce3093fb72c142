"""Catalogue lookups for tables of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.operators.hydration import frame_time, is_stale
from reelquery.operators.ordered import paged_lists, top_per_group


def pending_refs(refs: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """Pending refs of live files not waiting to be purged, with what an embedding job needs."""
    asset = assets.select(
        "asset_id", "asset_type", F.col("path").alias("asset_path"), "start_s", "end_s",
        "frame_time_s",
    )
    file = files.filter(~F.col("is_deleted") & (F.col("index_status") != "purge_queued")).select(
        "file_id", F.col("path").alias("file_path"), "media_type"
    )
    return (
        refs.filter((F.col("status") == "pending") & F.col("collection").isin(C.COLLECTIONS))
        .join(asset, "asset_id")
        .join(file, "file_id")
    )


def oldest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.asc("created_at"), F.asc("ref_id")).limit(limit)


REF_KEY = ["asset_id", "collection", "model_name", "model_version"]


def last_attempts(jobs: DataFrame) -> DataFrame:
    """Latest embedding attempt per (asset, collection, model, version); a missing part of the
    key is empty text."""
    attempts = jobs.filter(
        F.col("job_type").isin(C.EMBEDDING_JOB_TYPES) & F.col("status").isin(C.ATTEMPTED_STATUSES)
    )
    key = [
        F.coalesce(F.get_json_object("input_json", f"$.{name}"), F.lit("")).alias(out)
        for name, out in [
            ("asset_id", "asset_id"), ("collection", "collection"), ("model_name", "model_name"),
            ("model_version", "model_version"),
        ]
    ]
    return attempts.select(*key, "created_at").groupBy(*REF_KEY).agg(
        F.max("created_at").alias("last_attempt")
    )


def unattempted(refs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Refs with no attempt at or after their last change."""
    last = last_attempts(jobs)
    keyed = refs.withColumn("_asset", F.col("asset_id").cast("string"))
    same = keyed["_asset"] == last["asset_id"]
    for name in REF_KEY[1:]:
        same = same & (keyed[name] == last[name])
    joined = keyed.join(last.select(*REF_KEY, "last_attempt"), same, "left")
    return joined.filter(
        F.col("last_attempt").isNull() | (F.col("last_attempt") < keyed["updated_at"])
    ).select(*[keyed[c] for c in refs.columns])


def embedding_job_rows(pending: DataFrame) -> DataFrame:
    """Typed job payload per pending ref. The field set depends on the collection; absent fields
    are NULL and to_json leaves them out."""
    collection = F.col("collection")
    source = F.coalesce("asset_path", "file_path")
    job_type: Column = F.lit(None).cast("string")
    for name, config in C.COLLECTION_REGISTRY.items():
        job_type = F.when(collection == name, config["job_type"]).otherwise(job_type)
    frame = collection == "video_frame_vectors"
    payload = F.to_json(
        F.struct(
            F.col("asset_id").cast("string").alias("asset_id"),
            F.when(collection == "image_vectors", source).alias("path"),
            F.when(frame, source).alias("frame_path"),
            F.when(
                frame, frame_time(F.col("frame_time_s"), F.col("start_s"), F.col("end_s"))
            ).alias("frame_time_seconds"),
            "collection", "model_name", "model_version",
        )
    )
    return pending.select(
        "ref_id", job_type.alias("job_type"), "file_id", payload.alias("input_json")
    )


def job_file_ids(jobs: DataFrame) -> DataFrame:
    """(job, file): the file column or the payload's file id; a job naming both counts for each."""
    named = F.array(
        F.col("file_id").cast("string"), F.get_json_object("input_json", "$.file_id")
    )
    return jobs.withColumn("ref_file_id", F.explode(F.array_distinct(F.array_compact(named))))


def active_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Queued or running index jobs of the given files."""
    busy = jobs.filter(
        F.col("job_type").isin(C.INDEX_JOB_TYPES) & F.col("status").isin("queued", "running")
    )
    keys = files.select(F.col("file_id").cast("string").alias("ref_file_id")).distinct()
    return job_file_ids(busy).join(keys, "ref_file_id", "left_semi")


def reindex_admission(requests: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outcome per requested file: missing, conflict (with the number of jobs in the way) or
    admitted."""
    known = files.filter(~F.col("is_deleted")).select("file_id", F.lit(True).alias("_known"))
    busy = active_jobs(jobs, requests).groupBy("ref_file_id").agg(
        F.count(F.lit(1)).alias("n_active")
    )
    joined = requests.select("file_id").distinct().join(known, "file_id", "left").join(
        busy, F.col("file_id").cast("string") == busy["ref_file_id"], "left"
    )
    return joined.select(
        "file_id", F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("n_active") > 0, "conflict")
        .otherwise("admitted")
        .alias("outcome"),
    )


def admit_reindex(admission: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Admitted files marked for purging, with their purge jobs."""
    ok = admission.filter(F.col("outcome") == "admitted").select("file_id")
    marked = files.join(ok.withColumn("_ok", F.lit(True)), "file_id", "left").withColumn(
        "index_status",
        F.when(F.col("_ok").isNotNull(), "purge_queued").otherwise(F.col("index_status")),
    ).drop("_ok")
    jobs = ok.select(F.lit("purge_video_index").alias("job_type"), "file_id")
    return {"files": marked, "jobs": jobs}


PATH_KEYS = ["path", "frame_path", "root_path", "export_path"]


def job_file_paths(jobs: DataFrame, files: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct paths per job: literal path keys, then the file's path, then its assets' files'.

    Every payload is parsed once, into rows (stage, place, key); those that name a file or an asset meet
    one table of paths. The lists put together hold one job's own paths.
    """
    fields = ", ".join(f"{k} STRING" for k in [*PATH_KEYS, "file_id", "asset_id"])
    parsed = F.from_json("input_json", f"{fields}, asset_ids ARRAY<STRING>")
    some = lambda c: F.when(c != "", c)
    staged = lambda stage, keys: F.transform(
        keys, lambda k, at: F.struct(F.lit(stage).alias("stage"), at.alias("at"), k.alias("key"))
    )
    entries = F.concat(
        staged(0, F.array_compact(F.array(*[some(F.col(f"p.{k}")) for k in PATH_KEYS]))),
        staged(1, F.array_compact(F.array(some(F.col("p.file_id"))))),
        staged(2, F.concat(
            F.array_compact(F.array(some(F.col("p.asset_id")))),
            F.coalesce(F.col("p.asset_ids"), F.array().cast("array<string>")),
        )),
    )
    keyed = jobs.select("job_id", parsed.alias("p")).select("job_id", F.explode(entries).alias("e"))
    of_file = files.select(
        F.lit(1).alias("stage"), F.col("file_id").cast("string").alias("key"), F.col("path").alias("found")
    )
    of_asset = assets.select("asset_id", "file_id").join(files.select("file_id", "path"), "file_id").select(
        F.lit(2).alias("stage"), F.col("asset_id").cast("string").alias("key"), F.col("path").alias("found")
    )
    long = (
        keyed.select("job_id", "e.*")
        .join(of_file.unionByName(of_asset), ["stage", "key"], "left")
        .withColumn("path", F.when(F.col("stage") == 0, F.col("key")).otherwise(F.col("found")))
        .filter(F.col("path").isNotNull())
    )
    first = long.groupBy("job_id", "path").agg(F.min(F.struct("stage", "at")).alias("o"))
    paths = first.groupBy("job_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("o", "path"))), lambda x: x["path"]).alias(
            "file_paths"
        )
    )
    return jobs.select("job_id").join(paths, "job_id", "left").withColumn(
        "file_paths", F.coalesce("file_paths", F.array().cast("array<string>"))
    )


def refs_for_embedding(requests: DataFrame, refs: DataFrame, assets: DataFrame, files: DataFrame):
    """Ref, asset and file facts by (asset, collection, model, version)."""
    asset = assets.select(
        "asset_id", "asset_type", "start_s", "end_s", "frame_time_s", "text_content", "scene_id"
    )
    return (
        requests.select(*REF_KEY).distinct().join(refs, REF_KEY)
        .join(asset, "asset_id")
        .join(files.select("file_id", "media_type"), "file_id")
    )


def caption_sources(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Image assets with the asset's own path, else the file's."""
    file = files.select("file_id", F.col("path").alias("file_path"), "library_id", "media_type")
    return assets.filter(F.col("asset_type") == "image").join(file, "file_id").select(
        "asset_id", "file_id", "library_id", "media_type",
        F.coalesce("path", "file_path").alias("path"),
    )


def scenes_with_file(scenes: DataFrame, files: DataFrame) -> DataFrame:
    return scenes.join(files.select("file_id", "library_id", "path"), "file_id")


def file_graph(files: DataFrame, assets: DataFrame, refs: DataFrame) -> DataFrame:
    """A file's assets and refs as nested lists, one row per (file, kind, page).

    Two aggregations, never one joined fan-out. A list is cut into pages, so a file with very many
    assets is many rows and not one huge array; a file without any has one row without a list.
    """
    nested = paged_lists(assets, ["file_id"], ["asset_id"], ["asset_id", "asset_type"], "asset")
    nested_refs = paged_lists(refs, ["file_id"], ["ref_id"], ["ref_id", "status"], "ref")
    return files.join(nested.unionByName(nested_refs), "file_id", "left")


def media_detail(files: DataFrame, assets: DataFrame, shown: int = 50) -> DataFrame:
    """File with its first ``shown`` live assets; the total counts stale ones too."""
    totals = assets.groupBy("file_id").agg(F.count(F.lit(1)).alias("assets_total"))
    live = assets.filter(~is_stale(F.col("metadata_json")))
    first = top_per_group(live, ["file_id"], [F.asc("created_at"), F.asc("asset_id")], shown, "n")
    nested = first.groupBy("file_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("n", "asset_id", "asset_type", "text_content",
                                                 F.col("path").alias("cache_path")))),
            lambda a: a.dropFields("n"),
        ).alias("assets")
    )
    return (
        files.join(totals, "file_id", "left")
        .join(nested, "file_id", "left")
        .withColumn("assets_total", F.coalesce("assets_total", F.lit(0)))
    )


def agent_run_report(runs: DataFrame, events: DataFrame, calls: DataFrame) -> DataFrame:
    """Run with its ordered events and tool calls as paged lists (see ``file_graph``)."""
    by_time = ["created_at", "event_id"]
    nested = paged_lists(events, ["run_id"], by_time, ["event_id", "event_type"], "event")
    by_time = ["created_at", "tool_call_id"]
    calls_nested = paged_lists(calls, ["run_id"], by_time, ["tool_call_id", "tool_name"], "call")
    return runs.join(nested.unionByName(calls_nested), "run_id", "left")


#: Windows in one node of the time tree before the node is split.
HOT_NODE = 20_000


def _tree_nodes(low: Column, high: Column) -> Column:
    """(level, node) of the fewest nodes of a binary tree over whole numbers that cover low to high: at most two a level.

    At level k a node is 2 ** k leaves. From the leaves up, a range that begins at an odd node gives that node
    away, one that ends at an even node gives that one away, and the rest goes on at the next level.
    """
    def step(state: Column, k: Column) -> Column:
        a, b = state["a"], state["b"]
        first, last = (a <= b) & (F.pmod(a, F.lit(2)) == 1), (a <= b) & (F.pmod(b, F.lit(2)) == 0)
        given = F.array_compact(F.array(
            F.when(first, F.struct(k.alias("level"), a.alias("node"))),
            F.when(last & ~(first & (a == b)), F.struct(k.alias("level"), b.alias("node"))),
        ))
        up = F.struct(
            F.floor((a + first.cast("bigint")) / 2).cast("bigint").alias("a"),
            F.floor((b - last.cast("bigint")) / 2).cast("bigint").alias("b"),
            F.concat(state["nodes"], given).alias("nodes"),
        )
        return F.when(a <= b, up).otherwise(state)

    empty = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(low.cast("bigint").alias("a"), high.cast("bigint").alias("b"), empty.alias("nodes"))
    # As many levels as the length has binary digits, and one for ranges across a border.
    levels = F.length(F.bin(high - low + 1)) + 1
    return F.aggregate(F.sequence(F.lit(0), levels.cast("int")), start, step)["nodes"]


def window_overlaps(
    left: DataFrame, right: DataFrame, width: float, left_id: str, right_id: str
) -> DataFrame:
    """Pairs of windows of one file that overlap for a positive time.

    Two windows overlap where the later one starts inside the other, so a pair is found once, by that start.
    Time is a binary tree over leaves of ``width`` seconds: a window stands at the nodes that cover it, at
    most two a level, however long it is, and its start is looked up at the nodes above its leaf, of the
    levels that are in use. A node with more than ``HOT_NODE`` windows is split by salt, and the starts
    looked up there are copied to each part.
    """
    def windows(df: DataFrame, key: str, prefix: str) -> DataFrame:
        return df.filter(F.col("end_s") > F.col("start_s")).select(
            "file_id", F.col(key).alias(f"{prefix}_id"), F.col("start_s").alias(f"{prefix}_start"), F.col("end_s").alias(f"{prefix}_end")
        )

    leaf = lambda name: F.floor(F.col(name) / width).cast("bigint")

    def stabbed(outer: DataFrame, o: str, inner: DataFrame, i: str, strict: bool) -> DataFrame:
        """Pairs in which the ``inner`` window starts inside the ``outer`` one (``strict``: after its start)."""
        nodes = F.explode(_tree_nodes(leaf(f"{o}_start"), leaf(f"{o}_end"))).alias("n")
        standing = outer.select("*", nodes).select("*", "n.level", "n.node").drop("n")
        top = standing.agg(F.coalesce(F.max("level"), F.lit(0)).alias("top")).scalar()
        hot = standing.groupBy("file_id", "level", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_NODE).select(
            "file_id", "level", "node", F.ceil(F.col("n") / HOT_NODE).cast("int").alias("parts")
        )
        place = ["file_id", "level", "node"]
        parts = F.coalesce("parts", F.lit(1))
        standing = standing.join(hot, place, "left").withColumn("part", F.pmod(F.xxhash64(f"{o}_id"), parts).cast("int"))
        starts = inner.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn(
            "node", F.floor(leaf(f"{i}_start") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
        ).join(hot, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        after = F.col(f"{i}_start") > F.col(f"{o}_start") if strict else F.col(f"{i}_start") >= F.col(f"{o}_start")
        met = standing.drop("parts").join(starts.drop("parts"), [*place, "part"])
        return met.filter(after & (F.col(f"{i}_start") < F.col(f"{o}_end"))).drop("level", "node", "part")

    a, b = windows(left, left_id, "left"), windows(right, right_id, "right")
    return stabbed(a, "left", b, "right", False).unionByName(stabbed(b, "right", a, "left", True))


def point_lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Active rows for a table of ids."""
    return table.filter(~F.col("is_deleted")).join(ids.select(key).distinct(), key, "left_semi")


def best_frames_by_scene(hits: DataFrame, shown: int = C.MAX_DIAGNOSTIC_FRAMES) -> DataFrame:
    """First complete frame per (file, scene) in channel order, at most ``shown`` per query, with
    the number of incomplete rows. A channel holds at most its depth per query."""
    video = hits.filter(F.col("media_type") == "video")
    complete = F.col("scene_id").isNotNull() & F.col("start_s").isNotNull()
    order = [F.asc("source_rank")]
    firsts = top_per_group(video.filter(complete), ["query_id", "file_id", "scene_id"], order, 1)
    shown_frames = top_per_group(firsts, ["query_id"], order, shown, "position")
    incomplete = video.groupBy("query_id").agg(
        F.count_if(~complete).alias("incomplete_count")
    )
    return shown_frames.join(incomplete, "query_id")


