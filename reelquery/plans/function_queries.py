"""Scalar, array, JSON and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import formatting, identifiers, vectors
from reelquery.functions.scoring import clamp
from reelquery.operators import snapshots, temporal, vector_search
from reelquery.plans.registry import query
from reelquery.plans.upsert_queries import NAMESPACE, UUID_SQL


@query(
    "point_uuid5",
    f"""
    SELECT doc_id, {UUID_SQL} AS point_id FROM (SELECT doc_id, sha1({NAMESPACE} || encode(
      concat(doc_id, '|image_vectors|siglip|v1|image_embedding|', text))) AS h FROM documents)""",
)
def point_uuid5(t):
    """Named by whole document texts, so names are long and not plain ASCII."""
    point = identifiers.point_id(
        F.col("doc_id"), F.lit("image_vectors"), F.lit("siglip"), F.lit("v1"),
        F.lit("image_embedding"), F.col("text"),
    )
    return t.documents.select("doc_id", point.alias("point_id"))


@query(
    "strategy_fingerprint",
    """
    SELECT l_orderkey * 10 + l_linenumber AS row_id, sha256(concat('threshold=',
      format('{:g}', l_quantity), '|min_seconds=', format('{:g}', l_discount), '|max_seconds=',
      format('{:g}', l_extendedprice), '|interval_seconds=', format('{:g}', l_tax),
      '|layout=scene-frames-v3')) AS fingerprint FROM lineitem""",
)
def strategy_fingerprint(t):
    value = identifiers.strategy_fingerprint(
        F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax")
    )
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        value.alias("fingerprint"),
    )


@query(
    "content_fingerprint",
    """
    SELECT conv_id, turn, sha256(concat(conv_id, '|', turn, '|', format('{:g}', length(text) / 16),
      '||scene-caption-v2|v1|', text)) AS fingerprint FROM conversations""",
)
def content_fingerprint(t):
    """Two sources each, the second without a frame time."""
    ids = F.array("conv_id", "turn")
    times = F.array(F.length("text") / F.lit(16.0), F.lit(None).cast("double"))
    value = identifiers.caption_fingerprint(
        ids, times, F.lit(C.SCENE_PROMPT), F.lit("v1"), F.col("text")
    )
    return t.conversations.select("conv_id", "turn", value.alias("fingerprint"))


@query(
    "l2_normalize",
    """
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total,
      round(v[1] / n, 9) AS first_value, round(v[64] / n, 9) AS last_value
    FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id,
      list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 2)) AS v FROM embeddings))""",
)
def l2_normalize(t):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = t.embeddings.select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return unit.select(
        "vec_id", F.round(total, 6).alias("total"), F.round(F.col("u")[0], 9).alias("first_value"),
        F.round(F.element_at("u", -1), 9).alias("last_value"),
    )


@query(
    "cosine",
    """
    SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), p.embedding), 6)
      AS cosine FROM embeddings e JOIN v_prototypes p ON p.label = e.label""",
)
def cosine(t):
    """Each vector against the mean direction of its label."""
    means = t.v_prototypes.withColumnRenamed("embedding", "mean")
    joined = t.embeddings.join(means, "label")
    return joined.select(
        "vec_id", F.round(vectors.dot(F.col("embedding"), F.col("mean")), 6).alias("cosine")
    )


@query(
    "mean_pool",
    """
    SELECT label, round(list_sum(v) , 5) AS total, round(v[1], 6) AS first_value
    FROM (SELECT label, list(m / n ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m,
        sqrt(sum(avg(x) * avg(x)) OVER (PARTITION BY label)) AS n
      FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1)
        AS pos FROM embeddings WHERE embedding[1] > 0) GROUP BY label, pos) GROUP BY label)""",
)
def mean_pool(t):
    """Vectors as token vectors of their label; the mask keeps those with a positive first value."""
    masked = t.embeddings.withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    pooled = vector_search.masked_mean_pool(masked, "label", "embedding", "mask")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return pooled.select(
        "label", F.round(total, 5).alias("total"),
        F.round(F.col("embedding")[0], 6).alias("first_value"),
    )


@query(
    "mean_pool_values",
    """
    SELECT label, pos - 1 AS pos, round(m / n, 6) AS value FROM (SELECT label, pos, avg(x) AS m,
        sqrt(sum(avg(x) * avg(x)) OVER (PARTITION BY label)) AS n
      FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1)
        AS pos FROM embeddings WHERE embedding[1] > 0) GROUP BY label, pos)""",
)
def mean_pool_values(t):
    """Every value of the pooled vectors."""
    masked = t.embeddings.withColumn("mask", (F.col("embedding")[0] > 0).cast("int"))
    pooled = vector_search.masked_mean_pool(masked, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "value")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value")
    )


@query(
    "sample_times",
    """
    SELECT row_id, i + 1 AS n, (s + i * 2.5::DOUBLE + least(s + (i + 1) * 2.5::DOUBLE, e)) / 2
      AS frame_time
    FROM (SELECT row_id, s, e, unnest(range(0, CAST(ceil((e - s) / 2.5::DOUBLE) AS BIGINT))) AS i
      FROM (SELECT o_orderkey AS row_id, o_totalprice / 4096 AS s,
          o_totalprice / 4096 + o_custkey % 32 / CAST(4 AS DOUBLE) AS e FROM orders))""",
)
def sample_times(t):
    """Windows of zero to eight seconds; an empty one has no frame."""
    start = F.col("o_totalprice") / 4096
    end = start + F.col("o_custkey") % 32 / F.lit(4.0)
    times = temporal.sample_times(F.col("s"), F.col("e"))
    windows = t.orders.select(F.col("o_orderkey").alias("row_id"), start.alias("s"), end.alias("e"))
    return windows.select("row_id", F.posexplode(times).alias("i", "frame_time")).select(
        "row_id", (F.col("i") + 1).cast("bigint").alias("n"), "frame_time"
    )


@query(
    "fmt_g",
    """
    SELECT row_id, kind, printf('%g', x) AS text FROM (
      SELECT l_orderkey * 10 + l_linenumber AS row_id, unnest(['q', 'p', 'd', 'z', 'big', 'small'])
        AS kind, unnest([l_quantity / 64, l_extendedprice, -l_discount, 0 * l_quantity,
          l_extendedprice * 4096, l_discount / 65536]) AS x FROM lineitem)""",
)
def fmt_g(t):
    value = {
        "q": F.col("l_quantity") / 64, "p": F.col("l_extendedprice"), "d": -F.col("l_discount"),
        "z": F.col("l_quantity") * 0, "big": F.col("l_extendedprice") * 4096,
        "small": F.col("l_discount") / 65536,
    }
    items = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in value.items()])
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.explode(items).alias("i"),
    )
    return rows.select("row_id", "i.kind", formatting.fmt_g(F.col("i.x")).alias("text"))


@query(
    "json_get",
    """SELECT job_id, json_extract_string(input_json, '$.file_id') AS file_id,
      json_extract_string(input_json, '$.missing') AS missing FROM v_jobs""",
)
def json_get(t):
    get = lambda k: F.get_json_object("input_json", f"$.{k}").alias(k)
    return t.v_jobs.select("job_id", get("file_id"), get("missing"))


@query(
    "json_patch",
    """SELECT job_id, json_extract_string(input_json, '$.file_id') AS file_id,
      concat('/new/', job_id) AS path, CAST(priority AS VARCHAR) AS added,
      json_array_length(input_json, '$.asset_ids') AS n_assets FROM v_jobs""",
)
def json_patch(t):
    """One key replaced, one added, the rest (an array among them) kept."""
    patch = F.to_json(
        F.struct(
            F.concat(F.lit("/new/"), F.col("job_id").cast("string")).alias("path"),
            F.col("priority").alias("added"),
        )
    )
    merged = t.v_jobs.withColumn("j", snapshots.json_patch(F.col("input_json"), patch))
    get = lambda k: F.get_json_object("j", f"$.{k}").alias(k)
    return merged.select(
        "job_id", get("file_id"), get("path"), get("added"),
        F.json_array_length(F.get_json_object("j", "$.asset_ids")).cast("bigint").alias("n_assets"),
    )


@query(
    "json_array_flatten",
    """SELECT job_id, unnest(CAST(json_extract(input_json, '$.asset_ids') AS VARCHAR[]))
      AS asset_id FROM v_jobs""",
)
def json_array_flatten(t):
    items = F.from_json(F.get_json_object("input_json", "$.asset_ids"), "array<string>")
    return t.v_jobs.select("job_id", F.explode(items).alias("asset_id"))


PLAY = """CASE WHEN {0} >= 3600 THEN concat(CAST(floor({0} / 3600) AS BIGINT), ':',
    lpad(CAST(CAST(floor({0} % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0'), ':',
    lpad(CAST(CAST(floor({0} % 60) AS BIGINT) AS VARCHAR), 2, '0'))
  ELSE concat(CAST(floor({0} / 60) AS BIGINT), ':',
    lpad(CAST(CAST(floor({0} % 60) AS BIGINT) AS VARCHAR), 2, '0')) END"""


@query(
    "format_time_range",
    f"""SELECT o_orderkey, concat({PLAY.format('s')}, ' – ', {PLAY.format('e')}) AS label
      FROM (SELECT o_orderkey, o_totalprice / 40 AS s, o_totalprice / 40 + 59.5 AS e
        FROM orders)""",
)
def format_time_range(t):
    start = F.col("o_totalprice") / 40
    return t.orders.select(
        "o_orderkey", formatting.time_range(start, start + 59.5).alias("label")
    )


def _case(kind: str, column: str, fallback: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.LABELS[kind].items())
    return f"CASE {column} {arms} ELSE {fallback} END"


@query(
    "labels",
    f"""SELECT job_id, {_case('job_type', 'job_type', 'job_type')} AS job_label,
      {_case('status', 'status', 'status')} AS status_label, {_case('media_type', 'media',
      "'" + C.LABELS['media_type']['unknown'] + "'")} AS media_label
      FROM (SELECT *, CASE priority WHEN 0 THEN 'video' WHEN 1 THEN 'hologram' END AS media
        FROM v_jobs)""",
)
def labels(t):
    media = F.when(F.col("priority") == 0, "video").when(F.col("priority") == 1, "hologram")
    return t.v_jobs.select(
        "job_id", formatting.label("job_type", F.col("job_type")).alias("job_label"),
        formatting.label("status", F.col("status")).alias("status_label"),
        formatting.label("media_type", media).alias("media_label"),
    )


@query(
    "clip_name",
    """SELECT o_orderkey, concat(o_custkey, '-', replace(printf('%g', s), '.', '_'), '-',
        replace(printf('%g', s + 12.25), '.', '_'), '.mp4') AS name, 12.25::DOUBLE AS duration
      FROM (SELECT *, o_orderkey / CAST(8 AS DOUBLE) AS s FROM orders)""",
)
def clip_name(t):
    start = F.col("o_orderkey") / F.lit(8.0)
    return t.orders.select(
        "o_orderkey",
        formatting.clip_name(F.col("o_custkey"), start, start + 12.25, F.lit("mp4")).alias("name"),
        (start + 12.25 - start).alias("duration"),
    )


@query(
    "nullable_bounds",
    """SELECT asset_id, least(start_s, frame_time_s) AS low, greatest(end_s, frame_time_s) AS high,
      least(1, greatest(0, start_s / 10)) AS clamped FROM v_assets""",
)
def nullable_bounds(t):
    """Missing values are left out of a minimum or maximum."""
    return t.v_assets.select(
        "asset_id", F.least("start_s", "frame_time_s").alias("low"),
        F.greatest("end_s", "frame_time_s").alias("high"),
        F.when(F.col("start_s").isNull(), 0.0).otherwise(clamp(F.col("start_s") / 10, 0.0, 1.0))
        .alias("clamped"),
    )


@query(
    "clamp",
    """SELECT event_id, least(1, greatest(0.1, value / 300 - 0.25)) AS clamped FROM events""",
)
def clamp_values(t):
    value = clamp(F.col("value") / 300 - 0.25, 0.1, 1.0)
    return t.events.select("event_id", value.alias("clamped"))
