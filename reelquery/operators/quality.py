"""Row checks. Each adds the rules a row breaks; a clean row has none."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions import vectors as V

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds (NULL conditions do not)."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


def clip_range_check(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests: request_id, file_id, start_s, end_s, output_format (NULL = mp4)."""
    live = files.filter(~F.col("is_deleted")).select("file_id", "media_type")
    kind = F.col("media_type")
    rules = {
        "end_not_after_start": F.coalesce(F.col("end_s") <= F.col("start_s"), F.lit(True)),
        "negative_start": F.col("start_s") < 0,
        "bad_format": ~F.coalesce("output_format", F.lit("mp4")).isin("mp4", "mov"),
        "missing_file": kind.isNull(),
        "not_video": kind != "video",
    }
    return requests.join(live, "file_id", "left").withColumn("problems", broken(rules))


def _payload_rules() -> dict[str, dict[str, Column]]:
    """Rules per job type over the payload column ``input_json``."""
    payload = F.col("input_json")
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    # The JSON type of a key as a variant sees it; null if absent, VOID for a JSON null.
    kind = lambda k: F.expr(
        f"schema_of_variant(try_variant_get(try_parse_json(input_json), '$.{k}', 'variant'))"
    )
    number = lambda k: F.when(
        kind(k).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        F.expr(f"try_cast(get_json_object(input_json, '$.{k}') AS DOUBLE)"),
    )
    text = lambda k: (F.coalesce(kind(k), F.lit("")) != "STRING") | (get(k) == "")
    uuid = lambda k: ~F.coalesce(get(k), F.lit("")).rlike(UUID_PATTERN)
    uuids = lambda k: (F.coalesce(kind(k), F.lit("")) != "ARRAY<STRING>") | ~F.coalesce(
        F.forall(F.from_json(get(k), "array<string>"), lambda x: x.rlike(UUID_PATTERN)), F.lit(False)
    )
    one_of = lambda k, xs: ~F.coalesce(get(k), F.lit("")).isin(xs)
    optional = lambda k, rule: kind(k).isNotNull() & rule
    below = lambda k, low: F.coalesce(number(k) < low, F.lit(True))
    model = {"model_name": text("model_name"), "model_version": text("model_version")}
    embed = {"asset_id": uuid("asset_id"), **model}
    return {
        "scan_library": {
            "library_id": uuid("library_id"), "root_path": text("root_path"),
            "scan_mode": one_of("scan_mode", ["mtime_size", "full"]),
        },
        "probe_media": {
            "file_id": uuid("file_id"), "path": text("path"),
            "media_type": one_of("media_type", C.MEDIA_TYPES),
        },
        "index_media": {
            "file_id": uuid("file_id"), "index_profile": one_of("index_profile", C.INDEX_PROFILES),
        },
        "purge_video_index": {"file_id": uuid("file_id")},
        "transcribe_audio": {
            "file_id": uuid("file_id"), "path": text("path"),
            "media_type": one_of("media_type", ["video", "audio"]),
            "model": optional("model", text("model")),
            "language": optional("language", text("language")),
        },
        "embed_image": {
            **embed, "path": text("path"), "collection": one_of("collection", ["image_vectors"]),
        },
        "embed_video_frame": {
            **embed, "frame_path": text("frame_path"),
            "frame_time_seconds": optional("frame_time_seconds", below("frame_time_seconds", 0)),
            "collection": one_of("collection", ["video_frame_vectors"]),
        },
        "embed_text_asset": {
            **embed, "collection": one_of("collection", ["caption_text_vectors"]),
        },
        "generate_caption": {
            "file_id": uuid("file_id"),
            "prompt_version": optional(
                "prompt_version", one_of("prompt_version", [C.IMAGE_PROMPT, C.SCENE_PROMPT])
            ),
            "scene_id": optional("scene_id", uuid("scene_id")),
            "source_asset_ids": optional("source_asset_ids", uuids("source_asset_ids")),
            "model_name": optional("model_name", text("model_name")),
            "model_version": optional("model_version", text("model_version")),
        },
        "export_clip": {
            "file_id": uuid("file_id"), "start_time_seconds": below("start_time_seconds", 0),
            "end_time_seconds": F.coalesce(number("end_time_seconds") <= 0, F.lit(True)),
            "range": number("end_time_seconds") <= number("start_time_seconds"),
            "output_format": optional("output_format", one_of("output_format", ["mp4", "mov"])),
        },
    }


def job_payload_check(jobs: DataFrame) -> DataFrame:
    """Problems of each job's payload by its type; an unknown type is a problem itself."""
    found: Column = F.array(F.lit("job_type"))
    for job_type, rules in _payload_rules().items():
        found = F.when(F.col("job_type") == job_type, broken(rules)).otherwise(found)
    return jobs.withColumn("problems", found)


def strict_response_check(responses: DataFrame, text: str = "response_json") -> DataFrame:
    """A model response must be a bare JSON object with exactly the agreed keys and types."""
    raw = F.col(text)
    keys = F.json_object_keys(raw)
    wanted = F.array(*[F.lit(k) for k in C.STRICT_RESPONSE_KEYS])
    exact = (F.size(keys) == len(C.STRICT_RESPONSE_KEYS)) & (
        F.size(F.array_except(wanted, keys)) == 0
    )
    # Values keep their JSON type as text: a number stays bare, a string keeps its quotes.
    value = F.from_json(raw, "map<string,variant>")
    typed = lambda k: F.to_json(value[k])
    # Only an integer literal reads as INT; "2", 2.0 and true do not.
    whole = F.from_json(raw, "relevance INT")["relevance"]
    filled = lambda t: t.rlike(r'^".*\S.*"$')

    def good_list(k: str) -> Column:
        items = F.from_json(typed(k), "array<variant>")
        return F.coalesce(
            typed(k).startswith("[") & F.forall(items, lambda i: F.coalesce(
                filled(F.to_json(i)), F.lit(False))), F.lit(False)
        )

    bad = lambda c: ~F.coalesce(c, F.lit(False))
    is_object = F.coalesce(keys.isNotNull(), F.lit(False))
    rules = {
        "not_an_object": ~is_object,
        "wrong_keys": is_object & bad(exact),
        "relevance": is_object & exact & bad(whole.isin(0, 1, 2)),
        "matched_constraints": is_object & exact & ~good_list("matched_constraints"),
        "missing_constraints": is_object & exact & ~good_list("missing_constraints"),
        "reason": is_object & exact & bad(filled(typed("reason"))),
    }
    return responses.withColumn("problems", broken(rules))


def vector_quality(points: DataFrame, dims: dict[str, int], tolerance: float = 1e-3) -> DataFrame:
    """Problems of each vector: wrong dimension for its collection, zero or not unit length."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(dims.items())])
    length = V.norm(F.col("embedding"))
    rules = {
        "dimension": F.size("embedding") != F.coalesce(
            F.element_at(table, F.col("collection")), F.lit(-1)
        ),
        "zero_norm": length == 0,
        "not_unit": (length > 0) & (F.abs(length - 1) > tolerance),
    }
    return points.withColumns({"norm": length, "problems": broken(rules)})


def model_identity(responses: DataFrame, registry: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Responses whose model name, version or vector size differs from their collection's."""
    part = lambda i: F.element_at(
        F.create_map(*[F.lit(x) for k, v in registry.items() for x in (k, v[i])]),
        F.col("collection"),
    )
    differs = lambda c, i: ~F.col(c).eqNullSafe(part(i))
    rules = {
        "model_name": differs("model_name", 0),
        "model_version": differs("model_version", 1),
        "vector_dim": differs("vector_dim", 2),
    }
    return responses.withColumn("problems", broken(rules))
