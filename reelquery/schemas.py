"""Declared schemas of the fact tables; reads never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
    T.TimestampType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TIMES = {"created_at": _TS, "updated_at": _TS}

TABLES: dict[str, T.StructType] = {
    "libraries": _table(
        library_id=_S, name=_S, root_path=_S, status=_S, **_TIMES, deleted_at=_TS
    ),
    "media_files": _table(
        file_id=_S, library_id=_S, path=_S, relative_path=_S, media_type=_S, size_bytes=_L,
        mtime_ms=_L, content_hash=_S, index_status=_S, duration_seconds=_D, width=_I, height=_I,
        codec=_S, index_generation=_I, **_TIMES, deleted_at=_TS,
    ),
    "video_scenes": _table(
        scene_id=_S, file_id=_S, scene_key=_S, start_s=_D, end_s=_D, detection_strategy=_S,
        strategy_fingerprint=_S, index_generation=_I, **_TIMES,
    ),
    "media_assets": _table(
        asset_id=_S, file_id=_S, asset_type=_S, path=_S, scene_id=_S, start_s=_D, end_s=_D,
        frame_time_s=_D, content_hash=_S, text_content=_S, metadata_json=_S, created_at=_TS,
    ),
    "vector_refs": _table(
        ref_id=_S, asset_id=_S, file_id=_S, library_id=_S, collection=_S, point_id=_S,
        model_name=_S, model_version=_S, vector_kind=_S, vector_dim=_I, distance=_S,
        content_hash=_S, index_profile=_S, status=_S, **_TIMES,
    ),
    "jobs": _table(
        job_id=_S, job_type=_S, status=_S, priority=_I, attempt=_I, max_attempts=_I, locked_by=_S,
        locked_at=_TS, heartbeat_at=_TS, timeout_seconds=_I, progress=_I, input_json=_S,
        result_json=_S, error_message=_S, error_code=_S, error_details_json=_S, file_id=_S,
        **_TIMES, finished_at=_TS,
    ),
    "agent_runs": _table(
        run_id=_S, status=_S, prompt=_S, summary=_S, **_TIMES, finished_at=_TS
    ),
    "agent_run_events": _table(
        event_id=_S, run_id=_S, event_type=_S, tool_call_id=_S, payload_json=_S, created_at=_TS
    ),
    "agent_tool_calls": _table(
        call_id=_S, run_id=_S, tool_call_id=_S, tool_name=_S, status=_S, input_json=_S,
        output_json=_S, error_message=_S, requires_confirmation=_B, confirmed_at=_TS, **_TIMES,
    ),
    "points": T.StructType(
        [
            T.StructField("collection", _S), T.StructField("point_id", _S),
            T.StructField("scene_id", _S), T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    ),
}

PARTITIONS: dict[str, list[str]] = {
    "media_files": ["library_id"],
    "media_assets": ["asset_type"],
    "vector_refs": ["collection"],
    "points": ["collection"],
    "jobs": ["created_date"],
    "agent_run_events": ["created_date"],
    "agent_tool_calls": ["created_date"],
}
