"""Deterministic identifiers and fingerprints, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelquery import constants as C
from reelquery.functions.formatting import fmt_g

_NAMESPACE_HEX = C.POINT_NAMESPACE.replace("-", "")


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name`` in the point namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def point_id(asset_id, collection, model_name, model_version, vector_kind, content_hash) -> Column:
    parts = [asset_id, collection, model_name, model_version, vector_kind, content_hash]
    return uuid5(F.concat_ws("|", *[part.cast("string") for part in parts]))


def strategy_fingerprint(threshold, min_seconds, max_seconds, interval_seconds) -> Column:
    """SHA-256 over the scene and sampling parameters."""
    named = [
        ("threshold", threshold), ("min_seconds", min_seconds),
        ("max_seconds", max_seconds), ("interval_seconds", interval_seconds),
    ]
    parts = [F.concat(F.lit(f"{name}="), fmt_g(value)) for name, value in named]
    return F.sha2(F.concat_ws("|", *parts, F.lit(f"layout={C.LAYOUT_VERSION}")), 256)


def caption_fingerprint(source_ids, frame_times, prompt_version, model_version, caption) -> Column:
    """SHA-256 over source ids, frame times (missing time = empty text), versions and text."""
    times = F.transform(frame_times, lambda t: F.coalesce(fmt_g(t), F.lit("")))
    ids = F.transform(source_ids, lambda i: i.cast("string"))
    parts = F.concat(ids, times, F.array(prompt_version, model_version, caption))
    return F.sha2(F.array_join(parts, "|"), 256)
