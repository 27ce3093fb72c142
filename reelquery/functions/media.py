"""Path classification."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelquery import constants as C


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path segment, without the dot; empty when there is none.

    A leading dot alone (``.gitignore``) does not start a suffix, nor does a closing dot.
    """
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def media_type_of(path: Column) -> Column:
    ext = suffix(path)
    return (
        F.when(ext.isin(C.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(C.VIDEO_EXTENSIONS), "video")
        .when(ext.isin(C.AUDIO_EXTENSIONS), "audio")
        .when(ext.isin(C.DOCUMENT_EXTENSIONS), "document")
    )


def content_type_of(path: Column, media_type: Column) -> Column:
    """MIME type by the text after the last dot, else by media type, else octet-stream."""
    ext = F.lower(F.substring_index(path, ".", -1))
    by_ext = F.create_map(*[F.lit(x) for x in chain.from_iterable(C.CONTENT_TYPES.items())])
    by_type = F.create_map(
        *[F.lit(x) for x in chain.from_iterable(C.DEFAULT_CONTENT_TYPES.items())]
    )
    return F.coalesce(
        F.element_at(by_ext, ext), F.element_at(by_type, media_type), F.lit(C.OCTET_STREAM)
    )


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``; a path elsewhere is an error."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = F.startswith(path, prefix)
    return F.when(inside, path.substr(F.length(prefix) + 1, F.length(path))).otherwise(
        F.raise_error(F.concat(F.lit("path outside its root: "), path))
    )
