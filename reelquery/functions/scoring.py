"""Hybrid scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelquery import constants as C


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def source_weight(source: Column) -> Column:
    return F.when(source == C.TEXT_CHANNEL, C.TEXT_WEIGHT).otherwise(C.VECTOR_WEIGHT)


def normalize_score(source: Column, score: Column) -> Column:
    """Text ranks saturate as s/(s+1); cosines are clamped to 0..1."""
    text = F.when(score <= 0, 0.0).otherwise(score / (score + 1))
    return F.when(source == C.TEXT_CHANNEL, text).otherwise(clamp(score, 0.0, 1.0))


def contribution(source: Column, score: Column) -> Column:
    return source_weight(source) * normalize_score(source, score)


def keeps_source(source: Column, score: Column) -> Column:
    """False for a vector source too weak to count; text is exempt."""
    return (source == C.TEXT_CHANNEL) | (normalize_score(source, score) >= C.MIN_SOURCE_SCORE)


def reason_of_source(source: Column, reasons: Column | None = None) -> Column:
    """Why a source matched; a text hit that carries only a caption reason stays a caption."""
    text: Column = F.lit("transcript_match")
    if reasons is not None:
        only_caption = ~F.array_contains(reasons, "transcript_match") & F.array_contains(
            reasons, "caption_match"
        )
        text = F.when(only_caption, "caption_match").otherwise("transcript_match")
    return (
        F.when(source == C.CAPTION_CHANNEL, "caption_match")
        .when(source != C.TEXT_CHANNEL, "vector_match")
        .otherwise(text)
    )


def ordered_reasons(reasons: Column) -> Column:
    """Distinct reasons in display order."""
    known = F.array(*[F.lit(reason) for reason in C.REASONS])
    return F.filter(known, lambda reason: F.array_contains(reasons, reason))


def source_limit(limit: Column, offset: Column) -> Column:
    """Depth per channel: three pages' worth, at least 30, at most 300."""
    wanted = (limit + offset) * C.OVERFETCH
    return F.least(F.lit(C.MAX_SOURCE_LIMIT), F.greatest(F.lit(C.MIN_SOURCE_LIMIT), wanted))
