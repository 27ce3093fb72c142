"""Text forms of numbers, times and enumerations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelquery import constants as C

_DIGITS = 6


def _let(value: Column, body) -> Column:
    """``body`` over a value computed once; nesting plain columns would repeat its expression at
    every use."""
    return F.transform(F.array(value), body)[0]


def fmt_g(value: Column) -> Column:
    """C-style ``%g``: six significant digits, half-even, trailing zeros dropped."""
    nought = F.lit("0")

    def magnitude(x: Column) -> Column:
        return F.struct(
            F.abs(x).alias("size"), F.floor(F.log10(F.abs(x))).cast("int").alias("power")
        )

    def scaled(m: Column) -> Column:
        """The six digits as a number, with the factors whose exact product decides a tie."""
        shift = F.lit(_DIGITS - 1) - m["power"]
        up = shift >= 0
        factor = F.pow(F.lit(10.0), F.abs(shift))
        value = F.when(up, m["size"] * factor).otherwise(m["size"] / factor)
        return F.struct(
            m["size"].alias("size"), m["power"].alias("power"), up.alias("up"),
            value.alias("value"), factor.alias("b"),
            F.when(up, m["size"]).otherwise(value).alias("a"),
        )

    def halved(m: Column) -> Column:
        """Both factors split into 26-bit halves, so partial products are exact."""
        high = lambda c: c * 134217729.0 - (c * 134217729.0 - c)
        return F.struct(
            m.alias("m"), high(m["a"]).alias("ah"), (m["a"] - high(m["a"])).alias("al"),
            high(m["b"]).alias("bh"), (m["b"] - high(m["b"])).alias("bl"),
        )

    def significant(h: Column) -> Column:
        m = h["m"]
        product = m["a"] * m["b"]
        rest = (
            (h["ah"] * h["bh"] - product) + h["ah"] * h["bl"] + h["al"] * h["bh"]
        ) + h["al"] * h["bl"]
        off = F.when(m["up"], rest).otherwise((m["size"] - product) - rest)
        below = F.floor(m["value"])
        tie = m["value"] - below == 0.5
        whole = (
            F.when(tie & (off > 0), below + 1)
            .when(tie & (off < 0), below)
            .otherwise(F.rint(m["value"]).cast("bigint"))
        )
        return F.struct(whole.alias("whole"), m["power"].alias("power"))

    def carried(r: Column) -> Column:
        over = r["whole"] >= 10**_DIGITS
        return F.struct(
            F.when(over, F.lit("100000")).otherwise(r["whole"].cast("string")).alias("digits"),
            F.when(over, r["power"] + 1).otherwise(r["power"]).alias("power"),
        )

    def dotted(head: Column, tail: Column) -> Column:
        return F.rtrim(F.rtrim(F.concat(head, F.lit("."), tail), nought), F.lit("."))

    def text(d: Column) -> Column:
        digits, power = d["digits"], d["power"]
        exponent = F.abs(power).cast("string")
        padded = F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent)
        scientific = F.concat(
            dotted(F.substring(digits, 1, 1), F.substring(digits, 2, _DIGITS)),
            F.when(power < 0, "e-").otherwise("e+"), padded,
        )
        above_one = dotted(
            digits.substr(F.lit(1), power + 1), digits.substr(power + 2, F.lit(_DIGITS))
        )
        below_one = F.concat(
            F.lit("0."), F.repeat(nought, -power - 1), F.rtrim(digits, nought)
        )
        return (
            F.when((power < -4) | (power >= _DIGITS), scientific)
            .when(power >= 0, above_one)
            .otherwise(below_one)
        )

    def short_form(x: Column) -> tuple[Column, Column]:
        """Text of numbers that need at most six digits and no exponent, and whether x is one.

        Such a text is the nearest double's own, so rounding to six digits gives it back.
        """
        plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
        digits = F.ltrim(F.translate(plain, "-.", ""), nought)
        return plain, ~F.contains(plain, F.lit("E")) & F.length(digits).between(1, _DIGITS)

    def render(x: Column) -> Column:
        digits = _let(_let(_let(magnitude(x), scaled), halved), significant)
        plain = _let(_let(digits, carried), text)
        return (
            F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), "nan")
            .when(F.abs(x) == float("inf"), F.when(x < 0, "-inf").otherwise("inf"))
            .when(x == 0, F.when(F.startswith(x.cast("string"), F.lit("-")), "-0").otherwise("0"))
            .when(x < 0, F.concat(F.lit("-"), plain))
            .otherwise(plain)
        )

    def quick(x: Column) -> tuple[Column, Column]:
        """Text of a number from 1e-4 up to 1e6, and whether it is sure.

        The six digits as a number are off by less than 1e-9 here, so only one that near to a tie can
        round either way.
        """
        power, factor = F.lit(_DIGITS - 1), F.lit(1.0)
        for p in range(_DIGITS - 2, -5, -1):
            power = F.when(x < 10.0 ** (p + 1), F.lit(p)).otherwise(power)
            factor = F.when(x < 10.0 ** (p + 1), F.lit(10.0 ** (_DIGITS - 1 - p))).otherwise(factor)
        size = x * factor
        digits = F.rint(size).cast("bigint")
        sure = (F.abs(size - F.floor(size) - 0.5) > 1e-6) & (digits < 10**_DIGITS) & (digits >= 10 ** (_DIGITS - 1))
        return F.when(
            power >= 0, dotted(F.substring(digits.cast("string"), F.lit(1), power + 1),
                               F.substring(digits.cast("string"), power + 2, F.lit(_DIGITS)))
        ).otherwise(
            F.concat(F.lit("0."), F.repeat(nought, -power - 1), F.rtrim(digits.cast("string"), nought))
        ), sure

    number = value.cast("double")
    fast, is_sure = quick(F.when((number >= 1e-4) & (number < 1e6), number))
    plain, is_short = short_form(number)
    usual = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e6) & is_short
    return F.when(F.coalesce(is_sure, F.lit(False)), fast).when(usual, plain).otherwise(_let(number, render))


def playback_time(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = F.floor(seconds)
    hours, minutes = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    rest = F.pmod(whole, F.lit(60))
    return F.when(
        hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))
    ).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(rest)))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(playback_time(start), F.lit(" – "), playback_time(end))


def label(kind: str, value: Column) -> Column:
    """Display label; an unknown value keeps its own text (media types fall back to unknown)."""
    table = F.create_map(*[F.lit(item) for item in chain.from_iterable(C.LABELS[kind].items())])
    fallback = F.lit(C.LABELS[kind]["unknown"]) if kind == "media_type" else value
    return F.coalesce(F.element_at(table, value), fallback)


def confidence_label(value: Column) -> Column:
    return F.when(value == "low", C.CONFIDENCE_LOW).otherwise(C.CONFIDENCE_OTHER)


def clip_name(file_id: Column, start: Column, end: Column, output_format: Column) -> Column:
    stamp = lambda t: F.replace(fmt_g(t), F.lit("."), F.lit("_"))
    return F.concat(
        file_id.cast("string"), F.lit("-"), stamp(start), F.lit("-"), stamp(end), F.lit("."),
        output_format,
    )
