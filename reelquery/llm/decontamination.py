"""Benchmark decontamination by template windows and slot consistency.

A text becomes a template: numbers, units after numbers and names (capitalised words inside a sentence)
turn into typed placeholders, their values kept beside them as slots; everything else is lower-cased. A
capitalised word at the start of a sentence, of a line or of the text may be a name or not: windows with
such words come in two readings, and an item window is found if one of its readings is.
Windows of ``WINDOW`` template tokens are joined by hash with the windows of the benchmark items. An item
is found in a document if at least ``CONTAINMENT`` of its windows are there, counting only alignments
whose slots are consistent: along one alignment (position in the document minus position in the item)
every value of an item slot always stands for the same value in the document. So an item is caught
verbatim or with other numbers and names, but not where a mere form recurs with unrelated fillings.

Scale: documents are scanned where they are. The item windows are broadcast only up to
``BROADCAST_WINDOWS`` rows (counted first); beyond that the join shuffles. Found windows are counted per
(document, item) inside the scanning task. Only documents that reach the share are read again for their
slots. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import letters_lower, texts
from reelquery.session import checkpointed

WINDOW = 5
CONTAINMENT = 0.8
#: Windows with fewer other tokens than this say nothing by their form; only their values do.
LITERALS = 2
BROADCAST_WINDOWS = 1_000_000

NAME, NUMBER, UNIT = "", "", ""
#: Mark of a capitalised word that may be a name or not.
INITIAL = ""
#: Units that may follow a number.
UNITS = (
    "percent", "years", "year", "months", "month", "weeks", "week", "days", "day", "hours", "hour",
    "minutes", "minute", "seconds", "second", "kilometers", "kilometres", "meters", "metres", "miles",
    "feet", "inches", "kilograms", "grams", "pounds", "ounces", "liters", "litres", "gallons",
    "dollars", "euros", "cents", "degrees", "km/h", "mph", "kg", "km", "cm", "mm", "mg", "ml",
    "lb", "oz", "ft", "hz", "kb", "mb", "gb", "tb", "ms", "m", "g", "l", "s", "h",
)
# Patterns test a character first and look behind it only then.
_MEASURE = (
    rf"(\p{{Nd}}(?<![\p{{Nd}}.,:/]\p{{Nd}})\p{{Nd}}*(?:[.,:/]\p{{Nd}}+)*)"
    rf"(?:\s?((?i:{'|'.join(UNITS)}|%|\$|€))(?![\p{{L}}\p{{Nd}}]))?"
)
_NAME = rf"\p{{Lu}}(?<=[^\s.!?:;] \p{{Lu}})[\p{{L}}\p{{M}}]*"
#: A capitalised word anywhere else: at the start of a sentence, of a line, of the text, or in quotes.
_INITIAL = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{Nd}}{NAME}]\p{{Lu}})(?<!\p{{Nd}}\s\p{{Lu}})[\p{{L}}\p{{M}}]*"
#: What stands between tokens, and the mark of a unit that is not there.
_BETWEEN = rf"(?:(?![.,:/]\p{{Nd}})[^\p{{L}}\p{{M}}\p{{Nd}}{NAME}{NUMBER}{UNIT}{INITIAL}]|{UNIT}(?= ))+"


def template_tokens(text):
    """Tokens of a text, lower-cased; slots and capitalised words that may be names begin with their mark.

    Both readings of a text have the same tokens: ``INITIAL`` is no mark in one, and that of a name in the other.
    """
    named = F.regexp_replace(F.regexp_replace(text, _NAME, f"{NAME}$0"), _INITIAL, f"{INITIAL}$0")
    measured = F.regexp_replace(named, _MEASURE, f" {NUMBER}$1 {UNIT}$2 ")
    return F.array_remove(F.split(letters_lower(measured), _BETWEEN), "")


def _value(token):
    """A token without its mark."""
    return F.when(token >= NAME, F.substring(token, 2, 1 << 30)).otherwise(token)


#: Lowest bits of a token's code: what it is. The others are the hash of its value.
_KINDS = 7
_WORD, _NAMED, _NUMBERED, _UNITS, _MAYBE = range(5)


def _code(token):
    kind = F.when(token >= INITIAL, _MAYBE).when(token >= UNIT, _UNITS).when(token >= NUMBER, _NUMBERED).when(token >= NAME, _NAMED)
    return F.xxhash64(_value(token)).bitwiseAND(F.lit(~_KINDS).cast("long")).bitwiseOR(F.coalesce(kind, F.lit(_WORD)).cast("long"))


def _read(rows: DataFrame, key, *others) -> DataFrame:
    """(key, others, tokens, codes): tokens of the texts and their codes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = rows.select(key, *others, template_tokens(text).alias("tokens"))
    return tokens.withColumn("codes", F.transform("tokens", _code))


def _windows_of(rows: DataFrame, *ids: str, lengths: tuple[int, ...] = (), slots: bool = False) -> DataFrame:
    """(ids, pos, window, named, exact), a hash per window of consecutive tokens of each row of ``_read``; with
    ``slots`` also the window's slots in its reading (none if exact: their values agree already).

    Windows that differ between the readings come in both; ``named``: the one with names. Windows with
    fewer than ``LITERALS`` words are hashed with the values of their slots (``exact``), and so are those
    of ``lengths`` below ``WINDOW``. Fewer tokens than a window: one window of them all; none: no row.

    Places are exploded first, so that windows are hashed in generated code and arrays are not copied.
    """
    size = F.size("codes")
    last = size - 1 if lengths else F.greatest(size - WINDOW, F.lit(0))
    spread = rows.withColumn("pos", F.explode(F.when(size > 0, F.sequence(F.lit(0), last))))
    steps = range(WINDOW)
    # The tokens of a window, not those of the text, go with it.
    own_tokens = [F.get("tokens", F.col("pos") + k).alias(f"t{k}") for k in steps] if slots else []
    kept = [*ids, "pos", *[f"t{k}" for k in steps if slots]]
    coded = spread.select(
        *ids, "pos", *own_tokens, size.alias("n_codes"), *[F.get("codes", F.col("pos") + k).alias(f"c{k}") for k in steps]
    )
    kinds = coded.select("*", *[F.col(f"c{k}").bitwiseAND(F.lit(_KINDS).cast("long")).alias(f"k{k}") for k in steps])
    values = [F.col(f"c{k}").bitwiseAND(F.lit(~_KINDS).cast("long")) for k in steps]
    told = kinds.select(
        *kept, "n_codes", *[f"k{k}" for k in steps], *[v.alias(f"v{k}") for k, v in enumerate(values)],
        sum(F.coalesce((F.col(f"k{k}") == _MAYBE).cast("int"), F.lit(0)) for k in steps).alias("maybe"),
        sum(F.coalesce((F.col(f"k{k}") == _WORD).cast("int"), F.lit(0)) for k in steps).alias("words"),
    )

    def one(named: bool):
        kind = [F.when(F.col(f"k{k}") == _MAYBE, _NAMED).otherwise(F.col(f"k{k}")) if named else F.col(f"k{k}") for k in steps]
        slot = [(k >= _NAMED) & (k <= _UNITS) for k in kind]
        form = F.xxhash64(*[F.when(s, k).otherwise(F.col(f"v{i}")) for i, (s, k) in enumerate(zip(slot, kind, strict=True))])
        sparse = (F.col("words") if named else F.col("words") + F.col("maybe")) < LITERALS
        window = F.when(sparse, F.xxhash64(F.lit(0), *[f"v{k}" for k in steps])).otherwise(form)
        return F.struct(window.alias("window"), F.lit(named).alias("named"), sparse.alias("exact"))

    def short(length: int):
        window = F.xxhash64(F.lit(length), *[f"v{k}" for k in range(length)])
        own = F.struct(window.alias("window"), F.lit(False).alias("named"), F.lit(True).alias("exact"))
        return F.when(F.col("pos") + length <= F.col("n_codes"), own)

    differs = F.col("maybe") > 0
    if lengths:
        whole = F.col("pos") <= F.greatest(F.col("n_codes") - WINDOW, F.lit(0))
        every = F.array_compact(F.array(F.when(whole, one(False)), F.when(whole & differs, one(True)), *map(short, lengths)))
    else:
        every = F.when(differs, F.array(one(False), one(True))).otherwise(F.array(one(False)))
    windows = told.select(*kept, F.inline(every))
    if not slots:
        return windows
    return windows.select(*ids, "pos", "window", "named", "exact", _slots([F.col(f"t{k}") for k in steps]).alias("slots"))


def _slots(tokens: list):
    """Slots of a window of ``tokens``: (offset, mark and value)."""
    listed = []
    for k, token in enumerate(tokens):
        name = F.when(F.col("named"), F.concat(F.lit(NAME), _value(token)))
        slot = F.when(token >= INITIAL, name).when(token >= NAME, token)
        listed.append(F.when(slot.isNotNull() & ~F.col("exact"), F.struct(F.lit(k).alias("k"), slot.alias("value"))))
    return F.array_compact(F.array(*listed))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, at, window, named, exact, item_slots, size, n): item windows at their first place, in both
    readings, and how many places the item has. Written once.

    Windows with few words count only in items that have no other; an item shorter than a window also has
    one of its own length.
    """
    key = F.col("item_id").cast("long").alias("item_id")
    rows = _read(benchmark.where("item_id IS NOT NULL"), key).withColumn("size", F.size("tokens"))
    windows = _windows_of(rows, "item_id", "size", slots=True)
    # The whole of a short item is also a window by its values, of its own length.
    own = rows.where((F.col("size") > 0) & (F.col("size") < WINDOW)).select(
        "item_id", "size", F.lit(0).alias("pos"), _own_window().alias("window"), F.lit(False).alias("named"),
        F.lit(True).alias("exact"), F.array().cast(windows.schema["slots"].dataType).alias("slots"),
    )
    spread = checkpointed(windows.union(own).select(
        "item_id", F.col("pos").alias("at"), "window", "named", "exact", F.col("slots").alias("item_slots"), "size"
    ).distinct())
    counted = spread.where(~F.col("named")).withColumn("rich", ~F.col("exact") | (F.col("size") < WINDOW))
    only = counted.groupBy("item_id").agg(F.max("rich").alias("any_rich"))
    wanted = counted.join(only, "item_id").where(F.col("rich") | ~F.col("any_rich"))
    one = F.when(F.col("size") < WINDOW, F.lit(0)).otherwise(F.col("window"))
    first = checkpointed(wanted.groupBy("item_id", one.alias("one")).agg(F.min("at").alias("at")))
    counts = first.groupBy("item_id").agg(F.count("*").alias("n"))
    return checkpointed(
        spread.join(first.select("item_id", "at").distinct(), ["item_id", "at"], "left_semi").join(counts, "item_id")
    )


def _own_window():
    """Hash of all values of an item shorter than a window, as documents hash windows of that length."""
    whole = F.lit(None).cast("long")
    for length in range(1, WINDOW):
        values = [F.get("codes", F.lit(k)).bitwiseAND(F.lit(~_KINDS).cast("long")) for k in range(length)]
        whole = F.when(F.col("size") == length, F.xxhash64(F.lit(length), *values)).otherwise(whole)
    return whole


def _short_lengths(items: DataFrame) -> tuple[int, ...]:
    """Lengths below a window that items have."""
    return tuple(sorted(r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()))


def _doc_key(doc_id="doc_id", text="text"):
    """The doc_id, or without one a negative number from the text, so that such rows are found too."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), 1)
    return F.coalesce(F.col(doc_id).cast("long"), -hashed - 1)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, containment, n_slots, n_changed, kind) of every leak.

    ``n_changed`` of the ``n_slots`` aligned slots have another value in the document; ``kind`` is
    ``verbatim`` if none has, else ``reparameterised``. Null texts are empty and match nothing. An item
    whose windows are nearly all placeholders is found where these have the same values; an item shorter
    than a window is found verbatim anywhere (case and punctuation aside), and with other values only in a
    document of just those tokens. Windows with the same values bring no slots. Rows that repeat a doc_id or
    item_id act as one, and so do rows without a doc_id that have the same text; those are reported with a null
    doc_id. Items with a null item_id are not looked for. Empty tables: no rows. Other columns are ignored.
    """
    return _leaks(docs, benchmark).drop("key")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items = item_windows(benchmark)
    index = items.select("item_id", "at", "window", "n").distinct()
    sent = F.broadcast(index) if items.count() <= BROADCAST_WINDOWS else index
    short = _short_lengths(items)
    read = _read(docs.select(_doc_key().alias("key"), "text"), F.col("key"))
    found = _windows_of(read, "key", lengths=short).select("key", "window").join(sent, "window")
    enough = checkpointed(
        found.groupBy("key", "item_id", "n", "at").agg(F.lit(1).alias("one"))
        .groupBy("key", "item_id", "n").agg(F.count("*").alias("n_found"))
        .where(F.col("n_found") >= CONTAINMENT * F.col("n")).select("key", "item_id")
    )
    return _consistent(docs, items, enough, short)


def _consistent(docs: DataFrame, items: DataFrame, pairs: DataFrame, short: tuple[int, ...]) -> DataFrame:
    """The pairs whose share is reached over alignments with consistent slots."""
    rows = docs.select(_doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(pairs.select("key").distinct(), "key", "left_semi")
    again = _read(rows, F.col("key"), F.col("doc_id"))
    placed = _windows_of(again, "key", "doc_id", lengths=short, slots=True).drop("named", "exact").withColumnRenamed("slots", "doc_slots")
    mine = items.dropDuplicates(["item_id", "window", "at"]).select("item_id", "window", "at", "n", "item_slots")
    aligned = checkpointed(
        placed.join(pairs, "key").join(mine, ["item_id", "window"]).select(
            "key", "doc_id", "item_id", "n", "at", (F.col("pos") - F.col("at")).alias("shift"),
            F.arrays_zip(F.col("item_slots").alias("a"), F.col("doc_slots").alias("b")).alias("slots"),
        )
    )
    line = ["key", "item_id", "shift"]
    values = aligned.select(*line, F.explode("slots").alias("slot")).select(
        *line, F.col("slot.a.value").alias("mine"), F.col("slot.b.value").alias("theirs")
    ).distinct()
    maps = values.groupBy(*line, "mine").agg(F.count("*").alias("meanings"), F.max(
        (F.col("theirs") != F.col("mine")).cast("int")).alias("changed")
    ).groupBy(*line).agg(
        F.max("meanings").alias("meanings"), F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed")
    )
    steady = aligned.drop("slots").join(maps, line, "left").where(F.coalesce("meanings", F.lit(1)) == 1)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    per_line = steady.groupBy("key", "item_id", "n", "shift").agg(
        F.first("doc_id").alias("doc_id"), F.max(zero("n_slots")).alias("n_slots"), F.max(zero("n_changed")).alias("n_changed")
    ).groupBy("key", "item_id", "n").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_slots").cast("long").alias("n_slots"),
        F.sum("n_changed").cast("long").alias("n_changed"),
    )
    covered = steady.groupBy("key", "item_id", "n", "at").agg(F.lit(1).alias("one")).groupBy(
        "key", "item_id"
    ).agg(F.count("*").alias("n_found"))
    return per_line.join(covered, ["key", "item_id"]).where(
        F.col("n_found") >= CONTAINMENT * F.col("n")
    ).select(
        "key", "doc_id", "item_id", F.col("n").alias("n_windows"), "n_found",
        (F.col("n_found") / F.col("n")).alias("containment"), "n_slots", "n_changed",
        F.when(F.col("n_changed") == 0, "verbatim").otherwise("reparameterised").alias("kind"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; rows without a doc_id are judged
    by their text."""
    leaks = checkpointed(_leaks(docs, benchmark).select(F.col("key").alias("leaks")).distinct())
    return docs.join(leaks, _doc_key() == leaks["leaks"], "left_anti")
