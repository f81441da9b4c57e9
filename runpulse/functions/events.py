"""Reading a run's JSON event array.

One odd element must not hide the rest of a run, so an array may hold scalars, nulls and
nested arrays; text that is no JSON array reads as an empty one. Two readers are combined:

* ``from_json`` with a narrow struct skips every field that is not asked for. It is the
  cheap reader, but one scalar element voids its whole result and a bare object passes
  as a one-element array.
* ``array<variant>`` takes any element. ``coalesce`` evaluates it only for the rows the
  first reader gave up on.

Both readers would take the first array of a longer text. So the text is read as the first field of
an object that has a second one: if anything but white space follows the array, that object breaks
off and the text counts as no array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runpulse.functions.instants import safe_ts
from runpulse.functions.text import trim_text

# Fixed value: the job of a run whose first event names none.
DEFAULT_JOB = "(default)"

# By default Spark also takes 'single-quoted' texts and NaN, which are no JSON.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

EVENT_TYPES = {
    "run_id": "string",
    "dt": "string",
    "type": "string",
    "func": "string",
    "tag": "string",
    "note": "variant",
    "err_msg": "string",
}


def _array_text(col: Column) -> Column:
    """The text if it opens a JSON array, else null. The regex runs only on padded text."""
    return F.when(F.startswith(col, F.lit("[")) | col.rlike(r"^[ \t\r\n]*\["), col)


def _elements(col: Column, element: str) -> Column:
    """The array in the text, or null; the text is parsed once."""
    framed = F.concat(F.lit('{"a":'), _array_text(col), F.lit(',"z":0}'))
    read = F.from_json(framed, f"a array<{element}>, z int", STRICT)
    return F.transform(F.array(read), lambda r: F.when(r["z"] == 0, r["a"]))[0]


def is_array(col: Column) -> Column:
    """Whether the text is a JSON array; null for null."""
    return F.when(col.isNotNull(), _elements(col, "variant").isNotNull())


def parse_events(col: Column) -> Column:
    """JSON text to ``array<variant>``; null, malformed and non-array text give no elements."""
    return F.coalesce(_elements(col, "variant"), F.array().cast("array<variant>"))


def event_fields(col: Column, *fields: str) -> Column:
    """JSON text to an array of structs with just ``fields``; an odd element has null fields."""
    names = fields or tuple(EVENT_TYPES)
    schema = ", ".join(f"{name}: {EVENT_TYPES[name]}" for name in names)
    narrow = _elements(col, f"struct<{schema}>")
    tolerant = F.transform(
        _elements(col, "variant"),
        lambda e: F.struct(*[F.try_variant_get(e, f"$.{n}", EVENT_TYPES[n]).alias(n) for n in names]),
    )
    return F.coalesce(narrow, tolerant, F.array().cast(f"array<struct<{schema}>>"))


def severities(col: Column) -> Column:
    """The ``type`` of every event, in order: all that status and issue count need."""
    return event_fields(col, "type").getField("type")


def status_from(types: Column) -> Column:
    """ERROR beats WARN beats SUCCESS, over an array from ``severities``."""
    return (
        F.when(has_type(types, "ERROR"), "ERROR").when(has_type(types, "WARN"), "WARN").otherwise("SUCCESS")
    )


def has_type(types: Column, *names: str) -> Column:
    """Does any of ``names`` occur? With null elements a miss comes out null: that is a no."""
    return F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(n) for n in names])), F.lit(False))


def derive_status(col: Column) -> Column:
    return status_from(severities(col))


def issue_count(col: Column) -> Column:
    """Number of elements of any kind; 0 when the text is no array."""
    return F.size(severities(col))


def job_name(col: Column) -> Column:
    """Third argv item of the first event's note, trimmed; absent or blank is the default job."""
    return job_of(log_heads(col))


def log_heads(col: Column) -> Column:
    """``dt`` and ``argv`` of every event: all of a log that job, start and end need, in one parse."""
    narrow = F.transform(
        _elements(col, "struct<dt: string, note: struct<argv: array<string>>>"),
        lambda e: F.struct(e["dt"].alias("dt"), e["note"]["argv"].alias("argv")),
    )
    tolerant = F.transform(
        _elements(col, "variant"),
        lambda e: F.struct(
            F.try_variant_get(e, "$.dt", "string").alias("dt"),
            F.try_variant_get(e, "$.note.argv", "array<string>").alias("argv"),
        ),
    )
    return F.coalesce(narrow, tolerant, F.array().cast("array<struct<dt: string, argv: array<string>>>"))


def job_of(heads: Column) -> Column:
    """The job, over an array from ``log_heads``."""
    raw = F.try_element_at(F.try_element_at(heads, F.lit(1))["argv"], F.lit(3))
    return F.coalesce(F.nullif(trim_text(raw), F.lit("")), F.lit(DEFAULT_JOB))


def event_dts(col: Column) -> Column:
    """The raw ``dt`` text of every event, in order."""
    return event_fields(col, "dt").getField("dt")


def first_and_last(dts: Column) -> tuple[Column, Column]:
    """Start and end: the first and the last array element of ``event_dts``, by position."""
    return safe_ts(F.try_element_at(dts, F.lit(1))), safe_ts(F.try_element_at(dts, F.lit(-1)))


def duration_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds, half rounded up; null when unknown or when the span is negative."""
    span = F.unix_micros(ended) - F.unix_micros(started)
    return F.when(span >= 0, F.floor((span + 500) / 1000))


def run_timing(col: Column) -> Column:
    """``struct<started_at, ended_at, duration_ms>`` of a log. It is parsed once for all three."""

    def timing(dts: Column) -> Column:
        started, ended = first_and_last(dts)
        return F.struct(
            started.alias("started_at"), ended.alias("ended_at"), duration_ms(started, ended).alias("duration_ms")
        )

    return F.transform(F.array(event_dts(col)), timing)[0]


def issue_subset(events: Column) -> Column:
    """Elements of a struct array with type WARN or ERROR, in order."""
    return F.filter(events, lambda e: e["type"].isin("WARN", "ERROR"))
