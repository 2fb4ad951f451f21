"""Keys and values parsed out of names, paths and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The id layouts found in recordings.
SESSION_IN_PATH = r"behavior_\d+_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}"
START_TIME_SUFFIX = r"_\d{2}-\d{2}-\d{2}$"
PREFIXED_ID = r"^(?:behavior|FIP)_([^_]+)_(\d{4}-\d{2}-\d{2})_(.+)$"
NUMBERED_FILE_ID = r"^(\d+)_(\d{4}-\d{2}-\d{2})(?:_(\d+))?\.json$"
TIMED_FILE_ID = r"^(\d+)_(\d{4}-\d{2}-\d{2})_(.+)\.json$"
# The labels of free-text session notes; a colon follows each, at once or after its unit.
WATER_LABEL, RIG_LABELS, WEIGHT_LABEL = "Give extra water", ("tower", "box"), "Weight after"


def session_prefix(session: Column) -> Column:
    """The session id without its trailing start time."""
    return F.regexp_replace(session, START_TIME_SUFFIX, "")


def canon_unit(unit: Column) -> Column:
    """Unit id without a float tail ('12.0' -> '12'); anything not a finite number unchanged."""
    number = unit.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.2e18)
    return F.when(finite, number.cast("bigint").cast("string")).otherwise(unit)


def session_from_path(path: Column, pattern: str = SESSION_IN_PATH) -> Column:
    """First session id in a path, null when there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 0), F.lit(""))


def parse_session_id(session: Column) -> Column:
    """Struct (subject, date, suffix) from any of the three id layouts."""
    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(session, pattern, i), F.lit(""))

    digits = F.regexp_replace(
        F.coalesce(group(PREFIXED_ID, 3), group(NUMBERED_FILE_ID, 3), group(TIMED_FILE_ID, 3)),
        "-", "",
    )
    subject = F.coalesce(group(PREFIXED_ID, 1), group(NUMBERED_FILE_ID, 1), group(TIMED_FILE_ID, 1))
    date = F.coalesce(group(PREFIXED_ID, 2), group(NUMBERED_FILE_ID, 2), group(TIMED_FILE_ID, 2))
    suffix = F.when(
        session.rlike(NUMBERED_FILE_ID), F.coalesce(digits.try_cast("bigint"), F.lit(0))
    ).otherwise(digits.try_cast("bigint"))
    return F.struct(subject.alias("subject"), date.alias("date"), suffix.alias("suffix"))


def short_label(session: Column) -> Column:
    """'subject_date' label of a session."""
    parsed = parse_session_id(session)
    return F.concat_ws("_", parsed["subject"], parsed["date"])


def _labelled(notes: Column, at: Column) -> Column:
    """What follows the first colon after position `at` (1-based, null if absent), up to the end of the line."""
    line = F.substring_index(F.substr(notes, at), "\n", 1)
    return F.when(F.instr(line, ":") > 0, F.trim(F.substr(line, F.instr(line, ":") + 1)))


def parse_notes(notes: Column) -> Column:
    """Struct (extra_water, rig, weight_after) from free-text session notes; each field stands for itself.

    Water without an amount is 0, and null without its label.
    """
    def place(label: str) -> Column:
        return F.nullif(F.instr(notes, label), F.lit(0))

    def leading_number(value: Column) -> Column:
        return F.regexp_extract(value, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")

    water, weight = _labelled(notes, place(WATER_LABEL)), _labelled(notes, place(WEIGHT_LABEL))
    rig = _labelled(notes, F.least(*[place(label + ":") for label in RIG_LABELS]))
    amount = F.when(water.isNotNull(), F.coalesce(leading_number(water), F.lit(0.0)))
    return F.struct(amount.alias("extra_water"), rig.alias("rig"), leading_number(weight).alias("weight_after"))


def flag(value: Column) -> Column:
    """Boolean from mixed spellings; unknown and null are false."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.isin("true", "1", "1.0", "yes"), F.lit(False))


def number(value: Column) -> Column:
    """Double or null; NaN counts as missing."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def first_match(labels: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first true condition."""
    out = F.when(labels[0][0], labels[0][1])
    for condition, label in labels[1:]:
        out = out.when(condition, label)
    return out.otherwise(default)


def clock(seconds: Column) -> Column:
    """'HH:MM:SS.mmm' of a number of seconds."""
    whole = F.floor(seconds).cast("bigint")
    millis = F.floor((seconds - whole) * 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, millis
    )
