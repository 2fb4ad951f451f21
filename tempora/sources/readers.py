"""Readers for tracks, session tables, quality reports, acquisition files and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.keys import session_from_path, session_prefix
from tempora.operators.ordered import lagged

# Channel prefixes of photometry and the sync channels kept with it.
PHOTOMETRY = r"^(G|R|Iso)_[0-4]"
SYNC = r"^FIP_(falling|rising)_time$"
# Laser colours in nanometres, and the event a laser is aligned to when it starts with the trial.
WAVELENGTH = {"Blue": 473.0, "Red": 647.0, "Green": 547.0}
WITH_TRIAL = "Trial start"
LISTED_NAME = r"^(.*)_videoprocessed_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})$"


def _lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, value) of every line in the files of a folder, or of a table of packed files."""
    if isinstance(path, DataFrame):
        return path.select("path", "value")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def scan_keypoints(spark: SparkSession, path: str | DataFrame, session: Column | None = None, header: str | None = None) -> DataFrame:
    """Track CSVs with three header rows (scorer, keypoint, coordinate) in long form.

    Every file is read by its own header, so files may have other keypoints or another order; one without header rows is
    read by those of the file `header`. Data rows are those that start with a number. A cell that is missing or is no number
    is null, as are the coordinates a header does not name. Files with neither header give no rows. `path` is a folder, or a
    table of packed files (`sinks.write_packed`), which spares a file per session.
    """
    lines = _lines(spark, path).withColumnRenamed("path", "__file")
    heads = _track_headers(lines)
    rows = lines.where(F.col("value").rlike(r"^\d+(,|$)")).join(heads, "__file", "left")
    if header is not None:
        given = _track_headers(spark.read.text(header).select(F.lit("").alias("__file"), "value"))
        rows = rows.withColumn("__places", F.coalesce("__places", given.select("__places").scalar()))
    cells = rows.withColumn("__cells", F.split("value", ",")).withColumn(
        "session", session if session is not None else session_from_path(F.col("__file"))
    )

    def cell(at: Column) -> Column:
        return F.nanvl(F.get(F.col("__cells"), at).try_cast("double"), F.lit(None).cast("double"))

    long = F.transform("__places", lambda p: F.struct(p.keypoint.alias("keypoint"), cell(p.x).alias("x"), cell(p.y).alias("y"), cell(p.likelihood).alias("confidence")))
    return cells.select("session", F.get("__cells", F.lit(0)).cast("bigint").alias("frame"), F.inline(long))


def _track_headers(lines: DataFrame) -> DataFrame:
    """(__file, __places): per file the cell numbers of every keypoint's coordinates."""
    def row(name: str) -> Column:
        return F.split(F.max(F.when(F.col("value").startswith(name + ","), F.col("value"))), ",")

    heads = lines.where(~F.col("value").rlike(r"^\d")).groupBy("__file").agg(row("bodyparts").alias("points"), row("coords").alias("coords"))
    pairs = F.zip_with("points", "coords", lambda p, c: F.concat_ws("|", p, F.trim(c)))
    names = F.array_distinct(F.slice("points", 2, F.greatest(F.lit(0), F.size("points") - 1)))

    def place(name: Column, coordinate: str) -> Column:
        return F.nullif(F.array_position("pairs", F.concat_ws("|", name, F.lit(coordinate))), F.lit(0)).cast("int") - 1

    return heads.where(F.col("points").isNotNull() & F.col("coords").isNotNull()).withColumn("pairs", pairs).withColumn("names", names).select(
        "__file", F.transform("names", lambda n: F.struct(n.alias("keypoint"), *[place(n, c).alias(c) for c in ("x", "y", "likelihood")])).alias("__places")
    )


def mask_low_confidence(df: DataFrame, threshold: float = 0.9, inclusive: bool = False) -> DataFrame:
    good = F.col("confidence") >= threshold if inclusive else F.col("confidence") > threshold
    return df.withColumns({"x": F.when(good, F.col("x")), "y": F.when(good, F.col("y"))})


def sync_timebase(tracks: DataFrame, timebase: DataFrame, keys: Sequence[str], frame: str, raw: str) -> DataFrame:
    """Frames with their video time, from the first common frame; the longer side is trimmed."""
    joined = tracks.join(timebase.select(*keys, frame, F.col(raw).alias("time_raw")), [*keys, frame])
    zero = timebase.groupBy(*keys).agg(F.min_by(raw, frame).alias("__t0"))
    return joined.join(zero, list(keys)).withColumn("time", F.col("time_raw") - F.col("__t0")).drop("__t0")


def scan_session_parquet(spark: SparkSession, root: str, table: str, label_pattern: str | None = None) -> DataFrame:
    """One table of every session, in files under `root/session=*/` or, with the session as a column, under `root` itself; with a pattern
    the file stem gives a `keypoint` label. Partition pruning, pushdown and column pruning apply."""
    df = spark.read.option("basePath", root).parquet(f"{root}/{{session=*/{table}*,{table}*}}")
    if label_pattern is None:
        return df
    return df.withColumn("keypoint", F.regexp_extract(F.col("_metadata.file_path"), label_pattern, 1))


def discover_sessions(spark: SparkSession, root: str | DataFrame, needed: str = "intermediate_data") -> DataFrame:
    """Session ids that have the data folder, read from file paths alone: those under a folder, none of which is opened, or the
    `path` column of a table of packed files."""
    listed = root if isinstance(root, DataFrame) else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listed.select("path").where(F.col("path").contains(f"/{needed}/")).select(
        session_from_path(F.col("path")).alias("session")
    ).where(F.col("session").isNotNull()).distinct()


def scan_quality_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One quality report per file (or per line); `percentiles` stays a map of maps."""
    schema = (
        "session_id string, pred_csv string, total_licks bigint, licks_with_movement bigint, "
        "coverage_pct double, percentiles map<string,map<string,double>>"
    )
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


def flatten_percentiles(reports: DataFrame, metrics: Sequence[str], pcts: Sequence[str]) -> DataFrame:
    """`<metric>_<pct>` columns; a missing key gives 0."""
    def value(m: str, p: str) -> Column:
        return F.coalesce(F.try_element_at(F.try_element_at("percentiles", F.lit(m)), F.lit(p)), F.lit(0.0)).alias(f"{m}_{p}")

    return reports.select(*[c for c in reports.columns if c != "percentiles"], *[value(m, p) for m in metrics for p in pcts])


def scan_kv_text(spark: SparkSession, path: str | DataFrame, fields: Mapping[str, str], camera: str = r"([A-Za-z]+)_stats\.txt$") -> DataFrame:
    """'Key: value' files as one row per file with typed columns named by `fields`; `path` is a folder or a table of packed files."""
    lines = _lines(spark, path).select("path", F.split("value", ":", 2).alias("kv")).where(F.size("kv") == 2)
    key, value = F.trim(F.get("kv", F.lit(0))), F.trim(F.get("kv", F.lit(1))).try_cast("double")
    return lines.groupBy("path").agg(*[F.max(F.when(key == k, value)).alias(n) for k, n in fields.items()]).withColumns({
        "session": session_from_path(F.col("path")), "camera": F.regexp_extract("path", camera, 1),
    })


def scan_units(units: DataFrame, selected: DataFrame) -> DataFrame:
    """Units restricted to the selected ids of each session."""
    return units.join(selected.select("session", "unit"), ["session", "unit"], "left_semi")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def tidy_events(channels: DataFrame, cues: DataFrame, keys: Sequence[str], width: float | None = None, adjust: bool = True) -> DataFrame:
    """All event channels but photometry as (t, data, event, raw_timestamps, trial).

    `channels` has event, timestamp, data; `cues` trial and raw cue time. Times count from the
    first cue; trial is -1 before it.
    """
    from tempora.operators.timejoin import event_trial_index

    zero = cues.groupBy(*keys).agg(F.min("cue").alias("__t0"))
    rows = channels.where(~F.col("event").rlike(PHOTOMETRY) & ~F.col("event").rlike(SYNC) & F.col("timestamp").isNotNull())
    own = cues.select(*keys, F.col("cue").alias("timestamp"), F.lit(1.0).alias("data"), F.lit("goCue_start_time").alias("event"))
    both = rows.select(*keys, "timestamp", "data", "event").unionByName(own).join(zero, list(keys))
    shifted = both.select(
        *keys, (F.col("timestamp") - (F.col("__t0") if adjust else F.lit(0.0))).alias("t"), "data", "event",
        F.col("timestamp").alias("raw_timestamps"),
    )
    clocks = cues.join(zero, list(keys)).select(
        *keys, "trial", (F.col("cue") - (F.col("__t0") if adjust else F.lit(0.0))).alias("__cue")
    )
    return event_trial_index(shifted, clocks, keys, "t", "__cue", "trial", width)


def tidy_photometry(channels: DataFrame, keys: Sequence[str], t: str, names: Sequence[str] | None = None) -> DataFrame:
    """Photometry and sync channels only; with `names`, one column per channel by timestamp."""
    rows = channels.where(F.col("event").rlike(PHOTOMETRY) | F.col("event").rlike(SYNC))
    if names is None:
        return rows
    return rows.groupBy(*keys, t).pivot("event", list(names)).agg(F.first("data"))


def first_present(*columns: Column) -> Column:
    """First usable of several fields: null, empty and NaN are passed over."""
    def usable(c: Column) -> Column:
        text = F.nullif(F.trim(c.cast("string")), F.lit(""))
        return F.when(F.lower(text) != "nan", text)

    return F.coalesce(*[usable(c) for c in columns])


def acquisition_to_trials(records: DataFrame, keys: Sequence[str], fields: Mapping[str, str], harp: str = "") -> DataFrame:
    """Parallel arrays of one acquisition record as one row per trial.

    `fields` maps output column to array column. The go-cue clock is the CPU array without
    `harp`, else the old Harp array or, where that is absent, the sound-card array.
    """
    cue = F.col("B_GoCueTime") if not harp else F.coalesce("B_GoCueTimeHarp", "B_GoCueTimeSoundCard")
    arrays = {"goCue_start_time": cue, **{n: F.col(c) for n, c in fields.items()}}
    zipped = records.select(*keys, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])))
    return zipped.select(*keys, F.col("pos").cast("bigint").alias("trial"), *[F.col(f"col.{n}").alias(n) for n in arrays])


def acquisition_fields(
    records: DataFrame, keys: Sequence[str], condition: str, fields: Mapping[str, Sequence[str]],
    conditions: Sequence[int], defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per trial and record with text fields taken from parallel arrays.

    `fields` maps an output column to the array columns it may come from, the first usable value first. `{c}` in a name stands
    for the trial's own condition, one of `conditions`; a trial without a condition (0 or null) has none of
    these. Arrays that a table lacks are passed over, and so are values past an array's end. What is still missing gets its default.
    """
    at, have = F.col("trial").cast("int"), set(records.columns)
    trials = records.select("*", F.posexplode(condition).alias("trial", "condition")).withColumn("trial", F.col("trial").cast("bigint"))

    def value(name: str) -> Column | None:
        if "{c}" not in name:
            return F.get(F.col(name), at) if name in have else None
        own = [(c, name.format(c=c)) for c in conditions if name.format(c=c) in have]
        return first_match_value([(F.col("condition") == c, F.get(F.col(n), at)) for c, n in own])

    out = {}
    for name, sources in fields.items():
        usable = [v for v in map(value, sources) if v is not None]
        found = first_present(*usable) if usable else F.lit(None).cast("string")
        out[name] = F.coalesce(found, F.lit((defaults or {}).get(name)))
    return trials.select(*keys, "trial", "condition", *[c.alias(n) for n, c in out.items()])


def first_match_value(cases: Sequence[tuple[Column, Column]]) -> Column | None:
    """Value of the first true condition, null if none is."""
    out = None
    for holds, value in cases:
        out = F.when(holds, value.cast("string")) if out is None else out.when(holds, value.cast("string"))
    return out


def wavelength(colour: Column) -> Column:
    """Laser wavelength of a colour name."""
    return first_match_value([(colour == name, F.lit(nm)) for name, nm in WAVELENGTH.items()]).cast("double")


def stage_position(position: Column) -> list[Column]:
    """x, y, y1, y2 and z of a stage's position map: either one y, or y1 and y2 for the two spouts; null without a position."""
    def axis(name: str) -> Column:
        return F.try_element_at(position, F.lit(name)).cast("double")

    two = axis("y1").isNotNull() & axis("y2").isNotNull()
    return [
        axis("x").alias("position_x"), F.when(~two, axis("y")).alias("position_y"), F.when(two, axis("y1")).alias("position_y1"),
        F.when(two, axis("y2")).alias("position_y2"), axis("z").alias("position_z"),
    ]


def acquisition_events(records: DataFrame, keys: Sequence[str], series: Mapping[str, str]) -> DataFrame:
    """(keys, event, timestamp, data) of every time of every series: lick, reward and photometry arrays, `data` always 1.

    `series` maps an event name to its array column. A series that a record lacks stands as one row without a time.
    """
    lists = F.array(*[
        F.struct(F.lit(event).alias("event"), F.coalesce(F.col(c).cast("array<double>"), F.array(F.lit(None).cast("double"))).alias("times"))
        for event, c in series.items()
    ])
    rows = records.select(*keys, F.explode(lists).alias("s")).select(*keys, "s.event", F.explode("s.times").alias("timestamp"))
    return rows.withColumn("data", F.lit(1.0))


def optogenetics_times(trials: DataFrame, records: DataFrame, keys: Sequence[str], start: str, laser_start: str, other: str) -> DataFrame:
    """(keys, event, timestamp, data) of laser onsets: starts of the trials whose laser starts with the trial, and the times recorded for all others."""
    with_trial = trials.where(F.col(laser_start) == WITH_TRIAL).select(*keys, F.col(start).cast("double").alias("timestamp"))
    recorded = records.select(*keys, F.explode(F.coalesce(F.col(other).cast("array<double>"), F.array(F.lit(None).cast("double")))).alias("timestamp"))
    return with_trial.unionByName(recorded).select(*keys, F.lit("optogenetics_time").alias("event"), "timestamp", F.lit(1.0).alias("data"))


def latest_asset(listing: DataFrame, name: str, days: Sequence[str] | None = None) -> DataFrame:
    """Most recent processed asset per session among names `<session>_videoprocessed_<date>_<time>`."""
    parsed = listing.select(
        F.col(name), F.regexp_extract(name, LISTED_NAME, 1).alias("session"),
        F.regexp_extract(name, LISTED_NAME, 2).alias("__day"), F.regexp_extract(name, LISTED_NAME, 3).alias("__time"),
    ).where(F.col("session") != "")
    if days is not None:
        parsed = parsed.where(F.col("__day").isin(list(days)))
    stamp = F.try_to_timestamp(F.concat_ws(" ", "__day", "__time"), F.lit("yyyy-MM-dd HH-mm-ss"))
    return parsed.where(stamp.isNotNull()).groupBy("session").agg(
        F.max_by(name, F.struct(stamp, name)).alias(name), F.count(F.lit(1)).alias("n_runs")
    )


def assets_with_runs(listing: DataFrame, session: str, n_runs: int) -> DataFrame:
    """Assets of sessions with exactly `n_runs` distinct assets, duplicates removed."""
    unique = listing.distinct()
    complete = unique.groupBy(session).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n_runs)
    return unique.join(complete.select(session), session, "left_semi")


def resolve_with_fallback(sessions: DataFrame, files: DataFrame, session: str, path: str) -> DataFrame:
    """Path by exact session, else the first path of a session with the same prefix."""
    exact = files.select(session, F.col(path).alias("__exact"))
    near = files.groupBy(session_prefix(F.col(session)).alias("__p")).agg(F.min(path).alias("__near"))
    keyed = sessions.withColumn("__p", session_prefix(F.col(session)))
    return keyed.join(exact, session, "left").join(near, "__p", "left").withColumn(
        path, F.coalesce("__exact", "__near")
    ).drop("__p", "__exact", "__near")


def scan_latents(records: DataFrame, keys: Sequence[str], payload: str, alias: str) -> DataFrame:
    """Model latents from a JSON column, one fitted agent only."""
    schema = (
        "agent_alias string, q_value array<array<double>>, choice_kernel array<array<double>>, "
        "choice_prob array<array<double>>, rpe array<double>"
    )
    parsed = records.select(*keys, F.from_json(payload, schema).alias("m"))
    return parsed.where(F.col("m.agent_alias") == alias).select(*keys, "m.*")


def trial_stop_times(trials: DataFrame, keys: Sequence[str], trial: str, start: str, stop: str, width: float | None = None) -> DataFrame:
    """Stop of each trial = start of the next; the last keeps its own stop."""
    near = lagged(trials, keys, [trial], following={"__next": F.col(start)}, width=width)
    return near.withColumn(stop, F.coalesce("__next", stop)).drop("__next")
