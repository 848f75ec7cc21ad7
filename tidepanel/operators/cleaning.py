"""From a messy text table to a canonical panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import PANEL_COLUMNS, in_time
from tidepanel.functions.text import NON_PERIOD_PATTERN, header_key, month_from_text, number_from_text

# Header aliases per canonical column.
COLUMN_ALIASES = {
    "series_id": ("game_name", "gamename", "game", "name", "game_title", "title", "app_name"),
    "ts": ("month_year", "month", "date", "timestamp", "period", "time"),
    "y": ("avg_players", "avg", "avg_player_count", "average_players", "average"),
    "peak": ("peak_players", "peak", "peak_player_count", "highest_players"),
    "gain": ("gain", "net_gain", "player_gain", "diff"),
    "pct_gain": ("percent_gain", "%_gain", "%gain", "percentage_gain", "pct_gain", "gain_percent"),
}
# Headers that already hold a whole period, next to separate month and year columns.
WHOLE_PERIOD_HEADERS = ("month_year", "date", "timestamp", "period")
REQUIRED = ("series_id", "ts", "y")


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Canonical name -> source column; each source is used once, the first match wins."""
    found: dict[str, str] = {}
    for source in columns:
        key = header_key(source)
        for canonical, aliases in COLUMN_ALIASES.items():
            if key in aliases and canonical not in found:
                found[canonical] = source
                break
    return found


def has_month_and_year(columns: list[str]) -> bool:
    keys = {header_key(c) for c in columns}
    return {"month", "year"} <= keys and not keys.intersection(WHOLE_PERIOD_HEADERS)


def standardize(raw: DataFrame) -> DataFrame:
    """Rename aliased headers; join separate month and year columns into one period text."""
    if has_month_and_year(raw.columns):
        by_key = {header_key(c): c for c in raw.columns}
        month, year = by_key["month"], by_key["year"]
        period = F.concat_ws(" ", F.trim(F.col(f"`{month}`").cast("string")), F.col(f"`{year}`").cast("string"))
        raw = raw.withColumn("period", period).drop(month, year)
    found = resolve_headers(raw.columns)
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"cannot identify {missing} among the columns {raw.columns}")
    return raw.select(*[F.col(f"`{found[c]}`").alias(c) for c in PANEL_COLUMNS if c in found])


def _numeric(frame: DataFrame, name: str):
    is_text = frame.schema[name].dataType.simpleString() == "string"
    return number_from_text(F.col(name)) if is_text else F.col(name).cast("double")


def parse_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of a raw table, before de-duplication.  Narrow: no shuffle."""
    df = standardize(raw)
    period = F.col("ts")
    kind = df.schema["ts"].dataType.simpleString()
    text = F.lower(F.trim(period.cast("string")))
    month = F.trunc(period.cast("date"), "MM") if kind in ("date", "timestamp", "timestamp_ntz") else month_from_text(period)
    null = F.lit(None).cast("double")
    name = F.trim(F.col("series_id").cast("string"))
    typed = df.filter((name != "") & (F.lower(name) != "nan") & ~text.rlike(NON_PERIOD_PATTERN)).select(
        name.alias("series_id"),
        month.alias("ts"),
        _numeric(df, "y").alias("y"),
        *[(_numeric(df, c) if c in df.columns else null).alias(c) for c in ("peak", "gain", "pct_gain")],
    )
    kept = typed.filter(F.col("ts").isNotNull() & (F.col("y") >= 0))
    peak = F.bround(F.greatest(F.coalesce("peak", "y"), F.col("y")))
    return kept.withColumn("peak", peak.cast("long"))


def deduplicate(rows: DataFrame) -> DataFrame:
    """One row per (series, month): highest peak, then highest value.

    ``max`` of a struct combines on the map side, so any number of copies of one
    month costs one row per task in the shuffle.
    """
    best = F.max(F.struct("peak", "y", "gain", "pct_gain")).alias("b")
    return rows.groupBy("series_id", "ts").agg(best).select("series_id", "ts", "b.y", "b.peak", "b.gain", "b.pct_gain")


def recompute_gain(panel: DataFrame) -> DataFrame:
    """Gain and percent gain against the previous row of the series."""
    before = F.lag("y").over(in_time())
    return panel.withColumn("gain", F.round(F.col("y") - before, 2)).withColumn(
        "pct_gain", F.round(F.try_divide(F.col("y") - before, before) * 100, 2)
    )


def clean(raw: DataFrame) -> DataFrame:
    """The whole cleaning job: one shuffle to de-duplicate, one to order each series."""
    return recompute_gain(deduplicate(parse_rows(raw))).select(*PANEL_COLUMNS)


def profile(raw: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, detected canonical name, three samples.

    Counts are one aggregation for all columns; samples are the three smallest distinct
    values among the first eight columns.
    """
    found = {source: canonical for canonical, source in resolve_headers(raw.columns).items()}
    counted = raw.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(raw.columns)]
    )
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"n{i}").alias("n_null")) for i in range(len(raw.columns))])
    per_column = counted.select("n_rows", F.explode(pairs).alias("c")).select("c.position", "n_rows", "c.n_null")
    # Only the sampled columns are laid out as cells; equal values combine on the map side.
    cells = F.array(
        *[F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(raw.columns[:8])]
    )
    long = raw.select(F.explode(cells).alias("c")).select("c.position", "c.value").filter(F.col("value").isNotNull()).distinct()
    # row_number <= 3 is a group limit that Spark also applies before the shuffle.
    first = Window.partitionBy("position").orderBy("value")
    samples = (
        long.withColumn("_rn", F.row_number().over(first))
        .filter("_rn <= 3")
        .groupBy("position")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), " | ").alias("samples"))
    )
    names = F.array(*map(F.lit, raw.columns))
    types = F.array(*[F.lit(t) for _, t in raw.dtypes])
    mapped = F.array(*[F.lit(found.get(c)).cast("string") for c in raw.columns])
    at = F.col("position") + 1
    return (
        per_column.join(samples, "position", "left").select(
            F.element_at(names, at).alias("column_name"),
            F.element_at(types, at).alias("column_type"),
            "n_rows", "n_null",
            F.element_at(mapped, at).alias("canonical"),
            F.lit(has_month_and_year(raw.columns)).alias("has_month_and_year"),
            "samples",
        )
    )
