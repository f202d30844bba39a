"""Checks of a log before it is analysed, and a best-effort clean-up of its columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trailmark.functions import percent, strip, to_price
from trailmark.params import (
    EVENT_TIME,
    EVENT_TYPE,
    EVENT_TYPES,
    OPTIONAL_COLUMNS,
    PRICE,
    PRODUCT_ID,
    REQUIRED_COLUMNS,
    USER_ID,
)
from trailmark.sources.csv import parse_time

# Shares in percent above which a column is worth a warning or unusable.
MANY_BAD_PRICES = 50
MANY_NULLS = 30
TOO_MANY_NULLS = 80


@dataclass
class ValidationResult:
    """Outcome of a validation. Errors forbid an analysis, warnings do not."""

    is_valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    row_count: int = 0
    column_count: int = 0
    #: All event types outside the vocabulary, as a table; None when there are none.
    unknown_types: DataFrame | None = None

    def fail(self, message: str) -> None:
        self.is_valid = False
        self.errors.append(message)

    def summary(self) -> str:
        status = "PASSED" if self.is_valid else "FAILED"
        head = f"Validation {status} ({self.row_count:,} rows x {self.column_count} columns)"
        lines = [f"  error: {text}" for text in self.errors]
        lines += [f"  warning: {text}" for text in self.warnings]
        return "\n".join([head, *lines])


def _missing(frame: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(frame.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def quality_metrics(frame: DataFrame) -> DataFrame:
    """One row of counts about the log, in one pass; only columns that exist are looked at."""
    present = set(frame.columns)
    metrics = [
        F.count("*").alias("row_count"),
        F.lit(len(frame.columns)).cast("bigint").alias("column_count"),
    ]
    if EVENT_TYPE in present:
        kind = F.col(EVENT_TYPE)
        metrics += [
            F.count_if(~kind.isin(EVENT_TYPES)).alias("unknown_type_rows"),
            F.count_if(kind == "view").alias("view_rows"),
        ]
    if PRICE in present:
        price = to_price(F.col(PRICE), frame.schema[PRICE].dataType)
        metrics += [
            F.count_if(price.isNull()).alias("bad_price_rows"),
            F.count_if(price < 0).alias("negative_price_rows"),
        ]
    if EVENT_TIME in present and isinstance(frame.schema[EVENT_TIME].dataType, T.StringType):
        time = F.col(EVENT_TIME)
        metrics.append(
            F.count_if(time.isNotNull() & parse_time(time).isNull()).alias("bad_time_rows")
        )
    for name in REQUIRED_COLUMNS:
        if name in present:
            metrics.append(F.count_if(_missing(frame, name)).alias(f"null_{name}"))
    counted = frame.agg(*metrics)
    rates = [
        percent(F.col(f"null_{name}"), F.col("row_count")).alias(f"null_pct_{name}")
        for name in REQUIRED_COLUMNS
        if name in present
    ]
    return counted.select("*", *rates)


def unknown_event_types(frame: DataFrame) -> DataFrame:
    """Event types outside the known vocabulary, sorted."""
    kind = F.col(EVENT_TYPE)
    return (
        frame.where(kind.isNotNull() & ~kind.isin(EVENT_TYPES))
        .select(EVENT_TYPE)
        .distinct()
        .orderBy(EVENT_TYPE)
    )


def validation_report(frame: DataFrame) -> DataFrame:
    """One row per finding: ``level`` (info, warning, error), ``check``, ``count``.

    The two infos are the numbers of rows and columns. A log without rows or
    columns has no other finding than that.
    """
    spark = frame.sparkSession
    finding = "level string, check string, count bigint"
    if not frame.columns:
        return spark.createDataFrame(
            [("info", "rows", 0), ("info", "columns", 0), ("error", "no_rows", 0)], finding
        )
    present = set(frame.columns)
    seen = quality_metrics(frame)
    rows = F.col("row_count")

    def share(name: str) -> Column:
        return F.col(name) / rows * 100

    found: list[tuple[str, str, Column | bool, Column | int]] = []
    for name in REQUIRED_COLUMNS:
        found.append(("error", f"missing_{name}", name not in present, 1))
    for name in OPTIONAL_COLUMNS:
        found.append(("warning", f"missing_{name}", name not in present, 1))
    if EVENT_TYPE in present:
        unknown = F.col("unknown_type_rows")
        found.append(("warning", "unknown_type_rows", unknown > 0, unknown))
        found.append(("error", "no_views", F.col("view_rows") == 0, 0))
    if PRICE in present:
        bad, negative = F.col("bad_price_rows"), F.col("negative_price_rows")
        found.append(("warning", "bad_price_rows", share("bad_price_rows") > MANY_BAD_PRICES, bad))
        found.append(("warning", "negative_price_rows", negative > 0, negative))
    for name in REQUIRED_COLUMNS:
        if name in present:
            nulls = f"null_{name}"
            found.append(("warning", nulls, share(nulls) > MANY_NULLS, F.col(nulls)))
            found.append(("error", nulls, share(nulls) > TOO_MANY_NULLS, F.col(nulls)))
    if "bad_time_rows" in seen.columns:
        found.append(("error", "bad_time_rows", F.col("bad_time_rows") > 0, F.col("bad_time_rows")))

    def row(level: str, check: str, count: Column | int) -> Column:
        count = F.lit(count) if isinstance(count, int) else count
        return F.struct(
            F.lit(level).alias("level"), F.lit(check).alias("check"), count.cast("bigint").alias("count")
        )

    entries = []
    for level, check, holds, count in found:
        if isinstance(holds, bool):
            holds = F.lit(holds)
        entries.append(F.when(holds, row(level, check, count)))
    general = [row("info", "rows", rows), row("info", "columns", len(frame.columns))]
    empty = F.array(*general, row("error", "no_rows", 0))
    full = F.concat(F.array(*general), F.filter(F.array(*entries), lambda entry: entry.isNotNull()))
    return seen.select(F.inline(F.when(rows == 0, empty).otherwise(full)))


def validate(frame: DataFrame) -> ValidationResult:
    """Check columns, types, prices, null rates and times of a raw log.

    A view of ``validation_report`` on the driver, with the findings in words.
    """
    result = ValidationResult(column_count=len(frame.columns))
    try:
        found = [tuple(row) for row in validation_report(frame).collect()]
        result.row_count = next(count for _, check, count in found if check == "rows")
        if any(check == "unknown_type_rows" for _, check, _ in found):
            result.unknown_types = unknown_event_types(frame)
            n_types = result.unknown_types.count()
        else:
            n_types = 0
    except PySparkException as error:
        result.fail(f"the check itself failed: {error}")
        return result
    absent = [
        [check.removeprefix("missing_") for l, check, _ in found if l == level and check.startswith("missing_")]
        for level in ("error", "warning")
    ]
    if absent[0]:
        result.fail(f"required columns are missing: {absent[0]}")
    if absent[1]:
        result.warnings.append(f"optional columns are missing, some results may be: {absent[1]}")
    for level, check, count in found:
        share = count / max(result.row_count, 1) * 100
        column = check.removeprefix("null_")
        text = {
            "no_rows": "there are no rows to analyse",
            "unknown_type_rows": f"{n_types:,} unknown event types in {count:,} rows, listed in unknown_types",
            "no_views": "no 'view' events, a funnel cannot be built",
            "bad_price_rows": f"{share:.1f}% of prices are missing or no numbers",
            "negative_price_rows": f"{count:,} prices are negative",
            "bad_time_rows": f"{count:,} values of '{EVENT_TIME}' are no times",
        }.get(check)
        if check.startswith("null_"):
            text = (
                f"column '{column}' is {share:.1f}% null"
                if level == "warning"
                else f"column '{column}' is more than {TOO_MANY_NULLS}% null"
            )
        if text and level == "error":
            result.fail(text)
        elif text:
            result.warnings.append(text)
    return result


def coerce_columns(frame: DataFrame) -> DataFrame:
    """Strip all text, make prices numbers and ids text. Missing ids stay null."""
    columns = []
    for item in frame.schema.fields:
        value = F.col(f"`{item.name}`")
        if item.name == PRICE:
            value = to_price(value, item.dataType)
        elif item.name in (USER_ID, PRODUCT_ID):
            value = strip(value.cast("string"))
        elif isinstance(item.dataType, T.StringType):
            value = strip(value)
        columns.append(value.alias(item.name))
    return frame.select(*columns)
