"""Event logs in CSV files."""

from __future__ import annotations

from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trailmark.functions import normalize_type, strip, to_price
from trailmark.params import EVENT_TIME, EVENT_TYPE, PRICE
from trailmark.sources.records import read_records

# Cell texts that stand for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Time formats tried, in this order, after the ISO forms.
TIME_FORMATS = [
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "yyyyMMdd HH:mm:ss",
    "yyyyMMdd",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
]


def parse_time(text: Column) -> Column:
    """A timestamp from any of the known formats, or null."""
    text = strip(text)
    # A bare run of digits is a date only as yyyyMMdd, never a year.
    iso = F.when(~text.rlike(r"^\d+$"), F.try_to_timestamp(text))
    others = [F.try_to_timestamp(text, F.lit(pattern)) for pattern in TIME_FORMATS]
    return F.coalesce(iso, *others)


def parse_time_or_fail(text: Column) -> Column:
    """As ``parse_time``, but a text that is no time fails the job that reads it."""
    parsed = parse_time(text)
    message = F.concat(F.lit(f"Cannot parse '{EVENT_TIME}' as datetime: "), text)
    return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(message)).otherwise(parsed)


def clean_names(columns: list[str]) -> list[str]:
    """Column names stripped and in lower case; they must stay distinct."""
    names = [name.lstrip("\ufeff").strip().lower() for name in columns]
    twice = [name for name, count in Counter(names).items() if count > 1]
    if twice:
        raise ValueError(f"Column names occur more than once: {twice}")
    return names


def normalize_events(raw: DataFrame, parse_dates: bool = True) -> DataFrame:
    """Clean headers and event types, parse times, make prices numeric."""
    named = raw.toDF(*clean_names(raw.columns))
    columns = []
    for field in named.schema.fields:
        value = F.col(f"`{field.name}`")
        textual = isinstance(field.dataType, T.StringType)
        if field.name == EVENT_TYPE:
            value = normalize_type(value)
        elif field.name == EVENT_TIME and parse_dates and textual:
            value = parse_time_or_fail(value)
        elif field.name == PRICE:
            value = to_price(value, field.dataType)
        columns.append(value.alias(field.name))
    return named.select(*columns)


# Private-use characters that mark cells while a suspect row is looked at again.
END_OF_ROW = "\ue000"
CORRUPT = "_corrupt_record"
UNDECODABLE = "\ufffd"
# Encodings in which a quote and a line break are the same bytes everywhere.
SPLITTABLE = ("UTF-8", "UTF8", "ISO-8859-1")


def _parse_records(records: DataFrame, names: list[str], encoding: str) -> DataFrame:
    """Cells and the text of bad rows, as the CSV reader gives them; headers are checked and left out."""
    text = F.col("record")
    if encoding.upper() == "ISO-8859-1":
        text = F.decode(text.cast("binary"), "ISO-8859-1")
    text = F.when(text.endswith("\r"), F.substring(text, 1, F.char_length(text) - 1)).otherwise(text)
    columns = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{column} string" for column in [*columns, "behind"])
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    # The cell behind a row ends its last cell, as a line break does in a file, and tells its length.
    ended = F.concat("record", F.lit("," + END_OF_ROW))
    parsed = (
        records.select("first", text.alias("record"))
        .where(F.col("record") != "")
        .select("first", "record", F.from_csv(ended, schema, options).alias("row"))
    )
    fits = F.coalesce(F.col("row.behind") == END_OF_ROW, F.lit(False))
    same = fits
    for i, (column, name) in enumerate(zip(columns, names)):
        head = F.ltrim(F.coalesce(F.col(f"row.{column}"), F.lit(f"_c{i}")), F.lit("\ufeff"))
        same = same & (F.lower(head) == name.lstrip("\ufeff").lower())
    message = F.lit(f"CSV header does not conform to the columns {names}")
    body = parsed.where(
        F.when(F.col("first") & ~same, F.raise_error(message).cast("boolean")).otherwise(~F.col("first"))
    )
    cells = [F.when(F.col(f"row.{c}") != END_OF_ROW, F.col(f"row.{c}")).alias(n) for c, n in zip(columns, names)]
    return body.select(*cells, F.when(~fits, F.col("record")).alias(CORRUPT))


def _suspect_row(columns: list[str], separator: str, quote: str) -> Column:
    """What is wrong with a row that has not one cell per column; null if it is only short.

    A cell is put behind the row's text and the text is parsed again: in a short row that
    cell falls on one of the columns, in a long row behind them.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    raw = F.col(CORRUPT)
    parsed = F.from_csv(
        F.concat(raw, F.lit(separator + END_OF_ROW)),
        schema.simpleString()[len("struct<") : -1].replace(":", " "),
        {"sep": separator, "quote": quote, "escape": quote, "mode": "PERMISSIVE"},
    )
    cells = F.array(*[parsed[f"c{i}"] for i in range(len(columns))])
    is_short = F.coalesce(F.array_contains(cells, END_OF_ROW), F.lit(False))
    quotes = F.char_length(raw) - F.char_length(F.replace(raw, F.lit(quote), F.lit("")))
    return (
        F.when(raw.isNull(), None)
        .when(quotes % 2 == 1, "a quote is not closed (line break inside quotes? read with multiline=True)")
        .when(~is_short, f"more cells than the {len(columns)} columns of the header")
    )


def read_events_csv(
    spark: SparkSession,
    path: str | list[str],
    parse_dates: bool = True,
    multiline: bool = True,
    encoding: str = "UTF-8",
    errors: str = "strict",
) -> DataFrame:
    """Read CSV files with a header into a normalised event log.

    All columns are read as text, so that types depend on the schema and not
    on a sample. Wrong input fails the job that reads it, with the reason and
    the row: files whose header differs in names or order, rows with more cells
    than the header, and bytes that are not in ``encoding`` (``errors="replace"``
    keeps them as replacement characters). Rows with fewer cells end in nulls.

    Line breaks inside quotes are part of the cell, and large files are still read by
    many tasks (see ``records``): a first pass over the quotes finds where records
    begin, when this is called. Only encodings other than UTF-8 and ISO-8859-1 make a
    file one task. ``multiline=False`` saves that pass, and a quote that is still open
    at the end of a line fails the job.
    """
    if errors not in ("strict", "replace"):
        raise ValueError("errors must be 'strict' or 'replace'")
    reader = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("encoding", encoding)
    )
    try:
        names = reader.csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"CSV file not found: {path}") from error
        raise
    if not names:
        raise ValueError(f"CSV file is empty: {path}")
    clean_names(names)
    # With its own schema a file must have these columns in this order.
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, CORRUPT]])
    records = None
    by_line = not multiline
    if multiline and encoding.upper() in SPLITTABLE:
        records = read_records(spark, path)
        by_line = records is None
    raw = (
        reader.schema(schema)
        .option("multiLine", not by_line)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
        if records is None
        else _parse_records(records, names, encoding)
    )
    cells = {name: F.col(f"`{name}`") for name in names}
    problem = _suspect_row(names, ",", '"')
    if not multiline:
        # An open quote in the last column leaves a full row: its cell begins with the quote.
        opened = F.lit(False)
        for cell in cells.values():
            opened |= F.coalesce(cell.startswith('"') & ~cell.endswith('"'), F.lit(False))
        problem = F.coalesce(problem, F.when(opened, "a quote is not closed; read with multiline=True"))
    if errors == "strict":
        broken = F.lit(False)
        for cell in cells.values():
            broken |= F.coalesce(F.contains(cell, F.lit(UNDECODABLE)), F.lit(False))
        problem = F.coalesce(problem, F.when(broken, f"bytes that are not {encoding}"))
    text = F.concat_ws(",", *cells.values())
    message = F.concat(F.lit("Bad row in CSV file, "), problem, F.lit(": "), F.coalesce(F.col(CORRUPT), text))
    # The filter looks at all cells, so no row escapes it, whatever columns are asked for.
    sound = raw.where(F.when(problem.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    return normalize_events(
        sound.select(
            *[F.when(~cell.isin(NULL_TOKENS), cell).alias(name) for name, cell in cells.items()]
        ),
        parse_dates,
    )


def write_events_csv(
    events: DataFrame,
    path: str,
    mode: str = "errorifexists",
    order_by: list[str] | None = None,
) -> None:
    """Write all rows as CSV with a header, one file per task.

    With ``order_by`` the files, taken in the order of their names, are sorted.
    """
    frame = events.orderBy(*order_by) if order_by else events
    (
        frame.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
