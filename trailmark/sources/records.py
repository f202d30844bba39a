"""Records of CSV files whose quoted cells hold line breaks, found by many tasks.

A line alone does not tell whether it begins inside quotes. But what it does to the two
possible answers is a small function: outside or inside in, outside or inside out. Each byte
range of a file composes the functions of its lines, the compositions are chained along the
ranges of the file, and then every range knows how it begins and can cut its records exactly.
For regular files this is the prefix sum of the parities of quotes; quotes in the middle of
unquoted cells, which open nothing, are told apart by looking at the cells of a line.

Lines without quotes do not reach Python in the first pass. If no record spans lines, lines
are the records and nothing else does. Records that span ranges come in pieces, a few
a range, which are put together by file and order. No task holds more than one such record.

Lines end in ``\\n`` or ``\\r\\n``. The ranges are those of Spark's text source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailmark.tasks import map_batches

# A quoted cell may go on behind its closing quote up to the next comma; other cells hold quotes as they are.
_CELLS = rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+'
_OPEN_CELL = re.compile(_CELLS + rb'"(?:[^"]++|"")*+\Z')
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"[^,]*+')

RANGE = ["file", "start", "length"]


@dataclass(frozen=True)
class Range:
    """Bytes of a file: whether the first and the last line meet open quotes, and the line ends of the file."""

    key: tuple[int, int, int]
    begins_inside: bool
    ends_inside: bool
    crlf: bool


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside or outside quotes ends inside."""
    at = 0
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        at = closing.end() + 1
    return at < len(line) and _OPEN_CELL.match(line, at) is not None


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` (bytes) of every line with the byte range it begins in; a file is named by a hash."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("value").cast("binary").alias("value"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
    )


def ranges_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.Array]]:
    """The stretches of lines of one range, in order."""
    keys = list(zip(*[batch.column(name).to_pylist() for name in RANGE])) if batch.num_rows else []
    first = 0
    while first < len(keys):
        end = first + 1
        if keys[-1] == keys[first]:
            end = len(keys)
        while end < len(keys) and keys[end] == keys[first]:
            end += 1
        yield keys[first], batch.column("value").slice(first, end - first)
        first = end


def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, by how it begins: whether it ends inside quotes, and how many of its lines do."""
    found: dict[tuple, list] = {}  # a task reads a few ranges
    for batch in batches:
        for key, lines in ranges_of(batch):
            state = found.setdefault(key, [False, True, 0, 0])
            for line in lines.to_pylist():
                for which in (0, 1):
                    state[which] = ends_inside(line, state[which])
                    state[2 + which] += state[which]
    columns = [list(column) for column in zip(*[(*key, *state) for key, state in found.items()])]
    if columns:
        yield pa.RecordBatch.from_arrays(
            [pa.array(column) for column in columns],
            names=[*RANGE, "out_ends_inside", "in_ends_inside", "out_lines", "in_lines"],
        )


def _check_closed(inside: bool) -> None:
    if inside:
        raise ValueError("Bad row in CSV file, a quote is not closed at the end of a file")


def _first_lines(lines: DataFrame) -> list[tuple[tuple, bool]]:
    """All ranges in order, and whether the first line of each ends in ``\\r\\n``."""
    placed = lines.select(*RANGE, F.endswith("value", F.lit(b"\r")).alias("crlf"), F.monotonically_increasing_id().alias("at"))
    found = placed.groupBy(*RANGE).agg(F.min_by("crlf", "at").alias("crlf")).collect()
    return sorted(((r.file, r.start, r.length), r.crlf) for r in found)


def entries(lines: DataFrame) -> tuple[list[Range], bool]:
    """How each range that has lines begins and ends, and whether any record spans lines."""
    quoted = lines.where(F.contains("value", F.lit(b'"')))
    summary = map_batches(
        quoted,
        summarize,
        "file bigint, start bigint, length bigint, out_ends_inside boolean, in_ends_inside boolean, "
        "out_lines bigint, in_lines bigint",
    )
    # one row for each range, like the list of splits that the driver plans from
    by_range = {(r.file, r.start, r.length): r for r in summary.collect()}
    ranges, spans = [], False
    inside, crlf, file = False, False, None
    for key, returns in _first_lines(lines) if by_range else []:
        if key[0] != file:
            _check_closed(inside)
            inside, crlf, file = False, returns, key[0]
        begins, told = inside, by_range.get(key)
        if told is not None:
            spans |= (told.in_lines if inside else told.out_lines) > 0
            inside = told.in_ends_inside if inside else told.out_ends_inside
        ranges.append(Range(key, begins, inside, crlf))
    _check_closed(inside)
    return ranges, spans


def cut(ranges: dict[tuple, Range], whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in one range or, unless ``whole``, the pieces of all others.

    ``part`` is 0 for the end of a record that began before the range, 1 for a whole record and 2
    for the beginning of one that goes on; ``first`` marks the first record of a file that is not empty.
    """
    current, inside, part, first = None, False, 1, False
    held: list[bytes] = []  # lines of the record that is open

    def emit(part: int, records: pa.Array) -> Iterator[pa.RecordBatch]:
        nonlocal first
        flags = [False] * len(records)
        if first:
            filled = next((i for i, r in enumerate(records.to_pylist()) if r not in (b"", b"\r")), None)
            if filled is not None:
                flags[filled], first = True, False
        if whole == (part == 1):
            columns = [pa.array([value] * len(records), pa.int64()) for value in (*current, part)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(flags), records], names=[*RANGE, "part", "first", "record"]
            )

    def joined() -> pa.Array:
        if ranges[current].crlf:  # a line break is one character, as it is outside quotes
            held[:] = [line.removesuffix(b"\r") for line in held]
        return pa.array([b"\n".join(held)], pa.binary())

    for batch in batches:
        for key, lines in ranges_of(batch):
            if key != current:
                if held:
                    yield from emit(2 if part == 1 else 0, joined())
                if key not in ranges:
                    raise ValueError("files or spark.sql.files.maxPartitionBytes have changed since the log was opened")
                current, inside, held = key, ranges[key].begins_inside, []
                part, first = 0 if inside else 1, key[1] == 0
            done = 0  # lines before this one are dealt with
            for i in pc.indices_nonzero(pc.match_substring(lines, b'"')).to_pylist():
                if inside:
                    held += lines.slice(done, i - done).to_pylist()
                elif i > done:
                    yield from emit(1, lines.slice(done, i - done))
                held.append(lines[i].as_py())
                inside, done = ends_inside(held[-1], inside), i + 1
                if not inside:
                    yield from emit(part, joined())
                    held, part = [], 1
            if inside:
                held += lines.slice(done).to_pylist()
            elif done < len(lines):
                yield from emit(1, lines.slice(done))
    if held:
        yield from emit(2 if part == 1 else 0, joined())


def put_together(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a beginning and all that follows up to the next one."""
    in_order = Window.partitionBy("file").orderBy("start", "part")
    numbered = pieces.withColumn("number", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(in_order))
    texts = F.sort_array(F.collect_list(F.struct("start", F.col("record").cast("string").alias("text"))))
    return (
        numbered.groupBy("file", "number")
        .agg(texts.alias("texts"), F.max("first").alias("first"))
        .select("first", F.array_join("texts.text", "\n").alias("record"))
    )


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """``record`` (text) and whether it is the ``first`` of its file, for all records; None if every line is one."""
    lines = read_lines(spark, path)
    ranges, spans = entries(lines)
    if not spans:
        return None
    shared = spark.sparkContext.broadcast({r.key: r for r in ranges})
    schema = "file bigint, start bigint, length bigint, part bigint, first boolean, record binary"

    def records(whole: bool):
        return lambda batches: cut(shared.value, whole, batches)

    found = map_batches(lines, records(True), schema).select("first", F.col("record").cast("string"))
    torn = [r.key for r in ranges if r.begins_inside or r.ends_inside]
    if torn:
        chosen = lines.join(F.broadcast(spark.createDataFrame(torn, schema.split(", part")[0])), RANGE)
        pieces = map_batches(chosen.select("value", *RANGE), records(False), schema)
        found = found.unionByName(put_together(pieces))
    return found
