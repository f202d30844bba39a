"""Line dedup: every repeated run of two or more lines, and content-defined chunks of lines.

Texts are cut into content-defined chunks: lines are hashed, and a rolling hash over ``ROLL``
line hashes ends a chunk behind every line where it is 0 modulo ``MEAN_LINES``: a boundary
depends on the lines around it only, so inserted or missing lines move no other boundary.
Chunks of at least ``MIN_LINES`` lines that are not blank take part. Their hashes are counted
over all documents; the first occurrence, by id and place, stays. Every other one is compared
with the first one byte by byte and removed if they are equal.

``dedup_runs`` is the whole job: chunks first, and then what repeats across their boundaries
or in chunks that differ. Every line that is not blank forms a pair with the next one like it,
blank lines between them included. A pair that also stands at an earlier place (a smaller id, or
further up in the same document without sharing a line) is repeated, and its lines go; of a
repeated run of any length, anywhere in a text, these are all lines. The first occurrence of a
line never goes. In a chunk that is not the first of its kind all pairs are repeated, so it is
looked up as a whole; pairs are looked up one by one inside first occurrences of chunks and
where two chunks meet. Bytes are compared before removal: in a run of repeated pairs every
second one and the last are fetched, which cover all its lines. Blank lines go if the lines
around them go on both sides.

``dedup_lines`` is coarser and lighter: chunks only, with their line breaks. It finds the
repeated runs that hold a whole chunk.

In both, what is shuffled first is a few numbers a chunk or pair. Bytes are fetched only for first
occurrences of repeated ones and sent to the documents that repeat them; a hot one is a
single row on its side of the join, and the other side can be split.

Defined cases: null ids come last and are all different from numbers; rows with equal id and
text count as one document and get equal results; null and empty texts stay as they are; a
document may lose all its lines and then has an empty text; a difference behind equal hashes
leaves both in place; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from trailmark.llm.keys import KEY, bring_back, keyed
from trailmark.llm.tasks import map_batches
from trailmark.llm.words import BYTE_VALUES, PLAIN, Block, Sums, blocks, mix
from trailmark.storage import materialize

ROLL = 2
MEAN_LINES = 4
MIN_LINES = 2


@dataclass
class Lines:
    """All lines of a block: row and bytes of each, whether it ends its text or holds a word byte."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    last: np.ndarray
    filled: np.ndarray
    sums: Sums


@dataclass
class Chunks:
    """All chunks of a block: row, number within the row, bytes and lines of each."""

    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_lines: np.ndarray
    n_filled: np.ndarray
    hash: np.ndarray


@dataclass
class Units:
    """All pairs of a block, and the chunk of each: its index if both lines are inside, else -1."""

    chunks: Chunks
    pairs: Chunks
    inside: np.ndarray


def find_lines(block: Block) -> Lines:
    n = block.n_rows
    breaks = np.flatnonzero(block.data == 10)
    break_row = np.searchsorted(block.offsets, breaks, "right") - 1
    row = np.concatenate([np.arange(n), break_row])
    start = np.concatenate([block.offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, block.offsets[row + 1], np.append(start[1:], 0) - 1)
    word_bytes = np.concatenate([[0], np.cumsum(PLAIN[block.data])])
    return Lines(row, start, end, last, word_bytes[end] > word_bytes[start], Sums(BYTE_VALUES[block.data]))


def find_chunks(block: Block) -> Chunks:
    found = find_lines(block)
    row, start, end, last, sums = found.row, found.start, found.end, found.last, found.sums
    lines = sums.hash(start, end)
    rolling = lines.copy()
    first = np.concatenate([[True], last[:-1]])
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    for back in range(1, ROLL):
        far = np.roll(lines, back)
        rolling = mix(rolling + np.uint64(back)) + np.where(place >= back, far, np.uint64(0))
    cut = last | (mix(rolling) % np.uint64(MEAN_LINES) == 0)
    tail = np.flatnonzero(cut)
    head = np.concatenate([[0], tail[:-1] + 1])
    filled = np.concatenate([[0], np.cumsum(found.filled)])
    number = np.arange(len(head)) - np.searchsorted(row[head], row[head])
    return Chunks(
        row[head],
        number,
        start[head],
        end[tail],
        tail - head + 1,
        filled[tail + 1] - filled[head],
        sums.hash(start[head], end[tail]),
    )


def find_pairs(block: Block) -> Chunks:
    """All lines that are not blank, each with the next one like it in its text, as chunks."""
    lines = find_lines(block)
    full = np.flatnonzero(lines.filled)
    a, b = full[:-1], full[1:]
    same = lines.row[a] == lines.row[b]
    a, b = a[same], b[same]
    row, start, end = lines.row[a], lines.start[a], lines.end[b]
    number = np.arange(len(a)) - np.searchsorted(row, row)
    return Chunks(row, number, start, end, b - a + 1, np.full(len(a), 2), lines.sums.hash(start, end))


def find_units(block: Block) -> Units:
    chunks, pairs = find_chunks(block), find_pairs(block)
    # texts follow each other in a block, so places are in order over all rows
    of_first = np.searchsorted(chunks.start, pairs.start, "right") - 1
    of_last = np.searchsorted(chunks.start, pairs.end - 1, "right") - 1
    return Units(chunks, pairs, np.where(of_first == of_last, of_first, -1))


def list_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that take part with the pairs inside, and, without a number, the pairs where chunks meet."""
    for batch in batches:
        keys = [batch.column(name).to_numpy() for name in KEY]
        unknown = batch.column("unknown").to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text")):
            units = find_units(block)
            chunks, pairs = units.chunks, units.pairs
            whole = np.flatnonzero(chunks.n_filled >= MIN_LINES)
            edges = np.flatnonzero(units.inside < 0)
            inner = np.flatnonzero(units.inside >= 0)
            # pairs inside come in the order of their chunks, each of which has one at least
            ends = np.append(np.searchsorted(units.inside[inner], whole), len(inner))
            order = np.concatenate([inner, edges])
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([ends, len(inner) + np.arange(1, len(edges) + 1)]), pa.int32()),
                pa.StructArray.from_arrays(
                    [
                        pa.array(pairs.number[order].astype(np.int32)),
                        pa.array(pairs.hash[order].view(np.int64)),
                        pa.array((pairs.end - pairs.start)[order].astype(np.int64)),
                    ],
                    names=["number", "hash", "n_bytes"],
                ),
            )
            row = block.first_row + np.concatenate([chunks.row[whole], pairs.row[edges]])
            none = np.arange(len(row)) >= len(whole)
            zeros = np.zeros(len(edges), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unknown[row]),
                    *[pa.array(key[row]) for key in keys],
                    pa.array(np.concatenate([chunks.number[whole], zeros]).astype(np.int32), mask=none),
                    pa.array(np.concatenate([chunks.hash[whole].view(np.int64), zeros]), mask=none),
                    pa.array(np.concatenate([(chunks.end - chunks.start)[whole], zeros]).astype(np.int64), mask=none),
                    lists,
                ],
                names=["unknown", *KEY, "number", "hash", "n_bytes", "pairs"],
            )


def fetch_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks and pairs asked for by number."""
    for batch in batches:
        wanted = batch.column("numbers").to_pylist()
        for block in blocks(batch.column("text")):
            units = find_units(block)
            kinds = {True: units.chunks, False: units.pairs}
            first = {whole: np.searchsorted(kind.row, np.arange(block.n_rows)) for whole, kind in kinds.items()}
            found = [
                (unit["whole"], kinds[unit["whole"]], int(first[unit["whole"]][r]) + unit["number"])
                for r in range(block.n_rows)
                for unit in wanted[block.first_row + r]
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([whole for whole, _, _ in found], pa.bool_()),
                    pa.array([int(kind.hash[i].view(np.int64)) for _, kind, i in found], pa.int64()),
                    pa.array([int(kind.end[i] - kind.start[i]) for _, kind, i in found], pa.int64()),
                    pa.array([block.data[kind.start[i] : kind.end[i]].tobytes() for _, kind, i in found], pa.binary()),
                ],
                names=["whole", "hash", "n_bytes", "bytes"],
            )


def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that take part: document, number, hash and length in bytes."""
    for batch in batches:
        keys = [batch.column(name).to_numpy() for name in KEY]
        unknown = batch.column("unknown").to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text")):
            chunks = find_chunks(block)
            kept = np.flatnonzero(chunks.n_filled >= MIN_LINES)
            row = block.first_row + chunks.row[kept]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(unknown[row]),
                    *[pa.array(key[row]) for key in keys],
                    pa.array(chunks.number[kept].astype(np.int32)),
                    pa.array(chunks.hash[kept].view(np.int64)),
                    pa.array((chunks.end - chunks.start)[kept]),
                ],
                names=["unknown", *KEY, "number", "hash", "n_bytes"],
            )


def fetch_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks asked for by number."""
    for batch in batches:
        wanted = batch.column("numbers").to_pylist()
        for block in blocks(batch.column("text")):
            chunks = find_chunks(block)
            first = np.searchsorted(chunks.row, np.arange(block.n_rows))
            found = [
                int(first[r]) + number
                for r in range(block.n_rows)
                for number in wanted[block.first_row + r]
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunks.hash[found].view(np.int64)),
                    pa.array((chunks.end - chunks.start)[found]),
                    pa.array(
                        [block.data[chunks.start[i] : chunks.end[i]].tobytes() for i in found], pa.binary()
                    ),
                ],
                names=["hash", "n_bytes", "bytes"],
            )


def _result(rows: pa.Array, block: Block, texts: list[bytes | None], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a block with their new texts (None: as they were) and counts."""
    mine = rows.slice(block.first_row, block.n_rows)
    old = pc.struct_field(mine, "text")
    new = pa.array(texts, pa.binary())
    return pa.RecordBatch.from_arrays(
        [mine, pc.if_else(new.is_valid(), new.cast(pa.string()), old), *[pa.array(c.astype(np.int64)) for c in counts]],
        names=["row", "text", "n_lines", "n_removed_chunks", "n_removed_lines"],
    )


def remove_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the chunks that equal the bytes sent along, and what was removed, block by block."""
    for batch in batches:
        rows = batch.column("row")
        for block in blocks(pc.struct_field(rows, "text")):
            sent = batch.column("sent").slice(block.first_row, block.n_rows).to_pylist()
            texts: list[bytes | None] = [None] * block.n_rows
            n_lines, n_chunks, n_gone = (np.zeros(block.n_rows, np.int64) for _ in range(3))
            chunks = find_chunks(block)
            first = np.searchsorted(chunks.row, np.arange(block.n_rows + 1))
            for r in range(block.n_rows):
                mine = range(first[r], first[r + 1])
                n_lines[r] = chunks.n_lines[first[r] : first[r + 1]].sum()
                doubtful = {c["number"]: c["bytes"] for c in sent[r] or ()}
                if not doubtful:
                    continue
                raw = {i: block.data[chunks.start[i] : chunks.end[i]].tobytes() for i in mine}
                gone = [i for i in mine if doubtful.get(i - first[r]) == raw[i]]
                if gone:
                    n_chunks[r] = len(gone)
                    n_gone[r] = chunks.n_lines[gone].sum()
                    left = set(mine).difference(gone)
                    texts[r] = b"\n".join(raw[i] for i in sorted(left))
            yield _result(rows, block, texts, [n_lines, n_chunks, n_gone])


def remove_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines of chunks and pairs that equal the bytes sent along, and what was removed."""
    for batch in batches:
        rows = batch.column("row")
        for block in blocks(pc.struct_field(rows, "text")):
            sent = batch.column("sent").slice(block.first_row, block.n_rows).to_pylist()
            texts: list[bytes | None] = [None] * block.n_rows
            n_runs, n_gone = np.zeros(block.n_rows, np.int64), np.zeros(block.n_rows, np.int64)
            lines, chunks = find_lines(block), find_chunks(block)
            first = np.searchsorted(lines.row, np.arange(block.n_rows + 1))
            first_chunk = np.searchsorted(chunks.row, np.arange(block.n_rows))
            for r in range(block.n_rows):
                if not sent[r]:
                    continue
                start, end = lines.start[first[r] : first[r + 1]], lines.end[first[r] : first[r + 1]]
                full = np.flatnonzero(lines.filled[first[r] : first[r + 1]])
                gone = np.zeros(len(full), bool)
                for unit in sent[r]:
                    if unit["whole"]:
                        chunk = int(first_chunk[r]) + unit["number"]
                        a, b = chunks.start[chunk], chunks.end[chunk]
                        mine = slice(*np.searchsorted(start[full], [a, b]))
                    else:
                        a, b = start[full[unit["number"]]], end[full[unit["number"] + 1]]
                        mine = slice(unit["number"], unit["number"] + 2)
                    if block.data[a:b].tobytes() == unit["bytes"]:
                        gone[mine] = True
                # blank lines follow the lines on both sides of them
                cut = np.zeros(len(start), bool)
                cut[full] = gone
                for i in np.flatnonzero(gone[:-1] & gone[1:]):
                    cut[full[i] : full[i + 1]] = True
                n_gone[r] = cut.sum()
                n_runs[r] = (cut & ~np.concatenate([[False], cut[:-1]])).sum()
                left = [block.data[start[i] : end[i]].tobytes() for i in np.flatnonzero(~cut)]
                texts[r] = b"\n".join(left)
            yield _result(rows, block, texts, [np.diff(first), n_runs, n_gone])


def find_repeats(rows: DataFrame) -> DataFrame:
    """Chunks to compare, by document: ``key_id, key_text, sent`` (number and first one's bytes)."""
    listed = map_batches(
        rows.select(F.col("row.doc_id").isNull().alias("unknown"), *KEY, "text"),
        list_chunks,
        "unknown boolean, key_id bigint, key_text bigint, number int, hash bigint, n_bytes bigint",
    )
    chunks = materialize(listed, "line-chunks")
    place = F.struct("unknown", *KEY, "number")
    repeated = (
        chunks.groupBy("hash", "n_bytes")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
    )
    repeated = materialize(repeated.select("hash", "n_bytes", "first"), "repeated-chunks", small=True)
    firsts = materialize(
        repeated.groupBy(F.col("first.key_id").alias("key_id"), F.col("first.key_text").alias("key_text")).agg(
            F.collect_list("first.number").alias("numbers")
        ),
        "first-chunks",
    )
    owners, others = bring_back(rows.select(*KEY, "text"), firsts)
    if others is None:
        owners = owners.where("numbers IS NOT NULL")
    content = map_batches(
        owners.select("text", "numbers"), fetch_chunks, "hash bigint, n_bytes bigint, bytes binary"
    )
    named = repeated.select(F.col("hash").alias("h"), F.col("n_bytes").alias("b"), "first")
    later = chunks.join(
        named, (F.col("hash") == F.col("h")) & (F.col("n_bytes") == F.col("b"))
    ).where(place != F.col("first")).dropDuplicates([*KEY, "number"])
    content = content.select(F.col("hash").alias("of"), F.col("n_bytes").alias("of_bytes"), "bytes")
    content = content.dropDuplicates(["of", "of_bytes"])  # rows of one document have the same
    compared = later.select(*KEY, "number", "hash", "n_bytes").join(
        content, (F.col("hash") == F.col("of")) & (F.col("n_bytes") == F.col("of_bytes"))
    )
    return compared.groupBy(*KEY).agg(F.collect_list(F.struct("number", "bytes")).alias("sent"))


def find_repeated_runs(rows: DataFrame) -> DataFrame:
    """Chunks and pairs to compare, by document: ``key_id, key_text, sent`` (kind, number and first one's bytes)."""
    listed = map_batches(
        rows.select(F.col("row.doc_id").isNull().alias("unknown"), *KEY, "text"),
        list_units,
        "unknown boolean, key_id bigint, key_text bigint, number int, hash bigint, n_bytes bigint, "
        "pairs array<struct<number:int,hash:bigint,n_bytes:bigint>>",
    )
    listed = materialize(listed, "line-chunks")
    chunks = listed.where("number IS NOT NULL")
    place = F.struct("unknown", *KEY, "number")

    def repeated(units: DataFrame) -> DataFrame:
        found = units.groupBy("hash", "n_bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        found = found.where(F.col("first") != F.col("last"))
        return found.select(F.col("hash").alias("h"), F.col("n_bytes").alias("b"), "first")

    same = (F.col("hash") == F.col("h")) & (F.col("n_bytes") == F.col("b"))
    many = materialize(repeated(chunks.drop("pairs")), "repeated-chunks", small=True)
    own = [*[F.col(c) for c in ("unknown", *KEY)], F.col("number"), F.col("hash"), F.col("n_bytes")]
    first = F.when(place != F.col("first"), F.col("first")).alias("first")
    # the pairs of a chunk that is not the first one like it go with the chunk
    judged = chunks.join(many, same, "left").select(*own, first, F.when(first.isNull(), F.col("pairs")).alias("pairs"))
    judged = materialize(judged, "judged-chunks", small=True)
    whole = judged.where("first IS NOT NULL").dropDuplicates([*KEY, "number"])
    single = judged.where("first IS NULL").select("unknown", *KEY, "pairs").unionByName(
        listed.where("number IS NULL").select("unknown", *KEY, "pairs")
    )
    pairs = materialize(single.select("unknown", *KEY, F.inline("pairs")), "line-pairs")
    # a pair that shares a line with its first occurrence is not another one
    shares = F.struct("unknown", *KEY, (F.col("number") - 1).alias("number")) == F.col("first")
    later = pairs.join(repeated(pairs), same).where((place != F.col("first")) & ~shares)
    later = later.dropDuplicates([*KEY, "number"])
    # every second pair of a run and its last one hold all its lines
    in_text = Window.partitionBy(*KEY).orderBy("number")
    run = later.withColumn("run", F.col("number") - F.row_number().over(in_text)).withColumn(
        "ends", F.coalesce(F.lead("number").over(in_text) != F.col("number") + 1, F.lit(True))
    )
    begin = F.min("number").over(Window.partitionBy(*KEY, "run"))
    needed = run.withColumn("begin", begin).where(((F.col("number") - F.col("begin")) % 2 == 0) | F.col("ends"))
    wanted = ["whole", *KEY, "number", "hash", "n_bytes", "first"]
    needed = needed.withColumn("whole", F.lit(False)).select(*wanted).unionByName(
        whole.withColumn("whole", F.lit(True)).select(*wanted)
    )
    needed = materialize(needed, "units-to-fetch", small=True)
    firsts = materialize(
        needed.select("whole", "first")
        .distinct()
        .groupBy(F.col("first.key_id").alias("key_id"), F.col("first.key_text").alias("key_text"))
        .agg(F.collect_list(F.struct("whole", F.col("first.number").alias("number"))).alias("numbers")),
        "first-units",
        small=True,
    )
    owners, others = bring_back(rows.select(*KEY, "text"), firsts)
    if others is None:
        owners = owners.where("numbers IS NOT NULL")
    content = map_batches(
        owners.select("text", "numbers"), fetch_units, "whole boolean, hash bigint, n_bytes bigint, bytes binary"
    )
    content = content.select(
        F.col("whole").alias("of_whole"), F.col("hash").alias("of"), F.col("n_bytes").alias("of_bytes"), "bytes"
    )
    content = content.dropDuplicates(["of_whole", "of", "of_bytes"])  # rows of one document have the same
    same = (F.col("hash") == F.col("of")) & (F.col("n_bytes") == F.col("of_bytes"))
    compared = needed.drop("first").join(content, same & (F.col("whole") == F.col("of_whole")))
    return compared.groupBy(*KEY).agg(F.collect_list(F.struct("whole", "number", "bytes")).alias("sent"))


def remove_repeats(
    docs: DataFrame,
    find: Callable[[DataFrame], DataFrame],
    remove: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> DataFrame:
    rows = keyed(docs)
    repeats = materialize(find(rows), "chunks-to-compare")
    # the text is in the row, and goes to Python once
    decided, others = bring_back(rows.select(*KEY, "row"), repeats)
    untouched = F.lit(None).cast(repeats.schema["sent"].dataType).alias("sent")
    result = T.StructType(
        [T.StructField("row", docs.select(F.struct(*docs.columns).alias("row")).schema[0].dataType)]
        + [T.StructField("text", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed_chunks", "n_removed_lines")]
    )
    parts = [decided.select("row", "sent")]
    if others is not None:
        parts.append(others.select("row", untouched))
    done = [map_batches(part, remove, result) for part in parts]
    return done[0] if len(done) == 1 else done[0].union(done[1])


def dedup_runs(docs: DataFrame) -> DataFrame:
    """``row`` (the document as it was), the new ``text``, and counts of lines and runs removed."""
    return remove_repeats(docs, find_repeated_runs, remove_units)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (the document as it was), the new ``text``, and counts of lines and chunks removed."""
    return remove_repeats(docs, find_repeats, remove_chunks)


def without_repeated_lines(
    docs: DataFrame, dedup: Callable[[DataFrame], DataFrame] = dedup_lines
) -> DataFrame:
    """The documents with repeated chunks (or what ``dedup`` finds) removed; same columns.

    A document that had words and keeps none is dropped: all it held is elsewhere.
    ``n_chars``, where present, is counted anew for cut texts.
    """
    result = dedup(docs)
    cut = F.col("n_removed_lines") > 0
    columns = []
    for field in docs.schema.fields:
        value = F.col("row")[field.name]
        if field.name == "text":
            value = F.col("text")
        elif field.name == "n_chars":
            value = F.when(cut, F.char_length("text")).otherwise(value).cast(field.dataType)
        columns.append(value.alias(field.name))
    return result.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)
