"""Benchmark decontamination: an FM-index per shard of training text.

The phrases are the windows of 10 consecutive words of every benchmark item (an
item of fewer words is one phrase). A shard is a block of whole documents of one
task. Its words become symbols: the number of the word among the phrases' words,
or nothing for a word that no phrase has. Runs of such words that are long enough
to hold a phrase are indexed; phrases are searched backwards through the
wavelet matrix, all at once, occurrences are located from sampled positions, and
the spans they cover are merged. Documents are never shuffled.

The benchmark is dealt in parts of at most ``PART_BYTES`` bytes of text, one
broadcast at a time, however large it is; the documents are written down between
two parts. Usually there is one part.

Defined cases: a null or wordless text has no words and no hits; null and
wordless items have no phrases; a null ``item_id`` counts as the text ``null``;
items with equal ids count once; repeated documents each get their row; other
columns of the documents are carried along, unless a result column has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trailmark.llm.fm_index import FMIndex
from trailmark.llm.tasks import map_batches
from trailmark.llm.words import LOWERED, Block, blocks, find_words, hash_words, without_columns
from trailmark.storage import materialize

WINDOW = 10
SHARD_BYTES = 4 << 20
PART_BYTES = 8 << 20

SPAN = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("word", "end_word", "byte", "end_byte")]
)
RESULTS = ["n_words", "spans", "items"]


class Phrases:
    """The phrases of some items: distinct rows of word numbers, by length, with their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([text for _, text in items], pa.string())
        of_item: list[np.ndarray] = []
        for block in blocks(texts):
            words = find_words(block, LOWERED)
            hashes = hash_words(block, words, fold=True)
            of_item += np.split(hashes, words.first[1:-1])
        self.words = np.unique(np.concatenate([*of_item, np.zeros(0, np.uint64)]))
        self.names = np.array([name for name, _ in items], object)
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, hashes in enumerate(of_item):
            if len(hashes):
                numbers = np.searchsorted(self.words, hashes) + 1
                length = min(window, len(numbers))
                windows = np.lib.stride_tricks.sliding_window_view(numbers, length)
                by_length.setdefault(length, []).append((windows, item))
        self.groups = []  # (rows, first item of each row, items)
        for length, found in sorted(by_length.items()):
            rows = np.concatenate([windows for windows, _ in found])
            items_of = np.repeat([item for _, item in found], [len(w) for w, _ in found])
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), items_of]), axis=1)
            first = np.searchsorted(pairs[0], np.arange(len(rows) + 1))
            self.groups.append((rows, first, pairs[1]))
        self.shortest = min(by_length, default=0)


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of many ranges, and the range that each is from."""
    lengths = end - start
    owner = np.repeat(np.arange(len(start)), lengths)
    before = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) - before[owner] + start[owner], owner


def search_block(block: Block, phrases: Phrases):
    """Words of a block; hits as (first word, length, item)."""
    words = find_words(block, LOWERED)
    empty = np.zeros(0, np.int64)
    if not phrases.shortest or not len(words.start):
        return words, empty, empty, empty
    hashes = hash_words(block, words, fold=True)
    at = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    known = phrases.words[at] == hashes
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    at_text = words.first[:-1][np.diff(words.first) > 0]
    begins[at_text] = known[at_text]
    position = np.flatnonzero(known)
    run = np.cumsum(begins)[position] - 1
    long_enough = np.bincount(run)[run] >= phrases.shortest if len(run) else known[:0]
    position, run = position[long_enough], run[long_enough]
    if not len(position):
        return words, empty, empty, empty
    # runs one after the other, a separator behind each
    ends = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    symbols = np.insert(at[position] + 1, ends + 1, 0)
    back = np.insert(position, ends + 1, -1)
    run_starts = np.concatenate([[0], np.flatnonzero(symbols == 0)[:-1] + 1])
    index = FMIndex(symbols, run_starts)
    first, length, item = [], [], []
    for rows, first_item, items in phrases.groups:
        low, high = index.search(rows)
        places, phrase = ranges(low, high)
        starts = back[index.locate(places)]
        which, hit = ranges(first_item[phrase], first_item[phrase + 1])
        first.append(starts[hit])
        length.append(np.full(len(hit), rows.shape[1]))
        item.append(items[which])
    return words, np.concatenate(first), np.concatenate(length), np.concatenate(item)


def find_part(phrases: Phrases, batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """Add this part's spans and items to the result columns of a batch."""
    n_words = np.zeros(batch.num_rows, np.int64)
    spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    items: list[list[str]] = [[] for _ in range(batch.num_rows)]
    if "spans" in batch.schema.names:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
    for block in blocks(batch.column(text), SHARD_BYTES):
        words, first, length, item = search_block(block, phrases)
        n_words[block.first_row : block.first_row + block.n_rows] = np.diff(words.first)
        row = np.searchsorted(words.first, first, "right") - 1
        for r in np.unique(row):
            mine = row == r
            base = words.first[r]
            hits = [(s["word"], s["end_word"]) for s in spans[block.first_row + r]]
            start = first[mine] - base
            hits += set(zip(start.tolist(), (start + length[mine]).tolist()))
            spans[block.first_row + r] = [
                {
                    "word": lo,
                    "end_word": hi,
                    "byte": int(words.start[base + lo] - block.offsets[r]),
                    "end_byte": int(words.end[base + hi - 1] - block.offsets[r]),
                }
                for lo, hi in merge_spans(hits)
            ]
            names = set(phrases.names[np.unique(item[mine])])
            items[block.first_row + r] = sorted(names | set(items[block.first_row + r]))
    kept = without_columns(batch.schema.names, RESULTS)
    span_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN]))
    return pa.RecordBatch.from_arrays(
        [batch.column(name) for name in kept]
        + [pa.array(n_words), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
        names=kept + RESULTS,
    )


def merge_spans(spans) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return [tuple(span) for span in merged]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The documents with ``n_words``, merged ``spans`` of hit words and the ``items`` found.

    ``spans`` gives word and byte ranges (ends excluded); adjoining ranges are one span.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    items = materialize(items.distinct(), "benchmark-items")
    n_bytes = F.sum(F.octet_length("text") + F.octet_length("name"))
    size = items.agg(n_bytes).first()[0] or 0
    # parts are dealt by hash: more of them until only single items are beyond the bound
    parts = 1 if size <= part_bytes else 2 * size // part_bytes + 1
    while True:
        part = F.pmod(F.xxhash64("name", "text"), F.lit(parts))
        sizes = items.groupBy(part.alias("part")).agg(n_bytes.alias("size"), F.count(F.lit(1)).alias("n"))
        if parts == 1 or sizes.where((F.col("size") > part_bytes) & (F.col("n") > 1)).isEmpty():
            break
        parts *= 2
    numbers = [row["part"] for row in sizes.select("part").collect()] or [0]
    carried = docs.select(*without_columns(docs.columns, RESULTS))
    schema = carried.schema
    result = T.StructType(
        [*schema.fields, T.StructField("n_words", T.LongType())]
        + [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    for place, number in enumerate(numbers):
        rows = items.where(part == number).collect()
        phrases = spark.sparkContext.broadcast(Phrases([tuple(row) for row in rows], window))

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield find_part(phrases.value, batch, "text")

        carried = map_batches(carried, search, result)
        if place + 1 < len(numbers):
            carried = materialize(carried, "contamination")
    return carried


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every hit span cut out of the text; same columns, all rows.

    White space next to a cut stays. ``n_chars``, where present, is counted anew for cut texts.
    """
    names = docs.columns
    others = [name for name in names if name != "text"]
    # the other columns are in one struct, so that none of them meets a name of a result
    found = find_contamination(docs.select(F.struct(*others).alias("row"), "text"), benchmark, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = batch.column("spans").to_pylist()
            texts = [
                text if not spans else without_spans(text, spans)
                for text, spans in zip(batch.column("text").to_pylist(), all_spans)
            ]
            columns = dict(zip(others, batch.column("row").flatten()))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"]
                new = [n if not s else len(t) for n, s, t in zip(old.to_pylist(), all_spans, texts)]
                columns["n_chars"] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)

    return map_batches(found, cut, docs.schema)


def without_spans(text: str, spans: list[dict]) -> str:
    raw, kept, at = text.encode(), [], 0
    for span in spans:
        kept.append(raw[at : span["byte"]])
        at = span["end_byte"]
    return b"".join([*kept, raw[at:]]).decode()
