"""Passages that occur more than once, found without comparing pairs of documents.

Shared by the two operators that remove repeated passages; they differ in what a symbol is
(a word, a byte) and in how they match the candidates of one group.

Every window of ``window`` symbols holds a closed syncmer: a gram of ``gram`` symbols whose
smallest sub-gram is its first or its last. Whether a gram is one depends on the gram alone,
so equal windows hold equal syncmers (here: anchors), and a window can occur twice only if
all anchors in it do. Consecutive candidate windows with the same routing anchor (smallest
hash, leftmost) form a piece. Equal windows have equal routing anchors at equal places, so
they meet in the group of that anchor. Equal pieces count as one, however many documents
have them; what a group holds are the different surroundings of one gram.

A passage that many documents embed in texts of their own has about one piece per document.
Groups of more than ``MAX_GROUP`` pieces are not gathered: their windows are dealt one by one,
by two hashes of the whole window (which fix the anchor and its offset), and only counts and
smallest ids per window are exchanged, aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from trailmark.llm.keys import KEY, bring_back
from trailmark.llm.tasks import map_batches
from trailmark.llm.words import BYTE_VALUES, PLAIN, Block, Sums, blocks, find_words, hash_words, mix
from trailmark.storage import materialize

REMEMBERED_PIECES = 500_000
#: Groups of more pieces than this are dealt window by window.
MAX_GROUP = 1000


@dataclass(frozen=True)
class Spec:
    words: bool
    window: int
    gram: int
    sub: int
    block: int = 1 << 19

    def __post_init__(self):
        if 2 * self.gram - self.sub - 1 > self.window:
            raise ValueError("a window might hold no anchor")


@dataclass
class Symbols:
    values: np.ndarray
    first: np.ndarray  # row r has symbols first[r]:first[r + 1]
    start: np.ndarray  # their bytes
    end: np.ndarray


def symbols_of(block: Block, spec: Spec) -> Symbols:
    if spec.words:
        words = find_words(block, PLAIN)
        return Symbols(mix(hash_words(block, words)), words.first, words.start, words.end)
    place = np.arange(len(block.data))
    return Symbols(BYTE_VALUES[block.data], block.offsets, place, place + 1)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values: block-wise from both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_anchors(symbols: Symbols, sums: Sums, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors of a block."""
    subs = sums.hash_windows(spec.sub)
    width = spec.gram - spec.sub + 1
    least = sliding_minimum(subs, width)
    n = len(least)
    chosen = np.flatnonzero((subs[:n] == least) | (subs[width - 1 : width - 1 + n] == least))
    row = np.searchsorted(symbols.first, chosen, "right") - 1
    chosen = chosen[chosen + spec.gram <= symbols.first[row + 1]]
    return chosen, sums.hash(chosen, chosen + spec.gram)


def smallest_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the smallest, leftmost value in each range ``low:high`` (none empty)."""
    level = np.arange(len(values))
    result = np.zeros(len(low), np.int64)
    length = high - low
    step = 1
    while len(low):
        mine = (length >= step) & (length < 2 * step)
        left, right = level[low[mine]], level[high[mine] - step]
        result[mine] = np.where(values[right] < values[left], right, left)
        if step * 2 > length.max(initial=0):
            break
        left, right = level[: len(level) - step], level[step:]
        level = np.where(values[right] < values[left], right, left)
        step *= 2
    return result


@dataclass
class Pieces:
    row: np.ndarray
    start: np.ndarray  # first window, as a place in the block
    end: np.ndarray  # behind the last window
    anchor: np.ndarray
    name: np.ndarray  # two hashes of the piece's symbols


def find_pieces(symbols: Symbols, shared: Callable[[np.ndarray, np.ndarray], np.ndarray], spec: Spec) -> Pieces:
    """Runs of candidate windows with one routing anchor."""
    sums = Sums(symbols.values)
    place, hashes = find_anchors(symbols, sums, spec)
    reach = spec.window - spec.gram
    last = symbols.first[1:] - spec.window + 1  # behind the last window of each row
    row = np.searchsorted(symbols.first, place, "right") - 1
    known = shared(row, hashes)
    # between two breaks all windows hold the same anchors
    breaks = np.concatenate([place + 1, place - reach])
    of = np.concatenate([row, row])
    breaks = breaks[(breaks > symbols.first[of]) & (breaks < last[of])]
    breaks = np.unique(np.concatenate([breaks, symbols.first[:-1][last > symbols.first[:-1]]]))
    row = np.searchsorted(symbols.first, breaks, "right") - 1
    end = np.minimum(np.append(breaks[1:], np.iinfo(np.int64).max), last[row])
    low = np.searchsorted(place, breaks)
    high = np.searchsorted(place, breaks + reach, "right")
    unknown = np.concatenate([[0], np.cumsum(~known)])
    good = np.flatnonzero(unknown[high] == unknown[low])
    row, start, end = row[good], breaks[good], end[good]
    anchor = smallest_in(hashes, low[good], high[good])
    joined = np.zeros(len(start), bool)
    joined[1:] = (start[1:] == end[:-1]) & (anchor[1:] == anchor[:-1])
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], len(start))[: len(head)] - 1
    start, end = start[head], end[tail]
    other = Sums(mix(symbols.values ^ np.uint64(0x5851F42D4C957F2D)))
    behind = end - 1 + spec.window
    name = np.stack([sums.hash(start, behind), other.hash(start, behind)], axis=1)
    return Pieces(row[head], start, end, hashes[anchor[head]], name)


def count_anchors(spec: Spec) -> Callable:
    """For each anchor, in how many places (bytes) or documents (words) of a block it is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), spec.block):
                symbols = symbols_of(block, spec)
                place, hashes = find_anchors(symbols, Sums(symbols.values), spec)
                if spec.words:
                    row = np.searchsorted(symbols.first, place, "right") - 1
                    _, once = np.unique(mix(hashes) + row.astype(np.uint64), return_index=True)
                    hashes = hashes[once]
                found, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(n)], names=["anchor", "n"]
                )

    return count


def list_anchors(spec: Spec) -> Callable:
    """Each document's anchors, once."""

    def list_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(name).to_numpy() for name in KEY]
            for block in blocks(batch.column("text"), spec.block):
                symbols = symbols_of(block, spec)
                place, hashes = find_anchors(symbols, Sums(symbols.values), spec)
                row = np.searchsorted(symbols.first, place, "right") - 1
                _, once = np.unique(mix(hashes) + row.astype(np.uint64), return_index=True)
                row = block.first_row + row[once]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(key[row]) for key in keys], pa.array(hashes[once].view(np.int64))],
                    names=[*KEY, "anchor"],
                )

    return list_them


def cut_pieces(spec: Spec) -> Callable:
    """The pieces of documents that come with their shared anchors.

    The body of a piece is sent once a task, as far as it remembers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            keys = [batch.column(name) for name in KEY]
            lists = batch.column("anchors")
            for block in blocks(batch.column("text"), spec.block):
                mine = lists.slice(block.first_row, block.n_rows)
                known = mine.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(block.n_rows), mine.value_lengths().to_numpy())
                pairs = np.sort(mix(known) + owner.astype(np.uint64))

                def shared(row: np.ndarray, hashes: np.ndarray, pairs=pairs) -> np.ndarray:
                    if not len(pairs):
                        return np.zeros(len(hashes), bool)
                    wanted = mix(hashes) + row.astype(np.uint64)
                    return pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted

                symbols = symbols_of(block, spec)
                pieces = find_pieces(symbols, shared, spec)
                names = [name.tobytes() for name in pieces.name]
                bodies: list[bytes | None] = []
                for name, start, end in zip(names, pieces.start.tolist(), pieces.end.tolist()):
                    if name in sent:
                        bodies.append(None)
                        continue
                    if len(sent) >= REMEMBERED_PIECES:
                        sent.clear()
                    sent.add(name)
                    behind = symbols.end[end - 2 + spec.window]
                    body = block.data[symbols.start[start] : behind].tobytes()
                    bodies.append(b" ".join(body.split()) if spec.words else body)
                row = pa.array(block.first_row + pieces.row)
                base = symbols.first[pieces.row]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[key.take(row) for key in keys],
                        pa.array(names, pa.binary()),
                        pa.array(pieces.anchor.view(np.int64)),
                        pa.array(pieces.start - base),
                        pa.array(pieces.end - base),
                        pa.array(bodies, pa.binary()),
                    ],
                    names=[*KEY, "piece", "anchor", "start", "end", "body"],
                )

    return cut


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one anchor after the other; the partition is sorted by anchor."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and group[0]["anchor"] != row["anchor"]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def match_groups(match: Callable[[list[dict]], list[list[int]]]) -> Callable:
    """Apply ``match`` to each group: for every piece, the ranges of windows found elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.binary()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.list_(pa.int64())),
                ],
                names=["piece", "owner", "n", "ranges"],
            )

        for group in groups_of(batches):
            ranges = match(group) if len(group) > 1 else [[]]
            held += [(row["piece"], row["owner"], row["n"], r) for row, r in zip(group, ranges)]
            if len(held) >= 10_000:
                yield batch()
                held = []
        if held:
            yield batch()

    return run


def list_windows(spec: Spec) -> Callable:
    """All windows of pieces: two hashes of each, and its place in its piece."""

    def list_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("body"), spec.block):
                symbols = symbols_of(block, spec)
                n = np.diff(symbols.first) - spec.window + 1
                row = np.repeat(np.arange(block.n_rows), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = symbols.first[row] + place
                other = Sums(mix(symbols.values ^ np.uint64(0x5851F42D4C957F2D)))
                hashes = [sums.hash(start, start + spec.window) for sums in (Sums(symbols.values), other)]
                taken = pa.array(block.first_row + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(name).take(taken) for name in ("piece", "owner", "n")],
                        pa.array(place.astype(np.int32)),
                        *[pa.array(h.view(np.int64)) for h in hashes],
                    ],
                    names=["piece", "owner", "n", "place", "h1", "h2"],
                )

    return list_them


def match_windows(crowded: DataFrame, spec: Spec, ordered: bool) -> DataFrame:
    """``piece, owner, n, ranges`` as from ``match_groups``, but only equal windows meet."""
    crowded = materialize(crowded, "crowded-pieces")
    windows = map_batches(
        crowded.select("piece", "owner", "n", "body"),
        list_windows(spec),
        "piece binary, owner bigint, n bigint, place int, h1 bigint, h2 bigint",
    )
    windows = materialize(windows, "crowded-windows")
    met = windows.groupBy("h1", "h2").agg(
        F.min("owner").alias("least"), F.max("owner").alias("most"), F.count(F.lit(1)).alias("times")
    )
    met = met.where("least < most" if ordered else "times > 1")
    met = met.select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), "least")
    found = windows.join(met, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")))
    # unordered, a piece in several places goes as a whole and needs no ranges
    found = found.where("least < owner" if ordered else "n = 1")
    places = found.groupBy("piece").agg(F.sort_array(F.collect_list("place")).alias("places"))
    first = F.filter("places", lambda p, i: ~(p - 1).eqNullSafe(F.get("places", i - 1)))
    last = F.filter("places", lambda p, i: ~(p + 1).eqNullSafe(F.get("places", i + 1)))
    edges = F.zip_with(first, last, lambda a, b: F.array(a.cast("bigint"), (b + 1).cast("bigint")))
    ranges = places.select(F.col("piece").alias("of"), F.flatten(edges).alias("ranges"))
    joined = crowded.select("piece", "owner", "n").join(ranges, F.col("piece") == F.col("of"), "left")
    none = F.array().cast("array<bigint>")
    return joined.select("piece", "owner", "n", F.coalesce("ranges", none).alias("ranges"))


def ranges_of(flags: np.ndarray) -> list[int]:
    """True runs as [from, to, from, to, ...]."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


def remove_windows(spec: Spec) -> Callable:
    """Texts without the symbols covered by the given windows (row, kept, counts), block by block."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ranges = batch.column("row"), batch.column("ranges")
            for block in blocks(pc.struct_field(rows, "text"), spec.block):
                mine = ranges.slice(block.first_row, block.n_rows).to_pylist()
                symbols = symbols_of(block, spec)
                n = np.diff(symbols.first)
                removed, spans = np.zeros(block.n_rows, np.int64), np.zeros(block.n_rows, np.int64)
                kept: list[bytes] = []
                for r in range(block.n_rows):
                    lo, hi = int(symbols.first[r]), int(symbols.first[r + 1])
                    gone = np.zeros(hi - lo + 1, np.int64)
                    for start, end in mine[r] or ():
                        gone[start] += 1
                        gone[end - 1 + spec.window] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    removed[r] = gone.sum()
                    spans[r] = len(ranges_of(gone)) // 2
                    if spec.words:
                        # white space between words is what bytes.split() takes for it
                        words = block.text(r).split()
                        kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                    else:
                        kept.append(block.data[lo:hi][~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(block.first_row, block.n_rows),
                        pa.array(kept, pa.binary()),
                        pa.array(n.astype(np.int64)),
                        pa.array(removed),
                        pa.array(spans),
                    ],
                    names=["row", "kept", "n_symbols", "n_removed", "n_spans"],
                )

    return remove


def different_pieces(pieces: DataFrame) -> DataFrame:
    """Each piece once: its smallest id, the number of its places, its anchor and its body."""
    return pieces.groupBy("piece").agg(
        F.min("key_id").alias("owner"),
        F.count(F.lit(1)).alias("n"),
        F.first("anchor").alias("anchor"),
        F.max("body").alias("body"),
    )


def find_repeated(
    rows: DataFrame,
    spec: Spec,
    match: Callable[[list[dict]], list[list[int]]],
    ordered: bool,
    max_group: int,
) -> DataFrame:
    """Windows to remove, by document: ``key_id, key_text, ranges`` (array of start, end).

    ``ordered``: a piece is removed from all documents but the one with the smallest id, and
    its windows from that one where ``match`` found them in pieces of smaller ids. Otherwise
    a piece in several places is removed from all, and one in a single place where matched.
    """
    texts = rows.select(*KEY, "text")
    counted = map_batches(texts.select("text"), count_anchors(spec), "anchor bigint, n bigint")
    shared = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = materialize(shared, "shared-anchors")
    listed = map_batches(texts, list_anchors(spec), "key_id bigint, key_text bigint, anchor bigint")
    of_docs = listed.join(shared, "anchor", "left_semi")
    of_docs = materialize(of_docs.groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")), "anchors")
    some, others = bring_back(texts, of_docs)
    if others is None:
        some = some.where("anchors IS NOT NULL")
    pieces = map_batches(
        some.select(*KEY, "text", "anchors"),
        cut_pieces(spec),
        "key_id bigint, key_text bigint, piece binary, anchor bigint, start bigint, `end` bigint, body binary",
    )
    pieces = materialize(pieces, "pieces")
    # every different piece has a body from at least one task, so this is no less than their number
    bodies = pieces.where("body IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("bodies"))
    crowds = bodies.where(F.col("bodies") > max_group).select(F.col("anchor").alias("of"))
    crowds = materialize(crowds, "crowded-anchors")
    crowded = F.col("anchor") == F.col("of")
    some_crowded = not crowds.isEmpty()
    even = different_pieces(pieces.join(crowds, crowded, "left_anti") if some_crowded else pieces)
    dealt = even.repartition("anchor").sortWithinPartitions("anchor", "owner", "piece")
    matched = map_batches(
        dealt, match_groups(match), "piece binary, owner bigint, n bigint, ranges array<bigint>"
    )
    if some_crowded:
        many = different_pieces(pieces.join(crowds, crowded, "left_semi"))
        matched = matched.unionByName(match_windows(many, spec, ordered))
    matched = materialize(matched, "matched-pieces").select(
        F.col("piece").alias("of"), "owner", F.col("n").alias("n_places"), "ranges"
    )
    places = pieces.select(*KEY, "piece", "start", "end").join(matched, F.col("piece") == F.col("of"))
    whole = (F.col("key_id") > F.col("owner")) if ordered else (F.col("n_places") > 1)
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("ranges") / 2).cast("int") - 1),
        lambda i: F.struct(
            (F.col("start") + F.get("ranges", 2 * i)).alias("start"),
            (F.col("start") + F.get("ranges", 2 * i + 1)).alias("end"),
        ),
    )
    found = F.when(whole, F.array(F.struct("start", "end"))).when(F.size("ranges") > 0, pairs)
    hit = places.select(*KEY, F.explode(found).alias("range"))
    return hit.groupBy(*KEY).agg(F.collect_set("range").alias("ranges"))


def remove_repeated(
    rows: DataFrame,
    spec: Spec,
    match: Callable[[list[dict]], list[list[int]]],
    ordered: bool,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """``row, kept, n_symbols, n_removed, n_spans`` for all ``rows`` (keyed documents)."""
    # documents without an id have no place in an order of ids
    inside = rows.where(F.col("row.doc_id").isNotNull()) if ordered else rows
    windows = materialize(find_repeated(inside, spec, match, ordered, max_group), "windows-to-remove")
    # the text is in the row, and goes to Python once
    decided, others = bring_back(rows.select(*KEY, "row"), windows)
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("ranges")
    result = T.StructType(
        [T.StructField("row", rows.schema["row"].dataType), T.StructField("kept", T.BinaryType())]
        + [T.StructField(name, T.LongType()) for name in ("n_symbols", "n_removed", "n_spans")]
    )

    def as_pairs(frame: DataFrame) -> DataFrame:
        pair = F.transform("ranges", lambda r: F.array(r["start"], r["end"]))
        return map_batches(frame.select("row", pair.alias("ranges")), remove_windows(spec), result)

    done = as_pairs(decided.select("row", "ranges"))
    return done if others is None else done.union(as_pairs(others.select("row", none)))
