"""Near-duplicates by ProbMinHash: probability Jaccard of weighted word shingles.

A shingle is five words (a shorter text is one shingle), its weight how often the text has
it. Every shingle is a Poisson process whose rate is its weight: arrivals, drawn from the
shingle's hash, fall on random components of the signature, and the earliest arrival of a
component wins it. A shingle stops as soon as its next arrival comes too late to win, which
is known once all components are taken; the time limit starts where that is likely and is
doubled for the few texts where it is not. Two texts agree in a component with a
probability equal to their probability Jaccard.

Two texts are similar if their probability Jaccard, or the plain Jaccard of their shingle sets,
is at least ``THRESHOLD``. A text with repeated shingles has a second signature, with all
weights 1, for the plain one; for other texts the two signatures are the same.

Exact copies (equal words) are one node from the start. Nodes that agree in a whole band of
a signature share a bucket. Every bucket has one representative, the node whose buckets are the
fullest, as it lies in the middle of its kind; all others are compared with it by their whole
texts and linked if similar. Links make classes, so a group of very many copies costs one
comparison each.

What a representative does not link may still be similar to each other. Where nodes of several
classes are left in a bucket, they are dealt anew by every two of their open buckets, and where
several are left in those, by every three; each of these finer buckets has a representative of
its own. Texts below the threshold seldom share two or three bands, while two at the threshold
share 6.6 of the 20 on average and thus 18 pairs and 32 triples. So far a node is compared with one
other in each of its buckets: the work is in proportion to the nodes.

What is still of several classes in a bucket is compared exactly, every two texts of different
classes. The nodes of a bucket are laid out by class and cut into blocks of bounded size; a task
takes two blocks at a time and gets the common shingles of all their pairs from products of
matrices. Blocks of one and the same class are not paired. This step is quadratic in what is left
in a bucket, but bounded in memory and dealt to all tasks; it returns links only.

So two texts that share a bucket are in one class or were compared. With 20 bands of 5, two texts
at the threshold share a bucket with probability 0.9996.

Defined cases: a text without words is a class of its own; rows with equal id and text are one
document; null ids come last when the one to keep is chosen; a class is named by its
smallest id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trailmark.llm.components import connected_components
from trailmark.llm.keys import KEY, bring_back, keyed
from trailmark.llm.tasks import map_batches
from trailmark.llm.words import PLAIN, Block, Sums, blocks, find_words, hash_words, mix
from trailmark.storage import materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
BAND_ROWS = 5
COMPONENTS = BANDS * BAND_ROWS
#: Arrivals expected within the first time limit: enough to take all components.
FIRST_ARRIVALS = COMPONENTS * (np.log(COMPONENTS) + 3)
#: Buckets of one band, of two, of three.
LEVELS = 3
#: Bytes of a block of texts to be compared with each other; a text counts ``TEXT_BYTES`` more than it has.
PAIR_BYTES = 1 << 21
TEXT_BYTES = 2048
#: Cells of a matrix of texts by shingles.
CELLS = 1 << 20
_STEP = np.uint64(0xD1342543DE82EF95)


def weighted_shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, (row, hash, weight), and two hashes of its words in all."""
    words = find_words(block, PLAIN)
    hashes = hash_words(block, words)
    sums = Sums(mix(hashes + np.uint64(1)))
    count = np.diff(words.first)
    starts = np.arange(max(0, len(hashes) - SHINGLE + 1))
    row = words.row
    inside = starts + SHINGLE <= words.first[row[starts] + 1]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    shingle = np.concatenate(
        [sums.hash_windows(SHINGLE)[inside], sums.hash(words.first[short], words.first[short + 1])]
    )
    row = np.concatenate([row[starts[inside]], short])
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(row))).astype(float)
    other = Sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    names = np.stack(
        [sums.hash(words.first[:-1], words.first[1:]), other.hash(words.first[:-1], words.first[1:])], axis=1
    )
    return row[at], shingle[at], weight, np.where((count > 0)[:, None], names, np.uint64(0))


def arrival(shingle: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The waiting time before a shingle's arrival (at rate 1), and the component it falls on."""
    drawn = mix(shingle + _STEP * (number + np.uint64(1)))
    wait = -np.log((drawn >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
    return wait, (mix(drawn) % np.uint64(COMPONENTS)).astype(np.int64)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """The winning shingle of every component, by text; texts without shingles have zeros."""
    earliest = np.full(n_rows * COMPONENTS, np.inf)
    winner = np.zeros(n_rows * COMPONENTS, np.uint64)
    total = np.bincount(row, weight, n_rows)
    limit = np.divide(FIRST_ARRIVALS, total, out=np.zeros(n_rows), where=total > 0)
    number = np.zeros(len(row), np.uint64)
    wait, component = arrival(shingle, number)
    time = wait / weight
    open_rows = total > 0
    while open_rows.any():
        active = np.flatnonzero(open_rows[row] & (time <= limit[row]))
        while len(active):
            slot = row[active] * COMPONENTS + component[active]
            np.minimum.at(earliest, slot, time[active])
            won = earliest[slot] == time[active]
            winner[slot[won]] = shingle[active[won]]
            number[active] += np.uint64(1)
            wait, component[active] = arrival(shingle[active], number[active])
            time[active] += wait / weight[active]
            active = active[time[active] <= limit[row[active]]]
        open_rows &= np.isinf(earliest).reshape(n_rows, COMPONENTS).any(axis=1)
        limit[open_rows] *= 2
    return winner.reshape(n_rows, COMPONENTS)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash per text and band; the band's number is part of it."""
    grouped = signature.reshape(len(signature), BANDS, BAND_ROWS)
    hashes = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(signature), axis=0)
    for column in range(BAND_ROWS):
        hashes = mix(hashes * _STEP + grouped[:, :, column])
    return hashes


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of every text and its buckets; none for texts without words."""
    for batch in batches:
        keys = [batch.column(name) for name in ["unknown", *KEY]]
        for block in blocks(batch.column("text")):
            row, shingle, weight, names = weighted_shingles(block)
            bands = band_hashes(signatures(row, shingle, weight, block.n_rows)).view(np.int64)
            some = np.bincount(row, minlength=block.n_rows) > 0
            # the plain measure has a signature of its own where shingles are repeated
            repeats = np.bincount(row, weight > 1, block.n_rows) > 0
            mine = repeats[row]
            number = np.cumsum(repeats) - 1
            plain = signatures(number[row[mine]], shingle[mine], np.ones(mine.sum()), int(repeats.sum()))
            plain = band_hashes(plain).view(np.int64)
            of_text = [
                (np.union1d(bands[i], plain[number[i]]) if repeats[i] else bands[i]) if some[i] else bands[i, :0]
                for i in range(block.n_rows)
            ]
            ends = np.cumsum([0, *map(len, of_text)])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate([bands[:0].ravel(), *of_text]))
            )
            node = pa.array([names[i].tobytes() if some[i] else None for i in range(block.n_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[key.slice(block.first_row, block.n_rows) for key in keys], node, lists],
                names=["unknown", *KEY, "node", "bands"],
            )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard and plain Jaccard of two weighted sets (sorted hashes)."""
    union = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, a[0])] = a[1]
    wb[np.searchsorted(union, b[0])] = b[1]
    common = (wa > 0) & (wb > 0)
    if not common.any():
        return 0.0
    # 1 / sum of max(a_j / a_i, b_j / b_i) depends on i by a_i and the ratio b_i / a_i only
    ratio, which = np.unique(wb[common] / wa[common], return_inverse=True)
    own = np.bincount(which, wa[common])
    probability = sum(w / np.maximum(wa, wb / r).sum() for r, w in zip(ratio, own))
    return max(probability, common.sum() / len(union))


def weighted_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingles of every text, sorted, and their weights."""
    sets: list = []
    for block in blocks(texts):
        row, shingle, weight, _ = weighted_shingles(block)
        first = np.searchsorted(row, np.arange(block.n_rows + 1))
        sets += [(shingle[i:j], weight[i:j]) for i, j in zip(first, first[1:])]
    return sets


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar enough."""
    for batch in batches:
        n = batch.num_rows
        sides = [weighted_sets(batch.column(name)) for name in ("text_a", "text_b")]
        similar = pa.array([similarity(sides[0][i], sides[1][i]) >= THRESHOLD for i in range(n)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(similar), batch.column("b").filter(similar)], names=["a", "b"]
        )


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b; nodes) whose ``texts`` (node, text) are similar."""
    ta = texts.select(F.col("node").alias("na"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("nb"), F.col("text").alias("text_b"))
    both = pairs.join(ta, F.col("a") == F.col("na")).join(tb, F.col("b") == F.col("nb"))
    return map_batches(both.select("a", "text_a", "b", "text_b"), compare, "a binary, b binary")


def common_shingles(left: list, right: list, weighted: bool) -> np.ndarray:
    """For every pair of two lists of sets: how many shingles are common, or a bound of the probability Jaccard.

    The bound is the smaller of the shares that the common shingles have of either one's weight.
    """
    of_left, of_right = (np.concatenate([s[0] for s in side]) for side in (left, right))
    known = np.intersect1d(of_left, of_right)
    entries = []
    for side, shingles in ((left, of_left), (right, of_right)):
        row = np.repeat(np.arange(len(side)), [len(s[0]) for s in side])
        share = np.concatenate([s[1] / s[1].sum() for s in side])
        at = np.minimum(np.searchsorted(known, shingles), max(0, len(known) - 1))
        met = known[at] == shingles if len(known) else np.zeros(len(shingles), bool)
        entries.append((row[met], at[met], share[met]))
    sums = [np.zeros((len(left), len(right)), np.float32) for _ in range(1 + weighted)]
    width = max(1, CELLS // max(len(left), len(right)))
    for low in range(0, len(known), width):
        has, shares = [], []
        for side, (row, at, share) in zip((left, right), entries):
            mine = (at >= low) & (at < low + width)
            for matrices, values in ((has, 1), (shares, share[mine])):
                matrices.append(np.zeros((len(side), min(width, len(known) - low)), np.float32))
                matrices[-1][row[mine], at[mine] - low] = values
        if weighted:
            sums[0] += shares[0] @ has[1].T
            sums[1] += has[0] @ shares[1].T
        else:
            sums[0] += has[0] @ has[1].T
    return np.minimum(*sums) if weighted else sums[0]


def links_between(left: list, right: list) -> list[tuple[bytes, bytes]]:
    """Links that join all classes with similar texts in two lists of (class, set)."""
    sets_a, sets_b = ([s for _, s in side] for side in (left, right))
    common = common_shingles(sets_a, sets_b, weighted=False)
    sizes = [np.array([len(s[0]) for s in side], float) for side in (sets_a, sets_b)]
    repeats = [np.array([bool((s[1] > 1).any()) for s in side]) for side in (sets_a, sets_b)]
    number = {name: n for n, name in enumerate(dict.fromkeys(name for name, _ in [*left, *right]))}
    classes = [np.array([number[name] for name, _ in side]) for side in (left, right)]
    apart = classes[0][:, None] != classes[1][None, :]
    by_set = apart & (common / (sizes[0][:, None] + sizes[1][None, :] - common) >= THRESHOLD)
    # the measures differ for texts that repeat shingles only; rounding is left to the exact measure
    bound = np.zeros(common.shape, np.float32)
    some = [np.flatnonzero(r) for r in repeats]
    if len(some[0]):
        bound[some[0]] = common_shingles([sets_a[i] for i in some[0]], sets_b, weighted=True)
    if len(some[1]):
        bound[:, some[1]] = common_shingles(sets_a, [sets_b[j] for j in some[1]], weighted=True)
    by_weight = apart & ~by_set & (bound >= THRESHOLD - 1e-3)
    merged: dict[bytes, bytes] = {}

    def top(name: bytes) -> bytes:
        while name in merged:
            name = merged[name]
        return name

    links = []
    for found, sure in ((by_set, True), (by_weight, False)):
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(found))):
            a, b = top(left[i][0]), top(right[j][0])
            if a != b and (sure or similarity(sets_a[i], sets_b[j]) >= THRESHOLD):
                merged[max(a, b)] = min(a, b)
                links.append((a, b))
    return links


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between classes from all pairs of texts of two blocks; the partition is sorted by pair of blocks."""
    held: tuple = ()
    sides: dict[int, list] = {}

    def links() -> Iterator[pa.RecordBatch]:
        found = links_between(sides[held[1]], sides[held[2]])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

    for batch in batches:
        names = zip(*(batch.column(name).to_pylist() for name in ("bucket", "i", "j", "block", "class")))
        for (bucket, i, j, block, of), words in zip(names, weighted_sets(batch.column("text"))):
            if held != (bucket, i, j):
                if held:
                    yield from links()
                held, sides = (bucket, i, j), {}
            sides.setdefault(block, []).append((of, words))
    if held:
        yield from links()


def renamed_classes(frame: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``frame`` with the classes in ``column`` replaced by what they were merged into."""
    names = merged.select(F.col("node").alias("merged_class"), F.col("class").alias("merged_into"))
    joined = frame.join(names, F.col(column) == F.col("merged_class"), "left")
    return joined.withColumn(column, F.coalesce("merged_into", column)).select(*frame.columns)


def finer_buckets(left: DataFrame, lists: DataFrame) -> DataFrame:
    """Nodes dealt by the buckets ``of`` they were left in and one more of their ``open`` ones."""
    more = F.filter("open", lambda bucket: bucket > F.element_at("of", -1))
    dealt = left.join(lists, "node").select(
        "node", "class", F.explode(F.transform(more, lambda bucket: F.concat("of", F.array(bucket)))).alias("of")
    )
    level = materialize(dealt.select("node", "class", "of", F.xxhash64("of").alias("bucket")), "finer-buckets")
    several = level.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    several = materialize(several.where("low != high").select("bucket"), "finer-open", small=True)
    # written, as it is read for the representatives, the comparisons and what they leave
    return materialize(level.join(several, "bucket", "left_semi"), "finer-members")


def links_left(members: DataFrame, classes: DataFrame, texts: DataFrame, pair_bytes: int) -> DataFrame:
    """Links (a, b) that join the classes that have similar texts in any bucket, from all pairs of different classes."""
    names = classes.select(F.col("node").alias("named"), "class")
    placed = materialize(
        members.select("bucket", "node").join(names, F.col("node") == F.col("named")).drop("named"), "placed-members"
    )
    several = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    several = materialize(several.where("low != high").select("bucket"), "unsettled-buckets", small=True)
    left = placed.join(several, "bucket", "left_semi")
    sizes = texts.select(F.col("node").alias("of"), (F.octet_length("text") + TEXT_BYTES).cast("bigint").alias("size"))
    left = left.join(sizes, F.col("node") == F.col("of")).drop("of")
    # blocks by class, so that those of a large class are not paired with each other
    ahead = F.sum("size").over(Window.partitionBy("bucket").orderBy("class", "node")) - F.col("size")
    left = left.withColumn("block", F.floor(ahead / pair_bytes).cast("int")).drop("size")
    left = materialize(left, "blocks-left", small=True)
    ends = left.groupBy("bucket", "block").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    ends = materialize(ends, "ends-of-blocks", small=True)
    first = ends.select("bucket", F.col("block").alias("i"), F.col("low").alias("low_i"))
    second = ends.select(F.col("bucket").alias("of"), F.col("block").alias("j"), F.col("high").alias("high_j"))
    pairs = first.join(second, F.col("bucket") == F.col("of")).where("i <= j AND low_i != high_j")
    sides = pairs.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = materialize(sides, "pairs-of-blocks", small=True).join(left, ["bucket", "block"]).join(texts, "node")
    met = met.select("bucket", "i", "j", "block", "class", "text").repartition("bucket", "i", "j")
    return map_batches(met.sortWithinPartitions("bucket", "i", "j"), compare_blocks, "a binary, b binary")


def settle(members: DataFrame, texts: DataFrame, levels: int = LEVELS, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """``node, class`` of all ``members`` (bucket, node, weight).

    By representatives of finer and finer buckets, and exactly where several classes are left in a bucket.
    """
    classes = materialize(members.select("node", F.col("node").alias("class")).distinct(), "classes", small=True)
    level = members.select("bucket", "node", F.col("node").alias("class"), F.array("bucket").alias("of"), "weight")
    rank = F.col("weight")
    for depth in range(1, levels + 1):
        best = F.max(F.struct(rank, "node", "class")).alias("best")
        chosen = level.groupBy("bucket").agg(best)
        chosen = materialize(
            chosen.select("bucket", F.col("best.node").alias("a"), F.col("best.class").alias("class_a")),
            "representatives",
            small=True,
        )
        met = level.join(chosen, "bucket").where("class != class_a")
        met = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        links = similar_pairs(met, texts)
        for side in ("a", "b"):
            ends = classes.select(F.col("node").alias("end"), F.col("class").alias(f"class_{side}"))
            links = links.join(ends, F.col(side) == F.col("end")).drop("end")
        links = links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        merged = materialize(connected_components(links), "merged-classes", small=True)
        classes = materialize(renamed_classes(classes, "class", merged), "classes", small=True)
        if depth == levels:
            break
        rest = level.select("bucket", "node", "class", "of").join(
            renamed_classes(chosen, "class_a", merged), "bucket"
        )
        rest = renamed_classes(rest, "class", merged).where("class != class_a")
        rest = materialize(rest.select("bucket", "node", "class", "of"), "not-linked", small=True)
        several = rest.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
        several = materialize(several.where("low != high").select("bucket"), "open-buckets", small=True)
        if several.isEmpty():
            break
        left = rest.join(several, "bucket", "left_semi").select("node", "class", "of")
        if depth == 1:
            lists = left.groupBy("node").agg(F.sort_array(F.collect_set(F.get("of", 0))).alias("open"))
            lists = materialize(lists, "open-lists", small=True)
        # any node may represent a finer bucket: another one in each
        level, rank = finer_buckets(left, lists), F.xxhash64("bucket", "node")
    links = materialize(links_left(members, classes, texts, pair_bytes), "links-left", small=True)
    merged = materialize(connected_components(links), "merged-classes", small=True)
    return materialize(renamed_classes(classes, "class", merged), "classes", small=True)


def classify(rows: DataFrame) -> DataFrame:
    """``unknown, key_id, key_text, class, worded`` for all keyed documents."""
    signed = map_batches(
        rows.select(F.col("row.doc_id").isNull().alias("unknown"), *KEY, "text"),
        sign,
        "unknown boolean, key_id bigint, key_text bigint, node binary, bands array<bigint>",
    )
    signed = materialize(signed, "signatures")
    # one document stands for all that have the same words
    worded = signed.where("node IS NOT NULL")
    nodes = worded.groupBy("node").agg(F.min(F.struct("unknown", *KEY)).alias("stands"))
    stands = worded.join(
        nodes.select(F.col("node").alias("of"), "stands"),
        (F.col("node") == F.col("of")) & (F.struct("unknown", *KEY) == F.col("stands")),
    ).dropDuplicates(["node"])
    members = stands.select("node", *KEY, F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(members.join(crowded, "bucket"), "bucket-members", small=True)
    compared = members.groupBy("node", *KEY).agg(F.sum("n").alias("weight"))
    compared = materialize(compared, "compared-nodes", small=True)
    found, others = bring_back(rows.select(*KEY, "text"), compared.select("node", *KEY))
    if others is None:
        found = found.where("node IS NOT NULL")
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "texts-to-compare")
    weighted = members.select("bucket", "node").join(compared.select("node", "weight"), "node")
    classes = settle(materialize(weighted, "weighted-members", small=True), texts)
    named = signed.select("unknown", *KEY, "node").join(classes, "node", "left")
    # a text without words has no node and is named by its key, longer than a node's name
    alone = F.concat_ws("|", F.lit("without words"), "unknown", *KEY).cast("binary")
    own = F.coalesce("class", "node", alone).alias("class")
    return named.select("unknown", *KEY, own, F.col("node").isNotNull().alias("worded"))


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its key, whether it has words, ``class_id, class_size`` and ``kept``."""
    members = materialize(classify(keyed(docs)), "near-classes")
    best = F.struct("unknown", *KEY)
    classes = members.groupBy("class").agg(
        F.min(best).alias("best"), F.count(F.lit(1)).alias("class_size")
    )
    # written, so that the members of a very large class can be split in the join
    classes = materialize(classes, "class-sizes", small=True)
    joined = members.join(classes.withColumnRenamed("class", "of"), F.col("class") == F.col("of"))
    return joined.select(
        "unknown",
        *KEY,
        "worded",
        F.when(~F.col("best.unknown"), F.col("best.key_id")).alias("class_id"),
        "class_size",
        (best == F.col("best")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every class, and all documents without words; same columns.

    Of rows with equal id and text, one stays.
    """
    rows = keyed(docs)
    judged = materialize(find_near_duplicates(docs).where("worded"), "near-verdicts", small=True)
    dropped = judged.where("NOT kept").select(*KEY, F.lit(True).alias("dropped")).distinct()
    decided, others = bring_back(rows, materialize(dropped, "near-dropped", small=True))
    left = others if others is not None else decided.where("dropped IS NULL")
    repeated = judged.where("kept").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialize(repeated, "near-repeated", small=True)
    if not repeated.isEmpty():
        decided, others = bring_back(left.select(*KEY, "row"), repeated)
        order = Window.partitionBy(*KEY).orderBy(F.xxhash64(F.to_json("row")))
        again = decided.where("n > 1").withColumn("place", F.row_number().over(order)).where("place = 1")
        single = decided.where("n IS NULL") if others is None else others
        left = again.select("row").unionByName(single.select("row"))
    return left.select("row.*")
