from collections import Counter

import pyarrow as pa
from cases import documents, fresh, prose
from test_near_dedup import plain_similarity, shingles

from trailmark.llm import near_dedup
from trailmark.llm.near_dedup import find_near_duplicates, links_between, settle, sign, weighted_sets


def brute_classes(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and plain_similarity(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def heavy_texts(rng):
    """Texts ruled by one line said often, in groups that differ in the rest."""
    line, texts = prose(rng, 6), []
    for _ in range(12):
        common = prose(rng, 60)
        for _ in range(3):
            texts.append(" ".join([line] * 40 + [common, prose(rng, rng.randrange(20, 36))]))
    return texts


def plain_texts(rng):
    """Equal sets of shingles, but for the weight of one line in every second text."""
    texts = []
    for _ in range(12):
        base, line = prose(rng, 100), prose(rng, 6)
        texts += [" ".join([base] + [line] * n) for n in (2, 60)]
    return texts


def test_links_by_weight_and_by_set_are_all_found(spark):
    rng = fresh(24)
    texts = heavy_texts(rng) + plain_texts(rng)
    want = brute_classes(texts)
    assert 12 < len(set(want)) < len(texts)
    got = {row.key_id: row.class_id for row in find_near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_texts_with_equal_sets_share_buckets_whatever_their_weights():
    texts = plain_texts(fresh(25))
    n = len(texts)
    columns = [pa.array([False] * n), *[pa.array(range(n), pa.int64())] * 2, pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["unknown", "key_id", "key_text", "text"])
    buckets = [set(row) for signed in sign([batch]) for row in signed.column("bands").to_pylist()]
    for a, b in zip(buckets[::2], buckets[1::2]):
        assert a & b
    met = Counter(bucket for row in buckets for bucket in row)
    assert max(met.values()) == 2


def crowd(rng):
    """A base that many texts differ from, too much to be linked to it, in pairs that are similar to each other."""
    base, texts = prose(rng, 120).split(), []
    texts.append(" ".join(base))
    for _ in range(12):
        other = list(base)
        for place in rng.sample(range(0, 120, 6), 5):
            other[place] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(other))
        other[rng.randrange(120)] = "twin"
        texts.append(" ".join(other))
    return texts


def settled(spark, texts, **limits):
    nodes = [i.to_bytes(2, "big") for i in range(len(texts))]
    rows = [("all", node, 1) for node in nodes]
    # the first text represents the only bucket
    members = spark.createDataFrame([("all", nodes[0], 9), *rows[1:]], "bucket string, node binary, weight long")
    found = settle(members, spark.createDataFrame(list(zip(nodes, texts)), "node binary, text string"), **limits)
    classes = {bytes(row["node"]): bytes(row["class"]) for row in found.collect()}
    first = {}
    return [first.setdefault(classes[node], i) for i, node in enumerate(nodes)]


def test_what_a_representative_leaves_is_compared_exactly(spark):
    texts = crowd(fresh(27))
    want = brute_classes(texts)
    assert 5 < len(set(want)) < len(texts)
    # one bucket for all, so that finer buckets of two have none to share
    assert settled(spark, texts) == want
    # by blocks of a few texts
    assert settled(spark, texts, levels=1, pair_bytes=4 * near_dedup.TEXT_BYTES) == want


def test_links_between_blocks_are_those_of_all_pairs():
    texts = heavy_texts(fresh(28)) + plain_texts(fresh(29)) + crowd(fresh(30))
    want = brute_classes(texts)
    named = [(i.to_bytes(2, "big"), s) for i, s in enumerate(weighted_sets(pa.array(texts)))]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    half = len(named) // 2
    for left, right in ((named, named[:half]), (named, named[half:])):
        for a, b in links_between(left, right):
            a, b = root(int.from_bytes(a, "big")), root(int.from_bytes(b, "big"))
            parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(texts))] == want
