from collections import Counter

import numpy as np
from cases import documents, fresh, no_documents, odd_texts, prose, words

from trailmark.llm.components import connected_components
from trailmark.llm.near_dedup import find_near_duplicates, keep_one_of_each, signatures, similarity
from trailmark.llm.words import mix


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_similarity(a, b):
    union, common = set(a) | set(b), set(a) & set(b)
    if not common:
        return 0.0
    probability = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in union) for i in common)
    return max(probability, len(common) / len(union))


def weighted(counter):
    ids = np.array([hash(x) & (2**62 - 1) for x in counter], np.uint64)
    order = np.argsort(mix(ids))
    return mix(ids)[order], np.array(list(counter.values()), float)[order]


def test_similarity_and_its_estimate():
    rng, errors = fresh(5), []
    for _ in range(40):
        a = Counter({i: rng.randrange(1, 4) for i in range(150)})
        b = Counter({i: rng.randrange(1, 4) for i in range(rng.randrange(60), 150)})
        wa, wb = weighted(a), weighted(b)
        assert abs(similarity(wa, wb) - plain_similarity(a, b)) < 1e-9
        probability = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a | b) for i in set(a) & set(b))
        row = np.repeat([0, 1], [len(a), len(b)])
        both = signatures(row, np.concatenate([wa[0], wb[0]]), np.concatenate([wa[1], wb[1]]), 2)
        errors.append((both[0] == both[1]).mean() - probability)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_classes_equal_brute_force(spark):
    rng = fresh(6)
    texts = [prose(rng, 150) for _ in range(20)]
    for base in texts[:6]:
        texts += [edited(rng, base, rng.randrange(6)) for _ in range(12)] + [base]
    texts += ["tiny text", "tiny text", "tiny  text", "tiny Text", None, "", "  "]
    got = {
        row.key_id: row for row in find_near_duplicates(documents(spark, texts)).collect() if not row.unknown
    }
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and root(i) != root(j) and plain_similarity(sets[i], sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    sizes = Counter(root(i) for i in range(len(texts)))
    assert set(got) == set(range(len(texts)))  # those without words are classes of their own
    for i, row in got.items():
        assert (row.class_id, row.class_size, row.kept) == (root(i), sizes[root(i)], i == root(i))


def test_one_of_each_stays(spark):
    docs = documents(spark, odd_texts(fresh()))
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(-1 if row.doc_id is None else row.doc_id for row in kept.collect())
    # the text of 6 is also in 50 (twice) and in one without an id; texts without words all stay
    assert ids == [-1, 0, 1, 2, 3, 4, 5, 6, 11, 12]
    twice = documents(spark, [(7, "some words to repeat here"), (7, "some words to repeat here")])
    assert keep_one_of_each(twice).count() == 1
    assert keep_one_of_each(no_documents(spark)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200)]
    pairs = [(f"{a:03}", f"{b:03}") for a, b in pairs]
    found = connected_components(spark.createDataFrame(pairs, "a string, b string"))
    classes = {row["node"]: row["class"] for row in found.collect()}
    assert {n for n, c in classes.items() if c == "000"} == {f"{i:03}" for i in range(31)}
    assert {n for n, c in classes.items() if c == "100"} == {f"{i:03}" for i in [*range(100, 140), 200]}
