"""Small tables of documents with everything that can go wrong, and plain counterparts of the rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Names that operators use inside must not get in the way of columns of the same name.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "row string, `class` string, bucket bigint, node int, n string, hash int, number int, sent int, "
    "drawn int, steps int, of_source int, toxic int, of_lang int, word_length_low int, shout_ratio_high int, m int"
)


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return LOW_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(spark, texts, schema=SCHEMA):
    """One document per text, or per (id, text)."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    extra = ("r", None, 5, 6, "n", None, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
    rows = [
        (i, t, ["en", None, "de"][k % 3], ["web", "web", None][k % 3], None if t is None else len(t), *extra)
        for k, (i, t) in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, schema)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(rng):
    """Null, empty, blank, one word, odd characters, repeated and very long texts."""
    same = prose(rng, 80)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "Àé ß x\x1fy \x0b z",
        "a " * 3000,
        same,
        (50, same),
        (50, same),
        (None, same),
        (None, None),
        prose(rng, 30_000),
        "\n".join([prose(rng, 8)] * 5),
    ]


def fresh(seed=1):
    return random.Random(seed)
