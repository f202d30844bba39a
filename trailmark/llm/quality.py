"""Quality rules with thresholds that follow the data, in DataFrame functions only.

Fixed base rules reject what is broken anywhere. The adaptive rules compare each
document with its own kind: mergeable quantile sketches (KLL) of every metric are
built per language and source over the documents that pass the base rules, merged
into sketches per language and one of all, and read at the quartiles. A document is
rejected if a metric lies beyond the upper fence, third quartile + ``FENCE`` x
interquartile range, or ``word_length`` also below the lower one. The quartiles
of a group are drawn towards those of its language, and those of a language towards the
whole, by a weight that rises smoothly with the group (n^4 against ``EVEN_GROUP``^4): small
groups lean on what they belong to, and no size is a switch. Each metric has a least spread, so that a group of near-equal documents does
not reject slight differences. The thresholds are a small table, written down once and
joined to the documents.

Sketches are exact up to ``SKETCH_K`` values and approximate beyond.

Defined cases: a null text has no words and fails the base rules; null languages and
sources are groups of their own; repeated documents each get their row; other columns
are carried along, unless a result column has the name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.llm.words import without_columns
from trailmark.storage import materialize

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group of so many documents counts as much as what it belongs to, one of twice as many 16 times as much.
EVEN_GROUP = 50.0
SKETCH_K = 2048
FENCE = 3.0
#: Metrics of the adaptive rules and their least interquartile range.
SPREADS = {
    "symbol_ratio": 0.02,
    "dup_line_ratio": 0.15,
    "repeat_ratio": 0.1,
    "shout_ratio": 0.05,
    "word_length": 0.5,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, *SPREADS, "base_failed", "kept"]


def measure(docs: DataFrame) -> DataFrame:
    """The documents with the counts, the metrics and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = without_columns(docs.columns, RESULTS)
    # One projection a step: what a step refers to more than once is computed once.
    split = docs.select(
        F.struct(*kept).alias("row"),
        text.alias("text"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    # 3-word windows by hash, with their positions; equal neighbours are repeats
    ordered = split.withColumn(
        "windows",
        F.when(
            F.size("words") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("words") - 3),
                    lambda i: F.struct(
                        F.xxhash64(
                            F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)
                        ).alias("hash"),
                        i.alias("at"),
                    ),
                )
            ),
        ),
    )

    def is_repeat(window: Column, j: Column) -> Column:
        before, behind = F.get("windows", j - 1)["hash"], F.get("windows", j + 1)["hash"]
        return before.eqNullSafe(window["hash"]) | behind.eqNullSafe(window["hash"])

    repeats = ordered.withColumn(
        "repeats",
        F.sort_array(F.transform(F.filter("windows", is_repeat), lambda window: window["at"])),
    )
    # in order, each repeat covers three words or as many as lie ahead of the next one
    covered = F.aggregate(
        F.transform(
            "repeats", lambda at, j: F.coalesce(F.least(F.get("repeats", j + 1) - at, F.lit(3)), F.lit(3))
        ),
        F.lit(0),
        lambda total, n: total + n,
    )

    def length_of(value: Column) -> Column:
        return F.char_length(value).cast("bigint")

    counted = repeats.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        length_of(F.array_join("words", "")).alias("word_chars"),
        length_of(F.regexp_replace("text", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        length_of(F.regexp_replace("text", r"[^\p{Lu}!]+", "")).alias("n_shouted"),
    )

    def ratio(part: str, whole: str) -> Column:
        return F.col(part).cast("double") / F.greatest(F.col(whole), F.lit(1)).cast("double")

    return counted.select(
        *[F.col("row")[name].alias(name) for name in kept],
        *COUNTS,
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_shouted", "word_chars").alias("shout_ratio"),
        ratio("word_chars", "n_words").alias("word_length"),
        (
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
        ).alias("base_failed"),
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """Fences of each language and source: ``lang, source, <metric>_high, word_length_low``."""
    sketches = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in SPREADS]
    merged = [F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in SPREADS]
    n = F.count(F.lit(1)).alias("n")

    def quartiles(prefix: str) -> list[Column]:
        return [
            F.kll_sketch_get_quantile_double(m, F.lit(q)).alias(f"{prefix}_{m}_{name}")
            for m in SPREADS
            for name, q in (("low", 0.25), ("high", 0.75))
        ]

    passed = measured.where(~F.col("base_failed"))
    groups = materialize(passed.groupBy("lang", "source").agg(n, *sketches), "quality-sketches")
    languages = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    whole = groups.agg(F.sum("n").alias("n"), *merged).where("n > 0").select(*quartiles("all")).first()
    own = groups.select("lang", "source", F.col("n").alias("own_n"), *quartiles("own"))
    wider = languages.select(F.col("lang").alias("of"), F.col("n").alias("lang_n"), *quartiles("lang"))
    both = own.join(wider, F.col("lang").eqNullSafe(F.col("of")))

    def weight(n: str) -> Column:
        square = F.col(n).cast("double") * F.col(n).cast("double")
        return square * square / (square * square + F.lit(EVEN_GROUP**4))

    def quartile(metric: str, name: str) -> Column:
        of_all = F.lit(whole[f"all_{metric}_{name}"] if whole else None).cast("double")
        own, of_lang = F.col(f"own_{metric}_{name}"), F.col(f"lang_{metric}_{name}")
        wider = of_lang * weight("lang_n") + of_all * (1 - weight("lang_n"))
        return own * weight("own_n") + wider * (1 - weight("own_n"))

    def margin(metric: str) -> Column:
        spread = quartile(metric, "high") - quartile(metric, "low")
        return F.lit(FENCE) * F.greatest(spread, F.lit(SPREADS[metric]))

    return both.select(
        F.col("lang").alias("of_lang"),
        F.col("source").alias("of_source"),
        *[(quartile(m, "high") + margin(m)).alias(f"{m}_high") for m in SPREADS],
        (quartile("word_length", "low") - margin("word_length")).alias("word_length_low"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """The documents with counts, metrics, ``base_failed`` and ``kept``."""
    names = without_columns(docs.columns, RESULTS)
    measured = materialize(measure(docs), "quality-measures")
    fences = materialize(thresholds(measured), "quality-thresholds")
    # the columns of a document are in one struct, so that none of them meets the name of a threshold;
    # a small table is broadcast by its size, a large one is shuffled, hot sources split
    joined = measured.select(F.struct(*measured.columns).alias("m")).join(
        fences,
        F.col("m.lang").eqNullSafe(F.col("of_lang")) & F.col("m.source").eqNullSafe(F.col("of_source")),
        "left",
    )
    inside = F.col("m.word_length") >= F.col("word_length_low")
    for metric in SPREADS:
        inside = inside & (F.col("m")[metric] <= F.col(f"{metric}_high"))
    kept = ~F.col("m.base_failed") & F.coalesce(inside, F.lit(True))
    shown = [*names, *COUNTS, *SPREADS, "base_failed"]
    return joined.select(*[F.col("m")[name].alias(name) for name in shown], kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; same columns."""
    row = docs.select(
        F.struct(*docs.columns).alias("row"), "text", "lang", "source"
    )  # whatever the names of further columns
    return judge(row).where("kept").select("row.*")
