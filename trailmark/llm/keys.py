"""Names for rows of a table of documents, and decisions brought back to them.

Rows with the same id and the same text are one document to every operator: they get the
same decisions. A null id differs from every number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["key_id", "key_text"]
#: Keys are broadcast up to this many rows (two numbers each), and shuffled beyond.
MAX_BROADCAST_KEYS = 400_000


def key_columns(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two numbers, never null, that name a document."""
    number = F.col(doc_id).cast("bigint")
    return [
        F.coalesce(number, F.lit(0)).cast("bigint").alias("key_id"),
        F.xxhash64(number.isNull(), F.coalesce(F.col(text), F.lit(""))).alias("key_text"),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    """``key_id, key_text, row, text``; the struct ``row`` holds all columns, whatever their names."""
    return docs.select(*key_columns(), F.struct(*docs.columns).alias("row"), "text")


def same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left.key_id == right.key_id) & (left.key_text == right.key_text)


def bring_back(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Keyed rows with their decisions (one a key), and the rows that have none.

    If there are few keys, rows without a decision are told apart by a broadcast of the keys,
    and only the others are shuffled. Else all rows are shuffled, and the second part is None:
    the first one then holds rows with null decisions too.
    """
    columns = [c for c in decisions.columns if c not in KEY]
    renamed = decisions.withColumnsRenamed({"key_id": "of_id", "key_text": "of_text"})
    match = (F.col("key_id") == F.col("of_id")) & (F.col("key_text") == F.col("of_text"))
    picked = [*rows.columns, *columns]
    if decisions.count() > MAX_BROADCAST_KEYS:
        return rows.join(renamed, match, "left").select(*picked), None
    keys = F.broadcast(renamed.select("of_id", "of_text"))
    decided = rows.join(keys, match, "left_semi")
    return (
        decided.join(renamed.hint("merge"), match).select(*picked),
        rows.join(keys, match, "left_anti"),
    )
