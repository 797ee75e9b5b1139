"""Line dedup: lines that many documents share are dropped from all of them.

Plan: split each text, hash its normalised lines, count the distinct documents of each hash (aggregated
before each shuffle, so a line that every document has costs a row for each map task), keep the hashes over the
threshold, find each document's own such hashes with a sort-merge semi join that AQE can split, and filter the
array of lines in place. Texts move once, to meet their list of hashes; lines never leave their row, so
position needs no sort. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, free_names, lower_ascii, stored, whole


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits as two longs: at 10^13 lines a shared 64-bit hash would be expected, a shared 128-bit one not."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def line_hashes(docs: DataFrame, text: str, doc: str, min_chars: int) -> DataFrame:
    """One row (doc, h) for each different key of min_chars or more in a row of docs."""
    lines = F.split(whole(F.col(text)), "\n", -1)
    keys = F.filter(F.array_distinct(F.transform(lines, line_key)), lambda k: F.length(k) >= min_chars)
    return docs.select(F.col(doc).alias("doc"), F.explode(F.transform(keys, key_hash)).alias("h"))


def frequent_keys(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h, n_docs): hashes of the keys found in min_docs different documents or more."""
    pairs = line_hashes(docs, text, doc, min_chars)
    counted = pairs.groupBy("h").agg(F.count_distinct(F.struct("doc")).alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def drop_frequent_lines(docs: DataFrame, *, text: str = "text", doc: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows and columns of docs, the text without its frequent lines, with n_lines (before) and n_dropped.

    A null or empty text is one empty line, and comes back empty. Blank lines have an empty key, which is shorter than
    min_chars=1, and stay. A document is a doc_id: rows that repeat an id count once toward min_docs, and each row is
    cleaned; null ids are one id. An empty table gives an empty one. Input columns named n_lines or n_dropped are
    replaced; every other extra column is carried.
    """
    # as a table of its own it gets its own exchange below the join, so that AQE can split the rows of a hot line
    hot = stored(frequent_keys(docs, text=text, doc=doc, min_docs=min_docs, min_chars=min_chars).select("h"), "lines")
    owned = line_hashes(docs, text, doc, min_chars).join(hot.hint("merge"), "h", "left_semi")
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    key, found, parts, stay = free_names(kept_columns, "__doc", "__hot", "__lines", "__kept")
    lists = owned.groupBy(F.col("doc").alias(key)).agg(F.collect_set("h").alias(found))
    joined = docs.select(*kept_columns).join(lists.hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col(key)), "left").drop(key)
    split = joined.withColumn(parts, F.split(whole(F.col(text)), "\n", -1))
    staying = F.filter(parts, lambda x: ~F.array_contains(F.col(found), key_hash(line_key(x))))
    split = split.withColumn(stay, F.when(F.col(found).isNull(), F.col(parts)).otherwise(staying))
    out = split.withColumn(text, F.array_join(stay, "\n"))
    return out.select(*kept_columns, F.size(parts).cast("long").alias("n_lines"), (F.size(parts) - F.size(stay)).cast("long").alias("n_dropped"))
