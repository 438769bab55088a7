"""Line deduplication: drop lines that many documents share, keep the order of the others.

Lines are exploded, normalised and hashed; documents are counted once per hash; the positions of lines over the
threshold go back to their document, which is put together again from the positions that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.llm.common import saved, without
from caremeter.llm.exact_dedup import ascii_lower, content_hash

BLANKS = " \t\n\x0b\f\r"
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Every row of ``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of at least ``min_chars`` code points found in ``min_docs`` documents or more loses all its lines but those
    of the largest id that holds it. NULL and empty texts are one empty line. Rows that share an id are one document
    in the count and keep the same lines; rows with a NULL id count as one document below all others. Input columns
    named like an added one are replaced.
    """
    df = without(df, *ADDED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is known by its id and a hash of its text: equal rows have equal positions to drop
    row = [F.col(id_col).alias("i"), F.xxhash64(text).alias("x")]

    lines = df.select(*row, F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    keyed = lines.select("i", "x", "p", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = saved(keyed.select("i", "x", "p", content_hash(F.col("key")).alias("h")), "line-hashes")

    per_doc = hashed.select("h", "i").distinct()     # a document counts once, and a shared line is spread over its documents
    # a written table, so the join below has plain shuffles on both sides and a line of very many documents is split
    shared = saved(per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("i").alias("last"))
                   .where(F.col("docs") >= min_docs).select("h", "last"), "shared-lines")
    drops = (hashed.join(shared, "h").where(F.col("i").isNull() | (F.col("i") < F.col("last")))
             .groupBy("i", "x").agg(F.collect_set("p").alias("drop")))

    found = df.alias("d").join(drops, F.col(f"d.{id_col}").eqNullSafe(drops["i"])
                               & (F.xxhash64(F.coalesce(F.col(f"d.{text_col}"), F.lit(""))) == drops["x"]), "left")
    split = F.split(F.coalesce(F.col(f"d.{text_col}"), F.lit("")), "\n", -1)
    none = F.array().cast("array<int>")
    return (
        found.select("d.*", split.alias("__lines"), F.coalesce(drops["drop"], none).alias("__drop"))
        .select(*[f"`{c}`" for c in df.columns], F.size("__lines").cast("long").alias("n_lines"),
                F.size("__drop").cast("long").alias("n_dropped"),
                F.array_join(F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop"),
                    lambda p: F.element_at("__lines", p + 1)), "\n").alias("kept_text")))
