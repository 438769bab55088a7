"""Exact deduplication in DataFrame operations: group by a 128-bit content hash, then compare the bytes.

A hash group is only trusted after its smallest and largest text were found to be the same bytes; where they differ
the group holds a collision, and its rows are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.llm.common import fresh, saved, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64     # parts that the copies of one text are dealt to before their bytes are compared
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; NULL becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def collided(df: DataFrame, repeated: DataFrame, text: Column, hash_of: Callable[[Column], Column]) -> DataFrame:
    """Hashes (column ``h``) whose rows do not all hold the same bytes. ``repeated`` has the hashes of two or more rows."""
    members = df.select(hash_of(text).alias("h"), text.alias("t")).join(repeated.select("h"), "h", "left_semi")
    # dealt to many tasks first: each sends on one minimum and one maximum per hash, however many copies there are
    spread = members.repartition(F.col("h"), F.floor(F.rand(7) * SALTS))
    ends = spread.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ends.where(F.col("lo") != F.col("hi")).select("h")


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                normalise: Callable[[Column], Column] = ascii_lower,
                hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when ``normalise`` gives the same bytes. ``keep`` is ``"min"`` or ``"max"``: the id that stays.
    NULL texts count as empty, so they are copies of empty texts. A NULL id never wins over another id; if a group has
    only NULL ids, all its rows are kept. Rows equal in id and text are marked alike (``drop_copies`` leaves one of
    them). Input columns named like an added one are replaced; all others come back unchanged.
    """
    df = without(df, *ADDED)
    text, ident = normalise(F.col(text_col)), F.col(id_col)
    best = {"min": F.min, "max": F.max}[keep]

    digests = saved(df.select(ident.alias("i"), hash_of(text).alias("h"), F.sha2(text, 256).alias("s")), "digests")
    # a written table, so joins with it have plain shuffles on both sides and a hash of very many copies is split
    groups = saved(digests.groupBy("h").agg(best("i").alias("k"), F.count("*").alias("n")), "groups")
    clash = saved(collided(df, groups.where("n > 1"), text, hash_of), "collisions")

    narrow = all(c in (id_col, text_col) for c in df.columns)
    if narrow:        # nothing beside id and text: the digests hold all that is left to know
        rows = digests.select(F.col("i").alias(id_col), "h", F.col("s").alias("text_sha256"))
        hash_name = "h"
    else:
        hash_name = fresh(df, "h")
        rows = df.select("*", hash_of(text).alias(hash_name), F.sha2(text, 256).alias("text_sha256"))
    return _attach(df, rows, groups, clash, narrow, id_col, text, hash_name, best, hash_of)


def _attach(df, rows, groups, clash, narrow, id_col, text, h, best, hash_of) -> DataFrame:
    def out(joined: DataFrame) -> DataFrame:
        return joined.select(*[f"`{c}`" for c in rows.columns if c not in (h, "text_sha256")],
                             F.col("__k").alias("keep_id"), F.col("__n").alias("group_size"),
                             F.col(id_col).eqNullSafe(F.col("__k")).alias("kept"), "text_sha256")

    sound = groups.select(F.col("h").alias(h), F.col("k").alias("__k"), F.col("n").alias("__n"))
    if clash.isEmpty():
        return out(rows.join(sound, h))
    # rows of collided hashes: grouped by hash and whole text
    bad = clash.select(F.col("h").alias(h))
    full = df.select("*", hash_of(text).alias(h), F.sha2(text, 256).alias("text_sha256"), text.alias("__t"))
    exact = full.join(bad, h, "left_semi")
    by_text = exact.groupBy(h, "__t").agg(best(id_col).alias("__k"), F.count("*").alias("__n"))
    return out(rows.join(bad, h, "left_anti").join(sound, h)).unionByName(out(exact.join(by_text, [h, "__t"]).select(
        *[f"`{c}`" for c in rows.columns], "__k", "__n")))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """The rows of ``df`` that stay, one for each distinct text, with the columns of ``df``."""
    marked = mark_copies(df, id_col, text_col, keep, **options)
    kept = marked.where("kept").dropDuplicates([id_col, "text_sha256"])
    return kept.select(*[f"`{c}`" for c in df.columns])
