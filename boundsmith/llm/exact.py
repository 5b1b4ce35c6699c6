"""Exact deduplication by 128-bit content hash, in DataFrame functions only.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]``
is deleted.  Rows are grouped by the MD5 of that normalised text *and* its
bytes, so the aggregate itself compares bytes inside a hash group and a
collision can't merge two texts.  Rows find their group again by MD5 and
SHA-256; should two byte groups ever share both, the job fails loudly.

Defined cases: a null text is an empty text, and all empty texts are equal.  A
null id ranks after every other id.  Rows that share both id and text are one
document: :func:`exact_groups` answers each alike, :func:`drop_exact_copies`
keeps one.  Columns of other names are passed through or ignored, whatever they
are called.  An empty table gives an empty result.

Scale: the text is shuffled once, after partial aggregation, so a group of copies
sends a row for each task; rows meet their group by two hashes, hot groups by a
broadcast of proven size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundsmith.llm.common import written

#: Groups that hold more than one in so many of all rows are met by broadcast.
HOT_GROUPS = 1000

#: The characters that normalisation deletes.
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("row_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("len"),
        normalised(F.col(text_col)).alias("norm"),
    ).withColumn("hash", hash_of(F.col("norm")))


def _groups(keyed: DataFrame) -> DataFrame:
    """``hash, sha, rows, id`` for each distinct normalised text; ``id`` is that of the row that stays.

    The partial aggregate runs before the shuffle, so a group of copies sends a
    row for each task however large it is.
    """
    best = F.min(F.struct((-F.col("len")).alias("neg"), F.col("row_id").isNull().alias("no_id"), F.col("row_id").alias("id")))
    by_bytes = keyed.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("rows"), best.alias("best"))
    named = by_bytes.select("hash", F.sha2("norm", 256).alias("sha"), "rows", "best.id")
    once = named.groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("texts"), F.first("rows").alias("rows"), F.first("id").alias("id"))
    both = F.lit("two texts share MD5 and SHA-256")
    return once.select("hash", "sha", F.when(F.col("texts") > 1, F.raise_error(both).cast("long")).otherwise(F.col("rows")).alias("rows"), "id")


def _met(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``rows`` and ``keep`` of their group, null for a text of its own, by ``hash`` and ``text_sha256``.

    Groups with at least a ``1 / HOT_GROUPS`` share of the rows, so ``HOT_GROUPS`` of
    them at most, are broadcast.  Their rows then take part in the shuffled join under
    the number of their partition, which meets nothing, so that no key is hot.
    """
    hot = repeated.where(F.col("rows") * HOT_GROUPS >= total).select(F.col("hash").alias("h_hash"), F.col("sha").alias("h_sha"), F.struct("rows", "id").alias("h"))
    cold = repeated.where(F.col("rows") * HOT_GROUPS < total).select(F.col("hash").alias("c_hash"), F.col("sha").alias("c_sha"), F.struct("rows", "id").alias("c"))
    dealt = rows.join(F.broadcast(hot), (F.col("hash") == F.col("h_hash")) & (F.col("text_sha256") == F.col("h_sha")), "left").withColumn(
        "key", F.when(F.col("h").isNull(), F.col("hash")).otherwise(F.concat(F.lit("hot "), F.spark_partition_id().cast("string")))
    )
    met = dealt.join(cold, (F.col("key") == F.col("c_hash")) & (F.col("text_sha256") == F.col("c_sha")), "left")
    return met.select("row_id", "text_sha256", F.coalesce("h", "c").alias("group"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its own text stays, then
    the smallest id.  ``hash_of`` gives the grouping hash.
    """
    keyed = _keyed(docs, id_col, text_col, hash_of)
    repeated, _ = written(_groups(keyed).where("rows > 1"), "exact-groups")
    rows = keyed.select("row_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    found = _met(rows, repeated, docs.count())
    keep_id = F.when(F.col("group").isNull(), F.col("row_id")).otherwise(F.col("group.id"))
    return found.select(
        F.col("row_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group.rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("row_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    One aggregate by hash and bytes, so a group of copies sends a row for each task.
    Of rows with the same id and length the one with the smallest hash of its text stays.
    """
    # The row travels as one struct, so its columns may have any names.
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text)
    order = F.struct(-F.length(text), F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), order.alias("rank"), hash_of(norm).alias("hash"), norm.alias("norm"))
    return rows.groupBy("hash", "norm").agg(F.min_by("row", "rank").alias("row")).select("row.*")
