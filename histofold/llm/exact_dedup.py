"""Exact deduplication: 128-bit content hash, smallest stable id, byte comparison.

Two texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``.
Rows are grouped by (128-bit hash, normalised text): the hash decides the group,
and as the text itself is part of the key, the aggregate compares the bytes inside
a hash group, so texts that only collide stay apart.  Copies are merged map-side:
a group holding a third of all rows sends one row per map task.

Defined cases: null text counts as empty, empty texts are equal to each other; a
null ``doc_id`` loses against any id and is kept only where the group has no other;
of rows that repeat both id and text exactly one is kept; an empty table gives an
empty result; other columns are ignored by ``verdicts`` and carried by ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histofold.llm.common import OWN, SPACES, Scratch, plain


def normalised(text: Column) -> Column:
    return F.regexp_replace(plain(text), f"[{SPACES}]+", "")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Smaller is better: most code points, then smallest id, null ids last."""
    return F.struct((-n_chars).alias("neg"), doc_id.isNull().alias("none"), doc_id.alias("id"))


def groups(rows: DataFrame) -> DataFrame:
    """(hash, sha, size, best) per distinct normalised text of rows(id, n_chars, norm)."""
    return (rows.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm")
            .agg(F.count(F.lit(1)).alias("size"), F.min(_rank(F.col("n_chars"), F.col("id"))).alias("best"))
            .select("hash", F.sha2("norm", 256).alias("sha"), "size", "best"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = plain(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"),
                       normalised(F.col(text_col)).alias("norm"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = _rows(docs, id_col, text_col)
    members = (rows.select("id", "n_chars", F.unhex(F.md5("norm")).alias("hash"), F.sha2("norm", 256).alias("sha"))
               .groupBy("hash", "sha", "id", "n_chars").agg(F.count(F.lit(1)).alias("times")))
    # hot groups: the right side has one row a key, so skewed partitions of members split freely
    joined = members.join(groups(rows), ["hash", "sha"])
    best = _rank(F.col("n_chars"), F.col("id")).eqNullSafe(F.col("best"))
    return (joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
            .select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
                    (best & (F.col("nth") == 1)).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Only groups of two or more are joined back: texts that occur once never meet
    a join partner.  The group table is written first, so the join is one of plain
    exchanges, which Spark splits where a group is hot.
    """
    store = Scratch(docs.sparkSession, "exact-dedup")
    rows = _rows(docs, id_col, text_col)
    sized = rows.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm").agg(
        F.count(F.lit(1)).alias("size"), F.min(_rank(F.col("n_chars"), F.col("id"))).alias("best"))
    copies = sized.where("size > 1").select(F.col("hash").alias(f"{OWN}hash"), F.sha2("norm", 256).alias(f"{OWN}sha"),
                                            F.col("best").alias(f"{OWN}best"))
    copies = store.save(copies, "copies")
    norm = normalised(F.col(text_col))
    rank = _rank(F.length(plain(F.col(text_col))).cast("long"), F.col(id_col))
    keyed = docs.withColumns({f"{OWN}hash": F.unhex(F.md5(norm)), f"{OWN}sha": F.sha2(norm, 256), f"{OWN}rank": rank})
    best = F.col(f"{OWN}best")
    # a shuffle join at every size: the table of copies grows with the documents
    seen = keyed.join(copies.hint("shuffle_merge"), [f"{OWN}hash", f"{OWN}sha"], "left").where(
        best.isNull() | F.col(f"{OWN}rank").eqNullSafe(best))
    # rows repeating id and text are all best of their group: one of them stays
    ties = store.save(
        seen.where(best.isNotNull()).groupBy(f"{OWN}hash", f"{OWN}sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "ties").select(f"{OWN}hash", f"{OWN}sha")
    if ties.isEmpty():
        return seen.select(*[F.col(c) for c in docs.columns])
    one = seen.join(ties, [f"{OWN}hash", f"{OWN}sha"]).dropDuplicates([f"{OWN}hash", f"{OWN}sha"])
    rest = seen.join(ties, [f"{OWN}hash", f"{OWN}sha"], "left_anti")
    return rest.select(*docs.columns).unionByName(one.select(*docs.columns))
