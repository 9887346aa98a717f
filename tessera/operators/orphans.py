"""Problem 3: references to records that don't exist, by distributed anti-joins.

The distinct non-null references are made first, with partial aggregation, so repeated rows
never reach a join. The keys referred to are made distinct once more before they meet the
parent keys: a parent that a third of all rows refer to is one row in the anti-join. Only the
keys found wanting are joined back to their references. No side is broadcast by hint; Spark
broadcasts one only if its measured size is under the session's threshold.

Defined results: NULL, zero and negative values are no references; repeated references are one;
a NULL file or arrival counts as absent among the others of the same reference (a reference
without any file is never late, one without arrival has a NULL period); duplicates, NULL keys
and further columns in the parent tables don't matter; an empty parent table makes every
reference missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def references(diffs: DataFrame) -> DataFrame:
    """Distinct references (ref_field, revision_id, ref_id) with first file and first arrival."""
    both = F.array(
        F.struct(F.lit("parent_id").alias("ref_field"), F.col("parent_id").alias("ref_id")),
        F.struct(F.lit("revision_id").alias("ref_field"), F.col("revision_id").alias("ref_id")),
    )
    links = diffs.groupBy("revision_id", "parent_id").agg(F.min("file_no").alias("first_file"), F.min("arrived_at").alias("first_at"))
    return (
        links.select("revision_id", "first_file", "first_at", F.inline(both))
        .where("ref_id > 0")
        .groupBy("ref_field", "revision_id", "ref_id")
        .agg(F.min("first_file").alias("first_file"), F.min("first_at").alias("first_at"))
    )


def orphan_references(diffs: DataFrame, revisions: DataFrame, backup: DataFrame) -> DataFrame:
    """Each reference to a revision that is 'missing', 'deleted' (only in the backup) or 'late', with its month."""
    return _orphans(references(diffs), revisions, backup)


def _orphans(refs: DataFrame, revisions: DataFrame, backup: DataFrame) -> DataFrame:
    keys = refs.groupBy("ref_id").agg(F.min("first_file").alias("earliest"))
    parents = revisions.where("id IS NOT NULL").groupBy(F.col("id").alias("ref_id")).agg(F.min("file_no").alias("parent_file"))
    saved = backup.where("id IS NOT NULL").select(F.col("id").alias("ref_id")).distinct()

    absent = keys.select("ref_id").join(parents, "ref_id", "left_anti")
    none = F.lit(None).cast("int")
    wanting = (
        absent.join(saved, "ref_id", "left_anti").select("ref_id", F.lit("missing").alias("kind"), none.alias("parent_file"))
        .unionByName(absent.join(saved, "ref_id", "left_semi").select("ref_id", F.lit("deleted").alias("kind"), none.alias("parent_file")))
        .unionByName(keys.join(parents, "ref_id").where("parent_file > earliest").select("ref_id", F.lit("late").alias("kind"), "parent_file"))
    )
    return (
        refs.join(wanting, "ref_id")
        .where("kind <> 'late' OR parent_file > first_file")
        .select("ref_field", "revision_id", "ref_id", "kind", F.date_format("first_at", "yyyy-MM").alias("period"))
    )


def orphan_counts(diffs: DataFrame, revisions: DataFrame, backup: DataFrame) -> DataFrame:
    """Per field and month: references, and how many of them are missing, deleted and late."""
    refs = cut(references(diffs), "references")
    found = _orphans(refs, revisions, backup)
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    bad = found.groupBy("ref_field", "period").agg(n("missing"), n("deleted"), n("late"))
    total = refs.groupBy("ref_field", F.date_format("first_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_refs"))
    same = total["ref_field"].eqNullSafe(bad["ref_field"]) & total["period"].eqNullSafe(bad["period"])
    zero = lambda c: F.coalesce(bad[c], F.lit(0)).cast("long").alias(c)
    return total.join(bad, same, "left").select(total["ref_field"], total["period"], "n_refs", zero("n_missing"), zero("n_deleted"), zero("n_late"))
