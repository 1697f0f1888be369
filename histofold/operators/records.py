"""History records before they are classified: one per commit, with a walk position, back from one revision.

* **One record per commit.**  The analysed tool keys a history by commit id, so a commit that stands in two export
  files counts once.  Whole records are resolved by ``(repo_id, commit_id)`` before their lists are exploded; the
  last one in the order of origin (file path, place in the file) stays, as in a table that is written twice.  Copies
  with the same content vanish, those that say something else are handed out to be quarantined.
* **Walk position.**  Records without ``pos`` are numbered by their place: an export lists a history in walk order.
* **Revision.**  Only commits that the chosen revision reaches over ``parents`` belong to a history.

The reachability walk runs over blocks of ``BLOCK`` walk positions.  A round hands each block the commits that
were newly reached in it; the block's task walks inside the block and hands on the parents that lie in others.  A
history in walk order (children first) is done in about as many rounds as its longest repository has blocks,
whatever its depth, and no task holds more than a block.  Every round is written, so neither lineage nor lost
executors matter.  Any order of positions gives the same result, only in more rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histofold.functions.ordinal import ordinal

#: Writes a table under a name and returns it as read back.
Keep = Callable[[str, DataFrame], DataFrame]

KEY = ["repo_id", "commit_id"]
# What a record says; its position is its place in one export.
CONTENT = ("author", "author_email", "message", "date", "parent_count", "parents", "files", "changes")
# Fixed value: reason recorded for a copy that says something else than the record that stays.
DIFFERS = "differs from the last record of its commit"

#: Walk positions that one task walks together.
BLOCK = 65_536


def repeated_commits(records: DataFrame) -> DataFrame:
    """Keys that more than one record has."""
    return records.groupBy(*KEY).agg(F.count(F.lit(1)).alias("records")).filter("records > 1").select(*KEY)


def resolve_records(records: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(history, differing)``: the last record of every commit, and the records that differ from it.

    ``records`` carry their origin (``file_path``, ``block``, ``line_id``); only those of the ``repeated`` keys
    are compared.  What a record says is digested before anything moves, so that the comparison moves keys, origins
    and digests; whole records move once, to meet the place of their commit's last one.
    """
    says = records.withColumn("__says", F.md5(F.to_json(F.struct(*CONTENT))))
    origin = says.select(*KEY, F.struct("file_path", "block", "line_id", "__says").alias("__at"))
    last = origin.join(repeated, KEY, "left_semi").groupBy(*KEY).agg(F.max("__at").alias("__last")).select(
        *KEY, F.col("__last.line_id").alias("__line"), F.col("__last.__says").alias("__said"))
    history = (records.join(last.drop("__said"), KEY, "left")
               .filter(F.col("__line").isNull() | (F.col("line_id") == F.col("__line"))).drop("__line"))
    differing = (says.join(last.drop("__line"), KEY).filter(F.col("__says") != F.col("__said")).drop("__says", "__said"))
    return history, differing


def walk_positions(history: DataFrame, lacking: DataFrame) -> DataFrame:
    """``pos`` of the repositories in ``lacking`` (some record without one): the place among their records.

    Records are numbered where they lie: none is joined back to its place, so no side of a join grows with them.
    """
    repos = lacking.select("repo_id")
    # a scan split is a bucket, so no repository is numbered in one task
    placed = ordinal(history.join(repos, "repo_id", "left_semi").drop("pos"), ["repo_id"],
                     [F.col("file_path"), F.col("block"), F.col("line_id")], bucket=F.struct("file_path", "block"))
    return history.join(repos, "repo_id", "left_anti").unionByName(placed.select(*history.columns))


def walks(history: DataFrame) -> DataFrame:
    """One row per repository: HEAD (the first commit of the walk), whether a position is missing, whether every
    commit names its parents (a commit of no parents need not)."""
    named = F.col("parents").isNotNull() | F.coalesce(F.col("parent_count") == 0, F.lit(False))
    return history.groupBy("repo_id").agg(
        F.min_by("commit_id", "pos").alias("head_sha"), F.max(F.col("pos").isNull()).alias("lacks_pos"),
        F.min(named).alias("names_parents"))


def reachable(history: DataFrame, revisions: DataFrame, keep: Keep, block: int | None = None) -> DataFrame:
    """``(repo_id, commit_id)`` of the commits that a repository's ``revision`` reaches, itself included.

    ``history(repo_id, commit_id, pos, parents)`` with one row per commit, ``revisions(repo_id, revision)``;
    parents outside the history are left out.
    """
    size = BLOCK if block is None else block
    places = keep("places", history.select(*KEY, F.floor(F.col("pos") / size).cast("long").alias("block"),
                                           F.coalesce("parents", F.array().cast("array<string>")).alias("parents")))
    at = places.select(*KEY, "block")
    fresh = keep("reached-0", revisions.select("repo_id", F.col("revision").alias("commit_id")).distinct().join(at, KEY))
    rounds, n = [fresh.select(*KEY)], 0
    while not fresh.isEmpty():
        n += 1
        live = places.join(fresh.select("repo_id", "block").distinct(), ["repo_id", "block"], "left_semi")
        seen = reduce(DataFrame.unionByName, rounds)
        if len(rounds) > 32:  # the plan of a round stays small
            seen = keep(f"seen-{n}", seen)
            rounds = [seen]
        # what a block reaches: commits of its own (inside) and parents that lie elsewhere
        found = (live.groupBy("repo_id", "block").cogroup(fresh.groupBy("repo_id", "block"))
                 .applyInPandas(_walk, "repo_id long, commit_id string, inside boolean"))
        found = keep(f"found-{n}", found.groupBy(*KEY).agg(F.max("inside").alias("inside")).join(seen, KEY, "left_anti"))
        rounds.append(found.filter("inside").select(*KEY))
        fresh = keep(f"reached-{n}", found.filter(~F.col("inside")).select(*KEY).join(at, KEY))
        rounds.append(fresh.select(*KEY))
    return reduce(DataFrame.unionByName, rounds).distinct()


def _walk(places, fresh):
    """Commits of one block that its new ones reach, and their parents in other blocks."""
    import pandas as pd

    parents = dict(zip(places["commit_id"], places["parents"]))
    todo = [c for c in fresh["commit_id"] if c in parents]
    inside, outside = set(todo), set()
    while todo:
        for p in parents[todo.pop()]:
            if p in parents:
                if p not in inside:
                    inside.add(p)
                    todo.append(p)
            elif p is not None:
                outside.add(p)
    rows = [(c, True) for c in inside] + [(c, False) for c in outside]
    out = pd.DataFrame(rows, columns=["commit_id", "inside"])
    out.insert(0, "repo_id", places["repo_id"].iloc[0] if len(places) else None)
    return out


def cut_at_revision(history: DataFrame, revisions: DataFrame, keep: Keep) -> DataFrame:
    """The history without the commits that the chosen revision does not reach.

    ``revisions``: the repositories to cut; the others are kept whole.
    """
    own = history.join(revisions.select("repo_id"), "repo_id", "left_semi")
    kept = own.join(reachable(own, revisions, keep), KEY, "left_semi")
    return history.join(revisions.select("repo_id"), "repo_id", "left_anti").unionByName(kept)
