"""Jobs over real input files (not the driver-table adapter).

* ``collect``: catalog CSV (S1/S2) + PaC list CSV (S5) + exported histories
  (S6) -> one record per commit, back from the chosen revision (S15) -> classified
  changes and commit facts -> result folder (S10), leaving out repositories that
  already have a result (S13) and reporting repositories without commits or
  without a pin (strict mode raises, as the analysed tool does) and pins that are
  not in the history (HEAD instead, as there).
* ``load_results`` / ``load_documents``: a result folder written by
  ``collect``, or the analysed tool's own one-document-per-repository files,
  back to ``(commit_facts, classified)`` -- the inputs of every analysis in
  ``operators``.
* ``analyses``: the analysis tables of one corpus, as lazy DataFrames.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histofold.operators import classify as cl
from histofold.operators import cochange as co
from histofold.operators import coverage as cov
from histofold.operators import inspection as ins
from histofold.operators import records as rec
from histofold.operators import repo_metrics as rm
from histofold.schemas import RESULT_DOCUMENT
from histofold.sources import catalog as cat
from histofold.sources import documents as docs
from histofold.sources import history as hist
from histofold.session import scratch_dir
from histofold.sources import results as res


def collect(spark: SparkSession, catalog_path: str, pac_path: str, history_path: str, out_root: str,
            strict: bool = False, skip_existing: bool = True, repository_no: int | None = None,
            use_test_mode: bool = False, layout: str = "partitioned",
            use_head: Iterable[str] = cov.REPOSITORIES_THAT_SHOULD_USE_HEAD) -> DataFrame:
    """The collection step over files; returns the diagnostics.

    ``repository_no`` restricts the run to one 1-based catalog row (S3); ``layout`` is that of
    ``results.write_results`` (``"sorted"`` for many repositories: no folder for each); repositories of
    ``use_head`` are taken at HEAD whatever their pin.

    A commit that several lines record counts once (the last file and line), copies that say something else are
    quarantined; without ``pos`` a record's place is its walk position; a history whose commits name their
    ``parents`` is cut at the chosen revision, any other goes on whole with a note.
    Commit ids are strings here; a history may hold many repositories, and
    two repositories may share a commit id (forks): every commit key is
    ``(repo_id, commit_id)``.

    Nothing is lost or half-published: history lines are parsed once into the
    shared scratch folder, classified and folded once from there, and every
    dataset is written below its own ``run=<id>`` folder.  The run counts only
    from its row in ``published`` on, which is written last; readers and the
    skip of finished repositories look at published runs alone.  Lines that
    cannot be read go to ``quarantine/run=<id>`` and fail a ``strict`` run, as
    do a repository without commits and a catalog row without a pin.
    """
    start, run = time.time(), uuid.uuid4().hex
    stage = f"{scratch_dir(spark)}/histofold/collect-{run}"

    def staged(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{stage}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    repos = cat.scan_repo_catalog(spark, catalog_path)
    if repository_no is not None:
        repos = cat.select_repo_by_number(repos, repository_no)
    todo = cov.incremental_todo(repos, published_repositories(spark, out_root)) if skip_existing else repos
    todo = staged("todo", todo)
    pac = cat.scan_pac_files(spark, pac_path)
    lines = staged("lines", hist.read_history_lines(spark, history_path))
    records, bad = hist.split_history(lines)
    # Only histories of catalog repositories still to collect are read on.
    records = records.join(todo.select("repo_id"), "repo_id", "left_semi")
    history, differing = rec.resolve_records(records, staged("repeated", rec.repeated_commits(records)))
    if spark.read.parquet(f"{stage}/repeated").isEmpty():
        history = records
    else:
        history = staged("resolved", history)
        bad = bad.unionByName(hist.quarantined(differing, rec.DIFFERS))
    walks = staged("walks", rec.walks(history))
    if not walks.filter("lacks_pos").isEmpty():
        history = staged("walked", rec.walk_positions(history, walks.filter("lacks_pos")))
        walks = staged("walks-placed", rec.walks(history))
    use_head = list(use_head)
    revisions = staged("revisions", cov.resolve_revision(todo.join(walks, "repo_id"), history, use_head, need_pin=False))
    cut = revisions.join(walks.filter("names_parents"), "repo_id").filter("revision != head_sha").select("repo_id", "revision")
    if not cut.isEmpty():
        history = staged("cut", rec.cut_at_revision(history, cut, staged))
    history = hist.qualify_commit_ids(history)
    commits, files, changes = hist.history_tables(history)
    diagnostics = staged("diagnostics", cl.collection_diagnostics(todo, commits).unionByName(
        cl.revision_diagnostics(revisions, walks, use_head)))
    if strict:
        first = diagnostics.filter(F.col("reason").isin(*cl.FAILURES)).orderBy("repo_id").limit(1).collect()
        if first:
            raise RuntimeError(f"{first[0].reason} for {first[0].full_name}")
        lost = bad.limit(1).collect()
        if lost:
            raise RuntimeError(f"{lost[0].reason} in {lost[0].file_path}")
    classified = staged("classified", cl.classify_changes(
        commits, files, changes, pac, touched=cl.touched_files(hist.history_entries(cl.drop_merges(history)))))
    facts = staged("facts", cl.commit_fold(commits, classified, changes, todo))
    facts = facts.withColumn("commit_id", hist.unqualified_commit_id())
    live = cl.drop_merges(commits)
    res.write_results(
        res.result_commits(facts), res.result_repositories(facts), out_root, run=run,
        changes=res.result_changes(classified.withColumn("commit_id", hist.unqualified_commit_id()), todo),
        files=res.result_files(files, live, todo).withColumn("commit_id", hist.unqualified_commit_id()), layout=layout)
    bad.write.json(f"{out_root}/quarantine/run={run}")
    (res.run_metadata(spark, start, repository_no=repository_no, use_test_mode=use_test_mode,
                      csv_path=catalog_path, pac_file_names_csv=pac_path)
     .write.mode("append").json(f"{out_root}/runs"))
    publish(spark, out_root, run, todo.join(live.select("repo_id").distinct(), "repo_id", "left_semi"))
    return diagnostics


def publish(spark: SparkSession, out_root: str, run: str, collected: DataFrame) -> None:
    """Publish a written run: its manifest, the catalog names (``full_name``) it has collected, and last the one-row
    marker from which on it counts."""
    res.write_manifest(spark, out_root, run)
    collected.select("full_name").write.parquet(f"{out_root}/done_keys/run={run}")
    (spark.createDataFrame([(time.time(),)], "finished double").coalesce(1)
     .write.parquet(f"{out_root}/published/run={run}"))


def discover(spark: SparkSession, out_root: str) -> DataFrame:
    """S7 over published results: (owner_name, repository_name, file_path, run), the last published run of each
    repository, from the manifest -- one small table a run, however many result folders there are.

    Published runs that no manifest lists (written before there were any) are listed first, each once.  A folder
    without published runs, such as the analysed tool's own documents, is searched (``results.discover_results``; ``run`` null).
    """
    runs = _runs(spark, out_root)
    if runs is None:
        return res.discover_results(spark, out_root).select(
            "owner_name", "repository_name", "file_path", F.lit(None).cast("string").alias("run"))
    listed = _if_there(lambda: res.read_manifest(spark, out_root).select("run").distinct())
    for row in (runs if listed is None else runs.join(listed, "run", "left_anti")).select("run").collect():  # runs, not results
        res.write_manifest(spark, out_root, row.run)
    return (res.read_manifest(spark, out_root).join(runs, "run").groupBy("owner_name", "repository_name")
            .agg(F.max_by(F.struct("file_path", "run"), F.struct("finished", "run")).alias("last"))
            .select("owner_name", "repository_name", "last.file_path", "last.run"))


def _if_there(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _runs(spark: SparkSession, out_root: str) -> DataFrame | None:
    """(finished, run) of the published runs; None before the first one."""
    return _if_there(lambda: spark.read.schema("finished double, run string").parquet(f"{out_root}/published"))


def _published(spark: SparkSession, out_root: str) -> DataFrame | None:
    """(full_name, run) of the last published run of every repository; None before the first one."""
    runs = _runs(spark, out_root)
    if runs is None:
        return None
    keys = spark.read.schema("full_name string, run string").parquet(f"{out_root}/done_keys")
    return (keys.join(runs, "run").groupBy("full_name")
            .agg(F.max_by("run", F.struct("finished", "run")).alias("run")))


def published_repositories(spark: SparkSession, out_root: str) -> DataFrame:
    """Names of the repositories that a published run has collected."""
    done = _published(spark, out_root)
    return spark.createDataFrame([], "full_name string") if done is None else done.select("full_name")


def load_results(spark: SparkSession, out_root: str) -> tuple[DataFrame, DataFrame]:
    """``(commit_facts, classified)`` of a result folder written by ``collect``."""
    good, _ = res.read_results(spark, out_root, runs=True)
    facts = res.fold_result_commits(_of_published(spark, out_root, good))
    changes = _of_published(spark, out_root, res.read_result_changes(spark, out_root, runs=True))
    classified = changes.select(F.col("repository_id").alias("repo_id"), "commit_id", "pos", "file", "is_pac",
                                "additions", "deletions", "total_changes", "status")
    return facts, classified


def load_files(spark: SparkSession, out_root: str) -> DataFrame:
    """The touched files of every collected commit."""
    return _of_published(spark, out_root, res.read_result_files(spark, out_root, runs=True)).drop("run")


def load_quarantine(spark: SparkSession, out_root: str) -> DataFrame:
    """(file_path, reason, record, run): input lines that published runs could not read, and
    result lines that cannot be read back."""
    _, bad = res.read_results(spark, out_root, runs=True)
    lines = (spark.read.schema("file_path string, reason string, record string, run string")
             .json(f"{out_root}/quarantine"))
    published = spark.read.schema("finished double, run string").parquet(f"{out_root}/published").select("run")
    return lines.join(published, "run", "left_semi").select("file_path", "reason", "record", "run").unionByName(
        bad.select("file_path", F.lit("unreadable result").alias("reason"), F.coalesce("_corrupt_record", "commit_id").alias("record"), "run"))


def _of_published(spark: SparkSession, out_root: str, rows: DataFrame) -> DataFrame:
    """Rows of the last published run of their repository."""
    last = _published(spark, out_root)
    if last is None:
        raise ValueError(f"no published run below {out_root}")
    return rows.join(last.withColumnRenamed("full_name", "project_name"), ["project_name", "run"], "left_semi")


def load_discovered(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``load_documents`` behind discovery (S7): every result file below ``root`` but the
    aggregated one, the last path where a repository has several."""
    found = res.discover_results(spark, root).select("file_path")
    read = res.read_result_documents(spark, root, recursive=True)
    return _of_documents(read.join(found, "file_path", "left_semi"))


def load_documents(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """``(commit_facts, classified)`` of the analysed tool's own result files
    (``sources.results.unreadable_documents`` lists those that cannot be read).

    Inside a document the commit list order is the walk order (``pos``) and
    the PaC / other lists keep file order; PaC entries come first in the
    per-commit position so that file-order listings (F4/F5) hold.
    """
    return _of_documents(res.read_result_documents(spark, paths))


def _of_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _of_flat(res.flatten_documents(documents))


def _of_flat(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    facts = flat.select(
        F.col("repository_id").alias("repo_id"), "project_name", "commit_id",
        F.coalesce("author", F.lit("")).alias("author"), F.coalesce("message", F.lit("")).alias("message"),
        "date", "pos",
        F.coalesce(F.size("pac_changes"), F.lit(0)).cast("long").alias("pac_files_count"),
        F.coalesce(F.size("other_changes"), F.lit(0)).cast("long").alias("other_files_count"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
          for c in ("pac_added_lines", "pac_deleted_lines", "total_added_lines", "total_deleted_lines")],
        F.coalesce("has_pac_changes", F.lit(False)).alias("has_pac_changes"))
    ch = res.flatten_document_changes(flat)
    n_pac = F.coalesce(F.size("pac_changes"), F.lit(0))
    offsets = flat.select("repository_id", "commit_id", n_pac.alias("__np"))
    classified = (ch.join(offsets, ["repository_id", "commit_id"], "left")
                  .select(F.col("repository_id").alias("repo_id"), "commit_id",
                          F.when(F.col("is_pac"), F.col("list_pos"))
                          .otherwise(F.col("__np") + F.col("list_pos")).cast("int").alias("pos"),
                          "file", "is_pac", "additions", "deletions", "total_changes", "status"))
    return facts, classified


def export_documents(spark: SparkSession, out_root: str, root: str) -> None:
    """The published results below ``out_root`` as one document per repository below ``root``, as the
    analysed tool's later scripts read them; the metadata is that of the last run."""
    facts, classified = load_results(spark, out_root)
    runs = spark.read.schema(RESULT_DOCUMENT["metadata"].dataType).json(f"{out_root}/runs")
    last = runs.orderBy(F.desc("analysis_endtime")).limit(1)
    docs.write_documents(docs.document_rows(facts, classified, load_files(spark, out_root), last), root)


def load_large_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``load_documents`` for documents of any size, split into commits while they are read
    (``sources.documents.read_documents`` gives the errors of those that cannot be)."""
    rows = docs.read_documents(spark, root).filter("error IS NULL").drop("error")
    return _of_flat(rows.withColumn("project_name", F.coalesce("project_name", res.name_of_file(F.col("file_path")))).drop("file_path"))


def analyses(facts: DataFrame, classified: DataFrame) -> dict[str, DataFrame]:
    """The analysis tables of one corpus (lazy; write or collect what you need)."""
    tx = co.cochange_transactions(classified, facts)
    ext = co.extension_rows(classified, facts)
    rows = ins.inspection_rows(facts, classified)
    rules = co.association_rules(tx)
    return {
        "pac_frequency": rm.pac_frequency(facts),
        "maintainer_share": rm.maintainer_share(facts),
        "commit_size_medians": rm.commit_size_medians(facts),
        "code_change_sizes": rm.code_change_sizes(facts),
        "corpus_medians": rm.corpus_medians(facts),
        "repo_fold": rm.repo_fold(facts),
        "corpus_summary": rm.corpus_summary(facts),
        "inspection": ins.inspection_sorted(rows),
        "inspection_sample": ins.inspection_sorted(ins.seeded_sample(facts, classified)),
        "pac_commit_stats": ins.pac_commit_stats(facts),
        "top_projects": ins.top_projects(facts),
        "extension_counts": co.extension_counts(ext),
        "cochange_totals": co.cochange_totals(ext),
        "association_rules": rules,
        "top_rules": co.top_rules(rules),
        "cochange_grid": co.cochange_grid(ext, tx),
    }
