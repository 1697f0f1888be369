"""How often rows are read and moved: each table of line items, files and records once per step."""

import os

from pyspark.sql import functions as F

from histofold.operators import classify as cl
from histofold.plans.context import context

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def leaves(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [x for x in (plan.apply(i) for i in range(plan.size())) if table in x.output().mkString(",")]


def test_classification_reads_the_line_items_once(spark):
    assert len(leaves(context(spark, SF).classified_plan(), "l_orderkey")) == 1


def test_touched_files_equal_the_join_with_the_last_change(spark):
    records = spark.createDataFrame(
        [(1, "f", 0, 1, 0, 3, True), (1, "f", 1, 9, None, None, True), (1, "f", 2, 5, 5, 1, False), (1, "g", 3, 2, 2, 2, False),
         (2, "f", 0, 7, 1, 4, True), (2, None, 1, 1, 1, 1, True), (3, "", 0, None, None, None, True)],
        "commit_id long, file string, pos int, additions int, deletions int, status int, recorded boolean")
    files = records.select("commit_id", "file", "pos").filter("file IS NOT NULL")
    changes = records.filter("recorded").drop("recorded")
    joined = files.join(cl.last_change(changes), ["commit_id", "file"], "left").withColumn("has_info", F.coalesce("has_info", F.lit(False)))
    touched = cl.touched_files(records).filter("file IS NOT NULL")
    cols = ["commit_id", "pos", "file", "additions", "deletions", "status", "has_info"]
    assert sorted(map(tuple, touched.select(cols).collect()), key=str) == sorted(map(tuple, joined.select(cols).collect()), key=str)


def test_result_lines_are_packed_and_found(spark, tmp_path):
    from histofold.sources import results as res

    facts = context(spark, SF).facts
    root = str(tmp_path / "out")
    res.write_results(res.result_commits(facts), res.result_repositories(facts), root)
    size = lambda pattern: sum(f.stat().st_size for f in tmp_path.glob(pattern))
    assert size("out/commits/*/*/*.json") == 0
    plain = sum(len(r.value) + 1 for r in spark.read.text(f"{root}/commits").select("value").collect())
    assert 0 < size("out/commits/*/*/*.json.gz") < plain / 3
    names = {(r.owner_name, r.repository_name) for r in res.result_repositories(facts).collect()}
    for folder in ("", "/commits", "/repositories"):
        assert {(r.owner_name, r.repository_name) for r in res.discover_results(spark, root + folder).collect()} == names


def _records(spark):
    rows = [(7, "a", "amy", ["f"], "x", 0, 1), (7, "a", "amy", ["f"], "x", 0, 2), (7, "a", "eve", ["g"], "y", 0, 3),
            (7, "b", "bob", ["f"], "x", 0, 4), (8, "a", "eve", None, "x", 0, 5), (8, "c", None, [], "y", 0, 6), (8, "c", None, [], "x", 9, 7)]
    d = spark.createDataFrame(rows, "repo_id long, commit_id string, author string, files array<string>, file_path string, block long, line_id long")
    empty = {"author_email": "string", "message": "string", "date": "long", "parent_count": "int", "pos": "int",
             "parents": "array<string>", "changes": "array<struct<file string>>"}
    return d.withColumns({k: F.lit(None).cast(v.replace("file string", "file:string")) for k, v in empty.items()})


def test_records_are_resolved_with_whole_records_moved_once(spark):
    from histofold.operators import records as rec

    records = _records(spark)
    history, differing = rec.resolve_records(records, rec.repeated_commits(records))
    assert {r.line_id for r in history.collect()} == {3, 4, 5, 6}
    assert {r.line_id for r in differing.collect()} == {1, 2}
    assert sorted(history.columns) == sorted(differing.columns) == sorted(records.columns)
    whole = [x for x in leaves(history.withColumn("n", F.size("changes")), "changes") if "message" in x.output().mkString(",")]
    plan = history._jdf.queryExecution().optimizedPlan().toString()
    assert len(whole) <= 2 and "Union" not in plan


def test_lists_gathered_together_equal_the_export(spark):
    from histofold.sources import history as hist

    h = context(spark, SF).h
    one, two = hist.export_records(h.commits, h.records), hist.export_history(h.commits, h.files, h.changes)
    assert one.schema == two.schema and one.count() == two.count()
    assert one.exceptAll(two).isEmpty()
    assert len(leaves(one, "l_orderkey")) == 1


def test_inspection_file_is_read_in_blocks(spark, tmp_path):
    from histofold.operators.inspection import CSV_COLUMNS
    from histofold.sources import sinks

    def written(name, message, author):
        row = {"commit_message": message, "author": author, "date": "1"}
        line = ",".join(row.get(c, "2" if c.startswith(("total", "pac_files_count", "other", "pac_added", "pac_deleted")) else "t") for c in CSV_COLUMNS)
        (tmp_path / name).write_text(",".join(CSV_COLUMNS) + "\n" + (line + "\n") * 3_000, newline="")
        return str(tmp_path / name)

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        plain = sinks.read_inspection_csv(spark, written("plain.csv", '"say ""hi"", twice"', "amy"), "line")
        assert plain.rdd.getNumPartitions() > 1 and sinks.read_inspection_csv(spark, str(tmp_path / "plain.csv")).rdd.getNumPartitions() > 4
        assert [r.line for r in plain.orderBy("line").collect()] == list(range(1, 3_001))
        assert {r.commit_message for r in plain.collect()} == {'say "hi", twice'}
        for name, field in (("lf.csv", '"two\nlines"'), ("cr.csv", '"two\rlines"')):
            broken = sinks.read_inspection_csv(spark, written(name, field, '"x\ny"'), "line")
            assert broken.count() == 3_000 and {r.commit_message.replace("\r", "\n") for r in broken.collect()} == {"two\nlines"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entries_of_a_history_give_the_join_of_files_and_changes(spark):
    from histofold.schemas import HISTORY
    from histofold.sources import history as hist

    def change(file, added, status):
        return (file, added, 1, None if added is None else added + 1, status)

    rows = [("a", ["f", "f", "g", None], [change("f", 1, 3), change("f", None, 1), change("h", 4, 2)]), ("b", [], [change("f", 2, 3)]), ("c", ["f"], [])]
    given = spark.createDataFrame([(7, c, f, x) for c, f, x in rows], "repo_id long, commit_id string, files array<string>, changes "
                                  + HISTORY["changes"].dataType.simpleString())
    h = given.withColumns({"author": F.lit("x"), "author_email": F.lit("x"), "message": F.lit("m"), "date": F.lit(1), "parent_count": F.lit(1), "pos": F.lit(0)})
    _, files, changes = hist.history_tables(h)
    joined = files.join(cl.last_change(changes), ["commit_id", "file"], "left").withColumn("has_info", F.coalesce("has_info", F.lit(False)))
    touched = cl.touched_files(hist.history_entries(h))
    cols = ["commit_id", "pos", "file", "additions", "deletions", "status", "has_info"]
    got = sorted(map(tuple, touched.select(cols).collect()), key=str)
    assert len(got) == 4 and got == sorted(map(tuple, joined.select(cols).collect()), key=str)


def test_documents_are_made_where_the_collection_lies(spark, monkeypatch):
    """Commits, files and changes of a document come from the collected tables; only the finished text is moved."""
    from histofold.plans.queries import QUERIES
    from histofold.sources import documents as docs

    made, write = [], docs.write_documents
    monkeypatch.setattr(docs, "write_documents", lambda rows, root, **options: (made.append(rows), write(rows, root, **options)))
    assert QUERIES["documents_roundtrip"](spark, SF).count() == context(spark, SF).facts.count() > 0
    (rows,) = made
    commits = rows.filter("ord >= 0")
    assert not leaves(commits, "l_orderkey") and "Exchange hashpartitioning" not in commits._jdf.queryExecution().executedPlan().toString()


def test_facts_read_the_line_items_once(spark):
    """The commit totals come from the touched files' own records, and equal those of all change records."""
    c = context(spark, SF)
    plan = c.facts_plan()
    assert len(leaves(plan, "l_orderkey")) == 1
    apart = cl.commit_fold(c.h.commits, c.classified, c.h.changes, c.h.repos)
    assert plan.schema == apart.schema and plan.count() == apart.count()
    assert plan.exceptAll(apart).isEmpty()


def test_own_records_count_each_once_where_a_path_repeats(spark):
    commits = spark.createDataFrame([(7, 1, 1), (7, 2, 0), (7, 3, 2), (8, 4, 1)], "repo_id int, commit_id long, parent_count int").withColumns(
        {"author": F.lit("a"), "message": F.lit("m"), "date": F.lit(1).cast("long"), "pos": F.col("commit_id").cast("int")})
    records = spark.createDataFrame(
        [(1, "f", 0, 1, 2, 3, True), (1, "f", 1, 9, None, None, True), (1, "f", 2, 5, 5, 1, False), (1, "g", 3, 2, 2, 2, True),
         (2, "f", 0, 7, 1, 4, True), (3, "f", 0, 7, 1, 4, True)],
        "commit_id long, file string, pos int, additions int, deletions int, status int, recorded boolean")
    pac = spark.createDataFrame([(7, "f"), (7, "f")], "repo_id int, path string")
    repos = spark.createDataFrame([(7, "o/r"), (8, "o/s")], "repo_id int, full_name string")
    files, changes = records.select("commit_id", "file", "pos"), records.filter("recorded").drop("recorded")
    apart = cl.classify_changes(commits, files, changes, pac)
    touched = cl.classify_touched(commits, files, changes, pac, touched=cl.touched_files(records))
    kept = cl.kept_changes(touched)
    assert kept.schema.simpleString() == apart.schema.simpleString() and touched.count() == 5
    assert sorted(map(str, kept.collect())) == sorted(map(str, apart.collect()))
    one, two = cl.commit_fold(commits, kept, changes, repos, touched=touched), cl.commit_fold(commits, apart, changes, repos)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {(r.commit_id, r.total_added_lines, r.total_deleted_lines) for r in one.collect()} == {(1, 12, 4), (2, 7, 0), (4, 0, 0)}
