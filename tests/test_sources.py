"""Sources and sinks: permissive reads, the document format, CSV round trips."""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fixtures import micro_facts, micro_frames
from histofold.operators import inspection as ins
from histofold.sources import catalog as cat
from histofold.sources import results as res
from histofold.sources import sinks


def test_results_roundtrip_and_quarantine(spark, tmp_path):
    facts, classified = micro_facts(spark)
    root = str(tmp_path / "out")
    _c, _f, _ch, _p, repos = micro_frames(spark)
    res.write_results(res.result_commits(facts), res.result_repositories(facts), root,
                      changes=res.result_changes(classified, repos))
    broken = tmp_path / "out" / "commits" / "owner_name=o" / "repository_name=r" / "broken.json"
    broken.write_text('{"commit_id": "zz", "date": \n')
    good, bad = res.read_results(spark, root)
    assert sorted(r.commit_id for r in good.collect()) == ["c1", "c2", "c3", "c4", "c5", "c6"]
    rows = bad.collect()
    assert len(rows) == 1 and rows[0].file_path.endswith("broken.json")
    flat = res.read_result_changes(spark, root).filter(F.col("commit_id") == "c6").collect()
    assert sorted((r.file, r.is_pac, r.additions) for r in flat) == [("p/a.rego", True, 5), ("src/x.py", False, 10)]
    keys = res.discover_results(spark, root).collect()
    assert {(k.owner_name, k.repository_name) for k in keys} == {("o", "r")}


def test_reference_documents(spark, tmp_path):
    d = tmp_path / "outputs" / "acme"
    d.mkdir(parents=True)
    doc = {"metadata": {"analysis_start": 1.0, "analysis_endtime": 2.0, "analysis_duration": 1.0,
                        "configuration": {"repository_no": 1, "use_test_mode": True}},
           "repositories": [{"repository_id": 5, "repository_name": "tool", "owner_name": "acme",
                             "total_commits": 2, "commits": [
                                 {"commit_id": "a", "date": 5, "has_pac_changes": True,
                                  "pac_changes": [{"file": "x.rego", "additions": 1, "deletions": 0,
                                                   "total_changes": 1, "status": 3}]},
                                 {"commit_id": "b", "date": 3, "has_pac_changes": False}]}]}
    (d / "tool.json").write_text(json.dumps(doc, indent=2))
    (d / "aggregated_results.json").write_text("{}")
    docs = res.read_result_documents(spark, str(d / "tool.json"))
    flat = res.flatten_documents(docs)
    assert [(r.project_name, r.pos, r.commit_id) for r in flat.collect()] == [("acme/tool", 0, "a"),
                                                                              ("acme/tool", 1, "b")]
    ch = res.flatten_document_changes(flat).collect()
    assert [(r.commit_id, r.is_pac, r.file) for r in ch] == [("a", True, "x.rego")]
    keys = res.discover_results(spark, str(tmp_path / "outputs")).collect()
    assert [(k.owner_name, k.repository_name) for k in keys] == [("acme", "tool")]


def test_catalog_csv_roundtrip(spark, tmp_path):
    _c, _f, _ch, _p, repos = micro_frames(spark)
    more = spark.createDataFrame([(9, "x/y, \"z\"", 2, "s9", "h9"), (3, "a/b", 3, "s3", "h3")],
                                 repos.schema)
    path = str(tmp_path / "catalog")
    cat.write_repo_catalog(repos.unionByName(more), path)
    got = cat.scan_repo_catalog(spark, path).orderBy("idx").collect()
    assert [(r.repo_id, r.full_name, r.sha, r.idx) for r in got] == [
        (7, "o/r", "c1", 1), (9, 'x/y, "z"', "s9", 2), (3, "a/b", "s3", 3)]
    assert cat.select_repo_by_number(cat.scan_repo_catalog(spark, path), 2).first().repo_id == 9


def test_inspection_csv_keeps_cr_and_quotes(spark, tmp_path):
    facts, classified = micro_facts(spark)
    facts = facts.withColumn("message", F.when(F.col("commit_id") == "c6", F.lit('fix "x",\r\nmore'))
                             .otherwise(F.col("message")))
    rows = ins.inspection_sorted(ins.inspection_rows(facts, classified))
    path = str(tmp_path / "insp")
    assert sinks.write_inspection_csv(rows, path)
    back = {r.commit_sha: r for r in sinks.read_inspection_csv(spark, path).collect()}
    assert back["c6"].commit_message == 'fix "x",\r more'     # \n -> space, \r kept (Q26)
    assert not sinks.write_inspection_csv(rows.limit(0), str(tmp_path / "empty"))


def test_inspection_file_is_one_ordered_file(spark, tmp_path):
    facts, classified = micro_facts(spark)
    facts = facts.withColumn("message", F.when(F.col("commit_id") == "c6", F.lit('fix "x",\r\nmore')).otherwise(F.col("message")))
    rows = ins.inspection_rows(facts, classified)
    many = ins.inspection_sorted(rows.crossJoin(spark.range(700)).withColumn(
        "project_name", F.concat(F.lit("o/r"), (F.col("id") * 7919 % 700).cast("string"))).drop("id").repartition(6))
    path = str(tmp_path / "new folder" / "insp.csv")
    assert sinks.write_inspection_file(many, path)
    with open(path, newline="") as f:
        lines = f.read().split("\n")
    assert lines[0] == ",".join(ins.CSV_COLUMNS) and sum(x == lines[0] for x in lines) == 1
    back = sinks.read_inspection_csv(spark, path, "line").orderBy("line").collect()
    want = [(r.project_name, r.commit_sha, r.commit_message) for r in many.collect()]
    assert [(r.project_name, r.commit_sha, r.commit_message) for r in back] == want
    assert [r.line for r in back] == list(range(1, len(want) + 1))
    assert [f.name for f in (tmp_path / "new folder").iterdir()
            if not f.name.startswith(".")] == ["insp.csv"]  # nothing unfinished is left
    assert not sinks.write_inspection_file(rows.limit(0), str(tmp_path / "none.csv")) and not (tmp_path / "none.csv").exists()


def test_catalog_files_with_different_headers(spark, tmp_path):
    import pytest

    d = tmp_path / "cat 1"
    d.mkdir()
    (d / "a.csv").write_text("id,full_name,last_commit_sha,stars\n1,o/a,s1,5\n2,o/b,s2,6\n")
    (d / "b x.csv").write_text("stars,last_commit_sha,full_name,id\n7,s3,o/c,3\n")
    (d / "c.csv").write_text('full_name,id\n"o/d, ""e""",4\n')
    (d / "d.csv").write_text("id,full_name,last_commit_sha,stars\n5,o/f,s5,1\n")
    path = str(tmp_path / "cat 1") + "/*.csv"
    got = [tuple(r) for r in cat.scan_repo_catalog(spark, path).orderBy("idx").collect()]
    assert got == [(1, "o/a", "s1", 1), (2, "o/b", "s2", 2), (3, "o/c", "s3", 3), (4, 'o/d, "e"', None, 4), (5, "o/f", "s5", 5)]
    (d / "e.csv").write_text("name,id\no/g,6\n")
    with pytest.raises(ValueError, match="e.csv lacks required columns: ..full_name"):
        cat.scan_repo_catalog(spark, path)
    p = tmp_path / "pac"
    p.mkdir()
    (p / "1.csv").write_text("repo_id,path\n1,x.rego\n1,x.rego\n")
    (p / "2.csv").write_text("path,note,repo_id\ny.rego,n,2\nx.rego,n,1\n")
    assert sorted(tuple(r) for r in cat.scan_pac_files(spark, str(p)).collect()) == [(1, "x.rego"), (2, "y.rego")]


def test_sorted_layout_roundtrip(spark, tmp_path):
    facts, classified = micro_facts(spark)
    _c, _f, _ch, _p, repos = micro_frames(spark)
    root = str(tmp_path / "sorted")
    res.write_results(res.result_commits(facts), res.result_repositories(facts), root,
                      changes=res.result_changes(classified, repos), layout="sorted")
    good, _bad = res.read_results(spark, root)
    assert sorted(r.commit_id for r in good.collect()) == ["c1", "c2", "c3", "c4", "c5", "c6"]
    assert {(r.owner_name, r.repository_name) for r in good.collect()} == {("o", "r")}
    keys = res.discover_results(spark, f"{root}/repositories").collect()
    assert [(k.owner_name, k.repository_name) for k in keys] == [("o", "r")]


def test_bucketed_facts_reregistered_and_fallback(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from histofold.plans import context as ctxmod
    sf = "/root/testdata/sf0.001"
    first = ctxmod.Context(spark, sf)
    n = first.facts.count()
    # A fresh context (as in another process) finds the published attempt and
    # registers the bucketed table again after the catalog forgot it.
    for t in spark.catalog.listTables():
        if t.name.startswith("histofold_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    again = ctxmod.Context(spark, sf)
    plan = again.facts.join(again.classified, ["repo_id", "commit_id"])._jdf.queryExecution().executedPlan()
    assert again.facts.count() == n and "Exchange hashpartitioning" not in plan.toString()
    # If the catalog refuses bucketed tables, the attempt is plain Parquet.
    monkeypatch.setattr(DataFrameWriter, "saveAsTable", lambda *a, **k: (_ for _ in ()).throw(AnalysisException("no")))
    plain = ctxmod.Context(spark, sf)
    attempt = plain.materialize(force=True)
    assert plain._buckets[attempt] is None and plain.facts.count() == n
