"""Collection over files and analyses from results / from the old document format."""

import json

import pytest
from pyspark.sql import functions as F

from fixtures import micro_frames
from histofold.operators import repo_metrics as rm
from histofold.plans import jobs
from histofold.sources import catalog as cat
from histofold.sources import history as hist


def _inputs(spark, tmp_path):
    c, f, ch, p, r = micro_frames(spark)
    # a fork (repo 8) sharing commit ids with repo 7, but with no PaC files of its own
    fork = c.filter("commit_id IN ('c5', 'c6')").withColumn("repo_id", F.lit(8).cast("long"))
    repos = r.unionByName(spark.createDataFrame([(8, "fork/r", 2, "c6", "c6"), (9, "o/empty", 3, "z", "z")],
                                                r.schema))
    cat.write_repo_catalog(repos, str(tmp_path / "catalog"))
    cat.write_pac_files(p, str(tmp_path / "pac"))
    hist.write_history(hist.export_history(c.unionByName(fork), f, ch), str(tmp_path / "history"))
    return str(tmp_path / "catalog"), str(tmp_path / "pac"), str(tmp_path / "history")


def test_collect_then_analyse(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    out = str(tmp_path / "results")
    diag = jobs.collect(spark, catalog, pac, history, out)
    assert {(d.repo_id, d.reason) for d in diag.collect()} == {
        (9, "No commits found"), (7, "History not cut at the pinned revision: parents are not recorded")}
    facts, classified = jobs.load_results(spark, out)
    freq = {r.repository: r for r in rm.pac_frequency(facts).collect()}
    assert (freq["o/r"].total_commits, freq["o/r"].pac_commits, freq["o/r"].first_pac_commit_index) == (3, 2, 3)
    # same commit ids in the fork, classified against the fork's own list (src/x.py is PaC there)
    fork = facts.filter("repo_id = 8").orderBy("commit_id").collect()
    assert [(x.commit_id, x.pac_files_count, x.other_files_count) for x in fork] == [("c5", 1, 0), ("c6", 1, 1)]
    assert (freq["fork/r"].total_commits, freq["fork/r"].first_pac_commit_index) == (2, 0)
    orig = facts.filter("repo_id = 7 AND commit_id = 'c6'").first()
    assert (orig.pac_files_count, orig.other_files_count) == (1, 1)
    tables = jobs.analyses(facts, classified)
    rules = {(x.antecedent, x.consequent) for x in tables["association_rules"].collect()}
    assert rules == {(".rego", ".py"), (".py", ".rego")}    # the fork's c6 reverses the roles
    # a second run skips repositories that already have results
    jobs.collect(spark, catalog, pac, history, out)
    facts2, _ = jobs.load_results(spark, out)
    assert facts2.count() == facts.count()
    runs = spark.read.json(f"{out}/runs").collect()
    assert len(runs) == 2 and all(r.analysis_duration >= 0 for r in runs)


def test_collect_one_repository_by_number(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    out = str(tmp_path / "one")
    jobs.collect(spark, catalog, pac, history, out, repository_no=2)      # catalog row 2 = fork/r
    facts, _ = jobs.load_results(spark, out)
    assert {r.project_name for r in facts.collect()} == {"fork/r"}


def test_analyses_from_old_documents(spark, tmp_path):
    d = tmp_path / "outputs" / "o"
    d.mkdir(parents=True)
    def change(f, a, dl, st):
        return {"file": f, "additions": a, "deletions": dl, "total_changes": a + dl, "status": st}
    commits = [
        {"commit_id": "c6", "author": "amy", "date": 300, "has_pac_changes": True,
         "pac_changes": [change("p/a.rego", 5, 1, 3)], "other_changes": [change("src/x.py", 10, 0, 3)],
         "pac_added_lines": 5, "pac_deleted_lines": 1, "total_added_lines": 15, "total_deleted_lines": 1},
        {"commit_id": "c5", "author": "bob", "date": 200, "has_pac_changes": False,
         "other_changes": [change("src/x.py", 4, 4, 3)], "total_added_lines": 4, "total_deleted_lines": 4},
        {"commit_id": "c4", "author": "amy", "date": 200, "has_pac_changes": True,
         "pac_changes": [change("p/b.yaml", 0, 0, 4)], "total_added_lines": 3},
    ]
    doc = {"repositories": [{"repository_id": 7, "project_name": "o/r", "commits": commits}]}
    (d / "r.json").write_text(json.dumps(doc))
    facts, classified = jobs.load_documents(spark, str(d / "r.json"))
    r = rm.pac_frequency(facts).collect()[0]
    # order: c5 (200, pos 1), c4 (200, pos 2), c6 (300): first PaC at index 1
    assert (r.total_commits, r.pac_commits, r.first_pac_commit_index) == (2, 2, 1)
    got = {(x.commit_id, x.file, x.is_pac, x.pos) for x in classified.collect()}
    assert ("c6", "p/a.rego", True, 0) in got and ("c6", "src/x.py", False, 1) in got


def test_strict_collection_fails_on_repository_without_commits(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    with pytest.raises(RuntimeError, match="No commits found for o/empty"):
        jobs.collect(spark, catalog, pac, history, str(tmp_path / "strict"), strict=True)


def test_unreadable_document_is_skipped(spark, tmp_path):
    d = tmp_path / "outputs" / "o"
    d.mkdir(parents=True)
    (d / "good.json").write_text(json.dumps({"repositories": [{"repository_id": 1, "project_name": "o/good",
                                                               "commits": [{"commit_id": "a", "date": 1}]}]}))
    (d / "bad.json").write_text('{"repositories": [ {"repository_id": ')
    facts, _ = jobs.load_documents(spark, str(d))
    assert [(r.project_name, r.commit_id) for r in facts.collect()] == [("o/good", "a")]


def test_file_job_equals_adapter_path_on_real_data(spark, tmp_path):
    """sf0.001 exported to files, collected by the job, analysed: same as the registry."""
    from histofold.plans.context import context
    ctx = context(spark, "/root/testdata/sf0.001")
    h = ctx.h
    cat.write_repo_catalog(h.repos, str(tmp_path / "catalog"))
    cat.write_pac_files(h.pac_files, str(tmp_path / "pac"))
    hist.write_history(hist.export_history(h.commits, h.files, h.changes), str(tmp_path / "history"))
    out = str(tmp_path / "results")
    jobs.collect(spark, str(tmp_path / "catalog"), str(tmp_path / "pac"), str(tmp_path / "history"), out)
    facts, classified = jobs.load_results(spark, out)
    cols = ["repository", "total_commits", "pac_commits", "pac_maintenance_frequency", "first_pac_commit_index"]
    got = sorted(rm.pac_frequency(facts).select(*cols).collect())
    want = sorted(rm.pac_frequency(ctx.facts).select(*cols).collect())
    assert got == want and len(got) > 0
    tables = jobs.analyses(facts, classified)
    reg = jobs.analyses(ctx.facts, ctx.classified)
    for name in ("association_rules", "corpus_medians", "pac_commit_stats", "cochange_totals"):
        assert sorted(tables[name].collect()) == sorted(reg[name].collect()), name


def test_history_lines_that_cannot_be_read_are_quarantined(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    (tmp_path / "history" / "zz.json").write_text('{"repo_id": 7, "commit_id": "broken\n{"repo_id": 7, "author": "x"}\n')
    out = str(tmp_path / "results")
    jobs.collect(spark, catalog, pac, history, out)
    lost = jobs.load_quarantine(spark, out).collect()
    assert sorted(r.reason for r in lost) == ["no commit or repository id", "unreadable line"]
    assert all(r.file_path.endswith("zz.json") for r in lost) and any("broken" in r.record for r in lost)
    one = str(tmp_path / "only")
    hist.write_history(hist.scan_commit_history(spark, history).filter("repo_id = 7 AND commit_id IS NOT NULL"), str(tmp_path / "h7"))
    (tmp_path / "h7" / "zz.json").write_text("{broken")
    with pytest.raises(RuntimeError, match="unreadable line"):
        jobs.collect(spark, catalog, pac, str(tmp_path / "h7"), one, strict=True, repository_no=1)


@pytest.mark.parametrize("dies_at", ["repositories", "commits", "changes", "files", "quarantine", "done_keys", "published"])
def test_a_run_that_dies_is_collected_again(spark, tmp_path, monkeypatch, dies_at):
    """A run that stops before or at any dataset publishes nothing, and the next one is whole."""
    catalog, pac, history = _inputs(spark, tmp_path)
    out, kind = str(tmp_path / "results"), type(spark.range(1).write)
    for name in ("json", "parquet"):
        write = getattr(kind, name)

        def dying(self, path, *a, _write=write, **k):
            if f"results/{dies_at}" in path:
                raise RuntimeError("executor lost")
            return _write(self, path, *a, **k)

        monkeypatch.setattr(kind, name, dying)
    with pytest.raises(RuntimeError, match="executor lost"):
        jobs.collect(spark, catalog, pac, history, out)
    monkeypatch.undo()
    assert jobs.published_repositories(spark, out).count() == 0
    jobs.collect(spark, catalog, pac, history, out)
    facts, classified = jobs.load_results(spark, out)
    clean = str(tmp_path / "clean")
    jobs.collect(spark, catalog, pac, history, clean)
    want_facts, want_classified = jobs.load_results(spark, clean)
    assert sorted(map(str, facts.collect())) == sorted(map(str, want_facts.collect())) and facts.count() > 0
    assert sorted(map(str, classified.collect())) == sorted(map(str, want_classified.collect()))


def test_later_run_replaces_and_email_and_files_survive(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    rows = hist.scan_commit_history(spark, history).withColumn("author_email", F.concat("commit_id", F.lit("@x.org")))
    hist.write_history(rows, str(tmp_path / "h2"))
    out = str(tmp_path / "results")
    jobs.collect(spark, catalog, pac, history, out)
    before = jobs.load_results(spark, out)[0].count()
    jobs.collect(spark, catalog, pac, str(tmp_path / "h2"), out, skip_existing=False)
    facts = jobs.load_results(spark, out)[0].collect()
    assert len(facts) == before and all(r.author_email == f"{r.commit_id}@x.org" for r in facts)
    files = {(r.repository_id, r.commit_id, r.pos): r.file for r in jobs.load_files(spark, out).collect()}
    want = {(r.repo_id, r.commit_id, r.pos): r.file for r in hist.history_files(rows.filter("parent_count < 2")).collect() if r.file}
    assert files == want


def test_pinned_revision_that_is_missing_is_reported(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    repos = cat.scan_repo_catalog(spark, catalog).withColumn("sha", F.when(F.col("repo_id") == 7, F.lit("gone")).otherwise(F.col("sha")))
    cat.write_repo_catalog(repos, str(tmp_path / "pinned"))
    diag = jobs.collect(spark, str(tmp_path / "pinned"), pac, history, str(tmp_path / "out"))
    assert {(d.repo_id, d.reason) for d in diag.collect()} >= {(7, "Pinned revision not found"), (9, "No commits found")}


def test_documents_behind_discovery(spark, tmp_path):
    d = tmp_path / "outputs" / "o"
    d.mkdir(parents=True)
    doc = lambda c: json.dumps({"repositories": [{"repository_id": 1, "project_name": "o/a", "commits": [{"commit_id": c, "date": 1}]}]})
    (d / "a.json").write_text(doc("old"))
    (d / "aggregated_results.json").write_text(doc("sum"))
    later = tmp_path / "outputs" / "z" / "o"
    later.mkdir(parents=True)
    (later / "a.json").write_text(doc("new"))
    (later / "b.json").write_text("{")
    assert [r.commit_id for r in jobs.load_discovered(spark, str(tmp_path / "outputs"))[0].collect()] == ["new"]
    from histofold.sources import results as res
    bad = res.unreadable_documents(res.read_result_documents(spark, str(tmp_path / "outputs"), recursive=True)).collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in bad] == ["b.json"]


def test_discovery_by_manifest(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    out = tmp_path / "results"
    jobs.collect(spark, catalog, pac, history, str(out))
    jobs.collect(spark, catalog, pac, history, str(out), repository_no=2, skip_existing=False, layout="sorted")
    last = sorted(out.joinpath("published").glob("run=*"), key=lambda f: f.stat().st_mtime)[-1].name.removeprefix("run=")
    found = {(r.owner_name, r.repository_name): r for r in jobs.discover(spark, str(out)).collect()}
    assert set(found) == {("o", "r"), ("fork", "r")}
    assert found["fork", "r"].run == last != found["o", "r"].run
    rows = {k: spark.read.json(r.file_path).count() for k, r in found.items()}
    assert rows == {("o", "r"): 1, ("fork", "r"): 1}
    # the result folders are not looked at: discovery is the same without them
    plan = jobs.discover(spark, str(out))._jdf.queryExecution().optimizedPlan().toString()
    assert "repositories" not in plan
    # a run that is listed but not published does not count; a published one without a list is listed
    (out / "published" / f"run={last}").rename(tmp_path / "hidden")
    spark.catalog.refreshByPath(str(out))
    assert {r.run for r in jobs.discover(spark, str(out)).collect()} == {found["o", "r"].run}
    (tmp_path / "hidden").rename(out / "published" / f"run={last}")
    (out / "manifest" / f"run={last}").rename(tmp_path / "old-manifest")
    spark.catalog.refreshByPath(str(out))
    assert {(r.repository_name, r.owner_name, r.run) for r in jobs.discover(spark, str(out)).collect()} == {
        ("r", k[0], r.run) for k, r in found.items()}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_dates_outside_the_usual_range(spark, ansi):
    from fixtures import micro_frames  # noqa: F401
    rows = [(1, "o/r", f"c{k}", "a", d, k, p) for k, (d, p) in enumerate(
        [(None, False), (2 ** 33, True), (-(2 ** 40), False), (0, True), (2 ** 62, False), (None, True), (2 ** 33, False)])]
    facts = spark.createDataFrame(rows, "repo_id long, project_name string, commit_id string, author string, date long, pos int, "
                                        "has_pac_changes boolean")
    for c in ("pac_files_count", "other_files_count", "pac_added_lines", "pac_deleted_lines", "total_added_lines", "total_deleted_lines"):
        facts = facts.withColumn(c, F.lit(1).cast("long"))
    order = sorted(rows, key=lambda r: (r[4] or 0, r[5]))
    first = next(k for k, r in enumerate(order) if r[6])
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert {r.commit_id: r.idx for r in rm.commit_index(facts).collect()} == {r[2]: k for k, r in enumerate(order)}
        got = rm.pac_frequency(facts).first()
        assert (got.first_pac_commit_index, got.total_commits) == (first, len(rows) - first)
        assert {r.commit_id for r in rm.since_first_pac(facts).collect()} == {r[2] for r in order[first:]}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_commit_index_splits_a_hot_date(spark, monkeypatch):
    monkeypatch.setattr(rm, "POS_BLOCK", 16)
    facts = spark.range(400).selectExpr("1L AS repo_id", "cast(id AS string) AS commit_id", "cast(id AS int) AS pos",
                                        "CASE WHEN id % 5 = 0 THEN 100L WHEN id % 5 < 4 THEN NULL ELSE id END AS date")
    want = sorted(facts.collect(), key=lambda r: (r.date or 0, r.pos))
    assert {r.commit_id: r.idx for r in rm.commit_index(facts).collect()} == {r.commit_id: k for k, r in enumerate(want)}


def _copy(rows, path, **changed):
    hist.write_history(rows.withColumns({k: F.lit(v) for k, v in changed.items()}) if changed else rows, str(path))


def test_a_commit_in_two_files_counts_once(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    out = str(tmp_path / "plain")
    jobs.collect(spark, catalog, pac, history, out)
    rows = hist.scan_commit_history(spark, history)
    _copy(rows, tmp_path / "h" / "a")
    _copy(rows.filter("commit_id = 'c5'"), tmp_path / "h" / "b", author="mallory")     # an older record that differs
    _copy(rows.filter("commit_id IN ('c4', 'c5', 'c6')"), tmp_path / "h" / "c")
    twice = str(tmp_path / "twice")
    jobs.collect(spark, catalog, pac, str(tmp_path / "h" / "*"), twice)
    for one, two in zip(jobs.load_results(spark, out), jobs.load_results(spark, twice)):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 0
    lost = jobs.load_quarantine(spark, twice).collect()
    # repositories 7 and 8 both have c5
    assert [r.reason for r in lost] == ["differs from the last record of its commit"] * 2
    assert all("/b/" in r.file_path and "mallory" in r.record for r in lost)
    with pytest.raises(RuntimeError, match="differs from the last record"):
        jobs.collect(spark, catalog, pac, str(tmp_path / "h" / "*"), str(tmp_path / "s"), strict=True, repository_no=1)


def test_last_file_wins(spark, tmp_path):
    catalog, pac, history = _inputs(spark, tmp_path)
    rows = hist.scan_commit_history(spark, history)
    _copy(rows, tmp_path / "h" / "a")
    _copy(rows.filter("commit_id = 'c5' AND repo_id = 7"), tmp_path / "h" / "b", author="zoe", files=[], changes=[])
    out = str(tmp_path / "out")
    jobs.collect(spark, catalog, pac, str(tmp_path / "h" / "*"), out)
    got = jobs.load_results(spark, out)[0].filter("commit_id = 'c5'").collect()
    assert {(r.repo_id, r.author, r.other_files_count) for r in got if r.repo_id == 7} == {(7, "zoe", 0)}


def test_history_without_positions(spark, tmp_path):
    """Two PaC commits of one date: without ``pos`` their order is that of the lines, over several files."""
    catalog, pac, history = _inputs(spark, tmp_path)
    out = str(tmp_path / "plain")
    jobs.collect(spark, catalog, pac, history, out)
    ordered = hist.scan_commit_history(spark, history).orderBy("repo_id", "pos").drop("pos")
    ordered.write.json(str(tmp_path / "h"))
    assert "pos" not in spark.read.json(str(tmp_path / "h")).columns
    bare = str(tmp_path / "bare")
    jobs.collect(spark, catalog, pac, str(tmp_path / "h"), bare)
    want, got = (sorted(rm.pac_frequency(jobs.load_results(spark, o)[0]).collect()) for o in (out, bare))
    assert got == want and len(got) == 2
    facts = jobs.load_results(spark, bare)[0]
    assert [r.commit_id for r in facts.filter("repo_id = 7").orderBy("pos").collect()] == ["c6", "c5", "c4", "c3", "c2", "c1"]


# walk order of a small DAG: a side branch s1-s2 merged by m, pins at c3 and s2
DAG = [("h", ["m"]), ("m", ["c4", "s2"]), ("s2", ["s1"]), ("c4", ["c3"]), ("s1", ["c2"]), ("c3", ["c2"]), ("c2", ["c1"]), ("c1", [])]


PINS = {7: "c3", 11: "s2", 12: "h", 13: "gone", 14: None}


def _dag(spark, path, parents=True):
    from histofold.schemas import HISTORY
    rows = [(repo, c, "amy", "a@x", "m", 1000 - k, len(p), k, ["p/a.rego"], [("p/a.rego", 1, 0, 1, 3)], p if parents else None)
            for repo in PINS for k, (c, p) in enumerate(DAG)]
    hist.write_history(spark.createDataFrame(rows, HISTORY), path)
    return path


def test_history_is_cut_at_the_pin(spark, tmp_path, monkeypatch):
    from histofold.operators import records as rec
    monkeypatch.setattr(rec, "BLOCK", 3)
    _, pac, _ = _inputs(spark, tmp_path)
    repos = spark.createDataFrame([(k, f"o/r{k}", n + 1, pin, "h") for n, (k, pin) in enumerate(PINS.items())],
                                  "repo_id long, full_name string, idx int, sha string, head_sha string")
    pinned = str(tmp_path / "pinned")
    cat.write_repo_catalog(repos, pinned)
    whole = {"h", "s2", "s1", "c4", "c3", "c2", "c1"}   # m is a merge

    def kept(out):
        found = {}
        for r in jobs.load_results(spark, str(tmp_path / out))[0].collect():
            found.setdefault(r.repo_id, set()).add(r.commit_id)
        return found

    notes = {(13, "Pinned revision not found"), (14, "No pinned revision")}
    dag = _dag(spark, str(tmp_path / "dag"))
    diag = jobs.collect(spark, pinned, pac, dag, str(tmp_path / "cut"))
    assert {(d.repo_id, d.reason) for d in diag.collect()} == notes
    assert kept("cut") == {7: {"c3", "c2", "c1"}, 11: {"s2", "s1", "c2", "c1"}, 12: whole, 13: whole, 14: whole}
    # a strict run goes on with HEAD where the pin is gone, and fails without a pin
    jobs.collect(spark, pinned, pac, dag, str(tmp_path / "gone"), strict=True, repository_no=4)
    with pytest.raises(RuntimeError, match="No pinned revision for o/r14"):
        jobs.collect(spark, pinned, pac, dag, str(tmp_path / "none"), strict=True, repository_no=5)
    # listed repositories are taken at HEAD; a history without parents goes on whole, with a note
    not_cut = "History not cut at the pinned revision: parents are not recorded"
    diag = jobs.collect(spark, pinned, pac, _dag(spark, str(tmp_path / "bare"), parents=False), str(tmp_path / "bare-out"),
                        use_head=["o/r7"], layout="sorted")
    assert {(d.repo_id, d.reason) for d in diag.collect()} == notes | {(11, not_cut)}
    assert kept("bare-out") == dict.fromkeys(PINS, whole)


@pytest.mark.parametrize("block", [5, 1000])
def test_reachable_against_a_plain_walk(spark, tmp_path, block):
    import random

    from histofold.operators import records as rec
    rng, rows, pins, want = random.Random(block), [], [], set()
    for repo in range(6):
        n = rng.choice([1, 9, 18])
        graph = {f"c{k}": [f"c{j}" for j in rng.sample(range(k + 1, n), min(rng.choice([0, 1, 1, 1, 2]), n - k - 1))] for k in range(n)}
        if repo == 5:
            graph["c0"] = ["c0", "not here", None]     # broken links end a path
        place = list(range(n))
        if repo == 4:
            rng.shuffle(place)                         # any order of positions gives the same result
        rows += [(repo, c, place[k], p) for k, (c, p) in enumerate(graph.items())]
        start = rng.choice(list(graph))
        pins.append((repo, start))
        seen, todo = set(), [start]
        while todo:
            c = todo.pop()
            if c in graph and c not in seen:
                seen.add(c)
                todo += graph[c]
        want |= {(repo, c) for c in seen}

    def keep(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    history = spark.createDataFrame(rows, "repo_id long, commit_id string, pos int, parents array<string>")
    got = rec.reachable(history, spark.createDataFrame(pins, "repo_id long, revision string"), keep, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
