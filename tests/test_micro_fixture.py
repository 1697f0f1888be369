"""Expected values of FIXTURES.md §2, derived by hand."""

import pytest
from pyspark.sql import functions as F

from fixtures import micro_facts, micro_frames
from histofold.operators import classify as cl
from histofold.operators import cochange as co
from histofold.operators import inspection as ins
from histofold.operators import repo_metrics as rm


@pytest.fixture(scope="module")
def micro(spark):
    facts, classified = micro_facts(spark)
    return facts.cache(), classified.cache()


def test_commit_fold_a1(micro):
    facts, _ = micro
    got = {r.commit_id: (r.pac_files_count, r.other_files_count, r.pac_added_lines + r.pac_deleted_lines,
                         r.total_added_lines + r.total_deleted_lines)
           for r in facts.collect()}
    assert got == {"c6": (1, 1, 6, 16), "c5": (0, 1, 0, 8), "c4": (1, 0, 0, 3), "c3": (0, 0, 0, 7),
                   "c2": (0, 2, 0, 1), "c1": (0, 0, 0, 7)}  # merge "mm" dropped (Q1)


def test_status_rules(micro):
    _, classified = micro
    rows = {(r.commit_id, r.file): r for r in classified.collect()}
    assert ("c3", "p/a.rego") not in rows          # deleted PaC file (Q2)
    assert ("c4", "docs/.gitignore") not in rows   # added other file (Q2)
    n = rows[("c2", "note.txt")]                   # other file without record kept, zeros (Q4)
    assert (n.additions, n.deletions, n.status, n.is_pac) == (0, 0, None, False)
    assert rows[("c4", "p/b.yaml")].is_pac         # rename of a PaC file counts


def test_repo_fold_a3(micro):
    facts, _ = micro
    r = rm.repo_fold(facts).collect()[0]
    assert (r.total_commits, r.pac_changes_count, r.pac_commits_count) == (6, 2, 2)
    assert r.pac_change_ratio == pytest.approx(1 / 3)
    assert (r.total_added_lines, r.total_deleted_lines, r.total_modified_lines) == (30, 12, 42)
    assert (r.pac_added_lines, r.pac_deleted_lines, r.pac_modified_lines) == (5, 1, 6)
    assert (r.owner_name, r.repository_name) == ("o", "r")


def test_frequency_a5(micro):
    facts, _ = micro
    r = rm.pac_frequency(facts).collect()[0]
    assert (r.total_commits, r.pac_commits, r.first_pac_commit_index) == (3, 2, 3)
    assert r.pac_maintenance_frequency == pytest.approx(200 / 3)


def test_first_index_w1(micro):
    facts, _ = micro
    r = rm.first_pac_index(facts).collect()[0]
    assert (r.total_commits, r.first_pac_commit_index) == (6, 3)


def test_commit_sizes_a6(micro):
    facts, _ = micro
    r = rm.commit_size_medians(facts).collect()[0]
    assert (r.pac_commits_count, r.pac_commit_median_size) == (2, 9.5)
    assert (r.non_pac_commits_count, r.non_pac_commit_median_size) == (1, 7.0)


def test_maintainers_a7(micro):
    facts, _ = micro
    r = rm.maintainer_share(facts).collect()[0]
    assert (r.total_authors, r.pac_authors, r.pac_maintainer_percentage) == (1, 1, 100.0)


def test_code_changes_a8(micro):
    facts, _ = micro
    r = rm.code_change_sizes(facts).collect()[0]
    assert (r.pac_commits_with_changes, r.pac_code_median_changes, r.pac_changes_min, r.pac_changes_max) \
        == (1, 6.0, 6, 6)
    assert (r.non_pac_commits_with_changes, r.non_pac_code_median_changes, r.non_pac_changes_min,
            r.non_pac_changes_max) == (2, 6.5, 3, 10)
    assert (r.non_pac_only_commits_count, r.non_pac_only_median_changes, r.non_pac_only_changes_min,
            r.non_pac_only_changes_max) == (1, 7.0, 7, 7)


def test_inspection_a10_p12_f5(micro):
    facts, classified = micro
    s = ins.pac_commit_stats(facts).collect()[0]
    assert (s.total_commits, s.unique_projects) == (2, 1)
    assert (s.avg_pac_files_per_commit, s.avg_other_files_per_commit) == (1.0, 0.5)
    assert (s.avg_pac_line_changes, s.avg_total_line_changes) == (3.0, 9.5)
    assert (s.commits_with_only_pac, s.commits_with_mixed_changes) == (1, 1)
    rows = {r.commit_sha: r for r in ins.inspection_rows(facts, classified).collect()}
    assert set(rows) == {"c6", "c4"}
    assert rows["c6"].github_url == "https://github.com/o/r/commit/c6"
    assert rows["c6"].pac_files_detailed == "p/a.rego (+5/-1)"
    assert rows["c6"].commit_message == "msg c6 second line"   # \n -> space (F2)


def test_cochange_a13_a16_a18(micro):
    facts, classified = micro
    tx = {r.commit_id: (r.pac_extensions, r.other_extensions)
          for r in co.cochange_transactions(classified, facts).collect()}
    assert tx == {"c6": ([".rego"], [".py"]), "c4": ([".yaml"], [])}
    ext = co.extension_rows(classified, facts)
    t = co.cochange_totals(ext).collect()[0]
    assert (t.total_commits, t.commits_with_other_files, t.cochange_rate) == (2, 1, 50.0)
    rules = co.association_rules(co.cochange_transactions(classified, facts)).collect()
    assert len(rules) == 1
    r = rules[0]
    assert (r.antecedent, r.consequent, r.support, r.confidence, r.lift) == (".rego", ".py", 1.0, 1.0, 1.0)
    assert (r["count"], r.antecedent_count, r.consequent_count) == (1, 1, 1)


def test_duplicate_paths_q6(spark):
    micro = [(0, "d1", 1, "ann", 10, [("f", 3, 1, 0), ("f", 3, 9, 0)])]
    facts, classified = micro_facts(spark, micro=micro, pac=[(7, "f")])
    rows = classified.collect()
    assert sorted(r.additions for r in rows) == [9, 9]          # last record wins, per occurrence
    assert facts.collect()[0].total_added_lines == 10             # totals sum every record
    assert facts.collect()[0].pac_files_count == 2


def test_pac_list_duplicates_q7(micro):
    _, classified = micro
    assert classified.filter((F.col("commit_id") == "c6") & F.col("is_pac")).count() == 1


def test_no_pac_commit_no_row_q12(spark):
    micro = [(0, "e1", 1, "ann", 10, [("x", 3, 1, 0)])]
    facts, _ = micro_facts(spark, micro=micro, pac=[(7, "other")])
    assert rm.pac_frequency(facts).count() == 0
    assert rm.first_pac_index(facts).collect()[0].first_pac_commit_index == -1
    assert ins.pac_commit_stats(facts).count() == 0


def test_root_commit_rule_p2(spark):
    c, _f, ch, _p, _r = micro_frames(spark)
    rows = {r.commit_id: r for r in cl.root_commit_changes(c, ch).collect()}
    assert (rows["c1"].status, rows["c1"].deletions) == (1, 0)
    assert rows["c6"].status == 3
