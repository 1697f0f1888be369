
import pytest
from pyspark.sql import functions as F

from fixtures import micro_facts
from histofold.operators import cochange as co
from histofold.operators import coverage as cov
from histofold.operators import inspection as ins
from histofold.operators import repo_metrics as rm
from histofold.plans.context import context
from histofold.sources import results as res

SF = "/root/testdata/sf0.001"


def test_missing_date_sorts_first_q10(spark):
    # c_null has no date: it sorts as 0, before the PaC commit at 5 -> index 1.
    micro = [(0, "late", 1, "a", 9, [("p.rego", 3, 1, 0)]),
             (1, "pac", 1, "a", 5, [("p.rego", 3, 1, 0)]),
             (2, "c_null", 1, "b", None, [("x.py", 3, 1, 0)])]
    facts, _ = micro_facts(spark, micro=micro, pac=[(7, "p.rego")])
    r = rm.pac_frequency(facts).collect()[0]
    assert (r.first_pac_commit_index, r.total_commits, r.pac_commits) == (1, 2, 2)


def test_empty_medians_are_zero_q13(spark):
    micro = [(0, "p1", 1, "a", 5, [("p.rego", 3, 2, 1)])]
    facts, _ = micro_facts(spark, micro=micro, pac=[(7, "p.rego")])
    r = rm.commit_size_medians(facts).collect()[0]
    assert (r.non_pac_commits_count, r.non_pac_commit_median_size) == (0, 0.0)
    c = rm.code_change_sizes(facts).collect()[0]
    assert (c.non_pac_only_commits_count, c.non_pac_only_median_changes, c.non_pac_only_changes_max) == (0, 0.0, 0)


def test_change_ratio_may_exceed_one_q16(spark):
    micro = [(0, "p1", 1, "a", 5, [("a.rego", 3, 1, 0), ("b.rego", 3, 1, 0)])]
    facts, _ = micro_facts(spark, micro=micro, pac=[(7, "a.rego"), (7, "b.rego")])
    assert rm.repo_fold(facts).collect()[0].pac_change_ratio == 2.0


def test_corpus_medians_skip_zero_q17(spark):
    a = [(0, "a1", 1, "x", 5, [("p.rego", 3, 2, 0)])]                             # non-PaC medians 0
    b = [(0, "b1", 1, "y", 5, [("p.rego", 3, 4, 0), ("q.py", 3, 6, 0)]),
         (1, "b0", 1, "y", 6, [("q.py", 3, 8, 0)])]
    fa, _ = micro_facts(spark, micro=a, pac=[(1, "p.rego")], repo_id=1, full_name="o/a")
    fb, _ = micro_facts(spark, micro=b, pac=[(2, "p.rego")], repo_id=2, full_name="o/b")
    m = rm.corpus_medians(fa.unionByName(fb)).collect()[0]
    assert m.median_pac_code_changes == 3.0           # (2 + 4) / 2: zeros not dropped here
    assert m.median_non_pac_code_changes == 6.0       # only repo b (a has 0)
    assert m.median_non_pac_only_changes == 8.0


def test_coverage_fraction_q18(spark):
    repos = spark.createDataFrame([("a/x", 1), ("a/y", 2), ("b/z", 3), ("b/w", 4)], "full_name string, idx int")
    done = spark.createDataFrame([("a/x",)], "full_name string")
    s = cov.coverage_summary(repos, done).collect()[0]
    assert (s.collected_fraction, s.missed_fraction) == (0.25, 0.75)


def _tx(spark, n_pairs, n_other_only):
    rows = [(f"c{i}", [".rego"], [".py"]) for i in range(n_pairs)]
    rows += [(f"d{i}", [".yaml"], [".md"]) for i in range(n_other_only)]
    return spark.createDataFrame(rows, "commit_id string, pac_extensions array<string>, other_extensions array<string>")


def test_support_floor_in_double_q19(spark):
    # n = 100: int(0.29 * 100) = 28 in double arithmetic (29 with decimal literals).
    tx = _tx(spark, 28, 72)
    rules = {(r.antecedent, r.consequent) for r in co.association_rules(tx, 0.29, 0.0).collect()}
    assert (".rego", ".py") in rules
    # small n: floor(0.01 * 3) = 0 -> every pair passes the support test
    assert co.association_rules(_tx(spark, 1, 2), 0.01, 0.0).count() == 2


def test_full_name_without_slash_q25(spark):
    df = spark.createDataFrame([("noslash",)], "project_name string")
    r = rm.split_full_name(df).collect()[0]
    assert (r.owner_name, r.repository_name) == (None, None)
    with pytest.raises(Exception):
        df.select(res.output_file_name(F.lit(""), F.lit("x"))).collect()


# ---------------------------------------------------------------- properties
@pytest.fixture(scope="module")
def ctx(spark):
    return context(spark, SF)


def test_partition_of_touched_files(ctx):
    """Touched files = kept (classified) + dropped by status + PaC files without a record."""
    from histofold.operators import classify as cl
    h = ctx.h
    live = cl.drop_merges(h.commit_keys).select("commit_id", "repo_id", "parent_count")
    touched = cl.pac_membership(h.files.join(live, "commit_id"), h.pac_files)
    j = touched.join(cl.last_change(h.changes), ["commit_id", "file"], "left")
    # dropped: added / deleted records, and every record of a root commit
    dropped = j.filter(F.col("status").isin(1, 2)
                       | ((F.col("parent_count") == 0) & F.col("has_info").isNotNull())).count()
    pac_no_record = j.filter(F.col("is_pac") & F.col("has_info").isNull()).count()
    assert ctx.classified.count() + dropped + pac_no_record == touched.count()


def test_first_index_stable_under_repartitioning(ctx):
    a = {r.repo_id: r.first_pac_commit_index for r in rm.first_pac_index(ctx.facts).collect()}
    b = {r.repo_id: r.first_pac_commit_index
         for r in rm.first_pac_index(ctx.facts.repartition(7, "commit_id")).collect()}
    assert a == b


def test_sample_subset_exact_size_idempotent(ctx):
    rows = ins.inspection_rows(ctx.facts, ctx.classified)
    n = rows.count()
    k = min(10, n)
    s1 = {r.commit_sha for r in ins.seeded_sample(ctx.facts, ctx.classified, k).collect()}
    s2 = {r.commit_sha for r in ins.seeded_sample(ctx.facts.repartition(5), ctx.classified, k).collect()}
    assert len(s1) == k and s1 == s2
    assert s1 <= {r.commit_sha for r in rows.collect()}
    assert ins.seeded_sample(ctx.facts, ctx.classified, n + 5).count() == n       # size >= rows -> all rows


def test_rule_bounds(ctx):
    tx = co.cochange_transactions(ctx.classified, ctx.facts)
    for r in co.association_rules(tx, 0.0, 0.0).collect():
        assert 0 <= r.confidence <= 1
        assert r.support <= r.confidence


def test_repository_without_commits_is_diagnosed(spark):
    from fixtures import micro_frames
    from histofold.operators import classify as cl
    c, _f, _ch, _p, r = micro_frames(spark)
    extra = spark.createDataFrame([(9, "o/empty", 2, "x", "y")], r.schema)
    merges_only = c.filter("commit_id = 'mm'").withColumn("repo_id", F.lit(9).cast("long"))
    d = cl.collection_diagnostics(r.unionByName(extra), c.unionByName(merges_only)).collect()
    assert [(x.repo_id, x.reason) for x in d] == [(9, "No commits found")]


def test_survey_probe_counts(spark):
    ctx = context(spark, "/root/testdata/sf0.01")
    assert ctx.facts.count() == 12022
    assert ctx.facts.filter("has_pac_changes").count() == 3328
    assert ctx.classified.filter("is_pac").count() == 3953
    assert ctx.classified.filter("NOT is_pac").count() == 30752
    tx = co.cochange_transactions(ctx.classified, ctx.facts)
    assert tx.filter(F.size("other_extensions") > 0).count() == 3052
    assert co.association_rules(tx).count() == 25
    main = co.association_rules(tx, co.MAIN_MIN_SUPPORT, co.MAIN_MIN_CONFIDENCE)
    assert main.count() == 0
    assert co.association_rules(tx, 0.0, 0.0).agg(F.max("confidence")).first()[0] == pytest.approx(0.625, abs=5e-4)


def test_report_views_round_only_for_display(spark):
    from histofold.operators import reports
    med = spark.createDataFrame([(66.666666, 2.0, 3.0, 100.0, 1.0, 1.0, 9.5, 7.0, 6.0, 6.5, None, 1, 0)],
                                "median_pac_maintenance_frequency double, median_pac_commits double, "
                                "median_total_commits double, median_pac_maintainer_percentage double, "
                                "median_pac_authors double, median_total_authors double, "
                                "median_pac_commit_size double, median_non_pac_commit_size double, "
                                "median_pac_code_changes double, median_non_pac_code_changes double, "
                                "median_non_pac_only_changes double, repos_with_pac_changes long, "
                                "repos_with_non_pac_only long")
    rows = {r.label: r.value for r in reports.corpus_medians_report(med).collect()}
    assert rows["Median freq"] == "66.67%"
    assert rows["Median (PAC commits)"] == f"{9.5:.0f}"   # "10": half-even like Python
    assert rows["Median PAC code changes (in PAC commits)"] == f"{6.0:.0f}"
    assert rows["Median non-PAC code changes (in PAC commits)"] == f"{6.5:.0f}"   # "6", not "7"
    assert rows["Median non-PAC code changes (in non-PAC commits)"] == "nan"
    assert rows["Total repos with PAC changes"] == "1"


def test_suffix_lookup_edges_j7(spark):
    repos = spark.createDataFrame([(5, "a/tool", 2), (6, "b/tool", 1), (7, "c/other", 3)],
                                  "repo_id int, full_name string, idx int")
    names = spark.createDataFrame([("tool",), ("",), ("TOOL",), ("/other",)], "name string")
    got = {r.name: (r.repo_id, r.idx) for r in cov.suffix_lookup(names, repos).collect()}
    assert got["tool"] == (6, 1)        # first catalog row (lowest idx) wins
    assert got[""] == (6, 1)            # every name ends with the empty string
    assert got["TOOL"] == (None, None)  # case-sensitive
    assert got["/other"] == (7, 3)


def test_rare_extensions_make_no_pairs(spark):
    """One commit of 4,000 extensions on each side beside frequent ones: pairs are made of frequent items only."""
    wide = ([f".p{k}" for k in range(4000)] + [".rego"], [f".o{k}" for k in range(4000)] + [".py"])
    rows = [([".rego"], [".py", ".md"])] * 30 + [([".rego", ".yaml"], [".py"])] * 20 + [([".yaml"], [".rare"])] + [wide]
    tx = spark.createDataFrame([("r", str(k), sorted(p), sorted(o)) for k, (p, o) in enumerate(rows)],
                               "repo_id string, commit_id string, pac_extensions array<string>, other_extensions array<string>")
    n, least = len(rows), int(0.2 * len(rows))
    count = {}
    for p, o in rows:
        for a in p:
            count["p", a] = count.get(("p", a), 0) + 1
        for b in o:
            count["o", b] = count.get(("o", b), 0) + 1
    want = set()
    for a in (".rego", ".yaml"):
        for b in (".py", ".md", ".rare"):
            both = sum(a in p and b in o for p, o in rows)
            if both >= least and both / count["p", a] >= 0.1:
                want.add((a, b, both, count["p", a], count["o", b]))
    got = {(r.antecedent, r.consequent, r["count"], r.antecedent_count, r.consequent_count)
           for r in co.association_rules(tx, 0.2, 0.1).collect()}
    assert got == want and len(want) == 3
    sig = co.signatures(tx)
    ant = spark.createDataFrame([(".rego",), (".yaml",)], "antecedent string")
    con = spark.createDataFrame([(".py",), (".md",)], "consequent string")
    pruned = co.frequent_signatures(sig, ant, con, F.lit(least))
    assert pruned.agg(F.sum(F.size("pac_extensions") * F.size("other_extensions"))).first()[0] <= 5
    # a threshold of nothing prunes nothing
    assert co.association_rules(tx.filter(F.size("pac_extensions") < 9), 0.0, 0.0).count() == 4
