"""Hand-checked micro-fixture (FIXTURES.md §2): repository 7 = ``o/r``."""

# (pos, commit, parents, author, date, [(file, status, additions, deletions) | (file, None)])
MICRO = [
    (0, "c6", 1, "amy", 300, [("p/a.rego", 3, 5, 1), ("src/x.py", 3, 10, 0)]),
    (1, "c5", 1, "bob", 200, [("src/x.py", 3, 4, 4)]),
    (2, "c4", 1, "amy", 200, [("p/b.yaml", 4, 0, 0), ("docs/.gitignore", 1, 3, 0)]),
    (3, "c3", 1, "", 200, [("p/a.rego", 2, 0, 7)]),
    (4, "c2", 1, "cat", 100, [("README", 3, 1, 0), ("note.txt", None)]),
    (5, "mm", 2, "eve", 60, [("p/a.rego", 3, 9, 9)]),
    (6, "c1", 0, "dan", 50, [("p/a.rego", 1, 7, 0)]),
]
PAC = [(7, "p/a.rego"), (7, "p/a.rego"), (7, "p/b.yaml"), (8, "src/x.py")]


def micro_frames(spark, micro=MICRO, pac=PAC, repo_id=7, full_name="o/r"):
    commits, files, changes = [], [], []
    for pos, cid, parents, author, date, fl in micro:
        commits.append((repo_id, cid, author, f"msg {cid}\nsecond line", date, parents, pos))
        for i, rec in enumerate(fl):
            files.append((cid, rec[0], i))
            if rec[1] is not None or len(rec) == 4:
                if len(rec) == 4:
                    changes.append((cid, i, rec[0], rec[2], rec[3], rec[1]))
    c = spark.createDataFrame(commits, "repo_id long, commit_id string, author string, message string, "
                                       "date long, parent_count int, pos int")
    f = spark.createDataFrame(files, "commit_id string, file string, pos int")
    ch = spark.createDataFrame(changes, "commit_id string, pos int, file string, additions int, "
                                        "deletions int, status int")
    p = spark.createDataFrame(pac, "repo_id long, path string")
    r = spark.createDataFrame([(repo_id, full_name, 1, "c1", "c6")],
                              "repo_id long, full_name string, idx int, sha string, head_sha string")
    return c, f, ch, p, r


def micro_facts(spark, **kw):
    from histofold.operators import classify as cl
    c, f, ch, p, r = micro_frames(spark, **kw)
    classified = cl.classify_changes(c, f, ch, p)
    return cl.commit_fold(c, classified, ch, r), classified
