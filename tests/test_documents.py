"""Result documents: written commit by commit, read back split into commits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fixtures import micro_frames
from histofold.operators import classify as cl
from histofold.plans import jobs
from histofold.sources import catalog as cat
from histofold.sources import documents as docs
from histofold.sources import history as hist
from histofold.sources import results as res


def _results(spark, tmp_path):
    c, f, ch, p, r = micro_frames(spark)
    fork = c.filter("commit_id IN ('c5', 'c6')").withColumn("repo_id", F.lit(8).cast("long"))
    cat.write_repo_catalog(r.unionByName(spark.createDataFrame([(8, "a b/re:x", 2, "c6", "c6")], r.schema)), str(tmp_path / "catalog"))
    cat.write_pac_files(p, str(tmp_path / "pac"))
    hist.write_history(hist.export_history(c.unionByName(fork).withColumn("message", F.concat("message", F.lit(' "é\\'))), f, ch),
                       str(tmp_path / "history"))
    jobs.collect(spark, str(tmp_path / "catalog"), str(tmp_path / "pac"), str(tmp_path / "history"), str(tmp_path / "out"))
    return str(tmp_path / "out")


def _same(a, b, *cols):
    assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect())) and a.count() > 0


FACTS = ["repo_id", "project_name", "commit_id", "author", "message", "date", "pac_files_count", "other_files_count", "pac_added_lines",
         "pac_deleted_lines", "total_added_lines", "total_deleted_lines", "has_pac_changes"]
CLASSIFIED = ["repo_id", "commit_id", "file", "is_pac", "additions", "deletions", "total_changes", "status"]


def test_written_documents_read_back(spark, tmp_path):
    out, root = _results(spark, tmp_path), tmp_path / "outputs"
    jobs.export_documents(spark, out, str(root))
    jobs.export_documents(spark, out, str(root))   # a second run replaces whole files
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == ["a_b/re_x.json", "o/r.json"]
    doc = json.loads((root / "o" / "r.json").read_text(encoding="utf-8"))
    assert set(doc) == {"metadata", "repositories"} and doc["metadata"]["analysis_duration"] >= 0
    (repo,) = doc["repositories"]
    assert [c["commit_id"] for c in repo["commits"]] == ["c6", "c5", "c4", "c3", "c2", "c1"]
    assert (repo["repository_id"], repo["owner_name"], repo["repository_name"], repo["total_commits"]) == (7, "o", "r", 6)
    assert repo["commits"][0]["files"] == ["p/a.rego", "src/x.py"] and repo["commits"][0]["message"].endswith(' "é\\')
    assert repo["commits"][0]["pac_changes"] == [{"file": "p/a.rego", "additions": 5, "deletions": 1, "total_changes": 6, "status": 3}]
    facts, classified = jobs.load_results(spark, out)
    for load, path in ((jobs.load_documents, str(root / "*")), (jobs.load_large_documents, str(root))):
        got_facts, got_classified = load(spark, path)
        _same(facts, got_facts, *FACTS)
        _same(classified, got_classified, *CLASSIFIED)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_split_while_reading(tmp_path, monkeypatch, chunk):
    """Any chunk size gives the rows of the whole document; names may follow the commits."""
    monkeypatch.setattr(docs, "CHUNK", chunk)
    rng = random.Random(1)
    commits = [{"commit_id": f"é{k}", "date": rng.choice([None, 12345678901, -1]), "author": 'q"\\u00e9', "files": ["a", "b]}"],
                "pac_changes": [{"file": "f", "additions": k}], "has_pac_changes": True, "extra": {"x": [1, {"y": "]"}]}} for k in range(9)]
    doc = {"metadata": {"commits": [1]}, "repositories": [
        {"commits": commits[:5], "repository_id": 12, "project_name": "o/late"}, {"repository_id": 3, "commits": commits[5:]},
        {"repository_id": 4, "commits": []}, {"commits": None}], "more": 1.5}
    for k, indent in enumerate((None, 2)):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(k)), encoding="utf-8")
        rows = [r for _, r in docs.commit_rows(str(tmp_path / f"{k}.json"))]
        assert [(r["repository_id"], r["project_name"], r["pos"], r["commit_id"]) for r in rows] == [
            *((12, "o/late", n, f"é{n}") for n in range(5)), *((3, None, n, f"é{n + 5}") for n in range(4))]
        assert [r["date"] for r in rows] == [c["date"] for c in commits] and rows[8]["pac_changes"][0]["additions"] == 8
    text = json.dumps(doc)
    for broken in (text[:-1], text + "x", text.replace('"commits": [{', '"commits": [,{', 1), "", "[1]", '{"repositories": 5}'):
        (tmp_path / "bad.json").write_text(broken)
        (only,) = [r for _, r in docs.commit_rows(str(tmp_path / "bad.json"))]
        assert only["error"] and "commit_id" not in only


def test_documents_against_the_whole_reader(spark, tmp_path):
    d = tmp_path / "outputs" / "o"
    d.mkdir(parents=True)
    for k in range(3):
        repo = {"repository_id": k, "commits": [{"commit_id": f"c{n}", "author": None, "date": n, "pac_added_lines": 2, "files": ["x"],
                                                 "other_changes": [{"file": "x", "additions": 1, "status": 3}]} for n in range(40 * k)]}
        (d / f"r{k}.json").write_text(json.dumps({"repositories": [repo] if k else []}))
    (d / "bad.json").write_text('{"repositories": [{"commits": [{"commit_id": "lost"}')
    want, got = jobs.load_documents(spark, str(d)), jobs.load_large_documents(spark, str(d))
    _same(want[0], got[0], *FACTS, "pos")
    _same(want[1], got[1], *CLASSIFIED, "pos")
    errors = docs.read_documents(spark, str(d)).filter("error IS NOT NULL").collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in errors] == ["bad.json"]


def test_memory_is_bounded_by_a_commit(tmp_path):
    """A document of 60 MB is read with a small part of that."""
    import tracemalloc
    with open(tmp_path / "big.json", "w") as f:
        f.write('{"repositories": [{"repository_id": 1, "commits": [')
        f.write(", ".join(json.dumps({"commit_id": f"c{k}", "message": "m" * 3000}) for k in range(20_000)))
        f.write("]}]}")
    tracemalloc.start()
    assert sum(1 for _ in docs.commit_rows(str(tmp_path / "big.json"))) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 12e6
    tracemalloc.stop()


def test_packed_documents_hold_the_bytes_of_plain_ones(spark, tmp_path, monkeypatch):
    """Blocks and pieces of any size give one JSON document, its commits in order, with a commit larger than a piece."""
    import gzip

    def commit(doc, n):
        return (f"o/{doc}.json", n, json.dumps({"commit_id": f"c{n}", "message": "é" * (300 if n == 7 else n % 5)}, ensure_ascii=False))

    heads = [(f"o/{d}.json", -1, f'{{"repositories": [\n{{"repository_id": {d}, "commits": [\n') for d in range(3)]
    listed = {0: [], 1: [3], 2: [n for n in range(60) if n % 4]}
    rows = spark.createDataFrame([commit(d, n) for d in listed for n in listed[d]] + heads, "document string, ord long, body string").repartition(5)
    plain = {}
    for k, (block, size) in enumerate(((1_024, 1 << 20), (8, 100), (1, 1))):
        monkeypatch.setattr(docs, "BLOCK_COMMITS", block)
        monkeypatch.setattr(docs, "PIECE_BYTES", size)
        for packed in (False, True):
            root = tmp_path / f"{k}{packed}"
            docs.write_documents(rows, str(root), packed=packed)
            suffix = ".json.gz" if packed else ".json"
            assert sorted(p.name for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == [f"{d}{suffix}" for d in range(3)]
            for d in range(3):
                text = (root / "o" / f"{d}{suffix}").read_bytes()
                text = gzip.decompress(text) if packed else text
                assert plain.setdefault(d, text) == text
                assert [c["commit_id"] for c in json.loads(text)["repositories"][0]["commits"]] == [f"c{n}" for n in listed[d]]
            got = docs.read_documents(spark, str(root)).filter("error IS NULL").orderBy("repository_id", "pos").collect()
            assert [(r.repository_id, r.pos, r.commit_id) for r in got] == [(d, i, f"c{n}") for d in listed for i, n in enumerate(listed[d])]


def test_broken_packed_documents_give_their_error(tmp_path):
    import gzip
    whole = gzip.compress(json.dumps({"repositories": [{"commits": [{"commit_id": f"c{k}", "message": str(k) * 50} for k in range(500)]}]}).encode())
    for name, data in (("cut", whole[:-20]), ("other", b"no gzip"), ("flipped", whole[:400] + bytes(b ^ 255 for b in whole[400:440]) + whole[440:])):
        (tmp_path / f"{name}.json.gz").write_bytes(data)
        (only,) = [r for _, r in docs.commit_rows(str(tmp_path / f"{name}.json.gz"))]
        assert only["error"] and "commit_id" not in only
    (tmp_path / "whole.json.gz").write_bytes(whole)
    assert len([r for _, r in docs.commit_rows(str(tmp_path / "whole.json.gz"))]) == 500
