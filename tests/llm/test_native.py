"""Exact dedup, quality rules, URL lists and chat formatting against brute force."""

import datetime as dt
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from histofold.llm import chat, exact_dedup, quality, url_filter

from .helpers import AWKWARD, DOCS, IDS, LONG, docs, prose

SPACE = re.compile(r"[\x20\x09-\x0D]")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Arrow|Pandas", plan)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, g in groups.items():
        best = min(g)
        kept = False
        for m in sorted(g):
            out.append((m[3], best[3], len(g), m[:3] == best[:3] and not kept, hashlib.sha256(norm.encode()).hexdigest()))
            kept |= m[:3] == best[:3]
    return Counter(out)


def test_exact_verdicts(spark):
    out = exact_dedup.verdicts(docs(spark, AWKWARD, IDS))
    assert no_python(out)
    assert Counter(tuple(r) for r in out.collect()) == brute_exact(zip(IDS, AWKWARD))


def test_exact_hash_collision_is_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    out = {r["doc_id"]: r for r in exact_dedup.verdicts(docs(spark, ["a b", "ab", "c"])).collect()}
    assert [out[k]["keep_id"] for k in range(3)] == [0, 0, 2] and out[2]["group_size"] == 1


def test_exact_distinct_keeps_one_row_and_columns(spark):
    given = docs(spark, AWKWARD + ["one"], IDS + [7])
    kept = exact_dedup.distinct(given)
    assert kept.columns == given.columns
    rows = kept.collect()
    texts = Counter(SPACE.sub("", r["text"] or "") for r in rows)
    assert set(texts.values()) == {1} and len(texts) == len({SPACE.sub("", t or "") for t in AWKWARD})
    assert exact_dedup.distinct(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup.verdicts(spark.createDataFrame([], DOCS)).count() == 0


def brute_quality(texts):
    out = []
    for t in texts:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    return out


def test_quality_statistics(spark):
    texts = AWKWARD + ["a b c a b c a b", "a a a a", "x #$% <y>\nline\nline \nline\n\nline", "the end " * 30]
    ids = list(range(len(texts)))
    out = quality.verdicts(docs(spark, texts, ids))
    assert no_python(out)
    got = {r["doc_id"]: tuple(r)[1:6] for r in out.collect()}
    assert [got[i] for i in ids] == brute_quality(texts)
    assert quality.verdicts(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_frequent_lines(spark):
    boiler = "Shared   Banner line of this HOST"
    texts = [f"{boiler.upper() if k % 2 else boiler}\n{prose(k + 50, 60)}" for k in range(30)]
    texts += [f"{boiler}\n{boiler}\nown words {k}" for k in range(3)]
    given = docs(spark, texts).drop("source").withColumn("source", quality.F.lit("host"))
    rows = {r["doc_id"]: r for r in quality.verdicts(given, min_docs=20).collect()}
    assert all(rows[k]["kept"] and rows[k]["n_lines_removed"] == 1 and rows[k]["words_left"] == 60 for k in range(30))
    assert all(not rows[k]["kept"] for k in range(30, 33))
    clean = {r["doc_id"]: r["text"] for r in quality.cleaned(given, min_docs=20).collect()}
    assert set(clean) == set(range(30)) and clean[4] == prose(54, 60)
    assert all(r["n_lines_removed"] == 0 for r in quality.verdicts(given, min_docs=33).collect())


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute_urls(captures, events):
    state = defaultdict(dict)
    for name, pattern, time, active in events:
        if None not in (name, pattern, time, active):
            state[name, pattern.lower().rstrip(".")][time] = state[name, pattern.lower().rstrip(".")].get(time, False) or active
    out = []
    for url, at in captures:
        m = re.match(r"[A-Za-z][\w+.-]*://([^/?#\\]*)", url or "")
        host = re.sub(r"(:\d*)?$|\.(:\d*)?$", "", re.sub(r"^.*@", "", m[1]), count=1).lower() if m else ""
        seg = re.match(r"[A-Za-z][\w+.-]*://[^/?#]*/([^/?#]+)", url or "")
        labels = host.split(".")
        keys = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))] if host else []
        keys += [f"{k}/{seg[1]}" for k in keys] if seg else []
        hit = []
        for (name, pattern), changes in state.items():
            past = [t for t in changes if at is not None and t <= at]
            if pattern in keys and past and changes[max(past)]:
                hit.append((len(pattern), pattern, name))
        out.append((url, at, bool(hit), len({h[2] for h in hit}), tuple(sorted({h[2] for h in hit})), max(hit)[1] if hit else None))
    return Counter(out)


def test_url_lists(spark):
    events = [("ads", "example.com", day(3), True), ("ads", "example.com", day(9), False), ("ads", "example.com", day(9), True),
              ("ads", "example.com", day(20), False), ("bad", "Sub.Example.com.", day(5), True), ("bad", "x.org/en", day(0), True),
              ("bad", None, day(0), True), (None, "x.org", day(0), True), ("bad", "y.org", None, True), ("bad", "z.org", day(1), None)]
    urls = [None, "", "not a url", "http://example.com", "https://user@Sub.example.com:80/en/a?q#f", "http://a.b.sub.example.com./en",
            "https://x.org/en/1", "https://x.org/fr", "http://localhost/x", "ftp://x.org/en"]
    captures = [(u, at) for u in urls for at in (None, day(0), day(3), day(8), day(9), day(19), day(20), day(400))]
    captures += captures[:20]
    e = spark.createDataFrame(events, "list string, pattern string, time date, active boolean")
    c = spark.createDataFrame([(u, t, "x") for u, t in captures], "url string, fetched date, list string")
    got = url_filter.judge(c, e)
    assert no_python(got)
    rows = Counter((r["url"], r["fetched"], r["blocked"], r["n_lists"], tuple(r["lists"]), r["matched"])
                   for r in got.drop("list").withColumnRenamed("lists", "lists").collect())
    assert rows == brute_urls(captures, events)
    assert url_filter.judge(c.limit(0), e).count() == 0 and not any(r["blocked"] for r in url_filter.judge(c, e.limit(0)).collect())


def render(turns):
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)


def test_preferences(spark):
    talks = {1: [("system", "s"), ("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "long answer")],
             2: [("system", "s"), ("user", "hi"), ("assistant", "no")], 3: [("system", "s"), ("user", "hi"), ("assistant", "yes")],
             4: [("user", "")], 5: [("assistant", LONG)]}
    rows = [(c, k, r, t, "x") for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "x"), (6, 0, None, None, "x")]
    talks[6] = [("user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen string")
    pairs = [(1, 2), (1, 3), (3, 1), (2, 2), (4, 6), (5, 1), (1, 99), (98, 99), (1, 2)]
    out = chat.preferences(turns, spark.createDataFrame(pairs, "chosen long, rejected long"))
    assert no_python(out)
    got = Counter((r["chosen_id"], r["rejected_id"], r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"],
                   tuple(r["chosen"][a:b] for a, b in r["chosen_mask"]), tuple(r["rejected"][a:b] for a, b in r["rejected_mask"]))
                  for r in out.collect())
    want = Counter()
    for a, b in pairs:
        x, y = talks.get(a, []), talks.get(b, [])
        k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        own = lambda z: tuple(t for r, t in z[k:] if r == "assistant")  # noqa: E731, B023
        want[a, b, k, render(x[:k]), render(x[k:]), render(y[k:]), own(x), own(y)] += 1
    assert got == want


@pytest.mark.parametrize("empty", ["turns", "pairs"])
def test_preferences_of_empty_tables(spark, empty):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 1)], "chosen long, rejected long")
    out = chat.preferences(turns.limit(0) if empty == "turns" else turns, pairs.limit(0) if empty == "pairs" else pairs).collect()
    assert len(out) == (1 if empty == "turns" else 0) and all(r["chosen"] == "" for r in out)
