"""Quality rules: per-document statistics and cross-document line frequency.  DataFrame functions only.

Lines are normalised (words joined by one space, A-Z lower-cased) and hashed; for each
host the documents holding a line are counted (a line counts once a document).  A line
above both limits -- more than ``min_docs`` documents of its host and more than
``min_share`` of them -- is removed from every document; a document with less than
``min_left`` of its words left is depleted and rejected.

The text is read once.  Statistics and line hashes go to a written table; the counting
shuffles (host, hash) with partial counts only, never text.  The list of frequent lines
is written too, so its size is known when it is joined back.

Repeated 3-word windows are found inside the row without a shuffle: window hashes are
sorted together with their positions, and neighbours compared (n log n in the words).

Defined cases: null text has no words (and fails the base rule); a null host is one host
of its own name ''; each row is a document, repeated rows too; an empty table gives an
empty result; columns not named here are ignored, or carried along by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histofold.llm.common import OWN, SPACES, Scratch, plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is removed when more than so many documents of its host, and so large a share of them, hold it.
MIN_DOCS, MIN_SHARE = 20, 0.001
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3


def _let(value, use):
    """Evaluate ``value`` once and hand it to ``use`` as a variable."""
    return F.transform(F.array(value), use)[0]


def repeated_words(windows):
    """Words inside 3-word windows that occur twice or more; ``windows``: their hashes by position."""
    def found(h, low):
        # the lowest bits of each hash give way to its position; equal prefixes are checked in full
        def same(a, b):
            return (a.bitwiseAND(F.bitwise_not(low)) == b.bitwiseAND(F.bitwise_not(low))) & (
                F.get(h, a.bitwiseAND(low).cast("int")) == F.get(h, b.bitwiseAND(low).cast("int")))

        def starts(s):
            near = lambda x, i, d: F.coalesce(same(x, F.get(s, i + d)), F.lit(False))
            hit = F.filter(s, lambda x, i: near(x, i, F.lit(-1)) | near(x, i, F.lit(1)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(low)))

        mixed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        first = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            _let(F.sort_array(mixed), starts), first,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")),
            lambda a: a["n"])

    size = F.size(windows)
    low = F.expr("shiftleft(1L, CAST(ceil(log2(greatest(size(windows), 2))) AS INT)) - 1L")
    return (F.when((size < 2) | (F.size(F.array_distinct(windows)) == size), F.lit(0).cast("long"))
            .otherwise(_let(low, lambda m: found(windows, m))))


def measure(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
            host_col: str = "source") -> DataFrame:
    """One row per document: row, id, host, statistics, lines (hash, words) in order, and the columns ``keep``."""
    kept = [F.col(c).alias(OWN + c) for c in keep or []]
    text = plain(F.col(text_col))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"), *kept)
    own = [OWN + c for c in keep or []]
    cut = base.select(
        "row", "id", "host", *own,
        F.length(F.regexp_replace("text", f"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split("text", f"[{SPACES}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"))
    n = F.size("words")
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(F.slice(pairs, 1, F.greatest(n - 2, F.lit(0))), F.slice("words", 3, F.greatest(n - 2, F.lit(0))),
                         lambda ab, c: F.xxhash64(ab, c))
    spaced = lambda x: F.translate(F.trim(F.regexp_replace(x, f"[{SPACES}]+", " ")), UPPER, LOWER)
    lines = F.transform(F.transform("lines", spaced), lambda x: F.struct(
        F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    wide = cut.select("row", "id", "host", *own, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
                      (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                      F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
                      lines.alias("lines"))
    return wide.withColumn("n_repeat_words", repeated_words(F.col("windows"))).drop("windows")


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash, n_docs) of the lines above both limits."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = (measured.select("host", F.explode(F.array_distinct("lines.hash")).alias("hash"))
              .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs))
    return (counts.join(hosts, "host").where(F.col("n_docs") > min_share * F.col("host_docs"))
            .select("host", "hash", "n_docs"))


def judge(docs: DataFrame, store: Scratch, keep: list[str] | None = None, min_docs: int = MIN_DOCS,
          min_share: float = MIN_SHARE, min_left: float = MIN_LEFT, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source") -> DataFrame:
    """The measured rows with n_lines_removed, words_left, base_failed, kept, and the hashes removed."""
    measured = store.save(measure(docs, keep, id_col, text_col, host_col), "measured")
    frequent = store.save(frequent_lines(measured, min_docs, min_share), "frequent")
    lines = measured.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.hash", "line.words")
    removed = (lines.join(frequent, ["host", "hash"], "left_semi").groupBy("row")
               .agg(F.sum("words").alias("gone"), F.count(F.lit(1)).alias("n_lines_removed"),
                    F.collect_set("hash").alias("removed")))
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (measured.drop("lines").join(removed, "row", "left")
            .withColumns({"words_left": left, "n_lines_removed": F.coalesce("n_lines_removed", F.lit(0).cast("long"))})
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words"))))


def verdicts(docs: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """One row per document: id, statistics, lines removed, words left, base_failed, kept."""
    out = judge(docs, Scratch(docs.sparkSession, "quality"), id_col=id_col, **limits)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_lines_removed", "words_left")


def cleaned(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The kept documents with frequent lines removed from their text, all columns carried along."""
    out = judge(docs, Scratch(docs.sparkSession, "quality"), keep=docs.columns, text_col=text_col, **options)
    spaced = lambda x: F.translate(F.trim(F.regexp_replace(x, f"[{SPACES}]+", " ")), UPPER, LOWER)
    stay = F.filter(F.split(F.col(OWN + text_col), "\n"),
                    lambda x: ~F.array_contains("removed", F.xxhash64(spaced(x))))
    text = F.when(F.col("removed").isNull(), F.col(OWN + text_col)).otherwise(F.array_join(stay, "\n"))
    return out.where("kept").select(*[(text if c == text_col else F.col(OWN + c)).alias(c) for c in docs.columns])
