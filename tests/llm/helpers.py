"""Small tables with the awkward cases every operator defines."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use inside
    T.StructField("id", T.StringType()), T.StructField("row", T.StringType()), T.StructField("hash", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("n", T.StringType()), T.StructField("size", T.StringType())])

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi "
         "psi omega").split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        word = WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)]
        out.append(word + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 2}", None if t is None else len(t), "x", "y", "z", "k", "n", "s")
            for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


LONG = prose(3, 40_000)
AWKWARD = [None, "", "  \n\t ", "one", "one", prose(1, 80), prose(1, 80), prose(1, 80).upper(), prose(1, 78) + " changed words",
           prose(2, 200), "Ünï cödé — 漢字 \U0001F600 text", LONG, "a\n\na\n\nb\n", "x" * 3000]
IDS = [5, 4, None, 7, 7, 9, 8, 10, 11, 12, 13, 14, 15, 16]
