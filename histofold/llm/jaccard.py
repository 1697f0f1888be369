"""N-gram Jaccard join: grouped prefix join over 5-word shingles, exact at 0.75.

1. A document's set is its distinct shingle hashes, counted on 64 bits and written once with 48
   (two sets of 500 shingles share a hash by chance once in a billion pairs).
2. Shingles get a global order, rare ones first: a fixed-size table of hash slots holds
   their document frequency over the whole table, in eighths of a power of two (shingles that
   share a slot are counted together).  The order decides speed only, never results.
3. The prefix of a set of n shingles is its first n - ceil(0.75 n) + 1: linked documents
   share a shingle of their prefixes.  Documents with the same prefix and size form one
   *group*; only groups enter the prefix join.  Equal sets inside a group are one *class*.
4. A first round verifies each group against one hub of each shared prefix shingle -- the
   group that has the fewest rarer shingles before it, so the likeliest to link with the
   others -- and joins the linked classes to components.  Large clusters of near copies
   collapse here with a number of pairs linear in their prefix entries.
5. The exact round looks only at shingles whose groups lie in different components: group
   pairs are filtered by size and by position in the prefix, expanded to their classes, ruled
   out where the parity sketches differ in more bits than linked sets can differ in shingles,
   and verified on the whole sets.  Pairs inside one component need no comparison, so no
   link between components is lost, and no pairs inside a cluster are emitted.
6. Components over all links, smallest document id each.

Skew: shingles are counted with map-side partial sums and joined back, never gathered by
key into one task; copies are one class however many they are.

Defined cases: null text or one without words has an empty set, and is linked with nothing
(its component is its own id); fewer than five words are one shingle of the whole
sequence; null ids take part but never name a component that has another id; repeated rows
are copies; an empty table gives an empty result; other columns are ignored by ``linked``
and carried along by ``representatives``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histofold.llm.common import OWN, Scratch, plain, ship
from histofold.llm.components import components

WORDS = 5
#: Similarity as a fraction.
NUM, DEN = 75, 100
#: Slots of the frequency table (one byte each when sent to the tasks).
SLOTS = 1 << 22
#: Bytes of a stored shingle hash (sizes are counted on all 64 bits).
WIDTH = 6
#: Bits of the parity sketch that rules pairs out before whole sets are moved.
BITS = 4096
#: Parts of that table that are summed apart.
RANGES = 64
#: Shingles counted together.
WINDOW = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased, words split at ASCII white space)."""
    import xxhash

    of = xxhash.xxh3_64_intdigest
    own = text.encode("utf-8", "replace").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) < words:
        return np.array([of(b" ".join(own), seed=len(own))], np.uint64)
    h = np.fromiter(map(of, own), np.uint64, len(own))
    last = len(h) - words + 1
    out = np.zeros(last, np.uint64)
    for j in range(words):
        out = _mix(out + h[j:j + last] + np.uint64(j + 1))
    return np.unique(out)


def stored(s: np.ndarray) -> bytes:
    """The low ``WIDTH`` bytes of each hash, sorted and distinct."""
    low = np.unique(s & np.uint64((1 << 8 * WIDTH) - 1)).astype("<u8")
    return low.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def loaded(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _digest(*parts: bytes) -> bytes:
    import xxhash

    h = xxhash.xxh3_128()
    for p in parts:
        h.update(p)
    return h.digest()


def needed(n: int) -> int:
    """Shingles of the prefix of a set of n: n - ceil(0.75 n) + 1."""
    return n - -(-NUM * n // DEN) + 1


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, key, n, sig, shingles): the set of every document, as ``stored``.

    ``key`` is the md5 of the text, by which rows can be found again in the documents.
    """
    ship(docs.sparkSession)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                         plain(F.col(text_col)).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                row, ident, text = batch.slice(at, 512).columns
                found = [shingles(t.as_py()) for t in text]
                raw = [stored(s) for s in found]
                key = pa.array([hashlib.md5(t.as_py().encode("utf-8", "replace")).digest() for t in text], pa.binary())
                yield _batch(row=row, id=ident, key=key, n=pa.array([len(s) for s in found], pa.int64()),
                             sig=pa.array([_digest(r) for r in raw], pa.binary()), shingles=pa.array(raw, pa.binary()))

    return source.mapInArrow(run, f"row long, id {id_type}, key binary, n long, sig binary, shingles binary")


def levels(found: DataFrame) -> np.ndarray:
    """Document frequency by hash slot over the whole table, in eighths of a power of two.

    Each task counts into an array of ``SLOTS`` and hands it on in ``RANGES`` compressed parts, which are summed
    by range; what reaches the driver is one byte a slot.
    """
    slots, width = SLOTS, SLOTS // RANGES

    def counted(batches):
        import zstandard

        total, held, size = np.zeros(slots, np.uint32), [], 0

        def add():
            np.add.at(total, (np.concatenate(held) & np.uint64(slots - 1)).astype(np.int64), 1)

        for batch in batches:
            for raw in batch.column(0):
                held.append(loaded(raw.as_py()))
                size += len(held[-1])
                if size >= WINDOW:
                    add()
                    held, size = [], 0
        if held:
            add()
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(RANGES):
            part = total[k * width:(k + 1) * width]
            if part.any():
                # small counts in few bytes: most parts need one byte a slot
                kind = next(t for t in (np.uint8, np.uint16, np.uint32) if part.max() <= np.iinfo(t).max)
                yield _batch(range=pa.array([k], pa.int32()), size=pa.array([np.dtype(kind).itemsize], pa.int32()),
                             counts=pa.array([pack(part.astype(kind).tobytes())], pa.binary()))

    def summed(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = {}
        for batch in batches:
            for k, size, counts in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(unpack(counts), f"<u{size}")
                total[k] = total[k] + part if k in total else part.astype(np.uint64)
        for k, part in total.items():
            level = np.minimum(255, np.floor(8 * np.log2(np.maximum(part, 1).astype(float)))).astype(np.uint8)
            yield _batch(range=pa.array([k], pa.int32()), levels=pa.array([level.tobytes()], pa.binary()))

    rows = (found.select("shingles").mapInArrow(counted, "range int, size int, counts binary")
            .repartition(RANGES, "range").mapInArrow(summed, "range int, levels binary"))
    table = np.zeros(slots, np.uint8)
    for r in rows.collect():  # RANGES rows, SLOTS bytes in all
        table[r["range"] * width:(r["range"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return table


def _ordered(raw: bytes, level: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The prefix of a set in the global order (level, hash), or the part of it that is asked for."""
    s = loaded(raw)
    order = np.argsort(level[(s & np.uint64(len(level) - 1)).astype(np.int64)], kind="stable")
    return s[order[start:needed(len(s)) if stop is None else stop]]


def _behind(raw: bytes, level: np.ndarray) -> np.ndarray:
    """The shingles behind the prefix of which two linked sets of one size and one prefix share one: they share
    2 * 0.75 / 1.75 of their size, all of the prefix, so the rest of it among the others."""
    n = len(raw) // WIDTH
    return _ordered(raw, level, needed(n), n - -(-2 * NUM * n // (NUM + DEN)) + needed(n) + 1)


def grouped(found: DataFrame, level, store: Scratch) -> DataFrame:
    """(row, id, n, class, group): class and group named by their smallest row."""
    def run(batches):
        table = level.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                row, ident, key, n, sig, raw = batch.slice(at, 1024).columns
                prefix = [_digest(_ordered(r.as_py(), table).tobytes(), str(k.as_py()).encode()) for r, k in zip(raw, n)]
                yield _batch(row=row, id=ident, key=key, n=n, sig=sig, prefix=pa.array(prefix, pa.binary()))

    id_type = found.schema["id"].dataType.simpleString()
    keys = store.save(found.where("n > 0").mapInArrow(run, f"row long, id {id_type}, key binary, n long, sig binary, "
                                                    "prefix binary"), "keys")
    classes = keys.groupBy("sig", "prefix", "n").agg(F.min("row").alias("class"))
    groups = classes.groupBy("prefix", "n").agg(F.min("class").alias("group"))
    named = classes.join(groups, ["prefix", "n"]).select("sig", "class", "group")
    return store.save(keys.join(named, "sig").select("row", "id", "key", "n", "class", "group"), "rows")


def entries(found: DataFrame, rows: DataFrame, level, store: Scratch) -> DataFrame:
    """(token, group, n, pos): prefix entries of the groups, of shingles that two groups or more share."""
    others = store.save(rows.where("row <> group").select("row"), "others")

    def run(batches):
        table = level.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                row, raw = batch.slice(at, 256).columns
                kept = [_ordered(r.as_py(), table) for r in raw]
                size = np.array([len(k) for k in kept])
                n = np.array([len(r.as_py()) // WIDTH for r in raw])
                pos = np.concatenate([np.arange(k) for k in size]) if len(size) else np.empty(0, np.int64)
                yield _batch(token=pa.array(np.concatenate(kept).view(np.int64)),
                             group=pa.array(np.repeat(row.to_numpy(), size)),
                             place=pa.array((np.repeat(n, size) << 32) + pos))

    # one row a group: rows that name none are taken out (a join Spark broadcasts below its limit)
    of_groups = found.where("n > 0").join(others, "row", "left_anti").select("row", "shingles")
    every = of_groups.mapInArrow(run, "token long, group long, place long")
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    return store.save(every.join(shared, "token").select(
        "token", "group", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")),
        "entries")


def _behind_prefix(classes: DataFrame, found: DataFrame, level) -> DataFrame:
    """(group, token, class, comp) of the shingles behind the prefix of each class."""
    def run(batches):
        table = level.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                group, cls, comp, raw = batch.slice(at, 256).columns
                kept = [_behind(r.as_py(), table) for r in raw]
                size = np.array([len(k) for k in kept], np.int64)
                token = np.concatenate(kept) if kept else np.empty(0, np.uint64)
                yield _batch(group=pa.array(np.repeat(group.to_numpy(), size)), token=pa.array(token.view(np.int64)),
                             **{"class": pa.array(np.repeat(cls.to_numpy(), size))}, comp=pa.array(np.repeat(comp.to_numpy(), size)))

    return (classes.select("group", "class", "comp").join(found.select(F.col("row").alias("class"), "shingles"), "class")
            .select("group", "class", "comp", "shingles").mapInArrow(run, "group long, token long, class long, comp long"))


def _band(n: Column) -> Column:
    """Band of a size: linked sets lie in the same band or in neighbouring ones."""
    return F.floor(F.log2(n.cast("double")) / F.log2(F.lit(DEN / NUM))).cast("int")


def _possible(a: str, b: str) -> Column:
    """Size filter, and the overlap still possible after the shared prefix shingle."""
    n, m, i, j = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (
        (NUM + DEN) * (F.lit(1) + F.least(n - i, m - j) - 1) >= NUM * (n + m))


def _sketch(raw: bytes) -> bytes:
    """Parity of the shingles in each of ``BITS`` buckets: two sketches differ in no more bits than the sets in shingles."""
    bucket = (_mix(loaded(raw)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def plausible(pairs: DataFrame, found: DataFrame, store: Scratch, name: str) -> DataFrame:
    """The (a, b) whose parity sketches do not rule a link out."""
    def sketches(batches):
        for batch in batches:
            row, raw = batch.columns
            marks = [r.as_py() for r in raw]
            yield _batch(row=row, n=pa.array([len(r) // WIDTH for r in marks], pa.int64()),
                         sketch=pa.array([_sketch(r) for r in marks], pa.binary()))

    wanted = store.save(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), f"{name}-seen")
    own = store.save(found.join(wanted, "row", "left_semi").select("row", "shingles")
                     .mapInArrow(sketches, "row long, n long, sketch binary"), f"{name}-sketches")
    both = (pairs.join(own.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x")), "a")
            .join(own.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y")), "b")
            .select("a", "b", "na", "nb", "x", "y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b, na, nb, x, y = batch.slice(at, 4096).columns
                wide = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(a), -1) for c in (x, y)]
                apart = np.bitwise_count(wide[0] ^ wide[1]).sum(1, dtype=np.int64)
                # linked: |x - y| + |y - x| <= (DEN - NUM) / (DEN + NUM) * (|x| + |y|)
                keep = pa.array((DEN + NUM) * apart <= (DEN - NUM) * (na.to_numpy() + nb.to_numpy()))
                yield _batch(a=a.filter(keep), b=b.filter(keep))

    return store.save(both.mapInArrow(run, "a long, b long"), f"{name}-plausible")


def verify(pairs: DataFrame, found: DataFrame, store: Scratch, name: str) -> DataFrame:
    """The (a, b) of class pairs that link, by intersecting the whole sets."""
    pairs = plausible(store.save(pairs.distinct(), f"{name}-pairs"), found, store, name)
    wanted = store.save(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), f"{name}-wanted")
    own = store.save(found.join(wanted, "row", "left_semi").select("row", "shingles"), f"{name}-sets")
    both = (pairs.join(own.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a")
            .join(own.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches):
        for batch in batches:
            a, b, left, right = batch.columns
            keep = []
            for k in range(batch.num_rows):
                x, y = (loaded(c[k].as_py()) for c in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield _batch(a=a.filter(keep), b=b.filter(keep))

    links = store.save(both.mapInArrow(run, "a long, b long"), f"{name}-links")
    store.drop(f"{name}-sets", f"{name}-sketches")
    return links


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    rows, comps, store = _solve(docs, id_col, text_col)
    # written: a join of plain exchanges, which Spark splits where a component is hot
    name = store["store"].save(comps.groupBy("comp").agg(F.min("id").alias("component_id")), "names")
    out = rows.join(comps.select("class", "comp"), "class").join(name, "comp").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    empty = store["empty"].select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"),
                                  F.col("id").alias("component_id"))
    return out.unionByName(empty)


def _solve(docs: DataFrame, id_col: str, text_col: str):
    """(rows, classes with components, {"empty": rows without shingles})."""
    spark = docs.sparkSession
    store = Scratch(spark, "jaccard")
    found = store.save(sets(docs, id_col, text_col), "sets")
    level = spark.sparkContext.broadcast(levels(found))  # SLOTS bytes
    rows = grouped(found, level, store)
    empty = store.save(found.where("n = 0").select("id"), "empty")
    members = store.save(rows.groupBy("group", "class").agg(F.min("n").alias("n"), F.min("id").alias("id")), "members")
    entry = entries(found, rows, level, store)

    # round 1: each group against the purest group of the shingle (fewest rarer shingles before it) in its
    # own band of sizes and the one below, each class against its group
    hubs = store.save(entry.groupBy("token", _band(F.col("n")).alias("band")).agg(
        F.min(F.struct("pos", "n", "group")).alias("h")).select("token", "band", "h.*"), "hubs")
    band = _band(F.col("n"))
    star = (entry.withColumn("band", F.explode(F.array(band, band - 1))).alias("g").join(hubs.alias("h"), ["token", "band"])
            .where((F.col("g.group") != F.col("h.group")) & _possible("g", "h"))
            .select(F.col("h.group").alias("a"), F.col("g.group").alias("group")).distinct())
    star = star.join(members.select("group", "class"), "group").select("a", F.col("class").alias("b"))
    inside = members.where(F.col("group") != F.col("class")).select(F.col("group").alias("a"), F.col("class").alias("b"))
    links = verify(star.unionByName(inside), found, store, "star")
    first = components(links, store, "first")

    # round 2: groups of one shingle that lie in different components
    placed = store.save(members.join(first, members["class"] == first["node"], "left")
                        .select("group", "class", "n", "id", F.coalesce("comp", "class").alias("comp")), "placed")
    parts = placed.select("group", "comp").distinct()
    spread = store.save(entry.join(parts, "group"), "spread")
    mixed = spread.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    mixed = store.save(spread.join(mixed, "token"), "mixed")
    # Shingles held by exactly the same groups (a shared passage) stand in the same order in all of them, so what
    # passes the filters at a later one passes at the first: only the first is kept.
    members_of = mixed.groupBy("token").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("group", "comp")).alias("x"),
        F.bit_xor(F.xxhash64("comp", "group", F.lit(1))).alias("y"), F.min("pos").alias("first"))
    firsts = store.save(members_of.groupBy("k", "x", "y").agg(F.min_by("token", "first").alias("token")).select("token"), "firsts")
    mixed = store.save(mixed.join(firsts, "token", "left_semi"), "buckets")
    left = mixed.withColumn("band", F.explode(F.array(band, band + 1)))  # sizes of linked sets are one band apart at most
    right = mixed.withColumn("band", band)
    left = left.withColumn("exact", F.col("band") == band)
    pairs = (left.alias("g").join(right.alias("h"), ["token", "band"])
             .where((F.col("g.comp") != F.col("h.comp")) & _possible("g", "h")
                    & (~F.col("g.exact") | (F.col("g.group") < F.col("h.group"))))
             .select(F.col("g.group").alias("g1"), F.col("g.comp").alias("c1"), F.col("h.group").alias("g2"),
                     F.col("h.comp").alias("c2")).distinct())
    one = placed.select(F.col("group").alias("g1"), F.col("comp").alias("c1"), F.col("class").alias("a"))
    two = placed.select(F.col("group").alias("g2"), F.col("comp").alias("c2"), F.col("class").alias("b"))
    across = pairs.join(one, ["g1", "c1"]).join(two, ["g2", "c2"]).select("a", "b")
    split = parts.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("group")
    torn = placed.join(split, "group")
    # classes of one group that the first round left apart: joined by the shingles behind their prefix
    behind = store.save(_behind_prefix(torn, found, level), "behind")
    within = (behind.alias("g").join(behind.alias("h"), ["group", "token"]).where(F.col("g.comp") < F.col("h.comp"))
              .select(F.col("g.class").alias("a"), F.col("h.class").alias("b")).distinct())
    more = verify(across.unionByName(within), found, store, "cross")
    store.drop("sets", "entries", "spread", "mixed", "buckets", "keys")
    last = components(links.unionByName(more), store, "last")
    comps = store.save(members.join(last, members["class"] == last["node"], "left")
                       .select("class", "id", F.coalesce("comp", "class").alias("comp")), "components")
    return rows, comps, {"empty": empty, "store": store}


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest (id, class).

    Documents without shingles all stay.  What goes is a written list keyed by id and
    content, joined as an anti join by a shuffle.
    """
    rows, comps, kept = _solve(docs, id_col, text_col)
    store = kept["store"]
    all_rows = rows.join(comps.select("class", "comp"), "class")
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    winner = all_rows.groupBy("comp").agg(F.min(best).alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1")
    in_many = all_rows.join(winner, "comp").withColumn("wins", F.struct("id", "key").eqNullSafe(
        F.struct("w.id", "w.key")))
    named = store.save(in_many.groupBy(F.col("id").alias(f"{OWN}id"), F.col("key").alias(f"{OWN}key"))
                       .agg(F.max("wins").alias("wins"), F.count(F.lit(1)).alias("times")), "named")
    gone = named.where(~F.col("wins")).select(f"{OWN}id", f"{OWN}key")
    ties = named.where(F.col("wins") & (F.col("times") > 1)).select(f"{OWN}id", f"{OWN}key")
    keyed = docs.withColumn(f"{OWN}text", F.unhex(F.md5(plain(F.col(text_col)))))

    def same(other: DataFrame) -> Column:
        return keyed[f"{OWN}text"].eqNullSafe(other[f"{OWN}key"]) & keyed[id_col].eqNullSafe(other[f"{OWN}id"])

    # a shuffle join at every size: the list grows with the documents
    stay = keyed.join(gone.hint("shuffle_merge"), same(gone), "left_anti")
    if ties.isEmpty():
        return stay.select(*docs.columns)
    # rows that repeat id and text of a winner: one of them stays
    one = keyed.join(ties, same(ties), "left_semi").dropDuplicates([id_col, f"{OWN}text"])
    both = gone.unionByName(ties)
    rest = keyed.join(both, same(both), "left_anti")
    return rest.select(*docs.columns).unionByName(one.select(*docs.columns))
