"""Order MinHash fingerprints of whole documents with DataFrame functions only.

The k-mers of a text are its runs of `k` words, each numbered by its occurrence, so that a text is a set of distinct
(k-mer, number) pairs.  One 64-bit hash places them on a ring; a signature starts at one of `m` even points of the
ring and takes the next `l` members, which are the `l` smallest under that point's own hash (distance ahead on the ring).  The `l`
members are put back in text order and hashed as a tuple, so a signature survives only where both the words and
their order do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.shared import stored

#: Words of a k-mer, members of a tuple, signatures (a power of two).
K, L, M = 2, 2, 64
#: Members around each point that are looked at first; only if a point lacks its `l` are all of them sorted.
AHEAD = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def _members(kmers: Column) -> Column:
    """(u, pos) of each k-mer hash: u is the hash itself for a first occurrence, else hashed with its number."""
    at = F.transform(kmers, lambda h, i: F.struct(h.alias("u"), i.alias("pos")))

    def numbered(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (s[F.greatest(i - 1, F.lit(0))]["u"] != x["u"]), i)), lambda i: i.isNotNull())
        runs = _let(first, lambda a: F.zip_with(a, F.slice(a, 2, F.size(a)), lambda b, e: F.struct(b.alias("b"), F.coalesce(e, F.size(s)).alias("e"))))
        later = lambda x, o: F.struct(F.when(o == 0, x["u"]).otherwise(F.xxhash64(x["u"], o)).alias("u"), x["pos"].alias("pos"))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.slice(s, r["b"] + 1, r["e"] - r["b"]), later)))

    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), at).otherwise(_let(F.array_sort(at), numbered))


def signatures(text: Column, k: int = K, l: int = L, m: int = M) -> Column:  # noqa: E741
    """The m signatures (array of int) of a text; empty for a text without words.  Fewer than k words are one k-mer."""
    bits = m.bit_length() - 1
    low = (1 << (64 - bits)) - 1
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    start = [(-(1 << 63)) + (j << (64 - bits)) for j in range(m)]

    def kmers(w: Column) -> Column:
        run = lambda i: F.xxhash64(*(F.get(w, i + o) for o in range(k)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - k), run))

    def firsts(u: Column) -> Column:
        """The first l members after each point, in ring order."""
        part = lambda x: F.shiftright(x["u"], 64 - bits)
        heads = lambda s: F.filter(s, lambda x, i: (i < l) | (part(s[F.greatest(i - l, F.lit(0))]) != part(x)))
        all_of = lambda: _let(F.array_sort(u), heads)
        near = F.filter(u, lambda x: x["u"].bitwiseAND(F.lit(low)) < (F.lit(float(low) * m * AHEAD) / F.size(u)))
        return F.when(F.size(u) <= m * AHEAD, all_of()).otherwise(_let(_let(F.array_sort(near), heads), lambda r: F.when(F.size(r) == m * l, r).otherwise(all_of())))

    def tuples(r: Column) -> Column:
        points = F.array(*(F.struct(F.lit(p).alias("u"), F.lit(-1).alias("pos")) for p in start))
        merged = F.array_sort(F.concat(points, r))
        places = F.filter(F.transform(merged, lambda x, i: F.when(x["pos"] == -1, i)), lambda i: i.isNotNull())

        def one(i: Column, j: Column) -> Column:
            taken = F.array(*(r[F.pmod(i - j + o, F.size(r))] for o in range(l)))
            in_order = F.array_sort(F.transform(taken, lambda x: F.struct(x["pos"].alias("pos"), x["u"].alias("u"))))
            return _let(in_order, lambda t: F.xxhash64(*(t[o]["u"] for o in range(l)))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

        return F.when(F.size(r) == 0, F.array().cast("array<int>")).otherwise(F.transform(places, one))

    return _let(words, lambda w: _let(kmers(w), lambda h: _let(_members(h), lambda u: _let(firsts(u), tuples))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures, 0 to 1; two texts without words are alike, one without words is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits a signature ('' without words)."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0")), ""))


def next_ids(docs: DataFrame) -> DataFrame:
    """doc_id and next_id of every different doc_id: the next in ascending order (null last), the first after the last.

    Ids are dealt out by range and looked ahead inside each partition; the first id of each partition, one row a
    partition, closes the gaps.
    """
    order = F.asc_nulls_last("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = ids.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ids = stored(dealt.coalesce(docs.sparkSession.sparkContext.defaultParallelism), "ids-by-range")  # ids are few bytes: a file a core
    inside = Window.partitionBy("_part").orderBy(order)
    row = ids.withColumn("_next", F.lead(F.struct("doc_id")).over(inside))
    firsts = ids.groupBy("_part").agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("_first"))
    round_trip = Window.orderBy("_part")
    whole = round_trip.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_part", F.coalesce(F.lead("_first").over(round_trip), F.first("_first").over(whole)).alias("_after"))  # a row a partition
    return row.join(F.broadcast(after), "_part").select("doc_id", F.coalesce("_next", "_after")["doc_id"].alias("next_id"))


def fingerprints(docs: DataFrame, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """doc_id, n_chars, edited (text), signature and edited_signature, near_edited and near_next of each row of `docs`.

    The edited text has the last floor(n_chars/4) code points replaced by as many (or all) first ones of the next document's text.
    Null texts count as empty; empty texts have the fingerprint '' and are like empty texts only.  The next document
    is that of the next greater doc_id (null is the greatest; after the last comes the first); where that id repeats,
    the row whose text has the smallest hash.  Rows that repeat an id share their next document.  A table of one id is its own
    next.  An empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    wanted = next_ids(docs).join(own.select(F.col("doc_id").alias("_id"), quarter.alias("q")).groupBy("_id").agg(F.max("q").alias("q")), F.col("doc_id").eqNullSafe(F.col("_id")))
    wanted = wanted.select(F.col("doc_id").alias("of_id"), "next_id", "q")
    heads = own.join(wanted, own.doc_id.eqNullSafe(wanted.next_id)).select("of_id", "next_id", F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, q)").alias("head")).alias("head"))
    heads = heads.groupBy("of_id").agg(F.min("head").alias("head"), F.first("next_id").alias("next_id"))
    rows = own.join(heads, own.doc_id.eqNullSafe(heads.of_id))
    rows = rows.select("doc_id", "next_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.expr("concat(substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int)), substring(head.head, 1, cast(floor(char_length(text) / 4) as int)))").alias("edited"))
    return rows.select("doc_id", "next_id", "n_chars", "edited", F.xxhash64("text").alias("text_hash"), signatures(F.col("text"), k, l, m).alias("signature"), signatures(F.col("edited"), k, l, m).alias("edited_signature"))


def with_next(prints: DataFrame) -> DataFrame:
    """Adds near_edited and near_next to stored rows of `fingerprints`."""
    following = prints.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct("text_hash", "signature")).alias("following"))
    joined = prints.join(following, prints.next_id.eqNullSafe(F.col("_id")))
    return joined.withColumn("near_edited", likeness(F.col("signature"), F.col("edited_signature"))).withColumn("near_next", likeness(F.col("signature"), F.col("following.signature"))).drop("_id", "following")
