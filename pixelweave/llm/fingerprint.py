"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A paragraph (a line) is hashed to a wide vector: itself and each pair of neighbouring words in it have a 64-bit XXH64, whose
bits are summed lane by lane modulo 2^32, and a second XXH64 of another seed, whose halves are summed modulo 2^32 too. A text's fingerprint is the sum of its
paragraphs' vectors modulo 2^32 in each of 66 lanes. So the order of paragraphs doesn't matter, and a paragraph is inserted or
deleted by adding or subtracting its vector (``added``, ``removed``). The 64 lanes of bits are also a sketch: centred, they are sums of
random signs over the text's items, and the squared distance of two such sums estimates how many items two texts don't share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import cut, table

SEED = 5
HALF = 0xFFFFFFFF
#: Two lanes of 32 bits in each long: bits j and j + 32 of a hash.
PAIR = 0x100000001
LANES = [f"v{j}" for j in range(32)] + ["count", "d0", "d1"]


def items(text: Column) -> Column:
    """Two hashes, of seeds of their own, of all paragraphs and of the pairs of neighbouring words inside them: array of struct(h, d)."""

    def twice(*x: Column) -> Column:
        return F.struct(F.xxhash64(*x).alias("h"), F.xxhash64(F.lit(SEED), *x).alias("d"))

    def of(paragraph: Column) -> Column:
        words = F.split(paragraph, " ")
        pairs = F.transform(
            F.array(words),
            lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: twice(a, b)),
        )
        return F.concat(F.array(twice(paragraph)), F.flatten(pairs))

    return F.flatten(F.transform(F.split(text, "\n"), of))


def vectors(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """Sums of the lanes over the exploded hashes of each key."""
    spread = rows.select(*keys, F.explode(hashes).alias("i")).select(*keys, "i.h", "i.d")
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(PAIR))).alias(f"v{j}") for j in range(32)]
    halves = [F.sum(F.shiftrightunsigned("d", j).bitwiseAND(F.lit(HALF))).alias(n) for j, n in ((0, "d0"), (32, "d1"))]
    return spread.groupBy(*keys).agg(*lanes, F.count(F.lit(1)).alias("count"), *halves)


def packed(prefix: str = "") -> Column:
    """The lanes as an array of longs, the dense ones reduced modulo 2^32."""
    c = lambda n: F.col(prefix + n)
    return F.array(*[c(f"v{j}") for j in range(32)], *[c(d).bitwiseAND(F.lit(HALF)) for d in ("d0", "d1")], c("count"))


def spelled(v: Column) -> Column:
    """A fingerprint as hexadecimal digits, of which a text's count of items is the last field."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def read(fingerprint: Column) -> Column:
    """The array that ``spelled`` wrote."""
    return F.transform(F.sequence(F.lit(0), F.lit(34)), lambda i: F.conv(F.substr(fingerprint, i * 16 + 1, F.lit(16)), 16, -10).cast("long"))


def _lanes(a: Column, b: Column, sign: int) -> Column:
    def one(x: Column, y: Column, i: Column) -> Column:
        low = (x.bitwiseAND(F.lit(HALF)) + sign * y.bitwiseAND(F.lit(HALF))).bitwiseAND(F.lit(HALF))
        high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(HALF))
        return F.when(i < 34, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(x + sign * y)

    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p, i: one(p["x"], p["y"], i))


def added(a: Column, b: Column) -> Column:
    """The vector of the union of two multisets of paragraphs."""
    return _lanes(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``."""
    return _lanes(a, b, -1)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal vectors, about the share of common items else, 0 at least: 1 - |A - B|^2 / (|A|^2 + |B|^2), centred."""

    def lane(v: Column, j: Column, high: bool) -> Column:
        x = F.element_at(v, j)
        count = F.shiftrightunsigned(x, 32) if high else x.bitwiseAND(F.lit(HALF))
        return (2 * count - F.element_at(v, F.lit(35))).cast("double")

    def total(of) -> Column:
        def add(acc: Column, j: Column) -> Column:
            return acc + of(lane(a, j, False), lane(b, j, False)) + of(lane(a, j, True), lane(b, j, True))

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), add)

    apart, sizes = total(lambda x, y: (x - y) * (x - y)), total(lambda x, y: x * x + y * y)
    near = F.when(sizes > 0, F.greatest(F.lit(0.0), F.lit(1.0) - apart / sizes)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(place, n, doc_id, text) to the same with next_text and the next row's place and n, ascending, the first after the last.

    Rows are cut into ranges of ids at quantiles, so that no task sees them all; only each range's first row, one per range, meets elsewhere.
    """
    bounds = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))))
    least = docs.groupBy(place.alias("of")).agg(F.min("doc_id").alias("least"))
    # one row per range at most, so it may be broadcast
    firsts = docs.join(F.broadcast(least), docs["doc_id"].eqNullSafe(least["least"])).groupBy("of").agg(F.min("text").alias("first_text"))
    line = Window.orderBy("of")
    links = cut(
        firsts.withColumn("then", F.coalesce(F.lead("of").over(line), F.first("of").over(line))).withColumn(
            "first_text", F.coalesce(F.lead("first_text").over(line), F.first("first_text").over(line))
        )
    )
    order = Window.partitionBy("place").orderBy("doc_id", "text")
    rows = docs.withColumn("place", place).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("inner_n", F.lead("n").over(order)).withColumn("inner_text", F.lead("text").over(order))
    last = F.col("inner_n").isNull()
    return rows.join(links, (F.col("place") == F.col("of")) & last, "left").select(
        "place",
        "n",
        "doc_id",
        "text",
        F.when(last, F.col("then")).otherwise(F.col("place")).alias("next_place"),
        F.coalesce("inner_n", F.lit(1)).alias("next_n"),
        F.coalesce("inner_text", "first_text").alias("next_text"),
    )


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (array of 35 longs), one row per row.

    A null text is an empty one, which has one empty paragraph. Repeated rows have equal fingerprints; no rows give none; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", F.sha2("text", 256))
    found = vectors(rows.withColumn("hashes", items(F.col("text"))), ["doc_id", "key", "times"], "hashes")
    return found.select("doc_id", F.explode(F.array_repeat(packed(), F.col("times").cast("int"))).alias("fingerprint"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next row's text. Rows stand in
    order of id, null first, then text, so repeated ids and repeated rows follow each other; a single row follows itself.
    A null text is an empty one. No rows give none; other columns are dropped.
    """
    spark = docs.sparkSession
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = with_next(given, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.length("text")
    cutting = F.floor(size / 4).cast("int")
    new = F.concat(F.left("text", size - cutting), F.left("next_text", cutting))
    facts = ["place", "n", "doc_id", "next_place", "next_n", "n_chars", "edited_sha256"]
    rows = rows.select("place", "n", "doc_id", "next_place", "next_n", size.cast("long").alias("n_chars"), "text", new.alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("t")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("t"))
    )
    spread = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*facts, F.explode(both).alias("v"))
    hashes = spread.select(*facts, "v.version", items(F.col("v.t")).alias("hashes"))
    found = cut(vectors(hashes, [*facts, "version"], "hashes").select(*facts, "version", packed().alias("f")))
    own = found.where("version = 0").drop("version").withColumnRenamed("f", "own")
    changed = found.where("version = 1").select(F.col("place").alias("p1"), F.col("n").alias("n1"), F.col("f").alias("changed"))
    following = own.select(F.col("place").alias("p2"), F.col("n").alias("n2"), F.col("own").alias("following"))
    return (
        own.join(changed, (F.col("place") == F.col("p1")) & (F.col("n") == F.col("n1")))
        .join(following, (F.col("next_place") == F.col("p2")) & (F.col("next_n") == F.col("n2")))
        .select(
            F.col("doc_id").alias(id_col),
            "n_chars",
            "edited_sha256",
            spelled(F.col("own")).alias("fingerprint"),
            spelled(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("following")).alias("near_next"),
        )
    )


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents and its edited text."""
    return edited(table(spark, sf_dir, "documents"))
