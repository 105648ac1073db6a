"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most two have, of their two halves, one that differs in at most one bit. So
the upper half is indexed whole and with each of its bits deleted (33 keys), the lower half, which must be equal where the upper differs in two bits, whole.
Each linked pair meets under exactly one key where its halves say so. A key's fingerprints are compared pair by pair if they are
few. Where they are many, the rest of the fingerprint is given deletions too, so that those that still agree are linked by
construction, and are at most four: nothing is left out, and no key's pairs are written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import cut, in_blocks, table
from pixelweave.llm.graph import components

SEED = 42
#: Fingerprints under one key up to which pairs are compared: with one bit deleted, or whole.
FEW, FEW_WHOLE = 64, 512
#: Keys that are broadcast at most: two longs each.
SENT = 500_000
HALF = 0xFFFFFFFF


def fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    """SimHash of each text, as unsigned 64-bit integers."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        own = (text or b"").lower().split()  # of ASCII alone: A-Z, and the six characters of white space
        if not own:
            continue
        line = b" ".join(own)
        size = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(size + 1) - 1
        if len(own) <= words:
            hashes.append(digest(line, SEED))
            counts[i] = 1
            continue
        starts = (ends - size)[: len(own) - words + 1].tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
        counts[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.cumsum(counts[full]) - counts[full]
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1).reshape(-1).view(">u8")
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def work(columns: list[pa.Array]) -> list:
        return [columns[0], fingerprints(columns[1].to_pylist(), words).view(np.int64)]

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return given.mapInArrow(in_blocks(work, schema, weigh=1), "doc_id long, fp long")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(HALF))


def _without(half: Column, bit: Column) -> Column:
    return half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _key(kind: Column, half: Column) -> Column:
    return kind.cast("long") * F.lit(1 << 32) + half


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp, bit): kind 0 is the upper half, 1 to 32 that half with bit kind - 1 deleted, 33 the lower half; bit: the deleted one."""
    kind = F.explode(F.sequence(F.lit(0), F.lit(33))).alias("kind")
    up, k = _upper(F.col("fp")), F.col("kind")
    half = F.when(k == 0, up).when(k == 33, _lower(F.col("fp"))).otherwise(_without(up, k - 1))
    bit = F.when(k.between(1, 32), F.call_function("shiftright", up, k - 1).bitwiseAND(F.lit(1))).otherwise(F.lit(0))
    return nodes.select("fp", kind).select(_key(k, half).alias("key"), "fp", bit.alias("bit"))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all pairs within two bits."""
    every = variants(nodes)
    kind = F.shiftrightunsigned("key", 32)
    seen = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # with a bit deleted, only pairs that differ in it are new: the others meet under the whole half
    seen = cut(seen.where("n > 1").where((kind == 0) | (kind == 33) | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= 2
    found = seen.where("n = 2").where(near).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    shared = seen.where("n > 2").select(F.col("key").alias("k"), "n")
    count = shared.count()
    if not count:
        return found
    shared = F.broadcast(shared) if count <= SENT else shared
    members = cut(every.join(shared, F.col("key") == F.col("k")).select("key", "fp", "n"))
    kind, whole = F.shiftrightunsigned("key", 32), F.shiftrightunsigned("key", 32).isin(0, 33)
    few = F.col("n") <= F.when(whole, FEW_WHOLE).otherwise(FEW)
    left, right = members.where(few).select("key", "fp"), members.where(few).select(F.col("key").alias("k"), F.col("fp").alias("other"))
    pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2))
    found = found.unionByName(pairs.select(F.col("fp").alias("u"), F.col("other").alias("v")))
    many = members.where(~few)
    # one bit deleted: the lower half with one deleted too
    bits = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    one = many.where(~whole).select("key", "fp", bits).select("key", "fp", F.col("i").alias("a"), F.lit(-1).alias("b"), _without(_lower(F.col("fp")), F.col("i")).alias("rest"))
    # a half whole: the other with two deleted
    two = [(a, b) for a in range(32) for b in range(a)]
    places = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in two])).alias("p")
    other = F.when(kind == 0, _lower(F.col("fp"))).otherwise(_upper(F.col("fp")))
    both = many.where(whole).select("key", "fp", other.alias("other"), places)
    both = both.select("key", "fp", F.col("p.a").alias("a"), F.col("p.b").alias("b"), _without(_without(F.col("other"), F.col("p.a")), F.col("p.b")).alias("rest"))
    alike = one.unionByName(both).groupBy("key", "a", "b", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = alike.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return found.unionByName(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at two or fewer differing bits.

    One row per input row: the id column, fingerprint (16 hexadecimal digits), component_id (the smallest id that links reach). A text with fewer words
    than a shingle is one shingle; without words, or null, its fingerprint is zero and linked like any other. Rows that share an id are documents of
    their own. Ids are cast to long; a null id is never the smallest, and a component of null ids alone has a null
    component_id. Very long texts are hashed whole. No rows give none; other columns are dropped. Copies are one node, so groups of any size cost one
    row each.
    """
    marked = cut(with_fingerprint(docs, id_col, text_col, words))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes))
    of = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = of.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    of = of.join(first, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of, F.col("fp") == F.col("f")).select(F.col("doc_id").alias(id_col), digits.alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))
