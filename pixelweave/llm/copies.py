"""Near copies at a similarity of word shingles, by deletion-variant signatures.

Texts whose five-word shingles are 80 % alike differ in about ten of a SimHash's 64 bits, so no few segments of bits can find them. Here
the fingerprint's places hold symbols instead, each the least of the shingles' values under a hash of its own; alike texts differ in one with a chance of
one less their similarity. The rest is as with bits: the places are cut into few segments, so that one differs in at most one
place; each segment is indexed with each place deleted; equal keys make candidates; and the shingle sets themselves are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import cut, free_name, in_blocks, tidy
from pixelweave.llm.graph import components

WORDS, SIMILARITY = 5, 0.8
#: Segments, and places of a segment: at a similarity of 0.8 a pair shares a key with a chance of 0.995.
SEGMENTS, PLACES = 5, 6
#: Texts under a key up to which all pairs are candidates; beyond, each text with so many that follow it in order of their fingerprints, and
#: then, if that hasn't made one component of them, each outside the largest with all others, block by block.
FEW, AHEAD = 48, 5
#: Texts and shingles of a block, about; columns of the matrices that blocks are compared by.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 400_000, 2048
#: Links up to which one task finds all classes; beyond, a task makes stars of as many at a time, and what is left goes through rounds of joins.
TASK_LINKS = 250_000
_rng = np.random.default_rng(9)
FACTORS = _rng.integers(1, 1 << 63, SEGMENTS * PLACES, dtype=np.uint64) * 2 + 1
TERMS = _rng.integers(0, 1 << 63, SEGMENTS * PLACES, dtype=np.uint64)


def shingles(text: bytes | None, words: int) -> tuple[int, np.ndarray]:
    """A hash of the text's words, A-Z in lower case, and those of its shingles (fewer words: the whole; none: none)."""
    own = (text or b"").lower().split()
    line = b" ".join(own)
    whole = xxhash.xxh64_intdigest(line) - (1 << 63)
    if not own:
        return whole, np.zeros(0, np.uint64)
    size = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(size + 1) - 1
    k = max(1, len(own) - words + 1)
    last = ends[words - 1 :].tolist() if len(own) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    return whole, np.array([digest(line[a:b], 42) for a, b in zip((ends - size)[:k].tolist(), last)], np.uint64)


def signature(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of all segments with each place deleted, and a byte of each place."""
    n = len(FACTORS)
    if not len(hashes):
        hashes = np.zeros(1, np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * FACTORS + TERMS).min(axis=0))
    places = least.reshape(SEGMENTS, PLACES)
    mixed = (places ^ places >> np.uint64(29)) * FACTORS.reshape(SEGMENTS, PLACES)
    keys = mixed.sum(axis=1, keepdims=True, dtype=np.uint64) - mixed  # without one place
    keys = (keys ^ keys >> np.uint64(32)) * FACTORS[0] + (np.arange(SEGMENTS * PLACES, dtype=np.uint64) * TERMS[0]).reshape(SEGMENTS, PLACES)
    return keys.reshape(-1).view(np.int64), (least >> np.uint64(40)).astype(np.uint8).tobytes()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``a`` shares with each of ``b``: products of 0/1 matrices over the members that both sides know."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for own in (a, b):
        flat = np.concatenate(own) if own else np.zeros(0, np.int32)
        sides.append((flat, np.repeat(np.arange(len(own)), [len(x) for x in own])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    if not len(both):
        return out
    places = []
    for flat, row in sides:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        known = both[at] == flat
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], row[known][order]))
    for begin in range(0, len(both), COLUMNS):
        parts = []
        for (at, row), n in zip(places, out.shape):
            low, high = np.searchsorted(at, (begin, begin + COLUMNS))
            part = np.zeros((n, min(COLUMNS, len(both) - begin)), np.float32)
            part[row[low:high], at[low:high] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def linked_blocks(similarity: float):
    """For a cogrouped block: edges between its queries and members of other components, one per query and component."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        edges: tuple[list[int], list[int]] = ([], [])
        if queries.num_rows and members.num_rows:
            a, b = ([np.asarray(x.values) for x in t["set"].combine_chunks()] for t in (queries, members))
            size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            node_a, node_b = queries["node"].to_numpy(), members["node"].to_numpy()
            part_a, part_b = queries["component"].to_numpy(), members["component"].to_numpy()
            shared = common_counts(a, b)
            near = shared >= similarity * (size_a[:, None] + size_b[None, :] - shared)
            near &= part_a[:, None] != part_b[None, :]
            for i in np.flatnonzero(near.any(axis=1)):
                at = np.flatnonzero(near[i])
                at = at[np.unique(part_b[at], return_index=True)[1]]
                edges[0].extend([int(node_a[i])] * len(at))
                edges[1].extend(node_b[at].tolist())
        return pa.table({"u": pa.array(edges[0], pa.int64()), "v": pa.array(edges[1], pa.int64())})

    return run


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``TASK_LINKS`` links of a task at a time: each node, and the smallest that it can reach by them."""
    up: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def found() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least(x) for x in nodes], pa.int64())], ["node", "component"])

    n = 0
    for batch in batches:
        for begin in range(0, batch.num_rows, TASK_LINKS):
            part = batch.slice(begin, TASK_LINKS)
            if up and n + part.num_rows > TASK_LINKS:
                yield found()
                up.clear()
                n = 0
            n += part.num_rows
            for u, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                a, b = least(u), least(v)
                up[max(a, b)] = min(a, b)
    yield found()


def classes(links: DataFrame) -> DataFrame:
    """(u, v) of longs to (node, component) as ``components`` does, after the links have been made few by ``stars``.

    No class is lost, as stars reach what their links do. While stars are half as many as links or fewer they are made again; once a single task has had all, they are
    the classes. Each round of joins that this saves is eight stages and their tasks for the driver to keep account of.
    """
    while True:
        n = links.count()
        found = cut(links.coalesce(max(1, math.ceil(n / TASK_LINKS))).mapInArrow(stars, "node long, component long"))
        if n <= TASK_LINKS:
            return found
        links = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        if links.count() > n / 2:
            return components(links)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id): every document with the smallest id that links of at least ``similarity`` (Jaccard, of shingle sets) reach.

    Links are those of pairs that share a key, compared exactly: at a similarity of 0.8 a pair shares none with a chance of 0.005.
    Equal word sequences are one node, whatever their number. A text with fewer words than a shingle is one shingle; texts without words, null
    ones too, are copies of each other; very long texts are compared whole. A null id is never the smallest. Repeated rows are repeated; no rows
    give none; other columns are dropped.
    """

    def mark(columns: list[pa.Array]) -> list:
        found = [shingles(x, words) for x in columns[1].to_pylist()]
        signs = [signature(h) for _, h in found]
        return [columns[0], [w for w, _ in found], [len(np.unique(h >> np.uint64(32))) for _, h in found], [k for k, _ in signs], [s for _, s in signs]]

    def sets(columns: list[pa.Array]) -> list:
        found = [shingles(x, words) for x in columns[0].to_pylist()]
        return [[w for w, _ in found], [np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32) for _, h in found]]

    given = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("keys", pa.list_(pa.int64())), ("sign", pa.binary())])
    marked = cut(given.mapInArrow(in_blocks(mark, schema, weigh=1), "id long, node long, size int, keys array<long>, sign binary"))
    nodes = marked.groupBy("node", "size", "keys", "sign").agg(F.min("id").alias("least"))
    entries = nodes.select("node", "size", F.explode("keys").alias("key"))
    common = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    members = cut(entries.join(common, F.col("key") == F.col("k")).select("key", "node", "size", "n"))
    tidy(docs.sparkSession)
    # a set that is smaller than its partner by more than the similarity can't be alike
    sizes_fit = F.least("size", "other_size") >= similarity * F.greatest("size", "other_size")
    few = members.where(F.col("n") <= FEW)
    left, right = few.select("key", "node", "size"), few.select(F.col("key").alias("k"), F.col("node").alias("other"), F.col("size").alias("other_size"))
    pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("node") < F.col("other")) & sizes_fit).select("node", "other")
    crowded = members.where(F.col("n") > FEW)
    any_crowded = crowded.limit(1).count() > 0
    if any_crowded:
        # every key has an order of its own, so that a text meets others under each of its keys
        signs = nodes.select(F.col("node").alias("m"), "sign").join(crowded.select(F.col("node").alias("m")).distinct(), "m")
        begin = F.pmod(F.col("key"), F.lit(len(FACTORS))).cast("int")
        turned = F.concat(F.substr("sign", begin + 1, F.lit(len(FACTORS))), F.substr("sign", F.lit(1), begin))
        order = Window.partitionBy("key").orderBy(turned, "node")
        ahead = F.array(*[F.lead(F.struct(F.col("node").alias("other"), F.col("size").alias("other_size")), i).over(order) for i in range(1, AHEAD + 1)])
        many = crowded.join(signs, F.col("node") == F.col("m")).select("node", "size", ahead.alias("ahead"))
        many = many.select("node", "size", F.explode("ahead").alias("x")).where("x is not null").select("node", "size", "x.other", "x.other_size").where(sizes_fit)
        pairs = pairs.unionByName(many.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")))
    pairs = cut(pairs.distinct())
    tidy(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    kind = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int32()))])

    def sets_of(used: DataFrame) -> DataFrame:
        """(node, set): the shingle sets of some nodes, from one text each."""
        wanted = nodes.join(used, "node").select("least")
        own = texts.join(wanted, texts["id"] == wanted["least"]).select("text")
        return cut(own.mapInArrow(in_blocks(sets, kind, weigh=0), "node long, set array<int>").dropDuplicates(["node"]))

    found = sets_of(pairs.select("node").union(pairs.select("other")).distinct())
    a, b = found.select(F.col("node").alias("a"), F.col("set").alias("sa")), found.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, F.col("node") == F.col("a")).join(b, F.col("other") == F.col("b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    edges = cut(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select(F.col("node").alias("u"), F.col("other").alias("v")))
    del both, found, a, b
    tidy(docs.sparkSession)
    linked = classes(edges)
    if any_crowded:
        rest = _other_components(crowded, linked, sets_of, similarity)
        if rest is not None:
            linked = classes(linked.toDF("u", "v").unionByName(rest))
        tidy(docs.sparkSession)
    of = nodes.select("node", "least").join(linked.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    of = of.select("node", "least", F.coalesce("component", "node").alias("component"))
    first = of.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    of = of.join(first, F.col("component") == F.col("c")).select(F.col("node").alias("of"), "component_id")
    return marked.join(of, F.col("node") == F.col("of")).select(F.col("id").alias(id_col), "component_id")


def _other_components(crowded: DataFrame, linked: DataFrame, sets_of, similarity: float) -> DataFrame | None:
    """Edges between different components under one crowded key: what is outside the key's largest component meets all others.

    Sizes are put in classes so wide that alike sets are in one or in neighbouring ones, and classes are dealt into blocks by
    hash; a task holds a block of queries and one of members, and no pair is a row of its own. None if every key's texts are one component.
    """
    at = crowded.join(linked.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    at = cut(at.select("key", "node", F.coalesce("component", "node").alias("component"), F.floor(F.ln("size") / math.log(1 / similarity) - 1e-9).cast("int").alias("class"), "size"))
    sizes = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    split = at.join(most.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "node", "component", "class", "size", (F.col("component") != F.col("largest")).alias("minor"))
    split = cut(split)
    if not split.limit(1).count():
        return None
    blocks = lambda rows: F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    minor = split.where("minor").withColumn("to", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
    held = split.groupBy("key", "class").agg(blocks(split).alias("m_blocks"))
    asked = minor.groupBy("key", F.col("to").alias("class")).agg(blocks(minor).alias("q_blocks"))
    grid = held.join(asked, ["key", "class"]).select(F.col("key").alias("k"), F.col("class").alias("c"), "m_blocks", "q_blocks")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = minor.join(grid, (F.col("key") == F.col("k")) & (F.col("to") == F.col("c"))).select("key", F.col("to").alias("class"), own("q_blocks", 1).alias("q"), every("m_blocks").alias("m"), "node", "component")
    members = split.join(grid, (F.col("key") == F.col("k")) & (F.col("class") == F.col("c"))).select("key", "class", every("q_blocks").alias("q"), own("m_blocks", 2).alias("m"), "node", "component")
    found = sets_of(split.select("node").distinct()).withColumnRenamed("node", "n")
    cell = ["key", "class", "q", "m"]
    with_set = lambda rows: rows.join(found, F.col("node") == F.col("n")).select(*cell, "node", "component", "set").toDF(*cell, "node", "component", "set").groupBy(*cell)
    return cut(with_set(queries).cogroup(with_set(members)).applyInArrow(linked_blocks(similarity), "u long, v long").distinct())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, one each; all columns stay.

    Rows with a null id stay, as nothing tells them apart. Of rows that share the id of their group's first, one stays. Null and empty texts are
    copies of each other; no rows give none.
    """
    columns = docs.columns
    first, times = free_name(columns, "first_of_group"), free_name(columns, "rows_of_id")
    found = near_copies(docs, id_col, text_col)
    firsts = cut(found.where(F.col("component_id") == F.col(id_col)).groupBy(F.col("component_id").alias(first)).agg(F.count(F.lit(1)).alias(times)))
    kept = docs.join(firsts, docs[id_col] == firsts[first], "left").where(F.col(first).isNotNull() | F.col(id_col).isNull())
    if firsts.where(F.col(times) > 1).limit(1).count():
        once = kept.where(F.col(times) > 1).dropDuplicates([id_col])
        kept = kept.where((F.col(times) == 1) | F.col(times).isNull()).unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in columns])
