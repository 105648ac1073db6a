"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A block of documents becomes one array of code points. A table gives each code point its class; looking
one or two places ahead turns classes into the symbols of a small automaton whose states say what token a
character stands in. Every symbol is a function from states to states, and these functions are closed under
composition: the closure is enumerated once, with a composition table. The states before all characters
then follow by a scan with that associative operation: columns of a matrix are composed row by row, the
rows' totals by doubling, and the rows' first states are fed back. No regular expression is run. The slices
between boundaries go through a cache of merged pieces; the lengths of pieces and tokens are kept, so that
decoding is a gather by offset.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm.common import in_blocks, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Classes of code points.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE = range(6)
#: Symbols: letter; number; other; apostrophe before one or two letters of a contraction; white space before
#: more of it or the end; the space before something else; other white space before something else.
L, N, O, C2, C3, WI, SL, WL = range(8)
#: States: none, in letters, numbers, others, white space, after a space that joins, one or two letters to go.
NONE, IN_L, IN_N, IN_O, IN_W, JOIN, ONE, TWO = range(8)
#: Fixed values of the pattern: 's 't 'm 'd and 're 've 'll.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Pieces that a worker keeps merged.
CACHE = 1 << 18
WIDTH = 256
#: Bytes of texts that are encoded together, beside the one that ends a block.
BLOCK = 1_500_000


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this symbol."""
    if symbol == L:
        if state in (ONE, TWO):
            return (NONE if state == ONE else ONE), False
        return IN_L, state not in (IN_L, JOIN)
    if symbol == N:
        return IN_N, state not in (IN_N, JOIN)
    if symbol == O or symbol in (C2, C3) and state in (IN_O, JOIN):
        return IN_O, state not in (IN_O, JOIN)
    if symbol in (C2, C3):
        return (ONE if symbol == C2 else TWO), True
    if symbol == WI:
        return IN_W, state != IN_W
    return (JOIN if symbol == SL else NONE), True


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol (8 more for a text's first), composition, value at each state, starts."""
    base = [tuple(step(s, x)[0] for s in range(8)) for x in range(8)]
    base += [(step(NONE, x)[0],) * 8 for x in range(8)]
    found = {tuple(range(8)): 0}
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    values = np.array(list(found), np.uint8)
    then = np.array([[found[tuple(g[x] for x in f)] for g in found] for f in found], np.uint8 if len(found) < 256 else np.uint16)
    starts = np.array([[step(s, x)[1] for x in range(8)] for s in range(8)], bool)
    return np.array([found[f] for f in base], then.dtype), then, values, starts


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LNZ":
            out[i] = {"L": LETTER, "N": NUMBER, "Z": BLANK}[kind]
    out[[*range(9, 14), 0x85]] = BLANK
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where tokens start in ``points``, the code points of texts that begin at the places ``first``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)
    head[first[first < n]] = True
    head[n] = True
    blank = (kind == SPACE) | (kind == BLANK)
    ends = head[1:].copy()
    ends[:-1] |= blank[1:]
    symbol = np.array([L, N, SL, WL, O, O], np.uint8)[kind]
    symbol[blank & ends] = WI
    for i in np.flatnonzero((kind == QUOTE) & ~head[1:]):
        after = chr(points[i + 1])
        if after in SHORT:
            symbol[i] = C2
        elif i + 2 < n and not head[i + 2] and after + chr(points[i + 2]) in LONG:
            symbol[i] = C3
    own, then, values, starts = machine()
    rows = -(-n // WIDTH)
    f = np.zeros(rows * WIDTH, np.uint8)
    f[:n] = symbol + 8 * head[:n]
    f = np.ascontiguousarray(own[f].reshape(rows, WIDTH).T)
    for j in range(1, WIDTH):  # compositions of the row up to each column
        f[j] = then[f[j - 1], f[j]]
    total, d = f[-1].copy(), 1
    while d < rows:  # of all rows up to each row
        total[d:] = then[total[:-d], total[d:]]
        d *= 2
    before = np.zeros(rows, np.uint8)
    before[1:] = values[total[:-1], NONE]
    state = np.empty((rows, WIDTH), np.uint8)
    state[:, 0] = before
    state[:, 1:] = values[f[:-1], before[None, :]].T
    return np.flatnonzero(starts[state.reshape(-1)[:n], symbol] | head[:n])


class Codec:
    """Ranks, the pairs that merge, and pieces merged so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        spelled = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids, self.n = np.zeros(1 << 16, np.uint32), 0
        self.where, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost first, until none is left."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        parts, get, none = [self.single[x] for x in piece], self.pairs.get, 1 << 30
        if len(parts) > 200:
            return self.merge_long(parts)
        ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(best << 20 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | best, none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        import heapq

        n, get = len(parts), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (found, x, parts[x], parts[y]))
        return [x for x in parts if x >= 0]

    def pieces(self, found: list[str]) -> np.ndarray:
        """Where the cache holds each piece."""
        if len(self.cache) > CACHE:
            self.forget()
        out = np.fromiter(map(self.cache.get, found, repeat(-1)), np.int64, len(found))
        for i in np.flatnonzero(out < 0).tolist():
            piece = found[i]
            k = self.cache.get(piece)
            if k is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                k = self.cache[piece] = len(self.cache)
                if k == len(self.where):
                    self.where, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.where, self.count))
                while self.n + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.n : self.n + len(ids)] = ids
                self.where[k], self.count[k] = self.n, len(ids)
                self.n += len(ids)
            out[i] = k
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets at which each text's ids begin and end."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *map(len, texts)])
        starts = boundaries(points, first)
        edges = [*starts.tolist(), len(whole)]
        at = self.pieces([whole[a:b] for a, b in zip(edges, edges[1:])])
        ids, tokens = gather(self.ids, self.where[at], self.count[at])
        return ids, tokens[np.searchsorted(starts, first)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the offsets at which each id's bytes begin and end."""
        return gather(self.bytes, self.at[ids], self.size[ids])


def gather(values: np.ndarray, where: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values``, laid end to end, and their offsets."""
    edges = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=edges[1:])
    index = np.repeat(where - edges[:-1], count)
    index += np.arange(edges[-1])
    return values[index], edges


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encodes every whole text, and decodes the ids again.

    Returns one row per input row: the id column, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``,
    token_ids and, with ``decoded`` too, decoded (binary). A null text is an empty one: no ids, the digests of nothing. Repeated rows give
    repeated results; other columns aren't returned, so their names can't clash. Texts are cut into blocks
    of whole documents, whose size bounds memory; pieces of any length are merged in n log n.
    ``path`` is a file of ranks (default: that of public_tokenizers, looked up on each worker).
    """
    key = docs.schema[id_col].dataType
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("token_ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.binary())] * (ids and decoded)

    def work(columns: list[pa.Array]) -> list:
        own = codec(path or public_tokenizers.path(RANKS))
        texts = [x or "" for x in columns[1].to_pylist()]
        out, edges = own.encode(texts)
        back, places = own.decode(out)
        edge, raw, plain = edges.tolist(), memoryview(out.astype("<u4")).cast("B"), memoryview(back)
        place = places[edges].tolist()
        spans = list(zip(edge, edge[1:]))
        parts = list(zip(place, place[1:]))
        result = [
            columns[0],
            np.diff(edges),
            [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans],
            [hashlib.sha256(plain[a:b]).hexdigest() for a, b in parts],
        ]
        if ids:
            result.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(out.view(np.int32))))
            if decoded:
                result.append([bytes(plain[a:b]) for a, b in parts])
        return result

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(key)), *fields])
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids + ", decoded binary" * (ids and decoded)
    return given.mapInArrow(in_blocks(work, schema, weigh=1, most=BLOCK), f"id {key.simpleString()}, {kinds}").withColumnRenamed("id", id_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return encoded(table(spark, sf_dir, "documents"), ids=False)
