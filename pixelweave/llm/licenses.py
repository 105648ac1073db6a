"""License scans: an Aho-Corasick automaton over words, and a parser of licence expressions.

A text's words, joined by single spaces, go once through an automaton of all phrases (each between spaces,
so that only whole words match, places that overlap included). After each place of an identifier tag, what stands before the
next tag or the end of the line is parsed as an expression of ``and``, ``or`` and ``with`` by a shunting-yard parser; all licences
that it names are labels.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm.common import in_blocks, table

#: Fixed phrases of the contract, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the method knows besides.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Families of identifiers: the first prefix that fits gives the label, else the identifier itself.
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "cc-by", "mit", "bsd", "mpl", "epl")

#: Bytes of words stay, A-Z become a-z, all others blanks; bytes of code points beyond ASCII stay.
KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Words as ``KEEP`` leaves them, and what stands after a tag up to the end of its line.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
REST = re.compile(r"[ \t]*:?[ \t]*([^\r\n]*)")


def shunt(text: str) -> list[str]:
    """Postfix form of the longest expression that ``text`` starts with; empty if it starts with none."""
    out: list[str] = []
    stack: list[str] = []
    best: list[str] = []
    want, depth, at = True, 0, 0
    while m := TOKEN.match(text, at):
        token = m[0]
        low = token.lower()
        if want == (low in RANK or token == ")"):
            break
        if token == "(":
            stack.append(token)
            depth += 1
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        elif want:
            out.append(token)
            want = False
        else:
            break
        if not want and not depth:
            best = out + stack[::-1]
        at = m.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    return best


def identifiers(postfix: list[str]) -> set[str]:
    """Licences that any choice of an expression names; exceptions aren't among them."""
    stack: list[set[str]] = []
    for token in postfix:
        if token not in RANK:
            stack.append({token.lower().rstrip("+")})
            continue
        right, left = stack.pop(), stack.pop()
        if token != "with":
            left, right = (left, right) if len(left) >= len(right) else (right, left)
            left |= right
        stack.append(left)
    return stack[0] if stack else set()


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """Choices that an expression allows, each the set of licences that then hold together.

    All of them, which may be as many as two to the power of the number of ``and``: scans leave the postfix form unexpanded.
    """
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in RANK:
            stack.append([frozenset([token.lower().rstrip("+")])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            joined = left + right
        elif token == "and":
            joined = [a | b for a in left for b in right]
        else:  # an exception belongs to its licence and adds no licence
            joined = left
        stack.append(sorted(dict.fromkeys(joined), key=sorted) if token == "and" else joined)
    return stack[0] if stack else []


def label_of(identifier: str) -> str:
    return next((f for f in FAMILIES if identifier == f or identifier.startswith(f"{f}-")), identifier)


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(KEEP).split()
    line = b" " + b" ".join(words) + b" "
    line = line.decode("latin-1")
    places, base, labels, tags = [], set(), set(), []
    for end, (size, label, own) in automaton().iter(line):
        if own:
            places.append(end + 1 - size)
            base.add(label)
        elif label:
            labels.add(label)
        else:
            tags.append(end + 1 - size)
    expressions = []
    if tags:
        spans = [m.span() for m in WORD.finditer(text)]
        firsts, n = [], 0
        for before, place in zip([0, *tags], tags):
            n += line.count(" ", before, place)
            firsts.append(n)
        for i, n in zip(firsts, [*firsts[1:], None]):
            m = REST.match(text, spans[i + TAG.count(" ")][1], len(text) if n is None else spans[n][0])
            if postfix := shunt(m[1]):
                expressions.append(" ".join(postfix))
                labels |= {label_of(x) for x in identifiers(postfix)}
    at = [line.count(" ", 0, p) for p in ((min(places), max(places)) if places else ())] or [None, None]
    labels |= base
    # each place or tag halves the doubt; notices without a name count as one
    score = 1 - 0.5 ** (len(places) + 2 * len(expressions) + bool(labels - base)) if labels else 0.0
    return len(words), len(places), *at, ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions


FIELDS = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "expressions": pa.list_(pa.string()),
}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans every whole text for licences.

    One row per input row: the id column, n_words, n_base (places of base phrases, all that overlap counted), first_word and
    last_word (null without a place), base_labels and labels (distinct, sorted, comma-joined; empty if none), score
    (0 without a label) and expressions (postfix form of each tag's expression). A null or empty text has no words. A tag
    without a well-formed expression adds nothing. Very long texts are scanned whole. No rows give none. Repeated rows give repeated results; other columns are dropped.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = docs.schema[id_col].dataType
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"

    def work(columns: list[pa.Array]) -> list:
        found = [scan(x) for x in columns[1].to_pylist()]
        return [columns[0], *map(list, zip(*found, strict=True))]

    schema = pa.schema([("id", to_arrow_type(key)), *FIELDS.items()])
    return given.mapInArrow(in_blocks(work, schema, weigh=1), f"id {key.simpleString()}, {kinds}").withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scanned."""
    return scanned(table(spark, sf_dir, "documents")).drop("expressions")
