"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import ann, bpe, chat, copies, fingerprint, html, licenses, mixing, quality, simhash, toxicity

DOCS = "doc_id long, text string, source string, lang string, n_chars long, fp long, node long, id long, score double, _copies int, version int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None, 1, 2, 3, 0.5, 4, 5) for i, t, s in rows], DOCS)


ODD = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, None), (3, "", "x"), (None, "lone", "y"), (4, "word " * 60_000, "x"), (5, "<|x|> MIT license\n\x00\U0001f600", None)]
LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, rows=()):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


OPERATORS = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "copies": lambda s, d: copies.near_copies(d),
    "toxicity": lambda s, d: toxicity.scored(d, labels(s)),
    "quality": lambda s, d: quality.scored(d, labels(s)),
    "fingerprint": lambda s, d: fingerprint.edited(d),
    "bpe": lambda s, d: bpe.encoded(d),
    "licenses": lambda s, d: licenses.scanned(d),
    "mixing": lambda s, d: mixing.mixed(d),
    "html": lambda s, d: html.extracted(d.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit(None)).withColumn("html", F.col("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, docs(spark, ODD)).collect()
    assert len(out) == len(ODD)


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_values_of_odd_rows(spark):
    """What each operator makes of repeated rows, null and empty texts, a null id and a very long text."""
    run = lambda name: by_id(OPERATORS[name](spark, docs(spark, ODD)).collect(), "page_id" if name == "html" else "doc_id")
    texts = {i: t or "" for i, t, _ in ODD}
    out = run("simhash")
    assert {i: sorted({r.component_id for r in v}, key=str) for i, v in out.items()} == {1: [1], 2: [2], 3: [2], None: [None], 4: [4], 5: [5]}
    assert out[2][0].fingerprint == out[3][0].fingerprint == "0" * 16 and out[1][0] == out[1][1]
    assert {i: v[0].component_id for i, v in run("copies").items()} == {1: 1, 2: 2, 3: 2, None: None, 4: 4, 5: 5}
    assert all((r.score, r.predicted, r.evidence) == (0.0, 0, []) for v in run("toxicity").values() for r in v)
    assert all((r.score, r.predicted) == (0.5, 1) for v in run("quality").values() for r in v)
    out = run("fingerprint")
    assert {i: v[0].n_chars for i, v in out.items()} == {i: len(t) for i, t in texts.items()}
    assert out[2][0].fingerprint == out[3][0].fingerprint != out[5][0].fingerprint and out[1][0].fingerprint == out[1][1].fingerprint
    assert out[2][0].near_next == 1.0 and sorted(r.near_next for r in out[1])[1] == 1.0
    assert {i: bytes(v[0].decoded).decode() for i, v in run("bpe").items()} == texts and run("bpe")[2][0].n_tokens == 0
    out = run("licenses")
    assert (out[5][0].labels, out[5][0].n_base, out[2][0].labels, out[2][0].first_word, out[4][0].n_words) == ("mit", 1, "", None, 60_000)
    out = run("mixing")
    assert {i: v[0].size for i, v in out.items()} == {1: 6, 2: 0, 3: 0, None: 1, 4: 60_000, 5: 4} and all(0 <= r.taken <= 3 * r.size for v in out.values() for r in v)
    assert all(r.n_chars == len(r.text) for v in run("html").values() for r in v) and run("html")[2][0].text == ""


def test_classifiers_with_labels_of_odd_rows(spark):
    """Null, unknown and repeated labels; texts that are all alike."""
    rows = [(i, f"fine words {i}" if i % 2 else f"vile words {i}", "x") for i in range(60)] + [(100, None, "x"), (101, "", "x")]
    marks = [(i, i % 2, 1 - i % 2) for i in range(60)] + [(0, None, None), (1, 7, 7), (None, 1, 1), (100, 0, 0), (500, 1, 1)]
    for f in (toxicity.scored, quality.scored):
        out = by_id(f(docs(spark, rows), labels(spark, marks)).collect())
        assert len(out) == 62 and all(0 <= r.score <= 1 for v in out.values() for r in v) and out[100][0].score == out[101][0].score
    out = by_id(toxicity.scored(docs(spark, rows), labels(spark, marks)).collect())
    assert out[2][0].score > out[3][0].score


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_filters_of_no_rows(spark):
    none = docs(spark, [])
    for kept in (quality.kept(none, labels(spark)), toxicity.kept(none, labels(spark)), copies.deduplicated(none), mixing.resampled(none), bpe.encoded(none)):
        assert kept.collect() == []


def test_filters_keep_columns(spark):
    own = docs(spark, ODD)
    for kept in (quality.kept(own, labels(spark)), toxicity.kept(own, labels(spark)), copies.deduplicated(own), mixing.resampled(own)):
        assert kept.columns == own.columns
        kept.collect()
    assert toxicity.kept(own, labels(spark)).count() == len(ODD)
    assert sorted(r.doc_id or 0 for r in copies.deduplicated(own).collect()) == [0, 1, 2, 4, 5]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [1.0, 0.5]), (7, [1.0, 0.5])]
    own = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, v int")
    out = ann.neighbours(own).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 6, 0.5), (0, 2, 7, 0.5)]
    assert ann.neighbours(own.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, None, None), (1, None, "user", "a\n<|im_end|>"), (None, 1, "assistant", ""), (1, 0, None, None), (2, 0, "assi\nst&nl;", "&lt;|")]
    own = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    out = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.text_turns(own))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "a\n<|im_end|>"), ("", ""), ("", "")]
    assert [(t.role, t.text) for t in out[2].turns] == [("assi\nst&nl;", "&lt;|")]
    assert out[None].loss_text == ""
    assert chat.formatted(chat.text_turns(own.limit(0))).collect() == []
