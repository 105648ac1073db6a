import base64
import hashlib
import itertools

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pixelweave.llm import bpe, labelled, quality, toxicity
from pixelweave.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


def classified(spark, docs, label, model):
    """Examples gathered row by row, the model fitted here, and every text scored by itself."""
    marks = {r.doc_id: r[label] for r in table(spark, SF, "labels").where(~held_out()).collect()}
    turns = {r.doc_id: r.turn for r in docs.select("doc_id", F.xxhash64("doc_id").alias("turn")).collect()}
    rows = docs.collect()
    examples = sorted(((r.doc_id, r.text or "", marks[r.doc_id]) for r in rows if r.doc_id in marks), key=lambda x: (turns[x[0]], x[0], x[1]))
    assert len(examples) <= labelled.SAMPLE
    fitted = model(examples)
    return {r.doc_id: fitted.scores([r.text])[0] if label == "quality" else fitted.score(r.text)[0] for r in rows}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def firsts(rows):
    """The least id of every group that links of equal words or of 0.8 of the five-word shingles make."""
    words = {r.doc_id: r.text.lower().encode().split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    up = {i: i for i in words}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(words), 2):
        if words[a] == words[b] or words[a] and words[b] and alike(sets[a], sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted({find(i) for i in words})


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = docs.collect(), sorted(r.doc_id for r in out.collect())
        if name == "quality":
            scores = classified(spark, docs, "quality", quality.Model)
            assert after == sorted(k for k, x in scores.items() if x >= 0.5) and len(after) < len(before)
        elif name == "toxicity":
            scores = classified(spark, docs, "toxic", toxicity.Model)
            assert after == sorted(k for k, x in scores.items() if x < 0.7)
        elif name == "near_dedup":
            assert after == firsts(before) and len(after) < len(before)
        elif name == "mixing":
            size = {r.doc_id: len(r.text.encode().split()) for r in before}
            source = {r.doc_id: r.source for r in before}
            assert max(after.count(k) for k in after) <= 3 and set(after) <= set(size)
            assert abs(sum(size[k] for k in after) - sum(size.values())) <= 0.02 * sum(size.values())
            first = min(set(source.values()))
            assert sum(size[k] for k in after if source[k] == first) > sum(n for k, n in size.items() if source[k] == first)
        else:
            path = public_tokenizers.path(bpe.RANKS)
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            texts = {r.doc_id: r.text for r in before}
            assert after == sorted(r.doc_id for r in before)
            for r in out.collect():
                ids = own.encode_ordinary(texts[r.doc_id])
                assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_run_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows; without labels no classifier drops any."""
    rows = [(1, "a b c d e f", "en", "x", 11), (1, "a b c d e f", "en", "x", 11), (2, None, None, None, None), (3, "", None, "x", 0), (None, "lone words", None, "y", 10), (4, "word " * 30_000, "de", "x", 150_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 2, 4, None} and all(r.n_tokens >= 0 for r in out)
