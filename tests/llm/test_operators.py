"""Each operator against brute force, a round trip, or held-out labels."""

import base64
import hashlib
import itertools
import pickle
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import pixelweave.llm
from pixelweave.llm import ann, bpe, chat, copies, fingerprint, html, licenses, mixing, quality, simhash, toxicity
from pixelweave.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_of(text, k=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    out = {r.doc_id: r for r in simhash.op1_simhash(spark, SF).collect()}
    ids = sorted(texts)
    prints = [simhash_of(texts[i]) for i in ids]
    assert [out[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [out[i].component_id for i in ids] == [ids[c] for c in components(len(ids), links)]


@pytest.mark.parametrize("few", [(64, 512), (3, 3)])
def test_simhash_links(spark, monkeypatch, few):
    """Chains and dense groups of fingerprints; with a low bound on pairs, keys are split by further deletions."""
    monkeypatch.setattr(simhash, "FEW", few[0])
    monkeypatch.setattr(simhash, "FEW_WHOLE", few[1])
    r = random.Random(5)
    prints = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            prints.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(r.choice((1, 2, 2, 3))):
                x ^= 1 << r.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2]
    assert [found.get(x, x) for x in prints] == [prints[c] for c in components(len(prints), links)]


@pytest.mark.parametrize("few", [(48, 12), (3, 1)])
def test_near_copies(spark, monkeypatch, few):
    """With a low bound on pairs, keys with more texts are settled in two rounds."""
    monkeypatch.setattr(copies, "FEW", few[0])
    monkeypatch.setattr(copies, "AHEAD", few[1])
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(6):
            own = list(base)
            for _ in range(r.choice((0, 1, 2, 8))):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    out = {r.doc_id: r.component_id for r in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i, _ in rows] == components(len(rows), links)


def test_bpe_against_library(spark, texts):
    path = public_tokenizers.path(bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encoded(table(spark, SF, "documents").limit(60)).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.token_ids, r.n_tokens, bytes(r.decoded)) == (ids, len(ids), texts[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    r, alphabet = random.Random(1), " \n\t'sterlmdvab1２é　!?$中🙂\x85\x1c"
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["a" * 3000, "'" * 300, " " * 777 + "x"]
    ids, edges = bpe.codec(path).encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [own.encode_ordinary(x) for x in odd]


def test_licenses():
    n, base, first, last, labels, every, score, found = licenses.scan("Under the MIT License mit license.\n// SPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception OR GPL-2.0+) AND BSD-3-Clause\nCC  BY")
    assert (base, first, last, labels) == (3, 2, n - 2, "cc-by,mit")
    assert every == "apache,bsd,cc-by,gpl,mit" and 0 < score < 1
    assert licenses.evaluate(licenses.shunt("MIT and (Apache-2.0 or GPL-2.0 with Classpath) x")) == [frozenset({"mit", "apache-2.0"}), frozenset({"gpl-2.0", "mit"})]
    assert licenses.shunt("or MIT") == [] and licenses.shunt("MIT or") == ["MIT"] and licenses.shunt("(MIT") == []
    assert licenses.scan("commit license")[1] == 0 and licenses.scan(None)[:4] == (0, 0, None, None)


def test_licenses_of_many_choices():
    text = " and ".join(f"(a{i} or b{i})" for i in range(7))
    assert licenses.scan(f"SPDX-License-Identifier: {text}")[5].split(",") == sorted(f"{x}{i}" for x in "ab" for i in range(7))
    assert len(licenses.evaluate(licenses.shunt(text))) == 128
    assert licenses.identifiers(licenses.shunt("GPL-2.0+ with Classpath and (MIT or MIT)")) == {"gpl-2.0", "mit"}


def test_licenses_of_many_tags_in_a_line():
    text = "é MIT License a.c SPDX-License-Identifier: MIT b.c SPDX-License-Identifier: Apache-2.0 OR SPDX-License-Identifier: BSD-3-Clause\nSPDX License Identifier EPL-2.0\nGPL-2.0"
    assert licenses.scan(text)[5:6] + licenses.scan(text)[7:] == ("apache,bsd,epl,mit", ["MIT", "Apache-2.0", "BSD-3-Clause", "EPL-2.0"])


def test_licenses_against_brute_force(spark, texts):
    """The query's columns for every text, phrase by phrase; the method's own labels by looking for them word by word."""
    import re

    out = {r.doc_id: r for r in licenses.op9_license_scan(spark, SF).collect()}
    assert sorted(out) == sorted(texts)
    for i, text in texts.items():
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

        def places(phrase, own=own):
            wanted = phrase.split()
            return [k for k in range(len(own) - len(wanted) + 1) if own[k : k + len(wanted)] == wanted]

        found = {p: places(p) for p in licenses.BASE}
        at = sorted(x for v in found.values() for x in v)
        base = {licenses.BASE[p] for p, v in found.items() if v}
        labels = base | {label for p, label in licenses.NOTICES.items() if places(p)}
        for rest in re.findall(r"(?i)spdx[^a-z0-9\n]+license[^a-z0-9\n]+identifier[ \t]*:?[ \t]*([^\n]*)", text):
            labels |= {licenses.label_of(x.lower().rstrip("+")) for x in re.findall(r"[\w.+-]+", rest)[:1]}
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(at), at[0] if at else None, at[-1] if at else None)
        assert r.base_labels == ",".join(sorted(base)) and set(r.labels.split(",")) - {""} >= labels and (r.score > 0) == bool(r.labels)


def test_mixing_against_brute_force(spark, texts):
    """Targets by pouring out the excess source by source; what the mix takes, of whole copies and at most one more."""
    sources = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    size = {}
    for i, s in sources.items():
        size[s] = size.get(s, 0) + len(texts[i].encode().split())
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    out = mixing.op10_source_mixing(spark, SF).collect()
    for r in out:
        s = sources[r.doc_id]
        assert (r.size, r.source_size, r.target) == (len(texts[r.doc_id].encode().split()), size[s], pytest.approx(target[s]))
        rate = target[s] / size[s] if size[s] else 0
        if r.size:
            assert r.taken / r.size in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    for s in order:
        own = [r for r in out if sources[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own) / 2  # sources of a few documents can't come nearer than those allow


def test_inclusion_frequencies(spark):
    """Over many mixes with other hashes, documents are taken about as often as their source's rate says, long ones like short ones."""
    rows = [(i, "w " * (1 + i % 17)) for i in range(400)]
    taken = {"short": [], "long": []}
    for shift in range(6):
        own = spark.createDataFrame([(i + 1000 * shift, t, "a") for i, t in rows] + [(90_000 + i, "w " * 5, "b") for i in range(600)], "doc_id long, text string, source string")
        out = mixing.mixed(own).where("source = 'a'").collect()
        for r in out:
            taken["long" if r.size > 8 else "short"].append(r.copies)
        rate = out[0].target / out[0].source_size
    for k, copies_ in taken.items():
        assert abs(np.mean(copies_) - rate) < 0.06


def test_mixing(spark, texts):
    out = mixing.op10_source_mixing(spark, SF).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all()
    assert out["size"].tolist() == [len(texts[i].encode().split()) for i in out["doc_id"]]
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    again = mixing.op10_source_mixing(spark, SF).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mixing_by_levels(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), group=16).toPandas()
    assert len(out) == 900
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 60


def test_targets_fill_up(spark):
    rows = [("a", 1), ("b", 100), ("c", 1000), (None, 10)]
    out = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    level = (1111 - 3 - 30) / 3  # a (weight 5) and the null source (5) stop at three times their size; b at 300
    level = (1111 - 3 - 30 - 300) / 1 if level * 2 > 300 else level
    assert out == {"a": 3.0, None: 30.0, "b": 300.0, "c": pytest.approx(level)}


def test_chat_parts(spark):
    kind = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    rows = [
        (1, 0, "user", [("text", "see <", None, None), ("image", None, "a.png", None), ("text", "|im_end|> & <b>", None, None), ("audio", None, "b.wav", 7)]),
        (1, 1, "assistant", [("text", "ok <|image_0|>", None, None), ("document", None, "c.pdf", None)]),
    ]
    out = chat.formatted(spark.createDataFrame(rows, kind))
    row = out.collect()[0]
    assert [(a.number, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 7), (2, "document", "c.pdf", 512)]
    assert row.n_tokens_expanded == 775 and row.formatted.count("<|im_end|>") == 2
    back = chat.read_back(out).collect()[0]
    assert back.turns[0].text == "see <<|image_0|>|im_end|> & <b><|audio_1|>" and back.loss_text == "ok <|image_0|><|document_2|>"


def test_fingerprints(spark, texts):
    out = {r.doc_id: r for r in fingerprint.op5_fingerprint(spark, SF).collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        own, following = texts[k], texts[ids[(i + 1) % len(ids)]]
        cut = len(own) // 4
        assert out[k].edited_sha256 == hashlib.sha256((own[: len(own) - cut] + following[:cut]).encode()).hexdigest()
        assert out[k].n_chars == len(own)
    assert len({(texts[k], out[k].fingerprint) for k in ids}) == len(set(texts.values())) == len({r.fingerprint for r in out.values()})
    assert np.mean([r.near_edited for r in out.values()]) > 0.6 > 0.2 > np.mean([r.near_next for r in out.values()])


def lanes_of(text):
    """The fingerprint's 35 longs, worked out hash by hash."""
    counts, count, halves = [0] * 64, 0, [0, 0]
    seeded = xxhash.xxh64_intdigest((5).to_bytes(4, "little"), 42)
    for line in text.split("\n"):
        words = line.split(" ")
        for item in ([line], *zip(words, words[1:])):
            h, d = 42, seeded
            for x in item:
                h, d = xxhash.xxh64_intdigest(x.encode(), h), xxhash.xxh64_intdigest(x.encode(), d)
            count += 1
            halves = [(halves[0] + (d & 0xFFFFFFFF)) & 0xFFFFFFFF, (halves[1] + (d >> 32)) & 0xFFFFFFFF]
            for j in range(64):
                counts[j] += h >> j & 1
    return counts, halves, count


def spelled(lanes):
    counts, halves, count = lanes
    return "".join(f"{x:016X}" for x in [*[counts[j + 32] << 32 | counts[j] for j in range(32)], *halves, count])


def like(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * k - lanes[2] for k in lanes[0]] for lanes in (a, b))
    sizes = sum(i * i for i in x) + sum(i * i for i in y)
    return max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y)) / sizes) if sizes else 0.0


def test_fingerprints_recomputed(spark, texts):
    """Fingerprints and likeness of the query, by brute force."""
    out = {r.doc_id: r for r in fingerprint.op5_fingerprint(spark, SF).collect()}
    ids = sorted(texts)
    for i in [*range(0, len(ids), 9), len(ids) - 1]:
        own, following = texts[ids[i]], texts[ids[(i + 1) % len(ids)]]
        if len(own) + len(following) > 20_000:
            continue
        cut = len(own) // 4
        changed = own[: len(own) - cut] + following[:cut]
        a, b, c = lanes_of(own), lanes_of(changed), lanes_of(following)
        r = out[ids[i]]
        assert (r.fingerprint, r.edited_fingerprint) == (spelled(a), spelled(b))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(a, b)), pytest.approx(like(a, c)))


def test_fingerprints_add_up(spark):
    rows = [(1, "a b\nc d e\nf"), (2, "f\na b\nc d e"), (3, "a b\nf"), (4, "c d e"), (5, "a b\nc d e")]
    found = fingerprint.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    v = {r.doc_id: r.fingerprint for r in found.collect()}
    assert v[1] == v[2] != v[3]
    pair = spark.createDataFrame([(v[3], v[4], v[1])], "a array<long>, b array<long>, c array<long>")
    row = pair.select(fingerprint.added(F.col("a"), F.col("b")).alias("sum"), fingerprint.removed(F.col("c"), F.col("b")).alias("rest"), fingerprint.read(fingerprint.spelled(F.col("a"))).alias("same")).first()
    assert (row["sum"], row["rest"], row["same"]) == (v[1], v[3], v[3])


def test_neighbours_recall(spark):
    own = table(spark, SF, "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in own.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for r in ann.op7_ann(spark, SF).collect():
        d = np.sqrt(((x - x[ids == r.query_id][0]) ** 2).sum(axis=1))
        d[ids == r.query_id] = np.inf
        assert r.score == d[ids == r.vec_id][0]
        hits += r.vec_id in ids[np.lexsort((ids, d))[:10]]
        total += 1
    assert total == 10 * sum(ids % 100 == 0) and hits / total >= 0.9


def test_pigeonhole():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[1000:2000] = codes[:1000] ^ np.packbits(rng.random((1000, 64)) < 0.1, axis=1)
    index = ann.Index(codes)
    for radius in (0, 3, 7, 8, 11, 20, 28, 64):
        for code in codes[:20]:
            away = np.bitwise_count(codes ^ code).sum(axis=1)
            assert index.within(code, radius).tolist() == np.flatnonzero(away <= radius).tolist()


def test_near_copies_of_a_crowded_group(spark):
    """Hundreds of variants of one text, alike by 0.4 to 1: classes and links against exact similarities."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [r.choice(words) for _ in range(130)]
    rows = []
    for i in range(420):
        own = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 5, 8, 12))):
            own[r.randrange(len(own))] = r.choice(words)
        rows.append((i, " ".join(own[: r.choice((130, 130, 125, 100))])))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    out = {x.doc_id: x.component_id for x in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i] for i, _ in rows] == components(len(rows), links)
    assert len(set(out.values())) > 20


def test_common_counts():
    r = np.random.default_rng(2)
    a, b = ([np.unique(r.integers(-50, 50, n)).astype(np.int32) for n in sizes] for sizes in ((0, 5, 80, 200), (1, 0, 60)))
    assert copies.common_counts(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert copies.common_counts([], b).shape == (0, 3)


def test_near_copies_of_crowded_keys_lose_no_link(spark, monkeypatch):
    # the first and last share one key, in whose order the other stands between them, and fewer than 17 of 30 places
    r = random.Random(6)
    texts = [" ".join(f"w{j}" if r.random() > 0.06 else f"x{i}y{j}" for j in range(40)) for i in range(14)]
    rows = [(0, texts[2]), (1, texts[6]), (2, texts[5])]
    (_, a), (_, b) = (copies.signature(copies.shingles(rows[i][1].encode(), 5)[1]) for i in (0, 2))
    assert sum(x == y for x, y in zip(a, b)) < 17
    monkeypatch.setattr(copies, "FEW", 1)
    monkeypatch.setattr(copies, "AHEAD", 1)
    out = copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.56).collect()
    assert {x.doc_id: x.component_id for x in out} == {0: 0, 1: 1, 2: 0}


def jobs(spark, work):
    """How many Spark jobs ``work`` runs, and what it returns."""
    context, group = spark.sparkContext, f"counted {work}"
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group)), out


def test_near_copies_take_few_jobs(spark):
    """A chain of 300 texts, each alike to the next alone, is one class; the driver has no rounds of joins to keep account of."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(300)]
    n, out = jobs(spark, lambda: copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {x.component_id for x in out} == {0} and len(out) == 300
    assert n <= 40


def test_classes_of_links(spark, monkeypatch):
    r = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(180)] + [(90, 90)]
    r.shuffle(links)
    want = {x: components(400, links)[x] for pair in links for x in pair}
    given = spark.createDataFrame([r.sample(x, 2) for x in links], "u long, v long").repartition(3)
    at_once = copies.classes(given).collect()
    assert sorted(map(tuple, at_once)) == sorted(want.items())
    assert copies.classes(given.limit(0)).collect() == []
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links[i : i + 50])], ["u", "v"]) for i in range(0, len(links), 50)]
    assert len(list(copies.stars(iter(batches)))) == 1
    monkeypatch.setattr(copies, "TASK_LINKS", 20)
    parts = list(copies.stars(iter(batches)))
    assert len(parts) == 15 and sum(b.num_rows for b in parts) > len(want)
    joined = {x.node: x.component for x in copies.classes(given).collect()}
    assert all(joined.get(x, x) == c for x, c in want.items())


def test_form_of_a_long_word():
    assert quality.form_of("a" * 100 + "?b1") == "x?x0" and quality.form_of("Ab1" * 40 + "!").endswith("0!")


def test_toxicity_of_few_examples():
    rows = [(i, f"plain words of number {i} and more", 0) for i in range(40)] + [(40, "vile rant that is rare enough to stand once", 1)]
    score, at, cosines = (model := toxicity.Model(rows)).score("vile rant that is rare enough")
    assert model.ids[at[0]] == 40 and cosines[0] > 0.5 and score > model.score("plain words and more")[0]


@pytest.mark.parametrize("frequent", [256, 3, 0])
def test_toxicity_is_exact(monkeypatch, frequent):
    """Ids, ties and cosines of the nearest against TF-IDF vectors worked out word by word."""
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    r = random.Random(4)
    plain, bad = [f"w{i}" for i in range(60)], ["vile", "foul", "nasty"]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        own = [r.choice(plain) for _ in range(20)] + ([r.choice(bad) for _ in range(3)] if toxic else [])
        rows.append((1000 + i, " ".join(own), int(toxic)))
    rows += [(5000 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(7000, "", 1)]  # ties
    model = pickle.loads(pickle.dumps(toxicity.Model(rows)))
    own = rows[:-1]
    rate = (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)

    def weight_of(word):
        seen = [y for _, t, y in own if word in t.split()]
        p = min(max(sum(seen) / len(seen), 1e-12), 1 - 1e-12)
        ratio = len(seen) * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))
        return np.log((len(own) + 1) / len(seen)) * (1 + np.sqrt(ratio if p > rate else 0))

    known = sorted({w for _, t, _ in own for w in t.split()})
    weights = {w: weight_of(w) for w in known}

    def vector(text):
        n = [text.split().count(w) for w in known]
        v = np.array([weights[w] * (1 + np.log(k)) if k else 0 for w, k in zip(known, n)])
        return v / np.linalg.norm(v)

    dense = np.array([vector(t) for _, t, _ in own])
    for text in ("a vile foul thing", "nasty nasty w5", rows[0][1], rows[17][1], "w1 w2 w2 vile"):
        cosines = (dense @ vector(text)).round(9)
        order = np.lexsort((np.arange(len(own)), -cosines))
        order = order[cosines[order] > 0]
        at, times = model.terms_of(text)
        for k in (1, 7, 40, 5000):
            found, got = model.nearest(at, model.vector(at, times), k)
            by_place = np.lexsort((found, -got.round(9)))
            assert np.allclose(got, cosines[order[:k]])
            cut = cosines[order[:k]][-1]  # ties at the cut are decided by the last digits
            sure = lambda ids: {int(i) for i in ids if cosines[i] > cut}
            assert found[by_place][: len(sure(found))].tolist() == order[: len(sure(found))].tolist() and sure(found) == sure(order[:k])
        evidence = model.score(text)[1]
        same = [i for i, (_, t, _) in enumerate(own) if sorted(t.split()) == sorted(text.split())]
        assert len(evidence) == toxicity.K and sum(i in same for i in evidence) == max(0, len(same) - 1)
    assert model.score("something vile and foul")[0] >= 0.7 > 0.2 > model.score("w1 w2 w3")[0]
    assert model.score("")[0] == pytest.approx((1 + rate) / 2) and model.score("--")[1].tolist() == [] == model.score("unheard")[1].tolist()


def test_toxicity_is_calibrated():
    """Expected error of the scores of made texts whose labels are partly chance: a curve of two parameters can't flatten what the votes vary by."""
    plain = [f"w{i}" for i in range(300)]
    found = []
    for seed in range(4):
        r = random.Random(seed)

        def text(r=r):
            y = r.random() < 0.3
            word = "vile" if r.random() < (0.9 if y else 0.05) else "fine"
            return " ".join([r.choice(plain) for _ in range(12)] + [word] * 3), int(y)

        model = toxicity.Model([(i, *text()) for i in range(3000)])
        found += [(model.score(t)[0], y) for t, y in (text() for _ in range(1500))]
    off = 0.0
    for low in np.arange(0, 1, 0.1):
        own = [x for x in found if low <= x[0] < low + 0.1 or low > 0.85 and x[0] == 1]
        off += abs(sum(s for s, _ in own) - sum(y for _, y in own))
    assert off / len(found) < 0.06


def test_fitting_bounds_bytes(spark, monkeypatch):
    from pixelweave.llm import labelled

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(30)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int")
    ids = lambda: labelled.fitted(labelled.labelled_sample(docs, marks, "toxic"), lambda rows: [i for i, _, _ in rows])()
    every = ids()
    assert sorted(every) == [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 550)
    assert ids() == every[:5]


def test_classifiers_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    good = {r.doc_id: r for r in quality.op4_quality(spark, sf).where("held_out").collect() if r.doc_id in labels}
    assert len(good) > 80 and np.mean([r.predicted == labels[i].quality for i, r in good.items()]) >= 0.95
    toxic = [r for r in toxicity.op2_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    clean = [r.predicted for r in toxic if not labels[r.doc_id].toxic]
    assert np.mean(clean) <= 0.02 and np.mean([r.predicted for r in toxic if labels[r.doc_id].toxic]) >= 0.75
    assert all(0 <= r.score <= 1 for r in (*good.values(), *toxic))


def shares(pages, trees):
    """Characters of right blocks among those extracted, and among those of main text."""
    right = wrong = missed = 0
    for page, main in pages:
        got = html.extract([page], trees)[0]
        truth = [x.text for x in html.parse(page) if x.tag == "" and x.text in main]
        right += sum(len(x) for x in got if x in main)
        wrong += sum(len(x) for x in got if x not in main)
        missed += sum(len(x) for x in truth if x not in got)
    return right / (right + wrong), right / (right + missed)


def test_extraction_of_families_held_out():
    """Trees that never saw three of the families, on pages of these alone."""
    apart = ("docs", "portal", "archive")
    trees, r = html.forest(families=tuple(f for f in html.FAMILIES if f not in apart)), random.Random(77)
    assert min(shares([html.made_page(r, apart) for _ in range(150)], trees)) > 0.95


def test_extraction_of_pages_written_by_hand():
    """Pages of shapes that no template has."""
    forum = (
        "<html><body bgcolor=white><center><a href=/>Index</a> <a href=/faq>FAQ</a> <a href=/reg>Register</a></center><hr><div id=story><h2>How we mended the old mill wheel</h2>"
        "<div>The wheel had stood still for nine winters, and the river had taken half of its paddles by the time we came to look at it.</div>"
        "<div>We cut new paddles from larch, because oak was dear, and soaked them for a month in the pond behind the barn.</div><ol><li>Take off the iron rim.</li><li>Turn the hub by hand.</li></ol></div>"
        "<div class='thread'><div class=reply><b>anna</b><p>Lovely work, we did the same with ours last year!</p></div><div class=reply><b>tom</b><p>Which oil did you use?</p></div></div>"
        "<div class=colophon>Powered by mill software. All rights reserved.</div></body></html>",
        ["How we mended the old mill wheel", "The wheel had stood still for nine winters, and the river had taken half of its paddles by the time we came to look at it.",
         "We cut new paddles from larch, because oak was dear, and soaked them for a month in the pond behind the barn.", "Take off the iron rim.", "Turn the hub by hand."],
    )
    recipe = (
        "<!doctype html><body><header class='hero'><div class=logo>Kitchen Table</div><nav><ul><li><a href=/a>Soups</a><li><a href=/b>Breads</a><li><a href=/c>About us</a></ul></nav></header>"
        "<main><section class='recipe'><h1>Rye bread in two days</h1><p>This loaf asks for patience and little else; most of the time it is left alone in a bowl.</p><h2>What you need</h2>"
        "<ul><li>500 g of rye flour</li><li>400 g of water</li></ul><p>Mix, cover, wait until it has risen by half, and bake it hot and dark until it sounds hollow.</p></section></main>"
        "<aside class='newsletter-signup'><p>Get our best loaves by mail every Sunday.</p><form><input><button>Join</button></form></aside>"
        "<section class=related><h3>More breads</h3><ul><li><a href=/1>Wheat rolls</a></li><li><a href=/2>Corn cakes</a></li></ul></section><footer>&copy; Kitchen Table <a href=/imprint>Imprint</a></footer>",
        ["Rye bread in two days", "This loaf asks for patience and little else; most of the time it is left alone in a bowl.", "What you need", "500 g of rye flour", "400 g of water",
         "Mix, cover, wait until it has risen by half, and bake it hot and dark until it sounds hollow."],
    )
    notes = (
        "<html><head><title>3.2</title></head><body><div class=cookie-notice>We use cookies to count visits. <button>Fine</button></div><div class=breadcrumbs><a href=/>Home</a> &gt; <a href=/d>Docs</a></div>"
        "<article class=doc><h1>Release notes</h1><p>Version 3.2 reads compressed files without a temporary copy, which halves the time of a first run on slow disks.</p><pre>read(path, lazy=True)</pre>"
        "<p>Older settings keep working; they will be removed in a year, and a warning names the new ones.</p></article><div class=pagination><a href=/1>1</a> <a href=/2>2</a> <a href=/3>next</a></div></body></html>",
        ["Release notes", "Version 3.2 reads compressed files without a temporary copy, which halves the time of a first run on slow disks.", "read(path, lazy=True)",
         "Older settings keep working; they will be removed in a year, and a warning names the new ones."],
    )
    assert min(shares([(page, set(main)) for page, main in (forum, recipe, notes)], html.forest())) >= 0.95


@pytest.mark.parametrize("begin", ["<svg viewBox='0'>", "<iframe src=x>", "<noscript>", "<svg/>", "<title>", "<textarea>", "<select>"])
def test_elements_that_never_end(begin):
    """Only their tag is left out, not the article behind them."""
    page = f"<html><body><nav><a href=/>Home</a></nav>{begin}<article><h1>Of rivers</h1><p>Rivers carry more than water, as the people who live beside them know well.</p></article></body></html>"
    assert html.extract([page], html.forest()) == [["Of rivers", "Rivers carry more than water, as the people who live beside them know well."]]


def test_ends_of_pages():
    texts = lambda page: [x.text for x in html.parse(page) if x.tag == "" and x.text]
    assert texts("<p>if x < 3 and <div cla") == ["if x < 3 and"] and texts("<p>a < b") == ["a < b"] and texts("<p>a</p") == ["a"] and texts("<p>a<!-- b") == ["a"]
    assert texts("<p>a<script>if (1 < 2) b") == ["a"] and texts("<p>a<svg><text>b</text></svg>c") == ["ac"] and texts("<p>a <! b") == ["a"]


def test_extraction_of_a_page():
    page = (
        "<html><head><title>no</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy now</div>"
        "<article><h1>A&amp;B &copy</h1><p>One <b>two\n three<br>four, with more words to make it long enough for a paragraph.<p>Second &lt;p&gt; paragraph, which also has some words in it.</article><footer>&copy; me</footer>"
    )
    assert html.extract([page, None, "", "<p"], html.forest()) == [["A&B ©", "One two three four, with more words to make it long enough for a paragraph.", "Second <p> paragraph, which also has some words in it."], [], [], []]


def test_decoder_is_consistent():
    r = random.Random(8)
    for _ in range(50):
        nodes = html.parse(html.made_page(r)[0])
        html.features(nodes)
        chosen = html.decode(nodes, np.array([r.gauss(0, 3) for _ in nodes]))
        for x, c in zip(nodes, chosen):
            if x.tag or x is nodes[0]:
                assert c == any(chosen[k.order] for k in x.kids)


def test_registered(spark):
    names = sorted(int(n[2:].split("_")[0]) for n in pixelweave.llm.queries())
    assert names == list(range(1, 11))
