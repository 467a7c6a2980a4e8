"""Plain-Python versions of learned scores and of the whole pipeline, and rows that share an id."""

import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from faultloom.llm import bytewords, decontaminate, langid, neardup, oracle, repeats, toxicity
from test_operators import brute_classes, brute_repeats, lowered, sentence


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", lowered(text).encode())


def plain_features(text):
    w = words_of(text)
    out = {("word", x) for x in w} | {("stem", x[:n]) for x in w for n in toxicity.STEM_BYTES if len(x) > n}
    out |= {("pair", *x) for x in zip(w, w[1:])} | {("triple", *x) for x in zip(w, w[1:], w[2:])} | {("skip", *x) for x in zip(w, w[2:])}
    return out


def plain_ftrl(rows, how=toxicity.Ftrl()):
    """A scorer learnt from (id, text, label) in the order of the mixed ids."""
    ids = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    rows = [rows[i] for i in np.argsort(bytewords.mix(ids), kind="stable")]
    texts = [plain_features(t) for _, t, _ in rows]
    counts = collections.Counter(f for t in texts for f in t)
    texts = [{f for f in t if counts[f] >= how.least_texts} for t in texts]
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    rate = min(max(sum(y for *_, y in rows) / len(rows), 1e-3), 1 - 1e-3)
    bias, bias_n = math.log(rate / (1 - rate)), 1.0

    def weight(f):
        if abs(z[f]) <= how.l1:
            return 0.0
        return -(z[f] - math.copysign(how.l1, z[f])) / ((how.beta + math.sqrt(n[f])) / how.alpha + how.l2)

    for _ in range(how.passes):
        for features, (_, _, y) in zip(texts, rows):
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-min(max(bias + sum(w.values()), -30), 30))) - y
            for f in features:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / how.alpha * w[f]
                n[f] += g * g
            bias_n += g * g
            bias -= how.alpha / (how.beta + math.sqrt(bias_n)) * g
    return lambda text: 1 / (1 + math.exp(-min(max(bias + sum(weight(f) for f in plain_features(text) if f in z), -30), 30)))


def crc_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_scores(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 12) + rng.choice([" vile foolish thing ", " kind ", " vileness ", " "]) + sentence(rng, 5)) for i in range(160)]
    marks = [(i, int("vile" in t)) for i, t in rows if i % 5]
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, b, 0) for a, b in marks], "doc_id long, toxic int, quality int")
    texts = dict(rows)
    plain = plain_ftrl([(i, texts[i], y) for i, y in marks if not crc_held(i)])
    for r in toxicity.report(docs, labels).collect():
        assert r.score == pytest.approx(plain(texts.get(r.doc_id) or ""), abs=1e-9)


def test_network_scores():
    rng = np.random.default_rng(5)
    net = langid.Network.fresh(["aa", "bb", "cc"], rng)
    net.bias[:] = rng.normal(0, 0.3, len(net.bias))
    data = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (3, 200, 256, 700)]
    (block,) = bytewords.blocks(pa.array(data, pa.binary()), lower=False)
    windows, text, size = langid.windows_of(block)
    got = net.probabilities(windows)
    at = 0
    for k, raw in enumerate(data):
        for start in range(0, len(raw), langid.WINDOW):
            # every window sees a few bytes of what follows it, and zeros beyond the text
            x = raw[start : start + langid.WINDOW + langid.REACH].ljust(langid.WINDOW + langid.REACH, b"\0")
            pooled = []
            for f in range(langid.FILTERS * len(langid.WIDTHS)):
                width = langid.WIDTHS[f // langid.FILTERS]
                response = [sum(float(net.tables[j][x[p + j], f]) for j in range(width)) for p in range(langid.WINDOW)]
                pooled.append(max(max(response) + float(net.bias[f]), 0))
            raw_out = [sum(h * float(net.weights[f, c]) for f, h in enumerate(pooled)) + float(net.offset[c]) for c in range(3)]
            top = [math.exp(v - max(raw_out)) for v in raw_out]
            assert got[at] == pytest.approx([v / sum(top) for v in top], abs=1e-4)
            assert text[at] == k and size[at] == min(langid.WINDOW, len(raw) - start)
            at += 1
    assert at == len(got)


# --- the pipeline --------------------------------------------------------------------------------

def plain_run(docs, labels, bench):
    """Rows of run() in plain Python up to the mix, which DuckDB does by the SQL of op10."""
    texts = {d[0]: d[1] for d in docs}
    scorer = plain_ftrl([(i, texts[i], y) for i, y in labels if i in texts and texts[i] is not None and not crc_held(i)])
    left = [d for d in docs if scorer(d[1] or "") < toxicity.THRESHOLD]
    classes = brute_classes([(d[0], d[1]) for d in left], 5)
    left = [d for d in left if classes[d[0]][1] == d[0]]
    cut = []
    for d in left:
        raw, mask = brute_repeats([(x[0], x[1]) for x in left])[d[0]]
        at, whole = 0, ""
        for c in raw.decode():
            size = len(c.encode())
            whole += "" if any(mask[at : at + size]) else c
            at += size
        cut.append((d[0], whole, d[2], d[3], len(whole)) if any(mask) else d)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = set()
    for _, t in bench:
        w = find(t)
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    hit = lambda t: any(tuple(w[k : k + n]) in grams for w in [find(t)] for n in {len(g) for g in grams} for k in range(len(w) - n + 1))
    return [d for d in cut if not hit(d[1])]


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(9)
    passage, leak = sentence(rng, 60), sentence(rng, 14)
    docs = []
    for i in range(90):
        text = sentence(rng, rng.randrange(20, 70))
        kind = i % 9
        text += {1: " vile foolish thing vile words", 2: " " + passage, 3: ". " + leak + " more"}.get(kind, "")
        if kind == 4 and i > 9:
            words = docs[i - 9 if (i - 9) % 9 == 4 else 4][1].split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        text = docs[i - 5][1] if kind == 5 and i > 9 else text
        docs.append([i, text, rng.choice(["en", "de", None]), f"src{i % 4}" if i % 8 else None, 0])
    docs += [[200, None, "en", "src1", 0], [201, "", "en", "src2", 0], [202, "ü" * 300, "fr", "src3", 0], [203, "x " * 4000, "en", "src9", 0]]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    labels = [(d[0], int("vile" in (d[1] or ""))) for d in docs[:90]]
    bench = [("b1", leak), ("b2", "three little words"), ("b3", None), ("b4", "")]
    save = lambda rows, kind, name: spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([(*x, 0) for x in labels], "doc_id long, toxic int, quality int", "labels")
    save(bench, "item_id string, text string", "benchmark")

    want = plain_run(docs, labels, bench)
    gone = {d[0] for d in docs} - {d[0] for d in want}
    assert any(i % 9 == 1 for i in gone) and any(i % 9 == 3 for i in gone) and any(i % 9 == 4 for i in gone) and 200 not in gone
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, str(tmp_path))
    assert sorted(map(tuple, before.collect())) == sorted(want)

    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*want))))))
    mixed = con.sql(oracle.SQL["op10_mixing"]).fetchall()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {d[0]: d for d in want}
    assert sorted((r.doc_id, r.domain, r.epoch, r.tokens, r.take_tokens) for r in got) == sorted((m[0], m[1], m[4], m[5], m[6]) for m in mixed)
    assert all((r.text, r.lang, r.source, r.n_chars) == known[r.doc_id][1:] for r in got)


# --- rows that share an id ------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, -1])
def test_an_id_with_several_texts_links_by_each(spark, order):
    rng = random.Random(6)
    base, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, "alpha beta gamma delta epsilon"), (1, base), (2, base + " tail"), (3, other), (4, other + " end"), (1, ""), (4, base + " far more"), (None, base), (5, "alone " + sentence(rng, 30))]
    df = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in neardup.classes(df).collect():
        got[r._id].add((r.component_id, r.n_shingles > 0))
    assert got == {1: {(1, True), (1, False)}, 2: {(1, True)}, 3: {(1, True)}, 4: {(1, True)}, 5: {(5, True)}, None: {(None, True)}}


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(7)
    passage, more = ("".join(rng.choices("abcdefgh", k=n)) for n in (150, 130))
    rows = [(1, "first " + passage), (2, passage + " one"), (2, "k" * 10), (2, passage + more), (2, more + " ü"), (3, "k" + more), (2, None), (2, passage + " one")]
    by = lambda r: (r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())
    order = sorted(set(rows), key=by)
    masks = {order[k]: v for k, v in brute_repeats([(k, r[1]) for k, r in enumerate(order)]).items()}
    df = spark.createDataFrame([(*r, 0, "x") for r in [*rows, (None, passage)]], "doc_id long, text string, n_chars long, _kept string")
    kept = lambda r: bytes(b for b, m in zip(*masks[r]) if not m).decode()
    got = sorted(map(str, ((r.doc_id, r.text or "") for r in repeats.remove_repeats(df).collect())))
    assert got == sorted(map(str, [*((r[0], kept(r)) for r in rows), (None, passage)]))
    assert sum(r.n_removed for r in repeats.measure(df).collect()) == sum(sum(masks[r][1]) for r in rows) > 300
    assert sorted(str(r._id) for r in repeats.measure(df).collect()) == sorted(str(r[0]) for r in [*rows, (None, 0)])


@pytest.mark.parametrize("limit", [10**6, 2, 1])
def test_windows_in_several_passes(spark, limit):
    rows = [(1, "a1 b1 c1 x"), (1, "q r s"), (None, "a1 b1 c1"), (None, "zz"), (2, "u v w a1 b1 c1 u v w"), (1, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a1 b1 c1"), ("j", "u v w"), ("k", "q r s t")], "item_id string, text string")
    out = [(r._id, r.n_words, [(s.first, s["last"]) for s in r.spans], list(r["items"])) for r in decontaminate.find_hits(docs, bench, max_windows=limit).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(out, key=key) == sorted([
        (1, 4, [(0, 3)], ["i"]), (1, 3, [], []), (1, 3, [], []), (None, 3, [(0, 3)], ["i"]), (None, 1, [], []), (2, 9, [(0, 9)], ["i", "j"])], key=key)
