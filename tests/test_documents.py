"""Chunker, line classifier, context, reassembly, procedures: edges and brute-force twins."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from faultloom.functions import fixed
from faultloom.operators import chunks as ch
from faultloom.operators import procedures as pr
from faultloom.operators import search as se
from faultloom.operators import postings
from faultloom.operators.textmatch import containing


def docs(spark, *contents):
    rows = [(f"D{i}", f"D{i}.pdf", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "document_id string, file_path string, content string")


def test_chunk_edges(spark):
    blank_middle = "a" * 200 + " " * 200 + "b" * 30
    made = ch.chunk_text(docs(
        spark, "", None, "x" * 10, "x" * 11, "y" * 200, "y" * 201, "z" * 400, blank_middle,
        "Füße😀" * 50,
    )).orderBy("document_id", "chunk_sequence").collect()
    by_doc = {k: list(v) for k, v in itertools.groupby(made, key=lambda r: r.document_id)}
    assert set(by_doc) == {"D3", "D4", "D5", "D6", "D7", "D8"}
    spans = lambda d: [(r.chunk_sequence, r.char_start_position, r.char_end_position) for r in by_doc[d]]
    assert spans("D3") == [(1, 1, 11)]
    assert spans("D4") == [(1, 1, 200)]
    assert spans("D5") == [(1, 1, 200)]  # the last single character is not meaningful
    assert spans("D6") == [(1, 1, 200), (2, 201, 400)]
    assert spans("D7") == [(1, 1, 200), (3, 401, 430)]
    assert "".join(r.chunk_text for r in by_doc["D8"]) == "Füße😀" * 50


def test_chunks_put_together_again_give_the_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\té😀") for _ in range(rng.randrange(1, 3000))) for _ in range(40)]
    d = docs(spark, *texts)
    back = ch.reassemble(ch.chunk_text(d, min_len=-1), block=4)
    got = {r.document_id: r.content for r in back.collect()}
    assert got == {f"D{i}": t for i, t in enumerate(texts)}


def test_chunks_of_the_tables_put_together(spark, sf_dir):
    from faultloom.plans import derive

    d = derive.sop_documents(spark, sf_dir)
    back = ch.reassemble(ch.chunk_text(d, min_len=-1)).select("document_id", F.col("content").alias("again"))
    assert d.join(back, "document_id", "left").filter(~F.col("content").eqNullSafe(F.col("again"))).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_window_and_context_respect_gaps(spark, block):
    seqs = [1, 2, 5, 6, 7, 8, 9, 10, 15]
    rows = [(f"D-C{s:03d}", "D", s, "t", "CONTENT") for s in seqs]
    c = spark.createDataFrame(
        rows, "chunk_id string, document_id string, chunk_sequence int, chunk_text string, chunk_type string"
    )
    got = {r.chunk_sequence: set(r.neighbour_ids) for r in ch.context_window(c, 2, block).collect()}
    near = lambda s: {f"D-C{x:03d}" for x in seqs if abs(x - s) <= 2}
    assert got == {s: near(s) for s in seqs}
    around = ch.context_of(c, "D-C005", 2).collect()
    assert [(r.chunk_sequence, r.is_target_chunk, r.distance_from_target) for r in around] == [
        (5, True, 0), (6, False, 1), (7, False, 2)
    ]


def python_lines(content):
    """Reading of a document line by line."""
    for no, section in enumerate(content.strip().split("\n\n")):
        if not section.strip():
            continue
        lines = section.split("\n")
        title = lines[0].strip()
        if not ((title.isupper() and len(title) < fixed.HEADER_MAX) or title.endswith(":")):
            yield (no, 0, "paragraph", section)
            continue
        yield (no, 0, "header", title)
        for i, raw in enumerate(lines[1:], 1):
            line = raw.strip()
            if line:
                kind = "numbered" if line.startswith(fixed.NUMBER_MARKS) else (
                    "bullet" if line.startswith("-") else "plain"
                )
                yield (no, i, kind, line)


CONTENTS = [
    "SAFETY FIRST\n1. one\n - two\n\n\nnot a header\nsecond\n\nNotes:\n  plain \n9. nine\n10. ten",
    "  \n\nTitle:\n\nA" + "B" * 60 + "\nx", "", "123\n1. x", "ÄÖ 1\n- y",
]


def test_line_classifier(spark):
    got = ch.classify_lines(docs(spark, *CONTENTS)).orderBy("document_id", "section_no", "line_no")
    want = [(f"D{i}", *row) for i, c in enumerate(CONTENTS) for row in python_lines(c)]
    assert [tuple(r) for r in got.collect()] == want


def python_steps(content):
    """The section a step belongs to is that of the last line with a section word."""
    section = None
    for at, raw in enumerate(content.split("\n")):
        line = raw.strip()
        opened = next((n for n, words in fixed.STEP_SECTIONS if any(w in line.upper() for w in words)), None)
        if opened:
            section = opened
        elif section and line.startswith(fixed.STEP_MARKS):
            yield (section, at, line)


STEPS = [
    "1. lost\nSAFETY:\n1. a\n2. mind the safety\n3. b\n6. dropped\nOTHER HEAD\n- kept\nRESOLUTION\n\n  5. c\nVerification\n- d",
    "no sections\n1. x", "", "DIAGNOSTIC", "REPAIR\nREPAIR\n- z",
]


def test_steps(spark):
    got = pr.repair_steps(docs(spark, *STEPS)).orderBy("document_id", "position")
    want = [(f"D{i}", *row) for i, c in enumerate(STEPS) for row in python_steps(c)]
    assert [tuple(r) for r in got.collect()] == want
    lists = {r.document_id: r for r in pr.step_lists(docs(spark, *STEPS)).collect()}
    assert lists["D0"].safety_steps == ["1. a", "3. b", "- kept"]
    assert lists["D0"].verification_steps == ["- d"]
    assert lists["D1"].safety_steps == [] and lists["D4"].repair_steps == ["- z"]


def python_best(code, equipment, sops):
    best, top = None, 0
    for d in sorted(sops, key=lambda d: d[0]):
        score = 0
        if code is not None and code in (d[4] or []):
            score += 8
        if equipment is not None and any(equipment.lower() in e.lower() for e in d[3] or []):
            score += 6
        if code is not None and code in (d[5] or d[1] or ""):
            score += 4
        if score > top:
            best, top = d[0], score
    return best, top / 10


@pytest.fixture(scope="module")
def sop_rows():
    rng = random.Random(11)
    kits = ["Cisco cBR-8", "cisco CBR-8 (rev 2)", "Nokia 7750", "All Network Equipment", "Router"]
    codes = ["812.3", "81", "A B", "X-1", "600.1"]
    rows = []
    for i in range(60):
        rows.append((
            f"S{i:03d}", rng.choice(["Title 812.3", "About A B", None]), rng.choice(fixed.SOP_CATEGORIES),
            rng.choice([None, [], rng.sample(kits, 2)]), rng.choice([None, [], rng.sample(codes, 2)]),
            rng.choice(["", None, "see 812.3, then", "A B\nREPAIR\n1. go", "x X-1y SAFETY\n- s"]),
        ))
    return rows


def sop_frame(spark, rows):
    return spark.createDataFrame(rows, (
        "document_id string, title string, category string, equipment_types array<string>,"
        " fault_codes array<string>, content string"
    ))


def test_best_document_is_that_of_the_plain_search(spark, sop_rows):
    codes = ["812.3", "81", "A B", "X-1", "600.1", "none", None]
    kits = ["Cisco cBR-8", "nokia", "Router", "zzz", "", None]
    pairs = list(itertools.product(codes, kits))
    faults = spark.createDataFrame(
        [(f"F{i}", c, k, "d") for i, (c, k) in enumerate(pairs)],
        "fault_id string, fault_code string, equipment_type string, fault_description string",
    )
    sops = sop_frame(spark, sop_rows)
    got = {r.fault_id: (r.document_id, r.confidence) for r in pr.match_sop(faults, sops).collect()}
    for i, (c, k) in enumerate(pairs):
        doc, score = python_best(c, k, sop_rows)
        assert got[f"F{i}"] == (doc or "GENERIC", pytest.approx(score)), (c, k)
    made = {r.fault_id: r for r in pr.repair_procedures(faults, sops).collect()}
    lost = made[f"F{pairs.index((None, 'zzz'))}"]
    assert lost.document_title == fixed.GENERIC["title"] and lost.confidence is None
    assert lost.safety_steps == list(fixed.GENERIC["safety"])
    assert lost.full_content == "Generic repair procedure for d"
    assert len(made) == len(pairs)


def test_ties_take_the_first_document(spark):
    rows = [(n, "t", "Major", ["Box"], ["1"], "c") for n in ("S2", "S1", "S3")]
    faults = spark.createDataFrame([("1", "Box")], "fault_code string, equipment_type string")
    got = pr.best_sop(faults, sop_frame(spark, rows)).first()
    assert (got.document_id, got.confidence) == ("S1", 1.4)


# --- many patterns -----------------------------------------------------------------

def like(text, pattern):
    import re

    parts = {"%": ".*", "_": "."}
    return re.search("(?s)" + "".join(parts.get(c, re.escape(c)) for c in pattern), text) is not None


WORDS = ["the", "cable", "cut", "a", "ab", "abc", "x_y", "10%", "é", "fault", "faulty", "", "in\nline"]


def phrases(n, seed, most):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, most))) for _ in range(n)]


PATTERNS = sorted(set(phrases(60, 2, 5)) | {"", " ", "%", "_", "__", "% _", "a_c", "fa%t", " cut", "zzz", "able"})


@pytest.mark.parametrize("wild", [False, True])
def test_patterns_in_texts(spark, wild):
    bodies = [(i, b) for i, b in enumerate(phrases(200, 1, 12))] + [(900, None), (901, "")]
    texts = spark.createDataFrame(bodies, "id int, body string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS] + [(None,)], "pattern string")
    want = {
        (i, p) for i, b in bodies if b is not None for p in PATTERNS
        if (like(b, p) if wild else p in b)
    }
    got = [(r.id, r.pattern) for r in containing(texts, ["id"], "body", patterns, "pattern", like=wild).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    short = containing(texts, ["id"], "body", patterns, "pattern", like=wild, first=3).collect()
    lowest = {p: sorted(i for i, q in want if q == p)[:3] for p in PATTERNS}
    assert sorted((r.id, r.pattern) for r in short) == sorted((i, p) for p, ids in lowest.items() for i in ids)


@pytest.mark.parametrize("wild", [False, True])
def test_stored_index_finds_the_same(spark, wild, tmp_path):
    bodies = [(i, b) for i, b in enumerate(phrases(200, 1, 12))] + [(900, None), (901, ""), (902, " "), (903, "a  b "), (904, " ab c")]
    bodies += [(i, "the cable") for i in range(1000, 1400)]
    texts = spark.createDataFrame(bodies, "id int, body string")
    asked = [*PATTERNS, " ", "  ", "a  b", "a  b ", " ab", "b ", "the cable", "cable cut the", "e c", "zzz cable", "h_ c", "% b "]
    patterns = spark.createDataFrame([(p,) for p in asked] + [(None,)], "pattern string")
    laid = postings.in_parts(texts, ("id",)).persist()
    index = postings.write_postings(laid, ("id",), "body", str(tmp_path), buckets=7)
    assert len(index.steps) == len(postings.SHARES)
    want = {(i, p) for i, b in bodies if b is not None for p in asked if (like(b, p) if wild else p in b)}
    got = [(r.id, r.pattern) for r in postings.matching(index, texts, "body", patterns, "pattern", like=wild).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    short = postings.matching(index, texts, "body", patterns, "pattern", like=wild, first=3).collect()
    lowest = {p: sorted(i for i, q in want if q == p)[:3] for p in asked}
    assert sorted((r.id, r.pattern) for r in short) == sorted((i, p) for p, ids in lowest.items() for i in ids)


@pytest.mark.parametrize("wild", [False, True])
def test_patterns_in_texts_by_pieces(spark, wild, monkeypatch):
    """Lookup tables of many pieces, and patterns that the lowest ids do not settle, give the same rows."""
    from faultloom.operators import textmatch

    monkeypatch.setattr(textmatch, "FIRST_TEXTS", 20, raising=False)
    monkeypatch.setattr(textmatch, "PATTERNS_AT_ONCE", 7, raising=False)
    monkeypatch.setattr(textmatch, "HELD", 2000, raising=False)
    bodies = [(i // 3, str(i % 3), b) for i, b in enumerate(phrases(200, 1, 12))] + [(None, "a", "the cable cut"), (1, None, "a_c fault"), (900, "a", None), (901, "a", "")]
    texts = spark.createDataFrame(bodies + bodies[:30], "id int, at string, body string")
    asked = [*PATTERNS, "the ", " the", "cut a the", "x cable", "le c", "fault the"]
    patterns = spark.createDataFrame([(p,) for p in asked] + [(None,)], "pattern string")
    want = {(i, a, p) for i, a, b in bodies if b is not None for p in asked if (like(b, p) if wild else p in b)}
    shown = lambda rows: sorted(((r.id, r["at"], r.pattern) for r in rows), key=repr)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for first in (1, 3, None):
        found = containing(texts, ["id", "at"], "body", patterns, "pattern", like=wild, first=first).collect()
        lowest = {x for p in asked for x in sorted((x for x in want if x[2] == p), key=order)[:first]}
        assert shown(found) == sorted(lowest, key=repr), first


def test_batch_search_moves_no_chunk_text(spark, monkeypatch):
    """Texts were shuffled once per token where the lookup table was not small, and again for the winners."""
    from faultloom.operators import textmatch
    from faultloom.sources import tables

    monkeypatch.setattr(textmatch, "FIRST_TEXTS", 50, raising=False)
    rows = [(f"D{i:05d}", 1, f"{t} {'filler' * 9}{i}", f"D{i:05d}-C001") for i, t in enumerate(phrases(2000, 8, 12))]
    index = tables.settle(spark.createDataFrame(rows, "document_id string, chunk_sequence int, chunk_text string, chunk_id string").withColumns(
        {c: F.lit("General") for c in ("document_title", "category", "chunk_type", "section_name")}
    ).withColumn("page_number", F.lit(None).cast("int")), "index")
    queries = spark.createDataFrame([("the fault",), ("cut faulty cable ab",), ("a",), ("filler1999",), ("x_y 10% in",)], "query_text string")
    plans, plain = [], tables.settle

    def settle(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args, **kwargs)

    for module in (textmatch, se):
        monkeypatch.setattr(module, "settle", settle)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = se.search_many(index, queries, 3)
        plans.append(many._jdf.queryExecution().executedPlan().toString())
        got = [tuple(r) for r in many.select("query_text", "rank", "chunk_id").orderBy("query_text", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = [(q, i, r.chunk_id) for q in sorted(r[0] for r in queries.collect()) for i, r in enumerate(se.search_chunks(index, q, k=3).collect(), 1)]
    assert got == want
    # tokens are dealt for the vocabulary only, which holds no text, and chunks meet the winners where they lie
    dealt = [line for p in plans for line in p.split("\n") if "SortMergeJoin [token" in line or "SortMergeJoin [gram" in line]
    assert not dealt
    assert not [p for p in plans if "SortMergeJoin [document_id" in p and "/index-" in p]


@pytest.mark.parametrize("copies", [20, 20_000])
def test_rare_kind_is_found_at_any_size(spark, copies):
    texts = spark.range(copies).selectExpr("cast(id as int) as id", "'text' as kind", "'HOLDS BETA' as body")
    title = spark.createDataFrame([(10**6, "title", "BETA")], "id int, kind string, body string")
    asked = spark.createDataFrame([("BETA",)], "pattern string")
    found = containing(texts.union(title), ["id", "kind"], "body", asked, "pattern", first=3, per=("kind",))
    assert sorted((r.id, r.kind) for r in found.collect()) == [(0, "text"), (1, "text"), (2, "text"), (10**6, "title")]


@pytest.mark.parametrize("literal, stored", [(False, False), (True, False), (False, True), (True, True)])
def test_batch_search_equals_single_searches(spark, literal, stored, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"D{d:02d}-C{s:03d}", t, f"D{d:02d}", rng.choice(["Cable guide", "The fault", None]), "Major",
         "CONTENT", rng.choice(["Safety Requirements", "General Content", None]), None, s, ["Box"], ["1"], 1, 2)
        for (d, s), t in zip(itertools.product(range(40), range(1, 6)), phrases(200, 4, 12))
    ]
    index = spark.createDataFrame(rows, (
        "chunk_id string, chunk_text string, document_id string, document_title string, category string,"
        " chunk_type string, section_name string, page_number int, chunk_sequence int,"
        " equipment_types array<string>, fault_codes array<string>, char_start_position int,"
        " char_end_position int"
    )).persist()
    asked = [
        "cable", "the cable", "safety requirements", "fault", "a_c", "", " cut", "%", "zzz", "ab the",
        "general", "x_y", "10%", "able cut", "CABLE GUIDE", "the fault",
    ]
    queries = spark.createDataFrame([(q,) for q in asked] + [(None,)], "query_text string")
    kept = se.store_index(index, str(tmp_path)) if stored else index
    many = se.search_many(kept, queries, 7, literal).collect()
    if stored:
        for q in ("the fault", "safety requirements", "a_c"):
            for k in (4,):
                pair = [se.find_similar(i, q, k=k, literal=literal).collect() for i in (kept, index)]
                assert pair[0] == pair[1], q
    for q in asked:
        one = se.search_chunks(index, q, k=7, literal=literal).collect()
        got = sorted((r for r in many if r.query_text == q), key=lambda r: r["rank"])
        assert [(r.chunk_id, r.relevance_score) for r in got] == [
            (r.chunk_id, r.relevance_score) for r in one
        ], q


def test_search_filters(spark):
    schema = (
        "chunk_id string, document_id string, file_path string, chunk_sequence int, chunk_text string,"
        " chunk_type string, section_name string, page_number int, char_start_position int,"
        " char_end_position int, is_meaningful boolean"
    )
    long = "the cable fault of the north"
    chunks = spark.createDataFrame([
        ("A-C001", "A", "a", 1, long, "SAFETY", "s", None, 1, 9, True),
        ("A-C002", "A", "a", 2, long, "CONTENT", "s", None, 1, 9, False),
        ("A-C003", "A", "a", 3, "cable fault", "CONTENT", "s", None, 1, 9, True),
        ("B-C001", "B", "b", 1, long, "CONTENT", "s", None, 1, 9, True),
        ("C-C001", "C", "c", 1, long, "CONTENT", "s", None, 1, 9, True),
    ], schema)
    meta = spark.createDataFrame([
        ("A", "t", "Major", ["Box", None], ["1"], True), ("B", "t", "Minor", None, None, True),
        ("C", "t", "Major", ["Box"], ["1"], False),
    ], "document_id string, title string, category string, equipment_types array<string>, fault_codes array<string>, is_active boolean")
    index = se.search_index(chunks, meta)
    ids = lambda df: [r.chunk_id for r in df.collect()]
    assert ids(se.search_chunks(index, "cable fault")) == ["A-C001", "B-C001"]
    assert ids(se.search_chunks(index, "cable", equipment="Box")) == ["A-C001"]
    assert ids(se.search_chunks(index, "cable", equipment="Other")) == []
    assert ids(se.search_chunks(index, "cable", category="Minor")) == ["B-C001"]
    assert ids(se.search_chunks(index, "cable", chunk_type="SAFETY")) == ["A-C001"]
    assert ids(se.search_chunks(index, "cable", document_id="B")) == ["B-C001"]
    similar = se.find_similar(se.search_index(chunks, meta, None), "cable fault")
    assert [(r.document_id, r.similar_chunk_text) for r in similar.collect()] == [
        ("A", "cable fault"), ("A", long), ("B", long)
    ]
    context = se.fault_context(
        spark.createDataFrame([("F1", "1"), ("F2", "2"), ("F3", None)], "fault_id string, fault_code string"), index
    )
    assert {r.fault_id: r.context_size for r in context.collect()} == {"F1": 1, "F2": 0, "F3": 0}


def test_vectors(spark):
    import numpy as np

    from faultloom.operators.vectors import vector_topk

    rng = np.random.default_rng(0)
    data = rng.normal(size=(50, 8))
    data[7] = data[3]
    data[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = np.divide(data, norm, out=np.zeros_like(data), where=norm > 0)
    sims = np.round(unit @ unit.T, 9)
    for block_bytes in (1 << 30, 1000):
        got = vector_topk(df, df.repartition(3), 4, skip_same=True, block_bytes=block_bytes).collect()
        for q in range(50):
            order = sorted((i for i in range(50) if i != q), key=lambda i: (-sims[q, i], i))[:4]
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r.vec_id for r in mine] == order


def test_answers_for_questions(spark, sf_dir):
    from faultloom.plans import catalog

    q = spark.createDataFrame([("safety requirements",), ("zzzqqq",)], "query_text string")
    got = {r.query_text: r.answer for r in se.chat_answers(catalog.index(spark, sf_dir), q).collect()}
    assert "**Confidence:** 90.0%" in got["safety requirements"]
    assert got["zzzqqq"] == fixed.ANSWER_NONE


def test_index_from_texts_or_from_chunks(spark, sf_dir):
    from faultloom.plans import derive

    meta = derive.sop_metadata(spark, sf_dir)
    for min_len in (None, 20):
        a = se.search_index(derive.sop_chunks(spark, sf_dir), meta, min_len)
        b = se.index_documents(derive.sop_documents(spark, sf_dir), meta, min_len)
        assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _hybrid_brute(queries, vectors, documents, k, weight):
    def score(q, content, title):
        has = lambda t, w: t is not None and w.upper() in t.upper()
        if q is None:
            return None
        return 0.9 if has(content, q) else 0.7 if has(content, q.split(" ")[0]) else 0.5 if has(title, q) else None

    norm = lambda v: sum(x * x for x in v) ** 0.5
    near = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 9) if norm(a) * norm(b) else 0.0
    out = []
    for q, said, v in queries:
        blended = {}
        for d in {x[0] for x in vectors} | {x[0] for x in documents}:
            s = max((near(v, x) for i, x in vectors if i == d and x is not None), default=None) if v is not None else None
            r = next((score(said, c, t) for i, t, c, active in documents if i == d and active), None)
            if s is not None or r is not None:
                blended[d] = (round((s or 0) * weight + (r or 0) * (1 - weight), 9), s, r)
        best = sorted(blended, key=lambda d: (-blended[d][0], d))[:k]
        out += [(q, n + 1, d, blended[d][1], blended[d][2], blended[d][0]) for n, d in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_hybrid_blends_before_it_cuts(spark, monkeypatch, block):
    from faultloom.operators import vectors

    monkeypatch.setattr(vectors, "BLEND_DOCUMENTS", block)
    monkeypatch.setattr(vectors, "BLEND_QUERIES", block)
    rng = random.Random(3)
    point = lambda: [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(4)]
    bodies = ["Check cable fault now", "the cable is cut", "nothing", None]
    # most documents tie at the top text score: a cut before blending would keep the lowest ids only
    documents = [(f"D{i:03}", "Cable Fault Guide" if i % 4 else "Notes", bodies[0] if i % 3 else bodies[i // 3 % 4], i % 11 != 0) for i in range(90)]
    stored = [(f"D{i:03}", point() if i % 13 else None) for i in range(20, 120)] + [("D050", point())]
    asked = [(0, "cable fault", point()), (20, "guide", point()), (40, None, point()), (60, "cable cut", None), (80, "zzz", [0.0] * 4)]
    asked += [(100 + 20 * i, "CABLE fault", point()) for i in range(20)]
    got = se.hybrid_many(
        spark.createDataFrame(asked, "query_id long, query_text string, vector array<float>").repartition(3),
        spark.createDataFrame(stored, "document_id string, vector array<float>"),
        spark.createDataFrame(documents, "document_id string, title string, content string, is_active boolean"), 5, 0.4,
    ).collect()
    want = _hybrid_brute(asked, stored, documents, 5, 0.4)
    assert sorted((r.query_id, r["rank"], r.document_id) for r in got) == [x[:3] for x in want]
    for mine, other in zip(sorted(map(tuple, got)), want, strict=True):
        assert mine[3:] == pytest.approx(other[3:], abs=1e-8)
    assert max(x[2] for x in want if x[0] == 0) > "D050"


def test_vector_index(spark, tmp_path):
    import numpy as np

    from faultloom.operators import vector_index
    from faultloom.operators.vectors import vector_topk

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    data = [(i, [float(x) for x in centres[i % 20 if i % 3 else 0] + rng.normal(size=8) / 4]) for i in range(1500)]
    data += [(2000 + i, [0.0] * 8) for i in range(5)] + [(3000, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    index = vector_index.write_index(df, str(tmp_path / "a"))
    assert index.rows.count() == 1505 and 1 <= index.probes < index.lists.count()
    exact = {(r.query_id, r.vec_id): r.similarity for r in vector_topk(df, df, 5, skip_same=True).collect()}
    found = {(r.query_id, r.vec_id): r.similarity for r in vector_index.index_topk(index, df, 5, skip_same=True).collect()}
    assert len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(found[p] == exact[p] for p in found.keys() & exact.keys())
    every = vector_index.index_topk(index, df, 5, skip_same=True, probes=10**6).collect()
    assert {(r.query_id, r.vec_id): r.similarity for r in every} == exact
    none = vector_index.write_index(df.limit(0), str(tmp_path / "b"))
    assert vector_index.index_topk(none, df).collect() == []


def test_vector_index_query_recall(spark, sf_dir):
    from faultloom.plans import catalog, derive

    exact = {(r.query_id, r.vec_id) for r in catalog.QUERIES["vector_topk"](spark, sf_dir).collect() if r.query_id % 20 == 0}
    found = {(r.query_id, r.vec_id) for r in catalog.QUERIES["vector_index_topk"](spark, sf_dir).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9


def test_hybrid_query_takes_every_twentieth_vector(spark, sf_dir):
    from faultloom.plans import catalog, derive

    got = catalog.QUERIES["hybrid_search"](spark, sf_dir).collect()
    asked = [tuple(r) for r in derive.hybrid_queries(spark, sf_dir).collect()]
    assert {r.query_id for r in got} == {q[0] for q in asked} == set(range(0, 500, 20))
    vectors = [tuple(r) for r in derive.document_vectors(spark, sf_dir).collect()]
    documents = [tuple(r) for r in derive.sop_documents(spark, sf_dir).select("document_id", "title", "content", "is_active").collect()]
    want = _hybrid_brute(asked[:4], vectors, documents, 50, 0.5)
    mine = {(r.query_id, r.document_id): r.hybrid_score for r in got}
    assert all(abs(mine[x[0], x[2]] - x[5]) < 2e-6 for x in want)


def test_nearest_of_a_block_sort_few_scores(monkeypatch):
    """The whole matrix of scores was sorted for the k best; only what is over the k-th so far need be."""
    import numpy as np
    import pandas as pd

    from faultloom.operators.vectors import _meet

    rng = np.random.default_rng(3)
    corpus = pd.DataFrame({"vec_id": rng.permutation(9000) // 2, "vector": list(rng.integers(-2, 3, (9000, 6)).astype(float))})
    queries = pd.DataFrame({"query_id": np.arange(300), "vector": list(rng.integers(-2, 3, (300, 6)).astype(float))})
    sorted_, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **o: sorted_.append(np.size(keys[0])) or plain(keys, **o))
    got = _meet(4, True)(queries, corpus)
    assert sum(sorted_) < 0.2 * len(queries) * len(corpus)
    unit = lambda m: np.array([v / (np.linalg.norm(v) or 1) for v in m["vector"]])
    near = np.round(unit(queries) @ unit(corpus).T, 9)
    ids = corpus["vec_id"].to_numpy()
    for i, rows in got.groupby("query_id"):
        best = sorted((-s, v) for s, v in zip(near[i], ids) if v != i)[:4]
        assert [(-s, v) for s, v in zip(rows["similarity"], rows["vec_id"])] == best
    assert len(got) == 1200


def test_postings_are_made_once_and_laid_by_token(spark, tmp_path, monkeypatch):
    """Ranges of (bucket, token, part) were sampled from all rows, so that every row was made twice."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql.classic.dataframe import DataFrame

    texts = spark.createDataFrame([(i, f"a{i % 7} the b{i % 5} the c") for i in range(300)], "id long, body string")
    laid = postings.in_parts(texts, ("id",))
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda *a: pytest.fail("ranges are sampled"))
    made = postings.write_postings(laid, ("id",), "body", str(tmp_path / "i"))
    assert made.rows.count() == 1500 and made.rows.filter("token = 'the'").count() == 600
    for path in glob.glob(f"{tmp_path}/i/rows/bucket=*/*.parquet"):
        runs = [t for t, _ in itertools.groupby(pq.ParquetFile(path).read(["token"])["token"].to_pylist())]
        assert len(runs) == len(set(runs))
    asked = spark.createDataFrame([("a3 the b",), ("b4",), ("none",)], "pattern string")
    got = {(r.id, r.pattern) for r in postings.matching(made, laid, "body", asked, "pattern").collect()}
    assert got == {(i, "a3 the b") for i in range(300) if i % 7 == 3} | {(i, "b4") for i in range(300) if i % 5 == 4}


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Every posting and every key of a word went through a shuffle, six times the texts each."""
    from pyspark.sql import DataFrameWriter

    plans, plain = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        plans[path.rpartition("/")[2].partition("-")[0]] = self._df._jdf.queryExecution().executedPlan().toString()
        plain(self, path, *args, **options)

    monkeypatch.setattr(type(spark.range(0).write), "parquet", parquet)
    rows = [(f"D{i % 60:02d}", i // 60, f"a{i % 7} the b{i % 5} the c") for i in range(300)]
    texts = spark.createDataFrame(rows, "document_id string, chunk_sequence int, chunk_text string")
    made = se.store_index(texts, str(tmp_path / "i"))
    assert "Exchange" not in plans["rows"] and "Exchange" not in plans["words"]
    assert "Exchange" in plans["counts"]
    assert made.postings.rows.count() == 1500 and made.chunks.count() == 300
    assert [tuple(r) for r in made.postings.words.filter("key = '=THE'").select("token", "n").collect()] == [("THE", 600)]


def test_centroids_are_fitted_by_several_tasks(spark, tmp_path, monkeypatch):
    """The sample was scaled and fitted in one task, and its lengths added up for every component."""
    import numpy as np
    from faultloom.operators import vector_index

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)) * 9)]
    df = spark.createDataFrame([*rows, (400, [0.0] * 8)], "vec_id long, embedding array<double>")
    fitted, plain = [], vector_index.KMeans.fit
    monkeypatch.setattr(vector_index, "FIT_ROWS", 100, raising=False)
    monkeypatch.setattr(vector_index.KMeans, "fit", lambda self, data: fitted.append(data) or plain(self, data))
    vector_index.write_index(df, str(tmp_path / "v"))
    assert fitted[0].rdd.getNumPartitions() == 5
    sizes = sorted(round(float(np.linalg.norm(r.features.toArray())), 9) for r in fitted[0].collect())
    assert sizes == [0.0] + [1.0] * 400
