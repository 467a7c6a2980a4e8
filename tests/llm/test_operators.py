"""The operators of faultloom.llm against brute force on small tables with nulls, repeats and clashing columns."""

import hashlib
import itertools
import pathlib
import platform
import random
import re
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from faultloom.llm import (
    bwtmerge, bytewords, chat, decontaminate, fingerprints, graph, langid, licenses, mixing, neardup, repeats, toxicity, warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, score double, spans int, label int, tokens long"
WORDS = "the cat sat on a mat Ünder éine brücke and ran over hills far away while dogs slept in shade all day long".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, len(t or ""), "x", 0.5, 1, 2, 3) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(30)]
    out = list(base)
    for t in base[:12]:  # near copies
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += base[:3]  # exact copies
    shared = sentence(rng, 60)
    out += [sentence(rng, 30) + " " + shared + " " + sentence(rng, 20) for _ in range(6)]
    out += [None, "", " \n\t ", "one", "one", "ééé", "a" * 700, "\n".join(["same line here"] * 40), shared * 40]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- words, transforms, graphs ------------------------------------------------------

def test_words_of_a_block(texts):
    for limit in (1, 50, 1 << 18):
        found = []
        column = pa.array([t for _, t in texts], pa.string())
        for block in bytewords.blocks(column, limit=limit):
            start, end, first = block.words(decontaminate.WORD_BYTES)
            for k in range(len(block)):
                found.append([block.data[s:e].tobytes().decode() for s, e in zip(start[first[k]:first[k + 1]], end[first[k]:first[k + 1]])])
        assert found == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t)) for _, t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_find_all_repeats(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        length = int(rng.integers(1, 9))
        pieces = [rng.integers(0, 3, rng.integers(0, 50)).astype(np.uint8) for _ in range(rng.integers(1, 10))]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        at, group = bwtmerge.repeated(np.concatenate(pieces), bounds, length, int(rng.integers(1, 6)))
        want, got = defaultdict(set), defaultdict(set)
        for b, p in zip(bounds, pieces):
            for j in range(len(p) - length + 1):
                want[p[j : j + length].tobytes()].add(int(b + j))
        for a, g in zip(at, group):
            got[g].add(int(a))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_components(spark):
    rng = random.Random(1)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220))] + [(i, i + 1) for i in range(400, 440)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- WARC ------------------------------------------------------------------------------

def test_archives(spark, tmp_path):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate([
        "<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "ü\n" * 5000, "<p>a</p>"])]
    pages += [(None, None, "<p>a</p>"), (20, "with\nline", "<p>b</p>"), (20, "again", "<p>b</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, kind string")
    got = [
        (-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(df).collect()]
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        digest = warc.base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = i is not None and first[h or ""] != i
        want.append((-1 if i is None else i, len(raw), digest, "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.report(df.limit(0)).count() == 0


def test_smallest_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_pages(df, f"{tmp_path}/raw")
    warc.write_deduplicated(spark, f"{tmp_path}/raw", f"{tmp_path}/done", smallest=3)
    rows = warc.read_archive(spark, f"{tmp_path}/done", True).collect()
    assert sorted((r.page_id, r.kind, r.payload) for r in rows) == [
        (1, "response", "ab"), (2, "response", "ab"), (3, "response", "abcd"), (4, "revisit", "")]


# --- toxicity and language ------------------------------------------------------------------

def test_toxicity_learns_and_survives_gaps(spark, none):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, sentence(rng, 30) + (" vile fool " if bad else " ") + sentence(rng, 10), "en", "s", 0, "x", 0.1, 1, 1, 1))
        marks.append((i, int(bad), "y"))
    rows += [(900, None, None, None, 0, "", 0.0, 0, 0, 0), (901, "", None, None, 0, "", 0.0, 0, 0, 0), (None, "vile fool", None, None, 0, "", 0.0, 0, 0, 0)]
    marks += [(None, 1, "y"), (5, None, "y"), (901, None, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text string")
    got = toxicity.report(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == len(rows) and len(held) > 50
    assert sum((r.predicted == 1) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[None].predicted == 1
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.3}
    assert toxicity.report(none, labels).count() == 0
    assert all(r.score == pytest.approx(toxicity.PRIOR) for r in toxicity.report(docs, labels.limit(0)).collect())


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    texts = [np.unique(rng.integers(10, 5000, 40)).astype(np.uint64) for _ in range(400)]
    y = np.arange(400) % 2
    texts = [np.append(t, np.uint64(1)) if k else t for t, k in zip(texts, y)]
    keys, w, _ = toxicity.fit(texts, y.astype(float), toxicity.Ftrl())
    assert w[keys == 1][0] > 2 and len(keys) < 500


def test_language(spark, none):
    rng = random.Random(3)
    alphabet = {"aa": "abcde ", "bb": "wxyz  ", "cc": "éèàù  "}
    rows = [(i, "".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(40, 900))), k, "s") for i, k in enumerate(list(alphabet) * 60)]
    rows += [(500, None, "aa", "s"), (501, "", "aa", "s"), (502, "12 34 !", "bb", "s"), (503, "abc", None, "s"), (None, "wxyz zyx", "", "s")]
    docs = spark.createDataFrame([(*r, 1, "x", 0.0, 0, 0, 0) for r in ((a, b, c, d) for a, b, c, d in rows)], SCHEMA)
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert sum(got[i].lang_pred == k for i, _, k, _ in rows[:180]) > 170
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.report(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


# --- fingerprints ----------------------------------------------------------------------------

def test_fingerprints(spark, docs, texts, none):
    got = {r.doc_id: r for r in fingerprints.report(docs).collect()}
    order = sorted(texts, reverse=True)
    paragraphs = lambda t: {p for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if p}
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(paragraphs(t), paragraphs(edited)))
        assert r.near_next == pytest.approx(alike(paragraphs(t), paragraphs(following)))
    by_text = defaultdict(set)
    for i, t in texts:
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.report(none).count() == 0
    odd = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d\ne")], "doc_id long, text string")
    assert sorted(r.doc_id for r in fingerprints.report(odd).collect()) == [1, 2]


def test_larger_sketches_recover_what_small_ones_cannot(spark):
    from pyspark.sql import functions as F

    rows = [(list(range(n)), list(range(n // 2, n + m))) for n, m in ((0, 0), (0, 3), (40, 0), (200, 150), (3, 500))]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    small = F.lit(4)
    one = fingerprints._peeled(fingerprints.subtracted(fingerprints.sketch(F.col("a"), small), fingerprints.sketch(F.col("b"), small)), small)
    out = df.select("a", "b", one.alias("small"), fingerprints.difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in out] == [len(set(r.a) ^ set(r.b)) for r in out]
    assert out[3].small == -1 and out[0].small == 0


# --- near duplicates -----------------------------------------------------------------------------

def brute_classes(texts, words):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, texts, none, words):
    how = neardup.Tables(words=words)
    got = {r._id: (r.n_shingles, r.component_id) for r in neardup.classes(docs, how=how).collect()}
    want = brute_classes(texts, words)
    assert got == want
    kept = neardup.keep_one(docs, how=how)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert neardup.classes(none, how=how).count() == 0


def test_a_group_around_a_poor_head(spark):
    """Many near copies of one text, some so far off that only others link them."""
    rng = random.Random(8)
    base = sentence(rng, 90).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 7, 9, 12])):
            words[rng.randrange(90)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[rng.randrange(3):])))
    got = {r._id: (r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), how=neardup.CONTRACT).collect()}
    assert got == brute_classes(rows, 2)


def test_near_duplicate_gaps(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r._id or -1, r.component_id or -1) for r in neardup.classes(df).collect())
    assert got == [(-1, -1), (-1, -1), (2, 2), (3, 2), (3, 2)]
    assert sorted(r.doc_id or -1 for r in neardup.keep_one(df).collect()) == [-1, -1, 2]


# --- repeated strings ------------------------------------------------------------------------------

def brute_repeats(texts, n=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            w = raw[k : k + n]
            if w in seen:
                mask[k : k + n] = b"\1" * n
            seen.add(w)
        out[i] = (raw, mask)
    return out


@pytest.mark.parametrize("frequent", [2000, 3])
def test_repeats(spark, docs, texts, none, frequent, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    got = {r._id: r for r in repeats.measure(docs).collect()}
    for i, (raw, mask) in brute_repeats(texts).items():
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        want = (len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i
    cut = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert set(cut) == {i for i, _ in texts}
    for i, (raw, mask) in brute_repeats(texts).items():
        at, whole = 0, ""
        for c in raw.decode():
            size = len(c.encode())
            whole += "" if any(mask[at : at + size]) else c
            at += size
        assert (cut[i].text or "") == whole and (not any(mask) or cut[i].n_chars == len(whole))
    assert repeats.measure(none).count() == 0 and repeats.remove_repeats(none).columns == docs.columns


def test_repeat_gaps(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id long, text string")
    got = sorted((r._id or -1, r.n_removed) for r in repeats.measure(df).collect())
    # the same start in both rows of id 1 is one occurrence
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 300)]


def test_transform_is_the_order_of_suffixes():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pieces = [bytes(rng.integers(1, 1 + rng.integers(1, 4), rng.integers(0, 90), dtype=np.uint8)) for _ in range(rng.integers(1, 9))]
        text = b"".join(p + b"\0" for p in pieces + pieces[:2])
        order, before = bwtmerge.transform(np.frombuffer(text, dtype=np.uint8).astype(np.uint16))
        want = sorted(range(len(text)), key=lambda i: (text[i : text.index(b"\0", i) + 1], i))
        assert order.tolist() == want
        assert before.tolist() == [text[i - 1] if i else 0 for i in want]


def test_windows_that_demotion_moves_are_marked():
    rng = random.Random(3)
    passage, some = ("".join(rng.choices("abcdefgh ", k=n)) for n in (180, 400))
    raw = "".join("".join(rng.choices("abcdefgh ", k=rng.randrange(90))) + rng.choice([passage, some, some[150:]]) for _ in range(60)).encode()
    block = bytewords.Block(0, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw) // 3, len(raw)]))
    hashes = repeats.anchor_hashes(block)
    at = raw.index(passage.encode())
    demoted = repeats.HashSet(np.unique(hashes[at : at + 180 - repeats.ANCHOR + 1]))
    plain = repeats.segments(block, None)
    found, k = np.unique(plain[3], return_counts=True)
    assert not plain[5].any()
    text, first, count, h, _, moved = repeats.segments(block, demoted)
    kept = np.isin(h, found[k > 1]) | moved
    assert moved.any() and not kept.all()
    places = {}
    for t, f, n, keep in zip(text, first, count, kept):
        for i in range(block.bounds[t] + f, block.bounds[t] + f + n):
            places.setdefault(raw[i : i + repeats.LENGTH], []).append(keep)
    assert all(all(v) for v in places.values() if len(v) > 1)


def test_anchors_are_counted_once_for_frequent_passages(spark, monkeypatch):
    """Texts are read for anchors, frequent strings and segments; to count the anchors again was a fourth pass."""
    monkeypatch.setattr(repeats, "FREQUENT", 3)
    settled, settle = [], repeats.settle
    monkeypatch.setattr(repeats, "settle", lambda df, name: settled.append(name) or settle(df, name))
    looked, strings = [], repeats._frequent_strings
    monkeypatch.setattr(repeats, "_frequent_strings", lambda shared: looked.append(len(shared.value)) or strings(shared))
    rng = random.Random(4)
    words = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = words(250)
    texts = [(i, words(rng.randrange(200)) + passage + words(rng.randrange(200))) for i in range(40)]
    got = {r._id: r.n_removed for r in repeats.measure(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: sum(mask) for i, (_, mask) in brute_repeats(texts).items()}
    assert looked and settled.count("anchors") == 1


def test_workers_keep_the_memory_of_freed_arrays():
    """Most of the time of a pass over the texts went into new pages for the arrays of every block."""
    if platform.libc_ver()[0] != "glibc":
        pytest.skip("another allocator")
    code = (
        "import resource, numpy as np, pyarrow as pa\nfrom faultloom.llm import repeats\n"
        "text = bytes(np.random.default_rng(0).integers(97, 123, 1 << 16, dtype=np.uint8)).decode()\n"
        "found = repeats._anchor_rows(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text])], ['i', 't']) for i in range(60))\n"
        "faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt\n"
        "for _ in range(20): next(found)\n"
        "before = faults()\nn = sum(1 for _ in found)\nprint((faults() - before) // n)\n"
    )
    root = pathlib.Path(repeats.__file__).parents[2]
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) < 100


# --- licences ---------------------------------------------------------------------------------------

def test_licences(spark, none):
    s = licenses.SENTENCES
    rows = [
        "Some code.\nReleased under the MIT License.\n", "released  UNDER the mit license", "\n".join([s["mit-grant"], s["mit-condition"], s["as-is"]]),
        "\n".join([s["mit-grant"], "one", "two", "three", s["mit-condition"]]), "\n".join([s["mit-grant"], "1", "2", "3", "4", s["mit-condition"]]),
        f"{s['apache-the-license']}\n{s['apache-compliance']}", "This work is licensed under the GNU General Public License, version 3. Bye. " + s["mit-notice"],
        None, "", "no licence here", "\n".join([s["mit-notice"]] * 3),
    ]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in licenses.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [
        ("MIT", 1), ("MIT", 1), ("MIT", 1), ("MIT", 1), ("", 0), ("Apache-2.0", 1), ("GPL-3.0-only,MIT", 2), ("", 0), ("", 0), ("", 0), ("MIT", 3)]
    assert licenses.report(none).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC_FILE = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE_HEADER = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_NOTICE = """dnl This program is free software: you can redistribute it and/or modify
dnl it under the terms of the GNU General Public License as published by
dnl the Free Software Foundation, either version 3 of the License, or
dnl (at your option) any later version.
dnl
dnl This program is distributed in the hope that it will be useful,
dnl but WITHOUT ANY WARRANTY; without even the implied warranty of
dnl MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
dnl GNU General Public License for more details.
dnl
dnl You should have received a copy of the GNU General Public License
dnl along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
LGPL_NOTICE = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_wrapped_licences(spark):
    rows = [
        MIT_FILE, MIT_FILE.replace("\n", "\r\n"), BSD_FILE, BSD_FILE + BSD_THIRD, ISC_FILE, APACHE_HEADER, GPL_NOTICE, LGPL_NOTICE, MPL_HEADER,
        "Prose\n" + BSD_FILE + "\nmore prose\nwrapped\nover\nlines\n" + MIT_FILE, MIT_FILE.replace("without restriction", "with restriction"),
        'Licensed under the Apache License, Version 2.0\n(the "License"); you may not use this\nfile except in compliance with the License.',
        "See: Released under\nthe MIT License.\nOr not released under\nthe MIT License.",
    ]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [(got[i].licenses, got[i].n_matches) for i in range(len(rows))] == [
        ("MIT", 1), ("MIT", 1), ("BSD-2-Clause", 1), ("BSD-3-Clause", 1), ("ISC", 1), ("Apache-2.0", 1), ("GPL-3.0-or-later", 1),
        ("LGPL-2.1-or-later", 1), ("MPL-2.0", 1), ("BSD-2-Clause,MIT", 2), ("", 0), ("Apache-2.0", 1), ("MIT", 1)]
    # a wrapped sentence counts once: title, grant, condition and warranty; copyright line, four lines of the disclaimer and a rest
    assert (got[0].n_known, got[0].n_sentences) == (4, 10)
    assert (got[5].n_known, got[6].n_known) == (4, 6)


# --- chat ---------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<\\|im_end|>\n", "<", "|x", "a<|b<\\\\|c", "", None, "é<|", "<<|im_start|>assistant\n"]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|x"]), rng.choice(odd) if rng.random() < 0.6 else sentence(rng, 9))
            for c in (None, 1, 2, 7) for t in [None, *range(rng.randrange(1, 40))]]
    rows += [(7, 3, "assistant", "twice"), (7, 3, "assistant", "twice"), *[(9, t, "assistant", "<|" * 3) for t in range(700)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.report(df).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    by = defaultdict(list)
    for r in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by[r[0]].append(r)
    low = lambda r: tuple((x is not None, x) for x in r[1:])
    for c, turns in by.items():
        turns.sort(key=low)
        all_ = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(all_.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == set(by)
    assert [r.conv_id for r in chat.report(df.limit(0)).collect()] == [-1]


def test_escapes():
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice("<|\\a") for _ in range(rng.randrange(12))).encode()
        assert chat.unescape(chat.escape(t)) == t and b"<|" not in chat.escape(t)


# --- decontamination --------------------------------------------------------------------------------------

ITEMS = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (1, "Short ITEM here"), (2, None), (3, "..."), (10, "short item here"),
         (4, "one two three four five six seven eight nine ten")]
LEAKS = [
    "x " + ITEMS[0][1] + " y", "beta gamma delta epsilon zeta eta theta iota kappa lambda", "a short, item! here. and SHORT item here", None, "", "!!",
    "nothing of it", ITEMS[5][1].upper() + " eleven", "two three four five six seven eight nine ten", "shört short item here é", "short item"]


def brute_hits(text):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    w, hit, items = find(text), set(), set()
    for i, t in ITEMS:
        b = find(t)
        n = min(10, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == b[k : k + n]:
                    hit |= set(range(a, a + n))
                    items.add(str(i))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("limit", [10**6, 2])
def test_benchmark_hits(spark, none, limit):
    rows = list(enumerate(LEAKS))
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in rows], SCHEMA)
    bench = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, spans string")
    got = {r._id: r for r in decontaminate.find_hits(docs, bench, max_windows=limit).collect()}
    for i, t in rows:
        n, hit, items = brute_hits(t)
        r = got[i]
        assert (r.n_words, sum(s["last"] - s["first"] for s in r.spans), r.items) == (n, hit, items), t
    clean = decontaminate.drop_documents(docs, bench, max_windows=limit)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in rows if not brute_hits(t)[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, max_windows=limit).collect()}
    assert cut[2] == "a . and " and cut[9] == "shört  é" and cut[3] is None and cut[6] == LEAKS[6]
    assert decontaminate.find_hits(none, bench).count() == 0
    assert decontaminate.drop_documents(docs, bench.limit(0)).count() == len(rows)


# --- mixing ------------------------------------------------------------------------------------------------

def test_budgets_go_to_siblings_first(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10_000), ("web", "de", "c", 10_000), ("forum", "en", "d", 50), ("forum", "de", "e", 50)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    how = mixing.Targets(domain={}, lang={}, source={}, budget_percent=50, max_epochs=1)
    got = {r.source: r.budget for r in mixing.leaf_budgets(df, how).collect()}
    total = sum(x[3] for x in leaves) // 2
    # forum can't fill its half: what it lacks goes to web; a's shortage goes to its sibling b, not to c
    assert got["d"] == got["e"] == 50 and got["a"] == 100
    web = total - 100
    assert abs(got["c"] - web // 2) <= 1 and abs(got["b"] - (web // 2 - 100)) <= 1


def test_mix_gives_no_budget_to_what_a_weight_leaves_out_below(spark):
    leaves = [("web", "en", "src1", 100), ("web", "en", "src3", 900), ("web", "de", "src1", 500), ("forum", "en", "src7", 800), ("forum", "en", "src8", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    even = dict(domain={}, lang={}, max_epochs=1)
    left_out = mixing.Targets(**even, source={"src3": 0}, budget_percent=50)
    # 1,150 tokens: web can only read 600 of them, 575 is its share; en has 100 and de the rest of it
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, left_out).collect() if r.budget}
    assert got == {("web", "en", "src1"): 100, ("web", "de", "src1"): 475, ("forum", "en", "src7"): 575}
    whole = mixing.Targets(**even, source={"src3": 0}, budget_percent=60)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, whole).collect() if r.budget}
    assert got == {("web", "en", "src1"): 100, ("web", "de", "src1"): 500, ("forum", "en", "src7"): 780}


def test_mix_takes_exact_prefixes(spark, docs, none):
    how = mixing.Targets(budget_percent=130, max_epochs=3)
    rows = mixing.mix(docs, how).collect()
    used = defaultdict(int)
    for r in rows:
        used[(r.domain, r.lang or "unknown", r.source or "unknown")] += r.take_tokens
        assert 0 <= r.take_tokens <= r.tokens and 0 <= r.epoch < 3
    from pyspark.sql import functions as F

    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    sums = docs.groupBy(F.coalesce(mixing.domain_of(F.col("source")), F.lit("unknown")).alias("domain"), named("lang").alias("lang"), named("source").alias("source")).agg(
        F.sum(mixing.token_count(F.col("text"))).alias("tokens"))
    budgets = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(sums, how).collect()}
    assert {k: v for k, v in budgets.items() if v} == {k: v for k, v in used.items() if v}
    seen = [(r.doc_id, r.epoch) for r in rows]
    assert len(seen) == len(set(seen)) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, how).collect()))
    assert mixing.mix(none, how).count() == 0
    assert set(docs.columns) - {"tokens"} <= set(mixing.mix(none, how).columns)
