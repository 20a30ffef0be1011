"""Secrets, mixing, licenses, decontamination and archives against plain Python."""

import gzip
import hashlib
import io
import re
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontamination, licenses, mixture, secrets, warc_zip

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "AKIA" + "Q" * 16


def docs(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["a"] * len(texts))[k], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def base_spans(text):
    spans = []
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, pattern, good in (
        (0, assign, lambda m: len(m[2]) >= 6),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m)]
    return sorted(spans)


TEXTS = [
    None,
    "",
    "nothing here",
    'é😀 password = "hunter22" and API_KEY:abcdef0123456789abcdef01 tail',
    "secret:token:abcdefgh secret: abc token=short1",
    f"id {KEY} {KEY}X AKIA123 deadbeefdeadbeefdeadbeef",
    "user_id: alice and nothing",
    "user_id: alice then password: topsecret99",
    "see https://host.example/x with nothing else",
    f"{KEY} https://host.example/x token = abcdef1",
    " ".join(f"token={'x' * 5}{k:04d}" for k in range(700)),
    'user_id: alice then password: topsecret99',
]


def test_secret_base_spans_match_plain_regexes(spark):
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, TEXTS)).collect()}
    names = ("assign", "access", "hex")
    for k, t in enumerate(TEXTS):
        want = base_spans(t or "")
        assert hashlib.sha256(",".join(f"{names[x]}:{a}:{b}" for a, x, b in want).encode()).hexdigest() == got[k].base_sha256, t
        assert [got[k][f"n_{n}"] for n in names] == [sum(x == i for _, x, _ in want) for i in range(3)]
        assert set(f"{names[x]}:{a}:{b}" for a, x, b in want) <= set(got[k].spans.split(",")) | {""}
    assert got[6].n_linked == 0 and got[7].n_linked == 1 and "account:0:14" in got[7].spans and got[11].spans == got[7].spans
    assert got[8].n_linked == 0 and got[9].n_linked == 1 and "endpoint" in got[9].spans


def test_secret_redaction_keeps_the_rest(spark):
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, TEXTS)).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "nothing here"
    assert clean[3] == "é😀 [SECRET]\" and [SECRET] tail"
    assert clean[7] == "[SECRET] then [SECRET]"


def test_secrets_on_empty_tables_and_extra_columns(spark):
    d = docs(spark, TEXTS).withColumn("spans", F.lit("x")).withColumn("start", F.lit(1))
    assert secrets.find_secrets(d).count() == len(TEXTS) and secrets.find_secrets(d.limit(0)).count() == 0
    assert secrets.redact(d).columns == d.columns


def water_fill(sizes, weights):
    total, capped, target = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > 3 * sizes[i] + 1e-9]
        if not over:
            return target
        for i in over:
            capped.add(i)
            target[i] = 3 * sizes[i]
        if len(capped) == len(sizes):
            return target


def test_mixture_meets_targets(spark):
    draw = np.random.default_rng(1)
    sources = [["b", "a", None, "ä", "z"][k] for k in draw.choice(5, 400, p=[0.6, 0.02, 0.18, 0.1, 0.1])]
    texts = [" ".join(["w"] * int(n)) if n else None for n in draw.integers(0, 60, 400)]
    got = mixture.in_training_order(mixture.mix_sources(docs(spark, texts, sources), bucket_docs=16)).toPandas()
    order = ["a", "b", "z", "ä", None]
    sizes = [sum(len((t or "").split()) for t, s in zip(texts, sources) if s == o) for o in order]
    want = water_fill(sizes, [5, 2, 1, 5, 2])
    source_of = dict(enumerate(sources))
    for o, size, target in zip(order, sizes, want, strict=True):
        part = got[got.doc_id.map(lambda d, o=o: source_of[d] == o)]
        assert (part.source_size == size).all() and np.allclose(part.target, target)
        assert abs(part.taken.sum() - target) <= 1 and (part.taken <= 3 * part["size"]).all()
    place = got.position.dropna()
    assert place.is_monotonic_increasing and place.between(0, 1).all()
    again = mixture.in_training_order(mixture.mix_sources(docs(spark, texts, sources).repartition(7), bucket_docs=16)).toPandas()
    pd.testing.assert_frame_equal(got.drop(columns="occurrences"), again.drop(columns="occurrences"))
    sequence = mixture.training_sequence(mixture.mix_sources(docs(spark, texts, sources))).toPandas()
    assert sequence.position.is_monotonic_increasing and sequence.words.sum() == got.taken.sum()


def test_mixture_of_nothing(spark):
    assert mixture.mix_sources(docs(spark, ["x"]).limit(0)).count() == 0
    only = mixture.mix_sources(docs(spark, [None, ""])).toPandas()
    assert (only.taken == 0).all() and (only.target == 0).all() and only.position.isna().all()


def test_patience_alignment_and_license_scan(spark):
    pairs = licenses.patience("a b c d e".split(), "x a b q c e d e".split())
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:])) and len(pairs) == 5
    permission = licenses.NOTICES["MIT"][2]
    texts = [
        "word " * 500 + "Released under the MIT License. " + "more " * 300,
        "by " * 2000 + "Licensed under CC BY-NC 4.0",
        "the license of a mit student",
        permission.replace("free of charge", "at no charge").upper(),
        None,
        "",
        "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[k].license_id for k in range(6)] == ["MIT", "CC-BY-NC-4.0", None, "MIT", None, None]
    assert got[0].start_word == 500 and got[0].coverage == 1.0 and 0.9 < got[3].coverage < 1
    assert got[6].licenses == "Apache-2.0,GPL-3.0" and got[4].licenses == ""


def test_bm25_wand_equals_exhaustive_scores():
    draw = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(draw.choice(words, draw.integers(3, 90)))) for k in range(80)]
    units = [u for _, t in items for u in decontamination.units_of(t)]
    frequency = {w.encode(): sum(w.encode() in u for u in units) for w in words}
    index = decontamination.Index(items, frequency, len(units), np.mean([len(u) for u in units]))
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(40):
            terms = sorted(draw.choice(len(index.vocabulary), 30, replace=False).tolist())
            score = np.zeros(len(units))
            for t in terms:
                for u, w in zip(*index.postings[t], strict=True):
                    score[u] += w
            got = dict(index.retrieve(terms, threshold))
            assert set(got) == set(np.flatnonzero(score >= threshold).tolist())
            assert all(abs(got[u] - score[u]) < 1e-9 for u in got)


def test_leaks_are_found_inside_long_texts(spark):
    draw = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]
    some = lambda n: " ".join(draw.choice(words, n))
    items = [some(40) + "\n" + some(8), some(150), "short one", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    changed = items[1].split()
    changed[70] = "other"
    texts = [some(5000), some(1000) + " " + items[0].replace("\n", " ").upper() + " " + some(777), some(33) + " " + " ".join(changed), items[0][: len(items[0]) // 3], None, "", items[0]]
    d = docs(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, bench).collect()}
    assert got == {(1, 0), (2, 1), (6, 0)}
    assert [r.doc_id for r in decontamination.remove_leaks(d, bench).orderBy("doc_id").collect()] == [0, 3, 4, 5]
    assert decontamination.find_leaks(d, bench.limit(0)).count() == 0 and decontamination.find_leaks(d.limit(0), bench).count() == 0
    split = [list(i.items) for i in decontamination.indexes(bench, shard_bytes=300)]
    assert sum(map(len, split)) == 3 and len(split) > 1


PAGES = "page_id long, url string, html string"


def test_archive_round_trip_and_other_readers(spark, tmp_path):
    long, other = "<p>é</p>" * 40, "<b>" + "x" * 100
    rows = [(5, "http://a/é\r\nx", long), (3, "http://b", long), (4, None, long), (9, "u", "tiny"), (8, "u", "tiny"), (7, "u", None), (None, "u", other), (10, "u", other), (11, "u", other)]
    pages = spark.createDataFrame(rows, PAGES)
    got = {(r.page_id, r.payload_digest): r for r in warc_zip.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        row = got[page_id, hashlib.sha256(payload).hexdigest()]
        first = {long: 3, other: 10}.get(html)
        revisit = first is not None and page_id != first
        assert row.payload_bytes == len(payload) and row.record_type == ("revisit" if revisit else "response")
        assert row.refers_to == (first if revisit else None)
    manifest = warc_zip.write_archives(warc_zip.page_records(pages).coalesce(1), f"file://{tmp_path}/z", archive_bytes=400)
    paths = [r.path.removeprefix("file://") for r in manifest.collect()]
    assert len(paths) > 1
    seen = 0
    for path in paths:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and z.namelist() == [warc_zip.RECORDS, warc_zip.INDEX]
            seen += gzip.GzipFile(fileobj=io.BytesIO(z.read(warc_zip.RECORDS))).read().count(b"WARC/1.1\r\n")
    assert seen == len(rows)


def test_reader_takes_archives_of_the_standard_library():
    for force in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in (("a", b"123"), (warc_zip.RECORDS, b"abcdef" * 9)):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as f:
                    f.write(data)
            z.comment = b"a comment"
        raw = out.getvalue()
        read = lambda at, n, raw=raw: raw[at : at + n]
        found = {m.name: m for m in warc_zip.members(read, len(raw))}
        start = warc_zip.member_start(read, found[warc_zip.RECORDS])
        assert raw[start : start + found[warc_zip.RECORDS].size] == b"abcdef" * 9
    with pytest.raises(ValueError):
        warc_zip.members(lambda at, n: b"x" * n, 100)


def test_archive_of_no_pages(spark):
    assert warc_zip.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0
