"""Periodic runs against comparing the text with itself at every distance."""

import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import periodic_runs, queries

DATA = "/root/testdata/sf0.001"


def brute_force(letters, min_length=12):
    n, found = len(letters), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and letters[j] == letters[j + q]:
                j += 1
            if j - i >= q and j - i + q >= min_length:
                found.setdefault((i, j - i + q), q)  # distances ascend: the first is the smallest period
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_lyndon(letters):
    """The next smaller suffix ends the longest Lyndon word."""
    return [next((j for j in range(i + 1, len(letters)) if letters[j:] < letters[i:]), len(letters)) - i for i in range(len(letters))]


def summary(words):
    runs = brute_force(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    text = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(lines.encode()).hexdigest(), sha256(text.encode()).hexdigest())


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


LETTERS = st.one_of(st.lists(st.integers(0, 1), max_size=60), st.lists(st.integers(0, 3), max_size=80), st.builds(lambda w, k, t: w * k + t, st.lists(st.integers(0, 4), max_size=9), st.integers(1, 12), st.lists(st.integers(0, 4), max_size=9)))


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_lyndon_words_are_the_longest(letters):
    assert periodic_runs.lyndon_lengths(letters).tolist() == plain_lyndon(letters)


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS, max_size=5), st.sampled_from((2, 5, 12)))
def test_runs_are_those_of_brute_force(texts, least):
    arrays = [np.array(t, dtype=np.int64) for t in texts]
    assert [[tuple(r) for r in runs.tolist()] for runs in periodic_runs.runs_of_texts(arrays, least)] == [brute_force(t, least) for t in texts]
    assert [[tuple(r) for r in periodic_runs.runs_of(a, least).tolist()] for a in arrays] == [brute_force(t, least) for t in texts]


def test_a_text_of_a_million_equal_words_and_a_long_period():
    ones = np.zeros(300_000, dtype=np.int64)
    assert periodic_runs.runs_of(ones).tolist() == [[0, 300_000, 1]]
    draw = np.random.default_rng(3).integers(0, 50, 40_001)
    assert [40_001, 120_003] == periodic_runs.runs_of(np.tile(draw, 3))[:, [2, 1]].max(axis=0).tolist()


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = [w.decode() for w in (r.text or "").encode().split()]
        if len(words) < 3000:
            assert got[r.doc_id] == summary(changed(r.doc_id, words)), r.doc_id


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nulls_ties_repeats_empty_tables_and_clashing_columns(spark, kind):
    again = " ".join(["x y z"] * 5 + ["gap"] + ["p q r"] * 5)
    texts = [None, "", "one", again, again, "\x1f " * 30, "é　 é　 " * 10, "a b " * 3 + "a"]
    ids = [None, "5", "6", "7", "7", "8", None, "9"]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    docs = docs.withColumns({c: F.lit("clash") for c in ("given", "hash", "n_runs", "start", "length", "period", "collapsed", "c0")})
    got = periodic_runs.summarise_runs(docs)
    want = [(docs.schema["doc_id"].dataType.typeName() == "string" and i or (int(i) if i else None), *summary([w.decode() for w in (t or "").encode().split()])) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert summary(again.split())[:4] == (2, 0, 15, 3)
    assert periodic_runs.summarise_runs(docs.limit(0)).count() == 0
    collapsed = periodic_runs.collapse_runs(docs)
    assert collapsed.columns == docs.columns
    kept = Counter(r.text for r in collapsed.collect())
    assert kept["x y z gap p q r"] == 2 and kept[None] == 1 and kept[""] == 1 and kept["one"] == 1 and kept["a b a b a b a"] == 1
    assert {r.given for r in collapsed.collect()} == {"clash"} and collapsed.limit(0).count() == 0


def test_long_texts_are_read_whole(spark):
    draw = np.random.default_rng(9)
    body = [f"w{k}" for k in draw.integers(0, 10**6, 300_000)]
    text = " ".join(body + ["tail"] * 14)
    row = periodic_runs.summarise_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 300_000, 14, 1, 14_000)
    assert row.collapsed_sha256 == sha256(" ".join(body + ["tail"]).encode()).hexdigest()
