"""Every corpus operator on null and huge ids, repeated rows, empty tables and clashing columns; and those without SQL against brute force."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontamination, labelled, licenses, mixture, paragraph_dedup, quality_ranking, quality_rules, secrets, simhash, textstats, token_counts, warc_zip

BPE = public_tokenizers.path("byte_bpe_50k.json")
IDS = [None, -1, 2**53 + 1, 2**63 - 1, 2**63 - 1, None, 7]
CLASH = ("bucket", "size", "offset", "row", "node", "key", "keys", "spans", "score", "digest", "target", "c0", "text_hash", "start", "place", "n")


def words(draw, n, vocabulary=10**6):
    return [f"w{k}" for k in draw.integers(0, vocabulary, n)]


def table(spark, ids, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(ids))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


def long_texts():
    draw = np.random.default_rng(21)
    shared = " ".join(words(draw, 70))
    return [shared, "", " ".join(words(draw, 3000)) + " " + shared, shared, shared, shared, None]


def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (2**53 + 1, None, 0)], "doc_id long, quality int, toxic int")


BENCH = "item_id long, text string"
PER_DOCUMENT = {
    "op2": lambda s, d: secrets.find_secrets(d),
    "op4": lambda s, d: licenses.scan_licenses(d),
    "op5": lambda s, d: mixture.mix_sources(d),
    "op6": lambda s, d: token_counts.count_tokens(d, BPE, head=10),
    "op7": lambda s, d: quality_ranking.classify_quality(d, labels(s)),
    "op9": lambda s, d: simhash.simhash_components(d),
    "op10": lambda s, d: quality_rules.quality_rules(d, labels(s)),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_each_row_comes_back_with_its_own_id(spark, name):
    docs = table(spark, IDS, long_texts())
    got = PER_DOCUMENT[name](spark, docs)
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(IDS)
    of = lambda r: tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "held_out", "text_hash", "position", "taken", "passes", "occurrences", "tie"))
    same = [of(r) for r in rows if r.doc_id == 2**63 - 1]
    assert len(same) == 2 and same[0] == same[1]
    empty = PER_DOCUMENT[name](spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_ids_of_another_type_pass(spark):
    docs = table(spark, [1, 2], ["a b c", None]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for run in (PER_DOCUMENT[op] for op in ("op2", "op4", "op5", "op6", "op9")):
        assert sorted(r.doc_id for r in run(spark, docs).collect()) == ["d1", "d2"]


def test_repeated_passages_keep_their_ids(spark):
    got = paragraph_dedup.repeated_paragraphs(table(spark, IDS, long_texts())).collect()
    # The whole texts are one cluster; the long line's end and the first of them are another.
    assert Counter(r.doc_id for r in got) == Counter([None, None, 2**53 + 1, 2**63 - 1, 2**63 - 1, 2**63 - 1])
    assert {r.first_doc_id for r in got} == {2**53 + 1} or {r.first_doc_id for r in got} == {2**63 - 1, 2**53 + 1}
    assert paragraph_dedup.repeated_paragraphs(table(spark, IDS, long_texts()).limit(0)).count() == 0


def test_near_copies_keep_their_ids_and_columns(spark):
    docs = table(spark, IDS, long_texts())
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [-1, 2**53 + 1, 2**63 - 1]


def test_leaks_keep_their_ids(spark):
    item = " ".join(words(np.random.default_rng(2), 30))
    docs = table(spark, IDS, [item if k % 2 == 0 else None for k in range(7)])
    bench = spark.createDataFrame([(2**53 + 1, item), (None, "")], BENCH).withColumn("doc_id", F.lit("clash"))
    got = decontamination.find_leaks(docs, bench).collect()
    assert Counter(r.doc_id for r in got) == Counter(IDS[::2]) and {r.item_id for r in got} == {2**53 + 1}
    assert Counter(r.doc_id for r in decontamination.remove_leaks(docs, bench).collect()) == Counter(IDS[1::2])


def test_archives_keep_their_ids(spark):
    html = "x" * 200
    pages = spark.createDataFrame([(i, "u", html) for i in (2**53 + 1, -1, 2**63 - 1, -1, None)], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH})
    got = warc_zip.archive_round_trip(pages).collect()
    assert Counter(r.page_id for r in got) == Counter([2**53 + 1, -1, 2**63 - 1, -1, None])
    # Rows of the very page that is kept are all responses; every other revisits it.
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(-1, "response", None), (2**53 + 1, "revisit", -1), (2**63 - 1, "revisit", -1), (None, "revisit", -1)}


def test_labelled_sample_is_bounded_whatever_repeats(spark):
    docs = table(spark, [1] * 500 + list(range(2, 60)), [f"word {k}" for k in range(558)])
    given = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] * 3, "doc_id long, quality int, toxic int")
    x, y = labelled.training_sample(docs, given, limit=10)
    assert len(x) == len(y) <= 10
    x, y = labelled.training_sample(docs, given)
    held_out = sum(__import__("zlib").crc32(str(k).encode()) % 5 == 0 for k in range(1, 60))
    assert len(x) == 59 - held_out
    assert labelled.sampled_labels(given, limit=5).count() == 5


# --- brute force --------------------------------------------------------------------------------------------------------


def test_every_repeated_run_of_fifty_words_is_found(spark):
    draw = np.random.default_rng(31)
    passages = [words(draw, int(n)) for n in draw.integers(50, 120, 12)]
    texts = []
    for k in range(60):
        parts = [words(draw, int(draw.integers(10, 150)))]
        for p in draw.choice(12, int(draw.integers(0, 3)), replace=False):
            passage = list(passages[p])
            if k % 7 == 0 and len(passage) > 105:
                passage[52] = "changed"  # a near copy with a run of 50 words on one side
            parts += [passage, words(draw, int(draw.integers(5, 60)))]
        flat = [w for p in parts for w in p]
        breaks = set(draw.choice(len(flat), len(flat) // 30, replace=False).tolist())
        texts.append("".join(w + ("\n" if i in breaks else " ") for i, w in enumerate(flat)))
    got = {}
    for r in paragraph_dedup.repeated_paragraphs(table(spark, list(range(60)), texts)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    runs = Counter()
    split = [t.split() for t in texts]
    seen = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])] += 1
            seen.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    want = {}
    for run, n in runs.items():
        if n > 1:
            for d, i in seen[run]:
                want.setdefault(d, set()).update(range(i, i + 50))
    assert want and all(want[d] <= got.get(d, set()) for d in want)
    clean = set(range(60)) - set(want)
    assert clean and all(d not in got for d in clean)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_license_coverage_against_plain_alignment(spark):
    draw = np.random.default_rng(41)
    texts, ids = [], []
    known = [(name, t) for name, several in licenses.NOTICES.items() for t in several if len(licenses.words_of(t)) > licenses.SHORT_WORDS]
    for k in range(60):
        name, notice = known[int(draw.integers(0, len(known)))]
        w = notice.split()
        for at in sorted(draw.choice(len(w), int(len(w) * draw.choice([0.0, 0.1, 0.15, 0.3, 0.5])), replace=False).tolist(), reverse=True):
            if draw.random() < 0.5:
                del w[at]
            else:
                w[at] = f"other{at}"
        texts.append(" ".join([*words(draw, 40), *w, *words(draw, 40)]))
        ids.append(k)
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, ids, texts)).collect()}
    for k, t in enumerate(texts):
        w = licenses.words_of(t)
        best = max(lcs(licenses.words_of(n), w) / len(licenses.words_of(n)) for _, n in known)
        if best >= licenses.COVERAGE + 0.03:
            assert got[k].coverage is not None and got[k].coverage >= licenses.COVERAGE
        if best < licenses.COVERAGE:
            assert got[k].license_id is None


def test_doubled_notices_and_long_gaps(spark):
    gpl, mit = licenses.NOTICES["GPL-3.0"][0], licenses.NOTICES["MIT"][2]
    filler = " ".join(words(np.random.default_rng(1), 24))
    stray = mit.split()
    texts = [f"{filler} {gpl} {gpl} {filler}", f"{gpl} a b c d e f g h i j {gpl}", " ".join([*stray[:30], *["zz"] * 20, *stray[30:]]), "Licensed under the Other License", f"{filler} whether sublicense {filler * 9} {mit}"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, list(range(5)), texts)).collect()}
    assert [got[k].licenses for k in range(5)] == ["GPL-3.0", "GPL-3.0", "MIT", "", "MIT"] and [got[k].n_places for k in range(4)] == [2, 2, 1, 0]


def test_ranking_equals_a_plain_logistic_fit():
    draw = np.random.default_rng(51)
    x = draw.normal(0, 1, (600, len(textstats.FEATURES)))
    y = (x[:, 0] - 0.5 * x[:, 3] + draw.normal(0, 0.5, 600) > 0).astype(int)
    ranking = quality_ranking.fit(x, y, pairs=3000)
    z = quality_ranking.design(x, ranking.centre, ranking.scale)
    pick = np.random.default_rng(7)
    d = z[pick.choice(np.flatnonzero(y == 1), 3000)] - z[pick.choice(np.flatnonzero(y == 0), 3000)]
    w = np.zeros(d.shape[1])
    for _ in range(20_000):
        w -= 0.2 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + quality_ranking.RIDGE * w)
    assert np.abs(w - ranking.weights).max() < 0.02


def test_flat_trees_equal_a_plain_walk():
    draw = np.random.default_rng(61)
    x = draw.random((500, len(textstats.FEATURES)))
    y = (x[:, 2] + x[:, 5] * x[:, 7] > 0.8).astype(int)
    forest = quality_rules.fit_forest(x, y)
    plain = []
    for row in x[:100]:
        total = forest.base
        for t in range(len(forest.feature)):
            at = 0
            while not forest.leaf[t, at]:
                at = 2 * at + 1 + (row[forest.feature[t, at]] > forest.limit[t, at])
            total += forest.value[t, at]
        plain.append(1 / (1 + np.exp(-total)))
    assert np.allclose(forest.score(x[:100]), plain)


def test_leaks_against_brute_force(spark):
    draw = np.random.default_rng(71)
    pool = [f"v{k}" for k in range(400)]
    some = lambda n: list(draw.choice(pool, n))
    items = [[*some(int(n)), "?"] for n in draw.integers(8, 60, 120)]
    answers = [some(int(n)) for n in draw.integers(1, 6, 120)]
    bench = spark.createDataFrame([(k, " ".join(q) + "\n" + " ".join(a)) for k, (q, a) in enumerate(zip(items, answers, strict=True))], BENCH)
    texts = []
    for k in range(80):
        body = some(int(draw.integers(30, 400)))
        if k % 2:
            q, a = items[k], answers[k]
            body[20:20] = [*q, *a] if k % 4 == 1 else [*q[: len(q) // 2], "x", *q[len(q) // 2 :], *a]
        texts.append(" ".join(body))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(table(spark, list(range(80)), texts), bench).collect()}

    def share(gram_words, there):
        n = min(5, len(gram_words))
        grams = {tuple(gram_words[k : k + n]) for k in range(len(gram_words) - n + 1)}
        held = {tuple(there[k : k + n]) for k in range(len(there) - n + 1)}
        return len(grams & held) / len(grams) if grams else 1.0

    want = set()
    for d, t in enumerate(texts):
        there = decontamination.terms_of(t)
        for k, (q, a) in enumerate(zip(items, answers, strict=True)):
            whole, question, answer = decontamination.terms_of(" ".join([*q, *a])), decontamination.terms_of(" ".join(q)), decontamination.terms_of(" ".join(a))
            asked = share(question, there) if share(answer, there) >= 0.5 or len(question) >= decontamination.ENOUGH_WORDS else 0
            if max(share(whole, there) if len(whole) else 0, asked) >= decontamination.OVERLAP:
                want.add((d, k))
    assert want and len(got & want) >= 0.97 * len(want) and got <= want


def test_a_whole_part_of_a_long_item_counts(spark):
    draw = np.random.default_rng(72)
    item = words(draw, 200)
    unit = decontamination.units_of(" ".join(item))[1]
    docs = table(spark, [1, 2], [" ".join(words(draw, 50)) + " " + b" ".join(unit).decode(), " ".join(words(draw, 100))])
    assert [r.doc_id for r in decontamination.find_leaks(docs, spark.createDataFrame([(9, " ".join(item))], BENCH)).collect()] == [1]


LINKED = {
    "account": (r"(?i)\b(?:client|access|account|key|user)[_-]?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", "id"),
    "endpoint": (r"(?i)\b(?:https?|s?ftp|ssh|jdbc:[a-z0-9]+|amqps?|rediss?|mongodb|postgres(?:ql)?|mysql)://[^\s\x22'<>|]+", "endpoint"),
}


def test_linking_against_plain_distances(spark):
    draw = np.random.default_rng(81)
    parts = ["user_id: alice1", "https://host.example/p", "password = topsecret99", "AKIA" + "Q" * 16, "deadbeef" * 4]
    texts = []
    for _ in range(60):
        pieces = []
        for p in draw.choice(5, int(draw.integers(1, 5)), replace=False):
            pieces += [parts[p], "é " * int(draw.choice([1, 50, 150, 230]))]
        texts.append(" ".join(pieces))
    got = {r.doc_id: r for r in secrets.find_secrets(table(spark, list(range(60)), texts)).collect()}
    for k, t in enumerate(texts):
        spans = [(m.start(), m.end(), kind, part) for kind, (pattern, part) in LINKED.items() for m in re.finditer(pattern, t)]
        spans += [(m.start(), m.end(), "base", part) for pattern, part in ((r"password = topsecret99", "secret"), (r"AKIAQ+", "id"), (r"(?:deadbeef)+", "secret")) for m in re.finditer(pattern, t)]
        near = lambda s, part, spans=spans: any(o is not s and o[3] == part and max(o[0] - s[1], s[0] - o[1]) <= secrets.SCOPE for o in spans)
        want = {f"{s[2]}:{s[0]}:{s[1]}" for s in spans if (s[2] == "account" and near(s, "secret")) or (s[2] == "endpoint" and near(s, "id") and near(s, "secret"))}
        assert {x for x in got[k].spans.split(",") if x.startswith(("account", "endpoint"))} == want, t


@pytest.mark.parametrize("n", [40, 65, 86, 300])
def test_random_keys_of_any_length_are_linked(spark, n):
    key = ("aB3" + "xY7-_" * 100)[: n - 2] + "=="
    texts = [f"AccountName=storage1;x {key} y", f"only {key} here", f"see https://h.example/{key} alone"]
    got = {r.doc_id: r for r in secrets.find_secrets(table(spark, [0, 1, 2], texts)).collect()}
    assert f"random:{texts[0].index(key)}:{texts[0].index(key) + n}" in got[0].spans and got[1].n_linked == 0 and got[2].n_linked == 0


def test_mixing_is_spread_and_repeatable_with_shared_ids(spark):
    texts = ["w " * (k % 7) for k in range(300)]
    docs = table(spark, [None] * 100 + [5] * 100 + list(range(100)), texts, ["a", "b", None] * 100)
    a, b = (mixture.mix_sources(d, bucket_docs=4).drop("occurrences") for d in (docs, docs.repartition(5)))
    key = lambda rows: sorted(map(repr, rows))
    assert key(a.drop("position", "passes", "taken").collect()) == key(b.drop("position", "passes", "taken").collect())
    for r in a.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 1
    buckets = spark.createDataFrame([(False, s, k, k % 5) for s in ("a", "b") for k in range(57)], "no_source boolean, source_key string, bucket long, bucket_size long")
    got = {(r.source_key, r.bucket): r.bucket_offset for r in mixture._offsets(buckets, fan_out=3).collect()}
    assert got == {(s, k): sum(j % 5 for j in range(k)) for s in ("a", "b") for k in range(57)}
