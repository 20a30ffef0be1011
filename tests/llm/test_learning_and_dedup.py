"""Deduplication, token counts and learnt filters against brute force and held-out labels."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import candidates, components, labelled, paragraph_dedup, quality_ranking, quality_rules, simhash, textstats, token_counts

DATA = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts, strict=True)), "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("node", F.lit(1))


def some_words(draw, n, vocabulary=2000):
    return [f"w{k}" for k in draw.integers(0, vocabulary, n)]


def roots(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    draw = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in draw.integers(0, 300, (230, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 700)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = roots(700, edges)
    assert got == {n: want[n] for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- paragraphs ---------------------------------------------------------------------------------------------------------


def test_bands_reach_the_recall():
    bands, rows = paragraph_dedup.tune_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and 1 - (1 - (0.8 / 3) ** rows) ** bands <= 0.1
    draw = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        shared = draw.integers(0, 1 << 62, 80).astype(np.uint64)
        a, b = (np.concatenate([shared, draw.integers(0, 1 << 62, 10).astype(np.uint64)]) for _ in range(2))
        keys = paragraph_dedup.minhash_bands(np.concatenate([a, b]), np.array([0, len(a)]), bands, rows)
        found += (keys[0] == keys[1]).any()
    assert found / 300 > 0.97


def test_shingles_of_many_paragraphs_equal_those_of_each():
    draw = np.random.default_rng(9)
    for least in (1, 5):
        parts = [draw.integers(0, 1 << 62, int(n)).astype(np.uint64) for n in draw.integers(least, 40, 30)]
        hashes, starts = paragraph_dedup._all_shingles(np.concatenate(parts), np.array([len(x) for x in parts]), 5)
        assert all(np.array_equal(x, paragraph_dedup.shingle_hashes(y, 5)) for x, y in zip(np.split(hashes, starts[1:]), parts, strict=True))


def test_repeated_paragraphs_against_brute_force(spark):
    draw = np.random.default_rng(1)
    passage = some_words(draw, 60)
    near = list(passage)
    near[30] = "other"
    line = lambda w: " ".join(w)
    texts = [
        line(some_words(draw, 80)) + "\n" + line(passage) + "\nshort line",
        line(some_words(draw, 40)) + "\n" + line(near).upper().replace(" ", "  ") + "\nshort line",
        line(some_words(draw, 90)),
        line(passage) + "\n" + line(passage),
        None,
        "",
        "\n\n",
    ]
    got = paragraph_dedup.repeated_paragraphs(docs(spark, texts)).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.line, r.removed) for r in got] == [(0, 1, False), (1, 1, True), (3, 0, True), (3, 1, True)]
    assert {(r.cluster, r.first_doc_id, r.first_line, r.occurrences) for r in got} == {(got[0].cluster, 0, 1, 4)}
    assert (got[0].start, got[0].end) == (80, 140)
    twice = paragraph_dedup.repeated_paragraphs(docs(spark, [texts[2]] * 3, [7, 7, None])).collect()
    assert sorted(r.removed for r in twice) == [False, True, True] and all(r.first_doc_id == 7 for r in twice)
    assert paragraph_dedup.repeated_paragraphs(docs(spark, ["x"]).limit(0)).count() == 0


def test_passages_inside_and_across_lines_are_found(spark):
    draw = np.random.default_rng(12)
    passage, short, less = (some_words(draw, n, 10**6) for n in (50, 60, 49))
    short_lines = some_words(draw, 56, 10**6)
    line = lambda *parts: " ".join(w for p in parts for w in p)
    fresh = lambda n: some_words(draw, n, 10**6)
    texts = [
        line(fresh(70), passage, fresh(12)) + "\n" + line(fresh(5), less),
        line(fresh(200), passage, fresh(30)).upper(),
        line(short[:20]) + "\n" + line(short[20:41]) + "\n" + line(short[41:]) + "\n" + line(fresh(30), less),
        line(fresh(3)) + "\n" + line(fresh(9), short, fresh(60)),
        " ".join(["na", "no"] * 100),
        line(fresh(90)),
        "\n" + "\n".join(line(x) for x in np.array_split(short_lines, 4)),
        "\n".join(line(x) for x in np.array_split(short_lines, 4)),
    ]
    got = paragraph_dedup.repeated_paragraphs(docs(spark, texts)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.line, r.start, r.end, r.first_doc_id, r.first_line, r.occurrences, r.removed) for r in got] == [
        (0, 0, 70, 120, 0, 0, 2, False),
        (1, 0, 200, 250, 0, 0, 2, True),
        (2, 0, 0, 60, 2, 0, 2, False),
        (3, 1, 12, 72, 2, 0, 2, True),
        (4, 0, 0, 50, 4, 0, 2, False),  # the first ends where the second begins
        (4, 0, 50, 200, 4, 0, 2, True),
        (6, 1, 0, 28, 6, 1, 2, False),  # short lines in a row are paragraphs
        (6, 3, 28, 56, 6, 3, 2, False),
        (7, 0, 0, 28, 6, 1, 2, True),
        (7, 2, 28, 56, 6, 3, 2, True),
    ]
    assert len({r.cluster for r in got}) == 5


def test_long_lists_lose_no_group(spark):
    nodes = spark.createDataFrame([(k, [1, 100 + k % 3, 1000 + k // 2]) for k in range(60)], "node long, keys array<long>")
    pairs = {tuple(r) for r in candidates.candidate_pairs(nodes, 8).collect()}
    pivot = max(Counter(n for p in pairs for n in p).items(), key=lambda x: x[1])[0]
    assert {(k, k + 1) for k in range(0, 60, 2)} <= pairs and {n for p in pairs if pivot in p for n in p} == set(range(60)) and len(pairs) < 60 * 10


def test_similar_members_of_a_long_list_are_connected(spark):
    draw = np.random.default_rng(13)
    sets = [set(map(int, draw.integers(0, 1 << 40, 50))) | set(range(20)) for _ in range(60)]
    sets[41] = set(list(sets[40])[3:]) | {-1}
    nodes = spark.createDataFrame([(k, [1, 2, 3]) for k in range(60)], "node long, keys array<long>")
    held = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "node long, hashes array<long>")
    assert (40, 41) not in {tuple(r) for r in candidates.candidate_pairs(nodes, 8).collect()}
    edges = candidates.similar_edges(nodes, lambda wanted: held.join(wanted, "node"), candidates.Measure(0.8), 8)
    assert {tuple(r) for r in edges.filter("a <> b").collect()} == {(40, 41)}


# --- SimHash ------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_against_brute_force(spark):
    draw = np.random.default_rng(3)
    base = [some_words(draw, 400) for _ in range(6)]
    texts = [None, "", " \t\n", "One", "one two", "ÉÀ  É x \x0b y", "A B C d"]
    for words in base:
        for _ in range(12):
            near = list(words)
            near[int(draw.integers(0, 400))] = "changed"
            texts.append(" ".join(near))
    texts += [texts[-1].upper(), texts[-1]]
    got = simhash.simhash_components(docs(spark, texts)).collect()
    prints = [plain_fingerprint(t) for t in texts]
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(len(texts), edges)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in range(len(texts))}
    assert simhash.simhash_components(docs(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 4, 32])
def test_index_finds_every_close_pair_whatever_the_list_limit(spark, limit):
    draw = np.random.default_rng(4)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(s) for s in seeds} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for s in seeds:
        for _ in range(6):
            v = int(s)
            for bit in draw.choice(64, int(draw.integers(1, 4)), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    place = {v: k for k, v in enumerate(values)}
    unsigned = lambda x: x % (1 << 64)
    edges = [(place[unsigned(r.a)], place[unsigned(r.b)]) for r in simhash.close_pairs(rows, 2, limit).collect()]
    close = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2]
    assert roots(len(values), edges) == roots(len(values), close)
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in edges)


def test_one_document_of_each_near_copy_group_stays(spark):
    draw = np.random.default_rng(5)
    base = [some_words(draw, int(n)) for n in draw.integers(120, 400, 20)]
    texts, group = [], []
    for g, words in enumerate(base):
        for copy in range(3):
            near = list(words)
            for k in draw.choice(len(near), copy * len(near) // 120, replace=False):
                near[k] = f"new{k}"
            texts.append(" ".join(near) if copy else " ".join(near).upper())
            group.append(g)
    clean = [" ".join(some_words(draw, 200)) for _ in range(30)]
    d = docs(spark, [*texts, *clean, None, "", texts[0]], [*range(len(texts) + 32), 0])
    out = simhash.drop_near_copies(d)
    kept = sorted(r.doc_id for r in out.collect())
    assert out.columns == d.columns
    left = Counter(group[k] for k in kept if k < len(texts))
    assert all(left[g] >= 1 for g in range(20)) and sum(left.values()) <= 22 and kept.count(0) == 1
    assert [k for k in kept if k >= len(texts)] == list(range(len(texts), len(texts) + 31))
    assert simhash.drop_near_copies(d.limit(0)).count() == 0


def test_truncated_extended_and_short_copies_all_go(spark):
    draw = np.random.default_rng(14)
    texts = []
    for _ in range(25):
        for whole, part in ((100, 81), (220, 177), (100, 90)):
            words = some_words(draw, whole, 10**7)
            texts += [" ".join(words), " ".join(words[:part])]
        for n in (14, 20):
            words = some_words(draw, n, 10**7)
            texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs(spark, texts)).collect())
    assert kept == list(range(0, len(texts), 2))


# --- token counts -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_token_counts_equal_the_library(spark, head):
    odd = "".join(map(chr, range(1, 0x250))) + " ".join(map(chr, range(0x1C, 0x21)))
    texts = [None, "", "  two  spaces \n\n x", "it's we'll 'sx ''s", odd, "a<|endoftext|>b <|endoftext|> c<|endoftext|><|endoftext|>", "日本語 текст ١٢٣ 😀 x\u0085y", "x" * 5000, "\t\t\r\n " * 50, "word " * 1100]
    tokenizer = Tokenizer.from_file(BPE)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = sorted(token_counts.count_tokens(docs(spark, texts), BPE, head=head).collect())
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n, n > 1024) for t, n in zip(texts, want, strict=True)]
    assert token_counts.count_tokens(docs(spark, ["x"]).limit(0), BPE).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    texts = ["Hello there", "", "two words\nand more", "Hello there"]
    got = sorted(token_counts.count_tokens(docs(spark, texts), path).collect())
    if name.endswith(".model"):
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t)) for t in texts]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in got] == want


# --- quality ------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_counts_against_plain_python():
    draw = np.random.default_rng(6)
    texts = [None, "", " \n ", "é é |x|\n|x|\n a\na\n a", "a b c a b c", "a a a a", "x y"] + [" ".join(some_words(draw, 60, 4)) for _ in range(30)]
    for t in texts:
        assert textstats.statistics(t.encode() if t is not None else None)[0] == plain_counts(t), t


def labelled_rows(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_ranking_orders_held_out_documents(spark):
    d, labels = labelled_rows(spark)
    got = quality_ranking.classify_quality(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, poor = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > poor[None, :]).mean() > 0.98 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all() and (got.predicted == got.quality).mean() > 0.95


def test_ranking_never_reads_held_out_labels(spark):
    d, labels = labelled_rows(spark)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    spoilt = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(quality_ranking.classify_quality(d, x).collect()) for x in (labels, spoilt))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, 1)]])
def test_models_take_missing_labels(spark, labels):
    d = docs(spark, [None, "", "a few words here", "x"])
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality_ranking.classify_quality(d, rows).count() == 4
    assert {r.kept for r in quality_rules.quality_rules(d, rows).collect()} == {False}
    assert quality_ranking.classify_quality(d.limit(0), rows).count() == 0


def test_rules_keep_good_documents_and_follow_the_base(spark):
    d, labels = labelled_rows(spark)
    got = quality_rules.quality_rules(d, labels).toPandas()
    text = {r.doc_id: r.text for r in d.collect()}
    for r in got.head(200).itertuples():
        want = plain_counts(text[r.doc_id])
        assert {k: getattr(r, k) for k in want} == want
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all() and not (got.kept & got.base_failed).any()
    both = got[~got.base_failed].merge(labels.toPandas(), on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.05


def test_forest_keeps_its_constraints(spark):
    draw = np.random.default_rng(8)
    x = draw.random((3000, len(textstats.FEATURES)))
    f = textstats.FEATURES.index("repeat_share")
    y = (draw.random(3000) < 0.5 + 0.4 * np.sin(12 * x[:, f])).astype(int)
    forest = quality_rules.fit_forest(x, y)
    probe = np.repeat(x[:50], 40, axis=0)
    probe[:, f] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(probe).reshape(50, 40), axis=1) <= 1e-12).all()
    free = quality_rules.fit_forest(x, y, falling=())
    assert (np.diff(free.score(probe).reshape(50, 40), axis=1) > 1e-6).any()


def test_training_sample_is_bounded_and_reproducible(spark):
    d, labels = labelled_rows(spark)
    a = labelled.training_sample(d, labels, limit=100)
    b = labelled.training_sample(d.repartition(3), labels.repartition(5), limit=100)
    assert len(a[1]) == 100 and all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))


# --- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages_hold_against_brute_force(spark):
    import corpus_pipeline as pipeline
    from strandline.llm.common import written

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = written(stage(spark, d, DATA))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == d.columns
        seen.append((d.toPandas(), out.toPandas()))
        d = out
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    quality = set(seen[0][1].doc_id)
    good = labels[labels.quality == 1].doc_id
    assert good.isin(quality).mean() > 0.98 and labels[labels.quality == 0].doc_id.isin(quality).mean() < 0.05
    before, after = seen[1]
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in before.itertuples() for w in [r.text.lower().split()]}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    pairs = {(a, b) for several in held.values() if len(several) < 60 for a in several for b in several if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5]
    kept = set(after.doc_id)
    alone = set(sets) - {i for p in near for i in p}
    assert alone <= kept and sum(a in kept and b in kept for a, b in near) <= 0.05 * len(near)
    before, after = seen[3]
    assert len(before) == len(after) and not after.text.str.contains(r'token = "[0-9a-f]', regex=True).any()
    assert {"doc_id", "taken", "position"} <= set(seen[4][1].columns) and (seen[4][1].taken > 0).all()


def test_the_fit_lays_out_few_pairs_at_a_time():
    import tracemalloc

    draw = np.random.default_rng(5)
    x, y = draw.standard_normal((20_000, 19)), draw.integers(0, 2, 20_000)
    tracemalloc.start()
    try:
        ranking = quality_ranking.fit(x + y[:, None], y)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64 << 20 and ((ranking.score(x + y[:, None]) >= 0.3) == (y == 1)).mean() > 0.9


@pytest.mark.parametrize("limit", [8, 100])
def test_groups_are_the_components_of_the_edges(spark, limit):
    """Limit 8 finds the pair in the exact round alone, 100 among the first candidates."""
    draw = np.random.default_rng(13)
    sets = [set(map(int, draw.integers(0, 1 << 40, 50))) | set(range(20)) for _ in range(60)]
    sets[41] = set(list(sets[40])[3:]) | {-1}
    nodes = spark.createDataFrame([(k, [1, 2, 3]) for k in range(60)], "node long, keys array<long>")
    held = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "node long, hashes array<long>")
    groups = candidates.similar_groups(nodes, lambda wanted: held.join(wanted, "node"), candidates.Measure(0.8), limit)
    assert {tuple(r) for r in groups.select("node", "component").collect()} == {(40, 40), (41, 40)}
