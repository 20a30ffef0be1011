"""Near-duplicate vectors against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import embedding_dedup, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(ids, vectors, least=0.95):
    """Rows (vec_id, n_links, component_id, kept); all vectors have a direction and one length, ids differ."""
    unit = np.array(vectors, dtype=np.float32).astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    names = np.array(ids)
    while True:
        lower = np.minimum(names, np.where(linked, names[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == names).all():
            break
        names = lower
    return {i: (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, linked.sum(axis=1), names, strict=True)}


def around(draw, middle, cosine, n):
    """n unit vectors at this cosine to the middle."""
    middle = middle / np.linalg.norm(middle)
    noise = draw.standard_normal((n, len(middle)))
    noise -= (noise @ middle)[:, None] * middle
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * middle + np.sqrt(1 - cosine**2) * noise


def report(spark, ids, vectors, **options):
    table = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, **options).collect()}


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op11_embeddings(spark, DATA).collect()}
    assert got == plain([r.vec_id for r in rows], [r.embedding for r in rows])


def test_groups_of_any_shape_have_all_their_links(spark):
    draw = np.random.default_rng(4)
    tight = around(draw, draw.standard_normal(64), 0.994, 900)  # all linked to each other
    loose = around(draw, draw.standard_normal(64), 0.9747, 400)  # cosines about 0.95: some linked, some not
    two = around(draw, tight[0], 0.96, 40)  # beside the tight group
    pairs = draw.standard_normal((60, 64))
    close = np.concatenate([around(draw, p, c, 1) for p, c in zip(pairs, np.linspace(0.93, 0.97, 60), strict=True)])
    vectors = np.concatenate([tight, loose, two, pairs, close, draw.standard_normal((600, 64))])
    ids = [int(k) for k in draw.permutation(len(vectors)) * 3 + 1]
    got, want = report(spark, ids, vectors), plain(ids, vectors)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(got[i][0] for i in ids) >= 0.995 * sum(want[i][0] for i in ids)
    assert np.mean([got[i] == want[i] for i in ids]) > 0.99


def test_passes_follow_from_size_and_recall():
    sizes = [0, 1, 32, 10**4, 10**6, 10**9]
    passes = [embedding_dedup.passes_for(n) for n in sizes]
    assert passes == sorted(passes) and passes[-1] < 120
    assert embedding_dedup.passes_for(10**6, recall=0.9) < embedding_dedup.passes_for(10**6, recall=0.999)


def test_dropped_candidates_leave_the_same_connected():
    draw = np.random.default_rng(7)
    n = 300
    rows = {"dim": np.full(n, 8, np.int32), "pass": np.zeros(n, np.int32), "key": np.sort(draw.integers(0, 9, n)).astype(np.int32), "node": np.arange(n), "label": np.arange(n) // 3 * (draw.random(n) < 0.3), "sketch": draw.integers(0, 64, n)}
    rows["label"] = np.where(rows["label"] == 0, np.arange(n) + 1000, rows["label"])
    i, j = embedding_dedup.near_in_order(rows, 0, 12, 3)

    def groups(pairs):
        top = list(range(n))

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[find(a)] = find(b)
        return [find(x) for x in range(n)]

    same = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 13)) if rows["label"][a] == rows["label"][b]]
    near = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 13)) if int(rows["sketch"][a] ^ rows["sketch"][b]).bit_count() <= 3]
    full, kept = groups(same + near), groups(same + list(zip(i.tolist(), j.tolist(), strict=True)))
    assert len(i) < len(near) / 2 and len(set(zip(full, kept, strict=True))) == len(set(full)) == len(set(kept))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nulls_ties_repeats_empty_tables_and_clashing_columns(spark, kind):
    one, other = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, one), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, one), (8, one), (9, [2.0, 4.0, 6.0]), (None, other), (None, other), (2**53 + 1, [1.0, 2.0, 3.0, 0.0]), (2**53 + 2, [1.0, 2.0, 3.0, -0.0]), (10, [-1.0, -2.0, -3.0])]
    table = spark.createDataFrame([(None if i is None else i if kind == "long" else f"{i:020d}", v) for i, v in rows], f"vec_id {kind}, embedding array<double>")
    table = table.withColumns({c: F.lit("clash") for c in ("digest", "node", "label", "rows", "component", "links", "first", "some", "x", "n")})
    name = lambda i: i if kind == "long" or i is None else f"{i:020d}"
    group, wide = name(1), name(2**53 + 1)
    want = [(name(i), *((3, group, i == 1) if i in (1, 8, 9) else (1, None, True) if i is None else (1, wide, i == 2**53 + 1) if i > 2**53 else (0, name(i), True))) for i, _ in rows]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_long_vectors(spark):
    draw = np.random.default_rng(2)
    long = draw.standard_normal((3, 5000))
    got = report(spark, [1, 2, 3, 4], [long[0], long[1], long[0] + 0.01 * long[2], long[2]])
    assert got == {1: (1, 1, True), 2: (0, 2, True), 3: (1, 1, False), 4: (0, 4, True)}


@pytest.mark.parametrize("window, recall", [(32, 0.995), (2, 0.3)])
def test_no_link_is_lost_by_windows_and_sketches(spark, window, recall):
    draw = np.random.default_rng(21)
    chains = [around(draw, draw.standard_normal(64), c, n) for c, n in ((0.9747, 500), (0.968, 300), (0.97, 200))]  # cosines on both sides of 0.95
    pairs = draw.standard_normal((300, 64))
    vectors = np.concatenate([*chains, pairs, *(around(draw, p, c, 1) for p, c in zip(pairs, np.linspace(0.945, 0.96, 300), strict=True)), draw.standard_normal((200, 64))])
    ids = [int(k) for k in draw.permutation(len(vectors))]
    assert report(spark, ids, vectors, window=window, recall=recall) == plain(ids, vectors)


def test_the_exact_check_alone_finds_all_links(spark):
    draw = np.random.default_rng(22)
    for dim in (3, 64):
        vectors = np.concatenate([around(draw, draw.standard_normal(dim), c, 60) for c in (0.97, 0.99)] + [draw.standard_normal((100, dim))])
        nodes = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "node long, embedding array<double>")
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        want = {(a, b) for a, b in np.argwhere(unit @ unit.T >= 0.95).tolist() if a < b}
        assert {(min(r), max(r)) for r in embedding_dedup.rest_of_links(nodes, None, 0.95).collect()} == want
        half = spark.createDataFrame([(k, k % 2) for k in range(150)], "node long, component long")
        of = lambda k: k % 2 if k < 150 else k
        got = {(min(r), max(r)) for r in embedding_dedup.rest_of_links(nodes, half, 0.95).collect()}
        assert got == {(min(of(a), of(b)), max(of(a), of(b))) for a, b in want if of(a) != of(b)}
