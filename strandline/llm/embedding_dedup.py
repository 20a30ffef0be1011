"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets random hash bits, the sides of random hyperplanes on which it lies, concatenated to a key.
All vectors are laid in the order of their keys, and each is compared with a bounded window of neighbours. Close vectors
agree in a bit with a probability of 1 - angle / pi, so that they stand side by side in some of several passes; the number
of passes follows from the number of vectors and the recall that is asked for. Candidates are verified by their cosine,
and the verified pairs of all passes are united to components.

Windows and sketches miss some links. An exact check follows: what the passes left in different components is compared,
block by block, so that no link is lost. The cosine is bounded first, from a few coordinates and the length of the rest.

A window sees few of the members of a large group, so the passes find what is connected, not each link. Links are then
counted within components, whole and without pairing a group up: by the triangle inequality all vectors within half of
the angle around a common middle are linked to each other; only those further out are compared, in blocks.
"""

from __future__ import annotations

from math import acos, ceil, log, log1p, log2, pi, sqrt

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import discard, written
from strandline.llm.components import components

LEAST = 0.95
WINDOW = 32
RECALL = 0.995
SEED = 11
KEY_BITS, SKETCH_BITS = 32, 64
#: Passes whose pairs are united before the others, and passes that are laid out at a time.
FIRST_PASSES, PASSES_AT_ONCE = 2, 16
#: Rows of a sorted partition that are compared at a time; rows that a partition should have; rows of a block.
ROWS, PART_ROWS, BLOCK = 1 << 14, 50_000, 512
#: Coordinates that bound the cosine in the exact check; numbers in a block of it, and blocks that a few thousand vectors get.
HEAD, BLOCK_NUMBERS, LEAST_BLOCKS = 16, 1 << 22, 6
#: Vectors whose mean is the middle of a component; any middle gives the same counts.
MIDDLE = 32
SLACK = 1e-7


def passes_for(n: int, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair of the least cosine has met with this probability, if n vectors spread evenly.

    A pair meets where it agrees in the bits that tell a window's vectors from the others.
    """
    met = (1 - acos(least) / pi) ** max(0.0, log2(max(n, 1) / window))
    return FIRST_PASSES + (ceil(log(1 - recall) / log1p(-met)) if met < 1 else 1)


def most_differing(least: float = LEAST) -> int:
    """Differing bits of two sketches that a pair of the least cosine exceeds once in some 10 000 pairs."""
    share = acos(least) / pi
    return ceil(SKETCH_BITS * share + 4 * sqrt(SKETCH_BITS * share * (1 - share)))


def vector_rows(column) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of an Arrow column of lists: (row numbers, vectors, largest absolute values) by length, without rows of no direction."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(size) - size, []
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        rows = values[starts[at][:, None] + np.arange(n)]
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)  # a null is NaN here, and so is a maximum with NaN
        out.append((at[good], rows[good], top[good]))
    return out


def unit_rows(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of an Arrow column of lists: (row numbers, unit vectors) by length, without rows of no direction."""
    scaled = [(at, rows / top[:, None]) for at, rows, top in vector_rows(column)]
    return [(at, rows / np.sqrt((rows * rows).sum(axis=1))[:, None]) for at, rows in scaled]


def _planes(dim: int, numbers: range, bits: int) -> np.ndarray:
    return np.concatenate([np.random.default_rng([SEED, dim, k]).standard_normal((dim, bits)) for k in numbers], axis=1)


def _packed(sides: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 0 and 1 as big-endian integers of ``bits`` bits, one for each ``bits`` columns."""
    packed = np.packbits(sides.reshape(len(sides), -1, bits), axis=2)
    return packed.view(f">i{bits // 8}")[:, :, 0].astype(f"i{bits // 8}")


def digested(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and ``digest`` of every row: equal for equal vectors; null without a direction."""
    rows = vectors.select("vec_id", "embedding")
    schema = T.StructType([*rows.schema, T.StructField("digest", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list = [None] * batch.num_rows
            for at, values, _ in vector_rows(batch.column(1)):
                for k, value in zip(at.tolist(), values + 0.0, strict=True):  # no negative zero
                    out[k] = xxhash.xxh3_128_digest(value.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def hashed(nodes: DataFrame, passes: range) -> DataFrame:
    """One row per node and pass: dim, pass, key, node, label, sketch."""
    schema = "node long, label long, dim int, sketch long, keys array<int>"

    def run(batches):
        import pyarrow as pa

        known: dict[int, tuple] = {}
        for batch in batches:
            for at, unit in unit_rows(batch.column("embedding")):
                dim = unit.shape[1]
                if dim not in known:
                    known[dim] = _planes(dim, passes, KEY_BITS), _planes(dim, range(-1 % (1 << 32), (-1 % (1 << 32)) + 1), SKETCH_BITS)
                keys, sketch = (_packed(unit @ planes > 0, bits) for planes, bits in zip(known[dim], (KEY_BITS, SKETCH_BITS), strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("node", "label")] + [pa.array(np.full(len(at), dim, dtype=np.int32)), pa.array(sketch[:, 0]), lists], ["node", "label", "dim", "sketch", "keys"])

    made = nodes.select("node", "label", "embedding").mapInArrow(run, schema)
    return made.select("dim", F.posexplode("keys").alias("pass", "key"), "node", "label", "sketch")


_ORDER = ["dim", "pass", "key", "node"]
_CARRIED = ["dim", "pass", "key", "node", "label", "sketch"]


def near_in_order(rows: dict[str, np.ndarray], new: int, window: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places at most ``window`` apart, the later at ``new`` or after, that may be close and have different labels.

    Where there are many, those are left out that are the longest side of a triangle of three near places: what is
    connected at any distance of the sketches stays connected without them. Places of one label count as connected at no
    distance. Sketches only estimate the cosine: if one of the other sides is no link, rest_of_links() finds the long one.
    """
    n = len(rows["key"])
    far = np.int32(1 << 20)
    side, found = [None], 0
    for o in range(1, min(window, n - 1) + 1):
        apart = {c: rows[c][o:] ^ rows[c][:-o] for c in ("dim", "pass", "key", "label", "sketch")}
        differ = np.bitwise_count(apart["sketch"].view(np.uint64)).astype(np.int32)
        near = (apart["dim"] == 0) & (apart["pass"] == 0) & (differ <= most)
        length = np.where(near, (differ + np.bitwise_count(apart["key"].view(np.uint32))) * 64 + o, far)
        length[(apart["dim"] == 0) & (apart["pass"] == 0) & (apart["label"] == 0)] = -1
        side.append(length)
        found += int(((length >= 0) & (length < far)).sum())
    keep = [None, *[(x >= 0) & (x < far) for x in side[1:]]]
    if found > n:
        for a in range(1, len(side)):
            for b in range(1, len(side) - a):
                one, two, both = side[a][: n - a - b], side[b][a:], side[a + b]
                all_near = np.maximum(np.maximum(one, two), both) < far
                keep[a + b] &= ~(all_near & (both > one) & (both > two))
                keep[a][: n - a - b] &= ~(all_near & (one > both) & (one >= two))
                keep[b][a:] &= ~(all_near & (two > both) & (two > one))
    left, right = [], []
    for o in range(1, len(side)):
        i = np.flatnonzero(keep[o])
        i = i[i + o >= new]
        left.append(i)
        right.append(i + o)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def _columns(table) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy() for c in _CARRIED}


def candidates(keyed: DataFrame, n_parts: int, window: int, most: int) -> DataFrame:
    """Pairs (a, b) of nodes that stand within a window of each other in some pass and whose sketches are near."""
    schema = "a long, b long, seam long, late int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.select(*_CARRIED).schema)
    sorted_rows = keyed.select(*_CARRIED).repartitionByRange(n_parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches):
        import pyarrow as pa

        kinds = {"a": pa.int64(), "b": pa.int64(), "seam": pa.int64(), "late": pa.int32(), "dim": pa.int32(), "pass": pa.int32(), "key": pa.int32(), "node": pa.int64(), "label": pa.int64(), "sketch": pa.int64()}

        def out(n, **given):
            return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

        head, held, part = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py() if part is None else part
            for k in range(0, batch.num_rows, ROWS):
                rows = _columns(batch.slice(k, ROWS))
                new = 0 if held is None else len(held["key"])
                both = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in _CARRIED}
                i, j = near_in_order(both, new, window, most)
                a, b = both["node"][i], both["node"][j]
                yield out(len(a), a=np.minimum(a, b), b=np.maximum(a, b))
                if head is None or len(head["key"]) < window:
                    head = {c: (both if head is None else {x: np.concatenate([head[x], rows[x]]) for x in _CARRIED})[c][:window] for c in _CARRIED}
                held = {c: both[c][-window:] for c in _CARRIED}
        if part is not None:  # the neighbours on the other side of the partition's ends
            yield out(len(head["key"]), seam=np.full(len(head["key"]), part), late=np.ones(len(head["key"])).astype(np.int32), **head)
            yield out(len(held["key"]), seam=np.full(len(held["key"]), part + 1), late=np.zeros(len(held["key"])).astype(np.int32), **held)

    def across(group):
        import pyarrow as pa

        group = group.sort_by([("late", "ascending"), *((c, "ascending") for c in _ORDER)])
        rows, new = _columns(group), int((group.column("late").to_numpy() == 0).sum())
        i, j = near_in_order(rows, new, window, most)
        crossing = i < new
        a, b = rows["node"][i[crossing]], rows["node"][j[crossing]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    met = written(sorted_rows.mapInArrow(run, schema))
    seams = met.filter("seam IS NOT NULL").groupBy("seam").applyInArrow(across, "a long, b long")
    return met.filter("a IS NOT NULL").select("a", "b").unionByName(seams).filter("a <> b").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes (node, embedding) with a cosine of ``least`` or more."""
    pairs = written(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = written(nodes.select("node", "embedding").join(wanted, "node", "left_semi"))
    both = pairs.join(ends.select(F.col("node").alias("a"), F.col("embedding").alias("of_a")), "a").join(ends.select(F.col("node").alias("b"), F.col("embedding").alias("of_b")), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            left, right = (unit_rows(batch.column(c)) for c in ("of_a", "of_b"))
            for (at, u), (same, v) in zip(left, right, strict=True):
                if np.array_equal(at, same):  # a pair has one length
                    good[at] = np.einsum("ij,ij->i", u, v) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    done = written(both.mapInArrow(run, "a long, b long"))
    discard(pairs, ends)
    return done


def _linked(u: np.ndarray, v: np.ndarray, of_u: np.ndarray, of_v: np.ndarray, least: float) -> np.ndarray:
    """The pairs of components (rows of two) that the unit rows ``u`` and ``v`` link."""
    head = np.argsort(-v.var(axis=0), kind="stable")[:HEAD]
    # By Cauchy and Schwarz the rest of a product is no larger than the product of the lengths.
    low_u, low_v = (np.column_stack([x[:, head], np.sqrt(np.maximum(0.0, (x * x).sum(axis=1) - (x[:, head] ** 2).sum(axis=1)))]).astype(np.float32) for x in (u, v))
    found = [np.zeros((0, 2), dtype=np.int64)]
    for k in range(0, len(u), BLOCK):
        for m in range(0, len(v), 4 * BLOCK):
            rows, columns = slice(k, k + BLOCK), slice(m, m + 4 * BLOCK)
            may = low_u[rows] @ low_v[columns].T >= least - 1e-5
            if np.count_nonzero(may) > may.size // 16:
                may = u[rows] @ v[columns].T >= least - 1e-9
            i, j = np.divmod(np.flatnonzero(may), may.shape[1])
            apart = of_u[k + i] != of_v[m + j]
            i, j = k + i[apart], m + j[apart]
            for c in range(0, len(i), ROWS):
                a, b = i[c : c + ROWS], j[c : c + ROWS]
                good = np.einsum("ij,ij->i", u[a], v[b]) >= least
                found.append(np.unique(np.column_stack([of_u[a[good]], of_v[b[good]]]), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def rest_of_links(nodes: DataFrame, groups: DataFrame | None, least: float) -> DataFrame:
    """Pairs (a, b) of all components that a link connects and ``groups`` (node, component) keep apart; nodes beside them are their own.

    Exact: every two nodes of different components meet in a task, but for those of which neither is outside the largest
    component. Blocks hold some BLOCK_NUMBERS numbers; only names of components leave a task.
    """
    named = nodes.select("node", "embedding")
    named = named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")) if groups is not None else named.withColumn("component", F.col("node"))
    named = written(named)
    sizes = named.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("numbers"))
    top = sizes.agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.sum("numbers").alias("numbers"), F.max(F.struct("n", "component", "numbers"))["numbers"].alias("major")).first()
    if top.top is None:
        return named.select(F.col("node").alias("a"), F.col("node").alias("b"))

    def blocks(n: int, numbers: int) -> int:
        return max(-(-numbers // BLOCK_NUMBERS), min(LEAST_BLOCKS, -(-n // (4 * BLOCK))))

    minors = blocks(top.n - top.top.n, top.numbers - top.major)
    both = minors + blocks(top.top.n, top.major)
    minor = F.col("component") != top.top.component
    dealt = named.withColumn("block", F.when(minor, _bucket(F.col("node"), F.lit(max(1, minors)))).otherwise(minors + _bucket(F.col("node"), F.lit(both - minors))))
    left = dealt.filter(minor).withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(both - 1))))
    right = dealt.withColumnRenamed("block", "y").filter(F.lit(minors > 0)).withColumn("x", F.explode(F.sequence(F.lit(0), F.least(F.col("y"), F.lit(max(0, minors - 1))))))

    def compare(xs, ys):
        import pyarrow as pa

        found = [np.zeros((0, 2), dtype=np.int64)]
        if xs.num_rows and ys.num_rows:
            of_x, of_y = (t.column("component").to_numpy() for t in (xs, ys))
            lists = {v.shape[1]: (to, v) for to, v in unit_rows(ys.column("embedding").combine_chunks())}
            for at, u in unit_rows(xs.column("embedding").combine_chunks()):
                if u.shape[1] in lists:
                    to, v = lists[u.shape[1]]
                    found.append(_linked(u, v, of_x[at], of_y[to], least))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own
    done = written(left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(compare, "a long, b long"))
    discard(named)
    return done


def groups_of(nodes: DataFrame, n: int, least: float, window: int, recall: float) -> DataFrame:
    """(node, component) of all nodes with a link: those of the passes, completed by the exact check.

    After the first passes rows carry the component that they have so far, and only pairs of different ones are looked at.
    """
    passes, edges, groups, done = passes_for(n, least, window, recall), None, None, 0
    while done < passes:
        now = range(done, min(passes, FIRST_PASSES if not done else done + PASSES_AT_ONCE))
        labelled = nodes.withColumn("label", F.col("node"))
        if groups is not None:
            labelled = nodes.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node"))
        pairs = candidates(hashed(labelled, now), max(1, n * len(now) // PART_ROWS), window, most_differing(least))
        more = verified(pairs, nodes, least)
        edges = more if edges is None else edges.unionByName(more)
        groups = written(components(edges))
        done = now.stop
    rest = rest_of_links(nodes, groups, least)
    return groups if rest.isEmpty() else written(components(edges.unionByName(rest)))


def _bucket(of: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(of), n).cast("int")


def link_counts(nodes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """node, links: the rows of other nodes (node, embedding, rows) of the same component with a cosine of ``least`` or more."""
    members = nodes.select("node", "embedding", "rows").join(groups, "node")
    salted = members.groupBy("component", _bucket(F.col("node"), F.lit(MIDDLE)).alias("salt")).agg(F.min_by("embedding", F.xxhash64("node")).alias("some"))
    middles = salted.groupBy("component").agg(F.array_sort(F.collect_list("some")).alias("some"))
    kind = members.schema["embedding"]
    schema = T.StructType([T.StructField(c, t) for c, t in (("node", T.LongType()), ("component", T.LongType()), ("rows", T.LongType()), ("embedding", kind.dataType), ("angle", T.DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            angle, some = np.zeros(batch.num_rows), batch.column("some")
            middle = {}
            for at, unit in unit_rows(batch.column("embedding")):
                for k, u in zip(at.tolist(), unit, strict=True):
                    c = batch.column("component")[k].as_py()
                    if c not in middle:
                        mean = sum(v.mean(axis=0) for _, v in unit_rows(some[k].values))
                        size = np.sqrt(mean @ mean)
                        middle[c] = mean / size if size > 0 else mean
                    angle[k] = 2 * np.arcsin(min(1.0, np.sqrt(((u - middle[c]) ** 2).sum()) / 2))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "component", "rows", "embedding")), pa.array(angle)], schema.names)

    placed = members.join(middles, "component").select("node", "component", "rows", "embedding", "some").mapInArrow(run, schema)
    placed = written(placed.withColumn("inner", F.col("angle") <= acos(least) / 2 - SLACK))
    sums = placed.groupBy("component").agg(F.sum(F.when(F.col("inner"), F.col("rows")).otherwise(0)).alias("inner_rows"), F.count("*").alias("n"), F.count(F.when(~F.col("inner"), 1)).alias("n_outer"))
    sums = written(sums)
    by_middle = placed.filter("inner").join(sums, "component").select("node", (F.col("inner_rows") - F.col("rows")).alias("links"))
    return by_middle.unionByName(_outer_links(placed, sums.filter("n_outer > 0"), least)).groupBy("node").agg(F.sum("links").alias("links"))


def _outer_links(placed: DataFrame, sums: DataFrame, least: float) -> DataFrame:
    """node, links: partial counts of the links that have an outer vector at one end or both, by blocks of a component.

    Small components share blocks. Only counts leave a block.
    """
    few = sums.filter(F.col("n") <= BLOCK).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = placed.join(sums.select("component", "n", "n_outer"), "component")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    bundle = F.when(F.col("n") <= BLOCK, -1 - _bucket(F.col("component"), F.lit(1 + int(few) // BLOCK))).otherwise(F.col("component"))
    named = named.select("node", "component", "rows", "embedding", "inner", bundle.cast("long").alias("bundle"), blocks("n").alias("n"), blocks("n_outer").alias("n_outer"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = named.filter("NOT inner").withColumns({"x": _bucket(F.col("node"), F.col("n_outer"))}).withColumn("y", every("n"))
    right = named.withColumns({"y": _bucket(F.col("node"), F.col("n"))}).withColumn("x", every("n_outer"))

    def compare(xs, ys):
        import pyarrow as pa

        links = [np.zeros(xs.num_rows, dtype=np.int64), np.zeros(ys.num_rows, dtype=np.int64)]
        col = lambda t, c: t.column(c).to_numpy()
        inner, of_x, of_y, node_x, node_y, w_x, w_y = col(ys, "inner"), col(xs, "component"), col(ys, "component"), col(xs, "node"), col(ys, "node"), col(xs, "rows"), col(ys, "rows")
        lists = {u.shape[1]: (at, u) for at, u in unit_rows(ys.column("embedding").combine_chunks())} if ys.num_rows else {}
        for at, u in unit_rows(xs.column("embedding").combine_chunks()) if xs.num_rows else []:
            if u.shape[1] not in lists:
                continue
            to, v = lists[u.shape[1]]
            for k in range(0, len(to), BLOCK):
                some = to[k : k + BLOCK]
                linked = (u @ v[k : k + BLOCK].T >= least) & (of_x[at][:, None] == of_y[some]) & (node_x[at][:, None] != node_y[some])
                links[0][at] += linked @ w_y[some]
                links[1][some] += np.where(inner[some], w_x[at] @ linked, 0)
        return pa.table({"node": np.concatenate([node_x, node_y]), "links": np.concatenate(links)})

    key = ("bundle", "x", "y")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "node long, links long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked to it), component_id (smallest vec_id reachable), kept.

    Rows are linked if the cosine of their embeddings, in double precision, is ``least`` or more. Null and zero vectors and
    those with null or non-finite components link with nothing, nor do vectors of different lengths. Rows with equal
    vectors are one node of the graph and link to each other; repeated ids stay rows of their own. A null id names a
    component only if all its ids are null. An empty table gives no rows; further columns are ignored. No link is lost:
    ``recall`` is that of the passes, whose rest an exact check compares.
    """
    rows = digested(vectors)
    known = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("rows"), F.first("embedding").alias("embedding"))
    nodes = written(known.withColumn("node", F.monotonically_increasing_id()))
    groups = groups_of(nodes, nodes.count(), least, window, recall)
    links = written(link_counts(nodes, groups, least))
    named = nodes.select("node", "digest", "first", "rows").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per_node = named.join(smallest, "component").join(links, "node", "left").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    done = rows.select("vec_id", "digest").join(per_node, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
