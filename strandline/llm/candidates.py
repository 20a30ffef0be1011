"""Candidate pairs of nodes that share a key, without pairing up long lists, and the similar ones among them.

Members of long lists that the pairs leave in different components meet again by prefix filtering, which is exact: sets
that must share so many elements share one of their first ones in any fixed order, here the rarest first. Sizes, places
and bitmaps bound what two sets can share, so that hardly more than the similar pairs leave the join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, written
from strandline.llm.components import components

LIST_LIMIT = 8
#: Longer lists of the exact round are dealt into blocks of about so many nodes.
BLOCK = 256
#: Words of 64 bits in a node's bitmap.
BITMAP_WORDS = 16


@dataclass(frozen=True)
class Measure:
    """Similarity of two sets of n and m elements that reaches ``least``: Jaccard, or cosine (shared / sqrt(n m))."""

    least: float
    cosine: bool = False

    @property
    def share(self) -> float:
        """The share of a set's elements that any similar set has at least; also the least ratio of their sizes."""
        return self.least**2 if self.cosine else self.least

    def prefix(self, n: Column) -> Column:
        """How many elements to look at: of similar sets, these of one meet these of the other."""
        return (n - F.ceil(n * self.share - 1e-9) + 1).cast("int")

    def needed(self, n: Column, m: Column) -> Column:
        """Shared elements from which sets of these sizes are similar."""
        return (self.least * F.sqrt(n.cast("double") * m) if self.cosine else self.least / (1 + self.least) * (n + m)) - 1e-9


def candidate_pairs(nodes: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of ``nodes`` (node, keys) that share a key; keys of different kinds must differ in value.

    Nodes of a short list are all paired. The members of a longer one are each paired with its pivot, and meet again
    under two neighbouring keys at once, where lists are shorter; what is still long there is paired with a pivot only.
    The number of pairs thus grows with the number of nodes, whatever a list's length.
    """
    return _pairs(nodes, _met(nodes), list_limit)


def _met(nodes: DataFrame) -> DataFrame:
    return written(_met_again(nodes.select("node", F.posexplode("keys").alias("place", "key"))))


def _met_again(postings: DataFrame) -> DataFrame:
    """The postings of keys that occur twice or more, with the length ``n`` of their list."""
    return postings.join(postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")


def _pairs(nodes: DataFrame, met: DataFrame, list_limit: int) -> DataFrame:
    crowded = met.filter(F.col("n") > list_limit)
    both = crowded.select("node", "place").join(nodes, "node")
    both = both.select("node", F.xxhash64(F.get("keys", F.col("place")), F.get("keys", F.pmod(F.col("place") + 1, F.size("keys")))).alias("key"))
    again = written(_met_again(both))
    long = F.col("n") > list_limit
    return _all_pairs(met.filter(~long).select("key", "node").unionByName(again.filter(~long).select("key", "node"))).unionByName(_to_pivot(crowded)).unionByName(_to_pivot(again.filter(long))).distinct()


def _all_pairs(lists: DataFrame) -> DataFrame:
    """The lists are short, so one row holds a whole list."""
    whole = lists.groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("members")).select("members").distinct()
    return whole.select(F.posexplode("members").alias("at", "a"), "members").select("a", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("b"))


def _to_pivot(lists: DataFrame) -> DataFrame:
    """Each list's members paired with one of them: the node whose lists are longest in all, the likely origin of its copies."""
    weights = lists.groupBy("node").agg(F.sum("n").alias("weight"))
    pivots = lists.select("key", "node").join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
    return lists.join(pivots, "key").filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """The ``pairs`` (a, b) whose sets (node, hashes, without repeats) are similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared >= measure.needed(F.size("of_a"), F.size("of_b"))).select("a", "b")


def similar_edges(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], measure: Measure, list_limit: int = LIST_LIMIT, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect every two ``nodes`` (node, keys) that share a key and are similar.

    ``sets_of`` gives the sets (node, hashes), without repeated hashes, of a table of nodes. ``more`` has further pairs
    (a, b) to look at. Members of a list of any length are connected if they are similar, by the edges of one pair or
    of several.
    """
    groups, rest = _found(nodes, sets_of, measure, list_limit, more)
    return groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest)


def similar_groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], measure: Measure, list_limit: int = LIST_LIMIT, more: DataFrame | None = None) -> DataFrame:
    """The components (node, component) of similar_edges(); without edges between the first groups these are the result."""
    groups, rest = _found(nodes, sets_of, measure, list_limit, more)
    if rest.isEmpty():
        return groups
    return components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(rest))


def _found(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], measure: Measure, list_limit: int, more: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(node, component) by the similar candidate pairs, and the further similar pairs (a, b) of long lists' members."""
    met = _met(nodes)
    pairs = _pairs(nodes, met, list_limit)
    pairs = written(pairs.unionByName(more).distinct() if more is not None else pairs)
    sets = written(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    groups = written(components(similar(pairs, sets, measure)))
    rest = written(similar(written(_crowded_pairs(met.filter(F.col("n") > list_limit), groups, sets, measure)), sets, measure))
    discard(met, pairs, sets)
    return groups, rest


def _crowded_pairs(crowded: DataFrame, groups: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """All pairs of members of the ``crowded`` lists (node, key) that may be similar and are in different ``groups``."""
    named = crowded.select("node", "key").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = named.join(_mixed(named, "key"), "key").select("node", "component").distinct()
    tokens = members.join(sets.select("node", "hashes"), "node").select("node", "component", F.size("hashes").alias("size"), F.explode("hashes").alias("token"))
    times = tokens.groupBy("token").agg(F.count("*").alias("times"))
    # A bit for every token: two sets share no more tokens than half of their sizes less the bits in which they differ.
    word, bit = F.pmod(F.shiftrightunsigned("token", 6), F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, cast(token & 63 as int))")
    bits = F.array(*[F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(BITMAP_WORDS)]).alias("bits")
    ranked = tokens.join(times, "token").groupBy("node", "component", "size").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("tokens"), bits)
    ranked = ranked.withColumn("tokens", F.slice("tokens", F.lit(1), measure.prefix(F.col("size"))))
    held = ["node", "component", "size", "bits"]
    postings = ranked.select(*held, F.posexplode("tokens").alias("place", "t")).select(*held, "place", "t.token")
    # One of two nodes in different components is outside the list's largest component: only those look for partners.
    largest = postings.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"))
    mixed = _mixed(postings, "token").select("token")
    postings = written(postings.join(largest.join(mixed, "token"), "token").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    side = lambda name: F.struct(*held, "place").alias(name)
    minor = F.col("component") != F.col("largest")
    left = postings.filter(minor).select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), side("x"))
    right = postings.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), minor.alias("minor"), side("y"))
    x, y = F.col("x"), F.col("y")
    most = F.least(x["size"] - x["place"], y["size"] - y["place"])
    both = left.join(right, ["token", "block"]).filter((x["component"] != y["component"]) & (~F.col("minor") | (x["node"] < y["node"])))
    both = both.filter((x["size"] >= measure.share * y["size"] - 1e-9) & (y["size"] >= measure.share * x["size"] - 1e-9))
    both = both.filter(most >= measure.needed(x["size"], y["size"]))
    differ = sum((F.bit_count(F.get(x["bits"], F.lit(w)).bitwiseXOR(F.get(y["bits"], F.lit(w)))) for w in range(BITMAP_WORDS)), F.lit(0))
    both = both.filter((x["size"] + y["size"] - differ) / 2 >= measure.needed(x["size"], y["size"]))
    return both.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")).distinct()


def _mixed(lists: DataFrame, key: str) -> DataFrame:
    """The lists whose members are in several components."""
    return lists.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select(key)
