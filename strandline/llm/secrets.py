"""Secret scan with multipart credential linking, in DataFrame functions only.

Some strings are secrets by themselves (assignments, access keys, long hexadecimal runs). Others are only suspicious:
account names, random-looking strings, service addresses. Those are reported when the parts that complete a credential
stand near them in the same document. All spans of a document are put in order, and for each the nearest part of every
class before and after it is found with running maxima and minima: an interval join on distance that makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import written

# Fixed values of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_MIN = 20
HEX = r"[0-9a-f]+"
HEX_MIN = 24

#: Weak candidates: shown only when linked.
ACCOUNT = r"""(?i)\b(?:client|access|account|key|user)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
#: A run of the base64 alphabets, standard or URL-safe, of 32 characters or more of any length, with its padding.
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = r"(?i)\b(?:https?|s?ftp|ssh|jdbc:[a-z0-9]+|amqps?|rediss?|mongodb|postgres(?:ql)?|mysql)://[^\s\x22'<>|]+"

KINDS = ("assign", "access", "hex", "account", "random", "endpoint")
SCOPE = 400
BLOCK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _spans(text: Column, pattern: str, kind: int, least: int = 1, group: int = 0) -> Column:
    """Array of struct(start, kind, end), in code points, of the leftmost matches whose ``group`` is long enough.

    Gaps and matches alternate, so a match starts at the summed lengths before it. Sums are kept per block of matches,
    which bounds the work for a text with very many of them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), matches.alias("matches"), groups.alias("groups"))

    def lengths(p: Column) -> Column:
        gap = F.transform(p["gaps"], lambda x: F.length(x).cast("long"))
        match = F.transform(p["matches"], lambda x: F.length(x).cast("long"))
        step = F.zip_with(F.slice(gap, F.lit(1), F.size(match)), match, lambda a, b: a + b)
        return F.struct(gap.alias("gap"), match.alias("match"), step.alias("step"), F.transform(p["groups"], F.length).alias("group"))

    def blocks(p: Column) -> Column:
        n = F.size(p["match"])
        sums = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda b: _sum(F.slice(p["step"], b * BLOCK + 1, F.lit(BLOCK))))
        return F.struct(p["gap"].alias("gap"), p["match"].alias("match"), p["step"].alias("step"), p["group"].alias("group"), sums.alias("sums"))

    def spans(p: Column) -> Column:
        def one(length: Column, i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = _sum(F.slice(p["sums"], F.lit(1), b)) + _sum(F.slice(p["step"], b * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))) + F.get(p["gap"], i)
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + length).alias("end"), F.get(p["group"], i).alias("n"))

        return F.transform(F.filter(F.transform(p["match"], one), lambda s: s["n"] >= least), lambda s: s.dropFields("n"))

    # A one-element array and transform() bind each step to a variable, so that it is computed once.
    found = F.array(parts)
    for step in (lengths, blocks, spans):
        found = F.transform(found, step)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return F.when(text.rlike(pattern), F.get(found, F.lit(0))).otherwise(none)


def _shown(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, weak for every row: sorted spans that are secrets, and those that need complements."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        _spans(text, ASSIGN, 0, ASSIGN_MIN, 2).alias("assign"),
        _spans(text, rf"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}", 1).alias("access"),
        _spans(text, rf"[0-9a-f]{{{HEX_MIN},}}", 2).alias("hex"),
        _spans(text, ACCOUNT, 3).alias("account"),
        _spans(text, RANDOM, 4).alias("random"),
        _spans(text, ENDPOINT, 5).alias("endpoint"),
    )
    return scanned.select("doc_id", "text_hash", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.array_sort(F.concat("account", "random", "endpoint")).alias("weak"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, text_hash, n_assign, n_access, n_hex, n_linked, base_sha256, spans, found.

    ``found`` is the sorted array of struct(start, kind, end); ``spans`` is the same as kind:start:end text. A weak
    account needs a secret within ``scope`` code points, a random string an account, access key or endpoint that it is
    no part of, an endpoint both an account or access key and a secret. Null and empty texts have no spans. Equal rows each get the
    same result, null ids are no different from others, an empty table gives no rows, further columns are ignored.
    Texts are scanned once; the spans are written, and linked from there.
    """
    scanned = written(scan_spans(docs))
    linked = _link(scanned.filter((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["doc_id", "text_hash"]), scope)
    joined = scanned.join(linked, scanned["doc_id"].eqNullSafe(linked["linked_id"]) & (scanned["text_hash"] == linked["linked_hash"]), "left")
    found = F.array_sort(F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")))
    counted = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return joined.withColumn("found", found).select(
        scanned["doc_id"],
        "text_hash",
        *counted,
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"),
        F.sha2(_shown(F.col("base")), 256).alias("base_sha256"),
        _shown(F.col("found")).alias("spans"),
        "found",
    )


def _link(scanned: DataFrame, scope: int) -> DataFrame:
    """linked_id, linked_hash, linked: the weak spans whose complementary parts stand within ``scope``."""
    parts = scanned.select(F.col("doc_id").alias("linked_id"), F.col("text_hash").alias("linked_hash"), F.explode(F.concat("base", "weak")).alias("s")).select(
        "linked_id", "linked_hash", "s.*", F.when(F.col("s.kind").isin(1, 3), "id").when(F.col("s.kind").isin(0, 2, 4), "secret").otherwise("endpoint").alias("part")
    )
    document = Window.partitionBy("linked_id", "linked_hash")
    order, reverse = document.orderBy("start", "end", "kind"), document.orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))

    def near(part: str) -> Column:
        here = F.col("part") == part
        back = F.max(F.when(here, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
        ahead = F.min(F.when(here, F.col("start"))).over(reverse.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(F.col("start") - back <= scope, F.lit(False)) | F.coalesce(ahead - F.col("end") <= scope, F.lit(False))

    # A random string in the middle of an address is a part of the address.
    inside = F.coalesce(F.max(F.when(F.col("part") == "endpoint", F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
    near_parts = parts.select("*", inside.alias("inside"), *[near(p).alias(f"near_{p}") for p in ("id", "secret", "endpoint")])
    complete = (
        F.when(F.col("kind") == 3, F.col("near_secret"))
        .when(F.col("kind") == 4, (F.col("near_id") | F.col("near_endpoint")) & ~F.col("inside"))
        .when(F.col("kind") == 5, F.col("near_id") & F.col("near_secret"))
    )
    return near_parts.filter(complete).groupBy("linked_id", "linked_hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans become one mark. Texts without spans stay.

    Only the spans of texts that have some meet their texts again.
    """
    carried = {f"carried_{k}": c for k, c in enumerate(docs.columns)}
    text_key, id_key = (next(k for k, c in carried.items() if c == wanted) for wanted in ("text", "doc_id"))
    spans = find_secrets(docs.select("doc_id", "text"), scope).filter(F.size("found") > 0)
    spans = spans.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "found")
    rows = docs.toDF(*carried).withColumn("row_hash", F.xxhash64(F.coalesce(F.col(text_key), F.lit(""))))
    both = rows.join(spans, F.col(id_key).eqNullSafe(F.col("span_id")) & (F.col("row_hash") == F.col("span_hash")), "left")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def cut(done: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= done["at"], F.concat(F.substr(F.col(text_key), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["text"], gap).alias("text"))

    done = F.aggregate("found", empty, cut)
    clean = F.transform(F.array(done), lambda d: F.concat(d["text"], F.substr(F.col(text_key), (d["at"] + 1).cast("int"))))
    text = F.when(F.col("found").isNotNull(), F.get(clean, F.lit(0))).otherwise(F.col(text_key))
    return both.select(*[(text if c == "text" else F.col(k)).alias(c) for k, c in carried.items()])
