"""Repair of conversation structure by depth-first branch and bound.

A well-formed conversation has the role initials ``(s?(ua)+)?``: perhaps a system row, then pairs of user and assistant.
Edits make any sequence well-formed: keep a row (0), rerole it to user or assistant (1), delete it (2; blank and duplicate
rows must go), insert an empty row of either role anywhere (5); a truncated row that stays costs 5 more. Of the cheapest
scripts the one whose edits' initials are least in ASCII order is wanted.

Rows are numbered, judged and joined with their edits by Spark; the search itself needs one letter per row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import parts_of, written

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Grammar states: nothing yet, after the system row, after a user row (an assistant row must follow), after a pair.
START, SYSTEM, OPEN, PAIR = range(4)
_TURN = {START: ("u", OPEN), SYSTEM: ("u", OPEN), OPEN: ("a", PAIR), PAIR: ("u", OPEN)}
ROLES = {"u": "user", "a": "assistant"}
#: The ways in which one row of twenty each is damaged.
DROP, EMPTY, UNSTOP, REPEAT, AS_USER = range(5)


def _keep(symbol: str, state: int) -> int | None:
    """The state after keeping a row of this symbol, or None if it can't be kept."""
    role = symbol.lower()
    if role == "s":
        return SYSTEM if state == START else None
    wanted, after = _TURN[state]
    return after if role == wanted else None


def suffix_bounds(symbols: str) -> list[list[int]]:
    """The least cost from each row and state to a well-formed end, from the last row back. It is reached by some script."""
    bounds = [[0, 2 * INSERT, INSERT, 0]]
    for symbol in reversed(symbols):
        after, now = bounds[-1], []
        extra = TRUNCATED if symbol.isupper() else 0
        for state in range(4):
            least = DELETE + after[state]
            if symbol != "x":
                least = min(least, REROLE + extra + after[_TURN[state][1]])
                kept = _keep(symbol, state)
                if kept is not None:
                    least = min(least, extra + after[kept])
            now.append(least)
        now[OPEN], now[PAIR] = min(now[OPEN], INSERT + now[PAIR]), min(now[PAIR], INSERT + now[OPEN])
        now[START], now[SYSTEM] = min(now[START], INSERT + now[OPEN]), min(now[SYSTEM], INSERT + now[OPEN])
        bounds.append(now)
    return bounds[::-1]


def cheapest_edits(symbols: str) -> tuple[int, str, str]:
    """Cost, audit (initials of the cheapest edits, D I K R, ties ASCII-least) and new roles of a conversation.

    A symbol is a row: ``s``, ``u``, ``a`` or ``o`` by its role's initial, upper case if truncated, ``x`` if it must go.
    The new roles stand beside the audit: ``u`` or ``a`` for inserted and reroled rows, ``-`` for others. They follow
    from the audit, since the grammar leaves one role to each place.

    The stack holds nodes (row, state) with the prefix that leads there. The children of a node are entered by
    (prefix cost + bound, letter), so that the search dives to a cheapest script first. A prefix is given up if its bound
    can't beat the incumbent (cost, audit), or if the node's dominance table has a prefix that is as cheap: with bounds
    that are reached, prefixes of one node that cost the same are met in ASCII order.
    """
    n, bounds = len(symbols), suffix_bounds(symbols)
    best: tuple[int, str, str] | None = None
    dominant: dict[tuple[int, int], int] = {}
    letters, roles = [], []
    stack = [(bounds[0][START], 0, START, 0, 0, "", "")]
    while stack:
        bound, i, state, cost, depth, letter, role = stack.pop()
        del letters[max(0, depth - 1) :], roles[max(0, depth - 1) :]
        letters.append(letter)
        roles.append(role)
        if best is not None and bound >= best[0]:
            continue  # dearer, or as dear and behind the incumbent's audit
        if dominant.get((i, state), bound + 1) <= cost:
            continue
        dominant[i, state] = cost
        if i == n and bounds[n][state] == 0:
            best = (cost, "".join(letters[1:]), "".join(roles[1:]))
            continue
        wanted, after = _TURN[state]
        children = [(cost + INSERT, i, after, "I", wanted)]
        if i < n:
            symbol = symbols[i]
            children.append((cost + DELETE, i + 1, state, "D", "-"))
            if symbol != "x":
                extra = TRUNCATED if symbol.isupper() else 0
                children.append((cost + REROLE + extra, i + 1, after, "R", wanted))
                kept = _keep(symbol, state)
                if kept is not None:
                    children.append((cost + extra, i + 1, kept, "K", "-"))
        ranked = sorted(((c + bounds[k][s], e, k, s, c, r) for c, k, s, e, r in children), reverse=True)
        stack += [(b, k, s, c, len(letters) + 1, e, r) for b, e, k, s, c, r in ranked]
    return best


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row of four damaged, chosen by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it, 4 makes it the user's. A null
    role, text, or part of the key counts as one space.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).filter(F.col("kind") != DROP)
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == UNSTOP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == AS_USER, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == REPEAT, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def judged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every row with its ``place`` in the conversation, ``fault`` and ``symbol``.

    Rows stand by turn, nulls first; rows of one turn by role and text. A null role or text counts as one space. The first
    fault of a row counts: ``blank``, ``duplicate`` (of an earlier row's role and text), ``truncated`` (ends without one of
    ``.!?``); null if there is none. Nothing is gathered: numbers and faults come from sorted windows, which spill.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(in_order) - 1).withColumn("initial", F.substring("role", 1, 1))
    by_place = Window.partitionBy("conv_id").orderBy("place")
    rows = rows.withColumn("pair", F.concat(F.lag("initial").over(by_place), "initial"))
    turn_before = F.lag("turn").over(by_place)
    rows = rows.withColumn("new_turn", F.col("turn").isNotNull() & (turn_before.isNull() | (turn_before != F.col("turn"))))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(said == "", "blank").when(seen, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return rows.withColumn("symbol", symbol).drop("initial")


COUNTS = ("blank", "duplicate", "truncated")


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of judged ``rows``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles.

    A conversation is held by one row of letters, one for each of its rows; texts are left aside. ``gaps`` counts the
    numbers missing among its turns, null ones ignored (all null: 0). ``illegal`` counts neighbours with role initials
    other than su, ua, au.
    """
    count = lambda good: F.sum(F.coalesce(good, F.lit(False)).cast("long"))
    legal = F.col("pair").isin("su", "ua", "au")
    one = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - count(F.col("new_turn")), F.lit(0).cast("long")).alias("gaps"),
        *[count(F.col("fault") == name).alias(name) for name in COUNTS],
        count(~legal).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda r: r["symbol"]), "").alias("symbols"),
    )
    schema = T.StructType([*(f for f in one.schema if f.name != "symbols"), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("roles", T.StringType())])
    kept = [c for c in one.columns if c != "symbols"]

    def run(batches):
        import pyarrow as pa

        for part in parts_of(batches):
            symbols = part.column("symbols").to_pylist()
            found = {s: cheapest_edits(s) for s in set(symbols)}
            cost, audit, roles = zip(*(found[s] for s in symbols), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(cost, pa.int64()), pa.array(audit), pa.array(roles)], schema.names)

    return one.mapInArrow(run, schema)


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def edited(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every edit of each conversation in order: conv_id, step, edit (its initial), and the turn, role and text that result.

    Deleted rows have a null role and text; inserted rows have the text "" and no turn.
    """
    steps = plan.select("conv_id", F.posexplode(F.arrays_zip(F.split("audit", "").alias("edit"), F.split("roles", "").alias("new"))).alias("step", "e"))
    steps = steps.select("conv_id", "step", F.col("e.edit").alias("edit"), F.col("e.new").alias("new")).filter("edit <> ''")
    own = F.sum((F.col("edit") != "I").cast("int")).over(Window.partitionBy("conv_id").orderBy("step")) - 1
    steps = steps.withColumn("at", F.when(F.col("edit") != "I", own))
    those = rows.select(F.col("conv_id").alias("of"), "place", "turn", "role", "text")
    both = steps.join(those, _same(F.col("conv_id"), F.col("of")) & (F.col("at") == F.col("place")), "left")
    named = F.when(F.col("new") == "u", ROLES["u"]).when(F.col("new") == "a", ROLES["a"])
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(named)
    text = F.when(F.col("edit") == "I", "").when(F.col("edit") != "D", F.col("text"))
    return both.select("conv_id", "step", "edit", "turn", role.alias("role"), text.alias("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step, edit, turn, role, text of every row kept, reroled or inserted, in order by step."""
    rows = written(judged(conversations))
    return edited(rows, plans(rows)).filter("edit <> 'D'")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` of its rows (conv_id, step, role, text) joined by newlines.

    Rows are sorted within conversations and run past one at a time; no conversation is held whole.
    """
    kind = repaired.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", kind.dataType), T.StructField("repaired_sha256", T.StringType())])
    lines = repaired.select("conv_id", "step", F.concat_ws(":", "role", "text").cast("binary").alias("line"))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(kind.dataType)
        open_id, digest = None, None
        for part in parts_of(batches):
            ids, out = part.column("conv_id").to_pylist(), []
            for conv_id, line in zip(ids, part.column("line"), strict=True):
                if digest is None or conv_id != open_id:
                    if digest is not None:
                        out.append((open_id, digest.hexdigest()))
                    open_id, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], id_type), pa.array([x[1] for x in out], pa.string())], schema.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_id], id_type), pa.array([digest.hexdigest()])], schema.names)

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "step").drop("step").mapInArrow(run, schema)


def repair_report(conversations: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``all_ids`` may hold further conv_ids, of conversations that lost all their rows: these have zeros, an empty audit and
    the hash of the empty text, as do conversations of which all is deleted. A null conv_id is a conversation of its own.
    Rows of one turn stand by role and text; repeated rows are duplicates. An empty table gives no rows, further columns
    are ignored, ids pass as they are. Texts of any length are read whole.
    """
    rows = written(judged(conversations))
    plan = written(plans(rows))
    done = digests(edited(rows, plan).filter("edit <> 'D'")).withColumnRenamed("conv_id", "of")
    ids = (conversations if all_ids is None else all_ids).select("conv_id").distinct()
    found = plan.drop("roles").withColumnRenamed("conv_id", "planned")
    both = ids.join(found, _same(F.col("conv_id"), F.col("planned")), "left").join(done, _same(F.col("conv_id"), F.col("of")), "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select("conv_id", *[zero(c) for c in ("gaps", *COUNTS, "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
