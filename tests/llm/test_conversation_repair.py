"""Repair of conversations against trying scripts of edits in order of cost."""

import heapq
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import conversation_repair, queries

DATA = "/root/testdata/sf0.01"
BLANK = " \t\n\x0b\x0c\r"


def well_formed(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def could_be(initials):
    """Some well-formed conversation begins so."""
    rest = initials[1:] if initials[:1] == "s" else initials
    return rest == ("ua" * len(rest))[: len(rest)]


def plain_edits(rows):
    """(cost, audit, rows) of ``rows`` (role, text, fault): scripts in order of cost and audit until one ends well."""
    heap, count = [(0, "", 0, ())], 0
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[0][:1] or "-" for r in out)
        if i == len(rows) and well_formed(initials):
            return cost, audit, out
        nexts = [(5, "I", i, (role, "")) for role in ("user", "assistant")] if audit[-4:].count("I") < 3 else []
        if i < len(rows):
            role, text, fault = rows[i]
            nexts.append((2, "D", i + 1, None))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                nexts += [(more, "K", i + 1, (role, text))] + [(1 + more, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        for more, letter, k, row in nexts:
            grown = out if row is None else (*out, row)
            if could_be("".join(r[0][:1] or "-" for r in grown)):
                heapq.heappush(heap, (cost + more, audit + letter, k, grown))
        count += 1
        assert count < 10**6


def plain_report(table):
    """conv_id -> the report's columns, of rows (conv_id, turn, role, text)."""
    out, groups = {}, defaultdict(list)
    for conv_id, turn, role, text in table:
        groups[conv_id]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        groups[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv_id, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, turns = set(), [], {r[0] for r in rows} - {None}
        for _, role, text in rows:
            said = text.strip(BLANK)
            judged.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None))
            seen.add((role, text))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        cost, audit, kept = plain_edits(judged)
        faults = Counter(r[2] for r in judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = sha256("\n".join(f"{role}:{text}" for role, text in kept).encode()).hexdigest()
        out[conv_id] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOx", max_size=7))
def test_search_finds_the_cheapest_script(symbols):
    names = {"s": "system", "u": "user", "a": "assistant", "o": "Other", "x": "user"}
    rows = [(names[c.lower()], f"{k}.", "blank" if c == "x" else "truncated" if c.isupper() else None) for k, c in enumerate(symbols)]
    cost, audit, kept = plain_edits(rows)
    got = conversation_repair.cheapest_edits(symbols)
    assert got[:2] == (cost, audit) and len(got[2]) == len(audit)
    at, out = 0, []
    for letter, role in zip(audit, got[2], strict=True):
        if letter != "D":
            out.append(conversation_repair.ROLES.get(role) or rows[at][0])
        at += letter != "I"
    assert [r[0] for r in kept] == out and conversation_repair.suffix_bounds(symbols)[0][0] == cost


def test_a_long_conversation_is_searched_in_linear_time():
    symbols = "s" + "uaUAoxua" * 5000
    cost, audit, _ = conversation_repair.cheapest_edits(symbols)
    assert cost == conversation_repair.suffix_bounds(symbols)[0][0] and len(audit.replace("I", "")) == len(symbols)


def test_query_matches_plain_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, DATA).collect()}
    want = plain_report(rows)
    assert got == want and any(v[5] for v in want.values())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nulls_ties_repeats_empty_tables_and_clashing_columns(spark, kind):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3, 2**53 + 1) for t, r, x in [(None, "user", "Hi."), (None, None, None), (4, "", "é\x0b"), (4, "assistant", "  \t"), (5, "user", "same."), (5, "user", "same."), (9, "Usher", "x?"), (10, "assistant", "cut " * 9)][: 8 - (c or 0) % 5]]
    table = spark.createDataFrame([(c if c is None or kind == "long" else str(c), *rest) for c, *rest in rows], f"conv_id {kind}, turn long, role string, text string")
    table = table.withColumns({c: F.lit("clash") for c in ("kind", "place", "fault", "symbol", "of", "step", "cost", "at", "new", "copy")})
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_report(conversation_repair.damage(table), table).collect()}
    assert got == plain_report([tuple(r)[:4] for r in table.collect()])
    assert conversation_repair.repair_report(table.limit(0)).count() == 0


def test_repaired_rows_are_well_formed_and_lost_conversations_stay(spark):
    table = spark.createDataFrame([(1, 0, "assistant", "No question."), (1, 1, "user", "One?"), (1, 2, "assistant", "Two."), (2, 0, "system", "Alone.")], "conv_id long, turn long, role string, text string")
    kept = defaultdict(str)
    for r in sorted(conversation_repair.repair(table).collect(), key=lambda r: (r.conv_id, r.step)):
        kept[r.conv_id] += r.role[0]
    assert kept == {1: "ua"}
    report = {r.conv_id: r for r in conversation_repair.repair_report(table.filter("conv_id <> 2"), table).collect()}
    assert tuple(report[2])[1:] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) and (report[1].cost, report[1].audit, report[1].illegal) == (2, "DKK", 0)


def test_megabyte_texts_and_a_conversation_of_many_rows(spark):
    long = "ä b. " * 300_000
    rows = [(7, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(4000)] + [(8, 0, "user", long), (8, 1, "assistant", long)]
    got = {r.conv_id: r for r in conversation_repair.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[7].audit == "K" * 4000 and got[8].audit == "KK"
    assert got[8].repaired_sha256 == sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert got[7].repaired_sha256 == sha256("\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 7).encode()).hexdigest()
