"""Conversation repair against a search over all edit sequences in order of (cost, audit)."""

import hashlib
import heapq
import random
import zlib

import pytest

from quarry.llm import conversation_repair as repair
from quarry.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, rows_of_spark, rows_of_sql

BLANKS = " \t\n\x0b\x0c\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        turns = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        turns.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def solved(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    numbers = {t[0] for t in turns if t[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            break
        heapq.heappush(heap, (cost + 5, audit + "I", i, AFTER[last]))
        if i == len(turns):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
        if faults[i] in ("", "truncated"):
            extra, initial = 5 * (faults[i] == "truncated"), turns[i][1][:1]
            heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, AFTER[last]))
            if initial == AFTER[last] or initial == "s" and not last:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial))
    lines, last, i = [], "", 0
    for edit in audit:
        if edit != "D":
            role = turns[i][1] if edit == "K" else ROLE[AFTER[last]]
            lines.append(f"{role}:{'' if edit == 'I' else turns[i][2]}")
            last = role[:1]
        i += edit != "I"
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def check(spark, rows, found=None):
    found = repair.digests(repair.repair(repair.damaged(repair.turns_of(spark.createDataFrame(rows, SCHEMA))))) if found is None else found
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == {k: solved(v) for k, v in damaged(rows).items()}
    return got


def test_random_conversations(spark):
    pick = random.Random(5)
    texts = ["Yes.", "No!", "Well", "", " ", None, "So?", "cut off ", "Ends.\n", "odd ", " "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, t if pick.random() > 0.05 else None, pick.choice(roles[: 3 if pick.random() < 0.8 else 7]), pick.choice(texts)) for c in range(300) for t in range(pick.randrange(9))]
    assert any(x[6] for x in check(spark, rows).values())


def test_odd_conversations(spark):
    found = check(spark, [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hello."), (7, None, "user", "A."), (7, None, "user", "A.")] + [(9, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(700)])
    assert None in found


def test_a_conversation_that_loses_all_its_turns(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = check(spark, [(conv, 0, "user", "Gone.")])
    assert found[conv] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_lines_alternate(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye")], SCHEMA)
    got = repair.repair(repair.turns_of(rows)).first()
    assert (got.cost, got.audit, got.repaired) == (3, "KRKD", ["system:Be brief.", "user:Hi.", "assistant:Hello."])


def test_empty_table_and_clashing_columns(spark):
    assert repair.digests(repair.repair(repair.turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "A.", "x", 3)], SCHEMA + ", audit string, copy int")
    assert repair.digests(repair.repair(repair.turns_of(rows))).first().audit == "D"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    names, want = rows_of_sql(connect(folder), ORACLES["op11_conversation_repair"])
    found = QUERIES["op11_conversation_repair"](spark, folder)
    assert sorted(found.columns) == names and rows_of_spark(found) == want
