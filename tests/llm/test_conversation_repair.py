import hashlib
import heapq
import random
import re
import zlib

import pytest

from linkloom.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, fault long"
WORD, GAPS = re.compile(r"[^\x20\x09-\x0D]"), " \t\n\v\f\r"


def harmed(rows):
    out, ids = [], []
    for conv, turn, role, text, *_ in rows:
        ids.append(conv)
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, set(ids)


def cheapest(rows):
    """Least (cost, edits) by searching whole edit strings, cheapest first; roles are checked by the pattern alone."""
    want = re.compile(r"(s?(ua)+)?\Z")
    prefix = re.compile(r"(s?(ua)*u?)?\Z")
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        if at == len(rows) and want.match(roles):
            return cost, edits
        key = (at, roles[-1:], "s" in roles)
        if (key, edits) in done or len(roles) > 2 * len(rows) + 4:
            continue
        done.add((key, edits))
        nexts = [(cost + 2, edits + "I", at, roles + r) for r in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            nexts.append((cost + 3, edits + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                nexts += [(cost + 2 + more, edits + "R", at + 1, roles + r) for r in "ua"]
                nexts.append((cost + more, edits + "K", at + 1, roles + (initial or "?")))
        for item in nexts:
            if prefix.match(item[3]):
                heapq.heappush(heap, item)


def brute(rows):
    after, ids = harmed(rows)
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            fault = ""
            if not WORD.search(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.rstrip(GAPS)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            faults.append(fault)
        initials = [r[1][:1] for r in own]
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, edits = cheapest(list(zip(initials, faults)))
        lines, at, last = [], 0, ""
        for e in edits:
            role, text = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def conversations():
    rng = random.Random(5)
    texts = ["Oui.", "Non!", "Et  ", "x", "é?", "", " \t\n", "ok. ", "Qui? \n", "a\x0b"]
    rows = []
    for conv in range(120):
        turns = sorted(rng.sample(range(30), rng.randrange(1, 9)))
        for turn in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "sys"])
            rows.append((conv, turn, role, rng.choice(texts), "z", 1))
    for conv in range(200, 230):  # rows that tie on their turn, and rows without one
        for turn in [None, 1, 1, 2, None][: rng.randrange(1, 6)]:
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice([*texts, None]), None, None))
    rows += [(None, 1, "user", "Hi.", "z", 1), (None, 2, "assistant", "Ho.", "z", 1), (None, None, None, None, None, None)]
    rows += [(300, 1, "user", "w" * 100_000 + ".", "z", 1), (300, 2, "assistant", " " * 100_000, "z", 1), (9_007_199_254_740_993, 1, "user", "x.", "z", 1)]
    return rows + rows[:3]


@pytest.mark.parametrize("spill", [(1 << 16, 1 << 22), (1, 1 << 22), (3, 40)])
def test_agrees_with_brute_force(spark, folder_of, conversations, monkeypatch, spill):
    monkeypatch.setattr(C, "SPILL_ROWS", spill[0])
    monkeypatch.setattr(C, "SPILL_CHARS", spill[1])
    out = C.op12_conversation_repair(spark, folder_of("conversations", conversations, SCHEMA))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(conversations)


def test_long_conversation_over_many_batches(spark, monkeypatch):
    """Blocks of a few rows and batches of fewer: the same edits as in one piece, and the rows that they give."""
    rng = random.Random(11)
    rows = [(7, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "Again."])) for t in range(3000)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = C.repaired_conversations(docs).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        monkeypatch.setattr(C, "SPILL_ROWS", 64)
        assert C.repaired_conversations(docs).collect() == whole
        turns = C.repaired(C.prepared(docs)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole[0].audit.count("I") + 3000 == len(whole[0].audit)
    assert "".join(t.edit for t in turns) == whole[0].audit.replace("D", "")
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == whole[0].repaired_sha256
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns)) and [t.place for t in turns] == list(range(len(turns)))


def test_a_conversation_that_loses_all_rows(spark, folder_of):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    out = C.op12_conversation_repair(spark, folder_of("conversations", [(1, turn, "user", "Hi.", "", 0)], SCHEMA, 1)).collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_exchange_of_texts(spark, folder_of, conversations):
    rows = C.damaged(C.prepared(spark.createDataFrame(conversations, SCHEMA)))
    plan = C._streams(rows).sortWithinPartitions(*C.ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_no_rows(spark, folder_of):
    assert C.op12_conversation_repair(spark, folder_of("conversations", [], SCHEMA, 1)).count() == 0
