"""Conversation repair against a plain search over whole edit sequences."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelforge.llm import repair

VISIBLE = re.compile("[^\x20\x09-\x0d]")
SCHEMA = "conv_id long, turn long, role string, text string, codes string, kind string"


def search(rows):
    """Least (cost, letters, lines) of edits of (role, text, must go, truncated) rows, by Dijkstra over whole prefixes."""
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    fits = {"": "u", "s": "u", "a": "u", "u": "a"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if done.setdefault((i, state), (cost, letters)) != (cost, letters):
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, letters, lines
        to = fits[state]
        heapq.heappush(heap, (cost + 3, letters + "I", i, to, (*lines, names[to] + ":")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, lines))
            if not gone:
                if (state, role[:1]) in keep:
                    heapq.heappush(heap, (cost + 3 * cut, letters + "K", i + 1, keep[state, role[:1]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", i + 1, to, (*lines, f"{names[to]}:{text}")))


def brute(table):
    text_of = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        by[conv]
        draw = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        by[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = set()
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, marked, count = set(), [], Counter()
        for _, role, text in rows:
            shown = VISIBLE.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, letters, lines = search(marked)
        out.add((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def invented(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "   ", None, "Why? ", "so it goes\n", "Fine."]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, turns)):
            out.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"Text {t}."]), "x", "y"))
    return out + [(None, 1, "user", "Hi.", None, None), (None, 2, "assistant", "Hello.", None, None), (None, None, None, None, None, None), *[(99, 1, "user", "Same.", "x", "y")] * 4]


@pytest.mark.parametrize("most", [2, 3, repair.PIECE])
def test_rows_against_search(spark, most):
    table = invented(4, 30, 12)
    got = repair.repair_damaged(spark.createDataFrame(table, SCHEMA), most)
    assert {tuple(r) for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()} == brute(table)


def test_one_conversation_with_most_rows_is_cut(spark):
    """1200 turns of one conversation, in pieces of 64; the search over prefixes has the same cost and letters."""
    rng = random.Random(9)
    table = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"Text {t}{rng.choice(['.', ' '])}", "x", "y") for t in range(1200)] + [(8, 0, "user", "Hm.", "x", "y")]
    docs = spark.createDataFrame(table, SCHEMA)
    got = repair.repair_damaged(docs, 64)
    assert {tuple(r) for r in got.collect()} == brute(table)


def test_texts_of_every_size_and_empty_tables(spark):
    long = "x " * 300_000
    table = [(1, 0, "user", long + "?", "x", "y"), (1, 1, "assistant", long + ".", "x", "y"), (2, 0, "user", " " * 300_000, "x", "y"), (3, 5, None, "", "x", "y")]
    assert {tuple(r) for r in repair.repair_damaged(spark.createDataFrame(table, SCHEMA)).collect()} == brute(table)
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_layers_take_no_longer_for_bad_conversations():
    codes = bytes(random.Random(1).choice([0, 1, 2, 3, 6, 7]) for _ in range(4000))
    cost, letters = repair.repair(codes, np.zeros(4001, np.int64))
    worth = {"D": 4, "I": 3}
    at, total = 0, 0
    for x in letters:
        total += worth.get(x, 3 * (x == "R") + (3 if x in "KR" and codes[at] & 4 else 0))
        at += x != "I"
    assert total == cost and at == 4000
