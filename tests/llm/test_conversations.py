"""Prefix tries and structure repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from vitalgrain.llm import prefix_trie, structure_repair
from vitalgrain.llm.queries import oracle_sql

KIND = "conv_id long, turn long, role string, text string"
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def in_order(rows):
    return sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.sha256(y[2].encode()).hexdigest()))


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    own = {c: [y[1:] for y in in_order(v)] for c, v in own.items()}
    sequences = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        sequences[c] = tuple(own.get(lender, [])[:h] + v[h:])
    members, below = {}, {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        kids = below.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids) or 1, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids))
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), *sums[p], digest(p)) for p, m in members.items()), key=str)


def brute_audit(initials, faults):
    """Cheapest and then ASCII-least edits by Dijkstra's search."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(initials) and state in (0, 3):
            return cost, audit
        for c in "ua":
            if c in NEXT[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state][c]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if initials[i] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][initials[i]]))
                for c in "ua":
                    if c in NEXT[state]:
                        heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, NEXT[state][c]))


def brute_repair(rows):
    convs = {}
    for c, t, r, x in rows:
        own = convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        own += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, v in convs.items():
        v, seen, faults = in_order(v), set(), []
        for _, r, x in v:
            s = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not s else "duplicate" if (r, x) in seen else "" if s[-1] in ".!?" else "truncated")
            seen.add((r, x))
        turns = {t for t, _, _ in v if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit = brute_audit([r[:1] for _, r, _ in v], faults)
        said, state, i = [], 0, 0
        for letter in audit:
            given = "uuau"[state]
            r, x = (NAMES[given], "") if letter == "I" else v[i][1:]
            i += letter != "I"
            if letter != "D":
                said.append(f"{r if letter == 'K' else NAMES[given]}:{x}")
                state = NEXT[state][r[:1] if letter == "K" else given]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(seed, n=400):
    rng = random.Random(seed)
    texts = ["Hi.", "Go on!", "", " ", "cut off", "é\nüber?", None, "Hi.", "well \t\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(rng.choice([None, -40, -39, -20, -3, 0, 1, 2, 3, 19, 20, 21, 40, 41, 77]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    for c in range(100, 160):  # fresh conversations of a shared opening
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["same.", "same.", f"own {rng.random()}"])) for t in range(rng.randrange(1, 7))]
    return rows + rows[:20]


@pytest.mark.parametrize(("seed", "heavy"), [(1, 1000), (2, 2), (3, 0)])
def test_trie_matches_brute_force(spark, seed, heavy):
    rows = odd_rows(seed)
    got = prefix_trie.trie(spark.createDataFrame(rows, KIND).repartition(5), heavy=heavy).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_little(spark):
    assert prefix_trie.trie(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).collect() == []
    rows = [(3, 0, "user", "a b"), (None, 0, "user", "a b")]  # crc32("3") % 4 turns of its own go, and there is no 0
    got = prefix_trie.trie(spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS node", "2 AS depth", "3 AS NODES", "4 AS family")).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_a_long_conversation(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(c, t, "user", f"turn {t}") for c in (20, 40) for t in range(2500)]
    got = prefix_trie.trie(spark.createDataFrame(rows, KIND), heavy=1).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_level_order_bits():
    #      0 -> 1, 2; 1 -> 3; 2 -> none; 3 -> 4, 5
    trie = prefix_trie.Louds.build(np.array([0, 0, 1, 3, 3]), np.zeros(5, "S16"), 6)
    assert trie.bits.astype(int).tolist() == [1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0]
    assert trie.parents().tolist() == [0, 0, 1, 3, 3] and trie.degrees().tolist() == [2, 1, 0, 2, 0, 0]
    leaves = (trie.degrees() == 0).astype(int)
    trie.roll_up([0, 1, 3, 4, 6], leaves)
    assert leaves.tolist() == [3, 2, 1, 2, 1, 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repair_matches_brute_force(spark, seed):
    rows = odd_rows(seed)
    got = structure_repair.repair(structure_repair.damaged(spark.createDataFrame(rows, KIND).repartition(5))).collect()
    assert sorted(map(tuple, got), key=str) == brute_repair(rows)


def test_repair_of_little(spark):
    assert structure_repair.repair(structure_repair.damaged(spark.createDataFrame([], KIND))).collect() == []
    rows = [(5, None, None, None), (None, None, "user", "x."), (7, 1, "user", "long " * 50_000 + ".")]
    got = structure_repair.repair(structure_repair.damaged(spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS copy", "2 AS there", "3 AS HEAD", "4 AS digest"))).collect()
    assert sorted(map(tuple, got), key=str) == brute_repair(rows)


def test_repair_without_damage_keeps_good_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Yes?")]
    (got,) = structure_repair.repair(structure_repair.prepared(spark.createDataFrame(rows, KIND))).collect()
    assert (got.cost, got.audit, got.illegal) == (0, "KKK", 0)
    assert got.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hello.\nassistant:Yes?").hexdigest()


def test_signatures_are_solved_once_and_long_ones_too(spark):
    rng = random.Random(5)
    for _ in range(300):
        said = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(9)))
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in said]
        assert structure_repair.solve(said) == brute_audit(list(said.lower()), faults)
    cost, audit = structure_repair.solve("ua" * 20_000 + "x")
    assert cost == 3 and audit == "K" * 40_000 + "D"
    found = spark.createDataFrame([("ua",)] * 50 + [("uu",)] * 50 + [("",)], "signature string")
    assert sorted(map(tuple, structure_repair.solved(found).collect())) == [("", 0, ""), ("ua", 0, "KK"), ("uu", 2, "KR")]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_sql_twins_on_odd_rows(name):
    rows = odd_rows(9)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = brute_trie(rows) if "trie" in name else brute_repair(rows)
    assert sorted(duck.execute(oracle_sql()[name]).fetchall(), key=str) == want
