import hashlib
import heapq
import random
import re
import zlib

import pytest

from loreforge.llm import queries, repair
from loreforge.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """The contract in plain Python: what is left of (conv, turn, role, text) rows."""
    out, s = [], lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def search(rows, faults):
    """Cheapest first, then the least audit, over all edits: by trying (no automaton). rows: (role, text)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        state = (at, roles[:1] if len(roles) < 2 else roles[-1], len(roles) > 0)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, roles + role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles, out))
            if faults[at] not in ("b", "d"):
                more = faults[at] == "t"
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + new[0], (*out, (new, text))))
    raise AssertionError


def by_hand(rows):
    """The report of damaged rows, without those of no row."""
    out, of = {}, {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    for conv, own in of.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            stripped = text.strip(BLANKS)
            faults.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for _, t, _, _ in own if t is not None]
        first = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "x" for r in own]
        cost, audit, fixed = search([r[2:] for r in own], faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in fixed)))
    return out


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, path, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: (0,) * 6 + ("", sha("")) for r in rows} | by_hand(damaged(rows))
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, path).collect()}
    assert got == want


def random_rows(seed, n=120, most=7):
    rng, rows = random.Random(seed), []
    roles, texts = ["system", "user", "assistant", "tool", "", None, "user", "assistant"], ["Yes.", "No", "Why?", "", " \t", None, "ok!\n", "é. "]
    for conv in range(n):
        rows += [(conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(most))]
    return rows


@pytest.mark.parametrize("piece", [1, 12, 1 << 18])
def test_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = [*random_rows(piece), (None, 1, "assistant", "a."), (None, 0, "user", "u."), (900, 0, "user", "long " * 100_000 + "."), (900, 1, "assistant", "x" * 300_000), (901, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as piece", "'k' as letters", "'l' as fault", "true as LAST")
    found = repair.Repair(df)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = by_hand(plain)
    got = {r[0]: tuple(r)[1:] for r in found.report().collect()}
    assert got == want
    turns = {}
    for r in sorted(found.turns().collect(), key=lambda r: (r["conv_id"] or -1, r["place"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: sha("\n".join(v)) for c, v in turns.items()} == {c: w[-1] for c, w in want.items() if w[-1] != sha("")}
    assert repair.Repair(df.limit(0)).report().count() == 0


def test_damage(spark):
    rows = random_rows(5) + [(None, t, "system", "a.b!c?") for t in range(50)]
    got = [tuple(r) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, damaged(rows)))


def test_nodes_are_shared():
    rng = random.Random(6)
    signs = sorted({"".join(rng.choice("suaxSUAXD") for _ in range(rng.randrange(1, 7))) for _ in range(3000)}, key=lambda s: s[::-1])
    own = repair.Automaton()
    for s in signs:
        own.turn_to(s[::-1])
        cost, audit = own.audit()
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "") for c in s]
        want = search(rows, ["b" if c == "D" else "t" if c.isupper() else "" for c in s])
        assert (cost, audit) == want[:2], s
        assert [(r.decode(), t.decode()) for _, r, t, _ in repair.edited(audit, [(r.encode(), t.encode()) for r, t in rows]) if r is not None] == list(want[2])
    assert own.built == len({s[k:] for s in signs for k in range(len(s))})  # one node for each distinct rest
