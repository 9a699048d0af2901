"""Repair of conversations against a search over all edits, and the query against plain loops."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from palimpsest.llm import conversations

DATA = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows) by uniform-cost search over whole edit strings; ties by the audit."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, made, out = heapq.heappop(queue)
        state = at, made[:1] == "s" and len(made) == 1, made == "", made[-1:]
        if at == len(rows) and LEGAL.fullmatch(made):
            return cost, audit, out
        if (state, at) in done:
            continue
        done.add((state, at))
        ways = []
        for role, name in (("u", "user"), ("a", "assistant")):
            ways.append((3, "I", at, role, ((name, ""),)))
            if at < len(rows) and found[at] not in "bd":
                ways.append((3 + 3 * (found[at] == "t"), "R", at + 1, role, ((name, rows[at][2]),)))
        if at < len(rows):
            ways.append((4, "D", at + 1, "", ()))
            if found[at] not in "bd" and rows[at][1]:
                ways.append((3 * (found[at] == "t"), "K", at + 1, rows[at][1][0], (rows[at][1:],)))
        for more, letter, to, role, new in ways:
            if re.fullmatch(r"s?(ua)*u?", made + role):
                heapq.heappush(queue, (cost + more, audit + letter, to, made + role, out + new))
    raise AssertionError


def expected(rows):
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, out = cheapest(rows, found)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    counts = Counter(found)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
    return [row] * (0 if kind == 0 else 2 if kind == 3 else 1)


def whole(table):
    """What the query gives for rows (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).extend(damage(conv, turn, role, text))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))) if rows else empty for c, rows in by.items()}


def both(summary, repaired):
    hashed = {r.conv_id: r.sha256 for r in conversations.digests(repaired).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashed.get(r.conv_id, none)) for r in summary.collect()}


def test_query_equals_search(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[1:]) for r in conversations.op11_conversation_repair(spark, DATA).collect()}
    assert got == whole(table)


def made(rng, n):
    """Rows of n conversations with every fault; turns in order, so that no two rows tie."""
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randrange(1, 13)):
            turn += rng.choice([1, 1, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "a", None])
            out.append((conv, turn, role, rng.choice(["Yes.", "No!", "cut", " \n", "", None, f"t{turn}?", "end. \t"])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_repair_equals_search(spark, seed, monkeypatch):
    table = made(random.Random(seed), 300) + [(None, None, None, None), (None, 4, "user", "Hm."), (900, None, "user", "a."), (900, 2, "assistant", "b."), (901, None, None, " ")]
    rows = spark.createDataFrame([(*r, 1, "p", 2) for r in table], "conv_id long, turn long, role string, text string, part int, audit string, idx int")
    got = both(*conversations.repair(rows))
    by = {}
    for conv, turn, role, text in table:
        by.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    want = {c: expected(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in by.items()}
    assert got == want
    monkeypatch.setattr(conversations, "ROUNDS", 0)  # no grammar, other partitions: the same
    assert both(*conversations.repair(rows.repartition(7, "text"))) == want


@pytest.fixture
def whole_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_conversation_over_many_partitions(spark, whole_partitions):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"n{i}!", f"m{i}.", f"o{i}"])) for i in range(500)]
    rows += [(8, 0, "user", "a" * 200_000), (8, 1, "assistant", "b" * 200_000 + ".")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    summary, repaired = conversations.repair(frame)
    assert repaired.where("conv_id = 7").select("part").distinct().count() > 1
    got = both(summary, repaired)
    want = {c: expected([r[1:] for r in rows if r[0] == c]) for c in (7, 8)}
    assert got == want


def test_repeated_and_tied_rows(spark):
    rows = [(1, 5, "user", "Same."), (1, 5, "user", "Same."), (1, 5, "assistant", "Other."), (2, 1, "user", "x."), (2, 1, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = both(*conversations.repair(frame)), both(*conversations.repair(frame.orderBy("text").repartition(5)))
    assert a == b and a[2] == expected([r[1:] for r in rows[3:]]) and a[1][2] == 1
    summary, repaired = conversations.repair(frame.limit(0))
    assert summary.count() == 0 and repaired.count() == 0


def test_ranks_follow_the_audits():
    rng, grammar = random.Random(2), conversations.Grammar(["ua", "xx"])
    for _ in range(200):
        symbols = "".join(rng.choices("suaoSUAOx", k=rng.randrange(1, 7)))
        whole = grammar.steps(symbols)[1][-1]
        for i in range(4):
            audits = {j: grammar.audit(symbols, i, j) for j in range(4) if whole.costs[4 * i + j] < conversations._NEVER}
            assert sorted(audits, key=audits.get) == sorted(audits, key=lambda j: whole.ranks[4 * i + j])
