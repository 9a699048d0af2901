"""Repair of conversations: the cheapest edits that give (system)? (user assistant)+.

Every row becomes a symbol: its role's initial and its first fault.  Symbols of all
conversations are compressed together by Re-Pair: round by round the most frequent pairs
of neighbours become new symbols, so that what many conversations share is one symbol.
Each symbol has one transfer matrix in the (min, +) algebra over the four states of the
pattern (nothing yet, after system, after user, after assistant), with the cost of its
cheapest edits from state to state.  A rule's matrix is the product of its two parts',
worked out bottom-up once and used by every conversation.

Of equally cheap edits the ASCII-least audit counts.  An audit is kept as a rope: the state
between the two parts of a rule.  Insertions are put before the row they precede, so two
audits of the same rows from one state to different states differ at some letter, and
which is less is a rank among the four end states.  Ranks of a product follow from those
of its parts, so no strings are compared; they are written out at the end.

Rows are range-sorted by conversation and turn, so a long conversation lies in several
partitions; its symbols are one string a partition, whose matrices are put together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranged, stored, table

#: Costs of edits.  A kept or re-roled row that is truncated costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rules of the grammar, rounds that make them, and pairs that the driver sees a round.
RULES, ROUNDS, PAIRS = 1024, 12, 256
#: Distinct strings of up to SHORT symbols that a worker remembers the matrix of.
REMEMBERED, SHORT = 1 << 16, 64

_WHITE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEVER = 1 << 40
#: State after a role's initial; what is not here breaks the pattern.
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: First symbol of a rule (private use characters).
_RULE = 0xE000


def _open_role(state: int) -> str:
    """The one of user and assistant that may follow."""
    return "a" if state == _USER else "u"


class Matrix:
    """Costs and ranks from state to state, 16 each, and how the audits are made up."""

    __slots__ = ("costs", "ranks", "via")

    def __init__(self, costs: list[int], ranks: list[int], via: list):
        self.costs, self.ranks, self.via = costs, ranks, via

    @staticmethod
    def of_symbol(symbol: str) -> Matrix:
        """One row: s, u, a or o (another role), capital if truncated, x if it must go; `via` has the audits themselves."""
        best: list[tuple[int, str] | None] = [None] * 16
        more = TRUNCATED if symbol.isupper() else 0
        for i in range(4):
            state = i
            for inserted in range(3):
                ways = [(DELETE, "D", state)]
                if symbol != "x":
                    kept = _NEXT.get((state, symbol.lower()))
                    ways += [(KEEP + more, "K", kept)] if kept is not None else []
                    ways.append((REROLE + more, "R", _NEXT[state, _open_role(state)]))
                for cost, letter, j in ways:
                    way = inserted * INSERT + cost, "I" * inserted + letter
                    at = 4 * i + j
                    best[at] = way if best[at] is None else min(best[at], way)
                state = _NEXT[state, _open_role(state)]
        ranks = [0] * 16
        for i in range(4):
            for r, j in enumerate(sorted((j for j in range(4) if best[4 * i + j]), key=lambda j: best[4 * i + j][1])):
                ranks[4 * i + j] = r
        return Matrix([b[0] if b else _NEVER for b in best], ranks, [b[1] if b else None for b in best])

    def then(self, other: Matrix) -> Matrix:
        """The product; `via` has the states between."""
        costs, ranks, via = [_NEVER] * 16, [0] * 16, [0] * 16
        for i in range(0, 16, 4):
            order = []
            for j in range(4):
                cost, rank, k = min((self.costs[i + k] + other.costs[4 * k + j], self.ranks[i + k], k) for k in range(4))
                if cost < _NEVER:
                    costs[i + j], via[i + j] = cost, k
                    order.append((rank, other.ranks[4 * k + j], j))
            for r, (_, _, j) in enumerate(sorted(order)):
                ranks[i + j] = r
        return Matrix(costs, ranks, via)


def ending(costs: list[int], ranks: list[int]) -> tuple[int, int, str]:
    """(cost, state, insertions after the last row) of the cheapest way from the start to a legal end."""
    ways = [(costs[j] + len(tail) * INSERT, ranks[j], j, tail) for j, tail in ((_START, ""), (_SYSTEM, "II"), (_USER, "I"), (_ASSISTANT, ""))]
    cost, _, j, tail = min(ways)
    return cost, j, tail


class Grammar:
    """Re-Pair rules with their matrices; symbols of rules are single characters."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {s: Matrix.of_symbol(s) for s in "suaoSUAOx"}
        for i, (left, right) in enumerate(rules):
            self.matrices[chr(_RULE + i)] = self.matrices[left].then(self.matrices[right])
        self.audits: dict[tuple[str, int, int], str] = {}
        self.known: dict[str, tuple[str, list[Matrix]]] = {}

    def compressed(self, symbols: str) -> str:
        for i, pair in enumerate(self.rules):
            if pair in symbols:
                symbols = symbols.replace(pair, chr(_RULE + i))
        return symbols

    def steps(self, symbols: str) -> tuple[str, list[Matrix]]:
        """The compressed string and the matrices of its beginnings; the last one is the whole string's."""
        if symbols in self.known:
            return self.known[symbols]
        short = self.compressed(symbols)
        found = [self.matrices[short[0]]]
        for s in short[1:]:
            found.append(found[-1].then(self.matrices[s]))
        if len(symbols) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[symbols] = short, found
        return short, found

    def _letters(self, symbol: str, i: int, j: int) -> str:
        """The audit of one symbol."""
        key = symbol, i, j
        if key not in self.audits:
            via = self.matrices[symbol].via[4 * i + j]
            if symbol >= chr(_RULE):
                left, right = self.rules[ord(symbol) - _RULE]
                via = self._letters(left, i, via) + self._letters(right, via, j)
            if len(via) > 4 * SHORT:
                return via
            self.audits[key] = via
        return self.audits[key]

    def audit(self, symbols: str, i: int, j: int) -> str:
        """The cheapest, then ASCII-least edits from state i to j."""
        short, found = self.steps(symbols)
        out = []
        for at in range(len(short) - 1, 0, -1):
            k = found[at].via[4 * i + j]
            out.append(self._letters(short[at], k, j))
            j = k
        out.append(self._letters(short[0], i, j))
        return "".join(reversed(out))


def edits(symbols: str, audit: str, state: int) -> tuple[list[str], list[str]]:
    """For each row the letters that belong to it and the initials they put there (- where none is put); insertions at the end go to the last row."""
    letters, roles, at = [""] * len(symbols), [""] * len(symbols), 0
    for letter in audit:
        row = min(at, len(symbols) - 1)
        role = "-"
        if letter != "D":
            role = symbols[row].lower() if letter == "K" else _open_role(state)
            state = _NEXT[state, role]
        letters[row] += letter
        roles[row] += role
        at += letter != "I"
    return letters, roles


def _pair_counts(frames):
    """Neighbours in strings, weighted by how often the string comes."""
    import pandas as pd

    for frame in frames:
        counts: dict[str, int] = {}
        for symbols, weight in zip(frame["symbols"], frame["weight"], strict=True):
            for pair in map("".join, zip(symbols, symbols[1:], strict=False)):
                counts[pair] = counts.get(pair, 0) + weight
        yield pd.DataFrame({"pair": list(counts), "n": list(counts.values())}).astype({"pair": object, "n": "int64"})


def learn(strings: DataFrame) -> list[str]:
    """Re-Pair over a column `symbols`: the pairs that became symbols, in order.

    A round takes the most frequent pairs that have no symbol in common; a limit on rounds
    or rules leaves strings longer, with the same results.  The driver sees PAIRS pairs a
    round, out of at most the square of the number of symbols.
    """
    rules: list[str] = []
    seqs = stored(strings.groupBy("symbols").agg(F.count(F.lit(1)).alias("weight")), "symbols")
    for _ in range(ROUNDS):
        counts = seqs.where(F.length("symbols") > 1).mapInPandas(_pair_counts, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        used: set[str] = set()
        fresh = []
        for r in top:
            if used.isdisjoint(r["pair"]) and len(rules) + len(fresh) < RULES:
                used.update(r["pair"])
                fresh.append(r["pair"])
        if not fresh:
            break
        symbols: Column = F.col("symbols")
        for i, pair in enumerate(fresh, len(rules)):
            symbols = F.replace(symbols, F.lit(pair), F.lit(chr(_RULE + i)))
        rules += fresh
        seqs = stored(seqs.select(symbols.alias("symbols"), "weight"), "symbols")
    return rules


def _matrices(rules: list[str]):
    def run(batches):
        grammar = Grammar(rules)
        kind = pa.list_(pa.int64())
        for batch in batches:
            whole = [grammar.steps(s)[1][-1] for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.costs for m in whole], kind), pa.array([m.ranks for m in whole], kind)], [*batch.schema.names, "costs", "ranks"])

    return run


def _joined_parts(batches):
    """The states of each part of a conversation, its cost, and what counts across parts."""
    names = ["part", "at", "i", "j", "tail", "cost", "gaps", "illegal"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            found = []
            for p in parts:
                m = Matrix(p["costs"], p["ranks"], [])
                found.append(found[-1].then(m) if found else m)
            cost, j, tail = ending(found[-1].costs[:4], found[-1].ranks[:4])
            states = [j]
            for m in reversed(found[1:]):
                states.append(m.via[states[-1]])
            states.append(_START)
            states.reverse()
            timed = [p for p in parts if p["turns"]]
            turns = sum(p["turns"] for p in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
            illegal = sum(p["illegal"] for p in parts) + sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
            for n, p in enumerate(parts):
                out.append((p["part"], p["at"], states[n], states[n + 1], tail if n + 1 == len(parts) else "", cost, gaps, illegal))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(len(names))], names)


def _written_out(rules: list[str]):
    def run(batches):
        grammar = Grammar(rules)
        for batch in batches:
            got = {n: batch.column(n).to_pylist() for n in ("symbols", "i", "j", "tail")}
            audits, letters, roles = [], [], []
            for symbols, i, j, tail in zip(*got.values(), strict=True):
                audits.append(grammar.audit(symbols, i, j) + tail)
                one, other = edits(symbols, audits[-1], i)
                letters.append(one)
                roles.append(other)
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in got]
            made = [pa.array(audits, pa.string()), pa.array(letters, pa.list_(pa.string())), pa.array(roles, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + made, [n for n, _ in rest] + ["audit", "letters", "roles"])

    return run


def _count(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation, the repaired rows) of a table with conv_id, turn, role and text.

    The first has conv_id, gaps (turns missing between the least and the greatest), blank,
    duplicate, truncated and illegal (faults), cost and audit (K, R, D and I in order); the
    second conv_id, part, idx and n (the order), role and text.

    Rows are in order of turn, nulls first; rows of one turn are ordered by a hash of role
    and text.  A null role or text is one space; rows without conv_id are one conversation;
    a role counts by its first character, and one without any can't be kept.  Repeated
    rows are duplicates.  Other columns are left out, whatever their names; an empty table
    gives none.  A long conversation lies in many partitions; its audit is one value.  All
    copies of one row (equal in all four columns) are sorted in one task.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows, _ = ranged(rows.withColumn("tie", F.xxhash64("role", "text")), ["conv_id", "turn", "tie"], "conversations")
    content = F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)
    last = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    seen = rows.select("conv_id", content.alias("content"), F.struct("part", "idx").alias("place")).groupBy("conv_id", "content").agg(F.min("place").alias("place"))
    seen = seen.select("place.part", "place.idx", F.lit(True).alias("first"))
    marks = rows.select("conv_id", "part", "idx", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"), last.alias("last")).join(seen, ["part", "idx"], "left")
    fault = F.when(F.col("last") == "", "b").when(F.col("first").isNull(), "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-")
    marks = marks.select("conv_id", "part", F.struct("idx", "turn", "role", fault.alias("fault")).alias("row"))
    # at most the rows of one partition each
    units = marks.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    text = lambda f: F.array_join(F.transform("rows", f), "")
    symbol = lambda r: F.when(r["fault"].isin("b", "d"), "x").when(r["fault"] == "t", F.upper(r["role"])).otherwise(r["role"])
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    units = units.select("conv_id", "part", F.col("rows")[0]["idx"].alias("at"), text(symbol).alias("symbols"), text(lambda r: r["role"]).alias("initials"), text(lambda r: r["fault"]).alias("faults"), turns.alias("turns"))
    pairs = sum((_count(F.col("initials"), p) for p in ("su", "ua", "au")), F.lit(0))
    units = stored(
        units.select(
            *("conv_id", "part", "at", "symbols"),
            *(_count(F.col("faults"), c).alias(n) for n, c in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))),
            (F.length("initials") - 1 - pairs).cast("long").alias("illegal"),
            F.substring("initials", 1, 1).alias("first_role"),
            F.right("initials", F.lit(1)).alias("last_role"),
            F.array_min("turns").cast("long").alias("first_turn"),
            F.array_max("turns").cast("long").alias("last_turn"),
            F.size(F.array_distinct("turns")).cast("long").alias("turns"),
        ),
        "conversation-parts",
    )
    rules = learn(units.select("symbols"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    slim = units.select("conv_id", "part", "at", "symbols", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns")
    with_matrix = slim.mapInArrow(_matrices(rules), f"conv_id {kind}, part long, at long, symbols string, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long, costs array<long>, ranks array<long>")
    # a row for each partition that the conversation lies in
    parts = F.struct(*("part", "at", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns", "costs", "ranks"))
    states = with_matrix.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("parts")).select("parts")
    states = states.mapInArrow(_joined_parts, "part long, at long, i int, j int, tail string, cost long, gaps long, illegal long")
    known = units.select("conv_id", "part", "at", "symbols", "blank", "duplicate", "truncated").join(states, ["part", "at"])
    schema = f"conv_id {kind}, part long, at long, blank long, duplicate long, truncated long, cost long, gaps long, illegal long, audit string, letters array<string>, roles array<string>"
    done = stored(known.select("conv_id", "part", "at", "blank", "duplicate", "truncated", "cost", "gaps", "illegal", "symbols", "i", "j", "tail").mapInArrow(_written_out(rules), schema), "conversation-edits")
    audits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda a: a["audit"]), "")
    summary = done.groupBy("conv_id").agg(F.max("gaps").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), audits.alias("audit"))
    changes = done.select("part", "at", F.posexplode(F.arrays_zip("letters", "roles"))).select("part", (F.col("at") + F.col("pos")).alias("idx"), "col.letters", "col.roles")
    changed = rows.select("conv_id", "part", "idx", "role", "text").join(changes, ["part", "idx"])
    each = F.posexplode(F.transform(F.split("letters", ""), lambda c, n: F.struct(c.alias("letter"), F.substring(F.col("roles"), n + 1, F.lit(1)).alias("to"))))
    changed = changed.select("conv_id", "part", "idx", "role", "text", each.alias("n", "edit")).where("edit.letter <> 'D'")
    name = F.when(F.col("edit.to") == "u", "user").otherwise("assistant")
    repaired = changed.select("conv_id", "part", "idx", "n", F.when(F.col("edit.letter") == "K", F.col("role")).otherwise(name).alias("role"), F.when(F.col("edit.letter") == "I", "").otherwise(F.col("text")).alias("text"))
    return summary, repaired


def _digests(batches):
    """SHA-256 of the lines of each conversation, which come in order, one conversation after the other."""
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256(line)
            else:
                digest.update(b"\n")
                digest.update(line)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field("conv_id").type), pa.array([r[1] for r in out], pa.string())], ["conv_id", "sha256"])
        kind = batch.schema.field("conv_id").type
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its rows `role:text`, joined by line ends.

    A conversation's hash takes its rows one after the other, so one task reads it, as a
    stream; it holds a batch of rows at a time.
    """
    lines = repaired.select("conv_id", "part", "idx", "n", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx", "n").mapInArrow(_digests, f"conv_id {kind}, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with stated faults, by a checksum of conv_id and turn: dropped, emptied, without sentence ends, twice, or by user."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(s("text"), "[.!?]", "")).otherwise(s("text"))
    role = F.when(kind == 4, "user").otherwise(s("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the stated damage: their faults, the cheapest repair and the digest of the repaired text."""
    conversations = table(spark, sf_dir, "conversations")
    summary, repaired = repair(damaged(conversations))
    ids, hashed = conversations.select("conv_id").distinct(), digests(repaired)
    out = ids.join(summary, ids["conv_id"].eqNullSafe(summary["conv_id"]), "left").drop(summary["conv_id"])
    out = out.join(hashed, out["conv_id"].eqNullSafe(hashed["conv_id"]), "left").drop(hashed["conv_id"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
