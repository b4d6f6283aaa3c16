"""Conversation structure repair by a run-length dynamic program.

Each row of a conversation is a symbol: the initial of its role and its fault.  A
conversation's role initials shall read ``(s?(ua)+)?``; a four-state automaton
tells what may follow.  The cheapest cost from row i and state q on satisfies a
min-plus recurrence, so a row is a 4 x 4 min-plus matrix.  Equal consecutive
symbols are one run; a run of length r is advanced through cached binary powers of
its symbol's matrix, in log r products.  The choices are then unrolled forward,
taking the ASCII-least letter among the cheapest ones.

Rows lie range-partitioned by (conversation, turn, role, text), so a conversation
of any size spreads over tasks.  One that lies within a partition is solved there.
The first and the last of a partition may go on in others; their pieces are
composed: a matrix for each piece, then costs from the end, then states from the
front, and at last each piece unrolls on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

PART_BYTES = 16 << 20  # text of one range partition, about
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3  # costs
FAR = 1 << 60

# States: nothing yet, after s, after u, after a.  NEXT is where an added or rewritten row leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ADDED = ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)  # cost of the rows that still have to come
FOLLOWS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)

Symbol = tuple[str, int]  # initial ('s', 'u', 'a' or ''), fault: BLANK and DUPLICATE are one symbol
Costs = tuple[int, int, int, int]


# --------------------------------------------------------------------------
# min-plus matrices of symbols and runs
# --------------------------------------------------------------------------
def symbol(initial: str, fault: int) -> Symbol:
    if fault in (BLANK, DUPLICATE):
        return "", BLANK
    return initial if initial in ("s", "u", "a") else "", fault


@lru_cache(maxsize=64)
def choices(sym: Symbol) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each state the (letter, cost, next state) of edits that use up the row, in ASCII order."""
    initial, fault = sym
    extra = UNFINISHED if fault == TRUNCATED else 0
    out = []
    for q in range(4):
        own = [("D", DELETE, q)]
        if fault != BLANK:
            to = FOLLOWS.get((initial, q))
            if to is not None:
                own.append(("K", KEEP + extra, to))
            own.append(("R", REROLE + extra, NEXT[q]))
        out.append(tuple(own))
    return tuple(out)


def product(a, b):
    """Min-plus product of 4 x 4 matrices."""
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)) for row in a)


def apply(m, costs: Costs) -> Costs:
    return tuple(min(FAR, *(x + c for x, c in zip(row, costs, strict=True))) for row in m)


UNIT = tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4))


@lru_cache(maxsize=4096)
def power(sym: Symbol, k: int):
    """Matrix of 2^k rows of one symbol, with rows inserted before them where that is cheapest."""
    if k:
        return product(power(sym, k - 1), power(sym, k - 1))
    m = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        at, paid = q, 0
        for _ in range(4):  # more insertions only come back to the same states
            for _, cost, to in choices(sym)[at]:
                m[q][to] = min(m[q][to], paid + cost)
            at, paid = NEXT[at], paid + INSERT
    return tuple(map(tuple, m))


def advance(sym: Symbol, length: int, costs: Costs) -> Costs:
    """Costs in front of a run from those behind it."""
    k = 0
    while length:
        if length & 1:
            costs = apply(power(sym, k), costs)
        length >>= 1
        k += 1
    return costs


def run_matrix(runs: list[tuple[Symbol, int]]):
    """Matrix of consecutive runs."""
    cols = []
    for q in range(4):
        costs: Costs = tuple(0 if p == q else FAR for p in range(4))
        for sym, n in reversed(runs):
            costs = advance(sym, n, costs)
        cols.append(costs)
    return tuple(zip(*cols, strict=True))


def behind(runs: list[tuple[Symbol, int]], costs: Costs) -> list[Costs]:
    """Costs in front of each run, and at last those behind all."""
    out = [costs]
    for sym, n in reversed(runs):
        out.append(advance(sym, n, out[-1]))
    return out[::-1]


def _unroll_run(sym: Symbol, length: int, after: Costs, q: int, out: list[str]) -> int:
    """Letters of a run's cheapest edits from state ``q``; halves keep the costs held at log(length)."""
    if length > 1:
        k = (length - 1).bit_length() - 1
        q = _unroll_run(sym, length - (1 << k), advance(sym, 1 << k, after), q, out)
        return _unroll_run(sym, 1 << k, after, q, out)
    here = apply(power(sym, 0), after)
    while True:
        best = here[q]
        for letter, cost, to in choices(sym)[q]:
            if letter > "I" and INSERT + here[NEXT[q]] == best:
                break
            if cost + after[to] == best:
                out.append(letter)
                return to
        out.append("I")
        q = NEXT[q]


def unroll(runs: list[tuple[Symbol, int]], costs: Costs, q: int, last: bool) -> tuple[str, int]:
    """Audit of consecutive runs from state ``q``, and the state behind them.

    ``costs`` are those behind the runs; behind the ``last`` ones rows are added until
    the pattern is whole.
    """
    out: list[str] = []
    for (sym, n), after in zip(runs, behind(runs, costs)[1:], strict=True):
        q = _unroll_run(sym, n, after, q, out)
    while last and END[q]:
        out.append("I")
        q = NEXT[q]
    return "".join(out), q


@lru_cache(maxsize=1 << 14)
def _solved(runs: tuple) -> tuple[int, str]:
    return behind(list(runs), END)[0][START], unroll(list(runs), END, START, last=True)[0]


def solve(runs: list[tuple[Symbol, int]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation; many short ones are alike."""
    if len(runs) <= 16 and all(n <= 16 for _, n in runs):
        return _solved(tuple(runs))
    return _solved.__wrapped__(tuple(runs))


# --------------------------------------------------------------------------
# a conversation's rows, in order
# --------------------------------------------------------------------------
def fault_of(blank: bool, seen: bool, ended: bool) -> int:
    return BLANK if blank else DUPLICATE if seen else SOUND if ended else TRUNCATED


class Piece:
    """Runs and counts of consecutive rows of one conversation."""

    def __init__(self):
        self.runs: list[list] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns; rows come in their order
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int, copies: int) -> None:
        """``copies`` equal rows, one behind the other."""
        later = fault if fault == BLANK else DUPLICATE
        for what, n in ((fault, 1), (later, copies - 1)):
            if not n:
                continue
            self.faults[what] += n
            sym = symbol(initial, what)
            if self.runs and self.runs[-1][0] == sym:
                self.runs[-1][1] += n
            else:
                self.runs.append([sym, n])
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, other: "Piece") -> None:
        """Counts of the rows behind; the runs stay apart."""
        for k in range(4):
            self.faults[k] += other.faults[k]
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in LEGAL
        self.illegal += other.illegal
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.last is not None else self.last
        if other.low is not None:
            self.turns += other.turns - (other.low == self.high)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def counts(self) -> tuple:
        return self.gaps(), self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal


class Writer:
    """SHA-256 of the repaired rows, fed row by row; holds no text."""

    def __init__(self):
        self.digest, self.some, self.state = hashlib.sha256(), False, START
        self.audit: Iterator[str] = iter("")

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def _added(self) -> None:
        self._line(ADDED[self.state], "")
        self.state = NEXT[self.state]

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            for letter in self.audit:
                if letter != "I":
                    break
                self._added()
            if letter == "K":
                self._line(role, text)
                self.state = FOLLOWS[role[0], self.state]
            elif letter == "R":
                self._line(ADDED[self.state], text)
                self.state = NEXT[self.state]

    def rest(self) -> None:
        for _ in self.audit:
            self._added()

    def hex(self) -> str:
        return self.digest.hexdigest()


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------
ROW = "turn long, role string, text string, copies long, blank boolean, ended boolean"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(c, turn, role, text, copies) after damage by crc32(``conv:turn``) % 20.

    0 drops a row, 1 empties its text, 2 removes ``[.!?]``, 3 doubles the row, 4 sets
    the role to user.  Null roles and texts, and nulls in the key, are one space; null
    conversations and turns stay null in the result.
    """
    some = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv), F.lit(":"), some(turn)).cast("binary")) % 20
    src = rows.select(
        conv.alias("c"), turn.cast("long").alias("turn"), some(role).alias("r"), some(text).alias("t"), kind.alias("kind")
    )
    return src.where("kind != 0").select(
        "c",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("r")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("t", ".!?", ""))
        .otherwise(F.col("t"))
        .alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def layout(rows: DataFrame) -> DataFrame:
    """Equal rows with their number, range-partitioned and sorted, with what tells their faults."""
    keys = ["c", "turn", "role", "text"]
    one = stored(rows.groupBy(*keys).agg(F.sum("copies").alias("copies")))
    size = one.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 32)).first()[0] or 0
    at_once = one.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // PART_BYTES), min(at_once, size >> 20))
    order = [F.col(k).asc_nulls_first() for k in keys]
    laid = one.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tail = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    return laid.select(
        *keys, "copies", (tail == "").alias("blank"), tail.isin(".", "!", "?").alias("ended"),
        F.spark_partition_id().cast("long").alias("part"),
    )


def _rows(batches) -> Iterator[tuple]:
    names = ("turn", "role", "text", "copies", "blank", "ended")
    for batch in batches:
        kind = batch.schema.field("c").type
        cols = [batch.column(n).to_pylist() for n in names]
        for c, part, *row in zip(batch.column("c").to_pylist(), batch.column("part").to_pylist(), *cols, strict=True):
            yield kind, c, part, row


def _whole(rows: list) -> tuple:
    """Result of a conversation whose rows are all here."""
    piece, seen = Piece(), set()
    for turn, role, text, copies, blank, ended in rows:
        name = (role, hashlib.sha256(text.encode()).digest() if len(text) > 64 else text)
        piece.add(turn, role[:1], fault_of(blank, name in seen, ended), copies)
        seen.add(name)
    cost, audit = solve([(s, n) for s, n in piece.runs])
    out = Writer()
    out.audit = iter(audit)
    for _, role, text, copies, _, _ in rows:
        out.row(role, text, copies)
    out.rest()
    return *piece.counts(), cost, audit, out.hex()


def _solve_inside():
    """Results of conversations within a partition; rows of its first and last one pass unchanged."""
    results = [c.split()[0] for c in RESULT.split(", ")]
    raw = [c.split()[0] for c in ROW.split(", ")]

    def batch(lines: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
        types += [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        cols = zip(*lines, strict=True)
        arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["c", "part", "place", *results, *[f"row_{n}" for n in raw]])

    def run(batches):
        held: list = []  # rows of the current conversation, if it began in this partition
        done: list[tuple] = []
        size, at, place, opened, kind, last = 0, (), 0, False, None, None
        blank = (None,) * 8
        for kind, c, part, row in _rows(batches):
            if (c,) != at:
                if held:
                    done.append((last[0], last[1], None, *_whole(held), *(None,) * 6))
                opened, at, held = not at, (c,), []  # the first one may have begun before
            last = c, part
            if opened:
                done.append((c, part, place, *blank, *row))
                size += len(row[2])
            else:
                held.append(row)
            place += 1
            if len(done) >= 2000 or size > 4 << 20:
                yield batch(done, kind)
                done, size = [], 0
        for k, row in enumerate(held):  # the last one may go on
            done.append((*last, place - len(held) + k, *blank, *row))
        if done:
            yield batch(done, kind)

    return run


def _piece(table: pa.Table) -> tuple[Piece, tuple]:
    """Piece of a conversation in one partition, from its rows with their faults."""
    rows = table.sort_by("place").select(["row_turn", "initial", "fault", "row_copies"]).to_pydict()
    piece = Piece()
    for turn, initial, fault, copies in zip(*rows.values(), strict=True):
        piece.add(turn, initial, fault, copies)
    return piece, table.column("part")[0].as_py()


def _composed(key, table: pa.Table):
    """Counts of a conversation from its pieces, the costs behind each piece."""
    rows = table.sort_by("part").to_pylist()
    whole = Piece()
    for r in rows:
        p = Piece()
        p.faults, p.illegal, p.turns = r["faults"], r["illegal"], r["turns"]
        p.first, p.last, p.low, p.high = r["first"], r["last"], r["low"], r["high"]
        whole.join(p)
    after, costs = [], END
    for r in reversed(rows):
        after.append(list(costs))
        costs = apply([r["matrix"][4 * q : 4 * q + 4] for q in range(4)], costs)
    return rows, whole, after[::-1], costs[START]


def _same(*cols: str) -> Column:
    conds = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    out = conds[0]
    for c in conds[1:]:
        out &= c
    return out


def _open(rows: DataFrame) -> DataFrame:
    """Results of conversations that lie in several partitions, or may do so."""
    kind = rows.schema["c"].dataType.simpleString()
    digest = F.sha2("row_text", 256)
    rows = rows.withColumn("name", digest)
    # Order of equal roles and texts: by turn, nulls first; equal rows of one turn are one row here.
    when = F.struct(F.col("row_turn").isNotNull().alias("known"), F.col("row_turn").alias("turn"))
    first = rows.groupBy("c", "row_role", "name").agg(F.min(when).alias("first"))
    seen = rows.alias("l").join(first.alias("r"), _same("c", "row_role", "name"), "left")
    fault = (
        F.when(F.col("row_blank"), BLANK)
        .when(~F.col("first").eqNullSafe(when), DUPLICATE)
        .when(F.col("row_ended"), SOUND)
        .otherwise(TRUNCATED)
        .cast("long")
    )
    slim = stored(
        seen.select(
            "l.c", "l.part", "l.place", "l.row_turn", F.substring("l.row_role", 1, 1).alias("initial"), fault.alias("fault"), "l.row_copies"
        )
    )
    piece_schema = (
        f"c {kind}, part long, matrix array<long>, faults array<long>, illegal long, first string, last string, "
        "low long, high long, turns long"
    )

    def summed(key, table):
        p, part = _piece(table)
        m = run_matrix([(s, n) for s, n in p.runs])
        cols = [[part], [[x for row in m for x in row]], [p.faults], [p.illegal], [p.first], [p.last], [p.low], [p.high], [p.turns]]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), longs, longs, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["c", "part", "matrix", "faults", "illegal", "first", "last", "low", "high", "turns"]
        return pa.table([table.column("c").slice(0, 1), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names)

    pieces = stored(slim.groupBy("c", "part").applyInArrow(summed, piece_schema))

    def costed(key, table):
        own, whole, after, cost = _composed(key, table)
        n = len(own)
        counts = [pa.array([v] * n, pa.int64()) for v in (*whole.counts(), cost)]
        c = pa.array([key[0].as_py()] * n, table.column("c").type)
        cols = [c, pa.array([r["part"] for r in own]), pa.array(after), pa.array([k == n - 1 for k in range(n)]), *counts]
        return pa.table(cols, ["c", "part", "after", "final", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])

    six = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    costs = stored(pieces.groupBy("c").applyInArrow(costed, f"c {kind}, part long, after array<long>, final boolean, {six}"))
    both = slim.alias("l").join(costs.select("c", "part", "after", "final").alias("r"), _same("c", "part"))

    def unrolled(key, table):
        p, part = _piece(table)
        after, final = tuple(table.column("after")[0].as_py()), table.column("final")[0].as_py()
        ways = [unroll([(s, n) for s, n in p.runs], after, q, final) for q in range(4)]
        cols = [table.column("c").slice(0, 1), pa.array([part]), pa.array([[w for w, _ in ways]]), pa.array([[q for _, q in ways]])]
        return pa.table(cols, ["c", "part", "audits", "ends"])

    ways = stored(
        both.select("l.*", "r.after", "r.final")
        .groupBy("c", "part")
        .applyInArrow(unrolled, f"c {kind}, part long, audits array<string>, ends array<long>")
    )

    def chained(key, table):
        at, parts, starts = START, [], []
        for r in table.sort_by("part").to_pylist():
            parts.append(r["part"])
            starts.append(at)
            at = r["ends"][at]
        return pa.table([pa.array([key[0].as_py()] * len(parts), table.column("c").type), pa.array(parts), pa.array(starts)], ["c", "part", "start"])

    starts = ways.select("c", "part", "ends").groupBy("c").applyInArrow(chained, f"c {kind}, part long, start long")
    chosen = ways.alias("l").join(starts.alias("r"), _same("c", "part"))
    chosen = stored(chosen.select("l.c", "l.part", F.get("l.audits", F.col("r.start").cast("int")).alias("audit")))
    # Rows in order behind their piece's audit; the hash of a conversation is sequential by its nature.
    stream = rows.select("c", "part", "place", "row_role", "row_text", "row_copies").unionByName(
        chosen.select("c", "part", F.lit(-1).cast("long").alias("place"), "audit"), allowMissingColumns=True
    )
    deal = F.coalesce(F.xxhash64("c"), F.lit(0))
    stream = stream.withColumn("deal", deal).repartition("deal").sortWithinPartitions("deal", "c", "part", "place")
    hashes = stream.drop("deal").mapInArrow(_hashed, f"c {kind}, repaired_sha256 string")
    audit = chosen.groupBy("c").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    counts = costs.groupBy("c").agg(*[F.first(n).alias(n) for n in (x.split()[0] for x in six.split(", "))])
    out = counts.alias("l").join(audit.alias("r"), _same("c")).select("l.*", "r.audit")
    return out.alias("l").join(hashes.alias("r"), _same("c")).select("l.*", "r.repaired_sha256")


def _hashed(batches):
    """SHA-256 of each conversation, streamed over its sorted rows."""
    at, out, kind = (), None, None
    done: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], ["c", "repaired_sha256"]
        )

    for batch in batches:
        kind = batch.schema.field("c").type
        cols = (batch.column(n).to_pylist() for n in ("c", "place", "audit", "row_role", "row_text", "row_copies"))
        for c, place, audit, role, text, copies in zip(*cols, strict=True):
            if (c,) != at:
                if out:
                    out.rest()
                    done.append((at[0], out.hex()))
                at, out = (c,), Writer()
            if place < 0:
                out.rest()
                out.audit = iter(audit)
            else:
                out.row(role, text, copies)
        if len(done) >= 2000:
            yield flush()
            done = []
    if out:
        out.rest()
        done.append((at[0], out.hex()))
    if done:
        yield flush()


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    damage=damaged,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row per distinct conversation of the input, null included, also where damage
    leaves it no row (zeros, empty audit, hash of the empty string).  Rows are taken
    by turn, nulls first; rows of one turn by role, then text (as after damage), so
    equal rows stand side by side.  Null roles and texts are one space.  A text without
    a character outside of space, tab to carriage return is blank; of equal rows all
    but the first are duplicates.  Roles count by their first character, an empty role
    by none.  An empty table gives no rows; only the four named columns are read.

    A conversation may have any number of rows: only its audit, which is one value of
    the result, and one piece's rows at a time are held in memory; its hash streams.
    """
    spark = conversations.sparkSession
    prepare(spark)
    named = [conversations[c] for c in (conv_col, turn_col, role_col, text_col)]
    laid = layout(damage(conversations, *named))
    kind = laid.schema["c"].dataType.simpleString()
    raw = ", ".join(f"row_{c}" for c in ROW.split(", "))
    solved = stored(laid.mapInArrow(_solve_inside(), f"c {kind}, part long, place long, {RESULT}, {raw}"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    inside = solved.where("place is null").select("c", *names)
    across = _open(solved.where("place is not null").drop(*names)).select("c", *names)
    every = conversations.select(named[0].alias("c")).distinct()
    out = every.alias("l").join(inside.unionByName(across).alias("r"), _same("c"), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return out.select(
        F.col("l.c").alias(conv_col),
        *[F.coalesce(F.col(f"r.{n}"), F.lit(empty.get(n, 0)).cast("string" if n in empty else "long")).alias(n) for n in names],
    )


# --------------------------------------------------------------------------
# plain version, for tests
# --------------------------------------------------------------------------
def brute_force(rows: list[tuple]) -> list[tuple]:
    """Rows of ``repair`` from (conv, turn, role, text) by a search over all edits."""
    import heapq
    import re
    import zlib

    convs: dict = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        firsts = [r[:1] for _, r, _ in own]
        # Cheapest cost, then least audit: states (rows used, role initials so far as a state letter).
        heap, best = [(0, "", 0, "", ())], None
        closed = set()
        while heap:
            cost, audit, i, state, lines = heapq.heappop(heap)
            if i == len(own) and state in ("", "a"):
                best = cost, audit, lines
                break
            if (i, state) in closed:
                continue
            closed.add((i, state))
            new = "assistant" if state == "u" else "user"
            heapq.heappush(heap, (cost + 3, audit + "I", i, new[0], (*lines, new + ":")))
            if i < len(own):
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
                _, role, text = own[i]
                extra = 3 * (faults[i] == "truncated")
                if faults[i] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
                    if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False)),
            best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
        ))
    return out
