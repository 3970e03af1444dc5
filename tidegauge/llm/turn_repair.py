"""Repair of conversations: turns aligned to the strings of a grammar, by Wagner-Fischer.

A sound conversation's role initials are ``(s?(ua)+)?``. A repair keeps, re-roles or deletes turns and inserts
empty ones. The grammar has one string of each length (with a system turn for odd ones); lengths of one
kind are beginnings of one endless string, so one table of alignments serves them all. The table is filled in a band
around the diagonal (Ukkonen): whoever leaves a band of half-width w has paid for w + 1 insertions, so a cost
below that is final, and else the cost found says how wide the band must be. All lengths that reach the
least cost are traced back, each to its first audit in ASCII order, and the first of these is the repair.

A conversation of any length is cut into blocks of at most ``BLOCK`` turns. A block's insertions stand
before its turns, so the audits of a block are prefix-free and the least ones of the blocks make the least of the whole.
Steps: (1) each block's costs from any last role before it to any last role in it; (2) from the end of a conversation,
one small row a block, what the rest costs; (3) each block's audit for each role before it; (4) turns and audits
stream by in order: roles follow from block to block, counts and the hash are taken on the way. Memory is bounded by a block
in (1) to (3) and by an audit (a letter a turn) in (4); only the hash of a conversation is a sequence by nature.

Defined cases: null roles and texts count as one blank, turns without a number come first, turns of one number are
ordered by role and the MD5 of their text; rows that repeat are duplicates; rows whose conversation is null are a
conversation; initials other than s, u and a fit nowhere; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns of a block.
BLOCK = 128
#: What stands before a turn: nothing, a system, a user or an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What it costs to end after each of them: "ua", "a" or nothing is inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 10**9
LAST = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FULL_ROLE = {"u": "user", "a": "assistant"}


def match_cost(code: str, wanted: str) -> int:
    """Cost of keeping or re-roling a turn. Codes: b and d must go, else the initial (o: another), upper case if truncated."""
    if code in "bd":
        return NEVER
    more = TRUNCATED if code.isupper() else 0
    if code.lower() == wanted:
        return more
    return more + REROLE if wanted != "s" else NEVER


def endless(entry: int, n: int) -> list[str]:
    """Beginnings of n letters of the strings that may follow."""
    if entry == USER:
        return [("au" * n)[:n]]
    plain = ("ua" * n)[:n]
    return [plain, ("s" + plain)[:n]] if entry == START else [plain]


def state_after(entry: int, letters: str, length: int) -> int:
    return LAST[letters[length - 1]] if length else entry


def forward(codes: str, letters: str, width: int) -> dict[int, int]:
    """Least cost of aligning all turns to each length, over alignments inside the band; the last edit is a turn's."""
    n = len(codes)
    row = [NEVER] * (2 * width + 1)  # row[d]: length i + d - width
    row[width] = 0
    for i, code in enumerate(codes):
        price = {x: match_cost(code, x) for x in "sua"}
        for d in range(1, 2 * width + 1):
            j = i + d - width
            if j > 0 and letters[j - 1] != "s" and row[d - 1] + INSERT < row[d]:
                row[d] = row[d - 1] + INSERT
        after = [NEVER] * (2 * width + 1)
        for d in range(2 * width + 1):
            j = i + d - width
            if j < 0:
                continue
            best = row[d] + price[letters[j]]
            if d < 2 * width and row[d + 1] + DELETE < best:
                best = row[d + 1] + DELETE
            after[d] = best
        # Length 0 is reached by deletions alone, from the diagonal on its left.
        if 0 <= (d := width - i - 1) and row[d + 1] + DELETE < after[d]:
            after[d] = row[d + 1] + DELETE
        row = after
    return {n + d - width: c for d, c in enumerate(row) if c < NEVER and n + d - width >= 0}


def backward(codes: str, letters: str, length: int, width: int) -> list[list[int]]:
    """Costs from (turn, letters used) to the end of both, by diagonals as in ``forward``."""
    n, size = len(codes), 2 * width + 1
    table = [[NEVER] * size for _ in range(n + 1)]
    if 0 <= length - n + width < size:
        table[n][length - n + width] = 0
    for i in range(n - 1, -1, -1):
        here, below = table[i], table[i + 1]
        price = {x: match_cost(codes[i], x) for x in "sua"}
        for d in range(size - 1, -1, -1):
            j = i + d - width
            if not 0 <= j <= length:
                continue
            best = below[d - 1] + DELETE if d else NEVER
            if j < length:
                best = min(best, below[d] + price[letters[j]])
                if d + 1 < size and letters[j] != "s":
                    best = min(best, here[d + 1] + INSERT)
            here[d] = best
    return table


def first_audit(codes: str, letters: str, length: int, width: int) -> str:
    """Of the least alignments to that length the audit that comes first: D before I before K before R."""
    table, n, size = backward(codes, letters, length, width), len(codes), 2 * width + 1
    i = j = 0
    out = []
    while i < n:
        d = j - i + width
        rest = table[i][d]
        if d and table[i + 1][d - 1] + DELETE == rest:
            out.append("D")
            i += 1
        elif j < length and letters[j] != "s" and d + 1 < size and table[i][d + 1] + INSERT == rest:
            out.append("I")
            j += 1
        else:
            out.append("K" if codes[i].lower() == letters[j] else "R")
            i, j = i + 1, j + 1
    return "".join(out)


def start_width(codes: str) -> int:
    return 3 + sum(c in "bd" for c in codes)


def crossing(codes: str) -> list[int]:
    """Costs from each state before a block to each state after it, row by row."""
    n = len(codes)
    out = []
    for entry in range(4):
        cost = [NEVER] * 4
        cost[entry] = n * DELETE
        if entry == START and n:
            cost[SYSTEM] = min(match_cost(c, "s") for c in codes) + (n - 1) * DELETE
        for letters in endless(entry, 3 * n + 8):
            width = start_width(codes)
            while True:
                found = [NEVER] * 4
                for length, c in forward(codes, letters, width).items():
                    state = state_after(entry, letters, length)
                    found[state] = min(found[state], c)
                need = max(found[USER], found[ASSISTANT])
                need = (n + 2) * DELETE if need >= NEVER else need  # delete all, insert at most two
                if INSERT * (width + 1) > need or width > 2 * n + 4:
                    break
                width = need // INSERT
            for state in (USER, ASSISTANT):
                cost[state] = min(cost[state], found[state])
        out += cost
    return [min(c, NEVER) for c in out]


def align(codes: str, entry: int, rest: Sequence[int]) -> tuple[str, int, int]:
    """Audit of a block, the state after it, and its cost with the rest, given what the rest costs after each state."""
    families = endless(entry, 3 * len(codes) + 8)
    width, incumbent = start_width(codes), len(codes) * DELETE + rest[entry]
    while True:
        reached = []
        for letters in families:
            for length, c in forward(codes, letters, width).items():
                state = state_after(entry, letters, length)
                reached.append((c + rest[state], letters, length, state))
        incumbent = min([incumbent, *(r[0] for r in reached)])
        within = incumbent - min(rest)
        if INSERT * (width + 1) > within:
            break
        width = within // INSERT
    least = [(first_audit(codes, letters, length, width), state) for c, letters, length, state in reached if c == incumbent]
    return *min(least), incumbent


def coded(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns as conv, turn, role, text (nulls of the latter two: one blank), mark (MD5 of the text) and fault."""
    some = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("")
    return some.withColumn("mark", F.md5(F.col("text").cast("binary"))).withColumn("fault", fault)


def blocks(turns: DataFrame) -> DataFrame:
    """One row a block: its place (conv, band, part), its first turn's (turn, role, mark), codes of its turns."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    again = F.row_number().over(Window.partitionBy("conv", "role", "mark").orderBy(F.col("turn").asc_nulls_first()))
    place = Window.partitionBy("conv", "band").orderBy("turn", "role", "mark", "again")
    code = F.when(F.col("fault") == "b", "b").when(F.col("again") > 1, "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    rows = (
        turns.select("conv", "turn", "role", "mark", "fault", initial.alias("initial"), again.alias("again"))
        .withColumn("band", F.floor(F.col("turn") / BLOCK))
        .withColumn("n", F.row_number().over(place))
        .withColumn("part", F.floor((F.col("n") - 1) / BLOCK))
        .withColumn("code", code)
    )
    listed = F.sort_array(F.collect_list(F.struct("n", "turn", "role", "mark", "code")))
    return (
        rows.groupBy("conv", "band", "part")
        .agg(listed.alias("listed"))
        .select("conv", "band", "part", *[F.col("listed")[0][c].alias(c) for c in ("turn", "role", "mark")], F.array_join("listed.code", "").alias("codes"))
    )


def _mapped(df: DataFrame, columns: dict[str, str], fn, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` with further ones that ``fn`` makes from lists of all columns, batch by batch."""
    types = {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {t}" for c, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fn()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = list(zip(*[state(row) for row in batch.to_pylist()]))
            arrays = [batch.column(c) for c in keep] + [pa.array(m, types[t]) for m, t in zip(made, columns.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])

    return df.mapInArrow(run, schema)


class Rest:
    """Fed the blocks of a conversation from its last one on: what follows each costs, after each state."""

    def __init__(self):
        self.conv: object = self  # no conversation yet
        self.rest: list[int] = []

    def __call__(self, row: dict) -> tuple[list[int]]:
        if row["conv"] != self.conv:
            self.conv, self.rest = row["conv"], list(AT_END)
        rest, cost = self.rest, row["crossing"]
        self.rest = [min([cost[4 * a + b] + rest[b] for b in range(4)]) for a in range(4)]
        return (rest,)


def _audits(row: dict) -> tuple[list[str], list[int]]:
    """A block's audit and the state after it, for each state before it."""
    made = [align(row["codes"], entry, row["rest"]) for entry in range(4)]
    return [m[0] for m in made], [m[1] for m in made]


def audited(turns: DataFrame) -> DataFrame:
    """Blocks with audits and following states for each state before them (steps 1 to 3)."""
    place = ["conv", "band", "part", "turn", "role", "mark", "codes"]
    crossed = _mapped(blocks(turns), {"crossing": "array<int>"}, lambda: lambda row: (crossing(row["codes"]),), place)
    backwards = crossed.repartition("conv").sortWithinPartitions("conv", F.col("band").desc_nulls_last(), F.col("part").desc())
    rested = _mapped(backwards, {"rest": "array<int>"}, Rest, place)
    spread = rested.repartition("conv", "band", "part")
    return _mapped(spread, {"audits": "array<string>", "states": "array<int>"}, lambda: _audits, place)


@dataclass
class Conversation:
    """What is known of a conversation while its turns stream by."""

    conv: object
    plan: int = START  # state after the blocks that have come
    state: int = START  # state after the turns that have come
    edits: deque = field(default_factory=deque)
    codes: deque = field(default_factory=deque)
    audit: list = field(default_factory=list)
    counts: dict = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0))
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    initial: str | None = None

    def add_block(self, codes: str, audits: Sequence[str], states: Sequence[int]) -> None:
        self.edits.extend(audits[self.plan])
        self.audit.append(audits[self.plan])
        self.codes.extend(codes)
        self.plan = states[self.plan]

    def _insert(self) -> tuple[str, str, str]:
        letter = "a" if self.state == USER else "u"
        self.state = LAST[letter]
        self.counts["cost"] += INSERT
        return "I", FULL_ROLE[letter], ""

    def add_turn(self, turn: int | None, role: str, text: str, fault: str) -> Iterator[tuple[str, str, str]]:
        """Edits (letter, role, text) up to this turn; deleted turns have their own role and text."""
        counts = self.counts
        if turn is not None and (self.high is None or turn > self.high):
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            counts["illegal"] += 1
        self.initial = initial
        code = self.codes.popleft()
        kind = {"b": "blank", "d": "duplicate"}.get(code, "truncated" if fault == "t" else "")
        if kind:
            counts[kind] += 1
        while (edit := self.edits.popleft()) == "I":
            yield self._insert()
        if edit == "D":
            counts["cost"] += DELETE
        else:
            if edit == "R":
                counts["cost"] += REROLE
                role = FULL_ROLE["a" if self.state == USER else "u"]
            counts["cost"] += TRUNCATED if fault == "t" else 0
            self.state = LAST[role[0]]
        yield edit, role, text

    def finish(self) -> Iterator[tuple[str, str, str]]:
        for _ in range(AT_END[self.state] // INSERT):
            self.audit.append("I")
            yield self._insert()

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.distinct


def _streamed(turns: DataFrame) -> DataFrame:
    """Blocks and turns of each conversation in order, a block before its turns."""
    order = ["conv", "turn", "role", "mark", "kind"]
    plans = audited(turns).select(*order[:-1], F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit("").alias("fault"), "codes", "audits", "states")
    rows = turns.select(*order[:-1], F.lit(1).alias("kind"), "text", "fault", *[F.lit(None).cast(plans.schema[c].dataType).alias(c) for c in ("codes", "audits", "states")])
    return plans.unionByName(rows).repartition("conv").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, tuple[str, str, str] | None]]:
    """Every edit of each conversation in order, then None."""
    now: Conversation | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    yield from ((now, e) for e in now.finish())
                    yield now, None
                now = Conversation(row["conv"])
            if row["kind"] == 0:
                now.add_block(row["codes"], row["audits"], row["states"])
            else:
                yield from ((now, e) for e in now.add_turn(row["turn"], row["role"], row["text"], row["fault"]))
    if now is not None:
        yield from ((now, e) for e in now.finish())
        yield now, None


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
AT_ONCE = 2000


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
        held.clear()
        return made

    for row in rows:
        held.append(row)
        if len(held) >= AT_ONCE:
            yield table()
    if held:
        yield table()


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, gaps, counts of faults, cost, audit, and the SHA-256 of the repaired ``role:text`` lines."""
    turns = coded(df, conv, turn, role, text)
    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in REPORT) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            digest, lines = hashlib.sha256(), 0
            for now, edit in _conversations(batches):
                if edit is None:
                    counts = now.counts | {"gaps": now.gaps()}
                    yield (now.conv, *[counts[c] for c in REPORT], "".join(now.audit), digest.hexdigest())
                    digest, lines = hashlib.sha256(), 0
                elif edit[0] != "D":
                    digest.update(("\n" if lines else "").encode() + f"{edit[1]}:{edit[2]}".encode())
                    lines += 1

        yield from _batched(rows(), to_arrow_schema(ddl))

    return _streamed(turns).mapInArrow(run, ddl).withColumnRenamed("conv", conv)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired turns: conv, place (from 0), edit (K, R or I), role and text."""
    turns = coded(df, conv, turn, role, text)
    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, place bigint, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            place = 0
            for now, edit in _conversations(batches):
                if edit is None:
                    place = 0
                elif edit[0] != "D":
                    yield (now.conv, place, *edit)
                    place += 1

        yield from _batched(rows(), to_arrow_schema(ddl))

    return _streamed(turns).mapInArrow(run, ddl).select(F.col("conv").alias(conv), "place", "edit", F.col("role").alias(role), F.col("text").alias(text))


def to_arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of simple columns."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c, types[t]) for c, t in (x.strip().split(" ") for x in ddl.split(","))])
