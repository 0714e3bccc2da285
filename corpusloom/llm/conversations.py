"""Repair of the structure of conversations by cheapest edits.

The rows of a conversation are kept, given another role, deleted, or empty ones are put
between them, until the roles are ``system? (user assistant)+`` or nothing is left.
The nodes of the edit lattice are (rows read, last role written). A search from both of
its ends by two heaps settles nodes up to where they meet, looks at all crossings of
least cost and takes the least audit among these.

Rows are sorted over all tasks, and conversations are cut into blocks of bounded size.
A conversation that a task holds whole in one block is repaired at once. Of others each
block gives its cheapest edits between any two roles; such tables join associatively,
so that no task holds the rows of a long conversation, only its letters of edits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, released, small_batches

#: last role written: none, system, user, assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: from a role to the one that may follow, by its initial
NEXT = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
RIGHT = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
#: rows of a block
BLOCK = 64
FAULTS = ("blank", "duplicate", "truncated")

Row = tuple[str, str | None]  # initial of the role, fault


def edits(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(rows read, role, cost, edit) of every edge that leaves a node."""
    if at < len(rows):
        initial, fault = rows[at]
        yield at + 1, state, DELETE, "D"
        if fault not in ("blank", "duplicate"):
            extra = LEFT_TRUNCATED if fault == "truncated" else 0
            if initial in NEXT[state]:
                yield at + 1, NEXT[state][initial], KEEP + extra, "K"
            yield at + 1, USER if state != USER else ASSISTANT, REROLE + extra, "R"
    yield at, USER if state != USER else ASSISTANT, INSERT, "I"


def back_edits(rows: list[Row], at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """The same for the edges that reach a node."""
    for before in (at - 1, at) if at else (at,):
        for role in range(4):
            for to, reached, cost, edit in edits(rows, before, role):
                if (to, reached) == (at, state):
                    yield before, role, cost, edit


def cheapest(rows: list[Row], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) from a role to one of the goals over all rows; of equal costs the least audit; None: no way."""
    n = len(rows)
    labels: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, g): (0, "") for g in goals})
    settled: tuple[set, set] = (set(), set())
    # of equal costs, what all free edges come from goes first: a node's audit is final when it is taken
    heaps = ([(0, 0, start)], sorted((0, 0, g) for g in goals))
    best = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        mine, other = labels[side], labels[1 - side]
        _, place, state = heapq.heappop(heaps[side])
        node = (n - place if side else place, state)
        if node in settled[side]:
            continue
        settled[side].add(node)
        cost, audit = mine[node]
        if node in other:
            total = cost + other[node][0]
            best = total if best is None or total < best else best
        for at, role, price, edit in (back_edits if side else edits)(rows, *node):
            to = (at, role)
            label = (cost + price, edit + audit if side else audit + edit)
            if to not in settled[side] and (to not in mine or label < mine[to]):
                if to not in mine or label[0] < mine[to][0]:
                    heapq.heappush(heaps[side], (label[0], n - at if side else at, role))
                mine[to] = label
                if to in other:
                    total = label[0] + other[to][0]
                    best = total if best is None or total < best else best
    if best is None:
        return None
    # every cheapest path leaves what is settled from the front by an edge into what is settled from behind
    settled[0].add((0, start))
    settled[1].update((n, g) for g in goals)
    found = [a + labels[1][x][1] for x in settled[0] & settled[1] for c, a in [labels[0][x]] if c + labels[1][x][0] == best]
    for node in settled[0]:
        cost, audit = labels[0][node]
        for at, role, price, edit in edits(rows, *node):
            if (at, role) in settled[1] and cost + price + labels[1][at, role][0] == best:
                found.append(audit + edit + labels[1][at, role][1])
    return best, min(found)


Table = dict[tuple[int, int], tuple[int, str]]


def table_of(rows: list[Row]) -> Table:
    """Cheapest edits of a block between any two roles."""
    found = {(a, b): cheapest(rows, a, (b,)) for a in range(4) for b in range(4)}
    return {k: v for k, v in found.items() if v}


def joined(a: Table, b: Table) -> Table:
    """Of two blocks behind one another. Of equal costs no audit begins another, so the least parts make the least whole."""
    out: Table = {}
    for (x, y), (cost, audit) in a.items():
        for (z, w), (more, rest) in b.items():
            if y == z:
                label = (cost + more, audit + rest)
                if (x, w) not in out or label < out[x, w]:
                    out[x, w] = label
    return out


def ended(table: Table) -> tuple[int, str]:
    return min(table[NONE, g] for g in (NONE, ASSISTANT) if (NONE, g) in table)


def repaired(rows: list[tuple[str, str]], audit: str, state: int = NONE) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits; the audit's letters are those of these rows and what is put before, between and behind them."""
    given = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(given)
        if edit == "D":
            continue
        state = NEXT[state][role[:1]] if edit == "K" else USER if state != USER else ASSISTANT
        yield role if edit == "K" else NAMES[state], text


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def marked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, turn, role, text, rid, fault of turns (conv, turn, role, text): each row's first fault.

    A duplicate has a role and text that an earlier row of the conversation has.
    """
    turns = scratch.save(turns.withColumn("rid", F.monotonically_increasing_id()), "turns")
    same = F.sha2(F.concat_ws("\0", "role", "text"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"), F.col("rid").alias("rid"))
    keyed = turns.withColumn("same", same)
    firsts = keyed.groupBy("conv", "same").agg(F.min(order).alias("first"), F.count("*").alias("times")).filter("times > 1")
    firsts = firsts.select(F.col("conv").alias("its"), "same", F.col("first.rid").alias("first"))
    both = keyed.alias("x").join(firsts.alias("y"), F.col("x.conv").eqNullSafe(F.col("y.its")) & (F.col("x.same") == F.col("y.same")), "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(is_blank(F.col("text")), "blank").when(F.col("first") != F.col("rid"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return both.select("conv", "turn", "role", "text", "rid", fault.alias("fault"))


PIECE = (
    "conv {conv}, part int, k long, whole boolean, first_turn {turn}, last_turn {turn}, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_role string, last_role string, cost long, audit string, digest string, "
    "tables array<struct<a:int,b:int,cost:long,audit:string>>, roles array<string>, texts array<string>, n long"
)


def pieces_of(rows: DataFrame) -> DataFrame:
    """A row for each block of sorted rows; those of whole conversations are repaired."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = ["conv", "turn", "role", "text", "rid"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "fault")
    schema = PIECE.format(conv=kinds["conv"], turn=kinds["turn"])
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def piece(held: list[tuple], part: int, k: int, whole: bool) -> dict:
        told = sorted({r[1] for r in held if r[1] is not None})
        initials = [r[2][:1] for r in held]
        out = {
            "conv": held[0][0], "part": part, "k": k, "whole": whole, "n": len(held),
            "first_turn": told[0] if told else None, "last_turn": told[-1] if told else None, "turns": len(told),
            "illegal": sum(a + b not in RIGHT for a, b in zip(initials, initials[1:])), "first_role": initials[0], "last_role": initials[-1],
        }
        out |= {f: sum(r[4] == f for r in held) for f in FAULTS}
        marks = [(a, r[4]) for a, r in zip(initials, held)]
        if whole:
            cost, audit = cheapest(marks, NONE, (NONE, ASSISTANT))
            lines = (f"{role}:{text}" for role, text in repaired([(r[2], r[3]) for r in held], audit))
            out |= {"cost": cost, "audit": audit, "digest": hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()}
        else:
            out["tables"] = [{"a": a, "b": b, "cost": c, "audit": s} for (a, b), (c, s) in table_of(marks).items()]
            out |= {"roles": [r[2] for r in held], "texts": [r[3] for r in held]}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, out = TaskContext.get().partitionId(), 0, [], []
        # the task's first conversation can have begun, and its last one can go on, in another task
        begun = True
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                other = held and row[0] != held[0][0]
                if other or len(held) >= BLOCK:
                    out.append(piece(held, part, k, other and not begun))
                    k, held, begun = k + 1, [], not other
                held.append(row)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if held:
            out.append(piece(held, part, k, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return small_batches(dealt).mapInArrow(released(run), schema)


class Fold:
    """The blocks of a conversation, joined as they come: of the rows only edits are kept."""

    def __init__(self, conv: object):
        self.conv, self.sums, self.turns = conv, dict.fromkeys((*FAULTS, "illegal"), 0), 0
        self.low = self.high = self.role = None
        self.stack: list[tuple[int, Table]] = []  # tables of 1, 2, 4 ... blocks, as in a binary counter

    def add(self, p: dict) -> None:
        for f in self.sums:
            self.sums[f] += p[f]
        if self.role is not None:
            self.sums["illegal"] += self.role + p["first_role"] not in RIGHT
        self.role = p["last_role"]
        if p["turns"]:
            self.turns += p["turns"] - (self.high == p["first_turn"])
            self.low, self.high = p["first_turn"] if self.low is None else self.low, p["last_turn"]
        size, table = 1, {(t["a"], t["b"]): (t["cost"], t["audit"]) for t in p["tables"]}
        while self.stack and self.stack[-1][0] == size:
            table, size = joined(self.stack.pop()[1], table), 2 * size
        self.stack.append((size, table))

    def result(self) -> dict:
        _, table = self.stack.pop()
        while self.stack:
            table = joined(self.stack.pop()[1], table)
        cost, audit = ended(table)
        return self.sums | {"conv": self.conv, "gaps": self.high - self.low + 1 - self.turns if self.turns else 0, "cost": cost, "audit": audit}


def folded(pieces: DataFrame) -> DataFrame:
    """The conversations of several blocks, from what these say: one row each, without a digest."""
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    few = pieces.drop("roles", "texts", "whole", "cost", "audit", "digest")
    dealt = few.repartition("conv").sortWithinPartitions("conv", "part", "k")
    schema = f"conv {kinds['conv']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: Fold | None = None
        for batch in batches:
            for p in batch.to_pylist():
                if so_far and p["conv"] != so_far.conv:
                    yield pa.RecordBatch.from_pylist([so_far.result()], schema=arrow)
                    so_far = None
                so_far = so_far or Fold(p["conv"])
                so_far.add(p)
        if so_far:
            yield pa.RecordBatch.from_pylist([so_far.result()], schema=arrow)

    return dealt.mapInArrow(released(run), schema)


def digests(pieces: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, digest of conversations of several blocks. A digest is a chain: one task hashes a conversation, block by block."""
    kind = pieces.schema["conv"].dataType.simpleString()
    texts = pieces.select("conv", F.lit(1).alias("what"), "part", "k", "roles", "texts", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv", F.lit(0), F.lit(0), F.lit(0).cast("long"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), "audit")
    dealt = texts.union(heads).repartition("conv").sortWithinPartitions("conv", "what", "part", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, audit, at, state, lines = None, None, "", 0, NONE, 0

        def write(rows: list[tuple[str, str]], edits: str) -> None:
            nonlocal state, lines
            for role, text in repaired(rows, edits, state):
                digest.update((b"\n" if lines else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                state, lines = NEXT[state][role[:1]], lines + 1

        def end() -> pa.RecordBatch:
            write([], audit[at:])
            return pa.RecordBatch.from_arrays([held, pa.array([digest.hexdigest()])], names=["conv", "digest"])

        for batch in batches:
            for k in range(batch.num_rows):
                if not batch.column(1)[k].as_py():
                    if digest:
                        yield end()
                    held, digest, audit, at, state, lines = batch.column(0).slice(k, 1), hashlib.sha256(), batch.column(6)[k].as_py(), 0, NONE, 0
                else:
                    rows = list(zip(batch.column(4)[k].as_py(), batch.column(5)[k].as_py()))
                    to, n = at, 0
                    while n < len(rows):
                        n, to = n + (audit[to] != "I"), to + 1
                    write(rows, audit[at:to])
                    at = to
        if digest:
            yield end()

    return small_batches(dealt).mapInArrow(released(run), f"conv {kind}, digest string")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Null roles and texts are a space (so such texts are blank). Rows are taken by turn (nulls first), those of a turn by
    role, text. Roles count by their initials; an empty or unknown one is never kept. A null conversation is one of its own.
    Turns are whole numbers. No rows: no conversations.
    """
    scratch = Scratch(turns.sparkSession, "conversations")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    pieces = scratch.save(pieces_of(marked(rows, scratch)), "pieces")
    names = ["gaps", *FAULTS, "illegal", "cost", "audit"]
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0))
    whole = pieces.filter("whole").withColumn("gaps", gaps).select("conv", *names, "digest")
    parts = pieces.filter("not whole")
    long = scratch.save(folded(parts), "long")
    hashed = digests(parts, long).select(F.col("conv").alias("its"), "digest")
    long = long.join(hashed, F.col("conv").eqNullSafe(F.col("its"))).select("conv", *names, "digest")
    return whole.union(long).select(F.col("conv").alias(conv_col), *names, F.col("digest").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: rows go, are emptied, lose their marks,
    come twice, or get the role user. Nulls are a space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("times")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("times")


def damaged_repairs(turns: DataFrame) -> DataFrame:
    """The repairs of damaged conversations; those without a row left: zeros, an empty audit, the hash of nothing."""
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "its")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("its")), "left").drop("its")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
