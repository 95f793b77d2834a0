"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?, and the least audit of them.

Cost layers in the manner of Wu and Manber: for each cost, from 0 on, a bitset of the grammar's states for each turn that can be reached at that cost. The first layer
that accepts after the last turn gives the cost. The layers are pruned from the end to states that lead there; then a trace carries the set of states that one audit
leaves open and takes the least letter that keeps the set alive. A state that another beats by more than BAND can't win, so a layer holds the turns within
reach of it only, and the work is linear in the turns.

Rows travel without their texts (a role code, a fault, a mark of the text) to find the edits, one byte a turn; then texts, sorted, stream past the audit
into the hash, so that no task holds a conversation's texts. The contract's digest is over the whole repaired conversation in order, so one task reads it all.

Defined results: a null conversation id is an id; null role or text is one space; null turns come first; turns that tie go by role and
text; rows repeat as often as they are there; a role without an initial of s, u, a can't be kept; an empty table gives no rows. Very long texts and conversations are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import keep

WHITE = " \t\n\x0b\x0c\r"
#: Faults, in the order that decides which counts.
FAULTS = ("", "blank", "duplicate", "truncated")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: States of the grammar as bits: nothing yet, after system, after user, after assistant. The first and the last accept.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ACCEPTS = START | ASSISTANT
STEPS = {"s": ((START, SYSTEM),), "u": ((START | SYSTEM | ASSISTANT, USER),), "a": ((USER, ASSISTANT),), "": ()}
#: The role code of a row: its initial's place in ROLES plus four times the fault's place in FAULTS.
ROLES = ("", "s", "u", "a")
DELETE, INSERT, REROLE = 3, 2, 2
#: From any state the future of another one can be had for a deletion and two insertions, 7, and a truncated row's 1 more.
BAND = DELETE + 2 * INSERT + 2


def moves(initials: str) -> list[int]:
    """For each set of states the set after one of the initials."""
    return [sum({to for i in initials for source, to in STEPS[i] if states & source}) for states in range(16)]


KEEPS = [moves(r) for r in ROLES]
ANY = moves("ua")
BACK_KEEPS = [[sum(1 << s for s in range(4) if table[1 << s] & states) for states in range(16)] for table in KEEPS]
BACK_ANY = [sum(1 << s for s in range(4) if ANY[1 << s] & states) for states in range(16)]


class Layer:
    """Bitsets of states at the turns first, first + 1, ... ; outside there is none."""

    def __init__(self, first: int):
        self.first, self.bits = first, bytearray()

    def at(self, i: int) -> int:
        i -= self.first
        return self.bits[i] if 0 <= i < len(self.bits) else 0


NOTHING = Layer(0)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation given as role codes."""
    n = len(codes)
    layers: list[Layer] = []
    best = [-1] * (n + 1)  # the least cost at which a turn is reached
    low, goal = 0, -1
    while goal < 0:
        cost = len(layers)
        back = lambda k: layers[cost - k] if cost >= k else NOTHING  # noqa: E731, B023
        while low < n and 0 <= best[low] < cost - BAND:
            low += 1
        layer, one, two, three = Layer(low), back(1), back(2), back(3)
        ends = max(x.first + len(x.bits) for x in (one, two, three)) + 1
        i = low
        while i <= n:
            states = ANY[two.at(i)]
            if cost == 0 and i == 0:
                states |= START
            if i:
                role, fault = codes[i - 1] & 3, codes[i - 1] >> 2
                states |= three.at(i - 1)
                if fault == 0:
                    states |= KEEPS[role][layer.at(i - 1)] | ANY[two.at(i - 1)]
                elif fault == 3:
                    states |= KEEPS[role][one.at(i - 1)] | ANY[three.at(i - 1)]
            if not states and i > ends:
                break
            layer.bits.append(states)
            if states and best[i] < 0:
                best[i] = cost
            i += 1
        layer.bits = layer.bits.rstrip(b"\0")
        layers.append(layer)
        if layer.at(n) & ACCEPTS:
            goal = cost

    # What leads to the goal, from the end back.
    live: list[Layer] = [NOTHING] * (goal + 1)
    for cost in range(goal, -1, -1):
        held, kept = layers[cost], Layer(layers[cost].first)
        kept.bits = bytearray(len(held.bits))
        after = lambda k: live[cost + k] if cost + k <= goal else NOTHING  # noqa: E731, B023
        for at in range(len(held.bits) - 1, -1, -1):
            i = held.first + at
            onward = BACK_ANY[after(INSERT).at(i)]
            if i == n and cost == goal:
                onward |= ACCEPTS
            if i < n:
                role, fault = codes[i] & 3, codes[i] >> 2
                onward |= after(DELETE).at(i + 1)
                if fault == 0:
                    onward |= BACK_KEEPS[role][kept.at(i + 1)] | BACK_ANY[after(REROLE).at(i + 1)]
                elif fault == 3:
                    onward |= BACK_KEEPS[role][after(1).at(i + 1)] | BACK_ANY[after(REROLE + 1).at(i + 1)]
            kept.bits[at] = held.bits[at] & onward
        live[cost] = kept

    def alive(cost: int, i: int) -> int:
        return live[cost].at(i) if cost <= goal else 0

    audit, i, cost, states = [], 0, 0, START
    while (i, cost) != (n, goal):
        role, fault = (codes[i] & 3, codes[i] >> 2) if i < n else (0, 1)
        extra = 1 if fault == 3 else 0
        choices = [("I", INSERT, 0, ANY[states])]
        if i < n:
            choices.append(("D", DELETE, 1, states))
        if fault in (0, 3):
            choices += [("K", extra, 1, KEEPS[role][states]), ("R", REROLE + extra, 1, ANY[states])]
        for letter, price, step, reached in sorted(choices):
            if left := reached & alive(cost + price, i + step):
                audit.append(letter)
                i, cost, states = i + step, cost + price, left
                break
        else:
            raise AssertionError("the trace left the layers")
    return goal, "".join(audit)


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, twin, there: the rows after the damage that their crc32 asks for; twin numbers repetitions, there is false for a dropped row."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("_kind"))
    kind = F.col("_kind")
    rows = rows.withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role"))).withColumn("there", kind != 0)
    return rows.withColumn("twin", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind")


def as_given(rows: DataFrame) -> DataFrame:
    """The rows without damage, with the columns that repair_conversations takes."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", spaced("role"), spaced("text"), F.lit(True).alias("there"), F.lit(0).alias("twin"))


def in_order(rows: DataFrame, *more: str) -> DataFrame:
    """A conversation's rows in one partition, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.col("turn").asc_nulls_first(), "role", "mark", "twin")


def columns_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names])


def edits(rows: DataFrame) -> DataFrame:
    """A row for each conversation, with its counts, cost and audit; rows has the columns of damaged()."""
    kind = rows.schema["conv_id"].dataType
    solid = F.rtrim("text", F.lit(WHITE))
    role = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES[1:]]), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(solid == "", 1).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    lean = rows.select("conv_id", "turn", "role", "there", "twin", role.cast("int").alias("initial"), fault.alias("fault"), digest_of(F.col("text")).alias("mark"))
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((f, pa.int64()) for f in COUNTS), ("audit", pa.string())])

    def closed(conv_id: object, codes: bytearray, first: int | None, last: int | None, distinct: int) -> tuple:
        cost, audit = repair(bytes(codes))
        counts = [sum(1 for c in codes if c >> 2 == k) for k in (1, 2, 3)]
        initials = [ROLES[c & 3] for c in codes]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return (conv_id, 0 if first is None else last - first + 1 - distinct, *counts, illegal, cost, audit)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, seen, first, last, distinct = None, None, set(), None, None, 0
        for batch in batches:
            out = []
            for conv_id, turn, name, there, initial, fault_, mark in columns_of(batch, "conv_id", "turn", "role", "there", "initial", "fault", "mark"):
                if codes is None or conv_id != now:
                    if codes is not None:
                        out.append(closed(now, codes, first, last, distinct))
                    now, codes, seen, first, last, distinct = conv_id, bytearray(), set(), None, None, 0
                if not there:
                    continue
                if turn is not None and (first is None or turn != last):
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
                if fault_ != 1 and (name, mark) in seen:
                    fault_ = 2
                seen.add((name, mark))
                codes.append(initial | fault_ << 2)
            if out:
                yield batch_of(out)
        if codes is not None:
            yield batch_of([closed(now, codes, first, last, distinct)])

    return in_order(lean).mapInArrow(walk, from_arrow_schema(schema))


def stream_repairs(rows: DataFrame, told: DataFrame, schema: pa.Schema, result: Callable) -> DataFrame:
    """The rows that result(now, turns) gives for each conversation, where now has its edits and turns, to be read to the end, are (edit, role, text) of the repaired conversation, one at a time."""
    texts = rows.where("there").select("conv_id", "turn", "role", "twin", "text", digest_of(F.col("text")).alias("mark"), F.lit(1).alias("_text"))
    both = told.select("*", F.lit(0).alias("_text")).unionByName(texts, allowMissingColumns=True)
    kept = [f.name for f in told.schema]
    at_once = 1000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = (row for batch in batches for row in columns_of(batch, "_text", "role", "text", *kept))

        def results() -> Iterator[dict]:
            for is_text, _, _, *values in rows_:
                assert not is_text  # a conversation's edits come before its texts
                now = dict(zip(kept, values))
                turns = repaired_turns(now["audit"], ((r[1], r[2]) for r in rows_))
                yield from result(now, turns)

        found = results()
        while part := list(islice(found, at_once)):
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    return in_order(both, "_text").mapInArrow(walk, from_arrow_schema(schema))


def repaired_turns(audit: str, texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """The turns that an audit leaves, with the edit that made each. An audit fixes the roles: behind a system turn that is kept they alternate."""
    stays, system = 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(texts)
        if letter == "D":
            continue
        if letter == "K":
            system += stays == 0 and role.startswith("s")
            yield letter, role, text
        else:
            yield letter, ("user", "assistant")[(stays - system) % 2], text
        stays += 1


def repair_conversations(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of `role:text`, newline-joined)."""
    told = keep(edits(rows))
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), *((f, pa.int64()) for f in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def hashed(now: dict, turns: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
        whole = hashlib.sha256()
        for i, (_, role, text) in enumerate(turns):
            whole.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield now | {"repaired_sha256": whole.hexdigest()}

    return stream_repairs(rows, told, schema, hashed)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, turn (from 0), role, text, edit (K, R or I)."""
    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def listed(now: dict, turns: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
        for i, (edit, role, text) in enumerate(turns):
            yield {"conv_id": now["conv_id"], "turn": i, "role": role, "text": text, "edit": edit}

    return stream_repairs(rows, keep(edits(rows)).select("conv_id", "audit"), schema, listed)
