"""Conversation structure repair: the cheapest edits that give every conversation its turns.

Method. Each turn becomes one symbol of role and fault, each conversation a
signature. Signatures are sorted over range partitions, which lays out their
prefix trie: a task walks it with a stack of DP layers, so the layer of a prefix is
computed once for all signatures that share it, and answers are read off at
terminal nodes. Equal signatures may span ranges: none is hot.

A layer holds, for each state of the grammar, the cheapest cost, how it was reached
and the rank of its edits among the layer's. Edits are counted up to the last row
they consume, so no state's edits begin another's, and order of ranks is order of
whole strings: nothing but the stack is kept, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, materialize

# Costs of the edits, roles of inserted and changed turns, adjacent initials that are right.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
RIGHT_PAIRS = {"su", "ua", "au"}

# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The only role of user and assistant that may come next, and the state after it.
TURN = {START: ("u", ASKED), SYSTEM: ("u", ASKED), ASKED: ("a", ANSWERED), ANSWERED: ("u", ASKED)}
ROLES = {"u": USER, "a": ASSISTANT}

#: Symbol of a row that must go; others are their role's initial, in upper case if truncated, x for other roles.
MUST_GO = "D"

Layer = dict[int, tuple[int, int, int, str]]  # by state: cost, rank, state before, edits since


def inserted(state: int) -> list[tuple[int, int]]:
    """States after 0, 1 and 2 inserted turns; more lead to none of these more cheaply."""
    found = [(0, state)]
    for k in (1, 2):
        state = TURN[state][1]
        found.append((k, state))
    return found


def choices(symbol: str) -> list[tuple[int, int, str, int]]:
    """State before, state after, edits and cost of every way to consume a row."""
    found = []
    late = TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        for k, at in inserted(state):
            found.append((state, at, "I" * k + "D", INSERT * k + DELETE))
            if symbol == MUST_GO:
                continue
            if (kept := NEXT.get((at, symbol.lower()))) is not None:
                found.append((state, kept, "I" * k + "K", INSERT * k + late))
            found.append((state, TURN[at][1], "I" * k + "R", INSERT * k + REROLE + late))
    return found


CHOICES = {symbol: choices(symbol) for symbol in (MUST_GO, *"suaxSUAX")}
FIRST_LAYER: Layer = {START: (0, 0, START, "")}


def next_layer(layer: Layer, symbol: str) -> Layer:
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, after, edits, cost in CHOICES[symbol]:
        if state in layer:
            way = (layer[state][0] + cost, layer[state][1], edits, state)
            if after not in best or way < best[after]:
                best[after] = way
    ranks = {way: k for k, way in enumerate(sorted({way[1:3] for way in best.values()}))}
    return {after: (way[0], ranks[way[1:3]], way[3], way[2]) for after, way in best.items()}


def read_off(layers: list[Layer]) -> tuple[int, str]:
    """Cost and edits of the best way through all layers to a state where a conversation may end."""
    ends = []
    for state, (cost, rank, _, _) in layers[-1].items():
        k = {START: 0, SYSTEM: 2, ASKED: 1, ANSWERED: 0}[state]
        ends.append((cost + INSERT * k, rank, "I" * k, state))
    cost, _, tail, state = min(ends)
    parts = [tail]
    for layer in reversed(layers[1:]):
        _, _, before, edits = layer[state]
        parts.append(edits)
        state = before
    return cost, "".join(reversed(parts))


def walk_trie(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and edits of each of the sorted signatures."""
    layers, last, answer = [FIRST_LAYER], None, (0, "")
    for signature in signatures:
        if signature != last:
            shared = 0
            for x, y in zip(signature, last or ""):
                if x != y:
                    break
                shared += 1
            del layers[shared + 1 :]
            for symbol in signature[shared:]:
                layers.append(next_layer(layers[-1], symbol))
            last, answer = signature, read_off(layers)
        yield answer


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations with faults, the same ones at every run; nulls of role and text become one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one(id_col), F.lit(":"), one(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(one(text_col), ".!?", "")).otherwise(one(text_col))
    return rows.where(kind != 0).select(
        F.col(id_col),
        F.col(turn_col),
        F.when(kind == 4, F.lit(USER)).otherwise(one(role_col)).alias(role_col),
        text.alias(text_col),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows under own names, with the digest that tells their contents apart."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    return turns.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _ordered(turns: DataFrame) -> DataFrame:
    """Conversations whole in a partition, one after the other, each in the order of its turns."""
    return turns.repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), "kind", F.asc_nulls_first("turn"), "role", "digest")


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class _Tally:
    """Counts and signature of the conversation that is being read."""

    def __init__(self, key: object):
        self.key, self.turns, self.low, self.high, self.last = key, 0, None, None, None
        self.faults, self.illegal, self.initial, self.symbols = [0, 0, 0], 0, None, []

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.last
            self.high = self.last = turn
        if self.initial is not None and self.initial + initial not in RIGHT_PAIRS:
            self.illegal += 1
        self.initial = initial
        if fault < 3:
            self.faults[fault] += 1
        if fault < 2:
            self.symbols.append(MUST_GO)
        else:
            symbol = initial if initial in ("s", "u", "a") else "x"
            self.symbols.append(symbol.upper() if fault == 2 else symbol)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults, self.illegal, "".join(self.symbols))


def audit_conversations(
    rows: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Faults of each conversation and the cheapest edits that mend it.

    ``ids`` holds the conversations to report, also those without rows. A
    conversation's rows are taken by turn, null turns first; rows of the same turn by
    role and then by digest of their contents. A row's first fault counts: blank,
    duplicate (same role and text earlier), truncated (its last character that is no white
    space is none of ``.!?``).

    Edits: K keeps a row, R makes it user or assistant, D deletes it, I inserts an empty
    turn. Blank and duplicate rows are deleted. The roles that remain begin with letters in
    ``(s?(ua)+)?``. The cheapest edits win, of equal ones the ASCII-least.

    Returns one row per conversation: the id column, gaps, blank, duplicate, truncated,
    illegal, cost and audit. A null role or text is one space, a null id a conversation of
    its own; a conversation without rows has zeros and no edits. No ids give no rows. Other
    columns are not read, whatever their names.
    """
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    # Contents of one conversation spread over tasks; only numbers and digests meet in its own task.
    again = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    turns = _turns(rows, id_col, turn_col, role_col, text_col).select(
        "id", "turn", "role", "digest", (tail == "").alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    turns = turns.select(
        "id", F.lit(1).alias("kind"), "turn", "role", "digest", F.when(F.col("blank"), 0).when(again, 1).when(F.col("cut"), 2).otherwise(3).alias("fault")
    )
    asked = ids.select(F.col(id_col).alias("id")).distinct().select(
        "id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(3).alias("fault")
    )
    ordered = _ordered(asked.unionByName(turns)).select("id", "kind", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    kind = ordered.schema["id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), *((c, pa.int64()) for c in counts), ("signature", pa.string())])
            found = []
            for key, what, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    if tally:
                        found.append(tally.row())
                    tally = _Tally(key)
                elif tally and tally.key == key:  # else nobody asked for it
                    tally.add(turn, initial, fault)
            if found:
                yield _batch([list(c) for c in zip(*found, strict=True)], schema)
        if tally:
            yield _batch([[x] for x in tally.row()], schema)

    signed = ordered.mapInArrow(sign, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, signature string")
    signed = materialize(signed, "signatures")  # range borders are sampled: it would be computed twice

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def signatures() -> Iterator[str]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                yield from batch.column("signature").to_pylist()

        costs, audits = [], []
        for cost, audit in walk_trie(signatures()):
            costs.append(cost)
            audits.append(audit)
            if len(costs) == held[0].num_rows:
                batch = held.pop(0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*batch.schema.names[:-1], "cost", "audit"])
                costs, audits = [], []

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = signed.repartitionByRange(parts, "signature", "id").sortWithinPartitions("signature", "id")
    solved = sorted_.mapInArrow(solve, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, cost long, audit string")
    return solved.withColumnRenamed("id", id_col)


def repaired_turns(
    rows: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The turns of the mended conversations: the id column, place (from 0), role and text.

    ``audits`` holds the id column and audit, as ``audit_conversations`` returns them. Texts
    pass through one after the other and are never gathered. In a partition a conversation's
    turns stand together and in order.
    """
    turns = _turns(rows, id_col, turn_col, role_col, text_col).select("id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    edits = audits.select(
        F.col(id_col).alias("id"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text")
    )
    ordered = _ordered(edits.unionByName(turns)).select("id", "kind", "role", "text")
    kind = ordered.schema["id"].dataType.simpleString()

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = None, "", 0, START, 0
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            out: list[tuple] = []

            def insert() -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    initial, state = TURN[state]
                    out.append((key, place, ROLES[initial], ""))
                    at, place = at + 1, place + 1

            for owner, what, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == 0:
                    insert()
                    key, audit, at, state, place = owner, text, 0, START, 0
                    continue
                insert()
                if at == len(audit) or owner != key:  # nobody asked for it
                    continue
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    initial, state = TURN[state]
                    role = ROLES[initial]
                else:
                    state = NEXT[state, role[:1]]
                out.append((key, place, role, text))
                place += 1
            if out:
                yield _batch([list(c) for c in zip(*out, strict=True)], schema)
                out = []
        out = []
        while at < len(audit):  # inserted turns that end the last conversation
            initial, state = TURN[state]
            out.append((key, place, ROLES[initial], ""))
            at, place = at + 1, place + 1
        if out:
            yield _batch([list(c) for c in zip(*out, strict=True)], schema)

    return ordered.mapInArrow(mend, f"id {kind}, place long, role string, text string").withColumnRenamed("id", id_col)


def digest_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's ``role:text``, joined by line breaks, from turns as ``repaired_turns`` leaves them."""
    kind = turns.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("sha256", pa.string())])
            found = []
            for owner, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if digest:
                        found.append((key, digest.hexdigest()))
                    key, digest = owner, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if found:
                yield _batch([list(c) for c in zip(*found, strict=True)], schema)
        if digest:
            yield _batch([[key], [digest.hexdigest()]], schema)

    ordered = turns.select(F.col(id_col).alias("id"), "place", "role", "text")
    return ordered.mapInArrow(run, f"id {kind}, sha256 string").withColumnRenamed("id", id_col)


def repair_conversations(
    rows: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Audits (see ``audit_conversations``) and mended turns (see ``repaired_turns``) of conversations."""
    names = (id_col, turn_col, role_col, text_col)
    audits = materialize(audit_conversations(rows, ids, *names), "audits")
    return audits, repaired_turns(rows, audits.select(id_col, "audit"), *names)
