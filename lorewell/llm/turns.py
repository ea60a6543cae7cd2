"""Conversation structure repair: forward Viterbi over four grammar states.

A repaired conversation is an optional system turn and then pairs of a user and
an assistant turn, told by the first letters of the roles. Each turn is kept
(0), re-roled (1) or deleted (2, the only way for a blank turn or one whose role
and text came before); empty turns may be inserted anywhere (5); a turn that
breaks off and stays adds 5. The cheapest edits win, the least audit string
among those.

The forward pass carries the least (cost, audit) of each grammar state, and the
layer before each turn is closed by the inserts that can help: one into "user",
then one into "assistant". Audits of one layer that cost the same are never
prefixes of each other, so their order is fixed when they part, and a state needs
only its rank there.

Conversations are cut into pieces: rows are range-partitioned by conversation and
turn, and a piece ends where the partition does or after `piece_rows` rows. The
pass runs from each of the four states on entry, which gives a piece's cheapest
audits from every state to every state. What is merged for a conversation is
sixteen costs and ranks a piece; no text of a conversation meets in one task. The
audits chosen go back to the pieces, where the rows become repaired turns.

Edge cases: null role, text and conversation are a row's values like any other
(null role and text read as one space, a null conv_id is a conversation); turns
are ordered with nulls first and ties by role and text; repeated rows are
duplicates; an empty role, or one whose letter is none of s, u and a, cannot be
kept; an empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm import common

#: Where each state goes by a role's letter: nothing yet, system, user, assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The letter that an insert or a new role has in each state, and that role.
WANTED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
STATES = range(4)
FAR = 1 << 50


@dataclass(frozen=True)
class TurnParams:
    piece_rows: int = 4096
    broadcast_rows: int = 100_000


Live = dict[int, tuple[int, str, tuple | None]]


def closed(live: Live) -> Live:
    """The layer with the inserts that can help: into user from anywhere else, then into assistant."""
    out = dict(live)
    for source, target in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if source in out:
            cost, key, node = out[source]
            if target not in out or (cost + 5, key + "I") < out[target][:2]:
                out[target] = (cost + 5, key + "I", (node, "I"))
    return out


def advanced(live: Live, letter: str, must_delete: bool, truncated: bool) -> Live:
    """The layer after one more turn; keys are ranks again."""
    out: Live = {}

    def offer(target: int, cost: int, key: str, node: tuple | None, edit: str) -> None:
        if target not in out or (cost, key + edit) < out[target][:2]:
            out[target] = (cost, key + edit, (node, edit))

    for state, (cost, key, node) in closed(live).items():
        offer(state, cost + 2, key, node, "D")
        if not must_delete:
            stays = cost + 5 * truncated
            if letter in NEXT[state]:
                offer(NEXT[state][letter], stays, key, node, "K")
            offer(NEXT[state][WANTED[state]], stays + 1, key, node, "R")
    ranks = {key: chr(48 + k) for k, key in enumerate(sorted(x[1] for x in out.values()))}
    return {s: (cost, ranks[key], node) for s, (cost, key, node) in out.items()}


def spelled(node: tuple | None) -> str:
    letters: list[str] = []
    while node is not None:
        node, edit = node
        letters.append(edit)
    return "".join(reversed(letters))


@dataclass
class _Piece:
    """The rows of one conversation that a task has seen since the piece began."""

    conv: object
    number: int
    live: list[Live] = field(default_factory=lambda: [{s: (0, "0", None)} for s in STATES])
    rows: int = 0
    #: blank, duplicate, truncated, illegal, distinct turns
    counts: list[int] = field(default_factory=lambda: [0] * 5)
    turns: list[int | None] = field(default_factory=lambda: [None, None])
    letters: list[str] = field(default_factory=lambda: ["", ""])

    def add(self, turn: int | None, letter: str, fault: int) -> None:
        self.live = [advanced(x, letter, fault in (1, 2), fault == 3) for x in self.live]
        if fault:
            self.counts[fault - 1] += 1
        if self.rows and self.letters[1] + letter not in ("su", "ua", "au"):
            self.counts[3] += 1
        if turn is not None:
            self.counts[4] += turn != self.turns[1]
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]
        self.letters = [letter if not self.rows else self.letters[0], letter]
        self.rows += 1

    def record(self) -> dict:
        cells = [(x.get(s, (FAR, "0", None))) for x in self.live for s in STATES]
        return {
            "conv": self.conv, "piece": self.number, "pos": 0, "role": None, "text": None, "costs": [c[0] for c in cells], "ranks": [ord(c[1]) - 48 for c in cells],
            "audits": [spelled(c[2]) for c in cells], "counts": self.counts, "turns": self.turns, "letters": self.letters,
        }


def _fields(conv: T.DataType) -> T.StructType:
    longs, texts = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    return T.StructType([T.StructField("conv", conv), T.StructField("piece", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(n, t) for n, t in (("costs", longs), ("ranks", longs), ("audits", texts), ("counts", longs), ("turns", longs), ("letters", texts)))])


def _stream(df: DataFrame, schema: T.StructType, work: Callable[[Iterator[dict]], Iterator[dict]], rows: int = 1024) -> DataFrame:
    """Rows of each partition in their order through `work`; a task holds a batch, not its partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for row in work(row for b in batches for part in (b.slice(k, rows) for k in range(0, b.num_rows, rows)) for row in part.to_pylist()):
            held.append(row)
            size += len(row.get("text") or "")
            if len(held) == rows or size > common.BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, target)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, target)

    return df.mapInArrow(run, schema)


def _flagged(rows: DataFrame, p: TurnParams) -> DataFrame:
    """Rows with their fault but for what neighbours tell: conv, turn, role, text, fault, first (the earliest turn of a role and text that come again)."""
    marked = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    keyed = rows.withColumn("_key", F.unhex(F.md5(F.concat(marked("conv"), F.lit("\x00"), F.col("role"), F.lit("\x00"), F.col("text")))))
    again = (
        keyed.groupBy("_key").agg(F.count("*").alias("n"), F.bool_or(F.col("turn").isNull()).alias("_none"), F.min("turn").alias("_least"))
        .where("n > 1").select("_key", "n", F.struct(F.when(~F.col("_none"), F.col("_least")).alias("turn")).alias("first"))
    )
    return common.lookup(keyed, again, "_key", p.broadcast_rows).select(
        "conv", "turn", "role", "text", F.col("first").isNotNull().alias("again"), F.col("first.turn").alias("first"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0).alias("fault"),
    )


def _pieces(rows: DataFrame, p: TurnParams) -> DataFrame:
    """Every row with its piece and place there (from 1), and for each piece a record at place 0."""
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    dealt = _flagged(rows, p).repartitionByRange(*order).sortWithinPartitions(*order)

    def work(found: Iterator[dict]) -> Iterator[dict]:
        at, count, before, now = TaskContext.get().partitionId() << 33, 0, None, None
        for r in found:
            same = (r["conv"], r["turn"], r["role"], r["text"])
            if now is None or now.conv != r["conv"] or now.rows >= p.piece_rows:
                if now is not None:
                    yield now.record()
                now, count = _Piece(r["conv"], at + count), count + 1
            later = r["again"] and (r["first"] != r["turn"] or same == before)
            now.add(r["turn"], r["role"][:1], 2 if later and r["fault"] != 1 else r["fault"])
            before = same
            yield {"conv": r["conv"], "piece": now.number, "pos": now.rows, "role": r["role"], "text": r["text"]}
        if now is not None:
            yield now.record()

    return _stream(dealt, _fields(rows.schema["conv"].dataType), work)


def _merged(pieces: DataFrame) -> DataFrame:
    """(piece, cell, tail) for each piece, and with a conversation's first piece what is counted over all of it."""
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("tail", T.LongType()), *(T.StructField(n, T.LongType()) for n in REPORT)])
    light = pieces.select("conv", "piece", "costs", "ranks", "counts", "turns", "letters").repartition("conv").sortWithinPartitions("conv", "piece")

    def chosen(numbers: list[int], back: list[list[int]], vector: list[tuple[int, int]], total: list[int]) -> Iterator[dict]:
        # a system turn needs a pair after it, a user turn an answer
        cost, _, state = min((c + 5 * tail, f"{rank}" + "I" * tail, s) for s, tail in ((0, 0), (1, 2), (2, 1), (3, 0)) for c, rank in (vector[s],))
        tail, cells = {1: 2, 2: 1}.get(state, 0), []
        for steps in reversed(back):
            cells.append(steps[state] * 4 + state)
            state = steps[state]
        for k, (number, cell) in enumerate(zip(numbers, reversed(cells))):
            yield {"piece": number, "cell": cell, "tail": tail if k == len(numbers) - 1 else 0} | (dict(zip(REPORT, [*total, cost])) if not k else {})

    def work(found: Iterator[dict]) -> Iterator[dict]:
        numbers: list[int] = []
        for r in found:
            if not numbers or conv != r["conv"]:
                if numbers:
                    yield from chosen(numbers, back, vector, [gaps(span, counts), *counts[:4]])
                conv, numbers, back, counts, span, letter = r["conv"], [], [], [0] * 5, [None, None], None
                vector = [(0, 0), (FAR, 0), (FAR, 0), (FAR, 0)]
            steps, reached = [], []
            for target in STATES:
                options = [(vector[s][0] + r["costs"][4 * s + target], vector[s][1], r["ranks"][4 * s + target], s) for s in STATES]
                reached.append(min(options))
                steps.append(reached[-1][3])
            order = {x: k for k, x in enumerate(sorted({x[1:3] for x in reached if x[0] < FAR}))}
            vector = [(min(x[0], FAR), order.get(x[1:3], 0)) for x in reached]
            numbers.append(r["piece"])
            back.append(steps)
            counts = [a + b for a, b in zip(counts, r["counts"])]
            counts[3] += letter is not None and letter + r["letters"][0] not in ("su", "ua", "au")
            letter = r["letters"][1]
            if r["turns"][1] is not None:
                counts[4] -= span[1] == r["turns"][0]
                span = [r["turns"][0] if span[0] is None else span[0], r["turns"][1]]
        if numbers:
            yield from chosen(numbers, back, vector, [gaps(span, counts), *counts[:4]])

    def gaps(span: list[int | None], counts: list[int]) -> int:
        return span[1] - span[0] + 1 - counts[4] if span[0] is not None else 0

    return _stream(light, schema, work)


#: What is reported of a conversation.
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass(frozen=True)
class Repair:
    """`turns`: conv_id, piece, place, edit (K, R or I), role, text, in the order of piece and place. `report`: conv_id, REPORT, audit."""

    turns: DataFrame
    report: DataFrame


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", params: TurnParams = TurnParams()) -> Repair:
    """The repaired turns and a report for every conversation that has a row."""
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    parts = common.write_shared(_pieces(rows, params))
    heads = parts.where("pos = 0")
    picked = common.write_shared(heads.select("conv", "piece", "audits").join(_merged(heads), "piece").select("conv", "piece", F.element_at("audits", (F.col("cell") + 1).cast("int")).alias("audit"), "tail", (F.col("cell") / 4).cast("long").alias("entry"), *REPORT))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.concat("audit", F.expr("repeat('I', CAST(tail AS INT))")).alias("audit")))), lambda x: x["audit"]), "")
    report = picked.groupBy("conv").agg(*(F.max(c).alias(c) for c in REPORT), whole.alias("audit")).withColumnRenamed("conv", conv_id)
    return Repair(_applied(parts.where("pos > 0"), picked).withColumnRenamed("conv", conv_id), report)


def _applied(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of each piece behind its audit, as repaired turns."""
    conv = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv), T.StructField("piece", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    audits = picked.select("conv", "piece", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.concat("audit", F.expr("repeat('I', CAST(tail AS INT))")).alias("text"), "entry")
    both = rows.select("conv", "piece", "pos", "role", "text", F.lit(None).cast("long").alias("entry")).unionByName(audits).repartition("piece").sortWithinPartitions("piece", "pos")

    def work(found: Iterator[dict]) -> Iterator[dict]:
        conv = piece = audit = None
        at = place = state = 0

        def turn(edit: str, role: str, text: str) -> dict:
            nonlocal place, state
            place += 1
            state = NEXT[state][role[:1]]
            return {"conv": conv, "piece": piece, "place": place, "edit": edit, "role": role, "text": text}

        def inserted() -> Iterator[dict]:
            nonlocal at
            while audit is not None and at < len(audit) and audit[at] == "I":
                at += 1
                yield turn("I", ROLES[WANTED[state]], "")

        for r in found:
            if r["pos"] == 0:
                yield from inserted()
                conv, piece, audit, state, at, place = r["conv"], r["piece"], r["text"], r["entry"], 0, 0
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                yield turn(edit, r["role"] if edit == "K" else ROLES[WANTED[state]], r["text"])
        yield from inserted()

    return _stream(both, schema, work)


def digests(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """sha256 of each conversation's `role:text` lines. Such a hash is one sequence: a conversation passes one task, a batch at a time, and nothing of it is held."""
    schema = T.StructType([T.StructField(conv_id, turns.schema[conv_id].dataType), T.StructField("repaired_sha256", T.StringType())])
    dealt = turns.select(conv_id, "piece", "place", "role", "text").repartition(conv_id).sortWithinPartitions(conv_id, "piece", "place")

    def work(found: Iterator[dict]) -> Iterator[dict]:
        digest = conv = None
        for r in found:
            if digest is None or conv != r[conv_id]:
                if digest is not None:
                    yield {conv_id: conv, "repaired_sha256": digest.hexdigest()}
                digest, conv = hashlib.sha256(), r[conv_id]
            else:
                digest.update(b"\n")
            digest.update(f"{r['role']}:{r['text']}".encode())
        if digest is not None:
            yield {conv_id: conv, "repaired_sha256": digest.hexdigest()}

    return _stream(dealt, schema, work)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's crc32 asks for; nulls read as one space, but for the order of turns."""
    text_of: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    return (
        conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind != 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")
    )


def op11_turns(spark: SparkSession, sf_dir: str, params: TurnParams = TurnParams()) -> DataFrame:
    """Damages all conversations, repairs them, and reports every original conversation."""
    given = common.read_table(spark, sf_dir, "conversations")
    done = repair(damaged(given), params=params)
    parts = [given.select("conv_id").distinct(), done.report, digests(done.turns)]
    every = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return every.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in REPORT), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
