"""Conversation structure repair: the cheapest edits that turn a conversation's roles into `(s?(ua)+)?`.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4); Insert (3) puts an empty user or assistant turn in
anywhere. A row without visible text and a row whose role and text came before must be deleted; a truncated row that stays
costs 3 more. The grammar has four states (start, after s, after u, after a), so what can be reached is a bitset of four
bits for each turn. Cost layers grow from the end of the conversation: layer c has, for each turn, the states from which the
rest can be repaired at cost c and at no less; the first layer with the start state at the first turn tells the cost. The
trace walks forward through the layers and takes at each step the edit of least letter whose target lies in the layer
that its cost leads to, so its letters are the ASCII-least of all cheapest repairs. As D sorts first, rows that must go are
runs of D that no state depends on, and a state leaves no choice of the role to insert.

Rows are dealt by ranges of (conv_id, turn, role, digest of text), so a conversation of any length is cut into pieces of at
most PIECE rows (equal rows count as one with a number). A conversation of one piece is solved in its task. Of a longer one,
each piece gives the costs between its entry and exit states; one fold backward over these small tables gives each piece the
costs to go at its end, each piece is traced from all four entry states, and a fold forward picks one of the four. Texts are
shuffled once, for the SHA-256 of each repaired conversation, which is sequential by definition: a task streams a
conversation's rows in order and holds none of them.

Defined cases: null roles and texts are one space, as are null ids and turns where a row is drawn for damage; null turns
come first, rows of one turn go by role, then by the MD5 of their text; a null conv_id is a conversation; roles other than
system, user and assistant can't be kept; repeated rows are duplicates; other columns, whatever their names, are not looked
at; very long texts are only hashed; a conversation without rows has cost 0, an empty audit and the hash of nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import map_batches, materialise

PIECE = 4096
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPTING = (START, AFTER_A)
FAR = 1 << 62
#: Where Keep leads, by the row's role and the state; and where a row or insert of the fitting role leads.
KEEPS = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
FITS = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
_LETTERS = "?sua"


def _sources(step: dict[int, int]) -> list[int]:
    """Of each bitset of targets, the bitset of states that lead there."""
    return [sum(1 << s for s, t in step.items() if targets >> t & 1) for targets in range(16)]


_BEFORE_KEEP = [_sources(KEEPS.get(x, {})) for x in _LETTERS]
_BEFORE_FIT = _sources(FITS)


def cost_layers(codes: bytes, ends: list[int], last: bool) -> list[list[int]]:
    """For each turn and state the least cost to go, found layer by layer; `ends` are those after the last row. Codes: the
    role's place among the letters, 4 more if truncated. Only the last piece inserts after its last row."""
    m = len(codes)
    togo, seen = [[FAR] * 4 for _ in range(m + 1)], [0] * (m + 1)
    layers: dict[int, dict[int, int]] = {}
    for s, c in enumerate(ends):
        if c < FAR:
            at = layers.setdefault(c, {})
            at[m] = at.get(m, 0) | 1 << s
    while layers:
        c = min(layers)
        layer = layers.pop(c)
        turns = sorted(layer)
        while turns:
            i = turns.pop()
            new = layer[i] & ~seen[i]
            if not new:
                continue
            seen[i] |= new
            for s in range(4):
                if new >> s & 1:
                    togo[i][s] = c
            reached = [(c + INSERT, i, _BEFORE_FIT[new])] if i < m or last else []
            if i:
                code = codes[i - 1]
                more = TRUNCATED if code & 4 else 0
                reached += [(c + more, i - 1, _BEFORE_KEEP[code & 3][new]), (c + REROLE + more, i - 1, _BEFORE_FIT[new]), (c + DELETE, i - 1, new)]
            for cost, j, states in reached:
                if states & ~seen[j]:
                    if cost == c:  # Keep: the same layer, one turn earlier
                        if turns[-1:] != [j]:
                            turns.append(j)
                        layer[j] = layer.get(j, 0) | states
                    else:
                        at = layers.setdefault(cost, {})
                        at[j] = at.get(j, 0) | states
    return togo


def trace(codes: bytes, gone: np.ndarray, togo: list[list[int]], state: int, last: bool) -> tuple[str | None, int]:
    """The least letters from this entry state, and the state at the end; none if no repair begins there. gone: how many
    rows before each row, and at the end, must be deleted."""
    if togo[0][state] >= FAR:
        return None, state
    out, i = ["D" * int(gone[0])], 0
    while True:
        left = togo[i][state]
        if i == len(codes) and (not last or left == 0):
            return "".join(out), state
        step = None
        if i < len(codes):
            code = codes[i]
            more, kept = TRUNCATED if code & 4 else 0, KEEPS.get(_LETTERS[code & 3], {}).get(state)
            if left == DELETE + togo[i + 1][state]:
                step = "D", state
            elif left == INSERT + togo[i][FITS[state]]:
                pass
            elif kept is not None and left == more + togo[i + 1][kept]:
                step = "K", kept
            else:
                step = "R", FITS[state]
        if step is None:
            out.append("I")
            state = FITS[state]
        else:
            i += 1
            state = step[1]
            out.append(step[0] + "D" * int(gone[i]))


def repair(codes: bytes, gone: np.ndarray) -> tuple[int, str]:
    """Cost of the edits of rows that may stay, and the letters of all, of a whole conversation."""
    togo = cost_layers(codes, [0 if s in ACCEPTING else FAR for s in range(4)], True)
    return togo[0][START], trace(codes, gone, togo, START, True)[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after each row's damage, drawn by the crc32 of `conv_id:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space("text"), r"[.!?]", "")).otherwise(space("text"))
    copies = F.explode(F.when(draw == 0, F.array().cast("array<int>")).when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def turns(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: conv_id, turn, role, digest, copies, blank, truncated, again (role and text came at
    an earlier turn)."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("truncated"))
    own = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    own = own.withColumn("when", F.struct(F.col("turn").isNotNull(), "turn"))
    first = own.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("when").alias("first"))
    joined = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    return joined.withColumn("again", ~F.col("when").eqNullSafe(F.col("first"))).drop("c", "r", "d", "first", "when")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], fields: dict[str, pa.DataType], most: int = 256) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(fields.items()))
    while part := list(islice(rows, most)):
        yield _batch(part, schema)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


_LONGS = ("rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns", "low", "high")


def pieces_of(kind: pa.DataType, most: int):
    """Rows sorted by (conv_id, turn, role, digest) to pieces; each is also solved as if it were a whole conversation."""
    fields = {"conv_id": kind, "piece": pa.int64(), "codes": pa.binary(), "gone": pa.binary(), "first": pa.string(), "last": pa.string(), **{c: pa.int64() for c in _LONGS}, "cost": pa.int64(), "audit": pa.string()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number, at, part = TaskContext.get().partitionId() << 32, None, []
        for conv, *row in _rows(batches, "conv_id", "turn", "role", "copies", "blank", "truncated", "again"):
            if part and (conv != at or len(part) >= most):
                yield piece(at, number, part)
                number, part = number + 1, []
            at = conv
            part.append(row)
        if part:
            yield piece(at, number, part)

    def piece(conv, number: int, part: list) -> tuple:
        codes, gone, initial = bytearray(), [0], None
        blank = duplicate = truncated = illegal = total = distinct = 0
        seen_turn = low = high = None
        for turn, role, copies, is_blank, is_cut, again in part:
            letter = role[:1]
            illegal += (initial is not None and initial + letter not in ("su", "ua", "au")) + copies - 1
            initial, total = letter, total + copies
            if turn is not None:
                distinct += turn != seen_turn
                seen_turn, low, high = turn, turn if low is None else low, turn
            if is_blank or again:
                gone[-1] += copies
                blank, duplicate = blank + copies * is_blank, duplicate + copies * (not is_blank)
                continue
            codes.append(max(0, _LETTERS.find(letter) if letter else 0) | 4 * is_cut)
            gone.append(copies - 1)
            truncated, duplicate = truncated + is_cut, duplicate + copies - 1
        gone = np.array(gone, np.int64)
        cost, audit = repair(bytes(codes), gone)
        return conv, number, bytes(codes), gone.tobytes(), part[0][1][:1], initial, total, blank, duplicate, truncated, illegal, distinct, low, high, cost, audit

    return lambda batches: _in_batches(pieces(batches), fields)


def _codes(codes: bytes, gone: bytes) -> tuple[bytes, np.ndarray]:
    return codes, np.frombuffer(gone, np.int64)


def passage_costs(kind: pa.DataType):
    """costs: of each entry state and exit state (16 numbers) the cost of a piece; those to the end where it is the last."""

    def rows(batches):
        for conv, piece, codes, is_last in _rows(batches, "conv_id", "piece", "codes", "is_last"):
            if is_last:
                to_end = cost_layers(codes, [0 if s in ACCEPTING else FAR for s in range(4)], True)[0]
                yield conv, piece, True, to_end
            else:
                by_exit = [cost_layers(codes, [0 if s == t else FAR for s in range(4)], False)[0] for t in range(4)]
                yield conv, piece, False, [by_exit[t][s] for s in range(4) for t in range(4)]

    return lambda batches: _in_batches(rows(batches), {"conv_id": kind, "piece": pa.int64(), "is_last": pa.bool_(), "costs": pa.list_(pa.int64())})


def costs_to_go(kind: pa.DataType):
    """Backward over a conversation's pieces: ends, the costs to go at the end of each; holds four numbers."""

    def rows(batches):
        ends: list[int] = []
        for conv, piece, is_last, costs in _rows(batches, "conv_id", "piece", "is_last", "costs"):
            own = ends
            ends = costs if is_last else [min(min(FAR, costs[4 * s + t] + own[t]) for t in range(4)) for s in range(4)]
            yield conv, piece, [0 if s in ACCEPTING else FAR for s in range(4)] if is_last else own, ends[START]

    return lambda batches: _in_batches(rows(batches), {"conv_id": kind, "piece": pa.int64(), "ends": pa.list_(pa.int64()), "to_go": pa.int64()})


def four_traces(kind: pa.DataType):
    """audits and exits: of each entry state the trace through a piece and the state after it."""

    def rows(batches):
        for conv, piece, codes, gone, is_last, ends, to_go in _rows(batches, "conv_id", "piece", "codes", "gone", "is_last", "ends", "to_go"):
            codes, gone = _codes(codes, gone)
            togo = cost_layers(codes, ends, is_last)
            both = [trace(codes, gone, togo, s, is_last) for s in range(4)]
            yield conv, piece, [x[0] for x in both], [x[1] for x in both], to_go

    return lambda batches: _in_batches(rows(batches), {"conv_id": kind, "piece": pa.int64(), "audits": pa.list_(pa.string()), "exits": pa.list_(pa.int64()), "cost": pa.int64()})


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(kind: pa.DataType):
    """Rows sorted by (conv_id, kind, piece, turn, role, digest): the conversation (0), its pieces (1), its turns (2)."""

    class Conversation:
        def __init__(self, conv):
            self.conv, self.state, self.audit, self.sums, self.cost = conv, START, [], dict.fromkeys(_LONGS, 0), 0
            self.low = self.high = self.last = self.letters = None
            self.hash, self.any, self.at = hashlib.sha256(), False, START

        def add_piece(self, audits, exits, first, last, cost, own):
            self.cost = cost if self.last is None else self.cost
            self.audit.append(audits[self.state])
            self.state = exits[self.state]
            for name, x in own.items():
                self.sums[name] += x or 0
            if self.last is not None and self.last + first not in ("su", "ua", "au"):
                self.sums["illegal"] += 1
            self.last = last
            if own["low"] is not None:
                self.sums["distinct_turns"] -= own["low"] == self.high  # a turn that goes on from the piece before
                self.low, self.high = own["low"] if self.low is None else self.low, own["high"]

        def line(self, role: str, text: str) -> None:
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

        def inserts(self) -> str | None:
            """Applies the inserts that come next; the edit after them."""
            if self.letters is None:
                self.letters = iter("".join(self.audit))
            while (edit := next(self.letters, None)) == "I":
                self.at = FITS[self.at]
                self.line(ROLES[self.at], "")
            return edit

        def add_turn(self, role: str, text: str) -> None:
            edit = self.inserts()
            if edit == "K":
                self.at = KEEPS[role[:1]][self.at]
                self.line(role, text)
            elif edit == "R":
                self.at = FITS[self.at]
                self.line(ROLES[self.at], text)

        def close(self) -> tuple:
            self.inserts()
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["distinct_turns"]
            counts = (self.sums[x] for x in ("blank", "duplicate", "truncated", "illegal"))
            return self.conv, gaps, *counts, self.cost + DELETE * (self.sums["blank"] + self.sums["duplicate"]), "".join(self.audit), self.hash.hexdigest()

    def rows(batches):
        now = None
        for conv, kind_, audits, exits, first, last, cost, role, text, *own in _rows(batches, "conv_id", "kind", "audits", "exits", "first", "last", "cost", "role", "text", *_LONGS):
            if now is None or now.conv != conv:
                if now is not None:
                    yield now.close()
                now = Conversation(conv)
            if kind_ == 1:
                now.add_piece(audits, exits, first, last, cost, dict(zip(_LONGS, own, strict=True)))
            elif kind_ == 2:
                now.add_turn(role, text)
        if now is not None:
            yield now.close()

    return lambda batches: _in_batches(rows(batches), {"conv_id": kind, **dict.fromkeys(_RESULT, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()})


def _schema(id_type: str, **columns: str) -> str:
    return ", ".join(f"`{k}` {v}" for k, v in {"conv_id": id_type, **columns}.items())


def repair_rows(rows: DataFrame, ids: DataFrame, most: int = PIECE) -> DataFrame:
    """One row for each conv_id of `ids`: what is wrong with its `rows` (conv_id, turn, role, text), the least cost of a
    repair, its edits' letters and the SHA-256 of the repaired `role:text` lines."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    kind = pa.schema(rows.sparkSession.createDataFrame([], rows.select("conv_id").schema).toArrow().schema).field("conv_id").type
    order = ["conv_id", "turn", "role", "digest"]
    longs = dict.fromkeys(_LONGS, "long")
    cut = turns(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = materialise(map_batches(cut, pieces_of(kind, most), _schema(id_type, piece="long", codes="binary", gone="binary", first="string", last="string", **longs, cost="long", audit="string")), "pieces")

    many = pieces.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("pieces"), F.max("piece").alias("last_piece")).where("pieces > 1")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    parts = materialise(pieces.join(many, same).withColumn("is_last", F.col("piece") == F.col("last_piece")).select("conv_id", "piece", "codes", "gone", "is_last"), "parts")
    costs = map_batches(parts, passage_costs(kind), _schema(id_type, piece="long", is_last="boolean", costs="array<long>"))
    costs = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    ends = materialise(map_batches(costs, costs_to_go(kind), _schema(id_type, piece="long", ends="array<long>", to_go="long")), "ends")
    traced = map_batches(parts.join(ends.drop("conv_id"), "piece"), four_traces(kind), _schema(id_type, piece="long", audits="array<string>", exits="array<long>", cost="long"))

    alone = pieces.join(many, same, "left_anti").select("conv_id", "piece", F.array("audit").alias("audits"), F.array(F.lit(0).cast("long")).alias("exits"), "first", "last", "cost", *_LONGS)
    traced = traced.join(pieces.select("piece", "first", "last", *_LONGS), "piece").select(*alone.columns)
    stream = alone.unionByName(traced).withColumn("kind", F.lit(1))
    stream = stream.unionByName(ids.select("conv_id").distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.unionByName(rows.select("conv_id", "turn", "role", "text", _digest("text").alias("digest"), F.lit(2).alias("kind")), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "piece", "turn", "role", "digest")
    return map_batches(stream, repaired(kind), _schema(id_type, **dict.fromkeys(_RESULT, "long"), audit="string", repaired_sha256="string"))


def repair_damaged(conversations: DataFrame, most: int = PIECE) -> DataFrame:
    """The contract's result: conversations damaged by the draw of their rows, then repaired."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    return repair_rows(damaged(conversations), conversations, most)
