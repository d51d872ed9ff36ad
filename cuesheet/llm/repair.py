"""Conversation structure repair: run-length dynamic programming over turns.

A turn becomes a symbol: the initial of its role and its fault. Equal symbols
that follow each other are a run. A symbol is a min-plus matrix over the states
of the pattern `(s?(ua)+)?`, a run the power of its matrix, taken through
cached binary powers. Costs flow back from the end of a conversation, then the
choices are unrolled from its start.

1. Identical rows are counted as one; the first turn of every (role, text)
   tells the duplicates. All rows are sorted by conversation and turn over
   ranges, so a conversation with many rows spreads over tasks, and cut into
   pieces of bounded size, one row each: runs, items, the product of matrices.
2. A conversation of one piece is repaired in place. For the others one small
   row per piece travels: costs back through the pieces, states forth.
3. The texts of such a conversation pass its digest in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import written
from cuesheet.operators.lookup import lookup

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
# What may be written next from each state other than a kept system turn.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": 0, "u": 1, "a": 2}
_GONE = 8  # blank or duplicate; else 2 * (0 s, 1 u, 2 a, 3 other) + truncated
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {"su", "ua", "au"}
# A piece of a conversation holds about so many rows and characters.
PIECE_ROWS, PIECE_CHARS = 8_192, 1 << 20

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


# --- the transitions --------------------------------------------------------


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_FAR, *(r[k] + b[k][j] for k in range(4))) for j in range(4)) for r in a)


def _onto(a: Matrix, v: Vector) -> Vector:
    return tuple(min(r[k] + v[k] for k in range(4)) for r in a)


IDENTITY: Matrix = tuple(tuple(0 if i == j else _FAR for j in range(4)) for i in range(4))


def _kept(state: int, symbol: int) -> int | None:
    """The state after the turn is kept, if the pattern lets it stand here."""
    role = symbol >> 1
    if symbol == _GONE or role == 3:
        return None
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return None if state == USER else USER
    return ASSISTANT if state == USER else None


@lru_cache(maxsize=None)
def transition(symbol: int) -> Matrix:
    """Costs from state to state over one turn, turns inserted before it included."""
    inserts = IDENTITY
    step = tuple(
        tuple(min(0 if i == j else _FAR, INSERT if _NEXT[i] == j else _FAR) for j in range(4)) for i in range(4)
    )
    for _ in range(3):
        inserts = _times(inserts, step)
    rows = []
    for state in range(4):
        row = [_FAR] * 4
        row[state] = DELETE
        if symbol != _GONE:
            late = TRUNCATED * (symbol & 1)
            row[_NEXT[state]] = min(row[_NEXT[state]], REROLE + late)
            kept = _kept(state, symbol)
            if kept is not None:
                row[kept] = min(row[kept], KEEP + late)
        rows.append(tuple(row))
    return _times(inserts, tuple(rows))


@lru_cache(maxsize=None)
def _power(symbol: int, bit: int) -> Matrix:
    """The matrix of 2^bit turns of one symbol."""
    return transition(symbol) if not bit else _times(_power(symbol, bit - 1), _power(symbol, bit - 1))


@lru_cache(maxsize=1 << 16)
def run_matrix(symbol: int, length: int) -> Matrix:
    """The matrix of a run, from the powers of its length's bits."""
    out = IDENTITY
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            out = _times(out, _power(symbol, bit))
    return out


def _levelled(v: Vector) -> tuple[Vector, int]:
    low = min(v)
    return tuple(x - low for x in v), low


@lru_cache(maxsize=1 << 16)
def _before(symbol: int, length: int, after: Vector) -> tuple[Vector, int]:
    """Costs to go before a run, less the smallest, and that."""
    return _levelled(_onto(run_matrix(symbol, length), after))


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to and with one turn, given the
    costs to go after it, and the state they lead to."""
    edits = ""
    while True:
        go = _onto(transition(symbol), after)[state]
        if DELETE + after[state] == go:
            return edits + "D", state
        if INSERT + _onto(transition(symbol), after)[_NEXT[state]] == go:
            edits, state = edits + "I", _NEXT[state]
            continue
        late = TRUNCATED * (symbol & 1)
        kept = _kept(state, symbol)
        if kept is not None and KEEP + late + after[kept] == go:
            return edits + "K", kept
        return edits + "R", _NEXT[state]


def unrolled(runs: list[tuple[int, int]], after: Vector, state: int) -> tuple[list[str], int, Vector]:
    """Edits of every run, the state after them and the costs to go before them.

    Costs flow back run by run; then each run is unrolled turn by turn, its own
    costs found again. Turns that must go are deleted at once: to delete first
    is never dearer, and `D` sorts before all other edits."""
    after, base = _levelled(after)
    ends = []
    for symbol, length in reversed(runs):
        ends.append(after)
        after, low = _before(symbol, length, after)
        base += low
    out = []
    for (symbol, length), end in zip(runs, reversed(ends)):
        if symbol == _GONE:
            out.append("D" * length)
            continue
        to_go = [end]
        for _ in range(length - 1):
            to_go.append(_before(symbol, 1, to_go[-1])[0])
        edits = []
        for v in reversed(to_go):
            edit, state = _choice(symbol, state, v)
            edits.append(edit)
        out.append("".join(edits))
    return out, state, tuple(x + base for x in after)


def closing(state: int) -> str:
    """The edits that end a conversation in `state`."""
    return "I" * (_END[state] // INSERT)


def repaired(
    runs: list[tuple[int, int]], edits: list[str], roles: list[str], texts: list[str], state: int, last: bool
) -> Iterator[str]:
    """`role:text` of every turn after the edits; `roles` and `texts` are of the
    turns that need not go, in order."""
    turn = 0
    for (symbol, _), own in zip(runs, edits):
        if symbol == _GONE:
            continue
        for edit in own:
            if edit == "I":
                state = _NEXT[state]
                yield f"{_NAMES[state]}:"
                continue
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[turn][0]]
                yield f"{roles[turn]}:{texts[turn]}"
            elif edit == "R":
                state = _NEXT[state]
                yield f"{_NAMES[state]}:{texts[turn]}"
            turn += 1
    if last:
        for _ in closing(state):
            state = _NEXT[state]
            yield f"{_NAMES[state]}:"


# --- rows to pieces ---------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of (conv_id, turn, role, text) rows
    after the damage that the checksum of `conv_id:turn` chooses; a null role,
    text or part of the checksum is one space. A dropped row keeps its
    conversation, without copies."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    dropped = kind == 0
    return rows.select(
        "conv_id",
        F.when(~dropped, F.col("turn").cast("long")).alias("turn"),
        F.when(dropped, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "")
        .when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    space = F.lit(" ")
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        F.lit(1).cast("long").alias("copies"),
    )


def _content(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _told(rows: DataFrame) -> DataFrame:
    """One row per distinct row, with its copies and `fault` of the first of
    them: 0 none, 1 truncated, 2 duplicate, 3 blank."""
    same = ["conv_id", "turn", "role", "text"]
    single = rows.groupBy(*same).agg(F.sum("copies").alias("copies"))
    named = single.withColumn("said", F.struct("conv_id", _content(F.col("role"), F.col("text")).alias("of")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    solid = rows.where(F.col("copies") > 0).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # Only what is said at several turns has duplicates to tell.
    first = (
        solid.select(
            F.struct("conv_id", _content(F.col("role"), F.col("text")).alias("of")).alias("said"),
            order.alias("order"),
        )
        .groupBy("said")
        .agg(F.min("order").alias("first"), F.max("order").alias("last"))
        .where("first <> last")
        .select("said", "first")
    )
    row_id = F.xxhash64(*[F.col(c) for c in same])
    found = lookup(named.withColumn("row", row_id), first, "said", "row")
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(tail == "", 3)
        .when(F.col("first").isNotNull() & (F.col("first") < order), 2)
        .when(~tail.isin(".", "!", "?"), 1)
        .otherwise(0)
    )
    return found.select(*same, "copies", fault.alias("fault"))


_PIECE = (
    "conv_id {key}, part int, piece long, symbols array<int>, lengths array<long>, roles array<string>, "
    "texts array<string>, matrix array<long>, first_role string, last_role string, first_turn long, "
    "last_turn long, turns long, rows long, blank long, duplicate long, truncated long, illegal long"
)
_SUMMARY = (
    "first_role", "last_role", "first_turn", "last_turn", "turns", "rows", "blank", "duplicate", "truncated", "illegal"
)


class _Piece:
    """Rows of one conversation that follow each other, summed up."""

    def __init__(self, key: object):
        self.key, self.runs, self.roles, self.texts = key, [], [], []
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.turns = self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.items = self.chars = 0

    def _run(self, symbol: int, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            length += self.runs.pop()[1]
        self.runs.append((symbol, length))

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.rows:
            self.illegal += self.last_role + initial not in _LEGAL
        else:
            self.first_role = initial
        self.illegal += copies - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        self.rows += copies
        if fault == 3:
            self.blank += copies
            self._run(_GONE, copies)
        elif fault == 2:
            self.duplicate += copies
            self._run(_GONE, copies)
        else:
            self.truncated += fault
            self._run(2 * _INITIALS.get(initial, 3) + fault, 1)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
            if copies > 1:
                self.duplicate += copies - 1
                self._run(_GONE, copies - 1)
        self.items += 1

    def row(self, part: int, number: int) -> dict:
        matrix = IDENTITY
        for symbol, length in self.runs:
            matrix = _times(matrix, run_matrix(symbol, length))
        return {
            "conv_id": self.key,
            "part": part,
            "piece": number,
            "symbols": [s for s, _ in self.runs],
            "lengths": [n for _, n in self.runs],
            "roles": self.roles,
            "texts": self.texts,
            "matrix": [x for r in matrix for x in r],
        } | {name: getattr(self, name) for name in _SUMMARY}


def _pieces(told: DataFrame, piece_rows: int) -> DataFrame:
    """The rows in order, cut into pieces; (part, piece) orders those of a
    conversation, whose key keeps its type."""
    key = told.schema["conv_id"].dataType.simpleString()
    prefix = F.substring("text", 1, 64)
    parts = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = told.repartitionByRange(parts, "conv_id", "turn", "role", prefix).sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )
    numbered = ordered.select("conv_id", "turn", "role", "text", "copies", "fault", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, done, held = None, 0, [], 0
        part = 0
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *_ARROW])
            for key, turn, role, text, copies, fault, part in zip(*(c.to_pylist() for c in batch.columns)):
                full = piece is not None and (piece.items >= piece_rows or piece.chars >= PIECE_CHARS)
                if piece is None or full or piece.key != key:
                    if piece is not None:
                        done.append(piece.row(part, number))
                        held += piece.chars + 64
                        number += 1
                    piece = _Piece(key)
                piece.add(turn, role, text, copies, fault)
                if held > PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, held = [], 0
        if piece is not None:
            done.append(piece.row(part, number))
            yield pa.RecordBatch.from_pylist(done, schema)

    return numbered.mapInArrow(run, _PIECE.format(key=key))


_LISTS = {"symbols": pa.int32(), "lengths": pa.int64(), "roles": pa.string(), "texts": pa.string(), "matrix": pa.int64()}
_ARROW = [
    pa.field("part", pa.int32()),
    pa.field("piece", pa.int64()),
    *[pa.field(name, pa.list_(kind)) for name, kind in _LISTS.items()],
    *[pa.field(name, pa.string() if name.endswith("role") else pa.int64()) for name in _SUMMARY],
]


# --- pieces to conversations ------------------------------------------------

_RESULT = (
    "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_RESULT_ARROW = [
    *[pa.field(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    pa.field("audit", pa.string()),
    pa.field("repaired_sha256", pa.string()),
]


class _Total:
    """Counts of a conversation over its pieces, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.role: str | None = None

    def add(self, row: dict) -> None:
        if not row["rows"]:
            return
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + row[name])
        if self.role is not None:
            self.illegal += self.role + row["first_role"] not in _LEGAL
        self.role = row["last_role"]
        if row["turns"]:
            self.turns += row["turns"] - (row["first_turn"] == self.last)
            self.first = row["first_turn"] if self.first is None else self.first
            self.last = row["last_turn"]

    def counts(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "gaps": min(gaps, (1 << 63) - 1),
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
        }


def _whole(pieces: DataFrame, key: str) -> DataFrame:
    """The results of conversations that are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                total = _Total()
                total.add(row)
                runs = list(zip(row["symbols"], row["lengths"]))
                edits, state, before = unrolled(runs, _END, START)
                said = "\n".join(repaired(runs, edits, row["roles"], row["texts"], START, True))
                out.append(
                    {"conv_id": row["conv_id"]}
                    | total.counts()
                    | {
                        "cost": before[START],
                        "audit": "".join(edits) + closing(state),
                        "repaired_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    }
                )
            schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *_RESULT_ARROW])
            yield pa.RecordBatch.from_pylist(out, schema)

    return pieces.mapInArrow(run, _RESULT.format(key=key))


def _in_order(pieces: DataFrame, backwards: bool = False) -> DataFrame:
    """Every conversation's pieces in one task, in order, as a stream."""
    way = [F.col(c).desc() if backwards else F.col(c) for c in ("part", "piece")]
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", *way)


def _to_go(pieces: DataFrame, key: str) -> DataFrame:
    """(conv_id, part, piece, after): the costs to go after every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []
        for batch in batches:
            after = []
            for conv, matrix in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist()):
                if not current or current[0] != conv:
                    current = [conv, _END]
                after.append(current[1])
                rows = tuple(tuple(matrix[i : i + 4]) for i in range(0, 16, 4))
                current[1] = _onto(rows, current[1])
            columns = [batch.column(c) for c in ("conv_id", "part", "piece")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(after, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "after"]
            )

    small = pieces.select("conv_id", "part", "piece", "matrix")
    return _in_order(small, backwards=True).mapInArrow(
        run, f"conv_id {key}, part int, piece long, after array<long>"
    )


def _ways(pieces: DataFrame, key: str) -> DataFrame:
    """(conv_id, part, piece, after, ways): the state after a piece by that before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = []
            for symbols, lengths, after in zip(*(batch.column(c).to_pylist() for c in ("symbols", "lengths", "after"))):
                runs = list(zip(symbols, lengths))
                ways.append([unrolled(runs, tuple(after), state)[1] for state in range(4)])
            columns = [batch.column(c) for c in ("conv_id", "part", "piece", "after")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ways, pa.list_(pa.int32()))], names=["conv_id", "part", "piece", "after", "ways"]
            )

    small = pieces.select("conv_id", "part", "piece", "symbols", "lengths", "after")
    return small.mapInArrow(run, f"conv_id {key}, part int, piece long, after array<long>, ways array<int>")


def _states(ways: DataFrame, key: str) -> DataFrame:
    """(conv_id, part, piece, after, state): the state before every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []
        for batch in batches:
            states = []
            for conv, way in zip(batch.column("conv_id").to_pylist(), batch.column("ways").to_pylist()):
                if not current or current[0] != conv:
                    current = [conv, START]
                states.append(current[1])
                current[1] = way[current[1]]
            columns = [batch.column(c) for c in ("conv_id", "part", "piece", "after")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(states, pa.int32())], names=["conv_id", "part", "piece", "after", "state"]
            )

    return _in_order(ways).mapInArrow(run, f"conv_id {key}, part int, piece long, after array<long>, state int")


def _joined(pieces: DataFrame, key: str) -> DataFrame:
    """The results of conversations of several pieces with `after` and `state`:
    audits and digests grow piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = total = digest = last = None
        audit: list[str] = []
        started = False
        schema = None

        def finished() -> pa.RecordBatch:
            rest = list(repaired([], [], [], [], last, True))
            if rest:
                digest.update((("\n" if started else "") + "\n".join(rest)).encode())
            row = {"conv_id": conv[0]} | total.counts()
            row |= {"cost": conv[1], "audit": "".join(audit) + closing(last)}
            return pa.RecordBatch.from_pylist([row | {"repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *_RESULT_ARROW])
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                runs = list(zip(row["symbols"], row["lengths"]))
                edits, state, before = unrolled(runs, tuple(row["after"]), row["state"])
                if conv is None or conv[0] != row["conv_id"]:
                    if conv is not None:
                        yield finished()
                    conv, total, digest = (row["conv_id"], before[START]), _Total(), hashlib.sha256()
                    audit, started = [], False
                total.add(row)
                audit.extend(edits)
                for said in repaired(runs, edits, row["roles"], row["texts"], row["state"], False):
                    digest.update((("\n" if started else "") + said).encode())
                    started = True
                last = state
        if conv is not None:
            yield finished()

    return _in_order(pieces).mapInArrow(run, _RESULT.format(key=key))


def repair_conversations(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies) rows, as
    `damaged` or `undamaged` make them: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (null first), role and text. A row's fault is blank
    (no character but white space), else duplicate (role and text were there
    before), else truncated (the last such character is not one of `.!?`). The
    audit is the cheapest edits that give role initials `(s?(ua)+)?`, the
    ASCII-least of equal ones: K keep, R other role, D delete, I insert.

    A null conversation is one of its own. A conversation without rows gives
    zeros, an empty audit and the digest of nothing; an empty table gives no
    rows; texts of any length are read whole, other columns ignored.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    pieces = written(_pieces(_told(turns), piece_rows), "pieces")
    known = F.struct("conv_id").alias("conv")
    counts = pieces.groupBy(known).agg(F.count("*").alias("n")).where("n > 1").select("conv")
    marked = pieces.withColumn("conv", F.struct("conv_id"))
    single = marked.join(counts, "conv", "left_anti").drop("conv")
    several = marked.join(counts, "conv", "left_semi").drop("conv")
    to_go = _to_go(several, key)
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("conv_id", "part", "piece")]
    steps = pieces.alias("p").join(to_go.alias("q"), on).select("p.conv_id", "p.part", "p.piece", "symbols", "lengths", "after")
    states = written(_states(_ways(steps, key), key), "states")
    placed = pieces.alias("p").join(states.alias("q"), on).select("p.*", "after", "state")
    return _whole(single, key).unionByName(_joined(placed, key))
