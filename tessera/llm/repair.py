"""Repair of the structure of conversations by survivor-coalescence Viterbi.

A conversation is its rows by turn (nulls first). A repaired one has the role
initials ``(s?(ua)+)?``: perhaps a system message, then users and assistants in
turn. Edits of a row and their costs: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only one for blank and duplicate rows); an empty user or
assistant message can be Inserted anywhere for 2; a truncated row that is not
deleted adds 1. The cheapest edits win, among equals those whose initials come
first in ASCII.

Method. The states are what was written so far: nothing, a system message, a
last user, a last assistant. A state's survivor is the cheapest way to it; the
survivors are leaves of one tree of back pointers, in which a node lives as
long as something refers to it (its children, a survivor). Once the root has a
single child and is no survivor itself, all survivors agree on that edit: it
is emitted and forgotten, so a task remembers the undecided end only, however
long a conversation is. Equal costs are settled by the complete undecided ends
up to the common ancestor. A state that costs more than another by more than
the dearest detour from that one is dropped (``DETOUR``).

Spread. Rows are sorted by range of (conversation, turn, role, text digest),
so a long conversation covers several tasks. A task finishes the conversations
that begin and end inside it and writes of the others what it cannot decide:
their rows, and for each state before and after them the cost and the edits.
One narrow row per task and pair of states is then chained by the same
survivor tree, and the chosen edits go back to the undecided rows, again by
task. Equal rows (same turn, role and text) are counted before the shuffle and
travel once; the first row of a text in its conversation is found by a
map-side aggregation and marked by a narrow row that sorts next to it.

``summary`` reads the edits of a conversation in order in one task, because
sha256 is sequential; it holds one conversation's audit, not its texts.

Defined results: a null role or text is one space, so a null or empty text is
blank; rows of a null id are one conversation; equal turns go by role, then by
md5 of the text; every repeated row after the first is a duplicate; a role of
another initial is never kept as it is; a very long text is one row, read once;
an empty table gives an empty result; other columns are dropped, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)  # after a rerole or an insertion
NAMES = {USER: "user", ASSISTANT: "assistant"}
# DETOUR[x][y]: what it costs at most to go on from y as if from x. From USER an
# assistant is inserted; towards a state before a system message that message is
# deleted; from SYSTEM an end without messages needs two insertions.
DETOUR = ((0, 4, 5, 3), (0, 0, 2, 0), (2, 2, 0, 2), (0, 4, 2, 0))
BATCH = 1000


class Node:
    """One decision: edits (usually one letter) after those of ``parent``.
    ``children`` and ``held`` are what refers to it."""

    __slots__ = ("parent", "edits", "depth", "children", "held", "tag")

    def __init__(self, parent: Node | None, edits: str, tag=None):
        self.parent, self.edits, self.tag = parent, edits, tag
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.held = False


def comes_first(x: Node, y: Node) -> bool:
    """Whether the edits to x are smaller than those to y, compared from their
    common ancestor on."""
    xs, ys = [], []
    while x is not y:
        if x.depth >= y.depth:
            xs.append(x.edits)
            x = x.parent
        else:
            ys.append(y.edits)
            y = y.parent
    return "".join(reversed(xs)) < "".join(reversed(ys))


class Survivors:
    """The cheapest way to each state. ``decided`` gets the nodes on which all
    survivors agree, in order."""

    def __init__(self, entry: int, decided: Callable[[Node], None], insert: bool = True):
        self.root = Node(None, "")
        self.decided, self.insert = decided, insert
        self.best: dict[int, tuple[int, Node]] = {}
        self._settle({entry: (0, self.root)})

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node]], state: int, cost: int, node: Node) -> None:
        old = best.get(state)
        if old is None or cost < old[0] or cost == old[0] and comes_first(node, old[1]):
            best[state] = (cost, node)

    def row(self, initial: str, deleted: bool, truncated: bool, copies: int = 1) -> None:
        """Take a row; ``copies`` equal rows that must go count as one step."""
        best: dict[int, tuple[int, Node]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + 3 * copies, Node(node, "D" * copies))
            if not deleted:
                extra = cost + truncated
                if initial in KEEPS[state]:
                    self._offer(best, KEEPS[state][initial], extra, Node(node, "K"))
                self._offer(best, NEXT[state], extra + 2, Node(node, "R"))
        self._settle(best)

    def piece(self, ways: dict[tuple[int, int], tuple[int, str]], tag) -> None:
        """Take a piece of a conversation: (before, after) -> cost, edits,
        insertions included."""
        best: dict[int, tuple[int, Node]] = {}
        for (before, after), (cost, edits) in ways.items():
            if before in self.best:
                was, node = self.best[before]
                self._offer(best, after, was + cost, Node(node, edits, (before, tag)))
        self._settle(best)

    def _settle(self, best: dict[int, tuple[int, Node]]) -> None:
        if self.insert:
            for states, after in (((NOTHING, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
                for state in states:
                    if state in best:
                        cost, node = best[state]
                        self._offer(best, after, cost + 2, Node(node, "I"))
        kept = {x: b for x, b in best.items() if not any(b[0] > best[y][0] + DETOUR[x][y] for y in best)}
        before = [node for _, node in self.best.values()]
        self.best = kept
        for node in before:
            node.held = False
        for _, node in kept.values():
            node.held = True
            while node is not self.root and node not in node.parent.children:
                node.parent.children.append(node)
                node = node.parent
        for node in before:
            while node is not self.root and not node.held and not node.children:
                node.parent.children.remove(node)
                node = node.parent
        while not self.root.held and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.decided(self.root)

    def undecided(self, state: int) -> list[Node]:
        """The nodes from the root to a state's survivor."""
        node, path = self.best[state][1], []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def cheapest(self) -> int:
        """The final state of the cheapest, then smallest, edits; there always
        is one, as a cheaper state can reach it by insertions."""
        ends = [s for s in FINAL if s in self.best]
        costs = [self.best[s][0] for s in ends]
        if len(ends) == 2 and costs[0] == costs[1]:
            return ends[0] if comes_first(self.best[ends[0]][1], self.best[ends[1]][1]) else ends[1]
        return ends[costs.index(min(costs))]


class Editor:
    """Applies edits to the rows they are for, in order, from a state on."""

    def __init__(self, write: Callable[..., None], state: int = NOTHING, number: int = 0):
        self.rows: deque[list] = deque()  # turn, role, text, fault, copies
        self.write, self.state, self.number = write, state, number

    def apply(self, edits: str) -> None:
        for edit in edits:
            if edit == "I":
                self.state = NEXT[self.state]
                self._out("I", None, None, None, NAMES[self.state], "")
                continue
            row = self.rows[0]
            turn, role, text, fault, copies = row
            if copies == 1:
                self.rows.popleft()
            else:
                row[4] -= 1
            if edit == "D":
                self._out("D", turn, role, fault, None, None)
            elif edit == "K":
                self.state = KEEPS[self.state][role[:1]]
                self._out("K", turn, role, fault, role, text)
            else:
                self.state = NEXT[self.state]
                self._out("R", turn, role, fault, NAMES[self.state], text)

    def _out(self, *values) -> None:
        self.write(self.number, *values)
        self.number += 1


# What a task writes, in one table: its edits, the rows it could not decide,
# and the ways through them.
EDIT, OPEN, WAY = 0, 1, 2
_FIELDS = {
    "kind": pa.int32(), "conv_id": None, "part": pa.int64(), "seq": pa.int64(), "edit": pa.string(),
    "turn": None, "was_role": pa.string(), "fault": pa.string(), "role": pa.string(), "text": pa.string(),
    "copies": pa.int64(), "before": pa.int32(), "after": pa.int32(), "cost": pa.int64(),
    "state": pa.int32(),
}


class _Out:
    """Rows of the table above, gathered into batches."""

    def __init__(self, conv_kind: pa.DataType, turn_kind: pa.DataType):
        self.kinds = _FIELDS | {"conv_id": conv_kind, "turn": turn_kind}
        self.rows: list[dict] = []

    def add(self, **values) -> None:
        self.rows.append(values)

    def edits_of(self, conv_id, part: int) -> Callable[..., None]:
        def write(seq, edit, turn, was_role, fault, role, text):
            self.add(
                kind=EDIT, conv_id=conv_id, part=part, seq=seq, edit=edit, turn=turn, was_role=was_role, fault=fault,
                role=role, text=text,
            )

        return write

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while self.rows and len(self.rows) >= least:
            rows, self.rows = self.rows[:BATCH], self.rows[BATCH:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(c) for r in rows], t) for c, t in self.kinds.items()], names=list(self.kinds)
            )


class _Conversation:
    """The part of a conversation that a task sees."""

    def __init__(self, out: _Out, conv_id, part: int, begins: bool):
        self.out, self.id, self.part, self.begins = out, conv_id, part, begins
        self.seq = 0
        if begins:  # edits can be written as soon as they are decided
            self.editor = Editor(out.edits_of(conv_id, part))
            self.ways = {NOTHING: Survivors(NOTHING, lambda node: self.editor.apply(node.edits))}
        else:
            self.ends = {state: [] for state in range(4)}
            self.ways = {
                state: Survivors(state, lambda node, end=self.ends[state]: end.append(node.edits)) for state in range(4)
            }

    def row(self, turn, role: str, text: str, fault: str, copies: int) -> None:
        if self.begins:
            self.editor.rows.append([turn, role, text, fault, copies])
        else:
            self._open(turn, role, text, fault, copies)
        for survivors in self.ways.values():
            survivors.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated", copies)

    def _open(self, turn, role, text, fault, copies) -> None:
        self.out.add(
            kind=OPEN, conv_id=self.id, part=self.part, seq=self.seq, turn=turn, was_role=role, fault=fault, text=text,
            copies=copies,
        )
        self.seq += 1

    def close(self) -> None:
        """The conversation ends here."""
        (survivors,) = self.ways.values()
        for node in survivors.undecided(survivors.cheapest()):
            self.editor.apply(node.edits)

    def leave(self) -> None:
        """It may go on in the next task, or have begun in an earlier one."""
        state, number = (self.editor.state, self.editor.number) if self.begins else (None, 0)
        if self.begins:
            self.seq = number
            for row in self.editor.rows:
                self._open(*row)
        for before, survivors in self.ways.items():
            head = "" if self.begins else "".join(self.ends[before])
            for after, (cost, _) in survivors.best.items():
                edits = head + "".join(n.edits for n in survivors.undecided(after))
                self.out.add(
                    kind=WAY, conv_id=self.id, part=self.part, edit=edits, before=before, after=after, cost=cost,
                    seq=number, state=before if state is None else state,
                )


def _same(a, b) -> bool:
    return a == b and (a is None) == (b is None)


def _decide(batches: Iterator[pa.RecordBatch], conv_kind, turn_kind) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a task -> edits, undecided rows and ways."""
    out, part = _Out(conv_kind, turn_kind), TaskContext.get().partitionId()
    now, first_of, seen = None, None, False
    for batch in batches:
        for conv_id, turn, role, digest, mark, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or not _same(now.id, conv_id):
                if now is not None:
                    (now.close if now.begins else now.leave)()
                now = _Conversation(out, conv_id, part, begins=seen)
                seen = True
                first_of = None
            if mark == 0:  # the next row is the first of its text
                first_of = (turn, role, digest)
                continue
            is_first = first_of is not None and first_of == (turn, role, digest)
            solid = text.strip("\t\n\x0b\x0c\r ")
            fault = "blank" if not solid else "" if solid[-1] in ".!?" else "truncated"
            if not solid:
                now.row(turn, role, text, fault, copies)
            else:
                if is_first:
                    now.row(turn, role, text, fault, 1)
                    copies -= 1
                if copies:
                    now.row(turn, role, text, "duplicate", copies)
            yield from out.batches(BATCH)
    if now is not None:
        now.leave()
    yield from out.batches(0)


def _chain(batches: Iterator[pa.RecordBatch], conv_kind) -> Iterator[pa.RecordBatch]:
    """Sorted ways of a task -> the chosen edits of each piece (conv_id, part),
    with the state and the number that they start from."""
    done: list[tuple] = []
    kinds = {"conv_id": conv_kind, "part": pa.int64(), "state": pa.int32(), "number": pa.int64(), "edits": pa.string()}

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if done and len(done) >= least:
            columns = [pa.array(c, k) for c, k in zip(zip(*done), kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))
            done.clear()

    def end() -> None:
        survivors.piece(ways, starts)
        for node in survivors.undecided(survivors.cheapest()):
            survivors.decided(node)

    survivors, conv_id, part, ways, starts = None, None, None, {}, {}
    for batch in batches:
        for c, p, before, after, cost, edits, state, number in zip(*(x.to_pylist() for x in batch.columns)):
            if survivors is None or not _same(c, conv_id):
                if survivors is not None:
                    end()
                # a node's tag: the state before it, and where its piece starts from there
                survivors = Survivors(
                    NOTHING, lambda node, c=c: done.append((c, *node.tag[1][node.tag[0]], node.edits)), insert=False
                )
                ways, starts = {}, {}
            elif p != part:
                survivors.piece(ways, starts)
                ways, starts = {}, {}
            conv_id, part = c, p
            ways[before, after] = (cost, edits)
            starts[before] = (p, state, number)
            yield from flush(BATCH)
    if survivors is not None:
        end()
    yield from flush(0)


class _Piece:
    """Undecided rows of one task and the edits chosen for them."""

    def __init__(self, editor: Editor, edits: str):
        self.editor, self.edits, self.used = editor, edits, 0

    def row(self, row: list) -> None:
        self.editor.rows.append(row)
        at, left = self.used, row[-1]  # its copies
        while left:
            left -= self.edits[at] != "I"
            at += 1
        self.editor.apply(self.edits[self.used : at])
        self.used = at

    def end(self) -> None:
        self.editor.apply(self.edits[self.used :])


def _apply(batches: Iterator[pa.RecordBatch], conv_kind, turn_kind) -> Iterator[pa.RecordBatch]:
    """Sorted undecided rows, each piece after its chosen edits -> edits."""
    out, piece = _Out(conv_kind, turn_kind), None
    for batch in batches:
        for conv_id, part, seq, turn, role, fault, text, copies, state, chosen in zip(*(c.to_pylist() for c in batch.columns)):
            if seq == -1:
                if piece is not None:
                    piece.end()
                piece = _Piece(Editor(out.edits_of(conv_id, part), state, copies), chosen)
            else:
                piece.row([turn, role, text, fault, copies])
            yield from out.batches(BATCH)
    if piece is not None:
        piece.end()
    yield from out.batches(0)


def _digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(role, F.lit("\n"), text))


def edits(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of all conversations (conv_id, turn, role, text):
    conv_id, part and seq (their order), edit (K, R, D or I), turn, was_role
    and fault of the row it is for (null for insertions), and the repaired
    role and text (null for deletions)."""
    space = F.lit(" ")
    rows = (
        conversations.select(
            "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
        )
        .withColumn("digest", _digest(F.col("role"), F.col("text")))
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    key = ["conv_id", "turn", "role", "digest"]
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    marks = rows.groupBy("conv_id", "role", "digest").agg(first).select(
        "conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("mark"),
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"),
    )
    both = rows.select(*key, F.lit(1).alias("mark"), "text", "copies").unionByName(marks)
    order = [F.col(c).asc_nulls_first() for c in key]
    ranged = both.repartitionByRange(*order).sortWithinPartitions(*order, "mark")

    conv, turn = (both.schema[c].dataType for c in ("conv_id", "turn"))
    kinds = pa.schema(_arrow(both, "conv_id", "turn"))
    conv_kind, turn_kind = kinds.field(0).type, kinds.field(1).type
    schema = ", ".join(
        f"{c} {conv.simpleString() if c == 'conv_id' else turn.simpleString() if c == 'turn' else _SQL[str(t)]}"
        for c, t in _FIELDS.items()
    )
    done = staged(ranged.mapInArrow(lambda b: _decide(b, conv_kind, turn_kind), schema), "repair-decided")
    ways = done.filter(F.col("kind") == WAY).select(
        "conv_id", "part", "before", "after", "cost", "edit", "state", "seq"
    )
    chosen = (
        ways.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "before", "after")
        .mapInArrow(
            lambda b: _chain(b, conv_kind),
            f"conv_id {conv.simpleString()}, part long, state int, number long, edits string",
        )
    )
    none = lambda kind: F.lit(None).cast(kind)
    undecided = (
        done.filter(F.col("kind") == OPEN)
        .select(
            "conv_id", "part", "seq", "turn", "was_role", "fault", "text", "copies",
            none("int").alias("state"), none("string").alias("edits"),
        )
        .unionByName(
            chosen.select(
                "conv_id", "part", F.lit(-1).cast("long").alias("seq"), none(turn).alias("turn"),
                none("string").alias("was_role"), none("string").alias("fault"), none("string").alias("text"),
                F.col("number").alias("copies"), "state", "edits",
            )
        )
        .repartition("conv_id", "part")
        .sortWithinPartitions("conv_id", "part", "seq")
        .mapInArrow(lambda b: _apply(b, conv_kind, turn_kind), schema)
    )
    made = done.filter(F.col("kind") == EDIT).unionByName(undecided)
    return made.select("conv_id", "part", "seq", "edit", "turn", "was_role", "fault", "role", "text")


_SQL = {"int32": "int", "int64": "long", "string": "string"}


def _arrow(df: DataFrame, *columns: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(c, to_arrow_type(df.schema[c].dataType)) for c in columns]


def summary(made: DataFrame) -> DataFrame:
    """Per conversation of ``edits``: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256."""
    kind = _arrow(made, "conv_id")[0].type
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush(least: int):
            if out and len(out) >= least:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), [kind, *[pa.int64()] * 6, pa.string(), pa.string()])],
                    names=["conv_id", *counts, "audit", "repaired_sha256"],
                )
                out.clear()

        now = None
        for batch in batches:
            for conv_id, edit, turn, was_role, fault, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or not _same(now[0], conv_id):
                    if now is not None:
                        out.append(now[1].row(now[0]))
                        yield from flush(BATCH)
                    now = (conv_id, _Tally())
                now[1].add(edit, turn, was_role, fault, role, text)
        if now is not None:
            out.append(now[1].row(now[0]))
        yield from flush(0)

    ordered = (
        made.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "seq")
        .select("conv_id", "edit", "turn", "was_role", "fault", "role", "text")
    )
    conv = made.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    )


class _Tally:
    """Figures of one conversation, its edits coming in order."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = None
        self.distinct = self.illegal = self.cost = 0
        self.last = None
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, edit, turn, was_role, fault, role, text) -> None:
        self.audit.append(edit)
        late = fault == "truncated"
        self.cost += {"K": late, "R": 2 + late, "D": 3, "I": 2}[edit]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
            if self.last is not None:
                self.illegal += self.last + was_role[:1] not in ("su", "ua", "au")
            self.last = was_role[:1]
        if edit != "D":
            if self.begun:
                self.hash.update(b"\n")
            self.begun = True
            self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
