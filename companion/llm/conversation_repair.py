"""Conversation structure repair by survivor-coalescence Viterbi.

A conversation is to read ``s?(ua)+`` by the initials of its roles (or to be empty).
Every row is kept, given another role or deleted, and rows with an empty text may be
inserted; blank rows and repetitions must go, and a truncated row that stays costs
extra.  ``repair`` finds the cheapest edits, of equally cheap ones those whose letters
(Keep, Rerole, Delete, Insert) come first in ASCII order.

Method: a Viterbi pass over the rows keeps one survivor for each state of the pattern
(nothing yet, after s, after u, after a).  Survivors are leaves of a tree of
backpointers whose nodes count their references: a node that no survivor needs goes at
once, and edits that all survivors share are emitted and leave the tree.  A survivor
that costs more than any completion could win back (``EXCESS``) is dropped, which lets
the others coalesce.  Where two paths into one state cost the same, their complete
unresolved suffixes, back to where they part, are compared.

Scale: equal rows of a conversation are counted before anything else.  The rows are
then sorted by range, so that a conversation of any length lies in consecutive range
partitions; its rows in one partition are a piece.  Most conversations have one piece.
The others are solved piece by piece: each piece gives its cost from every state to
every state, these few numbers are chained backwards for the cost of what follows, and
then the states in which the best path enters the pieces are chained forwards.  No
task holds more than one piece, and only numbers of pieces (bounded by the number of
range partitions) meet per conversation.  Texts do not take part: a row is a letter.
``summarize`` digests the result to one row per conversation; it reads the rows in
order as a stream (SHA-256 can't be split), so a long conversation costs it time, and
memory for its audit only.

Defined cases: a null conversation is one of its own; null turns come first; rows of one
turn follow the SHA-256 of role and text; a null role or text is read as one space; an
empty role has no initial and fits no place; equal rows are duplicates of the first; an
empty table gives no rows; texts of any length; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companion.session import materialize

BLANKS = "\t\n\x0b\x0c\r "
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3         # costs
EMPTY, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
KEEPS = {"s": {EMPTY: AFTER_S}, "u": {EMPTY: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
         "a": {AFTER_U: AFTER_A}}
ROLES = {"u": "user", "a": "assistant"}
CLOSING = {EMPTY: "", AFTER_S: "ua", AFTER_U: "a", AFTER_A: ""}    # rows to insert at the end
END = [INSERT * len(CLOSING[state]) for state in STATES]
FAR = 1 << 60
#: EXCESS[y][x]: a completion from state x costs at most so much more from state y.
EXCESS = {EMPTY: {AFTER_S: 0, AFTER_U: INSERT, AFTER_A: 0},
          AFTER_S: {EMPTY: 2 * INSERT, AFTER_U: INSERT, AFTER_A: 2 * INSERT},
          AFTER_U: {EMPTY: INSERT + DELETE, AFTER_S: INSERT, AFTER_A: INSERT},
          AFTER_A: {EMPTY: DELETE, AFTER_S: 0, AFTER_U: INSERT}}
FORCED = "x"                                           # the letter of a row that must go


def made(state: int) -> tuple[str, int]:
    """The one role initial that a new or changed row can have in ``state``, and the next state."""
    return ("a", AFTER_A) if state == AFTER_U else ("u", AFTER_U)


def moves(letter: str) -> list[list[tuple[int, int, str, tuple[str, str, str]]]]:
    """For each next state its (state, cost, letters, edit) over a row; an edit is the initials
    inserted before the row, the row's letter, and its new initial.

    Letters: s, u, a or o (other) by initial, upper case if truncated; x must go."""
    best: dict[tuple[int, int], tuple[int, str, tuple[str, str, str]]] = {}
    for state in STATES:
        before, at = "", state
        for _ in range(3):
            options = [("D", at, DELETE, "")]
            if letter != FORCED:
                extra = TRUNCATED if letter.isupper() else 0
                role, to = made(at)
                options.append(("R", to, REROLE + extra, role))
                if at in KEEPS.get(letter.lower(), {}):
                    options.append(("K", KEEPS[letter.lower()][at], extra, ""))
            for edit, to, cost, role in options:
                offer = (cost + INSERT * len(before), "I" * len(before) + edit, (before, edit, role))
                best[state, to] = min(best.get((state, to), offer), offer)
            role, at = made(at)
            before += role
    return [[(state, *best[state, to]) for state in STATES if (state, to) in best] for to in STATES]


MOVES = {letter: moves(letter) for letter in "suaoSUAO" + FORCED}


def letters(edits: list[tuple[str, str, str]]) -> str:
    return "".join("I" * len(before) + edit for before, edit, _ in edits)


class Node:
    """An edit on the way back to the root; it lives as long as something refers to it."""

    __slots__ = ("parent", "edit", "references", "children")

    def __init__(self, parent: Node | None, edit: tuple[str, str, str] | None) -> None:
        self.parent, self.edit, self.references, self.children = parent, edit, 0, set()
        if parent is not None:
            parent.references += 1
            parent.children.add(self)

    def release(self) -> None:
        node = self
        node.references -= 1
        while node.references == 0 and node.parent is not None:
            parent = node.parent
            parent.children.discard(node)
            parent.references -= 1
            node = parent


class Survivors:
    """The cheapest path into every state, over the rows given so far.

    Each path is (cost, leaf, rank): the rank is its place among the survivors by their complete
    unresolved suffixes.  Every edit ends in its row's own letter, so no suffix is the
    beginning of another, and suffixes that part before the last row compare as their ranks."""

    def __init__(self, entry: int) -> None:
        self.root = Node(None, None)
        self.root.references += 1
        self.paths = {entry: (0, self.root, 0)}
        self.emitted: list[tuple[str, str, str]] = []
        self.most = 0                                   # unresolved rows at the worst time
        self.depth = 0

    def step(self, letter: str) -> None:
        found = {}
        for to in STATES:
            offers = []
            for state, cost, written, edit in MOVES[letter][to]:
                if state in self.paths:
                    total, node, rank = self.paths[state]
                    offers.append((total + cost, rank, written, node, edit))
            if offers:
                found[to] = min(offers, key=lambda x: x[:3])
        kept = [to for to in found if all(
            found[to][0] <= found[y][0] + EXCESS[y][to] for y in found if y != to)]
        kept.sort(key=lambda to: found[to][1:3])
        held, self.paths = self.paths, {}
        for rank, to in enumerate(kept):
            total, _, _, node, edit = found[to]
            leaf = Node(node, edit)
            leaf.references += 1
            self.paths[to] = (total, leaf, rank)
        for _, node, _ in held.values():
            node.release()
        self.depth += 1
        while self.root.references == 1 and len(self.root.children) == 1:
            (child,) = self.root.children
            child.parent = None
            self.emitted.append(child.edit)
            self.root = child
            self.depth -= 1
        self.most = max(self.most, self.depth)

    def finish(self, following: list[int]) -> tuple[list[tuple[str, str, str]], int]:
        """All edits and the state they end in, if what follows costs ``following[state]``."""
        _, _, state = min((total + following[state], rank, state)
                          for state, (total, _, rank) in self.paths.items())
        node = self.paths[state][1]
        rest = []
        while node is not self.root:
            rest.append(node.edit)
            node = node.parent
        return self.emitted + rest[::-1], state


def solve(row_letters: str, entry: int, following: list[int]):
    survivors = Survivors(entry)
    for letter in row_letters:
        survivors.step(letter)
    return survivors.finish(following)


def crossing(row_letters: str) -> list[int]:
    """Cost from every state to every state over the rows, as 16 numbers."""
    out = []
    for entry in STATES:
        costs = [0 if state == entry else FAR for state in STATES]
        for letter in row_letters:
            costs = [min((costs[state] + cost for state, cost, *_ in arrivals), default=FAR)
                     for arrivals in MOVES[letter]]
        out += [min(cost, FAR) for cost in costs]
    return out


def following_costs(crossings: list[list[int]]) -> list[list[int]]:
    """For consecutive pieces, what the rows after each piece cost from every state."""
    costs, out = END, []
    for cross in crossings[::-1]:
        out.append(costs)
        costs = [min(cross[4 * x + y] + costs[y] for y in STATES) for x in STATES]
    return out[::-1]


CROSSING = "array<long>"
EDITS = "array<struct<before:string,edit:string,role:string,after:string>>"


def crossing_column(row_letters: Column) -> Column:
    @F.arrow_udf(CROSSING)
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([crossing(x) for x in texts.to_pylist()], pa.list_(pa.int64()))

    return of(row_letters)


def following_column(crossings: Column) -> Column:
    @F.arrow_udf("array<array<long>>")
    def of(lists: pa.Array) -> pa.Array:
        return pa.array([following_costs(x) for x in lists.to_pylist()], pa.list_(pa.list_(pa.int64())))

    return of(crossings)


def exits_column(row_letters: Column, following: Column) -> Column:
    """For every state of entry the state in which the best path leaves the piece."""
    @F.arrow_udf("array<int>")
    def of(texts: pa.Array, costs: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), costs.to_pylist())
        return pa.array([[solve(x, entry, cost)[1] for entry in STATES] for x, cost in rows],
                        pa.list_(pa.int32()))

    return of(row_letters, following)


def entries_column(exits: Column) -> Column:
    """The states in which the best path enters consecutive pieces."""
    @F.arrow_udf("array<int>")
    def of(lists: pa.Array) -> pa.Array:
        out = []
        for pieces in lists.to_pylist():
            states = [EMPTY]
            for leaves in pieces[:-1]:
                states.append(leaves[states[-1]])
            out.append(states)
        return pa.array(out, pa.list_(pa.int32()))

    return of(exits)


def edits_column(row_letters: Column, entry: Column, following: Column, last: Column) -> Column:
    kind = pa.list_(pa.struct([(x, pa.string()) for x in ("before", "edit", "role", "after")]))

    @F.arrow_udf(EDITS)
    def of(texts: pa.Array, entries: pa.Array, costs: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(x.to_pylist() for x in (texts, entries, costs, ends))):
            edits, state = solve(*row[:3])
            rows = [{"before": b, "edit": e, "role": r, "after": ""} for b, e, r in edits]
            if row[3]:
                rows[-1]["after"] = CLOSING[state]
            out.append(rows)
        return pa.array(out, kind)

    return of(row_letters, entry, following, last)


def in_order(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct rows with their number of copies (zero: the conversation has a mark, no row),
    ``same`` (equal role and text in one conversation) and ``place``, which ascends with turns."""
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    conversation = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    same = F.sha2(F.concat_ws(":", conversation, F.length("role").cast("string"), "role", "text"), 256)
    known = counted.withColumn("conversation", conversation).withColumn("same", same)
    order = [F.col("conversation").asc(), F.col("turn").asc_nulls_first(), F.col("same").asc()]
    dealt = known.repartitionByRange(partitions, *order) if partitions else known.repartitionByRange(*order)
    return materialize(dealt.sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "conversation-rows")


def with_faults(ordered: DataFrame) -> DataFrame:
    """place, conversation, fault (blank, duplicate, truncated, none) and letter of every row."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = ordered.filter("copies > 0").select(
        "conversation", "place", "same", F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = narrow.groupBy("same").agg(F.min("place").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(
        F.col("cut"), "truncated").otherwise("none")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).when(
        F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return narrow.join(first, "same").withColumn("fault", fault).select(
        "conversation", "place", "fault", letter.alias("letter"))


def edits_of(faults: DataFrame) -> DataFrame:
    """place, before, edit, role, after of every row."""
    piece = F.shiftright("place", 33)                    # the range partition of the place
    listed = F.sort_array(F.collect_list(F.struct("place", "letter")))
    pieces = materialize(faults.groupBy("conversation", piece.alias("piece")).agg(
        listed.alias("rows")).select(
        "conversation", "piece", F.col("rows.place").alias("places"),
        F.array_join("rows.letter", "").alias("letters")), "conversation-pieces")
    spread = materialize(pieces.groupBy("conversation").agg(F.max("piece").alias("final"), F.count("*").alias(
        "n")).filter("n > 1"), "conversation-spread")      # fewer than there are range partitions
    end = F.array(*[F.lit(x).cast("long") for x in END])
    whole = pieces.join(spread, "conversation", "left_anti").select(
        "places", "letters", F.lit(EMPTY).alias("entry"), end.alias("following"), F.lit(True).alias("last"))

    def chained(df: DataFrame, value: str, chain, name: str) -> DataFrame:
        """One value per piece from the values of all pieces of its conversation."""
        lists = df.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct(
            "piece", value))).alias("all"))
        return lists.withColumn("chain", chain(F.col(f"all.{value}"))).select(
            "conversation", F.explode(F.arrays_zip(F.col("all.piece").alias("piece"), F.col(
                "chain").alias(name))).alias("one")).select("conversation", "one.piece", f"one.{name}")

    if not spread.isEmpty():
        key = ["conversation", "piece"]
        parts = pieces.join(spread, "conversation").withColumn("last", F.col("piece") == F.col("final"))
        crossed = materialize(parts.select(*key, crossing_column(F.col("letters")).alias("cross")),
                              "conversation-crossings")
        followed = parts.join(chained(crossed, "cross", following_column, "following"), key)
        left = materialize(followed.withColumn("exits", exits_column(
            F.col("letters"), F.col("following"))), "conversation-exits")
        entered = left.join(chained(left, "exits", entries_column, "entry"), key)
        whole = whole.union(entered.select(*whole.columns))
    solved = whole.select("places", edits_column(
        F.col("letters"), F.col("entry"), F.col("following"), F.col("last")).alias("edits"))
    return solved.select(F.explode(F.arrays_zip("places", "edits")).alias("one")).select(
        F.col("one.places").alias("place"), "one.edits.*")


def repair(rows: DataFrame, copies: str | None = None, partitions: int | None = None) -> DataFrame:
    """Edits of every distinct row of (conv_id, turn, role, text): conversation, place (ascends with the order), conv_id, turn, role, text,
    copies, fault, before (initials of rows to insert), edit (K, R or D), new_role, after.

    Copies beyond the first are to be deleted.  ``copies`` names a column that says how often a
    row stands there; ``partitions`` overrides the number of ranges."""
    space = F.lit(" ")
    number = F.col(copies) if copies else F.lit(1)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(
        F.col("role").cast("string"), space).alias("role"), F.coalesce(
        F.col("text").cast("string"), space).alias("text"), number.cast("long").alias("copies"))
    ordered = in_order(given, partitions)
    faults = materialize(with_faults(ordered), "conversation-faults")
    edits = edits_of(faults).withColumnRenamed("role", "new")
    role = F.when(F.col("edit") == "R", F.when(F.col("new") == "u", ROLES["u"]).otherwise(ROLES["a"])).when(
        F.col("edit") == "K", F.col("role"))
    found = faults.select("place", "fault").join(edits, "place")
    return ordered.drop("same").join(found, "place", "left").withColumn("new_role", role).drop("new")


class Summary:
    """What one conversation comes to, row by row in order."""

    def __init__(self) -> None:
        self.turns: list[int] = []                       # least, greatest, number of distinct ones
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = 0
        self.initial: str | None = None
        self.audit: list[str] = []
        self.digest, self.started = hashlib.sha256(), False

    def write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.started else "") + role + ":" + text).encode())
        self.started = True

    def add(self, turn, role, text, copies, fault, before, edit, new_role, after) -> None:
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        if fault in ("blank", "duplicate"):
            self.counts[fault] += copies
        else:
            self.counts["duplicate"] += copies - 1
            self.counts["truncated"] += fault == "truncated"
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1                       # no initial may follow itself
        self.initial = initial
        for new in before:
            self.write(ROLES[new], "")
        if new_role is not None:
            self.write(new_role, text)
            self.cost += TRUNCATED * (fault == "truncated") + REROLE * (edit == "R")
        for new in after:
            self.write(ROLES[new], "")
        self.audit.append("I" * len(before) + edit + "D" * (copies - 1) + "I" * len(after))
        self.cost += INSERT * (len(before) + len(after)) + DELETE * (copies - 1 + (edit == "D"))

    def row(self) -> dict:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def summarize(repaired: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256 (of the repaired ``role:text`` lines)."""
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fields = ["turn", "role", "text", "copies", "fault", "before", "edit", "new_role", "after"]
    schema = T.StructType([repaired.schema["conv_id"]] + [T.StructField(x, T.LongType()) for x in numbers]
                          + [T.StructField(x, T.StringType()) for x in ("audit", "repaired_sha256")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, summary = None, None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            out = pa.schema([("conv_id", kind)] + [(x, pa.int64()) for x in numbers]
                            + [("audit", pa.string()), ("repaired_sha256", pa.string())])
            columns = (batch.column(x).to_pylist() for x in ["conversation", "conv_id", *fields])
            for key, conv_id, *values in zip(*columns):
                if key != now:
                    if summary:
                        done.append({"conv_id": conv} | summary.row())
                    now, conv, summary = key, conv_id, Summary()
                if values[3]:
                    summary.add(*values)
            yield pa.RecordBatch.from_pylist(done, out)
        if summary:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv} | summary.row()], out)

    kept = repaired.select("conversation", "place", "conv_id", *fields)
    return kept.repartition("conversation").sortWithinPartitions("conversation", "place").mapInArrow(
        digest, schema)
