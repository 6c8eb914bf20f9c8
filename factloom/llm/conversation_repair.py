"""Conversation structure repair (operator 13).

Roles must follow the grammar `(s?(ua)+)?`: maybe a system turn, then user and assistant in turn.
The repair is the cheapest sequence of edits (keep, rerole, delete, insert), found by a forward
Viterbi recursion over the four states of the grammar that carries the least (cost, audit
string) into each state and closes each turn's layer with inserts.

Rows are sorted by range, so a conversation may spread over several tasks. It is cut into pieces
of bounded size; a piece's recursion starts from each of the four states, and the pieces'
4 x 4 results are chained afterwards. Only conversations of more than one piece, and those at
the border of a range, take that second step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm.common import hash128, lean, settled

#: Rows and characters of text in one piece of a conversation, at most (one row at least).
PIECE_ROWS, PIECE_CHARS = 400, 1_000_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. From each
#: one kind of turn can be made by an edit: its role and the state after it.
WANTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ENDS = (0, 3)
NEVER = (float("inf"), "")
FINE, BLANK, REPEATED, CUT = range(4)
SEEN = re.compile(r"[^\x20\x09-\x0D]")
GAPS = " \t\n\v\f\r"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def step(state: int, initial: str) -> int:
    """The state after keeping a turn of that role initial, -1 if the grammar forbids it."""
    if state == 0 and initial == "s":
        return 1
    return AFTER[state] if initial == WANTED[state][0] else -1


def closed(best: list) -> list:
    """The layer with inserted turns: from the start or after a system or assistant turn a user turn, then an assistant turn.

    More inserts come back to a state at a higher cost.
    """
    best = list(best)
    best[2] = min(best[2], *((best[k][0] + INSERT, best[k][1] + "I") for k in (0, 1, 3)))
    best[3] = min(best[3], (best[2][0] + INSERT, best[2][1] + "I"))
    return best


def layers(rows: Iterable[tuple[str, int]], entry: int) -> list:
    """The least (cost, audit) of each state after rows of (role initial, fault) from the state `entry`.

    Audits of equal cost over the same rows are never prefixes of each other, so the least one
    stays the least whatever follows.
    """
    best = [NEVER] * 4
    best[entry] = (0, "")
    best = closed(best)
    for initial, fault in rows:
        after = [(c + DELETE, a + "D") for c, a in best]
        if fault not in (BLANK, REPEATED):
            more = TRUNCATED if fault == CUT else 0
            for state, (cost, audit) in enumerate(best):
                kept, made = step(state, initial), AFTER[state]
                if kept >= 0:
                    after[kept] = min(after[kept], (cost + more, audit + "K"))
                after[made] = min(after[made], (cost + REROLE + more, audit + "R"))
        best = closed(after)
    return [b if b[0] < float("inf") else NEVER for b in best]


def replay(entry: int, audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the turns that the edits leave of the given ones."""
    state, at, out = entry, 0, ([], [])
    for edit in audit:
        if edit != "D":
            out[0].append(roles[at] if edit == "K" else WANTED[state])
            out[1].append("" if edit == "I" else texts[at])
            state = step(state, roles[at][:1]) if edit == "K" else AFTER[state]
        at += edit != "I"
    return out


def fault_of(text: str, first: bool) -> int:
    if not SEEN.search(text):
        return BLANK
    if not first:
        return REPEATED
    return FINE if text.rstrip(GAPS)[-1] in ".!?" else CUT


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present) with planted faults, by crc32(`conv:turn`) mod 20; nulls read as one space.

    0 drops the row (present is false), 1 empties its text, 2 removes its marks of a sentence's
    end, 3 repeats the row, 4 makes its role user.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")) % 20
    words = F.coalesce(F.col(text), space)
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


class _Piece:
    """Turns of one conversation that follow each other, with what counts need of them."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.chars = [], [], [], 0
        self.turns, self.low, self.high = 0, None, None

    def add(self, turn, role: str, text: str, first: bool) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault_of(text, first))
        self.chars += len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.chars >= PIECE_CHARS

    def counts(self) -> dict:
        initials = [r[:1] for r in self.roles]
        found = [self.faults.count(k) for k in (BLANK, REPEATED, CUT)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return dict(n=len(initials), found=[*found, illegal], first=initials[0] if initials else "", last=initials[-1] if initials else "", low=self.low, high=self.high, turns=self.turns)

    def paths(self, entries: Iterable[int]) -> list[list]:
        rows = [(r[:1], f) for r, f in zip(self.roles, self.faults)]
        return [layers(rows, e) for e in entries]


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 200 + sum(map(len, row.get("texts") or []))
        if chars >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _piece_type(conv: T.DataType) -> T.StructType:
    whole, words = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    kinds = dict(conv=conv, part=T.LongType(), seq=T.LongType(), single=T.BooleanType(), n=T.LongType(), found=whole, first=T.StringType(), last=T.StringType())
    kinds |= dict(low=T.LongType(), high=T.LongType(), turns=T.LongType(), costs=whole, audits=words, roles=words, texts=words)
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _pieces(ranged: DataFrame, conv: T.DataType, most: int) -> DataFrame:
    """Pieces of the conversations of each sorted range.

    A conversation that surely lies within the range and is one piece is repaired at once
    (`single`); of other pieces the 16 best paths are given, from each state into each.
    """
    kinds = _piece_type(conv)
    schema = to_arrow_schema(kinds)

    def cut(batches) -> Iterator[tuple]:
        """(conversation, its number here, its pieces so far) whenever a piece is full, and (.., None) at its end."""
        number, held, piece, pending = -1, object(), None, None
        for conv, turn, role, text, present, mark, own in _rows_of(batches):
            if piece is None or conv != held:
                if piece is not None:
                    yield held, number, piece, True
                held, piece, number = conv, _Piece(), number + 1
            if mark:
                pending = own
            elif present:
                if piece.full(most):
                    yield held, number, piece, False
                    piece = _Piece()
                piece.add(turn, role, text, own == pending)
        if piece is not None:
            yield held, number, piece, None

    def run(batches):
        part = TaskContext.get().partitionId()

        def made():
            before = -1
            for seq, (conv, number, piece, ends) in enumerate(cut(batches)):
                row = dict(conv=conv, part=part, seq=seq, **piece.counts())
                # The first and the last conversation of a range may go on in another one.
                if ends and number != before and number > 0:
                    best = piece.paths([0])[0]
                    cost, audit = min(best[e] for e in ENDS)
                    roles, texts = replay(0, audit, piece.roles, piece.texts)
                    yield row | dict(single=True, costs=[cost], audits=[audit], roles=roles, texts=texts)
                else:
                    flat = [b for line in piece.paths(range(4)) for b in line]
                    costs = [None if c == float("inf") else c for c, _ in flat]
                    yield row | dict(single=False, costs=costs, audits=[a for _, a in flat], roles=piece.roles, texts=piece.texts)
                before = number

        yield from _in_batches(made(), schema)

    return ranged.mapInArrow(lean(run), kinds)


def _chained(pieces: DataFrame, conv: T.DataType) -> DataFrame:
    """(part, seq) of each piece with the state it starts from, its edits, its number in the conversation, and on the last piece the counts.

    Survivors' audits are compared without what they have in common, which is nearly all.
    """
    kinds = T.StructType([T.StructField(k, T.LongType()) for k in ("part", "seq", "piece", "entry")] + [T.StructField("edits", T.StringType()), T.StructField("final", T.BooleanType())] + [T.StructField(k, T.LongType()) for k in COUNTS])
    schema = to_arrow_schema(kinds)

    def decided(places: list, best: list, came: list, found, low, high, turns) -> Iterator[dict]:
        state = min(ENDS, key=lambda e: best[e])
        cost, path = best[state][0], []
        for back in reversed(came):
            entry, audit = back[state]
            path.append((entry, audit))
            state = entry
        for k, ((part, seq), (entry, audit)) in enumerate(zip(places, reversed(path))):
            row = dict(part=part, seq=seq, piece=k, entry=entry, edits=audit, final=k == len(places) - 1)
            yield row | dict(zip(COUNTS, [_gaps(low, high, turns), *found, cost])) if row["final"] else row

    def run(batches):
        def made():
            held, places = None, []
            for conv, part, seq, n, counts, first, last, low, high, turns, costs, audits in _rows_of(batches):
                if not places or conv != held:
                    if places:
                        yield from decided(places, best, came, found, least, most, distinct)
                    held, places, came = conv, [], []
                    best, found, least, most, distinct, ending = [(0, ""), NEVER, NEVER, NEVER], [0] * 4, None, None, 0, None
                places.append((part, seq))
                new, back = [NEVER] * 4, [None] * 4
                for i in range(4):
                    for j in range(4):
                        if best[i][0] < float("inf") and costs[4 * i + j] is not None:
                            reached = (best[i][0] + costs[4 * i + j], best[i][1] + audits[4 * i + j])
                            if back[j] is None or reached < new[j]:
                                new[j], back[j] = reached, (i, audits[4 * i + j])
                live = [a for c, a in new if c < float("inf")]
                shared = next((k for k, (a, b) in enumerate(zip(min(live), max(live))) if a != b), min(map(len, live)))
                best, came = [(c, a[shared:]) for c, a in new], [*came, back]
                found = [a + b for a, b in zip(found, counts)]
                if n:
                    found[3] += ending is not None and ending + first not in ("su", "ua", "au")
                    ending = last
                if low is not None:
                    distinct += turns - (low == most)
                    least, most = low if least is None else least, high
            if places:
                yield from decided(places, best, came, found, least, most, distinct)

        yield from _in_batches(made(), schema)

    needed = pieces.select("conv", "part", "seq", "n", "found", "first", "last", "low", "high", "turns", "costs", "audits")
    return needed.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(lean(run), kinds)


def _edited(pieces: DataFrame) -> DataFrame:
    """pieces with roles and texts after their edits."""
    kinds = pieces.schema
    names, schema = kinds.names, to_arrow_schema(kinds)

    def run(batches):
        def made():
            for values in _rows_of(batches):
                row = dict(zip(names, values))
                row["roles"], row["texts"] = replay(row["entry"], row["edits"], row["roles"], row["texts"])
                yield row

        yield from _in_batches(made(), schema)

    return pieces.mapInArrow(lean(run), kinds)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Repaired conversations, in pieces: (conv, piece, final, edits, roles, texts) and, on the final piece, the counts of COUNTS.

    A conversation is its rows by turn (nulls first); rows of one turn come by role, then by the
    first 32 characters and a hash of their text. Null conversations are one conversation; null
    roles and texts are read as one space. Rows for which `present` is false or null aren't part of
    it, but their conversation is returned, empty if nothing else is there. An empty table gives no
    rows; other columns aren't read. A row's first fault counts, in the order blank, duplicate
    (role and text of an earlier row), truncated (no . ! ? at the end). Blank and duplicate rows
    must go. Pieces of one conversation are numbered from 0; nearly all have one.

    A repeated row is found by the first of each (conversation, role, text), a grouping that
    combines before it shuffles; marks of these firsts are sorted in just before their rows, so
    that no task needs to hold the texts of a conversation.
    """
    kind = df.schema[conv].dataType
    words, who = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    h1, h2 = hash128(who, words)
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), words.alias("text"), there.alias("present"), h1.alias("h1"), h2.alias("h2"), F.monotonically_increasing_id().alias("own"))
    # Written, as both the firsts and the rows need the same numbers of rows.
    rows = settled(rows, "turns").withColumn("head", F.substring("text", 1, 32))
    place = F.min(F.struct("turn", "own", "role", "head")).alias("place")
    firsts = rows.filter("present").groupBy("conv", "h1", "h2").agg(place).select("conv", "h1", "place.*", F.lit(None).cast("string").alias("text"), F.lit(True).alias("present"), F.lit(True).alias("mark"))
    every = rows.drop("h2").withColumn("mark", F.lit(False)).unionByName(firsts)
    order = ["conv", "turn", "role", "head", "h1", "own"]
    ranged = every.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("mark"))
    pieces = settled(_pieces(ranged.select("conv", "turn", "role", "text", "present", "mark", "own"), kind, piece_rows), "pieces")

    one = pieces.filter("single")
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    numbers = dict(zip(COUNTS, [gaps, *[F.col("found")[k] for k in range(4)], F.col("costs")[0]]))
    one = one.select(F.col("conv").alias(conv), F.lit(0).cast("long").alias("piece"), F.lit(True).alias("final"), F.col("audits")[0].alias("edits"), "roles", "texts", *[c.alias(k) for k, c in numbers.items()])
    many = pieces.filter("NOT single")
    joined = many.select(F.col("conv").alias(conv), "part", "seq", "roles", "texts").join(_chained(many, kind), ["part", "seq"])
    return one.unionByName(_edited(joined).select(*one.columns))


def outcomes(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of repair(): its counts, the whole audit, and the SHA-256 of its `role:text` lines.

    Conversations of several pieces are hashed piece after piece, as SHA-256 can't be split.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    alone = F.col("final") & (F.col("piece") == 0)
    one = pieces.filter(alone).select(conv, *COUNTS, F.col("edits").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    kinds = one.schema
    names, schema = kinds.names, to_arrow_schema(kinds)

    def run(batches):
        def made():
            seen, audit = hashlib.sha256(), []
            started = False
            for held, final, edits, roles, texts, *counts in _rows_of(batches):
                for r, t in zip(roles, texts):
                    seen.update(f"{chr(10) if started else ''}{r}:{t}".encode())
                    started = True
                audit.append(edits)
                if final:
                    yield dict(zip(names, [held, *counts, "".join(audit), seen.hexdigest()]))
                    seen, audit, started = hashlib.sha256(), [], False

        yield from _in_batches(made(), schema)

    rest = pieces.filter(~alone).select(conv, "final", "edits", "roles", "texts", *COUNTS, "piece")
    rest = rest.repartition(conv).sortWithinPartitions(conv, "piece").drop("piece")
    return one.unionByName(rest.mapInArrow(lean(run), kinds))
