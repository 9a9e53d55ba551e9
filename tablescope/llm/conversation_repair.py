"""Conversation structure repair (operator 13): turns aligned with the alternating grammar ``(s?(ua)+)?``.

A conversation is the initials of its roles in order. It is aligned, by Wagner and Fischer's table of edit costs, with the
grammar's string of each feasible length: ``ua`` repeated, with an ``s`` before it if the length is odd. Keep costs 0, giving a
turn the role user or assistant 2, deleting it 3, inserting an empty user or assistant turn 2; blank turns and turns whose
role and text came before must be deleted, truncated ones that stay add 1. Lengths are tried nearest first. Ukkonen's bands leave
out lengths and cells whose difference in length alone costs more than the cheapest alignment so far. The alignments of each length
are traced back, and of the cheapest edit strings the ASCII-least one is taken. In a conversation of many turns the table's
columns are folded: columns a period apart have the same continuations, so the tables of all lengths become one of four columns.
The edits are the same.

Turns are read twice in one sorted pass: first without their texts, which gives the edits with a few bytes a turn, then with
them, so no conversation's texts are ever held. Its edit string is one value, which bounds a conversation to 2^31 turns.

Order within a conversation is turn (missing first), role, then a hash of role and text. Defined cases: a missing role or text is
one space; rows without a conversation id are one conversation; a missing turn counts for order only; a role of another initial, or none, can't be kept; repeated rows are
duplicates; a conversation none of whose rows is present has zeros and no edits; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
LONG = 64  # turns from which the table is folded
_NEVER = 1 << 60

REPAIRED = "conv_id {0}, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by a checksum of ``conv_id:turn``; a dropped row stays as not present."""
    key = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    role_of, text_of = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text))
    rows = df.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.when(kind == 4, "user").otherwise(role_of).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text_of, ".!?", "")).otherwise(text_of).alias("text"),
        (kind != 0).alias("present"),
        kind.alias("_kind"),
    )
    return rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "_kind")


def _target(odd: bool, j: int) -> str:
    """Character j of the grammar's string of odd or even length."""
    if odd and j == 0:
        return "s"
    return "ua"[(j - odd) % 2]


def _step(initial: str, fault: str, wanted: str) -> list[tuple[int, str]]:
    """(cost, edit) of laying a turn against a character: keep or a new role."""
    if fault in "bd":
        return []
    extra = 1 if fault == "t" else 0
    if initial == wanted:
        return [(extra, KEEP)]
    return [(2 + extra, REROLE)] if wanted != "s" else []


def align(initials: str, faults: str) -> tuple[int, str]:
    """(cost, edits) of the cheapest alignment, the ASCII-least of the equal ones, over the lengths of the grammar.

    ``faults`` has b, d, t or space for each turn. Tables hold costs to the end of the conversation, so that edits are traced
    from its beginning.
    """
    n = len(initials)
    must = np.cumsum([0, *[f in "bd" for f in faults]])
    stay = n - int(must[-1])  # turns that may stay
    best = 3 * n
    audits = {0: DELETE * n}  # the empty string is always feasible
    for odd in (False, True):
        shortest = 3 if odd else 2
        # lengths by what their difference from the turns that may stay costs at least
        lengths = [m for m in range(shortest, stay + best // 2 + 2) if m % 2 == odd and _least(stay, m) + 3 * int(must[-1]) <= best]
        for m in sorted(lengths, key=lambda m: _least(stay, m)):
            if _least(stay, m) + 3 * int(must[-1]) > best:
                continue
            cost, audit = _one_length(initials, faults, odd, m, best, must)
            if cost is None or cost > best:
                continue
            if cost < best:
                audits = {}
            best = cost
            audits[m] = audit
    return best, min(audits.values())


def _least(turns: int, m: int) -> int:
    """What a difference in length costs at least."""
    return 2 * max(0, m - turns) + 3 * max(0, turns - m)


def _one_length(initials: str, faults: str, odd: bool, m: int, most: int, must: np.ndarray) -> tuple[int | None, str]:
    """Wagner-Fischer alignment with the string of length m, in a band of the cells that ``most`` leaves possible."""
    n = len(initials)
    costs = [[_NEVER] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        left = n - i - int(must[n] - must[i])
        before = i - int(must[i])
        asked = 3 * int(must[n])
        # a cell (i, j) needs at least the difference of what is before it and of what is after it
        low = max(0, before - (most - asked) // 3 - 1, m - left - (most - asked) // 2 - 1)
        high = min(m, before + (most - asked) // 2 + 1, m - left + (most - asked) // 3 + 1)
        row = costs[i]
        for j in range(high, low - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            cost = _NEVER
            if i < n:
                cost = costs[i + 1][j] + 3
                if j < m:
                    for extra, _ in _step(initials[i], faults[i], _target(odd, j)):
                        cost = min(cost, costs[i + 1][j + 1] + extra)
            if j < m and _target(odd, j) != "s":
                cost = min(cost, row[j + 1] + 2)
            row[j] = cost
    if costs[0][0] > most:
        return None, ""
    i, j, audit = 0, 0, []
    while i < n or j < m:  # letters in ASCII order, the first that keeps to the cost
        here = costs[i][j]
        kept = _step(initials[i], faults[i], _target(odd, j)) if i < n and j < m else []
        if i < n and costs[i + 1][j] + 3 == here:
            audit.append(DELETE)
            i += 1
        elif j < m and _target(odd, j) != "s" and costs[i][j + 1] + 2 == here:
            audit.append(INSERT)
            j += 1
        else:
            ((_, letter),) = kept
            audit.append(letter)
            i, j = i + 1, j + 1
    return costs[0][0], "".join(audit)


_PHASES = "0sua"  # nothing yet, after s, after u, after a pair
_AFTER = {("0", "s"): 1, ("0", "u"): 2, ("s", "u"): 2, ("u", "a"): 3, ("a", "u"): 2}


def align_folded(initials: str, faults: str) -> tuple[int, str]:
    """The same as ``align``, with the table folded to four columns; time and memory grow with the turns."""
    n = len(initials)
    costs = np.full((n + 1, 4), _NEVER, np.int64)
    costs[n, 0] = costs[n, 3] = 0
    moves = [[(to, c) for (at, c), to in _AFTER.items() if at == p] for p in _PHASES]
    for i in range(n, -1, -1):
        row = [int(v) for v in costs[i]]
        if i < n:
            after = [int(v) for v in costs[i + 1]]
            for p in range(4):
                row[p] = after[p] + 3
                for to, c in moves[p]:
                    for extra, _ in _step(initials[i], faults[i], c):
                        row[p] = min(row[p], after[to] + extra)
        for _ in range(3):  # at most a whole period is inserted between two turns
            for p in range(4):
                for to, c in moves[p]:
                    if c != "s":
                        row[p] = min(row[p], row[to] + 2)
        costs[i] = row
    i, p, audit = 0, 0, bytearray()
    while True:
        here = int(costs[i, p])
        if i == n and here == 0:
            break
        options = [(DELETE, i + 1, p, 3)] if i < n else []
        for to, c in moves[p]:
            if c != "s":
                options.append((INSERT, i, to, 2))
            if i < n:
                options += [(letter, i + 1, to, extra) for extra, letter in _step(initials[i], faults[i], c)]
        letter, i, p, _ = min(o for o in options if int(costs[o[1], o[2]]) + o[3] == here)
        audit += letter.encode()
    return int(costs[0, 0]), audit.decode()


def told(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role given or None) of an edit string, in order: its length without deletions names the grammar's string."""
    length = sum(a != DELETE for a in audit)
    odd, j = length % 2 == 1, 0
    for a in audit:
        if a == DELETE:
            yield a, None
            continue
        yield a, None if a == KEEP else ("user" if _target(odd, j) == "u" else "assistant")
        j += 1


class _Faults:
    """What the turns of one conversation are, added one by one in order."""

    def __init__(self) -> None:
        self.initials, self.faults = bytearray(), bytearray()
        self.seen: set[bytes] = set()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        if fault != "b" and digest in self.seen:
            fault = "d"
        if fault != "d":
            self.seen.add(digest)
        letter = initial if initial in ("s", "u", "a") else "-"
        if self.initials:
            self.illegal += chr(self.initials[-1]) + letter not in ("su", "ua", "au")
        self.initials += letter.encode()
        self.faults += fault.encode()

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *(self.faults.count(k.encode()) for k in "bdt"), self.illegal)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """Per conversation a row of place 0 with (gaps, blank, duplicate, truncated, illegal, cost, audit), followed by its repaired turns (place, role, text).

    Rows whose ``present`` column is false only name their conversation. Rows of a conversation stay together, in order of place.
    """
    kind = df.schema[conv].dataType.simpleString()
    role_of, text_of = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role, text))
    there: Column = F.lit(True) if present is None else F.coalesce(F.col(f"`{present}`"), F.lit(False))
    rows = df.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), role_of.alias("role"), text_of.alias("text"), there.alias("present")
    )
    ends = F.trim(F.col("text"), F.lit(WHITE))
    fault = F.when(~F.col("present"), "-").when(ends == "", "b").when(F.right(ends, F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")
    facts = rows.select(
        "*", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"),
        F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)), 1, 16).alias("digest"),
    )
    both = facts.select(
        "conv_id", "turn", "role", "digest",
        F.explode(F.array(F.struct(F.lit(0).alias("part"), "fault", "initial", F.lit(None).cast("string").alias("text")), F.struct(F.lit(1).alias("part"), "fault", "initial", "text"))).alias("e"),
    ).select("conv_id", "turn", "role", "digest", "e.*")
    order = [F.col("conv_id"), F.col("part"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = both.where("part = 0 OR fault != '-'").repartition("conv_id").sortWithinPartitions(*order)
    schema = pa.schema([("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[int, str]] = {}  # short conversations repeat
        key, started, state, edits, place = None, False, _Faults(), None, 0
        out: list[tuple] = []
        ids: list = []
        held = 0

        def decide() -> tuple[int, str]:
            turns = (bytes(state.initials), bytes(state.faults))
            if len(turns[0]) >= LONG:
                return align_folded(*(t.decode() for t in turns))
            if turns not in known:
                if len(known) > 100_000:
                    known.clear()
                known[turns] = align(*(t.decode() for t in turns))
            return known[turns]

        def give(*row) -> None:
            nonlocal held
            out.append(row)
            ids.append(key)
            held += len(row[2] or "") + 100

        def summed() -> Iterator[tuple[str, str | None]]:
            """Give the summary, and tell the edits."""
            cost, letters = decide()
            give(0, None, None, *state.counts(), cost, letters)
            return told(letters)

        def inserted() -> str | None:
            """Give the insertions before the next turn; the role that turn gets, '' for its own, None if it goes."""
            nonlocal place
            for letter, given in edits:
                if letter == INSERT:
                    place += 1
                    give(place, given, "", *[None] * 7)
                    continue
                return None if letter == DELETE else (given or "")
            return None

        def flush() -> pa.RecordBatch:
            nonlocal out, ids, held
            columns = [pa.array([r[k] for r in out], schema.field(k).type) for k in range(len(schema))]
            whole = pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], names=["conv_id", *schema.names])
            out, ids, held = [], [], 0
            return whole

        id_type = None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for first in range(0, batch.num_rows, 2000):
                for row in batch.slice(first, 2000).to_pylist():
                    if not started or row["conv_id"] != key:
                        if started:
                            edits = edits or summed()
                            inserted()
                        key, started, state, edits, place = row["conv_id"], True, _Faults(), None, 0
                    if row["part"] == 0:
                        if row["fault"] != "-":
                            state.add(row["turn"], row["initial"], row["fault"], row["digest"])
                        continue
                    if edits is None:
                        edits = summed()
                    given = inserted()
                    if given is not None:
                        place += 1
                        give(place, given or row["role"], row["text"], *[None] * 7)
                    if held > 4 << 20:
                        yield flush()
                if out:
                    yield flush()
        if started:
            edits = edits or summed()
            inserted()
        if out:
            yield flush()

    return ordered.mapInArrow(run, REPAIRED.format(kind))


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation the summary and ``repaired_sha256`` of its ``role:text`` joined by line breaks, from the rows of ``repair`` as they come."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, sha, begun = None, hashlib.sha256(), False

        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if summary is not None:
                        done.append((*summary, sha.hexdigest()))
                    summary, sha, begun = [row[c] for c in names], hashlib.sha256(), False
                    continue
                sha.update((("\n" if begun else "") + row["role"] + ":" + row["text"]).encode())
                begun = True
            if done:
                yield _digest_rows(done, batch, names)
        if summary is not None:
            yield _digest_rows([(*summary, sha.hexdigest())], batch, names)

    return repaired.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _digest_rows(rows: list[tuple], like: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    types = [*[like.schema.field(c).type for c in names], pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*names, "repaired_sha256"])
