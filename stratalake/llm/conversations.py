"""Conversation structure repair: generalised LR parsing of role sequences with weighted edits.

The grammar of roles is `S -> T | ε`, `T -> T u a | H u a`, `H -> s | ε` (an optional system row, then pairs of user and
assistant). A row may be kept, get the other role, or be deleted, and empty rows may be inserted; every choice is followed
at once on a graph-structured stack. Stacks that become equal are merged: the one with the least (cost, audit) stays, where
the audit is the edits' initials in order. An audit tells its path, and audits of equally many rows that end with a row's
edit are never one another's beginning, so ranks among the stacks of a step replace the strings when costs are equal.

Rows are sorted by range over (conv_id, turn, role, text), equal rows counted once, so a conversation of any length is
spread over tasks. Conversations that lie within one partition are repaired there; of the others each partition gives
its part as costs from every stack top to every other one, which are then chained part by part, and the parts are
repaired between the tops so found. No task holds more of a conversation than its partition.

Nulls in conv_id (within the key that damages rows), role and text read as one space; the output keeps the null conv_id.
Null turns come first. Rows of one turn are ordered by role and text (equal rows are duplicates of the first). Roles
other than system, user and assistant count by their first letter and can be kept only where it is s, u or a. Empty tables
give no rows, conversations without rows zeros. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.tables import stored

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"

# The LR tables: what each state shifts, what it reduces (left side, length of the right side) and on which tokens.
_SHIFT = {(0, "s"): 2, (1, "u"): 4, (4, "a"): 5, (3, "u"): 6, (6, "a"): 7}
_REDUCE = {(0, "u"): ("H", 0), 2: ("H", 1), 5: ("T", 3), 7: ("T", 3)}
_GOTO = {(0, "H"): 1, (0, "T"): 3}
_ACCEPT = {0, 3}

Stack = tuple[int, ...]
#: Live stacks as (stack, cost above the least, rank of its audit).
Front = tuple[tuple[Stack, int, int], ...]


def _reduce(stack: Stack, token: str | None) -> Stack:
    while rule := _REDUCE.get(stack[-1]) or _REDUCE.get((stack[-1], token)):
        left, length = rule
        stack = stack[: len(stack) - length]
        stack = (*stack, _GOTO[stack[-1], left])
    return stack


@cache
def shift(stack: Stack, token: str) -> Stack | None:
    """The stack after a token, or None if the token can't follow."""
    stack = _reduce(stack, token)
    state = _SHIFT.get((stack[-1], token))
    return None if state is None else _reduce((*stack, state), None)


@cache
def inserts(stack: Stack) -> tuple[tuple[Stack, str], ...]:
    """Stacks within reach of inserted rows, each with the inserted tokens (the fewest)."""
    found = {stack: ""}
    queue = [stack]
    for at in queue:
        for token in ROLES:
            after = shift(at, token)
            if after is not None and after not in found:
                found[after] = found[at] + token
                queue.append(after)
    return tuple(found.items())


#: Every stack that a row can start from.
STACKS = tuple(sorted({s for start in ((0,), shift((0,), "s")) for s, _ in inserts(start)}))


@cache
def moves(stack: Stack, symbol: str) -> tuple[tuple[str, Stack, int, str], ...]:
    """Edits of a row: their letters, the stack after them, the cost, the roles of the rows that they leave.

    A symbol is the role's initial and the row's fault: b(lank), d(uplicate), t(runcated) or - (none).
    """
    initial, fault = symbol
    found = [("D", stack, DELETE, "")]
    if fault in "bd":
        return tuple(found)
    extra = CUT_OFF if fault == "t" else 0
    for reached, tokens in inserts(stack):
        letters, cost = "I" * len(tokens), INSERT * len(tokens) + extra
        if kept := shift(reached, initial):
            found.append((letters + "K", kept, cost + KEEP, tokens + "k"))
        found += [(letters + "R", s, cost + REROLE, tokens + t) for t in ROLES if t != initial and (s := shift(reached, t))]
    return tuple(found)


@cache
def advance(front: Front, symbol: str) -> tuple[Front, int, dict[Stack, tuple[Stack, str, str]]]:
    """The live stacks after a row, how much the least cost grows, and where each stack came from."""
    best: dict = {}
    for stack, cost, rank in front:
        for letters, after, price, roles in moves(stack, symbol):
            key = (cost + price, rank, letters)
            if after not in best or key < best[after][0]:
                best[after] = (key, stack, letters, roles)
    ranks = {k: n for n, k in enumerate(sorted({key[1:] for key, *_ in best.values()}))}
    least = min(key[0] for key, *_ in best.values())
    live = tuple(sorted((s, key[0] - least, ranks[key[1:]]) for s, (key, *_) in best.items()))
    return live, least, {s: (stack, letters, roles) for s, (_, stack, letters, roles) in best.items()}


def parse(symbols: Iterable[str], start: Stack) -> tuple[Front, int, list[dict]]:
    front, cost, trail = ((start, 0, 0),), 0, []
    for symbol in symbols:
        front, more, back = advance(front, symbol)
        cost += more
        trail.append(back)
    return front, cost, trail


def trace(trail: list[dict], end: Stack) -> list[tuple[str, str]]:
    """Letters and roles of every row's edits on the way to a stack."""
    steps = []
    for back in reversed(trail):
        end, letters, roles = back[end]
        steps.append((letters, roles))
    return steps[::-1]


def finish(front: Front) -> tuple[int, int, Stack, str]:
    """The cheapest end: cost above the least, rank, the stack before the last inserts, the inserted tokens."""
    return min(
        (cost + INSERT * len(tokens), rank, stack, tokens)
        for stack, cost, rank in front for reached, tokens in inserts(stack) if reached[-1] in _ACCEPT
    )


def repaired(rows: list[tuple[str, str]], steps: list[tuple[str, str]], last: str = "") -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stays of (role, text) rows, with the inserted rows."""
    for (role, text), (letters, roles) in zip(rows, steps, strict=True):
        for letter, token in zip(letters, roles, strict=False):
            if letter == "I":
                yield "I", ROLES[token], ""
            else:
                yield letter, role if letter == "K" else ROLES[token], text
    for token in last:
        yield "I", ROLES[token], ""


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """A fixed share of rows dropped, emptied, left without sentence ends, repeated, or given to the user."""
    bad = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(bad == 1, "").when(bad == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    out = rows.select("conv_id", "turn", F.when(bad == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"), bad.alias("bad"))
    return out.filter("bad <> 0").select("conv_id", "turn", "role", "text", F.when(F.col("bad") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of copies, the role's initial, and the faults that need no other row."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # The last character that is no white space decides whether a text is blank or truncated.
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    words = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    same = stored(same.select("*", fault.alias("fault"), initial.alias("initial"), words.alias("words")), "rows")
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = same.groupBy(F.col("conv_id").alias("_conv"), F.col("words").alias("_words")).agg(F.min(order).alias("_first"))
    seen = same.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("words") == F.col("_words")))
    known = (order != F.col("_first")).alias("known")
    return stored(seen.select("conv_id", "turn", "role", "text", "copies", "fault", "initial", known), "rows")


@dataclass
class Part:
    """The rows of one conversation in one partition, in order."""

    turns: list[int | None]
    rows: list[tuple[str, str]]
    symbols: list[str]

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        pairs = zip(self.symbols, self.symbols[1:], strict=False)
        faults = [s[1] for s in self.symbols]
        return {
            "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairs),
            "initials": self.symbols[0][0] + self.symbols[-1][0],
        }


def _part(rows: Iterable[tuple]) -> Part:
    """From (turn, role, text, copies, fault, initial, known) rows; copies after the first are duplicates."""
    part = Part([], [], [])
    for turn, role, text, copies, fault, initial, known in rows:
        again = initial + (fault if fault == "b" else "d")
        part.turns += [turn] * copies
        part.rows += [(role, text)] * copies
        part.symbols += [again if known else initial + fault] + [again] * (copies - 1)
    return part


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


ROW = ["turn", "role", "text", "copies", "fault", "initial", "known"]
_ROW = "turn long, role string, text string, copies long, fault string, initial string, known boolean"
_SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURN = "conv_id {kind}, part int, seq long, edit string, role string, text string"


def _first_pass(judged: DataFrame, kind: str) -> DataFrame:
    """Summaries and repaired rows of the conversations inside a partition, and the rows of those at its ends."""
    schema = f"conv_id {kind}, what string, part int, seq long, edit string, {', '.join(f'{c} long' for c in _SUMMARY)}, audit string, {_ROW}"
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"conv_id": None, "part": pa.int32(), "known": pa.bool_()} | {c: pa.int64() for c in ("seq", "turn", "copies", *_SUMMARY)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, first, out, number, of_conv = [], None, True, [], -1, None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r.get(n) for r in out], types.get(n, pa.string()) or of_conv) for n in names]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def open_rows(rows: list, start: int) -> None:
            out.extend({"what": "open", "conv_id": current[0], "part": number, "seq": start + i} | dict(zip(ROW, r, strict=True)) for i, r in enumerate(rows))

        def close() -> None:
            part = _part(held)
            front, cost, trail = parse(part.symbols, (0,))
            more, _, end, last = finish(front)
            steps, counts = trace(trail, end), part.counts()
            audit = "".join(letters for letters, _ in steps) + "I" * len(last)
            out.append(
                {c: counts[c] for c in _SUMMARY[1:-1]} | {"what": "done", "conv_id": current[0], "cost": cost + more, "audit": audit}
                | {"gaps": _gaps(counts["low"], counts["high"], counts["turns"])}
            )
            out.extend(
                {"what": "turn", "conv_id": current[0], "part": number, "seq": i, "edit": e, "role": r, "text": t}
                for i, (e, r, t) in enumerate(repaired(part.rows, steps, last))
            )

        seq = 0
        for batch in batches:
            of_conv = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "here", *ROW)]
            for conv, number, *row in zip(*columns, strict=True):  # noqa: B020
                if current is not None and (conv,) != current:
                    if not first:
                        close()
                    held, first, seq = [], False, 0
                current = (conv,)
                if first:
                    # The first one may have begun in the partition before: its rows need not be held.
                    open_rows([row], seq)
                    seq += 1
                else:
                    held.append(row)
                if len(out) >= 4096:
                    yield flush()
        if held:
            # So may the last one go on in the next.
            open_rows(held, 0)
        if out:
            yield flush()

    ordered = judged.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", F.spark_partition_id().alias("here"), *ROW).mapInArrow(run, schema)


def _sorted_part(table: pa.Table) -> Part:
    rows = table.sort_by("seq").select(ROW)
    return _part(zip(*(c.to_pylist() for c in rows.columns), strict=True))


def _segments(opened: DataFrame, kind: str) -> DataFrame:
    """Per part of a conversation: its counts, and cost and audit rank from every stack to every other."""
    schema = (
        f"conv_id {kind}, part int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
        "initials string, costs array<long>, ranks array<int>"
    )

    def run(table: pa.Table) -> pa.Table:
        part = _sorted_part(table)
        found = {}
        for a, start in enumerate(STACKS):
            front, cost, trail = parse(part.symbols, start)
            for stack, more, _ in front:
                found[a, STACKS.index(stack)] = (cost + more, "".join(letters for letters, _ in trace(trail, stack)))
        order = {audit: n for n, audit in enumerate(sorted({audit for _, audit in found.values()}))}
        cells = [found.get((a, b)) for a in range(len(STACKS)) for b in range(len(STACKS))]
        row = part.counts() | {"costs": [c and c[0] for c in cells], "ranks": [c and order[c[1]] for c in cells]}
        head = {"conv_id": table.column("conv_id").slice(0, 1), "part": table.column("part").slice(0, 1)}
        types = {"initials": pa.string(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32())}
        return pa.table(head | {k: pa.array([v], types.get(k, pa.int64())) for k, v in row.items()})

    return opened.groupBy("conv_id", "part").applyInArrow(run, schema)


def _chain(segments: DataFrame, kind: str) -> DataFrame:
    """Per conversation the summary, and per part the stacks that the best repair enters and leaves it with."""
    schema = f"conv_id {kind}, part int, enter int, leave int, last string, {', '.join(f'{c} long' for c in _SUMMARY)}"

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        size, front, back = len(STACKS), {STACKS.index((0,)): (0, 0)}, []
        for row in rows:
            best: dict = {}
            for a, (cost, rank) in front.items():
                for b in range(size):
                    if row["costs"][a * size + b] is not None:
                        key = (cost + row["costs"][a * size + b], rank, row["ranks"][a * size + b])
                        if b not in best or key < best[b][0]:
                            best[b] = (key, a)
            ranks = {k: n for n, k in enumerate(sorted({key[1:] for key, _ in best.values()}))}
            front = {b: (key[0], ranks[key[1:]]) for b, (key, _) in best.items()}
            back.append({b: a for b, (_, a) in best.items()})
        cost, _, end, last = finish(tuple((STACKS[b], *v) for b, v in front.items()))
        at, ways = STACKS.index(end), []
        for step in reversed(back):
            ways.append((step[at], at))
            at = step[at]
        known = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in known) - sum(p["high"] == q["low"] for p, q in zip(known, known[1:], strict=False))
        edges = sum(p["initials"][1] + q["initials"][0] not in ("su", "ua", "au") for p, q in zip(rows, rows[1:], strict=False))
        summary = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")} | {"cost": cost}
        summary["illegal"] = edges + sum(r["illegal"] for r in rows)
        summary["gaps"] = _gaps(known[0]["low"], known[-1]["high"], turns) if known else 0
        n = len(rows)
        columns = {
            "conv_id": table.column("conv_id"), "part": pa.array([r["part"] for r in rows], pa.int32()),
            "enter": pa.array([a for a, _ in ways[::-1]], pa.int32()), "leave": pa.array([b for _, b in ways[::-1]], pa.int32()),
            "last": pa.array([""] * (n - 1) + [last]),
        }
        # The summary stands in the last part's row.
        return pa.table(columns | {c: pa.array([None] * (n - 1) + [summary[c]], pa.int64()) for c in _SUMMARY})

    return segments.groupBy("conv_id").applyInArrow(run, schema)


def _open_turns(opened: DataFrame, ways: DataFrame, kind: str) -> DataFrame:
    """Repaired rows of the parts; one row without an edit holds the part's audit."""
    chosen = ways.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "enter", "leave", "last")
    rows = opened.join(chosen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")

    def run(table: pa.Table) -> pa.Table:
        part, head = _sorted_part(table), table.slice(0, 1).to_pylist()[0]
        _, _, trail = parse(part.symbols, STACKS[head["enter"]])
        steps = trace(trail, STACKS[head["leave"]])
        found = [(None, None, "".join(letters for letters, _ in steps) + "I" * len(head["last"])), *repaired(part.rows, steps, head["last"])]
        columns = {
            "conv_id": pa.array([head["conv_id"]] * len(found), table.schema.field("conv_id").type),
            "part": pa.array([head["part"]] * len(found), pa.int32()), "seq": pa.array(range(-1, len(found) - 1), pa.int64()),
        }
        return pa.table(columns | {n: pa.array([f[i] for f in found], pa.string()) for i, n in enumerate(("edit", "role", "text"))})

    return rows.groupBy("conv_id", "part").applyInArrow(run, _TURN.format(kind=kind))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations given as rows (conv_id, turn, role, text) with an optional number of copies.

    Returns a summary per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) and the repaired
    rows (conv_id, part, seq, edit, role, text), in the order of (part, seq) within a conversation.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long").alias("copies")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), copies)
    first = stored(_first_pass(_judged(rows), kind), "parsed")
    done = first.filter("what = 'done'").select("conv_id", *_SUMMARY, "audit")
    turns = first.filter("what = 'turn'").select("conv_id", "part", "seq", "edit", "role", "text")

    opened = first.filter("what = 'open'").select("conv_id", "part", "seq", *ROW)
    ways = stored(_chain(_segments(opened, kind), kind), "ways")
    found = stored(_open_turns(opened, ways, kind), "turns")
    pieces = found.filter("edit is null").groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    audits = pieces.select("_conv", F.array_join("p.text", "").alias("audit"))
    summary = ways.filter("cost is not null").join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", *_SUMMARY, "audit")
    return done.union(summary), turns.union(found.filter("edit is not null"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of all `role:text`, joined by line feeds. A digest has to see a conversation's rows one
    after the other: they pass one task as a sorted stream, of which it holds one batch at a time."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, ids, found = None, None, [], []
        for batch in batches:
            of_conv = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if (conv,) == current:
                    digest.update(b"\n" + line)
                    continue
                if current is not None:
                    ids.append(current[0])
                    found.append(digest.hexdigest())
                current, digest = (conv,), hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, of_conv), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
            ids, found = [], []
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current[0]], of_conv), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """Damage `conversations`, repair them, and describe every original conversation."""
    summary, turns = repair(damage(conversations))
    every = conversations.select("conv_id").distinct()
    summary = summary.withColumnRenamed("conv_id", "_conv")
    hashes = digests(turns).withColumnRenamed("conv_id", "_hashed")
    joined = every.join(summary, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    joined = joined.join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _SUMMARY), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
