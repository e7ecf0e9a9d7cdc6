"""Conversation structure repair: damaged conversations, their faults, and the cheapest edits that make them well formed.

Well formed means that the initials of the roles read ``(s?(ua)+)?``. Edits: keep a turn (K, 0), change its role to user or
assistant (R, 2), delete it (D, 3; blank and duplicate turns must go), insert an empty turn (I, 2); a truncated turn that
stays adds 1.

The dynamic programme goes over the turns that are retained (kept or with a changed role), from the last to the first. With
the initial r of the last retained turn as state, the cheapest rest from place j is

    H(r, j) = min over the next retained turn k >= j as x of  D(k) - D(j) + inserts(r, x) + own(k, x) + H(x, k + 1)

where D are prefix sums of deletion costs and the pair (r, x) determines the inserts. For each x the minimum of the terms in
k alone is carried along, so a turn costs a few steps whatever the gaps. Of equally cheap edits the walk forward takes the
ASCII-least audit: a deletion if one is on a cheapest way, else the inserts, else keeping, else a new role.

Tasks read conversations as sorted runs of rows, one at a time. A conversation of more than ``LONG`` turns or ``BYTES`` of text
is cut into chunks of ``CHUNK`` turns by ranges of its order. A chunk's costs from each state to each state are a small
matrix, so the rest's costs after each chunk come from the matrices alone; each chunk is then walked from every state, and the
chain of chunks picks the walks. Only the digest reads such a conversation in one stream, a chunk at a time, as a hash must.

Defined results: null conv_id, turn, role and text read as one space in what is hashed, compared and repaired; rows go by turn
(nulls first), of one turn by role, then text; conversations without rows after damage give zeros, an empty audit and the
digest of the empty string; a null conv_id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

LONG, BYTES = 20_000, 32 << 20  # turns and bytes of text of a conversation that a task holds at once
CHUNK, CHUNK_BYTES = 4096, 8 << 20
EVERY = 20  # damage by the hash modulo this
FULL = {"u": "user", "a": "assistant"}
STATES = ("", "s", "u", "a")  # initial of the last retained turn; none yet
# inserts between a retained turn and the next one; what isn't listed can't follow
INSERTS = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
LAST = {"": "", "s": "ua", "u": "a", "a": ""}  # inserts after the last retained turn
LEGAL = {"su", "ua", "au"}
INF, NEVER = float("inf"), 1 << 60  # a state that can't be reached; the same in a table
_SPACE = "\x20\t\n\x0b\x0c\r"


class Turn:
    """What the programme knows of a turn: initial, whether it may stay, the cost of its staying, and its copies."""

    __slots__ = ("cost", "initial", "many", "stays")

    def __init__(self, initial: str, stays: bool, cut: bool, many: int = 1):
        self.initial, self.stays, self.cost, self.many = initial, stays, int(cut), many


def fault(text: str, again: bool) -> str:
    """The first fault of a turn: blank, duplicate (``again``: role and text came before), truncated, or none."""
    end = text.rstrip(_SPACE)
    return "blank" if not end else "duplicate" if again else "" if end[-1] in ".!?" else "truncated"


def rests(turns: list[Turn], end: dict[str, int]) -> list[dict[str, int]]:
    """H by place and state; ``end`` has the cost of what follows the last turn, by state."""
    n = len(turns)
    sums = [0]
    for t in turns:
        sums.append(sums[-1] + 3 * t.many)
    least = dict.fromkeys("sua", INF)  # by x, over the turns from j on
    rows = [end]
    for j in range(n - 1, -1, -1):
        t, after = turns[j], rows[-1]
        if t.stays:
            more = sums[j] + t.cost + 3 * (t.many - 1)
            for x in "sua":
                if x == t.initial or x != "s":
                    own = more + after[x] + (0 if x == t.initial else 2)
                    if own < least[x]:
                        least[x] = own
        all_gone = sums[n] - sums[j]
        rows.append({r: min(all_gone + end[r], min((least[x] - sums[j] + 2 * len(INSERTS[r, x]) for x in "sua" if (r, x) in INSERTS), default=INF)) for r in STATES})
    rows.reverse()
    return rows


ENDS = {r: 2 * len(x) for r, x in LAST.items()}


def walk(turns: list[Turn], rest: list[dict[str, int]], state: str) -> tuple[list[tuple[str, str]], str]:
    """The ASCII-least cheapest edits from a state as (letters, role): one item a turn; and the state after them.

    The letters of a turn are its deletion, or inserts and K or R, and the deletions of its copies; the role is a retained turn's initial.
    """
    out = []
    for j, t in enumerate(turns):
        here, after = rest[j][state], rest[j + 1]
        if here == 3 * t.many + after[state]:
            out.append(("D" * t.many, ""))
            continue
        best = None
        for x in "sua":
            if (state, x) in INSERTS and (x == t.initial or x != "s"):
                ins, new = INSERTS[state, x], x != t.initial
                if here == 2 * len(ins) + t.cost + 2 * new + 3 * (t.many - 1) + after[x]:
                    letters = "I" * len(ins) + ("R" if new else "K")
                    if best is None or letters < best[0]:
                        best = (letters, x)
        out.append((best[0] + "D" * (t.many - 1), best[1]))
        state = best[1]
    return out, state


def repaired(rows: list[tuple[str, str]], steps: list[tuple[str, str]], state: str) -> Iterator[tuple[str, str]]:
    """Role and text of what stays or is inserted; ``state`` is the one before the first step."""
    for (role, text), (letters, x) in zip(rows, steps, strict=True):
        if x:
            yield from ((FULL[i], "") for i in INSERTS[state, x])
            yield (FULL[x] if "R" in letters else role), text
            state = x


def _digest(parts) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in parts).encode("utf-8", "surrogatepass")).hexdigest()


def solved(rows: list[tuple[str, str]]) -> dict:
    """All results of one conversation's rows (role, text) in order, but for ``gaps``."""
    count, seen, turns = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for row in rows:
        what = fault(row[1], row in seen)
        seen.add(row)
        if what:
            count[what] += 1
        turns.append(Turn(row[0][:1], what not in ("blank", "duplicate"), what == "truncated"))
    rest = rests(turns, ENDS)
    steps, state = walk(turns, rest, "")
    parts = [*repaired(rows, steps, ""), *((FULL[i], "") for i in LAST[state])]
    illegal = sum(a.initial + b.initial not in LEGAL for a, b in zip(turns, turns[1:], strict=False))
    return count | {"illegal": illegal, "cost": rest[0][""], "audit": "".join(s for s, _ in steps) + "I" * len(LAST[state]), "repaired_sha256": _digest(parts)}


def damaged(conversations: DataFrame, every: int = EVERY) -> DataFrame:
    """conv_id, turn, role, text, alive: a dropped row stays as one that isn't ``alive``; nulls of role and text are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % every
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    said = F.when(F.col("code") == 0, F.lit("")).when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return x.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("code") != 0).alias("alive"), copies.alias("__copy")).drop("__copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def _table(out: list[dict]) -> pa.RecordBatch:
    types = {"conv_id": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in out], t) for k, t in types.items()})


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that a task holds one at a time, as sorted runs."""

    def run(batches):
        at, held, turns, out, begun = None, [], set(), [], False

        def done():
            return solved(held) | {"conv_id": at, "gaps": _gaps(turns)}

        for b in batches:
            for conv, turn, role, text, alive in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "alive")), strict=True):
                if not begun or conv != at:
                    if begun:
                        out.append(done())
                        if len(out) >= 2000:
                            yield _table(out)
                            out = []
                    at, held, turns, begun = conv, [], set(), True
                if alive:
                    held.append((role, text))
                    if turn is not None:
                        turns.add(turn)
        if begun:
            out.append(done())
        if out:
            yield _table(out)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


_KEYS = ["conv", "part", "chunk"]


def _long(rows: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """Conversations of any length, cut into chunks; equal rows of one turn are one row with its number of copies."""
    alive = written(rows.where("alive").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).drop("alive"), "long-turns")
    once = alive.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("many"))
    # a role and text are new in their first turn; null turns come first
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    named = [F.col(c).alias(f"first_{c}") for c in ("conv", "role", "text")]
    first = once.groupBy(*named).agg(F.min(place).alias("p")).withColumns({"first_turn": F.col("p.turn"), "new": F.lit(True)}).drop("p")
    on = F.lit(True)
    for c in ("conv", "turn", "role", "text"):
        on = on & F.col(c).eqNullSafe(F.col(f"first_{c}"))
    marked = once.join(first, on, "left").select("conv", "turn", "role", "text", "many", F.coalesce("new", F.lit(False)).alias("new"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]

    def number(batches):
        """Numbers the rows of a range in their order and cuts them into chunks."""
        at, k, seq, held = None, -1, 0, 0
        for b in batches:
            chunks, seqs = [], []
            for conv, text in zip(b.column("conv").to_pylist(), b.column("text").to_pylist(), strict=True):
                if conv != at or seq >= chunk or held >= chunk_bytes:
                    at, k, seq, held = conv, k + 1, 0, 0
                chunks.append(k)
                seqs.append(seq)
                seq, held = seq + 1, held + len(text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunks, pa.int64()), pa.array(seqs, pa.int64())], [*b.schema.names, "chunk", "seq"])

    ranged = marked.repartitionByRange(4 * partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    turns = written(ranged.mapInArrow(number, "conv string, turn long, role string, text string, many long, new boolean, part long, chunk long, seq long"), "long-chunks")

    def read(t: pa.Table) -> tuple[list[tuple[str, str]], list[Turn], dict[str, int]]:
        t = t.sort_by("seq")
        rows, items, count = list(zip(t.column("role").to_pylist(), t.column("text").to_pylist(), strict=True)), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for (role, text), many, new in zip(rows, t.column("many").to_pylist(), t.column("new").to_pylist(), strict=True):
            what = fault(text, not new)
            gone = what in ("blank", "duplicate")
            if what:
                count[what] += many if gone else 1
            count["duplicate"] += 0 if gone else many - 1
            items.append(Turn(role[:1], not gone, what == "truncated", many))
        return rows, items, count

    def matrix(t: pa.Table) -> pa.Table:
        """Costs from state to state, faults and the initials at either end of a chunk."""
        _, items, count = read(t)
        to = [rests(items, {r: 0 if r == x else INF for r in STATES})[0] for x in STATES]
        inside = sum(a.initial + b.initial not in LEGAL for a, b in zip(items, items[1:], strict=False)) + sum(i.many - 1 for i in items)
        cell = {"conv": t.column("conv")[0].as_py(), "part": t.column("part")[0].as_py(), "chunk": t.column("chunk")[0].as_py(), **count, "illegal": inside, "costs": [NEVER if x[r] == INF else x[r] for r in STATES for x in to], "ends": items[0].initial + "\n" + items[-1].initial}
        return pa.Table.from_pylist([cell], pa.schema([("conv", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("costs", pa.list_(pa.int64())), ("ends", pa.string())]))

    cells = written(turns.groupBy(*_KEYS).applyInArrow(matrix, "conv string, part long, chunk long, blank long, duplicate long, truncated long, illegal long, costs array<long>, ends string"), "long-costs")

    def following(t: pa.Table) -> pa.Table:
        """For each chunk of a conversation the cheapest rest after it, by state; and the conversation's sums."""
        cells = t.sort_by([("part", "ascending"), ("chunk", "ascending")]).to_pylist()
        after, rest = [], ENDS
        for c in reversed(cells):
            after.append([rest[r] for r in STATES])
            rest = {r: min(c["costs"][4 * i + k] + rest[x] for k, x in enumerate(STATES)) for i, r in enumerate(STATES)}
        last = None
        for c, end in zip(cells, reversed(after), strict=True):
            a, b = c["ends"].split("\n")
            c |= {"after": end, "cost": rest[""], "illegal": c["illegal"] + (last is not None and last + a not in LEGAL)}
            last = b
        return pa.Table.from_pylist([{k: c[k] for k in ("conv", "part", "chunk", "blank", "duplicate", "truncated", "illegal", "cost", "after")} for c in cells])

    planned = written(cells.groupBy("conv").applyInArrow(following, "conv string, part long, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, after array<long>"), "long-rests")

    def walks(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's edits and repaired rows from each state, and the state that each leads to."""
        rows, items, _ = read(left)
        rest = rests(items, dict(zip(STATES, right.column("after")[0].as_py(), strict=True)))
        out = []
        for r in STATES:
            steps, state = walk(items, rest, r)
            out.append({"conv": key[0].as_py(), "part": key[1].as_py(), "chunk": key[2].as_py(), "entry": r, "leaves": state, "audit": "".join(s for s, _ in steps), "said": "".join(f"\n{x}:{y}" for x, y in repaired(rows, steps, r))})
        return pa.Table.from_pylist(out)

    went = written(turns.groupBy(*_KEYS).cogroup(planned.groupBy(*_KEYS)).applyInArrow(walks, "conv string, part long, chunk long, entry string, leaves string, audit string, said string"), "long-walks")

    def followed(batches):
        """The walks of each conversation that follow one another, from states alone: no text moves for the others."""
        at, state, chunk = None, "", None
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                if r["conv"] != at:
                    at, state, chunk = r["conv"], "", None
                here = (r["part"], r["chunk"])
                if here != chunk and r["entry"] == state:
                    chunk, state = here, r["leaves"]
                    out.append(r)
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], b.schema.field(c).type) for c in b.schema.names}, schema=b.schema)

    states = went.select("conv", "part", "chunk", "entry", "leaves").repartition("conv").sortWithinPartitions("conv", "part", "chunk")
    walked = states.mapInArrow(followed, "conv string, part long, chunk long, entry string, leaves string").drop("leaves")

    def chained(batches):
        """The edits and the digest of each conversation, a chunk at a time."""
        at = state = digest = audit = None
        first = True

        def result():
            for i in LAST[state]:
                add(f"\n{FULL[i]}:")
            return pa.RecordBatch.from_pydict({"conv": [at], "audit": ["".join(audit) + "I" * len(LAST[state])], "repaired_sha256": [digest.hexdigest()]})

        def add(said):
            nonlocal first
            if said:
                digest.update(said[1 if first else 0 :].encode("utf-8", "surrogatepass"))
                first = False

        for b in batches:
            for r in b.to_pylist():
                if r["conv"] != at:
                    if at is not None:
                        yield result()
                    at, digest, audit, first = r["conv"], hashlib.sha256(), [], True
                state = r["leaves"]
                audit.append(r["audit"])
                add(r["said"])
        if at is not None:
            yield result()

    texts = went.join(walked, [*_KEYS, "entry"]).select(*_KEYS, "leaves", "audit", "said").repartition("conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(chained, "conv string, audit string, repaired_sha256 string")
    sums = planned.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.max("cost").alias("cost"))
    gaps = alive.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"))
    told = turns.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    gaps = gaps.join(told, "conv", "left").select("conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    every = sums.join(gaps, "conv").join(texts, "conv")
    return every.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), *[F.col(c).cast("long").alias(c) for c in COUNTS], "audit", "repaired_sha256")


def repair(conversations: DataFrame, every: int = EVERY, most: int = LONG, most_bytes: int = BYTES, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Query form: one row for each original conv_id with gaps, faults, cost, audit and the digest of the repaired turns."""
    rows = damaged(conversations, every)
    size = rows.where("alive").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = size.where((F.col("n") > most) | (F.col("bytes") > most_bytes)).select("conv_id")
    long = written(long, "long-conversations")
    if not (many := long.count()):
        return _short(rows)
    one = long.withColumnRenamed("conv_id", "long_id")
    one = F.broadcast(one) if many <= 1_000_000 else one
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(one, is_long, "left_anti")).union(_long(rows.join(one, is_long, "left_semi"), chunk, chunk_bytes))
