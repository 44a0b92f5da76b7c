"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation is an optional system turn and pairs of a user's and
an assistant's turn.  Turns may be kept, given another role, deleted or
inserted, each at a price; the cheapest edits are found by depth-first branch
and bound.  Sorted turns are read in pieces, so that a conversation of any
length is spread over tasks: a piece gives the cheapest edits between any two
states of the role order, and pieces are joined state by state.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwise.frames import null_safe_join
from shoalwise.llm.common import staged

# Prices of the edits (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: What has been said so far: nothing, a system turn, a user's last, an assistant's last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The role initial that comes next, and the state it leads to; only SYSTEM may also begin.
NEXT = {NOTHING: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ENDS = (NOTHING, ASSISTANT)
#: Turns, and characters, after which a piece ends.
PIECE_TURNS = 128
PIECE_CHARS = 1 << 21
_BLANKS = "\\x20\\x09-\\x0D"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row with this role initial, None if it may not stand there."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    wanted, after = NEXT[state]
    return after if initial == wanted else None


def least_prices(rows: list[tuple[str, int]]) -> list[int]:
    """What the rows from each position on cost at least, whatever stands around them.

    Sums the dearer of single rows and of neighbours that cannot both be kept
    as they are: no edit belongs to two of the parts, so the sum is a bound.
    """
    own = []
    for initial, fault in rows:
        if fault in (BLANK, DUPLICATE):
            own.append(DELETE)
        else:
            extra = TRUNCATED if fault == CUT else 0
            own.append(min((0 if initial in ("s", "u", "a") else REROLE) + extra, DELETE))
    out = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = own[i] + out[i + 1]
        if i + 1 < len(rows):
            (a, x), (b, y) = rows[i], rows[i + 1]
            stands = x in (SOUND, CUT) and y in (SOUND, CUT)
            if stands and a in ("s", "u", "a") and b in ("s", "u", "a") and a + b not in ("su", "ua", "au"):
                # the pair needs an edit besides what its rows cost when both stay
                both = own[i] + own[i + 1] + min(INSERT, REROLE)
                one = min(own[i], own[i + 1]) + DELETE
                out[i] = max(out[i], min(both, one) + out[i + 2])
    return out


def cheapest(
    rows: list[tuple[str, int]], start: int = NOTHING, ends: tuple[int, ...] = ENDS, limit: float = math.inf
) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way from ``start`` to one of ``ends``; equal costs by the edits' text.

    None if there is no way that costs at most ``limit``.

    ``rows`` are role initials with their first fault.  Edits are K (keep), R
    (new role), D (delete) and I (insert).  Depth-first branch and bound with
    an explicit stack: a prefix goes if its cost and the bound of the rest
    exceed the incumbent's, or if the same position and state was reached by a
    better prefix.  Prefixes at the same position and state have consumed the
    same rows, so at equal cost none begins another and their order is that of
    the whole texts.
    """
    n = len(rows)
    bound = least_prices(rows)
    # inserts that lead from a state to an end, when no row is left
    closing = []
    for state in range(4):
        steps, at = 0, state
        while at not in ends and steps < 3:
            at, steps = NEXT[at][1], steps + 1
        closing.append(steps * INSERT if at in ends else math.inf)

    def children(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Edit, price, position and state, in the order of the edits' names."""
        wanted, after = NEXT[state]
        out = []
        if i < n:
            out.append(("D", DELETE, i + 1, state))
        out.append(("I", INSERT, i, after))
        if i < n:
            initial, fault = rows[i]
            if fault in (SOUND, CUT):
                extra = TRUNCATED if fault == CUT else 0
                kept = kept_state(state, initial)
                if kept is not None:
                    out.append(("K", extra, i + 1, kept))
                out.append(("R", REROLE + extra, i + 1, after))
        return out

    # a first incumbent: always the child whose price and bound are least
    best: tuple[float, str] = (limit + 0.5, "")
    cost, edits, i, state = 0, "", 0, start
    seen: set[tuple[int, int]] = set()
    while i < n or state not in ends:
        if (i, state) in seen or (i == n and closing[state] == math.inf):
            break
        seen.add((i, state))
        options = [c for c in children(i, state) if (c[2], c[3]) not in seen]
        if not options:
            break
        name, price, i, state = min(options, key=lambda c: (c[1] + bound[c[2]], c[0]))
        cost, edits = cost + price, edits + name
    else:
        best = min(best, (cost, edits))

    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while stack:
        cost, edits, i, state = stack.pop()
        here = (i, state)
        held = table.get(here)
        if held is not None and held <= (cost, edits):
            continue
        rest = bound[i] if i < n else closing[state]
        if cost + rest > best[0] or (cost + rest == best[0] and edits > best[1][: len(edits)]):
            continue
        table[here] = (cost, edits)
        if i == n and state in ends and (cost, edits) < best:
            best = (cost, edits)
        # the last pushed is looked at first, so edits come in the order of their names
        for name, price, j, after in reversed(children(i, state)):
            stack.append((cost + price, edits + name, j, after))
    return (int(best[0]), best[1]) if best[0] <= limit and best[0] < math.inf else None


def ways_through(rows: list[tuple[str, int]], begins: bool, ends: bool) -> list[dict]:
    """The cheapest edits of a piece from every state before it to every state after it.

    A piece that is a whole conversation needs one way.  States that an other
    state outgrows, whatever follows, are left out.
    """
    if begins and ends:
        cost, edits = cheapest(rows)
        return [{"start": NOTHING, "end": ASSISTANT, "cost": cost, "edits": edits}]
    out = []
    for start in (NOTHING,) if begins else (NOTHING, SYSTEM, USER, ASSISTANT):
        said, answered = cheapest(rows, start, (USER,)), cheapest(rows, start, (ASSISTANT,))
        least = min(said[0] + INSERT, answered[0])
        found = {
            USER: said, ASSISTANT: answered,
            SYSTEM: cheapest(rows, start, (SYSTEM,), least), NOTHING: cheapest(rows, start, (NOTHING,), least + DELETE),
        }
        out += [{"start": start, "end": end, "cost": way[0], "edits": way[1]} for end, way in found.items() if way is not None]
    return out


def outgrown(costs: dict[int, int]) -> set[int]:
    """States whose cost another state can beat whatever follows.

    What follows SYSTEM fits ASSISTANT; USER and ASSISTANT are an insert
    apart; what follows NOTHING fits ASSISTANT but for a system turn, which
    can be deleted.
    """
    least = min(costs[USER] + INSERT if USER in costs else math.inf, costs.get(ASSISTANT, math.inf))
    over = {NOTHING: DELETE, SYSTEM: 0, ASSISTANT: 0}
    gone = {s for s, extra in over.items() if s in costs and costs[s] > least + extra}
    if USER in costs and costs[USER] > costs.get(ASSISTANT, math.inf) + INSERT:
        gone.add(USER)
    return gone


@dataclass
class Path:
    """The best edits up to a state: cost, the text not shared by all states, and the pieces' choices."""

    cost: int
    tail: str
    choices: tuple | None


def _role(name: Column) -> Column:
    return F.coalesce(name.cast("string"), F.lit(" "))


PIECES = (
    "conv_id long, part int, number int, roles array<string>, texts array<string>, ways array<struct<start:int,end:int,cost:long,edits:string>>, "
    "counts array<long>, initials array<string>, turns array<long>, distinct long"
)
CHOICES = (
    "conv_id long, part int, number int, start int, edits string, first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _fault_columns(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, the fault of the first of them, and whether it repeats an earlier turn."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    single = staged(
        rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", digest), "repair-rows"
    )
    told = (
        single.groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("earliest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("conv_id", "role", "digest", F.col("earliest.turn").alias("earliest"), F.lit(True).alias("again"))
    )
    joined = null_safe_join(single, told, ["conv_id", "role", "digest"], "left")
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("earliest"))
    last = F.regexp_extract("text", f"([^{_BLANKS}])[{_BLANKS}]*\\z", 1)
    fault = (
        F.when(last == "", BLANK).when(later, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of at most ``PIECE_TURNS`` turns of a sorted partition, with the cheapest edits between their states."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    number = 0
    began = False  # whether what is held begins a conversation for sure: the partition's first may have begun before
    current: object = ()
    held: list[tuple[int | None, str, str, int]] = []
    chars = 0

    def piece(begins: bool, ends: bool) -> dict:
        nonlocal number
        rows = [(role[:1], fault) for _, role, _, fault in held]
        initials = [r for r, _ in rows]
        turns = [t for t, *_ in held if t is not None]
        row = {
            "conv_id": current, "part": part, "number": number,
            "roles": [r for _, r, _, _ in held], "texts": [t for _, _, t, _ in held],
            "ways": ways_through(rows, begins, ends),
            "counts": [sum(f == x for _, f in rows) for x in (BLANK, DUPLICATE, CUT)]
            + [sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))],
            "initials": [initials[0], initials[-1]], "turns": [turns[0], turns[-1]] if turns else [], "distinct": len(set(turns)),
        }
        number += 1
        return row

    for batch in batches:
        out = []
        for conv, turn, role, text, copies, fault in zip(
            batch["conv_id"].astype("Int64"), batch["turn"].astype("Int64"), batch["role"], batch["text"], batch["copies"], batch["fault"], strict=True
        ):
            key = None if conv is pd.NA else int(conv)
            for copy in range(copies):
                if key != current or len(held) >= PIECE_TURNS or chars >= PIECE_CHARS:
                    if held:
                        out.append(piece(began, key != current))
                        began = key != current
                    current, held, chars = key, [], 0
                worst = fault if copy == 0 or fault == BLANK else DUPLICATE
                held.append((None if turn is pd.NA else int(turn), role, text, worst))
                chars += len(text)
        if out:
            yield _frame(out)
    if held:
        yield _frame([piece(began, False)])


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"conv_id": "Int64"})


def _choices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the pieces of each conversation, which come in order, and says what each piece's edits are."""
    current: object = ()
    order: list[tuple[int, int]] = []
    paths: dict[int, Path] = {}
    settled: list[str] = []
    totals = [0, 0, 0, 0]
    last_initial, last_turn, ends, distinct = None, None, None, 0

    def done() -> list[dict]:
        end = min((s for s in ENDS if s in paths), key=lambda s: (paths[s].cost, paths[s].tail))
        path = paths[end]
        picked, at = [], path.choices
        while at is not None:
            at, choice = at
            picked.append(choice)
        gaps = ends[1] - ends[0] + 1 - distinct if ends else 0
        audit = "".join([*settled, path.tail])
        rows = []
        for i, ((part, number), (start, edits)) in enumerate(zip(order, reversed(picked), strict=True)):
            head = (gaps, *totals, path.cost, audit) if i == 0 else (None,) * 7
            rows.append(dict(zip(
                ("conv_id", "part", "number", "start", "edits", "first", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
                (current, part, number, start, edits, i == 0, *head), strict=True,
            )))
        return rows

    for batch in batches:
        out: list[dict] = []
        for conv, part, number, ways, counts, initials, turns, own in zip(
            batch["conv_id"].astype("Int64"), batch["part"], batch["number"], batch["ways"], batch["counts"], batch["initials"], batch["turns"], batch["distinct"], strict=True
        ):
            key = None if conv is pd.NA else int(conv)
            if key != current:
                if order:
                    out.extend(done())
                current, order, settled, totals = key, [], [], [0, 0, 0, 0]
                paths = {NOTHING: Path(0, "", None)}
                last_initial, last_turn, ends, distinct = None, None, None, 0
            order.append((int(part), int(number)))
            for x in range(4):
                totals[x] += int(counts[x])
            if last_initial is not None and last_initial + initials[0] not in ("su", "ua", "au"):
                totals[3] += 1
            last_initial = initials[1]
            if len(turns):
                distinct += int(own) - (last_turn == turns[0])
                ends = (int(turns[0]) if ends is None else ends[0], int(turns[1]))
                last_turn = turns[1]
            after: dict[int, Path] = {}
            for way in ways:
                path = paths.get(way["start"])
                if path is None:
                    continue
                cost, tail = path.cost + way["cost"], path.tail + way["edits"]
                known = after.get(way["end"])
                if known is None or (cost, tail) < (known.cost, known.tail):
                    after[way["end"]] = Path(cost, tail, (path.choices, (way["start"], way["edits"])))
            for state in outgrown({s: p.cost for s, p in after.items()}):
                del after[state]
            shared = commonprefix([p.tail for p in after.values()])
            settled.append(shared)
            paths = {s: Path(p.cost, p.tail[len(shared) :], p.choices) for s, p in after.items()}
        if out:
            yield _frame(out)
    if order:
        yield _frame(done())


def repaired_turns(edits: str, start: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """Role and text of the turns that the edits leave of a piece."""
    full = {"u": "user", "a": "assistant"}
    out, at, state = [], 0, start
    for edit in edits:
        wanted, after = NEXT[state]
        if edit == "I":
            out.append((full[wanted], ""))
            state = after
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "K":
            out.append((role, text))
            state = kept_state(state, role[:1])
        elif edit == "R":
            out.append((full[wanted], text))
            state = after
    return out


@dataclass
class Repair:
    """``summary``: a row per conversation; ``turns``: its repaired turns, a row per piece in the order of part and number."""

    summary: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Count the faults of each conversation and find its cheapest repair.

    A turn's first fault counts: blank, a repetition of an earlier turn's role
    and text, or cut off (its last character that is not white space is none
    of ``.!?``).  Blank and repeated turns must be deleted.  Turns come by
    ``turn``, NULL first, equal ones by role, then text.

    NULL roles and texts are one space, and NULL is a conversation of its own.
    Repeated rows are repeated turns.  A role without characters, like one of
    another initial, cannot be kept.  Empty tables give no rows; other columns
    are ignored.  Turns are dealt by range, so a conversation of any length is
    spread over tasks; only edits and a few counts of it come together.

    ``summary`` has conv_id, gaps, blank, duplicate, truncated, illegal, cost
    and audit; ``turns`` has conv_id, part, number, roles and texts.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        _role(F.col(role)).alias("role"),
        _role(F.col(text)).alias("text"),
    )
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    # the range's text is only its beginning: longer texts differ rarely there, and equal ones stay in one task unharmed
    cut = [*keys[:3], F.substring("text", 1, 64)]
    dealt = _fault_columns(rows).repartitionByRange(*cut).sortWithinPartitions(*keys)
    pieces = staged(dealt.mapInPandas(_pieces, PIECES), "repair-pieces")
    narrow = pieces.drop("roles", "texts")
    chosen = staged(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInPandas(_choices, CHOICES), "repair-choices")
    summary = chosen.where("first").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    at = ["conv_id", "part", "number"]
    both = null_safe_join(pieces.select(*at, "roles", "texts"), chosen.select(*at, "start", "edits"), at)

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [
                repaired_turns(edits, int(start), list(roles), list(said))
                for edits, start, roles, said in zip(batch["edits"], batch["start"], batch["roles"], batch["texts"], strict=True)
            ]
            yield batch[at].assign(roles=[[r for r, _ in x] for x in left], texts=[[t for _, t in x] for x in left])

    return Repair(summary, both.mapInPandas(repaired, "conv_id long, part int, number int, roles array<string>, texts array<string>"))


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, read in order and never held together."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = ()
        digest, empty = None, True
        for batch in batches:
            out = []
            for conv, roles, texts in zip(batch["conv_id"].astype("Int64"), batch["roles"], batch["texts"], strict=True):
                key = None if conv is pd.NA else int(conv)
                if digest is None or key != current:
                    if digest is not None:
                        out.append({"conv_id": current, "repaired_sha256": digest.hexdigest()})
                    current, digest, empty = key, hashlib.sha256(), True
                for role, text in zip(roles, texts, strict=True):
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if out:
                yield _frame(out)
        if digest is not None:
            yield _frame([{"conv_id": current, "repaired_sha256": digest.hexdigest()}])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    return ordered.select("conv_id", "roles", "texts").mapInPandas(read, "conv_id long, repaired_sha256 string")


def repair_digests(conversations: DataFrame, repair: Repair) -> DataFrame:
    """The summary and the digest of the repaired turns, for each conversation listed; one without turns counts nothing."""
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    known = null_safe_join(repair.summary, digests(repair.turns), ["conv_id"], "left")
    return null_safe_join(conversations, known, ["conv_id"], "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        *[F.coalesce(c, F.lit(nothing)).alias(c) for c, nothing in texts.items()],
    )


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv:turn`` modulo 20; NULL values count as one space there.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats
    it, 4 makes it a user's.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spelt(conv), F.lit(":"), spelt(turn)).cast("binary")) % 20
    said = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(spelt(text), "[.!?]", "")).otherwise(spelt(text))
    return turns.where(lot != 0).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(lot == 4, "user").otherwise(spelt(role)).alias("role"),
        said.alias("text"),
        F.explode(F.when(lot == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
