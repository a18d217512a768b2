"""Structure repair of conversations: the cheapest edits that leave role initials ``(s?(ua)+)?``.

The search is depth-first branch and bound over (row, state), with an explicit stack. Lower bounds of all suffixes, the incumbent (cost, audit) and
the best prefix known at every node (its dominance table) cut worse prefixes; when the stack runs empty the incumbent is proved. A conversation is searched in segments of bounded length, each with the exact cost of all that follows it as its tail. Those tails, and
the states in which segments are entered, come from scans over a tree of segments, so a conversation of any length needs no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from .order import numbered

SEGMENT = 256  # rows searched at once
FAN = 64  # segments, or spans of them, that meet in one row of a scan
_NEVER = 1 << 40
_SPACE = " \t\n\x0b\f\r"
# states: nothing yet, after s, after u, after a. Cost of what is inserted when a conversation ends there, and the initial that comes next
_END = (0, 4, 2, 0)
_NEXT = "uuau"
_MOVE = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
# one character a row: initials of whole rows, of truncated ones, of rows that have to go; x is any other initial
_CODES = "suaxSUAXpqrt"
_INITIALS = dict(zip(_CODES, "suax" * 3))
_ROLES = {"u": "user", "a": "assistant"}


def _steps(code: str, q: int) -> list[tuple[int, str, int, int]]:
    """Edits at a row in state ``q``: (cost, letter, rows taken, next state)."""
    steps = [(3, "D", 1, q), (2, "I", 0, _MOVE[q, _NEXT[q]])]
    if code not in "pqrt":
        cut = 0 if code in "suax" else 1
        if (q, _INITIALS[code]) in _MOVE:
            steps.append((cut, "K", 1, _MOVE[q, _INITIALS[code]]))
        steps.append((2 + cut, "R", 1, _MOVE[q, _NEXT[q]]))
    return steps


_STEPS = {(c, q): _steps(c, q) for c in _CODES for q in range(4)}


def suffix_bounds(codes: str, tail: tuple[int, ...]) -> list[list[int]]:
    """For every row and state a cost that no edits of the rest can be below, audits aside."""
    low = [list(tail)]
    for code in reversed(codes):
        here = [min(c + low[-1][to] for c, _, taken, to in _STEPS[code, q] if taken) for q in range(4)]
        for q in (2, 3, 2, 1, 0):  # an insert leads on within the row
            here[q] = min(here[q], 2 + here[_MOVE[q, _NEXT[q]]])
        low.append(here)
    return low[::-1]


def search(codes: str, entry: int, tail: tuple[int, ...]) -> tuple[int, str, int]:
    """(cost with its tail, audit, exit state) of the cheapest edits of ``codes`` from state ``entry``, ties by audit. Inserts stand before a row."""
    n, low = len(codes), suffix_bounds(codes, tail)
    best: tuple[int, str, int] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if table[i, q] < (cost, audit):
            continue
        if best is not None and (cost + low[i][q], audit) > (best[0], best[1][: len(audit)]):
            continue
        if i == n:
            found = (cost + tail[q], audit, q)
            best = found if best is None or found < best else best
            continue
        open_ = []
        for more, letter, taken, to in _STEPS[codes[i], q]:
            prefix = (cost + more, audit + letter)
            node = (i + taken, to)
            if node not in table or prefix < table[node]:
                table[node] = prefix
                open_.append((prefix[0] + low[i + taken][to], letter, (*node, *prefix)))
        stack += [node for *_, node in sorted(open_, reverse=True)]  # the most promising is searched first
    return best


def _matrix(codes: str) -> list[int]:
    """Costs from every entry state to every exit state, row by row."""
    by_end = [suffix_bounds(codes, tuple(0 if q == e else _NEVER for q in range(4)))[0] for e in range(4)]
    return [min(by_end[e][q], _NEVER) for q in range(4) for e in range(4)]


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[["conv", "place", "n"]].assign(m=[_matrix(c) for c in b["codes"]])


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Searches of every segment from every state it may be entered in, and its illegal neighbours. The first one is entered in state 0."""
    known: dict[tuple, tuple] = {}

    def solve(codes: str, entry: int, tail: tuple[int, ...]) -> tuple[int, str, int]:
        key = (codes, entry, tail)
        if key not in known:
            if len(known) > 20000:
                known.clear()
            known[key] = search(codes, entry, tail)
        return known[key]

    for b in batches:
        out = []
        for codes, following, place, tail in zip(b["codes"], b["following"], b["place"], b["tail"]):
            told = [solve(codes, q, tuple(int(t) for t in tail)) for q in ([0] if place == 0 else range(4))]
            shown = "".join(_INITIALS[c] for c in codes + (following or ""))
            wrong = sum(shown[i : i + 2] not in ("su", "ua", "au") for i in range(len(shown) - 1))
            cost, audits, exits = zip(*told)
            out.append((cost[0], list(audits), [*exits] * (4 if place == 0 else 1), wrong))
        yield pd.concat([b[["conv", "place", "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["cost", "audits", "exits", "illegal"])], axis=1)


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines that the audits leave: (conv, at, sub, role); sub 4 keeps the text of row ``at`` (a null role its own role), others are inserted around
    it. An insert never stands before a deletion, as the two exchanged would give a smaller audit, so a line follows it or the end does."""
    for b in batches:
        out = []
        for conv, place, last, codes, state, audit in zip(b["conv"], b["place"], b["last"], b["codes"], b["entry"], b["audit"]):
            at, sub = place * SEGMENT, 0
            row = 0
            for letter in audit:
                if letter == "I":
                    out.append((conv, at + row, sub, _ROLES[_NEXT[state]]))
                    sub, state = sub + 1, _MOVE[state, _NEXT[state]]
                    continue
                if letter == "K":
                    out.append((conv, at + row, 4, None))
                    state = _MOVE[state, _INITIALS[codes[row]]]
                elif letter == "R":
                    out.append((conv, at + row, 4, _ROLES[_NEXT[state]]))
                    state = _MOVE[state, _NEXT[state]]
                row, sub = row + 1, 0
            if last:
                for sub in range(_END[state] // 2):
                    out.append((conv, at + row - 1, 5 + sub, _ROLES[_NEXT[state]]))
                    state = _MOVE[state, _NEXT[state]]
        yield pd.DataFrame(out, columns=["conv", "at", "sub", "role"])


def _scan(leaves: DataFrame, combine: Callable, act: Callable, start: Column, backwards: bool) -> DataFrame:
    """(conv, place, v) for every leaf (conv, place, n, m): ``start`` acted on by all leaves of the conversation before it, or after it if ``backwards``.
    Spans of ``FAN`` neighbours are combined level by level, then values are handed down; no row holds more than ``FAN`` of them."""
    levels = [leaves.select("conv", "place", "n", "m")]
    while True:
        spans = levels[-1].where("n > 1").groupBy("conv", F.floor(F.col("place") / FAN).alias("place"), F.ceil(F.col("n") / FAN).alias("n"))
        grown = spans.agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("kids"))
        ms = F.transform("kids", lambda k: k["m"])
        grown = settle(grown.withColumn("m", F.aggregate(F.slice(ms, 2, FAN), ms[0], combine)))
        if grown.isEmpty():
            break
        levels.append(grown)
    handed = None
    for level in reversed(levels):
        here = level.where("n = 1").select("conv", "place", start.alias("v"))
        here = here if handed is None else here.unionByName(handed)
        if level is levels[0]:
            return here
        kids = F.reverse("kids") if backwards else F.col("kids")
        first = F.struct(F.array().cast(f"array<struct<place:bigint,v:{here.schema['v'].dataType.simpleString()}>>").alias("out"), F.col("v").alias("v"))
        walk = lambda s, k: F.struct(
            F.concat(s["out"], F.array(F.struct(k["place"].alias("place"), s["v"].alias("v")))).alias("out"), act(k["m"], s["v"]).alias("v"))
        handed = level.join(here, ["conv", "place"]).select("conv", F.explode(F.aggregate(kids, first, walk)["out"]).alias("k")).select("conv", "k.place", "k.v")


def _each(n: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in range(n)]), f)


def _cheapest(a: Column, b: Column) -> Column:
    """Product of two cost matrices: through the cheapest state between them."""
    cell = lambda i: F.array_min(_each(4, lambda k: a[F.floor(i / 4).cast("int") * 4 + k] + b[k * 4 + i % 4]))
    return _each(16, cell)


def _before(m: Column, tail: Column) -> Column:
    return _each(4, lambda q: F.array_min(_each(4, lambda e: m[q * 4 + e] + tail[e])))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report and the repaired lines of the conversations in ``turns`` (conv_id, turn, role, text).

    The report has one row per conv_id: gaps, blank, duplicate, truncated, illegal, cost (longs) and audit. The lines are (conv_id, conv, place, role, text) with
    ``conv`` the id as text and ``place`` ascending in the repaired order. Rows go by turn, nulls first, then by role and a digest of the text, so repeated
    rows and ties have one order whatever way they come. Null ids are one conversation, null roles and texts are one space; a role with another initial
    than s, u or a, an empty one too, is never kept as it is. Texts are judged in whole. An empty table gives empty results. Other columns take no part.
    ``turns`` must give the same rows in the same order when read again, as a Parquet folder does.
    """
    spoken = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    ids = turns.schema["conv_id"].dataType
    back = F.when(F.col("conv") != " ", F.col("conv")).cast(ids).alias("conv_id")
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    light = spoken.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "rid", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open"))
    rows = settle(numbered(light, "conv", ["turn", "role", "digest"]).drop("first"))
    first = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("new"))
    blank = F.col("blank")
    again = ~blank & F.col("new").isNull()
    cut = ~blank & ~again & F.col("open")
    initial = F.greatest(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0))
    column = F.when((initial == 0) | (F.col("role") == ""), 4).otherwise(initial)
    code = F.substring(F.lit(_CODES), column + F.when(blank | again, 8).when(cut, 4).otherwise(0), F.lit(1))
    judged = rows.join(first, ["conv", "at"], "left").select(
        "conv", "at", "n", "turn", blank.cast("long").alias("blank"), again.cast("long").alias("duplicate"), cut.cast("long").alias("truncated"), code.alias("code"))
    judged = settle(judged)
    faults = ["blank", "duplicate", "truncated"]
    counted = judged.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in faults]).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in faults])

    segments = judged.groupBy("conv", F.floor(F.col("at") / SEGMENT).alias("place"), F.ceil(F.col("n") / SEGMENT).alias("n"))
    segments = settle(segments.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes")))
    long_type = "conv string, place long, n long, m array<long>"
    costs = settle(segments.where("n > 1").select("conv", "place", "n", "codes").mapInPandas(_matrices, long_type))
    single = segments.where("n = 1").select("conv", "place", "n", F.lit(None).cast("array<long>").alias("m"))
    tails = _scan(costs.unionByName(single), _cheapest, _before, F.array(*[F.lit(x).cast("long") for x in _END]), True)
    following = segments.where("place > 0").select("conv", (F.col("place") - 1).alias("place"), F.left("codes", F.lit(1)).alias("following"))
    asked = segments.join(tails.withColumnRenamed("v", "tail"), ["conv", "place"]).join(following, ["conv", "place"], "left")
    solved = asked.select("conv", "place", "n", "codes", "following", "tail").mapInPandas(
        _solved, "conv string, place long, n long, cost long, audits array<string>, exits array<int>, illegal long")
    solved = settle(solved)
    entries = _scan(solved.withColumnRenamed("exits", "m"), lambda a, b: F.transform(a, lambda q: b[q]), lambda m, q: m[q], F.lit(0), False)
    chosen = solved.join(entries.withColumnRenamed("v", "entry"), ["conv", "place"]).join(segments.select("conv", "place", "codes"), ["conv", "place"])
    chosen = settle(chosen.select("conv", "place", (F.col("place") == F.col("n") - 1).alias("last"), "codes", "entry", "cost", "illegal", F.col("exits")[F.col("entry")].alias("exit"),
                                  F.when(F.col("place") == 0, F.col("audits")[0]).otherwise(F.try_element_at("audits", F.col("entry") + 1)).alias("audit")))
    rest = F.when(F.col("last"), F.repeat(F.lit("I"), F.element_at(F.array(*[F.lit(x // 2) for x in _END]), F.col("exit") + 1))).otherwise("")
    audits = chosen.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("audit", rest).alias("audit")))), lambda x: x["audit"]), "").alias("audit"),
        F.sum("illegal").alias("illegal"), F.max(F.when(F.col("place") == 0, F.col("cost"))).alias("cost"))
    report = counted.join(audits, "conv").select(back, "gaps", *faults, "illegal", "cost", "audit")

    edits = chosen.select("conv", "place", "last", "codes", "entry", "audit").mapInPandas(_edits, "conv string, at long, sub long, role string")
    edits = edits.withColumn("place", F.col("at") * 8 + F.col("sub"))
    kept = edits.where("sub = 4").select("conv", "at", "place", F.col("role").alias("told")).join(rows.select("conv", "at", "rid"), ["conv", "at"])
    kept = kept.select("conv", "place", "told", "rid").join(spoken.select("rid", "role", "text"), "rid")
    kept = kept.select("conv", "place", F.coalesce("told", "role").alias("role"), "text")
    lines = kept.unionByName(edits.where("sub <> 4").select("conv", "place", "role", F.lit("").alias("text")))
    return report, lines.select(back, "conv", "place", "role", "text")


_BLOCK = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations that lie within a sorted partition, and blocks of joined lines of its first and last one, which may go on elsewhere."""
    schema = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("block", pa.string()), ("digest", pa.string())])
    conv, inner, lines, size, start = None, False, [], 0, 0

    def row(whole: bool) -> pa.RecordBatch:
        text = "\n".join(lines)
        cells = (conv, start, None, hashlib.sha256(text.encode()).hexdigest()) if whole else (conv, start, text, None)
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema)], schema=schema)

    for b in batches:
        for c, place, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "place", "role", "text"))):
            if c != conv:
                if conv is not None:
                    yield row(inner)
                conv, inner, lines, size, start = c, conv is not None, [], 0, place
            elif size > _BLOCK:
                yield row(False)
                inner, lines, size, start = False, [], 0, place
            lines.append(f"{role}:{text}")
            size += len(text) + 1
    if conv is not None:
        yield row(False)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the sorted blocks of every conversation, read one after another."""
    schema = pa.schema([("conv", pa.string()), ("digest", pa.string())])
    conv, state = None, None
    for b in batches:
        done = []
        for c, block in zip(b.column("conv").to_pylist(), b.column("block").to_pylist()):
            if c != conv:
                if conv is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(block.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], schema=schema)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], schema=schema)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with lines: the digest of ``role:text``, joined by newlines. A range sort spreads a long conversation over
    tasks, which join its lines to blocks; only those meet in the task that digests it, and are read there as a stream."""
    parts = settle(lines.select("conv", "place", "role", "text").repartitionByRange("conv", "place").sortWithinPartitions("conv", "place").mapInArrow(
        _digests, "conv string, place long, block string, digest string"))
    ids = lines.schema["conv_id"].dataType
    split = parts.where("digest IS NULL").select("conv", "place", "block").repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_joined, "conv string, digest string")
    both = parts.where("digest IS NOT NULL").select("conv", "digest").unionByName(split)
    return both.select(F.when(F.col("conv") != " ", F.col("conv")).cast(ids).alias("conv_id"), F.col("digest").alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the check sum of ``conv_id:turn``: of twenty, 0 drops a row, 1 empties its text, 2 takes out its
    full stops, 3 repeats it, 4 makes it the user's. Nulls of ids, roles and texts count as one space."""
    space = F.lit(" ")
    fault = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))), F.lit(20))
    text = F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", space))
    hurt = turns.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Report and digest of every original conv_id after ``damage``. One without rows has zeros, an empty audit and the digest of nothing."""
    report, lines = repair(damage(turns))
    key = lambda df: df.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    every = key(turns.select("conv_id").distinct())
    out = every.join(key(report).drop("conv_id"), "_key", "left").join(key(digests(lines)).drop("conv_id"), "_key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
