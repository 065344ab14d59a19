"""Conversation structure repair by a run-length dynamic program.

A conversation is well formed if its role initials match ``(s?(ua)+)?``, read by
an automaton of four states.  A row is a symbol: its role's initial with or
without a truncated text, or one that must go (blank, or a repeat of an earlier
row).  The cheapest edits from each state to each other over a symbol, insertions
before it included, are a 4 × 4 matrix of the (min, +) algebra, and a sequence of
symbols is the product of their matrices.

Equal consecutive symbols collapse to runs, and a run of n symbols is advanced by
the binary powers of its matrix, made once and cached.  From the end of the
conversation backwards this gives the cost still to come at each run; the audit
is unrolled forwards from it, at each place with the least initial that keeps to
the cost, which is the least of all cheapest audits in ASCII order.

Rows are ranged over partitions by conversation and turn, keys and hashes only, so
one conversation may spread over many tasks.  Each partition reports the matrices
of its first and last conversation alone (one row a partition passes the driver);
their products give what is still to come behind a cut and, after unrolling a
continued piece from each of the four states, which of them it begins in.  Texts
are joined to the kept rows afterwards, and a conversation's repaired text is
hashed as a stream (SHA-256 is sequential: that one task holds a row at a time).

Defined cases: a null conversation id is a conversation of its own; a null turn
sorts first; rows of one turn are ordered by role and then a hash of the text; a
null role or text is one space; blank rows count as blank only, repeats as
duplicates only; a conversation without rows has zeros, an empty audit and the
hash of the empty text; an empty table gives no row; extra columns are ignored.
Texts are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
STATES = 4
#: The state that an inserted or re-roled turn leads to, and its role.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Symbols: twice the place of the initial here, and 1 if truncated; MUST_GO.
INITIALS = "sua"
MUST_GO = 2 * len(INITIALS) + 2
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
#: Cost from each state to a well-formed end.
DONE = (0, 2 * INSERT, INSERT, 0)
#: Symbols of a run that are unrolled at once.
BLOCK = 1024
BLANK = r"\x20\x09-\x0D"


# ---- the program ------------------------------------------------------------

def kept_state(state: int, symbol: int) -> int | None:
    """The state after keeping the row as it is; None where that is not allowed."""
    initial = symbol // 2
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(STATES)) for j in range(STATES)) for i in range(STATES))


def applied(a, v):
    return tuple(min(a[i][k] + v[k] for k in range(STATES)) for i in range(STATES))


@lru_cache(None)
def power(symbol: int, bit: int):
    """The transition matrix of 2 ** bit equal symbols."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    edits = [[FAR] * STATES for _ in range(STATES)]
    for q in range(STATES):
        edits[q][q] = DELETE
        if symbol != MUST_GO:
            extra = TRUNCATED * (symbol % 2)
            edits[q][NEXT[q]] = min(edits[q][NEXT[q]], REROLE + extra)
            to = kept_state(q, symbol)
            if to is not None:
                edits[q][to] = min(edits[q][to], extra)
    out = []
    for q in range(STATES):  # insertions before the symbol; two reach every state that can be reached
        rows, at = [], q
        for n in range(3):
            rows.append([INSERT * n + c for c in edits[at]])
            at = NEXT[at]
        out.append(tuple(map(min, zip(*rows))))
    return tuple(out)


def _bits(n: int) -> Iterator[int]:
    return (b for b in range(n.bit_length()) if n >> b & 1)


def run_matrix(symbol: int, n: int):
    out = None
    for b in _bits(n):
        out = power(symbol, b) if out is None else product(out, power(symbol, b))
    return out


def before_run(symbol: int, n: int, v):
    """Costs to come before a run from those behind it."""
    for b in _bits(n):
        v = applied(power(symbol, b), v)
    return v


def runs_of(rows) -> list[list[int]]:
    """Rows (symbol, times, repeated) → runs [symbol, length]."""
    runs = []
    for symbol, times, repeated in rows:
        live = symbol != MUST_GO and not repeated
        for s, n in ((symbol, 1), (MUST_GO, times - 1)) if live else ((MUST_GO, times),):
            if n and runs and runs[-1][0] == s:
                runs[-1][1] += n
            elif n:
                runs.append([s, n])
    return runs


def matrix_of(runs):
    out = None
    for symbol, n in runs:
        m = run_matrix(symbol, n)
        out = m if out is None else product(out, m)
    return out


def unroll(runs, tail, state: int, last: bool) -> tuple[str, int, int]:
    """(audit, cost, state behind) of the cheapest, then ASCII-least, edits of the
    runs, begun in ``state``; ``tail`` is the cost to come behind them."""
    behind = [tail]
    for symbol, n in reversed(runs):
        behind.append(before_run(symbol, n, behind[-1]))
    behind.reverse()
    out, cost = [], 0
    for (symbol, n), end in zip(runs, behind[1:]):
        if symbol == MUST_GO:
            out.append("D" * n)
            cost += DELETE * n
            continue
        extra, one = TRUNCATED * (symbol % 2), power(symbol, 0)
        for begin in range(0, n, BLOCK):
            size = min(BLOCK, n - begin)
            to_come = [before_run(symbol, n - begin - size, end)]
            for _ in range(size):
                to_come.append(applied(one, to_come[-1]))
            for i in range(size, 0, -1):
                here, after = to_come[i], to_come[i - 1]
                while DELETE + after[state] != here[state] and INSERT + here[NEXT[state]] == here[state]:
                    out.append("I")
                    cost, state = cost + INSERT, NEXT[state]
                to = kept_state(state, symbol)
                if DELETE + after[state] == here[state]:
                    out.append("D")
                    cost += DELETE
                elif to is not None and extra + after[to] == here[state]:
                    out.append("K")
                    cost, state = cost + extra, to
                else:
                    out.append("R")
                    cost, state = cost + REROLE + extra, NEXT[state]
    while last and DONE[state]:
        out.append("I")
        cost, state = cost + INSERT, NEXT[state]
    return "".join(out), cost, state


# ---- rows -------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the contract's damage, nulls as one space: conv_id, tn and
    turn (null turns first), role, text, copies."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    d = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").isNotNull().cast("int").alias("tn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), text("role").alias("role"), text("text").alias("text"), d.alias("d"))
    return marked.where("d <> 0").select(
        "conv_id", "tn", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).alias("copies"))


KEY = ("tn", "turn", "role", "h1", "h2")


def marked_rows(rows: DataFrame) -> DataFrame:
    """rows(conv_id, tn, turn, role, text, copies) → one row for equal rows:
    conv_id, KEY, symbol, times, repeated (an earlier turn says the same)."""
    text = F.col("text")
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(len(INITIALS))
    symbol = F.when(~text.rlike(f"[^{BLANK}]"), MUST_GO).otherwise(2 * initial + (~text.rlike(rf"[.!?][{BLANK}]*\z")).cast("int"))
    own = rows.select("conv_id", "tn", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), symbol.cast("int").alias("symbol"), "copies")
    grouped = staged(own.groupBy("conv_id", *KEY, "symbol").agg(F.sum("copies").alias("times")), "turns")
    first = grouped.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct("tn", "turn")).alias("m")).select(
        "conv_id", "role", "h1", "h2", F.col("m.tn").alias("tn"), F.col("m.turn").alias("turn"), F.lit(False).alias("repeated"))
    on = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))
    for c in KEY:
        on &= F.col(f"x.{c}") == F.col(f"y.{c}")
    return grouped.alias("x").join(first.alias("y"), on, "left").select("x.*", F.coalesce("y.repeated", F.lit(True)).alias("repeated"))


def _segments(batches) -> Iterator[tuple[int, object, list[tuple]]]:
    """Consecutive rows of one partition and conversation."""
    at, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "conv_id", "symbol", "times", "repeated", *KEY)]
        for part, conv, *row in zip(*columns):
            if at != (part, conv):
                if rows:
                    yield *at, rows
                at, rows = (part, conv), []
            rows.append(row)
    if rows:
        yield *at, rows


def _edges(ordered: DataFrame, conv_type: str) -> list[dict]:
    """One record a partition, in order: its first and last conversation, their
    matrices, the last role."""
    def run(batches):
        at = None
        for part, conv, rows in _segments(batches):
            if at is None or at[0] != part:
                if at is not None:
                    yield record(at)
                at = [part, conv, rows, conv, rows, 0]
            at[3], at[4], at[5] = conv, rows, at[5] + 1
        if at is not None:
            yield record(at)

    def record(at):
        part, first, first_rows, last, last_rows, n = at
        flat = [[c for row in matrix_of(runs_of(r[:3] for r in rows)) for c in row] for rows in (first_rows, last_rows)]
        return pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "n": n, "head": flat[0], "tail": flat[1], "role": last_rows[-1][5][:1]}], schema=schema)

    spark_schema = f"part int, first {conv_type}, last {conv_type}, n int, head array<long>, tail array<long>, role string"
    schema = _arrow(ordered, spark_schema)
    return sorted((r.asDict() for r in ordered.mapInArrow(run, spark_schema).collect()), key=lambda r: r["part"])


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _behind_cuts(edges: list[dict]) -> dict[int, tuple]:
    """part → (cost to come behind its last conversation, that conversation ends
    here, the role before its first row or None if nothing comes before)."""
    out, square = {}, lambda flat: tuple(tuple(flat[i * STATES:(i + 1) * STATES]) for i in range(STATES))
    for k in range(len(edges) - 1, -1, -1):
        here, after = edges[k], edges[k + 1] if k + 1 < len(edges) else None
        goes_on = after is not None and after["first"] == here["last"]
        tail = DONE
        if goes_on:
            tail = applied(square(after["head"]), out[after["part"]][0] if after["n"] == 1 else DONE)
        before = edges[k - 1] if k else None
        out[here["part"]] = tail, not goes_on, before["role"] if before is not None and before["last"] == here["first"] else None
    return out


def _pieces(ordered: DataFrame, edges: list[dict], conv_type: str) -> DataFrame:
    """The repaired pieces (line = false): counts, audit and state behind, for a
    continued piece from each state it may begin in; and their lines."""
    cuts = _behind_cuts(edges)
    number = {e["part"]: e["n"] for e in edges}
    schema_sql = (f"part int, line boolean, conv_id {conv_type}, continued boolean, edge boolean, start int, stop int, audit string, cost long, blank long, duplicate long, "
                  "truncated long, illegal long, ord long, tn int, turn long, role string, h1 long, h2 long, new_role string")
    schema = _arrow(ordered, schema_sql)

    def run(batches):
        at, nth, out = None, 0, []
        for part, conv, rows in _segments(batches):
            at, nth = part, nth + 1 if part == at else 1
            tail, ends, before = cuts[part]
            last = nth == number[part]
            if not last:
                tail, ends = DONE, True
            prior = before if nth == 1 else None
            continued = prior is not None
            runs = runs_of(r[:3] for r in rows)
            counts = _counts(rows, prior)
            for start in range(STATES) if continued else (0,):
                audit, cost, stop = unroll(runs, tail, start, ends)
                base = {"part": part, "conv_id": conv, "continued": continued, "edge": last or nth == 1, "start": start}
                out.append(base | {"line": False, "stop": stop, "audit": audit, "cost": cost} | counts)
                out += [base | {"line": True} | line for line in _lines(rows, audit, start)]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, schema_sql)


def _counts(rows, prior: str | None) -> dict:
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for symbol, times, repeated, _, _, role, *_ in rows:
        if symbol == MUST_GO:
            out["blank"] += times
        else:
            out["duplicate"] += times - (not repeated)
            out["truncated"] += (not repeated) and symbol % 2
        out["illegal"] += times - 1 + (prior is not None and prior + role[:1] not in LEGAL)
        prior = role[:1]
    return out


def _lines(rows, audit: str, state: int) -> Iterator[dict]:
    """The repaired lines of an audit: a row's key with its new role, or a role
    alone for an inserted line."""
    at, ord_ = 0, 0
    for symbol, times, repeated, tn, turn, role, h1, h2 in rows:
        left = times
        while left:
            if audit[at] == "D":
                step = left if symbol == MUST_GO or repeated or left < times else 1
                at, left = at + step, left - step
                continue
            keep = audit[at] == "K"
            state = kept_state(state, symbol) if keep else NEXT[state]
            line = {"ord": ord_, "new_role": role if keep else ROLE[state]}
            if audit[at] != "I":
                line |= {"tn": tn, "turn": turn, "role": role, "h1": h1, "h2": h2}
                left -= 1
            yield line
            at, ord_ = at + 1, ord_ + 1
    for _ in audit[at:]:
        state = NEXT[state]
        yield {"ord": ord_, "new_role": ROLE[state]}
        ord_ += 1


def _begins(edges: list[dict], ends: list) -> list[tuple[int, int]]:
    """(part, state) in which each continued piece begins."""
    stop = {(r["part"], r["conv_id"], r["continued"], r["start"]): r["stop"] for r in ends}
    out, before = {}, None
    for here in edges:
        if before is not None and before["last"] == here["first"]:
            through = before["part"] in out and before["n"] == 1
            out[here["part"]] = stop[before["part"], before["last"], through, out[before["part"]] if through else 0]
        before = here
    return list(out.items())


def hashed_lines(lines: DataFrame, conv_type: str) -> DataFrame:
    """lines(conv_id, part, ord, new_role, text) → conv_id, repaired_sha256."""
    def run(batches):
        none, at, digest, ids, out = object(), None, None, [], []
        at = none
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "new_role", "text"))):
                if at is none or conv != at:
                    if at is not none:
                        ids.append(at)
                        out.append(digest.hexdigest())
                    at, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:".encode())
                digest.update(text.encode())
            if len(ids) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(out)], ["conv_id", "repaired_sha256"])
                ids, out = [], []
        if at is not none:
            yield pa.RecordBatch.from_arrays([pa.array([*ids, at], schema.field(0).type), pa.array([*out, digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    sql = f"conv_id {conv_type}, repaired_sha256 string"
    schema = _arrow(lines, sql)
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "ord").select("conv_id", "new_role", "text").mapInArrow(run, sql)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(conv_id, tn, turn, role, text, copies), as ``damaged`` makes them →
    pieces(part, conv_id, audit, cost, blank, duplicate, truncated, illegal) and
    lines(part, conv_id, ord, new_role, text): the repaired conversations."""
    spark = rows.sparkSession
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", *KEY]
    dealt = staged(marked_rows(rows).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns-ordered")
    ordered = dealt.repartition("part").sortWithinPartitions("part", *order)
    edges = _edges(ordered, conv_type)
    made = staged(_pieces(ordered, edges, conv_type), "turns-repaired")
    ends = [r.asDict() for r in made.where("NOT line AND edge").select("part", "conv_id", "continued", "start", "stop").collect()]
    begins = F.broadcast(spark.createDataFrame(_begins(edges, ends), "p int, s int"))  # one row a partition at most
    right = made.join(begins, (F.col("part") == F.col("p")) & F.col("continued"), "left").where(~F.col("continued") | (F.col("start") == F.col("s")))
    pieces = right.where("NOT line").select("part", "conv_id", "audit", "cost", "blank", "duplicate", "truncated", "illegal")
    texts = rows.select("conv_id", "tn", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text").dropDuplicates(order)
    on = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))
    for c in KEY:
        on &= F.col(f"x.{c}") == F.col(f"y.{c}")
    lines = right.where("line").alias("x").join(texts.alias("y"), on, "left").select("x.conv_id", "x.part", "x.ord", "x.new_role", F.coalesce("y.text", F.lit("")).alias("text"))
    return pieces, lines


def structure_report(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, …) → one row per conv_id: gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its
    rows after damage and repair."""
    prepare(conversations.sparkSession)
    rows = damaged(conversations)
    pieces, lines = repair(rows)
    turns = rows.where("tn = 1").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = (conversations.select("conv_id").distinct().unionByName(turns, True).unionByName(pieces, True).unionByName(hashed_lines(lines, conv_type), True)
             .groupBy("conv_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums],
                                     F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit")))).alias("audits"), F.max("repaired_sha256").alias("sha")))
    audit = F.array_join(F.transform("audits", lambda p: p["audit"]), "")
    return found.select("conv_id", *sums, audit.alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
