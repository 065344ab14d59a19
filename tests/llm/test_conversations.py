"""Conversation repair against a search over all edit scripts."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from quarry.llm import conversations as cv
from tests.conftest import SF001

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
WELL = re.compile(r"(s?(ua)+)?")


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _prefix_ok(roles):
    """Some well-formed sequence of initials begins so."""
    return any(WELL.fullmatch(roles + rest) for rest in ("", "a", "ua"))


def _cheapest(rows):
    """(cost, audit, lines) by best-first search over edit scripts: (cost, audit)
    is the key, so the first complete script is the cheapest and ASCII-least."""
    heap, seen = [(0, "", 0, (), "")], set()
    while heap:
        cost, audit, at, lines, roles = heapq.heappop(heap)
        if at == len(rows) and WELL.fullmatch(roles):
            return cost, audit, lines
        state = at, "" if not roles else roles[-1]
        if state in seen:
            continue
        seen.add(state)
        for role in ("user", "assistant"):
            if _prefix_ok(roles + role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", at, (*lines, f"{role}:"), (roles + role[0])))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, lines, roles))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and _prefix_ok(roles + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*lines, f"{role}:{text}"), roles + role[:1]))
                for new in ("user", "assistant"):
                    if _prefix_ok(roles + new[0]):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, (*lines, f"{new}:{text}"), roles + new[0]))
    raise AssertionError


def _report(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted(_damage([r for r in table if r[0] == conv]), key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {r[0] for r in rows if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, lines = _cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _got(df):
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in df.collect()}
    assert df.columns == COLUMNS
    return out


def _random_table(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "admin"]
    texts = ["One.", "Two!", "three", "Four? ", " ", "", "Füñf.\n", "a. b"]
    return [(conv, turn, rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(rng.randrange(5)) + "."])) for conv in range(n) for turn in range(rng.randrange(1, 9))]


def test_repair_against_all_scripts(spark):
    table = _random_table(150, 3)
    assert _got(cv.structure_report(spark.createDataFrame(table, SCHEMA))) == _report(table)


def test_given_table_against_all_scripts(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    want = _report([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert _got(cv.structure_report(df)) == want and want


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(5)
    table = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["One.", "two", f"Text {t}.", f"text {t}", " "])) for t in range(300)]
    table += [(c, t, "user", f"Hello {c}.") for c in (0, 2, None) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _got(cv.structure_report(spark.createDataFrame(table, SCHEMA))) == _report(table)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(50000)) + "."
    table = [(1, None, "user", "First."), (1, 0, None, None), (1, 7, "assistant", long), (None, 1, "user", "No id."), (None, None, None, None),
             (3, 2, "user", "Same."), (3, 2, "user", "Same."), (3, 2, "user", "Same."), (3, 3, "assistant", "Ok."), (4, 1, "system", "Only."), (5, 1, "user", "\t\n")]
    dropped = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((dropped, 0, "user", "Gone."))
    df = spark.createDataFrame(table, SCHEMA)
    want = _report(table)
    assert want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _got(cv.structure_report(df)) == want
    assert _got(cv.structure_report(df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("part", "h1", "symbol", "audit", "cost", "tn", "line")]))) == want
    assert _got(cv.structure_report(spark.createDataFrame([], SCHEMA))) == {}


def test_runs_use_powers_of_the_transition():
    for symbol in range(cv.MUST_GO + 1):
        step, v = cv.power(symbol, 0), cv.DONE
        for n in range(1, 70):
            v = cv.applied(step, v)
            assert cv.before_run(symbol, n, cv.DONE) == v == cv.applied(cv.run_matrix(symbol, n), cv.DONE)


def test_long_runs_are_unrolled_in_blocks(monkeypatch):
    runs = [[2, 37], [cv.MUST_GO, 9], [4, 23], [3, 30]]
    whole = cv.unroll(runs, cv.DONE, 0, True)
    monkeypatch.setattr(cv, "BLOCK", 4)
    assert cv.unroll(runs, cv.DONE, 0, True) == whole
    assert whole[1] == cv.applied(cv.matrix_of(runs), cv.DONE)[0]
