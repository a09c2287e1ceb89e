"""Operator 12: the repairer against all edits of short sequences, and the query against its SQL form."""

import itertools
import random
import re
from array import array

import duckdb
import pandas as pd
import pytest
from conftest import SMALL
from oracle import database, same_rows
from pyspark.sql import functions as F

from weftline.llm import conversations, queries
from weftline.llm.role_grammar import Repairer, repaired

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit) by trying every edit: up to three inserted rows at each place."""
    inserts = ["".join(p) for n in range(4) for p in itertools.product("ua", repeat=n)]
    best = None
    options = []
    for initial, fault in rows:
        more = 5 if fault == "truncated" else 0
        own = [("D", "", 2)] if fault == "delete" else [("D", "", 2), ("K", initial or "?", more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        options.append([("I" * len(i) + letter, i + role, 5 * len(i) + cost) for i in inserts for letter, role, cost in own])
    options.append([("I" * len(i), i, 5 * len(i)) for i in inserts])
    for way in itertools.product(*options):
        if LEGAL.fullmatch("".join(r for _, r, _ in way)):
            found = (sum(c for _, _, c in way), "".join(a for a, _, _ in way))
            best = found if best is None else min(best, found)
    return best


def test_all_short_sequences():
    kinds = [("s", ""), ("u", ""), ("a", ""), ("t", ""), ("", ""), ("u", "delete"), ("u", "truncated"), ("a", "truncated"), ("s", "truncated")]
    repairer = Repairer()
    rng = random.Random(3)
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)]
    cases += [[rng.choice(kinds) for _ in range(3)] for _ in range(25)]
    for rows in cases:
        if len(rows) == 3 and all(f != "delete" for _, f in rows):
            rows = [*rows[:2], ("u", "delete")]
        steps, config = array("q"), 0
        for initial, fault in rows:
            k = repairer.step(config, initial, fault)
            steps.append(k)
            config = repairer.steps[k][0]
        got = repairer.audit(steps)
        assert got == cheapest(rows), rows
        roles = "".join(r[:1] for r, _ in repaired(got[1], [(i, "x") for i, _ in rows]))
        assert LEGAL.fullmatch(roles)


SCHEMA = "conv_id long, turn long, role string, text string"


def hostile(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rng.choice(["Hello there.", "What?", "no end", " \t\n\x0b", None, "Yes! \n", " ", "😀 done!\r\n", f"text {turn}.", "x" * 3000 + "."])
            out.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    return out + out[:3] + [(1000, None, None, None), (-5, -7, "user", "a."), (-5, 12345678901, "assistant", "b.")]


@pytest.mark.parametrize("held", [conversations.HELD, 40])
def test_hostile_rows(spark, held):
    rows = hostile(held)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("fault", "code", "audit", "there", "copy")}).repartition(3)
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given")
    assert same_rows(conversations.repaired_conversations(df, held), con, conversations.ORACLE) == 63


def test_long_conversation(spark):
    """One conversation of users alone: no prefix of its audit is settled before its end."""
    df = spark.range(20000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.format_string("said %d.", "id").alias("text"))
    row = conversations.repaired_conversations(df, held=1000).first()
    assert set(row.audit) <= set("DKRI") and len(row.repaired_sha256) == 64
    again = conversations.repaired_conversations(df).first()
    assert row == again


def test_no_rows(spark):
    assert conversations.repaired_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    assert same_rows(queries.QUERIES["op12_conversation_repair"](spark, SMALL), database(SMALL), conversations.ORACLE)
