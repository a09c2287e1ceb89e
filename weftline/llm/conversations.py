"""Repair of the turn structure of conversations."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.crc import CRC_TABLE, crc32_sql
from weftline.llm.role_grammar import Repairer, repaired
from weftline.llm.storage import Scratch, tasks

#: Characters that do not count as text.
SPACE = " \t\n\x0b\f\r"
#: Characters of a conversation that a task holds; the repaired text of a longer one is hashed in a second pass.
HELD = 16 << 20
KEY = ["nameless", "conv_id"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with faults put in by the CRC-32 of ``conv_id:turn``, modulo 20.

    0 drops the row (it stays here with ``there`` false, so that its conversation
    is not lost), 1 empties the text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats
    the row, 4 makes it the user's. Nulls of any column count as one space; a null
    turn stays null for the order of rows, and rows without conv_id are a conversation.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 0, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("there"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def _fault(first: Column) -> Column:
    bare = F.rtrim("text", F.lit(SPACE))
    return F.when(bare == "", "blank").when(~first, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows with ``fault`` and ``initial``, each conversation's in one task by (turn, role, text), nulls first.

    One shuffle by conversation serves both sorts: the first finds out whether a
    role has said a text before.
    """
    keyed = rows.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce("conv_id", F.lit(0).cast(rows.schema["conv_id"].dataType)).alias("conv_id"), F.col("turn").isNull().alias("turnless"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "there")
    keyed = keyed.repartition(tasks(rows.sparkSession), *KEY)
    order = Window.partitionBy(*KEY, "there", "role", "text").orderBy(F.col("turnless").desc(), "turn")
    marked = keyed.withColumn("said", F.row_number().over(order)).withColumn("fault", _fault(F.col("said") == 1)).withColumn("initial", F.substring("role", 1, 1))
    return marked.sortWithinPartitions(*KEY, F.col("turnless").desc(), "turn", "role", "text", "said").drop("said")


class _Conversation:
    """What is known of the conversation whose rows a task is reading."""

    def __init__(self, key: tuple):
        self.key, self.counts = key, dict.fromkeys(COUNTS, 0)
        self.steps, self.config = array("q"), 0
        self.rows, self.size = [], 0
        self.before, self.turns = None, None

    def add(self, repairer: Repairer, turnless: bool, turn: int, role: str, text: str, fault: str, initial: str, held: int) -> None:
        c = self.counts
        if fault:
            c[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        self.before = initial
        if not turnless:
            if self.turns is None:
                self.turns = turn - 1
            c["gaps"] += max(turn - self.turns - 1, 0)
            self.turns = turn
        k = repairer.step(self.config, initial, fault if fault in ("", "truncated") else "delete")
        self.steps.append(k)
        self.config = repairer.steps[k][0]
        self.size += len(role) + len(text)
        if self.size <= held:
            self.rows.append((role, text))
        else:
            self.rows = []

    def result(self, repairer: Repairer, held: int) -> tuple:
        self.counts["cost"], audit = repairer.audit(self.steps)
        digest = None
        if self.size <= held:
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired(audit, self.rows)).encode()).hexdigest()
        return (*self.key, *self.counts.values(), audit, digest)


def _audits(rows: DataFrame, held: int) -> DataFrame:
    """A row a conversation: counts, audit, and the repaired text's digest where the text is short enough to be held."""
    key = rows.schema["conv_id"].dataType.simpleString()
    names = [*KEY, *COUNTS, "audit", "repaired_sha256"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer, now = Repairer(), None
        for frame in frames:
            out = []
            for nameless, conv_id, turnless, turn, role, text, there, fault, initial in zip(*(frame[c] for c in frame.columns), strict=True):
                if now is None or now.key != (nameless, conv_id):
                    if now is not None:
                        out.append(now.result(repairer, held))
                    now = _Conversation((nameless, conv_id))
                if there:
                    now.add(repairer, turnless, turn, role, text, fault, initial, held)
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([now.result(repairer, held)], columns=names)

    return _in_order(rows).mapInPandas(run, f"nameless boolean, conv_id {key}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(nameless, conv_id, digest) of conversations too long to be held: their rows stream behind their audits."""
    key = rows.schema["conv_id"].dataType
    ordered = rows.where("there").select(F.col("conv_id").isNull().alias("nameless"), F.coalesce("conv_id", F.lit(0).cast(key)).alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").isNull().alias("turnless"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text")
    heads = audits.select(*KEY, F.lit(0).alias("kind"), F.lit(True).alias("turnless"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(ordered.join(audits.select(*KEY), KEY, "left_semi"))
    both = both.repartition(*KEY).sortWithinPartitions(*KEY, "kind", F.col("turnless").desc(), "turn", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines() -> Iterator[tuple]:
            for frame in frames:
                yield from zip(frame["nameless"], frame["conv_id"], frame["kind"], frame["role"], frame["text"], strict=True)

        source = lines()
        head = next(source, None)
        while head is not None:
            after = None

            def own(key=head[:2]) -> Iterator[tuple]:
                nonlocal after
                for row in source:
                    if row[:2] != key:
                        after = row
                        return
                    yield row[3:]

            rest, digest, first = own(), hashlib.sha256(), True
            for role, text in repaired(head[4], rest):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            for _ in rest:  # nothing is left but what the audit deletes
                pass
            yield pd.DataFrame([(*head[:2], digest.hexdigest())], columns=[*KEY, "digest"])
            head = after

    return both.mapInPandas(run, f"nameless boolean, conv_id {key.simpleString()}, digest string")


def repaired_conversations(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """One row for each conv_id of ``conversations(conv_id, turn, role, text)``: faults after damage, and the cheapest repair.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. Rows are taken by turn (nulls first); those of one turn by
    role and text. A conversation streams through one task, as its digest is one
    chain; the task holds a few bytes a row, and the texts of at most ``held``
    characters. Longer conversations pass a second time, behind their audits.
    Equal rows are repeats, a conversation without rows has zeros, and other
    columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = damaged(conversations)
    found = scratch.write(_audits(rows, held), "audits")
    long = found.where("repaired_sha256 is null")
    if not long.isEmpty():
        found = found.join(_digests(rows, long.select(*KEY, "audit")), KEY, "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "digest"))
    return found.select(F.when(~F.col("nameless"), F.col("conv_id")).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


#: The same rows in DuckDB: the cheapest way to each place of the role grammar, row by row. States: 0 start, 1 system, 2 user, 3 assistant.
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE code <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM s),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, left(role, 1) AS x, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 2, 1, 'user:'), (0, 3, 2, 'user:|assistant:'), (0, 2, 3, 'user:|assistant:|user:'), (1, 1, 0, ''), (1, 2, 1, 'user:'), (1, 3, 2, 'user:|assistant:'), (2, 2, 0, ''), (2, 3, 1, 'assistant:'), (2, 2, 2, 'assistant:|user:'),
  (3, 3, 0, ''), (3, 2, 1, 'user:'), (3, 3, 2, 'user:|assistant:')) v(q, r, k, said)),
op AS (SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) v(r, z, y)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, z, min(b) FROM (
    SELECT dp.conv_id, f.i, o.z, {{'cost': best.cost + 5 * k + o.price, 'audit': best.audit || repeat('I', k::INT) || o.letter, 'said': best.said || CASE WHEN ins.said = '' THEN [] ELSE string_split(ins.said, '|') END || o.line}} AS b
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.q = dp.q,
    LATERAL (SELECT ins.r AS z, 2 AS price, 'D' AS letter, []::VARCHAR[] AS line
      UNION ALL SELECT op.z, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM op WHERE op.r = ins.r AND op.y = f.x AND fault NOT IN ('b', 'd')
      UNION ALL SELECT op.z, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', [CASE op.y WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] FROM op WHERE op.r = ins.r AND op.y <> 's' AND fault NOT IN ('b', 'd')) o) GROUP BY conv_id, i, z),
m AS (SELECT conv_id, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY conv_id),
j AS (SELECT conv_id, count(*) FILTER (p IS NOT NULL AND p || x NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, x, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f) GROUP BY conv_id),
e AS (SELECT dp.conv_id, min({{'cost': best.cost + 5 * k, 'audit': best.audit || repeat('I', k::INT), 'said': best.said || CASE WHEN ins.said = '' THEN [] ELSE string_split(ins.said, '|') END}}) AS b FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i JOIN ins ON ins.q = dp.q WHERE ins.r = 3 OR (dp.q = 0 AND k = 0) GROUP BY dp.conv_id),
r AS (SELECT m.conv_id, coalesce(gaps, 0) AS gaps, blank, duplicate, truncated, illegal, b.cost AS cost, b.audit AS audit, array_to_string(b.said, chr(10)) AS said FROM m JOIN j ON j.conv_id IS NOT DISTINCT FROM m.conv_id JOIN e ON e.conv_id IS NOT DISTINCT FROM m.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
