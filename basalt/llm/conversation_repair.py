"""Repair of the turns of conversations by error-correcting Earley parsing.

A good conversation's role initials are those of the grammar `(s?(ua)+)?`. Each row may be kept, given another role
or deleted, and rows may be inserted; each edit has a cost, and the cheapest edits win, of equal ones those whose
initials come first. The parser has the grammar's productions and an error production for each edit. Its chart keeps for
each item the least (cost, audit) only. It reads a conversation from its end, by the mirrored grammar: so an edit is put
before the audit of what follows, and the least audit of a whole is made of least audits of its parts.

Spark finds faults, deals rows by conversation and sorts them. A conversation comes to its task twice, in one
sorted stream: first a byte a row, from which it is parsed, then the texts, which pass one by one through what the
parse decided. So no task holds a conversation's texts, however long it is; it holds 14 bytes a row.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import frugal

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The grammar of role initials from the end: S is a conversation, T its pairs.
RULES = (("S", ""), ("S", "T"), ("S", "Ts"), ("T", "au"), ("T", "Tau"))
ITEMS = tuple((rule, dot) for rule, (_, right) in enumerate(RULES) for dot in range(len(right) + 1))
NUMBER = {item: k for k, item in enumerate(ITEMS)}
#: Of each item the symbol it waits for ("" if it is complete), and the item beyond that.
WAITS = tuple(RULES[rule][1][dot : dot + 1] for rule, dot in ITEMS)
BEYOND = tuple(NUMBER.get((rule, dot + 1)) for rule, dot in ITEMS)
PREDICTED = tuple(k for k, (_, dot) in enumerate(ITEMS) if dot == 0)
#: What a completed T takes further: pairs always begin at the end of the conversation, where their column is.
AFTER_T = tuple(BEYOND[k] for k in PREDICTED if WAITS[k] == "T")
DONE_T = frozenset(k for k, (rule, _) in enumerate(ITEMS) if RULES[rule][0] == "T" and not WAITS[k])
DONE_S = frozenset(k for k, (rule, _) in enumerate(ITEMS) if RULES[rule][0] == "S" and not WAITS[k])
#: A row as a byte: place of its initial in INITIALS, and whether it must go or is truncated.
INITIALS, MUST_GO, CUT_OFF = "sua?", 4, 8
EDITS = "DIKR"
#: Codes of conversations up to this length are remembered.
SHORT = 24


def parse(codes: bytes) -> tuple[int, str]:
    """The least (cost, audit) of rows told by their codes."""
    if len(codes) <= SHORT:
        return parse_short(codes)
    return parse_any(codes)


@functools.lru_cache(1 << 16)
def parse_short(codes: bytes) -> tuple[int, str]:
    return parse_any(codes)


def parse_any(codes: bytes) -> tuple[int, str]:
    width = len(ITEMS)
    back = bytearray(width * (len(codes) + 1))  # of each column and item: the edit that led there, and from which item

    def column(at: int, queue: list) -> list[tuple[int, int, int]]:
        """Items with least (cost, audit), as (cost, rank, item): ranks order audits of equal costs.

        Audits of equal cost and first edit come from items of equal cost in one column, so (cost, edit, rank there)
        orders them. An edit of 4 is none: completion.
        """
        heapq.heapify(queue)
        found, order = set(), []
        while queue:
            cost, edit, before, item, via = heapq.heappop(queue)
            if item in found:
                continue
            rank = len(order)
            found.add(item)
            order.append((cost, rank, item))
            back[at * width + item] = via
            if item in DONE_T:
                for k in AFTER_T:
                    heapq.heappush(queue, (cost, edit, before, k, 4 << 4 | item))
            elif WAITS[item] in ("u", "a"):
                heapq.heappush(queue, (cost + INSERT, 1, rank, BEYOND[item], 1 << 4 | item))
        return order

    order = column(0, [(0, -1, 0, k, 4 << 4 | k) for k in PREDICTED])
    for at, code in enumerate(reversed(codes), 1):
        initial, more = INITIALS[code & 3], TRUNCATED if code & CUT_OFF else 0
        queue = []
        for cost, rank, item in order:
            queue.append((cost + DELETE, 0, rank, item, item))
            if not code & MUST_GO and (symbol := WAITS[item]) in ("s", "u", "a"):
                if symbol == initial:
                    queue.append((cost + KEEP + more, 2, rank, BEYOND[item], 2 << 4 | item))
                elif symbol != "s":
                    queue.append((cost + REROLE + more, 3, rank, BEYOND[item], 3 << 4 | item))
        order = column(at, queue)
    cost, _, item = next(x for x in order if x[2] in DONE_S)
    audit, at = bytearray(), len(codes)
    while True:
        edit, before = divmod(back[at * width + item], 16)
        if edit == 4 and before == item:  # predicted
            return cost, audit.decode()
        if edit < 4:
            audit += EDITS[edit].encode()
        at -= edit in (0, 2, 3)
        item = before


def roles_after(audit: str) -> Iterator[str | None]:
    """The role that each edit's row has afterwards; None if it is deleted."""
    first = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with the system's
    at = -first
    for edit in audit:
        if edit == "D":
            yield None
        else:
            yield ROLES["s" if at < 0 else "ua"[at % 2]]
            at += 1


#: White space that doesn't count: ASCII's.
SPACE = " \t\n\x0b\f\r"


def staged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A stream of each conversation: kind 0 its id, 1 a code of each row, 2 each row with its text; unsorted."""
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), "there")
    ids = told.select("conv").distinct()
    told = told.where("there").drop("there").withColumn("mark", F.md5(F.col("text").cast("binary")))
    key = ["conv", "role", "mark"]
    place = lambda x: F.coalesce(x, F.lit(-(1 << 63)))  # noqa: E731  null comes first; the least number meets it only if a turn is that number
    again = told.groupBy(*key).agg(F.min(place(F.col("turn"))).alias("from"), F.max(place(F.col("turn"))).alias("to"), F.bool_or(F.col("turn").isNull()).alias("bare"))
    again = again.where("`from` < `to` or bare").alias("g")
    trimmed = F.rtrim("text", F.lit(SPACE))
    code = (
        F.when(trimmed == "", F.lit("B")).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), F.lit("T")).otherwise(F.lit("G"))
    )
    small = told.select("conv", "turn", "role", "mark", code.alias("fault")).alias("t")
    met = F.col("t.conv").eqNullSafe(F.col("g.conv")) & (F.col("t.role") == F.col("g.role")) & (F.col("t.mark") == F.col("g.mark"))
    earlier = F.coalesce(F.when(F.col("g.bare"), F.col("t.turn").isNotNull()).otherwise(F.col("t.turn") > F.col("g.from")), F.lit(False))
    small = small.join(again, met, "left").select("t.conv", F.lit(1).alias("kind"), "t.turn", "t.role", "t.mark", F.when((F.col("fault") != "B") & earlier, "D").otherwise(F.col("fault")).alias("text"))
    whole = told.select("conv", F.lit(2).alias("kind"), "turn", "role", "mark", "text")
    return ids.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.lit("").alias("text")).union(small).union(whole)


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "position bigint, edit string, role string, text string"


class Conversation:
    """One conversation as its rows come by."""

    def __init__(self, conv):
        self.conv, self.codes, self.counts = conv, bytearray(), {"B": 0, "D": 0, "T": 0}
        self.illegal = self.distinct = 0
        self.first = self.last = self.row = None
        self.initial = None
        self.hash, self.joint, self.position = hashlib.sha256(), b"", 0

    def told(self, turn, role: str, mark: str, fault: str) -> None:
        row = (turn, role, mark)
        if fault != "B" and row == self.row:  # equal rows are neighbours
            fault = "D"
        self.row = row
        if fault in self.counts:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.codes.append(max(0, INITIALS.find(initial)) if initial in ("s", "u", "a") else 3)
        self.codes[-1] |= MUST_GO if fault in "BD" else CUT_OFF if fault == "T" else 0

    def decide(self) -> None:
        self.cost, self.audit = parse(bytes(self.codes))
        self.codes = None
        self.edits = zip(self.audit, roles_after(self.audit), strict=True)

    def put(self, edit: str, role: str, text: str):
        self.hash.update(self.joint + f"{role}:{text}".encode())
        self.joint = b"\n"
        self.position += 1
        return self.conv, self.position - 1, edit, role, text

    def came(self, role: str, text: str) -> Iterator[tuple]:
        """A row with its text: what is inserted before it, and itself."""
        for edit, after in self.edits:
            if edit == "I":
                yield self.put(edit, after, "")
                continue
            if edit != "D":
                yield self.put(edit, role if edit == "K" else after, text)
            return

    def rest(self) -> Iterator[tuple]:
        for edit, after in self.edits:
            yield self.put(edit, after, "")

    def summary(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.first is not None else 0
        return self.conv, gaps, self.counts["B"], self.counts["D"], self.counts["T"], self.illegal, self.cost, self.audit, self.hash.hexdigest()


def run_of(turns: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, out, held = None, [], 0

        def table() -> pa.RecordBatch:
            nonlocal out, held
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def put(rows: Iterator[tuple]) -> None:
            nonlocal held
            for row in rows:
                if turns:
                    out.append(row)
                    held += len(row[4])

        def end() -> None:
            if talk is not None:
                if talk.codes is not None:
                    talk.decide()
                put(talk.rest())
                if not turns:
                    out.append(talk.summary())

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                for conv, kind, turn, role, mark, text in zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns), strict=True):
                    if kind == 0:
                        end()
                        talk = Conversation(conv)
                    elif kind == 1:
                        talk.told(turn, role, mark, text)
                    else:
                        if talk.codes is not None:
                            talk.decide()
                        put(talk.came(role, text))
                if len(out) >= 4096 or held > 1 << 22:
                    yield table()
        end()
        yield table()

    return run


def repaired(rows: DataFrame, turns: bool, conv_id: str, turn: str, role: str, text: str, there: Column | None) -> DataFrame:
    rows = rows.withColumn("there", F.lit(True) if there is None else there)
    stream = staged(rows, conv_id, turn, role, text).repartition("conv").sortWithinPartitions("conv", "kind", F.asc_nulls_first("turn"), "role", "mark")
    kind = rows.schema[conv_id].dataType
    made = f"conv_id {kind.simpleString()}, {TURNS if turns else SUMMARY}"
    arrow = pa.schema([("conv_id", pa_type(kind)), *[(n, {"bigint": pa.int64(), "string": pa.string()}[t]) for n, t in (x.split() for x in (TURNS if turns else SUMMARY).split(", "))]])
    return stream.mapInArrow(frugal(run_of(turns, arrow)), made)


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def assess_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows count in order of turn, nulls first. Ties: rows of one turn by role, then by the text's MD5, so that equal rows are
    neighbours. A null role or text is one space: no initial of the grammar, and blank. A row's first fault counts:
    blank, duplicate (of an equal role and text before), truncated. A null conv_id is a conversation of its own. Rows where `there` isn't
    true tell only that their conversation exists: without other rows it has zeros, an empty audit and the hash of the
    empty string. Other initials than s, u and a fit nowhere as they are. Very long texts are
    hashed whole, one at a time; very long conversations take one task and 14 bytes a row there, as their hash is one.
    Empty table: no rows. Other columns are dropped, whatever their names.
    """
    return repaired(rows, False, conv_id, turn, role, text, there)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """The turns after repair: conv_id, position from 0, edit (K, R or I), role, text. Cases as in assess_conversations."""
    return repaired(rows, True, conv_id, turn, role, text, there)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows damaged by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0: not there any more; 1: no text; 2: no `.`, `!` or `?`; 3: twice; 4: of the user.
    """
    bare = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(bare("conv_id"), F.lit(":"), bare("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    told = told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return told.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text", (F.col("kind") != 0).alias("there"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """assess_conversations over all conversations, damaged before; its cases hold."""
    return assess_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), there=F.col("there"))


def plus(state: str, cost: int | str, edit: str) -> str:
    """SQL: a state (cost in nine digits, then the audit) with one more edit before."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({state}, 10))"


def steps() -> str:
    """SQL: the states e (nothing yet), u (an answer waits for its question), t (pairs), s (begun by the system) after one more row."""
    moved = lambda state, by: f"CASE WHEN must THEN NULL WHEN initial = '{by}' THEN {plus(state, 'more', 'K')} ELSE {plus(state, '2 + more', 'R')} END"
    gone = lambda state: plus(state, 3, "D")
    return f"""{gone('e')} AS e1, least({gone('u')}, {moved('e', 'a')}, {moved('t', 'a')}) AS u1, least({gone('t')}, {moved('u', 'u')}) AS t1,
      least({gone('s')}, CASE WHEN initial = 's' AND NOT must THEN {plus('t', 'more', 'K')} END) AS s1"""


OP12_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT *, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS bytes FROM conversations
), hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, z: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT)) % 20 AS kind FROM keyed
), rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hurt, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM rows
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'T' ELSE 'G' END AS fault FROM placed
), judged AS (
  SELECT *, fault IN ('B', 'D') AS must, CASE WHEN fault = 'T' THEN 1 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate, count(*) FILTER (fault = 'T') AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), parsed AS (
  SELECT conv_id, n AS i, '000000000' AS e, '000000002I' AS u, '000000004II' AS t, CAST(NULL AS VARCHAR) AS s FROM counts
  UNION ALL
  SELECT conv_id, i, e1, least(u1, {plus('e1', 2, 'I')}, {plus('t1', 2, 'I')}), least(t1, {plus(f"least(u1, {plus('e1', 2, 'I')}, {plus('t1', 2, 'I')})", 2, 'I')}), s1
  FROM (SELECT p.conv_id, p.i - 1 AS i, {steps()} FROM parsed p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i)
), best AS (
  SELECT conv_id, least(e, t, s) AS x FROM parsed WHERE i = 0
), edits AS (
  SELECT conv_id, substr(x, 10) AS audit, unnest(string_split(substr(x, 10), '')) AS edit, unnest(range(1, len(x) - 8)) AS p FROM best WHERE len(x) > 9
), at AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w - 1 - len(replace(audit, 'D', '')) % 2 AS q FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), lines AS (
  SELECT a.conv_id, a.p, CASE WHEN edit = 'K' THEN j.role WHEN q % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END AS line
  FROM "at" a LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM a.conv_id AND j.i = a.i WHERE edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id
)
SELECT c.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(x, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(x, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
""".replace("), at AS (", '), "at" AS (')
