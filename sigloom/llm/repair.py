"""Structure repair of conversations by shortest paths with small integer costs.

A conversation's rows, by turn, are edited so that the initials of its roles read `(s?(ua)+)?`, at the least cost: a row is kept
(K, 0), gets the role that is wanted there, user or assistant (R, 3), or is deleted (D, 4); a message without text is inserted
(I, 3). Each row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (its
last visible character is none of `.!?`). Blank and duplicate rows must be deleted; a truncated row that stays costs 3 more.
Of equally cheap repairs the one whose initials of edits are least in ASCII order is taken.

A node is a number of rows dealt with and a state of the pattern (nothing yet, after s, after u, after a); an edit is an arc.
Arcs cost 0 to 6, so Dial's queue of buckets, one for each distance, settles the nodes from the end back; each initial leads from
a node to one other, so a walk from the start along tight arcs, the least initial first, gives the repair.

Rows are range-partitioned and sorted by conversation and turn without their texts, one byte each. A conversation that lies in
one task is solved there. One that tasks share, as one that holds a third of all rows is, is solved in pieces: distances between
the four states across each piece, then the distance to the end from each piece's last node, then the walk of each piece from each state it
may begin in; only these tables of one row for a piece, at most two for each task, are put in order conversation by conversation.
Texts follow in one shuffle by conversation, after which a task streams them; a digest of a conversation is one hash of its
text in order, so one task reads that, in constant memory.

Defined cases: null roles and texts are one space. Rows of one turn go by role, then by a hash of the text, and repeated rows lie side by side;
null turns come first. Rows with a null conversation id are one conversation. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .stage import staged

#: Costs, and what counts as white space and as the end of a sentence.
RELABEL, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE, ENDS = r"\x20\x09-\x0D", ".!?"
FAULTS = ("", "blank", "duplicate", "truncated")

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 40
END = (0, INF, INF, 0)
#: From each state: where an inserted or relabelled message leads, and where a kept one of initial s, u or a does.
WANTED = (USER, USER, ASSISTANT, USER)
KEPT = ({}, {NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT})
INITIALS = " sua"
_WANTED_BY = [[q for q in range(4) if WANTED[q] == to] for to in range(4)]
_KEPT_BY = [[[q for q, there in kept.items() if there == to] for to in range(4)] for kept in KEPT]
#: A row's byte: the place of its initial, and whether it must go or is truncated.
GO, TRUNCATED = 4, 8


def distances(codes: bytes, end: tuple[int, ...] = END) -> list[int]:
    """The distance of each node, 4 * rows + state, to the end; `end` has those of the last four nodes. By Dial's queue."""
    n = len(codes)
    found = [INF] * (4 * n + 4)
    buckets: list[list[int]] = []

    def reach(node: int, d: int) -> None:
        if d < found[node]:
            found[node] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append(node)

    for q, d in enumerate(end):
        if d < INF:
            reach(4 * n + q, d)
    d = 0
    while d < len(buckets):
        bucket, at = buckets[d], 0
        while at < len(bucket):  # arcs of cost 0 add to the bucket itself
            node = bucket[at]
            at += 1
            if found[node] != d:
                continue
            row, q = divmod(node, 4)
            for p in _WANTED_BY[q]:
                reach(4 * row + p, d + INSERT)
            if row:
                code = codes[row - 1]
                reach(node - 4, d + DELETE)
                if not code & GO:
                    extra = CUT if code & TRUNCATED else 0
                    for p in _KEPT_BY[code & 3][q]:
                        reach(4 * row - 4 + p, d + extra)
                    for p in _WANTED_BY[q]:
                        reach(4 * row - 4 + p, d + RELABEL + extra)
        buckets[d] = []
        d += 1
    return found


def walk(codes: bytes, found: list[int], state: int = NOTHING, last: bool = True) -> tuple[str, int]:
    """The least initials of tight arcs from a state on, and the state they end in; only the last piece inserts behind its rows."""
    row, n, out = 0, len(codes), []
    while row < n or (last and found[4 * row + state]):
        here = found[4 * row + state]
        code = codes[row] if row < n else GO
        extra = CUT if code & TRUNCATED else 0
        kept = KEPT[code & 3].get(state)
        if row < n and here == DELETE + found[4 * row + 4 + state]:
            out.append("D")
            row += 1
        elif here == INSERT + found[4 * row + WANTED[state]]:
            out.append("I")
            state = WANTED[state]
        elif not code & GO and kept is not None and here == extra + found[4 * row + 4 + kept]:
            out.append("K")
            row, state = row + 1, kept
        else:
            out.append("R")
            row, state = row + 1, WANTED[state]
    return "".join(out), state


def solve(codes: bytes) -> str:
    return walk(codes, distances(codes))[0]


# Rows


_ORDER = ("conv", "turn", "role", "tie", "row")


def _faults(rows: DataFrame) -> DataFrame:
    """The rows with `fault` (its place in FAULTS)."""
    visible = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    plain = rows.withColumn("fault", F.when(visible == "", 1).when(~F.lit(ENDS).contains(visible), 3).otherwise(0))
    key = ["conv", "role", "same"]
    keyed = plain.withColumn("same", F.sha2("text", 256))
    order = F.struct("turn", "row")
    # Rows of an equal text combine before the shuffle; the join is with texts that are there more than once.
    again = keyed.where("fault <> 1").groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = keyed.join(again, key, "left")
    return met.select(*rows.columns, F.when((F.col("fault") != 1) & (order > F.col("first")), 2).otherwise(F.col("fault")).alias("fault"))


def _code() -> Column:
    """The byte of a row; a role without an initial of the pattern counts as place 0."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    return (place + F.when(F.col("fault").isin(1, 2), GO).when(F.col("fault") == 3, TRUNCATED).otherwise(0)).cast("int")


_PIECE = "conv string, turn long, role string, tie long, row long, codes binary, whole boolean, audit string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each conversation in this task, with the key of its first row.

    Conversations between the first and the last of the task are whole and solved here.
    """

    def piece(head: tuple, codes: bytearray, whole: bool) -> pa.RecordBatch:
        values = [*head, bytes(codes), whole, solve(bytes(codes)) if whole else None]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[*_ORDER, "codes", "whole", "audit"])

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]
    head, codes, first = None, bytearray(), True
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for key, code in zip(keys, batch.column(5).to_pylist(), strict=True):
            if head is None or key[0] != head[0]:
                if head is not None:
                    yield piece(head, codes, not first)
                    first = False
                head, codes = key, bytearray()
            codes.append(code)
    if head is not None:
        yield piece(head, codes, False)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, codes to the distances of each piece from each state (outer) to each state (inner)."""
    for batch in batches:
        for row, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            to = [distances(codes, tuple(0 if q == there else INF for q in range(4)))[:4] for there in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([[[min(to[b][a], INF) for b in range(4)] for a in range(4)]], pa.list_(pa.list_(pa.int64())))], names=["row", "across"])


def _to_the_end(table: pa.Table) -> pa.Table:
    """The pieces of one conversation: the distance to the end from each one's last nodes, and whether it is the last."""
    rows = sorted(table.to_pylist(), key=_place)
    end, ends = list(END), []
    for piece in reversed(rows):
        ends.append(end)
        end = [min(x + y for x, y in zip(piece["across"][q], end, strict=True)) for q in range(4)]
        end = [min(x, INF) for x in end]
    return pa.table({"row": [x["row"] for x in rows], "to_end": pa.array(ends[::-1], pa.list_(pa.int64())), "last": [x is rows[-1] for x in rows]})


def _place(piece: dict) -> tuple:
    """Spark's order of the keys: nulls first, text by its bytes."""
    turn = piece["turn"]
    return (turn is not None, turn or 0, piece["role"].encode(), piece["tie"], piece["row"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, codes, to_end, last to the audit of the piece from each state that it may begin in, and where that ends."""
    for batch in batches:
        for row, codes, to_end, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = distances(codes, tuple(to_end))
            done = [walk(codes, found, q, last) if found[q] < INF else ("", -1) for q in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([row] * 4), pa.array(range(4), pa.int32()), pa.array([x[1] for x in done], pa.int32()), pa.array([x[0] for x in done])], names=["row", "begin", "exit", "audit"])


def _begins(table: pa.Table) -> pa.Table:
    """The state that each piece of one conversation begins in, and the place of the piece."""
    state, rows = NOTHING, sorted(table.to_pylist(), key=_place)
    begins = []
    for piece in rows:
        begins.append(state)
        state = piece["exits"][state]
    return pa.table({"row": [x["row"] for x in rows], "begin": pa.array(begins, pa.int32())})


def _audits(flags: DataFrame) -> DataFrame:
    """conv, the key of the piece's first row, and audit, in pieces that follow each other."""
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    rows = flags.select(*_ORDER, _code().alias("code"))
    pieces = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tk.trimmed(_pieces), _PIECE), "pieces")
    # At most two pieces per task.
    open_ends = pieces.where("NOT whole")
    across = open_ends.select("row", "codes").mapInArrow(_across, "row long, across array<array<long>>")
    to_end = open_ends.drop("codes", "whole", "audit").join(across, "row").groupBy("conv").applyInArrow(_to_the_end, "row long, to_end array<long>, last boolean")
    walks = staged(open_ends.select("row", "codes").join(to_end, "row").mapInArrow(_walks, "row long, begin int, exit int, audit string"), "walks")
    exits = walks.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("begin", "exit"))), lambda x: x["exit"]).alias("exits"))
    begins = open_ends.drop("codes", "whole", "audit").join(exits, "row").groupBy("conv").applyInArrow(_begins, "row long, begin int")
    chosen = walks.join(begins, ["row", "begin"]).select("row", "audit")
    settled = open_ends.drop("audit").join(chosen, "row")
    return pieces.where("whole").select(*_ORDER, "audit").unionByName(settled.select(*_ORDER, "audit"))


_MESSAGE = "conv string, turn long, edit string, role string, text string, fault int, was string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and then rows of each conversation to its edited messages; a deleted row has no role and no text."""
    names = ["conv", "turn", "edit", "role", "text", "fault", "was"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    conv, audit, at, state = None, [], 0, NOTHING
    out: list[tuple] = []

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, WANTED[state]
            yield conv, None, "I", NAMES[state], "", 0, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in (small for large in batches for small in tk.small_batches(large, 3)):
        for own, turn, role, text, fault, piece in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if own != conv:
                out.extend(inserts())
                conv, audit, at, state = own, [], 0, NOTHING
            if piece is not None:
                audit.extend(piece)
                continue
            out.extend(inserts())
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEPT[INITIALS.find(role[:1] or " ")][state]
            elif edit == "R":
                state = WANTED[state]
            kept = (None, None) if edit == "D" else (NAMES[state] if edit == "R" else role, text)
            out.append((conv, turn, edit, *kept, fault, role[:1]))
        if out:
            yield batch_of(out)
            out = []
    out.extend(inserts())
    if out:
        yield batch_of(out)


NAMES = {USER: "user", ASSISTANT: "assistant"}


def key_of(conv: Column) -> Column:
    """A conversation's id as text; that of a null id differs from all others."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv (`key_of` the id), turn, edit, role, text, fault, was: one row for each edit.

    `role` and `text` are those after the edit (null if deleted), `was` is the initial before it. The rows of a conversation lie in one partition, in order.
    """
    taken = rows.select(
        key_of(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text")))
    )
    own = staged(taken.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}), "turns")
    flagged = staged(_faults(own), "faults")
    audits = staged(_audits(flagged.drop("text")), "audits")
    none = F.lit(None).cast("string")
    first = audits.select("conv", F.lit(0).alias("kind"), "turn", "role", "tie", "row", none.alias("text"), F.lit(0).alias("fault"), "audit")
    both = first.unionByName(flagged.select("conv", F.lit(1).alias("kind"), "turn", "role", "tie", "row", "text", "fault", none.alias("audit")))
    in_order = both.repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "tie", "row")
    return in_order.select("conv", "turn", "role", "text", "fault", "audit").mapInArrow(tk.trimmed(_edited), _MESSAGE)


_SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}
_COST = {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of messages in order; of its texts only the hash is kept."""
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def fresh() -> dict:
        return {"faults": [0] * 4, "illegal": 0, "cost": 0, "audit": [], "hash": sha256(), "some": False, "low": None, "high": None, "turns": 0, "was": None}

    def row(conv: str, x: dict) -> tuple:
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
        return conv, gaps, *x["faults"][1:], x["illegal"], x["cost"], "".join(x["audit"]), x["hash"].hexdigest()

    conv, now, out = None, fresh(), []
    for batch in batches:
        for own, turn, edit, role, text, fault, was in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != conv:
                if conv is not None:
                    out.append(row(conv, now))
                conv, now = own, fresh()
            now["audit"].append(edit)
            now["cost"] += _COST[edit] + (CUT if fault == 3 and edit != "D" else 0)
            if edit != "I":
                now["faults"][fault] += 1
                if now["was"] is not None and now["was"] + was not in _LEGAL:
                    now["illegal"] += 1
                now["was"] = was
                if turn is not None:
                    if turn != now["high"]:
                        now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            if edit != "D":
                now["hash"].update(f"{chr(10) if now['some'] else ''}{role}:{text}".encode())
                now["some"] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(conv, now), kinds, strict=True)], names=names)


def summaries(messages: DataFrame) -> DataFrame:
    """Per conversation of `repair`: conv, the counts of its faults, the repair's cost and audit, and the digest of the repaired text."""
    return messages.mapInArrow(tk.trimmed(_summaries), _SUMMARY)


# The query


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the damage that crc32 of `conv_id:turn` modulo 20 names; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    left = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The query's columns for every conversation of `rows`; one without rows after the damage has zeros, no audit and the digest of the empty text."""
    every = rows.select("conv_id").distinct().withColumn("conv", key_of(F.col("conv_id")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.lit(sha256(b"").hexdigest())
    return every.join(found, "conv", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def _plus(best: str, cost: str, edit: str) -> str:
    """SQL: a repair (nine digits of cost, then its audit) with one more edit; null stays null."""
    return f"lpad(CAST(CAST({best}[:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {best}[10:] || '{edit}'"


ORACLE = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
         regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
         lambda b: [(strpos('0123456789ABCDEF', b[1]) - 1) * 16 + strpos('0123456789ABCDEF', b[2]) - 1, 0, 0, 0, 0, 0, 0, 0]))),
         lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1)))) % 20 AS kind FROM conversations),
m AS (
  SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i FROM m),
f AS (
  SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 3 ELSE 0 END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal, list(r ORDER BY i) AS rs, list(fault ORDER BY i) AS faults,
         list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM f GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS i, '000000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM s
  UNION ALL
  SELECT conv_id, i + 1, {_plus("b0", "4", "D")}, least({_plus("b1", "4", "D")}, CASE WHEN stay AND r = 's' THEN {_plus("b0", "x", "K")} END),
         least({_plus("n2", "4", "D")}, CASE WHEN stay THEN {_plus("p2", "x + 3", "R")} END, CASE WHEN stay AND r = 'u' THEN {_plus("p2", "x", "K")} END),
         least({_plus("n3", "4", "D")}, CASE WHEN stay THEN {_plus("n2", "x + 3", "R")} END, CASE WHEN stay AND r = 'a' THEN {_plus("n2", "x", "K")} END)
  FROM (SELECT *, least(b0, b1, n3) AS p2 FROM (SELECT *, least(b3, {_plus("n2", "3", "I")}) AS n3 FROM (
    SELECT dp.*, rs[i + 1] AS r, faults[i + 1] IN (0, 3) AS stay, CASE WHEN faults[i + 1] = 3 THEN 3 ELSE 0 END AS x, least(b2, {_plus("least(b0, b1, b3)", "3", "I")}) AS n2
    FROM dp JOIN s USING (conv_id) WHERE i < len(rs))))),
best AS (
  SELECT conv_id, least(b0, n3) AS b FROM (SELECT conv_id, b0, least(b3, {_plus("n2", "3", "I")}) AS n3 FROM (
    SELECT conv_id, b0, b3, least(b2, {_plus("least(b0, b1, b3)", "3", "I")}) AS n2 FROM dp JOIN s USING (conv_id) WHERE i = len(rs)))),
w AS (
  SELECT conv_id, 1 AS p, 1 AS i, b[10:] AS audit, '' AS state, []::VARCHAR[] AS lines FROM best
  UNION ALL
  SELECT conv_id, p + 1, i + CAST(audit[p] <> 'I' AS INTEGER), audit, CASE WHEN audit[p] = 'D' THEN state ELSE left(role, 1) END, CASE WHEN audit[p] = 'D' THEN lines ELSE list_append(lines, role || ':' || text) END
  FROM (SELECT w.*, CASE WHEN audit[p] IN ('K', 'D') THEN roles[i] WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN audit[p] = 'I' THEN '' ELSE texts[i] END AS text
        FROM w JOIN s USING (conv_id) WHERE p <= length(audit)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(CAST(b[:9] AS INTEGER), 0) AS BIGINT) AS cost, coalesce(b[10:], '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN (SELECT conv_id, lines FROM w WHERE p > length(audit)) USING (conv_id)
"""
