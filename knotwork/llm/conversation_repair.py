"""Least-cost repair of conversation structure over a suffix-shared automaton.

Each row of a conversation is one symbol: who speaks (by the role's initial) and
its fault. A suffix of symbols is a node of the automaton, shared by all
conversations that end with it. The conversations' signatures are dealt by
ranges of their reversed text and sorted, so that shared suffixes lie side by
side: a task keeps the nodes on the way to the current signature, and computes
for each new node and each state of the grammar ``(s?(ua)+)?`` the cost to go and
the best first edit. A node is computed once (the few on the border of two
ranges once in each). Ties between edits are decided by the first letter alone,
as all edits open to a node and state have different ones; so an audit is read
off by following first edits, and no audit text is stored at a node.

Rows are dealt by conversation, sorted, and read in order: a task holds no
conversation, but a 16-byte digest of each of its rows, to tell duplicates. A
signature is one byte a row, an audit about as long; an audit reaches its rows
by the conversation's first one.

Edits: K keep (0), R give the row to user or assistant (3), D delete (4, the
only edit of blank and duplicate rows), I insert an empty turn (3); a truncated
row that stays adds 3.

Results: null roles and texts are one space, an empty role has no initial; turns
go by ``turn`` (nulls first), then role, then text, repeats adjacently; rows with
a null conv_id are one conversation; a conversation without rows has an empty
audit; an empty table gives an empty one; columns besides the four named are not
read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

#: White space at the end of a text, and all that a blank one holds.
SPACE = " \t\n\x0b\x0c\r"
#: The grammar's states: nothing yet, after s, after u, after a. The step that each initial makes from each.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The initial that an inserted or given turn must have in each state, and the state behind it.
DUE = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
BATCH = 8192


class Node:
    """A suffix of symbols: per state the cost to go and the best first edit."""

    __slots__ = ("cost", "edit", "symbol")

    def __init__(self, symbol: str, cost: list[int], edit: list[str]):
        # An insert changes the state and stays at the node. States 2 and 3 lead to each other, 0 and 1 to 2 once that is settled.
        for settled in (((2, cost[3]), (3, cost[2])), ((0, None), (1, None))):
            for state, other in settled:
                way = INSERT + (cost[2] if other is None else other)
                if (way, "I") < (cost[state], edit[state]):
                    cost[state], edit[state] = way, "I"
        self.symbol, self.cost, self.edit = symbol, cost, edit


def last_node() -> Node:
    return Node("", [0, FAR, FAR, 0], ["", "~", "~", ""])


def node_before(symbol: str, after: Node) -> Node:
    """The node of one symbol more. Symbols: the initial s, u, a or o (none of them), in capitals if truncated; x must go."""
    cost, edit = [DELETE + c for c in after.cost], ["D"] * 4
    if symbol != "x":
        extra, who = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for state in range(4):
            ways = [(REROLE + extra + after.cost[AFTER[state]], "R")]
            if who in NEXT and NEXT[who][state] is not None:
                ways.append((extra + after.cost[NEXT[who][state]], "K"))
            cost[state], edit[state] = min([(cost[state], "D"), *ways])
    return Node(symbol, cost, edit)


def audit_of(nodes: list[Node]) -> str:
    """The best edits of the suffix that ends ``nodes`` (its own node last), from the first state."""
    at, state, edits = len(nodes) - 1, 0, []
    while edit := nodes[at].edit[state]:
        edits.append(edit)
        if edit == "K":
            state = NEXT[nodes[at].symbol.lower()][state]
        elif edit != "D":
            state = AFTER[state]
        at -= edit != "I"
    return "".join(edits)


def audits(batches):
    """Arrow batches of (key, signature), signatures reversed and sorted, to (key, cost, audit)."""
    nodes, now, found = [last_node()], "", None
    for batch in batches:
        costs, texts = [], []
        for signature in batch["signature"].to_pylist():
            if found is None or signature != now:
                shared = next((i for i, (a, b) in enumerate(zip(now, signature, strict=False)) if a != b), min(len(now), len(signature)))
                del nodes[shared + 1 :]
                for symbol in signature[shared:]:
                    nodes.append(node_before(symbol, nodes[-1]))
                now, found = signature, audit_of(nodes)
            costs.append(nodes[-1].cost[0])
            texts.append(found)
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(costs, pa.int64()), pa.array(texts, pa.string())], ["key", "cost", "audit"])


SIGNED = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"



def signatures(batches):
    """Rows in order to one row a conversation: its counts and its reversed signature."""
    names = [c.split()[0] for c in SIGNED.split(", ")]
    types = [pa.string(), *[pa.int64()] * 6, pa.string()]
    made: list[tuple] = []
    key = object()

    def close() -> None:
        if low is not None:
            counts[0] = high - low + 1 - turns
        made.append((key, conv, *counts, "".join(reversed(symbols))))

    for batch in batches:
        for k, c, turn, role, text in zip(*(batch[n].to_pylist() for n in ("key", "conv_id", "turn", "role", "text")), strict=True):
            if k != key:
                if type(key) is str:
                    close()
                key, conv, low, high, turns, before, seen, symbols = k, c, None, None, 0, None, set(), []
                counts = [0] * 5
            if text is None:  # a dropped row: it only names its conversation
                continue
            if turn is not None:
                turns += turn != high  # turns come in order
                low, high = (turn if low is None else low), turn
            who = role[:1]
            counts[4] += before is not None and before + who not in ("su", "ua", "au")
            before = who
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            symbol = who if who in NEXT else "o"
            said = text.rstrip(SPACE)
            if not said:
                counts[1] += 1
                symbol = "x"
            elif digest in seen:
                counts[2] += 1
                symbol = "x"
            elif said[-1] not in ".!?":
                counts[3] += 1
                symbol = symbol.upper()
            seen.add(digest)
            symbols.append(symbol)
        if len(made) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)
            made = []
    if type(key) is str:
        close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)


REPAIRED = "key string, place long, edit string, turn long, role string, text string"


def repaired(batches):
    """Rows in order, the first of a conversation with its audit, to the rows after repair; deleted ones are left out."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    key, audit, at, state, place = None, "", 0, 0, 0

    def inserts():
        nonlocal at, state, place
        while audit[at : at + 1] == "I":
            place += 1
            yield key, place, "I", None, ROLES[DUE[state]], ""
            at, state = at + 1, AFTER[state]

    for batch in batches:
        made: list[tuple] = []
        for k, a, turn, role, text in zip(*(batch[n].to_pylist() for n in ("key", "audit", "turn", "role", "text")), strict=True):
            if k != key:
                made += inserts()
                key, audit, at, state, place = k, a or "", 0, 0, 0
            if text is None:
                continue
            made += inserts()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            role = role if edit == "K" else ROLES[DUE[state]]
            state = NEXT[role[:1]][state]
            place += 1
            made.append((key, place, edit, turn, role, text))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)
    if made := list(inserts()):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)


def digests(batches):
    """Repaired rows in order to one hash of their ``role:text`` lines a conversation."""
    key, made, digest = None, [], None
    for batch in batches:
        for k, role, text in zip(*(batch[n].to_pylist() for n in ("key", "role", "text")), strict=True):
            if k != key:
                if digest is not None:
                    made.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(made) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*made, strict=True)], ["key", "repaired_sha256"])
            made = []
    if digest is not None:
        made.append((key, digest.hexdigest()))
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*made, strict=True)], ["key", "repaired_sha256"])


def in_order(rows: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text, place): a conversation's rows in one partition, in order; ``gone`` ones have no text.

    ``rows(conv_id, turn, role, text)`` with an optional ``gone``: rows that no longer count, but name their conversation.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    blank = F.lit(" ")
    rows = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), blank).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.when(~gone, F.coalesce(F.col("text").cast("string"), blank)).alias("text"),
    )
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.repartition("key").withColumn("place", F.row_number().over(order))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired rows (key, place, edit, turn, role, text).

    ``key`` (in both) is the conv_id as text, a space for null. The repaired rows of a conversation lie in order in one partition.
    """
    ordered = in_order(rows)
    signed = ordered.sortWithinPartitions("key", "place").select("key", "conv_id", "turn", "role", "text").mapInArrow(signatures, SIGNED)
    signed = W.stage_table(signed, "signatures")  # small: it is read three times, the texts once more
    best = signed.select("key", "signature").repartitionByRange(F.col("signature"), F.col("key")).sortWithinPartitions("signature", "key").mapInArrow(audits, "key string, cost long, audit string")
    # The condition on the place is part of the join: one row of a conversation takes the audit along, all stay.
    to_first = best.select(F.col("key").alias("of"), "audit")
    edited = ordered.join(to_first, (F.col("key") == F.col("of")) & (F.col("place") == 1), "left").sortWithinPartitions("key", "place")
    after = edited.select("key", "audit", "turn", "role", "text").mapInArrow(repaired, REPAIRED)
    return signed.drop("signature").join(best, "key"), after


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults chosen by the checksum of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated or given to the user."""
    blank = F.lit(" ")
    name: Column = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(kind, F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("kind"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its least-cost repair."""
    reports, after = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    hashes = after.select("key", "role", "text").mapInArrow(digests, "key string, repaired_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return reports.join(hashes, "key", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
