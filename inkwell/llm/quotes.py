"""Chat formatting by quotation linking.

Lines that begin with > marks are quotations, nested as deep as they have marks. Runs of lines of one depth are passages;
passages, their paragraphs and their lines are normalised (lower case, white space as single spaces) and hashed, as are whole
messages, their paragraphs and lines without quotations. A passage is linked to an earlier message of its conversation with
an equal hash: a whole one before a paragraph before a line, then the latest. A message replies to the origin of its first
best-linked passage of depth 1, without one to the message before it. A conversation is its messages in reply order
(each message followed by its replies, by turn), without quotations and the attribution lines above them.

Defined cases: rows with a null conv_id or turn are left out; a null text is an empty message, a null role is `unknown`;
repeated rows count once; messages of equal turn are ordered by role and text; a message that only quotes is kept, empty; an
empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import only, ready, written

_MARK = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")
_ATTRIBUTION = re.compile(r"(?:on\b.{0,200}\bwrote|.{0,80}\b(?:wrote|writes|said)):\s*", re.I | re.S)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(depth, lines) of each run of lines of one depth."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        depth = m[0].count(">") if m else 0
        if out and out[-1][0] == depth:
            out[-1][1].append(line[m.end() :] if m else line)
        else:
            out.append((depth, [line[m.end() :] if m else line]))
    for n, (depth, rows) in enumerate(out[:-1]):
        if out[n + 1][0] > depth:
            while rows and not rows[-1].strip():
                rows.pop()
            if rows and _ATTRIBUTION.fullmatch(rows[-1].strip()):
                rows.pop()
    return out


def units(rows: list[str]) -> dict[int, int]:
    """Hashes of a passage (3), its paragraphs (2) and its lines (1); a hash has its largest kind."""
    text = "\n".join(rows)
    out: dict[int, int] = {}
    for kind, parts in ((1, rows), (2, re.split(r"\n[ \t]*\n", text)), (3, [text])):
        for p in parts:
            if p := normalised(p):
                out[xxhash.xxh64_intdigest(p) - (1 << 63)] = kind
    return out


def without_quotes(text: str) -> str:
    own = ["\n".join(rows) for depth, rows in passages(text) if depth == 0]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")


def _units(batches):
    """Rows (conv_id, pos, passage, depth, hash, kind); passage 0 is the message's own text."""
    for b in batches:
        cols = [[] for _ in range(5)]
        for n, text in enumerate(b.column(2).to_pylist()):
            found = passages(text)
            own = [r for depth, rows in found if depth == 0 for r in rows]
            for k, (depth, rows) in enumerate([(0, own), *[x for x in found if x[0]]]):
                for h, kind in units(rows).items():
                    for c, v in zip(cols, (n, k, depth, h, kind)):
                        c.append(v)
        at = pa.array(cols[0], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())], ["conv_id", "pos", "passage", "depth", "hash", "kind"])


def _clean(batches):
    for b in batches:
        text = [without_quotes(t) for t in b.column(3).to_pylist()]
        yield b.set_column(3, "text", pa.array(text, pa.string()))


def _messages(conversations: DataFrame) -> DataFrame:
    """Each message once, with its place by time; a table, since it is read three times."""
    ready(conversations.sparkSession)
    m = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    m = m.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # spread by conversation first: what follows needs no other shuffle
    m = m.repartition("conv_id").distinct()
    return written(m.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))), "messages")


def _links(m: DataFrame) -> DataFrame:
    """The best origin of each passage. A unit's latest origin of each kind is a running maximum over the messages that hold it, so a
    line that stands in every message costs its occurrences, not their pairs."""
    u = m.select("conv_id", "pos", "text").mapInArrow(_units, "conv_id bigint, pos int, passage int, depth int, hash bigint, kind int")
    before = Window.partitionBy("conv_id", "hash").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    for kind in (3, 2, 1):
        u = u.withColumn(f"own{kind}", F.max(F.when((F.col("depth") == 0) & (F.col("kind") == kind), F.col("pos"))).over(before))
    own = F.coalesce(*[F.when(F.col(f"own{k}").isNotNull(), F.struct(F.lit(k).alias("own"), F.col(f"own{k}").alias("origin"))) for k in (3, 2, 1)])
    both = u.filter("depth > 0").withColumn("o", own).filter("o is not null")
    best = F.struct("kind", F.col("o.own").alias("own"), F.col("o.origin").alias("origin"))
    return both.groupBy("conv_id", "pos", "passage", "depth").agg(F.max(best).alias("best")).select("conv_id", "pos", "passage", "depth", "best.kind", "best.origin")


def links(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, depth, kind, origin_turn): what each quoted passage was linked to; kind 3, 2, 1: as a whole, by
    a paragraph, by a line."""
    m = _messages(conversations)
    at = m.select("conv_id", "pos", "turn")
    x = _links(m).join(at, ["conv_id", "pos"]).join(at.select("conv_id", F.col("pos").alias("origin"), F.col("turn").alias("origin_turn")), ["conv_id", "origin"])
    return x.select("conv_id", "turn", "passage", "depth", "kind", "origin_turn")


def _reply_order(parent: list[int]) -> tuple[list[int], list[int]]:
    """Place and depth of messages 1, 2 and so on, in a walk that has each message before its replies; parent 0: none."""
    replies: dict[int, list[int]] = {}
    for p, q in enumerate(parent, 1):
        replies.setdefault(q, []).append(p)
    depth, place, todo, n = [-1] * (len(parent) + 1), [0] * len(parent), [0], 0
    while todo:
        p = todo.pop()
        if p:
            place[p - 1], n = n, n + 1
            depth[p] = depth[parent[p - 1]] + 1
        todo.extend(reversed(replies.get(p, ())))
    return place, depth[1:]


def _ordered(batches):
    """(conv_id, at): the messages' pos, place, depth, parent and quoted in order of place. The input is whole conversations as
    numbers, by conversation and pos."""
    last, held = None, ([], [])

    def made():
        place, depth = _reply_order(held[0])
        at = [None] * len(place)
        for n, (p, d, q, k) in enumerate(zip(place, depth, *held), 1):
            at[p] = {"pos": n, "depth": d, "parent": q, "quoted": k}
        return at

    for b in batches:
        ids, out = [], []
        for c, parent, quoted in zip(*[b.column(k).to_pylist() for k in (0, 2, 3)]):
            if c != last:
                if held[0]:
                    ids.append(last)
                    out.append(made())
                last, held = c, ([], [])
            held[0].append(parent)
            held[1].append(quoted)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, _AT)], ["conv_id", "at"])
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([made()], _AT)], ["conv_id", "at"])


_AT = pa.list_(pa.struct([("pos", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("quoted", pa.int32())]))


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_links, messages): messages in reply order as (turn, role, text, reply_to, depth, quoted). A conversation is one
    row, so it has to fit one; what is done by conversation before that is done on numbers."""
    m = _messages(conversations)
    found = _links(m)
    chosen = F.max(F.when(F.col("depth") == 1, F.struct("kind", (-F.col("passage")).alias("n"), "origin"))).alias("best")
    best = found.groupBy("conv_id", "pos").agg(chosen, F.count("*").cast("int").alias("quoted"))
    at = m.select("conv_id", "pos").join(best, ["conv_id", "pos"], "left").select("conv_id", "pos", F.coalesce("best.origin", F.col("pos") - 1).alias("parent"), F.coalesce("quoted", F.lit(0)).alias("quoted"))
    order = at.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_ordered, "conv_id bigint, at array<struct<pos:int,depth:int,parent:int,quoted:int>>")
    text = m.select("conv_id", "pos", "role", "text", "turn").mapInArrow(_clean, "conv_id bigint, pos int, role string, text string, turn bigint")
    said = text.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text"))).alias("said"))

    def message(x):
        own = F.get("said", x["pos"] - 1)
        return F.struct(own["turn"].alias("turn"), own["role"].alias("role"), own["text"].alias("text"), F.get("said", x["parent"] - 1)["turn"].alias("reply_to"), x["depth"].alias("depth"), x["quoted"].alias("quoted"))

    n = F.aggregate("at", F.lit(0).cast("bigint"), lambda s, x: s + x["quoted"])
    return said.join(order, "conv_id").select("conv_id", n.alias("n_links"), F.transform("at", message).alias("messages"))
