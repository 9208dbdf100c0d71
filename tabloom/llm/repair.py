"""Conversations mended by the cheapest edits, ties decided by the least list of edits.

A conversation should read (system)? (user assistant)+. Rows may be kept,
given another role or deleted, and empty turns inserted; every place between
two rows and every state of that pattern is a node, every edit an arc.
Conversations are cut into blocks of rows. Costs to the end come from each
block's min-plus matrix, joined up block by block in doubling steps. Inside a
block the optimal arcs are ranked by the edits that follow them, one edit, two,
four and so on, and the ranks and doubled pointers give the least path from
each state the block can be entered in; composing the blocks' exits, again by
doubling, tells which one was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ddl, staged
from tabloom.operators.ordered import position

BLOCK = 1024  # rows of one conversation that one task looks at together
SLICE = 65_536  # rows of padded blocks held as arrays at once
BLANK = " \t\n\x0b\x0c\r"
FAR = 1 << 30

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STEP = np.array([2, 2, 3, 2])  # the state after the role that the pattern asks for next
ASKED = "uuau"
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and initial s, u, a, other
END = np.array([0, 10, 5, 0])  # cost of the inserts that close a conversation
DELETE, INSERT, RENAME, CUT = 2, 5, 1, 5
EDITS = "DIKR"  # in the order that decides ties
CODES = {c: i for i, c in enumerate("suaoSUAOx")}  # capitals: truncated; x: must go
PAD = 9


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that a CRC-32 of ``conv_id:turn`` names; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("__kind"))
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("__kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy"))
    return rows.drop("__copy")


def place(conversations: DataFrame) -> DataFrame:
    """Rows with ``pos`` from 0 in each conversation: by turn (nulls first), then role, then the text's hash.

    Rows of a null conv_id are one conversation. Null roles and texts count as one space.
    """
    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = position(filled.withColumn("h", F.sha2("text", 256)), ["conv_id"], ["turn", "role", "h"], "__rn")
    return rows.select("conv_id", "turn", "role", "text", "h", (F.col("__rn") - 1).alias("pos"))


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, pos, initial, fault (blank, duplicate, truncated or null) and code; the first fault counts."""
    trimmed = F.rtrim("text", F.lit(BLANK))
    end = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(*".!?"), "truncated")
    rows = placed.select("conv_id", "turn", "pos", "role", "h", F.left("role", F.lit(1)).alias("initial"), end.alias("end"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("t")).agg(F.min("pos").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("t")))
    fault = F.when((F.col("pos") > F.col("first")) & ~F.col("end").eqNullSafe(F.lit("blank")), "duplicate").otherwise(F.col("end"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("fault", fault).select("conv_id", "turn", "pos", "initial", "fault", code.alias("code"))


def _illegal(before: Column, after: Column) -> Column:
    return ~F.concat(before, after).isin("su", "ua", "au")


def blocks(marked: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, block, codes (one character per row), illegal neighbours inside, first and final initial, and whether it is the last block."""
    entry = F.struct("pos", "code", "initial")
    rows = marked.groupBy("conv_id", F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    i = F.col("c.initial")
    inside = F.size(F.filter(F.zip_with(F.slice("i", F.lit(1), F.size("i") - 1), F.slice("i", F.lit(2), F.size("i")), _illegal), lambda x: x))
    rows = rows.select("conv_id", "block", F.array_join("c.code", "").alias("codes"), i.alias("i"))
    rows = rows.select("conv_id", "block", "codes", inside.cast("long").alias("illegal"), F.get("i", F.lit(0)).alias("first"), F.element_at("i", -1).alias("final"))
    most = marked.groupBy(F.col("conv_id").alias("c")).agg(F.floor(F.max("pos") / size).alias("most"))
    return rows.join(most, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("last", F.col("block") == F.col("most")).drop("most")


def _padded(codes: list[str]) -> np.ndarray:
    out = np.full((len(codes), max(1, max(map(len, codes)))), PAD, dtype=np.int8)
    for row, text in zip(out, codes):
        row[: len(text)] = [CODES[c] for c in text]
    return out


def _row_costs(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs per edit of one row of every block: (D, K, R) by state, from the costs after it."""
    cut = CUT * ((codes >= 4) & (codes < 8))[:, None]
    to = KEEP[:, codes % 4].T
    kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1) + cut, FAR)
    out = np.stack([DELETE + after, kept, RENAME + cut + after[:, STEP]])
    out[1:, codes == CODES["x"]] = FAR
    return out


def costs(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cheapest cost from every node to the end: blocks × (rows + 1) × states; ``end`` has the costs behind the blocks."""
    n, rows = codes.shape
    g = np.empty((n, rows + 1, 4), dtype=np.int64)
    g[:, rows] = end
    for i in range(rows - 1, -1, -1):
        best = _row_costs(codes[:, i], g[:, i + 1]).min(0)
        for _ in range(3):
            best = np.minimum(best, INSERT + best[:, STEP])
        g[:, i] = np.where((codes[:, i] == PAD)[:, None], g[:, i + 1], best)
    return g


def arcs(codes: np.ndarray, g: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, edit, to) of all optimal arcs, sorted by node and edit; the edits of a node differ."""
    n, rows = codes.shape
    node = np.arange(n * (rows + 1) * 4).reshape(n, rows + 1, 4)
    wide = np.concatenate([codes, np.full((n, 1), PAD, np.int8)], 1)
    real = wide != PAD
    first, edit, then = [], [], []

    def add(mask: np.ndarray, kind: int, to: np.ndarray) -> None:
        first.append(node[mask]), then.append(to[mask]), edit.append(np.full(int(mask.sum()), kind))

    inserted = (g == INSERT + g[:, :, STEP]) & (real | last[:, None])[:, :, None]
    add(inserted, 1, node[:, :, STEP])
    for i in range(rows):
        after, here = g[:, i + 1], g[:, i]
        delete, keep, rename = (c == here for c in _row_costs(codes[:, i], after))
        to = np.maximum(KEEP[:, codes[:, i] % 4].T, 0)
        for mask, kind, target in ((delete, 0, node[:, i + 1]), (keep, 2, np.take_along_axis(node[:, i + 1], to, 1)), (rename, 3, node[:, i + 1][:, STEP])):
            mask = mask & real[:, i, None]
            first.append(node[:, i][mask]), then.append(target[mask]), edit.append(np.full(int(mask.sum()), kind))
    first, edit, then = np.concatenate(first), np.concatenate(edit), np.concatenate(then)
    order = np.lexsort((edit, first))
    return first[order], edit[order], then[order]


def least_paths(first: np.ndarray, edit: np.ndarray, then: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The least edits from every start, and the node where they end.

    Arcs are ranked by one edit, then by two, four, ...: a rank and the rank of the arc that many edits on make the next
    rank. ``pointers[k]`` leads 2 ** k arcs on along the least path; the arc behind the last one is the end (rank 0).
    """
    end, nodes = len(first), int(max(starts.max(), then.max(initial=0), first.max(initial=0))) + 1
    src = np.append(first, nodes)

    def heads(rank: np.ndarray) -> np.ndarray:
        """Of every node the arc of least rank."""
        order = np.lexsort((rank, src))
        out = np.full(nodes + 1, end)
        at, where = np.unique(src[order], return_index=True)
        out[at] = order[where]
        return out[:nodes]

    rank = np.append(edit + 1, 0)
    pointers = [np.append(heads(rank)[then], end)]
    while (pointers[-1] != end).any():
        ahead = pointers[-1]
        rank = np.unique(rank * (end + 6) + rank[ahead], return_inverse=True)[1]
        pointers.append(ahead[ahead])
    path = heads(rank)[starts][:, None]
    for pointer in pointers:
        path = np.concatenate([path, pointer[path]], 1)
    letters = np.frombuffer((EDITS + " ").encode(), np.uint8)[np.append(edit, 4)]
    texts = [letters[p].tobytes().decode().rstrip() for p in path]
    count = (path != end).sum(1)
    ends = np.where(count > 0, np.append(then, 0)[path[np.arange(len(path)), np.maximum(count - 1, 0)]], starts)
    return texts, ends


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Indexes of blocks of about the same length, a bounded number of rows at a time."""
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    part: list[int] = []
    for i in order:
        if part and (lengths[i].bit_length() != lengths[part[0]].bit_length() or (len(part) + 1) * (lengths[i] + 1) > SLICE):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _mapped(df: DataFrame, extra: str, one: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """conv_id, block, codes and illegal of ``df`` with the columns that ``one`` makes of a batch."""
    kept = ["conv_id", "block", "codes", "illegal"]
    schema = ddl(df, kept, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = {**{c: b.column(c) for c in kept}, **one(b)}
                yield pa.RecordBatch.from_pydict(made)

    return df.mapInArrow(run, schema)


def _matrices(b: pa.RecordBatch) -> dict:
    """Per block the costs from every state before it to every state behind it, row by row."""
    codes, out = b.column("codes").to_pylist(), [None] * b.num_rows
    for part in _groups([len(c) for c in codes]):
        padded = _padded([codes[i] for i in part])
        ends = np.where(np.eye(4, dtype=bool), 0, FAR)
        made = np.stack([costs(padded, np.tile(e, (len(part), 1)))[:, 0] for e in ends], 2)
        for i, m in zip(part, np.minimum(made, FAR)):
            out[i] = m.reshape(-1).tolist()
    return {"m": pa.array(out, pa.list_(pa.int64()))}


def _solved(b: pa.RecordBatch) -> dict:
    """Per block and state it is entered in: cost to the end, edits in the block, state behind it."""
    codes, last, ends = b.column("codes").to_pylist(), np.array(b.column("last").to_pylist()), b.column("end").to_pylist()
    cost, edits, exits = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
    for part in _groups([len(c) for c in codes]):
        padded = _padded([codes[i] for i in part])
        g = costs(padded, np.array([END if last[i] else ends[i] for i in part]))
        width = g.shape[1] * 4
        starts = (np.arange(len(part))[:, None] * width + np.arange(4)).reshape(-1)
        texts, nodes = least_paths(*arcs(padded, g, last[part]), starts)
        for k, i in enumerate(part):
            cost[i], edits[i], exits[i] = g[k, 0].tolist(), texts[4 * k : 4 * k + 4], (nodes[4 * k : 4 * k + 4] % 4).tolist()
    return {"cost": pa.array(cost, pa.list_(pa.int64())), "edits": pa.array(edits, pa.list_(pa.string())), "exits": pa.array(exits, pa.list_(pa.int64()))}


def _decoded(b: pa.RecordBatch) -> dict:
    """Per row of the block: its edit, the role it gets, the roles inserted before it and, at the end, behind it."""
    out = []
    for codes, entry, edits in zip(b.column("codes").to_pylist(), b.column("entry").to_pylist(), b.column("edits").to_pylist()):
        state, before, rows = entry, "", []
        for e in edits:
            if e == "I":
                before += ASKED[state]
            else:
                rows.append({"edit": e, "to": ASKED[state] if e == "R" else None, "before": before, "after": ""})
                before = ""
            state = state if e == "D" else int(KEEP[state][CODES[codes[len(rows) - 1]] % 4]) if e == "K" else int(STEP[state])
        rows[-1]["after"] = before
        out.append(rows)
    kind = pa.struct([("edit", pa.string()), ("to", pa.string()), ("before", pa.string()), ("after", pa.string())])
    return {"rows": pa.array(out, pa.list_(kind))}


def _doubled(df: DataFrame, value: str, most: int, forward: bool, join: Callable[[Column, Column], Column]) -> DataFrame:
    """``value`` of every block joined up with those of all blocks behind it (or, not ``forward``, before it) in doubling steps."""
    hop = 1
    while hop <= most:
        other = df.select(F.col("conv_id").alias("c"), (F.col("block") - hop if forward else F.col("block") + hop).alias("b"), F.col(value).alias("v"))
        both = df.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
        joined = F.when(F.col("v").isNull(), F.col(value)).otherwise(join(F.col(value), F.col("v")))
        df = staged(both.select("conv_id", "block", joined.alias(value)), "doubled")
        hop *= 2
    return df


def _times(a: Column, b: Column) -> Column:
    """Min-plus product of two 4 × 4 matrices, row by row."""
    cell = lambda i: F.array_min(F.array(*[F.get(a, F.floor(i / 4).cast("int") * 4 + k) + F.get(b, i % 4 + 4 * k) for k in range(4)]))
    return F.transform(F.array(*[F.lit(i) for i in range(16)]), lambda i: F.least(cell(i), F.lit(FAR).cast("long")))


def solve(cut: DataFrame) -> DataFrame:
    """The blocks with the state they are entered in, their least edits and the cost from there to the end."""
    cut = staged(cut, "cut")
    most = cut.agg(F.max("block")).first()[0] or 0
    at = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    several = cut.where("block > 0 or not last")
    if most:
        ahead = several.select(F.col("conv_id").alias("c"), (F.col("block") + 1).alias("b"), F.col("final").alias("before"))
        met = F.coalesce(_illegal(F.col("before"), F.col("first")).cast("long"), F.lit(0))
        cut = cut.join(ahead, at, "left").withColumn("illegal", F.col("illegal") + met).drop("c", "b", "before")
    if most:  # costs behind the blocks that are not their conversation's last
        sums = _doubled(staged(_mapped(several, "m array<bigint>", _matrices), "matrices"), "m", most, True, _times)
        end = F.array(*[F.array_min(F.array(*[F.get("m", F.lit(4 * q + k)) + int(END[k]) for k in range(4)])) for q in range(4)])
        ends = sums.select(F.col("conv_id").alias("c"), (F.col("block") - 1).alias("b"), end.alias("end"))
        cut = cut.join(ends, at, "left").drop("c", "b")
    else:
        cut = cut.withColumn("end", F.lit(None).cast("array<bigint>"))
    made = staged(_mapped(cut, "cost array<bigint>, edits array<string>, exits array<bigint>", _solved), "solved")
    made = made.withColumn("entry", F.lit(0))
    if most:  # exits composed from the first block on; a block is entered where those before it end
        own = several.select(F.col("conv_id").alias("c"), F.col("block").alias("b"))
        walked = _doubled(made.join(own, at, "left_semi").select("conv_id", "block", "exits"), "exits", most, False,
                          lambda own, before: F.transform(before, lambda q: F.get(own, q.cast("int"))))
        entry = walked.select(F.col("conv_id").alias("c"), (F.col("block") + 1).alias("b"), F.get("exits", F.lit(0)).cast("int").alias("entered"))
        made = staged(made.join(entry, at, "left").withColumn("entry", F.coalesce("entered", F.lit(0))), "entered")
    return made.select("conv_id", "block", "codes", "illegal", "entry", F.get("cost", "entry").alias("cost"), F.get("edits", "entry").alias("edits"))


def repaired(placed: DataFrame, found: DataFrame, size: int = BLOCK) -> DataFrame:
    """The mended conversations, one row per turn: conv_id, pos and part (their order), edit, role, text."""
    rows = _mapped(found, "rows array<struct<edit:string,to:string,before:string,after:string>>", _decoded)
    rows = rows.select(F.col("conv_id").alias("c"), "block", F.posexplode("rows").alias("i", "row"))
    rows = rows.select("c", (F.col("block") * size + F.col("i")).alias("p"), "row.*")
    both = placed.join(rows, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p")))
    name = lambda i: F.when(i == "u", "user").otherwise("assistant")
    turn = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    new = lambda c: F.transform(F.filter(F.split(c, ""), lambda i: i != ""), lambda i: turn(F.lit("I"), name(i), F.lit("")))
    own = F.when(F.col("edit") == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(
        F.array(turn(F.col("edit"), F.when(F.col("edit") == "R", name(F.col("to"))).otherwise(F.col("role")), F.col("text"))))
    turns = F.posexplode(F.concat(new(F.col("before")), own, new(F.col("after")))).alias("part", "turn")
    return both.select("conv_id", "pos", turns).select("conv_id", "pos", "part", "turn.*")


def measures(marked: DataFrame) -> DataFrame:
    """Per conversation: gaps in the turn numbers (nulls apart) and rows per fault."""
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    return marked.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])


def _solved_rows(conversations: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marked rows, the solved blocks and the mended turns."""
    placed = staged(place(conversations), "placed")
    marked = staged(faults(placed), "marked")
    found = solve(blocks(marked, size))
    return marked, found, repaired(placed, found, size)


def _audit() -> Column:
    """The edits of a conversation's blocks in order, as an aggregate."""
    pieces = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "edits"))))
    return F.array_join(F.transform(pieces, lambda p: p["edits"]), "")


def repair(conversations: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation with its faults, cost and audit; one row per turn of the mended conversations)."""
    marked, found, turns = _solved_rows(conversations, size)
    audits = found.groupBy(F.col("conv_id").alias("c")).agg(_audit().alias("audit"), F.sum("illegal").alias("illegal"),
                                                            F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"))
    told = measures(marked).join(audits, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return told, turns


def report(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every conversation of the table, damaged and mended again.

    A conversation of which no row is left has zeros, an empty audit and the hash of nothing; so has, but for its faults
    and cost, one whose rows are all deleted. The hash needs a conversation's text in one row, so all that is told of a
    conversation is brought together in one exchange: its rows' faults, its blocks' edits and its mended lines.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    marked, found, turns = _solved_rows(damage(conversations), size)
    line = F.struct("pos", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    parts = marked.select("conv_id", "turn", "fault").unionByName(found.select("conv_id", "block", "edits", "cost", "illegal"), allowMissingColumns=True)
    parts = parts.unionByName(turns.select("conv_id", line.alias("line")), allowMissingColumns=True)
    parts = parts.unionByName(conversations.select("conv_id"), allowMissingColumns=True)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn"))
    lines = F.transform(F.sort_array(F.collect_list("line")), lambda x: x["line"])
    return parts.groupBy("conv_id").agg(
        number(gaps).alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.sum("illegal")).alias("illegal"), number(F.max(F.when(F.col("block") == 0, F.col("cost")))).alias("cost"),
        _audit().alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
