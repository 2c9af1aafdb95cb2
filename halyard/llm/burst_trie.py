"""Prefix trie of conversations by burst tries.

A turn is 24 bytes: the MD5 of its role and text and the length of its text.  A conversation is a row of such turns, cut
into pieces of ``PIECE`` turns; the hash of all turns before a piece names the trie node that it hangs under.  Equal
pieces under the same node are one row with a count, so thousands of copies weigh as much as one.

All pieces under one node are a container.  A container of more than ``room`` pieces bursts: the turns that all its
pieces begin with become a chain of nodes, and the pieces are dealt to new containers by the next turn.  A hot first
turn bursts again, an opening of a hundred common turns in one or two rounds.  Containers that have room are spread over
shards by their key, sorted, and swept into nodes.  What a sweep adds up for a container's subtree (leaves, bytes
saved) goes up the burst heads, round by round, by joins on the heads' keys; later pieces of long conversations go
first, as their sums belong under earlier pieces.

Bounds: a sweep holds one container, of ``room`` pieces; the broadcast list of containers that burst has at most
``MOST_BURSTS`` rows of three fields, since ``room`` grows with the table.  A list of member ids is hashed as a
stream of sorted blocks of at most 1,024 ids.  The turns of one conversation are numbered by one task, which spills.

Defined cases: rows with a null conversation id belong to no conversation and take no part; a null turn comes first; a
null role or text is empty; rows of equal turns follow one another by their digests, repeated rows are turns of their
own; an empty table has no node, not even a root; other columns are ignored.  Equal 128-bit hashes count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import dropped, stored

#: Turns of a piece, pieces of a container at least, containers that may burst in one round, turns of a chain.
PIECE, ROOM, MOST_BURSTS, CHAIN = 4_096, 1_024, 50_000, 64

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NAMES = [x.split()[0] for x in NODE.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a hash and 8 of the text's length."""
    return F.unhex(F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), tid."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("tid"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "tid")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "tid")


def rebuilt(turns: DataFrame, step: int = 5, most: int = 8) -> DataFrame:
    """Each conversation begins with turns of the one at the step before it: the first h, which its own after h follow.

    conv, pos, tid; pos 0 without a tid stands for the conversation itself, which may have no turns left.
    """
    convs = turns.where("pos = 1").select("conv", (F.col("conv") - F.col("conv") % step).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).alias("h"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "tid")
    given = convs.join(heads.hint("merge"), "base").where(F.col("pos") <= F.col("h")).select("conv", "pos", "tid")
    sizes = heads.groupBy("base").agg(F.max("pos").alias("has"))
    # where the other has fewer turns, one's own move up
    moved = convs.join(sizes.hint("merge"), "base", "left").select("conv", "h", (F.col("h") - F.least("h", F.coalesce("has", F.lit(0)))).alias("gap"))
    own = turns.join(moved.hint("merge"), "conv").where(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("gap")).alias("pos"), "tid")
    return own.union(given).union(convs.select("conv", F.lit(0).cast("long"), F.lit(None).cast("binary")))


def _pieces(sequences: DataFrame, piece: int) -> DataFrame:
    """conv, seg, ids, and 128-bit hashes of what stands before the piece and up to its end; whether it is the last."""
    seg = F.greatest((F.col("pos") - 1) / piece, F.lit(0)).cast("long")
    rows = sequences.withColumn("seg", seg).repartition("conv").groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("t"))
    rows = rows.select("conv", "seg", F.transform(F.filter("t", lambda x: x["tid"].isNotNull()), lambda x: x["tid"]).alias("ids"))
    rows = rows.withColumns({"a": F.xxhash64("seg", "ids"), "b": F.xxhash64("ids", "seg")})
    order = Window.partitionBy("conv").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"head1": F.coalesce(F.bit_xor("a").over(before), F.lit(0)), "head2": F.coalesce(F.bit_xor("b").over(before), F.lit(0)), "last": F.lead("seg").over(order).isNull()})
    return rows.select("conv", "seg", "ids", "head1", "head2", F.col("head1").bitwiseXOR(F.col("a")).alias("full1"), F.col("head2").bitwiseXOR(F.col("b")).alias("full2"), "last")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of comma-joined ids, block after block of each group."""
    key, digest = None, None
    schema = pa.schema([("full1", pa.int64()), ("full2", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, b) != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x[i] for x in done], f.type) for i, f in enumerate(schema)], schema=schema)
    if key:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip((*key, digest.hexdigest()), schema, strict=True)], schema=schema)


def _ends(pieces: DataFrame) -> DataFrame:
    """For each whole conversation's hash, the digest of the ids of those that are equal to it."""
    blocks = pieces.where("last").groupBy("full1", "full2", F.shiftright("conv", 10).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition("full1", "full2").sortWithinPartitions("full1", "full2", "block").select("full1", "full2", "ids")
    return ordered.mapInArrow(_streamed, "full1 bigint, full2 bigint, ends string")


_SWEPT = f"total boolean, up string, head1 bigint, head2 bigint, {NODE}"


def sweep(rows: list[dict], depth: int, parent_conv: int | None) -> tuple[list[tuple], tuple[int, int, int]]:
    """Nodes of one sorted container below ``depth``, as result rows, and its tops, leaves and bytes saved."""
    depths, parents, size, n, conv, children, leaves, saved, ends = [], [], [], [], [], [], [], [], []
    path, before = [], []
    for row in rows:
        ids, common = row["ids"], 0
        for x, y in zip(before, ids):  # noqa: B905
            if x != y:
                break
            common += 1
        del path[common:]
        for tid in ids[common:]:
            parents.append(path[-1] if path else -1)
            path.append(len(depths))
            depths.append(depth + len(path))
            size.append(int.from_bytes(tid[16:], "big"))
            for values, start in ((n, 0), (conv, None), (children, 0), (leaves, 0), (saved, 0), (ends, None)):
                values.append(start)
        if path:
            i = path[-1]
            n[i], conv[i], ends[i] = row["n"], row["conv"], row["ends"]
            children[i], leaves[i], saved[i] = row["more_children"], row["more_leaves"], row["more_saved"]
        before = ids
    tops = [0, 0, 0]
    for i in range(len(depths) - 1, -1, -1):
        leaves[i] = leaves[i] if children[i] else 1
        saved[i] += (n[i] - 1) * size[i]
        p = parents[i]
        if p < 0:
            tops = [tops[0] + 1, tops[1] + leaves[i], tops[2] + saved[i]]
        else:
            n[p] += n[i]
            conv[p] = conv[i] if conv[p] is None else min(conv[p], conv[i])
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    made = [(conv[i], depths[i], conv[parents[i]] if parents[i] >= 0 else parent_conv, n[i], children[i], leaves[i], saved[i], ends[i] or NO_ENDS) for i in range(len(depths))]
    return made, tuple(tops)


_SWEPT_SCHEMA = pa.schema([("total", pa.bool_()), ("up", pa.string()), ("head1", pa.int64()), ("head2", pa.int64()), *[(x, pa.string() if x == "ends_sha256" else pa.int64()) for x in NAMES]])


def _sweep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers one after another: their nodes, and a row of their totals."""

    def swept(rows: list[dict]) -> list[tuple]:
        r = rows[0]
        made, (tops, leaves, saved) = sweep(rows, r["depth"], r["parent_conv"])
        return [(False, None, None, None, *x) for x in made] + [(True, r["up"], r["head1"], r["head2"], None, None, None, None, tops, leaves, saved, None)]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SWEPT_SCHEMA)], schema=_SWEPT_SCHEMA)

    rows: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if rows and rows[0]["c"] != row["c"]:
                out += swept(rows)
                rows = []
            rows.append(row)
        yield batch_of(out)
    if rows:
        yield batch_of(swept(rows))


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def _common(a: str, b: str) -> Column:
    """How many elements two arrays begin with in common."""
    same = F.transform(F.arrays_zip(a, b), lambda x: F.coalesce(x[a] == x[b], F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _burst(live: DataFrame, room: int) -> DataFrame:
    """Containers beyond their room: c, up, seg, depth, head1, head2, parent_conv, chain (the turns all begin with), n, conv, and the piece that ends there."""
    start = F.slice("ids", F.col("at") + 1, CHAIN)
    sizes = live.groupBy("c", "up", "seg", "at", "head1", "head2", "parent_conv").agg(F.count("*").alias("rows"), F.min(start).alias("least"), F.max(start).alias("most"), F.sum("n").alias("n"), F.min("conv").alias("conv"))
    full = sizes.where(F.col("rows") > room).withColumn("long", _common("least", "most"))
    return full.select("c", "up", "seg", "at", "head1", "head2", "parent_conv", "n", "conv", "long", F.slice("least", 1, F.col("long")).alias("chain"))


def _with_more(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    """Pieces with what later pieces of the same conversations add under their last node."""
    names = ["more_children", "more_leaves", "more_saved"]
    if more is None:
        return rows.withColumns({x: F.lit(0).cast("long") for x in names})
    return rows.join(more.hint("merge"), ["full1", "full2"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in names})


def prefix_trie(sequences: DataFrame, piece: int = PIECE, room: int = ROOM) -> DataFrame:
    """Nodes of the trie of conversations given as conv, pos, tid (see ``rebuilt``): the columns of ``NODE``."""
    spark = sequences.sparkSession
    pieces = stored(_pieces(sequences, piece), "trie-pieces")
    temporary = [pieces]

    def keep(df: DataFrame, name: str) -> DataFrame:
        temporary.append(stored(df, name))
        return temporary[-1]

    distinct = pieces.groupBy("seg", "head1", "head2", "full1", "full2", "ids").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    distinct = keep(distinct.join(_ends(pieces).hint("merge"), ["full1", "full2"], "left"), "trie-distinct")
    total, deepest, everyone, first = distinct.agg(F.count("*"), F.max("seg"), F.sum(F.when(F.col("seg") == 0, F.col("n"))), F.min(F.when(F.col("seg") == 0, F.col("conv")))).first()
    if not total:
        dropped(*temporary)
        return spark.createDataFrame([], NODE)
    room = max(room, total // MOST_BURSTS)
    # the node that a later piece hangs under is the end of the piece before it
    live = distinct.where("seg = 0").withColumn("parent_conv", F.lit(first).cast("long"))
    if deepest:
        under = distinct.select(F.col("full1").alias("head1"), F.col("full2").alias("head2"), (F.col("seg") + 1).alias("seg"), F.col("conv").alias("parent_conv"))
        live = live.union(distinct.where("seg > 0").join(under.hint("merge"), ["seg", "head1", "head2"]).select(*live.columns))
    live = keep(live.withColumns({"c": _key("seg", "head1", "head2"), "up": F.lit(None).cast("string"), "at": F.lit(0)}), "trie-live")
    heads, settled = [], []
    while True:
        full = keep(_burst(live, room), "trie-bursts")
        places = {r[0] for r in full.select("seg").distinct().collect()}
        if not places:
            settled.append(live)
            break
        marks = F.broadcast(full.select("c", "long", F.col("conv").alias("least_conv")))
        settled.append(live.join(marks, "c", "left_anti").select(*live.columns))
        onward = live.join(marks, "c").where(F.size("ids") > F.col("at") + F.col("long"))
        moved = {"up": F.col("c"), "parent_conv": F.when(F.col("long") > 0, F.col("least_conv")).otherwise(F.col("parent_conv")), "at": F.col("at") + F.col("long"), "c": _key("c", F.hex(F.get("ids", F.col("at") + F.col("long"))))}
        ending = live.join(marks, "c").where(F.size("ids") == F.col("at") + F.col("long")).select("c", "full1", "full2", "ends")
        heads.append((places, keep(full.join(ending.hint("merge"), "c", "left"), "trie-heads")))
        live = keep(onward.withColumns(moved).select(*live.columns), "trie-live")
    rows = settled[0]
    for x in settled[1:]:
        rows = rows.union(x)
    nodes, more = [], None
    for seg in range(deepest, -1, -1):
        # shards of containers, each container's pieces in order
        own = _with_more(rows.where(F.col("seg") == seg), more).withColumns({"ids": F.slice("ids", F.col("at") + 1, F.greatest(F.size("ids") - F.col("at"), F.lit(0))), "depth": F.lit(seg * piece).cast("long") + F.col("at")})
        ordered = own.repartition("c").sortWithinPartitions("c", "ids").select("c", "up", "head1", "head2", "depth", "parent_conv", "ids", "n", "conv", "ends", "more_children", "more_leaves", "more_saved")
        swept = keep(ordered.mapInArrow(_sweep_all, _SWEPT), "trie-swept")
        nodes.append(swept.where("NOT total").select(*NAMES))
        totals = swept.where("total").select("up", "head1", "head2", F.col("n_children").alias("tops"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        for full in [x for places, x in reversed(heads) if seg in places]:
            below = totals.where("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum("tops").alias("tops"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            joined = _with_more(full.where(F.col("seg") == seg), more).join(below.hint("merge"), "c")
            sums = joined.withColumns({"tops": F.col("tops") + F.col("more_children"), "leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
            bytes_of = lambda t: F.conv(F.hex(F.substring(t, 17, 8)), 16, 10).cast("long")
            gains = F.transform("chain", lambda t: (F.col("n") - 1) * bytes_of(t))
            summed = keep(sums.withColumn("gains", gains), "trie-sums")
            chain = summed.select("*", F.posexplode("gains").alias("i", "gain")).withColumn("last", F.col("i") == F.col("long") - 1)
            rest = F.aggregate(F.slice("gains", F.col("i") + 1, F.col("long")), F.col("saved"), lambda acc, x: acc + x)
            nodes.append(chain.select(F.col("conv").alias("conv_id"), (F.lit(seg * piece) + F.col("at") + F.col("i") + 1).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                                      F.when(F.col("last"), F.col("tops")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), rest.alias("saved_tokens"), F.when(F.col("last"), F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256")))
            whole = F.aggregate("gains", F.col("saved"), lambda acc, x: acc + x)
            above = summed.select("up", "head1", "head2", F.when(F.col("long") > 0, 1).otherwise(F.col("tops")).cast("long").alias("tops"), "leaves", whole.alias("saved"))
            # totals of earlier rounds wait for their own heads
            mine = summed.select(F.col("c").alias("up"))
            totals = totals.join(F.broadcast(mine), "up", "left_anti").union(above)
        totals = keep(totals, "trie-totals")
        if seg:
            more = totals.select(F.col("head1").alias("full1"), F.col("head2").alias("full2"), F.col("tops").alias("more_children"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    turnless = distinct.where((F.col("seg") == 0) & (F.size("ids") == 0)).select("head1", "head2", "ends")
    root = totals.join(turnless.hint("merge"), ["head1", "head2"], "left")
    nodes.append(root.select(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(everyone).cast("long").alias("n_convs"), F.col("tops").alias("n_children"),
                             F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")))
    out = nodes[0]
    for x in nodes[1:]:
        out = out.union(x)
    out = stored(out, "trie-nodes")
    dropped(*temporary)
    return out
