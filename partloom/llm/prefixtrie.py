"""The prefix trie of conversations by truncation peeling.

Every conversation is a path: for each turn a digest of all turns up to it and the length of its text. Conversations
are dealt by ranges of their paths, so that those with common beginnings stand together and a very common first turn
spreads over many tasks. A task peels its range from the greatest depth: at each depth it merges the conversations
that end there with the nodes that survive from below, which makes the nodes of that depth complete; it reports
them, strips their last turn and regroups them by what is left. One pass over the depths finds the nodes and sums
their subtrees at once.

Only nodes on the first and the last path of a range can have members elsewhere. They are not peeled; they go on as
one row a border, with what is known of each of its nodes. A sixteenth as many tasks peel the borders in turn, until
one task peels at most 32 of them. No task holds more of a node than its running sums, however many members it has.

The digest of a node's endings is taken over sorted pieces of at most ``PIECE`` decimal ids each, hashed as they
stream by; no list of a node's endings is ever made.

Defined cases: turns of a null ``conv_id`` take no part; a null turn comes first; turns of equal number are ordered
by the digest of role and text; null role and text are empty; text and role are compared whole, by SHA-256; repeated
rows are turns of their own; a rebuilt conversation may be turnless and is then a member of the root alone; an empty
table gives no rows, not even a root; other columns do not matter. A conversation's turns meet in one task, as digests.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, named, save, tune, width

#: Bytes of a turn in a path: the digest of all turns so far, and the length of its text.
KEY, STEP = 16, 24
#: Ids in one piece of a node's endings; items that are peeled together; tasks whose borders one task takes up.
PIECE, ITEMS, FAN = 4096, 4096, 16
NOTHING = hashlib.sha256(b"").hexdigest()

_SUMS = "depth bigint, n bigint, low bigint, children bigint, leaves bigint, saved bigint, ends string, asked boolean"
_PATHS = "conv_id bigint, path binary"
_ITEMS = f"path binary, first bigint, n bigint, ids string, sums array<struct<{_SUMS.replace(' ', ':').replace(',:', ',')}>>"
_NODE = "own binary, waits binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, asked boolean"
_sums = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("asked", pa.bool_())])
_items = pa.schema([("path", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("sums", pa.list_(_sums))])
_nodes = pa.schema([("own", pa.binary()), ("waits", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("asked", pa.bool_())])


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, turns): every conversation after its first h turns are exchanged for those of the first conversation
    of its block, h being the unsigned crc32 of the decimal id modulo ``heads``; turns are (digest, n_chars)."""
    role, text = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where(named(conv_col).isNotNull()).select(named(conv_col).cast("bigint").alias("conv_id"), F.struct(named(turn_col).alias("turn"), mark.alias("mark"), F.length(text).cast("bigint").alias("n_chars")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["mark"].alias("mark"), t["n_chars"].alias("n_chars"))).alias("own"))
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(first, "base", "left").withColumn("h", h)
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    return joined.select("conv_id", F.concat(start, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, path)."""

    @lean
    def run(batches):
        for b in batches:
            out = []
            for marks, lengths in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key, path = b"", bytearray()
                for m, n in zip(marks, lengths, strict=True):
                    key = hashlib.sha256(key + m).digest()[:KEY]
                    path += key + n.to_bytes(STEP - KEY, "big")
                out.append(bytes(path))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["conv_id", "path"])

    return conversations.select("conv_id", "turns.mark", "turns.n_chars").mapInArrow(run, _PATHS)


def pieces(pathed: DataFrame, parts: int) -> DataFrame:
    """The ids of each path in sorted pieces: rows with ``first``, ``n`` and the ids as text."""
    ranged = pathed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    @lean
    def run(batches):
        path, ids = None, []

        def row():
            return {"path": path, "first": ids[0], "n": len(ids), "ids": ",".join(map(str, ids)), "sums": None}

        for b in batches:
            out = []
            for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (p != path or len(ids) == PIECE):
                    out.append(row())
                    ids = []
                path = p
                ids.append(c)
            yield pa.RecordBatch.from_pylist(out, _items)
        if ids:
            yield pa.RecordBatch.from_pylist([row()], _items)

    return ranged.mapInArrow(run, _ITEMS)


def _key(path: bytes, depth: int) -> bytes:
    return path[STEP * depth - STEP : STEP * depth - STEP + KEY] if depth else b""


class _Node:
    """What is known of a node: one of the paths through it, and sums over its endings and complete children."""

    __slots__ = ("path", "depth", "n", "low", "children", "leaves", "saved", "ends", "asked")

    def __init__(self, path, depth, n=0, low=None, children=0, leaves=0, saved=0, ends=None, asked=False):
        self.path, self.depth, self.n, self.low, self.children, self.leaves, self.saved, self.ends, self.asked = path, depth, n, low, children, leaves, saved, ends, asked

    def add(self, n, low, children, leaves, saved, ends=None, asked=False):
        self.n += n
        self.low = low if self.low is None else self.low if low is None else min(low, self.low)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = ends or self.ends
        self.asked |= asked

    def sums(self) -> dict:
        return {c: getattr(self, c) for c in ("depth", "n", "low", "children", "leaves", "saved", "ends")} | {"asked": True}

    def row(self, parent: _Node, known: bool) -> dict:
        return {"own": _key(self.path, self.depth), "waits": None if known else _key(self.path, self.depth - 1), "conv_id": self.low, "depth": self.depth, "parent_conv_id": parent.low if known and parent else None, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved, "ends_sha256": self.ends or NOTHING, "asked": self.asked}


def _read(batches):
    """Sorted rows -> (path, what is known of its nodes); the pieces of one path are hashed as they come."""
    path, sha, n, low = None, None, 0, None
    for b in batches:
        for r in b.to_pylist():
            if sha is not None and (r["ids"] is None or r["path"] != path):
                yield path, [{"depth": len(path) // STEP, "n": n, "low": low, "children": 0, "leaves": 0, "saved": 0, "ends": sha.hexdigest(), "asked": False}]
                sha = None
            if r["ids"] is None:
                yield r["path"], r["sums"]
            elif sha is None:
                path, sha, n, low = r["path"], hashlib.sha256(r["ids"].encode()), r["n"], r["first"]
            else:
                sha.update(b"," + r["ids"].encode())
                n += r["n"]
    if sha is not None:
        yield path, [{"depth": len(path) // STEP, "n": n, "low": low, "children": 0, "leaves": 0, "saved": 0, "ends": sha.hexdigest(), "asked": False}]


def _grouped(items, many: int):
    """Lists of items, each with whether it is the last."""
    held: list = []
    for x in items:
        if len(held) == many:
            yield held, False
            held = []
        held.append(x)
    if held:
        yield held, True


def peel(items, whole: bool, many: int = ITEMS):
    """Items in the order of their paths -> complete nodes as rows, then the rest by borders. ``whole``: there is no
    other range, so all nodes become complete."""
    left, right, kept = None, None, []
    for group, last in _grouped(items, many):
        left = group[0][0] if left is None else left
        right = group[-1][0]
        levels: dict[int, dict[bytes, _Node]] = defaultdict(dict)
        for node in kept:
            levels[node.depth][_key(node.path, node.depth)] = node
        for path, sums in group:
            for s in sums:
                d = s["depth"]
                node = levels[d].setdefault(_key(path, d), _Node(path, d))
                node.add(*[s[c] for c in ("n", "low", "children", "leaves", "saved", "ends", "asked")])
        kept, below, out = [], [], []
        for d in range(max(levels, default=0), -1, -1):
            here = levels[d]
            for child in below:
                here.setdefault(_key(child.path, d), _Node(child.path, d)).add(child.n, child.low, 1, child.leaves, child.saved)
            shared = set() if whole else {_key(left, d)} if STEP * d <= len(left) else set()
            if not (whole and last) and STEP * d <= len(right):
                shared.add(_key(right, d))
            for child in below:
                parent = here[_key(child.path, d)]
                out.append(child.row(parent, _key(child.path, d) not in shared))
            below = []
            for key, node in here.items():
                if key in shared:
                    node.asked = True
                    kept.append(node)
                    continue
                node.leaves = node.leaves if node.children else 1
                if d:
                    node.saved += (node.n - 1) * int.from_bytes(node.path[STEP * d - STEP + KEY : STEP * d], "big")
                below.append(node)
        out += [root.row(None, True) for root in below]
        yield out, []
    if kept:
        of_left = [x for x in kept if STEP * x.depth <= len(left) and _key(x.path, x.depth) == _key(left, x.depth)]
        own = set(map(id, of_left))
        sides = ((left, of_left), (right, [x for x in kept if id(x) not in own]))
        yield [], [{"path": p, "first": None, "n": None, "ids": None, "sums": [x.sums() for x in side]} for p, side in sides if side]


def _round(items: DataFrame, parts: int) -> DataFrame:
    """One round of peeling: rows with either a node or a border."""
    order = ["path", F.col("first").asc_nulls_last()]
    ranged = (items.repartitionByRange(parts, "path") if parts > 1 else items.repartition(1)).sortWithinPartitions(*order)
    both = pa.schema([("node", pa.struct(list(_nodes))), ("item", pa.struct(list(_items)))])

    @lean
    def run(batches):
        for nodes, borders in peel(_read(batches), parts == 1):
            if nodes or borders:
                yield pa.RecordBatch.from_pylist([{"node": x, "item": None} for x in nodes] + [{"node": None, "item": x} for x in borders], both)

    nested = lambda ddl: f"struct<{', '.join(f'{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}' for c in ddl.split(', '))}>"
    item = f"struct<path: binary, first: bigint, n: bigint, ids: string, sums: {_ITEMS.split('sums ')[1]}>"
    return ranged.mapInArrow(run, f"node {nested(_NODE)}, item {item}")


def trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, turns) -> one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    tune(spark)
    parts = parts or width(spark)
    pathed = save(paths(conversations), "paths")
    now = save(pieces(pathed, parts), "pieces")
    discard(pathed)
    rounds = []
    while True:
        rounds.append(save(_round(now, parts), "peeled"))
        if len(rounds) == 1:
            discard(now)
        if parts == 1:
            break
        now, parts = rounds[-1].where("item IS NOT NULL").select("item.*"), -(-parts // FAN)
    nodes = rounds[0].where("node IS NOT NULL").select("node.*")
    for r in rounds[1:]:
        nodes = nodes.unionAll(r.where("node IS NOT NULL").select("node.*"))
    salts = 16
    asked = nodes.where("asked").select(F.col("own").alias("waits"), F.col("conv_id").alias("found"), F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    waiting = nodes.where("waits IS NOT NULL").withColumn("salt", F.pmod("conv_id", F.lit(salts)).cast("int")).join(asked, ["waits", "salt"])
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = nodes.where("waits IS NULL").select(*columns, "parent_conv_id").unionAll(waiting.select(*columns, F.col("found").alias("parent_conv_id")))
    return done.select("conv_id", "depth", "parent_conv_id", *columns[2:])
