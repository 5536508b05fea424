"""A prefix trie over the turns of conversations, built from z-fast tries.

A prefix of d turns is named by a 128-bit sum of hashes of (place, turn), so that names add up: a conversation of any length is cut into chunks of
``CHUNK`` turns, and a chunk knows the names of its prefixes from the sums of the chunks before it. Every chunk hangs below the name of the prefix
it continues; long edges therefore end at multiples of ``CHUNK``, and no row holds a whole long conversation.

Tasks put their chunks into z-fast tries (``ZFastTrie``): compacted nodes are found in a hash table by the name of the prefix at the two-fattest
depth of their edge, a chunk finds its exit node by a fat binary search over depths, batches are inserted in the order of their exit nodes, and the
edges are expanded at the end. A trie is given out when it has ``TRIE_TURNS`` turns, so memory is bounded; what two tries share has the same name and
meets in one aggregation with map-side combine, so a first turn that a third of all conversations have costs one row per trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from .common import stored

#: Turns in a chunk: the most that an edge, and a row, can hold.
CHUNK = 32
#: Turns after which a task gives out its trie and begins another one.
TRIE_TURNS = 400_000
#: Bytes of ids that are handed on together for a node's digest.
ID_BLOCK = 1 << 16
ROOT = bytes(16)
_WORDS = r"[^\x20\x09-\x0D]+"
_LANES = 4
_LOW = (1 << 32) - 1


# -- turns


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id long, place long from 1, symbol binary, words long) of every turn that has a conversation.

    Places follow ``turn``, null first; rows with the same turn are ordered by
    the digest of role and text, so repeated rows are turns of their own and
    every run numbers them alike. Null roles and texts are empty ones. Rows
    without a conv_id belong to no conversation. Other columns have no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(_WORDS)).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", symbol.alias("symbol"), words.alias("words"))
    return running(rows, [F.col("turn").asc_nulls_first(), "symbol"], ["conv_id"], number="place").select("conv_id", "place", "symbol", "words")


def branched(own: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every conversation c begins with the first h turns of conversation c - c % ``family`` instead of its own first h turns,
    with h = crc32(c) % ``heads``. ``own`` are the rows of ``turns``; the second table holds every conv_id, those left without a turn too.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    # At most heads - 1 rows for each conversation.
    first = own.where(F.col("place") < heads).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol", "words"))).alias("first"))
    convs = convs.join(first, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("conv_id", "h", F.size("first").cast("long").alias("taken"), "first"), "branched")
    lead = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.*")
    rest = own.where(F.col("place") > h).join(convs.select("conv_id", "taken"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") - h + F.col("taken")).alias("place"), "symbol", "words")
    return lead.unionByName(rest), convs.select("conv_id")


# -- the trie of a task


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class _Node:
    """A compacted node: its edge covers the depths (low, high] of a chunk's prefixes."""

    __slots__ = ("names", "item", "low", "high", "parent", "n", "ends", "least")

    def __init__(self, names: list[bytes], item: int, low: int, high: int, parent: _Node | None):
        self.names, self.item, self.low, self.high, self.parent = names, item, low, high, parent
        self.n = self.ends = 0
        self.least: int | None = None


class ZFastTrie:
    """Z-fast tries of chunks, one for each prefix that chunks continue.

    A chunk is a list of names: of the prefix it continues, then of each longer
    one. ``handles`` finds a node by the name at the two-fattest depth of its
    edge, ``branches`` by the name at the edge's first depth.
    """

    def __init__(self):
        self.roots: dict[bytes, _Node] = {}
        self.handles: dict[bytes, _Node] = {}
        self.branches: dict[bytes, _Node] = {}
        self.nodes: list[_Node] = []

    def exit_node(self, names: list[bytes], start: _Node) -> _Node:
        """The node whose edge a chunk leaves, by fat binary search below ``start``, a node whose whole edge the chunk has."""
        node, low, high = start, start.high, len(names) - 1
        while low < high:
            at = two_fattest(low, high)
            found = self.handles.get(names[at])
            if found is None:
                high = at - 1
            else:
                node, low = found, found.high
        # The last node found may be left at its end, before the handle of the next one.
        if node.high < len(names) - 1 and node.names[node.high] == names[node.high]:
            return self.branches.get(names[node.high + 1], node)
        return node

    def _shared(self, names: list[bytes], node: _Node) -> int:
        """Depth to which a chunk has the edge of its exit node (names once different stay so)."""
        low, high = node.low, min(node.high, len(names) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.names[middle] == names[middle] else (low, middle - 1)
        return low

    def _add(self, node: _Node) -> _Node:
        self.nodes.append(node)
        if node.high > node.low:
            self.handles[node.names[two_fattest(node.low, node.high)]] = node
            self.branches[node.names[node.low + 1]] = node
        return node

    def _split(self, node: _Node, depth: int) -> _Node:
        """Cut a node's edge at a depth inside; the new node takes the upper part."""
        del self.handles[node.names[two_fattest(node.low, node.high)]]
        upper = self._add(_Node(node.names, node.item, node.low, depth, node.parent))
        node.low, node.parent = depth, upper
        self.handles[node.names[two_fattest(depth, node.high)]] = node
        self.branches[node.names[depth + 1]] = node
        return upper

    def insert(self, chunks: list[list[bytes]], items: list[int], conv_ids: list[int], last: list[bool]) -> None:
        """Insert a batch: all exit nodes are located first, then chunks are added exit node by exit node, each looking again only below its own."""
        roots = []
        for names, item in zip(chunks, items):
            if (root := self.roots.get(names[0])) is None:
                root = self.roots[names[0]] = self._add(_Node(names, item, 0, 0, None))
            roots.append(root)
        exits = [self.exit_node(names, root) for names, root in zip(chunks, roots)]
        place = {id(node): k for k, node in enumerate({id(e): e for e in exits}.values())}
        for k in sorted(range(len(chunks)), key=lambda k: (place[id(exits[k])], chunks[k])):
            names = chunks[k]
            # An edge that was cut since then is followed from above it.
            start = exits[k] if exits[k].high < len(names) and exits[k].names[exits[k].high] == names[exits[k].high] else exits[k].parent
            node = self.exit_node(names, start)
            depth = self._shared(names, node)
            if depth < node.high:
                node = self._split(node, depth)
            if depth < len(names) - 1:
                node = self._add(_Node(names, items[k], depth, len(names) - 1, node))
            node.n += 1
            node.ends += last[k]
            node.least = conv_ids[k] if node.least is None else min(node.least, conv_ids[k])

    def summed(self) -> list[_Node]:
        """All nodes, with counts and smallest conversations of their subtrees."""
        self.nodes.sort(key=lambda n: -n.high)
        for node in self.nodes:
            if (up := node.parent) is not None:
                up.n += node.n
                if up.least is None or (node.least is not None and node.least < up.least):
                    up.least = node.least
        return self.nodes


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first, words) of a batch's chunks: for each chunk the name it continues and those of its prefixes, 16 bytes each."""
    lists = batch.column("turns")
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    flat = lists.flatten()
    lanes = np.stack([np.asarray(flat.field(f"lane{k}")) for k in range(_LANES)], axis=1).astype(np.uint32).reshape(-1, _LANES)
    base = np.stack([np.asarray(batch.column(f"base{k}")) for k in range(_LANES)], axis=1).astype(np.uint32)
    first = at + np.arange(len(at))  # each chunk has one name more than turns
    steps = np.zeros((first[-1], _LANES), np.uint32)
    words = np.zeros(first[-1], np.int64)
    is_turn = np.ones(first[-1], bool)
    is_turn[first[:-1]] = False
    steps[is_turn], words[is_turn] = lanes, np.asarray(flat.field("words"))
    sums = np.cumsum(steps, axis=0, dtype=np.uint32)
    chunk = np.repeat(np.arange(len(base)), np.diff(first))
    return sums - sums[first[:-1]][chunk] + base[chunk], first, words


_PART = "key binary, parent binary, depth long, conv_id long, n_convs long, n_ends long, words long, above array<binary>"


def _expanded(trie: ZFastTrie, names: np.ndarray, first: np.ndarray, words: np.ndarray, depth0: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every prefix on the edges of a trie as a row; ``above`` names the prefixes above it from the one its chunk continues on."""
    nodes = [n for n in trie.summed() if n.high > n.low or depth0[n.item] == 0]
    # A root that is no prefix of another chunk stands for itself.
    tall = np.array([max(1, n.high - n.low) for n in nodes], np.int64)
    item = np.array([n.item for n in nodes], np.int64)
    low = np.array([n.low + (n.high > n.low) for n in nodes], np.int64)
    column = {c: np.array([getattr(n, c) for n in nodes], np.int64) for c in ("n", "ends", "least")}
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(np.ascontiguousarray(names.astype(">u4")))]).cast(pa.binary())
    step = 20_000
    for k in range(0, len(nodes), step):
        of = np.repeat(np.arange(k, min(k + step, len(nodes))), tall[k : k + step])
        inside = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(tall[k : k + step])[:-1]]), tall[k : k + step])
        depth = low[of] + inside
        begin = first[item[of]]
        offsets = np.concatenate([[0], np.cumsum(depth)])
        above = np.repeat(begin - offsets[:-1], depth) + np.arange(offsets[-1])
        yield pa.RecordBatch.from_arrays(
            [
                raw.take(pa.array(begin + depth)),
                raw.take(pa.array(begin + depth - 1, mask=depth == 0)),
                pa.array(depth0[item[of]] + depth),
                pa.array(column["least"][of]),
                pa.array(column["n"][of]),
                pa.array(np.where(inside == tall[of] - 1, column["ends"][of], 0)),
                pa.array(words[begin + depth]),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), raw.take(pa.array(above))),
            ],
            ["key", "parent", "depth", "conv_id", "n_convs", "n_ends", "words", "above"],
        )


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def given() -> Iterator[pa.RecordBatch]:
        names = np.concatenate([h[0] for h in held])
        shift = np.cumsum([0, *(len(h[0]) for h in held)])
        first = np.concatenate([h[1][:-1] + s for h, s in zip(held, shift)])
        yield from _expanded(trie, names, first, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))

    trie, size, item = ZFastTrie(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names, first, words = _names(batch)
        raw = names.astype(">u4").tobytes()
        chunks = [[raw[16 * j : 16 * j + 16] for j in range(a, b)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        trie.insert(chunks, list(range(item, item + len(chunks))), batch.column("conv_id").to_pylist(), batch.column("last").to_pylist())
        held.append((names, first, words, np.asarray(batch.column("chunk")) * CHUNK))
        size, item = size + len(names), item + len(chunks)
        if size >= TRIE_TURNS:
            yield from given()
            trie, size, item = ZFastTrie(), 0, 0
            held.clear()
    if held:
        yield from given()


# -- digests of ids that end at a node


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) as rows (key, first id, ids joined by commas) of bounded size."""
    key, ids, size = None, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([int(ids[0])]), pa.array([",".join(ids)])], ["key", "first", "ids"])

    for batch in batches:
        done = []
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (k != key or size >= ID_BLOCK):
                done.append(block())
                ids, size = [], 0
            key = k
            ids.append(str(i))
            size += len(ids[-1]) + 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if ids:
        yield block()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of ids as rows (key, digest); a node's blocks pass through one hash, a block at a time."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


# -- all together


def _chunks(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, chunk, base0..3, total0..3, turns, last): the chunks of all conversations, an empty one for those without turns."""
    a, b = F.xxhash64("place", "symbol"), F.xxhash64("symbol", F.lit("2"), "place")
    lanes = [F.col("a").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("a", 32), F.col("b").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("b", 32)]
    rows = paths.select("conv_id", "place", "words", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"), a.alias("a"), b.alias("b"))
    rows = rows.select("conv_id", "chunk", "place", "words", *[x.alias(f"lane{k}") for k, x in enumerate(lanes)])
    turn = F.struct("place", "words", *[f"lane{k}" for k in range(_LANES)])
    made = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"), *[F.sum(f"lane{k}").alias(f"sum{k}") for k in range(_LANES)])
    # A row for every CHUNK turns: the sums of the chunks before, without a limit on a conversation's length.
    along = Window.partitionBy("conv_id").orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum(f"sum{k}").over(before), F.lit(0)) for k in range(_LANES)]
    full = made.select(
        "conv_id",
        "chunk",
        "turns",
        *[F.pmod(x, F.lit(1 << 32)).alias(f"base{k}") for k, x in enumerate(base)],
        *[F.pmod(x + F.col(f"sum{k}"), F.lit(1 << 32)).alias(f"total{k}") for k, x in enumerate(base)],
        F.lead("chunk").over(along).isNull().alias("last"),
    )
    zero = [F.lit(0).cast("long").alias(f"{name}{k}") for name in ("base", "total") for k in range(_LANES)]
    none = convs.join(paths.where("place = 1").select("conv_id"), "conv_id", "left_anti")
    return full.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("chunk"), F.array().cast(full.schema["turns"].dataType).alias("turns"), *zero, F.lit(True).alias("last")))


def _name(prefix: str) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(f"{prefix}{k}"), 8, "0") for k in range(_LANES)]))


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(key, n_children, n_leaves, saved_tokens) of every node.

    A node adds to the prefixes above it in its chunk; the sums of chunks that
    continue a prefix are carried over to the chunks above by following links
    in doubled steps, so the rounds grow with the logarithm of the depth.
    """
    own = nodes.withColumn("leaf", (F.col("n_convs") == F.col("n_ends")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    pairs = own.select(F.explode(F.concat("above", F.array("key"))).alias("of"), "key", "parent", "leaf", "saved")
    child = F.sum(F.coalesce(F.col("of") == F.col("parent"), F.lit(False)).cast("long"))
    sums = stored(pairs.groupBy(F.col("of").alias("key")).agg(child.alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-sums")

    ends = own.where((F.col("depth") > 0) & (F.col("depth") % CHUNK == 0)).select("key", "above", "leaf", "saved")
    below = ends.join(sums.where("n_children > 0"), "key").select("key", "above", (F.col("n_leaves") - F.col("leaf")).alias("leaf"), (F.col("saved_tokens") - F.col("saved")).alias("saved"))
    below = stored(below, "trie-chunks")
    if below.isEmpty():
        return sums
    links = below.select("key", F.col("above")[0].alias("up"), "leaf", "saved")
    while not links.where(F.col("up") != F.lit(ROOT)).isEmpty():
        gained = links.groupBy(F.col("up").alias("key")).agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
        further = links.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        grown = links.join(gained, "key", "left").join(further, "up", "left")
        links = stored(
            grown.select("key", F.coalesce("_up", F.lit(ROOT)).alias("up"), (F.col("leaf") + F.coalesce("_leaf", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")), "trie-links"
        )
    carried = below.select("key", "above").join(links, "key").select(F.explode("above").alias("key"), "leaf", "saved")
    carried = carried.groupBy("key").agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    more = sums.join(carried, "key", "left")
    return more.select("key", "n_children", (F.col("n_leaves") + F.coalesce("_leaf", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))


def nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of turns, the empty one included.

    ``paths`` has (conv_id, place from 1 without gaps, symbol, words), ``convs``
    every conv_id once. Returns key (the prefix's name), conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, n_convs - 1 times the words of the
    node's last turn) and ends_sha256 (of the ids that end there). No
    conversations give no rows; conversations without turns end at the root.
    """
    chunks = stored(_chunks(paths, convs), "trie-chunks")
    parts = chunks.select("conv_id", "chunk", "turns", "last", *[f"base{k}" for k in range(_LANES)]).mapInArrow(_tries, _PART)
    same = [F.first(c).alias(c) for c in ("parent", "depth", "words", "above")]
    made = stored(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"), *same), "trie-nodes")

    ends = chunks.where("last").select(_name("total").alias("key"), "conv_id")
    blocks = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_blocks, "key binary, first long, ids string")
    digests = blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")

    root = made.where("depth = 0").select("conv_id").first()
    upper = made.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    out = made.drop("above", "words").join(_subtree_sums(made), "key").join(digests, "key", "left")
    # The root is the parent of most nodes: its one value is not joined.
    parent = F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")).otherwise(F.col("_above"))
    out = out.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent"))).join(upper, "parent", "left").withColumn("parent_conv_id", parent)
    return out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
