"""The prefix trie of many conversations, peeled from its deepest level.

A conversation is a sequence of turns; every distinct beginning of one is a
node. Keys of beginnings are chained digests, made while the turns of a
conversation stream by in order, so texts are read once and never shuffled.
Equal conversations become one class with its number and the digest of its ids.

The trie is found by truncation: at the deepest level the conversations that
end there are nodes; their last turns are stripped, which groups them with
their siblings and with the conversations that end one turn earlier. Each
stripping adds up members, children, leaves and saved tokens, so every node is
discovered and finished in the same pass, and only one level is held.

Where at most ``LIGHT`` classes go through a node, its whole subtree is peeled
in one task, as a stream of turns sorted by falling depth: memory holds the
survivors of one level. Nodes above that, the root among them, are few; they
are peeled by aggregations, one a level, whose partial sums keep a beginning
shared by a third of all conversations from landing in one task.

Defined cases: a null role or text counts as empty. Turns are ordered by
``turn`` (null first), ties by role, then by the digest of the text; repeated
rows are turns of their own. Rows without a conversation id belong to no
conversation. A conversation may have no turn left: it is a member of the root
alone. An empty table gives no rows, not even a root. Keys are 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from logvane.session import materialize

#: classes of equal conversations below a node, up to which its subtree is peeled in one task
LIGHT = 50_000
#: turns that a conversation may take over from the first one of its block of ids
BLOCK, TAKEN = 20, 4
ROOT = bytes(16)
ROWS_OUT = 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()),
                   ("words", pa.int64()), ("last", pa.bool_())])
_PATH_SQL = "conv_id long, depth long, key binary, parent binary, words long, last boolean"
_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                   ("ends_sha256", pa.string()), ("top", pa.bool_())])
_NODE_SQL = ("key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, ends_sha256 string, top boolean")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of bounded size."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


# ---- paths


def _step(node: tuple, digest: bytes, words: int) -> tuple:
    """The node one turn below."""
    conv_id, depth, key, _, _ = node
    return conv_id, depth + 1, hashlib.blake2b(key + digest, digest_size=16).digest(), key, words


def paths(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK,
          taken: int = TAKEN) -> DataFrame:
    """``conv_id, depth, key, parent, words, last``: every rebuilt conversation's nodes.

    With h the CRC-32 of its id modulo ``taken``, a conversation begins with the
    first h turns of the first conversation of its block of ids and goes on
    with its own turns after its first h. A block streams through one task,
    its first conversation ahead, of which ``taken`` turns are remembered.
    """
    said = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cid = F.col(f"`{conv}`").cast("long")
    turns = df.filter(cid.isNotNull()).select(
        cid.alias("conv_id"), (cid - cid % block).alias("base"), (F.crc32(cid.cast("string").cast("binary")) % taken).alias("h"),
        F.col(f"`{turn}`").alias("turn"), said.alias("role"), F.md5(words.cast("binary")).alias("digest"),
        F.regexp_count(words, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ordered = turns.repartition("base").sortWithinPartitions(
        "base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"
    ).select("base", "conv_id", "h", "role", "digest", "words")

    def one(rows: Iterator[tuple]) -> Iterator[tuple]:
        # ``chain`` is the node reached last, given out once it is known whether the conversation ends there
        head_of, head, current, seen, chain = None, [], None, 0, None
        for base, conv_id, h, said, digest, n in rows:
            if base != head_of:
                head_of, head = base, []
            if conv_id != current:
                if chain is not None:
                    yield (*chain, True)
                current, seen, chain = conv_id, 0, (conv_id, 0, ROOT, None, 0)
                if conv_id != base:
                    for known in head[:h]:
                        yield (*chain, False)
                        chain = _step(chain, *known)
            item = (hashlib.blake2b(said.encode() + b"\0" + digest.encode(), digest_size=16).digest(), n)
            seen += 1
            if conv_id == base and len(head) < taken:
                head.append(item)
            if conv_id == base or seen > h:
                yield (*chain, False)
                chain = _step(chain, *item)
        if chain is not None:
            yield (*chain, True)

    return ordered.mapInArrow(lambda batches: _batches(one(_rows(batches)), _PATH), _PATH_SQL)


def ended(path: DataFrame) -> DataFrame:
    """Classes of equal conversations: ``key, n, first, sha``; the digest of the ids runs over a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classes() -> Iterator[tuple]:
            current = state = None
            n = first = 0
            for key, conv_id in _rows(batches):
                if key != current:
                    if current is not None:
                        yield current, n, first, state.hexdigest()
                    current, n, first, state = key, 0, conv_id, hashlib.sha256()
                state.update((b"," if n else b"") + str(conv_id).encode())
                n += 1
            if current is not None:
                yield current, n, first, state.hexdigest()

        schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("first", pa.int64()), ("sha", pa.string())])
        yield from _batches(classes(), schema)

    ends = path.filter("last").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ends.mapInArrow(run, "key binary, n long, first long, sha string")


# ---- peeling


class _Survivor:
    """A node while its children are stripped onto it."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "below")

    def __init__(self):
        self.n, self.conv, self.children, self.leaves, self.saved, self.below = 0, None, 0, 0, 0, []


def peel(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Finished nodes of the subtrees whose rows come sorted by subtree, falling depth and key.

    Rows are ``top, group, depth, key, parent, words, n, conv_id, sha``: a node
    on the path of a class, with the class's size and ids where it ends there.
    """
    survivors: dict[bytes, _Survivor] = {}
    stripped: dict[bytes, _Survivor] = {}
    group = depth = key = node = None

    def finish():
        """Complete the node that was read, strip its last turn, and give out its children."""
        g_depth, parent, words, state, sha = node
        saved = state.saved + (state.n - 1) * words
        row = (key, parent, state.conv, depth, None, state.n, state.children, max(state.leaves, 1), saved, sha or NO_ENDS)
        for child in state.below:
            yield (*child[:4], state.conv, *child[5:], False)
        if depth == g_depth:
            yield (*row, True)
            return
        up = stripped.setdefault(parent, _Survivor())
        up.n += state.n
        up.conv = state.conv if up.conv is None else min(up.conv, state.conv)
        up.children += 1
        up.leaves += max(state.leaves, 1)
        up.saved += saved
        up.below.append(row)

    for g_depth, g, d, k, parent, words, n, conv_id, sha in rows:
        if k != key or d != depth or g != group:
            if node is not None:
                yield from finish()
            if d != depth or g != group:
                survivors, stripped = stripped, {}
            group, depth, key = g, d, k
            node = [g_depth, parent, words, survivors.pop(k, None) or _Survivor(), None]
        if n is not None:
            state = node[3]
            state.n += n
            state.conv = conv_id if state.conv is None else min(state.conv, conv_id)
            node[4] = sha
    if node is not None:
        yield from finish()


def trie(path: DataFrame, light: int = LIGHT) -> DataFrame:
    """One row per node of the trie of these paths."""
    path = materialize(path, "trie_paths")
    classes = materialize(ended(path), "trie_classes")
    one_each = path.join(classes.select(F.col("first").alias("conv_id"), "n", "sha"), "conv_id")
    heavy = materialize(one_each.groupBy("key").agg(
        F.count("*").alias("classes"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("words").alias("words")
    ).filter((F.col("depth") == 0) | (F.col("classes") > light)).drop("classes"), "trie_heavy")

    # below the last heavy node of its path a class belongs to one light subtree
    marked = one_each.join(heavy.select("key", F.lit(True).alias("heavy")), "key", "left")
    along = Window.partitionBy("conv_id")
    marked = marked.withColumn("g_depth", F.max(F.when(F.col("heavy"), F.col("depth"))).over(along) + 1).filter("depth >= g_depth")
    marked = marked.withColumn("group", F.max(F.when(F.col("depth") == F.col("g_depth"), F.col("key"))).over(along))
    size = F.when(F.col("last"), F.col("n"))
    rows = marked.select("g_depth", "group", "depth", "key", "parent", "words", size.alias("n"), "conv_id", F.when(F.col("last"), F.col("sha")).alias("sha"))
    sorted_rows = rows.repartition("group").sortWithinPartitions("group", F.col("depth").desc(), "key")
    peeled = materialize(sorted_rows.mapInArrow(lambda b: _batches(peel(_rows(b)), _NODE), _NODE_SQL), "trie_nodes")

    columns = [f.name for f in _NODE][:-1]
    finished = [peeled.filter("NOT top").select(*columns)]
    open_tops = peeled.filter("top").select(*columns)
    survivors = None
    deepest = heavy.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = open_tops.filter(F.col("depth") == depth + 1)
        level = level if survivors is None else level.unionByName(survivors)
        below = level.groupBy(F.col("parent").alias("key")).agg(
            F.sum("n_convs").alias("c_n"), F.min("conv_id").alias("c_conv"), F.count("*").alias("c_children"),
            F.sum("n_leaves").alias("c_leaves"), F.sum("saved_tokens").alias("c_saved"),
        )
        here = heavy.filter(F.col("depth") == depth).join(below, "key", "left").join(classes, "key", "left")
        n = F.coalesce("c_n", F.lit(0)) + F.coalesce("n", F.lit(0))
        nodes = materialize(here.select(
            "key", "parent", F.least("c_conv", "first").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"),
            n.alias("n_convs"), F.coalesce("c_children", F.lit(0)).alias("n_children"), F.coalesce("c_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("c_saved", F.lit(0)) + (n - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"),
        ), "trie_level")
        parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        finished.append(level.drop("parent_conv_id").join(parents, "parent").select(*columns))
        survivors = nodes
    if survivors is not None:
        finished.append(survivors)
    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    return result.select(*RESULT)
