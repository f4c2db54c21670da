"""Trie of shared conversation prefixes from vertical bitmaps.

Conversations are cut into shards of consecutive ids. A shard's index maps (position, turn) to the bitset of its
conversations with that turn there. Going depth first, the lowest conversation left of a node names the next child's
turn; the node's bitset intersected with that posting is the child, its popcount the members, and the members that end
at this depth the end list. A node is known everywhere by the digest of its turns, so the shards' nodes are summed by
digest. What the sums count once for each shard (leaves, children, saved bytes) is corrected along the trunk: the
nodes that several shards hold. These sums over subtrees of the trunk double the distance they reach with each round.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.llm.common import slices
from broadloom.session import durable

#: A shard ends after so many conversations or turns: bitsets have that many bits, the index that many entries.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 65_536
FAMILY, MOST_BORROWED = 5, 9
ROOT = bytes(16)
NODES = ("path binary, parent binary, depth bigint, first bigint, parent_first bigint, size bigint, bytes bigint, children bigint, "
         "leaves bigint, leaf bigint, saved bigint, ends string")


def borrowed(conv: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv).encode()) % MOST_BORROWED


def _rebuilt(batches):
    """(conversation, its turns as (digest, bytes) pairs) in ascending order of families; a family is held at a time."""
    family, own = None, {}

    def done():
        base = own.get(family, [])
        for c in sorted(own):
            h = borrowed(c)
            yield c, base[:h] + own[c][h:]

    for batch in slices(batches, 4096):
        for b, c, turn in zip(batch.column("family").to_pylist(), batch.column("conv").to_pylist(),
                              zip(batch.column("digest").to_pylist(), batch.column("bytes").to_pylist())):
            if b != family:
                yield from done()
                family, own = b, {}
            own.setdefault(c, []).append(turn)
    yield from done()


def shard_nodes(shard: list) -> list[tuple]:
    """Nodes of a shard, parents first, as rows of NODES; ``shard`` has (id, turns) in ascending order of ids."""
    postings, lengths = {}, {}
    for i, (_, turns) in enumerate(shard):
        lengths[len(turns)] = lengths.get(len(turns), 0) | 1 << i
        for p, turn in enumerate(turns):
            postings[p, turn] = postings.get((p, turn), 0) | 1 << i
    lowest = lambda bits: (bits & -bits).bit_length() - 1
    nodes, stack = [], [((1 << len(shard)) - 1, 0, ROOT, -1, 0)]
    while stack:
        members, depth, path, parent, size = stack.pop()
        at, ends = len(nodes), members & lengths.get(depth, 0)
        children, left = 0, members & ~ends
        while left:
            turn = shard[lowest(left)][1][depth]
            child = left & postings[depth, turn]
            left ^= child
            children += 1
            stack.append((child, depth + 1, hashlib.sha256(path + turn[0]).digest()[:16], at, turn[1]))
        names = []
        while ends:
            i = lowest(ends)
            names.append(str(shard[i][0]))
            ends &= ends - 1
        n = members.bit_count()
        nodes.append([path, parent, depth, shard[lowest(members)][0], n, size, children, int(not children), (n - 1) * size, ",".join(names) or None])
    leaves, saved = [x[7] for x in nodes], [x[8] for x in nodes]
    for at in range(len(nodes) - 1, 0, -1):  # children come after their parents
        leaves[nodes[at][1]] += leaves[at]
        saved[nodes[at][1]] += saved[at]
    return [(x[0], nodes[x[1]][0] if at else None, x[2], x[3], nodes[x[1]][3] if at else None, x[4], x[5], x[6], leaves[at], x[7], saved[at], x[9])
            for at, x in enumerate(nodes)]


def _shards(batches):
    names = [part.split()[0] for part in NODES.split(", ")]
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
    types = [kinds[part.split()[1]] for part in NODES.split(", ")]

    def rows(shard):
        nodes = shard_nodes(shard)
        for i in range(0, len(nodes), 8192):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*nodes[i:i + 8192]), types)], names=names)

    shard, turns, family = [], 0, None
    for conv, seq in _rebuilt(batches):
        home = conv - (conv % FAMILY if conv >= 0 else -(-conv % FAMILY))
        if shard and home != family and (len(shard) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS):
            yield from rows(shard)
            shard, turns = [], 0
        family = home
        shard.append((conv, seq))
        turns += len(seq)
    if shard:
        yield from rows(shard)


def _joined_hashes(batches):
    """SHA-256 of the end lists of each path, joined in order; only the hash's state is held."""
    path, state = None, None
    for batch in slices(batches, 64):
        out = []
        for p, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist()):
            if p != path:
                if state is not None:
                    out.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["path", "sha"])
    if state is not None:
        yield pa.record_batch([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "sha"])


def _down_the_trunk(trunk: DataFrame, depth: int) -> DataFrame:
    """(path, leaves, saved): the corrections summed over each subtree of the trunk."""
    reach = trunk.select("path", F.col("parent").alias("up"), "leaves", "saved")
    step = 1
    while step <= depth:  # after each round: everything within 2 x step levels below
        below = reach.filter("up is not null").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = reach.select(F.col("path").alias("up"), F.col("up").alias("upper"))
        reach = durable(reach.join(below, "path", "left").join(above, "up", "left").select(
            "path", F.col("upper").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
        step *= 2
    return reach.select("path", "leaves", "saved")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    A conversation's rows are ordered by turn, NULL first, rows of one turn by the digest of role and text; a row that
    repeats is a turn of its own. NULL roles and texts are empty. Conversation c takes the first crc32(c) mod 9 turns of
    conversation c - c mod 5 (sign of c), if there is one, then its own after as many. Each distinct sequence of first
    turns is a node, from the root without turns; a conversation whose rebuilt sequence is empty belongs to the root
    alone. Rows with a NULL id belong to no conversation; without conversations there is no node.

    Texts stay where they are: 16 bytes of SHA-256 over role and text, and the text's bytes, stand for a turn. One
    range shuffle brings families of conversations together; a shard has at most 4096 conversations (and the rest of
    the last family) and is one bitmap index. A single conversation has to fit a task with 100 bytes a turn. Long end
    lists are hashed as a stream, since SHA-256 has an order.
    """
    c = F.col(conv_id).cast("bigint")
    said, who = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (text, role))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)), 1, 16)
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(
        (c - c % FAMILY).alias("family"), c.alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("bytes"))
    turns = turns.repartitionByRange("family").sortWithinPartitions("family", "conv", F.asc_nulls_first("turn"), "digest")
    nodes = durable(turns.mapInArrow(_shards, NODES))
    merged = durable(nodes.groupBy("path", "parent", "depth", "bytes").agg(
        F.count(F.lit(1)).alias("shards"), F.min("first").alias("first"), F.min("parent_first").alias("parent_first"), F.sum("size").alias("size"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"),
        F.max("ends").alias("ends")))

    several = merged.filter("shards > 1")
    trunk = durable(several.select(
        "path", "parent", "depth", "first", (F.col("shards") - 1).alias("extra"),
        (F.when(F.col("leaf") == F.col("shards"), 1).otherwise(0) - F.col("leaf")).cast("bigint").alias("leaves"),
        ((F.col("shards") - 1) * F.col("bytes")).alias("saved")))
    depth = trunk.agg(F.max("depth")).first()[0] or 0
    sums = _down_the_trunk(trunk, depth)
    fewer = trunk.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.sum("extra").alias("fewer"))
    lists = nodes.filter("ends is not null").join(trunk.select("path"), "path", "left_semi").select("path", "first", "ends")
    hashes = lists.repartition("path").sortWithinPartitions("path", "first").mapInArrow(_joined_hashes, "path binary, sha string")
    facts = durable(trunk.select("path", F.col("first").alias("trunk_first")).join(
        sums.select("path", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")), "path").join(fewer, "path", "left").join(
        hashes, "path", "left"))

    up = facts.select(F.col("path").alias("parent"), F.col("trunk_first").alias("parent_trunk"))
    out = merged.join(facts.drop("trunk_first"), "path", "left").join(up, "parent", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    empty = F.coalesce("ends", F.lit(""))
    return out.select(
        F.col("first").alias("conv_id"), "depth", F.coalesce("parent_trunk", "parent_first").alias("parent_conv_id"), F.col("size").alias("n_convs"),
        (F.col("children") - zero("fewer")).alias("n_children"), (F.col("leaves") + zero("more_leaves")).alias("n_leaves"),
        (F.col("saved") + zero("more_saved")).alias("saved_tokens"),
        F.when(F.col("shards") == 1, F.sha2(empty, 256)).otherwise(F.coalesce("sha", F.sha2(F.lit(""), 256))).alias("ends_sha256"))
