"""Prefix trie of the action sequences of entities, by vertical bitmaps.

A node of the trie is a distinct sequence of first actions; its members are the entities that begin with
it. Entities are dealt in order of their ids to shards of at most ``SHARD`` entities. In a shard, each
(position, action) has a bitset of the entities that have that action at that position; going down from the
root, a node's bitset is intersected with the posting of the next action of its lowest entity, which gives
the child and is taken out of the parent until nothing is left. Popcounts are members, entities whose
sequence ends here are the node's end list. A node with one entity is a plain chain and needs no bitsets.

Nodes of all shards meet by a 128-bit digest of their sequence, which grows action by action. Counts are
added up in groups that shrink before they are shuffled. Sums over subtrees are made only for nodes with
several entities, since a chain of one entity is one leaf: pointers to ancestors are doubled, so the number
of rounds is the logarithm of the depth of the deepest shared node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.columns import text_or_empty, word_count
from chronotrace.llm.ngram_join import stored

SHARD = 1024  # entities
SHARD_ACTIONS = 1 << 18
ROOT = bytes(16)
OUT = 8192  # rows


def action_mark(kind_col: str, text_col: str):
    """Digest of a kind and a text; null is empty."""
    kind, text = text_or_empty(kind_col), text_or_empty(text_col)
    return F.unhex(F.sha2(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, text), 256))


def marked(nodes: DataFrame, entity_col: str = "entity_id", order_cols: tuple[str, ...] = ("frame_idx",), kind_col: str = "trigger_rule", text_col: str = "action") -> DataFrame:
    """``entity_id, mark, n_words`` and the order columns: all the trie needs of a node; texts stay behind."""
    return nodes.select(F.col(entity_col).alias("entity_id"), *order_cols, action_mark(kind_col, text_col).alias("mark"), word_count(text_col).cast("int").alias("n_words"))


class _Shard:
    """Entities in order of id with their actions; ``walk`` gives the local nodes."""

    def __init__(self):
        self.ids, self.actions, self.n = [], [], 0

    def add(self, entity) -> None:
        self.ids.append(entity)
        self.actions.append([])

    def walk(self):
        """Rows (key, parent, depth, members, first id, words, ids of ends) from the root down."""
        postings: list[dict] = []
        ending: dict[int, int] = {}
        words: dict[bytes, int] = {}
        for i, seq in enumerate(self.actions):
            bit = 1 << i
            ending[len(seq)] = ending.get(len(seq), 0) | bit
            for pos, (mark, n) in enumerate(seq):
                if pos == len(postings):
                    postings.append({})
                postings[pos][mark] = postings[pos].get(mark, 0) | bit
                words[mark] = n
        todo = [(ROOT, None, 0, 0, (1 << len(self.ids)) - 1)] if self.ids else []
        while todo:
            key, parent, depth, n_words, members = todo.pop()
            ends = members & ending.get(depth, 0)
            yield key, parent, depth, members.bit_count(), self.ids[_lowest(members)], n_words, [self.ids[i] for i in _bits(ends)]
            rest = members ^ ends
            while rest:
                mark = self.actions[_lowest(rest)][depth][0]
                child = rest & postings[depth][mark]
                rest ^= child
                todo.append((_key(key, mark), key, depth + 1, words[mark], child))


def _key(parent: bytes, mark: bytes) -> bytes:
    return hashlib.sha256(parent + mark).digest()[:16]


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _bits(bits: int):
    while bits:
        i = _lowest(bits)
        yield i
        bits &= bits - 1


LOCAL = "key binary, parent binary, depth int, n long, first {id}, n_words int, ends array<{id}>"
_NAMES = ["key", "parent", "depth", "n", "first", "n_words", "ends"]


def _rows(rows: list[tuple], kind) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), kind, pa.int32(), pa.list_(kind)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)


def _walk_shards(batches):
    """Entities come in order of id, their actions in order; an entity with more actions than a shard may
    hold is a shard of its own and goes by as a chain."""
    shard, chain, kind, rows = _Shard(), None, None, []
    for batch in batches:
        kind = batch.schema.field(0).type
        for entity, mark, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if chain:
                if entity == chain[0]:
                    row, chain = _step(chain, mark, n)
                    rows.append(row)
                else:
                    rows.append(_chain_end(chain))
                    chain = None
            if not chain:
                new = not shard.ids or shard.ids[-1] != entity
                if new and (len(shard.ids) >= SHARD or shard.n >= SHARD_ACTIONS):
                    rows += shard.walk()
                    shard = _Shard()
                if new:
                    shard.add(entity)
                if mark is not None:
                    shard.actions[-1].append((mark, n))
                    shard.n += 1
                    if len(shard.actions[-1]) > SHARD_ACTIONS:
                        own, before = shard.actions.pop(), shard
                        shard.ids.pop()
                        rows += before.walk()
                        shard = _Shard()
                        chain = (entity, ROOT, None, 0, 0)
                        for action in own:
                            row, chain = _step(chain, *action)
                            rows.append(row)
            for at in range(0, len(rows) - OUT + 1, OUT):
                yield _rows(rows[at : at + OUT], kind)
            if len(rows) >= OUT:
                rows = rows[len(rows) // OUT * OUT :]
    if chain:
        rows.append(_chain_end(chain))
    rows += shard.walk()
    for at in range(0, len(rows), OUT):
        yield _rows(rows[at : at + OUT], kind)


def _step(chain: tuple, mark: bytes, n: int) -> tuple[tuple, tuple]:
    """The chain's node so far as a row, and the chain one action further."""
    entity, key, parent, depth, n_words = chain
    return (key, parent, depth, 1, entity, n_words, []), (entity, _key(key, mark), key, depth + 1, n)


def _chain_end(chain: tuple) -> tuple:
    entity, key, parent, depth, n_words = chain
    return key, parent, depth, 1, entity, n_words, [entity]


def shard_nodes(actions: DataFrame, order_cols: tuple[str, ...], entities: DataFrame | None = None) -> DataFrame:
    """Nodes of every shard, stored: ``key, parent, depth, n, first, n_words, ends``.

    ``actions`` is what ``marked`` gives; ``entities`` names further ``entity_id`` that may have no action.
    Rows of one entity with the same order are taken in order of their digest. Null ids are no entity.
    """
    kind = actions.schema["entity_id"].dataType.simpleString()
    order = [f"_{i}" for i in range(len(order_cols))]
    d = actions.select("entity_id", "mark", "n_words", *[F.col(c).alias(o) for c, o in zip(order_cols, order)])
    if entities is not None:
        none = [F.lit(None).cast(d.schema[c].dataType).alias(c) for c in ("mark", "n_words", *order)]
        d = d.unionByName(entities.select("entity_id", *none))
    d = d.filter("entity_id is not null")
    d = d.repartitionByRange("entity_id").sortWithinPartitions("entity_id", *[F.col(o).asc_nulls_first() for o in order], "mark")
    return stored(d.select("entity_id", "mark", "n_words").mapInArrow(_walk_shards, LOCAL.format(id=kind)))


def action_trie(local: DataFrame) -> DataFrame:
    """The trie of all shards: ``key, depth, entity_id, parent_entity_id, n_entities, n_children, n_leaves,
    saved_words``.

    ``entity_id`` is the smallest member; with ``depth`` it names the node. ``n_leaves`` are nodes without
    children in the subtree, the node itself included; ``saved_words`` adds up, over the subtree, the words
    of each node's last action as often as entities beyond the first have it: what is not sent twice when
    shared prefixes are read once. The root has depth 0 and no parent. Without entities there is no node.
    """
    nodes = local.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("first").alias("first"), F.first("n_words").alias("n_words"), F.sum(F.size("ends")).alias("n_ends")
    )
    nodes = stored(nodes)
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    shared = nodes.filter("n > 1").join(children, "key", "left")
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single"))
    shared = stored(shared.select("key", "first", "n_children", F.col("parent").alias("up"), leaves.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("n_words")).alias("saved")))
    sums = subtree_sums(shared.select("key", "up", "leaves", "saved"))
    sums = sums.join(shared.select("key", "n_children", "first"), "key")
    # a chain's nodes have the chain's own entity above them; only what hangs on a shared node asks for its parent
    parents = sums.select(F.col("key").alias("parent"), F.col("first").alias("parent_entity_id"))
    chains = nodes.filter("n = 1").join(parents, "parent", "left")
    above = F.when(F.col("depth") > 0, F.coalesce("parent_entity_id", "first"))
    zero = F.lit(0).cast("long")
    names = ["key", "depth", "entity_id", "parent_entity_id", "n_entities", "n_children", "n_leaves", "saved_words"]
    chains = chains.select("key", F.col("depth").cast("long"), "first", above, "n", 1 - F.col("n_ends"), zero + 1, zero).toDF(*names)
    rest = nodes.filter("n > 1").join(sums.drop("first"), "key").join(parents, "parent", "left")
    rest = rest.select("key", F.col("depth").cast("long"), "first", "parent_entity_id", "n", F.coalesce("n_children", zero), "leaves", "saved").toDF(*names)
    return chains.unionByName(rest)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``key, leaves, saved`` summed over each node's subtree; ``up`` is the parent's key.

    After round k a node has the sums of descendants less than 2^k below it and a pointer to its ancestor
    2^k above; the next round adds what those at exactly that distance have.
    """
    while not nodes.filter("up is not null").isEmpty():
        below = nodes.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        further = nodes.select(F.col("key").alias("up"), F.col("up").alias("further"))
        step = nodes.join(further, "up", "left").join(below, "key", "left")
        add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
        nodes = stored(step.select("key", F.col("further").alias("up"), add("leaves", "more").alias("leaves"), add("saved", "more_saved").alias("saved")))
    return nodes.drop("up")


def end_lists(local: DataFrame) -> DataFrame:
    """``key, first, ends``: the entities that end at a node, in ascending parts, one per shard."""
    return local.filter("size(ends) > 0").select("key", F.element_at("ends", 1).alias("first"), "ends")


def _digests(batches):
    key, state, done = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
        done = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(local: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas; nodes where
    none ends are left out. A node's parts pass through one task one after the other, which holds one part;
    nodes whose ends are all in one shard are digested without a shuffle."""
    parts = end_lists(local)
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    several = stored(several)
    text = F.concat_ws(",", F.transform("ends", lambda x: x.cast("string")))
    alone = parts.join(several, "key", "left_anti").select("key", F.sha2(text, 256).alias("ends_sha256"))
    many = parts.join(several, "key", "left_semi").repartition("key").sortWithinPartitions("key", "first").select("key", "ends")
    return alone.unionByName(many.mapInArrow(_digests, "key binary, ends_sha256 string"))
