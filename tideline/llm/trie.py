"""Prefix tries of conversations: one node for each distinct sequence of first turns.

Equal conversations form a class, and only one of each class goes into the tries, with the class's weight. Classes are dealt by
the digest of their first turn; what shares a first turn is a subtrie. Subtries of up to LIMIT turns are built in tasks, as
dictionaries of children, many to a task. A larger one gives its topmost node as a row and is dealt again by the next turn,
and so on; what lies under such topmost nodes is summed from the deepest up.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import discard, n_words, prepare, sent, stored

#: Turns of a subtrie up to which one task builds it, and about so many turns of small subtries go to one task.
LIMIT = 8192
#: What no conversation ends at has the digest of the empty string.
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations that share the first turns of one of them, and the most turns that they share, as rebuilt() has it.
SHARING, MOST_SHARED = 20, 3

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (digest of role and text) and words of each turn; texts don't move.

    Turns are ordered by turn, null first, and turns of one number by their digests. A null role or text is empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), n_words(text).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id and n_turns of each conversation, and its turns, after its first turns gave way to those of another.

    Conversation c takes the first h turns of conversation c - c % SHARING (all if it has fewer, none if it is absent), then its
    own after its first h; h is the CRC-32 of c in decimal, modulo MOST_SHARED + 1.
    """
    heads = turns.filter(F.col("pos") <= MOST_SHARED).select(F.col("conv_id").alias("_of"), F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("words").alias("_words"))
    lent = heads.groupBy("_of").agg(F.count("*").alias("_n"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_own")).select(
        "conv_id", "_own", (F.col("conv_id") - F.col("conv_id") % SHARING).alias("_base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("_h")
    )
    convs = convs.join(lent, F.col("_base") == F.col("_of"), "left").select("conv_id", "_own", "_base", "_h", F.least("_h", F.coalesce("_n", F.lit(0))).alias("_lent"))
    first = convs.join(heads, (F.col("_base") == F.col("_of")) & (F.col("_pos") <= F.col("_h"))).select("conv_id", F.col("_pos").alias("pos"), F.col("_key").alias("key"), F.col("_words").alias("words"))
    rest = turns.join(convs.select(F.col("conv_id").alias("_conv"), "_h", "_lent"), F.col("conv_id") == F.col("_conv")).filter(F.col("pos") > F.col("_h"))
    rest = rest.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_lent")).alias("pos"), "key", "words")
    n_turns = F.col("_lent") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))
    return convs.select("conv_id", n_turns.alias("n_turns")), first.unionByName(rest)


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Equal conversations: cls (the smallest conv_id of them), n_turns, n (how many) and ends_sha256 (of their conv_ids).

    A conversation is known by two 64-bit sums of its turns' hashes, whose parts are summed before they move. Each class passes
    one task in the order of conv_id, as a chained digest asks for, but only as a stream of ids: nothing of it is held.
    """
    prepare(convs.sparkSession)
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key"))
    marks = turns.groupBy(F.col("conv_id").alias("_conv")).agg(mark(1).alias("a"), mark(2).alias("b"))
    known = convs.join(marks, F.col("conv_id") == F.col("_conv"), "left").select("n_turns", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"), "conv_id")
    rows = known.repartition("n_turns", "a", "b").sortWithinPartitions("n_turns", "a", "b", "conv_id")

    def each(batches):
        now, least, n, digest = None, None, 0, None
        for batch in batches:
            done = []
            for n_turns, a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("n_turns", "a", "b", "conv_id")), strict=True):
                if (n_turns, a, b) == now:
                    n += 1
                    digest.update(b",%d" % conv)
                else:
                    if now is not None:
                        done.append((least, now[0], n, digest.hexdigest()))
                    now, least, n, digest = (n_turns, a, b), conv, 1, hashlib.sha256(b"%d" % conv)
            yield _batch(done)
        if now is not None:
            yield _batch([(least, now[0], n, digest.hexdigest())])

    def _batch(done):
        columns = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["cls", "n_turns", "n", "ends"])

    return rows.mapInArrow(each, "cls long, n_turns long, n long, ends string")


class Trie:
    """Nodes as parallel lists and dictionaries of children; the nodes of several subtries, each under a name."""

    def __init__(self) -> None:
        self.tops: dict[bytes, int] = {}
        self.children: list[dict[bytes, int]] = []
        self.parent, self.depth, self.least, self.n, self.words, self.ends = [], [], [], [], [], []

    def step(self, at: int | None, name: bytes, key: bytes, depth: int, cls: int, n: int, words: int) -> int:
        """The node of a turn under node `at`, or the topmost node of a subtrie; counts the class in."""
        held, what = (self.tops, name) if at is None else (self.children[at], key)
        if (node := held.get(what)) is None:
            node = held[what] = len(self.n)
            self.children.append({})
            for column, x in zip((self.parent, self.depth, self.least, self.n, self.words, self.ends), (at, depth, cls, 0, words, None), strict=True):
                column.append(x)
        self.n[node] += n
        self.least[node] = min(self.least[node], cls)
        return node

    def sums(self) -> tuple[list[int], list[int]]:
        """Childless nodes and saved tokens of each node's subtree, children before parents, without recursion."""
        leaves, saved = [0] * len(self.n), [0] * len(self.n)
        for top in self.tops.values():
            ahead, order = [top], []
            while ahead:
                order.append(node := ahead.pop())
                ahead.extend(self.children[node].values())
            while order:
                node = order.pop()
                below = self.children[node].values()
                leaves[node] = sum(leaves[x] for x in below) or 1
                saved[node] = (self.n[node] - 1) * self.words[node] + sum(saved[x] for x in below)
        return leaves, saved


def grown(rows: DataFrame, tasks: int) -> DataFrame:
    """The nodes of the subtries in rows (gid: the subtrie, up_gid and up: the node above, cls, n, pos, key, words, ends), many
    subtries to a task; topmost nodes carry up_gid."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cls", "pos"])
        trie, now, at, ups = Trie(), None, None, {}
        for gid, up_gid, up, cls, n, pos, key, words, ends in zip(*(pdf[c].tolist() for c in ("gid", "up_gid", "up", "cls", "n", "pos", "key", "words", "ends")), strict=True):
            if cls != now:
                now, at = cls, None
                ups[gid] = (up_gid, up)
            at = trie.step(at, gid, key, pos, cls, n, words)
            if ends is not None:
                trie.ends[at] = ends
        leaves, saved = trie.sums()
        up_gids, ups_of = [None] * len(leaves), [None if p is None else trie.least[p] for p in trie.parent]
        for gid, node in trie.tops.items():
            up_gids[node], ups_of[node] = ups[gid]
        return pd.DataFrame({
            "conv_id": trie.least, "depth": trie.depth, "parent_conv_id": pd.array(ups_of, "Int64"), "n_convs": trie.n, "n_children": [len(c) for c in trie.children],
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or NO_ENDS for e in trie.ends], "up_gid": up_gids,
        })

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(tasks)))
    return dealt.groupBy("bucket").applyInPandas(build, NODE + ", up_gid binary")


def chains(rows: DataFrame) -> DataFrame:
    """The nodes of large subtries that hold one class: a chain, whose sums are those of the turns from here on."""
    rest = Window.partitionBy("cls").orderBy(F.col("pos").desc())
    top = F.col("pos") == F.col("depth")
    return rows.select(
        F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), F.when(top, F.col("up")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("ends").isNull(), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.sum("words").over(rest)).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), F.when(top, F.col("up_gid")).alias("up_gid"),
    )


def node_table(convs: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row for each node of the trie of all conversations; see NODE for the columns.

    convs: conv_id and n_turns, a row for each conversation; turns: conv_id, pos from 1, key and words (a table that
    is read several times). conv_id: smallest member; parent_conv_id: that of the parent; n_leaves: childless nodes at or under
    the node; saved_tokens: (members - 1) times words of the last turn, over the node and all under it; ends_sha256: SHA-256 of
    the conv_ids that end here, in decimal and order, joined by commas.

    Defined cases: a conversation without turns is a member of the root alone; equal conversations share all nodes; without
    any conversation there is no root and no row. The rounds are as many as the turns that more than `limit` turns of different
    conversations share. Of one class alone a chain of any length is one round.
    """
    equal = stored(classes(convs, turns), "trie-classes")
    total = equal.agg(F.min("cls").alias("cls"), F.sum("n").alias("n"), F.max(F.when(F.col("n_turns") == 0, F.col("ends"))).alias("ends")).first()
    spark = convs.sparkSession
    root = spark.createDataFrame([(bytearray(), None, total["cls"], None, total["n"], 0, total["ends"])] if total["n"] else [], "gid binary, up_gid binary, conv_id long, up long, n_convs long, words long, ends string")
    last = equal.select("cls", "n", "n_turns", "ends")
    rows = turns.join(last, F.col("conv_id") == F.col("cls")).select("cls", "n", "pos", "key", "words", F.when(F.col("pos") == F.col("n_turns"), F.col("ends")).alias("ends"))
    rows = rows.withColumns({"gid": F.lit(b""), "up": F.lit(total["cls"])})
    spines, nodes, depth, used = [root], [], 1, [equal]
    while True:
        # the name of a child is the digest of its parent's name and its own turn
        child = rows.filter(F.col("pos") == depth).select(F.col("cls").alias("_cls"), F.unhex(F.md5(F.concat("gid", "key"))).alias("_gid"))
        now = rows.filter(F.col("pos") >= depth).join(child, F.col("cls") == F.col("_cls"))
        now = stored(now.select("cls", "n", "pos", "key", "words", "ends", F.col("gid").alias("up_gid"), "up", F.col("_gid").alias("gid")), "trie-rows")
        here = F.col("pos") == depth
        sizes = now.groupBy("gid").agg(
            F.count("*").alias("turns"), F.count_if(here).alias("classes"), F.sum(F.when(here, F.col("n"))).alias("n_convs"), F.min("cls").alias("conv_id"), F.max(F.when(here, F.col("words"))).alias("words"),
            F.max(F.when(here, F.col("ends"))).alias("ends"), F.max("up_gid").alias("up_gid"), F.max("up").alias("up"),
        )
        large = stored(sizes.filter(F.col("turns") > limit), "trie-large")
        found = large.agg(F.count("*").alias("large"), F.count_if(F.col("classes") == 1).alias("chains"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns")).first()
        names = large.select(F.col("gid").alias("_gid"), "classes", "conv_id")
        in_large = now.join(sent(names, 64), F.col("gid") == F.col("_gid")) if found["large"] else None
        small = now.join(sent(names, 64), F.col("gid") == F.col("_gid"), "left_anti") if found["large"] else now
        made = grown(small, max(1, -(-(now.count() - found["turns"]) // limit)))
        if found["chains"]:
            made = made.unionByName(chains(in_large.filter("classes = 1").withColumn("depth", F.lit(depth))))
        nodes.append(stored(made, "trie-nodes"))
        used.append(now)
        if found["large"] == found["chains"]:
            break
        spines.append(large.filter("classes > 1").select("gid", "up_gid", "conv_id", "up", "n_convs", "words", "ends"))
        rows = in_large.filter("classes > 1").select("cls", "n", "pos", "key", "words", "ends", "gid", F.col("conv_id").alias("up"))
        depth += 1

    tops, whole = None, [x.drop("up_gid") for x in nodes]
    for level in reversed(range(len(spines))):
        own = nodes[level].filter("up_gid IS NOT NULL").select("up_gid", "n_leaves", "saved_tokens")
        own = own if tops is None else own.unionByName(tops)
        sums = own.groupBy(F.col("up_gid").alias("_of")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        spine = spines[level].join(sums, F.col("gid") == F.col("_of"), "left").select(
            "conv_id", F.lit(level).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "up_gid",
        )
        spine = stored(spine, "trie-spine")
        tops = spine.select("up_gid", "n_leaves", "saved_tokens")
        whole.append(spine.drop("up_gid"))
    discard(*used)
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (conv_id, turn, role, text); see rebuilt() and node_table().

    Defined cases: null role or text is empty; null turns come first; turns of one number follow in the order of their
    digests, repeated rows are turns of their own; rows without conv_id belong to no conversation and go; other columns are left out.
    """
    turns = stored(turns_in_order(conversations), "trie-turns")
    convs, rows = rebuilt(turns)
    convs, rows = stored(convs, "trie-convs"), stored(rows, "trie-rebuilt")
    out = node_table(convs, rows, limit)
    discard(turns, convs, rows)
    return out
