"""N-gram Jaccard self-join by a token-group matrix.

Documents with one shingle set form a class. Classes are put into groups of similar classes (a leader and what links
with it); a group stores the union of its members' tokens. A class asks only groups with which it shares one of its rarest
tokens, of as many as a link needs, and a group is opened only if the class's overlap with the union reaches what the
threshold needs of any member.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, given_back, mix, pieces, prepare, sent, stored
from tideline.llm.components import components

#: Members of a group at most, and classes that ask it in one task at most.
GROUP, ASKING = 256, 1024
#: Parts into which the askers of one group are dealt before they learn how many chunks the group has.
SALTS = 32
#: Numbers that are laid out at once when a set's minima are taken.
CELLS = 1 << 18


@dataclass(frozen=True)
class Likeness:
    """Shingles of `words` words; sets link when den * intersection >= num * union.

    Classes that share none of their hints (see hints) are left out before blocks are cut; two linked sets at the threshold
    share none with a probability of `miss` or less. With exact=True nothing is left out: blocks meet for every link.
    """

    words: int = 3
    num: int = 90
    den: int = 100
    exact: bool = False
    miss: float = 1e-9

    def differing(self, sizes: int) -> int:
        """The most elements in which two linked sets with `sizes` elements together can differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def link(self, a: int, b: int, shared: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


@dataclass(frozen=True)
class Blocks:
    """How sets of one size band are cut: hash values into `parts` equal ranges, `differing` of which may hold other elements."""

    tag: int
    parts: int
    differing: int


@lru_cache(maxsize=16)
def minima(like: Likeness) -> tuple[int, int]:
    """Rows and bands of the hints: sets of similarity s agree in a band with s ** rows, in none with
    (1 - s ** rows) ** bands, which is `miss` or less from the threshold on."""
    share = like.num / like.den
    rows = max(1, round(math.log(0.52) / math.log(share)))
    return rows, math.ceil(math.log(like.miss) / math.log1p(-(share**rows)))


@lru_cache(maxsize=16)
def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of odd multipliers, a pair for each minimum."""
    drawn = np.random.default_rng(20).integers(0, 2**32, (2, count, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return drawn[0], drawn[1]


def hints(tokens: np.ndarray, like: Likeness) -> np.ndarray:
    """A name for each band of minima of a set: the smallest value under each of several hash functions, `rows` to a band."""
    if not len(tokens) or like.exact or like.num >= like.den:
        return np.zeros(0, np.uint64)
    rows, bands_ = minima(like)
    first, second = seeds(rows * bands_)
    plain = (tokens >> np.uint64(32)).astype(np.uint32)
    step = max(1, CELLS // len(plain))
    least = np.empty(rows * bands_, np.uint32)
    for i in range(0, len(least), step):
        h = plain * first[i : i + step]
        h ^= h >> np.uint32(15)
        h *= second[i : i + step]
        least[i : i + step] = h.min(axis=1)
    each = mix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32)))
    return mix(each.reshape(bands_, rows).sum(axis=1, dtype=np.uint64))


@lru_cache(maxsize=16)
def bands(like: Likeness) -> tuple[np.ndarray, tuple[Blocks | None, ...]]:
    """Size bands, each so wide that linked sets lie in one band or in neighbours, and for each band how its sets and those
    of the band below are cut.

    Linked sets of a band differ in at most D elements, so of D + 1 + m ranges of hash values at least 1 + m hold the
    same elements in both; m is what may be empty.
    """
    tops, plans, low, below = [], [], 1, 1
    while low <= 1 << 36:
        top = max(low, low * like.den // like.num)
        d = like.differing(2 * top)
        parts = d + 1
        for _ in range(20):
            empty = parts * math.exp(-below / parts)
            parts = d + 2 + math.ceil(empty + 4 * math.sqrt(empty))
        plans.append(Blocks(len(plans), parts, d) if d else None)
        tops.append(top)
        below, low = low, top + 1
    return np.array(tops), tuple(plans)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, words in lower-case ASCII; a shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(mix(h))


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, which stands for its class."""
    return int(mix(np.array([mix(tokens ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def ranges(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The equal range of hash values in which each element lies, and where the ranges that hold some begin."""
    part = np.minimum((tokens.astype(np.float64) * (parts / 2.0**64)).astype(np.int64), parts - 1)
    return part, np.flatnonzero(np.diff(part, prepend=-1))


def cut(tokens: np.ndarray, like: Likeness) -> list[tuple[int, np.ndarray]]:
    """A set's blocks in each of its plans, with the plan's spare: names of ranges of hash values with their elements.

    A set is cut by the plan of its own size band and by that of the band above, so linked sets have a plan in common.
    Elements that differ touch at most `differing` ranges, so all but so many of a set's blocks are shared by any set that
    links with it: of its differing + 1 rarest blocks one is shared, and the rarest shared one is among those of both sets.
    A block that no other class has takes one of these places; spare = differing + 1 - blocks, so a set has to show
    spare + (its blocks that other classes have too) of these. Where so few ranges hold elements that all may differ, one
    block for all such sets is added.
    """
    n, out = len(tokens), []
    if not n or like.num >= like.den:
        return out
    tops, plans = bands(like)
    own, mixed = int(np.searchsorted(tops, n)), mix(tokens)
    for plan in filter(None, plans[own : own + 2]):
        part, starts = ranges(tokens, plan.parts)
        name = np.uint64((plan.tag + 1) * 0xD6E8FEB86659FD93 % 2**64)
        names = mix(np.add.reduceat(mixed, starts) + mix(part[starts].astype(np.uint64) + name))
        spare = plan.differing + 1 - len(starts)
        out.append((spare, names if spare <= 0 else np.append(names, mix(np.array([name])))))
    return out


def row_key() -> Column:
    """A number that stands for a row's id and text, while rows may lack an id or share one."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def sketches(docs: DataFrame, like: Likeness, named: Callable[[np.ndarray, Likeness], np.ndarray] = hints) -> DataFrame:
    """doc_id, key, n_shingles, node and hints (what `named` makes of a set) of every row; a text without words has no node."""
    prepare(docs.sparkSession)

    def each(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                n, node, names = [], [], []
                for value in piece.column("text"):
                    tokens = shingles(value.as_py() or "", like.words)
                    n.append(len(tokens))
                    node.append(node_of(tokens) if len(tokens) else None)
                    names.append(named(tokens, like).view(np.int64))
                ends = np.cumsum([0, *map(len, names)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(names)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), lists], ["doc_id", "key", "n_shingles", "node", "hints"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text")).mapInArrow(given_back(each), "doc_id long, key long, n_shingles long, node long, hints array<long>")


def token_sets(docs: DataFrame, owners: DataFrame, like: Likeness) -> DataFrame:
    """node, tokens (sorted 64-bit hashes) and plans (see cut) of the classes in owners (node, key of one of its documents).

    Of equal rows each task takes one, so a class may come several times, but not as often as it has documents.
    """
    want = sent(owners.select(F.col("key").alias("_id"), F.col("node").alias("_node")), 16)
    ids = docs.select(row_key().alias("_key"), F.col("text"))
    rows = ids.join(want, F.col("_key") == F.col("_id")).select("_node", "text")
    plan = pa.list_(pa.struct([("spare", pa.int32()), ("names", pa.list_(pa.int64()))]))

    def each(batches):
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                node, sets, plans = [], [], []
                for name, value in zip(piece.column("_node").to_pylist(), piece.column("text"), strict=True):
                    if name in seen:
                        continue
                    tokens = shingles(value.as_py() or "", like.words)
                    if len(tokens) and node_of(tokens) == name:  # a key that several texts have
                        seen.add(name)
                        node.append(name)
                        sets.append(tokens.tobytes())
                        plans.append([{"spare": spare, "names": names.view(np.int64)} for spare, names in cut(tokens, like)])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary()), pa.array(plans, plan)], ["node", "tokens", "plans"])

    return rows.mapInArrow(given_back(each), "node long, tokens binary, plans array<struct<spare int, names array<long>>>")


def rarest_blocks(sets: DataFrame) -> DataFrame:
    """node and block: of each class and plan as many of its rarest blocks as a link needs (see cut). Blocks that one class
    alone has leave before anything is sorted, and so does every class that has enough of these to link with none."""
    posted = sets.select("node", F.posexplode("plans").alias("plan", "p")).select("node", "plan", F.col("p.spare").alias("spare"), F.explode("p.names").alias("block"))
    known = posted.groupBy("block").agg(F.count("*").alias("c")).filter("c > 1")
    held = posted.join(known, "block").groupBy("node", "plan", "spare").agg(F.array_sort(F.collect_list(F.struct("c", "block"))).alias("held"))
    show = F.col("spare") + F.size("held")
    return held.filter(show > 0).select("node", F.explode(F.slice("held", F.lit(1), show)).alias("x")).select("node", F.col("x.block").alias("block"))


def rarest_tokens(sets: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """node and block: of each class in nodes as many of its rarest tokens as a link needs, least frequent first.

    A link shares at least num / den of a set's n tokens, so all but n - ceil(n * num / den) of them: of so many and one more
    of the set's rarest tokens one is shared, and the rarest shared one is among those of both sets. Tokens that one class
    alone has take places, but leave before anything is sorted; a class that fills all places with them links with none.
    """
    wanted = sets.join(nodes, "node", "left_semi").select("node", "tokens")

    def each(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column("tokens").to_pylist()]
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            places = [len(t) - -(-len(t) * like.num // like.den) + 1 for t in held]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*held, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(t) for t in held], pa.int64()), pa.array(places, pa.int64()), lists], ["node", "n", "places", "tokens"])

    rows = wanted.mapInArrow(given_back(each), "node long, n long, places long, tokens array<long>").select("node", "n", "places", F.explode("tokens").alias("token"))
    known = rows.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("c")).filter("least <> most").select("token", "c")
    held = rows.join(known, "token").groupBy("node", "n", "places").agg(F.array_sort(F.collect_set(F.struct("c", "token"))).alias("held"))
    show = F.col("places") - (F.col("n") - F.size("held"))
    return held.filter(show > 0).select("node", F.explode(F.slice("held", F.lit(1), show.cast("int"))).alias("x")).select("node", F.col("x.token").alias("block"))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class TokenGroup:
    """One row of the matrix: the members of a group, the union of their tokens, and which member has which token of it."""

    #: Cells of the member-by-token table up to which it is laid out; beyond, members are compared one by one.
    MOST_CELLS = 1 << 26

    def __init__(self, like: Likeness) -> None:
        self.like, self.nodes, self.sets = like, [], []
        self.union: np.ndarray | None = None
        self.parent: dict[int, int] = {}

    def add(self, node: int, tokens: np.ndarray, comp: int) -> None:
        self.nodes.append(node)
        self.sets.append(tokens)
        self.parent[node] = comp
        self.parent.setdefault(comp, comp)

    def _close(self) -> None:
        self.sizes = np.array([len(t) for t in self.sets])
        self.union = self.sets[0] if len(self.sets) == 1 else np.unique(np.concatenate(self.sets))
        self.table = None
        if len(self.sets) > 1 and len(self.sets) * len(self.union) <= self.MOST_CELLS:
            self.table = np.zeros((len(self.sets), len(self.union)), bool)
            for row, t in zip(self.table, self.sets, strict=True):
                row[np.searchsorted(self.union, t)] = True

    def _root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def ask(self, node: int, tokens: np.ndarray, comp: int) -> list[tuple[int, int]]:
        """Links of the class with members, but none that joins what the links given before join already."""
        if self.union is None:
            self._close()
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if self.like.den * len(at) < self.like.num * len(tokens):
            return []  # no member can have enough of its tokens: the group stays closed
        self.parent.setdefault(node, comp)
        if len(self.sets) == 1:
            both = np.array([len(at)])
        elif self.table is not None:
            both = self.table[:, at].sum(axis=1)
        else:
            both = np.array([shared(tokens, t) for t in self.sets])
        out = []
        for i in np.flatnonzero(self.like.den * both >= self.like.num * (len(tokens) + self.sizes - both)):
            a, b = self._root(node), self._root(self.nodes[i])
            if a != b and node != self.nodes[i]:
                self.parent[max(a, b)] = min(a, b)
                out.append((node, self.nodes[i]))
        return out


def open_groups(members: DataFrame, asking: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links a, b between those who ask and members of the groups they ask.

    members, asking: gid, node and comp (the component that is known so far); a group has about GROUP members. Those who
    ask a group are dealt into chunks of about ASKING, each a task's work beside the group's members.
    """
    count = asking.groupBy("gid").agg(F.count("*").alias("_n")).select("gid", F.ceil(F.col("_n") / ASKING).cast("int").alias("_chunks"))
    salted = count.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asks = asking.withColumn("_salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["gid", "_salt"])
    asks = asks.select("gid", F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "node", "comp")
    held = members.join(count, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "node", "comp")
    rows = held.unionByName(asks).join(sets.select("node", "tokens"), "node").repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", "role", "node")

    def each(batches):
        now, group = None, TokenGroup(like)
        for batch in batches:
            links = []
            for gid, chunk, role, node, comp, held in zip(*(batch.column(c).to_pylist() for c in ("gid", "chunk", "role", "node", "comp", "tokens")), strict=True):
                if (gid, chunk) != now:
                    now, group = (gid, chunk), TokenGroup(like)
                tokens = np.frombuffer(held, np.uint64)
                if role == 0:
                    group.add(node, tokens, comp)
                elif group.nodes:
                    links += group.ask(node, tokens, comp)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    return rows.select("gid", "chunk", "role", "node", "comp", "tokens").mapInArrow(given_back(each), "a long, b long")


def link_components(docs: DataFrame, like: Likeness = Likeness()) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows (stored), and component_id of each node (stored).

    Classes that share a hint with another are cut into blocks, and show their rarest ones; what shows one block meets in settled().
    """
    rows = stored(sketches(docs, like), "near-rows")
    classes = rows.filter("node IS NOT NULL")
    owners = owners_of(classes)
    if not like.exact:
        posted = classes.select("node", F.explode("hints").alias("hint"))
        met = posted.groupBy("hint").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("hint")
        owners = owners.join(posted.join(met, "hint").select("node").distinct(), "node")
    owners = stored(owners, "near-owners")
    sets = stored(token_sets(docs, owners, like), "near-sets")
    posted = stored(rarest_blocks(sets), "near-posted")
    several = stored(meeting(posted), "near-blocks")
    discard(posted, owners)
    return rows, settled(classes, sets, several, like)


def meeting(posted: DataFrame) -> DataFrame:
    """block, node and lead of the blocks that several nodes have: each names its smallest node as leader."""
    lists = posted.groupBy("block").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last").select("block", "lead")
    return posted.join(lists, "block")


def settled(classes: DataFrame, sets: DataFrame, several: DataFrame, like: Likeness) -> DataFrame:
    """component_id of each node (stored). sets and several (see meeting) go.

    1. Every class of a block asks the block's leader. Links give first components.
    2. Where a block holds several components, its classes take part in the second step: they show their rarest tokens, and
       only components that share one of these can still be joined. What thousands of texts have in common, however much of
       each it is, is in nobody's rarest tokens but for those that hold little else, which link.
    3. Groups of about GROUP classes are cut from each component, and from the single classes that asked the same leader.
       Of components that share a rare token each asks the groups of the larger ones, and single classes ask the groups
       of single classes, each pair of groups in one direction.
    No pair within a component is looked at again, and copies were merged before, so neither large groups of copies nor
    large groups of near copies are expanded into pairs.
    """
    stars = stored(several.filter("node <> lead").select("node", "lead").distinct(), "near-stars")
    leaders = stars.select(F.col("lead").alias("gid"), F.col("lead").alias("node"), F.col("lead").alias("comp")).distinct()
    first = stored(open_groups(leaders, stars.select(F.col("lead").alias("gid"), "node", F.col("node").alias("comp")), sets, like), "near-links")
    comps = components(first)
    sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
    comps = stored(comps.join(sizes, "comp").select("node", "comp", "n"), "near-comps")

    placed = several.join(comps, "node", "left").select("block", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("n", F.lit(1)).alias("n"))
    # of two single classes one is the block's leader, which the other has asked
    of_block = placed.select("block", "comp", "n").distinct().groupBy("block").agg(F.count("*").alias("_c"), F.max("n").alias("_m")).filter("_c > 2 OR (_c = 2 AND _m > 1)")
    late = stored(placed.join(of_block.select("block"), "block").select("node").distinct(), "near-late")
    rare = stored(rarest_tokens(sets, late, like), "near-rare")
    named = rare.join(comps, "node", "left").select("block", F.coalesce("comp", "node").alias("comp"), F.coalesce("n", F.lit(1)).alias("n")).distinct()
    open_ = named.groupBy("block").agg(F.count("*").alias("_c")).filter("_c > 1").select("block")
    mixed = stored(named.join(open_, "block"), "near-mixed")
    asked_first = stars.groupBy("node").agg(F.min("lead").alias("home"))
    single = mixed.filter("n = 1").select(F.col("comp").alias("node")).distinct().join(asked_first, "node", "left").withColumn("home", F.coalesce("home", "node"))
    homes = single.groupBy("home").agg(F.ceil(F.count("*") / (GROUP * 0.75)).alias("_cuts"))
    single = stored(single.join(homes, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("_cuts"))).alias("gid")), "near-single")
    entries = mixed.join(single.withColumnRenamed("node", "comp"), "comp", "left")  # gid: null for a component of several
    entries = stored(entries.select("block", "comp", "n", "gid"), "near-entries")
    discard(several, stars, late, rare, mixed)
    goals = entries.select("block", F.coalesce("gid", "comp").alias("goal"), F.col("n").alias("goal_n")).distinct()
    upward = F.when(F.col("goal_n") == 1, (F.col("n") == 1) & (F.col("gid") <= F.col("goal"))).otherwise((F.col("n") < F.col("goal_n")) | ((F.col("n") == F.col("goal_n")) & (F.col("comp") < F.col("goal"))))
    pairs = stored(entries.join(goals, "block").filter(upward).select("comp", "goal", (F.col("goal_n") > 1).alias("whole")).distinct(), "near-pairs")
    wanted = pairs.filter("whole").select(F.col("goal").alias("comp")).distinct()
    cuts = comps.join(wanted, "comp", "left_semi").select("comp", "node", F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (GROUP * 0.75)))).alias("gid"))
    groups = stored(cuts.unionByName(single.select(F.col("node").alias("comp"), "node", "gid")), "near-groups")
    of_comps = groups.join(wanted, "comp", "left_semi").select(F.col("comp").alias("goal"), "gid").distinct()
    to_groups = pairs.filter("whole").join(of_comps, "goal").select("comp", "gid").unionByName(pairs.filter("NOT whole").select("comp", F.col("goal").alias("gid")))
    asks = to_groups.join(comps.select("comp", "node"), "comp", "left").select("gid", F.coalesce("node", "comp").alias("node"), "comp").distinct()
    second = open_groups(groups.select("gid", "node", "comp"), asks, sets, like)
    final = components(first.unionByName(second))
    named = owners_of(classes).join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = stored(named.select("node", "comp").join(least, "comp").select(F.col("node").alias("_node"), "component_id"), "near-found")
    discard(sets, first, comps, single, entries, pairs, groups, final)
    return found


def owners_of(classes: DataFrame) -> DataFrame:
    """node, its smallest doc_id and the key of one of its rows."""
    return classes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))


def rows_with_components(docs: DataFrame, like: Likeness, linked_by: Callable[[DataFrame, Likeness], tuple[DataFrame, DataFrame]] = link_components) -> DataFrame:
    rows, found = linked_by(docs, like)
    linked = rows.filter("node IS NOT NULL").join(found, F.col("node") == F.col("_node"), "left").select("doc_id", "n_shingles", "component_id")
    out = stored(linked.unionByName(rows.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))), "near-documents")
    discard(rows, found)
    return out


def join_table(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of docs (doc_id, text).

    Defined cases: a text without words, or null, has no shingles and is its own component; documents with equal sets are
    linked; a row without doc_id links as any other, and a component of such rows alone has no component_id; rows that repeat a doc_id with other texts are documents of their own; an empty table gives an empty
    result; other columns are left out.
    """
    return rows_with_components(docs, like)


def keep_one(docs: DataFrame, like: Likeness = Likeness(5, 80, 100)) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id (null ids last), then by its key, which
    doc_id and whole text decide.

    Defined cases: rows without words, null texts too, cannot be linked and all stay, repeated ones too; of rows that are
    equal in id and text one stays; rows that share an id but not a text are documents of their own, and so are rows without
    an id; an empty table gives an empty result; columns may have any names.
    """
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id")
    key = F.xxhash64(doc_id.isNull(), doc_id, F.sha2(text, 256))
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"), doc_id.cast("long").alias("id"), text.alias("text"))
    found = rows_with_components(keyed.select(F.col("key").alias("doc_id"), "text"), like)
    ids = keyed.groupBy("key").agg(F.min("id").alias("id"))
    linked = found.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))
    best = linked.join(ids, linked["doc_id"] == ids["key"]).groupBy("component_id").agg(F.min_by(F.struct("key", "n"), order).alias("b"))
    best = stored(best.select(F.col("b.key").alias("kept"), F.col("b.n").alias("n")), "near-kept")
    once = best.filter("n = 1").select("kept")
    gone = stored(linked.join(once, F.col("doc_id") == F.col("kept"), "left_anti").select(F.col("doc_id").alias("gone")), "near-gone")
    several = stored(best.filter("n > 1").select("kept"), "near-several")
    discard(found, best)
    out = keyed.join(sent(gone, 8), F.col("key") == F.col("gone"), "left_anti").select("row")
    again = keyed.join(sent(several, 8), F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select("row")
    return out.unionByName(again).select("row.*")
