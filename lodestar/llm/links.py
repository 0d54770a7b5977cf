"""Components of sets that are alike, by signature trees in three levels: leaves, nodes and sets.

The input are entries (token, owner, n): an owner is a set of n members, and two owners may be alike only if they
share a token. So that no pair is lost and no set travels with each of its tokens, the pairs are decided in turns:

1. Every owner goes to one leaf, named by the least hash among its tokens, so owners that share most tokens mostly
   meet. A leaf is joined by a dual traversal of its signature tree: a tree node holds the OR of its members' bitmaps
   and their size range, and a pair of nodes is dropped when the largest possible overlap is too small, or when both
   lie in one component already. Leaves over ``LEAF_SETS`` are split by a hash; each part gets the leaf's least owner
   as a guest, which joins the parts.
2. What a leaf joins is a node: one row with the OR of its bitmaps and its size range. Tokens that have owners in
   several leaves and nodes are still undecided. Their nodes, without any members, are traversed in the same way; of
   the pairs that survive one set each is compared, then, where nodes of several sets are still apart, all their sets.
   A pair travels once, whatever number of tokens it shares; where very many nodes of a token survive with each
   other (``DENSE`` pairs to a node), they travel as a group instead.

A link is always verified on the whole sets, and components are made of links only. Groups of nodes over
``GROUP_NODES`` are split into parts, and each pair of parts is a call of its own, so a call's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, small_side, stored
from lodestar.llm.components import connected_components

BITMAP_BITS = 2048
LEAF = 32
#: Sets and members of one part of a leaf; members that one call holds; nodes of one part of a group and of one call.
LEAF_SETS, LEAF_MEMBERS, CALL_MEMBERS = 2000, 2_000_000, 1_000_000
GROUP_NODES, CALL_NODES = 4000, 20_000
#: Pairs to a node that make a group dense; partners of one set in one call.
DENSE, PARTNERS = 16, 500

_U = np.uint64


def needed(a, b, percent: int):
    """The least overlap of sets of these sizes that reaches the similarity."""
    return -((-percent * (a + b)) // (100 + percent))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class SignatureTree:
    """A binary tree, ordered so that like entries are near; its nodes hold OR-ed bitmaps and size ranges.

    An entry is a set or a node of sets: a bitmap, the least and the largest size, and the excess, the most by which
    a set's size exceeds the bits it sets. Two sets then share at most popcount(a & b) + min(excess) members.
    """

    def __init__(self, maps: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray, key: np.ndarray, leaf: int = LEAF):
        self.maps, self.low, self.high, self.excess = maps, low, high, excess
        self.order = np.lexsort((key, low))
        self.leaf = leaf
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(low)) if len(low) else -1

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int = BITMAP_BITS, leaf: int = LEAF) -> SignatureTree:
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        dense = np.zeros((len(sets), bits), bool)
        dense[np.repeat(np.arange(len(sets)), size), (flat >> _U(20)).astype(np.int64) % bits] = True
        least = np.array([s[0] if len(s) else 0 for s in sets], _U)
        return cls(np.packbits(dense, axis=1).view(_U), size, size, size - dense.sum(axis=1), least, leaf)

    def _build(self, first: int, end: int) -> int:
        rows = self.order[first:end]
        children = ()
        if end - first > self.leaf:
            mid = (first + end) // 2
            children = (self._build(first, mid), self._build(mid, end))
        self.nodes.append((np.bitwise_or.reduce(self.maps[rows], axis=0), int(self.low[rows].min()), int(self.high[rows].max()), int(self.excess[rows].max()), children, rows))
        return len(self.nodes) - 1


def surviving_pairs(tree: SignatureTree, other: SignatureTree | None, percent: int, label: np.ndarray, place: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of entries that may be alike, within ``tree`` or between it and ``other``, by dual traversal.

    Entries of ``other`` are numbered after those of ``tree``. Pairs of one ``label`` are joined already, those of one
    ``place`` are decided; both are left out. The caller may change labels between pairs.
    """
    within = other is None
    other = tree if within else other
    shift = 0 if within else len(tree.low)
    stack = [(tree.root, other.root)] if tree.root >= 0 and other.root >= 0 else []
    while stack:
        i, j = stack.pop()
        bits_a, low_a, high_a, excess_a, down_a, rows_a = tree.nodes[i]
        bits_b, low_b, high_b, excess_b, down_b, rows_b = other.nodes[j]
        if high_a * 100 < low_b * percent or high_b * 100 < low_a * percent:
            continue
        most = int(np.bitwise_count(bits_a & bits_b).sum()) + min(excess_a, excess_b)
        if min(most, high_a, high_b) < needed(low_a, low_b, percent):
            continue
        label_a, label_b = label[rows_a], label[rows_b + shift]
        if label_a[0] == label_b[0] and (label_a == label_a[0]).all() and (label_b == label_a[0]).all():
            continue
        if down_a or down_b:
            if within and i == j:
                stack += [(down_a[0], down_a[1]), (down_a[1], down_a[1]), (down_a[0], down_a[0])]
            elif down_a and (not down_b or len(rows_a) >= len(rows_b)):
                stack += [(x, j) for x in down_a]
            else:
                stack += [(i, y) for y in down_b]
            continue
        overlap = np.bitwise_count(tree.maps[rows_a][:, None, :] & other.maps[rows_b][None, :, :]).sum(axis=2, dtype=np.int64)
        overlap += np.minimum(tree.excess[rows_a][:, None], other.excess[rows_b][None, :])
        overlap = np.minimum(overlap, np.minimum(tree.high[rows_a][:, None], other.high[rows_b][None, :]))
        may = overlap >= needed(tree.low[rows_a][:, None], other.low[rows_b][None, :], percent)
        may &= label_a[:, None] != label_b[None, :]
        if place is not None:
            may &= place[rows_a][:, None] != place[rows_b + shift][None, :]
        if within and i == j:
            may = np.triu(may, 1)
        for x, y in zip(*np.nonzero(may), strict=True):
            yield int(rows_a[x]), int(rows_b[y]) + shift


def linked_sets(sets: list[np.ndarray], split: int | None, percent: int, label: np.ndarray, place: np.ndarray | None = None, bits: int = BITMAP_BITS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links that join everything alike among ``sets``, or with ``split`` between those before it and the others.

    ``label`` has for each set what is joined already; pairs that are joined through earlier links are left out.
    """
    first = SignatureTree.of_sets(sets[:split], bits, leaf)
    other = None if split is None else SignatureTree.of_sets(sets[split:], bits, leaf)
    label, out = label.copy(), []
    for x, y in surviving_pairs(first, other, percent, label, place):
        if label[x] != label[y] and alike(sets[x], sets[y], percent):
            label[label == label[y]] = label[x]
            out.append((x, y))
    return out


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with equal values."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    starts = np.flatnonzero(new).tolist()
    yield from zip(starts, [*starts[1:], n], strict=True)


_NODES = "owner long, node long, place long, guest boolean, low int, high int, excess int, sets int, bits binary"


def _leaf_nodes(percent: int):
    """Joins each leaf; the node of every owner, and each node's own row."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["place", "guest", "owner"], ignore_index=True)
        owner, guest, place = (pdf[c].to_numpy() for c in ("owner", "guest", "place"))
        rows = []
        for low, high in _runs(place):
            sets = [np.frombuffer(x, "<u8") for x in pdf["members"][low:high]]
            label = np.arange(high - low)
            for x, y in linked_sets(sets, None, percent, label):
                label[label == max(label[x], label[y])] = min(label[x], label[y])
            # owners ascend and guests come last, so a label is its node's least owner
            tree = SignatureTree.of_sets(sets)
            own = ~guest[low:high]
            for i in range(high - low):
                at = low + int(label[i])
                if guest[low + i]:
                    rows += [(owner[low + i], owner[at], place[low], True, None, None, None, None, None)] if not guest[at] else []
                elif label[i] == i:
                    mine = (label == i) & own
                    bits = np.bitwise_or.reduce(tree.maps[mine], axis=0).tobytes()
                    rows.append((owner[at], owner[at], place[low], False, int(tree.low[mine].min()), int(tree.low[mine].max()), int(tree.excess[mine].max()), int(mine.sum()), bits))
                else:
                    rows.append((owner[low + i], owner[at], place[low], False, None, None, None, None, None))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in _NODES.split(", ")])
        yield out.astype({c: "Int32" for c in ("low", "high", "excess", "sets")})

    return run


_ALIVE = "token long, i int, j int, part int, node long, label long, place long, other long"


def _survivors(percent: int, whole: bool, dense: int):
    """Pairs of nodes (node, other) that may be alike, and in dense groups the nodes that survive (other is null).

    With ``whole`` only pairs with a node of several sets.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["token", "i", "j", "part", "node"], ignore_index=True)
        token, i, j, part = (pdf[c].to_numpy() for c in ("token", "i", "j", "part"))
        arrays = [pdf[c].to_numpy(np.int64) for c in ("low", "high", "excess", "node", "label", "place", "sets", "largest")]
        bits = np.frombuffer(b"".join(pdf["bits"]), _U).reshape(len(pdf), -1)
        left, right = [], []
        for a, b in _runs(token, i, j):
            low, high, excess, node, label, place, sets, largest = (x[a:b] for x in arrays)
            cut = b - a if i[a] == j[a] else int(np.count_nonzero(part[a:b] == i[a]))
            if i[a] != j[a] and cut in (0, b - a):
                continue
            make = lambda s: SignatureTree(bits[a:b][s], low[s], high[s], excess[s], node[s].view(_U))  # noqa: B023, E731
            first, other = make(slice(0, cut)), make(slice(cut, None)) if cut < b - a else None
            alive, pairs = np.zeros(b - a, bool), []
            for x, y in surviving_pairs(first, other, percent, label, place):
                if largest[x] == largest[y] != token[a]:
                    continue
                if not whole or sets[x] > 1 or sets[y] > 1:
                    alive[x] = alive[y] = True
                    if pairs is not None:
                        pairs.append((x, y))
                        if len(pairs) > dense * (b - a):
                            pairs = None
            if pairs is None:
                left += (a + np.flatnonzero(alive)).tolist()
                right += [None] * int(alive.sum())
            else:
                pairs = [(x, y) if node[x] < node[y] else (y, x) for x, y in pairs]
                left += [a + x for x, _ in pairs]
                right += [int(node[y]) for _, y in pairs]
        out = pdf.loc[left, ["token", "i", "j", "part", "node", "label", "place"]].reset_index(drop=True)
        out["other"] = pd.array(right, "Int64")
        yield out

    return run


def _pair_links(percent: int):
    """Links between each call's homes and their partners."""

    def run(key: tuple, pairs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        sets = {o: np.frombuffer(m, "<u8") for o, m in zip(held["owner"], held["members"], strict=True)}
        found = [(a, b) for a, b in zip(pairs["home"], pairs["partner"], strict=True) if alike(sets[a], sets[b], percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _compared(pairs: DataFrame, held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among pairs (node, other), each compared where the larger set is."""
    node, other = (sizes.select(F.col("owner").alias(c), F.col("n").alias(f"n_{c}")) for c in ("node", "other"))
    pairs = pairs.join(node, "node").join(other, "other")
    larger = F.col("n_node") >= F.col("n_other")
    pairs = pairs.select(F.when(larger, F.col("node")).otherwise(F.col("other")).alias("home"), F.when(larger, F.col("other")).otherwise(F.col("node")).alias("partner"), F.least("n_node", "n_other").alias("n"))
    many = pairs.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(PARTNERS))).cast("int").alias("k")).where("k > 1")
    calls = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // CALL_MEMBERS))
    k = F.coalesce("k", F.lit(1))
    call = F.when(k > 1, F.xxhash64("home", F.pmod(F.xxhash64("partner"), k))).otherwise(F.pmod(F.xxhash64("home"), F.lit(calls)))
    pairs = stored(pairs.join(small_side(many), "home", "left").select(call.alias("call"), "home", "partner"), "pairs")
    ends = pairs.select("call", F.col("home").alias("owner")).unionByName(pairs.select("call", F.col("partner").alias("owner"))).distinct()
    shipped = held.join(ends, "owner").select(F.col("call").alias("to"), "owner", "members")
    links = pairs.groupBy("call").cogroup(shipped.groupBy("to")).applyInPandas(_pair_links(percent), "a long, b long")
    links = stored(links, "links")
    drop_stored(pairs)
    return links


def _group_links(percent: int):
    """Links between the nodes of each group, verified on the sets that stand for them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["token", "i", "j", "part", "owner"], ignore_index=True)
        token, i, j, part, node, label, place = (pdf[c].to_numpy() for c in ("token", "i", "j", "part", "node", "label", "place"))
        found = []
        for a, b in _runs(token, i, j):
            split = None if i[a] == j[a] else int(np.count_nonzero(part[a:b] == i[a]))
            if split in (0, b - a):
                continue
            sets = [np.frombuffer(x, "<u8") for x in pdf["members"][a:b]]
            found += [(node[a + x], node[a + y]) for x, y in linked_sets(sets, split, percent, label[a:b], place[a:b])]
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _whole_nodes(pairs: DataFrame, own: DataFrame, facts: DataFrame) -> DataFrame:
    """Group rows that bring all sets of each node together with those of all its partners, in parts of either side.

    Of a pair the node of more sets is at home, so a large node travels once for its partners.
    """
    sizes = own.where("sets IS NOT NULL").select("node", "sets")
    of = lambda c: sizes.select(F.col("node").alias(c), F.col("sets").alias(f"{c}_sets"))
    pairs = pairs.join(of("node"), "node").join(of("other"), "other")
    first = F.col("node_sets") >= F.col("other_sets")
    pick = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    pairs = pairs.select(pick("node", "other", "home"), pick("other", "node", "partner"), F.greatest("node_sets", "other_sets").alias("many"), F.least("node_sets", "other_sets").alias("few"))
    pairs = stored(pairs, "pairs")
    parts = lambda x: F.ceil(x / F.lit(float(LEAF_SETS))).cast("int")
    grid = pairs.groupBy("home").agg(parts(F.max("many")).alias("across"), parts(F.sum("few")).alias("down"))
    members = own.select("owner", "node").join(facts, "node")
    side = lambda c, n: F.pmod(F.xxhash64("owner"), F.col(n)).cast("int").alias(c)
    every = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    left = grid.join(members.withColumnRenamed("node", "home"), "home").select(F.col("home").alias("token"), F.col("home").alias("node"), "owner", "label", "place", side("i", "across"), every("j", "down"))
    right = pairs.join(members.withColumnRenamed("node", "partner"), "partner").join(grid, "home")
    right = right.select(F.col("home").alias("token"), F.col("partner").alias("node"), "owner", "label", "place", every("i", "across"), side("j", "down"))
    beyond = F.lit(1 << 30)  # parts of the second side are numbered after all of the first
    both = left.withColumn("part", F.col("i")).unionByName(right.withColumn("part", F.col("j") + beyond))
    return both.select("token", "i", (F.col("j") + beyond).alias("j"), "part", "node", "label", "place", "owner")


def _dealt_groups(groups: DataFrame) -> DataFrame:
    """The groups' rows with part, i, j and call: large groups in parts, each pair of parts in a call of its own."""
    sizes = groups.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(GROUP_NODES))).cast("int").alias("k")).where("k > 1")
    calls = max(1, -(-groups.count() // CALL_NODES))
    k = F.coalesce("k", F.lit(1))
    dealt = groups.join(small_side(sizes), "token", "left").withColumn("part", F.pmod(F.xxhash64("node"), k).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), k - 1)))
    call = F.when(k > 1, F.xxhash64("token", F.least("part", "with"), F.greatest("part", "with"))).otherwise(F.pmod(F.xxhash64("token"), F.lit(calls)))
    return dealt.select("token", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "node", "label", "place", "largest", call.alias("call"))


def verified_components(entries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(owner, component) for the owners of ``entries`` (token, owner, n); equal components are joined by links.

    ``members`` has (owner, members: ascending unsigned 64-bit integers, packed) for these owners at least. A component
    is named by one of its owners. Repeated entries count once.
    """
    owners = stored(entries.groupBy("owner").agg(F.min(F.xxhash64("token")).alias("leaf"), F.max("n").alias("n")), "owners")
    sizes = owners.groupBy("leaf").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("weight"))
    parts = F.ceil(F.greatest(F.col("sets") / F.lit(float(LEAF_SETS)), F.col("weight") / F.lit(float(LEAF_MEMBERS)))).cast("int")
    large = stored(sizes.select("leaf", parts.alias("k")).where("k > 1"), "leaves")
    total = owners.agg(F.sum("n")).first()[0] or 0
    calls = max(1, -(-total // CALL_MEMBERS))
    spread = owners.join(small_side(large), "leaf", "left")
    place = F.when(F.col("k") > 1, F.xxhash64("leaf", F.pmod(F.xxhash64("owner"), F.col("k")))).otherwise(F.col("leaf"))
    call = lambda: F.when(F.col("k") > 1, F.col("place")).otherwise(F.pmod(F.xxhash64("leaf"), F.lit(calls)))
    spread = spread.withColumn("place", place).select("owner", "place", call().alias("call"), F.lit(False).alias("guest"))
    split = not large.isEmpty()
    if split:
        guests = owners.join(small_side(large), "leaf").groupBy("leaf", "k").agg(F.min("owner").alias("owner"))
        guests = guests.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        guests = guests.withColumn("place", F.xxhash64("leaf", F.pmod(F.col("at").cast("long"), F.col("k"))))
        own = F.xxhash64("leaf", F.pmod(F.xxhash64("owner"), F.col("k")))
        spread = spread.unionByName(guests.where(F.col("place") != own).select("owner", "place", F.col("place").alias("call"), F.lit(True).alias("guest")))
    held = stored(members.join(small_side(owners.select("owner")), "owner").select("owner", "members"), "members")
    shipped = held.join(spread, "owner").select("call", "place", "owner", "guest", "members")
    nodes = stored(shipped.groupBy("call").applyInPandas(_leaf_nodes(percent), _NODES), "nodes")
    own = nodes.where("NOT guest")

    edges = []
    labels = None
    if split:
        homes = own.select("owner", F.col("node").alias("home"))
        edges.append(stored(nodes.where("guest").join(homes, "owner").select(F.col("node").alias("a"), F.col("home").alias("b")), "links"))
        labels = _labels(edges)
    placed = entries.select("token", "owner").join(own.select("owner", "node", "place"), "owner").select("token", "node", "place").distinct()
    placed = _labelled(placed, labels)
    ends = [f(c).alias(f"{n}_{c}") for c in ("label", "place") for n, f in (("least", F.min), ("most", F.max))]
    marks = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"mark_{seed}") for seed in (1, 2)]
    tokens = placed.groupBy("token").agg(*ends, *marks, F.count(F.lit(1)).alias("q")).where("least_label <> most_label AND least_place <> most_place")
    tokens = tokens.groupBy("mark_1", "mark_2", "q").agg(F.min("token").alias("token"))  # tokens of the same nodes say the same
    groups = stored(placed.join(tokens.select("token", "q"), "token"), "tokens")
    drop_stored(large)
    # Pairs are decided at the largest token that both have as their largest: a token whose nodes all have the same
    # one, another, says nothing new.
    largest = groups.groupBy("node").agg(F.max(F.struct("q", "token")).alias("largest")).select("node", F.col("largest.token").alias("largest"))
    known = groups
    groups = groups.drop("q").join(largest, "node")
    news = groups.groupBy("token").agg(F.min("largest").alias("x"), F.max("largest").alias("y")).where("x <> y OR x = token")
    groups = stored(groups.join(news.select("token").repartition("token"), "token"), "groups")
    drop_stored(known)
    for whole in (False, True):
        if groups.isEmpty():
            break
        facts = own.where("bits IS NOT NULL").select("node", "low", "high", "excess", "sets", "bits")
        dealt = _dealt_groups(groups).join(facts, "node")
        alive = stored(dealt.groupBy("call").applyInPandas(_survivors(percent, whole, 2**62 if whole else DENSE), _ALIVE), "alive")
        pairs = alive.where("other IS NOT NULL").select("node", "other").distinct()
        crowds = alive.where("other IS NULL").drop("other")
        before = len(edges)
        if not whole:
            asked = crowds.withColumn("owner", F.col("node"))
            if not pairs.isEmpty():
                edges.append(_compared(pairs, held, owners.select("owner", "n"), percent))
        else:
            asked = _whole_nodes(pairs, own, groups.select("node", "label", "place").distinct())
        weighed = asked.join(owners.select("owner", "n"), "owner")
        if total := weighed.agg(F.sum("n")).first()[0]:
            calls = max(1, -(-total // CALL_MEMBERS))
            weighed = weighed.drop("n").withColumn("call", F.pmod(F.xxhash64("token", "i", "j"), F.lit(calls)))
            edges.append(stored(weighed.join(held, "owner").groupBy("call").applyInPandas(_group_links(percent), "a long, b long"), "links"))
        drop_stored(alive)
        if len(edges) == before:
            break
        labels = _labels(edges)
        if not whole:
            groups = _labelled(groups.drop("label"), labels)
            apart = groups.join(own.where("sets IS NOT NULL").select("node", "sets"), "node").groupBy("token")
            apart = apart.agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("sets").alias("sets")).where("x <> y AND sets > 1")
            groups = stored(groups.join(apart.select("token").repartition("token"), "token"), "groups")
    for done in (owners, held, groups, *edges):
        drop_stored(done)
    found = _labelled(own.select("owner", "node"), labels)
    return found.select("owner", F.col("label").alias("component"))


def _labels(edges: list[DataFrame]) -> DataFrame:
    both = edges[0]
    for more in edges[1:]:
        both = both.unionByName(more)
    return connected_components(both).select(F.col("vertex").alias("node"), F.col("component").alias("label"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the component that each node is known to lie in."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
