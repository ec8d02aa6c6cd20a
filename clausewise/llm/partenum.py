"""Jaccard join of word n-gram sets by PartEnum signatures, and the connected components of its links.

Two sets whose Jaccard similarity reaches ``percent`` differ in at most k elements, where k follows from their sizes.
Sets are put into size bands (and into the next band too, if a partner may be there), and all sets of a band use the
band's k: the domain of elements is hashed into n1 x n2 parts, of which some group of n2 holds at most k / n1 of the
differences, so one way of leaving out that many of its parts leaves equal elements. A signature is the hash of the
elements in the parts that are kept, one for each group and subset; sufficiently similar sets share one for certain.
A signature of no elements would tell nothing. A set that has one shares, with any partner that has it too, an element of
their prefixes in a fixed order of elements; the pair of signature and such an element takes its place. Sets of more than
``FEW_PARTS`` parts need no such stand-in: k differences leave about a third of their k + 1 parts alone, and that none of
those holds an element is less likely than a collision of the 64-bit hashes.

From signatures to components without listing the pairs of a group:

* Equal sets are one class, found by a 128-bit hash and one aggregation; copies never meet in pairs. A class is numbered
  by the first half of its hash, or by a mix of both where two classes share that.
* Signatures of one class only are dropped by an aggregation; a bit table of fixed size then keeps most of the rest from
  being shuffled again, and an exact join decides.
* Every class is compared with one hub, the member of its groups that shares most signatures. That settles the bulk of a
  large group of near copies.
* What is left are groups whose members lie in different components. A link between components is always inside such a
  group, and what its two sets share is held by open members of different components: a member with too few such elements
  has no link there and goes (``reaching``), as most sets do that only share a passage. In ``HUB_ROUNDS`` every open member meets a hub of another component, so that mutual near copies grow together;
  then groups of at most ``FEW_MEMBERS`` open members give their pairs, each pair once and only where components differ
  and sizes can match; bit maps that can only err on the safe side sift them before whole sets are joined. Larger groups
  compare their bit maps in blocks of bounded size, skipping blocks whose sizes cannot match or whose members are
  connected already; a large component has blocks of its own. At first each member meets only the one that is nearest by its
  map, so that mutual near copies grow together before all pairs are asked for.

Every similarity is computed exactly on 64-bit hashes of n-grams. Null and empty texts have no set and stay alone; a
text of fewer than n words is one sequence. Documents of equal doc_id count as one document with several texts; a null
doc_id never names a component unless all of a component's ids are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.decontaminate import bit_table, maybe
from clausewise.llm.graph import components
from clausewise.llm.textkit import free, give_back, lists, mixed, prepare, slices, text_shingles
from clausewise.session import discard, materialise

BAND_RATIO = 1.5
FEW_PARTS = 64
FEW_MEMBERS = 32
MANY_TIMES = 8  # groups of more than so many times few members look for the nearest ones first
HUB_ROUNDS = 3
BLOCK_ELEMENTS = 1_000_000
BLOCK_ROWS = 1024
BUCKET_SIGNATURES = 250_000
SLICE_BYTES = 2 << 20  # signatures take many times the memory of their text
BATCH_BYTES = 4 << 20  # of Arrow rows: a batch holds the sets of both sides of its pairs
PIECE = (1 << 21) - 1


def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of every band; a band is wide enough that partners are in it or in a neighbour."""
    low, ratio = [1], max(BAND_RATIO, 100 / percent)
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * ratio) + 1))
    first = np.array(low, np.int64)
    return first[:-1], first[1:] - 1


def differences(last: np.ndarray, percent: int) -> np.ndarray:
    """How many elements two sets of at most ``last`` elements may differ in."""
    return (100 - percent) * 2 * last // (100 + percent)


def scheme(k: int) -> tuple[int, int, int]:
    """n1 groups of n2 parts, and how many parts of a group may differ."""
    if k == 0:
        return 1, 1, 0
    if k <= 2:
        return 1, k + 2, k
    return -(-(k + 1) // 2), 2, 1


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    out = np.zeros((len(sets), 2), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(size)
    if len(some):
        m = mixed(np.concatenate([sets[i] for i in some]) + np.uint64(3))
        begin = np.cumsum(size[some]) - size[some]
        sums = np.stack([np.add.reduceat(x, begin) for x in (m, mixed(m + np.uint64(5)))], 1)
        out[some] = mixed(sums + size[some][:, None].astype(np.uint64))
    return out


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, signature) for all signatures of the sets; empty sets have none."""
    first, last = bands(percent)
    most = differences(last, percent)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    own = np.searchsorted(first, size, side="right") - 1
    some = np.flatnonzero(size > 0)
    up = some[size[some] * 100 >= percent * first[own[some] + 1]]
    row = np.concatenate((some, up))
    band = np.concatenate((own[some], own[up] + 1))
    shape = np.array([scheme(int(most[b])) for b in band], np.int64).reshape(-1, 3)
    parts = shape[:, 0] * shape[:, 1]
    base = np.cumsum(parts) - parts
    n = size[row]
    at = np.repeat(begin[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    element = flat[at]
    salted = mixed(element ^ np.repeat(mixed(band.astype(np.uint64) + np.uint64(77)), n))
    part = np.repeat(base, n) + (salted % np.repeat(parts, n).astype(np.uint64)).astype(np.int64)
    value = mixed(element + np.uint64(11))
    total = int(parts.sum())
    # sums of three pieces of 21 bits are exact in doubles
    sums = np.stack([np.bincount(part, ((value >> np.uint64(21 * j)) & np.uint64(PIECE)).astype(np.float64), total) for j in range(3)], 1).astype(np.uint64)
    held = np.bincount(part, minlength=total)
    owners, keys, kept, lines = [], [], [], []
    for s in {tuple(x) for x in shape.tolist()}:
        mine = np.flatnonzero((shape == s).all(1))
        for group in range(1) if s[0] == 1 else (None,):
            if group is None:  # one part is kept of each pair of parts, so each part alone is a signature
                cells = np.repeat(base[mine], parts[mine]) + np.arange(parts[mine].sum()) - np.repeat(np.cumsum(parts[mine]) - parts[mine], parts[mine])
                owners.append(np.repeat(mine, parts[mine]))
                lines.append(cells - np.repeat(base[mine], parts[mine]))
                keys.append(sums[cells])
                kept.append(held[cells])
            else:
                for number, subset in enumerate(combinations(range(s[1]), s[1] - s[2])):
                    cells = base[mine][:, None] + np.array(subset)
                    owners.append(mine)
                    lines.append(np.full(len(mine), number))
                    keys.append(sums[cells].sum(1))
                    kept.append(held[cells].sum(1))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, key, count, line = np.concatenate(owners), np.concatenate(keys), np.concatenate(kept), np.concatenate(lines)
    place = mixed(mixed(band[owner].astype(np.uint64) + np.uint64(1000)) + line.astype(np.uint64))
    full = mixed(mixed(mixed(key[:, 0] + place) + key[:, 1]) + key[:, 2])
    out_row, out_key = [row[owner][count > 0]], [full[count > 0]]
    for i in np.flatnonzero((count == 0) & (parts[owner] <= FEW_PARTS)):
        s = sets[row[owner[i]]]
        prefix = len(s) - -(-percent * len(s) // 100) + 1
        order = mixed(s + np.uint64(23))
        lead = np.sort(order)[:prefix]
        out_row.append(np.full(len(lead), row[owner[i]]))
        out_key.append(mixed(lead + place[i]))
    return np.concatenate(out_row), np.concatenate(out_key)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _fresh(found: np.ndarray, seen: set) -> np.ndarray:
    """Which sets this task meets for the first time."""
    out = np.zeros(len(found), bool)
    for i, key in enumerate(map(tuple, found.tolist())):
        if key not in seen:
            seen.add(key)
            out[i] = True
    return out


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, size, h1, h2`` of every row's set."""

    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = text_shingles(batch.column("text"), n)
            keys = set_keys(sets).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                ["doc_id", "text_key", "size", "h1", "h2"],
            )
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, size long, h1 long, h2 long")


def class_ids(keys: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """The number of a set's class: its first hash, or for the ``clash`` hashes that two classes share a mix of both."""
    return np.where(np.isin(keys[:, 0], clash), mixed(mixed(keys[:, 0]) + keys[:, 1]), keys[:, 0])


def clash_ids(classes: DataFrame) -> DataFrame:
    """``h1, h2, mixed``: the numbers of classes whose first hash clashes."""

    def run(batches):
        for batch in batches:
            h = np.stack([batch.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2")], 1)
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(mixed(mixed(h[:, 0]) + h[:, 1]).astype(np.int64))], ["h1", "h2", "mixed"])

    return classes.select("h1", "h2").mapInArrow(run, "h1 long, h2 long, mixed long")


def packed_signatures(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """``bucket, seeds, marks``: all signatures, packed by leading bits, with six bytes of the set's hash as its mark.

    A slice of documents is aggregated before anything is shuffled: a signature comes once with the smallest and, if
    it differs, the largest mark, so a signature of very many documents stays a few rows of each task.
    """

    def run(batches):
        seen: set = set()
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = text_shingles(batch.column("text"), n)
            keys = set_keys(sets)
            new = np.flatnonzero(_fresh(keys, seen) & np.array([len(s) > 0 for s in sets], bool))
            row, sig = signatures([sets[i] for i in new], percent)
            if not len(sig):
                continue
            mark = keys[new, 0][row] & MARK
            order = np.lexsort((mark, sig))
            sig, mark = sig[order], mark[order]
            first = np.concatenate(([True], sig[1:] != sig[:-1]))
            last = np.concatenate((first[1:], [True]))
            heads, tails = np.flatnonzero(first), np.flatnonzero(last)
            two = tails[mark[tails] != mark[heads]]
            keep = np.sort(np.concatenate((heads, two)))
            sig, mark = sig[keep], mark[keep]
            bucket = bucket_of(sig, buckets)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            pairs = list(zip(edges[:-1], edges[1:], strict=True))
            for at in range(0, len(pairs), 200):
                part = pairs[at : at + 200]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[i]) for i, _ in part], pa.int64()),
                        pa.array([sig[i:j].tobytes() for i, j in part], pa.binary()),
                        pa.array([mark[i:j].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i, j in part], pa.binary()),
                    ],
                    ["bucket", "seeds", "marks"],
                )
        give_back()

    return docs.select("text").mapInArrow(run, "bucket long, seeds binary, marks binary")


MARK = np.uint64((1 << 48) - 1)


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of signatures of equal width."""
    return ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def shared_signatures(packed: DataFrame) -> DataFrame:
    """``seed``: the signatures that sets of different marks have."""

    def work(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group["seeds"].to_pylist()), np.uint64)
        six = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(-1, 6)
        mark = np.zeros((len(sig), 8), np.uint8)
        mark[:, :6] = six
        mark = mark.view(np.uint64)[:, 0]
        order = np.argsort(sig, kind="stable")
        sig, mark = sig[order], mark[order]
        heads = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        split = np.minimum.reduceat(mark, heads) != np.maximum.reduceat(mark, heads)
        return pa.table([pa.array(sig[heads[split]].astype(np.int64))], names=["seed"])

    return packed.groupBy("bucket").applyInArrow(work, "seed long")


def signature_rows(docs: DataFrame, n: int, percent: int, known) -> DataFrame:
    """``seed, cid, size, weight``: those signatures that ``known`` (a bit table and the clashing hashes) may hold.

    Each set comes once per task; weight is the number of its signatures that are given.
    """

    def run(batches):
        seen: set = set()
        table, clash = known.value
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = text_shingles(batch.column("text"), n)
            keys = set_keys(sets)
            size = np.array([len(s) for s in sets], np.int64)
            new = np.flatnonzero(_fresh(keys, seen) & (size > 0))
            row, sig = signatures([sets[i] for i in new], percent)
            hit = maybe(table, sig)
            row, sig = row[hit], sig[hit]
            weight = np.bincount(row, minlength=len(new))
            columns = [sig, class_ids(keys[new], clash)[row], size[new][row], weight[row]]
            for a in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000].astype(np.int64)) for c in columns], ["seed", "cid", "size", "weight"])
        give_back()

    return docs.select("text").mapInArrow(run, "seed long, cid long, size long, weight long")


def wanted_sets(docs: DataFrame, n: int, known) -> DataFrame:
    """``cid, elements, bits`` of the sets whose class ``known`` (a bit table and the clashing hashes) may hold, once per task."""

    def run(batches):
        seen: set = set()
        table, clash = known.value
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = text_shingles(batch.column("text"), n)
            keys = set_keys(sets)
            cid = class_ids(keys, clash)
            new = np.flatnonzero(maybe(table, cid) & np.array([len(s) > 0 for s in sets], bool))
            new = new[_fresh(keys[new], seen)]
            for a in range(0, len(new), 100):
                part = new[a : a + 100]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[part].astype(np.int64)), lists([sets[i] for i in part], pa.int64()), pa.array([bit_map(sets[i]).tobytes() for i in part], pa.binary())],
                    ["cid", "elements", "bits"],
                )
        give_back()

    return docs.select("text").mapInArrow(run, "cid long, elements array<long>, bits binary")


def bit_map(s: np.ndarray) -> np.ndarray:
    """At least four bits for every element, packed; the bit of each element is set."""
    width = 1 << max(6, int(4 * len(s) - 1).bit_length())
    out = np.zeros(width, bool)
    out[(mixed(s + np.uint64(41)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Never False for similar sets of ``n`` and ``m`` elements: a bit that one map lacks is an element that the other set lacks."""
    width = min(len(a), len(b))
    a, b = np.bitwise_or.reduce(a.reshape(-1, width)), np.bitwise_or.reduce(b.reshape(-1, width))
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * both >= percent * (n + m - both)


def sifted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that the bit maps, a sixteenth of the sets, do not rule out."""
    one = sets.select(F.col("cid").alias("a"), F.col("bits").alias("x"), F.size("elements").alias("n"))
    two = sets.select(F.col("cid").alias("b"), F.col("bits").alias("y"), F.size("elements").alias("m"))

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "y", "n", "m")]
            good = [may_be_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, percent) for x, y, n, m in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b, x, y`` whose sets ``x`` and ``y`` are similar, as ``a, b``."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [similar(p.values.to_numpy(), q.values.to_numpy(), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def folded(maps: list[np.ndarray], width: int) -> np.ndarray:
    """Bit maps as the rows of a matrix, all brought to ``width`` cells."""
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps])


def block_pairs(one: tuple, two: tuple, percent: int, nearest: bool = False):
    """(a, b, share) arrays of members of different components that the bit maps do not rule out; a side is (ids, components, sizes, maps).

    ``share`` is the most that the similarity can be. With ``nearest`` each member of both sides comes once, with one of largest share.
    """
    width = min(len(m) for side in (one, two) for m in side[3])
    left, right = folded(one[3], width), folded(two[3], width)
    top, partner = np.zeros(len(right)), np.zeros(len(right), np.int64)
    for i in range(len(left)):
        lost, extra = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (left[i] & ~right, right & ~left[i]))
        both = np.minimum(one[2][i] - lost, two[2] - extra)
        good = (100 * both >= percent * (one[2][i] + two[2] - both)) & (two[1] != one[1][i])
        if not good.any():
            continue
        share = np.where(good, both / np.maximum(one[2][i] + two[2] - both, 1), 0.0)
        if nearest:
            ahead = share > top
            top[ahead], partner[ahead] = share[ahead], one[0][i]
            good = np.arange(len(right)) == share.argmax()
        yield np.full(int(good.sum()), one[0][i]), two[0][good], share[good]
    if nearest and (top > 0).any():
        yield two[0][top > 0], partner[top > 0], top[top > 0]


def open_groups(members: DataFrame, settled: DataFrame) -> DataFrame:
    """``seed, cid, size, weight, component`` of the groups whose members are not all in one component."""
    labelled = materialise(members.join(settled, members["cid"] == settled["node"], "left").select("seed", "cid", "size", "weight", F.coalesce("component", "cid").alias("component")))
    split = materialise(labelled.groupBy("seed").agg(F.min("component").alias("one"), F.max("component").alias("two")).filter(F.col("one") != F.col("two")).select("seed"))
    out = materialise(labelled.join(split, "seed", "left_semi"))
    discard(labelled, split)
    return out


def reaching(rows: DataFrame, sets: DataFrame, percent: int, of: int = 1) -> DataFrame:
    """The ``rows`` of open members that may have a link to another component.

    Similar sets of two components share at least ``percent`` of either one's elements, each of which open members of different
    components hold. Looking at one in ``of`` elements only, or at a bit table, may take more elements for such, never fewer.
    """
    context = rows.sparkSession.sparkContext
    held = rows.select("cid", "component").distinct().join(sets.select("cid", "elements"), "cid").select("component", F.explode("elements").alias("seed"))
    ends = held.filter(F.col("seed") % of == 0).groupBy("seed").agg(F.min("component").alias("one"), F.max("component").alias("two"))
    across = context.broadcast(bit_table(ends.filter(F.col("one") != F.col("two"))))
    give_back()

    def run(batches):
        for batch in batches:
            elements = batch.column("elements")
            flat, size = elements.flatten().to_numpy(), np.diff(elements.offsets.to_numpy())
            sums = np.concatenate(([0], np.cumsum(maybe(across.value, flat.astype(np.uint64)) | (flat % of != 0))))
            last = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("cid").filter(pa.array(100 * (sums[last] - sums[last - size]) >= percent * size))], ["cid"])

    able = materialise(sets.select("cid", "elements").mapInArrow(run, "cid long"))
    out = materialise(rows.join(able, "cid", "left_semi"))
    across.destroy()
    discard(able)
    return out


def could_match(x: str, y: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return (F.col(x) * percent <= F.col(y) * 100) & (F.col(y) * percent <= F.col(x) * 100)


def _group_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs that share one of these signatures, lie in different components and could match; each once."""
    left = rows.select("seed", F.col("cid").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("one"))
    right = rows.select("seed", F.col("cid").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("two"))
    met = left.join(right, "seed").filter((F.col("a") < F.col("b")) & (F.col("one") != F.col("two")) & could_match("size_a", "size_b", percent))
    return met.select("a", "b").distinct()


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """``a, b``: every member with one hub: of its groups' leading members in another component the first.

    Members that share most signatures lead in the first turn, others by hash in later ones.
    """
    rank = F.col("weight") if turn == 0 else F.xxhash64("cid", F.lit(turn))
    lead = F.max(F.struct(rank.alias("rank"), "cid", "component"))
    first = materialise(rows.groupBy("seed").agg(lead.alias("first")))
    beside = rows.join(first, "seed").filter(F.col("component") != F.col("first.component"))
    second = materialise(beside.groupBy("seed").agg(lead.alias("second")))
    both = materialise(first.join(second, "seed"))
    hub = F.when(F.col("component") != F.col("first.component"), F.col("first")).otherwise(F.col("second"))
    out = materialise(rows.join(both, "seed").groupBy(F.col("cid").alias("a")).agg(F.max(hub).alias("hub")).select("a", F.col("hub.cid").alias("b")))
    discard(first, second, both)
    return out


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _blocks(members: DataFrame, sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """``a, b``: pairs inside large groups, ``members(seed, cid, component, size)``, that lie in different components and
    that the bit maps do not rule out: chunks of like sizes, chunk against chunk; only the maps are shuffled. A component that
    fills a chunk has chunks of its own, which do not meet one another. With ``nearest`` each ``a`` comes once, with its nearest."""
    # groups of the same members, as the many signatures of near copies make them, are one
    whole = members.groupBy("seed").agg(F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("n"))
    kept = materialise(whole.groupBy("sum", "low", "high", "n").agg(F.min("seed").alias("seed")).select("seed"))
    banded = members.join(kept, "seed", "left_semi").withColumn("band", F.floor(F.log("size") * 10))
    weight = F.greatest(F.col("size"), F.lit(BLOCK_ELEMENTS // BLOCK_ROWS))
    parts = materialise(banded.groupBy("seed", "band", "component").agg(F.ceil(F.sum(weight) / BLOCK_ELEMENTS).alias("parts"), F.sum(weight).alias("sum")))
    together = materialise(parts.groupBy("seed", "band").agg(F.ceil(F.sum(F.when(F.col("parts") == 1, F.col("sum"))) / BLOCK_ELEMENTS).alias("shared")))
    slot = F.when(F.col("parts") > 1, F.xxhash64("band", "component", F.pmod(F.xxhash64("cid"), "parts"))).otherwise(F.xxhash64("band", F.pmod(F.xxhash64("component"), "shared")))
    dealt = banded.join(parts.drop("sum"), ["seed", "band", "component"]).join(together, ["seed", "band"])
    chunked = materialise(dealt.select("seed", "cid", "component", "size", slot.alias("chunk")))
    about = materialise(
        chunked.groupBy("seed", "chunk").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("component").alias("one"), F.max("component").alias("two"))
    )
    left = about.select("seed", F.col("chunk").alias("i"), F.col("least").alias("least_i"), F.col("most").alias("most_i"), F.col("one").alias("one_i"), F.col("two").alias("two_i"))
    right = about.select("seed", F.col("chunk").alias("j"), F.col("least").alias("least_j"), F.col("most").alias("most_j"), F.col("one").alias("one_j"), F.col("two").alias("two_j"))
    settled = (F.col("one_i") == F.col("two_i")) & (F.col("one_j") == F.col("two_j")) & (F.col("one_i") == F.col("one_j"))
    fits = (F.col("least_j") * percent <= F.col("most_i") * 100) & (F.col("least_i") * percent <= F.col("most_j") * 100)
    plan = left.join(right, "seed").filter((F.col("i") <= F.col("j")) & fits & ~settled).select("seed", "i", "j")
    sides = materialise(plan.select("seed", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("chunk")))
    maps = sets.select("cid", "bits")
    rows = sides.join(chunked, ["seed", "chunk"]).join(maps, "cid").select("seed", "i", "j", "chunk", "cid", "component", "size", "bits")

    def work(group: pa.Table) -> pa.Table:
        chunk = group["chunk"].to_numpy()
        ids, comps, sizes = (group[c].to_numpy() for c in ("cid", "component", "size"))
        maps = group["bits"].to_pylist()
        sides = []
        for c in np.unique(chunk):
            mine = np.flatnonzero(chunk == c)
            sides.append((ids[mine], comps[mine], sizes[mine], [np.frombuffer(maps[i], np.uint64) for i in mine]))
        one_sided = group["i"][0].as_py() == group["j"][0].as_py()
        found = list(block_pairs(sides[0], sides[-1], percent, nearest)) if one_sided or len(sides) == 2 else []
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        share = np.concatenate([f[2] for f in found] or [np.zeros(0)])
        one, two = (a, b) if nearest else (np.minimum(a, b), np.maximum(a, b))
        return pa.table([pa.array(one), pa.array(two), pa.array(share)], names=["a", "b", "share"])

    found = rows.groupBy("seed", "i", "j").applyInArrow(work, "a long, b long, share double")
    if nearest:
        return found.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return found.select("a", "b").distinct()


def all_links(members: DataFrame, starred: DataFrame, sets: DataFrame, percent: int, few: int) -> DataFrame:
    """``a, b``: links that connect what all links connect, beginning with the ``starred`` ones.

    Linked sets share a signature, so a link between components lies inside a group that both of them touch, and between
    members that reach other components. In each of ``HUB_ROUNDS`` every open member meets one hub of another component, which
    contracts groups of mutual near copies. Then groups of at most ``few`` open members give their pairs, and larger ones are
    compared in blocks, nearest members first.
    """
    links = starred
    rows = open_groups(members, components(links))
    for of in (2, 1):  # half of the elements rule most out; what only those held that are gone no longer counts
        rows = reaching(rows, sets, percent, of)
    for turn in range(HUB_ROUNDS):
        if turn:
            rows = open_groups(rows.drop("component"), components(links))
        met = materialise(sifted(_hub_pairs(rows, turn), sets, percent))
        links = links.unionByName(materialise(verified(_with_sets(met, sets), percent)))
        discard(met)
    rows = reaching(open_groups(rows.drop("component"), components(links)), sets, percent)
    sizes = materialise(rows.groupBy("seed").agg(F.count("*").alias("n")))
    small = rows.join(sizes.filter(F.col("n") <= few).select("seed"), "seed", "left_semi")
    large = materialise(rows.join(sizes.filter(F.col("n") > few).select("seed"), "seed", "left_semi"))
    paired = materialise(sifted(_group_pairs(small, percent), sets, percent))
    links = links.unionByName(materialise(verified(_with_sets(paired, sets), percent)))
    for _ in range(HUB_ROUNDS):
        many = large.join(sizes.filter(F.col("n") > few * MANY_TIMES).select("seed"), "seed", "left_semi")
        met = materialise(_blocks(many, sets, percent, nearest=True)) if not many.isEmpty() else None
        new = met and materialise(verified(_with_sets(met, sets), percent))
        if new is None or new.isEmpty():
            break
        links = links.unionByName(new)
        large = open_groups(large.drop("component"), components(links))
    if large.isEmpty():
        return links
    blocked = materialise(_blocks(large, sets, percent))
    return links.unionByName(materialise(verified(_with_sets(blocked, sets), percent)))


def join(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per row of ``doc_id, text`` (and more): ``doc_id, n_shingles, component_id``.

    Documents are linked when 100 x intersection >= ``percent`` x union of their n-gram sets; ``component_id`` is the
    smallest doc_id that links reach.
    """
    rows = labelled_rows(docs, n, percent)
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def labelled_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per row: ``doc_id, text_key, size, component, name``; ``component`` numbers the groups, ``name`` is its smallest doc_id."""
    context = prepare(docs.sparkSession, BATCH_BYTES).sparkContext
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = ["size", "h1", "h2"]
    keyed = materialise(set_table(given, n))
    classes = materialise(keyed.filter("size > 0").groupBy(*own).agg(F.min("doc_id").alias("doc")))
    # two sets with one 64-bit hash: about rows^2 / 2^65 of them
    clash = classes.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1").toArrow()["h1"].to_numpy().astype(np.uint64)
    # about BUCKET_SIGNATURES signatures each, after the number of elements
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(16, total * (100 - percent) * 4 // (100 + percent) // BUCKET_SIGNATURES)
    shared = materialise(shared_signatures(packed_signatures(given, n, percent, buckets)))
    known = context.broadcast((bit_table(shared), clash))
    give_back()
    members = materialise(signature_rows(given, n, percent, known).join(shared, "seed", "left_semi"))
    known.destroy()
    sized = materialise(members.select("cid", "size").distinct())
    sought = context.broadcast((bit_table(sized.select(F.col("cid").alias("seed"))), clash))
    give_back()
    sets = materialise(wanted_sets(given, n, sought).join(sized.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]))
    sought.destroy()

    # one hub per class: of the members of its groups the one that shares most signatures
    hubs = members.groupBy("seed").agg(F.max(F.struct("weight", "cid")).alias("hub"))
    star = members.join(hubs, "seed").filter(F.col("cid") != F.col("hub.cid")).groupBy(F.col("cid").alias("a")).agg(F.max("hub").alias("hub"))
    star = materialise(star.select("a", F.col("hub.cid").alias("b")))
    starred = materialise(verified(_with_sets(star, sets), percent))
    links = materialise(all_links(members, starred, sets, percent, FEW_MEMBERS))
    discard(members, sets, shared, star)
    joined = components(links)
    own_id = F.col("h1")
    if len(clash):
        clashing = docs.sparkSession.createDataFrame([(int(x),) for x in clash.astype(np.int64)], "h1 long")
        mixed_ids = clash_ids(classes.join(clashing, "h1", "left_semi"))
        classes = classes.join(mixed_ids, ["h1", "h2"], "left")
        own_id = F.coalesce("mixed", "h1")
    numbered = classes.withColumn("cid", own_id)
    labels = numbered.join(joined, numbered["cid"] == joined["node"], "left").select(*own, "doc", F.coalesce("component", "cid").alias("component"))
    names = labels.groupBy("component").agg(F.min("doc").alias("name"))
    known = labels.join(names, "component").select(*own, "component", "name")
    return keyed.join(known, own, "left").select("doc_id", "text_key", "size", "component", "name")


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One document of each group of linked documents, all columns: the one of smallest doc_id, null last.

    Rows without words are in no group and all stay. Of rows that repeat the chosen doc_id and text one stays.
    """
    rows = materialise(labelled_rows(docs, n, percent))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    doc, key = free(docs.columns, "_doc"), free(docs.columns, "_key")
    chosen = rows.filter("size > 0").groupBy("component").agg(first).select("first.doc_id", "first.text_key")
    chosen = materialise(chosen.union(rows.filter("size = 0").select("doc_id", "text_key").distinct()).toDF(doc, key))
    text_key = F.xxhash64(docs["text"].cast("string"))
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (text_key == F.col(key))
    kept = docs.join(chosen, match, "left_semi")
    # rows of groups that are there twice
    again = materialise(rows.filter("size > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "text_key").toDF(doc, key))
    if again.isEmpty():
        return kept
    repeated = kept.join(again, match, "left_semi").withColumn(key, text_key).dropDuplicates(["doc_id", key]).drop(key)
    return kept.join(again, match, "left_anti").unionByName(repeated)
