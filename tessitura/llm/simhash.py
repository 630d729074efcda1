"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has 64 bits: bit k is 1 if it is set in over half the
XXH64 hashes of its word shingles. Two fingerprints link if they differ in at
most ``budget`` bits.

Fingerprints that differ in 3 bits agree in one of four 16-bit blocks at
least, so each is dealt out four times, turned so that one block leads. All
that share a leading block form a unit, which is a subtree of the trie: in it,
pairs of nodes are traversed together, differing bits are added up on the way,
and a pair is dropped once they exceed the budget. A unit with more than
``LARGE_UNIT`` fingerprints is divided in the same way by a block of 12 more
bits. Equal fingerprints are one throughout, and of a unit only a spanning
forest of its links leaves the task, so large groups give no squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, spread_join, whole_rows
from .graph import components

SEED = 42
SHINGLE = 3
BUDGET = 3
LARGE_UNIT = 50_000
#: Pairs of nodes that are traversed, and pairs of fingerprints compared, at once.
FRONTIER, LEAF_PAIRS = 100_000, 1_000_000
#: An odd factor turns fingerprints into node numbers in random order, one to one.
SCATTER = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    values = np.ascontiguousarray(values, "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and node (its number in links)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(x or b"", shingle, seed) for x in texts], dtype=np.uint64)
            arrays = [batch.column("doc_id"), pa.array(fps.view(np.int64)), pa.array((fps * SCATTER).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, node long")


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; labels are roots before and after."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = labels[labels]
            if np.array_equal(deeper, labels):
                break
            labels[:] = deeper


def trie_links(units: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of fingerprints, given sorted by (unit, value): equal within a unit where links connect them.

    A node of the trie is a range of the sorted values with a common prefix.
    """
    n = len(values)
    labels = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]])) if n else np.zeros(0, np.int64)
    stops = np.append(starts[1:], n)
    several = stops - starts > 1
    roots = np.stack([starts, stops, starts, stops, np.zeros_like(starts)], axis=1)[several]
    zeros: dict[int, np.ndarray] = {}

    def before(depth: int) -> np.ndarray:
        """How many values before each place have a 0 at this depth."""
        if depth not in zeros:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)])
        return zeros[depth]

    def compare(pairs: np.ndarray) -> None:
        """All pairs of values under pairs of small nodes."""
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        ends = np.cumsum(sizes)
        at = 0
        while at < len(pairs):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAF_PAIRS, side="right")))
            part, size = pairs[at:stop], sizes[at:stop]
            which = np.repeat(np.arange(len(part)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = (part[:, 3] - part[:, 2])[which]
            a, b = part[which, 0] + k // wide, part[which, 2] + k % wide
            keep = (a < b) & (labels[a] != labels[b])
            a, b = a[keep], b[keep]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            _settle(labels, a[near], b[near])
            at = stop

    stack = [(0, roots)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack.append((depth, pairs[FRONTIER:]))
            pairs = pairs[:FRONTIER]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 64
        if depth == 64:
            small[:] = True
        compare(pairs[small])
        pairs = pairs[~small]
        if not len(pairs):
            continue
        cum = before(depth)
        al, ah, bl, bh, err = pairs.T
        am, bm = al + cum[ah] - cum[al], bl + cum[bh] - cum[bl]
        same = al == bl
        children = np.concatenate(
            [
                np.stack([al, am, bl, bm, err], axis=1),
                np.stack([am, ah, bm, bh, err], axis=1),
                np.stack([al, am, bm, bh, err + 1], axis=1),
                np.stack([am, ah, bl, bm, err + 1], axis=1)[~same],
            ]
        )
        full = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2]) & (children[:, 4] <= budget)
        stack.append((depth + 1, children[full]))
    return labels


def links(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links between distinct fingerprints (column fp) as a forest by unit: u, v (node numbers)."""
    if budget > 3:
        raise ValueError("four blocks find fingerprints that differ in 3 bits at most")
    turn = lambda x, k: x if not k else F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))
    dealt = fps.select(F.inline(F.array(*(F.struct(F.lit(k).alias("band"), turn(F.col("fp"), 16 * k).alias("value")) for k in range(4)))))
    dealt = dealt.withColumn("unit", F.col("band") * 65536 + F.shiftrightunsigned("value", 48))
    #: At most 4 x 65536 units exist, so this table is bounded.
    large = dealt.groupBy("unit").count().where(F.col("count") > LARGE_UNIT).select("unit", F.lit(True).alias("large"))
    blocks = F.array(*(F.lit(4096 * (k + 1)) + F.shiftrightunsigned("value", 36 - 12 * k).bitwiseAND(4095) for k in range(4)))
    spread = dealt.join(F.broadcast(large), "unit", "left").select(
        F.explode(F.when(F.col("large"), blocks).otherwise(F.array(F.lit(0).cast("long")))).alias("part"), "unit", "value", "band"
    )
    keyed = spread.select((F.col("unit") * 32768 + F.col("part")).alias("unit"), "value", F.col("band").cast("int").alias("band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(parts: list[tuple]) -> pa.RecordBatch:
            units, values, bands = (np.concatenate(x) for x in zip(*parts, strict=True))
            values = values.view(np.uint64)
            order = np.lexsort((values, units))
            units, values, bands = units[order], values[order], bands[order]
            labels = trie_links(units, values, budget)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            back = (16 * bands).astype(np.uint64)
            own = np.where(back == 0, values, (values >> back) | (values << ((np.uint64(64) - back) & np.uint64(63))))
            nodes = (own * SCATTER).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[labels[linked]])], names=["u", "v"])

        for batch in batches:
            part = tuple(batch.column(x).to_numpy() for x in ("unit", "value", "band"))
            held.append(part)
            size += batch.num_rows
            if size >= 200_000:  # all units but the last are complete, for rows come by unit
                units = np.concatenate([x[0] for x in held])
                cut = int(np.searchsorted(units, units[-1]))
                if cut:
                    whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    yield out([tuple(x[:cut] for x in whole)])
                    held, size = [tuple(x[cut:] for x in whole)], len(units) - cut
        if size:
            yield out(held)

    return keyed.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents are linked where their fingerprints differ in ``budget`` bits at
    most; component_id is the smallest doc_id that links lead to, its own
    included. Null texts count as empty, and all texts without a word have
    fingerprint 0 and are linked like any others. Null keys stay null and are
    never the smallest unless alone; repeated rows each return. Other columns
    are ignored; an empty table gives no rows.
    """
    found = materialise(fingerprints(docs, shingle), "fingerprints")
    fps = materialise(found.groupBy("fp", "node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(fps, budget))
    grouped = fps.join(roots, "node")
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(smallest, "root").select("node", "component_id")
    named = fps.join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return spread_join(found, named, "node", fps.select("node", "n")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Min-hashes of a signature, and how many of them make a band. A pair with a similarity of 0.8 shares
#: a band with a probability of 0.997.
SIGNATURE, BAND = 120, 6
SIMILAR = 0.8
#: Nodes of a piece and shingles in it; and nodes of a larger group that are in each of its pieces, about.
PIECE, PIECE_SHINGLES, PIVOTS = 1_000, 1_000_000, 100
_FACTORS = np.random.default_rng(9).integers(1 << 60, 1 << 63, SIGNATURE).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, shingle: int, seed: int = SEED) -> tuple[int, np.ndarray]:
    """Hash of the words in lower case, and hashes of their shingles (of the whole where there are fewer words)."""
    words = text.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, seed), np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return digest(joined, seed), np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, node (a hash of the text's words), fp (the fingerprint of its set of shingles), size (of that set) and bands of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            got = [shingle_hashes(x or b"", shingle) for x in texts]
            sets = [np.unique(x[1]) for x in got]
            fps = [majority(x) if (t or b"").strip() else 0 for x, t in zip(sets, texts, strict=True)]
            values = np.concatenate([x[1] for x in got])
            sizes = np.array([len(x[1]) for x in got])
            starts = np.cumsum(sizes) - sizes
            bands = np.zeros((len(texts), SIGNATURE // BAND), np.uint64)
            for k, factor in enumerate(_FACTORS):
                at = k // BAND
                bands[:, at] = (bands[:, at] ^ np.minimum.reduceat(values * factor, starts)) * SCATTER + np.uint64(at)
            offsets = np.arange(len(texts) + 1, dtype=np.int32)
            arrays = [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(np.array([x[0] for x in got], np.uint64).view(np.int64)),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets * bands.shape[1]), pa.array(bands.view(np.int64).ravel())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "fp", "size", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {kind}, text_key long, node long, fp long, size long, bands array<long>")


def exact_labels(sets: list[np.ndarray], groups: np.ndarray, similarity: float) -> np.ndarray:
    """Labels of sets of hashes: equal where equal groups or pairs with a Jaccard similarity of ``similarity`` connect them.

    One set after the other is compared with all that it isn't connected to,
    until the sets that weren't yet are all connected.
    """
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    labels = np.unique(groups, return_inverse=True)[1]
    values = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    marks = np.zeros(int(values.max()) + 1, bool)
    left, waits, own, at = np.arange(len(sets)), np.ones(len(sets), bool), values, starts
    while True:
        among = labels[left]
        count = np.bincount(among[waits])
        most = int(count.argmax()) if len(count) else 0
        others = np.flatnonzero(waits & (among != most))
        if not len(others):
            return labels
        place = int(others[0])
        node = int(left[place])
        mine = values[starts[node] : starts[node] + sizes[node]]
        marks[mine] = True
        shared = np.add.reduceat(marks[own], at, dtype=np.int64)
        marks[mine] = False
        near = shared >= similarity * (sizes[node] + sizes[left] - shared) - 1e-9
        hit = np.unique(among[near])
        if len(hit) > 1:
            labels[np.isin(labels, hit)] = hit[0]
        waits[place] = False
        if waits.sum() * 2 < len(left):
            left = left[waits]
            waits = np.ones(len(left), bool)
            own = np.concatenate([values[starts[k] : starts[k] + sizes[k]] for k in left]) if len(left) else values[:0]
            at = np.cumsum(sizes[left]) - sizes[left]


def exact_links(docs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links u, v between the nodes of a unit, as a forest by unit.

    ``rows`` has unit, node, group (nodes of a group are connected already),
    and doc_id and text_key of a row of ``docs`` with the node's text.
    """
    wanted = rows.select("unit", "node", "group", F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    # merged at every size: these rows grow with the input, so a broadcast would only do for small ones
    found = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
            nodes = np.array(list(held), np.int64)
            sets, groups = zip(*held.values(), strict=True)
            labels = exact_labels(list(sets), np.array(groups, np.int64), similarity)
            _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
            linked = np.flatnonzero(first[inverse] != np.arange(len(nodes)))
            return nodes[linked], nodes[first[inverse[linked]]]

        current, held = None, {}
        for batch in slices(batches, "text"):
            done = []
            columns = [batch.column(x).to_pylist() for x in ("unit", "node", "group")]
            for unit, node, group, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if unit != current:
                    if len(held) > 1:
                        done.append(out(held))
                    current, held = unit, {}
                if node not in held:  # rows may repeat
                    held[node] = (np.unique(shingle_hashes(text or b"", shingle)[1]), group)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names=["u", "v"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out(held)], names=["u", "v"])

    return found.select("unit", "node", "group", "text").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u long, v long")


def _pieces(n: Column, weight: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / PIECE), F.ceil(weight / PIECE_SHINGLES))


def _numbers(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))


def similar_roots(docs: DataFrame, found: DataFrame, shingle: int, similarity: float, linked: DataFrame) -> DataFrame:
    """node, root: equal roots for nodes that pairs with the similarity, or the links u, v that are given, connect.

    Nodes that bands connect form a group. A group of one piece is compared as
    a whole. In a larger one, pieces are compared first, with some pivots in
    each; then, of each band, all pairs that aren't connected yet: nodes
    outside the band's largest component with each other and with those in it,
    each pair of pieces by itself. So no pair that shares a band is left out.
    """
    source = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("source")
    nodes = found.groupBy("node").agg(source, F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.select("node", "source.doc_id", "source.text_key", "size", "bands"), "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    shared = materialise(dealt.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"), "bands")
    coarse = components(spread_join(dealt, shared.drop("n"), "band", shared).select(F.col("least").alias("u"), F.col("node").alias("v")))
    placed = nodes.drop("bands").join(coarse, "node")
    groups = placed.groupBy("root").agg(F.count("*").alias("n"), _pieces(F.count("*"), F.sum("size")).alias("pieces"))
    groups = materialise(groups, "groups")
    own = F.pmod(F.xxhash64("node"), F.col("pieces"))
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")) < PIVOTS
    every = F.when(pivot & (F.col("pieces") > 1), _numbers(F.col("pieces"))).otherwise(F.array(own))
    rows = placed.join(groups, "root").select("*", F.explode(every).alias("piece")).withColumn("unit", F.xxhash64("root", "piece")).withColumn("group", F.col("node"))
    edges = exact_links(docs, rows, shingle, similarity).unionByName(linked)
    large = groups.where("pieces > 1").select("root")
    if large.isEmpty():
        return components(edges)
    edges = materialise(edges, "links")
    fine = components(edges).withColumnRenamed("root", "group")
    open_ = placed.join(large, "root", "left_semi").drop("root").join(fine, "node", "left").withColumn("group", F.coalesce("group", "node"))
    open_ = materialise(open_.join(dealt, "node"), "open")
    parts = open_.groupBy("band", "group").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    top = F.max(F.struct("n", "weight", F.col("group").alias("top"))).alias("most")
    bands = parts.groupBy("band").agg(top, F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("weight").alias("weight")).where("k > 1")
    bands = bands.select(
        "band", F.col("n"), "most.top", _pieces(F.col("most.n"), F.col("most.weight")).alias("inside"), _pieces(F.col("n") - F.col("most.n"), F.col("weight") - F.col("most.weight")).alias("outside")
    )
    hashed = F.xxhash64("node", "band")
    own = F.pmod(hashed, F.col("outside"))
    among = F.transform(_numbers(F.col("outside")), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))
    across = F.transform(_numbers(F.col("inside")), lambda k: F.struct(own.alias("a"), (F.col("outside") + k).alias("b")))
    held = F.transform(_numbers(F.col("outside")), lambda k: F.struct(k.alias("a"), (F.col("outside") + F.pmod(hashed, F.col("inside"))).alias("b")))
    pair = F.explode(F.when(F.col("group") == F.col("top"), held).otherwise(F.concat(among, across))).alias("pair")
    bands = materialise(bands, "bands")
    rest = spread_join(open_, bands.drop("n"), "band", bands).select("*", pair).withColumn("unit", F.xxhash64("band", "pair.a", "pair.b"))
    return components(edges.unionByName(exact_links(docs, rest, shingle, similarity)))


def fingerprint_links(counted: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links u, v that connect the nodes (with ``node`` and ``fp``) whose fingerprints the trie self-join connects.

    All nodes of a component of fingerprints are linked to its least one.
    """
    number = lambda fp: pa.array((fp.to_numpy().view(np.uint64) * SCATTER).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("fp"), number(batch.column("fp")), *map(batch.column, ("least", "n"))], names=["fp", "number", "least", "n"])

    shared = counted.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    fps = materialise(shared.mapInArrow(run, "fp long, number long, least long, n long"), "fingerprints")
    roots = components(links(fps, budget)).withColumnRenamed("node", "number")
    joined = fps.join(roots, "number")
    least = joined.groupBy("root").agg(F.min("least").alias("u"))
    across = joined.join(least, "root").select("u", F.col("least").alias("v"))
    several = fps.where("n > 1")
    within = spread_join(counted.select("fp", "node"), several.select("fp", "least"), "fp", fps.select("fp", "n"))
    return materialise(across.unionByName(within.select(F.col("least").alias("u"), F.col("node").alias("v"))).where("u <> v"), "links")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """doc_id, component_id, text_key and root: near-duplicates by fingerprints, and by the similarity of word shingles.

    Fingerprints link as in near_duplicates. They are those of the sets of
    shingles, so that what one text repeats doesn't make it a copy of another.
    But those of pairs with a similarity of 0.8 differ in up to 16 bits, too
    many to find by equal blocks. So pairs that share a band of a min-hash
    signature link too if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more. Texts with equal words in lower case are one node.
    Nulls, repeats and empty tables are treated as in near_duplicates.
    """
    found = materialise(signatures(docs, shingle), "signatures")
    counted = materialise(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp")), "distinct")
    roots = similar_roots(docs, found, shingle, similarity, fingerprint_links(counted))
    firsts = counted.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.select("node", "root").join(smallest, "root")
    return spread_join(found.select("doc_id", "text_key", "node"), named, "node", counted).select("doc_id", "component_id", "text_key", "root")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """Documents with one of each group of near-duplicates (see similar_groups): that with the smallest doc_id.

    Rows without a doc_id come after those with one. Of rows that repeat a
    doc_id the one whose text has the smaller hash comes first, and of rows
    that are equal in both one stays. Null texts count as empty, and texts
    without a word are copies of each other. Columns may have any names and
    return as they were; an empty table gives no rows.
    """
    every = similar_groups(docs, shingle, similarity).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("first")
    chosen = materialise(every.groupBy("root").agg(first).select(F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_text"), "first.n"), "chosen")
    rows = whole_rows(docs).withColumn("text_key", F.xxhash64("row.text"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_text")))
    once = kept.where("n = 1").select("row.*")
    if chosen.where("n > 1").isEmpty():  # the texts are joined once more only for rows that repeat
        return once
    twice = kept.where("n > 1").groupBy("id", "text_key").agg(F.first("row").alias("row"))
    return once.unionByName(twice.select("row.*"))
