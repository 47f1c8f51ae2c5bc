"""Near-duplicates by b-bit MinHash.

A document's distinct shingles give PERMS minima.  Bands of ROWS minima are
hashed to bucket keys; of every minimum the low BITS are packed into a
signature.  Equal sets are one node.  Nodes that share a bucket are compared by
bit counts of their signatures, with the chance agreement of unequal minima
taken out, and what may be linked is confirmed on the full sets.

No bucket's pairs are listed.  Members of a large bucket are dealt to blocks, anew in
every round, and compared within their block only, so that a round has a row a
member.  In the first round a block gives a spanning forest of its pairs by the highest
estimates, in later ones the best pair that is not refuted of each node outside its
largest component; each node confirms the best it was given.  Then all members outside
their bucket's largest component, the open ones, are compared with all other members of the
bucket, block by block, and where an estimate allows a link, with their full sets.  So
the components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import U64, chunks, ids_and_texts, mixed, shingle_sets, stored

PERMS, BANDS, ROWS, BITS = 128, 32, 4, 4
#: Pairs at the threshold whose estimate falls by as much are five standard deviations off.
MARGIN = 0.18
#: Members of a bucket that one task compares with each other.
BLOCK = 1024
#: Rounds of few pairs, before open members are compared with their whole buckets.
ROUNDS = 2
#: Members, and open members, of a bucket whose full sets one task holds then.
EXACT_BLOCK = 256
#: Edges that a task contracts; a graph has so many tasks.
EDGES = 1 << 20

_SEED = mixed(np.arange(1, 2 * PERMS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FACTOR, _SHIFT = _SEED[:PERMS] | U64(1), _SEED[PERMS:]
_NIBBLES = U64(0x1111111111111111)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PERMS): the least value of each set, none of which is empty, under each permutation."""
    every = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((PERMS, len(sets)), U64)
    for p in range(PERMS):
        out[p] = np.minimum.reduceat(every * _FACTOR[p] + _SHIFT[p], begin)
    return out.T


def packed(least: np.ndarray) -> np.ndarray:
    """(sets, PERMS * BITS / 64): the low bits of the spread minima."""
    low = (mixed(least) & U64((1 << BITS) - 1)).reshape(len(least), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=U64) * U64(BITS)), axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(len(least), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        key = mixed(key ^ rows[:, :, r])
    return key.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal low bits, of which 1 / 2**BITS agree by chance."""
    x = a ^ b
    x = (x | x >> U64(1) | x >> U64(2) | x >> U64(3)) & _NIBBLES
    same = 1 - np.bitwise_count(x).sum(-1) / PERMS
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def node_of(hashes: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, text, and any further columns, kept.  Instead of text: n_shingles, node, sig, bands; the last three are null for a text without words."""
    keep = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), words)
                full = [k for k, x in enumerate(sets) if len(x)]
                nodes, sigs, bands = ([None] * len(sets) for _ in range(3))
                if full:
                    least = minima([sets[k] for k in full])
                    for k, s, b in zip(full, packed(least), band_keys(least)):
                        nodes[k], sigs[k], bands[k] = node_of(sets[k]), s.tobytes(), b
                made = [pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, "n_shingles", "node", "sig", "bands"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(run, kept + "n_shingles long, node binary, sig binary, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [x for x in shingle_sets(part.column("text"), words) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node binary, shingles binary")


# --- pairs within buckets -------------------------------------------------


def _forest(sigs: np.ndarray, comp: np.ndarray, floor: float, refuted: dict[int, list[int]]) -> list[tuple[int, int, float]]:
    """(child, parent, estimate) of a spanning forest by highest estimates; members of one component hang together at no cost."""
    n = len(sigs)
    best, parent, todo = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    out = []
    for _ in range(n):
        k = int(np.argmax(np.where(todo, best, -2.0)))
        todo[k] = False
        if parent[k] >= 0 and comp[k] != comp[parent[k]]:
            out.append((k, int(parent[k]), float(best[k])))
        near = estimates(sigs, sigs[k])
        near[near < floor] = -1
        near[refuted.get(k, [])] = -1
        near[comp == comp[k]] = 2
        better = todo & (near > best)
        best[better], parent[better] = near[better], k
    return out


def _nearest(sigs: np.ndarray, comp: np.ndarray, floor: float, refuted: dict[int, list[int]]) -> list[tuple[int, int, float]]:
    """The best pair of each member outside the largest component; every pair between components has such a member."""
    out = []
    for k in np.flatnonzero(comp != np.bincount(comp).argmax()).tolist():
        near = estimates(sigs, sigs[k])
        near[comp == comp[k]] = -1
        near[refuted.get(k, [])] = -1
        if near[best := int(np.argmax(near))] >= floor:
            out.append((k, best, float(near[best])))
    return out


def _open(sigs: np.ndarray, comp: np.ndarray, floor: float, refuted: dict[int, list[int]], asked: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(member, member, 1) of those that _nearest() has a pair for, and (member, member, 0) of all others in such pairs; asked: instead of those outside the largest component."""
    open_, others = np.zeros(len(sigs), bool), np.zeros(len(sigs), bool)
    for k in np.flatnonzero(comp != np.bincount(comp).argmax() if asked is None else asked).tolist():
        may = (estimates(sigs, sigs[k]) >= floor) & (comp != comp[k])
        may[refuted.get(k, [])] = False
        open_[k] = may.any()
        others |= may
    return [(k, k, float(open_[k])) for k in np.flatnonzero(open_ | others).tolist()]


def bucket_pairs(members: DataFrame, floor: float, work, by: tuple[str, ...] = ("key", "block")) -> DataFrame:
    """members: key, the other columns in by, node, comp, sig, refuted (nodes), and if by has more than a block, asked; work: what to find in a group.

    Returns child, parent, estimate, key.
    """

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        nodes, comps = table["node"].to_pylist(), table["comp"].to_pylist()
        where = np.column_stack([table[c].to_numpy() for c in by])
        cut = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
        bounds = [0, *cut.tolist(), n]
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), U64).reshape(n, -1)
        refuted = table["refuted"]
        lists = refuted.to_pylist() if refuted.null_count < n else [None] * n
        asked = table["asked"].to_numpy() if "asked" in table.column_names else None
        number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        found = []
        begin, size = np.array(bounds[:-1]), np.diff(bounds)
        two = begin[size == 2] if asked is None else begin[:0]  # most groups; done at once
        if len(two):
            near = estimates(sigs[two], sigs[two + 1])
            ok = (near >= floor) & (comp[two] != comp[two + 1])
            for a, e in zip(two[ok].tolist(), near[ok].tolist()):
                if nodes[a] not in (lists[a + 1] or ()) and nodes[a + 1] not in (lists[a] or ()):
                    found += [(a + 1, a + 1, 1.0), (a, a, 0.0)] if work is _open else [(a + 1, a, e)]
        many = size > (1 if asked is not None else 2)
        for a, b in zip(begin[many].tolist(), (begin + size)[many].tolist()):
            if (comp[a:b] == comp[a]).all():
                continue
            bad: dict[int, list[int]] = {}
            if any(lists[a:b]):
                at = {x: k for k, x in enumerate(nodes[a:b])}
                for k, xs in enumerate(lists[a:b]):
                    for x in xs or ():
                        if (o := at.get(x)) is not None:
                            bad.setdefault(k, []).append(o)
                            bad.setdefault(o, []).append(k)
            more = () if asked is None else (asked[a:b],)
            found += [(a + x, a + y, e) for x, y, e in work(sigs[a:b], comp[a:b], floor, bad, *more)]
        if found:
            x, y, e = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.binary()), pa.array([nodes[k] for k in y], pa.binary()), pa.array(e, pa.float64()), pa.array(where[list(x), 0])], ["child", "parent", "estimate", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if not table.num_rows:
                continue
            last = np.ones(table.num_rows, bool)
            for c in by:
                x = table[c].to_numpy()
                last &= x == x[-1]
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if first:
                yield from pairs(table.slice(0, first).combine_chunks())
            held = table.slice(first)
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())

    ordered = members.repartition(*by).sortWithinPartitions(*by, "node")
    return ordered.mapInArrow(run, "child binary, parent binary, estimate double, key long")


def _dealt(node: str, salt: str, parts: Column | str) -> Column:
    """One of so many blocks, by the node's hash."""
    return F.pmod(F.xxhash64(node, F.lit(salt)), F.col(parts) if isinstance(parts, str) else parts).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def open_across(large: DataFrame, floor: float) -> DataFrame:
    """What _open() says of buckets with more than BLOCK members, as bucket_pairs() returns it.

    large: key, n, node, comp, sig, refuted.  The members outside the bucket's largest
    component are dealt to blocks, as are all members; a task has a block of either.
    Where the rounds have left few open members, that is about a row a member.
    """
    top = large.groupBy("key", "comp").agg(F.count("*").alias("size"), F.max("n").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("top"), (F.max("n") - F.max("size")).alias("m"), F.max("n").alias("n"))
    top = stored(top.where("m > 0").select("key", "top", F.ceil(F.col("m") / BLOCK).cast("int").alias("ms"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ns")), "largest")
    both = large.drop("n").join(top, "key")
    columns = ["node", "comp", "sig", "refuted"]
    all_ = both.select("key", _dealt("node", "all", "ns").alias("i"), _each("ms").alias("j"), *columns, F.lit(False).alias("asked"))
    open_ = both.where("comp != top").select("key", _each("ns").alias("i"), _dealt("node", "open", "ms").alias("j"), *columns, F.lit(True).alias("asked"))
    return bucket_pairs(all_.unionByName(open_), floor, _open, ("key", "i", "j"))


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """child, parent, linked: whether 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = (np.frombuffer(x.as_buffer(), U64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("child"), batch.column("parent"), pa.array(linked, pa.bool_())], ["child", "parent", "linked"])

    one = edges.select("child", "parent").join(sets.select(F.col("node").alias("child"), F.col("shingles").alias("a")), "child")
    both = one.join(sets.select(F.col("node").alias("parent"), F.col("shingles").alias("b")), "parent")
    return both.select("child", "parent", "a", "b").mapInArrow(run, "child binary, parent binary, linked boolean")


def exact_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """child, parent: for each open member of a bucket one link to each other component among the rest, from full sets.

    members: key, node, comp, open.  A task has EXACT_BLOCK members of a bucket and as
    many open ones, with their sets; pairs are counted, not listed.
    """
    sizes = stored(members.groupBy("key").agg(F.ceil(F.count("*") / EXACT_BLOCK).cast("int").alias("n"), F.ceil(F.sum(F.col("open").cast("int")) / EXACT_BLOCK).cast("int").alias("m")), "sizes")
    both = members.join(sizes, "key")
    one = both.select("key", _dealt("node", "all", "n").alias("i"), _each("m").alias("j"), F.lit(0).alias("role"), "node", "comp")
    two = both.where("open").select("key", _each("n").alias("i"), _dealt("node", "open", "m").alias("j"), F.lit(1).alias("role"), "node", "comp")
    rows = one.unionByName(two).join(sets, "node")

    def links(group: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        own = [r for r in group if not r[0]]
        if not own or len(own) == len(group):
            return
        size = np.array([len(r[3]) for r in own])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        joined = np.concatenate([r[3] for r in own])
        for _, node, comp, mine in (r for r in group if r[0]):
            at = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
            both = np.add.reduceat((mine[at] == joined).astype(np.int64), begin)
            linked = np.flatnonzero(100 * both >= percent * (size + len(mine) - both))
            yield from {own[k][2]: (node, own[k][1]) for k in linked.tolist() if own[k][2] != comp}.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if found := [*links(held)]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["child", "parent"])

        for batch in batches:
            where = [*zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")))]
            values = zip(where, batch.column("role").to_pylist(), batch.column("node").to_pylist(), batch.column("comp").to_pylist(), batch.column("shingles"))
            for at, role, node, comp, x in values:
                if at != key:
                    yield from done()
                    held, key = [], at
                held.append((role, node, comp, np.frombuffer(x.as_py(), U64)))
        yield from done()

    ordered = rows.select("key", "i", "j", "role", "node", "comp", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "node")
    return ordered.mapInArrow(run, "child binary, parent binary")


# --- components -----------------------------------------------------------


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least of its component, given edges (a, b): roots hook on lower ones, then paths shrink."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def contracted(edges: DataFrame) -> DataFrame:
    """a, b: each partition's edges as stars; b is the least node of a's component among the partition's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (found := [*batches]):
            return
        table = pa.Table.from_batches(found)
        ends = pa.chunked_array(table["a"].chunks + table["b"].chunks, pa.binary()).combine_chunks().dictionary_encode()
        names = ends.dictionary
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        root = _roots(at[: table.num_rows], at[table.num_rows :], len(order))
        leaf = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(order[leaf])), names.take(pa.array(order[root[leaf]]))], ["a", "b"])

    return edges.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """node, comp: the least node of the connected component, for all nodes of edges (a, b).

    Each task contracts about per_task edges to stars.  What several tasks found is joined
    by alternating large and small stars, until a round changes nothing: every round is two
    joins on nodes with their least neighbours, which has a row for each node, so that a
    hub's many edges can be split.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(edges.where("a != b").select("a", "b"), "edges")
    tasks = -(-edges.count() // per_task) or 1
    now = stored(contracted(edges.repartition(tasks)), "stars")
    before, changed = None, tasks > 1  # one task sees all edges: nothing is left to join
    while changed:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        now = stored(linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "stars")
        after = state(now)
        before, changed = after, after != before
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text and what else is to be kept.  Rows with n_shingles and node, and of each node the least doc_id and comp, the component."""
    sigs = stored(signatures(docs, words), "signatures")
    own = sigs.where("node is not null")
    nodes = stored(own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")  # stored, so that the join can split a large bucket
    member = keys.join(shared, "key").select("key", "n", "node")
    members = stored(member.join(nodes.select("node", "sig"), "node"), "members")
    large = members.where(F.col("n") > BLOCK)
    some_large = not large.isEmpty()
    comps = stored(members.select("node").distinct().withColumn("comp", F.col("node")), "comps")
    floor = percent / 100 - MARGIN
    sets = refuted = None

    def with_comps(rows: DataFrame) -> DataFrame:
        now = rows.join(comps, "node")
        if refuted is None:
            return now.withColumn("refuted", F.lit(None).cast("array<binary>"))
        return now.join(refuted.groupBy("child").agg(F.collect_set("parent").alias("refuted")).withColumnRenamed("child", "node"), "node", "left")

    def after(links: DataFrame) -> DataFrame:
        """The components once these links are joined."""
        named = lambda side, to: comps.select(F.col("node").alias(side), F.col("comp").alias(to))
        joined = links.join(named("child", "a"), "child").join(named("parent", "b"), "parent").select("a", "b").where("a != b").distinct()
        merged = components(joined).withColumnRenamed("comp", "into").withColumnRenamed("node", "comp")
        return stored(comps.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "comps")

    def sets_of(ends: DataFrame) -> DataFrame:
        wanted = nodes.join(ends, "node", "left_semi").select("doc_id").distinct()
        texts = docs.select("doc_id", "text")
        found = texts.join(wanted, "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
        return stored(full_sets(found, words).join(ends, "node", "left_semi").dropDuplicates(["node"]), "sets")

    for turn in range(ROUNDS):
        dealt = with_comps(members).withColumn("block", _dealt("node", f"round {turn}", F.ceil(F.col("n") / BLOCK)))
        found = bucket_pairs(dealt.select("key", "block", "node", "comp", "sig", "refuted"), floor, _nearest if turn else _forest)
        if turn == 0:  # whoever has a pair within its block has one here
            found = stored(found, "forests")
            ends = found.select(F.col("child").alias("node")).union(found.select("parent")).union(large.select("node")).distinct()
        edges = stored(found.groupBy("child").agg(F.max_by("parent", F.struct("estimate", "parent")).alias("parent")), "pairs")  # each node's best
        if edges.isEmpty():
            break
        sets = sets if sets is not None else sets_of(ends)
        judged = stored(confirmed(edges, sets, percent), "judged")
        wrong = judged.where("not linked").select("child", "parent")
        refuted = wrong if refuted is None else refuted.unionByName(wrong)
        comps = after(judged.where("linked"))
    left = with_comps(members.where(F.col("n") <= BLOCK)).select("key", F.lit(0).alias("block"), "node", "comp", "sig", "refuted")
    opened = bucket_pairs(left, floor, _open)
    if some_large:
        opened = opened.unionByName(open_across(with_comps(large), floor))
    opened = stored(opened.groupBy("key", F.col("child").alias("node")).agg((F.max("estimate") > 0).alias("open")), "open")
    if not opened.isEmpty():
        sets = sets if sets is not None else sets_of(ends)
        comps = after(stored(exact_links(opened.join(comps, "node"), sets, percent), "links"))
    of_node = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return sigs.drop("sig", "bands"), stored(of_node, "classes")  # stored, so that joins with large classes can be split


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row in, of its whole text, however long.

    Words are lower-cased in A-Z.  A document's set is its distinct shingles of so
    many words; a shorter text's whole sequence is one shingle.  Documents are linked
    if 100 * intersection >= percent * union.  component_id is the least doc_id that
    links reach, kept whether it is the row's own.  A text without words (null, empty,
    white space) has n_shingles 0 and is linked with nothing.  Rows that share a doc_id
    are compared like others.  A row whose doc_id is null is kept unless another is in its
    component.  An empty table gives an empty one; other columns are not read.
    """
    rows, of_node = _classes(ids_and_texts(docs, id_col, text_col), words, percent)
    lowest = stored(of_node.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "lowest")
    found = rows.join(of_node.join(lowest, "comp").select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with docs' columns: of the rows with the least doc_id (null is greatest) one.

    Rows are told apart by id and text, so rows that share a doc_id are judged each for
    itself, and of rows equal in both one stays, whatever their other columns hold.  Rows
    whose text has no words are linked with nothing and all stay, unless equal in both.
    """
    one, two = F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), one.alias("one"), two.alias("two"))
    rows, of_node = _classes(named, words, percent)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), "one", "two")
    classed = rows.where("node is not null").join(of_node.select("node", "comp"), "node").groupBy("comp").agg(F.min(place).alias("least"))
    kept = classed.select("least.one", "least.two").unionByName(rows.where("node is null").select("one", "two")).distinct()
    kept = kept.select(F.col("one").alias("__one"), F.col("two").alias("__two"))
    wide = docs.withColumns({"__one": one, "__two": two}).join(kept, ["__one", "__two"], "left_semi")
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    first = F.row_number().over(Window.partitionBy("__one", "__two").orderBy(F.xxhash64(*plain)))
    return wide.withColumn("__row", first).where("__row = 1").select(*docs.columns)
