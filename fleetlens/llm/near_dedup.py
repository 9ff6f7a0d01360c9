"""Near duplicates by SetSketch registers, confirmed on the full shingle sets.

A document's set holds the distinct runs of ``WIDTH`` words (all words as one
run if there are fewer). Every element spreads points of a Poisson process over
``REGISTERS`` registers; a register keeps the smallest point, on the scale
``1 - log_b`` cut to 16 bits. Registers of a union are the register-wise maxima
(``merge``), and two registers agree with about the Jaccard similarity.

* Documents with equal sets are one node from then on.
* ``BANDS`` bands of ``ROWS`` registers name buckets. A pair at a threshold of
  0.8 shares no bucket with probability (1 - 0.8**5)**48 = 5e-9, at 0.85 with 6e-13.
* Inside a bucket, two bits of every register decide which members can be
  near: pairs six standard errors below the threshold can't. A bucket sends a
  spanning forest of what remains, at most one edge a member; the forests'
  components are clusters, and every link lies inside one.
* Each clustered node's full set travels once, to its cluster. A search goes
  from member to member: similarities are estimated from all registers by joint
  maximum likelihood (set sizes are known), those that can reach the threshold
  are counted exactly on the full sets, and linked members are not asked again.

Pairs are no rows there. Equal sets are reduced by partial aggregation. A bucket of
more than ``HOT`` members makes one cluster without a search. A cluster of more than
``LARGE`` nodes or ``LARGE_BYTES`` of shingles is not worked by one task but by joins, in
rounds: linked sets share one of the rarest shingles of each (as many as the threshold lets
them differ by, and one), so these name buckets; the next leaders of a bucket (1, then 2, 4,
8, ...) are compared with the members that are still in another component. What many
variants of a text share is frequent and names no bucket, so variants that aren't linked
rarely meet, and no pair is compared twice. Both ways give the same components (tests set the
limits to 3). Nothing is collected; stages are written tables.

Defined results: documents without words (null and empty texts too) are linked with nothing
and kept. Rows are judged one by one, also rows that share an id: ``component_id`` is the
smallest id that a row reaches, and it is kept if that is its own. Rows without an id
stand after all ids; of a component of such rows alone, whose ``component_id`` is null, one
row is kept. Nodes are named by 64 bits of their set's 128-bit digest; if two different digests of
the input share a name, all are named anew. Shingles are 64-bit hashes. Texts of any length are taken
whole. Other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .text import LOWER, U64, mix, short_batches, steps, text_bytes, window_hashes, word_hashes

WIDTH = 5
THRESHOLD = 85
ROWS = 5
BANDS = 48
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base of the scale, rate, largest value.
B, RATE, TOP = 1.001, 20.0, 65535
#: Points drawn for all active elements at once.
POINTS = 1 << 18
NO_ID = (1 << 63) - 1
#: Largest bucket that is searched, largest cluster that one task holds.
HOT, LARGE, LARGE_BYTES = 20_000, 20_000, 256 << 20
#: Bytes of a written table up to which it is broadcast, so that the other side doesn't move.
SMALL = 64 << 20
#: Equal two-bit fields of two bytes, by their exclusive or.
FIELDS = np.array([sum(x >> i & 3 == 0 for i in (0, 2, 4, 6)) for x in range(256)], np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of lower-cased bytes."""
    hashes, _, _, at = word_hashes(data, offsets)
    runs, _, run_at = window_hashes(hashes, at, width)
    out = []
    for i in range(len(offsets) - 1):
        if run_at[i + 1] > run_at[i]:
            s = np.sort(runs[run_at[i]: run_at[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif at[i + 1] > at[i]:
            own = hashes[at[i]: at[i + 1]]
            out.append(window_hashes(own, np.array([0, len(own)]), len(own))[0])
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set, one row a set (0 everywhere for an empty one)."""
    n = len(sets)
    least = np.full(n * m, np.inf)
    e = np.concatenate(sets) if n else np.zeros(0, U64)
    d = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.zeros(len(e))
    level = 0
    while len(e):
        width = int(min(256, max(1, POINTS // len(e))))
        step = (np.arange(level + 1, level + width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))[None, :]
        level += width
        for first in range(0, len(e), POINTS):  # bounded memory for a very large set
            part = slice(first, first + POINTS)
            r = mix(e[part, None] + step)
            gap = -np.log(((r >> U64(20)).astype(float) + 0.5) * 2.0**-44) / (RATE * m)
            points = x[part, None] + np.cumsum(gap, axis=1)
            np.minimum.at(least, (d[part, None] * m + (r % U64(m)).astype(np.int64)).ravel(), points.ravel())
            x[part] = points[:, -1]
        active = x < least.reshape(n, m).max(1)[d]
        e, d, x = e[active], d[active], x[active]
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(B))
    return np.clip(np.where(np.isinf(least), 0, k), 0, TOP).astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def codes(regs: np.ndarray) -> np.ndarray:
    """Two bits of each register, four registers a byte."""
    two = (mix(regs.astype(U64)) & U64(3)).astype(np.uint8).reshape(len(regs), -1, 4)
    return two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6


def least_equal(threshold: int) -> float:
    """Equal two-bit fields that a linked pair has but for six standard errors."""
    a = threshold / 100 + (1 - threshold / 100) / 4
    return REGISTERS * (a - 6 * np.sqrt(a * (1 - a) / REGISTERS))


def least_estimate(threshold: int) -> float:
    t = threshold / 100
    return t - 6 * np.sqrt(t * (1 - t) / REGISTERS)


def joint_estimate(ra, rb, na, nb, grid: int = 41) -> np.ndarray:
    """Jaccard similarity of each pair: the maximum of the registers' joint likelihood on a grid."""
    m = ra.shape[1]
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    u = na / (na + nb)
    v = 1.0 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda q: np.maximum(-np.log1p(-np.maximum(q, 0) * (B - 1) / B) / np.log(B), 1e-12)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (m - more - less)[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), like.argmax(1)]


def _node(own: np.ndarray) -> tuple[int, int]:
    """(name, check) of a set: the halves of its digest."""
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets_of(batch_col, width):
    data, offsets = text_bytes(batch_col)
    for lo, hi in steps(offsets):
        yield shingle_sets(LOWER[data[offsets[lo]: offsets[hi]]], offsets[lo: hi + 1] - offsets[lo], width)


SKETCH = "row bigint, id bigint, digest binary, node bigint, check bigint, n bigint, regs binary"


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``SKETCH`` of (id, digest, text): row numbers the rows of a run, node and check name the set, n is its size."""

    def run(batches):
        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            nodes, sizes, regs = [], [], []
            for sets in _sets_of(batch.column(2), width):
                nodes += [_node(s) for s in sets]
                sizes += [len(s) for s in sets]
                regs += [x.tobytes() for x in registers(sets)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(made, made + len(nodes))), batch.column(0), batch.column(1), pa.array([x for x, _ in nodes], pa.int64()),
                 pa.array([x for _, x in nodes], pa.int64()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())],
                names=["row", "id", "digest", "node", "check", "n", "regs"])
            made += len(nodes)

    return docs.mapInArrow(run, SKETCH)


def _registers_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(node, n, key) of (node, n, regs): the buckets of each node."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                folded = _registers_of(part.column(2)).reshape(part.num_rows, BANDS, ROWS).astype(U64)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (part.num_rows, BANDS))
                for i in range(ROWS):
                    h = mix(h * U64(0x9E3779B97F4A7C15) + folded[:, :, i])
                node, n = (np.repeat(part.column(i).to_numpy(), BANDS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(h.ravel().view(np.int64))], names=["node", "n", "key"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "node bigint, n bigint, key bigint")


def node_codes(nodes: DataFrame) -> DataFrame:
    """(node, code) of (node, regs)."""

    def run(batches):
        for batch in batches:
            code = [x.tobytes() for x in codes(_registers_of(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary())], names=["node", "code"])

    return nodes.select("node", "regs").mapInArrow(run, "node bigint, code binary")


def _full_sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text), where the text's set is the node's; once a task."""

    def run(batches):
        done = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            first = [i for i, x in enumerate(nodes) if x not in done and not done.add(x)]
            batch = batch.take(pa.array(first, pa.int64()))
            sets = [s.tobytes() for part in _sets_of(batch.column(1), width) for s in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(run, "node bigint, shingles binary")


def _plausible(threshold: int):
    cut = least_estimate(threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            keep = pa.array(joint_estimate(ra, rb, na, nb) >= cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _confirmed(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                s, t = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links among pairs (a, b)."""

    def sides(rows, table, *cols):
        for side in ("a", "b"):
            rows = rows.join(table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols)), side)
        return rows.select("a", "b", *(f"{c}_{side}" for c in cols for side in ("a", "b")))

    near = sides(pairs, nodes, "n", "regs").mapInArrow(_plausible(threshold), "a bigint, b bigint")
    return sides(near, sets, "shingles").mapInArrow(_confirmed(threshold), "a bigint, b bigint")


def _hop(comp: DataFrame, links: DataFrame) -> DataFrame:
    """One merge of components (node, comp) along links (a, b): every component takes the
    smallest label beside it, then the label of that label."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a") \
                .join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
    step = ends.select(F.greatest("ca", "cb").alias("from"), F.least("ca", "cb").alias("to")).groupBy("from").agg(F.min("to").alias("to"))
    twice = step.alias("s").join(step.select(F.col("from").alias("to"), F.col("to").alias("next")), "to", "left") \
                .select("from", F.coalesce("next", "to").alias("to"))
    return comp.join(twice, comp["comp"] == twice["from"], "left").select("node", F.coalesce("to", "comp").alias("comp"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node of each component, over links (a, b)."""
    comp = nodes.select("node", F.col("node").alias("comp"))
    while True:
        comp = stored(_hop(comp, links))
        left = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a") \
                    .join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb")
        if left.isEmpty():
            return comp


def _runs(stream, key: str):
    """Tables of whole groups from batches sorted by ``key``."""
    held = None
    for batch in stream:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        first = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if first:
            yield table.slice(0, first)
        held = table.slice(first)
    if held is not None and held.num_rows:
        yield held


def _search(m: int, near):
    """Edges (from, to) of a search over m members; near(x, others) -> the others beside x."""
    rest, edges = np.arange(m), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            hit = near(x, rest)
            edges += [(x, int(y)) for y in rest[hit]]
            todo += rest[hit].tolist()
            rest = rest[~hit]
    return edges


def _forests(threshold: int):
    """Buckets (key, node, n, code), sorted by key -> edges (a, b)."""
    cut = least_equal(threshold)

    def run(stream):
        for table in _runs(stream, "key"):
            keys, nodes, n = (table.column(c).to_numpy() for c in ("key", "node", "n"))
            code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(keys), -1)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))

            def like(x, others):
                small, large = np.minimum(n[x], n[others]), np.maximum(n[x], n[others])
                return (FIELDS[code[x] ^ code[others]].sum(-1) >= cut) & (100 * small >= threshold * large)

            two = starts[sizes == 2]
            two = two[like(two, two + 1)] if len(two) else two
            edges = [(two, two + 1)] if len(two) else []
            for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                got = _search(m, lambda x, others: like(s + x, s + others))
                if got:
                    edges.append(tuple(np.array(got).T + s))
            if edges:
                a, b = (nodes[np.concatenate(x)] for x in zip(*edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def cluster_components(n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """Index of the first member of each member's component, over exact links."""
    m = len(n)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    holders = owner[np.argsort(word, kind="stable")]  # of each shingle in turn
    begin = np.concatenate([[0], np.cumsum(np.bincount(word))])
    cut = least_estimate(threshold)

    def near(x, others):
        like = np.zeros(len(others), bool)
        fit = 100 * np.minimum(n[x], n[others]) >= threshold * np.maximum(n[x], n[others])
        some = np.flatnonzero(fit)
        if not len(some):
            return like
        y = others[some]
        likely = joint_estimate(np.broadcast_to(regs[x], (len(y), regs.shape[1])), regs[y], np.full(len(y), float(n[x])), n[y].astype(float)) >= cut
        some = some[likely]
        if not len(some):
            return like
        mine = word[at[x]: at[x + 1]]
        size = begin[mine + 1] - begin[mine]
        place = np.arange(size.sum()) + np.repeat(begin[mine] - (np.cumsum(size) - size), size)
        both = np.bincount(holders[place], minlength=m)[others[some]]
        like[some] = 100 * both >= threshold * (n[x] + n[others[some]] - both)
        return like

    label = np.arange(m)
    for x, y in _search(m, near):  # an edge leads away from the first member found
        label[y] = label[x]
    return label


def _clusters(threshold: int):
    """Clusters (cluster, node, n, regs, shingles), sorted by cluster -> (node, comp)."""

    def run(stream):
        for table in _runs(stream, "cluster"):
            cluster, nodes, n = (table.column(c).to_numpy() for c in ("cluster", "node", "n"))
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(len(n), -1)
            sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
            starts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
            comp = np.empty(len(n), np.int64)
            for s, e in zip(starts, np.append(starts[1:], len(n))):
                comp[s:e] = nodes[s + cluster_components(n[s:e], regs[s:e], sets[s:e], threshold)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], names=["node", "comp"])

    return run


def _small(written: DataFrame, row_bytes: int) -> DataFrame:
    """The written table, broadcast in joins if its rows of so many bytes are ``SMALL``."""
    return F.broadcast(written) if written.count() * row_bytes <= SMALL else written


def _members(exploded: DataFrame) -> DataFrame:
    """(key, node, n, size, least) of the buckets that hold several nodes; those of the same members count once."""
    shared = exploded.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("all"),
                                         F.min("node").alias("least")).where("size > 1")
    shared = stored(shared.groupBy("size", "all", "least").agg(F.min("key").alias("key")))
    return stored(exploded.join(_small(shared.select("key", "size", "least"), 32), "key"))


def rarest(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, n, key): of each set (node, shingles) the rarest shingles, so many that two linked sets share one.

    Linked sets share at least threshold % of either, so one of any (n - that + 1) of each
    in an order that is the same for all."""

    def explode(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int64)),
                                              pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], names=["node", "n", "key"])

    words = sets.mapInArrow(explode, "node bigint, n bigint, key bigint")
    often = words.groupBy("key").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "key"))
    ranked = words.join(often, "key").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) / 100) + 1).where("often > 1").select("node", "n", "key")


def _in_rounds(comp: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, comp) of large clusters: comp (node), nodes (node, n, regs), sets (node, shingles)."""
    own = sets.join(comp.select("node"), "node", "left_semi")
    members = _members(rarest(own, threshold)).select("key", "node", "n")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("node")) - 1
    members = stored(members.withColumn("rank", rank))
    comp = stored(comp.select("node", F.col("node").alias("comp")))
    links = tried = None
    first, last = 0, 1
    while True:
        now = members.join(comp, "node")
        open_keys = now.groupBy("key").agg(F.max("rank").alias("top"), F.min("comp").alias("low"), F.max("comp").alias("high")) \
                       .where(F.col("top") > first).where("low <> high").select("key")
        members = stored(members.join(open_keys, "key", "left_semi"))
        if members.isEmpty():
            return comp if links is None else components(comp, links)
        now = members.join(comp, "node")
        lead = now.where((F.col("rank") >= first) & (F.col("rank") < last)).select("key", *(F.col(c).alias(f"{c}_l") for c in ("node", "n", "rank", "comp")))
        smaller, larger = F.least("n", "n_l"), F.greatest("n", "n_l")
        pairs = now.join(lead, "key").where((F.col("rank") > F.col("rank_l")) & (F.col("comp") != F.col("comp_l"))
                                            & (100 * smaller >= threshold * larger))
        pairs = pairs.select(F.least("node", "node_l").alias("a"), F.greatest("node", "node_l").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_verify(pairs, nodes, sets, threshold))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comp = stored(_hop(_hop(comp, found), found))
        first, last = last, 2 * last


def link_components(nodes: DataFrame, sets_of, threshold: int = THRESHOLD, hot: int = HOT, large: int = LARGE,
                    large_bytes: int = LARGE_BYTES) -> DataFrame:
    """(node, comp) of the nodes that may have links; the others are alone.

    nodes: (node, n, regs); sets_of(node rows) -> (node, shingles)."""
    members = _members(band_keys(nodes))
    searched = members.where(F.col("size") <= hot).join(node_codes(nodes), "node").select("key", "node", "n", "code")
    edges = searched.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(threshold), "a bigint, b bigint")
    stars = members.where((F.col("size") > hot) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = stored(edges.unionByName(stars).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    clustered = stored(components(ends, edges).join(nodes.select("node", "n"), "node"))
    sizes = clustered.groupBy("comp").agg(((F.count("*") > large) | (F.sum("n") * 8 > large_bytes)).alias("large"))
    clustered = stored(clustered.join(sizes, "comp").select("node", F.col("comp").alias("cluster"), "large"))
    sets = stored(sets_of(clustered.select("node")))
    known = nodes.select("node", "n", "regs")
    small = clustered.where(~F.col("large")).select("node", "cluster").join(known, "node").join(sets, "node")
    small = small.select("cluster", "node", "n", "regs", "shingles").repartition("cluster").sortWithinPartitions("cluster")
    done = small.mapInArrow(_clusters(threshold), "node bigint, comp bigint")
    rest = clustered.where("large").select("node")
    if not rest.isEmpty():
        done = done.unionByName(_in_rounds(rest, known, sets, threshold))
    return stored(done)


def _classes(sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes): a class for each set, (node, id, digest, nameless, n, regs).

    id and digest are those of a row that holds the set, nameless is the first row without an id. Where a name
    stands for two different digests all sets get new names, made of both halves."""
    for _ in range(8):
        classes = stored(sk.where("n > 0").groupBy("node").agg(
            F.min(F.struct("id", "digest")).alias("owner"), F.min(F.when(F.col("id") == NO_ID, F.col("row"))).alias("nameless"),
            F.min("check").alias("low"), F.max("check").alias("high"), F.first("n").alias("n"), F.first("regs").alias("regs")))
        if classes.where("low < high").isEmpty():
            return sk, classes.select("node", "owner.id", "owner.digest", "nameless", "n", "regs")
        sk = stored(sk.withColumn("node", F.xxhash64("node", "check")))
    raise ValueError("sets can't be told apart by 64 bits")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, id_col: str = "doc_id",
                    text_col: str = "text", hot: int = HOT, large: int = LARGE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links where 100 * intersection >= threshold * union."""
    spark = docs.sparkSession
    short_batches(spark)
    text = docs[text_col].cast("string")
    src = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"),
                      F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"), text.alias("text"))
    sk, classes = _classes(stored(sketch(src, width)))
    owners = classes.select("node", "id", "nameless")

    def sets_of(rows):
        wanted = _small(stored(classes.select("node", "id", "digest").join(rows, "node").select("node", "id", "digest")), 48)
        texts = src.join(wanted, ["id", "digest"]).select("node", "text")  # rows of other texts don't meet, whatever their id
        return _full_sets(texts, width).dropDuplicates(["node"])

    comp = link_components(classes.select("node", "n", "regs"), sets_of, threshold, hot, large)
    low = owners.join(comp, "node").groupBy("comp").agg(F.min("id").alias("component"), F.min("nameless").alias("first"))
    named = comp.join(low, "comp").select("node", "component", "first")
    named = owners.join(named, "node", "left").select("node", F.coalesce("component", "id").alias("component"), F.coalesce("first", "nameless").alias("first"))
    out = sk.select("row", "id", "node", "n").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    clean = lambda c: F.nullif(c, F.lit(NO_ID))
    kept = (F.col("id") == component) & ((F.col("id") != NO_ID) | (F.col("n") == 0) | (F.col("row") == F.col("first")))
    return out.select(clean(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), clean(component).alias("component_id"),
                      kept.alias("kept"))
