"""Levels of many sources at once: a bit for each source and node, over a graph that every worker can hold."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 4_000_000  # rows of a graph that is broadcast (four bytes an end); larger ones go level by level through joins
WORDS = 16  # at most 1024 sources at a time
CELLS = 1_000_000  # pairs of source and node in a batch of results


class Graph(NamedTuple):
    """Nodes are numbers from 0, ids their names. Edges src, dst are sorted by dst, group, where group numbers the pairs of
    target and declared type (-1: no type, or the target dispatches nothing). Dispatches sent_src, sent_dst are sorted by
    sent_dst; fits pairs a dispatch with a group that lets it pass, sorted by dispatch."""

    ids: pa.Array
    src: np.ndarray
    dst: np.ndarray
    group: np.ndarray
    sent_src: np.ndarray
    sent_dst: np.ndarray
    fits_sent: np.ndarray
    fits_group: np.ndarray


def plain(ids: pa.Array, src: np.ndarray, dst: np.ndarray) -> Graph:
    """A graph without dispatches."""
    order, none = np.argsort(dst, kind="stable"), np.zeros(0, np.int32)
    return Graph(ids, src[order], dst[order], np.full(len(src), -1, np.int32), none, none, none, none)


def with_dispatches(ids: pa.Array, calls: list[np.ndarray], sent: list[np.ndarray], fits: list[np.ndarray]) -> Graph:
    """calls: src, dst, group. sent: src, dst. fits: src and dst of a dispatch, group."""
    order = np.lexsort((calls[2], calls[1]))
    src, dst, group = (c[order] for c in calls)
    order = np.lexsort((sent[0], sent[1]))
    sent_src, sent_dst = (c[order] for c in sent)
    key = lambda s, d: d.astype(np.int64) * (len(ids) + 1) + s
    at = np.searchsorted(key(sent_src, sent_dst), key(fits[0], fits[1])).astype(np.int32)
    order = np.argsort(at, kind="stable")
    return Graph(ids, src, dst, group, sent_src, sent_dst, at[order], fits[2][order])


def _or_by(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of the sorted key and the rows of `values` of each, joined by or."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.bitwise_or.reduceat(values, at, axis=0) if len(at) else values


def levels(g: Graph, starts: np.ndarray, depth: int):
    """(level, nodes, bits): the nodes first met from each start at the level; bit k is start k. As in `call_chain`: edges
    lead to new nodes, whose dispatches follow at the same level, narrowed to types that callers declared."""
    n, words = len(g.ids), -(-len(starts) // 64)
    bit = np.arange(len(starts), dtype=np.uint64)
    front = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(front, (starts, (bit // 64).astype(np.int64)), np.uint64(1) << bit % np.uint64(64))
    seen, nodes = front.copy(), np.unique(starts)
    for level in range(1, depth + 1):
        live = np.zeros(n, bool)
        live[nodes] = True
        e = np.flatnonzero(live[g.src])
        at, bits = _or_by(front[g.src[e]], g.dst[e])
        new = np.zeros((n, words), np.uint64)
        new[at] = bits & ~seen[at]
        if len(g.sent_src):
            at, bits = _dispatched(g, e, front, new)
            new[at] |= bits & ~seen[at]
        nodes = np.flatnonzero(new.any(axis=1))
        if not len(nodes):
            return
        seen |= new
        front = new
        yield level, nodes, new[nodes]


def _dispatched(g: Graph, e: np.ndarray, front: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Targets of the dispatches of new nodes. A start's dispatch passes if none of its edges into the node declares a type,
    or one declares a type that fits."""
    x = np.flatnonzero(new.any(axis=1)[g.sent_src])
    t = e[g.group[e] >= 0]
    from_typed = front[g.src[t]]
    typed, passes = np.zeros_like(new), np.zeros((len(g.sent_src), new.shape[1]), np.uint64)
    at, bits = _or_by(from_typed, g.dst[t])
    typed[at] = bits
    if len(g.fits_sent):
        of_group = np.zeros((int(g.fits_group.max()) + 1, new.shape[1]), np.uint64)
        at, bits = _or_by(from_typed, g.group[t])
        inside = at < len(of_group)
        of_group[at[inside]] = bits[inside]
        at, bits = _or_by(of_group[g.fits_group], g.fits_sent)
        passes[at] = bits
    return _or_by(new[g.sent_src[x]] & (~typed[g.sent_src[x]] | passes[x]), g.sent_dst[x])


def reached(spark: SparkSession, g: Graph, sources: DataFrame, depth: int, to: np.ndarray | None = None) -> DataFrame:
    """owner, id, level: for each owner of a source (no: its node, owners: array of names) the nodes that are 1 to `depth`
    levels away. to: node numbers that are asked for (None: all). Sources should lie in several partitions."""
    wanted = None if to is None else np.isin(np.arange(len(g.ids)), to)
    shared = spark.sparkContext.broadcast((g, wanted))
    width = 64 * int(np.clip(4_000_000 // max(1, len(g.src), len(g.ids)), 1, WORDS))

    def run(batches):
        g, wanted = shared.value
        for batch in batches:
            starts, owners = batch.column(0).to_numpy(), batch.column(1)
            for k in range(0, len(starts), width):
                part = owners.slice(k, width)
                counts = part.value_lengths().to_numpy().astype(np.int64)
                first, names = np.cumsum(counts) - counts, part.flatten()
                for level, nodes, bits in levels(g, starts[k : k + width], depth):
                    if wanted is not None:
                        bits, nodes = bits[wanted[nodes]], nodes[wanted[nodes]]
                    yield from _rows(g.ids, level, nodes, bits, first, counts, names)

    rows = sources.select("no", "owners").mapInArrow(run, "id string, level int, owners array<string>")
    return rows.select(F.explode("owners").alias("owner"), "id", "level")


def _rows(ids, level, nodes, bits, first, counts, names):
    step = max(1, CELLS // max(1, int(counts.sum())))
    for k in range(0, len(nodes), step):
        some = np.ascontiguousarray(bits[k : k + step])
        row, source = np.nonzero(np.unpackbits(some.astype("<u8").view(np.uint8), axis=1, bitorder="little"))
        n = counts[source]
        ends = np.cumsum(n)
        taken = np.repeat(first[source] - (ends - n), n) + np.arange(ends[-1])
        offsets = np.r_[0, np.cumsum(np.bincount(row, weights=n, minlength=len(some)).astype(np.int64))]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(taken)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(nodes[k : k + step])), pa.array(np.full(len(some), level, np.int32)), lists], ["id", "level", "owners"])


def numbered_edges(edges: DataFrame, numbered: DataFrame) -> DataFrame:
    """Edges (src, dst and more) with the numbers s and d of their ends in place of these."""
    end = lambda name, no: numbered.select(F.col("id").alias(name), F.col("no").cast("int").alias(no))
    return edges.join(end("src", "s"), "src").join(end("dst", "d"), "dst").drop("src", "dst")


def columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [table.column(name).to_numpy().astype(np.int32) for name in names]


def names_of(numbered: DataFrame) -> pa.Array:
    """Names (column id) in the order of their numbers (column no, from 0 without gaps)."""
    table = numbered.select("no", "id").toArrow()
    return table.column("id").combine_chunks().take(pa.array(np.argsort(table.column("no").to_numpy())))
