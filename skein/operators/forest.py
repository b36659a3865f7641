"""Call forests: trees below entry points, without accessors and external nodes, and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.traverse import call_chain
from skein.storage import Scratch


def call_forest(functions: DataFrame, calls: DataFrame, dispatches: DataFrame, entries: DataFrame, depth: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """root, src, dst, level: edges of the trees below the entry points (id, kind), suspected_dead ones left out."""
    roots = entries.where("kind <> 'suspected_dead'").select("id")
    return call_chain(functions, calls, dispatches, roots, depth, False, 0.0, scratch).edges.select("root", "src", "dst", "level").distinct()


def core_forest(edges: DataFrame, functions: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges (root, src, dst) without accessors and external functions, whose callees move up to their callers.

    Each round replaces every dropped node that is a callee by what lies behind it, twice as far as in the round before, so
    the rounds are about the logarithm of the dropped nodes; then only runs that turn in circles are left, and disappear.
    """
    gone = functions.where(F.col("is_getter") | F.col("is_setter") | F.coalesce("file_path", F.lit("")).isin("", "[external]")).select("id")
    e = scratch.save(edges.select("root", "src", "dst").distinct())
    below = scratch.save(e.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").where("src <> dst"))  # callees of dropped nodes
    kept = scratch.save(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"))
    rounds = below.select("src").distinct().count().bit_length() + 1
    for turn in range(rounds + 1):
        bad = scratch.save(kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("root", "src", "dst"))
        if bad.isEmpty() or turn == rounds:
            return kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").where("src <> dst").select("root", "src", "dst").distinct()
        good = kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("root", "src", "dst")
        moved = bad.withColumnRenamed("dst", "via").join(below.select("root", F.col("src").alias("via"), "dst"), ["root", "via"]).select("root", "src", "dst")
        kept = scratch.save(good.unionByName(moved).distinct())
        longer = below.withColumnRenamed("dst", "via").join(below.select("root", F.col("src").alias("via"), F.col("dst")), ["root", "via"]).select("root", "src", "dst").where("src <> dst")
        ends = below.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("root", "src", "dst")
        below = scratch.save(longer.unionByName(ends).distinct())


def call_tree_text(root: str, edges: list[tuple[str, str, int]], names: dict[str, str], depth: int = 5) -> str:
    """Indented text of one tree: edges (src, dst, line) in order of line, then callee; a function shown before is only
    named again. Repeated calls of one function by another are folded into one line with their number."""
    below: dict[str, dict[str, list[int]]] = {}
    for src, dst, line in sorted(edges, key=lambda e: (e[2] if e[2] is not None else 1 << 30, e[1])):
        below.setdefault(src, {}).setdefault(dst, []).append(line)
    lines, seen, stack = [names.get(root, root)], {root}, [(root, 0, None)]
    out: list[str] = []
    while stack:
        node, level, times = stack.pop()
        if level:
            again = node in seen
            out.append("  " * level + names.get(node, node) + (f" x{times}" if times and times > 1 else "") + (" (see above)" if again else ""))
            if again:
                continue
            seen.add(node)
        if level < depth:
            stack += [(dst, level + 1, len(at)) for dst, at in reversed(list(below.get(node, {}).items()))]
    return "\n".join(lines + out)
