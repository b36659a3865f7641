"""Filling containers of fixed capacity with documents, by conflict-constrained best fit."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.leaks import plain_words
from skein.storage import Scratch

# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Public vocabulary; a path on the driver, from where Spark sends it to the executors.
VOCABULARY = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Documents packed together. Each shard leaves a few bins less than full, which are packed once more.
SHARD_DOCUMENTS = 20_000
FULL = 0.97


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, cluster: one row per input row. Whole texts are counted; null and empty ones have 0.

    cluster is a hash of the text's words (case, punctuation and white space aside), so copies share it; null for a
    text without words.
    """

    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        import xxhash

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            counts, clusters = [], []
            for text in pdf.text:
                counts.append(len(encoding.encode_ordinary(text)) if text else 0)
                words = plain_words(text)
                clusters.append(xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63) if words else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": counts, "cluster": pd.array(clusters, "Int64")})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, n_tokens int, cluster long")


class Bins:
    """Open bins by residual capacity. `levels` has bit r set if a bin with r free tokens exists, so the tightest
    bin with room is the lowest set bit from the size on; the search goes on to the next one while bins conflict."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = 0
        self.by_residual: dict[int, list[int]] = {}
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.count = 0

    def _move(self, residual: int, number: int) -> None:
        self.by_residual.setdefault(residual, []).append(number)
        self.levels |= 1 << residual

    def place(self, size: int, cluster: int, source: int) -> int:
        """Bin of an item; cluster and source are single-bit masks (0: none). A bin never takes two items of one
        cluster. Of the equally tight bins the first without the source is taken, else the first compatible one."""
        levels = self.levels >> size
        residual = size
        while levels:
            step = (levels & -levels).bit_length() - 1
            residual += step
            numbers = self.by_residual[residual]
            chosen = -1
            for i in range(len(numbers) - 1, -1, -1):
                if not cluster or not self.clusters[numbers[i]] & cluster:
                    if chosen < 0:
                        chosen = i
                    if not source or not self.sources[numbers[i]] & source:
                        chosen = i
                        break
                    if len(numbers) - i > 64:  # enough equally tight bins looked at for a preference
                        break
            if chosen >= 0:
                number = numbers.pop(chosen)
                if not numbers:
                    del self.by_residual[residual]
                    self.levels &= ~(1 << residual)
                self.clusters[number] |= cluster
                self.sources[number] |= source
                self._move(residual - size, number)
                return number
            levels >>= step + 1
            residual += 1
        number = self.count
        self.count += 1
        self.clusters.append(cluster)
        self.sources.append(source)
        self._move(self.capacity - size, number)
        return number


def pack(sizes: list[int], clusters: list, sources: list, capacity: int) -> list[int]:
    """Bin number of each item, largest first. Masks name only clusters with several items, and all sources, here."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    where = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    bins = Bins(capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i], bit.get(clusters[i], 0), where.get(sources[i], 0))
    return out


_PLACED = "pack_name string, capacity int, container string, doc_id long, piece int, n_tokens int, cluster long, source string"


def _packer(stage: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        clusters = [None if pd.isna(c) else int(c) for c in pdf["cluster"]]
        numbers = pack(pdf.n_tokens.tolist(), clusters, pdf.source.where(pdf.source.notna(), None).tolist(), int(pdf.capacity.iloc[0]))
        pdf["container"] = [f"{stage}{key[1]}-{n}" for n in numbers]
        return pdf[["pack_name", "capacity", "container", "doc_id", "piece", "n_tokens", "cluster", "source"]]

    return run


def pack_documents(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Every document in one container of each size: pack_name, container, doc_id, piece, n_tokens.

    A document longer than the capacity is cut: full pieces have containers of their own, its rest is an item. No other
    is split. Two copies never share a container. Repeated rows of a doc_id count once (the longest text); null ids are
    left out; documents without text have 0 tokens and are placed like others. Capacities below 1 or null are left out.
    An empty table gives no rows.

    Documents are spread over shards of about `shard_documents` by hash of their id, so no shard grows with the data or
    with a source. Bins below FULL of their capacity are taken apart and packed again, together, in fewer shards.
    """
    rows = token_counts(documents.where("doc_id is not null"), vocabulary)
    best = F.max(F.struct("n_tokens", "cluster", "source")).alias("x")
    scratch = Scratch(documents.sparkSession)
    rows = scratch.save(rows.groupBy("doc_id").agg(best).select("doc_id", "x.*"))  # tokens are counted once
    capacities = sizes.where("pack_name is not null and capacity_tokens >= 1").select("pack_name", F.col("capacity_tokens").alias("capacity")).distinct()
    # One copy of the (id, size) rows per stated capacity, an array of the sizes being exploded on every row: what the task
    # asks for, a container of every size for every document. The sizes are a stated set, read once.
    stated = [(r["pack_name"], r["capacity"]) for r in capacities.collect()]
    if not stated:
        return documents.sparkSession.createDataFrame([], "pack_name string, container string, doc_id long, piece int, n_tokens int")
    sizes_array = F.from_json(F.lit(json.dumps([{"pack_name": n, "capacity": c} for n, c in stated])), "array<struct<pack_name:string,capacity:int>>")
    each = rows.select("*", F.explode(sizes_array).alias("size")).select("*", "size.pack_name", "size.capacity")
    pieces = F.expr("transform(sequence(0, cast(greatest(ceil(n_tokens / capacity), 1) as int) - 1), i -> struct(i as piece, cast(least(capacity, n_tokens - i * capacity) as int) as size))")
    items = each.select("pack_name", "capacity", "doc_id", "cluster", "source", F.explode(pieces).alias("p")).select("pack_name", "capacity", "doc_id", F.col("p.piece").alias("piece"), F.col("p.size").alias("n_tokens"), "cluster", "source")
    full = items.where("n_tokens = capacity").withColumn("container", F.format_string("own-%d-%d", "doc_id", "piece"))
    total = rows.count()
    shards = max(1, -(-total // shard_documents))
    loose = items.where("n_tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    first = loose.groupBy("pack_name", "shard").applyInPandas(_packer("a"), _PLACED)
    columns = ["pack_name", "container", "doc_id", "piece", "n_tokens"]
    if shards == 1:
        return full.select(columns).unionByName(first.select(columns))
    first = scratch.save(first)
    fill = first.groupBy("pack_name", "capacity", "container").agg(F.sum("n_tokens").alias("fill"))
    poor = fill.where(F.col("fill") < F.col("capacity") * FULL).select("pack_name", "container")
    again = first.join(poor, ["pack_name", "container"], "left_semi")
    left = again.groupBy("pack_name").count().agg(F.max("count")).first()[0] or 0
    fewer = max(1, -(-left // shard_documents))
    second = again.withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(fewer))).groupBy("pack_name", "shard").applyInPandas(_packer("b"), _PLACED)
    kept = first.join(poor, ["pack_name", "container"], "left_anti")
    return full.select(columns).unionByName(kept.select(columns)).unionByName(second.select(columns))
