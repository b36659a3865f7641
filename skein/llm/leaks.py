"""Evaluation texts that leaked into training text, by an FM-index per shard of the corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import Scratch

from skein.llm.fm_index import FMIndex

RUN_WORDS = 15
#: Exchanged words, GAP or more apart, do not break a run and count within its RUN_WORDS; its first and last word agree.
#: So a run has SEED agreeing words in a row: 9 between two exchanged ones, or the longer part beside a single one.
GAP = 10
SEED = 7
SHARD_WORDS = 1_000_000
OTHER = 1

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = str.maketrans(
    "аеорсухікѕјһԁԛԝвмнтАВЕЅІЈКМНОРСТХУοανρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
    "aeopcyxiksjhdqwbmhtABESIJKMHOPCTXYoavptuikABEZHIKMNOPTYXig",
)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e01ef]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbf\"'/\\]")
# Tags by the grammar of their attributes, of any length and over lines; what only looks like a tag within a line.
_TAG = re.compile(
    r"""</?[A-Za-z][\w:.-]*+(?:\s++[\w:@.*#/%;-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|\{[^{}]*+\}|[^\s"'<>={}]++))?)*+\s*+/?>|</?[A-Za-z][^<>\n]{0,200}>|<!--|-->"""
)
_NUMBERED = re.compile(r"^[ \t]*(?:[>|#*+;-]+[ \t]*)?L?(\d{1,6})(?:[.):|]|[ \t]*[|│:])?[ \t]")
_PERCENT = re.compile(r"%(2[0-9A-Fa-f]|3[A-Fa-f]|0[AaDd]|[57][BbDdEe])")
_WORD = re.compile(r"[^\W_]+")


def _without_line_numbers(s: str) -> str:
    """Drops numbers at the beginning of lines that count on from line to line; other signs there are no words anyway."""
    lines = s.split("\n")
    found = [_NUMBERED.match(x) for x in lines]
    numbers = [int(m.group(1)) if m else None for m in found]
    for i, n in enumerate(numbers):
        if n is not None and (i and numbers[i - 1] == n - 1 or i + 1 < len(lines) and numbers[i + 1] == n + 1):
            lines[i] = lines[i][found[i].end() :]
    return "\n".join(lines)


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def plain_words(text: str | None) -> list[str]:
    """Words (runs of letters or digits) without regard to case, punctuation, white space, line prefixes, markup,
    escapes, invisible and look-alike characters."""
    return _words(_unescaped(text))


def document_words(text: str | None) -> list[str]:
    """`plain_words`, then the insides of tags that hold RUN_WORDS or more words, as a passage can stand in an attribute.
    Two empty words before each inside break any run."""
    s = _unescaped(text)
    words = _words(s)
    for m in _TAG.finditer(s) if "<" in s else ():
        inside = _words(m.group()[1:-1])
        if len(inside) >= RUN_WORDS:
            words += ["", "", *inside]
    return words


def _unescaped(text: str | None) -> str:
    s = text or ""
    if "&" in s:
        s = html.unescape(html.unescape(s))
    if "\\" in s:
        s = _ESCAPE.sub(_unescape, s)
    if "%" in s:
        s = _PERCENT.sub(" ", s)
    return _INVISIBLE.sub("", s)


def _words(s: str) -> list[str]:
    if "<" in s:
        s = _TAG.sub(" ", s)
    s = _without_line_numbers(s)
    s = unicodedata.normalize("NFKC", s)
    s = _INVISIBLE.sub("", s).translate(_LOOK_ALIKE).lower()
    return _WORD.findall(s)


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if s]


def _openings(text: str | None, most: int) -> list[str]:
    """Words of a text's first sentence, of its first two, and so on."""
    s = _sentences(text or "")
    return ["\n".join(" ".join(plain_words(x)) for x in s[:k]) for k in range(1, min(most, len(s)) + 1)]


def shared_openings(items: DataFrame, shared: int = 5, most: int = 4) -> DataFrame:
    """item_id, item_text, skip: every distinct text of every item and how many opening sentences (`most` at most, the
    length an instruction may have) it has in common with `shared` or more different texts of the whole table."""
    texts = items.where("item_id is not null and item_text is not null").select("item_id", "item_text").distinct()

    @F.pandas_udf("array<string>")
    def openings(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _openings(t, most))

    each = texts.select("item_text").distinct().select("item_text", F.posexplode(openings("item_text")).alias("k", "opening"))
    common = each.groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).select("opening")
    # A text's opening of k sentences is common only if that of k - 1 is.
    skip = each.join(common, "opening").groupBy("item_text").agg((F.max("k") + 1).alias("skip"))
    return texts.join(skip, "item_text", "left").select("item_id", "item_text", F.coalesce("skip", F.lit(0)).alias("skip"))


def passage_words(text: str, skip: int) -> list[str]:
    """Words of an item behind its first `skip` sentences."""
    return plain_words("\n".join(_sentences(text)[skip:]) if skip else text)


def longest_run(same: np.ndarray, gap: int = GAP, by: int = 2) -> tuple[int, int, int]:
    """(begin, length, agreeing words) of the run with most agreeing words, or with by=1 of the longest; a run begins and
    ends with a match, and its mismatches are single and `gap` or more apart."""
    edges = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]]).tolist()
    best = (0, 0, 0)
    agreeing = np.append(0, np.cumsum(same)).tolist()
    for k in range(len(edges) - 1):
        # From behind edge k on: mismatches are taken in while each keeps its distance from the one before.
        j = k + 1
        while j < len(edges) - 1 and (j == k + 1 or edges[j] - edges[j - 1] >= gap):
            j += 1
        a, z = edges[k] + 1, edges[j]
        while a < z and not same[a]:
            a += 1
        while z > a and not same[z - 1]:
            z -= 1
        run = (a, z - a, agreeing[z] - agreeing[a])
        if run[by] > best[by]:
            best = run
    return best


def long_runs(same: np.ndarray, least: int = RUN_WORDS, gap: int = GAP) -> list[tuple[int, int]]:
    """(begin, length) of all runs as in `longest_run` of `least` or more words that lie in no longer one."""
    miss = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    stretch = np.diff(miss) - 1  # agreeing words between two mismatches
    following = np.append(stretch[1:], 0)
    # A run is one stretch, two around a mismatch, or goes on over a stretch that keeps its two mismatches apart.
    first = np.flatnonzero((stretch > 0) & ((stretch >= least) | (stretch + 1 + following >= least) | (following >= gap - 1)))
    if not len(first):
        return []
    edges, n = miss.tolist(), len(stretch)
    found: list[tuple[int, int]] = []
    for k in first.tolist():
        j = k + 1
        while j < n and (j == k + 1 or edges[j] - edges[j - 1] >= gap):
            j += 1
        a, z = edges[k] + 1, edges[j]
        while z > a and not same[z - 1]:
            z -= 1
        if z - a >= least and (not found or z > sum(found[-1])):
            found.append((a, z - a))
    return found


class Passages:
    """The stated texts (item, words) as symbols, and their seeds (distinct runs of SEED words) with all their places."""

    def __init__(self, texts: list[tuple[int, list[str]]]):
        self.symbol: dict[str, int] = {}
        for _, ws in texts:
            for w in ws:
                self.symbol.setdefault(w, len(self.symbol) + 2)
        self.item = [i for i, _ in texts]
        self.text = [np.array([self.symbol[w] for w in ws], np.int64) for _, ws in texts]
        places: dict[tuple, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.text):
            for p in range(len(t) - SEED + 1):
                places.setdefault(tuple(t[p : p + SEED].tolist()), []).append((i, p))
        self.seeds = np.array(list(places), np.int64).reshape(-1, SEED)
        counts = [len(v) for v in places.values()]
        self.begin = np.append(0, np.cumsum(counts)).astype(np.int64)
        flat = [x for v in places.values() for x in v]
        self.place_text = np.array([i for i, _ in flat], np.int64)
        self.place_at = np.array([p for _, p in flat], np.int64)


def own_runs(runs: list[tuple]) -> list[tuple]:
    """Of the runs (doc, item, first word, words) of one document those that lie in no longer run of another item.

    Test items share the wording of their templates: inside the copy of one item the words of another agree for a
    stretch, its own words standing where the other's would be. Such a stretch is a passage of the first item only. Runs
    over the same words are all kept.
    """
    order = sorted(set(runs), key=lambda r: (r[2], -r[3], r[1]))
    kept = []
    best, best_item, second = -1, None, -1  # greatest end so far, its item, greatest end of the other items
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][2:] == order[i][2:]:
            j += 1
        end = order[i][2] + order[i][3]
        kept += [r for r in order[i:j] if (second if r[1] == best_item else best) < end]
        for r in order[i:j]:
            if r[1] == best_item:
                best = max(best, end)
            elif end > best:
                best, best_item, second = end, r[1], best
            else:
                second = max(second, end)
        i = j
    return kept


def find_in_shard(docs: list, lengths: list[int], text: np.ndarray, wanted: Passages) -> list[tuple[int, int, int, int]]:
    """(doc, item, first word, words) of runs in one shard. text: the documents' symbols one after the other, OTHER for
    words of no item. Neighbouring OTHERs count as one symbol in the index, as no seed holds one."""
    if not len(text) or not len(wanted.seeds):
        return []
    starts = np.append(0, np.cumsum(lengths))
    edge = np.zeros(len(text), bool)
    edge[starts[:-1][np.array(lengths) > 0]] = True
    keep = (text != OTHER) | edge | np.append(True, text[:-1] != OTHER)
    # A document's first word is cut off from the one before by an OTHER.
    symbols = text[keep]
    origin = np.flatnonzero(keep)
    cut = np.flatnonzero(edge[origin])
    symbols = np.insert(symbols, cut, OTHER)
    origin = np.insert(origin, cut, -1)
    index = FMIndex(symbols, len(wanted.symbol) + 2)
    which, at = index.locate(*index.search(wanted.seeds))
    if not len(which):
        return []
    many = wanted.begin[which + 1] - wanted.begin[which]
    row = np.repeat(np.arange(len(which)), many)
    place = np.repeat(wanted.begin[which], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    number, shift = wanted.place_text[place], origin[at[row]] - wanted.place_at[place]
    doc = np.searchsorted(starts, origin[at[row]], side="right") - 1
    found: list[tuple] = []
    of_doc: list[tuple] = []
    here = -1
    for d, i, s in np.unique(np.stack([doc, number, shift], 1), axis=0).tolist():
        if d != here:
            found += own_runs(of_doc)
            here, of_doc = d, []
        t = wanted.text[i]
        a, z = max(starts[d], s), min(starts[d + 1], s + len(t))
        same = text[a:z] == t[a - s : z - s]
        of_doc += [(docs[d], wanted.item[i], int(a - starts[d] + begin), length) for begin, length in long_runs(same)]
    return found + own_runs(of_doc)


RUNS = "doc_id long, item_id long, first_word int, n_words int"
#: A block of items is broadcast, so it is bounded by rows and by characters (but holds one item at least).
BLOCK_CHARS = 50_000_000


def leaked_passages(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, block: int = 5_000) -> DataFrame:
    """Runs of RUN_WORDS or more words, exchanged ones among them, that a document shares with an item: doc_id, item_id,
    first_word (in `document_words`), n_words.

    documents: doc_id, text; items: item_id, item_text, a stated set of test texts that is taken in blocks of about
    `block`. Each task indexes its documents in shards of about `shard_words` words (a longer document is a shard of its
    own), searches all seeds backwards, locates them and extends each along its diagonal; see `longest_run` for what a
    run is, `own_runs` for the runs inside the copy of another item, which are left out. Whole texts are indexed. With
    one block nothing is shuffled; with more the documents' words are written once and searched per block.

    Null and empty texts have no runs; null ids are left out; rows of a repeated doc_id are searched each and may give
    repeated results (`distinct` them); all texts of a repeated item_id are searched; an item's opening sentences that
    five or more texts share are no part of it; empty tables give no rows.
    """
    stated = Scratch(documents.sparkSession).save(shared_openings(items))
    size = stated.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size["n"] // block), -(-size["chars"] // BLOCK_CHARS))
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    if parts > 1:
        rows = Scratch(documents.sparkSession).save(rows.mapInPandas(_split, "doc_id long, row long, words array<string>"))
    found = None
    for n in range(parts):
        mine = stated.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts)) == n).collect()  # about `block` rows
        got = _search(rows, Passages([(r["item_id"], passage_words(r["item_text"], r["skip"])) for r in mine]), shard_words)
        found = got if found is None else found.unionByName(got)
    if parts == 1:
        return found.drop("row")
    # Runs of one document from several blocks: those inside another block's longer run go.
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(own_runs(list(zip(*(pdf[c].tolist() for c in ("doc_id", "item_id", "first_word", "n_words"))))), columns=["doc_id", "item_id", "first_word", "n_words"])

    return found.groupBy("row").applyInPandas(own, RUNS)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id, "row": range(row, row + len(pdf)), "words": [document_words(t) for t in pdf.text]})
        row += len(pdf)


def _search(rows: DataFrame, wanted: Passages, shard_words: int) -> DataFrame:
    """rows: doc_id and text, or doc_id, row and words."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)  # the texts of one block of items
    split = "words" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = shared.value
        symbol = mine.symbol.get
        docs: list[tuple] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal docs, lengths, parts, size
            got = find_in_shard(docs, lengths, np.concatenate(parts) if parts else np.zeros(0, np.int64), mine)
            docs, lengths, parts, size = [], [], [], 0
            return pd.DataFrame([(d, r, i, a, n) for (d, r), i, a, n in got], columns=["doc_id", "row", "item_id", "first_word", "n_words"])

        for pdf in batches:
            for doc, row, text in zip(pdf.doc_id, pdf.row if split else pdf.doc_id, pdf.words if split else pdf.text):
                words = text if split else document_words(text)
                docs.append((doc, row))
                lengths.append(len(words))
                parts.append(np.fromiter((symbol(w, OTHER) for w in words), np.int64, len(words)))
                size += len(words)
                if size >= shard_words:
                    yield flush()
        yield flush()

    return rows.mapInPandas(run, "doc_id long, row long, item_id long, first_word int, n_words int")


def removal_spans(found: DataFrame) -> DataFrame:
    """Overlapping and touching runs of a document merged: doc_id, first_word, n_words, items."""
    end = F.col("first_word") + F.col("n_words")
    spans = found.distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_word", end.alias("end"), "item_id"))).alias("s"))
    empty = F.array().cast("array<struct<first_word:int,end:int,items:array<bigint>>>")

    def add(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end"], x["end"]).alias("end"), F.array_distinct(F.concat(last["items"], F.array(x["item_id"]))).alias("items"))
        one = F.struct(x["first_word"].alias("first_word"), x["end"].alias("end"), F.array(x["item_id"]).alias("items"))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))
        return F.when((F.size(acc) > 0) & (x["first_word"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(one)))

    rows = spans.select("doc_id", F.explode(F.aggregate("s", empty, add)).alias("m"))
    return rows.select("doc_id", F.col("m.first_word").alias("first_word"), (F.col("m.end") - F.col("m.first_word")).alias("n_words"), F.array_sort("m.items").alias("items"))
