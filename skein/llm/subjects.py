"""Subject areas of documents, from class-association rules mined with parallel frequent-pattern growth."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import Scratch

#: Most labelled documents the first rules are learnt from; a bound on the sample, of which the least ids are taken.
MAX_LABELLED = 2_000_000
MIN_SUPPORT = 4  # sentences, in the labelled sample
CORPUS_SUPPORT = 2e-5  # share of all sentences, in the second mining
MAX_WORDS = 2  # words of a rule
TELLING = 0.25  # least confidence of a word by itself; common words of all subjects fall below
#: A rule this sure decides a sentence; weaker ones only add up. Rules from noisy labels need less.
STRONG = 0.75
FIRST_STRONG = 0.6

_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_TRACE = re.compile(r"^(?:\s+at \S|\s*File \"|\s*Traceback \(|Caused by:|\s*\.\.\. \d+ more|\s*goroutine \d|[\w.$]+(?:Error|Exception)\b).*$", re.M)
_CODE_LINE = re.compile(r"^(?:\t| {4,}).*[(){}=;].*$|^\s*[\w.]+ = [\w.]+\(.*\)\s*;?$|^.*[;{}]\s*$", re.M)
_SPLIT = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")


def sentences(text: str | None) -> list[list[str]]:
    """Distinct words of each sentence or list item, in lower case; code blocks, code lines and traces are left out."""
    s = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    s = _CODE_LINE.sub(" ", _TRACE.sub(" ", _FENCE.sub("\n", s)))
    found = []
    for part in _SPLIT.split(s):
        words = sorted({w.lower() for w in _WORD.findall(_CAMEL.sub(" ", part)) if len(w) > 2})
        if words:
            found.append(words)
    return found


# ---- Words as numbers


def word_ids(documents: DataFrame) -> DataFrame:
    """doc_id, words: per document the 63-bit hashes of the distinct words of each sentence, each sentence ended by a 0.
    Texts are split once; everything after works on these arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                for words in sentences(text):
                    for w in words:
                        h = known.get(w)
                        if h is None:
                            h = known[w] = (xxhash.xxh64_intdigest(w) & ((1 << 63) - 1)) or 1
                        flat.append(h)
                    flat.append(0)
                ends.append(len(flat))
            if len(known) > 2_000_000:
                known.clear()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "words"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<bigint>")


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in pieces of about `most` words: the piece, its words one after the other, and the word count of each row."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("words"))
        ends = lists.offsets.to_numpy()
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[a] : ends[z]]
            yield batch.slice(a, z - a), flat, np.diff(ends[a : z + 1])
            a = z


# ---- Rules as evidence


class Scorer:
    """Rules (words, subject, confidence) as evidence: the log odds of their confidence, in arrays."""

    def __init__(self, subjects: list[str], rules: list[tuple[list[int], int, float]], strong: float = STRONG):
        self.subjects, self.sure = subjects, math.log(strong / (1 - strong))
        odds = lambda p: math.log(min(max(p, 0.01), 0.99) / (1 - min(max(p, 0.01), 0.99)))
        singles = [(w[0], s, odds(p)) for w, s, p in rules if len(w) == 1]
        self.words = np.unique(np.array([w for w, _, _ in singles], np.int64))
        self.single = np.full((len(self.words), len(subjects)), np.nan)
        if singles:
            at = np.searchsorted(self.words, np.array([w for w, _, _ in singles], np.int64))
            self.single[at, [s for _, s, _ in singles]] = [e for _, _, e in singles]
        rank = {int(w): i for i, w in enumerate(self.words)}
        pairs = [(rank[min(w)] * len(self.words) + rank[max(w)], s, odds(p)) for w, s, p in rules if len(w) == 2 and w[0] in rank and w[1] in rank]
        self.codes = np.unique(np.array([c for c, _, _ in pairs], np.int64))
        self.pair = np.full((len(self.codes), len(subjects)), np.nan)
        if pairs:
            self.pair[np.searchsorted(self.codes, [c for c, _, _ in pairs]), [s for _, s, _ in pairs]] = [e for _, _, e in pairs]
        self.chunk = max(20_000, 30_000_000 // max(1, len(subjects)))  # words scored at once, so that arrays stay small

    def evidence(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences that match a rule, the row of each match's sentence among them, and the matches' evidence."""
        sentence = np.cumsum(flat == 0)
        at = np.minimum(np.searchsorted(self.words, flat), max(0, len(self.words) - 1))
        hit = np.flatnonzero(self.words[at] == flat) if len(self.words) else np.zeros(0, np.int64)
        word, where = at[hit], sentence[hit]
        rows, values = [where], [self.single[word]]
        if len(self.codes) and len(hit):
            last = np.searchsorted(where, where, side="right")
            later = last - np.arange(len(hit)) - 1
            left = np.repeat(np.arange(len(hit)), later)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
            a, b = np.minimum(word[left], word[right]), np.maximum(word[left], word[right])
            code = a * len(self.words) + b
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ok = np.flatnonzero(self.codes[k] == code)
            rows.append(where[left[ok]])
            values.append(self.pair[k[ok]])
        rows, values = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
        matched, start = np.unique(rows, return_index=True)
        return matched, start, values

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subject number of each sentence (-1: none) and sentences per (document, subject).

        A sentence is about the subject of a sure rule (of several, the one with most evidence over its sure rules). A
        doubtful one, with two or more weak rules for a subject, goes to that of its possible subjects which has most
        sure sentences in the document; where none has any, to the one with more evidence for than against it.
        """
        n, k = int((flat == 0).sum()), len(self.subjects)
        number = np.repeat(np.arange(len(lengths)), lengths)
        doc = number[flat == 0]
        subject = np.full(n, -1, np.int64)
        matched, start, values = self.evidence(flat)
        if not len(matched):
            return subject, np.zeros((len(lengths), k), np.int64)
        known = ~np.isnan(values)
        count = np.add.reduceat(known, start, axis=0, dtype=np.int64)
        total = np.add.reduceat(np.where(known, values, 0), start, axis=0)
        best = np.maximum.reduceat(np.where(known, values, -np.inf), start, axis=0)
        over = np.add.reduceat(np.where(known & (values >= self.sure), values, 0), start, axis=0)
        sure = best >= self.sure
        first = np.where(sure, over, -np.inf)
        first_best = np.where(first == first.max(axis=1, keepdims=True), best, -np.inf)
        pick = k - 1 - np.argmax(first_best[:, ::-1], axis=1)
        is_sure = sure.any(axis=1)
        subject[matched[is_sure]] = pick[is_sure]
        of_doc = np.bincount(doc[matched[is_sure]] * k + pick[is_sure], minlength=len(lengths) * k).reshape(len(lengths), k)
        weak = (count >= 2) & (best > -1.8) & ~is_sure[:, None]
        rest = np.flatnonzero(weak.any(axis=1))
        if len(rest):
            mine = of_doc[doc[matched[rest]]]
            seen = np.where(weak[rest], mine, -1)
            low = np.where(seen == seen.max(axis=1, keepdims=True), total[rest], -np.inf)
            low = np.where(weak[rest], low, -np.inf)
            chosen = np.argmax(low, axis=1)
            row = np.arange(len(rest))
            takes = (mine[row, chosen] > 0) | (mine.sum(axis=1) == 0) & (total[rest][row, chosen] > 0)
            subject[matched[rest[takes]]] = chosen[takes]
            of_doc = of_doc + np.bincount(doc[matched[rest[takes]]] * k + chosen[takes], minlength=len(lengths) * k).reshape(len(lengths), k)
        return subject, of_doc


# ---- Mining


def _units(batches: Iterator[pa.RecordBatch], scorer: "Scorer | None", chunk: int):
    """(unit of each word, words, classes as (unit, class), number of units, first unit of nothing) of each piece. A unit
    is a sentence with the subject its scorer gives it, or without a scorer a labelled document with its classes."""
    for rows, flat, lengths in _chunks(batches, chunk):
        if scorer is None:
            unit = np.repeat(np.arange(len(lengths)), lengths)
            classes = rows.column(rows.schema.get_field_index("classes"))
            many = np.diff(classes.offsets.to_numpy())
            of = np.repeat(np.arange(len(lengths)), many)
            labels = classes.flatten().to_numpy()
            n = len(lengths)
        else:
            unit = np.cumsum(flat == 0) - (flat == 0)
            subject, _ = scorer.score(flat, lengths)
            of = np.flatnonzero(subject >= 0)
            labels, n = subject[of], len(subject)
        word = flat != 0
        yield unit[word], flat[word], of, labels, n, flat


def _class_counts(data: DataFrame, scorer: "Scorer | None", chunk: int) -> DataFrame:
    """w, c, n: units with word w and class c; c = -1: units with the word; w = 0: units with the class, and all."""
    shared = data.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, words, of, labels, n, _ in _units(batches, shared.value, chunk):
            vocabulary, index = np.unique(words, return_inverse=True)
            if shared.value is None:  # the words of a document's sentences repeat
                unit, index = np.unique(np.stack([unit, index]), axis=1) if len(unit) else (unit, index)
            seen = np.bincount(index, minlength=len(vocabulary))
            order = np.argsort(of, kind="stable")
            o, lab = of[order], labels[order]
            low, high = np.searchsorted(o, unit), np.searchsorted(o, unit, side="right")
            many = high - low
            w = np.repeat(index, many)
            c = lab[np.repeat(low, many) + np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many)]
            pair, k = np.unique(w * (1 << 20) + c, return_counts=True)
            classes, per = np.unique(labels, return_counts=True)
            out_w = np.concatenate([vocabulary, vocabulary[pair >> 20], np.zeros(len(classes) + 1, np.int64)])
            out_c = np.concatenate([np.full(len(vocabulary), -1), pair & ((1 << 20) - 1), classes, [-1]])
            out_n = np.concatenate([seen, k, per, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (out_w, out_c, out_n)], ["w", "c", "n"])

    return data.mapInArrow(run, "w long, c long, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))


def _baskets(data: DataFrame, scorer: "Scorer | None", keep: np.ndarray, chunk: int) -> DataFrame:
    """items: of each sentence that has any, its kept words and its classes (class c as -1 - c)."""
    shared = data.sparkSession.sparkContext.broadcast((scorer, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, kept = shared.value
        for unit, words, of, labels, _, flat in _units(batches, mine, chunk):
            at = np.minimum(np.searchsorted(kept, words), len(kept) - 1)
            hit = kept[at] == words
            sentence = (np.cumsum(flat == 0) - (flat == 0))[flat != 0][hit]
            items, unit = words[hit], unit[hit]
            present, first = np.unique(sentence, return_index=True)
            owner = unit[first]  # the unit of each sentence that is present
            order = np.argsort(of, kind="stable")
            o, lab = of[order], labels[order]
            low = np.searchsorted(o, owner)
            many = np.searchsorted(o, owner, side="right") - low
            c = lab[np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
            all_s = np.concatenate([sentence, np.repeat(present, many)])
            all_i = np.concatenate([items, -1 - c])
            order = np.argsort(all_s, kind="stable")
            ends = np.searchsorted(all_s[order], present, side="right")
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(all_i[order].astype(np.int64)))], ["items"])

    return data.mapInArrow(run, "items array<bigint>")


_RULES = "words array<bigint>, c long, n long, hits long, confidence double"


def mine_rules(data: DataFrame, scorer: "Scorer | None", support: float, scratch: Scratch, chunk: int = 1_000_000, longest: int = MAX_WORDS) -> DataFrame:
    """Class-association rules: words (up to `longest` hashes, sorted), c (class), n (sentences with the words), hits (of these with
    the class), confidence (smoothed towards the class's share).

    data: words (as in `word_ids`) and, where no scorer names the sentences, classes of the whole document. Words that are
    hardly more frequent with any class than without are dropped first, by their class counts over all sentences (over
    documents, where a class holds for documents); only then frequent patterns are grown, so patterns stay short. A two-word
    rule is redundant, and pruned, unless it is surer than both of its one-word rules. The one-word rules are the class
    counts themselves, so with longest=1 no patterns are grown.
    """
    spark = data.sparkSession
    counts = scratch.save(_class_counts(data, scorer, chunk))
    of_nothing = {r["c"]: r["n"] for r in counts.where("w = 0").collect()}  # a row per class
    units = of_nothing.pop(-1, 0)
    if not of_nothing:
        return spark.createDataFrame([], _RULES)
    share = {c: n / units for c, n in of_nothing.items()}
    base = F.create_map(*[x for c, p in share.items() for x in (F.lit(c), F.lit(p))])
    least = max(MIN_SUPPORT, math.ceil(support * units))
    seen = counts.where((F.col("c") == -1) & (F.col("n") >= least) & (F.col("w") != 0)).select("w", F.col("n").alias("all"))
    expected = F.col("all") * base[F.col("c")]
    telling = counts.where((F.col("c") >= 0) & (F.col("n") >= least)).join(seen, "w")
    telling = telling.where((F.col("n") >= TELLING * F.col("all")) & (F.col("n") >= 1.5 * expected) & (F.col("n") - expected >= 2.5 * F.sqrt(expected))).select("w").distinct()
    if longest == 1:
        rules = counts.where("c >= 0").withColumnRenamed("n", "hits").join(seen, "w").join(telling, "w", "left_semi").where(F.col("hits") >= least)
        rules = rules.withColumn("confidence", (F.col("hits") + base[F.col("c")]) / (F.col("all") + 1)).where(F.col("confidence") >= 1.5 * base[F.col("c")])
        return rules.select(F.array("w").alias("words"), "c", F.col("all").alias("n"), "hits", "confidence")
    # Each has `least` sentences or more: at most (words a sentence) / support of the corpus, or a quarter of the words of
    # the labelled sample, whose size is bounded.
    keep = np.sort(np.array([r[0] for r in telling.collect()], np.int64))
    if not len(keep):
        return spark.createDataFrame([], _RULES)
    baskets = scratch.save(_baskets(data, scorer, keep, chunk))
    size = baskets.count()
    if not size:
        return spark.createDataFrame([], _RULES)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / size), minConfidence=1.0).fit(baskets).freqItemsets
    is_class = lambda x: x < 0
    found = scratch.save(found.select(F.array_sort(F.filter("items", lambda x: x > 0)).alias("words"), F.filter("items", is_class).alias("cs"), "freq").where((F.size("cs") <= 1) & F.size("words").between(1, longest)))
    n = found.where(F.size("cs") == 0).select("words", F.col("freq").alias("n"))
    rules = found.where(F.size("cs") == 1).select("words", (-1 - F.col("cs")[0]).alias("c"), F.col("freq").alias("hits")).join(n, "words").where(F.col("n") >= least)
    rules = rules.withColumn("confidence", (F.col("hits") + base[F.col("c")]) / (F.col("n") + 1))
    rules = scratch.save(rules.where(F.col("confidence") >= 1.5 * base[F.col("c")]))
    single = rules.where(F.size("words") == 1).select(F.col("words")[0].alias("w"), "c", F.col("confidence").alias("alone"))
    pairs = rules.where(F.size("words") == 2)
    alone = pairs.select("words", "c", F.explode("words").alias("w")).join(single, ["w", "c"], "left").groupBy("words", "c").agg(F.max("alone").alias("alone"))
    pairs = pairs.join(alone, ["words", "c"]).where(F.col("confidence") > F.coalesce("alone", F.lit(0.0)) + 0.05).drop("alone")
    return rules.where(F.size("words") == 1).unionByName(pairs).select("words", "c", "n", "hits", "confidence")


def _collected(rules: DataFrame) -> list[tuple[list[int], int, float]]:
    """Rules on the driver: bounded like `keep` in `mine_rules`, as each word or pair has a minimum share of the sentences."""
    return [(list(r["words"]), r["c"], r["confidence"]) for r in rules.select("words", "c", "confidence").collect()]


# ---- Calibration


def rule_matches(labelled: DataFrame, rules: list[tuple[list[int], int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each rule the labelled documents with a sentence that matches it, and those of them that bear its class."""
    words = np.unique(np.array([w for ws, _, _ in rules for w in ws], np.int64))
    rank = {int(w): i for i, w in enumerate(words)}
    n = len(words)
    code = np.array([rank[ws[0]] if len(ws) == 1 else n + rank[min(ws)] * n + rank[max(ws)] for ws, _, _ in rules], np.int64)
    cls = np.array([c for _, c, _ in rules], np.int64)
    bodies = np.unique(code)
    shared = labelled.sparkSession.sparkContext.broadcast((words, bodies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bodies = shared.value
        n = len(words)
        for rows, flat, lengths in _chunks(batches, 1_000_000):
            at = np.minimum(np.searchsorted(words, flat), n - 1)
            hit = np.flatnonzero(words[at] == flat)
            doc, sentence = np.repeat(np.arange(len(lengths)), lengths)[hit], np.cumsum(flat == 0)[hit]
            word = at[hit]
            last = np.searchsorted(sentence, sentence, side="right")
            later = last - np.arange(len(hit)) - 1
            left = np.repeat(np.arange(len(hit)), later)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
            pairs = n + np.minimum(word[left], word[right]) * n + np.maximum(word[left], word[right])
            codes, docs = np.concatenate([word, pairs]), np.concatenate([doc, doc[left]])
            k = np.minimum(np.searchsorted(bodies, codes), len(bodies) - 1)
            ok = bodies[k] == codes
            if not ok.any():
                continue
            body, d = np.unique(np.stack([k[ok], docs[ok]]), axis=1)
            classes = rows.column(rows.schema.get_field_index("classes")).to_pylist()
            got = [(int(b), c) for b, x in zip(body, d) for c in (-1, *classes[x])]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int64()), pa.array([c for _, c in got], pa.int64())], ["b", "c"])

    got = labelled.mapInArrow(run, "b long, c long").groupBy("b", "c").count().collect()  # bounded by rules x classes
    counts = {(r["b"], r["c"]): r["count"] for r in got}
    at = np.searchsorted(bodies, code)
    held = np.array([counts.get((int(b), -1), 0) for b in at], np.float64)
    return held, np.array([counts.get((int(b), int(c)), 0) for b, c in zip(at, cls)], np.float64)


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares fit that never falls (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            total = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / total if total else (v1 + v2) / 2, total, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def calibrate(rules: list[tuple[list[int], int, float]], held_out: DataFrame, bins: int = 20, prior: float = 8.0) -> list[tuple[list[int], int, float]]:
    """Confidences re-estimated on labelled documents (words, classes) that had no part in the rules.

    Rules of like confidence are pooled: the share of held-out documents that bear the class, made to rise with the mined
    confidence. Hand labels miss and confuse subjects, so even a sure rule agrees with only some of them; the share is taken
    relative to that of the surest tenth of the matches. A rule's own matches then move it from its pool's value, which
    weighs as much as `prior` documents.
    """
    if not rules:
        return []
    confidence = np.array([p for _, _, p in rules])
    held, right = rule_matches(held_out, rules)
    if not held.sum():
        return rules
    order = np.argsort(-confidence, kind="stable")
    top = order[: int(np.searchsorted(np.cumsum(held[order]), held.sum() / 10)) + 1]
    reliable = max(right[top].sum() / max(held[top].sum(), 1), 1e-9)
    bin_of = np.minimum((confidence * bins).astype(int), bins - 1)
    h, r = np.bincount(bin_of, held, bins), np.bincount(bin_of, right, bins)
    middle = (np.arange(bins) + 0.5) / bins
    # A pool without matches keeps the mined value.
    share = np.minimum((r / reliable + prior * middle) / (h + prior), 1.0)
    pooled = rising(share, h + prior)[bin_of]
    own = np.minimum((right / reliable + prior * pooled) / (held + prior), 1.0)
    return [(w, c, float(p)) for (w, c, _), p in zip(rules, own)]


# ---- Documents


def subject_scorer(words: DataFrame, labels: DataFrame, subjects: DataFrame, scratch: Scratch) -> Scorer:
    """Rules from the hand labels, then twice again from all sentences under the rules so far, the last calibrated.

    Labels: any case, spaces around, repeated and unknown ones allowed; unknown subjects are left out. A tenth of the
    labelled documents is held out from all rules and calibrates the last. The first rules come from one half of the others
    and are calibrated on the other half. They name the subject of sentences in the whole corpus; mining over all sentences
    (those about no subject included) gives surer rules, first of one word, which are applied and mined once more for rare
    words and pairs.
    """
    names = sorted(r[0] for r in subjects.select(F.lower(F.trim("subject")).alias("s")).where("s is not null").distinct().collect())  # the permitted subjects
    if len(names) >= 1 << 20:
        raise ValueError("more than a million subjects")
    spark = words.sparkSession
    known = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "subject string, c long")
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).join(known, "subject").where("doc_id is not null")
    sample = clean.groupBy("doc_id").agg(F.array_sort(F.collect_set("c")).alias("classes"))
    if labels.count() > MAX_LABELLED:
        sample = sample.orderBy("doc_id").limit(MAX_LABELLED)
    labelled = scratch.save(words.join(sample, "doc_id").groupBy("doc_id").agg(F.max("words").alias("words"), F.max("classes").alias("classes")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    first = []
    for mine, other in (((1, 2, 3, 4), (5, 6, 7, 8, 9)), ((5, 6, 7, 8, 9), (1, 2, 3, 4))):
        rules = _collected(mine_rules(labelled.where(fold.isin(*mine)), None, 0.0, scratch))
        first.append(_shrunk(rules, labelled.where(fold.isin(*other))))
    both: dict[tuple, list[float]] = {}
    for ws, c, p in (r for rules in first for r in rules):
        both.setdefault((tuple(ws), c), []).append(p)
    scorer = Scorer(names, [(list(ws), c, sum(p) / len(p)) for (ws, c), p in both.items()], FIRST_STRONG)
    rules = []
    for longest in (1, MAX_WORDS):
        rules = _collected(mine_rules(words, scorer, CORPUS_SUPPORT, scratch, scorer.chunk, longest))
        scorer = Scorer(names, rules)
    return Scorer(names, calibrate(rules, labelled.where(fold == 0)))


def _shrunk(rules: list[tuple[list[int], int, float]], held_out: DataFrame, prior: float = 4.0) -> list[tuple[list[int], int, float]]:
    """Confidence re-estimated on documents the rules were not mined from; `prior` documents stand for the mined value."""
    if not rules:
        return []
    held, right = rule_matches(held_out, rules)
    return [(w, c, float((k + prior * p) / (n + prior))) for (w, c, p), n, k in zip(rules, held, right)]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = 0.2, last: str = "software") -> DataFrame:
    """Subjects of each document that has text: doc_id, subject, n_sentences, n_about (sentences about any subject).

    A subject counts from `share` of the sentences that are about some subject; `last` only if there is no other. Whole
    texts are scored. Documents without such sentences give no rows; null ids and texts are left out; rows of one id
    are scored each and their subjects united; no labels or no subjects give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    words = scratch.save(word_ids(documents.where("doc_id is not null and text is not null")))
    scorer = spark.sparkContext.broadcast(subject_scorer(words, labels, subjects, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = scorer.value
        names = np.array(mine.subjects, object)
        for rows, flat, lengths in _chunks(batches, mine.chunk):
            if not len(names):
                continue
            _, counts = mine.score(flat, lengths)
            about = counts.sum(axis=1)
            chosen = (counts > 0) & (counts >= share * about[:, None])
            is_last = names == last
            chosen &= ~(is_last[None, :] & (chosen & ~is_last[None, :]).any(axis=1)[:, None])
            d, s = np.nonzero(chosen)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(names[s].tolist(), pa.string()), pa.array(counts[d, s], pa.int32()), pa.array(about[d], pa.int32())], ["doc_id", "subject", "n_sentences", "n_about"])

    found = words.mapInArrow(run, "doc_id long, subject string, n_sentences int, n_about int")
    return found.groupBy("doc_id", "subject").agg(F.max("n_sentences").alias("n_sentences"), F.max("n_about").alias("n_about"))
