"""Subject rules on a corpus with known truth: held-out accuracy, shares, edge cases."""

import random

import pytest

from skein.llm.subjects import document_subjects, sentences

NOUNS = {"sport": [f"sp{a}" for a in "abcdefghij"], "law": [f"lw{a}" for a in "abcdefghij"], "software": [f"sw{a}" for a in "abcdefghij"]}
NOUNS = {k: [n + "ion" for n in v] + ["charge"] * (k != "software") for k, v in NOUNS.items()}
TALK = ["Please have a look before noon.", "It took 3 ms and takes 9 ms now.", "No change is needed for this."]


def sentence(rnd, subject):
    a, b = rnd.sample(NOUNS[subject], 2)
    return rnd.choice([f"The {a} report groups every {b} by month.", f"Cache the {a} per {b} for a day.", f"Why does a late {a} block the {b} queue?"])


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        subjects = rnd.sample(list(NOUNS), 1 if rnd.random() < 0.8 else 2)
        parts = [sentence(rnd, s) for s in subjects for _ in range(3)] + rnd.sample(TALK, 2)
        rnd.shuffle(parts)
        docs.append((i, " ".join(parts) + "\n\n```\nspaion = lwbion.swcion(3)\n```\r\n"))
        truth[i] = set(subjects) - ({"software"} if len(subjects) > 1 else set())
    labels = [(i, rnd.choice([s.upper(), s, f" {s} "])) for i in range(0, n, 3) for s in truth[i]] + [(0, "nonsense"), (1, None), (None, "law"), (10**9, "law")]
    labels += [(i, rnd.choice(list(NOUNS))) for i in range(0, n, 30)]
    return docs, truth, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*x, "w", 1) for x in docs], "doc_id long, text string, words string, n int")
    lab = spark.createDataFrame([(*x, "c") for x in labels], "doc_id long, subject string, classes string")
    return d, lab, spark.createDataFrame([(s, "d") for s in NOUNS], "subject string, description string")


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus(900, 1)
    got = {}
    for r in document_subjects(*frames(spark, docs + [(9000, None), (9001, ""), docs[2]], labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 3]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.95 * len(held)
    assert 9000 not in got and 9001 not in got


def test_no_labels_or_documents(spark):
    docs, _, labels = corpus(20, 2)
    d, lab, s = frames(spark, docs, labels)
    assert document_subjects(d, lab.limit(0), s).count() == 0
    assert document_subjects(d.limit(0), lab, s).count() == 0


@pytest.mark.parametrize("text,want", [(None, []), ("", []), ("One two three. Four!", [["one", "three", "two"], ["four"]]), ("```\ncode = here\n```\r\nAfter it.", [["after"]]), ("  at a.B.c(D.java:1)\nRename fooId now", [["foo", "now", "rename"]])])
def test_sentences(text, want):
    assert sentences(text) == want
