"""FM-index against string search, runs against brute force, disguises of leaked texts, edge cases."""

import random

import numpy as np

from skein.llm import leaks
from skein.llm.fm_index import FMIndex, suffix_array
from skein.llm.leaks import leaked_passages, longest_run, plain_words, removal_spans


def test_index_finds_every_occurrence():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = rnd.integers(1, 5, n)
        whole = np.append(text, 0)
        assert suffix_array(whole).tolist() == sorted(range(n + 1), key=lambda i: whole[i:].tolist())
        index = FMIndex(text, 5, sample=4)
        patterns = rnd.integers(1, 5, (30, 3))
        which, at = index.locate(*index.search(patterns))
        want = {(k, p) for k, x in enumerate(patterns.tolist()) for p in range(n - 2) if text[p : p + 3].tolist() == x}
        assert set(zip(which.tolist(), at.tolist())) == want and len(at) == len(want)


def test_runs_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        same = np.array([rnd.random() < 0.85 for _ in range(rnd.randint(0, 45))], bool)
        best = 0
        for a in range(len(same)):
            for z in range(a + 1, len(same) + 1):
                miss = [i for i in range(a, z) if not same[i]]
                if all(y - x >= 10 for x, y in zip(miss, miss[1:])):
                    best = max(best, int(same[a:z].sum()))
        assert longest_run(same)[2] == best


ITEM = "Given a warm window of at most 2519 summary values, send the bucket so that no two neighbours share a template. Ties go to the faint ledger"
WORDS = ITEM.split()
DISGUISES = [
    ITEM, ITEM.upper(), "\n".join("> " + x for x in ITEM.split(", ")), "// " + ITEM.replace(" the ", "\n// the "), ITEM.replace(" ", "\u2009"), ITEM.replace("summary", "sum\u00admary").replace("values", "va\u200blues"),
    '{"prompt": "' + ITEM.replace(", ", ",\\n") + '"}', " ".join(f"**{w}**" if i % 3 else f"<b>{w}</b>" for i, w in enumerate(WORDS)), ITEM.replace("a", "\u0430"), ITEM.replace(" ", "&nbsp;"),
    " ".join("other" if i in (2, 13, 24) else w for i, w in enumerate(WORDS)), "before " + " ".join(WORDS[4:22]) + " after", "12: " + "\n13: ".join(ITEM.split(", ")), ITEM.replace(",", "\uff0c"),
]
CLEAN = [None, "", "...", " ".join(WORDS[:14]), " ".join("x" if i % 5 == 0 else w for i, w in enumerate(WORDS)), "Answer with code only and no further text here please now.", " ".join(reversed(WORDS))]


def test_disguises_are_found_and_clean_texts_are_not(spark):
    opening = "Answer with code only and no further text. "
    items = [(1, opening + ITEM), *[(k, opening + f"item {k} " + " ".join(f"w{k}x{i}" for i in range(20))) for k in range(2, 8)], (9, None), (10, "")]
    docs = [(i, t) for i, t in enumerate(DISGUISES)] + [(100 + i, t) for i, t in enumerate(CLEAN)] + [(0, ITEM), (200, "word " * 50_000 + ITEM), (None, ITEM)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, n_words int")
    e = spark.createDataFrame([(*r, "z") for r in items], "item_id long, item_text string, text string")
    for words, block in ((1_000_000, 5_000), (10, 3)):
        got = leaked_passages(d, e, words, block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 1) for i in range(len(DISGUISES))} | {(200, 1)}
    spans = {r.doc_id: (r.first_word, r.n_words, r["items"]) for r in removal_spans(leaked_passages(d, e)).collect()}
    assert spans[200] == (50_000, len(plain_words(ITEM)), [1])
    assert leaked_passages(d.limit(0), e).count() == 0 and leaked_passages(d, e.limit(0)).count() == 0


def test_seed_length_covers_every_run():
    # Any run that counts holds SEED agreeing words in a row.
    for a in range(0, leaks.RUN_WORDS + 4):
        for b in range(a + leaks.GAP, leaks.RUN_WORDS + 5):
            same = np.ones(leaks.RUN_WORDS + 2, bool)
            same[[i for i in (a, b) if i < len(same)]] = False
            if longest_run(same)[2] >= leaks.RUN_WORDS:
                runs = "".join("1" if s else "0" for s in same).split("0")
                assert max(map(len, runs)) >= leaks.SEED


def test_exchanged_words_count_within_the_run(spark):
    swap = lambda n, *at: " ".join("other" if i in at else w for i, w in enumerate(WORDS[:n]))
    found = [swap(15, k) for k in range(1, 14)] + [swap(15, 1, 11), swap(15, 3, 13), swap(16, 4, 14)]
    clean = [swap(15, 0), swap(15, 14), swap(15, 3, 12), swap(14, 7), swap(16, 0, 15)]
    docs = [*enumerate(found), *((100 + i, t) for i, t in enumerate(clean))]
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, item_text string"))
    assert {r.doc_id for r in got.collect()} == set(range(len(found)))


def test_longest_run_by_length_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        same = np.array([rnd.random() < 0.85 for _ in range(rnd.randint(0, 45))], bool)
        spans = [(a, z) for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[a] and same[z - 1]]
        miss = lambda a, z: [i for i in range(a, z) if not same[i]]
        assert longest_run(same, by=1)[1] == max((z - a for a, z in spans if all(y - x >= 10 for x, y in zip(miss(a, z), miss(a, z)[1:]))), default=0)


def test_long_and_wrapped_tags():
    half = len(WORDS) // 2
    a, z = " ".join(WORDS[:half]), " ".join(WORDS[half:])
    for tag in (f'<span class="{"wide " * 80}">', '<a\n  href="x y"\n  title=\'z > w\'\n  disabled\n>', '<div onclick={run(1)}\n/>', "<" + "b" * 300 + ">"):
        assert plain_words(f"{a} {tag} {z}") == plain_words(ITEM), tag
    assert plain_words("a <b, and then\nmany words > c") == "a b and then many words c".split()
    inside = leaks.document_words(f'<img\n alt="{ITEM}">')
    assert " ".join(plain_words(ITEM)) in " ".join(inside) and leaks.document_words('<img alt="few words">') == []


def test_long_runs_against_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        same = np.array([rnd.random() < 0.9 for _ in range(rnd.randint(0, 90))], bool)
        spans = [(a, z) for a in range(len(same)) for z in range(a + 15, len(same) + 1) if same[a] and same[z - 1] and all(y - x >= 10 for x, y in zip(np.flatnonzero(~same[a:z]), np.flatnonzero(~same[a:z])[1:]))]
        want = [(a, z - a) for a, z in spans if not any((b, y) != (a, z) and b <= a and z <= y for b, y in spans)]
        assert leaks.long_runs(same) == sorted(want)


def test_own_runs_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        runs = [(7, rnd.randint(1, 4), rnd.randint(0, 30), rnd.randint(15, 30)) for _ in range(rnd.randint(0, 9))]
        want = {r for r in runs if not any(o[1] != r[1] and o[2] <= r[2] and r[2] + r[3] <= o[2] + o[3] and o[3] > r[3] for o in runs)}
        assert set(leaks.own_runs(runs)) == want


def test_items_of_one_template_and_repeated_ids(spark):
    frame = "you are handed {} sparse {} objects filter them by {} then apply whichever {} has the smallest topic it is promised that the item has a signed {} while"
    a, b = (frame.format(*x) for x in (("6", "tag", "header", "dataset", "lease"), ("20", "list", "segment", "task", "lock")))
    items = [(1, a), (2, b), (3, " ".join(f"w{i}" for i in range(20))), (3, " ".join(f"v{i}" for i in range(20))), (4, a)]
    docs = [(1, a), (2, "x " + b + " y"), (3, a + " and " + b), (4, " ".join(f"v{i}" for i in range(17))), (5, " ".join(f"w{i}" for i in range(16)))]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    want = {(1, 1), (1, 4), (2, 2), (3, 1), (3, 4), (3, 2), (4, 3), (5, 3)}
    for block in (5_000, 1):  # the second: every item in a block of its own
        assert {(r.doc_id, r.item_id) for r in leaked_passages(d, e, block=block).collect()} == want


def test_shared_openings_count_over_all_items(spark):
    e = spark.createDataFrame([(i, f"Answer with code only. Then {i} more words of item {i}.") for i in range(6)] + [(9, "Own text. More."), (10, None)], "item_id long, item_text string")
    assert {r.item_id: r.skip for r in leaks.shared_openings(e).collect()} == {**{i: 1 for i in range(6)}, 9: 0}
