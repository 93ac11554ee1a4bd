import random

import numpy as np

from quadrant.llm import suffix_leaks as sl

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
VOCABULARY = [f"w{i}" for i in range(400)]


def item(rng, n=40):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    words = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(300)] + [0])
    array = sl.suffix_array(words, 64)
    cut = lambda p: tuple(words[p : p + 64])
    head = lambda t: t[: t.index(0)] if 0 in t else t
    assert sorted(array) == list(np.flatnonzero(words))
    assert all(head(cut(a)) <= head(cut(b)) or cut(a) <= cut(b) for a, b in zip(array, array[1:], strict=False))


def longest(words, own):
    best = 0
    for i in range(len(words)):
        for j in range(len(own)):
            n = 0
            while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_matches_against_brute_force():
    rng = random.Random(2)
    items = [item(rng) for _ in range(12)]
    model = sl.Items(list(range(12)), [" ".join(t) for t in items])
    texts = []
    for _ in range(60):
        text = [rng.choice([*VOCABULARY, "other", "more"]) for _ in range(rng.randrange(30))]
        own, at = rng.choice(items), rng.randrange(20)
        text[len(text) // 2 : len(text) // 2] = own[at : at + rng.randrange(3, 20)]
        texts.append(text)
    rows = sl.leaks_in_shard(list(range(60)), [[model.number.get(w, 0) for w in t] for t in texts], model, 4)
    found = {(d, i): n for d, i, _, n, _ in rows}
    for d, text in enumerate(texts):
        for i, own in enumerate(items):
            n = longest(text, own)
            if n >= 4:
                assert found[d, i] == n
    for d, i, _, n, at in rows:
        assert " ".join(texts[d][at : at + n]) in " ".join(items[i])


def test_disguises_and_edges(spark):
    rng = random.Random(3)
    one, two = item(rng), item(rng)
    plain = " ".join(one)
    marked = "<p>" + " ".join(f"<b>{w.upper()}</b>," if i % 3 else f"{w}&nbsp;--" for i, w in enumerate(one)) + "</p>"
    parts = " ".join(one[25:]) + ". " + "filler words here. " + " ".join(one[:20])
    docs = [(1, "x " + plain + " y", None), (2, marked, None), (3, parts, None), (4, " ".join(one[:8]) + " and more", None), (5, None, None), (6, "", None), (7, "choose the best answer of all now", None), (1, "x " + plain + " y", None), (8, "pad " * 1_200_000 + plain, None)]
    held = [(10, "choose the best answer of all now " + plain, None), (11, "choose the best answer of all now " + " ".join(two), None), (12, None, None), (13, "", None), (14, "choose the best answer of all now " + plain, None)]
    held += [(20 + i, "choose the best answer of all now " + " ".join(item(rng)), None) for i in range(4)]
    leaks = sl.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(held, ITEMS))
    assert sorted({(r["doc_id"], r["item_id"]) for r in leaks.collect()}) == [(d, i) for d in (1, 2, 3, 8) for i in (10, 14)]
    kept = sl.without_leaks(spark.createDataFrame(docs, DOCS), leaks)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]
    empty = spark.createDataFrame([], DOCS)
    assert sl.find_leaks(empty, spark.createDataFrame(held, ITEMS)).count() == 0
    assert sl.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_items_that_share_a_passage_all_leak(spark):
    rng = random.Random(5)
    passage = item(rng, 60)
    for owners in (1, 3, 8, 30):
        held = [(i, " ".join(passage + item(rng, 12)), None) for i in range(owners)]
        leaks = sl.find_leaks(spark.createDataFrame([(1, "so " + " ".join(passage) + " it", None)], DOCS), spark.createDataFrame(held, ITEMS))
        assert sorted(r["item_id"] for r in leaks.collect()) == list(range(owners))


def test_short_items_and_changed_words():
    rng = random.Random(6)
    short, tiny, long = item(rng, 12), item(rng, 8), item(rng, 60)
    model = sl.Items([1, 2, 3], [" ".join(t) for t in (short, tiny, long)])
    numbered = lambda ws: [model.number.get(w, 10_000 + i) for i, w in enumerate(ws)]
    broken = [w if i % 3 < 2 else f"changed{i}" for i, w in enumerate(long)]
    rows = sl.leaks_in_shard([1, 2, 3, 4], [numbered(t) for t in (short, tiny, broken, long[:9])], model)
    assert {(d, i): n for d, i, n, _, _ in rows} == {(1, 1): 12, (3, 3): 40}


def test_scattered_pairs_of_a_long_text_are_no_leak():
    rng = random.Random(7)
    one = item(rng, 60)
    model = sl.Items([1], [" ".join(one)])
    text = []
    for at in range(0, 56, 2):
        text += [model.number[w] for w in one[at : at + 2]] + [90_000 + rng.randrange(10_000) for _ in range(20)]
    assert sl.leaks_in_shard([1], [text], model) == []
