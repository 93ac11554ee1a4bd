from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from quadrant.llm import line_kinds as lk
from quadrant.llm.line_features import Lines, pieces

PROSE = "The gate by the old bridge is closed in the evening, and nobody has told the visitors. We went round by the road and found that it was open."
CASES = {
    "prose": [PROSE, PROSE.upper(), PROSE.replace(". ", ".\n"), "\n".join(PROSE[i : i + 60] for i in range(0, len(PROSE), 60)), "Die Tür bei der Brücke ist seit dem Regen geschlossen und wird nicht geöffnet.", "小さな橋で右に曲がってください。中庭の扉は閉まっています。", PROSE + "\n- red door\n- blue door", "lowercase text that has no full stop in it but is read by the people of the town"],
    "list": ["- red door\n- blue door\n- green gate\n- old bridge", "1. red door\n2. blue door\n3. green gate", "red door\nblue door\ngreen gate\nold bridge", "red door / blue door / green gate / old bridge / lower steps"],
    "table": ["kind\tn\tcode\ndoor\t12\tA-1\ngate\t7\tB-22\nlamp\t90\tC-3", "| a | b |\n|---|---|\n| door | 12 |\n| gate | 9 |\n| lamp | 3 |", "n=1; kind=door; lat=3.5\nn=2; kind=gate; lat=4.5\nn=3; kind=lamp; lat=5.5", "<table>\n<tr><td>door</td><td>1</td></tr>\n<tr><td>gate</td><td>2</td></tr>\n</table>"],
    "junk": ["ha" * 60, "." * 200, "word " * 60, "%A1%B2%C3%D4%E5%F6" * 20, "00000000: 7d ae d3 b4 1f 57 d0 ec a4 9f 59 61 46 db b0 cc\n00000010: 7d ae d3 b4 1f 57 d0 ec", "Rjcws1A2O+pTRJaGyrvgsVdRSHQ7lEloUoLO8RDIcp9Xs0DnbWgMA58sDimMVZ9HFOV7aoWs8Hh", "#^^!^+,}?, |;~`,+^@!$.]/{:*& ,}.~)|-* ?|~@{>['_& .*<-^^ _@}')$", "\x1b[31ma09f \x1b[32mb77c1 \x1b[33mc81d"],
}


@pytest.fixture(scope="module")
def model():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    return lk.fit_model([t[: lk.SAMPLE_CHARS] for t in texts[:3_000] if t and t.strip()])


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in CASES.items() for t in texts])
def test_kinds(kind, text, model):
    (share,) = lk.label_texts([text], model)
    assert abs(sum(share) - 1) < 1e-9
    if kind == "prose":
        assert share[lk.PROSE] > 0.25
    else:
        assert share[lk.PROSE] < 0.25 and lk.KINDS[1 + max(range(3), key=share[1:].__getitem__)] == kind


def test_repeated_sentences_are_junk(model):
    assert lk.label_texts(["The gate is closed. " * 40], model) == [[0, 0, 0, 1]]


def test_labels_do_not_depend_on_the_batch(model):
    texts = [t for ts in CASES.values() for t in ts] + [None, "", " "]
    together = lk.label_texts(texts, model)
    assert together == [lk.label_texts([t], model)[0] for t in texts] and together[-3:] == [None] * 3


def small_chain():
    rng = np.random.default_rng(3)
    text = np.repeat([0, 1, 2], [4, 1, 3])
    return text, np.log(rng.dirichlet(np.ones(4), len(text))), np.log(rng.dirichlet(np.ones(4))), np.log(rng.dirichlet(np.ones(4), 4))


def test_posteriors_and_path_against_all_paths():
    text, emitted, start, change = small_chain()
    gamma, moved = lk.posteriors(text, emitted, start, change)
    path = lk.best_path(text, emitted, start, change)
    want_moved = np.zeros((4, 4))
    for t in range(3):
        at = np.flatnonzero(text == t)
        weights = {p: start[p[0]] + sum(change[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(emitted[i, k] for i, k in zip(at, p, strict=True)) for p in product(range(4), repeat=len(at))}
        total = sum(np.exp(w) for w in weights.values())
        for j, i in enumerate(at):
            assert np.allclose(gamma[i], [sum(np.exp(w) for p, w in weights.items() if p[j] == k) / total for k in range(4)])
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                want_moved[a, b] += np.exp(w) / total
        assert tuple(path[at]) == max(weights, key=weights.get)
    assert np.allclose(moved, want_moved)


def test_fitting_raises_the_likelihood_of_a_chain():
    rng = np.random.default_rng(8)
    states = [0]
    for _ in range(2_000):
        states.append(states[-1] if rng.random() < 0.95 else rng.integers(4))
    true = np.full((4, 4), 0.05) + np.eye(4) * 0.8
    seen = np.array([rng.choice(4, p=true[s]) for s in states])
    text, start, change = np.zeros(len(seen), int), np.log(np.full(4, 0.25)), np.log(np.full((4, 4), 0.1) + np.eye(4) * 0.6)
    emit = np.full((4, 4), 0.15) + np.eye(4) * 0.4
    for _ in range(10):
        gamma, moved = lk.posteriors(text, np.log(emit[:, seen].T), start, change)
        emit = np.stack([np.bincount(seen, gamma[:, k], 4) for k in range(4)])
        emit /= emit.sum(axis=1, keepdims=True)
        change = np.log(moved / moved.sum(axis=1, keepdims=True))
    assert np.abs(emit - true).max() < 0.1 and abs(np.exp(np.diag(change)).mean() - 0.9625) < 0.03


def test_pieces_keep_every_character():
    text = "word " * 500 + "\n" + "x" * 1_000 + "\r\n\n  end"
    assert "".join("".join(p.split()) for p, _ in pieces(text)) == "".join(text.split())
    assert Lines([text, ""]).chars.sum() == len("".join(text.split()))


def test_rows(spark):
    rows = [(1, PROSE, None), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "ha" * 100, "x"), (6, PROSE + " " + "x" * 300_000, None), (1, PROSE, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "lang as kind")
    got = {r["doc_id"]: (r["prose"], r["kind"]) for r in lk.label_documents(frame.unionByName(corpus)).collect()}
    assert got[1] == (1.0, None) and got[2] == got[3] == got[4] == (None, None) and got[5][1] == got[6][1] == "junk"
    assert lk.label_documents(frame.limit(0)).count() == 0
    stats = {r["doc_id"]: r for r in lk.text_statistics(frame).collect()}
    assert stats[2]["words"] == 0 and stats[2]["mean_word"] is None and stats[5]["mean_word"] == 200
    assert stats[1]["ended_lines"] == 1 and stats[1]["words"] == len(PROSE.split())


def test_the_model_comes_from_every_line_of_whole_documents(spark):
    held = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts = ["\n".join(t or "" for t in held[i : i + 8]) for i in range(0, len(held), 8)]
    assert max(map(len, texts)) > 5_000
    want = lk.label_texts(texts, lk.fit_model(texts))
    for parts in (1, 5):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {r["doc_id"]: [r[k] for k in lk.KINDS] for r in lk.label_documents(frame).collect()}
        assert [got[i] for i in range(len(texts))] == want
