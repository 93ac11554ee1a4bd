import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrant.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
MERGES = byte_bpe.load_merges(byte_bpe.VOCABULARY)


def reference():
    with open(byte_bpe.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.WORD.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})


ORACLE = reference()


def encode(texts):
    ids, sizes = byte_bpe.encode_texts(texts, MERGES)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(texts):
    assert encode(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def test_runs_and_long_words():
    texts = ["a" * 5000, "aaa aa aaaa", "0" * 999, " \n\n ", "<|endoftext|>", "hello" * 3000, "é́😀", "don't I'LL"]
    assert encode(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def test_rows(spark):
    rows = [(1, "one two", "x"), (2, None, "x"), (3, "", None), (1, "one two", "x")]
    got = byte_bpe.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == [(1, ORACLE.encode_ordinary("one two"))] * 2 + [(2, []), (3, [])]
    assert byte_bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_take_the_same_ids_in_little_time():
    import random
    import time

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (255, 256, 257, 5_000)] + ["aaab" * 3_000, "x" * 4_001, "ab " + "é漢" * 900 + " short words between", "base64/" * 700]
    assert encode(texts) == [ORACLE.encode(t) for t in texts]
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.process_time()
    (ids,) = encode([long])
    assert time.process_time() - began < 3 and b"".join(ORACLE.decode_single_token_bytes(i) for i in ids) == long.encode()
