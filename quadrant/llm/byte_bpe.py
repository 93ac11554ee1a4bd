"""Byte-level BPE encoding of a whole corpus.

The texts of an Arrow batch are cut into words; the distinct words' bytes lie in one flat
array, and every round merges, in all words at once, the adjacent pair of lowest rank. Ranks are
found by binary search over the sorted keys of all mergeable pairs. A word of more than LONG_WORD bytes, for which such rounds would cost its
length squared, is merged by a heap of its pairs instead, to the same ids.

Defined results: an empty or null text gives an empty list, never null; blank text is encoded like any
other; every row of the input gives one row, repeated texts included; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public word pattern of this vocabulary (white space as Unicode defines it).
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SPLITTER = regex.compile(WORD)

BLOCK_CHARS = 2_000_000
NO_RANK = np.int64(1) << 40
#: Bytes from which a word is merged by a heap: rounds over all its symbols would cost its length squared.
LONG_WORD = 256


@lru_cache(maxsize=4)
def load_merges(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(byte -> id, sorted pair keys, id each pair merges into, number of ids).

    The file gives only tokens; the pair a token is merged from is what is left of it after applying all
    merges of lower rank to its bytes.
    """
    ids: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ids[base64.b64decode(token)] = int(rank)
    size = max(ids.values()) + 1
    single = np.zeros(256, np.int64)
    keys, made = [], []
    for token, rank in ids.items():
        if len(token) == 1:
            single[token[0]] = rank
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(ids.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            low, at = min(ranked)
            if low >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            keys.append(ids[parts[0]] * size + ids[parts[1]])
            made.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return single, np.array(keys, np.int64)[order], np.array(made, np.int64)[order], size


def encode_long(word: bytes, merges: tuple[np.ndarray, np.ndarray, np.ndarray, int], ranks: dict[int, int]) -> np.ndarray:
    """Ids of one word by a heap of its pairs over a linked list of its symbols: the same merges, lowest rank first and leftmost of equals, in a time that grows
    about in proportion to the word's length. ``ranks`` holds what each mergeable pair becomes."""
    single, keys, made, size = merges
    codes = single[np.frombuffer(word, np.uint8)]
    pair = codes[:-1] * size + codes[1:]
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    known = np.flatnonzero(keys[at] == pair)
    heap = ((made[at[known]] << 32) | known).tolist()
    heapq.heapify(heap)
    n = len(codes)
    symbol, after, before = codes.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop, low = ranks.get, heapq.heappush, heapq.heappop, (1 << 32) - 1
    while heap:
        item = pop(heap)
        i, rank = item & low, item >> 32
        j = after[i]
        if symbol[i] < 0 or j >= n or get(symbol[i] * size + symbol[j]) != rank:
            continue
        symbol[i], symbol[j] = rank, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = get(rank * size + symbol[k])
            if new is not None:
                push(heap, (new << 32) | i)
        h = before[i]
        if h >= 0:
            new = get(symbol[h] * size + rank)
            if new is not None:
                push(heap, (new << 32) | h)
    return np.array([c for c in symbol if c >= 0], np.int32)


def encode_words(words: list[bytes], merges: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and each word's number of ids; words of more than LONG_WORD bytes go one by one."""
    long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
    if not long:
        return _merge_rounds(words, merges)
    ranks = dict(zip(merges[1].tolist(), merges[2].tolist(), strict=True))
    apart = {i: encode_long(words[i], merges, ranks) for i in long}
    ids, count = _merge_rounds([w if len(w) <= LONG_WORD else b"" for w in words], merges)
    bounds, parts, start = np.cumsum(count), [], 0
    for i in long:
        parts += [ids[start : bounds[i]], apart[i]]
        start = bounds[i]
        count[i] = len(apart[i])
    return np.concatenate([*parts, ids[start:]]), count


def _merge_rounds(words: list[bytes], merges: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Merge rounds over the symbols of all words in one flat array: each round merges every word's lowest-ranked pairs."""
    single, keys, made, size = merges
    length = np.fromiter(map(len, words), np.int64, len(words))
    symbols = single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), length)
    done_symbols, done_word = [], []
    while len(symbols):
        pair = symbols[:-1] * size + symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (word[:-1] == word[1:]), made[at], NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.r_[starts, len(symbols)])
        lowest = np.repeat(lowest, counts)
        finished = lowest == NO_RANK
        if finished.any():
            done_symbols.append(symbols[finished])
            done_word.append(word[finished])
            keep = ~finished
            symbols, word, rank, lowest = symbols[keep], word[keep], rank[keep], lowest[keep]
            if not len(symbols):
                break
        hit = np.flatnonzero(rank == lowest)
        # A run of touching hits ("aaaa") merges at its 1st, 3rd, ... member only.
        run_start = np.r_[True, np.diff(hit) != 1]
        in_run = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
        hit = hit[in_run % 2 == 0]
        symbols = symbols.copy()
        symbols[hit] = rank[hit]
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        symbols, word = symbols[stay], word[stay]
    if not done_symbols:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return symbols[order].astype(np.int32), np.bincount(word, minlength=len(words))


def encode_texts(texts: list[str | None], merges: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and each text's number of ids."""
    seen: dict[str, int] = {}
    codes: list[int] = []
    words_of = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = SPLITTER.findall(text)
            words_of[i] = len(found)
            codes.extend([seen.setdefault(w, len(seen)) for w in found])
    ids, count = encode_words([w.encode() for w in seen], merges)
    first = np.cumsum(count) - count
    code = np.array(codes, np.int64)
    size = count[code]
    ends = np.cumsum(size)
    gather = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first[code], size)
    bounds = np.r_[0, np.cumsum(words_of)]
    total = np.r_[0, ends]
    return ids[gather], np.diff(total[bounds])


def encode_corpus(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row. The merge table (the vocabulary's fixed 50 thousand pairs) is broadcast, texts never shuffle."""
    spark: SparkSession = frame.sparkSession
    shared = spark.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars < BLOCK_CHARS):
                    chars += len(texts[stop] or "")
                    stop += 1
                ids, sizes = encode_texts(texts[start:stop], merges)
                offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start).cast(pa.int64()), lists], names=[id_column, "ids"])
                start = stop

    return frame.select(frame[id_column].cast("long").alias(id_column), text_column).mapInArrow(run, f"{id_column} long, ids array<int>")
