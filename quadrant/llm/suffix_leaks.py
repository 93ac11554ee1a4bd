"""Held-out texts found again inside a training corpus.

Each task builds the suffix array of a shard of the training text (whole documents, about SHARD_WORDS words; every word has an id) and
binary-searches the suffixes of the held-out items in it, all at once, word by word. The places that agree are joined along
their diagonals and extended to the longest verbatim match on both sides; matches that follow each other in document and item with at most GAP
words changed between them form a chain. A document carries an item if its chains cover enough of the item's own words. Documents never
shuffle; what is broadcast is the held-out set, whose size is checked before it is gathered.

Words are compared after Unicode compatibility folding, without case, punctuation, markup, invisible characters and line-end hyphens. Wording
that two different items share is a phrase if the longest shared run around it has at most PHRASE words: it starts no match, and the words
of longer phrases (instructions) do not count. A longer shared run is a passage, and belongs to every item that has it, however many they are.

How much is enough follows the task's rule of CASE_WORDS words: FOUND_SHARE of them, as odd words may be changed, or of the item's own words if it
has fewer; never PHRASE_RULE words or fewer. So an item of twelve own words is found when nine of them are copied, and one of eight or fewer never.

Defined results: null, empty and blank texts carry nothing and leak nothing; items of equal wording leak together; repeated
documents are each reported; a document longer than a shard has a shard of its own, so nothing is cut; an empty table on either side gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_WORDS = 1_000_000
#: A match is looked up by so many words; pairs find what three miss where every third word was changed.
SEEDS = (2, 3)
#: The task's rule: a case has CASE_WORDS own words, a phrase of PHRASE_RULE words is none.
CASE_WORDS, PHRASE_RULE = 18, 8
FOUND_SHARE = 0.75
#: A run shared by items is a phrase up to so many words (two phrases may meet), an instruction from so many.
PHRASE, INSTRUCTION = 12, 5
#: Words that may differ between two matches of a chain, and the least words of a chain.
GAP, CHAIN_WORDS = 3, 4
#: The held-out set must stay small enough to send to every executor: at most so many characters.
MAX_ITEM_CHARS = 50_000_000

INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")
BREAK_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t>]*(?=\w)")
INLINE_TAG = re.compile(r"</?(?:b|i|u|a|em|strong|span|code|mark|small|sub|sup|font|q|s|wbr)\b[^<>]*>", re.IGNORECASE)
TAG = re.compile(r"<[!/?a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "-" in text:
        text = BREAK_HYPHEN.sub("", text)
    return WORD.findall(text.casefold())


class Items:
    """The held-out set as one array of word ids; 0 ends every item and is no word."""

    def __init__(self, ids: list[int], texts: list[str | None]) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[list[int]] = []
        distinct: dict[tuple, int] = {}
        parts: list[int] = []
        self.start: list[int] = []
        for key, text in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
            words = tuple(words_of(text))
            if not words:
                continue
            if words in distinct:
                self.ids[distinct[words]].append(key)
                continue
            distinct[words] = len(self.ids)
            self.ids.append([key])
            self.start.append(len(parts))
            parts.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
            parts.append(0)
        self.words = np.array(parts + [0] * (PHRASE + 2), np.int64)
        self.item = np.repeat(np.arange(len(self.start)), np.diff([*self.start, len(parts)])) if parts else np.zeros(0, np.int64)
        self.longest = max(np.diff([*self.start, len(parts)]), default=0)
        self._tell_phrases()

    def _tell_phrases(self) -> None:
        """Sets ``seeds`` (by length, the starts of runs that are no phrases), ``own`` (words outside instructions) and ``least`` (by item)."""
        n = len(self.item)
        code, shared = np.zeros(n, np.int64), {}
        whole = np.ones(n, bool)
        reach = np.zeros(n, np.int64)
        for k in range(1, PHRASE + 2):
            word = self.words[k - 1 : n + k - 1]
            whole = whole & (word > 0)
            at = np.flatnonzero(whole)
            if not len(at):
                break
            _, code[at] = np.unique(code[at] * (len(self.number) + 1) + word[at], return_inverse=True)
            owners = np.bincount(np.unique(code[at] * (len(self.ids) + 1) + self.item[at]) // (len(self.ids) + 1))
            shared[k] = np.zeros(n, bool)
            shared[k][at] = owners[code[at]] > 1
            reach[shared[k]] = k
        # The longest shared run that covers a run of k words from each place.
        self.seeds = {}
        cover = {k: np.zeros(n, np.int64) for k in (1, *SEEDS)}
        for back in range(PHRASE + 1):
            before = np.r_[np.zeros(min(back, n), np.int64), reach[: n - back]] if back else reach
            for k, best in cover.items():
                np.maximum(best, np.where(before >= back + k, before, 0), out=best)
        for k in SEEDS:
            valid = np.array([self.words[i : n + i] for i in range(k)]).all(axis=0) if n else np.zeros(0, bool)
            phrase = shared.get(k, np.zeros(n, bool)) & (cover[k] <= PHRASE)
            self.seeds[k] = np.flatnonzero(valid & ~phrase)
        self.own = (self.words[:n] > 0) & ~((cover[1] >= INSTRUCTION) & (cover[1] <= PHRASE))
        own_words = np.bincount(self.item, self.own, len(self.ids))
        self.least = np.maximum(PHRASE_RULE + 1, np.ceil(FOUND_SHARE * np.minimum(CASE_WORDS, own_words))).astype(np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` that hold a word (not 0), sorted by the ``depth`` words from there; by prefix doubling."""
    at = np.flatnonzero(words)
    rank = np.zeros(len(words) + 1, np.int64)
    _, first = np.unique(words[at], return_inverse=True)
    rank[at] = first + 1
    order, span = np.argsort(rank[at], kind="stable"), 1
    while span < depth:
        key = rank[at] * (len(at) + 2) + rank[np.minimum(at + span, len(words))]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.cumsum(np.r_[1, (np.diff(ordered) != 0).astype(np.int64)])
        rank[at[order]] = fresh
        span *= 2
        if fresh[-1] == len(at):
            break
    return at[order]


def search(words: np.ndarray, array: np.ndarray, wanted: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts that are found, first, last) of the suffixes that begin with the ``depth`` wanted words from each start."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    for step in range(depth):
        word = wanted[starts + step]
        low, high = _bound(words, array, low, high, step, word, False), _bound(words, array, low, high, step, word, True)
        keep = low < high
        starts, low, high = starts[keep], low[keep], high[keep]
        if not len(starts):
            break
    return starts, low, high


def _bound(words: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, word: np.ndarray, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        seen = words[np.minimum(array[np.minimum(middle, len(array) - 1)] + step, len(words) - 1)]
        right = open_ & ((seen <= word) if after else (seen < word))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


def matches(words: np.ndarray, items: Items) -> np.ndarray:
    """Rows (position in the shard, position in the items, length) of the longest verbatim matches that hold a seed."""
    if not words.any():
        return np.zeros((0, 3), np.int64)
    array = suffix_array(words, max(*SEEDS, int(items.longest)))
    heres, ats, sizes = [], [], []
    for k, seeds in items.seeds.items():
        if not len(seeds):
            continue
        starts, low, high = search(words, array, items.words, seeds, k)
        count = high - low
        ats.append(np.repeat(starts, count))
        heres.append(array[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        sizes.append(np.full(len(ats[-1]), k))
    here, item_at, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heres, ats, sizes))
    if not len(here):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((item_at, here - item_at))
    here, item_at, size = here[order], item_at[order], size[order]
    # Seeds that touch on one diagonal are one match.
    line = np.cumsum(np.r_[0, np.diff(here - item_at) != 0]) * (len(items.words) + len(words))
    end = np.maximum.accumulate(line + item_at + size)
    first = np.flatnonzero(np.r_[True, (line + item_at)[1:] > end[:-1]])
    length = np.r_[end[first[1:] - 1], end[-1]] - line[first] - item_at[first]
    here, item_at = here[first], item_at[first]
    for side in (-1, 1):
        open_ = np.arange(len(here))
        while len(open_):
            a = here[open_] - 1 if side < 0 else here[open_] + length[open_]
            b = item_at[open_] - 1 if side < 0 else item_at[open_] + length[open_]
            fits = (a >= 0) & (b >= 0) & (a < len(words)) & (b < len(items.words))
            fits[fits] = (words[a[fits]] > 0) & (words[a[fits]] == items.words[b[fits]])
            open_ = open_[fits]
            length[open_] += 1
            if side < 0:
                here[open_] -= 1
                item_at[open_] -= 1
    return np.unique(np.stack([here, item_at, length], axis=1), axis=0)


def chained(found: np.ndarray, document: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which of the matches, sorted by document, item and place, lie in a chain of at least CHAIN_WORDS words."""
    here, at, length = found.T
    chain = np.arange(len(found))
    links = []
    for step in range(1, GAP + 2):
        a, b = chain[:-step], chain[step:]
        gap, item_gap = here[b] - here[a] - length[a], at[b] - at[a] - length[a]
        near = (document[a] == document[b]) & (item[a] == item[b]) & (gap <= GAP) & (item_gap <= GAP) & (gap > -length[b]) & (item_gap > -length[b])
        links.append((a[near], b[near]))
    one, other = (np.concatenate(x) for x in zip(*links, strict=True)) if len(found) > 1 else (chain[:0], chain[:0])
    while True:
        low = np.minimum(chain[one], chain[other])
        before = chain.copy()
        np.minimum.at(chain, one, low)
        np.minimum.at(chain, other, low)
        chain = chain[chain]
        if (chain == before).all():
            break
    return np.bincount(chain, length, len(found))[chain] >= CHAIN_WORDS


def leaks_in_shard(ids: list[int], texts: list[list[int]], items: Items, min_words: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, item, own words covered, longest match, its word offset in the document)."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()) + 1, np.int64)
    for at, text in zip(start, texts, strict=True):
        words[at : at + len(text)] = text
    found = matches(words, items)
    if not len(found):
        return []
    document = np.searchsorted(start, found[:, 0], side="right") - 1
    item = items.item[found[:, 1]]
    order = np.lexsort((found[:, 0], item, document))
    found, document, item = found[order], document[order], item[order]
    keep = chained(found, document, item)
    found, document, item = found[keep], document[keep], item[keep]
    if not len(found):
        return []
    order = np.lexsort((found[:, 1], item, document))
    found, document, item = found[order], document[order], item[order]
    own = np.r_[0, np.cumsum(items.own)]
    cut = np.flatnonzero(np.r_[True, (np.diff(document) != 0) | (np.diff(item) != 0)])
    rows = []
    for low, high in zip(cut, [*cut[1:], len(found)], strict=True):
        covered, reach = 0, -1
        for at, length in found[low:high, 1:]:
            if at + length > reach:
                covered += own[at + length] - own[max(reach, at)]
                reach = at + length
        if covered >= (items.least[item[low]] if min_words is None else min_words):
            best = found[low + int(np.argmax(found[low:high, 2]))]
            doc = int(document[low])
            rows += [(ids[doc], key, int(covered), int(best[2]), int(best[0] - start[doc])) for key in items.ids[int(item[low])]]
    return rows


def find_leaks(corpus: DataFrame, held_out: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", min_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, words, longest, word_at) of every document that carries an item; ``min_words`` replaces the rule for how much is enough."""
    wanted = held_out.select(held_out[item_column].cast("long").alias("i"), held_out[text_column].alias("t")).filter("t is not null")
    chars = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars > MAX_ITEM_CHARS:
        raise ValueError(f"the held-out set has {chars} characters, more than {MAX_ITEM_CHARS} to send to every executor; split it and join the results")
    rows = wanted.collect()
    sent = corpus.sparkSession.sparkContext.broadcast({"rows": ([r["i"] for r in rows], [r["t"] for r in rows])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps the broadcast value between tasks, and so the index.
        held = sent.value
        if "items" not in held:
            held["items"] = Items(*held.pop("rows"))
        own = held["items"]
        ids, texts, size = [], [], 0
        number = dict(own.number)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [number.setdefault(w, len(number) + 1) for w in words_of(text.as_py())]
                ids.append(key)
                texts.append(words)
                size += len(words)
                if size >= SHARD_WORDS:
                    yield _leak_batch(leaks_in_shard(ids, texts, own, min_words))
                    ids, texts, size, number = [], [], 0, dict(own.number)
        if ids:
            yield _leak_batch(leaks_in_shard(ids, texts, own, min_words))

    return corpus.select(corpus[id_column].cast("long").alias("doc_id"), corpus[text_column].alias("text")).mapInArrow(run, "doc_id long, item_id long, words int, longest int, word_at int")


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("longest", pa.int32()), ("word_at", pa.int32())]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def without_leaks(corpus: DataFrame, leaks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The corpus without the documents that carry an item."""
    return corpus.join(leaks.select(leaks["doc_id"].alias(id_column)).distinct(), id_column, "left_anti")
