"""What a document consists of, line by line: prose, list, table or junk; and per-document text statistics.

A hidden Markov model labels the lines. Its states are the four kinds; what a line shows is the nearest entry of a codebook over the line's statistics
(line_features). Codebook, emission and transition probabilities are fitted here, on every line of every whole document: the codebook by k-means, the
probabilities by Baum-Welch from a first guess that only tells clear lines (first_guess). How letters follow one another in readable text is learnt from all
lines too. Viterbi's path then labels every line, and shares are counted by characters.

Statistics are worked out once and kept on the executors' disks, packed, as whole multiples of 1 / GRAIN; each round of a fit is a pass over them whose sums the driver gets, a
fixed number of figures a task. Where k-means begins or an entry is split, a line is drawn by a hash among all. All sums are of whole numbers, so the same rows give the same model in whatever order and
tasks they come.

Defined results: null, empty and blank texts have no lines, hence null shares and no kind; a text without
letters can be a table or junk, never prose of a letter script; repeated documents are labelled alike; an empty table gives no rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.llm.line_features import NAMES, Lines, letter_columns, letter_fits
from quadrant.sources.tables import cut

#: Characters of a text that fitting reads: all.
SAMPLE_CHARS = None
#: The codebook begins with CODES lines and takes in one of each of the MORE entries that describe theirs worst, in each of ROUNDS rounds.
CODES, MORE, ROUNDS, FITS, PRIOR, LEAN = 320, 48, 7, 8, 4.0, 1.0
#: Statistics that count for more than the others in the distance to a line of the codebook.
EMPHASIS = {"new_tokens": 2.5, "repeats": 2.0, "bars": 2.0}
#: A document is of a kind if more than this share of its characters is not prose.
NOT_PROSE = 0.75
#: Texts and characters (but for a longer text) handled at once.
AT_ONCE, CHARS_AT_ONCE = 4_000, 500_000
#: Statistics are kept as multiples of 1 / GRAIN, probabilities are summed as multiples of 1 / FINE.
GRAIN, FINE = 2_048, 2.0**30
#: Tasks whose sums the driver adds up itself; those of more are added up by some tasks first.
ADDED = 64

KINDS = ["prose", "list", "table", "junk"]
PROSE, LIST, TABLE, JUNK = range(4)

# Common words of five languages, for the statistics only.
COMMON = frozenset(
    """
the a an of to in is and on at by for that this with from it as be or not was were are you if but has have had which who what when where
your please there then than so do does could can before after while since until because its we they their
la le les du et est un une dans pour que qui ne pas par sur au ce se nous plus avec
el los las una es no del al su está como lo más para con por hay ya desde hasta
o os um uma e não do da dos das na em ao fica depois está
der die das den dem des und ist im zu von mit auf für nicht ein eine einen wir man sich als auch bei nach wird seit
""".split()
)


@dataclass
class LineModel:
    """Scaled codebook and log probabilities of the hidden Markov model."""

    odds: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    codebook: np.ndarray
    start: np.ndarray
    change: np.ndarray
    emit: np.ndarray

    def codes(self, features: np.ndarray) -> np.ndarray:
        """The nearest entry of the codebook to each line."""
        return _nearest(_scaled(_kept(features), self.middle, self.scale), self.codebook)


#: What a step finds in a chunk: arrays, which are added up but for those that _together names.
Found = dict[str, np.ndarray]
#: Runs a step over all chunks and adds up what it finds.
Total = Callable[..., Found]


def _kept(features: np.ndarray) -> np.ndarray:
    """Statistics as multiples of 1 / GRAIN, a row a statistic."""
    return np.ascontiguousarray(np.clip(np.rint(features.T * GRAIN), -32_767, 32_767).astype(np.int16))


def _scaled(kept: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(((kept / GRAIN - middle[:, None]) / scale[:, None]).T)


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry to each row, in single precision and exactly where that leaves doubt: what is looked up together makes no difference."""
    code = np.zeros(len(rows), np.int64)
    against = np.c_[book, -(book**2).sum(axis=1) / 2].astype(np.float32).T
    wide = np.c_[rows, np.ones(len(rows))].astype(np.float32)
    margin = (1e-3 + 2e-5 * (rows**2).sum(axis=1)).astype(np.float32)
    for low in range(0, len(rows), 512):
        score = wide[low : low + 512] @ against
        every = np.arange(len(score))
        best = score.argmax(axis=1)
        code[low : low + 512] = best
        least = score[every, best] - margin[low : low + 512]
        score[every, best] = -np.inf
        row = np.flatnonzero(score.max(axis=1) >= least)
        if len(row):
            score[row, best[row]] = np.inf
            at, entry = np.nonzero(score[row] >= least[row, None])
            away = ((rows[low + row[at]] - book[entry]) ** 2).sum(axis=1)
            order = np.lexsort((entry, away, at))
            first = order[np.r_[True, np.diff(at[order]) != 0]]
            code[low + row] = entry[first]
    return code


def _hash(kept: np.ndarray, turn: int) -> np.ndarray:
    """A number between 0 and 1 for each line, the same for the same statistics."""
    h = np.full(kept.shape[1], 0x9E3779B97F4A7C15 * (2 * turn + 1) % (1 << 64), np.uint64)
    for row in kept:
        h = (h ^ row.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _first(keys: np.ndarray, rows: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` distinct rows of the lowest keys, each behind its key; the same rows have the same key."""
    some = np.flatnonzero(keys <= np.partition(keys, keep * 2)[keep * 2]) if len(keys) > keep * 2 else np.arange(len(keys))
    found = np.unique(np.c_[keys[some], rows[some]], axis=0)[:keep]
    if len(found) < keep and len(some) < len(keys):
        found = np.unique(np.c_[keys, rows], axis=0)[:keep]
    return found


def _together(found: Iterable[Found]) -> Found:
    """What steps found in several chunks; of ``seeds`` the first rows by key are kept, of ``drawn`` the one of the lower key in each place."""
    total: Found = {}
    for part in found:
        for name, value in part.items():
            if name not in total:
                total[name] = value
            elif name == "seeds":
                both = np.concatenate([total[name], value])
                total[name] = _first(both[:, 0], both[:, 1:], CODES)
            elif name == "drawn":
                total[name] = np.where(value[:, :1] < total[name][:, :1], value, total[name])
            else:
                total[name] = total[name] + value
    return total


def _pack(value: object) -> bytes:
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> object:
    return pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))


def read_chunk(texts: list[str]) -> tuple[Found, Found]:
    """Lines of texts and their letter pairs: what the fit needs of them, without the statistics that depend on how letters follow."""
    lines = Lines(texts)
    plain = lines.features(None)
    name = NAMES.index
    use = (plain[:, name("letters")] > 0.8) & (plain[:, name("script")] < 0.1) & (plain[:, name("plain_words")] > 0.7) & (plain[:, name("log_chars")] > 3) & (plain[:, name("periodic")] < 0.5) & (plain[:, name("longest_token")] < 3.2)
    piece, a, b = lines.letter_pairs()
    size = np.bincount(lines.text, minlength=len(texts)).astype(np.int32)
    letters = {"use": use, "size": np.bincount(piece, minlength=lines.n).astype(np.int32), "pairs": a.astype(np.int16) * 27 + b}
    return {"size": size, "chars": lines.chars.astype(np.int32), "kept": _kept(plain)}, letters


def _middle(counts: np.ndarray) -> float:
    """The median of whole numbers from 0 on, by how often each occurs."""
    n, upto = int(counts.sum()), np.cumsum(counts)
    return (np.searchsorted(upto, (n - 1) // 2, side="right") + np.searchsorted(upto, n // 2, side="right")) / 2


def _low(fits: np.ndarray) -> np.ndarray:
    """How low mean log odds are, in multiples of 1 / GRAIN."""
    return np.minimum(np.rint(-fits * GRAIN), 16 * GRAIN).astype(np.int64)


def letter_step(letters: Found, before: list[tuple[np.ndarray, float]], odds: np.ndarray | None = None) -> Found:
    """Counts of letter pairs in the lines that are still in use, or of how low these fit ``odds``."""
    use, size, pairs = letters["use"], letters["size"], letters["pairs"]
    pairs, size = pairs[np.repeat(use, size)], size[use]
    for past, most in before:
        use = _low(letter_fits(size, pairs, past)) <= most
        pairs, size = pairs[np.repeat(use, size)], size[use]
    if odds is None:
        return {"counts": np.bincount(pairs, minlength=729)}
    return {"low": np.bincount(_low(letter_fits(size, pairs, odds)), minlength=16 * GRAIN + 1)}


def learn_letters(total: Total) -> np.ndarray:
    """Log probability of each letter after another, over the lines of words; lines that fit far worse than the rest are left out, twice."""
    before: list[tuple[np.ndarray, float]] = []
    odds = np.zeros((27, 27))
    for turn in range(3):
        counts = total(letter_step, before=before).get("counts", np.zeros(729)).reshape(27, 27) + 0.5
        odds = np.log(counts / counts.sum(axis=1, keepdims=True))
        if turn < 2:
            low = total(letter_step, before=before, odds=odds).get("low", np.zeros(1))
            before = [*before, (odds, _middle(low) + 0.6 * GRAIN if low.any() else np.inf)]
    return odds


def add_letters(lines: Found, letters: Found, odds: np.ndarray) -> Found:
    """``lines`` with the statistics that depend on how letters follow."""
    kept = lines["kept"].copy()
    kept[[NAMES.index("letter_fit"), NAMES.index("letter_pairs")]] = _kept(np.stack(letter_columns(letters["size"], letters["pairs"], odds), axis=1))
    return lines | {"kept": kept}


def first_guess(features: np.ndarray, usual: float) -> np.ndarray:
    """Log scores of the four kinds for lines that tell them clearly; equal ones for the others. Only where fitting starts; ``usual`` is the median fit of readable lines."""
    f = dict(zip(NAMES, features.T, strict=True))
    cells = np.maximum.reduce([f["tabs"], f["bars"], f["semicolons"], f["commas"], f["gaps"]])
    table = ((cells >= 2 / 8) & (f["alike"] >= 1) & ((f["number_tokens"] > 0.15) | (f["tabs"] > 1 / 8) | (f["bars"] > 1 / 8) | ((f["gaps"] > 1 / 8) & (f["short_words"] < 0.2)) | (f["tight"] > 1 / 8))) | (f["tags"] >= 4 / 8) | (f["equals"] >= 3 / 8)
    junk = (f["unreadable"] > 0.06) | (f["signs"] > 0.3) | ((f["longest_token"] > 3.7) & (f["script"] < 0.1)) | (f["mixed_script"] > 0.15) | (f["percent"] > 0.2) | (f["hex"] > 0.9)
    junk |= (f["letter_pairs"] >= 0.6) & (f["script"] < 0.1) & (f["number_tokens"] < 0.3) & (f["letter_fit"] < usual - 0.9) & (f["tags"] < 2 / 8)
    junk |= (f["signs"] > 0.04) & (f["plain_words"] < 0.55) & (f["letters"] > 0.3) & (f["number_tokens"] < 0.3) & (f["script"] < 0.1) & (f["tags"] < 2 / 8) & (f["equals"] < 2 / 8) & (f["bars"] < 3 / 8) & (f["bullet"] == 0) & (f["log_chars"] > 3)
    junk |= ((f["repeats"] > 1.6) & (f["log_chars"] > 2.5)) | ((f["new_tokens"] < 0.35) & (f["log_chars"] > 3.8) & (f["number_tokens"] < 0.2) & (f["bars"] == 0))
    same = (f["periodic"] > 0.85) & (f["log_chars"] > 2.5) & (f["bars"] < 3 / 8)
    table, junk = table & ~same, junk | same
    words = f["plain_words"] * f["short_words"]
    lists = ((f["bullet"] > 0) | (f["dots"] >= 2 / 8) | (f["semicolons"] >= 3 / 8) | ((f["log_chars"] < 3.9) & (f["ends_closed"] == 0) & (words < 0.15) & (f["goes_on"] == 0))) & (f["script"] < 0.3)
    prose = ((words > 0.22) & (f["log_chars"] > 3.2)) | ((f["script"] > 0.15) & (f["mixed_script"] < 0.05) & (f["bullet"] == 0) & (f["unreadable"] < 0.06))
    score = np.zeros((len(features), 4))
    for kind, told in ((PROSE, prose & ~junk), (LIST, lists & ~junk & ~table & ~prose), (TABLE, table & ~(junk & (f["tags"] < 4 / 8) & (f["number_tokens"] < 0.2) & ((f["letters"] < 0.15) | ((f["plain_words"] < 0.55) & (f["bars"] < 2 / 8))))), (JUNK, junk & ~table)):
        score[told, kind] += 4.0
    return score


def _side_by_side(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order of lines: all first ones, all second ones and so on, of longer texts before shorter; from where each of these goes, and how many they are)."""
    first = np.flatnonzero(np.r_[True, np.diff(text) != 0]) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(text)])
    falling = np.argsort(-size, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[falling] = np.arange(len(first))
    place = np.arange(len(text)) - np.repeat(first, size)
    many = np.bincount(place)
    low = np.cumsum(many) - many
    order = np.empty(len(text), np.int64)
    order[low[place] + np.repeat(rank, size)] = np.arange(len(text))
    return order, list(zip(low.tolist(), many.tolist(), strict=True))


def posteriors(text: np.ndarray, emitted: np.ndarray, start: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each kind at each line, expected changes between kinds) by forward and backward sums, all texts side by side."""
    order, steps = _side_by_side(text)
    seen = np.ascontiguousarray(np.exp(emitted - emitted.max(axis=1, keepdims=True))[order].T)
    step = np.exp(change)
    # Each line's sums are brought to 1, so nothing runs out of range. Sums of four are written out, as their rounding must not depend on how many texts there are.
    forth = lambda x, a: x[0] * a[0][:, None] + x[1] * a[1][:, None] + x[2] * a[2][:, None] + x[3] * a[3][:, None]
    even = lambda x: x / (x[0] + x[1] + x[2] + x[3])
    ahead, back, before = np.empty_like(seen), np.ones_like(seen), np.zeros(len(text), np.int64)
    last = 0
    for low, n in steps:
        come = forth(ahead[:, last : last + n], step) if low else np.exp(start)[:, None]
        ahead[:, low : low + n] = even(come * seen[:, low : low + n])
        before[low : low + n] = np.arange(last, last + n)
        last = low
    for (low, n), (last, _) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        back[:, last : last + n] = even(forth(seen[:, low : low + n] * back[:, low : low + n], step.T))
    moved = np.zeros(16)
    for low in range(steps[0][1] if steps else 0, len(text), 16_384):
        part = slice(low, low + 16_384)
        joint = (ahead[:, None, before[part]] * step[:, :, None] * (seen[:, part] * back[:, part])[None]).reshape(16, -1)
        moved += np.rint(joint * (FINE / joint.sum(axis=0))).sum(axis=1)
    gamma = np.empty_like(emitted)
    gamma[order] = even(ahead * back).T
    return gamma, moved.reshape(change.shape) / FINE


def best_path(text: np.ndarray, emitted: np.ndarray, start: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Viterbi's path of every text, all side by side."""
    order, steps = _side_by_side(text)
    seen = np.ascontiguousarray(emitted[order].T)
    came = np.zeros(seen.shape, np.int8)
    score = np.empty_like(seen)
    last = 0
    for low, n in steps:
        top = start[:, None]
        if low:
            top = score[0, last : last + n] + change[0][:, None]
            for kind in range(1, 4):
                way = score[kind, last : last + n] + change[kind][:, None]
                came[:, low : low + n][way > top] = kind
                top = np.maximum(top, way)
        score[:, low : low + n] = top + seen[:, low : low + n]
        last = low
    path = score.argmax(axis=0)
    for (low, n), (last, _) in zip(steps[:0:-1], steps[-2::-1], strict=True):
        path[last : last + n] = came[path[low : low + n], np.arange(low, low + n)]
    found = np.empty_like(path)
    found[order] = path
    return found


def scale_step(lines: Found) -> Found:
    """Sums of the statistics and of their squares, and how low the letters of readable lines fit."""
    kept = lines["kept"].astype(np.int64)
    f = dict(zip(NAMES, lines["kept"] / GRAIN, strict=True))
    readable = (f["letter_pairs"] >= 1) & (f["plain_words"] > 0.7) & (f["script"] < 0.1) & (f["periodic"] < 0.5) & (f["longest_token"] < 3.2)
    low = np.bincount(np.clip(-kept[NAMES.index("letter_fit")][readable], 0, None), minlength=1 << 15)
    return {"n": np.array([kept.shape[1]]), "sum": kept.sum(axis=1), "square": (kept**2).sum(axis=1), "low": low}


def seed_step(lines: Found) -> Found:
    """The lines that the codebook begins with: the first ones by hash."""
    return {"seeds": _first(_hash(lines["kept"], 0), lines["kept"].T, CODES)}


def book_step(lines: Found, middle: np.ndarray, scale: np.ndarray, book: np.ndarray, turn: int) -> Found:
    """A round of k-means: number of lines, sums of statistics and of squared distances of each entry, and a line drawn from each, the likelier the farther."""
    kept = lines["kept"]
    rows = _scaled(kept, middle, scale)
    code = _nearest(rows, book)
    sums = np.stack([np.bincount(code, column, len(book)) for column in kept], axis=1)
    away = ((rows - book[code]) ** 2).sum(axis=1)
    far = np.flatnonzero(away > 1)
    key = -np.log(_hash(kept[:, far], turn + 1)) / away[far] ** 2
    order = np.lexsort((key, code[far]))
    first = order[np.r_[True, np.diff(code[far][order]) != 0][: len(order)]]
    drawn = np.full((len(book), 1 + len(kept)), np.inf)
    drawn[code[far[first]], 0] = key[first]
    drawn[code[far[first]], 1:] = kept[:, far[first]].T
    return {"n": np.bincount(code, minlength=len(book)), "sums": sums, "away": np.bincount(code, np.rint(away * GRAIN), len(book)), "drawn": drawn}


def learn_book(total: Total, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The codebook, in scaled statistics."""
    book = (total(seed_step)["seeds"][:, 1:] / GRAIN - middle) / scale
    for turn in range(ROUNDS):
        found = total(book_step, middle=middle, scale=scale, book=book, turn=turn)
        n = found["n"][:, None]
        book = np.where(n > 0, (found["sums"] / np.maximum(n, 1) / GRAIN - middle) / scale, book)
        drawn = found["drawn"]
        mean = np.where(drawn[:, 0] < np.inf, found["away"] / np.maximum(found["n"], 1), 0)
        worst = np.argsort(-mean, kind="stable")[:MORE]
        book = np.concatenate([book, (drawn[worst[mean[worst] > 0], 1:] / GRAIN - middle) / scale])
    return book


def code_lines(lines: Found, middle: np.ndarray, scale: np.ndarray, book: np.ndarray, usual: float) -> Found:
    """Each line's entry of the codebook and the kinds that the first guess tells it to be, as bits."""
    told = first_guess((lines["kept"] / GRAIN).T, usual) > 0
    return {"size": lines["size"], "chars": lines["chars"], "code": _nearest(_scaled(lines["kept"], middle, scale), book).astype(np.int16), "told": np.packbits(told, axis=1, bitorder="little")[:, 0]}


def chain_step(coded: Found, entries: int, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Found:
    """Expected lines of each entry and kind, texts that begin with each kind, and changes between kinds; without a model the lines by the first guess."""
    code, text = coded["code"], np.repeat(np.arange(len(coded["size"])), coded["size"])
    begins = np.r_[True, np.diff(text) != 0][: len(text)]
    found = {"begun": np.array([begins.sum()])}
    if model is None:
        guess = np.exp(4.0 * np.unpackbits(coded["told"][:, None], axis=1, count=4, bitorder="little"))
        gamma = guess / guess.sum(axis=1, keepdims=True)
        found["held"] = np.bincount(code, minlength=entries)
    else:
        start, change, emit = model
        gamma, moved = posteriors(text, emit[code], start, change)
        found["moved"] = np.rint(moved * FINE)
    gamma = np.rint(gamma * FINE)
    return found | {"weight": np.stack([np.bincount(code, gamma[:, k], entries) for k in range(4)], axis=1), "starts": gamma[begins].sum(axis=0)}


def learn_chain(total: Total, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, change, emit) as log probabilities, by Baum-Welch."""
    start = np.log(np.full(4, 0.25))
    change = np.log(np.full((4, 4), 0.02) + np.eye(4) * 0.92)
    emit = np.zeros((entries, 4))
    found = total(chain_step, entries=entries, model=None)
    weight = found["weight"] / FINE
    # Entries lean on the first guess for their own lines, rare ones the most: as if PRIOR lines and a share of their own had been seen besides.
    held = np.maximum(found["held"], 1)[:, None]
    lean = weight / held * weight.sum(axis=0) + 1e-9
    lean *= (PRIOR + LEAN * held) / lean.sum(axis=1, keepdims=True)
    for turn in range(FITS + 1):
        seen = weight + lean + 0.01
        emit = np.log(seen / seen.sum(axis=0))
        if turn == FITS:
            break
        found = total(chain_step, entries=entries, model=(start, change, emit))
        weight, moved = found["weight"] / FINE, found["moved"] / FINE
        start = np.log((found["starts"] / FINE + 1) / (found["begun"] + 4))
        change = np.log((moved + 1) / (moved + 1).sum(axis=1, keepdims=True))
    return start, change, emit


def learn_scale(total: Total) -> tuple[int, np.ndarray, np.ndarray, float]:
    """(number of lines, middle and scale of the statistics, median fit of readable lines)."""
    found = total(scale_step)
    n = int(found["n"][0]) if found else 0
    if not n:
        return 0, np.zeros(len(NAMES)), np.ones(len(NAMES)), 0.0
    middle = found["sum"] / n
    scale = np.maximum(np.sqrt(np.maximum(found["square"] / n - middle**2, 0)) / GRAIN, 0.05)
    for name, times in EMPHASIS.items():
        scale[NAMES.index(name)] /= times
    return n, middle / GRAIN, scale, -_middle(found["low"]) / GRAIN if found["low"].any() else 0.0


def fit_model(texts: list[str]) -> LineModel:
    """The model of texts that are at hand, by the same steps as of a table."""
    lines, letters = read_chunk(texts)
    if not lines["kept"].shape[1]:
        return fit_model(["-"])
    odds = learn_letters(lambda step, **sent: step(letters, **sent))
    lines = add_letters(lines, letters, odds)
    _, middle, scale, usual = learn_scale(lambda step: step(lines))
    book = learn_book(lambda step, **sent: step(lines, **sent), middle, scale)
    coded = code_lines(lines, middle, scale, book, usual)
    return LineModel(odds, middle, scale, book, *learn_chain(lambda step, **sent: step(coded, **sent), len(book)))


def label_texts(texts: list[str | None], model: LineModel) -> list[list[float] | None]:
    """Share of the characters of each kind of every text; None if it is null or blank."""
    lines = Lines([t or "" for t in texts])
    coded = {"size": np.bincount(lines.text, minlength=len(texts)), "chars": lines.chars, "code": model.codes(lines.features(model.odds))}
    return label_lines(coded, model.start, model.change, model.emit)


def label_lines(coded: Found, start: np.ndarray, change: np.ndarray, emit: np.ndarray) -> list[list[float] | None]:
    """Share of the characters of each kind of every text, by the codes of its lines; None if it has none."""
    size = coded["size"]
    text = np.repeat(np.arange(len(size)), size)
    path = best_path(text, emit[coded["code"]], start, change)
    total = np.bincount(text * 4 + path, coded["chars"], 4 * len(size)).reshape(-1, 4)
    held = size > 0
    share = total / np.maximum(total.sum(axis=1, keepdims=True), 1)
    return [s if h else None for s, h in zip(share.tolist(), held.tolist(), strict=True)]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that are handled at once."""
    low = held = 0
    for at, size in enumerate(sizes):
        if at > low and (at - low >= AT_ONCE or held + size > CHARS_AT_ONCE):
            yield low, at
            low, held = at, 0
        held += size
    if len(sizes) > low:
        yield low, len(sizes)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: ids, lines and letters."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for low, high in _chunks([len(t) for t in texts]):
            lines, letters = read_chunk(texts[low:high])
            ids = pa.array([batch.column(0)[low:high].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([_pack(lines)], pa.binary()), pa.array([_pack(letters)], pa.binary())], names=["ids", "lines", "letters"])


def _passes(chunks: DataFrame, column: str) -> Total:
    """Runs steps over the packed ``column`` of all chunks."""
    context = chunks.sparkSession.sparkContext
    tasks = chunks.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _together(_unpack(v.as_py()) for batch in batches for v in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(found)], pa.binary())], names=["found"])

    def total(step: Callable[..., Found], **sent: object) -> Found:
        told = context.broadcast(sent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _together(step(_unpack(v.as_py()), **told.value) for batch in batches for v in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([_pack(found)], pa.binary())], names=["found"])

        parts = chunks.select(column).mapInArrow(run, "found binary")
        if tasks > ADDED:
            parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "found binary")
        try:
            return _together(_unpack(bytes(r["found"])) for r in parts.collect())
        finally:
            told.destroy()

    return total


def label_documents(corpus: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, prose, list, table, junk, kind) of every document; kind is null where prose has its quarter."""
    wanted = corpus.select(corpus[id_column].cast("long").alias("doc_id"), corpus[text_column].alias("text"))
    read = wanted.mapInArrow(_read, "ids array<long>, lines binary, letters binary").persist(StorageLevel.DISK_ONLY)
    odds = learn_letters(_passes(read, "letters"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lines = _pack(add_letters(_unpack(batch.column(1)[i].as_py()), _unpack(batch.column(2)[i].as_py()), odds))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([lines], pa.binary())], names=["ids", "lines"])

    lines = read.mapInArrow(whole, "ids array<long>, lines binary").persist(StorageLevel.DISK_ONLY)
    n, middle, scale, usual = learn_scale(_passes(lines, "lines"))
    read.unpersist()
    book = learn_book(_passes(lines, "lines"), middle, scale) if n else np.zeros((1, len(NAMES)))
    sent = corpus.sparkSession.sparkContext.broadcast((middle, scale, book, usual))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                coded = _pack(code_lines(_unpack(batch.column(1)[i].as_py()), *sent.value))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], pa.array([coded], pa.binary())], names=["ids", "coded"])

    coded = cut(lines.mapInArrow(code, "ids array<long>, coded binary"))
    lines.unpersist()
    chain = learn_chain(_passes(coded, "coded"), len(book)) if n else (np.zeros(4), np.zeros((4, 4)), np.zeros((1, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shares = label_lines(_unpack(batch.column(1)[i].as_py()), *chain)
                kinds = [KINDS[1 + int(np.argmax(s[1:]))] if s is not None and 1 - s[PROSE] > NOT_PROSE else None for s in shares]
                columns = [[s[k] if s is not None else None for s in shares] for k in range(4)]
                arrays = [batch.column(0)[i].values, *(pa.array(c, pa.float64()) for c in columns), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *KINDS, "kind"])

    return coded.mapInArrow(run, "doc_id long, prose double, list double, table double, junk double, kind string")


def text_statistics(corpus: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, words, mean_word, symbol_ratio, ended_lines, common_words) of every document, in Catalyst expressions only.

    Words are runs of non-space; a symbol is what is neither letter, digit nor space. A null, empty or blank text has 0 words and null elsewhere.
    """
    text = F.coalesce(corpus[text_column], F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda x: x.rlike(r"[^ \t]"))
    rows = corpus.select(corpus[id_column].alias("doc_id"), words.alias("w"), lines.alias("l"))
    n = F.size("w")
    dense = F.length(F.array_join("w", ""))
    symbols = F.length(F.regexp_replace(F.array_join("w", ""), r"[\p{L}\p{N}]", ""))
    ended = F.size(F.filter("l", lambda x: x.rlike("[.!?] *\\z")))
    common = F.size(F.filter("w", lambda w: w.isin(*sorted(COMMON))))
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b.cast("double"))
    return rows.select("doc_id", n.cast("long").alias("words"), ratio(dense, n).alias("mean_word"), ratio(symbols, dense).alias("symbol_ratio"), ratio(ended, F.size("l")).alias("ended_lines"), ratio(common, n).alias("common_words"))
