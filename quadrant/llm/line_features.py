"""Statistics of the lines of texts, computed with numpy for all lines of a batch at once.

Lines are what str.splitlines gives, without blank ones; a line of more than one and a half PIECE characters is cut after PIECE at white space, so that a text
without line breaks has pieces too. Every statistic is a number of the piece's characters, of its tokens (runs without white space), or of its neighbours in the text.
"""

from __future__ import annotations

import unicodedata

import numpy as np

PIECE = 80
# Classes of characters.
SPACE, LOWER, UPPER, DIGIT, ACCENTED, CLOSING, COMMON_SIGN, SIGN, UNREADABLE = range(9)
#: Other scripts, each a class of its own from here on: first and last code point.
SCRIPTS = [(0x370, 0x3FF), (0x400, 0x52F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0xDFF), (0xE00, 0xE7F), (0xAC00, 0xD7A3), (0x3040, 0x9FFF)]
FIRST_SCRIPT = UNREADABLE + 1
CLASSES = FIRST_SCRIPT + len(SCRIPTS)
CLOSERS, COMMON_SIGNS, BULLETS = ".!?…。！？", ",;:'\"()-–—’‘“”«»¿¡„、/&", "-*•–—·▪◦‣➢►+"
MARKS = "\t|;,<=%"
LAGS = 6
NAMES = [
    "log_chars", "letters", "digits", "closers", "signs", "unreadable", "capitals", "script", "mixed_script", "accented", "plain_words", "short_words", "token_length", "longest_token", "letter_digit_tokens", "number_tokens", "capitalised",
    "ends_closed", "inner_closed", "bullet", "tabs", "bars", "semicolons", "commas", "gaps", "tags", "equals", "dots", "tight", "alike", "goes_on", "repeats", "periodic", "new_tokens", "letter_fit", "letter_pairs", "hex", "percent",
]


def pieces(text: str) -> list[tuple[str, bool]]:
    """(piece, whether it begins a line) of a text."""
    found = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line.strip():
            continue
        start, first = 0, True
        while len(line) - start > PIECE * 3 // 2:
            cut = line.rfind(" ", start + PIECE // 2, start + PIECE)
            cut = cut if cut > 0 else start + PIECE
            found.append((line[start:cut], first))
            start, first = cut, False
        found.append((line[start:], first))
    return found


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, folded letter 1-26 or 0) of every code point of the basic plane; made once a task."""
    if not _TABLES:
        _TABLES.append(_make_tables())
    return _TABLES[0]


def _make_tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(0x10000, SIGN, np.uint8)
    kind[0xD800:0xF900] = UNREADABLE
    letter = np.zeros(0x10000, np.uint8)
    for code in range(0x590):
        c = chr(code)
        group = unicodedata.category(c)
        if c.isspace():
            kind[code] = SPACE
        elif group[0] == "L":
            kind[code] = ACCENTED if code > 127 else LOWER if c.islower() else UPPER
            base = unicodedata.normalize("NFKD", c)[0].lower()
            letter[code] = ord(base) - 96 if "a" <= base <= "z" else 0
        elif group == "Nd":
            kind[code] = DIGIT
        elif group == "Cc":
            kind[code] = UNREADABLE
        elif group[0] == "M":
            kind[code] = ACCENTED
    kind[[0x2028, 0x2029, 0x3000, 0xA0, *range(0x2000, 0x200B)]] = SPACE
    for i, (low, high) in enumerate(SCRIPTS):
        span = np.arange(low, high + 1)
        kind[span[kind[span] != SPACE]] = FIRST_SCRIPT + i
    kind[0x1E00:0x2000] = ACCENTED
    kind[[0x30FC, *range(0xFF66, 0xFFA0)]] = CLASSES - 1
    kind[[ord(c) for c in CLOSERS]] = CLOSING
    kind[[ord(c) for c in COMMON_SIGNS]] = COMMON_SIGN
    kind[[0xFFFD, 0x25A1]] = UNREADABLE
    return kind, letter


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2 ** 64; made once a task."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = np.cumprod(np.full(n, base, np.uint64))
    return _POWERS[base][:n]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def letter_fits(size: np.ndarray, pairs: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Mean log odds of each piece's letter pairs; ``size`` has their numbers, ``pairs`` all of them as letter * 27 + next letter."""
    fits, some = np.zeros(len(size)), np.flatnonzero(size)
    if len(some):
        fits[some] = np.add.reduceat(odds.ravel()[pairs], (np.cumsum(size) - size)[some]) / size[some]
    return fits


def letter_columns(size: np.ndarray, pairs: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistics letter_fit and letter_pairs."""
    return np.where(size >= 12, letter_fits(size, pairs, odds), 0.0), np.minimum(size, 40) / 40


class Lines:
    """The pieces of many texts, their characters in one array."""

    def __init__(self, texts: list[str]) -> None:
        cut = [pieces(t) for t in texts]
        self.text = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        held = [p for c in cut for p, _ in c]
        self.first = np.array([f for c in cut for _, f in c], bool)
        self.n = len(held)
        self.codes = np.frombuffer("\n".join([*held, ""]).encode("utf-32-le", "replace"), np.uint32)
        size = np.array([len(p) for p in held], np.int64) + 1
        self.start = np.cumsum(size) - size
        self.size = size
        self.of = np.repeat(np.arange(self.n), size)
        kind, letter = tables()
        low = np.minimum(self.codes, 0xFFFF).astype(np.intp)
        self.kind, self.letter = kind[low], letter[low]
        self.chars = self.number(self.kind != SPACE)
        seen: dict[tuple[int, str], int] = {}
        key = [(t, p.strip().lower()) for t, p in zip(self.text.tolist(), held, strict=True)]
        for k in key:
            seen[k] = seen.get(k, 0) + 1
        self.copies = np.array([seen[k] for k in key], float)

    def number(self, mask: np.ndarray) -> np.ndarray:
        """How many of each piece's characters are in ``mask``."""
        return np.add.reduceat(mask, self.start, dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def _marks(self) -> dict[str, np.ndarray]:
        """How often each piece has each sign of MARKS."""
        of_code = np.zeros(128, np.uint8)
        of_code[[ord(c) for c in MARKS]] = np.arange(1, len(MARKS) + 1)
        mark = of_code[np.where(self.codes < 128, self.codes, 0)]
        at = np.flatnonzero(mark)
        count = np.bincount(self.of[at] * (len(MARKS) + 1) + mark[at], minlength=self.n * (len(MARKS) + 1)).reshape(self.n, -1)
        return {c: count[:, i + 1] for i, c in enumerate(MARKS)}

    def letter_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, letter, next letter) of all neighbouring characters of which one is a letter; what is none is 0, also before a piece."""
        a, b = np.r_[np.uint8(0), self.letter[:-1]], self.letter
        use = (a > 0) | (b > 0)
        return self.of[use], a[use], b[use]

    def features(self, odds: np.ndarray | None) -> np.ndarray:
        """One row a piece, one column a name of NAMES; ``odds`` are the log odds of letter pairs, if they are known."""
        n, of, kind, codes = self.n, self.of, self.kind, self.codes
        if not n:
            return np.zeros((0, len(NAMES)))
        count = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
        dense = np.maximum(self.chars, 1)
        number = self.number
        scripts = count[:, FIRST_SCRIPT:]
        latin = count[:, LOWER] + count[:, UPPER] + count[:, ACCENTED]
        letters = latin + scripts.sum(axis=1)
        # Tokens.
        black = kind != SPACE
        begins = black & ~np.r_[False, black[:-1]]
        heads, tails = np.flatnonzero(begins), np.flatnonzero(black & ~np.r_[black[1:], False])
        home = of[heads]
        tokens = len(home)
        size = (tails - heads + 1).astype(float)
        is_letter = (kind == LOWER) | (kind == UPPER) | (kind == ACCENTED) | (kind >= FIRST_SCRIPT)
        with_letters, with_digits = (np.diff(np.r_[0, np.cumsum(own, dtype=np.int64)][np.stack([heads, tails + 1])], axis=0)[0].astype(float) for own in (is_letter, kind == DIGIT))
        others = size - with_letters - with_digits
        plain = (with_letters > 0) & (with_digits == 0) & (others <= 1)
        per = np.bincount(home, minlength=n).astype(float)
        by_piece = lambda values: np.bincount(home, values, n)
        words = by_piece(plain)
        short = by_piece(plain & (with_letters <= 3))
        capital = by_piece(plain & (kind[heads] == UPPER))
        longest = np.zeros(n)
        np.maximum.at(longest, home, size)
        mixed = by_piece((with_letters > 0) & (with_digits > 0))
        numbers = by_piece((with_digits > 0) & (with_letters <= 1))
        # A closing sign before white space; the piece's own end is the last such place.
        closed = np.zeros(len(kind), bool)
        closed[:-1] = ((kind[:-1] == CLOSING) | ((kind[:-1] == COMMON_SIGN) & np.r_[False, kind[:-2] == CLOSING])) & ~black[1:]
        ends = closed[np.maximum(self.start + self.size - 2, 0)]
        inner = number(closed & black) - ends
        # The first token as a bullet: a sign of its own, or a short number or letter with a point or bracket.
        first_token = np.zeros(n, int) - 1
        first_token[home[::-1]] = np.arange(tokens)[::-1]
        bullet = np.zeros(n)
        has = np.flatnonzero((first_token >= 0) & (per > 1) & self.first)
        at = first_token[has]
        head = codes[heads[at]]
        tail = codes[tails[at]]
        sign = (size[at] == 1) & np.isin(head, [ord(c) for c in BULLETS])
        numbered = (size[at] <= 4) & np.isin(tail, [ord("."), ord(")"), ord("]")]) & (others[at] <= 2) & (with_letters[at] <= 1)
        box = (size[at] <= 3) & (head == ord("["))
        bullet[has] = sign | numbered | box
        marks = self._marks()
        # Gaps of two spaces and more, but for those after a sentence.
        opens = np.r_[False, black[:-1] & ~black[1:] & (kind[:-1] != CLOSING)]
        gap = number(opens & np.r_[~black[1:], False] & (codes == 32) & np.r_[codes[1:] == 32, False])
        tight = number(((codes == ord(",")) | (codes == ord(";"))) & np.r_[black[1:], False])
        tags = marks["<"]
        dots = number(((codes == ord("·")) | (codes == ord("•")) | (codes == ord("/"))) & ~np.r_[True, black[:-1]] & ~np.r_[black[1:], True])
        shape = np.stack([marks["\t"], marks["|"], marks[";"], marks[","], gap, tags])
        code = shape.argmax(axis=0) * 1000 + np.minimum(shape.max(axis=0), 999)
        code[shape.max(axis=0) == 0] = -1
        same = (code[1:] == code[:-1]) & (code[1:] >= 0) & (self.text[1:] == self.text[:-1])
        alike = np.r_[False, same].astype(float) + np.r_[same, False]
        equal = np.zeros(n)
        for lag in range(1, LAGS + 1):
            hit = np.r_[np.zeros(lag, bool), codes[lag:] == codes[:-lag]]
            for j in range(lag):
                hit[np.minimum(self.start + j, len(hit) - 1)] = False
            equal = np.maximum(equal, number(hit[: len(codes)]) / np.maximum(self.size - 1 - lag, 8))
        # Tokens by the value of a polynomial in an odd number, modulo 2 ** 64: differences of running sums, moved to the same power.
        odd = 0x9E3779B97F4A7C15
        power, back = _powers(odd, len(codes)), _powers(pow(odd, -1, 1 << 64), len(codes))
        summed = np.r_[np.uint64(0), np.cumsum(codes * power)]
        hashed = (summed[tails + 1] - summed[heads]) * back[heads] * np.uint64(0xBF58476D1CE4E5B9)
        key = np.sort((home.astype(np.uint64) << np.uint64(36)) | (hashed >> np.uint64(28)))
        kinds = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(36)).astype(np.int64), minlength=n)
        fit, pairs = np.zeros(n), np.zeros(n)
        if odds is not None:
            piece, a, b = self.letter_pairs()
            fit, pairs = letter_columns(np.bincount(piece, minlength=n), a.astype(np.int64) * 27 + b, odds)
        hexes = number((kind == DIGIT) | (((codes | 32) >= 97) & ((codes | 32) <= 102) & (codes < 128)))
        few = lambda x: np.minimum(x, 8) / 8
        columns = [
            np.log1p(dense), letters / dense, count[:, DIGIT] / dense, count[:, CLOSING] / dense, count[:, SIGN] / dense, count[:, UNREADABLE] / dense, _share(count[:, UPPER], count[:, UPPER] + count[:, LOWER]),
            scripts.max(axis=1) / dense, (scripts.sum(axis=1) - scripts.max(axis=1)) / dense, count[:, ACCENTED] / dense, _share(words, per), _share(short, words), np.log1p(_share(self.chars, per)), np.log1p(longest), _share(mixed, per), _share(numbers, per),
            _share(capital, words), ends.astype(float), np.minimum(_share(inner, per) * 8, 1), bullet, few(marks["\t"]), few(marks["|"]), few(marks[";"]), few(marks[","]), few(gap), few(tags), few(marks["="]), few(dots), few(tight), alike,
            (~self.first).astype(float), np.log1p(np.minimum(self.copies, 50) - 1), equal, _share(kinds, per), fit, pairs, hexes / dense, marks["%"] / dense,
        ]
        return np.stack(columns, axis=1)
