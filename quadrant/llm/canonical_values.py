"""Freely written values mapped to the entries of a reference list, with a report of those that mean none.

The reference list's keys go into a symmetric-delete dictionary (every key prefix with up to two letters removed), which
is broadcast; a value with the same letters removed meets every key within the bounded edit distance. Candidates are
verified and ranked by weighted Damerau-Levenshtein distance (confusable letters and swaps cost less), then by how often the
entry is written exactly in the data. Forms that are no misspellings (initials, abbreviated, cut or
reordered words, the distinctive words alone, remarks after the name) are resolved word by word.

Values never shuffle: each task resolves the distinct values of its own rows, so a value that holds a third of all rows
costs each task one lookup.

Defined results: null and blank values and exact entries give no row in ``match_values``; a value that fits two entries equally
well means the more frequent one, or none if the fit is by initials, by a cut word or by distinctive words only; no
entry within the bounds gives -1; an empty reference list gives -1 for every value.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 2
PREFIX = 8
NONE = -1
#: The reference list must stay small enough to send to every executor.
MAX_ENTRIES = 20_000
#: Distinct values whose answers a task remembers.
REMEMBERED = 500_000

# Words without weight, remarks that follow a name, and values that stand in for one.
EMPTY_WORDS = frozenset("the of and".split())
GENERIC = frozenset("bldg building blg bld".split())
REMARKS = frozenset(
    """floor level upstairs downstairs entrance door ramp map hours session stairs desk lobby wing side basement annexe room rm suite
    rear front main east west north south lower upper ground first second third 1st 2nd 3rd 4th use see posted walk walkin in orientation blue roof block
    back left right top new old temporary closed open by near via ask only please enter elevator lift""".split()
)
STAND_INS = frozenset("tba tbd tbc arr arranged na none null nil online remote virtual offsite unknown various hybrid staff async".split())
CONFUSED = {frozenset(p) for p in ("0o", "1l", "1i", "il", "5s", "8b", "6g", "2z", "uv", "vy", "ce", "ao", "ae", "ei", "ou", "ao", "rn", "nm", "mn", "ft", "lt")}
VOWELS = frozenset("aeiou")
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12", "xiii": "13"}
NUMBER_SIGN = re.compile(r"\b(?:no|nr|num|number)\b\W*(?=\d)()")
WORDS = re.compile(r"[^\W_]+")
BRACKETED = re.compile(r"[(\[{<][^()\[\]{}<>]*[)\]}>]")
CAMEL = re.compile(r"(?<=[a-zà-þ])(?=[A-ZÀ-Þ][a-zà-þ])|(?<=[a-zA-Z])(?=\d)")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def words_of(text: str) -> list[str]:
    """Words with weight; a last word stays in any case, as it may be the beginning of a cut one."""
    words = NUMBER_SIGN.sub(r"\1", text) if "n" in text else text
    words = WORDS.findall(words)
    return [w.lstrip("0") or "0" if w.isdigit() else w for i, w in enumerate(words) if w not in EMPTY_WORDS or (i and i == len(words) - 1)]


def deletes(key: str) -> set[str]:
    """The key's prefix with up to MAX_EDITS letters removed."""
    key = key[:PREFIX]
    found, last = {key}, {key}
    for _ in range(min(MAX_EDITS, max(0, len(key) - 2))):
        last = {k[:i] + k[i + 1 :] for k in last for i in range(len(k))}
        found |= last
    return found


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 7 else MAX_EDITS


def distance(a: str, b: str, bound: int) -> tuple[int, float] | None:
    """(edits, weighted cost) of the restricted Damerau-Levenshtein distance; None beyond ``bound`` edits."""
    if abs(len(a) - len(b)) > bound:
        return None
    if a == b:
        return 0, 0.0
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    start = max(0, start - 1)
    a, b = a[start:], b[start:]
    while len(a) > 2 and len(b) > 2 and a[-1] == b[-1] and a[-2] == b[-2]:
        a, b = a[:-1], b[:-1]
    inf = (bound + 1, 99.0)
    before: list[tuple[int, float]] = []
    row = [(j, float(j)) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        new = [(i, float(i))] + [inf] * len(b)
        for j in range(max(1, i - bound), min(len(b), i + bound) + 1):
            x, y = a[i - 1], b[j - 1]
            if x == y:
                best = row[j - 1]
            else:
                n, w = row[j - 1]
                best = (n + 1, w + (0.5 if frozenset((x, y)) in CONFUSED else 0.7 if x in VOWELS and y in VOWELS else 1.0))
            n, w = row[j]
            best = min(best, (n + 1, w + (0.5 if i > 1 and x == a[i - 2] else 0.9)))
            n, w = new[j - 1]
            best = min(best, (n + 1, w + (0.5 if j > 1 and y == b[j - 2] else 0.9)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n, w = before[j - 2]
                best = min(best, (n + 1, w + 0.6))
            new[j] = best
        before, row = row, new
        if min(row)[0] > bound:
            return None
    return row[-1] if row[-1][0] <= bound else None


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a beginning of ``word`` or its letters in order with vowels left out."""
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    if len(short) < 2:
        return False
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    if len(short) > 3 and word.endswith(short[1:]):
        return True
    inner = short[1:-1] if short[-1] == word[-1] else short[1:]
    return sum(c in VOWELS for c in inner) <= (len(short) > 3)


def skeleton(text: str) -> str:
    """First letter and consonants, doubled letters once."""
    kept = text[:1] + "".join(c for c in text[1:] if c not in VOWELS)
    return re.sub(r"(.)\1+", r"\1", kept)


def only_remarks(text: str) -> bool:
    """Whether a text without spaces is made of remarks alone."""
    reached = {0}
    for i in range(len(text)):
        if i in reached:
            reached |= {i + n for n in range(2, 11) if text[i : i + n] in REMARKS}
    return len(text) in reached


class Reference:
    """The reference list and its dictionaries."""

    def __init__(self, entries: list[tuple[int, str, str | None, int]]) -> None:
        """entries: (id, name, longer official name or None, exact occurrences)."""
        self.words: dict[int, list[str]] = {}
        self.often: dict[int, int] = {}
        self.keys: dict[str, set[int]] = defaultdict(set)
        self.sorted: dict[tuple, set[int]] = defaultdict(set)
        self.initials: dict[str, set[int]] = defaultdict(set)
        self.subjects: dict[str, set[int]] = defaultdict(set)
        self.numbers: dict[str, set[int]] = defaultdict(set)
        self.prefix: dict[str, set[int]] = defaultdict(set)
        self.skeletons: dict[str, set[int]] = defaultdict(set)
        self.read: dict[str, dict[str, float]] = {}
        last = Counter()
        for key, name, official, often in entries:
            words = words_of(fold(name))
            if not words:
                continue
            self.often[key] = often
            self.words[key] = words
            last[words[-1]] += 1
            forms = [words]
            if official and official != name:
                bare = words_of(fold(BRACKETED.sub(" ", official)))
                forms.append(bare)
                for found in BRACKETED.findall(official):
                    self.initials["".join(words_of(fold(found)))].add(key)
                    self.keys["".join([*bare, *words_of(fold(found))])].add(key)
            for form in forms:
                self.keys["".join(form)].add(key)
                self.sorted[tuple(sorted(form))].add(key)
            if len(words) >= 3:
                self.initials["".join(w if w.isdigit() else w[0] for w in words)].add(key)
            if words[-1].isdigit():
                self.numbers[words[-1]].add(key)
            compact = "".join(words)
            self.skeletons["".join(map(skeleton, words))].add(key)
            for n in range(4, len(compact)):
                self.prefix[compact[:n]].add(key)
        #: Words that end many names tell kinds of entries, not one of them.
        self.kinds = {w for w, n in last.items() if n >= 3 and not w.isdigit()}
        for key, words in self.words.items():
            if words[-1] in self.kinds and len(words) > 1:
                self.subjects["".join(words[:-1])].add(key)
        self.near_keys = self._index(self.keys)
        self.near_subjects = self._index(self.subjects)
        vocabulary = {w for words in self.words.values() for w in words}
        self.near_words = self._index(vocabulary)
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.by_letter: dict[str, set[str]] = defaultdict(set)
        for key, words in self.words.items():
            for w in words:
                self.by_word[w].add(key)
                self.by_letter[w[0]].add(w)

    @staticmethod
    def _index(keys) -> dict[str, list[str]]:
        found: dict[str, list[str]] = defaultdict(list)
        for key in keys:
            for form in deletes(key):
                found[form].append(key)
        return dict(found)

    @staticmethod
    def _near(index: dict[str, list[str]], text: str, bound: int) -> list[tuple[float, str]]:
        """(cost, key) of the keys within ``bound`` edits, best first."""
        seen = {k for form in deletes(text) for k in index.get(form, ())}
        found = []
        for key in seen:
            if digits(key) != digits(text) and digits(key):
                continue
            d = distance(text, key, min(bound, edits_allowed(min(len(key), len(text)))))
            if d is not None:
                found.append((d[1], key))
        return sorted(found)

    def _only(self, keys: set[int] | None, strict: bool = False) -> int | None:
        """The entry of the set: its only one, else (unless strict) the most frequent."""
        if not keys:
            return None
        if len(keys) == 1:
            return next(iter(keys))
        return None if strict else min(keys, key=lambda k: (-self.often[k], k))

    def resolve(self, value: str) -> int:
        """The entry a value means, or NONE."""
        text = unicodedata.normalize("NFKC", value)
        words = words_of(fold(text))
        if not words:
            return NONE
        found = self._resolve_words(words)
        if found is None:
            bare = words_of(fold(BRACKETED.sub(" ", text)))
            if bare and bare != words:
                found = self._resolve_words(bare)
        if found is None:
            split = words_of(fold(CAMEL.sub(" ", text)))
            if split != words:
                found = self._resolve_words(split)
        return NONE if found is None else found

    def _resolve_words(self, words: list[str]) -> int | None:
        for form in self._forms(words):
            found = self._match(form)
            if found is not None:
                return found
        for form in self._joined(words):
            found = self._aligned(form)
            if found:
                return min(found)[2]
        return None

    def _joined(self, words: list[str]) -> list[list[str]]:
        """The words with one neighbouring pair written as one."""
        return [[*words[:i], words[i] + words[i + 1], *words[i + 2 :]] for i in range(len(words) - 1)] if 2 < len(words) < 7 else []

    def _forms(self, words: list[str]) -> Iterator[list[str]]:
        """The words, then without remarks and generic words around them, then without initials given beside the name."""
        seen = []

        def fresh(form: list[str]) -> bool:
            if form and form not in seen:
                seen.append(form)
                return True
            return False

        if fresh(words):
            yield words
        core = list(words)
        while core and core[0] in GENERIC:
            core.pop(0)
        if fresh(core):
            yield list(core)
        end = len(core)
        while end > 1 and core[end - 1] in REMARKS:
            end -= 1
            # A cut after each remark: some remarks are words of names.
            if fresh(core[:end]):
                yield core[:end]
        core = core[:end]
        if len(core) > 1 and core[-1] in GENERIC and fresh(core[:-1]):
            yield core[:-1]
        if len(core) > 2:
            for initials, rest in ((core[0], core[1:]), (core[-1], core[:-1])):
                if initials in self.initials and len(initials) >= 3 and fresh(rest):
                    yield rest

    def _match(self, words: list[str]) -> int | None:
        compact = "".join(words)
        if compact in STAND_INS or compact.isdigit():
            return None
        found = self._only(self.keys.get(compact))
        if found is not None:
            return found
        found = self._only(self.sorted.get(tuple(sorted(words))))
        if found is not None:
            return found
        if len(words) == 1 and len(compact) >= 3 or digits(compact):
            found = self._only(self.initials.get(compact), strict=True)
            if found is not None:
                return found
        best: list[tuple[float, int, int]] = []
        for cost, key in self._near(self.near_keys, compact, MAX_EDITS):
            for entry in self.keys[key]:
                if self._kind_fits(words, entry):
                    best.append((cost, -self.often[entry], entry))
        best += self._aligned(words)
        if best:
            return min(best)[2]
        found = self._glued(compact)
        if found is not None:
            return found
        found = self._only(self.prefix.get(compact) if len(compact) >= 5 else None, strict=True)
        if found is not None:
            return found
        if len(compact) >= 5 and not digits(compact):
            found = self._only(self.subjects.get(compact), strict=True)
            if found is not None:
                return found
            near = self._near(self.near_subjects, compact, MAX_EDITS)
            near = [k for c, k in near if c == near[0][0]]
            if len(near) == 1:
                return self._only(self.subjects[near[0]], strict=True)
        return None

    def _glued(self, compact: str) -> int | None:
        """A key with remarks or its initials written on to it, or a name without vowels and spaces."""
        for n in range(len(compact) - 3, 7, -1):
            if compact[:n] in self.keys and only_remarks(compact[n:]):
                return self._only(self.keys[compact[:n]])
        for n in (3, 4):
            if compact[:n] in self.initials and compact[n:] in self.keys:
                return self._only(self.keys[compact[n:]])
            if compact[-n:] in self.initials and compact[:-n] in self.keys:
                return self._only(self.keys[compact[:-n]])
        if len(compact) >= 6 and not any(c in VOWELS for c in compact[1:]):
            return self._only(self.skeletons.get(re.sub(r"(.)\1+", r"\1", compact)), strict=True)
        return None

    def _kind_fits(self, words: list[str], entry: int) -> bool:
        """A value that names a kind in full means no entry of another kind."""
        own = self.words[entry]
        return not any(w in self.kinds and w not in own for w in words)

    def _readings(self, word: str) -> dict[str, float]:
        """Words of the list that a word can stand for, with the cost."""
        known = self.read.get(word)
        if known is not None:
            return known
        found: dict[str, float] = {}
        if word in self.by_word:
            found[word] = 0.0
        elif not word.isdigit():
            found = {key: 0.3 + cost for cost, key in self._near(self.near_words, word, MAX_EDITS) if not key.isdigit()}
        if not word.isdigit() and word not in self.kinds:
            short = word[:-1] if len(word) > 3 and word[-1] == "s" else word
            for key in self.by_letter.get(word[0], ()):
                if not key.isdigit() and (abbreviates(word, key) or (short != word and abbreviates(short, key))):
                    found[key] = min(found.get(key, 9.0), 0.4 if len(word) > 1 else 0.8)
        if len(self.read) < REMEMBERED:
            self.read[word] = found
        return found

    def _aligned(self, words: list[str]) -> list[tuple[float, int, int]]:
        """Entries whose words are the value's words, each misspelt or abbreviated at most, in order or turned around; with cost."""
        words = [ROMAN.get(w, w) if i else w for i, w in enumerate(words)]
        numbers = [w for w in words if w.isdigit()]
        number = numbers[0] if len(numbers) == 1 else None
        if len(words) < 2 or len(words) > 8:
            return []
        readings = [self._readings(w) for w in words]
        if number is not None:
            # A numbered entry may lose words, never its number.
            found = []
            for entry in self.numbers.get(number, ()):
                own = self.words[entry][:-1]
                costs = [min((c for k, c in r.items() if k in own), default=None) for w, r in zip(words, readings, strict=True) if w != number]
                # A short word alone before a number is a code of its own.
                if costs and None not in costs and (len(costs) == len(own) or all(len(w) > 2 for w in words if w != number)):
                    found.append((sum(costs) + 0.3 * abs(len(own) - len(costs)), -self.often[entry], entry))
            return found
        if any(not r for r in readings):
            return []
        narrow = min(readings, key=lambda r: sum(len(self.by_word[k]) for k in r))
        entries = {e for k in narrow for e in self.by_word[k]}
        found = []
        for entry in entries:
            own = self.words[entry]
            if not self._kind_fits(words, entry):
                continue
            if len(own) > len(words) == 2 and own[-1] in self.kinds:
                # The first and the last word may stand for a longer name.
                costs = [readings[0].get(own[0]), readings[1].get(own[-1])]
                if None not in costs:
                    found.append((sum(costs) + 0.5 * (len(own) - 2), -self.often[entry], entry))
                continue
            if len(own) != len(words):
                continue
            for turn, extra in ((0, 0.0), (1, 0.2), (len(own) - 1, 0.2)):
                turned = own[turn:] + own[:turn]
                costs = [r.get(w) for r, w in zip(readings, turned, strict=True)]
                if None not in costs:
                    found.append((sum(costs) + extra, -self.often[entry], entry))
                    break
        if len(found) > 1:
            found.sort()
            # Abbreviations that fit two entries equally well tell neither.
            if found[1][0] == found[0][0] and found[0][0] > 0:
                return []
        return found


def digits(text: str) -> str:
    """The number a key ends with."""
    return re.search(r"\d*$", text)[0]


def match_values(frame: DataFrame, id_column: str, value_column: str, reference: DataFrame, keys: tuple[str, str, str] = ("building_id", "name", "official_name")) -> DataFrame:
    """(row_id, value, entry) of each row whose value is neither null, blank nor an entry as written; entry -1 means none."""
    key, name, official = keys
    listed = reference.select(reference[key].cast("long").alias("k"), reference[name].alias("n"), reference[official].alias("o")).filter("n is not null")
    if listed.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries, too many to send to every executor")
    rows = listed.collect()
    spark = frame.sparkSession
    values = frame.select(frame[id_column].cast("long").alias("row_id"), frame[value_column].alias("value"))
    exact = values.join(F.broadcast(listed.select(F.col("n").alias("value"))), "value").groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    often = {r["value"]: r["often"] for r in exact.collect()}
    sent = spark.sparkContext.broadcast({"rows": [(r["k"], r["n"], r["o"], often.get(r["n"], 0)) for r in rows]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps the broadcast value between tasks, and so the dictionary.
        held = sent.value
        if "index" not in held:
            held["index"] = Reference(held["rows"])
        index = held["index"]
        answers: dict[str, int | None] = {n: None for _, n, _, _ in held["rows"]}
        by_letters: dict[str, int] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            found = []
            for value in coded.dictionary.to_pylist():
                if value not in answers:
                    if len(answers) > REMEMBERED:
                        answers = {n: None for _, n, _, _ in held["rows"]}
                        by_letters = {}
                    # Values that differ in case and outer white space only are resolved once.
                    form = value if CAMEL.search(value) else value.lower()
                    form = " ".join(form.split())
                    if not form:
                        answers[value] = None
                    else:
                        if form not in by_letters:
                            by_letters[form] = index.resolve(form)
                        answers[value] = by_letters[form]
                found.append(answers[value])
            entry = pa.array(found, pa.int64()).take(coded.indices)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), entry], names=["row_id", "value", "entry"])
            yield out.filter(entry.is_valid())

    return values.filter(F.col("value").rlike(r"\S")).mapInArrow(run, "row_id long, value string, entry long")
