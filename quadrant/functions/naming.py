"""Names of buildings: tidying, agreement of words, title case, lines joined to one label. Column expressions; null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _initials(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[A-Z]"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def tidy_name(raw: Column, renames: dict[str, str] | None = None) -> Column:
    """A drawing's name as people say it: renamed if listed, without bracketed rooms, room numbers and "Division"; of "Head - Tail" the abbreviation
    becomes "Head (Tail)", else the head if it is longer, else the tail."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"(?i)\s*\((?:Rm|Room)[^)]*\)", ""), r"(?i),?\s*Room\s+\d+\w*", ""), r"(?i)\s+Division$", ""))
    pattern = r"^(.*?)\s+-\s+([A-Z][A-Za-z0-9 -]{0,14})$"
    head, tail = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    short = F.upper(F.regexp_replace(tail, "[^A-Za-z]", ""))
    told = F.when(~name.rlike(pattern), name).when(short == _initials(head), F.concat(head, F.lit(" ("), tail, F.lit(")"))).when(F.length(tail) < F.length(head), head).otherwise(tail)
    for old, new in (renames or {}).items():
        told = F.when(raw == old, F.lit(new)).otherwise(told)
    return told


def long_words(text: Column) -> Column:
    """The words of three ASCII letters and more, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 3)


def agreement(text: Column, official: Column) -> Column:
    """How many words of a text begin a word of the official name, or are begun by one."""
    own, other = long_words(text), long_words(official)
    return F.size(F.filter(own, lambda w: F.exists(other, lambda a: a.startswith(w) | w.startswith(a))))


def word_set(text: Column, stop_words: tuple[str, ...] = ("and", "the", "of", "at")) -> Column:
    """The distinct words of ASCII letters without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), lambda w: (w != "") & ~w.isin(*stop_words)))


def says_the_same(a: Column, b: Column) -> Column:
    """Whether the words of one text are all words of the other; a text without words says nothing."""
    x, y = word_set(a), word_set(b)
    within = lambda p, q: (F.size(p) > 0) & (F.size(F.array_except(p, q)) == 0)
    return within(x, y) | within(y, x)


def title_case(text: Column) -> Column:
    """Words in capitals with only the first letter left so; other words as they are."""
    capital = r"\p{Lu}[\p{Lu}']*"
    parts = F.regexp_extract_all(text, F.lit(rf"({capital}|[^\p{{Lu}}]+)"), F.lit(1))
    told = F.transform(parts, lambda p: F.when(p.rlike(rf"^{capital}$"), F.concat(F.substring(p, 1, 1), F.lower(F.substr(p, F.lit(2))))).otherwise(p))
    return F.array_join(told, "")


def join_lines(lines: Column) -> Column:
    """Lines of a label as one text: with spaces, but for two single words of which the second goes on in lower case."""
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    tight = (F.size(lines) == 2) & ~first.contains(" ") & ~second.contains(" ") & second.rlike("^[a-z]")
    return F.when(tight, F.concat(first, second)).otherwise(F.array_join(lines, " "))


def plain_text(html: Column, line_break: str = "\u0001") -> Column:
    """Markup as text: <br> becomes ``line_break``, other tags vanish, entities and numeric ones are resolved (unknown ones are a space), white space is one space."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", line_break), "<[^>]+>", "")
    text = F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#\d+;|&|[^&]+)"), F.lit(1))
    coded = F.transform(pieces, lambda p: F.when(p.rlike(r"^&#\d+;$"), F.char(F.regexp_extract(p, r"\d+", 0).cast("int"))).otherwise(p))
    text = F.regexp_replace(F.array_join(coded, ""), "&[a-z]+;", " ")
    return F.trim(F.regexp_replace(text, rf"[^\S{line_break}]+", " "))
