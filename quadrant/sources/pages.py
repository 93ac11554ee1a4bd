"""Label-value items out of HTML pages.

Comments are dropped, every list item is read as 'label: value', line breaks inside a value are kept as such. Expressions only: a page is cut at its cards,
a card at its items.

Defined results: null or empty pages give no rows; an item without a colon has a null label; entities and other markup of values are left to the
operator that splits them; repeated pages give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARD = r"(?i)<(?:div|article|details)\b[^>]*>"
ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"


def visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def items(frame: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, card, item, label, value): the items of every card of every page, in order from 1."""
    cards = frame.select(frame[id_column].alias("id"), F.posexplode(F.filter(F.split(visible(frame[html_column]), CARD, -1), lambda c: c.rlike(r"(?i)<li\b"))).alias("card", "text"))
    found = cards.select("id", (F.col("card") + 1).alias("card"), F.posexplode(F.regexp_extract_all("text", F.lit(ITEM), F.lit(1))).alias("item", "raw"))
    bare = F.regexp_replace("raw", r"(?i)</?(?:b|strong|span|em|dt|dd)\b[^>]*>", "")
    found = found.select("id", "card", (F.col("item") + 1).alias("item"), bare.alias("raw"))
    label = F.when(F.instr("raw", ":") > 0, F.trim(F.substring_index("raw", ":", 1)))
    value = F.when(F.instr("raw", ":") > 0, F.expr("substr(raw, instr(raw, ':') + 1)")).otherwise(F.col("raw"))
    return found.select("id", "card", "item", label.alias("label"), F.trim(value).alias("value"))
