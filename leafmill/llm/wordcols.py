"""Words and word shingles as DataFrame expressions.

Words are runs of ASCII digits, ASCII letters and all characters beyond ASCII, after
lower-casing A-Z only.  ``word_slots`` may hold an empty string first and last, where a text
begins or ends with other characters; the helpers here account for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_lower

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of keys that may be broadcast; larger key sets are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def word_slots(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1)


def words(text: Column) -> Column:
    """The words alone."""
    return F.filter(word_slots(text), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without making them: a capital letter is as good a word character."""
    slots = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    edge = lambda i: (F.element_at(slots, i) == "").cast("int")
    return F.when(F.size(slots) == 1, 1 - edge(1)).otherwise(F.size(slots) - edge(1) - edge(-1)).cast("long")


def shingles(words: Column, width: int) -> Column:
    """The word shingles in order, as arrays; fewer words than width are one, none give none."""
    n = F.size(words)
    return (
        F.when(n == 0, F.array().cast("array<array<string>>"))
        .when(n < width, F.array(words))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice(words, i, width)))
    )


def fits_broadcast(keys: DataFrame, column: str) -> bool:
    """Whether the keys, strings or numbers, are few enough to be sent to every executor."""
    size = keys.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 48)).first()[0]
    return (size or 0) <= BROADCAST_BYTES
