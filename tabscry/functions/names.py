"""Hints that a column name gives about its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that hint at a kind of column.
HINT_WORDS = {
    "id": ["id", "key", "uuid", "guid", "code"],
    "temporal": ["date", "time", "timestamp", "created", "updated", "year", "month", "day"],
    "geo": ["lat", "lon", "longitude", "latitude", "address", "location"],
    "categorical": ["type", "category", "status", "level", "grade", "class"],
    "ratio": ["rate", "ratio", "percent", "pct"],
    "count": ["count", "num", "quantity"],
}
# Words that make a column the entity of a panel.
ENTITY_WORDS = ["id", "user", "account", "device", "shop", "store", "customer", "member", "session"]
# Words that make a column an image reference.
IMAGE_WORDS = ["image", "img", "photo", "picture", "thumbnail", "avatar"]
IMAGE_FILE_PATTERN = r"(?i)\.(png|jpg|jpeg|gif|webp)(\?.*)?$"

# Words at the end of a name part that make a column a time axis.
TIME_AXIS_WORDS = ["date", "time", "timestamp", "epoch"]
TIME_AXIS_PATTERN = rf"(^|_)[a-z]*({'|'.join(TIME_AXIS_WORDS)})(_|$)"

# Words that also count at the end of a joined word, as in "orderkey" or "shipdate".
JOINED = {"key", "uuid", "guid", "date", "timestamp", "type", "status", "category", "address", "quantity"}


def word_pattern(words: list[str]) -> str:
    """Match a word as a whole name part, or a JOINED word at the end of a part."""
    joined = [w for w in words if w in JOINED]
    whole = f"(^|_)({'|'.join(words)})s?(_|$)"
    return whole if not joined else f"{whole}|[a-z]({'|'.join(joined)})(_|$)"


HINT_PATTERNS = {hint: word_pattern(words) for hint, words in HINT_WORDS.items()}
ENTITY_PATTERN = word_pattern(ENTITY_WORDS)
IMAGE_PATTERN = word_pattern(IMAGE_WORDS)


def has_hint(name: Column, hint: str) -> Column:
    return F.lower(name).rlike(HINT_PATTERNS[hint])
