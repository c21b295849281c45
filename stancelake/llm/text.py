"""Word forms shared by the text operators."""

from __future__ import annotations

import re

#: A word: a run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits of the whole text; none for null."""
    return WORD.findall(text.lower()) if text else []


def strip_tags(text: str) -> str:
    """The text with markup tags replaced by blanks."""
    return _TAG.sub(" ", text) if "<" in text else text
