"""Words as TESTDATA.md defines them, for Python workers."""

from __future__ import annotations

import re

#: Maximal runs of letters and digits of any script; ``_`` separates.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())
