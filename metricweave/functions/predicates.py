"""Row filters on time and tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# text without a character that means something in a pattern
PLAIN = re.compile(r"[\w\s:,/=@-]+")


def time_between(time: Column, after=None, before=None) -> Column:
    """Both bounds exclusive; either may be left out or be an expression such as
    ``F.current_timestamp() - F.expr("interval 4 hours")``."""
    keep = F.lit(True)
    if after is not None:
        keep = keep & (time > after)
    if before is not None:
        keep = keep & (time < before)
    return keep


def tag_matches(tag: Column, *patterns: str) -> Column:
    """Every pattern is found somewhere in the tag (no anchoring).

    Plain text, and plain text after ``^``, become ``contains`` and
    ``startswith``, which reach the file scan; other patterns do not.
    """
    keep = F.lit(True)
    for pattern in patterns:
        if PLAIN.fullmatch(pattern):
            keep = keep & tag.contains(pattern)
        elif pattern.startswith("^") and PLAIN.fullmatch(pattern[1:]):
            keep = keep & tag.startswith(pattern[1:])
        else:
            keep = keep & tag.rlike(pattern)
    return keep
