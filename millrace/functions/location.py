"""Location gates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Places of the region.
REGION = [
    r"\bmetro\b", r"metropolitan", r"national\s+capital\b", r"\bncr\b", r"\bmanila\b", r"\bmakati\b", r"\btaguig\b", r"quezon\s+city", r"\bqc\b", r"\bpasig\b", r"\bpasay\b",
    r"paranaque|parañaque", r"mandaluyong", r"muntinlupa", r"marikina", r"caloocan", r"las\s+pinas|las\s+piñas", r"malabon", r"navotas", r"valenzuela", r"\bsan\s+juan\b", r"pateros",
    r"\bortigas\b", r"\beastwood\b", r"\bnovaliches\b", r"\balabang\b", r"\bbinondo\b", r"\bbgc\b", r"\bbonifacio\b", r"\bp00\b",
]
COUNTRY = r"^\s*(remote(\s+in(\s+the)?)?\s*[-–,]?\s*)?(philippines|ph)\s*$|^\s*(philippines|ph)\s*[-–,]?\s*remote\s*$"
REMOTE = r"^\s*remote(\s*\(.*\))?\s*$|remote\s+(worldwide|global|anywhere|first)|worldwide|anywhere"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def in_region(c: Column, patterns: list[str] = REGION) -> Column:
    """FLT-1: a place of the region; blank passes."""
    return (_text(c) == "") | _text(c).rlike(f"(?iu){'|'.join(patterns)}")


def in_region_or_country(c: Column) -> Column:
    """FLT-2: the region, or the bare country."""
    return in_region(c) | _text(c).rlike(f"(?iu){COUNTRY}")


def is_remote(c: Column) -> Column:
    """FLT-3: a mark of worldwide remote work; blank fails."""
    return _text(c).rlike(f"(?iu){REMOTE}")


def location_gate(location: Column, loose: Column) -> Column:
    """FLT-4: remote passes; else the loose gate for flagged rows, the strict one for others."""
    return is_remote(location) | F.when(F.coalesce(loose, F.lit(False)), in_region_or_country(location)).otherwise(in_region(location))
