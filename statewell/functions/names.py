"""Column expressions that parse and recode identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1-based parts of an underscore-separated sample name.
LAYOUT_TRAINING = {"timepoint": 1, "subject_id": 2, "condition": 4, "sex": 6, "group": 7}
LAYOUT_VALIDATION = {"timepoint": 1, "subject_id": 2, "condition": 3, "sex": 5, "group": None}
# Recoded condition labels.
CONDITION_CODES = {"Ctrl": "CTL"}
# Identifier patterns and prefixes.
VERSION_SUFFIX = r"\.[0-9]+$"
SPARSE_SAMPLE = r"^WK[0-9]"
MATURE_SUFFIX = r"\.mature$"
LIBRARY_PREFIX = "COHP_"
STAGE_GENOTYPE = r"^.+_S([124])_(ZZ|ZW)$"


def strip_suffix(c: Column, pattern: str = VERSION_SUFFIX) -> Column:
    """Drop a trailing pattern."""
    return F.regexp_replace(c, pattern, "")


def name_part(c: Column, position: int, separator: str = "_") -> Column:
    """1-based part of a separated name, null when there are too few parts."""
    return F.get(F.split(c, separator), position - 1)


def parse_name(c: Column, layout: Mapping[str, int | None], separator: str = "_") -> list[Column]:
    """Named fields of a sample name; a part of None is a null field."""
    return [
        (F.lit(None).cast("string") if pos is None else name_part(c, pos, separator)).alias(name)
        for name, pos in layout.items()
    ]


def recode(c: Column, codes: Mapping[str, str] = CONDITION_CODES) -> Column:
    """Replace listed values, keep the rest."""
    out = c
    for old, new in codes.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def has_prefix(c: Column, pattern: str = SPARSE_SAMPLE) -> Column:
    """P5: true for samples outside the cohort contract."""
    return c.rlike(pattern)


def library_id(c: Column, prefix: str = LIBRARY_PREFIX) -> Column:
    """Prefixed numeric last token, null when it is not numeric."""
    digits = F.regexp_extract(c, r"(?:^|_)([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), digits))


def subject_time_key(c: Column, order: Sequence[int] = (2, 1), separator: str = "_") -> Column:
    """Composite subject/time key from parts of a name."""
    return F.concat_ws(separator, *[name_part(c, p, separator) for p in order])


def classify(c: Column, pattern: str = STAGE_GENOTYPE) -> tuple[Column, Column]:
    """(stage, genotype) captured from an id, null where it does not parse."""
    hit = c.rlike(pattern)
    return (
        F.when(hit, F.concat(F.lit("S"), F.regexp_extract(c, pattern, 1))),
        F.when(hit, F.regexp_extract(c, pattern, 2)),
    )
