"""Rule-based location classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.arrays import let, one_of
from tidemark.functions.text import SPACE_CLASS, strip


def _code(codes, closers: str) -> str:
    """A two-letter code standing alone between the usual separators."""
    return rf"(?iu)(?:^|[{SPACE_CLASS},(])(?:{'|'.join(codes)})(?:$|[{SPACE_CLASS}{closers}])"


_CANADA = one_of(("canada", "(can)", *fv.PROVINCES))
_PROVINCE_CODE = _code(fv.PROVINCE_CODES, ",).|")
_INCLUSIVE = one_of(fv.CANADA_INCLUSIVE_REGIONS)
_FOREIGN = one_of(fv.FOREIGN_PLACES)
_US = "(?U)" + fv.US_PATTERN
_STATE_CODE = _code(fv.US_STATE_CODES, ",).|")
_CITY = one_of(fv.CITIES)
_ARRANGEMENT = one_of(fv.ARRANGEMENT_WORDS)


def segment_kind(segment: Column) -> Column:
    """'ca', 'foreign', 'arrangement' or 'unknown' for one location segment.

    Strong Canadian signs come before the foreign list ("London, ON"), bare
    city names after it ("Melbourne, Victoria").  What is left once arrangement
    words are removed decides the rest: a place next to "remote" scopes the
    role there, a place on its own is merely unknown.
    """
    def kind(seg: Column) -> Column:
        names_place = F.regexp_replace(seg, _ARRANGEMENT, " ").rlike("[a-z]")
        return (
            F.when(seg.rlike(_CANADA), "ca")
            .when(seg.rlike(_PROVINCE_CODE), "ca")
            .when(seg.rlike(_INCLUSIVE), "ca")
            .when(seg.rlike(_FOREIGN) | seg.rlike(_US) | seg.rlike(_STATE_CODE), "foreign")
            .when(seg.rlike(_CITY), "ca")
            .when(~names_place, "arrangement")
            .when(seg.rlike(_ARRANGEMENT), "foreign")
            .otherwise("unknown")
        )

    return let(F.lower(segment), kind)


def looks_canadian(location: Column) -> Column:
    """Keep any Canadian segment; drop what only names foreign places.

    Unstated and merely unknown places are kept, an unknown place beside an
    arrangement ("Hamburg | Remote") is not.
    """
    segments = F.filter(F.split(location, "[|;]"), lambda s: strip(s) != "")

    def keep(kinds: Column) -> Column:
        def has(k: str) -> Column:
            return F.array_contains(kinds, k)

        scoped = has("arrangement") & has("unknown")
        return has("ca") | (~has("foreign") & ~scoped)

    return F.coalesce(let(F.transform(segments, segment_kind), keep), F.lit(True))
