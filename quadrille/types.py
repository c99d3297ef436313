"""Codes, query descriptions and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum, IntEnum


class QuadrilleError(Exception):
    """Base of the engine's errors."""


class InvalidGeometry(QuadrilleError): ...


class InvalidQueryType(QuadrilleError): ...


class InvalidParameter(QuadrilleError): ...


class UnsupportedFeature(QuadrilleError): ...


class UnknownDataset(QuadrilleError): ...


# Codes of query types, relations and results.
class QueryType(IntEnum):
    RANGE = 0
    INTERSECTION = 1
    INSIDE = 2
    DISJOINT = 3
    EQUAL = 4
    MEET = 5
    CONTAINS = 6
    COVERS = 7
    COVERED_BY = 8
    FIND_RELATION = 9
    DISTANCE = 10
    KNN = 11
    NONE = 777


class Relation(IntEnum):
    DISJOINT = 0
    INTERSECT = 1
    INSIDE = 2
    CONTAINS = 3
    COVERED_BY = 4
    COVERS = 5
    EQUAL = 6
    MEET = 7


class ResultType(Enum):
    COUNT = "COUNT"
    COLLECT = "COLLECT"
    KNN = "KNN_COLLECT"


class DataType(Enum):
    POINT = "POINT"
    LINESTRING = "LINESTRING"
    BOX = "BOX"
    POLYGON = "POLYGON"


class FileType(Enum):
    CSV = "CSV"
    WKT = "WKT"


class IndexType(Enum):
    TWO_LAYER = "TWO_LAYER"
    UNIFORM_GRID = "UNIFORM_GRID"


QUERY_NAMES = {
    "range": QueryType.RANGE, "intersect": QueryType.INTERSECTION, "disjoint": QueryType.DISJOINT, "equal": QueryType.EQUAL,
    "meet": QueryType.MEET, "inside": QueryType.INSIDE, "contains": QueryType.CONTAINS, "covers": QueryType.COVERS,
    "covered_by": QueryType.COVERED_BY, "find_relation": QueryType.FIND_RELATION, "distance": QueryType.DISTANCE, "kNN": QueryType.KNN,
}
PREDICATES = {v: k for k, v in QUERY_NAMES.items() if v in range(QueryType.INTERSECTION, QueryType.FIND_RELATION)}


def query_type(name: str) -> QueryType:
    try:
        return QUERY_NAMES[name]
    except KeyError:
        raise InvalidQueryType(name) from None


def member(kind: type[Enum], name):
    """A member of an enumeration by itself, its value or its name."""
    if isinstance(name, kind):
        return name
    for m in kind:
        if name in (m.value, m.name):
            return m
    raise InvalidParameter(f"{name!r} is no {kind.__name__}")


@dataclass(frozen=True)
class Bounds:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __post_init__(self):
        for lo, hi in (("xmin", "xmax"), ("ymin", "ymax")):
            a, b = getattr(self, lo), getattr(self, hi)
            object.__setattr__(self, lo, min(a, b))
            object.__setattr__(self, hi, max(a, b))

    def union(self, other: Bounds) -> Bounds:
        return Bounds(min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax))


@dataclass(frozen=True)
class Query:
    query_id: int
    result: ResultType = ResultType.COUNT

    def _check(self, *allowed: ResultType):
        object.__setattr__(self, "result", member(ResultType, self.result))
        if self.result not in allowed:
            raise InvalidParameter(f"{type(self).__name__} gives no {self.result.value}")


@dataclass(frozen=True)
class RangeQuery(Query):
    dataset: int = 0
    wkt: str = ""

    def __post_init__(self):
        self._check(ResultType.COUNT, ResultType.COLLECT)
        if "POLYGON" not in self.wkt and "BOX" not in self.wkt:
            raise InvalidGeometry(f"a window is a POLYGON or a BOX: {self.wkt[:60]!r}")


@dataclass(frozen=True)
class PredicateJoinQuery(Query):
    r: int = 0
    s: int = 1
    kind: QueryType = QueryType.INTERSECTION
    scope: str = "candidates"

    def __post_init__(self):
        self._check(ResultType.COUNT, ResultType.COLLECT)
        if not QueryType.INTERSECTION <= self.kind <= QueryType.FIND_RELATION:
            raise InvalidQueryType(f"{self.kind!r} is no predicate")


@dataclass(frozen=True)
class DistanceJoinQuery(Query):
    r: int = 0
    s: int = 1
    distance: float = field(default=0.0)

    def __post_init__(self):
        self._check(ResultType.COUNT, ResultType.COLLECT)
        if not self.distance > 0:
            raise InvalidParameter("a distance is above 0")


@dataclass(frozen=True)
class KNNQuery(Query):
    dataset: int = 0
    wkt: str = ""
    k: int = 1

    def __post_init__(self):
        object.__setattr__(self, "result", ResultType.KNN)
        if "POINT" not in self.wkt:
            raise InvalidGeometry(f"a neighbour query starts at a POINT: {self.wkt[:60]!r}")
        if self.k <= 0:
            raise InvalidParameter("k is above 0")
