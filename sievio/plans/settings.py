"""Settings of an index and of a query."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from ..errors import QueryError

RULES = ("typos", "proximity", "field", "position", "exact")
_LIMITS = {"maxHits": 1000, "fullScanThreshold": 5000}


@dataclass(frozen=True)
class Settings:
    indexedFields: list[str] | None = None
    facetFields: list[str] = field(default_factory=list)
    hitsPerPage: int = 20
    maxHits: int = 500
    maxFacetResults: int = 10
    rankAlgorithm: list[str] = field(default_factory=lambda: list(RULES))
    rankBy: dict[str, str] | None = None
    sortBy: dict[str, str] | None = None
    fullScan: bool = False
    fullScanThreshold: int = 25000
    getFields: list[str] | None = None
    highlightFields: list[str] | None = field(default_factory=lambda: ["*"])
    highlightSource: bool = False

    def changed(self, given: dict, query: bool = False) -> Settings:
        """These settings with those of `given`; a query can't change which fields are indexed."""
        new: dict = {}
        for key, value in given.items():
            if key not in self.__dataclass_fields__ or query and key in ("indexedFields", "facetFields"):
                continue
            new[key] = _checked(key, value)
        s = replace(self, **new)
        if s.maxHits > _LIMITS["maxHits"]:
            raise QueryError("maxHits is too large")
        if s.hitsPerPage > s.maxHits:
            raise QueryError("hitsPerPage is larger than maxHits")
        if s.fullScanThreshold < _LIMITS["fullScanThreshold"]:
            raise QueryError("fullScanThreshold is too small")
        return s

    def as_dict(self) -> dict:
        return asdict(self)


def _checked(key: str, value):
    def bad(what: str):
        return QueryError(f"{key} must be {what}")

    if key in ("indexedFields", "facetFields", "getFields", "highlightFields", "rankAlgorithm"):
        if value is None and key in ("getFields", "highlightFields"):
            return None
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise bad("a list of strings")
        if key == "rankAlgorithm" and any(v not in RULES for v in value):
            raise bad(f"a list of {', '.join(RULES)}")
        return value
    if key in ("rankBy", "sortBy"):
        if value is None:
            return None
        if not isinstance(value, dict) or any(v not in ("asc", "desc") for v in value.values()):
            raise bad("an object {field: asc or desc}")
        return dict(list(value.items())[-1:]) or None  # the last key wins
    if key in ("fullScan", "highlightSource"):
        if not isinstance(value, bool):
            raise bad("true or false")
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
        raise bad("a number")
    return int(value)
