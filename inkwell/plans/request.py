"""Search requests: JSON to terms, ranges and paging, on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..functions.ids import day_floor, from_hex
from ..functions.text import query_tokens, query_words
from .errors import BadRequest, NotFound

Term = tuple[str, str, str]
#: A filter that the caller adds: given the found documents, a condition on their columns, or that and their relevance.
Check = Callable[[DataFrame], Column | tuple[Column, Column]]


@dataclass(frozen=True)
class Phrase:
    """Consecutive words that the stored title or content must hold."""

    mbox: str
    attr: str
    words: tuple[str, ...]

    @property
    def in_title(self) -> bool:
        return "title" in self.attr


@dataclass
class SearchRequest:
    """Terms are (mailbox, attribute, token): all positive ones must be posted for a document, no negative one may be."""

    positive: list[Term] = field(default_factory=list)
    negative: list[Term] = field(default_factory=list)
    phrases: list[Phrase] = field(default_factory=list)
    #: Smallest and largest id; None is no bound.
    start: int | None = None
    end: int | None = None
    cursor: int = 0
    limit: int | None = None
    mailboxes: list[str] = field(default_factory=list)

    @property
    def lowest(self) -> int | None:
        """A cursor replaces the start of the range."""
        return self.cursor if self.cursor else self.start

    @classmethod
    def from_json(cls, request: str | bytes | dict, short: int = 0, lowercase: bool = True) -> SearchRequest:
        """Read {request: {mailbox: {query, exact, negation}}, time: {start, end}, paging: {next_document_id, max_number}}."""
        doc = _parsed(request)
        out = cls()
        paging, time = _object(doc.get("paging")), _object(doc.get("time"))
        cursor = paging.get("next_document_id")
        out.cursor = from_hex(cursor) if isinstance(cursor, str) else 0
        limit = _int(paging.get("max_number"))
        out.limit = limit if limit is not None and limit > 0 else None
        start, end = _int(time.get("start")), _int(time.get("end"))
        try:
            out.start = day_floor(start) if start is not None else None
            out.end = day_floor(end) if end is not None else None
        except ValueError as e:
            raise BadRequest(str(e)) from e
        boxes = doc.get("request")
        if not isinstance(boxes, dict):
            raise BadRequest("'request' must be an object")
        for mbox, parts in boxes.items():
            if not isinstance(parts, dict):
                raise BadRequest(f"mailbox {mbox!r}: the query must be an object")
            out._add(mbox, parts, short, lowercase)
        return out

    def _add(self, mbox: str, parts: dict, short: int, lowercase: bool) -> None:
        def terms(name: str) -> list[Term]:
            found = ((mbox, attr, t) for attr, text in sorted(_object(parts.get(name)).items()) if isinstance(text, str) for t in query_tokens(text, short, lowercase))
            return list(dict.fromkeys(found))

        query = terms("query")
        if not query:
            raise NotFound(f"mailbox {mbox!r}: the query has no words")
        self.mailboxes.append(mbox)
        self.positive += query
        self.negative += terms("negation")
        exact = _object(parts.get("exact"))
        for attr, text in sorted(exact.items()):
            if isinstance(text, str) and (ws := query_words(text)):
                self.phrases.append(Phrase(mbox, attr, tuple(ws)))

    def __repr__(self) -> str:
        bits = [" ".join(".".join(t) for t in self.positive)]
        bits += [f"not {'.'.join(t)}" for t in self.negative]
        bits += [f'{p.mbox}.{p.attr}:"{" ".join(p.words)}"' for p in self.phrases]
        if self.lowest is not None or self.end is not None:
            bits.append(f"ids {self.lowest} to {self.end}")
        return f"SearchRequest({', '.join(bits)}, limit {self.limit})"


def _parsed(request: str | bytes | dict) -> dict:
    if isinstance(request, (str, bytes)):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise BadRequest(f"not JSON: {e}") from e
    if not isinstance(request, dict):
        raise BadRequest("the request must be an object")
    return request


def _object(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _int(x: object) -> int | None:
    """Whole numbers that fit in a long, as the JSON getters have it; anything else is missing."""
    return x if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63 else None
