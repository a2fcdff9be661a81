"""From the words of a query to its terms and their boolean plan."""

from __future__ import annotations

from dataclasses import dataclass

from .analyzer import search_tokens

#: Words of more characters may have typos.
SHORT = 3


@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool
    typos: int  # most edits

    @property
    def fuzzy(self) -> bool:
        return self.typos > 0


@dataclass(frozen=True)
class TextPlan:
    words: list[str]
    terms: list[Term]

    @property
    def slots(self) -> int:
        return len(self.words)


def edits(word: str) -> int:
    return 0 if len(word) <= SHORT else 1 if len(word) < 8 else 2


def text_plan(q) -> TextPlan:
    """The terms of a query text: its words, neighbours joined, and all joined. The last word is a prefix unless a space follows."""
    words = [w for w, _ in search_tokens(q)] if isinstance(q, str) else []
    last = bool(words) and not q.endswith(" ")
    n = len(words)
    if n == 0:
        return TextPlan([], [])
    if n == 1:
        return TextPlan(words, [Term(words[0], last, edits(words[0]))])
    if n == 2:
        a, b = words
        return TextPlan(words, [Term(a, False, edits(a)), Term(b, last, edits(b)), Term(a + b, True, 0)])
    terms = []
    for i, w in enumerate(words):
        terms.append(Term(w, last and i == n - 1, edits(w)))
        if i < n - 1:
            terms.append(Term(w + words[i + 1], i == n - 2, 0))
    return TextPlan(words, [*terms, Term("".join(words), True, 0)])


def holds(plan: TextPlan, has):
    """The boolean plan over has(i), whether term i is in the document; and, or as operators of what has() gives."""
    n = plan.slots
    if n == 1:
        return has(0)
    if n == 2:
        return (has(0) & has(1)) | has(2)
    out = None
    for i in range(n):
        one = has(2 * i)
        if i:
            one = one | has(2 * i - 1)
        if i < n - 1:
            one = one | has(2 * i + 1)
        out = one if out is None else out & one
    return out | has(2 * n - 1)
