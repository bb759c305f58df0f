"""Trigrams that every match of a regular expression must contain."""

from __future__ import annotations

import re
from re import _constants as sre  # the parse tree of the standard library's compiler
from re import _parser

Group = frozenset[str]


#: Alternatives of one literal that are followed apart before the literal is cut.
SPREAD = 16


def _literals(tree) -> tuple[list[Group], Group | None]:
    """Groups of alternative literals, one of each group being in every match, and all texts of the
    tree if it has only a few."""
    groups: list[Group] = []
    run: Group = frozenset([""])
    exact: Group | None = frozenset([""])

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 3:
            groups.append(run)
        run = frozenset([""])

    def grow(texts: Group) -> None:
        nonlocal run, exact
        if len(run) * len(texts) > SPREAD:
            close()
            run = texts if len(texts) <= SPREAD else frozenset([""])
        else:
            run = frozenset(r + t for r in run for t in texts)
        both = None if exact is None else frozenset(e + t for e in exact for t in texts)
        exact = both if both is not None and len(both) <= SPREAD else None

    for op, arg in tree:
        if op is sre.AT and arg is not sre.AT_BEGINNING:
            continue
        texts: Group | None = None
        inner: list[Group] = []
        if op is sre.AT:
            texts = frozenset(["\n"])  # a line begins after a line feed; the text is read with one before it
        elif op is sre.LITERAL:
            texts = frozenset([chr(arg).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            texts = frozenset(chr(a).lower() for _, a in arg)
        elif op is sre.SUBPATTERN:
            inner, texts = _literals(arg[3])
        elif op is sre.BRANCH:
            parts = [_literals(branch) for branch in arg[1]]
            if all(t is not None for _, t in parts):
                texts = frozenset().union(*[t for _, t in parts])
            else:
                best: set[str] = set()
                for groups_of, text in parts:
                    pick = text if text is not None and min(map(len, text)) >= 3 else max(groups_of, key=lambda g: min(map(len, g)), default=None)
                    if pick is None:
                        break
                    best |= pick
                else:
                    inner = [frozenset(best)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _literals(arg[2])[0]
        if texts is not None:
            grow(texts)
        else:
            close()
            groups += inner
            exact = None
    close()
    return groups, exact


def required(pattern: str) -> list[list[frozenset[str]]]:
    """Condition on the trigrams of a lower-cased text with a line feed before it: all of (any of (all
    trigrams of a literal)).

    An empty list means that the pattern demands no trigram, so that every text is a candidate.
    """
    groups, _ = _literals(_parser.parse(pattern, re.IGNORECASE | re.MULTILINE))
    return [[frozenset(lit[i : i + 3] for i in range(len(lit) - 2)) for lit in sorted(g)] for g in groups]


def vocabulary(conditions: list[list[list[frozenset[str]]]]) -> list[str]:
    """All trigrams that any condition asks for, in alphabetical order."""
    return sorted({t for cond in conditions for group in cond for lit in group for t in lit})


def satisfied(condition: list[list[frozenset[str]]], present: set[str]) -> bool:
    """Whether the postings of a chunk meet a pattern's condition."""
    return all(any(lit <= present for lit in group) for group in condition)
