"""Ignore rules of a repository as one automaton.

Every rule is a row of tokens over the characters of a path; all rows together are
one nondeterministic automaton, whose sets of states are made deterministic as
paths need them.  So a path is walked once, character by character, whatever the
number of rules; of the rules that match, the last one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sets of states that are remembered before they are built anew.
MOST_STATES = 20_000
#: What a token takes: itself, one character but a slash, any number of these, any number of any.
ONE, SOME, ANY = "?", "*", "**"


class RuleSet:
    """The last rule that matches a path, by ``(line, folder)`` in order; lines that are no rules are passed over.

    A line is what ``scan.compile_rule`` reads: it holds below ``folder``, where the
    rule's name may stand anywhere unless it begins with a slash.
    """

    def __init__(self, lines: Iterable[tuple[str, str]]):
        self.tokens: list[tuple[str, bool]] = []  # a token, and whether it is a wildcard
        self.done: dict[int, int] = {}  # the state after a rule's last token, and the rule
        self.negated: list[bool] = []
        begins = []
        for line, folder in lines:
            text = line.strip()
            if not text or text.startswith("#"):
                continue
            negate = text.startswith("!")
            text = text[1:] if negate else text
            text = text[:-1] if text.endswith("/") else text
            anchored = text.startswith("/")
            text = text[1:] if anchored else text
            row = [(c, False) for c in (folder + "/" if folder else "")]
            inner = [{"**": (ANY, True), " ": (ANY, True), "*": (SOME, True), "?": (ONE, True)}.get(t, (t, False)) for t in re.findall(r"\*\*|.", text, re.S)]
            for place in [[]] if anchored else [[], [(ANY, True), ("/", False)]]:
                begins.append(len(self.tokens))
                self.tokens += [*row, *place, *inner, ("", False)]  # the last one takes nothing
                self.done[len(self.tokens) - 1] = len(self.negated)
            self.negated.append(negate)
        self.begins = begins
        self.forget()

    def forget(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.best: list[int] = []
        self.steps: list[dict[str, int]] = []
        self.start = self.state(self.closure(self.begins))

    def closure(self, states: Iterable[int]) -> frozenset:
        """With what follows a token that may take nothing."""
        found, waiting = set(), list(states)
        while waiting:
            s = waiting.pop()
            if s not in found:
                found.add(s)
                if self.tokens[s] in ((SOME, True), (ANY, True)):
                    waiting.append(s + 1)
        return frozenset(found)

    def state(self, states: frozenset) -> int:
        if states not in self.known:
            self.known[states] = len(self.sets)
            self.sets.append(states)
            self.best.append(max((self.done[s] for s in states if s in self.done), default=-1))
            self.steps.append({})
        return self.known[states]

    def step(self, at: int, c: str) -> int:
        after = []
        for s in self.sets[at]:
            token, wild = self.tokens[s]
            if not wild:
                if token == c:
                    after.append(s + 1)
            elif token == ANY or c != "/":
                after.append(s + 1 if token == ONE else s)
        self.steps[at][c] = found = self.state(self.closure(after))
        return found

    def last(self, path: str) -> int:
        """The number of the last rule that matches, or -1: a rule's name ends where a segment does."""
        if len(self.sets) > MOST_STATES:
            self.forget()
        at, best = self.start, -1
        for c in path:
            if c == "/" and self.best[at] > best:
                best = self.best[at]
            after = self.steps[at].get(c)
            at = self.step(at, c) if after is None else after
        return max(best, self.best[at])

    def excludes(self, path: str) -> bool:
        rule = self.last(path)
        return rule >= 0 and not self.negated[rule]


def excluded(path: Column, lines: list[tuple[str, str]]) -> Column:
    """Whether the last rule that matches a path excludes it; ``lines`` are ``(line, folder)``."""

    @F.pandas_udf("boolean")
    def run(paths: pd.Series) -> pd.Series:
        rules = RuleSet(lines)
        return paths.map(lambda p: None if p is None else rules.excludes(p))

    return run(path)
