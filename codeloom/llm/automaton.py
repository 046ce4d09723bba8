"""Minimal acyclic automata whose words are numbered by their place in the order."""

from __future__ import annotations

from collections.abc import Iterable


class Automaton:
    """Accepts the given words, which must be sorted and distinct; each has its place among them as its number.

    A state has a step for each letter: the next state, and how many words come before those that go this way. The number
    of a word is the sum of these counts along its path. States with the same steps are one.
    """

    def __init__(self, words: Iterable[str]) -> None:
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._below: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # nodes of the last word: whether it ends there, then (letter, state)
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905  the shorter one decides
                if a != b:
                    break
                same += 1
            self._close(path, before, same)
            path.extend([False] for _ in range(len(word) - same))
            path[-1][0] = True
            before = word
        self._close(path, before, 0)
        self.root = self._state(path.pop())
        del self._known, self._below

    def _close(self, path: list[list], word: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1].append((word[len(path) - 1], state))

    def _state(self, node: list) -> int:
        key = tuple(node)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.steps)
            count, steps = int(node[0]), {}
            for letter, to in node[1:]:
                steps[letter] = (to, count)
                count += self._below[to]
            self.steps.append(steps)
            self.final.append(node[0])
            self._below.append(count)
        return state

    def _number(self, state: int, number: int, rest: str) -> int:
        """Of the word that goes on from ``state`` with ``rest``, -1 if there is none."""
        steps = self.steps
        for letter in rest:
            step = steps[state].get(letter)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin with the first ``exact`` letters of ``word`` and differ from it by one letter inserted, deleted or replaced after them; each once."""
        steps, found = self.steps, []
        state, number, n = self.root, 0, len(word)
        for letter in word[:exact]:
            step = steps[state].get(letter)
            if step is None:
                return found
            state = step[0]
            number += step[1]
        for i in range(exact, n + 1):
            own, rest = word[i : i + 1], word[i + 1 :]
            following, whole = rest[:1], own + rest
            if own and own != following:  # of equal letters in a row the last is deleted
                found.append(self._number(state, number, rest))
            for letter, (to, k) in steps[state].items():
                if letter == own:  # inserted among equal letters: after the last
                    continue
                onward = steps[to]
                if own in onward or not own:
                    found.append(self._number(to, number + k, whole))
                if own and (following in onward or not following):
                    found.append(self._number(to, number + k, rest))
            step = steps[state].get(own)
            if step is None:
                break
            state = step[0]
            number += step[1]
        return [k for k in found if k >= 0]
