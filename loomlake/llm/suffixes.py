"""Suffix structures over sequences of whole numbers, for one bounded bin of strings inside a task."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in rising order, by linear grouping; every value is above 0. An empty text has none.

    First part: suffixes start in groups by first symbol. Groups are taken from the highest down. For every suffix i of the
    group its pointer goes to the nearest earlier suffix p in a lower group; the k suffixes of the group that point to p
    follow p's own prefix, so p moves up into a new group right above its old one, the higher the larger k is. In the end a
    group holds the suffixes with one Lyndon prefix. Second part: suffixes are taken in rising order; each one, s, gives
    their places to the suffixes whose Lyndon prefix ends before s, along the pointers, at the front of their groups. No
    part renames the text or calls itself.
    """
    if not text:
        return []
    text = [*text, 0]
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, x in enumerate(text):
        by_symbol.setdefault(x, []).append(i)
    members, below, above, group = [], [], [], [0] * n
    for g, x in enumerate(sorted(by_symbol)):
        members.append(by_symbol[x])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[x]:
            group[i] = g
    top = len(members) - 1
    above[top] = -1
    pointer, done = [-1] * n, bytearray(n)
    order = []  # groups from the highest
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            order.append(g)
        pointed: list[int] = []
        times: list[int] = []
        for i in own:
            done[i] = 1
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                if pointed and pointed[-1] == p:
                    times[-1] += 1
                else:
                    pointed.append(p)
                    times.append(1)
        if len(pointed) == 1:
            moved = {(group[pointed[0]], times[0]): pointed}
        else:
            moved = {}
            for p, k in zip(pointed, times):
                moved.setdefault((group[p], k), []).append(p)
        # a group's movers with the most followers come highest, so larger counts are put in place first
        for (old, _), ps in sorted(moved.items(), key=lambda x: -x[0][1]) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(ps)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in ps:
                group[p] = new
        g = below[g]
    front, at = {}, 0
    for g in reversed(order):
        front[g] = at
        at += len(members[g])
    placed, ranked = bytearray(n), [0] * n
    ranked[0] = n - 1
    placed[n - 1] = 1
    front[group[n - 1]] += 1
    for k in range(n):
        j = ranked[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            ranked[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = pointer[j]
    return ranked[1:]


def equal_runs(text: list[int], starts: np.ndarray, length: int) -> np.ndarray:
    """For each of `starts`, the number of its class: starts are of one class where the next `length` symbols are equal.

    The suffix array puts the starts of a class side by side. Every start must have `length` symbols before the end.
    """
    ranked = np.asarray(suffix_array(text), np.int64)
    values = np.asarray(text, np.int64)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    ranked = ranked[wanted[ranked]]
    same = np.ones(max(len(ranked) - 1, 0), bool)
    for t in range(length):
        same &= values[ranked[1:] + t] == values[ranked[:-1] + t]
    classes = np.zeros(len(text), np.int64)
    classes[ranked] = np.concatenate([[0], np.cumsum(~same)]) if len(ranked) else []
    return classes[starts]


class SuffixAutomaton:
    """The suffix automaton of a sequence, with the number of places where each state's strings end."""

    def __init__(self, text):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, count, last = [-1], [0], [0], 0
        for x in text:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            count.append(1)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    count.append(0)
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur
        for s in sorted(range(1, len(count)), key=self.length.__getitem__, reverse=True):
            count[self.link[s]] += count[s]
        self.count = count

    def matching(self, text, most: int) -> tuple[list[int], list[int]]:
        """For each symbol of `text`: the length, `most` at most, of the longest string that ends there and occurs in the sequence, and how often that string occurs."""
        lengths, counts, state, matched = [], [], 0, 0
        for x in text:
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                matched += 1
            while state and self.length[self.link[state]] >= most:
                state = self.link[state]
            matched = min(matched, self.length[state], most)
            lengths.append(matched)
            counts.append(self.count[state])
        return lengths, counts
