"""Suffix sorting by groups of equal Lyndon prefixes, in linear time.

Phase 1 takes groups of suffixes from the largest to the smallest. Every
suffix i of the group finds its previous smaller position: the nearest j < i
in a group not yet taken. The Lyndon prefix of j grows by that of i, so j moves
to a new group just above its own (further above for each repetition). When the
smallest group is reached, each group holds the suffixes of one Lyndon prefix.
Phase 2 walks the array from its front: the suffix before each entry, and then
its chain of previous smaller positions, take the next free places of their
groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Positions of the sorted suffixes of text (a shorter one before its extensions)."""
    n = len(text)
    if n < 2:
        return list(range(n))
    members: list[list[int]] = []  # by group; may hold suffixes that have moved on
    below: list[int] = []  # the next smaller group
    group = [0] * n
    by_byte: dict[int, list[int]] = {}
    for i, b in enumerate(text):
        if b in by_byte:
            by_byte[b].append(i)
        else:
            by_byte[b] = [i]
    for b in sorted(by_byte):
        g = len(members)
        for i in by_byte[b]:
            group[i] = g
        members.append(by_byte[b])
        below.append(g - 1)
    skip = list(range(n))  # skip[i] = i while i is in no taken group
    smaller = [-1] * n
    taken: list[int] = []
    current = len(members) - 1
    above: dict[int, int] = {g - 1: g for g in range(1, len(members))}  # the next larger group
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = own
        taken.append(current)
        for i in own:
            skip[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and skip[j] != j:
                k = skip[j]
                if k >= 0:
                    skip[j] = skip[k]
                j = k
            skip[i] = j
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                key = (group[j], k)
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
            for (g, k), items in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
                new = len(members)
                members.append(items)
                for j in items:
                    group[j] = new
                top = above[g]
                below.append(g)
                above[g], above[new] = new, top
                below[top] = new
        current = below[current]
    place = [0] * len(members)
    at = 0
    for g in reversed(taken):
        place[g] = at
        at += len(members[g])
    order = [-1] * n
    placed = [False] * n
    j = n - 1  # the empty suffix stands before all others
    while j >= 0:
        g = group[j]
        order[place[g]] = j
        place[g] += 1
        placed[j] = True
        j = smaller[j]
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = smaller[j]
    return order


def repeats_of(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Groups of (piece, start) at which one string of ``length`` bytes starts, two places at least.

    The suffixes of all pieces are sorted together; suffixes with a common
    prefix of ``length`` bytes inside their piece are neighbours then.
    """
    text = b"\n".join(pieces)
    piece, left, start = [0] * len(text), [0] * len(text), 0
    for k, x in enumerate(pieces):
        for i in range(len(x)):
            piece[start + i], left[start + i] = k, len(x) - i
        start += len(x) + 1
    starts, at = [], 0
    for x in pieces:
        starts.append(at)
        at += len(x) + 1
    found: list[list[tuple[int, int]]] = []
    last, run = b"", []
    for i in suffix_array(text):
        if left[i] < length:
            continue
        string = text[i : i + length]
        if string != last:
            if len(run) > 1:
                found.append(run)
            last, run = string, []
        run.append((piece[i], i - starts[piece[i]]))
    if len(run) > 1:
        found.append(run)
    return found
