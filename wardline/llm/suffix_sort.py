"""Linear suffix sorting by grouping: suffixes that begin with the same Lyndon word form a group.

The first phase handles the groups from the greatest down. The suffixes of a group point to the nearest earlier
suffix of a lower group; those pointed to are followed by the group's word and so move to new groups just above
their own. After it a suffix's group is its longest Lyndon prefix. The second phase runs over the order as it
grows: what lies before a placed suffix, along the pointers, takes the next place in its group. Nothing is
renamed and sorted again.
"""

from __future__ import annotations


def suffix_order(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order; an empty text gives none."""
    n = len(text)
    if not n:
        return []
    # groups by first symbol, linked downwards and upwards
    members: list[list[int]] = []
    number: dict[int, int] = {}
    for c in sorted(set(text)):
        number[c] = len(members)
        members.append([])
    group = [number[c] for c in text]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = [False] * n
    before = [-1] * n  # nearest earlier suffix of a lower group
    sizes = [0] * len(members)
    g = len(members) - 1
    lowest = 0
    while g >= 0:
        own = members[g]
        if len(own) == 1:  # the common case, by itself
            i = own[0]
            if group[i] == g:
                sizes[g] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = before[p]
                before[i] = p
                done[i] = True
                if p >= 0:
                    new, old = len(members), group[p]
                    members.append([p])
                    sizes.append(0)
                    below.append(old)
                    up = above[old]
                    above.append(up)
                    below[up] = new
                    above[old] = new
                    group[p] = new
            g = below[g]
            continue
        own = [i for i in own if group[i] == g]
        sizes[g] = len(own)
        own.sort()
        followed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and (done[p] or group[p] == g):
                p = before[p]
            before[i] = p
            if p >= 0:
                followed[p] = followed.get(p, 0) + 1
        for i in own:
            done[i] = True
        # the more often the group's word follows, the higher
        for times in sorted(set(followed.values())):
            made: dict[int, int] = {}
            for p in [p for p, k in followed.items() if k >= times]:
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    sizes.append(0)
                    below.append(old)
                    above.append(above[old])
                    below[above[old]] = new
                    above[old] = new
                group[p] = new
                members[new].append(p)
        g = below[g]
    # second phase
    start, at, g = [0] * len(members), 0, lowest
    while g >= 0:
        start[g] = at
        at += sizes[g]
        g = above[g]
    order: list[int] = [0] * n
    placed = [False] * n
    for k in range(-1, n):
        i = (n if k < 0 else order[k]) - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[start[g]] = i
            start[g] += 1
            placed[i] = True
            i = before[i]
    return order
