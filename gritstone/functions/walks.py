"""Walks over one small graph: what a root reaches, and immediate dominators."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


def following(edges: Iterable[tuple[Hashable, Hashable]]) -> dict[Hashable, list[Hashable]]:
    out: dict[Hashable, list[Hashable]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


def in_postorder(after: dict[Hashable, list[Hashable]], root: Hashable) -> list[Hashable]:
    """What ``root`` reaches, each node behind those that a depth-first walk finds from it; the root comes last."""
    seen, out = {root}, []
    stack = [(root, iter(after.get(root, ())))]
    while stack:
        node, rest = stack[-1]
        further = next((x for x in rest if x not in seen), None)
        if further is None:
            out.append(node)
            stack.pop()
        else:
            seen.add(further)
            stack.append((further, iter(after.get(further, ()))))
    return out


def led_to(ends: list[int], at: list[int], root: int) -> list[tuple[int, int]]:
    """All edges of what ``root`` reaches, itself included; node k leads to ``ends`` from ``at[k]`` to ``at[k + 1]``."""
    seen, stack, out = {root}, [root], []
    while stack:
        a = stack.pop()
        for b in ends[at[a] : at[a + 1]]:
            out.append((a, b))
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return out


def dominator_tree(edges: list[tuple[Hashable, Hashable]], root: Hashable) -> dict[Hashable, Hashable | None]:
    """The immediate dominator of each node that ``root`` reaches: the meeting of its predecessors' ways up, until none moves."""
    order = in_postorder(following(edges), root)
    number = {node: k for k, node in enumerate(order)}
    before: list[list[int]] = [[] for _ in order]
    for a, b in edges:
        if a in number and b in number:
            before[number[b]].append(number[a])
    top = len(order) - 1
    up = [-1] * top + [top]
    moved = True
    while moved:
        moved = False
        for k in range(top - 1, -1, -1):
            meet = -1
            for p in before[k]:
                if up[p] < 0:
                    continue
                if meet < 0:
                    meet = p
                while meet != p:
                    if meet < p:
                        meet = up[meet]
                    else:
                        p = up[p]
            if up[k] != meet:
                up[k], moved = meet, True
    return {node: order[up[k]] if k < top else None for k, node in enumerate(order)}
