"""Canonical forms of small labelled graphs by colour refinement and individualisation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

Labels = dict[int, str]
Links = dict[tuple[int, int], str]


def _neighbours(nodes: set[int], links: Links) -> dict[int, dict[int, str]]:
    near: dict[int, dict[int, str]] = {n: {} for n in nodes}
    for (u, v), x in links.items():
        near[u][v] = near[v][u] = x
    return near


def _ranked(keys: dict[int, tuple]) -> dict[int, int]:
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return {n: order[k] for n, k in keys.items()}


def refine_colours(colours: dict[int, int], near: dict[int, dict[int, str]]) -> dict[int, int]:
    """Split colours by the bonds and colours around until nothing changes."""
    while True:
        new = _ranked({n: (c, tuple(sorted((x, colours[m]) for m, x in near[n].items()))) for n, c in colours.items()})
        if len(set(new.values())) == len(set(colours.values())):
            return new
        colours = new


@dataclass
class Canonical:
    """The least text of a graph, the node order that writes it, automorphisms that the search met (node to
    node; they generate all that matter for its pruning) and whether the search was carried through."""

    text: str
    order: list[int]
    automorphisms: list[dict[int, int]] = field(default_factory=list)
    complete: bool = True

    def relabelled(self, labels: Labels, links: Links) -> tuple[Labels, Links]:
        """The graph with its nodes numbered from 1 in canonical order."""
        at = {n: i for i, n in enumerate(self.order, 1)}
        return {at[n]: labels[n] for n in self.order}, {(min(at[u], at[v]), max(at[u], at[v])): x for (u, v), x in sorted(links.items())}


def _joined(items: Iterable[int], maps: list[dict[int, int]]) -> dict[int, int]:
    """The smallest item that the maps lead to from each item, back and forth."""
    root = {n: n for n in items}

    def find(n: int) -> int:
        while root[n] != n:
            n = root[n]
        return n

    for m in maps:
        for a, b in m.items():
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in root}


def canonical_search(labels: Labels, links: Links, max_depth: int | None = None) -> Canonical:
    """The canonical form of a graph, equal for isomorphic graphs only.

    The first colour shared by several nodes is split at each of them, and the least text wins. Two orders with
    the same text give an automorphism; nodes that the automorphisms of the nodes chosen so far lead to each other
    are tried once, and so are nodes that swap without changing anything (same label, same bonds to the same
    others). With ``max_depth`` the search stops that deep and breaks what is left by node number."""
    near = _neighbours(set(labels), links)
    best = Canonical("||", [])
    found = False

    def text(order: list[int]) -> str:
        at = {n: i for i, n in enumerate(order)}
        bonds = sorted((min(at[u], at[v]), max(at[u], at[v]), x) for (u, v), x in links.items())
        return ";".join(labels[n] for n in order) + "||" + ";".join(f"{i},{j},{x}" for i, j, x in bonds)

    def leaf(order: list[int]) -> None:
        nonlocal found
        new = text(order)
        if found and new == best.text:
            moved = {a: b for a, b in zip(best.order, order) if a != b}
            if moved:
                best.automorphisms.append(moved)
        elif not found or new < best.text:
            best.text, best.order, found = new, order, True

    def search(colours: dict[int, int], chosen: list[int]) -> None:
        colours = refine_colours(colours, near)
        cells: dict[int, list[int]] = {}
        for n, c in colours.items():
            cells.setdefault(c, []).append(n)
        shared = [c for c in sorted(cells) if len(cells[c]) > 1]
        if not shared or len(chosen) == max_depth:
            best.complete = best.complete and not shared
            leaf(sorted(labels, key=lambda n: (colours[n], n)))
            return
        twins: set[tuple] = set()
        tried: list[int] = []
        for n in sorted(cells[shared[0]]):
            twin = tuple(sorted((m, x) for m, x in near[n].items() if m != n))
            orbit = _joined(labels, [a for a in best.automorphisms if not any(c in a for c in chosen)])
            if twin in twins or any(orbit[n] == orbit[t] for t in tried):
                continue
            twins.add(twin)
            tried.append(n)
            search({m: 2 * c + (1 if c == shared[0] and m != n else 0) for m, c in colours.items()}, [*chosen, n])

    search(_ranked({n: (x,) for n, x in labels.items()}), [])
    return best


def canonical_form(labels: Labels, links: Links, max_depth: int | None = None) -> tuple[str, list[int]]:
    """The text of ``canonical_search`` and the node order that writes it."""
    form = canonical_search(labels, links, max_depth)
    return form.text, form.order


def components(labels: Labels, links: Links) -> list[set[int]]:
    near, left, out = _neighbours(set(labels), links), set(labels), []
    while left:
        stack, seen = [left.pop()], set()
        while stack:
            n = stack.pop()
            seen.add(n)
            stack += near[n].keys() - seen
        left -= seen
        out.append(seen)
    return out


def whole_form(labels: Labels, links: Links) -> str:
    """Canonical text of a graph by its components, so that equal molecules side by side cost nothing."""
    forms = []
    for part in components(labels, links):
        inner = {e: x for e, x in links.items() if e[0] in part}
        forms.append(canonical_form({n: labels[n] for n in part}, inner)[0])
    return " + ".join(sorted(forms))


def orbits(labels: Labels, links: Links) -> list[list[int]]:
    """Classes of nodes that an automorphism maps to each other: equal forms once marked."""
    groups: dict[str, list[int]] = {}
    for n in sorted(labels):
        marked = {m: x + ("*" if m == n else "") for m, x in labels.items()}
        groups.setdefault(canonical_form(marked, links)[0], []).append(n)
    return sorted(groups.values())


def ego_forms(labels: Labels, links: Links, radius: int, memory: dict | None = None) -> Iterator[str]:
    """Canonical forms of the ego subgraph of each node for each k from 0 to ``radius``."""
    memory = {} if memory is None else memory
    near = _neighbours(set(labels), links)
    for center in labels:
        ego, ring = {center}, {center}
        for k in range(radius + 1):
            if k:
                ring = {m for n in ring for m in near[n]} - ego
                ego |= ring
            inner = {e: x for e, x in links.items() if e[0] in ego and e[1] in ego}
            # Whole contents as the key: no graph meets the result of another one.
            key = tuple(sorted((n, labels[n]) for n in ego)), tuple(sorted(inner.items()))
            if key not in memory:
                memory[key] = canonical_form({n: labels[n] for n in ego}, inner)[0]
            yield memory[key]
