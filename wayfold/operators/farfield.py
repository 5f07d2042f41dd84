"""Sums of great-circle metres from places to groups of places, in less than the square of their number.

Places are put into a tree of boxes. What is near is computed pair by pair. A box far away, against its size and that of the
places that ask, acts through the same number of points whatever it holds: the distance is smooth there, so its interpolation
at ORDER x ORDER Chebyshev points is exact to about the last three of a double's digits. No place is left out.
"""

from __future__ import annotations

import numpy as np

EARTH_M = 6_371_000.0
#: Places of a leaf at most, interpolation points a side, and how many half widths of the wider box lie between two far boxes.
LEAF, ORDER, APART = 512, 12, 4.0
#: Boxes wider than this (radians) or nearer to a pole are opened; so are those far around the globe (chord).
WIDEST, POLAR, AROUND = 0.35, 1.4, 1.8

_ANGLES = (np.arange(ORDER) + 0.5) * np.pi / ORDER
_TERMS = np.arange(ORDER)
_AT_NODES = np.cos(np.outer(_ANGLES, _TERMS)) * np.where(_TERMS == 0, 1.0, 2.0) / ORDER


def arcs(q: np.ndarray, out: np.ndarray) -> None:
    """Arcsines of the square roots of q, up to 1; q is used up. Small ones by the series, exact to the last bits."""
    if q.size and q.max() > 1e-4:
        np.sqrt(np.minimum(q, 1.0, out=out), out=out)
        np.arcsin(out, out=out)
        return
    np.multiply(q, 35 / 1152, out=out)
    for c in (15 / 336, 3 / 40, 1 / 6, 1.0):
        out += c
        if c < 1:
            out *= q
    out *= np.sqrt(q, out=q)


def on_sphere(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])


def half_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the angle between each place of a and each of b (3 rows of coordinates)."""
    q = np.subtract(a[0][:, None], b[0])
    q *= q
    t = np.empty_like(q)
    for x, y in ((a[1], b[1]), (a[2], b[2])):
        np.subtract(x[:, None], y, out=t)
        t *= t
        q += t
    q *= 0.25
    arcs(q, t)
    return t


class Box:
    """A node of the tree: places `lo` to `hi` of the tree's order, a centre and half widths in radians."""

    def __init__(self, lo: int, hi: int, lat: np.ndarray, lng: np.ndarray):
        self.lo, self.hi, self.kids = lo, hi, ()
        a, b, c, d = lat.min(), lat.max(), lng.min(), lng.max()
        self.lat, self.lng, self.high, self.wide = (a + b) / 2, (c + d) / 2, (b - a) / 2, (d - c) / 2
        across = self.wide * (1.0 if a <= 0 <= b else max(np.cos(a), np.cos(b)))
        self.half, self.round = max(self.high, across), float(np.hypot(self.high, across))
        self.smooth = self.high <= WIDEST and self.wide <= WIDEST and max(abs(a), abs(b)) <= POLAR
        self.at = on_sphere(np.array([self.lat]), np.array([self.lng]))[:, 0].tolist()
        self.moments: np.ndarray | None = None

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.cos(_ANGLES)
        lat, lng = np.meshgrid(self.lat + self.high * x, self.lng + self.wide * x, indexing="ij")
        return lat.ravel(), lng.ravel()

    def basis(self, lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
        """The values of the interpolation points' polynomials at places, a row a place."""
        part = lambda x, mid, half: np.cos(np.outer(np.arccos(np.clip((x - mid) / max(half, 1e-15), -1.0, 1.0)), _TERMS)) @ _AT_NODES.T
        a, b = part(lat, self.lat, self.high), part(lng, self.lng, self.wide)
        return (a[:, :, None] * b[:, None, :]).reshape(len(lat), -1)

    def far(self, other: Box) -> bool:
        if not (self.smooth and other.smooth):
            return False
        chord = sum((x - y) ** 2 for x, y in zip(self.at, other.at, strict=True)) ** 0.5
        return chord < AROUND and chord - self.round - other.round >= APART * max(self.half, other.half)


class Tree:
    """Places (radians) in boxes; `group` numbers them from 0 to groups - 1."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, group: np.ndarray, groups: int):
        self.order, self.groups = np.arange(len(lat)), groups
        self.leaves: list[Box] = []
        self.root = Box(0, len(lat), lat, lng)
        todo = [self.root]
        while todo:
            box = todo.pop()
            own = self.order[box.lo : box.hi]
            if box.hi - box.lo <= LEAF or not box.half:
                self.order[box.lo : box.hi] = own[np.argsort(group[own], kind="stable")]
                self.leaves.append(box)
                continue
            key = lat[own] if box.half == box.high else lng[own]
            mid = len(own) // 2
            own = self.order[box.lo : box.hi] = own[np.argpartition(key, mid)]
            cut = box.lo + mid
            box.kids = tuple(Box(a, b, lat[x], lng[x]) for a, b, x in ((box.lo, cut, own[:mid]), (cut, box.hi, own[mid:])))
            todo += box.kids
        self.lat, self.lng, self.group = lat[self.order], lng[self.order], group[self.order]
        self.xyz = on_sphere(self.lat, self.lng)

    def moments(self, box: Box) -> np.ndarray:
        """What the box's places weigh at its interpolation points, a column a group."""
        if box.moments is None:
            if box.kids:
                box.moments = sum(box.basis(*kid.nodes()).T @ self.moments(kid) for kid in box.kids)
            else:
                first, of = self.starts(box)
                box.moments = np.zeros((ORDER * ORDER, self.groups))
                box.moments[:, of] = np.add.reduceat(box.basis(self.lat[box.lo : box.hi], self.lng[box.lo : box.hi]), first, axis=0).T
        return box.moments

    def starts(self, box: Box) -> tuple[np.ndarray, np.ndarray]:
        """Where a leaf's groups begin, and which these are."""
        g = self.group[box.lo : box.hi]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        return first, g[first]

    def met(self, asking: Box) -> tuple[list[Box], list[Box]]:
        """Boxes that are far from `asking`, and leaves that are near; together they hold each place once."""
        far, near, todo = [], [], [self.root]
        while todo:
            box = todo.pop()
            if box.far(asking):
                far.append(box)
            elif box.kids:
                todo += box.kids
            else:
                near.append(box)
        return far, near


def sums(lat: np.ndarray, lng: np.ndarray, to: Tree) -> np.ndarray:
    """Metres from each place (radians) to all of each group of `to`, a column a group."""
    out = np.zeros((len(lat), to.groups))
    if not len(lat):
        return out
    asking = Tree(lat, lng, np.zeros(len(lat), np.int64), 1)
    for leaf in asking.leaves:
        own = slice(leaf.lo, leaf.hi)
        far, near = to.met(leaf)
        total = np.zeros((leaf.hi - leaf.lo, to.groups))
        if far:
            few = leaf.hi - leaf.lo > ORDER * ORDER
            at = on_sphere(*leaf.nodes()) if few else asking.xyz[:, own]
            felt = np.zeros((at.shape[1], to.groups))
            for box in far:
                felt += half_angles(at, on_sphere(*box.nodes())) @ to.moments(box)
            total += leaf.basis(asking.lat[own], asking.lng[own]) @ felt if few else felt
        for box in near:
            first, of = to.starts(box)
            for lo in range(box.lo, box.hi, 1 << 16):  # a leaf of one place may be large
                hi = min(box.hi, lo + (1 << 16))
                if hi - lo < box.hi - box.lo:
                    g = to.group[lo:hi]
                    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    of = g[first]
                step = max(1, (1 << 16) // (hi - lo))
                for k in range(leaf.lo, leaf.hi, step):
                    part = slice(k, min(k + step, leaf.hi))
                    total[part.start - leaf.lo : part.stop - leaf.lo, of] += np.add.reduceat(half_angles(asking.xyz[:, part], to.xyz[:, lo:hi]), first, axis=1)
        out[asking.order[own]] = total
    return 2 * EARTH_M * out
