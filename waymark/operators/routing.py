"""Geometry, shortest paths and routes between candidates in plain Python: the one core that batch and streaming decoders share.

Network is made from plans.network.collected(), so it is small by that bound; searches are Dijkstra's with a heap that stop at
their target or bound, go on from there when more is asked, and are kept by source up to a number of entries.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from dataclasses import dataclass, replace
from typing import NamedTuple

RADIUS, LEGACY_RADIUS = 6378137.0, 6371000.0
_INT_MIN = -(2**31)
#: Entries of all searches that a network keeps, some 200 bytes each.
KEEP = 2_000_000


def rounded(x: float) -> float:
    """Units of the sixth decimal, halves away from zero, as SQL's round(x, 6) has them."""
    return math.copysign(math.floor(abs(x) * 1e6 + 0.5), x) if math.isfinite(x) else x


def haversine(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    """Step by step what the SQL of the decoders computes, so that near ties round alike; so are direction() and placed()."""
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * math.asin(min(1.0, math.sqrt(a))) * RADIUS


def direction(lng1: float, lat1: float, lng2: float, lat2: float) -> tuple[float, float]:
    p, q, d = math.radians(lat1), math.radians(lat2), math.radians(lng2) - math.radians(lng1)
    return math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d), math.sin(d) * math.cos(q)


def degrees(x: float, y: float) -> float:
    return (math.degrees(math.atan2(y, x)) + 360.0) % 360.0


def bearing(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    return degrees(*direction(lng1, lat1, lng2, lat2))


def angle_between(a: float, b: float) -> float:
    d = abs(a - b)
    return 360 - d if d > 180 else d


def legacy_distance(a: tuple[float, float], b: tuple[float, float]) -> float:
    """With degrees made radians twice."""
    (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    s = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * math.atan2(math.sqrt(s), math.sqrt(1 - s)) * LEGACY_RADIUS


@dataclass(frozen=True)
class Candidate:
    """A place on a segment."""

    seg: int
    leg: int
    lng: float
    lat: float
    err: float
    offset: float
    idx: int = -1
    skip: bool = False

    @property
    def order(self) -> tuple:
        """Which of equals comes first (errors of twins agree to rounding)."""
        return rounded(self.err), self.seg < 0, abs(self.seg)


class Route(NamedTuple):
    length: float
    segments: tuple[int, ...]
    points: tuple[tuple[float, float], ...]


def project(lng: float, lat: float, line: list[tuple[float, float]], compat: bool = False) -> tuple[float, int, float, float]:
    """(distance, leg, lng, lat) of the nearest place on a line. compat: the leg is searched by halving chords, which may
    miss the nearest leg of a bent line."""

    def on(a, b, leg):
        ab = haversine(*a, *b)
        along = haversine(*a, lng, lat) * math.cos(math.radians(bearing(*a, lng, lat) - bearing(*a, *b)))
        rate = along / ab if ab else 0.0
        x, y = b if rate > 1 else a if rate < 0 else (a[0] + rate * (b[0] - a[0]), a[1] + rate * (b[1] - a[1]))
        return (haversine(lng, lat, x, y), leg, x, y), rate

    if not compat:
        return min(on(line[i], line[i + 1], i)[0] for i in range(len(line) - 1))
    low, high = 0, len(line) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if on(line[low], line[mid], -1)[1] > 1 else (low, mid)
    return on(line[low], line[high], low)[0]


class Network:
    """Directed segments by id, and routes between nodes, candidates and points."""

    def __init__(self, segments: dict[int, tuple], keep: int = KEEP):
        self.segments, self.keep, self.entries = segments, keep, 0
        self.out: dict[int, list[tuple[int, float, int]]] = {}
        self.place: dict[int, tuple[float, float]] = {}
        for s, (a, b, _, length, line) in segments.items():
            self.out.setdefault(a, []).append((b, length, s))
            self.place.setdefault(a, line[0])
            self.place.setdefault(b, line[-1])
        for edges in self.out.values():
            edges.sort(key=lambda e: (e[1], e[2] < 0, abs(e[2])))
        self.legs = {s: [haversine(*p, *q) for p, q in zip(x[4], x[4][1:])] for s, x in segments.items()}
        #: Bearings of legs that were asked for.
        self.turns: dict[tuple[int, int], float] = {}
        #: Searches by source: lengths found, what is to be looked at, settled nodes, entries.
        self.found: OrderedDict[int, tuple[dict, list, dict, int]] = OrderedDict()

    def _search(self, src: int, bound: float, dst: int | None = None) -> dict[int, tuple[float, int, int]]:
        """node -> (length, node before, segment) of settled nodes: up to the bound, rounded up so that steps share searches,
        or with dst until it is settled. A search is kept and goes on where it stopped; `keep` bounds the entries of all."""
        bound = math.ceil(bound / 500) * 500.0 if bound < math.inf else bound
        if src in self.found:
            self.found.move_to_end(src)
            best, heap, done, had = self.found[src]
        else:
            best, heap, done, had = {src: (0.0, -1, 0)}, [(0.0, src)], {}, 0
        while heap and heap[0][0] <= bound and dst not in done:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done[u] = best[u]
            for v, w, s in self.out.get(u, ()):
                if v not in best or d + w < best[v][0]:
                    best[v] = (d + w, u, s)
                    heapq.heappush(heap, (d + w, v))
        self.found[src] = (best, heap, done, len(best) + len(heap))
        self.entries += len(best) + len(heap) - had
        while self.entries > self.keep and len(self.found) > 1:
            self.entries -= self.found.popitem(last=False)[1][3]
        return done

    def distance(self, src: int, dst: int, bound: float = math.inf) -> float | None:
        """Metres along edges; None: unreachable within the bound."""
        if src == dst:
            return 0.0
        found = self._search(src, bound, dst).get(dst)
        return found[0] if found and found[0] <= bound else None

    def node_path(self, src: int, dst: int, bound: float = math.inf) -> Route | None:
        if (length := self.distance(src, dst, bound)) is None:
            return None
        if src == dst:
            return Route(0.0, (), ())
        found, at, segs = self._search(src, bound, dst), dst, []
        while at != src:
            _, before, s = found[at]
            segs.append(s)
            at = before
        segs.reverse()
        points = [self.segments[segs[0]][4][0]] + [p for s in segs for p in self.segments[s][4][1:]]
        return Route(length, tuple(segs), tuple(points))

    def twin(self, seg: int) -> int | None:
        other = 0 if seg == _INT_MIN else _INT_MIN if seg == 0 else -seg
        return other if other in self.segments else None

    def reversed(self, c: Candidate) -> Candidate:
        """The same place on the segment's twin."""
        seg = self.twin(c.seg)
        line = self.segments[seg][4]
        leg = len(line) - 2 - c.leg
        return replace(c, seg=seg, leg=leg, offset=sum(self.legs[seg][:leg]) + haversine(*line[leg], c.lng, c.lat))

    def at(self, seg: int, lng: float, lat: float, idx: int = -1, compat: bool = False) -> Candidate:
        """The candidate of a point on a segment."""
        err, leg, x, y = project(lng, lat, self.segments[seg][4], compat)
        return Candidate(seg, leg, x, y, err, sum(self.legs[seg][:leg]) + haversine(*self.segments[seg][4][leg], x, y), idx)

    def placed(self, seg: int, leg: int, lng: float, lat: float, idx: int = -1) -> Candidate:
        """The candidate of a point on a leg."""
        a, b = self.segments[seg][4][leg : leg + 2]
        if (turn := self.turns.get((seg, leg))) is None:
            turn = self.turns[seg, leg] = bearing(*a, *b)
        whole = self.legs[seg][leg]
        rate = haversine(*a, lng, lat) * math.cos(math.radians(bearing(*a, lng, lat) - turn)) / whole if whole else 0.0
        x, y = b if rate > 1 else a if rate < 0 else (a[0] + rate * (b[0] - a[0]), a[1] + rate * (b[1] - a[1]))
        return Candidate(seg, leg, x, y, haversine(lng, lat, x, y), sum(self.legs[seg][:leg]) + haversine(*a, x, y), idx)

    def _between(self, a: Candidate, b: Candidate) -> list[tuple[float, float]]:
        """From a on to b along one segment."""
        return [(a.lng, a.lat), *self.segments[a.seg][4][a.leg + 1 : b.leg + 1], (b.lng, b.lat)]

    def _tail(self, a: Candidate) -> list[tuple[float, float]]:
        return [(a.lng, a.lat), *self.segments[a.seg][4][a.leg + 1 :]]

    def _head(self, b: Candidate) -> list[tuple[float, float]]:
        return [*self.segments[b.seg][4][: b.leg + 1], (b.lng, b.lat)]

    def length(self, a: Candidate, b: Candidate, bound: float = math.inf) -> float | None:
        """Metres from a to b: along a shared segment, back along a dual one, else through the nodes; None: unreachable."""
        if b.seg != a.seg and b.seg == self.twin(a.seg):
            b = self.reversed(b)
        if a.seg == b.seg:
            if a.offset <= b.offset:
                return _length(self._between(a, b))
            if self.segments[a.seg][2]:
                return _length(self._between(b, a))
        middle = self.distance(self.segments[a.seg][1], self.segments[b.seg][0], bound)
        return None if middle is None else _length(self._tail(a)) + middle + _length(self._head(b))

    def route(self, a: Candidate, b: Candidate, bound: float = math.inf) -> Route | None:
        """As length(), with segments and points."""
        if b.seg != a.seg and b.seg == self.twin(a.seg):
            b = self.reversed(b)
        if a.seg == b.seg and a.offset <= b.offset:
            return Route(_length(p := self._between(a, b)), (a.seg,), tuple(p))
        if a.seg == b.seg and self.segments[a.seg][2]:
            return Route(_length(p := self._between(b, a)), (self.twin(a.seg),), tuple(reversed(p)))
        middle = self.node_path(self.segments[a.seg][1], self.segments[b.seg][0], bound)
        if middle is None:
            return None
        tail, head = self._tail(a), self._head(b)
        return Route(_length(tail) + middle.length + _length(head), (a.seg, *middle.segments, b.seg), (*tail, *middle.points, *head))

    def nearest(self, lng: float, lat: float, radius: float) -> Candidate | None:
        """By a scan of all segments; the table form is operators.candidates.nearest."""
        found = min((self.at(s, lng, lat) for s in self.segments), key=lambda c: c.order, default=None)
        return found if found and found.err <= radius else None

    def point_route(self, a: tuple[float, float], b: tuple[float, float], radius: float = 300.0) -> Route:
        """From a point to a point: each snaps to its nearest segment, the way includes the legs to and from the points,
        and dual ends may be left and reached in both directions. LookupError if an end has no segment in reach."""
        if a == b:
            return Route(0.0, (), ())
        ends = [self.nearest(*p, radius) for p in (a, b)]
        if None in ends:
            raise LookupError("no segment within the search distance")
        return self.snapped_route(a, ends[0], b, ends[1]) or Route(math.inf, (), ())

    def snapped_route(self, a: tuple[float, float], ca: Candidate, b: tuple[float, float], cb: Candidate, bound: float = math.inf) -> Route | None:
        extra = haversine(*a, ca.lng, ca.lat) + haversine(*b, cb.lng, cb.lat)
        if self.twin(ca.seg) == cb.seg and ca.seg != cb.seg:
            cb = self.reversed(cb)
        if ca.seg == cb.seg and (ca.offset <= cb.offset or self.segments[ca.seg][2]):
            ways = [self.route(ca, cb, bound)]
        else:
            both = lambda c: [c, self.reversed(c)] if self.twin(c.seg) is not None else [c]
            ways = [self.route(x, y, bound) for x in both(ca) for y in both(cb)]
        best = min((w for w in ways if w), key=lambda w: w.length, default=None)
        return best and Route(best.length + extra, best.segments, (a, *best.points, b))


def _length(points) -> float:
    return sum(haversine(*p, *q) for p, q in zip(points, points[1:]))


def mean_direction(network: Network, route: Route) -> float:
    """Length-weighted mean bearing; a route without length has its only segment's."""
    legs = [haversine(*p, *q) for p, q in zip(route.points, route.points[1:])]
    total = sum(legs)
    if total == 0:
        line = network.segments[route.segments[0]][4]
        return bearing(*line[0], *line[-1])
    parts = [direction(*p, *q) for p, q in zip(route.points, route.points[1:])]
    return degrees(sum(x * d for (x, _), d in zip(parts, legs)) / total, sum(y * d for (_, y), d in zip(parts, legs)) / total)
