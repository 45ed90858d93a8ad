"""The three alternative matchers as plain Python over one trajectory: adaptive (AMM), adaptive online (AOMM) and
dynamically weighted (DW-RMM). Skipped points carry a candidate with skip=True and index -1, which evaluation ignores.

State belongs to one trajectory. Where a formula would divide by zero, EPS stands in for zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from waymark.operators.decoder import NEVER, Match, Point, Viterbi, Weights
from waymark.operators.routing import Candidate, Network, angle_between, bearing, haversine, legacy_distance

EPS = 1e-9
SKIP = Candidate(0, 0, 0.0, 0.0, 0.0, 0.0, -1, True)


# ---------------------------------------------------------------- adaptive


def position_score(distance: float, sigma: float = 10.0) -> float:
    return math.sqrt(2.0) * math.exp(-((distance / sigma) ** 2) / 2)


def velocity_score(v: float, v0: float, spread: float = 5.0) -> float:
    top = v0 + spread
    c = 3 * (v0 + top) ** 2 / (8 * v0 + 4 * top)
    if v < v0:
        return 2 * c / (v0 + top)
    return 2 * c * (top - v) / (top**2 - v0**2) if v < top else 0.0


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with parts >= 0 that sum to 1."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.nonzero(u > over)[0][-1]], 0.0)


def weigh(scores: np.ndarray, punish1: float = 1.0, punish2: float = 2.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Minimises l1 |w|^2 + l2 |p|^2 - w' S p over two simplices (features' weights, candidates' probabilities), by exact
    minimisation over one and the other in turn; returns w, p and w' S p. scores S: a row for each feature."""
    m, n = scores.shape
    l1, l2 = 10.0 * punish1, math.exp(-punish2 * n)
    w, p = np.full(m, 1 / m), np.full(n, 1 / n)
    for _ in range(rounds):
        q = simplex(scores.T @ w / (2 * l2))
        v = simplex(scores @ q / (2 * l1))
        still = np.abs(q - p).max() + np.abs(v - w).max() < 1e-12
        w, p = v, q
        if still:
            break
    return w, p, float(w @ scores @ p)


@dataclass
class _Place:
    cand: Candidate
    least: float = math.inf
    before: "_Place | None" = None
    chance: float = 0.0
    position: float = 0.0
    velocity: float = 0.0


@dataclass
class _Step:
    point: Point
    places: list[_Place]
    before: "_Step | None" = None
    least: float = math.inf


def adaptive(network: Network, points: list[Point], compat: bool = False, cut: float = 0.6) -> tuple[list[Match], float]:
    """Matched rows and the matched length. compat: velocities in metres per millisecond over the doubly converted
    distance, and the last candidate with a finite length begins the way back instead of the shortest."""
    metres = (lambda a, b: legacy_distance((a.lng, a.lat), (b.lng, b.lat))) if compat else (lambda a, b: haversine(a.lng, a.lat, b.lng, b.lat))
    unit = 1.0 if compat else 1000.0
    speeds, kept, dropped, steps = [5.0] * 5, None, 0, []
    for p in points:
        step = _Step(p, [_Place(c) for c in p.candidates], kept)
        steps.append(step)
        v0 = 5.0
        if kept is not None:
            millis = max(p.millis - kept.point.millis, 1)
            speeds = [*speeds[1:], metres(kept.point, p) / millis * unit]
            v0 = max(sum(speeds) / 5, EPS)
        some = False
        for x in step.places:
            x.position = position_score(metres(x.cand, p))
            if kept is None:
                x.velocity, x.least = velocity_score(v0, v0), 0.0
            else:
                for q in kept.places:
                    way = network.length(q.cand, x.cand)
                    if way is None:
                        continue
                    if way + q.least < x.least:
                        x.least, x.before = way + q.least, q
                    x.velocity += velocity_score(way / millis * unit, v0) * q.chance
            if x.velocity > 0:
                some = True
                step.least = min(step.least, x.least)
        total = 0.0
        if some:
            _, chances, total = weigh(np.array([[x.position for x in step.places], [x.velocity for x in step.places]]))
            for x, c in zip(step.places, chances):
                x.chance = float(c)
        if some and total > cut:
            kept = step
            if dropped > 2:
                _relink(network, step)
            dropped = 0
        else:
            dropped += 1
    last = None
    for step in reversed(steps[1:]):
        finite = [x for x in step.places if x.least < math.inf]
        if finite:
            last = finite[-1] if compat else min(finite, key=lambda x: (x.least, x.cand.order))
            break
    length, found = (last.least if last else 0.0), {}
    while last is not None:
        found[last.cand.idx] = last.cand
        last = last.before
    return [Match(p.idx, found.get(p.idx)) for p in points], length


def _relink(network: Network, step: _Step) -> None:
    """After a gap: earlier steps are tried as predecessors as long as the shortest length falls."""
    earlier = step.before.before if step.before else None
    while earlier is not None:
        least = step.least
        for x in step.places:
            for q in earlier.places:
                way = network.length(q.cand, x.cand)
                if way is not None and way + q.least < least:
                    least, x.before, step.before = way + q.least, q, earlier  # x keeps its own least length
        if least >= step.least:
            break
        step.least, earlier = least, earlier.before


# ---------------------------------------------------------------- adaptive online


def _inverse_logs(values: list[float]) -> list[float]:
    inverse = [1 / max(v, EPS) for v in values]
    mean = sum(inverse) / max(len(inverse), 1)
    return [math.log(x / mean) for x in inverse]


def adaptive_online(network: Network, points: list[Point], compat: bool = False, still: float = 3.0, far: float = 100.0, most: int = 4) -> list[Match]:
    """Points without candidates or within `still` metres of the last kept point are skipped; a match whose way from the
    last is over `far` recalls up to `most` earlier steps, whose outputs become skips. Each kept step has its decoder. If no
    recalled step is near enough, the match stays as it was and all kept steps go; a break begins anew and keeps them.
    compat: a break emits the last match once more."""
    out: list[Match] = []
    kept: list[tuple[Point, Viterbi, Candidate, int]] = []  # point, decoder after it, match, row
    weights = Weights(dynamic=False)
    for p in points:
        row = len(out)
        if not p.candidates or kept and haversine(kept[-1][0].lng, kept[-1][0].lat, p.lng, p.lat) < still:
            out.append(Match(p.idx, SKIP))
            continue
        first, chosen, stale = None, None, kept[-1][2] if kept else None
        for recalled, (q, decoder, match, _) in enumerate(reversed(kept)):
            v = Viterbi(dict(decoder.message), dict(decoder.states), decoder.time)
            if not _forward(v, p, _steps(network, q, p), weights):
                break
            best = v.best()
            first = first or (v, best, 0)
            way = network.snapped_route((match.lng, match.lat), match, (best.lng, best.lat), best, far + 1)
            if way is not None and way.length <= far:
                chosen = (v, best, recalled)
                break
        if first is not None and chosen is None:
            kept = []
        v, best, recalled = chosen or first or (None, None, 0)
        if v is None:
            v = Viterbi()
            v.message = dict(zip(p.candidates, _inverse_logs([c.err for c in p.candidates])))
            v.states = {}
            best = v.best()
        for _ in range(recalled):
            out[kept.pop()[3]].cand = SKIP
        out.append(Match(p.idx, stale if compat and first is None and stale is not None else best))
        kept = [*kept, (p, v, best, row)][-most:]
    return out


def _steps(network: Network, q: Point, p: Point) -> dict[tuple[Candidate, Candidate], float]:
    linear, found = haversine(q.lng, q.lat, p.lng, p.lat), {}
    for a in q.candidates:
        ways = [(b, network.length(a, b)) for b in p.candidates]
        ways = [(b, w) for b, w in ways if w is not None]
        for (b, _), x in zip(ways, _inverse_logs([abs(linear - w) for _, w in ways])):
            found[a, b] = x
    return found


def _forward(v: Viterbi, p: Point, steps: dict, weights: Weights) -> bool:
    """A step with the emissions of this matcher, which are relative to the point's candidates."""
    message = {}
    for c, e in zip(p.candidates, _inverse_logs([c.err for c in p.candidates])):
        best = max((m + weights.transition * steps.get((q, c), NEVER) for q, m in v.message.items()), default=NEVER)
        message[c] = best + weights.emission * e
    if all(m == NEVER for m in message.values()):
        return False
    v.message = message
    return True


# ---------------------------------------------------------------- dynamically weighted


@dataclass
class Running:
    """Counts, spread of errors, and means of displacement and of |straight - route|, both capped at 50."""

    count: int = 0
    sigma: float = 10.0
    mean: float = 0.0
    m2: float = 0.0
    sums: list[float] = field(default_factory=lambda: [0.0, 0.0])
    means: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def add(self, err: float, moved: float | None, differs: float) -> None:
        self.count += 1
        if self.count == 1:
            return
        d = err - self.mean
        self.mean += d / self.count
        self.m2 += d * (err - self.mean)
        self.sigma = math.sqrt(self.m2 / (self.count - 1))
        if moved is not None:
            for k, v in enumerate((moved, differs)):
                self.sums[k] += min(v, 50.0)
                self.means[k] = self.sums[k] / (self.count - 1)

    def distance_score(self, d: float) -> float:
        s = max(self.sigma, EPS)
        return math.exp(-(d**2) / (2 * s**2)) / (math.sqrt(2 * math.pi) * s)

    def direction_weight(self, angle: float) -> float:
        return 1.0 if self.count < 20 or angle > self.means[0] else angle / max(self.means[0], EPS)

    def connectivity_weight(self, d: float) -> float:
        return 1.0 if self.count < 20 or d <= self.means[1] else connectivity_score(d)


def direction_score(angle: float) -> float:
    return (1 + math.cos(math.radians(angle))) / 2


def connectivity_score(d: float) -> float:
    return math.exp(-0.4 * d) if d < math.inf else 0.0


def distance_weight(hdop: float, low: float, high: float) -> float:
    """Unused by the matcher: by the dilution of precision; 1 up to low, then its place between low and high, 0 from high on."""
    return 1.0 if hdop <= low else (hdop - low) / (high - low) if hdop < high else 0.0


def heading_score(road_angle: float, turned: float, step: int) -> float:
    """Unused by the matcher: in step 1 by the angle between heading and road, in step 2 by that between two headings."""
    return (1 + (step == 1) * math.cos(math.radians(road_angle)) + (step == 2) * math.cos(math.radians(turned))) / 2


def heading_weight(speed: float, before: float, low: float, high: float) -> float:
    """Unused by the matcher: 0 if either speed is under low, 1 if both are over high, else their mean's place between."""
    return 0.0 if min(speed, before) < low else 1.0 if min(speed, before) > high else (speed + before - 2 * low) / (2 * (high - low))


def confidence(best: tuple, second: tuple) -> float:
    """Weighted relative gaps of distance, direction and connectivity scores. Tuples: three scores, then three weights."""
    parts = [w * abs(a - b) / (a + b) if a + b else 0.0 for a, b, w in zip(best[:3], second[:3], best[3:])]
    return sum(parts) / max(sum(best[3:]), EPS)


def _two_best(scored: list[tuple[Candidate, tuple]]) -> tuple[tuple | None, tuple | None]:
    """The best and the best of those with another total; only totals above zero count."""
    order = sorted((x for x in scored if sum(x[1][:3]) > 0), key=lambda x: (-sum(x[1][:3]), x[0].order))
    if not order:
        return None, None
    top = sum(order[0][1][:3])
    return order[0], next((x for x in order if sum(x[1][:3]) != top), None)


def dynamically_weighted(network: Network, points: list[Point], least: float = 0.1) -> list[Match]:
    stats, before, match = Running(), None, None
    out = [Match(p.idx, SKIP) for p in points]
    begun = False

    def way(a: Candidate, b: Candidate) -> float:
        r = network.snapped_route((a.lng, a.lat), a, (b.lng, b.lat), b)
        return r.length if r else math.inf

    for k in range(1, len(points)):
        q, p = points[k - 1], points[k]
        if not begun:
            # Waits for a pair of points whose best match stands out; displacement and way back are what it weighs.
            best_pair, score = None, 0.0
            linear = haversine(q.lng, q.lat, p.lng, p.lat)
            for a in q.candidates:
                scored = []
                for b in p.candidates:
                    turned = angle_between(bearing(p.lng, p.lat, q.lng, q.lat), bearing(b.lng, b.lat, a.lng, a.lat))
                    gap = abs(linear - way(b, a))
                    wd, wc = stats.direction_weight(turned), stats.connectivity_weight(gap)
                    scored.append((b, (stats.distance_score(linear), wd * direction_score(turned), wc * connectivity_score(gap), 1.0, wd, wc)))
                best, second = _two_best(scored)
                if best and second and confidence(best[1], second[1]) >= least and sum(best[1][:3]) > score:
                    best_pair, score = (a, best[0]), sum(best[1][:3])
            if best_pair:
                out[k - 1].cand, out[k].cand = best_pair
                begun, before, match = True, p, best_pair[1]
            continue
        if not p.candidates:
            before = match = None
            continue
        scored, gaps = [], {}
        for c in p.candidates:
            distance, turned, linked, wd, wc, gap = stats.distance_score(c.err), 0.0, 0.0, 1.0, 1.0, 0.0
            if before is not None:
                angle = angle_between(bearing(p.lng, p.lat, before.lng, before.lat), bearing(c.lng, c.lat, match.lng, match.lat))
                if angle == 0:
                    distance = 0.0  # no angle stands for no movement, which says nothing of the distance
                else:
                    wd = stats.direction_weight(angle)
                    turned = wd * direction_score(angle)
                gap = abs(haversine(p.lng, p.lat, before.lng, before.lat) - way(match, c))
                wc = stats.connectivity_weight(gap)
                linked = wc * connectivity_score(gap)
            gaps[c] = gap
            scored.append((c, (distance, turned, linked, 1.0, wd, wc)))
        best, second = _two_best(scored)
        chosen = best[0] if best else None
        err, gap = (chosen.err, gaps[chosen]) if chosen else (0.0, 0.0)
        if best and second and confidence(best[1], second[1]) < least and match is not None:
            chosen = network.at(match.seg, p.lng, p.lat)  # index -1: evaluation passes it over
        stats.add(err, haversine(p.lng, p.lat, before.lng, before.lat) if before is not None else None, gap)
        out[k].cand = chosen
        before, match = (p, chosen) if chosen is not None else (None, None)
    return out
