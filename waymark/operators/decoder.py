"""The Viterbi decoders: batch, greedy and online with correction. One step function serves all three.

Scores are logarithms. Where the original engine's result hung on hash order or on a defect, the defined results here are:
equal scores (to six decimals: twins of a segment differ by rounding alone) go to the candidate with the smaller error, then the positive id, then the smaller one; a break emits the
re-initialised best match of the point at which it happened; a correction skips just the states that are too old.
compat=True restores the stale row at a break and the stalled correction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from waymark.operators.routing import Candidate, Network, angle_between, bearing, haversine, mean_direction, rounded

SIGMA, BETA, CUT, ALPHA = 50.0, 5.0, 500.0, 5.0
JITTER_SPEED, JITTER_METRES = 34.0, 20.0
NEVER = -math.inf


def emission(err: float, sigma: float = SIGMA) -> float:
    return math.log(1 / (math.sqrt(2 * math.pi) * sigma)) - 0.5 * (err / sigma) ** 2


def transition(route: float | None, linear: float, beta: float = BETA) -> float:
    if route is None or abs(linear - route) > CUT:
        return NEVER
    return math.log(1 / beta) - abs(linear - route) / beta


def turn(angle: float, alpha: float = ALPHA) -> float:
    return emission(angle, alpha)


@dataclass
class Weights:
    """Weights of transition and emission; dynamic ones follow the sizes of the step's log probabilities."""

    transition: float = 0.5
    emission: float = 0.5
    dynamic: bool = True
    rate: float = 0.01

    def update(self, emissions: float, transitions: float) -> None:
        if not self.dynamic:
            return
        t, e = abs(transitions), abs(emissions)
        self.transition += self.rate * (0.0 if t > 30 else t)
        self.emission += self.rate * e
        total = self.transition + self.emission
        self.transition, self.emission = (self.transition / total, self.emission / total) if total else (0.5, 0.5)


@dataclass
class Point:
    """An observation with its candidates."""

    idx: int
    millis: int
    lng: float
    lat: float
    candidates: list[Candidate] = field(default_factory=list)


@dataclass
class Node:
    """A state of the decoder and where it came from."""

    cand: Candidate
    point: int
    before: "Node | None" = None
    time: int = 0


@dataclass
class Viterbi:
    """The filtering message and the last state of each candidate."""

    message: dict[Candidate, float] = field(default_factory=dict)
    states: dict[Candidate, Node] = field(default_factory=dict)
    time: int = 0

    def start(self, p: Point, sigma: float = SIGMA) -> None:
        self.message = {c: emission(c.err, sigma) for c in p.candidates}
        self.states = {c: Node(c, p.idx) for c in p.candidates}
        self.time = 0

    def best(self) -> Candidate | None:
        return min(self.message, key=lambda c: (-rounded(self.message[c]) if self.message[c] > NEVER else math.inf, c.order), default=None)

    def step(self, p: Point, steps: dict[tuple[Candidate, Candidate], float], weights: Weights, sigma: float = SIGMA) -> bool:
        """One observation on; False if no candidate is reachable (nothing changes then but the weights)."""
        before = sorted((q for q in self.message if self.message[q] > NEVER), key=lambda q: q.order)
        message, states, sums = {}, {}, [0.0, 0.0]
        for c in p.candidates:
            value, first, way, most = NEVER, None, NEVER, NEVER
            for q in before:
                t = steps.get((q, c), NEVER)
                if t > NEVER and (units := rounded(score := self.message[q] + weights.transition * t)) > most:
                    value, first, way, most = score, q, t, units
            e = emission(c.err, sigma)
            message[c] = value + weights.emission * e if first is not None else NEVER
            if first is not None:
                states[c] = Node(c, p.idx, self.states[first], self.time + 1)
                sums[0] += e
                sums[1] += way
        weights.update(*sums)
        if not states:
            return False
        self.message, self.states, self.time = message, states, self.time + 1
        return True

    def path(self) -> list[Node]:
        """The most likely states so far."""
        best = self.best()
        found, node = [], self.states.get(best) if best is not None else None
        while node is not None:
            found.append(node)
            node = node.before
        return found[::-1]


def jittered(network: Network, before: Point, p: Point, viterbi: Viterbi, shortcut: bool = True) -> Point:
    """The point, with the last best match among its candidates where one of them would mean a jump back on its segment."""
    last = viterbi.best()
    seconds = (p.millis - before.millis) / 1000
    for c in p.candidates:
        if c.seg == last.seg and c.offset < last.offset:
            way = network.length(last, c)
            fast = way is None or (way > 0 if seconds <= 0 else way / seconds > JITTER_SPEED)
            if fast and haversine(last.lng, last.lat, c.lng, c.lat) < JITTER_METRES:
                # Carried on under the point's own index; if it is there already nothing is added.
                carried = replace(last, idx=p.idx)
                return p if carried in p.candidates else replace(p, candidates=[*p.candidates, carried])
    return p


def transitions(network: Network, before: Point, p: Point, carried: bool, turning: bool = False) -> dict[tuple[Candidate, Candidate], float]:
    """Log probabilities of all pairs. carried: the same place in both steps counts as no way at all. turning: with the
    factor of the angle between the observed and the route's direction."""
    linear = haversine(before.lng, before.lat, p.lng, p.lat)
    # Beyond this a transition is impossible and a jump back is too fast, whatever the exact length.
    bound = max(linear + CUT, JITTER_SPEED * (p.millis - before.millis) / 1000) + 1.0
    found = {}
    for a in before.candidates:
        for b in p.candidates:
            if carried and (a.seg, a.leg, a.lng, a.lat) == (b.seg, b.leg, b.lng, b.lat) and a.err == b.err:
                found[a, b] = transition(0.0, 0.0)
                continue
            t = transition(network.length(a, b, bound), linear)
            if turning and t > NEVER:
                route = network.route(a, b, bound)
                t += turn(angle_between(bearing(before.lng, before.lat, p.lng, p.lat), mean_direction(network, route)))
            found[a, b] = t
    return found


class Bearings:
    """Eight moving points; stable() if the last turns are small."""

    def __init__(self, window: int = 8):
        self.window, self.points, self.turns, self.last = window, [], [], None

    def add(self, lng: float, lat: float) -> None:
        if self.points and haversine(*self.points[-1], lng, lat) == 0:
            return
        if self.points:
            b = bearing(*self.points[-1], lng, lat)
            if self.last is not None:
                self.turns = [*self.turns, angle_between(self.last, b)][-(self.window - 2) :]
            self.last = b
        self.points = [*self.points, (lng, lat)][-self.window :]

    def stable(self) -> bool:
        return bool(self.turns) and sum(self.turns) / 180 <= 0.2


@dataclass
class Match:
    """What a decoder says of a point."""

    idx: int
    cand: Candidate | None
    revision: int = 0
    converged: bool = False


class Decoder:
    """Feeds points in order. mode: batch (flushes whole paths), greedy, or online (greedy, revised on convergence)."""

    def __init__(self, network: Network, mode: str = "batch", weights: Weights | None = None, window: int = 10, compat: bool = False, turning: bool = False, finalize: bool = False):
        self.network, self.mode, self.weights, self.window = network, mode, weights or Weights(), window
        self.compat, self.turning, self.finalize = compat, turning, finalize
        self.viterbi, self.before, self.out = Viterbi(), None, []
        self.bearings = Bearings()
        self.begin, self.root = 0, None
        self.delay_points, self.delay = 0, 0

    def _flush(self) -> None:
        self.out += [Match(n.point, n.cand) for n in self.viterbi.path()]

    def feed(self, p: Point) -> list[Match]:
        """Takes the next point; returns the rows that are new or revised (batch: those that are final)."""
        had = len(self.out)
        self.bearings.add(p.lng, p.lat)
        if not p.candidates:
            if self.mode == "batch":
                self._flush()
            self.out.append(Match(p.idx, None))
            self.viterbi, self.before, self.root, self.begin = Viterbi(), None, None, len(self.out)
            return self.out[had:]
        if self.before is None:
            self.viterbi.start(p)
            self.begin, self.root = len(self.out), None
            ok = True
        else:
            p = jittered(self.network, self.before, p, self.viterbi)
            speed = haversine(self.before.lng, self.before.lat, p.lng, p.lat) / max((p.millis - self.before.millis) / 1000, 1e-9)
            turning = self.turning and self.bearings.stable() and speed >= 2
            ok = self.viterbi.step(p, transitions(self.network, self.before, p, self.mode == "batch", turning), self.weights)
        revised: list[Match] = []
        if not ok:
            if self.mode == "batch":
                self._flush()
            elif self.compat:
                node = self.viterbi.path()[-1]
                self.out.append(Match(p.idx, node.cand))
            self.viterbi = Viterbi()
            self.viterbi.start(p)
            self.begin, self.root = len(self.out) - (1 if self.compat and self.mode != "batch" else 0), None
        elif self.mode == "online" and self.viterbi.time:
            revised = self._converge()
        if self.mode != "batch" and (ok or not self.compat):
            self.out.append(Match(p.idx, self.viterbi.best()))
        self.before = p
        new = self.out[had:]
        return [*(m for m in revised if m not in new), *new]

    @property
    def depth(self) -> int:
        """Rows back that a correction may reach."""
        return 2 * self.window + 2 if self.mode == "online" else 1

    def forget(self) -> None:
        """Drops rows and states beyond depth, for streams: later output is the same, as corrections don't reach them."""
        level = list(self.viterbi.states.values())
        for _ in range(self.depth):
            level = list({id(n.before): n.before for n in level if n.before is not None}.values())
        for n in level:
            n.before = None
        drop = max(0, len(self.out) - self.depth - 1)
        del self.out[:drop]
        self.begin -= drop

    def end(self) -> list[Match]:
        """After the last point."""
        had = len(self.out)
        if self.mode == "batch":
            self._flush()
        elif self.mode == "online" and self.finalize and self.viterbi.states:
            return self._merge(self.viterbi.path(), everything=True)
        return self.out[had:]

    def _converge(self) -> list[Match]:
        """Corrects earlier rows once all surviving states have a common ancestor that is newer than the last one."""
        level = list({id(n): n for n in self.viterbi.states.values()}.values())
        if len(level) < 2:
            return []
        while len(level) > 1 and level[0].time > 1:
            if any(n.before is None for n in level):
                return []  # forgotten: whatever they share is too old to be corrected
            level = list({id(n.before): n.before for n in level}.values())
        if len(level) > 1 or self.root is not None and level[0].time <= self.root.time:
            return []
        root, last, path = level[0], self.root.time if self.root is not None else -1, []
        node = root
        while node is not None and node.time > last:
            path.append(node)
            node = node.before
        self.root = root
        return self._merge(path[::-1])

    def _merge(self, path: list[Node], everything: bool = False) -> list[Match]:
        now, changed, points, delay = self.viterbi.time, [], 0, 0
        for node in path:
            at = self.begin + node.time
            if at >= len(self.out):
                break
            if at < 0:
                continue
            if not everything and node.time < now - 2 * self.window:
                if self.compat:
                    break  # the original's merge stalls at a state that is too old, and corrects nothing after it
                continue
            m = self.out[at]
            moved = m.cand is None or abs(m.cand.lng - node.cand.lng) >= 1e-6 or abs(m.cand.lat - node.cand.lat) >= 1e-6
            if moved:
                points += 1
                delay += node.time - (now - self.window)
            if m.cand != node.cand or not m.converged:
                self.out[at] = Match(m.idx, node.cand, m.revision + 1, True)
                changed.append(self.out[at])
        if points and delay > 0:
            self.delay_points += points
            self.delay += delay
        return changed


def decode(network: Network, points: list[Point], **how) -> list[Match]:
    """All rows of a trajectory, one for each point."""
    d = Decoder(network, **how)
    for p in points:
        d.feed(p)
    d.end()
    return d.out
