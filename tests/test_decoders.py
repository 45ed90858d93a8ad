"""Decoders against brute force on small lattices, and what must hold of any result."""

import itertools
import math
import random

import pytest

from waymark.operators import baselines
from waymark.operators.recover import recover_points
from waymark.operators.decoder import NEVER, Decoder, Point, Weights, decode, emission, transitions
from waymark.operators.routing import Candidate, Network, haversine, project


def city(n=4, step=0.002):
    """A grid of dual segments with one-way ones among them; node ids row by row."""
    place = {r * n + c: (104 + step * c, 30.6 + step * 0.9 * r) for r in range(n) for c in range(n)}
    segments, k = {}, 1
    for a in place:
        for b in ([a + 1] if a % n < n - 1 else []) + ([a + n] if a + n in place else []):
            line = [place[a], ((place[a][0] + place[b][0]) / 2 + 0.00003, (place[a][1] + place[b][1]) / 2), place[b]]
            length = sum(haversine(*p, *q) for p, q in zip(line, line[1:]))
            dual = k % 5 != 0
            segments[k] = (a, b, dual, length, line)
            if dual:
                segments[-k] = (b, a, dual, length, line[::-1])
            k += 1
    return Network(segments)


def walk(net, seed, steps=5, most=4):
    rng = random.Random(seed)
    points, (x, y) = [], (104 + 0.002 * rng.uniform(0.2, 1.5), 30.6 + 0.0018 * rng.uniform(0.2, 1.5))
    for i in range(steps):
        x, y = x + rng.uniform(0, 0.0006), y + rng.uniform(-0.0001, 0.0004)
        p = Point(i, 5000 * i, x, y)
        for s in net.segments:
            err, leg, px, py = project(x, y, net.segments[s][4])
            if err <= 60:
                p.candidates.append(net.at(s, x, y, i))
        p.candidates = sorted(p.candidates, key=lambda c: c.order)[:most]
        points.append(p)
    return points


@pytest.mark.parametrize("seed", range(25))
def test_batch_is_the_best_sequence(seed):
    net = city()
    points = walk(net, seed)
    if any(not p.candidates for p in points):
        points = [p for p in points if p.candidates]
    best, value = None, NEVER
    steps = [transitions(net, a, b, True) for a, b in zip(points, points[1:])]
    for way in itertools.product(*(p.candidates for p in points)):
        v = emission(way[0].err)
        for a, b, t in zip(way, way[1:], steps):
            v += 0.5 * t[a, b] + 0.5 * emission(b.err)
        if v > value + 1e-12:
            best, value = way, v
    found = decode(net, points, mode="batch", weights=Weights(dynamic=False))
    assert len(found) == len(points)
    if best is not None:
        got = [m.cand for m in found]
        v = emission(got[0].err) + sum(0.5 * t[a, b] + 0.5 * emission(b.err) for a, b, t in zip(got, got[1:], steps))
        assert v == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("seed", range(15))
def test_sizes_and_greedy_prefix(seed):
    net = city()
    points = walk(net, 100 + seed, steps=9)
    points[4].candidates = [] if seed % 3 == 0 else points[4].candidates
    for mode in ("batch", "greedy", "online"):
        assert [m.idx for m in decode(net, points, mode=mode)] == list(range(9))
    greedy = decode(net, points, mode="greedy", weights=Weights(dynamic=False))
    for k in range(1, 10):
        part = decode(net, points[:k], mode="greedy", weights=Weights(dynamic=False))
        assert [m.cand for m in part] == [m.cand for m in greedy[:k]]


@pytest.mark.parametrize("seed", range(15))
def test_online_corrections_are_the_batch_path(seed):
    net = city()
    points = walk(net, 200 + seed, steps=14)
    batch = decode(net, points, mode="batch", weights=Weights(dynamic=False))
    online = Decoder(net, "online", Weights(dynamic=False), window=50)
    for p in points:
        online.feed(p)
    online.end()
    if all(p.candidates for p in points):
        for a, b in zip(batch, online.out):
            if b.converged:
                assert (a.cand.seg, a.cand.lng) == (b.cand.seg, b.cand.lng)


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("mode", ["greedy", "online"])
def test_forgetting_changes_nothing(seed, mode):
    net = city()
    points = walk(net, 300 + seed, steps=16)
    whole, short = Decoder(net, mode, window=3), Decoder(net, mode, window=3)
    seen = {}
    for p in points:
        whole.feed(p)
        for m in short.feed(p):
            seen[m.idx] = m.cand
        short.forget()
    assert [seen[m.idx] for m in whole.out] == [m.cand for m in whole.out]
    assert len(short.out) <= short.depth + 1


def test_no_candidates_and_empty():
    net = city()
    assert decode(net, []) == []
    lone = [Point(0, 0, 0.0, 0.0), Point(1, 1000, 0.0, 0.0)]
    assert [m.cand for m in decode(net, lone, mode="online")] == [None, None]
    assert [m.cand.skip for m in baselines.dynamically_weighted(net, lone)] == [True, True]
    assert [m.cand.skip for m in baselines.adaptive_online(net, lone)] == [True, True]
    assert baselines.adaptive(net, lone) [1] == 0.0


def test_routes():
    net = city()
    a, b = net.at(1, 104.0005, 30.6), net.at(1, 104.0015, 30.6)
    assert net.length(a, b) == pytest.approx(b.offset - a.offset, abs=0.01)
    assert net.length(b, a) == pytest.approx(net.length(a, b))  # a dual segment may be left backwards
    assert net.length(a, net.reversed(b)) == pytest.approx(net.length(a, b), abs=1e-6)
    one = net.at(5, *net.segments[5][4][1])
    back = Candidate(5, 0, *net.segments[5][4][0], 0.0, 0.0)
    assert net.length(one, back) is None or net.length(one, back) > net.segments[5][3] / 2  # one-way: goes round
    for x, y in ((a, b), (b, a), (a, net.at(9, 104.003, 30.603))):
        r = net.route(x, y)
        assert (r is None) == (net.length(x, y) is None)
        if r:
            assert r.length == pytest.approx(net.length(x, y))
            assert sum(haversine(*p, *q) for p, q in zip(r.points, r.points[1:])) == pytest.approx(r.length, abs=1e-6)
    assert net.point_route((104.0, 30.6), (104.0, 30.6)).length == 0
    with pytest.raises(LookupError):
        net.point_route((0.0, 0.0), (104.0, 30.6))


def test_weights():
    w = Weights()
    w.update(-10, -20)
    assert w.transition == pytest.approx(0.7 / 1.3) and w.emission == pytest.approx(0.6 / 1.3)
    w.update(0, -31)
    assert w.transition == pytest.approx(0.7 / 1.3)


def test_programme_has_the_least_value():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 5))
        s = rng.uniform(0, 1.4, (2, n))
        w, p, total = baselines.weigh(s)
        value = lambda w, p: 10 * w @ w + math.exp(-2 * n) * p @ p - w @ s @ p  # noqa: E731, B023
        assert w.sum() == pytest.approx(1) and p.sum() == pytest.approx(1) and (w >= 0).all() and (p >= 0).all()
        tried = min(value(np.array([u, 1 - u]), q) for u in np.linspace(0, 1, 41) for q in [*np.eye(n), *rng.dirichlet(np.ones(n), 200)])
        assert value(w, p) <= tried + 1e-6
        assert total == pytest.approx(w @ s @ p)


def test_exact_projection_is_no_farther_than_the_halving_one():
    rng = random.Random(4)
    for _ in range(50):
        line = [(104 + 0.001 * k, 30.6 + rng.uniform(0, 0.001)) for k in range(6)]
        x, y = 104 + rng.uniform(0, 0.005), 30.6 + rng.uniform(0, 0.001)
        assert project(x, y, line)[0] <= project(x, y, line, compat=True)[0] + 1e-9


# ---------------------------------------------------------------- rules of the original, on hand-made rows


def test_path_is_cut_at_the_segments_end():
    net = city()
    net.segments[99] = (90, 91, False, 100.0, [(105.0, 30.6), (105.001, 30.6), (105.002, 30.6)])
    alone = Network(net.segments)
    a, b = alone.at(99, 105.0002, 30.6), alone.at(1, 104.0005, 30.6)
    parts = recover_points(alone, [a, b])
    assert [p[0] for p in parts] == [[99], [1]]
    assert parts[0][1] == [(a.lng, a.lat), (105.001, 30.6), (105.002, 30.6)] and parts[1][1] == [(b.lng, b.lat)]


def test_repair_leaves_a_candidates_own_length():
    net = city()
    steps = []
    for k, (seg, lng, lat, least) in enumerate([(1, 104.0005, 30.6, 0.0), (4, 104.002, 30.601, 900.0), (3, 104.0045, 30.6, 950.0)]):
        step = baselines._Step(Point(k, 1000 * k, lng, lat), [baselines._Place(net.at(seg, lng, lat, k), least)], steps[-1] if steps else None, least)
        steps.append(step)
    baselines._relink(net, steps[2])
    x = steps[2].places[0]
    assert x.least == 950.0 and x.before is steps[0].places[0] and steps[2].before is steps[0]
    assert steps[2].least == pytest.approx(net.length(steps[0].places[0].cand, x.cand))


def test_recall_that_fails_forgets_and_a_break_keeps():
    net = city()
    at = lambda k, seg, lng, lat: Point(k, 3000 * k, lng, lat, [net.at(seg, lng, lat, k)])
    far = [at(0, 1, 104.0002, 30.6), at(1, 1, 104.0008, 30.6), at(2, 22, 104.006, 30.605)]
    got = baselines.adaptive_online(net, far, far=1.0)
    assert [m.cand.skip for m in got] == [False, False, False]  # no step is near enough: nothing is taken back
    lone = dict(net.segments) | {99: (90, 91, False, 100.0, [(104.0, 30.61), (104.001, 30.61)])}
    cut = Network(lone)
    broken = [at(0, 1, 104.0002, 30.6), Point(1, 3000, 104.0005, 30.61, [cut.at(99, 104.0005, 30.61, 1)])]
    plain, compat = (baselines.adaptive_online(cut, broken, compat=c) for c in (False, True))
    assert plain[1].cand.seg == 99 and compat[1].cand.seg == 1


def test_unused_weights():
    assert [baselines.distance_weight(h, 1, 3) for h in (0.5, 1, 2, 3, 4)] == [1, 1, 0.5, 0, 0]
    assert baselines.heading_score(60, 90, 1) == pytest.approx(0.75) and baselines.heading_score(60, 90, 2) == pytest.approx(0.5)
    assert [baselines.heading_weight(*v, 2, 6) for v in ((1, 9), (7, 8), (4, 4), (2, 6))] == [0, 1, 0.5, 0.5]


def test_searches_stop_and_are_bounded():
    net = city(12)
    nodes = range(144)
    whole = {(a, b): net.distance(a, b) for a in nodes for b in nodes}
    fresh = Network(net.segments, keep=300)
    rng = random.Random(1)
    for _ in range(600):
        a, b = rng.choice(nodes), rng.choice(nodes)
        bound = rng.choice([math.inf, 400.0, 1500.0])
        want = whole[a, b]
        got = fresh.distance(a, b, bound)
        assert got == (want if want is not None and want <= bound else None)
        assert fresh.entries <= 300 or len(fresh.found) == 1
    near = Network(net.segments)
    near.distance(0, 1)
    assert near.entries < 20


def test_own_weights_and_router():
    net = city()
    points = walk(net, 5, steps=6)
    own = Weights(0.5, 0.5, False)
    assert [m.cand for m in decode(net, points, weights=own)] == [m.cand for m in decode(net, points, weights=Weights(dynamic=False))]
    heavy = Weights(0.0, 1.0, False)  # emissions alone: the nearest candidates
    assert [m.cand for m in decode(net, points, mode="greedy", weights=heavy)][0] == min(points[0].candidates, key=lambda c: c.order)
