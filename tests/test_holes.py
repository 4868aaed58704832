import itertools
import random

import pytest
from pyspark.sql import functions as F

from wirelog.operators.holes import (
    gaps_at_expiry,
    gaps_exact,
    gaps_online,
    id_epochs,
    sender_leases,
    top_ids,
)
from wirelog.operators import id_scan
from wirelog.operators.id_futures import Futures, Rules, Stretch, first_jump, grow
from wirelog.operators.id_scan import scan_ids
from wirelog.operators.id_state import IdMemory, observe, remaining_holes

BASES = [-1000, -3, 0, 1, 2**31 - 40]


def _take(ids, capacity, max_hole):
    memory = IdMemory()
    return sum(observe(memory, i, capacity, max_hole) for i in ids), memory


@pytest.mark.parametrize("hole", range(1, 6))
@pytest.mark.parametrize("base", BASES)
def test_holes_in_flight_and_at_the_end(hole, base):
    ids = [base + (hole + 1) * n for n in range(5)]
    found, _ = _take(ids, 1, hole * 5)
    assert found == 4 * hole
    found, memory = _take(ids, 5, hole + 1)
    assert found == 0 and remaining_holes(memory, hole + 1) == 4 * hole
    if hole > 2:
        assert remaining_holes(memory, hole - 1) == 0


def test_memory_stays_sorted_for_every_permutation():
    for order in itertools.permutations(range(1, 5)):
        _, memory = _take(order, 4, 3)
        assert memory.recent == [1, 2, 3, 4]


def test_bounds_and_resets():
    memory = IdMemory()
    for candidate, max_hole in [(0, 1), (-1, 1), (1, 2)]:
        observe(memory, candidate, 1, max_hole)
    assert (memory.lo, memory.hi) == (-1, 1)
    for jump in (10, -10):
        found, memory = _take([0, jump], 2, 5)
        assert found == 0 and memory.recent == [jump] and memory.epoch == 1
    assert _take([0, 10], 2, 5)[1].hi is None and _take([0, -10], 2, 5)[1].hi == -10


@pytest.mark.parametrize("seed", range(30))
def test_futures_equal_direct_steps(seed):
    """Whatever came before a stretch, its description gives the memory after it."""
    rnd = random.Random(seed)
    steps = [1, 1, 2, -1] if seed % 3 else [1, 15, 40, -30, -2]
    at, ids = 0, []
    for _ in range(60):
        at += rnd.choice(steps)
        ids.append(at if rnd.random() < 0.95 else -(2**31))
    cut = rnd.randrange(1, 59)
    capacity = rnd.choice([1, 3, 10])
    _, before = _take(ids[:cut], capacity, 10)
    futures = Futures(capacity, 10)
    most = 0
    for candidate in ids[cut:]:
        futures.add(candidate)
        most = max(most, len(futures.live))
    assert most <= 3
    expected = before.copy()
    for candidate in ids[cut:]:
        observe(expected, candidate, capacity, 10)
    jumps = [(j.candidate, j.upwards, j.opens) for j in futures.jumps]
    position = first_jump(before, jumps, 10)
    if position is None:
        assert grow(before, futures.grown, capacity) == expected
    else:
        end, epochs = futures.outcome(futures.jumps[position].group)
        after = futures.members[futures.live[end]]
        assert after.same_future(expected) and before.epoch + epochs == expected.epoch


def _stretch(arrivals, rules):
    memory, futures, leases = IdMemory(), Futures(rules.capacity, rules.max_hole, rules.limit), 0
    for at, (candidate, us) in enumerate(arrivals):
        if at and us - arrivals[at - 1][1] >= rules.idle_us:
            memory, futures, leases = IdMemory(), None, leases + 1
        if futures is None:
            observe(memory, candidate, rules.capacity, rules.max_hole)
        else:
            futures.add(candidate)
    ends = arrivals[0][1], arrivals[-1][1]
    return Stretch.of(futures, *ends) if futures else Stretch.constant(*ends, leases, memory)


@pytest.mark.parametrize("limit", [2, 3, 100])
@pytest.mark.parametrize("seed", range(25))
def test_stretches_compose_in_any_order(seed, limit):
    """Folded pairwise however it falls, a run of stretches does what its arrivals do one by one."""
    rnd = random.Random(seed)
    steps = [1, 1, 2, -1] if seed % 3 else [1, 15, 40, -30, -2, 20, 20]
    rules = Rules(1000, rnd.choice([1, 3, 10]), 10, limit)
    at, us, arrivals = 0, 0, []
    for _ in range(80):
        at += rnd.choice(steps)
        us += 1000 if rnd.random() < 0.01 else 1
        arrivals.append((at if rnd.random() < 0.95 else -(2**31), us))
    cuts = sorted({0, 80, *(rnd.randrange(1, 79) for _ in range(9))})
    pieces = [arrivals[a:b] for a, b in zip(cuts, cuts[1:])]
    stretches = [_stretch(piece, rules) for piece in pieces[1:]]
    while len(stretches) > 1:
        k = rnd.randrange(len(stretches) - 1)
        stretches[k : k + 2] = [stretches[k].followed_by(stretches[k + 1], rules)]
    whole = Stretch.from_json(stretches[0].to_json())
    before, expected = IdMemory(), IdMemory()
    begun = 0
    for n, (candidate, us) in enumerate(arrivals):
        if n and us - arrivals[n - 1][1] >= rules.idle_us:
            expected, begun = IdMemory(), begun + (n >= cuts[1])
        observe(expected, candidate, rules.capacity, rules.max_hole)
        if n == cuts[1] - 1:
            before = expected.copy()
    broke = whole.breaks(pieces[0][-1][1], rules)
    found = whole.after(None if broke else before, rules)
    assert whole.leases + broke == begun
    if found is None:
        assert limit < 100
    else:
        assert found == expected


def test_descriptions_stay_small():
    """A sender that counts in steps of 20 may jump at every id; its description doesn't grow."""
    rules = Rules(10**9, 10, 10, id_scan.JUMPS)
    sizes = []
    for count in (200, 2000, 20000):
        whole = _stretch([(20 * n, n) for n in range(10**6, 10**6 + count)], rules)
        sizes.append(len(whole.to_json()))
        for part in range(1, 5):
            begin = 10**6 + part * count
            whole = whole.followed_by(_stretch([(20 * n, n) for n in range(begin, begin + count)], rules), rules)
        sizes.append(len(whole.to_json()))
    assert max(sizes) < 1500 and max(sizes) - min(sizes) < 300


def test_scan_folds_and_looks_again(spark, ids_of, monkeypatch):
    """Partitions folded two at a time; a memory that takes an unlisted jump is looked for again."""
    monkeypatch.setattr(id_scan, "FOLD", 2)
    monkeypatch.setattr(id_scan, "JUMPS", 2)
    ids = [*range(0, 400, 5), 200, *range(150, 900, 20), *range(880, 1000, 3)] * 3
    rows = [(port, n + port, at * 1000) for at, n in enumerate(ids) for port in (0, 1)]
    tried = []
    original = id_scan.describe_partitions
    monkeypatch.setattr(id_scan, "describe_partitions", lambda *a: tried.append(a[1].limit) or original(*a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scan_ids(ids_of(rows).repartition(5), "1 minute", 5, 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r.sender_port, r.msg_id, r.kind, r.lease, r.epoch, r.holes) for r in found]
    expected = _scan_model(sorted(rows, key=lambda r: (r[0], r[2])), 60_000_000, 5, 10)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert tried == [2] or tried == [2, 4] or tried == [2, 4, 8]


def _scan_model(rows, idle, capacity, max_hole):
    found, current = [], None
    for port, msg_id, us in rows:
        if current is not None and (port != current or us - last >= idle):
            found.append((current, None, "lease_end", lease, memory.epoch, remaining_holes(memory, max_hole)))
        if port != current:
            memory, lease = IdMemory(), 0
        elif us - last >= idle:
            memory, lease = IdMemory(), lease + 1
        holes = observe(memory, msg_id, capacity, max_hole)
        found.append((port, msg_id, "arrival", lease, memory.epoch, holes))
        current, last = port, us
    found.append((current, None, "lease_end", lease, memory.epoch, remaining_holes(memory, max_hole)))
    return found


@pytest.mark.parametrize("kind", ["dense", "jumps", "strides", "leases"])
def test_scan_of_a_hot_sender_equals_model(spark, ids_of, kind):
    rnd = random.Random(kind)
    now, at, rows = 0, {p: 0 for p in range(3)}, []
    for _ in range(900):
        port = rnd.choice([0] * 8 + [1, 2])
        now += 2_000_000 if kind == "leases" and rnd.random() < 0.02 else rnd.choice([1, 1000])
        if kind == "jumps" and rnd.random() < 0.03:
            at[port] = rnd.randrange(-500, 3000)
        at[port] += 20 if kind == "strides" else rnd.choice([1, 1, 1, 2, 4, -2])
        rows.append((port, at[port], now))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        found = scan_ids(ids_of(rows).repartition(5), "1 second", 5, 10).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    got = [(r.sender_port, r.msg_id, r.kind, r.lease, r.epoch, r.holes) for r in found]
    expected = _scan_model(sorted(rows, key=lambda r: (r[0], r[2])), 1_000_000, 5, 10)
    assert sorted(got, key=str) == sorted(expected, key=str)


def _ids(rnd, jumps=True):
    rows, at = [], {p: 0 for p in (1, 2)}
    for n in range(300):
        port = rnd.choice([1, 1, 2])
        at[port] += rnd.choice([1, 1, 2, 9, 30]) if jumps else 1
        rows.append((port, at[port] - 100, n))
    return rows + rows[:20]


@pytest.mark.parametrize("bucket", [1, 7, 64, 65536])
def test_exact_gaps_equal_brute_force(spark, ids_of, bucket):
    rows = _ids(random.Random(3))
    expected = set()
    for port in (1, 2):
        present = sorted({i for p, i, _ in rows if p == port})
        expected |= {
            (port, a, b, b - a - 1) for a, b in zip(present, present[1:]) if 1 <= b - a - 1 <= 10
        }
    found = gaps_exact(ids_of(rows), bucket=bucket).collect()
    assert {(r.sender_port, r.after_id, r.before_id, r.hole_size) for r in found} == expected
    assert len(found) == len(expected) > 10


def test_gaps_at_the_ends_of_the_id_range(spark, ids_of):
    rows = [(1, -(2**31), 0), (1, -(2**31) + 3, 1), (1, 2**31 - 5, 2), (1, 2**31 - 1, 3)]
    assert sorted(r.hole_size for r in gaps_exact(ids_of(rows)).collect()) == [2, 3]


def test_online_equals_exact_for_small_disorder(spark, ids_of):
    ids = [n for n in range(1, 401) if n % 11]
    rnd = random.Random(1)
    order = sorted(range(len(ids)), key=lambda n: n + rnd.random() * 4)
    rows = ids_of([(1, ids[n], at * 1000) for at, n in enumerate(order)])
    online = gaps_online(rows).agg(F.sum("holes")).first()[0]
    at_end = gaps_at_expiry(rows).agg(F.sum("holes")).first()
    total = online + (at_end[0] or 0)
    assert total == gaps_exact(rows).agg(F.sum("hole_size")).first()[0] == 36


def test_leases_equal_brute_force(spark, ids_of):
    rnd = random.Random(5)
    now, rows = -3_000_000, []
    for n in range(400):
        now += rnd.choice([0, 10, 500_000, 999_999, 1_000_000, 1_000_001, 5_000_000])
        rows.append((rnd.choice([1, 1, 2]), n, now))
    expected = []
    for port in (1, 2):
        times = [us for p, _, us in rows if p == port]
        groups = [[times[0]]]
        for before, us in zip(times, times[1:]):
            if us - before >= 1_000_000:
                groups.append([])
            groups[-1].append(us)
        expected += [(port, n, g[0], g[-1], len(g)) for n, g in enumerate(groups)]
    found = sender_leases(ids_of(rows), "1 second").select(
        "sender_port", "lease", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "messages"
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_epochs_and_top(spark, ids_of):
    rows = ids_of([(1, i, n) for n, i in enumerate([1, 2, 3, 50, 51, 1, 2])])
    assert [r.epoch for r in id_epochs(rows).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert [r.msg_id for r in top_ids(rows, 3).orderBy("rank").collect()] == [51, 50, 3]


@pytest.mark.parametrize("bad", [0, -1])
def test_parameters(spark, ids_of, bad):
    rows = ids_of([(1, 1, 1)])
    for call in (gaps_exact, gaps_online, gaps_at_expiry, id_epochs):
        with pytest.raises(ValueError):
            call(rows, max_hole=bad)
    with pytest.raises(ValueError):
        gaps_online(rows, ids_per_port=bad)
