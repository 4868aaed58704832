import random

import pytest
from conftest import fragment, murmur3
from pyspark.sql import functions as F

from wirelog.operators.compat import defragment_compat
from wirelog.operators.decode import valid_fragments
from wirelog.operators.defrag import defragment, find_hot_keys, missing_fragments, with_checksum
from wirelog.operators.message_state import PartialMessage


def _outcome(result):
    messages = sorted(
        (r.sender_port, r.msg_id, r.generation, bytes(r.payload), tuple(r.tags))
        for r in result.messages.collect()
    )
    incomplete = sorted(
        (r.sender_port, r.msg_id, r.generation, r.touches, tuple(sorted(r.missing)))
        for r in result.incomplete.collect()
    )
    assert sorted(_opened(result.generations)) == sorted(set(_opened(result.generations)))
    invalid = sorted(r.seq for r in result.invalid.collect())
    late = sorted(r.seq for r in result.late_duplicates.collect())
    return messages, incomplete, invalid, late


def _opened(generations):
    return [
        (r.sender_port, r.msg_id, r.generation, str(r.first_ts), r.first_seq)
        for r in generations.collect()
    ]


def _run(packets, **options):
    return defragment(valid_fragments(packets), **options)


def test_out_of_order(packets_of):
    digest = murmur3(b"\2\1")
    packets = packets_of(
        [(9, 0, fragment(2, 1, 1, 7, 2, digest, b"\1")), (9, 1, fragment(2, 0, 1, 7, 2, digest, b"\2"))]
    )
    row = with_checksum(_run(packets).messages).first()
    assert bytes(row.payload) == b"\2\1" and row.checksum_ok


@pytest.mark.parametrize(
    "index,length,good",
    [(4, 4, False), (4, 5, True), (4, 6, False), (2, 9, False), (2, 10, True), (2, 11, False)],
)
def test_fragment_length(packets_of, index, length, good):
    packets = packets_of([(9, 0, fragment(5, index, 10, 7, 45, 0, b"x" * length))])
    result = _run(packets)
    assert result.invalid.count() == (0 if good else 1)
    missing = missing_fragments(result.incomplete).count()
    assert missing == (4 if good else 5)


@pytest.mark.parametrize("change", [{"size": 12}, {"count": 4}, {"digest": 1}])
def test_header_mismatch(packets_of, change):
    second = {"count": 5, "size": 10, "digest": 0, **change}
    packets = packets_of(
        [
            (9, 0, fragment(5, 0, 10, 7, 45, 0, b"x" * 10)),
            (9, 1, fragment(second["count"], 1, second["size"], 7, 45, second["digest"], b"x" * second["size"])),
        ]
    )
    assert [r.fragment_index for r in _run(packets).invalid.collect()] == [1]


def test_empty_message(packets_of):
    row = _run(packets_of([(9, 0, fragment(1, 0, 0, 7, 0, 0, b""))])).messages.first()
    assert bytes(row.payload) == b"" and row.fragment_count == 1


def test_expiry_edge(packets_of):
    a, b = fragment(2, 0, 1, 7, 2, 0, b"a"), fragment(2, 1, 1, 7, 2, 0, b"b")
    assert _run(packets_of([(9, 0, a), (9, 9_999, b)])).messages.count() == 1
    late = _run(packets_of([(9, 0, a), (9, 10_000, b)]))
    assert late.messages.count() == 0 and late.incomplete.count() == 2


def test_offsets_do_not_overflow(packets_of):
    data = fragment(65535, 65534, 65535, 7, 2**31 - 1, 0, b"x")
    assert _run(packets_of([(9, 0, data)])).invalid.count() == 1


def _random_rows(seed, ports=(1, 1, 1, 2), rows=400):
    rnd = random.Random(seed)
    out, now = [], 0
    for _ in range(rows):
        now += rnd.choice([0, 1, 5, 30, 200]) if rnd.random() < 0.97 else 1200
        count = 3 if rnd.random() < 0.95 else 2
        index = rnd.randrange(count)
        size = 4 if rnd.random() < 0.95 else 5
        payload = bytes(rnd.randrange(256) for _ in range(2 if index == 2 else 4))
        if rnd.random() < 0.05:
            payload += b"!"
        tags = rnd.choice([b"", b"", b"a\0b", b"c"])
        digest = 5 if rnd.random() < 0.95 else 6
        data = fragment(count, index, size, rnd.randrange(4), 10, digest, payload, tags)
        out.append((rnd.choice(ports), now, data))
    return out


def _model(rows, expire_ms, phantom=False):
    """Sequential reading of the rules over parsed rows."""
    open_, generation = {}, {}
    messages, incomplete, invalid, late, touches = [], [], [], [], {}
    for seq, row in enumerate(rows):
        key = (row.sender_port, row.msg_id)
        current = open_.get(key)
        if current is not None and row.us - current.last_us >= expire_ms * 1000:
            if not current.done:
                incomplete.append((*key, generation[key], touches[key], tuple(current.missing())))
            current = None
        if current is None:
            current = open_[key] = PartialMessage.opened_by(row)
            generation[key] = generation.get(key, -1) + 1
            touches[key] = 0
        verdict = current.ingest(row)
        touches[key] += verdict != "late_duplicate"
        if verdict == "invalid":
            invalid.append(seq)
        elif verdict == "late_duplicate":
            late.append(seq)
        elif verdict == "complete":
            tags = tuple(current.tags or [])
            messages.append((*key, generation[key], current.payload(), tags))
            if phantom:
                open_[key] = None
    for key, current in open_.items():
        if current is not None and not current.done:
            incomplete.append((*key, generation[key], touches[key], tuple(current.missing())))
    return sorted(messages), sorted(incomplete), sorted(invalid), sorted(late)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sequential_model(spark, packets_of, seed):
    fragments = valid_fragments(packets_of(_random_rows(seed)))
    parsed = fragments.withColumn("us", F.unix_micros("ts")).orderBy("seq").collect()
    expected = _model(parsed, 1000)
    assert len(expected[0]) > 10 and len(expected[1]) > 5 and expected[2] and expected[3]
    shuffled = fragments.repartition(3).cache()
    assert _outcome(defragment(shuffled, "1 second")) == expected
    spread = defragment(shuffled, "1 second", hot_keys=find_hot_keys(shuffled, 60))
    assert _outcome(spread) == expected
    everything = defragment(shuffled, "1 second", hot_keys=find_hot_keys(shuffled, 0))
    assert _outcome(everything) == expected
    usual = defragment(shuffled, "1 second")
    assert sorted(_opened(everything.generations)) == sorted(_opened(usual.generations))
    assert sorted(_opened(spread.generations)) == sorted(_opened(usual.generations))


def _statuses(result):
    return [
        sorted((r.sender_host or "", r.fragment_index, r.seq) for r in rows.collect())
        for rows in (result.invalid, result.late_duplicates)
    ]


def test_ties_and_missing_hosts_are_the_same_either_way(spark, packets_of):
    digest = murmur3(b"abcd")
    first, second = fragment(2, 0, 2, 3, 4, digest, b"ab"), fragment(2, 1, 2, 3, 4, digest, b"cd")
    bad = fragment(2, 1, 2, 3, 4, 5, b"cd")
    rows = packets_of([(9, 0, first), (9, 100, first), (9, 150, bad), (9, 150, bad), (9, 200, second), (9, 300, second), (9, 300, second)])
    tied = rows.withColumn("seq", F.when(F.col("seq").isin(3, 6), F.col("seq") - 1).otherwise(F.col("seq")))
    for packets in (tied, tied.withColumn("sender_host", F.lit(None).cast("string"))):
        fragments = valid_fragments(packets)
        ways = [defragment(fragments), defragment(fragments, hot_keys=find_hot_keys(fragments, 2))]
        assert [_statuses(w) for w in ways] == [_statuses(ways[0])] * 2
        assert [len(x) for x in _statuses(ways[0])] == [2, 2]
        assert _opened(ways[0].generations) == _opened(ways[1].generations)
        assert ways[0].generations.first().first_seq == 0
        assert [bytes(r.payload) for w in ways for r in w.messages.collect()] == [b"abcd"] * 2


def test_keys_are_crowded_by_bytes_too(spark, packets_of):
    rows = [(9, n, fragment(9, n, 100, 1, 900, 0, b"x" * 100)) for n in range(3)]
    fragments = valid_fragments(packets_of(rows + [(8, 9, fragment(9, 0, 1, 1, 9, 0, b"x"))]))
    assert [r.sender_port for r in find_hot_keys(fragments, 100, min_bytes=299).collect()] == [9]
    assert find_hot_keys(fragments, 100, min_bytes=300).count() == 0


def test_single_fragments_need_no_assembly(spark, packets_of):
    fragments = valid_fragments(packets_of([(9, 0, fragment(1, 0, 99, 5, 77, murmur3(b"hi"), b"hi"))]))
    result = defragment(fragments)
    assert [bytes(r.payload) for r in result.messages.collect()] == [b"hi"]
    assert result.invalid.count() == result.incomplete.count() == 0


def test_no_hot_keys_means_the_usual_plan(spark, packets_of):
    fragments = valid_fragments(packets_of(_random_rows(3, rows=50)))
    result = defragment(fragments, "1 second", hot_keys=find_hot_keys(fragments, 10**6), singles=False)
    assert "Union" not in result.messages._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_partition_count_does_not_matter(spark, packets_of, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        fragments = valid_fragments(packets_of(_random_rows(4, rows=120)))
        parsed = fragments.withColumn("us", F.unix_micros("ts")).orderBy("seq").collect()
        assert _outcome(defragment(fragments, "1 second")) == _model(parsed, 1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_online_replica(spark, packets_of):
    fragments = valid_fragments(packets_of(_random_rows(5)))
    parsed = fragments.withColumn("us", F.unix_micros("ts")).orderBy("seq").collect()
    messages, incomplete, invalid, _ = _model(parsed, 1000, phantom=True)
    rows = defragment_compat(fragments, "1 second").collect()
    kinds = [r.kind for r in rows]
    assert kinds.count("message") == len(messages)
    assert kinds.count("invalid") == len(invalid)
    assert sorted(bytes(r.payload) for r in rows if r.kind == "message") == sorted(
        m[3] for m in messages
    )
    assert sorted(tuple(r.missing) for r in rows if r.kind == "incomplete") == sorted(
        i[4] for i in incomplete
    )


def test_one_exchange(spark, packets_of):
    fragments = valid_fragments(packets_of(_random_rows(6, rows=5)))
    plan = defragment(fragments).messages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2


def test_many_hot_keys_are_computed_once(spark, packets_of, monkeypatch):
    """Keys too many to broadcast are kept, however many parts and outputs read them."""
    from wirelog.operators import defrag

    monkeypatch.setattr(defrag, "BROADCAST_KEYS", 2)
    fragments = valid_fragments(packets_of(_random_rows(5, rows=120)))
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    keys = defrag.find_hot_keys(fragments, 0)
    number = keys.count()
    result = defrag.defragment(fragments, hot_keys=keys.coalesce(1).mapInArrow(counted, keys.schema))
    after = computed.value
    assert after <= 2 * number and number > 2  # a look at how many they are, and the keys themselves
    assert result.generations.count() == defrag.defragment(fragments).generations.count()
    assert result.late_duplicates.count() == defrag.defragment(fragments).late_duplicates.count()
    assert computed.value == after
