"""Fold cases, random histories against a replay, apply, validation and the store."""

import random

import pytest

from tidewright.operators.apply import InvalidBatch, apply_changes, require_valid
from tidewright.operators.fold import AmbiguousSequence, fold, fold_stable, fold_steps
from tidewright.operators.log import LateRows, assign_batches
from tidewright.plans import store as store_module
from tidewright.plans.store import Corrupt, LsnRegression, StaleFence, Store
from tidewright.streaming import mirror

LOG = "seq long, op string, id int, old_id int, payload string, p_payload boolean"
UNCHANGED = object()


def events(*steps):
    out = []
    for n, (op, key, *rest) in enumerate(steps):
        old, value = None, UNCHANGED
        if op == "M":
            op, old, key, value = "U", key, rest[0], rest[1] if len(rest) > 1 else UNCHANGED
        elif rest:
            value = rest[0]
        sent = value is not UNCHANGED
        out.append({"seq": n, "op": op, "id": key, "old_id": old, "payload": value if sent else None, "p_payload": sent})
    return out


def fold_ordered(rows, keys, data):
    """``fold_steps`` with the values of the events put back."""
    rows = sorted(rows, key=lambda r: r["seq"])
    steps = []
    for r in rows:
        new, old = tuple(r[k] for k in keys), tuple(r[f"old_{k}"] for k in keys)
        steps.append((r["op"], new, None if None in old or old == new else old, [c for c in data if r[f"p_{c}"]]))
    out = []
    for op, key, old, cells in fold_steps(steps, data):
        row = {"op": op} | dict(zip(keys, key)) | {f"old_{k}": v for k, v in zip(keys, old or [None] * len(keys))}
        out.append(row | {c: rows[cells[c]][c] if c in cells else None for c in data} | {f"p_{c}": c in cells for c in data})
    return out


def short(rows):
    return sorted((r["op"], r["id"], r["old_id"], r["payload"] if r["p_payload"] else "-") for r in rows)


CASES = [
    ([("I", 1, "a")], [("U", 1, None, "a")]),
    ([("I", 1, "a"), ("U", 1, "b")], [("U", 1, None, "b")]),
    ([("I", 1, "a"), ("D", 1)], []),
    ([("I", 1, "a"), ("U", 1, "b"), ("D", 1)], []),
    ([("I", 1, "a"), ("D", 1), ("I", 1, "c")], [("U", 1, None, "c")]),
    ([("U", 1, "a"), ("U", 1)], [("U", 1, None, "a")]),
    ([("U", 1)], [("U", 1, None, "-")]),
    ([("U", 1, "a"), ("D", 1)], [("D", 1, None, "-")]),
    ([("D", 1), ("I", 1, "c")], [("U", 1, None, "c")]),
    ([("D", 1), ("I", 1, "c"), ("D", 1)], [("D", 1, None, "-")]),
    ([("M", 1, 2)], [("M", 2, 1, "-")]),
    ([("M", 1, 2), ("U", 2, "x")], [("M", 2, 1, "x")]),
    ([("M", 1, 2), ("M", 2, 3)], [("M", 3, 1, "-")]),
    ([("M", 1, 2), ("M", 2, 1)], [("U", 1, None, "-")]),
    ([("M", 1, 2), ("D", 2)], [("D", 1, None, "-")]),
    ([("I", 1, "a"), ("M", 1, 2), ("D", 2)], []),
    ([("M", 1, 2), ("I", 1, "r")], [("M", 2, 1, "-"), ("U", 1, None, "r")]),
    ([("M", 1, 2), ("I", 1, "r"), ("D", 2)], [("U", 1, None, "r")]),
]


@pytest.mark.parametrize("steps,expected", CASES)
def test_cases(steps, expected):
    assert short(fold_ordered(events(*steps), ["id"], ["payload"])) == sorted(expected)


def test_errors():
    for steps in ([("I", 1, "a"), ("I", 1, "b")], [("I", 1)], [("U", 1, "a"), ("D", 1), ("D", 1)], [("D", 1), ("U", 1, "a")]):
        with pytest.raises(AmbiguousSequence):
            fold_ordered(events(*steps), ["id"], ["payload"])


@pytest.mark.parametrize("moved", [False, True])
def test_errors_on_both_paths(spark, moved):
    extra = [("M", 50, 51)] if moved else []
    for steps in ([("I", 1, "a"), ("I", 1, "b")], [("I", 1)], [("U", 1, "a"), ("D", 1), ("D", 1)], [("D", 1), ("U", 1, "a")], [("I", 1, "a"), ("D", 1), ("U", 1, "a")], [("U", None, "a")]):
        rows = events(*steps, *extra)
        if moved and steps[0][1] is not None:  # a second move brings the faulty key into the ordered fold
            rows = [{"seq": -1, "op": "U", "id": 1, "old_id": 77, "payload": None, "p_payload": False}, *rows] if steps[0][0] == "U" else rows
        log = spark.createDataFrame([tuple(r[c] for c in ("seq", "op", "id", "old_id", "payload", "p_payload")) for r in rows], LOG)
        with pytest.raises(Exception, match="AmbiguousSequence"):
            fold(log, ["id"], ["payload"]).collect()
    with pytest.raises(Exception, match="AmbiguousSequence"):
        fold(spark.createDataFrame([(1, "D", 2, None, None, False), (2, "U", 2, 1, None, False)], LOG), ["id"], ["payload"]).collect()


def test_fold_keeps_every_bit(spark):
    """Keys and values above 2^53, NaN, decimals, binaries, chains and clashing column names."""
    import decimal

    big = (1 << 53) + 1
    shape = "seq long, op string, k long, old_k long, _key double, p__key boolean, _group decimal(38,0), p__group boolean, component long, p_component boolean, b binary, p_b boolean"
    rows = [
        (1, "U", big + 2, big, float("nan"), True, decimal.Decimal(10**37 + 1), True, (1 << 60) + 1, True, b"\0\xff", True),
        (2, "U", big + 4, big + 2, None, False, None, True, None, False, None, False),
        (3, "U", big + 6, None, float("nan"), True, None, False, (1 << 60) + 3, True, None, False),
        (4, "D", big + 8, None, None, False, None, False, None, False, None, False),
    ]
    got = {r["k"]: r for r in fold(spark.createDataFrame(rows, shape), ["k"], ["_key", "_group", "component", "b"]).collect()}
    assert set(got) == {big + 4, big + 6, big + 8}
    m = got[big + 4]
    assert (m["op"], m["old_k"], m["component"], bytes(m["b"])) == ("M", big, (1 << 60) + 1, b"\0\xff") and m["_key"] != m["_key"]
    assert m["_group"] is None and m["p__group"] and m["p__key"]
    u = got[big + 6]
    assert (u["op"], u["component"], u["p_b"]) == ("U", (1 << 60) + 3, False) and u["_key"] != u["_key"]
    assert got[big + 8]["op"] == "D"


def history(rng, start):
    state, steps = dict(start), []
    for n in range(rng.randint(1, 12)):
        live, free = sorted(state), [k for k in range(6) if k not in state]
        what = rng.choice("IUUMD")
        if what == "I" and free:
            k = rng.choice(free)
            state[k] = rng.choice([f"v{n}", None])
            steps.append(("I", k, state[k]))
        elif what == "U" and live:
            k = rng.choice(live)
            state[k] = f"v{n}"
            steps.append(("U", k, state[k]))
        elif what == "M" and live and free:
            k, j = rng.choice(live), rng.choice(free)
            state[j] = state.pop(k)
            steps.append(("M", k, j))
        elif what == "D" and live:
            k = rng.choice(live)
            del state[k]
            steps.append(("D", k))
    return state, steps


def test_random_histories_through_spark(spark):
    rng, rows, start, want = random.Random(4), [], [], {}
    for case in range(60):
        base = {k: f"s{k}" for k in range(6) if rng.random() < 0.5}
        state, steps = history(rng, base)
        try:
            fold_ordered(events(*steps), ["id"], ["payload"])
        except AmbiguousSequence:
            continue
        shift = lambda k: None if k is None else case * 10 + k
        rows += [r | {"seq": case * 100 + r["seq"], "id": shift(r["id"]), "old_id": shift(r["old_id"])} for r in events(*steps)]
        start += [(shift(k), v) for k, v in base.items()]
        want |= {shift(k): v for k, v in state.items()}
    names = ["seq", "op", "id", "old_id", "payload", "p_payload"]
    log = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], LOG)
    target = spark.createDataFrame(start, "id int, payload string")
    staging = fold(log, ["id"], ["payload"]).cache()
    after = apply_changes(target, staging, ["id"], ["payload"])
    assert {r["id"]: r["payload"] for r in after.collect()} == want


def test_validation(spark):
    shape = "op string, id int, old_id int, payload string, p_payload boolean"
    target = spark.createDataFrame([(1, "a")], "id int, payload string")
    for row in [("X", 1, None, "a", True), ("U", None, None, "a", True), ("U", 1, 2, "a", True), ("M", 1, 1, "a", True), ("M", 5, 6, "a", True), ("U", 9, None, None, False)]:
        with pytest.raises(InvalidBatch):
            require_valid(target, spark.createDataFrame([row], shape), ["id"], ["payload"])
    require_valid(target, spark.createDataFrame([("M", 2, 1, None, False)], shape), ["id"], ["payload"])


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    fence = store.activate_fence("p", 1, 1).fence
    assert store.register_group("g", ["items"], {"0": 10}, fence) == "registered"
    assert store.register_group("g", ["items"], {"0": 10}, fence) == "already_registered"
    with pytest.raises(ValueError):
        store.register_group("g", ["items"], {"0": 11}, fence)
    with pytest.raises(ValueError):
        store.activate_group("g", fence)
    store.load_shadow("g", "items", spark.createDataFrame([(1, "before")], "id int, payload string"), ["id"], fence)
    assert store.activate_group("g", fence)["outcome"] == "activated"
    assert store.activate_group("g", fence)["outcome"] == "already_active"
    shape = "op string, id int, old_id int, payload string, p_payload boolean"
    move = spark.createDataFrame([("M", 2, 1, None, False)], shape)
    assert store.apply({"items": move}, "0", 20, fence) == "advanced"
    assert store.apply({"items": move}, "0", 20, fence) == "unchanged"
    assert [tuple(r) for r in store.read("items").collect()] == [(2, "before")]
    with pytest.raises(LsnRegression):
        store.apply({}, "0", 5, fence)
    assert store.resume("g", fence, restart={"0": 20}) == {"0": 20}
    with pytest.raises(LsnRegression):
        store.resume("g", fence, restart={"0": 21})
    mine, other = store.head(), store.head()
    store.publish(mine)
    with pytest.raises(StaleFence):
        store.publish(other)
    newer = store.activate_fence("p", 2, 2).fence
    with pytest.raises(StaleFence):
        store.apply({}, "0", 30, fence)
    store.register_group("g2", ["items"], {"0": 40}, newer)
    store.load_shadow("g2", "items", spark.createDataFrame([(7, "x")], "id int, payload string"), ["id"], newer)
    assert store.activate_group("g2", newer)["quarantined"] == [("items", "replaced")]
    assert len(store.collect_garbage(newer, -1, 10)) == 1
    assert [tuple(r) for r in store.read("items").collect()] == [(7, "x")]


def test_store_deltas_against_replay(spark, tmp_path, monkeypatch):
    """Many small batches through deltas and merges give what one dictionary holds."""
    monkeypatch.setattr(store_module, "MERGE_AFTER", 3)
    rng, shape = random.Random(3), "op string, id int, old_id int, _bucket string, p__bucket boolean, n int, p_n boolean"
    store = Store(spark, f"file://{tmp_path}/store", buckets=3)
    fence = store.activate_fence("p", 1, 1).fence
    store.register_group("g", ["t"], {"0": 0}, fence)
    state = {k: (f"s{k}", k) for k in range(8)}
    store.load_shadow("g", "t", spark.createDataFrame([(k, *v) for k, v in state.items()], "id int, _bucket string, n int"), ["id"], fence)
    store.activate_group("g", fence)
    for lsn in range(1, 6):
        free = [k for k in range(14) if k not in state]
        a, b, c, d = rng.sample(sorted(state), 4)
        rows = [("U", a, None, f"u{lsn}", True, None, False), ("D", b, None, None, False, None, False), ("M", free[0], c, None, False, lsn, True), ("U", free[1], None, None, True, lsn, True), ("U", d, None, None, True, None, False)]
        state[a], state[d] = (f"u{lsn}", state[a][1]), (None, state[d][1])
        del state[b]
        state[free[0]] = (state.pop(c)[0], lsn)
        state[free[1]] = (None, lsn)
        store.apply({"t": spark.createDataFrame(rows, shape)}, "0", lsn, fence)
        if lsn in (1, 2, 5):
            assert {r["id"]: (r["_bucket"], r["n"]) for r in store.read("t").collect()} == state
    before = len(store._folders())
    assert store.collect_garbage(fence, -1, 10) == [] and len(store._folders()) < before
    assert {r["id"]: (r["_bucket"], r["n"]) for r in store.read("t").collect()} == state
    m = store.head()
    m.groups["g"]["tables"] = ["other"]
    store.publish(m)
    with pytest.raises(Corrupt):
        store.resume("g", fence)


def test_late_rows_raise_and_replays_do_nothing(spark, tmp_path):
    shape = "seq long, op string, id int, old_id int, payload string, p_payload boolean"
    rows = [(n, "U", n % 5, None, f"v{n}", True) for n in range(1, 31)]
    batch = lambda lo, hi: spark.createDataFrame(rows[lo:hi], shape)
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    fence = store.activate_fence("p", 1, 1).fence
    store.register_group("g", ["t"], {"0": 3}, fence)
    store.load_shadow("g", "t", spark.createDataFrame([(k, "s") for k in range(5)], "id int, payload string"), ["id"], fence)
    store.activate_group("g", fence)
    assert mirror.apply_batch(store, "t", "0", batch(0, 10), fence) == "advanced"  # rows up to 3 are in the snapshot
    assert mirror.apply_batch(store, "t", "0", batch(0, 10), fence) == "unchanged"
    assert mirror.apply_batch(store, "t", "0", batch(5, 12), fence) == "advanced"
    assert mirror.apply_batch(store, "t", "0", batch(20, 30), fence) == "advanced"
    for part in (batch(12, 20), batch(15, 30)):
        with pytest.raises(LateRows):
            mirror.apply_batch(store, "t", "0", part, fence)
    assert {r["id"]: r["payload"] for r in store.read("t").collect()} == {k: f"v{k + 25 if k else 30}" for k in range(5)}
    late = spark.createDataFrame([(99, "T", None, None, None, False)], shape)
    with pytest.raises(mirror.SchemaBarrier):
        mirror.apply_batch(store, "t", "0", late, fence)


def test_batches(spark):
    rng = random.Random(1)
    rows = [(n % 3, n, rng.randint(1, 60), rng.randint(1, 900), rng.random() < 0.1) for n in range(400)]
    got = {(r.node_id, r.seq): r.batch for r in assign_batches(spark.createDataFrame(rows, "node_id int, seq long, n_rows long, n_bytes long, barrier boolean"), 100, 2000).collect()}
    for node in range(3):
        batch, r, b, held, alone = 0, 0, 0, 0, False
        for _, seq, n, size, barrier in sorted(x for x in rows if x[0] == node):
            if held and (alone or barrier or r + n > 100 or b + size > 2000 or held >= 100):
                batch, r, b, held = batch + 1, 0, 0, 0
            r, b, held, alone = r + n, b + size, held + 1, barrier
            assert got[node, seq] == batch


def test_batches_of_empty_transactions(spark):
    rows = [(0, n, 0, 0, False) for n in range(5)]
    got = [r.batch for r in assign_batches(spark.createDataFrame(rows, "node_id int, seq long, n_rows long, n_bytes long, barrier boolean"), 2, 2000).orderBy("seq").collect()]
    assert got == [0, 0, 1, 1, 2]
