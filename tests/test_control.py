"""Durable control store, settings, supervisor, catalog guards, DDL documents and the COPY reader."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text, values
from tidewright.functions.types import ContractError
from tidewright.operators import ddl, log
from tidewright.plans import catalog_queries, control
from tidewright.plans.queries import ORACLE_SQL
from tidewright.sources import catalog, copy_text, wire
from tidewright.streaming.supervisor import Progress, RebuildNeeded, Reconciler, Telemetry, lease_deadline


def test_control_store(spark, tmp_path):
    a, b = (control.ControlStore(spark, f"file://{tmp_path}") for _ in range(2))
    a.change(lambda c: c.put("sources", "s", {"host": "h"}))
    with pytest.raises(ContractError):
        a.change(lambda c: c.put("sources", "s", {"Password": "x"}))
    b.change(lambda c: c.upsert("p", {"n": 1}, 1, 1))
    assert a.read().pipelines["p"]["revision"] == 1
    assert a.change(lambda c: c.request_rebuild("p")) == 2 and b.change(lambda c: c.request_rebuild("p")) == 3
    assert [b.change(lambda c, g=g: c.complete_rebuilds("p", g)) for g in (2, 3, 3)] == [1, 1, 0]
    with pytest.raises(ContractError):
        a.change(lambda c: c.upsert("p", {}, 2, 3))
    a.change(lambda c: c.upsert("p", {}, 2, 4))
    assert len(a.read().revisions) == 2 and [r["state"] for r in a.listing("operations").collect()] == ["completed"] * 2
    assert [r["name"] for r in a.listing("pipelines").collect()] == ["p"]
    # of two writers at one version the second tries again on the newer state
    inner = []

    def raced(c):
        if not inner:
            inner.append(1)
            b.change(lambda d: d.desire("p", True))
        c.put("targets", "t", {})

    a.change(raced)
    got = a.read()
    assert got.pipelines["p"]["running"] and "t" in got.targets
    token = a.change(lambda c: c.acquire("p", "x", 30, 100))
    assert b.change(lambda c: c.acquire("p", "y", 30, 110)) is None
    assert not a.change(lambda c: c.renew("p", "x", token, 30, 131)) and b.change(lambda c: c.acquire("p", "y", 30, 131)) == token + 1


def test_reconciler(spark, tmp_path):
    store, calls, now = control.ControlStore(spark, f"file://{tmp_path}"), [], [1000.0]

    def run(name, definition, stop):
        calls.append(name)
        if definition.get("fail"):
            raise ValueError("boom")
        if definition.get("rebuild"):
            raise RebuildNeeded("lost")
        stop.wait(20)

    for n, d in (("good", {}), ("bad", {"fail": True}), ("old", {"rebuild": True})):
        store.change(lambda c, n=n, d=d: (c.upsert(n, d, 1, 1), c.desire(n, True)))
    r = Reconciler(store, "me", run, clock=lambda: now[0], initial=1, most=60)
    assert r.tick()["started"] == ["bad", "good", "old"]
    for n in ("bad", "old"):
        r.jobs[n].thread.join(10)
    assert sorted(r.tick()["ended"]) == ["bad", "old"] and store.read().pipelines["old"]["generation"] == 2
    assert calls.count("bad") == 1  # still backing off
    now[0] += 1.5
    assert "bad" in r.tick()["started"]
    r.jobs["bad"].thread.join(10)
    store.change(lambda c: c.upsert("good", {}, 2, 2))
    assert "good" in r.tick()["stopped"] and "good" in r.jobs  # started anew with its new revision
    assert r.jobs["good"].revision == 2
    now[0] += 100  # the lease ran out: renewal fails, the job stops and is taken again with a higher token
    before = r.jobs["good"].token
    r.tick()
    assert r.jobs["good"].token > before
    store.change(lambda c: c.desire("good", False))
    r.tick()
    assert "good" not in r.jobs and r.failures["bad"][0] >= 2
    assert lease_deadline(10, 30, 5) == 35
    assert all(t.name != "good" for t in threading.enumerate())


def test_progress():
    p = Progress(("sys", 1))
    p.emit(10)
    p.emit(20)
    p.keepalive(90)
    assert p.acknowledge(("sys", 1), 20) == {"write": 20, "flush": 20, "apply": 20} and p.durable == 20 and p.observed == 90
    for identity, lsn in ((("sys", 2), 20), (("sys", 1), 10), (("sys", 1), 90)):
        with pytest.raises(ContractError):
            p.acknowledge(identity, lsn)
    p.emit(30)
    with pytest.raises(ContractError):
        p.emit(25)
    assert p.feedback(5, 0) == {"xmin": 5, "epoch": 0} and p.durable == 20
    t = Telemetry()
    t.phase("p", "starting")
    t.report("p", received=10, applied=4, error="é" * 3000)
    assert t.lag("p") == 6 and len(t.state["p"]["error"]) == 1024
    with pytest.raises(ContractError):
        t.phase("p", "catching_up")


def test_settings():
    assert control.decode_settings("pipeline", "{}")["max_rows"] == 10_000
    for kind, bad in (("pipeline", '{"max_rows": 0}'), ("pipeline", '{"max_rows": "5"}'), ("pipeline", '{"max_rows": true}'), ("target", '{"x": 1}'), ("target", "[]"), ("target", "{"), ("source", '{"include_schemas": [1]}'), ("pipeline", '{"max_rows": 1, "max_rows": 2}'), ("pipeline", '{"tables": {"a.b": "c.d", "a.e": "c.d"}}')):
        with pytest.raises(ContractError):
            control.decode_settings(kind, bad)
    assert control.bootstrap('[store]\nroot = "/x"\n')["engine"]["lease_seconds"] == 30
    for bad in ("", '[store]\nroot = "/x"\nother = 1', '[store]\nroot = "/x"\n[z]\n', '[store]\nroot = "/x"\n[engine]\nrenew_seconds = 11', "["):
        with pytest.raises(ContractError):
            control.bootstrap(bad)


def test_names_and_commands(spark):
    one = spark.range(1)
    checks = {"erp_01": True, "ERP": False, "1erp": False, "a" * 24: True, "a" * 25: False, "": False}
    rows = spark.createDataFrame(list(checks.items()), "p string, want boolean")
    assert rows.filter(text.valid_prefix(rows.p) != rows.want).count() == 0
    rows = spark.createDataFrame([("a" * 63, True), ("a" * 64, False), ("", False), ("a\0b", False), ("é" * 32, False), (None, False)], "n string, want boolean")
    assert rows.filter(text.valid_identifier(rows.n) != rows.want).count() == 0
    assert one.select(one.id.alias("odd`name")).select(text.quote("odd`name")).count() == 1
    assert catalog.name_of("My Pipe", "slot", 3) == "tw_slot_my_pipe_3"
    assert catalog.replication_command("tw_slot", "16/B374D848", 'a"b') == """START_REPLICATION SLOT tw_slot LOGICAL 16/B374D848 (proto_version '1', publication_names '"a""b"', messages 'true')"""
    for args in (("tw", "0/", "p"), ("Tw", "0/1", "p"), ("tw", "0/000000000", "p"), ("tw", "g/0", "p")):
        with pytest.raises(ContractError):
            catalog.replication_command(*args)
    with pytest.raises(ContractError):
        catalog.replication_command("tw", "0/1", "p", streaming=True)
    assert catalog.parse_slot_response([("s", "0/1", "snap", "plugin")])["snapshot_name"] == "snap"
    for rows in ([], [("s", "0/1", "snap")], [("s", "", "snap", "x")], [("s", "0/1", "a", "b")] * 2):
        with pytest.raises(ContractError):
            catalog.parse_slot_response(rows)
    g = catalog.SnapshotGuard(2)
    with pytest.raises(ContractError):
        g.release()
    assert [g.register(x) for x in "ab"] == ["created", "ready"]
    g.release()
    with pytest.raises(ContractError):
        g.register("c")
    assert catalog.dsn("a b", "h", 5432, "d/1", sslmode="require") == "postgresql://a%20b@h:5432/d%2F1?sslmode=require"
    v = values.uuid7(1_700_000_000_000)
    assert v[14] == "7" and v[19] in "89ab" and v < values.uuid7(1_700_000_000_001)
    row = one.select(catalog.version_at_least(catalog.F.lit("Citus 14.1.0"), 14, 1).alias("a"), catalog.version_at_least(catalog.F.lit("13.9"), 14, 1).alias("b"), catalog.version_at_least(catalog.F.lit("x"), 14, 1).alias("c")).first()
    assert tuple(row) == (True, False, None)


def test_publication_and_faults(spark):
    state = spark.createDataFrame([("p", True, ["s.b", "s.a"]), ("q", False, ["s.a"])], "pubname string, complete boolean, members array<string>")
    wanted = spark.createDataFrame([("p", "s.a"), ("p", "s.b")], "pubname string, table_name string")
    catalog.require_publication(state, wanted)
    for bad in ([("p", "s.a")], [("q", "s.a")], [("r", "s.a")]):
        with pytest.raises(ContractError):
            catalog.require_publication(state, spark.createDataFrame(bad, wanted.schema))
    shape = "node_id int, seq long, kind string, xid long, lsn long, n_bytes long"
    good = [(0, 1, "begin", 1, 5, 0), (0, 2, "row", 1, 5, 9), (0, 3, "commit", 1, 6, 0)]
    assert log.require_transactions(spark.createDataFrame(good, shape)).count() == 1
    for bad in (good[1:], good[:2], [*good, good[2][:1] + (4,) + good[2][2:]], [good[0], (0, 2, "begin", 2, 5, 0)], [good[0], (0, 2, "commit", 1, 4, 0)], [good[0], (0, 3, "commit", 2, 6, 0)]):
        with pytest.raises(ValueError):
            log.require_transactions(spark.createDataFrame(bad, shape))
    with pytest.raises(ValueError, match="too many bytes"):
        log.require_transactions(spark.createDataFrame(good, shape), max_bytes=8)


def test_documents(spark):
    assert ddl.portable_fingerprint_text({"b": [{"oid": 1, "n": "é"}], "generation": 3}) == '{"b":[{"n":"é"}]}'
    assert wire.decode_message(b"T" + (1).to_bytes(4, "big") + b"\3" + (7).to_bytes(4, "big"))["truncate_flags"] == 3


def test_copy_reader_refuses(spark):
    shape = spark.createDataFrame([], "a int, b binary").schema
    good = spark.createDataFrame([("1\t\\\\x00ff",), ("\\N\t\\N",), ("\\.",)], "value string")
    assert [(r.a, r.b and bytes(r.b)) for r in copy_text.parse_lines(good, shape).collect()] == [(1, b"\0\xff"), (None, None)]
    for bad in ("1", "x\t\\N", "1\t2\t3"):
        with pytest.raises(Exception, match="COPY line|no int"):
            copy_text.parse_lines(spark.createDataFrame([(bad,)], "value string"), shape).collect()


def test_shapes_by_block(spark, monkeypatch):
    import struct

    shape = lambda n: b"R" + struct.pack(">I", 7) + b"s\0t\0d" + struct.pack(">H", n) + b"".join(b"\1id\0" + struct.pack(">Ii", 20, -1) for _ in range(n))
    insert = lambda n: b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", n) + b"n" * n
    rows = [insert(1), shape(1), insert(1), shape(2), insert(2), insert(1), insert(2)]
    decoded = wire.decode(spark.createDataFrame([(1, 3 * i, p) for i, p in enumerate(rows)], "node_id int, seq long, payload binary"))
    want = {0: None, 6: 1, 12: 2, 15: None, 18: 2}
    assert {r["seq"]: r["generation"] for r in wire.with_relations(decoded).collect()} == want
    monkeypatch.setattr(wire, "FEW_SHAPES", 0)
    for block in (1, 4, 100):
        assert {r["seq"]: r["generation"] for r in wire.with_relations(decoded, block).collect()} == want


def test_connection_url(spark):
    rows = [("h", "a@b", "p/a:ss?#", "sales data"), (" ::1 ", "it's", "(x)!*~ +", None)]
    frame = spark.createDataFrame(rows, "host string, user string, password string, db string")
    c = frame.columns
    url = values.connection_url(frame[c[0]], F.lit(5432), F.coalesce(frame[c[3]], F.lit("d")), frame[c[1]], frame[c[2]], F.lit("prefer"))
    assert [r[0] for r in frame.select(url).collect()] == ["postgresql://a%40b:p%2Fa%3Ass%3F%23@h:5432/sales%20data?sslmode=prefer", "postgresql://it's:(x)!*~%20%2B@[::1]:5432/d?sslmode=prefer"]


def test_operations_in_tables(spark, tmp_path):
    store = control.ControlStore(spark, f"file://{tmp_path}")
    store.change(lambda c: (c.upsert("p", {}, 1, 1), c.upsert("q", {}, 1, 1)))
    store.change(lambda c: c.request_rebuild("p"))  # generation 2, in the document
    ops = lambda *rows: spark.createDataFrame([(i, p, k, g, s, 0.0) for i, p, k, g, s in rows], control.OPERATION)
    store.add_operations(ops(("a", "p", "rebuild", 2, "requested"), ("b", "p", "rebuild", 4, "requested"), ("c", "q", "rebuild", 1, "requested"), ("d", "p", "other", 1, "requested"), ("e", "p", "rebuild", None, "requested"), ("f", "p", "rebuild", 1, "failed"), ("g", None, "rebuild", 1, "requested")))
    with pytest.raises(ContractError, match="unknown pipeline 'r'"):
        store.add_operations(ops(("x", "r", "rebuild", 1, "requested")))
    assert len(list(tmp_path.glob("operations-*"))) == 1
    assert [store.complete_rebuilds(n, g) for n, g in ((["p"], 3), (["p"], 3), (["p"], 1), ([], 9))] == [2, 0, 0, 0]
    store.add_operations(ops(("h", "p", "rebuild", 2, "requested")))  # asked for after the completion: still open
    state = lambda: {r["id"]: r["state"] for r in store.operations().collect() if len(r["id"]) == 1}
    assert state() == {"a": "completed", "b": "requested", "c": "requested", "d": "requested", "e": "requested", "f": "failed", "g": "requested", "h": "requested"}
    assert store.change(lambda c: c.complete_rebuilds("p", 4)) == 0
    assert [state()[i] for i in "abch"] == ["completed", "completed", "requested", "completed"]
    assert store.listing("operations").count() == 9 and len(store.read().operations) == 1


def test_document_of_the_format_before(spark, tmp_path):
    store = control.ControlStore(spark, f"file://{tmp_path}")
    store.commits.publish(1, {"pipelines": {"p": {"definition": {}, "revision": 1, "generation": 1, "running": False}}, "format": 1, "version": 1})
    assert store.change(lambda c: c.request_rebuild("p")) == 2 and store.complete_rebuilds(["p"], 2) == 1 and store.read().format == 2


def test_rebuilds_stay_off_the_driver(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    sizes, publish = [], control.Commits.publish
    monkeypatch.setattr(control.Commits, "publish", lambda self, version, document: (sizes.append(len(str(document))), publish(self, version, document))[1])
    most = []
    for n in (100, 5_000):
        e = spark.range(-60, n).select(F.col("id").alias("event_id"), (F.col("id") % 41).alias("user_id"), F.when(F.col("id") % 3 != 0, "error").otherwise("view").alias("event_type"))
        odd = spark.createDataFrame([(None, 3, "error"), (7, None, "error"), (4_000, None, "error"), (5, 4, None), (None, None, "error")], "event_id long, user_id long, event_type string")
        e.union(odd).write.parquet(f"{tmp_path}/{n}/events.parquet")
        sizes.clear()
        ours = sorted(map(str, catalog_queries.rebuild_operations(spark, f"{tmp_path}/{n}").select("pipeline", "generation", "open", "completed").collect()))
        most.append(max(sizes))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{n}/events.parquet/*.parquet'")
        got = db.execute(ORACLE_SQL["rebuild_operations"]).fetchall()
        assert ours == sorted(f"Row(pipeline={p}, generation={g}, open={o}, completed={c})" for p, g, o, c in got)
    assert most[1] < most[0] + 1_000  # the document doesn't grow with the log


def test_large_sizes(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, n, s) for k in (1, 4, 13, 18_547, 1_200_000, None) for s in (0, 1, 50, -3, None) for n in ("ab", "aébcdéfghij", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    ours = catalog_queries.readable_values(spark, str(tmp_path)).select("p_partkey", "size", "took", "short", "phase").collect()
    assert sorted(repr(tuple(r)) for r in ours) == sorted(map(repr, db.execute(ORACLE_SQL["readable_values"]).fetchall()))
    # the operator itself also knows TiB
    one = spark.range(1).select(values.readable_bytes(F.lit(1_100_672_358_400)), values.readable_bytes(F.lit(1_100_672_358_400), ("KiB", "MiB", "GiB")))
    assert tuple(one.first()) == ("1.0 TiB", "1025.0 GiB")
