"""Decoders, files and streams on made input."""

import base64
import gzip
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import amm, decode, intents
from tidemark.operators import labels, policies, triggers
from tidemark.sources import files, sinks
from tidemark.sources.tape import events_tape
from tidemark.streaming import harness
from tidemark.streaming import triggers as live


def event(mint=b"m" * 32, user=b"u" * 32, buy=1, numbers=(5, 6, 7, 8, 9, 10, 2**64 - 1)):
    sol, tok, ts, vsol, vtok, rsol, rtok = numbers
    return bytes.fromhex(decode.discriminator("TradeEvent", "event")) + mint + struct.pack("<QQB", sol, tok, buy) + user + struct.pack("<QQQQQ", ts, vsol, vtok, rsol, rtok)


def test_trade_events(spark):
    lines = ["Program data: " + base64.b64encode(event()).decode(), "Program data: !!", "other", "Program data: " + base64.b64encode(event()[:100]).decode(), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("d", decode.program_data(F.col("line")))
    got = {r["i"]: r["e"] for r in df.select("i", decode.trade_event(F.col("d")).alias("e")).collect()}
    assert got[0].asDict() | {"mint": None, "user": None} == {"mint": None, "user": None, "is_buy": True, "sol": 5, "tok": 6, "ts": 7, "vsol": 8, "vtok": 9, "rsol": 10, "rtok": 2**64 - 1}
    assert bytes.fromhex(got[0]["mint"]) == b"m" * 32 and all(got[i] is None for i in (1, 2, 3, 4))
    names = {r["i"]: r["n"] for r in df.select("i", decode.event_name(F.col("d"), ["TradeEvent", "CreateEvent"]).alias("n")).collect()}
    assert names[0] == "TradeEvent" and names[2] == "Unknown"


def test_create_events_and_base58(spark):
    text = lambda s: struct.pack("<I", len(s)) + s
    keys = [bytes([i]) * 32 for i in range(4)]
    data = bytes.fromhex(decode.discriminator("CreateEvent", "event")) + text(b"Name") + text("Zé".encode()) + text(b"") + b"".join(keys)
    (r,) = spark.createDataFrame([(data,)], "d binary").select(decode.create_event(F.col("d")).alias("c"), decode.base58(F.lit(b"\0\0abc")).alias("b")).collect()
    assert (r["c"]["name"], r["c"]["symbol"], r["c"]["uri"], bytes.fromhex(r["c"]["creator"])) == ("Name", "Zé", "", keys[3])
    assert r["b"] == "11ZiCa"


def test_transactions(spark):
    tx = bytes([1]) + b"s" * 64 + bytes([0x80, 1, 0, 1]) + bytes([2]) + b"k" * 64 + b"h" * 32 + bytes([1, 1, 2, 0, 1, 3]) + b"abc" + bytes([0])
    batch = struct.pack("<Q", 1) + b"x" * 40 + struct.pack("<Q", 2) + tx + tx
    rows = decode.transactions(spark.createDataFrame([(1, batch), (2, batch[:-5]), (3, None)], "i int, payload binary")).collect()
    assert [r["i"] for r in rows] == [1, 1] and rows[0]["tx"]["version"] == 0 and rows[0]["tx"]["instructions"][0]["data"] == b"abc" and len(rows[0]["tx"]["keys"]) == 2


def test_intents_and_failed_buys(spark):
    program, budget, system, tipped = (bytes([i]) * 32 for i in (1, 2, 0, 9))
    keys = [bytes([40 + i]) * 32 for i in range(14)] + [program, budget, system, tipped]  # numbers 14 to 17
    disc = lambda name: bytes.fromhex(decode.discriminator(name))
    order = lambda name, tokens, limit, accounts: (14, accounts, disc(name) + struct.pack("<QQ", tokens, limit))
    ixs = [
        (15, [], b"\x02" + struct.pack("<I", 20_000)), (15, [], b"\x03" + struct.pack("<Q", 77)), (16, [0, 17], b"\x02\0\0\0" + struct.pack("<Q", 5000)), (16, [0, 3], b"\x02\0\0\0" + struct.pack("<Q", 9)),
        order("buy", 10, 2**63 + 1, [0, 1, 2, 3, 4, 5, 6]), order("sell_v2", 11, 22, list(range(14))), order("buy", 1, 2, [0, 1, 2]), order("buy", 1, 2, [0, 1, 99, 3, 4, 5, 6]), order("create", 1, 2, list(range(14))), (14, [0] * 7, disc("buy") + b"short"),
    ]
    tx = lambda ixs: (b"s" * 64, 0, [1, 0, 4], keys, ixs)
    txs = spark.createDataFrame([(5, tx(ixs), [b"L" * 32] * 90), (6, tx([]), []), (7, tx([order("buy", 1, 2, [0, 1, 20, 3, 4, 5, 6])]), [b"A" * 32, b"B" * 32, b"C" * 32])], f"slot int, tx {decode.TRANSACTION}, more array<binary>")
    layout = intents.Layout(program.hex(), budget.hex(), system.hex(), (tipped.hex(),))
    got = sorted((r.asDict() for r in intents.intents(txs.drop("more"), layout).collect()), key=lambda r: r["type"])
    assert [(r["slot"], r["type"], r["version"], int(r["token_amount"]), int(r["sol_limit"])) for r in got] == [(5, "buy", 1, 10, 2**63 + 1), (5, "sell", 2, 11, 22)]
    buy, sell = got
    assert (buy["mint"], buy["user"], buy["signer"], buy["quote_mint"]) == (keys[2].hex(), keys[6].hex(), keys[0].hex(), None)
    assert (sell["mint"], sell["user"], sell["quote_mint"]) == (keys[1].hex(), keys[13].hex(), keys[2].hex())
    assert (int(buy["cu_limit"]), int(buy["unit_price"]), int(buy["tip"]), buy["n_ix"], buy["n_accounts"], buy["n_signers"]) == (20_000, 77, 5000, 10, 18, 1)
    assert buy["curve_writable"] and buy["probable_spoof"] and set(buy["programs"]) == {program.hex(), budget.hex(), system.hex()}
    failed = {r["slot"]: (r["mint"], r["signer"]) for r in intents.failed_buys(txs, layout, "more").collect()}
    assert failed == {5: (keys[2].hex(), keys[6].hex()), 7: ((b"C" * 32).hex(), keys[6].hex())}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"mint": "x", "sol": 5, "t": 1.5}\nnot json\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"mint": "y", "event": "TradeEvent", "is_buy": True}) + "\n")
    rows = files.json_lines(spark, str(tmp_path / "*.jsonl*")).cache()
    assert rows.filter("_corrupt_record is not null").count() == 1
    got = {r["mint"]: r for r in files.era(files.good(rows)).collect()}
    assert got["x"]["schema_era"] == 1 and got["y"]["schema_era"] == 2 and files.since(rows, "b").count() == 1
    paths = spark.createDataFrame([("/1/a.jsonl.gz",), ("/2/a.jsonl",), ("/1/b.jsonl.gz",)], "path string")
    assert [r["path"] for r in files.listing(paths).collect()] == ["/2/a.jsonl", "/1/b.jsonl.gz"]
    frame = lambda ns, slot, p: struct.pack(files.HEADER, ns, slot, len(p)) + p
    (tmp_path / "f.bin").write_bytes(frame(1, 2, b"ab") + frame(3, 4, b"") + frame(5, 6, b"cut")[:-1])
    assert [(r["recv_ns"], r["slot"], bytes(r["payload"])) for r in files.frames(spark, str(tmp_path / "f.bin")).orderBy("seq").collect()] == [(1, 2, b"ab"), (3, 4, b"")]


def test_amounts(spark):
    df = spark.createDataFrame([(42_400_000_000, 758_800_000_000_000, 50_000_000)], "vs long, vt long, pay long")
    (r,) = df.select(amm.buy_out_exact(F.col("vs"), F.col("vt"), F.col("pay")).alias("out"), amm.hash_bucket(F.lit("abc")).alias("b")).collect()
    assert int(r["out"]) == 758_800_000_000_000 - -(-42_400_000_000 * 758_800_000_000_000 // 42_450_000_000)
    import hashlib

    assert r["b"] == int(hashlib.md5(b"abc").hexdigest(), 16) % 100


def test_sizing(spark):
    from tidemark.functions import sizing

    vs, vt, bet = 42_400_000_000, 758_800_000_000_000, 50_000_000
    df = spark.createDataFrame([(x / 10, int(vs * (x / 10) ** 0.5), int(vt / (x / 10) ** 0.5)) for x in range(10, 21)], "drift double, fs long, ft long").withColumns({"vs": F.lit(vs), "vt": F.lit(vt), "bet": F.lit(bet)})
    p = df.withColumn("p", sizing.plan(F.col("vs"), F.col("vt"), F.col("bet"), 3000))
    f = p.withColumn("f", sizing.fill(F.col("fs"), F.col("ft"), F.col("p"), 100, F.lit(5000)))
    rows = f.withColumn("r", sizing.realised(F.col("fs") * 2, (F.col("ft") / 2).cast("long"), F.col("p"), F.col("f"), 100, F.lit(5000))).collect()
    root = 1.3**0.5
    cs, ct = int(vs * root), int(vt / root)
    want = ct - (cs * ct) // (cs + bet)
    for r in rows:
        cost = -(-(r["fs"] * r["ft"]) // (r["ft"] - want)) - r["fs"]
        assert r["p"]["tokens"] == want and r["f"]["filled"] == (cost <= bet) and r["f"]["cost"] == (cost if cost <= bet else 0)
        if r["f"]["filled"]:
            assert r["f"]["cost"] <= bet and r["r"]["on_outlay"] < r["r"]["on_curve"]
    assert rows[0]["f"]["filled"] and not rows[-1]["f"]["filled"]


def test_more_decoders(spark):
    amm = b"B" * 8 + b"x" * 40 + struct.pack("<QQ", 7, 9) + b"y" * 56 + b"p" * 32 + b"u" * 32
    curve = b"c" * 8 + struct.pack("<QQQQQ", 1, 2, 3, 4, 5) + b"\x01"
    df = spark.createDataFrame([(amm, curve), (amm[:100], curve[:20])], "a binary, c binary")
    one, two = df.select(decode.pool_event(F.col("a"), "42" * 8, "53" * 8, "43" * 8).alias("a"), decode.curve_account(F.col("c")).alias("c")).collect()
    assert one["a"]["kind"] == "buy" and (one["a"]["quote_res"], one["a"]["base_res"]) == (7, 9) and bytes.fromhex(one["a"]["pool"]) == b"p" * 32
    assert (one["c"]["vtok"], one["c"]["supply"], one["c"]["complete"]) == (1, 5, True) and two["a"] is None and two["c"] is None
    ix = [(0, [1], bytes([2]) + struct.pack("<I", 200_000)), (0, [], bytes([3]) + struct.pack("<Q", 77)), (1, [], bytes([2]) + struct.pack("<I", 9))]
    tx = spark.createDataFrame([(ix, [b"k" * 32, b"z" * 32]), ([], [b"k" * 32])], "ix array<struct<program:int,accounts:array<int>,data:binary>>, keys array<binary>")
    got = [r["b"] for r in tx.select(decode.compute_budget(F.col("ix"), F.col("keys"), (b"k" * 32).hex()).alias("b")).collect()]
    assert (got[0]["cu_limit"], got[0]["unit_price"]) == (200_000, 77) and (got[1]["cu_limit"], got[1]["unit_price"]) == (0, 0)
    names = spark.createDataFrame([(["a", "b", "c"],), (["x"],)], "k array<string>").select(decode.first_known(F.col("k"), {"c": "C", "b": "B"}).alias("n")).collect()
    assert [r["n"] for r in names] == ["B", None]
    bal = spark.createDataFrame([([("w", "100"), ("m", "4"), ("m", "20")],), ([("w", "1")],)], "b array<struct<mint:string,amt_str:string>>")
    assert [r["p"] for r in bal.select(decode.balance_price(F.col("b"), "w").alias("p")).collect()] == [5.0, None]


def test_upsert_and_journal(spark, tmp_path):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    got = {r["k"]: (r["v"], r["orig_v"]) for r in sinks.upsert(base, spark.createDataFrame([(2, 9.0)], "k int, v double"), ["k"]).collect()}
    assert got == {1: (1.0, None), 2: (9.0, 2.0)}
    rows = spark.createDataFrame([("a", "open", 1.0, 5), ("a", "open", 2.0, 6), ("a", "close", 3.0, 7), ("b", "open", 1.0, 8)], "mint string, kind string, t double, x int")
    state = {r["mint"]: r for r in sinks.latest(rows, "mint", "kind", "t").collect()}
    assert state["a"]["open"]["x"] == 6 and state["b"]["close"] is None


def test_unknown_policy(spark, sf):
    with pytest.raises(KeyError):
        policies.replay(events_tape(spark, sf), "none")


def _stream(spark, sf, tmp_path, parts=3):
    tape = events_tape(spark, sf).drop("kind")
    at = str(tmp_path / "tape")
    cuts = [r[0] for r in tape.selectExpr(f"percentile(ts, array({','.join(str(i / parts) for i in range(parts + 1))})) q").collect()][0]
    for i in range(parts):
        tape.filter((F.col("ts") >= cuts[i]) & ((F.col("ts") < cuts[i + 1]) if i + 1 < parts else F.lit(True))).coalesce(1).write.mode("append").parquet(at)
    return tape, spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(at)


def _run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_live_decisions_equal_batch(spark, sf, tmp_path):
    tape, stream = _stream(spark, sf, tmp_path)
    got = sorted(map(tuple, _run(live.decisions(stream), "live_decisions", tmp_path).collect()))
    assert got == sorted(map(tuple, triggers.decisions(tape).collect()))


def test_live_volume_equals_batch(spark, sf, tmp_path):
    tape, stream = _stream(spark, sf, tmp_path, 2)
    got = {(r["start"], r["rows"]) for r in _run(live.volume(stream, "1 day"), "live_volume", tmp_path, "complete").collect()}
    assert got == {(r["start"], r["rows"]) for r in live.volume(tape, "1 day").collect()}


def test_live_decisions_forget_silent_keys(spark, sf, tmp_path):
    """With a horizon beyond the tape nothing is forgotten; a short one loses decisions only."""
    tape, stream = _stream(spark, sf, tmp_path)
    want = set(map(tuple, triggers.decisions(tape).collect()))
    assert set(map(tuple, _run(live.decisions(stream, horizon=1e9), "live_long", tmp_path).collect())) == want
    short = {r["key"] for r in _run(live.decisions(stream, horizon=1.0), "live_short", tmp_path).collect()}
    assert short <= {r["key"] for r in tape.select("key").distinct().collect()}


@pytest.mark.parametrize("plan", [harness.PLAN, harness.Plan(take=90.0, cap=1e12)])
def test_live_harness_equals_batch(spark, sf, tmp_path, plan):
    tape, stream = _stream(spark, sf, tmp_path)
    events = [r.asDict() for r in _run(harness.run(stream, plan), f"live_harness_{int(plan.take)}", tmp_path).collect()]
    of = lambda kind: {e["key"]: e for e in events if e["kind"] == kind}
    decided, filled, left = of("decision"), of("fill"), of("exit")
    assert len(events) == len(decided) + len(filled) + len(left)
    want = harness.outcomes(tape, plan).collect()
    assert {r["key"] for r in want} == decided.keys() and not all(r["fired"] for r in want)
    # what is still open at the end is censored in batch, and has no exit live
    assert any(r["censored"] for r in want) if plan.take > 1 else any(r["reason"] == "take" for r in want)
    for r in want:
        k = r["key"]
        assert (decided[k]["n"], decided[k]["reason"] == "fire") == (r["decision"], r["fired"]) and abs(decided[k]["score"] - r["score"]) < 1e-9
        assert (filled[k]["mid"] if k in filled else None) == r["fill_mid"]
        assert (left[k]["reason"] if k in left else None) == r["reason"] and (k not in left or abs(left[k]["ret"] - r["exit_ret"]) < 1e-9)


def test_live_harness_gives_up_late_fills(spark, sf, tmp_path):
    tape, stream = _stream(spark, sf, tmp_path, 2)
    plan = harness.Plan(wait=20_000.0)
    kinds = {(r["key"], r["kind"]) for r in _run(harness.run(stream, plan), "live_wait", tmp_path).collect()}
    want = harness.outcomes(tape, plan).filter("fired").collect()
    assert {k for k, kind in kinds if kind == "fill"} == {r["key"] for r in want if r["fill_mid"] is not None}
    assert any(kind == "give_up" for _, kind in kinds)


def test_recent_files_only(spark, tmp_path):
    for name, t, mint in (("a", 1_000_000_000, "old"), ("b", 1_700_000_000, "new")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"t": 1.0, "mint": mint}) + "\n")
        os.utime(tmp_path / f"{name}.jsonl", (t, t))
    assert [r["mint"] for r in files.recent(spark, str(tmp_path), "2020-01-01T00:00:00").collect()] == ["new"]
    assert files.recent(spark, str(tmp_path), "2000-01-01T00:00:00").count() == 2


def test_live_harness_gives_up_without_a_later_row(spark, tmp_path):
    """Key 1 never trades again after it has fired: a timer gives the entry up; key 2 only moves the clock."""
    rows = [(1, i, 1000.0 + 100.0 * i, 100.0, 60.0, True) for i in range(3)] + [(2, 9, 50_000.0, 10.0, 1.0, True), (2, 10, 900_000.0, 10.0, 1.0, True)]
    for k, r in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(r, "key long, seq long, ts double, mid double, sol double, is_buy boolean").coalesce(1).write.parquet(str(tmp_path / f"t/{k}"))
        for at in (tmp_path / f"t/{k}").glob("*.parquet"):
            os.utime(at, (1_000 + k, 1_000 + k))  # the order in which the files are read
    stream = spark.readStream.schema("key long, seq long, ts double, mid double, sol double, is_buy boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "t"))
    plan = harness.Plan(wait=20_000.0)
    got = [(r["key"], r["kind"], r["ts"]) for r in _run(harness.run(stream, plan, late="1 hour"), "live_timer", tmp_path).collect()]
    assert got == [(1, "decision", 1200.0), (1, "give_up", 21_200.0)]
    # without timers the entry waits for a row that never comes
    assert [r["kind"] for r in _run(harness.run(stream, plan), "live_no_timer", tmp_path).collect()] == ["decision"]


@pytest.mark.parametrize("share", [0.0005, 0.02, 0.1, 0.3])
@pytest.mark.parametrize("plan", [harness.PLAN, harness.Plan(take=90.0, cap=1e12, wait=20_000.0)])
def test_batch_hands_its_state_to_the_stream(spark, sf, tmp_path, share, plan):
    """Cut anywhere, the events of the stream after the cut are those that a stream of all has after it."""
    tape, stream = _stream(spark, sf, tmp_path, 2)
    cut = tape.selectExpr(f"percentile(ts, {share})").first()[0]
    before, after = tape.filter(F.col("ts") <= cut), tape.filter(F.col("ts") > cut)
    state = harness.state_of(before, plan)
    state.write.parquet(str(tmp_path / "state"))
    after.coalesce(1).write.parquet(str(tmp_path / "after"))
    rest = spark.readStream.schema(tape.schema).parquet(str(tmp_path / "after"))
    initial = spark.readStream.schema(state.schema).parquet(str(tmp_path / "state"))
    tag = f"{int(share * 1e4)}_{int(plan.take)}"
    whole = _run(harness.run(stream, plan), f"hand_whole_{tag}", tmp_path).filter(F.col("ts") > cut)
    parts = _run(harness.run(rest, plan, initial=initial), f"hand_over_{tag}", tmp_path)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and parts.count()


def test_live_sessions_equal_batch(spark, sf, tmp_path):
    tape, stream = _stream(spark, sf, tmp_path, 2)
    got = {tuple(r) for r in _run(live.sessions(stream).select("key", "opened", "closes", "rows"), "live_sessions", tmp_path).collect()}
    want = {tuple(r) for r in live.sessions(tape).select("key", "opened", "closes", "rows").collect()}
    assert got and got <= want  # sessions that the watermark has not passed are still open


def test_live_crosses_equal_batch(spark, sf, tmp_path):
    tape, stream = _stream(spark, sf, tmp_path)
    got = {r["key"]: (r["cross_mid"], r["fill_mid"]) for r in _run(live.crosses(stream, 1.5, 1e9), "live_crosses", tmp_path).collect()}
    want = {r["key"]: (r["cross_mid"], r["fill_mid"]) for r in labels.crosses(tape, [1.5]).filter("fill_mid is not null").collect()}
    assert got == want


def test_live_first_seen_and_matches(spark, tmp_path):
    rows = [("a", 10.0), ("b", 11.0), ("a", 12.0), ("c", 5000.0), ("d", 9000.0)]
    seen = [("a", 15.0), ("b", 60.0), ("c", 5001.0), ("z", 9000.0), ("y", 20000.0)]
    for name, some in (("sent", rows), ("seen", seen)):
        for i, r in enumerate(some):
            spark.createDataFrame([r], "sig string, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda name: spark.readStream.schema("sig string, ts double").parquet(str(tmp_path / name))
    first = sorted(map(tuple, _run(live.first_seen(stream("sent"), ["sig"]), "live_first", tmp_path).select("sig").collect()))
    assert first == [("a",), ("b",), ("c",), ("d",)]
    got = {(r["sig"], r["sent"], r["seen"]) for r in _run(live.matched(stream("sent"), stream("seen")), "live_matched", tmp_path).collect()}
    assert {("a", 10.0, 15.0), ("a", 12.0, 15.0), ("c", 5000.0, 5001.0)} <= got and not any(s == "b" and t is not None for s, _, t in got)


def test_markdown_says_what_it_leaves_out(spark):
    from tidemark.sources import sinks

    rows = spark.range(5).withColumnRenamed("id", "k")
    assert sinks.markdown(rows).splitlines() == ["| k |", "|---|", *(f"| {k} |" for k in range(5))]
    assert sinks.markdown(rows, 3).endswith("First 3 rows; there are more.")
