"""Segmentation, allocation, parsers, sources, sinks, loops, bootstrap, manifests and streams."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import parse
from parlance.operators import allocate, blocks, bootstrap, loops, segment
from parlance.plans import manifests as M
from parlance.plans import queries
from parlance.sources import readers, schemas, writers
from parlance.streaming import units as stream

UNIT = "unit_id long, recording string, speaker string, start double, end double, text string, flags array<string>, ingested_at timestamp"


def greedy(rows):
    rows, out = sorted(rows, key=lambda r: (r[3], r[4], r[2], r[0])), {}
    chunk, first, last = -1, None, None
    for uid, _, _, s, e in rows:
        if first is None or e - first > 27_500 or s - last > 3_000:
            chunk, first = chunk + 1, s
        last, out[uid] = e, chunk
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunks(spark, seed, monkeypatch):
    monkeypatch.setattr(segment, "BLOCK_MS", 20_000)
    r, rows, t = random.Random(seed), [], 0
    for i in range(500):
        t += r.choice([0, 400, 2_000, 2_999, 3_000, 9_000])
        rows.append((i, r.choice(["A", "A", "B"]), r.choice("XYZ"), t, t + r.randrange(1, 9_000)))
    df = spark.createDataFrame([(*x, "word", []) for x in rows], "unit_id long, recording string, speaker string, start_ms long, end_ms long, text string, flags array<string>")
    got = {x["unit_id"]: x["chunk"] for x in segment.assign_chunks(df).collect()}
    want = {}
    for rec in "AB":
        want |= greedy([x for x in rows if x[1] == rec])
    assert got == want


def test_chunks_without_pauses(spark, monkeypatch):
    """One stretch over many blocks, in which chunks run across the blocks' edges."""
    monkeypatch.setattr(segment, "BLOCK_MS", 40_000)
    r, rows, t = random.Random(9), [], 0
    for i in range(1_500):
        t += r.choice([0, 300, 900])
        rows.append((i, "A", r.choice("XYZ"), t, t + r.choice([200, 3_000, 27_000])))
    df = spark.createDataFrame(rows, "unit_id long, recording string, speaker string, start_ms long, end_ms long")
    assert {x["unit_id"]: x["chunk"] for x in segment.assign_chunks(df).collect()} == greedy(rows)
    assert segment.assign_chunks(df.limit(0)).count() == 0


def test_overlap_and_tiers(spark):
    rows = [(1, "A", "X", 0, 1000, "a", []), (2, "A", "Y", 500, 1500, "b", ["unintelligible"]), (3, "A", "X", 900, 1200, "c", []), (4, "A", "X", 60_000, 61_000, "d", [])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "unit_id long, recording string, speaker string, start_ms long, end_ms long, text string, flags array<string>, chunk int").withColumn("chunk", F.when(F.col("unit_id") == 4, 1).otherwise(0))
    got = {x["chunk"]: x for x in segment.chunk_rows(df.drop("text", "flags"), df).collect()}
    assert got[0]["overlap_ms"] == 700 and got[0]["quality_tier"] == "CHALLENGE" and got[0]["text"] == "a b c"
    assert got[1]["overlap_ms"] == 0 and got[1]["quality_tier"] == "A" and got[1]["example_id"] == "A_0001"


def test_timed_units_edges(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(1, "A", " x ", 0.0, 1.0, None, None, t), (1, "A", "x", 0.0, 1.0, "late", None, t + dt.timedelta(days=9)), (2, "A", None, 0.0, 1.0, "q", [], t), (3, "A", "x", 2.0, 1.0, "q", [], t), (4, None, "x", 0.0, 1.0, "q", [], t), (5, "A", "x", None, 1.0, "q", [], t)]
    got = segment.timed_units(spark.createDataFrame(rows, UNIT)).collect()
    assert [(x["unit_id"], x["speaker"], x["text"], x["flags"]) for x in got] == [(1, "X", "", [])]
    assert segment.assign_chunks(segment.lexical(segment.timed_units(spark.createDataFrame([], UNIT)))).count() == 0


def test_blocks(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), i, r.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    b = F.floor(F.col("t") / 11)
    n = {x["t"]: x["n"] for x in blocks.row_numbers(df, ["k"], ["t"], b, "n").collect()}
    s = {x["t"]: x["s"] for x in blocks.running_sum(df, ["k"], ["t"], b, "v", "s").collect()}
    p = {x["t"]: x["p"] for x in blocks.previous(df, ["k"], ["t"], b, "v", "p").collect()}
    for k in "ab":
        own, total, last = [x for x in rows if x[0] == k], 0, None
        for i, (_, t, v) in enumerate(own):
            total += v
            assert (n[t], s[t], p[t]) == (i, total, last)
            last = v


def test_components_and_allocation(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(120):03d}", f"n{r.randrange(120):03d}") for _ in range(90)] + [(None, "n001")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x["node"]: x["component"] for x in allocate.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    groups = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    assert got == {n: min(g) for g in groups.values() for n in g}
    sizes = spark.createDataFrame([("", f"c{i:02d}", f"c{i:02d}", float(r.randrange(1, 50))) for i in range(60)], "stratum string, component string, members string, duration double")
    split = allocate.allocate(sizes, "seed").groupBy("split").agg(F.sum("duration").alias("d")).collect()
    total = sum(x["d"] for x in split)
    assert {x["split"]: round(x["d"] / total, 1) for x in split} == {"train": 0.7, "validation": 0.1, "test": 0.2}
    big = allocate.allocate(sizes, "seed", sequential=10)
    assert big.count() == 60 and big.where("split IS NULL").count() == 0


def test_allocation_of_large_strata(spark):
    """Strata beyond the limit follow the same rule; one component of the first holds a third of the duration."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(4)
        rows = [(s, f"{s}{i:02d}", f"{s}{i:02d}", 500.0 if s == "a" and i == 33 else float(r.randrange(1, 50))) for s in "abc" for i in range(40)]
        sizes = spark.createDataFrame(rows, "stratum string, component string, members string, duration double").repartition(5)
        for seed in ("seed", "other"):
            small, large = (sorted(map(tuple, allocate.allocate(sizes, seed, sequential=n).collect())) for n in (1_000, 10))
            assert large == small and len(small) == 120
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


CHAT = "@Begin\n@Participants:\tANN Ann Participant, BOB Bob Interviewer\n@ID:\teng|c|ANN|34;|female|||Participant||ITA|\n@Comment:\tnoisy\n*ANN:\twell um \x15100_900\x15 yes\n\tand then \x15900_1500\x15 lost\n%com:\tx\n\tnot a part\n*BOB:\t(.) \x15300_400\x15\n*BOB:\txx \x15500_700\x15\n"


def test_tiers():
    got = parse.tier_units(CHAT)
    assert [(u[0], u[1], u[2], u[4]) for u in got] == [("ANN", 100, 900, "well um"), ("BOB", 500, 700, ""), ("ANN", 900, 1500, "yes and then")]
    assert parse.participants(CHAT) == [("ANN", "34;", "female", "Participant", "ita")]
    assert parse.participant_codes(CHAT) == ["ANN", "BOB"] and parse.comments(CHAT) == ["noisy"]
    assert parse.tier_units(None) == [] and parse.participant_codes("") == []


def test_interviews():
    text = "﻿Ann and Bob talk\nAnn: hello\nthere\n\nBob well yes\nA/Bob: both\nAnn: Bob: mm\nall: hey\nall of us\n"
    turns, preamble = parse.interview_turns(text, ["Ann", "Bob"], {"A": "Ann"})
    assert preamble == ["Ann and Bob talk"]
    assert [(t["speaker"], t["line_start"], t["line_end"], t["raw_text"]) for t in turns] == [("Ann", 2, 3, "hello there"), ("Bob", 5, 5, "well yes"), ("Ann/Bob", 6, 6, "both"), ("Ann/Bob", 7, 7, "mm"), ("ALL", 8, 9, "hey all of us")]
    assert parse.interview_turns(None, None) == ([], [])


def test_files(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"example_id": "a", "start": 1, "flags": []}\n\n{"example_id": "b"}\n')
    m = readers.read_jsonl(spark, str(tmp_path / "m.jsonl"), schemas.CHUNK)
    assert [(x["example_id"], x["start"]) for x in m.orderBy("example_id").collect()] == [("a", 1.0), ("b", None)]
    (tmp_path / "bad.jsonl").write_text('{"example_id": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.CHUNK).collect()
    (tmp_path / "R1.cha").write_bytes(("﻿" + CHAT).replace("\n", "\r\n").encode())
    t = readers.read_transcripts(spark, str(tmp_path / "*.cha")).first()
    assert t["recording"] == "R1" and t["text"] == CHAT
    assert parse.parse_tiers(readers.read_transcripts(spark, str(tmp_path / "*.cha")), "recording", "text").count() == 3
    (tmp_path / "segment.tbl").write_text("sbc007\tspeaker\t12\nsbc007\tspeaker\t3\nsbc007\ttitle:\tone\tx\nsbc007\ttitle\ttwo\nshort\tline\nnone\tkey\tv\n")
    s = readers.read_segment_table(spark, str(tmp_path / "segment.tbl"), "REC").collect()
    assert [(x["recording"], x["speaker_ids"], x["extra"]) for x in s] == [("REC007", ["12", "3"], {"title": "two"})]
    writers.write_jsonl(m, str(tmp_path / "out"), ["example_id"], one_file=True)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert [x["example_id"] for x in lines] == ["a", "b"] and list(lines[0]) == sorted(lines[0])
    writers.write_tsv(m, str(tmp_path / "tsv"), ["example_id", "flags"])
    d = spark.createDataFrame([("train", "a", {"x": 2})], "split string, id string, normalization_changes map<string,int>")
    writers.write_change_log(d, str(tmp_path / "log"), ["id"])
    writers.write_release(d.select("split", "id"), str(tmp_path / "rel"))
    with pytest.raises(Exception):
        writers.write_release(d.select("split", "id"), str(tmp_path / "rel"))
    assert json.loads(writers.summary_json(d.select("split")))["split"] == "train"
    assert len(readers.file_lineage(spark, str(tmp_path / "m.jsonl")).first()["sha256"]) == 64
    with pytest.raises(ValueError):
        readers.require_rows(d, 2)


def test_audio(spark, tmp_path):
    pcm = (np.arange(16_000) % 100).astype("<i2")
    for name, rate in (("a", 16_000), ("b", 8_000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(pcm.tobytes())
    audio = readers.read_wav(spark, str(tmp_path / "a.wav"))
    path = audio.first()["path"]
    clips = spark.createDataFrame([("x", path, 100, 200), ("y", path, 900, 5000)], "example_id string, path string, start_ms long, end_ms long")
    cut = {x["example_id"]: x["samples"] for x in readers.cut_samples(clips, audio).collect()}
    assert len(cut["x"]) == 1600 and len(cut["y"]) == 1600 and cut["x"][1] == pytest.approx(pcm[1601] / 32768)
    writers.write_wav(readers.cut_samples(clips, audio), str(tmp_path)).collect()
    with wave.open(str(tmp_path / "x.wav")) as w:
        assert np.array_equal(np.frombuffer(w.readframes(1600), "<i2"), pcm[1600:3200])
    with pytest.raises(Exception):
        readers.read_wav(spark, str(tmp_path / "b.wav")).collect()


def first_loop(ids, smallest, largest, reps):
    for i in range(len(ids)):
        for n, k in sorted(reps.items()):
            if smallest <= n <= largest and i + n * k <= len(ids) and all(ids[i + r * n : i + (r + 1) * n] == ids[i : i + n] for r in range(k)):
                return i, n
    return None


def test_loops(spark):
    r = random.Random(2)
    seqs = [[r.choice([1, 2]) for _ in range(r.randrange(40))] for _ in range(60)] + [[7, *[1, 2, 3] * 4], [5] * 8, []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, ids array<int>")
    got = df.withColumn("l", loops.first_loop(F.col("ids"), 1, 5, loops.REPETITIONS)).select("i", "l", loops.trim_loop(F.col("ids"), F.col("l")).alias("t")).collect()
    for x in got:
        want = first_loop(seqs[x["i"]], 1, 5, loops.REPETITIONS)
        assert (tuple(x["l"]) if x["l"] else None) == want
        assert x["t"] == (seqs[x["i"]][: want[0] + want[1]] if want else seqs[x["i"]])
    a = spark.createDataFrame([([9, 1, 2, 50, 3],)], "ids array<int>")
    b = a.select(loops.until(F.col("ids"), 50).alias("u"), loops.without_prefix(F.col("ids"), F.array(F.lit(9), F.lit(1))).alias("p"), loops.insert_before(F.col("ids"), F.lit(2), F.lit(8)).alias("s")).first()
    assert (b["u"], b["p"], b["s"]) == ([9, 1, 2], [2, 50, 3], [9, 1, 8, 2, 50, 3])


def test_generator_query_and_limit(spark, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(queries.bootstrap, "generator_rates", lambda sums, replicates=20_000, seed=20260803: seen.append((replicates, seed)) or {"a": np.arange(3.0)})
    monkeypatch.setattr(queries, "_errors", lambda spark, d: spark.createDataFrame([(1, "a", 1, 2)], "blind_id int, system string, errors int, units int"))
    monkeypatch.setattr(queries, "bench", lambda spark, d: spark.createDataFrame([(1, "v")], "blind_id int, video_id string"))
    assert queries.bootstrap_generator(spark, str(tmp_path)).count() == 1 and seen == [(20_000, 20260803)]
    monkeypatch.undo()
    monkeypatch.setattr(bootstrap, "MOST_SUMS", 5, raising=False)
    sums = spark.createDataFrame([(s, "c", 1, 2) for s in "abcdef"], "system string, cluster string, errors int, units int")
    with pytest.raises(ValueError):
        bootstrap.generator_rates(sums, 2)
    assert set(bootstrap.generator_rates(sums.where("system <> 'f'"), 2)) == {*"abcde"}


def test_bootstrap(spark):
    r = random.Random(4)
    rows = [(s, f"c{i % 7}", r.randrange(9), 10) for i in range(70) for s in "ab"]
    sums = bootstrap.cluster_sums(spark.createDataFrame(rows, "system string, cluster string, errors int, units int"))
    draws = bootstrap.hashed_draws(sums, 50, "x")
    assert {x["n"] for x in draws.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {7}
    rates = bootstrap.replicate_rates(sums, draws)
    ci = {x["system"]: x for x in bootstrap.intervals(rates, sums).collect()}
    assert all(ci[s]["low"] <= ci[s]["point"] <= ci[s]["high"] for s in "ab")
    assert bootstrap.paired_differences(rates, "a").count() == 1
    # the generator's draws, as they are made one by one
    exact = bootstrap.generator_rates(sums, 20, 7)
    g, names = random.Random(7), sorted({x[1] for x in rows})
    e = {(s, c): sum(x[2] for x in rows if x[:2] == (s, c)) for s in "ab" for c in names}
    for k in range(20):
        pick = g.choices(names, k=7)
        assert exact["a"][k] == pytest.approx(sum(e["a", c] for c in pick) / (100 * 7))


def test_manifests(spark):
    a = spark.createDataFrame([("x", "train", "R1", 200, 5), ("y", "test", "R1", 100, 7)], "example_id string, split string, recording string, duration_ms long, token_count int")
    b = spark.createDataFrame([("z", "c")], "example_id string, corpus string")
    both = M.combine(a, b)
    assert both.count() == 3 and both.where("corpus IS NULL").count() == 2
    assert [x["example_id"] for x in M.ranked_order(both).collect()] == ["x", "y", "z"]
    assert [tuple(x) for x in M.split_leaks(a).collect()] == [("R1", ["test", "train"])]
    assert {tuple(x) for x in M.id_differences(a, b, "example_id").collect()} == {("x", "left"), ("y", "left"), ("z", "right")}
    assert M.exposure_repeat(a).count() == 4 and M.unmatched(a, b, "example_id").count() == 2
    p = M.policy_rows(a.withColumn("v", F.lit("V")).withColumn("i", F.lit("I")), "v", "i")
    assert {(x["example_id"], x["text"]) for x in p.where("pair_id = 'x'").collect()} == {("x__verbatim", "V"), ("x__intended", "I")}
    with pytest.raises(Exception):
        M.unpadded(spark.createDataFrame([(0, 300)], "start_ms long, end_ms long")).collect()
    s = M.summary(a.withColumn("speakers", F.array(F.lit("A"), F.lit("B"))).withColumn("speaker_count", F.lit(None).cast("int"))).first()
    assert (s["examples"], s["recordings"], s["several_speakers"], s["n_train"], s["n_test"]) == (2, 1, 2, 1, 1)


def test_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    rows = [(i, "A", "x", float(i * 2), i * 2 + 1.5, "w", [], t + dt.timedelta(minutes=i)) for i in range(40)]
    spark.createDataFrame(rows, UNIT).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame(rows[:5], UNIT).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    src = stream.unit_stream(spark, str(tmp_path / "in/*"), spark.read.parquet(str(tmp_path / "in/a")).schema)
    q = stream.once_delivered(src).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 40
    timed = src.select("recording", (F.col("start") * 1000).cast("long").alias("start_ms"), (F.col("end") * 1000).cast("long").alias("end_ms")).where("start_ms >= 0")
    q = stream.greedy_chunks(timed).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    first = spark.table("chunks").where("chunk = 0").first()
    assert first["start_ms"] == 0 and first["end_ms"] - first["start_ms"] <= 27_500
    q = stream.ingestion_totals(src.withWatermark("ingested_at", "1 day")).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("totals").agg(F.sum("units")).first()[0] == 45


def test_resampling(spark, tmp_path):
    t = np.arange(8_000) / 8_000
    tone = np.sin(2 * np.pi * 440 * t)
    up = readers.resampled(tone, 8_000)
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert len(up) == 16_000 and np.abs(up - want)[200:-200].max() < 0.01
    assert len(readers.resampled(tone, 44_100)) == -(-8_000 * 160 // 441)
    stereo = np.column_stack([tone, tone]) * 20_000
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8_000)
        w.writeframes(stereo.astype("<i2").tobytes())
    x = readers.read_any_wav(spark, str(tmp_path / "s.wav")).first()
    assert x["rate"] == 16_000 and np.abs(np.array(x["samples"]) * 32768 / 20_000 - want)[200:-200].max() < 0.02
