import re
import json

import pytest
from pyspark.sql import functions as F

from clausewise.operators import extract
from clausewise.plans import rate_refresh
from clausewise.sources import page_text, rate_feeds, results, uploads
from clausewise.streaming import events


def test_upload_rules(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.png").write_bytes(b"%PDF")
    (tmp_path / "c.webp").write_bytes(b"RIFF0000WEBP")
    (tmp_path / "d.webp").write_bytes(b"RIFF0000WAVE")
    (tmp_path / "f.txt").write_bytes(b"x")
    checked = uploads.validate(uploads.read_files(spark, str(tmp_path)))
    got = {r.upload_id.split("/")[-1]: r.code for r in checked.collect()}
    assert got == {"a.pdf": None, "b.png": "MAGIC_BYTES_MISMATCH", "c.webp": None, "d.webp": "MAGIC_BYTES_MISMATCH", "f.txt": "INVALID_MIME_TYPE"}
    assert uploads.accepted(checked).count() == 2 and uploads.rejected(checked).count() == 3
    empty = spark.createDataFrame([("e", "application/pdf", bytearray(), 0)], "upload_id string, mime string, content binary, size long")
    assert uploads.validate(empty).first().code == "EMPTY_FILE"
    too_big = spark.createDataFrame([("x", "application/pdf", bytearray(b"%PDF"), 26 * 1024 * 1024 + 1)], "upload_id string, mime string, content binary, size long")
    assert uploads.validate(too_big).first().message == "File size 26.00 MB exceeds the maximum allowed size of 25 MB."
    raw = spark.createDataFrame([("x", "JVBERi0="), ("y", "***")], "upload_id string, file_content string")
    assert [bytes(r.content) if r.content else None for r in uploads.decode_base64(raw).collect()] == [b"%PDF-", None]


def test_runs_to_page(spark):
    runs = [(1, 1, 0, False, "Rate 5%", 72.0, 700.0, 60.0, 10.0), (1, 1, 1, True, "marker", 0.0, 0.0, 0.0, 0.0), (1, 1, 2, False, " ", 0.0, 0.0, 0.0, 0.0), (1, 1, 3, False, "  ", 0.0, 0.0, 0.0, 0.0), (1, 1, 4, False, "end\n", 72.0, 0.0, 9999.0, 0.0)]
    df = spark.createDataFrame([(*r, 612.0, 792.0) for r in runs], "audit_id int, page_no int, run_no int, is_marker boolean, str string, x double, y double, width double, height double, page_width double, page_height double")
    row = page_text.from_runs(df).first()
    assert row.text == "Rate 5%  end\n"
    assert [(w.word, w.off) for w in row.words] == [("Rate", 0), ("5%", 5), ("end", 9)]
    last = row.words[2].box
    assert last.x1 == 1.0 and last.y1 == 1.0 and last.y0 == pytest.approx((792 - 12) / 792)
    assert row.words[0].box.y0 == pytest.approx((792 - 700 - 10) / 792)


def test_lines_to_page(spark):
    reply = "```json\n" + json.dumps({"lines": [{"text": "ab cd", "box": {"x0": 0.1, "y0": 0.2, "x1": 0.6, "y1": 0.3}}, {"text": "z"}], "estimated": True}) + "\n```"
    df = spark.createDataFrame([(1, 1, reply), (1, 2, "no"), (1, 3, '{"lines": []}')], "audit_id int, page_no int, reply string")
    got = {r.page_no: r for r in page_text.from_lines(df).collect()}
    assert got[1].text == "ab cd\nz\n" and got[1].estimated
    assert [(w.word, w.off) for w in got[1].words] == [("ab", 0), ("cd", 3), ("z", 6)]
    assert got[1].words[1].box.x0 == pytest.approx(0.1 + 0.4 * 0.5) and got[1].words[2].box.y0 == 0.5
    assert got[2].text == "" and got[3].words == []


def test_classification_replies(spark):
    rows = [(1, '{"contractType": "MORTGAGE", "confidence": 0.9}'), (2, 'Well: {"contractType": "AUTO_LOAN", "confidence": 0.6} ok'), (3, "<think>{}</think>{\"contractType\": \"LEASE\", \"confidence\": 1}"), (4, '{"contractType": "MORTGAGE"}'), (5, "?")]
    got = {r.audit_id: (r.contract_type, r.warning_code) for r in extract.classify(spark.createDataFrame(rows, "audit_id int, reply string")).collect()}
    assert got == {1: ("MORTGAGE", None), 2: ("AUTO_LOAN", None), 3: ("UNKNOWN", "CLASSIFY_INVALID_TYPE"), 4: ("UNKNOWN", "CLASSIFY_LOW_CONFIDENCE"), 5: (None, "CLASSIFY_UNREADABLE")}


def test_series_and_refresh(spark, tmp_path):
    landed = tmp_path / "in"
    landed.mkdir()
    (landed / "V39079.json").write_text('{"observations": [{"d": "2026-03-01", "V39079": {"v": "2.75"}}]}')
    (landed / "V80691311.json").write_text("broken")
    answers = rate_feeds.read_series(spark, str(landed))
    replies = spark.createDataFrame([("https://www.wealthsimple.com/en-ca/save", '<think>x</think>{"savings": 1.5, "gic_1yr": 3}')], "url string, reply string")
    base = str(tmp_path / "rates")
    rates, errors = rate_refresh.refresh_rates(spark, base, answers, replies)
    assert rates.count() == 17 and [r.error for r in errors.collect()] == ["BOC V80691311: no observations in response"]
    assert results.read_version(spark, base).filter("category = 'overnight_rate' and value = 2.75").count() == 1
    assert rates.filter("source_name = 'Wealthsimple | savings' and value = 1.5").count() == 1


def test_sealed_maps(spark):
    spark.conf.set(results.KEY_CONF, "0f" * 32)
    df = spark.createDataFrame([(1, {"[A_1]": "x@y.org", "[B]": "é"})], "id int, m map<string,string>")
    sealed = results.seal_maps(df, "m", "b").select("m", "b")
    row = sealed.first()
    again = spark.createDataFrame([(row.b,), (row.b[:-1],), (row.b[:20],)], "b binary")
    assert [r[0] for r in results.open_maps(again, "b", "m").select("m").collect()] == [row.m, None, None]
    assert len(row.b) == 28 + len(json.dumps(row.m, separators=(",", ":"), ensure_ascii=False).encode())
    spark.conf.set(results.KEY_CONF, "1f" * 32)
    assert results.open_maps(again.limit(1), "b", "m").first().m is None
    spark.conf.set(results.KEY_CONF, "short")
    with pytest.raises(ValueError):
        results.seal_maps(df, "m", "b")
    spark.conf.unset(results.KEY_CONF)


def test_rehydrate(spark):
    pages = '[{"page_no": 1, "text": "t", "words": []}]'
    audits = spark.createDataFrame([(1, pages, "t"), (2, "oops", None)], "audit_id int, pages_json string, text string")
    pii = spark.createDataFrame([(1, 2, {"SSN_SIN": 2})], "audit_id int, total_redacted int, entity_counts map<string,bigint>")
    got = {r.audit_id: r for r in results.rehydrate(audits, pii).collect()}
    assert got[1].pages[0].text == "t" and got[1].total_redacted == 2
    assert got[2].pages == [] and got[2].text == "" and got[2].entity_counts == {}


def test_malformed_events_are_set_aside(spark):
    raw = spark.createDataFrame([(1, '{"type":"complete"}'), (1, "{oops"), (1, '{"type":"status_change","status":"FAILED","progress":3}')], "audit_id int, payload string")
    parsed = events.parse_events(raw)
    assert events.quarantine(parsed).count() == 1
    assert events.well_formed(parsed).filter(events.is_terminal(F.col("type"), F.col("status"))).count() == 2


@pytest.mark.parametrize("progress,left", [(0, 90), (50, 45), (100, 0), (99, 1), (33, 60)])
def test_remaining(spark, progress, left):
    assert spark.range(1).select(events.remaining_seconds(F.lit(progress))).first()[0] == left


def test_status_with_time_to_live(spark, tmp_path):
    src = tmp_path / "ev"
    spark.createDataFrame([(1, i, "status_change", "EXTRACTING", i) for i in range(5)] + [(2, 9, "error", "x", 1)], "audit_id long, seq long, type string, status string, progress int").write.parquet(str(src))
    stream = spark.readStream.schema("audit_id long, seq long, type string, status string, progress int").parquet(str(src))
    out = str(tmp_path / "out")
    q = events.stream_latest_status(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        q.awaitTermination(25)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.read.parquet(out).distinct().collect()] == [(1, 4, "EXTRACTING", 4)]


EVENT = "audit_id long, seq long, type string, status string, progress int"


def test_state_ends_with_the_terminal_event(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("ev", "out", "cp"))

    def run(*rows):
        spark.createDataFrame(rows, EVENT).write.mode("append").parquet(src)
        q = events.stream_history(spark.readStream.schema(EVENT).parquet(src), 3)
        q.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{out}/of={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.audit_id, r.seq) for r in events.kept_state(spark, checkpoint, "events").collect())

    change = lambda a, i: (a, i, "status_change", "EXTRACTING", i)
    assert run(*[change(1, i) for i in range(5)], change(2, 1)) == [(1, 2), (1, 3), (1, 4), (2, 1)]
    assert run((1, 9, "complete", None, None)) == [(2, 1)]
    assert run(change(1, 10), change(3, 1), change(3, 2)) == [(2, 1), (3, 1), (3, 2)]  # the late event of audit 1 brings nothing back
    last = spark.read.parquet(out).filter("audit_id = 1").collect()
    assert max(r.seq for r in last) == 9 and {r.closed for r in last if r.of == 1} == {True}


def test_snapshot_then_tail(spark, tmp_path):
    src, live, snapshot, tail = (str(tmp_path / x) for x in ("ev", "live", "snap", "tail"))
    schema = spark.createDataFrame([], EVENT).schema

    def feed(first, last):
        spark.createDataFrame([(i % 3, i, "status_change", "EXTRACTING", 0) for i in range(first, last)], EVENT).write.mode("append").parquet(src)
        events.write_feed(spark.readStream.schema(EVENT).parquet(src), live, str(tmp_path / "cp")).awaitTermination()

    def read():
        rows = events.live_tail(spark, live, schema, snapshot)
        rows.writeStream.format("parquet").option("path", tail).option("checkpointLocation", str(tmp_path / "reader")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.schema(EVENT).parquet(tail).collect())

    feed(0, 10)
    events.take_snapshot(spark, live, schema, snapshot, 2)
    assert sorted(r.seq for r in events.snapshot_events(spark, snapshot, schema).collect()) == [4, 5, 6, 7, 8, 9]
    assert read() == []
    feed(10, 14)
    feed(14, 15)
    assert read() == [10, 11, 12, 13, 14]
    feed(15, 16)
    assert read() == [10, 11, 12, 13, 14, 15]


def test_key_is_in_no_plan(spark):
    spark.conf.set(results.KEY_CONF, "ab" * 32)
    df = spark.createDataFrame([({"[A]": "x"},)], "m map<string,string>")
    sealed = results.seal_maps(df, "m", "b").select("b")
    opened = results.open_maps(sealed, "b", "m")
    assert opened.first().m == {"[A]": "x"}
    for frame in (sealed, opened):
        frame.collect()
        assert "abab" not in frame._jdf.queryExecution().toString().lower()
    spark.conf.unset(results.KEY_CONF)


def test_newest_status_holds(spark, tmp_path):
    base = f"file://{tmp_path}/results"
    audits = lambda *rows: spark.createDataFrame(rows, "audit_id long, status string")
    clauses = spark.createDataFrame([(1, "c1"), (2, "c2")], "audit_id long, clause_id string")
    issues = spark.createDataFrame([(1, "i1"), (2, "i2")], "audit_id long, issue_id string")
    links = spark.createDataFrame([("i1", "c1"), ("i2", "c2")], "issue_id string, clause_id string")
    warnings = spark.createDataFrame([(1, "X", "m")], "audit_id long, code string, message string")
    rest = {"clauses": clauses, "issues": issues, "links": links, "warnings": warnings}
    results.save_results({"audits": audits((1, "EXTRACTING"), (2, "COMPLETE")), **rest}, base)
    assert {r.status for r in results.read_audit(spark, base, [1])["audits"].collect()} == {"EXTRACTING"}
    results.save_results({"audits": audits((1, "COMPLETE")), **rest}, base)
    got = results.read_audit(spark, base, [1, 2])
    assert {(r.audit_id, r.status) for r in got["audits"].collect()} == {(1, "COMPLETE"), (2, "COMPLETE")}
    assert got["clauses"].count() == got["issues"].count() == got["links"].count() == 2
    results.save_results({"audits": audits((1, "COMPLETE")), **rest}, base)
    assert spark.read.parquet(f"{base}/audits").count() == 3


def test_state_is_kept_from_plain_rows():
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.held = []

        def exists(self):
            return bool(self.held)

        def get(self):
            return iter(self.held)

        def put(self, rows):
            self.held = list(rows)

        def update(self, row):
            self.held = [row]

        def clear(self):
            self.held = []

    class Handle:
        def getValueState(self, *args, **kw):
            return State()

        getListState = getValueState

    kept = events.LastEvents(2)
    kept.init(Handle())
    given = [Row(audit_id=7, seq=q, type="status_change", status="EXTRACTING", progress=None, terminal=q == 9) for q in (3, 1, 2, 9)]
    assert [(r.audit_id, r.seq, r.closed) for r in kept.handleInputRows((7,), iter(given[:2]), None)] == [(7, 1, False), (7, 3, False)]
    assert [r.seq for r in kept.handleInputRows((7,), iter(given[2:3]), None)] == [2, 3] and len(kept.events.held) == 2
    assert [(r.seq, r.closed) for r in kept.handleInputRows((7,), iter(given[3:]), None)] == [(3, True), (9, True)] and not kept.events.held
    assert list(kept.handleInputRows((7,), iter(given[:1]), None)) == []


def test_running_sums_and_marked_words(spark):
    from pyspark.sql import functions as F

    from clausewise.functions import spans

    df = spark.createDataFrame([([],), ([4],), (list(range(300)),)], "n array<int>")
    got = {len(r.n): r.s for r in df.select("n", spans.running(F.col("n")).alias("s")).collect()}
    assert got == {k: [sum(range(i)) if k > 1 else 0 for i in range(k)] for k in (0, 1, 300)}
    texts = ["a\u0001b  c\u0001", " one two"]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "audit_id long, page_no int, text string")
    words = {r.page_no: [(w.word, w.off) for w in r.words] for r in page_text.with_words(pages).collect()}
    assert words == {0: [("a\u0001b", 0), ("c\u0001", 5)], 1: [("one", 1), ("two", 5)]}


def test_words_are_placed_for_whole_batches(spark):
    """Every text was walked word by word in interpreted steps that copied what they had so far; nulls, marks and odd blanks stay as they were."""
    texts = ["one two", " a\u00a0b\u2028c  ", "", "  ", None, "x\u0001y \u0001z", "caf\u00e9 \U0001F600\U0001F600 end", " ".join(f"w{i}" for i in range(300))]
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "audit_id long, page_no int, text string")
    placed = page_text.with_words(pages)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    assert placed.schema["words"].dataType.simpleString() == page_text.WORDS
    got = {r.page_no: r.words for r in placed.collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        want = [(m.group(), m.start(), m.start() / len(t), 0.0, m.end() / len(t), 1.0) for m in re.finditer(r"[^\s]+", t)]
        assert [(w.word, w.off, w.box.x0, w.box.y0, w.box.x1, w.box.y1) for w in got[i]] == want, i
