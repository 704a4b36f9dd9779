import datetime as dt

from casegrain.sources import readers
from casegrain.streaming import streams


def test_text_and_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.TXT.bak").write_text("no")
    (tmp_path / "c.PDF").write_bytes(b"x" * 60 + b"\f" + b"y")
    (tmp_path / "d.png").write_bytes(b"!")
    assert [(r.case_id, r.text) for r in readers.text_folder(spark, str(tmp_path)).collect()] == [("a", "one\ntwo")]
    files = readers.binary_folder(spark, str(tmp_path))
    assert {r.doc_id for r in files.collect()} == {"c", "d"}

    def reader(content, form):
        if content == b"!":
            raise ValueError("empty")
        return content.decode().split("\f")

    pages = readers.read_pages(files, reader)
    assert {(r.doc_id, r.page_num, r.mode) for r in pages.collect()} == {("c", 1, "text"), ("c", 2, "image"), ("d", None, None)}
    assert readers.join_pages(pages).first().text == "x" * 60 + "\fy"


def test_feedback_log(spark, tmp_path):
    p = str(tmp_path / "log")
    readers.append_feedback(spark.createDataFrame([("q", "c", 1, "t", "s")], readers.FEEDBACK), p)
    (tmp_path / "log" / "bad.json").write_text("{broken\n")
    assert readers.feedback_log(spark, p).count() == 1


def test_vectors_and_embed(spark, tmp_path):
    df = spark.createDataFrame([("a", "some text")], "case_id string, text string")
    made = readers.embed(df, lambda xs: [[float(len(x)), 1.0] for x in xs])
    readers.save_vectors(made, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).first().embedding == [9.0, 1.0]
    try:
        readers.save_vectors(made, str(tmp_path / "w"), 3)
        raise AssertionError("a wrong dimension must fail")
    except Exception as e:
        assert "dimension" in str(e)


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 5)
    rows = [(t, 1, "view", 1.0), (t + dt.timedelta(minutes=10), 1, "view", 2.0), (t + dt.timedelta(hours=2), 2, "error", None)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    s = lambda: streams.table_stream(spark, str(tmp_path), "events")
    got = streams.run_once(streams.event_windows(s())).collect()
    assert sorted((r.event_type, r.n, r.total) for r in got) == [("error", 1, None), ("view", 2, 3.0)]
    assert sorted((r.user_id, r.n) for r in streams.run_once(streams.event_sessions(s())).collect()) == [(1, 2), (2, 1)]
    turns = [("c", 1, "a"), ("c", 2, ""), ("d", 1, None)]
    spark.createDataFrame(turns, "conv string, turn int, domain string").write.parquet(str(tmp_path / "turns.parquet"))
    state = streams.run_once(streams.conversation_state(streams.table_stream(spark, str(tmp_path), "turns"), "conv", "turn", ["domain"]), "update")
    assert {(r.conv, r.turn_count, r.domain) for r in state.collect()} == {("c", 2, "a"), ("d", 1, None)}
