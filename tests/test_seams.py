from docloom.operators import recognise
from docloom.sources import package as packages
from tests.test_core import BOOK, package


def test_recognition_asks_once_and_keeps_what_fails(spark):
    asked = spark.sparkContext.accumulator(0)

    def engine(data, kind, prompt):
        asked.add(1)
        if data == b"bad":
            raise RuntimeError
        return f"{data.decode()} {kind}"

    texts = spark.createDataFrame([(1, "a [Image:x.png] b [Image: y.png ] [Image:none]"), (2, "[Image:x.png]"), (3, None), (4, "plain"), (4, "plain"), (None, "[Image:bad]")], "id long, text string")
    images = spark.createDataFrame([("x.png", b"X", "image/png"), ("x.png", b"X", "image/png"), ("y.png", b"Y", None), ("bad", b"bad", "image/png"), ("unused", b"u", "image/png")], "path string, content binary, kind string")
    got = {r.id: r.text for r in recognise.recognised(texts, images, engine, "id").collect()}
    assert got == {1: "a [Figure:X image/png] b [Figure:Y image/png] [Image:none]", 2: "[Figure:X image/png]", 3: None, 4: "plain", None: "[Image:bad]"}
    assert asked.value == 3


def test_packages_as_tables(spark):
    page = b'<img src="data:image/png;base64,aGVsbG8="><img src="data:image/png;base64,aGVsbG8=">'
    df = spark.createDataFrame([(1, package(BOOK)), (2, b"no zip"), (3, None), (4, package({"word/media/a.png": b"hello"})), (5, page)], "id long, content binary")
    assert {(r.sheet, r.row, r.col, r.value) for r in packages.cells(df, "id").collect()} == {("One", 1, 1, "Name"), ("One", 1, 2, "Q|1"), ("One", 2, 1, "3"), ("One", 2, 2, "TRUE")}
    assert packages.parts(df, "id").where("id = 1").count() == len(BOOK)
    assert [(r.source, r.id, r.target) for r in packages.relations(df.withColumnRenamed("id", "k"), "k").collect()] == [("xl/workbook.xml", "r1", "xl/worksheets/sheet1.xml")]
    assert sorted((r.id, r.bytes) for r in packages.images(df, "id").collect()) == [(4, b"hello"), (5, b"hello")]
    assert packages.cells(df.limit(0), "id").count() == 0


def test_why_an_engine_failed_and_progress(spark):
    def engine(data, kind, prompt):
        if data == b"bad":
            raise ValueError("broken")
        return "" if data == b"blank" else "text"

    images = spark.createDataFrame([("a", b"ok", None), ("b", b"bad", None), ("c", b"blank", None)], "path string, content binary, kind string")
    progress = recognise.Progress(spark)
    got = {r.path: (r.said, r.error) for r in recognise.asked(images, engine, progress=progress).collect()}
    assert got == {"a": ("[Figure:text]", None), "b": (None, "ValueError: broken"), "c": (None, "no text")} and repr(progress) == "1 of 3 recognised, 2 failed"


def test_limits_are_told_and_kept():
    from docloom import engine
    from docloom.config import Settings

    few = Settings(most_rows=2, most_columns=2, most_values=2, most_bytes=1000)
    got, _ = engine.read_one(b"a,b,c\n1,2,3\n4,5,6\n", "csv", few)
    assert got.warnings == ["rows beyond 2 or columns beyond 2 left out"] and [len(r) for r in got.tables[0]] == [2, 2]
    got, _ = engine.read_one(b'{"a": 1, "b": 2, "c": 3}', "json", few)
    assert got.warnings == ["values beyond 2 left out"] and got.text == "a: 1\nb: 2\n..."
    assert engine.read_one(b"x" * 1001, "txt", few)[1].startswith("E_VALUE") and engine.read_one(b"x" * 1001, "txt", Settings(most_bytes=None))[1] is None
    wide = ",".join(map(str, range(1500)))
    assert len(engine.read_one(f"{wide}\n{wide}".encode(), "csv", Settings(most_columns=None))[0].tables[0][0]) == 1500
    assert Settings.from_dict(few.to_dict()) == few


def test_a_reader_that_takes_too_long():
    import time

    from docloom import engine
    from docloom.config import Settings

    engine.register("slow", lambda data, ext: (time.sleep(2), engine.Read("late"))[1])
    try:
        assert engine.read_one(b"x", "slow", Settings(seconds=0.1)) == (None, "E_TIMEOUT: more than 0.1 s")
        assert engine.read_one(b"a", "txt", Settings(seconds=5))[0].text == "a"
    finally:
        engine.unregister("slow")


def test_readers_of_installed_packages(tmp_path, monkeypatch):
    from docloom import engine

    (tmp_path / "plug.py").write_text("from docloom.engine import Read\npair = ('plugged', lambda data, ext: Read(data.decode().upper()))\nbroken = 5\n")
    info = tmp_path / "plug-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: plug\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[docloom.readers]\ngood = plug:pair\nbad = plug:broken\nnone = nowhere:x\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        assert engine.discover() == ["good"] and engine.read_one(b"abc", "plugged")[0].text == "ABC"
    finally:
        engine.unregister("plugged")


def test_caches(tmp_path):
    from docloom import caching, engine
    from docloom.config import Settings

    calls = []
    engine.register("counted", lambda data, ext: (calls.append(1), engine.Read(data.decode(), {"title": "T"}, [[[engine.Cell("x", 2, 1, True)]]], ["w"], "utf-8"))[1])
    try:
        for cache in (caching.Memory(2), caching.Folder(str(tmp_path / "kept"))):
            calls.clear()
            first, again = (caching.read_cached(b"a", "counted", cache)[0] for _ in range(2))
            assert first == again and again.tables[0][0][0].rows == 2 and len(calls) == 1
            caching.read_cached(b"a", "counted", cache, Settings(most_rows=1))
            assert len(calls) == 2 and caching.read_cached(b"a", "none", cache)[1].startswith("E_UNSUPPORTED")
            cache.put(caching.key_of(b"a", "counted", Settings()), "no result")
            assert caching.read_cached(b"a", "counted", cache)[0] == first and len(calls) == 3
        small = caching.Memory(1)
        small.put("a", "1"), small.put("b", "2")
        assert small.get("a") is None and small.get("b") == "2"
    finally:
        engine.unregister("counted")


def test_results_as_json_and_rows_of_a_loader(spark):
    from docloom import engine
    from docloom.config import Settings

    files = spark.createDataFrame([("/d/a.csv", "csv", b"n,v\nx,1"), ("/d/b.txt", "txt", b"[Page Number: 1]\nfirst\n[Page Number: 2]\nsecond page"), ("/d/c.zzz", "zzz", b"?"), ("/d/e.txt", "txt", None)], "path string, extension string, content binary")
    got = engine.extracted(files, ["path"])
    back = engine.of_json(engine.as_json(got, ["path"]), ["path"])
    assert back.schema.simpleString() == got.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, got.collect()))
    whole = {r.metadata["file_name"]: r for r in engine.loaded(files, more={"owner": "me"}).collect()}
    assert set(whole) == {"a.csv", "b.txt"} and whole["b.txt"].metadata == {"source": "/d/b.txt", "file_name": "b.txt", "file_extension": "txt", "owner": "me"}
    cut = engine.loaded(files, settings=Settings().with_chunking(chunk_size=25, chunk_overlap=0), chunked=True).where("metadata['file_name'] = 'b.txt'").collect()
    assert [r.metadata["page_number"] for r in sorted(cut, key=lambda r: int(r.metadata["chunk_index"]))] == ["1", "2"]


def test_kept_results_are_read_once(spark, tmp_path):
    from docloom import engine

    files = spark.createDataFrame([(1, "txt", b"a"), (2, "txt", b"a"), (3, "txt", b"b")], "id long, extension string, content binary")
    kept = str(tmp_path / "kept")
    for _ in range(2):
        assert sorted((r.id, r.text) for r in engine.extracted_once(files, ["id"], kept).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    assert spark.read.parquet(kept).count() == 2
    spark.read.parquet(kept).write.mode("append").parquet(kept)  # as if two writers had met
    assert engine.extracted_once(files, ["id"], kept).count() == 3


def test_files_written_stay_below_their_folder(spark, tmp_path):
    import pytest

    from docloom import engine

    chunks = spark.createDataFrame([("k", 0, "one", 4), ("k", 1, "two", None)], "doc string, no int, chunk string, page int")
    for _ in range(2):
        engine.write_chunks(chunks, "doc", str(tmp_path / "c"), header=True, page="page")
    assert (tmp_path / "c" / "doc=k" / "chunk_0001.md").read_text() == "<!-- chunk_index: 0 -->\n<!-- page: 4 -->\n---\n\none" and (tmp_path / "c" / "doc=k" / "chunk_0002.md").read_text() == "<!-- chunk_index: 1 -->\n---\n\ntwo"
    images = spark.createDataFrame([(1, "a.png", b"x")], "id long, name string, bytes binary")
    stored = engine.store_images(images, f"file://{tmp_path}/i", "id").first()
    assert stored.tag == f"[Image:{tmp_path}/i/a.png]" and (tmp_path / "i" / "a.png").read_bytes() == b"x"
    for bad in ("..", "a/../../b", "", "a\\b"):
        with pytest.raises(ValueError):
            engine.safe_name(bad)


def test_sql_functions_and_source(spark, tmp_path):
    from docloom import sql

    sql.register(spark)
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text('{"k": [1]}')
    (tmp_path / "c.zzz").write_text("?")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in spark.read.format("documents").load(str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", None), "b.json": ("k[0]: 1", None), "c.zzz": (None, "E_UNSUPPORTED_FORMAT: zzz")}
    one = spark.sql("SELECT doc_text(cast('x' AS binary), 'txt') AS t, html_text('<h1>a</h1>') AS h, json_paths('{\"a\": 1}') AS j, html_tables('<table><tr><td>1</td></tr></table>') AS x, html_text(NULL) AS n").first()
    assert (one.t, one.h, one.j, one.x, one.n) == ("x", "# a", "a: 1", [[["1"]]], None)
    rows = spark.sql("SELECT no, strategy, chunk FROM doc_chunks('one two three', '', 5, 0)").collect()
    assert [r.chunk for r in rows] == ["one", "two", "three"] and rows[0].strategy == "plain"
