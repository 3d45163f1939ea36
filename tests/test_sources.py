import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, rows
from tidemark.sources import store, text


def test_line_numbers_are_exact_when_a_file_is_split(spark, tmp_path):
    big = [f"row {i}," + "x" * (i % 90) for i in range(1, 4001)]
    (tmp_path / "a.csv").write_text("\n".join(big) + "\n")
    (tmp_path / "b.csv").write_text("one\ntwo\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = text.read_lines(spark, str(tmp_path))
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        got = {(r.source_file, r.file_line): r.value for r in lines.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert splits > 5
    want = {("a.csv", i): v for i, v in enumerate(big, 1)} | {("b.csv", 1): "one", ("b.csv", 2): "two"}
    assert got == want


def test_splits_that_move_between_the_passes_stop_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"row {i}\n" for i in range(5000)))
    (tmp_path / "b.csv").write_text("".join(f"row {i}\n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = text.read_lines(spark, str(tmp_path))
    cells = text.read_raw_text(spark, str(tmp_path), ["row 0"], 0, "S1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for df in (lines, cells.select("row 0")):
            with pytest.raises(Exception, match="splits changed"):
                df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_preamble_header_and_blanks(spark, tmp_path):
    (tmp_path / "x1.csv").write_text('sep=,\ntitle\nDate,Cash\n01 Jan 2020,\n"02 Jan 2020",5\n')
    (tmp_path / "x2.csv").write_text("sep=,\ntitle\nDate,Other\n03 Jan 2020,9\n")
    df = text.read_raw_text(spark, str(tmp_path), ["Date", "Cash"], 2, "S1")
    assert rows(df) == [("x1.csv", 4, "01 Jan 2020", "", "S1"), ("x1.csv", 5, "02 Jan 2020", "5", "S1")]


def test_single_byte_encoding_and_empty_to_null(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("name,note\ncafé,“quoted” – dash\nplain,\n".encode("cp1252"))
    kept = text.read_raw_csv(spark, str(tmp_path), ["name", "note"], "S2", "windows-1252")
    assert rows(kept.select("name", "note", "file_line")) == [("café", "“quoted” – dash", 2), ("plain", "", 3)]
    nulls = text.read_raw_csv(spark, str(tmp_path), ["name", "note"], "S2", "windows-1252", empty_to_null=True)
    assert rows(nulls.select("note", "source_id")) == [("“quoted” – dash", "S2"), (None, "S2")]


def test_quoted_cells_are_read_whole_when_a_file_is_split(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    hard = ['say ""hi""', 'a,"b"\n"c",\n\n', '"', '""\n"', "x\r\ny", "\n\nz \"\n", ",", "a\nb,\"c"]
    df = df.unionByName(spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(hard)], "doc_id string, text string"))
    want = {r.doc_id: r.text for r in df.collect()}
    options = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.repartition(3).write.options(**options).csv(str(tmp_path / "w"))
    (tmp_path / "w" / "part-x.csv").write_bytes(b'doc_id,text\r\n\r\np,5" pipe\r\nq,"a\r\nb"\r\n')
    want |= {"p": '5" pipe', "q": "a\r\nb"}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "5000")
    spark.conf.set(keys[1], "0")
    try:
        got = text.read_raw_csv(spark, str(tmp_path / "w"), ["doc_id", "text"], "S2").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert any("\n" in t for t in want.values()) and len(got) == len(want)
    assert {r.doc_id: r.text for r in got} == {k: v or "" for k, v in want.items()}
    files: dict = {}
    for r in got:
        files.setdefault(r.source_file, []).append(r.file_line)
    assert all(sorted(v) == list(range(2, len(v) + 2)) for v in files.values())


def test_a_language_is_written_and_numbered_in_parts(spark, tmp_path, monkeypatch):
    from tidemark.queries import ingest

    texts = [None, "", "a\nb,\"c\"", "one line", "\n\n", '"'] * 50
    rows_in = [(i * 7 % 300, ("en", "fr")[i % 5 == 0], f"s{i % 4}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows_in, "doc_id long, lang string, source string, text string")
    df.repartition(6).write.parquet(str(tmp_path / "in" / "documents.parquet"))
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    monkeypatch.setattr(ingest, "_folder", lambda spark: str(tmp_path / "w"))
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: (r.lang, r.file_line, r.n_chars) for r in ingest.raw_csv_ingest(spark, str(tmp_path / "in")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    seen, want = {}, {}
    for i, lang, _, t in sorted(rows_in, key=lambda x: x[0]):
        seen[lang] = seen.get(lang, 1) + 1
        want[i] = (lang, seen[lang], len(t) if t else None)
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert all(got[i][2] == n for i, (_, _, n) in want.items() if n)
    assert len(list((tmp_path / "w").glob("lang=en/part-*.csv"))) > 2


def test_a_quote_that_is_never_closed_is_named(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "open.csv").write_text('a,b\n1,x\n2,"never\nclosed\n3,z\n')
    with pytest.raises(ValueError, match="record 3 of .*open.csv"):
        text.read_raw_csv(spark, str(tmp_path), ["a", "b"], "S2")
    assert rows(text.read_raw_csv(spark, str(tmp_path / "ok.csv"), ["a", "b"], "S2").select("a", "b")) == [("1", "x\ny")]


def test_longest_file_wins_among_good_headers(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("b", 1)] * 5 + [("c", 0)] * 9, "source_file string, ok int")
    used, report = text.pick_longest_file(df, F.col("ok") == 1)
    assert used.count() == 5
    assert rows(report) == [("a", 3, "ignored"), ("b", 5, "used"), ("c", 9, "other header")]


def test_missing_inputs_are_named(spark):
    with pytest.raises(FileNotFoundError, match="a, b"):
        store.require_tables(["c"], ["b", "a", "c"])
    assert store.stub(spark, "x int, y string").count() == 0


def test_available_tells_missing_empty_and_filled_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    df.write.parquet(str(tmp_path / "full"))
    df.limit(0).write.parquet(str(tmp_path / "empty"))
    (tmp_path / "bare").mkdir()
    df.createOrReplaceTempView("shown")
    tables = {t: str(tmp_path / t) for t in ("full", "empty", "bare", "none")} | {"shown": None, "hidden": None}
    assert store.available(spark, tables) == {"full", "full_data", "empty", "shown", "shown_data"}
    with pytest.raises(FileNotFoundError, match="empty_data, none"):
        store.require_tables(store.available(spark, tables), ["full_data", "empty_data", "none"])


def test_a_failed_rebuild_leaves_the_old_tables(spark, tmp_path):
    folder, df = str(tmp_path / "build"), spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    store.save_tables({"t": df, "gone": df}, folder)
    bad = df.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("broken input"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken input"):
        store.save_tables({"new": df, "t": bad}, folder)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["build"]
    assert sorted(p.name for p in (tmp_path / "build").iterdir()) == ["gone", "t"] and rows(store.load_tables(spark, folder, ["t"])["t"]) == rows(df)
    store.save_tables({"t": store.load_tables(spark, folder, ["t"])["t"].where("k = 'a'")}, folder)
    assert [p.name for p in (tmp_path / "build").iterdir()] == ["t"] and rows(store.load_tables(spark, folder, ["t"])["t"]) == [("a", 1.5)]


def test_store_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    shape = store.save_result(df, "res", str(tmp_path))
    assert shape == {"rows": 2, "columns": 2}
    assert rows(store.load_results(spark, str(tmp_path), {"res": "k string, v double"})["res"]) == rows(df)
    with pytest.raises(ValueError, match="never be exported"):
        store.save_result(df, "res", str(tmp_path), deny=["v"])
    store.save_tables({"t": df}, str(tmp_path / "tabs"), {"t": ["k"]})
    assert rows(store.load_tables(spark, str(tmp_path / "tabs"), ["t"])["t"].select("k", "v")) == rows(df)


def test_texts_survive_the_master_copy(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("text <> ''")
    hard = ["two\nlines", 'say "hi"', '"\n""', "  spaces ", "a\r\nb", 'x\\"', ",\n"]
    df = df.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(hard, 1)], df.schema))
    store.save_result(df, "docs", str(tmp_path))
    schema = {"docs": "doc_id long, text string"}
    assert rows(store.load_results(spark, str(tmp_path), schema)["docs"]) == rows(df)
    some = df.where("doc_id < 0")
    store.export_csv({"docs": some}, f"{tmp_path}/base")
    assert rows(store.read_baseline(spark, f"{tmp_path}/base/docs", schema["docs"])) == rows(some)
    store.export_csv({"docs": some}, f"{tmp_path}/csv")
    with pytest.raises(ValueError, match="7 rows in the master copy"):
        store.load_results(spark, str(tmp_path), schema)


def test_collected_and_baseline_nulls(spark, tmp_path):
    (tmp_path / "facts.csv").write_text('id,v,note\nF1,1.5,"two\nlines"\nF2,,NA\n')
    got = store.read_collected(spark, str(tmp_path), {"facts": "id string, v double, note string"})["facts"]
    assert rows(got) == [("F1", 1.5, "two\nlines"), ("F2", None, "NA")]
    base = store.read_baseline(spark, str(tmp_path / "facts.csv"), "id string, v string, note string")
    assert rows(base.where("id = 'F2'")) == [("F2", None, "NA")]


def test_json_cells_are_typed(spark):
    values = ["", None, "12", "-3", "007", "1.50", "2.0000004", ".5", "1e-3", 'a "b"', "12345678901234567890"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [json.loads(r.c) for r in df.select("i", store.json_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert got == [None, None, 12, -3, "007", 1.5, 2, 0.5, 0.001, 'a "b"', 12345678901234567890]


def test_export_leaves_out_restricted_parts(spark, tmp_path):
    df = spark.createDataFrame([("x", "1", "licensed data"), ("y", "2", "own"), ("z", "3", None)], "k string, gw string, kind string")
    folder = str(tmp_path / "site")
    store.export_datasets([("demand", "cases", df), ("home", "all", df.select("k"))], folder, {"cases": ["gw"]}, {"cases": F.col("kind").contains("licensed")}, ["cash"])
    got = rows(spark.read.text(f"{folder}/page=demand/dataset=cases"))
    assert got == [('["y","own"]',), ('["z",null]',)]
    assert rows(store.read_datasets(spark, folder).where("page = 'home'").select("dataset", "row")) == [("all", '["x"]'), ("all", '["y"]'), ("all", '["z"]')]
