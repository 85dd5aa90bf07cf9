import zipfile

import pytest

from tableferry.operators.mirror import mirror
from tableferry.plans.catalog.ingest import workbook_bytes
from tableferry.sources import files
from tableferry.sources.workbook import read_workbooks
from tableferry.streaming.watch import Watch


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


def test_csv_header(spark, tmp_path, rows):
    path = put(tmp_path, "h.csv", ' id , name ,note\n007,"a\nb",\n\n8, c ,"say ""hi"""\n')
    df = files.read_csv(spark, path, multiline=True)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("note", "string")]
    assert rows(df) == [(7, "a\nb", None), (8, "c", 'say "hi"')]


def test_csv_without_header(spark, tmp_path, rows):
    df = files.read_csv(spark, put(tmp_path, "n.csv", "1;x\n2;y\n"), header=False, sep=";")
    assert df.columns == ["column_1", "column_2"] and rows(df) == [(1, "x"), (2, "y")]


def test_ragged(spark, tmp_path, rows):
    text = "a,b\n1,2\n3\n"
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, put(tmp_path, "r.csv", text)).collect()
    given = spark.createDataFrame([], "a bigint, b bigint").schema
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(tmp_path / "r.csv"), schema=given).select("a").collect()
    lines = files.read_file(spark, put(tmp_path, "r.txt", text), "txt")
    assert rows(lines) == [(1, "a,b"), (2, "1,2"), (3, "3")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "r.csv"), mode="PERMISSIVE")
    texts = files.read_file(spark, str(tmp_path / "r.txt"), "txt", string_columns=("a", "b"))
    assert rows(texts) == [(1, "a,b"), (2, "1,2"), (3, "3")]


def test_csv_finds_quoted_line_breaks(spark, tmp_path, rows):
    path = put(tmp_path, "q.csv", 'a,b\n1,"x\ny,z"\n2,w\n')
    assert rows(files.read_csv(spark, path)) == [(1, "x\ny,z"), (2, "w")]


def test_duplicate_headers_fail(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_csv(spark, put(tmp_path, "d.csv", "a, a\n1,2\n"))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {i}\r\n" + ("\n" if i % 3 == 0 else "") for i in range(5000))
    one, two = put(tmp_path, "one.txt", text), put(tmp_path, "two.txt", "x\n\n\ny")
    want = {(i + 1, line.strip()) for i, line in enumerate(text.split("\n")) if line.strip()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = files.read_lines(spark, str(tmp_path))
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r["line_number"], r["content"]) for r in got if r["path"].endswith("one.txt")} == want
    assert {(r["line_number"], r["content"]) for r in got if r["path"].endswith("two.txt")} == {(1, "x"), (4, "y")}
    assert one and two


def test_json_forms(spark, tmp_path, rows):
    big = 9007199254740993
    array = put(tmp_path, "array.json", f'[{{"a":{big}}},{{"b":"x"}}]')
    assert rows(files.read_json(spark, array)) == [(None, "x"), (big, None)]
    assert rows(files.read_json(spark, put(tmp_path, "single.json", '{"a":1}'))) == [(1,)]
    wrapper = put(tmp_path, "wrapper.json", '{"data":[{"a":1},{"a":2}],"ok":true}')
    assert rows(files.read_json(spark, wrapper)) == [(1,), (2,)]
    plain = put(tmp_path, "plain.json", '{"data":"text"}')
    assert rows(files.read_json(spark, plain)) == [("text",)]


def test_json_lines_and_documents_are_told_apart(spark, tmp_path, rows):
    lines = "".join(f'{{"a":{i}}}\n' for i in range(5))
    put(tmp_path / "lines", "one.jsonl", "\n" + lines)
    assert rows(files.read_json(spark, str(tmp_path / "lines"))) == [(i,) for i in range(5)]
    assert rows(files.read_file(spark, str(tmp_path / "lines"))) == [(i,) for i in range(5)]
    put(tmp_path / "lines", "two.json", '{\n"a": 9\n}')
    assert rows(files.read_file(spark, str(tmp_path / "lines"))) == [(i,) for i in (0, 1, 2, 3, 4, 9)]
    put(tmp_path / "lines", "three", "a\n1\n")
    with pytest.raises(ValueError):
        files.read_file(spark, str(tmp_path / "lines"))
    assert files.read_json(spark, put(tmp_path, "empty.json", '{"data":[]}')).count() == 0


def test_sniff_and_dispatch(spark, tmp_path, rows):
    assert rows(files.read_file(spark, put(tmp_path, "a", ' \n[{"a":1}]'))) == [(1,)]
    assert rows(files.read_file(spark, put(tmp_path, "b", "a\n1\n"))) == [(1,)]
    with pytest.raises(ValueError):
        files.read_file(spark, str(tmp_path / "b"), "xml")


def test_selection(spark, tmp_path):
    for name in ("a/x.csv", "a/b/x.csv", "b/y.csv", "y.txt"):
        put(tmp_path, name, "1")
    root = str(tmp_path)

    def keys(df):
        return sorted(r["key"] for r in df.collect())

    assert keys(files.list_objects(spark, root, pattern="*.csv")) == ["a/b/x.csv", "a/x.csv", "b/y.csv"]
    assert keys(files.list_objects(spark, root, prefix="a/", pattern="?.csv")) == ["a/b/x.csv", "a/x.csv"]
    assert keys(files.select_files(spark, root, "*.csv")) == ["a/b/x.csv"]
    assert keys(files.select_files(spark, root, "*.txt", recursive=False)) == ["y.txt"]
    with pytest.raises(FileNotFoundError):
        files.select_files(spark, root, "*.csv", recursive=False)


def test_hidden_and_empty_objects_are_objects(spark, tmp_path):
    names = ["a.txt", "_b.txt", ".c.txt", "_dir/d.txt", "sub/empty.txt", "sub/e f%20.txt"]
    for name in names:
        put(tmp_path / "in", name, "" if "empty" in name else name)
    listed = files.list_objects(spark, str(tmp_path / "in"))
    assert sorted(r["key"] for r in listed.collect()) == sorted(names)
    result = mirror(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert all(r["error"] is None for r in result) and len(result) == len(names)
    assert all((tmp_path / "out" / n).read_text() == ("" if "empty" in n else n) for n in names)


def test_watch_tries_failed_copies_again(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.txt", "a")
    put(tmp_path / "out/a.txt", "blocks", "the name is a folder")
    watch = Watch(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r["error"] is None for r in watch.poll().collect()] == [False]
    again = watch.poll().collect()
    assert [(r["key"], r["error"] is None) for r in again] == [("a.txt", False)]


def test_workbooks(spark, tmp_path, rows):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes([" id ", "name"], iter([(1, "x"), (2, "ü & <b>")])))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(["id", "extra"], iter([(3, "e")])))
    df = read_workbooks(spark, str(tmp_path))
    assert df.columns == ["extra", "id", "name"]
    assert rows(df) == [(None, "1", "x"), (None, "2", "ü & <b>"), ("e", "3", None)]
    bare = read_workbooks(spark, str(tmp_path / "b.xlsx"), header=False)
    assert bare.columns == ["column_1", "column_2"] and bare.count() == 2


def test_workbook_with_shared_strings_and_gaps(spark, tmp_path, rows):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    (tmp_path / "s.xlsx").write_bytes(workbook_bytes(["id"], iter([])))
    with zipfile.ZipFile(tmp_path / "s.xlsx") as book:
        parts = {n: book.read(n) for n in book.namelist()}
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}"><si><t>h1</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>'
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>h3</t>'
        '</is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)
    df = read_workbooks(spark, str(tmp_path / "s.xlsx"))
    assert df.columns == ["h1", "h3"] and rows(df) == [("ab", "TRUE")]
