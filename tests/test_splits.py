import csv
import io
import json
import random

import pytest

from tableferry.sources import files, splits


@pytest.fixture
def small_splits(spark):
    """Files of a few kilobytes are read by several tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("700", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_quoted_cells_over_split_ends(spark, tmp_path, small_splits, rows):
    rng = random.Random(1)
    cell = lambda: rng.choice(["plain", "two\nlines", 'a "quote"', "x,y", "", "\n\n", "long " * 60 + "\n" + "text " * 300, 'ends "\n"'])
    want = [[str(i), cell(), cell()] for i in range(120)]
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator="\n").writerows([["id", "one", "two"], *want])
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(text.getvalue(), newline="")
    df = files.read_csv(spark, str(tmp_path), string_columns=("id", "one", "two"))
    assert df.columns == ["id", "one", "two"]
    clean = lambda v: v.strip() or None
    assert rows(df) == sorted([tuple(map(clean, r)) for r in want] * 2, key=lambda r: [(v is not None, str(v)) for v in r])
    found = splits.pieces(spark, str(tmp_path), "\n").select("file", "block").distinct().count()
    assert found > 20


def test_quotes_inside_plain_cells_open_nothing():
    assert not splits.open_after('5" pipe,3', False)
    assert splits.open_after('a,"b', False) and not splits.open_after('b",c', True)
    assert not splits.open_after('"a ""b""",c', False) and splits.open_after('x","y', True)
    assert splits.open_after('""', True) and not splits.open_after('""', False)


def test_ragged_rows_fail_with_quoted_breaks(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n"1\n2",3\n4\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(tmp_path / "r.csv"), string_columns=("a", "b")).collect()
    (tmp_path / "s.csv").write_text('c,b\n"1\n2",3\n')
    with pytest.raises(ValueError, match="headers"):
        files.read_csv(spark, str(tmp_path)).collect()


def records(rng, count):
    text = ["plain", 'q " q', "brace } { ] [", "back\\slash", "line\nend", "\\", 'x\\"}', "ü漢", ""]
    return [{"id": i, "s": rng.choice(text), "inner": {"a": [rng.choice(text)], "b": {"c": i}}, "list": [{"x": 1}, {"x": i}]} for i in range(count)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("shape", ["array", "wrapper"])
def test_json_arrays_are_split(spark, tmp_path, small_splits, indent, shape):
    rng = random.Random(2)
    want = records(rng, 150)
    whole = want if shape == "array" else {"ok": True, "meta": {"q": {"id": -1}, "w": [{"id": -2}]}, "data": want, "after": [{"id": -3}], "n": "x"}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
    assert splits.pieces(spark, str(tmp_path), "}").select("block").distinct().count() > 5
    got = sorted((json.loads(r) for r in files.read_json(spark, str(tmp_path)).toJSON().collect()), key=lambda r: r["id"])
    assert got == want


def test_documents_of_all_kinds_together(spark, tmp_path, rows):
    for name, text in {"a.json": '[{"id":1},\n{"id":2}]', "b.json": '{"id":3,"deep":{"data":[{"id":9}]}}', "c.json": '{"data":[{"id":4}],"ok":1}', "d.json": "[]", "e.json": '{"data":[]}'}.items():
        (tmp_path / name).write_text(text)
    got = files.read_json(spark, str(tmp_path), multiline=True)
    assert rows(got.select("id")) == [(1,), (2,), (3,), (4,)]
    (tmp_path / "f.json").write_text('[{"id":1}, 5]')
    with pytest.raises(Exception, match="not objects"):
        files.read_json(spark, str(tmp_path), multiline=True).collect()


def test_lines_with_a_field_called_data(spark, tmp_path, rows):
    (tmp_path / "l.json").write_text('{"id":1,"data":[{"x":1}]}\n{"id":2,"data":[{"x":2}]}\n{"id":3,"data":[]}\n')
    got = files.read_json(spark, str(tmp_path))
    assert rows(got.select("id")) == [(1,), (2,), (3,)]
    assert set(got.columns) == {"id", "data"}
    wrapped = files.read_json(spark, str(tmp_path), multiline=False, unwrap=True)
    assert rows(wrapped) == [(1,), (2,)]


def test_a_long_line_is_never_read_as_a_line(spark, tmp_path):
    """Lines above 1 MB are skipped by the reader here, as a stand-in for those that no task can hold."""
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"id":{i},"text":"{"x" * 100}"}}' for i in range(90_000)) + "]")
    conf, name = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.linerecordreader.line.maxlength"
    conf.set(name, str(2**20))
    try:
        assert files.read_json(spark, str(tmp_path)).count() == 90_000
    finally:
        conf.unset(name)


KINDS = {
    "array": '[{"a":{"b":1}},\n{"a":2}]',
    "array in a line": '[{"a":{"b":1}},{"a":2}]',
    "wrapper in a line": '{"data":[{"a":1},{"a":2}]}\n\n',
    "wrapper with a long line": '{"data":[{"a":1},{"a":2}\n,{"a":3}]}',
    "wrapper that ends a line in an object": '{"data":[{"a":{"b":1}\n},\n{"a":2}]}',
    "indented": '\n\n {\n "data": [\n  {"a": 1},\n  {"a": 2}\n ]\n}\n',
    "lines": '{"a":{"b":1}}\n{"a":2}\n',
    "lines with blanks": '\ufeff \r\n\r\n{"a":{"b":1},"c":"long, long"} \r\n\r\n  {"a":2}\r\n',
    "one line": '{"a":1,"b":"long, long, long"}\n \n',
    "csv": "\n" + " " * 40 + "a,b\n1,{2}\n",
    "blank": " \n" * 30,
}


@pytest.mark.parametrize("head", [4, 64])
def test_large_files_are_told_as_small_ones(spark, tmp_path, monkeypatch, head):
    for name, text in KINDS.items():
        (tmp_path / f"{name}.json").write_text(text, newline="")
    want = {name: files.file_kinds(spark, str(tmp_path / f"{name}.json")).keys() for name in KINDS}
    monkeypatch.setattr(files, "WHOLE_LINES", 0)
    monkeypatch.setattr(files, "HEAD_BYTES", head)
    assert {name: files.file_kinds(spark, str(tmp_path / f"{name}.json")).keys() for name in KINDS} == want
    together = {k: sorted(p.rsplit("/", 1)[1][:-5] for p in paths) for k, paths in files.file_kinds(spark, str(tmp_path)).items()}
    assert together == {k: sorted(n for n in KINDS if k in want[n]) for k in ("csv", "json", "lines")}


def test_files_of_several_kinds_with_spaces_in_their_names(spark, tmp_path, rows):
    (tmp_path / "a b%.json").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "c d.json").write_text('[{"a":3}]')
    assert rows(files.read_json(spark, str(tmp_path))) == [(1,), (2,), (3,)]
