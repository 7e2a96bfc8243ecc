import io

import pandas as pd
import pytest

from featurescape.sources import records, tables


def _read(spark, tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text)
    return tables.read_table(spark, f"{tmp_path}/{name}")


def _rows(text):
    n = 0
    lines = []
    for i in range(400):
        note = [f"plain {i}", f'"first {i}\n\nlast, ""{i}"""', f'"one\nline {i}"', f'x"{i}', '""', f'"a{i}, b"'][i % 6]
        lines.append(f"{i},{note},{i * 0.5}")
        n += 1
    return text + "\n".join(lines) + "\n"


@pytest.mark.parametrize("split", [None, 700])
def test_quoted_line_ends_across_splits(spark, tmp_path, split):
    text = _rows("ID,note,x\n")
    want = pd.read_csv(io.StringIO(text), keep_default_na=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = _read(spark, tmp_path, text).orderBy("_ord").toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["ID"].tolist() == [str(i) for i in want["ID"]]
    assert [v or "" for v in got["note"]] == want["note"].fillna("").tolist()
    assert got["x"].tolist() == want["x"].tolist()
    assert got["_ord"].tolist() == list(range(1, 401))


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a",b', False, False), ('"a","b"', False, False),
    ('x"y,"z', True, True), ('""', False, True), ('"', True, False), ('","', False, True), ('a"",b', False, True), ("", False, True)])
def test_what_a_line_does_to_the_state(line, outside, inside):
    assert records.ends_inside(line, False) == outside
    assert records.ends_inside(line, True) == inside


def test_open_quote_at_the_end_raises(spark, tmp_path):
    with pytest.raises(records.OpenQuoteError):
        _read(spark, tmp_path, 'ID,a\n1,"x\n2,y\n')


@pytest.mark.parametrize("text", ["ID,a\n1,2\n3,4,5\n", 'ID,a\n1,"2\n2"\n3,4,5\n'])
def test_rows_longer_than_the_header_raise(spark, tmp_path, text):
    with pytest.raises(tables.RaggedRowError):
        _read(spark, tmp_path, text)
    with pytest.raises(pd.errors.ParserError):
        pd.read_csv(io.StringIO(text))


def test_short_rows_are_filled(spark, tmp_path):
    got = _read(spark, tmp_path, "ID,a,b\n1,2,3\n2\n").orderBy("ID").collect()
    assert [(r.ID, r.a, r.b) for r in got] == [("1", 2.0, 3.0), ("2", None, None)]


def test_integers_beyond_64_bits(spark, tmp_path):
    got = _read(spark, tmp_path, "ID,u,s,w,m\n1,9223372036854775808,9223372036854775808,99999999999999999999,9223372036854775808\n"
                                 "2,1,-1,1,\n")
    assert [t for _, t in got.dtypes[1:5]] == ["decimal(20,0)", "string", "string", "string"]
    assert sorted(int(r.u) for r in got.collect()) == [1, 9223372036854775808]
    assert sorted(r.w for r in got.collect()) == ["1", "99999999999999999999"]
