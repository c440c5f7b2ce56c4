"""Line lists beyond the size that is read as a whole give the entries that whole files give."""

import pytest

from isoline.sources import linelists


def _file(path, n, encoding, end, quoted_break, mark=b""):
    out = ["Line No.,Remarks,Oper. Press,Line No." + end]
    for k in range(n):
        note = f'"wet, ""{k}"" é"' if k % 3 else ""
        if quoted_break and k % 5 == 0:
            note = f'"first{end}{end}second {k}, ""x"" é"'
        out.append(f'6"-GF-{k:05d},{note},{k}.5 barg,{"dup" if k % 2 else ""}' + end)
        if k % 7 == 0:
            out.append(end)
    path.write_bytes(mark + "".join(out).encode(encoding))


@pytest.mark.parametrize("encoding, end, quoted_break, mark", [("utf-8", "\n", False, b"\xef\xbb\xbf"), ("latin-1", "\r\n", False, b""), ("utf-8", "\n", True, b""), ("latin-1", "\r\n", True, b""), ("utf-8", "\r", False, b"")])
def test_blocks_give_what_whole_files_give(spark, tmp_path, monkeypatch, encoding, end, quoted_break, mark):
    for name, n in (("a b%20.csv", 2000), ("c[1].csv", 700)):
        _file(tmp_path / name, n, encoding, end, quoted_break, mark)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    want = linelists.read_csv(spark, f"file://{tmp_path}").collect()
    monkeypatch.setattr(linelists, "WHOLE", 1 << 10)
    spark.conf.set(key, "8192")
    try:
        got = linelists.read_csv(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set(key, old)
    place = lambda r: (r.source, r.row_no)
    assert len(want) == 2700 and sorted(got, key=place) == sorted(want, key=place)


def test_large_files_are_not_held_whole(spark, tmp_path, monkeypatch):
    """Without a block on a file beyond the limit: the plan reads no contents of it."""
    _file(tmp_path / "a.csv", 2000, "utf-8", "\n", False)
    monkeypatch.setattr(linelists, "WHOLE", 1 << 10, raising=False)
    plan = linelists.read_csv(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "Scan text" in plan and "LessThanOrEqual(length,1024)" in plan


def test_large_file_without_line_numbers_fails(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("Remarks\n" + "x\n" * 2000)
    monkeypatch.setattr(linelists, "WHOLE", 1 << 10)
    with pytest.raises(Exception, match="no column of line numbers"):
        linelists.read_csv(spark, f"file://{tmp_path}").collect()
