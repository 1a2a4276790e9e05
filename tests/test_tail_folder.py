"""Growing files of a folder, cut into pieces and replaced."""

import os

from tidewatch.sources.tail import FolderReader, identity, line_start

HEAD = "TimeStamp,AI0_Vibration,AI1_Vibration,AI2_Current\n"


def rows(reader, start, end):
    return [r[0] for p in reader.partitions(start, end) for r in reader.read(p)]


def test_lines_are_read_once_however_files_grow_and_pieces_are_cut(tmp_path, monkeypatch):
    monkeypatch.setattr(FolderReader, "MAX_PART", 37)
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    r = FolderReader(str(tmp_path / "*.csv"))
    assert r.latestOffset() == {} == r.initialOffset()
    a.write_bytes("﻿".encode() + HEAD.encode() + "".join(f"a{i},1,2,3\n" for i in range(30)).encode() + b"a30,7")
    first = r.latestOffset()
    assert rows(r, {}, first) == [f"a{i}" for i in range(30)]
    with a.open("ab") as f:
        f.write(b",8,9\nbad,1\na31,4,5,6\r\n")
    b.write_text(HEAD + "b0,1,1,1\n")
    second = r.latestOffset()
    assert rows(r, first, second) == ["a30", "a31", "b0"] and rows(r, second, second) == []
    b.write_text(HEAD)  # got shorter
    third = r.latestOffset()
    assert rows(r, second, third) == []
    os.remove(a)
    a.write_text(HEAD.replace("AI2", "AI3") + "".join(f"n{i},1,2,3\n" for i in range(90)))  # another file, and a longer one
    fourth = r.latestOffset()
    assert third[str(a)][0] != identity(str(a)) and rows(r, third, fourth) == [f"n{i}" for i in range(90)]


def test_lines_longer_than_a_step(tmp_path):
    p = tmp_path / "x"
    p.write_bytes(b"ab\n" + b"y" * 500 + b"\nz\n")
    with p.open("rb") as f:
        assert [line_start(f, i, 7) for i in (0, 1, 3, 4, 400, 503, 504, 506)] == [0, 0, 3, 3, 3, 3, 504, 506]
