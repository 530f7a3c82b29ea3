"""Growing files as a stream."""

from pyarrow import fs as pafs

from logweave.sources import tail
from logweave.streaming.tables import run_to_table


def test_appended_lines_arrive_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()

    def run():
        return sorted((r.source, r.line) for r in run_to_table(tail.follow_text_logs(spark, str(folder), "*.log"), out, checkpoint).collect())

    (folder / "a.log").write_bytes(b"one\n two \nthr")
    (folder / "skip.txt").write_bytes(b"no\n")
    assert run() == [("a.log", "one"), ("a.log", "two")]
    with open(folder / "a.log", "ab") as f:
        f.write(b"ee\n\xff\xc3\xa9\n")
    (folder / "b.log").write_bytes(b"\nfirst\n")
    want = [("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("a.log", "�é"), ("b.log", ""), ("b.log", "first")]
    assert run() == sorted(want)
    assert run() == sorted(want)  # nothing new
    (folder / "a.log").write_bytes(b"new\n")  # replaced by a shorter file
    assert run() == sorted([*want, ("a.log", "new")])


def test_ranges_cover_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "STEP_BYTES", 7)
    lines = [b"x" * (n * 5 % 23) for n in range(60)]
    path = tmp_path / "f"
    path.write_bytes(b"\n".join(lines) + b"\nrest")
    store, size = pafs.LocalFileSystem(), path.stat().st_size
    end = tail.whole_lines(store, str(path), size)
    assert end == size - 4
    for width in (1, 2, 3, 10, 64, 10_000):
        got = [line for at in range(0, end, width) for line in tail.lines_of(store, tail.Range(str(path), 0, at, min(at + width, end)))]
        assert got == lines
