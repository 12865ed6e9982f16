"""CSV by blocks against the reader that takes a file as a whole."""

import random

import pytest

from textloom.sources import readers
from textloom.sources.csv_blocks import inside_after, records


def random_cell(draw):
    kind = draw.random()
    text = "".join(draw.choice(["a", "b c", ",", '"', "\n", "é", ""]) for _ in range(draw.randint(0, 7)))
    if kind < 0.6 or any(c in text for c in '\n,') or text.startswith('"'):
        return '"' + text.replace('"', '""') + '"'
    return text


def write(path, draw, rows, eol="\n"):
    lines = ["prompt,completion,extra"]
    for _ in range(rows):
        cells = [random_cell(draw) for _ in range(draw.choice([2, 3, 3, 3, 4]))]
        lines.append(",".join(cells))
        if draw.random() < 0.05:
            lines.append("")
    # Breaks inside cells are those of the file too.
    text = "\n".join(lines) + draw.choice(["", "\n"])
    path.write_bytes(text.replace("\n", eol).encode())


def as_rows(df):
    return sorted(((r.source, r.line_idx, r.prompt, r.completion, r.extra) for r in df.collect()), key=repr)


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("seed,eol,broadcast", [(1, "\n", 100_000), (2, "\n", 0), (3, "\r\n", 100_000)])
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_blocks, monkeypatch, seed, eol, broadcast):
    monkeypatch.setattr("textloom.sources.csv_blocks._BROADCAST_BLOCKS", broadcast)
    draw = random.Random(seed)
    for name in ("a", "b", "c"):
        write(tmp_path / f"{name}.csv", draw, draw.choice([1, 60, 120]), eol)
    path = f"{tmp_path}/*.csv"
    found = readers.read_csv_rows(spark, path)
    blocks = {(r.source, r.file_block_start) for r in spark.read.text(path).selectExpr("_metadata.file_path source", "_metadata.file_block_start").collect()}
    assert len(blocks) > 10
    assert as_rows(found) == as_rows(readers.number_csv_rows(readers.read_csv(spark, path)))


def test_a_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {i}, with ""quotes""' for i in range(200))
    (tmp_path / "x.csv").write_text(f'prompt,completion,extra\n1,"{long}",z\n2,plain 5" disk,"y"\n', encoding="utf-8")
    rows = as_rows(readers.read_csv_rows(spark, str(tmp_path / "x.csv")))
    assert [r[1:] for r in rows] == [(0, "1", long.replace('""', '"'), "z"), (1, "2", 'plain 5" disk', "y")]
    assert records(spark, str(tmp_path / "x.csv")).count() == 3


def test_states():
    assert [inside_after(x, False, ",") for x in ('a"b', '"a', '"a""', '"a"', 'x,"y', '"a"b"c,d', "", '""', '"""')] == [
        False, True, True, False, True, False, False, False, True]
    assert [inside_after(x, True, ",") for x in ("a", 'a"', 'a""', '",', '","', '""",x')] == [True, False, True, False, True, False]


def test_other_separators_and_charsets(spark, tmp_path):
    (tmp_path / "s.csv").write_text('prompt;completion\n"a;\nb";c\n', encoding="utf-8")
    assert [(r.line_idx, r.prompt, r.completion) for r in readers.read_csv_rows(spark, str(tmp_path / "s.csv"), ";").collect()] == [(0, "a;\nb", "c")]
    (tmp_path / "l.csv").write_bytes('prompt,completion\n"é\nx",y\n'.encode("latin-1"))
    assert [(r.line_idx, r.prompt) for r in readers.read_csv_rows(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()] == [(0, "é\nx")]
    (tmp_path / "h.csv").write_text("prompt,completion\n", encoding="utf-8")
    assert readers.read_csv_rows(spark, str(tmp_path / "h.csv")).collect() == []
