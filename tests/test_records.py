"""Records that span lines, read by many tasks, against the reader that gives a file to one task."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.sources import read_events_csv
from trailmark.sources.csv import _parse_records
from trailmark.sources.records import ends_inside, read_lines, read_records

NAMES = ["event_type", "note", "x", "brand"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 40 bytes, so that records begin, end and go on in different ones."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def regular(rng, rows, end="\n"):
    cell = ["a", "", "two words", 'say ""x""', "x,y", "line\nbreak", "\n\n", '""\n""', "ü\r\nß", "long " * 20 + "\nend"]
    return end.join(
        ",".join(f'"{c}"' if rng.random() < 0.6 or set(c) & set(',"\n\r') else c for c in rng.choices(cell, k=4))
        for _ in range(rows)
    )


def none_sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, x or "") for x in r])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_equal_those_of_one_task(spark, tmp_path, small_ranges, end):
    rng = random.Random(1)
    for k in range(4):
        path = tmp_path / f"{k}.csv"
        path.write_bytes((",".join(NAMES) + end + regular(rng, 60, end) + (end if k % 2 else "")).encode())
        lines = read_lines(spark, str(path))
        assert lines.select("start").distinct().count() > 10
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        expected = none_sorted(tuple(r) for r in reader.csv(str(path)).collect())
        records = read_records(spark, str(path))
        got = none_sorted(tuple(r)[:-1] for r in _parse_records(records, NAMES, "UTF-8").collect())
        assert got == expected


def test_stray_quotes_as_in_one_task(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    cells = ["a", '5" x', '"q"z', '"l\nm"', '"n,"', '"q" z"', '"two\n\n""lines"""x', 'in"ch"', '"" ']
    for k in range(3):
        path = tmp_path / f"{k}.csv"
        rows = [",".join(rng.choices(cells, k=4)) for _ in range(60)]
        path.write_text("\n".join([",".join(NAMES), *rows]))
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        expected = none_sorted(tuple(r) for r in reader.csv(str(path)).collect())
        got = _parse_records(read_records(spark, str(path)), NAMES, "UTF-8").collect()
        assert none_sorted(tuple(r)[:-1] for r in got) == expected


def test_several_files_headers_and_blank_lines(spark, tmp_path, small_ranges):
    for k in range(3):
        body = f'\n\nevent_type,note\nview,"{k}\n{"z" * 90}\n"\n\ncart,b{k}\n'
        (tmp_path / f"{k}.csv").write_text(body)
    got = read_events_csv(spark, str(tmp_path)).collect()
    assert sorted(r.note for r in got) == sorted([f"{k}\n{'z' * 90}\n" for k in range(3)] + [f"b{k}" for k in range(3)])
    (tmp_path / "3.csv").write_text('note,event_type\n"a\nb",view\n')
    with pytest.raises(Exception, match="header does not conform"):
        read_events_csv(spark, str(tmp_path)).collect()


def test_an_open_quote_fails(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('event_type,note\nview,"open\n' + "view,x\n" * 40)
    with pytest.raises(Exception, match="quote is not closed"):
        read_events_csv(spark, str(tmp_path / "a.csv")).collect()


def test_lines_are_records_without_python_where_none_spans(spark, tmp_path):
    (tmp_path / "a.csv").write_text('event_type,note\nview,5" disk\nview,"quoted, cell"\ncart,"a"b\n')
    frame = read_events_csv(spark, str(tmp_path / "a.csv"))
    assert "MapInArrow" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.note for r in frame.collect()) == ['"a"b', '5" disk', "quoted, cell"]


def test_ranges_that_changed_fail(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('event_type,note\nview,"a\nb"\n' * 1 + 'view,"c\nd"\n' * 30)
    frame = read_events_csv(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "55")
    with pytest.raises(Exception, match="have changed"):
        frame.collect()


def test_lines_as_functions_against_a_character_machine():
    """Quotes open a cell only where it begins; behind a closing quote a cell goes on to the comma."""

    def machine(line, inside):
        state = "quoted" if inside else "begin"
        i = 0
        while i < len(line):
            c = line[i : i + 1]
            if state == "quoted":
                if c == b'"':
                    if line[i + 1 : i + 2] == b'"':
                        i += 1
                    else:
                        state = "plain"
            elif c == b",":
                state = "begin"
            elif state == "begin":
                state = "quoted" if c == b'"' else "plain"
            i += 1
        return state == "quoted"

    rng = random.Random(2)
    for _ in range(20000):
        line = bytes(rng.choices(b'",a', k=rng.randrange(9)))
        for inside in (False, True):
            assert ends_inside(line, inside) == machine(line, inside), (line, inside)


def test_columns_are_text(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes('event_type,brand\nview,"Lanc\xf4me\nx"\n'.encode("latin-1") * 1)
    path = str(tmp_path / "a.csv")
    assert read_events_csv(spark, path, encoding="ISO-8859-1").first().brand == "Lancôme\nx"
    with pytest.raises(Exception, match="not UTF-8"):
        read_events_csv(spark, path).collect()
    assert read_events_csv(spark, path, errors="replace").select(F.col("brand")).first().brand == "Lanc�me\nx"
