from datetime import datetime

import pytest
from helpers import log, rows

from trailmark.sources import read_events_csv, write_events_csv

HEADER = "\ufeff Event_Time ,EVENT_TYPE,product_id,User_ID, Price,brand,note\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_untidy_file(spark, tmp_path):
    body = (
        '2019-10-01 00:00:00 UTC," View ",1,10,35.79,NA,"a ""quoted"", text"\n'
        "2019-10-01T02:00:00+02:00,CART,2,10,abc,null,x\n"
        "10/01/2019 05:00,purchase,3,11, 7 ,acme,\n"
        "25/12/2019,view,3,11,,acme,\n"
        "2019-10-01T00:00:00Z,view,4,N/A,1e2,acme,\n"
        ",view,4,12,nan,acme,\n"
    )
    frame = read_events_csv(spark, write(tmp_path / "e.csv", HEADER + body))
    assert frame.columns == [
        "event_time", "event_type", "product_id", "user_id", "price", "brand", "note",
    ]
    got = {row.product_id + str(row.user_id): row for row in frame.collect() if row.event_time}
    assert got["110"].event_type == "view" and got["110"].price == 35.79
    assert got["110"].brand is None and got["110"].note == 'a "quoted", text'
    assert got["210"].event_type == "cart" and got["210"].price is None
    assert got["210"].event_time == got["110"].event_time == datetime(2019, 10, 1)
    assert got["4None"].price == 100.0
    times = {row.event_time for row in frame.collect()}
    assert times == {
        None,
        datetime(2019, 10, 1),
        datetime(2019, 10, 1, 5),
        datetime(2019, 12, 25),
    }


def test_a_text_that_is_no_time_fails_the_load(spark, tmp_path):
    path = write(tmp_path / "e.csv", HEADER + "soon,view,1,1,1,b,\n")
    with pytest.raises(Exception, match="Cannot parse 'event_time'"):
        read_events_csv(spark, path).collect()
    assert read_events_csv(spark, path, parse_dates=False).first().event_time == "soon"


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_events_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="empty"):
        read_events_csv(spark, write(tmp_path / "empty.csv", ""))
    with pytest.raises(ValueError, match="more than once"):
        read_events_csv(spark, write(tmp_path / "twice.csv", "price, Price\n1,2\n"))


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "e.csv", 'event_type,note\nview,"two\nlines"\n')
    assert read_events_csv(spark, path).first().note == "two\nlines"
    with pytest.raises(Exception, match="multiline=True"):
        read_events_csv(spark, path, multiline=False).collect()
    inner = write(tmp_path / "f.csv", 'note,event_type\n"two\nlines",view\n')
    assert read_events_csv(spark, inner).count() == 1
    with pytest.raises(Exception, match="multiline=True"):
        read_events_csv(spark, inner, multiline=False).select("event_type").collect()


@pytest.mark.parametrize("multiline", [True, False])
def test_rows_that_do_not_fit_the_header(spark, tmp_path, multiline):
    head = "event_type,product_id,user_id,price\n"
    short = write(tmp_path / "short.csv", head + 'view,1,10,2.5\nview,2\ncart,"a, b"\n')
    got = rows(read_events_csv(spark, short, multiline=multiline))
    assert got == [("cart", "a, b", None, None), ("view", "1", "10", 2.5), ("view", "2", None, None)]
    for extra in ("EXTRA", "", "x,y"):
        long = write(tmp_path / f"long{len(extra)}.csv", head + f"view,1,10,2.5\nview,1,10,6.0,{extra}\n")
        frame = read_events_csv(spark, long, multiline=multiline)
        with pytest.raises(Exception, match="more cells than the 4 columns.*6.0"):
            frame.select("user_id").collect()
        with pytest.raises(Exception, match="more cells"):
            frame.count()


@pytest.mark.parametrize("multiline", [True, False])
def test_files_in_different_column_orders_fail(spark, tmp_path, multiline):
    for first, second in (("a", "b"), ("b", "a")):
        folder = tmp_path / first
        folder.mkdir()
        write(folder / f"{first}.csv", "product_id,user_id\n100,1\n")
        write(folder / f"{second}.csv", "user_id,product_id\n2,200\n")
        with pytest.raises(Exception, match="header does not conform"):
            read_events_csv(spark, str(folder), multiline=multiline).collect()


def test_undecodable_bytes_fail_unless_asked_for(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes(b"event_type,brand\nview,Lanc\xf4me\n")
    with pytest.raises(Exception, match="not UTF-8"):
        read_events_csv(spark, str(path)).select("event_type").collect()
    assert read_events_csv(spark, str(path), errors="replace").first().brand == "Lanc\ufffdme"
    assert read_events_csv(spark, str(path), encoding="ISO-8859-1").first().brand == "Lancôme"
    with pytest.raises(ValueError):
        read_events_csv(spark, str(path), errors="ignore")


def test_sorted_export(spark, tmp_path):
    events = spark.range(100).selectExpr("100 - id AS user_id", "id AS product_id").repartition(4)
    write_events_csv(events, str(tmp_path / "out"), order_by=["user_id"])
    written = [
        int(line.split(",")[0])
        for part in sorted((tmp_path / "out").glob("part-*.csv"))
        for line in part.read_text().splitlines()[1:]
    ]
    assert written == list(range(1, 101))


def test_round_trip(spark, tmp_path):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00.123456", "view", 1, 10, 1.25, 'say "hi", now', "s"),
            ("2024-01-02 00:00:00", "cart", 2, 11, None, None, None),
        ],
    ).repartition(2)
    folder = str(tmp_path / "out")
    write_events_csv(events, folder)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 2
    back = read_events_csv(spark, folder).selectExpr(
        "event_time", "event_type", "CAST(product_id AS bigint)", "CAST(user_id AS bigint)",
        "price", "brand", "user_session",
    )
    assert rows(back) == rows(events)
