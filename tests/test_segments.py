from helpers import log, rows

from trailmark.operators import segments, sessions


def segment_log(spark):
    return log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", 1, 1, 1.0),
            ("2024-01-01 00:00:10", "purchase", 1, 1, 2.0),
            ("2024-01-01 02:00:00", "cart", 1, 1, None),
            ("2024-01-01 00:00:00", "cart", 2, 1, 5.0),
            ("2024-01-01 00:00:00", "remove_from_cart", 3, 1, 5.0),
            ("2024-01-01 00:00:00", None, 3, 1, None),
            ("2024-01-01 00:00:00", "purchase", None, 1, 5.0),
        ],
    )


EXPECTED = [
    (1, 3, 1, 1, 1, 1.5, 2, 5.0, "Purchaser"),
    (2, 1, 0, 1, 0, 5.0, 1, 0.0, "Cart Abandoner"),
    (3, 1, 0, 0, 0, 5.0, 1, 0.0, "Browser"),
]


def test_segments_from_tagged_and_from_raw_events(spark):
    tagged = sessions.assign_sessions(segment_log(spark), 30, use_existing=False)
    assert rows(segments.segment_users(tagged)) == EXPECTED
    direct = segments.segment_users_by_session(segment_log(spark), 30, use_existing=False)
    assert rows(direct) == EXPECTED


def test_segments_without_session_columns(spark):
    plain = rows(segments.segment_users(segment_log(spark)))
    assert [(r[0], r[6], r[7]) for r in plain] == [(1, 3, 0.0), (2, 1, 0.0), (3, 1, 0.0)]
    named = segment_log(spark).selectExpr("*", "'s' AS session_id")
    assert [r[6:8] for r in rows(segments.segment_users(named))] == [(1, 0.0)] * 3


def test_shared_given_session_counts_its_whole_span_for_each_user(spark):
    events = log(
        spark,
        [
            ("2024-01-01 00:00:00", "view", 1, 1, 1.0, "b", "s"),
            ("2024-01-01 00:00:10", "view", 2, 1, 1.0, "b", "s"),
        ],
    )
    direct = rows(segments.segment_users_by_session(events))
    assert [r[7] for r in direct] == [10.0, 10.0]
    assert rows(segments.segment_users(sessions.assign_sessions(events))) == direct


def test_summaries(spark):
    table = segments.segment_users_by_session(segment_log(spark), 30, use_existing=False)
    assert {r[0]: r[1:] for r in rows(segments.segment_distribution(table))} == {
        "Purchaser": (1, 33.3),
        "Cart Abandoner": (1, 33.3),
        "Browser": (1, 33.3),
    }
    assert rows(segments.segment_summary(table))[2] == ("Purchaser", 1, 3.0, 1.0, 1.0, 1.0, 1.5, 5.0)
    assert rows(segments.segment_metrics(table))[2] == ("Purchaser", 3.0, 1.0, 1.5, 2.0)
    assert rows(segments.cart_abandoners(segment_log(spark))) == [(2,)]
