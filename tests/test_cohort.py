from helpers import log, rows

from trailmark.operators import cohort


def cohort_log(spark):
    return log(
        spark,
        [
            ("2024-01-31 23:59:59.999999", "view", 1),
            ("2024-02-01 00:00:00", "odd", 1),
            ("2025-01-01 00:00:00", "view", 1),
            ("2025-02-01 00:00:00", "view", 1),
            ("2024-01-15 00:00:00", "view", 2),
            ("2024-01-16 00:00:00", "view", 2),
            ("2024-03-01 00:00:00", "view", 3),
            ("2024-03-01 00:00:00", "view", None),
            (None, "view", 4),
        ],
    )


def test_periods_and_labels(spark):
    assigned = cohort.cohort_assign(cohort_log(spark))
    assert rows(assigned) == [
        (1, "2024-01", "2024-01", 0),
        (1, "2024-02", "2024-01", 1),
        (1, "2025-01", "2024-01", 12),
        (1, "2025-02", "2024-01", 13),
        (2, "2024-01", "2024-01", 0),
        (3, "2024-03", "2024-03", 0),
    ]
    assert rows(cohort.cohort_active_users(assigned)) == [
        ("2024-01", 0, 2),
        ("2024-01", 1, 1),
        ("2024-01", 12, 1),
        ("2024-03", 0, 1),
    ]
    assert rows(cohort.cohort_sizes(assigned)) == [("2024-01", 2), ("2024-03", 1)]
    purchases = cohort.cohort_assign(cohort_log(spark), ["odd"])
    assert rows(purchases) == [(1, "2024-02", "2024-02", 0)]


def test_retention_matrix(spark):
    retention = cohort.cohort_retention(cohort.cohort_assign(cohort_log(spark)))
    first, second = retention.collect()
    assert retention.columns == ["cohort", *[f"M{p}" for p in range(13)]]
    assert (first.M0, first.M1, first.M2, first.M12) == (100.0, 50.0, 0.0, 50.0)
    assert (second.cohort, second.M0, second.M1) == ("2024-03", 100.0, 0.0)
    labels = cohort.retention_labels(retention).first()
    assert (labels.M0, labels.M1, labels.M2) == ("100.0%", "50.0%", "")
    assert tuple(cohort.average_first_month(retention).first()) == (25.0, "healthy")
    short = cohort.cohort_retention(cohort.cohort_assign(cohort_log(spark)), 1)
    assert short.columns == ["cohort", "M0", "M1"]
