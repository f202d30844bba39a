import random

import pytest
from helpers import log, rows

from trailmark.operators import activity, cohort, kpis


def random_log(spark, n, months, seed=1):
    rng = random.Random(seed)
    return log(
        spark,
        [
            (f"2023-{rng.choice(months):02}-{rng.randrange(1, 29):02} 10:00:00", "view", rng.randrange(40), rng.choice([None, *range(60)]), 1.0, None, None)
            for _ in range(n)
        ],
    )


def test_counts_of_batches_equal_those_of_the_whole_log(spark, tmp_path, monkeypatch):
    parts = [random_log(spark, 60, [1, 2]), random_log(spark, 80, [3], 2), random_log(spark, 90, [4, 5, 6], 3)]
    store = activity.Activity(spark, f"{tmp_path}/store")
    for part in parts:
        store.add(part)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(activity.active_users(store.days)) == rows(cohort.cohort_active_users(cohort.cohort_assign(whole)))
    want = kpis.compute_kpis(whole).select("unique_users", "unique_products")
    assert rows(activity.distinct_counts(store.days)) == rows(want)
    may = store.days.where("event_day BETWEEN '2023-05-01' AND '2023-05-31'")
    of_may = whole.where("event_time >= '2023-05-01' AND event_time < '2023-06-01'")
    assert rows(activity.distinct_counts(may)) == rows(kpis.compute_kpis(of_may).select("unique_users", "unique_products"))
    # one number for everybody, and a stretch of numbers is of one month
    assert store.numbers.count() == store.numbers.select("kind", "number").distinct().count()
    assert store.days.select("kind", "bucket", "month").distinct().groupBy("kind", "bucket").count().where("count > 1").isEmpty()


def test_a_month_goes_on_in_the_next_batch(spark, tmp_path):
    store = activity.Activity(spark, f"{tmp_path}/store")
    early = log(spark, [("2023-01-05 00:00:00", "view", u, 1, 1.0, None, None) for u in (1, 2)])
    late = log(spark, [("2023-01-09 00:00:00", "view", u, 1, 1.0, None, None) for u in (2, 3)])
    store.add(early)
    store.add(late)
    assert rows(activity.active_users(store.days)) == [("2023-01", 0, 3)]
    assert sorted(r.number for r in store.numbers.where("kind = 'user'").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="too late"):
        store.add(early)
    store.add(late.where("user_id = 0"))
    assert rows(activity.distinct_counts(store.days)) == [(3, 1)]


def test_adding_reads_no_earlier_day(spark, tmp_path):
    store = activity.Activity(spark, f"{tmp_path}/store")
    store.add(random_log(spark, 30, [1]))
    before = {p.name for p in tmp_path.glob("store/days/*/part-*")}
    store.add(random_log(spark, 30, [2]))
    assert before < {p.name for p in tmp_path.glob("store/days/*/part-*")}
