import datetime
import random
from decimal import Decimal

from vaultlens.operators import derive

SCHEMA = "deal_id int, subject string, metric string, value decimal(24,6), period_type string, period_start date, period_end date, as_of date, confidence double, seq int"


def test_runway_equals_the_plain_rule(spark):
    """Overlapping, nested, open and equal periods, burns of zero, dates without any burn."""
    rng, rows = random.Random(8), []
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(200))
    for seq in range(600):
        subject, value = f"s{rng.randrange(12)}", Decimal(rng.choice([0, -5, 10, 20, 40, 80]))
        if rng.random() < 0.5:
            at = day()
            rows.append((1, subject, "cash_balance", rng.choice([value, None]), "point", None, at, rng.choice([at, None]), 0.9, seq))
        else:
            end = day()
            start = rng.choice([None, end - datetime.timedelta(days=rng.randrange(60)), end + datetime.timedelta(days=3)])
            rows.append((1, subject, "net_burn", value, "month", start, rng.choice([end, end, end, None]), None, 0.9, seq))
    want = set()
    for r in rows:
        at = r[7] or r[6]
        if r[2] != "cash_balance" or r[3] is None or at is None:
            continue
        burns = [b for b in rows if b[2] == "net_burn" and b[1] == r[1] and b[6] is not None]
        inside = sorted((b for b in burns if b[5] is not None and b[5] <= at <= b[6]), key=lambda b: b[9])
        ended = sorted((b for b in burns if b[6] <= at), key=lambda b: (-b[6].toordinal(), b[9]))
        best = (inside or ended or [None])[0]
        if best is not None and best[3] > 0:
            want.add((r[1], at, r[9], best[9]))
    got = derive.runway(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r["subject"], r["as_of"], r["cash_seq"], r["burn_seq"]) for r in got} == want and len(got) == len(want) > 80
