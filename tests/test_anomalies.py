import random

from pyspark.sql import functions as F

from gridloom.functions.timeparse import DAY, HOUR
from gridloom.operators.anomalies import Limits, implausible, stuck
from gridloom.operators.dedup import with_identity

READ = "log_partition int, log_offset bigint, event_id string, meter_id string, household_id string, power_consumption_kwh double, solar_generation_kwh double, at bigint"
HOME = "meter_id string, household_id string, has_solar boolean, solar_capacity_kw double"


class Meters:
    def __init__(self):
        self.rows, self.rng = [], random.Random(4)

    def add(self, meter, at, use, sun=0.0, event_id=None, household="h"):
        n = len(self.rows)
        self.rows.append((0, n, event_id or f"{n:032x}", meter, household + (meter or ""), use, sun, at))
        return n

    def usual(self, meter, hours=24 * 14, level=lambda h: 1.0, **kw):
        return [self.add(meter, h * HOUR + self.rng.randrange(HOUR), round(level(h) * self.rng.uniform(0.5, 1.5), 6), **kw) for h in range(hours)]

    def change(self, n, **values):
        names = [x.split()[0] for x in READ.split(", ")]
        row = list(self.rows[n])
        for k, v in values.items():
            row[names.index(k)] = v
        self.rows[n] = tuple(row)


def flags(spark, m, homes):
    df = implausible(spark.createDataFrame(m.rows, READ), spark.createDataFrame(homes, HOME))
    return {(r.log_offset, "use" if r.measure.startswith("power") else "sun"): r.why for r in df.collect()}


def test_rules_one_by_one(spark):
    m = Meters()
    a = m.usual("A")
    m.change(a[5], power_consumption_kwh=-0.01)
    m.change(a[100], power_consumption_kwh=16.0)
    m.change(a[101], power_consumption_kwh=14.0)
    m.change(a[12], solar_generation_kwh=4.1)  # capacity 4
    m.change(a[13], solar_generation_kwh=4.0)
    m.change(a[22], solar_generation_kwh=0.1)  # dark
    m.change(a[4], solar_generation_kwh=0.1)
    m.change(a[30], solar_generation_kwh=-0.2)
    m.change(a[50], power_consumption_kwh=None)
    m.change(a[51], power_consumption_kwh=float("nan"))
    b = m.usual("B", level=lambda h: 20.0)  # what is a spike for A is usual for B
    m.change(b[10], solar_generation_kwh=0.5)  # no panels
    x = m.add(None, 12 * HOUR, -1.0, 5.0, household="hA")  # judged by its household: the name is made to match below
    m.change(x, household_id="hA")
    y = m.add("A", None, -2.0, 9.0)
    out = flags(spark, m, [("A", "hA", True, 4.0), ("B", "hB", False, 0.0)])
    assert out == {
        (a[5], "use"): "negative", (a[100], "use"): "spike", (a[101], "use"): "spike", (a[12], "sun"): "above_capacity", (a[22], "sun"): "dark", (a[30], "sun"): "negative",
        (b[10], "sun"): "no_panels", (x, "use"): "negative", (x, "sun"): "above_capacity", (y, "use"): "negative", (y, "sun"): "above_capacity",
    }


def test_regular_peaks_and_lasting_changes_are_no_spikes(spark):
    m = Meters()
    m.usual("car", level=lambda h: 9.0 if h % 24 in (22, 23) and h // 24 % 2 else 0.4)
    m.usual("rare", level=lambda h: 7.0 if h % 24 == 3 and h // 24 in (1, 3, 5, 6, 8, 10, 12) else 0.4)
    m.usual("moved", level=lambda h: 0.5 if h < 24 * 11 else 2.5)
    assert flags(spark, m, [(x, "h" + x, False, 0.0) for x in ("car", "rare", "moved")]) == {}


def test_several_spikes_of_one_meter(spark):
    m = Meters()
    a = m.usual("A")
    for k, v in ((10, 20.0), (50, 45.0), (90, 400.0), (130, 17.0), (200, 32767.0), (300, 25.0)):
        m.change(a[k], power_consumption_kwh=v)
    assert {n for (n, _) in flags(spark, m, [("A", "hA", False, 0.0)])} == {a[k] for k in (10, 50, 90, 130, 200, 300)}


def test_stuck_runs(spark):
    m = Meters()
    a = m.usual("A", 24 * 7)
    for k in range(20, 28):  # eight, over midnight
        m.change(a[k], power_consumption_kwh=0.777)
    for k in range(60, 67):  # seven
        m.change(a[k], power_consumption_kwh=0.555)
    copy = m.add("A", m.rows[a[63]][7], 0.555, event_id=m.rows[a[63]][2].upper())  # the copy of a message makes it no longer
    assert m.rows[copy][2] != m.rows[a[63]][2] or m.rows[copy][2].isdigit()
    again = m.add("A", m.rows[a[25]][7], 0.777, event_id=m.rows[a[25]][2])
    for k in range(100, 140):  # interrupted by a null after seven
        m.change(a[k], power_consumption_kwh=0.333 if k < 107 else None if k == 107 else 0.333 if k < 115 else m.rows[a[k]][5])
    levels = [m.add("L", h * HOUR, 0.27 if (h // 12) % 2 else 0.13) for h in range(24 * 7)]
    s = m.usual("S", 24 * 7)
    for k in range(24 * 3):
        m.change(s[k], solar_generation_kwh=0.0)
    for k in range(80, 100):
        m.change(s[k], solar_generation_kwh=0.321)
    days = m.usual("D", 24 * 7)
    for k in range(10, 90):  # over several whole days
        m.change(days[k], power_consumption_kwh=1.25)
    rows = with_identity(spark.createDataFrame(m.rows, READ), "event_id")
    out = stuck(rows, "meter_id", "at", ["log_partition", "log_offset"], {"power_consumption_kwh": False, "solar_generation_kwh": True}, Limits())
    got = {(r.log_offset, r.measure[:3]) for r in out.collect()}
    want = {(a[k], "pow") for k in range(20, 28)} | {(again, "pow")} | {(s[k], "sol") for k in range(80, 100)} | {(days[k], "pow") for k in range(10, 90)}
    assert got == want and not {n for n, _ in got} & set(levels)


def test_runs_against_brute_force(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(3000):
        at += rng.randrange(1, 2 * HOUR)
        rows.append((0, i, f"{i:032x}", rng.choice(["hot", "hot", "a"]), "h", 0.0, 0.0, at))
    # values change seldom
    out_rows, last = [], {}
    for r in rows:
        k = r[3]
        last[k] = last.get(k, 0.5) if rng.random() < 0.8 else rng.random()
        out_rows.append((*r[:5], last[k], 0.0, r[7]))
    df = with_identity(spark.createDataFrame(out_rows, READ), "event_id")
    found = stuck(df, "meter_id", "at", ["log_partition", "log_offset"], {"power_consumption_kwh": False}, Limits(), bucket=DAY // 4)
    want = set()
    for k in ("hot", "a"):
        line, i = [r for r in out_rows if r[3] == k], 0
        while i < len(line):
            j = i
            while j < len(line) and line[j][5] == line[i][5]:
                j += 1
            if j - i >= 8:
                want |= {r[1] for r in line[i:j]}
            i = j
    assert {r.log_offset for r in found.collect()} == want


def test_empty_and_unknown(spark):
    assert flags(spark, Meters(), [("A", "hA", True, 1.0)]) == {}
    m = Meters()
    m.add("A", 12 * HOUR, 1.0, 500.0)
    m.add(None, None, None, None)
    assert flags(spark, m, [("B", "hB", None, None)]) == {}
    df = spark.createDataFrame(m.rows, READ).withColumns({"why": F.lit("x"), "measure": F.lit("y"), "total": F.lit(1)})
    assert implausible(df, spark.createDataFrame([], HOME)).count() == 0


def sunny(m, meter, days=14):
    """Hours of sun as they usually are, by (day, hour)."""
    return {(d, h): m.add(meter, d * DAY + h * HOUR, 0.5, round((0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.4, 0.35, 0.25, 0.15, 0.1, 0.05)[h - 6] * m.rng.uniform(0.7, 1.3), 6)) for d in range(days) for h in range(6, 18)}


def test_spikes_do_not_raise_the_fence_of_their_own_part_of_the_day(spark):
    m = Meters()
    sun = sunny(m, "S")
    spikes = [sun[k] for k in ((2, 16), (8, 16), (10, 16), (12, 16), (5, 13))]  # of the 28 values from 16:00 more than a tenth
    for k in spikes:
        m.change(k, solar_generation_kwh=2.5)
    few = m.usual("F", 24 * 14)
    m.rows = [r for r in m.rows if not (r[3] == "F" and r[7] // HOUR % 24 < 4 and r[7] // DAY > 1)]  # 8 readings from 00:00
    m.change(next(i for i, r in enumerate(m.rows) if r[1] == few[3]), power_consumption_kwh=30.0)
    untimed = m.usual("U", 24 * 14)
    m.change(next(i for i, r in enumerate(m.rows) if r[1] == untimed[50]), power_consumption_kwh=30.0, at=None)
    assert flags(spark, m, [("S", "hS", True, 4.0), ("F", "hF", False, 0.0), ("U", "hU", False, 0.0)]) == {(k, "sun"): "spike" for k in spikes} | {(few[3], "use"): "spike", (untimed[50], "use"): "spike"}


def test_copies_of_a_spike_do_not_make_it_regular(spark):
    m = Meters()
    a = m.usual("A")
    m.change(a[100], power_consumption_kwh=40.0)
    copies = [m.add("A", m.rows[a[100]][7], 40.0, event_id=m.rows[a[100]][2]) for _ in range(20)]
    assert flags(spark, m, [("A", "hA", False, 0.0)]) == {(k, "use"): "spike" for k in [a[100], *copies]}


def test_isolated_jumps_are_spikes_even_if_there_are_many(spark):
    m = Meters()
    sun = sunny(m, "S")
    spikes = [sun[k] for k in ((0, 12), (1, 8), (3, 14), (5, 9), (7, 11), (8, 15), (11, 10), (12, 13))]  # 5 % of the values
    for k in spikes:
        m.change(k, solar_generation_kwh=2.5)
    a = m.usual("A")
    six = [a[d * 24 + h] for d, h in ((1, 0), (3, 23), (5, 12), (7, 17), (9, 3), (12, 12))]  # the first and last hour: neighbours on other days
    for k in six:
        m.change(k, power_consumption_kwh=50.0)
    m.change(a[5 * 24 + 11], power_consumption_kwh=None)  # passed over
    copy = m.add("A", m.rows[six[3]][7], 50.0, event_id=m.rows[six[3]][2])
    b = m.usual("B")
    for d in (1, 4, 6, 8, 10, 12):  # a regular peak
        m.change(b[d * 24 + 19], power_consumption_kwh=50.0)
    assert flags(spark, m, [("S", "hS", True, 4.0), ("A", "hA", False, 0.0), ("B", "hB", False, 0.0)]) == {(k, "sun"): "spike" for k in spikes} | {(k, "use"): "spike" for k in [*six, copy]}


def test_a_long_jam_is_no_fixed_level(spark):
    m = Meters()
    jam = m.usual("J")
    for k in jam[48:]:  # 12 of 14 days
        m.change(k, power_consumption_kwh=0.777)
    m.change(jam[200], power_consumption_kwh=None)  # in two runs
    short = m.usual("K", 10)
    for k in short[1:]:
        m.change(k, power_consumption_kwh=0.5)
    for h in range(24 * 14):
        m.add("one", h * HOUR, 0.27)
    rows = with_identity(spark.createDataFrame(m.rows, READ), "event_id")
    out = stuck(rows, "meter_id", "at", ["log_partition", "log_offset"], {"power_consumption_kwh": False}, Limits())
    assert {r.log_offset for r in out.collect()} == {*jam[48:], *short[1:]} - {jam[200]}
