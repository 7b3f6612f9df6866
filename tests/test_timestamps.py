from datetime import datetime, timedelta, timezone

import pytest

from docloom.functions import zones
from docloom.operators import timestamps as T


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "value,locale,zone,expected",
    [
        ("2024-10-05T18:29:40Z", None, None, at(2024, 10, 5, 18, 29, 40)),
        ("\t2018-10-08T13:18:01.1366972+05:30 ", None, None, at(2018, 10, 8, 7, 48, 1)),
        ("D:20220116034431+11'00", None, None, at(2022, 1, 15, 16, 44, 31)),
        ("D:20180320045700Z00'00'", None, None, at(2018, 3, 20, 4, 57)),
        ("D:20210202135700", None, "America/New_York", at(2021, 2, 2, 18, 57)),
        ("132886977875613573", None, None, int((datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=13288697787)).timestamp())),
        ("1598228837732", None, None, 1598228837),
        ("1544142900", None, None, 1544142900),
        ("15.04.2022 21:52:30", "de_DE", "Europe/Berlin", at(2022, 4, 15, 19, 52, 30)),
        ("2/20/2018 1:14:52 AM", "en_US", "UTC", at(2018, 2, 20, 1, 14, 52)),
        ("08/10/2018 12:18:01", "en_GB", "UTC", at(2018, 10, 8, 12, 18, 1)),
        ("30/03/2022 22:28:03", None, "UTC", at(2022, 3, 30, 22, 28, 3)),
        ("05/05/2022 22:28:03", None, "UTC", at(2022, 5, 5, 22, 28, 3)),
        ("2017년 8월 21일 오전 12:41:00", "ko_KR", "Asia/Seoul", at(2017, 8, 20, 15, 41)),
        ("2017. 6. 22. 오후 5:49:00", "ko_KR", "Asia/Seoul", at(2017, 6, 22, 8, 49)),
        ("Sun, 19 Jun 2022 13:48:48 +0200", None, None, at(2022, 6, 19, 11, 48, 48)),
        ("Tue Oct  9 22:36:56 2018", None, "UTC", at(2018, 10, 9, 22, 36, 56)),
        ("Feb 16, 2020 8:01:39 AM KST", None, None, at(2020, 2, 15, 23, 1, 39)),
        ("20181008T074801Z", None, None, at(2018, 10, 8, 7, 48, 1)),
        ("2023-09-03 21:22", None, "Europe/London", at(2023, 9, 3, 20, 22)),
    ],
)
def test_resolved(value, locale, zone, expected):
    seconds, status = T.resolve([value], [locale], [zone])
    assert (status, seconds.tolist()) == (["resolved"], [expected])


@pytest.mark.parametrize(
    "value,locale,zone,expected",
    [
        ("2021-02-29T10:15:00Z", None, None, "invalid"), ("2020-06-15T25:10:00Z", None, None, "invalid"), ("2022-06-19", None, "UTC", "no_time"), ("2022-06-19T10:00:00", None, None, "no_zone"),
        ("2023-03-26 02:30:00", None, "Europe/Berlin", "gap"), ("2023-10-29 02:30:00", None, "Europe/Berlin", "ambiguous"), ("03/04/2022 10:00:00", None, "UTC", "ambiguous"), ("yesterday", None, "UTC", "unparsed"),
        ("", None, "UTC", "unparsed"), (None, None, "UTC", "null"), ("2022-06-19T10:00:00", None, "Mars/Base", "no_zone"), ("Mon Oct  9 22:36:56 2018", None, "UTC", "invalid"), ("x" * 100_000, None, "UTC", "unparsed"),
    ],
)
def test_unresolved(value, locale, zone, expected):
    assert T.resolve([value], [locale], [zone])[1] == [expected]


def test_zone_tables_agree_with_the_library():
    from zoneinfo import ZoneInfo

    import numpy as np

    for zone in ("Europe/Berlin", "Asia/Kolkata", "America/New_York", "Australia/Sydney"):
        walls = np.arange(at(2019, 1, 1), at(2029, 1, 1), 86400 * 3 + 3601)
        got, kind = zones.to_utc(walls, zone)
        for w, u, k in zip(walls.tolist(), got.tolist(), kind.tolist()):
            naive = datetime.fromtimestamp(w, timezone.utc).replace(tzinfo=None)
            moments = {int(naive.replace(tzinfo=ZoneInfo(zone), fold=f).timestamp()) for f in (0, 1)}
            moments = {m for m in moments if datetime.fromtimestamp(m, ZoneInfo(zone)).replace(tzinfo=None) == naive}
            assert (k == 0 and moments == {u}) or (k == 1 and not moments) or (k == 2 and len(moments) == 2)


def test_tables_of_all_zones_agree_with_the_library_in_all_years():
    from zoneinfo import ZoneInfo, available_timezones

    import numpy as np

    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    for k, zone in enumerate(sorted(available_timezones())):
        transitions, offsets = zones.table(zone)
        moments = [-60_000_000_000 + 7_919_000_000 * i + 104_729 * k for i in range(39)] + [int(t) + d for t in transitions[-3:] for d in (-1, 0) if t < 250_000_000_000]
        moments += [int(t) + d for t in transitions[k % 5 :: 37][:12] for d in (-1, 0, 1)]
        got = offsets[np.searchsorted(transitions, moments, "right")]
        assert got.tolist() == [int((epoch + timedelta(seconds=m)).astimezone(ZoneInfo(zone)).utcoffset().total_seconds()) for m in moments], zone
    assert zones.table("No/Such") is None and zones.table("../zone.tab") is None


def test_pairs_against_brute_force(spark):
    rows = [(i, i % 3 if i % 7 else None, v, None, None, "UTC") for i, v in enumerate(["2024-10-05T18:29:40Z", "2024-10-05 18:29:40", "D:20241005182940Z", "1728152980", None, "", "2024-10-05T18:29:41Z"] * 3)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "meta_id long, file_id long, create_time string, last_saved_time string, locale string, zone_name string").withColumnRenamed("x", "x")
    times = T.normalise(df)
    known = {(r.field, r.file_id, r.utc_seconds, r.meta_id) for r in times.collect() if r.utc_seconds is not None and r.file_id is not None}
    want = {(f, a, b) for f, i, s, a in known for g, j, t, b in known if (f, i, s) == (g, j, t) and a < b}
    got = [(r.field, r.meta_id_a, r.meta_id_b) for r in T.same_moment(times).collect()]
    assert sorted(got) == sorted(want) and got
    assert T.same_moment(T.normalise(df.limit(0))).count() == 0
    rows = T.classes(times).collect()
    pairs = sorted((r.field, r.meta_id, r.links, r["class"]) for r in rows)
    linked = [(f, a) for f, a, b in got] + [(f, b) for f, a, b in got]
    assert len(rows) == len(known) and all(links == linked.count((f, m)) and least == min([m] + [a for g, a, b in got if g == f and b == m]) for f, m, links, least in pairs)
