"""The briefing as text, with rows in all sections and in none."""

import datetime as dt

from tidewatch.functions import times
from tidewatch.operators import report

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"
SCHEMAS = ["position int, label string, value string, detail string", f"severity int, ts {NTZ}, headline string, lines array<string>", f"position int, source string, level string, kind string, title string, issued {NTZ}", "omitted long", "position int, title string, lines array<string>", "position int, kind string, title string, lines array<string>", "position int, label string, value string, detail string", "source string, age double, state string"]


def lines(spark, *tables):
    return [r.line for r in report.report(times.at(str(T0)), 60, *[spark.createDataFrame(t, s) for t, s in zip(tables, SCHEMAS, strict=True)]).collect()]


def test_a_full_report(spark):
    got = lines(
        spark, [(1, "B", "2", None), (0, "A", "1", "x")], [(1, T0, "small", None), (3, T0, "old", ["a", "b"]), (3, T0 + dt.timedelta(minutes=1), "new", []), (1, None, "none", None)],
        [(0, "VicEmergency", "Advice", "Fire", "Ash", T0), (1, "BoM", None, "Flood", "River", None)], [(1,)], [(0, "Ash", ["l"])], [(0, "OBSERVED", "Gauge", ["near"])], [(0, "Gust", "—", None)], [("Roads", None, "never"), ("Fire", 2.0, "ok")],
    )
    assert got == [
        "OPERATIONAL BRIEFING", "Generated 11 Aug 2026 12:00", "Changes since: last 1 hour",
        "CURRENT SITUATION", "  A                            1 — x", "  B                            2",
        "SIGNIFICANT CHANGES (last 1 hour)", "  12:01  [CRITICAL] new", "  12:00  [CRITICAL] old", "      a", "      b", "  12:00  [NOTABLE] small", "  --:--  [NOTABLE] none",
        "ACTIVE WARNINGS — VICEMERGENCY", "  [Advice] Fire — Ash (issued 11 Aug 12:00)", "  ... and 1 further Advice warning not listed.", "ACTIVE WARNINGS — BOM", "  Flood — River (issued —)",
        "EMERGING CONSEQUENCES", "  Ash", "      l", "WATCH POINTS", "  [OBSERVED] Gauge", "      near", "WEATHER OBSERVATIONS", "  Gust                         —", f"  {report.NOT_CHECKED}",
        "DATA FRESHNESS", "  Fire           2 min ago", "  Roads          never   <-- CHECK",
    ]


def test_an_empty_report_says_so(spark):
    got = lines(spark, *[[] for _ in SCHEMAS])
    assert [x for x in got if x.startswith("  ")] == [f"  {x}" for x in (report.NO_CHANGES, report.NO_WARNINGS, report.NO_WARNINGS, report.NO_CONSEQUENCES, report.NO_POINTS, report.NOT_CHECKED)]
