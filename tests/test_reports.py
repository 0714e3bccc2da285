"""Versioned reports against a build by hand."""

from collections import defaultdict
from datetime import date

from corpusloom.operators.graph import Rounds
from corpusloom.plans import reports
from corpusloom.plans.feeds import LEAST_ITEMS, SECTIONS
from corpusloom.sources import products

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    chosen, days = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r.score, r.item_id)):
        days[r.day].append(r)
    for day, found in days.items():
        taken = []
        for r in found:
            if len(taken) < 12 and sum(t.family == r.family for t in taken) < 3 and (r.content_type != "research" or sum(t.content_type == "research" for t in taken) < 4):
                taken.append(r)
        iso = date.fromisoformat(day).isocalendar()
        for key in (("daily", day), ("weekly", f"{iso[0]}-W{iso[1]:02}"), ("monthly", day[:7])):
            chosen[key] += taken
    out = {}
    for (period, key), items in chosen.items():
        stories = defaultdict(list)
        for r in items:
            stories[("s", r.story) if r.story is not None else ("i", r.item_id)].append(r)
        best = [(min(s, key=lambda r: (-r.score, r.item_id)), len({r.source_id for r in s})) for s in stories.values()]
        best.sort(key=lambda b: (SECTIONS.index(b[0].content_type) if b[0].content_type in SECTIONS else 99, -b[0].score, b[0].item_id))
        faults = [f"invalid_canonical_url:{r.item_id}" for r, _ in best if not (r.url or "").startswith("https://")] + [f"missing_story:{r.item_id}" for r, _ in best if r.story is None]
        reasons = [f"too_few_items:{len(best)}<{LEAST_ITEMS[period]}"] * (len(best) < LEAST_ITEMS[period]) + ["missing_summary"] * key.endswith("3") + sorted(faults)
        out[period, key] = ([r.item_id for r, _ in best], reasons, sum(n for _, n in best), [(r.title, r.url, r.score, n) for r, n in best])
    return out


def test_reports_equal_those_by_hand(spark):
    rows = reports.candidates(spark, SF).collect()
    before, now = by_hand([r for r in rows if r.item_id % 7 < 6]), by_hand(rows)
    got = {(r.period, r.key): r for r in reports.i9_report_products(spark, SF).collect()}
    assert got.keys() == now.keys()
    for k, (items, reasons, outlets, _) in now.items():
        assert (got[k].item_ids, got[k].reasons, got[k].outlets) == (items, reasons, outlets)
        assert got[k].status == ("REVIEW_REQUIRED" if reasons else "PUBLISHED")
        assert got[k].version == (2 if k in before and before[k] != now[k] else 1)


def test_versions_of_finished_builds(spark):
    path, schema = Rounds(spark, "versions").root, "k string, d string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    told = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert told(products.published(spark, path, schema, ["k"])) == []
    assert told(products.publish(frame([("a", "1"), ("b", "1")]), path, ["k"], "d")) == [("a", "1", 1), ("b", "1", 1)]
    assert told(products.publish(frame([("b", "2"), ("c", None)]), path, ["k"], "d")) == [("a", "1", 1), ("b", "2", 2), ("c", None, 1)]
    # a build that was lost in the middle is no build, and its number isn't taken again
    frame([("a", "9")]).selectExpr("*", "7L as version").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/build=3")
    assert told(products.published(spark, path, schema, ["k"])) == [("a", "1", 1), ("b", "2", 2), ("c", None, 1)]
    assert told(products.publish(frame([("a", "1"), ("b", "2"), ("c", None)]), path, ["k"], "d")) == [("a", "1", 1), ("b", "2", 2), ("c", None, 1)]
    assert told(products.publish(frame([("b", "1")]), path, ["k"], "d")) == [("a", "1", 1), ("b", "1", 3), ("c", None, 1)]
    assert products._builds(spark, path) == ([1, 2, 4, 5], 5)
