"""The staging audit's severity order, case by case."""

from tonearm.operators.audit import staging_audit

SCHEMA = "n int, base string, artist string, title string, duration double, expected double, tag_artist string, tag_title string, indexed boolean"
#: what is staged, and the status that follows
CASES = [
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "OK"),
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", None, None, None, None, True), "OK"),  # unknown duration passes
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 300.0, 200.0, "", "", True), "SUSPECT"),  # more than a tenth off
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 215.0, 200.0, "", "", True), "OK"),
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 30.0, None, "", "", True), "SUSPECT"),  # too short
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 300.0, None, "Other Person", "Another Thing", True), "SUSPECT"),  # tags of another track
    (("Massive Attack - Unfinished Sympathy (Remix)", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "SUSPECT"),  # another version
    (("Massive Attack - Unfinished Sympathy Bonus", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "PARTIAL"),  # one word too many
    (("Massive Attack - Unfinished Sympathy Bonus Hidden Corner", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "SUSPECT"),  # three
    (("Moby - Porcelain", "Moby", "Porcelain", 240.0, None, "", "", True), "PARTIAL"),  # short, nothing corroborates
    (("Moby - Porcelain", "Moby", "Porcelain", 240.0, None, "Moby", "Porcelain", True), "OK"),
    (("Massive - Unfinished", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "PARTIAL"),  # half of both
    (("Somebody Else - Wrong Record", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", True), "SUSPECT"),
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 300.0, None, "", "", False), "NO_INDEX_ENTRY"),
    (("Massive Attack - Unfinished Sympathy", "Massive Attack", "Unfinished Sympathy", 10.0, None, "", "", False), "SUSPECT"),
    (("a - b", "", "", 300.0, None, "", "", True), "NO_MEANINGFUL_WORDS"),
]


def test_staging_audit(spark):
    rows = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(CASES)], SCHEMA)
    got = {r.n: r.status for r in staging_audit(rows).collect()}
    assert [(CASES[i][0], got[i]) for i in got] == [(CASES[i][0], CASES[i][1]) for i in got]
    assert staging_audit(rows.limit(0)).count() == 0
