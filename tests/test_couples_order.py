"""A marriage some months before another: whole years count 0, which in_order leaves out."""

from kinweave.operators import couples
from kinweave.sources.certificates import PERSON

_ROLES = ("subject", "partner", "subject_father", "subject_mother", "partner_father", "partner_mother")


def test_in_order(spark):
    people = {"subject": ("anna", "bakker", "f"), "partner": ("jan", "visser", "m"), "subject_mother": ("maria", "smit", "f"), "partner_father": ("piet", "visser", "m")}
    role = lambda e, r: (f"{r}{e}", *people[r], None) if r in people else None
    rows = [(e, day, *(role(e, r) for r in _ROLES)) for e, day in (("a", "1850-09-01"), ("b", "1850-03-01"), ("c", "1850-03-01"))]
    w = spark.createDataFrame(rows, "event string, day string, " + ", ".join(f"{r} {PERSON}" for r in _ROLES)).selectExpr("event", "date(day) as event_date", *_ROLES)
    pairs = lambda **more: {(r.a_event, r.b_event) for r in couples.couples(w, w, **more).collect()}
    assert pairs() == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert pairs(in_order=True) == {("b", "a"), ("c", "a"), ("b", "c"), ("c", "b")}
