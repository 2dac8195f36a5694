"""Triples are dealt before they are made distinct, and certificates read them from one table."""

from kinweave.sources import certificates, person_csv


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    row = ("e1", None, "p1", "anna", "smit", None, "female", None, "newborn")
    return spark.createDataFrame([row, row, ("e1", None, "p2", "maria", "bos", None, "female", None, "mother")], ", ".join(f"{c} string" for c in person_csv.NAMES))


def test_triples_are_dealt_first(spark):
    for made in (person_csv.triples(_rows(spark)), person_csv.pico_triples(_rows(spark))):
        plan = _plan(made)
        assert plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM")  # no table of a task's triples before the shuffle
        assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM") :].split("Union")[0]
        assert made.count() == made.distinct().count()


def test_certificates_read_one_table(spark):
    for model in certificates.MODELS.values():
        made = certificates.certificates(person_csv.triples(_rows(spark)), "births", model)
        assert "kinweave-statements" in _plan(made) and "REPARTITION_BY_NUM" not in _plan(made)
