"""What the enrich job works out for every claim or attribute is worked out once."""

from shelfmark.operators import claims as cl
from shelfmark.plans import enrich as plan
from shelfmark.sources.store import Staging
from tests.test_norms import _claims, _rows


def test_forms_that_claims_carry_are_taken_over(spark, monkeypatch):
    d = _claims(spark)
    carried = cl.with_canonical(d).cache()
    for fold in (True, False):
        want = _rows(cl.compare_sources(d, fold))
        with monkeypatch.context() as m:
            m.setattr(cl, "with_norm", lambda *a, **b: (_ for _ in ()).throw(AssertionError("claims were normalised again")))
            assert _rows(cl.compare_sources(carried, fold)) == want


def test_best_claims_are_found_once(spark, monkeypatch):
    feed = spark.createDataFrame([(i, f"PN-{i}", "Acme", "Acme", f"{i} V AC 5 A steel wall mount 3 x 4 in", None) for i in range(5)],
                                 "product_id long, part_number string, manufacturer string, brand string, description string, category string")
    kept, keep = {}, Staging.keep

    def told(self, df, name):
        kept[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Staging, "keep", told)
    out = plan.enrich(feed, plan.Rules.starter(spark))
    assert out["attributes"].count() > 0
    assert "max_by" in kept["found"] and "max_by" not in kept["attributes"]


def test_overall_confidence_is_free_of_float_noise(spark, monkeypatch):
    """A mean of 71.45 is rounded as one, in whatever order its scores are added: as confidence per product is."""
    feed = spark.createDataFrame([(1, "PN-1", "Acme", "Acme", "24 V AC", None)], "product_id long, part_number string, manufacturer string, brand string, description string, category string")
    told = []
    monkeypatch.setattr(plan.score, "score_round", lambda c, n, f=plan.score.score_round: told.append(str(c)) or f(c, n))
    plan.enrich(feed, plan.Rules.starter(spark))
    assert any("avg(confidence_score)" in x for x in told)
