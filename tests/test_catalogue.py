import pytest
from pyspark.sql import functions as F

from plotweave.plans import catalogue as c


@pytest.fixture(scope="module")
def few(spark, data, tmp_path_factory):
    """A folder with a corner of the given layers."""
    d = tmp_path_factory.mktemp("few")
    for n in ("parcels", "parcels_legacy", "buildings"):
        t = c.table(spark, data, n)
        t.filter(F.substring("fid", -1, 1).isin("1", "2")).write.parquet(str(d / f"{n}.parquet"))
    return str(d)


def outlines(spark, d, name):
    return {r["fid"] for r in c.given(spark, d, name).collect()}


@pytest.mark.parametrize("which", ["few", "data"])
def test_layers_are_read(spark, which, request):
    d = request.getfixturevalue(which)
    legacy, parcels = outlines(spark, d, "parcels_legacy"), outlines(spark, d, "parcels")
    assert len(legacy) > 10
    assert c.topology_diagnosis(spark, d).head()["features"] == len(legacy)
    p = c.pair_features29(spark, d).select("src", "tgt").collect()
    assert p and {r["src"] for r in p} <= legacy and {r["tgt"] for r in p} <= parcels
    assert {r["src"] for r in c.global_assignment(spark, d).collect()} <= legacy


def test_ledger_and_epochs_are_of_the_tables(spark, few):
    area = c.layers.total_area(c.given(spark, few, "parcels_legacy")).head()[0]
    assert c.topology_clean(spark, few).head()["area_before"] == pytest.approx(area)
    got = c.epoch_recovery(spark, few).collect()
    assert {r["epoch"] for r in got} == {"t0", "t1", "t2", "t3"}
    assert {r["kind"] for r in got if r["injected"] == "new"} <= {"new"} and sum(r["n"] for r in got) > 40
    assert {r["layer"]: r["n"] for r in c.city_layers(spark, few).collect()}["roads"] >= 42


def test_defaults(spark, few, monkeypatch):
    """Queries leave the operators' sizes alone."""
    seen = {}

    def spy(module, name):
        fn = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (seen.setdefault(name, k), fn(*a, **k))[1])

    for module, name in ((c.georef, "coarse_align"), (c.targeting, "candidate_corners"), (c.targeting, "plan_survey")):
        spy(module, name)
    c.table(spark, "/root/testdata/sf0.001", "survey_points").write.parquet(f"{few}/survey_points.parquet")
    c.coarse_alignment(spark, few)
    plan = c.survey_plan(spark, few)
    assert seen == {"coarse_align": {}, "candidate_corners": {}, "plan_survey": {}}
    assert plan.count() > 0
    assert c.gp_posterior(spark, few).filter("variance is not null").count() > 0
