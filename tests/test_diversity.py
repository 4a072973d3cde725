"""The registered diversity query takes the operator's own sample."""

from orrery.operators import training
from orrery.plans import catalog
from orrery.session import table

DIR = "/root/testdata/sf0.001"


def test_query_takes_the_sample_of_the_operator(spark, monkeypatch):
    seen, own = [], training.diversity
    monkeypatch.setattr(training, "diversity", lambda *a, **k: seen.append((a[1:], k)) or own(*a, **k))
    got = catalog.QUERIES["a11_diversity"](spark, DIR).first()[0]
    want = own(table(spark, DIR, "benchmark"), "item_id", "text", 100).first()[0]
    assert seen == [(("item_id", "text"), {})] and got == want
