"""The registered selections compare all candidates of their operators, over all windows and periods."""
import __spark_entry__ as entry
from highwater.operators import models as ML


def test_selection_has_something_to_select(spark, sf):
    got = {(r["candidate"], r["window"]) for r in entry.queries()["m5_select_and_refit"](spark, sf).collect()}
    assert got == {(c, w) for c in ("logistic", "gradient_boosting") for w in range(3)}


def test_alert_policy_compares_and_is_tested(spark, sf, monkeypatch):
    fitted, fit = [], ML.fit
    monkeypatch.setattr(ML, "fit", lambda name, *a: fitted.append(name) or fit(name, *a))
    rows = entry.queries()["m7_alert_policy"](spark, sf).collect()
    assert fitted == ["logistic", "gradient_boosting", "balanced_boosting"]
    assert {r["period"] for r in rows} == {"validation", "future", "unseen_streets"}
    assert {r["group"] for r in rows if r["period"] == "future"} == {"city", "county", "overall"}
