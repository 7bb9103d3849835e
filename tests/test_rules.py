"""Decision tables, parsing and formatting."""

import itertools

import pytest
from panelforge.functions import pretrade, rules, scalars
from panelforge.operators import extras
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_dates(spark):
    cases = {
        "2026-01-05": "2026-01-05", "2026-01-06T00:00:00+00:00": "2026-01-06", "2026-01-06T20:00:00-05:00": "2026-01-07", "01/07/2026": "2026-01-07", "13/01/2026": "2026-01-13",
        "20260108": "2026-01-08", "Jan 9, 2026": "2026-01-09", " 2026-01-05 ": "2026-01-05", "2026": None, "soon": None, "": None, "2026-02-31": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    assert {r["text"]: r["d"] and r["d"].isoformat() for r in df.select("text", scalars.day(F.col("text")).alias("d")).collect()} == cases


def test_numbers(spark):
    cases = {"1.5": 1.5, " 2 ": 2.0, "-.5": -0.5, "1e3": 1000.0, "5d": None, "": None, "NaN": None, "x": None, "inf": float("inf"), "1_0": None}
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    assert {r["text"]: r["n"] for r in df.select("text", scalars.number(F.col("text")).alias("n")).collect()} == cases


def test_formats_are_half_even_and_short(spark):
    values = extras.FORMAT_NUMBERS + [-2.5, -0.00001234, 999999.4, 1e-5, 12345.678]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", scalars.fixed(F.col("v"), 0).alias("f"), scalars.shortest(F.col("v")).alias("g")).collect():
        assert row["g"] == f"{row['v']:g}"
        assert row["f"] == f"{row['v']:.0f}".replace("-0", "0")
    assert one(spark, p=scalars.percent(F.lit(None).cast("double")))["p"] == "n/a"


def test_strip_takes_all_white_space_and_path_parts_are_safe(spark):
    row = one(spark, s=scalars.symbol(F.lit(" \t\n spy ".replace(" ", ""))), p=scalars.path_part(F.lit("a/b é:1")), e=scalars.path_part(F.lit("")))
    assert (row["s"], row["p"], row["e"]) == ("SPY", "a_b_é_1", "_")


@pytest.mark.parametrize(
    ("news", "ar", "label"),
    [
        ("positive", 0.01, "Positive Abnormal Reaction"), ("positive", 0.0099, "No Meaningful Abnormal Reaction"), ("upbeat", -0.02, "Sell the News"), ("negative", 0.02, "Bad News Absorbed"),
        ("bad", -0.02, "Negative Abnormal Reaction"), ("neutral", 0.5, "Inconclusive"), ("positive", None, "Inconclusive"), ("positive", float("nan"), "Negative Abnormal Reaction"),
    ],
)
def test_reactions(spark, news, ar, label):
    made = rules.event_reaction(F.lit(news), F.lit(ar).cast("double"))
    assert one(spark, r=made["label"])["r"] == label


def test_classes_at_the_limits(spark):
    grid = list(itertools.product([69.9, 70.0, 62.0, 61.9], [True, False]))
    df = spark.createDataFrame(grid, "setup double, volume boolean")
    made = rules.signal_class(F.lit("good"), F.lit(rules.POSITIVE_REACTION), F.lit(False), F.col("setup"), F.col("volume"))
    for row in df.select("*", made.alias("c")).collect():
        score = row["setup"] + 8 * row["volume"]
        assert row["c"]["score"] == score and row["c"]["classification"] == ("Tradeable" if score >= 70 else "Watch")
    downbeat = rules.signal_class(F.lit("downbeat"), F.lit(rules.BAD_NEWS_ABSORBED), F.lit(False), F.lit(50.0), F.lit(False))
    assert one(spark, c=downbeat["classification"])["c"] == "Avoid"


def test_horizons(spark):
    assert one(spark, label=rules.horizon_label(F.lit(20)), bad=rules.horizon_label(F.lit(2)))["label"] == "20D theme validation"
    assert one(spark, h=rules.checked_horizon(F.lit(5)))["h"] == 5
    with pytest.raises(PySparkException, match="Unsupported horizon"):
        one(spark, h=rules.checked_horizon(F.lit(4) + F.rand().cast("int")))
    row = one(spark, a=rules.default_horizons(F.lit("event_reaction")), b=rules.default_horizons(F.lit("x")))
    assert row["a"] == [1, 3] and row["b"] is None


@pytest.mark.parametrize(("theme", "proxy"), [("AI Infrastructure / Semiconductor", "SMH"), ("Airlines / Travel Rebound", "JETS"), ("power and utilities", "XLU"), ("Other", None), (None, None)])
def test_theme_proxies(spark, theme, proxy):
    assert one(spark, p=rules.theme_proxy(F.lit(theme).cast("string")))["p"] == proxy


BASE = {
    "decision_id": "1", "ticker": "NVDA", "theme": "AI", "entry_thesis": "thesis", "event_type": "pullback", "planned_action": "buy", "instrument_type": "stock", "horizon_days": 20,
    "market_expectation": "medium", "confidence": "medium", "status": "pending", "max_loss": 0.0, "invalidation_rule": "a close under the low", "position_size": 5.0,
}
TYPES = "decision_id string, ticker string, theme string, entry_thesis string, event_type string, planned_action string, instrument_type string, horizon_days int, market_expectation string, confidence string, status string, max_loss double, invalidation_rule string, position_size double"


def judged(spark, high_runup=False, is_percent=False, **change):
    row = BASE | change
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in TYPES.split(", "))], TYPES)
    return pretrade.evaluate(df, F.lit(high_runup), F.lit(is_percent)).first()


def test_plain_decision_proceeds(spark):
    row = judged(spark)
    assert row["verdict"] == "proceed" and row["active"] == [] and row["reasons"] == [pretrade.NO_FLAGS] and row["heuristic_only"] and row["not_financial_advice"]


@pytest.mark.parametrize("rule", ["", "idk", "tbd", "?", "not sure", "  IDK ", "n/a", "none", None])
def test_missing_rule_waits_with_prompts(spark, rule):
    row = judged(spark, invalidation_rule=rule)
    assert row["verdict"] == "wait" and row["reasons"][:4] == pretrade.PROMPTS and row["active"] == ["no_invalidation_rule"]


def test_strictest_floor_wins_and_prompts_stay(spark):
    row = judged(spark, high_runup=True, instrument_type="call", horizon_days=2, event_type="earnings", market_expectation="high", invalidation_rule="")
    assert row["verdict"] == "avoid_chase" and row["reasons"][:4] == pretrade.PROMPTS
    row = judged(spark, instrument_type="leveraged_etf", event_type="macro_event")
    assert row["verdict"] == "use_spread_or_hedge" and "event_gamble" in row["active"]


@pytest.mark.parametrize("action", ["watch", "avoid", "trim"])
def test_no_escalation_without_entry(spark, action):
    row = judged(spark, high_runup=True, planned_action=action)
    assert row["verdict"] == "proceed" and row["active"] == ["high_runup"] and row["reasons"][-1] == f"Planned action is '{action}' (not an entry); risk escalation suppressed."


def test_short_dated_and_size(spark):
    assert judged(spark, instrument_type="put", horizon_days=3, event_type="guidance")["active"] == ["short_dated_option", "event_gamble"]
    assert "short_dated_option" not in judged(spark, instrument_type="call", horizon_days=30, event_type="earnings")["active"]
    assert "short_dated_option" not in judged(spark, instrument_type="call_spread", horizon_days=3, event_type="earnings")["active"]
    assert judged(spark, position_size=10.0)["verdict"] == "proceed" and judged(spark, position_size=25.0)["verdict"] == "reduce_size"


def test_loss_texts(spark):
    assert any("define the exit basis" in r for r in judged(spark, max_loss=2.0, position_size=10.0)["reasons"])
    assert any("roughly a 20% adverse move" in r and "max loss 2% of portfolio / position 10%" in r for r in judged(spark, is_percent=True, max_loss=2.0, position_size=10.0)["reasons"])


def test_violations(spark):
    rows = [{"ticker": " "}, {"theme": None}, {"event_type": "rumour"}, {"position_size": -1.0}, {"position_size": 100.1}, {"horizon_days": 0}, {"max_loss": -10.0}, {}, {"position_size": 100.0}, {"max_loss": None}, {"status": None}]
    data = [tuple((BASE | r | {"decision_id": str(i)})[c.split()[0]] for c in TYPES.split(", ")) for i, r in enumerate(rows)]
    out = pretrade.validate_decisions(spark.createDataFrame(data, TYPES)).orderBy(F.col("decision_id").cast("int")).collect()
    assert [len(r["violations"]) for r in out] == [1] * 7 + [0] * 4 and out[-1]["status"] == "pending"
