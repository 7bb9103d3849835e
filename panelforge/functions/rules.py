"""Decision tables as columns: sentiment, event reaction, signal class, outcome, horizons and sector proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import above, at_least, strip

# Fixed values.
POSITIVE_REACTION = "Positive Abnormal Reaction"
NEGATIVE_REACTION = "Negative Abnormal Reaction"
SELL_THE_NEWS = "Sell the News"
BAD_NEWS_ABSORBED = "Bad News Absorbed"
NO_REACTION = "No Meaningful Abnormal Reaction"
INCONCLUSIVE = "Inconclusive"
RULE_VERSION = "rules.v1"
MATERIAL = 0.01
FALSE_NEGATIVE_OVER = 0.02
OVEREXTENDED_RSI = 75
OVEREXTENDED_RETURN = 0.25
TRADEABLE_SCORE = 70
VOLUME_BONUS = 8
HORIZONS = {1: "1D event reaction", 3: "3D event digestion", 5: "5D swing validation", 20: "20D theme validation", 60: "60D broader context"}
DEFAULT_HORIZONS = {"event_reaction": [1, 3], "trade_setup": [5], "theme_thesis": [20], "context": [60]}
MORE_DEFAULT_HORIZONS = {"technical_extension": [5, 20], "basket_confirmation": [5, 20]}
THEME_PROXIES = {
    "AI Infrastructure": "SMH",
    "Semiconductor": "SMH",
    "Airlines": "JETS",
    "Travel Rebound": "JETS",
    "Energy": "XLE",
    "Consumer Cyclical": "XLY",
    "Utilities": "XLU",
    "Power": "XLU",
    "Enterprise Software": "IGV",
    "Cybersecurity": "HACK",
}
EVENT_WORDS = {"positive": ["positive", "bullish", "good", "upbeat"], "negative": ["negative", "bearish", "bad", "downbeat"]}
SIGNAL_WORDS = {"positive": ["positive", "bullish", "good"], "negative": ["negative", "bearish", "bad"]}

# What reactions and classes say.
NO_CLAIM = "Do not make a strong causal claim."
DAILY_CLAIM = "Daily-only evidence; use as association, not proof of intraday causality."
TIMED_CLAIM = "Timestamped event evidence; still validate with forward tracking."
REACTION_REASONS = {
    "missing": "Missing abnormal return or event timestamp.",
    "neutral": "Neutral or unknown catalyst without explicit basket/theme evidence.",
    "small": "Abnormal return did not clear the materiality threshold.",
    "good_up": "Positive catalyst aligned with positive abnormal return.",
    "good_down": "Positive catalyst was met with negative abnormal return.",
    "bad_up": "Negative catalyst was absorbed without negative abnormal return.",
    "bad_down": "Negative catalyst aligned with negative abnormal return.",
    "basket_up": "Abnormal return was positive with explicit basket/theme evidence.",
    "basket_down": "Abnormal return was negative with explicit basket/theme evidence.",
}
CLASS_REASONS = {
    "chase": "Positive catalyst and reaction are real, but the setup is technically overextended.",
    "against": "Abnormal reaction argues against the bullish thesis.",
    "absorbed": "Bad news was absorbed, but needs forward validation.",
    "unclear": "Positive catalyst has not produced a meaningful abnormal reaction.",
    "untested": "No testable positive validation is present.",
    "aligned": "Catalyst, abnormal reaction, and setup score align.",
    "weak_setup": "Positive abnormal reaction exists, but setup quality is not high enough.",
    "none": "Rules did not find a validated setup.",
}


def sentiment(text: Column, words: dict[str, list[str]]) -> Column:
    value = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(value.isin(words["positive"]), "positive").when(value.isin(words["negative"]), "negative").otherwise("neutral")


def event_sentiment(text: Column) -> Column:
    return sentiment(text, EVENT_WORDS)


def signal_sentiment(text: Column) -> Column:
    """Knows fewer words than the event's: 'upbeat' and 'downbeat' are neutral here."""
    return sentiment(text, SIGNAL_WORDS)


def event_reaction(
    news: Column,
    abnormal: Column,
    timestamp_present: Column | None = None,
    granularity: Column | None = None,
    threshold: float = MATERIAL,
    basket_evidence: Column | None = None,
    kind: Column | None = None,
) -> Column:
    """Struct of label, abnormal_return, causal_claim and reason; the first rule that holds decides.

    ``kind`` is the normalised sentiment, if a column has it already.
    """
    present = F.lit(True) if timestamp_present is None else F.coalesce(timestamp_present, F.lit(False))
    grain = F.lit("daily") if granularity is None else granularity
    basket = F.lit(False) if basket_evidence is None else F.coalesce(basket_evidence, F.lit(False))
    kind = event_sentiment(news) if kind is None else kind
    missing = abnormal.isNull() | ~present
    up, down = above(abnormal, 0.0), (abnormal < 0) & ~F.isnan(abnormal)
    small = (F.abs(abnormal) < threshold) & ~F.isnan(abnormal)
    claim = (
        F.when(missing, NO_CLAIM)
        .when(F.lower(grain).isin("daily", "daily-only", "end_of_day"), DAILY_CLAIM)
        .otherwise(TIMED_CLAIM)
    )
    rules = [
        (missing, INCONCLUSIVE, REACTION_REASONS["missing"]),
        ((kind == "neutral") & ~basket, INCONCLUSIVE, REACTION_REASONS["neutral"]),
        (small, NO_REACTION, REACTION_REASONS["small"]),
        ((kind == "positive") & up, POSITIVE_REACTION, REACTION_REASONS["good_up"]),
        ((kind == "positive") & down, SELL_THE_NEWS, REACTION_REASONS["good_down"]),
        ((kind == "negative") & at_least(abnormal, 0.0), BAD_NEWS_ABSORBED, REACTION_REASONS["bad_up"]),
        ((kind == "negative") & down, NEGATIVE_REACTION, REACTION_REASONS["bad_down"]),
        (up, POSITIVE_REACTION, REACTION_REASONS["basket_up"]),
        (F.lit(True), NEGATIVE_REACTION, REACTION_REASONS["basket_down"]),
    ]
    return F.struct(_first(rules, 1).alias("label"), abnormal.alias("abnormal_return"), claim.alias("causal_claim"), _first(rules, 2).alias("reason"))


def _first(rules: list[tuple], part: int) -> Column:
    out = F.when(rules[0][0], rules[0][part])
    for rule in rules[1:]:
        out = out.when(rule[0], rule[part])
    return out


def overextended(flag: Column, rsi: Column, return_20d: Column) -> Column:
    """Any of the flag, an RSI of 75 or a 20-day return of 25 %; missing values are not."""
    conditions = [flag, at_least(rsi.cast("double"), OVEREXTENDED_RSI), at_least(return_20d.cast("double"), OVEREXTENDED_RETURN)]
    flag, by_rsi, by_return = (F.coalesce(c, F.lit(False)) for c in conditions)
    return flag | by_rsi | by_return


def signal_score(setup: Column, volume: Column) -> Column:
    return setup.cast("double") + F.when(F.coalesce(volume, F.lit(False)), float(VOLUME_BONUS)).otherwise(0.0)


def signal_class(news: Column, reaction: Column, extended: Column, setup: Column, volume: Column, kind: Column | None = None) -> Column:
    """Struct of classification, score, rule_version and reason; the first rule that holds decides."""
    kind = signal_sentiment(news) if kind is None else kind
    score = signal_score(setup, volume)
    real = reaction == POSITIVE_REACTION
    positive = kind == "positive"
    unclear = reaction.isin(INCONCLUSIVE, NO_REACTION)
    rules = [
        (positive & real & extended, "Avoid Chase", CLASS_REASONS["chase"]),
        (reaction.isin(SELL_THE_NEWS, NEGATIVE_REACTION), "Avoid", CLASS_REASONS["against"]),
        ((kind == "negative") & (reaction == BAD_NEWS_ABSORBED), "Watch", CLASS_REASONS["absorbed"]),
        (unclear & positive, "Wait for Confirmation", CLASS_REASONS["unclear"]),
        (unclear, "Avoid", CLASS_REASONS["untested"]),
        (positive & real & at_least(score, TRADEABLE_SCORE), "Tradeable", CLASS_REASONS["aligned"]),
        (real, "Watch", CLASS_REASONS["weak_setup"]),
        (F.lit(True), "Avoid", CLASS_REASONS["none"]),
    ]
    return F.struct(_first(rules, 1).alias("classification"), score.alias("score"), F.lit(RULE_VERSION).alias("rule_version"), _first(rules, 2).alias("reason"))


def outcome(classification: Column, abnormal: Column, threshold: float = FALSE_NEGATIVE_OVER) -> Column:
    """Struct of trade_hit, watch_followthrough, avoided_bad_trade and false_negative; NULL where a class has none."""
    known = abnormal.isNotNull()
    rose = above(abnormal, 0.0)
    avoided = classification.isin("Avoid", "Avoid Chase")
    watched = classification.isin("Watch", "Wait for Confirmation")
    traded = classification == "Tradeable"
    return F.struct(
        F.when(known & traded, rose).alias("trade_hit"),
        F.when(known & watched, rose).alias("watch_followthrough"),
        F.when(known & avoided, (abnormal <= 0) & ~F.isnan(abnormal)).alias("avoided_bad_trade"),
        F.when(known & avoided, above(abnormal, threshold)).when(known & (traded | watched), False).alias("false_negative"),
    )


def horizon_known(horizon: Column) -> Column:
    return F.coalesce(horizon.isin(list(HORIZONS)), F.lit(False))


def checked_horizon(horizon: Column) -> Column:
    """The horizon; any other than the five is an error at run time."""
    return F.when(horizon_known(horizon), horizon).otherwise(F.raise_error(F.concat(F.lit("Unsupported horizon: "), F.coalesce(horizon.cast("string"), F.lit("None")))))


def horizon_label(horizon: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in HORIZONS.items() for x in pair])[horizon]


def default_horizons(signal_type: Column, more: bool = False) -> Column:
    """The horizons of a signal type, as an array; NULL for an unknown type."""
    known = DEFAULT_HORIZONS | (MORE_DEFAULT_HORIZONS if more else {})
    return F.create_map(*[x for name, days in known.items() for x in (F.lit(name), F.array(*map(F.lit, days)))])[signal_type]


def theme_proxy(theme: Column, proxies: dict[str, str] = THEME_PROXIES) -> Column:
    """The proxy of the first name that the theme holds, whatever the case; else NULL."""
    lowered = F.lower(theme)
    out = F.lit(None).cast("string")
    for name, proxy in reversed(proxies.items()):
        out = F.when(F.contains(lowered, F.lit(name.lower())), proxy).otherwise(out)
    return out
