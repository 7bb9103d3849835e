"""Pre-trade check of planned decisions: validation, risk flags, verdict and reasons, as columns of one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import fixed, shortest, strip, symbol

# Fixed values.
DOMAINS = {
    "event_type": ["earnings", "guidance", "analyst_day", "product_launch", "sympathy_move", "pullback", "breakout", "macro_event", "other"],
    "planned_action": ["buy", "add", "hold", "trim", "avoid", "watch"],
    "instrument_type": ["stock", "call", "put", "call_spread", "put_spread", "leveraged_etf", "other"],
    "market_expectation": ["low", "medium", "high"],
    "confidence": ["low", "medium", "high"],
    "status": ["pending", "entered", "skipped", "invalidated", "closed"],
}
REQUIRED_TEXT = ["ticker", "theme", "entry_thesis"]
ENTRY_ACTIONS = ["buy", "add", "hold"]
NAKED_OPTIONS = ["call", "put"]
SPREADS = ["call_spread", "put_spread"]
BINARY_EVENTS = ["earnings", "guidance", "analyst_day", "product_launch", "macro_event"]
SHORT_OPTION_EVENTS = ["earnings", "guidance"]
PLACEHOLDERS = ["", "idk", "tbd", "?", "??", "???", "na", "n/a", "none", "not sure", "no", "nope", "-", ".", "dunno", "unsure"]
SHORT_DATED_DAYS = 5
SOFT_LIMIT = 10.0
SEVERITY = ["proceed", "reduce_size", "use_spread_or_hedge", "wait", "avoid_chase"]
FLAGS = ["earnings_imminent", "high_runup", "short_dated_option", "leveraged_product", "no_invalidation_rule", "position_too_large", "event_gamble", "priced_for_perfection_candidate"]
PROMPTS = [
    "No usable invalidation rule / stop basis was provided.",
    "Reflection: what specific price, level, or event would prove this thesis wrong?",
    "Reflection: define your exit basis before entry — where do you get out if it goes against you?",
    "These are reasoning prompts, not financial advice and not a recommended stop level.",
]
FLOORS = [
    ("high_runup", "avoid_chase", "Recent large run-up flagged; entering here risks chasing."),
    ("event_gamble", "use_spread_or_hedge", "Binary event with a leveraged or naked short-dated instrument reads as an event gamble."),
    ("short_dated_option", "use_spread_or_hedge", "Naked short-dated option into a binary event; time-decay and gamma risk are high."),
    ("leveraged_product", "use_spread_or_hedge", "Leveraged product carries path and decay risk."),
    ("position_too_large", "reduce_size", "Position size exceeds the 10% soft limit."),
    ("priced_for_perfection_candidate", "wait", "You rate market expectation as high; the setup may be priced for perfection."),
    ("earnings_imminent", "wait", "Earnings are imminent; the outcome is binary."),
]
SPREAD_NOTE = "Defined-risk spread into a binary event with high expectations; risk is capped but still event-dependent."
LOSS_NOTE = "Max loss recorded; define the exit basis. The unit is not specified as % of portfolio, so no implied price move is computed."
IMPLIED_MOVE = ["Your inputs imply roughly a ", "% adverse move on this position (max loss ", "% of portfolio / position ", "% of portfolio). This is pure arithmetic from your own numbers, not a recommended stop."]
NO_ENTRY = ["Planned action is '", "' (not an entry); risk escalation suppressed."]
NO_FLAGS = "No behavioral risk flags triggered by this heuristic check."


def violations(columns: list[str]) -> Column:
    """The rules that a decision breaks, in order; empty if it is valid. Absent optional columns count as unset."""
    checks = [F.when(F.col(c).isNull() | (strip(F.col(c)) == ""), f"{c} is required and cannot be empty") for c in REQUIRED_TEXT]
    for name, domain in DOMAINS.items():
        if name in columns:
            value = F.coalesce(F.col(name), F.lit("pending")) if name == "status" else F.col(name)
            checks.append(F.when(~F.coalesce(value.isin(domain), F.lit(False)), f"{name} must be one of: {', '.join(domain)}"))
    days, size, loss = F.col("horizon_days"), F.col("position_size"), F.col("max_loss")
    checks.append(F.when(days.isNull() | (F.floor(days) <= 0), "horizon_days must be a positive number of days"))
    checks.append(F.when(size.isNull() | F.isnan(size) | (size < 0) | (size > 100), "position_size must be a percent of portfolio between 0 and 100"))
    checks.append(F.when(loss < 0, "max_loss cannot be negative"))
    return F.array_compact(F.array(*checks))


def validate_decisions(df: DataFrame, now: Column | None = None, new_id: Column | None = None) -> DataFrame:
    """Decisions in canonical form with ``violations``; unset status, id and time of creation get their defaults."""
    canonical = df.withColumn("violations", violations(df.columns)).withColumn("ticker", symbol(F.col("ticker")))
    for name in ("theme", "entry_thesis"):
        canonical = canonical.withColumn(name, strip(F.col(name)))
    defaults = {"status": F.lit("pending"), "decision_id": F.uuid() if new_id is None else new_id, "created_at": F.current_timestamp() if now is None else now}
    for name, value in defaults.items():
        if name in df.columns:
            canonical = canonical.withColumn(name, F.coalesce(F.col(name), value.cast(df.schema[name].dataType)))
    return canonical


def placeholder(rule: Column) -> Column:
    return F.lower(strip(F.coalesce(rule, F.lit("")))).isin(PLACEHOLDERS)


def risk_flags(high_runup: Column | None = None) -> Column:
    """Struct of the eight flags; they describe the inputs whatever the planned action is."""
    event, instrument = F.col("event_type"), F.col("instrument_type")
    short = instrument.isin(NAKED_OPTIONS) & (F.col("horizon_days") <= SHORT_DATED_DAYS) & event.isin(SHORT_OPTION_EVENTS)
    leveraged = instrument == "leveraged_etf"
    flags = {
        "earnings_imminent": event == "earnings",
        "high_runup": F.lit(False) if high_runup is None else high_runup,
        "short_dated_option": short,
        "leveraged_product": leveraged,
        "no_invalidation_rule": placeholder(F.col("invalidation_rule")),
        "position_too_large": F.col("position_size") > SOFT_LIMIT,
        "event_gamble": event.isin(BINARY_EVENTS) & (short | leveraged),
        "priced_for_perfection_candidate": F.col("market_expectation") == "high",
    }
    return F.struct(*[F.coalesce(flags[name], F.lit(False)).alias(name) for name in FLAGS])


def active_flags(flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(flags[name], name) for name in FLAGS]))


def any_active(flags: Column) -> Column:
    return F.exists(F.array(*[flags[name] for name in FLAGS]), lambda x: x)


def is_entry() -> Column:
    return F.coalesce(F.col("planned_action").isin(ENTRY_ACTIONS), F.lit(False))


def verdict(flags: Column) -> Column:
    """The strictest floor of the active flags for an entry; otherwise to proceed."""
    steps = [F.when(flags[name], SEVERITY.index(floor)).otherwise(0) for name, floor, _ in FLOORS]
    steps.append(F.when(flags["no_invalidation_rule"], SEVERITY.index("wait")).otherwise(0))
    return F.element_at(F.array(*map(F.lit, SEVERITY)), F.when(is_entry(), F.greatest(*steps)).otherwise(0) + 1)


def implied_move() -> Column:
    """Per cent that the price may move against the position, from the two percentages of the portfolio."""
    return F.when((F.col("max_loss") > 0) & (F.col("position_size") > 0), F.col("max_loss") / F.col("position_size") * 100)


def loss_reason(is_percent: Column) -> Column:
    text = F.concat(
        F.lit(IMPLIED_MOVE[0]), fixed(implied_move(), 0), F.lit(IMPLIED_MOVE[1]), shortest(F.col("max_loss")), F.lit(IMPLIED_MOVE[2]), shortest(F.col("position_size")), F.lit(IMPLIED_MOVE[3])
    )
    return F.when(F.col("max_loss") > 0, F.when(is_percent & (F.col("position_size") > 0), text).otherwise(LOSS_NOTE))


def reasons(flags: Column, is_percent: Column | None = None) -> Column:
    is_percent = F.lit(False) if is_percent is None else is_percent
    prompts = F.when(is_entry() & flags["no_invalidation_rule"], F.array(*map(F.lit, PROMPTS))).otherwise(F.array().cast("array<string>"))
    spread = F.col("instrument_type").isin(SPREADS) & F.col("event_type").isin(BINARY_EVENTS) & (F.col("market_expectation") == "high")
    held_back = F.concat(F.lit(NO_ENTRY[0]), F.col("planned_action"), F.lit(NO_ENTRY[1]))
    listed = F.array_compact(
        F.array(*[F.when(flags[name], reason) for name, _, reason in FLOORS], F.when(spread, SPREAD_NOTE), loss_reason(is_percent), F.when(~is_entry() & any_active(flags), held_back))
    )
    every = F.concat(prompts, listed)
    return F.when(F.size(every) == 0, F.array(F.lit(NO_FLAGS))).otherwise(every)


def evaluate(df: DataFrame, high_runup: Column | None = None, is_percent: Column | None = None) -> DataFrame:
    """Add ``flags``, ``active``, ``verdict``, ``reasons`` and the two disclaimers to each decision."""
    flagged = df.withColumn("flags", risk_flags(high_runup))
    flags = F.col("flags")
    return flagged.select(
        "*", active_flags(flags).alias("active"), verdict(flags).alias("verdict"), reasons(flags, is_percent).alias("reasons"),
        F.lit(True).alias("heuristic_only"), F.lit(True).alias("not_financial_advice"),
    )


def summary_rows(df: DataFrame, key: str = "decision_id") -> DataFrame:
    """``Field`` and ``Value`` rows of each decision, values as text, '' for none."""
    fields = {
        "Ticker": "ticker", "Planned action": "planned_action", "Instrument": "instrument_type", "Event type": "event_type", "Horizon (days)": "horizon_days", "Max loss": "max_loss",
        "Invalidation rule": "invalidation_rule", "Position size (%)": "position_size", "Confidence": "confidence", "Market expectation": "market_expectation", "Theme": "theme", "Status": "status",
    }
    rows = []
    for label, name in fields.items():
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if name == "invalidation_rule":
            value = F.when(value == "", "(none)").otherwise(value)
        rows.append(F.struct(F.lit(label).alias("Field"), value.alias("Value")))
    return df.select(key, F.inline(F.array(*rows)))
