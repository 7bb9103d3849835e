"""Fetch functions that executors import by name."""


def prices(symbols, start, end):
    for symbol in symbols:
        if symbol == "NONE":
            continue
        yield symbol, start, 10.0
        yield symbol, start, 11.0
        yield symbol, end, None
        yield symbol, "2026-01-05", 12.5


def news(symbol):
    if symbol == "BAD":
        raise OSError("no network")
    return [{"title": f"About {symbol}"}] if symbol == "AAA" else None


def earnings(symbol):
    return {"AAA": {"Earnings Date": ["2026-03-01", "2026-06-01"]}, "BBB": {}}[symbol]


def seen(symbols, start, end):
    """Every day of the window; what is asked for is written down in the folder that SEEN names, and the first call for a symbol fails."""
    import datetime as dt
    import os

    mark = os.path.join(os.environ["SEEN"], f"{symbols[0]} {start} {end}")
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise ConnectionError("first call")
    for i in range((end - start).days):
        yield symbols[0], start + dt.timedelta(i), float(i)


def flaky(prompt):
    """Counts calls in the folder that SEEN names; every second call of a text fails, and some always do."""
    import hashlib
    import os
    import uuid

    own = hashlib.md5(prompt.encode()).hexdigest()
    before = sum(name.startswith(own) for name in os.listdir(os.environ["SEEN"]))
    open(os.path.join(os.environ["SEEN"], f"{own}-{uuid.uuid4().hex}"), "w").close()
    if "never" in prompt:
        raise ValueError("no answer")
    if before % 2 == 0:
        raise TimeoutError("later")
    return prompt.upper()
