"""News items of either JSON shape, as columns over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import iso_seconds, strip


def first_given(*values: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def field(item: Column, *names: str) -> Column:
    """The text of a nested field; NULL if any step is missing or no object."""
    return F.try_variant_get(item, "$." + ".".join(names), "string")


#: Where items of both shapes keep each text.
TEXTS = {
    "_title": ("title",),
    "_content_title": ("content", "title"),
    "_publisher": ("publisher",),
    "_provider": ("content", "provider", "displayName"),
    "_link": ("link",),
    "_canonical": ("content", "canonicalUrl", "url"),
    "_click": ("content", "clickThroughUrl", "url"),
}


def news_time(kind: Column, text: Column, seconds: Column) -> Column:
    """From the schema, text and number of a variant: text as it is, without white space at its ends; epoch seconds as UTC; else NULL."""
    text = strip(text)
    utc = F.when(seconds.between(-62_135_596_800, 253_402_300_799), F.concat(iso_seconds(F.timestamp_seconds(F.floor(seconds))), F.lit("+00:00")))
    numeric = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(kind == "STRING", F.when(text != "", text)).when(numeric, utc)


def news_fields(objects: DataFrame, carry: list[str], item: str = "item") -> DataFrame:
    """``carry``, title, publisher, link and timestamp. Empty text and 0 count as missing.

    Each value is read from the variant once, into a column of its own that the optimizer doesn't repeat.
    """
    value = F.col(item)
    texts = [field(value, *path).alias(name) for name, path in TEXTS.items()]
    times = [F.try_variant_get(value, path, "variant").alias(name) for name, path in (("_published", "$.providerPublishTime"), ("_date", "$.content.pubDate"))]
    read = objects.select(*carry, *texts, *times).withColumn("_given", F.try_variant_get("_published", "$", "string"))
    given = F.coalesce(~F.col("_given").isin("", "0", "0.0", "false"), F.lit(False))
    moment = read.withColumn("_moment", F.coalesce(F.when(given, F.col("_published")), F.col("_date")))
    parts = {"_kind": F.schema_of_variant("_moment"), "_text": F.try_variant_get("_moment", "$", "string"), "_seconds": F.try_variant_get("_moment", "$", "double")}
    return moment.withColumns(parts).select(
        *carry,
        first_given(F.col("_title"), F.col("_content_title")).alias("title"),
        first_given(F.col("_publisher"), F.col("_provider")).alias("publisher"),
        first_given(F.col("_link"), F.col("_canonical"), F.col("_click")).alias("link"),
        news_time(F.col("_kind"), F.col("_text"), F.col("_seconds")).alias("timestamp"),
    )


def normalise_news(df: DataFrame, raw: str = "raw", carry: list[str] | None = None) -> DataFrame:
    """One row for each object in each JSON list: ``carry``, ``position`` and the four fields.

    What is no list gives no rows, and entries that are no objects are skipped.
    """
    carry = carry or []
    parsed = df.select(*carry, F.try_variant_get(F.try_parse_json(F.col(raw)), "$", "array<variant>").alias("items"))
    items = parsed.select(*carry, F.posexplode("items").alias("position", "item"))
    objects = items.where(F.schema_of_variant("item").startswith("OBJECT"))
    return news_fields(objects, [*carry, "position"])


def headlines(news: DataFrame, key: str) -> DataFrame:
    """The titles of each key's items in order, as an array."""
    titled = news.where("title <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("titles"))
    return titled.select(key, F.transform("titles", lambda t: t["title"]).alias("headlines"))


def summary_prompt(titles: Column) -> Column:
    """The text for a summary of nothing but these headlines."""
    intro = "Summarize ONLY the following public news headlines at a topic level. Do not use any outside knowledge or price data.\n\nHeadlines:\n"
    return F.concat(F.lit(intro), F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), t)), "\n"))


def summarise(news: DataFrame, key: str, client) -> dict:
    """Summaries by an injected ``client``: a function from a prompt to a text, called on the driver for each key."""
    prompts = headlines(news, key).select(key, summary_prompt(F.col("headlines")).alias("prompt"))
    return {row[key]: client(row["prompt"]) for row in prompts.toLocalIterator()}


def days_until(target: Column, as_of: Column) -> Column:
    """Days between two dates given as dates, times or text; NULL if either is none."""
    return F.datediff(F.to_date(F.coalesce(target.try_cast("timestamp"))), F.to_date(F.coalesce(as_of.try_cast("timestamp"))))
