"""Message cards, and a sink that delivers each notification once, over crashes and repeated batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.scalars import card_price, first_filled, thousands

OUT = "id string, chat_id string, text string, button_url string"


def listing_card(title: Column, year: Column, mileage: Column, price: Column, region: Column, search: Column, label: Column, currency: Column | str = "UAH") -> Column:
    """A listing's message: five lines with simple markup. Nulls are shown as nothing."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shown = first_filled(currency.cast("string"), F.lit("UAH")) if isinstance(currency, Column) else F.lit(currency)
    return F.concat(
        F.lit("🚗 <b>"), text(title), F.lit("</b>\n📅 "), text(year), F.lit(" · 🛣 "), text(thousands(mileage)), F.lit(" км · 📍 "), text(region),
        F.lit("\n💰 <b>"), text(card_price(price, shown)), F.lit("</b>\n🔍 Запит: «"), text(search), F.lit("»\n📡 "), text(label),
    )


def button_url(url: Column, site: str) -> Column:
    """The listing's address, or the site's."""
    return first_filled(url, F.lit(site))


def _outbox(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{path}/sent")
    return hadoop, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def deliver(cards: DataFrame, batch: int, path: str) -> bool:
    """Put a batch of cards (``OUT`` and created_at) into the outbox, each notification once for all batches; False if this batch is there already.

    The batch is written aside and put in its place, named by its number, with one rename: it is there whole or not at all, and when a
    stream repeats a batch after a crash between the two, it finds it done. A notification of an earlier batch isn't sent again; as
    notifications lie by the day they were made, only the days of this batch are looked up. Of repeated ids in a batch one is sent.
    Cards without an id or a chat are not sent.
    """
    spark = cards.sparkSession
    hadoop, fs, folder = _outbox(spark, path)
    place = hadoop.Path(folder, f"batch={batch}")
    if fs.exists(place):
        return False
    rows = cards.where("id IS NOT NULL AND chat_id IS NOT NULL").select("id", "chat_id", "text", "button_url", F.to_date("created_at").alias("day")).dropDuplicates(["id"])
    if fs.exists(folder) and fs.listStatus(folder):
        days = [r[0] for r in rows.select("day").distinct().collect()]  # of one batch: few
        sent = spark.read.schema(f"{OUT}, batch long, day date").parquet(f"{path}/sent").where(F.col("day").isin(*days) if days else F.lit(False))
        rows = rows.join(sent.select("id"), "id", "left_anti")
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    rows.write.partitionBy("day").parquet(aside)
    fs.mkdirs(folder)
    if not fs.rename(hadoop.Path(aside), place):
        raise RuntimeError(f"{path} has a batch {batch} already")
    return True


def sent_cards(spark: SparkSession, path: str) -> DataFrame:
    """All that was delivered, with its batch and day."""
    return spark.read.schema(f"{OUT}, batch long, day date").parquet(f"{path}/sent")


def deliver_stream(cards: DataFrame, path: str, checkpoint: str, deliver_batch: Callable[[DataFrame, int, str], object] = deliver):
    """Start delivering a streamed table of cards until its source has no more."""
    return cards.writeStream.foreachBatch(lambda df, n: deliver_batch(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
