"""The hashes that earlier batches and runs kept, behind bitmaps that tell where to look.

A hash owns one bit of a fixed number of bitmaps (slots), and neighbouring slots make a bucket. The hashes lie in
folders by bucket; a batch first asks the bitmaps and then reads only buckets in which one of its bits is set, so
what a batch of new hashes reads does not grow with the history. Of new hashes, about the share of bits set meets
a set bit by chance; that costs a read, never a wrong answer. ``slots`` fixes the size (4 KB each) and stays the
same for the life of a table.

A batch writes the bits of what it kept; the first batch of an epoch folds those of the epoch before into one set.
Files lie under the run and number of their batch, so a repeated batch replaces its own. What other runs kept is
folded once, when a run starts or goes on. Runs over one table take turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.session import fresh_path, spread

SLOT_BITS = 32768  # what one bitmap of the built-in functions holds
HASHES = "hash string, bucket int, run string, batch long"
BITS = "slot int, bits binary"
FOLDED = -1  # the step of what an epoch starts with


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, bit.bitwiseAND(7)) == 1


def merged(bits: DataFrame) -> DataFrame:
    return bits.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits"))


@dataclass(frozen=True)
class SeenSet:
    spark: SparkSession
    out: str
    run: str
    others: str  # bits of the other runs, folded when this one started
    slots: int
    buckets: int
    epoch: int  # batches between two foldings

    def spots(self, hashes: DataFrame) -> DataFrame:
        """``hash, slot, bit, bucket`` of the distinct hashes; null is one of them."""
        spot = F.pmod(F.xxhash64("hash"), F.lit(self.slots * SLOT_BITS))
        placed = hashes.select("hash").distinct().select(
            "hash", F.floor(spot / SLOT_BITS).cast("int").alias("slot"), (spot % SLOT_BITS).cast("int").alias("bit"))
        return placed.withColumn("bucket", F.floor(F.col("slot") * self.buckets / self.slots).cast("int"))

    def _place(self, epoch: int, step: int) -> str:
        return f"{self.out}/bits/run={self.run}/epoch={epoch}/step={step}"

    def _parts(self, epoch: int, until: int) -> list[str]:
        """Where the bits lie that this run's batches before ``until`` set, as of an epoch."""
        start = [self._place(epoch, FOLDED)] if epoch else []
        return start + [self._place(epoch, n) for n in range(epoch * self.epoch, until)]

    def fold(self, number: int) -> None:
        """Start an epoch, if batch ``number`` is its first."""
        epoch = number // self.epoch
        if epoch and number % self.epoch == 0:
            before = self.spark.read.schema(BITS).parquet(*self._parts(epoch - 1, number))
            merged(before).write.mode("overwrite").parquet(self._place(epoch, FOLDED))

    def may_hold(self, hashes: DataFrame, number: int) -> list[int]:
        """Buckets in which a hash may have been kept before batch ``number``; one small number for each bucket."""
        parts = [self.others] + self._parts(number // self.epoch, number)
        bits = self.spark.read.schema(BITS).parquet(*parts)
        met = self.spots(hashes).join(bits, "slot").where(_is_set(F.col("bits"), F.col("bit")))
        return sorted(r["bucket"] for r in met.select("bucket").distinct().collect())

    def earlier(self, hashes: DataFrame, number: int) -> DataFrame:
        """``hash``: what was kept before batch ``number``, of all buckets that may hold one of ``hashes``."""
        places = [f"{self.out}/seen/bucket={b}" for b in self.may_hold(hashes, number)]
        if not places:
            return self.spark.createDataFrame([], "hash string")
        kept = self.spark.read.schema(HASHES).option("basePath", f"{self.out}/seen").parquet(*places)
        return kept.where((F.col("run") != self.run) | (F.col("batch") < number)).select("hash")

    def add(self, hashes: DataFrame, number: int) -> None:
        """Enter what batch ``number`` kept: the hashes first, so that a set bit always leads to a folder."""
        spots = self.spots(hashes)
        rows = spots.select("hash", "bucket", F.lit(self.run).alias("run"), F.lit(number).cast("long").alias("batch"))
        (spread(rows, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "run", "batch").parquet(f"{self.out}/seen"))
        bits = spots.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits.write.mode("overwrite").parquet(self._place(number // self.epoch, number))


def open_seen(spark: SparkSession, out: str, run: str, slots: int = 4096, buckets: int = 64,
              epoch: int = 16) -> SeenSet:
    """The seen set below ``out`` as ``run`` goes on with it; ``buckets`` divides ``slots``."""
    spark.createDataFrame([], f"{BITS}, run string, epoch long, step long").write.mode("append").partitionBy(
        "run", "epoch", "step").parquet(f"{out}/bits")
    every = spark.read.schema(f"{BITS}, run string, epoch long, step long").parquet(f"{out}/bits").where(
        F.col("run") != run)
    # an epoch counts once a batch of its own is there: what it starts with is whole by then
    last = every.where(F.col("step") > FOLDED).groupBy("run").agg(F.max("epoch").alias("epoch"))
    others = fresh_path(spark, "bits")
    merged(every.join(last, ["run", "epoch"]).select("slot", "bits")).write.parquet(others)
    return SeenSet(spark, out, run, others, slots, buckets, epoch)
