"""Quality of frames, incrementally: what is new is measured once, and frames far from their source's norm are named.

A frame is a row of a text table, its source the recording that it belongs to. New files are taken by a file stream
with a checkpoint, so a run measures only what no run has seen. Of each new frame five whole numbers are taken from its
text (words, letters, different words, length of words, repeated lines). A source's norm is the median and the median
absolute deviation of each measure over all its frames so far; a frame is out where a measure is more than ``spread``
robust standard deviations away (plain ones where the deviation is 0). Norms move when a source grows, so all frames of
the partitions that a batch touches are judged again, from their measures and not from their texts.

    FOLDER/checkpoint       the stream's mark
    FOLDER/measures         part=, batch=: the measures of each batch's frames
    FOLDER/norms            part=: n, median, MAD and limits by source and measure
    FOLDER/quality          part=: every frame with its measures and the names of those that are out

A batch replaces whole partitions of its own number, then judges; one that is cut short is taken again by the next
run with the same files and the same result, however often. Whatever the batches, the tables end up the same.

Cases: a null text has no words and zero measures; a null or empty source is "none"; a repeated row is a frame of its
own; files that are changed in place are not read again; further columns are ignored.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from kinegrid.operators import ranks
from kinegrid.operators.windows import MAD

LOG = logging.getLogger("jobs.frame_quality")
INPUT = "doc_id long, text string, source string"
MEASURES = ["n_words", "letters", "distinct_words", "word_length", "repeated_lines"]
FRAMES = "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES)


@dataclass(frozen=True)
class Settings:
    spread: float = 3.5
    parts: int = 16
    files: int = 1000


def measured(frames: DataFrame, parts: int) -> DataFrame:
    """(doc_id, source, measures, part): whole numbers only, so that every order statistic of them is exact."""
    text = F.coalesce("text", F.lit(""))
    word = F.lit(r"[^\x20\x09-\x0D]+")
    words, lines = F.regexp_extract_all(text, word, F.lit(0)), F.split(text, "\n", -1)
    n, chars = F.size(words), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    part_of = lambda a, b, scale: F.when(b > 0, F.floor(F.lit(scale) * a / b)).otherwise(0).cast("long")
    source = F.when(F.coalesce("source", F.lit("")) == "", "none").otherwise(F.col("source"))
    return frames.select(
        "doc_id", source.alias("source"), n.cast("long").alias("n_words"),
        part_of(F.regexp_count(text, F.lit(r"\p{L}")), chars, 1000).alias("letters"),
        part_of(F.size(F.array_distinct(words)), n, 1000).alias("distinct_words"),
        part_of(chars, n, 100).alias("word_length"),
        (F.lit(1000) - part_of(F.size(F.array_distinct(lines)), F.size(lines), 1000)).alias("repeated_lines"),
    ).withColumn("part", F.pmod(F.crc32("source"), F.lit(parts)).cast("int"))


def norms(frames: DataFrame, spread: float) -> DataFrame:
    """(part, source, measure, n, median, mad, low, high) over the given frames."""
    keys = ["part", "source", "measure"]
    each = F.explode(F.create_map(*(c for m in MEASURES for c in (F.lit(m), F.col(m)))))
    values = frames.select("part", "source", each.alias("measure", "v"))
    middle = ranks.group_quantiles(values, keys, "v", {"median": 0.5}).drop("n")
    away = values.join(middle, keys).withColumn("away", F.abs(F.col("v") - F.col("median")))
    mad = ranks.group_quantiles(away, keys, "away", {"mad": 0.5}).drop("n")
    # sums of whole numbers are exact: the order in which tasks add doesn't show
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = values.groupBy(*keys).agg(F.count("*").alias("n"), exact(F.col("v")).alias("s1"), exact(F.col("v") * F.col("v")).alias("s2"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("n") * F.col("s2") - F.col("s1") * F.col("s1"))) / F.col("n")
    wide = F.lit(spread) * F.when(F.col("mad") > 0, F.lit(MAD) * F.col("mad")).otherwise(sd)
    return sums.join(middle, keys).join(mad, keys).select(*keys, "n", "median", "mad", (F.col("median") - wide).alias("low"), (F.col("median") + wide).alias("high"))


def judged(frames: DataFrame, limits: DataFrame) -> DataFrame:
    """Frames with ``n_out`` and ``reasons``, the measures that are out, in their order."""
    of = limits.groupBy("part", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("limits"))  # five entries a source

    def out(m: str) -> Column:
        limit = F.col("limits")[m]
        return F.when((F.col(m) < limit["low"]) | (F.col(m) > limit["high"]), m)

    reasons = F.array_compact(F.array(*(out(m) for m in MEASURES)))
    return frames.join(of, ["part", "source"]).select("doc_id", "source", *MEASURES, F.size(reasons).cast("long").alias("n_out"), F.array_join(reasons, ",").alias("reasons"), "part")


def run(spark: SparkSession, source: str, output: str, config: Settings = Settings()) -> DataFrame:
    """Take what is new at ``source`` and bring ``output`` up to date; the whole quality table."""
    measures, limits, quality = (f"{output}/{x}" for x in ("measures", "norms", "quality"))

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession  # the stream's
        with common.joined_by_size(own):
            new = measured(batch, config.parts).withColumn("batch", F.lit(number))
            common.put(new, measures, ["part", "batch"])
            known = own.read.schema(f"{FRAMES}, part int, batch long").parquet(measures)
            LOG.info("read %s, batch %d", source, number)
            if not common.counted(known, measures, LOG, batch=number):
                return
            touched = [r["part"] for r in known.where(F.col("batch") == number).select("part").distinct().collect()]  # config.parts at most
            frames = known.where(F.col("part").isin(touched)).drop("batch")
            common.put(norms(frames, config.spread), limits, ["part"])
            common.put(judged(frames, own.read.schema(NORMS).parquet(limits).where(F.col("part").isin(touched))), quality, ["part"])
            for r in own.read.schema(QUALITY).parquet(quality).where(F.col("part").isin(touched)).groupBy("part").count().orderBy("part").collect():
                LOG.info("%s: %d rows, part %d", quality, r["count"], r["part"])

    # a stream can't be given a single file, but a pattern that only this file matches
    plain = source.rstrip("/")
    pattern = source if set("*?[{") & set(source) else f"{plain[:-1]}[{plain[-1]}]"
    new = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", config.files).parquet(pattern)
    stream = new.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return common.existing(spark, quality, QUALITY)


QUALITY = f"{FRAMES}, n_out long, reasons string, part int"
NORMS = "source string, measure string, n long, median double, mad double, low double, high double, part int"


if __name__ == "__main__":
    common.main("frame_quality", __doc__.splitlines()[0], Settings, run)
