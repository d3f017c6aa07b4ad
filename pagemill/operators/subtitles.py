"""Subtitle files to cues and transcripts, and the choice of a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import collapse, strip

KEY, MAX_CUES = ["video_id", "lang"], 4000
_TIME = r"^\s*(?:(\d{2}):)?(\d{2}):(\d{2})(?:[.,]\d{1,3})?\s*-->"


def _file():
    return W.partitionBy(*KEY)


def parse_cue_start(line: Column) -> Column:
    """HH:MM:SS of a time line, else null."""
    h = F.regexp_extract(line, _TIME, 1)
    return F.when(line.rlike(_TIME), F.concat(F.when(h == "", "00").otherwise(h), F.lit(":"), F.regexp_extract(line, _TIME, 2), F.lit(":"), F.regexp_extract(line, _TIME, 3)))


def _cues(files: DataFrame, skip: Column) -> DataFrame:
    """Groups start at a blank or time line; a group counts if it starts with a time line and a blank line or the end follows."""
    lines = files.select(*KEY, F.posexplode(F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    start = parse_cue_start(F.col("line"))
    lines = lines.filter(~skip).withColumn("start", start).withColumn("edge", (F.col("line") == "") | F.col("start").isNotNull())
    lines = lines.withColumn("g", F.sum(F.col("edge").cast("int")).over(_file().orderBy("n")))
    text = F.array_sort(F.collect_list(F.when(~F.col("edge"), F.struct("n", "line"))))
    groups = lines.groupBy(*KEY, "g").agg(F.max("start").alias("start"), text.alias("t"))
    after = F.lead(F.struct(F.col("start"))).over(_file().orderBy("g"))
    groups = groups.withColumn("next", after).filter("start is not null and size(t) > 0 and (next is null or next.start is null)")
    plain = collapse(F.regexp_replace(F.array_join(F.transform("t", lambda x: x["line"]), " "), "<[^>]+>", ""))
    return groups.select(*KEY, F.col("g").alias("pos"), "start", plain.alias("text")).filter("text != ''")


def srt_cues(files: DataFrame) -> DataFrame:
    return _cues(files, F.col("line").rlike(r"^\d+$"))


def vtt_cues(files: DataFrame) -> DataFrame:
    line = F.col("line")
    return _cues(files, (line == "WEBVTT") | line.startswith("NOTE") | line.startswith("STYLE") | line.startswith("Kind:") | line.startswith("Language:"))


def normalize_cues(cues: DataFrame, most: int = MAX_CUES) -> DataFrame:
    """The first cues, then without repeats of the one before."""
    df = cues.withColumn("i", F.row_number().over(_file().orderBy("pos"))).filter(F.col("i") <= most)
    prev = F.lag(F.struct("start", "text")).over(_file().orderBy("pos"))
    return df.withColumn("prev", prev).filter("prev is null or prev.start != start or prev.text != text").drop("prev", "i")


def _joined(df: DataFrame, line: str, name: str) -> DataFrame:
    made = df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(line).alias("l")))).alias("a"))
    return made.select(*KEY, F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias(name))


def transcript_plain(cues: DataFrame) -> DataFrame:
    prev = F.lag("text").over(_file().orderBy("pos"))
    return _joined(cues.withColumn("prev", prev).filter("prev is null or prev != text"), "text", "transcript")


def transcript_timestamped(cues: DataFrame) -> DataFrame:
    return _joined(cues.withColumn("l", F.concat(F.lit("["), "start", F.lit("] "), "text")), "l", "transcript")


#: The bar of a document's head, the names of its section, and the line that stands for times that aren't there.
_BAR, _SECTIONS, NO_TIMES = "=" * 80, ("Transcript", "Transcript With Timestamp"), "[00:00:00] Timestamp tidak tersedia dari sumber subtitle."


def subtitle_documents(videos: DataFrame, plain: DataFrame, timed: DataFrame, include_timestamp: bool = True) -> DataFrame:
    """video_id, lang, markdown, text: both documents of a transcript.

    videos: video_id, lang, title, source. A head between bars, title, source and language, then one section: the timed transcript,
    or a placeholder where it is empty, or else the plain one.
    """
    said = strip(F.coalesce("transcript", F.lit("")))
    section = F.nullif(said, F.lit("")) if include_timestamp else said
    df = videos.join(timed if include_timestamp else plain, KEY, "left").withColumn("__said", F.coalesce(section, F.lit(NO_TIMES)) if include_timestamp else section)
    named = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    title, source, lang = F.coalesce("title", F.lit("")), F.col("source"), F.col("lang")

    def made(mark: str, section_mark: str) -> Column:
        head = [F.lit(_BAR), named("TITLE", title), named("SOURCE", source), named("LANGUAGE", lang), F.lit(_BAR), F.lit("")]
        body = [F.concat(F.lit(mark), title), F.lit(""), named("Source", source), F.lit(""), named("Language", lang), F.lit(""), F.lit(section_mark + _SECTIONS[include_timestamp]), F.lit(""), F.col("__said"), F.lit(""), F.lit("")]
        return F.concat_ws("\n", *head, *body)

    return df.select(*KEY, made("# ", "## ").alias("markdown"), made("", "").alias("text"))


def subtitle_languages(meta: DataFrame) -> DataFrame:
    """video_id, rank, code, has_manual, has_auto from the maps manual and auto; manual first, then code."""
    names = lambda c: F.array_distinct(F.filter(F.transform(F.map_keys(c), lambda x: F.trim(x)), lambda x: x != ""))
    df = meta.select("video_id", names("manual").alias("m"), names("auto").alias("a"))
    df = df.select("video_id", "m", "a", F.explode(F.array_union("m", "a")).alias("code"))
    df = df.select("video_id", "code", F.array_contains("m", F.col("code")).alias("has_manual"), F.array_contains("a", F.col("code")).alias("has_auto"))
    order = W.partitionBy("video_id").orderBy(F.col("has_manual").desc(), "code")
    return df.withColumn("rank", F.row_number().over(order))


def preferred_languages(languages: DataFrame, originals: DataFrame, k: int = 3) -> DataFrame:
    """video_id, choice, code: original, en, id matched exactly or by base part; else the first k."""
    base = lambda c: F.split_part(F.lower(F.replace(c, F.lit("_"), F.lit("-"))), F.lit("-"), F.lit(1))
    want = originals.select("video_id", F.posexplode(F.array(F.col("original"), F.lit("en"), F.lit("id"))).alias("w", "target")).filter("target is not null")
    hit = languages.join(want, "video_id").withColumn("exact", F.lower(F.replace("code", F.lit("_"), F.lit("-"))) == F.lower(F.replace("target", F.lit("_"), F.lit("-")))).filter(F.col("exact") | (base(F.col("code")) == base(F.col("target"))))
    best = hit.groupBy("video_id", "w").agg(F.min(F.struct(~F.col("exact"), "rank", "code")).alias("b")).groupBy("video_id", F.col("b.code").alias("code")).agg(F.min("w").alias("choice"))
    rest = languages.filter(F.col("rank") <= k).join(best.select("video_id").distinct(), "video_id", "left_anti").select("video_id", "code", (F.col("rank") - 1).alias("choice"))
    return best.select("video_id", "code", "choice").unionByName(rest).withColumn("choice", F.row_number().over(W.partitionBy("video_id").orderBy("choice")))


def original_language(languages: DataFrame, told: DataFrame) -> DataFrame:
    """video_id, code: the told language where it is there (exactly or by its base part), else the first manual one, else the first."""
    base = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    plain = lambda c: F.lower(F.replace(F.trim(c), F.lit("_"), F.lit("-")))
    df = languages.join(told.select("video_id", F.nullif(plain("original"), F.lit("")).alias("t")), "video_id", "left").withColumn("c", plain("code"))
    place = F.when(F.col("c") == F.col("t"), 0).when(base(F.col("c")) == base(F.col("t")), 1).when(F.col("has_manual"), 2).otherwise(3)
    return df.groupBy("video_id").agg(F.min_by("code", F.struct(place, "rank")).alias("code"))


def best_language(languages: DataFrame, originals: DataFrame) -> DataFrame:
    return preferred_languages(languages, originals).filter("choice = 1").select("video_id", "code")
