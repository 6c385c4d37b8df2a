"""A search index on disk: tokens with the rows that have them, kept up module by module."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import fts_phrases, fts_text
from folium.shared import exists

#: Index rows of a file, and of a module that is kept in one folder rather than in one for each beginning of a token.
FILE_ROWS, SMALL = 500_000, 100_000
#: The folder in which every row stands once, for searches without a word, and that of all tokens of a small module.
ALL, WHOLE = "_", "~"
KEY = ["module_id", "link"]


class SearchIndex:
    """Catalog rows under each of their tokens, in folders by version of a module and by a token's first two characters.

    A module's tokens are replaced by a new version beside the old one; a line in ``_parts`` then makes it the one that
    counts, so that searches see the old version or the new one, and a write that died half-way is not seen at all.
    Modules of few tokens have one folder. Folders hold files of bounded size, ordered by token: a common beginning is
    many files, and a search reads only those whose range has its word.

    Each index row has the catalog row and its folded text, so that a search is one narrow scan: by the longest word, then
    all words as phrases on the text that was stored; nothing is folded again and nothing is joined.
    """

    def __init__(self, spark: SparkSession, root: str, listing: DataFrame) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.columns = listing.columns
        rows = self._tokens(listing.limit(0))
        self.schema = rows.schema
        self.refresh()

    @staticmethod
    def _tokens(listing: DataFrame) -> DataFrame:
        d = listing.withColumn("_texts", F.array(fts_text(F.col("title")), fts_text(F.col("alttitles"))))
        tokens = F.filter(F.array_distinct(F.flatten(F.transform("_texts", lambda t: F.split(F.trim(t), " ")))), lambda t: t != "")
        return d.withColumn("token", F.explode(F.concat(F.array(F.lit("")), tokens)))

    def refresh(self) -> None:
        """See the versions that count now."""
        newest = []
        if exists(self.spark, f"{self.root}/_parts"):
            lines = self.spark.read.schema("module string, part string, at long").json(f"{self.root}/_parts")
            newest = lines.groupBy("module").agg(F.max_by("part", "at").alias("part")).collect()  # a line a module
        self.parts = {r.module: r.part for r in newest if r.part}
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.table = self.spark.read.schema(f"{kinds}, part string, prefix string").parquet(f"{self.root}/tokens") if self.parts else None

    def replace(self, rows: DataFrame, modules: list[str] | None = None) -> None:
        """Make ``rows`` all there is of their modules; modules that are named and have no rows are emptied."""
        version = uuid.uuid4().hex
        d = self._tokens(rows).withColumn("_start", F.when(F.col("token") == "", ALL).otherwise(F.substring("token", 1, 2)))
        # how many files a module's beginnings take: a row for each of them
        sizes = d.groupBy("module_id", "_start").agg(F.count("*").alias("n")).groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("_start", "n"))).alias("sizes"), F.sum("n").alias("_all"))
        d = d.join(sizes, "module_id")
        small = F.col("_all") <= SMALL
        d = d.withColumn("prefix", F.when((F.col("_start") == ALL) | ~small, F.col("_start")).otherwise(WHOLE)).withColumn("part", F.concat(F.col("module_id").cast("string"), F.lit(f"@{version}")))
        files = F.when(small, 1).otherwise(F.ceil(F.col("sizes")[F.col("_start")] / FILE_ROWS))
        # rows of one file lie together; within a folder files are dealt by row, and each is ordered by token
        d = d.withColumn("_file", F.pmod(F.xxhash64("link"), files)).drop("sizes", "_all", "_start")
        d = d.repartition("part", "prefix", "_file").sortWithinPartitions("part", "prefix", "token", "link").drop("_file")
        d.write.mode("append").partitionBy("part", "prefix").parquet(f"{self.root}/tokens")
        there = [r[0] for r in rows.select(F.col("module_id").cast("string")).distinct().collect()]  # a module a row
        lines = [(m, f"{m}@{version}") for m in there] + [(str(m), "") for m in modules or [] if str(m) not in there]
        if lines:
            made = self.spark.createDataFrame(lines, "module string, part string").withColumn("at", F.unix_micros(F.current_timestamp()))
            made.coalesce(1).write.mode("append").json(f"{self.root}/_parts")
        self.refresh()

    def search(self, query: str, modules: list[str] | None = None) -> DataFrame:
        """The catalog rows of the modules that count, or of some of them, with every word of ``query`` as a phrase prefix."""
        parts = sorted(p for m, p in self.parts.items() if modules is None or m in set(map(str, modules)))
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        d = self.table.where(F.col("part").isin(parts))
        phrases = fts_phrases(query)
        if not phrases:
            return d.where(F.col("prefix") == ALL).select(*self.columns)
        # words that end in a phrase's last token are prefixes, the others whole; the longest says most
        words = [(t, i + 1 == len(ts)) for ts in map(str.split, phrases) for i, t in enumerate(ts)]
        token, prefix = max(words, key=lambda w: len(w[0]))
        starts = F.col("prefix").startswith(token) if len(token) < 2 else F.col("prefix") == token[:2]
        d = d.where((starts & (F.col("prefix") != ALL)) | (F.col("prefix") == WHOLE))
        d = d.where(F.col("token").startswith(token) if prefix else F.col("token") == token)
        match = lambda p: F.exists("_texts", lambda t: F.contains(t, F.lit(p)))
        hits = d.where(reduce(Column.__and__, map(match, phrases)))
        # a row with two tokens of one beginning stands there twice: the least of them counts
        least = F.array_min(F.filter(F.flatten(F.transform("_texts", lambda t: F.split(F.trim(t), " "))), lambda t: F.startswith(t, F.lit(token))))
        return (hits.where(F.col("token") == least) if prefix else hits).select(*self.columns)
