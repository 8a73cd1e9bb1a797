"""Forked sessions: lineage, parent lookup and the prefix a fork replays from its parent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions import variants as V
from tokentide.session import MAX_BROADCAST_ROWS, broadcast_if_small, row_count_up_to, stage

BLOCK_LINES = 1024
# Length of the substrings that lead from an id to the file names with it.
GRAM = 8
# Bits of the broadcast filter for many wanted substrings (8 MB), and words of 64 bits in one of its rows.
FILTER_BITS, FILTER_WORDS = 1 << 26, 512


def lineage(events: DataFrame) -> DataFrame:
    """Per file, the ids of a leading `session_meta` line and of the one right after it.

    Two leading ids make a fork: its own id, then its parent's.
    """
    heads = events.where((F.col("line_no") <= 2) & (F.col("event_type") == "session_meta"))
    return heads.groupBy("file_path").agg(
        F.max(F.when(F.col("line_no") == 1, F.col("meta_id"))).alias("first_id"),
        F.max(F.when(F.col("line_no") == 2, F.col("meta_id"))).alias("second_id"),
    )


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of one length; none if the text is shorter."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size))
    return F.when(F.length(text) >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _only_wanted(named: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of `named` whose gram is wanted; of many wanted grams a few others may pass too.

    Names have many more substrings than are wanted, so they are told apart before any is shuffled: by the wanted grams
    themselves while these are few, else by one bit for each gram's hash.
    """
    if row_count_up_to(grams, MAX_BROADCAST_ROWS) <= MAX_BROADCAST_ROWS:
        return named.join(F.broadcast(grams), "gram", "left_semi")
    bit = F.pmod(F.xxhash64("gram"), F.lit(FILTER_BITS))
    mask = F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("mask")
    words = grams.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(mask)
    every = grams.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    masks = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))), lambda x: x["mask"])
    rows = every.groupBy(F.expr(f"word div {FILTER_WORDS}").alias("row")).agg(masks.alias("masks"))
    tested = named.withColumn("bit", bit).withColumn("row", F.expr(f"bit div {64 * FILTER_WORDS}")).join(F.broadcast(rows), "row")
    mask = F.get("masks", F.expr(f"cast(bit div 64 % {FILTER_WORDS} AS int)"))
    return tested.withColumn("mask", mask).where("shiftrightunsigned(mask, cast(bit % 64 AS int)) & 1 = 1").select(*named.columns)


def _by_name(missing: DataFrame, all_files: DataFrame) -> DataFrame:
    """First file whose name starts with `rollout-` and contains the wanted id.

    A name that contains an id contains all its substrings of `GRAM` characters; of these the one that the fewest names have leads to
    the names, which are then checked. Ids of at most that length are looked up whole. Names give one row per character and
    length of ids up to `GRAM`, however long the ids are.
    """
    ids = missing.where(F.length("parent_session_id") > 0).select("parent_session_id").distinct()
    size = F.least(F.length("parent_session_id"), F.lit(GRAM))
    wanted = stage(ids.select("parent_session_id", size.alias("n"), F.explode(_grams(F.col("parent_session_id"), size)).alias("gram")), "idgrams")
    lengths = [r[0] for r in wanted.select("n").distinct().collect()]  # GRAM values at most
    if not lengths:
        return missing.select("parent_session_id", F.lit(None).cast("string").alias("named_path")).limit(0)
    names = all_files.where(F.col("file_name").startswith("rollout-")).select("file_path", "file_name")
    grams = F.concat(*[_grams(F.col("file_name"), F.lit(n)) for n in sorted(lengths)])
    named = names.select("file_path", "file_name", F.explode(grams).alias("gram"))
    named = stage(_only_wanted(named, wanted.select("gram").distinct()), "namegrams")
    counts = named.groupBy("gram").agg(F.count("*").alias("names"), F.min("file_path").alias("first_path"))
    rare = wanted.join(counts, "gram", "left").groupBy("parent_session_id", "n").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram", "first_path")).alias("r")
    )
    rare = stage(rare.where("r.names > 0").select("parent_session_id", "r.gram", "r.first_path"), "raregrams")
    whole = F.length("parent_session_id") <= GRAM
    short = rare.where(whole).select("parent_session_id", F.col("first_path").alias("named_path"))
    long = rare.where(~whole).drop("first_path").join(named, "gram").where(F.col("file_name").contains(F.col("parent_session_id")))
    return short.unionByName(long.groupBy("parent_session_id").agg(F.min("file_path").alias("named_path")))


def parents(heads: DataFrame, all_files: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """One row per fork: its own id, its parent's id and the parent's file (null when missing).

    The parent is the first scanned file that opens with the wanted id, else the
    first file of the tree whose name contains it. A listing given as a function is made only if it is needed.
    """
    # A row per file; making it again would parse the lines again.
    heads = stage(heads.select("file_path", "first_id", "second_id"), "heads")
    forks = heads.where(F.col("first_id").isNotNull() & F.col("second_id").isNotNull()).select(
        "file_path", F.col("first_id").alias("pinned_id"), F.col("second_id").alias("parent_session_id")
    )
    owners = (
        heads.where(F.col("first_id").isNotNull())
        .groupBy(F.col("first_id").alias("parent_session_id"))
        .agg(F.min("file_path").alias("parent_path"))
    )
    found = stage(forks.join(owners, "parent_session_id", "left"), "parents")
    if all_files is None:
        return found
    missing = found.where(F.col("parent_path").isNull()).select("parent_session_id").distinct()
    if missing.isEmpty():
        return found
    named = _by_name(missing, all_files() if callable(all_files) else all_files)
    return (
        found.join(named, "parent_session_id", "left")
        .withColumn("parent_path", F.coalesce("parent_path", "named_path"))
        .drop("named_path")
    )


def fingerprint(value: Column) -> Column:
    """Hash of an event without its top-level timestamp, keys in sorted order; an invalid line
    is told apart only by its length, line end included."""
    v = V.line(value)
    fields = F.try_variant_get(v, "$[0]", "map<string,variant>")
    rest = F.to_json(F.map_filter(fields, lambda k, _: k != "timestamp"))
    text = (
        F.when(v.isNull(), F.concat(F.lit("invalid-json:"), (F.octet_length(value) + 1).cast("string")))
        .when(fields.isNotNull(), rest)
        .otherwise(F.to_json(V.at(v, "$[0]")))
    )
    return F.sha2(text, 256)


def _plain(value: Column) -> Column:
    """A line without its top-level timestamp where that shows without parsing: behind string members only.

    Lines of equal length with equal plain text have equal fingerprints; others may have.
    """
    return F.regexp_replace(value, r'^\{((?:"[^"\\]*": ?"[^"\\]*", ?)*)"timestamp": ?"[^"\\]*"', "{$1")


def _digests(tagged: DataFrame) -> DataFrame:
    """Per file, role and block of lines: their number and a 128-bit digest of their plain texts and places."""
    parts = (F.col("n"), _plain(F.col("value")), F.octet_length("value"))
    return tagged.groupBy("file_path", "shift", "block").agg(
        F.struct(F.count("*"), F.bit_xor(F.xxhash64(*parts)), F.bit_xor(F.xxhash64(F.lit("second"), *parts))).alias("digest"), F.max("n").alias("last")
    )


def _first_bad(tagged: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_path, bad): the first line of the given (file_path, parent_path, block) whose fingerprint is not the parent's; null if none."""
    wanted = blocks.select("file_path", F.lit(1).alias("shift"), "block").unionByName(
        blocks.select(F.col("parent_path").alias("file_path"), F.lit(0).alias("shift"), "block").distinct()
    )
    prints = tagged.join(broadcast_if_small(wanted), ["file_path", "shift", "block"])
    prints = stage(prints.select("file_path", "shift", "n", fingerprint(F.col("value")).alias("fp")), "prints")
    pairs = blocks.select("file_path", "parent_path").distinct()
    children = prints.where("shift = 1").join(broadcast_if_small(pairs), "file_path").select("file_path", "parent_path", "n", "fp")
    source = prints.where("shift = 0").select(F.col("file_path").alias("parent_path"), "n", F.col("fp").alias("parent_fp"))
    differs = F.col("parent_fp").isNull() | (F.col("parent_fp") != F.col("fp"))
    return children.join(source, ["parent_path", "n"], "left").groupBy("file_path").agg(F.min(F.when(differs, F.col("n"))).alias("bad"))


def replay_prefix(
    found: DataFrame, lines: DataFrame, parent_lines: DataFrame | None = None, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Adds `replay_prefix_lines` to forks: how many leading lines repeat the parent.

    Child line n + 1 meets parent line n. Blocks of lines are digested first, without parsing, and meet on (parent file, block);
    only the first block that differs is compared line by line. Where its lines turn out equal all the same
    (keys in another order), the later blocks that differ follow at once. A long file or a much-forked parent spreads over its blocks.
    """
    pairs = found.where(F.col("parent_path").isNotNull()).select("file_path", "parent_path")
    roles = pairs.select("file_path", F.lit(1).alias("shift")).unionByName(
        pairs.select(F.col("parent_path").alias("file_path"), F.lit(0).alias("shift")).distinct()
    )
    roles = broadcast_if_small(roles)
    every = [lines] if parent_lines is None else [lines, parent_lines]
    parts = [x.select("file_path", "line_no", "value").join(roles, "file_path") for x in every]
    tagged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1].where("shift = 0"))
    tagged = tagged.withColumn("n", F.col("line_no") - F.col("shift")).where("n >= 1")
    tagged = tagged.withColumn("block", F.expr(f"(n - 1) div {block_lines}")).drop("line_no")

    digests = stage(_digests(tagged), "digests")
    mine = digests.where("shift = 1").join(broadcast_if_small(pairs), "file_path").select("file_path", "parent_path", "block", "digest", "last")
    source = digests.where("shift = 0").select(F.col("file_path").alias("parent_path"), "block", F.col("digest").alias("parent_digest"))
    compared = stage(mine.join(source, ["parent_path", "block"], "left").withColumn("same", F.coalesce(F.col("digest") == F.col("parent_digest"), F.lit(False))), "blocks")
    ends = compared.groupBy("file_path", "parent_path").agg(
        F.min(F.when(~F.col("same"), F.col("block"))).alias("block"), F.max("last").alias("last"), F.max(F.when(~F.col("same"), F.col("block"))).alias("last_block")
    )
    first = ends.where(F.col("block").isNotNull())
    bad = stage(_first_bad(tagged, first.select("file_path", "parent_path", "block")), "bad")
    # Blocks that differ in spelling only: the rest is compared at once.
    open_ = bad.where("bad IS NULL").join(ends.where("last_block > block"), "file_path")
    if not open_.isEmpty():
        later = compared.where(~F.col("same")).join(open_.select("file_path", F.col("block").alias("done")), "file_path").where("block > done")
        bad = bad.where("bad IS NOT NULL").unionByName(_first_bad(tagged, later.select("file_path", "parent_path", "block")))
    matched = F.coalesce(F.col("bad") - 1, F.col("last"))
    counted = ends.join(bad, "file_path", "left").select("file_path", F.when(matched > 0, matched + 1).otherwise(0).alias("replay_prefix_lines"))
    return found.join(counted, "file_path", "left").withColumn(
        "replay_prefix_lines", F.coalesce("replay_prefix_lines", F.lit(0))
    )


def fork_counters(forks: DataFrame) -> DataFrame:
    return forks.agg(
        F.count("*").alias("fork_files"),
        F.count_if(F.col("parent_path").isNull()).alias("fork_parent_missing"),
        F.coalesce(F.sum(F.greatest(F.col("replay_prefix_lines") - 1, F.lit(0))), F.lit(0)).alias("fork_replay_lines"),
    )

