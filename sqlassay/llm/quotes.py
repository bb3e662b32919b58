"""Conversations in reply order, rebuilt from quotations.

A message's lines that begin with ``>`` are quotes; each further ``>`` is a level. A maximal
run of lines of one level is a passage; what is left without marks and without the line that
announces a quote ("... wrote:") is the message's own text, whose blocks between quotes are
its own passages. Passages are compared by the digests of their words (lower case): whole, line
by line, sentence by sentence, and in all windows of ``WINDOW`` words, at every level. A
quoted passage belongs to the first earlier message of the conversation that states it as a block,
line or sentence; if none does, it has been trimmed, and it belongs to the latest message that first
stated one of its windows, or else one of its lines or sentences. A message replies to the latest
message that its quotes belong to on the outermost level that has a linked one. Messages
without a linked quote start a thread of their own, in the order of turns.

A thread's root and a message's depth are found by pointer doubling, so a chain of n replies
takes log2 n joins. The reply order is (root_turn, depth, turn); ``formatted`` writes it
range-sorted, so no conversation is gathered in one row or task.

Defined cases: a null or empty text has no passages and an empty own text; a quote without a
source, or one that quotes only later messages, links to nothing; a passage without a word is
no passage; a part of a line that is neither a sentence nor ``WINDOW`` words long links to nothing; rows with a null conv_id or turn start a thread and are never a source; rows that
repeat a (conv_id, turn) are one message to those that quote them and each come out; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions.rows import let
from sqlassay.session import landed

#: Fixed value: how a mail program announces a quote.
ANNOUNCES = r"(?i)\bwrote:\s*$"
#: Fixed value: so many words in a row tell a passage's source.
WINDOW = 5
_SENTENCE_END = r"(?<=[.!?…])\s+|(?<=[。！？])"
_MARKS = r"^\s{0,3}((?:>\s?)+)"


def _parsed(text: Column) -> Column:
    """The text's runs: arrays of lines of one quote level, in order."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 1)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda line: F.struct(
        F.length(F.regexp_replace(marks(line), r"[^>]", "")).alias("level"), F.regexp_replace(line, _MARKS, "").alias("line")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines and, per run of one level, an array of (level, words)."""
    rows = messages.select("conv_id", "turn", "role", _parsed(F.col("text")).alias("lines"))
    level = lambda i: F.get(F.col("lines"), i)["level"]
    # A line that announces a quote belongs to none.
    marked = F.transform("lines", lambda line, i: F.struct(
        F.when(line["line"].rlike(ANNOUNCES) & (F.coalesce(level(i + 1), F.lit(0)) > line["level"]), F.lit(-1)).otherwise(line["level"]).alias("level"), line["line"].alias("line")))
    rows = rows.withColumn("lines", marked)
    first = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.withColumn("starts", first)
    ends = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines"))
    runs = F.transform("starts", lambda at, k: F.struct(level(at).alias("level"), F.transform(F.slice("lines", at + 1, ends(k) - at), lambda line: line["line"]).alias("lines")))
    return rows.withColumn("runs", runs).drop("starts")


def normal(text: Column) -> Column:
    """A passage's words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _parts(lines: Column) -> Column:
    """The words of a passage's whole, its lines and its sentences, those across line ends too."""
    block = F.array_join(lines, "\n")
    said = F.concat(F.array(block), lines, F.split(block, rf"\n|{_SENTENCE_END}", -1), F.split(F.regexp_replace(block, r"\s+", " "), _SENTENCE_END, -1))
    return F.array_distinct(F.transform(said, normal))


def _windows(words: Column) -> Column:
    """All runs of WINDOW words."""
    return let(F.split(words, " "), lambda each: F.when(F.size(each) >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size(each) - WINDOW, F.lit(0))), lambda i: F.array_join(F.slice(each, i + 1, WINDOW), " "))).otherwise(F.array().cast("array<string>")))


def _said(kind: str, words: Column, rank: int) -> Column:
    """Array of (rank, digest) of an array of words; windows are told from other parts."""
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.struct(F.lit(rank).alias("rank"), F.unhex(F.md5(F.concat(F.lit(kind), w))).alias("digest")))


def own_text(lines: str = "lines") -> Column:
    own = F.transform(F.filter(lines, lambda line: line["level"] == 0), lambda line: line["line"])
    return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own text, n_quotes (passages of all levels), n_linked and parent_turn of each message."""
    rows = passages(messages)
    rows = landed(rows.select("conv_id", "turn", "role", "runs", own_text().alias("own_text")).withColumn("message", F.monotonically_increasing_id()), "messages")
    known = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    runs = known.select("conv_id", "turn", "message", F.posexplode("runs").alias("run_no", "run")).select("conv_id", "turn", "message", "run_no", "run.level", "run.lines")
    runs = runs.withColumn("words", normal(F.array_join("lines", "\n"))).filter("words != ''")
    said = F.concat(_said("part ", F.array("words"), 0), _said("window ", _windows(F.col("words")), 1), _said("part ", _parts(F.col("lines")), 2))
    quoted = runs.filter("level >= 1").select("conv_id", "turn", "message", "run_no", "level", F.explode(said).alias("said"))
    quoted = landed(quoted.select("conv_id", "turn", "message", "run_no", "level", "said.rank", "said.digest"), "quoted")
    # Only conversations with a quote need sources.
    own = runs.filter("level = 0").join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    own = own.select("conv_id", "turn", F.explode(F.concat(_said("window ", _windows(F.col("words")), 1), _said("part ", _parts(F.col("lines")), 2))).alias("said"))
    sources = own.select("conv_id", "said.digest", "turn").groupBy("conv_id", "digest").agg(F.min("turn").alias("source"))
    hits = quoted.join(landed(sources, "sources"), ["conv_id", "digest"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    # A whole passage tells more than its windows, and these more than its lines.
    source = F.coalesce(*[F.max(F.when(F.col("rank") == rank, F.col("source"))) for rank in range(3)])
    per_run = hits.groupBy("message", "run_no", "level").agg(source.alias("source"))
    outermost = F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("level"), "source")))
    per_message = per_run.groupBy("message").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), outermost["source"].alias("parent_turn"))
    joined = rows.drop("runs").join(per_message, "message", "left")
    return joined.select("message", "conv_id", "turn", "role", "own_text", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn")


def conversations(messages: DataFrame) -> DataFrame:
    """Each message with its place: conv_id, root_turn, depth, turn, parent_turn, role, own_text, n_quotes, n_linked."""
    rows = landed(linked(messages), "linked")
    # Only messages that reply need their chain followed. Repeated (conv_id, turn) reply to the latest of their sources.
    links = rows.filter("parent_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up"))
    links = landed(links.withColumn("steps", F.lit(1)), "reply_links")
    while True:
        above = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        joined = landed(links.join(above, ["conv_id", "up"], "left"), "reply_links")
        links = joined.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if joined.filter("further IS NOT NULL").isEmpty():
            break
    found = rows.join(links, ["conv_id", "turn"], "left")
    return found.select("conv_id", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).alias("depth"), "turn", "parent_turn", "role", "own_text", "n_quotes", "n_linked")


def formatted(messages: DataFrame) -> DataFrame:
    """The conversations as chat text, one row per message, sorted so that reading on gives each conversation whole."""
    order = ["conv_id", "root_turn", "depth", "turn"]
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own_text"), F.lit("\n"))
    rows = conversations(messages).withColumn("chat", chat)
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
