"""Quotation linking, with DataFrame functions only: conversations in reply order from quoted passages.

A line's quote level is the number of ``>`` it begins with (blanks between allowed).
Runs of neighbouring lines of one level over 0 are quoted passages. Passages, the
unquoted body of every message and each of its paragraphs (lines between empty lines)
and lines are normalised (marks off, blanks collapsed, A-Z lower-cased) and hashed,
as are those runs of an unquoted body's lines, and of its paragraphs, that begin with
the first line or paragraph of a quoted passage and have as many (empty ones don't
count); a quoted passage belongs to the first earlier message of its conversation that
holds it in its own words. Part of a line is no passage, nor is part of a paragraph
whose lines are broken elsewhere. A message replies to the message of its shallowest
linked passage, the latest of these if there are several; a message that links to none
goes on from the turn before it, so that an ordinary chat is one thread.

The reply order is the walk through this tree that takes, after each message, first the
replies that quote it (by turn, each with all that follows from it) and then the turn
after it, if that quotes nothing. Its places come from pointer doubling over the list of steps into
and out of each message: log2 of the longest conversation joins, on unique keys, and
only for conversations that some quotation takes out of the order of turns. No task
holds a whole conversation; ``segments`` writes rows of SEGMENT places of the order.

A null or empty text has no lines and is ''; a very long one is read whole, in time that
grows with its length; a message of a null conversation or turn never links and is a
conversation of its own; repeated rows (equal in conversation and turn) are returned as
often as they come by ``conversations``, and ``segments`` has each message once; different
messages of one turn share its place, by role and text, and beyond SEGMENT of them go
into further parts; empty tables give empty results; columns other than the four are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import running, stash

MARKS = r"^[ \t]*((?:>[ \t]*)*)"
BLANK = " \t\n\x0b\f\r"
#: Places of a conversation in one row of segments(), and turns in one window of a long conversation.
SEGMENT, SPAN = 256, 4096


def normal(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read and don't evaluate again: the optimiser would copy an array's expression to each use, so to each element of a lambda."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_s")).select(*df.columns, "_s.*")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (without quotes) and passages (level, text) of each message."""
    level = lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 1), " \t", ""))
    m = settled(messages.select("conv_id", "turn", "role", "text"), lines=F.split(F.coalesce("text", F.lit("")), "\n")).drop("text")
    m = settled(m, levels=F.transform("lines", level))
    kept = F.filter(F.arrays_zip("lines", "levels"), lambda x: x["levels"] == 0)
    # the lines at which a passage or a stretch of own words begins
    places = F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)))
    m = settled(m, body=F.btrim(F.array_join(F.transform(kept, lambda x: x["lines"]), "\n"), F.lit(BLANK)), begins=places)
    end = lambda k: F.coalesce(F.get("begins", k + 1), F.size("levels"))
    quoted = lambda i, k: F.array_join(F.transform(F.slice("lines", i + 1, end(k) - i), lambda x: F.regexp_replace(x, MARKS, "")), "\n")
    stretch = F.transform("begins", lambda i, k: F.struct(F.get("levels", i).alias("level"), F.when(F.get("levels", i) > 0, quoted(i, k)).alias("text")))
    m = settled(m, passages=F.filter(stretch, lambda x: x["level"] > 0), n_quoted=F.size(F.filter("levels", lambda x: x > 0)))
    return m.select("conv_id", "turn", "role", "body", "passages", "n_quoted")


def units(text: Column) -> Column:
    """The normalised lines of a text and its normalised paragraphs, without empty ones."""
    return F.array(*[F.filter(F.transform(F.split(text, by), normal), lambda x: x != "") for by in ("\n", r"\n\s*\n")])


def runs(known: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, h of the runs of lines or paragraphs that begin like a quoted one and are as long."""
    starts = asked.select("conv_id", F.explode("starts").alias("s")).select("conv_id", "s.*").where("n > 1").distinct()
    bodies = known.join(starts.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", units(F.col("body")).alias("units"))
    heads = bodies.select("conv_id", "turn", F.posexplode("units").alias("kind", "unit")).select("conv_id", "turn", "kind", F.size("unit").alias("size"), F.posexplode("unit").alias("at", "head"))
    places = heads.withColumn("head", F.md5(F.col("head").cast("binary"))).join(starts, ["conv_id", "kind", "head"]).where("at + n <= size")
    places = places.groupBy("conv_id", "turn").agg(F.collect_set(F.struct("kind", "at", "n")).alias("places"))
    found = bodies.join(places, ["conv_id", "turn"]).select("conv_id", "turn", "units", F.explode("places").alias("p"))
    return found.select("conv_id", "turn", F.md5(F.array_join(F.slice(F.get("units", F.col("p.kind")), F.col("p.at") + 1, F.col("p.n")), " ").cast("binary")).alias("h"))


def linked(parsed_messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: the message that each quoting message answers."""
    known = parsed_messages.where("conv_id is not null and turn is not null")
    starts = F.transform(units(F.col("p.text")), lambda u, kind: F.struct(kind.alias("kind"), F.md5(F.get(u, 0).cast("binary")).alias("head"), F.size(u).alias("n")))
    quotes = known.where("n_quoted > 0").select("conv_id", "turn", F.explode("passages").alias("p")).where(F.length(normal("p.text")) > 0).select("conv_id", "turn", F.col("p.level").alias("level"), F.md5(normal("p.text").cast("binary")).alias("h"), starts.alias("starts"))
    asked = stash(quotes.distinct())
    if asked.isEmpty():
        return asked.select("conv_id", "turn", F.col("turn").alias("reply_to"))
    wanted = asked.select("conv_id", "h").distinct()
    parts = F.array_union(F.array(F.col("body")), F.array_union(F.split("body", r"\n\s*\n"), F.split("body", "\n")))
    own = known.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normal))).alias("part")).where("part <> ''")
    first = own.select("conv_id", "turn", F.md5(F.col("part").cast("binary")).alias("h")).union(runs(known, asked)).groupBy("conv_id", "h").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "h"], "left_semi")
    found = asked.join(first, ["conv_id", "h"]).where("origin < turn")
    return found.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "origin"))["origin"].alias("reply_to"))


def neighbour(df: DataFrame, keys: list[str], value: str, name: str, back: bool = False) -> DataFrame:
    """df with the next larger value (or with back the next smaller one) among the rows of its keys, whose values are distinct; windows hold SPAN values."""
    df = df.withColumn("_span", F.floor(F.col(value) / SPAN))
    step = F.lag if back else F.lead
    inner = step(value).over(Window.partitionBy(*keys, "_span").orderBy(value))
    ends = df.groupBy(*keys, "_span").agg((F.max if back else F.min)(value).alias("_end"))
    ends = ends.select(*keys, "_span", step("_end").over(Window.partitionBy(*keys).orderBy("_span")).alias("_end"))
    return df.withColumn("_in", inner).join(ends, [*keys, "_span"]).withColumn(name, F.coalesce("_in", "_end")).drop("_in", "_end", "_span")


def tree(parsed_messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, linked (by a quotation), stray (not to the turn before): a row a turn; the first turn of a conversation replies to none."""
    nodes = parsed_messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    quoting = linked(parsed_messages).withColumnRenamed("reply_to", "origin")
    t = neighbour(nodes, ["conv_id"], "turn", "before", back=True).join(quoting, ["conv_id", "turn"], "left")
    up = F.coalesce("origin", "before")
    return stash(t.select("conv_id", "turn", up.alias("reply_to"), F.col("origin").isNotNull().alias("linked"), F.coalesce(up != F.col("before"), F.lit(False)).alias("stray")))


def ordered(t: DataFrame) -> DataFrame:
    """conv_id, turn and position (from 0) in the reply order of a tree."""
    branched = t.where("stray").select("conv_id").distinct()
    plain = t.join(branched, "conv_id", "left_anti").withColumn("_span", F.floor(F.col("turn") / SPAN))
    plain = running(plain, ["conv_id"], "_span", [F.col("turn")], F.lit(1).cast("long"), "position").select("conv_id", "turn", (F.col("position") - 1).alias("position"))
    if branched.isEmpty():
        return plain
    t = stash(t.join(branched, "conv_id", "left_semi"))
    children = t.where("reply_to is not null")
    kids = children.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min(F.when(F.col("linked"), F.col("turn"))).alias("quoter"), F.max(F.when(~F.col("linked"), F.col("turn"))).alias("follower"))
    beside = neighbour(children.where("linked").select("conv_id", "reply_to", "turn"), ["conv_id", "reply_to"], "turn", "beside").select("conv_id", "turn", "beside")
    j = t.join(kids, ["conv_id", "turn"], "left").join(beside, ["conv_id", "turn"], "left")
    j = j.join(kids.select("conv_id", F.col("turn").alias("reply_to"), F.col("follower").alias("last")), ["conv_id", "reply_to"], "left")
    into, out = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    after = F.coalesce(into("beside"), F.when(F.col("linked"), into("last")), out("reply_to"))
    steps = j.select("conv_id", F.explode(F.array(
        F.struct(into("turn").alias("id"), F.coalesce(into("quoter"), into("follower"), out("turn")).alias("next"), F.lit(1).cast("long").alias("n")),
        F.struct(out("turn").alias("id"), after.alias("next"), F.lit(0).cast("long").alias("n")),
    )).alias("s")).select("conv_id", "s.*")
    now = stash(steps)
    while not now.where("next is not null").isEmpty():  # n: messages from here up to the next pointer; the pointers double their reach
        far = now.select("conv_id", F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("more"))
        now = stash(now.join(far, ["conv_id", "next"], "left").select("conv_id", "id", F.col("beyond").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    total = now.groupBy("conv_id").agg(F.max("n").alias("total"))
    walked = now.where("id % 2 = 0").join(total, "conv_id").select("conv_id", F.expr("id div 2").alias("turn"), (F.col("total") - F.col("n")).alias("position"))
    return plain.union(walked)


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, reply_to, linked, position (in the reply order) and formatted, a row a message."""
    p = parsed(messages)
    t = tree(p)
    places = ordered(t).join(t.select("conv_id", "turn", "reply_to", "linked"), ["conv_id", "turn"])
    m = p.drop("passages").join(places, ["conv_id", "turn"], "left")
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    return m.select("conv_id", "turn", "role", F.col("body").alias("text"), F.col("n_quoted").cast("long").alias("n_quoted"), "reply_to", F.coalesce("linked", F.lit(False)).alias("linked"), "position", turn.alias("formatted"))


def segments(found: DataFrame) -> DataFrame:
    """Conversations in reply order, a row for SEGMENT places: conv_id, segment, part, n_messages, n_linked, turns, chat."""
    alone = F.when(F.col("position").isNull(), F.md5(F.concat_ws("\x00", F.col("turn").cast("string"), "role", "formatted").cast("binary")))
    one = found.groupBy("conv_id", "turn", "role", "formatted", "linked", "position").agg(F.lit(1).alias("_one")).drop("_one").withColumn("alone", alone)
    many = one.where("position is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT)
    keyed = one.join(many, ["conv_id", "turn"], "left").withColumns({"segment": F.coalesce(F.floor(F.col("position") / SEGMENT), F.lit(0)), "part": F.coalesce(F.pmod(F.xxhash64("role", "formatted"), F.expr(f"1 + n div {SEGMENT}")), F.lit(0))})
    messages = F.array_sort(F.collect_list(F.struct("position", "turn", "role", "formatted")))
    g = keyed.groupBy("conv_id", "segment", "part", "alone").agg(messages.alias("m"), F.count_if("linked").alias("n_linked"))
    return g.select("conv_id", "segment", "part", F.size("m").cast("long").alias("n_messages"), "n_linked", F.transform("m", lambda x: x["turn"]).alias("turns"), F.array_join(F.transform("m", lambda x: x["formatted"]), "\n").alias("chat"))


def op9_quotation_threads(spark, sf_dir: str) -> DataFrame:
    return segments(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
