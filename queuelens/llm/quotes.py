"""Conversations without quotes, linked by what they quote. DataFrame functions only.

A line that begins with ">" signs is quoted text; their number is its level.
Maximal runs of lines of one level are passages. A passage is normalised
(lower case, white space squeezed, blank lines left out) and hashed in two
ways: as flowing text, and as a run of lines. It quotes a message if its text
is the message's whole unquoted text or one of its paragraphs, however they
are wrapped, or if its lines are consecutive lines of that text. It is linked
to the latest earlier message of its own conversation that it quotes, else to
the first message of any other conversation that it quotes.

Runs of lines are compared by hashes of 1, 2, 4, 8... lines: a run of m lines
is covered by its first and its last 2**k lines, with 2**k <= m < 2**(k+1).
Of both the one that fewer messages hold is looked up first.

A message replies to the latest message of its conversation that its
outermost linked passages quote, else to the message before it. The first
reply to a message goes on with its branch, every later one begins a branch.
Ordered by conversation, branch and depth, the messages form conversations in
order of reply, without quotes.

Hot conversations and hot passages are not gathered: only what is quoted
somewhere is joined, earlier messages are found by running maxima over buckets
of turns, and branches by pointer doubling.

Results, also for odd input:

* a null text counts as empty; empty messages stay, as they are part of the
  order; a message of quotes alone gets an empty text;
* messages with a null conv_id or turn are conversations of their own: they
  reply to nothing, and nothing replies to them;
* repeated rows, and rows with the same conv_id and turn, share their place
  in the order; each gets a result row;
* texts of any length count whole, an empty table gives no rows;
* columns beside conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.common import written

#: Turns in a bucket of a conversation.
TURNS = 4096
_QUOTE = r"^[ \t]*((?:>[ \t]?)+)"
_ENDS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), "[^>]", ""))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _hash(text: Column) -> Column:
    """Hash of a normalised passage; null for blank ones."""
    return F.when(_plain(text) != "", F.md5(_plain(text)))


def _placed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())


def parse(messages: DataFrame) -> DataFrame:
    """Messages with `lines`, an array of (pos, level, content), and `own`, the unquoted text."""
    lines = F.transform(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"),
        lambda line, i: F.struct(i.alias("pos"), _level(line).alias("level"), F.regexp_replace(line, _QUOTE, "").alias("content")),
    )
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", lines.alias("lines"))
    unquoted = F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.content)
    return base.withColumn("own", F.regexp_replace(F.array_join(unquoted, "\n"), _ENDS, ""))


def quoted_lines(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, message, run, level, pos, content): the quoted lines of placed messages, by passage."""
    quoting = _placed(parsed).filter(F.exists("lines", lambda x: x.level > 0))
    # A new passage begins where the level changes; no more rows than lines.
    rows = quoting.select("conv_id", "turn", F.md5("text").alias("message"), F.explode("lines").alias("line")).distinct().select("conv_id", "turn", "message", "line.*")
    message = Window.partitionBy("conv_id", "turn", "message").orderBy("pos")
    begins = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    return rows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(message)).filter("level > 0").drop("begins")


def _windows(rows: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Adds `w`, the hashes of the 1, 2, 4... lines from each line on, to rows with (keys, at, hash); null where fewer follow."""
    order = Window.partitionBy(*keys).orderBy("at")
    rows = rows.withColumnRenamed("hash", "w0")
    for k in range(levels):
        rows = rows.withColumn(f"w{k + 1}", F.md5(F.concat(f"w{k}", F.lead(f"w{k}", 1 << k).over(order))))
    names = [f"w{k}" for k in range(levels + 1)]
    return rows.withColumn("w", F.array(*names)).drop(*names)


def passages(lines: DataFrame, levels: int) -> DataFrame:
    """(conv_id, turn, message, run, level, flat, k, a, b, gap) of passages with text.

    flat: hash of the flowing text. a, b: hashes of the first and the last
    2**k lines, which are `gap` lines apart.
    """
    keys = ["conv_id", "turn", "message", "run", "level"]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x.content), " ")
    flat = lines.groupBy(*keys).agg(_hash(joined).alias("flat")).filter("flat is not null")
    rows = lines.withColumn("hash", _hash(F.col("content"))).filter("hash is not null")
    passage = Window.partitionBy(*keys)
    rows = rows.withColumn("at", F.row_number().over(passage.orderBy("pos"))).withColumn("m", F.count("*").over(passage))
    rows = _windows(rows.select(*keys, "at", "m", "hash"), keys, levels).withColumn("k", F.length(F.bin("m")) - 1).withColumn("gap", (F.col("m") - F.expr("shiftleft(1, k)")).cast("int"))
    own = F.element_at("w", F.col("k") + 1)
    ends = rows.groupBy(*keys).agg(F.first("k").alias("k"), F.first("gap").alias("gap"), F.max(F.when(F.col("at") == 1, own)).alias("a"), F.max(F.when(F.col("at") == F.col("gap") + 1, own)).alias("b"))
    return flat.join(ends, keys)


def _run_key(k: str, a: str, b: str, gap: str) -> Column:
    return F.md5(F.concat_ws("/", k, a, b, gap))


def texts_of(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of unquoted texts, as wholes and by paragraph."""
    units = F.array_distinct(F.concat(F.array(_hash(F.col("own"))), F.transform(F.split("own", r"\n[ \t\r]*\n"), _hash)))
    return _placed(parsed).filter("own <> ''").select("conv_id", "turn", F.explode(units).alias("hash")).filter("hash is not null")


def runs_of(parsed: DataFrame, asked: DataFrame, levels: int) -> DataFrame:
    """(conv_id, turn, hash): the messages that hold a run of lines of `asked` (k, a, b, gap)."""
    lines = F.filter(F.transform(F.split("own", "\n"), _hash), lambda x: x.isNotNull())
    message = ["conv_id", "turn", "message"]
    rows = _placed(parsed).filter("own <> ''").select("conv_id", "turn", F.md5("own").alias("message"), F.posexplode(lines).alias("at", "hash"))
    if levels:  # all lines of a message meet for windows, so repeated messages count once
        rows = rows.repartition(*message).distinct()
    rows = _windows(rows, message, levels).select(*message, "at", F.posexplode("w").alias("k", "w")).filter("w is not null")
    wanted = asked.select("k", F.col("a").alias("w")).unionByName(asked.select("k", F.col("b").alias("w"))).distinct()
    rows = written(rows.join(wanted, ["k", "w"], "left_semi"), "quotes-runs")
    near = rows.join(asked.filter("gap = 0").withColumnRenamed("a", "w"), ["k", "w"]).select("conv_id", "turn", _run_key("k", "w", "b", "gap").alias("hash"))
    if not levels:
        return near.distinct()
    held = rows.groupBy("k", "w").agg(F.count("*").alias("n"))
    far = asked.filter("gap > 0")
    for end in ("a", "b"):
        far = far.join(held.select("k", F.col("w").alias(end), F.col("n").alias(f"n_{end}")), ["k", end])
    by_first = F.col("n_a") <= F.col("n_b")
    far = far.select("k", "gap", _run_key("k", "a", "b", "gap").alias("hash"), F.when(by_first, F.col("a")).otherwise(F.col("b")).alias("w"), F.when(by_first, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(by_first, F.col("gap")).otherwise(-F.col("gap")).alias("step"))
    found = rows.join(far, ["k", "w"]).select(*message, "k", (F.col("at") + F.col("step")).alias("at"), F.col("other").alias("w"), "hash")
    found = found.join(rows, [*message, "k", "at", "w"], "left_semi").select("conv_id", "turn", "hash")
    return near.unionByName(found).distinct()


def link(quoted: DataFrame, own: DataFrame) -> DataFrame:
    """(conv_id, turn, level, to_conv, to_turn) of each passage; nulls where nothing is quoted.

    quoted: passages with `keys`, any of which may be the hash of a message in
    `own` (conv_id, turn, hash).
    """
    passage = ["conv_id", "turn", "message", "run", "level"]
    asked = quoted.select(*passage, F.explode("keys").alias("hash"))
    # Only what is quoted somewhere matters.
    own = written(own.join(asked.select("hash").distinct(), "hash", "left_semi").distinct(), "quotes-originals")
    # In the same conversation: the latest turn before, by running maxima in a bucket of turns and over the buckets before.
    said = own.select("conv_id", "turn", "hash", F.col("turn").alias("said"))
    mixed = said.unionByName(asked, allowMissingColumns=True).withColumn("bucket", F.floor(F.col("turn") / TURNS))
    before = Window.partitionBy("conv_id", "hash", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    tops = mixed.groupBy("conv_id", "hash", "bucket").agg(F.max("said").alias("top"))
    tops = tops.withColumn("above", F.max("top").over(Window.partitionBy("conv_id", "hash").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    near = mixed.withColumn("inside", F.max("said").over(before)).filter("level is not null").join(tops, ["conv_id", "hash", "bucket"])
    # In other conversations: the first one, or the second if the first is its own.
    by_conv = own.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")).select("hash", F.struct("conv_id", "turn").alias("place"))
    first = by_conv.groupBy("hash").agg(F.min("place").alias("first"))
    second = by_conv.join(first, "hash").filter("place.conv_id <> first.conv_id").groupBy("hash").agg(F.min("place").alias("second"))
    found = near.join(first, "hash", "left").join(second, "hash", "left")
    other = F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first"))
    best = found.withColumn("other", other).groupBy(*passage).agg(F.max(F.coalesce("inside", "above")).alias("near"), F.min("other").alias("other"))
    same = F.col("near").isNotNull()
    return best.select(
        "conv_id", "turn", "level",
        F.when(same, F.col("conv_id")).otherwise(F.col("other.conv_id")).alias("to_conv"),
        F.when(same, F.col("near")).otherwise(F.col("other.turn")).alias("to_turn"),
    )


def _earlier(places: DataFrame) -> DataFrame:
    """(conv_id, turn, previous): the turn before each distinct turn of a conversation."""
    places = places.withColumn("bucket", F.floor(F.col("turn") / TURNS))
    within = places.withColumn("inside", F.lag("turn").over(Window.partitionBy("conv_id", "bucket").orderBy("turn")))
    tops = places.groupBy("conv_id", "bucket").agg(F.max("turn").alias("top"))
    tops = tops.withColumn("before", F.lag("top").over(Window.partitionBy("conv_id").orderBy("bucket"))).drop("top")
    return within.join(tops, ["conv_id", "bucket"]).select("conv_id", "turn", F.coalesce("inside", "before").alias("previous"))


def _order(places: DataFrame) -> DataFrame:
    """Adds branch (the turn that begins it) and depth to (conv_id, turn, reply_to), by pointer doubling."""
    first = places.filter("reply_to is not null").groupBy("conv_id", "reply_to").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.lit(True).alias("goes_on"))
    state = places.join(first, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "reply_to",
        F.when(F.col("goes_on"), F.col("reply_to")).otherwise(F.col("turn")).alias("branch"),
        F.col("reply_to").alias("up"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth"),
    )
    done = []
    while True:
        state = written(state, "quotes-order")
        # What has reached the first message is final, its branch too, and leaves the rounds.
        done.append(state.filter("up is null").drop("up"))
        rest = state.filter("up is not null")
        if not rest.limit(1).count():
            return functools.reduce(DataFrame.unionByName, done)
        ends = functools.reduce(DataFrame.unionByName, [d.withColumn("up", F.lit(None).cast("long")) for d in done]).unionByName(rest)
        at_branch = ends.select(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.col("branch").alias("b_branch"))
        at_up = ends.select(F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"))
        state = rest.join(at_branch, (F.col("conv_id") == F.col("b_conv")) & (F.col("branch") == F.col("b_turn")))
        state = state.join(at_up, (F.col("conv_id") == F.col("u_conv")) & (F.col("up") == F.col("u_turn")), "left")
        state = state.select("conv_id", "turn", "reply_to", F.col("b_branch").alias("branch"), F.col("u_up").alias("up"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quotes),
    n_quotes, n_linked, reply_to, branch, depth. See the module's docstring.
    """
    parsed = parse(messages)
    lines = written(quoted_lines(parsed), "quotes-lines")
    longest = lines.groupBy("conv_id", "turn", "message", "run").count().agg(F.max("count")).first()[0] or 1
    levels = longest.bit_length() - 1
    quoted = passages(lines, levels).withColumn("keys", F.array_distinct(F.array("flat", _run_key("k", "a", "b", "gap"))))
    quoted = written(quoted, "quotes-passages")
    own = texts_of(parsed).unionByName(runs_of(parsed, quoted.select("k", "a", "b", "gap").distinct(), levels))
    links = written(link(quoted, own), "quotes-links")
    inside = links.filter("to_conv = conv_id")
    outermost = inside.groupBy("conv_id", "turn").agg(F.min("level").alias("outermost"))
    replies = inside.join(outermost, ["conv_id", "turn"]).filter("level = outermost").groupBy("conv_id", "turn").agg(F.max("to_turn").alias("quotes_turn"))
    counts = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("to_conv").alias("n_linked"))
    places = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    placed = _earlier(places).join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quotes_turn", "previous").alias("reply_to"))
    order = _order(placed).join(counts, ["conv_id", "turn"], "left")
    rows = parsed.select("conv_id", "turn", "role", F.col("own").alias("text"))
    zero = F.lit(0).cast("long")
    return rows.join(order, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text",
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
        "reply_to", F.coalesce("branch", "turn").alias("branch"), F.coalesce("depth", zero).alias("depth"),
    )
