"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line end. Inside roles and texts the control
characters are coded by a backslash and a letter, so no mark of the template can occur there and
decoding gives the very text.

Prefix sums of the turns' tokens choose the windows. The room of a conversation is the budget less
its system turn (the first turn, if its role is system). The other turns' sums cut it into stretches of
so many tokens: turns that lie within one stretch are new in one window, a turn that reaches from one stretch
into another has a window of its own. So new turns fit wherever each of them does. A window starts with the system turn, repeats the last
turns of the window before it as far as they fit in ``history`` tokens and in what its new turns
leave of the room, and then holds its new turns. Only a turn that is itself larger than the room makes a
window go over the budget; it stands there as it is, never cut. Beside a system turn that fills the budget alone the
other turns have as much room again, so that it isn't repeated for every one of them. The loss mask covers the texts of new
assistant turns; what is repeated is masked, so each assistant text counts once.

Prefix sums are taken over ranges of CHUNK turn numbers first and then over the ranges, so a long
conversation is not summed in one task.

Cases: null text or role counts as empty, a null turn comes first, rows of one turn go by role and
text, and rows that repeat stay. A null conv_id is a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
#: Turn numbers of a conversation that are summed together.
CHUNK = 512
END = "</turn>\n"
#: What stands for each control character. The backslash comes first in coding and last in decoding.
CODES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(text: Column) -> Column:
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    """About four bytes a token, and four for the turn's marks."""
    return F.ceil(F.octet_length(text) / 4) + 4


def placed_turns(clean: DataFrame) -> DataFrame:
    """clean (key, turn, role, text, tokens) with chunk, pos (from 1 within the chunk), ends (tokens of the conversation up to here, its system turn apart), system and fixed (the system turn's tokens)."""
    own = Window.partitionBy("key", "chunk").orderBy("turn", "role", "text")
    local = clean.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))  # null turns come first
    local = local.withColumns({"pos": F.row_number().over(own), "running": F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    # of each chunk its sum and its first turn; of each conversation what lies before each chunk, and the tokens of a first turn of the system
    lead = F.min(F.when(F.col("pos") == 1, F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)))
    sums = local.groupBy("key", "chunk").agg(F.sum("tokens").alias("sum"), lead.alias("lead"))
    order = Window.partitionBy("key").orderBy("chunk")
    before = F.coalesce(F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("key", "chunk", before.alias("before"), F.first("lead").over(order).alias("fixed"), (F.row_number().over(order) == 1).alias("first"))
    known = local.join(offsets, ["key", "chunk"])
    system = F.col("first") & (F.col("pos") == 1) & (F.col("role") == "system")
    return known.withColumn("ends", F.col("before") + F.col("running") - F.col("fixed")).withColumn("system", system).drop("before", "running", "first")


def windows(turns: DataFrame, history: int = HISTORY, budget: int = BUDGET, count: str | None = None) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns that stand there again), n_turns, n_tokens, over_budget and loss_spans.

    window numbers rise with the turns, with gaps. loss_spans are (start from 1, length) in code points of formatted.
    count: a column of turns with their tokens; without one, about four bytes are a token.
    """
    amount = tokens(F.coalesce("text", F.lit(""))) if count is None else F.coalesce(F.col(count), F.lit(0))
    # as a field of a struct a null conv_id equals itself in joins
    clean = turns.select(F.struct("conv_id").alias("key"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), amount.cast("long").alias("tokens"))
    room = F.when(F.col("fixed") < budget, budget - F.col("fixed")).otherwise(budget)  # beside a system turn that fills the budget alone, the others have as much again
    first, last = F.floor((F.col("ends") - F.col("tokens")) / room), F.floor((F.col("ends") - 1) / room)
    # twice the stretch, and one more for a turn that ends in a later stretch than it starts in
    window = F.when(F.col("system"), F.lit(0)).otherwise(F.when(first == last, 2 * first).otherwise(2 * first + 1))
    placed = placed_turns(clean).withColumn("room", room).withColumn("window", window.cast("long"))
    # a window's new turns are a bounded number of tokens; their sums meet by conversation
    new = F.when(~F.col("system"), F.col("tokens"))
    sizes = placed.groupBy("key", "window").agg(F.coalesce(F.sum(new), F.lit(0)).alias("size"), F.count(new).alias("others"), F.max("ends").alias("end"))
    order = Window.partitionBy("key").orderBy("window")
    sizes = sizes.select("key", "window", "others", "end", F.lead("window").over(order).alias("next"), F.lead("size").over(order).alias("next_size"))
    known = placed.join(sizes, ["key", "window"])
    from_end = F.col("end") - F.col("ends") + F.col("tokens")
    again = ~F.col("system") & F.col("next").isNotNull() & (from_end <= F.least(F.lit(history), F.col("room") - F.col("next_size")))
    # every turn is new in its own window (part 1); a late turn stands in the next one too (0), the system turn in all (-1)
    place = lambda part, at: F.struct(F.lit(part).alias("part"), F.col(at).alias("window"))
    stands = F.when(again, F.array(place(1, "window"), place(0, "next"))).otherwise(F.array(place(1, "window")))
    columns = ["key", "chunk", "pos", "tokens", "role", "text"]
    shown = known.withColumn("stands", F.explode(stands)).select(*columns, "stands.part", "stands.window")
    heads = placed.filter("system").select(*columns, F.lit(-1).alias("part")).join(sizes.filter("others > 0 AND window > 0").select("key", "window"), "key")
    head, body, end = F.concat(F.lit("### "), escape(F.col("role")), F.lit(": ")), escape(F.col("text")), F.lit(END)
    line = Window.partitionBy("key", "window").orderBy("part", "chunk", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    written = shown.unionByName(heads).withColumn("body", body).withColumn("piece", F.concat(head, "body", end)).withColumn("stop", F.sum(F.length("piece")).over(line))
    start = F.col("stop") - len(END) - F.length("body") + 1
    span = F.when((F.col("role") == "assistant") & (F.col("part") == 1), F.struct(start.cast("int").alias("start"), F.length("body").alias("length")))
    # a window holds a bounded number of tokens, so these lists are short
    grouped = written.groupBy("key", "window").agg(
        F.sort_array(F.collect_list(F.struct("part", "chunk", "pos", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sum((F.col("part") < 1).cast("int")).alias("n_repeated"),
        F.count("*").alias("n_turns"),
        F.sum("tokens").alias("n_tokens"),
    )
    return grouped.select(
        "key.conv_id",
        "window",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        "n_repeated",
        "n_turns",
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
        F.col("spans").alias("loss_spans"),
    )


def read_turns(formatted: Column, n_repeated: Column) -> Column:
    """The new turns of a window as an array of (role, text)."""
    parts = F.split(formatted, F.lit(END), -1)
    new = F.slice(parts, n_repeated + 1, F.size(parts) - 1 - n_repeated)  # behind the last end mark there is nothing

    def turn(x: Column) -> Column:
        role = F.substring_index(x, ":", 1)
        return F.struct(unescape(F.substr(role, F.lit(5))).alias("role"), unescape(F.substr(x, F.length(role) + 3)).alias("text"))

    return F.transform(new, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask of a window, decoded."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s.start, s.length))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the windows finds, one row for each conversation."""
    turns = read_turns(F.col("formatted"), F.col("n_repeated"))
    read = formatted.select(
        "conv_id",
        "window",
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ODD = "\\### Assistant: </turn> ok"


def with_odd_conversation(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Two more rows, of a conversation whose texts look like marks."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(odd)


ROOM_SQL = f"(CASE WHEN fixed < {BUDGET} THEN {BUDGET} - fixed ELSE {BUDGET} END)"
SQL = f"""
WITH raw AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ODD}' UNION ALL SELECT -7, 1, 'assistant', '{ODD}'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens,
    length(role) + len(regexp_extract_all(role, '[\\\\<#:]')) + length(text) + len(regexp_extract_all(text, '[\\\\<#:]')) + 14 AS chars
  FROM raw
), placed AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system,
    coalesce(max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS fixed,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM sized
), windowed AS (
  SELECT *, {ROOM_SQL} AS room, upto - fixed AS ends,
    CASE WHEN is_system THEN 0 WHEN (upto - fixed - tokens) // {ROOM_SQL} = (upto - fixed - 1) // {ROOM_SQL}
      THEN 2 * ((upto - fixed - tokens) // {ROOM_SQL}) ELSE 2 * ((upto - fixed - tokens) // {ROOM_SQL}) + 1 END AS win FROM placed
), sizes AS (
  SELECT conv_id, win, sum(CASE WHEN is_system THEN 0 ELSE tokens END) AS size, max(ends) AS last_end, bool_or(NOT is_system) AS others FROM windowed GROUP BY conv_id, win
), followed AS (
  SELECT *, lead(size) OVER (PARTITION BY conv_id ORDER BY win) AS next_size, count(*) FILTER (others AND win > 0) OVER (PARTITION BY conv_id) AS later FROM sizes
), shown AS (
  SELECT t.*, CASE WHEN t.is_system THEN 1 + f.later WHEN f.next_size IS NOT NULL AND f.last_end - t.ends + t.tokens <= least({HISTORY}, t.room - f.next_size) THEN 2 ELSE 1 END AS times
  FROM windowed t JOIN followed f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.win = f.win
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * times) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
