"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens place every turn on its conversation's token line. The line is
cut at multiples of the stride (budget less history less system turn); a window holds the
turns that start in its stride, so it is turn-aligned. Each window repeats the system
turn and the turns that start at most ``history`` tokens before it; repeated turns are
masked from the loss, so every assistant text is a target exactly once.

A turn is written ``<turn N>role``, newline, text, ``</turn>`` and newline, N being the
written role's length. Inside roles and texts a backslash is doubled and ``<turn`` and
``</turn`` get one after the ``<``, so markers never occur in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]"
PER_TURN = 4  # tokens of the markers
BUDGET = 512
HISTORY = 128
CELL = 1024  # turn numbers that one task orders together


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit("<turn"), F.lit("<\\turn"))
    return F.replace(x, F.lit("</turn"), F.lit("<\\/turn"))


def unescape(x: Column) -> Column:
    """A backslash pair is a backslash, a lone one marks a broken marker."""
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def placed(turns: DataFrame) -> DataFrame:
    """Turns with their position and token start in the conversation (two-level prefix sums).

    Cells of ``CELL`` turn numbers are ordered and summed on their own; only one row per
    cell is ordered by conversation, so a long conversation is many tasks' work.
    """
    keys = ["_null", "conv_id"]
    inner = Window.partitionBy(*keys, "cell").orderBy(F.asc_nulls_first("turn"), "role", "text")
    up_to = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = turns.withColumns(
        {"pos": F.row_number().over(inner), "start": F.sum("tokens").over(up_to) - F.col("tokens")}
    )
    first = F.min(F.struct("turn", "role", "text", "tokens"))
    cells = turns.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), first.alias("first"))
    cells = cells.select(*keys, "cell", "n", "t", F.col("first.role").alias("r"), F.col("first.tokens").alias("k"))
    outer = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_system = F.first("r").over(outer) == "system"
    cells = cells.select(
        *keys,
        "cell",
        (F.sum("n").over(outer) - F.col("n")).alias("n0"),
        (F.sum("t").over(outer) - F.col("t")).alias("t0"),
        F.when(is_system, F.first("k").over(outer)).otherwise(0).alias("system_tokens"),
    )
    out = local.join(cells, [*keys, "cell"])
    out = out.withColumns({"pos": F.col("pos") + F.col("n0") - 1, "start": F.col("start") + F.col("t0")})
    system = (F.col("pos") == 0) & (F.col("system_tokens") > 0)
    start = F.when(system, 0).otherwise(F.col("start") - F.col("system_tokens"))
    return out.withColumns({"system": system, "start": start})


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window of a conversation (columns conv_id, turn, role, text).

    Returns ``conv_id``, ``window_id``, ``text``, ``loss`` (array of start, length in code
    points), ``n_turns``, ``n_repeated`` (leading turns that are repeats) and
    ``n_tokens``. Turns are never cut, so a turn longer than the budget fills a window
    alone or makes its window longer. Null roles and texts are empty; null turns come
    first; turns of equal number are ordered by role and text, and repeated rows are all
    kept; rows with a null conv_id form one conversation. A first turn of role ``system``
    is the system turn. An empty table gives no windows; other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").isNull().alias("_null"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    lowest = F.lit(-(1 << 62))
    turns = turns.withColumns(
        {
            "cell": F.coalesce(F.floor(F.col("turn") / CELL).cast("long"), lowest),
            "tokens": (F.regexp_count("text", F.lit(TOKEN)) + PER_TURN).cast("long"),
        }
    )
    role = escape(F.col("role"))
    head = F.concat(F.lit("<turn "), F.length(role).cast("string"), F.lit(">"), role, F.lit("\n"))
    body = escape(F.col("text"))
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_tokens"))
    own = F.floor(F.col("start") / stride)
    last = F.when(F.col("system"), own).otherwise(F.floor((F.col("start") + history) / stride))
    lines = placed(turns).select(
        "_null",
        "conv_id",
        "pos",
        "system",
        "tokens",
        (F.col("role") == "assistant").alias("target"),
        head.alias("head"),
        body.alias("body"),
        own.cast("long").alias("own"),
        F.explode(F.sequence(own.cast("long"), last.cast("long"))).alias("window_id"),
    )
    keys = ["_null", "conv_id"]
    line = F.concat("head", "body", F.lit(END))
    new = F.col("own") == F.col("window_id")
    order = Window.partitionBy(*keys, "window_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(F.col("system"), 0).otherwise(F.length(line))
    lines = lines.withColumn("at", F.sum(size).over(order) - size)
    item = F.when(~F.col("system"), F.struct("pos", line.alias("line")))
    mask = F.when(
        new & F.col("target") & ~F.col("system"),
        F.struct("pos", (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length")),
    )
    made = lines.groupBy(*keys, "window_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.sort_array(F.collect_list(mask)).alias("mask"),
        F.sum(F.when(~F.col("system"), 1).otherwise(0)).alias("n"),
        F.sum(F.when(~F.col("system") & ~new, 1).otherwise(0)).alias("old"),
        F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).alias("t"),
        F.max(new).alias("any_new"),
    )
    system = lines.where("system").select(*keys, line.alias("sys"), F.col("tokens").alias("sys_tokens"))
    both = made.where("any_new").join(system, keys, "left")
    lead = F.coalesce(F.length("sys"), F.lit(0))
    has = F.col("sys").isNotNull()
    return both.select(
        F.when(~F.col("_null"), F.col("conv_id")).alias("conv_id"),
        "window_id",
        F.concat(F.coalesce("sys", F.lit("")), F.array_join(F.transform("items", lambda x: x["line"]), "")).alias("text"),
        F.transform(
            "mask", lambda x: F.struct((x["start"] + lead).alias("start"), x["length"].cast("long").alias("length"))
        ).alias("loss"),
        (F.col("n") + F.when(has, 1).otherwise(0)).alias("n_turns"),
        (F.col("old") + F.when(has & (F.col("window_id") > 0), 1).otherwise(0)).alias("n_repeated"),
        (F.col("t") + F.coalesce("sys_tokens", F.lit(0))).alias("n_tokens"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the windows' text and loss alone: counts and digests.

    A digest needs the whole conversation in one row; the windows themselves do not.
    """
    parts = F.slice(F.split("text", END), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    size = lambda x: F.regexp_extract(x, r"^<turn (\d+)>", 1)

    def turn(x: Column) -> Column:
        n = size(x).cast("int")
        at = F.length(size(x)) + 8  # after "<turn N>"
        role, text = F.substring(x, at, n), F.substring(x, at + n + 1, F.length(x))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    shown = made.select(
        "conv_id",
        "window_id",
        F.array_join(F.transform(parts, turn), "").alias("turns"),
        F.array_join(
            F.transform("loss", lambda x: unescape(F.substring(F.col("text"), x["start"].cast("int") + 1, x["length"].cast("int")))), ""
        ).alias("target"),
        (F.col("n_turns") - F.col("n_repeated")).alias("n"),
        F.length("text").alias("chars"),
    )
    whole = shown.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window_id", "turns", "target"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = lambda k: F.array_join(F.transform("w", lambda x: x[k]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("target")).cast("long").alias("loss_chars"),
        F.sha2(joined("target").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
