r"""Chat formatting in budgeted windows.

A conversation's turns are numbered in order and get the prefix sums of their
tokens. A window takes turns as long as their sum stays within what the budget
leaves beside the turns that the window repeats, so windows are aligned with
turns. Every window but the first repeats the conversation's first system
turn, if that came before, and the last turns before the window, up to
`history` tokens. New turns are laid out with room for the history, but for
half of what the system turn leaves at most, and the history is what still
fits beside them; so a window is longer than the budget, which `over_budget`
marks, only where the system turn and one new turn are. The loss mask covers
assistant texts where they are new, never where they are repeated, so every
target counts once.

Template: `[INST]role\ntext[/INST]`, `<s>role\ntext</s>` for the assistant and
`<<SYS>>role\ntext<</SYS>>` for the system; the role is URL-encoded. A control
string inside a text gets one backslash after its first character (one more
if it has some already), which reading back removes.

Everything is DataFrame expressions. Windows are laid out on light rows
(order, tokens, a hash of the text), and texts join them once that is done.
Order comes from one range sort with offsets between its partitions, and spans
are folded in blocks of `block` turns (a window ends at the edge of a block),
so a conversation with a third of all rows is dealt over many tasks, whatever
its turn numbers are. Only the digest of a whole conversation, which `digests`
makes, needs its text in one row.

Null text or role is empty; a null turn comes first; null conv_id is a
conversation of its own; turns with equal numbers are ordered by role, length
and hash of the text, and repeated rows are turns of their own. Texts of any
length are whole, and extra columns play no part. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: First character, backslashes, rest: the template's control strings.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|</?SYS>>)"
TURN = r"(?s)(?:\[INST\]|<s>|<<SYS>>)(.*?)(?:\[/INST\]|</s>|<</SYS>>)"
#: What a turn is known by; rows equal in these are equal.
IDENTITY = ["c", "t", "role", "chars", "digest"]
STARTS = "array<struct<number:bigint,start:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def by_bytes(text: Column) -> Column:
    """Token estimate of a turn: a quarter of its bytes, and eight for the template."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 8


def identified(turns: DataFrame, tokens: Column) -> DataFrame:
    """turns with IDENTITY, `conv_id`, `text` and `tokens` (one at least)."""
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("t"),
        F.coalesce("role", F.lit("")).alias("role"), F.length(text).alias("chars"), F.xxhash64(text).alias("digest"), text.alias("text"), F.greatest(tokens, F.lit(1)).cast("long").alias("tokens"),
    )


def numbered(classes: DataFrame) -> DataFrame:
    """A row for each turn, from classes (IDENTITY, conv_id, tokens, copies): its `number` and `start`, the tokens before it in its conversation.

    One range sort of light rows; numbers and sums within each piece of a
    conversation that a partition holds, and offsets between the pieces.
    """
    copied = classes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = [*IDENTITY, "copy"]
    kept = materialize(copied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns").withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("c", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept.groupBy("c", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    # At most one row for each conversation and partition.
    offsets = sums.select("c", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    local = kept.withColumn("number", F.count("*").over(inside)).withColumn("start", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = local.join(offsets, ["c", "part"]).withColumn("number", F.col("number") + F.col("n0")).withColumn("start", F.col("start") + F.col("s0"))
    return placed.drop("at", "part", "n0", "s0", "copy")


def spans(turns: DataFrame, leads: DataFrame, budget: int, history: int, block: int) -> DataFrame:
    """(c, b, starts): number and start of each window's first turn, for every block b of a conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("number", "start", "tokens")))
    blocks = turns.groupBy("c", F.floor(F.col("number") / block).alias("b")).agg(ordered.alias("turns")).join(leads.select("c", "sys_tokens", "sys_number"), "c", "left")
    after = lambda n: F.lit(budget) - F.when(n > F.col("sys_number"), F.col("sys_tokens")).otherwise(0)

    def step(acc: Column, turn: Column) -> Column:
        opens = (F.size(acc["starts"]) == 0) | (turn["start"] + turn["tokens"] > acc["limit"])
        left = after(turn["number"])
        room = F.when(turn["number"] == 0, F.lit(budget)).otherwise(F.greatest(left - history, F.floor(left / 2)))
        limit = turn["start"] + room.cast("long")
        first = F.array(F.struct(turn["number"].alias("number"), turn["start"].alias("start")))
        return F.struct(F.when(opens, limit).otherwise(acc["limit"]).alias("limit"), F.when(opens, F.concat(acc["starts"], first)).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).cast("long").alias("limit"), F.array().cast(STARTS).alias("starts"))
    return blocks.select("c", "b", F.aggregate("turns", zero, step, lambda acc: acc["starts"]).alias("starts"))


def members(turns: DataFrame, leads: DataFrame, budget: int, history: int, block: int) -> DataFrame:
    """(c, window, place, again, tokens, IDENTITY): every turn in its window, and the repeated ones; `window` is the number of its first new turn."""
    cuts = materialize(spans(turns, leads, budget, history, block), "windows")
    at = F.floor(F.col("number") / block)
    own = turns.withColumn("b", at).join(cuts, ["c", "b"]).withColumn("window", F.array_max(F.transform(F.filter("starts", lambda s: s["number"] <= F.col("number")), lambda s: s["number"])))
    kinds = [*IDENTITY, "tokens"]
    out = own.select("window", F.col("number").alias("place"), F.lit(False).alias("again"), *kinds)
    windows = cuts.select("c", F.explode("starts").alias("s")).where("s.number > 0").select("c", F.col("s.number").alias("window"), F.col("s.start").alias("first"))
    if history > 0:
        # A turn has a token at least, so a bucket of the prefix sums holds at most `history` turns.
        reach = windows.withColumn("bucket", F.explode(F.array(F.floor(F.col("first") / history) - 1, F.floor(F.col("first") / history))))
        met = turns.withColumn("bucket", F.floor(F.col("start") / history)).join(reach, ["c", "bucket"]).where((F.col("start") >= F.col("first") - history) & (F.col("start") < F.col("first")))
        # What a window's new turns and the system turn leave is all that may be repeated.
        fresh = own.groupBy("c", "window").agg(F.sum("tokens").alias("new")).join(leads.select("c", "sys_number", "sys_tokens"), "c", "left")
        spare = fresh.select("c", "window", (F.lit(budget) - F.col("new") - F.when(F.col("window") > F.col("sys_number"), F.col("sys_tokens")).otherwise(0)).alias("spare"))
        again = met.join(spare, ["c", "window"]).where(F.col("start") >= F.col("first") - F.col("spare")).select("window", F.col("number").alias("place"), F.lit(True).alias("again"), *kinds)
        out = out.unionByName(again)
        reached = again.groupBy("c", "window").agg(F.min("place").alias("oldest"))
        windows = windows.join(reached, ["c", "window"], "left")
    else:
        windows = windows.withColumn("oldest", F.lit(None).cast("long"))
    # The system turn, unless it is among the repeated turns or comes later.
    lead = windows.join(leads, "c").where(F.col("sys_number") < F.coalesce("oldest", "window"))
    said = [F.col(f"sys_{k}").alias(k) for k in kinds if k != "c"]
    return out.unionByName(lead.select("window", F.lit(-1).cast("long").alias("place"), F.lit(True).alias("again"), "c", *said))


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256, block: int = 1024, tokens: Column | None = None) -> DataFrame:
    """(c, conv_id, window, text, repeated, loss_spans, n_tokens, over_budget), a row for each window.

    `window` is the number of its first new turn, `text` the rendered window,
    whose first `repeated` turns are context, and `loss_spans` are (start,
    length) in code points. `tokens` is a column of turns' tokens.
    """
    rows = identified(turns, by_bytes(F.coalesce("text", F.lit(""))) if tokens is None else tokens)
    classes = rows.groupBy(*IDENTITY).agg(F.first("conv_id").alias("conv_id"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    placed = materialize(numbered(classes), "numbered")
    system = placed.where("role = 'system'").groupBy("c").agg(F.min(F.struct("number", *IDENTITY[1:], "tokens")).alias("s"))
    leads = system.select("c", *[F.col(f"s.{k}").alias(f"sys_{k}") for k in ("number", *IDENTITY[1:], "tokens")])
    laid = members(placed, leads, budget, history, block)

    known = F.col("role")
    kind = F.when(known == "assistant", 0).when(known == "system", 1).otherwise(2)
    opening = F.when(kind == 0, "<s>").when(kind == 1, "<<SYS>>").otherwise("[INST]")
    closing = F.when(kind == 0, "</s>").when(kind == 1, "<</SYS>>").otherwise("[/INST]")
    head = F.concat(opening, F.url_encode(known), F.lit("\n"))
    texts = rows.drop("tokens")
    repeated = placed.where("copies > 1").select(*IDENTITY).distinct()
    if not repeated.isEmpty():
        texts = texts.join(repeated, IDENTITY, "left_anti").unionByName(texts.join(repeated, IDENTITY, "left_semi").dropDuplicates(IDENTITY))
    said = texts.select(*IDENTITY, "conv_id", F.concat(head, escape(F.col("text")), closing).alias("rendered"), F.length(head).cast("long").alias("at"), F.length(escape(F.col("text"))).cast("long").alias("shown"))
    # A long text stands in its turn's window, and again where it is repeated.
    joined = laid.join(said, IDENTITY)
    piece = F.struct("place", "rendered", "at", "shown", ((F.col("role") == "assistant") & ~F.col("again")).alias("target"))
    windows = joined.groupBy("c", "window").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.count_if("again").alias("repeated"), F.sum("tokens").alias("n_tokens"))
    # Offsets of the pieces in the window: prefix sums of their lengths.
    masks = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p["rendered"])).alias("pos"),
            F.when(p["target"], F.concat(acc["spans"], F.array(F.struct((acc["pos"] + p["at"]).alias("start"), p["shown"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        "c", "conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["rendered"]), "").alias("text"),
        "repeated", masks.alias("loss_spans"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """windows with `turns`, the new turns (role, text) parsed from the text, and `loss`, the unescaped text under its mask."""
    body = F.slice(F.regexp_extract_all("text", F.lit(TURN), F.lit(1)), (F.col("repeated") + 1).cast("int"), F.lit(1 << 30))
    turns = F.transform(body, lambda x: F.struct(
        F.url_decode(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text"),
    ))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", turns).withColumn("loss", F.array_join(loss, ""))


def digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows.

    A digest of a whole conversation needs its text in one row; that row is
    as long as the conversation, and no longer.
    """
    read = read_back(windows)
    part = read.select(
        "c", "conv_id", "window", F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"), "loss",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    joined = part.groupBy("c").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return joined.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op4(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(format_windows(turns.unionByName(extra)))
