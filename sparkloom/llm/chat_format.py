"""Chat formatting into budgeted windows, with DataFrame functions only.

Template: a turn is ``<s>[ROLE=user]text</s>``.  In roles and texts ``&``, ``<``,
``[`` and ``]`` are written as character references, so no text can hold a
control string and reading back is exact.

Windows.  Running sums of turn tokens choose turn-aligned spans: a turn belongs
to the span in which it starts, spans are half of what is left of the budget
beside the system turn and the history, and a turn of over half of that has a
span of its own.  Every window keeps the leading system turn and repeats the
end of its predecessor, up to ``history`` tokens.  The loss mask holds each
assistant text once: repeated turns are not targets.

Budget.  A leading system turn of over ``system_share`` of the budget stands whole
in the first window alone; repeated, it would leave the others no room.  Turns are
never cut, so one that is longer than what system turn and history leave makes a
window beyond the budget, in which it is the only turn that is not repeated.

Sums run in two steps (per block of turns, then over the block sums), so that a
conversation with very many turns is not one task's work until its windows are
gathered into the one digest that a conversation has.

Edge cases: null texts and roles count as empty, a null turn comes first,
repeated rows are turns of their own, a null conv_id is a conversation; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.common import materialize, table

BUDGET, HISTORY, SYSTEM_SHARE, BLOCK = 1024, 192, 0.5, 256
#: What is escaped, in the order in which it is.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(c: Column) -> Column:
    for raw, code in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def token_count(c: Column) -> Column:
    """Words and single marks: a count without a vocabulary."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long") + 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system_share: float = SYSTEM_SHARE) -> DataFrame:
    """One row per window of turns(conv_id, turn, role, text).

    conv_id, window, formatted, repeated (turns at the head that a previous
    window has as its own), spans (start and length of the text under the loss
    mask, in code points).
    """
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", token_count(F.col("text")))
    same = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c")]  # null is a conversation
    t = t.select("*", *same, F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"))
    inner = W.partitionBy("c", "block").orderBy("turn", "role", "text")
    first = t.groupBy("c").agg(F.min_by(F.struct("role", "tokens"), F.struct(F.col("turn"), F.col("role"), F.col("text"))).alias("head"))
    leads = (F.col("head.role") == "system") & (F.col("head.tokens") <= int(budget * system_share))
    head = F.when(leads, F.col("head.tokens")).otherwise(0)
    room = F.greatest((F.lit(budget - history) - head) / 2, F.lit(16)).cast("long")
    first = materialize(first.select("c", room.alias("room"), leads.alias("has_system")))
    t = t.join(first, "c")
    # ends of long turns break spans; both sums need what came before in the block and in earlier blocks
    long_turn = (F.col("tokens") > F.col("room")).cast("long")
    t = t.withColumn("long", long_turn).withColumn("sum_in", F.sum("tokens").over(inner)).withColumn("longs_in", F.sum("long").over(inner)).withColumn("at", F.row_number().over(inner))
    totals = t.groupBy("c", "block").agg(F.sum("tokens").alias("bt"), F.sum("long").alias("bl"), F.count("*").alias("bn"))
    before = W.partitionBy("c").orderBy("block")
    totals = totals.select("c", "block", (F.sum("bt").over(before) - F.col("bt")).alias("t0"), (F.sum("bl").over(before) - F.col("bl")).alias("l0"), (F.sum("bn").over(before) - F.col("bn")).alias("n0"))
    t = t.join(totals, ["c", "block"]).withColumn("place", F.col("n0") + F.col("at"))
    t = t.withColumn("start", F.col("t0") + F.col("sum_in") - F.col("tokens"))
    t = t.withColumn("span", F.struct(F.floor(F.col("start") / F.col("room")).alias("slot"), (2 * (F.col("l0") + F.col("longs_in")) - F.col("long")).alias("cut")))
    t = materialize(t.withColumn("system", F.col("has_system") & (F.col("place") == 1)).select("conv_id", "c", "place", "role", "text", "tokens", "start", "span", "system"))
    spans = t.groupBy("c", "span").agg(F.max(F.col("start") + F.col("tokens")).alias("end"), F.min("place").alias("p"))
    numbered = materialize(
        spans.withColumn("window", F.row_number().over(W.partitionBy("c").orderBy("p"))).withColumn("windows", F.count("*").over(W.partitionBy("c"))).drop("p")
    )
    t = t.join(numbered, ["c", "span"])
    kept = F.when(F.col("system"), F.sequence(F.lit(1), F.col("windows"))).when(
        (F.col("window") < F.col("windows")) & (F.col("end") - F.col("start") <= history), F.array("window", F.col("window") + 1)
    ).otherwise(F.array("window"))
    t = t.select("*", F.explode(kept).alias("in")).withColumn("old", F.col("in") != F.col("window"))
    lead = F.concat(F.lit("<s>[ROLE="), escape(F.col("role")), F.lit("]"))
    body = escape(F.col("text"))
    t = t.select("conv_id", "c", F.col("in").alias("window"), "place", "role", "old", lead.alias("lead"), body.alias("body"))
    t = t.withColumn("part", F.concat("lead", "body", F.lit("</s>")))
    order = W.partitionBy("c", "window").orderBy("place")
    t = t.withColumn("at", F.sum(F.length("part")).over(order) - F.length("part"))
    target = (F.col("role") == "assistant") & ~F.col("old")
    mask = F.struct("place", (F.col("at") + F.length("lead")).alias("start"), F.length("body").cast("long").alias("length"))
    return t.groupBy("c", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])).alias("formatted"),
        F.count_if("old").alias("repeated"),
        F.sort_array(F.collect_list(F.when(target, mask))).alias("spans"),
    ).select("conv_id", "window", "formatted", "repeated", "spans")


def read_back(formatted: Column, repeated: Column) -> Column:
    """The (role, text) turns that a window holds for the first time."""
    parts = F.slice(F.split(formatted, r"<s>\[ROLE=", -1), (repeated + 2).cast("int"), F.lit(1 << 30))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "]", 1)).alias("role"),
            unescape(F.regexp_replace(p.substr(F.instr(p, "]") + 1, F.length(p)), F.lit("</s>$"), F.lit(""))).alias("text"),
        ),
    )


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, what its windows say when they are read back."""
    turns = read_back(F.col("formatted"), F.col("repeated"))
    told = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, s["length"].cast("int")))))
    each = made.withColumn("turns", turns).select("conv_id", "window", F.size("turns").alias("n"), told.alias("told"), loss.alias("loss"), F.length("formatted").alias("chars"))
    whole = lambda c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]))
    return each.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), whole("told").alias("told"), whole("loss").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op2_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return digests(windows(turns.union(extra)))
