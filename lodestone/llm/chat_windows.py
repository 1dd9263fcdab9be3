"""Chat formatting in budgeted windows of whole turns.

A turn is written between markers that name its role; the characters that
markers are made of are escaped in texts and roles, so whatever a text says, it
can't be read as a marker, and unescaping gives it back.

Prefix sums of the turns' tokens choose the windows: from a turn on, a window is
the longest span of turns that fits the budget together with the system turn and
the history that it repeats, the last turns before it as far as their allowance
goes. A turn that only fits without history has none. A turn that does not fit
even so has a window of its own beyond the budget, as nothing is cut or dropped;
its window says so (fits is false). The spans follow one another, so they are
found by folding the token counts, in stretches of STRETCH budgets: a window does
not pass from one stretch into the next, and no fold gets longer than that. The
loss mask has the texts of assistant turns where they are new; repeated ones are
context.

All of it is DataFrame expressions. Windows are chosen on numbers alone; the
texts are joined once, by turn.

Defined results: null texts count as empty, a null role as an empty one; rows of
a conversation are ordered by turn, role and text, nulls first, and repeated rows
are turns of their own; rows without a conversation id are one conversation; an
empty table gives an empty table; other columns are not read. The system turn is
the first row, if its role is system. A conversation's windows are one row's
text each; only the digests of a whole conversation need it in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

OPEN, AFTER_ROLE, CLOSE = "<turn:", ">", "</turn>"
#: Characters of the markers, and how texts have them; the first escape is that of the escapes' own sign.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
BUDGET, HISTORY, CHARS_PER_TOKEN = 1_024, 256, 4
#: Budgets of tokens that are folded together.
STRETCH = 64
TARGET, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, k, head, body, tokens, is_system, is_target), staged: a conversation's turns numbered from 1; conv holds its id, null or not."""
    rows = turns.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("said"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "said")
    head, body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE)), escape(F.col("said"))
    rows = rows.select("conv", "role", F.row_number().over(order).alias("k"), head.alias("head"), body.alias("body"))
    tokens = F.ceil((F.char_length("head") + F.char_length("body") + len(CLOSE)) / CHARS_PER_TOKEN)
    return staged(rows.select("conv", "k", "head", "body", tokens.alias("tokens"), ((F.col("k") == 1) & (F.col("role") == SYSTEM)).alias("is_system"), (F.col("role") == TARGET).alias("is_target")), "chat-turns")


def _spans(new: Column, budget: int) -> Column:
    """The windows (k of the first turn, bare: without history) over turns (k, tokens, past: the history's tokens, system), by a fold."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("room"), F.array().cast("array<struct<k:int,bare:boolean>>").alias("found"))

    def step(state: Column, turn: Column) -> Column:
        whole = F.lit(budget).cast("long") - turn["system"]
        bare = turn["tokens"] > whole - turn["past"]
        opened = F.struct(turn["tokens"].alias("used"), F.when(bare, whole).otherwise(whole - turn["past"]).alias("room"), F.concat(state["found"], F.array(F.struct(turn["k"].alias("k"), bare.alias("bare")))).alias("found"))
        longer = F.struct((state["used"] + turn["tokens"]).alias("used"), state["room"].alias("room"), state["found"].alias("found"))
        return F.when(state["used"] + turn["tokens"] <= state["room"], longer).otherwise(opened)

    return F.aggregate(new, start, step, lambda state: state["found"])


def _chosen(numbers: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, window, k, is_new): the turns of each window, repeated ones with is_new 0. numbers: (conv, k, tokens, is_system)."""
    by_turn = Window.partitionBy("conv").orderBy("k")
    own = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    rows = numbers.withColumn("prefix", F.coalesce(F.sum(own).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("system", F.sum(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(by_turn)).filter("NOT is_system")
    # the history's tokens: back to the first turn whose prefix is within the allowance
    within = Window.partitionBy("conv").orderBy("prefix").rangeBetween(-history, 0)
    rows = staged(rows.withColumn("past", F.col("prefix") - F.min("prefix").over(within)).drop("is_system"), "chat-numbers")
    turn = F.struct("k", *(F.col(c).cast("long").alias(c) for c in ("tokens", "past", "system", "prefix")))
    folded = rows.groupBy("conv", F.floor(F.col("prefix") / (STRETCH * budget)).alias("stretch")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    folded = folded.select("conv", "turns", F.element_at("turns", 1)["k"].alias("low"), F.element_at("turns", -1)["k"].alias("high"), _spans(F.col("turns"), budget).alias("found"))
    following = lambda i: F.coalesce(F.get("found", i + 1)["k"] - 1, F.col("high"))
    spans = F.transform("found", lambda x, i: F.struct(x["k"].alias("first"), following(i).alias("last"), x["bare"].alias("bare"), F.get("turns", x["k"] - F.col("low"))["prefix"].alias("begin")))
    spans = folded.select("conv", F.inline(spans))
    windows = staged(spans.withColumn("window", F.row_number().over(Window.partitionBy("conv").orderBy("first")) - 1), "chat-spans")
    new = windows.select("conv", "window", F.explode(F.sequence("first", "last")).alias("k"), F.lit(1).alias("is_new"))
    system, later = numbers.filter("is_system").select("conv", "k"), windows.filter("window > 0")
    new = new.unionByName(system.select("conv", F.lit(0).alias("window"), "k", F.lit(1).alias("is_new")))
    carried = later.select("conv", "window").join(system, "conv").withColumn("is_new", F.lit(0))
    # a turn within the allowance before a window stands in the same part of the conversation, or in the part before
    part = F.floor(F.col("prefix") / max(1, history))
    near = rows.select("conv", "k", "prefix", F.explode(F.array(part, part + 1)).alias("part"))
    begun = later.filter("NOT bare").select("conv", "window", "begin", F.floor(F.col("begin") / max(1, history)).alias("part"))
    repeated = near.join(begun, ["conv", "part"]).filter((F.col("prefix") < F.col("begin")) & (F.col("begin") - F.col("prefix") <= history))
    return new.unionByName(carried).unionByName(repeated.select("conv", "window", "k", F.lit(0).alias("is_new")))


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_context, text, loss, tokens, fits): one row per window.

    n_context turns at the beginning are repeated; loss has the spans (start, size,
    in code points of text) that are trained on; fits tells whether the window's
    tokens are within the budget.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    everything = _chosen(rows.select("conv", "k", "tokens", "is_system"), budget, history).join(rows.drop("is_system"), ["conv", "k"])
    whole = F.concat("head", "body", F.lit(CLOSE))
    inside = Window.partitionBy("conv", "window").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("head") + F.char_length("body") + len(CLOSE)).over(inside), F.lit(0)) + F.char_length("head")
    span = F.when((F.col("is_new") == 1) & F.col("is_target"), F.struct(start.alias("start"), F.char_length("body").cast("long").alias("size")))
    placed = everything.select("conv", "window", "k", "is_new", "tokens", whole.alias("turn_text"), span.alias("span"))
    grouped = placed.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("k", "is_new", "turn_text", "span"))).alias("turns"), F.sum("tokens").alias("tokens"))
    return grouped.select(
        F.col("conv.id").alias("conv_id"),
        "window",
        F.size(F.filter("turns", lambda t: t["is_new"] == 0)).alias("n_context"),
        F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("text"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        "tokens",
        (F.col("tokens") <= budget).alias("fits"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, n_chars) of formatted windows: the new turns (role, text) and the texts under the loss mask, unescaped."""
    pieces = F.split("text", CLOSE)
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    role = lambda p: unescape(F.substring(F.substring_index(p, AFTER_ROLE, 1), len(OPEN) + 1, 1 << 30))
    body = lambda p: unescape(F.substr(p, F.instr(p, AFTER_ROLE) + 1))
    return windows.select(
        "conv_id",
        "window",
        F.transform(new, lambda p: F.struct(role(p).alias("role"), body(p).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), s["size"].cast("int")))).alias("targets"),
        F.char_length("text").cast("long").alias("n_chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its formatted windows."""
    whole = read_turns(windows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("n_chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["targets"])), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def digests_sql(extra: tuple[tuple[int, int, str, str], ...]) -> str:
    """conversation_digests(format_windows(...)) of the table conversations and the extra turns, in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({c}, {t}, {quote(r)}, {quote(x)})" for c, t, r, x in extra)

    def escaped(column: str) -> str:
        for plain, other in ESCAPES:
            column = f"replace({column}, {quote(plain)}, {quote(other)})"
        return column

    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations UNION ALL SELECT * FROM (VALUES {rows})),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS k, {len(OPEN + AFTER_ROLE + CLOSE)} + length({escaped("role")}) + length({escaped("body")}) AS chars FROM t),
s AS (SELECT *, CAST(ceil(chars / {CHARS_PER_TOKEN}.0) AS BIGINT) AS tokens, k = 1 AND role = '{SYSTEM}' AS is_system FROM k),
p AS (SELECT *, coalesce(sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix,
  {BUDGET} - coalesce(max(CASE WHEN is_system THEN tokens END) OVER (PARTITION BY conv_id), 0) AS whole FROM s),
h AS (SELECT *, prefix - min(prefix) OVER (PARTITION BY conv_id ORDER BY prefix RANGE BETWEEN {HISTORY} PRECEDING AND CURRENT ROW) AS past, prefix // {STRETCH * BUDGET} AS stretch FROM p WHERE NOT is_system),
r AS (SELECT *, tokens > whole - past AS bare, CASE WHEN tokens > whole - past THEN whole ELSE whole - past END AS room FROM h),
e AS (SELECT a.conv_id, a.k, min(b.k) AS following FROM r a JOIN r b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.k > a.k AND (b.stretch > a.stretch OR b.prefix + b.tokens - a.prefix > a.room) GROUP BY 1, 2),
b AS (SELECT conv_id, min(k) AS k FROM r GROUP BY 1 UNION ALL SELECT b.conv_id, e.following FROM b JOIN e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.k = b.k),
w AS (SELECT r.conv_id, r.k, r.prefix, r.bare FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.k) > 1),
again AS (SELECT p.conv_id, sum(p.chars) AS chars FROM p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND (p.is_system OR (NOT w.bare AND p.k < w.k AND w.prefix - p.prefix <= {HISTORY})) GROUP BY 1)
SELECT n.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(body)) FILTER (role = '{TARGET}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(body, '' ORDER BY k) FILTER (role = '{TARGET}'), '')) AS loss_sha256,
  CAST(sum(n.chars) + coalesce(any_value(again.chars), 0) AS BIGINT) AS formatted_chars
FROM p n LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM n.conv_id GROUP BY 1"""
