"""Conversations put right: faults found by windows, then the cheapest edits by a fold over the sorted turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits; a truncated turn that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns that are folded from each state; longer conversations are folded block by block.
BLOCK = 512
#: What has been kept so far: nothing, the system's turn, a user's turn last, an assistant's turn last. Nothing and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: More than any sum of costs.
NEVER = 1 << 60


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str = "present") -> DataFrame:
    """``conv, turn, role, text, present`` with faults planted by crc32("conv:turn") modulo 20; nulls are read as one space there,
    in roles and in texts.

    0 drops the row (it stays, not ``present``, so that its conversation is known), 1 empties the text, 2 takes its ``[.!?]``
    out, 3 repeats the row, 4 makes the role ``user``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv), F.col(turn), space(role).alias(role), space(text).alias(text), kind.alias("_kind"))
    rows = rows.withColumns({
        text: F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)),
        role: F.when(F.col("_kind") == 4, "user").otherwise(F.col(role)),
        present: F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col("_kind") != 0))),
    })
    return rows.drop("_kind")


def _state(cost: Column, path: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), path.alias("path"))


def _after(s: Column, cost, token: str) -> Column:
    return _state(s["cost"] + cost, F.concat(s["path"], F.lit(token)))


def _inserted(states: list[Column]) -> list[Column]:
    """States after as many insertions as pay: each state expects one role, so an insertion leads to one other state."""
    start, system, user, assistant = states
    user = F.least(user, _after(start, INSERT, "Iu"), _after(system, INSERT, "Iu"), _after(assistant, INSERT, "Iu"))
    assistant = F.least(assistant, _after(user, INSERT, "Ia"))
    return [start, system, user, assistant]


def _edited(states: list[Column], row: Column) -> list[Column]:
    """States after one turn, which is kept, given another role or deleted."""
    start, system, user, assistant = states
    gone, stays = [_after(s, DELETE, "D-") for s in states], ~row["bad"]
    worse = F.when(row["cut"], TRUNCATED).otherwise(0)
    never = _state(F.lit(NEVER), F.lit(""))
    kept = lambda s, c: F.when(stays & (row["initial"] == c), _after(s, worse, "K-")).otherwise(never)
    other = lambda s, c: F.when(stays, _after(s, worse + REROLE, "R" + c)).otherwise(never)
    to_user = [f(s, "u") for s in (start, system, assistant) for f in (kept, other)]
    return [gone[START], F.least(gone[SYSTEM], kept(start, "s")), F.least(gone[USER], *to_user), F.least(gone[ASSISTANT], kept(user, "a"), other(user, "a"))]


def _bound(states: list[Column], then) -> Column:
    """``then`` of four states that are worked out once and not wherever they are named."""
    return F.transform(F.array(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])), lambda s: then([s[f"s{i}"] for i in range(4)]))[0]


def _four(states: list[Column]) -> Column:
    return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(states)])


def folded(rows: Column, begin: Column) -> Column:
    """Four (cost, path) structs, one for each state, after the sorted turns ``rows`` from the state with the number ``begin``.

    A path has two letters for each edit: D, I, K or R, and the role that an inserted or changed turn gets (``-`` without one).
    Costs and the role's letters follow from the edits and the first state, so the least path is that of the ASCII-least edits;
    and of two equally cheap paths to a state neither begins with the other, so the least one stays least whatever follows.
    """
    at = lambda i: _state(F.when(begin == i, 0).otherwise(NEVER), F.lit(""))
    first = _bound([at(i) for i in range(4)], lambda s: _four(_inserted(s)))
    step = lambda acc, row: _bound(_edited([acc[f"s{i}"] for i in range(4)], row), lambda s: _four(_inserted(s)))
    return F.aggregate(rows, first, step)


def _linked(matrices: Column) -> Column:
    """The states after all blocks; each block gives four states for each state that it can be begun in."""
    joined = lambda s, t: _state(F.least(F.lit(NEVER), s["cost"] + t["cost"]), F.concat(s["path"], t["path"]))
    step = lambda acc, m: _four([F.least(*[joined(acc[f"s{i}"], m[i][f"s{j}"]) for i in range(4)]) for j in range(4)])
    return F.aggregate(F.slice(matrices, 2, F.greatest(F.size(matrices) - 1, F.lit(0))), F.get(matrices, F.lit(0))[0], step)


def _inserts(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(path, F.lit("I([ua])"), 1), lambda c: _turn(F.lit("I"), _role(c), F.lit("")))


def _turn(edit: Column, role: Column, text: Column) -> Column:
    return F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))


def _role(letter: Column) -> Column:
    return F.when(letter == "u", "user").otherwise("assistant")


def _applied(path: Column, rows: Column) -> Column:
    """The turns that a path leaves and makes: each part of it has the insertions before a row and the row's own edit."""
    parts = F.regexp_extract_all(path, F.lit("(?:I[ua])*(?:K-|D-|R[ua])"), 0)
    none = F.array().cast("array<struct<edit:string,role:string,text:string>>")
    own = lambda p, r: (
        F.when(F.endswith(p, F.lit("K-")), F.array(_turn(F.lit("K"), r["role"], r["text"])))
        .when(F.endswith(p, F.lit("D-")), none)
        .otherwise(F.array(_turn(F.lit("R"), _role(F.substring(p, -1, 1)), r["text"])))
    )
    return F.concat(F.flatten(F.zip_with(parts, rows, lambda p, r: F.concat(_inserts(p), own(p, r)))), _inserts(F.regexp_extract(path, "((?:I[ua])*)$", 1)))


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row a conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` and ``turns``, the repaired
    ``array<struct<edit, role, text>>``.

    Turns are ordered by ``turn`` (nulls first), then role and text. A turn is ``blank`` without a character besides white space,
    else ``duplicate`` if one before has its role and text, else ``truncated`` if its last such character is none of ``.!?``.
    Roles' first letters have to be ``(s?(ua)+)?`` in the end. Keeping a turn costs nothing, another role (user or assistant) 3,
    deletion 4 (blank and duplicate turns have to go), insertion of a turn without text 3; a truncated turn that stays 3 more.
    ``audit`` has the letters K, R, D, I of the cheapest edits, of equally cheap ones the ASCII-least. ``illegal`` counts
    neighbours whose roles' first letters aren't su, ua or au, ``gaps`` the numbers that lack between the least and the greatest.

    Null roles and texts are read as one space; a null id is a conversation like any other. Rows that aren't ``present`` count
    for nothing, but their conversation is in the result: zeros, an empty audit, no turns. Further columns are left out.

    One shuffle, by conversation: windows and both groupings share it. Turns are collected ``BLOCK`` at a time and folded from
    each of the four states; blocks then take one step each, so time grows with a conversation's length and not its square. The
    sort and the windows before spill; the result of a conversation is one row and has to fit one (2 GB), else the job stops.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), there.alias("here"))
    rows = rows.repartition("conv").withColumn("initial", F.substring("role", 1, 1))
    by = Window.partitionBy("conv", "here").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(by) - 1, "before": F.lag("initial").over(by), "last_turn": F.lag("turn").over(by)})
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv", "here", "role", "text").orderBy("pos")) > 1)
    # what is left of a text without the white space behind it
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    blank = body == ""
    duplicate = ~blank & F.col("seen")
    cut = ~blank & ~F.col("seen") & ~F.substring(body, -1, 1).isin(".", "!", "?")
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    flags = {"blank": blank, "duplicate": duplicate, "truncated": cut, "illegal": F.col("before").isNotNull() & ~legal, "fresh": fresh}
    rows = rows.withColumns({"block": F.floor(F.col("pos") / BLOCK), **flags})
    here = lambda c: F.when(F.col("here"), c)
    row = F.struct("pos", (F.col("blank") | F.col("duplicate")).alias("bad"), F.col("truncated").alias("cut"), "initial", "role", "text")
    counts = [F.count_if(F.col("here") & F.col(c)).alias(c) for c in flags]
    blocks = rows.groupBy("conv", "here", "block").agg(*counts, F.min(here(F.col("turn"))).alias("low"), F.max(here(F.col("turn"))).alias("high"), F.array_sort(F.collect_list(here(row))).alias("rows"))
    begins = F.when(F.col("block") == 0, F.array(F.lit(START))).otherwise(F.array(*map(F.lit, range(4))))
    blocks = blocks.withColumn("block", here(F.struct("block", F.transform(begins, lambda b: folded(F.col("rows"), b)).alias("matrix"), "rows")))
    sums = [F.sum(c).alias(c) for c in flags]
    convs = blocks.groupBy("conv").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list("block")).alias("blocks"))
    ends = F.when(F.size("blocks") > 0, _linked(F.transform("blocks", lambda b: b["matrix"])))
    convs = convs.withColumn("end", ends).withColumn("end", F.least(F.col("end")[f"s{START}"], F.col("end")[f"s{ASSISTANT}"]))
    whole = F.flatten(F.transform("blocks", lambda b: b["rows"]))
    path = F.coalesce(F.col("end.path"), F.lit(""))
    return convs.select(
        F.col("conv").alias(conv),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("fresh"), F.lit(0)).cast("bigint").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal",
        F.coalesce(F.col("end.cost"), F.lit(0)).cast("bigint").alias("cost"),
        F.translate(path, "-ua", "").alias("audit"),
        _applied(path, whole).alias("turns"),
    )
