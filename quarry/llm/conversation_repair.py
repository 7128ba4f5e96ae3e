"""Conversations checked and repaired: faults of turns, and the cheapest edits that make the roles alternate.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant in
turn.  Edits: keep (K, 0), rerole to user or assistant (R, 1), delete (D, 2; the only edit of blank and duplicate turns), insert
an empty user or assistant turn (I, 5); a truncated turn that stays costs 5 more.  Windows derive each turn's fault, the turns of
a conversation are collected as sorted structs, and one ``aggregate`` carries for each of four states - nothing yet, after a
system turn, after a user turn, after an assistant turn - the least (cost, audit).  An audit determines its cost, so of two
audits of equal cost over the same turns none begins the other, and taking the least early is right.

Defined cases: a null role or text is one space, a null turn sorts first and a null ``conv_id`` is a conversation of its own;
turns that tie go by role, then text.  A role is known by its first letter; an empty role can't be kept.  Columns other than
``conv_id turn role text`` are ignored.  An empty table gives no rows; a conversation without turns has zeros, an empty audit
and the hash of the empty text.  A conversation is one row of the result with all its text (the hash needs it whole), so its
turns meet in one task; their texts are gathered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANK = r"\A[\x20\x09-\x0D]*\z"
CUT_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
STATES = ("none", "system", "user", "assistant")


def turns_of(rows: DataFrame) -> DataFrame:
    """The rows as turns: ``conv_id turn role text copy present``."""
    return rows.select("conv_id", F.col("turn").cast("long"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(0).alias("copy"), F.lit(True).alias("present"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns after the damage that ``crc32(conv_id:turn) % 20`` names; a dropped turn stays as a row that isn't present."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind != 0).alias("present"))


def flagged(turns: DataFrame) -> DataFrame:
    """Turns with ``fault`` (blank, duplicate, truncated or null: the first that holds) and ``illegal``, against the turn before."""
    alike = Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn", "copy")
    order = Window.partitionBy("conv_id", "present").orderBy("turn", "role", "text", "copy")
    again = F.row_number().over(alike) > 1
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(again, "duplicate").when(F.col("text").rlike(CUT_OFF), "truncated")
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    return turns.repartition("conv_id").withColumns({"fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})


def collected(turns: DataFrame) -> DataFrame:
    """One row a conversation with its present turns as sorted structs."""
    turn = F.struct("turn", "role", "text", "copy", "fault", "illegal")
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("present"), turn))).alias("turns"))


def _plus(path: Column, cost: Column | int, edit: Column | str) -> Column:
    """The path with one more edit; null where the state can't be reached."""
    cost, edit = (x if isinstance(x, Column) else F.lit(x) for x in (cost, edit))
    return F.when(path.isNotNull(), F.struct((path["cost"] + cost).cast("long").alias("cost"), F.concat(path["audit"], edit).alias("audit")))


def _states(*paths: Column) -> Column:
    return F.struct(*(p.alias(s) for p, s in zip(paths, STATES, strict=True)))


def _inserted(acc: Column) -> Column:
    """The states after any inserted turns; more than two in a row never pay."""
    none, system, user, assistant = (acc[s] for s in STATES)
    user = F.least(user, *(_plus(p, INSERT, "I") for p in (none, system, assistant)))
    return _states(none, system, user, F.least(assistant, _plus(user, INSERT, "I")))


def _edited(acc: Column, turn: Column) -> Column:
    """The states after the turn is kept, reroled or deleted."""
    none, system, user, assistant = (acc[s] for s in STATES)
    initial, open_ = F.substring(turn["role"], 1, 1), F.coalesce(turn["fault"] == "truncated", turn["fault"].isNull())
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)

    def stays(path: Column, letter: str) -> Column:
        same = initial == letter
        return F.when(open_, _plus(path, extra + F.when(same, KEEP).otherwise(REROLE), F.when(same, "K").otherwise("R")))

    kept = F.when(open_ & (initial == "s"), _plus(none, extra + KEEP, "K"))
    gone = [_plus(p, DELETE, "D") for p in (none, system, user, assistant)]
    return _states(gone[0], F.least(gone[1], kept), F.least(gone[2], stays(F.least(none, system, assistant), "u")), F.least(gone[3], stays(user, "a")))


def cheapest(turns: Column) -> Column:
    """The least (cost, audit) over sorted turn structs."""
    path = "struct<cost:bigint,audit:string>"
    start = F.struct(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")).cast(path).alias("none"), *(F.lit(None).cast(path).alias(s) for s in STATES[1:]))
    kind = f"struct<{','.join(f'{s}:{path}' for s in STATES)}>"
    return F.aggregate(turns, _inserted(start).cast(kind), lambda acc, turn: _inserted(_edited(acc, turn)).cast(kind), lambda acc: F.least(acc["none"], acc["assistant"]))


def repaired(turns: Column, audit: Column) -> Column:
    """``role:text`` of each turn of the repaired conversation."""
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, edit: Column) -> Column:
        turn = F.get(turns, acc["next"] - 1)
        role = F.when(edit == "K", turn["role"]).when(acc["last"] == "u", "assistant").otherwise("user")
        line = F.concat(role, F.lit(":"), F.when(edit == "I", "").otherwise(turn["text"]))
        gone = edit == "D"
        return F.struct((acc["next"] + F.when(edit == "I", 0).otherwise(1)).alias("next"), F.when(gone, acc["last"]).otherwise(F.substring(role, 1, 1)).alias("last"), F.when(gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(line))).alias("out"))

    edits = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.aggregate(edits, start, step, lambda acc: acc["out"])


def repair(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id turns gaps blank duplicate truncated illegal cost audit repaired``.

    ``turns`` has ``conv_id turn role text copy present`` (see ``turns_of``)."""
    rows = collected(flagged(turns)).withColumn("best", cheapest(F.col("turns")))
    numbers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull()))
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers), F.lit(0)).cast("long")

    def count(held) -> Column:
        return F.size(F.filter("turns", held)).cast("long")

    def faulty(name: str) -> Column:
        return count(lambda t: t["fault"] == name).alias(name)

    faults = [faulty(name) for name in ("blank", "duplicate", "truncated")]
    return rows.select("conv_id", "turns", gaps.alias("gaps"), *faults, count(lambda t: t["illegal"]).alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired(F.col("turns"), F.col("best.audit")).alias("repaired"))


def digests(found: DataFrame) -> DataFrame:
    """The repaired conversations by the hash of their lines."""
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
