"""Rules of training records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_order(roles: Column, first: str = "user", last: str = "assistant", allow_system: bool = True) -> Column:
    """The code of the first rule that an array of roles breaks; null if none.

    In this order: a system message anywhere but first (or at all, where not allowed); no turns besides it; a wrong
    first turn; then, pair by pair, a tool message not after an assistant or tool message, or two user or assistant
    turns in a row; a wrong last turn.
    """
    number = F.size(roles)
    head = F.get(roles, F.lit(0)) == "system"
    turns = F.when(head, F.slice(roles, 2, F.greatest(number - 1, F.lit(0)))).otherwise(roles)
    later = F.slice(roles, 2, F.greatest(number - 1, F.lit(0))) if allow_system else roles
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(turns) - 1, F.lit(1))), lambda i: F.struct(F.get(turns, i - 1).alias("a"), F.get(turns, i).alias("b")))

    def broken(p: Column) -> Column:
        orphan = (p["b"] == "tool") & ~p["a"].isin("assistant", "tool")
        same = (p["a"] == p["b"]) & p["b"].isin("user", "assistant")
        return F.when(orphan, "orphan_tool_message").when(same, "consecutive_same_role")

    return (
        F.when(F.array_contains(later, "system"), "misplaced_system_message")
        .when(F.size(turns) == 0, "no_turns")
        .when(F.get(turns, F.lit(0)) != first, f"first_turn_not_{first}")
        .otherwise(F.coalesce(F.get(F.filter(F.transform(pairs, broken), lambda x: x.isNotNull()), F.lit(0)), F.when(F.element_at(roles, -1) != last, f"last_turn_not_{last}")))
    )


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, messages)``: a row per conversation with its messages in order; bounded by a conversation."""
    grouped = turns.groupBy(turns[id_col].alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return grouped


def check_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, reasons)``: all codes that a conversation breaks, sorted; none for a valid one."""
    grouped = conversations(turns)
    roles = F.transform("messages", lambda m: m["role"])
    blank = F.exists("messages", lambda m: F.coalesce(m["content"].rlike(r"(?U)^\s*$"), F.lit(True)))
    short = F.size("messages") < 2
    unknown = F.exists(roles, lambda r: ~F.coalesce(r.isin("system", "user", "assistant", "tool"), F.lit(False)))
    codes = F.array(F.when(blank, "blank_text"), F.when(short, "too_short"), F.when(unknown, "literal_error"))
    codes = F.filter(codes, lambda c: c.isNotNull())
    order = turn_order(roles)
    all_codes = F.when(F.size(codes) > 0, codes).when(order.isNotNull(), F.array(order)).otherwise(F.array().cast("array<string>"))
    return grouped.select("conv_id", F.array_sort(all_codes).alias("reasons"))


def reason_counts(checked: DataFrame) -> DataFrame:
    """``(reason, records)``: a record counts once for each distinct code."""
    return checked.select(F.explode(F.array_distinct("reasons")).alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))


def funnel(checked: DataFrame, most_quarantined: float | None = None) -> DataFrame:
    """``(total, valid, quarantined, rate, withheld)``: withheld if the rate exceeds the limit."""
    bad = F.count_if(F.size("reasons") > 0)
    rate = F.when(F.count("*") == 0, 0.0).otherwise(bad / F.count("*"))
    out = checked.agg(F.count("*").alias("total"), (F.count("*") - bad).alias("valid"), bad.alias("quarantined"), F.round(rate, 6).alias("rate"))
    return out.withColumn("withheld", F.col("rate") > F.lit(most_quarantined if most_quarantined is not None else 1.0))


def text_fields(messages: Column) -> tuple[Column, Column]:
    """Prompt (all messages but the last, by lines) and response (the last)."""
    contents = F.transform(messages, lambda m: m["content"])
    return F.array_join(F.slice(contents, 1, F.greatest(F.size(contents) - 1, F.lit(0))), "\n"), F.element_at(contents, -1)


def content_id(messages: Column) -> Column:
    """16 hex digits of the sha256 of the canonical JSON of roles and contents."""
    plain = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return F.substring(F.sha2(F.concat(F.lit('{"messages":'), F.to_json(plain), F.lit("}")), 256), 1, 16)


def duplicate_ids(rows: DataFrame, id_col: str, order: str, content: str) -> DataFrame:
    """``(id, line, first_line, same_content)`` of rows whose id an earlier row has."""
    least = rows.groupBy(F.col(id_col).alias("id")).agg(F.min(order).alias("first_line"), F.min_by(content, order).alias("first_content"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(least, rows[id_col] == least["id"]).where(F.col(order) > F.col("first_line"))
    return found.select("id", F.col(order).alias("line"), "first_line", (F.col(content) == F.col("first_content")).alias("same_content"))


def preference_code(chosen: Column, rejected: Column, score_chosen: Column, score_rejected: Column) -> Column:
    """identical_responses (white space aside), then chosen_scored_below_rejected; null if neither."""
    squeeze = lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(squeeze(chosen) == squeeze(rejected), "identical_responses").when(score_chosen < score_rejected, "chosen_scored_below_rejected")
