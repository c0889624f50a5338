"""Chat formatting by event-sourced reconstruction.

A conversation log is a table of events (conv_id, seq, turn, kind, role, text). Events of one turn are sorted by seq and folded:

    message     opens a message with its role and text
    delta       appends its text to the turn's open message
    edit        puts its text in place of the open message's
    regenerate  throws the open message's text away and begins again with its own

The messages, by turn, are rendered as `<|im_start|>role`, line feed, text, `<|im_end|>`, line feed. Inside texts a `<`, any
number of backslashes and a `|` get one backslash more, so no control string can arise from content and reading back takes one
away: the rendering is reversible. In a role the backslash and the line feed are escaped as well.

The work is split so that no step sorts a whole conversation: each turn is folded alone, runs of RUN turns are joined to one
string, and a conversation's runs are joined last; only its result, one string, is ever in one place.

Cases: null roles and texts are empty; a null conv_id is one conversation; two `message` events of one turn are two messages,
ties of seq are ordered by kind (messages first), role and text, so repeated rows give the same output in any order; a delta,
edit or regenerate without an open message opens one; an unknown kind, or none, is a message. An empty log gives no rows;
very long texts and turns of very many deltas are folded whole, in one pass. Columns that aren't the log's are dropped, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that are joined to one string at a time.
RUN = 64
_CONTROL = r"<(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    # The line feed's mark is told from an escaped backslash by splitting at the latter first.
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def fold_turns(events: DataFrame) -> DataFrame:
    """(conv_id, turn, messages array<struct<role, text>>), the events of each turn folded by seq."""
    kind = F.lower(F.coalesce(F.col("kind"), F.lit("message")))
    order = F.when(kind == "delta", 1).when(kind == "edit", 2).when(kind == "regenerate", 3).otherwise(0)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    event = F.struct(F.col("seq"), order.alias("kind"), role.alias("role"), text.alias("text"))
    grouped = events.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("e"))

    def message(at: Column, k: Column) -> Column:
        """The message that opens at the event `at`: its text is that of the last event that isn't a delta, and the deltas after it."""
        end = F.coalesce(F.get(F.col("opens"), k + 1), F.size("e"))
        own = F.slice(F.col("e"), at + 1, end - at)
        last = F.array_max(F.filter(F.transform(own, lambda x, i: F.when((x["kind"] != 1) | (i == 0), i)), lambda i: i.isNotNull()))
        return F.struct(F.get(own, F.lit(0))["role"].alias("role"), F.array_join(F.transform(F.slice(own, last + 1, F.size(own)), lambda x: x["text"]), "").alias("text"))

    # Each event is in one message's slice, so a turn takes time in proportion to its events. Most are complete messages as they are.
    opens = F.filter(F.sequence(F.lit(0), F.size("e") - 1), lambda i: (i == 0) | (F.get(F.col("e"), i)["kind"] == 0))
    grouped = grouped.withColumn("opens", F.when(F.exists("e", lambda e: e["kind"] != 0), opens))
    plain = F.transform("e", lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    folded = F.when(F.col("opens").isNotNull(), F.transform("opens", message)).otherwise(plain)
    return grouped.select("conv_id", "turn", folded.alias("messages"))


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row for each conversation."""
    turns = fold_turns(events).select(
        "conv_id",
        "turn",
        F.array_join(
            F.transform("messages", lambda m: F.concat(F.lit(START), _role(m["role"]), F.lit("\n"), escape(m["text"]), F.lit(END))), ""
        ).alias("piece"),
    )
    runs = turns.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "").alias("piece")
    )
    whole = F.transform(F.sort_array(F.collect_list(F.struct("run", "piece"))), lambda x: x["piece"])
    return runs.groupBy("conv_id").agg(F.array_join(whole, "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)

    def one(p: Column) -> Column:
        at = F.instr(p, "\n")
        role, rest = F.substring(p, F.lit(1), at - 1), F.substring(p, at + 1, F.length(p) - at - len(END))
        return F.struct(_unrole(role).alias("role"), unescape(rest).alias("text"))

    return F.transform(parts, one)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, and what the loss mask covers (assistant texts), all read back from the output."""
    read = formatted.withColumn("m", read_back(F.col("formatted")))
    turns = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("m", lambda m: m["role"] == "assistant"), lambda m: m["text"]), "")
    return read.select("conv_id", F.size("m").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"), "formatted").select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """Complete messages, one row each, as a log."""
    c = conversations
    return c.select(c.conv_id, c.turn.alias("seq"), c.turn, F.lit("message").alias("kind"), c.role, c.text)
