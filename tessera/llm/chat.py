r"""Chat formatting by event-sourced reconstruction.

A log has one row per event: (conversation, message, seq, kind, role, text). Per message, in the order of seq:
`message` sets role and text; `delta` appends to the text; `edit` replaces the text; `regenerate` empties it, ends all
later messages of the conversation that began before it, and further deltas stream the new attempt. The fold is per
message, so a conversation that holds a third of all events is spread over many tasks; what has to go through a whole
conversation (offsets, digests) streams over its sorted messages and never gathers them.

A message is rendered as

    ### Role: text </turn>

with a line feed after it. In texts and roles, `\`, `###` and `</turn>` get a backslash before them, so that no text can
open or close a turn, and reading is exact: a backslash gives the sign after it.

Roles system, user, assistant and tool are capitalised; any other role r is written as `=r`, with colons escaped too.

Defined results: null text is empty, a null role is the empty role; events of the same seq are ordered by kind (message,
regenerate, edit, delta) and text; unknown or null kinds are ignored; a message without a `message` event has an empty
role; rows without conversation id form a conversation of their own; repeated rows are repeated events; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpoint, partitions

ROLES = ("system", "user", "assistant", "tool")
KINDS = ("message", "regenerate", "edit", "delta")
END = " </turn>\n"


def fold(log: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, message, role, text) of the final messages."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    events = log.select(F.col(conv).alias("conv_id"), F.col(message).alias("message"), F.col(seq).alias("seq"), rank.alias("k"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("k > 0")
    held = F.sort_array(F.collect_list(F.struct("seq", "k", "text", "role")))
    folded = F.aggregate(
        "events",
        F.lit(""),
        lambda t, e: F.when(e["k"] == 4, F.concat(t, e["text"])).when(e["k"] == 2, F.lit("")).otherwise(e["text"]),
    )
    messages = events.groupBy("conv_id", "message").agg(
        held.alias("events"),
        F.min("seq").alias("began"),
        F.max(F.when(F.col("k") == 2, F.col("seq"))).alias("again"),
        F.max(F.when(F.col("k") == 1, F.struct("seq", "role"))).alias("named"),
    )
    if events.where("k = 2").limit(1).count():
        # the latest regeneration of the messages before: within ranges of the order, then over the ranges that share a conversation
        spark = log.sparkSession
        ranged = checkpoint(messages.repartitionByRange(partitions(spark), "conv_id", "message").withColumn("__p", F.spark_partition_id()))
        inside = Window.partitionBy("__p", "conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy("__c").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
        ends = ranged.groupBy(F.col("conv_id").alias("__c"), F.col("__p").alias("__q")).agg(F.max("again").alias("top")).withColumn("carried", F.max("top").over(before))
        both = ranged.withColumn("inside", F.max("again").over(inside)).join(ends, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__p") == F.col("__q")))
        messages = both.withColumn("ended", F.greatest("inside", "carried")).where("ended is null or ended < began")
    return messages.select("conv_id", "message", F.coalesce(F.col("named.role"), F.lit("")).alias("role"), folded.alias("text"))


def escape(text: Column) -> Column:
    for sign in ("\\", "###", "</turn>"):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return text


def render(messages: DataFrame, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages with formatted, and with loss_start and loss_end: where the text under the loss mask sits in it (code points)."""
    role = F.coalesce(F.col("role"), F.lit(""))
    name = F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\:"))))
    head = F.concat(F.lit("### "), name, F.lit(": "))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    trained = role.isin(*train)
    return messages.select(
        "*",
        F.concat(head, body, F.lit(END)).alias("formatted"),
        F.when(trained, F.length(head)).cast("long").alias("loss_start"),
        F.when(trained, F.length(head) + F.length(body)).cast("long").alias("loss_end"),
    )


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*?) </turn>\n", re.S)
_PAIR = re.compile(r"\\(.)", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; refuses anything that isn't a sequence of turns."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        name = m[1]
        out.append((_PAIR.sub(r"\1", name[1:]) if name.startswith("=") else name.lower(), _PAIR.sub(r"\1", m[2])))
        at = m.end()
    return out


def conversations(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the rendered messages.

    Messages stream by in order; a conversation needs three counters and two hash states, however long it is."""
    n = rendered.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rendered.select("conv_id", "message", "formatted", "loss_start", "loss_end").repartition(int(n), "conv_id").sortWithinPartitions("conv_id", "message")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{turn}\n".encode())
                if a is not None:
                    masked = _PAIR.sub(r"\1", text[a:b])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
                done.clear()
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """conversations as a log: every row is the event that sets its message. Conversation -7 writes control strings.

    Rows that share conversation and turn are messages of their own, in the order of role and text."""
    from tessera.llm.common import read

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    log = rows.unionByName(extra).withColumn("message", F.struct(F.col("turn").alias("turn"), copy.alias("copy")))
    log = log.select("conv_id", "message", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
    return conversations(render(fold(log)))


#: Turns are escaped by the definition; what is read back is then what was written, so digests are of the table's own texts.
SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as er, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as et from c),
f as (select *, '### ' || case when role in ('system', 'user', 'assistant', 'tool') then upper(left(role, 1)) || substr(role, 2) else '=' || replace(er, ':', '\:') end || ': ' || et || ' </turn>' || chr(10) as formatted from e)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(length(formatted))::bigint as formatted_chars
from f group by conv_id"""
