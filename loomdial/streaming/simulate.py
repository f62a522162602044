"""Turn-by-turn simulation as bounded DataFrame rounds, with responders injected as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdial.functions.canon import MARKER
from loomdial.operators.dialogue import MESSAGES, next_role
from loomdial.session import cut

#: A responder gets the histories as Series of lists of dicts and the role that speaks, and gives the texts.
Responder = Callable[[pd.Series, pd.Series], pd.Series]


def echo_responder(histories: pd.Series, roles: pd.Series) -> pd.Series:
    """Offline stub: deterministic, ends after six messages."""
    out = []
    for h, r in zip(histories, roles):
        n = len(h)
        out.append(f"{r} {n}" + (f" {MARKER}" if r == "user" and n >= 6 else ""))
    return pd.Series(out)


def _reply(responder: Responder):
    @F.pandas_udf("struct<value:string,error:string>")
    def run(histories: pd.Series, roles: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": responder(histories, roles), "error": None})
        except Exception as e:  # a failed batch ends its conversations, not the job
            return pd.DataFrame({"value": [None] * len(histories), "error": [str(e)[:200]] * len(histories)})

    return run


def simulate(conversations: DataFrame, responder: Responder = echo_responder, budget: int = 8, marker: str = MARKER) -> DataFrame:
    """id, history, active, error after at most budget new messages.

    conversations: id, history (array of role, content). Users and assistants alternate; a user message with the marker, an error or the end of the
    budget stops a conversation. Each round appends one message to all active conversations and is checkpointed; finished ones are set aside.
    """
    reply = _reply(responder)
    state = conversations.select("id", F.coalesce("history", F.array()).cast(MESSAGES).alias("history")).withColumn("error", F.lit(None).cast("string"))
    done, live = [], state
    for _ in range(budget):
        said = live.withColumn("_role", next_role(F.col("history"))).withColumn("_r", reply("history", "_role"))
        grown = F.when(F.col("_r.value").isNotNull(), F.array_append("history", F.struct(F.col("_role").alias("role"), F.col("_r.value").alias("content")))).otherwise(F.col("history"))
        ended = F.col("_r.value").isNull() | ((F.col("_role") == "user") & F.col("_r.value").contains(marker))
        after = cut(said.select("id", grown.cast(MESSAGES).alias("history"), F.col("_r.error").alias("error"), ended.alias("_ended")))
        done.append(after.where("_ended").drop("_ended").withColumn("active", F.lit(False)))
        live = after.where("not _ended").drop("_ended")
        if live.isEmpty():
            break
    out = live.withColumn("active", F.lit(True))
    for d in done:
        out = out.unionByName(d)
    return out


def synthesize(conversations: DataFrame, candidates: Responder, score: Callable[[pd.Series, pd.Series], pd.Series], users: Responder = echo_responder, k: int = 3, turns: int = 2) -> DataFrame:
    """id, turn_id, candidate_no, completion, score, chosen: k scored candidates a turn; the best (the first of equals) is continued by the user's reply.

    Candidates are keyed rows: a conversation is exploded to k rows, answered and scored in batches, and the best is a partial aggregate.
    """
    answer, ask = _reply(candidates), _reply(users)

    @F.pandas_udf("double")
    def rate(histories: pd.Series, texts: pd.Series) -> pd.Series:
        return score(histories, texts).astype(float)

    live, out = conversations.select("id", F.col("history").cast(MESSAGES).alias("history")), None
    for _ in range(turns):
        rows = live.withColumn("candidate_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_role", F.lit("assistant"))
        seeded = F.array_append("history", F.struct(F.lit("system").alias("role"), F.concat(F.lit("candidate "), F.col("candidate_no").cast("string")).alias("content")))
        rows = rows.withColumn("completion", answer(seeded.cast(MESSAGES), F.col("_role"))["value"]).where("completion is not null")
        rows = cut(rows.withColumn("score", rate("history", "completion")).select("id", "history", "candidate_no", F.size("history").alias("turn_id"), "completion", "score"))
        best = rows.groupBy("id").agg(F.max_by(F.struct("candidate_no", "completion", "history"), F.struct("score", -F.col("candidate_no"))).alias("b"))
        marked = rows.join(best.select("id", F.col("b.candidate_no").alias("_best")), "id").withColumn("chosen", F.col("candidate_no") == F.col("_best"))
        marked = marked.select("id", "turn_id", "candidate_no", "completion", "score", "chosen")
        out = marked if out is None else out.unionByName(marked)
        nxt = best.select("id", F.array_append("b.history", F.struct(F.lit("assistant").alias("role"), F.col("b.completion").alias("content"))).cast(MESSAGES).alias("history")).withColumn("_role", F.lit("user"))
        nxt = nxt.withColumn("_u", ask("history", "_role")["value"]).where(F.col("_u").isNotNull() & ~F.col("_u").contains(MARKER))
        live = cut(nxt.select("id", F.array_append("history", F.struct(F.lit("user").alias("role"), F.col("_u").alias("content"))).cast(MESSAGES).alias("history")))
        if live.isEmpty():
            break
    return out


def needs_evaluation(dialogues: DataFrame, records: DataFrame) -> DataFrame:
    """id, digest of the dialogues without a record of the same digest: missing or stale."""
    return dialogues.join(records.select("id", F.col("digest")), ["id", "digest"], "left_anti")
