"""The message path as streams: decide and report, aggregate by release, cold starts, and samples that aren't yet stored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions import text as X
from textloom.operators import decisions, evaluation


def decided(messages: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Messages (sender, text) with label, confidence, action and sub_action; works on streams and tables alike."""
    made = decisions.first_rule(messages, rules).withColumnRenamed("action", "rule_action").withColumn("d", decisions.keyword_label(F.col("text")))
    action = F.coalesce("rule_action", decisions.route(F.col("d.label"), decisions.base_action(F.col("d.label")), F.col("d.confidence")))
    made = made.withColumns({"label": F.col("d.label"), "confidence": F.col("d.confidence"), "action": action})
    return made.withColumn("sub_action", decisions.sub_action(F.col("label"), F.col("action"))).drop("d", "rule_action")


def release_totals(events: DataFrame, by: str = "release") -> DataFrame:
    """Running totals of each release, of a stream in complete or update mode."""
    return evaluation.release_aggregate(events, by)


def cold_starts(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """Of a table: is_cold marks the first event of each session."""
    from pyspark.sql import Window

    return events.withColumn("is_cold", F.row_number().over(Window.partitionBy(session).orderBy(order)) == 1)


def cold_starts_stream(events: DataFrame) -> DataFrame:
    """Of a stream (session, seq): the same, by a flag kept for each session."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("seq")
        pdf["is_cold"] = False
        if not state.exists and len(pdf):
            pdf.iloc[0, pdf.columns.get_loc("is_cold")] = True
            state.update((True,))
        yield pdf[["session", "seq", "is_cold"]]

    return events.select("session", "seq").groupBy("session").applyInPandasWithState(run, "session string, seq long, is_cold boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def similar(a: str, b: str, least: float = 0.92, min_length: int = 12) -> bool:
    """Whether canonical texts are one, or share enough shingles of three."""
    if a == b:
        return True
    if min(len(a), len(b)) < min_length:
        return False
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) >= least


def unseen_samples(samples: DataFrame) -> DataFrame:
    """Of a stream (id, label, text): samples unlike any kept before under their label."""
    made = samples.select("id", "label", "text", X.canonical(F.col("text")).alias("c")).where("label is not null and text is not null")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        out = []
        for pdf in batches:
            for row in pdf.sort_values("id").itertuples(index=False):
                if not any(similar(row.c, k) for k in kept):
                    kept.append(row.c)
                    out.append((row.id, row.label, row.text))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["id", "label", "text"])

    return made.groupBy("label").applyInPandasWithState(run, "id string, label string, text string", "kept array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed_latency(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and the greatest latency of each release in windows of event time; a Spark extra, events later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "release").agg(F.count("*").alias("n"), F.max("latency_ms").alias("highest"))
