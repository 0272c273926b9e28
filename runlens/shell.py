"""Conversations with the service: answer, ask whether it was right, learn if not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.triage import Triage

#: Words that end a conversation, and those that say yes.
LEAVE, YES = ("q", "quit", "exit"), ("y", "yes")


def replay(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of conversations with the roles before and after, and whether they leave."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    leaves = F.lower(F.trim(F.col("text"))).isin(*LEAVE)
    return turns.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), leaves.alias("leaves"))


def converse(triage: Triage, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> int:
    """Ask for errors until one of LEAVE or the end of input; the number of corrections taught. Blank lines are passed over."""
    taught = 0
    try:
        while True:
            text = ask("Error: ").strip()
            if text.lower() in LEAVE:
                break
            if not text:
                continue
            found = triage.search(triage.spark.createDataFrame([(0, text)], "qid bigint, text string")).first()
            say(f"{found['doc_path']} ({found['source']}, {found['confidence']:.2f}%)")
            if found["root_cause"]:
                say(f"Cause: {found['root_cause']}")
            if ask("Right? (y/n): ").strip().lower() in YES:
                continue
            path = ask("Path of the right document: ").strip()
            if path:
                triage.teach(triage.spark.createDataFrame([(text, path)], "text string, correct_doc_path string"))
                taught += 1
                say("Learned.")
    except EOFError:
        pass
    return taught
