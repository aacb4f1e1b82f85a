"""Language models behind one seam: a model answers a table of prompts.

`replies(asked)` takes qid, role, call_no and prompt, and gives each row its reply (null if there is none) and, in reason, why it has none. Scripts are a table joined
natively; a live model is made once in each task, and a task waits out rate limits by itself.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

#: What a script may say in place of the first source that its prompt shows.
FIRST_SOURCE = "{source}"
APPROVAL = '{"faithful": true, "issues": "", "sufficient_context": true}'
#: Replies when a script has none left for a role: a query, and the judge's approval; a draft repeats the last one.
DEFAULTS = {"rewrite": "document search", "judge": APPROVAL}
#: Attempts of a call, the longest wait in seconds that makes sense, and the largest random addition to a wait.
ATTEMPTS, LONGEST_WAIT, JITTER = 4, 120.0, 1.0


@dataclass(frozen=True)
class Scripted:
    """Replies from a table (qid, role, call_no, text); each role of a question counts its own calls."""

    scripts: DataFrame

    def replies(self, asked: DataFrame) -> DataFrame:
        mine = self.scripts.select("qid", "role", "call_no", F.col("text").alias("reply"))
        last = self.scripts.where("role = 'draft'").groupBy("qid", "role").agg(F.max_by("text", "call_no").alias("last"))
        found = asked.join(mine, ["qid", "role", "call_no"], "left").join(last, ["qid", "role"], "left")
        default = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])[F.col("role")]
        reply = F.coalesce("reply", "last", default, F.lit(""))
        source = F.regexp_extract("prompt", r"\[arxiv:([^\]]+)\]", 1)
        return found.select(*asked.columns, F.replace(reply, F.lit(FIRST_SOURCE), source).alias("reply"), F.lit(None).cast("string").alias("reason"))


@dataclass(frozen=True)
class Failing:
    """A model that has no reply for some questions, for a reason that is given."""

    model: object
    at: Column
    reason: str

    def replies(self, asked: DataFrame) -> DataFrame:
        told = self.model.replies(asked)
        return told.withColumns({"reply": F.when(~self.at, F.col("reply")), "reason": F.when(self.at, F.lit(self.reason)).otherwise(F.col("reason"))})


def content_text(content) -> str:
    """The text of a message: a string, or a list of strings and typed blocks of which those of type text count."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return ""
    return "".join(b if isinstance(b, str) else str(b.get("text") or "") for b in content if isinstance(b, str) or (isinstance(b, dict) and b.get("type") == "text"))


_DELAY = re.compile(r"""retryDelay['"]?:\s*['"]?(\d+(?:\.\d+)?)s""")


def decide(error: str, attempt: int) -> tuple[str, float, str]:
    """What to do after a failed attempt (from 0): raise, give_up or wait; how long; and why. The same as functions.replies.retry_decision says of a column."""
    told = _DELAY.search(error)
    delay = float(told[1]) if told else float(2**attempt)
    if "429" not in error and "RESOURCE_EXHAUSTED" not in error:
        return "raise", delay, "no rate limit"
    if "PerDay" in error or "requests_per_day" in error.lower():
        return "give_up", delay, "daily quota"
    if delay > LONGEST_WAIT:
        return "give_up", delay, "wait too long"
    if attempt >= ATTEMPTS - 1:
        return "give_up", delay, "attempts used up"
    return "wait", delay, "rate limit"


def invoke(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0, JITTER)) -> tuple[str | None, str | None]:
    """The text of a call's reply, and null; or null, and why it was given up. An error that is no rate limit is told as it is, for the row alone."""
    for attempt in range(ATTEMPTS):
        try:
            return content_text(call()), None
        except Exception as e:  # noqa: BLE001  whatever a model's client raises
            action, delay, why = decide(str(e), attempt)
            if action != "wait":
                return None, f"{why}: {e}"
            sleep(delay + jitter())
    raise AssertionError("the last attempt gives up")


@dataclass(frozen=True)
class PerTask:
    """A live model: make() gives a function of role and prompt, once in each task that has prompts. sleep and jitter can be replaced.

    A task that is run again asks again, so results are stored before anything else reads them.
    """

    make: Callable[[], Callable[[str, str], object]]
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = field(default=lambda: random.uniform(0, JITTER))

    def replies(self, asked: DataFrame) -> DataFrame:
        out = D.StructType([*asked.schema, D.StructField("reply", D.StringType()), D.StructField("reason", D.StringType())])
        make, sleep, jitter = self.make, self.sleep, self.jitter

        def run(batches):
            model = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                model = model or make()
                told = [invoke(lambda r=r, p=p: model(r, p or ""), sleep, jitter) for r, p in zip(batch.column("role").to_pylist(), batch.column("prompt").to_pylist(), strict=True)]
                text, why = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(why, pa.string())], names=out.names)

        return asked.mapInArrow(run, out)


