"""Summaries from an outside model, behind a plain function so that any client can be plugged in."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.functions import text as X
from docsect.operators import sections as S

CONCURRENCY = 8
PATIENCE = 3
LANES = 4  # tasks that share a limit of calls
#: The clients' settings (fixed values): what an answer may be long, addresses and models that hold where the environment names none.
MAX_TOKENS = 100
OLLAMA_URL, OLLAMA_MODEL = "http://localhost:11434/api/generate", "qwen3:4b"
ANTHROPIC_URL, ANTHROPIC_VERSION, ANTHROPIC_MODEL = "https://api.anthropic.com/v1/messages", "2023-06-01", "claude-haiku-4-5-20251001"


class Pace:
    """At most so many calls a second from all threads that share it: each call takes the next free moment."""

    def __init__(self, calls_a_second: float, now=time.monotonic, sleep=time.sleep):
        self.every, self.now, self.sleep, self.free, self.lock = 1 / calls_a_second, now, sleep, 0.0, threading.Lock()

    def __call__(self, ask: Callable[[str], str]) -> Callable[[str], str]:
        def run(prompt: str) -> str:
            with self.lock:
                at = max(self.free, self.now())
                self.free = at + self.every
            self.sleep(max(0.0, at - self.now()))
            return ask(prompt)

        return run


def chain(*clients: Callable[[str], str]) -> Callable[[str], str]:
    """The first answer that is not empty; a client that fails counts as silent."""

    def ask(prompt: str) -> str:
        for c in clients:
            try:
                if answer := (c(prompt) or "").strip():
                    return answer
            except Exception:
                continue
        return ""

    return ask


def post(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=30) as r:
        return json.loads(r.read())


def patient(ask: Callable[[str], str]) -> Callable[[str], str]:
    """The client, until it has failed PATIENCE times on end: a server that is not there is not asked for every section."""
    failed = [0]

    def run(prompt: str) -> str:
        if failed[0] >= PATIENCE:
            return ""
        try:
            answer = ask(prompt)
        except Exception:
            failed[0] += 1
            raise
        failed[0] = 0
        return answer

    return run


def ollama(url: str, model: str, send=post) -> Callable[[str], str]:
    body = {"model": model, "stream": False, "options": {"num_predict": MAX_TOKENS}}
    return lambda prompt: send(url, {}, body | {"prompt": prompt}).get("response", "")


def anthropic(key: str, model: str, send=post) -> Callable[[str], str]:
    headers, body = {"x-api-key": key, "anthropic-version": ANTHROPIC_VERSION}, {"model": model, "max_tokens": MAX_TOKENS}
    return lambda prompt: send(ANTHROPIC_URL, headers, body | {"messages": [{"role": "user", "content": prompt}]})["content"][0]["text"]


def default_client(env=os.environ, send=post) -> Callable[[str], str] | None:
    """The clients that the environment asks for, in order; None where it asks for none."""
    clients = []
    if env.get("USE_OLLAMA", "true").lower() == "true":
        clients.append(ollama(env.get("OLLAMA_URL", OLLAMA_URL), env.get("OLLAMA_MODEL", OLLAMA_MODEL), send))
    if env.get("ANTHROPIC_API_KEY"):
        clients.append(anthropic(env["ANTHROPIC_API_KEY"], env.get("ANTHROPIC_MODEL", ANTHROPIC_MODEL), send))
    return chain(*map(patient, clients)) if clients else None


def model_name(env=os.environ) -> str:
    """What answers come from, for telling whether answers of before are of the same source."""
    names = [f"ollama:{env.get('OLLAMA_MODEL', OLLAMA_MODEL)}"] * (env.get("USE_OLLAMA", "true").lower() == "true") + [f"anthropic:{env.get('ANTHROPIC_MODEL', ANTHROPIC_MODEL)}"] * bool(env.get("ANTHROPIC_API_KEY"))
    return " ".join(names)


def summarize(sections: DataFrame, ask: Callable[[str], str] | None = None, known: str | None = None, calls_a_second: float | None = None) -> DataFrame:
    """sections with summary filled: short sections at once, others by ask(prompt), or else by their text alone, as if ask fails.

    known: a column with an answer of before, null where there is none; those sections are not asked about.  Sections go
    through in one pass, without their text where there is someone to ask.  calls_a_second: of all tasks together; the
    sections then go through LANES tasks, each with its share.
    """
    title, content = F.col("title"), F.col("content")
    if ask is None:
        return sections.withColumn("summary", X.simple_summary(title, content))
    short = X.short_summary(content, F.col("line_count"))
    names = [*dict.fromkeys([*(c for c in sections.columns if c not in ("content", known)), "summary"])]
    done = F.coalesce(short, F.col(known)) if known else short
    rows = sections.withColumn("summary", F.coalesce(done, X.fallback_summary(title, content)))
    rows = rows.withColumn("_prompt", F.when(done.isNull(), X.prompt(title, content)))
    ask = chain(ask)

    def run(batches):
        paced = Pace(calls_a_second / LANES)(ask) if calls_a_second else ask
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for pdf in batches:
                asked = pdf["_prompt"].notna()
                answers = list(pool.map(paced, pdf.loc[asked, "_prompt"]))
                told = pdf["summary"].copy()
                told[asked] = [a or b for a, b in zip(answers, pdf.loc[asked, "summary"])]
                yield pdf.assign(summary=told)[names]

    rows = rows.select(*names, "_prompt")
    if calls_a_second:
        rows = rows.repartition(LANES, "file", "seq")
    return rows.mapInPandas(run, rows.drop("_prompt").schema)


class Parser:
    """Files to sections for an index.  With someone to ask, known() asks only about sections that were not told of before."""

    def __init__(self, ask: Callable[[str], str] | None = None, model: str = "", calls_a_second: float | None = None):
        self.ask, self.model, self.calls_a_second = ask, model if ask else "plain", calls_a_second

    def __call__(self, files: DataFrame) -> DataFrame:
        return summarize(S.parse_stored(files), self.ask, None, self.calls_a_second)

    def known(self, files: DataFrame, old: DataFrame, same_model: bool = True) -> DataFrame:
        """old: sections of before; those with the same title and text keep their answers, if they are the same model's.

        A section that nobody has answered for has its fallback as summary, and is asked about again.
        """
        new = S.parse_stored(files)
        told = old.groupBy("hash", "title").agg(F.max("summary").alias("_told"))
        both = new.join(told if same_model else told.limit(0), ["hash", "title"], "left")
        earlier = F.when(F.col("_told") != X.fallback_summary(F.col("title"), F.col("content")), F.col("_told"))
        return summarize(both.withColumn("_told", earlier), self.ask, "_told", self.calls_a_second)
