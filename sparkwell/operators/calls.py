"""Calls of a model that answers in a given form, and the steps that are made of them: summaries, events, reranking, answers, decisions.

A call is a row's request in and a parsed reply or an error out. Any object with ``complete`` will do for the model; one is made
per task, and none where there are no rows. Failed or invalid replies stay as rows with an error, so a caller can raise or go on.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from . import validation
from .ledger import Ledger
from .models import EVENT_KEYS, identified
from .prompts import answer_requests, article_request, recommendation_requests, rerank_requests
from .retrieval import candidate_error, rerank_error
from .tables import work_dir

RERANK_REPLY = "ranked_candidates array<struct<candidate_id: string, reason: string>>"
_POINTS = "array<struct<text: string, citations: array<bigint>>>"
_SOURCES = "array<struct<id: bigint, title: string, url: string, snippet: string>>"
ANSWER_REPLY = f"answer string, sources {_SOURCES}, confidence string, insufficient_evidence boolean, supporting_points {_POINTS}, counter_points {_POINTS}"
DECISION_REPLY = f"decision string, confidence string, time_horizon string, reasoning string, key_risks array<string>, insufficient_evidence boolean, sources {_SOURCES}"
SUMMARY_REPLY = "bullets array<string>"
EVENTS_REPLY = f"events array<struct<{', '.join(f'{k}: string' for k in EVENT_KEYS)}>>"
SUMMARY_RULES = "Give 3 to 5 bullets with facts that the article states, for later search. Add no opinion and no advice, and don't repeat the title."
EVENT_RULES = "List the signals for investors that the article states, or none. Use the given names for type, direction, importance and horizon; General Market is the asset of what concerns no single one. Quote the evidence."
RERANK_RULES = "Order the candidates by how well they answer the question. Return every candidate id exactly once, each with a short reason. Add no others and answer nothing else."
ANSWER_RULES = "Answer from the sources alone and cite their ids. Put claims for and against into supporting_points and counter_points, each with a citation. Where the sources don't suffice, say so, set insufficient_evidence and use low confidence."
DECISION_RULES = "Decide BUY, HOLD or SELL for the target from the aggregated signal and the sources alone, as a patient long-term owner would. Prefer HOLD where evidence is thin, name at most three key risks, and list the sources used."


class MissingKeyError(RuntimeError):
    """No key for the model's service."""


class Client(Protocol):
    def complete(self, rules: str, request: str, form: str) -> str:
        """A JSON object of the form (a Spark schema). Raises if the model refuses or says nothing."""
        ...


def resolve_model(explicit: str | None, own_variable: str | None, default: str, env: Mapping[str, str] | None = None) -> str:
    """The given name, else that of the step's own variable, else of the common one, else the default."""
    env = os.environ if env is None else env
    return explicit or (env.get(own_variable, "") if own_variable else "") or env.get("OPENAI_MODEL", "") or default


class HttpService:
    """A service that takes JSON with a bearer's key."""

    def __init__(self, model: str, key: str | None = None, url: str = "https://api.openai.com/v1", timeout: float = 60) -> None:
        self.key = key or os.environ.get("OPENAI_API_KEY", "")
        if not self.key:
            raise MissingKeyError("OPENAI_API_KEY is required")
        self.model, self.url, self.timeout = model, url, timeout

    def post(self, path: str, body: dict) -> dict:
        asked = urllib.request.Request(f"{self.url}/{path}", json.dumps({"model": self.model} | body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
            return json.load(reply)


class HttpClient(HttpService):
    """A chat-completions service."""

    def complete(self, rules: str, request: str, form: str) -> str:
        messages = [{"role": "system", "content": f"{rules}\nReply with one JSON object: {form}"}, {"role": "user", "content": request}]
        message = self.post("chat/completions", {"messages": messages, "response_format": {"type": "json_object"}})["choices"][0]["message"]
        if message.get("refusal"):
            raise RuntimeError(f"Model refused the request: {message['refusal']}")
        if not message.get("content"):
            raise RuntimeError("Model returned no parsed reply")
        return message["content"]


class HttpEmbedder(HttpService):
    """A service of embeddings; for :func:`models.embed`, which hands over a batch of texts at a time."""

    #: Texts of a request.
    BATCH = 256

    def embed_all(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.BATCH):
            found = self.post("embeddings", {"input": [t or " " for t in texts[at : at + self.BATCH]]})["data"]
            out += [v["embedding"] for v in sorted(found, key=lambda v: v["index"])]
        return out


Make = Callable[[], Client]


def call(requests: DataFrame, rules: str, form: str, make: Make, refused: Column | None = None, ledger: Ledger | None = None) -> DataFrame:
    """``requests`` with reply (a struct of ``form``, null on failure) and error. Where ``refused`` gives a reason, the model isn't asked.

    With a ``ledger`` the model is asked here and now, once for equal requests, and what it holds already isn't asked again. Without one,
    tasks that are repeated call again, so results should be written before they are used twice.
    """
    if ledger is not None:
        return _parsed(_from_ledger(requests, rules, form, make, refused, ledger), form)
    requests = requests.withColumn("error", F.lit(None).cast("string") if refused is None else refused)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client: Client | None = None
        for b in batches:
            raw: list[str | None] = []
            errors: list[str | None] = []
            for request, why in zip(b.column("request").to_pylist(), b.column("error").to_pylist(), strict=True):
                if why is not None:
                    raw.append(None)
                    errors.append(why)
                    continue
                client = client or make()
                try:
                    raw.append(client.complete(rules, request, form))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a model is a row's error
                    raw.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.string()), pa.array(errors, pa.string())], [*b.schema.names[:-1], "_raw", "error"])

    text = T.StringType()
    called = requests.mapInArrow(run, T.StructType([*requests.schema.fields[:-1], T.StructField("_raw", text), T.StructField("error", text)]))
    return _parsed(called, form)


def _parsed(called: DataFrame, form: str) -> DataFrame:
    parsed = F.coalesce(F.get_json_object("_raw", "$").isNotNull(), F.lit(False))
    error = F.coalesce("error", F.when(~parsed, F.lit("Model returned no parsed reply")))
    return called.withColumn("reply", F.when(parsed, F.from_json("_raw", form))).withColumn("error", error).drop("_raw")


def _from_ledger(requests: DataFrame, rules: str, form: str, make: Make, refused: Column | None, ledger: Ledger) -> DataFrame:
    own = requests.withColumn("_refused", F.lit(None).cast("string") if refused is None else refused).withColumn("_key", ledger.key(rules, form, F.col("request")))
    at = f"{work_dir(requests.sparkSession)}-requests"
    own.write.parquet(at)
    own = requests.sparkSession.read.parquet(at)

    def answering() -> Callable[[str], str]:
        client = make()
        return lambda request: client.complete(rules, request, form)

    replies = ledger.ask(own.filter("_refused is null").select(F.col("_key").alias("key"), "request"), answering)
    joined = own.join(replies.withColumnsRenamed({"key": "_key", "raw": "_raw"}), "_key", "left")
    return joined.withColumn("_raw", F.when(F.col("_refused").isNull(), F.col("_raw"))).withColumn("error", F.coalesce("_refused", "error")).drop("_refused", "_key")


def summarise(articles: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """article_id, bullets and error of each article (article_id, url, title, description, content)."""
    got = call(articles.select("article_id", article_request().alias("request")), SUMMARY_RULES, SUMMARY_REPLY, make, ledger=ledger)
    return got.select("article_id", F.col("reply.bullets").alias("bullets"), "error")


def structured(articles: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """Events of each article, as :func:`models.structured` gives them; an article whose call failed has one row with its error."""
    got = call(articles.select("article_id", article_request().alias("request")), EVENT_RULES, EVENTS_REPLY, make, ledger=ledger)
    got = got.withColumn("error", F.coalesce("error", F.when(F.col("reply.events").isNull(), "no events in the reply")))
    events = F.when(F.col("error").isNull(), F.col("reply.events")).otherwise(F.array(F.lit(None).cast(got.schema["reply"].dataType["events"].dataType.elementType)))
    rows = got.select("article_id", "error", F.posexplode(events).alias("place", "e"))
    return identified(rows.select("article_id", F.col("place").cast("long").alias("place"), *[F.col(f"e.{k}").alias(k) for k in EVENT_KEYS], "error"))


def rerank(candidates: DataFrame, questions: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """question_id, ranked (candidate ids in their new order), ranked_candidates (with reasons) and error: the order must be a permutation. Blank questions and incomplete candidates are not sent."""
    own = rerank_requests(candidates, questions)
    invalid = F.get(F.array_compact(F.transform("candidates", candidate_error)), F.lit(0))
    got = call(own, RERANK_RULES, RERANK_REPLY, make, F.coalesce(validation.question_error(F.col("question")), invalid), ledger)
    items = F.transform("reply.ranked_candidates", lambda c: F.struct(clean(c["candidate_id"]).alias("candidate_id"), clean(c["reason"]).alias("reason")))
    own = got.withColumn("ranked_candidates", items).withColumn("ranked", F.transform("ranked_candidates", lambda c: c["candidate_id"]))
    blank = F.when(F.col("ranked").isNull(), "no ranked candidates").when(F.exists("ranked_candidates", lambda c: (c["candidate_id"] == "") | (c["reason"] == "")), "empty candidate_id or reason")
    expected = F.transform("candidates", lambda c: c["candidate_id"])
    return own.select("question_id", "ranked", "ranked_candidates", F.coalesce("error", blank, rerank_error(expected, F.col("ranked"))).alias("error"))


def answer(evidence: DataFrame, questions: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """question_id, the columns of an answer and error; citations must be among the answer's own sources."""
    got = call(answer_requests(evidence, questions), ANSWER_RULES, ANSWER_REPLY, make, validation.question_error(F.col("question")), ledger).select("question_id", "reply.*", "error")
    points = F.concat(F.coalesce("supporting_points", F.array().cast(_POINTS)), F.coalesce("counter_points", F.array().cast(_POINTS)))
    return got.withColumn("error", F.coalesce("error", validation.answer_error(points), validation.citation_error(points, F.col("sources"))))


def decide(aggregated: DataFrame, evidence: DataFrame, make: Make, ledger: Ledger | None = None) -> DataFrame:
    """``aggregated`` with the columns of a decision and error; risks are cleaned, what the model says of the aggregation isn't asked for."""
    columns = [c for c in aggregated.columns if c not in ("decision", "confidence", "time_horizon", "reasoning", "key_risks", "insufficient_evidence", "sources")]
    own = recommendation_requests(aggregated.select(columns), evidence)
    got = call(own, DECISION_RULES, DECISION_REPLY, make, validation.aggregation_error(), ledger).select(*columns, "reply.*", "error")
    return got.withColumn("error", F.coalesce("error", validation.recommendation_error())).withColumn("key_risks", validation.clean_risks(F.col("key_risks")))
