"""Answer generators behind one interface: extractive (columns), remote (batches), and a fallback."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import answering
from skein.storage import Scratch


class LLMGenerationError(RuntimeError):
    """A chat backend that failed; the only error that falls back."""


class AnswerGenerator(Protocol):
    def raw(self, questions: DataFrame, context: DataFrame) -> DataFrame:
        """(qid, raw) for every question with context; raw is text with the three sections."""


@dataclass(frozen=True)
class Extractive:
    """The best sentences of the context."""

    def raw(self, questions: DataFrame, context: DataFrame) -> DataFrame:
        top = answering.top_sentences(answering.sentence_scores(context, questions))
        a = answering.extractive_answers(top, questions.join(context.select("qid").distinct(), "qid", "left_semi"))
        text = answering.formatted(F.col("answer"), F.col("sources"), F.col("evidence"))
        return a.select("qid", F.when(F.col("answer") == answering.INSUFFICIENT, answering.INSUFFICIENT).otherwise(text).alias("raw"))


@dataclass(frozen=True)
class Remote:
    """A function from prompts to texts, called on the executors for ``batch_size`` prompts at a time."""

    call: Callable[[Sequence[str]], Sequence[str]]
    batch_size: int = 1

    def raw(self, questions: DataFrame, context: DataFrame) -> DataFrame:
        return self._called(questions, context, False).drop("error")

    def tried(self, questions: DataFrame, context: DataFrame) -> DataFrame:
        """``raw`` with a column ``error``: where a call failed its questions have the reason and no text, and the others go on."""
        return self._called(questions, context, True)

    def _called(self, questions: DataFrame, context: DataFrame, catch: bool) -> DataFrame:
        import pyarrow as pa

        call, size = self.call, self.batch_size
        asked = answering.prompts(context, questions.join(context.select("qid").distinct(), "qid", "left_semi"))

        def made(prompts: list[str]) -> list[str]:
            out = list(call(prompts))
            if len(out) != len(prompts):
                raise LLMGenerationError(f"LLMGenerationError: expected {len(prompts)} texts")
            return out

        def run(batches):
            for b in batches:
                prompts, texts, errors = b.column("prompt").to_pylist(), [], []
                for lo in range(0, len(prompts), size):
                    part = prompts[lo : lo + size]
                    try:
                        texts += made(part)
                        errors += [None] * len(part)
                    except LLMGenerationError as e:
                        if not catch:
                            raise
                        texts += [None] * len(part)
                        errors += [str(e)] * len(part)
                yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["qid", "raw", "error"])

        return asked.mapInArrow(run, f"qid {questions.schema['qid'].dataType.simpleString()}, raw string, error string")


@dataclass(frozen=True)
class Fallback:
    """The first generator, and the second for those questions whose call failed. What the first gave is written before that, so no call is made twice."""

    first: Remote
    second: AnswerGenerator

    def raw(self, questions: DataFrame, context: DataFrame) -> DataFrame:
        done = Scratch(questions.sparkSession).save(self.first.tried(questions, context), "tried")
        failed = done.where("error IS NOT NULL").select("qid")
        rest = self.second.raw(questions.join(failed, "qid", "left_semi"), context.join(failed, "qid", "left_semi"))
        return done.where("error IS NULL").select("qid", "raw").unionByName(rest.select("qid", "raw"))


def message_text(payload: dict) -> str:
    """The text of a chat endpoint's answer: a string, or parts of text that are joined."""
    choices = payload.get("choices")
    choice = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    content = (choice.get("message") or {}).get("content") if isinstance(choice.get("message"), dict) else None
    if isinstance(content, list):
        content = "".join(p.get("text", "") for p in content if isinstance(p, dict) and p.get("type") == "text")
    text = content if isinstance(content, str) and content.strip() else choice.get("text")
    if not isinstance(text, str) or not text.strip():
        raise LLMGenerationError("LLMGenerationError: the answer has no text")
    return text.strip()


def chat(url: str, key: str, model: str, timeout: float = 60.0, temperature: float = 0.2) -> Callable[[Sequence[str]], list[str]]:
    """A client of a chat endpoint."""

    def call(prompts: Sequence[str]) -> list[str]:
        import json
        import urllib.error
        import urllib.request

        out = []
        for prompt in prompts:
            body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
            request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            try:
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    out.append(message_text(json.load(r)))
            except (urllib.error.URLError, ValueError) as e:
                raise LLMGenerationError(f"LLMGenerationError: {e}") from e
        return out

    return call


def generator_from_environment(env: dict[str, str] | None = None) -> AnswerGenerator:
    """Extractive, unless a chat endpoint is configured; that falls back to extractive."""
    env = os.environ if env is None else env
    url, key, model = (env.get(f"OPENAI_{n}", "") for n in ("BASE_URL", "API_KEY", "MODEL"))
    return Fallback(Remote(chat(url, key, model)), Extractive()) if url and key and model else Extractive()


def respond(questions: DataFrame, retrieved: DataFrame, generator: AnswerGenerator | None = None) -> DataFrame:
    """(qid, answer, sources, evidence) of all questions: context, generation, and the checks of what came out."""
    context = answering.select_context(retrieved)
    checked = answering.grounded((generator or Extractive()).raw(questions, context), context)
    none = F.expr(answering.NO_STRINGS)
    rows = questions.select("qid").join(checked, "qid", "left")
    return rows.select("qid", F.coalesce("answer", F.lit(answering.INSUFFICIENT)).alias("answer"), F.coalesce("sources", none).alias("sources"), F.coalesce("evidence", none).alias("evidence"))
