"""Enrichment: summaries for symbols that lack one, from a provider or any function that is given; else from a template."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import prompt, template_summary, truncate_summary

BATCH = 4
#: Tokens that a provider may answer with, and seconds it may take to show that it is there.
MOST_TOKENS, PROBE_S = 150, 0.5


class ProviderError(RuntimeError):
    """A provider answered with an error, or with nothing."""


@dataclass(frozen=True)
class Provider:
    """A service that completes a prompt over HTTP; can be sent to executors."""

    name: str
    base: str
    model: str
    key: str = ""
    timeout_s: float = 60.0

    def request(self, text: str) -> tuple[str, dict[str, str], dict]:
        """(URL, headers, body) by the provider's own format."""
        said = [{"role": "user", "content": text}]
        if self.name == "anthropic":
            return f"{self.base}/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": MOST_TOKENS, "messages": said}
        if self.name == "google":
            return f"{self.base}/v1beta/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, {"contents": [{"parts": [{"text": text}]}]}
        return f"{self.base}/v1/chat/completions", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "max_tokens": MOST_TOKENS, "messages": said}

    def answer(self, body: dict) -> str:
        if body.get("error"):
            raise ProviderError(str(body["error"].get("message", body["error"])))
        try:
            if self.name == "anthropic":
                return body["content"][0]["text"]
            if self.name == "google":
                return body["candidates"][0]["content"]["parts"][0]["text"]
            return body["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("empty answer") from e

    def __call__(self, text: str) -> str:
        url, headers, body = self.request(text)
        asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout_s) as response:
                return self.answer(json.load(response))
        except urllib.error.HTTPError as e:  # the body may say why
            try:
                said = json.load(e)
            except ValueError:
                said = {}
            raise ProviderError(str((said.get("error") or {}).get("message", e)) if isinstance(said.get("error"), dict) else str(e)) from e
        except ValueError as e:
            raise ProviderError(f"not JSON: {e}") from e


def answers(base: str) -> bool:
    """Whether a local service is there."""
    try:
        with urllib.request.urlopen(f"{base}/api/tags", timeout=PROBE_S) as response:
            return response.status == 200
    except (OSError, ValueError):
        return False


def detect(environ: dict[str, str] | None = None) -> str:
    """The name of the provider that would be used."""
    found = provider(environ)
    return found.name if found else "template"


def provider(environ: dict[str, str] | None = None, timeout_s: float = 60.0, local: str = "http://localhost:11434") -> Provider | None:
    """The first provider that is set up, else one that answers on this machine, else none: templates."""
    e = dict(os.environ) if environ is None else environ
    if e.get("ANTHROPIC_API_KEY"):
        return Provider("anthropic", e.get("ANTHROPIC_BASE_URL", "https://api.anthropic.com"), e.get("ANTHROPIC_MODEL", "claude-3-5-haiku-latest"), e["ANTHROPIC_API_KEY"], timeout_s)
    if e.get("GOOGLE_API_KEY"):
        return Provider("google", e.get("GOOGLE_BASE_URL", "https://generativelanguage.googleapis.com"), e.get("GOOGLE_MODEL", "gemini-2.0-flash"), e["GOOGLE_API_KEY"], timeout_s)
    if e.get("OPENAI_API_BASE"):
        return Provider("openai", e["OPENAI_API_BASE"].rstrip("/"), e.get("OPENAI_MODEL", "gpt-4o-mini"), e.get("OPENAI_API_KEY", ""), timeout_s)
    local = e.get("OLLAMA_HOST") or local
    local = local if "://" in local else f"http://{local}"
    return Provider("ollama", local.rstrip("/"), e.get("OLLAMA_MODEL", "llama3.2"), "ollama", timeout_s) if answers(local.rstrip("/")) else None


def template(symbols: DataFrame) -> DataFrame:
    """Summaries from the template where there is none."""
    none = F.coalesce("summary", F.lit("")) == ""
    return symbols.withColumn("summary", F.when(none, template_summary(F.col("kind"), F.col("name"), F.lit(""), F.lit(""))).otherwise(F.col("summary")))


def enrich(symbols: DataFrame, describe: Callable[[str], str], source: str = "source", batch: int = BATCH) -> DataFrame:
    """Summaries from ``describe`` (prompt to sentence) where there is none, ``batch`` calls at a time in each task; a call
    that fails leaves the template's."""
    names = symbols.columns
    asked = symbols.withColumn("prompt_", F.when(F.coalesce("summary", F.lit("")) == "", prompt(F.col("kind"), F.col("name"), F.col("signature"), F.col(source))))

    def one(said: str | None) -> str | None:
        try:
            return describe(said) if said is not None else None
        except Exception:  # noqa: BLE001  whatever a provider raises
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(batch) as pool:
            for rows in batches:
                said = list(pool.map(one, rows.column("prompt_").to_pylist()))
                kept = rows.column("summary").to_pylist()
                found = pa.array([k if k else s for k, s in zip(kept, said, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([found if n == "summary" else rows.column(n) for n in names], names=names)

    return template(asked.mapInArrow(run, symbols.schema).withColumn("summary", truncate_summary(F.col("summary"))))
