"""Operators that ask a language model.  ``ask`` maps a prompt to the text of an answer, and runs on the executors."""

from __future__ import annotations

import json
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliolake.functions import prompts
from foliolake.operators import chapters


class AskError(Exception):
    """A model gave no answer."""


@dataclass
class Client:
    """A model behind a local generation service; tries again after 1, 2, 4 ... seconds."""

    base_url: str = "http://localhost:11434"
    model: str = "llama3.1:8b"
    timeout: int = 120
    max_retries: int = 3

    def __call__(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "format": "json"}).encode()
        for tried in range(self.max_retries):
            try:
                request = urllib.request.Request(f"{self.base_url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())["response"]
            except (urllib.error.URLError, KeyError, TimeoutError, ValueError) as failed:
                if tried == self.max_retries - 1:
                    raise AskError(f"no answer after {self.max_retries} tries: {failed}") from failed
                time.sleep(2**tried)
        raise AskError("no tries are allowed")


def answered(rows: DataFrame, prompt: Column, ask: Callable[[str], str]) -> DataFrame:
    """``rows`` with ``answer``; null where asking fails."""
    names = [*rows.columns, "answer"]

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(b.num_columns - 1):
                try:
                    out.append(ask(p.as_py()))
                except Exception:  # whatever the service does, the page goes on without an answer
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names)

    with_prompt = rows.withColumn("answer", prompt)
    return with_prompt.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


def page_numbers(pages: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``doc, page, text, number``: pages without a number get the one that the model reads, if it is a positive whole one."""
    pages = pages.select("doc", "page", "text", "number")
    asked = answered(pages.filter("number IS NULL"), prompts.page_number(F.coalesce("text", F.lit(""))), ask)
    return pages.filter("number IS NOT NULL").unionByName(asked.select("doc", "page", "text", prompts.number_answered(F.col("answer")).alias("number")))


def chapter_starts(blocks: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``doc, ord`` of the headings that the model says open chapters; indices beyond the headings are left out."""
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1
    headings = blocks.filter("kind = 'heading'").select("doc", "ord", "level", "text").withColumn("nth", nth)
    listed = headings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("nth").alias("index"), "text", "level"))).alias("headings"))
    told = answered(listed, prompts.chapter_starts(F.col("headings")), ask).select("doc", F.explode(prompts.starts_answered(F.col("answer"))).alias("nth"))
    return headings.join(told.distinct(), ["doc", "nth"]).select("doc", "ord")


def detect(blocks: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Chapters that open where the model says; documents without an answer go by their level-1 headings."""
    return chapters.detect(blocks, chapter_starts(blocks, ask))


def sync(remote: str, folder: str, flags: list[str] = ["--progress", "--transfers=4"], command: str = "rclone") -> None:  # noqa: B006
    """Copies a remote folder to a local one with an outside command."""
    done = subprocess.run([command, "sync", remote, folder, *flags], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command} failed with {done.returncode}: {done.stderr}")
