"""Token counts: texts are encoded in batches inside Arrow functions that return lengths only.

A text is cut where the tokenizer cannot see across.  For a piece model that writes a space as U+2581, has no piece with
that sign after another character and sets one before every text, that is each single space between two other
characters: the space goes, and the sign set before the next part stands for it.  :func:`safe_to_cut` reads the model
to make sure; any other model gets whole texts.  Parts are encoded in calls balanced by bytes, and the lengths of parts
met before are kept in a table of bounded size, so a long text costs neither a long encoder call nor memory.

Cases: null texts count as empty; empty texts have no tokens; texts that begin or end with a space or hold runs of
spaces or U+2581 are cut only where the rule above holds; repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Parts whose lengths a worker keeps (and their greatest length in characters), and bytes of one encoder call.
KEPT, KEPT_CHARS, CALL_BYTES = 300_000, 40, 1 << 18
#: A space between two characters that are neither spaces nor marks.
CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def safe_to_cut(model) -> bool:
    """Whether single spaces are safe boundaries for this model."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) or " " in p for p in pieces) and model.encode("a b", out_type=str)[0][:1] == MARK and model.encode("  a") != model.encode(" a") and len(model.encode("a ")) == len(model.encode("a")) + 1


class Counter:
    """Counts tokens of texts with one model."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            self.lengths, self.cut = lambda parts: [len(e.ids) for e in t.encode_batch(parts, add_special_tokens=False)], False
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths, self.cut = lambda parts: [len(x) for x in model.encode(parts, num_threads=1)], safe_to_cut(model)
        self.known: dict[str, int] = {}

    def encode(self, parts: list[str]) -> list[int]:
        """Lengths of the parts, in calls of about CALL_BYTES."""
        out, call, size = [], [], 0
        for p in parts:
            call.append(p)
            size += len(p) if p.isascii() else len(p.encode())
            if size >= CALL_BYTES:
                out += self.lengths(call)
                call, size = [], 0
        return out + (self.lengths(call) if call else [])

    def count(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self.encode(texts)
        if len(self.known) > KEPT:
            self.known.clear()
        parted = [t.split(" ") if "  " not in t and MARK not in t and t[:1] != " " and t[-1:] != " " else CUT.split(t) for t in texts]
        fresh = list({p for parts in parted for p in parts if p not in self.known})
        now = dict(zip(fresh, self.encode(fresh)))
        get = (self.known | now).__getitem__ if len(now) > len(self.known) else lambda p, a=self.known, b=now: a[p] if p in a else b[p]
        out = [sum(map(get, parts)) for parts in parted]
        self.known.update((p, n) for p, n in now.items() if len(p) <= KEPT_CHARS)
        return out


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, slice_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.  ``slice_bytes``: text held as Python strings at once."""

    def run(batches):
        counter = Counter(public_tokenizers.path(model))
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            text = text.fill_null("")
            size = pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype("int64")
            done, counts = 0, []
            while done < len(text):
                end, held = done, 0
                while end < len(text) and (end == done or held + size[end] <= slice_bytes):
                    held += size[end]
                    end += 1
                counts += counter.count(text.slice(done, end - done).to_pylist())
                done = end
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
