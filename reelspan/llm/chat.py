"""Chat formatting: conversations rendered by a compiled template, with the spans that carry loss.

Turns of a conversation are ordered by turn, then role and text. Null roles and
texts count as empty; rows with a null conversation id form one conversation.
Repeated rows are repeated turns. The default template escapes roles and texts
reversibly (see ``template.escape``), and line feeds of roles too, so that no
text can imitate a control string and no role another role's text; ``parse_chat`` reads turns back from formatted text alone.

Rows are dealt by conversation and sorted inside a partition; a task streams
through them and holds one conversation at a time, which it must, as it writes
each as one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.template import Template, unescape

START, END = "<|im_start|>", "<|im_end|>"
DEFAULT = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | escape | one_line }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)
#: Rows of output in a batch, and their characters.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20


def format_conversations(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, formatted and loss_spans (code points) for each conversation of (conv_id, turn, role, text)."""
    compiled = Template(template)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, spans, size = [], [], [], 0
        messages: list[dict] = []
        current: object = run  # no conversation yet

        def flush():
            text, found = compiled.render(messages=messages)
            ids.append(current)
            texts.append(text)
            spans.append([{"start": a, "end": b} for a, b in found])
            return len(text)

        def batch_of():
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(texts, pa.string()), pa.array(spans, span)], names=["conv_id", "formatted", "loss_spans"])
            ids.clear(), texts.clear(), spans.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != current or current is run:
                    if current is not run:
                        size += flush()
                        if len(ids) >= BATCH_ROWS or size >= BATCH_CHARS:
                            yield batch_of()
                            size = 0
                    current, messages = conv, []
                messages.append({"role": role, "text": text})
        if current is not run:
            flush()
        if ids:
            yield batch_of()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of text that the default template has written."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn doesn't begin with its marker")
        end = formatted.index(END, at + len(START))
        role, _, text = formatted[at + len(START) : end].partition("\n")
        out.append((unescape(role), unescape(text)))
        at = end + len(END) + 1
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, from formatted text and spans alone."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse_chat(text)
                turn_hash, loss_hash, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    turn_hash.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    part = unescape(text[s["start"] : s["end"]])
                    chars += len(part)
                    loss_hash.update(part.encode())
                out.append((len(turns), turn_hash.hexdigest(), chars, loss_hash.hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
