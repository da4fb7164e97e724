"""Chat formatting with offset-aligned loss masks: whole conversations are rendered and encoded once, with offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The template's control strings; the tokenizer gets them as special tokens, so no token spans the edge of a text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


@dataclass(frozen=True)
class Params:
    """tokenizer: the file of a lossless byte-level tokenizer. learn: the role whose texts are under the loss mask."""

    tokenizer: str
    learn: str = "assistant"


def escape(text: str) -> str:
    """Reversibly leaves no control string in a text: every backslash is doubled, and one goes between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(x.replace("<\\|", "<|") for x in parts)


def render(turns: list[tuple[str, str]], learn: str) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, ascending spans of the escaped texts of the learned role, as code points)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest[: -len(END)])))
    return turns


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token that lies in a span. Tokens and spans ascend; two binary searches for each span."""
    out = np.zeros(len(starts), np.int8)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, "right").tolist(), np.searchsorted(starts, b, "left").tolist()):
            out[lo:hi] = 1
    return out


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


FORMATTED = "conv_id long, n_turns long, formatted string, input_ids array<int>, loss_mask array<tinyint>"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("input_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])
#: Characters of conversations encoded together.
GROUP = 1_000_000


def _format(p: Params):
    def encode(done: list[tuple[int, list[tuple[str, str]]]]) -> pa.RecordBatch:
        t = tokenizer(p.tokenizer)
        rendered = [render(turns, p.learn) for _, turns in done]
        ids, masks = [], []
        for e, (_, spans) in zip(t.encode_batch([x for x, _ in rendered], add_special_tokens=False), rendered):
            at = np.array(e.offsets, np.int64).reshape(-1, 2)
            ids.append(np.array(e.ids, np.int32))
            masks.append(mask(at[:, 0], at[:, 1], spans))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([len(x) for _, x in done], pa.int64()), pa.array([x for x, _ in rendered], pa.string()), pa.array(ids, _SCHEMA.field(3).type), pa.array(masks, _SCHEMA.field(4).type)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by conversation and turn; one conversation is open at a time."""
        now, turns, done, size = None, [], [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    if turns:
                        done.append((now, turns))
                    if size > GROUP:
                        yield encode(done)
                        done, size = [], 0
                    now, turns = conv, []
                turns.append((role, text))
                size += len(text)
        if turns:
            done.append((now, turns))
        if done:
            yield encode(done)

    return run


def format_conversations(rows: DataFrame, p: Params, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, input_ids, loss_mask: one row per conversation.

    Turns go by number (null first), ties by role and text; repeated rows are turns of their own. Null roles and texts
    are empty. Rows with a null conversation id belong to none and are left out. No rows: no rows. Extra columns are ignored.
    Rows are dealt by conversation and sorted (spilling as needed), then streamed: a task holds one conversation and
    about a million characters of finished ones, whatever a key's share of the rows."""
    spark = rows.sparkSession
    common.bound_batches(spark)
    base = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return base.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(p), FORMATTED)


def read_back(formatted: DataFrame, p: Params) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the operator's output alone.

    Turns come from parsing the formatted text, the text under the loss mask from decoding the masked ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        t = tokenizer(p.tokenizer)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for i in range(len(batch)):
                text = batch.column("formatted")[i].as_py()
                turns = parse(text)
                ids = batch.column("input_ids")[i].values.to_numpy(zero_copy_only=False)
                on = batch.column("loss_mask")[i].values.to_numpy(zero_copy_only=False)
                loss = unescape(t.decode(ids[on == 1].tolist(), skip_special_tokens=False))
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                for k, v in zip(out, (batch.column("conv_id")[i].as_py(), len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
