"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and its token spans are intersected with the
sorted spans of the trained turns by binary search. So tokens are those of the rendered text, whatever they join across a border, and a
token is trained where it shares a character with a trained turn.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ready

DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
TRAINED = ("assistant",)
HEAD, TAIL = "<|im_start|>{role}\n", "<|im_end|>\n"


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def render(turns: list[tuple[str | None, str | None]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the sorted character spans of its trained turns, each with its end marker."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head = HEAD.format(role=role if role is not None else "unknown")
        body = (text or "") + TAIL
        if role in trained:
            spans.append((n + len(head), n + len(head) + len(body) - 1))
        out += [head, body]
        n += len(head) + len(body)
    return "".join(out), spans


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """1 for tokens that share a character with a span. Both are sorted; the first span that ends after the token's begin is the only candidate."""
    if not spans or not offsets:
        return [0] * len(offsets)
    o, s = np.array(offsets), np.array(spans)
    k = np.searchsorted(s[:, 1], o[:, 0], side="right")
    ok = k < len(s)
    return (ok & (s[np.minimum(k, len(s) - 1), 0] < o[:, 1])).astype(np.int8).tolist()


def format_chats(turns: DataFrame, path: str = DEFAULT, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv_id, n_turns, text, token_ids, loss_mask, n_trained): a row per conversation.

    Turns are ordered by turn, then role and text, nulls first; repeated turns are all rendered. A null text is an empty turn, a null role is ``unknown``
    and not trained. Rows with a null conv_id are left out. Strings that look like special tokens are ordinary text. Other columns are ignored.
    """
    ready(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            convs = [[(x["role"], x["text"]) for x in c] for c in b.column(1).to_pylist()]
            rendered = [render(c, trained) for c in convs]
            ids, masks = [], []
            for lo in range(0, len(rendered), 32):
                for e, (_, spans) in zip(t.encode_batch([x for x, _ in rendered[lo : lo + 32]], add_special_tokens=False), rendered[lo : lo + 32]):
                    ids.append(e.ids)
                    masks.append(mask(e.offsets, spans))
            yield pa.record_batch([b.column(0), pa.array([len(c) for c in convs], pa.int32()), pa.array([x for x, _ in rendered]), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array([sum(m) for m in masks], pa.int32())], names=["conv_id", "n_turns", "text", "token_ids", "loss_mask", "n_trained"])

    return whole.mapInArrow(run, f"conv_id {kind}, n_turns int, text string, token_ids array<int>, loss_mask array<tinyint>, n_trained int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))
