"""Chat formatting: conversations as token ids with a loss mask, assembled segment by segment.

A turn is  <|turn|> role <|text|> text <|end|>, where the three marks are reserved
ids that no text can produce: each segment is encoded on its own, without special
tokens, and the ids are spliced in between.  The same conversation rendered as a
string stays readable by machine, because control strings inside roles and texts are
escaped: a backslash is put after their first character, and one more where
backslashes already stand there, so unescaping gives every text back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-pair ranks (a tiktoken file) and the pattern that cuts texts before pairs are merged; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The template's own marks, and marks of other templates that are escaped as well.
TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_rest = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_rest})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_rest})")
ROLE_LEARNED = "assistant"


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1\2", s)


class Tokenizer:
    """A byte-level tokenizer without special tokens, and the reserved ids after its own."""

    def __init__(self, ranks_file: bytes) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        self._own = tiktoken.Encoding("factloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.marks = {m: first + i for i, m in enumerate(MARKS)}

    def encode(self, s: str) -> list[int]:
        return self._own.encode_ordinary(s)

    def decode(self, ids: list[int]) -> str:
        return self._own.decode_bytes(ids).decode("utf-8")


def assemble(tok: Tokenizer, role: str, text: str, learned: str = ROLE_LEARNED) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a turn, and its loss mask: the text's tokens where the role is the learned one."""
    body = tok.encode(escape(text))
    segments = [[tok.marks[TURN]], tok.encode(escape(role)), [tok.marks[TEXT]], body, [tok.marks[END]]]
    ends = np.cumsum([len(s) for s in segments])
    ids = np.concatenate([np.asarray(s, np.int32) for s in segments])
    steps = np.zeros(len(ids) + 1, np.int8)  # +1 where the loss begins, -1 behind its end; the mask is their prefix sum
    if role == learned:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return ids, np.cumsum(steps[:-1], dtype=np.int8)


def read_turn(tok: Tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, code points of the rendered turn), from the ids alone."""
    marks = {v: k for k, v in tok.marks.items()}
    places = [(i, marks[x]) for i, x in enumerate(ids.tolist()) if x in marks]
    if [m for _, m in places] != list(MARKS) or places[0][0] != 0 or places[2][0] != len(ids) - 1:
        raise ValueError("not a turn")
    t = places[1][0]
    role, text = tok.decode(ids[1:t].tolist()), tok.decode(ids[t + 1 : -1].tolist())
    learned = tok.decode(ids[mask.astype(bool)].tolist())
    return unescape(role), unescape(text), unescape(learned), sum(map(len, MARKS)) + len(role) + len(text)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _format(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                turns = [assemble(tok, r or "", t or "") for r, t in zip(part["role"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "conv_id": part["conv_id"], "turn": part["turn"], "order_key": part["order_key"],
                    "input_ids": pa.array([i for i, _ in turns], pa.list_(pa.int32())), "loss_mask": pa.array([m for _, m in turns], pa.list_(pa.int8())),
                })

    return run


def format_turns(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, turn, order_key, input_ids, loss_mask), one row per row of conversations.

    A conversation is its rows in the order of (turn, order_key), ids and masks strung
    together; rows stay apart so that no conversation has to fit in memory.  order_key
    (role and text hashed) settles ties of turn; fully equal rows are as good as each
    other.  Null roles and texts are empty, null turns come first, null conv_ids are one
    conversation.  An empty table gives no rows; further columns are ignored.
    """
    kinds = dict(conversations.dtypes)
    rows = conversations.select("conv_id", "turn", F.xxhash64("role", "text").alias("order_key"), "role", "text")
    return rows.mapInArrow(_format(_ranks(tokenizer)), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, order_key long, input_ids array<int>, loss_mask array<tinyint>")


def _read(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(ranks)
        for batch in batches:
            got = [read_turn(tok, i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(batch["input_ids"], batch["loss_mask"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("conv_id", "turn", "order_key")), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string()), pa.array([g[3] for g in got], pa.int64())],
                names=["conv_id", "turn", "order_key", "role", "text", "learned", "rendered_chars"],
            )

    return run


def read_turns(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What format_turns wrote, decoded: role, text, learned (text under the loss mask), rendered_chars of each row."""
    kinds = dict(formatted.dtypes)
    return formatted.select("conv_id", "turn", "order_key", "input_ids", "loss_mask").mapInArrow(_read(_ranks(tokenizer)), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, order_key long, role string, text string, learned string, rendered_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation -> one digest row each; a conversation streams through."""
    conv, state = None, None
    out: list[tuple] = []

    def done():
        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    kind = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, role, text, learned, chars in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text", "learned", "rendered_chars")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += chars
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind if i == 0 else None) for i, x in enumerate(zip(*out, strict=True))], names=names)
            out = []
    if state is not None:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind if i == 0 else None) for i, x in enumerate(zip(*out, strict=True))], names=names)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: numbers and SHA-256 digests of what read_turns gave, in turn order."""
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "order_key")
    return rows.mapInArrow(_digest, f"conv_id {dict(turns.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
