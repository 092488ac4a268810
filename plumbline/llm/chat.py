"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its loss mask found by
intersecting the sorted spans of assistant texts with the tokens' spans by binary
search. A turn is `<|turn|>` role `<|text|>` text `<|end|>`; the three marks are added
to the byte-level vocabulary as special tokens, so no token straddles a mark and the
spans of a text are those of whole tokens.

Control strings inside texts and roles (the marks, and those of common chat templates)
are escaped by ESC after their first character, and ESC itself by ESC and "e"; since no
control string has "e" second, the reverse is unambiguous.

Rows go to their conversation's partition sorted by turn and are streamed: what is held
is one piece of a conversation, of at most PIECE characters or one longer turn. A piece
ends after a turn, where an encoding of the whole has a special token, so the pieces'
tokens are those of the whole: a conversation of any length, or one that holds a third
of all rows, needs bounded memory. Its digests need its turns in order, so one
conversation is one task's stream.

Columns other than the four asked for are not looked at. Null texts and roles are empty; null conversation ids are one conversation; turns with
equal numbers are ordered by role and text, null turns first.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESC = "␛"
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PIECE = 1 << 18
_CONTROL = re.compile("([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_UNESCAPE = re.compile(ESC + "(e?)")


def escape(text: str) -> str:
    return _CONTROL.sub("\\1" + ESC, text.replace(ESC, ESC + "e"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: ESC if m[1] else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted turns and the spans of assistant texts in it, sorted, as rows of (start, end)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{TURN}{escape(role)}{TEXT}"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the formatted text."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, rest = turn.partition(TEXT)
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: the last span that starts at or before a token must reach beyond its start.
    offsets: (start, end) of each token; tokens without characters are in none."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    return (k >= 0) & (offsets[:, 0] < spans[np.maximum(k, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    if path not in _tokenizers:
        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked_texts(formatted: str, offsets: np.ndarray, under: np.ndarray) -> list[str]:
    """The runs of characters under the mask, unescaped, in order."""
    at = np.flatnonzero(under)
    if not len(at):
        return []
    new = np.flatnonzero(np.r_[True, offsets[at[1:], 0] > np.maximum.accumulate(offsets[at, 1])[:-1]])
    starts = offsets[at[new], 0]
    ends = np.maximum.reduceat(offsets[at, 1], new)
    return [unescape(formatted[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _sorted(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]], bool]]:
    """(conversation, turns, whether these are its last) of bounded size from sorted rows."""
    at, turns, size, any_row = None, [], 0, False
    for b in batches:
        for conv, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if any_row and conv != at:
                yield at, turns, True
                turns, size = [], 0
            elif size > PIECE:
                yield at, turns, False
                turns, size = [], 0
            at, any_row = conv, True
            turns.append((role, text))
            size += len(role) + len(text)
    if any_row:
        yield at, turns, True


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None) -> DataFrame:
    """conv_id, piece, formatted text, token ids and loss mask; a long conversation takes several rows, in order of piece."""
    ship(conversations.sparkSession)
    path = path or byte_bpe()
    kind = conversations.schema[conv].dataType.simpleString()
    rows = _sorted(conversations, conv, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizer(path), 0
        for conv_id, turns, last in _pieces(batches):
            formatted, spans = render(turns)
            e = t.encode(formatted, add_special_tokens=False)
            under = mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
            yield pa.RecordBatch.from_pydict({"conv_id": [conv_id], "piece": pa.array([number], pa.int32()), "formatted": [formatted], "ids": pa.array([e.ids], pa.list_(pa.int32())), "loss_mask": pa.array([under.tolist()], pa.list_(pa.bool_()))})
            number = 0 if last else number + 1

    return rows.mapInArrow(tidy(run), f"conv_id {kind}, piece int, formatted string, ids array<int>, loss_mask array<boolean>")


#: The conversation that the contract adds.
PROBE = "</s>[INST] ok [/INST]"


def digest(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """The contract of op2: everything is read back from the formatted text, its tokens and their mask."""
    spark = conversations.sparkSession
    ship(spark)
    path = path or byte_bpe()
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = _sorted(conversations.select("conv_id", "turn", "role", "text").unionByName(added), "conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sha = tokenizer(path), hashlib.sha256
        out: list[tuple] = []
        fresh = lambda: [0, sha(), 0, sha(), 0]
        now, waiting = fresh(), []

        def encode(pieces: list) -> Iterator[tuple]:
            rendered = [render(turns) for _, turns, _ in pieces]
            for (conv_id, _, last), (formatted, spans), e in zip(pieces, rendered, t.encode_batch([f for f, _ in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                yield conv_id, last, formatted, offsets, mask(offsets, spans)

        def settle() -> Iterator[tuple]:
            nonlocal now
            for conv_id, last, formatted, offsets, under in encode(waiting):
                for role, text in parse(formatted):
                    now[0] += 1
                    now[1].update(f"{role}\n{text}\n".encode())
                for text in masked_texts(formatted, offsets, under):
                    now[2] += len(text)
                    now[3].update(text.encode())
                now[4] += len(formatted)
                if last:
                    yield conv_id, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]
                    now = fresh()

        size = 0
        for piece in _pieces(batches):
            waiting.append(piece)
            size += sum(len(x) for turn in piece[1] for x in turn)
            if size > PIECE:
                out += settle()
                waiting, size = [], 0
            if len(out) > 2000:
                yield _batch(out)
                out = []
        out += settle()
        if out:
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _oracle() -> str:
    escaped = "replace(coalesce({0}, ''), '␛', '␛e')"
    for c in CONTROL:
        escaped = f"replace({escaped}, '{c}', '{c[0]}␛{c[1:]}')"
    marks = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t AS (SELECT *, length({escaped.format("role")}) + length({escaped.format("text")}) + {marks} AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


ORACLE = _oracle()
