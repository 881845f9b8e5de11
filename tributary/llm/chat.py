"""Chat formatting at the token level.

Each turn is encoded on its own; reserved ids that no text can produce mark the turns; the loss mask
follows from prefix sums of the segments' lengths. Control strings inside texts are escaped, so that
the formatted text can be read back as well as the ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word-splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# The template's control strings.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<ROLE>", "</ROLE>")
#: Strings that open and close a turn of each role; other roles are written out between role marks.
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}

#: Tokens after which a conversation goes on in a further row.
PIECE = 1_000_000

_PLAIN = re.compile(r"<<(\\*)(/?SYS>>)|<(\\*)(/?(?:s|ROLE)>)|\[(\\*)(/?INST\])")
_ESCAPED = re.compile(r"<<\\(\\*)(/?SYS>>)|<\\(\\*)(/?(?:s|ROLE)>)|\[\\(\\*)(/?INST\])")


def _opening(m: re.Match) -> tuple[str, int]:
    return ("<<", 1) if m.group(2) else ("<", 3) if m.group(4) else ("[", 5)


def escape(text: str) -> str:
    """Put one more backslash into every control string, plain or escaped already."""

    def more(m: re.Match) -> str:
        start, g = _opening(m)
        return f"{start}\\{m.group(g)}{m.group(g + 1)}"

    return _PLAIN.sub(more, text)


def unescape(text: str) -> str:
    """Undo :func:`escape`."""

    def less(m: re.Match) -> str:
        start, g = _opening(m)
        return f"{start}{m.group(g)}{m.group(g + 1)}"

    return _ESCAPED.sub(less, text)


class Encoder:
    """A byte-level vocabulary with the template's marks as ids above it."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.coding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.reserved = max(pairs.values()) + 2
        self.ids = {m: self.reserved + i for i, m in enumerate(MARKS)}
        self.marks = {i: m for m, i in self.ids.items()}

    def encode(self, text: str) -> list[int]:
        return self.coding.encode_ordinary(text)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; marks come out as their strings."""
        ids = np.asarray(ids, np.int64)
        out, start = [], 0
        for stop in np.flatnonzero(ids >= self.reserved).tolist():
            out += [self.coding.decode_bytes(ids[start:stop].tolist()), self.marks[int(ids[stop])].encode()]
            start = stop + 1
        out.append(self.coding.decode_bytes(ids[start:].tolist()))
        return b"".join(out).decode()


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def _segments(role: str, content: np.ndarray, enc: Encoder) -> list[tuple[np.ndarray | list[int], bool]]:
    """(ids, under the loss mask) of a turn."""
    opening, closing = TURNS.get(role, ("", ""))
    if role in TURNS:
        head = [enc.ids[opening]] if opening else []
        return [(head, False), (content, role == "assistant"), ([enc.ids[closing]], False)]
    return [([enc.ids["<ROLE>"], *enc.encode(escape(role)), enc.ids["</ROLE>"]], False), (content, False), ([enc.ids["</s>"]], False)]


class _Piece:
    """Turns of a conversation that become one row."""

    def __init__(self, conversation: int, number: int, head: list[int]):
        self.conversation, self.number, self.turns, self.size = conversation, number, 0, len(head)
        self.parts: list[tuple[np.ndarray | list[int], bool]] = [(head, False)]

    def add(self, segments: list[tuple[np.ndarray | list[int], bool]]) -> None:
        self.parts += segments
        self.turns += 1
        self.size += sum(len(ids) for ids, _ in segments)

    def row(self, ended: bool, enc: Encoder) -> tuple:
        ends = np.cumsum([len(ids) for ids, _ in self.parts])
        # +1 where a masked segment begins and -1 behind it: the running sum is the mask
        steps = np.zeros(self.size + 1, np.int8)
        for (ids, masked), end in zip(self.parts, ends, strict=True):
            if masked and len(ids):
                steps[end - len(ids)] += 1
                steps[end] -= 1
        ids = np.concatenate([np.asarray(part, np.int32) for part, _ in self.parts])
        return self.conversation, self.number, ended, self.turns, ids, np.cumsum(steps)[:-1].astype(bool), enc.decode(ids)


PIECES = "id long, piece long, ended boolean, n_turns long, input_ids array<int>, loss_mask array<boolean>, text string"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    conversations, numbers, ended, turns, ids, masks, texts = zip(*rows, strict=True)
    names = ["id", "piece", "ended", "n_turns", "input_ids", "loss_mask", "text"]
    arrays = [pa.array(conversations, pa.int64()), pa.array(numbers, pa.int64()), pa.array(ended, pa.bool_()), pa.array(turns, pa.int64()), _lists(ids, pa.int32()), _lists(masks, pa.bool_()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER, piece: int = PIECE) -> DataFrame:
    """Formatted conversations: id, piece, ended, n_turns, input_ids, loss_mask and text (the formatted string).

    A conversation is one row (piece 0, ended) unless it is longer than ``piece`` tokens; then it goes
    on in further rows, cut between turns, whose ids, masks and texts follow each other. The rows of a
    conversation stand one behind the other in one partition, the last one with ``ended``. Turns stream
    through tasks in sorted order, so that a task holds one piece, however long a conversation is.

    Turns are ordered by turn number (nulls first), ties by role and then by text; a repeated
    row is a turn of its own. A null text or role is an empty one. Rows without a conversation id
    belong to none and are left out; an empty table gives no rows. The loss mask covers what
    assistants say and no marks.
    """
    with open(tokenizer, "rb") as f:
        ranks = turns.sparkSession.sparkContext.broadcast(f.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        for batch in batches:
            if batch.num_rows:
                ids = [np.asarray(enc.encode(escape(t or "")), np.int32) for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(ids, pa.int32()), batch.column(3)], names=["id", "turn", "role", "ids", "said"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        at, done, held = None, [], 0
        for batch in batches:
            ends, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for k, (conversation, role) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if at is None or at.conversation != conversation or at.size >= piece:
                    follows = at is not None and at.conversation == conversation
                    if at is not None:
                        done.append(at.row(not follows, enc))
                        held += at.size
                    at = _Piece(conversation, at.number + 1, []) if follows else _Piece(conversation, 0, [enc.ids["<s>"]])
                    if held >= piece:
                        yield _rows(done)
                        done, held = [], 0
                # a copy: a view would keep the batch that it is from
                at.add(_segments(role or "", values[ends[k] : ends[k + 1]].copy(), enc))
        if at is not None:
            yield _rows([*done, at.row(True, enc)])

    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(encoded, "id long, turn long, role string, ids array<int>, said string")
    # the text goes along for the order of equal turns
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", F.coalesce("role", F.lit("")), F.coalesce("said", F.lit(""))).drop("said")
    return ordered.mapInArrow(assembled, PIECES).withColumnRenamed("id", id_col)


def read_back(ids: list[int] | np.ndarray, mask: list[bool] | np.ndarray, enc: Encoder) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of the turns and the text under the mask, from the ids alone (of a piece or a whole conversation)."""
    ids = np.asarray(ids, np.int64)
    opened = {enc.ids[o]: r for r, (o, _) in TURNS.items() if o}
    turns, known, role, start = [], {}, "assistant", 0
    for stop in np.flatnonzero(ids >= enc.reserved).tolist():
        mark = int(ids[stop])
        if mark in opened:
            role = opened[mark]
        elif mark == enc.ids["</ROLE>"]:
            role = unescape(enc.decode(ids[start:stop]))
        elif enc.marks[mark] not in ("<s>", "<ROLE>"):
            known[start, stop] = unescape(enc.decode(ids[start:stop]))
            turns.append((role, known[start, stop]))
            role = "assistant"
        start = stop + 1
    # where the mask begins and ends; a run that is a turn's whole content is decoded already
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, np.int8), [0]]))).tolist()
    said = [known[a, b] if (a, b) in known else unescape(enc.decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return turns, "".join(said)


def digests(formatted: DataFrame, id_col: str = "conv_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """What :func:`read_back` gets from the ids and the mask, as lengths and SHA-256 digests, a row per conversation.

    Takes rows as :func:`format_chats` leaves them: the pieces of a conversation one behind the other;
    pieces that don't follow each other are an error. Counts and digests run on from piece to piece, so a conversation of any
    length is read piece by piece. Repeated turns count each time; an empty table gives an empty one.
    """
    import hashlib

    with open(tokenizer, "rb") as f:
        ranks = formatted.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conversation, expected = None, 0
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            id_ends, ids = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            mask_ends, masks = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy(zero_copy_only=False)
            for k, (key, piece, ended, text) in enumerate(zip(*columns, strict=True)):
                if piece != expected or (piece and key != conversation):
                    raise ValueError(f"piece {piece} of conversation {key} doesn't follow the one before it")
                if not piece:
                    n_turns = chars = size = 0
                    turns_hash, said_hash = hashlib.sha256(), hashlib.sha256()
                turns, said = read_back(ids[id_ends[k] : id_ends[k + 1]], masks[mask_ends[k] : mask_ends[k + 1]], enc)
                turns_hash.update("".join(f"{role}\n{content}\n" for role, content in turns).encode())
                said_hash.update(said.encode())
                n_turns, chars, size = n_turns + len(turns), chars + len(said), size + len(text)
                conversation, expected = key, 0 if ended else piece + 1
                if ended:
                    out.append((key, n_turns, turns_hash.hexdigest(), chars, said_hash.hexdigest(), size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if expected:
            raise ValueError(f"conversation {conversation} ends without its last piece")

    rows = formatted.select(F.col(id_col).alias("id"), "piece", "ended", "input_ids", "loss_mask", "text")
    return rows.mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
