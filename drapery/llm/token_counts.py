"""Token counts by a compiled finite-state tokenizer.

``compile_splitter`` builds the deterministic transducer of the byte-level
pre-tokenizer: its states say what piece is open, its transitions are
annotated with the places where a piece begins (before the current character,
or before the one in front of it), and every piece carries the number of
tokens it emits, taken from the library's model once per distinct piece of a
block and remembered. Texts are joined, each with an end mark, and cut into
chunks of ``CHUNK`` characters; all chunks advance in lockstep from
every state, which gives each chunk's state map; the maps compose by a
parallel prefix scan, and a second pass with known entry states emits. The
scan works on arrays, so one very long text costs no more than many short;
chunks whose map is constant, nearly all in common texts, need no scan.

Defined results: null text counts as empty (0 bytes, 0 tokens); strings of
special tokens inside a text count as the library's default has them, one
token each. Each row is counted on its own, so repeated rows and extra
columns don't matter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .token_store import BYTE_CHARS, items

CHUNK = 64
#: Characters handled at once in a task, and distinct pieces remembered.
BLOCK_CHARS, MEMO = 1_500_000, 300_000
#: Bytes of pieces remembered; one may be as long as its text.
HELD_BYTES = 16 << 20

# character classes: letters that may end a contraction have their own
(C_ST, C_R, C_V, C_E, C_L, C_LETTER, C_NUMBER, C_OTHER, C_QUOTE, C_SPACE, C_BLANK, C_END, C_PAD) = range(13)
LETTERS = (C_ST, C_R, C_V, C_E, C_L, C_LETTER)
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, SPACE1, BLANK1, RUN_SPACE, RUN_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, DONE) = range(13)
N_STATES, N_CLASSES = 13, 13
HERE, BACK = 1, 2  # a piece begins at this character / at the one before it


def _fresh(c: int) -> int:
    if c in LETTERS:
        return IN_LETTERS
    return {C_NUMBER: IN_NUMBER, C_OTHER: IN_OTHER, C_QUOTE: QUOTE, C_SPACE: SPACE1, C_BLANK: BLANK1}[c]


def _step(q: int, c: int) -> tuple[int, int]:
    """Next state and where pieces begin, for state ``q`` and class ``c``."""
    if c == C_PAD:
        return q, 0
    pending = {QUOTE_R: C_E, QUOTE_V: C_E, QUOTE_L: C_L}.get(q)
    if c == C_END:
        return DONE, BACK if pending is not None else 0
    if pending is not None:  # the quote was a piece of its own unless the contraction ends here
        if c == pending:
            return DONE, 0
        return (IN_LETTERS, BACK) if c in LETTERS else (_fresh(c), BACK | HERE)
    if q == QUOTE:
        if c in (C_ST, C_R, C_V, C_L):
            return {C_ST: DONE, C_R: QUOTE_R, C_V: QUOTE_V, C_L: QUOTE_L}[c], 0
        if c in (C_OTHER, C_QUOTE):
            return IN_OTHER, 0
    if (q == IN_LETTERS and c in LETTERS) or (q == IN_NUMBER and c == C_NUMBER) or (q == IN_OTHER and c in (C_OTHER, C_QUOTE)):
        return q, 0
    if q in (SPACE1, BLANK1, RUN_SPACE, RUN_BLANK):
        if c in (C_SPACE, C_BLANK):
            return RUN_SPACE if c == C_SPACE else RUN_BLANK, 0
        joined = IN_OTHER if c == C_QUOTE else _fresh(c)
        if q in (SPACE1, RUN_SPACE):  # the last space belongs to the next piece
            return joined, 0 if q == SPACE1 else BACK
        return _fresh(c), HERE if q == BLANK1 else HERE | BACK
    return _fresh(c), HERE


# one byte holds N_CLASSES * state + class, so a step of all chunks is an addition and a translation of bytes
def _table(of: int, times: int) -> bytes:
    found = [times * _step(q, c)[of] for q in range(N_STATES) for c in range(N_CLASSES)]
    return bytes(found + [0] * (256 - len(found)))


NEXT, CUTS = _table(0, N_CLASSES), _table(1, 1)


def _advance(table: bytes, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """``table`` at each state (times N_CLASSES) and class."""
    at = state + classes
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


class Transducer:
    """The compiled tokenizer of one task: class table, state maps, token counts of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if (spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space")
                or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)):
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is compiled")
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.held = 0
        self.classes = np.full(0x110000, 255, np.uint8)
        self.counts: dict[bytes, int] = {}

    def _classify(self, cp: int) -> int:
        """Class of a character, as the library's own splitter has it."""
        ch = chr(cp)
        fixed = {"'": C_QUOTE, " ": C_SPACE, "r": C_R, "v": C_V, "e": C_E, "l": C_L} | dict.fromkeys("stmd", C_ST)
        if ch in fixed:
            return fixed[ch]
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for before, kind in (("a", C_LETTER), ("1", C_NUMBER), ("!", C_OTHER)):
            if len(split(before + ch)) == 1:
                return kind
        return C_BLANK

    def _class_of(self, cps: np.ndarray) -> np.ndarray:
        out = self.classes[cps]
        if (new := out == 255).any():
            for cp in np.unique(cps[new]):
                self.classes[cp] = self._classify(int(cp))
            out = self.classes[cps]
        return out

    def piece_starts(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places where pieces begin among the code points ``cps``; there is an end mark at ``ends``, a piece of its own."""
        n = len(cps)
        grid = np.full(-(-n // CHUNK) * CHUNK, C_PAD, np.uint8)
        grid[:n] = self._class_of(cps)
        grid[ends] = C_END
        grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        # state maps: where each state ends after the chunk
        maps = np.repeat(np.arange(0, N_STATES * N_CLASSES, N_CLASSES, dtype=np.uint8)[:, None], grid.shape[1], axis=1)
        for row in grid:
            maps = _advance(NEXT, maps, row)
        maps = maps.copy()
        maps[:, 0] = maps[START, 0]  # the first chunk is entered from the start: a constant map
        step = 1
        # inclusive scan under composition; constant maps stay as they are
        while len(left := np.flatnonzero((maps != maps[0]).any(axis=0))):
            maps[:, left] = np.take_along_axis(maps[:, left], (maps[:, left - step] // N_CLASSES).astype(np.intp), axis=0)
            step *= 2
        state = np.empty(grid.shape[1], np.uint8)
        state[0], state[1:] = START * N_CLASSES, maps[0, :-1]
        cuts = np.empty_like(grid)
        for j, row in enumerate(grid):
            cuts[j] = _advance(CUTS, state, row)
            state = _advance(NEXT, state, row)
        cuts = cuts.T.reshape(-1)[:n]
        begins = (cuts & HERE).astype(bool)
        begins[:-1] |= (cuts[1:] & BACK).astype(bool)
        begins[ends] = True
        return np.flatnonzero(begins)

    def _learn(self, new: list[bytes]) -> None:
        """Counts of pieces, in the form the model has them: bytes as characters."""
        chars, at = b"".join(new).decode("latin-1").translate(BYTE_CHARS), 0
        for piece in new:
            self.counts[piece] = len(self.model.tokenize(chars[at:at + len(piece)]))
            self.held += len(piece)
            at += len(piece)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        segments, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            extra[i] = len(parts) - 1
            for p in parts:
                if p:
                    segments.append(p)
                    owner.append(i)
        if not segments:
            return extra
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        text = "\n".join(segments) + "\n"
        data = text.encode()
        starts = self.piece_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), ends)
        at = starts if len(data) == len(text) else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        at = np.append(at, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        if len(self.counts) > MEMO or self.held > HELD_BYTES:
            self.counts, self.held = {}, 0
        names, known = items(pieces.dictionary), self.counts
        if new := [p for p in names if p not in known]:
            self._learn(new)
        n = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]
        marks = np.searchsorted(starts, ends)
        n[marks] = 0
        of_segment = np.add.reduceat(n, np.concatenate([[0], marks[:-1] + 1]))
        np.add.at(extra, owner, of_segment)
        return extra


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _count_batches(path: str):
    def run(batches):
        t = Transducer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [t.count(texts[a:b]) for a, b in blocks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())],
                                             names=["id", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("id"), text.alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    out = map_batches(d, _count_batches(tokenizer_path), f"id {kind}, n_tokens bigint")
    return out.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
