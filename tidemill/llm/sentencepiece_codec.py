"""SentencePiece encoding and decoding by an Aho-Corasick automaton and one Viterbi pass.

The pieces of a model file form the automaton. While a text runs through it, the
output links at each position name the pieces that end there; each relaxes the
best score of that position (best score where it starts, plus its own). What no
piece covers falls back to byte pieces. Decoding joins pieces and bytes again,
and the round trip is exact.

The segmentation is the one of highest total piece score. (For a file whose
pieces were made by merging, its own library merges by rank instead, so ids may
differ from that library's while the decoded text is the same; see the README.)

Defined results. Null text: no ids. Of segmentations of one score the one whose last
piece is found first (the longest) stands. Repeated rows repeat. Texts of any length
are read whole, in linear time. An empty table gives no rows. ``doc_id`` is carried,
other columns, whatever their names, are dropped. The model's own normaliser isn't
read: text is encoded as it stands, with blanks as the pieces write them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 500_000
BYTE_COST = -20.0  #: added to the worst piece score for each byte that falls back


class Automaton:
    """Aho-Corasick over (piece, id, score): child tables, failure links, output links."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.link = [0], [0]
        self.held: list[tuple[int, int, float] | None] = [None]
        for piece, i, score in pieces:
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.link.append(0)
                    self.held.append(None)
                at = self.next[at][c]
            if self.held[at] is None or self.held[at][2] < score:
                self.held[at] = (len(piece), i, score)
        queue = list(self.next[0].values())
        for at in queue:  # breadth first: it grows while it is read
            for c, child in self.next[at].items():
                f = self.fail[at]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                f = self.next[f].get(c, 0)
                self.fail[child] = f
                self.link[child] = f if self.held[f] else self.link[f]
                queue.append(child)

    def viterbi(self, text: str, fallback) -> tuple[list[int], float]:
        best = [0.0] + [-np.inf] * len(text)
        came: list = [None] * (len(text) + 1)
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            out = at if self.held[at] else self.link[at]
            while out:
                length, i, score = self.held[out]
                if (s := best[end - length] + score) > best[end]:
                    best[end], came[end] = s, (length, (i,))
                out = self.link[out]
            if came[end] is None:
                ids, score = fallback(c)
                best[end], came[end] = best[end - 1] + score, (1, ids)
        ids, end = [], len(text)
        while end:
            length, part = came[end]
            ids.extend(reversed(part))
            end -= length
        return ids[::-1], float(best[-1])


class Codec(dict):
    """Caches segment -> id bytes, where a segment (blanks, then other characters) is what no piece crosses."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        pieces = [(model.id_to_piece(i), i, model.get_score(i)) for i in range(n) if not special[i] and not model.is_byte(i)]
        self.automaton = Automaton(pieces)
        self.unknown = model.unk_id()
        self.floor = min(s for _, _, s in pieces) + BYTE_COST
        self.scores = np.zeros(n)
        for _, i, s in pieces:
            self.scores[i] = s
        self.scores[list(self.bytes.values())] = self.floor
        self.text = {i: p for p, i, _ in pieces}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # Blanks begin pieces; one inside a piece would make segments depend on each other.
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in pieces)
        self.segments = re.compile("(?s).+" if crosses else f"(?s){SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def fallback(self, c: str) -> tuple[tuple[int, ...], float]:
        raw = c.encode("utf-8", "surrogatepass")
        if all(b in self.bytes for b in raw):
            return tuple(self.bytes[b] for b in raw), self.floor * len(raw)
        return (self.unknown,), self.floor

    def __missing__(self, segment: str) -> bytes:
        ids, _ = self.automaton.viterbi(segment, self.fallback)
        data = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(segment) <= 64:
            self[segment] = data
        return data

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids; a leading blank is added, as the model's own library does."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.segments.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, data: bytes) -> str:
        out, run = [], bytearray()
        text, byte_of = self.text, self.byte_of
        for i in np.frombuffer(data, "<u4").tolist():
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(text.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1:]


_held: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _held:
        _held[path] = Codec(path)
    return _held[path]


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, score, round_trip (the decoded ids are the text again) and ids."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            data = [c.encode(t) for t in batch["text"]]
            ids = [np.frombuffer(d, "<u4") for d in data]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_ids": [len(x) for x in ids], "ids_crc32": [zlib.crc32(d) for d in data]})
            out["score"] = [float(c.scores[x].sum()) for x in ids]
            # A blank sign of the text itself is read as a blank; that is all the model can tell.
            out["round_trip"] = [c.decode(d) == (t or "").replace(SPACE, " ") for d, t in zip(data, batch["text"])]
            if with_ids:
                out["ids"] = [x.astype(np.int32) for x in ids]
            yield out

    shape = "doc_id string, n_ids long, ids_crc32 long, score double, round_trip boolean" + (", ids array<int>" if with_ids else "")
    # As text, for pandas would turn ids beside a null one into floats.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(rows, shape)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids array<int>) with ``decoded``."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if x is None else c.decode(np.asarray(x, "<u4").tobytes()) for x in ids])

    return encoded.withColumn("decoded", text_of("ids"))
