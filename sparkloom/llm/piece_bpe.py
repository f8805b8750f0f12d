"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is cut where no vocabulary piece can span the cut: before a space mark
that follows another character, and around characters that occur in no piece of
two or more characters. Each part is then merged by a score-ordered agenda of
adjacent symbol pairs: the best-scored pair (leftmost on ties) is replaced by its
concatenation until no pair is a piece. Symbols that are no piece become byte
pieces. Parts repeat a lot, so each worker remembers the ids of the parts it has
met, up to a fixed number.

Every part that a worker meets for the first time is also encoded by the
sentencepiece library within the same Arrow batch, and so is one whole text of
each batch; a difference raises an error. Decoding uses the library's decode.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches

MARK = "▁"
#: Parts that a worker remembers in each of two generations; when the younger one is full, the older one goes.
REMEMBER = 400_000
#: Parts up to this length are merged side by side in arrays, longer ones one by one.
SHORT = 32
_NONE = np.iinfo("int32").max


class PieceCodec:
    """Encoder of one merge-type sentencepiece model.

    Space marks and spaces normalise alike, so parts are kept with spaces in them.
    """

    def __init__(self, model_file: str, remember: int = REMEMBER):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = (array("I", [i]).tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.remember = remember
        if any(MARK in p.lstrip(MARK) for p in self.ids) or sp.normalize("a  b\tﬁ ") != f"{MARK}a{MARK}{MARK}b\tﬁ{MARK}":
            raise ValueError("this model needs another normaliser or has pieces that span spaces")
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("this model has no byte pieces")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if "\n" in joined or "\0" in joined:
            raise ValueError("this model has pieces that span lines")
        self.spaced = re.compile(" *[^ \n\0]+| +|\n|\0")
        self.memory, self.older, self.fresh = {"": b""}, {}, []
        self.piece_bytes = [array("I", [i]).tobytes() for i in range(n)]
        self.char_id = np.full(0x110000, -1, "int32")
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")] = self.char_id[ord(MARK)]
        order = {x: k for k, x in enumerate(sorted(set(self.rank.values())))}
        pairs = sorted((self.ids[p[:k]] * n + self.ids[p[k:]], order[self.rank[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.size = n
        self.known = {p for p in self.ids if len(p) == 1} | {" "}
        self.pair_key, self.pair_rank, self.pair_id = (np.array(x, kind) for x, kind in zip(zip(*pairs, strict=True), ("int64", "int32", "int32"), strict=True))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent symbols; the rank of what is no piece comes after all others."""
        key = left.astype("int64") * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (right >= 0)
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_id[at]

    def side_by_side(self, parts: list[str]) -> list[bytes]:
        """Ids of short parts of known characters. Each row of the arrays is the agenda of one part."""
        lens = np.fromiter(map(len, parts), "int64", len(parts))
        width = int(lens.max())
        grid = np.full((len(parts), width + 1), -1, "int32")
        grid[np.arange(width + 1) < lens[:, None]] = self.char_id[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        rank, new = self.pairs(grid[:, :-1], grid[:, 1:])
        rows, done = np.arange(len(parts)), [b""] * len(parts)
        while len(rows):
            best = rank.argmin(1)  # the first of equals
            k = np.arange(len(rows))
            open_ = rank[k, best] != _NONE
            if not open_.all():
                for r, row in zip(rows[~open_].tolist(), grid[~open_], strict=True):
                    done[r] = row[row >= 0].tobytes()
                rows, grid, rank, new, best = rows[open_], grid[open_], rank[open_], new[open_], best[open_]
                if not len(rows):
                    break
                used = int((grid >= 0).sum(1).max())
                grid, rank, new, k = grid[:, : used + 1], rank[:, :used], new[:, :used], np.arange(len(rows))
            merged = new[k, best]
            from_ = np.arange(grid.shape[1]) + (np.arange(grid.shape[1]) > best[:, None])
            grid = np.take_along_axis(np.pad(grid, ((0, 0), (0, 1)), constant_values=-1), from_, 1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), from_[:, :-1], 1)
            new = np.take_along_axis(np.pad(new, ((0, 0), (0, 1))), from_[:, :-1], 1)
            grid[k, best] = merged
            rank[k, best], new[k, best] = self.pairs(merged, grid[k, best + 1])
            k, b = k[best > 0], best[best > 0]
            rank[k, b - 1], new[k, b - 1] = self.pairs(grid[k, b - 1], merged[best > 0])
        return done

    def learn(self, parts: set[str]) -> None:
        """Encode the parts that are not remembered."""
        memory, older, known, fresh, short = self.memory, self.older, self.known.issuperset, [], []
        for p in parts.difference(memory):
            if (ids := older.get(p)) is not None:
                memory[p] = ids
            else:
                fresh.append(p)
        for p in fresh:
            if len(p) <= SHORT and known(p):
                short.append(p)
            else:
                memory[p] = array("I", self.merged(p)).tobytes()
        short.sort(key=len)
        for start in range(0, len(short), 8192):
            some = short[start : start + 8192]
            memory.update(zip(some, self.side_by_side(some), strict=True))
        self.fresh += fresh

    def merged(self, part: str) -> list[int]:
        """Ids of one part: its symbols merged, then looked up; a symbol that is no piece gives its bytes."""
        ids, out = self.ids, []
        for s in self.heap(part.replace(" ", MARK)):
            if s in ids:
                out.append(ids[s])
            else:
                out.extend([self.bytes[b] for b in s.encode()])
        return out

    def heap(self, part: str) -> list[str]:
        """The agenda of one part as a heap of pairs over linked symbols."""
        rank, symbols = self.rank, list(part)
        n = len(symbols)
        todo = [(rank[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapify(todo)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while todo:
            _, i, pair = heappop(todo)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # one of the two has grown since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in rank:
                    heappush(todo, (rank[new], i, new))
            k = before[i]
            if k >= 0 and (new := symbols[k] + pair) in rank:
                heappush(todo, (rank[new], k, new))
        return [s for s in symbols if s]

    def parts(self, text: str) -> list[str]:
        """Parts of a text; some may be empty. Joined, they give the text with one space in front."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or text[-1] == " " or " \n" in text or "\0" in text:
            return self.spaced.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """All ids of each text with begin and end, as 32-bit integers in the machine's order."""
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        get = self.memory.__getitem__
        return [self.begin + b"".join(map(get, p)) + self.end for p in parts]

    def check(self, texts: list[str], raw: list[bytes]) -> None:
        """Compare the parts met since the last check, and one whole text, with the library; then age the memory."""
        self.learn({" ", "\n"})
        memory, fresh = self.memory, [x for x in self.fresh if x]
        for start in range(0, len(fresh), 2000):
            # a line end is a part of its own, so each part can be a line; the library puts one mark before the first
            some = fresh[start : start + 2000]
            ours = memory[" "] + b"".join([memory[p] for x in some for p in ("\n", x)])
            if array("I", self.lib.encode("\n" + "\n".join(some))).tobytes() != ours:
                raise AssertionError("ids differ from the library's")
        self.fresh = []
        if texts:
            k = min(range(len(texts)), key=lambda i: abs(len(texts[i]) - 2000))
            if array("I", self.lib.encode(texts[k], add_bos=True, add_eos=True)).tobytes() != raw[k]:
                raise AssertionError("ids differ from the library's")
        if len(memory) > self.remember:
            self.memory, self.older = {"": b""}, memory


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(documents: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with begin and end ids and decode it again.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256`` with one row per input
    row, repeated rows included. A null text counts as empty (two ids). Other
    columns of the input are ignored. :func:`encode` returns the ids themselves.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            raw = c.encode_bytes(texts)
            c.check(texts, raw)
            ids = [array("I", x) for x in raw]
            decoded = [c.lib.decode(x.tolist()) for x in ids]
            if sys.byteorder != "little":
                for x in ids:
                    x.byteswap()
            yield pd.DataFrame({"id": batch["id"], "n": [len(x) for x in ids], "a": [hashlib.sha256(x).hexdigest() for x in ids], "b": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]})

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n long, a string, b string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias("ids_sha256"), F.col("b").alias("decoded_sha256"))


def encode(documents: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``: the ids of every whole text with begin and end; null counts as empty."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            raw = c.encode_bytes(texts)
            c.check(texts, raw)
            yield pd.DataFrame({"id": batch["id"], "ids": [np.frombuffer(x, "int32") for x in raw]})

    kind = documents.schema[id_col].dataType.simpleString()
    out = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: the library's decoding of each row's ids; null or empty ids give the empty text."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": ["" if x is None else c.lib.decode([int(i) for i in x]) for x in batch["ids"]]})

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_col), "text")
