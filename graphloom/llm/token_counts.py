"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol per byte, in a doubly linked list. A heap holds the adjacent
pairs that have a merge rank; the lowest rank, leftmost first, is popped and merged, and the pairs at
its sides are pushed. The count is the symbols at the start less the merges; identifiers are never
made. Counts of pieces are remembered in a bounded table.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import per_row, table, texts

LIMIT = 1024
PIECES_KEPT = 300_000
#: Fixed value: the public pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself if printable, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter(dict):
    """Piece to its number of tokens; reads merges and special tokens from a byte-level BPE file."""

    def __init__(self, path: str, kept: int = PIECES_KEPT):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.kept, self.old = kept, {}
        self.symbol = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.result.append(vocab[a + b])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.merged(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n

    def merged(self, piece: bytes) -> int:
        n = left = len(piece)
        if n < 2:
            return n
        rank, result = self.rank, self.result
        sym = [self.symbol[b] for b in piece]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            top = heapq.heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if sym[i] < 0 or j >= n or rank.get(sym[i] << 32 | sym[j]) != r:
                continue  # one of the two has been merged since
            sym[i], sym[j] = result[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0 and (s := rank.get(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, s << 32 | h)
        return left

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


_loaded: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One for each path and worker process."""
    if path not in _loaded:
        _loaded[path] = MergeCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row. Null and empty texts have 0 bytes and tokens; null ids and repeated rows are kept."""

    def run(b: pa.RecordBatch) -> dict:
        count, raw = counter(path).count, texts(b)
        n = [count(t.decode("utf-8", "replace")) for t in raw]
        return {id_col: b.column("id"), "n_bytes": [len(t) for t in raw], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return per_row(docs.selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text"), run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
