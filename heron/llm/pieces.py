"""SentencePiece encoding and decoding by suffix-array matching.

The chunks of a batch (a run of word marks and what follows up to the next) are joined to one text
and indexed by a suffix array. Every piece of the vocabulary is looked up by binary search, which
gives the range of its occurrences; each occurrence inside a chunk is an edge. The edges are sorted
by position and relaxed from left to right. As the vocabulary is of the BPE kind, an edge may only
follow the piece that ends before it if merging the two pieces' characters gives back just these two;
then the last piece of every prefix is unique, and the path is the one that BPE merging finds.
Characters outside the vocabulary are their bytes' pieces. A bounded cache keeps chunks that a worker
has encoded, so that each batch only indexes new ones.

Cases: null and empty texts have no ids; white space, control characters and any Unicode text come
back by decoding, as the vocabulary's normal form is the identity and it adds one leading space,
which decoding takes off; repeated rows are encoded each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.plans.session import table

MARK = "▁"
CACHE = 600_000
#: Bits of the table of remembered pairs.
PAIRS = 21
OTHER = 1 << 20
#: Stands for the null character within the index; a lone surrogate, which no text holds.
NULL = "\ud800"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of code points, by doubling of ranks until depth characters are in order."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if fresh[order[-1]] == n - 1 or step * 2 >= depth:
            return order
        rank, step = fresh, step * 2


class Pieces:
    """A SentencePiece BPE vocabulary: encoding by suffix-array matching, decoding by table."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(names))]
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.ids = {names[i]: i for i in range(len(names)) if not special[i]}
        self.names = {i: p for p, i in self.ids.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.width = max(map(len, self.ids), default=1) + 1
        #: Pieces in code point order; beyond them, a character outside the vocabulary is OTHER + code point.
        self.pieces = sorted(self.ids)
        self.table = np.array(self.pieces, f"U{self.width}")
        self.beyond = np.array([p + "\U0010ffff" for p in self.pieces], f"U{self.width}")
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        texts = [bytes([self.of_byte[i]]) if i in self.of_byte else self.names.get(i, "").encode() for i in range(len(names))]
        self.piece_sizes = np.array([len(t) for t in texts], np.int64)
        self.piece_starts = np.concatenate([[0], np.cumsum(self.piece_sizes)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.id_of = np.array([self.ids[p] for p in self.pieces], "<u4")
        self.id_of_ascii = np.array([self.bytes[b] for b in range(128)], "<u4")
        self.pair: dict[tuple[int, int], bool] = {}
        self.pair_keys = np.full(1 << PAIRS, -1, np.int64)
        self.pair_stays = np.zeros(1 << PAIRS, bool)
        self.cache: dict[str, bytes] = {}

    def _text(self, piece: int) -> str:
        return self.pieces[piece] if piece < OTHER else chr(piece - OTHER)

    def _stays(self, left: int, right: int) -> bool:
        """Merging the characters of both pieces by score gives the two pieces again."""
        first = self._text(left)
        second = self._text(right)
        parts = [*first, *second]
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [first, second]

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every occurrence of every piece in the text, by end, longer pieces first."""
        n, width = len(points), self.width
        order = suffix_order(points, width)
        # Every suffix's first characters, in order, for the binary search of all pieces.
        padded = np.concatenate([points, np.zeros(width, np.uint32)])
        heads = np.lib.stride_tricks.sliding_window_view(padded, width)[order].view(f"U{width}").ravel()
        low, high = np.searchsorted(heads, self.table), np.searchsorted(heads, self.beyond)
        many = np.maximum(high - low, 0)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        piece = np.repeat(np.arange(len(many)), many)
        begin = order[rows]
        known = np.zeros(n, bool)
        known[begin[self.lengths[piece] == 1]] = True
        rest = np.flatnonzero(~known & (points != 0))
        length = np.concatenate([self.lengths[piece], np.ones(len(rest), np.int64)])
        begin = np.concatenate([begin, rest])
        piece = np.concatenate([piece, points[rest].astype(np.int64) + OTHER])
        by_end = np.argsort((begin + length) * (width + 1) + width - length, kind="stable")
        return begin[by_end], (begin + length)[by_end], piece[by_end]

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stays() for many pairs, remembered in a table of fixed size; a pair that another one displaced is worked out again."""
        key = left << 22 | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out = self.pair_stays[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, at = np.unique(key[new], return_inverse=True)
            stays = np.array([self._stays(k >> 22, k & (1 << 22) - 1) for k in keys.tolist()], bool)[at]
            out[new] = stays
            self.pair_keys[slot[new]], self.pair_stays[slot[new]] = key[new], stays
        return out

    def _one(self, chunk: str, start: int, begin: list[int], end: list[int], piece: list[int]) -> bytes:
        """The ids of a chunk by its own edges, one after the other."""
        last, pair = [-2] * (len(chunk) + 1), self.pair
        last[0] = -1
        if len(pair) > CACHE:
            pair.clear()
        for b, e, p in zip(begin, end, piece, strict=True):
            b, e = b - start, e - start
            if last[e] == -2:
                key = (last[b], p)
                if key[0] >= 0 and key not in pair:
                    pair[key] = self._stays(*key)
                if key[0] == -1 or pair[key]:
                    last[e] = p
        path, at = [], len(chunk)
        while at:
            p = last[at]
            if p < OTHER:
                path.append(self.ids[self.pieces[p]])
                at -= len(self.pieces[p])
            else:
                c = chr(p - OTHER)
                path += [self.bytes[x] for x in reversed((c if c != NULL else "\0").encode())]
                at -= 1
        return np.array(path[::-1], "<u4").tobytes()

    def _relax(self, chunks: list[str], edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
        """The ids of each chunk, the chunks standing one apart in the text; all short ones go on place by place together."""
        begin, end, piece = edges
        size = np.array([len(c) for c in chunks])
        start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
        first = np.searchsorted(end, np.arange(int(start[-1] + size[-1]) + 2))
        odd = np.zeros(len(chunks), bool)
        # Characters of several bytes outside the vocabulary and very long chunks go on their own.
        odd[np.searchsorted(start, begin[piece >= OTHER + 128], "right") - 1] = True
        odd |= size > 128
        last = np.full(len(first), -2, np.int64)
        last[start] = -1
        some = np.flatnonzero(~odd)
        some = some[np.argsort(-size[some], kind="stable")]
        for t in range(1, int(size[some[0]]) + 1 if len(some) else 1):
            place = start[some[: np.searchsorted(-size[some], -t, "right")]] + t
            edge = first[place]
            while len(place):
                before = last[begin[edge]]
                fits = before == -1
                rest = np.flatnonzero(~fits)
                fits[rest] = self._stay(before[rest], piece[edge[rest]])
                last[place[fits]] = piece[edge[fits]]
                place, edge = place[~fits], edge[~fits] + 1
        at, who, paths, owners = start[some] + size[some], some, [], []
        while len(who):
            p = last[at]
            known = p < OTHER
            p = np.where(known, p, p - OTHER)
            paths.append(np.where(known, self.id_of[p], self.id_of_ascii[p & 127]))
            owners.append(who)
            at = at - np.where(known, self.lengths[p], 1)
            more = at > start[who]
            at, who = at[more], who[more]
        out = [b""] * len(chunks)
        if paths:
            owner = np.concatenate(owners[::-1])
            order = np.argsort(owner, kind="stable")
            data, owner = np.concatenate(paths[::-1])[order].tobytes(), owner[order]
            to = (4 * np.searchsorted(owner, some, "right")).tolist()
            of = (4 * np.searchsorted(owner, some, "left")).tolist()
            for i, x, y in zip(some.tolist(), of, to, strict=True):
                out[i] = data[x:y]
        for i in np.flatnonzero(odd).tolist():
            x, y = first[start[i] + 1], first[start[i] + size[i] + 1]
            out[i] = self._one(chunks[i], int(start[i]), begin[x:y].tolist(), end[x:y].tolist(), piece[x:y].tolist())
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, as the vocabulary's own merging gives them."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = sorted(set().union(*split).difference(self.cache))
        if new:
            # The character that parts the chunks is also one of texts; there it is looked up as another one outside the vocabulary.
            points = np.frombuffer("\0".join(c.replace("\0", NULL) for c in new).encode("utf-32-le", "surrogatepass"), np.uint32)
            self.cache.update(zip(new, self._relax(new, self._edges(points)), strict=True))
        got = self.cache.__getitem__
        return [b"".join(map(got, s)) for s in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(np.array(ids, "<u4").tobytes())

    def decode_bytes(self, data: bytes) -> str:
        """The text of ids that stand as little-endian 32-bit bytes: every id's bytes, one after the other."""
        ids = np.frombuffer(data, "<u4").astype(np.int64)
        many = self.piece_sizes[ids]
        at = np.repeat(self.piece_starts[ids] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(ids) else np.zeros(0, np.int64)
        return self.piece_bytes[at].tobytes().decode("utf-8", "replace").replace(MARK, " ")[1 if len(ids) else 0 :]


@lru_cache(maxsize=1)
def _pieces(path: str | None) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces(path)


def _encode(path: str | None, group: int = 1024):
    def run(batches):
        pieces = _pieces(path)
        for b in batches:
            docs, texts = b.column(0), b.column(1)
            for at in range(0, len(docs), group):
                ids = [np.frombuffer(x, "<i4") for x in pieces.encode_bytes([t or "" for t in texts.slice(at, group).to_pylist()])]
                yield pa.RecordBatch.from_arrays([docs.slice(at, group), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str | None):
    def run(batches):
        pieces = _pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pieces.decode(i) if i is not None else None for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, text string")


def _digest(path: str | None, group: int = 1024):
    def run(batches):
        pieces = _pieces(path)
        for b in batches:
            docs, texts = b.column(0), b.column(1)
            for at in range(0, len(docs), group):
                some = [t or "" for t in texts.slice(at, group).to_pylist()]
                ids = pieces.encode_bytes(some)
                back = [pieces.decode_bytes(i) == t for i, t in zip(ids, some, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(at, group), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(back)],
                    ["doc_id", "n_ids", "ids_crc32", "round_trip"],
                )

    return run


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, the number and checksum of its ids, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_digest(None), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
