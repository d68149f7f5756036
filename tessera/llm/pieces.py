"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The text's UTF-8 bytes get one leading blank if the model asks for it, and blanks are written as the marker U+2581. The
best path maximises the sum of the pieces' log scores; a character that no single piece covers costs the smallest score
less 10 and is written as its bytes' pieces. Of equally good paths, the one whose last piece is longer wins, at every
position. A marker that the text itself holds is written as bytes, so that decoding gives back exactly the text.

If no piece goes on into a marker after another sign, a blank always begins a piece; and a line feed in no piece is a
piece by itself. Texts are then cut there, and only what a worker hasn't seen lately is searched, many words at once.

Scores: of a unigram model as they are; of a BPE model, whose scores are negative ranks, minus the logarithm of the
rank plus 2.

Defined results: null and empty texts have no pieces; a null id is kept; repeated rows are encoded alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes

MODEL = os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁".encode()
#: Words remembered by a worker, and bytes of the longest word that is searched together with others.
REMEMBERED, TOGETHER = 300_000, 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


class Trie:
    """Double array over bytes: the child of s by byte b is base[s] + b + 1, if check there is s; value is a piece or -1."""

    def __init__(self, words: dict[bytes, int]):
        root: dict = {}
        for word, i in words.items():
            node = root
            for b in word:
                node = node.setdefault(b, {})
            node[-1] = i
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], queue = 0, [(0, root)]
        free = {True: 1, False: 1}  # where to look for room: for one child, and for more (which leaves gaps to the former)
        for state, node in queue:
            codes = sorted(b for b in node if b >= 0)
            value[state] = node.get(-1, -1)
            if not codes:
                continue
            at = max(free[len(codes) == 1], codes[0] + 1)
            while True:
                while at + 257 >= len(check):
                    base += [0] * len(base)
                    value += [-1] * len(value)
                    check += [-1] * len(check)
                b = at - codes[0] - 1
                if check[at] < 0 and all(check[b + c + 1] < 0 for c in codes):
                    break
                at += 1
            free[len(codes) == 1] = max(free[len(codes) == 1], at - 256 if len(codes) > 1 else at - codes[0])
            base[state] = b
            for c in codes:
                check[b + c + 1] = state
            queue += [(b + c + 1, node[c]) for c in codes]
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Model:
    def __init__(self, pieces: list[tuple[bytes, float, int]], prefix: bool = True):
        """pieces: (UTF-8, log score, kind: 1 normal, 2 unknown, 3 control, 4 user defined, 6 byte)."""
        words = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4) and p}
        self.trie, self.prefix = Trie(words), prefix
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = float(self.score[list(words.values())].min(initial=0.0)) - 10
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte = [self.unk] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte[int(p[3:5], 16)] = i
        back = {i: bytes([b]) for b, i in enumerate(self.byte) if i != self.unk}
        self.bytes_of = [back.get(i, p.replace(MARK, b" ") if kind in (1, 4) else b"") for i, (p, _, kind) in enumerate(pieces)]
        inner = any(MARK in re.sub(b"^(?:" + MARK + b")+", b"", p) for p in words)
        feed = rb"\n" if not any(b"\n" in p for p in words) else b""
        self.cut = re.compile(rb" *[^ " + feed + rb"]+| +" + (rb"|\n" if feed else b"")) if not inner else re.compile(rb"(?s).+")
        self.lists = None

    @classmethod
    def load(cls, path: str) -> Model:
        pieces, prefix, kind_of = [], True, 1
        for number, data in fields(open(path, "rb").read()):
            if number == 1:
                f = dict(fields(data))
                pieces.append((f[1], float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]), f.get(3, 1)))
            elif number == 2:
                kind_of = dict(fields(data)).get(3, 1)
            elif number == 3:
                prefix = bool(dict(fields(data)).get(3, 1))
        if kind_of == 2:
            rank = {i: k for k, i in enumerate(sorted((i for i, p in enumerate(pieces) if p[2] in (1, 4)), key=lambda i: (-pieces[i][1], i)))}
            pieces = [(p, -float(np.log(rank[i] + 2)) if i in rank else s, k) for i, (p, s, k) in enumerate(pieces)]
        return cls(pieces, prefix)

    def _one(self, word: bytes) -> list[int]:
        """Best path of one word, blanks already markers."""
        if self.lists is None:
            self.lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist()
        base, check, value, score = self.lists
        n = len(word)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if word[i] & 0xC0 == 0x80 or best[i] == float("-inf"):
                continue
            size = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
            state, single = 0, False
            for j in range(i, n):
                to = base[state] + word[j] + 1
                if check[to] != state:
                    break
                state = to
                p = value[state]
                if p >= 0:
                    single |= j + 1 == i + size
                    if best[i] + score[p] > best[j + 1]:
                        best[j + 1], back[j + 1] = best[i] + score[p], (i, p)
            if not single and best[i] + self.unknown > best[min(n, i + size)]:
                best[min(n, i + size)], back[min(n, i + size)] = best[i] + self.unknown, (i, -1)
        out, at = [], n
        while at:
            i, p = back[at]
            out.append([p] if p >= 0 else [self.byte[b] for b in word[i:at]])
            at = i
        return [p for part in reversed(out) for p in part]

    def _many(self, words: list[bytes]) -> list[list[int]]:
        """As _one, for words of up to TOGETHER bytes: one step of all their searches at a time."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        sym = np.zeros((n, width + 4), np.int32)
        sym[:, :width] = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 5), np.int32), np.full((n, width + 5), -1, np.int32)
        for i in range(width):
            live = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(live):
                continue
            first = sym[live, i]
            step = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single = np.zeros(n, bool)
            rows, state, here, wide = live, np.zeros(len(live), np.int32), best[live, i], step
            for j in range(i, width):
                to = base[state] + sym[rows, j] + 1
                ok = (check[to] == state) & (size[rows] > j)
                rows, state, here, wide = rows[ok], to[ok], here[ok], wide[ok]
                if not len(rows):
                    break
                p = value[state]
                got = p >= 0
                if got.any():
                    r = rows[got]
                    single[r[wide[got] == j + 1 - i]] = True
                    new = here[got] + self.score[p[got]]
                    up = new > best[r, j + 1]
                    r = r[up]
                    best[r, j + 1], start[r, j + 1], piece[r, j + 1] = new[up], i, p[got][up]
            rest = ~single[live]
            r, e = live[rest], np.minimum(i + step[rest], size[live[rest]])
            new = best[r, i] + self.unknown
            up = new > best[r, e]
            best[r[up], e[up]], start[r[up], e[up]], piece[r[up], e[up]] = new[up], i, -1
        start, piece, out = start.tolist(), piece.tolist(), []
        for k, w in enumerate(words):
            ids, at = [], len(w)
            s, p = start[k], piece[k]
            while at:
                i = s[at]
                if p[at] >= 0:
                    ids.append(p[at])
                else:
                    ids.extend(self.byte[b] for b in reversed(w[i:at]))
                at = i
            out.append(ids[::-1])
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (4 bytes each) of distinct words, with blanks still blanks."""
        marked = [w.replace(b" ", MARK) for w in words]
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i in range(len(words)) if len(marked[i]) <= TOGETHER), key=lambda i: len(marked[i]))
        for at in range(0, len(order), 8192):
            part = order[at : at + 8192]
            for i, ids in zip(part, self._many([marked[i] for i in part])):
                out[i] = np.array(ids, np.int32).tobytes()
        for i, w in enumerate(marked):
            if len(w) > TOGETHER:
                out[i] = np.array(self._one(w), np.int32).tobytes()
        return out

    def encode(self, texts: list[bytes], seen: dict[bytes, bytes] | None = None) -> list[bytes]:
        """Packed ids of each text. seen remembers words between calls; it is emptied when it is full."""
        seen = {} if seen is None else seen
        literal = np.array([self.byte[b] for b in MARK], np.int32).tobytes()
        out = []
        for at in range(0, len(texts), 256):
            cut = []
            for text in texts[at : at + 256]:
                parts = (b" " + text if self.prefix and text else text).split(MARK)
                cut.append([self.cut.findall(p) for p in parts])
            fresh = {w for parts in cut for p in parts for w in p if w not in seen}
            if len(seen) + len(fresh) > REMEMBERED:
                seen.clear()
                fresh = {w for parts in cut for p in parts for w in p}
            fresh = list(fresh)
            seen.update(zip(fresh, self.words(fresh) if fresh else []))
            out += [literal.join([b"".join(map(seen.__getitem__, p)) for p in parts]) for parts in cut]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return text[1:] if self.prefix and text[:1] == b" " else text


_seen: dict = {}


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, ids, n_byte_pieces, exact): the pieces of every whole text, and whether decoding them gives it back."""
    told, key = docs.sparkSession.sparkContext.broadcast(Model.load(path)), path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = told.value, _seen.setdefault(key, {})
        byte = np.zeros(len(model.bytes_of), bool)
        byte[[i for i in model.byte if i != model.unk]] = True
        for batch in batches:
            texts = text_bytes(batch.column(1))
            packed = model.encode(texts, seen)
            ids = [np.frombuffer(p, np.int32) for p in packed]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))),
                    pa.array([int(byte[i].sum()) for i in ids], pa.int64()),
                    pa.array([model.decode(i) == t for i, t in zip(ids, texts)]),
                ],
                names=["id", "n_bytes", "ids", "n_byte_pieces", "exact"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, ids array<int>, n_byte_pieces long, exact boolean")


def decode(rows: DataFrame, path: str = MODEL, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text of their pieces; null and empty pieces give an empty text, an id out of range nothing."""
    told = rows.sparkSession.sparkContext.broadcast(Model.load(path))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        model = told.value
        size = len(model.bytes_of)
        return pa.array([model.decode(np.array([i for i in x or () if i is not None and 0 <= i < size], np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return rows.withColumn(to, text(F.col(ids_col)))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return encode(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", "exact", "ids")
