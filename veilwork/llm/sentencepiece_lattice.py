"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has one node per character boundary and one edge per vocabulary piece.  Forward filtering sums
the weights of all paths to a node; backward sampling then walks from the end and draws each incoming edge in
proportion to (mass of its start) x (weight of its piece), which gives every segmentation its exact probability.
No piece crosses a blank run or a newline, so the lattice factors into words; forward masses are computed once per
distinct word and worker, and the backward walk of all words of a text runs as one vectorised draw per step.

Piece weights: the public model is a merge list whose score is minus a rank r, taken as Zipf weights
``(r + 2) ** -alpha``.  Each draw hashes (seed, row key, position, step): the same key and text give the same pieces
on any cluster, in any order, after any retry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilwork.llm.common import mix, texts

MODEL_FILE = "piece_bpe_32k.model"
MARK = "▁"
ALPHA = 2.0
SEED = 17
#: Words up to this many characters are filtered in vectorised groups; longer ones one by one.
GROUPED_LENGTH = 24
#: So many distinct words stay between texts in a worker (memory only; results are equal).
KEPT_WORDS = 300_000
#: No edge weighs less, so forward masses of grouped words stay within a double.
LEAST_WEIGHT = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r" *[^ \n]+|\n| +")
_CACHE: dict[tuple[str, float], Lattices] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


class Lattices:
    """Flat arrays of lattice nodes and their incoming edges, longest piece first, with running shares."""

    def __init__(self, model_file: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.byte_ids, self.raw, self.weight = [model.unk_id()] * 256, [b""] * n, np.zeros(n + 1)
        self.pieces: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.pieces[text] = i
                self.raw[i] = text.encode()
                self.weight[i] = max(LEAST_WEIGHT, (2.0 - model.get_score(i)) ** -alpha)
        self.longest = max(map(len, self.pieces))
        self._index()
        self.words: dict[str, int] = {}
        self.length = np.ones(n + 1, np.int32)  # the last, at -1, is for single characters outside the vocabulary
        for text, i in self.pieces.items():
            self.length[i] = len(text)
        self.share, self.ids, self.first = np.empty(1 << 16, np.float32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.size = self.nodes = 0
        self.bytes_of: dict[int, list[int]] = {}

    def _index(self) -> None:
        """Two hash tables over the pieces; the second has those that meet another one in the first."""
        self.keys = np.zeros(len(self.weight), np.uint64)
        for text, i in self.pieces.items():
            h = 0
            for c in text:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.keys[i] = h
        ids = np.array(sorted(self.pieces.values()))
        self.tables = []
        for shift in (44, 24):
            table = np.full(1 << 20, -1, np.int32)
            slots = (mix(self.keys[ids]) >> np.uint64(shift)).astype(np.int64) & 0xFFFFF
            table[slots] = ids
            self.tables.append((np.uint64(shift), table))
            ids = ids[table[slots] != ids]
        self.rest = {int(self.keys[i]): int(i) for i in ids}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 for none."""
        mixed, out = mix(hashes), None
        for shift, table in self.tables:
            found = table[(mixed >> shift).astype(np.int64) & 0xFFFFF]
            found = np.where(self.keys[found] == hashes, found, -1)
            out = found if out is None else np.where(out >= 0, out, found)
        for key, i in self.rest.items():
            out = np.where(hashes == np.uint64(key), i, out)
        return out

    def _append(self, share: np.ndarray, ids: np.ndarray, degree: np.ndarray) -> None:
        """Edges node by node; ``degree`` counts each node's edges and is 0 at the start of a word."""
        while self.size + len(ids) > len(self.ids):
            self.share, self.ids = (np.resize(a, 2 * len(a)) for a in (self.share, self.ids))
        while self.nodes + len(degree) > len(self.first):
            self.first = np.resize(self.first, 2 * len(self.first))
        at, ends = slice(self.size, self.size + len(ids)), np.cumsum(degree)
        self.share[at], self.ids[at] = share, ids
        self.share[self.size + ends[degree > 0] - 1] = 2  # the last edge takes what is left
        self.first[self.nodes : self.nodes + len(degree)] = self.size + ends - degree
        self.size += len(ids)
        self.nodes += len(degree)

    def add_long(self, word: str) -> int:
        """Forward filtering of one long word; gives the number of its last node."""
        mass, share, ids, degree = [1.0], [], [], [0]
        for end in range(1, len(word) + 1):
            total, edges = 0.0, []
            for start in range(max(0, end - self.longest), end):
                i = self.pieces.get(word[start:end])
                if i is not None:
                    w = mass[start] * self.weight[i]
                    total += w
                    edges.append((w, i))
            if word[end - 1] not in self.pieces:  # byte fallback keeps the lattice connected
                w = mass[end - 1] * LEAST_WEIGHT
                total += w
                edges.append((w, -1 - ord(word[end - 1])))
            running = 0.0
            for w, i in edges:
                running += w
                share.append(running / total)
                ids.append(i)
            degree.append(len(edges))
            mass.append(total)
            if total < 1e-100:  # only ratios within the reach of one piece matter
                for k in range(max(0, end + 1 - self.longest), end + 1):
                    mass[k] /= total
        self._append(np.array(share), np.array(ids), np.array(degree))
        return self.nodes - 1

    def add_group(self, words: list[str]) -> np.ndarray:
        """Forward filtering of many words of at most ``GROUPED_LENGTH`` characters."""
        n, length = len(words), np.array(list(map(len, words)))
        wide = int(length.max())
        code = np.array(words, dtype=f"U{wide}").view(np.uint32).reshape(n, wide).astype(np.uint64)
        reach = min(self.longest, wide)
        weight, piece = np.zeros((reach, n, wide)), np.full((reach, n, wide), -1, np.int32)  # by length - 1 and end - 1
        h = np.zeros((n, wide), np.uint64)
        for size in range(1, reach + 1):
            h = h[:, : wide - size + 1] * _BASE + code[:, size - 1 :] + np.uint64(1)
            found = self.lookup(h)
            piece[size - 1, :, size - 1 :] = found
            weight[size - 1, :, size - 1 :] = self.weight[found] * (found >= 0)
        lone = piece[0] < 0
        piece[0][lone] = -1 - code.astype(np.int32)[lone]
        weight[0][lone] = LEAST_WEIGHT
        mass = np.zeros((n, wide + 1))
        mass[:, 0] = 1
        for end in range(1, wide + 1):
            for size in range(1, min(reach, end) + 1):
                weight[size - 1, :, end - 1] *= mass[:, end - size]
            mass[:, end] = weight[:, :, end - 1].sum(axis=0)
        share = np.cumsum(weight[::-1], axis=0) / mass[:, 1:]
        kept = (weight[::-1] > 0) & (np.arange(wide)[None, :] < length[:, None])[None]
        w, e, s = np.nonzero(kept.transpose(1, 2, 0))  # by word, node, length
        degree = np.zeros((n, wide + 1), np.int64)
        degree[:, 1:] = kept.sum(axis=0)
        real = np.arange(wide + 1)[None, :] <= length[:, None]
        last = self.nodes + np.cumsum(length + 1) - 1
        self._append(share[s, w, e], piece[reach - 1 - s, w, e], degree[real])
        return last

    def encode(self, keys: list[int], rows: list[str], seed: int) -> list[np.ndarray]:
        """Sampled piece ids of each text."""
        known = self.words
        split = [_WORD.findall(" " + t) if t else [] for t in rows]
        counts = np.array(list(map(len, split)), np.int64)
        flat = [w for ws in split for w in ws]
        node = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        missing, held = np.flatnonzero(node < 0), (self.size, self.nodes)
        if len(missing):
            lacking = [flat[k] for k in missing.tolist()]
            fresh = dict.fromkeys(lacking)
            by_length: dict[int, list[str]] = {}
            for w in fresh:
                if len(w) > GROUPED_LENGTH:
                    fresh[w] = self.add_long(w)
                else:
                    by_length.setdefault((len(w) + 3) // 4, []).append(w)
            for group in by_length.values():
                for k in range(0, len(group), 2048):
                    part = group[k : k + 2048]
                    fresh.update(zip(part, self.add_group(part).tolist(), strict=True))
            node[missing] = list(map(fresh.__getitem__, lacking))
            if len(known) + len(fresh) <= KEPT_WORDS:
                known.update(fresh)
                held = (self.size, self.nodes)
        left = np.fromiter(map(len, flat), np.int32, len(flat))
        row = np.repeat(np.arange(len(rows)), counts)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        salt = mix(np.array(keys, np.int64).view(np.uint64) * _BASE + np.uint64(seed))
        draws = mix(salt[row] + position.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        word, picked, where = np.arange(len(flat), dtype=np.int32), [], []
        steps = np.zeros(len(flat) + 1, np.int32)
        while len(word):
            draws = draws * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
            u = ((draws ^ (draws >> np.uint64(32))) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            edge = self.first[node]
            on = np.flatnonzero(self.share[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= u[on]]
            piece = self.ids[edge]
            picked.append(piece)
            where.append(word)
            step = self.length[np.maximum(piece, -1)]
            left -= step
            steps[word] += 1
            on = np.flatnonzero(left > 0)
            word, left, draws = word[on], left[on], draws[on]
            node = node[on] - step[on]
        self.size, self.nodes = held
        first = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(steps[:-1], out=first[1:])
        ids, last = np.empty(first[-1], np.int32), first[1:] - 1
        for k, (w, p) in enumerate(zip(where, picked, strict=True)):
            ids[last[w] - k] = p  # the walk ran backwards
        cuts = first[np.r_[0, np.cumsum(counts)]]
        out = []
        for r in range(len(rows)):
            part = ids[cuts[r] : cuts[r + 1]]
            if len(part) and part.min() < 0:
                part = np.array([j for i in part.tolist() for j in ([i] if i >= 0 else self.spelled(-1 - i))], np.int32)
            out.append(part)
        return out

    def spelled(self, code: int) -> list[int]:
        if code not in self.bytes_of:
            self.bytes_of[code] = [self.byte_ids[b] for b in chr(code).encode()]
        return self.bytes_of[code]

    def decode(self, ids: list[int]) -> str:
        """The text whose segmentation this is, exactly."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode()[1:]


def lattices(model_file: str, alpha: float) -> Lattices:
    key = (model_file, alpha)
    if key not in _CACHE:
        _CACHE[key] = Lattices(model_file, alpha)
    return _CACHE[key]


def encode(docs: DataFrame, model_file: str | None = None, seed: int = SEED, alpha: float = ALPHA, decoded: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every document, or with ``decoded=False`` without the last.

    ``round_trip`` tells that decoding the sampled ids gives back the whole text.  An empty or null text has no pieces
    and decodes to the empty text.  Repeated rows give equal results; a null id counts as 0 in the seed.
    """
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_file, alpha)
        for batch in batches:
            keys, rows = batch.column("doc_id"), batch.column("text")
            for first in range(0, batch.num_rows, 256):
                part = rows.slice(first, 256).to_pylist()
                own = keys.slice(first, 256)
                ids: list[np.ndarray] = []
                begin = size = 0
                for i, text in enumerate(part):  # bounds what one vectorised walk holds
                    size += len(text)
                    if size > 300_000 or i + 1 == len(part):
                        ids += model.encode(own.slice(begin, i + 1 - begin).fill_null(0).to_pylist(), part[begin : i + 1], seed)
                        begin, size = i + 1, 0
                n = np.array([len(x) for x in ids], np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat, pa.int32()))
                columns = [own, pa.array(n, pa.int32()), lists]
                if decoded:
                    columns.append(pa.array([model.decode(x.tolist()) == t for x, t in zip(ids, part, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "round_trip"][: len(columns)])

    return texts(docs).mapInArrow(run, "doc_id long, n_pieces int, ids array<int>" + ", round_trip boolean" * decoded)


def decode(pieces: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; null or empty ids give the empty text."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_file, ALPHA)
        for batch in batches:
            out = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
