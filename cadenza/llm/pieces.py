"""SentencePiece segmentation sampled by forward filtering and backward sampling, and lossless decoding."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count as counter
from itertools import islice

import numpy as np
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as schema

from cadenza.llm.common import per_text, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Exponent of the piece probabilities: 0 samples all segmentations alike, large values the likeliest one.
SHARPNESS = 1.0
#: Characters a task segments at once; a longer text stands alone.
TEXT_CHARS = 600_000
#: Characters of distinct parts whose lattices a task keeps; beyond them it starts anew.
KEPT_CHARS = 3_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Kept:
    """Lattices of the distinct parts met so far, one after another; arrays grow by doubling."""

    def __init__(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(counter().__next__)
        self.points: list[int] = []
        self.spelled: dict[int, int] = {}
        self.held: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.chars = 0

    def add(self, begins, ends, first, from_, code, within, points, plain: int) -> None:
        """Append the lattices of further parts: their places and edges follow those there are."""
        for p in points.tolist():
            if p not in self.spelled:
                self.spelled[p] = len(self.points)
                self.points.append(p)
        if len(points):
            place = np.array([self.spelled[p] for p in points.tolist()], np.int32)
            code = np.where(code >= plain, plain + place[np.maximum(code - plain, 0) % len(place)], code)
        places, edges = (self.sizes[2], self.sizes[3]) if self.sizes else (0, 0)
        fresh = [begins + places, ends + places, first + edges, from_ + places, code, within]
        if not self.held:
            self.held, self.sizes = [x.copy() for x in fresh], [len(x) for x in fresh]
        else:
            for i, x in enumerate(fresh):
                need = self.sizes[i] + len(x)
                if need > len(self.held[i]):
                    grown = np.empty(max(need, 2 * len(self.held[i])), self.held[i].dtype)
                    grown[: self.sizes[i]] = self.held[i][: self.sizes[i]]
                    self.held[i] = grown
                self.held[i][self.sizes[i] : need] = x
                self.sizes[i] = need
        self.chars = self.sizes[2]

    def arrays(self) -> list[np.ndarray]:
        return [x[:n] for x, n in zip(self.held, self.sizes)]


class Pieces:
    """The pieces of a model: their texts, weights and hashes; built anew in each worker from the model's bytes."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        self.model, self.sharpness, self.ready = model, sharpness, False

    def __getstate__(self) -> dict:
        return {"model": self.model, "sharpness": self.sharpness, "ready": False}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state

    def load(self) -> Pieces:
        if self.ready:
            return self
        proto = schema.ModelProto()
        proto.ParseFromString(self.model)
        if len(sentencepiece.SentencePieceProcessor(model_proto=self.model)) != len(proto.pieces):
            raise ValueError("unreadable model")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can decode without loss")
        kinds = schema.ModelProto.SentencePiece
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.bytes_of = [b""] * len(proto.pieces)
        self.byte_ids = np.zeros(256, np.int64)
        texts: dict[str, int] = {}
        for i, piece in enumerate(proto.pieces):
            if piece.type == kinds.BYTE:
                value = int(piece.piece[3:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
                # a blank stands for the mark of the model, so that the mark itself is an ordinary character
                text = piece.piece.replace("▁", " ")
                texts[text], self.bytes_of[i] = i, text.encode()
        if not self.byte_ids.all():
            raise ValueError("a model without byte pieces can't decode without loss")
        if proto.trainer_spec.model_type == schema.TrainerSpec.UNIGRAM:
            weights = {t: proto.pieces[i].score for t, i in texts.items()}
        else:
            # merge ranks give no probabilities: pieces are taken to follow Zipf's law in the order of their ranks
            ranked = sorted(texts, key=lambda t: (-proto.pieces[texts[t]].score, texts[t]))
            total = np.log(np.arange(2, len(ranked) + 2).astype(float) ** -1).max() + np.log((1 / np.arange(2.0, len(ranked) + 2)).sum())
            weights = {t: -np.log(r + 2.0) - total for r, t in enumerate(ranked)}
        self.least = min(weights.values())
        self.longest = max(map(len, texts))
        hashes = np.array([self._hash(t) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.fromiter(texts.values(), np.int64, len(texts))[order]
        self.weights = np.fromiter((weights[t] for t in texts), float, len(texts))[order] * self.sharpness
        self.least *= self.sharpness
        # where the hashes with the same 20 leading bits begin; pieces that share them follow one another
        lead = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[lead[::-1]] = np.arange(len(lead), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(lead).max())
        # no piece runs over such a place, so the lattice falls apart there and its parts are sampled on their own
        crossing = [t for t in texts if re.search(r"[^ ] |\n.|.\n", t, re.S)]
        self.parts = re.compile(r" *[^ \n]+|\n| +" if not crossing else r"(?s).+")
        self.kept = _Kept()
        self.ready = True
        return self

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_A) + ord(c) + 1) % (1 << 64)
        return int(_mix(np.array([h], np.uint64))[0])

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        """The text of a segmentation; null for null."""
        if ids is None:
            return None
        self.load()
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        raw = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return raw[1:] if self.prefix and raw else raw

    def sample(self, texts: list[str | None], seeds: list[int]) -> list[np.ndarray | None]:
        """Piece ids of a random segmentation of each text, drawn by its probability given the text.

        Forward filtering sums over all segmentations up to each place of the lattice, backward sampling then
        draws pieces from the end by the share of the sum that came through them.  The draws depend on
        (seed, part, step) alone.  Null gives null, an empty text no piece.
        """
        self.load()
        if self.kept.chars > KEPT_CHARS:
            self.kept = _Kept()
        known, held = self.kept.number, len(self.kept.number)
        word, lengths = [], []
        for text in texts:
            parts = self.parts.findall(f" {text}" if self.prefix else text) if text else []
            word.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
            lengths.append(len(parts))
        if not sum(lengths):
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        if len(known) > held:
            self.kept.add(*self._lattice(list(islice(known, held, None))), len(self.bytes_of))
        owner = np.repeat(np.arange(len(texts)), lengths)
        word = np.concatenate(word)
        ordinal = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seed = np.array([(s or 0) % (1 << 64) for s in seeds], np.uint64)[owner]
        stream = _mix(seed * _A + ordinal.astype(np.uint64) + np.uint64(1))
        return self._backward(texts, owner, word, stream)

    def _lattice(self, parts: list[str]):
        """Edges of the lattices of all parts, sorted by where they end, with the chance that a path came through them."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # places: one more than characters in each part
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        part = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(len(chars))
        stop = np.cumsum(sizes)[part]
        h, letters = np.zeros(len(chars), np.uint64), (chars + 1).astype(np.uint64)
        live = at
        edge_from, edge_len, edge_code, edge_weight = [], [], [], []
        for n in range(1, self.longest + 1):
            fits = live + n <= stop
            live, stop, h = live[fits], stop[fits], h[fits]
            if not len(live):
                break
            h = h * _A + letters[live + (n - 1)]
            hit, place = self._known(live, _mix(h))
            edge_from.append(hit)
            edge_len.append(np.full(len(hit), n))
            edge_code.append(self.ids[place])
            edge_weight.append(self.weights[place])
            if n == 1:
                # characters that are no piece are spelled in bytes
                known = np.zeros(len(chars), bool)
                known[hit] = True
                rest = live[~known[live]]
                points = chars[rest]
                spelled = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                edge_from.append(rest)
                edge_len.append(np.ones(len(rest), np.int64))
                edge_code.append(-1 - points)
                edge_weight.append(self.least * spelled)
        # longest pieces first: they are the likeliest, and a draw mostly ends at the first edge it looks at
        start = np.concatenate(edge_from[::-1])
        from_ = (start + part[start]).astype(np.int32)
        to = from_ + np.concatenate(edge_len[::-1]).astype(np.int32)
        order = np.argsort(to, kind="stable")
        from_, to, start = from_[order], to[order], start[order]
        code, weight = np.concatenate(edge_code[::-1])[order], np.concatenate(edge_weight[::-1])[order]
        local = to - begins[part[start]]
        # place after place, all parts at once
        order = np.argsort(local.astype(np.uint16) if local.max() < 1 << 16 else local, kind="stable")
        from_2, to_2, weight_2, local = from_[order], to[order], weight[order], local[order]
        total = np.zeros(len(chars) + len(parts))
        cuts = np.searchsorted(local, np.arange(1, local[-1] + 2))
        for low, high in zip(cuts[:-1], cuts[1:]):
            value = total[from_2[low:high]] + weight_2[low:high]
            heads = np.flatnonzero(np.concatenate(([True], to_2[low + 1 : high] != to_2[low : high - 1])))
            top = np.maximum.reduceat(value, heads)
            each = np.diff(np.append(heads, high - low))
            total[to_2[low:high][heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, each)), heads))
        del from_2, to_2, weight_2, local, order, start
        chance = np.exp(total[from_] + weight - total[to])
        # running sums of the chances at each place, added up place by place so that they don't depend on other parts
        heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        many = np.diff(np.append(heads, len(to)))
        within, live, step = chance, heads[many > 1], 1
        left = many[many > 1]
        while len(live):
            within[live + step] += within[live + step - 1]
            step += 1
            live = live[left > step]
            left = left[left > step]
        within[heads + many - 1] = 1.0
        first = np.zeros(len(chars) + len(parts), np.int32)
        first[to[heads]] = heads
        # spelled characters follow the pieces
        spelled, back = np.unique(code[code < 0], return_inverse=True)
        code[code < 0] = len(self.bytes_of) + back
        return begins, ends, first, from_, code.astype(np.int32), within, -1 - spelled

    def _known(self, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose hash is that of a piece, and the piece."""
        slot = self.first[hashes >> np.uint64(44)]
        maybe = slot >= 0
        places, hashes, slot = places[maybe], hashes[maybe], slot[maybe]
        right = self.hashes[slot] == hashes
        found = [(places[right], slot[right])]
        for _ in range(self.crowd - 1):
            places, hashes, slot = places[~right], hashes[~right], slot[~right] + 1
            slot = np.minimum(slot, len(self.hashes) - 1)
            right = self.hashes[slot] == hashes
            found.append((places[right], slot[right]))
        hit, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hit, kind="stable")
        return hit[order], place[order]

    def _backward(self, texts, owner, word, stream) -> list[np.ndarray | None]:
        begins, ends, first, from_, code, within = self.kept.arrays()
        points = self.kept.points
        cursor, live, step = ends[word], np.arange(len(word)), 0
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(word), np.int64)
        while len(live):
            u = (_mix(stream[live] + np.uint64(step * int(_B) % (1 << 64))) >> np.uint64(12)).astype(float) * 2.0**-52
            edge = first[cursor[live]]
            late = np.flatnonzero(u >= within[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= within[edge[late]]]
            drawn.append((live, edge))
            count[live] += 1
            cursor[live] = from_[edge]
            live = live[cursor[live] > begins[word[live]]]
            step += 1
        offset = np.cumsum(count) - count
        path = np.empty(count.sum(), np.int64)
        for s, (who, edge) in enumerate(drawn):
            path[offset[who] + count[who] - 1 - s] = code[edge]
        # spelled characters give as many ids as they have bytes
        plain = len(self.bytes_of)
        size, wide = np.ones(plain + len(points), np.int64), np.zeros((plain + len(points), 4), np.int32)
        wide[:plain, 0] = np.arange(plain)
        for i, point in enumerate(points, plain):
            spelled = self.byte_ids[list(chr(point).encode("utf-8", "surrogatepass"))]
            size[i] = len(spelled)
            wide[i, : len(spelled)] = spelled
        lengths = size[path]
        ids = wide[np.repeat(path, lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]
        per_row = np.bincount(np.repeat(owner, count), lengths, len(texts)).astype(np.int64)
        split = np.split(ids, np.cumsum(per_row)[:-1])
        return [None if t is None else s for t, s in zip(texts, split)]


def load(model: str = MODEL, sharpness: float = SHARPNESS) -> Pieces:
    with open(model, "rb") as f:
        return Pieces(f.read(), sharpness)


def encode(text: Column, key: Column, pieces: Pieces) -> Column:
    """Array of piece ids of a segmentation sampled for the row key: the same for the same key and text everywhere."""

    def run(texts: list, seeds: list) -> list:
        return [(ids,) for ids in pieces.sample(texts, seeds)]

    return per_text("ids array<int>", run, text, F.xxhash64(key), rows=1 << 16, chars=TEXT_CHARS).ids


def encode_checked(text: Column, key: Column, pieces: Pieces) -> Column:
    """``struct(ids, lossless)``: as ``encode``, each segmentation decoded again and compared with its text."""

    def run(texts: list, seeds: list) -> list:
        return [(ids, pieces.decode(ids) == t) for t, ids in zip(texts, pieces.sample(texts, seeds))]

    return per_text("ids array<int>, lossless boolean", run, text, F.xxhash64(key), rows=1 << 16, chars=TEXT_CHARS)


def decode(ids: Column, pieces: Pieces) -> Column:
    def run(rows: list) -> list:
        return [(pieces.decode(r),) for r in rows]

    return per_text("text string", run, ids).text


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_checked(F.col("text"), F.col("doc_id"), load())
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("_c")).select(
        "doc_id", "_c.ids", F.size("_c.ids").alias("n_pieces"), "_c.lossless")
