"""SentencePiece encoding and decoding over distinct words in a shared-prefix trie.

A text becomes ``▁`` plus the text with spaces as ``▁``, cut before every run of marks and between Latin letters and
other characters: the model is read for pieces that cross such a cut, and with any the cut isn't made. Each task sorts the distinct marked words of its rows, which lays their trie out in depth-first order, and
runs the forward recursion once for every trie node: a word takes over the forward states of the prefix that
it shares with the word before and continues from there.

For a unigram model the forward state of a prefix is its best sum of scores, with the last piece of that path. The public model here is
a BPE model, whose segmentation is not the path of the best sum, so its state is the last piece of the prefix's segmentation: the one
piece that ends there and that its predecessor doesn't merge with otherwise. That gives the ids of the library, piece
for piece (tests compare them), and with a unigram model a path of the same sum, which is the library's unless several have it; characters without a piece fall back to their bytes. Models of other types are refused. What a
worker remembers of earlier words is bounded by number, and encoding and decoding are stages of their own, so that no executor
holds both codecs' workers at once.

Defined cases: a null text encodes to null and decodes to null; an empty text to no ids; a text that itself holds ``▁``
comes back with a space there, as with the library; an id outside the vocabulary decodes to nothing. Words of any
length are encoded in linear time. Tables need doc_id and text alone; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.llm.common import give_back, remembered, slices

MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Bounds of what a worker remembers (about 25 MB each): words of its latest batches, and piece pairs.
WORDS, PAIRS = 100_000, 200_000
#: The numbers of model types, and what a character without a piece costs below the worst piece.
UNIGRAM, BPE, UNKNOWN_PENALTY = 1, 2, 10.0


class Codec:
    """One model's pieces, with the recursion over prefixes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model.serialized_model_proto())
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"the model's type is {self.kind}: neither unigram nor BPE")
        del spec
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.scores = [model.get_score(i) for i in ids]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model holds a mark after a letter: its words can't be cut at marks")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        letters, others = f"[{LATIN}]+", f"[^{LATIN}{MARK}{alone}]+"
        cuts = [letters, others]
        if not all(re.fullmatch(f"{MARK}*(?:{letters}|{others})?", p) for p in self.ids):
            cuts = [f"[^{MARK}{alone}]+"]  # some piece mixes letters and others
        self.words = re.compile("|".join([f"{MARK}*{c}" for c in cuts] + [f"{MARK}+"] + ([f"[{alone}]"] if alone else [])))
        if self.kind == BPE:
            self.ids = {p: i for p, i in self.ids.items() if self.merge(p) == [i]}  # what merging never makes is never a piece
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.tails = {p[at:]: -1 for p in self.ids for at in range(len(p))} | self.ids  # ends of pieces; their ids where they are pieces
        raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.known: dict[str, bytes] = {}  # words of the latest batches
        self.before: dict[str, bytes] = {}  # and of those before
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int | str]:
        """Piece ids of a short text by repeated merging of the best pair; a character without a piece stays itself."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, p) for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are side by side; a = -1 (a character without a piece) merges with nothing."""
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def learn(self, words: set[str]) -> None:
        """Encode new words in trie order into ``known`` (int32 ids as bytes)."""
        step = self.best_sums if self.kind == UNIGRAM else self.last_pieces
        before, states, sums = "", [0], [0.0]  # states[i]: the last piece of the first i characters; sums[i]: their best sum
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :], sums[shared + 1 :]
            step(word, shared, states, sums)
            out, end = [], len(word)
            while end:
                k = states[end]
                if k < 0:
                    out.extend(self.byte_ids.get(b, 0) for b in reversed(word[end - 1].encode("utf-8", "replace")))
                    end -= 1
                else:
                    out.append(k)
                    end -= len(self.pieces[k])
            self.known[word] = np.array(out[::-1], np.int32).tobytes()
            before = word

    def last_pieces(self, word: str, shared: int, states: list[int], _: list[float]) -> None:
        """Forward states of a BPE model: the one piece at each end that its predecessor leaves as it is."""
        tail, known, follows = self.tails.get, self.pairs.get, self.follows
        for end in range(shared + 1, len(word) + 1):
            state = -1
            for start in range(end - 1, -1, -1):
                k = tail(word[start:end])
                if k is None:
                    break
                if k >= 0:
                    a = states[start] if start else -1
                    ok = a < 0 or known(a << 20 | k)
                    if follows(a, k) if ok is None else ok:
                        state = k
                        break
            states.append(state)

    def best_sums(self, word: str, shared: int, states: list[int], sums: list[float]) -> None:
        """Forward states of a unigram model: the best sum of scores up to each end, and its last piece."""
        tail, scores = self.tails.get, self.scores
        for end in range(shared + 1, len(word) + 1):
            state, best = -1, -math.inf if word[end - 1] in self.ids else sums[end - 1] + self.unknown
            for start in range(end - 1, -1, -1):
                k = tail(word[start:end])
                if k is None:
                    break
                if k >= 0 and sums[start] + scores[k] > best:
                    state, best = k, sums[start] + scores[k]
            states.append(state)
            sums.append(best)

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """int32 ids of each text, as bytes."""
        split = [None if t is None else self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        present = {w for words in split if words for w in words}
        if len(self.known) + len(present) > WORDS:  # what later batches didn't use goes
            self.before, self.known = self.known, {}
        old, known = self.before, self.known
        fresh = set()
        for w in present:
            if w not in known:
                if (ids := old.get(w)) is None:
                    fresh.add(w)
                else:
                    known[w] = ids
        self.learn(fresh)
        get = self.known.__getitem__
        return [None if words is None else b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> list[str]:
        """Texts of consecutive id runs that end at ``ends``."""
        out, at = [], 0
        ids = np.where((ids >= 0) & (ids < len(self.lengths)), ids, 0)
        for end in ends.tolist():
            chunks = []
            for a in range(at, end, step):
                part = ids[a : min(end, a + step)]
                n = self.lengths[part]
                last = np.cumsum(n)
                if len(last) and last[-1]:
                    chunks.append(self.flat[np.arange(last[-1]) + np.repeat(self.starts[part] - last + n, n)].tobytes())
            raw = b"".join(chunks)
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            at = end
        return out


_codecs: dict[str, Codec] = remembered.setdefault("sentencepiece", {})


def codec(path: str) -> Codec:
    """The worker's codec for the model at ``path``, read once until a task of another operator comes."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row. ``model``: path of the SentencePiece model on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, limit=1 << 20, owner="sentencepiece"):
            found = own.encode(batch.column("text").to_pylist())
            lengths = np.array([len(b or b"") // 4 for b in found], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(b or b"" for b in found), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([b is None for b in found] + [False])), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])
        own.known, own.before = {}, {}  # a worker that waits for its next task, of whatever stage, holds no words
        give_back("sentencepiece")

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column("ids")
                lengths = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()], np.int64)
                texts = own.decode(np.asarray(lists.flatten()).astype(np.int64), np.cumsum(lengths))
                texts = pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], names=["doc_id", "ids", "text"])
        give_back("sentencepiece")

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
