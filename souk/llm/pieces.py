"""Operator 6: SentencePiece encoding and decoding.

The pieces of a SentencePiece model (a parameter; nothing is trained) are put
into an Aho-Corasick automaton.  A text is read once: at each character the
automaton's state and its output links name all pieces that end there, each
relaxes the best score of that position, and the best path is read backwards.

The scores of a merge model's pieces are the negative ranks of its merges, which
say nothing of a sum of pieces.  A piece's score is therefore the logarithm of a
Zipf-Mandelbrot law over the rank, 1 / (rank + ``RANK_SHIFT``): a rule, nothing is
trained.  The ids are those of the best path under that law; merging step by step
gives the same ids for about five of six running words.

Characters that no piece covers become byte pieces, so decoding gives back
every text exactly.

Pieces cannot run across the start of a run of spaces, so the words between
such places are encoded one by one, with a bounded memory of those seen.

Defined results: a null text gives no ids (an empty list) and decodes to the
empty text, as an empty one does.  Equal scores go to the longer last piece.
One row per input row; repeated rows repeat their result; other input columns
are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import table, tidy

#: The model file of the production query (a parameter of ``load``).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The law of the pieces' ranks; None takes the model's scores as they are (log probabilities).
RANK_SHIFT = 100.0
#: Words remembered per task, in each of two generations (about 250 bytes each).
REMEMBERED = 100_000
#: Score of a character that no piece covers, below the lowest piece.
UNKNOWN_PENALTY = 10.0
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Model:
    #: Text of a piece (with a plain space for the space mark) -> (id, score).
    pieces: dict[str, tuple[int, float]]
    #: Ids of the 256 byte pieces.
    byte_ids: tuple[int, ...]
    #: What each id stands for, as UTF-8.
    surface: tuple[bytes, ...] = field(repr=False)


def load(path: str = MODEL, rank_shift: float | None = RANK_SHIFT) -> Model:
    """Reads a model file on the driver; the pieces travel to the tasks."""
    import sentencepiece

    def law(score: float) -> float:
        return score if rank_shift is None else -math.log(rank_shift - score)

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, surface = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:-1], 16)
            byte_ids[value] = i
            surface.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            plain = piece.replace(SPACE_MARK, " ")
            pieces[plain] = (i, law(sp.get_score(i)))
            surface.append(plain.encode())
    return Model(pieces, tuple(byte_ids), tuple(surface))


class Encoder:
    """The automaton and the single-pass Viterbi search."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.unknown = min((s for _, s in model.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.next: list[dict[str, int]] = [{}]
        self.length, self.score, self.piece = [0], [0.0], [-1]
        for text, (i, score) in model.pieces.items():
            node = 0
            for ch in text:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.length.append(self.length[node] + 1)
                    self.score.append(0.0)
                    self.piece.append(-1)
                node = child
            self.piece[node], self.score[node] = i, score
        self.fail = [0] * len(self.next)
        #: The pieces that end at a node, longest first, as (length, score, id): its own,
        #: then those of its output link, the next shorter suffix that is a piece.
        self.ends: list[tuple] = [()] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for ch, child in self.next[node].items():
                f = self.fail[node]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[child] = self.next[f].get(ch, 0)
                queue.append(child)
            own = ((self.length[node], self.score[node], self.piece[node]),) if self.piece[node] >= 0 else ()
            self.ends[node] = own + self.ends[self.fail[node]]
        self.moves: list[dict[str, int]] = [dict(children) for children in self.next]  # with failures followed
        # words can be cut out only if no piece has a space after another character, or a line end
        apart = all(" " not in t.lstrip(" ") and "\n" not in t for t in model.pieces)
        self.cut = re.compile(r"\n| *[^ \n]+| +").findall if apart else lambda t: [t] if t else []
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def follow(self, node: int, ch: str) -> int:
        """Where ``ch`` leads from ``node`` by its failure links; remembered for characters of pieces."""
        at = node
        while at and ch not in self.next[at]:
            at = self.fail[at]
        found = self.next[at].get(ch, 0)
        if found:
            self.moves[node][ch] = found
        return found

    def best_path(self, text: str) -> list[int]:
        """Ids of the highest-scoring segmentation of ``text``."""
        moves, ends, unknown = self.moves, self.ends, self.unknown
        best, came = [0.0], [None]  # best score and the last piece (None: a bare character)
        node = 0
        for at, ch in enumerate(text, 1):
            after = moves[node].get(ch)
            node = self.follow(node, ch) if after is None else after
            top, how = best[-1] + unknown, None
            for end in ends[node]:
                s = best[at - end[0]] + end[1]
                if s > top:
                    top, how = s, end
            best.append(top)
            came.append(how)
        ids: list[int] = []
        at = len(text)
        while at:
            how = came[at]
            if how:
                ids.append(how[2])
                at -= how[0]
            else:
                ids += [self.model.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; a space is put before it, as the model's pieces expect."""
        if not text:
            return np.empty(0, np.int32)
        known, older, parts = self.known, self.older, []
        for word in self.cut(" " + text):
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    ids = array("i", self.best_path(word)).tobytes()
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:  # words not met again for so long are forgotten
                        known, older = {}, known
                        self.known, self.older = known, older
                    known[word] = ids
            parts.append(ids)
        return np.frombuffer(b"".join(parts), np.int32)


def decode_ids(model: Model, ids) -> str:
    surface = model.surface
    data = b"".join([surface[i] for i in ids])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (decoding gives the text) of every row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [t.as_py() or "" for t in batch.column("text")]
                ids = [encoder.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                same = [decode_ids(model, x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), values),
                     pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, token_ids); null ids give the empty text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(model, x.as_py() or ()) for x in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(
        tidy(run), "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's token ids, decoded again as a check."""
    return encode(table(spark, sf_dir, "documents"), load())
