"""Language-model scores by a subword lattice: every segmentation of a text into pieces of an existing vocabulary counts.

A text is its words (ASCII letters in lower case), each behind the vocabulary's white-space marker, then one end. No
piece crosses a marker, so a text's probability is the product of its words' and the end's, and a word's is the sum
over all its segmentations of the product of its pieces' probabilities: a forward recursion in log space over the
arcs that a trie of the pieces finds. Each of the 256 bytes is a piece too, so every text has a probability.

1. Slices (slices.py): texts are read once; a word meets the corpus once a slice.
2. The words' counts in the training documents are summed; they give the base score, and train the pieces.
3. The file's scores are the starting weights. Byte-pair files score a piece by minus its rank of merging, which is read as a
   Zipf law, p ~ 1 / (2 + rank); log probabilities (a unigram file) are taken as they are. ROUNDS rounds of expectation
   maximisation over the distinct words (forward and backward, expected uses times counts) fit them to the training
   documents, with the file's weights as prior (PRIOR pseudo uses a piece). The vocabulary itself stays as it is.
4. Each distinct word is scored once; scores return to the slices by number, and are summed by document.

The driver holds the vocabulary's weights only. Defined results: null is the empty text, which is one end; texts of
any length are scored whole; repeated rows are scored (and trained on) each; with no training documents N and V are 0, the
base score of a token is log10(0.5 / 0.5) and the file's weights stand alone; an empty table gives an empty table;
extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import slices
from .common import free_name, written

MARK = "▁".encode()
ROUNDS = 2
PRIOR = 1.0
#: Positions times words of one forward pass.
CELLS = 1 << 20

FIELDS = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def words_of(text: bytes) -> list[bytes]:
    """Bytes know ASCII white space and ASCII letters only."""
    return text.lower().split()


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece file as bytes, each of the 256 bytes among them, and their starting weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    size = model.get_piece_size()
    real = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) and model.get_score(i) > -1e8]
    ranks = bool(real) and all(float(model.get_score(i)).is_integer() for i in real)
    for i in real:
        score = model.get_score(i)
        found[model.id_to_piece(i).encode()] = 1 / (2 - score) if ranks else math.exp(score)
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    return list(found), np.array(list(found.values()))


class Lattice:
    """A trie over pieces with their log probabilities; the number after the last piece is the end's."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.size = len(pieces)
        nodes: dict[int, int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(pieces):
            state = 0
            for b in piece:
                state = nodes.setdefault(state << 8 | b, len(nodes) + 1)
            ends[state] = number
        keys = np.array(sorted(nodes), dtype=np.int64)
        self.keys, self.child = keys, np.array([nodes[k] for k in keys.tolist()], dtype=np.int64)
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.first = np.zeros(256, dtype=np.int64)
        top = keys < 256
        self.first[keys[top]] = self.child[top]
        self.depth = max(map(len, pieces))
        self.prior = np.append(weights / weights.sum(), 1 / self.size)
        self.prior /= self.prior.sum()
        self.set(self.prior)

    def set(self, p: np.ndarray) -> None:
        self.log = np.append(np.log(p), -np.inf)  # the last is what no piece (-1) has

    def learn(self, uses: np.ndarray) -> None:
        """Weights from expected uses, the end's last, with the file's as prior."""
        mass = uses + self.prior * (PRIOR * len(uses))
        self.set(mass / mass.sum())

    def arcs(self, data: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the piece of that length at every place, or -1; room: bytes up to the word's end."""
        out = []
        alive = np.arange(len(data))
        state = np.zeros(0, dtype=np.int64)
        for length in range(1, self.depth + 1):
            if length == 1:
                state = self.first[data]
            else:
                fits = room[alive] >= length
                alive, state = alive[fits], state[fits]
                key = state << 8 | data[alive + length - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                alive, state = alive[hit], self.child[at[hit]]
            if not len(alive):
                break
            ids = np.full(len(data), -1, dtype=np.int32)
            ids[alive] = self.piece[state]
            out.append(ids)
        return out

    def pass_over(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word behind its marker; with counts also the expected uses of every piece."""
        out = np.zeros(len(words))
        uses = np.zeros(self.size) if counts is not None else None
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(MARK)
        order = np.argsort(-sizes, kind="stable")
        start = 0
        while start < len(order):
            stop = min(len(order), start + max(1, CELLS // int(sizes[order[start]])))
            these = order[start:stop]
            out[these] = self._block([words[i] for i in these.tolist()], sizes[these], None if counts is None else counts[these], uses)
            start = stop
        return out, uses

    def _block(self, words: list[bytes], sizes: np.ndarray, counts: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        """Words by falling length: those still running at a place are the first ones."""
        data = np.frombuffer(MARK + MARK.join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        room = np.repeat(begin + sizes, sizes) - np.arange(len(data))
        arcs, longest, n = self.arcs(data, room), int(sizes[0]), len(words)
        running = np.searchsorted(-sizes, -np.arange(longest + 1), side="right")  # words of at least so many bytes
        ahead = np.full((longest + 1, n), -np.inf)
        ahead[0] = 0
        for end in range(1, longest + 1):
            m = running[end]
            total = ahead[end, :m]
            for length in range(1, min(end, len(arcs)) + 1):
                ids = arcs[length - 1][begin[:m] + (end - length)]
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    total[at] = np.logaddexp(total[at], ahead[end - length, at] + self.log[ids[at]])
        whole = ahead[sizes, np.arange(n)]
        if counts is not None:
            back = np.full((longest + 1, n), -np.inf)
            back[sizes, np.arange(n)] = 0
            for place in range(longest - 1, -1, -1):
                m = running[place + 1]
                total = back[place, :m]
                for length in range(1, min(longest - place, len(arcs)) + 1):
                    ids = arcs[length - 1][begin[:m] + place]
                    at = np.flatnonzero(ids >= 0)
                    if len(at):
                        rest = self.log[ids[at]] + back[place + length, at]
                        total[at] = np.logaddexp(total[at], rest)
                        uses += np.bincount(ids[at], np.exp(ahead[place, at] + rest - whole[at]) * counts[at], self.size)
        return whole


def expected_uses(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Of every piece, over words (word, c): a row a piece and task, summed by Spark; the driver gets one a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(lattice.size)
        for b in batches:
            if b.num_rows:
                uses += lattice.pass_over(b.column("word").to_pylist(), b.column("c").to_numpy().astype(float))[1]
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(uses[at])], names=["piece", "uses"])

    out = np.zeros(lattice.size)
    for r in words.select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses")).collect():
        out[r[0]] = r[1]
    return out


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Lattice:
    """The lattice of a vocabulary file, fitted to words (word, c > 0) and the number of texts' ends."""
    lattice = Lattice(*vocabulary(path))
    if ends:
        for _ in range(rounds):
            lattice.learn(np.append(expected_uses(words, lattice), float(ends)))
    return lattice


def with_log(words: DataFrame, lattice: Lattice) -> DataFrame:
    """words (word, c) with the log probability of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, _ = lattice.pass_over(b.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(found)], names=["word", "c", "log"])

    return words.select("word", "c").mapInArrow(run, "word binary, c bigint, log double")


def score_texts(docs: DataFrame, path: str, training: str, keep: list[str] | None = None, text: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, str]:
    """docs with a struct (FIELDS) of the scores; also the struct's name. training: SQL condition of the documents to learn from."""
    keep = docs.columns if keep is None else keep
    table = slices.slices(docs, keep, words_of, "lm-slices", text, f"coalesce({training}, false)")
    asked = slices.asked(table)
    words = written(asked.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    ends = table.agg(F.sum("ends")).head()[0] or 0
    known, tokens = words.filter("c > 0").agg(F.count(F.lit(1)), F.sum("c")).head()
    tokens, known = (tokens or 0) + ends, known + bool(ends)
    lattice = fit(words.filter("c > 0"), ends, path, rounds)
    scored = asked.select("slice", "at", "word").join(with_log(words, lattice), "word")
    found = table.select("slice", "docs", "lengths", "tokens").join(slices.answered(scored, ["c", "log"]), "slice", "left")
    name = free_name(docs.select(*keep), "lm")
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields]).add(name, T.StructType.fromDDL(FIELDS))
    floor = math.log10(tokens + 0.5 * (known + 1))
    end_base, end_log = math.log10(ends + 0.5) - floor, float(lattice.log[lattice.size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                every, lengths, index, at, c, log = (batch.column(x)[k] for x in ("docs", "lengths", "tokens", "at", "c", "log"))
                sizes = lengths.values.to_numpy()
                index = slices.unpacked(index.as_py())
                count, total = np.zeros(0, dtype=np.int64), np.zeros(0)
                if at.is_valid:
                    place = at.values.to_numpy()
                    count, total = np.zeros(len(place), dtype=np.int64), np.zeros(len(place))
                    count[place], total[place] = c.values.to_numpy(), log.values.to_numpy()
                n_known, base, score = (by_text(x[index], sizes) for x in (count > 0, np.log10(count + 0.5) - floor, total))
                got = [pa.array(sizes + 1), pa.array(n_known.astype(np.int64) + int(ends > 0)), pa.array(np.full(len(sizes), tokens, dtype=np.int64)), pa.array(base + end_base), pa.array((score + end_log) / math.log(10))]
                struct = pa.StructArray.from_arrays(got, names=[x.split()[0] for x in FIELDS.split(", ")])
                values = every.values
                yield pa.RecordBatch.from_arrays([*(values.field(i) for i in range(values.type.num_fields)), struct], names=schema.names)

    return found.mapInArrow(run, schema), name


def by_text(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs; an empty run is 0."""
    out = np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(x.astype(float), (np.cumsum(sizes) - sizes)[full])
    return out
