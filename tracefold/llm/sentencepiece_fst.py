"""SentencePiece encoding and decoding by weighted transducers.

A model is compiled once into machines that are composed with each input:

* the normaliser, a transducer over characters: blanks to the piece alphabet's blank
  mark, dummy prefix, extra blanks;
* the lexicon, a transducer from marked characters to pieces: a trie whose states at
  the end of a piece have an arc back to the start that writes the piece, and, for
  characters that are no piece, arcs that write their bytes;
* the acceptor of piece sequences. For unigram models it takes all, and the pieces
  carry their negated scores as weights. For BPE models the weights are zero and its
  states are the piece read last: merging in order of score is no sum of weights, but
  its result is local, since a segmentation is the one that BPE makes if and only if it
  makes every pair of neighbours from their joint string. Only such pairs have an arc.
  There are too many pairs to list, so arcs are made when they are first asked for.

Encoding composes input, normaliser, lexicon and acceptor, state by state as the search
needs them, and takes the shortest path in the tropical semiring. Where no piece has a
blank after another character, the lexicon is in its start state before each run of
blanks, so the words of a text are composed on their own and paths of recent words are
kept.

Encoding gives what the sentencepiece library gives for the same model file. NULL and
empty texts have no ids; decoding NULL or no ids gives the empty text. Decoding
restores a text unless it held the blank mark itself or the model drops blanks or
characters. Models with a character map or user-defined symbols are refused. Other
columns pass through; a column that has the name of an added one, `ids` or `decoded`,
is replaced. Tasks keep machines by the content of their model.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Model file, read by the driver; the setting `tracefold.sentencepiece.model` names another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SETTING = "tracefold.sentencepiece.model"
MARK = "▁"
_WORDS = 600_000  # paths kept, twice: recent ones and those before
_PAIRS = 600_000
_LONGEST = 64  # of a word whose path is kept
_MACHINES_KEPT = 2
_BATCH = 4 << 20  # bytes of text handled at once
_UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    """What a model file holds, without the library: it travels to the tasks."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 5 unused, 6 byte
    bpe: bool
    byte_fallback: bool = True
    dummy_prefix: bool = True
    trim: bool = False

    @staticmethod
    def read(path: str = MODEL) -> Model:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = [p.type for p in proto.pieces]
        if proto.normalizer_spec.precompiled_charsmap or 4 in kinds or proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only BPE and unigram models without character map and user-defined symbols")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("blanks as suffixes are not supported")
        return Model(
            [p.piece for p in proto.pieces],
            [p.score for p in proto.pieces],
            kinds,
            proto.trainer_spec.model_type == 2,
            proto.trainer_spec.byte_fallback,
            proto.normalizer_spec.add_dummy_prefix,
            proto.normalizer_spec.remove_extra_whitespaces,
        )

    def digest(self) -> str:
        """The same for models of equal content, another for any other."""
        parts = (self.pieces, self.scores, self.kinds, self.bpe, self.byte_fallback, self.dummy_prefix, self.trim)
        return hashlib.sha256(repr(parts).encode("utf-8", "surrogatepass")).hexdigest()


# --- machines ----------------------------------------------------------------------


class Normaliser:
    """A transducer over characters. An arc writes a string; `others` are the arcs of all characters
    that have none of their own in a state, which write a string and then the character read."""

    BEGIN, INSIDE, PENDING = range(3)

    def __init__(self, dummy_prefix: bool, trim: bool):
        first = MARK if dummy_prefix else ""
        self.arcs: dict[tuple[int, str], tuple[str, int]] = {}
        self.others = {self.BEGIN: (first, self.INSIDE), self.INSIDE: ("", self.INSIDE)}
        if trim:  # blanks are written when something follows them
            self.arcs[self.BEGIN, " "] = ("", self.BEGIN)
            self.arcs[self.INSIDE, " "] = ("", self.PENDING)
            self.arcs[self.PENDING, " "] = ("", self.PENDING)
            self.others[self.PENDING] = (MARK, self.INSIDE)
        else:
            self.arcs[self.BEGIN, " "] = (first + MARK, self.INSIDE)
            self.arcs[self.INSIDE, " "] = (MARK, self.INSIDE)
        #: Whether one symbol leads to INSIDE from anywhere.
        self.settles = not trim
        self.loop = re.compile("[^ ]+")  # characters that INSIDE copies and stays

    def compose(self, string: str, state: int = BEGIN) -> tuple[str, int]:
        """What the machine writes for `string` from `state`, and the state it ends in."""
        out, at, n = [], 0, len(string)
        while at < n:
            run = self.loop.match(string, at) if state == self.INSIDE else None
            if run:
                out.append(run[0])
                at = run.end()
                continue
            char = string[at]
            at += 1
            arc = self.arcs.get((state, char))
            if arc is None:
                written, state = self.others[state]
                out.append(written + char)
            else:
                out.append(arc[0])
                state = arc[1]
        return "".join(out), state


class Lexicon:
    """The transducer from marked characters to pieces.

    A state is (piece on its arc back to the start, -1 for none; that arc's weight; its
    arcs by character).
    """

    def __init__(self, pieces: dict[str, int], weights: dict[int, float]):
        self.start: dict[str, list] = {}
        self.weighted = bool(weights)
        for piece, number in pieces.items():
            arcs, state = self.start, None
            for char in piece:
                state = arcs.setdefault(char, [-1, 0.0, {}])
                arcs = state[2]
            if state is not None:
                state[0], state[1] = number, weights.get(number, 0.0)


#: Symbols from here on are characters that are no piece, by code point.
_CHARACTER = 1 << 24
_START = 1 << 25
_BITS = 26


class Lattice:
    """Lexicon after a string of labels: states are places in it, an arc reads a whole piece and writes its number.

    A label that is no piece has an arc that writes a symbol of its own, spelled out at the end.
    """

    def __init__(self, labels: str, lexicon: Lexicon, unknown: float):
        self.labels, self.lexicon, self.unknown = labels, lexicon, unknown

    def arcs(self, at: int) -> list[tuple[float, int, int]]:
        """(weight, minus next state, output), the lightest and then the longest last."""
        labels, n, end = self.labels, len(self.labels), at
        state = self.lexicon.start.get(labels[at])
        out = [(self.unknown, -1 - at, _CHARACTER + ord(labels[at]))] if state is None or state[0] < 0 else []
        while state is not None:
            end += 1
            piece, weight, arcs = state
            if piece >= 0:
                out.append((weight, -end, piece))
            if end == n:
                break
            state = arcs.get(labels[end])
        if self.lexicon.weighted:
            out.sort(reverse=True)
        return out


class AllPieces(dict):
    """The acceptor of every sequence, by state and symbol (state << _BITS | symbol)."""

    start = 0

    def __missing__(self, key: int) -> int | None:
        return 0


class MergedPairs(dict):
    """The acceptor of BPE's segmentations: its states are the piece read last, its arcs are made when asked for.

    A dict of arcs from state and symbol (state << _BITS | symbol) to a state, None for no arc.
    """

    start = _START

    def __init__(self, pieces: dict[str, int], scores: list[float]):
        by_score = sorted((p for p in pieces if len(p) > 1), key=lambda p: (-scores[pieces[p]], pieces[p]))
        self.rank = {p: r for r, p in enumerate(by_score, 1)}  # 1 merges first
        self.string = {i: p for p, i in pieces.items()}
        self.last: dict[str, tuple[str, str] | None] = {}

    def __missing__(self, key: int) -> int | None:
        state, symbol = key >> _BITS, key & (1 << _BITS) - 1
        if state >= _CHARACTER or symbol >= _CHARACTER:  # at the start, or next to a character that takes part in no merge
            return symbol
        if len(self) >= _PAIRS:
            self.clear()
        following = self[key] = symbol if self.neighbours(self.string[state], self.string[symbol]) else None
        return following

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b in order of score ends in a, b.

        Undo the merges at the border, latest first; none across it may have come before
        the one undone. Equal merges happen from left to right, so one on the left goes first.
        """
        rank, limit = self.rank, len(self.rank) + 1
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            before, after = rank.get(a, 0) if len(a) > 1 else 0, rank.get(b, 0) if len(b) > 1 else 0
            if not before and not after:
                return True
            if before > after:
                limit, a = before, self.halves(a)[1]
            else:
                limit, b = after + 1, self.halves(b)[0]

    def makes(self, piece: str) -> bool:
        """Whether merging a piece's characters gives the piece at all."""
        return len(piece) == 1 or self.halves(piece) is not None

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of the last merge."""
        if piece not in self.last:
            self.last[piece] = None
            parts = list(piece)
            while len(parts) > 1:
                ranked = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1]))]
                if not ranked:
                    break
                k = min(ranked)[1]
                if len(parts) == 2:
                    self.last[piece] = (parts[0], parts[1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.last[piece]


class Composition:
    """A lattice followed by an acceptor of what it writes: states are pairs (place, acceptor's state)."""

    def __init__(self, lattice: Lattice, acceptor: AllPieces | MergedPairs):
        self.arcs, self.accepts = lattice.arcs, acceptor
        self.start, self.end = acceptor.start, len(lattice.labels)


def shortest_path(machine: Composition) -> list[int]:
    """Outputs on a path of least weight (none is negative); among equal weights the arc that goes farthest is first.

    States and their arcs are made as the search reaches them. The queue holds one
    entry for each open state, its next arc: lighter arcs of a state come first, so
    no later one can be needed before it.
    """
    arcs_of, accepts, end = machine.arcs, machine.accepts, machine.end
    order, settled, heap = 0, set(), []
    arcs = arcs_of(0)
    entry = (arcs[-1][0], arcs[-1][1], 0, arcs, 0.0, machine.start, None)
    while entry is not None:
        total, minus, _, arcs, cost, last, path = entry
        output = arcs.pop()[2]
        if arcs:
            order += 1
            weight, further, _ = arcs[-1]
            heapq.heappush(heap, (cost + weight, further, order, arcs, cost, last, path))
        following = accepts[last << _BITS | output]
        if following is None or (minus, following) in settled:
            entry = heapq.heappop(heap) if heap else None
            continue
        settled.add((minus, following))
        path = (path, output)
        if -minus == end:
            out = []
            while path is not None:
                path, output = path
                out.append(output)
            return out[::-1]
        arcs = arcs_of(-minus)
        order += 1
        weight, further, _ = arcs[-1]
        entry = heapq.heappushpop(heap, (total + weight, further, order, arcs, total, following, path))
    raise ValueError("no path")  # cannot be: single characters always have one


class Machine:
    """The machines of a model, and what recent words came to."""

    def __init__(self, model: Model):
        self.model = model
        self.output = [self._written(p, k) for p, k in zip(model.pieces, model.kinds)]
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @cached_property
    def normaliser(self) -> Normaliser:
        return Normaliser(self.model.dummy_prefix, self.model.trim)

    @cached_property
    def pieces(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.model.pieces, self.model.kinds)) if k == 1}

    @cached_property
    def acceptor(self) -> AllPieces | MergedPairs:
        return MergedPairs(self.pieces, self.model.scores) if self.model.bpe else AllPieces()

    @cached_property
    def lexicon(self) -> Lexicon:
        if self.model.bpe:
            return Lexicon({p: i for p, i in self.pieces.items() if self.acceptor.makes(p)}, {})
        scores = self.model.scores
        return Lexicon(self.pieces, {i: self.lift * len(p) - scores[i] for p, i in self.pieces.items()})

    @cached_property
    def lift(self) -> float:
        """Added for each character, the same for all paths, so that no weight is negative."""
        return max([0.0, *(self.model.scores[i] / len(p) for p, i in self.pieces.items() if p)])

    @cached_property
    def unknown(self) -> float:
        lowest = min((self.model.scores[i] for i in self.pieces.values()), default=0.0)
        return 0.0 if self.model.bpe else self.lift + _UNKNOWN_PENALTY - lowest

    @cached_property
    def bytes(self) -> dict[int, int]:
        return {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.model.pieces, self.model.kinds)) if k == 6}

    @cached_property
    def unknown_id(self) -> int:
        return self.model.kinds.index(2) if 2 in self.model.kinds else 0

    @cached_property
    def unit(self) -> re.Pattern | None:
        """What can be composed on its own: blanks and what follows them, and line ends if no piece has any."""
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            return None
        apart = "" if any("\n" in p for p in self.pieces) else "\n"
        blank = f" {MARK}"
        return re.compile(f"[{blank}]+[^{blank}{apart}]*|[^{blank}{apart}]+" + ("|\n" if apart else ""))

    @staticmethod
    def _written(piece: str, kind: int) -> bytes:
        if kind == 6:
            return bytes([int(piece[1:-1], 16)])
        return {2: " ⁇ ", 3: ""}.get(kind, piece.replace(MARK, " ")).encode()

    def path(self, labels: str) -> list[int]:
        """Ids for marked characters."""
        if not labels:
            return []
        outputs = shortest_path(Composition(Lattice(labels, self.lexicon, self.unknown), self.acceptor))
        if max(outputs) < _CHARACTER:
            return outputs
        return [i for o in outputs for i in ((o,) if o < _CHARACTER else self.spelled(chr(o - _CHARACTER)))]

    def spelled(self, char: str) -> list[int]:
        """Byte fallback."""
        if self.model.byte_fallback and self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown_id]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        normaliser = self.normaliser
        if self.unit is None:
            out = self.path(normaliser.compose(text)[0])
        else:
            state, out = normaliser.BEGIN, []
            units = self.unit.findall(text)
            if normaliser.settles:
                out += self._through(units.pop(0), state)[0]
                recent = self.recent
                for unit in units:
                    path = recent.get(unit)
                    if path is None:
                        path = self._word(unit)
                        recent = self.recent
                    out += path
            else:
                for unit in units:
                    path, state = self._through(unit, state)
                    out += path
        if not self.bytes or not self.model.byte_fallback:  # a run of unknown characters is one
            u = self.unknown_id
            out = [x for x, before in zip(out, [None, *out]) if x != u or before != u]
        return out

    def _through(self, unit: str, state: int) -> tuple[list[int], int]:
        labels, state = self.normaliser.compose(unit, state)
        return self.path(labels), state

    def _word(self, unit: str) -> tuple[int, ...]:
        """The path of a unit inside a text."""
        path = self.older.get(unit)
        if path is None:
            path = tuple(self._through(unit, self.normaliser.INSIDE)[0])
        if len(unit) <= _LONGEST:
            if len(self.recent) >= _WORDS:
                self.older, self.recent = self.recent, {}
            self.recent[unit] = path
        return path

    def decode(self, ids: list[int] | None) -> str:
        text = b"".join(map(self.output.__getitem__, ids or ())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_MACHINES: OrderedDict[str, Machine] = OrderedDict()


class _Shared:
    """A model broadcast to the tasks; its size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, model: Model):
        self.digest, self._value = model.digest(), spark.sparkContext.broadcast(model)

    def machine(self) -> Machine:
        """The worker's machine for this model: the words it has met stay known between tasks."""
        machine = _MACHINES.get(self.digest)
        if machine is None:
            machine = _MACHINES[self.digest] = Machine(self._value.value)
            while len(_MACHINES) > _MACHINES_KEPT:
                _MACHINES.popitem(last=False)
        _MACHINES.move_to_end(self.digest)
        return machine


# --- tables ------------------------------------------------------------------------


def _pieces_of(batch: pa.RecordBatch, sized: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in column `sized`, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(sized)) if pa.types.is_string(batch.column(sized).type)
                         else pc.multiply(pc.list_value_length(batch.column(sized)), 4), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _transform(rows: DataFrame, model: Model | str | None, read: str, write: dict[str, T.DataType]) -> DataFrame:
    """`rows` with the columns `write`, `ids` of the texts or `decoded` from ids or from those just made."""
    spark = rows.sparkSession
    if model is None:
        model = spark.conf.get(SETTING, MODEL)
    model = Model.read(model) if isinstance(model, str) else model
    rows = rows.drop(*write)
    shared, at, encode, decode = _Shared(spark, model), rows.columns.index(read), "ids" in write, "decoded" in write
    names = [*rows.columns, *write]
    rows = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # names with dots do not pass mapInArrow
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in write.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.machine()
        for whole in batches:
            for batch in _pieces_of(whole, at, _BATCH):
                lists, texts = [], []
                for item in batch.column(at):
                    ids = machine.encode(item.as_py()) if encode else item.values.to_numpy().tolist() if item.is_valid else None
                    if encode:
                        lists.append(np.array(ids, np.int32))
                    if decode:
                        texts.append(machine.decode(ids))
                added = []
                if encode:
                    offsets = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum([len(x) for x in lists], out=offsets[1:])
                    added.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32))))
                if decode:
                    added.append(pa.array(texts, pa.string()))
                yield pa.record_batch([*batch.columns, *added], [*batch.schema.names, *write])

    return rows.mapInArrow(run, schema).toDF(*names)


_IDS = {"ids": T.ArrayType(T.IntegerType())}
_DECODED = {"decoded": T.StringType()}


def encode(docs: DataFrame, model: Model | str | None = None) -> DataFrame:
    """`docs` with `ids array<int>`."""
    return _transform(docs, model, "text", _IDS)


def decode(rows: DataFrame, model: Model | str | None = None) -> DataFrame:
    """`rows` (with ids) with `decoded string`."""
    return _transform(rows, model, "ids", _DECODED)


def round_trip(docs: DataFrame, model: Model | str | None = None) -> DataFrame:
    """`docs` with `ids` and what they decode to, in one pass."""
    return _transform(docs, model, "text", _IDS | _DECODED)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"),
    )
