"""Byte-level BPE: a lazily built transducer for encoding, an incremental state machine for decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, in_workers, text_or_empty

# Bounds of what a worker remembers. When one is reached that table starts anew; results do not change.
MAX_STATES = 200_000
MAX_PAIRS = 120_000
MAX_MOVES = 20_000
MAX_KNOWN = 10_000
MAX_WORD_BYTES = 24 << 20
LONGEST_WORD = 64
OPENING, MAX_OPENINGS = 6, 5_000
# So many pieces are not worth a step of all at once.
FEW_PIECES = 16
# A blank between white space: only there does the pattern look across a blank.
OPEN_BLANK = re.compile(r"\s (?:\s|$)")
ROWS_AT_ONCE = 128
BYTES_AT_ONCE = 3 << 20
IDS_AT_ONCE = 4096
DECODED_AT_ONCE = 1 << 16


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def laid_out(values: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of runs of values with the given sizes, the chosen runs one after the other."""
    size = sizes[chosen]
    end = np.cumsum(size)
    return values[np.arange(int(size.sum())) + np.repeat((np.cumsum(sizes) - sizes)[chosen] - (end - size), size)]


def _state(before: int | None, data: bytes, boundaries: list[tuple[int, tuple[int, ...]]]) -> tuple:
    """A state as one flat tuple: each boundary is its place, the number of ranks that lead to it, and these."""
    flat: list = [before, data]
    for start, path in boundaries:
        flat += (start, len(path), *path)
    return tuple(flat)


def _boundaries(state: tuple) -> list[tuple[int, tuple[int, ...]]]:
    found, at = [], 2
    while at < len(state):
        end = at + 2 + state[at + 1]
        found.append((state[at], state[at + 2 : end]))
        at = end
    return found


class Transducer:
    """Reads a piece byte by byte and emits ranks as soon as no later byte can change them.

    A state holds the bytes that are not settled yet and the boundaries among them that may still matter: the end,
    and those behind which the bytes start some longer token. Each has the ranks that lead to it. A
    further byte adds one boundary, reached by the only token that ends there and whose pair with the token before it
    would itself be encoded as that pair. Ranks that all boundaries have in common are settled and emitted.
    Token lengths bound that lookahead. States and moves are made when first met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.starts = {token[:size] for token in ranks for size in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # Last settled rank (-1 where it cannot matter), open bytes, boundaries, and the ranks that lead to each.
        start = _state(None, b"", [(0, ())])
        self.number: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        # By state and byte, for single pieces: the next state, or that and the ranks that are emitted.
        self.moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        # The same for many pieces at once, in order of state and byte, with what is emitted as a number in ``outs``; and the moves
        # that are still to be added.
        self.keys, self.targets, self.emits = (np.zeros(0, dtype=kind) for kind in (np.int64, np.int32, np.int32))
        self.fresh: dict[int, tuple[int, int]] = {}
        self.outs: list[tuple[int, ...]] = [()]
        self.out_number: dict[tuple[int, ...], int] = {(): 0}
        self.openings: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes, below: int) -> list[bytes]:
        """Plain merging, lowest rank first, with ranks under ``below``."""
        parts = [data[at : at + 1] for at in range(len(data))]
        while len(parts) > 1:
            options = ((self.ranks.get(a + b, below), at) for at, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            rank, at = min(options)
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or a token that merging never makes."""
        if token not in self.halves:
            parts = self.merged(self.bytes_of[token], token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def stands(self, left: int | None, right: int) -> bool:
        """Whether the bytes of the two tokens are encoded as just these two; left may be nothing.

        The merges on either side of the border are taken back from the latest on. If some step shows a pair across
        the border that would have merged before the part it breaks, the two tokens do not stand.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, len(self.ranks) + 1
        answer = None if len(self.bytes_of[right]) == 1 or self.split(right) is not None else False
        if left is None and answer is None:
            answer = True
        while answer is None:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < before:
                answer = False
                break
            of_a, of_b = self.split(a), self.split(b)
            if of_a is None and of_b is None:
                answer = True
            elif of_b is None or (of_a is not None and a > b):
                a, before = of_a[1], a
            else:
                # On the right a pair across the border comes first in the text, so it wins a tie.
                b, before = of_b[0], b + 1
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = answer
        return answer

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, data, *_ = known = self.states[state]
        boundaries = _boundaries(known)
        data = data + bytes((byte,))
        for start, path in boundaries:
            token = self.ranks.get(data[start:])
            if token is not None and self.stands(path[-1] if path else before, token):
                break
        else:
            raise ValueError("the ranks must hold every single byte")
        whole = (*path, token)
        kept = [(start, path) for start, path in boundaries if data[start:] in self.starts]
        common = len(whole)
        for _, path in kept:
            common = min(common, len(path))
            while path[:common] != whole[:common]:
                common -= 1
        kept.append((len(data), whole))
        emitted = whole[:common]
        if emitted:
            size = sum(len(self.bytes_of[rank]) for rank in emitted)
            before, data = emitted[-1], data[size:]
            kept = [(start - size, path[common:]) for start, path in kept]
        if kept[0][0]:
            before = -1
        key = _state(before, data, kept)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
        return target, emitted

    def _open(self, state: int) -> tuple[int, ...]:
        """The ranks that are still to come when a piece ends in this state."""
        return _boundaries(self.states[state])[-1][1]

    def _run(self, piece: bytes, state: int, ids: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) >= MAX_MOVES:
                    moves.clear()
                target, emitted = self._move(state, byte)
                moves[state << 8 | byte] = move = (target, emitted) if emitted else target
            if move.__class__ is int:
                state = move
            else:
                state = move[0]
                ids += move[1]
        return state, ids

    def _out(self, ranks: tuple[int, ...]) -> int:
        number = self.out_number.get(ranks)
        if number is None:
            number = self.out_number[ranks] = len(self.outs)
            self.outs.append(ranks)
        return number

    def _fresh_move(self, key: int) -> tuple[int, int]:
        move = self.fresh.get(key)
        if move is None:
            target, emitted = self._move(key >> 8, key & 255)
            move = self.fresh[key] = (target, self._out(emitted))
        return move

    def _add_fresh(self) -> None:
        if not self.fresh:
            return
        moves = np.array(list(self.fresh.values()), dtype=np.int32)
        keys = np.concatenate([self.keys, np.fromiter(self.fresh, dtype=np.int64, count=len(moves))])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.targets = np.concatenate([self.targets, moves[:, 0]])[order]
        self.emits = np.concatenate([self.emits, moves[:, 1]])[order]
        self.fresh = {}

    def _step(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and number of what is emitted, for many states and bytes."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            target, emit = self.targets[at], self.emits[at]
            missing = np.flatnonzero(self.keys[at] != key)
        else:
            target, emit = np.zeros(len(key), dtype=np.int32), np.zeros(len(key), dtype=np.int32)
            missing = np.arange(len(key))
        if len(missing):
            keys, same = np.unique(key[missing], return_inverse=True)
            moves = np.array([self._fresh_move(one) for one in keys.tolist()], dtype=np.int32)
            target[missing], emit[missing] = moves[same].T
        return target, emit

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of many pieces, one after the other, and how many each has.

        All pieces move by one byte at a time; Python is entered only for a move that has not been met. Once few
        pieces are left, the rest of each is read on its own.
        """
        if len(self.states) > MAX_STATES:
            self._reset()
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data, order = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.argsort(-lengths, kind="stable")
        ends, start = np.sort(lengths), (np.cumsum(lengths) - lengths)[order]
        state, step = np.zeros(len(pieces), dtype=np.int64), 0
        owners, emits, rest = [], [], []
        while (active := len(pieces) - int(np.searchsorted(ends, step, side="right"))) > FEW_PIECES:
            state[:active], emit = self._step(state[:active] << 8 | data[start[:active] + step])
            some = np.flatnonzero(emit)
            owners.append(some)
            emits.append(emit[some])
            step += 1
        for at in range(active):
            state[at], ranks = self._run(pieces[order[at]][step:], int(state[at]), ())
            rest.append(ranks)
        reached, same = np.unique(state, return_inverse=True)
        last = np.array([self._out(self._open(one)) for one in reached.tolist()], dtype=np.int64)
        self._add_fresh()
        outs = [*self.outs, *rest]
        sizes = np.fromiter(map(len, outs), dtype=np.int64, count=len(outs))
        flat = np.fromiter(chain.from_iterable(outs), dtype=np.int32, count=int(sizes.sum()))
        owner = order[np.concatenate([*owners, np.arange(active), np.arange(len(pieces))])]
        emit = np.concatenate([*emits, len(self.outs) + np.arange(active), last[same]])
        counts = np.bincount(owner, weights=sizes[emit], minlength=len(pieces)).astype(np.int64)
        return laid_out(flat, sizes, emit[np.argsort(owner, kind="stable")]), counts

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ranks of one piece. Where pieces begin alike, the run over the beginning is remembered."""
        if len(self.states) > MAX_STATES:
            self._reset()
        begin = piece[:OPENING]
        known = self.openings.get(begin)
        if known is None:
            known = self._run(begin, 0, ())
            if len(self.openings) < MAX_OPENINGS:
                self.openings[begin] = known
        state, ids = self._run(piece[OPENING:], *known)
        return ids + self._open(state)

    def encode_text(self, piece: str) -> tuple[int, ...]:
        return self.encode(piece.encode())


class Known(dict):
    """Ids by text, worked out when first asked for; what is not asked for again is forgotten in time."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]], most: int = MAX_KNOWN):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(text) < 64:
            self[text] = ids
        return ids


class Encoder:
    """Splits a text by the pattern and encodes every match on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.at_blanks = pattern == public_tokenizers.PATTERN
        self.pieces = Known(self.transducer.encode_text, MAX_KNOWN // 4)
        self.after_blank = Known(lambda word: self.encode_chunk(" " + word))
        self.at_start = Known(self.encode_chunk)
        self._forget()

    def _forget(self) -> None:
        # Words of earlier batches, with the blank before them, and their ids one after the other.
        self.words = pa.array([], pa.string())
        self.word_ids, self.word_sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def whole(self, text: str) -> bool:
        """Whether the text is not to be split at blanks: another pattern may look across any of them."""
        return not self.at_blanks or OPEN_BLANK.search(text) is not None

    def encode_chunk(self, text: str) -> tuple[int, ...]:
        if text[1:].isalpha() and text[0] == " ":  # one match: letters behind a blank
            return self.transducer.encode_text(text)
        matches = self.pattern.findall(text)
        if len(matches) == 1:
            return self.transducer.encode_text(text)
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, matches)))

    def encode_pieces(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts that are encoded on their own, one after the other, and how many each has."""
        # Letters behind a blank are one match.
        alone = np.fromiter((self.at_blanks and chunk[1:].isalpha() and chunk[0] == " " for chunk in chunks), dtype=bool, count=len(chunks))
        simple = list(compress(chunks, alone.tolist()))
        split = list(map(self.pattern.findall, compress(chunks, (~alone).tolist())))
        number: dict[str, int] = {}
        matches = [number.setdefault(match, len(number)) for match in chain.from_iterable(split)]
        flat, sizes = self.transducer.encode_all([piece.encode() for piece in chain(simple, number)])
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        piece = np.concatenate([np.arange(len(simple)), len(simple) + np.array(matches, dtype=np.int64)])
        owner = np.concatenate([np.flatnonzero(alone), np.repeat(np.flatnonzero(~alone), counts)])
        total = np.bincount(owner, weights=sizes[piece], minlength=len(chunks)).astype(np.int64)
        return laid_out(flat, sizes, piece[np.argsort(owner, kind="stable")]), total

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_chunks`` for different words; those of earlier batches are remembered, up to ``MAX_WORD_BYTES``."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.words) + np.arange(len(new))
        fresh = words.take(pa.array(new))
        flat, sizes = self.encode_chunks(fresh.to_pylist())
        flat, sizes = np.concatenate([self.word_ids, flat]), np.concatenate([self.word_sizes, sizes])
        self._remember(pa.concat_arrays([self.words, fresh]), flat, sizes)
        flat, sizes = laid_out(flat, sizes, at), sizes[at]
        if not len(self.words):
            self._remember(words, flat, sizes)
        return flat, sizes

    def _remember(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Hold these words, without long ones, or none if they are too many."""
        short = np.flatnonzero(pc.binary_length(words).to_numpy() <= LONGEST_WORD)
        if len(short) < len(words):
            words, flat, sizes = words.take(pa.array(short)), laid_out(flat, sizes, short), sizes[short]
        if words.nbytes + flat.nbytes + sizes.nbytes > MAX_WORD_BYTES:
            self._forget()
        else:
            self.words, self.word_ids, self.word_sizes = words, flat, sizes

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """The ids of many whole texts, as a list array.

        The texts are split as ``encode`` does, all at once, and every different word of the batch is looked up once; the ids are
        then laid out by the words' numbers.
        """
        plain = texts.to_pylist()
        open_blank = np.fromiter((self.whole(text) for text in plain), dtype=bool, count=len(plain))
        split = pc.split_pattern(texts.filter(pa.array(~open_blank)).cast(pa.string()), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        starts, first = np.unique(code[offsets[:-1]], return_inverse=True)
        behind = np.ones(len(code), dtype=bool)
        behind[offsets[:-1]] = False
        used = np.zeros(len(words), dtype=bool)
        used[code[behind]] = True
        code = (np.cumsum(used) - 1)[code]
        code[offsets[:-1]] = np.count_nonzero(used) + first
        after_blank = pc.binary_join_element_wise("", words.filter(pa.array(used)), " ")
        flat, size = self.encode_words(pa.concat_arrays([after_blank, words.take(pa.array(starts))]))
        end = np.cumsum(size[code])
        flat = laid_out(flat, size, code)
        borders = np.concatenate([[0], end])[offsets].astype(np.int32)
        done = pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))
        if not open_blank.any():
            return done
        flat, size = self.encode_chunks([text for text, one in zip(plain, open_blank.tolist(), strict=True) if one])
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
        place = np.where(open_blank, len(done) + np.cumsum(open_blank) - 1, np.cumsum(~open_blank) - 1)
        return pa.concat_arrays([done, rest]).take(pa.array(place))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text.

        Where no blank stands between white space, no match reaches over a blank except with it as its first
        character. Then the words behind blanks are encoded one by one, and equal words only once.
        """
        if not text:
            return []
        if self.whole(text):
            return list(self.encode_pieces(text))
        first, *words = text.split(" ")
        ids = list(self.at_start[first]) if first else []
        ids.extend(chain.from_iterable(map(self.after_blank.__getitem__, words)))
        return ids


class Utf8Stream:
    """Incremental UTF-8: characters come out as soon as their last byte is there.

    Between calls it holds the start of at most one character. Bytes that can never become a character are
    shown as U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _missing(tail: bytes) -> bool:
        """Whether the bytes are the proper start of a character."""
        lead = tail[0]
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if len(tail) >= size:
            return False
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
            lead, (0x80, 0xBF)
        )
        if len(tail) > 1 and not low <= tail[1] <= high:
            return False
        return all(0x80 <= byte <= 0xBF for byte in tail[2:])

    def feed(self, data: bytes) -> str:
        data = self.held + data
        self.held = b""
        for size in range(1, min(3, len(data)) + 1):
            byte = data[-size]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                if self._missing(data[-size:]):
                    data, self.held = data[:-size], data[-size:]
                break
        return data.decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace")


def read_stream(parts: Iterable[bytes]) -> Iterator[str]:
    """The text of a stream of bytes, in parts; no part waits for more than the rest of one character."""
    stream = Utf8Stream()
    for data in parts:
        if part := stream.feed(data):
            yield part
    if part := stream.finish():
        yield part


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """The text of a stream of ids, in parts, as ``read_stream`` gives it."""
    ids = iter(ids)
    return read_stream(b"".join(map(bytes_of.__getitem__, some)) for some in iter(lambda: list(islice(ids, IDS_AT_ONCE)), []))


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    """The rank file at ``path`` on this machine, or as Spark has sent it."""
    try:
        file = open(path, "rb")  # noqa: SIM115
    except FileNotFoundError:
        file = open(SparkFiles.get(path.rpartition("/")[2]), "rb")  # noqa: SIM115
    with file:
        return read_ranks(file)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> pa.Array:
    """Token bytes in order of their ranks, null where there is none."""
    bytes_of = {rank: token for token, rank in _ranks(path).items()}
    return pa.array(map(bytes_of.get, range(max(bytes_of, default=-1) + 1)), pa.large_binary())


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``BYTES_AT_ONCE`` bytes of text in their last column."""
    part = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)) // BYTES_AT_ONCE
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def _with_column(batch: pa.RecordBatch, values: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*batch.schema.names[:-1], name])


def _beside(df: DataFrame, rest: list[str], value: Column, name: str) -> DataFrame:
    """The other columns in one, whatever they are called, and the value."""
    others = [column(other).alias(other) for other in rest] or [F.lit(0).alias("_none")]
    return df.select(F.struct(*others).alias("_row"), value.alias(name))


def _spread_out(df: DataFrame, rest: list[str], name: str) -> DataFrame:
    return df.select(*(F.col("_row").getField(other).alias(other) for other in rest), column(name))


def _texts_of(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The text of each row of ids. The tokens of many rows are looked up at once; the bytes of each row are read as a stream."""
    texts = []
    for start in range(0, len(ids), ROWS_AT_ONCE):
        rows = ids.slice(start, ROWS_AT_ONCE)
        found = tokens.take(rows.flatten())
        if found.null_count:
            raise KeyError("an id that no token has")
        borders = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())]).astype(np.int32)
        for data in pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), found), pa.scalar(b"", found.type)).to_pylist():
            parts = (data[at : at + DECODED_AT_ONCE] for at in range(0, len(data), DECODED_AT_ONCE))
            texts.append("".join(read_stream(parts)))
    return pa.array(texts, pa.string())


def bpe_encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """The given columns without the text, and its ids as ``array<int>``.

    Every text is encoded whole; a null or empty text has no ids. Rows are independent, nothing is shuffled, and an
    empty table gives an empty result. A column that is named like a result is replaced. The rank file is read
    at ``ranks_path`` on every machine, or sent along with ``SparkContext.addFile``. With ``decoded_col`` the ids are decoded
    again by the same worker, as ``bpe_decode`` does, and the text that comes out is one more column.
    """
    in_workers(docs.sparkSession)
    results = [ids_col] if decoded_col is None else [ids_col, decoded_col]
    rest = [name for name in docs.columns if name != text_col and name not in results]
    source = _beside(docs, rest, text_or_empty(text_col), ids_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            for part in _slices(batch):
                ids = encoder.encode_batch(part.column(part.num_columns - 1))
                more = [] if decoded_col is None else [_texts_of(ids, _tokens(ranks_path))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *more], names=[*part.schema.names[:-1], *results])

    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    fields = [*source.schema.fields[:-1], *(T.StructField(name, kind) for name, kind in zip(results, kinds, strict=False))]
    encoded = source.mapInArrow(encode, T.StructType(fields))
    return encoded.select(*(F.col("_row").getField(other).alias(other) for other in rest), *(column(name) for name in results))


def bpe_decode(df: DataFrame, ranks_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The given columns and the text of their ids. No ids, or null, give an empty text; an unknown id is an error."""
    in_workers(df.sparkSession)
    rest = [name for name in df.columns if name != text_col]
    source = _beside(df, rest, F.coalesce(column(ids_col), F.array().cast("array<int>")), text_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks_path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                yield _with_column(part, _texts_of(part.column(part.num_columns - 1), tokens), text_col)

    fields = [*source.schema.fields[:-1], T.StructField(text_col, T.StringType())]
    return _spread_out(source.mapInArrow(decode, T.StructType(fields)), rest, text_col)
